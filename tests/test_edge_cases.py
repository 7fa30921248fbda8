"""Edge cases listed for fixtures: comma names, successor codes, one code with
two names, overrides, window years partly / fully missing, before-rate 0."""

from pyspark.sql import functions as F

from panelkit.operators import cluster as D
from panelkit.operators import composition as E
from panelkit.operators import quality as Q


def test_propagate_key_then_name_then_prefix(spark):
    target = spark.createDataFrame([("KOR", "Korea, Republic of"), ("ITA", "Italy"), ("XXX", "Korea"), ("ZZZ", "Nowhere")],
                                   "noc string, country string")
    source = spark.createDataFrame([("KOR", "South Korea", "rich", 1), (None, "Italy", "mid", 2), (None, "Korea", "poor", 3)],
                                   "noc string, country string, label string, o int")
    got = {r.noc: (r.label, r.matched_by) for r in
           D.propagate_labels(target, source, key="noc", name="country", label="label", source_order=["o"]).collect()}
    assert got["KOR"] == ("rich", "key") and got["ITA"] == ("mid", "name")
    assert got["XXX"] == ("poor", "name") and got["ZZZ"] == (None, None)
    t2 = spark.createDataFrame([("AAA", "Korea, Democratic")], "noc string, country string")
    assert D.propagate_labels(t2, source, key="noc", name="country", label="label",
                              source_order=["o"]).first().matched_by == "prefix"


def test_alias_successor_only_competed_years(spark):
    lookup = spark.createDataFrame([("RUS", 1992, "a"), ("RUS", 1996, "b")], "noc string, year int, label string")
    aliases = spark.createDataFrame([("URS", "RUS")], "alias string, successor string")
    competed = spark.createDataFrame([("URS", 1992), ("URS", 1992)], "alias string, year int")
    got = sorted((r.noc, r.year) for r in D.alias_successor(lookup, aliases, "noc", time="year", competed=competed).collect())
    assert got == [("RUS", 1992), ("RUS", 1996), ("URS", 1992)]


def test_code_with_two_names_and_override(spark):
    df = spark.createDataFrame([("GER", "Germany", 1), ("GER", "West Germany", 2), ("ITA", "Italy", 3)],
                               "code string, name string, o int")
    multi = Q.names_per_key(df, "code", "name").collect()
    assert [(r.code, r.n_names) for r in multi] == [("GER", 2)]
    names = spark.createDataFrame([("Germany", "DEU", 1), ("Germany", "GER", 2), ("Italy", "ITA", 3)],
                                  "name string, code string, o int")
    over = spark.createDataFrame([("Italy", "ITL")], "name string, code string")
    got = {(r.name, r.o): r.code for r in Q.canonical_code(names, "name", "code", ["o"], over).collect()}
    assert got == {("Germany", 1): "DEU", ("Germany", 2): "DEU", ("Italy", 3): "ITL"}


def test_before_after_zero_before_rate(spark):
    rates = spark.createDataFrame([("a", 1, "P", 0.0), ("a", 2, "P", 0.0), ("a", 3, "R", 5.0), ("a", 4, "R", 7.0),
                                   ("b", 1, "R", 2.0), ("b", 2, "P", 1.0), ("b", 3, "P", 1.0), ("b", 4, "P", 4.0)],
                                  "k string, t int, l string, rate double")
    movers = spark.createDataFrame([("a",), ("b",)], "k string")
    got = {r.k: r for r in E.before_after(rates, movers, "k", "t", "l").collect()}
    assert got["a"].change_time == 3 and got["a"].rate_before == 0.0 and got["a"].pct_change is None
    assert got["b"].change_time == 2 and got["b"].rate_before == 2.0 and got["b"].pct_change == 0.0   # after = mean(1, 1, 4) = 2


def test_set_compare_and_side_by_side(spark):
    a = spark.createDataFrame([("X",), ("Y",), (None,)], "c string")
    b = spark.createDataFrame([("Y",), ("Z",)], "c string")
    got = {r.value: r.side for r in Q.set_compare(a, b, "c", "c").collect()}
    assert got == {"X": "only_a", "Y": "both", "Z": "only_b"}
