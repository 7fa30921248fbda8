from pyspark.sql import functions as F

from panelkit.operators import ingest as I
from panelkit.operators import quality as Q


def test_null_profile_exactly_30_is_drop(spark):
    rows = [(None,)] * 3 + [(1.0,)] * 7
    out = I.null_profile(spark.createDataFrame(rows, "x double"), ["x"], variant=1).first()
    assert out.pct_null == 30.0 and out.band == "Drop"


def test_duplicate_rows_keep_false_and_null_safe(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (3, "b"), (3, "b"), (3, "c")], "k int, v string")
    got = sorted((r.k, r.v) for r in Q.duplicate_rows(df).collect())
    assert got == [(1, None), (1, None), (3, "b"), (3, "b")]


def test_dedup_first(spark):
    df = spark.createDataFrame([("x", 2, "late"), ("x", 1, "early"), ("y", 5, "only")], "code string, o int, d string")
    got = {r.code: r.d for r in Q.dedup_first(df, ["code"], ["o"]).collect()}
    assert got == {"x": "early", "y": "only"}


def test_recode_replace_vs_map(spark):
    df = spark.createDataFrame([("URS",), ("ITA",)], "c string")
    m = Q.mapping_frame(spark, {"URS": "RUS"})
    assert sorted(r.c for r in Q.recode(df, "c", m, strict=False).collect()) == ["ITA", "RUS"]
    assert sorted((r.c or "") for r in Q.recode(df, "c", m, strict=True).collect()) == ["", "RUS"]


def test_fill_from_lookup(spark):
    df = spark.createDataFrame([(" ger ", None), ("ita", "NaN"), ("fra", "France"), ("zzz", " ")], "code string, name string")
    ref = spark.createDataFrame([("GER", "Germany", 1), ("ITA", "Italy", 1), ("ITA", "Italia", 2), (" ", "Blank", 3)],
                                "k string, v string, o int")
    filled, n, missing = Q.fill_from_lookup(df, "code", "name", ref, "k", "v", ["o"])
    got = {r.code.strip(): r.name for r in filled.collect()}
    assert got == {"ger": "Germany", "ita": "Italy", "fra": "France", "zzz": " "}
    assert n.first()["n_updated"] == 2
    assert [r.code for r in missing.collect()] == ["ZZZ"]


def test_code_bridge(spark):
    df = spark.createDataFrame([("GER",), ("ITA",), ("XXX",)], "code string")
    alias = spark.createDataFrame([("GER", "DEU")], "ioc string, iso3 string")
    known = spark.createDataFrame([("DEU", 276), ("ITA", 380)], "iso3 string, num_id int")
    got = {r.code: r.id3 for r in Q.code_bridge(df, "code", alias, known).collect()}
    assert got == {"GER": "276", "ITA": "380"}      # unknown code dropped


def test_to_long_and_coerce(spark):
    df = spark.createDataFrame([("A", "1.5", "x")], "id string, YR1999 string, `2000` string")
    out = sorted((r.year, r.value) for r in I.to_long(df, ["id"]).collect())
    assert out == [(1999, 1.5), (2000, None)]


def test_read_entity_series(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text("Year,GDP,POP\nYR2000,1.5,\nYR2001,x,3\n")
    (tmp_path / "BBB.csv").write_text("Year,POP\nYR2000,7\n")
    (tmp_path / "CCC.csv").write_text("Foo,POP\n1,2\n")
    long, skipped = I.read_entity_series(spark, str(tmp_path / "*.csv"))
    got = sorted((r.noc, r.year, r.indicator, r.value) for r in long.collect())
    assert ("AAA", 2000, "GDP", 1.5) in got and ("AAA", 2001, "GDP", None) in got and ("BBB", 2000, "POP", 7.0) in got
    assert [r.noc for r in skipped.collect()] == ["CCC"]
    assert I.indicator_order(long) == ["GDP", "POP"]
