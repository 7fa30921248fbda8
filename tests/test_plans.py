"""Plan-shape checks for the scale claims, plus a hot-key correctness check."""

from pyspark.sql import functions as F

from panelkit.operators import panel as P
from panelkit.operators import quality as Q
from panelkit.plans import tables as tb


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_trailing_mean_is_one_window_no_join(spark):
    panel = spark.createDataFrame([("a", 2000, "e")], "noc string, year int, edition string")
    series = spark.createDataFrame([("a", 1998, 1.0)], "noc string, year int, gdp double")
    plan = _plan(P.trailing_mean(panel, series, "noc", "year", ["gdp"]))
    assert "Window" in plan and "Join" not in plan


def test_first_per_key_aggregates_map_side(spark):
    df = spark.createDataFrame([("k", i, str(i)) for i in range(10)], "code string, o int, v string")
    plan = _plan(Q.dedup_first(df, ["code"], ["o"]))
    assert "Window" not in plan and "partial_min_by" in plan   # combined map-side before the exchange


def test_scan_pruning_and_pushdown(spark):
    d = "/root/testdata/sf0.001"
    df = tb.order_facts(spark, d).filter(F.col("year") == 1997).select("noc", "o_totalprice")
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = [ln for ln in plan.split("\n") if "orders.parquet" in ln][0]
    read_schema = scan.split("ReadSchema:")[1]
    assert "o_orderstatus" not in read_schema and "o_orderpriority" not in read_schema   # pruned
    assert "IsNotNull(o_custkey)" in scan                                               # pushed


def test_hot_key_results_whole(spark):
    # one key holds a third of the rows: results stay complete and exact
    rows = [("hot", i % 7 + 1995, float(i)) for i in range(3000)] + \
           [(f"k{i}", 1995 + i % 7, float(i)) for i in range(6000)]
    df = spark.createDataFrame(rows, "noc string, year int, v double")
    series = df.groupBy("noc", "year").agg(F.avg("v").alias("v"))
    panel = spark.createDataFrame([("hot", 2001, "e")], "noc string, year int, edition string")
    got = P.trailing_mean(panel, series, "noc", "year", ["v"]).first().v
    import statistics
    by_year = {y: statistics.mean(float(i) for i in range(3000) if i % 7 + 1995 == y) for y in range(1997, 2001)}
    assert abs(got - statistics.mean(by_year.values())) < 1e-9
    dup = Q.duplicate_rows(df.select("noc"), ["noc"])
    assert dup.filter(F.col("noc") == "hot").count() == 3000
    first = Q.dedup_first(df, ["noc"], ["v"]).filter(F.col("noc") == "hot").first()
    assert first.v == 0.0
