"""Quantiles over value counts, exact folds and AUC, scenario growth, scaled ridge,
quoted separators, wide frames of many columns."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.functions.quantiles import exact_medians, exact_quantiles
from panelkit.operators import composition as E
from panelkit.operators import ingest as I
from panelkit.operators import models as M
from panelkit.session import ensure_checkpoint_dir


def test_quantiles_with_a_value_of_half_the_rows(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab") if i % 7 else None, 5.0 if i % 2 else rng.random() * 10) for i in range(4000)] + [("a", None), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.q): r.value for r in exact_quantiles(df, "v", qs, ["g"]).collect()}
    for g in ("a", "b", None):
        v = [x for k, x in rows if k == g and x is not None]
        for q in qs:
            assert math.isclose(got[g, q], np.quantile(v, q), rel_tol=1e-12)
    assert len(got) == 15  # a group without values is absent
    assert exact_quantiles(df, "v", [0.5]).first().value == np.quantile([x for _, x in rows if x is not None], 0.5)
    assert exact_quantiles(df.limit(0), "v", [0.5]).count() == 0
    assert exact_medians(df, ["v"]).first().v == 5.0
    assert exact_medians(df.limit(0), ["v"]).first().v is None


def test_stratified_folds_and_auc(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("xy"), int(rng.random() < 0.1), round(rng.random(), 7)) for i in range(1500)]
    df = spark.createDataFrame(rows, "k int, cat string, y int, score double").repartition(5)
    d = M.stratified_folds(df, ["k"], ["cat", "y"], 5)
    sizes = [r["count"] for r in d.groupBy("cat", "y", "fold").count().collect()]
    assert len(sizes) == 20
    for cat in "xy":
        for y in (0, 1):
            n = [r["count"] for r in d.where((F.col("cat") == cat) & (F.col("y") == y)).groupBy("fold").count().collect()]
            assert max(n) - min(n) <= 1
    for r in M.grouped_auc(df, ["cat"], "y").collect():
        p = [s for _, c, y, s in rows if c == r.cat and y]
        n = [s for _, c, y, s in rows if c == r.cat and not y]
        want = sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))
        assert math.isclose(r.auc, want, rel_tol=1e-12)


def test_ridge_is_on_standardised_features(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(1e5, 3e4, 200), rng.normal(0, 1, 200)])
    y = 2e-5 * x[:, 0] - x[:, 1] + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, y double")
    for alpha in (0.0, 1.0, 50.0):
        z = (x - x.mean(0)) / x.std(0)
        w = np.linalg.solve(z.T @ z + alpha * np.eye(2), z.T @ (y - y.mean())) / x.std(0)
        got = M.gram_fit(df, ["a", "b"], "y", alpha)
        assert np.allclose(got, [y.mean() - w @ x.mean(0), *w], rtol=1e-6)


def test_growth_is_over_the_last_three_rows(spark):
    rows = [("a", 2000, 100.0), ("a", 2001, None), ("a", 2002, 200.0), ("a", 2003, 202.0), ("a", 2004, 206.04), ("b", 2000, 5.0), ("c", 2000, None),
            ("d", 2000, 1.0), ("d", 2001, 100.0), ("d", 2002, 104.0), ("d", 2003, None)]
    df = spark.createDataFrame([(n, y, g, 10, 1) for n, y, g in rows], "n string, y int, gdp double, pop int, m int")
    got = {r.n: r.growth for r in M.project_scenario(df, "n", "y", "gdp", "pop", "m").collect()}
    assert math.isclose(got["a"], 0.015) and set(got) == {"a", "b", "c", "d"} and got["b"] == got["c"]
    assert math.isclose(got["d"], 0.04)


def test_specialization_over_a_zero_filled_grid(spark):
    grid = [("p", "s1", 8), ("p", "s2", 2), ("p", "s3", 0), ("q", "s1", 2), ("q", "s2", 2), ("q", "s3", 6)]
    df = spark.createDataFrame(grid, "label string, sport string, n long")
    got = {(r.label, r.sport): r for r in E.specialization(df, "label", "sport", top=1, bottom=1).collect()}
    assert set(got) == {("p", "s1"), ("p", "s3"), ("q", "s3"), ("q", "s1")}
    assert math.isclose(got["p", "s1"]["index"], 0.8 / 0.5) and got["p", "s3"]["index"] == 0.0 and got["p", "s3"].side == "bottom"


def test_unlabelled_rows_are_no_units(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None)], "event string, label string")
    assert [(r.event, r.athletes) for r in E.event_units(df, ["event", "label"], required="label").collect()] == [("a", 2)]


def test_entity_files_with_quoted_separators(spark, tmp_path):
    (tmp_path / "ITA.csv").write_text('Year,"GDP, total",Pop\nYR2000,"1",2\n"YR2001", 3 ,"x, ""y"""\n')
    long, skipped = I.read_entity_series(spark, str(tmp_path / "*.csv"))
    got = {(r.noc, r.year, r.indicator): r.value for r in long.collect()}
    assert got == {("ITA", 2000, "GDP, total"): 1.0, ("ITA", 2000, "Pop"): 2.0, ("ITA", 2001, "GDP, total"): 3.0, ("ITA", 2001, "Pop"): None}
    assert skipped.count() == 0


def test_more_than_a_thousand_columns(spark):
    df = spark.range(1200).select(F.lit("e").alias("noc"), (F.col("id") + 1000).cast("string").alias("year"), F.col("id").cast("double").alias("v"))
    years = sorted(r[0] for r in df.select("year").distinct().collect())
    back = I.to_long(I.to_wide(df, ["noc"], "year", "v", years), ["noc"])
    assert back.count() == 1200 and back.agg(F.sum("value")).first()[0] == sum(range(1200))


def test_cluster_without_shared_folder_is_an_error(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())
