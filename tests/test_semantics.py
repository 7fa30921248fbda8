import decimal
import math

from pyspark.sql import functions as F

from panelkit.functions import semantics as S
from panelkit.functions.stats import chi2_sf, r_pvalue, t_pvalue


def test_safe_corr_constant_and_pairwise(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1.0), (2.0, 5.0, 2.0), (3.0, 5.0, None), (4.0, 5.0, 4.0)], "x double, c double, y double")
    r = df.agg(S.safe_corr("x", "c").alias("rc"), S.safe_corr("x", "y").alias("rxy"), S.pair_count("x", "y").alias("n")).first()
    assert r["rc"] is None            # constant column -> NULL, not an error
    assert abs(r["rxy"] - 1.0) < 1e-12 and r["n"] == 3


def test_last_non_null_per_column(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, None), ("a", 3, None)], "k string, t int, v double")
    assert df.groupBy("k").agg(S.last_non_null("v", "t").alias("v")).first()["v"] == 10.0


def test_half_even_and_division(spark):
    r = spark.range(1).select(S.bround(F.lit(2.5), 0).alias("a"), S.bround(F.lit(0.125), 2).alias("b"),
                              S.div(F.lit(1), F.lit(0)).alias("z")).first()
    assert r["a"] == 2.0 and r["b"] == 0.12 and r["z"] is None


def test_bands(spark):
    bins = [(-float("inf"), -15.0, "A"), (-15.0, 15.0, "B"), (15.0, 40.0, "C"), (40.0, float("inf"), "D")]
    df = spark.createDataFrame([(-15.0,), (15.0,), (15.01,), (None,)], "x double")
    got = [r[0] for r in df.select(S.bands_closed_right("x", bins)).collect()]
    assert got == ["A", "B", "C", None]          # (a, b] like pd.cut


def even_t(t, n):
    """Two-sided p for an even number of degrees of freedom, by the finite series in 60 digits."""
    with decimal.localcontext(prec=60):
        t, n = decimal.Decimal(t), decimal.Decimal(n)
        term = total = decimal.Decimal(1)
        for j in range(1, int(n) // 2):
            term *= n / (n + t * t) * (2 * j - 1) / (2 * j)
            total += term
        return float(1 - t / (n + t * t).sqrt() * total)


def test_distribution_tails(spark):
    """Known quantiles, closed forms, and tails far out."""
    t = [(2.228138851986274, 10.0, 0.05), (12.706204736432095, 1.0, 0.05), (0.0, 7.0, 1.0), (1.959964, 1e7, 0.05), (-2.0, 2.0, 0.18350341907227397),
         (40.0, 30.0, even_t(40, 30)), (3.5, 8.0, even_t(3.5, 8)), (3.0, 0.0, None)]
    got = [r[0] for r in spark.createDataFrame(t, "t double, n double, p double").coalesce(1).select(t_pvalue("t", "n")).collect()]
    for (_, _, want), p in zip(t, got):
        assert (want is None and p is None) or math.isclose(p, want, rel_tol=1e-6)
    up = spark.createDataFrame([(1.812461, 10.0), (-1.812461, 10.0)], "t double, n double").coalesce(1).select(t_pvalue("t", "n", "greater")).collect()
    assert math.isclose(up[0][0], 0.05, rel_tol=1e-5) and math.isclose(up[1][0], 0.95, rel_tol=1e-6)
    c = [(3.841458820694124, 1.0, 0.05), (5.0, 2.0, math.exp(-2.5)), (0.0, 4.0, 1.0), (18.307038053275146, 10.0, 0.05), (1000.0, 2.0, math.exp(-500)),
         (0.1, 50.0, 1.0), (None, 3.0, None)]
    got = [r[0] for r in spark.createDataFrame(c, "x double, k double, p double").coalesce(1).select(chi2_sf("x", "k")).collect()]
    for (_, _, want), p in zip(c, got):
        assert (want is None and p is None) or math.isclose(p, want, rel_tol=1e-6)
    assert spark.range(1).select(r_pvalue(F.lit(1.0), F.lit(9))).first()[0] == 0.0
