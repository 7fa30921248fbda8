"""Statistics on economic drivers: correlation grids, per-group correlation
and OLS lines, top rates, edition totals, spend deltas, home effect,
medallist ranking (H1-H12).

Correlations and regressions are aggregate expressions (covariance
moments, ``regr_*``) evaluated in one pass per grouping; p-values are
computed from the aggregated statistic, never from rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from ..functions.semantics import bround, bands_closed_right, div, safe_corr, spread
from ..functions.stats import r_pvalue, t_pvalue


def corr_grid(df: DataFrame, xs: Sequence[str], ys: Sequence[str], min_n: int = 30,
              by: Sequence[str] = ()) -> DataFrame:
    """H1: Pearson r for every (x, y) pair on pairwise-complete rows; kept
    only with n >= min_n and both sides non-constant.  (by..., x, y, r, n)."""
    aggs, names = [], []
    for x in xs:
        for y in ys:
            both = F.col(x).isNotNull() & F.col(y).isNotNull()
            xx, yy = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
            k = f"{x}\u0001{y}"
            names.append(k)
            aggs.append(F.struct(safe_corr(x, y).alias("r"), F.count_if(both).alias("n"),
                                 ((spread(xx) > 0) & (spread(yy) > 0)).alias("ok")).alias(k))
    long = df.groupBy(*by).agg(*aggs).unpivot(list(by), names, "__k", "__v")
    parts = F.split("__k", "\u0001")
    out = long.select(*by, parts[0].alias("x"), parts[1].alias("y"), F.col("__v.r").alias("r"),
                      F.col("__v.n").alias("n"), F.col("__v.ok").alias("ok"))
    return out.filter((F.col("n") >= min_n) & F.col("ok")).drop("ok")


def corr_difference(grid: DataFrame, key: str, side: str, a: str, b: str) -> DataFrame:
    """H2: r_a - r_b per key (e.g. indicator), from a long grid with a side column."""
    p = grid.groupBy(key).agg(F.max(F.when(F.col(side) == a, F.col("r"))).alias("r_a"),
                              F.max(F.when(F.col(side) == b, F.col("r"))).alias("r_b"))
    return p.withColumn("diff", F.col("r_a") - F.col("r_b")).filter(F.col("diff").isNotNull())


def corr_by_group(df: DataFrame, group: Sequence[str], x: str, y: str, min_n: int = 10,
                  complete: Sequence[str] | None = None, with_p: bool = False) -> DataFrame:
    """H3: Pearson r per group on complete rows (all of ``complete`` non-null),
    groups with n >= min_n; t statistic and optional two-sided p."""
    d = df
    if complete:
        for c in complete:
            d = d.filter(F.col(c).isNotNull())
    a = d.groupBy(*group).agg(safe_corr(x, y).alias("r"), F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull())
                              .alias("n")).filter(F.col("n") >= min_n)
    a = a.withColumn("t", F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r"))))
    return a.withColumn("p_value", r_pvalue("r", "n")) if with_p else a


def ols_line(df: DataFrame, x: str, y: str, by: Sequence[str] = (), with_p: bool = False) -> DataFrame:
    """H4: least-squares slope, intercept, r, r2, n (and optional slope p)."""
    a = df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                            safe_corr(x, y).alias("r"), F.regr_r2(y, x).alias("r2"),
                            F.regr_count(y, x).alias("n"), F.min(x).alias("x_min"), F.max(x).alias("x_max"))
    return a.withColumn("p_value", r_pvalue("r", "n")) if with_p else a


def prediction_grid(lines: DataFrame, by: Sequence[str] = (), points: int = 100) -> DataFrame:
    """H4: ``points`` evenly spaced x between the group's min and max with the fitted y."""
    g = lines.select(*by, "slope", "intercept", "x_min", "x_max",
                     F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    xv = F.col("x_min") + F.col("i") * (F.col("x_max") - F.col("x_min")) / (points - 1)
    return g.select(*by, "i", xv.alias("x"), (F.col("intercept") + F.col("slope") * xv).alias("y_hat"))


def top_mean_rate(df: DataFrame, entity: str, rate: str, winners: str, top: int = 20) -> DataFrame:
    """H5: mean rate over rows with ``winners`` > 0; top by mean (ties by entity)."""
    a = df.filter(F.col(winners) > 0).groupBy(entity).agg(F.avg(rate).alias("mean_rate"),
                                                          F.count(F.lit(1)).alias("n"))
    return a.orderBy(F.desc("mean_rate"), F.asc(entity)).limit(top)


def group_totals(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """H6: sum by keys (e.g. edition totals by (year, city))."""
    return df.groupBy(*by).agg(F.sum(value).alias("total"))


def top_series(df: DataFrame, entity: str, time: str, value: str, top: int = 5) -> DataFrame:
    """H6: the ``top`` entities by overall sum, then their per-time series."""
    t = df.groupBy(entity).agg(F.sum(value).alias("__s")).orderBy(F.desc("__s"), F.asc(entity)).limit(top)
    return df.join(t.select(entity), entity, "left_semi").groupBy(entity, time).agg(F.sum(value).alias(value))


def spend_panel(a: DataFrame, b: DataFrame, spend: str, medals: str) -> DataFrame:
    """H7: union of two editions; log spend; spend per medal (0 medals -> NULL)."""
    u = a.unionByName(b)
    return u.withColumns({"log_spend": F.log(F.when(F.col(spend) > 0, F.col(spend))),
                          "spend_per_medal": div(spend, F.when(F.col(medals) != 0, F.col(medals)))})


def delta_join(a: DataFrame, b: DataFrame, key: str, spend: str, medals: str, up: str, down: str) -> DataFrame:
    """H8: inner self join of two editions; deltas, % change of spend, direction."""
    x = a.select(key, F.col(spend).alias("spend_a"), F.col(medals).alias("medals_a"))
    y = b.select(key, F.col(spend).alias("spend_b"), F.col(medals).alias("medals_b"))
    j = x.join(y, key, "inner")
    return j.withColumns({"delta_spend": F.col("spend_b") - F.col("spend_a"),
                          "delta_medals": F.col("medals_b") - F.col("medals_a")}) \
        .withColumn("delta_pct", 100 * div("delta_spend", "spend_a")) \
        .withColumn("direction", F.when(F.col("delta_medals") > 0, up).otherwise(down))


def binned_delta(deltas: DataFrame, bins) -> DataFrame:
    """H9: (a, b] bins of the spend % change; mean medal delta per bin."""
    b = deltas.withColumn("group", bands_closed_right("delta_pct", bins))
    return b.filter(F.col("group").isNotNull()).groupBy("group").agg(
        F.avg("delta_medals").alias("mean_delta"), F.count(F.lit(1)).alias("n"))


def home_effect(panel: DataFrame, hosts: DataFrame, entity: str, edition: str, value: str,
                min_others: int = 2, boycotts: Sequence = (), boycott_label: str = "boicottaggio") -> DataFrame:
    """For each host row, value minus the host's mean over its *other*
    editions (needs >= min_others), 1 dp; type by boycott / sign."""
    w = Window.partitionBy(entity)
    p = panel.select(entity, edition, value).withColumns({"__s": F.sum(value).over(w), "__n": F.count(value).over(w)})
    loo = p.withColumn("mean_others", div(F.col("__s") - F.col(value), F.col("__n") - 1)) \
        .withColumn("n_others", F.col("__n") - 1)
    h = loo.join(hosts.select(entity, edition), [entity, edition], "left_semi").filter(F.col("n_others") >= min_others)
    h = h.withColumn("effect", bround(F.col(value) - F.col("mean_others"), 1))
    kind = F.when(F.col(edition).isin(list(boycotts) or [None]), boycott_label) \
        .when(F.col("effect") > 0, "positivo").otherwise("negativo")
    return h.withColumn("type", kind).drop("__s", "__n")


def one_sample_t(effects: DataFrame, value: str, exclude: str | None = None) -> DataFrame:
    """One-sided (greater) one-sample t test of the mean effect vs 0."""
    e = effects.filter(F.col(exclude) != F.lit(True)) if exclude else effects
    a = e.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    a = a.withColumn("t", div(F.col("mean"), F.col("sd") / F.sqrt("n")))
    return a.withColumn("p_value", t_pvalue("t", F.col("n") - 1, alternative="greater"))


def medalist_ranking(rows: DataFrame, athlete: str, country: str, medals: str, order: Sequence[str]) -> DataFrame:
    """Medals per athlete (sum), country of the athlete's first row by
    ``order``; rank by medals desc (ties by athlete)."""
    a = rows.groupBy(athlete).agg(F.sum(medals).alias("medals"),
                                  F.min_by(country, F.struct(*[F.col(c) for c in order])).alias(country))
    return a


def global_rank(df: DataFrame, order: Sequence[F.Column], name: str = "rank") -> DataFrame:
    """Place of each row in a total order, from 1, without a one-task window:
    rows are range-partitioned and stored with their partition, and a row's place
    is the number of rows in the partitions before plus its place inside."""
    order = list(order)
    d = cut_lineage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    count = d.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    count = count.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return d.withColumn(name, inside).join(count, "__part").withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop("__part", "__before")


def ranked_medalists(ranking: DataFrame, athlete: str, country: str, countries: Sequence | None = None) -> DataFrame:
    """``rank`` by medals (ties by athlete) over all athletes, of those of
    ``countries`` if given."""
    ranked = global_rank(ranking, [F.desc("medals"), F.asc(athlete)])
    return ranked if countries is None else ranked.filter(F.col(country).isin(*countries))


def small_countries(ranking: DataFrame, country: str, frac: float = 0.0001) -> DataFrame:
    """Countries whose medal sum s satisfies 0 < s < round(frac x total)."""
    per = ranking.groupBy(country).agg(F.sum("medals").alias("medals"))  # one row per country
    thr = F.round(F.sum("medals").over(Window.partitionBy()) * frac)
    return per.withColumn("__thr", thr).filter((F.col("medals") > 0) & (F.col("medals") < F.col("__thr"))).drop("__thr")
