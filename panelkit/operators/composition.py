"""Category x group composition: label attachment, event units, share
matrices, specialisation, chi-square, per-capita rates, label mobility
(E1-E19).

Shapes: shares are window sums over small aggregated tables (group x
category), never over raw rows - an unpartitioned window only ever sees such
a table, bounded by labels x categories; dense grids use a bounded category list
(top-n sports, label order) exploded per entity rather than a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.semantics import bround, div
from ..functions.stats import chi2_sf


def attach_label(medals: DataFrame, labels: DataFrame, keys: Sequence[str], label: str,
                 medal: str = "medal", no_medal: str = "No medal") -> DataFrame:
    """Drop no-medal rows, left join the label on ``keys``."""
    m = medals.filter(F.col(medal).isNotNull() & (F.col(medal) != no_medal))
    return m.join(labels.select(*keys, label), list(keys), "left")


def label_coverage(labelled: DataFrame, label: str) -> DataFrame:
    """Matched / unmatched row counts and percent matched (one row)."""
    return labelled.agg(F.count_if(F.col(label).isNotNull()).alias("matched"),
                        F.count_if(F.col(label).isNull()).alias("unmatched")) \
        .withColumn("pct_matched", bround(100 * div("matched", F.col("matched") + F.col("unmatched")), 2))


def top_unmatched(labelled: DataFrame, label: str, key: str, n: int = 10) -> DataFrame:
    """Keys with the most unlabelled rows (ties: key ascending)."""
    return (labelled.filter(F.col(label).isNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
            .orderBy(F.desc("rows"), F.asc(key)).limit(n))


def event_units(df: DataFrame, keys: Sequence[str], required: str | None = None) -> DataFrame:
    """One unit per distinct key (a team medal counts once): athletes = rows,
    count = 1; rows without the ``required`` column (the label) go first."""
    if required:
        df = df.filter(F.col(required).isNotNull())
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("athletes")).withColumn("count", F.lit(1))


def top_categories(units: DataFrame, category: str, n: int, weight: str | None = "count") -> DataFrame:
    """Top-n categories by summed weight (or rows), ties by name; (category, n, rank)."""
    agg = units.groupBy(category).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    top = agg.orderBy(F.desc("n"), F.asc(category)).limit(n)  # distributed top-k, then rank n rows
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc(category))))


def category_list(top: DataFrame, category: str, limit: int = 10_000) -> list:
    """Bounded list of categories (a top-n result) for dense grids."""
    rows = top.select(category).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("category list is not bounded")
    return sorted(r[0] for r in rows)


def counts_grid(units: DataFrame, group: str, category: str, groups: Sequence, categories: Sequence,
                weight: str = "count") -> DataFrame:
    """(group, category, n) for every pair of the given lists, zero-filled."""
    agg = units.filter(F.col(category).isin(list(categories)) & F.col(group).isin(list(groups))) \
        .groupBy(group, category).agg(F.sum(weight).alias("n"))
    spark = units.sparkSession
    grid = spark.createDataFrame([(g, c) for g in groups for c in categories],
                                 units.select(group, category).schema)
    return grid.join(agg, [group, category], "left").withColumn("n", F.coalesce(F.col("n"), F.lit(0)).cast("long"))


def share_matrix(grid: DataFrame, group: str, category: str, n: str = "n", scale: int = 2) -> DataFrame:
    """Percent of the group (row) and percent of the category (column)."""
    wg, wc = Window.partitionBy(group), Window.partitionBy(category)
    return grid.withColumns({
        "pct_of_group": bround(100 * div(F.col(n), F.sum(n).over(wg)), scale),
        "pct_of_category": bround(100 * div(F.col(n), F.sum(n).over(wc)), scale),
    })


def top_k_per_group(units: DataFrame, group: str, category: str, k: int = 10,
                    weight: str = "count") -> DataFrame:
    """E5: top-k categories per group; share is of the top-k subtotal."""
    agg = units.groupBy(group, category).agg(F.sum(weight).alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), F.asc(category))
    top = agg.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top.withColumn("share_of_top", bround(100 * div("n", F.sum("n").over(Window.partitionBy(group))), 2))


def specialization(grid: DataFrame, group: str, category: str, n: str = "n", top: int = 5, bottom: int = 3) -> DataFrame:
    """(% of category within group) / (% of category overall) over a
    zero-filled grid; top and bottom per group (ties by category)."""
    g_tot = F.sum(n).over(Window.partitionBy(group))
    c_tot = F.sum(n).over(Window.partitionBy(category))
    all_tot = F.lit(grid.agg(F.sum(n)).first()[0])  # one number
    s = grid.withColumn("index", div(div(n, g_tot), div(c_tot, all_tot)))
    hi = Window.partitionBy(group).orderBy(F.desc("index"), F.asc(category))
    lo = Window.partitionBy(group).orderBy(F.asc("index"), F.asc(category))
    s = s.withColumn("rank_high", F.row_number().over(hi)).withColumn("rank_low", F.row_number().over(lo))
    return s.filter((F.col("rank_high") <= top) | (F.col("rank_low") <= bottom)) \
        .withColumn("side", F.when(F.col("rank_high") <= top, "top").otherwise("bottom"))


def chi_square(grid: DataFrame, group: str, category: str, n: str = "n") -> DataFrame:
    """Pearson chi-square of a zero-filled contingency table (no Yates);
    one row (chi2, dof, p_value).  Expected = row total x column total / N."""
    rt = F.sum(n).over(Window.partitionBy(group))
    ct = F.sum(n).over(Window.partitionBy(category))
    tot = F.sum(n).over(Window.partitionBy())
    e = grid.withColumn("__e", rt * ct / tot)
    stats = e.agg(F.sum(F.when(F.col("__e") > 0, (F.col(n) - F.col("__e")) ** 2 / F.col("__e"))).alias("chi2"),
                  ((F.count_distinct(group) - 1) * (F.count_distinct(category) - 1)).alias("dof"))
    return stats.withColumn("p_value", chi2_sf("chi2", "dof"))


def share_over_time(units: DataFrame, time: str, group: str, groups: Sequence, from_time: int,
                    weight: str = "count") -> DataFrame:
    """Percent per time by group from ``from_time``, zero-filled over the groups."""
    u = units.filter(F.col(time) >= from_time)
    agg = u.groupBy(time, group).agg(F.sum(weight).alias("n"))
    times = u.select(time).distinct()
    arr = F.array(*[F.lit(g) for g in groups])
    grid = times.select(time, F.explode(arr).alias(group))
    j = grid.join(agg, [time, group], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return j.withColumn("pct", bround(100 * div("n", F.sum("n").over(Window.partitionBy(time))), 2))


def accessibility(shares: DataFrame, group: str, category: str, pct: str, accessible_groups: Sequence,
                  accessible_min: float, exclusive_max: float) -> DataFrame:
    """Per category, the summed share of the given (non-rich) groups and a class."""
    s = shares.filter(F.col(group).isin(list(accessible_groups))).groupBy(category) \
        .agg(F.sum(pct).alias("accessible_share"))
    cls = F.when(F.col("accessible_share") >= accessible_min, "accessible") \
        .when(F.col("accessible_share") < exclusive_max, "exclusive").otherwise("intermediate")
    return s.withColumn("class", cls)


def category_order(shares: DataFrame, group: str, category: str, pct: str, rich: str) -> DataFrame:
    """Categories ordered by the rich group's share ascending (rank 1 = lowest)."""
    r = shares.filter(F.col(group) == rich).select(category, F.col(pct).alias("rich_share"))
    return r.withColumn("order", F.row_number().over(Window.orderBy("rich_share", category)))


def roster_rates(roster: DataFrame, medal_counts: DataFrame, keys: Sequence[str], pop: str,
                 medals: str = "medals") -> DataFrame:
    """One row per roster key; medals absent -> 0; rate = medals / (pop / 1e6)."""
    j = roster.join(medal_counts.select(*keys, medals), list(keys), "left")
    j = j.withColumn(medals, F.coalesce(F.col(medals), F.lit(0)).cast("long"))
    return j.withColumn("rate", div(medals, F.col(pop) / 1e6))


def pooled_vs_averaged(rates: DataFrame, group: str, pop: str, medals: str = "medals",
                       rate: str = "rate") -> DataFrame:
    """Pooled rate sum(medals)/(sum(pop)/1e6) vs unweighted mean of rates; ratio 2 dp."""
    a = rates.groupBy(group).agg(div(F.sum(medals), F.sum(pop) / 1e6).alias("pooled"),
                                 F.avg(rate).alias("averaged"))
    return a.withColumn("ratio", bround(div("averaged", "pooled"), 2))


def mean_rate_by(rates: DataFrame, by: Sequence[str], rate: str = "rate") -> DataFrame:
    """Unweighted mean rate by group (and optionally year)."""
    return rates.groupBy(*by).agg(F.avg(rate).alias("mean_rate"), F.count(F.lit(1)).alias("n"))


def dense_category_rates(roster: DataFrame, units: DataFrame, keys: Sequence[str], category: str,
                         categories: Sequence, pop: str, group: str, weight: str = "count") -> DataFrame:
    """Roster x categories zero-filled; mean rate per (group, category)."""
    arr = F.array(*[F.lit(c) for c in categories])
    grid = roster.select(*keys, pop, group, F.explode(arr).alias(category))
    cnt = units.filter(F.col(category).isin(list(categories))).groupBy(*keys, category) \
        .agg(F.sum(weight).alias("medals"))
    j = grid.join(cnt, [*keys, category], "left").withColumn("medals", F.coalesce("medals", F.lit(0)))
    j = j.withColumn("rate", div("medals", F.col(pop) / 1e6))
    return j.groupBy(group, category).agg(F.avg("rate").alias("mean_rate"))


def label_rank(label: str, order: Sequence[str]) -> F.Column:
    """Position of the label in ``order`` (0-based), NULL when absent."""
    m = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))])
    return m[F.col(label)]


def mobility(labels: DataFrame, entity: str, time: str, label: str, order: Sequence[str],
             min_years: int = 4) -> DataFrame:
    """First / last label by time, their ranks, jump = last - first,
    distinct times; ``mover`` = jump != 0 and n_years >= min_years."""
    lab = labels.filter(F.col(label).isNotNull())
    a = lab.groupBy(entity).agg(F.min_by(label, time).alias("first_label"),
                                F.max_by(label, time).alias("last_label"),
                                F.count_distinct(time).alias("n_years"))
    a = a.withColumn("first_rank", label_rank("first_label", order)) \
        .withColumn("last_rank", label_rank("last_label", order))
    a = a.withColumn("jump", F.col("last_rank") - F.col("first_rank"))
    return a.withColumn("mover", (F.col("jump") != 0) & (F.col("n_years") >= min_years))


def transition_points(labels: DataFrame, entity: str, time: str, label: str) -> DataFrame:
    """Rows whose label differs from the entity's previous row."""
    w = Window.partitionBy(entity).orderBy(time)
    prev = F.lag(label).over(w)
    return labels.withColumn("prev_label", prev).filter(F.col("prev_label").isNotNull() &
                                                        (F.col("prev_label") != F.col(label)))


def before_after(rates: DataFrame, movers: DataFrame, entity: str, time: str, label: str,
                 rate: str = "rate") -> DataFrame:
    """For movers, the first time the label differs from the initial one;
    mean rate before vs from then; % change only when before > 0."""
    w = Window.partitionBy(entity).orderBy(time)
    r = rates.join(movers.select(entity), entity, "left_semi") \
        .withColumn("__init", F.first(label).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    change = r.filter(F.col(label) != F.col("__init")).groupBy(entity).agg(F.min(time).alias("change_time"))
    j = r.join(change, entity)
    a = j.groupBy(entity, "change_time").agg(
        F.avg(F.when(F.col(time) < F.col("change_time"), F.col(rate))).alias("rate_before"),
        F.avg(F.when(F.col(time) >= F.col("change_time"), F.col(rate))).alias("rate_after"))
    return a.withColumn("pct_change", F.when(F.col("rate_before") > 0,
                                             100 * (F.col("rate_after") - F.col("rate_before")) / F.col("rate_before")))


def edition_timeline(labels: DataFrame, edition_times: DataFrame, medal_counts: DataFrame,
                     entity: str, time: str) -> DataFrame:
    """Label rows only in real edition times, dense time index from 0,
    medals zero-filled."""
    t = labels.join(edition_times.select(time).distinct(), time, "left_semi")
    # the rank is over the distinct times alone, not over the rows
    index = t.select(time).distinct().withColumn("time_index", F.dense_rank().over(Window.orderBy(time)) - 1)
    j = t.join(index, time).join(medal_counts, [entity, time], "left")
    return j.withColumn("medals", F.coalesce(F.col("medals"), F.lit(0)).cast("long"))


def latest_rows(df: DataFrame, key: str, time: str) -> DataFrame:
    """The newest row per key (max time; ties by all columns)."""
    others = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(time, *[c for c in others if c != time]))
                               .alias("__r"))
    return best.select(key, "__r.*").select(*df.columns)
