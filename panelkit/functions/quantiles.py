"""Exact quantiles (linear interpolation, as pandas / numpy / DuckDB
``quantile_cont``) without gathering a group into one task.

``F.percentile`` / ``F.median`` are exact but keep every value of a group in
one aggregation buffer - a global ``describe`` would pull a whole column into
one task.  Here the rows first become (group, value, count), which map-side
combining shrinks and which leaves no hot value.  The counts are
range-partitioned by (group, value); a value's ranks are the counts of the
partitions before its own, of the values before it in its partition, and its
own count.  Nothing but the result table is left at the end, and nothing goes
through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., q, value): the q-quantile of ``value`` per group (NULLs
    ignored; a group without values is absent)."""
    by = list(by)
    counts = df.select(*by, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull()) \
        .groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n"))
    counts = cut_lineage(counts.repartitionByRange(*[F.col(c) for c in by], F.col("__v"))
                         .withColumn("__pid", F.spark_partition_id()))  # the pieces must stay as they are
    pieces = counts.groupBy(*by, "__pid").agg(F.sum("__n").alias("__in"))  # partitions, and groups beyond one each
    upto = Window.partitionBy(*by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*[F.col(c).alias(f"__b_{c}") for c in by], F.col("__pid").alias("__b_pid"),
                           F.coalesce(F.sum("__in").over(upto), F.lit(0)).alias("__first"),
                           F.sum("__in").over(Window.partitionBy(*by)).alias("__total"))
    cond = F.col("__pid") == F.col("__b_pid")
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__b_{c}"))
    inside = Window.partitionBy(*by, "__pid").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.join(pieces, cond).withColumn("__from", F.col("__first") + F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    aggs = []
    for i, q in enumerate(qs):
        at = F.lit(float(q)) * (F.col("__total") - 1)
        for side, k in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("__from") <= k) & (k < F.col("__from") + F.col("__n"))
            aggs.append(F.max(F.when(here, F.col("__v"))).alias(f"__{side}{i}"))
    found = ranked.groupBy(*by).agg(F.max("__total").alias("__total"), *aggs)
    if not by:
        found = found.filter(F.col("__total").isNotNull())
    each = []
    for i, q in enumerate(qs):
        at = F.lit(float(q)) * (F.col("__total") - 1)
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        each.append(F.struct(F.lit(float(q)).alias("q"), (lo + (hi - lo) * (at - F.floor(at))).alias("value")))
    return found.select(*by, F.explode(F.array(*each)).alias("__r")).select(*by, "__r.q", "__r.value")


def exact_quantiles_wide(df: DataFrame, cols: Sequence[str], qs: Sequence[float], by: Sequence[str] = ()) -> dict:
    """Quantiles of several columns in one distributed sort: the columns are
    unpivoted to (column, value) and the column name becomes part of the
    group.  Returns {(group..., column): {q: value}} (small: groups x columns x qs)."""
    by = list(by)
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]) \
        .unpivot(by, list(cols), "__col", "__val") if by else \
        df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "__col", "__val")
    out: dict = {}
    for r in exact_quantiles(long, "__val", qs, [*by, "__col"]).collect():
        out.setdefault(tuple(r[b] for b in by) + (r["__col"],), {})[r["q"]] = r["value"]
    return out


def exact_medians(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Median of each column per group, one row per group: (by..., cols...)."""
    by = list(by)
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(by, list(cols), "__col", "__val")
    found = exact_quantiles(long, "__val", [0.5], [*by, "__col"])
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("__col") == c, F.col("value"))).alias(c) for c in cols])
