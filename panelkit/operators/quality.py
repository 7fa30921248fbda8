"""Data quality and key harmonisation.

Skew notes: "first row per key" uses ``min_by`` over a struct, which Spark
aggregates partially on the map side, so a key holding a third of all rows
costs one row per partition before the shuffle - never a giant sort of one
window partition.  Lookup tables (code maps) are joined plainly: they are
small, so AQE turns the join into a broadcast after measuring them at run time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.quantiles import exact_quantiles_wide
from ..functions.semantics import clean_text, is_blank, require_columns


def describe_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sd (ddof 1), min, 25/50/75 % (linear interpolation), max
    per column: one aggregation pass for the moments, distributed exact
    quantiles (no column gathered into one task).  Output (column, count,
    mean, std, min, p25, p50, p75, max)."""
    spark = df.sparkSession
    mom = df.agg(*[F.struct(F.count(F.col(c).cast("double")).alias("count"), F.avg(F.col(c).cast("double")).alias("mean"),
                            F.stddev_samp(F.col(c).cast("double")).alias("std"), F.min(F.col(c).cast("double")).alias("min"),
                            F.max(F.col(c).cast("double")).alias("max")).alias(c) for c in cols]).first()
    qs = exact_quantiles_wide(df, cols, [0.25, 0.5, 0.75])
    rows = []
    for c in cols:
        qv = qs.get((c,), {})
        m = mom[c]
        rows.append((c, m["count"], m["mean"], m["std"], m["min"], qv.get(0.25), qv.get(0.5), qv.get(0.75), m["max"]))
    return spark.createDataFrame(rows, "column string, count long, mean double, std double, min double, "
                                       "p25 double, p50 double, p75 double, max double")


def rule_violations(df: DataFrame, parts: Sequence[str], total: str) -> DataFrame:
    """Count of negative values per part column and of rows where
    ``total`` differs from the sum of the parts.  Output (rule, n_rows)."""
    aggs = [F.count_if(F.col(c) < 0).alias(f"negative_{c}") for c in (*parts, total)]
    s = sum((F.col(c) for c in parts[1:]), F.col(parts[0]))
    aggs.append(F.count_if(~F.col(total).eqNullSafe(s)).alias("total_mismatch"))
    names = [f"negative_{c}" for c in (*parts, total)] + ["total_mismatch"]
    return df.agg(*aggs).unpivot([], names, "rule", "n_rows")


def null_out_of_range(df: DataFrame, ranges: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Values outside [lo, hi] (either bound optional) become NULL."""
    m = {}
    for c, (lo, hi) in ranges.items():
        x = F.col(c)
        bad = F.lit(False)
        if lo is not None:
            bad = bad | (x < F.lit(lo))
        if hi is not None:
            bad = bad | (x > F.lit(hi))
        m[c] = F.when(bad, F.lit(None).cast(dict(df.dtypes)[c])).otherwise(x)
    return df.withColumns(m)


def exact_dedup(df: DataFrame) -> DataFrame:
    """Remove exact duplicate rows."""
    return df.distinct()


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Every member of a group of identical rows (pandas keep=False).

    Group sizes come from a partially aggregated count; members are found by
    a null-safe join back, which AQE splits when one group is huge."""
    cols = list(cols or df.columns)
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    g = groups.select(*[F.col(c).alias(f"__g_{c}") for c in cols])
    cond = None
    for c in cols:
        e = df[c].eqNullSafe(g[f"__g_{c}"])
        cond = e if cond is None else cond & e
    return df.join(g, cond, "left_semi")


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A10: keep the first row per key by ``order`` (ties broken by all other
    columns, so the result is deterministic)."""
    others = [c for c in df.columns if c not in keys]
    ordk = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in others if c not in order])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in others]), ordk).alias("__r"))
    return best.select(*keys, "__r.*").select(*df.columns)


def mapping_frame(spark: SparkSession, mapping: Mapping[str, str], key: str = "key",
                  value: str = "value") -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in mapping.items()], f"{key} string, {value} string")


def recode(df: DataFrame, column: str, mapping: DataFrame, *, strict: bool,
           key: str = "key", value: str = "value", out: str | None = None) -> DataFrame:
    """``strict=False`` is ``replace`` (unmapped values kept), ``strict=True``
    is ``map`` (unmapped -> NULL).  ``mapping`` must be unique on ``key``."""
    out = out or column
    m = mapping.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    j = df.join(m, df[column] == m["__k"], "left")
    newv = F.col("__v") if strict else F.coalesce(F.col("__v"), F.col(column))
    return j.withColumn(out, newv).drop("__k", "__v")


def code_bridge(df: DataFrame, code: str, alias_map: DataFrame, known: DataFrame, *,
                alias_key: str = "ioc", alias_value: str = "iso3", known_code: str = "iso3",
                known_id: str = "num_id", out_code: str = "iso3", out_id: str = "id3") -> DataFrame:
    """Alias code -> canonical code, else the code itself when it is
    already a known canonical code; then the canonical -> zero-padded 3-digit
    numeric id.  Rows that map to nothing are dropped."""
    a = alias_map.select(F.col(alias_key).alias("__a"), F.col(alias_value).alias("__canon"))
    k = known.select(F.col(known_code).alias("__kc"), F.col(known_id).alias("__kid"))
    j = df.join(a, F.upper(F.trim(df[code])) == F.col("__a"), "left")
    canon = F.coalesce(F.col("__canon"), F.upper(F.trim(F.col(code))))
    j = j.withColumn(out_code, canon).join(k, F.col(out_code) == F.col("__kc"), "inner")
    return j.withColumn(out_id, F.lpad(F.col("__kid").cast("string"), 3, "0")) \
        .drop("__a", "__canon", "__kc", "__kid")


def names_per_key(df: DataFrame, key: str, name: str) -> DataFrame:
    """Keys with more than one distinct name, with the sorted name list."""
    return (df.groupBy(key).agg(F.count_distinct(name).alias("n_names"),
                                F.array_sort(F.collect_set(name)).alias("names"))
            .filter("n_names > 1"))


def set_compare(a: DataFrame, b: DataFrame, col_a: str, col_b: str) -> DataFrame:
    """Value -> 'only_a' / 'only_b' / 'both' (distinct values, NULLs ignored)."""
    da = a.select(F.col(col_a).alias("value")).filter("value IS NOT NULL").distinct().withColumn("__a", F.lit(True))
    db = b.select(F.col(col_b).alias("value")).filter("value IS NOT NULL").distinct().withColumn("__b", F.lit(True))
    j = da.join(db, "value", "full")
    side = F.when(F.col("__a") & F.col("__b"), "both").when(F.col("__a"), "only_a").otherwise("only_b")
    return j.select("value", side.alias("side"))


def side_by_side_codes(a: DataFrame, b: DataFrame, name: str, code_a: str, code_b: str) -> DataFrame:
    """Per name, the sorted code sets of both tables (full outer on name)."""
    sa = a.groupBy(name).agg(F.array_sort(F.collect_set(code_a)).alias("codes_a"))
    sb = b.groupBy(name).agg(F.array_sort(F.collect_set(code_b)).alias("codes_b"))
    return sa.join(sb, name, "full")


def canonical_code(df: DataFrame, name: str, code: str, order: Sequence[str],
                   overrides: DataFrame | None = None) -> DataFrame:
    """Every row of a name takes the first code of that name (by ``order``);
    an override table (name, code) wins over the first code."""
    first = df.groupBy(name).agg(F.min_by(F.col(code), F.struct(*[F.col(c) for c in order])).alias("__first"))
    j = df.join(first, name, "left")
    if overrides is not None:
        o = overrides.select(F.col(name).alias("__on"), F.col(code).alias("__ov"))
        j = j.join(o, F.col(name) == F.col("__on"), "left")
        j = j.withColumn(code, F.coalesce("__ov", "__first", code)).drop("__on", "__ov")
    else:
        j = j.withColumn(code, F.coalesce("__first", code))
    return j.drop("__first")


def fill_from_lookup(df: DataFrame, key: str, target: str, ref: DataFrame, ref_key: str,
                     ref_value: str, ref_order: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fill ``target`` where it is missing (NULL, blank, 'NAN', 'NULL')
    from a reference table keyed by trimmed upper-case code.  The reference
    drops blank keys / values and keeps its first row per key.

    Returns (filled frame, one-row count of updated rows, sorted distinct
    non-blank keys of missing rows that found no reference row)."""
    r = ref.select(F.upper(F.trim(F.col(ref_key))).alias("__rk"), clean_text(ref_value).alias("__rv"),
                   *[F.col(c) for c in ref_order])
    r = r.filter(F.col("__rk").isNotNull() & (F.col("__rk") != "") & F.col("__rv").isNotNull())
    r = r.groupBy("__rk").agg(F.min_by("__rv", F.struct(*[F.col(c) for c in ref_order])).alias("__rv"))
    nk = F.upper(F.trim(F.col(key)))
    j = df.withColumn("__nk", nk).join(r, F.col("__nk") == F.col("__rk"), "left")
    missing = is_blank(target)
    upd = missing & F.col("__rv").isNotNull()
    filled = j.withColumn("__upd", upd).withColumn(target, F.when(upd, F.col("__rv")).otherwise(F.col(target)))
    n_updated = filled.agg(F.count_if("__upd").alias("n_updated"))
    unmatched = (filled.filter(missing & F.col("__rv").isNull() & F.col("__nk").isNotNull() & (F.col("__nk") != ""))
                 .select(F.col("__nk").alias("code")).distinct())
    return filled.drop("__nk", "__rk", "__rv", "__upd"), n_updated, unmatched


def edition_filter(df: DataFrame, edition: str, *, contains: str, y0: int, y1: int,
                   year_out: str = "year") -> DataFrame:
    """year = first 4 digits of the edition text; keep editions containing
    ``contains`` (case-insensitive) with y0 <= year <= y1."""
    y = F.regexp_extract(F.col(edition), r"^(\d{4})", 1).try_cast("int")
    return (df.withColumn(year_out, y)
            .filter(F.lower(F.col(edition)).contains(contains.lower()) & F.col(year_out).between(y0, y1)))


def require(df: DataFrame, cols: Sequence[str], where: str) -> DataFrame:
    require_columns(df, cols, where)
    return df


def change_flags(df: DataFrame, entity: str, order: Sequence[str], col: str, out: str = "changed") -> DataFrame:
    """``x != x.shift(1)`` per entity, NULL-safe; the first row counts as a change."""
    w = Window.partitionBy(entity).orderBy(*order)
    return df.withColumn(out, ~F.lag(col).over(w).eqNullSafe(F.col(col)))
