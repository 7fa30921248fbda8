"""Derived measures, lags, interpolation, host flags, correlation pruning and
per-entity PCA (C1-C10).

Window functions here are partitioned by entity; a panel has at most one row
per entity and edition, so no window partition can grow with the data.
Correlation matrices are computed as one aggregation with one expression per
column pair (columns are a fixed, small set) - rows are never paired up.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..functions.semantics import bround, div, safe_corr, spread


def per_capita(df: DataFrame, *, total: str, gold: str, pop: str, gdp: str, scale: int = 4) -> DataFrame:
    """Medals per million people, gold per million, medals per GDP billion
    (half-even, ``scale`` dp) and ``won_medal`` = total > 0."""
    return df.withColumns({
        "medals_per_million": bround(div(total, F.col(pop) / 1e6), scale),
        "gold_per_million": bround(div(gold, F.col(pop) / 1e6), scale),
        "medals_per_gdp_bn": bround(div(total, F.col(gdp) / 1e9), scale),
        "won_medal": (F.col(total) > 0).cast("int"),
    })


def log_features(df: DataFrame, cols: Mapping[str, str], *, gold: str | None = None,
                 total: str | None = None) -> DataFrame:
    """``log1p`` of the given columns (out name -> source) and gold share
    (only where total > 0)."""
    m = {out: F.log1p(F.col(src).cast("double")) for out, src in cols.items()}
    if gold and total:
        m["gold_share"] = F.when(F.col(total) > 0, div(gold, total))
    return df.withColumns(m)


def decade_label(year: str, cap: int | None = None) -> F.Column:
    """1996 -> '1990s'; with ``cap`` the last decade absorbs later years
    (cap=2010 gives 2020 -> '2010s', as the analysed notebooks do)."""
    d = (F.floor(F.col(year) / 10) * 10).cast("int")
    if cap is not None:
        d = F.least(d, F.lit(cap))
    return F.concat(d.cast("string"), F.lit("s"))


def period_label(year: str, early_max: int, early: str, late: str) -> F.Column:
    """Two-way split, <= early_max -> early, any later year -> late."""
    return F.when(F.col(year) <= early_max, early).when(F.col(year).isNotNull(), late)


def lag_features(df: DataFrame, entity: str, order: Sequence[str], col: str,
                 lags: Sequence[int] = (1, 2), prefix: str = "prev") -> DataFrame:
    """C4: row-based lags per entity (previous row, not previous year)."""
    w = Window.partitionBy(entity).orderBy(*order)
    return df.withColumns({(f"{prefix}_{col}" if k == 1 else f"{prefix}_{col}_{k}"): F.lag(col, k).over(w)
                           for k in lags})


def interpolate_inside(df: DataFrame, entity: str, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Linear interpolation by row position inside gaps only (leading and
    trailing NULLs stay NULL), per entity."""
    w = Window.partitionBy(entity).orderBy(*order)
    prev = w.rowsBetween(Window.unboundedPreceding, 0)
    nxt = w.rowsBetween(0, Window.unboundedFollowing)
    out = df.withColumn("__pos", F.row_number().over(w))
    m = {}
    for c in cols:
        x = F.col(c).cast("double")
        mark = F.when(x.isNotNull(), F.struct(x.alias("v"), F.col("__pos").alias("p")))
        lo = F.last(mark, ignorenulls=True).over(prev)
        hi = F.first(mark, ignorenulls=True).over(nxt)
        frac = (F.col("__pos") - lo["p"]) / (hi["p"] - lo["p"])
        m[c] = F.when(x.isNotNull(), x).when(lo.isNotNull() & hi.isNotNull(),
                                            lo["v"] + (hi["v"] - lo["v"]) * frac)
    return out.withColumns(m).drop("__pos")


def null_counts(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """(stage, column, n_null) - used for before / after imputation counts."""
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return agg.unpivot([], list(cols), "column", "n_null").withColumn("stage", F.lit(label))


def host_flag_literal(df: DataFrame, year: str, name: str, hosts: DataFrame,
                      host_year: str = "year", host_name: str = "host") -> DataFrame:
    """C6 (a): 1 when the row's name equals the host of its year (literal table)."""
    h = hosts.select(F.col(host_year).alias("__hy"), F.col(host_name).alias("__hn"))
    j = df.join(h, F.col(year) == F.col("__hy"), "left")
    return j.withColumn("is_host", F.coalesce((F.col(name) == F.col("__hn")).cast("int"), F.lit(0))) \
        .drop("__hy", "__hn")


def host_flag_mode(df: DataFrame, year: str, code: str, host_code: str) -> DataFrame:
    """C6 (b): host code per year = most frequent host code among the year's
    rows (smallest on ties); flag rows whose trimmed upper-case code equals it."""
    modes = df.groupBy(year).agg(F.mode(F.upper(F.trim(F.col(host_code))), deterministic=True).alias("__h"))
    j = df.join(modes, year, "left")
    return j.withColumn("is_host", F.coalesce((F.upper(F.trim(F.col(code).cast("string"))) == F.col("__h"))
                                              .cast("int"), F.lit(0))).drop("__h")


def pair_correlations(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Pearson r for every column pair (i < j) per group, pairwise-complete,
    NULL for constant columns.  One aggregation; output (by..., i, j, r, n)."""
    aggs = []
    names = []
    for a, b in combinations(cols, 2):
        k = f"{a}\u0001{b}"
        names.append(k)
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs.append(F.struct(safe_corr(a, b).alias("r"), F.count_if(both).alias("n")).alias(k))
    agg = df.groupBy(*by).agg(*aggs)
    long = agg.unpivot(list(by), names, "__pair", "__v")
    parts = F.split("__pair", "\u0001")
    return long.select(*by, parts[0].alias("i"), parts[1].alias("j"), F.col("__v.r").alias("r"),
                       F.col("__v.n").alias("n"))


def entity_corr_matrix(df: DataFrame, entity: str, cols: Sequence[str]) -> DataFrame:
    """Full symmetric Pearson matrix per entity, long (entity, i, j, r);
    the diagonal is 1 for a non-constant column, NULL otherwise."""
    off = pair_correlations(df, [entity], cols).select(entity, "i", "j", "r")
    mirror = off.select(entity, F.col("j").alias("i"), F.col("i").alias("j"), "r")
    diag = df.groupBy(entity).agg(*[F.when(spread(F.col(c).cast("double")) > 0, F.lit(1.0)).alias(c) for c in cols]) \
        .unpivot([entity], list(cols), "i", "r").withColumn("j", F.col("i")).select(entity, "i", "j", "r")
    return off.unionByName(mirror).unionByName(diag)


def prune_correlated(df: DataFrame, entity: str, cols: Sequence[str], threshold: float = 0.75,
                     warn: float = 0.70, keep: Sequence[str] = ()) -> DataFrame:
    """Per entity, mean |r| of each indicator with all indicators (self
    included, NULL r skipped); averaged over entities; flags and drop decision.
    Output (indicator, mean_abs_r, above_warn, above_threshold, drop)."""
    m = entity_corr_matrix(df, entity, cols)
    per = m.groupBy(entity, "i").agg(F.avg(F.abs("r")).alias("a"))
    overall = per.groupBy(F.col("i").alias("indicator")).agg(F.avg("a").alias("mean_abs_r"))
    return overall.withColumns({
        "above_warn": F.col("mean_abs_r") > warn,
        "above_threshold": F.col("mean_abs_r") > threshold,
        "drop": (F.col("mean_abs_r") > threshold) & ~F.col("indicator").isin(list(keep) or [""]),
    })


def fill_series_mean(df: DataFrame, entity: str, cols: Sequence[str]) -> DataFrame:
    """NULL -> the entity's mean of that column."""
    w = Window.partitionBy(entity)
    return df.withColumns({c: F.coalesce(F.col(c), F.avg(c).over(w)) for c in cols})


def entity_pca1(df: DataFrame, entity: str, time: str, cols: Sequence[str]) -> DataFrame:
    """First principal component per entity of its (time x indicator)
    matrix, NULL -> 0 before centring.  The covariance matrix (p x p) is
    aggregated by Spark per entity; only those p x p numbers go through numpy
    (eigendecomposition), then scores are computed back in Spark.  Sign: the
    largest-magnitude loading is positive.  Output (entity, time, pc1, pc1_scaled)
    where pc1_scaled is min-max scaled per entity (0 for a constant score)."""
    cols = list(cols)
    p = len(cols)
    z = df.select(entity, time, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    aggs = [F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]
    for i in range(p):
        for j in range(i, p):
            aggs.append(F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}"))
    cov = z.groupBy(entity).agg(*aggs)
    key_type = dict(df.dtypes)[entity]
    out_schema = f"{entity} {key_type}, " + ", ".join(f"l{i} double" for i in range(p))

    def eig(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.itertuples(index=False):
                r = rec._asdict()
                c = np.zeros((p, p))
                for i in range(p):
                    for j in range(i, p):
                        v = r[f"c{i}_{j}"]
                        c[i, j] = c[j, i] = 0.0 if v is None or np.isnan(v) else v
                vals, vecs = np.linalg.eigh(c)
                v = vecs[:, int(np.argmax(vals))]
                if v[int(np.argmax(np.abs(v)))] < 0:
                    v = -v
                rows.append([r[entity], *v.tolist()])
            yield pd.DataFrame(rows, columns=[entity] + [f"l{i}" for i in range(p)])

    loads = cov.select(entity, *[f"c{i}_{j}" for i in range(p) for j in range(i, p)]).mapInPandas(eig, out_schema)
    means = cov.select(entity, *[f"m{i}" for i in range(p)])
    j = z.join(means, entity).join(loads, entity)
    score = sum(((F.col(c) - F.col(f"m{i}")) * F.col(f"l{i}") for i, c in enumerate(cols)), F.lit(0.0))
    s = j.select(entity, time, score.alias("pc1"))
    w = Window.partitionBy(entity)
    lo, hi = F.min("pc1").over(w), F.max("pc1").over(w)
    return s.withColumn("pc1_scaled", F.when(hi > lo, (F.col("pc1") - lo) / (hi - lo)).otherwise(F.lit(0.0)))
