"""Entity clustering: latest profiles, income bands, nearest-centroid
assignment, K-means with exact scaling, label ranking / agreement /
propagation / aliasing, static vs dynamic labels, outcome profiles (D1-D15).

What reaches the driver: per-variable medians / means / sds, band centroids
(bands x variables) and K-means centres (k x variables) - all bounded by the
number of variables, never by rows.  Scaling uses population sd (ddof 0) and
exact medians, as the analysed scikit-learn code does; Spark ML's own
StandardScaler (ddof 1) and Imputer (lower median) are deliberately not used.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window, functions as F

from .. import dims
from ..functions.semantics import bands_closed_left, div, last_non_null, row_non_null_count
from ..functions.quantiles import exact_medians
from ..session import cut_lineage, run_concurrently


def income_band(gdp_pc: str, bands=None, fallback: str | None = None) -> F.Column:
    """[low, high) bands on GDP per capita; a non-null value outside every
    band (e.g. negative) takes the last label; NULL stays NULL."""
    return bands_closed_left(gdp_pc, bands or dims.INCOME_BANDS, fallback or dims.INCOME_BAND_FALLBACK)


def latest_profile(df: DataFrame, entity: str, time: str, cols: Sequence[str], min_non_null: int = 3,
                   keep: Sequence[str] = ()) -> DataFrame:
    """Rows with at least ``min_non_null`` of ``cols``; per entity the
    last non-null value of *each* column by time."""
    d = df.filter(row_non_null_count(cols) >= min_non_null)
    return d.groupBy(entity).agg(*[last_non_null(c, time).alias(c) for c in (*cols, *keep)])


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> dict:
    """Exact median (imputation), then mean and population sd of the imputed
    columns.  Two small aggregation jobs; returns plain numbers."""
    med = exact_medians(df, cols).first().asDict()
    imp = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(med[c])).alias(c) for c in cols])
    mom = imp.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return {"median": med, "mean": {c: mom[f"m_{c}"] for c in cols},
            "sd": {c: mom[f"s_{c}"] for c in cols}, "cols": list(cols)}


def scaled_columns(params: dict, prefix: str = "z_") -> dict:
    """Impute with the fitted median, z-score with the fitted mean / sd (sd 0 -> 0)."""
    out = {}
    for c in params["cols"]:
        x = F.coalesce(F.col(c).cast("double"), F.lit(params["median"][c]))
        sd = params["sd"][c] or 0.0
        out[prefix + c] = (x - F.lit(params["mean"][c])) / F.lit(sd) if sd > 0 else F.lit(0.0)
    return out


def assign_missing_band(df: DataFrame, band: str, proxies: Sequence[str], out: str = "band_filled") -> DataFrame:
    """D3: rows without a band get the band whose centroid (per-band medians of
    the proxies over banded rows) is nearest in the space imputed and scaled
    on the banded rows.  Ties go to the first band in sorted order."""
    known = df.filter(F.col(band).isNotNull())
    params = fit_scaler(known, proxies)
    cents = exact_medians(known, proxies, [band]).collect()  # bands x proxies
    cents = sorted(cents, key=lambda r: r[band])
    z = scaled_columns(params)
    dists = []
    for r in cents:
        sq = None
        for c in proxies:
            v = r[c] if r[c] is not None else params["median"][c]
            sd = params["sd"][c] or 0.0
            cz = (v - params["mean"][c]) / sd if sd > 0 else 0.0
            term = (z["z_" + c] - F.lit(cz)) ** 2
            sq = term if sq is None else sq + term
        dists.append(F.struct(F.sqrt(sq).alias("d"), F.lit(r[band]).alias("b")))
    nearest = F.array_min(F.array(*dists))["b"] if dists else F.lit(None).cast("string")
    return df.withColumn(out, F.coalesce(F.col(band), nearest)) \
        .withColumn("assigned_by", F.when(F.col(band).isNotNull(), "band").otherwise("nearest"))


def feature_table(df: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    """The features, and their vector, checkpointed (shared checkpoint folder),
    so K-means restarts read a materialised entity table instead of replaying
    the joins behind it - and survive executor loss."""
    va = VectorAssembler(inputCols=list(feature_cols), outputCol="features")
    return cut_lineage(va.transform(df.select(*feature_cols)))


@dataclass
class Centres:
    """A fitted K-means: its centres, and the cost of the last round's assignment."""
    centres: np.ndarray
    cost: float

    def nearest(self, feature_cols: Sequence[str]) -> F.Column:
        """Index of the nearest centre (ties: the first)."""
        far = lambda c: sum(((F.col(f) - F.lit(float(v))) ** 2 for f, v in zip(feature_cols, c)), F.lit(0.0))
        return F.array_min(F.array(*[F.struct(far(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(self.centres)]))["i"]


def _assigner(centres: Sequence[np.ndarray], feature_cols: Sequence[str], names: Sequence[str]):
    """For ``mapInArrow``: per run and cluster the rows nearest to it and the sums
    of their features, with the run's cost - one row each, however many rows come in."""
    every, at = np.concatenate(centres), np.cumsum([0] + [len(c) for c in centres])
    half = (every**2).sum(axis=1) / 2

    def of(batches):
        total, costs = np.zeros((len(every), 1 + len(feature_cols))), np.zeros(len(centres))
        for b in batches:
            x = np.column_stack([b.column(f).to_numpy(zero_copy_only=False) for f in feature_cols])
            near = half - x @ every.T
            for run, (i, j) in enumerate(zip(at[:-1], at[1:])):
                label = near[:, i:j].argmin(axis=1)
                cost = sum((x[:, f] - every[i + label, f]) ** 2 for f in range(x.shape[1]))
                # added row after row, as Spark's K-means does: restarts that end alike differ by rounding alone
                costs[run] = np.cumsum(np.concatenate([costs[run: run + 1], cost]))[-1]
                place = np.concatenate([np.arange(j - i), label])
                for c, w in enumerate((np.ones(len(x)), *x.T)):
                    total[i:j, c] = np.bincount(place, np.concatenate([total[i:j, c], w]), j - i)
        run = np.repeat(np.arange(len(centres)), np.diff(at))
        here = np.flatnonzero(total[:, 0] > 0)
        first = np.diff(run[here], prepend=-1) > 0  # the cost of a run goes with its first row
        cols = [run[here], here - at[run[here]], total[here, 0], np.where(first, costs[run[here]], 0.0), *total[here, 1:].T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)
    return of


def fit_kmeans_runs(data: DataFrame, feature_cols: Sequence[str], runs: Sequence[tuple[int, int]], max_iter: int = 300,
                    tol: float = 1e-4) -> list[Centres]:
    """K-means for each (k, seed) of ``runs``.  Each starts from the centres that
    Spark's K-means|| draws with its seed; Lloyd's rounds of all runs that still
    move then share one pass over the rows.  A run ends as Spark's does, when no
    centre moves by more than ``tol``.  Each task sends runs x centres x features
    numbers to the driver, whatever its rows."""
    data = data.persist()  # else every start would keep its own copy

    def start(k, seed):
        return lambda: np.array(KMeans(k=k, seed=seed, maxIter=0, featuresCol="features").fit(data).clusterCenters())
    centres = run_concurrently([start(*r) for r in runs], 16)
    cost, active = [0.0] * len(runs), list(range(len(runs)))
    names = ["run", "cluster", "n", "cost", *[f"s{i}" for i in range(len(feature_cols))]]
    schema = "run long, cluster long, " + ", ".join(f"{c} double" for c in names[2:])
    rows = data.select(*feature_cols)
    for _ in range(max_iter):
        sums = [np.zeros((len(centres[r]), len(names) - 2)) for r in active]
        for run, cluster, *g in rows.mapInArrow(_assigner([centres[r] for r in active], feature_cols, names), schema).collect():
            sums[run][cluster] += g
        moved = []
        for r, g in zip(active, sums):
            here = g[:, 0] > 0  # a centre that no row is nearest to stays
            to = np.where(here[:, None], g[:, 2:] * (1.0 / np.maximum(g[:, :1], 1)), centres[r])
            if (((to - centres[r]) ** 2).sum(axis=1) > tol**2).any():
                moved.append(r)
            centres[r], cost[r] = to, float(g[:, 1].sum())
        active = moved
        if not active:
            break
    data.unpersist()
    return [Centres(c, x) for c, x in zip(centres, cost)]


def fit_kmeans(df: DataFrame, feature_cols: Sequence[str], k: int, n_init: int = 10, seed: int = 42,
               max_iter: int = 300) -> tuple[Centres, float]:
    """K-means restarted ``n_init`` times (seeds seed .. seed+n_init-1); the
    model with the lowest training cost wins.  Returns (model, cost)."""
    fits = fit_kmeans_runs(feature_table(df, feature_cols), feature_cols, [(k, seed + s) for s in range(n_init)], max_iter)
    best = min(fits, key=lambda m: m.cost)
    return best, best.cost


def predict(model: Centres, df: DataFrame, feature_cols: Sequence[str], out: str = "cluster") -> DataFrame:
    return df.withColumn(out, model.nearest(feature_cols))


def fit_profile_clusters(df: DataFrame, cols: Sequence[str], k: int = 4, fit_on: F.Column | None = None,
                         n_init: int = 10, seed: int = 42):
    """Scaler (median impute + pop-sd z-score) fitted on all rows, K-means
    fitted only on rows matching ``fit_on``; returns (scored rows, model, params)."""
    params = fit_scaler(df, cols)
    z = df.withColumns(scaled_columns(params))
    zc = ["z_" + c for c in cols]
    fit_rows = z.filter(fit_on) if fit_on is not None else z
    model, _ = fit_kmeans(fit_rows, zc, k, n_init, seed)
    return predict(model, fit_rows, zc), model, params


def k_sweep(df: DataFrame, feature_cols: Sequence[str], ks: Sequence[int] = range(2, 9), n_init: int = 10,
            seed: int = 42) -> DataFrame:
    """(k, inertia, silhouette) per k.  Silhouette is Spark's exact
    squared-Euclidean silhouette (O(n k)); the pairwise Euclidean version is
    O(n^2) and is not computed."""
    data, ks = feature_table(df, feature_cols), list(ks)
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="prediction",
                             distanceMeasure="squaredEuclidean")
    fits = fit_kmeans_runs(data, feature_cols, [(k, seed + s) for k in ks for s in range(n_init)])

    def one(i, k):
        def run():
            m = min(fits[i * n_init: (i + 1) * n_init], key=lambda x: x.cost)
            return int(k), float(m.cost), float(ev.evaluate(predict(m, data, feature_cols, "prediction")))
        return run

    rows = run_concurrently([one(i, k) for i, k in enumerate(ks)], len(ks))
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def rank_labels(assigned: DataFrame, cluster: str, value: str, names: Sequence[str],
                out: str = "cluster_label", code: str = "cluster_code") -> DataFrame:
    """Clusters ordered by mean ``value`` descending -> names[i], code i."""
    means = assigned.groupBy(cluster).agg(F.avg(value).alias("__m"))
    r = means.withColumn(code, (F.row_number().over(Window.orderBy(F.desc("__m"), F.asc(cluster))) - 1)
                         .cast("int"))
    m = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(i), F.lit(n))])
    r = r.withColumn(out, m[F.col(code)]).drop("__m")
    return assigned.join(F.broadcast(r), cluster, "left")  # k rows


def contingency(df: DataFrame, a: str, b: str, labels: Sequence[str]) -> DataFrame:
    """Zero-filled labels x labels contingency table (a, b, n)."""
    arr = F.array(*[F.lit(x) for x in labels])
    grid = df.sparkSession.range(1).select(F.explode(arr).alias(a)).select(a, F.explode(arr).alias(b))
    c = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(c, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index, share on the diagonal, disagreements (one row).
    Uses sum_i C(a_i, 2) = sum_ij n_ij (a_i - 1) / 2 so every term comes from
    one pass over the (labels x labels) contingency table."""
    c = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumns({"__ra": F.sum("n").over(Window.partitionBy(a)),
                       "__rb": F.sum("n").over(Window.partitionBy(b))})
    s = c.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2.0).alias("idx"),
              F.sum(F.col("n") * (F.col("__ra") - 1) / 2.0).alias("sa"),
              F.sum(F.col("n") * (F.col("__rb") - 1) / 2.0).alias("sb"),
              F.sum("n").alias("tot"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("diag"))
    exp = F.col("sa") * F.col("sb") / (F.col("tot") * (F.col("tot") - 1) / 2.0)
    mx = (F.col("sa") + F.col("sb")) / 2
    return s.select(div(F.col("idx") - exp, mx - exp).alias("ari"),
                    (100 * div("diag", "tot")).alias("pct_diagonal"),
                    (F.col("tot") - F.col("diag")).alias("n_disagree"), F.col("tot").alias("n"))


def propagate_labels(target: DataFrame, source: DataFrame, *, key: str, name: str, label: str,
                     source_order: Sequence[str]) -> DataFrame:
    """Label by key; else by exact name; else by the name's text before the
    first comma (trimmed).  Source keys are deduplicated first (first by
    ``source_order``).  Adds ``label`` and ``matched_by`` (key / name / prefix)."""
    def first_by(col: str, alias: str) -> DataFrame:
        s = source.filter(F.col(col).isNotNull())
        return s.groupBy(F.col(col).alias(alias)).agg(
            F.min_by(label, F.struct(*[F.col(c) for c in source_order])).alias(alias + "_lab"))
    pref = F.trim(F.split(F.col(name), ",").getItem(0))
    by_key, by_name = first_by(key, "__k"), first_by(name, "__n")
    sp = source.filter(F.col(name).isNotNull()).withColumn("__pfx", F.trim(F.split(F.col(name), ",").getItem(0)))
    by_pfx = sp.groupBy("__pfx").agg(F.min_by(label, F.struct(*[F.col(c) for c in source_order])).alias("__p_lab"))
    j = (target.join(by_key, F.col(key) == F.col("__k"), "left")
         .join(by_name, F.col(name) == F.col("__n"), "left")
         .join(by_pfx, pref == F.col("__pfx"), "left"))
    lab = F.coalesce("__k_lab", "__n_lab", "__p_lab")
    how = F.when(F.col("__k_lab").isNotNull(), "key").when(F.col("__n_lab").isNotNull(), "name") \
        .when(F.col("__p_lab").isNotNull(), "prefix")
    return j.withColumn(label, lab).withColumn("matched_by", how).drop(
        "__k", "__k_lab", "__n", "__n_lab", "__pfx", "__p_lab")


def coverage_steps(propagated: DataFrame, steps: Sequence[str] = ("key", "name", "prefix")) -> DataFrame:
    """Cumulative matched share after each step (step, matched, pct)."""
    aggs = []
    for i, s in enumerate(steps):
        aggs.append(F.count_if(F.col("matched_by").isin(list(steps[:i + 1]))).alias(s))
    a = propagated.agg(F.count(F.lit(1)).alias("__n"), *aggs)
    long = a.unpivot(["__n"], list(steps), "step", "matched")
    return long.withColumn("pct", 100 * div("matched", "__n")).drop("__n")


def alias_successor(lookup: DataFrame, aliases: DataFrame, key: str, *, time: str | None = None,
                    competed: DataFrame | None = None) -> DataFrame:
    """Copy the successor's label rows under the alias code - with a time
    column only for times the alias competed - then deduplicate.
    ``aliases`` has (alias, successor); ``competed`` has (alias, time)."""
    a = aliases.select(F.col("alias"), F.col("successor").alias(key))
    copied = lookup.join(a, key).withColumn(key, F.col("alias")).drop("alias")
    if time is not None and competed is not None:
        copied = copied.join(competed.select(F.col("alias").alias(key), time), [key, time], "left_semi")
    return lookup.unionByName(copied.select(*lookup.columns)).distinct()


def static_profile(df: DataFrame, entity: str, time: str, cols: Sequence[str], from_time: int,
                   require: str, name: str | None = None) -> DataFrame:
    """Per entity the mean of each column over times >= from_time;
    entities whose ``require`` mean is NULL are dropped; name = last non-null."""
    d = df.filter(F.col(time) >= from_time)
    aggs = [F.avg(c).alias(c) for c in cols]
    if name:
        aggs.append(last_non_null(name, time).alias(name))
    return d.groupBy(entity).agg(*aggs).filter(F.col(require).isNotNull())


def compare_labels(a: DataFrame, b: DataFrame, key: str, la: str, lb: str) -> DataFrame:
    """One row: n entities in both, n equal, percent equal."""
    j = a.select(key, la).join(b.select(key, lb), key)
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(la) == F.col(lb)).alias("n_equal")) \
        .withColumn("pct_equal", 100 * div("n_equal", "n"))


def coherence(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """Median of each variable per label (distributed exact medians)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    med = exact_medians(df, cols, [label])
    return n.join(med, n[label].eqNullSafe(med[label]), "left").drop(med[label])


def outcome_table(panel: DataFrame, entity: str, time: str, total: str, gdp_pc: str, pop: str,
                  rate: str) -> DataFrame:
    """Winners only (total > 0): average and total medals, number of
    editions, mean GDP pc, mean population, mean rate, sd of totals; rows
    with any NULL dropped."""
    w = panel.filter(F.col(total) > 0)
    a = w.groupBy(entity).agg(F.avg(total).alias("avg_medals"), F.sum(total).alias("total_medals"),
                              F.count_distinct(time).alias("n_editions"), F.avg(gdp_pc).alias("avg_gdp_pc"),
                              F.avg(pop).alias("avg_pop"), F.avg(rate).alias("medals_per_m"),
                              F.stddev_samp(total).alias("consistency"))
    return a.dropna()


def outcome_names(assigned: DataFrame, cluster: str) -> DataFrame:
    """Name each cluster by its mean profile (rule order fixed; names may repeat)."""
    m = assigned.groupBy(cluster).agg(F.avg("avg_medals").alias("__a"), F.avg("medals_per_m").alias("__p"))
    rule = None
    for nm, col, thr in dims.OUTCOME_NAMES:
        c = (F.col("__a") if col == "avg_medals" else F.col("__p")) > thr
        rule = F.when(c, nm) if rule is None else rule.when(c, nm)
    m = m.withColumn("cluster_name", rule.otherwise(dims.OUTCOME_DEFAULT)).drop("__a", "__p")
    return assigned.join(F.broadcast(m), cluster, "left")


def spot_check(df: DataFrame, name: str, code: str, pattern: str, codes: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows whose name matches ``pattern`` (case-insensitive) or whose
    code is in ``codes`` (one column named like ``code``); number and names of
    missing indicators per hit."""
    listed = codes.where(F.col(code).isNotNull()).distinct().withColumn("__listed", F.lit(True))
    df = df.join(listed, code, "left")
    hit = F.col(name).rlike("(?i)" + pattern) | F.col("__listed")
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]))
    return df.filter(hit).drop("__listed").withColumn("missing", F.array_join(missing, ", ")) \
        .withColumn("n_missing", F.size(missing)).withColumn("all_missing", F.size(missing) == len(cols))
