"""Predictive models.

* Per-category logistic models (M2) are fitted for *all* categories and all
  cross-validation folds at once with Newton's method: every iteration is one
  Spark aggregation of per-group gradients and Hessians (p x p numbers per
  group) and the tiny per-group solves run on the driver.  The coefficient
  table (groups x p) is the only broadcast and its size is bounded by the
  number of groups.  Objective = 0.5 ||w||^2 + C * sum_i s_i logloss_i with
  balanced class weights s_i and an unpenalised intercept (scikit-learn's
  L2 logistic regression).
* AUC ranks the exact scores: counts per score, running sums over slices of
  the score range, then inside a slice.
* Trees and forests are grown from counts of binned rows (``trees.py``); OLS,
  ridge and the lasso path use aggregated Gram matrices, one per fold.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .. import dims
from ..functions.semantics import div
from ..session import cut_lineage
from .trees import Regression, cells, classifiers_by_group, predict, regressions_by_model


MAX_GROUPS = 100_000  # model groups (categories x folds) whose coefficients are broadcast


def training_sets(base: DataFrame, events: DataFrame, keys: Sequence[str], category: str, won: str,
                  min_rows: int = 50, max_categories: int = 10_000) -> DataFrame:
    """M1: base rows x categories with >= ``min_rows`` event rows; y = 1 when
    the key won anything in that category.  The category list is bounded
    (checked) and exploded per base row."""
    each = cut_lineage(events.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("__n"), F.max(F.col(won)).alias("__won")))
    counts = each.groupBy(category).agg(F.sum("__n").alias("__n")).filter(F.col("__n") >= min_rows)
    cats = [r[0] for r in counts.select(category).limit(max_categories + 1).collect()]
    if len(cats) > max_categories:
        raise ValueError("too many categories for one training table")
    wins = each.filter("__won").groupBy(*keys).agg(F.collect_set(category).alias("__wins"))
    # a base row and its list of wins meet once, before there is a row for each category
    wide = cut_lineage(base.join(wins, list(keys), "left"))
    grid = wide.select("*", F.explode(F.array(*[F.lit(c) for c in sorted(cats)])).alias(category))
    return grid.withColumn("y", F.coalesce(F.array_contains("__wins", F.col(category)).cast("int"), F.lit(0))).drop("__wins")


def stratified_folds(df: DataFrame, keys: Sequence[str], strata: Sequence[str], k: int = 5, parts: int = 64) -> DataFrame:
    """``df`` with ``fold``: the rows of each stratum (category and label) in hash
    order of their key, dealt in turn to k folds.  The place in the order is that
    of one of ``parts`` slices plus the place inside it, so no stratum is one task."""
    d = df.withColumn("__h", F.xxhash64(*[F.col(c) for c in keys])).withColumn("__part", F.shiftright("__h", 58))
    count = d.groupBy(*strata, "__part").agg(F.count(F.lit(1)).alias("__n"))
    up_to = Window.partitionBy(*strata).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    count = count.withColumn("__first", F.coalesce(F.sum("__n").over(up_to), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*strata, "__part").orderBy("__h", *keys))
    d = d.join(count, [*strata, "__part"])
    return d.withColumn("fold", F.pmod(F.col("__first") + inside, F.lit(k)).cast("int")).drop("__h", "__part", "__first")


def with_folds(data: DataFrame, keys: Sequence[str], category: str, label: str, k: int = 5) -> DataFrame:
    """``data`` with the folds of the models of a category, stored: all its models start from it."""
    return cut_lineage(stratified_folds(data, [*keys, category], [category, label], k))


def fold_column(keys: Sequence[str], k: int = 5) -> F.Column:
    """Deterministic fold id in 0..k-1 from a hash of the row key."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in keys]), F.lit(k)).cast("int")


def _balanced_weights(df: DataFrame, group: Sequence[str], label: str) -> DataFrame:
    """Balanced class weight n / (n_classes x n_class) per group, from a small
    (groups x classes) count table joined back - no window over a whole group."""
    c = df.groupBy(*group, label).agg(F.count(F.lit(1)).alias("__ny"))
    tot = c.groupBy(*group).agg(F.sum("__ny").alias("__n"), F.count(F.lit(1)).alias("__k"))
    wt = cut_lineage(c.join(tot, list(group)).select(*group, label, (F.col("__n") / (F.col("__k") * F.col("__ny"))).alias("__sw")))
    return df.join(F.broadcast(wt), [*group, label])  # groups x classes rows


def grouped_logit(df: DataFrame, group: Sequence[str], features: Sequence[str], label: str,
                  c: float = 1.0, balanced: bool = True, max_iter: int = 50, tol: float = 1e-10, stored: bool = False) -> DataFrame:
    """Newton fits of L2 logistic regression for every group at once.
    Returns (group..., b0, b_<feature>...) with b0 the intercept.  ``stored``:
    ``df`` is a plain reading of a stored table, whose rows are not written again."""
    spark = df.sparkSession
    feats = list(features)
    p = len(feats) + 1
    d = _balanced_weights(df, group, label) if balanced else df.withColumn("__sw", F.lit(1.0))
    d = d.select(*group, *[F.col(f).cast("double").alias(f) for f in feats], F.col(label).cast("double").alias("__y"), "__sw")
    d = d if stored else cut_lineage(d)
    keys = [tuple(r) for r in d.select(*group).distinct().limit(MAX_GROUPS + 1).collect()]  # categories x folds
    if len(keys) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} model groups")
    gtypes = dict(d.dtypes)
    beta = {k: np.zeros(p) for k in keys}
    xs = [F.lit(1.0)] + [F.col(f) for f in feats]
    for _ in range(max_iter):
        rows = [(*k, *[float(v) for v in beta[k]]) for k in keys]
        schema = ", ".join([f"{g} {gtypes[g]}" for g in group] + [f"__b{i} double" for i in range(p)])
        coef = spark.createDataFrame(rows, schema)
        j = d.join(F.broadcast(coef), list(group))
        eta = sum((F.col(f"__b{i}") * xs[i] for i in range(p)), F.lit(0.0))
        mu = 1.0 / (1.0 + F.exp(-eta))
        j = j.withColumn("__mu", mu)
        r = F.col("__sw") * (F.col("__mu") - F.col("__y"))
        wgt = F.col("__sw") * F.col("__mu") * (1 - F.col("__mu"))
        aggs = [F.sum(r * xs[i]).alias(f"g{i}") for i in range(p)]
        aggs += [F.sum(wgt * xs[i] * xs[jj]).alias(f"h{i}_{jj}") for i in range(p) for jj in range(i, p)]
        stats = j.groupBy(*group).agg(*aggs).collect()
        step_max = 0.0
        for s in stats:
            k = tuple(s[g] for g in group)
            b = beta[k]
            g = np.array([c * s[f"g{i}"] for i in range(p)])
            h = np.zeros((p, p))
            for i in range(p):
                for jj in range(i, p):
                    h[i, jj] = h[jj, i] = c * s[f"h{i}_{jj}"]
            g[1:] += b[1:]
            h[1:, 1:] += np.eye(p - 1)
            step = np.linalg.solve(h, g)
            beta[k] = b - step
            step_max = max(step_max, float(np.max(np.abs(step))))
        if step_max < tol:
            break
    else:
        if step_max > 1e-6:
            raise ValueError(f"the Newton steps did not converge in {max_iter} rounds")
    rows = [(*k, *[float(v) for v in beta[k]]) for k in keys]
    schema = ", ".join([f"{g} {gtypes[g]}" for g in group] + ["b0 double"] + [f"b_{f} double" for f in feats])
    return spark.createDataFrame(rows, schema)


def logit_score(df: DataFrame, coef: DataFrame, group: Sequence[str], features: Sequence[str],
                out: str = "score") -> DataFrame:
    eta = F.col("b0") + sum((F.col(f"b_{f}") * F.col(f) for f in features), F.lit(0.0))
    return df.join(F.broadcast(coef), list(group)).withColumn(out, 1.0 / (1.0 + F.exp(-eta)))


def grouped_auc(scored: DataFrame, group: Sequence[str], label: str, score: str = "score") -> DataFrame:
    """Area under the ROC curve per group (ties count one half)."""
    c = scored.groupBy(*group, F.col(score).alias("__s")).agg(F.count_if(F.col(label) == 1).alias("__pos"),
                                                               F.count_if(F.col(label) != 1).alias("__neg"))
    # negatives below a score: those of the lower slices of the score range, and those below in its own slice
    c = c.withColumn("__slice", F.floor(F.col("__s") * 4096))
    before = lambda *by: Window.partitionBy(*group, *by).rowsBetween(Window.unboundedPreceding, -1)
    lower = c.groupBy(*group, "__slice").agg(F.sum("__neg").alias("__in")) \
        .withColumn("__lower", F.coalesce(F.sum("__in").over(before().orderBy("__slice")), F.lit(0))).drop("__in")
    c = c.join(lower, [*group, "__slice"]).withColumn(
        "__below", F.col("__lower") + F.coalesce(F.sum("__neg").over(before("__slice").orderBy("__s")), F.lit(0)))
    a = c.groupBy(*group).agg(F.sum(F.col("__pos") * (F.col("__below") + 0.5 * F.col("__neg"))).alias("__u"),
                              F.sum("__pos").alias("__p"), F.sum("__neg").alias("__n"))
    return a.select(*group, div("__u", F.col("__p") * F.col("__n")).alias("auc"))


def logit_per_category(data: DataFrame, keys: Sequence[str], category: str, features: Sequence[str],
                       label: str = "y", k: int = 5, c: float = 1.0) -> DataFrame:
    """M2: per category, k-fold cross-validated AUC (mean, sd ddof 0) of the
    balanced L2 logistic model, coefficients of the fit on all rows, number
    and percent of winners; sorted by mean AUC at the sink.  ``data`` may come
    from ``with_folds``."""
    d = data if "fold" in data.columns else with_folds(data, keys, category, label, k)
    train = d.select("*", F.explode(F.sequence(F.lit(-1), F.lit(k - 1))).alias("model")) \
        .filter(F.col("model") != F.col("fold"))          # model -1 = all rows
    coef = grouped_logit(train, [category, "model"], features, label, c, stored=True)  # a row is in k models
    test = d.withColumn("model", F.col("fold"))
    auc = grouped_auc(logit_score(test, coef, [category, "model"], features), [category, "model"], label)
    cv = auc.groupBy(category).agg(F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"))
    full = coef.filter(F.col("model") == -1).drop("model")
    n = d.groupBy(category).agg(F.sum(label).alias("n_winners"), (100 * F.avg(label)).alias("pct_winners"),
                                   F.count(F.lit(1)).alias("n"))
    return cv.join(full, category).join(n, category)


def trees_per_category(data: DataFrame, keys: Sequence[str], category: str, features: Sequence[str],
                       label: str = "y", k: int = 5, seed: int = 42, trees: int = 300, rounds: int = 200) -> DataFrame:
    """M3: per category, k-fold AUC of a balanced random forest (300 trees,
    depth 5, min leaf 5) and an unweighted gradient-boosted model (200 rounds,
    depth 3, step 0.05); feature importances of fits on all rows.  Spark counts
    the binned rows once; all (category, fold) fits start from the counts.
    ``data`` may come from ``with_folds``."""
    d = data if "fold" in data.columns else with_folds(data, keys, category, label, k)
    d = d.select(category, "fold", *features, F.col(label).cast("double").alias(label))
    table, edges = cells(d, [category, "fold"], features, label)
    fits = cut_lineage(classifiers_by_group(table, category, features, max([len(e) for e in edges], default=0) + 1, k, seed,
                                            {"trees": trees, "depth": 5, "leaf": 5}, {"rounds": rounds, "depth": 3, "rate": 0.05}))
    cv = fits.filter(F.col("model") >= 0).groupBy(category, "kind").agg(F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"))
    imp = fits.filter(F.col("model") == -1).select(category, "kind", *[f"imp_{f}" for f in features])
    return cv.join(imp, [category, "kind"]).withColumnRenamed("kind", "model")


def model_deltas(logit: DataFrame, trees: DataFrame, category: str, threshold: float = 0.01) -> DataFrame:
    """M3: AUC delta of each tree model over the logistic model; ``better`` when > threshold."""
    t = trees.select(category, "model", F.col("auc_mean").alias("tree_auc"))
    j = t.join(logit.select(category, F.col("auc_mean").alias("logit_auc")), category)
    return j.withColumn("delta", F.col("tree_auc") - F.col("logit_auc")) \
        .withColumn("better", F.col("delta") > threshold)


def profile_probabilities(coef: DataFrame, profiles: DataFrame, category: str, profile: str,
                          features: Sequence[str], rich: str, poor: str) -> DataFrame:
    """M4: probability of winning per (category, profile) for the given
    profile rows (features already on the model scale, host = 0), and the
    rich - poor gap per category."""
    eta = F.col("b0") + sum((F.col(f"b_{f}") * F.col(f) for f in features), F.lit(0.0))
    prof = profiles.select(profile, *features).limit(10_001).collect()  # a handful of profile rows
    if len(prof) > 10_000:
        raise ValueError("profile table is not bounded")
    arr = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in (profile, *features)]) for r in prof])
    j = coef.select("*", F.explode(arr).alias("__p")).select("*", "__p.*").drop("__p")
    pr = j.withColumn("prob", 1.0 / (1.0 + F.exp(-eta))).select(category, profile, "prob")
    piv = pr.groupBy(category).agg(F.max(F.when(F.col(profile) == rich, F.col("prob"))).alias("p_rich"),
                                   F.max(F.when(F.col(profile) == poor, F.col("prob"))).alias("p_poor"))
    return pr, piv.withColumn("gap", F.col("p_rich") - F.col("p_poor"))


def gram_fit(df: DataFrame, features: Sequence[str], label: str, alpha: float = 0.0) -> np.ndarray:
    """OLS (alpha 0) / ridge (alpha > 0, on standardised features, intercept
    unpenalised) from the aggregated Gram matrix X'X and X'y (p x p numbers
    reach the driver), on the features' own scale."""
    xs = [F.lit(1.0)] + [F.col(f).cast("double") for f in features]
    p = len(xs)
    aggs = [F.sum(xs[i] * xs[j]).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)]
    aggs += [F.sum(xs[i] * F.col(label)).alias(f"b{i}") for i in range(p)]
    s = df.agg(*aggs).first()
    a = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            a[i, j] = a[j, i] = s[f"a{i}_{j}"] or 0.0
    b = np.array([s[f"b{i}"] or 0.0 for i in range(p)])
    if not a[0, 0]:
        return np.zeros(p)
    n, mean, y = a[0, 0], a[0, 1:] / a[0, 0], b[0] / a[0, 0]
    sd = np.sqrt(np.maximum(np.diag(a)[1:] / n - mean**2, 0.0))
    sd[sd == 0] = 1.0
    z = (a[1:, 1:] - n * np.outer(mean, mean)) / np.outer(sd, sd)
    slope = np.linalg.lstsq(z + alpha * np.eye(p - 1), (b[1:] - mean * b[0]) / sd, rcond=None)[0] / sd
    return np.concatenate([[y - slope @ mean], slope])


def linear_predict(df: DataFrame, coef: np.ndarray, features: Sequence[str], out: str = "pred") -> DataFrame:
    e = F.lit(float(coef[0])) + sum((F.lit(float(c)) * F.col(f) for c, f in zip(coef[1:], features)), F.lit(0.0))
    return df.withColumn(out, e)


def r2_mae(df: DataFrame, label: str, pred: str = "pred") -> DataFrame:
    m = df.agg(F.avg(label).alias("__m")).first()["__m"]
    return df.agg((1 - div(F.sum((F.col(label) - F.col(pred)) ** 2), F.sum((F.col(label) - F.lit(m)) ** 2)))
                  .alias("r2"), F.avg(F.abs(F.col(label) - F.col(pred))).alias("mae"))


def gram_by(df: DataFrame, by: Sequence[str], features: Sequence[str], label: str) -> dict[tuple, np.ndarray]:
    """{by values: Z'Z} of Z = (1, features, label), in one aggregation; only
    these (p + 2)^2 numbers of each group reach the driver."""
    z = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(label).cast("double")]
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    out = {}
    for r in df.groupBy(*by).agg(*[F.sum(z[i] * z[j]).alias(f"a{i}_{j}") for i, j in pairs]).collect():
        g = np.zeros((len(z), len(z)))
        for i, j in pairs:
            g[i, j] = g[j, i] = r[f"a{i}_{j}"] or 0.0
        out[tuple(r[c] for c in by)] = g
    return out


def _centred(g: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float, np.ndarray, np.ndarray]:
    """(n, feature means, sds, label mean, correlation-scale X'X, X'y) of a Gram matrix."""
    n, mean, y = g[0, 0], g[0, 1:-1] / g[0, 0], g[0, -1] / g[0, 0]
    sd = np.sqrt(np.maximum(np.diag(g)[1:-1] / n - mean**2, 0.0))
    sd[sd <= 1e-9 * np.abs(mean)] = 1.0
    xx = (g[1:-1, 1:-1] - n * np.outer(mean, mean)) / np.outer(sd, sd)
    return n, mean, sd, y, xx, (g[1:-1, -1] - n * mean * y) / sd


def _on_own_scale(slope: np.ndarray, mean: np.ndarray, sd: np.ndarray, y: float) -> np.ndarray:
    return np.concatenate([[y - (slope / sd) @ mean], slope / sd])


def ridge_from_gram(g: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and slopes of ridge on standardised features (alpha 0: OLS)."""
    n, mean, sd, y, xx, xy = _centred(g)
    return _on_own_scale(np.linalg.lstsq(xx + alpha * np.eye(len(xy)), xy, rcond=None)[0], mean, sd, y)


def lasso_path(xx: np.ndarray, xy: np.ndarray, n: float, alphas: Sequence[float], tol: float = 1e-10, rounds: int = 10_000) -> np.ndarray:
    """Slopes for each penalty, largest first: coordinate descent on
    ``1 / (2n) |y - Xb|^2 + alpha |b|_1`` given X'X and X'y, each fit from the one before."""
    b, out = np.zeros(len(xy)), []
    for alpha in alphas:
        for _ in range(rounds):
            most = 0.0
            for j in range(len(b)):
                if xx[j, j] <= 0:
                    continue
                rho = xy[j] - xx[j] @ b + xx[j, j] * b[j]
                new = np.sign(rho) * max(abs(rho) - n * alpha, 0.0) / xx[j, j]
                most, b[j] = max(most, abs(new - b[j])), new
            if most <= tol * max(1.0, np.abs(b).max(initial=0.0)):
                break
        out.append(b.copy())
    return np.array(out)


def lasso_cv(grams: Sequence[np.ndarray], n_alphas: int = 100, eps: float = 1e-3) -> tuple[np.ndarray, float]:
    """(intercept and slopes, penalty): the penalty of least mean squared error
    over the folds given by their Gram matrices, on a path of ``n_alphas``
    penalties from the least that leaves no slope down to ``eps`` of it.  Errors
    of a fold left out follow from its own matrix, so no row is read again."""
    whole = sum(grams)
    n, mean, sd, y, xx, xy = _centred(whole)
    top = np.abs(xy).max() / n
    alphas = top * np.logspace(0, np.log10(eps), n_alphas) if top > 0 else np.zeros(1)
    error = np.zeros(len(alphas))
    for g in grams:
        if g[0, 0] in (0, n):
            continue
        m, mu, s, yy, fxx, fxy = _centred(whole - g)
        for i, slope in enumerate(lasso_path(fxx, fxy, m, alphas, tol=1e-7)):
            c = np.concatenate([-_on_own_scale(slope, mu, s, yy), [1.0]])
            error[i] += c @ g @ c / g[0, 0]
    best = int(np.argmin(error))
    return _on_own_scale(lasso_path(xx, xy, n, alphas[: best + 1])[-1], mean, sd, y), float(alphas[best])


def regression_bakeoff(data: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, k: int = 5, inner: int = 5,
                       seed: int = 42, forest: dict | None = None, boost: dict | None = None) -> DataFrame:
    """M6: k-fold R2 (mean, sd) and MAE of OLS, ridge (alpha 1), lasso (penalty
    by ``inner`` folds inside the training rows, full path), random forest (200 x
    depth 8 x leaf 5) and gradient boosting (200 x depth 4 x 0.05).  Folds are of
    equal size.  The linear fits share one aggregation of Gram matrices by
    (fold, inner fold), the trees one table of cells, the scores one pass."""
    d = data.withColumn("__all", F.lit(0)).withColumn(label, F.col(label).cast("double"))
    d = stratified_folds(d, keys, ["__all"], k * inner).withColumnRenamed("fold", "__f")
    d = cut_lineage(d.withColumn("fold", F.pmod("__f", F.lit(k)).cast("int")).withColumn("inner", F.floor(F.col("__f") / k).cast("int")).drop("__all", "__f"))
    grams = gram_by(d, ["fold", "inner"], features, label)
    folds = sorted({f for f, _ in grams})
    coef = {}
    for f in folds:
        parts = [sum(g for (a, i), g in grams.items() if a != f and i == j) for j in range(inner)]
        parts = [g for g in parts if isinstance(g, np.ndarray)]
        if parts:
            coef[f] = {"ols": ridge_from_gram(sum(parts), 0.0), "ridge": ridge_from_gram(sum(parts), 1.0), "lasso": lasso_cv(parts)[0]}
    table, edges = cells(d, ["fold"], features, label)
    kinds = {"rf": forest or {"trees": 200, "depth": 8, "leaf": 5}, "gbt": boost or {"rounds": 200, "depth": 4, "rate": 0.05}}
    fits = regressions_by_model(table, features, edges, folds, kinds, seed)
    spark = data.sparkSession
    if not coef:
        return spark.createDataFrame([], "model string, r2_mean double, r2_std double, mae double")
    linear = [m for m in ("ols", "ridge", "lasso")]
    rows = [(f, *[[float(x) for x in c[m]] for m in linear]) for f, c in coef.items()]  # k rows
    scored = predict(d, {c: {f: fits[f, c] for f in folds if (f, c) in fits} for c in kinds}, "fold")
    scored = scored.join(F.broadcast(spark.createDataFrame(rows, "fold int, " + ", ".join(f"__{m} array<double>" for m in linear))), "fold")
    value = lambda m: sum((F.col(f"__{m}")[i + 1] * F.col(x) for i, x in enumerate(features)), F.col(f"__{m}")[0])
    scored = scored.select("fold", label, *[value(m).alias(m) for m in linear], *kinds)
    y = F.col(label)
    spread = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y)
    each = scored.groupBy("fold").agg(*[(1 - div(F.sum((y - F.col(m)) ** 2), spread)).alias(f"r2_{m}") for m in (*linear, *kinds)],
                                      *[F.avg(F.abs(y - F.col(m))).alias(f"mae_{m}") for m in (*linear, *kinds)])
    out = each.select("fold", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"r2_{m}").alias("r2"), F.col(f"mae_{m}").alias("mae"))
                                                  for m in (*linear, *kinds)])).alias("e")).select("e.*")
    return out.groupBy("model").agg(F.avg("r2").alias("r2_mean"), F.stddev_pop("r2").alias("r2_std"), F.avg("mae").alias("mae"))


def rf_importance(data: DataFrame, features: Sequence[str], label: str, trees: int = 300, depth: int = 8,
                  leaf: int = 5, seed: int = 42):
    """M7: random-forest regressor and its feature importances (feature, importance)."""
    table, edges = cells(data.withColumn("fold", F.lit(0)), ["fold"], features, label)
    m = regressions_by_model(table, features, edges, [-1], {"rf": {"trees": trees, "depth": depth, "leaf": leaf}}, seed)[-1, "rf"]
    return m, data.sparkSession.createDataFrame(m.importance(), "feature string, importance double")


def holdout_eval(model: Regression, test: DataFrame, label: str) -> DataFrame:
    """M8: predictions floored at 0 and rounded to 1 dp; error, abs error."""
    p = predict(test, {"pred": model}).withColumn("pred", F.bround(F.greatest(F.col("pred"), F.lit(0.0)), 1))
    return p.withColumns({"error": F.col("pred") - F.col(label), "abs_error": F.abs(F.col("pred") - F.col(label))})


def project_scenario(panel: DataFrame, entity: str, time: str, gdp: str, pop: str, prev: str,
                     host: str | None = None, life: str | None = None, urban: str | None = None) -> DataFrame:
    """M9: per entity, growth g = mean percentage change between the GDP values
    of its last 3 rows, those without a value left out (two changes at most),
    clipped to the range, default when undefined; next values:
    GDP x (1 + g)^2, population x 1.015, life + 0.5, urban + 0.5 (cap 100)."""
    w = Window.partitionBy(entity).orderBy(time)
    last = Window.partitionBy(entity).orderBy(F.desc(time))
    pc = panel.withColumn("__rn", F.row_number().over(last)).filter((F.col("__rn") <= 3) & F.col(gdp).isNotNull()) \
        .withColumn("__pct", div(F.col(gdp) - F.lag(gdp).over(w), F.lag(gdp).over(w)))
    g = pc.groupBy(entity).agg(F.avg("__pct").alias("__g"))
    latest = panel.withColumn("__rn", F.row_number().over(last)).filter(F.col("__rn") == 1).drop("__rn")
    lo, hi = dims.GROWTH_CLIP
    j = latest.join(g, entity, "left").withColumn(
        "growth", F.coalesce(F.least(F.greatest(F.col("__g"), F.lit(lo)), F.lit(hi)), F.lit(dims.GROWTH_DEFAULT)))
    out = j.withColumns({"gdp_next": F.col(gdp) * (1 + F.col("growth")) ** 2,
                         "pop_next": F.col(pop) * dims.POP_GROWTH,
                         "prev_medals": F.col(prev)})
    if life:
        out = out.withColumn("life_next", F.col(life) + dims.LIFE_STEP)
    if urban:
        out = out.withColumn("urban_next", F.least(F.col(urban) + dims.URBAN_STEP, F.lit(dims.URBAN_CAP)))
    if host:
        out = out.withColumn("is_host", F.col(host))
    return out.drop("__g")


def forecast_interval(model: Regression, rows: DataFrame, lo: float = 0.10, hi: float = 0.90) -> DataFrame:
    """Forest prediction floored at 0 and rounded, with the lo / hi
    percentiles of the individual trees' predictions, floored and rounded alike;
    one pass walks all trees."""
    out = predict(rows, {"pred": model}, quantiles={"p_lo": ("pred", lo), "p_hi": ("pred", hi)})
    return out.withColumns({c: F.bround(F.greatest(F.col(c), F.lit(0.0)), 0) for c in ("pred", "p_lo", "p_hi")})


def host_effect(model: Regression, rows: DataFrame, host: str) -> DataFrame:
    """Prediction of each row as a host and as none, and the difference."""
    both = [predict(rows.withColumn(host, F.lit(v).cast(rows.schema[host].dataType)), {name: model}).drop(host)
            for v, name in ((1, "as_host"), (0, "as_guest"))]
    keys = [c for c in both[0].columns if c != "as_host"]
    tagged = both[0].select(*keys, "as_host", F.lit(None).cast("double").alias("as_guest")).unionByName(
        both[1].select(*keys, F.lit(None).cast("double").alias("as_host"), "as_guest"))
    out = tagged.groupBy(*keys).agg(F.max("as_host").alias("as_host"), F.max("as_guest").alias("as_guest"))
    return out.withColumn("host_effect", F.col("as_host") - F.col("as_guest"))
