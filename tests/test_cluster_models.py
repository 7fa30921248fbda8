import numpy as np
from pyspark.sql import functions as F

from panelkit.operators import cluster as D
from panelkit.operators import models as M


def test_ari_identical_and_band_edges(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "b"), ("c", "c")], "x string, y string")
    assert abs(D.agreement(df, "x", "y").first().ari - 1.0) < 1e-12
    bands = spark.createDataFrame([(1135.99,), (1136.0,), (-5.0,), (None,)], "g double")
    got = [r[0] for r in bands.select(D.income_band("g")).collect()]
    assert got == ["Poveri estremi", "Reddito basso-medio", "Ricchi avanzati", None]


def test_assign_missing_band_nearest(spark):
    rows = [("a", "L", 1.0, 1.0), ("b", "L", 1.2, 0.8), ("c", "H", 9.0, 9.0), ("d", "H", 8.8, 9.2), ("e", None, 8.5, 8.0)]
    df = spark.createDataFrame(rows, "k string, band string, p1 double, p2 double")
    got = {r.k: r.band_filled for r in D.assign_missing_band(df, "band", ["p1", "p2"]).collect()}
    assert got["e"] == "H" and got["a"] == "L"


def test_rank_labels_by_mean(spark):
    df = spark.createDataFrame([(0, 5.0), (1, 50.0), (0, 7.0)], "cluster int, v double")
    got = {r.cluster: (r.cluster_code, r.cluster_label) for r in D.rank_labels(df, "cluster", "v", ["rich", "poor"]).collect()}
    assert got[1] == (0, "rich") and got[0] == (1, "poor")


def test_grouped_logit_matches_newton_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] + 0.5 * rng.normal(size=200) > 0.7).astype(float)
    rows = [("g", float(a), float(b), float(t)) for (a, b), t in zip(x, y)]
    df = spark.createDataFrame(rows, "g string, a double, b double, y double")
    coef = M.grouped_logit(df, ["g"], ["a", "b"], "y").first()
    # reference: Newton on 0.5|w|^2 + sum s_i logloss with balanced weights, intercept unpenalised
    s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    X = np.hstack([np.ones((200, 1)), x])
    w = np.zeros(3)
    for _ in range(50):
        mu = 1 / (1 + np.exp(-X @ w))
        g = X.T @ (s * (mu - y)); g[1:] += w[1:]
        h = (X * (s * mu * (1 - mu))[:, None]).T @ X; h[1:, 1:] += np.eye(2)
        w -= np.linalg.solve(h, g)
    assert np.allclose([coef.b0, coef.b_a, coef.b_b], w, atol=1e-7)


def test_grouped_auc_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    sc = np.round(rng.random(60), 3)
    yy = (rng.random(60) < 0.4).astype(int)
    df = spark.createDataFrame([("g", float(a), int(b)) for a, b in zip(sc, yy)], "g string, score double, y int")
    auc = M.grouped_auc(df, ["g"], "y").first().auc
    pos, neg = sc[yy == 1], sc[yy == 0]
    brute = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert abs(auc - brute) < 1e-12


def test_gram_ols(spark):
    rows = [(float(i), 3.0 + 2.0 * i) for i in range(10)]
    df = spark.createDataFrame(rows, "x double, y double")
    assert np.allclose(M.gram_fit(df, ["x"], "y"), [3.0, 2.0])


def test_kmeans_sweep_invariants(spark):
    rows = [(float(a), float(b)) for a, b in np.random.default_rng(3).normal(size=(60, 2)) * 0.1] + \
           [(5 + float(a), 5 + float(b)) for a, b in np.random.default_rng(4).normal(size=(60, 2)) * 0.1]
    df = spark.createDataFrame(rows, "x double, y double")
    sw = {r.k: r for r in D.k_sweep(df, ["x", "y"], [2, 3], n_init=2).collect()}
    assert sw[3].inertia <= sw[2].inertia and sw[2].silhouette > 0.9


def test_kmeans_runs_end_where_sparks_do(spark):
    from pyspark.ml.clustering import KMeans
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b)) for a, b in np.concatenate([rng.normal(size=(150, 2)) + c for c in ([0, 0], [4, 1], [1, 5])])]
    data = D.feature_table(spark.createDataFrame(rows, "x double, y double"), ["x", "y"])
    runs = [(3, 42), (3, 43), (5, 42)]
    got = D.fit_kmeans_runs(data, ["x", "y"], runs)
    for (k, seed), m in zip(runs, got):
        want = KMeans(k=k, seed=seed, maxIter=300, featuresCol="features").fit(data)
        assert np.allclose(m.centres, np.array(want.clusterCenters()), atol=1e-9)
        assert abs(m.cost - want.summary.trainingCost) < 1e-6
        both = D.predict(m, want.transform(data), ["x", "y"])
        assert both.where("cluster <> prediction").count() == 0


def test_training_rows_with_twin_keys_and_unknown_wins(spark):
    base = spark.createDataFrame([(1, 0.5), (1, 0.7), (2, 0.1), (None, 0.2)], "k int, f double")
    ev = spark.createDataFrame([(1, "a", True), (1, "a", False), (2, "b", False), (2, "a", None), (None, "b", True), (2, "rare", True)],
                               "k int, c string, won boolean")
    got = sorted((r.k or 0, r.f, r.c, r.y) for r in M.training_sets(base, ev, ["k"], "c", "won", 2).collect())
    assert got == sorted((k, f, c, int((k, c) == (1, "a"))) for k, f in ((1, 0.5), (1, 0.7), (2, 0.1), (0, 0.2)) for c in "ab")


def test_logit_of_stored_rows(spark):
    rng = np.random.default_rng(6)
    rows = [("ab"[i % 2], float(a), float(a + rng.normal() > 0)) for i, a in enumerate(rng.normal(size=200))]
    df = spark.createDataFrame(rows, "g string, a double, y double")
    plain, stored = (M.grouped_logit(df, ["g"], ["a"], "y", stored=s).orderBy("g").collect() for s in (False, True))
    assert np.allclose([tuple(r)[1:] for r in plain], [tuple(r)[1:] for r in stored], atol=1e-9)
