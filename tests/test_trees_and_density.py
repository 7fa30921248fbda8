"""Histogram trees, lasso paths, density clusters, the vector index, ranks,
grids, mojibake and column fallback against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import drivers as H
from panelkit.operators import models as M
from panelkit.operators import panel as P
from panelkit.operators import text as T
from panelkit.operators import trees as R
from panelkit.plans import catalog
from panelkit.sources import readers


def plain_tree(x, y, depth, leaf):
    """Greedy least-squares tree: {path: (feature, bin) or value}."""
    out = {}

    def split(rows, path, d):
        best = None
        if d < depth:
            for f in range(x.shape[0]):
                for c in sorted(set(x[f][rows]))[:-1]:
                    go = x[f][rows] > c
                    if min(go.sum(), (~go).sum()) < leaf:
                        continue
                    gain = sum(y[rows][g].sum() ** 2 / g.sum() for g in (go, ~go)) - y[rows].sum() ** 2 / len(rows)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, f, c, go)
        if best is None:
            out[path] = y[rows].mean()
            return
        split(rows[~best[3]], path + "l", d + 1)
        split(rows[best[3]], path + "r", d + 1)
    split(np.arange(x.shape[1]), "", 0)
    return out


def test_one_tree_is_the_greedy_one():
    rng = np.random.default_rng(0)
    for leaf in (1, 7):
        x = rng.integers(0, 6, (3, 200))
        y = rng.normal(size=200) + x[0] * 2 - (x[1] > 3) * x[2]
        one = np.ones((1, 200))
        tree = R.grow(x, one, one, y[None], 3, leaf, 3, np.random.default_rng(1), 6)
        got = tree.walk(x)[0]
        assert len(set(np.round(got, 9))) == len(plain_tree(x, y, 3, leaf))
        assert np.allclose(sorted(set(np.round(got, 9))), sorted(plain_tree(x, y, 3, leaf).values()))
        weighted = R.grow(x[:, :50], 3 * one[:, :50], 3 * one[:, :50], 3 * y[None, :50], 3, leaf, 3, np.random.default_rng(1), 6)
        again = np.tile(x[:, :50], 3)  # a cell of three rows is three rows
        plain = R.grow(again, np.ones((1, 150)), np.ones((1, 150)), np.tile(y[None, :50], 3), 3, leaf, 3, np.random.default_rng(1), 6)
        assert np.allclose(weighted.walk(x), plain.walk(x))


def test_forests_and_boosting_learn():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 16, (4, 3000))
    p = 1 / (1 + np.exp(-(x[0] - 8) * 0.8))
    y = (rng.random(3000) < p).astype(float)
    n = np.ones(2000)
    f = R.random_forest(x[:, :2000], n, y[:2000], trees=60, depth=5, leaf=5, features=2, seed=3, n_bins=16, balanced=True)
    b, first = R.boosted(x[:, :2000], n, y[:2000], rounds=80, depth=3, rate=0.05, n_bins=16, logistic=True)
    best = R.auc_of_cells(p[2000:], np.ones(1000), y[2000:])
    for score, forest in ((R._score_blocks(f, x[:, 2000:], np.mean), f), (first + R._score_blocks(b, x[:, 2000:], np.sum), b)):
        assert R.auc_of_cells(score, np.ones(1000), y[2000:]) > best - 0.03
        share = R._shares(forest.importance)
        assert abs(share.sum() - 1) < 1e-9 and share.argmax() == 0
    brute = np.mean([(a > c) + 0.5 * (a == c) for a, s in zip(x[0], y) for c, t in zip(x[0], y) if s and not t])
    assert abs(R.auc_of_cells(x[0].astype(float), np.ones(3000), y) - brute) < 1e-9


def test_regressions_over_cells(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    y = 3 * x[:, 0] + (x[:, 1] > 0) + rng.normal(size=400) * 0.1
    rows = [(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id int, u double, v double, y double")
    out = {r.model: r for r in M.regression_bakeoff(df, ["id"], ["u", "v"], "y", forest={"trees": 30, "depth": 6, "leaf": 3},
                                                    boost={"rounds": 60, "depth": 3, "rate": 0.1}).collect()}
    assert set(out) == {"ols", "ridge", "lasso", "rf", "gbt"} and all(r.r2_mean > 0.9 and r.mae < 1 for r in out.values())
    fit, imp = M.rf_importance(df, ["u", "v"], "y", trees=20, depth=4)
    assert {r.feature for r in imp.collect()} == {"u", "v"}
    got = M.forecast_interval(fit, df).collect()
    each = fit.forest.walk(fit.bins(x))
    for r in got[:50]:
        want = [max(0.0, v) for v in (each[:, r.id].mean(), *np.quantile(each[:, r.id], [0.1, 0.9]))]
        assert max(abs(a - b) for a, b in zip((r.pred, r.p_lo, r.p_hi), want)) <= 0.5 + 1e-9
    nodes = fit.node_table(spark)
    assert nodes.where("feature IS NOT NULL").count() > 0 and nodes.select("tree").distinct().count() == 20
    # fewer bins when a group would have too many cells
    table, edges = R.cells(df.withColumn("fold", F.lit(0)), ["fold"], ["u", "v"], "y", bins=32, most=80)
    assert table.count() <= 80 and table.agg(F.sum("n")).first()[0] == 400


def test_lasso_path_and_folds():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 5)) * [1, 10, 0.1, 3, 1] + [0, 5, 2, -1, 0]
    y = x @ [2, 0.3, 0, -1, 0] + rng.normal(size=150)
    fold = np.arange(150) % 5
    z = np.column_stack([np.ones(150), x, y])
    coef, alpha = M.lasso_cv([z[fold == f].T @ z[fold == f] for f in range(5)])

    def descent(x, y, alpha):
        mean, sd = x.mean(0), x.std(0)
        u, v, b = (x - mean) / sd, y - y.mean(), np.zeros(x.shape[1])
        for _ in range(3000):
            for j in range(len(b)):
                r = u[:, j] @ (v - u @ b + u[:, j] * b[j]) / len(v)
                b[j] = np.sign(r) * max(abs(r) - alpha, 0) / (u[:, j] @ u[:, j] / len(v))
        return np.concatenate([[y.mean() - (b / sd) @ mean], b / sd])
    assert np.allclose(coef, descent(x, y, alpha), atol=1e-6)
    error = lambda a: sum(((np.column_stack([np.ones((fold == f).sum()), x[fold == f]]) @ descent(x[fold != f], y[fold != f], a)
                            - y[fold == f]) ** 2).mean() for f in range(5))
    assert error(alpha) <= min(error(alpha * 1.2), error(alpha / 1.2)) + 1e-6


def dbscan(pts, eps, least):
    near = [[j for j, q in enumerate(pts) if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= eps * eps] for p in pts]
    core = [len(n) >= least for n in near]
    label, k = [None] * len(pts), 0
    for i in range(len(pts)):
        if core[i] and label[i] is None:
            todo, label[i] = [i], k
            while todo:
                for j in near[todo.pop()]:
                    if core[j] and label[j] is None:
                        label[j] = k
                        todo.append(j)
            k += 1
    for i in range(len(pts)):
        if not core[i]:
            c = [((pts[i][0] - pts[j][0]) ** 2 + (pts[i][1] - pts[j][1]) ** 2, label[j]) for j in near[i] if core[j]]
            label[i] = min(c)[1] if c else -1
    return core, label


def test_density_clusters_equal_dbscan(spark):
    rng = np.random.default_rng(6)
    pts = np.concatenate([rng.normal(size=(700, 2)) * 0.3, rng.normal(size=(500, 2)) * 0.1 + [2, 1], rng.random((600, 2)) * 8 - 2,
                          np.repeat([[5.0, 5.0]], 150, axis=0), np.column_stack([np.linspace(3, 4, 50), np.full(50, -1.0)])])
    eps, least = 0.12, 5
    core, label = dbscan(pts.tolist(), eps, least)
    rows = [(i, *map(float, p)) for i, p in enumerate(pts)] + [(9001, None, 1.0), (9002, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double").repartition(5)
    got = {r.id: (r.is_core, r.cluster) for r in T.density_clusters(df, "id", "x", "y", eps, least).collect()}
    assert got.pop(9001) == got.pop(9002) == (False, -1)
    assert [got[i][0] for i in range(len(pts))] == core
    pairs = {(a, got[i][1]) for i, a in enumerate(label)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})  # the same partition
    assert all((a == -1) == (b == -1) for a, b in pairs)


def test_vector_index_recall(spark):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(40, 16))
    x = centre[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * 0.4
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, [0.0] * 16)], "id long, v array<double>")
    centres = T.fit_lists(df, "id", "v", lists=16)
    index = T.list_index(df, "id", "v", centres)
    assert index.count() == 3000  # every vector with a direction
    top = T.indexed_top_k(index, df.where("id % 100 = 0"), "id", "id", "v", centres, k=40, probes=6)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for r in top.collect():
        found.setdefault(r.query, {})[r.rank] = r.id
        assert abs(r.score - u[r.query] @ u[r.id]) < 1e-9
    hit = [len(set(np.argsort(-(u @ u[q]))[:40].tolist()) & set(ids.values())) / 40 for q, ids in found.items()]
    assert len(found) == 30 and all(sorted(ids) == list(range(1, 41)) for ids in found.values()) and np.mean(hit) >= 0.9


def test_vector_search_in_blocks(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 8))
    x[300:420] = x[7]  # more equal vectors than a query has places
    x[500:520] = 2 * x[40]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[40].tolist()), (9999, [0.0] * 8)], "id long, v array<double>")
    df = df.repartition(5)
    centres = T.fit_lists(df, "id", "v", lists=6)
    index = T.list_index(df, "id", "v", centres)
    rows = [(-1 if r.id is None else r.id, np.array(r.v), r.list) for r in index.collect()]
    asks = df.where("id % 20 = 0").unionByName(df.where("id = 40"))  # one query comes twice
    unit = {i: v for i, v, _ in rows}
    want = {}
    for q in range(0, 900, 20):
        lists = np.argsort(-(unit[q] @ np.array(centres).T), kind="stable")[:3]
        best = sorted((-sum(a * b for a, b in zip(v, unit[q])), i) for i, v, l in rows if l in lists)
        want[q] = sorted(best * 2 if q == 40 else best)[:40]
    for block, ask in ((1 << 16, 1 << 12), (100, 7)):
        top = T.indexed_top_k(index, asks, "id", "id", "v", centres, k=40, probes=3, block=block, ask=ask)
        assert "Join" not in top._jdf.queryExecution().executedPlan().toString()  # no row for a query and an index row
        got = {}
        for r in top.orderBy("query", "rank").collect():
            got.setdefault(r.query, []).append((-r.score, -1 if r.id is None else r.id))
        assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}
        assert all(abs(a - b) < 1e-12 for q in want for (a, _), (b, _) in zip(got[q], want[q]))
    words = df.selectExpr("concat('k', id) AS id", "v")
    named = T.indexed_top_k(T.list_index(words, "id", "v", centres), words.where("id = 'k40'"), "id", "id", "v", centres, k=3, probes=6)
    assert [r.id for r in named.orderBy("rank").collect()] == [None, "k40", "k500"]
    assert T.indexed_top_k(index, df.where("id < 0"), "id", "id", "v", centres).count() == 0


def test_index_query_recall_without_structure(spark, tmp_path):
    x = np.random.default_rng(12).normal(size=(1500, 64))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    catalog.load_all()
    found = {}
    for r in catalog.QUERIES["text_semantic_index"](spark, str(tmp_path)).collect():
        found.setdefault(r["query"], set()).add(r["vec_id"])
    hit = [len(found[q] & set(np.argsort(-(u @ u[q]))[:40].tolist())) / 40 for q in range(0, 1500, 20)]
    assert len(found) == 75 and np.mean(hit) >= 0.9


def test_global_rank(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, m int").repartition(7)
    got = {r.a: r["rank"] for r in H.global_rank(df, [F.desc("m"), F.asc("a")]).collect()}
    assert got == {a: k for k, (a, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}


def test_grid_has_no_cap(spark):
    left, right = spark.range(3).toDF("e"), spark.range(100_001).selectExpr("id AS y", "CAST(id AS STRING) AS s")
    got = P.grid(left, right)
    assert got.count() == 300_003 and got.distinct().count() == 300_003
    assert P.grid(left, right.limit(0)).count() == 0


def test_mojibake(spark):
    sound = ["perché è già così", "plain", "naïve €uro “x” – œuvre", "日本 🙂", "", "Ã", "Ãx â€ é", "Ô ê"]
    rows = [(i, s) for i, s in enumerate(sound)]
    for i, s in enumerate(sound[:4]):
        rows += [(100 + i, s.encode().decode("latin-1"))]
        raw = s.encode()
        if not any(b in raw for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)):
            rows += [(200 + i, raw.decode("cp1252"))]
    rows += [(300, "già " + "così".encode().decode("cp1252")), (301, None)]
    got = {r.id: r.t for r in spark.createDataFrame(rows, "id int, s string").select("id", T.fix_mojibake(F.col("s")).alias("t")).collect()}
    for i, s in enumerate(sound):
        assert got[i] == s
    assert all(got[100 + i] == sound[i] for i in range(4)) and all(got.get(200 + i, sound[i]) == sound[i] for i in range(4))
    assert got[300] == "già così" and got[301] is None


def test_lexicon_scores_of_several_labels(spark):
    ch = spark.createDataFrame([(1, 0, "Good good bad x"), (1, 1, "x y"), (2, 0, "fine"), (3, 0, "...")], "id int, chunk_no int, t string")
    lex = spark.createDataFrame([("good", "pos"), ("fine", "pos"), ("bad", "neg"), ("good", "warm"), ("none", "rare")], "word string, label string")
    got = {(r.id, r.label): r.score for r in T.lexicon_scores(ch, "id", "t", lex).collect()}
    assert got == {(1, "pos"): 0.25, (1, "neg"): 0.125, (1, "warm"): 0.25, (1, "rare"): 0.0,
                   (2, "pos"): 1.0, (2, "neg"): 0.0, (2, "warm"): 0.0, (2, "rare"): 0.0}


def test_lexicon_of_any_size(spark):
    ch = spark.createDataFrame([(1, 0, "a b a"), (1, 1, "b c"), (2, 0, "..."), (3, 0, "c c d")], "id int, chunk_no int, t string")
    lex = spark.createDataFrame([("a", "x"), ("c", "x"), ("c", "y"), (None, "y")], "word string, label string")
    few, many = ({(r.id, r.label): r.score for r in T.lexicon_scores(ch, "id", "t", lex, small=n).collect()} for n in (100, 1))
    assert few == many and abs(few[1, "x"] - (2 / 3 + 1 / 2) / 2) < 1e-12 and few[3, "y"] == 2 / 3 and (2, "x") not in few


def test_text_models_share_their_words(spark):
    docs = spark.createDataFrame([(i, ("good fine " if i % 2 else "bad sad ") + ("loud" if i % 3 else "calm")) for i in range(60)], "id int, t string")
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 > 0)) for i in range(60)], "id int, p int, q int")
    models = T.train_text_model(docs, labels, "id", "t", ["p", "q"], 1 << 10)
    assert [s.uid for s in models["p"].stages[:-1]] == [s.uid for s in models["q"].stages[:-1]]
    got = T.model_scores(docs.withColumn("chunk_no", F.lit(0)), "id", "t", models).collect()
    assert all((r.p > 0.5) == (r.id % 2 == 1) and (r.q > 0.5) == (r.id % 3 > 0) for r in got) and len(got) == 60
    alone = T.model_scores(docs.withColumn("chunk_no", F.lit(0)), "id", "t", {"q": models["q"]}).collect()
    assert {r.id: r.q for r in alone} == {r.id: r.q for r in got}


def test_forest_grown_in_shares_is_the_same_forest():
    rng = np.random.default_rng(8)
    x, n = rng.integers(0, 8, (3, 500)), rng.integers(1, 4, 500).astype(float)
    s = n * x[0] + rng.normal(size=500)
    make = lambda share: R.random_forest(x, n, s, trees=20, depth=4, leaf=2, features=3, seed=1, n_bins=8, share=share)
    whole, at_once = make((0, 1)), R.AT_ONCE
    assert sum(len(make((i, 3)).feature) for i in range(3)) == 20  # one lot, two empty shares
    R.AT_ONCE = 3 * x.size
    try:
        parts = R.joined([make((i, 4)) for i in range(4)])
        assert np.array_equal(parts.value, make((0, 1)).value) and np.array_equal(parts.cut, whole.cut)
    finally:
        R.AT_ONCE = at_once


def test_bins_do_not_depend_on_the_size_of_the_table(spark):
    """More than 200,000 cells in a group: features had 16 bins, not 32."""
    rows = spark.range(260_000).select(F.lit("a").alias("sport"), F.lit(0).alias("fold"),
                                       *[F.rand(i).alias(f"x{i}") for i in range(5)], (F.col("id") % 3).alias("y"))
    for by in (["fold"], ["sport", "fold"]):
        table, edges = R.cells(rows, by, [f"x{i}" for i in range(5)], "y")
        assert [len(e) for e in edges] == [31] * 5
        assert table.count() > 200_000 and table.agg(F.sum("n")).first()[0] == 260_000


def test_fits_from_packed_cells_are_those_of_plain_arrays(spark):
    """Cells in several folds, more rows than one batch, a null group; folds left out one by one."""
    rng = np.random.default_rng(9)
    rows = [(str(g) if g else None, int(rng.integers(3)), *map(int, rng.integers(0, w, 3)), 1.0 + int(rng.integers(2)))
            for g, w, m in ((None, 4, 200), (1, 40, 24_000), (2, 3, 500)) for _ in range(m)]
    rows = {r[:5]: r for r in rows}.values()
    rows = [(*r, float(rng.integers(0, int(r[5]) + 1))) for r in rows]
    table = spark.createDataFrame(rows, "g string, fold int, b0 int, b1 int, b2 int, n double, s double").cache()

    def plain(keep):
        at = {}
        for r in rows:
            if keep(r):
                n, s = at.get(r[2:5], (0.0, 0.0))
                at[r[2:5]] = n + r[5], s + r[6]
        x = np.array(sorted(at)).reshape(-1, 3).T
        n, s = np.array([at[k] for k in sorted(at)]).reshape(-1, 2).T
        return x, n, s
    got = R.classifiers_by_group(table, "g", ["u", "v", "w"], 40, 3, 5, {"trees": 6, "depth": 3, "leaf": 2}, {"rounds": 4, "depth": 2, "rate": 0.1}).collect()
    assert {(r.g, r.model, r.kind) for r in got} == {(g, m, k) for g in (None, "1", "2") for m in (-1, 0, 1, 2) for k in ("rf", "gbt")}
    for r in got:
        x, n, s = plain(lambda a: a[0] == r.g and a[1] != r.model)  # noqa: B023
        if r.kind == "rf":
            f, how = R.random_forest(x, n, s, trees=6, depth=3, leaf=2, features=1, seed=5, n_bins=40, balanced=True), np.mean
        else:
            f, how = R.boosted(x, n, s, rounds=4, depth=2, rate=0.1, n_bins=40, logistic=True)[0], np.sum
        assert np.allclose([r.imp_u, r.imp_v, r.imp_w], R._shares(f.importance))
        if r.model < 0:
            assert r.auc is None
        else:
            x, n, s = plain(lambda a: a[0] == r.g and a[1] == r.model)  # noqa: B023
            assert abs(r.auc - R.auc_of_cells(R._score_blocks(f, x, how), n, s)) < 1e-9
    edges = [np.arange(39) + 0.0] * 3
    one = table.filter(F.col("g") == "1")
    fits = R.regressions_by_model(one, ["u", "v", "w"], edges, [-1, 1], {"rf": {"trees": 9, "depth": 4, "leaf": 2}, "gbt": {"rounds": 3, "depth": 2, "rate": 0.1}}, 7)
    for m in (-1, 1):
        x, n, s = plain(lambda a: a[0] == "1" and a[1] != m)  # noqa: B023
        f = R.random_forest(x, n, s, trees=9, depth=4, leaf=2, features=3, seed=7, n_bins=40)
        b, first = R.boosted(x, n, s, rounds=3, depth=2, rate=0.1, n_bins=40, logistic=False)
        assert np.allclose(fits[m, "rf"].forest.value, f.value) and np.array_equal(fits[m, "rf"].forest.cut, f.cut)
        assert np.allclose(fits[m, "gbt"].forest.value, b.value) and abs(fits[m, "gbt"].first - first) < 1e-12


def test_trees_do_not_depend_on_the_blocks(monkeypatch):
    """The same trees with all cells at once, block by block, and with the blocks in files."""
    rng = np.random.default_rng(10)
    x, n = rng.integers(0, 32, (5, 4000)), rng.integers(1, 4, 4000).astype(float)
    s, score = np.floor(n * rng.random(4000) + (x[0] > 20)).clip(0, n), rng.integers(0, 900, 4000) / 7

    def make():
        balanced = R.random_forest(x, n, s, trees=3, depth=5, leaf=5, features=2, seed=3, n_bins=32, balanced=True)
        plain = R.random_forest(x, n, s, trees=3, depth=6, leaf=2, features=5, seed=3, n_bins=32)
        share = R.random_forest(x, n, s, trees=3, depth=6, leaf=2, features=5, seed=3, n_bins=32, share=(1, 3))
        return balanced, plain, share, *(R.boosted(x, n, s, rounds=8, depth=3, rate=0.1, n_bins=32, logistic=g)[0] for g in (True, False))
    monkeypatch.setattr(R, "AT_ONCE", x.size)  # one tree a lot
    whole, auc = make(), R.auc_of_cells(score, n, s)
    monkeypatch.setattr(R, "AT_ONCE", 2500)
    assert len(R._of_arrays(x, n, s).blocks) == 8
    for held in (R.HELD, 100):
        monkeypatch.setattr(R, "HELD", held)
        assert (R._of_arrays(x, n, s).blocks.file is None) == (held > 100)
        for a, b in zip(whole, make()):
            assert np.array_equal(a.feature, b.feature) and np.array_equal(a.cut, b.cut)
            assert np.allclose(a.value, b.value) and np.allclose(a.importance, b.importance)
        parts = R.Blocks((score[i: i + 300], n[i: i + 300], s[i: i + 300]) for i in range(0, 4000, 300))
        monkeypatch.setattr(R, "AT_ONCE", 200)
        assert abs(R.auc_of_blocks(parts) - auc) < 1e-12
        monkeypatch.setattr(R, "AT_ONCE", 2500)


def test_declared_columns(spark):
    df = spark.createDataFrame([("7", "x")], "Id string, other string")
    got = readers.with_declared_columns(df, "id long, name string, n int", {"id": ["key", "Id"], "name": ["title", "other"]})
    assert got.dtypes == [("id", "bigint"), ("name", "string"), ("n", "int")] and tuple(got.first()) == (7, "x", None)


@pytest.mark.parametrize("rows", [[], [(1, 0.0), (2, 0.0)]])
def test_density_of_few_points(spark, rows):
    df = spark.createDataFrame(rows, "id long, x double").withColumn("y", F.col("x"))
    assert [r.cluster for r in T.density_clusters(df, "id", "x", "y", 0.1, 3).collect()] == [-1] * len(rows)
