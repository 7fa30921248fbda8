"""Histogram trees from counts of binned rows.

A histogram tree sees of a row only the bin of each feature and its target.
So Spark first counts the rows of each cell (group, fold, bins) with the sums
of the target: the scan and the shuffle of the whole table, with map-side
combining.  Features have the same bins and a fit reads all cells, at every size
of the table.  Spark sorts the cells and packs them into runs of some bytes a
cell.  The fits of all (group, model) pairs then run side by side, one task each,
and grow the trees of a forest level by level from histograms of (tree, node,
feature, bin).  A task reads its cells block by block, once a level, and keeps
what is beyond ``HELD`` bytes in a file of its own, so its memory does not grow
with the table; trees do not depend on where the blocks end.

A fitted forest is one node table; ``predict`` walks all trees in one pass over
the rows.
"""

from __future__ import annotations

import itertools
import os
import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

BINS = 32
#: Histogram entries (tree, cell, feature) that are added up at once.
AT_ONCE = 4_000_000
#: Bytes of a sequence of blocks that a task keeps in memory; the blocks are in a file beyond.
HELD = 32_000_000
#: Rows of a cells table in one packed run.
RUN = 64
#: Tasks that grow the trees of one forest of regression trees.
SHARES = 8


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = BINS, accuracy: int = 10_000) -> list[np.ndarray]:
    """Upper edges of each feature's bins but the last, at even ranks (one
    aggregation; the sketches are of bounded size)."""
    at = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), at, accuracy).alias(f"e{i}") for i, f in enumerate(features)]).first()
    return [np.unique(np.array(row[f"e{i}"] or [], float)) for i in range(len(features))]


def _bin(feature: str, edges: np.ndarray) -> F.Column:
    """Number of edges below the value."""
    x = F.col(feature).cast("double")
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>"), lambda e: x > e)).cast("int")


def cells(df: DataFrame, by: Sequence[str], features: Sequence[str], label: str, bins: int = BINS,
          most: int | None = None) -> tuple[DataFrame, list[np.ndarray]]:
    """(stored table of by, b0.., n, s, q; edges): rows of each cell, and the
    sums of the label and its square.  Only a caller that gives ``most`` gets
    half the bins, again and again, until no group has more cells; no query does."""
    while True:
        edges = bin_edges(df, features, bins)
        names = [f"b{i}" for i in range(len(features))]
        y = F.col(label).cast("double")
        d = df.select(*by, *[_bin(f, e).alias(b) for f, e, b in zip(features, edges, names)], y.alias("__y"))
        table = cut_lineage(d.groupBy(*by, *names).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("__y").alias("s"),
                                                       F.sum(F.col("__y") * F.col("__y")).alias("q")))
        if most is None or bins <= 2 or (table.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= most:
            return table, edges
        bins //= 2


class Blocks:
    """Tuples of arrays, to be read again and again in their order: in memory up
    to ``HELD`` bytes, in a file of the task's own beyond."""

    def __init__(self, parts: Iterable[tuple] = ()):
        self.held, self.file, self.bytes, self.count = [], None, 0, 0
        for x in parts:
            self.add(*x)

    def add(self, *arrays) -> None:
        self.count, self.bytes = self.count + 1, self.bytes + sum(a.nbytes for a in arrays)
        self.held.append(arrays)
        if self.bytes > HELD and self.count > 1:
            if self.file is None:
                self.file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
            for x in self.held:
                pickle.dump(x, self.file, pickle.HIGHEST_PROTOCOL)
            self.held = []

    def __len__(self) -> int:
        return self.count

    def __iter__(self) -> Iterator[tuple]:
        if self.file is None:
            yield from self.held
            return
        self.file.seek(0)
        for _ in range(self.count):
            yield pickle.load(self.file)


class Cells:
    """The cells of a fit in their order, in blocks of ``AT_ONCE`` entries (cell,
    feature): bins (features, cells), rows n, sum s of their target."""

    def __init__(self, features: int):
        self.features, self.blocks, self.parts = features, Blocks(), []
        self.size, self.waiting, self.n, self.s, self.ones = 0, 0, 0.0, 0.0, 0.0

    def add(self, bins: np.ndarray, n: np.ndarray, s: np.ndarray) -> None:
        if len(n):
            self.parts.append((bins, n, s))
            self.size, self.waiting = self.size + len(n), self.waiting + len(n)
            if self.waiting * self.features >= AT_ONCE:
                self.end()

    def end(self) -> Cells:
        if self.parts:
            bins, n, s = (np.concatenate(x, axis=-1) if len(x) > 1 else x[0] for x in zip(*self.parts))
            self.blocks.add(bins, n, s)
            self.n, self.s, self.parts, self.waiting = self.n + n.sum(), self.s + s.sum(), [], 0
        return self


def _of_arrays(bins: np.ndarray, n: np.ndarray, s: np.ndarray) -> Cells:
    out, step = Cells(len(bins)), max(1, -(-AT_ONCE // max(1, len(bins))))
    for i in range(0, len(n), step):
        out.add(bins[:, i: i + step], n[i: i + step], s[i: i + step])
    return out.end()


@dataclass
class Forest:
    """Trees as arrays over (tree, node); node i has the children 2i + 1 and
    2i + 2; feature -1 is a leaf; a row goes left if its bin is at most ``cut``."""
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    importance: np.ndarray

    def walk(self, bins: np.ndarray) -> np.ndarray:
        """The value of each (tree, row) for ``bins`` (features, rows)."""
        return np.take_along_axis(self.value, self.leaves(bins), 1)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))[:, None]
        row = np.arange(bins.shape[1])[None, :]
        at = np.zeros((len(self.feature), bins.shape[1]), np.int64)
        while True:
            f = self.feature[trees, at]
            inner = f >= 0
            if not inner.any():
                return at
            at = np.where(inner, 2 * at + 1 + (bins[np.maximum(f, 0), row] > self.cut[trees, at]), at)


def grow(bins: np.ndarray, count: np.ndarray, weight: np.ndarray, total: np.ndarray, depth: int, leaf: int,
         features: int, rng: np.random.Generator, n_bins: int, classes: tuple[float, float] | None = None) -> Forest:
    """``grow_blocks`` of one block.  ``bins`` (features, cells); for each (tree,
    cell) the rows ``count``, their ``weight`` and weighted target ``total``.
    With ``classes`` ``weight`` is not read."""
    sums = (count, total) if classes or weight is count else (count, weight, total)
    return grow_blocks(lambda: [(bins, sums)], 1, len(count), len(bins), depth, leaf, features, rng, n_bins, classes)


def grow_blocks(read: Callable[[], Iterable[tuple]], blocks: int, trees: int, p: int, depth: int, leaf: int, features: int,
                rng: np.random.Generator, n_bins: int, classes: tuple[float, float] | None = None) -> Forest:
    """All trees at once.  ``read`` gives the blocks anew for each level: (bins
    (features, cells), sums); sums are, for each (tree, cell), the rows, their
    weight unless it is the rows, and the weighted target.  A split is the one of
    greatest gain ``left^2 / w + right^2 / w`` (least squares, and Gini for a 0/1
    target) that leaves ``leaf`` rows on either side, of ``features`` features
    drawn for each node.  With ``classes``, the weights of ones and zeros, sums
    are the rows and the ones."""
    nodes = 2 ** (depth + 1) - 1
    out = Forest(np.full((trees, nodes), -1, np.int16), np.zeros((trees, nodes), np.int16), np.zeros((trees, nodes)), np.zeros((trees, p)))

    def three(x):
        """(rows, weight, weighted target) from the sums kept."""
        if classes:
            return x[0], classes[0] * x[1] + classes[1] * (x[0] - x[1]), classes[0] * x[1]
        return (x[0], x[0], x[1]) if len(x) == 2 else x
    small = np.int32 if blocks > 1 else np.int64
    state = split = f = c = None
    for d in range(depth + 1):
        width, base = 2**d, 2**d - 1
        node, left, kept = None, None, Blocks()
        for (bins, sums), was in zip(read(), state if d else itertools.repeat(None)):
            if d:  # to the children
                cell, at = was
                go = split[at]
                cell, at = cell[go], at[go]
                at = 2 * at + (bins[f[at], cell] > c[at])
            else:
                at, cell = np.nonzero(sums[0] > 0)
            kept.add(cell.astype(small, copy=False), at.astype(small, copy=False))
            entry = (at >> d) * bins.shape[1] + cell if trees > 1 else cell
            stats = [x.ravel()[entry] for x in sums]
            if node is None:
                node = [np.zeros(trees * width) for _ in stats]
                left = [np.zeros((trees * width, p, n_bins)) for _ in stats] if d < depth else []
            for a, x in zip(node, stats):
                a += np.bincount(at, x, trees * width)
            row = at.astype(np.int64, copy=False) * n_bins
            for i in range(p if d < depth and len(at) else 0):
                key = row + bins[i][cell]
                for a, x in zip(left, stats):
                    a[:, i] += np.bincount(key, x, trees * width * n_bins).reshape(-1, n_bins)
        state = kept
        n, w, s = three(node)
        here = n > 0
        value = np.divide(s, w, out=np.zeros_like(s), where=w > 0)
        t, k = np.divmod(np.flatnonzero(here), width)
        out.value[t, base + k] = value[here]
        if d == depth or not here.any():
            break
        left = three([a.cumsum(axis=2) for a in left])
        right = [a[:, None, None] - x for a, x in zip((n, w, s), left)]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[2] ** 2 / left[1] + right[2] ** 2 / right[1] - (s**2 / w)[:, None, None]
        gain[~((left[0] >= leaf - 1e-9) & (right[0] >= leaf - 1e-9))] = -np.inf
        if features < p:
            drawn = rng.random((trees * width, p))
            gain[drawn > np.partition(drawn, features - 1, axis=1)[:, features - 1: features]] = -np.inf
        flat = gain.reshape(trees * width, -1)
        best = flat.argmax(axis=1)
        most = flat[np.arange(len(flat)), best]
        split = here & np.isfinite(most) & (most > 1e-12 * np.maximum(1.0, np.abs(s)))
        f, c = np.divmod(best, n_bins)
        t, k = np.divmod(np.flatnonzero(split), width)
        out.feature[t, base + k], out.cut[t, base + k] = f[split], c[split]
        np.add.at(out.importance, (t, f[split]), most[split])
    return out


def _shares(importance: np.ndarray) -> np.ndarray:
    """Mean over the trees of each one's shares of gain, then as shares."""
    sums = importance.sum(axis=1, keepdims=True)
    mean = np.divide(importance, sums, out=np.zeros_like(importance), where=sums > 0).mean(axis=0)
    return mean / mean.sum() if mean.sum() else mean


def _least(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def random_forest(bins: np.ndarray, n: np.ndarray, s: np.ndarray, *args, **how) -> Forest:
    """``forest_of_cells`` of arrays."""
    return forest_of_cells(_of_arrays(bins, n, s), *args, **how)


def forest_of_cells(data: Cells, trees: int, depth: int, leaf: int, features: int, seed: int, n_bins: int,
                    balanced: bool = False, share: tuple[int, int] = (0, 1)) -> Forest:
    """Bagged trees: each tree draws every row a Poisson(1) number of times.  A
    0/1 target (``balanced``) is drawn class by class and weighted so that both
    classes have the same total.  ``share`` (i, n): the i-th of n even runs of
    the lots that an unbalanced forest is grown in, the draws before it passed
    over.  Cells of more than one block are grown tree by tree."""
    rng = np.random.default_rng(seed)
    lot = max(1, AT_ONCE // max(1, data.size * data.features)) if len(data.blocks) < 2 else 1
    firsts, parts = range(0, trees, lot), []
    mine = set(list(firsts)[len(firsts) * share[0] // share[1]: len(firsts) * (share[0] + 1) // share[1]])
    up, down = (data.n / (2 * x) if x else 0.0 for x in (data.s, data.n - data.s)) if balanced else (1.0, 1.0)
    for first in firsts:
        if not balanced and first > max(mine, default=-1):
            break
        size = min(lot, trees - first)
        draw = lambda of: Blocks((_least(rng.poisson(of(n, s), (size, len(n)))),) for _, n, s in data.blocks)  # noqa: B023, E731
        if balanced:
            ones = draw(lambda n, s: s)
            drawn = Blocks((a, _least(rng.poisson(n - s, (size, len(n))))) for (a,), (_, n, s) in zip(ones, data.blocks))
        elif first in mine:
            drawn = draw(lambda n, s: n)
        else:
            for _, n, _ in data.blocks:
                rng.poisson(n, (size, len(n)))
            continue

        def read(drawn=drawn):
            for (bins, n, s), x in zip(data.blocks, drawn):
                if balanced:
                    yield bins, (x[0].astype(float) + x[1], x[0].astype(float))
                else:
                    yield bins, (x[0].astype(float), x[0] * (s / n)[None, :])
        if len(data.blocks) == 1:
            once = list(read())
            read = lambda once=once: once
        parts.append(grow_blocks(read, len(data.blocks), size, data.features, depth, leaf, features, rng, n_bins, (up, down) if balanced else None))
    if not parts:  # more runs than lots
        none = np.zeros((0, 2 ** (depth + 1) - 1))
        return Forest(none.astype(np.int16), none.astype(np.int16), none, np.zeros((0, data.features)))
    return joined(parts)


def joined(parts: Sequence[Forest]) -> Forest:
    return Forest(*(np.concatenate([getattr(x, k) for x in parts]) for k in ("feature", "cut", "value", "importance")))


def boosted(bins: np.ndarray, n: np.ndarray, s: np.ndarray, *args, **how) -> tuple[Forest, float]:
    """``boosted_cells`` of arrays."""
    return boosted_cells(_of_arrays(bins, n, s), *args, **how)


def boosted_cells(data: Cells, rounds: int, depth: int, rate: float, n_bins: int, logistic: bool) -> tuple[Forest, float]:
    """(trees with values times ``rate``, first value): trees fitted to the
    residuals one after the other; ``logistic``: residuals of a 0/1 target,
    leaves by a Newton step."""
    rng, p, mean = np.random.default_rng(0), data.features, data.s / data.n
    first = float(np.log(mean / (1 - mean))) if logistic and 0 < mean < 1 else float(mean)
    scores = Blocks((np.full(len(n), first),) for _, n, _ in data.blocks)
    prob = (lambda x: 1 / (1 + np.exp(-x))) if logistic else (lambda x: x)
    parts = []
    for _ in range(rounds if not logistic or 0 < mean < 1 else 0):
        def read(scores=scores):
            for (bins, n, s), (x,) in zip(data.blocks, scores):
                yield bins, (n[None], (s - n * prob(x))[None])
        if len(data.blocks) == 1:
            once = list(read())
            read = lambda once=once: once
        tree = grow_blocks(read, len(data.blocks), 1, p, depth, 1, p, rng, n_bins)
        ends, up, down = Blocks(), 0.0, 0.0
        for (bins, n, s), (x,) in zip(data.blocks, scores):
            at = tree.leaves(bins)[0]
            if logistic:
                q = prob(x)
                up = up + np.bincount(at, s - n * q, tree.value.shape[1])
                down = down + np.bincount(at, n * q * (1 - q), tree.value.shape[1])
            ends.add(_least(at))
        if logistic:
            tree.value = np.divide(up, down, out=np.zeros_like(up), where=down > 1e-12)[None]
        tree.value = tree.value * rate
        scores = Blocks((x + tree.value[0][at],) for (x,), (at,) in zip(scores, ends))
        parts.append(tree)
    if not parts:
        parts = [Forest(np.full((1, 1), -1, np.int16), np.zeros((1, 1), np.int16), np.zeros((1, 1)), np.zeros((1, p)))]
    return joined(parts), first


def auc_of_cells(score: np.ndarray, n: np.ndarray, s: np.ndarray) -> float | None:
    """Area under the ROC curve of rows with a 0/1 target, equal scores one half."""
    return auc_of_blocks(Blocks([(score, n, s)]))


def auc_of_blocks(scored: Blocks) -> float | None:
    """The same of blocks (score, n, s): counts of the distinct scores, range
    after range of about ``AT_ONCE`` entries."""
    size, sample, counts = 0, [], Blocks()
    for score, n, s in scored:
        x, of = np.unique(score, return_inverse=True)
        counts.add(x, np.bincount(of, s, len(x)), np.bincount(of, n - s, len(x)))
        size += len(x)
        sample.append(x[:: max(1, len(x) // 1000)])
    ranges = -(-size // AT_ONCE)
    ends = np.unique(np.quantile(np.concatenate(sample), np.arange(1, ranges) / ranges)) if ranges > 1 else []
    ones = zeros = area = 0.0
    for lo, hi in zip([-np.inf, *ends], [*ends, np.inf]):
        some = [[a[np.searchsorted(x, lo, "right"): np.searchsorted(x, hi, "right")].copy() for a in (x, pos, neg)] for x, pos, neg in counts]
        x, pos, neg = (np.concatenate(a) for a in zip(*some))
        _, of = np.unique(x, return_inverse=True)
        pos, neg = np.bincount(of, pos), np.bincount(of, neg)
        area += (pos * (zeros + np.cumsum(neg) - neg / 2)).sum()
        ones, zeros = ones + pos.sum(), zeros + neg.sum()
    return float(area / (ones * zeros)) if ones and zeros else None


def _score_blocks(forest: Forest, bins: np.ndarray, how) -> np.ndarray:
    """``how`` (sum or mean) of the trees' values of each row, in blocks of rows."""
    step = max(1, AT_ONCE // max(1, len(forest.feature)))
    parts = [how(forest.walk(bins[:, i: i + step]), axis=0) for i in range(0, bins.shape[1], step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _record(p: int, n_bins: int) -> np.dtype:
    """A row of a cells table in a packed run; bytes of bins sort like the bins."""
    return np.dtype([("bins", "u1" if n_bins <= 256 else ">u2", (p,)), ("fold", "i4"), ("n", "f8"), ("s", "f8")])


def _starts(x: np.ndarray) -> np.ndarray:
    """Places where a row of ``x`` is not the one before it."""
    return np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)])) if len(x) else np.zeros(0, int)


def _packed(table: DataFrame, group: Sequence[str], p: int, n_bins: int) -> DataFrame:
    """(group, first, cells): the rows of a ``cells`` table by ``group`` and fold
    in runs of about ``RUN``, sorted by their bins; ``first``, the bins that a run
    begins with, sorts the runs.  A cell is in one run with all its folds."""
    names, record = [f"b{i}" for i in range(p)], _record(p, n_bins)

    def pack(batches):
        rest = None
        for d in itertools.chain(batches, [None]):
            last = d is None
            d = pd.concat([x for x in (rest, d) if x is not None], ignore_index=True) if rest is not None or not last else None
            if d is None or not len(d):
                continue
            of = np.column_stack([np.zeros(len(d), int), *[pd.factorize(d[g])[0] for g in group]])
            cell, lots = _starts(np.column_stack([of, d[names].to_numpy()])), _starts(of)
            ready = len(d) if last else cell[-1]  # the last cell may go on
            rest = None if last else d[ready:]
            rows = np.zeros(ready, record)
            rows["bins"] = d[names].to_numpy()[:ready]
            for c, null in (("fold", -2), ("n", 0), ("s", 0)):  # no fold: in no test
                rows[c] = d[c].fillna(null).to_numpy()[:ready]
            at, lots = [], set(lots.tolist())
            for x in cell[cell < ready].tolist():
                if x in lots or x - at[-1] >= RUN:
                    at.append(x)
            runs = [rows[i:j] for i, j in zip(at, [*at[1:], ready])]
            if runs:
                yield pd.DataFrame({**{g: d[g].iloc[at].tolist() for g in group}, "first": [r["bins"][0].tobytes() for r in runs], "cells": [r.tobytes() for r in runs]})
    fields = [*[table.schema[g] for g in group], T.StructField("first", T.BinaryType()), T.StructField("cells", T.BinaryType())]
    rows = table.select(*group, *names, "fold", "n", "s")
    return rows.repartitionByRange(*group, *names).sortWithinPartitions(*group, *names, "fold").mapInPandas(pack, T.StructType(fields))


def _fitted(packed: DataFrame, by: Sequence[str], fits: int, p: int, n_bins: int, fit: Callable[[tuple, Cells, Cells], list[tuple]],
            schema: T.StructType | str) -> DataFrame:
    """Rows of ``fit`` (key, cells of the other folds, cells of the fold) of each
    value of ``by`` in ``packed`` (by, first, cells); ``model``, one of ``by``, is
    the fold left out."""
    names, record, model = T.StructType.fromDDL(schema).names if isinstance(schema, str) else schema.names, _record(p, n_bins), list(by).index("model")

    def of(batches):
        key = train = test = None

        def put(runs: list[bytes]) -> None:
            rows = np.frombuffer(b"".join(runs), record)
            here = rows["fold"] == key[model]
            at = rows[here]
            test.add(np.ascontiguousarray(at["bins"].T), at["n"].copy(), at["s"].copy())
            at = rows[~here]
            if len(at):  # a cell's folds are next to each other
                starts = _starts(at["bins"])
                train.add(np.ascontiguousarray(at["bins"][starts].T), np.add.reduceat(at["n"], starts), np.add.reduceat(at["s"], starts))

        def done():
            return pd.DataFrame(fit(key, train.end(), test.end()), columns=names)
        for d in batches:
            keys = ([None if x != x else x for x in d[c].tolist()] for c in by)
            for k, runs in itertools.groupby(zip(zip(*keys), d["cells"]), lambda x: x[0]):
                if k != key:
                    if key is not None:
                        yield done()
                    key, train, test = k, Cells(p), Cells(p)
                while some := [x for _, x in itertools.islice(runs, 1000)]:
                    put(some)
        if key is not None:
            yield done()
    return _spread(packed, by, fits).sortWithinPartitions(*by, "first").mapInPandas(of, schema)


def classifiers_by_group(table: DataFrame, group: str, features: Sequence[str], n_bins: int, k: int, seed: int,
                         forest: dict, boost: dict) -> DataFrame:
    """For each group of a ``cells`` table (by group and fold): a balanced random
    forest and a boosted model on the rows outside each fold, with the AUC inside
    it, and on all rows (model -1) with the importances.  One row per (group,
    model, kind): auc, imp_<feature>."""
    p = len(features)
    fields = [T.StructField(group, table.schema[group].dataType), T.StructField("model", T.IntegerType()), T.StructField("kind", T.StringType()),
              T.StructField("auc", T.DoubleType()), *(T.StructField(f"imp_{f}", T.DoubleType()) for f in features)]

    def fit(key, train: Cells, test: Cells) -> list[tuple]:
        if not train.size:
            return []
        if key[2] == "rf":
            f, how = forest_of_cells(train, seed=seed, n_bins=n_bins, features=max(1, int(p**0.5)), balanced=True, **forest), np.mean
        else:
            f, how = boosted_cells(train, n_bins=n_bins, logistic=True, **boost)[0], np.sum
        auc = auc_of_blocks(Blocks((_score_blocks(f, bins, how), n, s) for bins, n, s in test.blocks)) if test.size else None
        return [(*key, auc, *map(float, _shares(f.importance)))]
    each = _packed(table, [group], p, n_bins).withColumn("model", F.explode(F.sequence(F.lit(-1), F.lit(k - 1)))) \
        .withColumn("kind", F.explode(F.array(F.lit("rf"), F.lit("gbt"))))
    return _fitted(each, [group, "model", "kind"], table.select(group).distinct().count() * (k + 1) * 2, p, n_bins, fit, T.StructType(fields))


def _spread(df: DataFrame, by: Sequence[str], fits: int) -> DataFrame:
    """A place for each fit: its rows are few and its work is much, so places
    chosen by size would put many fits in one task, one after the other."""
    return df.repartition(min(4 * max(fits, 1), 4000), *by)


@dataclass
class Regression:
    """A fitted ensemble: ``how`` is mean (forest) or sum (boosted, from ``first``)."""
    features: list[str]
    edges: list[np.ndarray]
    forest: Forest
    how: str = "mean"
    first: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        """(features, rows) of ``x`` (rows, features)."""
        return np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(self.edges)]) if len(self.edges) else x.T

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.first + _score_blocks(self.forest, self.bins(x), np.mean if self.how == "mean" else np.sum)

    def importance(self) -> list[tuple[str, float]]:
        return [(f, float(v)) for f, v in zip(self.features, _shares(self.forest.importance))]

    def node_table(self, spark) -> DataFrame:
        """(tree, node, feature, edge, value): a row goes left if its feature is at most ``edge``."""
        t, k = np.nonzero(np.ones_like(self.forest.feature))
        f, c = self.forest.feature[t, k], self.forest.cut[t, k]
        edge = [float(self.edges[a][b]) if a >= 0 and b < len(self.edges[a]) else None for a, b in zip(f.tolist(), c.tolist())]
        rows = list(zip(t.tolist(), k.tolist(), [self.features[a] if a >= 0 else None for a in f.tolist()], edge, self.forest.value[t, k].tolist()))
        return spark.createDataFrame(rows, "tree int, node int, feature string, edge double, value double")


def regressions_by_model(table: DataFrame, features: Sequence[str], edges: list[np.ndarray], models: Sequence[int],
                         kinds: dict[str, dict], seed: int = 42) -> dict[tuple[int, str], Regression]:
    """{(model, kind): fit} from a ``cells`` table by fold: model f leaves fold f
    out, model -1 takes all rows.  ``kinds``: {"rf": {trees, depth, leaf},
    "gbt": {rounds, depth, rate}}.  A forest is grown in ``SHARES`` tasks.  The
    fits come back as bounded arrays (trees x nodes)."""
    p, n_bins = len(features), max([len(e) for e in edges], default=0) + 1

    def fit(key, train: Cells, _) -> list[tuple]:
        model, kind, share = key
        if not train.size:
            return []
        if kind == "rf":
            made = forest_of_cells(train, features=p, seed=seed, n_bins=n_bins, share=(share, SHARES), **kinds[kind]), 0.0
        else:
            made = boosted_cells(train, n_bins=n_bins, logistic=False, **kinds[kind])
        return [(model, kind, share, pickle.dumps(made))]
    tasks = [(m, c, i) for m in models for c in kinds for i in range(SHARES if c == "rf" else 1)]
    pick = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(c).alias("kind"), F.lit(i).alias("share")) for m, c, i in tasks]))
    each = _packed(table, [], p, n_bins).withColumn("__m", pick).select("*", "__m.*").drop("__m")
    got = _fitted(each, ["model", "kind", "share"], len(tasks), p, n_bins, fit, "model int, kind string, share int, fit binary").collect()
    parts: dict = {}
    for r in sorted(got, key=lambda r: r["share"]):
        parts.setdefault((r["model"], r["kind"]), []).append(pickle.loads(bytes(r["fit"])))
    return {(m, c): Regression(list(features), edges, joined([f for f, _ in fits]), "mean" if c == "rf" else "sum", fits[0][1])
            for (m, c), fits in parts.items()}


def predict(df: DataFrame, fits: dict[str, Regression | dict[int, Regression]], fold: str | None = None,
            quantiles: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """``df`` with a column for each entry of ``fits`` (a fit, or one for each
    value of ``fold``), and for each entry of ``quantiles``, (fit, q), the
    quantile of the single trees' predictions: one pass, all trees at once."""
    quantiles = quantiles or {}
    any_fit = next(iter(fits.values()))
    features = (any_fit if isinstance(any_fit, Regression) else next(iter(any_fit.values()))).features
    new = [*fits, *quantiles]
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.DoubleType()) for c in new)])

    def of(batches):
        for d in batches:
            x = d[features].to_numpy(dtype=float)
            for name, fit in fits.items():
                if isinstance(fit, Regression):
                    d[name] = fit.of(x)
                else:
                    d[name] = np.nan
                    for value, one in fit.items():
                        here = (d[fold] == value).to_numpy()
                        d.loc[here, name] = one.of(x[here])
            for name, (fit, q) in quantiles.items():
                f = fits[fit]
                step = max(1, AT_ONCE // len(f.forest.feature))
                parts = [np.quantile(f.forest.walk(f.bins(x[i: i + step])), q, axis=0) for i in range(0, len(x), step)]
                d[name] = np.concatenate(parts) if parts else np.zeros(0)
            yield d[[f.name for f in schema.fields]]
    return df.mapInPandas(of, schema)
