"""Operator 12: document quality by a linear-chain conditional random field.

Each line with words is good or bad.  Its features are shares (capitals, signs,
digits, words without letters or with two signs at the end, repeated words),
length and shape, and the shares of the lines before and after it.  A line's
label depends on the label before it.  Forward-backward gives each line's
probability of being good; a document's quality is their mean, weighted by the
bytes of the lines' words, and a logistic curve fitted to the labels turns it
into the score.

Labels are of documents, so training goes in two rounds: first every line has
its document's label; then, in bad documents, the lines that the first model
holds for good are good, except that the worst line of each stays bad.  Each
step of the fit (L-BFGS) is one Spark job, in which each task sums likelihood
and gradient over its documents.  The training rows are a bounded sample, at
most ``max_per_class`` documents of each class in hash order.

Products of the chain's 2 x 2 matrices over all lines of a chunk are taken by
doubling; the first line of a document has equal rows, which cuts the chain.

Edge cases: a null or empty text, or one without words, has no lines and gets
the share of class 1 among the training rows; labels that are null, or whose
row has no document, are ignored; with no training row of either class that
share is the score of all documents (0 without rows); repeated rows get equal
scores; an empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..session import discard
from . import common as C
from . import words as W
from .registry import register

MAX_PER_CLASS = 4_000
CUT = 0.3
RIDGE = 0.1
STEPS = (20, 25)
#: Documents that one task of a training step takes.
DOCS_PER_TASK = 500

SHARES = 7
HINGES = (0.0, 0.1, 0.3)
OWN = SHARES * len(HINGES) + 5
FEATURES = OWN + 2 * SHARES + 2
#: Weights of the features for "good", and of the steps bad-good, good-bad, good-good.
SIZE = FEATURES + 3

_UPPER, _LETTER, _DIGIT = (np.zeros(256, np.int32) for _ in range(3))
_UPPER[65:91] = 1
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1
_DIGIT[48:58] = 1
_SIGN = np.zeros(256, np.int32)
_SIGN[33:127] = 1
_SIGN -= _SIGN * (_LETTER + _DIGIT)


def lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, weight, first): features of each line with words, the bytes of its
    words, and each text's first line (and the number of lines)."""
    w = W.split(texts)
    n = len(w.start)
    if not n:
        return np.zeros((0, FEATURES)), np.zeros(0), np.zeros(len(texts) + 1, np.int64)
    doc, size = w.doc, w.end - w.start
    breaks = np.concatenate([[0], np.cumsum(w.data == 0x0A)])[w.start]
    new = np.ones(n, bool)
    new[1:] = (doc[1:] != doc[:-1]) | (breaks[1:] != breaks[:-1])
    at = np.flatnonzero(new)
    line = np.cumsum(new) - 1
    total = lambda v: np.add.reduceat(v, at)

    def per_word(kind):
        run = np.concatenate([[0], np.cumsum(kind[w.data])])
        return run[w.end] - run[w.start]
    letters = per_word(_LETTER)
    h = w.hashes()
    again = np.zeros(n)
    again[1:] = (h[1:] == h[:-1]) & ~new[1:]
    order = np.lexsort((h, line))
    twice = np.zeros(n)
    twice[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (line[order[1:]] == line[order[:-1]])
    two_signs = (size > 2) & (_SIGN[w.data[w.end - 1]] & _SIGN[w.data[np.maximum(w.end - 2, 0)]]).astype(bool)
    count, weight = total(np.ones(n)), total(size).astype(float)
    share = np.stack([total(per_word(_UPPER)) / np.maximum(total(letters), 1), total(per_word(_SIGN)) / weight,
                      total(per_word(_DIGIT)) / weight, total((letters == 0).astype(float)) / count,
                      total(two_signs.astype(float)) / count, total(again) / count, total(twice) / count], 1)
    last = np.append(at[1:], n) - 1
    shape = np.stack([np.log1p(count) / 4, np.minimum(weight / count / 8, 4), _UPPER[w.data[w.start[at]]],
                      np.isin(w.data[w.end[last] - 1], [0x21, 0x2E, 0x3F]), np.ones(len(at))], 1)
    first = np.searchsorted(doc[at], np.arange(len(texts) + 1))
    begins = np.zeros(len(at), bool)
    begins[first[:-1][np.diff(first) > 0]] = True
    ends = np.append(begins[1:], True)
    before, after = np.zeros_like(share), np.zeros_like(share)
    before[1:], after[:-1] = share[:-1], share[1:]
    before[begins], after[ends] = 0, 0
    x = np.concatenate([*[np.maximum(share - t, 0) for t in HINGES], shape, before, after, begins[:, None], ends[:, None]], 1)
    return x, weight, first


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices, scaled to a greatest entry of 1."""
    out = a[:, :, :1] * b[:, :1, :] + a[:, :, 1:] * b[:, 1:, :]
    return out / out.max(axis=(1, 2), keepdims=True)


class Chain:
    """Forward-backward over the lines of a chunk of documents."""

    def __init__(self, x: np.ndarray, first: np.ndarray, params: np.ndarray):
        self.x, n = x, len(x)
        size = np.diff(first)
        self.begins = np.zeros(n, bool)
        self.begins[first[:-1][size > 0]] = True
        self.emit = np.stack([np.zeros(n), np.clip(x @ params[:FEATURES], -50, 50)], 1)
        self.step = np.array([[0.0, params[-3]], [params[-2], params[-1]]])
        score = self.emit[:, None, :] + np.where(self.begins[:, None, None], 0.0, self.step[None])
        self.top = score.max(axis=(1, 2))
        m = np.exp(score - self.top[:, None, None])
        back = np.concatenate([m[1:], np.ones((min(n, 1), 2, 2))])
        fore, reach = m.copy(), 1
        while reach < (size.max() if len(size) else 0):
            fore, back = fore.copy(), back.copy()
            fore[reach:] = _times(fore[:-reach].copy(), fore[reach:].copy())
            back[:-reach] = _times(back[:-reach].copy(), back[reach:].copy())
            reach *= 2
        self.m = m
        self.fore = fore[:, 0, :] / fore[:, 0, :].sum(axis=1, keepdims=True)
        self.back = back.sum(axis=2)
        p = self.fore * self.back
        self.good = p[:, 1] / p.sum(axis=1)

    def likelihood(self, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Log-likelihood of the labels, and its gradient."""
        inner = np.flatnonzero(~self.begins)
        before = np.ones((len(self.x), 2)) / 2  # the rows of a first line are equal
        before[inner] = self.fore[inner - 1]
        norm = (before[:, :, None] * self.m).sum(axis=(1, 2))
        value = self.emit[np.arange(len(y)), y].sum() - np.log(norm).sum() - self.top.sum()
        value += self.step[y[inner - 1], y[inner]].sum()
        pair = self.fore[inner - 1][:, :, None] * self.m[inner] * self.back[inner][:, None, :]
        pair = (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        seen = np.bincount(2 * y[inner - 1] + y[inner], minlength=4).reshape(2, 2)
        steps = (seen - pair).ravel()[1:]
        return float(value), np.concatenate([self.x.T @ (y - self.good), steps])


def _line_table(batches):
    """(label, x, y, weight) of documents (label, text): features of all lines,
    one after the other, and the document's label for each."""
    for b in batches:
        label = b.column("label").to_numpy()
        for row, texts in W.chunks(b.column("text")):
            x, weight, first = lines(texts)
            y = np.repeat(label[row: row + len(texts)], np.diff(first)).astype(np.int32)
            offsets = first.astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(label[row: row + len(texts)]),
                pa.ListArray.from_arrays(pa.array(offsets * FEATURES), pa.array(x.ravel())),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(y)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(weight))], names=["label", "x", "y", "weight"])


def _chains(b: pa.RecordBatch, params: np.ndarray):
    y = b.column("y")
    first = y.offsets.to_numpy().astype(np.int64)
    flat = b.column("x").flatten().to_numpy().reshape(-1, FEATURES)
    return Chain(flat, first - first[0], params), y.flatten().to_numpy().astype(np.int64), first - first[0]


def _gradient(params: np.ndarray):
    def of(batches):
        total = np.zeros(SIZE + 1)
        for b in batches:
            if len(b.column("y").flatten()):
                chain, y, _ = _chains(b, params)
                value, slope = chain.likelihood(y)
                total += np.concatenate([[value], slope])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])
    return of


def _relabel(params: np.ndarray):
    """In bad documents the lines that are held for good become good, but for
    the worst one."""
    def of(batches):
        for b in batches:
            if not len(b.column("y").flatten()):
                yield b
                continue
            chain, y, first = _chains(b, params)
            bad = np.repeat(b.column("label").to_numpy() == 0, np.diff(first))
            y = np.where(bad, (chain.good > 0.5).astype(np.int64), y)
            for d in np.flatnonzero((b.column("label").to_numpy() == 0) & (np.diff(first) > 0)):
                y[first[d] + int(np.argmin(chain.good[first[d]: first[d + 1]]))] = 0
            ys = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(y.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("x"), ys, b.column("weight")], names=b.schema.names)
    return of


def _quality(chain: Chain, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The weighted mean of each document (no lines: NaN)."""
    run = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[first])
    with np.errstate(invalid="ignore", divide="ignore"):
        return run(chain.good * weight) / run(weight)


def _train_quality(params: np.ndarray):
    def of(batches):
        for b in batches:
            if len(b.column("y").flatten()):
                chain, _, first = _chains(b, params)
                q = _quality(chain, b.column("weight").flatten().to_numpy(), first)
                ok = np.isfinite(q)
                yield pa.record_batch([pa.array(q[ok]), pa.array(b.column("label").to_numpy()[ok])], names=["q", "label"])
    return of


def minimise(f, x: np.ndarray, steps: int, memory: int = 8, close: float = 1e-4) -> np.ndarray:
    """L-BFGS with halved steps; ``f`` gives value and gradient."""
    value, slope = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, kept = slope.copy(), []
        for s, y in reversed(past):
            a = s @ way / (s @ y)
            way -= a * y
            kept.append(a)
        if past:
            s, y = past[-1]
            way *= (s @ y) / (y @ y)
        else:
            way /= max(1.0, np.linalg.norm(way))
        for (s, y), a in zip(past, reversed(kept)):
            way += s * (a - y @ way / (s @ y))
        gain, t = slope @ way, 1.0
        while t > 1e-6:
            new = x - t * way
            new_value, new_slope = f(new)
            if new_value <= value - 1e-4 * t * gain:
                break
            t /= 2
        else:
            return x
        s, y = new - x, new_slope - slope
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        done = value - new_value <= close * max(1.0, abs(new_value))
        x, value, slope = new, new_value, new_slope
        if done:
            break
    return x


def logistic_curve(q: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(a, b) of score = 1 / (1 + exp(-(a * logit(q) + b))), with a little
    doubt about each label so that separate classes have finite ones."""
    x = np.stack([_logit(q), np.ones(len(q))], 1)
    ones, zeros = (label == 1).sum(), (label == 0).sum()
    y = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    c = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -50, 50)))
        slope = x.T @ (p - y) + 1e-3 * c
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        c = c - step
        if np.abs(step).max() < 1e-8:
            break
    return float(c[0]), float(c[1])


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


@dataclass
class Model:
    """params None: no model, all documents score ``prior``."""
    params: np.ndarray | None
    curve: tuple[float, float] = (1.0, 0.0)
    prior: float = 0.0

    def of(self, texts: pa.Array) -> np.ndarray:
        """Scores of a chunk of texts without nulls."""
        x, weight, first = lines(texts)
        if not len(x):
            return np.full(len(texts), self.prior)
        q = _quality(Chain(x, first, self.params), weight, first)
        a, b = self.curve
        score = 1 / (1 + np.exp(-np.clip(a * _logit(np.nan_to_num(q)) + b, -50, 50)))
        return np.where(np.isfinite(q), score, self.prior)

    def score(self, docs: DataFrame, text_col: str = "text", name: str = "score") -> DataFrame:
        """``docs`` with a column ``name``, from 0 to 1; a column of that name is replaced."""
        if self.params is None:
            return docs.withColumn(name, F.lit(self.prior))
        at = docs.columns.index(text_col)
        rest = [f for f in docs.schema.fields if f.name != name]

        def of(batches):
            for b in batches:
                parts = [self.of(t) for _, t in W.chunks(b.column(at))]
                got = pa.array(np.concatenate(parts) if parts else np.zeros(0))
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), got], names=[*(f.name for f in rest), name])
        return docs.mapInArrow(of, T.StructType([*rest, T.StructField(name, T.DoubleType())]))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_per_class: int = MAX_PER_CLASS, seed: int = 11) -> Model:
    """``usable``: over the label rows, which of them may be learned from."""
    C.bound_batches(docs.sparkSession)
    known = labels.where(usable & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    sample = None
    for k in (0, 1):
        one = known.where(F.col(label_col) == k).select(F.col(id_col).alias("id"), F.lit(k).alias("label")).distinct()
        one = one.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(max_per_class)
        sample = one if sample is None else sample.unionByName(one)
    sample = C.cut_lineage(sample)  # at most 2 * max_per_class rows
    rows = docs.select(F.col(id_col).alias("id"), C.text_or_empty(text_col).alias("text")).join(F.broadcast(sample), "id")
    shape = "label int, x array<double>, y array<int>, weight array<double>"
    table = C.cut_lineage(rows.select("label", "text").repartition(1 + 2 * max_per_class // DOCS_PER_TASK).mapInArrow(_line_table, shape))
    count = {r["label"]: r["n"] for r in table.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = count.get(1, 0), count.get(0, 0)
    prior = ones / max(1, ones + zeros)
    if not ones or not zeros:
        return Model(None, prior=prior)

    def learn(data, start, steps):
        def loss(p):
            sums = sum(np.array(r["sums"]) for r in data.mapInArrow(_gradient(p), "sums array<double>").collect())
            return RIDGE / 2 * p @ p - sums[0], RIDGE * p - sums[1:]
        return minimise(loss, start, steps)
    params = learn(table, np.zeros(SIZE), STEPS[0])
    second = C.cut_lineage(table.mapInArrow(_relabel(params), shape))
    params = learn(second, params, STEPS[1])
    pairs = table.mapInArrow(_train_quality(params), "q double, label int").toArrow()  # two numbers a training document
    curve = logistic_curve(pairs.column("q").to_numpy(), pairs.column("label").to_numpy()) if len(pairs) else (1.0, 0.0)
    discard(sample, table, second)
    return Model(params, curve, prior)


def held_out(id_col: str) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % 5 == 0


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return fit(docs, labels, ~held_out("doc_id"), id_col, text_col).score(docs, text_col)


@register("op12_line_quality")
def op12_line_quality(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, C.table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= CUT).cast("int").alias("predicted"))
