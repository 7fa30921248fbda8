"""Operator 2: toxicity by gradient-boosted trees over dense features.

Features of a whole text: densities and maxima of a lexicon (words and word
beginnings, with log-odds learned from labels, and a short seed list), nearness
of second-person words to lexicon words, rates of capitals, punctuation and
obfuscated words.  Spark ML fits the trees; isotonic regression turns their
probability into a calibrated score.

Labels are used only for training rows, which fall into ``FOLDS`` folds by their
text.  A row's features use the lexicon of the other folds, and its probability
for the calibration comes from trees of the other folds, at every size; the
final lexicon and trees learn from all rows.  The training rows are a bounded sample, at most
``max_per_class`` of each class in hash order (the documented bound on what
is collected and broadcast); a text that occurs twice among them counts once.
Scoring reads every whole text and shuffles nothing.

Edge cases: a null or empty text has all-zero features and a score like any
other; labels that are null, or whose row has no document, are ignored; with
no training row of either class the score is the share of class 1 (0 without
rows); a fold whose others lack a class has the share of class 1 as
probability; repeated rows get equal scores; further columns pass through, but
for one of the score's name, which is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..session import discard
from . import common as C
from . import words as W
from .registry import register

MAX_PER_CLASS = 8_000
#: Beyond so many entries a lexicon asks for more texts of class 1 with each.
MAX_LEXICON = 20_000
LEAST_TEXTS = 3
CUT = 0.3
FOLDS = 3

# Insults, and second-person words of the corpus' languages.
SEED = ("idiot", "stupid", "moron", "loser", "trash", "pathetic", "scum", "worthless", "clown", "disgusting",
        "dumb", "hate", "shut", "ugly", "garbage", "imbecile", "kill")
SECOND_PERSON = ("you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "ihr", "euch", "tu", "toi", "te",
                 "ton", "ta", "vous", "votre", "vos", "ti", "tus", "usted", "ustedes", "vosotros")
STARTS = (4, 6)
NEAR = 5
FEATURES = 18


def _keys(w: W.Words):
    """Hashes of the words, and of their beginnings (None: too short), as
    (positions, hashes) a kind."""
    yield np.arange(len(w.start)), w.hashes()
    for i, k in enumerate(STARTS):
        at = np.flatnonzero(w.end - w.start > k)
        yield at, W.mix(w.spans(w.start[at], w.start[at] + k) + np.uint64(i + 1))


def _hash_list(words) -> np.ndarray:
    return np.sort(W.split(pa.array(list(words)), W.BARE).hashes())


def _in(sorted_keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(sorted_keys, h), len(sorted_keys) - 1)
    return sorted_keys[at] == h


@dataclass
class Lexicon:
    """Sorted key hashes with their log-odds."""
    key: np.ndarray
    odds: np.ndarray

    def look_up(self, h: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
        return np.where(self.key[at] == h, self.odds[at], 0.0)


def features(texts: pa.Array, lex: Lexicon) -> np.ndarray:
    """(texts, FEATURES) array of a chunk of texts without nulls."""
    w = W.split(texts, W.BARE)
    n, size = len(texts), np.diff(w.first)
    out = np.zeros((n, FEATURES))
    doc = w.doc
    per = np.maximum(size, 1)
    total = lambda mask: np.bincount(doc[mask], minlength=n)
    any_hit = np.zeros(len(w.start), bool)
    col = 0
    for at, h in _keys(w):
        odds = lex.look_up(h)
        hit = odds > 0
        any_hit[at[hit]] = True
        count = np.bincount(doc[at[hit]], minlength=n)
        most = np.zeros(n)
        np.maximum.at(most, doc[at[hit]], odds[hit])
        out[:, col], out[:, col + 1], out[:, col + 2] = np.log1p(count), count / per, most
        out[:, col + 3] = np.bincount(doc[at], odds, minlength=n) / per
        col += 4
    h = w.hashes()
    seeds = total(_in(_hash_list(SEED), h))
    out[:, 12] = np.log1p(seeds)
    # second-person words near lexicon words
    you, hits = np.flatnonzero(_in(_hash_list(SECOND_PERSON), h)), np.flatnonzero(any_hit)
    if len(you) and len(hits):
        right = np.minimum(np.searchsorted(you, hits), len(you) - 1)
        gap = np.full(len(hits), 10**6)
        for k in (right, np.maximum(right - 1, 0)):
            d = np.abs(you[k] - hits)
            gap = np.where((doc[you[k]] == doc[hits]) & (d < gap), d, gap)
        near = np.zeros(n)
        np.maximum.at(near, doc[hits], 1.0 / (1.0 + gap))
        out[:, 13] = np.where(near > 1e-5, near, 0.0)
    # rates over the bytes as they stand
    raw = W.split(texts)
    _, offsets, _ = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset: texts.offset + n + 1].astype(np.int64)
    at -= at[0]
    b = raw.data
    rate = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    letter = ((b | 32) >= 97) & ((b | 32) <= 122) | (b >= 128)
    letters = np.maximum(rate(letter), 1)
    out[:, 14] = rate((b >= 65) & (b <= 90)) / letters
    out[:, 15] = rate((b == 33) | (b == 63)) / per
    out[:, 16] = rate((b > 32) & (b < 127) & ~letter & ~((b >= 48) & (b <= 57))) / per
    odd = np.zeros(len(b), bool)  # a digit or sign between letters
    if len(b) > 2:
        odd[1:-1] = letter[:-2] & letter[2:] & ~letter[1:-1] & (b[1:-1] > 32) & ~np.isin(b[1:-1], [39, 44, 45, 46])
    out[:, 17] = rate(odd) / per
    return out


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), pa.array(x.ravel()))


def _with_features(lex: Lexicon, text: int):
    def of(batches):
        for b in batches:
            parts = [features(t, lex) for _, t in W.chunks(b.column(text))]
            x = np.concatenate(parts) if parts else np.zeros((0, FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(x)], names=[*b.schema.names, "_"])
    return of


def _out_of_fold(lexicons: dict[int, Lexicon]):
    """(toxic, part, x): features of training rows by the lexicon of the other folds."""
    def of(batches):
        for b in batches:
            for f in np.unique(b.column("part").to_numpy()).tolist():
                own = b.filter(pa.array(b.column("part").to_numpy() == f))
                x = np.concatenate([features(t, lexicons[f]) for _, t in W.chunks(own.column("text"))])
                yield pa.RecordBatch.from_arrays([own.column("toxic"), own.column("part"), _lists(x)], names=["toxic", "part", "x"])
    return of


def _key_counts(batches):
    """(key, part, texts of class 1, of class 0), combined for each batch."""
    for b in batches:
        toxic = b.column("toxic").to_numpy(zero_copy_only=False)
        part = b.column("part").to_numpy(zero_copy_only=False).astype(np.int64)
        keys, rows = [], []
        for row, texts in W.chunks(b.column("text")):
            w = W.split(texts, W.BARE)
            for at, h in _keys(w):
                pair = np.unique(np.stack([w.doc[at].astype(np.uint64), h], 1), axis=0) if len(at) else np.zeros((0, 2), np.uint64)
                keys.append(pair[:, 1])
                rows.append(row + pair[:, 0].astype(np.int64))
        if keys:
            key, row = np.concatenate(keys), np.concatenate(rows)
            for f in np.unique(part).tolist():
                own = part[row] == f
                name, of = np.unique(key[own], return_inverse=True)
                one = np.bincount(of, toxic[row[own]], minlength=len(name)).astype(np.int64)
                every = np.bincount(of, minlength=len(name)).astype(np.int64)
                yield pa.record_batch([name.view(np.int64), np.full(len(name), f), one, every - one], names=["key", "part", "ones", "zeros"])


def learn_lexicons(rows: DataFrame, count: dict[tuple[int, int], int]) -> dict[int, Lexicon]:
    """{fold: lexicon of the rows (text, toxic, part) outside it; -1: of all}.
    Entries are keys with smoothed log-odds of class 1 above 2 in at least
    LEAST_TEXTS texts of class 1, in more if there are over MAX_LEXICON such
    keys.  ``count``: texts by (part, class)."""
    models = [-1, *range(FOLDS)]
    per = (rows.select("text", "toxic", "part").mapInArrow(_key_counts, "key long, part long, ones long, zeros long")
           .groupBy("key").agg(*[F.sum(F.when(F.col("part") == f, F.col(c))).alias(f"{c}{f}") for f in range(FOLDS) for c in ("ones", "zeros")]))
    rest = lambda c, m: sum((F.coalesce(f"{c}{f}", F.lit(0)) for f in range(FOLDS) if f != m), F.lit(0))
    sides = [F.struct(F.lit(m).alias("m"), rest("ones", m).alias("o"), rest("zeros", m).alias("z"),
                      *[F.lit(sum(n for (p, t), n in count.items() if p != m and t == k) + 1.0).alias(f"n{k}") for k in (1, 0)]) for m in models]
    odds = F.log((F.col("o") + 0.5) / F.col("n1")) - F.log((F.col("z") + 0.5) / F.col("n0"))
    good = per.select("key", F.explode(F.array(*sides)).alias("s")).select("key", "s.*").where(F.col("o") >= LEAST_TEXTS)
    good = C.cut_lineage(good.withColumn("odds", odds).where("odds > 2").select("m", "key", "o", "odds"))
    found: dict[int, list] = {m: [] for m in models}
    for r in good.groupBy("m", "o").count().collect():  # at most folds x texts of class 1
        found[r["m"]].append((r["o"], r["count"]))
    least = {}
    for m, hist in found.items():
        size, least[m] = 0, LEAST_TEXTS
        for o, n in sorted(hist, reverse=True):
            size += n
            if size > MAX_LEXICON:
                least[m] = o + 1
                break
    keep = F.array(*[F.lit(least[m]) for m in models])
    entries = {m: [] for m in models}
    for r in good.where(F.col("o") >= F.element_at(keep, F.col("m") + 2)).select("m", "key", "odds").collect():
        entries[r["m"]].append((r["key"], r["odds"]))
    discard(good)
    out = {}
    for m, rows_ in entries.items():
        key = np.array([r[0] for r in rows_], np.int64).view(np.uint64)
        order = np.argsort(key)
        out[m] = Lexicon(key[order], np.array([r[1] for r in rows_], float)[order])
    return out


@dataclass
class Model:
    lexicon: Lexicon
    trees: object = None
    scale: object = None
    prior: float = 0.0

    def score(self, docs: DataFrame, text_col: str = "text", name: str = "score") -> DataFrame:
        """``docs`` with a column ``name``, from 0 to 1."""
        if self.trees is None:
            return docs.withColumn(name, F.lit(self.prior))
        docs = docs.drop(name)
        free = lambda x: x if x not in docs.columns else free(x + "_")
        x, v, raw, p, out = (free(k) for k in ("_x", "_features", "_raw", "_p", "_fit"))
        schema = T.StructType([*docs.schema.fields, T.StructField(x, T.ArrayType(T.DoubleType()))])
        rows = docs.mapInArrow(_with_features(self.lexicon, docs.columns.index(text_col)), schema)
        rows = rows.withColumn(v, array_to_vector(x)).drop(x)
        trees = self.trees.setFeaturesCol(v).setRawPredictionCol(raw).setProbabilityCol(p).setPredictionCol(out)
        rows = trees.transform(rows).withColumn(p, vector_to_array(p)[1]).drop(v, raw, out)
        scale = self.scale.setFeaturesCol(p).setPredictionCol(out)
        return scale.transform(rows).withColumn(p, F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))).drop(out).withColumnRenamed(p, name)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_per_class: int = MAX_PER_CLASS, seed: int = 7) -> Model:
    """``usable``: over the label rows, which of them may be learned from."""
    order = F.xxhash64(F.lit(seed), id_col)
    known = labels.where(usable & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    sample = None
    for k in (0, 1):
        one = known.where(F.col(label_col) == k).select(F.col(id_col).alias("id"), F.lit(k).alias("toxic"), order.alias("o"))
        one = one.dropDuplicates(["id"]).orderBy("o", "id").limit(max_per_class).drop("o")
        sample = one if sample is None else sample.unionByName(one)
    sample = C.cut_lineage(sample)  # at most 2 * max_per_class rows
    rows = docs.select(F.col(id_col).alias("id"), C.text_or_empty(text_col).alias("text"))
    rows = C.cut_lineage(rows.join(F.broadcast(sample), "id").groupBy(F.sha2("text", 256).alias("k")).agg(
        F.min_by(F.struct("text", "toxic"), "id").alias("r")).select("r.text", "r.toxic",
        F.pmod(F.conv(F.substring("k", 1, 8), 16, 10).cast("long"), F.lit(FOLDS)).alias("part")))
    count = {(r["part"], r["toxic"]): r["n"] for r in rows.groupBy("part", "toxic").agg(F.count("*").alias("n")).collect()}
    ones, zeros = (sum(n for (_, t), n in count.items() if t == k) for k in (1, 0))
    prior = ones / max(1, ones + zeros)
    if not ones or not zeros:
        return Model(Lexicon(np.zeros(0, np.uint64), np.zeros(0)), prior=prior)
    lexicons = learn_lexicons(rows, count)
    table = C.cut_lineage(rows.mapInArrow(_out_of_fold(lexicons), "toxic int, part long, x array<double>"))
    table = table.withColumn("features", array_to_vector("x")).withColumn("label", F.col("toxic").cast("double")).drop("x")
    learner = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.3, seed=seed)

    def held(f):
        own, others = table.where(F.col("part") == f), table.where(F.col("part") != f)
        if not all(sum(n for (p, t), n in count.items() if p != f and t == k) for k in (0, 1)):
            return own.select("label", F.lit(prior).alias("p"))
        return learner.fit(others).transform(own).select("label", vector_to_array("probability")[1].alias("p"))
    trees, scored = learner.fit(table), held(0)  # one after the other: each fit is many small jobs of the driver
    for f in range(1, FOLDS):
        scored = scored.unionByName(held(f))
    scale = IsotonicRegression(featuresCol="p", labelCol="label").fit(C.cut_lineage(scored))
    return Model(lexicons[-1], trees, scale, prior)


def held_out(id_col: str) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % 4 == 2


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return fit(docs, labels, ~held_out("doc_id"), id_col, text_col).score(docs, text_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that score below ``cut``, all columns kept."""
    name = "_score"
    while name in docs.columns:
        name += "_"
    return fit(docs, labels, ~held_out("doc_id")).score(docs, name=name).where(F.col(name) < cut).drop(name)


@register("op2_toxicity_gbt")
def op2_toxicity_gbt(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, C.table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= CUT).cast("int").alias("predicted"))
