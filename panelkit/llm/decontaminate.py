"""Operator 10: benchmark decontamination with a BM25 index of test items.

The index is over the test items: word -> items with a BM25 weight, divided by
the item's weight against itself, so that a score is the share of the item
that a passage has (weighted by rarity).  Every training passage (windows of
words that overlap by half, long enough to hold any item whole) is a query,
and block-max WAND returns all items at or above the threshold:

* the upper bounds of a passage's words, then their maxima per block of items,
  rule out most passages for a whole Arrow batch at once;
* each passage that is left runs the WAND loop: pivot by list bounds, block
  maxima of the pivot's block, then scoring or skipping.

A retrieved item counts as leaked when its question and its answer (the last
sentence) both overlap the passage in word trigrams.

The items are indexed in blocks of about ``items_per_index`` items or
``bytes_per_index`` bytes, one pass over the documents each, so that the
broadcast index is bounded whatever the size of the benchmark.  Document
frequencies, the number of items, their mean length and the passage length are
those of all items, whatever the blocks.  With several blocks, each one's hits
are a table before the next index is built.  Documents are not shuffled, but
for ``drop_leaked`` with several blocks.

Edge cases: null or empty texts and items without words have no hits; a null
id is an id like others; repeated rows and repeated items each give their own
result; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C
from . import words as W
from .registry import register

K1, B = 1.2, 0.75
BLOCK = 4
THRESHOLD = 0.6
OVERLAP = 0.6
ITEMS_PER_INDEX = 20_000
BYTES_PER_INDEX = 1 << 26
#: Passages times blocks that are summed at once.
CELLS = 1 << 21


def _words(texts: list[str]) -> list[np.ndarray]:
    w = W.split(pa.array(texts, pa.string()), W.BARE)
    h = w.hashes()
    return [h[a:b] for a, b in zip(w.first[:-1], w.first[1:])]


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer; one sentence is all question."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text.strip()) if p.strip()]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def _grams(h: np.ndarray) -> tuple[np.ndarray, int]:
    """Distinct word trigrams (a shorter text is one gram), and their length."""
    k = min(3, len(h))
    return (np.unique(W.window_hashes(h, k)) if k else np.zeros(0, np.uint64)), k


@dataclass
class Index:
    """Postings of word ``t``: item[at[t]:at[t+1]] with weight; the same for
    blocks of items in block_at, block and block_max."""
    ids: list
    vocab: np.ndarray
    at: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    bound: np.ndarray
    block_at: np.ndarray
    block: np.ndarray
    block_max: np.ndarray
    parts: list
    passage: int

    def __post_init__(self):
        self.items = self.item.tolist()  # the loop of wand() reads single entries
        self.blocks, self.maxima, self.bounds = self.block.tolist(), self.block_max.tolist(), self.bound.tolist()


@dataclass
class Totals:
    """Of all items: their number, mean and greatest length, and how many hold
    each word of one block (``vocab``, sorted)."""
    items: int
    mean: float
    longest: int
    vocab: np.ndarray
    df: np.ndarray


def build_index(items: list[tuple], totals: Totals | None = None) -> Index:
    """Index of (item_id, text) rows; without ``totals`` these are all items."""
    texts = [t or "" for _, t in items]
    words = _words(texts)
    length = np.array([len(w) for w in words] or [0], float)
    mean = max(totals.mean if totals else length.mean(), 1.0)
    doc = np.repeat(np.arange(len(words)), length.astype(int)[: len(words)])
    allw = np.concatenate(words) if words else np.zeros(0, np.uint64)
    vocab, term = np.unique(allw, return_inverse=True)
    pair, tf = np.unique(term.astype(np.int64) * max(len(words), 1) + doc, return_counts=True)
    t, d = pair // max(len(words), 1), pair % max(len(words), 1)
    df = totals.df[np.searchsorted(totals.vocab, vocab)] if totals else np.bincount(t, minlength=len(vocab))
    idf = np.log1p(((totals.items if totals else len(words)) - df + 0.5) / (df + 0.5))
    weight = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[d] / mean))
    weight /= np.bincount(d, weight, minlength=len(words))[d]
    at = np.searchsorted(t, np.arange(len(vocab) + 1))
    begin = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (d[1:] // BLOCK != d[:-1] // BLOCK)]) if len(t) else np.zeros(0, int)
    block_max = np.maximum.reduceat(weight, begin) if len(t) else weight
    bound = np.maximum.reduceat(weight, at[:-1]) if len(t) else weight
    parts = [tuple(_grams(h) for h in _words(list(question_and_answer(x)))) for x in texts]
    return Index([i for i, _ in items], vocab, at, d, weight, bound,
                 np.searchsorted(t[begin], np.arange(len(vocab) + 1)), d[begin] // BLOCK, block_max, parts,
                 2 * max(64, totals.longest if totals else int(length.max())))


def wand(ix: Index, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """All items whose score over the distinct ``terms`` reaches the threshold."""
    lists = []  # [current item, position, end, bound, block position, block end]
    for t in terms.tolist():
        a = int(ix.at[t])
        lists.append([ix.items[a], a, int(ix.at[t + 1]), ix.bounds[t], int(ix.block_at[t]), int(ix.block_at[t + 1])])
    items, blocks, maxima, found = ix.items, ix.blocks, ix.maxima, []
    threshold -= 1e-9

    def forward(some, to):
        """Move the lists to the first item from ``to`` on; True if one ended."""
        ended = False
        for x in some:
            if x[0] < to:
                p = x[1] = bisect_left(items, to, x[1], x[2])
                if p < x[2]:
                    x[0] = items[p]
                else:
                    x[0], ended = -1, True
        return ended

    while lists:
        lists.sort()
        total, pivot = 0.0, -1
        for k, x in enumerate(lists):
            total += x[3]
            if total >= threshold:
                pivot = k
                break
        if pivot < 0:
            break
        item = lists[pivot][0]
        while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
            pivot += 1
        upto, block, most = lists[: pivot + 1], item // BLOCK, 0.0
        for x in upto:  # block maxima at the pivot
            p, end = x[4], x[5]
            while p < end and blocks[p] < block:
                p += 1
            x[4] = p
            if p < end and blocks[p] == block:
                most += maxima[p]
        if most < threshold:  # nothing up to the end of the block, or the next list's item
            to = (block + 1) * BLOCK
            if pivot + 1 < len(lists):
                to = min(to, lists[pivot + 1][0])
            ended = forward(upto, max(to, item + 1))
        elif lists[0][0] == item:
            score = sum(float(ix.weight[x[1]]) for x in upto)
            if score >= threshold:
                found.append((item, score))
            ended = forward(upto, item + 1)
        else:
            ended = forward(upto, item)
        if ended:
            lists = [x for x in lists if x[0] >= 0]
    return found


def _expand(at: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of CSR lists of the terms: (which term row, position)."""
    size = at[terms + 1] - at[terms]
    row = np.repeat(np.arange(len(terms)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at[terms], size)


def _search(ix: Index, w: W.Words, threshold: float):
    """(text, first word, end, item, score) for each passage of a chunk and item found."""
    half, h = ix.passage // 2, w.hashes()
    term = np.minimum(np.searchsorted(ix.vocab, h), len(ix.vocab) - 1)
    at = np.flatnonzero(ix.vocab[term] == h)
    if not len(at):
        return
    doc, term = w.doc[at], term[at]
    size = np.diff(w.first)
    count = np.maximum(1, -(-size // half) - 1)  # passages of each text
    begin = np.cumsum(count) - count
    place = (at - w.first[doc]) // half
    # a word stands in the passages that begin at its half and at the half before
    one, two = np.minimum(place, count[doc] - 1), np.maximum(place - 1, 0)
    two = np.minimum(two, count[doc] - 1)
    key = np.unique(np.concatenate([begin[doc] + one, begin[doc] + two]).astype(np.int64) * len(ix.vocab) + np.tile(term, 2))
    passage, term = key // len(ix.vocab), key % len(ix.vocab)
    live = np.bincount(passage, ix.bound[term]) >= threshold - 1e-9
    keep = live[passage]
    passage, term = passage[keep], term[keep]
    n_blocks = int(ix.block.max()) + 1
    cell, lo = np.unique(passage, return_index=True)
    hi = np.append(lo[1:], len(passage))
    hot = np.zeros(len(cell), bool)
    step = max(1, CELLS // n_blocks)
    for c in range(0, len(cell), step):  # block maxima of so many passages at once
        part = slice(lo[c], hi[min(c + step, len(cell)) - 1])
        row, p = _expand(ix.block_at, term[part])
        mine = np.searchsorted(cell[c: c + step], passage[part])
        most = np.bincount(mine[row] * n_blocks + ix.block[p], ix.block_max[p], minlength=len(cell[c: c + step]) * n_blocks)
        hot[c: c + step] = (most.reshape(-1, n_blocks) >= threshold - 1e-9).any(axis=1)
    for c in np.flatnonzero(hot):
        d = int(np.searchsorted(begin, cell[c], "right")) - 1
        a = int(w.first[d] + (cell[c] - begin[d]) * half)
        for item, score in wand(ix, term[lo[c]: hi[c]], threshold):
            yield d, a, min(a + ix.passage, int(w.first[d + 1])), item, score, h


def _overlap(part: np.ndarray, words: np.ndarray, k: int) -> float:
    return float(np.isin(part, W.window_hashes(words, k)).mean()) if len(part) else 1.0


def _best(ix: Index, texts: pa.Array, threshold: float) -> dict:
    """(row, item) -> best passage's (score, question overlap, answer overlap)."""
    best: dict = {}
    for row, part in W.chunks(texts) if len(ix.vocab) else ():
        for d, a, e, item, score, h in _search(ix, W.split(part, W.BARE), threshold):
            q, z = (_overlap(grams, h[a:e], k) for grams, k in ix.parts[item])
            key = (row + d, item)
            best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, q, z), key=lambda x: (min(x[1:]), x))
    return best


def _hits(ix: Index, threshold: float):
    def of(batches):
        for b in batches:
            best = _best(ix, b.column(1), threshold)
            rows = sorted(best)
            yield pa.record_batch([
                b.column(0).take(pa.array([r for r, _ in rows], pa.int64())), pa.array([ix.ids[i] for _, i in rows], pa.int64()),
                *[pa.array([best[k][j] for k in rows], pa.float64()) for j in range(3)]],
                names=["id", "item_id", "score", "question_overlap", "answer_overlap"])
    return of


def _clean(ix: Index, threshold: float, text: int):
    def of(batches):
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            keep[[r for (r, _), (_, q, z) in _best(ix, b.column(text), threshold).items() if min(q, z) >= OVERLAP]] = False
            yield b.filter(pa.array(keep))
    return of


def _item_words(batches):
    """The length and the distinct words of each item."""
    for b in batches:
        words = _words(b.column("text").to_pylist())
        yield pa.record_batch([b.column("part"), pa.array([len(w) for w in words], pa.int64()),
                               pa.array([np.unique(w).view(np.int64) for w in words], pa.list_(pa.int64()))],
                              names=["part", "n", "words"])


def _indexes(benchmark: DataFrame, item_col: str, item_text: str, items_per_index: int, bytes_per_index: int):
    """(number of indexes, the indexes one after the other) over parts of the
    items, each of a bounded number and size."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), C.text_or_empty(item_text).alias("text"))
    count, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(1, -(-count // items_per_index), -(-(size or 0) // bytes_per_index))
    order = lambda part: sorted(map(tuple, part), key=lambda r: (r[0] is None, r[0] or 0, r[1]))

    def many():
        # by row, not by content: copies of an item spread like others
        held = C.cut_lineage(items.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts))))
        lengths = C.cut_lineage(held.mapInArrow(_item_words, "part long, n long, words array<long>"))
        total, longest = lengths.agg(F.sum("n"), F.max("n")).first()
        word = lengths.select("part", F.explode("words").alias("word"))
        df = C.cut_lineage(word.groupBy("word").agg(F.count("*").alias("df")))
        for k in range(parts):
            part = order(held.where(F.col("part") == k).select("item_id", "text").collect())
            mine = word.where(F.col("part") == k).select("word").distinct().join(df, "word").toArrow()
            vocab = mine.column("word").to_numpy().view(np.uint64)
            by = np.argsort(vocab)
            yield build_index(part, Totals(count, total / count, longest, vocab[by], mine.column("df").to_numpy()[by]))

    return parts, iter([build_index(order(items.collect()))]) if parts == 1 else many()


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD,
                   items_per_index: int = ITEMS_PER_INDEX, bytes_per_index: int = BYTES_PER_INDEX) -> DataFrame:
    """One row per document and retrieved item (long id): the best passage's
    score, question_overlap and answer_overlap, and whether it is ``leaked``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {kind}, item_id long, score double, question_overlap double, answer_overlap double"
    parts, indexes = _indexes(benchmark, item_col, item_text, items_per_index, bytes_per_index)
    hits = lambda: rows.mapInArrow(_hits(next(indexes), threshold), shape)
    # of several, each is done with before the next one is built
    found = [hits()] if parts == 1 else [C.cut_lineage(hits()) for _ in range(parts)]
    return (reduce(DataFrame.unionByName, found).withColumnRenamed("id", id_col)
            .withColumn("leaked", (F.col("question_overlap") >= OVERLAP) & (F.col("answer_overlap") >= OVERLAP)))


def drop_leaked(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                item_text: str = "text", threshold: float = THRESHOLD, items_per_index: int = ITEMS_PER_INDEX,
                bytes_per_index: int = BYTES_PER_INDEX) -> DataFrame:
    """The rows of ``docs`` without a leaked item, all columns kept."""
    parts, indexes = _indexes(benchmark, item_col, item_text, items_per_index, bytes_per_index)
    if parts == 1:
        return docs.mapInArrow(_clean(next(indexes), threshold, docs.columns.index(text_col)), docs.schema)
    free = lambda x: x if x not in docs.columns else free(x + "_")
    row = free("_row")
    rows = C.cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    hits = benchmark_hits(rows, benchmark, row, text_col, item_col, item_text, threshold, items_per_index, bytes_per_index)
    return rows.join(hits.where("leaked").select(row).distinct(), row, "left_anti").select(*docs.columns)


@register("op10_benchmark_bm25")
def op10_benchmark_bm25(spark, sf_dir):
    """Leaked (document, item) pairs of all documents."""
    docs = C.table(spark, sf_dir, "documents")
    return benchmark_hits(docs, C.table(spark, sf_dir, "benchmark")).where("leaked").drop("leaked")

