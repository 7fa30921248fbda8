"""Operator 11: phrase collocation mining by prefix-free parsing.

1. Texts are cut into pieces and words.  Where the hash of ``OVERLAP`` words
   falls on a trigger, a chunk ends and the next one begins; a chunk reaches
   over those words, so chunks overlap and depend on content alone: copies of a
   passage give the same chunks wherever they stand.
2. The distinct chunks are the dictionary; the parse is kept as the number of
   times that each of them occurs.
3. n-grams are counted inside distinct chunks, weighted by that number.  A
   chunk counts those that begin in its own part, before the next chunk, which
   reaches far enough for phrases of ``OVERLAP + 1`` words: each occurrence
   counts once.
4. Rare phrases are kept out level by level: a phrase that is frequent has
   frequent parts.  Hashes are counted (an equal hash can only raise a count)
   and the frequent ones go to the next level as a bitmap of bounded size; the
   words themselves are counted last and alone decide.

Everything is per language (null: ``und``).  Scores are exact: floor of
``1000 * a * n / (l * r)`` in whole decimals.

Edge cases: null and empty texts, and texts of separators alone, have no words;
a language without frequent phrases has no rows; repeated rows count as often
as they stand; ties go by count, then by the phrase's bytes; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import discard
from . import common as C
from . import words as W
from .jaccard_join import _bitmap, _in_bitmap
from .registry import register

LONGEST = 5
LEAST = 100
BEST = 2_000
#: Words that chunks share with the next one, and one window in how many is a trigger.
OVERLAP = LONGEST - 1
TRIGGER = 32

_BREAK = 0x0A
#: Lower case, piece separators as line breaks, tabs as blanks.
FOLD = W.LOWER.copy()
FOLD[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = _BREAK
FOLD[0x09] = 0x20


def _lang_seed(names: list[str]) -> np.ndarray:
    """A 64-bit number for each language name."""
    return np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in names], np.uint64)


def _codes(langs: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct languages of a batch, and each row's number among them."""
    d = langs.dictionary_encode()
    return d.dictionary.to_pylist(), d.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _text_bytes(w: W.Words, first: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The words from ``first`` up to ``stop`` of each run, joined by one blank."""
    count = stop - first
    word = W.ranges(first, count)
    size = (w.end - w.start)[word]
    last = np.cumsum(count) - 1
    room = size + 1
    room[last] -= 1
    end = np.cumsum(room)
    out = np.full(end[-1] if len(end) else 0, 0x20, np.uint8)
    out[W.ranges(end - room, size)] = w.data[W.ranges(w.start[word], size)]
    ends = np.concatenate([[0], end[last]])
    return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)])


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the first of each key, sums of n), in key order."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return order[new], np.add.reduceat(n[order], new)


def _parse(batches):
    """(lang, chunk, own, freq): the distinct chunks of a batch's texts."""
    for b in batches:
        names, code = _codes(b.column("lang"))
        for row, texts in W.chunks(b.column("text")):
            w = W.split(texts, FOLD)
            n = len(w.start)
            if not n:
                continue
            h, doc = w.hashes(), w.doc
            breaks = np.concatenate([[0], np.cumsum(w.data == _BREAK)])
            piece = np.ones(n, bool)  # a word that begins a piece
            piece[1:] = (doc[1:] != doc[:-1]) | (breaks[w.start[1:]] > breaks[w.end[:-1]])
            begins = np.flatnonzero(piece)
            ends = np.append(begins[1:], n)[np.cumsum(piece) - 1]
            cut = piece.copy()
            if n >= OVERLAP:
                window = W.window_hashes(h, OVERLAP)
                cut[: len(window)] |= (window % np.uint64(TRIGGER) == 0) & (np.arange(len(window)) + OVERLAP <= ends[: len(window)])
            start = np.flatnonzero(cut)
            stop = np.append(start[1:], n)
            own = stop - start
            reach = np.minimum(stop + OVERLAP, ends[start])
            key = W.sequence_hashes(h, start, reach) ^ W.mix(((own << 20) + code[row + doc[start]]).astype(np.uint64))
            at, freq = _summed(key, np.ones(len(key), np.int64))
            lang = pa.array(names, pa.string()).take(pa.array(code[row + doc[start[at]]]))
            yield pa.RecordBatch.from_arrays([lang, _text_bytes(w, start[at], reach[at]).cast(pa.string()), pa.array(own[at]),
                                              pa.array(freq)], names=["lang", "chunk", "own", "freq"])


def dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, chunk, own, freq), stored: the distinct chunks, how many words
    from their beginning are their own, and how often they occur."""
    C.bound_batches(docs.sparkSession)
    rows = docs.select(C.text_or_empty(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    chunks = rows.mapInArrow(_parse, "lang string, chunk string, own long, freq long")
    return C.cut_lineage(chunks.groupBy("lang", "chunk", "own").agg(F.sum("freq").alias("freq")))


class Grams:
    """The n-grams that the chunks of a batch count: for each word that is the
    chunk's own, the hashes of the phrases that begin there."""

    def __init__(self, b: pa.RecordBatch, row: int, texts: pa.Array, seed: np.ndarray, code: np.ndarray):
        self.w = W.split(texts)
        size = np.diff(self.w.first)
        self.chunk = np.repeat(np.arange(len(texts)), size)
        at = np.arange(len(self.w.start)) - self.w.first[:-1][self.chunk]
        own = b.column("own").to_numpy()[row: row + len(texts)]
        self.freq = b.column("freq").to_numpy()[row: row + len(texts)]
        self.own, self.left = at < own[self.chunk], size[self.chunk] - at
        self.h = W.mix(self.w.hashes() ^ seed[code[row: row + len(texts)]][self.chunk])
        self.ok: dict[int, np.ndarray] = {}

    def keys(self, n: int) -> np.ndarray:
        """The hash of the n words from each word on (the last ones: 0)."""
        out = np.zeros(len(self.h), np.uint64)
        if n == 1:
            return self.h
        x = W.window_hashes(self.h, n)
        out[: len(x)] = x
        return out

    def hold(self, n: int, bitmap: np.ndarray) -> None:
        """Only phrases whose parts of n words are in the bitmap go on."""
        self.ok[n] = _in_bitmap(bitmap, self.keys(n).view(np.int64)) & (self.left >= n)

    def places(self, n: int) -> np.ndarray:
        """Words at which a phrase of n words begins that is counted here."""
        ok = self.own & (self.left >= n)
        for size, good in self.ok.items():
            for i in range(n - size + 1):
                ok[: len(ok) - i] &= good[i:]
                ok[len(ok) - i:] = False
        return np.flatnonzero(ok)


def _grams(b: pa.RecordBatch):
    names, code = _codes(b.column("lang"))
    seed = _lang_seed(names)
    for row, texts in W.chunks(b.column("chunk"), 4 * W.CHUNK):
        yield Grams(b, row, texts, seed, code)


def _hash_counts(n: int, known: dict[int, np.ndarray]):
    """(key, count) of the phrases of n words."""
    def of(batches):
        for b in batches:
            for g in _grams(b):
                for size, bitmap in known.items():
                    g.hold(size, bitmap)
                at = g.places(n)
                key = g.keys(n)[at]
                first, total = _summed(key, g.freq[g.chunk[at]])
                yield pa.record_batch([key[first].view(np.int64), total], names=["key", "count"])
    return of


def _phrase_counts(known: dict[int, np.ndarray]):
    """(lang, words, phrase, count) of the phrases of 1 to LONGEST words."""
    def of(batches):
        for b in batches:
            langs = b.column("lang")
            row = 0
            for g in _grams(b):
                for size, bitmap in known.items():
                    g.hold(size, bitmap)
                for n in range(1, LONGEST + 1):
                    at = g.places(n) if n > max(known) else np.flatnonzero(g.own & g.ok[n])
                    first, total = _summed(g.keys(n)[at], g.freq[g.chunk[at]])
                    at = at[first]
                    yield pa.RecordBatch.from_arrays([
                        langs.take(pa.array(row + g.chunk[at])), pa.array(np.full(len(at), n, np.int32)),
                        _text_bytes(g.w, at, at + n).cast(pa.string()), pa.array(total)], names=["lang", "words", "phrase", "count"])
                row += len(g.freq)
    return of


def frequent_phrases(chunks: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, words, phrase, f), stored: all phrases of 1 to LONGEST words that
    occur ``least`` times or more."""
    known: dict[int, np.ndarray] = {}
    for n in (1, 2, 3):
        keys = chunks.mapInArrow(_hash_counts(n, known), "key long, count long").groupBy("key").agg(F.sum("count").alias("c"))
        keys = C.cut_lineage(keys.where(F.col("c") >= least).select("key"))
        known[n] = _bitmap(keys, keys.count())
        discard(keys)
    found = chunks.mapInArrow(_phrase_counts(known), "lang string, words int, phrase string, count long")
    return C.cut_lineage(found.groupBy("lang", "words", "phrase").agg(F.sum("count").alias("f")).where(F.col("f") >= least))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST,
                 best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    chunks = dictionary(docs, text_col, lang_col)
    total = C.cut_lineage(chunks.groupBy("lang").agg(F.sum(F.col("freq") * F.col("own")).alias("n")))
    freq = frequent_phrases(chunks, least)
    discard(chunks)

    # the first and the last words of each phrase, one row a cut
    cand = freq.where("words >= 2")
    word = F.split("phrase", " ")
    cuts = cand.select("lang", "words", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", F.array_join(F.slice(word, F.lit(1), F.col("k")), " ").alias("first"),
                       F.array_join(F.slice(word, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(freq.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    cuts = C.cut_lineage(cuts.join(total, "lang"))
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    over = (F.lit(1000).cast("decimal(4,0)") * whole("a")).cast("decimal(20,0)") * whole("n")
    under = whole("l") * whole("r")
    cuts = cuts.withColumn("_over", over).withColumn("_under", under).withColumn("score", F.expr("_over div _under").cast("long"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("c"))

    # a phrase goes if a longer one holds it each time; one word longer shows it
    inside = cuts.where("k = 1").select("lang", F.col("rest").alias("phrase"), "a").unionByName(
        cuts.where("k = words - 1").select("lang", F.col("first").alias("phrase"), "a"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = lowest.select("lang", "phrase", "c.*").join(inside, ["lang", "phrase"], "left")
    kept = kept.where(F.col("most").isNull() | (100 * F.col("most") < 100 * F.col("a"))).drop("most")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    kept = kept.withColumn("rank", rank).where(F.col("rank") <= best)
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
    FROM documents),
  p AS (SELECT lang, regexp_extract_all(u.piece, '[^\x20\x09]+') AS w FROM d, unnest(d.pieces) u(piece)),
  g AS (SELECT lang, k.k AS words, array_to_string(w[i.i : i.i + k.k - 1], ' ') AS phrase
    FROM p, range(1, 6) k(k), unnest(range(1, len(w) - k.k + 2)) i(i)),
  f AS (SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY ALL),
  t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang),
  c AS (SELECT * FROM f WHERE words > 1 AND f >= 100),
  s AS (SELECT c.lang, c.phrase, c.words, c.f AS a, l.f AS l, r.f AS r, t.n, j.j AS k,
      CAST((1000::HUGEINT * c.f * t.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
    FROM c, range(1, 5) j(j), f l, f r, t WHERE j.j < c.words AND l.lang = c.lang AND r.lang = c.lang AND t.lang = c.lang
      AND l.phrase = array_to_string(string_split(c.phrase, ' ')[1 : j.j], ' ')
      AND r.phrase = array_to_string(string_split(c.phrase, ' ')[j.j + 1 :], ' ')),
  m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s),
  z AS (SELECT * FROM m WHERE o = 1 AND NOT EXISTS (SELECT 1 FROM c AS b WHERE b.lang = m.lang AND b.words > m.words
      AND 100 * b.f >= 100 * m.a AND contains(' ' || b.phrase || ' ', ' ' || m.phrase || ' ')))
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
    phrase, a, l, r, n, score FROM z) WHERE rank <= 2000"""


@register("op11_collocations", _SQL)
def op11_collocations(spark, sf_dir):
    return collocations(C.table(spark, sf_dir, "documents"))
