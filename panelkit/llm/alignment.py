"""Operator 13: alignment of two tokenizers by sparse incidence matrices.

A text is encoded by a byte-level BPE (A) and by a piece BPE with byte fallback
(B).  Both cover the same bytes, the text with a blank before it.  Rows of the
incidence matrices are token occurrences, columns are bytes, kept in CSR form.
A row of A times the transpose of B (Gustavson: the rows of B's transpose that
the row names, added up) holds the B tokens that overlap it, with the number of
shared bytes: the overlap links.  Those whose ranges end together cut the
tokens into groups, and the product of the groups' incidence matrices holds the
links inside a group.

Ids whose occurrences end together are, one of them, the end of the other's
bytes, so that the vocabularies alone bound the number of different pairs.
Corpus-wide counts of them go to all tasks; their number does not grow with
the corpus.

The parts of a text that start at a blank after a visible character are encoded
apart, once each, as no token of either vocabulary reaches over such a place
(checked when the vocabularies are read; else texts are encoded whole).  A text
whose bytes do not come back is encoded whole, and decides so.

Edge cases: a null or empty text, or one whose tokens' bytes differ from it,
has no tokens, and zeros; strings of special tokens are plain text; repeated
rows and null ids are rows like others; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from . import common as C
from . import words as W
from .registry import register

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Encoded parts that a worker keeps.
KEPT = 400_000
#: Bytes of text that are handled at once: the more, the fewer parts are looked up again.
CHUNK = 4 * W.CHUNK
#: Bytes that are not cut before a blank: white space, and the last bytes of wide white space.
_CLOSED = np.ones(256, bool)
_CLOSED[list(range(0x09, 0x0E)) + list(range(0x1C, 0x21))] = False


@dataclass
class CSR:
    """A sparse matrix by rows: the columns of row i and their values stand
    from start[i] to start[i + 1]."""
    start: np.ndarray
    column: np.ndarray
    value: np.ndarray
    width: int

    @classmethod
    def of_ranges(cls, begin: np.ndarray, end: np.ndarray, width: int) -> "CSR":
        """Ones from ``begin`` up to ``end`` in each row."""
        size = end - begin
        return cls(np.concatenate([[0], np.cumsum(size)]), W.ranges(begin, size), np.ones(int(size.sum()), np.int64), width)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))

    def transposed(self) -> "CSR":
        order = np.argsort(self.column, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(self.column, minlength=self.width))])
        return CSR(start, self.row[order], self.value[order], len(self.start) - 1)

    def times(self, other: "CSR") -> "CSR":
        """The product, row by row: the rows of ``other`` that a row names,
        times its values, are added up by column."""
        size = np.diff(other.start)[self.column]
        at = W.ranges(other.start[:-1][self.column], size)
        row, column = np.repeat(self.row, size), other.column[at]
        value = np.repeat(self.value, size) * other.value[at]
        place = row * other.width + column
        if len(place) and (place[1:] < place[:-1]).any():
            order = np.argsort(place, kind="stable")
            place, value = place[order], value[order]
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
        place, value = place[new], np.add.reduceat(value, new) if len(new) else value
        count = np.bincount(place // other.width, minlength=len(self.start) - 1) if len(place) else np.zeros(len(self.start) - 1, np.int64)
        return CSR(np.concatenate([[0], np.cumsum(count)]), place % max(other.width, 1), value, other.width)


class Vocabulary:
    """Bytes of all ids, one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.data[W.ranges(self.begin[ids], self.size[ids])]


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: visible
    ones for themselves, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoders:
    """Both tokenizers, with the parts they have seen."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        alphabet = _byte_alphabet()
        names = self.a.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            tokens[i] = bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()
        self.va = Vocabulary(tokens)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.vb = Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                              for i, p in enumerate(pieces)])
        self.blank = self.b.piece_to_id("▁")
        with open(byte_bpe, encoding="utf-8") as f:
            made = json.load(f)
        cut = made.get("pre_tokenizer") or {}
        self.by_parts = (made.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex")
                         and not cut.get("add_prefix_space") and not self.b.is_unknown(self.blank)
                         and not any("▁" in p.lstrip("▁") for i, p in enumerate(pieces) if not self.b.is_byte(i)))
        self._forget()

    def _forget(self):
        self.slot: dict[bytes, int] = {}  # of a part; flat and size: its ids of A and of B
        self.flat = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.size = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return (np.array(self.a.encode(" " + text, add_special_tokens=False).ids, np.int64),
                np.array(self.b.encode(text), np.int64))

    def _learn(self, parts: list[bytes]) -> None:
        texts = [p.decode() for p in parts]
        a = [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        b = [[self.blank] if t == " " else x for t, x in zip(texts, b)]
        for i, ids in enumerate((a, b)):
            self.flat[i] = np.concatenate([self.flat[i], np.fromiter(chain.from_iterable(ids), np.int64)])
            self.size[i] = np.concatenate([self.size[i], np.fromiter(map(len, ids), np.int64, len(ids))])
        for p in parts:
            self.slot[p] = len(self.slot)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, number for each text, ids of B, number for each text) of
        a chunk of texts without nulls; 0 where a text has no tokens."""
        n = len(texts)
        raw, at = _bytes(texts)
        size = np.diff(at)
        some = np.flatnonzero(size)
        if not self.by_parts:
            return self._one_by_one(texts, some, set())
        # a blank before each text that is not empty
        data = np.full(len(raw) + len(some), 0x20, np.uint8)
        begin = at[:-1][some] + np.arange(len(some))
        data[W.ranges(begin + 1, size[some])] = raw[W.ranges(at[:-1][some], size[some])]
        cut = np.zeros(len(data), bool)
        cut[1:] = (data[1:] == 0x20) & _CLOSED[data[:-1]]
        cut[2:] &= ~((data[:-2] == 0xC2) & ((data[1:-1] == 0x85) | (data[1:-1] == 0xA0)))
        cut[3:] &= ~((data[:-3] >= 0xE1) & (data[:-3] <= 0xE3) & (data[1:-2] >= 0x80))
        cut[begin] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        part = W.Words(data, start, end, np.zeros(1, np.int64)).hashes()
        _, index, of = np.unique(part, return_index=True, return_inverse=True)
        names = [data[start[i]: end[i]].tobytes() for i in index]
        if len(self.slot) > KEPT:
            self._forget()
        fresh = [p for p in names if p not in self.slot]
        if fresh:
            self._learn(fresh)
        slot = np.fromiter(map(self.slot.__getitem__, names), np.int64, len(names))[of] if names else np.zeros(0, np.int64)
        doc = np.searchsorted(begin, start, "right") - 1
        ids, count = [], []
        for flat, length in zip(self.flat, self.size):
            own = length[slot]
            ids.append(flat[W.ranges((np.cumsum(length) - length)[slot], own)])
            count.append(np.bincount(doc, own, minlength=len(some)).astype(np.int64))
        wrong = {int(some[d]) for d in np.flatnonzero(~self._right(ids, count, data, begin))}
        out = []
        for i, c in zip(ids, count):
            each = np.zeros(n, np.int64)
            each[some] = c
            out += [i, each]
        return self._one_by_one(texts, some, wrong, out) if wrong else tuple(out)

    def _right(self, ids, count, data, begin) -> np.ndarray:
        """For each text, whether the tokens of both give its bytes."""
        want = np.diff(np.append(begin, len(data)))
        ok = np.ones(len(begin), bool)
        for vocabulary, i, c in zip((self.va, self.vb), ids, count):
            run = np.concatenate([[0], np.cumsum(vocabulary.size[i])])[np.concatenate([[0], np.cumsum(c)])]
            got = vocabulary.bytes_of(i)
            if len(got) == len(data) and (np.diff(run) == want).all() and (got == data).all():
                continue
            for d in range(len(begin)):
                ok[d] &= got[run[d]: run[d + 1]].tobytes() == data[begin[d]: begin[d] + want[d]].tobytes()
        return ok

    def _one_by_one(self, texts, some, wrong, have=None):
        """Texts in ``wrong`` (or all) encoded whole."""
        split = [np.split(have[i], np.cumsum(have[i + 1])[:-1]) for i in (0, 2)] if have else None
        none = np.zeros(0, np.int64)
        a, b = ([none] * len(texts) for _ in range(2))
        for d in some.tolist():
            if have and d not in wrong:
                a[d], b[d] = split[0][d], split[1][d]
                continue
            text = texts[d].as_py()
            x, y = self._whole(text)
            want = (" " + text).encode()
            if self.va.bytes_of(x).tobytes() == want == self.vb.bytes_of(y).tobytes():
                a[d], b[d] = x, y
        sizes = [np.array([len(x) for x in ids], np.int64) for ids in (a, b)]
        return (np.concatenate(a) if a else none, sizes[0], np.concatenate(b) if b else none, sizes[1])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array without nulls."""
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


@lru_cache(maxsize=None)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of all numbers below ``n``, with room for a sign, and how many they are."""
    width = len(str(n))
    text = np.array([str(i).ljust(width + 1) for i in range(n)], f"S{width + 1}").view(np.uint8).reshape(n, width + 1)
    return text, np.array([len(str(i)) for i in range(n)])


@lru_cache(maxsize=2)
def encoders(byte_bpe: str, piece_bpe: str) -> Encoders:
    return Encoders(byte_bpe, piece_bpe)


@lru_cache(maxsize=2)
def possible_pairs(byte_bpe: str, piece_bpe: str) -> np.ndarray:
    """All pairs of ids (a * ids of B + b, sorted) of which one's bytes are the
    end of the other's: at most one for each end of each entry, times the few
    entries of equal bytes."""
    e = encoders(byte_bpe, piece_bpe)
    width = len(e.vb.tokens)
    of_a, of_b = {}, {}
    for of, v in ((of_a, e.va), (of_b, e.vb)):
        for i, t in enumerate(v.tokens):
            of.setdefault(t, []).append(i)
    found = {a * width + b for a, t in enumerate(e.va.tokens) for k in range(len(t)) for b in of_b.get(t[k:], ())}
    found |= {a * width + b for b, t in enumerate(e.vb.tokens) for k in range(len(t)) for a in of_a.get(t[k:], ())}
    return np.array(sorted(found), np.int64)


@dataclass
class Alignment:
    """Tokens of a chunk of texts: ids, ends (bytes, running over the chunk) and
    numbers for each text, of A and of B."""
    a: np.ndarray
    n_a: np.ndarray
    b: np.ndarray
    n_b: np.ndarray
    end_a: np.ndarray
    end_b: np.ndarray

    @classmethod
    def of(cls, e: Encoders, texts: pa.Array) -> "Alignment":
        a, n_a, b, n_b = e.encode(texts)
        return cls(a, n_a, b, n_b, np.cumsum(e.va.size[a]), np.cumsum(e.vb.size[b]))

    def overlap(self) -> CSR:
        """A tokens by B tokens: the bytes that they share."""
        width = int(self.end_a[-1]) if len(self.end_a) else 0
        begin = lambda end: np.concatenate([[0], end[:-1]])[: len(end)]
        a = CSR.of_ranges(begin(self.end_a), self.end_a, width)
        b = CSR.of_ranges(begin(self.end_b), self.end_b, width)
        return a.times(b.transposed())

    def together(self) -> tuple[np.ndarray, np.ndarray]:
        """(A tokens, B tokens): the overlap links whose ranges end together."""
        links = self.overlap()
        row = links.row
        ok = self.end_a[row] == self.end_b[links.column]
        return row[ok], links.column[ok]

    def groups(self, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group of each token; the links' tokens are the last of theirs."""
        return np.searchsorted(last_a, np.arange(len(self.a))), np.searchsorted(last_b, np.arange(len(self.b)))

    def in_groups(self) -> CSR:
        """A tokens by B tokens: those of one group."""
        last_a, last_b = self.together()
        group_a, group_b = self.groups(last_a, last_b)
        a = CSR.of_ranges(group_a, group_a + 1, len(last_a))
        return a.times(CSR.of_ranges(group_b, group_b + 1, len(last_a)).transposed())

    def digests(self, last_a: np.ndarray, last_b: np.ndarray) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2`` for each text, '' without tokens."""
        group_a, group_b = self.groups(last_a, last_b)
        before_b = np.concatenate([[0], last_b + 1])  # B tokens in the groups before
        ids = np.zeros(len(self.a) + len(self.b), np.int64)
        sign = np.full(len(ids), ord(","), np.uint8)
        at_a = np.arange(len(self.a)) + before_b[group_a]
        at_b = np.arange(len(self.b)) + (last_a + 1)[group_b]
        ids[at_a], ids[at_b] = self.a, self.b
        sign[at_a[last_a]], sign[at_b[last_b]] = ord("|"), ord(";")
        text, size = _decimals(1 << int(ids.max(initial=0)).bit_length())
        text, size = text[ids], size[ids]
        text[np.arange(len(ids)), size] = sign
        end = np.cumsum(size + 1)
        text = text[np.arange(text.shape[1]) <= size[:, None]]
        stop = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        return [hashlib.sha256(text[i: j - 1]).hexdigest() if j > i else "" for i, j in zip(stop[:-1].tolist(), stop[1:].tolist())]


def _aligned(paths: tuple[str, str]):
    """id, n_a, n_b, n_groups, n_links, groups_sha256 and the links' pairs (as
    places among the possible ones) of a batch."""
    def of(batches):
        e, pairs = encoders(*paths), possible_pairs(*paths)
        width = len(e.vb.tokens)
        for b in batches:
            for row, texts in W.chunks(b.column("text"), CHUNK):
                x = Alignment.of(e, texts)
                last_a, last_b = x.together()
                link = np.searchsorted(pairs, x.a[last_a] * width + x.b[last_b]).astype(np.int32)
                to = np.concatenate([[0], np.cumsum(x.n_a)])
                first = np.searchsorted(last_a, to).astype(np.int32)
                n = pa.array(np.diff(first).astype(np.int64))
                yield pa.RecordBatch.from_arrays([
                    b.column("id").slice(row, len(texts)), pa.array(x.n_a), pa.array(x.n_b), n, n,
                    pa.array(x.digests(last_a, last_b), pa.string()),
                    pa.ListArray.from_arrays(pa.array(first), pa.array(link))],
                    names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])
    return of


def _pair_counts(size: int):
    """(pair, count) of one task's links."""
    def of(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            at, n = np.unique(b.column("pairs").flatten().to_numpy(), return_counts=True)
            total[at] += n
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "count"])
    return of


def _with_counts(count: np.ndarray, best: np.ndarray):
    def of(batches):
        for b in batches:
            pairs = b.column("pairs")
            first = pairs.offsets.to_numpy()
            link = pairs.flatten().to_numpy()
            run = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[first - first[0]])
            keep = [b.column(c) for c in b.schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(run(best[link].astype(np.int64))), pa.array(run(count[link]))],
                                             names=[*b.schema.names[:-1], "n_best", "count_sum"])
    return of


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE,
          piece_bpe: str = PIECE_BPE) -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b (tokens), n_groups, n_links
    (token pairs that end together), groups_sha256, n_best and count_sum."""
    C.bound_batches(docs.sparkSession)
    paths = (byte_bpe, piece_bpe)
    rows = docs.select(F.col(id_col).alias("id"), C.text_or_empty(text_col).alias("text"))
    fields = [T.StructField("id", rows.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")),
              T.StructField("groups_sha256", T.StringType())]
    stored = C.cut_lineage(rows.mapInArrow(_aligned(paths), T.StructType([*fields, T.StructField("pairs", T.ArrayType(T.IntegerType()))])))
    pairs = possible_pairs(*paths)  # bounds what comes back: one row a pair of ids
    counts = stored.select("pairs").mapInArrow(_pair_counts(len(pairs)), "pair int, count long").groupBy("pair").agg(
        F.sum("count").alias("count")).toArrow()
    count = np.zeros(len(pairs), np.int64)
    count[counts.column("pair").to_numpy()] = counts.column("count").to_numpy()
    width = len(encoders(*paths).vb.tokens)
    most = np.zeros(width, np.int64)
    np.maximum.at(most, pairs % width, count)
    out = T.StructType([*fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    done = stored.mapInArrow(_with_counts(count, count == most[pairs % width]), out)
    return done.withColumnRenamed("id", id_col)


def _links(kind: str, paths: tuple[str, str]):
    def of(batches):
        e = encoders(*paths)
        for b in batches:
            for row, texts in W.chunks(b.column("text"), W.CHUNK // 4):
                x = Alignment.of(e, texts)
                if kind == "together":
                    i, j = x.together()
                    value = np.ones(len(i), np.int64)
                else:
                    m = x.overlap() if kind == "overlap" else x.in_groups()
                    i, j, value = m.row, m.column, m.value
                doc = np.repeat(np.arange(len(texts)), x.n_a)[i]
                at_a, at_b = (np.concatenate([[0], np.cumsum(n)])[doc] for n in (x.n_a, x.n_b))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row + doc)), pa.array(i - at_a), pa.array(j - at_b),
                                                  pa.array(x.a[i]), pa.array(x.b[j]), pa.array(value)],
                                                 names=["id", "at_a", "at_b", "a", "b", "value"])
    return of


def links(docs: DataFrame, kind: str = "overlap", id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE,
          piece_bpe: str = PIECE_BPE) -> DataFrame:
    """The links themselves: id, at_a, at_b (places of the tokens), a, b (their
    ids) and value.  ``kind``: overlap (value: shared bytes), together (ranges
    that end together), group (tokens of one group)."""
    if kind not in ("overlap", "together", "group"):
        raise ValueError(f"no such kind of links: {kind}")
    C.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), C.text_or_empty(text_col).alias("text"))
    shape = T.StructType([T.StructField("id", rows.schema["id"].dataType),
                          *(T.StructField(c, T.LongType()) for c in ("at_a", "at_b", "a", "b", "value"))])
    return rows.mapInArrow(_links(kind, (byte_bpe, piece_bpe)), shape).withColumnRenamed("id", id_col)


@register("op13_token_alignment")
def op13_token_alignment(spark, sf_dir):
    return align(C.table(spark, sf_dir, "documents"))
