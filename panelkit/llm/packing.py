"""Operator 5: token ids, packed into rows of a fixed length.

Texts become the ids of a byte-level BPE vocabulary (a ranks file whose path
is a parameter); a document ends with the end id.  Documents longer than a row
are split into whole rows and a rest, nothing being dropped.  Each task packs
its documents, a bounded pool of ids at a time, by best-fit decreasing: the
segments by falling length, each into the fullest row that still has room.
A segment tree over capacities finds that row in O(log capacity).

A packed row holds its ids as little-endian unsigned numbers padded to the
full length (the id matrix), the cumulative segment lengths, the places at
which positions start again from the offset given beside them, and where each
segment comes from.  Tasks need no shuffle; row names are (task, number).

Edge cases: a null or empty text is one segment that holds the end id alone;
null ids are carried as such; repeated rows are packed as often as they occur;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from . import common as C
from .registry import register

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's text is cut into pieces before merging.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
END = 50_256
LENGTH = 4_096
#: Ids that a task holds before it packs them.
POOL = 2_000_000


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken
    ranks = {}
    for line in _lines(path):
        token, rank = line.split()
        ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding("ids", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def _lines(path: str):
    with open(path, "rb") as f:  # a vocabulary file that is installed beside the library on every node
        return f.read().splitlines()


class CapacityTree:
    """Rows by the room that is left in them.  A node counts the rows with a
    room in its range; ``fit`` takes the least room that is large enough."""

    def __init__(self, length: int):
        self.size = 1 << (length + 1).bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = self.size + room
        while at:
            self.count[at] += 1
            at >>= 1

    def fit(self, need: int) -> tuple[int, int] | None:
        """(room, row), taken out; None if no row has so much room."""
        at, count = self.size + need, self.count
        if not count[at]:  # up until a right neighbour has rows, then down to its left end
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at *= 2
                if not count[at]:
                    at += 1
        room = at - self.size
        row = self.rows[room].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return room, row


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Rows as lists of segment numbers; each size is 1 to ``length``."""
    tree, rows = CapacityTree(length), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        need = int(sizes[i])
        got = tree.fit(need)
        if got is None:
            room, row = length, len(rows)
            rows.append([])
        else:
            room, row = got
        rows[row].append(i)
        if room > need:
            tree.put(room - need, row)
    return rows


def _row_schema(kind) -> T.StructType:
    return T.StructType([
        T.StructField("task", T.IntegerType()), T.StructField("number", T.IntegerType()),
        T.StructField("n_tokens", T.IntegerType()), T.StructField("ids", T.BinaryType()),
        T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
        T.StructField("position_start", T.ArrayType(T.LongType())),
        T.StructField("doc_ids", T.ArrayType(kind))])


def _pack(path: str, length: int, end: int, pool: int):
    def of(batches):
        encode, number = _encoding(path).encode_ordinary, 0
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        wide = np.dtype("<u2" if end < 1 << 16 else "<u4")
        held, ids, total = [], [], 0  # (ids, offset in the document, place in ids)

        def flush():
            nonlocal number, held, ids, total
            if not held:
                return None
            names = pa.concat_arrays(ids)
            sizes = np.array([len(x) for x, _, _ in held])
            rows = best_fit_decreasing(sizes, length)
            cols = [[] for _ in range(7)]
            for row in rows:
                matrix = np.full(length, end, wide)
                cu = np.concatenate([[0], np.cumsum(sizes[row])])
                for a, i in zip(cu.tolist(), row):
                    matrix[a: a + sizes[i]] = held[i][0]
                for col, x in zip(cols, (task, number, int(cu[-1]), matrix.tobytes(), cu.tolist(),
                                         [held[i][1] for i in row], [held[i][2] for i in row])):
                    col.append(x)
                number += 1
            flat = pa.array([i for x in cols[6] for i in x], pa.int64())
            at = pa.array(np.cumsum([0, *map(len, cols[6])]).astype(np.int32))
            held, ids, total = [], [], 0
            return pa.RecordBatch.from_arrays([
                pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()),
                pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.list_(pa.int32())), pa.array(cols[5], pa.list_(pa.int64())),
                pa.ListArray.from_arrays(at, names.take(flat))],
                names=["task", "number", "n_tokens", "ids", "cu_seqlens", "position_start", "doc_ids"])

        for b in batches:
            for i in range(b.num_rows):
                got = np.array([*encode(b.column(1)[i].as_py() or ""), end], wide)
                ids.append(b.column(0).slice(i, 1))
                held.extend((got[a: a + length], a, len(ids) - 1) for a in range(0, len(got), length))
                total += len(got)
                if total >= pool:
                    yield flush()
        if held:
            yield flush()
    return of


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
         length: int = LENGTH, end: int = END, pool: int = POOL) -> DataFrame:
    """Packed rows: task, number, n_tokens, ids (binary, ``length`` numbers of
    two bytes, or four for a larger vocabulary; padded with the end id),
    cu_seqlens, position_start (position of each segment's first id in its
    document: above 0 for the rest of a split one) and doc_ids."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pack(vocabulary, length, end, pool), _row_schema(rows.schema["id"].dataType))


def positions(cu_seqlens, position_start) -> np.ndarray:
    """Position ids of a packed row: they begin anew with each segment."""
    return np.concatenate([np.arange(p, p + b - a) for a, b, p in zip(cu_seqlens[:-1], cu_seqlens[1:], position_start)])


def write_packed(docs: DataFrame, path: str, **kw) -> None:
    """The packed rows as a Parquet table."""
    pack(docs, **kw).write.mode("overwrite").parquet(path)


@register("op5_token_packing")
def op5_token_packing(spark, sf_dir):
    return pack(C.table(spark, sf_dir, "documents"))
