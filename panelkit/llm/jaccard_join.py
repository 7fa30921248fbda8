"""Operator 9: n-gram Jaccard similarity join by grouped prefixes.

A document is the set of its distinct word shingles; two link when
``den * |intersection| >= num * |union|``.  Steps:

1. A fixed number of counters, summed over the whole table, grades the shingles
   by how often they occur.  The global order is by grade, then by hash, so
   that common lines and passages come last, however the table is cut.  (Any
   order gives the same links; it changes the cost.)
2. Each text becomes its sorted set; equal sets become one class.  A class's
   prefix is its first ``n - ceil(t * n) + 1`` shingles: two sets that link
   share one of them.
3. Classes of equal size and prefix form a group; the inverted index of prefix
   shingles is over groups.  Shingles that one group alone has in its prefix
   are left out before the index rows are dealt.
4. ``link_components`` verifies the best neighbour of each group and the
   neighbours inside a group first, then the other near rows of the index lists
   that are not connected yet.  A few keys of each group are looked at for that,
   which makes a number of candidates in proportion to the groups, and in a
   large family of near copies it connects nearly all.
   Index lists whose groups are all connected are then done; in the others each
   group meets one group of the largest family there.
5. All other group pairs in the index that are not connected yet (in
   ``class_links``: all group pairs) meet at the first shingle that they share.
   A pair stays when the sizes, the places of that shingle, the number of
   shared prefix shingles and (6.) the parity bits of groups of one class allow
   a link: if x's prefix ends first, then each
   shingle of it that y's prefix lacks is one that y lacks.  What is left
   expands to its members.
6. Before their texts are read, pairs of classes are held against 512 parity
   bits of each set; more bits that differ than shingles may differ rule a
   pair out.  Whole texts decide on all others.

Shingles are compared by 59-bit hashes.  A bucket of the index is never held
in memory: Spark sorts and joins it.

Edge cases: without words or text the set is empty and links with nothing, not
even with another empty one; fewer words than a shingle has are one shingle;
null ids take part, but never name a component; repeated rows are equal sets;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..session import discard
from . import common as C
from . import words as W
from .components import components
from .registry import register

#: Counters of shingles, and how many go into one row of a task's result.
COUNTERS = 1 << 22
BLOCK = 1 << 14
#: Rows of an index list before a row that are looked at first.
REACH = 6
#: Keys of a group's prefix, about, that look at the rows before them.
LOOKING = 16
#: Keys of its group that an index row carries into the join.
FIRST_KEYS = 32
#: Words of 64 parity bits of a set.
PARITIES = 8
#: Bits of a bitmap that goes to all tasks: a few for each entry, and no more than these.
BITS_EACH = 16
MOST_BITS = 1 << 26

_TOP = np.uint64(1 << 63)
_GRADE = np.uint64(59)
_LOW = np.uint64((1 << 59) - 1)
_LOST = np.uint64(5)


def _shingles(texts: pa.Array, k: int):
    """(hashes, first, short): the shingles of each text of a chunk, with
    repeats, and those of the texts with fewer than k words."""
    w = W.split(texts, W.LOWER)
    word = w.hashes()
    ok = W.window_starts(w.first, k)
    h = W.window_hashes(word, k)[ok]
    count = np.maximum(np.diff(w.first) - k + 1, 0)
    first = np.concatenate([[0], np.cumsum(count)])
    short = {int(d): W.window_hashes(word[w.first[d]: w.first[d + 1]], int(w.first[d + 1] - w.first[d]))
             for d in np.flatnonzero((np.diff(w.first) > 0) & (np.diff(w.first) < k))}
    return h, first, short


def _count_shingles(k: int):
    """A task's counters (255 at most each), the empty blocks left out."""
    def of(batches):
        seen = np.zeros(COUNTERS, np.uint8)
        for b in batches:
            for _, texts in W.chunks(b.column(0)):
                at, n = np.unique(_shingles(texts, k)[0] & np.uint64(COUNTERS - 1), return_counts=True)
                seen[at] = np.minimum(seen[at] + n, 255)
        blocks = seen.reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array([blocks[i].tobytes() for i in some], pa.binary())],
                              names=["block", "counts"])
    return of


def _grade_blocks(batches):
    """The grade of each counter, the bits of its sum over all tasks; rows come
    sorted by block."""
    at, total = None, None

    def done():
        grade = np.minimum(np.frexp(total.astype(float))[1], 31).astype(np.uint8)
        return pa.record_batch([pa.array([at], pa.int32()), pa.array([grade.tobytes()], pa.binary())], names=["block", "grades"])
    for b in batches:
        for block, counts in zip(b.column(0).to_pylist(), b.column(1)):
            if block != at:
                if total is not None:
                    yield done()
                at, total = block, np.zeros(BLOCK, np.int64)
            total += np.frombuffer(counts.as_buffer(), np.uint8)
    if total is not None:
        yield done()


def _grades(texts: DataFrame, k: int) -> np.ndarray:
    """The grades of all counters (COUNTERS bytes on the driver and in tasks)."""
    counts = texts.mapInArrow(_count_shingles(k), "block int, counts binary")
    summed = counts.repartition("block").sortWithinPartitions("block").mapInArrow(_grade_blocks, "block int, grades binary")
    out = np.zeros((COUNTERS // BLOCK, BLOCK), np.uint8)
    for r in summed.collect():
        out[r["block"]] = np.frombuffer(r["grades"], np.uint8)
    return out.ravel()


def _bitmap(numbers: DataFrame, entries: int) -> np.ndarray:
    """A packed bitmap of the low bits of ``numbers`` (a long), its size a
    power of two; put together in words of 64, so that MOST_BITS / 64 rows at
    most reach the driver."""
    bits = min(MOST_BITS, 1 << max(10, (BITS_EACH * entries).bit_length()))
    bit = numbers.select((F.col(numbers.columns[0]).bitwiseAND(F.lit(bits - 1))).alias("bit"))
    words = bit.groupBy(F.expr("shiftright(bit, 6)").alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("word")).toArrow()
    has = np.zeros(bits // 64, np.int64)
    has[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return has


def _in_bitmap(has: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    bit = numbers & np.int64(64 * len(has) - 1)
    return (has[bit >> 6] >> (bit & 63) & 1).astype(bool)


def _sets(texts: pa.Array, k: int, grades: np.ndarray | None = None):
    """The sorted distinct shingles of each text of a chunk, in the global
    order if grades are given."""
    h, first, short = _shingles(texts, k)

    def keys(x):
        low = x >> _LOST
        return low if grades is None else low | grades[x & np.uint64(COUNTERS - 1)].astype(np.uint64) << _GRADE

    key = keys(h)
    for d in range(len(texts)):
        x = np.sort(keys(short[d]) if d in short else key[first[d]: first[d + 1]])
        if len(x) > 1:
            x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        yield x


def _name(x: np.ndarray) -> tuple[int, int, int]:
    """Two 64-bit sums, whatever the order, and the size: the name of a set."""
    y = W.mix(x & _LOW)
    return int(y.sum(dtype=np.uint64).view(np.int64)), int(W.mix(y ^ _TOP).sum(dtype=np.uint64).view(np.int64)), len(x)


def _parities(x: np.ndarray) -> np.ndarray:
    """For each bit whether an odd number of shingles falls on it.  A shingle
    that one of two sets lacks turns one bit at most."""
    odd = np.bincount((x & np.uint64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array((x ^ _TOP).view(np.int64))


def _prefix(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1 if n else 0


def _signatures(k: int, num: int, den: int, grades: np.ndarray):
    def of(batches):
        for b in batches:
            seen: dict = {}
            for row, texts in W.chunks(b.column("text")):
                for i, x in enumerate(_sets(texts, k, grades)):
                    name = _name(x)
                    if name not in seen:
                        seen[name] = (x[: _prefix(len(x), num, den)].copy(), [], _parities(x))
                    seen[name][1].append(row + i)
            names = list(seen)
            at = np.cumsum([0, *(len(seen[x][1]) for x in names)])
            order = pa.array([i for x in names for i in seen[x][1]], pa.int64())
            pre = np.cumsum([0, *(len(seen[x][0]) for x in names)])
            flat = np.concatenate([seen[x][0] for x in names]) if names else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([
                *[pa.array([x[j] for x in names], pa.int64()) for j in range(3)],
                pa.ListArray.from_arrays(pa.array(pre.astype(np.int32)), _signed(flat)),
                pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), b.column("id").take(order)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1, dtype=np.int32) * PARITIES), pa.array(
                    np.concatenate([seen[x][2] for x in names]) if names else np.zeros(0, np.int64)))],
                names=["lo", "hi", "n", "prefix", "ids", "odd"])
    return of


_INDEX = ("key", "n", "grp", "p", "last", "at")


def _index_rows(shared: np.ndarray):
    """The index rows of groups (grp, n, prefix) whose key is in the bitmap of
    shared ones; a few more get through."""
    def of(batches):
        for b in batches:
            prefix = b.column("prefix")
            p = np.diff(prefix.offsets.to_numpy()).astype(np.int64)
            key = prefix.flatten().to_numpy()
            row = np.repeat(np.arange(len(p)), p)
            first = np.cumsum(p) - p
            keep = np.flatnonzero(_in_bitmap(shared, key))
            row = row[keep]
            last = key[np.minimum(first + p - 1, max(len(key) - 1, 0))] if len(key) else np.zeros(len(p), np.int64)
            n, grp = b.column("n").to_numpy(), b.column("grp").to_numpy()
            yield pa.record_batch([key[keep], n[row], grp[row], p[row], last[row], keep - first[row]], names=list(_INDEX))
    return of


def _stack(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(c).to_numpy() for c in _INDEX], 1)


def _shared_rows(batches):
    """Rows sorted by key: those whose key the row before or after has as well."""
    wait, known = np.zeros((0, len(_INDEX)), np.int64), False
    for b in batches:
        rows = np.concatenate([wait, _stack(b)])
        if not len(rows):
            continue
        same = rows[1:, 0] == rows[:-1, 0]
        dup = np.zeros(len(rows), bool)
        dup[0] = known
        dup[1:] |= same
        dup[:-1] |= same
        out = rows[:-1][dup[:-1]]
        yield pa.record_batch([np.ascontiguousarray(x) for x in out.T], names=list(_INDEX))
        wait, known = rows[-1:], bool(dup[-1])
    if known:
        yield pa.record_batch([np.ascontiguousarray(x) for x in wait.T], names=list(_INDEX))


def _most(n1, at1, n2, at2):
    """How many shingles two sets can share that have one at these places."""
    return np.minimum(at1, at2) + 1 + np.minimum(n1 - at1 - 1, n2 - at2 - 1)


def _near_pairs(num: int, den: int):
    """(prev, grp, k, far, p) of rows sorted by (key, n, grp): in how many index
    lists a group is among the REACH rows before another, and how near.  Only
    about LOOKING keys of a group, drawn by their hash, are looked at, so that
    rows grow with the groups and not with the keys that copies share; groups
    of like size draw like keys.  p is how many were drawn."""
    def of(batches):
        back = np.zeros((0, len(_INDEX)), np.int64)
        for b in batches:
            rows = _stack(b)
            draw = (W.mix(rows[:, 0].view(np.uint64) & _LOW) >> np.uint64(32)).astype(np.int64)
            rows = np.concatenate([back, rows[draw * rows[:, 3] < LOOKING << 32]])
            found = []
            for far in range(min(REACH, len(rows) - 1)):
                x, y = rows[: len(rows) - 1 - far], rows[1 + far:]
                ok = (x[:, 0] == y[:, 0]) & (den * x[:, 1] >= num * y[:, 1])
                ok &= (num + den) * _most(x[:, 1], x[:, 5], y[:, 1], y[:, 5]) >= num * (x[:, 1] + y[:, 1])
                ok[: max(0, len(back) - 1 - far)] = False  # seen with the batch before
                at = np.flatnonzero(ok)
                found.append(np.stack([x[at, 2], y[at, 2], np.full(len(at), far), np.minimum(y[at, 3], LOOKING)], 1))
            back = rows[-REACH:]
            f = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
            f = f[np.lexsort((f[:, 2], f[:, 1], f[:, 0]))]
            new = np.ones(len(f), bool)
            new[1:] = (f[1:, :2] != f[:-1, :2]).any(axis=1)
            at = np.flatnonzero(new)
            k = np.diff(np.append(at, len(f)))
            f = f[at]
            yield pa.record_batch([f[:, 0].copy(), f[:, 1].copy(), k, f[:, 2].copy(), f[:, 3].copy()],
                                  names=["prev", "grp", "k", "far", "p"])
    return of


def _named_texts(k: int, wanted: np.ndarray):
    """(class names, text) of the texts whose id hash is in the bitmap."""
    def of(batches):
        for b in batches:
            b = b.filter(pa.array(_in_bitmap(wanted, b.column("bit").to_numpy())))
            name, at = {}, []
            for row, texts in W.chunks(b.column("text")):
                for i, x in enumerate(_sets(texts, k)):
                    if name.setdefault(_name(x), row + i) == row + i:
                        at.append(row + i)
            yield pa.RecordBatch.from_arrays([*[pa.array([x[j] for x in name], pa.int64()) for j in range(3)],
                                              b.column("text").take(pa.array(at, pa.int64()))], names=["lo", "hi", "n", "text"])
    return of


def _linked(k: int, num: int, den: int):
    """The pairs (a, b) whose texts (x, y) link."""
    def of(batches):
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for row, xs in W.chunks(b.column("x")):
                for i, (x, y) in enumerate(zip(_sets(xs, k), _many(b.column("y").slice(row, len(xs)), k))):
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    ok[row + i] = (num + den) * both >= num * (len(x) + len(y))
            yield b.select(["a", "b"]).filter(pa.array(ok))
    return of


def _many(texts: pa.Array, k: int):
    for _, part in W.chunks(texts):
        yield from _sets(part, k)


@dataclass
class Index:
    """rows: (id, text); signed: a row for each set of an Arrow batch, with its
    ids; classes: (cls, n, odd: parity bits, grp: the least class of its group, least id);
    shared: index rows of keys that several groups have."""
    rows: DataFrame
    signed: DataFrame
    classes: DataFrame
    shared: DataFrame
    k: int
    num: int
    den: int

    def texts_of(self, cls: DataFrame) -> DataFrame:
        """(cls, text) of the classes ``cls``, a stored table: their documents
        are found by a bitmap of id hashes."""
        rep = self.signed.join(cls, "cls", "left_semi").groupBy("cls").agg(F.min(F.element_at("ids", 1)).alias("id"))
        bit = F.xxhash64("id").alias("bit")
        wanted = _bitmap(rep.select(bit), cls.count())
        found = self.rows.select(bit, "text").mapInArrow(_named_texts(self.k, wanted), "lo long, hi long, n long, text string")
        found = found.select(F.xxhash64("lo", "hi", "n").alias("cls"), "text").join(cls, "cls", "left_semi")
        return C.cut_lineage(found.groupBy("cls").agg(F.any_value("text").alias("text")))

    def far(self, x: str, y: str):
        """Whether the parity bits alone show that two classes (columns n<x>,
        odd<x>, n<y>, odd<y>, or those of the tables x. and y.) do not link:
        they differ in more bits than there may be shingles that one of the two
        lacks."""
        of = lambda c, side: f"{side}{c}" if side.endswith(".") else f"{c}{side}"
        n, need = F.col(of("n", x)) + F.col(of("n", y)), F.lit(self.num + self.den)
        differ = sum(F.bit_count(F.get(of("odd", x), F.lit(i)).bitwiseXOR(F.get(of("odd", y), F.lit(i)))) for i in range(PARITIES))
        return need * (n - differ) < 2 * self.num * n

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that their parity bits allow to link, stored."""
        x, y = (self.classes.select(F.col("cls").alias(f"cls{c}"), F.col("n").alias(f"n{c}"), F.col("odd").alias(f"odd{c}"))
                for c in ("a", "b"))
        pairs = pairs.join(x, F.col("a") == F.col("clsa")).join(y, (F.col("b") == F.col("clsb")) & ~self.far("a", "b"))
        return C.cut_lineage(pairs.select("a", "b"))

    def verify(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that link, stored."""
        one = pairs.select("a", "b").join(texts.select(F.col("cls").alias("a"), F.col("text").alias("x")), "a")
        two = one.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
        return C.cut_lineage(two.mapInArrow(_linked(self.k, self.num, self.den), "a long, b long"))

    def group_pairs(self, rows: DataFrame, label: str | None = None) -> DataFrame:
        """(g, h): pairs of groups that may hold links, by the index ``rows``;
        with ``label``, of groups with different labels (or none) only, whose
        common keys are then all in ``rows``.

        Each row carries its group's first keys, and its class's parity bits if
        the group has one class.  A pair comes out at the first key that it
        shares (a longer list may let it out again), and only if the places
        there, the number of shared keys and the parity bits allow a link."""
        num, den = self.num, self.den
        more = [label] if label else []
        lists = rows.groupBy("grp").agg(*[F.any_value(c).alias(c) for c in ("n", "p", "last", *more)],
                                        F.sort_array(F.collect_list(F.struct("key", "at"))).alias("list"))
        odd = self.classes.groupBy("grp").agg(F.when(F.count("*") == 1, F.any_value("odd")).alias("odd"))
        lists = lists.join(odd, "grp")
        rows = lists.select("grp", "n", "p", "last", "odd", *more, (F.size("list") <= FIRST_KEYS).alias("whole"),
                            F.slice("list.key", 1, FIRST_KEYS).alias("keys"), F.explode("list").alias("e"))
        rows = rows.select(*rows.columns[:-1], "e.key", "e.at")
        x, y = rows.alias("x"), rows.alias("y")
        need = num * (F.col("x.n") + F.col("y.n"))
        places = 1 + F.least(F.col("x.n") - F.col("x.at") - 1, F.col("y.n") - F.col("y.at") - 1)
        common = F.array_intersect("x.keys", "y.keys")
        # both sides need the same columns, so that one exchange serves them
        free = F.col("x.n") - F.col("x.p")
        free = F.when(F.col("x.last") == F.col("y.last"), F.least(free, F.col("y.n") - F.col("y.p"))).otherwise(free)
        few = F.col("x.whole") & F.col("y.whole") & ((num + den) * (free + F.size(common)) < need)
        may = ((F.col("x.key") == F.col("y.key")) & (F.col("x.last") <= F.col("y.last"))
               & ((F.col("x.last") < F.col("y.last")) | (F.col("x.grp") < F.col("y.grp")))
               & (den * F.least("x.n", "y.n") >= num * F.greatest("x.n", "y.n"))
               & ((num + den) * places >= need))
        if label:
            may &= F.coalesce(F.col(f"x.{label}") != F.col(f"y.{label}"), F.lit(True))
        may &= (F.coalesce(F.get(common, F.lit(0)), F.col("x.key")) == F.col("x.key")) & ~few
        may &= ~F.coalesce(self.far("x.", "y."), F.lit(False))
        return x.join(y, may).select(F.col("x.grp").alias("g"), F.col("y.grp").alias("h")).distinct()

    def hub_pairs(self, rows: DataFrame, label: str) -> DataFrame:
        """Pairs (a, b) of groups of different labels that are likely to link, at
        most one for each index row: in each list the groups meet the
        least group of the label with most groups there.  Of the pairs of a
        group with a label the one with most lists in common is taken, if their
        number allows a link."""
        num, den = self.num, self.den
        some = rows.where(F.col(label).isNotNull())
        hub = some.groupBy("key", label).agg(F.count("*").alias("c"), F.min(F.struct("grp", "n", "p", "last")).alias("b"))
        hub = hub.groupBy("key").agg(F.max(F.struct("c", F.col(label).alias("lb"), "b")).alias("hub"))
        x = some.join(hub, "key").where(F.col(label) != F.col("hub.lb")).select(
            F.col("grp").alias("a"), F.col(label).alias("la"), "n", "p", "last", "hub.lb", F.col("hub.b").alias("y"))
        x = x.where(den * F.least("n", "y.n") >= num * F.greatest("n", "y.n"))
        free = F.when(F.col("last") <= F.col("y.last"), F.col("n") - F.col("p")).otherwise(F.col("y.n") - F.col("y.p"))
        met = x.groupBy("a", "lb", F.col("y.grp").alias("b")).agg(
            F.count("*").alias("c"), F.any_value(F.struct(free.alias("free"), (num * (F.col("n") + F.col("y.n"))).alias("need"))).alias("f"))
        met = met.where((num + den) * (F.col("f.free") + F.col("c")) >= F.col("f.need"))
        return met.groupBy("a", "lb").agg(F.max_by("b", F.struct("c", "b")).alias("b")).select("a", "b")


def _index(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> Index:
    C.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), C.text_or_empty(text_col).alias("text"))
    grades = _grades(rows.select("text"), k)
    kind = rows.schema["id"].dataType
    shape = T.StructType([*T._parse_datatype_string("lo long, hi long, n long, prefix array<long>").fields,
                          T.StructField("ids", T.ArrayType(kind)), T.StructField("odd", T.ArrayType(T.LongType()))])
    signed = rows.mapInArrow(_signatures(k, num, den, grades), shape)
    signed = C.cut_lineage(signed.select(F.monotonically_increasing_id().alias("row"), F.xxhash64("lo", "hi", "n").alias("cls"),
                                         F.xxhash64("n", "prefix").alias("same"), "n", "prefix", "ids", "odd"))
    some = signed.where("n > 0")
    groups = C.cut_lineage(some.groupBy("same").agg(F.min("cls").alias("grp"), F.any_value("n").alias("n"),
                                                    F.any_value("prefix").alias("prefix")))
    classes = some.groupBy("cls").agg(F.any_value("n").alias("n"), F.any_value("same").alias("same"),
                                      F.any_value("odd").alias("odd"), F.min(F.array_min("ids")).alias("least"))
    classes = C.cut_lineage(classes.join(groups.select("same", "grp"), "same").drop("same"))
    twice = C.cut_lineage(groups.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count("*").alias("c"))
                          .where("c > 1").select("key"))
    schema = ", ".join(f"{c} long" for c in _INDEX)
    index = groups.select("grp", "n", "prefix").mapInArrow(_index_rows(_bitmap(twice, twice.count())), schema)
    shared = C.cut_lineage(index.repartition("key").sortWithinPartitions("key", "n", "grp").mapInArrow(_shared_rows, schema))
    discard(twice, groups)
    return Index(rows, signed, classes, shared, k, num, den)


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (a, b) whose classes have different labels (none: their own),
    with the labels as la and lb, stored."""
    for side in ("a", "b"):
        pairs = pairs.join(label.select(F.col("node").alias(side), F.col("label").alias(f"l{side}")), side, "left")
    pairs = pairs.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))
    return C.cut_lineage(pairs.where("la <> lb"))


def _extend(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: components of the labels that they join."""
    known = label
    for side in ("a", "b"):
        links = links.join(known.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}")), side, "left")
    met = C.cut_lineage(links.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
                        .where("a <> b").distinct())
    if met.isEmpty():
        return label
    top = components(met)
    up = top.select(F.col("node").alias("label"), F.col("label").alias("up"))
    moved = C.spread_join(label, up, "label", "node", "left").select("node", F.coalesce("up", "label").alias("label"))
    fresh = top.join(label, "node", "left_anti").select("node", "label")
    out = C.cut_lineage(moved.unionByName(fresh))
    discard(met, label)
    return out


def _open_lists(classes: DataFrame, rows: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The classes with their labels (none: their own), stored; the groups with
    the label ``one`` that all their classes have, or null; and, stored with
    ``one``, the index rows of lists that more than one label has."""
    member = C.cut_lineage(classes.select("cls", "grp", "n", "odd").join(label.withColumnRenamed("node", "cls"), "cls", "left")
                           .withColumn("label", F.coalesce("label", "cls")))
    whole = member.groupBy("grp").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    whole = whole.select("grp", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("one"))
    stored = C.cut_lineage(rows.join(whole, "grp"))
    open_ = stored.groupBy("key").agg(F.min("one").alias("lo"), F.max("one").alias("hi"), F.max(F.col("one").isNull()).alias("mixed"))
    rest = C.cut_lineage(stored.join(open_.where("mixed OR lo < hi").select("key"), "key", "left_semi"))
    discard(stored)
    return member, whole, rest


def _classes_in(pairs: DataFrame) -> DataFrame:
    return C.cut_lineage(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct())


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4,
                    num: int = 85, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id
    that links reach, its own included)."""
    some, none = _members(docs, id_col, text_col, k, num, den)
    some, none = (x.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id") for x in (some, none))
    return some.unionByName(none)


def _members(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The rows with a set (id, cls, n, label of the component, component_id),
    and those with an empty one (id, n, component_id)."""
    ix = _index(docs, id_col, text_col, k, num, den)
    classes, shared = ix.classes, ix.shared

    # first the best neighbour and the one inside the group, then the other near ones
    near = shared.mapInArrow(_near_pairs(num, den), "prev long, grp long, k long, far long, p long")
    near = C.cut_lineage(near.groupBy("prev", "grp").agg(F.sum("k").alias("k"), F.min("far").alias("far"), F.any_value("p").alias("p"))
                         .where("4 * k >= p").select("prev", "grp", "k", "far"))
    best = near.groupBy(F.col("grp").alias("b")).agg(F.max_by("prev", F.struct("k", -F.col("far"), "prev")).alias("a"))
    inside = classes.select(F.lag("cls").over(Window.partitionBy("grp").orderBy("cls")).alias("a"), F.col("cls").alias("b"))
    first = ix.likely(best.select("a", "b").unionByName(inside.where("a IS NOT NULL")))
    others = ix.likely(near.select(F.col("prev").alias("a"), F.col("grp").alias("b")))
    need = _classes_in(first.unionByName(others))
    texts = ix.texts_of(need)
    links = ix.verify(first, texts)
    label = components(links)
    more = _apart(others, label)
    found = ix.verify(more, texts)
    label = _extend(label, found)
    discard(near, first, others, need, texts, links, more, found)

    # then, in index lists that are not done, each group and one of the family that has most groups there
    member, whole, stored = _open_lists(classes, shared, label)
    hub = ix.likely(ix.hub_pairs(stored, "one"))
    if not hub.isEmpty():
        need = _classes_in(hub)
        texts = ix.texts_of(need)
        links = ix.verify(hub, texts)
        label = _extend(label, links)
        discard(need, texts, links)
    discard(hub, member)

    # then all pairs that are not connected yet, in index lists that are still not done
    member, whole, rest = _open_lists(classes, stored.drop("one"), label)
    pairs = ix.group_pairs(rest, "one")
    m1, m2 = (member.select(F.col("grp").alias(g), F.col("cls").alias(c), F.col("label").alias(f"l{c}"),
                            F.col("n").alias(f"n{c}"), F.col("odd").alias(f"odd{c}")) for g, c in (("g", "a"), ("h", "b")))
    near = (F.col("la") != F.col("lb")) & ~ix.far("a", "b")
    across = pairs.join(m1, "g").alias("x").join(m2.alias("y"), (F.col("x.h") == F.col("y.h")) & near).select("a", "b", "la", "lb")
    mixed = whole.where("one IS NULL").select(F.col("grp").alias("g"))
    within = m1.join(mixed, "g", "left_semi").join(m2, (F.col("g") == F.col("h")) & (F.col("la") < F.col("lb")) & ~ix.far("a", "b")).select("a", "b", "la", "lb")
    second = C.cut_lineage(across.unionByName(within).distinct())
    if not second.isEmpty():
        # one pair of two components may settle all of theirs
        need = _classes_in(second)
        texts = ix.texts_of(need)
        ends = F.struct(F.least("la", "lb"), F.greatest("la", "lb"))
        one = second.groupBy(ends.alias("ends")).agg(F.min(F.struct("a", "b")).alias("pair")).select("pair.*")
        label = _extend(label, ix.verify(one, texts))
        label = _extend(label, ix.verify(_apart(second.select("a", "b").join(one, ["a", "b"], "left_anti"), label), texts))
        discard(need, texts)
    discard(second, stored, rest, shared, member)

    least = classes.select("cls", "least").join(label.withColumnRenamed("node", "cls"), "cls", "left")
    least = least.withColumn("label", F.coalesce("label", "cls"))
    root = least.groupBy("label").agg(F.min("least").alias("component_id"))
    named = C.spread_join(least.select("cls", "label"), root, "label", "cls").select("cls", "label", "component_id")
    each = C.spread_join(ix.signed.where("n > 0").select("row", "cls", "n", "ids"), named, "cls", "row")
    some = each.select(F.explode("ids").alias("id"), "cls", "n", "label", "component_id")
    none = ix.signed.where("n = 0").select(F.explode("ids").alias("id"), "n").withColumn("component_id", F.col("id"))
    return some, none


def class_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, num: int = 85,
                den: int = 100) -> tuple[DataFrame, DataFrame]:
    """All links, without pairs of copies: (links, members), where links holds
    the pairs (a, b), a < b, of classes of equal sets that link, and members the
    class ``cls`` of each row (id, n_shingles; null for an empty set)."""
    ix = _index(docs, id_col, text_col, k, num, den)
    m1 = ix.classes.select(F.col("grp").alias("g"), F.col("cls").alias("a"))
    m2 = ix.classes.select(F.col("grp").alias("h"), F.col("cls").alias("b"))
    across = ix.group_pairs(ix.shared).join(m1, "g").join(m2, "h")
    within = m1.join(m2, (F.col("g") == F.col("h")) & (F.col("a") < F.col("b")))
    pairs = across.select("a", "b").unionByName(within.select("a", "b"))
    pairs = ix.likely(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    need = _classes_in(pairs)
    texts = ix.texts_of(need)
    links = ix.verify(pairs, texts)
    discard(pairs, need, texts, ix.shared)
    cls = F.when(F.col("n") > 0, F.col("cls")).alias("cls")
    return links, ix.signed.select(F.explode("ids").alias(id_col), F.col("n").alias("n_shingles"), cls)


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, num: int = 85,
                den: int = 100) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, cls, and n_links, the number
    of other rows that it links with (copies included)."""
    links, members = class_links(docs, id_col, text_col, k, num, den)
    size = C.cut_lineage(members.where("cls IS NOT NULL").groupBy("cls").agg(F.count("*").alias("size")))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = both.join(size.select(F.col("cls").alias("b"), "size"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("size").alias("more"))
    facts = size.join(more, "cls", "left").select("cls", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    members = C.cut_lineage(members.withColumn("_row", F.monotonically_increasing_id()))
    out = C.spread_join(members, facts, "cls", "_row", "left")
    return out.select(id_col, "n_shingles", "cls", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _with_names(k: int, text: int, names: list[str]):
    """The rows of a batch and the names of their sets."""
    def of(batches):
        for b in batches:
            name = [_name(x) for _, texts in W.chunks(b.column(text)) for x in _sets(texts, k)]
            more = [pa.array([x[j] for x in name], pa.int64()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *names])
    return of


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, num: int = 85,
             den: int = 100) -> DataFrame:
    """Of each component one row of the smallest id, whatever other rows of
    that id there are; a row with an empty set is a component alone, and rows
    with a null id all stay."""
    some, _ = _members(docs, id_col, text_col, k, num, den)
    free = lambda x: x if x not in docs.columns else free(x + "_")
    names, cls, at, of = [free(x) for x in ("_lo", "_hi", "_n")], free("_cls"), free("_at"), free("_of")
    stay = (some.where(F.col("id") == F.col("component_id")).groupBy("label", F.col("id").alias(at))
            .agg(F.min("cls").alias(of)).select(at, of))
    alone = F.col(id_col).isNull() | ~C.text_or_empty(text_col).rlike(C.WORD)
    shape = T.StructType([*docs.schema.fields, *(T.StructField(x, T.LongType()) for x in names)])
    rows = docs.where(~alone).mapInArrow(_with_names(k, docs.columns.index(text_col), names), shape)
    rows = rows.withColumn(cls, F.xxhash64(*names))
    # rows of equal id and equal set are of one component
    kept = rows.join(stay, (F.col(id_col) == F.col(at)) & (F.col(cls) == F.col(of)), "left_semi").dropDuplicates([id_col, cls])
    return kept.select(*docs.columns).unionByName(docs.where(alone))


@register("op9_jaccard_join")
def op9_jaccard_join(spark, sf_dir):
    return link_components(C.table(spark, sf_dir, "documents"))
