"""Operator 8: removal of word sequences that occur more than once, by
difference-cover anchors.

A window is ``width`` consecutive words; a word goes when a window covers it
whose words also start elsewhere, in another row or at another place of the
same text.  With a difference cover D modulo v (every difference modulo v is
one of two members), two equal windows at positions i and j have an offset
below v at which both positions are in D modulo v; so it is enough to hash
anchors of ``width - v + 1`` words at cover positions (5 of 21).  Steps:

1. equal texts become one row with its number of copies;
2. anchors that occur twice are found by sorting their hashes; hot ones are
   combined in each batch before the shuffle;
3. each shared anchor extends to the windows that contain it; their hashes
   are compared in the same way, which settles every window exactly (up to
   64-bit hash equality of 35 words);
4. the words that shared windows cover are cut.

Edge cases: a null text has no words; texts below ``width`` words stay; null
ids and repeated rows are rows like others (a repeated text of ``width`` words
or more is removed in all its rows); an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import common as C
from . import runs
from . import words as W
from .registry import register

# A perfect difference set modulo 21.
COVER_PERIOD = 21
COVER = (0, 1, 4, 14, 16)

_SENT = "key long, ref long, known array<long>"


def _combined(batches):
    """Equal texts of a batch as one row."""
    for b in batches:
        t = pa.Table.from_batches([b]).group_by(["ref", "text"]).aggregate([("copies", "sum")])
        yield from t.rename_columns(["ref", "text", "copies"]).select(["ref", "text", "copies"]).to_batches()


def _u64(a) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False).view(np.uint64)


def _member(own: np.ndarray, doc: np.ndarray, lists: pa.Array) -> np.ndarray:
    """For each hash of a text, whether the text's list has it."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(lists), dtype=np.uint64), size)
    have = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    tag = np.uint64(0x9E3779B97F4A7C15)
    return np.isin(own ^ W.mix(doc.astype(np.uint64) * tag + tag), have ^ W.mix(of * tag + tag))


def _cover_anchors(w: W.Words, size: int):
    """Positions (word index) and hashes of the anchors of a chunk."""
    h = W.window_hashes(w.hashes(), size)
    inside = np.zeros(COVER_PERIOD, bool)
    inside[list(COVER)] = True
    place = np.arange(len(h)) - np.repeat(w.first[:-1], np.diff(w.first))[: len(h)]
    at = np.flatnonzero(W.window_starts(w.first, size) & inside[place % COVER_PERIOD])
    return at, h[at]


def _sent(key, ref):
    """Batch of combined rows: those to send, and one row a text with the
    settled keys, dealt by the text."""
    key, ref, done, whose = runs.local_rows(key, ref)
    order = np.argsort(whose, kind="stable")
    done, whose = done[order], whose[order]
    owners, begin = np.unique(whose, return_index=True)
    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(done)).astype(np.int32)), pa.array(done.view(np.int64)))
    none = pa.nulls(len(key), pa.list_(pa.int64()))
    return pa.record_batch([pa.array(np.concatenate([key, W.mix(owners)]).view(np.int64)),
                            pa.array(np.concatenate([ref, owners]).view(np.int64)),
                            pa.concat_arrays([none, lists])], names=["key", "ref", "known"])


def _anchors(width: int):
    size = width - COVER_PERIOD + 1

    def of(batches):
        for b in batches:
            refs, keys = [], []
            ref = _u64(b.column("ref"))
            for row, texts in W.chunks(b.column("text")):
                w = W.split(texts)
                at, h = _cover_anchors(w, size)
                keys.append(h)
                refs.append(ref[row + w.doc[at]])
            if keys:
                yield _sent(np.concatenate(keys), np.concatenate(refs))
    return of


def _candidates(w: W.Words, shared: pa.Array, width: int) -> np.ndarray:
    """Starts of the windows that hold a shared anchor at a cover position."""
    at, h = _cover_anchors(w, width - COVER_PERIOD + 1)
    at = at[_member(h, w.doc[at], shared)]
    n = int(w.first[-1])
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.maximum(at - COVER_PERIOD + 1, w.first[w.doc[at]]), 1)
    np.add.at(step, at + 1, -1)
    ok = W.window_starts(w.first, width)
    return np.flatnonzero((np.cumsum(step)[: len(ok)] > 0) & ok)


def _windows(width: int):
    def of(batches):
        for b in batches:
            b = b.filter(pc.is_valid(b.column("anchors")))
            refs, keys = [], []
            ref = _u64(b.column("ref"))
            for row, texts in W.chunks(b.column("text")):
                w = W.split(texts)
                at = _candidates(w, b.column("anchors").slice(row, len(texts)), width)
                keys.append(W.window_hashes(w.hashes(), width)[at])
                refs.append(ref[row + w.doc[at]])
            if keys:
                yield _sent(np.concatenate(keys), np.concatenate(refs))
    return of


def _cut(width: int):
    def of(batches):
        for b in batches:
            copies = b.column("copies").to_numpy(zero_copy_only=False)
            out = [[], [], [], []]
            for row, texts in W.chunks(b.column("text")):
                w = W.split(texts)
                n = int(w.first[-1])
                ok = W.window_starts(w.first, width)
                h = W.window_hashes(w.hashes(), width)
                gone = ok & (copies[row + w.doc[: len(ok)]] > 1)
                lists = b.column("windows").slice(row, len(texts))
                if lists.null_count < len(lists):
                    at = _candidates(w, b.column("anchors").slice(row, len(texts)), width)
                    gone[at[_member(h[at], w.doc[at], lists)]] = True
                at = np.flatnonzero(gone)
                step = np.zeros(n + 1, np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + width, -1)
                cut = np.cumsum(step)[:n] > 0
                removed = np.concatenate([[0], np.cumsum(cut)])
                removed = removed[w.first[1:]] - removed[w.first[:-1]]
                total = np.diff(w.first)
                for i, t in enumerate(texts.to_pylist()):
                    kept = t.encode().split()
                    if removed[i]:
                        mask = cut[w.first[i]: w.first[i + 1]]
                        kept = [kept[k] for k in np.flatnonzero(~mask)]
                    kept = b" ".join(kept)
                    out[0].append(int(total[i]))
                    out[1].append(int(removed[i]))
                    out[2].append(kept.decode())
                    out[3].append(hashlib.sha256(kept).hexdigest())
            yield pa.record_batch([b.column("digest"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                                   pa.array(out[2], pa.string()), pa.array(out[3], pa.string())],
                                  names=["digest", "n_words", "n_removed", "kept_text", "kept_sha256"])
    return of


def cut_repeats(docs: DataFrame, text_col: str = "text", width: int = 35) -> DataFrame:
    """One row per distinct text: digest (SHA-256), n_words, n_removed,
    kept_text (kept words, one space between) and kept_sha256."""
    rows = docs.select(C.text_or_empty(text_col).alias("text")).select(
        F.xxhash64("text").alias("ref"), "text", F.lit(1).cast("long").alias("copies"))
    texts = (rows.mapInArrow(_combined, "ref long, text string, copies long").repartition("ref")
             .groupBy("ref", "text").agg(F.sum("copies").alias("copies"))
             .select("ref", "text", "copies", F.sha2("text", 256).alias("digest")))

    def shared(sent: DataFrame, name: str) -> DataFrame:
        # a text's settled keys travel under a key of their own
        both = sent.repartition("key").sortWithinPartitions("key").mapInArrow(_shared_or_known, runs.PAIR)
        return both.groupBy("ref").agg(F.collect_set("key").alias(name))

    anchors = shared(texts.mapInArrow(_anchors(width), _SENT), "anchors")
    marked = texts.join(anchors, "ref", "left")
    # no filter on the anchors here: it would give the texts another plan and a shuffle of their own
    windows = shared(marked.mapInArrow(_windows(width), _SENT), "windows")
    return marked.join(windows, "ref", "left").mapInArrow(
        _cut(width), "digest string, n_words long, n_removed long, kept_text string, kept_sha256 string")


def _shared_or_known(batches):
    """runs.shared_keys() over the rows without a list; lists as they are."""
    def plain():
        for b in batches:
            lists = b.column("known")
            has = pc.is_valid(lists)
            if lists.null_count < len(lists):
                some = b.filter(has)
                size = pc.list_value_length(some.column("known")).to_numpy(zero_copy_only=False)
                ready.append(pa.record_batch([some.column("known").flatten(), pa.array(np.repeat(
                    some.column("ref").to_numpy(), size))], names=["key", "ref"]))
                b = b.filter(pc.invert(has))
            yield b.select(["key", "ref"])

    ready: list = []
    for out in runs._shared(plain()):
        while ready:
            yield ready.pop()
        yield out
    while ready:
        yield ready.pop()


@register("op8_substring_dedup")
def op8_substring_dedup(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = cut_repeats(docs).select("digest", "n_words", "n_removed", "kept_sha256")
    ids = C.cut_lineage(docs.select("doc_id", F.sha2(C.text_or_empty("text"), 256).alias("digest")))
    return C.spread_join(ids, cut, "digest", "doc_id").select("doc_id", "n_words", "n_removed", "kept_sha256")
