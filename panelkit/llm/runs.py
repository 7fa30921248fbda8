"""Neighbours in key order: which rows share their key with another row.

Rows are dealt by the key and sorted inside each partition by Spark; a task
then looks at one Arrow batch and the row before it, so that a key of any
number of rows needs no memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PAIR = "key long, ref long"


def _shared(batches):
    key, ref, known = (np.zeros(0, np.int64) for _ in range(3))
    for b in batches:
        if not b.num_rows:
            continue
        key = np.concatenate([key, b.column(0).to_numpy()])
        ref = np.concatenate([ref, b.column(1).to_numpy()])
        same = key[1:] == key[:-1]
        dup = np.concatenate([known > 0, np.zeros(len(key) - len(known), bool)])
        dup[1:] |= same
        dup[:-1] |= same
        out = dup[:-1]
        yield pa.record_batch([key[:-1][out], ref[:-1][out]], names=["key", "ref"])
        key, ref, known = key[-1:], ref[-1:], dup[-1:].astype(np.int64)
    if len(key) and known[0]:
        yield pa.record_batch([key, ref], names=["key", "ref"])


def shared_keys(rows: DataFrame) -> DataFrame:
    """The rows (key long, ref long) whose key another row has as well."""
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, PAIR)


def local_rows(key: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Combine before the shuffle.  Of a key with one row here the row goes on;
    of a key with more, two rows go on, which is enough for every other place
    to see that it is shared, and its rows are settled here and now.  Returns
    (key, ref) to send and (key, ref) settled, each (key, ref) once."""
    order = np.lexsort((ref, key))
    key, ref = key[order], ref[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    last = np.ones(len(key), bool)
    last[:-1] = new[1:]
    alone = new & last
    second = np.zeros(len(key), bool)
    second[1:] = new[:-1] & ~alone[:-1]
    send = new | second
    settled = ~alone
    settled[1:] &= new[1:] | (ref[1:] != ref[:-1])
    return key[send], ref[send], key[settled], ref[settled]
