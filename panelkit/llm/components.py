"""Connected components of a graph given as a table of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import discard
from . import common as C

#: Links that one task handles; fewer links in all need no more than one task.
LINKS_PER_TASK = 200_000


def _joined(batches):
    """(node, label) for each node of a task's links, the label the least node
    that these links reach."""
    links = [np.stack([b.column(i).to_numpy() for i in (0, 1)]) for b in batches]
    node, at = np.unique(np.concatenate(links or [np.zeros((2, 0), np.int64)], axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    label, before = np.arange(len(node)), None
    while before is None or (label != before).any():
        before = label.copy()
        for side in (a, b):
            np.minimum.at(label, before[side], np.minimum(before[a], before[b]))
        while (label != label[label]).any():
            label = label[label]
    yield pa.record_batch([node, node[label]], names=["node", "label"])


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of ``links`` (a long, b long): the label is
    the smallest node that links reach.  Each task first joins its own links,
    which is all there is to do if they fit one task; else what the tasks found
    are the links of the rounds.  In each round a node takes the least
    label among its neighbours, the root of its old label takes it too, and
    then each label is replaced by that label's own; it ends when a round
    changes nothing.  Every round is a table in shared storage, in as many
    parts as the links need."""
    parts = 1 + links.count() // LINKS_PER_TASK
    cut = lambda df: C.cut_lineage(df.coalesce(parts)).coalesce(parts)
    joined = links.select("a", "b").coalesce(parts).mapInArrow(_joined, "node long, label long")
    if parts == 1:
        return C.cut_lineage(joined)
    links = cut(joined.select(F.col("node").alias("a"), F.col("label").alias("b")))
    edges = cut(links.select("a", "b").union(links.select("b", "a")).coalesce(parts).distinct())
    v = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
            .withColumn("label", F.least("node", "label")))
    before = []  # the tables of the round before, which the next one no longer reads
    while True:
        near = edges.join(v, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = v.join(near, "node")
        root = step.groupBy(F.col("label").alias("node")).agg(F.min("near").alias("hook"))
        step = cut(step.join(root, "node", "left").select(
            "node", F.col("label").alias("was"), F.least("label", "near", "hook").alias("label")))
        up = step.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = cut(C.spread_join(step, up, "label", "node").select("node", F.least("label", "top").alias("label"), "was"))
        done = new.where("label <> was").isEmpty()
        discard(step, *before)
        if done:
            discard(edges, links)
            return new.select("node", "label")
        before, v = [new], new.select("node", "label")
