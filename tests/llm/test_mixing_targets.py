"""Targets of the mix against rounds of resharing in plain Python, and tables
whose rows share an id or have none."""

import re
from collections import Counter

import pytest

from panelkit.llm import mixing
from panelkit.llm.common import WORD

SHAPE = "doc_id long, text string, source string"


def reshared(sizes, weights=(5, 2, 1), epochs=3, budget=None):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = sum(sizes.values()) if budget is None else budget
    stopped = {}
    while True:
        free = [s for s in names if s not in stopped]
        share = (total - sum(stopped.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if weight[s] * share > epochs * sizes[s]]
        if not over:
            return {**stopped, **{s: weight[s] * share for s in free}}
        stopped.update({s: epochs * sizes[s] for s in over})


@pytest.mark.parametrize("sizes", [
    {f"s{i}": 1000 for i in range(7)},                       # equal sources
    {"a": 10, "b": 5000, "c": 5000, "d": 4000},              # one is used up
    {"a": 9000, "b": 20, None: 30, "d": 0},                  # all but one are used up
    {"a": 0, "b": 0},                                        # nothing to share
])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, n long, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    want = reshared(sizes)
    assert set(got) == set(want)
    for s in want:
        assert abs(got[s] - want[s]) < 1e-6, (s, got, want)
    assert abs(sum(got.values()) - sum(sizes.values())) < 1e-6


def test_copies_without_an_id(spark, monkeypatch):
    """A third of all rows are one text without an id, a third carry one id;
    buckets of few rows are filled many times over."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    rows = ([(None, "a b c", "s0")] * 300 + [(7, "d e", f"s{i % 2}") for i in range(300)]
            + [(1000 + i, "w " * (i % 9), f"s{i % 5}") for i in range(300)])
    docs = spark.createDataFrame(rows, SHAPE).repartition(6)
    size = lambda t: len(re.findall(WORD, t))
    plan = mixing.taken_epochs(docs).collect()
    assert Counter((r.id, r.source, r["size"]) for r in plan) == Counter((d, s, size(t)) for d, t, s in rows)
    seen = Counter((r.source, r.upto) for r in plan if r["size"])
    assert max(seen.values()) == 1  # each row has a place of its own
    total, taken = Counter(), Counter()
    for r in plan:
        total[r.source] += r["size"]
        taken[r.source] += r.times * r["size"]
        assert 0 <= r.times <= 3
    want = reshared(total)
    for s in want:
        assert abs(taken[s] - want[s]) <= 9
    want = Counter()
    for r in plan:
        want[(r.id, r.source, r["size"])] += r.times
    got = Counter((r.doc_id, r.source, size(r.text)) for r in mixing.mix(docs).collect())
    assert got == Counter({k: n for k, n in want.items() if n})
