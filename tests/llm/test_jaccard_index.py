"""The Jaccard join's index and its links, however the table is cut."""

import random

import numpy as np

from panelkit.llm import jaccard_join
from test_operators import sentence


def corpus():
    """Families of near copies, a passage that many documents share, copies and odd rows."""
    rng = random.Random(9)
    passage = sentence(rng, 40)
    rows = []
    for f in range(30):
        base = sentence(rng, rng.randint(40, 150)).split()
        for _ in range(rng.choice((1, 2, 6))):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice("xyz")
            rows.append(" ".join(w + passage.split() if f % 2 else w))
    rows += rows[:9] + [None, "", "one two", "One  two", "x " * 90]
    return [(i, t) for i, t in enumerate(rows)]


def shingles(t, k):
    w = (t or "").lower().split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_links_and_index_do_not_depend_on_the_partitions(spark):
    rows = corpus()
    sets = [shingles(t, 4) for _, t in rows]
    links = [sum(1 for j, y in enumerate(sets) if j != i and x and y and 100 * len(x & y) >= 85 * len(x | y))
             for i, x in enumerate(sets)]
    size = []
    for parts in (1, 40):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        ix = jaccard_join._index(df, "doc_id", "text", 4, 85, 100)
        size.append(ix.shared.groupBy("key").count().selectExpr("sum(count * (count - 1) / 2)").first()[0])
    assert abs(size[0] - size[1]) <= 0.1 * size[0]
    got = jaccard_join.link_counts(df).collect()
    assert {r.doc_id: (r.n_shingles, r.n_links) for r in got} == {i: (len(sets[i]), links[i]) for i, _ in rows}
    assert len({r.cls for r in got if r.cls is not None}) == len({frozenset(x) for x in sets if x})
    assert all((r.cls is None) == (not sets[r.doc_id]) for r in got)


def test_parity_bits_never_differ_in_more_places_than_the_sets(spark):
    rng = np.random.default_rng(5)
    for n in (1, 30, 300, 5000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64))
        for lost in (0, 1, n // 10, n):
            y = np.union1d(x[lost:], rng.integers(0, 1 << 63, lost, dtype=np.int64).astype(np.uint64))
            differ = sum((a ^ b).bit_count() for a, b in zip(
                jaccard_join._parities(x).view(np.uint64).tolist(), jaccard_join._parities(y).view(np.uint64).tolist()))
            assert differ <= len(np.setxor1d(x, y))
    rows = corpus()
    ix = jaccard_join._index(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 4, 85, 100)
    cls = [r.cls for r in ix.classes.select("cls").collect()]
    text = {r.cls: shingles(r.text, 4) for r in ix.texts_of(ix.classes.select("cls")).collect()}
    pairs = [(a, b) for a in cls for b in cls if a < b]
    stay = {tuple(r) for r in ix.likely(spark.createDataFrame(pairs, "a long, b long")).collect()}
    links = {(a, b) for a, b in pairs if 100 * len(text[a] & text[b]) >= 85 * len(text[a] | text[b])}
    assert links and links <= stay and len(stay) < len(pairs) / 4


def family(copies, words=700):
    """Near copies of one text, each with edits of its own."""
    rng = random.Random(4)
    base = sentence(rng, words).split()
    rows = []
    for i in range(copies):
        w = list(base)
        for _ in range(2 + i % 30):
            w[rng.randrange(words)] = f"{rng.choice('xyz')}{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    return rows


def test_rows_of_the_pair_steps_are_bounded(spark):
    rows = family(60)
    sets = [shingles(t, 4) for _, t in rows]
    links = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and 100 * len(x & y) >= 85 * len(x | y)}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ix = jaccard_join._index(df, "doc_id", "text", 4, 85, 100)
    near = ix.shared.mapInArrow(jaccard_join._near_pairs(85, 100), "prev long, grp long, k long, far long, p long")
    looked = near.selectExpr("sum(k)").first()[0]
    assert 0 < looked <= 2 * jaccard_join.LOOKING * jaccard_join.REACH * len(rows) < ix.shared.count() * jaccard_join.REACH
    # groups whose parity bits rule a link out do not come out of the index join
    odd = {r.grp: (r.n, r.odd) for r in ix.classes.collect()}
    differ = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(odd[a][1], odd[b][1]))
    pairs = ix.group_pairs(ix.shared).collect()
    assert len(odd) == len(rows) and len(links) <= len(pairs)
    assert all(185 * (odd[r.g][0] + odd[r.h][0] - differ(r.g, r.h)) >= 170 * (odd[r.g][0] + odd[r.h][0]) for r in pairs)
    got = {r.doc_id: r.component_id for r in jaccard_join.link_components(df).collect()}
    least = list(range(len(rows)))
    for _ in rows:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    assert got == dict(enumerate(least)) and len(set(least)) > 1
    assert {r.doc_id: r.n_links for r in jaccard_join.link_counts(df).collect()} == {i: sum(i in p for p in links) for i in range(len(rows))}
