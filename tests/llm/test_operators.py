"""The training-data operators on small tables against plain Python, with
nulls, empty and long texts, ties, repeated rows, empty tables and extra
columns of clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelkit.llm import (common, decontaminate, exact_dedup, jaccard_join, mixing, packing, revisits, secrets,
                          substring_dedup, toxicity, url_rules)
from panelkit.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, id int, size string, key string, _salt int, score string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(n))


def corpus():
    """(doc_id, text, source) with copies, near copies, shared passages and odd rows."""
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(30, 120)) for _ in range(25)]
    passage = sentence(rng, 50)
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(base)]
    for i in range(6):  # copies that differ in white space, and near copies
        rows.append((100 + i, base[i].replace(" ", " \t", 2), "s0"))
        w = base[10 + i].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((120 + i, " ".join(w), "s1"))
    for i in range(8):
        rows.append((200 + i, sentence(rng, 20) + " " + passage + " " + sentence(rng, 15), "s0"))
    rows += [(300, None, "s2"), (301, "", "s2"), (302, "  \n", None), (303, "one", "s3"), (304, "One two three", None),
             (305, "one two three", "s3"), (306, "be " * 400, "s0"), (307, "é " * 60 + "ü", "s1"),
             (308, sentence(rng, 20_000), "s1"), (400, base[3], "s0"), (400, base[3], "s0"), (None, base[4], "s0"), (None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", s, len(t or ""), 7, "x", "y", 3, "z") for d, t, s in corpus()]
    return spark.createDataFrame(rows, SHAPE).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


def words(t):
    return WORD.findall(t or "")


def test_word_hashes_tell_words_apart():
    import pyarrow as pa
    texts = [t or "" for _, t, _ in corpus()]
    w = W.split(pa.array(texts))
    got = [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end)]
    assert got == [x for t in texts for x in words(t)]
    assert np.diff(w.first).tolist() == [len(words(t)) for t in texts]
    h = w.hashes()
    assert len(set(h.tolist())) == len(set(got)) and len(set(zip(h.tolist(), got))) == len(set(got))
    grams = W.window_hashes(h, 3)[W.window_starts(w.first, 3)]
    want = [tuple(x[i:i + 3]) for x in map(words, texts) for i in range(len(x) - 2)]
    assert len(set(zip(grams.tolist(), want))) == len(set(want)) == len(set(grams.tolist()))
    part = W.split(pa.array(["zz", *texts, "yy"]).slice(1, len(texts)))  # a slice has offsets of its own
    assert (part.hashes() == h).all()


def test_word_count(docs):
    for r in docs.select("text", common.word_count("text").alias("n")).collect():
        assert r.n == len(words(r.text))


def test_exact_dedup(docs, empty):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    group = defaultdict(list)
    for d, t, _ in corpus():
        group[norm(t)].append(d)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(corpus())
    text = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in group.items()}
    for r in got:
        ids = text[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept) == set(text) and set(kept.values()) == {1}
    assert exact_dedup.exact_dedup(empty).count() == 0


SECRETS = [
    (1, "x password = 'hunter22' y"), (2, "secret=token\"=abcdef"), (3, "API_KEY: abc"), (4, None), (5, ""),
    (6, "é AKIA" + "A1" * 9 + " AKIASHORT " + "0af" * 8 + "\nüToken:=abcdefg" + "passwd =  \"zz/zz+z\""),
    (7, "secret=token=abcdef token = token : abcdef"), (8, "apikey=abcdef " * 50), (8, "apikey=abcdef " * 50), (None, "deadbeef" * 5),
]


def spans(t):
    out = []
    for k, (kind, p, ok) in enumerate([
            ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
            ("access", r"(?-i:AKIA[A-Z0-9]+)", lambda m: len(m[0]) >= 20), ("hex", r"(?-i:[0-9a-f]+)", lambda m: len(m[0]) >= 24)]):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(p, t or "", re.I | re.A) if ok(m)]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_secret_ledger(spark, empty):
    rows = spark.createDataFrame([(d, t, 1) for d, t in SECRETS], "path long, text string, blob int")
    ledger = common.scratch_path(spark, "test-ledger")
    got = [(r.path, r.s) for r in secrets.scan_history(rows, ledger).select("path", secrets.span_string("found").alias("s")).collect()]
    assert Counter(got) == Counter((d, spans(t)) for d, t in SECRETS)
    before = spark.read.parquet(ledger).count()
    more = rows.unionByName(spark.createDataFrame([(99, "token=" + "q" * 9, 0)], rows.schema))
    assert secrets.scan_history(more, ledger).count() == len(SECRETS) + 1
    added = spark.read.parquet(ledger).count() - before
    assert added == len(secrets.RULES)  # the new blob alone was scanned
    newer = [secrets.Rule(r.kind, r.version + (r.kind == "hex"), r.pattern, r.part, r.least, r.marks, r.hint) for r in secrets.RULES]
    again = secrets.scan_history(more, ledger, rules=newer)
    assert again.count() == len(SECRETS) + 1
    seen = {(r.kind, r.version) for r in spark.read.parquet(ledger).select("kind", "version").distinct().collect()}
    assert seen == {("assign", 1), ("access", 1), ("hex", 1), ("hex", 2)}
    assert secrets.scan_history(empty, common.scratch_path(spark, "test-ledger"), "doc_id").count() == 0


def test_secret_ledger_counts_and_repeats(spark):
    """A known blob is skipped, a repeated scan changes nothing, rows found
    twice count once, a long text and many rows without a path pass."""
    long = ("word " * 50_000) + "token=" + "q" * 9 + (" word" * 50_000)
    texts = [(d, t) for d, t in SECRETS] + [(20, long)] + [(None, "deadbeef" * 5)] * 30
    rows = spark.createDataFrame(texts, "path long, text string")
    ledger = common.scratch_path(spark, "test-ledger")

    def counts(df):
        return Counter((r.path, r.s, r.n_scanned, r.n_skipped) for r in df.withColumn(
            "s", secrets.span_string("found")).select("path", "s", "n_scanned", "n_skipped").collect())

    first = counts(secrets.scan_history(rows, ledger, scan="one"))
    assert first == Counter((d, spans(t), 3, 0) for d, t in texts)
    stored = spark.read.parquet(ledger).count()
    assert counts(secrets.scan_history(rows, ledger, scan="one")) == first
    assert spark.read.parquet(ledger).count() == stored
    newer = [replace(r, version=r.version + (r.kind == "hex")) for r in secrets.RULES]
    assert counts(secrets.scan_history(rows, ledger, rules=newer, scan="two")) == Counter((d, spans(t), 1, 2) for d, t in texts)
    # two scans of one blob at the same time leave equal rows under two names
    spark.read.parquet(f"{ledger}/scan=one").write.parquet(f"{ledger}/scan=other")
    assert counts(secrets.scan_history(rows, ledger, scan="three")) == Counter((d, spans(t), 0, 3) for d, t in texts)


def test_secret_query(spark, tmp_path):
    """Both deliveries against the patterns of Python; copies that came with
    the first are scanned for the new rule version alone."""
    texts = [(i, t) for i, (_, t) in enumerate(SECRETS * 6)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = secrets.op6_secret_ledger(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.spans for r in got} == {d: spans(t) for d, t in texts} and len(got) == len(texts)
    assert all(r.n_scanned + r.n_skipped == 3 for r in got)
    assert {r.n_skipped for r in got} == {0, 2}
    for r in got:
        kinds = Counter(x.split(":")[0] for x in r.spans.split(",") if x)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()


def test_substring_dedup(docs, empty):
    k = 35
    rows = corpus()
    count = Counter(tuple(w[i:i + k]) for w in (words(t) for _, t, _ in rows) for i in range(len(w) - k + 1))
    want = {}
    for _, t, _ in rows:
        w = words(t)
        cut = [False] * len(w)
        for i in range(len(w) - k + 1):
            if count[tuple(w[i:i + k])] > 1:
                cut[i:i + k] = [True] * k
        kept = " ".join(x for x, c in zip(w, cut) if not c)
        want[hashlib.sha256((t or "").encode()).hexdigest()] = (len(w), sum(cut), kept, hashlib.sha256(kept.encode()).hexdigest())
    got = {r.digest: (r.n_words, r.n_removed, r.kept_text, r.kept_sha256) for r in substring_dedup.cut_repeats(docs).collect()}
    assert got == want
    assert substring_dedup.cut_repeats(empty).count() == 0


def test_difference_cover():
    v = substring_dedup.COVER_PERIOD
    assert {(a - b) % v for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(v))


def jaccard_brute(rows, k, num, den):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t, _ in rows:
        w = words((t or "").translate(low))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                root[find(i)] = find(j)
    comp = defaultdict(list)
    for i, (d, _, _) in enumerate(rows):
        comp[find(i)].append(d)
    return [(d, len(sets[i]), min((x for x in comp[find(i)] if x is not None), default=None)) for i, (d, _, _) in enumerate(rows)]


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80)])
def test_jaccard_join(docs, empty, k, num):
    got = jaccard_join.link_components(docs, k=k, num=num)
    want = jaccard_brute(corpus(), k, num, 100)
    assert Counter(map(tuple, got.collect())) == Counter(want)
    if k == 5:
        kept = jaccard_join.keep_one(docs, k=k, num=num)
        assert kept.columns == docs.columns
        ids = Counter(r.doc_id for r in kept.collect())
        assert {i for i in ids if i is not None} == {c for d, _, c in want if c is not None and c == d} and max(
            n for i, n in ids.items() if i is not None) == 1 and ids[None] == 2
        assert jaccard_join.link_components(empty).count() == 0 and jaccard_join.keep_one(empty).count() == 0


def test_jaccard_join_of_a_large_family(spark):
    """Near copies of one text in a row: each links with the next ones only."""
    rng = random.Random(3)
    w = sentence(rng, 100).split()
    rows = []
    for i in range(150):
        w[(7 * i) % 100] = f"n{i}"
        rows.append((i, " ".join(w), "s"))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    assert Counter(map(tuple, jaccard_join.link_components(df).collect())) == Counter(jaccard_brute(rows, 4, 85, 100))


def test_bitmap_reaches_the_driver_in_words(spark, monkeypatch):
    size = 1 << 14
    bits = [0, 1, 63, 64, 65, 200, 200, size - 1, size + 5, -3] + list(range(1000, 3000, 3))
    sent = []
    frame = type(spark.range(0))
    for name in ("collect", "toArrow"):
        monkeypatch.setattr(frame, name, lambda self, f=getattr(frame, name): (sent.append(len(x := f(self))), x)[1])
    has = jaccard_join._bitmap(spark.createDataFrame([(b,) for b in bits], "bit long").repartition(3), 1000)
    assert 64 * len(has) == size and sum(sent) == len({b % size // 64 for b in bits})
    numbers = np.arange(-size, 2 * size)
    assert (jaccard_join._in_bitmap(has, numbers) == np.isin(numbers % size, np.array(bits) % size)).all()
    assert not jaccard_join._bitmap(spark.createDataFrame([], "bit long"), 0).any()


def test_keep_one_of_repeated_ids(spark):
    """Id 5 stands on a near copy of document 3, on a text alone, and twice on another; empty sets stay."""
    rng = random.Random(6)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    rows = [(3, a), (5, a + " end"), (5, b), (5, c), (5, c), (7, c), (8, ""), (8, None), (8, " "), (None, b)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, _cls int").repartition(3)
    for _ in range(2):
        kept = jaccard_join.keep_one(df, k=5, num=80)
        assert kept.columns == df.columns
        assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(
            [(3, a), (5, b), (5, c), (8, ""), (8, None), (8, " "), (None, b)])
        df = df.repartition(1)


ITEMS = [(0, "What is the capital of the northern province. It is Veldmark."), (1, "one two three four five six seven eight nine ten. eleven twelve"),
         (2, None), (3, ""), (4, "the of and to in is it on at by for with from up out as if so no be"), (4, "Red green blue?\nYellow brown.")]


def test_decontamination(spark, empty):
    rng = random.Random(9)
    rows = [(i, sentence(rng, 200)) for i in range(20)]
    rows += [(100, sentence(rng, 90) + " WHAT is the capital, of the northern province? it is veldmark " + sentence(rng, 90)),
             (101, "one two three four five six seven eight nine ten. eleven twelve"), (101, "red green blue yellow brown"),
             (102, "one two three unrelated words"), (103, None), (104, ""), (None, sentence(rng, 300) + " red green blue yellow brown")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, id int, item_id string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for size in (10, 2):  # one index, and several
        hits = decontaminate.benchmark_hits(df, bench, items_per_index=size).where("leaked").select("doc_id", "item_id").collect()
        assert Counter(map(tuple, hits)) == Counter([(100, 0), (101, 1), (101, 4), (None, 4)])
        left = decontaminate.drop_leaked(df, bench, items_per_index=size)
        assert left.columns == df.columns and left.count() == len(rows) - 4
    assert decontaminate.benchmark_hits(empty, bench).count() == 0
    assert decontaminate.benchmark_hits(df, bench.limit(0)).count() == 0 and decontaminate.drop_leaked(df, bench.limit(0)).count() == len(rows)


def test_blocks_of_items_change_no_score(spark):
    """The same pairs and scores from one index, from several by number, and from several by bytes."""
    rng = random.Random(12)
    items = [(i, sentence(rng, rng.randint(5, 30)) + " the same end of all. " + sentence(rng, 3)) for i in range(12)] + [(12, sentence(rng, 200)), (12, None)]
    rows = [(i, sentence(rng, 60) + " " + " ".join(t.split()[: rng.randint(4, 30)]) + " " + sentence(rng, 60)) for i, t in items if t]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")

    def hits(**kw):
        got = decontaminate.benchmark_hits(df, bench, threshold=0.3, **kw).collect()
        return Counter((r.doc_id, r.item_id, round(r.score, 9), r.leaked) for r in got)
    want = hits()
    assert len(want) > 5 and hits(items_per_index=3) == want and hits(bytes_per_index=500) == want
    left = Counter(map(tuple, decontaminate.drop_leaked(df, bench, threshold=0.3).collect()))
    assert Counter(map(tuple, decontaminate.drop_leaked(df, bench, threshold=0.3, bytes_per_index=500).collect())) == left


def test_wand_finds_all_above_threshold():
    rng = random.Random(4)
    vocabulary = [sentence(rng, 1) + str(i) for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary[: 10 + i]) for _ in range(rng.randint(3, 20)))) for i in range(40)]
    ix = decontaminate.build_index(items)
    for _ in range(200):
        terms = np.unique(np.array([rng.randrange(len(ix.vocab)) for _ in range(rng.randint(1, 40))]))
        score = defaultdict(float)
        for t in terms:
            for p in range(ix.at[t], ix.at[t + 1]):
                score[int(ix.item[p])] += float(ix.weight[p])
        for threshold in (0.2, 0.5, 0.8):
            got = dict(decontaminate.wand(ix, terms, threshold))
            want = {i: s for i, s in score.items() if s >= threshold - 1e-9}
            assert got.keys() == want.keys() and all(math.isclose(got[i], want[i]) for i in want)
    own = decontaminate.wand(ix, np.searchsorted(ix.vocab, np.unique(decontaminate._words([items[7][1]])[0])), 0.999)
    assert 7 in dict(own)


def mix_brute(rows, weights=(5, 2, 1), epochs=3):
    size = [len(words(t)) for _, t, _ in rows]
    source = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(source)}
    total = {s: sum(z for z, r in zip(size, rows) if r[2] == s) for s in source}
    budget, open_, target = sum(size), set(source), {}
    while True:
        left = budget - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > epochs * total[s]}
        if not over:
            return size, total, target | share
        target |= {s: epochs * total[s] for s in over}
        open_ -= over


def test_mixing(docs, empty):
    rows = corpus()
    size, total, target = mix_brute(rows)
    plan = mixing.taken_epochs(docs).collect()
    assert len(plan) == len(rows)
    assert Counter((r.id, r.size) for r in plan) == Counter((d, z) for (d, _, _), z in zip(rows, size))
    taken = defaultdict(int)
    for r in plan:
        assert 0 <= r.times <= 3 and r.source_size == total[r.source] and abs(r.target - target[r.source]) < 1e-6
        taken[r.source] += r.times * r["size"]
    assert sum(taken.values()) <= sum(size)
    longest = max(size)
    for s in target:
        assert abs(taken[s] - target[s]) <= longest
    again = {(r.id, r.source, r.upto): r.times for r in mixing.taken_epochs(docs.repartition(3)).collect()}
    assert again == {(r.id, r.source, r.upto): r.times for r in plan}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    want = Counter()
    for r in plan:
        want[(r.id, r.source, r["size"])] += r.times
    got = Counter((r.doc_id, r.source, len(words(r.text))) for r in out.collect())
    assert got == Counter({k: n for k, n in want.items() if n})
    assert mixing.taken_epochs(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(200):
        length = rng.randint(1, 40)
        sizes = np.array([rng.randint(1, length) for _ in range(rng.randint(0, 50))], int)
        plain = []
        for s in sorted(sizes.tolist(), reverse=True):
            fits = [(length - sum(b), i) for i, b in enumerate(plain) if length - sum(b) >= s]
            if fits:
                plain[min(fits)[1]].append(s)
            else:
                plain.append([s])
        got = packing.best_fit_decreasing(sizes, length)
        assert sorted(i for row in got for i in row) == list(range(len(sizes)))
        assert sorted(int(sizes[row].sum()) for row in got) == sorted(map(sum, plain))


def test_packing_round_trip(docs, empty):
    rows = packing.pack(docs, length=256, pool=3_000).collect()
    names = [(r.task, r.number) for r in rows]
    assert len(set(names)) == len(names)
    pieces = Counter()
    parts = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, np.uint16)
        assert len(ids) == 256 and r.cu_seqlens[-1] == r.n_tokens <= 256 and (ids[r.n_tokens:] == packing.END).all()
        assert len(packing.positions(r.cu_seqlens, r.position_start)) == r.n_tokens
        for a, b, p, d in zip(r.cu_seqlens[:-1], r.cu_seqlens[1:], r.position_start, r.doc_ids):
            parts[d].append((p, tuple(ids[a:b].tolist())))
            pieces[d] += 1
    decode = packing._encoding(packing.VOCABULARY).decode
    for d, t, _ in corpus():
        if d not in (None, 400):  # ids that occur once
            got = [x for _, seg in sorted(parts[d]) for x in seg]
            assert got[-1] == packing.END and decode(got[:-1]) == (t or "")
    assert pieces[400] == 2 * len({p for p, _ in parts[400]})
    assert packing.pack(empty).count() == 0


PAGES = [
    (1, "https://www.a.example.net/en/5"), (2, "https://a.example.NET/x"), (3, "http://b.example.com/de/1?x=1#f"), (4, "http://b.example.com/de"),
    (5, "ftp://q.org/fr/2"), (6, "http://org/fr/"), (7, None), (8, "no scheme"), (9, ""), (9, ""), (10, "http://net?x"), (11, "http://bad.io/ads/7.html?utm=1"),
    (12, "http://fine.io/read/8"), (None, "x://Y.NET/%20/"), (13, "http://example.network/"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "t") for i, u in PAGES], "page_id long, url string, host string, key string")
    shown = [(f"http://bad.io/ads/{i}.html", True) for i in range(30)] + [(f"http://fine.io/read/{i}", i % 10 == 0) for i in range(60)] + [(None, None)]
    got = url_rules.judge_urls(pages, spark.createDataFrame(shown, "url string, blocked boolean")).collect()
    assert len(got) == len(PAGES)

    def plain(u):
        if u is None or "://" not in u:
            return "", "", None
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [h + p for h, p, _ in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fit, key=len, default=None)
    want = Counter((i, *plain(u)) for i, u in PAGES)
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == want
    of = {r.page_id: r.verdict for r in got}
    assert (of[11], of[12], of[1], of[2], of[3], of[4], of[7]) == ("block", "allow", "allow", "block", "block", "allow", "allow")
    none = url_rules.judge_urls(pages, spark.createDataFrame([], "url string, blocked boolean")).collect()
    assert {r.verdict for r in none if r.rule is None} == {"allow"} and len(none) == len(PAGES)
    assert url_rules.judge_urls(pages.limit(0), spark.createDataFrame(shown, "url string, blocked boolean")).count() == 0


def test_url_rules_are_held_against_the_base_rate(spark):
    """Blocked: 15 of 100 pages, 10 of the 25 under /ads/ (confidence 0.4), and the only page of one host."""
    shown = [(f"http://a.io/ads/{i}", i < 10) for i in range(25)] + [(f"http://a.io/read/{i}", i < 4) for i in range(74)] + [("http://once.io/read/1", True)]
    pages = spark.createDataFrame([(1, "http://a.io/ads/99"), (2, "http://a.io/read/99"), (3, "http://once.io/read/99")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.confidence) for r in url_rules.judge_urls(pages, spark.createDataFrame(shown, "url string, blocked boolean")).collect()}
    assert got == {1: ("block", 0.4), 2: ("allow", None), 3: ("allow", None)}


def test_mined_rules_are_the_frequent_ones(spark):
    rng = random.Random(8)
    baskets = [(sorted(rng.sample("abcdef", rng.randint(1, 4))), rng.random() < 0.4) for _ in range(120)]
    got = {tuple(r.antecedent): (r.confidence, r.support) for r in url_rules.mine_rules(
        spark.createDataFrame(baskets, "tokens array<string>, blocked boolean"), 0.05, 0.45, 1.0).collect()}
    from itertools import combinations
    rate = sum(b for _, b in baskets) / len(baskets)
    fit = {}
    for k in range(1, 5):
        for c in combinations("abcdef", k):
            have = [b for t, b in baskets if set(c) <= set(t)]
            if have and sum(have) / len(baskets) >= 0.05 and sum(have) / len(have) >= 0.45 and sum(have) / len(have) / rate >= 1:
                fit[c] = (sum(have) / len(have), sum(have) / len(baskets))
    want = {c: v for c, v in fit.items() if not any(
        p in fit and fit[p][0] >= v[0] for p in (tuple(x for x in c if x != t) for t in c))}
    assert got.keys() == want.keys() and all(np.allclose(got[c], want[c]) for c in want)


def test_revisits(spark):
    h = {"etag": "a", "date": "1", "content-type": "text/html", "content-length": "9"}
    rec = lambda i, u, ts, kind, etag=None, lm=None, headers=None, status=None: (
        i, u, ts, kind, status or (200 if kind == "response" else 304), etag, lm, headers, f"p{i}" if kind == "response" else None)
    rows = [rec(1, "http://www.X.org/a/", 100, "response", "a", None, h), rec(2, "https://x.org/a?utm_source=f#z", 5 * 86_400, "revisit", "a", None, {"date": "2", "content-length": "0", "vary": "v"}),
            rec(3, "x.org/a", 50, "revisit", "a"), rec(4, "http://x.org/a", 100, "revisit", "a"), rec(5, "http://x.org/a", 200, "revisit", "b"),
            rec(6, "http://x.org/a", 150, "response", "c", "m", None, 404), rec(7, None, 10, "response", None, "m"), rec(8, None, 20, "revisit", "z", "m"),
            rec(9, None, None, "revisit"), rec(10, "http://x.org/a", 100, "response", "t"), rec(11, "http://x.org/a", 101, "revisit", None, None), rec(11, "http://x.org/a", 101, "revisit", None, None)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status int, etag string, last_modified string, headers map<string,string>, payload_sha256 string")
    got = defaultdict(list)
    for r in revisits.resolve_revisits(df).collect():
        got[r.record_id].append(r)
    one = {k: v[0] for k, v in got.items()}
    assert {k: (r.outcome, r.payload_from) for k, r in one.items()} == {
        1: ("full", 1), 2: ("mismatch", None), 3: ("missing", None), 4: ("missing", None), 5: ("mismatch", None), 6: ("full", 6), 7: ("full", 7),
        8: ("resolved", 7), 9: ("missing", None), 10: ("full", 10), 11: ("resolved", 10)}
    assert len(got[11]) == 2 and {r.page for k, r in one.items() if k not in (7, 8, 9)} == {"x.org/a"}
    df2 = df.where("record_id not in (10)")
    r = {r.record_id: r for r in revisits.resolve_revisits(df2).collect()}[2]
    assert (r.outcome, r.payload_from, r.payload_sha256) == ("resolved", 1, "p1")
    assert r.headers == {"etag": "a", "date": "2", "vary": "v", "content-type": "text/html", "content-length": "9"}
    assert revisits.resolve_revisits(df.limit(0)).count() == 0


def toxic_corpus(n):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.25
        w = sentence(rng, rng.randint(10, 80)).split()
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["zorkish", "zorkify", "zorkling", "idiot"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark, docs, empty):
    rows, labels = toxic_corpus(900)
    odd = [(5_000, None), (5_001, ""), (5_002, "!?" * 50), (None, "x"), (0, rows[0][1])]
    df = spark.createDataFrame([(d, t, "s") for d, t in rows + odd], "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (7_777, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(df.drop("score"), lab).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    true = {d: t for d, _, t in labels}
    held = [r for r in got if r.doc_id in true and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    hits = sum((r.score >= toxicity.CUT) == bool(true[r.doc_id]) for r in held)
    assert hits >= 0.97 * len(held)
    kept = toxicity.drop_toxic(df, lab)
    assert kept.columns == df.columns
    left = {r.doc_id for r in kept.collect()}
    assert sum(d in left for d, t in true.items() if not t) >= 0.98 * sum(not t for t in true.values())
    assert sum(d in left for d, t in true.items() if t) <= 0.05 * sum(true.values())
    assert {r.score for r in toxicity.score_documents(df.drop("score"), lab.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.score_documents(df.drop("score"), lab.limit(0)).count() == len(got)
    assert toxicity.score_documents(empty.drop("score"), lab).count() == 0


def test_pipeline_stages(spark):
    """Each stage against its own contract on the rows that it got."""
    d = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    docs = common.table(spark, d, "documents")
    columns = docs.columns
    kept = {}
    for name in list(stages)[:-1]:
        docs = common.cut_lineage(stages[name](spark, docs, d))
        assert docs.columns == columns
        kept[name] = docs
    ids = lambda name: [r.doc_id for r in kept[name].select("doc_id").collect()]
    rows = [(r.doc_id, r.text, r.source) for r in kept["toxicity"].collect()]
    want = {x for i, _, c in jaccard_brute(rows, 5, 80, 100) for x in [c] if c == i}
    assert Counter(ids("near_duplicates")) == Counter(want)
    items = [r.text for r in common.table(spark, d, "benchmark").collect()]
    text = {i: t for i, t, _ in rows}
    assert set(ids("near_duplicates")) - set(ids("decontamination")) == {
        i for i in ids("near_duplicates") if any(x in (text[i] or "") for x in items)}
    size, _, target = mix_brute([(i, text[i], s) for i, _, s in rows if i in set(ids("decontamination"))])
    mixed = Counter(ids("mix"))
    assert max(mixed.values()) <= 3 and sum(len(words(text[i])) * n for i, n in mixed.items()) <= sum(size)
    packed = stages["packing"](spark, docs, d).collect()
    got = Counter(i for r in packed for i, p in zip(r.doc_ids, r.position_start) if p == 0)
    assert got == mixed
