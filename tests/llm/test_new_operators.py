"""Collocations, line quality and tokenizer alignment against plain Python."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelkit.llm import alignment, collocations, line_quality
from panelkit.llm import words as W

SHAPE = "doc_id long, text string, lang string, source string, score string, n long, chunk string"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(d, t, g, "s", "x", 1, "y") for d, t, g in rows], SHAPE).repartition(parts)


# ---- collocations

def phrase_corpus():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)] + ["Élan", "a|b"]
    rows = []
    for i in range(150):
        out = []
        for _ in range(rng.randint(0, 40)):
            out.append(rng.choice(vocab) + rng.choice(["", "", "", ".", ", ", "\n", "!\x0b"]))
            if rng.random() < 0.3:
                out.append("New  York\tCity Hall of" if rng.random() < 0.7 else "new york times")
        rows.append((i, " ".join(out), rng.choice(["en", "en", "de", None])))
    return rows + [(900, None, "en"), (901, "", "en"), (902, "..;;\n", "fr"), (903, "be " * 3000, "en"), (904, "x y z " * 500, "de"),
                   (None, rows[3][1], rows[3][2]), (7, rows[7][1], rows[7][2])]


def phrases_brute(rows, least, best):
    f, n = defaultdict(Counter), Counter()
    for _, t, g in rows:
        g = g or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[g] += len(w)
            for k in range(1, 6):
                f[g].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = set()
    for g, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for q, b in cand.items()):
                continue
            s, k = min((1000 * a * n[g] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), a, c[p[:k]], c[p[k:]], n[g], s))
        for r, x in enumerate(sorted(rows)[:best], 1):
            out.add((g, r, x[2].decode(), *x[3:]))
    return out


def test_collocations(spark, monkeypatch):
    monkeypatch.setattr(collocations, "TRIGGER", 3)
    rows = phrase_corpus()
    for least, best in ((5, 30),):
        got = collocations.collocations(frame(spark, rows), least=least, best=best)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert {tuple(r) for r in got.collect()} == phrases_brute(rows, least, best)
    assert collocations.collocations(frame(spark, [])).count() == 0


def test_scores_pass_64_bits(spark):
    """The arithmetic of the score on counts whose products pass 64 bits."""
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    a, n, l, r = 10**15 + 7, 10**17 + 3, 10**16 + 1, 10**15 + 9
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in (("a", a), ("n", n), ("l", l), ("r", r))])
    over = (F.lit(1000).cast("decimal(4,0)") * whole("a")).cast("decimal(20,0)") * whole("n")
    got = row.select(over.alias("_o"), (whole("l") * whole("r")).alias("_u")).select(F.expr("_o div _u")).first()[0]
    assert got == 1000 * a * n // (l * r)


def test_each_occurrence_is_counted_once_whatever_the_chunks():
    text = "a b c a b c d. " * 40 + "x " * 300
    out = list(collocations._parse([pa.record_batch([pa.array([text, None, ""]), pa.array(["en"] * 3)], names=["text", "lang"])]))
    own = sum(o * f for b in out for o, f in zip(b.column("own").to_pylist(), b.column("freq").to_pylist()))
    assert own == len(re.findall(r"[^\s.]+", text))


# ---- line quality

def plain_shares(line):
    ws = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", line)]
    b = b"".join(ws)
    letter = lambda x: 65 <= x <= 90 or 97 <= x <= 122 or x >= 128
    sign = lambda x: 33 <= x < 127 and not letter(x) and not 48 <= x <= 57
    letters = sum(map(letter, b))
    return [sum(65 <= x <= 90 for x in b) / max(letters, 1), sum(map(sign, b)) / len(b), sum(48 <= x <= 57 for x in b) / len(b),
            sum(not any(map(letter, w)) for w in ws) / len(ws), sum(len(w) > 2 and sign(w[-1]) and sign(w[-2]) for w in ws) / len(ws),
            sum(x == y for x, y in zip(ws, ws[1:])) / len(ws), 1 - len(set(ws)) / len(ws)]


LINES = ["A plain line of words, and more.", "BUY!! NOW!! 99", "a | b | c |", "go go go go", "é à ü", "x"]


def test_line_features():
    texts = ["\n".join(LINES), "", " \n\n ", LINES[1] + "\n\n" + LINES[0]]
    x, weight, first = line_quality.lines(pa.array(texts))
    assert first.tolist() == [0, 6, 6, 6, 8]
    want = [plain_shares(s) for s in LINES + [LINES[1], LINES[0]]]
    n = line_quality.SHARES
    assert np.allclose(x[:, :n], want)
    assert np.allclose(x[:, n: 2 * n], np.maximum(np.array(want) - 0.1, 0))
    before = x[:, line_quality.OWN: line_quality.OWN + n]
    after = x[:, line_quality.OWN + n: line_quality.OWN + 2 * n]
    assert np.allclose(before[1:6], want[:5]) and not before[[0, 6]].any()
    assert np.allclose(after[:5], want[1:6]) and not after[[5, 7]].any()
    assert weight.tolist()[:2] == [len(LINES[0].replace(" ", "")), len(LINES[1].replace(" ", ""))]


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(1)
    first = np.array([0, 4, 4, 5, 11])
    x = rng.normal(size=(11, line_quality.FEATURES)) * 0.3
    params = rng.normal(size=line_quality.SIZE)
    y = rng.integers(0, 2, 11)
    chain = line_quality.Chain(x, first, params)
    emit, step = x @ params[:line_quality.FEATURES], np.array([[0, params[-3]], [params[-2], params[-1]]])
    value = 0.0
    for a, b in zip(first[:-1], first[1:]):
        if a == b:
            continue
        score = {}
        for z in itertools.product((0, 1), repeat=b - a):
            score[z] = sum(emit[a + i] * z[i] for i in range(b - a)) + sum(step[z[i], z[i + 1]] for i in range(b - a - 1))
        total = sum(map(math.exp, score.values()))
        for i in range(b - a):
            p = sum(math.exp(s) for z, s in score.items() if z[i]) / total
            assert abs(p - chain.good[a + i]) < 1e-9
        value += score[tuple(y[a:b].tolist())] - math.log(total)
    got, slope = chain.likelihood(y)
    assert abs(got - value) < 1e-9
    for i in [0, 5, line_quality.FEATURES, line_quality.FEATURES + 1, line_quality.SIZE - 1]:
        move = np.zeros(line_quality.SIZE)
        move[i] = 1e-5
        up, down = (line_quality.Chain(x, first, params + s * move).likelihood(y)[0] for s in (1, -1))
        assert abs((up - down) / 2e-5 - slope[i]) < 1e-5
    far = line_quality.Chain(np.tile(x, (3000, 1)), np.arange(0, 33001, 11000), params)  # long chains stay finite
    assert np.isfinite(far.good).all() and np.isfinite(far.likelihood(np.tile(y, 3000))[0])


def test_line_quality_learns(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["the", "of", "house", "river", "green", "walk"]) + str(rng.choice("abc")) for _ in range(12)) + "."
    bad = lambda: " ".join(rng.choice(["BUY", "NOW", "FREE"]) + "!!" for _ in range(12))
    rows, labels = [], []
    for i in range(160):
        k = i % 2
        body = [good() for _ in range(rng.randint(1, 4))] + ([] if k else [bad() for _ in range(6)])
        rows.append((i, "\n".join(body), "en"))
        labels.append((i, k if i % 40 else None))
    rows += [(900, None, "en"), (901, "", "en"), (902, " \n", "en"), (903, (good() + "\n") * 4000, "en"), (None, good(), "en"), (3, rows[3][1], "en")]
    docs = frame(spark, rows)
    lab = spark.createDataFrame(labels + [(5000, 1), (None, 1), (9, 7)], "doc_id long, quality int")
    model = line_quality.fit(docs, lab, ~line_quality.held_out("doc_id"))
    got = model.score(docs)
    assert got.columns == [c for c in docs.columns if c != "score"] + ["score"]
    score = {r.doc_id: r.score for r in got.collect()}
    for i in range(160):
        assert (score[i] >= 0.3) == (i % 2 == 1), (i, score[i])
    assert score[900] == score[901] == score[902] == model.prior and score[903] > 0.5 and score[None] > 0.5
    assert line_quality.fit(docs, lab.where("quality = 1"), F.lit(True)).score(docs).select("score").distinct().collect()[0][0] == 1.0
    assert line_quality.score_documents(frame(spark, []), lab.limit(0)).count() == 0


# ---- alignment

TEXTS = ["plain words here", " lead", "two  spaces   three\n\ntabs\t x", "é ünï 日本語 🙂 x", "<|endoftext|> </s> <unk> a", "don't we'll 123 4567", "",
         None, "a▁b", "trailing  ", "x  y 　 z   w", "AKIA99 == {}[]", "word " * 3000, " ", "\n", "naïve café" * 50, "\x00\x01 zero"]


def encoded(texts):
    from tokenizers import Tokenizer
    import sentencepiece
    a = Tokenizer.from_file(alignment.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)
    letters = {v: k for k, v in alignment._byte_alphabet().items()}
    back = {v: k for k, v in letters.items()}
    vocab = {i: bytes(back[c] for c in t) for t, i in a.get_vocab().items()}
    for t in texts:
        if not t:
            yield [], []
            continue
        x = [(i, vocab[i]) for i in a.encode(" " + t, add_special_tokens=False).ids]
        y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)]
        want = (" " + t).encode()
        ok = b"".join(s for _, s in x) == want == b"".join(s for _, s in y)
        yield (x, y) if ok else ([], [])


def ranges(tokens):
    out, at = [], 0
    for i, s in tokens:
        out.append((i, at, at + len(s)))
        at += len(s)
    return out


def test_alignment(spark):
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "en"), (3, TEXTS[3], "en")]
    sides = [tuple(map(ranges, x)) for x in encoded([t for _, t, _ in rows])]
    count = Counter((i, j) for x, y in sides for i, _, e in x for j, _, f in y if e == f)
    best = defaultdict(int)
    for (_, j), c in count.items():
        best[j] = max(best[j], c)
    want = Counter()
    for (d, _, _), (x, y) in zip(rows, sides):
        ends = sorted({e for _, _, e in x} & {f for _, _, f in y})
        links = [(i, j) for i, _, e in x for j, _, f in y if e == f]
        parts, low = [], 0
        for e in ends:
            parts.append(",".join(str(i) for i, _, z in x if low < z <= e) + "|" + ",".join(str(j) for j, _, z in y if low < z <= e))
            low = e
        digest = hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else ""
        want[(d, len(x), len(y), len(ends), len(links), digest, sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links))] += 1
    docs = frame(spark, rows)
    got = alignment.align(docs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert Counter(map(tuple, got.collect())) == want
    some = docs.where("doc_id < 8 AND doc_id <> 3")
    for kind in ("overlap", "group"):
        want = set()
        for (d, _, _), (x, y) in zip(rows[:8], sides):
            ends = sorted({e for _, _, e in x} & {f for _, _, f in y})
            of = lambda e: next(k for k, z in enumerate(ends) if e <= z)
            if d != 3:
                for (p, (i, b, e)), (q, (j, c, f)) in itertools.product(enumerate(x), enumerate(y)):
                    both = min(e, f) - max(b, c)
                    if both > 0 if kind == "overlap" else of(e) == of(f):
                        want.add((d, p, q, i, j, both if kind == "overlap" else 1))
        assert {tuple(r) for r in alignment.links(some, kind).collect()} == want
    with pytest.raises(ValueError):
        alignment.links(some, "other")
    assert alignment.align(frame(spark, [])).count() == 0


def test_parts_give_the_tokens_of_whole_texts():
    """Each chunk of random texts, cut at blanks, against both libraries; the cache forgets in between."""
    rng = random.Random(3)
    signs = ["a", "the", "Ünder", " ", "  ", "\n", "\t", " ", " ", "日本", "🙂", "'s", "12", "...", "\u0085", "<s>", "é", "\x1c"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    e = alignment.Encoders(alignment.BYTE_BPE, alignment.PIECE_BPE)
    assert e.by_parts
    for lot in (texts[:200], texts[200:], texts[:100]):
        a, n_a, b, n_b = e.encode(pa.array(lot))
        got = list(zip(np.split(a, np.cumsum(n_a)[:-1]), np.split(b, np.cumsum(n_b)[:-1])))
        for (x, y), (p, q) in zip(encoded(lot), got):
            assert [i for i, _ in x] == p.tolist() and [i for i, _ in y] == q.tolist()


def test_sparse_product():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.integers(0, 3, (rng.integers(1, 6), 5)), rng.integers(0, 3, (5, rng.integers(1, 6)))

        def csr(m):
            row, column = np.nonzero(m)
            return alignment.CSR(np.concatenate([[0], np.cumsum((m != 0).sum(axis=1))]), column, m[row, column], m.shape[1])
        got = csr(a).times(csr(b))
        dense = np.zeros((a.shape[0], b.shape[1]), int)
        dense[got.row, got.column] = got.value
        assert (dense == a @ b).all()
        flip = csr(a).transposed()
        dense = np.zeros(a.T.shape, int)
        dense[flip.row, flip.column] = flip.value
        assert (dense == a.T).all()
    wide = W.ranges(np.array([3, 0, 7]), np.array([2, 0, 1]))
    assert wide.tolist() == [3, 4, 7]
