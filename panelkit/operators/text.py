"""Text jobs: article extraction from HTML, cleaning, date repair, listing
filter, chunking, chunk scoring, score ranking, embedding top-k, score/time
clustering and grid-density clustering (T1-T10).

Everything runs on whole texts.  Cleaning, dates and chunking are built-in
string / regex / array functions (JVM, codegen); only HTML parsing runs in
Python (``mapInPandas`` over Arrow batches, stdlib ``html.parser``).
"""

from __future__ import annotations

from collections.abc import Sequence
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from .. import dims
from ..session import cut_lineage, run_concurrently
from .panel import grid

LISTING_MAX_NEWLINES = 100
URL_DATE = r"(\d{4})/(\d{2})/(\d{2})"
TEXT_DATE = r"\((\d+)°* (\w+) (\d{4})\)"


class _Extractor(HTMLParser):
    """Collects <title>, and the text of the first div.articolo, the first
    div.story__text and <body> (script / style text excluded)."""

    def __init__(self, classes: Sequence[str]):
        super().__init__(convert_charrefs=True)
        self.classes = list(classes)
        self.title: list[str] = []
        self.bufs: dict[str, list[str]] = {c: [] for c in self.classes}
        self.bufs["body"] = []
        self.open: list[list] = []  # [name, depth] of captures in progress
        self.done: set[str] = set()
        self.stack: list[str] = []
        self.in_title = False
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.stack.append(tag)
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "title":
            self.in_title = True
        if tag == "body" and "body" not in self.done:
            self.open.append(["body", len(self.stack)])
        if tag == "div":
            cls = (dict(attrs).get("class") or "").split()
            for c in self.classes:
                if c in cls and c not in self.done and all(o[0] != c for o in self.open):
                    self.open.append([c, len(self.stack)])

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.skip:
            self.skip -= 1
        if tag == "title":
            self.in_title = False
        if tag in self.stack:
            while self.stack:
                depth = len(self.stack)
                top = self.stack.pop()
                for o in [o for o in self.open if o[1] == depth]:
                    self.open.remove(o)
                    self.done.add(o[0])
                if top == tag:
                    break

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        if self.skip:
            return
        for name, _ in self.open:
            self.bufs[name].append(data)


def _extract_batches(classes: Sequence[str], id_col: str, html_col: str, url_col: str):
    def run(batches):
        for pdf in batches:
            rows = []
            for pid, html, url in zip(pdf[id_col], pdf[html_col], pdf[url_col]):
                p = _Extractor(classes)
                try:
                    p.feed(html or "")
                    p.close()
                except Exception:  # malformed markup: keep what was parsed
                    pass
                body = None
                for name in [*classes, "body"]:
                    if p.bufs[name] or name in p.done:
                        body = "".join(p.bufs[name])
                        break
                rows.append((pid, url, "".join(p.title).strip(), body))
            yield pd.DataFrame(rows, columns=[id_col, url_col, "title", "raw_text"])
    return run


def extract_articles(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", url_col: str = "url",
                     classes: Sequence[str] = ("articolo", "story__text")) -> DataFrame:
    """Title, date from the URL (yyyy/mm/dd -> yyyy-mm-dd, else the
    sentinel) and the article text: first div of the given classes in order,
    else <body>.  Text is then cleaned with :func:`clean_text`."""
    schema = f"{id_col} {dict(pages.dtypes)[id_col]}, {url_col} string, title string, raw_text string"
    ext = pages.select(id_col, html_col, url_col).mapInPandas(_extract_batches(classes, id_col, html_col, url_col),
                                                             schema)
    date = F.when(F.col(url_col).rlike(URL_DATE),
                  F.regexp_replace(F.regexp_extract(F.col(url_col), URL_DATE, 0), "/", "-")) \
        .otherwise(F.lit(dims.DATE_SENTINEL))
    return ext.select(id_col, url_col, "title", date.alias("date"), clean_text("raw_text").alias("text"))


#: The characters that windows-1252 has for the bytes 0x80 to 0x9F, and those bytes as control characters.
_HIGH = {bytes([b]).decode("cp1252"): chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_TAIL = "[\u0080-\u00bf" + "".join(_HIGH) + "]"
_SHAPED = f"[\u00c2-\u00df]{_TAIL}|[\u00e0-\u00ef]{_TAIL}{{2}}|[\u00f0-\u00f4]{_TAIL}{{3}}"


def fix_mojibake(x: F.Column) -> F.Column:
    """UTF-8 bytes that were read as a one-byte charset: each run of characters
    that has the shape of one UTF-8 character is encoded back to its bytes
    and decoded as UTF-8, and stays as it is if that is not valid."""
    pieces = F.regexp_extract_all(x, F.lit(f"(?s)(?:{_SHAPED})|[^\u00c2-\u00f4]+|."), F.lit(0))

    def back(piece):
        raw = F.encode(F.translate(piece, "".join(_HIGH), "".join(_HIGH.values())), "ISO-8859-1").cast("string")
        return F.when(piece.rlike(f"^(?:{_SHAPED})$"), F.when(F.is_valid_utf8(raw), raw).otherwise(piece)).otherwise(piece)
    return F.when(x.rlike(_SHAPED), F.array_join(F.transform(pieces, back), "")).otherwise(x)


def clean_text(c) -> F.Column:
    """Strip, tab / CR -> LF, runs of LF -> one, runs of spaces -> one,
    mojibake repaired."""
    x = F.col(c) if isinstance(c, str) else c
    x = F.regexp_replace(x, r"^[\s\p{Z}\x{85}\x1c-\x1f]+|[\s\p{Z}\x{85}\x1c-\x1f]+$", "")  # as str.strip
    x = F.regexp_replace(x, r"[\t\r]", "\n")
    x = F.regexp_replace(x, r"\n{2,}", "\n")
    x = F.regexp_replace(x, r" {2,}", " ")
    return fix_mojibake(x)


def clean_title(c) -> F.Column:
    """Every character that is not a letter or digit becomes a space."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[^\p{L}\p{N}]", " ")


def repair_date(date: str, text: str) -> F.Column:
    """A sentinel date ('0000...') is replaced by the first '(d month yyyy)'
    found in the text: year-month-day with the Italian month number (12 when
    unknown) and the day as written; otherwise the sentinel stays."""
    m = F.create_map(*[x for k, v in dims.ITALIAN_MONTHS.items() for x in (F.lit(k), F.lit(f"{v:02d}"))])
    pat = "(?U)" + TEXT_DATE
    found = F.regexp_extract(F.col(text), pat, 0) != ""
    day = F.regexp_extract(F.col(text), pat, 1)
    month = F.coalesce(m[F.lower(F.regexp_extract(F.col(text), pat, 2))], F.lit(f"{dims.UNKNOWN_MONTH:02d}"))
    year = F.regexp_extract(F.col(text), pat, 3)
    fixed = F.concat_ws("-", year, month, day)
    return F.when(F.col(date).startswith("0000") & found, fixed).otherwise(F.col(date))


def as_date(c: str) -> F.Column:
    """Real date from 'yyyy-MM-d' text; the sentinel becomes NULL."""
    return F.to_date(F.when(~F.col(c).startswith("0000"), F.col(c)), "yyyy-M-d")


def newline_count(c: str) -> F.Column:
    return F.length(F.col(c)) - F.length(F.replace(F.col(c), F.lit("\n"), F.lit("")))


def drop_listing_pages(df: DataFrame, text: str, max_newlines: int = LISTING_MAX_NEWLINES) -> DataFrame:
    """T4: keep documents with fewer than ``max_newlines`` line breaks."""
    return df.filter(newline_count(text) < max_newlines)


def chunk_chars(df: DataFrame, id_col: str, text: str, size: int = 500, overlap: int = 0) -> DataFrame:
    """T5: character chunks of ``size`` starting every ``size - overlap``
    characters over the whole text: (id, chunk_no, chunk)."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    e = df.filter(F.length(text) > 0).select(id_col, text, F.posexplode(starts).alias("chunk_no", "__s"))
    return e.select(id_col, "chunk_no", F.substring(F.col(text), F.col("__s") + 1, size).alias("chunk"))


def chunk_tokens(df: DataFrame, id_col: str, text: str, size: int = 500, overlap: int = 25) -> DataFrame:
    """T5: whitespace-token chunks of ``size`` tokens with ``overlap`` tokens shared."""
    step = size - overlap
    toks = F.filter(F.split(F.col(text), r"\s+"), lambda t: t != "")
    d = df.select(id_col, toks.alias("__t")).filter(F.size("__t") > 0)
    starts = F.sequence(F.lit(0), F.size("__t") - 1, F.lit(step))
    e = d.select(id_col, "__t", F.posexplode(starts).alias("chunk_no", "__s"))
    return e.select(id_col, "chunk_no", F.array_join(F.slice("__t", F.col("__s") + 1, size), " ").alias("chunk"))


def lexicon_scores(chunks: DataFrame, id_col: str, text: str, lexicon: DataFrame, word: str = "word",
                   label: str = "label", salts: int = 64, small: int = 100_000) -> DataFrame:
    """T6 (lexicon scorer): per chunk, the share of its lower-cased word tokens
    found in each label's lexicon; per document the mean over its chunks.
    Output (id, label, score).

    Texts are exploded once.  A dictionary of up to ``small`` words goes to the
    texts, so that only a row for each set of labels in a chunk is shuffled.  A
    larger one is joined with counts of (document, chunk, word) and has ``salts``
    copies of each word, so that a word in every chunk is dealt to as many places."""
    t = chunks.select(id_col, "chunk_no", F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")).alias("w")) \
        .filter(F.col("w") != "")
    words = cut_lineage(lexicon.filter(F.col(word).isNotNull() & F.col(label).isNotNull())
                        .groupBy(F.col(word).alias("w")).agg(F.collect_set(label).alias("__labels")))
    if words.limit(small + 1).count() <= small:
        hit = t.join(F.broadcast(words), "w", "left").groupBy(id_col, "chunk_no", "__labels").agg(F.count(F.lit(1)).alias("__c"))
    else:
        n = t.groupBy(id_col, "chunk_no", "w").agg(F.count(F.lit(1)).alias("__c"))
        n = n.withColumn("__salt", F.pmod(F.xxhash64(id_col, "chunk_no"), F.lit(salts)).cast("int"))
        words = words.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        hit = n.join(words, ["w", "__salt"], "left").groupBy(id_col, "chunk_no", "__labels").agg(F.sum("__c").alias("__c"))
    per = cut_lineage(hit)  # a row for each set of labels in a chunk
    total = per.groupBy(id_col, "chunk_no").agg(F.sum("__c").alias("__n"))
    docs = total.groupBy(id_col).agg(F.count(F.lit(1)).alias("__chunks"))
    found = per.select(id_col, "chunk_no", "__c", F.explode("__labels").alias(label)) \
        .groupBy(id_col, "chunk_no", label).agg(F.sum("__c").alias("__h")).join(total, [id_col, "chunk_no"]) \
        .groupBy(id_col, label).agg(F.sum(F.col("__h") / F.col("__n")).alias("__s"))
    every = grid(docs, lexicon.select(label).filter(F.col(label).isNotNull()).distinct())
    return every.join(found, [id_col, label], "left").select(
        id_col, label, (F.coalesce(F.col("__s"), F.lit(0.0)) / F.col("__chunks")).alias("score"))


def train_text_model(docs: DataFrame, labels: DataFrame, id_col: str, text: str, targets: Sequence[str],
                     num_features: int = 1 << 18):
    """T6 (model scorer): one TF-IDF + logistic-regression pipeline per 0/1
    target, trained on the labelled documents.  Returns {target: model}."""
    train = docs.join(labels, id_col).select(id_col, F.col(text).alias("__text"), *[F.col(t).cast("double").alias(t) for t in targets])
    words = Pipeline(stages=[RegexTokenizer(inputCol="__text", outputCol="__tok", pattern=r"[^\p{L}\p{N}]+"),
                             HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=num_features)]).fit(train)
    train = cut_lineage(words.transform(train).select("__tf", *targets))  # texts are cut into words once for all targets
    weigh = IDF(inputCol="__tf", outputCol="__feat").fit(train)
    train = weigh.transform(train)

    def fit(t):
        return lambda: LogisticRegression(featuresCol="__feat", labelCol=t, maxIter=50, regParam=0.01).fit(train)
    fits = run_concurrently([fit(t) for t in targets], len(targets))
    return {t: PipelineModel(stages=[*words.stages, weigh, m]) for t, m in zip(targets, fits)}


def model_scores(chunks: DataFrame, id_col: str, text: str, models: dict) -> DataFrame:
    """Probability of each target per chunk; mean over chunks per document
    (id, one column per target)."""
    out, done = chunks.select(id_col, "chunk_no", F.col(text).alias("__text")), []
    for t, m in models.items():
        *words, last = m.stages
        if [s.uid for s in words] != done:  # models of one training share their words
            out, done = out.drop("__tok", "__tf", "__feat"), [s.uid for s in words]
            for s in words:
                out = s.transform(out)
        out = last.transform(out).withColumn(t, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    return out.groupBy(id_col).agg(*[F.avg(t).alias(t) for t in models])


def score_ranking(scores: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean of each score column x 100, ranked descending (label, mean_pct, rank)."""
    a = scores.agg(*[(F.avg(c) * 100).alias(c) for c in cols]).unpivot([], list(cols), "label", "mean_pct")
    return a.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_pct"), F.asc("label"))))


def cosine(a, b) -> F.Column:
    """Cosine similarity of two equal-length numeric arrays (double math)."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.try_divide(dot, na * nb)


def centroid(df: DataFrame, vec: str, max_dim: int = 100_000) -> list[float]:
    """Mean vector of an array column, aggregated per position by Spark; only
    the (bounded) vector reaches the driver."""
    e = df.select(F.posexplode(vec).alias("i", "v")).groupBy("i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    rows = e.orderBy("i").limit(max_dim + 1).collect()
    if len(rows) > max_dim:
        raise ValueError("vector dimension is not bounded")
    return [r["m"] for r in rows]


def semantic_top_k(vectors: DataFrame, id_col: str, vec: str, query: Sequence[float], k: int = 40) -> DataFrame:
    """Cosine similarity to the query vector, top k (ties by id)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    s = vectors.select(id_col, cosine(F.col(vec), q).alias("score"))
    top = s.orderBy(F.desc("score"), F.asc(id_col)).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc(id_col))))


def fit_lists(vectors: DataFrame, id_col: str, vec: str, lists: int = 32, sample: int = 20_000, seed: int = 5) -> list[list[float]]:
    """T8 (indexed form): centres of an inverted file, by K-means on the
    direction of at most ``sample`` vectors in hash order (the documented bound
    of what the fit reads); ``lists`` x dimension numbers reach the driver."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    v = F.col(vec).cast("array<double>")
    some = vectors.filter(v.isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample).select(unit(v).alias("v"))
    some = cut_lineage(some.filter(F.col("v").isNotNull()).select(array_to_vector("v").alias("features")))
    return [list(map(float, c)) for c in KMeans(k=lists, seed=seed, initMode="k-means||").fit(some).clusterCenters()]


def unit(v: F.Column) -> F.Column:
    """The vector at length 1 (null for a zero vector)."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(size > 0, F.transform(v, lambda x: x / size))


def _with_lists(centres: Sequence[Sequence[float]], vec: str, probes: int, name: str):
    m = np.array(centres)

    def of(batches):
        for d in batches:
            x = np.array(d[vec].tolist(), float).reshape(len(d), m.shape[1])
            d[name] = list(np.argsort(-(x @ m.T), axis=1, kind="stable")[:, :probes].astype(np.int32))
            yield d
    return of


def list_index(vectors: DataFrame, id_col: str, vec: str, centres: Sequence[Sequence[float]], salts: int = 16) -> DataFrame:
    """(id, unit vector, list, salt) of every row: its list is the centre of
    greatest inner product; a list's rows are dealt to ``salts`` places."""
    v = vectors.select(id_col, unit(F.col(vec).cast("array<double>")).alias("v")).filter(F.col("v").isNotNull())
    kind = dict(v.dtypes)[id_col]
    got = v.mapInPandas(_with_lists(centres, "v", 1, "lists"), f"`{id_col}` {kind}, v array<double>, lists array<int>")
    return cut_lineage(got.select(id_col, "v", F.col("lists")[0].alias("list"), F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int").alias("salt")))


def _best_of_block(k: int, at_once: int = 1 << 21):
    """Of one block of index rows (id, v, list) and one of queries (query, qv,
    lists): for each query its ``k`` best rows in its lists, ties by id (nulls
    first).  A matrix product finds the rows that may be among them; their
    scores are then added up dimension by dimension, so that equal vectors have
    equal scores wherever they stand.  About ``at_once`` scores are held."""
    near = 1e-9  # far above the product's rounding for vectors of length 1

    def of(rows, queries):
        name = rows.column_names[0]
        shape = pa.schema([("query", queries.schema.field("query").type), (name, rows.schema.field(name).type), ("score", pa.float64())])
        if not (rows.num_rows and queries.num_rows):
            return shape.empty_table()
        ids = rows.column(name).to_pandas()
        known = ids.notna().to_numpy()
        rank = np.full(len(ids), -1)
        rank[known] = np.unique(ids[known].to_numpy(), return_inverse=True)[1]
        flat = lambda t, c: pc.list_flatten(t.column(c)).to_numpy().reshape(t.num_rows, -1)
        v, q, lists, of_list = flat(rows, "v"), flat(queries, "qv"), flat(queries, "lists"), rows.column("list").to_numpy()
        least = np.full(len(q), -np.inf)  # no row below it is among a query's best
        best, held = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))], 0  # query, row, score

        def merged():
            x, y, score = (np.concatenate(z) for z in zip(*best))
            by = np.lexsort((rank[y], -score, x))
            x, y, score = x[by], y[by], score[by]
            place = np.arange(len(x)) - np.searchsorted(x, x)
            last = place == k - 1
            least[x[last]] = np.maximum(least[x[last]], score[last])
            return x[place < k], y[place < k], score[place < k]

        for at in np.unique(of_list):
            mine, asks = np.flatnonzero(of_list == at), np.flatnonzero((lists == at).any(axis=1))
            step = max(1, at_once // max(1, len(asks)))
            for lo in range(0, len(mine) if len(asks) else 0, step):
                some = mine[lo: lo + step]
                product = q[asks] @ v[some].T
                hit = product >= least[asks, None] - near
                many = np.flatnonzero(hit.sum(axis=1) > k)
                if len(many):
                    least[asks[many]] = np.maximum(least[asks[many]], np.partition(product[many], len(some) - k, axis=1)[:, len(some) - k] - near)
                    hit[many] = product[many] >= least[asks[many], None] - near
                x, y = np.nonzero(hit)
                x, y = asks[x], some[y]
                score = np.zeros(len(x))
                for d in range(q.shape[1]):
                    score += v[y, d] * q[x, d]
                best.append((x, y, score))
                held += len(x)
                if held > 2 * k * len(q):
                    best, held = [merged()], 0
        x, y, score = merged()
        return pa.table([queries.column("query").take(pa.array(x)), rows.column(name).take(pa.array(y)), pa.array(score)], schema=shape)
    return of


def indexed_top_k(index: DataFrame, queries: DataFrame, id_col: str, query_id: str, vec: str,
                  centres: Sequence[Sequence[float]], k: int = 40, probes: int = 8,
                  block: int = 1 << 16, ask: int = 1 << 12) -> DataFrame:
    """T8 (indexed form): (query, id, score, rank) of the ``k`` best rows in the
    ``probes`` nearest lists of each query, a stated set of query vectors.
    Blocks of about ``block`` index rows meet blocks of about ``ask`` queries,
    and each pair of blocks keeps its own best rows before they meet."""
    q = queries.select(F.col(query_id).alias("query"), unit(F.col(vec).cast("array<double>")).alias("v")).filter(F.col("v").isNotNull())
    q = q.mapInPandas(_with_lists(centres, "v", probes, "lists"), f"query {dict(q.dtypes)['query']}, v array<double>, lists array<int>")
    q = cut_lineage(q.select("query", F.col("v").alias("qv"), "lists"))
    asked, parts = 1 + q.count() // ask, 1 + index.count() // block
    deal = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("ask", deal(asked)).withColumn("part", all_of(parts))
    rows = index.select(id_col, "v", "list").withColumn("part", deal(parts)).withColumn("ask", all_of(asked))
    shape = f"query {dict(q.dtypes)['query']}, `{id_col}` {dict(index.dtypes)[id_col]}, score double"
    near = rows.groupBy("ask", "part").cogroup(q.groupBy("ask", "part")).applyInArrow(_best_of_block(k), shape)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc(id_col))
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query", id_col, "score", "rank")


def token_estimate(docs: DataFrame, text: str, factor: float = 1.5) -> DataFrame:
    """Total words of the retrieved documents and the token estimate (words x 1.5)."""
    w = F.size(F.filter(F.split(F.col(text), r"\s+"), lambda t: t != ""))
    return docs.agg(F.sum(w).alias("words")).withColumn("tokens_est", F.col("words") * factor)


def score_time_features(df: DataFrame, a: str, b: str, ts: str) -> DataFrame:
    """score = clip(a + b, 0, 1); date ordinal (days since 0001-01-01, +1);
    undated rows dropped."""
    d = df.filter(F.col(ts).isNotNull())
    return d.withColumns({"score": F.least(F.greatest(F.col(a) + F.col(b), F.lit(0.0)), F.lit(1.0)),
                          "ordinal": F.datediff(F.to_date(F.col(ts)), F.to_date(F.lit("0001-01-01"))) + 1})


def grid_density_clusters(df: DataFrame, id_col: str, x: str, y: str, eps: float, min_samples: int = 5,
                          min_cluster_size: int = 10) -> DataFrame:
    """T10 (re-aimed density clustering): points are binned in eps x eps cells;
    a cell is dense when its 3 x 3 neighbourhood holds >= min_samples points;
    clusters are connected components of adjacent dense cells (iterative
    minimum-label propagation on the cell graph, lineage cut each round);
    clusters with fewer than min_cluster_size points and points of sparse
    cells are noise (-1).  No point pairs are ever formed."""
    cells = df.select(id_col, F.floor(F.col(x) / eps).cast("long").alias("cx"),
                      F.floor(F.col(y) / eps).cast("long").alias("cy"))
    cnt = cells.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    offs = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = cnt.select("cx", "cy", "n", F.explode(offs).alias("o")) \
        .select((F.col("cx") + F.col("o.dx")).alias("tx"), (F.col("cy") + F.col("o.dy")).alias("ty"), "n")
    nb = spread.groupBy("tx", "ty").agg(F.sum("n").alias("nb"))
    dense = cnt.join(nb, (cnt.cx == nb.tx) & (cnt.cy == nb.ty)).filter(F.col("nb") >= min_samples) \
        .select("cx", "cy", "n")
    dense = cut_lineage(dense.withColumn("cid", F.col("cx") * F.lit(1 << 31) + F.col("cy")))
    nbr = dense.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("cid").alias("ncid"))
    edges = dense.select("cid", "cx", "cy", F.explode(offs).alias("o")) \
        .select("cid", (F.col("cx") + F.col("o.dx")).alias("nx"), (F.col("cy") + F.col("o.dy")).alias("ny"))
    edges = cut_lineage(edges.join(nbr, ["nx", "ny"]).select("cid", "ncid"))
    labels = dense.select("cid", F.col("cid").alias("label"))
    while True:
        # one hop of minimum-label propagation over adjacent dense cells ...
        nl = edges.join(labels.select(F.col("cid").alias("ncid"), F.col("label").alias("nl")), "ncid") \
            .groupBy("cid").agg(F.min("nl").alias("m"))
        hop = cut_lineage(labels.join(nl, "cid", "left").select(
            "cid", F.least(F.col("label"), F.coalesce(F.col("m"), F.col("label"))).alias("label")))
        # ... then pointer jumping: a cell takes the label of its label (same
        # component, never larger), so rounds grow with log(diameter)
        jump = hop.select(F.col("cid").alias("label"), F.col("label").alias("l2"))
        new = cut_lineage(hop.join(jump, "label", "left").select(
            "cid", F.least(F.col("label"), F.coalesce(F.col("l2"), F.col("label"))).alias("label")))
        changed = new.join(labels.withColumnRenamed("label", "old"), "cid") \
            .filter(F.col("label") != F.col("old")).limit(1).count()
        labels = new
        if changed == 0:
            break
    sizes = labels.join(dense.select("cid", "n"), "cid").groupBy("label").agg(F.sum("n").alias("size"))
    kept = sizes.filter(F.col("size") >= min_cluster_size).select(
        "label", (F.dense_rank().over(Window.orderBy("label")) - 1).alias("cluster_id"))  # one row per cluster
    lab = labels.join(kept, "label").join(dense.select("cid", "cx", "cy"), "cid") \
        .select("cx", "cy", F.col("cluster_id").alias("label"))
    return cells.join(lab, ["cx", "cy"], "left").select(
        id_col, "cx", "cy", F.coalesce(F.col("label"), F.lit(-1)).alias("cluster"))


def connected_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the least node that ``edges`` (a, b; both directions)
    reach.  Each round takes the least label of the neighbours and then the label
    of the label; it is stored, and rounds grow with log(diameter)."""
    v = cut_lineage(nodes.select("node", F.col("node").alias("label")))
    while True:
        near = edges.join(v, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hop = cut_lineage(v.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")))
        up = hop.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = cut_lineage(hop.join(up, "label", "left").select("node", "was", F.least("label", "top").alias("label")))
        if new.filter("label <> was").isEmpty():
            return new.select("node", "label")
        v = new.select("node", "label")


def density_clusters(df: DataFrame, id_col: str, x: str, y: str, eps: float, min_samples: int = 5,
                     min_cluster_size: int = 1) -> DataFrame:
    """DBSCAN.  A point with ``min_samples`` points within ``eps`` (its own
    included) is core; core points within ``eps`` of each other are one cluster;
    another point joins the cluster of the nearest core point within ``eps``
    (ties: least cluster).  Output (id, is_core, cluster), -1 for noise and for
    clusters below ``min_cluster_size``; points without coordinates are noise.

    Points lie in cells whose diagonal is ``eps``, so all points of a cell are
    within reach of each other: a cell with ``min_samples`` points is core as a
    whole, a cell with a core point is one node of the cluster graph, and a cell
    with fewer points has fewer than ``min_samples`` to compare with the 20 cells
    around it.  Pairs are thus in proportion to the points.  Cells are joined by
    their outermost core points first; only where two cells are still apart are
    their points compared, those near the other cell, each value once."""
    side = eps / 2**0.5
    pts = df.select(F.col(id_col).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    cell = lambda c: F.floor(F.col(c) / F.lit(side)).cast("long")
    pts = pts.withColumns({"cx": cell("x"), "cy": cell("y"), "row": F.monotonically_increasing_id()})
    pts = cut_lineage(pts)
    known = pts.filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    around = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) < 4 and (i, j) != (0, 0)]
    offs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in around]))
    within = lambda a, b: ((F.col(f"{a}x") - F.col(f"{b}x")) ** 2 + (F.col(f"{a}y") - F.col(f"{b}y")) ** 2) <= F.lit(eps * eps)

    def reaching(d, keep):
        """Rows of ``d`` (few in a cell) sent to the cells around them, as p-columns."""
        e = d.select("cx", "cy", *keep, offs.alias("o"))
        return e.select(*[F.col(c).alias(f"p{c}") for c in ("cx", "cy", *keep)], (F.col("cx") + F.col("o.i")).alias("cx"),
                        (F.col("cy") + F.col("o.j")).alias("cy"))
    count = known.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    placed = cut_lineage(known.join(count, ["cx", "cy"]))
    sparse = placed.filter(F.col("n") < min_samples)
    values = placed.groupBy("cx", "cy", "x", "y").agg(F.count(F.lit(1)).alias("m"))
    met = reaching(sparse, ["row", "x", "y", "n"]).join(values, ["cx", "cy"]).filter(within("p", "")) \
        .groupBy(F.col("prow").alias("row")).agg(F.sum("m").alias("met"))
    core = sparse.join(met, "row", "left").filter(F.col("n") + F.coalesce("met", F.lit(0)) >= min_samples).select("row", "cx", "cy", "x", "y")
    core = cut_lineage(placed.filter(F.col("n") >= min_samples).select("row", "cx", "cy", "x", "y").unionByName(core))

    # the graph of cells with core points, by their outermost points, then by the others
    node = F.xxhash64("cx", "cy")
    cells = cut_lineage(core.select("cx", "cy").distinct().withColumn("node", node))
    ends = [F.col("x"), -F.col("x"), F.col("y"), -F.col("y"), F.col("x") + F.col("y"), -F.col("x") - F.col("y"), F.col("x") - F.col("y"), F.col("y") - F.col("x")]
    outer = core.groupBy("cx", "cy").agg(*[F.min_by(F.struct("x", "y"), F.struct(e, "x", "y")).alias(f"e{i}") for i, e in enumerate(ends)])
    outer = outer.select("cx", "cy", F.explode(F.array_distinct(F.array(*[f"e{i}" for i in range(len(ends))]))).alias("e")).select("cx", "cy", "e.*")

    def joined(some, others):
        pairs = reaching(some, ["x", "y"]).join(others, ["cx", "cy"]).filter(within("p", ""))
        return pairs.select(F.xxhash64("pcx", "pcy").alias("a"), node.alias("b")).distinct()
    both = lambda e: cut_lineage(e.union(e.select("b", "a")).distinct())
    edges = both(joined(outer, outer))
    label = connected_labels(cells, edges)
    lab = cells.join(label, "node").select("cx", "cy", "label")
    apart = reaching(lab, ["label"]).join(lab, ["cx", "cy"]).filter(F.col("plabel") != F.col("label")).select("pcx", "pcy", "cx", "cy")
    gap = lambda c: F.greatest(F.col(f"{c}c") * side - F.col(c), F.col(c) - (F.col(f"{c}c") + 1) * side, F.lit(0.0))
    one = core.select("cx", "cy", "x", "y").distinct()
    facing = one.join(apart.select(F.col("pcx").alias("cx"), F.col("pcy").alias("cy"), F.col("cx").alias("xc"), F.col("cy").alias("yc")).distinct(), ["cx", "cy"])
    facing = facing.filter(gap("x") ** 2 + gap("y") ** 2 <= F.lit(eps * eps * (1 + 1e-9)))
    left = facing.select(*[F.col(c).alias(f"p{c}") for c in ("cx", "cy", "x", "y")], F.col("xc").alias("cx"), F.col("yc").alias("cy"))
    right = facing.select("cx", "cy", "x", "y", F.col("xc").alias("pcx"), F.col("yc").alias("pcy"))
    more = left.filter("pcx < cx OR (pcx = cx AND pcy < cy)").join(right, ["cx", "cy", "pcx", "pcy"]).filter(within("p", ""))
    more = both(more.select(F.xxhash64("pcx", "pcy").alias("a"), node.alias("b")).distinct())
    if not more.isEmpty():
        label = connected_labels(cells, both(edges.union(more)))
        lab = cells.join(label, "node").select("cx", "cy", "label")

    # border points, each with the nearest core point around it; core points lie in cells of their own label
    labelled = core.join(lab, ["cx", "cy"])
    rim = sparse.join(core.select("row"), "row", "left_anti")
    inside = rim.join(labelled.select("cx", "cy", F.col("x").alias("px"), F.col("y").alias("py"), "label"), ["cx", "cy"])
    beside = reaching(rim, ["row", "x", "y"]).join(labelled.select("cx", "cy", "x", "y", "label").distinct(), ["cx", "cy"]).filter(within("p", ""))
    far = ((F.col("px") - F.col("x")) ** 2 + (F.col("py") - F.col("y")) ** 2).alias("d")
    border = inside.select("row", far, "label").unionByName(beside.select(F.col("prow").alias("row"), far, "label")) \
        .groupBy("row").agg(F.min_by("label", F.struct("d", "label")).alias("label"))
    found = cut_lineage(labelled.select("row", "label", F.lit(True).alias("is_core")).unionByName(border.withColumn("is_core", F.lit(False))))
    size = found.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).filter(F.col("n") >= min_cluster_size)
    names = size.select("label", (F.row_number().over(Window.orderBy("first")) - 1).cast("long").alias("cluster"))  # one row a cluster
    out = pts.select("id", "row").join(found.join(names, "label", "left"), "row", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("is_core", F.lit(False)).alias("is_core"), F.coalesce("cluster", F.lit(-1)).alias("cluster"))
