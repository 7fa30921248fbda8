"""Text and semantic queries (T1-T10) on pages, documents, benchmark, labels,
embeddings and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..operators import cluster as D
from ..operators import text as T
from ..session import cut_lineage
from . import tables as tb
from .catalog import r_sql, register, rounded

CHUNK = 500
TOK, TOK_OVERLAP = 500, 25
TOP_K = 40
#: Lists of 32 that a query of the vector index reads.
PROBES = 30


def _docs(spark, d):
    return tb.load(spark, d, "documents").select("doc_id", "text")


@register("text_extract")
def text_extract(spark, d):
    """Article title, URL date and cleaned body text from raw HTML pages
    (stdlib HTML parser in mapInPandas; checked on fixtures in tests)."""
    return T.extract_articles(tb.load(spark, d, "pages"))


#: The SQL's own road: sequences and what they stand for.
MOJIBAKE = [
    ("Ã ", "à"), ("Ã¨", "è"), ("Ã©", "é"), ("Ã¬", "ì"), ("Ã²", "ò"), ("Ã¹", "ù"),
    ("Ã€", "À"), ("Ãˆ", "È"), ("Ã‰", "É"), ("Ã§", "ç"), ("Ã¶", "ö"), ("Ã¼", "ü"), ("Ã¤", "ä"),
    ("â€™", "’"), ("â€˜", "‘"), ("â€œ", "“"), ("â€\u009d", "”"), ("â€“", "–"), ("â€”", "—"), ("â€¦", "…"),
]


def _clean_sql(x: str) -> str:
    e = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '^[\\s\\p{{Z}}\\x{{85}}\\x1c-\\x1f]+|[\\s\\p{{Z}}\\x{{85}}\\x1c-\\x1f]+$', '', 'g'),
          '[\\t\\r]', chr(10), 'g'), '\\n{{2,}}', chr(10), 'g'), ' {{2,}}', ' ', 'g')"""
    for bad, good in MOJIBAKE:
        e = f"replace({e}, '{bad}', '{good}')"
    return e


@register("text_clean", f"""
SELECT doc_id, {_clean_sql('text')} AS text,
  regexp_replace(split_part(text, chr(10), 1), '[^\\p{{L}}\\p{{N}}]', ' ', 'g') AS title FROM documents""")
def text_clean(spark, d):
    """Whole-text cleaning; the first line, alphanumerics only, as title."""
    docs = _docs(spark, d)
    return docs.select("doc_id", T.clean_text("text").alias("text"),
                       T.clean_title(F.split_part(F.col("text"), F.lit("\n"), F.lit(1))).alias("title"))


@register("text_mojibake", "SELECT doc_id, text FROM documents")
def text_mojibake(spark, d):
    """Whole texts whose UTF-8 bytes were read as Latin-1 come back."""
    docs = _docs(spark, d)
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return docs.select("doc_id", T.fix_mojibake(broken).alias("text"))


_DATED = """dated AS (SELECT o_orderkey, '0000-00-00' AS date, 'Roma (' || day(o_orderdate) || '° ' ||
    ['gennaio', 'febbraio', 'marzo', 'aprile', 'maggio', 'giugno', 'luglio', 'agosto', 'settembre', 'ottobre', 'novembre', 'dicembre'][month(o_orderdate)]
    || ' ' || year(o_orderdate) || ') ' || o_orderpriority AS text, o_orderdate FROM orders)"""


@register("text_repair_date_orders", f"""WITH {_DATED}
SELECT o_orderkey, year(o_orderdate) || '-' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '-' || day(o_orderdate) AS date,
  CAST(o_orderdate AS DATE) AS day FROM dated""")
def text_repair_date_orders(spark, d):
    """A sentinel date and a text that names the order's day in Italian; the
    repaired date, and the real date that it stands for."""
    o = tb.load(spark, d, "orders")
    names = F.array(*[F.lit(m) for m in dims.ITALIAN_MONTHS])
    day, month, year = F.dayofmonth("o_orderdate"), F.month("o_orderdate"), F.year("o_orderdate")
    text = F.concat(F.lit("Roma ("), day.cast("string"), F.lit("° "), F.element_at(names, month), F.lit(" "), year.cast("string"), F.lit(") "), "o_orderpriority")
    rows = o.select("o_orderkey", F.lit("0000-00-00").alias("date"), text.alias("text"))
    return rows.select("o_orderkey", T.repair_date("date", "text").alias("date")).withColumn("day", T.as_date("date"))


@register("text_repair_date", """
SELECT doc_id, CASE WHEN regexp_matches(text, '\\((\\d+)°* (\\w+) (\\d{4})\\)') THEN
    regexp_extract(text, '\\((\\d+)°* (\\w+) (\\d{4})\\)', 3) || '-' ||
    coalesce(CASE lower(regexp_extract(text, '\\((\\d+)°* (\\w+) (\\d{4})\\)', 2))
      WHEN 'gennaio' THEN '01' WHEN 'febbraio' THEN '02' WHEN 'marzo' THEN '03' WHEN 'aprile' THEN '04'
      WHEN 'maggio' THEN '05' WHEN 'giugno' THEN '06' WHEN 'luglio' THEN '07' WHEN 'agosto' THEN '08'
      WHEN 'settembre' THEN '09' WHEN 'ottobre' THEN '10' WHEN 'novembre' THEN '11' WHEN 'dicembre' THEN '12' END, '12')
    || '-' || regexp_extract(text, '\\((\\d+)°* (\\w+) (\\d{4})\\)', 1)
  ELSE '0000-00-00' END AS date FROM documents""")
def text_repair_date(spark, d):
    """Documents without a date take the first '(d month yyyy)' of their text."""
    docs = _docs(spark, d).withColumn("date", F.lit(dims.DATE_SENTINEL))
    return docs.select("doc_id", T.repair_date("date", "text").alias("date"))


@register("text_drop_listing", """
SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS n_newlines
FROM documents WHERE length(text) - length(replace(text, chr(10), '')) < 100""")
def text_drop_listing(spark, d):
    """T4: documents with fewer than 100 line breaks (listing pages dropped)."""
    docs = _docs(spark, d)
    return T.drop_listing_pages(docs, "text").select("doc_id", T.newline_count("text").alias("n_newlines"))


@register("text_chunk", f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS chunk_no,
  substr(text, s + 1, {CHUNK}) AS chunk
FROM (SELECT doc_id, text, unnest(range(0, length(text), {CHUNK})) AS s FROM documents WHERE length(text) > 0)""")
def text_chunk(spark, d):
    """T5: 500-character chunks of every whole document."""
    return T.chunk_chars(_docs(spark, d), "doc_id", "text", CHUNK, 0)


@register("text_chunk_tokens", f"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS toks FROM documents)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS chunk_no,
  array_to_string(toks[s + 1 : s + {TOK}], ' ') AS chunk
FROM (SELECT doc_id, toks, unnest(range(0, len(toks), {TOK - TOK_OVERLAP})) AS s FROM t WHERE len(toks) > 0)""")
def text_chunk_tokens(spark, d):
    """T5: 500-token chunks with 25 tokens of overlap."""
    return T.chunk_tokens(_docs(spark, d), "doc_id", "text", TOK, TOK_OVERLAP)


def _lexicon(spark, d):
    b = tb.load(spark, d, "benchmark")
    return b.select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("word")) \
        .filter(F.col("word") != "").distinct().withColumn("label", F.lit("benchmark"))


@register("text_lexicon_scores", f"""
WITH lex AS (SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM benchmark) WHERE w <> ''),
ch AS (SELECT doc_id, s, substr(text, s + 1, {CHUNK}) AS chunk
       FROM (SELECT doc_id, text, unnest(range(0, length(text), {CHUNK})) AS s FROM documents WHERE length(text) > 0)),
tok AS (SELECT doc_id, s, w FROM (SELECT doc_id, s, unnest(regexp_split_to_array(lower(chunk), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM ch) WHERE w <> ''),
per AS (SELECT t.doc_id, t.s, count(*) AS n, count(l.word) AS h FROM tok t LEFT JOIN lex l ON l.word = t.w GROUP BY t.doc_id, t.s)
SELECT doc_id, 'benchmark' AS label, {r_sql('avg(h / n)')} AS score FROM per GROUP BY doc_id""")
def text_lexicon_scores(spark, d):
    """T6 (lexicon scorer): share of each chunk's words found in the benchmark
    vocabulary, averaged over the document's chunks."""
    ch = T.chunk_chars(_docs(spark, d), "doc_id", "text", CHUNK, 0)
    return rounded(T.lexicon_scores(ch, "doc_id", "chunk", _lexicon(spark, d)), 6)


def _model_scores(spark, d):
    docs = _docs(spark, d)
    models = T.train_text_model(docs, tb.load(spark, d, "labels"), "doc_id", "text", ["quality", "toxic"])
    ch = T.chunk_chars(docs, "doc_id", "text", CHUNK, 0)
    return T.model_scores(ch, "doc_id", "chunk", models)


@register("text_model_scores")
def text_model_scores(spark, d):
    """T6 (model scorer): TF-IDF + logistic regression trained on `labels`,
    probability per chunk, mean per document."""
    return _model_scores(spark, d)


@register("text_score_ranking")
def text_score_ranking(spark, d):
    """Mean score x 100 per label, ranked."""
    return T.score_ranking(_model_scores(spark, d), ["quality", "toxic"])


_CENTROID_SQL = """c AS (SELECT i, avg(CAST(v AS DOUBLE)) AS m FROM (
    SELECT unnest(embedding) AS v, unnest(generate_series(1, len(embedding))) AS i FROM embeddings WHERE label = 0)
  GROUP BY i),
q AS (SELECT list(m ORDER BY i) AS qv FROM c),
sc AS (SELECT e.vec_id, list_dot_product(CAST(e.embedding AS DOUBLE[]), q.qv)
         / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(q.qv, q.qv))) AS score
       FROM embeddings e, q),
top AS (SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank
        FROM sc ORDER BY score DESC, vec_id LIMIT 40)"""


def _top(spark, d):
    e = tb.load(spark, d, "embeddings")
    q = T.centroid(e.filter(F.col("label") == 0), "embedding")
    return T.semantic_top_k(e, "vec_id", "embedding", q, TOP_K)


@register("text_semantic_top_k", f"WITH {_CENTROID_SQL}\nSELECT vec_id, {r_sql('score')} AS score, rank FROM top")
def text_semantic_top_k(spark, d):
    """40 vectors most similar (cosine) to the centroid of label 0."""
    return rounded(_top(spark, d), 6)


@register("text_token_estimate", f"""WITH {_CENTROID_SQL}
SELECT CAST(sum(len(list_filter(regexp_split_to_array(d.text, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS words,
  CAST(sum(len(list_filter(regexp_split_to_array(d.text, '\\s+'), lambda x: x <> ''))) * 1.5 AS DOUBLE) AS tokens_est
FROM top JOIN documents d ON d.doc_id = top.vec_id""")
def text_token_estimate(spark, d):
    """Retrieved documents looked up by id; words and tokens (x 1.5)."""
    top = _top(spark, d).select(F.col("vec_id").alias("doc_id"))
    docs = _docs(spark, d).join(top, "doc_id", "left_semi")
    return T.token_estimate(docs, "text").withColumn("tokens_est", F.col("tokens_est").cast("double"))


def _time_score(spark, d):
    e = tb.load(spark, d, "events").select("event_id", "ts", "value", "event_type")
    e = e.withColumns({"a": F.col("value") / 50.0, "b": F.when(F.col("event_type") == "purchase", 0.25).otherwise(0.0)})
    return T.score_time_features(e, "a", "b", "ts")


@register("text_time_score_clusters")
def text_time_score_clusters(spark, d):
    """score = clip(a + b, 0, 1) against date ordinal; K-means k sweep (2..6)."""
    f = cut_lineage(_time_score(spark, d).select("ordinal", "score"))
    params = D.fit_scaler(f, ["ordinal", "score"])
    z = f.withColumns(D.scaled_columns(params))
    return D.k_sweep(z, ["z_ordinal", "z_score"], range(2, 7), n_init=10)


@register("text_density_clusters")
def text_density_clusters(spark, d):
    """Grid-density clusters of events on (hour of day, value)."""
    e = tb.load(spark, d, "events").select("event_id", "ts", "value")
    e = e.withColumn("hour", F.hour("ts") + F.minute("ts") / 60.0)
    return T.grid_density_clusters(e, "event_id", "hour", "value", eps=0.5, min_samples=5, min_cluster_size=10)


def _day_score(spark, d):
    return _time_score(spark, d).select("event_id", (F.col("ordinal") / F.lit(365.0)).alias("day"), "score")


@register("text_density_core", """
WITH f AS (SELECT event_id, (datediff('day', DATE '0001-01-01', CAST(ts AS DATE)) + 1) / 365.0::DOUBLE AS day,
    least(greatest(value / 50.0::DOUBLE + CASE WHEN event_type = 'purchase' THEN 0.25 ELSE 0.0 END, 0.0), 1.0) AS score
  FROM events WHERE ts IS NOT NULL)
SELECT a.event_id, count(*) >= 5 AS is_core FROM f a JOIN f b
  ON b.day BETWEEN a.day - 0.01 AND a.day + 0.01 AND power(a.day - b.day, 2) + power(a.score - b.score, 2) <= 0.005 * 0.005
GROUP BY a.event_id""")
def text_density_core(spark, d):
    """Core points of DBSCAN on date and score."""
    return T.density_clusters(_day_score(spark, d), "event_id", "day", "score", 0.005, 5).select("event_id", "is_core")


@register("text_density_dbscan")
def text_density_dbscan(spark, d):
    """DBSCAN clusters of events on date and score, clusters of 10 and more."""
    return T.density_clusters(_day_score(spark, d), "event_id", "day", "score", 0.005, 5, 10)


@register("text_semantic_index")
def text_semantic_index(spark, d):
    """T8 (indexed form): for every vector whose id is divisible by 20, its 40
    nearest by an inverted file over all vectors (recall against all pairs in
    tests; vectors without structure need most of the lists for 0.9)."""
    e = tb.load(spark, d, "embeddings").select("vec_id", "embedding")
    centres = T.fit_lists(e, "vec_id", "embedding")
    index = T.list_index(e, "vec_id", "embedding", centres)
    return T.indexed_top_k(index, e.filter(F.col("vec_id") % 20 == 0), "vec_id", "vec_id", "embedding", centres, TOP_K, PROBES)
