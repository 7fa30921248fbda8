"""Operator 4: not-modified revisits of a web archive, resolved.

A revisit record (304) has no body.  Its page is the latest earlier full
response of the same canonical url; the revisit's validators must agree with
that response, and the headers that a 304 may carry replace the stored ones.

The as-of join is two windows.  Records lie in (url, time bucket) pieces; the
first window looks back inside a piece, the second carries the last response
of each piece on to the next ones, over one row per piece.  So the records of
a hot url are dealt by time.

Edge cases: a null url is the empty url, a url like others; a record without a
time has no earlier response, nor is it one; of responses at one time the one
with the largest id counts; "earlier" is strictly earlier; a revisit without
validators is taken as unmodified; repeated rows give repeated results; empty
tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common as C
from .registry import register

# The headers that a 304 response carries to update the stored ones.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query keys that do not change the page.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"
BUCKET_SECONDS = 86_400


def canonical_url(url: Column) -> Column:
    """Without scheme, fragment, tracking keys, a www. in front, a default
    port, or a slash at the end; the host in lower case."""
    u = F.regexp_replace(F.coalesce(url, F.lit("")), r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    u = F.regexp_replace(u, rf"([?&]){TRACKING}=[^&]*", "$1")
    u = F.regexp_replace(F.regexp_replace(u, r"&&+", "&"), r"\?&+", "?")
    u = F.regexp_replace(u, r"[?&]+$", "")
    host = F.lower(F.regexp_extract(u, r"^[^/?]*", 0))
    rest = F.regexp_extract(u, r"^[^/?]*(.*)$", 1)
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(?:80|443)$", "")
    return F.concat(host, F.regexp_replace(rest, r"/$", ""))


def resolve_revisits(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """``records``: record_id, url, ts (seconds, long), kind ("response" or
    "revisit"), status, etag, last_modified, headers (map, lower-case names),
    payload_sha256.  One row per record: record_id, page (canonical url), ts,
    kind, outcome (full, resolved, mismatch, missing), payload_from (record
    id), payload_sha256 and headers (merged)."""
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("ts").isNotNull()
    rows = records.select("record_id", canonical_url(F.col("url")).alias("page"), F.col("ts").cast("long").alias("ts"),
                          "kind", "status", "etag", "last_modified", "headers", "payload_sha256")
    entries = F.array_sort(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))))
    rows = rows.withColumn("bucket", F.floor(F.col("ts") / bucket_seconds)).withColumn("own", F.when(full, F.struct(
        "ts", "record_id", "etag", "last_modified", "payload_sha256", entries.alias("entries"))))
    back = Window.partitionBy("page", "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.max("own").over(back))
    piece = rows.where("own IS NOT NULL").groupBy("page", "bucket").agg(F.max("own").alias("last"))
    # each piece's last response holds up to the next piece that has one
    spans = Window.partitionBy("page").orderBy("bucket")
    carried = (rows.select("page", "bucket").distinct().join(piece, ["page", "bucket"], "left")
               .withColumn("prior", F.max("last").over(spans.rowsBetween(Window.unboundedPreceding, -1)))
               .where("bucket IS NOT NULL AND prior IS NOT NULL").select("page", "bucket", "prior"))
    rows = rows.join(carried, ["page", "bucket"], "left").withColumn(
        "base", F.when(F.col("ts").isNotNull(), F.coalesce("inside", "prior")))
    agree = (F.when(F.col("etag").isNotNull() & F.col("base.etag").isNotNull(), F.col("etag") == F.col("base.etag"))
             .when(F.col("last_modified").isNotNull() & F.col("base.last_modified").isNotNull(),
                   F.col("last_modified") == F.col("base.last_modified")).otherwise(F.lit(True)))
    revisit = F.col("kind") == "revisit"
    outcome = (F.when(~revisit, F.lit("full")).when(F.col("base").isNull(), F.lit("missing"))
               .when(agree, F.lit("resolved")).otherwise(F.lit("mismatch")))
    rows = rows.withColumn("outcome", outcome)
    mine = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    new = F.map_filter(mine, lambda k, v: k.isin(*PERMITTED))
    old = F.map_filter(F.map_from_entries("base.entries"), lambda k, v: ~F.array_contains(F.map_keys(new), k))
    done = F.col("outcome") == "resolved"
    return rows.select("record_id", "page", "ts", "kind", "outcome",
                       F.when(done, F.col("base.record_id")).when(~revisit, F.col("record_id")).alias("payload_from"),
                       F.when(done, F.col("base.payload_sha256")).when(~revisit, F.col("payload_sha256")).alias("payload_sha256"),
                       F.when(done, F.map_concat(old, new)).otherwise(mine).alias("headers"))


def attach_payload(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """The bodies (record_id, payload) of the responses that records point to."""
    facts = payloads.select(F.col("record_id").alias("payload_from"), "payload")
    return C.spread_join(resolved, facts, "payload_from", "record_id", "left")


def header_text(headers: str | Column) -> Column:
    lines = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return F.array_join(lines, "\n")


def page_captures(pages: DataFrame) -> DataFrame:
    """Archive records that the pages table implies: each page is a full
    response, and was visited again later (or, for some, earlier), when the
    server answered that it had not changed, with its own or a stale tag."""
    h = lambda tag: F.conv(F.substring(F.md5(F.concat(F.lit(tag), F.col("page_id").cast("string"))), 1, 8), 16, 10).cast("long")
    at = F.pmod(h("t"), F.lit(30 * 86_400))
    html = F.coalesce("html", F.lit(""))
    day = lambda ts: F.concat(F.lit("day "), F.floor(ts / 86_400).cast("string"))
    base = pages.select("page_id", "url", at.alias("at"), F.md5(html).alias("tag"), F.sha2(html, 256).alias("sha"),
                        F.char_length(html).alias("size"), (F.pmod(h("gap"), F.lit(400_000)) - 50_000).alias("gap"),
                        (F.pmod(h("stale"), F.lit(5)) == 0).alias("stale"))
    empty = F.lit(None).cast("string")
    full = base.select((F.col("page_id") * 2).alias("record_id"), "url", F.col("at").alias("ts"), F.lit("response").alias("kind"),
                       F.lit(200).alias("status"), F.col("tag").alias("etag"), day(F.col("at")).alias("last_modified"),
                       F.create_map(F.lit("etag"), F.col("tag"), F.lit("date"), day(F.col("at")), F.lit("content-type"),
                                    F.lit("text/html"), F.lit("content-length"), F.col("size").cast("string")).alias("headers"),
                       F.col("sha").alias("payload_sha256"))
    again = base.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("at") + F.col("gap")).alias("ts"),
                        F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
                        F.when(F.col("stale"), F.lit("stale")).otherwise(F.col("tag")).alias("etag"),
                        empty.alias("last_modified"),
                        F.create_map(F.lit("date"), day(F.col("at") + F.col("gap")), F.lit("cache-control"), F.lit("max-age=60"),
                                     F.lit("content-length"), F.lit("0")).alias("headers"), empty.alias("payload_sha256"))
    return full.unionByName(again)


_CANON = r"""regexp_replace(coalesce(url, ''), '#.*$', '')"""
_CANON = rf"regexp_replace({_CANON}, '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
_CANON = rf"regexp_replace({_CANON}, '([?&]){TRACKING}=[^&]*', '\1', 'g')"
_CANON = rf"regexp_replace(regexp_replace({_CANON}, '&&+', '&', 'g'), '\?&+', '?', 'g')"
_CANON = rf"regexp_replace({_CANON}, '[?&]+$', '')"
_NUM = "CAST('0x' || substr(md5('{}' || CAST(page_id AS VARCHAR)), 1, 8) AS BIGINT)"
_SQL = rf"""
WITH p AS (SELECT page_id, {_CANON} AS u, {_NUM.format('t')} % 2592000 AS t0, md5(coalesce(html, '')) AS tag,
    sha256(coalesce(html, '')) AS sha, length(coalesce(html, '')) AS size,
    {_NUM.format('gap')} % 400000 - 50000 AS gap, {_NUM.format('stale')} % 5 = 0 AS stale FROM pages),
  c AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*', 0)), '^www\.', ''), ':(?:80|443)$', '')
    || regexp_replace(regexp_extract(u, '^[^/?]*(.*)$', 1), '/$', '') AS page FROM p),
  v AS (SELECT *, t0 + gap AS ts, CASE WHEN stale THEN 'stale' ELSE tag END AS etag FROM c),
  m AS (SELECT v.page_id, b.page_id AS base, b.tag AS btag, b.sha AS bsha, b.size AS bsize,
      row_number() OVER (PARTITION BY v.page_id ORDER BY b.t0 DESC, b.page_id DESC) AS k
    FROM v JOIN c b ON b.page = v.page AND b.t0 < v.ts)
SELECT page_id * 2 AS record_id, page, t0 AS ts, 'response' AS kind, 'full' AS outcome, page_id * 2 AS payload_from,
  sha AS payload_sha256, 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) ||
  'date: day ' || t0 // 86400 || chr(10) || 'etag: ' || tag AS headers FROM c
UNION ALL
SELECT v.page_id * 2 + 1, page, ts, 'revisit',
  CASE WHEN base IS NULL THEN 'missing' WHEN etag = btag THEN 'resolved' ELSE 'mismatch' END,
  CASE WHEN etag = btag THEN base * 2 END, CASE WHEN etag = btag THEN bsha END,
  CASE WHEN etag = btag THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || bsize || chr(10) || 'content-type: text/html'
      || chr(10) || 'date: day ' || CAST(floor(ts / 86400) AS BIGINT) || chr(10) || 'etag: ' || btag
    ELSE 'cache-control: max-age=60' || chr(10) || 'content-length: 0' || chr(10) || 'date: day ' || CAST(floor(ts / 86400) AS BIGINT) END
FROM v LEFT JOIN (SELECT * FROM m WHERE k = 1) n ON v.page_id = n.page_id"""


@register("op4_revisit_resolution", _SQL)
def op4_revisit_resolution(spark, sf_dir):
    found = resolve_revisits(page_captures(C.table(spark, sf_dir, "pages")))
    return found.withColumn("headers", header_text("headers"))
