"""Operator 6: secret scan with an incremental blob ledger.

A text version is content-addressed by its SHA-256 (the blob).  The ledger, a
Parquet table in shared storage, holds for each (blob, rule, rule version)
that was ever scanned one row per finding, or one row without a span.  A scan
reads the distinct blobs of the given history, leaves out each pair of blob
and rule version that the ledger knows, scans the rest once, writes them under
its own name, and joins the findings back to all paths and versions.  A new
rule version scans everything again for that rule alone.  A scan that is
repeated under its name replaces its own rows; spans are a set, so that two
scans of one blob at the same time find nothing twice.

Built-in functions only: a match and all text since the previous match come
out of one lazy pattern (begun by \\G: else the rest behind the last match is
tried from each of its characters), so running sums of their lengths are the positions
(in code points).  A pattern is leftmost and non-overlapping; a match that
then fails its length test is dropped, without another try inside it.

Edge cases: a null text is an empty one; null paths are kept and joined like
any other; repeated rows give repeated results; empty tables give empty
results; further columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common as C
from .registry import register


@dataclass(frozen=True)
class Rule:
    """``part``: the group whose length counts, ``least`` characters being
    needed.  Every text with a finding holds one of ``marks`` and fits ``hint``;
    both are cheap."""
    kind: str
    version: int
    pattern: str
    part: int
    least: int
    marks: tuple[str, ...]
    hint: str


# The patterns of the secret kinds, in the order of the report.
# The last two take a whole run of their letters, so their length is part of them.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6,
         ("=", ":"), r"""[DdTtNnYy]["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}"""),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20, ("AKIA",), r"AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24, (), r"[0-9a-f]{24}"),
)


def _matches(text: str, rule: Rule):
    """Array of (adv: characters since the previous match, this one included;
    len: its own characters; ok), null for a text without any."""
    steps = F.regexp_extract_all(F.col(text), F.lit(rf"(?s)\G.*?(?:{rule.pattern})"), F.lit(0))
    likely = F.col(text).rlike(rule.hint)
    if rule.marks:
        likely = reduce(or_, [F.contains(F.col(text), F.lit(m)) for m in rule.marks]) & likely
    return F.when(likely, F.transform(steps, lambda s: F.struct(
        F.char_length(s).alias("adv"),
        F.char_length(F.regexp_extract(s, rule.pattern, 0)).alias("len"),
        (F.char_length(F.regexp_extract(s, rule.pattern, rule.part)) >= rule.least).alias("ok"))))


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """(blob, kind, version, start, end, scan: the name of the scan); start and
    end null: nothing found.  None for a ledger that is not there yet."""
    try:
        return spark.read.schema("blob string, kind string, version int, start long, end long, scan string").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def scan_blobs(blobs: DataFrame, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """New ledger rows of the (blob, text) rows: only pairs of blob and rule
    version that the ledger lacks are scanned."""
    todo = blobs
    if ledger is None:
        todo = todo.withColumn("known", F.array().cast("array<string>"))
    else:  # at most one entry a rule version
        known = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "kind", "version")).alias("known"))
        todo = todo.join(known, "blob", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    each = F.array(*[F.when(~F.array_contains("known", f"{r.kind}@{r.version}"), F.struct(
        F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), _matches("text", r).alias("hits")))
        for r in rules])
    hit = (todo.select("blob", F.explode(each).alias("r")).where("r IS NOT NULL")
           .select("blob", "r.kind", "r.version", F.posexplode_outer("r.hits").alias("nth", "hit")))
    upto = Window.partitionBy("blob", "kind", "version").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    found = hit.withColumn("end", F.sum("hit.adv").over(upto)).withColumn("good", F.coalesce("hit.ok", F.lit(False)))
    # a rule without a good match leaves the row that says so: its first
    any_good = F.max("good").over(Window.partitionBy("blob", "kind", "version"))
    return (found.withColumn("any", any_good)
            .where(F.col("good") | (~F.col("any") & (F.coalesce("nth", F.lit(0)) == 0)))
            .select("blob", "kind", "version",
                    F.when(F.col("good"), F.col("end") - F.col("hit.len")).cast("long").alias("start"),
                    F.when(F.col("good"), F.col("end")).cast("long").alias("end")))


def scan_history(history: DataFrame, ledger_path: str, path_col: str = "path", text_col: str = "text",
                 rules=RULES, scan: str | None = None) -> DataFrame:
    """Bring the ledger up to date with ``history`` (one row per path and
    version) and return one row per row of it: path, blob, ``found``: array of
    (start, rank of the kind, kind, end), sorted, and ``n_scanned`` and
    ``n_skipped``: how many rule versions this scan tried on the blob, and how
    many the ledger knew.  ``scan`` names the scan (letters, digits, - and _;
    by default a new name)."""
    spark = history.sparkSession
    scan = scan or uuid.uuid4().hex
    rows = history.select(F.col(path_col).alias("path"), C.text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("blob", F.sha2("text", 256))
    # rows without a path, or with one repeated path, are dealt by their number
    paths = C.cut_lineage(rows.select("path", "blob", F.monotonically_increasing_id().alias("_row")))
    here = paths.select("blob").distinct()
    # by blob alone: the ledger then meets the texts where they are
    blobs = rows.groupBy("blob").agg(F.any_value("text").alias("text"))
    ledger = read_ledger(spark, ledger_path)
    if ledger is not None:
        ledger = ledger.where(F.col("scan") != scan).join(here, "blob", "left_semi")
    new = scan_blobs(blobs, ledger, rules)
    # the rows are light: no more files than cores, each with its own write buffers
    new.coalesce(2 * spark.sparkContext.defaultParallelism).write.mode("overwrite").parquet(f"{ledger_path}/scan={scan}")
    rank = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind"))
    now = F.concat_ws("@", "kind", "version").isin([f"{r.kind}@{r.version}" for r in rules])
    span = F.when(F.col("start").isNotNull(), F.struct("start", rank.alias("rank"), "kind", "end"))
    tried = F.when(F.col("scan") == scan, F.col("kind"))
    per_blob = (read_ledger(spark, ledger_path).where(now).join(here, "blob", "left_semi").groupBy("blob")
                .agg(F.array_sort(F.collect_set(span)).alias("found"), F.size(F.collect_set(tried)).cast("long").alias("n_scanned")))
    per_blob = per_blob.withColumn("n_skipped", F.lit(len(rules)).cast("long") - F.col("n_scanned"))
    return C.spread_join(paths, per_blob, "blob", "_row", "left").drop("_row")


def span_string(found: str):
    return F.array_join(F.transform(F.coalesce(found, F.array()), lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


@register("op6_secret_ledger")
def op6_secret_ledger(spark, sf_dir):
    """All documents, in two deliveries to one new ledger; together they hold
    every row.  Before the second the rule for hex has a new version, so that
    a blob that came with the first delivery is scanned for hex alone.  The
    built-in rules are the base; ``spans`` holds them all.  ``n_scanned`` and
    ``n_skipped`` are of the row's own delivery."""
    docs = C.table(spark, sf_dir, "documents")
    ledger = C.scratch_path(spark, "ledger")
    early = F.xxhash64("doc_id") >= 0
    newer = tuple(replace(r, version=r.version + (r.kind == "hex")) for r in RULES)
    found = scan_history(docs.where(early), ledger, "doc_id", scan="first").unionByName(
        scan_history(docs.where(~early), ledger, "doc_id", rules=newer, scan="second"))
    count = lambda kind: F.coalesce(F.size(F.filter("found", lambda x: x["kind"] == kind)), F.lit(0)).cast("long")
    return (found.select(F.col("path").alias("doc_id"), *[count(r.kind).alias(f"n_{r.kind}") for r in RULES],
                         span_string("found").alias("spans"), "n_scanned", "n_skipped")
            .withColumn("base_sha256", F.sha2("spans", 256)))
