"""Operator 3: URL filter by association rules.

A url becomes a set of tokens (scheme, domains, path segments, extension,
query keys; numbers are one token).  Over the labelled pages Spark's FP-growth
mines the token sets that come with the label "block".  A rule stays when its
confidence is at least ``MIN_LIFT`` times the share of pages to block, and the
pages to block that it holds are ``MIN_SUPPORT`` of the labelled ones and
``MIN_PAGES`` at least; it goes when a shorter one with no lower confidence
implies it.  Each rule stands in an inverted index under its rarest
token.  Pages with equal tokens are one row until their verdict is known, so a
frequent token meets the index once for each distinct set.

Explicit rules (host, path, verdict) come first: one fits its host and all
subdomains when the url's path starts with its path; the longest wins.

Edge cases: a null url, or one without ``://``, has an empty host and path, no
explicit rule and only the token ``none``; with fewer than ``MIN_PAGES``
labelled pages to block nothing is mined and the verdict is "allow"; null ids are kept; repeated rows give
repeated rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from . import common as C
from .registry import register

# The explicit rules (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MIN_SUPPORT = 0.005
MIN_PAGES = 5
MIN_LIFT = 1.1
LABEL = "label:block"


def url_host(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.char_length(url))).otherwise(F.lit(""))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    # every domain from the top one down to the host itself
    domains = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.concat(
        F.lit("dom:"), F.array_join(F.slice(labels, n - k + 1, k), ".")))).otherwise(F.array().cast("array<string>"))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(
        F.lit("seg:"), F.regexp_replace(F.lower(x), r"\d+", "#")))
    ext = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "[&;]"), lambda x: x != ""),
                       lambda x: F.concat(F.lit("key:"), F.regexp_extract(x, "^[^=]*", 0)))
    scheme = F.when(host != "", F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1)))).otherwise(F.lit("none"))
    one = F.array(scheme, F.when(ext != "", F.concat(F.lit("ext:"), F.lower(ext))),
                  F.when(F.coalesce(url, F.lit("")).contains("#"), F.lit("fragment")),
                  F.when(path.endswith("/"), F.lit("slash")))
    return F.array_sort(F.array_distinct(F.filter(F.concat(one, domains, segments, keys), lambda x: x.isNotNull())))


def explicit_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host + path, its verdict) of the longest rule that fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def mine_rules(baskets: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = 0.0,
               min_lift: float = MIN_LIFT, min_pages: int = MIN_PAGES) -> DataFrame:
    """``baskets``: (tokens array, blocked boolean).  Returns the rules
    (antecedent, confidence, support), pruned."""
    spark = baskets.sparkSession
    items = C.cut_lineage(baskets.select(F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(LABEL))))
                                         .otherwise(F.col("tokens")).alias("items")))
    shape = "antecedent array<string>, confidence double, support double"
    n, blocked = items.agg(F.count("*"), F.count_if(F.array_contains("items", LABEL))).first()
    if blocked < max(min_pages, 1):
        return spark.createDataFrame([], shape)
    # a little less than each bound, as Spark rounds up; the exact ones follow
    asked = min(1.0, max(min_confidence, 0.999 * min_lift * blocked / n))
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, (min_pages - 0.5) / n), minConfidence=asked).fit(items)
    rules = (model.associationRules.where((F.col("consequent") == F.array(F.lit(LABEL))) & (F.col("lift") >= min_lift))
             .select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support"))
    rules = C.cut_lineage(rules)
    # a rule is implied by one whose tokens are its own less some: look each part up
    part = rules.select("antecedent", "confidence", F.explode("antecedent").alias("t"))
    part = part.select("antecedent", "confidence", F.array_remove("antecedent", F.col("t")).alias("shorter"))
    implied = part.join(rules.select(F.col("antecedent").alias("shorter"), F.col("confidence").alias("c")), "shorter")
    implied = implied.where("c >= confidence").select("antecedent")
    return C.cut_lineage(rules.join(implied, "antecedent", "left_anti"))


def match_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``sets`` (key, tokens), distinct; the highest confidence of the rules
    whose tokens a set holds, for the sets that fit any."""
    tokens = sets.select("key", "tokens", F.explode("tokens").alias("t"))
    often = tokens.groupBy("t").count()
    each = rules.withColumn("rule", F.xxhash64("antecedent")).select("rule", "antecedent", "confidence", F.explode("antecedent").alias("t"))
    rare = each.join(often, "t").groupBy("rule").agg(F.min_by("t", F.struct("count", "t")).alias("t"),
                                                     F.any_value("antecedent").alias("antecedent"),
                                                     F.any_value("confidence").alias("confidence"))
    hit = tokens.join(rare, "t").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return hit.groupBy("key").agg(F.max("confidence").alias("confidence"))


def judge_urls(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
               **mining) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, confidence (of the
    mined rule, null if none fits).  ``labelled``: (url, blocked boolean)."""
    host, path = url_host(F.col("url")), url_path(F.col("url"))

    def tokens(df):
        return df.withColumn("host", host).withColumn("path", path).withColumn(
            "tokens", url_tokens(F.col("url"), F.col("host"), F.col("path")))

    known = tokens(labelled.where("blocked IS NOT NULL").select("url", "blocked"))
    mined = mine_rules(known.select("tokens", "blocked"), **mining)
    rows = tokens(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")))
    rows = rows.withColumn("key", F.array_join("tokens", " "))
    sets = C.cut_lineage(rows.select("key", "tokens").distinct())
    judged = C.spread_join(rows.drop("tokens", "url"), match_rules(sets, mined), "key", "id", "left")
    rule, verdict = explicit_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"),
                         F.coalesce(verdict, by_method).alias("verdict"), "confidence")


@register("op3_url_rules")
def op3_url_rules(spark, sf_dir):
    """The number in a page's path is the document it shows; a page of a
    document of low quality is one to block."""
    pages = C.table(spark, sf_dir, "pages").select("page_id", "url")
    doc = F.regexp_extract(url_path(F.col("url")), r"(\d{1,18})[^0-9]*$", 1)
    shown = pages.select("url", doc.try_cast("long").alias("doc_id"))
    labels = C.table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("blocked"))
    return judge_urls(pages, shown.join(labels, "doc_id").select("url", "blocked"))
