"""Operator 7: exact de-duplication by skew-safe combining.

Texts are equal when they are identical after each run of ASCII white space
has become one space.  Three stages, the full text being part of the grouping
key in each: (a) map-side combining drops the copies inside each partition;
(b) what is left of a text is merged within (salt, digest, text), so that a
text which a third of all rows share is dealt to ``salts`` places; (c) the at
most ``salts`` winners of a text are combined globally.  The winner goes back
to the rows over their (digest, salt) pair.

Edge cases: a null text counts as empty; a null id never wins over another,
and a group of null ids alone keeps one of its rows with a null ``keep_id``;
of repeated rows (same id, same text) one stays; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common as C
from .registry import register


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(C.text_or_empty(text), C.SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept and the
    SHA-256 of the normalised text.  ``salts``: 2 to 64."""
    rows = (docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
            .select("id", "norm", F.sha2("norm", 256).alias("digest"), C.salted("id", salts).alias("salt")))
    by_salt = rows.groupBy("salt", "digest", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))
    place = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)  # noqa: E731  one bit a salt
    whole = by_salt.groupBy("digest", "norm").agg(
        F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(place(F.col("salt"))).alias("places"))
    # one row per text; a digest with two texts would make the way back ambiguous
    winners = whole.groupBy("digest").agg(
        F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"),
        F.bit_or("places").alias("places"))
    winners = winners.withColumn("texts", F.when(F.col("texts") == 1, 1).otherwise(
        F.raise_error(F.lit("two texts share one SHA-256 digest"))))
    dealt = winners.where("texts = 1").select("digest", "keep_id", "group_size", F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(salts - 1)),
        lambda b: F.col("places").bitwiseAND(place(b)) != 0)).alias("salt"))
    light = C.cut_lineage(rows.select("id", "digest", "salt"))
    first = Window.partitionBy("digest", "salt", "id").orderBy("id")
    return (light.join(dealt, ["digest", "salt"])
            .withColumn("nth", F.row_number().over(first))
            .select(F.col("id").alias(id_col), "keep_id", "group_size",
                    (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
                    F.col("digest").alias("text_sha256")))


@register("op7_exact_dedup", r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
  g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g ON d.norm = g.norm""")
def op7_exact_dedup(spark, sf_dir):
    return exact_dedup(C.table(spark, sf_dir, "documents"))
