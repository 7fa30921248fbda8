"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage, ensure_checkpoint_dir

#: ASCII white space, and a word: what stands between it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

SALTS = 64

BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def word_count(c: str | Column) -> Column:
    """Number of words of a text, 0 for null: the pieces that white space
    parts, less the empty ones at either end."""
    pieces = F.split(text_or_empty(c), SPACE)
    empty = lambda i: (F.element_at(pieces, i) == "").cast("int")
    return F.when(F.size(pieces) == 1, 1 - empty(1)).otherwise(F.size(pieces) - empty(1) - empty(-1)).cast("long")


def salted(c: str | Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(salts)).cast("int")


def spread_join(rows: DataFrame, facts: DataFrame, key: str, by: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``rows`` joined with ``facts``, which holds one row per ``key``, when one
    key may hold a third of ``rows``.  The distinct (key, salt) pairs, at most
    ``salts`` for a key after map-side combining, fetch the facts; the rows
    then meet their pair, so that a hot key is dealt to ``salts`` places and
    nothing is broadcast.  ``by`` is the column that the salt is drawn from."""
    rows = rows.withColumn("_salt", salted(by, salts))
    pairs = rows.select(key, "_salt").distinct().join(facts, key, how)
    return rows.join(pairs, [key, "_salt"], how).drop("_salt")


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Arrow batches of the session hold at most so many bytes, or one row,
    unless the user has set a bound: long texts come in fewer rows at once."""
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, str(most))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares."""
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


__all__ = ["SPACE", "WORD", "SALTS", "table", "text_or_empty", "word_count", "salted", "spread_join",
           "bound_batches", "scratch_path", "cut_lineage"]
