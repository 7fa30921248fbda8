"""Readers.  Schemas are always explicit (no inference pass over the data);
per-entity indicator files are read by :func:`panelkit.operators.ingest.read_entity_series`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table (predicate pushdown and column pruning reach the scan)."""
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, *, sep: str = ",",
             header: bool = True, encoding: str = "UTF-8", strip_leading: bool = False,
             keep_text: bool = False) -> DataFrame:
    """CSV with an explicit schema.  ``sep`` may be any character (e.g. ';' or
    '§'); ``strip_leading`` drops blanks after separators; ``keep_text`` keeps
    '', 'NaN', 'NULL' as text (no null marker, no NaN parsing) so they can be
    tested later (read everything as strings for that)."""
    r = (spark.read.schema(schema).option("header", header).option("sep", sep).option("encoding", encoding)
         .option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", strip_leading))
    if keep_text:
        r = r.option("nullValue", "\u0000").option("nanValue", "\u0000").option("emptyValue", "")
        df = r.csv(path)
        return df.select(*[F.coalesce(F.col(f"`{f.name}`"), F.lit("")).alias(f.name)
                           if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
                           for f in df.schema.fields])
    return r.csv(path)


def read_csv_skip_preamble(spark: SparkSession, path: str, skip: int, schema: T.StructType, *,
                           sep: str = ",") -> DataFrame:
    """CSV files whose first ``skip`` lines are a preamble (then a header).
    Each file is read whole by one task (such files are small exports); the
    remaining lines are parsed with ``from_csv`` against the schema."""
    raw = spark.read.text(path, wholetext=True)
    lines = raw.select(F.posexplode(F.split("value", r"\r?\n")).alias("ln", "line"))
    body = lines.filter((F.col("ln") > skip) & (F.trim("line") != ""))  # line `skip` is the header
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = body.select(F.from_csv("line", ddl, {"sep": sep}).alias("r"))
    return parsed.select("r.*")


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | str, lines: bool = False) -> DataFrame:
    """A JSON array of records (one document per file), or one record per line
    (``lines``; files of any size are then split)."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: (file_name, text)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def with_declared_columns(df: DataFrame, schema: T.StructType | str, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """``df`` with exactly the columns of a declared schema: each is taken under
    its own name or, failing that, the first of its ``aliases`` that the table
    has; one that the table lacks is null of the declared type."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    out = []
    for f in schema.fields:
        name = next((c for c in [f.name, *(aliases or {}).get(f.name, [])] if c in df.columns), None)
        out.append((F.lit(None) if name is None else F.col(f"`{name}`")).cast(f.dataType).alias(f.name))
    return df.select(*out)
