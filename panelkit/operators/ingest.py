"""Ingest: per-entity indicator files, long <-> wide reshape, schema coercion,
null profiles and band-based column dropping (A1-A5)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import dims
from ..functions.semantics import bround, clean_text, to_double, to_int


def read_entity_series(spark: SparkSession, path_glob: str, *, year_col: str = "Year",
                       year_prefix: str = "YR", sep: str = ",", entity: str = "noc",
                       encoding: str | None = None, entity_of: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A1: many small CSV files, one per entity (entity = file stem), each with a
    ``Year`` column ("YR1960") and indicator columns that may differ per file.

    Returns ``(long, skipped)``: long = (entity, year int, indicator, value double)
    with non-numeric text -> NULL and year text without digits -> NULL year;
    skipped = files without the year column.  Each file is read whole by one
    task (files are per entity and small); nothing passes through the driver.
    Quoted fields may hold the separator and doubled quotes.  ``entity_of``: a
    pattern whose first group, found in the file's path, is the entity instead
    of the stem (for one folder per entity).
    Use :func:`to_wide` with :func:`indicator_order` for the wide frame."""
    reader = spark.read
    if encoding:
        reader = reader.option("encoding", encoding)
    raw = reader.text(path_glob, wholetext=True).select(
        (F.regexp_extract(F.col("_metadata.file_path"), entity_of, 1) if entity_of else
         F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")).alias(entity),
        F.col("value"))
    lines = raw.select(entity, F.posexplode(F.split("value", r"\r?\n")).alias("ln", "line")) \
        .filter(F.trim("line") != "")
    # fields: split where an even number of quotes follows, trimmed, unquoted
    fields = F.transform(F.split("line", re.escape(sep) + r'(?=(?:[^"]*"[^"]*")*[^"]*$)'),
                         lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r'^"(.*)"$', "$1"), '""', '"'))
    parsed = lines.select(entity, "ln", fields.alias("vals"))
    first_ln = parsed.groupBy(entity).agg(F.min("ln").alias("ln"))
    header = parsed.join(first_ln, [entity, "ln"]).select(entity, F.col("vals").alias("names"))
    has_year = F.array_contains("names", year_col)
    skipped = header.filter(~has_year).select(entity)
    body = parsed.join(first_ln.withColumnRenamed("ln", "hdr"), entity) \
        .filter(F.col("ln") > F.col("hdr")).select(entity, "ln", "vals")
    cells = body.join(header.filter(has_year), entity).select(
        entity, "ln", "names",
        F.posexplode(F.slice("vals", 1, F.size("names"))).alias("i", "v"))
    cells = cells.withColumn("name", F.element_at("names", F.col("i") + 1))
    years = cells.filter(F.col("name") == year_col).select(
        entity, "ln", to_int(F.regexp_extract(F.trim("v"), rf"^(?:{re.escape(year_prefix)})?(\d+)$", 1))
        .alias("year"))
    vals = cells.filter(F.col("name") != year_col).select(
        entity, "ln", F.col("name").alias("indicator"), to_double(F.when(F.col("v") != "", F.col("v"))).alias("value"),
        F.col("i").alias("pos"))
    long = vals.join(years, [entity, "ln"], "left").select(entity, "year", "indicator", "value", "pos")
    return long, skipped


def indicator_order(long: DataFrame, entity: str = "noc", indicator: str = "indicator",
                    pos: str = "pos") -> list[str]:
    """Ordered union of indicator names (first-seen order: entity, then column
    position).  Returns names only - one per indicator."""
    first = long.groupBy(indicator).agg(F.min(F.struct(entity, pos)).alias("k"))
    return [r[0] for r in first.orderBy("k").select(indicator).collect()]


def to_wide(long: DataFrame, ids: Sequence[str], key: str, value: str,
            names: Sequence[str]) -> DataFrame:
    """Long -> wide with an explicit, ordered column list (no data-driven pivot pass)."""
    return long.groupBy(*ids).pivot(key, list(names)).agg(F.first(value, ignorenulls=True)) \
        .select(*ids, *[F.col(n) for n in names])


def to_long(df: DataFrame, ids: Sequence[str], *, year_name: str = "year",
            value_name: str = "value", year_pattern: str = r"^(?:YR)?(\d{4})$") -> DataFrame:
    """A2: digit-named (or ``YR``-prefixed) columns -> (ids, year int, value double)."""
    cols = [c for c in df.columns if c not in ids and re.match(year_pattern, c)]
    melted = df.select(*ids, *[to_double(F.col(f"`{c}`")).alias(c) for c in cols]).unpivot(
        list(ids), cols, "__col", value_name)
    return melted.select(*ids, F.regexp_extract("__col", year_pattern, 1).cast("int").alias(year_name),
                         value_name)


def coerce_schema(df: DataFrame, ints: Sequence[str] = (), doubles: Sequence[str] = (),
                  texts: Sequence[str] = ()) -> DataFrame:
    """A3: lenient numeric coercion and trimmed text (blank -> NULL)."""
    m = {c: to_int(c) for c in ints}
    m.update({c: to_double(c) for c in doubles})
    m.update({c: clean_text(c) for c in texts})
    return df.withColumns(m)


def null_profile(df: DataFrame, cols: Sequence[str] | None = None, variant: int = 1,
                 by: Sequence[str] = ()) -> DataFrame:
    """A4: percent of NULLs per column in one aggregation pass, then a band.

    variant 1: pct (2 dp) < 30 Keep, 30 < pct < 50 Maybe, otherwise Drop
    (exactly 30 falls to Drop); variant 2: > 30 excluded, > 15 caution, else
    reliable (raw pct); variant 3: only pct > 0, 1 dp.
    Output: (*by, column, pct_null, band)."""
    cols = list(cols or [c for c in df.columns if c not in by])
    agg = df.groupBy(*by).agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in cols])
    long = agg.unpivot(list(by), cols, "column", "pct_null")
    if variant == 1:
        p = bround("pct_null", 2)
        keep, maybe, drop = dims.NULL_BANDS_V1
        band = F.when(p < 30, keep).when((p > 30) & (p < 50), maybe).otherwise(drop)
        return long.select(*by, "column", p.alias("pct_null"), band.alias("band"))
    if variant == 2:
        excl, caut, ok = dims.NULL_BANDS_V2
        p = F.col("pct_null")
        band = F.when(p > 30, excl).when(p > 15, caut).otherwise(ok)
        return long.select(*by, "column", "pct_null", band.alias("band"))
    return long.filter(F.col("pct_null") > 0).select(
        *by, "column", bround("pct_null", 1).alias("pct_null"), F.lit(None).cast("string").alias("band"))


def drop_by_band(df: DataFrame, profile: DataFrame, band: str = "Drop",
                 by: str | None = None) -> tuple[DataFrame, list[str]]:
    """A5: drop the columns banded ``band`` in every group of the profile
    (e.g. every country file); already-absent columns are tolerated."""
    g = profile.groupBy("column").agg(F.bool_and(F.col("band") == band).alias("all_bad"))
    bad = sorted(r[0] for r in g.filter("all_bad").select("column").collect())
    return df.drop(*[c for c in bad if c in df.columns]), bad
