"""Sinks.  Stage tables are parquet; CSV / JSON only where a file format is the deliverable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet stage table, optionally partitioned (e.g. by year) for pruning."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    """CSV with a header and no index column."""
    df.write.mode(mode).option("header", True).option("sep", sep).csv(path)


def write_per_group(df: DataFrame, path: str, column: str, mode: str = "overwrite") -> None:
    """One CSV folder per value of ``column`` (``column=value/`` directories)."""
    df.write.mode(mode).option("header", True).partitionBy(column).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, one record per row."""
    df.write.mode(mode).json(path)


def write_report(findings: DataFrame, path: str, order: Sequence[str] = ("section", "line"),
                 line: str = "line") -> None:
    """Findings as a text report, one line per finding, globally ordered
    (range-partitioned sort, not a single task)."""
    findings.orderBy(*order).select(F.col(line).alias("value")).write.mode("overwrite").text(path)
