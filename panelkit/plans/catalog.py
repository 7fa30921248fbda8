"""Registry of the queries bound to the driver's tables.

Each query is ``fn(spark, sf_dir) -> DataFrame``; ``oracle`` holds the
independent DuckDB SQL for the same result (absent for invariant-checked
operators such as model fits)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rnd(c, scale: int = 6):
    """Round for comparison with the SQL oracle.  Values here are often exact
    decimal ties (means of 2-decimal prices); a nudge of a thousandth of the
    rounding step, away from zero, moves a tie off the boundary so both
    engines round it the same way; ``+ 0.0`` turns -0.0 into 0.0."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.round(x + F.signum(x) * F.lit(10.0 ** -(scale + 3)), scale) + F.lit(0.0)


def r_sql(expr: str, scale: int = 6) -> str:
    """SQL twin of :func:`rnd`."""
    x = f"CAST({expr} AS DOUBLE)"
    return f"(round({x} + sign({x}) * {10.0 ** -(scale + 3)!r}, {scale}) + 0.0)"


def rounded(df: DataFrame, scale: int = 6, cols: list[str] | None = None) -> DataFrame:
    """Round floating columns for comparison against the SQL oracle."""
    targets = [f.name for f in df.schema.fields
               if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (cols is None or f.name in cols)]
    return df.withColumns({c: rnd(c, scale) for c in targets}) if targets else df


def load_all() -> None:
    from . import (q_panel, q_quality, q_features, q_cluster, q_composition,  # noqa: F401
                   q_category, q_stats, q_models, q_text, q_files)
