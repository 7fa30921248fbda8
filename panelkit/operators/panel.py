"""Panel construction: trailing-window means, host lookup, zero-filled rows,
missing-data findings and the composed panel builder (the flagship job).

Physical shape (what ``explain`` shows for :func:`build_panel`):

* trailing mean — panel rows and the (aggregated) series are unioned and one
  window per entity with a RANGE frame [y-n, y-1] computes the means: one
  shuffle by entity, no range join, no join back.  A window partition holds
  one entity's series years plus its panel rows, so a hot entity cannot skew
  it (its raw facts were aggregated into <= one row per year first).
* host lookup — the games table has one row per edition; Spark measures it and
  chooses the join.
* densify — entities and editions are two stored dimension tables; editions
  are dealt into blocks, each entity meets each block once and the block is
  exploded; absent pairs are found with one left-anti join on the full key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.semantics import require_columns
from ..session import cut_lineage

BLOCK = 1_000  # rows of the smaller dimension that travel together
SALTS = 64  # copies of a block, so that no task holds all entities


def trailing_mean(panel: DataFrame, series: DataFrame, entity: str, year: str,
                  indicators: Sequence[str], n: int = 4) -> DataFrame:
    """Append the skip-null mean of each indicator over years y-n .. y-1 of the
    same entity.  No series rows in the window -> NULL.

    Panel rows and series rows are unioned and one window per entity with a
    RANGE frame [y-n, y-1] computes the means: a single shuffle by entity and
    no join back.  A window partition holds one entity's series years plus its
    panel rows, so it stays small even for an entity with a huge share of the
    raw facts (those were aggregated into the series first)."""
    require_columns(series, [entity, year, *indicators], "series")
    probe = "__panel_row"
    base = panel.drop(*[c for c in indicators if c in panel.columns]).withColumn(probe, F.lit(True))
    s = series.select(entity, year, *[F.col(c) for c in indicators]).withColumn(probe, F.lit(False))
    u = base.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy(entity).orderBy(F.col(year)).rangeBetween(-n, -1)
    means = {c: F.avg(F.when(~F.col(probe), F.col(c))).over(w) for c in indicators}
    return u.withColumns(means).filter(F.col(probe)).drop(probe)


def window_years_present(keys: DataFrame, series: DataFrame, entity: str, year: str,
                         n: int = 4) -> DataFrame:
    """For each distinct (entity, year) of ``keys``: the sorted list of window
    years y-n..y-1 that have no series row (availability = row exists).  Same
    union + RANGE-frame window as :func:`trailing_mean` (at most n years per frame)."""
    probe = "__key_row"
    k = keys.select(entity, year).distinct().withColumn(probe, F.lit(True))
    s = series.select(entity, year).distinct().withColumn(probe, F.lit(False))
    w = Window.partitionBy(entity).orderBy(F.col(year)).rangeBetween(-n, -1)
    have = F.collect_set(F.when(~F.col(probe), F.col(year))).over(w)
    j = k.unionByName(s).withColumn("__have", have).filter(F.col(probe))
    wanted = F.sequence(F.col(year) - n, F.col(year) - 1)
    return j.select(entity, year, F.array_sort(F.array_except(wanted, F.col("__have"))).alias("missing_years"))


def host_lookup(games: DataFrame, keys: Sequence[str], values: Sequence[str],
                order: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """One host row per key (first by ``order`` wins) plus the conflicts: keys
    whose rows disagree on any value column, with the distinct values seen."""
    keys, values = list(keys), list(values)
    order_cols = [F.col(c) for c in (order or values)]
    w = Window.partitionBy(*keys).orderBy(*order_cols)
    lookup = (games.withColumn("__rn", F.row_number().over(w))
              .filter("__rn = 1").select(*keys, *values))
    vals = F.struct(*[F.col(c) for c in values])
    conflicts = (games.groupBy(*keys)
                 .agg(F.count_distinct(vals).alias("n_variants"),
                      F.array_sort(F.collect_set(vals)).alias("variants"))
                 .filter("n_variants > 1"))
    return lookup, conflicts


def column_fd(df: DataFrame, keys: Sequence[str], candidates: Sequence[str] | None = None) -> list[str]:
    """Columns holding at most one distinct non-null value inside every key
    group (NULL keys form their own group).  Only one number per column (the
    largest per-group distinct count) reaches the driver."""
    keys = list(keys)
    cands = [c for c in (candidates or df.columns) if c not in keys]
    if not cands:
        return []
    per = df.groupBy(*keys).agg(*[(F.min(c) != F.max(c)).alias(c) for c in cands])
    mixed = per.agg(*[F.max(c).alias(c) for c in cands]).first()
    return [c for c in cands if not mixed[c]]


def edition_values(tally: DataFrame, year: str, edition: str, candidates: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """(stored table: one row per (year, edition) with the value of each column
    that depends on them, those columns): a column depends on the edition when
    its least and greatest value agree in every edition."""
    cands = list(candidates)
    per = cut_lineage(tally.groupBy(year, edition).agg(F.count(F.lit(1)).alias("__rows"), *[F.min(c).alias(c) for c in cands],
                                                       *[(F.min(c) != F.max(c)).alias(f"__mixed_{c}") for c in cands]))
    mixed = per.agg(F.count(F.lit(1)), *[F.max(f"__mixed_{c}").alias(c) for c in cands]).first()
    fd = [c for c in cands if not mixed[c]]
    return per.select(year, edition, *fd), fd


def grid(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of ``left`` with every row of ``right`` (the smaller table, read
    three times): ``right`` is dealt into blocks of some ``BLOCK`` rows, which
    rows of ``left`` meet by (block, salt), so that neither side is broadcast
    and a task holds one block and its share of ``left``."""
    n = right.count()
    blocks = 1 + n // BLOCK
    row = F.struct(*[F.col(c) for c in right.columns])
    dealt = right.groupBy(F.pmod(F.xxhash64(*right.columns), F.lit(blocks)).alias("__block")).agg(F.collect_list(row).alias("__rows"))
    dealt = dealt.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")
    asks = left.withColumn("__salt", salt).withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    return asks.join(dealt, ["__block", "__salt"]).select(*left.columns, F.explode("__rows").alias("__r")).select(*left.columns, "__r.*")


def densify(tally: DataFrame, entities: DataFrame, entity: str, year: str, edition: str,
            zero_cols: Sequence[str], fd_cols: Sequence[str] | None = None) -> DataFrame:
    """Add, for every (year, edition) of the tally, each entity of ``entities``
    that has no row there: ``zero_cols`` = 0, columns functionally dependent on
    (year, edition) copied when the group holds exactly one non-null value,
    every other column NULL.  Returns original rows + added rows.

    Editions and their dependent values are one stored table, joined with the
    entities in blocks (``grid``)."""
    cands = [c for c in tally.columns if c not in (entity, year, edition, *zero_cols)]
    if fd_cols is not None:
        cands = [c for c in cands if c in fd_cols]
    editions, _ = edition_values(tally, year, edition, cands)
    dtypes = dict(tally.dtypes)
    pairs = grid(entities.select(entity).distinct(), editions)
    absent = pairs.join(tally.select(entity, year, edition), [entity, year, edition], "left_anti")
    fill = {c: F.lit(0).cast(dtypes[c]) for c in zero_cols}
    for c in tally.columns:
        if c not in absent.columns and c not in fill:
            fill[c] = F.lit(None).cast(dtypes[c])
    added = absent.withColumns(fill).select(*tally.columns)
    return tally.unionByName(added)


def build_panel(tally: DataFrame, games: DataFrame, series: DataFrame, *, entity: str = "noc",
                year: str = "year", edition: str = "edition", medals: Sequence[str] = (),
                host_values: Sequence[str] = ("host_country", "host_city"),
                indicators: Sequence[str] | None = None, n: int = 4, materialize: bool = True) -> DataFrame:
    """Tally + host per (year, edition) + trailing means + zero-filled rows.
    Column order: tally columns, host columns, indicators.  With
    ``materialize`` the (aggregated, much smaller) tally and series are
    written once to the checkpoint folder instead of being recomputed from
    the raw facts by each branch of the plan."""
    require_columns(tally, [entity, year, edition, *medals], "tally")
    indicators = list(indicators or [c for c in series.columns if c not in (entity, year)])
    if materialize:  # both inputs are read 2-3 times below; aggregate the raw facts only once
        tally, series = cut_lineage(tally), cut_lineage(series)
    dense = densify(tally, series.select(entity), entity, year, edition, list(medals))
    hosts, _ = host_lookup(games, [year, edition], list(host_values))
    with_host = dense.join(hosts, [year, edition], "left")
    out = trailing_mean(with_host, series, entity, year, indicators, n)
    return out.select(*tally.columns, *host_values, *indicators)


def missing_report(tally: DataFrame, games: DataFrame, series: DataFrame, *, entity: str = "noc",
                   year: str = "year", edition: str = "edition", n: int = 4,
                   conflict_keys: Sequence[str] | None = None,
                   host_values: Sequence[str] = ("host_country", "host_city")) -> DataFrame:
    """Data-quality findings as rows (section, line); sort by (section, line) at the sink.

    section 0: conflicting host rows; 1: edition without host row; 2: entity
    without series; 3: entity-edition with window years absent from the
    series; 9: "No missing data found." when nothing else was found."""
    keys = list(conflict_keys or [year, edition])
    tally, series = cut_lineage(tally), cut_lineage(series)  # each is read several times below
    _, conflicts = host_lookup(games, keys, list(host_values))
    key_txt = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys])
    s0 = conflicts.select(F.lit(0).alias("section"),
                          F.concat(F.lit("Conflicting host rows for "), key_txt).alias("line"))
    eds = tally.select(year, edition).distinct()
    s1 = (eds.join(games.select(year, edition), [year, edition], "left_anti")
          .select(F.lit(1).alias("section"),
                  F.format_string("Missing Olympic summary match for year=%s, edition=%s",
                                  F.col(year).cast("string"), F.col(edition)).alias("line")))
    ents = tally.select(entity).filter(F.col(entity).isNotNull()).distinct()
    have = series.select(entity).distinct()
    s2 = (ents.join(have, entity, "left_anti")
          .select(F.lit(2).alias("section"),
                  F.format_string("%s: missing country file", F.col(entity).cast("string")).alias("line")))
    dense = densify(tally.select(entity, year, edition), have, entity, year, edition, [])
    rows = dense.select(entity, year, edition).join(have, entity, "left_semi")
    miss = window_years_present(rows, series, entity, year, n)
    s3 = (rows.join(miss, [entity, year], "inner")
          .filter(F.size("missing_years") > 0)
          .select(F.lit(3).alias("section"),
                  F.format_string("%s - year=%s, edition=%s: missing previous years %s",
                                  F.col(entity).cast("string"), F.col(year).cast("string"),
                                  F.col(edition),
                                  F.array_join(F.col("missing_years").cast("array<string>"), ", "))
                  .alias("line")))
    # findings are small (report lines); materialise them once so the
    # "nothing found" check reads that table instead of recomputing every branch
    found = cut_lineage(s0.unionByName(s1).unionByName(s2).unionByName(s3))
    none = (found.agg(F.count(F.lit(1)).alias("k")).filter("k = 0")
            .select(F.lit(9).alias("section"), F.lit("No missing data found.").alias("line")))
    return found.unionByName(none)


def fill_from_trailing_mean(df: DataFrame, series: DataFrame, entity: str, year: str,
                            target: str, value: str | None = None, n: int = 4) -> DataFrame:
    """Only NULL targets are filled, with the mean of the series value
    over years y-n .. y-1 of the same entity (all NULL / no rows -> stays NULL)."""
    value = value or target
    s = series.select(entity, year, F.col(value).alias("__fill"))
    j = trailing_mean(df, s, entity, year, ["__fill"], n)
    return j.withColumn(target, F.coalesce(F.col(target), F.col("__fill"))).drop("__fill")
