"""Panel construction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel as P
from . import tables as tb
from .catalog import r_sql, register, rounded
from .sqlbase import with_

IND = tb.INDICATORS
_R = ", ".join(f"{r_sql('tm.' + c)} AS {c}" for c in IND)
_AVG = ", ".join(f"avg(s.{c}) AS {c}" for c in IND)

_DENSE = [
    "ed AS (SELECT DISTINCT year, edition FROM tally)",
    "ent AS (SELECT DISTINCT noc FROM series)",
    """fdv AS (SELECT year, edition,
                CASE WHEN min(edition_id) = max(edition_id) THEN min(edition_id) END AS edition_id
                FROM tally GROUP BY year, edition)""",
    """added AS (SELECT e.edition, f.edition_id, e.year, CAST(NULL AS VARCHAR) AS country, n.noc,
                  CAST(0 AS BIGINT) AS gold, CAST(0 AS BIGINT) AS silver, CAST(0 AS BIGINT) AS bronze,
                  CAST(0 AS BIGINT) AS total
                FROM ed e CROSS JOIN ent n LEFT JOIN fdv f ON f.year = e.year AND f.edition = e.edition
                WHERE NOT EXISTS (SELECT 1 FROM tally t
                                  WHERE t.noc = n.noc AND t.year = e.year AND t.edition = e.edition))""",
    "dense AS (SELECT * FROM tally UNION ALL SELECT * FROM added)",
]
_TM = [f"""tm AS (SELECT d.noc, d.year, {_AVG}
          FROM (SELECT DISTINCT noc, year FROM dense) d
          JOIN series s ON s.noc = d.noc AND s.year BETWEEN d.year - 4 AND d.year - 1
          GROUP BY d.noc, d.year)"""]


@register("panel_build", with_("tally", "series", "games", extra=_DENSE + _TM) + f"""
SELECT d.edition, d.edition_id, d.year, d.country, d.noc, d.gold, d.silver, d.bronze, d.total,
       g.host_country, g.host_city, {_R}
FROM dense d
LEFT JOIN games g ON g.year = d.year AND g.edition = d.edition
LEFT JOIN tm ON tm.noc = d.noc AND tm.year = d.year""")
def panel_build(spark, d):
    """F5 = F1 + F2 + F3: the enriched, zero-filled entity x edition panel."""
    out = P.build_panel(tb.tally(spark, d), tb.games(spark, d), tb.series(spark, d),
                        medals=tb.MEDALS + ["total"], indicators=IND, n=4)
    return rounded(out, 6, IND)


@register("panel_trailing_mean", with_("tally", "series", extra=[
    f"""tm AS (SELECT d.noc, d.year, {_AVG}
        FROM (SELECT DISTINCT noc, year FROM tally) d
        JOIN series s ON s.noc = d.noc AND s.year BETWEEN d.year - 4 AND d.year - 1
        GROUP BY d.noc, d.year)"""]) + f"""
SELECT t.edition, t.noc, t.year, t.total, {_R}
FROM tally t LEFT JOIN tm ON tm.noc = t.noc AND tm.year = t.year""")
def panel_trailing_mean(spark, d):
    """F1 alone on the medal rows."""
    t = tb.tally(spark, d).select("edition", "noc", "year", "total")
    return rounded(P.trailing_mean(t, tb.series(spark, d), "noc", "year", IND, 4), 6, IND)


@register("panel_host_lookup", with_("games") + """
SELECT year, edition, host_country, host_city FROM games""")
def panel_host_lookup(spark, d):
    """F2 keyed by (year, edition): one host per edition."""
    lookup, _ = P.host_lookup(tb.games(spark, d), ["year", "edition"], ["host_country", "host_city"])
    return lookup


@register("panel_host_conflicts", with_("games") + """
SELECT year, CAST(count(DISTINCT (host_country, host_city)) AS BIGINT) AS n_variants
FROM games GROUP BY year HAVING count(DISTINCT (host_country, host_city)) > 1""")
def panel_host_conflicts(spark, d):
    """F2 keyed by year only (older builder): Winter and Summer conflict; first kept, reported."""
    _, conflicts = P.host_lookup(tb.games(spark, d), ["year"], ["host_country", "host_city"],
                                 order=["edition"])
    return conflicts.select("year", "n_variants")


@register("panel_densify", with_("tally", "series", extra=_DENSE) + """
SELECT edition, edition_id, year, country, noc, gold, silver, bronze, total FROM dense""")
def panel_densify(spark, d):
    """zero rows for entities with series but no tally row in an edition."""
    t = tb.tally(spark, d)
    return P.densify(t, tb.series(spark, d).select("noc"), "noc", "year", "edition",
                     tb.MEDALS + ["total"])


@register("panel_missing_report", with_("tally", "series", "games", extra=_DENSE + [
    """have AS (SELECT DISTINCT noc, year FROM series)""",
    """rows_ AS (SELECT DISTINCT d.noc, d.year, d.edition FROM dense d WHERE d.noc IN (SELECT noc FROM ent))""",
    """miss AS (SELECT r.noc, r.year, r.edition,
                  string_agg(CAST(y.y AS VARCHAR), ', ' ORDER BY y.y) AS yrs
                FROM rows_ r, LATERAL (SELECT unnest(range(r.year - 4, r.year)) AS y) y
                WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.noc = r.noc AND h.year = y.y)
                GROUP BY r.noc, r.year, r.edition)""",
    """found AS (
       SELECT 1 AS section, 'Missing Olympic summary match for year=' || CAST(e.year AS VARCHAR)
              || ', edition=' || e.edition AS line
       FROM ed e WHERE NOT EXISTS (SELECT 1 FROM games g WHERE g.year = e.year AND g.edition = e.edition)
       UNION ALL
       SELECT 2, CAST(x.noc AS VARCHAR) || ': missing country file'
       FROM (SELECT DISTINCT noc FROM tally WHERE noc IS NOT NULL) x WHERE x.noc NOT IN (SELECT noc FROM ent)
       UNION ALL
       SELECT 3, CAST(noc AS VARCHAR) || ' - year=' || CAST(year AS VARCHAR) || ', edition=' || edition
              || ': missing previous years ' || yrs FROM miss)"""]) + """
SELECT section, line FROM found
UNION ALL SELECT 9, 'No missing data found.' WHERE (SELECT count(*) FROM found) = 0""")
def panel_missing_report(spark, d):
    """findings lines (section, line)."""
    return P.missing_report(tb.tally(spark, d), tb.games(spark, d), tb.series(spark, d))


@register("panel_fd_columns", with_("tally", extra=[
    """per AS (SELECT year, edition, count(DISTINCT edition_id) AS edition_id, count(DISTINCT country) AS country,
                 count(DISTINCT noc) AS noc, count(DISTINCT gold) AS gold FROM tally GROUP BY year, edition)"""]) + """
SELECT column_name FROM (
  SELECT 'edition_id' AS column_name, max(edition_id) AS m FROM per UNION ALL
  SELECT 'country', max(country) FROM per UNION ALL
  SELECT 'noc', max(noc) FROM per UNION ALL
  SELECT 'gold', max(gold) FROM per) WHERE m <= 1""")
def panel_fd_columns(spark, d):
    """Columns with at most one distinct non-null value per (year, edition)."""
    t = tb.tally(spark, d)
    cols = P.column_fd(t, ["year", "edition"], ["edition_id", "country", "noc", "gold"])
    return spark.createDataFrame([(c,) for c in cols], "column_name string")
