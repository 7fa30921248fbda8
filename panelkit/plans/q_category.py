"""Category-split (gender) queries (G1-G17) on line items as athlete events."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions.semantics import div
from ..operators import category as G
from . import tables as tb
from .catalog import r_sql, register, rounded
from .sqlbase import with_

FEM, MAS, MIX = "Femminile", "Maschile", dims.EVENT_GENDER_DEFAULT
TEAM_KEYS = ["year", "noc", "sport", "event", "medal", "event_gender"]


def _prep(spark, d):
    e = G.prepare_events(tb.raw_events(spark, d), tb.bio(spark, d), athlete="athlete_id", sex="sex",
                         medal="medal", team="is_team", edition="edition", contains="Summer", y0=1995, y1=2001)
    return e.withColumn("event_gender", G.event_gender("event_name", tb.PART_GENDER_RULES))


def _units(spark, d):
    return G.medal_units(_prep(spark, d), "is_team", TEAM_KEYS)


def _mbg(spark, d):
    return G.medals_by_category(_units(spark, d), ["year", "noc"], "event_gender", FEM, MAS, MIX)


def _part(spark, d):
    return G.participants_by_category(_prep(spark, d), "year", "athlete_id", "athlete_sex", [FEM, MAS])


_R_MBG = f"year, noc, medals_f, medals_m, medals_mixed, medals_tot, {r_sql('share_f')} AS share_f, gap_fm, {r_sql('share_m')} AS share_m"


@register("cat_prepare", with_("prep") + """
SELECT year, noc, athlete_id, event, medal, is_team, athlete_sex, has_medal, event_gender FROM prep""")
def cat_prepare(spark, d):
    """G1 + G2: summer rows 1995-2001, team flag from text, sex labels, medal flag, event gender."""
    return _prep(spark, d).select("year", "noc", "athlete_id", "event", "medal", "is_team", "athlete_sex",
                                  "has_medal", "event_gender")


@register("cat_event_gender_counts", with_("prep") + """
SELECT event_gender, CAST(count(DISTINCT event_name) AS BIGINT) AS n_events FROM prep GROUP BY event_gender""")
def cat_event_gender_counts(spark, d):
    """Distinct events per event gender."""
    return _prep(spark, d).groupBy("event_gender").agg(F.count_distinct("event_name").alias("n_events"))


@register("cat_crosstab", with_("prep") + """
SELECT event_gender, athlete_sex, CAST(count(*) AS BIGINT) AS n FROM prep GROUP BY ALL""")
def cat_crosstab(spark, d):
    """Event gender x athlete sex."""
    return G.crosstab(_prep(spark, d), "event_gender", "athlete_sex")


@register("cat_medal_units", with_("gunits") + "SELECT * FROM gunits")
def cat_medal_units(spark, d):
    """Individual medal rows plus team medals counted once."""
    return _units(spark, d)


@register("cat_medals_by_gender", with_("mbg") + f"SELECT {_R_MBG} FROM mbg")
def cat_medals_by_gender(spark, d):
    """Female / male / mixed medal units per (year, noc), shares and gap."""
    return rounded(_mbg(spark, d), 6)


@register("cat_reconcile", with_("mbg", extra=["""off AS (SELECT year, noc, CAST(count(*) AS BIGINT) AS official
   FROM raw_events WHERE medal <> '' AND contains(lower(edition), 'summer') GROUP BY year, noc)""",
    """j AS (SELECT m.medals_tot AS a, o.official AS b FROM mbg m JOIN off o ON o.year = m.year AND o.noc = m.noc)"""]) + f"""
SELECT {r_sql('covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0)')} AS r,
  {r_sql('avg(abs(a - b))')} AS mean_abs_diff, CAST(count(*) AS BIGINT) AS n FROM j""")
def cat_reconcile(spark, d):
    """Our unit counts vs raw medal-row counts per (year, noc): r and mean |diff|."""
    off = tb.raw_events(spark, d).filter((F.col("medal") != "") & F.lower("edition").contains("summer")) \
        .groupBy("year", "noc").agg(F.count(F.lit(1)).alias("official"))
    return rounded(G.reconcile(_mbg(spark, d), off, ["year", "noc"], "medals_tot", "official"), 6)


_PART_SQL = """part AS (SELECT year, athlete_sex, CAST(count(*) AS BIGINT) AS athletes,
   count(*) / sum(count(*)) OVER (PARTITION BY year) AS share
   FROM (SELECT DISTINCT year, athlete_id, athlete_sex FROM prep WHERE athlete_sex IN ('Femminile', 'Maschile'))
   GROUP BY year, athlete_sex)"""


@register("cat_participants", with_("prep", extra=[_PART_SQL]) + f"""
SELECT year, athlete_sex, athletes, {r_sql('share')} AS share FROM part""")
def cat_participants(spark, d):
    """Distinct athletes per year by known sex, share of F+M."""
    return rounded(_part(spark, d), 6)


@register("cat_share_comparison", with_("mbg", extra=[_PART_SQL]) + f"""
SELECT year, 'atlete' AS misura, {r_sql('share')} AS share FROM part WHERE athlete_sex = 'Femminile'
UNION ALL
SELECT year, 'medaglie', {r_sql('sum(medals_f) / CAST(sum(medals_f) + sum(medals_m) AS DOUBLE)')} FROM mbg GROUP BY year""")
def cat_share_comparison(spark, d):
    """Female athlete share vs female medal share per year, stacked."""
    a = _part(spark, d).filter(F.col("athlete_sex") == FEM)
    m = _mbg(spark, d).groupBy("year").agg(
        div(F.sum("medals_f"), F.sum("medals_f") + F.sum("medals_m")).alias("share"))
    return rounded(G.share_comparison(a, m, "year"), 6)


@register("cat_yield", with_("mbg", extra=[_PART_SQL, """ml AS (
   SELECT year, 'Femminile' AS gender, sum(medals_f) AS medals FROM mbg GROUP BY year UNION ALL
   SELECT year, 'Maschile', sum(medals_m) FROM mbg GROUP BY year)"""]) + f"""
SELECT ml.year, ml.gender, CAST(ml.medals AS BIGINT) AS medals, p.athletes,
  {r_sql('100.0 * ml.medals / p.athletes')} AS yield_100
FROM ml JOIN part p ON p.year = ml.year AND p.athlete_sex = ml.gender""")
def cat_yield(spark, d):
    """Medals per 100 athletes by gender and year."""
    m = _mbg(spark, d)
    ml = m.groupBy("year").agg(F.sum("medals_f").alias(FEM), F.sum("medals_m").alias(MAS)) \
        .unpivot(["year"], [FEM, MAS], "gender", "medals")
    at = _part(spark, d).select("year", F.col("athlete_sex").alias("gender"), "athletes")
    return rounded(G.yield_per_100(ml, at, ["year", "gender"]), 6)


@register("cat_country_share", with_("mbg", extra=["""nm AS (SELECT n.n_name AS noc, n.n_name || ' (' || r.r_name || ')' AS name
   FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey)"""]) + f"""
SELECT a.noc, a.medals_f, a.medals_m, a.fm, {r_sql('a.medals_f / CAST(a.fm AS DOUBLE)')} AS share_f,
  coalesce(nm.name, CAST(a.noc AS VARCHAR)) AS name
FROM (SELECT noc, CAST(sum(medals_f) AS BIGINT) AS medals_f, CAST(sum(medals_m) AS BIGINT) AS medals_m,
             CAST(sum(medals_f) + sum(medals_m) AS BIGINT) AS fm FROM mbg GROUP BY noc) a
LEFT JOIN nm ON nm.noc = a.noc WHERE a.fm >= 25""")
def cat_country_share(spark, d):
    """Whole-period female share per nation with at least 25 F+M medals."""
    n = tb.load(spark, d, "nation")
    r = tb.load(spark, d, "region")
    names = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_name").alias("noc"), F.concat(F.col("n_name"), F.lit(" ("), F.col("r_name"), F.lit(")")).alias("name"),
        F.lit(0).alias("year"))
    return rounded(G.entity_share(_mbg(spark, d), "noc", 25, names), 6)


@register("cat_period_shift", with_("mbg", extra=[f"""p AS (SELECT noc, CASE WHEN year <= {dims.EARLY_PERIOD_MAX} THEN 'early' ELSE 'late' END AS period,
   sum(medals_f) AS f, sum(medals_m) AS m FROM mbg GROUP BY ALL)"""]) + f"""
SELECT e.noc, {r_sql('e.f / CAST(e.f + e.m AS DOUBLE)')} AS share_early, CAST(e.f + e.m AS BIGINT) AS fm_early,
  {r_sql('l.f / CAST(l.f + l.m AS DOUBLE)')} AS share_late, CAST(l.f + l.m AS BIGINT) AS fm_late,
  {r_sql('l.f / CAST(l.f + l.m AS DOUBLE) - e.f / CAST(e.f + e.m AS DOUBLE)')} AS delta
FROM p e JOIN p l ON e.noc = l.noc AND e.period = 'early' AND l.period = 'late'
WHERE e.f + e.m >= 10 AND l.f + l.m >= 10""")
def cat_period_shift(spark, d):
    """Female share up to 1996 vs later, both periods with >= 10 F+M medals."""
    return rounded(G.period_shift(_mbg(spark, d), "noc", "year", dims.EARLY_PERIOD_MAX, 10, ("early", "late")), 6)


@register("cat_zero_panel", with_("mbg", "nation_year") + f"""
SELECT y.noc, y.year, {r_sql('y.gdp')} AS gdp, y.population, y.n_orders,
  CAST(coalesce(m.medals_f, 0) AS BIGINT) AS medals_f, CAST(coalesce(m.medals_m, 0) AS BIGINT) AS medals_m,
  CAST(coalesce(m.medals_mixed, 0) AS BIGINT) AS medals_mixed, CAST(coalesce(m.medals_tot, 0) AS BIGINT) AS medals_tot,
  {r_sql('coalesce(m.medals_f, 0) / nullif(CAST(coalesce(m.medals_f, 0) + coalesce(m.medals_m, 0) AS DOUBLE), 0)')} AS share_f
FROM nation_year y LEFT JOIN mbg m ON m.noc = y.noc AND m.year = y.year""")
def cat_zero_panel(spark, d):
    """Nation-year indicators with zero-filled gender medal counts."""
    ny = tb.nation_year(spark, d).select("noc", "year", "gdp", "population", "n_orders")
    return rounded(G.zero_filled_panel(ny, _mbg(spark, d), ["noc", "year"]), 6)


_DELEG = ["""ath AS (SELECT year, noc, CAST(count(*) FILTER (WHERE athlete_sex = 'Femminile') AS BIGINT) AS athletes_f,
     CAST(count(*) FILTER (WHERE athlete_sex = 'Maschile') AS BIGINT) AS athletes_m, CAST(count(*) AS BIGINT) AS athletes_tot
   FROM (SELECT DISTINCT year, noc, athlete_id, athlete_sex FROM prep) GROUP BY year, noc)""",
          """nm AS (SELECT noc, mode() WITHIN GROUP (ORDER BY trim(country)) AS name FROM bio GROUP BY noc)""",
          """dl AS (SELECT coalesce(a.year, m.year) AS year, coalesce(a.noc, m.noc) AS noc, a.athletes_f, a.athletes_m,
     a.athletes_tot, a.athletes_f / CAST(a.athletes_tot AS DOUBLE) AS athlete_share_f, m.medals_f, m.medals_m, m.medals_tot,
     m.share_f, m.share_f / nullif(a.athletes_f / CAST(a.athletes_tot AS DOUBLE), 0) AS success_index
   FROM ath a FULL JOIN mbg m ON a.year = m.year AND a.noc = m.noc)"""]


def _deleg(spark, d):
    p = _prep(spark, d)
    return G.delegation_panel(p, _mbg(spark, d), time="year", entity="noc", athlete="athlete_id", cat="athlete_sex",
                              female=FEM, male=MAS, bio_names=tb.bio(spark, d), name_col="country")


@register("cat_delegation", with_("mbg", extra=_DELEG) + f"""
SELECT dl.year, dl.noc, athletes_f, athletes_m, athletes_tot, {r_sql('athlete_share_f')} AS athlete_share_f,
  medals_f, medals_m, medals_tot, {r_sql('share_f')} AS share_f, {r_sql('success_index')} AS success_index,
  coalesce(nm.name, CAST(dl.noc AS VARCHAR)) AS name
FROM dl LEFT JOIN nm ON nm.noc = dl.noc""")
def cat_delegation(spark, d):
    """Athletes by sex incl. unknown, medals, success index, modal name."""
    return rounded(_deleg(spark, d), 6)


@register("cat_global_trend", with_("mbg", extra=["""t AS (SELECT year, CAST(sum(medals_f) AS DOUBLE) AS f,
   CAST(sum(medals_m) AS DOUBLE) AS m, CAST(sum(medals_mixed) AS DOUBLE) AS mixed, CAST(sum(medals_tot) AS DOUBLE) AS tot
   FROM mbg GROUP BY year)"""]) + f"""
SELECT year, measure, {r_sql('value')} AS value FROM (
  SELECT year, 'f' AS measure, f AS value FROM t UNION ALL SELECT year, 'm', m FROM t UNION ALL
  SELECT year, 'mixed', mixed FROM t UNION ALL SELECT year, 'tot', tot FROM t UNION ALL
  SELECT year, 'share_f', f / nullif(f + m, 0) FROM t UNION ALL SELECT year, 'share_m', m / nullif(f + m, 0) FROM t)""")
def cat_global_trend(spark, d):
    """Yearly totals and recomputed shares, long."""
    return rounded(G.global_trend(_mbg(spark, d), "year"), 6)


_RECENT = ["""rc AS (SELECT noc, CAST(sum(medals_f) AS BIGINT) AS medals_f, CAST(sum(medals_m) AS BIGINT) AS medals_m,
     CAST(sum(medals_tot) AS BIGINT) AS medals_tot FROM mbg WHERE year >= 2000 GROUP BY noc)""",
           """ra AS (SELECT noc, sum(athletes_f) / CAST(sum(athletes_tot) AS DOUBLE) AS athlete_share_f
     FROM ath WHERE year >= 2000 GROUP BY noc)""",
           """rx AS (SELECT rc.*, medals_f / nullif(CAST(medals_f + medals_m AS DOUBLE), 0) AS share_f, medals_tot >= 5 AS above_min,
     ra.athlete_share_f, (medals_f / nullif(CAST(medals_f + medals_m AS DOUBLE), 0)) / nullif(ra.athlete_share_f, 0) AS success_index
     FROM rc LEFT JOIN ra ON ra.noc = rc.noc)"""]
_RX_COLS = (f"noc, medals_f, medals_m, medals_tot, {r_sql('share_f')} AS share_f, above_min, "
            f"{r_sql('athlete_share_f')} AS athlete_share_f, {r_sql('success_index')} AS success_index")


def _ath(spark, d):
    return _deleg(spark, d).filter(F.col("athletes_tot").isNotNull()).select(
        "year", "noc", "athletes_f", "athletes_tot")


@register("cat_recent", with_("mbg", extra=_DELEG[:1] + _RECENT) + f"""
SELECT {_RX_COLS} FROM rx ORDER BY medals_tot DESC, noc LIMIT 15""")
def cat_recent(spark, d):
    """2000 onwards per nation: shares, success index, top 15 by medals."""
    return rounded(G.recent_entities(_mbg(spark, d), "noc", "year", 2000, 15, 5, _ath(spark, d)), 6)


@register("cat_specialists", with_("mbg", extra=_DELEG[:1] + _RECENT) + f"""
SELECT {_RX_COLS} FROM rx WHERE medals_tot >= 10 AND success_index IS NOT NULL
ORDER BY success_index DESC, noc LIMIT 15""")
def cat_specialists(spark, d):
    """Nations with >= 10 medals since 2000, top 15 by success index."""
    r = G.recent_totals(_mbg(spark, d), "noc", "year", 2000, 5, _ath(spark, d))
    return rounded(G.specialists(r, "noc", "success_index", "medals_tot", 10, 15), 6)


@register("cat_share_heat", with_("mbg") + f"""
SELECT noc, year, {r_sql('coalesce(share_f, 0.0)')} AS share_f FROM mbg
WHERE medals_tot > 0 AND noc IN (SELECT noc FROM mbg GROUP BY noc ORDER BY sum(medals_f) DESC, noc LIMIT 12)""")
def cat_share_heat(spark, d):
    """Yearly female share of the 12 nations with most female medals."""
    return rounded(G.share_heat(_mbg(spark, d), "noc", "year", 12), 6)
