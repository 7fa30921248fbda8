"""Category x group composition queries (E1-E19) on medal rows x income-band labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..operators import composition as E
from . import tables as tb
from ..session import cut_lineage
from .catalog import r_sql, register, rounded
from .sqlbase import chi2_tail_sql, with_

ORDER = dims.INCOME_BAND_ORDER
TOP_N = 30
LABELS_SQL = ", ".join(f"'{x}'" for x in ORDER)

_BASE = ["medal_rows", "roster"]
_LAB = """lab AS (SELECT m.year, m.noc, m.sport, m.event, m.medal, r.label
         FROM medal_rows m LEFT JOIN roster r ON r.year = m.year AND r.noc = m.noc WHERE m.medal <> 'No medal')"""
_UNITS = """units AS (SELECT year, noc, sport, event, medal, label, CAST(count(*) AS BIGINT) AS athletes, 1 AS count
           FROM lab WHERE label IS NOT NULL GROUP BY ALL)"""
_TOP = f"""top AS (SELECT sport, n FROM (SELECT sport, CAST(sum(count) AS BIGINT) AS n FROM units GROUP BY sport)
          ORDER BY n DESC, sport ASC LIMIT {TOP_N})"""
_GRID = f"""grid AS (SELECT g.label, t.sport, CAST(coalesce(c.n, 0) AS BIGINT) AS n
   FROM (SELECT unnest([{LABELS_SQL}]) AS label) g CROSS JOIN top t
   LEFT JOIN (SELECT label, sport, sum(count) AS n FROM units GROUP BY ALL) c ON c.label = g.label AND c.sport = t.sport)"""
_SHARES = """shares AS (SELECT label, sport, n,
     round_even(100.0 * n / nullif(sum(n) OVER (PARTITION BY label), 0), 2) AS pct_of_group,
     round_even(100.0 * n / nullif(sum(n) OVER (PARTITION BY sport), 0), 2) AS pct_of_category FROM grid)"""
_RATES = """rates AS (SELECT r.noc, r.year, r.population, r.label, CAST(coalesce(m.medals, 0) AS BIGINT) AS medals,
     coalesce(m.medals, 0) / (r.population / 1e6) AS rate
   FROM roster r LEFT JOIN (SELECT noc, year, sum(count) AS medals FROM units GROUP BY ALL) m
   ON m.noc = r.noc AND m.year = r.year)"""


def W(*extra: str) -> str:
    return with_(*_BASE, extra=[_LAB, _UNITS, *extra])


def _lab(spark, d):
    return E.attach_label(tb.medal_rows(spark, d), tb.roster(spark, d), ["year", "noc"], "label")


def _units(spark, d):
    return E.event_units(_lab(spark, d), ["year", "noc", "sport", "event", "medal", "label"], required="label")


def _top(spark, d):
    return E.top_categories(_units(spark, d), "sport", TOP_N)


def _grid(spark, d):
    """(label, sport) counts aggregated once and materialised (labels x sports
    rows); the top-sport list and the zero-filled grid both read that small
    table, so the medal rows are scanned once."""
    counts = cut_lineage(_units(spark, d).groupBy("label", "sport").agg(F.sum("count").alias("n")))
    top = E.top_categories(counts, "sport", TOP_N, weight="n")
    return E.counts_grid(counts, "label", "sport", ORDER, E.category_list(top, "sport"), weight="n")


def _rates(spark, d):
    u = _units(spark, d)
    mc = u.groupBy("noc", "year").agg(F.sum("count").alias("medals"))
    return E.roster_rates(tb.roster(spark, d).select("noc", "year", "population", "label"), mc,
                          ["noc", "year"], "population")


@register("comp_label_coverage", W() + """
SELECT CAST(count(label) AS BIGINT) AS matched, CAST(count(*) - count(label) AS BIGINT) AS unmatched,
       round_even(100.0 * count(label) / count(*), 2) AS pct_matched FROM lab""")
def comp_label_coverage(spark, d):
    """Labelled / unlabelled medal rows."""
    return E.label_coverage(_lab(spark, d), "label")


@register("comp_top_unmatched", W() + """
SELECT noc, CAST(count(*) AS BIGINT) AS rows FROM lab WHERE label IS NULL GROUP BY noc
ORDER BY rows DESC, noc ASC LIMIT 10""")
def comp_top_unmatched(spark, d):
    """Ten entities with the most unlabelled medal rows."""
    return E.top_unmatched(_lab(spark, d), "label", "noc", 10)


@register("comp_event_units", W() + "SELECT * FROM units")
def comp_event_units(spark, d):
    """Team medals counted once per (year, noc, sport, event, medal, label)."""
    return _units(spark, d)


@register("comp_top_sports", W(_TOP) + """
SELECT sport, n, CAST(row_number() OVER (ORDER BY n DESC, sport) AS INTEGER) AS rank FROM top""")
def comp_top_sports(spark, d):
    """Top 30 sports by medal units."""
    return _top(spark, d)


@register("comp_top_sports_rows", with_("medal_rows", extra=["""t AS (SELECT sport, CAST(count(*) AS BIGINT) AS n
   FROM medal_rows GROUP BY sport ORDER BY n DESC, sport LIMIT 20)"""]) + """
SELECT sport, n, CAST(row_number() OVER (ORDER BY n DESC, sport) AS INTEGER) AS rank FROM t""")
def comp_top_sports_rows(spark, d):
    """E3 variant: top 20 sports by raw rows."""
    return E.top_categories(tb.medal_rows(spark, d), "sport", 20, weight=None)


@register("comp_share_matrix", W(_TOP, _GRID, _SHARES) + "SELECT * FROM shares")
def comp_share_matrix(spark, d):
    """Percent of label and percent of sport over the top sports, zero-filled."""
    return E.share_matrix(_grid(spark, d), "label", "sport")


@register("comp_top_k_per_label", W("""agg AS (SELECT label, sport, CAST(sum(count) AS BIGINT) AS n FROM units GROUP BY ALL)""",
    """tk AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY n DESC, sport) AS INTEGER) AS rank FROM agg)""") + """
SELECT label, sport, n, rank, round_even(100.0 * n / sum(n) OVER (PARTITION BY label), 2) AS share_of_top
FROM tk WHERE rank <= 10""")
def comp_top_k_per_label(spark, d):
    """E5: top 10 sports per label; share of the top-10 subtotal."""
    return E.top_k_per_group(_units(spark, d), "label", "sport", 10)


@register("comp_specialization", W(_TOP, _GRID,
    """ix AS (SELECT label, sport, n, (CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY label)) /
        (CAST(sum(n) OVER (PARTITION BY sport) AS DOUBLE) / sum(n) OVER ()) AS idx FROM grid)""",
    """rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY idx DESC, sport) AS INTEGER) AS rank_high,
        CAST(row_number() OVER (PARTITION BY label ORDER BY idx ASC, sport) AS INTEGER) AS rank_low FROM ix)""") + f"""
SELECT label, sport, n, {r_sql('idx')} AS "index", rank_high, rank_low,
  CASE WHEN rank_high <= 5 THEN 'top' ELSE 'bottom' END AS side FROM rk WHERE rank_high <= 5 OR rank_low <= 3""")
def comp_specialization(spark, d):
    """Specialisation index over the top sports, absent pairs as 0: top 5 and
    bottom 3 per label."""
    return rounded(E.specialization(_grid(spark, d), "label", "sport"), 6, ["index"])


@register("comp_chi_square", W(_TOP, _GRID, """e AS (SELECT *, sum(n) OVER (PARTITION BY label) * sum(n) OVER (PARTITION BY sport)
   / sum(n) OVER () AS ex FROM grid)""") + f"""
SELECT {r_sql('sum(CASE WHEN ex > 0 THEN (n - ex) * (n - ex) / ex END)', 4)} AS chi2,
  CAST((count(DISTINCT label) - 1) * (count(DISTINCT sport) - 1) AS BIGINT) AS dof FROM e""")
def comp_chi_square(spark, d):
    """Pearson chi-square (no Yates) of label x top sports."""
    r = E.chi_square(_grid(spark, d), "label", "sport")
    return rounded(r.select("chi2", F.col("dof").cast("long").alias("dof")), 4)


@register("comp_chi_square_p", W(_TOP, _GRID, """e AS (SELECT *, sum(n) OVER (PARTITION BY label) * sum(n) OVER (PARTITION BY sport)
   / sum(n) OVER () AS ex FROM grid)""",
    """c AS (SELECT sum(CASE WHEN ex > 0 THEN (n - ex) * (n - ex) / ex END) AS chi2,
   CAST((count(DISTINCT label) - 1) * (count(DISTINCT sport) - 1) AS BIGINT) AS dof FROM e)""") + f"""
SELECT {r_sql('chi2', 4)} AS chi2, dof, {r_sql(chi2_tail_sql('chi2', 'dof'))} AS p_value FROM c""")
def comp_chi_square_p(spark, d):
    """Chi-square with its p-value."""
    r = E.chi_square(_grid(spark, d), "label", "sport").withColumn("dof", F.col("dof").cast("long"))
    return rounded(rounded(r, 4, ["chi2"]), 6, ["p_value"])


@register("comp_share_over_time", W(f"""g AS (SELECT y.year, l.label FROM (SELECT DISTINCT year FROM units WHERE year >= 1995) y
   CROSS JOIN (SELECT unnest([{LABELS_SQL}]) AS label) l)""",
    """c AS (SELECT year, label, sum(count) AS n FROM units WHERE year >= 1995 GROUP BY ALL)""") + """
SELECT g.year, g.label, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
  round_even(100.0 * coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY g.year), 2) AS pct
FROM g LEFT JOIN c ON c.year = g.year AND c.label = g.label""")
def comp_share_over_time(spark, d):
    """Label shares of medal units per year from the first on, zero-filled."""
    return E.share_over_time(_units(spark, d), "year", "label", ORDER, 1995)


@register("comp_accessibility", W(_TOP, _GRID, _SHARES) + f"""
SELECT sport, {r_sql('sum(pct_of_category)')} AS accessible_share,
  CASE WHEN sum(pct_of_category) >= {dims.ACCESSIBLE_MIN} THEN 'accessible'
       WHEN sum(pct_of_category) < {dims.EXCLUSIVE_MAX} THEN 'exclusive' ELSE 'intermediate' END AS class
FROM shares WHERE label IN ('{ORDER[0]}', '{ORDER[1]}') GROUP BY sport""")
def comp_accessibility(spark, d):
    """Summed share of the two lowest bands per sport (dynamic labels)."""
    sh = E.share_matrix(_grid(spark, d), "label", "sport")
    r = E.accessibility(sh, "label", "sport", "pct_of_category", ORDER[:2], dims.ACCESSIBLE_MIN, dims.EXCLUSIVE_MAX)
    return rounded(r, 6, ["accessible_share"])


@register("comp_sport_order", W(_TOP, _GRID, _SHARES) + f"""
SELECT sport, pct_of_category AS rich_share, CAST(row_number() OVER (ORDER BY pct_of_category, sport) AS INTEGER) AS "order"
FROM shares WHERE label = '{ORDER[-1]}'""")
def comp_sport_order(spark, d):
    """Sports ordered by the richest band's share, ascending."""
    sh = E.share_matrix(_grid(spark, d), "label", "sport")
    return E.category_order(sh, "label", "sport", "pct_of_category", ORDER[-1])


@register("comp_roster_rates", W(_RATES) + f"SELECT noc, year, population, label, medals, {r_sql('rate')} AS rate FROM rates")
def comp_roster_rates(spark, d):
    """Medal units per million 'population', zero-filled over the roster."""
    return rounded(_rates(spark, d), 6, ["rate"])


@register("comp_pooled_vs_averaged", W(_RATES) + f"""
SELECT label, {r_sql('sum(medals) / (sum(population) / 1e6)')} AS pooled, {r_sql('avg(rate)')} AS averaged,
  round_even(avg(rate) / (sum(medals) / (sum(population) / 1e6)), 2) AS ratio FROM rates GROUP BY label""")
def comp_pooled_vs_averaged(spark, d):
    """Pooled vs averaged rate per label."""
    return rounded(E.pooled_vs_averaged(_rates(spark, d), "label", "population"), 6, ["pooled", "averaged"])


@register("comp_mean_rate", W(_RATES) + f"""
SELECT label, year, {r_sql('avg(rate)')} AS mean_rate, CAST(count(*) AS BIGINT) AS n FROM rates GROUP BY label, year""")
def comp_mean_rate(spark, d):
    """Unweighted mean rate per (label, year)."""
    return rounded(E.mean_rate_by(_rates(spark, d), ["label", "year"]), 6)


@register("comp_dense_sport_rates", W(_TOP, """c AS (SELECT noc, year, sport, sum(count) AS m FROM units GROUP BY ALL)""") + f"""
SELECT r.label, t.sport, {r_sql('avg(coalesce(c.m, 0) / (r.population / 1e6))')} AS mean_rate
FROM roster r CROSS JOIN top t LEFT JOIN c ON c.noc = r.noc AND c.year = r.year AND c.sport = t.sport
GROUP BY r.label, t.sport""")
def comp_dense_sport_rates(spark, d):
    """Roster x top sports zero-filled, mean rate per (label, sport)."""
    sports = E.category_list(_top(spark, d), "sport")
    r = E.dense_category_rates(tb.roster(spark, d), _units(spark, d), ["noc", "year"], "sport", sports,
                               "population", "label")
    return rounded(r, 6)


_MOB = f"""mob AS (SELECT noc, first_label, last_label, n_years,
     list_position([{LABELS_SQL}], first_label) - 1 AS first_rank, list_position([{LABELS_SQL}], last_label) - 1 AS last_rank
   FROM (SELECT noc, arg_min(label, year) AS first_label, arg_max(label, year) AS last_label,
                CAST(count(DISTINCT year) AS BIGINT) AS n_years FROM roster WHERE label IS NOT NULL GROUP BY noc))"""


@register("comp_mobility", with_("roster", extra=[_MOB]) + """
SELECT noc, first_label, last_label, n_years, CAST(first_rank AS INTEGER) AS first_rank,
  CAST(last_rank AS INTEGER) AS last_rank, CAST(last_rank - first_rank AS INTEGER) AS jump,
  (last_rank <> first_rank AND n_years >= 4) AS mover FROM mob""")
def comp_mobility(spark, d):
    """First / last band per entity, jump, movers (jump != 0, >= 4 years)."""
    return E.mobility(tb.roster(spark, d), "noc", "year", "label", ORDER)


@register("comp_transitions", with_("roster") + """
SELECT noc, year, population, {r_sql('gdp_pc')} AS gdp_pc, label, prev_label FROM (
  SELECT noc, year, population, gdp_pc, label, lag(label) OVER (PARTITION BY noc ORDER BY year) AS prev_label
  FROM roster) WHERE prev_label IS NOT NULL AND prev_label <> label""".replace("{r_sql('gdp_pc')}", r_sql('gdp_pc')))
def comp_transitions(spark, d):
    """Years where an entity's band differs from its previous row."""
    return rounded(E.transition_points(tb.roster(spark, d), "noc", "year", "label"), 6, ["gdp_pc"])


@register("comp_before_after", W(_RATES, _MOB, """mv AS (SELECT noc FROM mob WHERE last_rank <> first_rank AND n_years >= 4)""",
    """ri AS (SELECT r.*, first_value(r.label) OVER (PARTITION BY r.noc ORDER BY r.year) AS init
              FROM rates r WHERE r.noc IN (SELECT noc FROM mv))""",
    """ch AS (SELECT noc, min(year) AS change_time FROM ri WHERE label <> init GROUP BY noc)""") + f"""
SELECT ri.noc, ch.change_time, {r_sql('avg(CASE WHEN ri.year < ch.change_time THEN rate END)')} AS rate_before,
  {r_sql('avg(CASE WHEN ri.year >= ch.change_time THEN rate END)')} AS rate_after,
  {r_sql('''CASE WHEN avg(CASE WHEN ri.year < ch.change_time THEN rate END) > 0 THEN 100 * (avg(CASE WHEN ri.year >= ch.change_time THEN rate END)
     - avg(CASE WHEN ri.year < ch.change_time THEN rate END)) / avg(CASE WHEN ri.year < ch.change_time THEN rate END) END''')} AS pct_change
FROM ri JOIN ch ON ch.noc = ri.noc GROUP BY ri.noc, ch.change_time""")
def comp_before_after(spark, d):
    """Mean rate before and after the first band change, for movers."""
    movers = E.mobility(tb.roster(spark, d), "noc", "year", "label", ORDER).filter("mover")
    return rounded(E.before_after(_rates(spark, d), movers, "noc", "year", "label"), 6)


@register("comp_edition_timeline", W("""mc AS (SELECT noc, year, sum(count) AS medals FROM units GROUP BY ALL)""") + """
SELECT r.year, r.noc, r.label, CAST(dense_rank() OVER (ORDER BY r.year) - 1 AS INTEGER) AS time_index,
  CAST(coalesce(mc.medals, 0) AS BIGINT) AS medals
FROM roster r LEFT JOIN mc ON mc.noc = r.noc AND mc.year = r.year
WHERE r.year IN (SELECT year FROM medal_rows WHERE medal = 'Gold')""")
def comp_edition_timeline(spark, d):
    """Band rows in years with gold medals, dense year index, medals zero-filled."""
    u = _units(spark, d)
    mc = u.groupBy("noc", "year").agg(F.sum("count").alias("medals"))
    eds = tb.medal_rows(spark, d).filter(F.col("medal") == "Gold").select("year")
    lab = tb.roster(spark, d).select("year", "noc", "label")
    r = E.edition_timeline(lab, eds, mc, "noc", "year")
    return r.select("year", "noc", "label", F.col("time_index").cast("int"), "medals")


@register("comp_latest_rows", with_("roster") + """
SELECT noc, year, population, GDP AS gdp_pc, label FROM (SELECT *, row_number() OVER (PARTITION BY noc ORDER BY year DESC) AS rn
  FROM roster) WHERE rn = 1""".replace("GDP", r_sql('gdp_pc')))
def comp_latest_rows(spark, d):
    """Newest roster row per entity."""
    return rounded(E.latest_rows(tb.roster(spark, d), "noc", "year"), 6, ["gdp_pc"])
