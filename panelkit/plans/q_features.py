"""Derived-feature queries (C1-C10) bound to the driver tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from .. import dims
from ..operators import features as C
from . import tables as tb
from .catalog import ORACLE, QUERIES, r_sql, register, rounded
from .sqlbase import with_

IND = tb.INDICATORS


def _spread_sql(x: str, both: str) -> str:
    sd = f"stddev_pop({x}) FILTER (WHERE {both})"
    return f"(CASE WHEN {sd} <= 1e-9 * abs(avg({x}) FILTER (WHERE {both})) THEN 0.0 ELSE {sd} END)"


def corr_sql(a: str, b: str) -> str:
    both = f"({a} IS NOT NULL AND {b} IS NOT NULL)"
    return (f"(covar_pop({a}, {b}) FILTER (WHERE {both}) / nullif({_spread_sql(a, both)} * "
            f"{_spread_sql(b, both)}, 0))")


def _pb() -> str:
    return f"WITH pb AS ({ORACLE['panel_build']})\n"


def _panel(spark, d):
    return QUERIES["panel_build"](spark, d)


@register("features_per_capita", _pb() + """
SELECT noc, year, edition,
  round_even(total / (n_lines / 1e6), 4) AS medals_per_million,
  round_even(gold / (n_lines / 1e6), 4) AS gold_per_million,
  round_even(total / (spend / 1e9), 4) AS medals_per_gdp_bn,
  CAST(total > 0 AS INTEGER) AS won_medal
FROM pb""")
def features_per_capita(spark, d):
    """C1 on the panel: lines stand for population, spend for GDP."""
    p = _panel(spark, d)
    out = C.per_capita(p, total="total", gold="gold", pop="n_lines", gdp="spend")
    return out.select("noc", "year", "edition", "medals_per_million", "gold_per_million",
                      "medals_per_gdp_bn", "won_medal")


@register("features_log", _pb() + f"""
SELECT noc, year, edition, {r_sql('ln(1 + spend)')} AS log_gdp_total, {r_sql('ln(1 + n_lines)')} AS log_pop,
  {r_sql('ln(1 + qty)')} AS log_gdp_pc, {r_sql('ln(1 + total)')} AS log_medals,
  {r_sql('CASE WHEN total > 0 THEN gold / total END')} AS gold_share
FROM pb""")
def features_log(spark, d):
    """C2 on the panel."""
    p = _panel(spark, d)
    out = C.log_features(p, {"log_gdp_total": "spend", "log_pop": "n_lines", "log_gdp_pc": "qty",
                             "log_medals": "total"}, gold="gold", total="total")
    return rounded(out.select("noc", "year", "edition", "log_gdp_total", "log_pop", "log_gdp_pc",
                              "log_medals", "gold_share"), 6)


@register("features_period", with_("tally") + f"""
SELECT noc, edition, year, CAST(floor(year / 10) * 10 AS INTEGER) || 's' AS decade,
  CASE WHEN year <= {dims.EARLY_PERIOD_MAX} THEN '{dims.PERIOD_LABELS[0]}' ELSE '{dims.PERIOD_LABELS[1]}' END AS period
FROM tally""")
def features_period(spark, d):
    """Decade label and the two-way period split."""
    t = tb.tally(spark, d).select("noc", "edition", "year")
    return t.withColumns({"decade": C.decade_label("year"),
                          "period": C.period_label("year", dims.EARLY_PERIOD_MAX, *dims.PERIOD_LABELS)})


@register("features_lags", with_("tally") + """
SELECT noc, year, edition, total,
  lag(total, 1) OVER (PARTITION BY noc ORDER BY year, edition) AS prev_total,
  lag(total, 2) OVER (PARTITION BY noc ORDER BY year, edition) AS prev_total_2
FROM tally""")
def features_lags(spark, d):
    """C4: previous and second-previous medal totals per entity (row-based)."""
    t = tb.tally(spark, d).select("noc", "year", "edition", "total")
    return C.lag_features(t, "noc", ["year", "edition"], "total")


_INTERP_SQL = with_("series", extra=["""s2 AS (SELECT noc, year, urgent_value AS x,
      row_number() OVER (PARTITION BY noc ORDER BY year) AS pos FROM series)""",
    """s3 AS (SELECT *,
      last_value(CASE WHEN x IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY noc ORDER BY year
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lp,
      last_value(x IGNORE NULLS) OVER (PARTITION BY noc ORDER BY year
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lv,
      first_value(CASE WHEN x IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY noc ORDER BY year
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hp,
      first_value(x IGNORE NULLS) OVER (PARTITION BY noc ORDER BY year
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hv FROM s2)""",
    """s4 AS (SELECT noc, year, x AS before, CASE WHEN x IS NOT NULL THEN x
         WHEN lp IS NOT NULL AND hp IS NOT NULL THEN lv + (hv - lv) * (CAST(pos - lp AS DOUBLE) / (hp - lp)) END AS after
         FROM s3)"""])


@register("features_interpolate", _INTERP_SQL + f"""
SELECT noc, year, {r_sql('after')} AS urgent_value FROM s4""")
def features_interpolate(spark, d):
    """Positional linear interpolation of the urgent-order price inside gaps."""
    s = tb.series(spark, d).select("noc", "year", "urgent_value")
    return rounded(C.interpolate_inside(s, "noc", ["year"], ["urgent_value"]), 6)


@register("features_interp_counts", _INTERP_SQL + """
SELECT 'before' AS stage, 'urgent_value' AS "column", CAST(count(*) FILTER (WHERE before IS NULL) AS BIGINT) AS n_null FROM s4
UNION ALL SELECT 'after', 'urgent_value', CAST(count(*) FILTER (WHERE after IS NULL) AS BIGINT) FROM s4""")
def features_interp_counts(spark, d):
    """NULL counts before and after the interpolation."""
    s = tb.series(spark, d).select("noc", "year", "urgent_value")
    before = C.null_counts(s, ["urgent_value"], "before")
    after = C.null_counts(C.interpolate_inside(s, "noc", ["year"], ["urgent_value"]), ["urgent_value"], "after")
    return before.unionByName(after)


@register("features_host_literal", with_("tally", "games") + """
SELECT t.noc, t.year, t.edition, coalesce(CAST(t.country = h.host_country AS INTEGER), 0) AS is_host
FROM tally t LEFT JOIN (SELECT year, host_country FROM games WHERE edition LIKE '%Summer') h ON t.year = h.year""")
def features_host_literal(spark, d):
    """C6 (a): year -> host table (summer editions), equality on the name."""
    t = tb.tally(spark, d).select("noc", "year", "edition", "country")
    hosts = tb.games(spark, d).filter(F.col("edition").endswith("Summer")) \
        .select("year", F.col("host_country").alias("host"))
    return C.host_flag_literal(t, "year", "country", hosts).drop("country")


@register("features_host_mode", _pb() + """
, m AS (SELECT year, mode() WITHIN GROUP (ORDER BY upper(trim(host_country))) AS h FROM pb GROUP BY year)
SELECT pb.noc, pb.year, pb.edition, coalesce(CAST(upper(trim(pb.country)) = m.h AS INTEGER), 0) AS is_host
FROM pb LEFT JOIN m ON pb.year = m.year""")
def features_host_mode(spark, d):
    """C6 (b): host per year = modal host code of the year's panel rows."""
    p = _panel(spark, d).select("noc", "year", "edition", "country", "host_country")
    return C.host_flag_mode(p, "year", "country", "host_country").drop("country", "host_country")


def _corr_matrix_sql() -> str:
    parts = []
    for a, b in combinations(IND, 2):
        parts.append(f"SELECT noc, '{a}' AS i, '{b}' AS j, {corr_sql(a, b)} AS r FROM series GROUP BY noc")
        parts.append(f"SELECT noc, '{b}' AS i, '{a}' AS j, {corr_sql(a, b)} AS r FROM series GROUP BY noc")
    for a in IND:
        parts.append(f"SELECT noc, '{a}', '{a}', CASE WHEN {_spread_sql(a, 'TRUE')} > 0 THEN 1.0 END FROM series GROUP BY noc")
    return " UNION ALL ".join(parts)


@register("features_corr_matrix", with_("series", extra=[f"m AS ({_corr_matrix_sql()})"]) + f"""
SELECT noc, i, j, {r_sql('r')} AS r FROM m""")
def features_corr_matrix(spark, d):
    """Per-entity Pearson matrix of the five indicators over years."""
    return rounded(C.entity_corr_matrix(tb.series(spark, d), "noc", IND), 6)


@register("features_corr_prune", with_("series", extra=[
    f"m AS ({_corr_matrix_sql()})",
    "per AS (SELECT noc, i, avg(abs(r)) AS a FROM m GROUP BY noc, i)",
    "o AS (SELECT i AS indicator, avg(a) AS mean_abs_r FROM per GROUP BY i)"]) + f"""
SELECT indicator, {r_sql('mean_abs_r')} AS mean_abs_r, mean_abs_r > 0.70 AS above_warn,
  mean_abs_r > 0.75 AS above_threshold, (mean_abs_r > 0.75 AND indicator NOT IN ('spend')) AS "drop"
FROM o""")
def features_corr_prune(spark, d):
    """Mean |r| per indicator over entities, flags > .70 / > .75, drop unless kept."""
    out = C.prune_correlated(tb.series(spark, d), "noc", IND, 0.75, 0.70, keep=["spend"])
    return rounded(out, 6)


@register("features_fill_mean", with_("series") + f"""
SELECT noc, year, {r_sql('coalesce(urgent_value, avg(urgent_value) OVER (PARTITION BY noc))')} AS urgent_value
FROM series""")
def features_fill_mean(spark, d):
    """NULL -> entity mean."""
    s = tb.series(spark, d).select("noc", "year", "urgent_value")
    return rounded(C.fill_series_mean(s, "noc", ["urgent_value"]), 6)


@register("features_pca1")
def features_pca1(spark, d):
    """First principal component per entity over its years (checked
    against numpy in tests; sign and scaling conventions differ by engine)."""
    return C.entity_pca1(tb.series(spark, d), "noc", "year", IND)
