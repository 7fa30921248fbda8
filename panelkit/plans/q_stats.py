"""Statistics-on-drivers queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..operators import drivers as H
from . import tables as tb
from .catalog import ORACLE, QUERIES, r_sql, register, rounded
from .q_features import _spread_sql
from .sqlbase import t_tail_sql, with_

XS = ["log_gdp", "log_pop", "log_gdp_pc", "n_orders"]
YS = ["log_medals_f", "log_medals_m"]


def _zp(spark, d):
    z = QUERIES["cat_zero_panel"](spark, d)
    return z.withColumns({"log_gdp": F.log(F.col("gdp")), "log_pop": F.log(F.col("population")),
                          "log_gdp_pc": F.log(F.col("gdp") / F.col("population")),
                          "log_medals_f": F.log1p("medals_f"), "log_medals_m": F.log1p("medals_m")})


def _zp_sql() -> str:
    return f"""WITH zp0 AS ({ORACLE['cat_zero_panel']}),
zp AS (SELECT *, ln(gdp) AS log_gdp, ln(population) AS log_pop, ln(gdp / population) AS log_gdp_pc,
              ln(1 + medals_f) AS log_medals_f, ln(1 + medals_m) AS log_medals_m FROM zp0)
"""


def _corr(a: str, b: str) -> str:
    both = f"({a} IS NOT NULL AND {b} IS NOT NULL)"
    return (f"covar_pop({a}, {b}) FILTER (WHERE {both}) / nullif({_spread_sql(a, both)} * {_spread_sql(b, both)}, 0)")


def _grid_sql() -> str:
    parts = []
    for x in XS:
        for y in YS:
            both = f"({x} IS NOT NULL AND {y} IS NOT NULL)"
            parts.append(f"""SELECT '{x}' AS x, '{y}' AS y, {_corr(x, y)} AS r,
              CAST(count(*) FILTER (WHERE {both}) AS BIGINT) AS n,
              ({_spread_sql(x, both)} > 0 AND {_spread_sql(y, both)} > 0) AS ok FROM zp""")
    return " UNION ALL ".join(parts)


@register("stats_corr_grid", _zp_sql() + f"""
SELECT x, y, {r_sql('r')} AS r, n FROM ({_grid_sql()}) WHERE n >= 30 AND ok""")
def stats_corr_grid(spark, d):
    """H1: indicators x (log female medals, log male medals), n >= 30, non-constant."""
    return rounded(H.corr_grid(_zp(spark, d), XS, YS, 30), 6)


@register("stats_corr_difference", _zp_sql() + f"""
, g AS (SELECT x, y, r FROM ({_grid_sql()}) WHERE n >= 30 AND ok)
SELECT x, {r_sql("max(CASE WHEN y = 'log_medals_f' THEN r END)")} AS r_a,
  {r_sql("max(CASE WHEN y = 'log_medals_m' THEN r END)")} AS r_b,
  {r_sql("max(CASE WHEN y = 'log_medals_f' THEN r END) - max(CASE WHEN y = 'log_medals_m' THEN r END)")} AS diff
FROM g GROUP BY x""")
def stats_corr_difference(spark, d):
    """H2: r(female) - r(male) per indicator."""
    g = H.corr_grid(_zp(spark, d), XS, YS, 30)
    return rounded(H.corr_difference(g, "x", "y", "log_medals_f", "log_medals_m"), 6)


@register("stats_corr_by_group", with_("nation_year") + f"""
, c AS (SELECT year, {_corr('gdp_pc', 'CAST(medals AS DOUBLE)')} AS r, CAST(count(*) AS BIGINT) AS n
        FROM nation_year WHERE gdp_pc IS NOT NULL AND medals IS NOT NULL GROUP BY year)
SELECT year, {r_sql('r')} AS r, n, {r_sql('r * sqrt((n - 2) / (1 - r * r))')} AS t FROM c WHERE n >= 10""")
def stats_corr_by_group(spark, d):
    """H3: per year, r(gdp per capita, medals) over nations with complete rows; t statistic."""
    ny = tb.nation_year(spark, d)
    return rounded(H.corr_by_group(ny, ["year"], "gdp_pc", "medals", 10, complete=["gdp_pc", "medals"]), 6)


@register("stats_corr_by_group_p", with_("nation_year") + f"""
, c AS (SELECT year, {_corr('gdp_pc', 'CAST(medals AS DOUBLE)')} AS r, CAST(count(*) AS BIGINT) AS n
        FROM nation_year WHERE gdp_pc IS NOT NULL AND medals IS NOT NULL GROUP BY year),
u AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM c WHERE n >= 10)
SELECT year, {r_sql('r')} AS r, n, {r_sql('t')} AS t, {r_sql('2 * ' + t_tail_sql('t', '(n - 2)'))} AS p_value FROM u""")
def stats_corr_by_group_p(spark, d):
    """H3 with the two-sided p-value of r (Student t)."""
    ny = tb.nation_year(spark, d)
    return rounded(H.corr_by_group(ny, ["year"], "gdp_pc", "medals", 10, complete=["gdp_pc", "medals"], with_p=True), 6)


_OLS = with_("nation_year", extra=["""o AS (SELECT year, regr_slope(medals, ln(gdp_pc)) AS slope,
   regr_intercept(medals, ln(gdp_pc)) AS intercept, regr_r2(medals, ln(gdp_pc)) AS r2,
   CAST(regr_count(medals, ln(gdp_pc)) AS BIGINT) AS n, min(ln(gdp_pc)) AS x_min, max(ln(gdp_pc)) AS x_max,
   covar_pop(ln(gdp_pc), medals) / nullif(stddev_pop(ln(gdp_pc)) * stddev_pop(medals), 0) AS r FROM nation_year GROUP BY year)"""])


def _ols(spark, d, with_p=False):
    ny = tb.nation_year(spark, d).withColumn("x", F.log("gdp_pc")).withColumn("medals", F.col("medals").cast("double"))
    return H.ols_line(ny, "x", "medals", ["year"], with_p)


@register("stats_ols", _OLS + f"""
SELECT year, {r_sql('slope')} AS slope, {r_sql('intercept')} AS intercept, {r_sql('r')} AS r, {r_sql('r2')} AS r2, n,
  {r_sql('x_min')} AS x_min, {r_sql('x_max')} AS x_max FROM o""")
def stats_ols(spark, d):
    """H4: per year OLS line of medals on log gdp per capita."""
    return rounded(_ols(spark, d).withColumn("n", F.col("n").cast("long")), 6)


@register("stats_ols_p", _OLS + f"""
SELECT year, {r_sql('slope')} AS slope, {r_sql('r')} AS r, n,
  {r_sql('2 * ' + t_tail_sql('r * sqrt((n - 2) / (1 - r * r))', '(n - 2)'))} AS p_value FROM o""")
def stats_ols_p(spark, d):
    """H4: slope of each year's line with its two-sided p-value."""
    return rounded(_ols(spark, d, True).select("year", "slope", "r", F.col("n").cast("long").alias("n"), "p_value"), 6)


@register("stats_ols_grid", _OLS + f"""
SELECT o.year, CAST(i.i AS INTEGER) AS i, {r_sql('x_min + i.i * (x_max - x_min) / 99')} AS x,
  {r_sql('intercept + slope * (x_min + i.i * (x_max - x_min) / 99)', 4)} AS y_hat
FROM o, (SELECT unnest(range(0, 100)) AS i) i""")
def stats_ols_grid(spark, d):
    """H4: 100-point prediction grid per year."""
    g = H.prediction_grid(_ols(spark, d), ["year"], 100)
    return rounded(rounded(g, 6, ["x"]), 4, ["y_hat"])


@register("stats_top_mean_rate", f"WITH fpc AS ({ORACLE['features_per_capita']}), pb AS ({ORACLE['panel_build']})\n" + f"""
SELECT f.noc, {r_sql('avg(f.medals_per_million)')} AS mean_rate, CAST(count(*) AS BIGINT) AS n
FROM fpc f JOIN pb ON pb.noc = f.noc AND pb.year = f.year AND pb.edition = f.edition
WHERE pb.total > 0 AND f.medals_per_million IS NOT NULL
GROUP BY f.noc ORDER BY avg(f.medals_per_million) DESC, f.noc LIMIT 20""")
def stats_top_mean_rate(spark, d):
    """H5: mean medals per million over winning editions, top 20 entities."""
    f = QUERIES["features_per_capita"](spark, d).filter(F.col("medals_per_million").isNotNull())
    p = QUERIES["panel_build"](spark, d).select("noc", "year", "edition", "total")
    j = f.join(p, ["noc", "year", "edition"])
    return rounded(H.top_mean_rate(j, "noc", "medals_per_million", "total", 20), 6, ["mean_rate"])


@register("stats_edition_totals", with_("tally", "games") + """
SELECT t.year, g.host_city, CAST(sum(t.total) AS BIGINT) AS total
FROM tally t LEFT JOIN games g ON g.year = t.year AND g.edition = t.edition GROUP BY t.year, g.host_city""")
def stats_edition_totals(spark, d):
    """H6: medal totals by (year, host city)."""
    t = tb.tally(spark, d).join(tb.games(spark, d).select("year", "edition", "host_city"), ["year", "edition"], "left")
    return H.group_totals(t, ["year", "host_city"], "total")


@register("stats_top5_series", with_("tally") + """
SELECT noc, year, CAST(sum(total) AS BIGINT) AS total FROM tally
WHERE noc IN (SELECT noc FROM tally GROUP BY noc ORDER BY sum(total) DESC, noc LIMIT 5) GROUP BY noc, year""")
def stats_top5_series(spark, d):
    """H6: yearly totals of the five entities with most medals."""
    return H.top_series(tb.tally(spark, d), "noc", "year", "total", 5)


@register("stats_entity_edition_matrix", with_("tally") + """
SELECT noc, edition, CAST(sum(total) AS BIGINT) AS total FROM tally
WHERE noc IN (SELECT noc FROM tally GROUP BY noc ORDER BY sum(total) DESC, noc LIMIT 20) GROUP BY noc, edition""")
def stats_entity_edition_matrix(spark, d):
    """H6: entity x edition totals for the top 20 entities (long)."""
    return H.top_series(tb.tally(spark, d), "noc", "edition", "total", 20)


def _two(spark, d):
    ny = tb.nation_year(spark, d).select("noc", "year", F.col("gdp").alias("spend"), "medals")
    a = ny.filter("year = 1999").withColumn("edition", F.lit("A")).drop("year")
    b = ny.filter("year = 2000").withColumn("edition", F.lit("B")).drop("year")
    return a, b


_TWO = with_("nation_year", extra=[
    "a AS (SELECT noc, gdp AS spend, medals, 'A' AS edition FROM nation_year WHERE year = 1999)",
    "b AS (SELECT noc, gdp AS spend, medals, 'B' AS edition FROM nation_year WHERE year = 2000)",
    """dj AS (SELECT a.noc, a.spend AS spend_a, a.medals AS medals_a, b.spend AS spend_b, b.medals AS medals_b,
       b.spend - a.spend AS delta_spend, b.medals - a.medals AS delta_medals,
       100 * (b.spend - a.spend) / nullif(a.spend, 0) AS delta_pct FROM a JOIN b ON a.noc = b.noc)"""])


@register("stats_spend_panel", _TWO + f"""
SELECT noc, {r_sql('spend', 2)} AS spend, medals, edition, {r_sql('ln(spend)')} AS log_spend,
  {r_sql('spend / nullif(medals, 0)', 4)} AS spend_per_medal FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def stats_spend_panel(spark, d):
    """H7: two editions stacked, log spend, spend per medal."""
    a, b = _two(spark, d)
    r = H.spend_panel(a, b, "spend", "medals")
    return rounded(rounded(rounded(r, 2, ["spend"]), 6, ["log_spend"]), 4, ["spend_per_medal"])


@register("stats_delta_join", _TWO + f"""
SELECT noc, {r_sql('spend_a', 2)} AS spend_a, medals_a, {r_sql('spend_b', 2)} AS spend_b, medals_b,
  {r_sql('delta_spend', 2)} AS delta_spend, delta_medals, {r_sql('delta_pct')} AS delta_pct,
  CASE WHEN delta_medals > 0 THEN '{dims.DIRECTION_UP}' ELSE '{dims.DIRECTION_DOWN}' END AS direction FROM dj""")
def stats_delta_join(spark, d):
    """H8: change in spend and medals between the two editions."""
    a, b = _two(spark, d)
    r = H.delta_join(a, b, "noc", "spend", "medals", dims.DIRECTION_UP, dims.DIRECTION_DOWN)
    return rounded(rounded(r, 2, ["spend_a", "spend_b", "delta_spend"]), 6, ["delta_pct"])


_BINS_SQL = " ".join(f"WHEN delta_pct > {lo} AND delta_pct <= {hi} THEN '{lab}'".replace("inf", "'Infinity'::DOUBLE")
                     for lo, hi, lab in dims.DELTA_BINS)


@register("stats_binned_delta", _TWO + f"""
SELECT "group", {r_sql('avg(delta_medals)')} AS mean_delta, CAST(count(*) AS BIGINT) AS n
FROM (SELECT *, CASE {_BINS_SQL} END AS "group" FROM dj) WHERE "group" IS NOT NULL GROUP BY "group" """)
def stats_binned_delta(spark, d):
    """H9: mean medal change per spend-change bin."""
    a, b = _two(spark, d)
    r = H.delta_join(a, b, "noc", "spend", "medals", dims.DIRECTION_UP, dims.DIRECTION_DOWN)
    return rounded(H.binned_delta(r, dims.DELTA_BINS), 6)


@register("stats_row_means", with_("nation_year") + f"""
SELECT noc, m1997, m1998, m1999, m2000,
  {r_sql('(coalesce(m1997, 0) + coalesce(m1998, 0) + coalesce(m1999, 0) + coalesce(m2000, 0)) / nullif((m1997 IS NOT NULL)::INT + (m1998 IS NOT NULL)::INT + (m1999 IS NOT NULL)::INT + (m2000 IS NOT NULL)::INT, 0)')} AS row_mean
FROM (SELECT noc, max(CASE WHEN year = 1997 THEN medals END) AS m1997, max(CASE WHEN year = 1998 THEN medals END) AS m1998,
             max(CASE WHEN year = 1999 THEN medals END) AS m1999, max(CASE WHEN year = 2000 THEN medals END) AS m2000
      FROM nation_year GROUP BY noc)""")
def stats_row_means(spark, d):
    """Mean across four yearly columns (skip NULL)."""
    from ..functions.semantics import row_mean
    ny = tb.nation_year(spark, d)
    w = ny.groupBy("noc").pivot("year", [1997, 1998, 1999, 2000]).agg(F.max("medals"))
    w = w.select("noc", *[F.col(str(y)).alias(f"m{y}") for y in (1997, 1998, 1999, 2000)])
    return rounded(w.withColumn("row_mean", row_mean([f"m{y}" for y in (1997, 1998, 1999, 2000)])), 6)


_HOME = f"WITH pb AS ({ORACLE['panel_build']}) , games AS (SELECT * FROM ({ORACLE['panel_host_lookup'].replace('SELECT year, edition, host_country, host_city FROM games', 'SELECT year, edition, host_noc FROM games')})),\n" + \
    """loo AS (SELECT noc, edition, total, (sum(total) OVER (PARTITION BY noc) - total) / nullif(count(total) OVER (PARTITION BY noc) - 1, 0) AS mean_others,
           count(total) OVER (PARTITION BY noc) - 1 AS n_others FROM pb),
he AS (SELECT l.noc, l.edition, l.total, l.mean_others, CAST(l.n_others AS BIGINT) AS n_others,
          round_even(l.total - l.mean_others, 1) AS effect FROM loo l
       WHERE (l.noc, l.edition) IN (SELECT (host_noc, edition) FROM games) AND l.n_others >= 2)
"""


def _home(spark, d):
    p = QUERIES["panel_build"](spark, d).select("noc", "edition", "total")
    hosts = tb.games(spark, d).select(F.col("host_noc").alias("noc"), "edition")
    return H.home_effect(p, hosts, "noc", "edition", "total")


@register("stats_home_effect", _HOME + f"""
SELECT noc, edition, total, {r_sql('mean_others')} AS mean_others, n_others, effect,
  CASE WHEN effect > 0 THEN 'positivo' ELSE 'negativo' END AS type FROM he""")
def stats_home_effect(spark, d):
    """Host medals minus the host's mean in its other editions."""
    return rounded(_home(spark, d), 6, ["mean_others"])


@register("stats_home_effect_t", _HOME + f"""
SELECT {r_sql('avg(effect)')} AS mean, {r_sql('stddev_samp(effect)')} AS sd, CAST(count(effect) AS BIGINT) AS n,
  {r_sql('avg(effect) / (stddev_samp(effect) / sqrt(count(effect)))')} AS t FROM he""")
def stats_home_effect_t(spark, d):
    """One-sample t statistic of the home effect (p in stats_home_effect_p)."""
    return rounded(H.one_sample_t(_home(spark, d), "effect").drop("p_value"), 6)


@register("stats_home_effect_p", _HOME + f""",
st AS (SELECT avg(effect) AS mean, stddev_samp(effect) AS sd, CAST(count(effect) AS BIGINT) AS n,
  avg(effect) / (stddev_samp(effect) / sqrt(count(effect))) AS t FROM he)
SELECT {r_sql('mean')} AS mean, {r_sql('sd')} AS sd, n, {r_sql('t')} AS t,
  {r_sql("CASE WHEN t >= 0 THEN " + t_tail_sql('t', '(n - 1)') + " ELSE 1 - " + t_tail_sql('t', '(n - 1)') + " END")} AS p_value FROM st""")
def stats_home_effect_p(spark, d):
    """One-sided p-value of the home effect (Student t)."""
    return rounded(H.one_sample_t(_home(spark, d), "effect"), 6)


_RANK = with_("raw_events", extra=["""mr AS (SELECT athlete_id, CAST(count(*) AS BIGINT) AS medals,
    arg_min(noc, (year, event, noc)) AS noc FROM raw_events
    WHERE medal <> '' AND contains(lower(edition), 'summer') GROUP BY athlete_id)"""])


def _rank(spark, d):
    e = tb.raw_events(spark, d).filter((F.col("medal") != "") & F.lower("edition").contains("summer")) \
        .withColumn("one", F.lit(1).cast("long"))
    return H.medalist_ranking(e, "athlete_id", "noc", "one", ["year", "event", "noc"])


@register("stats_medalist_ranking", _RANK + "SELECT athlete_id, medals, noc FROM mr")
def stats_medalist_ranking(spark, d):
    """Medals per athlete with the country of the athlete's first row."""
    return _rank(spark, d)


@register("stats_small_countries", _RANK + """
SELECT noc, CAST(sum(medals) AS BIGINT) AS medals FROM mr GROUP BY noc
HAVING sum(medals) > 0 AND sum(medals) < round((SELECT sum(medals) FROM mr) * 0.0001)""")
def stats_small_countries(spark, d):
    """Countries whose medal sum is below round(0.0001 x total)."""
    return H.small_countries(_rank(spark, d), "noc", 0.0001)


@register("stats_medalist_rank", _RANK + "SELECT athlete_id, medals, noc, row_number() OVER (ORDER BY medals DESC, athlete_id) AS rank FROM mr")
def stats_medalist_rank(spark, d):
    """Place of each athlete by medals, ties by athlete."""
    return H.ranked_medalists(_rank(spark, d), "athlete_id", "noc")


@register("stats_medalist_rank_countries", _RANK + """
, tops AS (SELECT noc FROM mr GROUP BY noc ORDER BY sum(medals) DESC, noc LIMIT 5)
SELECT athlete_id, medals, noc, rank FROM (SELECT *, row_number() OVER (ORDER BY medals DESC, athlete_id) AS rank FROM mr)
WHERE noc IN (SELECT noc FROM tops)""")
def stats_medalist_rank_countries(spark, d):
    """The athletes of five countries (here those with most medals) with their place among all."""
    ranking = _rank(spark, d)
    tops = ranking.groupBy("noc").agg(F.sum("medals").alias("m")).orderBy(F.desc("m"), "noc").limit(5).collect()
    return H.ranked_medalists(ranking, "athlete_id", "noc", [r["noc"] for r in tops])


@register("stats_small_countries_share", _RANK + """
SELECT noc, CAST(sum(medals) AS BIGINT) AS medals FROM mr GROUP BY noc
HAVING sum(medals) > 0 AND sum(medals) < round((SELECT sum(medals) FROM mr) * 0.04)""")
def stats_small_countries_share(spark, d):
    """The same cut at a share that countries of these tables fall below."""
    return H.small_countries(_rank(spark, d), "noc", 0.04)


def _headline_sql() -> str:
    return (f"WITH gt AS ({ORACLE['cat_global_trend']}), cs AS ({ORACLE['cat_country_share']}),\n"
            + _zp_sql().replace("WITH ", "", 1) + f""",
g AS (SELECT x, y, r FROM ({_grid_sql()}) WHERE n >= 30 AND ok),
df AS (SELECT x AS indicator, max(CASE WHEN y = 'log_medals_f' THEN r END) - max(CASE WHEN y = 'log_medals_m' THEN r END) AS diff
       FROM g GROUP BY x HAVING diff IS NOT NULL)
SELECT (SELECT arg_min(value, year) FROM gt WHERE measure = 'share_f') AS first_share_f,
  (SELECT arg_max(value, year) FROM gt WHERE measure = 'share_f') AS last_share_f,
  (SELECT min(year) FROM gt WHERE measure = 'share_f') AS first_year,
  (SELECT max(year) FROM gt WHERE measure = 'share_f') AS last_year,
  (SELECT arg_max(noc, (share_f, noc)) FROM cs) AS top_entity,
  (SELECT max(share_f) FROM cs) AS top_share_f,
  (SELECT arg_max(indicator, (abs(diff), indicator)) FROM df) AS largest_diff_indicator,
  (SELECT {r_sql('max(abs(diff))')} FROM df) AS largest_abs_diff""")


@register("cat_headline", _headline_sql())
def cat_headline(spark, d):
    """One row of headline facts: first / last year female medal share,
    nation with the highest share, indicator with the largest |r(F) - r(M)|."""
    from ..operators import category as G
    trend = QUERIES["cat_global_trend"](spark, d)
    shares = QUERIES["cat_country_share"](spark, d)
    g = H.corr_grid(_zp(spark, d), XS, YS, 30)
    diffs = H.corr_difference(g, "x", "y", "log_medals_f", "log_medals_m").withColumnRenamed("x", "indicator")
    return rounded(G.headline_facts(trend, shares, diffs, "year", "noc"), 6)
