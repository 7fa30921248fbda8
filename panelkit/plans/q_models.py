"""Predictive-model queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from .. import dims
from ..operators import cluster as D
from ..operators import features as C
from ..operators import models as M
from ..session import cut_lineage
from . import tables as tb
from .catalog import QUERIES, r_sql, register, rounded
from .sqlbase import with_

V = tb.PROFILE_VARS
ZF = ["z_" + c for c in V] + ["is_host"]
#: Total, size and ratio as logs, two further indicators, host flag and the previous total.
REG_FEATURES = ["log_spend", "log_lines", "log_unit", "qty", "avg_disc", "is_host", "prev_total"]
LAST_YEAR = 2000


def _complete(spark, d):
    """Entity-years with all five indicators and the host flag, stored: the
    scaler, the profiles and the training rows read it."""
    p = tb.profiles(spark, d)
    for c in V:
        p = p.filter(F.col(c).isNotNull())
    hosts = tb.games(spark, d).select(F.col("host_noc").alias("noc"), "year").distinct().withColumn("is_host", F.lit(1))
    b = p.join(hosts, ["noc", "year"], "left").withColumn("is_host", F.coalesce("is_host", F.lit(0)))
    return cut_lineage(b.drop("country"))


def _train(spark, d, complete=None, params=None):
    """A row for each complete entity-year (z-scored indicators, raw host flag) and sport."""
    b = _complete(spark, d) if complete is None else complete
    base = b.withColumns(D.scaled_columns(params or D.fit_scaler(b, V))).select("noc", "year", *ZF)
    return M.training_sets(base, tb.type_events(spark, d), ["noc", "year"], "sport", "won", 50)


@register("models_training_set", with_("profiles", extra=["""ev AS (SELECT o.o_custkey AS noc, CAST(year(o.o_orderdate) AS INTEGER) AS year,
      p.p_type AS sport, l.l_returnflag IN ('A', 'R') AS won
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey)""",
    f"""base AS (SELECT noc, year FROM profiles WHERE {' AND '.join(f'{c} IS NOT NULL' for c in V)})""",
    "cats AS (SELECT sport FROM ev GROUP BY sport HAVING count(*) >= 50)",
    "fl AS (SELECT DISTINCT noc, year, sport FROM ev WHERE won)"]) + """
SELECT b.noc, b.year, c.sport, CASE WHEN fl.noc IS NOT NULL THEN 1 ELSE 0 END AS y
FROM base b CROSS JOIN cats c LEFT JOIN fl ON fl.noc = b.noc AND fl.year = b.year AND fl.sport = c.sport""")
def models_training_set(spark, d):
    """M1: entity-years with complete indicators x sports with >= 50 rows; y = won."""
    return _train(spark, d).select("noc", "year", "sport", "y")


def _folds(spark, d):
    return M.with_folds(_train(spark, d), ["noc", "year"], "sport", "y", 5)


def _logit(rows):
    return M.logit_per_category(rows, ["noc", "year"], "sport", ZF, "y", 5, 1.0)


@register("models_logit")
def models_logit(spark, d):
    """M2: balanced L2 logistic model per sport: 5-fold AUC, coefficients, winners."""
    return _logit(_folds(spark, d))


def _trees(rows):
    return M.trees_per_category(rows, ["noc", "year"], "sport", ZF, "y", 5, 42)


@register("models_trees")
def models_trees(spark, d):
    """M3: random forest and gradient boosting per sport: 5-fold AUC and importances."""
    return _trees(_folds(spark, d))


@register("models_tree_deltas")
def models_tree_deltas(spark, d):
    """M3: AUC gain of the tree models over the logistic model (> 0.01 counted)."""
    rows = _folds(spark, d)
    return M.model_deltas(_logit(rows), _trees(rows), "sport", 0.01)


@register("models_profile_probabilities")
def models_profile_probabilities(spark, d):
    """M4: win probability per sport for the median profile of each income band
    (scaled like the training rows, host = 0) and the rich - poor gap."""
    b = _complete(spark, d)
    params = D.fit_scaler(b, V)
    med = D.coherence(b.withColumn("band", D.income_band("gdp_pc")), "band", V)
    prof = med.withColumns(D.scaled_columns(params)).withColumn("is_host", F.lit(0.0))
    rows = _train(spark, d, b, params).withColumn("model", F.lit(-1))
    coef = M.grouped_logit(rows, ["sport", "model"], ZF, "y", stored=True)
    _, gap = M.profile_probabilities(coef, prof, "sport", "band", ZF, dims.CLUSTER_ORDER[0], dims.CLUSTER_ORDER[-1])
    return gap


@register("models_importance_compare")
def models_importance_compare(spark, d):
    """M5: normalised |logit coefficient| vs gradient-boosting importance per
    feature, for the sport with the largest tree gain and the one with the smallest |gain|."""
    rows = _folds(spark, d)
    lg, tr = cut_lineage(_logit(rows)), cut_lineage(_trees(rows))
    deltas = M.model_deltas(lg, tr, "sport").filter(F.col("model") == "gbt")
    picks = deltas.agg(F.max_by("sport", "delta").alias("max_sport"),
                       F.min_by("sport", F.abs("delta")).alias("min_sport")).first()
    chosen = [picks["max_sport"], picks["min_sport"]]
    coefs = lg.filter(F.col("sport").isin(chosen)).select(
        "sport", *[F.abs(F.col(f"b_{f}")).alias(f) for f in ZF]).unpivot(["sport"], ZF, "feature", "abs_coef")
    coefs = coefs.withColumn("coef_share", F.col("abs_coef") / F.sum("abs_coef").over(
        Window.partitionBy("sport")))
    imps = tr.filter((F.col("model") == "gbt") & F.col("sport").isin(chosen)).select(
        "sport", *[F.col(f"imp_{f}").alias(f) for f in ZF]).unpivot(["sport"], ZF, "feature", "gbt_importance")
    return coefs.join(imps, ["sport", "feature"])


def _reg_rows(spark, d):
    """Entity-editions with the seven features, stored."""
    p = QUERIES["panel_build"](spark, d).select("noc", "year", "edition", "edition_id", "total", "spend", "n_lines", "qty", "avg_disc")
    p = C.lag_features(p, "noc", ["year", "edition"], "total", lags=(1,))
    hosts = tb.games(spark, d).select("year", "edition", "host_noc")
    p = p.join(hosts, ["year", "edition"], "left").withColumn("is_host", F.coalesce(F.col("noc") == F.col("host_noc"), F.lit(False)).cast("int"))
    return cut_lineage(_logs(p, "spend", "n_lines").drop("host_noc"))


def _logs(p, spend, lines):
    return p.withColumns({"log_spend": F.log(spend), "log_lines": F.log(lines), "log_unit": F.log(F.try_divide(F.col(spend), F.col(lines)))})


def _reg_data(rows):
    return rows.dropna(subset=["total", *REG_FEATURES])


@register("models_bakeoff")
def models_bakeoff(spark, d):
    """M6: 5-fold R2 / MAE of OLS, ridge, lasso (full path), random forest,
    gradient boosting (complete rows up to 2000, seven features)."""
    data = _reg_data(_reg_rows(spark, d)).filter(F.col("year") <= LAST_YEAR)
    return M.regression_bakeoff(data, ["noc", "edition"], REG_FEATURES, "total", 5)


def _rf(rows):
    return M.rf_importance(_reg_data(rows).filter(F.col("year") <= LAST_YEAR), REG_FEATURES, "total", 300, 8, 5)


@register("models_rf_importance")
def models_rf_importance(spark, d):
    """M7: random-forest (300 x depth 8 x leaf 5) feature importances."""
    return _rf(_reg_rows(spark, d))[1]


@register("models_holdout")
def models_holdout(spark, d):
    """M8: forest trained on years <= 2000, evaluated on 2001 (floored, 1 dp): R2, MAE."""
    rows = _reg_rows(spark, d)
    test = _reg_data(rows).filter(F.col("year") == LAST_YEAR + 1).withColumn("total", F.col("total").cast("double"))
    return M.r2_mae(M.holdout_eval(_rf(rows)[0], test, "total"), "total", "pred")


@register("models_polarised")
def models_polarised(spark, d):
    """M4: the five sports with the widest and with the least rich - poor gap of the win probability."""
    gap = models_profile_probabilities(spark, d).filter(F.col("gap").isNotNull())
    wide = gap.orderBy(F.desc("gap"), "sport").limit(5).withColumn("list", F.lit("most"))
    return wide.unionByName(gap.orderBy(F.abs("gap"), "sport").limit(5).withColumn("list", F.lit("least")))


@register("models_auc_lists")
def models_auc_lists(spark, d):
    """M5: the five sports that the logistic model predicts best, and the five that it predicts worst."""
    lg = cut_lineage(_logit(_folds(spark, d)).select("sport", "auc_mean", "auc_std", "n_winners").filter(F.col("auc_mean").isNotNull()))
    top = lg.orderBy(F.desc("auc_mean"), "sport").limit(5).withColumn("list", F.lit("top"))
    return top.unionByName(lg.orderBy("auc_mean", "sport").limit(5).withColumn("list", F.lit("bottom")))


@register("models_scenario", with_("nation_year", extra=["""l3 AS (SELECT * FROM nation_year QUALIFY row_number() OVER (PARTITION BY noc ORDER BY year DESC) <= 3)""",
    """pc AS (SELECT *, (gdp - lag(gdp) OVER w) / nullif(lag(gdp) OVER w, 0) AS pct
      FROM l3 WHERE gdp IS NOT NULL WINDOW w AS (PARTITION BY noc ORDER BY year))""",
    "g AS (SELECT noc, avg(pct) AS g FROM pc GROUP BY noc)",
    "la AS (SELECT * FROM nation_year QUALIFY row_number() OVER (PARTITION BY noc ORDER BY year DESC) = 1)"]) + f"""
SELECT p.noc, p.year, {r_sql('p.gdp', 2)} AS gdp, p.population, p.medals,
  {r_sql(f'coalesce(least(greatest(g.g, {dims.GROWTH_CLIP[0]}), {dims.GROWTH_CLIP[1]}), {dims.GROWTH_DEFAULT})')} AS growth,
  {r_sql(f'p.gdp * power(1 + coalesce(least(greatest(g.g, {dims.GROWTH_CLIP[0]}), {dims.GROWTH_CLIP[1]}), {dims.GROWTH_DEFAULT}), 2)', 2)} AS gdp_next,
  {r_sql(f'p.population * {dims.POP_GROWTH}')} AS pop_next, p.medals AS prev_medals
FROM la p LEFT JOIN g ON g.noc = p.noc""")
def models_scenario(spark, d):
    """M9: next-edition scenario per nation: clipped mean growth between the
    last three GDP values, GDP x (1+g)^2, population x 1.015, previous medals."""
    ny = tb.nation_year(spark, d).select("noc", "year", "gdp", "population", "medals")
    out = M.project_scenario(ny, "noc", "year", "gdp", "population", "medals")
    out = out.select("noc", "year", "gdp", "population", "medals", "growth", "gdp_next", "pop_next", "prev_medals")
    return rounded(rounded(out, 2, ["gdp", "gdp_next"]), 6, ["growth", "pop_next"])


def _next_rows(rows):
    """M9's rows for the edition after the last one, with the model's features."""
    out = M.project_scenario(rows, "noc", "edition_id", "spend", "n_lines", "total", host="is_host", life="qty", urban="avg_disc")
    out = out.select("noc", F.col("gdp_next").alias("spend"), F.col("pop_next").alias("n_lines"), F.col("life_next").alias("qty"),
                     F.col("urban_next").alias("avg_disc"), F.lit(0).alias("is_host"), F.col("prev_medals").alias("prev_total"), "growth")
    return _logs(out, "spend", "n_lines").dropna(subset=REG_FEATURES)


def _forecast(spark, d):
    rows = _reg_rows(spark, d)
    return _rf(rows)[0], _next_rows(rows)


@register("models_forecast_interval")
def models_forecast_interval(spark, d):
    """Forecast of M9's rows with the 10th / 90th percentile of the trees."""
    return M.forecast_interval(*_forecast(spark, d)).select("noc", "growth", "prev_total", "pred", "p_lo", "p_hi")


@register("models_forecast_top")
def models_forecast_top(spark, d):
    """The 15 entities with the highest forecast (ties by entity)."""
    f = M.forecast_interval(*_forecast(spark, d)).select("noc", "pred", "p_lo", "p_hi")
    return f.orderBy(F.desc("pred"), "noc").limit(15)


@register("models_forecast_host_effect")
def models_forecast_host_effect(spark, d):
    """Forecast of each entity as host and as guest, and the difference."""
    model, rows = _forecast(spark, d)
    return M.host_effect(model, rows, "is_host").select("noc", "as_host", "as_guest", "host_effect")
