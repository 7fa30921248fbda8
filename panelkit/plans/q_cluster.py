"""Entity clustering queries (D1-D15) on customer profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..operators import cluster as D
from ..session import cut_lineage
from . import tables as tb
from .catalog import ORACLE, QUERIES, r_sql, register, rounded
from .sqlbase import band_sql, with_

V = tb.PROFILE_VARS
PX = tb.PROXY_VARS
FROM_YEAR = 1995  # the first year of the data


def _latest(spark, d):
    return D.latest_profile(tb.profiles(spark, d), "noc", "year", V, 3, keep=["country"])


def _banded(spark, d):
    return _latest(spark, d).withColumn("cluster_wb", D.income_band("gdp_pc"))


_NN = " + ".join(f"({c} IS NOT NULL)::INT" for c in V)
_LATEST = f"""latest AS (SELECT noc, {", ".join(f"arg_max({c}, year) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in V + ['country'])}
   FROM profiles WHERE {_NN} >= 3 GROUP BY noc)"""
_BANDED = f"banded AS (SELECT *, {band_sql('gdp_pc')} AS cluster_wb FROM latest)"


def W(*extra: str) -> str:
    return with_("profiles", extra=[_LATEST, _BANDED, *extra])


@register("cluster_latest_profile", W() + f"SELECT noc, {', '.join(r_sql(c) + ' AS ' + c for c in V)}, country FROM latest")
def cluster_latest_profile(spark, d):
    """Rows with >= 3 of 5 indicators; last non-null value per column per entity."""
    return rounded(_latest(spark, d), 6)


@register("cluster_income_band", W() + f"SELECT noc, {r_sql('gdp_pc')} AS gdp_pc, cluster_wb FROM banded")
def cluster_income_band(spark, d):
    """Income band of the latest gdp per capita."""
    return rounded(_banded(spark, d).select("noc", "gdp_pc", "cluster_wb"), 6)


def _assign_sql() -> str:
    med = ", ".join(f"median({c}) AS {c}" for c in PX)
    imp = ", ".join(f"coalesce({c}, (SELECT {c} FROM med)) AS {c}" for c in PX)
    mom = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in PX)
    cz = ", ".join(f"(coalesce(c.{c}, (SELECT {c} FROM med)) - m.m_{c}) / nullif(m.s_{c}, 0) AS {c}" for c in PX)
    rz = ", ".join(f"(coalesce(b.{c}, (SELECT {c} FROM med)) - m.m_{c}) / nullif(m.s_{c}, 0) AS {c}" for c in PX)
    dist = " + ".join(f"power(coalesce(r.{c}, 0) - coalesce(c.{c}, 0), 2)" for c in PX)
    return W(f"med AS (SELECT {med} FROM banded WHERE cluster_wb IS NOT NULL)",
             f"imp AS (SELECT {imp} FROM banded WHERE cluster_wb IS NOT NULL)",
             f"mom AS (SELECT {mom} FROM imp)",
             f"cent AS (SELECT cluster_wb, {med} FROM banded WHERE cluster_wb IS NOT NULL GROUP BY cluster_wb)",
             f"cz AS (SELECT c.cluster_wb, {cz} FROM cent c, mom m)",
             f"rz AS (SELECT b.noc, {rz} FROM banded b, mom m WHERE b.cluster_wb IS NULL)",
             f"""near AS (SELECT r.noc, arg_min(c.cluster_wb, (sqrt({dist}), c.cluster_wb)) AS nb
                 FROM rz r, cz c GROUP BY r.noc)""") + """
SELECT b.noc, b.cluster_wb, coalesce(b.cluster_wb, n.nb) AS band_filled,
  CASE WHEN b.cluster_wb IS NOT NULL THEN 'band' ELSE 'nearest' END AS assigned_by
FROM banded b LEFT JOIN near n ON n.noc = b.noc"""


@register("cluster_assign_missing", _assign_sql())
def cluster_assign_missing(spark, d):
    """D3: entities without gdp get the band of the nearest band centroid on 4 proxies."""
    r = D.assign_missing_band(_banded(spark, d), "cluster_wb", PX)
    return r.select("noc", "cluster_wb", "band_filled", "assigned_by")


def _kmeans(spark, d, n_init=10):
    b = cut_lineage(_banded(spark, d))
    scored, model, params = D.fit_profile_clusters(b, V, 4, F.col("cluster_wb").isNotNull(), n_init, 42)
    return D.rank_labels(scored, "cluster", "gdp_pc", dims.CLUSTER_ORDER), model, params


@register("cluster_kmeans")
def cluster_kmeans(spark, d):
    """D4 + D6: K-means (k=4, 10 restarts) on scaled latest profiles of banded
    entities; clusters named by mean gdp per capita (richest first)."""
    r, _, _ = _kmeans(spark, d)
    return r.select("noc", "cluster", "cluster_code", "cluster_label")


@register("cluster_k_sweep")
def cluster_k_sweep(spark, d):
    """Inertia and (squared-Euclidean) silhouette for k = 2..8."""
    b = cut_lineage(_banded(spark, d))  # read by the scaler and by the fits
    params = D.fit_scaler(b, V)
    z = b.withColumns(D.scaled_columns(params))
    return D.k_sweep(z, ["z_" + c for c in V], range(2, 9), n_init=10)


def _static(spark, d):
    return D.static_profile(tb.profiles(spark, d), "noc", "year", V, FROM_YEAR, "gdp_pc", name="country") \
        .withColumn("static_band", D.income_band("gdp_pc"))


_STATIC = f"""static AS (SELECT noc, {band_sql('avg(gdp_pc)')} AS static_band, avg(gdp_pc) AS gdp_pc
    FROM profiles WHERE year >= {FROM_YEAR} GROUP BY noc HAVING avg(gdp_pc) IS NOT NULL)"""
_LABELS_SQL = ", ".join(f"'{x}'" for x in dims.INCOME_BAND_ORDER)


@register("cluster_label_contingency", W(_STATIC) + f"""
, ab AS (SELECT b.cluster_wb AS a, s.static_band AS b FROM banded b JOIN static s ON s.noc = b.noc WHERE b.cluster_wb IS NOT NULL)
, g AS (SELECT x.a, y.b FROM (SELECT unnest([{_LABELS_SQL}]) AS a) x, (SELECT unnest([{_LABELS_SQL}]) AS b) y)
SELECT g.a, g.b, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM g LEFT JOIN (SELECT a, b, count(*) AS n FROM ab GROUP BY ALL) c ON c.a = g.a AND c.b = g.b""")
def cluster_label_contingency(spark, d):
    """Zero-filled contingency of latest band vs static (mean) band."""
    ab = _banded(spark, d).filter(F.col("cluster_wb").isNotNull()).select("noc", F.col("cluster_wb").alias("a")) \
        .join(_static(spark, d).select("noc", F.col("static_band").alias("b")), "noc")
    return D.contingency(ab, "a", "b", dims.INCOME_BAND_ORDER)


@register("cluster_agreement", W(_STATIC) + f"""
, ab AS (SELECT b.cluster_wb AS a, s.static_band AS b FROM banded b JOIN static s ON s.noc = b.noc WHERE b.cluster_wb IS NOT NULL)
, c AS (SELECT a, b, count(*) AS n FROM ab GROUP BY ALL)
, c2 AS (SELECT *, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS rb FROM c)
, s AS (SELECT sum(n * (n - 1) / 2.0) AS idx, sum(n * (ra - 1) / 2.0) AS sa, sum(n * (rb - 1) / 2.0) AS sb,
               sum(n) AS tot, sum(CASE WHEN a = b THEN n ELSE 0 END) AS diag FROM c2)
SELECT {r_sql('(idx - sa * sb / (tot * (tot - 1) / 2.0)) / nullif((sa + sb) / 2 - sa * sb / (tot * (tot - 1) / 2.0), 0)')} AS ari,
  {r_sql('100.0 * diag / tot')} AS pct_diagonal, CAST(tot - diag AS BIGINT) AS n_disagree, CAST(tot AS BIGINT) AS n FROM s""")
def cluster_agreement(spark, d):
    """Adjusted Rand index and diagonal share of latest vs static bands."""
    ab = _banded(spark, d).filter(F.col("cluster_wb").isNotNull()).select("noc", F.col("cluster_wb").alias("a")) \
        .join(_static(spark, d).select("noc", F.col("static_band").alias("b")), "noc")
    return rounded(D.agreement(ab, "a", "b"), 6)


def _prop_inputs(spark, d):
    c = tb.load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    target = c.select(F.col("c_custkey").alias("noc"), F.col("c_name").alias("country"))
    lab = _banded(spark, d).select("noc", "cluster_wb")
    src = c.join(lab, c.c_custkey == lab.noc).select(
        F.when(F.col("c_acctbal") >= 3000, F.col("c_custkey")).alias("noc"),
        F.when(F.col("c_acctbal") < 1000, F.concat(F.col("c_name"), F.lit(", Inc"))).otherwise(F.col("c_name"))
        .alias("country"), "cluster_wb", F.col("c_custkey").alias("src_order"))
    return target, src


_PROP = with_("profiles", extra=[_LATEST, _BANDED, """src AS (
    SELECT CASE WHEN c.c_acctbal >= 3000 THEN c.c_custkey END AS noc,
           CASE WHEN c.c_acctbal < 1000 THEN c.c_name || ', Inc' ELSE c.c_name END AS country,
           b.cluster_wb, c.c_custkey AS src_order FROM customer c JOIN banded b ON b.noc = c.c_custkey)""",
    "bk AS (SELECT noc, arg_min(cluster_wb, src_order) AS l FROM src WHERE noc IS NOT NULL GROUP BY noc)",
    "bn AS (SELECT country, arg_min(cluster_wb, src_order) AS l FROM src WHERE country IS NOT NULL GROUP BY country)",
    """bp AS (SELECT trim(split_part(country, ',', 1)) AS p, arg_min(cluster_wb, src_order) AS l
            FROM src WHERE country IS NOT NULL GROUP BY 1)""",
    """prop AS (SELECT c.c_custkey AS noc, c.c_name AS country, coalesce(bk.l, bn.l, bp.l) AS cluster_wb,
        CASE WHEN bk.l IS NOT NULL THEN 'key' WHEN bn.l IS NOT NULL THEN 'name' WHEN bp.l IS NOT NULL THEN 'prefix' END AS matched_by
      FROM customer c LEFT JOIN bk ON bk.noc = c.c_custkey LEFT JOIN bn ON bn.country = c.c_name
      LEFT JOIN bp ON bp.p = trim(split_part(c.c_name, ',', 1)))"""])


@register("cluster_propagate", _PROP + "SELECT noc, country, cluster_wb, matched_by FROM prop")
def cluster_propagate(spark, d):
    """Labels by key, else exact name, else name prefix before the first comma."""
    t, s = _prop_inputs(spark, d)
    return D.propagate_labels(t, s, key="noc", name="country", label="cluster_wb", source_order=["src_order"])


@register("cluster_propagate_coverage", _PROP + f"""
SELECT step, matched, {r_sql('100.0 * matched / n')} AS pct FROM (
  SELECT 'key' AS step, CAST(count(*) FILTER (WHERE matched_by IN ('key')) AS BIGINT) AS matched, count(*) AS n FROM prop UNION ALL
  SELECT 'name', CAST(count(*) FILTER (WHERE matched_by IN ('key', 'name')) AS BIGINT), count(*) FROM prop UNION ALL
  SELECT 'prefix', CAST(count(*) FILTER (WHERE matched_by IN ('key', 'name', 'prefix')) AS BIGINT), count(*) FROM prop)""")
def cluster_propagate_coverage(spark, d):
    """Cumulative coverage after each matching step."""
    t, s = _prop_inputs(spark, d)
    p = D.propagate_labels(t, s, key="noc", name="country", label="cluster_wb", source_order=["src_order"])
    return rounded(D.coverage_steps(p), 6)


@register("cluster_score_dynamic")
def cluster_score_dynamic(spark, d):
    """Every (entity, year) with gdp scored by the fitted K-means
    (same imputation / scaling parameters), named clusters."""
    labelled, model, params = _kmeans(spark, d)
    names = labelled.select("cluster", "cluster_label").distinct()
    p = tb.profiles(spark, d).filter((F.col("year") >= FROM_YEAR) & F.col("gdp_pc").isNotNull())
    z = p.withColumns(D.scaled_columns(params))
    scored = D.predict(model, z, ["z_" + c for c in V]).join(F.broadcast(names), "cluster", "left")  # k rows
    return scored.select("noc", "year", "cluster", "cluster_label")  # (noc, year) is unique in profiles


def _alias_inputs(spark, d):
    r = tb.roster(spark, d).select("noc", "year", "label")
    c = tb.load(spark, d, "customer").filter("c_acctbal < 0")
    aliases = c.select((F.col("c_custkey") + 1_000_000).alias("alias"), F.col("c_custkey").alias("successor"))
    o = tb.load(spark, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    competed = o.join(c, o.o_custkey == c.c_custkey).select(
        (F.col("o_custkey") + 1_000_000).alias("alias"), F.year("o_orderdate").alias("year")).distinct()
    return r, aliases, competed


@register("cluster_alias_successor", with_("roster") + """
, al AS (SELECT c_custkey + 1000000 AS alias, c_custkey AS successor FROM customer WHERE c_acctbal < 0)
, comp AS (SELECT DISTINCT o.o_custkey + 1000000 AS alias, CAST(year(o.o_orderdate) AS INTEGER) AS year
           FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal < 0 AND o.o_orderpriority = '1-URGENT')
SELECT DISTINCT * FROM (
  SELECT noc, year, label FROM roster
  UNION ALL
  SELECT al.alias AS noc, r.year, r.label FROM roster r JOIN al ON al.successor = r.noc
  WHERE (al.alias, r.year) IN (SELECT (alias, year) FROM comp))""")
def cluster_alias_successor(spark, d):
    """Successor labels copied to the alias code for the years the alias competed."""
    r, aliases, competed = _alias_inputs(spark, d)
    return D.alias_successor(r, aliases, "noc", time="year", competed=competed)


@register("cluster_static")
def cluster_static(spark, d):
    """Mean profile of all years per entity -> K-means (k=4) -> named clusters."""
    s = cut_lineage(_static(spark, d))
    scored, _, _ = D.fit_profile_clusters(s, V, 4, None, 10, 42)
    return D.rank_labels(scored, "cluster", "gdp_pc", dims.CLUSTER_ORDER).select(
        "noc", "country", "cluster_code", "cluster_label")


@register("cluster_compare_static_dynamic", W(_STATIC) + f"""
, dyn AS (SELECT noc, arg_max(label, year) AS dyn_band FROM roster GROUP BY noc)
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE d.dyn_band = s.static_band) AS BIGINT) AS n_equal,
  {r_sql('100.0 * count(*) FILTER (WHERE d.dyn_band = s.static_band) / count(*)')} AS pct_equal
FROM dyn d JOIN static s ON s.noc = d.noc""")
def cluster_compare_static_dynamic(spark, d):
    """Latest-year band vs band of the mean of all years."""
    r = tb.roster(spark, d)
    dyn = r.groupBy("noc").agg(F.max_by("label", "year").alias("dyn_band"))
    return rounded(D.compare_labels(dyn, _static(spark, d), "noc", "dyn_band", "static_band"), 6)


@register("cluster_coherence", W() + f"""
SELECT cluster_wb, {', '.join(r_sql(f'median({c})') + ' AS ' + c for c in V)}, CAST(count(*) AS BIGINT) AS n
FROM banded GROUP BY cluster_wb""")
def cluster_coherence(spark, d):
    """Median profile per band."""
    return rounded(D.coherence(_banded(spark, d), "cluster_wb", V), 6)


def _outcome(spark, d):
    p = QUERIES["panel_build"](spark, d)
    f = QUERIES["features_per_capita"](spark, d).select("noc", "year", "edition", "medals_per_million")
    j = p.join(f, ["noc", "year", "edition"])
    return D.outcome_table(j, "noc", "edition", "total", "spend", "n_lines", "medals_per_million")


@register("cluster_outcome_table", f"WITH pb AS ({ORACLE['panel_build']}), fpc AS ({ORACLE['features_per_capita']})\n" + f"""
SELECT * FROM (SELECT p.noc, {r_sql('avg(p.total)')} AS avg_medals, CAST(sum(p.total) AS BIGINT) AS total_medals,
  CAST(count(DISTINCT p.edition) AS BIGINT) AS n_editions, {r_sql('avg(p.spend)')} AS avg_gdp_pc,
  {r_sql('avg(p.n_lines)')} AS avg_pop, {r_sql('avg(f.medals_per_million)')} AS medals_per_m,
  {r_sql('stddev_samp(p.total)')} AS consistency
FROM pb p JOIN fpc f ON f.noc = p.noc AND f.year = p.year AND f.edition = p.edition
WHERE p.total > 0 GROUP BY p.noc)
WHERE avg_gdp_pc IS NOT NULL AND avg_pop IS NOT NULL AND medals_per_m IS NOT NULL AND consistency IS NOT NULL""")
def cluster_outcome_table(spark, d):
    """Per-entity outcome profile over winning editions (rows with NULL dropped)."""
    return rounded(_outcome(spark, d), 6)


@register("cluster_outcome_clusters")
def cluster_outcome_clusters(spark, d):
    """K-means (k=4, 20 restarts) on the z-scored outcome profile, named by rule."""
    t = cut_lineage(_outcome(spark, d))  # read by the scaler, the fits and the names
    cols = ["avg_medals", "medals_per_m", "consistency", "avg_gdp_pc", "n_editions"]
    scored, _, _ = D.fit_profile_clusters(t, cols, 4, None, 20, 42)
    return D.outcome_names(scored, "cluster").select("noc", "cluster", "cluster_name")


@register("cluster_spot_check", with_("profiles", "games", extra=[_LATEST, _BANDED]) + f"""
SELECT noc, country, {', '.join(r_sql(c) + ' AS ' + c for c in V)},
  array_to_string(list_filter([{', '.join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in V)}], lambda x: x IS NOT NULL), ', ') AS missing,
  CAST(({' + '.join(f'({c} IS NULL)::INT' for c in V)}) AS INTEGER) AS n_missing,
  ({' + '.join(f'({c} IS NULL)::INT' for c in V)}) = {len(V)} AS all_missing
FROM latest WHERE regexp_matches(country, '(?i)#00000001[0-4]') OR noc IN (SELECT host_noc FROM games)""")
def cluster_spot_check(spark, d):
    """Spot check of entities named by a pattern or listed as codes (here
    the edition hosts): which indicators are missing."""
    hosts = tb.games(spark, d).select(F.col("host_noc").alias("noc"))
    r = D.spot_check(_latest(spark, d), "country", "noc", r"#00000001[0-4]", hosts, V)
    return rounded(r, 6)
