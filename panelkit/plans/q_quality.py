"""Ingest and quality queries (A2-A17) bound to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..operators import ingest as I
from ..operators import panel as P
from ..operators import quality as Q
from . import tables as tb
from .catalog import QUERIES, ORACLE, r_sql, register, rounded
from .sqlbase import with_


def _panel(spark, d):
    return QUERIES["panel_build"](spark, d)


def _panel_sql_cte() -> str:
    """The panel_build oracle as a CTE named pb (prefix with WITH ... pb AS (...))."""
    return ORACLE["panel_build"]


_PROFILE_COLS = ["country", "host_country", "host_city"] + tb.INDICATORS


def _profile_sql(variant: int) -> str:
    parts = []
    for c in _PROFILE_COLS:
        pct = f"100.0 * avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)"
        parts.append(f"SELECT '{c}' AS \"column\", {pct} AS p FROM pb")
    body = " UNION ALL ".join(parts)
    if variant == 1:
        keep, maybe, drop = dims.NULL_BANDS_V1
        return (f"SELECT \"column\", round_even(p, 2) AS pct_null, CASE WHEN round_even(p, 2) < 30 THEN '{keep}' "
                f"WHEN round_even(p, 2) > 30 AND round_even(p, 2) < 50 THEN '{maybe}' ELSE '{drop}' END AS band "
                f"FROM ({body})")
    ex, ca, ok = dims.NULL_BANDS_V2
    return (f"SELECT \"column\", {r_sql('p')} AS pct_null, CASE WHEN p > 30 THEN '{ex}' WHEN p > 15 THEN '{ca}' "
            f"ELSE '{ok}' END AS band FROM ({body})")


def _wrap_panel(sql_tail: str) -> str:
    return f"WITH pb AS ({_panel_sql_cte()})\n{sql_tail}"


def _reg_profiles():
    @register("quality_null_profile_v1", _wrap_panel(_profile_sql(1)))
    def quality_null_profile_v1(spark, d):
        """A4 variant 1 (Keep / Maybe / Drop, 2 dp) over the enriched panel."""
        return I.null_profile(_panel(spark, d), _PROFILE_COLS, variant=1)

    @register("quality_null_profile_v2", _wrap_panel(_profile_sql(2)))
    def quality_null_profile_v2(spark, d):
        """A4 variant 2 (excluded / caution / reliable) over the enriched panel."""
        return rounded(I.null_profile(_panel(spark, d), _PROFILE_COLS, variant=2), 6, ["pct_null"])


_reg_profiles()


@register("quality_null_profile_by_year", with_("series") + """
SELECT year, "column", round(p, 1) AS pct_null, CAST(NULL AS VARCHAR) AS band FROM (
  SELECT year, 'avg_disc' AS "column", 100.0 * avg(CASE WHEN avg_disc IS NULL THEN 1.0 ELSE 0.0 END) AS p
  FROM series GROUP BY year UNION ALL
  SELECT year, 'urgent_value', 100.0 * avg(CASE WHEN urgent_value IS NULL THEN 1.0 ELSE 0.0 END)
  FROM series GROUP BY year) WHERE p > 0""")
def quality_null_profile_by_year(spark, d):
    """A4 variant 3 (only columns with nulls, 1 dp) per series year."""
    return I.null_profile(tb.series(spark, d), ["avg_disc", "urgent_value"], variant=3, by=["year"])


@register("quality_drop_by_band", with_("series", extra=[
    """prof AS (SELECT year, 'urgent_value' AS c,
                round_even(100.0 * avg(CASE WHEN urgent_value IS NULL THEN 1.0 ELSE 0.0 END), 2) AS p FROM series GROUP BY year
              UNION ALL SELECT year, 'avg_disc', round_even(100.0 * avg(CASE WHEN avg_disc IS NULL THEN 1.0 ELSE 0.0 END), 2)
              FROM series GROUP BY year)"""]) + """
SELECT c AS dropped_column FROM prof GROUP BY c
HAVING bool_and(NOT (p < 30) AND NOT (p > 30 AND p < 50))""")
def quality_drop_by_band(spark, d):
    """A5: columns banded Drop in every year group of the series."""
    s = tb.series(spark, d)
    prof = I.null_profile(s, ["urgent_value", "avg_disc"], variant=1, by=["year"])
    _, dropped = I.drop_by_band(s, prof)
    return spark.createDataFrame([(c,) for c in dropped], "dropped_column string")


_DESC_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("quality_describe", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS count, {r_sql(f'avg({c})')} AS mean,
        {r_sql(f'stddev_samp({c})')} AS std, {r_sql(f'min({c})')} AS min,
        {r_sql(f'quantile_cont({c}, 0.25)')} AS p25, {r_sql(f'quantile_cont({c}, 0.5)')} AS p50,
        {r_sql(f'quantile_cont({c}, 0.75)')} AS p75, {r_sql(f'max({c})')} AS max FROM lineitem"""
    for c in _DESC_COLS))
def quality_describe(spark, d):
    """describe() of the numeric line-item columns."""
    return rounded(Q.describe_numeric(tb.load(spark, d, "lineitem"), _DESC_COLS), 6)


@register("quality_rule_violations", with_("order_facts", extra=[
    """t AS (SELECT CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS BIGINT) AS gold,
               CAST(count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS BIGINT) AS silver,
               CAST(count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS BIGINT) AS bronze,
               CAST(count(*) AS BIGINT) AS total
             FROM order_facts GROUP BY noc, edition)"""]) + """
SELECT 'negative_gold' AS rule, CAST(count(*) FILTER (WHERE gold < 0) AS BIGINT) AS n_rows FROM t UNION ALL
SELECT 'negative_silver', CAST(count(*) FILTER (WHERE silver < 0) AS BIGINT) FROM t UNION ALL
SELECT 'negative_bronze', CAST(count(*) FILTER (WHERE bronze < 0) AS BIGINT) FROM t UNION ALL
SELECT 'negative_total', CAST(count(*) FILTER (WHERE total < 0) AS BIGINT) FROM t UNION ALL
SELECT 'total_mismatch', CAST(count(*) FILTER (WHERE total IS DISTINCT FROM gold + silver + bronze) AS BIGINT) FROM t""")
def quality_rule_violations(spark, d):
    """A7 on a tally whose total counts every order (priorities 4-5 break the sum rule)."""
    of = tb.order_facts(spark, d)
    t = of.groupBy("noc", "edition").agg(
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("gold"),
        F.count_if(F.col("o_orderpriority") == "2-HIGH").alias("silver"),
        F.count_if(F.col("o_orderpriority") == "3-MEDIUM").alias("bronze"),
        F.count(F.lit(1)).alias("total"))
    return Q.rule_violations(t, ["gold", "silver", "bronze"], "total")


@register("quality_range_nulling", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 OR c_acctbal > 9000 THEN NULL ELSE c_acctbal END AS c_acctbal
FROM customer""")
def quality_range_nulling(spark, d):
    """Account balance outside [0, 9000] -> NULL."""
    c = tb.load(spark, d, "customer").select("c_custkey", "c_acctbal")
    return Q.null_out_of_range(c, {"c_acctbal": (0.0, 9000.0)})


@register("quality_exact_dedup", "SELECT DISTINCT p_name, p_type, p_size FROM part")
def quality_exact_dedup(spark, d):
    """Exact duplicate removal."""
    return Q.exact_dedup(tb.load(spark, d, "part").select("p_name", "p_type", "p_size"))


@register("quality_duplicate_rows", """
SELECT p_partkey, p_name, p_type, p_size FROM part p
WHERE (p_name, p_type, p_size) IN (SELECT (p_name, p_type, p_size) FROM part GROUP BY ALL HAVING count(*) > 1)""")
def quality_duplicate_rows(spark, d):
    """A9 keep=False: every member of a duplicate (name, type, size) group."""
    p = tb.load(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size")
    return Q.duplicate_rows(p, ["p_name", "p_type", "p_size"])


@register("quality_dedup_first", """
SELECT c_nationkey, c_mktsegment, c_custkey, c_name, c_acctbal FROM (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn
  FROM customer) WHERE rn = 1""")
def quality_dedup_first(spark, d):
    """A10: first customer per (nation, segment) by balance descending."""
    c = tb.load(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", "c_name", "c_acctbal")
    c = c.withColumn("__neg", -F.col("c_acctbal"))
    return Q.dedup_first(c, ["c_nationkey", "c_mktsegment"], ["__neg", "c_custkey"]).drop("__neg")


# Test-binding recode map (illustrative names for a few nations).
_RECODE = {"NATION_0": "Algeria", "NATION_1": "Argentina", "NATION_2": "Brazil",
           "NATION_3": "Canada", "NATION_4": "Egypt"}
_RECODE_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _RECODE.items()) + ") AS m(k, v)"


def _cust_nation(spark, d):
    c = tb.load(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = tb.load(spark, d, "nation").select("n_nationkey", "n_name")
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", F.col("n_name").alias("nation"))


@register("quality_recode_replace", f"""
SELECT c.c_custkey, coalesce(m.v, n.n_name) AS nation
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN {_RECODE_SQL} ON m.k = n.n_name""")
def quality_recode_replace(spark, d):
    """A11 replace(): unmapped names kept."""
    return Q.recode(_cust_nation(spark, d), "nation", Q.mapping_frame(spark, _RECODE), strict=False)


@register("quality_recode_map", f"""
SELECT c.c_custkey, m.v AS nation
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN {_RECODE_SQL} ON m.k = n.n_name""")
def quality_recode_map(spark, d):
    """A11 map(): unmapped names -> NULL."""
    return Q.recode(_cust_nation(spark, d), "nation", Q.mapping_frame(spark, _RECODE), strict=True)


def _alias_codes(spark, d):
    """Alias map by rule: 'N' + two-digit key -> nation name, for every nation
    of the AFRICA and AMERICA regions (others have no alias)."""
    n = tb.load(spark, d, "nation")
    return n.filter(F.col("n_regionkey") <= 1).select(
        F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("ioc"),
        F.col("n_name").alias("iso3"))


@register("quality_code_bridge", """
WITH a AS (SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS ioc, n_name AS iso3 FROM nation WHERE n_regionkey <= 1),
s AS (SELECT s.s_suppkey, CASE WHEN s.s_acctbal < 2000 THEN ' n' || lpad(CAST(s.s_nationkey AS VARCHAR), 2, '0')
                             ELSE lower(n.n_name) END AS code
      FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey)
SELECT s.s_suppkey, s.code, k.n_name AS iso3, lpad(CAST(k.n_nationkey AS VARCHAR), 3, '0') AS id3
FROM s LEFT JOIN a ON upper(trim(s.code)) = a.ioc
JOIN nation k ON coalesce(a.iso3, upper(trim(s.code))) = k.n_name""")
def quality_code_bridge(spark, d):
    """Mixed alias / canonical codes -> canonical code -> 3-digit id."""
    s = tb.load(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    n = tb.load(spark, d, "nation").select("n_nationkey", "n_name")
    code = F.when(F.col("s_acctbal") < 2000,
                  F.concat(F.lit(" n"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0"))) \
        .otherwise(F.lower("n_name"))
    src = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", code.alias("code"))
    known = n.select(F.col("n_name").alias("iso3"), F.col("n_nationkey").alias("num_id"))
    return Q.code_bridge(src, "code", _alias_codes(spark, d), known).select("s_suppkey", "code", "iso3", "id3")


@register("quality_names_per_key", """
SELECT p_brand, CAST(count(DISTINCT p_type) AS BIGINT) AS n_names,
       array_to_string(list_sort(list(DISTINCT p_type)), ', ') AS names
FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1""")
def quality_names_per_key(spark, d):
    """Brands carrying more than one type."""
    r = Q.names_per_key(tb.load(spark, d, "part"), "p_brand", "p_type")
    return r.withColumn("names", F.array_join("names", ", "))


@register("quality_set_compare", """
WITH a AS (SELECT DISTINCT o_custkey AS v FROM orders),
b AS (SELECT DISTINCT c_custkey AS v FROM customer)
SELECT coalesce(a.v, b.v) AS value,
       CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN 'both' WHEN a.v IS NOT NULL THEN 'only_a' ELSE 'only_b' END AS side
FROM a FULL JOIN b ON a.v = b.v""")
def quality_set_compare(spark, d):
    """Customers who ordered vs all customers."""
    return Q.set_compare(tb.load(spark, d, "orders"), tb.load(spark, d, "customer"), "o_custkey", "c_custkey")


@register("quality_side_by_side", """
WITH a AS (SELECT n.n_name, array_to_string(list_sort(list(DISTINCT c.c_mktsegment)), ', ') AS codes_a
           FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1),
b AS (SELECT n.n_name, array_to_string(list_sort(list(DISTINCT CAST(CAST(floor(s.s_acctbal / 1000) AS BIGINT) AS VARCHAR))), ', ') AS codes_b
      FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY 1)
SELECT coalesce(a.n_name, b.n_name) AS n_name, codes_a, codes_b FROM a FULL JOIN b ON a.n_name = b.n_name""")
def quality_side_by_side(spark, d):
    """Per nation name, sorted code sets of two tables side by side."""
    n = tb.load(spark, d, "nation").select("n_nationkey", "n_name")
    a = tb.load(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    b = tb.load(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")) \
        .withColumn("s_code", F.floor(F.col("s_acctbal") / 1000).cast("string"))  # balance band
    r = Q.side_by_side_codes(a, b, "n_name", "c_mktsegment", "s_code")
    return r.select("n_name", F.array_join("codes_a", ", ").alias("codes_a"),
                    F.array_join("codes_b", ", ").alias("codes_b"))


@register("quality_canonical_code", """
SELECT p_partkey, p_name, first_value(p_brand) OVER (PARTITION BY p_name ORDER BY p_partkey) AS p_brand FROM part""")
def quality_canonical_code(spark, d):
    """Every part takes the brand of the first part with the same name."""
    p = tb.load(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    return Q.canonical_code(p, "p_name", "p_brand", ["p_partkey"]).select("p_partkey", "p_name", "p_brand")


_FILL_SRC = """src AS (
  SELECT c.c_custkey, CASE WHEN c.c_acctbal < 500 THEN ' ' || CAST(c.c_nationkey AS VARCHAR) || ' '
                          ELSE CAST(c.c_nationkey AS VARCHAR) END AS code,
         CASE WHEN c.c_acctbal < 0 THEN NULL WHEN c.c_acctbal < 1000 THEN 'NaN' WHEN c.c_acctbal < 2000 THEN '  '
              ELSE n.n_name END AS country_name
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)"""
_FILL_REF = """ref AS (
  SELECT upper(trim(CAST(n_nationkey AS VARCHAR))) AS rk, trim(n_name) AS rv FROM nation WHERE n_regionkey <> 4)"""
_FILL_MISS = """(j.country_name IS NULL OR trim(j.country_name) = '' OR upper(trim(j.country_name)) IN ('NAN', 'NULL'))"""


def _fill(spark, d):
    c = tb.load(spark, d, "customer")
    n = tb.load(spark, d, "nation")
    code = F.when(F.col("c_acctbal") < 500, F.concat(F.lit(" "), F.col("c_nationkey").cast("string"), F.lit(" "))) \
        .otherwise(F.col("c_nationkey").cast("string"))
    name = F.when(F.col("c_acctbal") < 0, F.lit(None).cast("string")).when(F.col("c_acctbal") < 1000, "NaN") \
        .when(F.col("c_acctbal") < 2000, "  ").otherwise(F.col("n_name"))
    src = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", code.alias("code"), name.alias("country_name"))
    ref = n.filter("n_regionkey <> 4").select(F.col("n_nationkey").cast("string").alias("k"), "n_name", "n_nationkey")
    return Q.fill_from_lookup(src, "code", "country_name", ref, "k", "n_name", ["n_nationkey"])


@register("quality_fill_lookup", with_(extra=[_FILL_SRC, _FILL_REF]) + f"""
SELECT j.c_custkey, j.code, CASE WHEN {_FILL_MISS} AND r.rv IS NOT NULL THEN r.rv ELSE j.country_name END AS country_name
FROM src j LEFT JOIN ref r ON upper(trim(j.code)) = r.rk""")
def quality_fill_lookup(spark, d):
    """Fill missing names (NULL / blank / 'NaN') from a code lookup."""
    return _fill(spark, d)[0]


@register("quality_fill_lookup_count", with_(extra=[_FILL_SRC, _FILL_REF]) + f"""
SELECT CAST(count(*) FILTER (WHERE {_FILL_MISS} AND r.rv IS NOT NULL) AS BIGINT) AS n_updated
FROM src j LEFT JOIN ref r ON upper(trim(j.code)) = r.rk""")
def quality_fill_lookup_count(spark, d):
    """Number of rows filled."""
    return _fill(spark, d)[1]


@register("quality_fill_lookup_unmatched", with_(extra=[_FILL_SRC, _FILL_REF]) + f"""
SELECT DISTINCT upper(trim(j.code)) AS code FROM src j LEFT JOIN ref r ON upper(trim(j.code)) = r.rk
WHERE {_FILL_MISS} AND r.rv IS NULL AND trim(j.code) <> ''""")
def quality_fill_lookup_unmatched(spark, d):
    """Distinct codes still missing after the fill (sort at the sink)."""
    return _fill(spark, d)[2]


@register("quality_trailing_fill", with_("series", extra=[
    """tm AS (SELECT d.noc, d.year, avg(s.urgent_value) AS f FROM series d
              JOIN series s ON s.noc = d.noc AND s.year BETWEEN d.year - 4 AND d.year - 1 GROUP BY d.noc, d.year)"""]) + f"""
SELECT s.noc, s.year, {r_sql('coalesce(s.urgent_value, tm.f)')} AS urgent_value
FROM series s LEFT JOIN tm ON tm.noc = s.noc AND tm.year = s.year""")
def quality_trailing_fill(spark, d):
    """NULL urgent-order price filled with the entity's mean over the 4 previous years."""
    s = tb.series(spark, d)
    out = P.fill_from_trailing_mean(s.select("noc", "year", "urgent_value"), s, "noc", "year", "urgent_value")
    return rounded(out, 6)


@register("quality_edition_filter", with_("tally") + """
SELECT edition, noc, total, year FROM tally
WHERE lower(edition) LIKE '%summer%' AND year BETWEEN 1996 AND 2000""")
def quality_edition_filter(spark, d):
    """Summer editions 1996-2000, year parsed from the edition text."""
    t = tb.tally(spark, d).select("edition", "noc", "total").withColumnRenamed("year", "y0")
    return Q.edition_filter(t, "edition", contains="Summer", y0=1996, y1=2000)


@register("quality_to_long", with_("order_facts", extra=[
    "cy AS (SELECT noc, year, sum(o_totalprice) AS v FROM order_facts GROUP BY noc, year)",
    "yrs AS (SELECT DISTINCT year FROM cy)"]) + f"""
SELECT e.noc, y.year, {r_sql('cy.v')} AS value
FROM (SELECT DISTINCT noc FROM cy) e CROSS JOIN yrs y LEFT JOIN cy ON cy.noc = e.noc AND cy.year = y.year""")
def quality_to_long(spark, d):
    """A2: customer x year order value pivoted wide (one column per year), then back to long."""
    of = tb.order_facts(spark, d)
    cy = of.groupBy("noc", F.col("year").cast("string").alias("year")).agg(F.sum("o_totalprice").alias("v"))
    years = sorted(r[0] for r in cy.select("year").distinct().collect())  # they name the columns
    wide = I.to_wide(cy, ["noc"], "year", "v", years)
    return rounded(I.to_long(wide, ["noc"]), 6)


@register("quality_coerce", f"""
SELECT event_id, TRY_CAST(CASE WHEN value > 40 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS value,
       CASE WHEN trim(event_type) = '' THEN NULL ELSE trim(event_type) END AS event_type
FROM events""")
def quality_coerce(spark, d):
    """A3: text numbers coerced leniently ('n/a' -> NULL), text trimmed."""
    e = tb.load(spark, d, "events")
    raw = e.select("event_id", F.when(F.col("value") > 40, F.lit("n/a")).otherwise(F.col("value").cast("string"))
                   .alias("value"), F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")).alias("event_type"))
    return I.coerce_schema(raw, doubles=["value"], texts=["event_type"])
