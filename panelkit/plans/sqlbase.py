"""DuckDB-side definitions of the derived tables in :mod:`panelkit.plans.tables`.

Used only to write the independent oracle SQL; each constant is a list of CTE
bodies that a query prepends with ``with_(...)``.
"""

from __future__ import annotations

ORDER_FACTS = """order_facts AS (
  SELECT o.o_orderkey, o.o_custkey AS noc, c.c_name AS country, c.c_nationkey, c.c_mktsegment,
         o.o_totalprice, o.o_orderpriority, o.o_orderstatus,
         CAST(year(o.o_orderdate) AS INTEGER) AS year,
         CASE WHEN month(o.o_orderdate) <= 6 THEN 'Winter' ELSE 'Summer' END AS season,
         CAST(year(o.o_orderdate) AS VARCHAR) || ' ' ||
           CASE WHEN month(o.o_orderdate) <= 6 THEN 'Winter' ELSE 'Summer' END AS edition
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""

TALLY = """tally AS (
  SELECT edition, CAST(year * 10 + CASE WHEN season = 'Summer' THEN 1 ELSE 0 END AS INTEGER) AS edition_id,
         year, country, noc, gold, silver, bronze, gold + silver + bronze AS total
  FROM (SELECT edition, year, season, noc, country,
               CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS BIGINT) AS gold,
               CAST(count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS BIGINT) AS silver,
               CAST(count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS BIGINT) AS bronze
        FROM order_facts GROUP BY edition, year, season, noc, country) t
  WHERE gold + silver + bronze > 0)"""

SERIES = """series AS (
  SELECT o.o_custkey AS noc, CAST(year(o.o_orderdate) AS INTEGER) AS year,
         sum(l.l_extendedprice * (1 - l.l_discount)) AS spend,
         CAST(count(*) AS DOUBLE) AS n_lines,
         sum(l.l_quantity) AS qty,
         avg(l.l_discount) AS avg_disc,
         avg(CASE WHEN o.o_orderpriority = '1-URGENT' THEN o.o_totalprice END) AS urgent_value
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  GROUP BY 1, 2)"""

GAMES = """games AS (
  SELECT g.edition, g.year, g.noc AS host_noc, g.country AS host_country, n.n_name AS host_city
  FROM (SELECT edition, year, noc, country, c_nationkey,
               row_number() OVER (PARTITION BY edition, year ORDER BY v DESC, noc ASC) AS rn
        FROM (SELECT edition, year, noc, country, c_nationkey, sum(o_totalprice) AS v
              FROM order_facts GROUP BY ALL) x) g
  LEFT JOIN nation n ON g.c_nationkey = n.n_nationkey
  WHERE g.rn = 1)"""

ATHLETE_EVENTS = """athlete_events AS (
  SELECT CAST(year(o.o_orderdate) AS INTEGER) AS year, n.n_name AS noc, o.o_custkey AS athlete_id,
         CASE WHEN c.c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'Female'
              WHEN c.c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'Male' END AS sex,
         p.p_type AS sport, l.l_partkey AS event, p.p_name AS event_name,
         CASE WHEN l.l_returnflag = 'A' THEN 'Gold' WHEN l.l_returnflag = 'R' THEN 'Silver' END AS medal,
         (l.l_linestatus = 'O') AS is_team, l.l_orderkey AS order_id
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

NATION_YEAR = """nation_year AS (
  SELECT n.n_name AS noc, f.year, sum(f.o_totalprice) AS gdp,
         CAST(count(DISTINCT f.noc) AS DOUBLE) AS population,
         CAST(count(*) FILTER (WHERE f.o_orderpriority = '1-URGENT') AS BIGINT) AS medals,
         CAST(count(*) AS BIGINT) AS n_orders,
         sum(f.o_totalprice) / CAST(count(DISTINCT f.noc) AS DOUBLE) AS gdp_pc
  FROM order_facts f JOIN nation n ON f.c_nationkey = n.n_nationkey
  GROUP BY 1, 2)"""

DEPS = {
    "order_facts": (ORDER_FACTS, ()),
    "tally": (TALLY, ("order_facts",)),
    "series": (SERIES, ()),
    "games": (GAMES, ("order_facts",)),
    "athlete_events": (ATHLETE_EVENTS, ()),
    "nation_year": (NATION_YEAR, ("order_facts",)),
}


def with_(*names: str, extra: list[str] | None = None) -> str:
    """WITH clause holding the named base CTEs (dependencies first) plus extras."""
    order: list[str] = []

    def visit(n: str) -> None:
        for dep in DEPS[n][1]:
            visit(dep)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [DEPS[n][0] for n in order] + list(extra or [])
    return "WITH " + ",\n".join(parts) + "\n"


def band_sql(x: str) -> str:
    from ..dims import INCOME_BANDS, INCOME_BAND_FALLBACK
    whens = " ".join(f"WHEN {x} >= {lo} AND {x} < {hi if hi != float('inf') else '1e308'} THEN '{lab}'"
                     for lab, lo, hi in INCOME_BANDS)
    return f"(CASE WHEN {x} IS NULL THEN NULL {whens} ELSE '{INCOME_BAND_FALLBACK}' END)"


MEDAL_ROWS = """medal_rows AS (
  SELECT CAST(year(o.o_orderdate) AS INTEGER) AS year, o.o_custkey AS noc, p.p_name AS sport, l.l_partkey AS event,
         CASE WHEN l.l_returnflag = 'A' THEN 'Gold' WHEN l.l_returnflag = 'R' THEN 'Silver' ELSE 'No medal' END AS medal
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey)"""

ROSTER = f"""roster AS (
  SELECT noc, year, population, gdp_pc, {band_sql('gdp_pc')} AS label FROM (
    SELECT o_custkey AS noc, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(count(*) AS DOUBLE) * 1000.0 AS population,
           avg(o_totalprice) / 30.0 AS gdp_pc
    FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2))"""

DEPS["medal_rows"] = (MEDAL_ROWS, ())
DEPS["roster"] = (ROSTER, ())

RAW_EVENTS = """raw_events AS (
  SELECT CAST(year(o.o_orderdate) AS INTEGER) AS year,
         CAST(year(o.o_orderdate) AS VARCHAR) || ' ' || CASE WHEN month(o.o_orderdate) <= 6 THEN 'Winter' ELSE 'Summer' END AS edition,
         n.n_name AS noc, o.o_custkey AS athlete_id, p.p_type AS sport, l.l_partkey AS event, p.p_name AS event_name,
         CASE WHEN l.l_returnflag = 'A' THEN 'Gold' WHEN l.l_returnflag = 'R' THEN 'Silver' ELSE '' END AS medal,
         CASE WHEN l.l_linestatus = 'O' THEN 'True' ELSE 'False' END AS is_team
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN part p ON l.l_partkey = p.p_partkey JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

BIO = """bio AS (
  SELECT c.c_custkey AS athlete_id,
         CASE WHEN c.c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'Female'
              WHEN c.c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'Male' END AS sex,
         CASE WHEN c.c_acctbal < 0 THEN ' ' || n.n_name || ' ' ELSE n.n_name END AS country, n.n_name AS noc
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

PREP = """prep AS (
  SELECT e.year, e.edition, e.noc, e.athlete_id, e.sport, e.event, e.event_name, e.medal,
         coalesce(lower(trim(e.is_team)) = 'true', false) AS is_team,
         coalesce(CASE b.sex WHEN 'Male' THEN 'Maschile' WHEN 'Female' THEN 'Femminile' END, 'Sconosciuto') AS athlete_sex,
         (e.medal IS NOT NULL AND trim(e.medal) <> '') AS has_medal,
         CASE WHEN regexp_matches(lower(e.event_name), '\\bsmall\\b|\\bred\\b') THEN 'Femminile'
              WHEN regexp_matches(lower(e.event_name), '\\blarge\\b|\\bold\\b') THEN 'Maschile' ELSE 'Misto/Altro' END AS event_gender
  FROM raw_events e LEFT JOIN bio b ON e.athlete_id = b.athlete_id
  WHERE contains(lower(e.edition), 'summer') AND e.year BETWEEN 1995 AND 2001)"""

UNITS_G = """gunits AS (
  SELECT year, noc, sport, event, medal, event_gender FROM prep WHERE has_medal AND NOT is_team
  UNION ALL
  SELECT DISTINCT year, noc, sport, event, medal, event_gender FROM prep WHERE has_medal AND is_team)"""

MBG = """mbg AS (
  SELECT year, noc, medals_f, medals_m, medals_mixed, medals_tot,
         medals_f / nullif(CAST(medals_f + medals_m AS DOUBLE), 0) AS share_f, medals_f - medals_m AS gap_fm,
         medals_m / nullif(CAST(medals_f + medals_m AS DOUBLE), 0) AS share_m
  FROM (SELECT year, noc, CAST(count(*) FILTER (WHERE event_gender = 'Femminile') AS BIGINT) AS medals_f,
               CAST(count(*) FILTER (WHERE event_gender = 'Maschile') AS BIGINT) AS medals_m,
               CAST(count(*) FILTER (WHERE event_gender = 'Misto/Altro') AS BIGINT) AS medals_mixed,
               CAST(count(*) AS BIGINT) AS medals_tot FROM gunits GROUP BY year, noc))"""

DEPS["raw_events"] = (RAW_EVENTS, ())
DEPS["bio"] = (BIO, ())
DEPS["prep"] = (PREP, ("raw_events", "bio"))
DEPS["gunits"] = (UNITS_G, ("prep",))
DEPS["mbg"] = (MBG, ("gunits",))

PROFILES = """profiles AS (
  SELECT s.noc, c.c_name AS country, s.year, r.gdp_pc, s.n_lines, s.qty, s.avg_disc, s.urgent_value
  FROM series s LEFT JOIN roster r ON r.noc = s.noc AND r.year = s.year
  LEFT JOIN customer c ON c.c_custkey = s.noc)"""
DEPS["profiles"] = (PROFILES, ("series", "roster"))


def t_tail_sql(t: str, nu: str) -> str:
    """P(T > |t|) for a whole number of degrees of freedom, by the finite
    trigonometric series (the library integrates the density)."""
    a, j = f"atan(abs({t}) / sqrt({nu}))", "lambda j: "
    odd = f"""2 / pi() * ({a} + CASE WHEN {nu} > 1 THEN sin({a}) * list_sum(list_transform(range(0, CAST(({nu} - 1) / 2 AS BIGINT)),
      {j}exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * power(cos({a}), 2 * j + 1))) ELSE 0 END)"""
    even = f"""sin({a}) * list_sum(list_transform(range(0, CAST({nu} / 2 AS BIGINT)),
      {j}exp(lgamma(j + 0.5) - lgamma(j + 1) - lgamma(0.5)) * power(cos({a}), 2 * j)))"""
    return f"((1 - CASE WHEN {nu} % 2 = 1 THEN {odd} ELSE {even} END) / 2)"


def chi2_tail_sql(x: str, k: str) -> str:
    """Upper tail of chi-square by the series of the lower one."""
    return f"""(1 - list_sum(list_transform(range(0, 3000),
      lambda j: exp(({k} / 2.0 + j) * ln({x} / 2.0) - {x} / 2.0 - lgamma({k} / 2.0 + j + 1)))))"""
