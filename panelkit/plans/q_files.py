"""File sources and sinks: given tables are written in a file format under the
shared checkpoint folder, read back, and must equal the table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import ingest as I
from ..session import ensure_checkpoint_dir
from ..sources import readers as R
from ..sources import sinks as S
from . import tables as tb
from .catalog import r_sql, register, rounded
from .sqlbase import with_

CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"


def _path(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _customer(spark, d):
    c = tb.load(spark, d, "customer")
    return c.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_mktsegment")


_CUSTOMER_SQL = "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey, c_mktsegment FROM customer"


@register("file_csv", _CUSTOMER_SQL)
def file_csv(spark, d):
    """CSV sink and scan with a non-ASCII separator and an explicit schema."""
    path = _path(spark, "csv")
    S.write_csv(_customer(spark, d), path, sep="\u00a7")
    return R.read_csv(spark, path, CUSTOMER, sep="\u00a7")


@register("file_csv_per_group", _CUSTOMER_SQL)
def file_csv_per_group(spark, d):
    """One CSV folder per market segment, read back as one table."""
    path = _path(spark, "groups")
    S.write_per_group(_customer(spark, d), path, "c_mktsegment")
    return R.read_csv(spark, path, CUSTOMER).select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@register("file_json", _CUSTOMER_SQL)
def file_json(spark, d):
    """JSON records, one per line."""
    path = _path(spark, "json")
    S.write_json(_customer(spark, d), path)
    return R.read_json_records(spark, path, CUSTOMER, lines=True)


@register("file_table", _CUSTOMER_SQL + " WHERE c_nationkey < 10")
def file_table(spark, d):
    """Parquet stage table partitioned by nation; a range of partitions read."""
    path = _path(spark, "stage")
    S.write_table(_customer(spark, d), path, ["c_nationkey"])
    return R.read_table(spark, path).where("c_nationkey < 10").select("c_custkey", "c_name", F.col("c_nationkey").cast("int"), "c_mktsegment")


@register("file_table_whole", _CUSTOMER_SQL)
def file_table_whole(spark, d):
    """Parquet stage table partitioned by nation, all partitions read."""
    path = _path(spark, "stage")
    S.write_table(_customer(spark, d), path, ["c_nationkey"])
    return R.read_table(spark, path).select("c_custkey", "c_name", F.col("c_nationkey").cast("int"), "c_mktsegment")


@register("file_column_fallback", """
SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey,
  CASE WHEN c_mktsegment < 'F' THEN c_mktsegment END AS c_mktsegment FROM customer""")
def file_column_fallback(spark, d):
    """Two files of one table, the second with other column names and without a column."""
    c, first, second = _customer(spark, d), _path(spark, "names"), _path(spark, "names")
    S.write_table(c.where("c_mktsegment < 'F'"), first)
    other = c.where("c_mktsegment >= 'F' OR c_mktsegment IS NULL")
    S.write_table(other.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("Name"), F.col("c_nationkey").alias("nation")), second)
    names = {"c_custkey": ["customer_id"], "c_name": ["name", "Name"], "c_nationkey": ["nation_id", "nation"]}
    parts = [R.with_declared_columns(R.read_table(spark, x), CUSTOMER, names) for x in (first, second)]
    return parts[0].unionByName(parts[1])


@register("file_json_array", _CUSTOMER_SQL)
def file_json_array(spark, d):
    """JSON arrays of records, one a file, as another program writes them."""
    path = _path(spark, "array")
    rows = _customer(spark, d)
    arrays = rows.groupBy("c_nationkey").agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    arrays.repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    return R.read_json_records(spark, f"{path}/*/*", CUSTOMER)


@register("file_text_folder", """SELECT o_orderpriority || ': ' || count(*) AS line FROM orders GROUP BY o_orderpriority""")
def file_text_folder(spark, d):
    """Whole text files, their lines taken apart again."""
    path = _path(spark, "texts")
    n = tb.load(spark, d, "orders").groupBy("o_orderpriority").count()
    n.select(F.concat_ws(": ", "o_orderpriority", F.col("count").cast("string")).alias("value")).write.text(path)
    return R.read_text_files(spark, path).select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")


@register("file_forced_strings", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer""")
def file_forced_strings(spark, d):
    """CSV in another encoding, all columns kept as text."""
    path = _path(spark, "strings")
    rows = _customer(spark, d)
    rows.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    schema = ", ".join(f"{c} string" for c in rows.columns)
    return R.read_csv(spark, path, schema, encoding="ISO-8859-1", keep_text=True)


@register("file_report", """SELECT o_orderpriority || ': ' || count(*) AS line FROM orders GROUP BY o_orderpriority""")
def file_report(spark, d):
    """Text report, a line per order priority."""
    path = _path(spark, "report")
    n = tb.load(spark, d, "orders").groupBy("o_orderpriority").count()
    lines = n.select(F.lit(1).alias("section"), F.concat_ws(": ", "o_orderpriority", F.col("count").cast("string")).alias("line"))
    S.write_report(lines, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@register("file_entity_series", with_("nation_year") + f"""
SELECT CAST(noc AS VARCHAR) AS noc, year, indicator, {r_sql('value')} AS value FROM (
  SELECT noc, year, 'gdp, total' AS indicator, CAST(gdp AS DOUBLE) AS value FROM nation_year
  UNION ALL SELECT noc, year, 'population', CAST(population AS DOUBLE) FROM nation_year)""")
def file_entity_series(spark, d):
    """A1: one file per nation with a year column and indicators, one of whose
    names holds the separator, read back as one long table."""
    path = _path(spark, "series")
    ny = tb.nation_year(spark, d).select("noc", F.concat(F.lit("YR"), F.col("year").cast("string")).alias("Year"),
                                         F.col("gdp").cast("double").alias("gdp, total"), "population")
    S.write_per_group(ny.repartition("noc"), path, "noc")
    long, _ = I.read_entity_series(spark, f"{path}/*/*.csv", entity_of=r"noc=([^/]+)/")
    return rounded(long.select("noc", "year", "indicator", "value"), 6, ["value"])
