from pyspark.sql import functions as F

from panelkit.operators import panel as P

TALLY = [("2000 Summer", 1, 2000, "Aland", "A", 1, 0, 0, 1),
         ("2000 Summer", 1, 2000, "Bland", "B", 0, 2, 0, 2),
         ("2004 Summer", 2, 2004, "Aland", "A", 0, 0, 1, 1),
         ("2004 Winter", 3, 2004, "Cland", "C", 1, 1, 1, 3)]
T_SCHEMA = "edition string, edition_id int, year int, country string, noc string, gold int, silver int, bronze int, total int"


def _tally(spark):
    return spark.createDataFrame(TALLY, T_SCHEMA)


def _series(spark):
    rows = [("A", 1996, 1.0, None), ("A", 1997, 3.0, None), ("A", 1999, None, None),
            ("B", 1998, 10.0, 1.0), ("B", 2003, 20.0, 2.0), ("D", 2001, 5.0, 5.0)]
    return spark.createDataFrame(rows, "noc string, year int, gdp double, pop double")


def test_trailing_mean_window_and_nulls(spark):
    out = P.trailing_mean(_tally(spark).select("noc", "year", "edition"), _series(spark), "noc", "year", ["gdp", "pop"], 4)
    got = {(r.noc, r.edition): (r.gdp, r.pop) for r in out.collect()}
    assert got[("A", "2000 Summer")] == (2.0, None)     # 1996..1999: mean of 1, 3 (null skipped); pop all null
    assert got[("B", "2000 Summer")] == (10.0, 1.0)
    assert got[("A", "2004 Summer")] == (None, None)    # 2000..2003 has only an all-null row? no rows -> null
    assert got[("C", "2004 Winter")] == (None, None)    # no series


def test_densify_adds_zero_rows_with_fd_columns(spark):
    t = _tally(spark)
    out = P.densify(t, _series(spark).select("noc"), "noc", "year", "edition", ["gold", "silver", "bronze", "total"])
    rows = {(r.noc, r.edition): r for r in out.collect()}
    assert len(rows) == 4 + (3 * 3 - 3)           # 3 editions x entities {A, B, D}; A/B already present where listed
    z = rows[("D", "2000 Summer")]
    assert (z.gold, z.total, z.country, z.edition_id) == (0, 0, None, 1)   # edition_id copied, name not
    assert ("C", "2000 Summer") not in rows        # C has no series


def test_host_lookup_first_and_conflicts(spark):
    g = spark.createDataFrame([(2000, "2000 Summer", "X", "Xcity"), (2000, "2000 Winter", "Y", "Ycity"),
                               (2004, "2004 Summer", "Z", "Zcity")], "year int, edition string, host string, city string")
    lookup, conflicts = P.host_lookup(g, ["year"], ["host", "city"], order=["edition"])
    assert {r.year: r.host for r in lookup.collect()} == {2000: "X", 2004: "Z"}
    assert [r.year for r in conflicts.collect()] == [2000]


def test_missing_report_lines(spark):
    games = spark.createDataFrame([(2000, "2000 Summer", "H", "Hc")], "year int, edition string, host_country string, host_city string")
    rep = P.missing_report(_tally(spark), games, _series(spark))
    lines = [r.line for r in rep.orderBy("section", "line").collect()]
    assert "Missing Olympic summary match for year=2004, edition=2004 Summer" in lines
    assert "C: missing country file" in lines
    assert "A - year=2000, edition=2000 Summer: missing previous years 1998" in lines
    assert "No missing data found." not in lines


def test_build_panel_column_order(spark):
    games = spark.createDataFrame([(2000, "2000 Summer", "H", "Hc")], "year int, edition string, host_country string, host_city string")
    p = P.build_panel(_tally(spark), games, _series(spark), medals=["gold", "silver", "bronze", "total"], indicators=["gdp", "pop"])
    assert p.columns == [c.split()[0] for c in T_SCHEMA.split(", ")] + ["host_country", "host_city", "gdp", "pop"]
    assert p.filter(F.col("host_country") == "H").count() == 3   # A, B, D rows in 2000 Summer
