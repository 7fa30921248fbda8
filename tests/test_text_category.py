from pyspark.sql import functions as F

from panelkit.operators import category as G
from panelkit.operators import text as T

HTML = ("<html><head><title>Titolo</title><script>var x='<p>';</script></head><body><nav>menu</nav>"
        "<div class='x story__text'>Primo\t paragrafo\r\n\n\nsecondo   pezzo</div></body></html>")


def test_extract_articles(spark):
    pages = spark.createDataFrame([(1, "https://x.it/2012/08/05/a", HTML), (2, "https://x.it/a", "<body>solo</body>")],
                                  "page_id long, url string, html string")
    got = {r.page_id: r for r in T.extract_articles(pages).collect()}
    assert got[1].title == "Titolo" and got[1].date == "2012-08-05"
    assert got[1].text == "Primo\n paragrafo\nsecondo pezzo"
    assert got[2].date == "0000-00-00" and got[2].text == "solo"


def test_repair_date_and_listing(spark):
    df = spark.createDataFrame([("0000-00-00", "Roma (5 agosto 2012) testo"), ("0000-00-00", "nessuna"),
                                ("2001-01-01", "(1 maggio 1999)"), ("0000-00-00", "(3 foo 2010)")], "date string, text string")
    got = [r[0] for r in df.select(T.repair_date("date", "text")).collect()]
    assert got == ["2012-08-5", "0000-00-00", "2001-01-01", "2010-12-3"]
    many = spark.createDataFrame([("a" + "\n" * 100,), ("b\nc",)], "text string")
    assert [r.text for r in T.drop_listing_pages(many, "text").collect()] == ["b\nc"]


def test_chunking_whole_text(spark):
    df = spark.createDataFrame([(1, "x" * 1201), (2, "")], "id long, text string")
    ch = T.chunk_chars(df, "id", "text", 500).orderBy("chunk_no").collect()
    assert [len(r.chunk) for r in ch] == [500, 500, 201]
    tk = T.chunk_tokens(spark.createDataFrame([(1, " ".join(str(i) for i in range(10)))], "id long, text string"),
                        "id", "text", 4, 1).orderBy("chunk_no").collect()
    assert [r.chunk for r in tk] == ["0 1 2 3", "3 4 5 6", "6 7 8 9", "9"]


def test_cosine_top_k(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id long, v array<double>")
    got = [r.id for r in T.semantic_top_k(df, "id", "v", [1.0, 0.1], 2).orderBy("rank").collect()]
    assert got == [1, 3]


def test_grid_density_two_blobs(spark):
    pts = [(i, 0.05 * (i % 7), 0.05 * (i // 7)) for i in range(49)] + \
          [(100 + i, 10 + 0.05 * (i % 7), 10 + 0.05 * (i // 7)) for i in range(49)] + [(999, 50.0, 50.0)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    got = {r.id: r.cluster for r in T.grid_density_clusters(df, "id", "x", "y", eps=0.2, min_samples=5,
                                                             min_cluster_size=10).collect()}
    assert got[999] == -1 and got[0] != got[100] and got[0] != -1 and len({got[i] for i in range(49)}) == 1


def test_event_gender_order_and_team_units(spark):
    df = spark.createDataFrame([("Women's 100m",), ("100m, Men",), ("Mixed relay",), ("Men's and Women's",)], "e string")
    got = [r[0] for r in df.select(G.event_gender("e")).collect()]
    assert got == ["Femminile", "Maschile", "Misto/Altro", "Femminile"]
    ev = spark.createDataFrame([(1, "T", True, True), (1, "T", True, True), (2, "I", False, True), (2, "I", False, True),
                                (3, "I", False, False)], "k int, e string, is_team boolean, has_medal boolean")
    assert G.medal_units(ev, "is_team", ["k", "e"]).count() == 3   # team once, two individual bronzes kept
