from pyspark.sql import functions as F

from tavola.operators import menus as M
from tavola.sources import pages as G

PAGE = """<html><body><p>Előtte</p><img src="img/Desperado.JPG"><p>Mai menü ára: 2400Ft</p><p>Húsleves</p>
<p>A: Rakott karfiol</p><p>Leves B: Rántott szelet</p><p>Nyitva 8-tól</p><img src=kukta.jpg><p>Extra 3000 ft</p><p>Pörkölt</p>
<img src="weber.png"><p>Tarja<script>x</script><p>&Aacute;fonya</body>"""


def frame(spark, html, path="x/2024-05-05.html"):
    return spark.createDataFrame([(path, "2024-05-05", bytearray(html.encode()))], "path string, date string, content binary")


def test_elements_nest_or_close():
    nested = G.elements_of("<p>a<img src=x><p>b")
    assert nested == [("p", None, "ab"), ("img", "x", ""), ("p", None, "b")]
    assert G.elements_of("<p>a<img src=x><p>b", close_p=True) == [("p", None, "a"), ("img", "x", ""), ("p", None, "b")]


def test_daily_menus(spark):
    rows = M.daily_menus(G.page_elements(frame(spark, PAGE), close_p=True)).collect()
    got = sorted((r.restaurant, r.dish_name, r.item_number, r.menu_type, tuple(sorted((r.prices or {}).items()))) for r in rows)
    assert ("Desperado", "Húsleves", 1, "main", (("regular", 2400),)) in got
    assert ("Desperado", "Rakott karfiol", 1, "option_A", (("regular", 2400),)) in got
    assert ("Desperado", "Rántott szelet", 2, "main", (("regular", 2400),)) in got
    assert ("Desperado", "Pörkölt", 1, "main", (("extra", 3000),)) in got
    assert ("Weber", "Áfonya", 1, "main", ()) in got
    assert not any("Előtte" in r[1] or "Nyitva" in r[1] for r in got)
    strict = M.daily_menus(G.page_elements(frame(spark, PAGE), close_p=True), strict_logos=True)
    assert strict.where("dish_name = 'Pörkölt'").count() == 0


def test_price_rules(spark):
    rows = [("p", "d", i, 1, "r", t) for i, t in enumerate(["menü 1499 ft", "menü 1500 ft", "Extra menü 2600ft", "menü 3501ft"])]
    out = M.section_prices(spark.createDataFrame(rows, "path string, date string, pos int, section int, restaurant string, text string")).first()
    assert out.prices == {"regular": 2600}


def test_read_pages_and_text(spark, tmp_path):
    (tmp_path / "2024-05-05.html").write_bytes("<p>Tök\r\nleves</p>a<br>b".encode("iso-8859-2"))
    (tmp_path / "none.html").write_text("<p>x")
    raw = G.read_pages(spark, str(tmp_path))
    assert [r.date for r in raw.collect()] == ["2024-05-05"]
    text = G.page_text(raw, "content")
    assert text.first().text == "Tök leves\na\nb"
    assert {r.line: r.n for r in G.line_frequency(text).collect()} == {"Tök leves": 1, "a": 1, "b": 1}


def test_committed_pages_parse(spark):
    import os

    import pytest

    folder = os.environ.get("TAVOLA_SAMPLE_PAGES", "")
    if not folder or not os.path.isdir(folder):
        pytest.skip("sample pages are not here")
    rows = M.daily_menus(G.page_elements(G.read_pages(spark, folder)))
    assert rows.select("date").distinct().count() > 30 and rows.where(F.length("dish_name") < 3).count() == 0


def test_schedule(spark):
    import datetime as dt

    days = spark.createDataFrame([(dt.date(2024, 5, 5),), (dt.date(2024, 5, 6),)], "day date")
    got = sorted(map(tuple, G.weekly_schedule(days).collect()))
    assert len(got) == 7 and got[0] == ("2024-04-29", "hetfo") and got[-1] == ("2024-05-05", "vasarnap")


def test_pages_leave_python_in_small_batches(spark):
    """Elements of large pages are not held for a whole batch of pages."""
    df = spark.range(40, numPartitions=1).selectExpr("cast(id AS string) AS path", "'2024-05-05' AS date", "cast(concat('<p>', repeat('ab ', 5000), '</p><p>x') AS binary) AS content")
    sizes = []
    for b in G.elements_in_batches(((str(i), "2024-05-05", f"<p>{'ab ' * 5000}</p><p>x") for i in range(40)), True, 60_000):
        sizes.append(b.num_rows)
    assert sum(sizes) == 80 and max(sizes) <= 10
    assert G.page_elements(df, True).count() == 80
