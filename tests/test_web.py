"""The data source of daily pages, with a site of its own."""

import datetime
import os

import pytest

from tavola import cli
from tavola.sources import pages, web

SUNDAY = datetime.date(2024, 5, 5)


def site(log, fails=0, down=()):
    """A site whose every page fails so often before it comes; ``log``: a folder with a file per request."""

    def get(url):
        name = url.rsplit("/", 1)[1]
        n = sum(x.startswith(name) for x in os.listdir(log))
        open(f"{log}/{name}.{n}", "w").close()
        if n < fails or name in down:
            raise OSError("no answer")
        return f"<p>Tűzött {name}</p>".encode("windows-1250")

    return get


def load(spark, get, name, **options):
    spark.dataSource.register(web.daily_pages(get, name, today=lambda: SUNDAY + datetime.timedelta(days=1), pause=lambda s: None))
    return spark.read.format(name).options(site="http://x/", **options).load()


def test_a_partition_per_day(spark, tmp_path):
    log = str(tmp_path)
    df = load(spark, site(log, fails=2), "days_a", first="2024-04-28", last="2024-05-05")
    assert df.rdd.getNumPartitions() == 8
    rows = {r.date: r for r in df.collect()}
    assert len(rows) == 8 and {r.tries for r in rows.values()} == {3, 1}  # the page of both Sundays is one
    assert rows["2024-05-05"].path == "http://x/vasarnap.htm" and rows["2024-04-29"].path == "http://x/hetfo.htm"
    assert bytes(rows["2024-05-03"].content).decode() == "<p>Tűzött pentek.htm</p>"
    text = pages.page_elements(df.select("path", "date", "content")).where("date = '2024-05-04'").first()
    assert (text.tag, text.text) == ("p", "Tűzött szombat.htm")


def test_default_is_the_week_up_to_yesterday(spark, tmp_path):
    assert sorted(r.date for r in load(spark, site(str(tmp_path)), "days_b").collect()) == [str(SUNDAY - datetime.timedelta(days=i)) for i in range(6, -1, -1)]


def test_pages_that_do_not_come(spark, tmp_path):
    get = site(str(tmp_path), down=("kedd.htm",))
    assert len(load(spark, get, "days_c", onError="skip", tries="2").collect()) == 6
    assert sum(x.startswith("kedd") for x in os.listdir(tmp_path)) == 2
    with pytest.raises(Exception, match="no answer"):
        load(spark, get, "days_d").collect()


def test_week_on_sundays(spark, tmp_path):
    os.makedirs(tmp_path / "log")
    got = web.fetch_week(spark, "http://x", str(tmp_path / "p"), SUNDAY, site(str(tmp_path / "log"), fails=0))
    assert [os.path.basename(x) for x in got] == [f"{SUNDAY - datetime.timedelta(days=i)}.html" for i in range(7)]
    assert (tmp_path / "p/2024-04-29.html").read_text(encoding="utf-8") == "<p>Tűzött hetfo.htm</p>"
    assert web.fetch_week(spark, "http://x", str(tmp_path / "p"), SUNDAY - datetime.timedelta(days=1), lambda url: 1 / 0) == []


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    os.makedirs(tmp_path / "log")
    get = site(str(tmp_path / "log"), fails=1)

    def run(last):
        spark.dataSource.register(web.daily_pages(get, "days_e", pause=lambda s: None))
        rows = spark.readStream.format("days_e").options(site="http://x", first="2024-05-01", last=last).load()
        query = rows.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r.date for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run("2024-05-03") == ["2024-05-01", "2024-05-02", "2024-05-03"]
    asked = len(os.listdir(tmp_path / "log"))
    assert run("2024-05-03") == ["2024-05-01", "2024-05-02", "2024-05-03"] and len(os.listdir(tmp_path / "log")) == asked
    assert run("2024-05-05") == [f"2024-05-0{i}" for i in range(1, 6)]


def test_fetch_stage(spark, tmp_path, monkeypatch, capsys):
    os.makedirs(tmp_path / "log")
    get, made = site(str(tmp_path / "log")), web.daily_pages
    monkeypatch.setattr(web, "daily_pages", lambda: made(get))
    cli.main(["fetch", "--site", "http://x", "--output", f"{tmp_path}/p", "--first", "2024-05-04", "--last", "2024-05-05"])
    assert sorted(os.listdir(tmp_path / "p")) == ["2024-05-04.html", "2024-05-05.html"] and "date=2024-05-04" in capsys.readouterr().out
