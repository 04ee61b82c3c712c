import json
import re

import pytest

from tavola import cli
from tavola.operators import lemmas as L
from tavola.operators import lineage, sinks
from tavola.sources import files, pages
from tavola.streaming import ingest as I


def test_stream_equals_batch(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "2024-05-05.html").write_text('<img src="weber.jpg"><p>Húsleves</p>', encoding="utf-8")
    q = I.ingest(I.page_stream(spark, str(pages)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    (pages / "2024-05-12.html").write_text('<img src="weber.jpg"><p>Gulyás</p>', encoding="utf-8")
    q = I.ingest(I.page_stream(spark, str(pages)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = {(r.date, r.dish_name) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("2024-05-05", "Húsleves"), ("2024-05-12", "Gulyás")}


def test_stages(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    for d in range(5, 17):
        (pages / f"2024-05-{d:02d}.html").write_text('<img src="weber.jpg"><p>Húsleves</p><p>Rántott sajt</p>', encoding="utf-8")
    p = lambda x: str(tmp_path / x)
    cli.main(["menus", "--pages", str(pages), "--output", p("menus")])
    cli.main(["dishes", "--menus", p("menus"), "--output", p("dishes")])
    cli.main(["lemmas", "--csv", p("dishes"), "--output", p("lemmas")])
    cli.main(["dictionary", "--input", p("lemmas"), "--output-csv", p("dict"), "--output-json", p("dict.json")])
    cli.main(["categorize", "--input", p("lemmas"), "--output", p("cats"), "--stats", p("stats.json")])
    cli.main(["synonyms", "--input", p("cats"), "--output", p("resolved"), "--groups", p("groups")])
    cli.main(["seasonal", "--menus", p("menus"), "--dishes", p("resolved"), "--output-monthly", p("monthly"), "--output-summary", p("summary"), "--output-json", p("seasonal.json")])
    rows = spark.read.csv(p("summary"), header=True).collect()
    assert {r.canonical_name for r in rows} == {"húsleves", "rántott sajt"} and {r.total_count for r in rows} == {"12"}


def test_text_may_be_written_again(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / "2024-05-05.html").write_text("<p>Húsleves</p><p>Gulyás</p>", encoding="utf-8")
    for _ in range(2):
        cli.main(["text", "--pages", str(folder), "--output", str(tmp_path / "text")])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "text/dump")).collect()) == ["Gulyás", "Húsleves"]
    rows = spark.read.csv(str(tmp_path / "text/group_by"), header=True).collect()
    assert sorted((r.line, r.n) for r in rows) == [("Gulyás", "1"), ("Húsleves", "1")]
    cli.main(["clean", "--output", str(tmp_path / "text")])
    assert not (tmp_path / "text").exists()


def test_synonym_map_and_reports(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/d.csv").write_text('dish_name,count,lemmas,course,protein,cooking_method\n"Rizi bizi",5,rizi bizi,főétel,,\nPommes frites,2,pommes frites,főétel,,\n', encoding="utf-8")
    (tmp_path / "map.json").write_text(json.dumps({"groups": [{"canonical": "rizs", "variants": ["rizi", "RIZI BIZI"]}, {"canonical": "krumpli", "variants": ["pommes", "rizi"]}, {"canonical": "x", "variants": None}]}), encoding="utf-8")
    keys = [(r.ordinal, r.key, r.canonical) for r in files.read_synonyms(spark, str(tmp_path / "map.json")).orderBy("ordinal").collect()]
    assert keys == [(0, "rizs", "rizs"), (1, "rizi", "krumpli"), (2, "rizi bizi", "rizs"), (3, "krumpli", "krumpli"), (4, "pommes", "krumpli"), (5, "x", "x")]
    cli.main(["synonyms", "--input", str(tmp_path / "in"), "--synonym-map", str(tmp_path / "map.json"), "--output", str(tmp_path / "out"), "--groups", str(tmp_path / "groups")])
    assert {r.dish_name: r.canonical_name for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()} == {"Rizi bizi": "rizs", "Pommes frites": "krumpli"}
    groups = [(r.canonical_name, r.variant_name, r.match_type) for r in spark.read.csv(str(tmp_path / "groups"), header=True).collect()]
    assert sorted(groups) == [("krumpli", "Pommes frites", "curated"), ("rizs", "Rizi bizi", "curated")]
    assert "match_type=curated  names=2" in capsys.readouterr().out


def test_dictionary_file(spark, tmp_path, capsys):
    rows = spark.createDataFrame([('a a "b" ő',), ("a ő ,",)], "lemmas string")
    sinks.write_dictionary(L.lemma_dictionary(rows), str(tmp_path / "d.json"))
    got = json.loads((tmp_path / "d.json").read_text(encoding="utf-8"))
    assert got["total_unique_lemmas"] == 4 and got["total_occurrences"] == 7 and got["dictionary"] == {"a": 3, "ő": 2, '"b"': 1, ",": 1}
    assert [x["lemma"] for x in got["sorted_by_frequency"]] == ["a", "ő", '"b"', ","]
    # byte for byte what one writer in rank order writes, over several partitions
    words = spark.range(700).selectExpr("concat('w', id % 90, '\\u0001\"ő') AS lemmas")
    made = L.lemma_dictionary(words)
    sinks.write_dictionary(made, f"file://{tmp_path}/w.json")
    sinks.write_dictionary(made.drop("rank"), str(tmp_path / "v.json"))
    items = [(r.lemma, r.frequency) for r in made.orderBy("rank").collect()]
    whole = {"total_unique_lemmas": 90, "total_occurrences": 700, "dictionary": dict(items), "sorted_by_frequency": [{"lemma": w, "frequency": n} for w, n in items]}
    plain = json.dumps(whole, ensure_ascii=False, indent=2)
    flat = re.sub(r"\{\s+(\"lemma\": .*),\s+(\"frequency\": \d+)\s+\}", r"{\1, \2}", plain) + "\n"
    assert (tmp_path / "w.json").read_text(encoding="utf-8") == flat == (tmp_path / "v.json").read_text(encoding="utf-8")
    sinks.write_dictionary(L.lemma_dictionary(rows.limit(0)), str(tmp_path / "e.json"))
    assert json.loads((tmp_path / "e.json").read_text())["dictionary"] == {}
    assert tuple(L.lemma_counts(rows).first()) == (2, 7, 1, 6)


def test_model_ladder():
    def absent(name):
        raise OSError(name)

    assert L.load_model("any", lambda n: f"model {n}", absent) == "model any"
    assert L.load_model("hu_core", absent, lambda n: f"blank {n}") == "blank hu"
    with pytest.raises(OSError):
        L.load_model("en_core", absent, lambda n: "blank")


def test_whole_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n", encoding="utf-8")
    assert [r.text for r in files.read_text(spark, str(tmp_path)).collect()] == ["one\ntwo\n"]


def test_counts_of_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a"), ("2024-01-02 00:00:00", "a"), ("2024-01-03 00:00:00", "b"), ("2024-03-20 00:00:00", "a")]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, "ts string, event_type string").selectExpr("cast(ts AS timestamp) AS ts", "event_type").coalesce(1).write.parquet(str(tmp_path / f"in/p={i}"))
    stream = spark.readStream.schema("ts timestamp, event_type string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = I.monthly_stream(stream).writeStream.format("memory").queryName("monthly_counts_test").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert sorted((r.event_type, r.n) for r in spark.table("monthly_counts_test").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_no_private_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Frame:
        class sparkSession:
            sparkContext = Context()

            class conf:
                @staticmethod
                def get(name, default=None):
                    return default

    with pytest.raises(ValueError):
        lineage.cut(Frame())
