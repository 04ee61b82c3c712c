"""The whole pipeline on planted rows."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

pipeline = pytest.importorskip("corpus_pipeline")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices(["an", "er", "th", "on", "re", "is"], k=rng.randint(1, 4)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(n)) for _ in range(6))
    rows = [(i, text(12)) for i in range(300)]
    rows = [(i, t + (" zurk" if i % 5 == 1 else "")) for i, t in rows]
    item = " ".join(word() for _ in range(30))
    passage = " ".join(word() for _ in range(55))
    rows += [(1000, rows[0][1]), (1001, text(12) + "\n" + item), (1002, "first\n" + passage), (1003, passage + "\nsecond"), (1004, None), (1005, "")]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 1)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    left = []
    for i, (name, stage) in enumerate(pipeline.STAGES):
        docs = pipeline.materialize(stage(spark, docs, folder), "t")
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    toxic = {i for i in range(300) if i % 5 == 1}
    assert len(toxic & left[0]) <= 3 and len(left[0] - toxic) >= 240
    assert 1000 not in left[1] and {1002, 1003} <= left[1]  # a whole copy goes, a passage is cut
    assert 1001 not in left[3] and len(left[3]) >= 235
    out = {r.doc_id: r for r in docs.collect()}
    assert all(r.round_trip for r in out.values()) and out[1003].n_tokens < 10


def test_odd_tables(spark, folder, tmp_path):
    """Empty tables, rows without id or text, repeated rows: every stage takes them."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.where("doc_id < 40").unionByName(docs.where("doc_id < 5")).unionByName(docs.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.where("doc_id = 1004").withColumn("doc_id", F.lit(None).cast("long")))
    for name, d in (("odd", rows), ("empty", docs.limit(0))):
        at = str(tmp_path / name)
        d.write.parquet(f"{at}/documents.parquet")
        for t in ("labels", "benchmark"):
            x = spark.read.parquet(f"{folder}/{t}.parquet")
            (x if name == "odd" else x.limit(0)).write.parquet(f"{at}/{t}.parquet")
        out = pipeline.run(spark, at)
        ids = [r.doc_id for r in out.collect()]
        assert out.columns[-3:] == ["ids", "n_tokens", "round_trip"]
        known = [i for i in ids if i is not None]
        assert len(known) == len(set(known)) and (ids == [] if name == "empty" else len(ids) > 25)


def test_registered():
    names = set(entry.queries())
    assert {"pipeline"} | {n for n in names if n.startswith("op")} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
    assert set(entry.oracle_sql()) <= names
