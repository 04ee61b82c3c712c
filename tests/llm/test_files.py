"""Operators that write files: drifted schemas and token planes."""

import datetime
import hashlib
import io
import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tavola.llm import drift, planes

CLIENTS = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"


def clients(n, seed=1):
    rng = random.Random(seed)
    maybe = lambda x: None if rng.random() < 0.1 else x
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, maybe(rng.randrange(n)), maybe("web"), maybe(day + datetime.timedelta(microseconds=rng.randrange(10**13))), maybe(f"n{i} é|,"), maybe(f"{i}@x"), maybe("c\n"), maybe(i % 25), maybe("retail"), maybe(round(rng.uniform(-1e6, 1e6), 2))) for i in range(n)]
    return [*rows, rows[3], rows[3], rows[5][:4] + ("other",) + rows[5][5:]]


def expected(rows):
    """Every step in plain Python."""
    crc = lambda i: zlib.crc32(str(i).encode())
    low = lambda r: [(x is not None, x if x is not None else 0) for x in r]
    rows = sorted(rows, key=lambda r: (crc(r[0]), low(r)))
    each = 1 + len(rows) // 250
    names = [f.name for f in drift.CLIENTS]
    out = {}
    for no in range(-(-len(rows) // each)):
        v = zlib.crc32(f"19:{no}".encode()) % 24
        v = 0 if v > 15 else v
        part, cols = [list(r) for r in rows[no * each : (no + 1) * each]], list(names)
        if v & 4:
            for r in part:
                r[7], r[8] = -1, "none"
            cols = [c for c in cols if c not in ("nation_id", "segment")]
        if v & 8:
            for r in part:
                r[9] = None if r[9] is None else float(np.float32(r[9]))
        if v & 2:
            cols = [cols[0], *reversed(cols[1:])]
        if v & 1:
            cols = [{"name": "email", "email": "name"}.get(c, c) for c in cols]
        lines = []
        for r in part:
            t = list(r)
            t[3] = None if t[3] is None else (t[3] - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
            t[9] = None if t[9] is None else math.floor(1048576 * t[9])
            lines.append("|".join("?" if x is None else str(x) for x in t))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[no] = (v, len(part), sum(x is None for r in part for x in r), sha(",".join(str(r[0]) for r in part)), sha("\n".join(lines)), ",".join(cols), ",".join(names), v != 0)
    return out


def local(path):
    return path.removeprefix("file://")


@pytest.mark.parametrize("n", [1, 700])
def test_drift_rewrite_as_plain_loops(spark, tmp_path, n):
    rows = clients(n) if n > 5 else clients(6)[:n]
    extra = spark.createDataFrame(rows, CLIENTS).withColumns({"rank": F.lit("x"), "_place": F.lit(1), "FILE_NO": F.lit(None).cast("int")})
    extra.repartition(3).write.parquet(f"{tmp_path}/clients.parquet")
    got = drift.op11_drift_rewrite(spark, str(tmp_path)).collect()
    assert {r.file_no: (r.version, r.n_rows, r.n_nulls, r.ids_sha256, r.rows_sha256, r.start_columns, r.columns, r.rewritten) for r in got} == expected(rows)
    folder = {os.path.dirname(local(r.path)) for r in got}
    assert len(folder) == 1 and sorted(os.listdir(f := folder.pop())) == sorted(os.path.basename(r.path) for r in got)
    assert not os.path.exists(f"{f}-work")
    for r in got:
        schema = pq.ParquetFile(local(r.path)).schema_arrow
        assert [int(x.metadata[b"PARQUET:field_id"]) for x in schema] == list(range(1, 11)) and [x.type for x in schema] == [x.type for x in drift.CLIENTS] and all(x.nullable for x in schema)


def test_drift_rewrite_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], CLIENTS).write.parquet(f"{tmp_path}/clients.parquet")
    assert drift.op11_drift_rewrite(spark, str(tmp_path)).collect() == []


def test_rewrite_by_ids(spark, tmp_path):
    """Names and order tell nothing; unknown ids go, lacking ones are filled; files of the schema stay as they are; a second run changes nothing."""
    F1, F2, F3 = drift.Field(1, "a", pa.int64()), drift.Field(2, "b", pa.string(), "none"), drift.Field(3, "c", pa.float64())
    old = {
        0: ([F2._replace(name="a"), F1._replace(name="b", type=pa.int32())], [["x", None], [1, 2]]),
        1: ([drift.Field(9, "a", pa.int64()), F1._replace(name="z")], [[7, 8], [None, 4]]),
        2: ([F1, F2, F3], [[5], ["q"], [0.5]]),
    }
    os.makedirs(f"{tmp_path}/t")
    for i, (fields, cols) in old.items():
        schema = drift.schema_of(fields)
        pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema), f"{tmp_path}/t/{i}")
    before = os.stat(f"{tmp_path}/t/2").st_mtime_ns
    files = spark.createDataFrame([(i, f"{tmp_path}/t/{i}") for i in old], "file_no long, path string")
    for again in (False, True):
        done = {r.file_no: r.rewritten for r in drift.rewrite(files, 3, f"{tmp_path}/t", [F1, F2, F3]).collect()}
        assert done == ({0: False, 1: False, 2: False} if again else {0: True, 1: True, 2: False})
        assert [pq.read_table(f"{tmp_path}/t/{i}").to_pydict() for i in old] == [{"a": [1, 2], "b": ["x", None], "c": [None, None]}, {"a": [None, 4], "b": ["none", "none"], "c": [None, None]}, {"a": [5], "b": ["q"], "c": [0.5]}]
    assert os.stat(f"{tmp_path}/t/2").st_mtime_ns == before
    for bad in (pa.schema([("a", pa.int64())]), drift.schema_of([F1, F1._replace(name="b")])):
        with pytest.raises(ValueError, match="field id"):
            drift.columns_by_id(bad)


def test_ranks_of_one_hot_key(spark):
    rows = spark.range(5_000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"), "id")
    got, n = drift.ranked(rows, [F.col("k")], "rank")
    got = got.orderBy("rank").collect()
    assert n == 5_000 and [r["rank"] for r in got] == list(range(5_000)) and [r.k for r in got] == sorted(r.k for r in got)


public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def words():
    return planes.Encoder(public.path(planes.TOKENIZER))


ODD = ["", " ", "The cat's  SAT.", "x<|endoftext|>y", "<|ENDOFTEXT|> <|startoftext|>", "don't 'tis' we'll,, a.b ...", "É é ΑΣ İK  x y\x1cz\x85w\xa0v", "日本語 テキスト。 ok", "á̧ ́b", "😀😀 x9y 12a", "\x00 �", "ǅ ǆ ﬁ ²³ Ⅷ ª"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(alphabet=st.one_of(st.sampled_from("abS 'tsld.,\n\t<|>é#1"), st.characters(blacklist_categories=("Cs",))), max_size=40)), max_size=4))
def test_word_ids_as_the_library(words, texts):
    got = [words.encode(t.encode()).tolist() for t in texts]
    assert words.by_word and got == [e.ids for e in words.library.encode_batch(texts, add_special_tokens=False)]


def test_words_are_forgotten(words):
    own = planes.Encoder(public.path(planes.TOKENIZER), most=10)
    for i in range(30):
        text = f"ab{'c' * i} word, x{i} the..."
        assert own.encode(text.encode()).tolist() == own.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [True, False])
@pytest.mark.parametrize("kind", ["<u4", "<i8"])
def test_planes_there_and_back(bits, kind):
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 1000):
        x = rng.integers(-(1 << 40) if kind == "<i8" else 0, 1 << 40 if kind == "<i8" else 1 << 32, n).astype(kind)
        parts = planes.to_planes(x, bits)
        assert len(parts) == x.itemsize * (8 if bits else 1)
        assert planes.from_planes(parts, n, np.dtype(kind), bits).tolist() == x.tolist()


@pytest.mark.parametrize("bits", [True, False])
def test_files_of_planes(bits):
    rng = np.random.default_rng(2)
    docs = [(None, []), (-5, [1, 2, 3]), (1 << 60, rng.integers(0, 1 << 32, 5_000).tolist()), (2, []), *((i, rng.integers(0, 50_000, int(rng.integers(0, 40))).tolist()) for i in range(3, 600))]
    out = io.BytesIO()
    w = planes.Writer(out, 64, bits)
    for i, ids in docs:
        w.add(i, np.array(ids, np.uint32))
    w.close()
    r = planes.Reader(io.BytesIO(out.getvalue()))
    flat = [x for _, ids in docs for x in ids]
    assert (r.n_ids, r.n_docs) == (len(flat), len(docs))
    assert [(i, np.concatenate([np.empty(0), *p]).tolist()) for i, _, p in r.documents()] == docs
    for first, count in [(0, 1), (63, 2), (64, 64), (100, 3_000), (len(flat) - 3, 10), (len(flat), 5)]:
        assert r.span(first, count).tolist() == flat[first : first + count]
    empty = io.BytesIO()
    planes.Writer(empty, 64, bits).close()
    assert list(planes.Reader(io.BytesIO(empty.getvalue())).documents()) == []
    with pytest.raises(ValueError, match="whole"):
        planes.Reader(io.BytesIO(out.getvalue()[:-1]))


def test_token_planes_as_plain_loops(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["the", "Cat", "sat.", "Über", "x1", "...", "日本"], k=rng.randrange(60)))) for i in range(300)]
    rows += [(500, None), (None, "null id"), (7, "again"), (7, "again"), (8, "the " * 40_000), (-3, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_tie": F.lit("x"), "start": F.lit(1), "ID": F.lit(2)})
    frame.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = planes.op13_token_planes(spark, str(tmp_path)).collect()
    library = planes.encoder(public.path(planes.TOKENIZER)).library
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 2]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((i is not None, i or 0, len(x := ids(t)), crc(x)) for i, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])


def test_token_spans_and_texts(spark, tmp_path):
    rows = [(i, f"word{i} and so on " * (i % 5)) for i in range(200)]
    path = public.path(planes.TOKENIZER)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = f"{tmp_path}/t"
    index = planes.write_tokens(frame, folder, path, end=None, block=32, bits=False)
    flat = [x for r in sorted(planes.read_tokens(spark, folder).collect(), key=lambda r: r.start) for x in r.ids]
    library = planes.encoder(path).library
    assert flat == [x for _, t in rows for x in library.encode(t, add_special_tokens=False).ids]
    assert index.agg(F.sum("n_ids"), F.sum("n_docs")).first() == (len(flat), 200)
    spans = [(0, 10), (31, 2), (5, len(flat)), (len(flat) - 1, 9)]
    got = {(r["first"], r["count"]): r.ids for r in planes.read_spans(spark, folder, spark.createDataFrame([(a, b) for a, b in spans], "first long, count long")).select("*").collect()}
    assert got == {(a, b): flat[a : a + b] for a, b in spans}
    planes.write_tokens(frame.limit(0), f"{tmp_path}/none", path)
    assert planes.digests(spark, f"{tmp_path}/none").collect() == []
