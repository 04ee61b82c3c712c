"""Alignment of two tokenizers, against whole texts tokenised one by one."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tavola.llm import align

public = pytest.importorskip("public_tokenizers")
PATHS = public.path(align.TOKENIZER_A), public.path(align.TOKENIZER_B)


@pytest.fixture(scope="module")
def own():
    return align.tokenizers(*PATHS)


def whole(own, text):
    """Groups of one text, by both libraries over the text as a whole; None without tokens."""
    if not text:
        return None
    a, b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
    want = (" " + text).encode()
    if b"".join(own.a_bytes[i] for i in a) != want or b"".join(own.b_bytes[i] for i in b) != want:
        return None
    out, i, j, x, y = [], 0, 0, 0, 0
    ga, gb = [], []
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            ga.append(a[i])
            x += len(own.a_bytes[a[i]])
            i += 1
        else:
            gb.append(b[j])
            y += len(own.b_bytes[b[j]])
            j += 1
        if x == y and ga and gb:
            out.append((ga, gb))
            ga, gb = [], []
    return out


def expected(own, rows):
    docs = [(i, whole(own, t)) for i, t in rows]
    links = [[(a, b) for ga, gb in g or () for a in ga for b in gb] for _, g in docs]
    count = collections.Counter(p for x in links for p in set(x))
    most = collections.defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (i, g), x in zip(docs, links, strict=True):
        text = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in g or ())
        sha = hashlib.sha256(text.encode()).hexdigest() if g else ""
        out.append((i, sum(len(ga) for ga, _ in g or ()), sum(len(gb) for _, gb in g or ()), len(g or ()), len(x), sum(count[p] == most[p[0]] for p in x), sum(count[p] for p in x), sha))
    return out


def key(r):
    return tuple((x is not None, x if x is not None else 0) for x in r)


WORDS = ["the", "Cat", "sat.", "Über", "x1=1234", "...", "日本語", "don't", "😀", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "antidisestablishment", "__init__", "});", "ﬁ", "É", "\x00"]
GAPS = [" ", " ", " ", "  ", "   ", "\n", "\n\n", "\r\n", "\t", " \n ", "\xa0", "\xa0 ", " \xa0", "\x1c", "　", "\v", "\f ", "᠎ "]


def prose(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice(GAPS) for _ in range(n))


def test_documents_as_plain_loops(spark, own, tmp_path):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randrange(80))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " "), (203, "\n"), (204, "  a  "), (205, "has ▁ meta"), (None, "no id here"), (3, "again " * 30), (3, "again " * 30), (206, "x" * 30_000), (207, "= " + "=" * 20_001 + "-" * 3_001), (208, "日本" * 4_000), (209, "word " * 60_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"chunk": F.lit("x"), "segment": F.lit(1), "groups": F.lit(2)}).repartition(5)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(expected(own, rows), key=key)
    got = align.op12_token_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == want
    small = align.align(frame, *PATHS, chunk_bytes=500)  # many chunks
    sha = small.withColumn("groups", F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise(""))
    assert sorted(map(tuple, sha.collect()), key=key) == want


def test_no_documents(spark):
    for rows in ([], [(1, None), (2, "")], [(1, "▁")]):
        got = align.align(spark.createDataFrame(rows, "doc_id long, text string"), *PATHS).collect()
        assert sorted(map(tuple, got)) == [(i, 0, 0, 0, 0, 0, 0, "") for i, _ in rows]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab Zé.=-1 \n\t\r\v\f\xa0\x1c\x85 's日▁😀<>_"), st.characters(blacklist_categories=("Cs",))), max_size=60))
def test_segments_compose(own, text):
    if not text:
        return
    parts = own.segments(text)
    assert "".join(parts) == " " + text
    a, b = own.encode(parts)
    assert [i for x in a for i in x] == own.a.encode(" " + text, add_special_tokens=False).ids
    if "▁" not in text:
        assert [i for x in b for i in x] == own.b.encode(text)


def test_large_groups(own, monkeypatch):
    """Groups counted by distinct ids and those counted link by link agree."""
    parts = [" " + "ab=#" * k + "日😀x" * k for k in range(1, 12)] + [" word", "\nline", " "]
    ok, found = align.align_texts(own, parts)
    assert ok.all()
    one = found.pairs()
    monkeypatch.setattr(align, "_LARGE", 0)
    assert all(np.array_equal(x, y) for x, y in zip(one, found.pairs(), strict=True))
    assert found.totals()[3].sum() == one[2].sum()


def test_packed_and_back(own):
    parts = [" word", " " + "日本" * 50, "\n", " x1=1234"]
    _, found = align.align_texts(own, parts)
    found.count_a[0] += 300  # as if a group had so many ids that its numbers are wide
    found.ids_a = np.concatenate([np.arange(300), found.ids_a])
    back = align.Groups.unpacked(align.Groups(found.groups, found.count_a, found.count_b, found.ids_a, found.ids_b).packed())
    for c in ("groups", "count_a", "count_b", "ids_a", "ids_b"):
        assert np.array_equal(getattr(back, c), getattr(found, c)), c
    assert align.Groups.unpacked([]).texts() == [] and align.Groups.unpacked([bytes(4)]).texts() == [""]


def test_white_space_of_the_library(own):
    """Every character that A's pre-tokenizer takes for white space is one to the cuts, too."""
    for c in [*range(0xD800), *range(0xE000, 0x30000)]:
        x = chr(c)
        if not re.match(r"\s", x) and len(own.a.pre_tokenizer.pre_tokenize_str(f"{x}{x}b")) == 3:
            assert len(own.a.pre_tokenizer.pre_tokenize_str(x + x)) == 2, hex(c)


def test_small_flushes(spark, own):
    """Entries that come in many rows per chunk, and segments that go on over batches, give the same."""
    rng = random.Random(11)
    segments = [f" w{i}" for i in range(40)] + [" ▁", "\n日本", " "]
    rows = [((c << align._BITS) + i, s) for c in (0, 5, (3 << 16) + 1) for i, s in enumerate(rng.sample(segments, 30))]
    entries = spark.createDataFrame(rows, "entry long, segment string")
    found = {}
    for r in align.align_segments(entries, *PATHS, batch=3, most=7).groupBy("of").agg(F.collect_list(F.struct("n", "data")).alias("x")).collect():
        found[r.of] = align._opened([x.n for x in r.x], [bytes(x.data) for x in r.x])
    for c in {e >> align._BITS for e, _ in rows}:
        parts = [s for e, s in rows if e >> align._BITS == c]
        ok, groups = align.align_texts(own, parts)
        assert found[c] == [p if good else b"" for p, good in zip(groups.packed(), ok, strict=True)]


def test_holders_in_slices():
    rng = np.random.default_rng(3)
    for most in (1, 5, 1 << 19):
        size = rng.integers(0, 4, 12)
        start = np.concatenate([[0], np.cumsum(size)])
        pair = rng.integers(0, 6, int(size.sum()))
        held = sorted({(int(d), int(s)) for d, s in rng.integers(0, [9, 12], (40, 2))})
        doc, seg = np.array(held).T
        want = collections.Counter(p for d in set(doc.tolist()) for p in {int(x) for e, s in held if e == d for x in pair[start[s] : start[s + 1]]})
        assert align._holders(doc, seg, size, start, pair, 6, most).tolist() == [want[p] for p in range(6)]
