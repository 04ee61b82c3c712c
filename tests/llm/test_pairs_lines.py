"""SimHash, components, line runs and winnowing against brute force, with awkward rows."""

import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tavola.llm import components, lines, simhash, winnow
from tavola.llm.tables import dealt_anew

WORDS = ["the", "of", "and", "in", "ab", "cd", "ef", "gh", "Über", "naïve"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS).repartition(3)


def closure(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(df, "a", "b").collect()}
    want = closure(200, edges)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: want[x] for x in linked}
    assert components.connected_components(df.limit(0), "a", "b").count() == 0


def test_totals_are_dealt_anew(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("k"))
    totals = rows.groupBy("k").agg(F.count("*").alias("n"))
    out = rows.hint("merge").join(dealt_anew(totals, ["k"], "n"), "k")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3  # for the totals, and for either side of the join
    assert out.agg(F.sum("n")).first()[0] == 34 * 34 + 2 * 33 * 33


def brute_fp(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    c = Counter(b for s in sh for b in range(64) if xxhash.xxh64_intdigest(s, seed=42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * c[b] > len(sh))


def test_simhash_against_brute_force(spark):
    rng = random.Random(2)
    base = [rng.choices(WORDS + [f"w{i}" for i in range(200)], k=80) for _ in range(12)]
    texts = [None, "", " \n", "one", "two words", "A b  C"]
    for b in base:
        for _ in range(6):
            t = list(b)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = "x" + str(rng.randrange(9))
            texts.append(" ".join(t))
    texts += texts[6:9] + ["a" * 50_000, "q r s " * 20_000]
    fps = [brute_fp(t) for t in texts]
    want = closure(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    got = simhash.near_duplicates(frame(spark, texts)).collect()
    assert {r.id: (r.fp % (1 << 64), r.component) for r in got} == {i: (fps[i], want[i]) for i in range(len(texts))}
    kept = simhash.keep_one(frame(spark, texts))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r.doc_id for r in kept.collect()} == set(want)


def test_simhash_dense_groups_in_chunks(spark):
    rng = random.Random(3)
    fps = {0}
    while len(fps) < 400:
        fps.add(rng.choice(tuple(fps)) ^ (1 << rng.randrange(64)))
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame(list(zip(fps, range(400), strict=True)), "fp long, node long")
    pairs = simhash.links(nodes, chunk=16)
    comp = {r.node: r.component for r in components.connected_components(pairs, "a", "b").collect()}
    want = closure(400, [(i, j) for i in range(400) for j in range(i) if ((fps[i] ^ fps[j]) % (1 << 64)).bit_count() <= 3])
    assert comp == {i: want[i] for i in range(400)}
    bits = {i: fps[i] % (1 << 64) for i in range(400)}
    assert all((bits[r.a] ^ bits[r.b]).bit_count() <= 3 for r in pairs.collect())


def test_simhash_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(7, "a b c d", "x"), (7, "a b c d", "x"), (None, "a b c d", "x"), (7, "other words here now", "y")], "doc_id long, text string, component string")
    kept = sorted(r.text for r in simhash.keep_one(df).collect())
    assert kept == ["a b c d", "other words here now"]  # different texts under one id are not linked; the copy without id goes
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_simhash_links_through_rows_without_id(spark, monkeypatch):
    fps = {"a": 0, "b": 0b111, "c": 0b111111, "d": 0xFFFF << 40}  # a and c are linked by b alone
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs.select(F.col("doc_id").alias("id"), F.element_at(F.create_map(*[F.lit(x) for kv in fps.items() for x in kv]), F.col("text")).cast("long").alias("fp"), F.xxhash64("text").alias("th")))
    df = spark.createDataFrame([(5, "a"), (None, "b"), (3, "c"), (None, "d"), (None, "d")], "doc_id long, text string")
    got = sorted((r.fp, r.component) for r in simhash.near_duplicates(df).collect())
    assert got == [(0, 3), (7, 3), (63, 3), (0xFFFF << 40, None), (0xFFFF << 40, None)]
    assert sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(df).collect()) == [(0, "d"), (3, "c")]


def brute_lines(texts, least=50):
    seq = []
    for d, t in enumerate(texts):
        rows = [(p, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for p, x in enumerate((t or "").split("\n"))] if t is not None else []
        seq.append([r for r in rows if r[2]])
    first, gone = {}, [set() for _ in texts]
    for d, rows in enumerate(seq):  # every run of every length, by brute force
        for i in range(len(rows)):
            for j in range(i + 1, len(rows) + 1):
                run = tuple(r[1] for r in rows[i:j])
                if first.setdefault(run, (d, i)) < (d, i) and sum(r[2] for r in rows[i:j]) >= least:
                    gone[d].update(r[0] for r in rows[i:j])
    return ["\n".join(x for p, x in enumerate(t.split("\n")) if p not in g) if t is not None else None for t, g in zip(texts, gone, strict=True)]


def test_line_runs_against_brute_force(spark):
    rng = random.Random(4)
    pool = [" ".join(rng.choices(WORDS, k=rng.choice([1, 3, 8, 20, 60]))) for _ in range(12)]
    texts = ["\n".join(rng.choice([*pool, "", "  "]) for _ in range(rng.randint(0, 14))) for _ in range(40)]
    texts += [None, "", "\n\n", texts[3], texts[3], "\n".join([pool[0]] * 30), "w " * 30_000]
    got = {r.doc_id: r.text for r in lines.dedup_lines(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts)


def test_line_dedup_extra_columns_and_repeats(spark):
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, long, 5, 1), (1, long, 5, 1), (2, long + "\nend", 6, 2), (3, long, 7, 3), (None, "x", 1, 4)], "doc_id long, text string, n_chars long, th long")
    clash = df.withColumns({c: F.lit(c) for c in ("_w", "_left", "_o", "_gone", "_ls", "n_lines")})
    assert {(r._w, r._left, r._o, r._gone, r._ls) for r in lines.dedup_lines(clash).collect()} == {("_w", "_left", "_o", "_gone", "_ls")}
    out = {(r.doc_id, r.n_removed): r.text for r in lines.dedup_lines(df).collect()}
    assert out[(1, 0)] == long and out[(2, 1)] == "end" and out[(3, 1)] == "" and out[(None, 0)] == "x"
    named = lines.without_copies(df.withColumns({"n_lines": F.lit(-1), "n_removed": F.lit(-2), "_lines": F.lit(-3)}))
    assert {(r.n_lines, r.n_removed, r._lines) for r in named.collect()} == {(-1, -2, -3)}
    left = lines.without_copies(df)
    assert left.columns == df.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 1, 2]
    assert [r.n_chars for r in left.where("doc_id = 2").collect()] == [3]
    assert lines.dedup_lines(df.limit(0)).count() == 0


def brute_hits(texts, items, n=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    win = defaultdict(set)
    for k, t in items:
        w = low(t)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            win[tuple(w[i : i + size])].add(str(k))
    sizes = {len(x) for x in win}
    out = []
    for t in texts:
        w, hit, got = low(t), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in win:
                    hit.update(range(i, i + size))
                    got |= win[tuple(w[i : i + size])]
        out.append((len(w), len(hit), sorted(got), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("small", [True, False])
def test_winnowing_against_brute_force(spark, small):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices(WORDS[:6], k=rng.choice([14, 20, 40])))) for i in range(6)] + [(20, "the of-and IN ab"), (21, "naïve"), (22, "the " * 15), (23, None), (24, "..."), (25, "a1 b2 c3 d4 e5 f6 g7 h8 i9 j0 k1 l2 m3")]
    texts = [None, "", "...", "the of and in ab", "Naïve? NAÏVE", "the " * 40]
    for _ in range(50):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = (rng.choice(items)[1] or "").split()
            i = rng.randrange(len(w) + 1)
            parts += w[i : i + rng.randint(0, 30)] + rng.choices(WORDS[:4], k=rng.randint(0, 30))
        texts.append(" ".join(parts).upper() if rng.random() < 0.3 else ", ".join(parts))
    texts += [texts[10], "x y " * 20_000 + items[0][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    how = {} if small else {"broadcast_bytes": 0}
    got = {r.id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in winnow.contamination(frame(spark, texts), bench, **how).collect()}
    assert [got[i] for i in range(len(texts))] == brute_hits(texts, items)


def test_winnowing_rows(spark):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")
    bad = " ".join(f"W{i}" for i in range(15))
    df = spark.createDataFrame([(1, bad, 0), (1, bad, 0), (1, "clean text", 0), (None, bad, 0), (None, "fine", 0)], "doc_id long, text string, th long")
    assert winnow.contamination(df, bench).count() == 5
    left = winnow.decontaminate(df, bench)
    assert left.columns == df.columns and sorted(r.text for r in left.collect()) == ["clean text", "fine"]
    assert winnow.contamination(df.limit(0), bench).count() == 0
    assert winnow.contamination(df, bench.limit(0)).where(F.col("n_hit") > 0).count() == 0


def test_items_without_id_hit(spark):
    bench = spark.createDataFrame([(None, " ".join(f"w{i}" for i in range(20))), (None, "short item"), (3, "w1 w2")], "item_id long, text string")
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(2, 17))), (2, "a short item here"), (3, "W1 w2")], "doc_id long, text string")
    got = {r.id: (r.n_hit, list(r["items"]), r.contaminated) for r in winnow.contamination(df, bench).collect()}
    assert got == {1: (15, [], True), 2: (2, [], True), 3: (2, ["3"], True)}
    assert winnow.decontaminate(df, bench).count() == 0


def test_both_sides_are_winnowed(spark):
    """Of a text's grams only the least of eight in a row go on, by brute force over the hashes."""
    rng = random.Random(6)
    words = [rng.choices(WORDS, k=n) for n in (0, 5, 12, 13, 14, 60, 200)]
    rows = spark.createDataFrame([(i, i, [hash(w) % (1 << 40) for w in x]) for i, x in enumerate(words)], "id long, th long, ws array<long>")
    got = defaultdict(set)
    for r in winnow._fingerprints(rows, 6, 8).where("k > 0").collect():
        got[r.id].add((r.at, r.h))
    for r in winnow._fingerprints(rows, 6, 8, [6]).where("k > 0").select("id", "at", "h").distinct().groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "h"))).alias("g")).collect():
        g = [x.h for x in r.g]
        least = {(i, g[i]) for a in range(len(g) - 7) for i in range(a, a + 8) if g[i] == min(g[a : a + 8])}
        assert got[r.id] == least
