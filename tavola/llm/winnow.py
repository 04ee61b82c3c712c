"""Benchmark decontamination by winnowing, in DataFrame operations only.

Texts become arrays of word hashes.  Hashes of ``k`` consecutive words are
formed by doubling; of every ``w`` consecutive ones the least is kept, ties
included.  With ``k + w - 1`` equal to the window, two texts that share a
window share a fingerprint at the same place of it, so every shared span is
found.  Kept fingerprints of documents are joined with the benchmark's; each
match carries the few words around it, is extended word by word, and spans
that hold a whole window go on.  An item shorter than the window is one
fingerprint of all its words, looked for at every place in the same pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import fits_broadcast, materialize
from .tables import table

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits by which the left half turns when two halves of 1, 2, 4 and more words are combined.
_TURNS = {1: 7, 2: 19, 4: 41, 8: 53}


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(WORDS), F.lit(0))


def _slide(df: DataFrame, out: str, src: str, other: str, by: int, f: str) -> DataFrame:
    """Column ``out``: ``f`` of ``x``, an element of ``src``, and ``y``, that of ``other`` which lies ``by`` further on, or null.

    The optimizer merges projections whose columns are used once.  ``src`` may
    be merged (it is computed once a row); ``other`` must be a column that is
    used more often, or it would be computed anew for every element.
    """
    return df.withColumn(out, F.expr(f"transform({src}, (x, i) -> {f.replace('y', f'get({other}, i + {by})')})"))


def _grams(df: DataFrame, sizes: set[int]) -> DataFrame:
    """Columns ``g6`` and so on: the hash of so many words from each word of ``ws`` on, or null."""
    df, size = df.withColumn("p1", F.col("ws")), 1
    while 2 * size <= max(sizes):
        t = _TURNS[size]
        df = _slide(df, f"p{2 * size}", f"p{size}", f"p{size}", size, f"shiftleft(x, {t}) ^ shiftrightunsigned(x, {64 - t}) ^ y")
        size *= 2
    for k in sorted(sizes):
        first = max(s for s in (1, 2, 4, 8) if s <= k)
        df, done = df.withColumn(f"g{k}", F.col(f"p{first}")), first
        while done < k:
            size = max(s for s in (1, 2, 4, 8) if s <= k - done)
            df = _slide(df, f"g{k}", f"g{k}", f"p{size}", done, f"shiftleft(x, {3 + done}) ^ shiftrightunsigned(x, {61 - done}) ^ y")
            done += size
    return df


def _least(g: str, w: int) -> str:
    """Whether the gram at ``at`` is the least of some ``w`` in a row that all lie in the text: as many as that around it are no less."""

    def run(j: int, sign: int) -> str:
        return "0" if j == w else f"if(get({g}, at {'+' if sign > 0 else '-'} {j}) >= get({g}, at), 1 + {run(j + 1, sign)}, 0)"

    return f"{run(1, 1)} + {run(1, -1)} >= {w - 1}"


def _fingerprints(rows: DataFrame, k: int, w: int, whole: list[int] = ()) -> DataFrame:
    """``rows (..., ws)`` once per kept gram, with ``at``, its first word from 0, ``k`` and ``h``.

    ``whole``: lengths of which every gram is kept.  One more row per text has
    ``k`` 0, ``at`` the number of words, and the text's hash ``th`` as ``h``.
    """
    d = _grams(rows, {k, *whole})
    # one place more than there are words: no inner generator over computed arrays, for which the optimizer adds filters that compute all of them again
    d = d.select(*rows.columns, *[f"g{n}" for n in sorted({k, *whole})], F.posexplode(F.concat("ws", F.array(F.lit(None).cast("long")))).alias("at", "_"))
    # a generator, so that what follows reads a row's hash and does not compute it again
    kinds = [f"struct({k} as k, if({_least(f'g{k}', w)}, get(g{k}, at), null) as h)", *(f"struct({n} as k, get(g{n}, at) as h)" for n in whole), "struct(0 as k, if(at = size(ws), th, null) as h)"]
    return d.select(*rows.columns, "at", F.explode(F.expr(f"array({', '.join(kinds)})")).alias("x")).where("x.h is not null").select(*rows.columns, "at", "x.k", "x.h")


def _around(prints: DataFrame, keep: list[str], ws: str, before: str, window: int) -> DataFrame:
    """``keep`` and ``ws``: the words of the text that can be in one window with the gram, and ``before``: how many of them come first."""
    side = f"if(k = 0, 0, {window} - k)"
    return prints.select(*keep, F.expr(f"slice(ws, greatest(at - {side}, 0) + 1, if(k = 0, 0, least(at, {side}) + {window}))").alias(ws), F.expr(f"least(at, {side})").alias(before))


def _bench(items: DataFrame, k: int, w: int, window: int) -> DataFrame:
    """Fingerprints of the items: ``h, k, item_id, ctx, left``; ``ctx``: the words around, of which ``left`` are before.  ``whole`` ones have no words around."""
    hashed = items.select("item_id", F.xxhash64("text").alias("th"), F.transform(_words(F.col("text")), lambda x: F.xxhash64(x)).alias("ws"))
    long = _around(_fingerprints(hashed.where(f"size(ws) >= {window}"), k, w).where("k > 0"), ["h", "k", "item_id"], "ctx", "left", window)
    short = hashed.where(f"size(ws) between 1 and {window - 1}").withColumn("n", F.size("ws"))
    sizes = [n for (n,) in sorted(short.select("n").distinct().collect())]  # fewer than the window has words
    if sizes:
        own = _grams(short, set(sizes))
        first = F.coalesce(*[F.when(F.col("n") == n, F.get(f"g{n}", F.lit(0))) for n in sizes])
        long = long.unionByName(own.select(first.alias("h"), F.col("n").alias("k"), "item_id", F.col("ws").alias("ctx"), F.lit(0).alias("left")))
    return long.distinct()


def _extended(matches: DataFrame, window: int) -> DataFrame:
    """``id, th, from, to, item_id, n_words`` of matches: the equal words around each, which may go beyond it to both sides.

    Where no whole window is equal, ``from``, ``to`` and ``item_id`` are null.
    Rows of ``k`` 0 get ``n_words``.
    """
    d = matches.withColumn("eq", F.expr("transform(ctx, (x, j) -> x <=> get(dctx, dleft - left + j))"))
    stop_l = "array_position(reverse(slice(eq, 1, left)), false)"
    stop_r = "array_position(slice(eq, left + k + 1, size(eq)), false)"
    d = d.withColumn("from", F.expr(f"cast(at - if({stop_l} = 0, left, {stop_l} - 1) as int)")).withColumn("to", F.expr(f"cast(at + k + if({stop_r} = 0, size(eq) - left - k, {stop_r} - 1) as int)"))
    good = F.expr(f"k > 0 and not array_contains(slice(eq, left + 1, k), false) and to - from >= if(size(ctx) = k, k, {window})")
    return d.select("id", "th", F.when(good, F.col("from")).alias("from"), F.when(good, F.col("to")).alias("to"), F.when(good, F.col("item_id")).alias("item_id"), F.expr("if(k = 0, cast(at as bigint), null)").alias("n_words"))


def _by_text(spans: DataFrame) -> DataFrame:
    """Spans, items and number of words of each text, and how many rows have it."""
    return spans.groupBy("id", "th").agg(
        F.max("n_words").alias("n_words"),
        F.count("n_words").alias("rows"),
        F.collect_set(F.when(F.col("from").isNotNull(), F.struct("from", "to"))).alias("s"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, k: int = 6, share: tuple[int, int] = (1, 20), broadcast_bytes: int = 8 << 20) -> DataFrame:
    """``id, th, n_words, n_hit, items (sorted as strings), contaminated`` per row of ``docs``.

    ``items`` has ``item_id`` and ``text``.  A word of a document is hit if it
    lies in an occurrence of ``window`` consecutive words of an item, or of
    all words of a shorter item.  Contaminated: some word is hit, and hits are
    at least ``share`` of all words.  Items without id hit words, too, but are
    not listed.  Null and empty texts have no words and match nothing;
    repeated rows, and rows without id, are judged like any other; without
    items nothing is hit.  ``th`` hashes the text and tells rows of one id
    apart.  The join broadcasts the items' fingerprints up to
    ``broadcast_bytes`` of them on disk; beyond that both sides are shuffled.
    """
    w = window - k + 1
    bench = materialize(_bench(items, k, w, window), "bench")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.transform(_words(text), lambda x: F.xxhash64(x)).alias("ws"))
    whole = [n for (n,) in sorted(bench.where("size(ctx) = k").select("k").distinct().collect())]
    prints = _around(_fingerprints(rows, k, w, whole), ["id", "th", "at", "k", "h"], "dctx", "dleft", window)
    side = F.broadcast(bench) if fits_broadcast(bench, broadcast_bytes) else bench
    found = prints.join(side, ["h", "k"], "left").where("k = 0 or left is not null")
    spans = _extended(found, window)
    covered = "aggregate(array_sort(s), named_struct('n', 0L, 'e', 0), (a, x) -> named_struct('n', a.n + greatest(x.to - greatest(x.from, a.e), 0), 'e', greatest(a.e, x.to)), a -> a.n)"
    out = _by_text(spans).withColumn("n_hit", F.expr(covered))
    out = out.withColumn("contaminated", F.expr(f"n_hit > 0 and {share[1]} * n_hit >= {share[0]} * n_words"))
    # rows that are equal in id and text were counted together
    return out.select("id", "th", "n_words", "n_hit", "items", "contaminated", F.explode(F.expr("array_repeat(0, cast(rows as int))")).alias("_")).drop("_")


def decontaminate(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``docs (doc_id, text, ...)`` without contaminated rows."""
    bad = contamination(docs, items, **how).where("contaminated").select(F.col("id").alias("bad_id"), "th").distinct()
    bad = materialize(bad, "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["th"]), "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of all documents."""
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bg AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bg),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, dg.n FROM dg JOIN bg ON dg.g = bg.g AND dg.n = bg.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLE = {"op3_decontaminate": _SQL}
