"""Removal of repeated line runs with a distributed suffix array, in DataFrame operations only.

The corpus is one sequence of line ids (lines without a word left out), each
document ended by its own sentinel.  Ranks of the blocks of 1, 2, 4, ... lines
that begin at a suffix come from prefix doubling with discarding: a suffix
whose block is unique is final, is in no longer repeat, and is dropped; the
others are ranked by a range-partitioned sort of distinct pairs of ranks.

A repeat counts if it has ``min_words`` words.  The suffixes that share their
first lines up to that many words are the interval of the suffix array whose
longest common prefix reaches so far; two overlapping ranks name it.  Intervals
of the blocks that end at a line (the same, read backwards) find the tail of a
run.  All members but the earliest of an interval are later copies; together
their blocks are exactly the maximal runs, of ``min_words`` or more, that also
occur earlier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import materialize
from .tables import dealt_anew, free, table

_WORD = r"[^\x20\x09-\x0D]+"
_FIRST = -(1 << 63)
_AT = ["o", "th", "i"]


def _order(id_col: str):
    """Rows without id come before all others."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST))


def _sequence(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``o, th, i, h1, h2, n``: the lines with words of each text, numbered from 0, their 128-bit id and number of words."""
    text = F.col(text_col).cast("string")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.where(text.isNotNull()).select(_order(id_col).alias("o"), F.xxhash64(text).alias("th"), F.posexplode(lines).alias("i", "line"))
    return out.select(*_AT, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.size(F.regexp_extract_all("line", F.lit(_WORD), F.lit(0))).cast("long").alias("n"))


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by`` values that occur twice or more, with a rank ``r`` in their order.

    For one use only: another run may give other ranks.
    """
    twice = rows.groupBy(*by).agg(F.count("*").alias("c")).where("c > 1").drop("c")
    return twice.orderBy(*by).select(*by, F.monotonically_increasing_id().alias("r"))


def _candidates(seq: DataFrame, min_words: int) -> DataFrame:
    """``o, th, i, n, r, fore, back``: repeated lines in unbroken rows of such with ``min_words`` words in all.

    ``fore`` lines from ``i`` on, and ``back`` lines up to ``i``, are the
    fewest that have ``min_words`` words; null where the row ends before.
    """
    a = seq.join(_ranked(seq, ["h1", "h2"]), ["h1", "h2"]).select(*_AT, "n", "r").distinct()
    doc = Window.partitionBy("o", "th").orderBy("i")
    a = a.withColumn("row", F.col("i") - F.row_number().over(doc))
    own = Window.partitionBy("o", "th", "row")
    a = a.withColumn("till", F.sum("n").over(own.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(own)).where(F.col("all") >= min_words)
    a = a.withColumn("base", F.col("till") - F.col("n"))
    fore = F.count("*").over(own.orderBy("base").rangeBetween(0, min_words - 1))
    back = F.count("*").over(own.orderBy("till").rangeBetween(-(min_words - 1), 0))
    return a.select(*_AT, "n", "r", F.when(F.col("base") + min_words <= F.col("all"), fore).cast("int").alias("fore"), F.when(F.col("till") >= min_words, back).cast("int").alias("back"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """``o, th, i, m``: blocks of ``m`` lines from line ``i`` on that are later copies; they overlap and cover all such runs.

    ``o`` is the id (the least number for null), ``th`` hashes the text.  The
    earliest copy, by ``o``, ``th`` and line, is not among them.  Rows equal
    in id and text are one document.  Ids are integers, or texts of such.
    Null texts have no lines; an empty table has no runs.
    """
    seq = materialize(_sequence(docs, id_col, text_col), "lines")
    cand = materialize(_candidates(seq, min_words), "candidates", seq.count())
    blocks = cand.where("fore is not null").select(*_AT, F.col("fore").alias("m")).unionByName(cand.where("back is not null").select("o", "th", F.expr("cast(i - back + 1 as int)").alias("i"), F.col("back").alias("m"))).distinct()
    most, have = cand.agg(F.max(F.greatest("fore", "back")), F.count("*")).first()
    if not most:
        return blocks
    level, left = cand.select(*_AT, "r"), have
    named, k = None, 0
    while (1 << k) <= most:
        size = 1 << k
        if k:  # ranks of blocks of twice as many lines, for suffixes that are not final
            half = size >> 1
            after = level.select("o", "th", (F.col("i") - half).alias("i"), F.col("r").alias("r2"))
            pairs = level.withColumnRenamed("r", "r1").join(after, _AT)
            level = materialize(pairs.join(_ranked(pairs, ["r1", "r2"]), ["r1", "r2"]).select(*_AT, "r"), f"suffixes-{size}", left)
            left = level.count()
        here = blocks.where(f"m >= {size} and m < {2 * size}")
        part = here.join(level.withColumnRenamed("r", "ra"), _AT)
        tail = level.select("o", "th", F.col("i").alias("j"), F.col("r").alias("rb"))
        part = part.withColumn("j", (F.col("i") + F.col("m") - size).cast("int")).join(tail, ["o", "th", "j"]).drop("j")
        part = materialize(part, f"blocks-{size}", 2 * have)  # level by level: one plan of all joins is large for the driver
        named = part if named is None else named.unionByName(part)
        k += 1
    first = named.groupBy("m", "ra", "rb").agg(F.min(F.struct(*_AT)).alias("first"), F.count("*").alias("c")).where("c > 1")
    return named.join(dealt_anew(first, ["m", "ra", "rb"], "c"), ["m", "ra", "rb"]).where(F.struct(*_AT) > F.col("first")).select(*_AT, "m")


def _merged(runs: DataFrame) -> DataFrame:
    """``o, th, gone``: the lines in any of the runs, as ascending numbers, each once."""
    doc = Window.partitionBy("o", "th").orderBy("i", "m")
    end = F.max(F.col("i") + F.col("m")).over(doc.rowsBetween(Window.unboundedPreceding, -1))
    r = runs.withColumn("new", F.when(F.col("i") <= end, 0).otherwise(1))
    r = r.withColumn("g", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    spans = r.groupBy("o", "th", "g").agg(F.min("i").alias("a"), F.max(F.col("i") + F.col("m")).alias("b"))
    spans = spans.groupBy("o", "th").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("s"))
    return spans.select("o", "th", F.expr("flatten(transform(s, x -> sequence(x.a, x.b - 1)))").alias("gone"))


def _once(col: Column) -> Column:
    """``col``, computed once a row: the optimizer neither merges such a projection into the next nor pushes filters below it.

    Merged, it would be computed anew for every element of an array that a
    lambda function runs over.  The condition always holds.
    """
    return F.when(F.monotonically_increasing_id() >= 0, col)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with later copies of line runs deleted from its text, and ``counts``: ``n_lines, n_removed`` (replaced if there).

    ``n_lines`` counts the lines of the text that came in, ``n_removed`` those
    deleted.  Lines without words stay.  A null text stays null and has no
    lines.  A text that is not touched is returned as it is.
    """
    keep = [c for c in docs.columns if c not in counts]
    o, th, gone, ls, w, left = (free(x, keep) for x in ("o", "th", "gone", "ls", "w", "left"))
    found = _merged(repeated_runs(docs, id_col, text_col, min_words))
    found = found.select(F.col("o").alias(o), F.col("th").alias(th), F.col("gone").alias(gone))
    text = F.col(text_col).cast("string")
    d = docs.select(*keep).join(found, (_order(id_col) == F.col(o)) & (F.xxhash64(text) == F.col(th)), "left")
    d = d.withColumn(ls, _once(F.split(text, "\n", -1)))
    worded = F.expr(rf"filter(sequence(0, size(`{ls}`) - 1), p -> get(`{ls}`, p) rlike '[^\\x20\\x09-\\x0D]')")
    d = d.withColumn(w, _once(F.when(F.col(gone).isNotNull(), worded)))
    rest = F.expr(f"array_except(sequence(0, size(`{ls}`) - 1), transform(`{gone}`, k -> get(`{w}`, k)))")
    d = d.withColumn(left, _once(F.when(F.col(gone).isNotNull(), rest)))
    new = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(F.transform(left, lambda p: F.get(ls, p)), "\n"))
    return d.select(
        *[new.alias(c) if c == text_col else F.col(c) for c in keep],
        F.coalesce(F.when(text.isNotNull(), F.size(ls)), F.lit(0)).cast("long").alias(counts[0]),
        F.coalesce(F.size(ls) - F.size(left), F.lit(0)).cast("long").alias(counts[1]),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs (doc_id, text, ...)`` after line dedup; ``n_chars``, if there, is brought up to date, and rows of which nothing but white space is left go."""
    counts = free("lines", docs.columns), free("removed", docs.columns)
    d, removed = dedup_lines(docs, counts=counts), F.col(counts[1])
    d = d.where(~((removed > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(removed > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return d.select(*docs.columns)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_lines, n_removed, text_sha256`` (of the text that is left) of all documents."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


_SQL = r"""
WITH l AS (SELECT doc_id, p, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS p FROM documents)),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i, sum(n) OVER (PARTITION BY doc_id ORDER BY p) AS c FROM l WHERE n > 0),
fore AS (SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 49 AND b.c - a.c + a.n >= 50 GROUP BY ALL),
back AS (SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.i BETWEEN b.i - 49 AND b.i AND b.c - a.c + a.n >= 50 GROUP BY b.doc_id, b.i),
arr AS (SELECT doc_id, list(line ORDER BY i) AS a FROM w GROUP BY doc_id),
blk AS (SELECT x.doc_id, s, e, array_to_string(a[s:e], chr(10)) AS t FROM (SELECT * FROM fore UNION SELECT doc_id, s, e FROM back) x JOIN arr USING (doc_id)),
late AS (SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS rn FROM blk) WHERE rn > 1),
gone AS (SELECT DISTINCT w.doc_id, w.p FROM late JOIN w ON late.doc_id = w.doc_id AND w.i BETWEEN late.s AND late.e),
rest AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.p) AS t FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.p = l.p WHERE g.p IS NULL GROUP BY l.doc_id),
cnt AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(c, 0) AS BIGINT) AS n_removed, sha256(CASE WHEN c IS NULL THEN coalesce(d.text, '') ELSE coalesce(t, '') END) AS text_sha256
FROM documents d LEFT JOIN cnt USING (doc_id) LEFT JOIN rest USING (doc_id)
"""

QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLE = {"op2_line_dedup": _SQL}
