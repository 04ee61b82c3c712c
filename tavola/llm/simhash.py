"""SimHash near-duplicates: pigeonhole blocks, then Hamming verification.

Fingerprints are made in one pass over whole texts (Arrow batches, numpy).  Of
each distinct fingerprint one row goes on, so exact copies cost nothing
further.  A pair within ``distance`` bits differs in at most ``distance`` of
the ``blocks`` blocks, so it agrees on some set of ``blocks - distance`` of
them: every such set is a key, and only fingerprints that share a key are
compared.  Keys of more than ``chunk`` fingerprints are dealt out as pairs of
chunks, so a task holds two chunks at most; of a large group only a spanning
forest of its links is emitted, which has the same components.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .storage import in_small_batches, materialize
from .tables import dealt_anew, table

_hash = partial(xxhash.xxh64_intdigest, seed=42)
_SLICE = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64 bits of one text as a signed number; 0 if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = np.array([_hash(b" ".join(words))], np.uint64)
    else:
        n = len(words) - shingle + 1
        hashes = np.fromiter(map(_hash, map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _SLICE):
        part = hashes[i : i + _SLICE].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp, th)`` of each row, whatever other columns ``docs`` has; a null text has no words. ``th`` hashes the text."""

    def run(batches):
        for b in batches:
            fp = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), b.column(2)], names=["id", "fp", "th"])

    text = F.col(text_col).cast("string")
    d = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"), F.xxhash64(text).alias("th"))
    return in_small_batches(d).mapInArrow(run, "id long, fp long, th long")


def _masks(blocks: int, distance: int) -> list[int]:
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    part = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    out = []
    for chosen in combinations(range(blocks), blocks - distance):
        m = sum(part[i] for i in chosen)
        out.append(m - (1 << 64) if m >= 1 << 63 else m)
    return out


def _forest(fp: np.ndarray, side: np.ndarray | None, distance: int) -> tuple[list, list]:
    """A spanning forest of the links in one group, as indexes; ``side``: compare all, whichever chunk they are of."""
    left, right = [], []
    rest = np.arange(len(fp))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(fp[rest] ^ fp[at]) <= distance
            if near.any():
                found = rest[near]
                rest = rest[~near]
                left += [at] * len(found)
                right += found.tolist()
                queue += found.tolist()
    return left, right


def _links_of(run: np.ndarray, fp: np.ndarray, node: np.ndarray, distance: int, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the runs of equal ``run``."""
    fp = fp.view(np.uint64)  # of a signed number numpy counts the bits of the absolute value
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    size = np.diff(np.r_[starts, len(run)])
    a, b = [], []
    width = np.repeat(size, size)
    few = np.flatnonzero(width <= small)
    for d in range(1, small):
        i = few[few + d < len(run)]
        i = i[run[i] == run[i + d]]
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= distance]
        a.append(node[i])
        b.append(node[i + d])
    for s, n in zip(starts[size > small], size[size > small], strict=True):
        left, right = _forest(fp[s : s + n], None, distance)
        a.append(node[s : s + n][left])
        b.append(node[s : s + n][right])
    return (np.concatenate(a), np.concatenate(b)) if a else (node[:0], node[:0])


def links(nodes: DataFrame, distance: int = 3, blocks: int = 5, chunk: int = 2048) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints of ``nodes (fp, node)``, neither of them null, that span the components of all links.  No nodes, no links."""
    masks = _masks(blocks, distance)
    keyed = nodes.select("fp", "node", F.explode(F.array(*[F.struct(F.lit(i).alias("j"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("x")).select("fp", "node", "x.j", "x.key")
    shared = keyed.groupBy("j", "key").agg(F.count("*").alias("n")).where("n > 1")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = (
        keyed.join(shared, ["j", "key"])
        .withColumn("parts", F.ceil(F.col("n") / F.lit(chunk)).cast("int"))
        .withColumn("own", own)
        .select("fp", "node", "j", "key", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        .select("fp", "node", F.xxhash64("j", "key", F.least("own", "other"), F.greatest("own", "other")).alias("run"))
    )

    def run(batches):
        tail: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            cols = [np.asarray(b.column(i)) for i in range(3)]
            if tail:
                cols = [np.concatenate(x) for x in zip(tail, cols, strict=True)]
            cut = int(np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])[-1])
            tail = [c[cut:] for c in cols]
            if cut:
                x, y = _links_of(*(c[:cut] for c in cols), distance)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
        if tail:
            x, y = _links_of(*tail, distance)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return dealt.select("run", "fp", "node").repartition("run").sortWithinPartitions("run").mapInArrow(run, "a long, b long").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, blocks: int = 5) -> DataFrame:
    """``(id, fp, th, component, root)`` per row of ``docs``: texts whose fingerprints differ in ``distance`` bits or fewer are linked.

    ``component`` is the least id that links reach, the row's own included;
    ``root`` names the component by a fingerprint.  Texts without words (null,
    empty) have fingerprint 0 and link like others.  Repeated rows stay
    repeated.  Rows without id link like others; the component is null if no
    row of it has an id.  Different texts under one id are linked only if
    their fingerprints are.  Ids are integers, or texts of such.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("id").alias("least")), "nodes", fps.count())
    found = connected_components(links(nodes.select("fp", F.col("fp").alias("node")), distance, blocks), "a", "b")
    linked = found.select(F.col("node").alias("fp"), F.col("component").alias("root")).join(nodes, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("n"))
    linked = linked.join(dealt_anew(least, ["root"], "n"), "root").select("fp", "root", "component")
    label = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"), F.coalesce("root", "fp").alias("root"))
    label = materialize(label, "labels", nodes.count())  # dealt out anew for the join, which can then split the rows of one fingerprint
    return fps.join(label, "fp").select("id", "fp", "th", "component", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates of ``docs (doc_id, text, ...)``: that of the least ``doc_id``, one without id only if all are.

    Of different texts under that ``doc_id`` the one with the least hash
    stays, of wholly equal rows one.
    """
    rows = materialize(near_duplicates(docs), "classes")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("x"), F.count("*").alias("n"))
    kept = materialize(first.select("x.id", "x.th", "n"), "kept", rows.count())
    same = docs["doc_id"].cast("long").eqNullSafe(kept["id"]) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(kept["th"])
    chosen = docs.join(kept.select("id", "th"), same, "left_semi")
    if not rows.groupBy("id", "th").count().where("count > 1").isEmpty():
        chosen = chosen.dropDuplicates(["doc_id", "text"])
    return chosen


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of all documents."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op5_simhash": op5_simhash}
ORACLE: dict[str, str] = {}
