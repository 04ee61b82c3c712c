"""Which keys of a large table a text contains, by automata over shards of the table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HITS = pa.schema([("low", pa.string()), ("exact", pa.bool_()), ("ordinal", pa.int64()), ("key", pa.string()), ("canonical", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(kind, text, ordinal, canonical)``: all keys (kind 0) first, which make an automaton, then texts, each with the first of the keys that it is or contains."""
    import ahocorasick

    automaton, ready = ahocorasick.Automaton(), False
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for kind, text, ordinal, canonical in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if kind == 0:
                had = automaton.get(text, None)
                if had is None or (ordinal, canonical) < (had[0], had[2]):
                    automaton.add_word(text, (ordinal, text, canonical))
                continue
            if not ready:
                ready = True
                automaton.make_automaton()
            if not len(automaton):
                continue
            best = automaton.get(text, None)
            exact = best is not None
            if not exact:
                best = min((hit for _, hit in automaton.iter(text)), default=None)
            if best is not None:
                for col, v in zip(out, (text, exact, *best), strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _HITS, strict=True)], schema=_HITS)


def shards_of(keys: DataFrame, shard_chars: int) -> int:
    """How many shards hold ``shard_chars`` characters of keys each, about."""
    chars = keys.agg(F.coalesce(F.sum(F.length("key")), F.lit(0)).alias("n")).first().n
    return max(1, -(-chars // shard_chars))


def best_keys(texts: DataFrame, keys: DataFrame, shard_chars: int = 1_000_000, partitions: int | None = None) -> DataFrame:
    """``low, canonical`` of the distinct ``texts (low)`` that are a key of ``keys (ordinal, key, canonical)``, or else contain one: the one of least ordinal, then least key.

    Keys are dealt into shards by their hash and texts into blocks, and every
    shard meets every block in one task.  A task reads its keys first, makes
    one automaton of them, and lets the texts stream by: it holds one shard,
    of about ``shard_chars`` characters, however large the table, and its time
    is linear in the texts and in their hits.  Each text is copied once per
    shard and each key once per block.  Null keys and texts match nothing; the
    empty key is contained in every text.  A key that comes twice counts as
    its row of least ordinal.
    """
    spark = texts.sparkSession
    table = keys.select(F.col("ordinal").cast("long").alias("ordinal"), "key", "canonical").where("key is not null")
    shards = shards_of(table, shard_chars)
    blocks = max(1, -(-(partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))) // shards))
    low = texts.select("low").where("low is not null").distinct()
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = table.where("key <> ''").select(F.lit(0).alias("kind"), F.col("key").alias("text"), "ordinal", "canonical", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), all_of(blocks).alias("block"))
    them = low.select(F.lit(1).alias("kind"), F.col("low").alias("text"), F.lit(None).cast("long").alias("ordinal"), F.lit(None).cast("string").alias("canonical"), F.pmod(F.xxhash64("low"), F.lit(blocks)).cast("int").alias("block"), all_of(shards).alias("shard"))
    dealt = own.unionByName(them).repartitionById(shards * blocks, F.col("shard") * blocks + F.col("block")).sortWithinPartitions("kind")
    hits = dealt.select("kind", "text", "ordinal", "canonical").mapInArrow(_scan, "low string, exact boolean, ordinal long, key string, canonical string")
    empty = table.where("key = ''").agg(F.min(F.struct("ordinal", "canonical")).alias("e")).where("e is not null")  # one row at most
    anywhere = low.join(F.broadcast(empty), how="cross").select("low", (F.col("low") == "").alias("exact"), "e.ordinal", F.lit("").alias("key"), "e.canonical")
    order = F.struct(~F.col("exact"), "ordinal", "key", "canonical")
    return hits.unionByName(anywhere).groupBy("low").agg(F.min_by("canonical", order).alias("canonical"))
