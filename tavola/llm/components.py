"""Connected components by alternating large and small stars, in DataFrame operations only.

The edge set is rewritten until it is a forest of stars whose centres are the
least nodes.  No task ever holds the neighbours of a node: minima are
pre-aggregated, and both sides of the join with them are dealt out for it, so
that adaptive execution can split a node of many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, release
from .tables import dealt_anew


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return both.where("v > u").join(dealt_anew(least, ["u"], "n"), "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
    moved = e.join(dealt_anew(least, ["hi"], "n"), "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def _signature(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; ``component`` is the least node that can be reached.

    Nodes may be of any orderable type.  Null ends and loops make no link; a
    node that has only these is not returned.  Repeated edges count once.  An
    empty input gives an empty result.
    """
    a, b = F.col(src), F.col(dst)
    e = materialize(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    seen = _signature(e)
    while seen[0]:
        nxt = materialize(_small_star(_large_star(e)), "edges", 2 * seen[0])
        now = _signature(nxt)
        release(e)
        e = nxt
        if now == seen:
            break
        seen = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
