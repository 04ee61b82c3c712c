"""Groups of similar names, kept up to date as names come in batches.

A folder keeps what pairing needs: the distinct token sets, the edges found so
far, and the names with their counts.  The keys by which sets meet are found in
each set alone, so they need no table.  A batch pairs its new sets with all,
never old ones with each other; leaders are then found over the stored
edges, in the order that the counts have by now.  So the groups equal those of
one run over all names, whatever order they came in.

Every batch writes folders of its own and a commit at the end.  A batch that
failed, or the last one, may be given again and replaces itself; readers see
committed batches only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.functions.text import tokens
from tavola.operators.lineage import pick, shuffles_freed, stored
from tavola.operators.nearsets import near_pairs
from tavola.operators.resolve import grouped, name_key, not_first, verified

_TABLES = {
    "names": "row long, dish_name string, count long, id string",
    "sets": "row long, id string, tokens array<string>, n int",
    "prefix": "x long, y long",  # pairs that share a key; the folder has kept its name
    "edges": "x long, y long",
    "commits": "names long, sets long, edges long",
}


def set_id(col: Column) -> Column:
    """Of a sorted token set; tokens have no spaces."""
    return F.md5(F.array_join(col, " "))


class NameIndex:
    """Similar names under ``folder``, at a Jaccard similarity of ``threshold`` or more."""

    def __init__(self, spark: SparkSession, folder: str, threshold: float = 0.85):
        self.spark, self.folder, self.num = spark, folder.rstrip("/"), round(threshold * 1000)

    def batches(self) -> list[int]:
        """Numbers of the committed batches."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(path):
            return []
        found = (str(s.getPath().getName()) for s in store.listStatus(path) if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
        return sorted(int(x.removeprefix("batch=")) for x in found if x.startswith("batch="))

    def _read(self, table: str, below: int | None = None) -> DataFrame:
        paths = [f"{self.folder}/{table}/batch={k}" for k in self.batches() if below is None or k < below]
        return self.spark.read.schema(_TABLES[table]).parquet(*paths) if paths else self.spark.createDataFrame([], _TABLES[table])

    def _write(self, df: DataFrame, table: str, batch: int) -> DataFrame:
        path = f"{self.folder}/{table}/batch={batch}"
        with shuffles_freed(self.spark):
            df.select(*[c.split()[0] for c in _TABLES[table].split(", ")]).write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(_TABLES[table]).parquet(path)

    def add(self, names: DataFrame, batch: int) -> None:
        """Take in ``names (dish_name, count)``; counts of a name add up over batches.  ``batch``: a number over all committed ones, or the last one again."""
        if (done := self.batches()) and batch < done[-1]:
            raise ValueError(f"batch {done[-1]} has been paired with batch {batch} already")
        words = F.array_sort(tokens(F.col("dish_name")))
        last = self._read("names", batch).agg(F.coalesce(F.max("row") + 1, F.lit(0)).alias("n")).first().n
        rows = names.where("dish_name is not null").groupBy("dish_name").agg(F.sum("count").cast("long").alias("count")).withColumn("tokens", words)
        rows = rows.withColumn("id", F.when(F.size("tokens") > 0, set_id(F.col("tokens")))).withColumn("row", F.monotonically_increasing_id() + last)
        rows = self._write(rows, "names", batch)

        found, old = rows.where("id is not null"), self._read("sets", batch)
        known = found.select("id", "row").join(old.select("id"), "id", "left_semi").select("row")
        later = stored(not_first(found, "id", F.col("row")).union(known), "later")
        sets = self._write(pick(found, later, "left_anti").withColumn("tokens", words).withColumn("n", F.size("tokens")), "sets", batch)
        every = old.withColumn("fresh", F.lit(False)).unionByName(sets.withColumn("fresh", F.lit(True))).where(F.col("n") * 1000 >= self.num * (F.col("n") + 1))
        every = every.select(F.col("row").alias("id"), "tokens", "fresh")
        pairs = self._write(near_pairs(every, self.num).select(F.col("a").alias("x"), F.col("b").alias("y")), "prefix", batch)
        edges = verified(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")), every, self.num)
        edges = self._write(edges.select(F.col("a").alias("x"), F.col("b").alias("y")), "edges", batch)
        counts = [d.agg(F.count("*").alias(c)) for c, d in (("names", rows), ("sets", sets), ("edges", edges))]
        self._write(counts[0].crossJoin(counts[1]).crossJoin(counts[2]), "commits", batch)  # one row each

    def names(self) -> DataFrame:
        """``dish_name, count, id`` of all committed batches."""
        return self._read("names").groupBy("dish_name").agg(F.sum("count").alias("count"), F.first("id").alias("id"))

    def groups(self) -> DataFrame:
        """``dish_name, canonical_name`` of names that join an earlier, similar one, by falling count and then by name, as ``auto_groups`` of all names tells."""
        names = self._read("names").where("id is not null")
        rows = names.select(name_key("dish_name"), F.col("id").alias("digest"), "count")
        many = rows.groupBy("digest").agg((F.min("name") != F.max("name")).alias("many"))
        classes = self._read("sets").select(F.col("row").alias("id"), F.col("id").alias("digest")).join(many, "digest")
        return grouped(rows, classes, self._read("edges").select(F.col("x").alias("a"), F.col("y").alias("b")), names.select("dish_name"))
