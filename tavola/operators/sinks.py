"""Where results go."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flat(df: DataFrame) -> DataFrame:
    """Maps and structs as JSON, arrays of text comma-joined: what CSV can hold."""
    out = {}
    for name, kind in df.dtypes:
        if kind == "array<string>":
            out[name] = F.array_join(name, ",")
        elif kind.startswith(("map", "struct", "array")):
            out[name] = F.to_json(name)
    return df.withColumns(out) if out else df


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with header.  One file only for results of a known small size."""
    d = flat(df)
    (d.coalesce(1) if one_file else d).write.csv(path, header=True, mode="overwrite", quote='"', escape='"')


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_text(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path, mode="overwrite")


def write_report(df: DataFrame, path: str) -> None:
    """A report of one row as indented JSON, letters kept as they are."""
    row = json.loads(df.select(F.to_json(F.struct("*")).alias("j")).first()["j"])
    with open(path, "w", encoding="utf-8") as f:
        json.dump(row, f, ensure_ascii=False, indent=2)


def _dictionary_items(rows: list[tuple[str, int, int]]) -> tuple[bytes, bytes]:
    """The items of both sections for ``rows (lemma, frequency, rank)``; all but the first begin with a comma."""
    text = lambda x: json.dumps(x, ensure_ascii=False)
    pairs = ((("," if r > 1 else ""), text(w), n) for w, n, r in rows)
    a, b = [], []
    for comma, w, n in pairs:
        a.append(f"{comma}\n    {w}: {n}")
        b.append(f'{comma}\n    {{"lemma": {w}, "frequency": {n}}}')
    return "".join(a).encode("utf-8", "surrogatepass"), "".join(b).encode("utf-8", "surrogatepass")


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """``dictionary (lemma, frequency, rank)`` as one JSON file: totals, lemma -> frequency, and the list by rank.

    Rows are sorted by range of their ranks.  Every partition tells how many
    bytes its items take; the sums over the partitions before it are where
    they begin, and each task then writes its ranges of the one file at their
    places, a batch at a time.  No row comes to the driver, which writes the
    brackets.  The path must be on a file system that all executors mount.
    """
    from tavola.operators.lemmas import ranked
    from tavola.operators.lineage import cut

    path = path.removeprefix("file://")
    if "rank" not in dictionary.columns:
        dictionary = ranked(dictionary.select("lemma", "frequency"), "frequency", "lemma")
    total = dictionary.agg(F.count("*").alias("n"), F.coalesce(F.sum("frequency"), F.lit(0)).alias("all")).first()
    rows = dictionary.select("lemma", F.col("frequency").cast("long").alias("frequency"), F.col("rank").cast("long").alias("rank"))
    part = cut(rows.repartitionByRange("rank").sortWithinPartitions("rank").withColumn("part", F.spark_partition_id()))

    def sizes(batches):
        at, a, b = None, 0, 0
        for x in batches:
            if x.num_rows:
                at = x.column(3)[0].as_py()
                one, two = _dictionary_items(list(zip(*(c.to_pylist() for c in x.columns[:3]), strict=True)))
                a, b = a + len(one), b + len(two)
        if at is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([at], pa.int32()), "a": pa.array([a], pa.int64()), "b": pa.array([b], pa.int64())})

    each = part.mapInArrow(sizes, "part int, a long, b long").orderBy("part").collect()  # a row per partition
    head = f'{{\n  "total_unique_lemmas": {total.n},\n  "total_occurrences": {total["all"]},\n  "dictionary": {{'.encode()
    middle, tail = b'\n  },\n  "sorted_by_frequency": [', b"\n  ]\n}\n"
    starts: dict[int, tuple[int, int]] = {}
    at = len(head)
    second = at + sum(r.a for r in each) + len(middle)
    end = second
    for r in each:
        starts[r.part] = (at, end)
        at, end = at + r.a, end + r.b
    with open(path, "wb") as f:
        f.write(head)
        f.truncate(end)
        f.seek(at)
        f.write(middle)
        f.seek(end)
        f.write(tail)

    def write(batches):
        places = None
        for x in batches:
            if x.num_rows:
                places = places or list(starts[x.column(3)[0].as_py()])
                with open(path, "r+b") as f:
                    for i, items in enumerate(_dictionary_items(list(zip(*(c.to_pylist() for c in x.columns[:3]), strict=True)))):
                        f.seek(places[i])
                        f.write(items)
                        places[i] += len(items)
            yield x.slice(0, 0)

    part.mapInArrow(write, part.schema).write.format("noop").mode("overwrite").save()


def remove(spark, path: str) -> bool:
    """Delete an output folder, wherever it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
