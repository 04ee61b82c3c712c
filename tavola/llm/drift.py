"""Drifted schema rewrite: files of many schemas become files of one, matched by Parquet field ids.

Rows are sorted by range; how many each partition has, summed up over the
partitions before it, makes a row's number in its partition a rank over all.
Runs of ranks are files, and each file has one task that streams its rows.
For the rewrite each file has one task again: it reads batches, takes the
columns by field id whatever their names and order, casts or fills them, and
writes the replacement to a work folder.  Only when a table of all
replacements has been written do tasks move these over the old files, so
executors may be lost at any point: no task reads a file that another attempt
has replaced already.

Files whose schema is that of the target are not touched.  Columns whose id
the target lacks are dropped, those that a file lacks get the target's
default, null included.  A cast that would lose digits, a file with two
columns of one id, and a file without ids are errors.  Null and repeated sort
keys are ranked like others; rows that are alike in all keys keep the order in
which they were read.  An empty table makes no file.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .outfiles import make_folder, new_folder, one_task_each, place, remove_folder, running_totals, small_batches, whole_file
from .storage import materialize, release
from .tables import free, table

_ID = b"PARQUET:field_id"


class Field(NamedTuple):
    """A column of a file: its field id, its name there, its type, and what rows get where a file lacks it."""

    id: int
    name: str
    type: pa.DataType
    default: Any = None


def schema_of(fields: Iterable[Field]) -> pa.Schema:
    return pa.schema([pa.field(f.name, f.type, metadata={_ID: str(f.id).encode()}) for f in fields])


def columns_by_id(schema: pa.Schema) -> dict[int, int]:
    """Field id -> place of its column."""
    out: dict[int, int] = {}
    for i, field in enumerate(schema):
        number = int((field.metadata or {}).get(_ID, b"-1"))
        if number < 0 or number in out:
            raise ValueError(f"column {field.name} has no field id or one that another column has")
        out[number] = i
    return out


def _is(schema: pa.Schema, fields: list[Field]) -> bool:
    by_id = columns_by_id(schema)
    return list(by_id) == [f.id for f in fields] and all(s.name == f.name and s.type == f.type and s.nullable for s, f in zip(schema, fields, strict=True))


class _Rows:
    """Batches to a Parquet file, in row groups of about ``size`` bytes."""

    def __init__(self, out, schema: pa.Schema, size: int = 32 << 20):
        self.writer = pq.ParquetWriter(out, schema, compression="zstd")
        self.schema, self.size, self.held, self.bytes, self.rows = schema, size, [], 0, 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.held.append(batch)
        self.bytes += batch.nbytes
        self.rows += batch.num_rows
        if self.bytes >= self.size:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.writer.write_table(pa.Table.from_batches(self.held, self.schema))
        self.held, self.bytes = [], 0

    def close(self) -> None:
        self.flush()
        self.writer.close()


def rebuilt(batch: pa.RecordBatch, by_id: dict[int, int], fields: list[Field]) -> pa.RecordBatch:
    """The columns of ``fields``, found by their ids."""
    arrays = [pc.cast(batch.column(by_id[f.id]), f.type) if f.id in by_id else pa.repeat(pa.scalar(f.default, f.type), batch.num_rows) for f in fields]
    return pa.RecordBatch.from_arrays(arrays, schema=schema_of(fields))


def ranked(rows: DataFrame, keys: list[Column], rank: str) -> tuple[DataFrame, int]:
    """``rows`` with ``rank`` from 0 by ``keys`` over all rows, from a written table, and how many rows there are.

    One shuffle, by range.  Rows alike in all keys are told apart by their
    place in the input, so a hot key is split like any other.
    """
    place_, part, own = (free(x, rows.columns) for x in ("place", "part", "own"))
    found = rows.withColumn(place_, F.monotonically_increasing_id())
    order = [*keys, F.col(place_)]
    found = found.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(own, F.monotonically_increasing_id())  # partition and place in it
    found = found.select(*rows.columns, F.shiftright(own, 33).alias(part), F.col(own).bitwiseAND(F.lit((1 << 33) - 1)).alias(own))
    found = materialize(found, "sorted")
    sizes = found.groupBy(part).agg(F.count("*").alias("n"))  # a row per partition
    starts = running_totals(sizes, part, "n", "before", "total").select(F.col(part), "before", "total")
    one = starts.first()
    out = found.join(F.broadcast(starts.select(part, "before")), part)
    return out.select(*rows.columns, (F.col("before") + F.col(own)).alias(rank)), one.total if one else 0


_WRITTEN = "file_no long, path string, n_rows long, columns string"


def write_files(rows: DataFrame, columns: list[str], file_no: str, order: str, n: int, folder: str, layout: Callable[[int], list[Field]], fields: list[Field]) -> DataFrame:
    """Write the ``columns`` of ``rows``, given by ``fields``, to ``n`` files by ``file_no``, each in ``order`` and with the columns of its ``layout``.  Returns ``file_no, path, n_rows, columns``, written as a table."""
    work = f"{folder}-work"
    make_folder(folder)
    make_folder(work)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        number = first.column(0)[0].as_py()
        own = layout(number)
        at = {f.id: i for i, f in enumerate(fields, 1)}
        path = f"{folder}/file-{number:05}.parquet"
        with whole_file(path, work) as out:
            file = _Rows(out, schema_of(own))
            while first is not None:
                arrays = [pc.cast(first.column(at[f.id]), f.type) for f in own]
                file.add(pa.RecordBatch.from_arrays(arrays, schema=file.schema))
                first = next(batches, None)
            file.close()
        yield pa.RecordBatch.from_pydict({"file_no": [number], "path": [path], "n_rows": [file.rows], "columns": [",".join(f.name for f in own)]}, schema=pa.schema([("file_no", pa.int64()), ("path", pa.string()), ("n_rows", pa.int64()), ("columns", pa.string())]))

    with small_batches(rows.sparkSession):
        dealt = one_task_each(rows.select(file_no, *columns, order), file_no, n).sortWithinPartitions(order).drop(order)
        out = materialize(dealt.mapInArrow(write, _WRITTEN), "files", rows=n)
    remove_folder(work)
    return out


_REPLACED = "file_no long, path string, replacement string"


def rewrite(files: DataFrame, n: int, folder: str, fields: list[Field], batch_rows: int = 65_536) -> DataFrame:
    """Turn every file of ``files (file_no, path)``, numbered from 0 to ``n - 1`` and all in ``folder``, into one of ``fields``.

    Returns ``file_no, path, rewritten``, written as a table; ``rewritten`` is
    false for files that had the schema already.  Nothing but the files is
    left in the folder.
    """
    spark = files.sparkSession
    work = f"{folder}-work"
    make_folder(work)
    kind = pa.schema([("file_no", pa.int64()), ("path", pa.string()), ("replacement", pa.string())])

    def replacement(path: str) -> str | None:
        store, at = place(path)
        with store.open_input_file(at) as source:
            old = pq.ParquetFile(source)
            if _is(old.schema_arrow, fields):
                return None
            by_id = columns_by_id(old.schema_arrow)
            new = f"{work}/{uuid.uuid4().hex}"
            with store.open_output_stream(place(new)[1]) as out:
                file = _Rows(out, schema_of(fields))
                for batch in old.iter_batches(batch_rows):
                    file.add(rebuilt(batch, by_id, fields))
                file.close()
        return new

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers, paths = b.column(0), b.column(1)
            yield pa.RecordBatch.from_arrays([numbers, paths, pa.array([replacement(p) for p in paths.to_pylist()], pa.string())], schema=kind)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, new in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if new is not None:
                    store, at = place(path)
                    try:
                        store.move(place(new)[1], at)
                    except FileNotFoundError:  # an attempt before this one has moved it
                        with store.open_input_file(at) as source:
                            if not _is(pq.ParquetFile(source).schema_arrow, fields):
                                raise
            yield b

    done = materialize(one_task_each(files.select(F.col("file_no").cast("long"), "path"), "file_no", n).mapInArrow(rebuild, _REPLACED), "replacements", rows=n)
    moved = one_task_each(done.where("replacement is not null"), "file_no", n).mapInArrow(move, _REPLACED)
    moved.write.format("noop").mode("overwrite").save()
    remove_folder(work)
    return done.select("file_no", "path", F.col("replacement").isNotNull().alias("rewritten"))


def _floored(x: pa.Array, scale: int) -> pa.Array:
    """``floor(scale * x)`` in decimals; what is no number by its name."""
    return pa.array([None if v is None else str(math.floor(v * scale)) if math.isfinite(v) else str(v) for v in x.to_pylist()], pa.string())


def _text(x: pa.Array) -> pa.Array:
    if pa.types.is_timestamp(x.type):
        x = pc.cast(pc.cast(x, pa.timestamp("us", x.type.tz)), pa.int64())
    return _floored(x, 1 << 20) if pa.types.is_floating(x.type) else pc.cast(x, pa.string())


_DIGEST = "file_no long, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string, columns string"


def digests(files: DataFrame, n: int, batch_rows: int = 65_536) -> DataFrame:
    """``file_no, n_rows, n_nulls, ids_sha256, rows_sha256, columns`` of ``files (file_no, path)``, read back batch by batch.

    Ids are the first column.  Fields are joined by ``|``, rows by newlines,
    nulls are ``?``; times are microseconds since 1970, floating numbers
    ``floor(1048576 x)``.
    """
    kind = pa.schema([("file_no", pa.int64()), ("n_rows", pa.int64()), ("n_nulls", pa.int64()), ("ids_sha256", pa.string()), ("rows_sha256", pa.string()), ("columns", pa.string())])

    def digest(number: int, path: str) -> tuple:
        store, at = place(path)
        ids, lines, rows, nulls = hashlib.sha256(), hashlib.sha256(), 0, 0
        with store.open_input_file(at) as source:
            file = pq.ParquetFile(source)
            for batch in file.iter_batches(batch_rows):
                nulls += sum(c.null_count for c in batch.columns)
                text = [pc.fill_null(_text(c), "?") for c in batch.columns]
                for sha, parts, by in ((ids, text[0], b","), (lines, pc.binary_join_element_wise(*text, "|"), b"\n")):
                    sha.update(by * bool(rows) + by.join(x.encode() for x in parts.to_pylist()))
                rows += batch.num_rows
            return number, rows, nulls, ids.hexdigest(), lines.hexdigest(), ",".join(file.schema_arrow.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [digest(*x) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), kind, strict=True)], schema=kind) if found else pa.RecordBatch.from_pylist([], schema=kind)

    return one_task_each(files.select("file_no", "path"), "file_no", n).mapInArrow(run, _DIGEST)


CLIENTS = [
    Field(1, "client_id", pa.int64()),
    Field(2, "master_id", pa.int64()),
    Field(3, "source", pa.string()),
    Field(4, "updated_at", pa.timestamp("us")),
    Field(5, "name", pa.string()),
    Field(6, "email", pa.string()),
    Field(7, "city", pa.string()),
    Field(8, "nation_id", pa.int64(), -1),
    Field(9, "segment", pa.string(), "none"),
    Field(10, "balance", pa.float64()),
]


def drifted(number: int) -> list[Field]:
    """The columns of a file of clients before the rewrite, by the bits of its version."""
    bits, out = version(number), list(CLIENTS)
    if bits & 8:
        out = [f._replace(type={"balance": pa.float32(), "nation_id": pa.int32()}.get(f.name, f.type)) for f in out]
    if bits & 4:
        out = [f for f in out if f.name not in ("nation_id", "segment")]
    if bits & 2:
        out = [out[0], *out[:0:-1]]
    if bits & 1:
        out = [f._replace(name={"name": "email", "email": "name"}.get(f.name, f.name)) for f in out]
    return out


def version(number: int) -> int:
    found = zlib.crc32(f"19:{number}".encode()) % 24
    return found if found <= 15 else 0


def op11_drift_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of clients, drifted by their number, are rewritten to one schema and read back."""
    names = [f.name for f in CLIENTS]
    kinds = {"nation_id": "long", "client_id": "long", "master_id": "long", "balance": "double", "updated_at": "timestamp_ntz"}
    rows = table(spark, sf_dir, "clients").select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in names])
    key = F.crc32(F.col("client_id").cast("string"))
    order, total = ranked(rows, [key.asc_nulls_first(), F.col("client_id").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in names[1:]]], "rank")
    each = 1 + total // 250
    n = -(-total // each)
    base = new_folder(spark, "op11-clients")
    start = write_files(order.withColumn("file_no", F.floor(F.col("rank") / each)), names, "file_no", "rank", n, f"{base}/table", drifted, CLIENTS)
    release(order)
    done = rewrite(start, n, f"{base}/table", CLIENTS)
    drawn = F.crc32(F.concat(F.lit("19:"), F.col("file_no").cast("string"))) % 24
    few = [F.broadcast(x) for x in (done, start.select("file_no", F.col("columns").alias("start_columns")))]  # 250 rows at most
    out = digests(done, n).join(few[0], "file_no").join(few[1], "file_no")
    return out.select("file_no", F.when(drawn <= 15, drawn).otherwise(0).cast("long").alias("version"), "n_rows", "n_nulls", "ids_sha256", "rows_sha256", "start_columns", "columns", "path", "rewritten")


QUERIES = {"op11_drift_rewrite": op11_drift_rewrite}
ORACLE: dict[str, str] = {}
