"""Token ids in files of compressed bit or byte planes.

Documents are sorted by range of their ids, and every task streams its part
into one file: texts are encoded, the end id is appended, and each block of a
fixed number of ids is transposed.  A plane holds one bit (or byte) of all ids
of the block, so the high planes, which hardly vary, nearly vanish under
zstandard.  Bounds of documents are blocks of the same form.  At the end of a
file stands its chunk index: kind, place, number of the first id and length of
every plane of each block, so any span of ids is read by its blocks alone.
How many documents and ids each file has goes to an index of all files, whose
running totals are where the documents of each file start.

Words recur, so the library encodes each distinct one of a worker once: its
pre-tokenizer drops white space, and no token of it crosses any, which is
verified on the vocabulary.  The ids equal those of whole texts.

A text that is null or empty is the end id alone.  Documents come by rising
id, null first; repeated ids by hash of their texts, equal rows as read.
Ids of documents are integers.  An empty table makes an index without files.
"""

from __future__ import annotations

import json
import string
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .outfiles import make_folder, new_folder, one_task_each, place, remove_folder, running_totals, small_batches, whole_file
from .tables import free, table

TOKENIZER = "word_bpe_49k.json"
_MAGIC = b"TOKPLAN1"
_ENTRY = np.dtype([("kind", "u1"), ("bits", "u1"), ("width", "<u2"), ("count", "<u4"), ("first", "<u8"), ("offset", "<u8"), ("lengths", "<u4", (64,))])
_TAIL = struct.Struct("<QQQ8s")  # place of the index, ids, documents
_IDS, _DOCS = 0, 1


def to_planes(values: np.ndarray, bits: bool) -> list[np.ndarray]:
    """The bit or byte planes of unsigned integers, lowest first."""
    flat = np.ascontiguousarray(values)
    if bits:
        flat = flat.view(f"<u{flat.itemsize}")
        one, used = flat.dtype.type(1), int(np.bitwise_or.reduce(flat)).bit_length()
        none = np.zeros(-(-len(flat) // 8), np.uint8)
        return [np.packbits(((flat >> flat.dtype.type(k)) & one).astype(np.uint8), bitorder="little") if k < used else none for k in range(8 * flat.itemsize)]
    return list(np.ascontiguousarray(flat.view(np.uint8).reshape(len(flat), flat.itemsize).T))


def from_planes(planes: list[np.ndarray | None], count: int, dtype: np.dtype, bits: bool) -> np.ndarray:
    """The integers again; None stands for a plane of zeros."""
    width = np.dtype(dtype).itemsize
    if bits:
        out = np.zeros(count, f"<u{width}")
        for k, plane in enumerate(planes):
            if plane is not None:
                out |= np.unpackbits(plane, count=count, bitorder="little").astype(out.dtype) << out.dtype.type(k)
        return out.view(dtype)
    octets = np.zeros((count, width), np.uint8)
    for k, plane in enumerate(planes):
        if plane is not None:
            octets[:, k] = plane
    return octets.view(dtype).reshape(count)


class Writer:
    """One file of ids and of bounds of documents; holds a block of each at most."""

    def __init__(self, out, block: int = 65_536, bits: bool = True, level: int = 3):
        import zstandard

        self.out, self.block, self.bits = out, block, bits
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.index: list[np.ndarray] = []
        self.at = self.out.write(_MAGIC)
        self.ids = np.empty(block, "<u4")
        self.held = self.n_ids = self.n_docs = 0
        self.docs: list[tuple[int, int, int]] = []

    def _chunk(self, kind: int, first: int, parts: list[np.ndarray]) -> None:
        entry = np.zeros(1, _ENTRY)
        entry["kind"], entry["bits"], entry["width"], entry["count"], entry["first"], entry["offset"] = kind, self.bits, len(parts), len(parts[0]), first, self.at
        lengths = []
        for plane in (p for values in parts for p in to_planes(values, self.bits)):
            data = self.zstd.compress(plane.tobytes()) if plane.any() else b""  # a plane of zeros has no bytes
            lengths.append(len(data))
            self.at += self.out.write(data) if data else 0
        entry["lengths"][0, : len(lengths)] = lengths
        self.index.append(entry)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id is not None, doc_id or 0, len(ids)))
        self.n_docs += 1
        while len(ids):
            part, ids = ids[: self.block - self.held], ids[self.block - self.held :]
            self.ids[self.held : self.held + len(part)] = part
            self.held += len(part)
            if self.held == self.block:
                self._flush_ids()
        if len(self.docs) == self.block:
            self._flush_docs()

    def _flush_ids(self) -> None:
        if self.held:
            self._chunk(_IDS, self.n_ids, [self.ids[: self.held]])
        self.n_ids, self.held = self.n_ids + self.held, 0

    def _flush_docs(self) -> None:
        if self.docs:
            has, number, size = (np.array(x, "<i8") for x in zip(*self.docs, strict=True))
            first = self.n_docs - len(self.docs)
            for kind, values in ((_DOCS, number), (_DOCS + 1, (size << 1) | has)):
                self._chunk(kind, first, [values])
        self.docs = []

    def close(self) -> None:
        self._flush_ids()
        self._flush_docs()
        self.out.write(np.concatenate(self.index).tobytes() if self.index else b"")
        self.out.write(_TAIL.pack(self.at, self.n_ids, self.n_docs, _MAGIC))


class Reader:
    """One file, by its chunk index."""

    def __init__(self, source):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        source.seek(0, 2)
        end = source.tell() - _TAIL.size
        at, self.n_ids, self.n_docs, magic = _TAIL.unpack(self._bytes(end, _TAIL.size)) if end > 0 else (0, 0, 0, b"")
        if magic != _MAGIC:
            raise ValueError("not a whole file of token planes")
        self.index = np.frombuffer(self._bytes(at, end - at), _ENTRY)
        self.chunks = {k: self.index[self.index["kind"] == k] for k in (_IDS, _DOCS, _DOCS + 1)}

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def chunk(self, entry) -> np.ndarray:
        dtype = np.dtype("<u4" if entry["kind"] == _IDS else "<i8")
        bits, count = bool(entry["bits"]), int(entry["count"])
        lengths = entry["lengths"][: dtype.itemsize * (8 if bits else 1)].astype(np.int64)
        data, ends = self._bytes(int(entry["offset"]), int(lengths.sum())), np.cumsum(lengths)
        planes = [np.frombuffer(self.zstd.decompress(data[e - n : e]), np.uint8) if n else None for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
        return from_planes(planes, count, dtype, bits)

    def span(self, first: int, count: int) -> np.ndarray:
        """``count`` ids from number ``first`` of the file on, from the blocks that hold them."""
        own, end = self.chunks[_IDS], min(first + count, self.n_ids)
        if first >= end:
            return np.empty(0, "<u4")
        from_, to = np.searchsorted(own["first"], [first, end - 1], "right") - 1
        flat = np.concatenate([self.chunk(e) for e in own[from_ : to + 1]])
        skip = first - int(own["first"][from_])
        return flat[skip : skip + end - first]

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """(id, first id's number in the file, pieces of its ids) of each document in order; a block of each kind is held.  Take the pieces before the next document."""
        blocks, held, used, start = iter(self.chunks[_IDS]), np.empty(0, "<u4"), 0, 0

        def pieces(n: int) -> Iterator[np.ndarray]:
            nonlocal held, used
            while n:
                if used == len(held):
                    held, used = self.chunk(next(blocks)), 0
                part = held[used : used + n]
                used, n = used + len(part), n - len(part)
                yield part

        for a, b in zip(self.chunks[_DOCS], self.chunks[_DOCS + 1], strict=True):
            sizes = self.chunk(b)
            for number, size in zip(self.chunk(a).tolist(), sizes.tolist(), strict=True):
                yield (number if size & 1 else None), start, pieces(size >> 1)
                start += size >> 1


class Encoder:
    """Ids of whole texts by the library, each distinct word asked for once; ``most`` words are kept."""

    def __init__(self, path: str, most: int = 750_000):
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        self.library.no_padding()
        self.library.no_truncation()
        whole = json.loads(self.library.to_str())
        drops = json.dumps(whole["normalizer"]).count('"Lowercase"') and any(p["type"] == "Split" and p["invert"] and r"[\p{L}]+" in p["pattern"]["Regex"] for p in whole["pre_tokenizer"].get("pretokenizers", ()))
        blank = {chr(c) for c in b" \t\n\r\v\f"} | {"Ġ", "ĉ", "Ċ", "č"}
        self.by_word = bool(drops) and not any(len(t) > 1 and blank & set(t) for t in (x.removesuffix("</w>") for x in self.library.get_vocab(False)))
        self.closes = np.zeros(self.library.get_vocab_size(), bool)
        for text, i in self.library.get_vocab(False).items():
            self.closes[i] = text.endswith("</w>")
        self.marks = string.punctuation.encode()
        self._empty()

    def _empty(self) -> None:
        self.place: dict[bytes, int] = {}
        self.begin, self.end = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def _put(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        """New words, with their ids one after the other and where in these each ends."""
        n, m = len(self.place), len(words)
        while n + m > len(self.begin):
            self.begin, self.end = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.end))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.end[n : n + m] = self.used + ends
        self.begin[n], self.begin[n + 1 : n + m] = self.used, self.used + ends[:-1]
        self.used += len(ids)
        self.place.update(zip(words, range(n, n + m), strict=True))

    def _places(self, words: list[bytes]) -> np.ndarray:
        """Of words that are known; -1 for others."""
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))

    def _ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by their places, one after the other, and where each word ends."""
        begin, size = self.begin[at], self.end[at] - self.begin[at]
        ends = np.cumsum(size)
        return self.flat[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)], ends

    def _learn(self, words: list[bytes]) -> None:
        """Distinct new words.  Those of letters are asked for many at a time, as the ids that end a word tell them apart; others singly, without the marks behind letters, which are words of their own to the library."""
        plain, odd, joined = {}, {}, []
        for w in words:
            stem = w.rstrip(self.marks)
            text = stem.decode("utf-8", "replace")
            if text.isalpha():
                if stem not in self.place:
                    plain[stem] = text
                if len(stem) < len(w):
                    tail = w[len(stem) :]
                    joined.append((w, stem, tail))
                    if tail not in self.place:
                        odd[tail] = None
            else:
                odd[w] = None
        stems, texts = list(plain), list(plain.values())
        for i in range(0, len(stems), 500):
            ids = np.array(self.library.encode_batch_fast([" ".join(texts[i : i + 500])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(stems[i : i + 500]):
                self._put(stems[i : i + 500], ids, ends)
            else:  # a letter that the library does not take for one
                odd |= dict.fromkeys(stems[i : i + 500])
        others = list(odd)
        for i in range(0, len(others), 500):
            part = others[i : i + 500]
            found = [e.ids for e in self.library.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)]
            self._put(part, np.array([x for ids in found for x in ids], np.uint32), np.cumsum([len(ids) for ids in found]))
        joined = [x for x in joined if x[0] not in self.place]
        if joined:
            whole, stems, tails = zip(*joined, strict=True)
            ids, ends = self._ids(self._places([x for two in zip(stems, tails, strict=True) for x in two]))
            self._put(list(whole), ids, ends[1::2])

    def encode_all(self, raws: list[bytes]) -> list[np.ndarray]:
        """Ids of each of some texts."""
        if not self.by_word:
            return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast([r.decode("utf-8", "replace") for r in raws], add_special_tokens=False)]
        if len(self.place) > self.most:
            self._empty()
        # the library lower-cases anyway, but for its special tokens
        split = [raw.split() if b"<|" in raw else raw.lower().split() for raw in raws]
        words = list(chain.from_iterable(split))
        at = self._places(words)
        if len(new := np.flatnonzero(at < 0)):
            missing = [words[i] for i in new.tolist()]
            self._learn(list(dict.fromkeys(missing)))
            at[new] = self._places(missing)
        ids, ends = self._ids(at)
        cuts = np.concatenate([[0], ends])[np.cumsum([len(x) for x in split])]
        return np.split(ids, cuts[:-1]) if len(raws) else []

    def encode(self, raw: bytes) -> np.ndarray:
        return self.encode_all([raw])[0]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker, with the words that earlier batches and tasks have brought."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_FILES = "file_no int, name string, n_docs long, n_ids long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int | None = 2, block: int = 65_536, bits: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all texts to files in ``folder``, by rising ``id_col``, and return the index of the files.

    ``file_no, name, n_docs, n_ids, start``: files are in order of their
    numbers, and ``start`` is how many ids the files before have.  The index
    is a table ``index`` in the folder, too.  ``end``: the id that ends each
    document, or None.
    """
    spark = docs.sparkSession
    work = f"{folder}-work"
    make_folder(folder)
    make_folder(work)
    tie, place_ = free("tie", docs.columns), free("place", docs.columns)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias(tie), F.monotonically_increasing_id().alias(place_))
    order = [F.col("id").asc_nulls_first(), F.col(tie), F.col(place_)]
    kind = pa.schema([("file_no", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        own, number = encoder(tokenizer), TaskContext.get().partitionId()
        name, last = f"tokens-{number:06}.planes", np.array([] if end is None else [end], np.uint32)
        with whole_file(f"{folder}/{name}", work) as out:
            file = Writer(out, block, bits)
            while first is not None:
                found = own.encode_all([raw or b"" for raw in first.column(1).to_pylist()])
                for i, ids in zip(first.column(0).to_pylist(), found, strict=True):
                    file.add(i, np.concatenate([ids, last]))
                first = next(batches, None)
            file.close()
        yield pa.RecordBatch.from_pydict({"file_no": [number], "name": [name], "n_docs": [file.n_docs], "n_ids": [file.n_ids]}, schema=kind)

    with small_batches(spark):
        found = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text").mapInArrow(write, _FILES)
        found.write.parquet(f"{folder}/files")
    remove_folder(work)
    index = running_totals(spark.read.schema(_FILES).parquet(f"{folder}/files"), "file_no", "n_ids", "start", "all").drop("all")  # a row per file
    index.coalesce(1).write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/index")


def _each_file(spark: SparkSession, folder: str) -> DataFrame:
    """The index of the files, one to a task."""
    index = read_index(spark, folder).select("file_no", "name", "start")
    most = index.agg(F.max("file_no")).first()[0]
    return one_task_each(index, "file_no", 1 if most is None else most + 1)


def _per_document(spark: SparkSession, folder: str, value, kind: pa.DataType, ddl: str, name: str, rows: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), (name, kind)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, before in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                store, at = place(f"{folder}/{file}")
                with store.open_input_file(at) as source:
                    held: list[tuple] = []
                    size = 0
                    for number, start, pieces in Reader(source).documents():
                        n, found = value(pieces)
                        held.append((number, before + start, n, found))
                        size += n
                        if len(held) == rows or size > 1 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return _each_file(spark, folder).mapInArrow(read, f"doc_id long, start long, n_tokens long, {name} {ddl}")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``, from the files."""

    def value(pieces):
        ids = np.concatenate([np.empty(0, "<u4"), *pieces]).astype(np.int32)
        return len(ids), ids

    return _per_document(spark, folder, value, pa.list_(pa.int32()), "array<int>", "ids", 1_000)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``, from the files; ids are never held as a whole."""

    def value(pieces):
        n = crc = 0
        for p in pieces:
            n, crc = n + len(p), zlib.crc32(np.ascontiguousarray(p).view(np.uint8), crc)
        return n, crc

    return _per_document(spark, folder, value, pa.int64(), "long", "ids_crc32", 10_000)


def read_spans(spark: SparkSession, folder: str, spans: DataFrame) -> DataFrame:
    """``first, ids`` for ``spans (first, count)`` of the whole sequence of ids; a span may cross files.  Only the blocks that hold them are read."""
    index = read_index(spark, folder).select("name", "start", "n_ids").where("n_ids > 0")
    hit = spans.select("first", "count").distinct().join(index, (F.col("first") < F.col("start") + F.col("n_ids")) & (F.col("start") < F.col("first") + F.col("count")))
    parts = hit.select("first", "count", "name", "start", F.greatest(F.col("first") - F.col("start"), F.lit(0)).alias("from"), F.least(F.col("first") + F.col("count") - F.col("start"), F.col("n_ids")).alias("to"))
    schema = pa.schema([("first", pa.int64()), ("count", pa.int64()), ("start", pa.int64()), ("part", pa.list_(pa.int32()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                store, at = place(f"{folder}/{r['name']}")
                with store.open_input_file(at) as source:
                    ids = Reader(source).span(r["from"], r["to"] - r["from"])
                yield pa.RecordBatch.from_pydict({"first": [r["first"]], "count": [r["count"]], "start": [r["start"]], "part": [ids.astype(np.int32)]}, schema=schema)

    found = parts.mapInArrow(read, "first long, count long, start long, part array<int>").groupBy("first", "count").agg(F.array_sort(F.collect_list(F.struct("start", "part"))).alias("x"))
    return found.select("first", "count", F.flatten("x.part").alias("ids"))


def op13_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to files of bit planes and back."""
    import public_tokenizers

    folder = new_folder(spark, "op13-tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER))
    return digests(spark, folder)


QUERIES = {"op13_token_planes": op13_token_planes}
ORACLE: dict[str, str] = {}
