"""Alignment of two tokenizers' tokens by deduplicated segments.

A text is cut before runs of white space where neither vocabulary has a token
that goes from what is no white space into it, which is verified on both.  So
the tokens of a text are those of its segments, and every cut is a place where
tokens of both end.  Tasks cut their documents into chunks of a bounded size:
the distinct segments of the chunk, and the documents as numbers of them.
Segments that are distinct over all chunks are tokenised and aligned once,
beside all entries that have them, which take the result back to their chunks;
each chunk then composes its documents.  What is counted over the corpus, the
documents that hold a pair of ids linked, is counted per chunk, summed up per
pair and joined back in the same way.

A text that is null, empty, not UTF-8 or not given back byte for byte by both
tokenizers has no tokens.  Rows count each for itself, also where ids or whole
rows repeat.  One chunk is all that a task holds; the longest text bounds it
from below.
"""

from __future__ import annotations

import gc
import hashlib
import re
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .outfiles import small_batches
from .storage import materialize, release
from .tables import dealt_anew, table

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
_META = "▁"
_BLANKS = " \t\n\r\v\f"
#: Pairs of larger groups are counted by distinct ids, one group at a time.
_LARGE = 4_096
#: Of the number of a chunk's segment; a chunk ends at half as many, so one more text of this many words fits.
_BITS = 24


def _byte_level() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves, the others are numbered from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both vocabularies, as bytes, and the blanks before which texts may be cut."""

    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        level = _byte_level()
        special = set(self.a.get_added_tokens_decoder())
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for text, i in self.a.get_vocab().items():
            self.a_bytes[i] = b"" if i in special else bytes(level[c] for c in text)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        self.b_bytes = []
        pieces = []
        for i in range(self.b.get_piece_size()):
            p = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes.append(bytes([int(p[3:5], 16)]))
            elif self.b.is_control(i) or self.b.is_unknown(i):
                self.b_bytes.append(b"")
            else:
                pieces.append(p)
                self.b_bytes.append(p.replace(_META, " ").encode())
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        if len(self.a_bytes) > 1 << 16 or len(self.b_bytes) > 1 << 16:
            raise ValueError("ids of over 16 bits")
        self.blank = self.b.piece_to_id(_META)
        #: a blank other than the space begins a segment only if no piece of B has it beside other characters
        self.cuts = "".join(c for c in _BLANKS if c == " " or not any(len(p) > 1 and c in p for p in pieces))
        across = re.compile(rf"\S[{re.escape(self.cuts)}]")
        if any(across.search(t.decode("utf-8", "surrogateescape")) for t in (*self.a_bytes, *self.b_bytes)):
            raise ValueError("a token goes on from a word into white space")
        own = re.escape(self.cuts)
        self.segment = re.compile(rf"[{own}]\s*\S*(?:[^\S{own}]\s*\S*)*")

    def segments(self, text: str) -> list[str]:
        """Space and text, cut before each run of white space that begins with a blank that may be cut at."""
        return self.segment.findall(" " + text)

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of segments; B puts a space before what it is given, which is the first one of a segment or goes."""
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        led = [s[:1] == " " for s in segments]
        b = self.b.encode([s[1:] if x else s for s, x in zip(segments, led, strict=True)], num_threads=1)
        for i, (ids, x) in enumerate(zip(b, led, strict=True)):
            if not x:
                b[i] = ids[1:] if ids[:1] == [self.blank] else []
            elif not ids:
                b[i] = [self.blank]
        return a, b


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(a: str, b: str) -> Tokenizers:
    if (a, b) not in _LOADED:
        _LOADED[a, b] = Tokenizers(a, b)
    return _LOADED[a, b]


def _runs(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each size."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weights, first)


class Groups:
    """Aligned segments: how many groups each has, how many ids of A and of B each group has, and these ids one after the other."""

    def __init__(self, groups: np.ndarray, count_a: np.ndarray, count_b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray):
        self.groups, self.count_a, self.count_b, self.ids_a, self.ids_b = groups, count_a, count_b, ids_a, ids_b
        self.n = len(groups)
        self.seg = np.repeat(np.arange(self.n), groups)
        self.begin_a, self.begin_b = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b

    def totals(self) -> list[np.ndarray]:
        """Ids of A, ids of B, groups and links of each segment."""
        out = []
        for of_group in (self.count_a, self.count_b, np.ones_like(self.count_a), self.count_a * self.count_b):
            up = np.concatenate([[0], np.cumsum(of_group)])
            end = np.cumsum(self.groups)
            out.append(up[end] - up[end - self.groups])
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segment, code (A's id times 65536 plus B's) and number of links of every linked pair, by segment."""
        small = self.count_a * self.count_b <= _LARGE
        group = np.repeat(np.arange(len(self.seg)), self.count_a)
        each = np.where(small[group], self.count_b[group], 0)
        at = np.repeat(self.begin_b[group], each) + _runs(each)
        keys = [(np.repeat(self.seg[group], each) << 32) | (np.repeat(self.ids_a, each) << 16) | self.ids_b[at]]
        weights = [np.ones(len(at), np.int64)]
        for g in np.flatnonzero(~small).tolist():
            x, k = np.unique(self.ids_a[self.begin_a[g] : self.begin_a[g] + self.count_a[g]], return_counts=True)
            y, m = np.unique(self.ids_b[self.begin_b[g] : self.begin_b[g] + self.count_b[g]], return_counts=True)
            keys.append((self.seg[g] << 32) | ((x << 16)[:, None] | y[None, :]).ravel())
            weights.append((k[:, None] * m[None, :]).ravel())
        found, times = _summed(np.concatenate(keys), np.concatenate(weights))
        return found >> 32, found & 0xFFFFFFFF, times

    def texts(self) -> list[str]:
        """``a1,a2|b1;a3|b2`` of each segment."""
        a, b = self.ids_a.tolist(), self.ids_b.tolist()
        one = (self.count_a == 1) & (self.count_b == 1)
        texts = [
            f"{a[i]}|{b[j]}" if single else f"{','.join(map(str, a[i : i + k]))}|{','.join(map(str, b[j : j + m]))}"
            for i, j, k, m, single in zip(self.begin_a.tolist(), self.begin_b.tolist(), self.count_a.tolist(), self.count_b.tolist(), one.tolist(), strict=True)
        ]
        ends = np.cumsum(self.groups).tolist()
        return [";".join(texts[i:j]) for i, j in zip([0, *ends], ends, strict=False)]

    def packed(self) -> list[bytes]:
        """Each segment as bytes: its groups and whether numbers are wide, ids of A and of B in each group, all ids of A, all of B."""
        wide = np.zeros(self.n, bool)
        np.logical_or.at(wide, self.seg, (self.count_a > 255) | (self.count_b > 255))
        head = (self.groups << 1 | wide).astype("<u4").tobytes()
        ends = np.cumsum(self.groups).tolist()
        ends_a, ends_b = (np.concatenate([[0], np.cumsum(c)])[ends].tolist() for c in (self.count_a, self.count_b))
        both = np.stack([self.count_a, self.count_b], axis=1).astype("<u4")
        narrow, full = both.astype("u1").tobytes(), both.tobytes()
        a, b = self.ids_a.astype("<u2").tobytes(), self.ids_b.astype("<u2").tobytes()
        out, g, x, y = [], 0, 0, 0
        for i, (h, i_a, i_b, w) in enumerate(zip(ends, ends_a, ends_b, wide.tolist(), strict=True)):
            out.append(head[4 * i : 4 * i + 4] + (full[8 * g : 8 * h] if w else narrow[2 * g : 2 * h]) + a[2 * x : 2 * i_a] + b[2 * y : 2 * i_b])
            g, x, y = h, i_a, i_b
        return out

    @classmethod
    def unpacked(cls, parts: list[bytes]) -> Groups:
        data = np.frombuffer(b"".join(parts), "u1")
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.cumsum(size) - size

        def numbers(start: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
            """``count`` numbers of ``width`` bytes from each start on."""
            first = np.repeat(start, count) + width * _runs(count)
            return sum(data[first + k].astype(np.int64) << (8 * k) for k in range(width))

        head = numbers(at, np.ones(len(parts), np.int64), 4) if len(parts) else np.empty(0, np.int64)
        groups, wide = head >> 1, (head & 1).astype(bool)
        counts = np.empty(2 * int(groups.sum()), np.int64)
        is_wide = np.repeat(wide, 2 * groups)
        counts[~is_wide] = numbers(at[~wide] + 4, 2 * groups[~wide], 1)
        counts[is_wide] = numbers(at[wide] + 4, 2 * groups[wide], 4)
        count_a, count_b = counts[::2].copy(), counts[1::2].copy()
        end = np.cumsum(groups)
        n_a, n_b = (np.concatenate([[0], np.cumsum(c)])[end] - np.concatenate([[0], np.cumsum(c)])[end - groups] for c in (count_a, count_b))
        ids = at + 4 + 2 * groups * np.where(wide, 4, 1)
        return cls(groups, count_a, count_b, numbers(ids, n_a, 2), numbers(ids + 2 * n_a, n_b, 2))


def align_texts(own: Tokenizers, segments: list[str]) -> tuple[np.ndarray, Groups]:
    """Which segments both tokenizers give back byte for byte, and their groups; the others have none."""
    a, b = own.encode(segments)
    raw = [s.encode() for s in segments]
    ok = [b"".join(map(own.a_bytes.__getitem__, x)) == r == b"".join(map(own.b_bytes.__getitem__, y)) for x, y, r in zip(a, b, raw, strict=True)]
    n_a, n_b = (np.array([len(x) if good else 0 for x, good in zip(t, ok, strict=True)], np.int64) for t in (a, b))
    ids_a, ids_b = (np.fromiter((i for x, good in zip(t, ok, strict=True) if good for i in x), np.int64, int(c.sum())) for t, c in ((a, n_a), (b, n_b)))
    ends_a, ends_b = np.cumsum(own.a_sizes[ids_a]), np.cumsum(own.b_sizes[ids_b])
    both = np.intersect1d(ends_a, ends_b, assume_unique=True)  # segments end where tokens of both end, so no group goes on beyond one
    group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
    count_a, count_b = (np.bincount(g, minlength=len(both)).astype(np.int64) for g in (group_a, group_b))
    seg = np.repeat(np.arange(len(segments)), n_a)[np.cumsum(count_a) - count_a] if len(both) else np.empty(0, np.int64)
    return np.array(ok, bool), Groups(np.bincount(seg, minlength=len(segments)).astype(np.int64), count_a, count_b, ids_a, ids_b)


def _chunks(docs: DataFrame, paths: tuple[str, str], size: int) -> DataFrame:
    """``chunk, doc_ids, counts, seq, segments``: the documents of each chunk as numbers of its distinct segments; a count of -1 tells a text that has no tokens whatever comes."""
    kind = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.binary()), ("seq", pa.binary()), ("segments", pa.list_(pa.string()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(*paths)
        number, part = 0, TaskContext.get().partitionId()

        def close() -> pa.RecordBatch:
            counts = np.array(sizes, np.int32).tobytes()
            return pa.RecordBatch.from_pydict({"chunk": [(part << 16) + number], "doc_ids": [ids], "counts": [counts], "seq": [_dense(np.concatenate([np.empty(0, np.int32), *seqs]))], "segments": [list(known)]}, schema=kind)

        ids, sizes, seqs, known, held = [], [], [], {}, 0
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = (raw or b"").decode("utf-8", "replace")
                ids.append(i)
                if not text or ("�" in text and text.encode() != raw):
                    sizes.append(-1)
                else:
                    found = own.segments(text)
                    seqs.append(np.fromiter((known.setdefault(s, len(known)) for s in found), np.int32, len(found)))
                    sizes.append(len(found))
                    held += len(raw)
                if held >= size or len(ids) >= 100_000 or len(known) >= 1 << (_BITS - 1):
                    yield close()
                    ids, sizes, seqs, known, held, number = [], [], [], {}, 0, number + 1
        if ids:
            yield close()

    return docs.mapInArrow(cut, "chunk long, doc_ids array<long>, counts binary, seq binary, segments array<string>")


def align_segments(entries: DataFrame, a: str, b: str, batch: int = 5_000, most: int = 500_000) -> DataFrame:
    """``of, n, data`` of ``entries (entry, segment)``: each distinct segment is aligned once, and every entry gets what its segment has.

    Entries are dealt out and sorted by segment, so those of one segment
    follow each other and stream through one task.  No segment has more
    entries than there are chunks.  What a task has for a chunk, of ``most``
    entries at a time, is one compressed row; see ``_opened``.
    """
    kind = pa.schema([("of", pa.int64()), ("n", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        own, zstd = tokenizers(a, b), zstandard.ZstdCompressor(level=3)
        last: str | None = None
        packed: list[bytes] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            entry, which = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(entry)
            entry, which = entry[order], which[order]
            chunk = entry >> _BITS
            first = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
            size = np.fromiter(map(len, packed), "<u4", len(packed))
            rows = []
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(chunk)], strict=True):
                numbers = (entry[i:j] & ((1 << _BITS) - 1)).astype("<u4")
                rows.append(zstd.compress(numbers.tobytes() + size[which[i:j]].tobytes() + b"".join([packed[k] for k in which[i:j].tolist()])))
            return pa.RecordBatch.from_arrays([pa.array(chunk[first], pa.int64()), pa.array(np.diff([*first, len(chunk)]).astype(np.int32), pa.int32()), pa.array(rows, pa.binary())], schema=kind)

        for x in batches:
            for at in range(0, x.num_rows, batch):
                part = x.slice(at, batch)
                segments = part.column(1).to_pylist()
                new = [i for i, (s, before) in enumerate(zip(segments, [last, *segments], strict=False)) if s != before]
                ok, groups = align_texts(own, [segments[i] for i in new])
                begun = np.zeros(len(segments), np.int64)
                begun[new] = 1
                held.append((part.column(0).to_numpy(), len(packed) - 1 + np.cumsum(begun)))  # what comes before the first new segment goes on with the one before
                packed += [p if good else b"" for p, good in zip(groups.packed(), ok.tolist(), strict=True)]
                last = segments[-1]
                if sum(len(e) for e, _ in held) >= most:
                    yield flush()
                    held, packed = [], packed[-1:]
        if held:
            yield flush()

    dealt = entries.repartition("segment").sortWithinPartitions("segment")
    return dealt.select("entry", "segment").mapInArrow(run, "of long, n int, data binary")


def _opened(counts: list[int], rows: list[bytes]) -> list[bytes]:
    """The packed alignments of a chunk's segments by their numbers, from all its rows; empty where a segment is not given back by both tokenizers."""
    import zstandard

    zstd, numbers, parts = zstandard.ZstdDecompressor(), [], []
    for n, row in zip(counts, rows, strict=True):
        data = zstd.decompress(row)
        numbers.append(np.frombuffer(data, "<u4", n))
        ends = (8 * n + np.cumsum(np.frombuffer(data, "<u4", n, 4 * n), dtype=np.int64)).tolist()
        parts += [data[i:j] for i, j in zip([8 * n, *ends], ends, strict=False)]
    return [parts[i] for i in np.argsort(np.concatenate([np.empty(0, np.int64), *numbers])).tolist()]


def _dense(seq: np.ndarray) -> bytes:
    """Numbers from 0, compressed by their first to fourth bytes: most are small."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(seq.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _numbers(dense: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(dense), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


class _Chunk:
    """The documents of a chunk as slices of numbers of segments."""

    def __init__(self, counts: bytes, seq: bytes):
        sizes = np.frombuffer(counts, np.int32).astype(np.int64)
        self.given = sizes >= 0
        self.sizes = np.maximum(sizes, 0)
        self.end = np.cumsum(self.sizes)
        self.begin = self.end - self.sizes
        self.seq = _numbers(seq)

    def sums(self, per_segment: np.ndarray) -> np.ndarray:
        """For each document the sum over its segments."""
        up = np.concatenate([[0], np.cumsum(per_segment[self.seq])])
        return up[self.end] - up[self.begin]


def _holders(doc: np.ndarray, seg: np.ndarray, size: np.ndarray, start: np.ndarray, pair: np.ndarray, n: int, most: int = 1 << 19) -> np.ndarray:
    """In how many documents each of ``n`` pairs is, of documents with distinct segments, by document; about ``most`` pairs are held at a time."""
    out, up, i = np.zeros(n, np.int64), np.cumsum(size[seg]), 0
    while i < len(doc):
        at = min(max(int(np.searchsorted(up, (up[i - 1] if i else 0) + most)), i), len(doc) - 1)
        j = int(np.searchsorted(doc, doc[at], "right"))
        part, k = seg[i:j], size[seg[i:j]]
        held = np.unique(np.repeat(doc[i:j] - doc[i], k) * n + pair[np.repeat(start[part], k) + _runs(k)])
        out += np.bincount(held % n, minlength=n)
        i = j
    return out


_DONE = "chunk long, doc_ids array<long>, counts binary, seq binary, seg_size binary, seg_pair binary, seg_times binary, good binary, totals binary, groups array<string>, codes array<long>, holders array<long>"


def _composed(chunks: DataFrame, paths: tuple[str, str], digest: bool) -> DataFrame:
    """One row per chunk: its documents with their totals and groups, and how many of them hold each of its pairs."""
    kind = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("counts", "seq", "seg_size", "seg_pair", "seg_times", "good", "totals")], ("groups", pa.list_(pa.string())), ("codes", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64()))])

    def compose(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        chunk = _Chunk(row["counts"], row["seq"])
        packed = _opened(right.column("n").to_pylist(), right.column("data").to_pylist())
        n = len(packed)
        bad = np.array([not x for x in packed], bool)
        found = Groups.unpacked([x or bytes(4) for x in packed])
        pair_seg, pair_code, times = found.pairs()
        size = np.bincount(pair_seg, minlength=n)
        start = np.concatenate([[0], np.cumsum(size)])
        codes, pair = np.unique(pair_code, return_inverse=True)
        good = chunk.given & (chunk.sizes > 0) & (chunk.sums(bad.astype(np.int64)) == 0)
        totals = np.stack([chunk.sums(x) for x in found.totals()]) * good
        # each document's distinct segments, then its distinct pairs
        doc = np.repeat(np.arange(len(good)), chunk.sizes)
        own = np.unique((doc * max(n, 1) + chunk.seq)[good[doc]])
        doc, seg = own // max(n, 1), own % max(n, 1)
        holders = _holders(doc, seg, size, start, pair, len(codes))
        texts = [x.encode() for x in found.texts()]
        groups = []
        for i, (fit, a, b) in enumerate(zip(good.tolist(), chunk.begin.tolist(), chunk.end.tolist(), strict=True)):
            whole = b";".join([texts[s] for s in chunk.seq[a:b].tolist()]) if fit else b""
            groups.append((hashlib.sha256(whole).hexdigest() if digest else whole.decode()) if fit else "")
        out = [[row["chunk"]], [row["doc_ids"]], [row["counts"]], [row["seq"]], [_dense(size)], [_dense(pair)], [times.tobytes() if (times > 1).any() else b""], [good.tobytes()], [totals.astype(np.int64).tobytes()], [groups], [codes], [holders]]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(out, kind, strict=True)], schema=kind)

    entries = align_segments(chunks.select("chunk", F.posexplode("segments").alias("number", "segment")).select((F.shiftleft("chunk", _BITS) + F.col("number")).alias("entry"), "segment"), *paths)
    return chunks.drop("segments").groupBy("chunk").cogroup(entries.groupBy("of")).applyInArrow(compose, _DONE)


def pair_counts(done: DataFrame) -> DataFrame:
    """``code, n, best``: in how many documents a pair of ids is linked, and whether no pair of its A id is in more."""
    pairs = done.select(F.explode(F.arrays_zip("codes", "holders")).alias("x")).groupBy(F.col("x.codes").alias("code")).agg(F.sum("x.holders").alias("n")).where("n > 0")
    pairs = pairs.withColumn("a", F.shiftright("code", 16))
    most = pairs.groupBy("a").agg(F.max("n").alias("most"))
    return pairs.join(most, "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def _drop_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffles of tables that are written: it does so once their plans are collected here and in the JVM, which is twice as the one has to tell the other."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def align(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, chunk_bytes: int = 8 << 20) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` of each row of ``docs``.

    ``groups``: ``a1,a2|b1;a3|b2`` in order of the text, or with ``digest``
    its SHA-256 as hexadecimal digits (empty without tokens).  ``n_best``:
    links whose pair is in as many documents as any pair of its A id;
    ``count_sum``: the sum over links of how many documents have their pair.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    with small_batches(spark):
        chunks = materialize(_chunks(rows, (a, b), chunk_bytes), "chunks")
        done = materialize(_composed(chunks, (a, b), digest), "composed")
        release(chunks)
        _drop_shuffles(spark)
        pairs = materialize(pair_counts(done), "pairs")
        _drop_shuffles(spark)
    kind = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups", pa.string())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        chunk, good = _Chunk(row["counts"], row["seq"]), np.frombuffer(row["good"], bool)
        right = right.sort_by("number")
        n, best = (right.column(c).to_numpy().astype(np.int64) for c in ("n", "best"))
        start = np.concatenate([[0], np.cumsum(_numbers(row["seg_size"]))])
        pair, times = _numbers(row["seg_pair"]), np.frombuffer(row["seg_times"], np.int64) if row["seg_times"] else 1

        def per_segment(of_pair: np.ndarray) -> np.ndarray:
            up = np.concatenate([[0], np.cumsum(times * of_pair[pair])])
            return up[start[1:]] - up[start[:-1]]

        totals = np.frombuffer(row["totals"], np.int64).reshape(4, -1)
        sums = [chunk.sums(per_segment(x)) * good for x in (best, n)]
        return pa.Table.from_arrays([pa.array(row["doc_ids"], pa.int64()), *[pa.array(x, pa.int64()) for x in (*totals, *sums)], pa.array(row["groups"], pa.string())], schema=kind)

    numbered = done.select(F.col("chunk").alias("of"), F.posexplode("codes").alias("number", "code"))
    counted = numbered.join(dealt_anew(pairs, ["code"], "n"), "code", "left")  # no document holds pairs of texts without tokens
    counted = counted.select("of", "number", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("best", F.lit(False)).alias("best"))
    left = done.drop("codes", "holders")
    return left.groupBy("chunk").cogroup(counted.groupBy("of")).applyInArrow(finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two public tokenizers over all documents."""
    import public_tokenizers

    out = align(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B), digest=True)
    return out.withColumnRenamed("groups", "groups_sha256")


QUERIES = {"op12_token_alignment": op12_token_alignment}
ORACLE: dict[str, str] = {}
