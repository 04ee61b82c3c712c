"""Pairs of sets of tokens that may be similar, by keys found in each set alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.session import in_small_batches

_KEYS_PER_BLOCK = 1_000_000
_PAIRS_AT_ONCE = 1 << 20
_RECORD = "block int, band int, id bigint, n int, whole boolean, fresh boolean, sketch array<bigint>, keys array<bigint>"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """64 bits in which every bit of ``x`` tells."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bands(most: int) -> list[tuple[int, int]]:
    """Least and largest sizes of the bands up to the one that has ``most``."""
    out, low = [], 1
    while low <= most:
        out.append((low, max(low, low * 7 // 5)))
        low = out[-1][1] + 1
    return out


def parts_of(low: int, high: int, num: int) -> tuple[int, int]:
    """Into how many parts the sets of a band are dealt, and up to how many tokens a part is weak.

    Similar sets, the larger one in the band, differ in ``gap`` tokens at most,
    so of ``gap + 2`` parts at least two are equal.  Where parts would come
    out small, ``gap + 1`` do, of which one is equal, and none is weak.
    """
    gap = 2 * high * (1000 - num) // (1000 + num)
    if low < 3 * (gap + 2):
        return gap + 1, -1
    return gap + 2, 2 if gap < 32 else 1 if gap < 256 else 0


def words_of(high: int) -> int:
    """Words of 64 bits in a sketch of sets of up to ``high`` tokens."""
    return -(-high // 64) if high <= 128 else max(2, -(-high // 128))


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values.view(np.int64)))


def _keys(token: np.ndarray, size: np.ndarray, band: int, parts: int, weak: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of sets whose tokens follow each other in ``token``, and the number of the set of each."""
    sets = len(size)
    cell = np.repeat(np.arange(sets) * parts, size) + (token % np.uint64(parts)).astype(np.int64)
    sums, full = np.zeros(sets * parts, np.uint64), np.bincount(cell, minlength=sets * parts)
    np.add.at(sums, cell, _mix(token))
    part = np.tile(np.arange(parts, dtype=np.uint64), sets)
    keys = _mix(sums + _ODD * (part + np.uint64(1 + (band << 32)))).reshape(sets, parts)
    strong = full.reshape(sets, parts) > weak
    found, of = [keys[strong]], [np.nonzero(strong)[0]]
    for r in np.flatnonzero(strong.sum(axis=1) < parts - 1):
        own = keys[r][~strong[r]]
        i, j = np.triu_indices(len(own), 1)
        found.append(_mix(own[i] * _ODD + own[j]))
        of.append(np.full(len(i), r))
    return np.concatenate(found), np.concatenate(of)


def _records(ids: np.ndarray, fresh: np.ndarray, values: np.ndarray, start: np.ndarray, n: np.ndarray, band: int, low: int, high: int, num: int, blocks: int) -> Iterator[pa.RecordBatch]:
    rows = np.flatnonzero((n <= high) & (n * 1000 >= num * low))
    if not len(rows):
        return
    size, words = n[rows], words_of(high)
    at = np.arange(size.sum()) + np.repeat(start[rows] - (np.cumsum(size) - size), size)
    token = _mix(values[at] + _ODD)
    bit = _mix(token) % np.uint64(64 * words)
    sketch = np.zeros(len(rows) * words, np.uint64)
    np.bitwise_xor.at(sketch, np.repeat(np.arange(len(rows)) * words, size) + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    keys, of = _keys(token, size, band, *parts_of(low, high, num))
    block = (keys % np.uint64(blocks)).astype(np.int64)
    order = np.lexsort((block, of))
    keys, of, block = keys[order], of[order], block[order]
    ends = np.append(np.flatnonzero((np.diff(of) != 0) | (np.diff(block) != 0)) + 1, len(keys))
    first = np.concatenate([[0], ends[:-1]])
    own, count = of[first], len(first)
    columns = [pa.array(block[first], pa.int32()), pa.array(np.full(count, band), pa.int32()), pa.array(ids[rows][own]), pa.array(size[own], pa.int32()), pa.array(size[own] >= low), pa.array(fresh[rows][own])]
    yield pa.RecordBatch.from_arrays([*columns, _lists(sketch.reshape(len(rows), words)[own].ravel(), np.arange(1, count + 1) * words), _lists(keys, ends)], names=[c.split()[0] for c in _RECORD.split(", ")])


def _meet(t: pa.Table, num: int) -> Iterator[pa.RecordBatch]:
    """Pairs of records of one band that share a key and whose sketches allow a similarity of ``num`` thousandths."""
    ids, n, whole, fresh = (t.column(c).to_numpy() for c in ("id", "n", "whole", "fresh"))
    n = n.astype(np.int64)
    sketch = np.concatenate([c.flatten().to_numpy() for c in t.column("sketch").chunks]).view(np.uint64).reshape(len(ids), -1)
    keys = np.concatenate([c.flatten().to_numpy() for c in t.column("keys").chunks])
    rec = np.repeat(np.arange(len(ids)), np.concatenate([np.diff(c.offsets.to_numpy()) for c in t.column("keys").chunks]))
    # of keys that follow each other in both records only the first makes a pair
    before, head = np.roll(keys, 1), np.concatenate([[True], rec[1:] != rec[:-1]])
    order = np.argsort(keys, kind="stable")
    keys, rec, before, head = keys[order], rec[order], before[order], head[order]
    kept, held = [], 0

    def batch() -> pa.RecordBatch:
        a, b = (np.concatenate([k[i] for k in kept] or [np.zeros(0, np.int64)]) for i in (0, 1))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])

    left, step = np.arange(len(keys)), 0
    while len(left):
        step += 1
        left = left[left + step < len(keys)]
        left = left[keys[left] == keys[left + step]]
        for i in range(0, len(left), _PAIRS_AT_ONCE // sketch.shape[1] + 1):
            at = left[i : i + _PAIRS_AT_ONCE // sketch.shape[1] + 1]
            at = at[head[at] | head[at + step] | (before[at] != before[at + step])]
            a, b = rec[at], rec[at + step]
            ok = (whole[a] | whole[b]) & (fresh[a] | fresh[b]) & (ids[a] != ids[b]) & (n[a] * 1000 >= num * n[b]) & (n[b] * 1000 >= num * n[a])
            a, b = a[ok], b[ok]
            apart = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64)
            ok = apart * (1000 + num) <= (n[a] + n[b]) * (1000 - num)
            x, y = ids[a[ok]], ids[b[ok]]
            kept.append((np.minimum(x, y), np.maximum(x, y)))
            held += len(x)
            if held > _PAIRS_AT_ONCE:
                yield batch()
                kept, held = [], 0
    yield batch()


def near_pairs(sets: DataFrame, num: int) -> DataFrame:
    """``a, b`` (a < b), each once: ids of ``sets (id, tokens, fresh)``, integers, among which are all pairs with a similarity of ``num`` thousandths or more of which one is ``fresh``.

    A hash deals the tokens of a set into parts, more parts than similar sets
    can differ in tokens, so some parts are equal.  A part is a key.  Parts of
    few tokens, which unlike sets share by chance, are keys by twos: if no
    other part is equal, two of these are.  How many parts there are goes by
    the size of the larger set, in bands; ``whole`` sets have their size in
    the band, others come to it as the smaller ones.  No order or frequency of
    tokens is needed.

    Keys are dealt into blocks.  A set sends each block its keys there and a
    sketch once, the parities of its tokens by hash; sketches differ in no
    more bits than their sets in tokens.  Sets that meet by chance, whose
    number grows with the square of the input, end there: they are not
    shuffled.  A block has a million keys, about, however large the input.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fresh, tokens = b.columns
            offsets, values = tokens.offsets.to_numpy(), tokens.values.to_numpy(zero_copy_only=False).view(np.uint64)
            start, n = offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)
            if len(n):
                for band, (low, high) in enumerate(bands(int(n.max()) * 1000 // num)):
                    yield from _records(ids.to_numpy(), fresh.to_numpy(zero_copy_only=False), values, start, n, band, low, high, num, blocks)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (all_of := list(batches)):
            return
        t = pa.Table.from_batches(all_of)
        for band in t.column("band").unique().to_pylist():
            yield from _meet(t.filter(pc.equal(t.column("band"), band)), num)

    total = sets.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("n")).first().n
    blocks = max(2 * sets.sparkSession.sparkContext.defaultParallelism, total * (1000 - num) // 500 // _KEYS_PER_BLOCK)
    hashed = in_small_batches(sets.select("id", "fresh", F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens")))
    dealt = hashed.mapInArrow(deal, _RECORD).repartitionById(blocks, F.col("block"))
    return dealt.mapInArrow(meet, "a bigint, b bigint").distinct()
