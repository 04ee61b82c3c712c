"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch (a word: a run of meta spaces and what follows
up to the next) are laid end to end and indexed by a suffix array, sorted to
the depth of the longest piece.  Every piece of the vocabulary is
binary-searched for its range of occurrences.  All occurrences are edges from
where they begin to where they end; sorted by end they are relaxed: an edge
extends the encoding that ends where it begins if its piece may follow that
encoding's last one.  For byte-pair merges exactly one edge into each place
can: two pieces may meet if merging their joint text gives just these two, and
every prefix of an encoding is the encoding of its text.  Characters that no
piece has fall back to bytes.

The vocabulary is read from the tokenizer's file, whose path is a parameter.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import in_small_batches
from .tables import free, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_SPACE = "▁"
_UNIT = re.compile(f"{_SPACE}+[^{_SPACE}]*|[^{_SPACE}]+")
_OPEN = -1


class _Pairs:
    """Answers for pairs of pieces in an open-addressed table of numpy arrays, of at most ``most`` slots."""

    def __init__(self, most: int = 1 << 23):
        self.most = most
        self._make(1 << 18)

    def _make(self, slots: int) -> None:
        self.keys, self.good, self.used = np.full(slots, -1, np.int64), np.zeros(slots, bool), 0

    def _slot(self, code: np.ndarray) -> np.ndarray:
        shift = np.uint64(64 - (len(self.keys).bit_length() - 1))
        with np.errstate(over="ignore"):
            return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)

    def find(self, code: np.ndarray) -> np.ndarray:
        """The slot of each code, or one less than the negative of the free slot where it belongs."""
        at, mask = self._slot(code), len(self.keys) - 1
        out = np.empty(len(code), np.int64)
        todo = np.arange(len(code))
        while len(todo):
            k = self.keys[at]
            hit, free = k == code, k == -1
            out[todo[hit]], out[todo[free]] = at[hit], -1 - at[free]
            go = ~(hit | free)
            todo, code, at = todo[go], code[go], (at[go] + 1) & mask
        return out

    def add(self, codes: np.ndarray, good: np.ndarray) -> None:
        """Codes that are not there yet."""
        if 2 * (self.used + len(codes)) > len(self.keys):
            size = 1 << (4 * (self.used + len(codes))).bit_length()
            have = self.keys != -1
            old = (self.keys[have], self.good[have]) if size <= self.most else (codes[:0], good[:0])  # full: begin anew
            self._make(max(1 << 18, min(size, self.most), 1 << (2 * len(codes)).bit_length()))
            if len(old[0]):
                self.add(*old)
        while len(codes):
            free = -1 - self.find(codes)
            _, first = np.unique(free, return_index=True)  # two may want the same slot
            self.keys[free[first]], self.good[free[first]] = codes[first], good[first]
            self.used += len(first)
            rest = np.ones(len(codes), bool)
            rest[first] = False
            codes, good = codes[rest], good[rest]


class Vocabulary:
    """Pieces of a byte-pair model with byte fallback, and which pairs of them may meet."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.bytes = [0] * 256
        self.text: list[str] = [""] * n
        self.fallback: dict[int, int] = {}
        normal: list[int] = []
        for i in range(n):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                b = int(p[3:5], 16)
                self.bytes[b], self.fallback[i] = i, b
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.text[i] = p
                normal.append(i)
        self.unknown = m.unk_id()
        self.prefix = m.encode("a") == m.encode(" a")[-1:] or m.encode("a", out_type=str)[0].startswith(_SPACE)
        self.rank = {self.text[i]: -m.get_score(i) for i in normal}
        if any(_SPACE in p.lstrip(_SPACE) for p in self.rank):
            raise ValueError("a piece goes on beyond a word; this vocabulary cannot be matched word by word")
        # pieces that merging can reach at all, as one matrix of their characters' numbers (0: beyond the piece)
        usable = [i for i in normal if self._merge(self.text[i]) == [self.text[i]]]
        self.ids = np.array(usable, np.int32)
        self.lens = np.array([len(self.text[i]) for i in usable], np.int32)
        self.depth = int(self.lens.max(initial=1))
        flat = _points("".join(self.text[i] for i in usable))
        self.alphabet = np.unique(flat)
        self.grid = np.zeros((len(usable), self.depth), np.int64)
        begin = np.cumsum(self.lens) - self.lens
        self.grid[np.repeat(np.arange(len(usable)), self.lens), np.arange(len(flat)) - np.repeat(begin, self.lens)] = np.searchsorted(self.alphabet, flat) + 1
        self.single = np.array(sorted(ord(self.text[i]) for i in usable if len(self.text[i]) == 1), np.int64)
        self.pairs = _Pairs()

    def _merge(self, text: str) -> list[str]:
        """Merging of a short text, pair by pair: best rank first, leftmost of equals."""
        parts, rank, never = list(text), self.rank.get, float("inf")
        ranks = [rank(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], never)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], never)
        return parts

    def may_meet(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the pieces may stand side by side; each pair is merged once in a process."""
        code = left.astype(np.int64) * (1 << 20) + right
        at = self.pairs.find(code)
        if (at < 0).any():
            new = np.unique(code[at < 0])
            self.pairs.add(new, np.fromiter((self._pair(c >> 20, c & ((1 << 20) - 1)) for c in new.tolist()), bool, len(new)))
            at = self.pairs.find(code)
        return self.pairs.good[at]

    def _pair(self, a: int, b: int) -> bool:
        x, y = self.text[a], self.text[b]
        return x + y not in self.rank and self._merge(x + y) == [x, y]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker process."""
    return Encoder(path)


def _suffix_array(codes: np.ndarray, depth: int, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of all suffixes by their first ``depth`` codes, and the keys (``63 // bits`` codes each) in that order."""
    per = 63 // bits
    keys = []
    padded = np.r_[codes, np.zeros(depth + per, np.int64)]
    for first in range(0, depth, per):
        k = np.zeros(len(codes), np.int64)
        for j in range(per):
            k = (k << bits) | (padded[first + j : first + j + len(codes)] if first + j < depth else 0)
        keys.append(k)
    order = np.argsort(keys[0]).astype(np.int32)
    first = keys[0][order]
    new = np.r_[True, first[1:] != first[:-1]]
    tied = np.flatnonzero(~(new & np.r_[new[1:], True]))  # few suffixes share a whole first key
    if len(tied) and len(keys) > 1:
        own = order[tied]
        order[tied] = own[np.lexsort([*(k[own] for k in keys[:0:-1]), np.cumsum(new)[tied]])]
    return order, [k[order] for k in keys]


def _search(keys: list[np.ndarray], want: list[np.ndarray], after: bool) -> np.ndarray:
    """For each wanted tuple the first place in the sorted ``keys`` that is not less (``after``: that is greater)."""
    n = len(keys[0])
    lo, hi = np.zeros(len(want[0]), np.int64), np.full(len(want[0]), n, np.int64)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = np.minimum((lo + hi) // 2, n - 1)
        less, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
        for k, w in zip(keys, want, strict=True):
            at = k[mid]
            less |= same & (at < w)
            same &= at == w
        go = open_ & (less | same if after else less)
        lo = np.where(go, mid + 1, lo)
        hi = np.where(open_ & ~go, mid, hi)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _pack(grid: np.ndarray, bits: int, per: int) -> list[np.ndarray]:
    """``per`` columns in one number, like the keys of suffixes."""
    wide = np.pad(grid, ((0, 0), (0, -grid.shape[1] % per)))
    return [sum(wide[:, f + j] << (bits * (per - 1 - j)) for j in range(per)) for f in range(0, wide.shape[1], per)]


def _edges(chars: np.ndarray, ends: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All occurrences of pieces in ``chars``, by a suffix array: start, end and piece.  ``ends``: no piece that starts here may go beyond.

    A character of no piece is an edge of its own, with the unknown piece.
    """
    alphabet = np.unique(chars)
    bits = max(2, int(len(alphabet) + 2).bit_length())
    per = 63 // bits
    order, keys = _suffix_array(np.searchsorted(alphabet, chars) + 1, v.depth, bits)  # 0 is beyond the text
    # the vocabulary's matrix in the numbers of this text's characters; pieces whose characters do not all occur go
    at = np.searchsorted(alphabet, v.alphabet)
    here = alphabet[np.minimum(at, len(alphabet) - 1)] == v.alphabet
    grid = np.r_[0, np.where(here, at + 1, -1)][v.grid]
    some = np.flatnonzero((grid >= 0).all(1))
    grid, ids, lens = grid[some], v.ids[some], v.lens[some]
    full = np.where(np.arange(v.depth) >= lens[:, None], (1 << bits) - 1, grid)
    low, high = _search(keys, _pack(grid, bits, per), False), _search(keys, _pack(full, bits, per), True)
    n = high - low
    s = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    t, e = np.repeat(ids, n), s + np.repeat(lens, n)
    inside = e <= ends[s]
    strange = np.flatnonzero(~np.isin(chars, v.single)).astype(np.int32)
    return np.r_[s[inside], strange], np.r_[e[inside], strange + 1], np.r_[t[inside], np.full(len(strange), v.unknown, np.int32)]


def _as_bytes(piece: np.ndarray, word: np.ndarray, odd_chars: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Unknown pieces, whose characters are ``odd_chars``, become these characters' bytes."""
    odd = np.flatnonzero(piece == v.unknown)
    if not len(odd):
        return piece, word
    raw = [chr(c).encode("utf-8", "replace") for c in odd_chars.tolist()]
    size = np.ones(len(piece), np.int64)
    size[odd] = [len(r) for r in raw]
    out = np.repeat(piece, size)
    begin = (np.cumsum(size) - size)[odd]
    k = size[odd]
    out[np.repeat(begin - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))] = np.array(v.bytes, np.int64)[np.frombuffer(b"".join(raw), np.uint8)]
    return out, np.repeat(word, size)


def encode_words(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one word after the other, and where each word's begin (one more than there are words).

    All words are relaxed at once, place by place: for words of moderate length.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.r_[0, np.cumsum(size)]
    chars = _points("".join(words))
    s, e, t = _edges(chars, np.repeat(begin[1:], size), v)
    # relax by place within the word, all words at once
    total, stop = len(chars), v.unknown
    last = np.full(total + 1, -1, np.int32)  # the piece that ends before each place (within the word that it is in)
    came = np.full(total + 1, -1, np.int32)
    depth_of = (e - np.repeat(begin[:-1], size)[s]).astype(np.uint16 if int(size.max()) < 1 << 16 else np.int64)
    by = np.argsort(depth_of, kind="stable")
    s, e, t, depth_of = s[by], e[by], t[by], depth_of[by]
    starts = np.searchsorted(depth_of, np.arange(1, int(size.max()) + 2))
    is_start = np.zeros(total + 1, bool)
    is_start[begin[:-1]] = True
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if a == b:
            continue
        sd, ed, td = s[a:b], e[a:b], t[a:b]
        first = is_start[sd]
        prev = np.where(first, stop, last[sd])  # ``last`` at a word's start belongs to the word before
        ok = first | ((td == stop) | (prev == stop)) & (prev >= 0)
        ask = np.flatnonzero(~ok & (prev >= 0))
        if len(ask):
            ok[ask] = v.may_meet(prev[ask], td[ask])
        ed = ed[ok]
        last[ed], came[ed] = td[ok], sd[ok]
    # walk back from the ends of all words at once
    at = begin[1:].copy()
    live = np.arange(len(words))
    got_word, got_piece, got_at = [], [], []
    while len(live):
        p = at[live]
        got_word.append(live)
        got_piece.append(last[p])
        got_at.append(came[p])
        at[live] = came[p]
        live = live[at[live] > begin[live]]
    word, piece, place = np.concatenate(got_word), np.concatenate(got_piece), np.concatenate(got_at)
    order = np.argsort(place, kind="stable")
    word, piece, place = word[order], piece[order], place[order]
    piece, word = _as_bytes(piece, word, chars[place[piece == stop]], v)
    return piece, np.searchsorted(word, np.arange(len(words) + 1))


def encode_long(text: str, v: Vocabulary, block: int = 1 << 15) -> np.ndarray:
    """Ids of one long word, indexed block by block and relaxed edge by edge: memory beside a few numbers per character is that of a block."""
    chars, stop = _points(text), v.unknown
    n = len(chars)
    last, back = np.full(n + 1, -1, np.int32), np.zeros(n + 1, np.uint8 if v.depth < 256 else np.int32)
    known: dict[int, bool] = {}
    tail = [-1] * (v.depth + 1)  # ``last`` of the places around the present one
    for lo in range(0, n, block):
        part = chars[lo : lo + block + v.depth]
        s, e, t = _edges(part, np.full(len(part), len(part)), v)
        here = s < block
        by = np.argsort(s[here], kind="stable")
        for a, b, piece in zip(s[here][by].tolist(), e[here][by].tolist(), t[here][by].tolist(), strict=True):
            a, b = a + lo, b + lo
            prev = stop if a == 0 else tail[a % (v.depth + 1)] if last[a] >= 0 else -1
            if prev < 0:
                continue
            if a and piece != stop and prev != stop:
                code = prev << 20 | piece
                ok = known.get(code)
                if ok is None:
                    ok = known[code] = v._pair(prev, piece)
                    if len(known) > 1 << 20:
                        known.clear()
                if not ok:
                    continue
            last[b], back[b], tail[b % (v.depth + 1)] = piece, b - a, piece
    out, at = [], n
    while at > 0:
        out.append(at)
        at -= int(back[at])
    at = np.array(out[::-1], np.int64)
    piece = last[at].astype(np.int64)
    return _as_bytes(piece, piece, chars[at[piece == stop] - 1], v)[0]


class Encoder:
    """Encodes batches; keeps the ids of at most ``most`` distinct words of ``most_chars`` characters from one batch to the next.

    Words of over ``long`` characters are encoded on their own and not kept.
    """

    def __init__(self, path: str = MODEL, most: int = 300_000, most_chars: int = 6 << 20, long: int = 256):
        self.v, self.most, self.most_chars, self.long = vocabulary(path), most, most_chars, long
        v = self.v
        self.high = np.zeros(len(v.text), bool)  # bytes that are only a part of a character
        self.plain = list(v.text)
        for i, b in v.fallback.items():
            self.high[i] = b >= 0x80
            self.plain[i] = chr(b)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.at, self.used, self.chars = np.zeros(1 << 20, np.int32), np.zeros(1 << 18, np.int64), 0, 0

    def units(self, text: str | None) -> list[str]:
        if not text:
            return []
        text = text.replace(" ", _SPACE)
        return _UNIT.findall(_SPACE + text if self.v.prefix else text)

    def _learn(self, new: list[str], step: int = 20_000) -> None:
        for i in range(0, len(new), step):
            part = new[i : i + step]
            short = [w for w in part if len(w) <= self.long]
            self._add(short, *encode_words(short, self.v))
            for w in part:
                if len(w) > self.long:
                    ids = encode_long(w, self.v)
                    self._add([w], ids, np.array([0, len(ids)]))

    def _add(self, new: list[str], ids: np.ndarray, at: np.ndarray) -> None:
        n, have = len(new), len(self.known)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while have + n + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[have : have + n + 1] = self.used + at
        self.used += len(ids)
        self.chars += sum(map(len, new))
        self.known.update(zip(new, range(have, have + n), strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        units = [self.units(t) for t in texts]
        every = set().union(*units)
        new = list(every.difference(self.known))
        if self.known and (len(new) + len(self.known) > self.most or self.chars + sum(map(len, new)) > self.most_chars):
            self._clear()
            new = list(every)
        if new:
            self._learn(new)
        get, out = self.known.__getitem__, []
        for x in units:
            i = np.fromiter(map(get, x), np.int64, len(x))
            n = self.at[i + 1] - self.at[i]
            total = int(n.sum())
            out.append(self.ids[np.repeat(self.at[i] - (np.cumsum(n) - n), n) + np.arange(total)])
        if self.chars > self.most_chars:
            self._clear()
        return out

    def decode(self, ids) -> str:
        """The text of ids; the space that encoding puts first is taken away.  Bytes that are no UTF-8 become U+FFFD."""
        v, out, raw = self.v, [], bytearray()
        if not self.high[np.asarray(ids, np.int64)].any():
            s = "".join(map(self.plain.__getitem__, ids)).replace(_SPACE, " ")
            return s[1:] if v.prefix and s.startswith(" ") else s
        fallback, text = v.fallback, v.text
        for i in ids:
            if i in fallback:
                raw.append(fallback[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(text[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        s = "".join(out).replace(_SPACE, " ")
        return s[1:] if v.prefix and s.startswith(" ") else s


def _groups(texts: pa.Array, most_bytes: int = 2 << 20):
    """Ranges of texts of so many bytes in all, or of one text."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    i = 0
    while i < len(size):
        j, n = i, 0
        while j < len(size) and (j == i or n + size[j] <= most_bytes):
            n += int(size[j])
            j += 1
        yield i, j
        i = j


def encode(docs: DataFrame, text_col: str = "text", path: str = MODEL) -> DataFrame:
    """``docs`` without the text, with ``ids``, ``n_tokens`` and ``round_trip``: whether decoding gives the text again.

    Null and empty texts have no ids (null and empty count as the same text).
    Columns of these three names are replaced.  Repeated rows stay.
    """
    keep = [c for c in docs.columns if c not in (text_col, "ids", "n_tokens", "round_trip")]

    def run(batches):
        enc = encoder(path)
        for b in batches:
            for i, j in _groups(b.column(0)):
                texts = b.column(0).slice(i, j - i).to_pylist()
                ids = enc.encode(texts)
                same = [enc.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts, strict=True)]
                size = np.array([len(x) for x in ids], np.int64)
                values = pa.array(np.concatenate(ids), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), values)
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], lists, pa.array(size), pa.array(same)], names=[*part.schema.names[1:], "ids", "n_tokens", "round_trip"])

    own = free("text", keep)
    d = docs.select(F.col(text_col).cast("string").alias(own), *keep)
    return in_small_batches(d).mapInArrow(run, d.drop(own).schema.add("ids", T.ArrayType(T.IntegerType())).add("n_tokens", "long").add("round_trip", "boolean"))


def decode(rows: DataFrame, ids_col: str = "ids", out_col: str = "text", path: str = MODEL) -> DataFrame:
    """``rows`` with ``ids_col`` replaced by its text; null ids give null."""
    keep = [c for c in rows.columns if c not in (ids_col, out_col)]

    def run(batches):
        enc = encoder(path)
        for b in batches:
            text = [None if x.as_py() is None else enc.decode(x.as_py()) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(text, pa.string())], names=[*b.schema.names[1:], out_col])

    own = free("ids", keep)
    d = rows.select(F.col(ids_col).cast("array<int>").alias(own), *keep)
    return in_small_batches(d).mapInArrow(run, d.drop(own).schema.add(out_col, "string"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256`` (of the ids in decimal, comma-joined) and ``round_trip`` of all documents."""
    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "round_trip")


QUERIES = {"op8_sentencepiece": op8_sentencepiece}
ORACLE: dict[str, str] = {}
