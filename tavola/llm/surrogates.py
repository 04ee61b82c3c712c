"""Surrogates for personal data: keyed, type-consistent and distinct.

Detected entities are brought to a canonical form (the national digits of a
phone number, an address in lower case), so that every spelling of one entity
gets one surrogate.  A surrogate is a keyed permutation of the canonical form:
every character moves within its class (digit, vowel or consonant of its
script, or the letters near it for other scripts), by a Feistel network over
the characters, so length, script, format and the country of a number stay, and
different entities of one shape get different surrogates.  Check digits are
made right.  The last letter of a name shows the gender that its title tells,
taken over the whole corpus, else it stays.

Collision checks over the whole corpus: a surrogate that is itself an entity
of the corpus, or that two entities share, is drawn anew under the next tweak.
Shapes of which the corpus has over half of all possible entities leave no
room for that: all their entities take one permutation without fixed
points, which keeps them distinct by itself.  So do shapes still in conflict
after 64 draws; as shapes are finite in number and a shape that has gone over
is never drawn again, the draws end.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import in_small_batches, materialize, release
from .tables import free, table

#: Alphabets within which a character is replaced; case is kept.
_CLASSES = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àâéèêëîïôöûüùáíóúäåæø", "çñßšžčćłńśżř", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρσςτφχψ")
_CLASS_OF = {c: (a, i) for a in _CLASSES for i, c in enumerate(a)}
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_BEFORE_AT = re.compile(r"[\w.%+'-]")
_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
_NUMBER = re.compile(
    rf"""(?P<ip>(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d))
    |(?P<ssn>(?<![\d-])\d{{3}}-\d{{2}}-\d{{4}}(?![\d-]))
    |(?P<phone>(?<![\w+])(?:\+\d{{1,3}}[ .-]?)?\(\d{{2,4}}\)[ .-]?\d{{3,4}}[ .-]?\d{{3,4}}(?!\w)|(?<![\w.])\+\d{{1,3}}(?:[ .-]?\(0\))?(?:[ .-]?\d{{2,4}}){{2,5}}(?!\w)|(?<![\w.-])\d{{3}}[.-]\d{{3}}[.-]\d{{4}}(?![\w-]))
    |(?P<card>(?<![\w.,])\d(?:[ -]?\d){{12,18}}(?![\w]))""",
    re.X,
)
_SECRET = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])")
_ASSIGNED = re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s*[:=]\s*[\"']?(?P<value>[^\s\"'<>|,;]{8,})")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
#: Gender -> titles; those without one tell nothing.
_TITLES = {"f": "Mrs|Ms|Miss|Frau|Madame|Mlle|Mme|Señora|Sra|Doña|г-жа|κα", "m": "Mr|Herrn?|Monsieur|Señor|Sr|Don|г-н|κ", "": "Dr|Prof"}
_PART = r"[^\W\d_a-zа-яα-ω][^\W\d_]+"
_NAME = re.compile(rf"\b(?:{'|'.join(f'(?P<t{g}>{t})' for g, t in _TITLES.items())})\.?[  ](?P<name>{_PART}(?:[ -]{_PART}){{0,2}})")
_CUE = re.compile(rf"\b(?:[Mm]y name is|[Ii]ch heiße|[Mm]ein Name ist|[Jj]e m'appelle|[Mm]e llamo|[Mm]i nombre es|[Мм]еня зовут|[Μμ]ε λένε) (?P<name>{_PART}(?:[ -]{_PART}){{0,2}})")
#: One of these is in every such phrase.
_CUE_WORDS = ("name is ", "heiße ", "Name ist ", "appelle ", "llamo ", "nombre es ", "зовут ", "λένε ")
#: Script of the last letter -> the letters that names of a gender end in.
_ENDINGS = {"f": ("a", "ая", "αη"), "m": ("nrlsdkot", "нрлвйсдк", "ςσ")}
_SCRIPTS = ("abcdefghijklmnopqrstuvwxyzàâéèêëîïôöûüùáíóúäåæøçñßšžčćłńśżř", "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρσςτυφχψω")
#: Calling codes of one and of two digits; all others have three.
_ONE, _TWO = ("1", "7"), "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
_DRAWS = 64
#: The tweak of the permutation without fixed points.
_PLAIN = -1


@lru_cache(maxsize=1 << 16)
def _class_of(c: str) -> tuple[str, int] | None:
    """The class of a character and its place in it; null if it stays.  Letters of other scripts: those of the same kind among the 64 code points around."""
    if c in _CLASS_OF:
        return _CLASS_OF[c]
    if not c.isalpha() or c.isascii():
        return None
    first, kind = ord(c) & ~63, unicodedata.category(c)
    near = "".join(chr(x) for x in range(first, first + 64) if unicodedata.category(chr(x)) == kind and chr(x).lower() == chr(x) and chr(x) not in _CLASS_OF)
    return (near, near.index(c)) if c in near else None


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _network(digits: str) -> int:
    """How many first digits name a card's network; 0 if none has such a number."""
    if not luhn(digits):
        return 0
    n = len(digits)
    if digits[0] == "4" and n in (13, 16, 19):
        return 1
    if n == 16 and "51" <= digits[:2] <= "55" or n == 15 and digits[:2] in ("34", "37") or n == 16 and digits[:2] == "65":
        return 2
    if n == 16 and ("2221" <= digits[:4] <= "2720" or digits[:4] == "6011" or "6440" <= digits[:4] <= "6499"):
        return 4
    return 0


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _shift(key: bytes, what: str, other: list[int], n: int) -> list[int]:
    raw = hashlib.shake_256(key + b"\0" + what.encode("utf-8", "replace") + b"\0" + ",".join(map(str, other)).encode()).digest(4 * n)
    return [int.from_bytes(raw[4 * i : 4 * i + 4], "big") for i in range(n)]


def permute(values: list[int], radix: list[int], key: bytes, tweak: str, rounds: int = 6, inverse: bool = False) -> list[int]:
    """A keyed permutation of all value lists of these radices."""
    half = [values[0::2], values[1::2]]
    sizes = [radix[0::2], radix[1::2]]
    for k in reversed(range(rounds)) if inverse else range(rounds):
        own = k % 2
        shift = _shift(key, f"{tweak}:{k}", half[1 - own], len(half[own]))
        half[own] = [(v - s if inverse else v + s) % r for v, s, r in zip(half[own], shift, sizes[own], strict=True)]
    out = [0] * len(values)
    out[0::2], out[1::2] = half
    return out


def _moved(values: list[int], radix: list[int], key: bytes, tag: str, tweak: int) -> list[int]:
    """``permute`` under a tweak; or, for ``_PLAIN``, the one place on in a keyed order of all value lists, which no list but an only one has for itself."""
    if tweak != _PLAIN:
        return permute(values, radix, key, f"{tag}:{tweak}")
    at = permute(values, radix, key, tag)
    for i, r in enumerate(radix):
        at[i] = (at[i] + 1) % r
        if at[i]:
            break
    return permute(at, radix, key, tag, inverse=True)


def _private(o: list[int]) -> bool:
    return o[0] in (0, 10, 127) or o[0] >= 224 or o[:2] == [192, 168] or o[0] == 172 and 16 <= o[1] < 32 or o[:2] == [169, 254]


def _calling_code(found: str) -> int:
    """Length of the country's calling code in digits; 0 without a plus sign."""
    digits = re.sub(r"\D", "", found)
    if not found.startswith("+"):
        return 0
    return 1 if digits[:1] in _ONE else 2 if digits[:2] in _TWO else 3


def canonical(kind: str, found: str) -> str:
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", found)
    if kind == "phone":  # national digits, without the trunk's zero
        return re.sub(r"\D", "", found)[_calling_code(found) :].lstrip("0")
    if kind == "iban":
        return found.replace(" ", "")
    return found if kind == "secret" and not _SECRET.fullmatch(found) else found.lower()


def _anatomy(kind: str, canon: str) -> tuple[list[int], list[str]]:
    """Which characters of a canonical form move, and the alphabet of each."""
    if kind == "secret" and _SECRET.fullmatch(canon):
        return list(range(len(canon))), ["0123456789abcdef"] * len(canon)
    start, stop = 0, len(canon)
    if kind == "card":  # the last is a check digit
        start, stop = max(1, _network(canon)), len(canon) - 1
    elif kind == "iban":
        start = 4
    elif kind == "email":
        stop = canon.rindex(".")
    low = canon.lower() if len(canon.lower()) == len(canon) else canon
    at = [(i, _class_of(low[i])) for i in range(start, stop)]
    if kind == "name" and at and at[-1][1] and at[-1][1][0] in ("aeiou", "аеиоуыэюя", "αεηιουω"):
        at.pop()  # an ending in a vowel carries gender
    at = [(i, "123456789" if kind == "phone" and not i else c[0]) for i, c in at if c]
    return [i for i, _ in at], [a for _, a in at]


def room(kind: str, canon: str) -> int:
    """How many entities of its shape there can be."""
    if kind == "ip":
        return 1 << 16 if _private([int(x) for x in canon.split(".")]) else 1 << 31
    n = 1
    for a in _anatomy(kind, canon)[1]:
        n *= len(a)
    return n


def shape(kind: str, canon: str) -> str:
    """What all surrogates of an entity share with it: entities of two shapes are never confused."""
    if kind == "ip":
        o = [int(x) for x in canon.split(".")]
        return f"ip:{o[:2] if _private(o) else ''}"
    chars = list(canon)
    for i, a in zip(*_anatomy(kind, canon), strict=True):
        chars[i] = f"[{a[0]}{'^' if chars[i].isupper() else ''}]"
    if kind == "card":
        chars[-1] = "?"
    elif kind == "iban":
        chars[2:4] = "??"
    return f"{kind}:{''.join(chars)}"


def surrogate(kind: str, canon: str, key: bytes, tweak: int = 0, gender: str = "") -> str:
    """The canonical form that stands for ``canon``; itself only if nothing in it can move."""
    tag = shape(kind, canon)
    if kind == "ip":
        octets = [int(x) for x in canon.split(".")]
        if _private(octets):
            return ".".join(map(str, octets[:2] + _moved(octets[2:], [256, 256], key, tag, tweak)))
        while True:  # walks the cycle until the address is public again
            octets = _moved(octets, [256] * 4, key, tag, tweak)
            if not _private(octets):
                return ".".join(map(str, octets))
    at, classes = _anatomy(kind, canon)
    chars = list(canon.lower() if len(canon.lower()) == len(canon) else canon)
    values = _moved([a.index(chars[i]) for i, a in zip(at, classes, strict=True)], [len(a) for a in classes], key, tag, tweak)
    for i, v, a in zip(at, values, classes, strict=True):
        chars[i] = a[v]
    new = "".join(chars)
    if kind == "card":
        return next(new[:-1] + d for d in "0123456789" if luhn(new[:-1] + d))
    if kind == "iban":
        new = canon[:2] + "00" + new[4:].upper()
        return f"{new[:2]}{98 - _mod97(new):02d}{new[4:]}"
    if kind == "name" and gender and tweak != _PLAIN:
        ends = next((_ENDINGS[gender][i] for i, letters in enumerate(_SCRIPTS) if canon[-1] in letters), "")
        if ends:
            new = new[:-1] + ends[_shift(key, f"{tag}:{tweak}:{new}", [], 1)[0] % len(ends)]
    if kind == "secret" and not _SECRET.fullmatch(canon):
        return "".join(s.upper() if c.isupper() else s for s, c in zip(new, canon, strict=True))
    return new


def _dressed(kind: str, found: str, canon: str, new: str) -> str:
    """``new`` in the spelling of ``found``: its separators and its case."""
    if kind in ("ip",):
        return new
    if kind in ("card", "ssn", "phone", "iban"):
        keep = len(re.sub(r"[^0-9A-Za-z]", "", found)) - len(new)  # a country code and the trunk's zero
        out, i = [], -keep
        for c in found:
            if c.isalnum():
                out.append(c if i < 0 else new[i])
                i += 1
            else:
                out.append(c)
        return "".join(out)
    if len(new) != len(found):
        return new
    return "".join(n.upper() if c.isupper() and len(n.upper()) == 1 else n for n, c in zip(new, found, strict=True))


def _names(text: str) -> dict[str, set[str]]:
    """Parts of names that a title or a phrase introduces, and the genders that titles tell.

    A title tells the gender of the given name before another part; where
    family names are inflected (Cyrillic, Greek) that of all parts.
    """
    out: dict[str, set[str]] = {}
    for pattern in (_NAME, _CUE) if any(x in text for x in _CUE_WORDS) else (_NAME,):
        for m in pattern.finditer(text):
            parts = [x for x in re.split(r"[ -]", m["name"]) if len(x) > 1]
            told = next((g for g in ("f", "m") if pattern is _NAME and m[f"t{g}"]), "")
            for i, x in enumerate(parts):
                own = told and (i == 0 and len(parts) > 1 or x[0].lower() in _SCRIPTS[1] + _SCRIPTS[2])
                out.setdefault(x, set()).update({told} if own else ())
    return out


def _find(text: str | None) -> tuple[list[tuple[int, int, str]], dict[str, set[str]]]:
    if not text:
        return [], {}
    hits: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))

    def add(a: int, b: int, kind: str) -> None:
        if taken.find(1, a, b) < 0 and room(kind, canonical(kind, text[a:b])) > 1:
            taken[a:b] = b"\1" * (b - a)
            hits.append((a, b, kind))

    last = 0
    for m in re.finditer("@", text):
        a = m.start()
        while a > last and _BEFORE_AT.match(text[a - 1]):
            a -= 1
        d = _DOMAIN.match(text, m.end())
        if d and a < m.start() and re.match(r"[\w%+]", text[m.start() - 1]):
            add(a, d.end(), "email")
            last = d.end()
        else:
            last = m.end()
    if re.search(r"\d", text):
        for m in _SECRET.finditer(text):
            add(m.start(), m.end(), "secret")
        for m in _IBAN.finditer(text):
            if _mod97(m[0].replace(" ", "")) == 1:
                add(m.start(), m.end(), "iban")
        for m in _NUMBER.finditer(text):
            kind = m.lastgroup
            if kind != "card" or _network(re.sub(r"\D", "", m[0])):
                add(m.start(), m.end(), kind)
    if "=" in text or ":" in text:
        for m in _ASSIGNED.finditer(text):
            add(m.start("value"), m.end("value"), "secret")
    names = _names(text)
    if names:  # with or without title, each part of a name that this text has introduced
        for m in re.finditer(r"\w+", text):
            if m[0] in names:
                add(m.start(), m.end(), "name")
    return sorted(hits), {canonical("name", x): g for x, g in names.items()}


def find(text: str | None) -> list[tuple[int, int, str]]:
    """Entities as (start, end, kind): in order, without overlap; of those that overlap the first found by kind.

    What has no character that can move (a mask of asterisks) is no entity.
    Time is linear in the text.
    """
    return _find(text)[0]


def replace(text: str | None, key: bytes, told: dict[tuple[str, str], tuple[int, str]] | None = None) -> tuple[str | None, int]:
    """The text with surrogates, and how many entities it had.  ``told``: tweak and gender of those that have them."""
    hits = find(text)
    if not hits:
        return text, 0
    out, at = [], 0
    for a, b, kind in hits:
        canon = canonical(kind, text[a:b])
        new = surrogate(kind, canon, key, *(told or {}).get((kind, canon), (0, "")))
        out += [text[at:a], _dressed(kind, text[a:b], canon, new)]
        at = b
    return "".join([*out, text[at:]]), len(hits)


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``th, kind, canon, f, m``: the distinct entities of each text, and whether titles there tell a gender of a name.  Null texts have none."""
    text = F.col(text_col).cast("string")

    def run(batches):
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for t, h in zip(b.column(0), b.column(1), strict=True):
                s = t.as_py()
                hits, told = _find(s)
                for kind, canon in sorted({(k, canonical(k, s[x:y])) for x, y, k in hits}):
                    g = told.get(canon, ()) if kind == "name" else ()
                    for col, v in zip(out, (h.as_py(), kind, canon, "f" in g, "m" in g), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["th", "kind", "canon", "f", "m"])

    return in_small_batches(docs).select(text.alias("t"), F.xxhash64(text).alias("th")).where("t is not null").mapInArrow(run, "th long, kind string, canon string, f boolean, m boolean")


_ENTITY = ["kind", "canon", "gender", "tweak"]


def _with_surrogate(rows: DataFrame, key: bytes) -> DataFrame:
    """``rows (kind, canon, gender, tweak)`` with ``new``, ``shape`` (hashed) and ``room``."""

    def run(batches):
        for b in batches:
            rows = list(zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
            new = [surrogate(k, c, key, t, g) for k, c, g, t in rows]
            shapes = [hashlib.sha256(shape(k, c).encode("utf-8", "replace")).hexdigest()[:32] for k, c, _, _ in rows]
            rooms = [min(room(k, c), 1 << 60) for k, c, _, _ in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string()), pa.array(shapes, pa.string()), pa.array(rooms, pa.int64())], names=[*b.schema.names, "new", "shape", "room"])

    return rows.select(*_ENTITY).mapInArrow(run, "kind string, canon string, gender string, tweak int, new string, shape string, room long")


def _plainly(now: DataFrame, shapes: DataFrame, key: bytes) -> DataFrame:
    """``now`` with all entities of ``shapes`` under the permutation without fixed points."""
    moved = now.join(shapes, "shape", "left_semi").withColumn("tweak", F.lit(_PLAIN))
    return now.join(shapes, "shape", "left_anti").unionByName(_with_surrogate(moved, key))


def tweaks_of(found: DataFrame, key: bytes) -> DataFrame:
    """``kind, canon, gender, tweak`` of entities whose surrogate is not that of tweak 0 without gender.

    ``found (kind, canon, f, m)`` may repeat entities; titles of both genders
    for one name tell nothing.  Only entities in conflict are drawn anew.
    """
    gender = F.when(F.max("f") & ~F.max("m"), "f").when(F.max("m") & ~F.max("f"), "m").otherwise("")
    known = materialize(found.groupBy("kind", "canon").agg(gender.alias("gender")).withColumn("tweak", F.lit(0)), "entities")
    n = known.count()
    now = materialize(_with_surrogate(known, key), "surrogates")
    full = materialize(now.groupBy("shape", "room").agg(F.count("*").alias("c")).where("2 * c > room").select("shape"), "full-shapes", n)
    draws = 0
    if not full.isEmpty():
        now = materialize(_plainly(now, full, key), "surrogates", n)
    while True:
        real = known.select("kind", F.col("canon").alias("new"))
        shared = materialize(now.groupBy("kind", "new").agg(F.count("*").alias("n"), F.min(F.struct("tweak", "canon")).alias("first")).where("n > 1"), "shared", n)
        bad = now.join(shared.select("kind", "new", F.col("first.canon").alias("first")), ["kind", "new"]).where("canon <> first").select("kind", "canon", "shape", "tweak")
        bad = bad.unionByName(now.join(real, ["kind", "new"], "left_semi").select("kind", "canon", "shape", "tweak")).where(F.col("tweak") != _PLAIN).distinct()
        bad = materialize(bad, "conflicts", n)
        if bad.isEmpty():
            return now.where("tweak <> 0 or gender <> ''").select(*_ENTITY)
        draws += 1
        if draws % _DRAWS == 0:
            nxt = _plainly(now, bad.select("shape").distinct(), key)
        else:
            again = now.join(bad, ["kind", "canon"], "left_semi").withColumn("tweak", F.col("tweak") + 1)
            nxt = now.join(bad, ["kind", "canon"], "left_anti").unionByName(_with_surrogate(again, key))
        nxt = materialize(nxt, "surrogates", n)
        release(now, bad, shared)
        now = nxt


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in its text, and ``n_entities`` (replaced if there).

    One key gives one surrogate for an entity in all texts; an empty key is
    refused.  Null texts stay null, texts without entities stay as they are.
    Repeated rows stay.
    """
    if not key:
        raise ValueError("a key is needed: surrogates are only as secret as it is")
    secret = hashlib.sha256(key.encode()).digest()
    found = materialize(entities(docs, text_col), "found")
    moved = materialize(tweaks_of(found, secret), "moved")
    keep = [c for c in docs.columns if c not in (text_col, "n_entities")]
    t, h, told = (free(x, keep) for x in ("text", "hash", "told"))
    text = F.col(text_col).cast("string")
    d = docs.select(*keep, text.alias(t))
    if moved.isEmpty():
        d = d.withColumn(told, F.lit(None).cast("string"))
    else:
        own = found.join(moved, ["kind", "canon"]).groupBy(F.col("th").alias(h)).agg(F.to_json(F.collect_list(F.struct(*_ENTITY))).alias(told))
        d = d.join(own, F.xxhash64(t) == F.col(h), "left")
    d = d.select(t, told, *keep)

    def run(batches):
        import json

        for b in batches:
            out = []
            for x, m in zip(b.column(0), b.column(1), strict=True):
                own = {(e["kind"], e["canon"]): (e["tweak"], e["gender"]) for e in json.loads(m.as_py())} if m.is_valid else None
                out.append(replace(x.as_py(), secret, own))
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], names=[*b.schema.names[2:], text_col, "n_entities"])

    done = in_small_batches(d).mapInArrow(run, d.drop(t, told).schema.add(text_col, "string").add("n_entities", "long"))
    return done.select(*[c for c in docs.columns if c != "n_entities"], "n_entities")


#: Of the registered query alone: it makes its results the same in every run.
_TEST_KEY = "known to everybody; for tests only"


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text, n_entities`` of all documents, under the key of the setting ``spark.tavola.surrogate.key``, else one for tests."""
    key = spark.conf.get("spark.tavola.surrogate.key", None) or _TEST_KEY
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


QUERIES = {"op4_surrogates": op4_surrogates}
ORACLE: dict[str, str] = {}
