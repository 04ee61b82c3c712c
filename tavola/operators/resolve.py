"""Canonical names: curated synonyms first, then groups of similar names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tavola.functions import values as V
from tavola.functions.rules import first_contained
from tavola.functions.text import tokens
from tavola.operators.keymatch import best_keys
from tavola.operators.lemmas import ranked
from tavola.operators.lineage import cut, pick, stored
from tavola.operators.nearsets import near_pairs


def curated_pairs(groups=V.SYNONYMS) -> list[tuple[str, str]]:
    """(key, canonical) in order of priority; a key that comes again keeps its place and takes the later name."""
    out: dict[str, str] = {}
    for canonical, variants in groups:
        for key in (canonical, *variants):
            out[key.lower()] = canonical
    return list(out.items())


def curated_match(name: Column, pairs: list[tuple[str, str]]) -> Column:
    """Canonical name of the key that the name is, else of the first that it contains; null without one.  No join: for tables of some hundred keys."""
    low = F.lower(name)
    if not pairs:
        return F.lit(None).cast("string")
    exact = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    return F.coalesce(F.try_element_at(exact, low), first_contained(low, pairs))


def curated_join(names: DataFrame, synonyms: DataFrame, name: str = "dish_name", shard_chars: int = 1_000_000) -> DataFrame:
    """``names`` with ``curated``, for tables ``synonyms (ordinal, key, canonical)`` too large for an expression; see ``best_keys``."""
    best = best_keys(names.select(F.lower(name).alias("low")), synonyms, shard_chars)
    return names.withColumn("_low", F.lower(name)).join(best.select(F.col("low").alias("_low"), F.col("canonical").alias("curated")), "_low", "left").drop("_low")


def token_classes(sets: DataFrame) -> DataFrame:
    """``id, class_id`` of ``sets (id, tokens)``: the least id that has the same set of tokens.  Sets without a token are left out."""
    rows = sets.select("id", F.array_sort("tokens").alias("tokens")).where(F.size("tokens") > 0)
    return rows.join(rows.groupBy("tokens").agg(F.min("id").alias("class_id")), "tokens").select("id", "class_id")


def digest_of(tokens: str) -> Column:
    """``digest`` of a sorted token set, in place of the set where classes are made; tokens have no spaces."""
    return F.unhex(F.sha2(F.array_join(tokens, " "), 256)).alias("digest")


def not_first(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """``row`` of all ``rows`` but the first one, by ``order``, of each ``key``."""
    first = rows.groupBy(key).agg(F.min(F.struct(order.alias("o"), "row")).getField("row").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    return rows.select(key, "row").join(first, key).where("row <> _first").select("row")


def verified(pairs: DataFrame, sets: DataFrame, num: int) -> DataFrame:
    """Those of ``pairs (a, b)``, each given once, whose ``sets (id, tokens)`` have a similarity of ``num`` thousandths or more."""
    ids = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "id")
    some = pick(sets.select("id", "tokens"), stored(ids, "ids"), "left_semi", "id")
    both = pairs.join(some.select(F.col("id").alias("a"), F.col("tokens").alias("s")), "a").join(some.select(F.col("id").alias("b"), F.col("tokens").alias("t")), "b")
    shared = F.size(F.array_intersect("s", "t"))
    return both.where(1000 * shared >= num * (F.size("s") + F.size("t") - shared)).select("a", "b")


def similar_pairs(sets: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``a, b`` (a < b): ids of ``sets (id, tokens)``, no two of them equal, with a Jaccard similarity of ``threshold`` or more.

    Those of ``near_pairs`` are verified, each once.  Sets so small that no
    other can be similar are left out first.  ``sets`` are read more than
    once, so they should be a stored table; ids are integers.
    """
    num = round(threshold * 1000)
    sets = sets.select("id", "tokens", F.lit(True).alias("fresh")).where(F.size("tokens") * 1000 >= num * (F.size("tokens") + 1))
    return verified(stored(near_pairs(sets, num), "pairs"), sets, num)


def leaders(edges: DataFrame) -> DataFrame:
    """``id, leader`` for every id that joins one: in rising order each id joins its least earlier leader that it has an edge to, else leads.

    ``edges (a, b)`` with a < b.  In every round the ids without an undecided
    lower neighbour lead and their neighbours join; edges of decided ids go,
    so each round has only the edges between undecided ones.
    """
    e = cut(edges)
    joined, left = e.select("b").limit(0), e
    while not left.isEmpty():
        heads = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        new = cut(left.join(heads, "a", "left_semi").select("b").distinct())
        left = cut(left.join(heads, "a", "left_anti").join(new, "b", "left_anti").join(new.select(F.col("b").alias("a")), "a", "left_anti").select("a", "b"))
        joined = joined.unionByName(new)
    lead = e.join(joined.select(F.col("b").alias("a")), "a", "left_anti").join(joined, "b", "left_semi")
    return lead.groupBy("b").agg(F.min("a").alias("leader")).select(F.col("b").alias("id"), "leader")


def auto_groups(dishes: DataFrame, threshold: float = 0.85, lemmas: str | None = "lemmas") -> DataFrame:
    """``dish_name, canonical_name`` of names that join an earlier, similar one.

    Names come by falling ``count``, then by name.  Names with one token set
    share the fate of the first of them; names without a token stay alone.
    Without ``lemmas`` a name may come in several rows, whose counts add up.

    ``dishes`` are read twice: for their tokens, and for the names that have
    others like them; only these are sorted, and no other name is shuffled.
    """
    text = F.col("dish_name")
    if lemmas and lemmas in dishes.columns:
        joined = F.array_join(lemmas, " ") if dict(dishes.dtypes)[lemmas].startswith("array") else F.col(lemmas)
        text = F.when(F.coalesce(joined, F.lit("")) != "", joined).otherwise(text)
    named = dishes.groupBy("dish_name").agg(F.max("count").alias("count"), F.min(text).alias("_text")) if lemmas else dishes.withColumn("_text", text)
    sets = named.select(F.monotonically_increasing_id().alias("row"), name_key("dish_name"), "count", F.array_sort(tokens(F.col("_text"))).alias("tokens"))
    sets = stored(sets.select("*", digest_of("tokens")), "names").where(F.size("tokens") > 0)
    later = stored(not_first(sets, "digest", F.col("row")), "later")
    edges = stored(similar_pairs(pick(sets, later, "left_anti").select(F.col("row").alias("id"), "tokens"), threshold), "edges")
    classes = sets.groupBy("digest").agg(F.min("row").alias("id"), (F.min("name") != F.max("name")).alias("many"))
    return grouped(sets.select("name", "digest", "count"), classes, edges, named.select("dish_name"))


def name_key(name: str) -> Column:
    """``name`` in few bytes."""
    return F.unhex(F.sha2(name, 256)).alias("name")


def grouped(rows: DataFrame, classes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """``dish_name, canonical_name`` from ``rows (name, digest, count)``, their ``classes (digest, id, many)``, ``edges (a, b)`` between the ids of classes, and all ``names (dish_name)``."""
    linked = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("linked", F.lit(True))
    some = classes.join(linked, "id", "left").where("many or linked").select("digest", "id")
    some = stored(rows.join(some, "digest").groupBy("name").agg(F.first("id").alias("id"), F.sum("count").alias("count")), "some")
    found = pick(names.select("dish_name", name_key("dish_name")), some, "inner", "name").groupBy("dish_name").agg(F.first("id").alias("id"), F.first("count").alias("count"))
    ranks = stored(ranked(found, "count", "dish_name", "long").select("dish_name", "id", "rank"), "ranks")
    first = cut(ranks.groupBy("id").agg(F.min("rank").alias("first")))
    at = lambda c, to: first.select(F.col("id").alias(c), F.col("first").alias(to))
    lines = edges.join(at("a", "p"), "a").join(at("b", "q"), "b").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    head = first.join(leaders(lines).withColumnRenamed("id", "first"), "first", "left").select("id", F.coalesce("leader", "first").alias("leader"))
    own = ranks.join(head, "id").where("rank <> leader").select("dish_name", "leader")
    return own.join(ranks.select(F.col("rank").alias("leader"), F.col("dish_name").alias("canonical_name")), "leader").select("dish_name", "canonical_name")


def resolve(categorized: DataFrame, pairs: list[tuple[str, str]] | None = None, threshold: float = 0.85) -> DataFrame:
    """``categorized`` with ``canonical_name`` and ``match_type`` (curated, auto or null)."""
    rows = categorized.withColumn("_curated", curated_match(F.col("dish_name"), curated_pairs() if pairs is None else pairs))
    auto = auto_groups(rows.where("_curated is null"), threshold).withColumnRenamed("canonical_name", "_auto")
    out = rows.join(auto, "dish_name", "left")
    kind = F.when(F.col("_curated").isNotNull(), "curated").when(F.col("_auto").isNotNull(), "auto")
    return out.select(*categorized.columns, F.coalesce("_curated", "_auto", "dish_name").alias("canonical_name"), kind.alias("match_type"))


def synonym_groups(resolved: DataFrame) -> DataFrame:
    """``canonical_name, variant_name, match_type`` of all matched names, by variant."""
    return resolved.where("match_type is not null").select("canonical_name", F.col("dish_name").alias("variant_name"), "match_type").orderBy("variant_name")
