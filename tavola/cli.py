"""Stages as commands: ``python -m tavola.cli STAGE ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.functions import values as V
from tavola.operators import categorize, dishes, lemmas, menus, observed, resolve, seasonal, sinks
from tavola.session import session
from tavola.sources import files, pages, web


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tavola")
    s = p.add_subparsers(dest="stage", required=True)

    def stage(name: str, *options: tuple[str, dict]) -> None:
        q = s.add_parser(name)
        for flag, how in options:
            q.add_argument(flag, **how)

    need = {"required": True}
    stage("fetch", ("--site", need), ("--output", need), ("--first", {}), ("--last", {}))
    stage("text", ("--pages", need), ("--output", need))
    stage("menus", ("--pages", need), ("--output", need), ("--strict-logos", {"action": "store_true"}), ("--close-p", {"action": "store_true"}))
    stage("dishes", ("--menus", need), ("--output", need))
    stage("lemmas", ("--csv", need), ("--model", {"default": "identity"}), ("--pairs", {}), ("--output", need))
    stage("dictionary", ("--input", need), ("--output-csv", need), ("--output-json", {}), ("--min-frequency", {"type": int, "default": 1}), ("--filter-punctuation", {"action": "store_true"}))
    stage("categorize", ("--input", need), ("--output", need), ("--stats", {}))
    stage("synonyms", ("--input", need), ("--synonym-map", {}), ("--output", need), ("--groups", need), ("--threshold", {"type": float, "default": 0.85}))
    stage("seasonal", ("--menus", need), ("--dishes", need), ("--output-monthly", need), ("--output-summary", need), ("--output-json", {}), ("--min-count", {"type": int, "default": 10}))
    stage("clean", ("--output", need))
    return p


def _show(title: str, few: DataFrame) -> None:
    """A report of a few rows on the console."""
    rows = few.collect()
    print(f"{title}:")
    for r in rows:
        print("  " + "  ".join(f"{k}={v}" for k, v in r.asDict().items()))


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = session()
    if a.stage == "fetch":
        spark.dataSource.register(web.daily_pages())
        days = {k: v for k, v in (("first", a.first), ("last", a.last)) if v}
        saved = web.save_pages(spark.read.format("daily_pages").options(site=a.site, **days).load(), a.output)
        _show("pages", saved.orderBy("date"))
    elif a.stage == "text":
        raw = pages.read_pages(spark, a.pages)
        text = pages.page_text(raw, "content")
        sinks.write_text(text.select(F.explode(F.split("text", "\n", -1)).alias("value")), f"{a.output}/dump")
        sinks.write_csv(pages.line_frequency(text).orderBy(F.desc("n"), "line"), f"{a.output}/group_by")
    elif a.stage == "menus":
        rows = menus.daily_menus(pages.page_elements(pages.read_pages(spark, a.pages), a.close_p), a.strict_logos)
        sinks.write_parquet(rows.withColumn("year", F.substring("date", 1, 4)), a.output, "year")
    elif a.stage == "dishes":
        found = dishes.clean_dishes(dishes.dish_count(spark.read.parquet(a.menus)))
        sinks.write_csv(found, a.output)
        _show("most frequent dishes", found.orderBy(F.desc("count"), "dish_name").limit(30))
    elif a.stage == "lemmas":
        counts = files.read_csv(spark, a.csv, "dish_name string, count long")
        named = files.without_header_rows(counts, "dish_name")
        backend, options = (a.model, {}) if a.model in lemmas.BACKENDS else ("spacy", {"model": a.model})
        if backend == "learned":
            options = {"pairs": files.read_csv(spark, a.pairs, "word string, lemma string")}
        out = lemmas.lemmatize(named, backend, **options)
        out = out.withColumn("lemmas", F.array_join("lemmas", " "))
        sinks.write_csv(out, a.output)
        _show("first rows", out.orderBy(F.desc("score"), "dish_name").limit(3))
    elif a.stage == "dictionary":
        rows = files.without_header_rows(files.read_strings(spark, a.input), "lemmas")
        found = lemmas.lemma_dictionary(rows, "lemmas", a.min_frequency, a.filter_punctuation)
        sinks.write_csv(found.orderBy("rank"), a.output_csv)
        if a.output_json:
            sinks.write_dictionary(found, a.output_json)
        _show("tokens", lemmas.lemma_counts(rows))
        _show("dictionary", lemmas.lemma_stats(found))
        _show("most frequent lemmas", found.where("rank <= 10").orderBy("rank"))
    elif a.stage == "categorize":
        rows = files.without_header_rows(files.read_csv(spark, a.input, "dish_name string, score long, lemmas string"), "dish_name")
        out = categorize.categorize(rows)
        sinks.write_csv(out, a.output)
        if a.stats:
            sinks.write_report(categorize.category_stats(out), a.stats)
        _show("rows", categorize.counts(rows))
        _show("labels", categorize.label_share(out).orderBy("dimension", F.desc("n"), "label"))
    elif a.stage == "synonyms":
        rows = files.read_csv(spark, a.input, "dish_name string, count long, lemmas string, course string, protein string, cooking_method string")
        pairs = resolve.curated_pairs(V.SYNONYMS)
        if a.synonym_map:
            rows_of = files.read_synonyms(spark, a.synonym_map).orderBy("ordinal").collect()  # a curated table
            pairs = [(r.key, r.canonical) for r in rows_of]
        out = resolve.resolve(rows, pairs, a.threshold)
        sinks.write_csv(out.drop("match_type"), a.output)
        sinks.write_csv(resolve.synonym_groups(out), a.groups)
        _show("resolved names", out.groupBy("match_type").agg(F.count("*").alias("names")).orderBy("match_type"))
    elif a.stage == "seasonal":
        names = seasonal.canonical_map(files.read_strings(spark, a.dishes))
        rows, seen = observed.matched(spark.read.parquet(a.menus), names)
        counts = seasonal.monthly_counts(rows, a.min_count)
        summary = seasonal.seasonal_summary(counts)
        sinks.write_csv(counts.drop("first_seen", "last_seen").orderBy(F.desc("total"), "canonical_name"), a.output_monthly)
        sinks.write_csv(summary.orderBy(F.desc("total_count"), "canonical_name"), a.output_summary)
        if a.output_json:
            sinks.write_report(seasonal.seasonal_report(summary, a.min_count), a.output_json)
        print("rows:\n  " + "  ".join(f"{k}={v}" for k, v in observed.figures(seen).items()))  # of the first write; nothing is counted again
        _show("best of each season", seasonal.top_per_season(summary, 3).orderBy("season", "rank"))
        _show("most seasonal", seasonal.most_seasonal(summary, a.min_count, 5))
    elif a.stage == "clean":
        sinks.remove(spark, a.output)


if __name__ == "__main__":
    main()
