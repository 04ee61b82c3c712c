"""Queries by name, and the same as DuckDB SQL.

The tables hold no menus, so parts stand for dishes, shipping dates for menu
dates, suppliers for restaurants, and lines of documents for menu lines.  Raw
menu lines with prices, options, noise and spellings are built from part names
by one SQL expression that both engines run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.functions import rules as R
from tavola.functions import text as X
from tavola.functions import values as V
from tavola.operators import categorize as C
from tavola.operators import dishes as D
from tavola.operators import lemmas as L
from tavola.operators import menus as M
from tavola.operators import reports as P
from tavola.operators import resolve as S
from tavola.operators import seasonal as T
from tavola.operators.lineage import cut, pick, stored
from tavola.sources import pages as G

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _lit(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _any(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")" if words else "false"


# Menu lines: a part name dressed in one of many ways.
RAW_LINE = """CASE p_partkey % 20
WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(p_name, ' 990 ft') WHEN 2 THEN concat('A: ', p_name) WHEN 3 THEN concat(p_name, ' B: rántott sajt')
WHEN 4 THEN concat('- ', p_name, ' (1, 7)') WHEN 5 THEN concat('www.', p_name) WHEN 6 THEN concat(p_name, ' vagy leves vagy sült hal')
WHEN 7 THEN concat(p_name, ':') WHEN 8 THEN concat('"', p_name, '" 30dkg') WHEN 9 THEN concat(p_name, ' leves debreceni módra')
WHEN 10 THEN concat('Kellemes ünnepeket ', p_name) WHEN 11 THEN concat(p_name, ', rántott csirkemell, hasábburgonya') WHEN 12 THEN concat(p_name, ' + sütemény')
WHEN 13 THEN concat(p_name, ' Desszert: torta') WHEN 14 THEN concat(p_name, '! 1.250,-') WHEN 15 THEN '12:30-14:00'
WHEN 16 THEN concat('Mai menü ára: ', CAST(1400 + p_size * 50 AS STRING), 'Ft') WHEN 17 THEN concat('főtt marhahús ', p_name, ' gombóc') WHEN 18 THEN replace(p_name, 'a', 'á')
ELSE p_name END"""
_RAW_SQL = RAW_LINE.replace("AS STRING", "AS VARCHAR")


def _raw(spark, d) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", F.expr(RAW_LINE).alias("dish_name"), (F.col("p_size").cast("long") + 1).alias("count"))


_RAW = f"raw AS (SELECT p_partkey, {_RAW_SQL} AS dish_name, CAST(p_size AS BIGINT) + 1 AS count FROM part)"


def _menus(spark, d) -> DataFrame:
    li = _t(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"))
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("dish_name"))
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("restaurant"))
    return li.join(p, "l_partkey").join(s, "l_suppkey").select("date", "restaurant", "dish_name")


_MENUS = "menus AS (SELECT strftime(l_shipdate, '%Y-%m-%d') AS date, s_name AS restaurant, p_name AS dish_name, month(l_shipdate) AS m FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"
# Names of the first half of the alphabet are known dishes to unmatched_rows and run_metrics.
_KNOWN = "known AS (SELECT DISTINCT p_name AS dish_name FROM part WHERE p_name < 'n')"


def _known(spark, d) -> DataFrame:
    return T.canonical_map(_t(spark, d, "part").where("p_name < 'n'").select(F.col("p_name").alias("dish_name")))


def _dishes(spark, d) -> DataFrame:
    return T.canonical_map(_t(spark, d, "part").select(F.col("p_name").alias("dish_name")))


def _counts(spark, d, min_count: int = 10) -> DataFrame:
    return T.monthly_counts(T.matched(_menus(spark, d), _dishes(spark, d)), min_count)


_MONTHLY = f"WITH {_MENUS}, known AS (SELECT DISTINCT p_name AS dish_name FROM part), counts AS (SELECT dish_name AS canonical_name, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE m = {m}) AS {c}" for m, c in enumerate(T.MONTHS, 1)) + ", min(date) AS first_seen, max(date) AS last_seen FROM menus JOIN known USING (dish_name) GROUP BY dish_name HAVING count(*) >= 10)"
_ARR = "[" + ", ".join(T.MONTHS) + "]"
_SEASON = "CASE WHEN {m} IN (12, 1, 2) THEN 'tél' WHEN {m} IN (3, 4, 5) THEN 'tavasz' WHEN {m} IN (6, 7, 8) THEN 'nyár' ELSE 'ősz' END"
_SUMMARY = (
    _MONTHLY
    + f", peak AS (SELECT *, list_position({_ARR}, list_max({_ARR})) AS pm, list_sum({_ARR}) / 12.0 AS mu FROM counts), summary AS (SELECT canonical_name, total AS total_count, CAST(pm AS INTEGER) AS peak_month, {_SEASON.format(m='pm')} AS peak_season, "
    + f"CASE WHEN mu > 0 THEN round(sqrt(list_sum(list_transform({_ARR}, lambda x: (x - mu) * (x - mu))) / 12.0) / mu, 3) ELSE 0.0 END AS seasonality_index, first_seen, last_seen, "
    + "month_12 + month_01 + month_02 AS \"tél\", month_03 + month_04 + month_05 AS \"tavasz\", month_06 + month_07 + month_08 AS \"nyár\", month_09 + month_10 + month_11 AS \"ősz\" FROM peak)"
)


@query(f"WITH {_MENUS} SELECT date, restaurant, dish_name FROM menus")
def menu_rows(spark, d):
    """Menu rows: dated dishes of restaurants."""
    return _menus(spark, d)


@query(f"WITH {_MENUS} SELECT dish_name, count(*) AS count FROM menus GROUP BY dish_name")
def dish_count(spark, d):
    return D.dish_count(_menus(spark, d))


@query(_MONTHLY + " SELECT * FROM counts")
def monthly_counts(spark, d):
    return _counts(spark, d)


@query(_SUMMARY + " SELECT * FROM summary")
def seasonal_summary(spark, d):
    return T.seasonal_summary(_counts(spark, d))


@query(_SUMMARY + ", long AS (SELECT season, canonical_name, n, total_count, seasonality_index FROM summary UNPIVOT (n FOR season IN (\"tél\", \"tavasz\", \"nyár\", \"ősz\"))) SELECT season, CAST(rank AS INTEGER) AS rank, canonical_name AS dish, n AS count, seasonality_index AS seasonality FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY n DESC, total_count DESC, canonical_name) AS rank FROM long) WHERE rank <= 20")
def top_per_season(spark, d):
    return T.top_per_season(T.seasonal_summary(_counts(spark, d)))


@query(_SUMMARY + " SELECT canonical_name AS dish, peak_season, peak_month, seasonality_index, total_count AS total FROM summary WHERE total_count >= 20 ORDER BY seasonality_index DESC, total_count DESC, canonical_name LIMIT 30")
def most_seasonal(spark, d):
    return T.most_seasonal(T.seasonal_summary(_counts(spark, d)))


@query(_SUMMARY + " SELECT peak_season, CAST(rank AS INTEGER) AS rank, canonical_name AS dish, total_count AS total, seasonality_index FROM (SELECT *, row_number() OVER (PARTITION BY peak_season ORDER BY seasonality_index DESC, total_count DESC, canonical_name) AS rank FROM summary WHERE total_count >= 50) WHERE rank <= 5")
def season_peakers(spark, d):
    return T.season_peakers(T.seasonal_summary(_counts(spark, d)))


@query(f"WITH {_MENUS}, {_KNOWN} SELECT dish_name, date, restaurant FROM menus WHERE dish_name NOT IN (SELECT dish_name FROM known)")
def unmatched_rows(spark, d):
    return T.unmatched(_menus(spark, d), _known(spark, d)).select("dish_name", "date", "restaurant")


# Menu rows of which some have a blank name or date, and some a date without a month.
_MESSY_DATE = "CASE WHEN l_orderkey % 50 = 0 THEN '' WHEN l_orderkey % 51 = 0 THEN '2024' WHEN l_orderkey % 53 = 0 THEN '2024-xx-01' WHEN l_orderkey % 59 = 0 THEN '2024-13-01' ELSE {day} END"
_MESSY_NAME = "CASE WHEN l_orderkey % 47 = 0 THEN '  ' WHEN l_orderkey % 61 = 0 THEN NULL WHEN l_orderkey % 3 = 0 THEN concat(' ', p_name, ' ') ELSE p_name END"


@query(f"WITH m AS (SELECT trim(coalesce({_MESSY_NAME}, '')) AS dish_name, " + _MESSY_DATE.format(day="strftime(l_shipdate, '%Y-%m-%d')") + f" AS date FROM lineitem JOIN part ON l_partkey = p_partkey), {_KNOWN}, j AS (SELECT dish_name = '' OR date = '' AS blank, k.dish_name IS NOT NULL AS known, coalesce(TRY_CAST(string_split(date, '-')[2] AS INTEGER) BETWEEN 1 AND 12, false) AS dated FROM m LEFT JOIN known k USING (dish_name)) SELECT count(*) AS menu_rows, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE NOT blank AND NOT known) AS unmatched, count(*) FILTER (WHERE NOT blank AND known AND NOT dated) AS bad_dates, count(*) FILTER (WHERE NOT blank AND known AND dated) AS matched FROM j")
def run_metrics(spark, d):
    li = _t(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_shipdate").join(_t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    rows = li.select(F.expr(_MESSY_NAME).alias("dish_name"), F.expr(_MESSY_DATE.format(day="date_format(l_shipdate, 'yyyy-MM-dd')")).alias("date"))
    return T.run_metrics(rows, _known(spark, d))


def _noise_sql(kind: str, words: list[str]) -> str:
    low = "lower(dish_name)"
    return {
        "contains": lambda: _any(low, words),
        "regex": lambda: " OR ".join(f"regexp_matches({low}, '{w}')" for w in words),
        "raw_regex": lambda: " OR ".join(f"regexp_matches(dish_name, '{w}')" for w in words),
        "suffix": lambda: " OR ".join(f"ends_with(trim(dish_name), '{w}')" for w in words),
        "exact": lambda: f"dish_name IN ({_lit(words)})",
        "exact_trimmed": lambda: f"trim(dish_name) IN ({_lit(words)})",
        "all_of": lambda: " AND ".join(f"contains({low}, '{w}')" for w in words),
        "long_any": lambda: f"length(dish_name) > 100 AND {_any(low, words)}",
    }[kind]()


def _noise_case() -> str:
    return "CASE " + " ".join(f"WHEN {_noise_sql(kind, words)} THEN '{name}'" for name, kind, words in V.NOISE) + " END"


@query(f"WITH {_RAW} SELECT p_partkey, dish_name, {_noise_case()} AS reason FROM raw")
def noise_filter(spark, d):
    """Menu lines with the first noise rule that fits."""
    return _raw(spark, d).select("p_partkey", "dish_name", R.noise_reason(F.col("dish_name")).alias("reason"))


@query(f"WITH {_RAW} SELECT reason, count(*) AS names, CAST(sum(count) AS BIGINT) AS occurrences FROM (SELECT count, {_noise_case()} AS reason FROM (SELECT dish_name, sum(count) AS count FROM raw GROUP BY dish_name)) WHERE reason IS NOT NULL GROUP BY reason")
def noise_reason_counts(spark, d):
    return D.noise_reasons(_raw(spark, d).groupBy("dish_name").agg(F.sum("count").alias("count")))


def _re2(p: str) -> str:
    return p.replace(r"\w", r"[\p{L}\p{N}_]").replace("'", "''")


def _sub_sql(col: str, steps: list[tuple[str, str, bool]]) -> str:
    for p, to, ignore in steps:
        p = _re2(p).replace(r"[^[\p{L}\p{N}_]\s]", r"[^\p{L}\p{N}_\s]")
        col = f"regexp_replace({col}, '{'(?i)' if ignore else ''}{p}', '{to}', 'g')"
    return col


_SQUEEZE = r"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def _scrub_sql(col: str) -> str:
    t = _sub_sql(_SQUEEZE.format(c=f"coalesce({col}, '')"), [(p, to, False) for p, to in V.SCRUB] + [("(?:" + "|".join(V.SCRUB_TAILS) + ").*$", "", True)])
    return f"CASE WHEN length(trim({t})) > 2 THEN trim({t}) ELSE '' END"


def _case_sql(col: str) -> str:
    stems = "|".join(V.PROPER_STEMS)
    w, lead = "w", r"regexp_extract(w, '^[,:;.!?+()\-\"'']+')"
    rest = f"substr(w, length({lead}) + 1)"
    named = f"{lead} || upper(substr({rest}, 1, 1)) || substr({rest}, 2)"
    return f"array_to_string(list_transform(list_filter(string_split(lower({col}), ' '), lambda w: w <> ''), lambda w, i: CASE WHEN i = 1 THEN upper(substr(w, 1, 1)) || substr(w, 2) WHEN regexp_matches({rest}, '^(?:{stems})') THEN {named} ELSE w END), ' ')"


_CLEAN = _case_sql(_SQUEEZE.format(c=_sub_sql("dish_name", V.CLEAN)))
_DISH = f"(length(c) >= 4 AND length(lower(c)) - length(replace(lower(c), ' vagy ', '')) <= 6 AND NOT {_any('lower(c)', V.NOT_A_DISH)} AND ({_any('lower(c)', V.FOOD_WORDS)} OR (len(list_filter(string_split(c, ' '), lambda w: w <> '')) <= 3 AND NOT {_any('c', V.NOT_SIMPLE)})))"
_CLEANED = f"WITH {_RAW}, cl AS (SELECT p_partkey, count, dish_name, {_CLEAN} AS c FROM raw), cleaned AS (SELECT c AS dish_name, CAST(sum(count) AS BIGINT) AS count FROM cl WHERE ({_noise_case()}) IS NULL AND length(c) > 3 AND {_DISH} GROUP BY c)"
_KEY = r"trim(regexp_replace(regexp_replace(translate(lower(dish_name), '" + V.FOLD_FROM + "', '" + V.FOLD_TO + r"'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_MERGED = _CLEANED + f", merged AS (SELECT arg_min(dish_name, (-count, -length(dish_name), dish_name)) AS dish_name, CAST(sum(count) AS BIGINT) AS count FROM cleaned WHERE length(dish_name) >= 4 GROUP BY {_KEY})"


@query(f"WITH {_RAW} SELECT p_partkey, {_scrub_sql('dish_name')} AS scrubbed FROM raw")
def scrub_lines(spark, d):
    return _raw(spark, d).select("p_partkey", X.scrub(F.col("dish_name")).alias("scrubbed"))


@query(f"WITH {_RAW} SELECT p_partkey, {_CLEAN} AS clean FROM raw")
def clean_names(spark, d):
    return _raw(spark, d).select("p_partkey", X.clean_name(F.col("dish_name")).alias("clean"))


@query(f"WITH {_RAW} SELECT p_partkey, {_DISH} AS is_dish FROM (SELECT p_partkey, {_CLEAN} AS c FROM raw)")
def actual_dish_filter(spark, d):
    return _raw(spark, d).select("p_partkey", R.is_dish(X.clean_name(F.col("dish_name"))).alias("is_dish"))


# Lines on which every step of scrubbing and cleaning and every noise rule acts, around a part's name.
_SCRUB_LINES = ["NULL", "concat('  ', p_name, chr(9), ' leves', chr(10))", "concat(p_name, ' + 150 Ft doboz')", "concat(p_name, ' ( 990 Ft )')", "concat(p_name, ' 990 Ft, köret')", "concat(p_name, ' Telefon: 06-30 123 4567')", "concat(p_name, ' Kiszállítás ingyen minden nap')", "concat('Házhozszállítás hétfőn ', p_name)", "concat(p_name, ', Menü mára ketten')", "concat(p_name, ', rendelés telefonon délig')", "concat(p_name, ' 11:30-14:00')", "concat(p_name, ' 9:05 után')", "concat(p_name, '!?..')", "concat('(', p_name, ') (', p_size, ')')", "'ab'", "concat(p_name, ' -')"]
_SCRUB_LINES += [f"concat(p_name, ', {t.upper() if i % 2 else t} még')" for i, t in enumerate(V.SCRUB_TAILS)]
_CLEAN_LINES = ["concat(chr(34), p_name, chr(34))", "concat('• - ', p_name)", "concat(p_name, ' 1.250,-')", "concat(p_name, ' 30dkg köret')", "concat(p_name, ' (1, 7) köret')", "concat(p_name, ' 1, 3, 7')", "concat(p_name, ' DESSZERT: torta')", "concat(p_name, ' + sütemény és kávé')", "concat(p_name, ' + Meglepetés')", "concat('B: ', p_name)", "concat(p_name, ' -')", "concat(p_name, '   ', p_type)", "upper(p_name)", "concat(p_name, ', (debreceni módra')", "concat(p_name, ' Milánói bbq GYROS')"]
_NOISE_LINES = ["concat('www.', p_name)", "concat(p_name, ' utca 5')", "concat(p_name, ' LOGO')", "concat(p_name, ' svédasztal')", "concat('Napi menünk: ', p_name)", "concat(p_name, ' Kellemes')", "concat(p_size, '990 ft')", "concat(p_name, ':')", "'12:30-14:00'", "'leves nélkül'", "concat(p_size, 'ft')", "concat(p_size, '')", "concat('rántott szelet, tartárral 2.', p_size)", "'BUÉK'", "' Mai menü '", "concat(p_name, ' crispy chicken nuggets 7db')", "concat(repeat(concat(p_name, ' '), 20), 'vagy')", "p_name", "concat(p_name, ' és ', p_type)", "NULL"]


def _lines(words: list[str]) -> str:
    return f"CASE p_partkey % {len(words)} " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(words)) + " END"


def _line_rows(spark, d, words: list[str]) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", F.expr(_lines(words)).alias("dish_name"))


def _line_sql(words: list[str]) -> str:
    return f"raw AS (SELECT p_partkey, {_lines(words)} AS dish_name FROM part)"


@query(f"WITH {_line_sql(_SCRUB_LINES)} SELECT p_partkey, {_scrub_sql('dish_name')} AS scrubbed FROM raw")
def scrub_steps(spark, d):
    """Every step of scrubbing acts on some line."""
    return _line_rows(spark, d, _SCRUB_LINES).select("p_partkey", X.scrub(F.col("dish_name")).alias("scrubbed"))


@query(f"WITH {_line_sql(_CLEAN_LINES)} SELECT p_partkey, {_CLEAN} AS clean FROM raw")
def clean_steps(spark, d):
    """Every step of cleaning acts on some line."""
    return _line_rows(spark, d, _CLEAN_LINES).select("p_partkey", X.clean_name(F.col("dish_name")).alias("clean"))


@query(f"WITH {_line_sql(_NOISE_LINES)} SELECT p_partkey, " + ", ".join(f"coalesce({_noise_sql(kind, words)}, false) AS \"{name}\"" for name, kind, words in V.NOISE) + f", {_noise_case()} AS reason FROM raw")
def noise_rules(spark, d):
    """Every noise rule by itself, also where an earlier one fits, and the first that fits."""
    rows = _line_rows(spark, d, _NOISE_LINES)
    return rows.select("p_partkey", *[F.coalesce(R.fits(F.col("dish_name"), kind, words), F.lit(False)).alias(name) for name, kind, words in V.NOISE], R.noise_reason(F.col("dish_name")).alias("reason"))


@query(_MERGED + " SELECT dish_name, count FROM merged")
def dedup_folded(spark, d):
    """Raw lines to clean, merged dish names with counts."""
    return D.clean_dishes(_raw(spark, d).select("dish_name", "count"))


@query(f"WITH {_RAW}, n AS (SELECT DISTINCT dish_name FROM raw), cl AS (SELECT ({_noise_case()}) IS NOT NULL AS noise, {_CLEAN} AS c FROM n), k AS (SELECT *, NOT noise AND length(c) > 3 AS long, NOT noise AND length(c) > 3 AND {_DISH} AS dish FROM cl) SELECT count(*) AS names, count(*) FILTER (WHERE NOT noise) AS without_noise, count(*) FILTER (WHERE long) AS cleaned, count(*) FILTER (WHERE dish) AS dishes, count(DISTINCT c) FILTER (WHERE dish) AS distinct_names, count(DISTINCT {_KEY.replace('dish_name', 'c')}) FILTER (WHERE dish) AS merged FROM k")
def step_counts(spark, d):
    """How many names each cleaning step leaves."""
    return D.step_counts(_raw(spark, d).select("dish_name").distinct())


@query("SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line")
def line_frequency(spark, d):
    return G.line_frequency(_t(spark, d, "documents").select("text"))


# The given pages have these elements and references alone.
_DECODED = "replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&copy;', '©'), '&middot;', '·')"
_PLAIN = "regexp_replace(regexp_replace(regexp_replace(" + _DECODED.format(x="regexp_replace(replace(replace(translate(coalesce(html, ''), chr(13) || chr(10), '  '), '</p>', chr(10)), '<br>', chr(10)), '(?s)<(script|style)>.*?</(script|style)>', '', 'g')") + r", '&amp;?', '&', 'g'), '[^\S\n]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT line, count(*) AS n FROM (SELECT unnest(string_split({_PLAIN}, chr(10))) AS line FROM pages) GROUP BY line")
def page_line_frequency(spark, d):
    """Text of all pages, line by line."""
    return G.line_frequency(G.page_text(_t(spark, d, "pages")))


_TOKENS = r"tok AS (SELECT unnest(list_filter(regexp_split_to_array(text, '[\s\x1c-\x1f]+'), lambda w: w <> '')) AS lemma FROM documents)"
_DICT = f"WITH {_TOKENS}, dict AS (SELECT lemma, frequency, CAST(row_number() OVER (ORDER BY frequency DESC, lemma) AS INTEGER) AS rank FROM (SELECT lemma, count(*) AS frequency FROM tok WHERE NOT regexp_matches(lemma, '^[!-/:-@\\[-`{{-~\\s]*$') GROUP BY lemma))"


def _dictionary(spark, d, least=1) -> DataFrame:
    return L.lemma_dictionary(_t(spark, d, "documents").select("text"), "text", least, True)


@query(_DICT + " SELECT * FROM dict")
def lemma_dictionary(spark, d):
    return _dictionary(spark, d)


@query(_DICT + " SELECT count(*) AS unique_lemmas, CAST(sum(frequency) AS BIGINT) AS occurrences, avg(frequency) AS mean_frequency, count(*) FILTER (WHERE frequency = 1) AS hapaxes, 100.0 * count(*) FILTER (WHERE frequency = 1) / count(*) AS hapax_percent, arg_min(lemma, rank) AS most_frequent, arg_max(lemma, rank) AS least_frequent FROM dict")
def lemma_stats(spark, d):
    return L.lemma_stats(_dictionary(spark, d))


@query(_MERGED + r" SELECT dish_name, count AS score, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(dish_name), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda w: w <> ''), ' ') AS lemmas FROM merged")
def lemmatized(spark, d):
    out = L.lemmatize(D.clean_dishes(_raw(spark, d).select("dish_name", "count")))
    return out.withColumn("lemmas", F.array_join("lemmas", " "))


_LOOKUP = [("rántott", "ránt"), ("sajt", "sajt"), ("leves", "lé"), ("red", "colour"), ("blue", "colour"), ("hot", "warm"), ("steel", "metal"), ("copper", "metal"), ("copper", "ore")]


@query(_MERGED + f", words AS (SELECT dish_name, count, unnest(w) AS word, unnest(range(len(w))) AS i FROM (SELECT dish_name, count, list_filter(regexp_split_to_array(regexp_replace(lower(dish_name), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '') AS w FROM merged)), look AS (SELECT word, min(lemma) AS lemma FROM (VALUES " + ", ".join(f"('{w}', '{v}')" for w, v in _LOOKUP) + ") AS t(word, lemma) GROUP BY word) SELECT dish_name, count AS score, string_agg(coalesce(lemma, words.word), ' ' ORDER BY i) AS lemmas FROM words LEFT JOIN look USING (word) GROUP BY dish_name, count")
def lemmatized_lookup(spark, d):
    """Lemmas by a table of words."""
    known = spark.createDataFrame(_LOOKUP, "word string, lemma string")
    out = L.lemmatize(D.clean_dishes(_raw(spark, d).select("dish_name", "count")), "lookup", table=known)
    return out.withColumn("lemmas", F.array_join("lemmas", " "))


@query(r"WITH tok AS (SELECT unnest(list_filter(regexp_split_to_array(text, '[\s\x1c-\x1f]+'), lambda w: w <> '')) AS lemma FROM documents) SELECT (SELECT count(*) FROM documents) AS rows, count(*) AS tokens, count(*) FILTER (WHERE regexp_matches(lemma, '^[!-/:-@\[-`{-~\s]*$')) AS punctuation, count(*) FILTER (WHERE NOT regexp_matches(lemma, '^[!-/:-@\[-`{-~\s]*$')) AS remaining FROM tok")
def lemma_counts(spark, d):
    """What the filter of punctuation takes away."""
    return L.lemma_counts(_t(spark, d, "documents").select("text"), "text")


_LEM = r"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(dish_name), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda w: w <> ''), ' ')"


def _labels_sql(classes, text="t") -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_any(text, words)} THEN '{label}' END" for label, words in classes) + "], lambda x: x IS NOT NULL)"


_COURSE = "CASE " + " ".join(f"WHEN {_any('t', w)} THEN '{c}'" for c, w in V.COURSES if w) + f" ELSE '{V.DEFAULT_COURSE}' END"
_PROT = f"CASE WHEN len({_labels_sql(V.PROTEINS)}) > 0 THEN {_labels_sql(V.PROTEINS)} ELSE {_labels_sql([V.VEGETARIAN])} END"
_CAT = _MERGED + f", txt AS (SELECT dish_name, count, lower(dish_name || ' ' || {_LEM}) AS t FROM merged), cat AS (SELECT dish_name, count, {_COURSE} AS course, {_PROT} AS protein, {_labels_sql(V.METHODS)} AS method FROM txt)"


def _categorized(spark, d) -> DataFrame:
    return C.categorize(L.lemmatize(D.clean_dishes(_raw(spark, d).select("dish_name", "count"))))


@query(_CAT + " SELECT dish_name, course FROM cat")
def course_first_match(spark, d):
    return _categorized(spark, d).select("dish_name", "course")


@query(_CAT + " SELECT dish_name, array_to_string(protein, ',') AS protein, array_to_string(method, ',') AS cooking_method FROM cat")
def labels_multi(spark, d):
    return C.joined(_categorized(spark, d)).select("dish_name", "protein", "cooking_method")


@query(_MERGED + f" SELECT dish_name, array_to_string({_labels_sql([(x, [x]) for x in V.SIDES], 'lower(dish_name || chr(32) || ' + _LEM + ')')}, ',') AS sides FROM merged")
def side_dishes(spark, d):
    rows = C.side_dishes(L.lemmatize(D.clean_dishes(_raw(spark, d).select("dish_name", "count"))))
    return rows.withColumn("sides", F.array_join("sides", ","))


@query(f"WITH {_line_sql(_NOISE_LINES)}, x AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN '  ' ELSE dish_name END AS dish_name FROM raw) SELECT count(*) AS rows, count(*) FILTER (WHERE coalesce(trim(dish_name), '') = '') AS skipped, count(*) FILTER (WHERE coalesce(trim(dish_name), '') <> '') AS categorized FROM x")
def category_counts(spark, d):
    """Rows that have no name to categorize."""
    rows = _line_rows(spark, d, _NOISE_LINES)
    return C.counts(rows.withColumn("dish_name", F.when(F.col("p_partkey") % 7 == 0, "  ").otherwise(F.col("dish_name"))))


_DIST = ", dist AS (SELECT dimension, label, count(*) AS n FROM (SELECT 'course' AS dimension, course AS label FROM cat UNION ALL SELECT 'protein', unnest(protein) FROM cat UNION ALL SELECT 'cooking_method', unnest(method) FROM cat) GROUP BY dimension, label)"


@query(_CAT + _DIST + " SELECT * FROM dist")
def category_stats(spark, d):
    return C.distribution(_categorized(spark, d))


@query(_CAT + _DIST + " SELECT dimension, label, n, 100.0 * n / (SELECT sum(n) FROM dist WHERE dimension = 'course') AS share FROM dist")
def label_share(spark, d):
    return C.label_share(_categorized(spark, d))


_PAIRS = S.curated_pairs()
_KEYS = "(VALUES " + ", ".join(f"({i}, '{k}', '{c}')" for i, (k, c) in enumerate(_PAIRS)) + ") AS k(ordinal, key, canonical)"
_CUR = f", cur AS (SELECT dish_name, arg_min(canonical, CASE WHEN lower(dish_name) = key THEN -1 ELSE ordinal END) AS curated FROM merged JOIN {_KEYS} ON contains(lower(dish_name), key) GROUP BY dish_name)"


@query(_MERGED + _CUR + " SELECT merged.dish_name, curated FROM merged LEFT JOIN cur USING (dish_name)")
def curated_exact_or_substring(spark, d):
    names = D.clean_dishes(_raw(spark, d).select("dish_name", "count"))
    return names.select("dish_name", S.curated_match(F.col("dish_name"), _PAIRS).alias("curated"))


@query(_MERGED + _CUR + " SELECT merged.dish_name, curated FROM merged LEFT JOIN cur USING (dish_name)")
def curated_by_join(spark, d):
    """The same for tables of synonyms of any size."""
    names = D.clean_dishes(_raw(spark, d).select("dish_name", "count")).select("dish_name")
    keys = spark.createDataFrame([(i, k, c) for i, (k, c) in enumerate(_PAIRS)], "ordinal long, key string, canonical string")
    return S.curated_join(names, keys)


def _tokens_sql(col: str) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({col}), '{V.TOKEN}'), lambda t: length(t) > 1 AND t NOT IN ({_lit(V.STOPWORDS)}))))"


_CLASSES = f"sets AS (SELECT doc_id AS id, {_tokens_sql('text')} AS s FROM documents), ok AS (SELECT s, min(id) AS id FROM sets WHERE len(s) > 0 GROUP BY s)"
_EDGES = "edge AS MATERIALIZED (SELECT a, b FROM (SELECT x.{id} AS a, y.{id} AS b, len(list_intersect(x.s, y.s)) AS i, len(x.s) AS n, len(y.s) AS m FROM {rows} x JOIN {rows} y ON x.{id} < y.{id} AND len(x.s) * 1000 >= 850 * len(y.s) AND len(y.s) * 1000 >= 850 * len(x.s)) WHERE 1000 * i >= 850 * (n + m - i))"


def _sets(spark, d) -> DataFrame:
    # written once: a filter on tokens and each further use would have them found anew
    sets = cut(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_sort(X.tokens(F.col("text"))).alias("tokens")))
    return sets.where(F.size("tokens") > 0)


@query(f"WITH {_CLASSES}, {_EDGES.format(id='id', rows='ok')} SELECT a, b FROM edge")
def jaccard_pairs(spark, d):
    """Similar classes of documents, by their least ids; documents of one class have one set of tokens."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_sort(X.tokens(F.col("text"))).alias("tokens"))
    sets = stored(docs.select(F.monotonically_increasing_id().alias("row"), "id", "tokens", S.digest_of("tokens")), "sets").where(F.size("tokens") > 0)
    later = stored(S.not_first(sets, "digest", F.struct("id", "row")), "later")
    return S.similar_pairs(pick(sets, later, "left_anti"))


@query(f"WITH {_CLASSES} SELECT sets.id, ok.id AS class_id FROM sets JOIN ok USING (s)")
def jaccard_classes(spark, d):
    """The class of each document."""
    return S.token_classes(_sets(spark, d))


# Names by rank join the least earlier leader: one step of the recursion per name that has an earlier neighbour.
_GROUPS = f"sets AS (SELECT s, min(r) AS r FROM toks WHERE len(s) > 0 GROUP BY s), {_EDGES.format(id='r', rows='sets')}, nodes AS MATERIALIZED (SELECT b, list(a) AS low, row_number() OVER (ORDER BY b) AS k FROM edge GROUP BY b), rec AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS joined, CAST(0 AS BIGINT) AS b, CAST(NULL AS BIGINT) AS leader UNION ALL SELECT k, CASE WHEN leader IS NULL THEN joined ELSE list_append(joined, b) END, b, leader FROM (SELECT n.k, rec.joined, n.b, list_min(list_filter(n.low, lambda a: NOT list_contains(rec.joined, a))) AS leader FROM rec JOIN nodes n ON n.k = rec.k + 1)), grp AS (SELECT t.dish_name, h.dish_name AS canonical_name FROM toks t JOIN sets USING (s) LEFT JOIN rec ON rec.b = sets.r JOIN toks h ON h.r = coalesce(rec.leader, sets.r) WHERE t.dish_name <> h.dish_name)"


@query(f"WITH RECURSIVE toks AS (SELECT dish_name, row_number() OVER (ORDER BY c DESC, dish_name) AS r, {_tokens_sql('dish_name')} AS s FROM (SELECT text AS dish_name, count(*) AS c FROM documents WHERE text IS NOT NULL GROUP BY text)), {_GROUPS} SELECT sha256(dish_name) AS name_sha256, sha256(canonical_name) AS canonical_sha256 FROM grp")
def auto_groups(spark, d):
    """Texts, as names, that join an earlier, similar one."""
    names = _t(spark, d, "documents").where("text is not null").select(F.col("text").alias("dish_name"), F.lit(1).cast("long").alias("count"))
    out = S.auto_groups(names, lemmas=None)
    return out.select(F.sha2("dish_name", 256).alias("name_sha256"), F.sha2("canonical_name", 256).alias("canonical_sha256"))


_RESOLVED = (
    _CAT.replace("WITH ", "WITH RECURSIVE ", 1)
    + _CUR
    + f", toks AS (SELECT dish_name, row_number() OVER (ORDER BY count DESC, dish_name) AS r, {_tokens_sql('CASE WHEN length(l) > 0 THEN l ELSE dish_name END')} AS s FROM (SELECT cat.dish_name, cat.count, {_LEM.replace('dish_name', 'cat.dish_name')} AS l FROM cat LEFT JOIN cur USING (dish_name) WHERE curated IS NULL)), {_GROUPS}"
    + f" SELECT cat.dish_name, cat.count, {_LEM.replace('dish_name', 'cat.dish_name')} AS lemmas, course, array_to_string(protein, ',') AS protein, array_to_string(method, ',') AS cooking_method, coalesce(curated, grp.canonical_name, cat.dish_name) AS canonical_name, CASE WHEN curated IS NOT NULL THEN 'curated' WHEN grp.canonical_name IS NOT NULL THEN 'auto' END AS match_type FROM cat LEFT JOIN cur USING (dish_name) LEFT JOIN grp USING (dish_name)"
)


@query(_RESOLVED)
def dishes_resolved(spark, d):
    return C.joined(S.resolve(_categorized(spark, d))).withColumn("lemmas", F.array_join("lemmas", " "))


# Names of which some are one set of words in another order, some differ in a word of many, and some of these hold a curated key as well.
_RIVALS = """CASE p_partkey % 6 WHEN 0 THEN concat(p_name, ' friss házi saláta finom meleg kenyér') WHEN 1 THEN concat('finom meleg kenyér friss házi saláta ', p_name)
WHEN 2 THEN concat(p_name, ' friss házi saláta finom meleg kenyér extra') WHEN 3 THEN concat(p_name, ' friss házi saláta finom meleg kenyér rántott sajt')
WHEN 4 THEN concat('rántott sajt kenyér friss házi saláta finom meleg ', p_name) ELSE p_name END"""


@query(
    f"WITH RECURSIVE merged AS (SELECT {_RIVALS} AS dish_name, CAST(sum(p_size) AS BIGINT) AS count FROM part GROUP BY 1){_CUR}, "
    f"toks AS (SELECT dish_name, row_number() OVER (ORDER BY count DESC, dish_name) AS r, {_tokens_sql('dish_name')} AS s FROM merged LEFT JOIN cur USING (dish_name) WHERE curated IS NULL), {_GROUPS} "
    "SELECT merged.dish_name, count, coalesce(curated, grp.canonical_name, merged.dish_name) AS canonical_name, CASE WHEN curated IS NOT NULL THEN 'curated' WHEN grp.canonical_name IS NOT NULL THEN 'auto' END AS match_type FROM merged LEFT JOIN cur USING (dish_name) LEFT JOIN grp ON grp.dish_name = merged.dish_name"
)
def resolved_rivals(spark, d):
    """Names that group automatically, some of them with a curated rival, which goes first."""
    names = _t(spark, d, "part").groupBy(F.expr(_RIVALS).alias("dish_name")).agg(F.sum("p_size").cast("long").alias("count"))
    return S.resolve(names)


@query("SELECT p_name AS dish_name, max(coalesce(CASE WHEN p_partkey % 4 <> 0 THEN concat(p_name, ' ', p_partkey % 3) END, p_name)) AS canonical_name FROM part GROUP BY p_name")
def canonical_map_repeated(spark, d):
    """Names that the build side has many times, with one canonical name or another or none."""
    rows = _t(spark, d, "part").select(F.col("p_name").alias("dish_name"), F.expr("CASE WHEN p_partkey % 4 <> 0 THEN concat(p_name, ' ', p_partkey % 3) END").alias("canonical_name"))
    return T.canonical_map(rows)


def _curated(spark, d) -> DataFrame:
    rows = _categorized(spark, d)
    return rows.withColumn("canonical_name", F.coalesce(S.curated_match(F.col("dish_name"), _PAIRS), "dish_name"))


_RES = _CAT + _CUR + ", res AS (SELECT cat.*, coalesce(curated, cat.dish_name) AS canonical_name FROM cat LEFT JOIN cur USING (dish_name)), top AS (SELECT canonical_name, CAST(sum(count) AS BIGINT) AS occurrences FROM res GROUP BY canonical_name), tiered AS (SELECT *, CASE WHEN occurrences >= 200 THEN 1 WHEN occurrences >= 50 THEN 2 WHEN occurrences >= 10 THEN 3 ELSE 4 END AS tier FROM top)"


@query(f"WITH {_MENUS} SELECT count(*) AS menu_rows, count(DISTINCT dish_name) AS dishes, min(date) AS first_date, max(date) AS last_date FROM menus")
def corpus_totals(spark, d):
    return P.corpus_totals(_menus(spark, d))


@query(_RES + " SELECT * FROM top")
def top_dishes(spark, d):
    return P.top_dishes(_curated(spark, d))


@query(_RES + " SELECT canonical_name, CAST(sum(count) AS BIGINT) AS occurrences FROM res WHERE course = 'leves' GROUP BY canonical_name ORDER BY occurrences DESC, canonical_name LIMIT 10")
def top_of_course(spark, d):
    return P.top_dishes(_curated(spark, d), 10, "leves")


@query(_RES + " SELECT tier, count(*) AS dishes, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM tiered GROUP BY tier")
def tiers(spark, d):
    return P.tiers(_curated(spark, d))


@query(_RES + " SELECT tier, CAST(rank AS INTEGER) AS rank, canonical_name, occurrences FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY occurrences DESC, canonical_name) AS rank FROM tiered)")
def tier_ranks(spark, d):
    return P.tier_ranks(_curated(spark, d))


@query(_RES + " SELECT tier, dimension, label, CAST(sum(count) AS BIGINT) AS occurrences FROM (SELECT tier, count, 'course' AS dimension, course AS label FROM res JOIN tiered USING (canonical_name) UNION ALL SELECT tier, count, 'protein', unnest(protein) FROM res JOIN tiered USING (canonical_name) UNION ALL SELECT tier, count, 'cooking_method', unnest(method) FROM res JOIN tiered USING (canonical_name)) GROUP BY ALL")
def tier_profile(spark, d):
    return P.tier_profile(_curated(spark, d))


@query(f"WITH {_RAW}, x AS (SELECT dish_name, p_partkey FROM raw) SELECT low, spellings FROM (SELECT lower(dish_name) AS low, count(DISTINCT dish_name) AS spellings FROM x GROUP BY 1) WHERE spellings > 1")
def case_collisions(spark, d):
    return D.case_collisions(_raw(spark, d), "dish_name")


@query(f"WITH {_RAW} SELECT p_partkey, TRY_CAST(nullif(regexp_extract(dish_name, '([0-9]+)\\s*(?:Ft|ft)', 1), '') AS INTEGER) AS price FROM raw")
def price_extract(spark, d):
    return _raw(spark, d).select("p_partkey", X.price_of(F.col("dish_name")).alias("price"))


_LINES = f"WITH {_RAW}, sc AS (SELECT p_partkey, dish_name, {_scrub_sql('dish_name')} AS c FROM raw WHERE length(dish_name) >= 3 AND NOT regexp_matches(dish_name, '^[0-9\\s]*(?:Ft|ft)[^\\p{{L}}\\p{{N}}_]*$')), ok AS (SELECT * FROM sc WHERE length(c) >= 3)"
_SEP = r"(?i)\s*[AB]:\s*"
_PARTS = f"list_filter(list_transform(regexp_split_to_array(c, '{_SEP}'), lambda p: trim(p)), lambda p: length(p) > 2)"


_OPTIONS = (
    r", opt AS (SELECT p_partkey, trim(regexp_extract(c, '^([A-Z]):\s*(.+)', 2)) AS dish_name, 1 AS item_number, 'option_' || regexp_extract(c, '^([A-Z]):', 1) AS menu_type FROM ok WHERE regexp_matches(c, '^[A-Z]:')), "
    + f"parts AS (SELECT p_partkey, unnest({_PARTS}) AS dish_name, unnest(range(1, len({_PARTS}) + 1)) AS item_number FROM ok WHERE NOT regexp_matches(c, '^[A-Z]:') AND regexp_matches(c, '{_SEP}')), "
    + f"rest AS (SELECT p_partkey, c AS dish_name FROM ok WHERE NOT regexp_matches(c, '^[A-Z]:') AND NOT regexp_matches(c, '{_SEP}') AND ({_any('lower(c)', V.SOUP_WORDS)} OR NOT {_any('lower(c)', V.DEFAULT_SKIP)}))"
)


@query(_LINES + _OPTIONS + " SELECT p_partkey, dish_name, item_number, menu_type FROM opt WHERE dish_name <> '' UNION ALL SELECT p_partkey, dish_name, CAST(item_number AS INTEGER), 'main' FROM parts UNION ALL SELECT p_partkey, dish_name, 1, 'main' FROM rest")
def option_split(spark, d):
    """Menu lines to dishes: options, separators, soups and the rest."""
    return M.menu_lines(_raw(spark, d).select("p_partkey", "dish_name").withColumnRenamed("dish_name", "text"))


# An element stream: purchases are logos, other events paragraphs; a user is a page.
@query("SELECT user_id, event_id, CAST(section AS BIGINT) AS section, restaurant FROM (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS section, last_value(CASE WHEN event_type = 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'Desperado' WHEN 1 THEN 'Weber' END END IGNORE NULLS) OVER w AS restaurant FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) WHERE event_type <> 'purchase' AND restaurant IS NOT NULL")
def section_carry_forward(spark, d):
    logo = F.element_at(F.array(F.lit("desperado.jpg"), F.lit("img/WEBER.png"), F.lit("other.png")), (F.col("event_id") % 3 + 1).cast("int"))
    el = _t(spark, d, "events").select(F.col("user_id").alias("path"), F.lit("2024-01-07").alias("date"), F.col("event_id").alias("pos"), F.when(F.col("event_type") == "purchase", "img").otherwise("p").alias("tag"), F.when(F.col("event_type") == "purchase", logo).alias("src"), F.lit("dish").alias("text"))
    return M.sections(el).select(F.col("path").alias("user_id"), F.col("pos").alias("event_id"), F.col("section").cast("long").alias("section"), "restaurant")


@query("SELECT DISTINCT strftime(CAST(o_orderdate AS DATE) - CAST(b AS INTEGER), '%Y-%m-%d') AS file_date, ['vasarnap', 'szombat', 'pentek', 'csutortok', 'szerda', 'kedd', 'hetfo'][CAST(b AS INTEGER) + 1] AS page FROM orders, range(0, 7) AS r(b) WHERE dayofweek(o_orderdate) = 0")
def weekly_schedule(spark, d):
    days = _t(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return G.weekly_schedule(days)


_P_TEXT = "regexp_replace(regexp_replace(" + _DECODED.format(x="regexp_replace(x, '(?s)(</p>|</article>).*', '')") + r", '&amp;?', '&', 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT url AS path, 'p' AS tag, count(*) AS n, CAST(sum(length({_P_TEXT})) AS BIGINT) AS chars FROM (SELECT url, unnest(string_split(html, '<p>')[2:]) AS x FROM pages) GROUP BY url")
def page_menus(spark, d):
    """Paragraphs of the scraped pages as elements."""
    pages = _t(spark, d, "pages").select(F.col("url").alias("path"), F.lit("2024-01-07").alias("date"), F.col("html").cast("binary").alias("content"))
    return G.page_elements(pages, close_p=True).groupBy("path", "tag").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"SELECT url AS path, {_P_TEXT} AS text FROM (SELECT url, unnest(string_split(html, '<p>')[2:]) AS x FROM pages)")
def page_texts(spark, d):
    """The text of every paragraph of the scraped pages."""
    pages = _t(spark, d, "pages").select(F.col("url").alias("path"), F.lit("2024-01-07").alias("date"), F.col("html").cast("binary").alias("content"))
    return G.page_elements(pages, close_p=True).where("tag = 'p'").select("path", "text")


# Pages of parts: 37 pages, on each every sixth element an image, known logo or not, and paragraphs of every kind between.
_EL_TAG = "CASE WHEN cast(floor(p_partkey / 37) AS bigint) % 6 = 0 THEN 'img' ELSE 'p' END"
_EL_SRC = "CASE WHEN cast(floor(p_partkey / 37) AS bigint) % 6 = 0 THEN CASE p_partkey % 5 WHEN 0 THEN 'img/Desperado.JPG' WHEN 1 THEN 'weber.png' WHEN 2 THEN 'kukta.jpg' WHEN 3 THEN '2darvas.gif' ELSE 'OTTHON.png' END END"
_EL_TEXT = "CASE p_partkey % 13 WHEN 0 THEN concat('Mai menü ', 1400 + p_size * 50, ' Ft') WHEN 1 THEN concat('Extra tál ', 1900 + p_size * 50, ' ft') WHEN 2 THEN concat('A: ', p_name) WHEN 3 THEN concat(p_name, ' B: rántott sajt') WHEN 4 THEN concat('Nyitva ', p_name) WHEN 5 THEN concat(p_name, ' leves 500 Ft') WHEN 6 THEN '  ' WHEN 7 THEN concat('Extra menü ', 1500 + p_size * 60, 'ft') WHEN 8 THEN '990 Ft' WHEN 9 THEN concat(' ', p_name, ' ') WHEN 10 THEN 'ab' WHEN 11 THEN concat(p_name, ', ft nélkül') ELSE p_name END"
_EL_RESTAURANT = "CASE " + " ".join(f"WHEN contains(lower(src), '{k}') THEN '{v}'" for k, v in V.RESTAURANTS) + f" ELSE '{V.UNKNOWN_RESTAURANT}' END"
_PRICE = r"TRY_CAST(nullif(regexp_extract(text, '([0-9]+)\s*(?:Ft|ft)', 1), '') AS INTEGER)"
_REGULAR = "contains(lower(text), 'menü') AND contains(lower(text), 'ft')"
_EXTRA = "contains(lower(text), 'extra') AND contains(lower(text), 'ft')"
_DAILY = (
    f"WITH el AS (SELECT p_partkey % 37 AS path, p_partkey AS pos, {_EL_TAG} AS tag, {_EL_SRC} AS src, trim({_EL_TEXT}) AS text FROM part), "
    + f"sec AS (SELECT *, sum(CASE WHEN tag = 'img' THEN 1 ELSE 0 END) OVER w AS section, last_value(CASE WHEN tag = 'img' AND {_any('lower(src)', V.LOGOS)} THEN {_EL_RESTAURANT} END IGNORE NULLS) OVER w AS restaurant FROM el WINDOW w AS (PARTITION BY path ORDER BY pos ROWS UNBOUNDED PRECEDING)), "
    + f"para AS (SELECT * FROM sec WHERE tag = 'p' AND restaurant IS NOT NULL AND text <> '' AND NOT {_any('lower(text)', V.PARAGRAPH_SKIP)}), "
    + f"prices AS (SELECT path, section, arg_max({_PRICE}, pos) FILTER (WHERE {_REGULAR} AND {_PRICE} BETWEEN {V.REGULAR_PRICE[0]} AND {V.REGULAR_PRICE[1]}) AS regular, arg_max({_PRICE}, pos) FILTER (WHERE NOT ({_REGULAR}) AND {_EXTRA} AND {_PRICE} BETWEEN {V.EXTRA_PRICE[0]} AND {V.EXTRA_PRICE[1]}) AS extra FROM para GROUP BY path, section), "
)


@query(
    _DAILY
    + _LINES.replace(f"WITH {_RAW}, ", "").replace("FROM raw", "FROM (SELECT pos AS p_partkey, text AS dish_name FROM para)")
    + _OPTIONS
    + ", dishes AS (SELECT p_partkey, dish_name, item_number, menu_type FROM opt WHERE dish_name <> '' UNION ALL SELECT p_partkey, dish_name, CAST(item_number AS INTEGER), 'main' FROM parts UNION ALL SELECT p_partkey, dish_name, 1, 'main' FROM rest) SELECT strftime(DATE '2024-01-01' + CAST(para.path AS INTEGER), '%Y-%m-%d') AS date, restaurant, dish_name, item_number, menu_type, regular, extra FROM dishes JOIN para ON para.pos = p_partkey LEFT JOIN prices ON prices.path = para.path AND prices.section = para.section"
)
def daily_menus(spark, d):
    """Whole pages of elements to menu rows with the prices of their sections."""
    el = _t(spark, d, "part").select((F.col("p_partkey") % 37).cast("string").alias("path"), F.expr("date_format(date_add(DATE '2024-01-01', cast(p_partkey % 37 AS int)), 'yyyy-MM-dd')").alias("date"), F.col("p_partkey").alias("pos"), F.expr(_EL_TAG).alias("tag"), F.expr(_EL_SRC).alias("src"), F.expr(_EL_TEXT).alias("text"))
    rows = M.daily_menus(el)
    return rows.select("date", "restaurant", "dish_name", "item_number", "menu_type", F.try_element_at("prices", F.lit("regular")).alias("regular"), F.try_element_at("prices", F.lit("extra")).alias("extra"))


@query("SELECT url AS path, regexp_extract(file, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) AS date FROM (SELECT url, concat(url, CASE page_id % 3 WHEN 0 THEN '/2024-05-05.html' WHEN 1 THEN concat('/x2023-11-', 10 + page_id % 20, '/2022-01-01') ELSE '/none.html' END) AS file FROM pages)")
def page_dates(spark, d):
    """Dates in paths of files."""
    file = F.expr("concat(url, CASE page_id % 3 WHEN 0 THEN '/2024-05-05.html' WHEN 1 THEN concat('/x2023-11-', 10 + page_id % 20, '/2022-01-01') ELSE '/none.html' END)")
    return _t(spark, d, "pages").select(F.col("url").alias("path"), G.date_of(file).alias("date"))
