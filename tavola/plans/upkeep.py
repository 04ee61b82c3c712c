"""Queries of what is kept up to date, observed or laid out; see the catalogue for how tables stand for menus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tavola.functions.collated import spellings
from tavola.operators import dishes as D
from tavola.operators import layout
from tavola.operators import observed as O
from tavola.operators import partials as B
from tavola.operators import seasonal as T
from tavola.operators.keymatch import best_keys
from tavola.operators.lineage import shared_folder
from tavola.operators.nameindex import NameIndex
from tavola.operators.suffixes import learn, lemmas_of
from tavola.plans import catalogue as C
from tavola.streaming import seen

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Words of clients' names are keys, in order of the first client who has them; addresses are texts that may contain them.
@query(
    "WITH keys AS (SELECT min(client_id) AS ordinal, key, upper(key) AS canonical FROM (SELECT client_id, unnest(string_split(lower(name), ' ')) AS key FROM clients) WHERE length(key) > 2 GROUP BY key), "
    "texts AS (SELECT DISTINCT lower(email) AS low FROM clients WHERE email IS NOT NULL) "
    "SELECT low, arg_min(canonical, (key <> low, ordinal, key)) AS canonical FROM texts JOIN keys ON contains(low, key) GROUP BY low"
)
def keys_in_texts(spark, d):
    """The first key that each address contains, by automata over shards of the keys."""
    clients = C._t(spark, d, "clients")
    words = clients.select("client_id", F.explode(F.split(F.lower("name"), " ")).alias("key")).where(F.length("key") > 2)
    keys = words.groupBy("key").agg(F.min("client_id").alias("ordinal")).withColumn("canonical", F.upper("key"))
    return best_keys(clients.select(F.lower("email").alias("low")), keys, shard_chars=20_000)


@query()
def auto_groups_in_batches(spark, d):
    """``auto_groups`` of the catalogue, from an index that takes the documents in three batches."""
    index = NameIndex(spark, shared_folder(spark, "names"))
    docs = C._t(spark, d, "documents")
    for k in range(3):
        index.add(D.dish_count(docs.where(F.pmod("doc_id", F.lit(3)) == k), "text"), k)
    return index.groups().select(F.sha2("dish_name", 256).alias("name_sha256"), F.sha2("canonical_name", 256).alias("canonical_sha256"))


@query()
def seasonal_from_partials(spark, d):
    """``seasonal_summary`` of the catalogue, from weekly partials; the weeks of a year first come with all rows twice, then again as they are."""
    rows = T.matched(C._menus(spark, d), C._dishes(spark, d))
    table = shared_folder(spark, "partials")
    again = rows.where(F.year("date") == 1996)
    B.replace_weeks(rows.unionAll(again), table)
    edges = B.week_of(F.col("date"))  # the first and last week of the year have days of its neighbours, too
    weeks = again.select(edges.alias("week")).distinct()
    B.replace_weeks(rows.withColumn("week", edges).join(F.broadcast(weeks), "week", "left_semi").drop("week"), table)
    return T.seasonal_summary(B.merged(B.read_partials(spark, table)))


@query()
def seen_clients(spark, d):
    """First and last day, clicks by month and whether a client is gone, from a stream that stops and starts again on its checkpoint."""
    clicks = C._t(spark, d, "clicks")
    rows = clicks.select(F.col("client_id").cast("string").alias("canonical_name"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.month("ts").alias("month"), F.coalesce("arrived_at", "ts").cast("timestamp").alias("arrived"))
    base = shared_folder(spark, "seen")
    for k, part in enumerate((F.col("arrived") < "2024-03-15", F.col("arrived") >= "2024-03-15")):
        rows.where(part).write.mode("append").parquet(f"{base}/in/{k}")
        arriving = spark.readStream.schema(rows.schema).parquet(f"{base}/in/*")
        seen.keep_seen(arriving, f"{base}/out", f"{base}/check").awaitTermination()
    return seen.latest_seen(spark, f"{base}/out")


def _one_row(spark, values: dict) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} long" for k in values))


@query(C.ORACLE["run_metrics"])
def run_metrics_observed(spark, d):
    """``run_metrics`` of the catalogue, from the plan that matches the rows."""
    li = C._t(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_shipdate").join(C._t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    menus = li.select(F.expr(C._MESSY_NAME).alias("dish_name"), F.expr(C._MESSY_DATE.format(day="date_format(l_shipdate, 'yyyy-MM-dd')")).alias("date"))
    rows, seen_ = O.matched(menus, C._known(spark, d))
    rows.write.format("noop").mode("overwrite").save()
    return _one_row(spark, O.figures(seen_))


@query(C.ORACLE["step_counts"])
def step_counts_observed(spark, d):
    """``step_counts`` of the catalogue, from the plan that cleans the names."""
    rows, steps = O.clean_dishes(C._raw(spark, d).select("dish_name").distinct().withColumn("count", F.lit(1)))
    rows.write.format("noop").mode("overwrite").save()
    return _one_row(spark, O.figures(*steps))


@query()
def matched_by_bucket(spark, d):
    """Monthly counts from menus that are laid out by name."""
    folder = shared_folder(spark, "menus")
    name = folder.rsplit("/", 1)[1].replace("-", "_")
    layout.write_menus(C._menus(spark, d), name, folder, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return T.monthly_counts(layout.matched_again(spark, name, C._dishes(spark, d)))


@query("WITH e AS (SELECT name AS one, count(*) AS n FROM clients WHERE name IS NOT NULL GROUP BY name) SELECT arg_min(one, (-n, one)) AS name, CAST(sum(n) AS BIGINT) AS count, count(*) AS spellings FROM e GROUP BY strip_accents(lower(one))")
def spellings_collated(spark, d):
    """Clients' names that differ in case and accents alone."""
    return spellings(C._t(spark, d, "clients"), "name", None)


# Of words that the documents have both with and without an end of one to three letters the one without is the lemma: the longest such.
_WORDS = r"w AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+')) AS word FROM documents) WHERE length(word) BETWEEN 4 AND 16)"
_PAIRS = "pairs AS (SELECT word, left(word, length(word) - cut) AS lemma, cut FROM (SELECT a.word, min(k) AS cut FROM w a, range(1, 4) AS r(k) WHERE length(a.word) - k >= 4 AND left(a.word, length(a.word) - CAST(k AS INTEGER)) IN (SELECT word FROM w) GROUP BY a.word))"
_RULES = (
    "ends AS (SELECT right(word, CAST(k AS INTEGER)) AS suffix, cut, count(*) AS n FROM pairs, range(1, 7) AS r(k) WHERE k >= cut AND k <= length(word) GROUP BY ALL), "
    "kept AS (SELECT suffix, arg_min(cut, (-n, cut)) AS cut, max(n) AS n, sum(n) AS total FROM ends GROUP BY suffix HAVING max(n) >= 3 AND max(n) >= 0.5 * sum(n)), "
    "rules AS (SELECT a.* FROM kept a LEFT JOIN kept b ON b.suffix = substr(a.suffix, 2) WHERE b.cut IS DISTINCT FROM a.cut)"
)


def _words(spark, d) -> DataFrame:
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-öø-ÿ]+"), F.lit(0))
    return C._t(spark, d, "documents").select(F.explode(found).alias("word")).where(F.length("word").between(4, 16)).distinct()


def _word_pairs(words: DataFrame) -> DataFrame:
    shorter = words.select("word", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")).where(F.length("word") - F.col("k") >= 4).withColumn("lemma", F.expr("left(word, length(word) - k)"))
    return shorter.join(words.withColumnRenamed("word", "lemma"), "lemma", "left_semi").groupBy("word").agg(F.min_by("lemma", "k").alias("lemma"))


@query(f"WITH {_WORDS}, {_PAIRS}, {_RULES} SELECT suffix, CAST(cut AS INTEGER) AS cut, '' AS add, n, CAST(total AS BIGINT) AS of FROM rules")
def suffix_rules(spark, d):
    """Rules on word ends, learnt from all words of the documents."""
    return learn(_word_pairs(_words(spark, d)))


@query(
    f"WITH {_WORDS}, {_PAIRS}, {_RULES}, fit AS (SELECT w.word, max_by(suffix, length(suffix)) AS suffix, max_by(cut, length(suffix)) AS cut FROM w JOIN rules ON length(suffix) <= length(w.word) AND right(w.word, length(suffix)) = suffix WHERE length(w.word) > cut GROUP BY w.word) "
    "SELECT w.word, coalesce(left(w.word, length(w.word) - CAST(fit.cut AS INTEGER)), w.word) AS lemma, suffix FROM w LEFT JOIN fit ON fit.word = w.word"
)
def learned_lemmas(spark, d):
    """Lemmas of all words of the documents by these rules."""
    words = _words(spark, d)
    return lemmas_of(words, learn(_word_pairs(words)))
