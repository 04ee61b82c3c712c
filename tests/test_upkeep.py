"""Queries of what is kept up to date against those that compute all anew, and against loops."""

import collections
import datetime
import random

import __spark_entry__ as entry
from pyspark.sql import functions as F

from tavola.operators import layout
from tavola.operators import seasonal as T


def run(spark, name, folder):
    df = entry.queries()[name](spark, str(folder))
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def menus(spark, folder):
    rng = random.Random(3)
    day = datetime.date(1995, 6, 1)
    lines = [(i % 97, rng.randrange(12), 1, day + datetime.timedelta(days=rng.randrange(900))) for i in range(1200)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_shipdate date").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(i, f"{'gulyás' if i % 2 else 'hal'} leves {i % 7}", i) for i in range(12)], "p_partkey long, p_name string, p_size int").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(1, "s")], "s_suppkey long, s_name string").write.parquet(f"{folder}/supplier.parquet")


def test_seasons_of_partials_and_buckets(spark, tmp_path):
    menus(spark, tmp_path)
    assert run(spark, "seasonal_from_partials", tmp_path) == run(spark, "seasonal_summary", tmp_path) != []
    assert run(spark, "matched_by_bucket", tmp_path) == run(spark, "monthly_counts", tmp_path) != []
    assert run(spark, "run_metrics_observed", tmp_path) == run(spark, "run_metrics", tmp_path)
    assert run(spark, "step_counts_observed", tmp_path) == run(spark, "step_counts", tmp_path)


def test_no_exchange_on_the_side_of_menus(spark, tmp_path):
    rows = spark.createDataFrame([(" a ", "2024-01-02"), ("b", "2024-02-02"), ("", "x"), ("a", "2024-xx")], "dish_name string, date string")
    names = T.canonical_map(spark.createDataFrame([("a", "A"), ("b", "B")], "dish_name string, canonical_name string"))
    layout.write_menus(rows, "laid_out", f"{tmp_path}/m", 4)
    out = layout.matched_again(spark, "laid_out", names)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, T.matched(rows, names).collect()))
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    side = plan[: plan.index("FileScan parquet")]
    menu_side = side[side.rindex("SortMergeJoin") :]
    assert "Exchange" not in menu_side and "Bucketed: true" in plan


def test_documents_in_batches(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{chr(97 + i)}" for i in range(20)]
    texts = [" ".join(rng.sample(words, rng.randrange(6, 15))) for _ in range(60)]
    texts += [" ".join([*t.split(), "extra"]) for t in texts[:30]] + texts[:10] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert run(spark, "auto_groups_in_batches", tmp_path) == run(spark, "auto_groups", tmp_path) != []


def test_clients_seen(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for i in range(800):
        ts = datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randrange(150 * 1440))
        rows.append((i, None if rng.random() < 0.03 else ts, None if rng.random() < 0.05 else ts + datetime.timedelta(days=rng.choice([0, 0, 20])), None if rng.random() < 0.03 else rng.choice([1, 1, 1, *range(2, 40)])))
    rows += [(9000, datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 6), 77), rows[3]]
    frame = spark.createDataFrame(rows, "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long")
    frame.write.parquet(f"{tmp_path}/clicks.parquet")
    known = [(str(c), ts, at or ts) for _, ts, at, c in rows if c is not None and ts is not None]
    days, arrivals = collections.defaultdict(list), collections.defaultdict(list)
    for c, ts, at in known:
        days[c].append(str(ts.date()))
        arrivals[c].append(at)
    now = max(at for _, _, at in known)
    want = {c: (len(d), min(d), max(d), max(arrivals[c]) + datetime.timedelta(days=30) < now, *(sum(int(x[5:7]) == m for x in d) for m in range(1, 13))) for c, d in days.items()}
    got = {r.canonical_name: (r.total, r.first_seen, r.last_seen, r.gone, *(r[m] for m in T.MONTHS)) for r in entry.queries()["seen_clients"](spark, str(tmp_path)).collect()}
    assert got == want and got["77"][3]
