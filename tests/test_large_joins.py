"""Interval joins and window totals on dense times: right at the bounds, without pairs where none are asked for."""

import datetime
import math
import random

from pyspark.sql import functions as F

from tidewright.operators.decisions import decayed_sentiment, in_window
from tidewright.operators.live_reports import assembled, macro_signal, macro_views

EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
HOUR = 3_600_000_000


def sample(spark, bars=60, articles=80):
    """Bars and articles of some hours, many at one instant or exactly at the bounds; micros since EPOCH."""
    r = random.Random(5)
    published = [r.choice([r.randrange(-9 * HOUR, 9 * HOUR), r.randrange(-9, 9) * HOUR]) for _ in range(articles)] + [HOUR] * 7
    times = [r.choice([r.randrange(-9 * HOUR, 9 * HOUR), r.randrange(-9, 9) * HOUR, r.choice(published) + 4 * HOUR, r.choice(published)]) for _ in range(bars)]
    a = [(i, p, r.choice([-1.0, 0.0, 1.0])) for i, p in enumerate(published)]
    b = [("X", t) for t in times]
    when = lambda c: F.timestamp_micros(F.col(c) + int(EPOCH.timestamp()) * 1_000_000)
    left = spark.createDataFrame([*b, ("X", None)], "instrument string, at long").select("instrument", when("at").alias("ts"))
    right = spark.createDataFrame([*a, (-1, None, 1.0)], "doc_id long, at long, score double").select("doc_id", when("at").alias("published_at"), "score", F.abs("score").alias("intensity"))
    return b, a, left, right


def micros(name):
    return (F.unix_micros(name) - int(EPOCH.timestamp()) * 1_000_000).alias(name)


def test_interval_join_is_exact_and_spread_over_all_partitions(spark):
    b, a, left, right = sample(spark)
    times = {t for _, t in b}
    out = in_window(left.select("ts").distinct(), right.select("doc_id", "published_at"), 4, most=3)
    assert out.columns == ["ts", "published_at", "age", "doc_id"]
    # the size of the input says nothing about the result: partitions are not merged
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = sorted((x["ts"], x["doc_id"]) for x in out.select(micros("ts"), "doc_id").collect())
    assert got == sorted((t, i) for t in times for i, p, _ in a if t - 4 * HOUR < p <= t)


def test_interval_join_cuts_rows_of_several_bars_to_the_bounds(spark):
    b, a, left, right = sample(spark)
    times = {t for _, t in b}
    for rows in (1, 2, 1_000):
        out = in_window(left.select("ts").distinct(), right.select("doc_id", "published_at"), 4, most=2, times=rows, places=6)
        got = sorted((x["ts"], x["doc_id"], x["age"]) for x in out.select(micros("ts"), "doc_id", "age").collect())
        assert got == sorted((t, i, round((t - p) / HOUR, 6)) for t in times for i, p, _ in a if t - 4 * HOUR < p <= t)
    assert in_window(left.where("false").select("ts"), right.select("doc_id", "published_at"), 4).count() == 0


def test_interval_join_orders_pairs_so_that_files_are_small(spark, tmp_path):
    start = int(EPOCH.timestamp()) * 1_000_000
    # 2,000 bars of 3 hours, of which the first sees 60 instants of 50 articles, the last 239
    bars = spark.range(2_000).select(F.timestamp_micros(F.lit(start) + HOUR + F.col("id") * 5_399_977).alias("ts"))
    articles = spark.range(12_000).select(F.xxhash64("id").alias("doc_id"), F.timestamp_micros(F.lit(start) + (F.col("id") % 240) * 60_000_000).alias("published_at"))
    in_window(bars, articles, 4, places=6).select("ts", "doc_id", "age").write.parquet(str(tmp_path / "pairs"))
    files = list((tmp_path / "pairs").glob("*.parquet"))
    pairs = sum(50 * (1 + min(239, (HOUR + i * 5_399_977) // 60_000_000)) for i in range(2_000))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == pairs
    assert sum(f.stat().st_size for f in files) < 1.0 * pairs


def dense(spark, n=40_000):
    """n bars that all see the same n articles: 1.6 * 10^9 pairs."""
    start = int(EPOCH.timestamp()) * 1_000_000
    bars = spark.range(n).select(F.lit("X").alias("instrument"), F.timestamp_micros(F.lit(start) + HOUR + F.col("id") * 40_000).alias("ts"))
    return bars, spark.range(n).select(F.col("id").alias("doc_id"), F.timestamp_micros(F.lit(start) + F.col("id") * 80_000).alias("published_at"), F.lit(1.0).alias("score"), F.lit(1.0).alias("intensity"))


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_macro_signal_equals_loops_without_pairs(spark):
    b, a, left, right = sample(spark)
    views = macro_views(right)
    known = {r["doc_id"]: r for r in views.collect()}
    out = macro_signal(left, views)
    assert joins(out) == 1  # only that of bars and times
    rows = out.select("*", micros("ts").alias("at")).collect()
    assert len(rows) == len(b) + 1
    span = {"immediate": 1.0, "hours": 0.7, "days": 0.4, "weeks": 0.2}
    for r in rows:
        seen = [(known[i], known[i]["confidence"] * 0.8 ** ((r["at"] - p) / HOUR)) for i, p, _ in a if r["at"] is not None and r["at"] - 6 * HOUR < p <= r["at"]]
        total = sum(w for _, w in seen)
        if total < 1e-8:
            assert (r["macro_signal"], r["events"], r["surprise"], r["confidence"]) == (0, 0, 0, 0)
            continue
        bias = round(sum(w * v["bias"] for v, w in seen) / total, 9)
        signal = max(-1, min(1, round(bias * 2))) if abs(bias) > 0.1 else 0
        assert (r["macro_signal"], r["events"], r["confidence"]) == (signal, len(seen), max(v["confidence"] for v, _ in seen))
        assert math.isclose(r["surprise"], sum(w * v["surprise"] for v, w in seen) / total, abs_tol=1e-12)
        assert math.isclose(r["horizon"], sum(w * span[v["horizon"]] for v, w in seen) / total, abs_tol=1e-12)


def test_macro_signal_of_dense_times(spark):
    bars, articles = dense(spark)
    got = macro_signal(bars, macro_views(articles)).agg(F.min("events"), F.max("events"), F.count("*")).first()
    assert tuple(got) == (40_000, 40_000, 40_000)


def test_decayed_sentiment_equals_loops_without_pairs(spark):
    b, a, left, right = sample(spark)
    out = decayed_sentiment(left, right)
    assert joins(out) == 1  # only that of bars and times
    rows = out.select("*", micros("ts").alias("at")).collect()
    assert len(rows) == len(b) + 1
    for r in rows:
        seen = [(s, 0.9 ** ((r["at"] - p) / HOUR)) for _, p, s in a if r["at"] is not None and r["at"] - 4 * HOUR < p <= r["at"]]
        n, total = len(seen), sum(w for _, w in seen)
        score = sum(w * s for s, w in seen) / total if n else 0.0
        assert r["articles"] == n and math.isclose(r["score"], score, abs_tol=1e-12)
        assert r["signal"] == (1 if round(score, 9) > 0.15 else -1 if round(score, 9) < -0.15 else 0)
        assert math.isclose(r["intensity"], sum(w * abs(s) for s, w in seen) / total if n else 0.0, abs_tol=1e-12)
        assert math.isclose(r["positive"], sum(s > 0 for s, _ in seen) / n if n else 0.0) and math.isclose(r["negative"], sum(s < 0 for s, _ in seen) / n if n else 0.0)


def test_decayed_sentiment_of_dense_times(spark):
    bars, articles = dense(spark)
    assert tuple(decayed_sentiment(bars, articles).agg(F.min("articles"), F.max("articles"), F.count("*")).first()) == (40_000, 40_000, 40_000)


def test_feature_table_reads_trades_and_orders_once(spark):
    out = assembled(spark, "/root/testdata/sf0.001")
    assert out.inputFiles() == []  # what grows with the input is computed before; the plan holds bars and observations only
