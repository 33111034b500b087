"""Streams with state against their batch twins, over restarts and replays."""

import pytest
from pyspark.sql import functions as F

from tidewright.operators.decisions import decisions
from tidewright.operators.live_reports import forward_filter, regime_model
from tidewright.sources.store import commit_batch, read_journal
from tidewright.streaming import stateful as s
from tidewright.streaming.live import replayed

SF = "/root/testdata/sf0.001"


def rows(df, places=9):
    return sorted(tuple(round(v, places) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def sparse(spark):
    return s.sparse_decisions(spark, SF).cache()


def test_carry_goes_on_after_a_restart(spark, sparse, tmp_path):
    """A stream that is stopped and started anew on more files equals the batch over all of them."""
    late = F.col("ts") >= F.lit("2024-01-14").cast("timestamp")
    source, base = str(tmp_path / "in"), str(tmp_path / "run")
    plain = sparse.drop("rn")
    with s.rocks(spark):
        for part in (~late, late):
            plain.where(part).coalesce(1).write.mode("append").parquet(source)
            out = replayed(s.stream_carry(spark.readStream.schema(plain.schema).parquet(source)), base=base)
    assert rows(out) == rows(s.batch_carry(sparse).select("instrument", "event_id", "held"))


def test_hold_ends_after_twelve_bars(spark):
    bars = [("a", f"2024-01-01 00:{m:02d}:00", m, m + 1, 1.0 if m == 1 else None) for m in range(20)]
    d = spark.createDataFrame(bars, "instrument string, ts string, event_id long, rn long, target double").withColumn("ts", F.col("ts").cast("timestamp"))
    held = [r["held"] for r in s.batch_carry(d).orderBy("rn").collect()]
    assert held == [0.0] + [1.0] * 13 + [0.0] * 6
    with s.rocks(spark):
        assert rows(replayed(s.stream_carry(s.landed(d.drop("rn"))))) == rows(s.batch_carry(d).select("instrument", "event_id", "held"))


def test_silence_is_told_without_a_later_tick(spark):
    """Instrument b falls silent; a goes on, so that event time passes b's hour."""
    ticks = [("a", f"2024-01-0{d} {h:02d}:00:00", d * 100 + h, 10_000.0 - 30 * h) for d in (1, 2) for h in range(24)] + [("b", "2024-01-01 05:00:00", 1, 10_000.0), ("b", "2024-01-01 05:30:00", 2, 8_000.0)]
    d = spark.createDataFrame(ticks, "instrument string, ts string, tick_id long, equity double").withColumn("ts", F.col("ts").cast("timestamp"))
    with s.rocks(spark):
        out = replayed(s.stream_alerts(s.landed(d, "day")))
    assert sorted(map(str, out.collect())) == sorted(map(str, s.batch_alerts(d).collect()))
    silent = [str(r["raised_at"]) for r in out.where("instrument = 'b' and alert = 'silent'").collect()]
    assert silent == ["2024-01-01 06:30:00"]
    assert {r["alert"] for r in out.where("instrument = 'b' and tick_id = 2").collect()} == {"breaker", "drawdown_high", "day_loss"}


def test_online_regimes_equal_the_batch_filter(spark):
    d = s.online_rows(spark, SF)
    seed = s.model_seed(*regime_model(d))
    with s.rocks(spark):
        out = replayed(s.stream_online(s.landed(d), seed)).select("instrument", "rn", "p0", "p1", "p2", "p3")
    assert rows(out, 6) == rows(forward_filter(d, *regime_model(d)).select("instrument", "rn", "p0", "p1", "p2", "p3"), 6)
    assert decisions(spark, SF).count() == out.count()


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "journal")
    make = lambda values: spark.createDataFrame(values, "tag string, v int, day string").withColumn("day", F.col("day").cast("date"))
    one, two = make([("a", 1, "2024-01-01"), ("b", 2, "2024-01-02")]), make([("b", 3, "2024-01-02"), ("c", 4, "2024-01-02")])
    for number, batch in ((0, one), (1, two), (1, two), (0, one)):
        commit_batch(batch, path, number, ["tag"])
    assert spark.read.parquet(path).count() == 4
    assert rows(read_journal(spark, path, ["tag"]).select("tag", "v")) == [("a", 1), ("b", 3), ("c", 4)]
    other = str(tmp_path / "orders")
    for number, batch in ((0, one), (1, two), (1, two)):
        commit_batch(batch, other, number, ["tag"], first=True, order=["v"])
    assert rows(spark.read.parquet(other).select("tag", "v")) == [("a", 1), ("b", 2), ("c", 4)]
