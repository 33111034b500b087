"""Operators against DuckDB, causality of features, and blocks against whole series."""

import datetime
import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewright import queries as q
from tidewright.functions.windows import carried, numbered, running_sum, with_halo
from tidewright.operators import features, market
from tidewright.sources.views import bars

SF = "/root/testdata/sf0.001"
#: One of each kind; the driver compares all of them.
NAMES = ["p05_flagship_bollinger", "e02_trades", "f05_f06_ema_macd", "f12_f17_volatility", "l01_triple_barrier", "m04_as_of_join", "j01_walk_forward", "c15_c16_ledger", "n10_decayed_sentiment", "t04_order_plan"]


def plain(df: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of texts."""

    def text(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "-"
        if isinstance(v, float):
            return f"{v:.4f}"
        if isinstance(v, (pd.Timestamp, datetime.datetime)):
            return str(pd.Timestamp(v).tz_localize(None) if pd.Timestamp(v).tz is None else pd.Timestamp(v).tz_convert("UTC").tz_localize(None))
        return str(v)[:19] if isinstance(v, datetime.date) else str(v)

    return sorted(tuple(text(row[c]) for c in sorted(df.columns)) for row in df.astype(object).to_dict("records"))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, duck, name):
    ours, theirs = q.QUERIES[name](spark, SF).toPandas(), duck.sql(q.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    different = sum(a != b for a, b in zip(plain(ours), plain(theirs), strict=True))
    assert different <= len(ours) * 0.001  # a last digit may round either way


def test_every_query_with_sql_has_a_plan():
    assert set(q.ORACLE_SQL) <= set(q.QUERIES)
    assert len(q.QUERIES) > 100


def test_blocks_equal_whole_series(spark):
    b = bars(spark, SF).cache()
    small = with_halo(b, ["instrument"], 30, lambda d, w: d.withColumn("m", w.full(F.avg, "close", 30)), rows=64)
    w = Window.partitionBy("instrument").orderBy("rn").rowsBetween(-29, 0)
    whole = b.withColumn("m", F.when(F.count("close").over(w) == 30, F.avg("close").over(w)))
    gap = small.alias("a").join(whole.alias("b"), ["instrument", "rn"]).where("abs(a.m - b.m) > 1e-12 or (a.m is null) <> (b.m is null)")
    assert small.count() == b.count() and gap.count() == 0


def test_running_sum_and_carry_have_two_levels(spark):
    rows = [("a", i, float(i) if i % 5 == 0 else None) for i in range(1, 201)]
    df = spark.createDataFrame(rows, "instrument string, rn long, v double")
    out = carried(running_sum(df, ["instrument"], {"s": "v"}, rows=16), ["instrument"], "v", "last", rows=16).orderBy("rn").collect()
    total, last = 0.0, None
    for r in out:
        total, last = (total + r["v"], r["v"]) if r["v"] is not None else (total, last)
        assert (r["s"], r["last"]) == (total, last)


def test_future_does_not_change_the_past(spark):
    b = bars(spark, SF).where("instrument = 'A'").cache()
    cut = 300
    later = b.withColumn("close", F.when(F.col("rn") > cut, F.col("close") * 1.5).otherwise(F.col("close"))).withColumn("high", F.greatest("high", "close"))
    for build in (features.moving_exponentials, features.volatility, features.oscillators, features.volume):
        x, y = (build(d).where(F.col("rn") <= cut).drop("bid_close", "ask_close").orderBy("rn").toPandas() for d in (b, later))
        pd.testing.assert_frame_equal(x, y)


def test_labels_use_later_bars_only_up_to_the_hold(spark):
    b = bars(spark, SF).where("instrument = 'A'")
    assert market.triple_barrier(b, hold=10).count() == b.count() - 10


def test_empty_tables(spark):
    none = bars(spark, SF).where("false")
    for build in (features.returns, features.moving_exponentials, features.candle_shape, market.triple_barrier, market.raw_checks):
        assert build(none).count() == 0


def test_numbered_equals_row_number(spark):
    df = bars(spark, SF).drop("rn")
    a = numbered(df, ["instrument"], ["ts"], "month").select("instrument", "ts", "rn")
    b = df.withColumn("rn", F.row_number().over(Window.partitionBy("instrument").orderBy("ts")).cast("long")).select("instrument", "ts", "rn")
    assert a.exceptAll(b).count() == 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 9


def test_stream_and_batch_books_agree(spark):
    a, b = (sorted(q.QUERIES[n](spark, SF).collect()) for n in ("t07_o06_stream_book", "t07_batch_book"))
    assert [(r["instrument"], r["fills"]) for r in a] == [(r["instrument"], r["fills"]) for r in b]
    for x, y in zip(a, b, strict=True):
        assert abs(x["units"] - y["units"]) < 1e-9 and abs(x["realised"] - y["realised"]) < 1e-3 and abs(x["average"] - y["average"]) < 1e-6


def test_stream_bars_equal_sql(spark, duck):
    ours, theirs = q.QUERIES["o01_stream_bars"](spark, SF).toPandas(), duck.sql(q.ORACLE_SQL["o01_stream_bars"]).df()
    assert plain(ours) == plain(theirs)


def test_store_replaces_partitions_only(spark, tmp_path):
    from tidewright.sources import store

    candles = bars(spark, SF).drop("rn")
    store.write_store(candles, str(tmp_path / "s"))
    store.write_store(candles.where("ts >= '1999-01-01'"), str(tmp_path / "s"))
    assert store.read_store(spark, str(tmp_path / "s"), sealed=False).count() == candles.count()
    sealed = store.read_store(spark, str(tmp_path / "s"))
    assert sealed.agg(F.max("ts")).first()[0] < datetime.datetime(2001, 3, 7)


def test_keep_last_and_new_rows(spark):
    from tidewright.sources import store

    a = spark.createDataFrame([("x", 1, 1.0, 1), ("x", 1, 2.0, 2), ("y", 1, 3.0, 1)], "instrument string, ts long, v double, seq int")
    assert sorted(tuple(r) for r in store.keep_last(a, ["instrument", "ts"], "seq").select("instrument", "ts", "v").collect()) == [("x", 1, 2.0), ("y", 1, 3.0)]
    more = spark.createDataFrame([("x", 1, 9.0), ("x", 2, 9.0), ("z", 1, 9.0)], "instrument string, ts long, v double")
    assert store.new_rows(a.drop("seq"), more).count() == 5


def series(spark, rows, start="2024-01-01"):
    """Bars of one instrument from (open, high, low, close)."""
    t = datetime.datetime.fromisoformat(start)
    data = [("x", t + datetime.timedelta(days=i), i + 1, *map(float, r), 1) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "instrument string, ts timestamp, rn long, open double, high double, low double, close double, volume long")


def test_forecasts_below_the_threshold_are_flat_and_gaps_are_carried(spark):
    from tidewright.operators import strategies

    b = series(spark, [(1, 2, 0, 1)] * 6)
    made = [(0, 1, 0.9, 0), (1, 1, 0.5, 2), (3, -1, 0.7, 3), (5, 1, 0.9, 0)]  # no forecasts at bars 2 and 4
    t = datetime.datetime(2024, 1, 1)
    fc = spark.createDataFrame([("x", t + datetime.timedelta(days=i), s, c, g) for i, s, c, g in made], "instrument string, ts timestamp, signal int, confidence double, regime int")
    out = strategies.gated_positions(fc, b, {0: 0.52, 1: 0.52, 2: 0.55, 3: 0.62}).orderBy("rn").collect()
    assert [r["ungated"] for r in out] == [1, 1, 1, -1, -1, 1]
    assert [r["gated"] for r in out] == [1, 0, 0, -1, -1, 1]  # confidence 0.5 in regime 2 is an explicit 0
    assert [r["top"] for r in out] == [0] * 6
    assert [r["gated"] for r in strategies.gated_positions(fc, b, {}, carry=0).orderBy("rn").collect()] == [1, 0, 0, -1, 0, 1]


def test_small_rules_of_the_features(spark):
    flat = features.candle_shape(series(spark, [(1, 2, 0, 1), (2, 3, 1, 1)])).orderBy("rn").collect()
    assert [r["direction"] for r in flat] == [1, -1] and flat[0]["body_ratio"] == 0
    up = features.volume(series(spark, [(1, 2, 0, 1), (1, 2, 0, 2), (1, 2, 0, 1)])).orderBy("rn").collect()
    assert [r["obv"] for r in up] == [None, 1, 0]
    hours = spark.createDataFrame([(datetime.datetime(2024, 1, 1, h),) for h in (6, 7, 11, 12, 15)], "ts timestamp")
    assert [(r["is_london"], r["is_overlap"]) for r in features.calendar(hours).orderBy("ts").collect()] == [(0, 0), (1, 0), (1, 0), (0, 1), (0, 1)]


def test_exponential_means_weigh_gaps_as_pandas(spark):
    from tidewright.functions.windows import ewm

    values = [None, 1.0, 2.0, None, None, 4.0, 3.0, None, 5.0]
    df = spark.createDataFrame([("x", i + 1, v) for i, v in enumerate(values)], "instrument string, rn long, v double")
    got = [r["m"] for r in with_halo(df, ["instrument"], 20, lambda d, w: ewm(d, w, {"m": ("v", 0.2)})).orderBy("rn").collect()]
    want = pd.Series(values).ewm(alpha=0.2, adjust=False).mean().tolist()
    assert got[0] is None and all(abs(a - b) < 1e-12 for a, b in zip(got[1:], want[1:], strict=True))


def test_labels_without_a_range(spark):
    still = market.triple_barrier(series(spark, [(1, 1, 1, 1)] * 15), hold=10).collect()
    assert {(r["label"], r["ret"], r["holding_bars"], r["barrier"]) for r in still} == {(0, 0.0, 0, "vertical")}
    aged = market.sample_weights(spark.createDataFrame([("x", datetime.datetime(2024, 1, 1), i, 0.5) for i in range(1, 5)], "instrument string, ts timestamp, rn long, ret double")).collect()
    assert abs(sum(r["by_age"] for r in aged) - 4) < 1e-12 and abs(max(r["by_age"] for r in aged) / min(r["by_age"] for r in aged) - 2.718281828459045) < 1e-9


def test_as_of_join_of_many_instruments_and_series(spark):
    n = 1_200
    b = spark.range(n).selectExpr("cast(id as string) as instrument", "timestamp'2024-01-02 00:00:00' as ts")
    o = spark.range(n).selectExpr("cast(id as string) as series", "timestamp'2024-01-01' as date", "timestamp'2024-01-01 12:00:00' as available_at", "double(id) as value")
    one = market.as_of(b, o.where("series < '2'"), ["value"])
    assert one.count() == n * o.where("series < '2'").count() and one.where("value is null").count() == 0
    assert market.as_of(b.limit(2), o, ["value"]).where("value = double(series)").count() == 2 * n


def test_ledger_closes_at_the_end_and_stops(spark):
    from tidewright.operators import decisions as dc

    b = series(spark, [(1, 1, 1, 1), (1, 1.2, 1, 1.1), (1.1, 1.2, 1, 1.2)], "2024-01-02").withColumn("units", F.lit(1000)).withColumn("action", F.lit("trade"))
    out = dc.ledger(b).orderBy("rn").collect()
    assert [r["pos"] for r in out] == [0, 1000, 0] and [r["delta"] for r in out] == [0, 1000, -1000]
    assert abs(out[-1]["equity"] - 10_000 - 200 + sum(r["paid"] for r in out)) < 1e-6 and out[-1]["paid"] > 0
    crash = series(spark, [(1, 1, 1, 1), (1, 1, 1, 1), (1, 1, 0.1, 0.1), (0.1, 1, 0.1, 1), (1, 1, 1, 1)], "2024-01-02").withColumn("units", F.lit(5000))
    assert [r["pos"] for r in dc.ledger(crash).orderBy("rn").collect()] == [0, 5000, 5000, 0, 0]
    wild = spark.createDataFrame([("trade", True, 900_000), ("flat", True, 10), ("reduce", False, 10), ("reduce", True, -10)], "action string, compliant boolean, units int")
    assert [r["units"] for r in dc.target_units(wild).collect()] == [500_000, 0, 0, -10]


def test_forward_filter_equals_the_recursion_and_is_causal(spark):
    import numpy as np

    from tidewright.operators import live_reports as lr

    r = np.random.default_rng(1)
    x = r.normal(size=300) * 0.01
    rows = spark.createDataFrame([("x", i + 1, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i), float(v), int(i) % 4) for i, v in enumerate(x)], "instrument string, rn long, ts timestamp, x double, regime int")
    states, moves = (m.toPandas() for m in lr.regime_model(rows))
    got = lr.forward_filter(rows, spark.createDataFrame(states), spark.createDataFrame(moves), block=64).orderBy("rn").toPandas()
    a = moves.pivot(index="before", columns="state", values="p").to_numpy()
    mean, vol = (states.sort_values("state")[c].to_numpy() for c in ("mean", "vol"))
    v = np.full(4, 0.25)
    for t in range(300):
        v = (v if t == 0 else v @ a) * np.exp(-0.5 * ((x[t] - mean) / vol) ** 2) / vol
        v = v / v.sum()
        assert np.abs(got.loc[t, ["p0", "p1", "p2", "p3"]].to_numpy(float) - v).max() < 1e-9
    later = rows.withColumn("x", F.when(F.col("rn") > 200, -F.col("x")).otherwise(F.col("x")))
    again = lr.forward_filter(later, spark.createDataFrame(states), spark.createDataFrame(moves), block=64).where("rn <= 200").orderBy("rn").toPandas()
    assert np.abs(again[["p0", "p1", "p2", "p3"]].to_numpy() - got[["p0", "p1", "p2", "p3"]].to_numpy()[:200]).max() < 1e-12


def test_ranges_of_ids_join_over_blocks(spark):
    from tidewright.sources import store

    ids = [*range(1, 20), 25, *range(30, 45), 64]
    out = store.id_ranges(spark.createDataFrame([("a", i) for i in [*ids, 3]], "part string, id long"), block=8)
    assert sorted(r["text"] for r in out.collect()) == ["1-19", "25", "30-44", "64"]
    assert sorted(r["id"] for r in store.parse_ranges(out).collect()) == ids


def test_trades_have_clock_times(spark):
    from tidewright.operators import live_reports as lr

    mids = [1.0, 1.001, 1.002, 1.001, 1.0, 1.001]
    rows = [("s", "x", datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i), i + 1, p, m, m - 4e-5, m + 4e-5) for i, (p, m) in enumerate(zip([1.0, 1.0, -1.0, 0.0, 1.0, 1.0], mids, strict=True))]
    ledger = lr.paper_ledger(spark.createDataFrame(rows, "strategy string, instrument string, ts timestamp, rn long, pos double, mid double, bid double, ask double"))
    last = ledger.orderBy("rn").collect()[-1]
    assert (last["trades"], round(last["gross_pips"], 6), round(last["cost_ref_pips"], 6)) == (3, 40.0, 2.0)
    t = lr.clock_trades(lr.evaluator_frame(ledger)).orderBy("opened").collect()
    assert [(r["opened"].day, r["closed"].day, r["direction"], round(r["gross_pips"], 6), r["open"]) for r in t] == [(2, 4, 1, 20.0, False), (4, 5, -1, 10.0, False), (6, 7, 1, 10.0, True)]


def test_store_merges_parts_and_folds_days(spark, tmp_path):
    from tidewright.sources import store

    path = str(tmp_path / "s")
    day = datetime.datetime(2024, 1, 30)
    rows = [("x", day + datetime.timedelta(days=i), float(i)) for i in range(5)]
    d = spark.createDataFrame(rows, "instrument string, ts timestamp, close double")
    store.write_store(d.where("close < 3"), path, "2024-02")
    store.write_store(d.where("close >= 2").withColumn("close", F.col("close") * 10), path, "2024-02")
    assert sorted(r["period"] for r in store.existing(spark, path).select("period").distinct().collect()) == ["2024-01", "2024-02-01", "2024-02-02", "2024-02-03"]
    assert store.compact(spark, path, "2024-03") == 3 and store.compact(spark, path, "2024-03") == 0
    assert [r["close"] for r in store.read_store(spark, path, sealed=False).orderBy("ts").collect()] == [0.0, 1.0, 20.0, 30.0, 40.0]
    assert {r["period"] for r in store.existing(spark, path).select("period").distinct().collect()} == {"2024-01", "2024-02"}


def test_blocks_resume_and_pass_over_what_cannot_be_read(spark, tmp_path):
    from tidewright.sources import store

    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    rows = spark.range(12).selectExpr("id as event_id", "cast(id % 4 as int) as block_id")
    plan = store.block_plan(rows)
    store.write_blocks(rows.where("block_id = 1"), a)
    store.write_blocks(rows.where("block_id in (1, 2)"), b)
    broken = tmp_path / "b" / "block_id=3"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"PAR1 not a file")
    store.merge_blocks(b, a, spark)
    assert sorted(r["block_id"] for r in store.missing_blocks(plan, a).collect()) == [0, 3]
    assert [r["block_id"] for r in store.missing_blocks(plan, a, shard=(1, 2)).collect()] == [3] and store.missing_blocks(plan, a, skip="0-3").count() == 0
    with pytest.raises(ValueError):
        store.read_design(plan, a)
    store.write_blocks(rows, a)
    assert store.read_design(plan, a).count() == 12
