"""Full forms of quality, evaluation, order, risk and panel operators against DuckDB on the smallest tables, and small cases by hand."""

import duckdb
import pytest
from pyspark.sql import functions as F

from test_engine import plain
from tidewright import queries as q
from tidewright.functions.windows import normal_quantile
from tidewright.operators import documents, orders, panels, power, quality, risk_rules
from tidewright.operators.evaluation import best_of
from tidewright.sources.store import compact, read_store, write_store
from tidewright.streaming import stateful

SF = "/root/testdata/sf0.001"
#: One or two of each module; the driver compares all of them.
NAMES = [
    "r01_r02_candles_h4", "q06_contract_rules", "q10_health_rules", "e08_split_aggregate", "e15_sentiment_evaluation", "e19_placements", "e09_best_of_strategies", "t06_reconciliations", "c16_currency_ledger",
    "c20_report_by_check", "c03_costed_series", "n05_tuned_by_week", "j12_blocks_with_run_up", "m01_release_calendar", "x05_snapshot_document", "s09_rewrite_years", "o09_full_monitor", "p11_planted_edge",
]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in "lineitem orders events documents labels".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, duck, name):
    ours, theirs = q.QUERIES[name](spark, SF).toPandas(), duck.sql(q.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    days = lambda rows: [tuple(x.removesuffix(" 00:00:00") for x in r) for r in rows]
    assert days(plain(ours)) == days(plain(theirs))


def test_names_are_registered_once():
    names = [n for m in q.MODULES for n in m.QUERIES]
    assert len(names) == len(set(names))


def test_normal_quantile(spark):
    want = {0.5: 0.0, 0.975: 1.959963985, 0.01: -2.326347874, 0.999: 3.090232306, 0.9: 1.281551566}
    got = spark.createDataFrame([(p,) for p in [*want, 0.0, 1.0]], "p double").select("p", normal_quantile(F.col("p")).alias("z"), best_of(F.lit(1)).alias("one")).collect()
    for r in got:
        assert r["z"] is None if r["p"] not in want else abs(r["z"] - want[r["p"]]) < 1e-7
        assert r["one"] == 0


def test_first_reason_of_an_order_stands(spark):
    ts = lambda c: F.to_timestamp(F.col(c))
    make = lambda rows, schema: spark.createDataFrame(rows, schema).withColumn("as_of", ts("as_of"))
    at = "2024-01-02 22:00:00"
    targets = make([(at, n, u, 0.01) for n, u in (("click", 100), ("error", 100), ("signup", -100), ("view", 0))], "as_of string, instrument string, units int, stop_distance double")
    positions = make([(at, "signup", 50, 1.0), (at, "view", -70, 1.0), (at, "error", -200, 1.0)], "as_of string, instrument string, units int, average_price double")
    quotes = make([(at, n, f"2024-01-02 21:59:{s}", 1.0, 1.1, True) for n, s in (("click", 58), ("error", 58), ("signup", 30))], "as_of string, instrument string, quoted_at string, bid double, ask double, tradeable boolean").withColumn("quoted_at", ts("quoted_at"))
    none = spark.createDataFrame([], "order_id string")
    plan = {r["instrument"]: r for r in orders.order_plan(targets, positions, quotes, none).collect()}
    assert plan["click"]["rejected"] is None and plan["click"]["units"] == 100 and abs(plan["click"]["price_bound"] - 1.1 * 1.0002) < 1e-12 and abs(plan["click"]["stop_loss"] - 1.05 * 0.99) < 1e-12
    assert plan["error"]["reason"] == "close_for_reversal" and plan["error"]["result"] == 0 and plan["error"]["stop_loss"] is None
    assert plan["signup"]["rejected"] == "stale_quote" and plan["view"]["rejected"] == "missing_quote"
    again = orders.order_plan(targets, positions, quotes, spark.createDataFrame([(plan["click"]["order_id"],)], "order_id string")).where("instrument = 'click'").first()
    assert again["rejected"] == "duplicate_client_order_id"
    fills = orders.paper_fills(orders.order_plan(targets, positions, quotes, none).where("rejected is null"), quotes.withColumn("ask", F.lit(1.2)), positions, none)
    got = {r["instrument"]: r for r in fills.collect()}
    assert got["click"]["why"] == "buy_price_bound_exceeded" and got["click"]["filled_units"] == 0
    assert got["error"]["status"] == "REJECTED"  # it buys back at 1.2 too


def test_folded_stores_are_read_once(spark, tmp_path):
    """While day parts of a folded month are still there, a reader sees every row once."""
    path = str(tmp_path / "s")
    days = spark.createDataFrame([("a", f"2000-01-{d:02d}", float(d)) for d in range(1, 11)], "instrument string, ts string, close double").withColumn("ts", F.to_timestamp("ts"))
    write_store(days, path, "2000-01")
    assert read_store(spark, path).count() == 10
    write_store(days, path, "2000-02")  # the month's part, before its days are deleted
    assert read_store(spark, path).count() == 10
    assert compact(spark, path, "2000-02") == 10 and read_store(spark, path).count() == 10


def test_missing_features_raise(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        documents.load_features(spark, str(tmp_path), "H4")


def test_empty_inputs(spark):
    none = quality.candles(spark, SF).where("false")
    assert quality.resample_candles(none, "1 hour", "0 hours", 60).count() == 0 and quality.coverage(none).count() == 0
    assert panels.purged_rows(spark.createDataFrame([], "instrument string, rn long")).count() == 0
    assert stateful.batch_alerts(stateful.equities(spark, SF).where("false")).count() == 0
    rows = spark.createDataFrame([], "instrument string, ts timestamp, rn long, open double, high double, low double, close double, bid_close double, ask_close double, volume long")
    assert power.planted_candles(rows, 0.2).count() == 0
    assert risk_rules.stops(risk_rules.some_ranges(spark, SF).where("false")).count() == 0
