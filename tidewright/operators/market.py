"""Quality checks, resampling, macro joins, labels and splits, with their queries and SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import Frames, carried, numbered, ratio, with_halo
from ..plans.registry import Registry, columns
from ..sources.views import bars, count_bars, forecasts, macro_obs, sql, table, ticks
from .feature_queries import _TR, _ewm
from .features import KEYS, average_range, flag

R = Registry()
N = "(PARTITION BY instrument ORDER BY rn)"

# Quality -------------------------------------------------------------------------------------


def raw_checks(bars: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """One row per instrument: unique times, consistent candles, ask not below bid, first and last bar."""
    good = (F.col("high") + tolerance >= F.greatest("open", "close", "low")) & (F.col("low") - tolerance <= F.least("open", "close", "high"))
    return bars.groupBy("instrument").agg(
        F.count("*").alias("n"), (F.count("*") == F.count_distinct("ts")).alias("unique_times"), F.bool_and(good).alias("consistent"),
        F.bool_and(F.col("ask_close") >= F.col("bid_close")).alias("ordered_quotes"), F.min("ts").alias("first"), F.max("ts").alias("last"),
    )


def market_closed(ts: Column, friday: int = 21, holidays: bool = True) -> Column:
    """Saturday, Sunday before 22:00, Friday from ``friday`` o'clock, and by choice 25 December and 1 January."""
    day, hour = F.weekday(ts), F.hour(ts)
    closed = (day == 5) | ((day == 6) & (hour < 22)) | ((day == 4) & (hour >= friday))
    feast = ((F.month(ts) == 12) & (F.dayofmonth(ts) == 25)) | ((F.month(ts) == 1) & (F.dayofmonth(ts) == 1))
    return closed | feast if holidays else closed


R.add("q01_raw_checks", lambda k, d: raw_checks(bars(k, d)), sql("bars", "SELECT instrument, count(*) AS n, count(*) = count(DISTINCT ts) AS unique_times, bool_and(high + 1e-9 >= greatest(open, close, low) AND low - 1e-9 <= least(open, close, high)) AS consistent, bool_and(ask_close >= bid_close) AS ordered_quotes, min(ts) AS first, max(ts) AS last FROM bars GROUP BY ALL"))
R.add(
    "q02_q03_market_hours", lambda k, d: ticks(k, d).select("tick_id", market_closed(F.col("ts")).alias("closed"), (~market_closed(F.col("ts"), 22, False)).alias("open_for_orders")),
    sql("ticks", "SELECT tick_id, isodow(ts) = 6 OR isodow(ts) = 7 AND hour(ts) < 22 OR isodow(ts) = 5 AND hour(ts) >= 21 OR month(ts) = 12 AND day(ts) = 25 OR month(ts) = 1 AND day(ts) = 1 AS closed, NOT (isodow(ts) = 6 OR isodow(ts) = 7 AND hour(ts) < 22 OR isodow(ts) = 5 AND hour(ts) >= 22) AS open_for_orders FROM ticks"),
)


def null_shares(df: DataFrame, names: list[str]) -> DataFrame:
    """Share of nulls per column, and whether it is above 5 %."""
    shares = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in names)).unpivot([], names, "column_name", "null_share")
    return shares.withColumn("flagged", F.col("null_share") > 0.05)


def returns_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with a mean of 200 bars: a column with leading nulls."""
    return with_halo(bars(spark, sf_dir), KEYS, 200, lambda d, w: d.withColumn("sma_200", w.full(F.avg, "close", 200)).withColumn("r", F.col("close") / w.lag("close") - 1))


R.add("q04_null_shares", lambda k, d: null_shares(returns_200(k, d), ["close", "r", "sma_200"]), sql("bars", f", a AS (SELECT close, close / lag(close) OVER {N} AS r, CASE WHEN rn >= 200 THEN 1 END AS sma_200 FROM bars), b AS (SELECT avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0 END) AS close, avg(CASE WHEN r IS NULL THEN 1.0 ELSE 0 END) AS r, avg(CASE WHEN sma_200 IS NULL THEN 1.0 ELSE 0 END) AS sma_200 FROM a), o AS (SELECT column_name, null_share, null_share > 0.05 AS flagged FROM (UNPIVOT b ON close, r, sma_200 INTO NAME column_name VALUE null_share))" + columns("column_name flagged", "null_share", "o")))
R.add("q05_order_violations", lambda k, d: with_halo(bars(k, d), KEYS, 1, lambda x, w: x.withColumn("bad", flag(F.col("ts") <= w.lag("ts")))).groupBy("instrument").agg(F.sum("bad").alias("violations"), F.count("*").alias("n")), sql("bars", f"SELECT instrument, CAST(sum(CASE WHEN ts <= p THEN 1 ELSE 0 END) AS BIGINT) AS violations, count(*) AS n FROM (SELECT *, lag(ts) OVER {N} AS p FROM bars) GROUP BY ALL"))


def violations(**rules: Column) -> Column:
    """Names of the rules that are not true, joined by a bar."""
    return F.concat_ws("|", *(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))


R.add(
    "q06_contract_checks", lambda k, d: forecasts(k, d).select("event_id", violations(direction=F.col("signal").isin(-1, 0, 1), confidence=(F.col("confidence") >= 0.1) & (F.col("confidence") <= 1), ordered=(F.col("p10") <= F.col("p50")) & (F.col("p50") <= F.col("p90")), quiet=F.abs("p50") <= 0.0008).alias("violated")),
    sql("forecasts", "SELECT event_id, concat_ws('|', CASE WHEN NOT signal IN (-1, 0, 1) THEN 'direction' END, CASE WHEN NOT (confidence >= 0.1 AND confidence <= 1) THEN 'confidence' END, CASE WHEN NOT (p10 <= p50 AND p50 <= p90) THEN 'ordered' END, CASE WHEN NOT abs(p50) <= 0.0008 THEN 'quiet' END) AS violated FROM forecasts"),
)
R.add("q07_quote_checks", lambda k, d: ticks(k, d).select("tick_id", ((F.col("bid") > 0) & (F.col("bid") <= F.col("ask"))).alias("valid"), ((F.col("bid") + F.col("ask")) / 2).alias("mid"), ((F.col("ask") - F.col("bid")) / ((F.col("bid") + F.col("ask")) / 2)).alias("spread_return")), sql("ticks", ", a AS (SELECT tick_id, bid > 0 AND bid <= ask AS valid, (bid + ask) / 2 AS mid, (ask - bid) / ((bid + ask) / 2) AS spread_return FROM ticks)" + columns("tick_id valid", "mid spread_return", "a", 9)), 9)
R.add("q11_usable_rows", lambda k, d: returns_200(k, d).dropna(subset=["r", "sma_200"]).groupBy("instrument", F.year("ts").alias("block")).agg(F.count("*").alias("n")).where("n >= 200"), sql("bars", "SELECT instrument, CAST(year(ts) AS INTEGER) AS block, count(*) AS n FROM bars WHERE rn >= 200 GROUP BY ALL HAVING count(*) >= 200"))


def missing_hours(df: DataFrame) -> DataFrame:
    """Expected open hours between the first and last tick of each instrument that have no tick."""
    seen = df.select("instrument", F.date_trunc("hour", "ts").alias("hour")).distinct()
    span = seen.groupBy("instrument").agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    grid = span.select("instrument", F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("hour")).where(~market_closed(F.col("hour")))
    return grid.join(seen, ["instrument", "hour"], "left_anti")


_CLOSED = "(isodow(hour) = 6 OR isodow(hour) = 7 AND hour(hour) < 22 OR isodow(hour) = 5 AND hour(hour) >= 21 OR month(hour) = 12 AND day(hour) = 25 OR month(hour) = 1 AND day(hour) = 1)"
R.add("q09_bar_coverage", lambda k, d: missing_hours(ticks(k, d)), sql("ticks", f", seen AS (SELECT DISTINCT instrument, date_trunc('hour', ts) AS hour FROM ticks), g AS (SELECT instrument, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM seen GROUP BY instrument) SELECT * FROM g ANTI JOIN seen USING (instrument, hour) WHERE NOT {_CLOSED}"))
R.add("q10_health_alerts", lambda k, d: ticks(k, d).groupBy("instrument").agg(F.max("ts").alias("last"), F.count("*").alias("n")).select("instrument", violations(stale=F.col("last") >= F.lit("2024-01-30 12:00:00").cast("timestamp"), few=F.col("n") >= 2000).alias("alerts")), sql("ticks", "SELECT instrument, concat_ws('|', CASE WHEN NOT max(ts) >= TIMESTAMP '2024-01-30 12:00:00' THEN 'stale' END, CASE WHEN NOT count(*) >= 2000 THEN 'few' END) AS alerts FROM ticks GROUP BY ALL"))

# Resampling ----------------------------------------------------------------------------------


def resample(df: DataFrame, length: str, offset: str = "0 seconds", price: str = "price", least: int = 1) -> DataFrame:
    """Bars [start, start + length) of ticks (instrument, ts, tick_id, price, size), of at least ``least`` ticks."""
    seq = F.struct("ts", "tick_id")
    out = df.groupBy("instrument", F.window("ts", length, length, offset).alias("w")).agg(
        F.min_by(price, seq).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, seq).alias("close"), F.sum("size").cast("long").alias("volume"), F.count("*").alias("n")
    )
    return out.where(F.col("n") >= least).select("instrument", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "n")


_BAR = "instrument, first(price ORDER BY ts, tick_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, tick_id) AS close, CAST(sum(size) AS BIGINT) AS volume, count(*) AS n FROM ticks GROUP BY instrument, 1"
for _name, _len, _off, _sqloff, _least in (("h1", "1 hour", "0 seconds", "0 hours", 1), ("h4", "4 hours", "2 hours", "2 hours", 3), ("d", "24 hours", "22 hours", "22 hours", 20)):
    R.add(
        f"r01_r02_resample_{_name}", lambda k, d, a=_len, b=_off, c=_least: resample(ticks(k, d), a, b, least=c),
        sql("ticks", f", b AS (SELECT time_bucket(INTERVAL '{_len}', ts, TIMESTAMP '2000-01-01 00:00:00' + INTERVAL '{_sqloff}') AS ts, {_BAR.replace('ORDER BY ts,', 'ORDER BY ticks.ts,')} HAVING count(*) >= {_least})" + columns("instrument ts volume n", "open high low close", "b", 8)), 8,
    )


def daily_fill(df: DataFrame) -> DataFrame:
    """One row per series and day: the last observation on or before it."""
    span = df.groupBy("series").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select("series", F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("date"))
    placed = numbered(days.join(df, ["series", "date"], "left"), ["series"], ["date"], "year")
    return carried(placed, ["series"], "value", "filled").select("series", "date", F.col("filled").alias("value"))


R.add("r03_daily_fill", lambda k, d: daily_fill(macro_obs(k, d)), sql("macro_obs", ", g AS (SELECT series, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS date FROM macro_obs GROUP BY series), o AS (SELECT series, date, last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY date) AS value FROM g LEFT JOIN macro_obs USING (series, date))" + columns("series date", "value", "o", 9)), 9)


def evenly(df: DataFrame, points: int = 12) -> DataFrame:
    """At most ``points`` evenly spaced bars of each instrument and month, as steps from the first close."""
    w = Window.partitionBy("instrument", "month").orderBy("ts")
    d = df.withColumn("month", F.date_trunc("month", "ts")).withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("instrument", "month")))
    slot = F.floor(F.col("i") * points / F.col("n"))
    d = d.withColumn("slot", slot).withColumn("keep", F.coalesce(F.lag("slot").over(w) != F.col("slot"), F.lit(True))).withColumn("pips", (F.col("close") - F.first("close").over(w)) / 0.0001)
    return d.where("keep").select("instrument", "ts", "slot", "pips")


R.add("r04_downsample", lambda k, d: evenly(bars(k, d)), sql("bars", ", a AS (SELECT *, date_trunc('month', ts) AS m FROM bars), b AS (SELECT *, CAST(floor((row_number() OVER w - 1) * 12 / count(*) OVER (PARTITION BY instrument, m)) AS BIGINT) AS slot, (close - first_value(close) OVER w) / 0.0001 AS pips FROM a WINDOW w AS (PARTITION BY instrument, m ORDER BY ts)), o AS (SELECT *, lag(slot) OVER (PARTITION BY instrument, m ORDER BY ts) AS p FROM b)" + columns("instrument ts slot", "pips", "o WHERE p IS NULL OR p <> slot", 5)), 5)

# Macro ---------------------------------------------------------------------------------------

#: Release rule of each series of the view.
RULES = {"1-URGENT": "daily", "2-HIGH": "daily", "3-MEDIUM": "weekly", "4-NOT SPECIFIED": "monthly", "5-LOW": "monthly"}


def availability(df: DataFrame) -> DataFrame:
    """Adds ``available_at``: daily series a day later at 14:00, weekly ones on the next Monday at 21:00, monthly ones a month and 19 days later at 14:00."""
    rule = F.element_at(F.create_map(*(F.lit(x) for kv in RULES.items() for x in kv)), F.col("series"))
    return df.withColumn(
        "available_at",
        F.when(rule == "daily", F.expr("date + interval 38 hours")).when(rule == "weekly", F.expr("date + make_interval(0, 0, 0, 7 - weekday(date), 21)")).otherwise(F.expr("date + interval 1 month + interval 19 days + interval 14 hours")),
    )


_AVAIL = ", obs AS (SELECT *, CASE WHEN series IN ('1-URGENT', '2-HIGH') THEN date + INTERVAL 38 HOUR WHEN series = '3-MEDIUM' THEN date + to_days(CAST(8 - isodow(date) AS INTEGER)) + INTERVAL 21 HOUR ELSE date + INTERVAL 1 MONTH + INTERVAL 19 DAY + INTERVAL 14 HOUR END AS available_at FROM macro_obs)"


def derived(obs: DataFrame) -> DataFrame:
    """Per series, in its own observations: z-score over 12, change over 12, and the change since 30 days earlier."""
    w = Window.partitionBy("series").orderBy("date")
    last = w.rowsBetween(-11, 0)
    month = Window.partitionBy("series").orderBy(F.col("date").cast("long")).rangeBetween(Window.unboundedPreceding, -30 * 86400)
    full = F.count("value").over(last) == 12
    return obs.select(
        "series", "date", "available_at", "value",
        F.when(full, ratio(F.col("value") - F.avg("value").over(last), F.stddev_samp("value").over(last))).alias("zscore"),
        (F.col("value") / F.lag("value", 12).over(w) - 1).alias("yoy"), (F.col("value") - F.last("value").over(month)).alias("change_30d"),
    )


def six(df: DataFrame) -> DataFrame:
    """Derived ratios to six places, as both engines compare them."""
    return df.withColumn("zscore", F.round("zscore", 6)).withColumn("yoy", F.round("yoy", 6))


def as_of(bars: DataFrame, obs: DataFrame, names: list[str]) -> DataFrame:
    """Bars with, for each series, the last value public at or before the bar (``available_at`` <= ts; later dates win ties).

    An observation holds until the next one of its series; its time is dealt over the days that it spans,
    and bars meet it by an equi-join on the day and the exact bounds. A day holds few observations of a
    series, so the join makes little more than its result: a row per bar and series, with nulls before
    the first observation. Any number of instruments and series does.
    """
    ends = bars.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    placed = numbered(obs.select("series", "date", F.col("available_at").alias("ts"), *names), ["series"], ["ts", "date"], "year")
    spans = with_halo(placed, ["series"], 1, lambda d, w: d.withColumn("to", F.lead("ts").over(w.base)), ahead=1).select("series", F.col("ts").alias("from"), "to", *names)
    before = obs.groupBy("series").agg(F.min("available_at").alias("to")).withColumn("from", F.lit(None).cast("timestamp"))
    spans = spans.unionByName(before, allowMissingColumns=True)
    first, last = F.lit(ends["a"]).cast("timestamp"), F.lit(ends["b"]).cast("timestamp")
    days = F.sequence(F.to_date(F.greatest(F.coalesce("from", first), first)), F.to_date(F.least(F.coalesce("to", last), last)))
    reached = spans.where((F.coalesce("from", first) <= last) & (F.coalesce("to", last) >= first)).withColumn("day", F.explode(days))
    both = bars.select("instrument", "ts", F.to_date("ts").alias("day")).join(reached, "day")
    return both.where((F.col("from").isNull() | (F.col("from") <= F.col("ts"))) & (F.col("to").isNull() | (F.col("ts") < F.col("to")))).select("instrument", "series", "ts", *names)


R.add("m01_availability", lambda k, d: availability(macro_obs(k, d)), sql("macro_obs", _AVAIL + columns("series date available_at", "value", "obs", 9)), 9)
_DER = _AVAIL + ", der AS (SELECT series, date, available_at, value, round(CASE WHEN count(value) OVER l = 12 THEN (value - avg(value) OVER l) / nullif(stddev_samp(value) OVER l, 0) END, 6) AS zscore, round(value / lag(value, 12) OVER w - 1, 6) AS yoy, value - last_value(value) OVER m AS change_30d FROM obs WINDOW w AS (PARTITION BY series ORDER BY date), l AS (PARTITION BY series ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), m AS (PARTITION BY series ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 30 DAY PRECEDING))"
R.add("m02_m03_derived", lambda k, d: six(derived(availability(macro_obs(k, d)))), sql("macro_obs", _DER + columns("series date available_at", "value zscore yoy change_30d", "der", 9)), 9)
R.add("m04_as_of_join", lambda k, d: as_of(bars(k, d), six(derived(availability(macro_obs(k, d)))), ["value", "zscore"]), sql("bars,macro_obs", _DER + ", s AS (SELECT DISTINCT series FROM der), l AS (SELECT instrument, ts, series FROM bars, s), p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series, available_at ORDER BY date DESC) AS k FROM der) WHERE k = 1), o AS (SELECT l.instrument, l.series, l.ts, p.value, p.zscore FROM l ASOF LEFT JOIN p ON l.series = p.series AND l.ts >= p.available_at)" + columns("instrument series ts", "value zscore", "o", 9)), 9)
R.add("m05_by_date_align", lambda k, d: as_of(bars(k, d), macro_obs(k, d).withColumn("available_at", F.col("date")), ["value"]), sql("bars,macro_obs", ", s AS (SELECT DISTINCT series FROM macro_obs), l AS (SELECT instrument, ts, series FROM bars, s), o AS (SELECT l.instrument, l.series, l.ts, p.value FROM l ASOF LEFT JOIN macro_obs AS p ON l.series = p.series AND l.ts >= p.date)" + columns("instrument series ts", "value", "o", 9)), 9)
R.add("m06_first_release", lambda k, d: table(k, d, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.date_trunc("month", "o_orderdate").alias("date")).agg(F.min_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("value")), "SELECT o_orderpriority AS series, date_trunc('month', o_orderdate) AS date, round(first(o_totalprice ORDER BY o_orderdate, o_orderkey), 6) AS value FROM orders GROUP BY ALL")

# Labels --------------------------------------------------------------------------------------


def triple_barrier(bars: DataFrame, up: float = 1.0, down: float = 1.0, hold: int = 10, least: float = 0.001) -> DataFrame:
    """First touch of entry + up x range or entry - down x range within ``hold`` bars, else the sign of a return of ``least``.

    The range is the average true range of 14 bars; the next closes are a bounded array. A bar with a
    null or zero range has label, return and holding time 0. The last ``hold`` bars have no label.
    """

    def build(d: DataFrame, w: Frames) -> DataFrame:
        d = d.withColumn("atr", F.coalesce("atr_14", F.lit(0.0))).withColumn("next", F.collect_list("close").over(w(1, hold)))
        top, bottom = F.round(F.col("close") + up * F.col("atr"), 9), F.round(F.col("close") - down * F.col("atr"), 9)
        hits = F.transform("next", lambda x: F.when(F.round(x, 9) >= top, 1).when(F.round(x, 9) <= bottom, -1).otherwise(0))
        d = d.withColumn("hits", hits).withColumn("at", F.array_position(F.transform("hits", lambda x: x != 0), F.lit(True)).cast("int"))
        d = d.withColumn("touched", (F.col("at") > 0) & (F.col("atr") > 0)).where(F.size("next") == hold)
        d = d.withColumn("holding_bars", F.when(F.col("touched"), F.col("at")).when(F.col("atr") > 0, hold).otherwise(0))
        d = d.withColumn("ret", F.when(F.col("atr") > 0, F.element_at("next", F.greatest("holding_bars", F.lit(1))) / F.col("close") - 1).otherwise(0.0))
        late = F.when(F.col("atr") <= 0, 0).when(F.abs(F.round("ret", 9)) >= least, F.signum("ret").cast("int")).otherwise(0)
        d = d.withColumn("label", F.when(F.col("touched"), F.element_at("hits", F.col("holding_bars"))).otherwise(late))
        return d.withColumn("barrier", F.when(F.col("touched"), F.when(F.col("label") == 1, "upper").otherwise("lower")).otherwise("vertical"))

    return with_halo(average_range(bars), KEYS, 1, build, ahead=hold)


_TB = _TR + f""", xa AS ({_ewm('@tr', 1 / 14, 'r', 'atr_14')})
, a AS (SELECT r.*, coalesce(atr_14, 0) AS atr, list(close) OVER (PARTITION BY r.instrument ORDER BY r.rn ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS nx FROM r LEFT JOIN xa USING (instrument, rn))
, h AS (SELECT *, list_transform(nx, lambda x: CASE WHEN round(x, 9) >= round(close + atr, 9) THEN 1 WHEN round(x, 9) <= round(close - atr, 9) THEN -1 ELSE 0 END) AS hits FROM a WHERE len(nx) = 10)
, f AS (SELECT *, list_position(list_transform(hits, lambda x: x <> 0), true) AS pos, coalesce(pos, 0) > 0 AND atr > 0 AS touched, CASE WHEN touched THEN pos WHEN atr > 0 THEN 10 ELSE 0 END AS hb FROM h)
, tb AS (SELECT *, CAST(hb AS INTEGER) AS holding_bars, CASE WHEN atr > 0 THEN nx[hb] / close - 1 ELSE 0 END AS ret, CAST(CASE WHEN touched THEN hits[hb] WHEN atr <= 0 THEN 0 WHEN abs(round(ret, 9)) >= 0.001 THEN sign(ret) ELSE 0 END AS INTEGER) AS label, CASE WHEN touched THEN CASE WHEN hits[hb] = 1 THEN 'upper' ELSE 'lower' END ELSE 'vertical' END AS barrier FROM f)"""
R.add("l01_triple_barrier", lambda k, d: triple_barrier(bars(k, d)).select("instrument", "ts", "label", "ret", "holding_bars", "barrier"), sql("bars", _TB + columns("instrument ts label holding_bars barrier", "ret", "tb")))
R.add("l02_meta_labels", lambda k, d: triple_barrier(bars(k, d)).withColumn("signal", F.pmod(F.col("rn"), F.lit(3)).cast("int") - 1).withColumn("meta", flag((F.col("signal") != 0) & (F.col("signal") == F.col("label")))).groupBy("instrument").agg(F.sum("meta").alias("correct"), F.avg(F.when(F.col("signal") != 0, F.col("meta").cast("double"))).alias("precision")), sql("bars", _TB + ", m AS (SELECT *, CAST(rn % 3 AS INTEGER) - 1 AS signal, CASE WHEN signal <> 0 AND signal = label THEN 1 ELSE 0 END AS meta FROM tb), o AS (SELECT instrument, CAST(sum(meta) AS BIGINT) AS correct, avg(CASE WHEN signal <> 0 THEN CAST(meta AS DOUBLE) END) AS precision FROM m GROUP BY ALL)" + columns("instrument correct", "precision", "o")))


def sample_weights(df: DataFrame) -> DataFrame:
    """Weights by size of return and by age, each with a mean of one per instrument.

    Ages run evenly from exp(-1) at the first row to 1 at the last; their sum is that of a geometric
    series, so that only the number of rows is needed.
    """
    total = df.groupBy("instrument").agg(F.sum(F.abs("ret")).alias("sum_ret"), F.count("*").alias("n"))
    step = 1 / F.greatest(F.col("n") - 1, F.lit(1))
    sum_age = F.exp(F.lit(-1.0)) * F.when(F.col("n") == 1, 1.0).otherwise(F.expm1(F.col("n") * step) / F.expm1(step))
    d = numbered(df.drop("rn"), KEYS, ["ts"], "year").join(total, "instrument")
    return d.select("instrument", "ts", (F.coalesce(F.abs("ret"), F.lit(0.0)) / F.nullif("sum_ret", F.lit(0.0)) * F.col("n")).alias("by_return"), (F.exp(-1 + (F.col("rn") - 1) * step) / sum_age * F.col("n")).alias("by_age"))


R.add("l03_sample_weights", lambda k, d: sample_weights(triple_barrier(bars(k, d))), sql("bars", _TB + ", o AS (SELECT instrument, ts, abs(ret) / nullif(sum(abs(ret)) OVER v, 0) * count(*) OVER v AS by_return, exp(-1 + (rn - 1) / (nn - 1)) / sum(exp(-1 + (rn - 1) / (nn - 1))) OVER v * nn AS by_age FROM (SELECT *, count(*) OVER (PARTITION BY instrument) AS nn FROM tb) WINDOW v AS (PARTITION BY instrument))" + columns("instrument ts", "by_return by_age", "o")))


def horizon_labels(bars: DataFrame, horizons: tuple[int, ...] = (1, 3, 6, 12), pip: float = 0.0001) -> DataFrame:
    """Direction of the log return over each horizon with a dead zone of two pips, and the sums of returns up to it."""

    def build(d: DataFrame, w: Frames) -> DataFrame:
        d = d.withColumn("_r", F.log(F.col("close") / w.lag("close")))
        for h in horizons:
            move = F.round(F.log(F.lead("close", h).over(w.base) / F.col("close")), 12)
            zone = F.round(2 * pip / F.col("close"), 12)
            d = d.withColumn(f"label_{h}", F.when(move.isNull(), None).when(move > zone, 1).when(move < -zone, -1).otherwise(0))
            d = d.withColumn(f"cum_{h}", F.when(F.count("_r").over(w(1, h)) == h, F.sum("_r").over(w(1, h))))
        return d.where(F.col(f"label_{max(horizons)}").isNotNull())

    return with_halo(bars, KEYS, 1, build, ahead=max(horizons) + 1)


_HL = ", ".join(f"CASE WHEN round(ln(lead(close, {h}) OVER {N} / close), 12) > round(0.0002 / close, 12) THEN 1 WHEN round(ln(lead(close, {h}) OVER {N} / close), 12) < -round(0.0002 / close, 12) THEN -1 WHEN lead(close, {h}) OVER {N} IS NOT NULL THEN 0 END AS label_{h}, ln(lead(close, {h}) OVER {N} / close) AS cum_{h}" for h in (1, 3, 6, 12))
_HLS = f", hl AS (SELECT * FROM (SELECT *, {_HL} FROM bars) WHERE label_12 IS NOT NULL)"
R.add("l04_l05_horizons", lambda k, d: horizon_labels(bars(k, d)).select("instrument", "ts", *(f"label_{h}" for h in (1, 3, 6, 12)), *(f"cum_{h}" for h in (1, 3, 6, 12))), sql("bars", _HLS + columns("instrument ts label_1 label_3 label_6 label_12", "cum_1 cum_3 cum_6 cum_12", "hl")))


def windows_of(bars: DataFrame, length: int = 60) -> DataFrame:
    """Model windows: the last ``length`` log returns as an array at each bar that has them."""

    def build(d: DataFrame, w: Frames) -> DataFrame:
        d = d.withColumn("_r", F.log(F.col("close") / w.lag("close")))
        return d.withColumn("window", F.collect_list("_r").over(w(1 - length))).where(F.size("window") == length)

    return with_halo(bars, KEYS, length + 1, build).select("instrument", "ts", "rn", "window")


R.add("l06_model_windows", lambda k, d: windows_of(bars(k, d)).select("instrument", "ts", F.size("window").alias("n"), F.aggregate("window", F.lit(0.0), lambda s, x: s + x).alias("total")), sql("bars", f", a AS (SELECT *, ln(close / lag(close) OVER {N}) AS r FROM bars), o AS (SELECT instrument, ts, 60 AS n, sum(r) OVER v AS total, count(r) OVER v AS k FROM a WINDOW v AS (PARTITION BY instrument ORDER BY rn ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))" + columns("instrument ts n", "total", "o WHERE k = 60")))


def standardised(bars: DataFrame) -> DataFrame:
    """Close in each year, standardised by mean and population deviation of the years before."""
    by_year = bars.withColumn("block", F.year("ts")).groupBy("instrument", "block").agg(F.count("close").alias("n"), F.sum("close").alias("s"), F.sum(F.col("close") * F.col("close")).alias("ss"))
    w = Window.partitionBy("instrument").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    fit = by_year.select("instrument", "block", (F.sum("s").over(w) / F.sum("n").over(w)).alias("mean"), F.sqrt(F.greatest(F.sum("ss").over(w) / F.sum("n").over(w) - F.pow(F.sum("s").over(w) / F.sum("n").over(w), F.lit(2)), F.lit(0.0))).alias("std"))
    return bars.withColumn("block", F.year("ts")).join(fit, ["instrument", "block"]).select("instrument", "ts", ratio(F.col("close") - F.col("mean"), F.col("std")).alias("z"))


R.add("l07_train_scaling", lambda k, d: standardised(bars(k, d)), sql("bars", ", y AS (SELECT *, year(ts) AS b FROM bars), f AS (SELECT DISTINCT instrument, b FROM y), g AS (SELECT f.instrument, f.b, avg(y.close) AS mean, stddev_pop(y.close) AS std FROM f LEFT JOIN y ON y.instrument = f.instrument AND y.b < f.b GROUP BY ALL), o AS (SELECT y.instrument, y.ts, (close - mean) / nullif(std, 0) AS z FROM y JOIN g USING (instrument, b))" + columns("instrument ts", "z", "o", 4)), 4)
R.add("l08_lag_features", lambda k, d: with_halo(bars(k, d), KEYS, 7, lambda x, w: (x := x.withColumn("r", F.log(F.col("close") / w.lag("close")))).select("*", *(F.lag("r", i).over(w.base).alias(f"lag_{i}") for i in range(5)), F.lead("r").over(w.base).alias("target")), ahead=2).select("instrument", "ts", *(f"lag_{i}" for i in range(5)), "target"), sql("bars", f", a AS (SELECT *, ln(close / lag(close) OVER {N}) AS r FROM bars), o AS (SELECT *, " + ", ".join(f"lag(r, {i}) OVER {N} AS lag_{i}" for i in range(5)) + f", lead(r) OVER {N} AS target FROM a)" + columns("instrument ts", "lag_0 lag_1 lag_2 lag_3 lag_4 target", "o", 9)), 9)
R.add("l09_class_weights", lambda k, d: class_weights(horizon_labels(bars(k, d))), sql("bars", _HLS + ", u AS (UNPIVOT (SELECT label_1, label_3, label_6, label_12 FROM hl) ON label_1, label_3, label_6, label_12 INTO NAME h VALUE label), c AS (SELECT label, count(*) AS n FROM u GROUP BY ALL), o AS (SELECT label, n, (1.0 / n) / sum(1.0 / n) OVER () * 3 AS weight FROM c)" + columns("label n", "weight", "o")))


def class_weights(labels: DataFrame) -> DataFrame:
    """Inverse frequency weights of the labels of all horizons together, with a sum of three."""
    counts = labels.select(F.explode(F.array(*(f"label_{h}" for h in (1, 3, 6, 12)))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return counts.withColumn("weight", (1 / F.col("n")) / F.sum(1 / F.col("n")).over(Window.partitionBy()) * 3)


# Splits --------------------------------------------------------------------------------------


def walk_forward(bars: DataFrame, least: int = 200, embargo: int = 5) -> DataFrame:
    """Expanding monthly splits per instrument: train up to ``embargo`` days before the month, test in it."""
    span = bars.groupBy("instrument").agg(F.min("ts").alias("train_start"), F.date_trunc("month", F.min("ts")).alias("a"), F.date_trunc("month", F.max("ts")).alias("b"))
    plan = span.select("instrument", "train_start", F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("test_start"))
    plan = plan.withColumn("train_end", F.expr(f"test_start - interval {embargo} days")).withColumn("test_end", F.expr("test_start + interval 1 month - interval 1 day"))
    days = bars.select("instrument", "ts", F.date_trunc("month", "ts").alias("month"))
    tests = days.groupBy("instrument", F.col("month").alias("test_start")).agg(F.count("*").alias("n_test"))
    # rows before a bound: whole months before its month, and the part of that month
    bound = plan.select("instrument", "test_start", "train_end", F.date_trunc("month", "train_end").alias("month"))
    part = bound.join(days, ["instrument", "month"], "left").groupBy("instrument", "test_start").agg(F.count(F.when(F.col("ts") <= F.col("train_end"), 1)).alias("in_month"))
    months = days.groupBy("instrument", "month").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("instrument").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    full = bound.join(months.select("instrument", "month", "before"), ["instrument", "month"], "left").select("instrument", "test_start", "before")
    out = plan.join(tests, ["instrument", "test_start"]).join(part, ["instrument", "test_start"]).join(full, ["instrument", "test_start"])
    out = out.withColumn("n_train", F.coalesce("before", F.lit(0)) + F.col("in_month")).where(F.col("n_train") >= least)
    split = F.row_number().over(Window.partitionBy("instrument").orderBy("test_start")) - 1
    return out.select("instrument", split.alias("split_id"), "train_start", "train_end", "test_start", "test_end", "n_train", "n_test")


_WF = """, m AS (SELECT instrument, min(ts) AS train_start, unnest(generate_series(date_trunc('month', min(ts)), date_trunc('month', max(ts)), INTERVAL 1 MONTH)) AS test_start FROM bars GROUP BY instrument)
, p AS (SELECT *, test_start - INTERVAL 5 DAY AS train_end, test_start + INTERVAL 1 MONTH - INTERVAL 1 DAY AS test_end FROM m)
, c AS (SELECT p.*, count(*) FILTER (b.ts <= train_end) AS n_train, count(*) FILTER (date_trunc('month', b.ts) = test_start) AS n_test FROM p JOIN bars AS b USING (instrument) GROUP BY ALL)
, wf AS (SELECT *, CAST(row_number() OVER (PARTITION BY instrument ORDER BY test_start) - 1 AS INTEGER) AS split_id FROM c WHERE n_train >= 200 AND n_test > 0)"""
R.add("j01_walk_forward", lambda k, d: walk_forward(bars(k, d)), sql("bars", _WF + " SELECT instrument, split_id, train_start, train_end, test_start, test_end, n_train, n_test FROM wf"))
R.add("j02_refit_blocks", lambda k, d: walk_forward(bars(k, d)).groupBy("instrument", F.floor(F.col("split_id") / 3).cast("int").alias("block_id")).agg(F.min("test_start").alias("test_start"), F.max("test_end").alias("test_end"), F.min("train_end").alias("train_end"), F.greatest(F.min("train_start"), F.add_months(F.min("test_start"), -12).cast("timestamp")).alias("train_start"), F.count("*").alias("n_splits")), sql("bars", _WF + " SELECT instrument, CAST(floor(split_id / 3) AS INTEGER) AS block_id, min(test_start) AS test_start, max(test_end) AS test_end, min(train_end) AS train_end, greatest(min(train_start), min(test_start) - INTERVAL 12 MONTH) AS train_start, count(*) AS n_splits FROM wf GROUP BY ALL"))


def purged_folds(bars: DataFrame, folds: int = 5, embargo: int = 10) -> DataFrame:
    """Contiguous folds by row; training rows keep ``embargo`` rows away from the test fold. Counts per fold."""
    n = bars.groupBy("instrument").agg(F.max("rn").alias("n"))
    base, extra = F.floor(F.col("n") / folds), F.col("n") % folds
    bounds = n.select("instrument", "n", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    first = (F.col("fold") * base + F.least("fold", extra) + 1).cast("long")
    bounds = bounds.withColumn("first", first).withColumn("last", (F.col("first") + base + F.when(F.col("fold") < extra, 1).otherwise(0) - 1).cast("long"))
    train = F.greatest(F.col("first") - 1 - embargo, F.lit(0)) + F.greatest(F.col("n") - F.col("last") - embargo, F.lit(0))
    return bounds.select("instrument", "fold", "first", "last", train.cast("long").alias("n_train"))


R.add("j03_purged_folds", lambda k, d: purged_folds(bars(k, d)), sql("bars", ", f AS (SELECT *, ntile(5) OVER (PARTITION BY instrument ORDER BY rn) - 1 AS fold FROM bars), b AS (SELECT instrument, fold, min(rn) AS first, max(rn) AS last FROM f GROUP BY ALL) SELECT b.instrument, CAST(b.fold AS INTEGER) AS fold, b.first, b.last, count(*) FILTER (f.rn < b.first - 10 OR f.rn > b.last + 10) AS n_train FROM b JOIN f USING (instrument) GROUP BY ALL"))
R.add("j04_validation_cut", lambda k, d: bars(k, d).join(bars(k, d).groupBy("instrument").agg(F.add_months(F.max("ts"), -2).cast("timestamp").alias("cut")), "instrument").groupBy("instrument").agg(F.count(F.when(F.col("ts") >= F.col("cut"), 1)).alias("n_validation"), F.count(F.when(F.col("ts") < F.col("cut"), 1)).alias("n_train")), sql("bars", ", c AS (SELECT instrument, max(ts) - INTERVAL 2 MONTH AS cut FROM bars GROUP BY ALL) SELECT instrument, count(*) FILTER (ts >= cut) AS n_validation, count(*) FILTER (ts < cut) AS n_train FROM bars JOIN c USING (instrument) GROUP BY ALL"))
R.add("j05_j06_alignment", lambda k, d: bars(k, d).where("instrument = 'A'").select("ts", F.col("close").alias("a")).join(bars(k, d).where("instrument = 'N' and rn % 3 <> 0").select("ts", F.col("close").alias("n")), "ts", "left").select("ts", F.col("n").isNotNull().alias("matched"), F.coalesce("n", F.lit(0.5)).alias("n")), sql("bars", ", o AS (SELECT a.ts, n.close IS NOT NULL AS matched, coalesce(n.close, 0.5) AS n FROM bars AS a LEFT JOIN bars AS n ON a.ts = n.ts AND n.instrument = 'N' AND n.rn % 3 <> 0 WHERE a.instrument = 'A')" + columns("ts matched", "n", "o", 8)), 8)
R.add("j07_limited_carry", lambda k, d: with_halo(bars(k, d), KEYS, 4, lambda x, w: x.withColumn("v", F.when(F.col("rn") % 7 == 0, F.col("rn").cast("double"))).withColumn("carried", F.coalesce(F.last("v", ignorenulls=True).over(w(-3)), F.lit(0.0)))).select("instrument", "ts", "carried"), sql("bars", ", v AS (SELECT *, CASE WHEN rn % 7 = 0 THEN CAST(rn AS DOUBLE) END AS v FROM bars), o AS (SELECT instrument, ts, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY rn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 0) AS carried FROM v)" + columns("instrument ts", "carried", "o")))
R.add("j09_set_operations", lambda k, d: (a := bars(k, d).where("instrument = 'A'").select("ts")).intersect(b := bars(k, d).where("instrument = 'N'").select("ts")).withColumn("side", F.lit("both")).unionByName(a.exceptAll(b).withColumn("side", F.lit("a_only"))).unionByName(b.exceptAll(a).withColumn("side", F.lit("n_only"))), sql("bars", ", a AS (SELECT ts FROM bars WHERE instrument = 'A'), b AS (SELECT ts FROM bars WHERE instrument = 'N') SELECT ts, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT ts, 'a_only' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT ts, 'n_only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"))
R.add("j10_full_outer", lambda k, d: (x := ticks(k, d).groupBy("instrument", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))).where("day <= '2024-01-20'").select("instrument", "day", F.col("n").alias("expected")).join(x.where("day >= '2024-01-10'").select("instrument", "day", F.col("n").alias("actual")), ["instrument", "day"], "full_outer").select("instrument", "day", (F.coalesce("actual", F.lit(0)) - F.coalesce("expected", F.lit(0))).alias("difference")), sql("ticks", ", x AS (SELECT instrument, CAST(ts AS DATE) AS day, count(*) AS n FROM ticks GROUP BY ALL) SELECT instrument, day, coalesce(a.n, 0) - coalesce(e.n, 0) AS difference FROM (SELECT * FROM x WHERE day <= '2024-01-20') AS e FULL JOIN (SELECT * FROM x WHERE day >= '2024-01-10') AS a USING (instrument, day)"))
R.add("j11_latest_per_key", lambda k, d: ticks(k, d).groupBy("instrument", "user_id").agg(F.max_by(F.struct("tick_id", "size"), F.struct("ts", "tick_id")).alias("x")).select("instrument", "user_id", "x.tick_id", "x.size"), sql("ticks", "SELECT instrument, user_id, tick_id, size FROM ticks QUALIFY row_number() OVER (PARTITION BY instrument, user_id ORDER BY ts DESC, tick_id DESC) = 1"))
R.add("j12_blocks_to_bars", lambda k, d: walk_forward(bars(k, d)).select("instrument", "split_id", F.col("test_start").alias("month")).join(bars(k, d).withColumn("month", F.date_trunc("month", "ts")), ["instrument", "month"]).groupBy("instrument", "split_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), (F.min("rn") - 100).alias("warm_from")), sql("bars", _WF + " SELECT wf.instrument, split_id, min(ts) AS first, max(ts) AS last, min(rn) - 100 AS warm_from FROM wf JOIN bars ON bars.instrument = wf.instrument AND date_trunc('month', ts) = test_start GROUP BY ALL"))
QUERIES, ORACLE_SQL = R.queries, R.sql
