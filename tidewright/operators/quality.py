"""Quality rules and resampling in full: raw checks, quality reports, contracts and quotes, coverage and health, longer bars from five-minute candles, even paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import numbered, with_halo
from ..plans.registry import Registry, columns
from ..sources.views import KEYS, bars, forecasts, sql, ticks
from .market import market_closed, violations

R = Registry()
#: Share of five-minute candles that a longer bar needs; longer bars (minutes, offset).
MIN_FILL = 0.3
LONGER = {"h1": ("1 hour", "0 hours", 60), "h4": ("4 hours", "2 hours", 240), "d": ("24 hours", "22 hours", 1440)}

# Resampling (R1, R2, R4) --------------------------------------------------------------------------


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute candles of the ticks, with their last quotes."""
    seq = F.struct("ts", "tick_id")
    out = ticks(spark, sf_dir).groupBy("instrument", F.window("ts", "5 minutes").alias("w")).agg(
        F.min_by("price", seq).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", seq).alias("close"),
        F.max_by("bid", seq).alias("bid_close"), F.max_by("ask", seq).alias("ask_close"), F.sum("size").cast("long").alias("volume"),
    )
    return out.select("instrument", F.col("w.start").alias("ts"), "open", "high", "low", "close", "bid_close", "ask_close", "volume")


def resample_candles(rows: DataFrame, length: str, offset: str, minutes: int, fill: float = MIN_FILL) -> DataFrame:
    """Bars [start, start + length) of five-minute candles, labelled by their start; those with under ``fill`` of their candles are dropped."""
    out = rows.groupBy("instrument", F.window("ts", length, length, offset).alias("w")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        *(F.max_by(c, "ts").alias(c) for c in ("close", "bid_close", "ask_close")), F.sum("volume").cast("long").alias("volume"), F.count("close").alias("n"),
    )
    return out.where(F.col("n") >= fill * minutes / 5).select("instrument", F.col("w.start").alias("ts"), "open", "high", "low", "close", "bid_close", "ask_close", "volume", "n")


_M5 = """, m5 AS (SELECT instrument, time_bucket(INTERVAL 5 MINUTE, ts) AS t, first(price ORDER BY ts, tick_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, tick_id) AS close,
  last(bid ORDER BY ts, tick_id) AS bid_close, last(ask ORDER BY ts, tick_id) AS ask_close, CAST(sum(size) AS BIGINT) AS volume FROM ticks GROUP BY 1, 2)"""
for _name, (_len, _off, _min) in LONGER.items():
    R.add(
        f"r01_r02_candles_{_name}", lambda k, d, a=_len, b=_off, m=_min: resample_candles(candles(k, d), a, b, m),
        sql("ticks", _M5 + f""", b AS (SELECT instrument, time_bucket(INTERVAL '{_len}', t, TIMESTAMP '2000-01-01 00:00:00' + INTERVAL '{_off}') AS ts, first(open ORDER BY t) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY t) AS close,
  last(bid_close ORDER BY t) AS bid_close, last(ask_close ORDER BY t) AS ask_close, CAST(sum(volume) AS BIGINT) AS volume, count(close) AS n FROM m5 GROUP BY 1, 2 HAVING count(close) >= {MIN_FILL * _min / 5})""" + columns("instrument ts volume n", "open high low close bid_close ask_close", "b", 8)), 8,
    )


def even_paths(rows: DataFrame, least: int = 270, points: int = 72, days: int = 150) -> DataFrame:
    """(day, point, pips): of at most ``days`` evenly spaced days with ``least`` rows, ``points`` evenly spaced prices as pips from the day's first.

    ``rows`` has ts, tick_id and price; rows of a day are numbered by hours.
    """
    d = numbered(rows.withColumn("day", F.to_date("ts")), ["day"], ["ts", "tick_id"], "hour").withColumn("i", (F.col("rn") - 1).cast("int"))
    full = d.groupBy("day").agg(F.count("*").alias("n"), F.min_by("price", "i").alias("first")).where(F.col("n") >= least)
    # days are few: one row each
    placed = full.withColumn("k", F.row_number().over(Window.orderBy("day")) - 1).withColumn("m", F.count("*").over(Window.partitionBy()))
    wanted = F.least("m", F.lit(days))
    chosen = placed.withColumn("slot", F.explode(F.sequence(F.lit(0), wanted - 1))).where(F.round(F.col("slot") * (F.col("m") - 1) / F.greatest(wanted - 1, F.lit(1))) == F.col("k")).select("day", "n", "first").distinct()
    at = chosen.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("i", F.round(F.col("point") * (F.col("n") - 1) / (points - 1)).cast("int"))
    return at.join(d.select("day", "i", "price"), ["day", "i"]).select("day", "point", F.round((F.col("price") - F.col("first")) / 1e-4 + 0.001).cast("long").alias("pips"))


R.add(
    "r04_even_paths", lambda k, d: even_paths(ticks(k, d)),
    sql("ticks", """, a AS (SELECT CAST(ts AS DATE) AS day, price, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, tick_id) - 1 AS i FROM ticks), f AS (SELECT day, count(*) AS n, arg_min(price, i) AS first FROM a GROUP BY 1 HAVING count(*) >= 270)
, p AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS k, count(*) OVER () AS m FROM f), c AS (SELECT DISTINCT day, n, first FROM (SELECT *, unnest(range(least(m, 150))) AS slot FROM p) WHERE round(slot * (m - 1) / greatest(least(m, 150) - 1, 1)) = k)
, t AS (SELECT *, unnest(range(72)) AS point FROM c)
SELECT t.day, CAST(point AS INTEGER) AS point, CAST(round((price - first) / 1e-4 + 0.001) AS BIGINT) AS pips FROM t JOIN a ON a.day = t.day AND a.i = round(point * (n - 1) / 71)"""),
)

# Raw checks and reports (Q1, Q4) ------------------------------------------------------------------


def recent_checks(rows: DataFrame, after: str = "2 hours", tolerance: float = 1e-9, stale: str = "3 hours") -> DataFrame:
    """Checks on the candles of the last two months, per instrument: unique times, consistent prices, quotes in order, and freshness.

    Now is ``after`` the last candle of all. An instrument is fresh if its last candle is younger than
    ``stale``, or if the market is closed.
    """
    now = rows.agg((F.max("ts") + F.expr(f"interval {after}")).alias("now"))
    d = rows.join(F.broadcast(now)).where(F.col("ts") >= F.date_trunc("month", F.add_months("now", -1)))  # one row
    good = (F.col("high") + tolerance >= F.greatest("open", "close")) & (F.col("low") - tolerance <= F.least("open", "close"))
    return d.groupBy("instrument").agg(
        F.count("*").alias("n"), (F.count("*") == F.count_distinct("ts")).alias("monotonic_unique"), F.bool_and(good).alias("ohlc_consistent"), F.bool_and(F.col("ask_close") >= F.col("bid_close")).alias("spread_positive"),
        (F.bool_or(market_closed(F.col("now"))) | (F.max("now") - F.max("ts") < F.expr(f"interval {stale}"))).alias("fresh"),
    )


def _closed_sql(t: str) -> str:
    return f"(isodow({t}) = 6 OR isodow({t}) = 7 AND hour({t}) < 22 OR isodow({t}) = 5 AND hour({t}) >= 21 OR month({t}) = 12 AND day({t}) = 25 OR month({t}) = 1 AND day({t}) = 1)"


R.add(
    "q01_recent_checks", lambda k, d: recent_checks(candles(k, d)),
    sql("ticks", _M5 + f""", nw AS (SELECT max(t) + INTERVAL 2 HOUR AS now FROM m5), r AS (SELECT * FROM m5, nw WHERE t >= date_trunc('month', now - INTERVAL 1 MONTH))
SELECT instrument, count(*) AS n, count(*) = count(DISTINCT t) AS monotonic_unique, bool_and(high + 1e-9 >= greatest(open, close) AND low - 1e-9 <= least(open, close)) AS ohlc_consistent, bool_and(ask_close >= bid_close) AS spread_positive,
  bool_or({_closed_sql('now')}) OR max(now) - max(t) < INTERVAL 3 HOUR AS fresh FROM r GROUP BY ALL"""),
)


def quality_report(df: DataFrame, names: list[str], label: str) -> DataFrame:
    """(section, name, value, flagged): rows, first and last day (as days since 1970), the share of nulls of each column, flagged above 5 %, and the share of each label."""
    one = df.agg(F.count("*").alias("_n"), F.min(F.unix_date(F.to_date("ts"))).alias("_a"), F.max(F.unix_date(F.to_date("ts"))).alias("_b"), *(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in names))
    facts = one.select(*(F.col(c).cast("double").alias(n) for c, n in (("_n", "rows"), ("_a", "first"), ("_b", "last")))).unpivot([], ["rows", "first", "last"], "name", "value").select(F.lit("range").alias("section"), "name", "value", F.lit(False).alias("flagged"))
    nulls = one.unpivot([], names, "name", "value").select(F.lit("nulls").alias("section"), "name", "value", (F.col("value") > 0.05).alias("flagged"))
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("name")).agg(F.count("*").alias("k"))
    shares = counts.join(F.broadcast(counts.agg(F.sum("k").alias("all")))).select(F.lit("labels").alias("section"), "name", (F.col("k") / F.col("all")).alias("value"), F.lit(False).alias("flagged"))  # one row
    return facts.unionByName(nulls).unionByName(shares)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with a return, a mean of 200 bars, and the sign of the next move as a label."""

    def build(d: DataFrame, w) -> DataFrame:
        d = d.withColumn("r", F.col("close") / w.lag("close") - 1).withColumn("sma_200", w.full(F.avg, "close", 200))
        return d.withColumn("label", F.signum(F.lead("close").over(w.base) - F.col("close")).cast("int"))

    return with_halo(bars(spark, sf_dir), KEYS, 200, build, ahead=1)


R.add(
    "q04_quality_report", lambda k, d: quality_report(labelled(k, d), ["close", "r", "sma_200", "label"], "label"),
    sql("bars", """, a AS (SELECT ts, close, lag(close) OVER w AS r, CASE WHEN rn >= 200 THEN 1 END AS sma_200, CAST(sign(lead(close) OVER w - close) AS INTEGER) AS label FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY rn))
, n AS (SELECT avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0 END) AS close, avg(CASE WHEN r IS NULL THEN 1.0 ELSE 0 END) AS r, avg(CASE WHEN sma_200 IS NULL THEN 1.0 ELSE 0 END) AS sma_200, avg(CASE WHEN label IS NULL THEN 1.0 ELSE 0 END) AS label FROM a)
, g AS (SELECT CAST(count(*) AS DOUBLE) AS "rows", CAST(datediff('day', DATE '1970-01-01', CAST(min(ts) AS DATE)) AS DOUBLE) AS "first", CAST(datediff('day', DATE '1970-01-01', CAST(max(ts) AS DATE)) AS DOUBLE) AS "last" FROM a)
, o AS (SELECT 'range' AS section, name, value, false AS flagged FROM (UNPIVOT g ON "rows", "first", "last" INTO NAME name VALUE value) UNION ALL SELECT 'nulls', name, value, value > 0.05 FROM (UNPIVOT n ON close, r, sma_200, label INTO NAME name VALUE value)
  UNION ALL SELECT 'labels', CAST(label AS VARCHAR), count(*) / sum(count(*)) OVER (), false FROM a WHERE label IS NOT NULL GROUP BY label)""" + columns("section name flagged", "value", "o")),
)

# Contracts and quotes (Q6, Q7) --------------------------------------------------------------------

#: Instruments that a contract may name.
KNOWN = ("click", "error", "purchase", "signup")


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts as prediction contracts, some of which break a rule."""
    e, minutes = F.col("event_id"), lambda n: F.make_dt_interval(mins=n.cast("int"))
    return forecasts(spark, sf_dir).select(
        "event_id", "instrument", "ts", (F.col("ts") + minutes(F.pmod(e, F.lit(3)) - 1)).alias("data_as_of"), (F.col("ts") + minutes(F.pmod(e, F.lit(5)) * 15)).alias("expires_at"), F.pmod(e, F.lit(6)).alias("horizon_bars"),
        F.col("signal").alias("direction"), "confidence", (F.pmod(e * 37, F.lit(110)) / 100.0).alias("uncertainty"), F.when(F.pmod(e, F.lit(17)) == 0, " ").otherwise("v1").alias("model_version"),
    )


def contract_checks(df: DataFrame, now: Column, known: tuple[str, ...] = KNOWN) -> DataFrame:
    """(event_id, violated, fresh): the names of all rules that a contract breaks, and whether it holds at ``now``."""
    share = lambda c: (F.col(c) >= 0) & (F.col(c) <= 1)
    broken = violations(
        instrument=F.col("instrument").isin(*known), direction=F.col("direction").isin(-1, 0, 1), horizon=F.col("horizon_bars") >= 1, confidence=share("confidence"), uncertainty=share("uncertainty"),
        as_of=F.col("data_as_of") <= F.col("ts"), expiry=F.col("expires_at") > F.col("ts"), version=F.trim("model_version") != "",
    )
    return df.select("event_id", broken.alias("violated"), ((F.col("ts") <= now) & (now < F.col("expires_at"))).alias("fresh"))


R.add(
    "q06_contract_rules", lambda k, d: contract_checks(contracts(k, d), F.col("ts") + F.expr("interval 20 minutes")),
    sql("forecasts", """, c AS (SELECT *, ts + INTERVAL (event_id % 3 - 1) MINUTE AS data_as_of, ts + INTERVAL (event_id % 5 * 15) MINUTE AS expires_at, event_id * 37 % 110 / 100.0 AS uncertainty FROM forecasts)
SELECT event_id, concat_ws('|', CASE WHEN instrument NOT IN ('click', 'error', 'purchase', 'signup') THEN 'instrument' END, CASE WHEN signal NOT IN (-1, 0, 1) THEN 'direction' END, CASE WHEN event_id % 6 < 1 THEN 'horizon' END, CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence' END,
  CASE WHEN uncertainty NOT BETWEEN 0 AND 1 THEN 'uncertainty' END, CASE WHEN data_as_of > ts THEN 'as_of' END, CASE WHEN expires_at <= ts THEN 'expiry' END, CASE WHEN event_id % 17 = 0 THEN 'version' END) AS violated, ts + INTERVAL 20 MINUTE < expires_at AS fresh FROM c"""),
)


def quote_checks(df: DataFrame) -> DataFrame:
    """(tick_id, violated, mid, spread_return) of quotes with stop_distance and financing: 0 < bid <= ask, a stop above 0, no negative cost."""
    mid = (F.col("bid") + F.col("ask")) / 2
    broken = violations(quote=(F.col("bid") > 0) & (F.col("ask") > 0) & (F.col("bid") <= F.col("ask")), stop=F.col("stop_distance") > 0, financing=F.col("financing") >= 0)
    return df.select("tick_id", broken.alias("violated"), mid.alias("mid"), ((F.col("ask") - F.col("bid")) / mid).alias("spread_return"))


def quoted_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks as quotes with stops and financing costs; some are crossed, lack a stop or pay to hold."""
    i = F.col("tick_id")
    crossed = F.pmod(i, F.lit(13)) == 0
    return ticks(spark, sf_dir).select("tick_id", F.when(crossed, F.col("ask")).otherwise(F.col("bid")).alias("bid"), F.when(crossed, F.col("bid")).otherwise(F.col("ask")).alias("ask"), (F.pmod(i, F.lit(7)) / 1000.0).alias("stop_distance"), ((F.pmod(i, F.lit(11)) - 1) / 1e5).alias("financing"))


R.add(
    "q07_quote_rules", lambda k, d: quote_checks(quoted_ticks(k, d)),
    sql("ticks", """, q AS (SELECT tick_id, CASE WHEN tick_id % 13 = 0 THEN ask ELSE bid END AS b, CASE WHEN tick_id % 13 = 0 THEN bid ELSE ask END AS a FROM ticks)
, o AS (SELECT tick_id, concat_ws('|', CASE WHEN NOT (b > 0 AND a > 0 AND b <= a) THEN 'quote' END, CASE WHEN tick_id % 7 = 0 THEN 'stop' END, CASE WHEN tick_id % 11 = 0 THEN 'financing' END) AS violated, (a + b) / 2 AS mid, (a - b) / ((a + b) / 2) AS spread_return FROM q)""" + columns("tick_id violated", "mid spread_return", "o", 9)), 9,
)

# Coverage and health (Q9, Q10) ----------------------------------------------------------------------


def coverage(rows: DataFrame, last: int = 20) -> DataFrame:
    """Per instrument: five-minute bars expected while the market was open, recorded and missed ones, the share missed, and the ``last`` missed ones as text.

    A bar is expected if the market is open when it closes, from the first recorded bar to the last of all.
    """
    step = F.expr("interval 5 minutes")
    seen = rows.select("instrument", "ts").distinct()
    end = rows.agg(F.max("ts").alias("b"))
    span = seen.groupBy("instrument").agg(F.min("ts").alias("a")).join(F.broadcast(end))  # one row
    days = span.select("instrument", "a", "b", F.explode(F.expr("sequence(date_trunc('day', a), b, interval 1 day)")).alias("day"))
    grid = days.select("instrument", F.explode(F.expr("filter(sequence(day, day + interval 1435 minutes, interval 5 minutes), t -> t between a and b)")).alias("ts")).where(~market_closed(F.col("ts") + step))
    both = grid.join(seen.withColumn("seen", F.lit(1)), ["instrument", "ts"], "left")
    counts = both.groupBy("instrument").agg(F.count("*").alias("expected"), F.count("seen").alias("recorded"))
    # the newest missed ones are searched from the end of each day's list, so that no list of all is made
    newest = both.where("seen is null").withColumn("k", F.row_number().over(Window.partitionBy("instrument").orderBy(F.desc("ts")))).where(F.col("k") <= last)
    text = newest.groupBy("instrument").agg(F.array_join(F.transform(F.sort_array(F.collect_list("ts")), lambda t: F.date_format(t, "yyyy-MM-dd HH:mm")), ",").alias("last_missed"))
    out = counts.join(text, "instrument", "left").withColumn("missed", F.col("expected") - F.col("recorded"))
    return out.select("instrument", "expected", "recorded", "missed", (F.col("missed") / F.col("expected")).alias("share_missed"), F.coalesce("last_missed", F.lit("")).alias("last_missed"))


_COVER = _M5 + f""", sp AS (SELECT instrument, min(t) AS a, (SELECT max(t) FROM m5) AS b FROM m5 GROUP BY 1), gr AS (SELECT instrument, unnest(generate_series(a, b, INTERVAL 5 MINUTE)) AS t FROM sp), op AS (SELECT * FROM gr WHERE NOT {_closed_sql('(t + INTERVAL 5 MINUTE)')})
, cv AS (SELECT op.instrument, op.t, m5.t IS NOT NULL AS seen, row_number() OVER (PARTITION BY op.instrument, m5.t IS NOT NULL ORDER BY op.t DESC) AS k FROM op LEFT JOIN m5 ON m5.instrument = op.instrument AND m5.t = op.t)
, co AS (SELECT instrument, count(*) AS expected, count(*) FILTER (seen) AS recorded, expected - recorded AS missed, missed / expected AS share_missed, coalesce(string_agg(strftime(t, '%Y-%m-%d %H:%M'), ',' ORDER BY t) FILTER (NOT seen AND k <= 20), '') AS last_missed FROM cv GROUP BY 1)"""
R.add("q09_coverage", lambda k, d: coverage(candles(k, d)), sql("ticks", _COVER + columns("instrument expected recorded missed last_missed", "share_missed", "co")))


def health_alerts(snapshots: DataFrame, now: Column) -> DataFrame:
    """(instrument, alerts): snapshots over ten hours old, a heartbeat missing or over thirty minutes older than its snapshot, an error of the loop (but a closed market), over 2 % of bars missed."""
    hours = lambda a, b: (a.cast("double") - b.cast("double")) / 3600
    at, beat = F.col("generated_at"), F.col("heartbeat_at")
    excused = (F.col("error") == "market closed") & market_closed(at)
    rules = F.array(
        F.when(hours(now, at) > 10, F.lit("old_snapshot")), F.when(beat.isNull(), F.lit("no_heartbeat")).when(hours(at, beat) > 0.5, F.lit("old_heartbeat")),
        F.when(F.col("error").isNotNull() & ~excused, F.lit("loop_error")), F.when(F.col("missed") / F.nullif(F.col("expected"), F.lit(0)) > 0.02, F.lit("missed_bars")),
    )
    return snapshots.select("instrument", F.array_join(F.array_compact(rules), "|").alias("alerts"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot per instrument: taken an hour to five after its last candle, its heartbeat that candle's close but one is missing, and what errors there were."""
    last = candles(spark, sf_dir).groupBy("instrument").agg(F.max("ts").alias("last"))
    n = F.length("instrument")
    d = last.join(coverage(candles(spark, sf_dir)).select("instrument", "expected", "missed"), "instrument")
    return d.select(
        "instrument", "expected", "missed", F.timestamp_add("MINUTE", F.lit(10) + (n - 4) * 15, F.col("last")).alias("generated_at"), F.when(n != 8, F.col("last") + F.expr("interval 5 minutes")).alias("heartbeat_at"),
        F.when(n == 5, "timeout").when(n == 6, "market closed").alias("error"),
    )


R.add(
    "q10_health_rules", lambda k, d: health_alerts(snapshots(k, d), F.lit("2024-01-31 09:00:00").cast("timestamp")),
    sql("ticks", _COVER + f""", l AS (SELECT instrument, max(t) AS last, length(instrument) AS n FROM m5 GROUP BY 1), s AS (SELECT l.*, expected, missed, last + INTERVAL (10 + (n - 4) * 15) MINUTE AS g, CASE WHEN n <> 8 THEN last + INTERVAL 5 MINUTE END AS h, CASE WHEN n = 5 THEN 'timeout' WHEN n = 6 THEN 'market closed' END AS e FROM l JOIN co USING (instrument))
SELECT instrument, concat_ws('|', CASE WHEN TIMESTAMP '2024-01-31 09:00:00' - g > INTERVAL 10 HOUR THEN 'old_snapshot' END, CASE WHEN h IS NULL THEN 'no_heartbeat' WHEN g - h > INTERVAL 30 MINUTE THEN 'old_heartbeat' END, CASE WHEN e IS NOT NULL AND NOT (e = 'market closed' AND {_closed_sql('g')}) THEN 'loop_error' END, CASE WHEN missed / nullif(expected, 0) > 0.02 THEN 'missed_bars' END) AS alerts FROM s"""),
)
QUERIES, ORACLE_SQL = R.queries, R.sql
