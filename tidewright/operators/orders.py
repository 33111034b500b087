"""The order path and its compliance in full: plans with rejections, fills, reconciliation; pre-trade checks with warnings, the daily report, and a ledger of several currencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import settled
from ..plans.registry import Registry, columns
from ..sources.views import sql, ticks
from . import decisions as dec
from .decisions import _D, decisions
from .features import flag
from .market import market_closed

R = Registry()
#: Slippage that an order may accept, and that a paper fill has (basis points); age of a quote (seconds); cash at the start.
BOUND_BPS, SLIP_BPS, QUOTE_AGE, CASH = 2.0, 0.25, 15, 10_000.0
#: Fixed values, a dimension of the views' instruments: quote currency, base currency, least units.
SPECS = {"click": ("USD", "EUR", 1), "error": ("JPY", "USD", 150), "purchase": ("GBP", "EUR", 1), "signup": ("USD", "GBP", 1), "view": ("CHF", "USD", 1)}


def specs(df: DataFrame) -> DataFrame:
    """``df`` with quote and base currency and least units of its instruments (a constant map)."""
    pairs = [x for name, (quote, base, least) in SPECS.items() for x in (F.lit(name), F.struct(F.lit(quote).alias("quote"), F.lit(base).alias("base"), F.lit(least).alias("least")))]
    spec = F.element_at(F.create_map(*pairs), F.col("instrument"))
    return df.withColumn("quote_currency", spec["quote"]).withColumn("base_currency", spec["base"]).withColumn("least_units", spec["least"])


def in_dollars(gain: Column, price: Column) -> Column:
    """Money of the quote currency in US dollars; null for a cross."""
    return F.when(F.col("quote_currency") == "USD", gain).when(F.col("base_currency") == "USD", gain / price)


_SPEC = ", spec(instrument, quote_currency, base_currency, least_units) AS (VALUES " + ", ".join(f"('{n}', '{q}', '{b}', {u})" for n, (q, b, u) in SPECS.items()) + ")"

# Plans (T4) ---------------------------------------------------------------------------------------


def order_id(as_of: Column, instrument: Column, current: Column, result: Column) -> Column:
    """A repeatable id of an order: 16 hex digits of a digest of what it is."""
    text = F.concat_ws("|", F.concat(F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")), instrument, current.cast("string"), result.cast("string"))
    return F.concat(F.lit("TW-"), F.substring(F.sha2(text, 256), 1, 16))


def order_plan(targets: DataFrame, positions: DataFrame, quotes: DataFrame, processed: DataFrame) -> DataFrame:
    """One row per (as_of, instrument) whose target differs from the position: an order, or a rejection with its first reason.

    ``targets`` has units and stop_distance, ``positions`` units and average_price, ``quotes`` quoted_at,
    bid, ask and tradeable, ``processed`` the ids that were sent before. A reversal closes first; the
    other side opens in a later plan.
    """
    keys = ["as_of", "instrument"]
    both = targets.select(*keys, F.col("units").alias("target"), "stop_distance").join(positions.select(*keys, F.col("units").alias("current"), "average_price"), keys, "full_outer")
    both = both.withColumn("target", F.coalesce("target", F.lit(0))).withColumn("current", F.coalesce("current", F.lit(0))).where("target <> current")
    d = specs(both.join(quotes, keys, "left"))
    reverse = (F.col("current") != 0) & (F.col("target") != 0) & (F.signum("current") != F.signum("target"))
    reason = F.when(reverse, "close_for_reversal").when(F.col("current") == 0, "open").when(F.col("target") == 0, "close").when(F.abs("target") > F.abs("current"), "increase").otherwise("reduce")
    d = d.withColumn("reason", reason).withColumn("result", F.when(reverse, 0).otherwise(F.col("target"))).withColumn("units", F.col("result") - F.col("current"))
    d = d.withColumn("order_id", order_id(F.col("as_of"), F.col("instrument"), F.col("current"), F.col("result")))
    age = F.col("as_of").cast("double") - F.col("quoted_at").cast("double")
    d = d.join(processed.select("order_id", F.lit(True).alias("sent")).distinct(), "order_id", "left")
    rejected = F.coalesce(
        F.when(F.col("quoted_at").isNull(), "missing_quote"), F.when(~F.col("tradeable"), "instrument_not_tradeable"), F.when((age < 0) | (age > QUOTE_AGE), "stale_quote"),
        F.when(F.abs("units") < F.col("least_units"), "below_minimum_order_size"), F.when(F.col("sent"), "duplicate_client_order_id"),
    )
    buys = F.col("units") > 0
    reference = F.when(buys, F.col("ask")).otherwise(F.col("bid"))
    mid = (F.col("bid") + F.col("ask")) / 2
    d = d.withColumn("rejected", rejected)
    ordered = lambda c: F.when(F.col("rejected").isNull(), c)
    return d.select(
        *keys, "order_id", "current", "result", "units", "reason", "rejected", ordered(reference).alias("reference_price"), ordered(reference * F.when(buys, 1 + BOUND_BPS / 1e4).otherwise(1 - BOUND_BPS / 1e4)).alias("price_bound"),
        ordered(F.when((F.col("result") != 0) & (F.col("target") != 0), mid * (1 - F.signum("target") * F.col("stop_distance")))).alias("stop_loss"), "average_price",
    )


def day_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(as_of, instrument, e, bid, ask): the last tick of each instrument and day."""
    day = F.to_date("ts")
    last = ticks(spark, sf_dir).groupBy("instrument", day.alias("day")).agg(F.max_by(F.struct("tick_id", "bid", "ask"), F.struct("ts", "tick_id")).alias("t"))
    return last.select((F.col("day").cast("timestamp") + F.expr("interval 22 hours")).alias("as_of"), "instrument", F.col("t.tick_id").alias("e"), "t.bid", "t.ask")


def book_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(day ends, targets, positions, quotes): targets and positions in hundreds of units, some absent; some quotes missing, old or not tradeable."""
    d, e = settled(day_ends(spark, sf_dir)), F.col("e")
    keys = ["as_of", "instrument"]
    targets = d.where(F.pmod(e, F.lit(4)) != 0).select(*keys, ((F.pmod(e * 7919, F.lit(5)) - 2) * 100).alias("units"), (0.001 * (F.pmod(e, F.lit(9)) + 1)).alias("stop_distance"))
    positions = d.where(F.pmod(e, F.lit(3)) != 0).select(*keys, ((F.pmod(e * 104729, F.lit(5)) - 2) * 100).alias("units"), (F.col("bid") * (1 + (F.pmod(e, F.lit(11)) - 5) / 1e4)).alias("average_price")).where("units <> 0")
    quotes = d.where(F.pmod(e, F.lit(17)) != 0).select(*keys, F.timestamp_seconds(F.unix_timestamp("as_of") - F.pmod(e, F.lit(19)) + 1).alias("quoted_at"), "bid", "ask", (F.pmod(e, F.lit(13)) != 0).alias("tradeable"))
    return d, targets, positions, quotes


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of every day, where the orders of every seventh row were sent before."""
    d, targets, positions, quotes = book_of(spark, sf_dir)
    none = d.select(F.lit("").alias("order_id")).where("false")
    sent = order_plan(targets, positions, quotes, none).join(d.where(F.pmod("e", F.lit(7)) == 0).select("as_of", "instrument"), ["as_of", "instrument"], "left_semi").select("order_id")
    return order_plan(targets, positions, quotes, sent)


_BOOK = _SPEC + """, de AS (SELECT CAST(ts AS DATE) + INTERVAL 22 HOUR AS as_of, instrument, arg_max(tick_id, (ts, tick_id)) AS e, arg_max(bid, (ts, tick_id)) AS bid, arg_max(ask, (ts, tick_id)) AS ask FROM ticks GROUP BY CAST(ts AS DATE), instrument)
, bk AS (SELECT *, CASE WHEN e % 4 <> 0 THEN (e * 7919 % 5 - 2) * 100 ELSE 0 END AS target, CASE WHEN e % 3 <> 0 THEN (e * 104729 % 5 - 2) * 100 ELSE 0 END AS current, 0.001 * (e % 9 + 1) AS stop_distance, bid * (1 + (e % 11 - 5) / 1e4) AS average_price, 1 - e % 19 + 0 AS shift FROM de)
, pl AS (SELECT *, current <> 0 AND target <> 0 AND sign(current) <> sign(target) AS rev, CASE WHEN rev THEN 0 ELSE target END AS result, result - current AS units, CASE WHEN rev THEN 'close_for_reversal' WHEN current = 0 THEN 'open' WHEN target = 0 THEN 'close' WHEN abs(target) > abs(current) THEN 'increase' ELSE 'reduce' END AS reason,
  'TW-' || substring(sha256(strftime(as_of, '%Y-%m-%dT%H:%M:%S') || '+00:00|' || instrument || '|' || current || '|' || result), 1, 16) AS order_id FROM bk JOIN spec USING (instrument) WHERE target <> current)
, rj AS (SELECT *, CASE WHEN e % 17 = 0 THEN 'missing_quote' WHEN e % 13 = 0 THEN 'instrument_not_tradeable' WHEN -shift < 0 OR -shift > 15 THEN 'stale_quote' WHEN abs(units) < least_units THEN 'below_minimum_order_size' WHEN e % 7 = 0 THEN 'duplicate_client_order_id' END AS rejected FROM pl)
, op AS (SELECT *, CASE WHEN rejected IS NULL THEN CASE WHEN units > 0 THEN ask ELSE bid END END AS reference_price, reference_price * CASE WHEN units > 0 THEN 1 + 2 / 1e4 ELSE 1 - 2 / 1e4 END AS price_bound, CASE WHEN rejected IS NULL AND result <> 0 AND target <> 0 THEN (bid + ask) / 2 * (1 - sign(target) * stop_distance) END AS stop_loss FROM rj)"""
R.add("t04_order_plans", lambda k, d: planned(k, d).drop("average_price"), sql("ticks", _BOOK + columns("as_of instrument order_id current result units reason rejected", "reference_price price_bound stop_loss", "op", 8)), 8)

# Fills (T5) and reconciliation (T6) -----------------------------------------------------------------


def paper_fills(orders: DataFrame, quotes: DataFrame, actual: DataFrame, filled: DataFrame) -> DataFrame:
    """``orders`` with status, why, fill price and realised profit in dollars, against quotes and positions at the time of execution.

    ``actual`` has the units really held, ``filled`` the ids of orders that were filled before. The first
    reason stands; an order that is rejected or a duplicate fills nothing.
    """
    keys = ["as_of", "instrument"]
    d = orders.join(quotes.select(*keys, "quoted_at", "bid", "ask", "tradeable"), keys, "left").join(actual.select(*keys, F.col("units").alias("held")), keys, "left").withColumn("held", F.coalesce("held", F.lit(0)))
    d = specs(d.join(filled.select("order_id", F.lit(True).alias("again")).distinct(), "order_id", "left"))
    age, buys = F.col("as_of").cast("double") - F.col("quoted_at").cast("double"), F.col("units") > 0
    price = F.when(buys, F.col("ask") * (1 + SLIP_BPS / 1e4)).otherwise(F.col("bid") * (1 - SLIP_BPS / 1e4))
    d = d.withColumn("fill_price", price)
    why = F.coalesce(
        F.when(F.col("again"), "already_filled"), F.when(F.col("quoted_at").isNull(), "missing_or_mismatched_quote"), F.when(~F.col("tradeable"), "instrument_not_tradeable"), F.when((age < 0) | (age > QUOTE_AGE), "stale_quote"),
        F.when(F.col("held") != F.col("current"), "position_changed_since_planning"), F.when(F.col("held") + F.col("units") != F.col("result"), "invalid_resulting_position"),
        F.when(buys & (F.round("fill_price", 12) > F.round("price_bound", 12)), "buy_price_bound_exceeded"), F.when(~buys & (F.round("fill_price", 12) < F.round("price_bound", 12)), "sell_price_bound_exceeded"),
    )
    d = d.withColumn("why", F.coalesce(why, F.col("reason"))).withColumn("status", F.when(F.col("again"), "DUPLICATE").when(why.isNotNull(), "REJECTED").otherwise("FILLED"))
    done = F.col("status") == "FILLED"
    against = (F.col("held") != 0) & (F.signum("held") != F.signum("units"))
    gain = F.when(against, F.least(F.abs("held"), F.abs("units")) * (F.col("fill_price") - F.col("average_price")) * F.signum("held")).otherwise(0.0)
    average = F.when(F.col("result") == 0, 0.0).when(against, F.col("average_price")).otherwise((F.abs("held") * F.coalesce("average_price", F.lit(0.0)) + F.abs("units") * F.col("fill_price")) / F.abs("result"))
    return d.withColumn("filled_units", F.when(done, F.col("units")).otherwise(0)).withColumn("realised", F.when(done, F.coalesce(in_dollars(gain, F.col("fill_price")), F.lit(0.0))).otherwise(0.0)).withColumn("new_average", F.when(done, average))


def executed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills of the planned orders: quotes have moved a little by then, some positions too, and some orders come twice."""
    d, _, positions, quotes = book_of(spark, sf_dir)
    keys, e = ["as_of", "instrument"], F.col("e")
    orders = planned(spark, sf_dir).where("rejected is null").join(d.select(*keys, "e"), keys)
    moved = quotes.join(d.select(*keys, "e"), keys)
    moved = moved.select(*keys, "quoted_at", *((F.col(c) * (1 + (F.pmod(e, F.lit(9)) - 4) / 1e4)).alias(c) for c in ("bid", "ask")), (F.pmod(e, F.lit(23)) != 0).alias("tradeable"))
    held = positions.join(d.select(*keys, "e"), keys).select(*keys, (F.col("units") + F.when(F.pmod(e, F.lit(10)) == 0, 100).otherwise(0)).alias("units"))
    return paper_fills(settled(orders), moved, held, orders.where(F.pmod("e", F.lit(31)) == 0).select("order_id"))


_FILL = _BOOK + """, ex AS (SELECT *, bid * (1 + (e % 9 - 4) / 1e4) AS xb, ask * (1 + (e % 9 - 4) / 1e4) AS xa, current + CASE WHEN current <> 0 AND e % 10 = 0 THEN 100 ELSE 0 END AS held, CASE WHEN units > 0 THEN xa * (1 + 0.25 / 1e4) ELSE xb * (1 - 0.25 / 1e4) END AS fill_price FROM op WHERE rejected IS NULL)
, wy AS (SELECT *, CASE WHEN e % 31 = 0 THEN 'already_filled' WHEN e % 23 = 0 THEN 'instrument_not_tradeable' WHEN held <> current THEN 'position_changed_since_planning' WHEN units > 0 AND round(fill_price, 12) > round(price_bound, 12) THEN 'buy_price_bound_exceeded' WHEN units < 0 AND round(fill_price, 12) < round(price_bound, 12) THEN 'sell_price_bound_exceeded' END AS bad FROM ex)
, fi AS (SELECT *, coalesce(bad, reason) AS why, CASE WHEN e % 31 = 0 THEN 'DUPLICATE' WHEN bad IS NOT NULL THEN 'REJECTED' ELSE 'FILLED' END AS status, held <> 0 AND sign(held) <> sign(units) AS against, CASE WHEN against THEN least(abs(held), abs(units)) * (fill_price - average_price) * sign(held) ELSE 0 END AS gain,
  CASE WHEN bad IS NULL THEN units ELSE 0 END AS filled_units, CASE WHEN bad IS NULL THEN coalesce(CASE WHEN quote_currency = 'USD' THEN gain WHEN base_currency = 'USD' THEN gain / fill_price END, 0) ELSE 0 END AS realised,
  CASE WHEN bad IS NULL THEN CASE WHEN result = 0 THEN 0 WHEN against THEN average_price ELSE (abs(held) * CASE WHEN current = 0 THEN 0 ELSE average_price END + abs(units) * fill_price) / abs(result) END END AS new_average FROM wy)"""
R.add("t05_paper_fills", lambda k, d: executed(k, d).select("order_id", "status", "why", F.col("filled_units").cast("long").alias("filled_units"), "fill_price", "realised", "new_average"), sql("ticks", _FILL + " SELECT order_id, status, why, CAST(filled_units AS BIGINT) AS filled_units, round(fill_price, 7) + 0.0 AS fill_price, round(realised, 7) + 0.0 AS realised, round(new_average, 7) + 0.0 AS new_average FROM fi"), 7)


def reconciled(targets: DataFrame, positions: DataFrame, marks: DataFrame, realised: DataFrame, cash: float = CASH) -> DataFrame:
    """One row per as_of: whether targets and positions agree, the differences, the missing and the orphan instruments, and the equity marked at mid prices."""
    keys = ["as_of", "instrument"]
    both = targets.select(*keys, F.col("units").alias("expected")).join(positions.select(*keys, F.col("units").alias("actual"), "average_price"), keys, "full_outer")
    both = specs(both.withColumn("expected", F.coalesce("expected", F.lit(0))).withColumn("actual", F.coalesce("actual", F.lit(0))).join(marks.select(*keys, "mid"), keys, "left"))
    listed = lambda test, text: F.array_join(F.sort_array(F.collect_list(F.when(test, text))), ",")
    e, a = F.col("expected"), F.col("actual")
    unrealised = F.coalesce(in_dollars(a * (F.col("mid") - F.col("average_price")), F.col("mid")), F.lit(0.0))
    out = both.groupBy("as_of").agg(
        F.bool_and(e == a).alias("in_sync"), listed(e != a, F.concat_ws(":", "instrument", e.cast("string"), a.cast("string"))).alias("differences"),
        listed((e != 0) & (a == 0), F.col("instrument")).alias("missing"), listed((a != 0) & (e == 0), F.col("instrument")).alias("orphan"), F.sum(unrealised).alias("unrealised"),
    )
    paid = realised.groupBy("as_of").agg(F.sum("realised").alias("realised"))
    return out.join(paid, "as_of", "left").select("as_of", "in_sync", "differences", "missing", "orphan", (cash + F.col("unrealised") + F.coalesce("realised", F.lit(0.0))).alias("equity"))


def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of every day after its fills."""
    d, targets, positions, _ = book_of(spark, sf_dir)
    keys = ["as_of", "instrument"]
    done = settled(executed(spark, sf_dir)).select(*keys, F.col("result").alias("_result"), "new_average", "status", "realised")
    after = positions.join(done.where("status = 'FILLED'"), keys, "full_outer").select(*keys, F.coalesce("_result", "units").alias("units"), F.coalesce("new_average", "average_price").alias("average_price")).where("units <> 0")
    return reconciled(targets, after, d.select(*keys, ((F.col("bid") + F.col("ask")) / 2).alias("mid")), done)


R.add(
    "t06_reconciliations", lambda k, d: reconciliation(k, d),
    sql("ticks", _FILL + """, af AS (SELECT bk.*, spec.quote_currency, spec.base_currency, fi.status = 'FILLED' AS did, CASE WHEN did THEN fi.result ELSE bk.current END AS actual, CASE WHEN did THEN fi.new_average ELSE bk.average_price END AS avg2, (bk.bid + bk.ask) / 2 AS mid, coalesce(fi.realised, 0) AS realised
  FROM bk JOIN spec USING (instrument) LEFT JOIN fi USING (as_of, instrument) WHERE bk.e % 4 <> 0 OR CASE WHEN fi.status = 'FILLED' THEN fi.result ELSE bk.current END <> 0 OR fi.order_id IS NOT NULL)
, un AS (SELECT *, coalesce(CASE WHEN quote_currency = 'USD' THEN actual * (mid - avg2) WHEN base_currency = 'USD' THEN actual * (mid - avg2) / mid END, 0) AS u FROM af)
, ss AS (SELECT as_of, coalesce(bool_and(target = actual) FILTER (e % 4 <> 0 OR actual <> 0), true) AS in_sync, count(*) FILTER (e % 4 <> 0 OR actual <> 0) AS k, coalesce(string_agg(instrument || ':' || target || ':' || actual, ',' ORDER BY instrument || ':' || target || ':' || actual) FILTER (target <> actual), '') AS differences,
  coalesce(string_agg(instrument, ',' ORDER BY instrument) FILTER (target <> 0 AND actual = 0), '') AS missing, coalesce(string_agg(instrument, ',' ORDER BY instrument) FILTER (actual <> 0 AND target = 0), '') AS orphan, 10000 + sum(u) + sum(realised) AS equity FROM un GROUP BY as_of HAVING k > 0)""" + columns("as_of in_sync differences missing orphan", "equity", "ss", 5)), 5,
)

# Compliance (C17, C20) --------------------------------------------------------------------------------

#: Limits of an order, of a day, of a minute; seconds of a hold and of a blackout; leverage, share of equity, loss of a day, loss that trips the breaker.
ORDER_UNITS, DAY_ORDERS, MINUTE_ORDERS, HOLD, BLACKOUT = 500_000, 200, 10, 900, 60
LEVERAGE, SHARE, DAY_LOSS, BREAKER, EQUITY = 30, 0.2, 0.03, 0.15, 10_000.0
CHECKS = ("circuit_breaker", "position_limit", "leverage_limit", "daily_loss_limit", "order_size", "daily_order_count", "hft_rate", "wash_trade", "news_blackout", "market_hours")


def pre_trade(df: DataFrame) -> DataFrame:
    """All pre-trade checks of decisions (units, close, day_pnl, high_impact, news_at), one boolean per check, ``failures`` and ``warnings``.

    Notional is in dollars; a cross has none and fails. A tripped breaker ends the check: nothing else is
    looked at, for the rest of the day. Orders are those with units; counts are of the orders before.
    """
    d = specs(df)
    of_day = Window.partitionBy("instrument", F.to_date("ts")).orderBy("ts", "event_id")
    before = of_day.rowsBetween(Window.unboundedPreceding, -1)
    second = F.col("ts").cast("long")
    minute = Window.partitionBy("instrument", F.to_date("ts")).orderBy(second).rangeBetween(-59, 0)
    traded = F.col("units") != 0
    one = flag(traded)
    d = d.withColumn("orders_before", F.coalesce(F.sum(one).over(before), F.lit(0))).withColumn("in_minute", F.sum(one).over(minute) - one)
    d = d.withColumn("_last", F.last(F.when(traded, F.struct("units", second.alias("at"))), ignorenulls=True).over(before))
    d = d.withColumn("broken", F.max(flag(F.round("day_pnl", 9) <= -BREAKER)).over(of_day.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    size = F.abs("units")
    notional = F.when(F.col("quote_currency") == "USD", size * F.col("close")).when(F.col("base_currency") == "USD", size.cast("double")).otherwise(F.lit(float("inf")))
    most = EQUITY * LEVERAGE * SHARE
    flips = traded & F.col("_last").isNotNull() & (F.signum("units") != F.signum("_last.units"))
    loss = F.round("day_pnl", 9)
    tests = {
        "circuit_breaker": ~F.col("broken"), "position_limit": notional <= most, "leverage_limit": notional / EQUITY <= LEVERAGE, "daily_loss_limit": loss > -DAY_LOSS, "order_size": size <= ORDER_UNITS, "daily_order_count": F.col("orders_before") < DAY_ORDERS,
        "hft_rate": F.col("in_minute") < MINUTE_ORDERS, "wash_trade": ~flips | (second - F.col("_last.at") >= HOLD),
        "news_blackout": ~F.col("high_impact") | F.coalesce(F.unix_timestamp("ts") - F.unix_timestamp("news_at") >= BLACKOUT, F.lit(False)), "market_hours": ~market_closed(F.col("ts"), 22, False),
    }
    for name, ok in tests.items():
        d = d.withColumn(f"ok_{name}", ok if name == "circuit_breaker" else F.when(~F.col("broken"), F.coalesce(ok, F.lit(True))))
    failures = F.array_compact(F.array(*(F.when(~F.col(f"ok_{n}"), F.lit(n)) for n in CHECKS)))
    warn = F.array_compact(F.array(F.when(notional > 0.9 * most, F.lit("approaching_position_limit")), F.when(notional / EQUITY > 0.85 * LEVERAGE, F.lit("high_leverage")), F.when(loss < -0.8 * DAY_LOSS, F.lit("approaching_daily_loss_limit"))))
    return d.withColumn("failures", F.when(F.col("broken"), "circuit_breaker").otherwise(F.array_join(failures, "|"))).withColumn("warnings", F.when(F.col("broken"), "").otherwise(F.array_join(warn, "|")))


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-trade checks of all decisions: news of high impact on every eleventh, at a time before it or at none; a day's result is twenty times its price move."""
    d = decisions(spark, sf_dir).withColumn("day", F.to_date("ts"))
    first = d.groupBy("instrument", "day").agg(F.min_by("close", F.struct("ts", "event_id")).alias("_first"))
    e = F.col("event_id")
    d = d.join(first, ["instrument", "day"]).withColumn("day_pnl", 20 * (F.col("close") / F.col("_first") - 1)).withColumn("high_impact", F.pmod(e, F.lit(11)) == 0)
    return pre_trade(d.withColumn("news_at", F.when(F.pmod(e, F.lit(3)) != 0, F.timestamp_seconds(F.unix_timestamp("ts") - F.pmod(e, F.lit(20)) * 10))))


def daily_report(df: DataFrame) -> DataFrame:
    """(day, check, n_checks, n_failures, pass_rate) of every check that was looked at, and of all together."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(f"ok_{n}").alias("passed")) for n in CHECKS), F.struct(F.lit("all").alias("check"), (F.col("failures") == "").alias("passed"))))
    d = df.select(F.to_date("ts").alias("day"), each.alias("c")).select("day", "c.*").where("passed is not null")
    return d.groupBy("day", "check").agg(F.count("*").alias("n_checks"), F.sum(flag(~F.col("passed"))).cast("long").alias("n_failures"), F.avg(flag(F.col("passed")).cast("double")).alias("pass_rate"))


_OK = {
    "position_limit": "notional <= 60000", "leverage_limit": "notional / 10000 <= 30", "daily_loss_limit": "loss > -0.03", "order_size": "abs(units) <= 500000", "daily_order_count": "orders_before < 200", "hft_rate": "in_minute < 10",
    "wash_trade": "NOT (units <> 0 AND lu IS NOT NULL AND sign(units) <> sign(lu)) OR sec - ls >= 900", "news_blackout": "event_id % 11 <> 0 OR event_id % 3 <> 0 AND event_id % 20 * 10 >= 60",
    "market_hours": "NOT (isodow(ts) = 6 OR isodow(ts) = 7 AND hour(ts) < 22 OR isodow(ts) = 5 AND hour(ts) >= 22)",
}
_CHECK = _D + _SPEC + """, cd AS (SELECT dec.*, quote_currency, base_currency, CAST(ts AS DATE) AS day, CAST(floor(epoch(ts)) AS BIGINT) AS sec, round(20 * (close / first_value(close) OVER (PARTITION BY dec.instrument, CAST(ts AS DATE) ORDER BY ts, event_id) - 1), 9) AS loss FROM dec JOIN spec USING (instrument))
, ce AS (SELECT *, count(*) FILTER (units <> 0) OVER b AS orders_before, count(*) FILTER (units <> 0) OVER m - CASE WHEN units <> 0 THEN 1 ELSE 0 END AS in_minute, last_value(CASE WHEN units <> 0 THEN units END IGNORE NULLS) OVER b AS lu, last_value(CASE WHEN units <> 0 THEN sec END IGNORE NULLS) OVER b AS ls,
  max(CASE WHEN loss <= -0.15 THEN 1 ELSE 0 END) OVER o = 1 AS broken, CASE WHEN quote_currency = 'USD' THEN abs(units) * close WHEN base_currency = 'USD' THEN abs(units) ELSE 'inf'::DOUBLE END AS notional FROM cd
  WINDOW o AS (PARTITION BY instrument, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY instrument, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), m AS (PARTITION BY instrument, day ORDER BY sec RANGE BETWEEN 59 PRECEDING AND CURRENT ROW))
, cf AS (SELECT *, NOT broken AS ok_circuit_breaker, """ + ", ".join(f"CASE WHEN NOT broken THEN coalesce({t}, true) END AS ok_{n}" for n, t in _OK.items()) + """ FROM ce)
, cg AS (SELECT *, CASE WHEN broken THEN 'circuit_breaker' ELSE concat_ws('|', """ + ", ".join(f"CASE WHEN NOT ok_{n} THEN '{n}' END" for n in _OK) + """) END AS failures, CASE WHEN broken THEN '' ELSE concat_ws('|', CASE WHEN notional > 54000 THEN 'approaching_position_limit' END, CASE WHEN notional / 10000 > 25.5 THEN 'high_leverage' END, CASE WHEN loss < -0.024 THEN 'approaching_daily_loss_limit' END) END AS warnings FROM cf)"""
R.add("c17_all_checks", lambda k, d: checked(k, d).select("event_id", "failures", "warnings"), sql("forecasts", _CHECK + " SELECT event_id, failures, warnings FROM cg"))
R.add(
    "c20_report_by_check", lambda k, d: daily_report(checked(k, d)),
    sql("forecasts", _CHECK + ", ch AS (" + " UNION ALL ".join(f"SELECT day, '{n}' AS \"check\", ok_{n} AS passed FROM cg" for n in CHECKS) + """ UNION ALL SELECT day, 'all', failures = '' FROM cg)
, o AS (SELECT day, "check", count(*) AS n_checks, count(*) FILTER (NOT passed) AS n_failures, avg(CASE WHEN passed THEN 1.0 ELSE 0 END) AS pass_rate FROM ch WHERE passed IS NOT NULL GROUP BY ALL)""" + columns('day "check" n_checks n_failures', "pass_rate", "o")),
)

# Ledger of several currencies (C16) -------------------------------------------------------------------


def currency_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The causal ledger of compliant decisions, each instrument in its own currencies; crosses, which need a rate of their own, are left out."""
    d = checked(spark, sf_dir).withColumn("compliant", F.col("failures") == "").withColumn("home", F.col("quote_currency") == "USD").where("quote_currency = 'USD' or base_currency = 'USD'")
    keep = [c for c in d.columns if not c.startswith(("ok_", "_", "orders_", "in_minute", "broken", "least_"))]
    return dec.ledger(dec.target_units(d.select(*keep)), quote_is_home="home")


_TGT = ", pt AS (SELECT *, quote_currency = 'USD' AS home FROM cg WHERE quote_currency = 'USD' OR base_currency = 'USD')" + dec._TARGET
R.add("c16_currency_ledger", lambda k, d: currency_ledger(k, d).select("event_id", F.col("pos").cast("int").alias("pos"), F.col("delta").cast("int").alias("delta"), "paid", "net", "equity", "drawdown"), sql("forecasts", _CHECK + _TGT + dec.ledger_sql_tail(True) + columns("event_id pos delta", "paid net equity drawdown", "led", 4)), 4)
QUERIES, ORACLE_SQL = R.queries, R.sql
