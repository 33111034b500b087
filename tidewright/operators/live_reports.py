"""Ledger per strategy and its reports: evaluator frames, trades, summaries, practice fills; macro views; the assembled feature table; the causal regime filter; a surrogate of decisions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import BLOCK, numbered, running_sum, settled, with_halo
from ..plans.registry import Registry, columns
from ..sources.views import bars, daily_bars, forecasts, macro_obs, news, sql
from . import features as f
from .decisions import _C, N, composite, decisions, distinct_news, second_model, window_totals
from .evaluation_queries import RULES_SQL, positions
from .feature_queries import COLUMNS
from .feature_queries import ORACLE_SQL as FEATURE_SQL
from .features import KEYS
from .market import _DER, as_of, availability, derived, six
from .market import ORACLE_SQL as MARKET_SQL

R = Registry()
SERIES = ["strategy", "instrument"]
#: Pip, reference cost in pips, starting balance, units of one position.
PIP, REFERENCE, START, ORDER_UNITS = 0.0001, 0.8, 10_000.0, 1_000

# Ledger --------------------------------------------------------------------------------------


def paper_ledger(targets: DataFrame) -> DataFrame:
    """Running ledger of (strategy, instrument, ts, rn, pos, mid, bid, ask): gross pips, costs, number of trades.

    The position held so far is marked on the bar that just closed, then moved to the target; turnover
    pays half the reference cost, or half the quoted spread. A trade starts where the side changes.
    """

    def build(d: DataFrame, w) -> DataFrame:
        before, mid = F.coalesce(w.lag("pos"), F.lit(0.0)), F.coalesce(w.lag("mid"), F.col("mid"))
        d = d.withColumn("_gross", before * (F.col("mid") - mid) / PIP).withColumn("_moved", F.abs(F.col("pos") - before))
        d = d.withColumn("_new", F.when((F.col("pos") != 0) & (F.signum("pos") != F.signum(before)), 1).otherwise(0))
        return d.withColumn("_ref", F.col("_moved") * REFERENCE / 2).withColumn("_quoted", F.col("_moved") * (F.col("ask") - F.col("bid")) / PIP / 2)

    d = running_sum(with_halo(targets, SERIES, 1, build), SERIES, {"gross_pips": "_gross", "cost_ref_pips": "_ref", "cost_quoted_pips": "_quoted", "trades": "_new"})
    return d.select(*SERIES, "ts", "rn", F.col("pos").alias("position"), "mid", "gross_pips", "cost_ref_pips", "cost_quoted_pips", "trades")


def ledger_of_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paper ledger of all rules."""
    quotes = bars(spark, sf_dir).select("instrument", "ts", F.col("close").alias("mid"), F.col("bid_close").alias("bid"), F.col("ask_close").alias("ask"))
    return paper_ledger(positions(spark, sf_dir).select(*SERIES, "ts", "rn", "pos").join(quotes, ["instrument", "ts"]))


def evaluator_frame(ledger: DataFrame) -> DataFrame:
    """Ledger rows as scored bars: what was held, its return and pips, and the costs of the bar from the running ones."""

    def build(d: DataFrame, w) -> DataFrame:
        d = d.withColumn("held", F.coalesce(w.lag("position"), F.lit(0.0))).withColumn("r_log", F.coalesce(F.log(F.col("mid") / w.lag("mid")), F.lit(0.0)))
        d = d.withColumn("pnl_pips", F.col("held") * F.coalesce(F.col("mid") - w.lag("mid"), F.lit(0.0)) / PIP)
        for c in ("ref", "quoted"):
            name = f"cost_{c}_pips"
            d = d.withColumn(f"{c}_pips", F.col(name) - F.coalesce(w.lag(name), F.lit(0.0)))
        d = d.withColumn("gross_log", F.col("held") * F.col("r_log")).withColumn("pip_log", PIP / F.col("mid"))
        return d.withColumn("ref_log", F.col("gross_log") - F.col("ref_pips") * F.col("pip_log")).withColumn("quoted_log", F.col("gross_log") - F.col("quoted_pips") * F.col("pip_log"))

    return with_halo(ledger, SERIES, 1, build)


def clock_trades(frame: DataFrame, bar: str = "1 day") -> DataFrame:
    """Runs held in one direction, with clock times, money figures and whether they are still open.

    A bar is labelled by its open: a trade opens at its first held bar and closes ``bar`` after its last.
    """
    d = with_halo(frame.withColumn("_side", F.signum("held")), SERIES, 1, lambda x, w: x.withColumn("_start", F.when(F.col("_side") == w.lag("_side"), 0).otherwise(1)))
    d = running_sum(d, SERIES, {"_run": "_start"})
    ends = frame.groupBy(*SERIES).agg(F.max("ts").alias("_end"), F.max_by("position", "rn").alias("_now"))
    t = d.where("held <> 0").groupBy(*SERIES, "_run").agg(
        F.min("ts").alias("opened"), F.max("ts").alias("_last"), F.max("_side").alias("direction"), F.sum("pnl_pips").alias("gross_pips"), F.sum("gross_log").alias("_log"),
        F.avg("pip_log").alias("_pip"), F.avg(F.abs("held")).alias("_size"),
    )
    return t.join(ends, SERIES).select(
        *SERIES, "opened", (F.col("_last") + F.expr(f"interval {bar}")).alias("closed"), F.col("direction").cast("int").alias("direction"), "gross_pips", (F.col("_size") * REFERENCE).alias("cost_pips"),
        (START * F.expm1("_log")).alias("gross_gbp"), (START * F.col("_size") * REFERENCE * F.col("_pip")).alias("cost_gbp"), ((F.col("_last") == F.col("_end")) & (F.col("_now") != 0)).alias("open"),
    )


_LG = RULES_SQL + """, ps AS (SELECT p.strategy, p.instrument, p.ts, p.rn, p.pos, b.close AS mid, b.bid_close AS bid, b.ask_close AS ask FROM positions AS p JOIN bars AS b ON b.instrument = p.instrument AND b.ts = p.ts)
, st AS (SELECT *, coalesce(lag(pos) OVER k, 0) AS before, coalesce(lag(mid) OVER k, mid) AS pm FROM ps WINDOW k AS (PARTITION BY strategy, instrument ORDER BY rn))
, lgr AS (SELECT strategy, instrument, ts, rn, pos AS position, mid, sum(before * (mid - pm) / 0.0001) OVER k AS gross_pips, sum(abs(pos - before) * 0.4) OVER k AS cost_ref_pips, sum(abs(pos - before) * (ask - bid) / 0.0001 / 2) OVER k AS cost_quoted_pips,
  CAST(sum(CASE WHEN pos <> 0 AND sign(pos) <> sign(before) THEN 1 ELSE 0 END) OVER k AS BIGINT) AS trades FROM st WINDOW k AS (PARTITION BY strategy, instrument ORDER BY rn))"""
_EV = _LG + """, ev AS (SELECT *, coalesce(lag(position) OVER k, 0) AS held, coalesce(ln(mid / lag(mid) OVER k), 0) AS r_log, held * coalesce(mid - lag(mid) OVER k, 0) / 0.0001 AS pnl_pips, cost_ref_pips - coalesce(lag(cost_ref_pips) OVER k, 0) AS ref_pips,
  cost_quoted_pips - coalesce(lag(cost_quoted_pips) OVER k, 0) AS quoted_pips, held * r_log AS gross_log, 0.0001 / mid AS pip_log, gross_log - ref_pips * pip_log AS ref_log, gross_log - quoted_pips * pip_log AS quoted_log FROM lgr WINDOW k AS (PARTITION BY strategy, instrument ORDER BY rn))"""
_TR = _EV + """, sd AS (SELECT *, CASE WHEN sign(held) = lag(sign(held)) OVER k THEN 0 ELSE 1 END AS s FROM ev WINDOW k AS (PARTITION BY strategy, instrument ORDER BY rn)), rr AS (SELECT *, sum(s) OVER (PARTITION BY strategy, instrument ORDER BY rn) AS run FROM sd)
, en AS (SELECT strategy, instrument, max(ts) AS z, arg_max(position, rn) AS now FROM ev GROUP BY ALL)
, tg AS (SELECT strategy, instrument, run, min(ts) AS opened, max(ts) AS lst, CAST(max(sign(held)) AS INTEGER) AS direction, sum(pnl_pips) AS gross_pips, sum(gross_log) AS lg, avg(pip_log) AS pl, avg(abs(held)) AS size FROM rr WHERE held <> 0 GROUP BY ALL)
, trd AS (SELECT strategy, instrument, opened, lst + INTERVAL 1 DAY AS closed, direction, gross_pips, size * 0.8 AS cost_pips, 10000 * (exp(lg) - 1) AS gross_gbp, 10000 * size * 0.8 * pl AS cost_gbp, lst = z AND now <> 0 AS open FROM tg JOIN en USING (strategy, instrument))"""
#: Sums of decimal prices often end in a 5 right behind the last digit that is compared; this moves them off it.
_OFF = 0.0001370193
R.add("o06_paper_ledger", lambda k, d: ledger_of_rules(k, d).select(*SERIES, "ts", "rn", "position", "trades", *((F.col(c) + _OFF).alias(c) for c in ("gross_pips", "cost_ref_pips", "cost_quoted_pips"))), sql("bars", _LG + f", o AS (SELECT strategy, instrument, ts, rn, position, trades, gross_pips + {_OFF} AS gross_pips, cost_ref_pips + {_OFF} AS cost_ref_pips, cost_quoted_pips + {_OFF} AS cost_quoted_pips FROM lgr)" + columns("strategy instrument ts rn trades", "position gross_pips cost_ref_pips cost_quoted_pips", "o", 3)), 3)
R.add("x01_evaluator_frame", lambda k, d: evaluator_frame(ledger_of_rules(k, d)).select(*SERIES, "ts", "held", "r_log", "pnl_pips", "ref_pips", "quoted_pips", "gross_log", "ref_log", "quoted_log"), sql("bars", _EV + columns("strategy instrument ts", "held r_log pnl_pips ref_pips quoted_pips gross_log ref_log quoted_log", "ev", 5)), 5)
R.add("x02_clock_trades", lambda k, d: clock_trades(evaluator_frame(ledger_of_rules(k, d))), sql("bars", _TR + columns("strategy instrument opened closed direction open", "gross_pips cost_pips gross_gbp cost_gbp", "trd", 4)), 4)


def strategy_summary(frame: DataFrame, trades: DataFrame) -> DataFrame:
    """One row per series: trades, hit rate where both moved, bars in the market, pips, costs, position now."""
    both = (F.col("held") != 0) & (F.col("r_log") != 0)
    totals = frame.groupBy(*SERIES).agg(
        F.avg(F.when(both, F.when(F.signum("held") == F.signum("r_log"), 1.0).otherwise(0.0))).alias("hit"), F.count(F.when(F.col("held") != 0, 1)).alias("bars_in_market"), F.sum("pnl_pips").alias("gross_pips"),
        F.sum("ref_pips").alias("cost_ref_pips"), F.sum("quoted_pips").alias("cost_quoted_pips"), F.max_by("position", "rn").alias("position"),
    )
    return totals.join(trades.groupBy(*SERIES).agg(F.count("*").alias("trades")), SERIES, "left").na.fill(0, ["trades"])


def daily_figures(frame: DataFrame) -> DataFrame:
    """Daily log returns (gross, at reference and at quoted cost) of each series on all days of the trial, 0 where it has none."""
    day = F.to_date("ts")
    own = frame.groupBy(*SERIES, day.alias("day")).agg(*(F.sum(c).alias(c) for c in ("gross_log", "ref_log", "quoted_log")))
    trial = frame.select(day.alias("day")).distinct()
    span = trial.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    every = frame.select(*SERIES).distinct().join(F.broadcast(span)).withColumn("day", F.explode(F.sequence("a", "b"))).drop("a", "b")  # one row of two dates is broadcast
    return every.join(trial, "day", "left_semi").join(own, [*SERIES, "day"], "left").na.fill(0.0).select(*SERIES, "day", "gross_log", "ref_log", "quoted_log")


def recent_trades(trades: DataFrame, days: int = 2) -> DataFrame:
    """The trades that closed on the last ``days`` days on which any of their series did."""
    d = trades.withColumn("day", F.to_date("closed"))
    rank = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("day")))
    last = d.select(*SERIES, "day").distinct().withColumn("_k", rank).where(F.col("_k") <= days).drop("_k")
    return d.join(last, [*SERIES, "day"], "left_semi").drop("day")


def with_frame(build):
    """A query over the evaluator frame of the rules, computed once."""
    return lambda spark, sf_dir: build(settled(evaluator_frame(ledger_of_rules(spark, sf_dir))))


R.add("x03_strategy_summary", with_frame(lambda e: strategy_summary(e, clock_trades(e))), sql("bars", _TR + """, c AS (SELECT strategy, instrument, count(*) AS trades FROM trd GROUP BY ALL), s AS (SELECT strategy, instrument, avg(CASE WHEN held <> 0 AND r_log <> 0 THEN CASE WHEN sign(held) = sign(r_log) THEN 1.0 ELSE 0 END END) AS hit, count(*) FILTER (held <> 0) AS bars_in_market,
  sum(pnl_pips) AS gross_pips, sum(ref_pips) AS cost_ref_pips, sum(quoted_pips) AS cost_quoted_pips, arg_max(position, rn) AS position FROM ev GROUP BY ALL), o AS (SELECT s.*, coalesce(trades, 0) AS trades FROM s LEFT JOIN c USING (strategy, instrument))""" + columns("strategy instrument trades bars_in_market", "hit gross_pips cost_ref_pips cost_quoted_pips position", "o", 4)), 4)
R.add("x03_daily_figures", with_frame(daily_figures), sql("bars", _EV + """, dd AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM ev), ss AS (SELECT DISTINCT strategy, instrument FROM ev), ow AS (SELECT strategy, instrument, CAST(ts AS DATE) AS day, sum(gross_log) AS g, sum(ref_log) AS r, sum(quoted_log) AS q FROM ev GROUP BY ALL)
, o AS (SELECT ss.strategy, ss.instrument, dd.day, coalesce(g, 0) AS gross_log, coalesce(r, 0) AS ref_log, coalesce(q, 0) AS quoted_log FROM ss CROSS JOIN dd LEFT JOIN ow ON ow.strategy = ss.strategy AND ow.instrument = ss.instrument AND ow.day = dd.day)""" + columns("strategy instrument day", "gross_log ref_log quoted_log", "o", 7)), 7)
R.add("x03_recent_trades", with_frame(lambda e: recent_trades(clock_trades(e))), sql("bars", _TR + ", o AS (SELECT * FROM trd QUALIFY dense_rank() OVER (PARTITION BY strategy, instrument ORDER BY CAST(closed AS DATE) DESC) <= 2)" + columns("strategy instrument opened closed direction open", "gross_pips cost_pips gross_gbp cost_gbp", "o", 4)), 4)


def practice_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of every forecast with a signal: filled at the quote some seconds after the bar, or failed."""
    e = F.col("event_id")
    price = F.when(F.col("signal") > 0, F.col("ask_close")).otherwise(F.col("bid_close")) + (F.pmod(e, F.lit(7)) - 3) / 1e6
    return forecasts(spark, sf_dir).where("signal <> 0").select(
        e.alias("tag"), "instrument", "ts", F.col("close").alias("mid"), (F.col("signal") * ORDER_UNITS).alias("units"), F.when(F.pmod(e, F.lit(13)) == 0, "failed").otherwise("filled").alias("status"),
        price.alias("price"), F.col("bid_close").alias("bid"), F.col("ask_close").alias("ask"), F.pmod(e, F.lit(30)).cast("double").alias("delay_s"),
    )


def against_mid(orders: DataFrame) -> DataFrame:
    """Filled orders against the ledger's mid: pips paid beyond it and beyond half the reference cost, in money, and the spread."""
    d = orders.where("status = 'filled'").withColumn("vs_mid_pips", (F.col("price") - F.col("mid")) * F.signum("units") / PIP)
    d = d.withColumn("extra_pips", F.col("vs_mid_pips") - REFERENCE / 2).withColumn("spread_pips", (F.col("ask") - F.col("bid")) / PIP)
    return d.withColumn("extra_gbp", START * F.col("extra_pips") * PIP / F.col("mid") * F.abs("units") / ORDER_UNITS)


def orders_summary(orders: DataFrame) -> DataFrame:
    """Practice fills per instrument: numbers, means, totals and the median delay."""
    done = against_mid(orders).groupBy("instrument").agg(
        F.count("*").alias("filled"), F.sum(F.abs("units")).cast("long").alias("units_traded"), F.avg("vs_mid_pips").alias("mean_vs_mid_pips"), F.avg("extra_pips").alias("mean_extra_pips"), F.sum("extra_pips").alias("total_extra_pips"),
        F.sum("extra_gbp").alias("total_extra_gbp"), F.avg("spread_pips").alias("mean_spread_pips"), F.percentile("delay_s", 0.5).alias("median_delay_s"),
    )
    failed = orders.groupBy("instrument").agg(F.count(F.when(F.col("status") == "failed", 1)).alias("failed"))
    return failed.join(done, "instrument", "left")


def latest_orders(orders: DataFrame, rows: int = 200) -> DataFrame:
    """The latest ``rows`` orders, filled ones with their figures."""
    last = orders.orderBy(F.desc("ts"), F.desc("tag")).limit(rows)
    return last.join(against_mid(orders).select("tag", "vs_mid_pips", "extra_pips", "spread_pips"), "tag", "left").select("tag", "ts", "units", "status", "vs_mid_pips", "extra_pips", "spread_pips")


_PO = """, po AS (SELECT event_id AS tag, instrument, ts, close AS mid, signal * 1000 AS units, CASE WHEN event_id % 13 = 0 THEN 'failed' ELSE 'filled' END AS status, CASE WHEN signal > 0 THEN ask_close ELSE bid_close END + (event_id % 7 - 3) / 1e6 AS price, bid_close AS bid, ask_close AS ask, CAST(event_id % 30 AS DOUBLE) AS delay_s FROM forecasts WHERE signal <> 0)
, am AS (SELECT *, (price - mid) * sign(units) / 0.0001 AS vs_mid_pips, vs_mid_pips - 0.4 AS extra_pips, (ask - bid) / 0.0001 AS spread_pips, 10000 * extra_pips * 0.0001 / mid * abs(units) / 1000 AS extra_gbp FROM po WHERE status = 'filled')"""
R.add("x04_orders_summary", lambda k, d: orders_summary(practice_orders(k, d)), sql("forecasts", _PO + ", dn AS (SELECT instrument, count(*) AS filled, CAST(sum(abs(units)) AS BIGINT) AS units_traded, avg(vs_mid_pips) AS mean_vs_mid_pips, avg(extra_pips) AS mean_extra_pips, sum(extra_pips) AS total_extra_pips, sum(extra_gbp) AS total_extra_gbp, avg(spread_pips) AS mean_spread_pips, quantile_cont(delay_s, 0.5) AS median_delay_s FROM am GROUP BY ALL), fd AS (SELECT instrument, count(*) FILTER (status = 'failed') AS failed FROM po GROUP BY ALL), o AS (SELECT * FROM fd LEFT JOIN dn USING (instrument))" + columns("instrument failed filled units_traded", "mean_vs_mid_pips mean_extra_pips total_extra_pips total_extra_gbp mean_spread_pips median_delay_s", "o", 4)), 4)
R.add("x04_latest_orders", lambda k, d: latest_orders(practice_orders(k, d)), sql("forecasts", _PO + ", la AS (SELECT * FROM po ORDER BY ts DESC, tag DESC LIMIT 200), o AS (SELECT la.tag, la.ts, la.units, la.status, am.vs_mid_pips, am.extra_pips, am.spread_pips FROM la LEFT JOIN am USING (tag))" + columns("tag ts units status", "vs_mid_pips extra_pips spread_pips", "o", 4)), 4)

# Macro views and agreement ---------------------------------------------------------------------

#: How long a macro view holds.
HORIZONS = {"immediate": 1.0, "hours": 0.7, "days": 0.4, "weeks": 0.2}


def macro_views(articles: DataFrame) -> DataFrame:
    """Articles with an analysis: bias, confidence, surprise and horizon, by integer arithmetic on the id."""
    e = F.col("doc_id")
    names = F.array(*(F.lit(h) for h in HORIZONS))
    return articles.select("doc_id", "published_at", ((F.pmod(e * 13, F.lit(21)) - 10) / 10.0).alias("bias"), (F.pmod(e * 17, F.lit(11)) / 10.0).alias("confidence"), (F.pmod(e * 7, F.lit(9)) / 8.0).alias("surprise"), F.get(names, F.pmod(e, F.lit(4)).cast("int")).alias("horizon"))


def macro_signal(rows: DataFrame, views: DataFrame, hours: int = 6, decay: float = 0.8) -> DataFrame:
    """Macro signal of every bar time: views of the last hours weighed by confidence x decay^hours; zeros where there are none."""
    rows, w = settled(rows.select("instrument", "ts")), F.coalesce("confidence", F.lit(0.0))
    span = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in HORIZONS.items() for x in kv)), F.coalesce("horizon", F.lit("hours"))), F.lit(0.5))
    weighed = {"_w": w, "_b": w * F.coalesce("bias", F.lit(0.0)), "_s": w * F.coalesce("surprise", F.lit(0.0)), "_h": w * span}
    seen = window_totals(rows, views, hours, decay, weighed, {"_n": F.lit(1)}, {"_c": w}).where("_w >= 1e-8")
    bias = F.round(F.col("_b") / F.col("_w"), 9)
    signal = F.when(F.abs(bias) > 0.1, F.greatest(F.lit(-1), F.least(F.lit(1), F.bround(bias * 2).cast("int")))).otherwise(0)
    out = seen.select("ts", signal.alias("macro_signal"), F.col("_c").alias("confidence"), (F.col("_s") / F.col("_w")).alias("surprise"), (F.col("_h") / F.col("_w")).alias("horizon"), F.col("_n").alias("events"))
    return rows.join(out, "ts", "left").na.fill(0.0, ["confidence", "surprise", "horizon"]).na.fill(0, ["macro_signal", "events"])


R.add("n11_macro_signal", lambda k, d: macro_signal(forecasts(k, d), macro_views(distinct_news(news(k, d)))), sql("count_bars,news", """, dn AS (SELECT * FROM news QUALIFY row_number() OVER (PARTITION BY text_hash ORDER BY published_at, doc_id) = 1)
, mv AS (SELECT published_at, (doc_id * 13 % 21 - 10) / 10.0 AS bias, doc_id * 17 % 11 / 10.0 AS conf, doc_id * 7 % 9 / 8.0 AS surp, [1.0, 0.7, 0.4, 0.2][doc_id % 4 + 1] AS hor FROM dn), tb AS (SELECT DISTINCT ts FROM count_bars)
, j AS (SELECT tb.ts, mv.*, CAST(conf AS DOUBLE) * power(0.8, (epoch(tb.ts) - epoch(published_at)) / 3600) AS w FROM tb JOIN mv ON published_at <= tb.ts AND published_at > tb.ts - INTERVAL 6 HOUR)
, s AS (SELECT ts, round(sum(w * bias) / sum(w), 9) AS b, sum(w * surp) / sum(w) AS surprise, sum(w * hor) / sum(w) AS horizon, max(conf) AS confidence, count(*) AS events, CASE WHEN abs(b) > 0.1 THEN greatest(-1, least(1, CAST(round_even(b * 2, 0) AS INTEGER))) ELSE 0 END AS macro_signal FROM j GROUP BY ts HAVING sum(w) >= 1e-8)
, o AS (SELECT b.instrument, b.ts, coalesce(macro_signal, 0) AS macro_signal, coalesce(events, 0) AS events, CAST(coalesce(confidence, 0) AS DOUBLE) AS confidence, coalesce(surprise, 0) AS surprise, coalesce(horizon, 0) AS horizon FROM count_bars AS b LEFT JOIN s USING (ts))""" + columns("instrument ts macro_signal events", "confidence surprise horizon", "o")))
R.add("n14_price_text_agreement", lambda k, d: composite(second_model(forecasts(k, d))).select("event_id", ((F.col("c_signal") == F.col("signal")) & (F.col("c_signal") != 0)).alias("agrees")), sql("forecasts", _C + " SELECT event_id, c_signal = signal AND c_signal <> 0 AS agrees FROM cp"))


def macro_present(rows: DataFrame, observed: DataFrame, last: int = 2_000) -> DataFrame:
    """Whether each series has a value on any of the last ``last`` bars of each instrument."""
    ends = rows.groupBy("instrument").agg(F.max("rn").alias("_end"))
    late = rows.join(ends, "instrument").where(F.col("rn") > F.col("_end") - last).select("instrument", "ts")
    return observed.join(late, ["instrument", "ts"]).groupBy("instrument", "series").agg(F.max(F.col("value").isNotNull()).alias("present"), F.count("*").alias("bars"))


R.add("q08_macro_present", lambda k, d: macro_present(bars(k, d), as_of(bars(k, d), macro_obs(k, d).transform(availability), ["value"])), sql("bars,macro_obs", _DER + ", s AS (SELECT DISTINCT series FROM der), l AS (SELECT instrument, ts, series FROM (SELECT *, max(rn) OVER (PARTITION BY instrument) AS z FROM bars), s WHERE rn > z - 2000), p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series, available_at ORDER BY date DESC) AS k FROM der) WHERE k = 1) SELECT l.instrument, l.series, bool_or(p.value IS NOT NULL) AS present, count(*) AS bars FROM l ASOF LEFT JOIN p ON l.series = p.series AND l.ts >= p.available_at GROUP BY ALL"))

# Feature table -----------------------------------------------------------------------------------

#: The feature queries whose columns the table has, beside macro columns and the cross pair.
PARTS = ("f01_f02_returns", "f03_f04_moving_averages", "f05_f06_ema_macd", "f07_adx", "f08_rsi", "f09_f11_oscillators", "f12_f17_volatility", "f16_atr", "f18_f20_volume", "f21_candle_shape", "f22_calendar", "f25_quoted_spread")
MACRO = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "plain", "5-LOW": "low"}


def feature_table(rows: DataFrame, obs: DataFrame, other: str = "N") -> DataFrame:
    """All features of every bar: own ones, macro values and z-scores by publication time, and the cross pair with ``other``.

    Own features run through blocks with halos one after the other; macro and cross columns are joined
    by instrument and time. Bars and observations are read many times, so they are computed once first.
    """
    rows, obs = settled(rows), settled(obs)
    d = rows
    for build in (f.returns, f.moving_averages, f.oscillators, f.volatility, f.volume, f.candle_shape, f.calendar, f.quoted_spread):
        d = build(d)
    for build in (f.moving_exponentials, f.directional_index, f.relative_strength, f.average_range):  # blocks of exponential means are short
        d = build(d)
    known = as_of(rows, obs, ["value", "zscore"])
    wide = known.groupBy("instrument", "ts").agg(*(F.max(F.when(F.col("series") == s, F.col(c))).alias(f"macro_{n}_{c}") for s, n in MACRO.items() for c in ("value", "zscore")))
    cross = f.cross_pair(rows.where(F.col("instrument") != other), rows.where(F.col("instrument") == other)).select("instrument", "ts", "cross_corr_20", "cross_spread", "cross_spread_z")
    return d.join(wide, ["instrument", "ts"], "left").join(cross, ["instrument", "ts"], "left")


_OWN = [c for p in PARTS for c in COLUMNS[p]]
_WIDE = [f"macro_{n}_{c}" for n in MACRO.values() for c in ("value", "zscore")]
_FT = (
    f"SELECT * FROM ({FEATURE_SQL[PARTS[0]]})" + "".join(f" JOIN ({FEATURE_SQL[p]}) USING (instrument, ts)" for p in PARTS[1:])
    + " LEFT JOIN (SELECT instrument, ts, " + ", ".join(f"max(CASE WHEN series = '{s}' THEN round({c}, 6) END) AS macro_{n}_{c}" for s, n in MACRO.items() for c in ("value", "zscore")) + f" FROM ({MARKET_SQL['m04_as_of_join']}) GROUP BY ALL) USING (instrument, ts)"
    + f" LEFT JOIN ({FEATURE_SQL['f24_cross_pair']}) USING (instrument, ts)"
)


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table of the daily bars."""
    obs = six(derived(availability(macro_obs(spark, sf_dir))))
    rows = numbered(settled(daily_bars(spark, sf_dir)), KEYS, ["ts"], "year")
    return feature_table(rows, obs).select("instrument", "ts", *_OWN, *_WIDE, *COLUMNS["f24_cross_pair"])


R.add("f26_feature_table", assembled, _FT)

# Regime filter -----------------------------------------------------------------------------------


def forward_filter(rows: DataFrame, states: DataFrame, moves: DataFrame, block: int = BLOCK) -> DataFrame:
    """P(state | bars up to t) of (instrument, rn, ts, x): the forward recursion, in two levels of blocks.

    ``states`` has (instrument, state, mean, vol) of Gaussian emissions, ``moves`` (instrument, before,
    state, p). A step is a linear map of the vector of states, so a block is the product of its maps; the
    maps of blocks, one small matrix each, are multiplied in order per instrument, and every block is
    filtered from the vector that it begins with. Probabilities start even.
    """
    n = 4
    level = states.groupBy("instrument").agg(F.map_from_entries(F.collect_list(F.struct("state", F.struct("mean", "vol")))).alias("emit"))
    table = moves.groupBy("instrument").agg(F.map_from_entries(F.collect_list(F.struct((F.col("before") * n + F.col("state")).cast("int"), "p"))).alias("trans"))
    d = settled(rows.select("instrument", "rn", "ts", "x").join(level, "instrument").join(table, "instrument").withColumn("block", F.floor((F.col("rn") - 1) / block)))

    def maps(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        frame = frame.sort_values("rn")
        emit, trans = frame["emit"].iloc[0], frame["trans"].iloc[0]
        a = np.array([[trans.get(i * n + j, 1e-300) for j in range(n)] for i in range(n)])
        x = frame["x"].to_numpy(float)[:, None]
        mean, vol = (np.array([emit[s][k] if s in emit else d for s in range(n)], float) for k, d in (("mean", 0.0), ("vol", 1.0)))
        log = -0.5 * ((x - mean) / vol) ** 2 - np.log(vol)
        return a, np.exp(log - log.max(axis=1, keepdims=True))

    def product(frame: pd.DataFrame) -> pd.DataFrame:
        a, e = maps(frame)
        m = np.eye(n)
        for t in range(len(e)):
            step = np.diag(e[t]) if frame["rn"].min() == 1 and t == 0 else a * e[t]
            m = m @ step
            m /= m.max()
        return pd.DataFrame({"instrument": [frame["instrument"].iloc[0]], "block": [frame["block"].iloc[0]], "m": [m.ravel().tolist()]})

    def begin(frame: pd.DataFrame) -> pd.DataFrame:
        v, out = np.full(n, 1 / n), []
        for r in frame.sort_values("block").itertuples():
            out.append((r.instrument, r.block, v.tolist()))
            v = v @ np.array(r.m).reshape(n, n)
            v = v / v.sum()
        return pd.DataFrame(out, columns=["instrument", "block", "v"])

    def filtered(frame: pd.DataFrame) -> pd.DataFrame:
        a, e = maps(frame)
        frame = frame.sort_values("rn")
        v, out = np.array(frame["v"].iloc[0], float), np.empty((len(e), n))
        for t in range(len(e)):
            v = (v if frame["rn"].iloc[0] == 1 and t == 0 else v @ a) * e[t]
            v = v / v.sum()
            out[t] = v
        return pd.concat([frame[["instrument", "rn", "ts"]].reset_index(drop=True), pd.DataFrame(out, columns=[f"p{i}" for i in range(n)])], axis=1)

    products = d.groupBy("instrument", "block").applyInPandas(product, "instrument string, block long, m array<double>")
    starts = products.groupBy("instrument").applyInPandas(begin, "instrument string, block long, v array<double>")
    return d.join(starts, ["instrument", "block"]).groupBy("instrument", "block").applyInPandas(filtered, "instrument string, rn long, ts timestamp, " + ", ".join(f"p{i} double" for i in range(n)))


def regime_model(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Emissions and smoothed transitions of rows that have a state (``regime``) and a value ``x``."""
    states = rows.groupBy("instrument", F.col("regime").alias("state")).agg(F.avg("x").alias("mean"), F.greatest(F.stddev_pop("x"), F.lit(1e-9)).alias("vol"))
    pairs = with_halo(rows, KEYS, 1, lambda d, w: d.withColumn("before", w.lag("regime"))).where("before is not null").groupBy("instrument", "before", F.col("regime").alias("state")).agg(F.count("*").alias("k"))
    grid = rows.select("instrument").distinct().select("instrument", F.explode(F.array(*(F.lit(i) for i in range(4)))).alias("before")).select("*", F.explode(F.array(*(F.lit(i) for i in range(4)))).alias("state"))
    counted = grid.join(pairs, ["instrument", "before", "state"], "left").withColumn("k", F.coalesce("k", F.lit(0)) + 1)
    return states, counted.select("instrument", "before", "state", (F.col("k") / F.sum("k").over(Window.partitionBy("instrument", "before"))).alias("p"))


def filtered_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered regime probabilities of count bars, with a model of the named states."""
    rows = with_halo(forecasts(spark, sf_dir), KEYS, 1, lambda d, w: d.withColumn("x", F.coalesce(F.log(F.col("close") / w.lag("close")), F.lit(0.0))))
    rows = settled(rows.select("instrument", "rn", "ts", "x", "regime"))
    return forward_filter(rows, *regime_model(rows))


R.add("g02_forward_filter", filtered_regimes)


def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed transition probabilities of the regimes."""
    rows = forecasts(spark, sf_dir).select("instrument", "rn", "regime", F.lit(0.0).alias("x"))
    return regime_model(rows)[1]


R.add("g01_transition_matrix", transition_matrix, sql("forecasts", f", a AS (SELECT instrument, regime, lag(regime) OVER {N} AS before FROM forecasts), c AS (SELECT instrument, before, regime AS state, count(*) AS k FROM a WHERE before IS NOT NULL GROUP BY ALL), g AS (SELECT i.instrument, b.x AS before, s.x AS state FROM (SELECT DISTINCT instrument FROM forecasts) AS i, (SELECT unnest([0, 1, 2, 3]) AS x) AS b, (SELECT unnest([0, 1, 2, 3]) AS x) AS s), o AS (SELECT g.*, (coalesce(k, 0) + 1.0) / sum(coalesce(k, 0) + 1) OVER (PARTITION BY g.instrument, g.before) AS p FROM g LEFT JOIN c ON c.instrument = g.instrument AND c.before = g.before AND c.state = g.state)" + columns("instrument before state", "p", "o")))


def surrogate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest that imitates the decisions: importance of every input, and the share of decisions it repeats."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    inputs = ["signal", "confidence", "p50", "regime", "b_signal", "b_confidence", "weight"]
    rows = settled(VectorAssembler(inputCols=inputs, outputCol="x").transform(decisions(spark, sf_dir).withColumn("y", (F.col("d_signal") + 1).cast("double"))).select("x", "y"))
    fitted = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=30, maxDepth=6, seed=5).fit(rows)
    fidelity = fitted.transform(rows).agg(F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("fidelity"))
    table = spark.createDataFrame([(n, float(v)) for n, v in zip(inputs, fitted.featureImportances.toArray(), strict=True)], "feature string, importance double")
    return table.join(F.broadcast(fidelity))


R.add("x11_surrogate", surrogate)
QUERIES, ORACLE_SQL = R.queries, R.sql
