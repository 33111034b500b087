"""Portfolio: candidates screened against quotes, ranked, and allocated under risk, class and currency limits."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.registry import Registry, columns
from ..sources.views import forecasts, sql, ticks

R = Registry()


@dataclass(frozen=True)
class Limits:
    """Limits of a portfolio, as shares of equity where not said otherwise."""

    positions: int = 3
    total_risk: float = 0.0100
    fx_risk: float = 0.0075
    metal_risk: float = 0.0025
    position_risk: float = 0.0025
    position_notional: float = 0.50
    net_currency: float = 0.50
    gross_currency: float = 1.00
    confidence: float = 0.55
    uncertainty: float = 0.45
    edge_bps: float = 1.0
    slippage_bps: float = 0.25
    quote_age: float = 3600.0


#: Class, base and quote currency, least and most units of the views' instruments.
SPECS = {
    "click": ("fx", "EUR", "USD", 1, 10_000_000), "error": ("fx", "GBP", "USD", 1, 10_000_000), "purchase": ("fx", "USD", "CHF", 1, 10_000_000),
    "signup": ("metal", "XAU", "USD", 1, 10_000), "view": ("fx", "AUD", "USD", 1, 10_000_000),
}


def screened(predictions: DataFrame, quotes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Predictions (as_of, now, instrument, ts, expires, ...) with the first reason against them, net edge, score and place.

    The newest prediction of an instrument counts. Rules in order: freshness, a quote that is there,
    tradeable and not older than allowed, a direction, confidence, uncertainty, an expected return in that
    direction, and an edge beyond spread, slippage on both sides and financing. Places follow the score.
    """
    newest = predictions.groupBy("as_of", "instrument").agg(F.max_by(F.struct(*(c for c in predictions.columns if c not in ("as_of", "instrument"))), F.struct("ts", "event_id")).alias("p")).select("as_of", "instrument", "p.*")
    d = newest.join(quotes.withColumn("quoted", F.lit(True)), ["as_of", "instrument"], "left")
    age = F.col("now").cast("double") - F.col("quote_ts").cast("double")
    mid = (F.col("bid") + F.col("ask")) / 2
    edge = F.col("signal") * F.col("p50")
    net = edge - ((F.col("ask") - F.col("bid")) / mid + 2 * limits.slippage_bps / 1e4 + F.col("financing"))
    rules = [
        ("stale_prediction", ~((F.col("ts") <= F.col("now")) & (F.col("now") < F.col("expires")))), ("missing_quote", F.col("quoted").isNull()), ("instrument_not_tradeable", ~F.col("tradeable")),
        ("stale_quote", (age < 0) | (age > limits.quote_age)), ("flat_prediction", F.col("signal") == 0), ("low_confidence", F.round("confidence", 9) < limits.confidence), ("high_uncertainty", F.round("uncertainty", 9) > limits.uncertainty),
        ("inconsistent_expected_return", F.round(edge, 9) <= 0), ("insufficient_net_edge", F.round(net * 1e4, 6) < limits.edge_bps),
    ]
    d = d.withColumn("mid", mid).withColumn("reason", F.coalesce(*(F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules)))
    d = d.withColumn("net_edge", F.when(F.col("reason").isNull(), net)).withColumn("score", F.col("net_edge") * F.col("confidence") * (1 - F.col("uncertainty")) / F.col("stop"))
    good = d.where("reason is null")
    place = good.withColumn("place", F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc(F.round("score", 9)), "instrument"))).select("as_of", "instrument", "place")
    return d.join(place, ["as_of", "instrument"], "left")


def allocated(candidates: DataFrame, equity: float = 10_000.0, limits: Limits = Limits()) -> DataFrame:
    """(as_of, instrument, units, notional, risk, outcome): candidates taken in turn while limits leave room.

    A position risks its share of equity, what is left of the total and of its class; its notional stays
    within the room of both of its currencies, net and gross. The candidates of one time, one per
    instrument at most, are a sorted array that is folded with the exposures so far.
    """
    spec = F.create_map(*(x for k, (kind, base, quote, least, most) in SPECS.items() for x in (F.lit(k), F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), F.lit(quote).alias("quote"), F.lit(least).alias("least"), F.lit(most).alias("most")))))
    rows = candidates.where("place is not null").withColumn("spec", F.element_at(spec, F.col("instrument")))
    one = F.struct("place", "instrument", F.col("signal").cast("double").alias("side"), "mid", "stop", "spec")
    sorted_ = rows.groupBy("as_of").agg(F.sort_array(F.collect_list(one)).alias("c"))
    done = "array<struct<instrument:string,units:double,notional:double,risk:double,outcome:string>>"
    zero, none = F.lit(0.0), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    start = F.struct(F.lit(0).alias("n"), zero.alias("total"), zero.alias("fx"), zero.alias("metal"), none.alias("net"), none.alias("gross"), F.array().cast(done).alias("out"))

    def moved(book: Column, key: Column, by: Column) -> Column:
        kept = F.map_filter(book, lambda k, v: k != key)
        return F.map_concat(kept, F.map_from_arrays(F.array(key), F.array(F.coalesce(F.try_element_at(book, key), F.lit(0.0)) + by)))

    def take(acc: Column, x: Column) -> Column:
        s, side = x["spec"], x["side"]
        metal = s["kind"] == "metal"
        room = F.when(metal, equity * limits.metal_risk - acc["metal"]).otherwise(equity * limits.fx_risk - acc["fx"])
        budget = F.least(F.lit(equity * limits.position_risk), F.lit(equity * limits.total_risk) - acc["total"], room)
        wanted = F.least(budget / x["stop"], F.lit(equity * limits.position_notional))
        rooms = []
        for key, sign in ((s["base"], side), (s["quote"], -side)):
            net, gross = F.coalesce(F.try_element_at(acc["net"], key), F.lit(0.0)), F.coalesce(F.try_element_at(acc["gross"], key), F.lit(0.0))
            rooms += [F.greatest(F.lit(0.0), equity * limits.gross_currency - gross), F.greatest(F.lit(0.0), F.when(sign > 0, equity * limits.net_currency - net).otherwise(equity * limits.net_currency + net))]
        allowed = F.least(wanted, *rooms)
        in_usd = s["quote"] == "USD"
        units = F.least(F.floor(F.round(F.when(in_usd, allowed / x["mid"]).otherwise(allowed) / s["least"], 6)) * s["least"], s["most"]).cast("double")
        notional = F.when(in_usd, units * x["mid"]).otherwise(units)
        risk = notional * x["stop"]

        def result(outcome: str, *values: Column) -> Column:
            u, m, r = values or (F.lit(0.0), F.lit(0.0), F.lit(0.0))
            return F.concat(acc["out"], F.array(F.struct(x["instrument"].alias("instrument"), u.alias("units"), m.alias("notional"), r.alias("risk"), F.lit(outcome).alias("outcome"))))

        def state(out: Column, n=0, r: Column = F.lit(0.0), net: Column | None = None, gross: Column | None = None) -> Column:
            fx, mt = F.when(metal, F.lit(0.0)).otherwise(r), F.when(metal, r).otherwise(F.lit(0.0))
            return F.struct((acc["n"] + n).alias("n"), (acc["total"] + r).alias("total"), (acc["fx"] + fx).alias("fx"), (acc["metal"] + mt).alias("metal"), (acc["net"] if net is None else net).alias("net"), (acc["gross"] if gross is None else gross).alias("gross"), out.alias("out"))

        net = moved(moved(acc["net"], s["base"], side * notional), s["quote"], -side * notional)
        gross = moved(moved(acc["gross"], s["base"], notional), s["quote"], notional)
        taken = state(result("taken", side * units, notional, risk), 1, risk, net, gross)
        return F.when(acc["n"] >= limits.positions, state(result("position_limit"))).when(F.round(budget, 9) <= 0, state(result("risk_budget_exhausted"))).when(units < s["least"], state(result("currency_exposure_limit"))).otherwise(taken)

    return sorted_.select("as_of", F.explode(F.aggregate("c", start, take)["out"]).alias("t")).select("as_of", "t.*")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts as predictions for the end of their day, with an uncertainty and a time to live of twelve hours."""
    day = F.date_trunc("day", "ts")
    return forecasts(spark, sf_dir).select(day.alias("as_of"), (day + F.expr("interval 1 day")).alias("now"), "instrument", "ts", (F.col("ts") + F.expr("interval 12 hours")).alias("expires"), "event_id", "signal", "p50", "confidence", (F.pmod(F.col("event_id") * 13, F.lit(60)) / 100.0).alias("uncertainty"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last tick of each day and instrument as a quote; those of the smallest size are gaps in trading."""
    last = ticks(spark, sf_dir).groupBy(F.date_trunc("day", "ts").alias("as_of"), "instrument").agg(F.max_by(F.struct("ts", "bid", "ask", "size", "tick_id"), F.struct("ts", "tick_id")).alias("q"))
    return last.select("as_of", "instrument", F.col("q.ts").alias("quote_ts"), "q.bid", "q.ask", (F.col("q.size") > 0).alias("tradeable"), (0.002 + F.pmod("q.tick_id", F.lit(5)) / 1000.0).alias("stop"), (F.pmod("q.tick_id", F.lit(3)) / 100_000.0).alias("financing"))


_SC = """, pr AS (SELECT date_trunc('day', ts) AS as_of, * FROM forecasts QUALIFY row_number() OVER (PARTITION BY date_trunc('day', ts), instrument ORDER BY ts DESC, event_id DESC) = 1)
, qu AS (SELECT date_trunc('day', ts) AS as_of, instrument, ts AS qts, bid, ask, size > 0 AS tradeable, 0.002 + (tick_id % 5) / 1000.0 AS stop, (tick_id % 3) / 100000.0 AS fin FROM ticks QUALIFY row_number() OVER (PARTITION BY date_trunc('day', ts), instrument ORDER BY ts DESC, tick_id DESC) = 1)
, jn AS (SELECT pr.as_of, pr.instrument, pr.ts, event_id, signal, p50, confidence, CAST((event_id * 13 % 60) / 100.0 AS DOUBLE) AS unc, qu.* EXCLUDE (as_of, instrument), pr.as_of + INTERVAL 1 DAY AS now FROM pr LEFT JOIN qu ON qu.as_of = pr.as_of AND qu.instrument = pr.instrument)
, ed AS (SELECT *, signal * p50 AS edge, edge - ((ask - bid) / ((bid + ask) / 2) + 0.00005 + fin) AS net, CASE WHEN NOT (now < ts + INTERVAL 12 HOUR) THEN 'stale_prediction' WHEN qts IS NULL THEN 'missing_quote' WHEN NOT tradeable THEN 'instrument_not_tradeable' WHEN epoch(now) - epoch(qts) > 3600 THEN 'stale_quote' WHEN signal = 0 THEN 'flat_prediction'
  WHEN round(confidence, 9) < 0.55 THEN 'low_confidence' WHEN round(unc, 9) > 0.45 THEN 'high_uncertainty' WHEN round(edge, 9) <= 0 THEN 'inconsistent_expected_return' WHEN round(net * 1e4, 6) < 1 THEN 'insufficient_net_edge' END AS reason FROM jn)
, sc AS (SELECT *, CASE WHEN reason IS NULL THEN net END AS net_edge, net_edge * confidence * (1 - unc) / CAST(stop AS DOUBLE) AS score FROM ed)
, rk AS (SELECT *, CASE WHEN reason IS NULL THEN CAST(row_number() OVER (PARTITION BY as_of, reason IS NULL ORDER BY round(score, 9) DESC, instrument) AS INTEGER) END AS place FROM sc)"""
R.add("t01_t02_screening", lambda k, d: screened(predictions(k, d), quotes(k, d)).select("as_of", "instrument", "event_id", "reason", "net_edge", "score", "place"), sql("forecasts", _SC + columns("as_of instrument event_id reason place", "net_edge score", "rk")))
R.add("t03_allocation", lambda k, d: allocated(screened(predictions(k, d), quotes(k, d))))


# Models per block ----------------------------------------------------------------------------------


def fit_window(lags: int):
    """A function of the rows of one window (``role`` train) and its tests (``role`` test) that fits both models and gives the positions of the tests."""
    names = [f"lag_{i}" for i in range(lags)]

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        known = frame[frame["role"] == "train"].sort_values("ts").iloc[:-1].dropna(subset=[*names, "next"])
        test = frame[frame["role"] == "test"].sort_values("ts")
        out = test[["instrument", "ts"]].assign(block=test["for"].astype("int32"), linear=0.0, logistic=-1.0)
        if len(known) < 2 * lags or not len(test):
            return out.assign(logistic=0.0)
        x, y, z = known[names].to_numpy(float), known["next"].to_numpy(float), test[names].fillna(0.0).to_numpy(float)
        out["linear"] = np.sign(z @ np.linalg.lstsq(x, y, rcond=None)[0])
        x, up = x[y != 0], (y[y != 0] > 0).astype(float)
        mean, std = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
        x, z = np.hstack([np.ones((len(x), 1)), (x - mean) / std]), np.hstack([np.ones((len(z), 1)), (z - mean) / std])
        w, penalty = np.zeros(lags + 1), np.diag([0.0, *[1.0] * lags])
        for _ in range(50):  # Newton's steps
            p = 1 / (1 + np.exp(-x @ w))
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty + 1e-12 * np.eye(lags + 1), x.T @ (up - p) - penalty @ w)
            w = w + step
            if np.abs(step).max() < 1e-10:
                break
        out["logistic"] = np.where(1 / (1 + np.exp(-z @ w)) > 0.5, 1.0, -1.0)
        return out

    return fit


def block_models(rows: DataFrame, lags: int = 5) -> DataFrame:
    """(instrument, ts, block, linear, logistic): positions of two models of the next return on its last ``lags`` ones.

    ``rows`` has instrument, ts, block, lag_0.. and next; a block is scored by models of the block before
    it, whose last row (its target lies outside) is left out. The linear one has no intercept; the logistic
    one, on standardised lags with a unit penalty, says +1 above one half, else -1, and leaves out rows
    that do not move. A block and the one before it are what one task holds. Missing lags count as 0.
    """
    names = [f"lag_{i}" for i in range(lags)]
    train = rows.withColumn("role", F.lit("train")).withColumn("for", F.col("block") + 1)
    both = train.unionByName(rows.withColumn("role", F.lit("test")).withColumn("for", F.col("block"))).select("instrument", "ts", "role", "for", "next", *names)

    return both.groupBy("instrument", "for").applyInPandas(fit_window(lags), "instrument string, ts timestamp, block int, linear double, logistic double")


def lagged_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log returns of the daily bars with their lags and the next one, in blocks of calendar years."""
    from ..functions.windows import with_halo
    from ..sources.views import bars
    from .features import KEYS

    def build(d: DataFrame, w) -> DataFrame:
        d = d.withColumn("r", F.log(F.col("close") / w.lag("close")))
        return d.select("*", *(F.lag("r", i).over(w.base).alias(f"lag_{i}") for i in range(5)), F.lead("r").over(w.base).alias("next"))

    return with_halo(bars(spark, sf_dir), KEYS, 7, build, ahead=1).withColumn("block", F.year("ts"))


R.add("p06_p07_block_models", lambda k, d: block_models(lagged_bars(k, d)))
QUERIES, ORACLE_SQL = R.queries, R.sql
