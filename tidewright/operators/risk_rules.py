"""Risk rules in full: costs over a series, Kelly sizes with drawdowns, stops with regime defaults, edge against cost, fill reports, tuned weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import running_sum, with_halo
from ..plans.registry import Registry, columns
from ..sources.views import forecasts, sql
from . import decisions as dec
from . import evaluation as e
from .decisions import _CASE, _COST, _FILLS, _F, _SESSION, KELLY_CAPS, MAX_POSITION, MODEL_WEIGHTS, N, PIP, by, decisions, full, session, sized
from .features import KEYS, flag
from .split_metrics import MOVE, direction

R = Registry()
#: Units of a series' trades; drawdown from which sizes shrink and at which they are least; least edge in pips.
UNITS, DERISK, STOP, LEAST_EDGE = 10_000, 0.08, 0.15, 0.5
#: Fixed values by regime: stops in pips and reward for risk, where no range is forecast.
STOPS, REWARDS = {0: 12.0, 1: 12.0, 2: 8.0, 3: 5.0}, {0: 2.0, 1: 2.0, 2: 1.5, 3: 1.5}


def costed_series(df: DataFrame, units: int = UNITS) -> DataFrame:
    """Costs of a series of signals by session: (is_trade, gross, total_cost, net, drag, cum_gross, cum_net) per row.

    Costs are paid where the signal changes, on the change; a reversal has twice the turnover of an entry.
    """
    d = with_halo(df, KEYS, 1, lambda x, w: x.withColumn("_before", F.coalesce(w.lag("signal"), F.lit(0))).withColumn("_r", F.coalesce(F.log(F.col("close") / w.lag("close")), F.lit(0.0))))
    moved = F.col("signal") - F.col("_before")
    d = dec.cost(d.withColumn("session", session(F.col("ts"))), units * moved, F.col("close"))
    d = d.withColumn("is_trade", moved != 0).withColumn("gross", F.col("_r") * F.col("signal")).withColumn("total_cost", F.when(moved != 0, F.col("total_cost")).otherwise(0.0)).withColumn("net", F.col("gross") - F.col("total_cost"))
    d = running_sum(d.withColumn("_g", F.log1p("gross")).withColumn("_n", F.log1p("net")), KEYS, {"drag": "total_cost", "_cg": "_g", "_cn": "_n"})
    return d.withColumn("cum_gross", F.expm1("_cg")).withColumn("cum_net", F.expm1("_cn"))


_SERIES_SQL = f""", a AS (SELECT *, coalesce(lag(signal) OVER {N}, 0) AS b, coalesce(ln(close / lag(close) OVER {N}), 0) AS r, signal - b AS moved, close AS price, {_SESSION} AS session FROM forecasts)
, c AS (SELECT event_id, instrument, rn, moved, r * signal AS gross, {_COST.replace('abs(units)', f'abs({UNITS} * moved)').replace('session, greatest', 'greatest', 1)} FROM a)
, n AS (SELECT *, CASE WHEN moved <> 0 THEN total_cost ELSE 0 END AS tc, gross - tc AS net FROM c), o AS (SELECT event_id, moved <> 0 AS is_trade, gross, tc AS total_cost, net, sum(tc) OVER {N} AS drag, exp(sum(ln(1 + gross)) OVER {N}) - 1 AS cum_gross, exp(sum(ln(1 + net)) OVER {N}) - 1 AS cum_net FROM n)"""
_COLS = "gross total_cost net drag cum_gross cum_net"
R.add("c03_costed_series", lambda k, d: costed_series(forecasts(k, d)).select("event_id", "is_trade", *_COLS.split()), sql("forecasts", _SERIES_SQL + columns("event_id is_trade", _COLS, "o", 8)), 8)


def sized_by_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kelly sizes of the forecasts under the drawdown of their own signals so far."""
    d = with_halo(forecasts(spark, sf_dir), KEYS, 1, lambda x, w: x.withColumn("_ret", F.coalesce(w.lag("signal") * F.log(F.col("close") / w.lag("close")), F.lit(0.0))))
    return dec.kelly(e.drawdowns(d, KEYS, "_ret").withColumn("drawdown", F.round("drawdown", 9)), drawdown="drawdown")


R.add(
    "c06_kelly_drawdown", lambda k, d: sized_by_drawdown(k, d).select("event_id", "reason", "units", "drawdown"),
    sql("forecasts", f""", a AS (SELECT *, coalesce(lag(signal) OVER {N}, 0) * ln(close / lag(close) OVER {N}) AS r FROM forecasts), q AS (SELECT *, sum(coalesce(r, 0)) OVER {N} AS eq FROM a), p AS (SELECT *, round(1 - exp(eq - max(eq) OVER {N}), 9) AS drawdown FROM q)
, m AS (SELECT *, CASE WHEN count(r) OVER v >= 5 THEN avg(r) OVER v ELSE (confidence - 0.5) * 0.001 END - 0.00008 AS net, CASE WHEN count(r) OVER v >= 5 THEN var_samp(r) OVER v + 1e-10 ELSE 1e-6 END AS s2, net / s2 AS kelly FROM p WINDOW v AS (PARTITION BY instrument ORDER BY rn ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
, r AS (SELECT *, CASE WHEN signal = 0 THEN 'flat_signal' WHEN round(net, 12) <= 0 THEN 'negative_edge_after_costs' WHEN drawdown > {DERISK} THEN 'drawdown_derisking' WHEN confidence < 0.55 THEN 'low_confidence' WHEN round(kelly, 9) <= {_CASE(KELLY_CAPS)} THEN 'within_kelly' ELSE 'regime_cap' END AS reason,
  least(kelly, {_CASE(KELLY_CAPS)}) * CASE WHEN confidence < 0.55 THEN least(0.5 + confidence, 1.0) ELSE 1.0 END * CASE WHEN drawdown > {DERISK} THEN greatest(0.1, 1 - (drawdown - {DERISK}) / ({STOP} - {DERISK})) ELSE 1.0 END AS share FROM m)
, o AS (SELECT event_id, reason, drawdown, CAST(CASE WHEN reason IN ('flat_signal', 'negative_edge_after_costs') THEN 0 ELSE greatest(1000, least(floor(round(300000.0 * share / close, 6)), least(floor(300000.0 * {_CASE(MAX_POSITION)} / close), 100000))) * signal END AS BIGINT) AS units FROM r)""" + columns("event_id reason units", "drawdown", "o")),
)


def stops(df: DataFrame) -> DataFrame:
    """(event_id, stop_pips, target_pips) to a tenth of a pip: from the forecast range, at least 3 pips and one and a half for the target; by regime where no range is forecast; scaled by confidence."""
    known = (F.col("p10") != 0) & (F.col("p90") != 0)
    low, high = F.abs("p10") * F.col("close") / PIP, F.abs("p90") * F.col("close") / PIP
    long = F.col("signal") == 1
    stop = F.when(known, F.greatest(F.when(long, low).otherwise(high), F.lit(3.0))).otherwise(by(STOPS, F.col("regime")))
    d = df.withColumn("_stop", stop)
    target = F.when(known, F.greatest(F.when(long, high).otherwise(low), 1.5 * F.col("_stop"))).otherwise(F.col("_stop") * by(REWARDS, F.col("regime")))
    scale = 0.8 + 0.4 * F.col("confidence")
    return d.select("event_id", F.round(F.round(F.col("_stop") * scale, 9), 1).alias("stop_pips"), F.round(F.round(target * scale, 9), 1).alias("target_pips"))


some_ranges = lambda k, d: forecasts(k, d).withColumn("p10", F.when(F.pmod("event_id", F.lit(7)) == 0, 0.0).otherwise(F.col("p10")))
R.add(
    "c08_stops_by_regime", lambda k, d: stops(some_ranges(k, d)),
    sql("forecasts", f""", a AS (SELECT *, event_id % 7 <> 0 AND p10 <> 0 AND p90 <> 0 AS known, abs(p10) * close / 0.0001 AS lo, abs(p90) * close / 0.0001 AS hi, CASE WHEN known THEN greatest(CASE WHEN signal = 1 THEN lo ELSE hi END, 3.0) ELSE {_CASE(STOPS)} END AS sl, CASE WHEN known THEN greatest(CASE WHEN signal = 1 THEN hi ELSE lo END, 1.5 * sl) ELSE sl * {_CASE(REWARDS)} END AS tp FROM forecasts)
, o AS (SELECT event_id, round(round(sl * (0.8 + 0.4 * confidence), 9), 1) AS stop_pips, round(round(tp * (0.8 + 0.4 * confidence), 9), 1) AS target_pips FROM a)""" + columns("event_id", "stop_pips target_pips", "o", 1)), 1,
)


def edge_filter(df: DataFrame, units: int = UNITS) -> DataFrame:
    """(event_id, edge_pips, breakeven_pips, enough): the forecast in the direction of the trade against the cost of its session and a least edge."""
    d = dec.cost(df.withColumn("session", session(F.col("ts"))), units * F.col("signal"), F.col("close"))
    edge = F.col("signal") * F.col("p50") * F.col("close") / PIP
    return d.select("event_id", edge.alias("edge_pips"), "breakeven_pips", (F.round(edge, 9) >= F.round(LEAST_EDGE + F.col("breakeven_pips"), 9)).alias("enough"))


R.add("c09_edge_against_cost", lambda k, d: edge_filter(forecasts(k, d)), sql("forecasts", f""", a AS (SELECT *, close AS price, {_SESSION} AS session FROM forecasts), c AS (SELECT event_id, signal * p50 * close / 0.0001 AS edge_pips, {_COST.replace('abs(units)', f'abs({UNITS} * signal)').replace('session, greatest', 'greatest', 1)} FROM a)
, o AS (SELECT event_id, edge_pips, breakeven_pips, round(edge_pips, 9) >= round({LEAST_EDGE} + breakeven_pips, 9) AS enough FROM c)""" + columns("event_id enough", "edge_pips breakeven_pips", "o", 8)), 8)


def fill_report(df: DataFrame) -> DataFrame:
    """One row per executed fill: units, fill and signal price, slippage, cost of its session in pips, kind of order."""
    d = dec.cost(dec.fills(df).where("executed"), F.col("units"), F.col("close"))
    return d.select("event_id", "instrument", F.col("units").cast("long").alias("units"), "fill_price", F.col("close").alias("signal_price"), "slippage_pips", F.col("breakeven_pips").alias("cost_pips"), "order_type", "fill_quality")


def fill_summary(df: DataFrame) -> DataFrame:
    """Per instrument: bars and executed ones, mean slippage and quality of these, and the share of market orders among them."""
    d, done = dec.fills(df), F.col("executed")
    return d.groupBy("instrument").agg(
        F.count("*").alias("n_total"), F.count(F.when(done, 1)).alias("n_executed"), F.avg(F.when(done, F.col("slippage_pips"))).alias("slippage_pips"), F.avg(F.when(done, F.col("fill_quality"))).alias("fill_quality"),
        F.avg(F.when(done, flag(F.col("order_type") == "MARKET").cast("double"))).alias("market_share"),
    )


_COSTED_FILLS = _FILLS + f", fc AS (SELECT event_id, instrument, CAST(units AS BIGINT) AS units, fill_price, close AS signal_price, slippage_pips, order_type, fill_quality, {_COST.replace('/ price', '/ close').replace('* price', '* close').replace('session, greatest', 'greatest', 1)} FROM fl WHERE executed)"
R.add("c14_fill_report", lambda k, d: fill_report(sized(decisions(k, d))), sql("forecasts", _COSTED_FILLS + ", o AS (SELECT *, breakeven_pips AS cost_pips FROM fc)" + columns("event_id instrument units order_type", "fill_price signal_price slippage_pips cost_pips fill_quality", "o", 7)), 7)
R.add("c14_fill_totals", lambda k, d: fill_summary(sized(decisions(k, d))), sql("forecasts", _FILLS + ", o AS (SELECT instrument, count(*) AS n_total, count(*) FILTER (executed) AS n_executed, avg(slippage_pips) FILTER (executed) AS slippage_pips, avg(fill_quality) FILTER (executed) AS fill_quality, avg(CASE WHEN order_type = 'MARKET' THEN 1.0 ELSE 0 END) FILTER (executed) AS market_share FROM fl GROUP BY ALL)" + columns("instrument n_total n_executed", "slippage_pips fill_quality market_share", "o", 5)), 5)

# Tuned weights (N5) -------------------------------------------------------------------------------

#: Grid of weights in order, rows and active rows that a choice needs, score that acts.
ALPHAS, ROWS, ACTIVE, ACTS = (0.2, 0.35, 0.5, 0.65, 0.8), 20, 5, 0.1


def tuned_weights(df: DataFrame, keys: list[str], horizon: int = 3) -> DataFrame:
    """(keys, regime, n, weight, other): the first weight of the grid with the best hit rate of active rows, in each regime.

    A regime with fewer than ROWS rows has its default; one in which no weight has ACTIVE active rows gets
    one half.
    """
    d = with_halo(df, KEYS, 1, lambda x, w: x.withColumn("_move", F.log(F.lead("close", horizon).over(w.base) / F.col("close"))), ahead=horizon).where("_move is not null").withColumn("truth", direction(F.col("_move"), MOVE))
    groups = [*keys, "regime"]
    grid = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).alias("alpha")) for i, a in enumerate(ALPHAS))))
    each = d.select(*groups, "signal", "b_signal", "truth", grid.alias("g")).withColumn("score", F.round(F.col("g.alpha") * F.col("signal") + (1 - F.col("g.alpha")) * F.col("b_signal"), 9))
    call = F.when(F.col("score") > ACTS, 1).when(F.col("score") < -ACTS, -1).otherwise(0)
    each = each.withColumn("call", call)
    rates = each.groupBy(*groups, "g.i", "g.alpha").agg(F.count("*").alias("n"), F.count(F.when(F.col("call") != 0, 1)).alias("active"), F.avg(F.when(F.col("call") != 0, flag(F.col("call") == F.col("truth")).cast("double"))).alias("hit"))
    best = rates.groupBy(*groups).agg(F.max("n").alias("n"), F.max(F.when(F.col("active") >= ACTIVE, F.struct(F.round("hit", 9).alias("h"), (-F.col("i")).alias("i"), "alpha"))).alias("b"))
    weight = F.when(F.col("n") < ROWS, by(MODEL_WEIGHTS, F.col("regime"))).otherwise(F.coalesce("b.alpha", F.lit(0.5)))
    return best.select(*groups, "n", weight.alias("weight"), (1 - weight).alias("other"))


weekly_models = lambda k, d: full(k, d).withColumn("week", F.to_date(F.date_trunc("week", "ts")))
R.add(
    "n05_tuned_by_week", lambda k, d: tuned_weights(weekly_models(k, d), ["instrument", "week"]),
    sql("forecasts", _F + f""", tm AS (SELECT *, CAST(date_trunc('week', ts) AS DATE) AS week, ln(lead(close, 3) OVER {N} / close) AS move FROM f), tt AS (SELECT *, CASE WHEN round(move, 12) > {MOVE} THEN 1 WHEN round(move, 12) < -{MOVE} THEN -1 ELSE 0 END AS truth FROM tm WHERE move IS NOT NULL)
, tg AS (SELECT instrument, week, regime, truth, i, alpha, round(alpha * signal + (1 - alpha) * b_signal, 9) AS score, CASE WHEN score > {ACTS} THEN 1 WHEN score < -{ACTS} THEN -1 ELSE 0 END AS call FROM tt, (VALUES {', '.join(f'({i}, {a}::DOUBLE)' for i, a in enumerate(ALPHAS))}) AS x(i, alpha))
, tr AS (SELECT instrument, week, regime, i, alpha, count(*) AS n, count(*) FILTER (call <> 0) AS active, round(avg(CASE WHEN call = truth THEN 1.0 ELSE 0 END) FILTER (call <> 0), 9) AS hit FROM tg GROUP BY ALL)
, tb AS (SELECT instrument, week, regime, max(n) AS n, arg_max(alpha, (hit, -i)) FILTER (active >= {ACTIVE}) AS alpha FROM tr GROUP BY ALL), o AS (SELECT instrument, week, regime, n, CASE WHEN n < {ROWS} THEN {_CASE(MODEL_WEIGHTS)} ELSE coalesce(alpha, 0.5) END AS weight, 1 - weight AS other FROM tb)""" + columns("instrument week regime n", "weight other", "o")),
)
QUERIES, ORACLE_SQL = R.queries, R.sql
