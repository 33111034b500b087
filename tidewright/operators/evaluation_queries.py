"""Queries of strategies (P), evaluation (E) and the flagship, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import QUANTILE_EDGE, QUANTILE_MIDDLE, QUANTILE_TAIL, numbered
from ..plans.registry import Registry, columns
from ..sources.views import bars, count_bars, forecasts, sql
from . import evaluation as e
from . import strategies as s

R = Registry()
WI = "(PARTITION BY instrument ORDER BY rn{})"
N = WI.format("")


def _w(n: int) -> str:
    return WI.format(f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW")


def _full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {_w(n)} = {n} THEN {agg}({x}) OVER {_w(n)} END"


RULES_SQL = f""", q AS (SELECT *, close / lag(close) OVER {N} - 1 AS r, {_full('avg', 'close', 20)} AS m20, {_full('avg', 'close', 200)} AS m200, {_full('stddev_samp', 'close', 20)} AS sd FROM bars)
, q2 AS (SELECT *, round(close - m20, 9) AS away, sign(round(close - m20, 9)) AS side, {_full('avg', 'r', 3)} AS r3 FROM q)
, q3 AS (SELECT *, lag(side) OVER {N} AS before FROM q2)
, q4 AS (SELECT *, CASE WHEN side * before < 0 THEN 0.0 WHEN away > round(2 * sd, 9) THEN -1.0 WHEN away < -round(2 * sd, 9) THEN 1.0 END AS event FROM q3)
, wide AS (SELECT instrument, ts, rn, close, 1.0 AS buy_hold, CASE WHEN m200 IS NULL THEN 0.0 WHEN round(m20 - m200, 9) > 0 THEN 1.0 ELSE -1.0 END AS sma_cross, coalesce(-sign(round(r3, 12)), 0.0) AS contrarian,
  coalesce(last_value(event IGNORE NULLS) OVER {N}, 0.0) AS bollinger FROM q4)
, positions AS (SELECT instrument, ts, rn, close, strategy, CAST(pos AS DOUBLE) AS pos, date_trunc('month', ts) AS split FROM (UNPIVOT wide ON buy_hold, sma_cross, contrarian, bollinger INTO NAME strategy VALUE pos))"""
WS = "(PARTITION BY strategy, instrument, split ORDER BY ts)"
SCORED_SQL = RULES_SQL + f"""
, flat AS (SELECT * REPLACE (CASE WHEN lead(ts) OVER {WS} IS NULL THEN 0 ELSE pos END AS pos) FROM positions)
, scored AS (SELECT *, lag(pos, 1, 0) OVER {WS} AS held, coalesce(ln(close / lag(close) OVER {WS}), 0) AS r_log, held * coalesce(close - lag(close) OVER {WS}, 0) / 0.0001 AS pnl_pips, abs(pos - held) AS turnover FROM flat)"""
TRADES_SQL = SCORED_SQL + f"""
, sides AS (SELECT *, sign(held) AS side FROM scored), starts AS (SELECT *, CASE WHEN side = lag(side) OVER {WS} THEN 0 ELSE 1 END AS start FROM sides)
, runs AS (SELECT *, sum(start) OVER {WS} AS run FROM starts)
, trades AS (SELECT strategy, instrument, split, run, CAST(max(side) AS DOUBLE) AS direction, sum(pnl_pips) AS gross_pips, count(*) AS n_bars, avg(abs(held)) AS size, min(ts) AS opened, max(ts) AS closed FROM runs WHERE held <> 0 GROUP BY ALL)"""
COSTED_SQL = TRADES_SQL + """
, costs(cost, cost_pips) AS (VALUES ('gross', 0.0), ('spread', 0.8), ('spread_plus', 1.5))
, priced AS (SELECT *, held * r_log - turnover * (cost_pips / 2) * 0.0001 / close AS net FROM scored, costs)"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of all rules, with calendar months as splits."""
    return s.long_positions(s.rule_positions(bars(spark, sf_dir))).withColumn("split", F.date_trunc("month", "ts"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored bars of all rules."""
    return e.simulate(positions(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does Bollinger reversion survive its costs? One row per instrument and cost."""
    return e.summarise(e.simulate(positions(spark, sf_dir).where("strategy = 'bollinger'")))


R.add("p01_p05_rule_positions", lambda k, d: positions(k, d).drop("close"), sql("bars", RULES_SQL + columns("strategy instrument ts rn split", "pos", "positions")))
R.add(
    "p02_seeded_random",
    lambda k, d: bars(k, d).select("instrument", "ts", s.seeded_sign(F.col("instrument"), F.col("ts"), seed=7).alias("pos")),
)
R.add("e01_simulate", lambda k, d: scored(k, d).select("strategy", "instrument", "ts", "split", "held", "r_log", "pnl_pips", "turnover"), sql("bars", SCORED_SQL + columns("strategy instrument ts split", "held r_log pnl_pips turnover", "scored")))
R.add("e02_trades", lambda k, d: e.trades(scored(k, d)).drop("run"), sql("bars", TRADES_SQL + columns("strategy instrument split opened closed n_bars", "direction gross_pips size", "trades")))
R.add("e03_net_returns", lambda k, d: e.costed(scored(k, d)).select("strategy", "instrument", "ts", "cost", e.net_log().alias("net")), sql("bars", COSTED_SQL + columns("strategy instrument ts cost", "net", "priced", 9)), 9)
R.add("e04_daily_returns", lambda k, d: e.daily_returns(scored(k, d)), sql("bars", COSTED_SQL + ", daily AS (SELECT strategy, instrument, cost, CAST(ts AS DATE) AS day, sum(net) AS net FROM priced GROUP BY ALL)" + columns("strategy instrument cost day", "net", "daily", 9)), 9)


def _summary_sql(more: str = "") -> str:
    k = f"strategy, instrument, {more}cost"
    return COSTED_SQL + f"""
, t AS (SELECT {k}, count(*) AS n, sum(gross_pips) AS gross, avg(CASE WHEN gross_pips - cost_pips * size > 0 THEN 1.0 ELSE 0 END) AS win_rate FROM trades, costs GROUP BY ALL)
, b AS (SELECT {k}, avg(CASE WHEN held <> 0 THEN 1.0 ELSE 0 END) AS exposure, avg(CASE WHEN held <> 0 AND r_log <> 0 THEN CASE WHEN sign(held) = sign(r_log) THEN 1.0 ELSE 0 END END) AS hit_directional,
  avg(CASE WHEN held <> 0 THEN CASE WHEN held * r_log > 0 THEN 1.0 ELSE 0 END END) AS hit_msc_style, sum(turnover * cost_pips / 2) AS paid FROM priced GROUP BY ALL)
, dd AS (SELECT {k}, CAST(ts AS DATE) AS day, sum(net) AS net FROM priced GROUP BY ALL), d AS (SELECT {k}, count(*) AS days, avg(net) AS mean, stddev_samp(net) AS std FROM dd GROUP BY ALL)
, eq AS (SELECT *, exp(sum(net) OVER (PARTITION BY {k} ORDER BY rn)) AS equity FROM priced), pk AS (SELECT *, max(equity) OVER (PARTITION BY {k} ORDER BY rn) AS peak FROM eq)
, w AS (SELECT {k}, max(1 - equity / peak) AS max_drawdown FROM pk GROUP BY ALL)
, summary AS (SELECT b.*, CAST(coalesce(n, 0) AS BIGINT) AS n_trades, n_trades / greatest(days, 1) AS trades_per_day, win_rate, coalesce(gross, 0) - paid AS net_pips_total, net_pips_total / nullif(n_trades, 0) AS net_pips_per_trade,
  CASE WHEN std > 0 THEN mean / std * sqrt(252) ELSE 0 END AS sharpe, max_drawdown FROM b LEFT JOIN t USING ({k}) JOIN d USING ({k}) JOIN w USING ({k}))"""


_SUM = "exposure trades_per_day hit_directional hit_msc_style win_rate net_pips_total net_pips_per_trade sharpe max_drawdown"
R.add("e05_e06_summary", lambda k, d: e.summarise(scored(k, d)), sql("bars", _summary_sql() + columns("strategy instrument cost n_trades", _SUM, "summary")))
R.add("p05_flagship_bollinger", flagship, sql("bars", _summary_sql() + columns("strategy instrument cost n_trades", _SUM, "summary WHERE strategy = 'bollinger'")))


def profitable_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits with a profit out of all splits, as text."""
    net = e.costed(scored(spark, sf_dir)).groupBy("strategy", "instrument", "cost", "split").agg(F.sum(e.net_log()).alias("net"))
    return net.groupBy("strategy", "instrument", "cost").agg(F.concat_ws("/", F.sum(F.when(F.round("net", 12) > 0, 1).otherwise(0)), F.count("*")).alias("profitable"))


R.add("e07_profitable_splits", profitable_splits, sql("bars", COSTED_SQL + ", m AS (SELECT strategy, instrument, cost, split, sum(net) AS net FROM priced GROUP BY ALL) SELECT strategy, instrument, cost, concat(CAST(sum(CASE WHEN round(net, 12) > 0 THEN 1 ELSE 0 END) AS BIGINT), '/', count(*)) AS profitable FROM m GROUP BY ALL"))


def across_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and spread of split results: returns, best and worst split, total return."""
    net = e.costed(scored(spark, sf_dir)).groupBy("strategy", "instrument", "cost", "split").agg(F.sum(e.net_log()).alias("net"))
    return net.groupBy("strategy", "instrument", "cost").agg(
        F.avg("net").alias("mean_net"), F.stddev_pop("net").alias("std_pop"), F.stddev_samp("net").alias("std_samp"), F.min("net").alias("worst"), F.max("net").alias("best"), F.expm1(F.sum("net")).alias("total_return")
    )


R.add("e08_across_splits", across_splits, sql("bars", COSTED_SQL + ", m AS (SELECT strategy, instrument, cost, split, sum(net) AS net FROM priced GROUP BY ALL), a AS (SELECT strategy, instrument, cost, avg(net) AS mean_net, stddev_pop(net) AS std_pop, stddev_samp(net) AS std_samp, min(net) AS worst, max(net) AS best, exp(sum(net)) - 1 AS total_return FROM m GROUP BY ALL)" + columns("strategy instrument cost", "mean_net std_pop std_samp worst best total_return", "a")))

_RET = f", r AS (SELECT *, close / lag(close) OVER {N} - 1 AS r FROM bars), rr AS (SELECT * FROM r WHERE r IS NOT NULL)"


def bar_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple bar returns."""
    from .features import KEYS
    from ..functions.windows import with_halo

    return with_halo(bars(spark, sf_dir), KEYS, 1, lambda d, w: d.withColumn("r", F.col("close") / w.lag("close") - 1)).where("r is not null")


R.add(
    "e09_deflated_sharpe", lambda k, d: e.deflated_sharpe(bar_returns(k, d), ["instrument"], "r"),
    sql("bars", _RET + """, m AS (SELECT instrument, CAST(count(r) AS DOUBLE) AS n, avg(r) / stddev_samp(r) AS sr, skewness(r) AS skew, kurtosis(r) AS kurt FROM rr GROUP BY ALL)
, f AS (SELECT *, sr * sqrt(1 - skew * sr + ((kurt - 1) / 4) * sr * sr) / sqrt((1 + sr * sr / 2 * (1 - skew * skew + kurt / 4)) / (n - 1)) AS z FROM m)
, x AS (SELECT *, abs(z / sqrt(2)) AS a, 1 / (1 + 0.3275911 * a) AS t FROM f)
, o AS (SELECT *, 0.5 * (1 + sign(z) * (1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-a * a))) AS dsr FROM x)""" + columns("instrument", "sr skew kurt dsr", "o")),
)


def daily_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily net returns at the spread's cost of all rules."""
    return e.daily_returns(scored(spark, sf_dir)).where("cost = 'spread'")


def _poly_sql(coefficients: tuple, x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _quantile_sql(p: str) -> str:
    """The normal quantile of ``p``, above one half."""
    middle = f"({p} - 0.5) * {_poly_sql(QUANTILE_MIDDLE[0], f'pow({p} - 0.5, 2)')} / {_poly_sql(QUANTILE_MIDDLE[1], f'pow({p} - 0.5, 2)')}"
    t = f"sqrt(-2 * ln(1 - {p}))"
    return f"CASE WHEN {p} <= {1 - QUANTILE_EDGE} THEN {middle} ELSE -({_poly_sql(QUANTILE_TAIL[0], t)} / {_poly_sql(QUANTILE_TAIL[1], t)}) END"


R.add(
    "e09_best_of_strategies", lambda k, d: e.deflated_sharpe(daily_net(k, d), ["strategy", "instrument"], "net", ["instrument"]),
    sql("bars", COSTED_SQL + f""", dn AS (SELECT strategy, instrument, CAST(ts AS DATE) AS day, sum(net) AS r FROM priced WHERE cost = 'spread' GROUP BY ALL)
, m AS (SELECT strategy, instrument, CAST(count(r) AS DOUBLE) AS n, avg(r) / stddev_samp(r) AS sr, skewness(r) AS skew, kurtosis(r) AS kurt FROM dn GROUP BY ALL), mn AS (SELECT *, count(*) OVER (PARTITION BY instrument) AS n_strategies FROM m)
, f AS (SELECT *, CASE WHEN n_strategies > 1 THEN (1 - {e.EULER}) * ({_quantile_sql('(1 - 1.0::DOUBLE / n_strategies)')}) + {e.EULER} * ({_quantile_sql('(1 - 1.0::DOUBLE / (n_strategies * exp(1.0::DOUBLE)))')}) ELSE 0 END AS expected_best FROM mn)
, g AS (SELECT *, (sr - expected_best) * sqrt(1 - skew * sr + ((kurt - 1) / 4) * sr * sr) / sqrt((1 + sr * sr / 2 * (1 - skew * skew + kurt / 4)) / (n - 1)) AS z FROM f)
, x AS (SELECT *, abs(z / sqrt(2)) AS a, 1 / (1 + 0.3275911 * a) AS t FROM g)
, o AS (SELECT *, 0.5 * (1 + sign(z) * (1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-a * a))) AS dsr FROM x)""" + columns("strategy instrument n_strategies", "sr skew kurt expected_best dsr", "o")),
)
R.add(
    "e10_return_metrics", lambda k, d: e.return_metrics(bar_returns(k, d), ["instrument"], "r"),
    sql("bars", _RET + """, one AS (SELECT instrument, sum(ln(1 + r)) AS logs, count(r) AS n, avg(r) AS mean, stddev_samp(r) AS std, stddev_samp(CASE WHEN r < 0 THEN r END) AS down FROM rr GROUP BY ALL)
, eq AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY instrument ORDER BY rn)) AS equity FROM rr), pk AS (SELECT *, max(equity) OVER (PARTITION BY instrument ORDER BY rn) AS peak FROM eq)
, w AS (SELECT instrument, -max(1 - equity / peak) AS max_drawdown FROM pk GROUP BY ALL)
, o AS (SELECT instrument, exp(logs) - 1 AS total_return, exp(logs * 252 / n) - 1 AS annualised_return, std * sqrt(252) AS volatility, CASE WHEN std > 0 THEN mean / std * sqrt(252) ELSE 0 END AS sharpe,
  CASE WHEN down IS NOT NULL THEN mean / nullif(down, 0) * sqrt(252) ELSE 0 END AS sortino, max_drawdown, CASE WHEN max_drawdown < 0 THEN -annualised_return / max_drawdown ELSE 0 END AS calmar FROM one JOIN w USING (instrument))""" + columns("instrument", "total_return annualised_return volatility sharpe sortino max_drawdown calmar", "o")),
)
R.add(
    "e11_tail_risk", lambda k, d: e.tail_risk(bar_returns(k, d), ["instrument"], "r"),
    sql("bars", _RET + """, c AS (SELECT instrument, quantile_cont(r, 0.05) AS cut FROM rr GROUP BY ALL)
, o AS (SELECT instrument, -any_value(cut) AS var_95, -avg(CASE WHEN round(r, 12) <= round(cut, 12) THEN r END) AS cvar_95, sum(greatest(r, 0)) / nullif(-sum(least(r, 0)), 0) AS profit_factor, avg(CASE WHEN r <> 0 THEN CASE WHEN r > 0 THEN 1.0 ELSE 0 END END) AS hit_ratio FROM rr JOIN c USING (instrument) GROUP BY ALL)""" + columns("instrument", "var_95 cvar_95 profit_factor hit_ratio", "o")),
)
_MOM = SCORED_SQL + ", gd AS (SELECT strategy, instrument, CAST(ts AS DATE) AS day, sum(held * r_log) AS g, sum(turnover / 2 * 0.0001 / close) AS d FROM scored GROUP BY ALL), m AS (SELECT strategy, instrument, count(*) AS n, sum(g) AS sg, sum(d) AS sd, sum(g * g) AS sgg, sum(d * d) AS sdd, sum(g * d) AS sgd FROM gd GROUP BY ALL)"
R.add("e16_moments", lambda k, d: e.moments(scored(k, d)), sql("bars", _MOM + columns("strategy instrument n", "sg sd sgg sdd sgd", "m", 9)), 9)
R.add(
    "e16_sharpe_at_cost", lambda k, d: e.sharpe_at(e.moments(scored(k, d))),
    sql("bars", COSTED_SQL + """, dd AS (SELECT strategy, instrument, cost, CAST(ts AS DATE) AS day, sum(net) AS net FROM priced GROUP BY ALL)
, o AS (SELECT strategy, instrument, cost, CASE WHEN stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) * sqrt(252) ELSE 0 END AS sharpe FROM dd GROUP BY ALL)""" + columns("strategy instrument cost", "sharpe", "o")),
)


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net log returns per week (ending on Friday), equity in money, and the rank of each strategy by final balance."""
    d = e.daily_returns(scored(spark, sf_dir)).where("cost = 'spread'")
    week = F.next_day(F.date_sub("day", 1), "FRI")
    return d.groupBy("strategy", "instrument", week.alias("week")).agg(F.sum("net").alias("net"))


R.add("e17_weekly", weekly, sql("bars", COSTED_SQL + ", o AS (SELECT strategy, instrument, CAST(CAST(ts AS DATE) + CAST((5 - isodow(ts) + 7) % 7 AS INTEGER) AS DATE) AS week, sum(net) AS net FROM priced WHERE cost = 'spread' GROUP BY ALL)" + columns("strategy instrument week", "net", "o", 9)), 9)


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final balance of 10,000 per strategy, instrument and cost, ranked inside each cost."""
    total = e.costed(scored(spark, sf_dir)).groupBy("strategy", "instrument", "cost").agg(F.sum(e.net_log()).alias("net"))
    order = Window.partitionBy("cost").orderBy(F.desc(F.round("balance", 3)), "strategy", "instrument")
    return total.withColumn("balance", 10_000 * F.exp("net")).withColumn("place", F.row_number().over(order)).drop("net")


R.add("e17_leaderboard", leaderboard, sql("bars", COSTED_SQL + ", t AS (SELECT strategy, instrument, cost, 10000 * exp(sum(net)) AS balance FROM priced GROUP BY ALL), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY cost ORDER BY round(balance, 3) DESC, strategy, instrument) AS INTEGER) AS place FROM t)" + columns("strategy instrument cost place", "balance", "o", 3)), 3)
_DAILY = COSTED_SQL + ", daily AS (SELECT strategy, instrument, CAST(ts AS DATE) AS day, sum(net) AS net FROM priced WHERE cost = 'spread' GROUP BY ALL)"
R.add(
    "e18_expectation_bands", lambda k, d: e.bands(e.daily_returns(scored(k, d)).where("cost = 'spread'").drop("cost"), ["strategy", "instrument"]),
    sql("bars", _DAILY + """, c AS (SELECT *, sum(net) OVER (PARTITION BY strategy, instrument ORDER BY day) AS total, row_number() OVER (PARTITION BY strategy, instrument ORDER BY day) AS i FROM daily)
, g AS (SELECT unnest(generate_series(1, 65)) AS n), p AS (SELECT c.strategy, c.instrument, g.n, 10000 * (exp(c.total - coalesce(b.total, 0)) - 1) AS x FROM c JOIN g ON c.i >= g.n LEFT JOIN c AS b ON b.strategy = c.strategy AND b.instrument = c.instrument AND b.i = c.i - g.n)
, o AS (SELECT strategy, instrument, n, quantile_cont(x, 0.05) AS p05, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, quantile_cont(x, 0.95) AS p95 FROM p GROUP BY ALL)""" + columns("strategy instrument n", "p05 p25 p50 p75 p95", "o", 5)), 5,
)


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t value of the daily differences of each rule to buy and hold."""
    d = e.daily_returns(scored(spark, sf_dir)).where("cost = 'spread'").drop("cost")
    base = d.where("strategy = 'buy_hold'").select("instrument", "day", F.col("net").alias("base"))
    diff = d.where("strategy <> 'buy_hold'").join(base, ["instrument", "day"]).withColumn("x", F.col("net") - F.col("base"))
    return diff.groupBy("strategy", "instrument").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), (F.avg("x") / F.nullif(F.stddev_samp("x") / F.sqrt(F.count("*")), F.lit(0.0))).alias("t"))


R.add("e20_paired_designs", paired, sql("bars", _DAILY + ", o AS (SELECT a.strategy, a.instrument, count(*) AS n, avg(a.net - b.net) AS mean, avg(a.net - b.net) / nullif(stddev_samp(a.net - b.net) / sqrt(count(*)), 0) AS t FROM daily AS a JOIN daily AS b ON a.instrument = b.instrument AND a.day = b.day AND b.strategy = 'buy_hold' WHERE a.strategy <> 'buy_hold' GROUP BY ALL)" + columns("strategy instrument n", "mean t", "o")))


def band_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance path by day, with its running place between the final quantiles, per strategy and instrument."""
    d = e.daily_returns(scored(spark, sf_dir)).where("cost = 'spread'").drop("cost").withColumn("ts", F.col("day").cast("timestamp"))
    path = e.drawdowns(numbered(d, ["strategy", "instrument"], ["ts"], "year"), ["strategy", "instrument"], "net").withColumn("balance", 10_000 * F.col("equity"))
    quant = path.groupBy("strategy", "instrument").agg(F.percentile("balance", F.array(*(F.lit(q) for q in (0.05, 0.25, 0.75, 0.95)))).alias("q"))
    b, q = F.round("balance", 6), [F.round(F.col("q")[i], 6) for i in range(4)]
    place = F.when(b < q[0], "below").when(b < q[1], "low").when(b <= q[2], "middle").when(b <= q[3], "high").otherwise("above")
    return path.join(quant, ["strategy", "instrument"]).select("strategy", "instrument", "day", "balance", place.alias("place"))


R.add("e19_band_places", band_places, sql("bars", _DAILY + """, p AS (SELECT *, 10000 * exp(sum(net) OVER (PARTITION BY strategy, instrument ORDER BY day)) AS balance FROM daily)
, qq AS (SELECT strategy, instrument, quantile_cont(balance, [0.05, 0.25, 0.75, 0.95]) AS q FROM p GROUP BY ALL)
, o AS (SELECT p.*, CASE WHEN round(balance, 6) < round(q[1], 6) THEN 'below' WHEN round(balance, 6) < round(q[2], 6) THEN 'low' WHEN round(balance, 6) <= round(q[3], 6) THEN 'middle' WHEN round(balance, 6) <= round(q[4], 6) THEN 'high' ELSE 'above' END AS place FROM p JOIN qq USING (strategy, instrument))""" + columns("strategy instrument day place", "balance", "o", 2)), 2)

#: Least confidence by regime.
_GATES = {0: 0.52, 1: 0.52, 2: 0.55, 3: 0.62}


def scorable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of the bars that models can score: those with a range."""
    return forecasts(spark, sf_dir).where("high > low")


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the forecast variants on every bar."""
    return s.gated_positions(scorable(spark, sf_dir), count_bars(spark, sf_dir), _GATES).select("instrument", "ts", "rn", "ungated", "gated", "top")


def _on_bars_sql(names: str, carry: int = 1) -> str:
    """SQL of decisions ``names`` of table dcs on the bars between the first and the last of them."""
    held = ", ".join(f"CAST(coalesce(last_value({n} IGNORE NULLS) OVER c, 0) AS DOUBLE) AS {n}" for n in names.split())
    return f""", span AS (SELECT instrument, min(ts) AS a, max(ts) AS z FROM dcs GROUP BY ALL), onb AS (SELECT b.instrument, b.ts, b.rn, {", ".join(f"dcs.{n}" for n in names.split())} FROM count_bars AS b JOIN span USING (instrument) LEFT JOIN dcs ON dcs.instrument = b.instrument AND dcs.ts = b.ts WHERE b.ts BETWEEN a AND z)
, o AS (SELECT instrument, ts, rn, {held} FROM onb WINDOW c AS (PARTITION BY instrument ORDER BY rn ROWS BETWEEN {carry} PRECEDING AND CURRENT ROW))"""


R.add(
    "p08_forecast_variants", gated,
    sql("forecasts", """, a AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts) AS k FROM forecasts WHERE high > low)
, b AS (SELECT *, CASE WHEN count(confidence) OVER w >= 20 THEN quantile_cont(confidence, 0.9) OVER w END AS bar FROM a WINDOW w AS (PARTITION BY instrument ORDER BY k ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
, dcs AS (SELECT *, signal AS ungated, CASE WHEN round(confidence, 9) >= [0.52, 0.52, 0.55, 0.62][regime + 1] THEN signal ELSE 0 END AS gated, CASE WHEN round(confidence, 9) >= round(bar, 9) THEN signal ELSE 0 END AS top FROM b)""" + _on_bars_sql("ungated gated top") + columns("instrument ts rn", "ungated gated top", "o")),
)
R.add(
    "p10_risk_variants", lambda k, d: s.risk_positions(scorable(k, d), count_bars(k, d)),
    sql("forecasts", """, dcs AS (SELECT *, CASE WHEN confidence >= 0.52 AND NOT (regime = 3 AND confidence < 0.62) THEN signal ELSE 0 END AS risk_gates, CASE WHEN round(signal * p50 * close / 0.0001, 9) >= 1.3 THEN signal ELSE 0 END AS cost_filter FROM forecasts WHERE high > low)"""
    + _on_bars_sql("risk_gates cost_filter") + columns("instrument ts rn", "risk_gates cost_filter", "o")),
)
R.add(
    "p06_lag_regression", lambda k, d: s.lag_regression(bars(k, d)).select("instrument", "ts", "block", "pos", F.round("weight", 9).alias("weight")),
    sql("bars", f""", x AS (SELECT *, ln(close / lag(close) OVER {N}) AS x, year(ts) AS block FROM bars), y AS (SELECT *, lead(x) OVER {N} AS y, max(rn) OVER (PARTITION BY instrument, block) AS last FROM x)
, sums AS (SELECT instrument, block, sum(x * y) FILTER (rn < last AND x IS NOT NULL AND y IS NOT NULL) AS xy, sum(x * x) FILTER (rn < last AND x IS NOT NULL AND y IS NOT NULL) AS xx FROM y GROUP BY ALL)
, ws AS (SELECT instrument, block, sum(xy) OVER v / nullif(sum(xx) OVER v, 0) AS weight FROM sums WINDOW v AS (PARTITION BY instrument ORDER BY block RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING))
, o AS (SELECT *, CAST(coalesce(sign(weight * coalesce(x, 0)), 0) AS DOUBLE) AS pos FROM y JOIN ws USING (instrument, block))""" + columns("instrument ts", "pos weight", "o").replace("SELECT instrument, ts", "SELECT instrument, ts, CAST(block AS INTEGER) AS block")),
)


def momentum_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate of following the sign of the mean of the last six returns."""
    from .features import KEYS
    from ..functions.windows import with_halo

    def build(d: DataFrame, w) -> DataFrame:
        d = d.withColumn("r", F.log(F.col("close") / w.lag("close")))
        return d.withColumn("pos", F.signum(F.round(w.full(F.avg, "r", 6), 12))).withColumn("next", F.lead("r").over(w.base))

    d = with_halo(bars(spark, sf_dir), KEYS, 7, build, ahead=1).where("pos <> 0 and next <> 0")
    return d.groupBy("instrument").agg(F.count("*").alias("n"), F.avg(F.when(F.col("pos") == F.signum("next"), 1.0).otherwise(0.0)).alias("hit"))


R.add("p12_momentum_oracle", momentum_oracle, sql("bars", f", a AS (SELECT *, ln(close / lag(close) OVER {N}) AS r FROM bars), b AS (SELECT *, sign(round({_full('avg', 'r', 6)}, 12)) AS pos, lead(r) OVER {N} AS next FROM a), o AS (SELECT instrument, count(*) AS n, avg(CASE WHEN pos = sign(next) THEN 1.0 ELSE 0 END) AS hit FROM b WHERE pos <> 0 AND next <> 0 GROUP BY ALL)" + columns("instrument n", "hit", "o")))


def rounded_replica(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-lag regression hit rate on raw and on four-digit prices, with the share of flat bars."""
    from .features import KEYS
    from ..functions.windows import with_halo

    both = bars(spark, sf_dir).withColumn("v", F.explode(F.array(F.struct(F.lit("raw").alias("prices"), F.col("close").alias("p")), F.struct(F.lit("rounded").alias("prices"), F.round("close", 4).alias("p"))))).select("instrument", "rn", "v.*")
    keys = [*KEYS, "prices"]

    def build(d: DataFrame, w) -> DataFrame:
        d = d.withColumn("x", F.log(F.col("p") / w.lag("p")))
        return d.withColumn("y", F.lead("x").over(w.base))

    d = with_halo(both, keys, 2, build, ahead=1).where("x is not null and y is not null")
    weights = d.groupBy(*keys).agg((F.sum(F.col("x") * F.col("y")) / F.nullif(F.sum(F.col("x") * F.col("x")), F.lit(0.0))).alias("weight"))
    hit = F.when(F.round(F.col("weight") * F.col("x") * F.col("y"), 15) > 0, 1.0).otherwise(0.0)
    return d.join(weights, keys).groupBy(*keys).agg(F.first("weight").alias("weight"), F.avg(hit).alias("hit"), F.avg(F.when(F.round("y", 12) == 0, 1.0).otherwise(0.0)).alias("flat_share"))


R.add(
    "p14_rounded_replica", rounded_replica,
    sql("bars", """, v AS (SELECT instrument, rn, 'raw' AS prices, close AS p FROM bars UNION ALL SELECT instrument, rn, 'rounded', round(close, 4) FROM bars)
, a AS (SELECT *, ln(p / lag(p) OVER (PARTITION BY instrument, prices ORDER BY rn)) AS x FROM v), b AS (SELECT * FROM (SELECT *, lead(x) OVER (PARTITION BY instrument, prices ORDER BY rn) AS y FROM a) WHERE x IS NOT NULL AND y IS NOT NULL)
, g AS (SELECT instrument, prices, sum(x * y) / nullif(sum(x * x), 0) AS weight FROM b GROUP BY ALL)
, o AS (SELECT instrument, prices, any_value(weight) AS weight, avg(CASE WHEN round(weight * x * y, 15) > 0 THEN 1.0 ELSE 0 END) AS hit, avg(CASE WHEN round(y, 12) = 0 THEN 1.0 ELSE 0 END) AS flat_share FROM b JOIN g USING (instrument, prices) GROUP BY ALL)""" + columns("instrument prices", "weight hit flat_share", "o")),
)
QUERIES, ORACLE_SQL = R.queries, R.sql
