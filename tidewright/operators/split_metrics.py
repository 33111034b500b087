"""Evaluation per split in full: split rows and their aggregate, tails and regimes, signals, sentiment, weeks at any cost, and places in expectation bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import normal_cdf, running_sum, with_halo
from ..plans.registry import Registry, columns
from ..sources.views import forecasts, sql
from . import evaluation as e
from .decisions import _F, N, full
from .evaluation_queries import COSTED_SQL, _quantile_sql, _SUM, _summary_sql, scored
from .features import KEYS, flag

R = Registry()
SERIES = ["strategy", "instrument"]
#: Bars of a year (days times five-minute bars of a session), rows that a ratio needs, rows that a regime's ratio needs, move that counts, hit rate that signals are held against.
YEAR, LEAST, REGIME_ROWS, MOVE, BASELINE = 252 * 78, 10, 50, 0.0002, 0.3756
REGIMES = range(4)

R.add("e07_split_rows", lambda k, d: e.summarise(scored(k, d), ["split"]), sql("bars", _summary_sql("split, ") + columns("strategy instrument split cost n_trades", _SUM, "summary")))

# Split metrics (E11) and their aggregate (E8) -------------------------------------------------------


def split_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gross and net returns (at the spread's cost) of every rule and bar, in splits of a year, with the quarter as regime."""
    d = e.costed(scored(spark, sf_dir), {"spread": 0.8})
    return d.select(*SERIES, "rn", "held", F.date_trunc("year", "ts").alias("split"), (F.quarter("ts") - 1).alias("regime"), (F.col("held") * F.col("r_log")).alias("gross"), e.net_log().alias("net"))


def sharpe(c: Column, enough: Column) -> Column:
    """Annual Sharpe ratio of a column in a group; 0 with too few rows."""
    return F.when(enough, F.avg(c) / (F.stddev_samp(c) + 1e-10) * F.sqrt(F.lit(float(YEAR)))).otherwise(0.0)


def split_metrics(rows: DataFrame) -> DataFrame:
    """One row per series and split of (rn, held, regime, gross, net): ratios, drawdown, hits, profit factor, cost drag, tails, and the Sharpe ratio of each regime with over REGIME_ROWS bars.

    Flat bars count. A split is a bounded stretch of bars, of which the 5 % quantile is exact.
    """
    keys = [*SERIES, "split"]
    worst = e.drawdowns(rows, keys, "net", simple=True).groupBy(*keys).agg(F.max("drawdown").alias("max_drawdown"))
    cut = rows.groupBy(*keys).agg(F.percentile("net", F.lit(0.05)).alias("cut"))
    active, enough = F.col("held") != 0, F.count("*") > LEAST
    net, gross = F.col("net"), F.col("gross")
    of = lambda r: F.when(F.col("regime") == r, net)
    one = rows.join(cut, keys).groupBy(*keys).agg(
        F.count("*").alias("n_bars"), F.sum(flag(active)).cast("long").alias("n_trades"), sharpe(net, enough).alias("sharpe_net"), sharpe(gross, enough).alias("sharpe_gross"),
        F.when(enough, F.avg(net) / (F.coalesce(F.stddev_samp(F.when(net < 0, net)), F.lit(0.0)) + 1e-10) * F.sqrt(F.lit(float(YEAR)))).otherwise(0.0).alias("sortino_net"),
        F.expm1(F.sum(F.log1p(net))).alias("cum_return_net"), F.expm1(F.sum(F.log1p(gross))).alias("cum_return_gross"),
        F.coalesce(F.avg(F.when(active, flag(gross > 0).cast("double"))), F.lit(0.5)).alias("hit_ratio"), (F.sum(F.greatest(net, F.lit(0.0))) / (F.sum(F.greatest(-net, F.lit(0.0))) + 1e-10)).alias("profit_factor"),
        (-F.first("cut")).alias("var_95"), (-F.avg(F.when(F.round(net, 12) <= F.round("cut", 12), net))).alias("cvar_95"),
        *(F.when(F.count(of(r)) > REGIME_ROWS, F.avg(of(r)) / (F.stddev_samp(of(r)) + 1e-10) * F.sqrt(F.lit(float(YEAR)))).alias(f"sharpe_{r}") for r in REGIMES),
    )
    annual = F.pow(1 + F.col("cum_return_net"), YEAR / F.col("n_bars")) - 1
    drag = F.when(F.col("sharpe_gross") != 0, (F.col("sharpe_gross") - F.col("sharpe_net")) / F.sqrt(F.lit(float(YEAR)))).otherwise(0.0)
    out = one.join(worst, keys).withColumn("calmar", annual / F.greatest("max_drawdown", F.lit(0.001))).withColumn("cost_drag", drag)
    return out.withColumn("cost_per_trade", F.col("cost_drag") / F.greatest("n_trades", F.lit(1)))


_SPLIT = COSTED_SQL + f""", sr AS (SELECT strategy, instrument, rn, held, date_trunc('year', ts) AS split, quarter(ts) - 1 AS regime, held * r_log AS gross, net FROM priced WHERE cost = 'spread')
, ct AS (SELECT strategy, instrument, split, quantile_cont(net, 0.05) AS cut FROM sr GROUP BY ALL), eq AS (SELECT *, exp(sum(ln(1 + net)) OVER k) AS equity FROM sr WINDOW k AS (PARTITION BY strategy, instrument, split ORDER BY rn))
, pk AS (SELECT *, max(equity) OVER (PARTITION BY strategy, instrument, split ORDER BY rn) AS peak FROM eq), ws AS (SELECT strategy, instrument, split, max(1 - equity / peak) AS max_drawdown FROM pk GROUP BY ALL)
, so AS (SELECT strategy, instrument, split, count(*) AS n_bars, CAST(count(*) FILTER (held <> 0) AS BIGINT) AS n_trades, CASE WHEN count(*) > {LEAST} THEN avg(net) / (stddev_samp(net) + 1e-10) * sqrt({YEAR}) ELSE 0 END AS sharpe_net,
  CASE WHEN count(*) > {LEAST} THEN avg(gross) / (stddev_samp(gross) + 1e-10) * sqrt({YEAR}) ELSE 0 END AS sharpe_gross, CASE WHEN count(*) > {LEAST} THEN avg(net) / (coalesce(stddev_samp(net) FILTER (net < 0), 0) + 1e-10) * sqrt({YEAR}) ELSE 0 END AS sortino_net,
  exp(sum(ln(1 + net))) - 1 AS cum_return_net, exp(sum(ln(1 + gross))) - 1 AS cum_return_gross, coalesce(avg(CASE WHEN gross > 0 THEN 1.0 ELSE 0 END) FILTER (held <> 0), 0.5) AS hit_ratio, sum(greatest(net, 0)) / (sum(greatest(-net, 0)) + 1e-10) AS profit_factor,
  -any_value(cut) AS var_95, -avg(net) FILTER (round(net, 12) <= round(cut, 12)) AS cvar_95, {', '.join(f'CASE WHEN count(*) FILTER (regime = {r}) > {REGIME_ROWS} THEN avg(net) FILTER (regime = {r}) / (stddev_samp(net) FILTER (regime = {r}) + 1e-10) * sqrt({YEAR}) END AS sharpe_{r}' for r in REGIMES)}
  FROM sr JOIN ct USING (strategy, instrument, split) GROUP BY ALL)
, sm AS (SELECT *, (pow(1 + cum_return_net, {YEAR} / n_bars) - 1) / greatest(max_drawdown, 0.001) AS calmar, CASE WHEN sharpe_gross <> 0 THEN (sharpe_gross - sharpe_net) / sqrt({YEAR}) ELSE 0 END AS cost_drag, cost_drag / greatest(n_trades, 1) AS cost_per_trade FROM so JOIN ws USING (strategy, instrument, split))"""
_METRICS = "sharpe_net sharpe_gross sortino_net cum_return_net cum_return_gross hit_ratio profit_factor var_95 cvar_95 sharpe_0 sharpe_1 sharpe_2 sharpe_3 max_drawdown cost_drag cost_per_trade"
# annual rates of daily bars are huge, so Calmar ratios are compared by their logarithms
R.add("e11_split_metrics", lambda k, d: split_metrics(split_returns(k, d)).withColumn("calmar", F.signum("calmar") * F.log1p(F.abs("calmar"))), sql("bars", _SPLIT + columns("strategy instrument split n_bars n_trades", _METRICS + " calmar", "sm").replace("round(calmar, 6)", "round(sign(calmar) * ln(1 + abs(calmar)), 6)")))


def across(rows: DataFrame) -> DataFrame:
    """One row per series from its splits: means and deviations (population) of hits and Sharpe ratios, worst and mean drawdown, total return, and the deflated Sharpe ratio among as many trials as splits."""
    splits = split_metrics(rows).groupBy(*SERIES).agg(
        F.count("*").alias("n_splits"), F.avg("hit_ratio").alias("hit_mean"), F.stddev_pop("hit_ratio").alias("hit_std"), F.avg("sharpe_net").alias("sharpe_mean"), F.stddev_pop("sharpe_net").alias("sharpe_std"), F.stddev_samp("sharpe_net").alias("sharpe_sample_std"),
        F.max("max_drawdown").alias("worst_drawdown"), F.avg("max_drawdown").alias("mean_drawdown"),
    )
    m = rows.groupBy(*SERIES).agg(F.count("net").alias("n"), F.expm1(F.sum(F.log1p("net"))).alias("total_return"), F.skewness("net").alias("g1"), F.kurtosis("net").alias("g2"))
    n, sr = F.col("n").cast("double"), F.col("sharpe_mean")
    d = splits.join(m, SERIES).withColumn("skew", F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).withColumn("kurt", ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3)))
    inner = 1 - F.col("skew") * sr + ((F.col("kurt") - 1) / 4) * sr * sr
    wide = (1 + (sr * sr) / 2 * (1 - F.col("skew") * F.col("skew") + F.col("kurt") / 4)) / (n - 1)
    known = (inner > 0) & (wide > 0)
    z = (sr - e.best_of(F.col("n_splits"))) * F.sqrt(F.when(known, inner)) / F.sqrt(F.when(known, wide))
    return d.select(*SERIES, "n_splits", "hit_mean", "hit_std", "sharpe_mean", "sharpe_std", "sharpe_sample_std", "worst_drawdown", "mean_drawdown", "total_return", normal_cdf(z).alias("deflated_sharpe"))


R.add(
    "e08_split_aggregate", lambda k, d: across(split_returns(k, d)),
    sql("bars", _SPLIT + f""", ag AS (SELECT strategy, instrument, count(*) AS n_splits, avg(hit_ratio) AS hit_mean, stddev_pop(hit_ratio) AS hit_std, avg(sharpe_net) AS sharpe_mean, stddev_pop(sharpe_net) AS sharpe_std, stddev_samp(sharpe_net) AS sharpe_sample_std, max(max_drawdown) AS worst_drawdown, avg(max_drawdown) AS mean_drawdown FROM sm GROUP BY ALL)
, mo AS (SELECT strategy, instrument, CAST(count(*) AS DOUBLE) AS n, exp(sum(ln(1 + net))) - 1 AS total_return, skewness(net) AS skew, kurtosis(net) AS kurt FROM sr GROUP BY ALL)
, dz AS (SELECT *, 1 - skew * sharpe_mean + ((kurt - 1) / 4) * sharpe_mean * sharpe_mean AS a1, (1 + sharpe_mean * sharpe_mean / 2 * (1 - skew * skew + kurt / 4)) / (n - 1) AS b1, CASE WHEN n_splits > 1 THEN (1 - {e.EULER}) * ({_quantile_sql('(1 - 1.0::DOUBLE / n_splits)')}) + {e.EULER} * ({_quantile_sql('(1 - 1.0::DOUBLE / (n_splits * exp(1.0::DOUBLE)))')}) ELSE 0 END AS star FROM ag JOIN mo USING (strategy, instrument))
, zz AS (SELECT *, CASE WHEN a1 > 0 AND b1 > 0 THEN (sharpe_mean - star) * sqrt(a1) / sqrt(b1) END AS z FROM dz), xx AS (SELECT *, abs(z / sqrt(2)) AS a, 1 / (1 + 0.3275911 * a) AS t FROM zz)
, o AS (SELECT *, 0.5 * (1 + sign(z) * (1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-a * a))) AS deflated_sharpe FROM xx)""" + columns("strategy instrument n_splits", "hit_mean hit_std sharpe_mean sharpe_std sharpe_sample_std worst_drawdown mean_drawdown total_return deflated_sharpe", "o")),
)
R.add("e08_equity_curve", lambda k, d: running_sum(split_returns(k, d).withColumn("_l", F.log1p("net")), SERIES, {"_e": "_l"}).select(*SERIES, "rn", F.exp("_e").alias("equity")), sql("bars", _SPLIT + ", o AS (SELECT strategy, instrument, rn, exp(sum(ln(1 + net)) OVER (PARTITION BY strategy, instrument ORDER BY rn)) AS equity FROM sr)" + columns("strategy instrument rn", "equity", "o")))

# Signals, sentiment, regimes (E12, E15, E13) ---------------------------------------------------------


def direction(move: Column, least: float = MOVE) -> Column:
    """-1, 0 or 1 by a log return; 0 where it is missing or small."""
    return F.when(F.round(move, 12) > least, 1).when(F.round(move, 12) < -least, -1).otherwise(0)


def signal_evaluation(df: DataFrame, horizon: int = 3) -> DataFrame:
    """Per instrument: bars, active signals, hit rate at a horizon and against the baseline, gross Sharpe ratio, return and drawdown of the active bars, and the hit rate of each regime with ten of them."""
    d = with_halo(df, KEYS, 1, lambda x, w: x.withColumn("move", F.log(F.lead("close", horizon).over(w.base) / F.col("close"))), ahead=horizon)
    active = F.col("actionable") & (F.col("f_signal") != 0)
    d = d.withColumn("active", active).withColumn("hit", flag(F.col("f_signal") == direction(F.col("move"))).cast("double")).withColumn("ret", F.when(active, F.col("f_signal") * F.coalesce("move", F.lit(0.0))))
    of = lambda r: F.when(F.col("active") & (F.col("regime") == r), F.col("hit"))
    one = d.groupBy("instrument").agg(
        F.count("*").alias("n_bars"), F.sum(flag(F.col("active"))).cast("long").alias("n_active"), F.coalesce(F.avg(F.when(F.col("active"), F.col("hit"))), F.lit(0.0)).alias("hit_ratio"), F.avg(flag(F.col("active")).cast("double")).alias("share_active"), F.avg(flag(F.col("agree")).cast("double")).alias("share_agree"),
        F.coalesce(F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0)) * F.sqrt(F.lit(float(YEAR))), F.lit(0.0)).alias("sharpe_gross"), F.coalesce(F.expm1(F.sum(F.log1p("ret"))), F.lit(0.0)).alias("return_gross"),
        *(F.when(F.count(of(r)) >= 10, F.avg(of(r))).alias(f"hit_{r}") for r in REGIMES),
    )
    worst = e.drawdowns(d, KEYS, "ret", simple=True).where("active").groupBy("instrument").agg(F.max("drawdown").alias("max_drawdown"))
    return one.join(worst, "instrument", "left").withColumn("against_baseline", F.col("hit_ratio") - BASELINE)


_HITS = "hit_0 hit_1 hit_2 hit_3"
R.add(
    "e12_signal_evaluation", lambda k, d: signal_evaluation(full(k, d)),
    sql("forecasts", _F + f""", m AS (SELECT *, ln(lead(close, 3) OVER {N} / close) AS move, actionable AND f_signal <> 0 AS active FROM f)
, h AS (SELECT *, CASE WHEN f_signal = CASE WHEN round(move, 12) > {MOVE} THEN 1 WHEN round(move, 12) < -{MOVE} THEN -1 ELSE 0 END THEN 1.0 ELSE 0 END AS hit, CASE WHEN active THEN f_signal * coalesce(move, 0) END AS ret FROM m)
, q AS (SELECT *, exp(sum(coalesce(ln(1 + ret), 0)) OVER {N}) AS eq FROM h), p AS (SELECT *, max(eq) OVER {N} AS pk FROM q)
, o AS (SELECT instrument, count(*) AS n_bars, count(*) FILTER (active) AS n_active, coalesce(avg(hit) FILTER (active), 0) AS hit_ratio, avg(CASE WHEN active THEN 1.0 ELSE 0 END) AS share_active, avg(CASE WHEN agree THEN 1.0 ELSE 0 END) AS share_agree, coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt({YEAR}), 0) AS sharpe_gross,
  coalesce(exp(sum(ln(1 + ret))) - 1, 0) AS return_gross, max(1 - eq / pk) FILTER (active) AS max_drawdown, hit_ratio - {BASELINE} AS against_baseline, {', '.join(f'CASE WHEN count(*) FILTER (active AND regime = {r}) >= 10 THEN avg(hit) FILTER (active AND regime = {r}) END AS hit_{r}' for r in REGIMES)} FROM p GROUP BY ALL)"""
        + columns("instrument n_bars n_active", f"hit_ratio share_active share_agree sharpe_gross return_gross max_drawdown against_baseline {_HITS}", "o")),
)


def sentiment_evaluation(df: DataFrame, signal: str = "b_signal") -> DataFrame:
    """Per instrument: active text signals, their accuracy on the next bar (one half without any), by agreement with the price's signal, the lift of agreement, and of each regime with five of them."""
    d = with_halo(df, KEYS, 1, lambda x, w: x.withColumn("move", F.log(F.lead("close").over(w.base) / F.col("close"))), ahead=1)
    d = d.withColumn("active", F.col(signal) != 0).withColumn("right", F.when(F.col(signal) != 0, flag(F.col(signal) == direction(F.col("move"))).cast("double")))
    when = lambda test: F.when(test, F.col("right"))
    many = lambda c, n: F.when(F.count(c) > n, F.avg(c))
    one = d.groupBy("instrument").agg(
        F.count("*").alias("n_bars"), F.count("right").alias("n_active"), F.avg(flag(F.col("active")).cast("double")).alias("share_active"), F.coalesce(F.avg("right"), F.lit(0.5)).alias("accuracy"), F.avg(flag(F.col("agree")).cast("double")).alias("share_agree"),
        F.coalesce(many(when(F.col("agree")), 5), F.lit(0.0)).alias("agree_accuracy"), F.coalesce(many(when(~F.col("agree")), 5), F.lit(0.0)).alias("disagree_accuracy"), *(many(when(F.col("regime") == r), 4).alias(f"hit_{r}") for r in REGIMES),
    )
    return one.withColumn("lift", F.col("agree_accuracy") - F.col("accuracy"))


R.add(
    "e15_sentiment_evaluation", lambda k, d: sentiment_evaluation(full(k, d)),
    sql("forecasts", _F + f""", m AS (SELECT *, ln(lead(close) OVER {N} / close) AS move FROM f), h AS (SELECT *, CASE WHEN b_signal <> 0 THEN CASE WHEN b_signal = CASE WHEN round(move, 12) > {MOVE} THEN 1 WHEN round(move, 12) < -{MOVE} THEN -1 ELSE 0 END THEN 1.0 ELSE 0 END END AS r FROM m)
, o AS (SELECT instrument, count(*) AS n_bars, count(r) AS n_active, avg(CASE WHEN b_signal <> 0 THEN 1.0 ELSE 0 END) AS share_active, coalesce(avg(r), 0.5) AS accuracy, avg(CASE WHEN agree THEN 1.0 ELSE 0 END) AS share_agree, CASE WHEN count(r) FILTER (agree) > 5 THEN avg(r) FILTER (agree) ELSE 0 END AS agree_accuracy,
  CASE WHEN count(r) FILTER (NOT agree) > 5 THEN avg(r) FILTER (NOT agree) ELSE 0 END AS disagree_accuracy, agree_accuracy - accuracy AS lift, {', '.join(f'CASE WHEN count(r) FILTER (regime = {r}) >= 5 THEN avg(r) FILTER (regime = {r}) END AS hit_{r}' for r in REGIMES)} FROM h GROUP BY ALL)""" + columns("instrument n_bars n_active", f"share_active accuracy share_agree agree_accuracy disagree_accuracy lift {_HITS}", "o")),
)


def regime_quality(df: DataFrame, certain: float = 0.55) -> DataFrame:
    """Per instrument: mean confidence, share of certain bars, entropy of the regimes, stability from bar to bar, mean length of a run, and the share of each regime."""
    d = with_halo(df, KEYS, 1, lambda x, w: x.withColumn("same", flag(F.coalesce(F.col("regime") == w.lag("regime"), F.lit(False))).cast("double")))
    one = d.groupBy("instrument").agg(
        F.count("*").alias("n_bars"), F.avg("confidence").alias("mean_confidence"), F.avg(flag(F.round("confidence", 9) >= certain).cast("double")).alias("share_certain"), F.avg("same").alias("stability"),
        (F.count("*") / F.sum(1 - F.col("same"))).alias("mean_run"), *(F.avg(flag(F.col("regime") == r).cast("double")).alias(f"share_{r}") for r in REGIMES),
    )
    shares = [F.col(f"share_{r}") for r in REGIMES]
    return one.withColumn("entropy", -sum((s * F.log2(s + 1e-10) for s in shares), F.lit(0.0)))


_SHARES = "share_0 share_1 share_2 share_3"
R.add(
    "e13_regime_report", lambda k, d: regime_quality(forecasts(k, d)),
    sql("forecasts", f""", a AS (SELECT *, CASE WHEN regime = lag(regime) OVER {N} THEN 1.0 ELSE 0 END AS same FROM forecasts), o AS (SELECT instrument, count(*) AS n_bars, avg(confidence) AS mean_confidence, avg(CASE WHEN round(confidence, 9) >= 0.55 THEN 1.0 ELSE 0 END) AS share_certain, avg(same) AS stability, count(*) / sum(1 - same) AS mean_run,
  {', '.join(f'avg(CASE WHEN regime = {r} THEN 1.0::DOUBLE ELSE 0 END) AS share_{r}' for r in REGIMES)}, -({' + '.join(f'share_{r} * log2(share_{r} + 1e-10)' for r in REGIMES)}) AS entropy FROM a GROUP BY ALL)""" + columns("instrument n_bars", f"mean_confidence share_certain stability mean_run {_SHARES} entropy", "o")),
)

# Weeks and months at any cost (E17) ------------------------------------------------------------------

#: Cost at which reference sums are taken, costs that are reported (pips), start of a balance.
REFERENCE, COSTS, START = 0.8, (0.0, 0.4, 0.8, 1.5), 10_000.0


def at_costs(df: DataFrame) -> DataFrame:
    """``df`` once for each reported cost (a few constants)."""
    return df.withColumn("pips", F.explode(F.array(*(F.lit(c) for c in COSTS))))


def weekly_report(scored_bars: DataFrame) -> DataFrame:
    """(strategy, instrument, week, pips, gross, reference, net, balance): weeks that end on Friday, at each cost.

    Net follows from the gross and the reference sums alone: gross - k (gross - reference) with k the cost over the reference cost.
    """
    day = F.to_date("ts")
    ref = F.col("held") * F.col("r_log") - F.col("turnover") * REFERENCE / 2 * 0.0001 / F.col("close")
    weeks = scored_bars.groupBy(*SERIES, F.next_day(F.date_sub(day, 1), "FRI").alias("week")).agg(F.sum(F.col("held") * F.col("r_log")).alias("gross"), F.sum(ref).alias("reference"))
    d = at_costs(weeks).withColumn("net", F.col("gross") - F.col("pips") / REFERENCE * (F.col("gross") - F.col("reference")))
    so_far = Window.partitionBy(*SERIES, "pips").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)  # one row per week
    return d.withColumn("balance", START * F.exp(F.sum("net").over(so_far)))


def final_balances(weeks: DataFrame) -> DataFrame:
    """The last balance of every strategy and instrument at each cost, ranked inside a cost."""
    last = weeks.groupBy(*SERIES, "pips").agg(F.max_by("balance", "week").alias("balance"))
    return last.withColumn("place", F.row_number().over(Window.partitionBy("pips").orderBy(F.desc(F.round("balance", 3)), *SERIES)))


def monthly_report(scored_bars: DataFrame) -> DataFrame:
    """(strategy, instrument, split, pips, trades, net_pips): net pips per month at each cost, from gross pips and trades."""
    t = e.trades(scored_bars).groupBy(*SERIES, "split").agg(F.sum("gross_pips").alias("gross"), F.count("*").alias("trades"))
    return at_costs(t).select(*SERIES, "split", "pips", "trades", (F.col("gross") - F.col("trades") * F.col("pips")).alias("net_pips"))


_WEEKS = COSTED_SQL + f""", wk AS (SELECT strategy, instrument, CAST(CAST(ts AS DATE) + CAST((5 - isodow(ts) + 7) % 7 AS INTEGER) AS DATE) AS week, sum(held * r_log) AS gross, sum(held * r_log - turnover * 0.4 * 0.0001 / close) AS reference FROM scored GROUP BY ALL)
, pc AS (SELECT unnest([{', '.join(f'{c}::DOUBLE' for c in COSTS)}]) AS pips), wn AS (SELECT *, gross - pips / {REFERENCE} * (gross - reference) AS net FROM wk, pc), wb AS (SELECT *, {START} * exp(sum(net) OVER (PARTITION BY strategy, instrument, pips ORDER BY week)) AS balance FROM wn)"""
R.add("e17_weekly_report", lambda k, d: weekly_report(scored(k, d)).withColumn("balance", F.round("balance", 2)), sql("bars", _WEEKS + columns("strategy instrument week pips", "gross reference net balance", "wb").replace("round(balance, 6)", "round(balance, 2)")))
R.add("e17_final_balances", lambda k, d: final_balances(weekly_report(scored(k, d))), sql("bars", _WEEKS + ", l AS (SELECT strategy, instrument, pips, arg_max(balance, week) AS balance FROM wb GROUP BY ALL), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY pips ORDER BY round(balance, 3) DESC, strategy, instrument) AS INTEGER) AS place FROM l)" + columns("strategy instrument pips place", "balance", "o", 4)), 4)
R.add("e17_monthly_report", lambda k, d: monthly_report(scored(k, d)), sql("bars", _WEEKS + ", o AS (SELECT strategy, instrument, split, pips, count(*) AS trades, sum(gross_pips) - count(*) * pips AS net_pips FROM trades, pc GROUP BY strategy, instrument, split, pips)" + columns("strategy instrument split pips trades", "net_pips", "o", 4)), 4)

# Places in expectation bands (E19) -------------------------------------------------------------------

LIVE_DAYS = 65


def placements(daily: DataFrame) -> DataFrame:
    """(strategy, instrument, day, n, balance, place): the last LIVE_DAYS days of each series as a balance path, held against the bands of the days before them."""
    order = Window.partitionBy(*SERIES).orderBy(F.desc("day"))
    marked = daily.withColumn("back", F.row_number().over(order))
    live = marked.where(F.col("back") <= LIVE_DAYS)
    n = F.row_number().over(Window.partitionBy(*SERIES).orderBy("day"))
    path = live.withColumn("n", n.cast("long")).withColumn("balance", START * F.expm1(F.sum("net").over(Window.partitionBy(*SERIES).orderBy("day").rowsBetween(Window.unboundedPreceding, 0))))
    known = e.bands(marked.where(F.col("back") > LIVE_DAYS).drop("back"), SERIES, LIVE_DAYS, START)
    b, q = F.round("balance", 6), {p: F.round(p, 6) for p in ("p05", "p25", "p75", "p95")}
    place = F.when(b < q["p05"], "below").when(b < q["p25"], "low").when(b <= q["p75"], "middle").when(b <= q["p95"], "high").otherwise("above")
    return path.join(known, [*SERIES, "n"]).select(*SERIES, "day", "n", "balance", place.alias("place"))


def period_changes(daily: DataFrame) -> DataFrame:
    """(strategy, instrument, period, start, change): balance changes per week (from Monday) and month."""
    kinds = F.explode(F.array(*(F.struct(F.lit(p).alias("period"), F.date_trunc(p, "day").cast("date").alias("start")) for p in ("week", "month"))))
    d = daily.withColumn("k", kinds).groupBy(*SERIES, "k.period", "k.start")
    return d.agg((START * F.expm1(F.sum("net"))).alias("change"))


_DAYS = COSTED_SQL + ", daily AS (SELECT strategy, instrument, CAST(ts AS DATE) AS day, sum(net) AS net FROM priced WHERE cost = 'spread' GROUP BY ALL)"
spread_days = lambda k, d: e.daily_returns(scored(k, d)).where("cost = 'spread'").drop("cost")
R.add(
    "e19_placements", lambda k, d: placements(spread_days(k, d)),
    sql("bars", _DAYS + f""", mk AS (SELECT *, row_number() OVER (PARTITION BY strategy, instrument ORDER BY day DESC) AS back FROM daily), li AS (SELECT *, row_number() OVER k AS n, {START} * (exp(sum(net) OVER k) - 1) AS balance FROM mk WHERE back <= {LIVE_DAYS} WINDOW k AS (PARTITION BY strategy, instrument ORDER BY day))
, c AS (SELECT *, sum(net) OVER k AS total, row_number() OVER k AS i FROM mk WHERE back > {LIVE_DAYS} WINDOW k AS (PARTITION BY strategy, instrument ORDER BY day)), g AS (SELECT unnest(generate_series(1, {LIVE_DAYS})) AS n)
, p AS (SELECT c.strategy, c.instrument, g.n, {START} * (exp(c.total - coalesce(b.total, 0)) - 1) AS x FROM c JOIN g ON c.i >= g.n LEFT JOIN c AS b ON b.strategy = c.strategy AND b.instrument = c.instrument AND b.i = c.i - g.n)
, qs AS (SELECT strategy, instrument, n, quantile_cont(x, [0.05, 0.25, 0.75, 0.95]) AS q FROM p GROUP BY ALL)
, o AS (SELECT li.strategy, li.instrument, day, li.n, balance, CASE WHEN round(balance, 6) < round(q[1], 6) THEN 'below' WHEN round(balance, 6) < round(q[2], 6) THEN 'low' WHEN round(balance, 6) <= round(q[3], 6) THEN 'middle' WHEN round(balance, 6) <= round(q[4], 6) THEN 'high' ELSE 'above' END AS place FROM li JOIN qs USING (strategy, instrument, n))""" + columns("strategy instrument day n place", "balance", "o", 4)), 4,
)
R.add("e19_period_changes", lambda k, d: period_changes(spread_days(k, d)), sql("bars", _DAYS + f", u AS (SELECT strategy, instrument, 'week' AS period, CAST(date_trunc('week', day) AS DATE) AS start, net FROM daily UNION ALL SELECT strategy, instrument, 'month', CAST(date_trunc('month', day) AS DATE), net FROM daily), o AS (SELECT strategy, instrument, period, start, {START} * (exp(sum(net)) - 1) AS change FROM u GROUP BY ALL)" + columns("strategy instrument period start", "change", "o", 4)), 4)

# Ensemble of four states (G5) ------------------------------------------------------------------------

#: Share of the first model, confidence from which a regime is certain.
ALPHA, CERTAIN = 0.6, 0.55


def four_states(df: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(event_id, p0..p3, regime, confidence, certain, unsure) of rows with arrays ``first`` and ``second``: their weighted mean; a null second model counts as even, and the first largest state wins."""
    even = F.array(*(F.lit(0.25) for _ in REGIMES))
    d = df.withColumn("mixed", F.zip_with("first", F.coalesce("second", even), lambda a, b: F.round(alpha * a + (1 - alpha) * b, 12))).withColumn("confidence", F.array_max("mixed"))
    state = F.array_position("mixed", F.col("confidence")).cast("int") - 1
    return d.select("event_id", *(F.col("mixed")[i].alias(f"p{i}") for i in REGIMES), state.alias("regime"), "confidence", (F.col("confidence") >= CERTAIN).alias("certain"), F.col("second").isNull().alias("unsure"))


def two_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' probabilities of four states from the forecasts; the second lacks some rows."""
    i = F.col("event_id")
    weights = [(F.pmod(i * k, F.lit(10)) + 1).cast("double") for k in (3, 7, 11, 13)]
    total = weights[0] + weights[1] + weights[2] + weights[3]
    first = F.array(*(F.when(F.col("regime") == s, 0.7).otherwise(0.1) for s in REGIMES))
    return forecasts(spark, sf_dir).select("event_id", first.alias("first"), F.when(F.pmod(i, F.lit(9)) != 0, F.array(*(w / total for w in weights))).alias("second"))


R.add(
    "g05_four_states", lambda k, d: four_states(two_models(k, d)),
    sql("forecasts", f""", a AS (SELECT event_id, list_transform([0, 1, 2, 3], lambda i: CASE WHEN regime = i THEN 0.7::DOUBLE ELSE 0.1 END) AS x, list_transform([3, 7, 11, 13], lambda k: CAST(event_id * k % 10 + 1 AS DOUBLE)) AS w FROM forecasts)
, b AS (SELECT *, CASE WHEN event_id % 9 <> 0 THEN list_transform(w, lambda v: v / (w[1] + w[2] + w[3] + w[4])) END AS y FROM a), m AS (SELECT *, list_transform([1, 2, 3, 4], lambda i: round({ALPHA} * x[i] + {1 - ALPHA} * coalesce(y[i], 0.25), 12)) AS z FROM b)
, o AS (SELECT event_id, z[1] AS p0, z[2] AS p1, z[3] AS p2, z[4] AS p3, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS regime, list_max(z) AS confidence, list_max(z) >= {CERTAIN} AS certain, y IS NULL AS unsure FROM m)""" + columns("event_id regime certain unsure", "p0 p1 p2 p3 confidence", "o")),
)
QUERIES, ORACLE_SQL = R.queries, R.sql
