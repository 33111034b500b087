"""The evaluator: positions to scored bars, trades, net returns and summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import BLOCK, normal_cdf, normal_quantile, numbered, running_sum, with_halo

SERIES = ["strategy", "instrument"]
#: Round-trip costs in pips, and the annual number of days.
COSTS = {"gross": 0.0, "spread": 0.8, "spread_plus": 1.5}
DAYS = 252.0


def simulate(positions: DataFrame, pip: float = 0.0001) -> DataFrame:
    """Scored bars of (strategy, instrument, split, ts, rn, close, pos): held, r_log, pnl_pips, turnover.

    A split ends flat; a position decided at a bar is held over the next one.
    """
    w = Window.partitionBy(*SERIES, "split").orderBy("ts")
    flat = positions.withColumn("pos", F.when(F.lead("ts").over(w).isNull(), 0.0).otherwise(F.coalesce("pos", F.lit(0.0))))
    before, close = F.lag("pos", 1, 0.0).over(w), F.lag("close").over(w)
    return (
        flat.withColumn("held", before)
        .withColumn("r_log", F.coalesce(F.log(F.col("close") / close), F.lit(0.0)))
        .withColumn("pnl_pips", F.col("held") * F.coalesce(F.col("close") - close, F.lit(0.0)) / pip)
        .withColumn("turnover", F.abs(F.col("pos") - before))
    )


def trades(scored: DataFrame) -> DataFrame:
    """Trades: runs of bars held in one direction inside a split."""
    w = Window.partitionBy(*SERIES, "split").orderBy("ts")
    d = scored.withColumn("side", F.signum("held"))
    d = d.withColumn("run", F.sum(F.when(F.col("side") == F.lag("side").over(w), 0).otherwise(1)).over(w))
    return d.where("held <> 0").groupBy(*SERIES, "split", "run").agg(
        F.max("side").alias("direction"), F.sum("pnl_pips").alias("gross_pips"), F.count("*").alias("n_bars"), F.avg(F.abs("held")).alias("size"), F.min("ts").alias("opened"), F.max("ts").alias("closed")
    )


def costed(df: DataFrame, costs: dict[str, float] = COSTS) -> DataFrame:
    """``df`` once per cost level (cost, cost_pips): a few constant rows."""
    levels = F.array(*(F.struct(F.lit(k).alias("cost"), F.lit(v).alias("cost_pips")) for k, v in costs.items()))
    return df.select("*", F.explode(levels).alias("_level")).select("*", "_level.*").drop("_level")


def net_log(pip: float = 0.0001) -> Column:
    """Net log return of a scored bar at ``cost_pips``."""
    return F.col("held") * F.col("r_log") - F.col("turnover") * (F.col("cost_pips") / 2) * pip / F.col("close")


def daily_returns(scored: DataFrame) -> DataFrame:
    """Daily net log returns per strategy, instrument and cost."""
    d = costed(scored).withColumn("net", net_log()).withColumn("day", F.to_date("ts"))
    return d.groupBy(*SERIES, "cost", "day").agg(F.sum("net").alias("net"))


def drawdowns(df: DataFrame, keys: list[str], column: str, simple: bool = False) -> DataFrame:
    """Adds equity and drawdown of returns per row (log returns, or simple ones), in the order of ``rn``.

    Two levels in one pass: inside blocks of rows, the running sum and its maximum; over blocks,
    the sum before a block and the highest point before it.
    """
    step = F.log1p(column) if simple else F.col(column)
    inside = Window.partitionBy(*keys, "_block").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("_block", F.floor((F.col("rn") - 1) / BLOCK))
    d = d.withColumn("_run", F.sum("_step").over(inside)).withColumn("_top", F.max("_run").over(inside))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = d.groupBy(*keys, "_block").agg(F.sum("_step").alias("_s"), F.max("_run").alias("_m"))
    ends = ends.withColumn("_off", F.coalesce(F.sum("_s").over(before), F.lit(0.0)))
    ends = ends.select(*keys, "_block", "_off", F.max(F.col("_off") + F.col("_m")).over(before).alias("_high"))
    joined = d.join(ends, [*keys, "_block"])
    total, peak = F.col("_off") + F.col("_run"), F.greatest("_high", F.col("_off") + F.col("_top"))
    return joined.withColumn("equity", F.exp(total)).withColumn("drawdown", 1 - F.exp(total - peak)).drop("_step", "_block", "_run", "_top", "_off", "_high")


def summarise(scored: DataFrame, more: list[str] | None = None) -> DataFrame:
    """One row per strategy, instrument (and ``more`` keys) and cost, over all splits."""
    keys = [*SERIES, *(more or [])]
    traded = costed(trades(scored)).groupBy(*keys, "cost").agg(
        F.count("*").alias("n_trades"), F.sum("gross_pips").alias("gross"), F.avg(F.when(F.col("gross_pips") - F.col("cost_pips") * F.col("size") > 0, 1.0).otherwise(0.0)).alias("win_rate")
    )
    priced = costed(scored).withColumn("net", net_log())
    moved = (F.col("held") != 0) & (F.col("r_log") != 0)
    bars = priced.groupBy(*keys, "cost").agg(
        F.avg(F.when(F.col("held") != 0, 1.0).otherwise(0.0)).alias("exposure"),
        F.avg(F.when(moved, F.when(F.signum("held") == F.signum("r_log"), 1.0).otherwise(0.0))).alias("hit_directional"),
        F.avg(F.when(F.col("held") != 0, F.when(F.col("held") * F.col("r_log") > 0, 1.0).otherwise(0.0))).alias("hit_msc_style"),
        F.sum(F.col("turnover") * F.col("cost_pips") / 2).alias("paid"),
    )
    days = priced.groupBy(*keys, "cost", F.to_date("ts").alias("day")).agg(F.sum("net").alias("net")).groupBy(*keys, "cost").agg(
        F.count("*").alias("days"), F.avg("net").alias("mean"), F.stddev_samp("net").alias("std")
    )
    worst = drawdowns(priced, [*keys, "cost"], "net").groupBy(*keys, "cost").agg(F.max("drawdown").alias("max_drawdown"))
    joined = bars.join(traded, [*keys, "cost"], "left").join(days, [*keys, "cost"]).join(worst, [*keys, "cost"])
    n = F.coalesce("n_trades", F.lit(0))
    total = F.coalesce("gross", F.lit(0.0)) - F.col("paid")
    return joined.select(
        *keys, "cost", n.cast("long").alias("n_trades"), "exposure", (n / F.greatest("days", F.lit(1))).alias("trades_per_day"), "hit_directional", "hit_msc_style", "win_rate",
        total.alias("net_pips_total"), (total / F.nullif(n, F.lit(0))).alias("net_pips_per_trade"),
        F.when(F.col("std") > 0, F.col("mean") / F.col("std") * F.sqrt(F.lit(DAYS))).otherwise(0.0).alias("sharpe"), "max_drawdown",
    )


def moments(scored: DataFrame, pip: float = 0.0001) -> DataFrame:
    """Sums from which the Sharpe ratio at any cost follows: of daily gross g, unit cost d, and their products."""
    d = scored.groupBy(*SERIES, F.to_date("ts").alias("day")).agg(F.sum(F.col("held") * F.col("r_log")).alias("g"), F.sum(F.col("turnover") / 2 * pip / F.col("close")).alias("d"))
    g, c = F.col("g"), F.col("d")
    return d.groupBy(*SERIES).agg(F.count("*").alias("n"), F.sum(g).alias("sg"), F.sum(c).alias("sd"), F.sum(g * g).alias("sgg"), F.sum(c * c).alias("sdd"), F.sum(g * c).alias("sgd"))


def sharpe_at(m: DataFrame, costs: dict[str, float] = COSTS) -> DataFrame:
    """Sharpe ratio of every row of ``moments`` at every cost."""
    k, n = F.col("cost_pips"), F.col("n")
    d = costed(m, costs)
    mean = (F.col("sg") - k * F.col("sd")) / n
    square = F.col("sgg") - 2 * k * F.col("sgd") + k * k * F.col("sdd")
    std = F.sqrt(F.greatest((square - n * mean * mean) / (n - 1), F.lit(0.0)))
    return d.select(*SERIES, "cost", F.when(std > 0, mean / std * F.sqrt(F.lit(DAYS))).otherwise(0.0).alias("sharpe"))


def bands(daily: DataFrame, keys: list[str], longest: int = 65, start: float = 10_000.0) -> DataFrame:
    """Quantiles of the profit over n = 1..longest consecutive days, over all starting days."""
    d = numbered(daily.withColumn("ts", F.col("day").cast("timestamp")), keys, ["ts"], "year")
    d = running_sum(d, keys, {"total": "net"})
    # totals of the last days are a bounded array; before the first day the total is 0
    d = with_halo(d, keys, longest, lambda x, w: x.withColumn("last", F.collect_list("total").over(w(-longest))))
    both = d.select(*keys, "total", "last", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(longest).cast("long"), F.col("rn")))).alias("n"))
    profit = F.lit(start) * F.expm1(F.col("total") - F.coalesce(F.get("last", (F.size("last") - 1 - F.col("n")).cast("int")), F.lit(0.0)))
    out = both.groupBy(*keys, "n").agg(F.percentile(profit, F.array(*(F.lit(q) for q in (0.05, 0.25, 0.5, 0.75, 0.95)))).alias("q"))
    return out.select(*keys, F.col("n").cast("long").alias("n"), *(F.col("q")[i].alias(f"p{p:02d}") for i, p in enumerate((5, 25, 50, 75, 95))))


def return_metrics(df: DataFrame, keys: list[str], column: str, periods: float = DAYS) -> DataFrame:
    """Total and annual return, volatility, Sharpe, Sortino, drawdown and Calmar of simple returns in the order of ``rn``."""
    r = F.col(column)
    one = df.groupBy(*keys).agg(F.sum(F.log1p(r)).alias("logs"), F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), F.stddev_samp(F.when(r < 0, r)).alias("down"))
    worst = drawdowns(df, keys, column, simple=True).groupBy(*keys).agg((-F.max("drawdown")).alias("max_drawdown"))
    annual = F.expm1(F.col("logs") * periods / F.col("n"))
    return one.join(worst, keys).select(
        *keys, F.expm1("logs").alias("total_return"), annual.alias("annualised_return"), (F.col("std") * F.sqrt(F.lit(periods))).alias("volatility"),
        F.when(F.col("std") > 0, F.col("mean") / F.col("std") * F.sqrt(F.lit(periods))).otherwise(0.0).alias("sharpe"),
        F.when(F.col("down").isNotNull(), F.col("mean") / F.nullif(F.col("down"), F.lit(0.0)) * F.sqrt(F.lit(periods))).otherwise(0.0).alias("sortino"),
        "max_drawdown", F.when(F.col("max_drawdown") < 0, -annual / F.col("max_drawdown")).otherwise(0.0).alias("calmar"),
    )


def tail_risk(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Value at risk and its conditional mean at 5 %, profit factor and hit rate: the cut first, then the tail."""
    cut = df.groupBy(*keys).agg(F.percentile(column, 0.05).alias("cut"))
    r = F.col(column)
    return df.join(cut, keys).groupBy(*keys).agg(
        (-F.first("cut")).alias("var_95"), (-F.avg(F.when(F.round(r, 12) <= F.round("cut", 12), r))).alias("cvar_95"),
        (F.sum(F.when(r > 0, r).otherwise(0.0)) / F.nullif(-F.sum(F.when(r < 0, r).otherwise(0.0)), F.lit(0.0))).alias("profit_factor"),
        F.avg(F.when(r != 0, F.when(r > 0, 1.0).otherwise(0.0))).alias("hit_ratio"),
    )


#: Fixed value: Euler's constant.
EULER = 0.5772156649


def best_of(n: Column) -> Column:
    """The Sharpe ratio that the best of n strategies without skill is expected to show; 0 for one."""
    low, high = normal_quantile(1 - 1 / n), normal_quantile(1 - 1 / (n * math.e))
    return F.when(n > 1, (1 - EULER) * low + EULER * high).otherwise(0.0)


def deflated_sharpe(df: DataFrame, keys: list[str], column: str, among: list[str] | None = None) -> DataFrame:
    """Probability that a Sharpe ratio is above chance, with its standard error widened for skew and kurtosis.

    With ``among`` (some of ``keys``), the benchmark is the best of as many strategies as share these
    keys; else it is 0. Moments are the bias-corrected ones: Spark's are those of the population and are
    converted.
    """
    m = df.groupBy(*keys).agg(F.count(column).alias("n"), (F.avg(column) / F.stddev_samp(column)).alias("sr"), F.skewness(column).alias("g1"), F.kurtosis(column).alias("g2"))
    if among is not None:
        m = m.join(m.groupBy(*among).agg(F.count("*").alias("n_strategies")), among)
    n, sr = F.col("n").cast("double"), F.col("sr")
    skew = F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3))
    factor = F.sqrt(1 - skew * sr + ((kurt - 1) / 4) * sr * sr)
    se = F.sqrt((1 + (sr * sr) / 2 * (1 - skew * skew + kurt / 4)) / (n - 1))
    star = best_of(F.col("n_strategies")) if among is not None else F.lit(0.0)
    more = [F.col("n_strategies"), star.alias("expected_best")] if among is not None else []
    return m.select(*keys, "sr", skew.alias("skew"), kurt.alias("kurt"), *more, normal_cdf((sr - star) * factor / se).alias("dsr"))
