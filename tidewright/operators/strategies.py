"""Rule-based strategies: positions in [-1, 1], decided at a bar and earned on the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import Frames, carried, numbered, with_halo
from .features import KEYS

#: Name of a strategy by its column in ``rule_positions``.
RULES = ("buy_hold", "sma_cross", "contrarian", "bollinger")


def seeded_sign(*parts: Column, seed: int = 0) -> Column:
    """+1 or -1 by a hash of ``parts``: the same on every run, even in the long run."""
    return F.when(F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(2)) == 0, 1.0).otherwise(-1.0)


def rule_positions(bars: DataFrame) -> DataFrame:
    """(instrument, ts, rn, close and a column per rule) of a bar table with ``rn``.

    Buy and hold; SMA 20 over 200 (0 until both are known, -1 on a tie); against the mean of the last three
    returns; Bollinger reversion, which enters outside the bands, leaves where the close crosses the
    mean, and otherwise holds: an event column carried forward over the whole series.
    """

    def build(d: DataFrame, w: Frames) -> DataFrame:
        close = F.col("close")
        d = d.withColumn("_r", close / w.lag("close") - 1).withColumn("_m20", w.full(F.avg, "close", 20)).withColumn("_m200", w.full(F.avg, "close", 200)).withColumn("_sd", w.full(F.stddev_samp, "close", 20))
        away = F.round(close - F.col("_m20"), 9)
        d = d.withColumn("_side", F.signum(away)).withColumn("_before", w.lag(F.signum(away)))
        crossed = F.col("_side") * F.col("_before") < 0  # a close on the mean is not yet beyond it
        over, under = away > F.round(2 * F.col("_sd"), 9), away < -F.round(2 * F.col("_sd"), 9)
        d = d.withColumn("_event", F.when(crossed, 0.0).when(over, -1.0).when(under, 1.0))
        gap = F.round(F.col("_m20") - F.col("_m200"), 9)
        return d.select(
            *KEYS, "ts", "rn", "close", "_own", "_block", "_event",
            F.lit(1.0).alias("buy_hold"),
            F.when(gap.isNull(), 0.0).when(gap > 0, 1.0).otherwise(-1.0).alias("sma_cross"),
            F.coalesce(-F.signum(F.round(w.full(F.avg, "_r", 3), 12)), F.lit(0.0)).alias("contrarian"),
        )

    held = carried(with_halo(bars, KEYS, 202, build), KEYS, "_event", "bollinger")
    return held.withColumn("bollinger", F.coalesce("bollinger", F.lit(0.0))).drop("_event")


def long_positions(wide: DataFrame, rules: tuple[str, ...] = RULES) -> DataFrame:
    """(strategy, instrument, ts, rn, close, pos): one row per rule and bar."""
    return wide.unpivot(["instrument", "ts", "rn", "close"], list(rules), "strategy", "pos")


def on_bars(decided: DataFrame, bars: DataFrame, names: list[str], carry: int) -> DataFrame:
    """Decisions (instrument, ts, columns ``names``) on every bar from the first to the last of them.

    A bar without a decision, one that could not be scored, keeps the last one of at most ``carry`` bars
    before; further on it is 0. A decision to be flat is an explicit 0 and is not carried over.
    """
    span = decided.groupBy(*KEYS).agg(F.min("ts").alias("_from"), F.max("ts").alias("_to"))
    placed = bars.select(*KEYS, "ts", "rn").join(decided.select(*KEYS, "ts", *names), [*KEYS, "ts"], "left").join(span, KEYS).where("ts between _from and _to").drop("_from", "_to")
    return with_halo(placed, KEYS, carry, lambda d, w: d.select("*", *(F.coalesce(F.last(n, ignorenulls=True).over(w(-carry)), F.lit(0.0)).alias(f"_{n}") for n in names)).drop(*names).withColumnsRenamed({f"_{n}": n for n in names}))


def gated_positions(forecasts: DataFrame, bars: DataFrame, thresholds: dict[int, float], lookback: int = 60, least: int = 20, carry: int = 1) -> DataFrame:
    """Forecast variants on bars: (instrument, ts, rn, ungated, gated, top) from signal, confidence and regime.

    ``ungated`` follows every signal; ``gated`` only from the threshold of its regime on; ``top`` only
    from the 90 % quantile of the confidences of the earlier forecasts of the lookback on, once there
    are ``least`` of them; otherwise a forecast means 0. Quantiles roll over forecasts, not over bars.
    """
    needed = F.coalesce(F.element_at(F.create_map(*(x for k, v in thresholds.items() for x in (F.lit(k), F.lit(v)))), F.col("regime")), F.lit(0.55))
    placed = numbered(forecasts.select(*KEYS, "ts", "signal", "confidence", "regime"), KEYS, ["ts"], "day")

    def build(d: DataFrame, w: Frames) -> DataFrame:
        earlier, signal = w(-lookback, -1), F.col("signal").cast("double")
        bar = F.when(F.count("confidence").over(earlier) >= least, F.percentile("confidence", 0.9).over(earlier))
        d = d.withColumn("_bar", F.round(bar, 9)).withColumn("ungated", signal)
        return d.withColumn("gated", F.when(F.round("confidence", 9) >= needed, signal).otherwise(0.0)).withColumn("top", F.when(F.round("confidence", 9) >= F.col("_bar"), signal).otherwise(0.0)).drop("_bar")

    return on_bars(with_halo(placed, KEYS, lookback, build), bars, ["ungated", "gated", "top"], carry)


def risk_positions(forecasts: DataFrame, bars: DataFrame, cost: float = 0.8, edge: float = 0.5, pip: float = 0.0001, carry: int = 1) -> DataFrame:
    """(instrument, ts, rn, risk_gates, cost_filter): forecasts behind the hard gates, or behind cost and edge in pips.

    The gates ask for a confidence of 0.52, and of 0.62 in a crisis (regime 3); the filter for
    signal x p50 x close of ``cost`` + ``edge`` pips. Otherwise a forecast means 0.
    """
    signal, sure = F.col("signal").cast("double"), F.round("confidence", 9)
    move = F.round(F.col("signal") * F.col("p50") * F.col("close") / pip, 9)
    gate = (sure >= 0.52) & ~((F.col("regime") == 3) & (sure < 0.62))
    decided = forecasts.withColumn("risk_gates", F.when(gate, signal).otherwise(0.0)).withColumn("cost_filter", F.when(move >= cost + edge, signal).otherwise(0.0))
    return on_bars(decided, bars, ["risk_gates", "cost_filter"], carry)


def lag_regression(bars: DataFrame, lags: int = 1, train_blocks: int = 1) -> DataFrame:
    """Positions of a regression of the next return on the last ones, without an intercept.

    The weight of a calendar year comes from the years before it alone (``train_blocks`` of them):
    sums of products per year, summed over the training years, give the normal equations.
    """

    def build(d: DataFrame, w: Frames) -> DataFrame:
        d = d.withColumn("x", F.log(F.col("close") / w.lag("close")))
        return d.withColumn("y", F.lead("x").over(w.base)).withColumn("block", F.year("ts"))

    rows = with_halo(bars, KEYS, 1, build, ahead=1)
    inside = rows.withColumn("_last", F.max("rn").over(Window.partitionBy(*KEYS, "block"))).where("rn < _last and x is not null and y is not null")
    sums = inside.groupBy(*KEYS, "block").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    before = Window.partitionBy(*KEYS).orderBy("block").rangeBetween(-train_blocks, -1)
    years = rows.select(*KEYS, "block").distinct().join(sums, [*KEYS, "block"], "left")
    weights = years.select(*KEYS, "block", (F.sum("xy").over(before) / F.nullif(F.sum("xx").over(before), F.lit(0.0))).alias("weight"))
    return rows.join(weights, [*KEYS, "block"]).withColumn("pos", F.coalesce(F.signum(F.col("weight") * F.coalesce("x", F.lit(0.0))), F.lit(0.0)))
