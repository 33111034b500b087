"""Features of bars. Every value at a bar reads that bar and earlier ones only.

Functions take a bar table with ``rn`` (see functions.windows.numbered) and add columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import EWM_BLOCK, Frames, ewm, numbered, ratio, reach, running_sum, with_halo

KEYS = ["instrument"]


def flag(condition: Column) -> Column:
    """1 where true, 0 where false or null."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def returns(df: DataFrame, steps: tuple[int, ...] = (1, 2, 3, 5, 10)) -> DataFrame:
    """Simple and log returns over ``steps`` bars, and the z-score of the one-bar return over 252 bars."""

    def build(d: DataFrame, w: Frames) -> DataFrame:
        for k in steps:
            d = d.withColumn(f"return_{k}", F.col("close") / w.lag("close", k) - 1).withColumn(f"log_return_{k}", F.log(F.col("close") / w.lag("close", k)))
        mean, std = w.full(F.avg, "return_1", 252), w.full(F.stddev_samp, "return_1", 252)
        return d.withColumn("return_zscore_252", ratio(F.col("return_1") - mean, std))

    return with_halo(df, KEYS, 253, build)


def moving_averages(df: DataFrame, sizes: tuple[int, ...] = (10, 20, 50, 100, 200)) -> DataFrame:
    """sma_w, its relative distance, and the sign of sma_20 over sma_200."""

    def build(d: DataFrame, w: Frames) -> DataFrame:
        for n in sizes:
            d = d.withColumn(f"sma_{n}", w.full(F.avg, "close", n)).withColumn(f"sma_{n}_dist", F.col("close") / F.col(f"sma_{n}") - 1)
        a, b = F.round("sma_20", 9), F.round("sma_200", 9)
        return d.withColumn("sma_cross_signal", F.when(a > b, 1).when(a < b, -1).otherwise(0))

    return with_halo(df, KEYS, max(sizes), build)


def moving_exponentials(df: DataFrame) -> DataFrame:
    """ema_12, ema_26, ema_50 and MACD(12, 26, 9)."""

    def build(d: DataFrame, w: Frames) -> DataFrame:
        d = ewm(d, w, {f"ema_{n}": ("close", 2 / (n + 1)) for n in (12, 26, 50)})
        d = ewm(d.withColumn("macd_line", F.col("ema_12") - F.col("ema_26")), w, {"macd_signal": ("macd_line", 0.2)})
        a, b = F.round("macd_line", 9), F.round("macd_signal", 9)
        return d.withColumn("macd_histogram", F.col("macd_line") - F.col("macd_signal")).withColumn("macd_cross", F.when(a > b, 1).otherwise(-1))

    return with_halo(df, KEYS, reach(2 / 51, 0.2), build, rows=EWM_BLOCK)


def true_range(d: DataFrame, w: Frames) -> DataFrame:
    """Adds ``tr`` and the directional moves ``up`` and ``down``."""
    high, low, before = F.col("high"), F.col("low"), w.lag("close")
    rise, fall = high - w.lag("high"), w.lag("low") - low
    return (
        d.withColumn("tr", F.greatest(high - low, F.abs(high - before), F.abs(low - before)))
        .withColumn("up", F.when((rise > fall) & (rise > 0), rise).otherwise(0.0))
        .withColumn("down", F.when((fall > rise) & (fall > 0), fall).otherwise(0.0))
    )


def directional_index(df: DataFrame) -> DataFrame:
    """ADX(14) with both directional indices, and whether the trend is strong (above 25)."""

    def build(d: DataFrame, w: Frames) -> DataFrame:
        d = ewm(true_range(d, w), w, {"atr": ("tr", 1 / 14), "_up": ("up", 1 / 14), "_down": ("down", 1 / 14)})
        d = d.withColumn("plus_di", 100 * ratio(F.col("_up"), F.col("atr"))).withColumn("minus_di", 100 * ratio(F.col("_down"), F.col("atr")))
        d = d.withColumn("dx", 100 * ratio(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))
        return ewm(d, w, {"adx": ("dx", 1 / 14)}).withColumn("trend_strong", flag(F.round("adx", 9) > 25)).drop("_up", "_down")

    return with_halo(df, KEYS, reach(1 / 14, 1 / 14) + 1, build, rows=EWM_BLOCK)


def relative_strength(df: DataFrame) -> DataFrame:
    """RSI(14) and its flags beyond 70 and 30."""

    def build(d: DataFrame, w: Frames) -> DataFrame:
        step = F.col("close") - w.lag("close")
        d = d.withColumn("_gain", F.when(step.isNotNull(), F.greatest(step, F.lit(0.0)))).withColumn("_loss", F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0))))
        d = ewm(d, w, {"_g": ("_gain", 1 / 14), "_l": ("_loss", 1 / 14)})
        d = d.withColumn("rsi_14", 100 - 100 / (1 + ratio(F.col("_g"), F.col("_l"))))
        r = F.round("rsi_14", 9)
        return d.withColumn("rsi_overbought", flag(r > 70)).withColumn("rsi_oversold", flag(r < 30)).drop("_gain", "_loss", "_g", "_l")

    return with_halo(df, KEYS, reach(1 / 14) + 1, build, rows=EWM_BLOCK)


def oscillators(df: DataFrame) -> DataFrame:
    """Stochastic %K(14) and %D(3), Williams %R, rates of change, CCI(20)."""

    def build(d: DataFrame, w: Frames) -> DataFrame:
        low, high = w.full(F.min, "low", 14), w.full(F.max, "high", 14)
        d = d.withColumn("stoch_k", 100 * ratio(F.col("close") - low, high - low)).withColumn("williams_r", -100 * ratio(high - F.col("close"), high - low))
        d = d.withColumn("stoch_d", w.full(F.avg, "stoch_k", 3))
        for n in (5, 10, 20):
            d = d.withColumn(f"roc_{n}", 100 * (F.col("close") / w.lag("close", n) - 1))
        d = d.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3).withColumn("_m", w.full(F.avg, "_tp", 20))
        # the mean absolute deviation about the mean of the window does not split into sums
        apart = F.aggregate(F.collect_list("_tp").over(w(-19)), F.lit(0.0), lambda s, x: s + F.abs(x - F.col("_m"))) / 20
        return d.withColumn("cci_20", ratio(F.col("_tp") - F.col("_m"), 0.015 * apart)).drop("_tp", "_m")

    return with_halo(df, KEYS, 40, build)


def volatility(df: DataFrame) -> DataFrame:
    """Realised and Garman-Klass volatility, Bollinger bands and squeeze, high-volatility regime, ATR(14)."""

    def build(d: DataFrame, w: Frames) -> DataFrame:
        d = d.withColumn("_r", F.log(F.col("close") / w.lag("close")))
        d = d.withColumn("vol_realised_20", w.full(F.stddev_samp, "_r", 20) * F.sqrt(F.lit(252.0)))
        d = d.withColumn("_gk", 0.5 * F.pow(F.log(F.col("high") / F.col("low")), F.lit(2)) - (2 * F.log(F.lit(2.0)) - 1) * F.pow(F.log(F.col("close") / F.col("open")), F.lit(2)))
        d = d.withColumn("_gk20", w.full(F.avg, "_gk", 20))
        d = d.withColumn("vol_gk_20", F.sqrt(F.when(F.col("_gk20") >= 0, F.col("_gk20")) * 252))
        d = d.withColumn("bb_middle", w.full(F.avg, "close", 20)).withColumn("_sd", w.full(F.stddev_samp, "close", 20))
        d = d.withColumn("bb_upper", F.col("bb_middle") + 2 * F.col("_sd")).withColumn("bb_lower", F.col("bb_middle") - 2 * F.col("_sd"))
        d = d.withColumn("bb_width", (F.col("bb_upper") - F.col("bb_lower")) / F.col("bb_middle"))
        d = d.withColumn("bb_pct", ratio(F.col("close") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")))
        d = d.withColumn("_w9", F.round("bb_width", 9)).withColumn("_v9", F.round("vol_realised_20", 9))
        squeeze = w.full(lambda c: F.percentile(c, 0.2), "_w9", 126)
        calm = w.full(lambda c: F.percentile(c, 0.75), "_v9", 252)
        d = d.withColumn("bb_squeeze", flag(F.col("_w9") < F.round(squeeze, 9))).withColumn("vol_regime_high", flag(F.col("_v9") > F.round(calm, 9)))
        return d.drop("_r", "_gk", "_gk20", "_sd", "_w9", "_v9")

    return with_halo(df, KEYS, 280, build)


def average_range(df: DataFrame) -> DataFrame:
    """ATR(14), in price and relative to the close."""

    def build(d: DataFrame, w: Frames) -> DataFrame:
        d = ewm(true_range(d, w), w, {"atr_14": ("tr", 1 / 14)})
        return d.withColumn("atr_pct", F.col("atr_14") / F.col("close"))

    return with_halo(df, KEYS, reach(1 / 14) + 1, build, rows=EWM_BLOCK)


def volume(df: DataFrame) -> DataFrame:
    """Volume z-score and flag, on-balance volume with its mean and trend, and a VWAP of 20 bars."""

    def signed(d: DataFrame, w: Frames) -> DataFrame:
        return d.withColumn("_signed", F.col("volume") * F.coalesce(F.signum(F.col("close") - w.lag("close")), F.lit(0.0)))

    d = running_sum(with_halo(df, KEYS, 1, signed), KEYS, {"obv": "_signed"}).withColumn("obv", F.when(F.col("rn") > 1, F.col("obv")))

    def build(d: DataFrame, w: Frames) -> DataFrame:
        v = F.col("volume").cast("double")
        d = d.withColumn("volume_zscore", ratio(v - w.full(F.avg, v, 20), w.full(F.stddev_samp, v, 20)))
        d = d.withColumn("volume_high", flag(F.round("volume_zscore", 9) > 2))
        d = d.withColumn("obv_sma_20", w.full(F.avg, "obv", 20)).withColumn("obv_trend", F.when(F.col("obv") > F.col("obv_sma_20"), 1).otherwise(-1))
        tp = (F.col("high") + F.col("low") + F.col("close")) / 3
        return d.withColumn("vwap_20", ratio(w.full(F.sum, tp * F.col("volume"), 20), w.full(F.sum, v, 20)))

    return with_halo(d, KEYS, 20, build).drop("_signed")


def candle_shape(df: DataFrame) -> DataFrame:
    """Body and shadows relative to the range, direction, range relative to the close, place of the close."""
    span = F.col("high") - F.col("low")
    return (
        df.withColumn("body_ratio", ratio(F.abs(F.col("close") - F.col("open")), span))
        .withColumn("upper_shadow", ratio(F.col("high") - F.greatest(F.col("open"), F.col("close")), span))
        .withColumn("lower_shadow", ratio(F.least(F.col("open"), F.col("close")) - F.col("low"), span))
        .withColumn("direction", F.when(F.col("close") >= F.col("open"), 1).otherwise(-1))
        .withColumn("range_norm", span / F.col("close"))
        .withColumn("close_position", ratio(F.col("close") - F.col("low"), span))
    )


def calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Cyclic hour, weekday (of five) and day of month, the overlap of London and New York, and London before it."""
    t = F.col(ts)
    hour, day = F.hour(t), F.weekday(t)

    def cyclic(d: DataFrame, name: str, value: Column, period: float) -> DataFrame:
        angle = 2 * 3.141592653589793 * value / period
        return d.withColumn(f"{name}_sin", F.sin(angle)).withColumn(f"{name}_cos", F.cos(angle))

    d = cyclic(cyclic(cyclic(df, "hour", hour, 24.0), "dow", day, 5.0), "dom", F.dayofmonth(t), 31.0)
    return d.withColumn("is_overlap", flag((hour >= 12) & (hour < 16))).withColumn("is_london", flag((hour >= 7) & (hour < 12)))


def future_calendar(df: DataFrame, ahead: int = 12, minutes: int = 1440) -> DataFrame:
    """Calendar rows of the next ``ahead`` bars of ``minutes`` after the last bar of each instrument."""
    last = df.groupBy("instrument").agg(F.max("ts").alias("last"))
    steps = F.expr(f"sequence(last + interval {minutes} minutes, last + interval {minutes * ahead} minutes, interval {minutes} minutes)")
    return calendar(last.select("instrument", F.explode(steps).alias("ts")))


def cross_pair(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rolling correlation and spread with another instrument, over the bars that both have."""
    both = df.select("instrument", "ts", "close").join(other.select("ts", F.col("close").alias("close_b")), "ts")
    placed = numbered(both, KEYS, ["ts"], "year")

    def build(d: DataFrame, w: Frames) -> DataFrame:
        d = d.withColumn("_a", F.log(F.col("close") / w.lag("close"))).withColumn("_b", F.log(F.col("close_b") / w.lag("close_b")))
        pairs = F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).over(w(-19))
        d = d.withColumn("cross_corr_20", F.when(pairs == 20, F.corr("_a", "_b").over(w(-19)))).withColumn("cross_spread", F.col("close") - F.col("close_b"))
        mean, std = w.full(F.avg, "cross_spread", 20), w.full(F.stddev_samp, "cross_spread", 20)
        return d.withColumn("cross_spread_z", ratio(F.col("cross_spread") - mean, std)).drop("_a", "_b", "close_b")

    return with_halo(placed, KEYS, 21, build)


def quoted_spread(df: DataFrame, pip: float = 0.0001) -> DataFrame:
    """The quoted spread of a bar in pips, with bid and ask."""
    return df.withColumn("spread_pips", (F.col("ask_close") - F.col("bid_close")) / pip)
