"""Queries of bar features (F1 to F25) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.windows import rounded
from ..sources.views import bars, sql
from . import features as f

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Feature columns of each query.
COLUMNS: dict[str, list[str]] = {}


def _add(name: str, build: Callable[[DataFrame], DataFrame], columns: str, body: str, views: str = "bars") -> None:
    """A query of (instrument, ts, columns), rounded to six places in both engines."""
    names = COLUMNS[name] = columns.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(build(bars(spark, sf_dir)).select("instrument", "ts", *names))

    QUERIES[name] = run
    ORACLE_SQL[name] = sql(views, body)


W = "(PARTITION BY instrument ORDER BY rn{})"


def _w(n: int | None = None) -> str:
    return W.format("" if n is None else f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW")


def _full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {_w(n)} = {n} THEN {agg.format(x)} OVER {_w(n)} END"


def _out(columns: str, source: str, ints: str = "") -> str:
    return f"SELECT instrument, ts, {', '.join(c if c in ints.split() else f'round({c}, 6) + 0.0 AS {c}' for c in columns.split())} FROM {source}"


def _ewm(x: str, alpha: float, source: str, name: str, back: int = 1200) -> str:
    """SQL of an exponential mean as a weighted sum over the rows before (what is older is below 1e-20)."""
    own, keep = x.replace("@", ""), f"power({1 - alpha!r}, coalesce(gap, 1)) / (power({1 - alpha!r}, coalesce(gap, 1)) + {alpha!r})"
    placed = f"""(SELECT *, sum(CASE WHEN {own} IS NOT NULL THEN ln({keep}) ELSE 0 END) OVER {_w()} AS l, CASE WHEN gap IS NULL THEN 1 ELSE 1 - {keep} END AS w
        FROM (SELECT *, rn - last_value(CASE WHEN {own} IS NOT NULL THEN rn END IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM {source}))"""
    return f"""SELECT t.instrument, t.rn, sum({x.replace('@', 's.')} * s.w * exp(t.l - s.l)) AS {name} FROM {placed} AS t JOIN {placed} AS s
        ON s.instrument = t.instrument AND s.rn <= t.rn AND s.rn > t.rn - {back} AND {x.replace('@', 's.')} IS NOT NULL GROUP BY ALL"""


_steps = (1, 2, 3, 5, 10)
_cols = " ".join(f"return_{k} log_return_{k}" for k in _steps)
_add(
    "f01_f02_returns", f.returns, f"{_cols} return_zscore_252",
    ", a AS (SELECT *, " + ", ".join(f"close / lag(close, {k}) OVER {_w()} - 1 AS return_{k}, ln(close / lag(close, {k}) OVER {_w()}) AS log_return_{k}" for k in _steps) + " FROM bars), "
    f"b AS (SELECT *, (return_1 - {_full('avg({})', 'return_1', 252)}) / nullif({_full('stddev_samp({})', 'return_1', 252)}, 0) AS return_zscore_252 FROM a) " + _out(f"{_cols} return_zscore_252", "b"),
)
_sizes = (10, 20, 50, 100, 200)
_cols = " ".join(f"sma_{n} sma_{n}_dist" for n in _sizes) + " sma_cross_signal"
_add(
    "f03_f04_moving_averages", f.moving_averages, _cols,
    ", a AS (SELECT *, " + ", ".join(f"{_full('avg({})', 'close', n)} AS sma_{n}, close / sma_{n} - 1 AS sma_{n}_dist" for n in _sizes)
    + " FROM bars), b AS (SELECT *, CASE WHEN round(sma_20, 9) > round(sma_200, 9) THEN 1 WHEN round(sma_20, 9) < round(sma_200, 9) THEN -1 ELSE 0 END AS sma_cross_signal FROM a) " + _out(_cols, "b", "sma_cross_signal"),
)
_cols = "ema_12 ema_26 ema_50 macd_line macd_signal macd_histogram macd_cross"
_add(
    "f05_f06_ema_macd", f.moving_exponentials, _cols,
    "".join(f", e{n} AS ({_ewm('@close', 2 / (n + 1), 'bars', f'ema_{n}')})" for n in (12, 26, 50))
    + ", m AS (SELECT *, ema_12 - ema_26 AS macd_line FROM bars JOIN e12 USING (instrument, rn) JOIN e26 USING (instrument, rn) JOIN e50 USING (instrument, rn))"
    + f", g AS ({_ewm('@macd_line', 0.2, 'm', 'macd_signal')})"
    + ", b AS (SELECT *, macd_line - macd_signal AS macd_histogram, CASE WHEN round(macd_line, 9) > round(macd_signal, 9) THEN 1 ELSE -1 END AS macd_cross FROM m JOIN g USING (instrument, rn)) "
    + _out(_cols, "b", "macd_cross"),
)
_TR = f""", p AS (SELECT *, lag(close) OVER {_w()} AS pc, high - lag(high) OVER {_w()} AS rise, lag(low) OVER {_w()} - low AS fall FROM bars)
, r AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, CASE WHEN rise > fall AND rise > 0 THEN rise ELSE 0 END AS up, CASE WHEN fall > rise AND fall > 0 THEN fall ELSE 0 END AS down FROM p)"""
_cols = "tr plus_di minus_di adx trend_strong"
_add(
    "f07_adx", f.directional_index, _cols,
    _TR + f", a AS ({_ewm('@tr', 1 / 14, 'r', 'atr')}), u AS ({_ewm('@up', 1 / 14, 'r', 'us')}), d AS ({_ewm('@down', 1 / 14, 'r', 'ds')})"
    ", x AS (SELECT *, 100 * us / nullif(atr, 0) AS plus_di, 100 * ds / nullif(atr, 0) AS minus_di, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx FROM r JOIN a USING (instrument, rn) JOIN u USING (instrument, rn) JOIN d USING (instrument, rn))"
    f", y AS ({_ewm('@dx', 1 / 14, 'x', 'adx')}), b AS (SELECT *, CASE WHEN round(adx, 9) > 25 THEN 1 ELSE 0 END AS trend_strong FROM x LEFT JOIN y USING (instrument, rn)) " + _out(_cols, "b", "trend_strong"),
)
_cols = "rsi_14 rsi_overbought rsi_oversold"
_add(
    "f08_rsi", f.relative_strength, _cols,
    f", p AS (SELECT *, close - lag(close) OVER {_w()} AS step FROM bars), q AS (SELECT *, CASE WHEN step IS NOT NULL THEN greatest(step, 0) END AS gain, CASE WHEN step IS NOT NULL THEN greatest(-step, 0) END AS loss FROM p)"
    f", g AS ({_ewm('@gain', 1 / 14, 'q', 'g')}), l AS ({_ewm('@loss', 1 / 14, 'q', 'l')})"
    ", b AS (SELECT *, 100 - 100 / (1 + g / nullif(l, 0)) AS rsi_14, CASE WHEN round(rsi_14, 9) > 70 THEN 1 ELSE 0 END AS rsi_overbought, CASE WHEN round(rsi_14, 9) < 30 THEN 1 ELSE 0 END AS rsi_oversold FROM q LEFT JOIN g USING (instrument, rn) LEFT JOIN l USING (instrument, rn)) "
    + _out(_cols, "b", "rsi_overbought rsi_oversold"),
)
_cols = "stoch_k stoch_d williams_r roc_5 roc_10 roc_20 cci_20"
_add(
    "f09_f11_oscillators", f.oscillators, _cols,
    f", p AS (SELECT *, {_full('min({})', 'low', 14)} AS lo, {_full('max({})', 'high', 14)} AS hi, (high + low + close) / 3 AS tp FROM bars)"
    f", q AS (SELECT *, 100 * (close - lo) / nullif(hi - lo, 0) AS stoch_k, -100 * (hi - close) / nullif(hi - lo, 0) AS williams_r, {', '.join(f'100 * (close / lag(close, {n}) OVER {_w()} - 1) AS roc_{n}' for n in (5, 10, 20))}, {_full('avg({})', 'tp', 20)} AS m, list(tp) OVER {_w(20)} AS tps FROM p)"
    f", b AS (SELECT *, {_full('avg({})', 'stoch_k', 3)} AS stoch_d, (tp - m) / nullif(0.015 * (list_sum(list_transform(tps, lambda x: abs(x - m))) / 20), 0) AS cci_20 FROM q) " + _out(_cols, "b"),
)
_cols = "vol_realised_20 vol_gk_20 bb_upper bb_lower bb_middle bb_width bb_pct bb_squeeze vol_regime_high"
_add(
    "f12_f17_volatility", f.volatility, _cols,
    f", p AS (SELECT *, ln(close / lag(close) OVER {_w()}) AS r, 0.5 * power(ln(high / low), 2) - (2 * ln(2) - 1) * power(ln(close / open), 2) AS gk FROM bars)"
    f", q AS (SELECT *, {_full('stddev_samp({})', 'r', 20)} * sqrt(252) AS vol_realised_20, sqrt(CASE WHEN {_full('avg({})', 'gk', 20)} >= 0 THEN {_full('avg({})', 'gk', 20)} END * 252) AS vol_gk_20, {_full('avg({})', 'close', 20)} AS bb_middle, {_full('stddev_samp({})', 'close', 20)} AS sd FROM p)"
    ", s AS (SELECT *, bb_middle + 2 * sd AS bb_upper, bb_middle - 2 * sd AS bb_lower, (bb_upper - bb_lower) / bb_middle AS bb_width, (close - bb_lower) / nullif(bb_upper - bb_lower, 0) AS bb_pct, round(bb_width, 9) AS w9, round(vol_realised_20, 9) AS v9 FROM q)"
    f", b AS (SELECT *, CASE WHEN w9 < round({_full('quantile_cont({}, 0.2)', 'w9', 126).replace('count(w9)', 'count(w9)')}, 9) THEN 1 ELSE 0 END AS bb_squeeze, CASE WHEN v9 > round({_full('quantile_cont({}, 0.75)', 'v9', 252)}, 9) THEN 1 ELSE 0 END AS vol_regime_high FROM s) "
    + _out(_cols, "b", "bb_squeeze vol_regime_high"),
)
_add("f16_atr", f.average_range, "atr_14 atr_pct", _TR + f", a AS ({_ewm('@tr', 1 / 14, 'r', 'atr_14')}), b AS (SELECT *, atr_14 / close AS atr_pct FROM r JOIN a USING (instrument, rn)) " + _out("atr_14 atr_pct", "b"))
_cols = "volume_zscore volume_high obv obv_sma_20 obv_trend vwap_20"
_add(
    "f18_f20_volume", f.volume, _cols,
    f", p AS (SELECT *, volume * coalesce(sign(close - lag(close) OVER {_w()}), 0) AS sv, (high + low + close) / 3 * volume AS tv FROM bars)"
    f", q AS (SELECT *, CASE WHEN rn > 1 THEN CAST(sum(sv) OVER {_w()} AS DOUBLE) END AS obv, (volume - {_full('avg({})', 'volume', 20)}) / nullif({_full('stddev_samp({})', 'volume', 20)}, 0) AS volume_zscore, {_full('sum({})', 'tv', 20)} / nullif({_full('sum({})', 'volume', 20)}, 0) AS vwap_20 FROM p)"
    f", b AS (SELECT *, CASE WHEN round(volume_zscore, 9) > 2 THEN 1 ELSE 0 END AS volume_high, {_full('avg({})', 'obv', 20)} AS obv_sma_20, CASE WHEN obv > obv_sma_20 THEN 1 ELSE -1 END AS obv_trend FROM q) "
    + _out(_cols, "b", "volume_high obv_trend"),
)
_cols = "body_ratio upper_shadow lower_shadow direction range_norm close_position"
_add(
    "f21_candle_shape", f.candle_shape, _cols,
    ", b AS (SELECT *, abs(close - open) / nullif(high - low, 0) AS body_ratio, (high - greatest(open, close)) / nullif(high - low, 0) AS upper_shadow, (least(open, close) - low) / nullif(high - low, 0) AS lower_shadow, "
    "CASE WHEN close >= open THEN 1 ELSE -1 END AS direction, (high - low) / close AS range_norm, (close - low) / nullif(high - low, 0) AS close_position FROM bars) " + _out(_cols, "b", "direction"),
)
_cols = "hour_sin hour_cos dow_sin dow_cos dom_sin dom_cos is_overlap is_london"
_CAL = (
    "SELECT *, sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos, sin(2 * pi() * (isodow(ts) - 1) / 5) AS dow_sin, cos(2 * pi() * (isodow(ts) - 1) / 5) AS dow_cos, "
    "sin(2 * pi() * day(ts) / 31) AS dom_sin, cos(2 * pi() * day(ts) / 31) AS dom_cos, CASE WHEN hour(ts) >= 12 AND hour(ts) < 16 THEN 1 ELSE 0 END AS is_overlap, CASE WHEN hour(ts) >= 7 AND hour(ts) < 12 THEN 1 ELSE 0 END AS is_london"
)
_add("f22_calendar", f.calendar, _cols, f", b AS ({_CAL} FROM bars) " + _out(_cols, "b", "is_overlap is_london"))
_add("f23_future_calendar", f.future_calendar, _cols, f", n AS (SELECT instrument, unnest(generate_series(max(ts) + INTERVAL 1 DAY, max(ts) + INTERVAL 12 DAY, INTERVAL 1 DAY)) AS ts FROM bars GROUP BY instrument), b AS ({_CAL} FROM n) " + _out(_cols, "b", "is_overlap is_london"))
_cols = "cross_corr_20 cross_spread cross_spread_z"
_CROSS = (
    f", j AS (SELECT a.instrument, a.ts, a.close, o.close AS close_b, row_number() OVER (PARTITION BY a.instrument ORDER BY a.ts) AS rn FROM bars AS a JOIN bars AS o ON a.ts = o.ts AND o.instrument = 'N' WHERE a.instrument <> 'N')"
    f", p AS (SELECT *, ln(close / lag(close) OVER {_w()}) AS ra, ln(close_b / lag(close_b) OVER {_w()}) AS rb, close - close_b AS cross_spread FROM j)"
    f", x AS (SELECT *, CASE WHEN count(ra) OVER {_w(20)} = 20 THEN corr(ra, rb) OVER {_w(20)} END AS cross_corr_20, (cross_spread - {_full('avg({})', 'cross_spread', 20)}) / nullif({_full('stddev_samp({})', 'cross_spread', 20)}, 0) AS cross_spread_z FROM p) "
)
_add("f24_cross_pair", lambda d: f.cross_pair(d.where("instrument <> 'N'"), d.where("instrument = 'N'")), _cols, _CROSS + _out(_cols, "x"))
_add("f25_quoted_spread", f.quoted_spread, "spread_pips", ", b AS (SELECT *, (ask_close - bid_close) / 0.0001 AS spread_pips FROM bars) " + _out("spread_pips", "b"))
