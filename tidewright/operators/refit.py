"""Refit blocks (J2) and the models that are fitted on their windows: lag regressions (P6, P7), Gaussian regimes and their causal filter (G1 to G3).

A block is some months of test rows that share one training window: the months before, up to an embargo.
Windows of neighbouring blocks overlap, so a row trains several blocks; rows meet blocks by an equi-join
on the month and the exact bounds after. A training window has a stated number of months, so that one
window of one instrument is what a task may hold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import with_halo
from ..plans.registry import Registry, columns
from ..sources.views import KEYS, bars, macro_obs, sql
from .market import _WF, as_of, availability, derived, six, walk_forward
from .portfolio import fit_window

R = Registry()
#: Months of a block and of its training window; rows that a first window must have; lags; rows of run-up before a test.
REFIT, TRAIN, LEAST, LAGS, WARM_UP = 3, 12, 340, 5, 400


def months_between(blocks: DataFrame, start: str, end: str) -> DataFrame:
    """Blocks once per calendar month from ``start`` to ``end``."""
    return blocks.withColumn("month", F.explode(F.expr(f"sequence(date_trunc('month', {start}), date_trunc('month', {end}), interval 1 month)")))


def train_rows(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block_id, columns of rows): every row once for each block whose training window holds it."""
    bounds = months_between(blocks.select("instrument", "block_id", "train_start", "train_end"), "train_start", "train_end")
    both = rows.withColumn("month", F.date_trunc("month", "ts")).join(bounds, ["instrument", "month"])
    return both.where((F.col("ts") >= F.col("train_start")) & (F.col("ts") <= F.col("train_end"))).drop("month", "train_start", "train_end")


def test_rows(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block_id, columns of rows): every row of the block that tests its month."""
    bounds = months_between(blocks.select("instrument", "block_id", "test_start", "test_end"), "test_start", "test_end").drop("test_start", "test_end")
    return rows.withColumn("month", F.date_trunc("month", "ts")).join(bounds, ["instrument", "month"]).drop("month")


def refit_blocks(splits: DataFrame, rows: DataFrame, refit: int = REFIT, train: int | None = TRAIN, least: int = LEAST) -> DataFrame:
    """(instrument, block_id, train_start, train_end, test_start, test_end, n_splits, n_train) from monthly splits.

    Every ``refit`` splits share the window that ends before the first of them; it is the last ``train``
    months of it, or all of it for None. Leading blocks with fewer than ``least`` rows are dropped, and
    the others are numbered from 0.
    """
    start = F.min("train_start")
    if train is not None:
        start = F.greatest(start, F.add_months(F.min("test_start"), -train).cast("timestamp"))
    raw = splits.groupBy("instrument", F.floor(F.col("split_id") / refit).cast("int").alias("block_id")).agg(
        start.alias("train_start"), F.min("train_end").alias("train_end"), F.min("test_start").alias("test_start"), F.max("test_end").alias("test_end"), F.count("*").alias("n_splits")
    )
    counts = train_rows(rows.select("instrument", "ts"), raw).groupBy("instrument", "block_id").agg(F.count("*").alias("n_train"))
    known = raw.join(counts, ["instrument", "block_id"], "left").withColumn("n_train", F.coalesce("n_train", F.lit(0)).cast("long"))
    first = known.where(F.col("n_train") >= least).groupBy("instrument").agg(F.min("block_id").alias("_first"))
    kept = known.join(first, "instrument").where(F.col("block_id") >= F.col("_first"))
    return kept.withColumn("block_id", F.col("block_id") - F.col("_first")).select("instrument", "block_id", "train_start", "train_end", "test_start", "test_end", "n_splits", "n_train")


def blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly refits of the daily bars on rolling windows of a year."""
    rows = bars(spark, sf_dir)
    return refit_blocks(walk_forward(rows), rows)


_BLOCKS = _WF + f""", rb AS (SELECT instrument, CAST(floor(split_id / {REFIT}) AS INTEGER) AS b, greatest(min(train_start), min(test_start) - INTERVAL {TRAIN} MONTH) AS train_start, min(train_end) AS train_end, min(test_start) AS test_start, max(test_end) AS test_end, count(*) AS n_splits FROM wf GROUP BY ALL)
, rn AS (SELECT rb.*, count(bars.ts) AS n_train FROM rb LEFT JOIN bars ON bars.instrument = rb.instrument AND bars.ts BETWEEN train_start AND train_end GROUP BY ALL)
, rf AS (SELECT instrument, min(b) AS f FROM rn WHERE n_train >= {LEAST} GROUP BY ALL)
, blk AS (SELECT rn.instrument, b - f AS block_id, train_start, train_end, test_start, test_end, n_splits, n_train FROM rn JOIN rf USING (instrument) WHERE b >= f)"""
R.add("j02_rolling_refits", blocks_of, sql("bars", _BLOCKS + " SELECT * FROM blk"))

# Lag models --------------------------------------------------------------------------------------


def lagged(rows: DataFrame, lags: int = LAGS) -> DataFrame:
    """(instrument, ts, rn, lag_0.., next): log returns of a bar and the ones before it, and the next one."""

    def build(d: DataFrame, w) -> DataFrame:
        d = d.withColumn("r", F.log(F.col("close") / w.lag("close")))
        return d.select("instrument", "ts", "rn", "_own", "_block", *(F.lag("r", i).over(w.base).alias(f"lag_{i}") for i in range(lags)), F.lead("r").over(w.base).alias("next"))

    return with_halo(rows, KEYS, lags + 1, build, ahead=1)


def regression(rows: DataFrame, blocks: DataFrame, lags: int = LAGS) -> DataFrame:
    """(instrument, ts, block_id, pos): the sign of a regression of the next return on ``lags`` lags, without an intercept, fitted on the block's window.

    The last row of a window is left out, since its next return lies outside, and so are rows that lack a
    lag; missing lags of test rows count as 0. A window adds up to one row of products: its normal
    equations, whose least solution is taken where they have many.
    """
    names = [f"lag_{i}" for i in range(lags)]
    x = [*names, "next"]
    dealt = train_rows(lagged(rows, lags), blocks)
    last = dealt.groupBy("instrument", "block_id").agg(F.max("rn").alias("_last"))
    known = dealt.join(last, ["instrument", "block_id"]).where("rn < _last").dropna(subset=x)
    sums = known.groupBy("instrument", "block_id").agg(F.array(*(F.sum(F.col(a) * F.col(b)) for a in names for b in x)).alias("sums"))

    def solved(parts):
        for frame in parts:
            weights = []
            for s in frame["sums"]:
                m = np.array(s, float).reshape(lags, lags + 1)
                weights.append(np.linalg.lstsq(m[:, :lags], m[:, lags], rcond=None)[0].tolist())
            yield frame[["instrument", "block_id"]].assign(weights=weights)

    fitted = sums.mapInPandas(solved, "instrument string, block_id int, weights array<double>")
    told = sum((F.col("weights")[i] * F.coalesce(n, F.lit(0.0)) for i, n in enumerate(names)), F.lit(0.0))
    return test_rows(lagged(rows, lags), blocks).join(fitted, ["instrument", "block_id"]).select("instrument", "ts", "block_id", F.signum(F.round(told, 12)).alias("pos"))


def cholesky_sql(table: str, n: int) -> str:
    """CTEs that solve the normal equations of ``table`` (s{i}{j}, y{i}) by a Cholesky factor, one column after the other, to weights w0.. in ``sol``."""
    out, carry = [], table
    for j in range(n):
        low = "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
        rest = [f"(s{j}{i}{''.join(f' - l{i}{k} * l{j}{k}' for k in range(j))}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, n)]
        z = f"(y{j}{''.join(f' - l{j}{k} * z{k}' for k in range(j))}) / l{j}{j} AS z{j}"
        out.append(f"ch{j} AS (SELECT *, sqrt(s{j}{j}{low}) AS l{j}{j}, {', '.join([*rest, z])} FROM {carry})")
        carry = f"ch{j}"
    for j in reversed(range(n)):
        out.append(f"bk{j} AS (SELECT *, (z{j}{''.join(f' - l{k}{j} * w{k}' for k in range(j + 1, n))}) / l{j}{j} AS w{j} FROM {carry})")
        carry = f"bk{j}"
    return ", ".join([*out, f"sol AS (SELECT * FROM {carry})"])


def _regression_sql(n: int) -> str:
    lag = ", ".join(f"lag(r, {i}) OVER k AS lag_{i}" for i in range(n))
    sums = ", ".join([*(f"sum(lag_{i} * lag_{j}) AS s{i}{j}" for i in range(n) for j in range(i, n)), *(f"sum(lag_{i} * next) AS y{i}" for i in range(n))])
    told = " + ".join(f"w{i} * coalesce(lag_{i}, 0)" for i in range(n))
    whole = " AND ".join(f"lag_{i} IS NOT NULL" for i in range(n))
    return _BLOCKS + f""", lr AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY instrument ORDER BY rn)) AS r FROM bars), lx AS (SELECT *, {lag}, lead(r) OVER k AS next FROM lr WINDOW k AS (PARTITION BY instrument ORDER BY rn))
, tr AS (SELECT lx.*, block_id, max(lx.rn) OVER (PARTITION BY lx.instrument, block_id) AS last FROM lx JOIN blk ON lx.instrument = blk.instrument AND ts BETWEEN train_start AND train_end)
, su AS (SELECT instrument, block_id, {sums} FROM tr WHERE rn < last AND next IS NOT NULL AND {whole} GROUP BY ALL), {cholesky_sql('su', n)}
, o AS (SELECT lx.instrument, lx.ts, blk.block_id, CAST(sign(round({told}, 12)) AS DOUBLE) AS pos FROM lx JOIN blk ON lx.instrument = blk.instrument AND date_trunc('month', lx.ts) BETWEEN test_start AND test_end JOIN sol ON sol.instrument = blk.instrument AND sol.block_id = blk.block_id)"""


for _n in (1, LAGS):
    R.add(f"p06_refit_regression_{_n}", lambda k, d, n=_n: regression(bars(k, d), blocks_of(k, d), n), sql("bars", _regression_sql(_n) + columns("instrument ts block_id", "pos", "o")))


def classified(rows: DataFrame, blocks: DataFrame, lags: int = LAGS) -> DataFrame:
    """(instrument, ts, block_id, linear, logistic): both lag models per block, each fitted in one task on the window that the block has."""
    x = lagged(rows, lags)
    both = train_rows(x, blocks).withColumn("role", F.lit("train")).unionByName(test_rows(x, blocks).withColumn("role", F.lit("test")))
    out = both.withColumn("for", F.col("block_id")).drop("block_id", "rn").groupBy("instrument", "for").applyInPandas(fit_window(lags), "instrument string, ts timestamp, block int, linear double, logistic double")
    return out.withColumnRenamed("block", "block_id")


R.add("p07_refit_classifier", lambda k, d: classified(bars(k, d), blocks_of(k, d)))

# Regimes per block ---------------------------------------------------------------------------------

#: The features of regimes, their number of states, steps of a fit and its tolerance, and the least variance.
REGIME_FEATURES = ("ret", "vol", "macro", "inverted", "spread", "activity")
STATES, STEPS, TOLERANCE, LEAST_VARIANCE = 4, 60, 1e-4, 1e-3
#: Canonical names: 0 bull, 1 bear, 2 sideways, 3 crisis.
SERIES = {"macro": "1-URGENT", "inverted": "5-LOW"}


def regime_features(rows: DataFrame, obs: DataFrame) -> DataFrame:
    """(instrument, ts, rn, REGIME_FEATURES): return, its deviation over 20 bars, two macro readings by publication time, range, and volume against 20 bars; missing ones are 0."""

    def build(d: DataFrame, w) -> DataFrame:
        d = d.withColumn("ret", F.log(F.col("close") / w.lag("close"))).withColumn("vol", w.full(F.stddev_samp, "ret", 20)).withColumn("spread", (F.col("high") - F.col("low")) / F.col("close"))
        mean, std = w.full(F.avg, "volume", 20), w.full(F.stddev_samp, "volume", 20)
        return d.withColumn("activity", (F.col("volume") - mean) / F.nullif(std, F.lit(0.0))).select("instrument", "ts", "rn", "_own", "_block", "ret", "vol", "spread", "activity")

    own = with_halo(rows, KEYS, 22, build)
    known = as_of(rows, obs, ["zscore"]).groupBy("instrument", "ts").agg(*(F.max(F.when(F.col("series") == s, F.col("zscore"))).alias(f"_{n}") for n, s in SERIES.items()))
    both = own.join(known, ["instrument", "ts"], "left").withColumn("macro", F.col("_macro")).withColumn("inverted", F.when(F.col("_inverted") < 0, 1.0).otherwise(0.0))
    return both.select("instrument", "ts", "rn", *(F.coalesce(n, F.lit(0.0)).alias(n) for n in REGIME_FEATURES))


def densities(x: np.ndarray, weight: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Log of weight times density of each row in each state."""
    return np.log(weight) - 0.5 * ((((x[:, None, :] - mean) ** 2) / var) + np.log(2 * np.pi * var)).sum(axis=2)


def mixture_fit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, variances, states) of a mixture of STATES Gaussians with diagonal covariances, from quarters of the second column on."""
    order = np.argsort(np.argsort(x[:, 1], kind="stable"), kind="stable")
    member = np.eye(STATES)[np.minimum(order * STATES // len(x), STATES - 1)]
    before = -np.inf
    for _ in range(STEPS):
        n = member.sum(axis=0) + 1e-10
        mean = (member.T @ x) / n[:, None]
        var = np.maximum((member.T @ (x * x)) / n[:, None] - mean**2, 0.0) + LEAST_VARIANCE
        log = densities(x, n / n.sum(), mean, var)
        top = log.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log - top).sum(axis=1))
        member = np.exp(log - total[:, None])
        if abs(total.mean() - before) < TOLERANCE:
            break
        before = total.mean()
    return n / n.sum(), mean, var, member.argmax(axis=1)


def canonical(names: np.ndarray, states: np.ndarray, ret: np.ndarray, vol: np.ndarray) -> np.ndarray:
    """Canonical name of each state: of the states by mean deviation, the highest is crisis (3); of the rest by mean return, the highest bull (0), the lowest bear (1), the others sideways (2)."""
    mean = np.array([[vol[states == s].mean(), ret[states == s].mean()] if (states == s).any() else [-np.inf, 0.0] for s in names])
    out = np.full(len(names), 2)
    crisis = int(np.argmax(mean[:, 0]))
    rest = [s for s in range(len(names)) if s != crisis]
    out[crisis] = 3
    out[max(rest, key=lambda s: (mean[s, 1], -s))] = 0
    out[min((s for s in rest if out[s] != 0), key=lambda s: (mean[s, 1], s))] = 1
    return out


MODEL = "instrument string, block_id int, regime int, n long, weight double, mean array<double>, var array<double>, centre array<double>, scale array<double>, moves array<double>"


def regime_models(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row per block and regime: a Gaussian mixture of the standardised features of its window, and the smoothed shares of moves to each regime."""

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rn")
        raw = frame[list(REGIME_FEATURES)].to_numpy(float)
        centre, scale = raw.mean(axis=0), raw.std(axis=0)
        scale = np.where(scale > 0, scale, 1.0)
        weight, mean, var, states = mixture_fit((raw - centre) / scale)
        name = canonical(np.arange(STATES), states, raw[:, 0], raw[:, 1])
        at = np.argsort(name)
        regimes = name[states]
        moves = np.ones((STATES, STATES))
        np.add.at(moves, (regimes[:-1], regimes[1:]), 1)
        moves /= moves.sum(axis=1, keepdims=True)
        head = {"instrument": frame["instrument"].iloc[0], "block_id": frame["block_id"].iloc[0]}
        return pd.DataFrame([
            {**head, "regime": r, "n": int((regimes == r).sum()), "weight": weight[s], "mean": mean[s].tolist(), "var": var[s].tolist(), "centre": centre.tolist(), "scale": scale.tolist(), "moves": moves[r].tolist()}
            for r, s in enumerate(at.tolist())
        ])

    return train_rows(rows, blocks).groupBy("instrument", "block_id").applyInPandas(fit, MODEL)


def run_up(rows: DataFrame, tests: DataFrame, n: int = WARM_UP) -> DataFrame:
    """(block_id, columns of rows): the ``n`` rows right before the first test row of each block.

    Rows are dealt by chunks of n places, of which a run-up touches two, so that the join is an equi-join.
    """
    first = tests.groupBy("instrument", "block_id").agg(F.min("rn").alias("_first"))
    ends = F.explode(F.array(F.greatest(F.col("_first") - n, F.lit(1)), F.col("_first") - 1))
    wanted = first.withColumn("_place", ends).where("_place >= 1").select("instrument", "block_id", "_first", F.floor(F.col("_place") / n).alias("_chunk")).distinct()
    early = rows.withColumn("_chunk", F.floor(F.col("rn") / n)).join(wanted, ["instrument", "_chunk"])
    return early.where((F.col("rn") < F.col("_first")) & (F.col("rn") >= F.col("_first") - n)).drop("_chunk", "_first")


def filtered_tests(rows: DataFrame, blocks: DataFrame, models: DataFrame) -> DataFrame:
    """(instrument, ts, block_id, regime, p0..p3): the causal filter over the test rows of each block, with a run-up of WARM_UP rows that are not returned.

    Probabilities start even at the first row of the run-up; each row sees itself and what came before.
    """
    tests = test_rows(rows, blocks)
    early = run_up(rows, tests)
    both = tests.withColumn("shown", F.lit(True)).unionByName(early.withColumn("shown", F.lit(False)))

    def run(model: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        names = ["instrument", "ts", "block_id"]
        if not len(model) or not len(frame):
            return pd.DataFrame(columns=[*names, "regime", *(f"p{i}" for i in range(STATES))])
        model, frame = model.sort_values("regime"), frame.sort_values("rn")
        mean, var, moves = (np.stack(model[c].to_numpy()) for c in ("mean", "var", "moves"))
        x = (frame[list(REGIME_FEATURES)].to_numpy(float) - model["centre"].iloc[0]) / model["scale"].iloc[0]
        log = densities(x, np.ones(STATES), mean, var)
        seen, p = np.exp(log - log.max(axis=1, keepdims=True)), np.empty((len(x), STATES))
        v = np.full(STATES, 1 / STATES)
        for t in range(len(x)):
            v = (v if t == 0 else v @ moves) * seen[t]
            v = v / v.sum()
            p[t] = v
        out = frame[names].assign(regime=p.argmax(axis=1), **{f"p{i}": p[:, i] for i in range(STATES)})
        return out[frame["shown"].to_numpy()]

    schema = "instrument string, ts timestamp, block_id int, regime int, " + ", ".join(f"p{i} double" for i in range(STATES))
    return models.groupBy("instrument", "block_id").cogroup(both.groupBy("instrument", "block_id")).applyInPandas(run, schema)


def block_regimes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, blocks, models) of the daily bars."""
    rows = regime_features(bars(spark, sf_dir), six(derived(availability(macro_obs(spark, sf_dir)))))
    blocks = blocks_of(spark, sf_dir)
    return rows, blocks, regime_models(rows, blocks)


R.add("g01_block_regimes", lambda k, d: block_regimes(k, d)[2].select("instrument", "block_id", "regime", "n", "weight", *(F.col("mean")[i].alias(f"mean_{n}") for i, n in enumerate(REGIME_FEATURES))))
R.add("g02_block_filter", lambda k, d: filtered_tests(*block_regimes(k, d)))
QUERIES, ORACLE_SQL = R.queries, R.sql
