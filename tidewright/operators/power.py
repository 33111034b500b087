"""Power of the evaluation: a momentum edge planted into prices (P11), and its strength calibrated to a hit rate (P13).

A planted return is the real one plus beta times the mean of the LOOKBACK planted returns before it: a
linear recurrence of order LOOKBACK. What a block of rows does to the last LOOKBACK planted returns is
an affine map: the power of the companion matrix for its length, plus the response of the block alone.
Blocks are run once from zeros, their maps are applied in order per series, one small row each, and
then every block is run again from the state that it begins with. So a series of any length is spread.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import BLOCK, running_sum, settled, with_halo
from ..plans.registry import Registry, columns
from ..sources.views import KEYS, bars, sql

R = Registry()
#: Bars of the planted momentum; points of a grid of betas; times that a grid is drawn, each ten times as fine as the one before.
LOOKBACK, POINTS, ROUNDS = 6, 11, 4


def responses(r: np.ndarray, betas: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Planted returns of a block for each beta; ``state`` has, per beta, the planted returns before it, newest first."""
    out = np.empty((len(r) + LOOKBACK, len(betas)))
    out[:LOOKBACK] = state.T[::-1]
    pull = betas / LOOKBACK
    for t in range(len(r)):
        out[t + LOOKBACK] = r[t] + pull * out[t : t + LOOKBACK].sum(axis=0)
    return out[LOOKBACK:]


def companion(beta: float) -> np.ndarray:
    """The map of the last planted returns over one row without a return of its own."""
    m = np.eye(LOOKBACK, k=-1)
    m[0] = beta / LOOKBACK
    return m


def returns_in_blocks(rows: DataFrame, betas: DataFrame, block: int) -> DataFrame:
    """(instrument, rn, r, block, betas): log returns, 0 for the first bar; the betas stand on the first row of a block only."""
    r = with_halo(rows, KEYS, 1, lambda d, w: d.withColumn("r", F.coalesce(F.log(F.col("close") / w.lag("close")), F.lit(0.0)))).select("instrument", "rn", "r")
    placed = r.join(betas.select("instrument", "betas"), "instrument")
    first = (F.col("rn") - 1) % block == 0
    return settled(placed.select("instrument", "rn", "r", F.floor((F.col("rn") - 1) / block).alias("block"), F.when(first, F.col("betas")).alias("betas")))


def block_starts(dealt: DataFrame, block: int) -> DataFrame:
    """(instrument, block, state): for each beta, the last planted returns with which a block begins, as one flat list."""

    def alone(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rn")
        betas = np.array(frame["betas"].iloc[0], float)
        planted = responses(frame["r"].to_numpy(), betas, np.zeros((len(betas), LOOKBACK)))
        tail = np.vstack([np.zeros((LOOKBACK, len(betas))), planted])[-LOOKBACK:][::-1].T
        return pd.DataFrame({"instrument": [frame["instrument"].iloc[0]], "block": [frame["block"].iloc[0]], "betas": [betas.tolist()], "tail": [tail.ravel().tolist()]})

    def composed(frame: pd.DataFrame) -> pd.DataFrame:
        frame, out, state = frame.sort_values("block"), [], None
        for r in frame.itertuples():
            betas = np.array(r.betas)
            if state is None:
                state, maps = np.zeros((len(betas), LOOKBACK)), np.stack([np.linalg.matrix_power(companion(b), block) for b in betas])
            out.append((r.instrument, r.block, state.ravel().tolist()))
            state = np.einsum("bij,bj->bi", maps, state) + np.array(r.tail).reshape(state.shape)
        return pd.DataFrame(out, columns=["instrument", "block", "state"])

    tails = dealt.groupBy("instrument", "block").applyInPandas(alone, "instrument string, block long, betas array<double>, tail array<double>")
    return tails.groupBy("instrument").applyInPandas(composed, "instrument string, block long, state array<double>")


def in_state(dealt: DataFrame, starts: DataFrame) -> DataFrame:
    """Blocks with the state that each begins with, on its first row only."""
    first = F.col("betas").isNotNull()
    return dealt.join(starts, ["instrument", "block"]).withColumn("state", F.when(first, F.col("state")))


def planted_returns(rows: DataFrame, beta: float, block: int = BLOCK) -> DataFrame:
    """(instrument, rn, r, planted): log returns of numbered bars and the planted ones."""
    betas = rows.select("instrument").distinct().withColumn("betas", F.array(F.lit(float(beta))))
    dealt = returns_in_blocks(rows, betas, block)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rn")
        state = np.array(frame["state"].iloc[0], float).reshape(1, LOOKBACK)
        return frame[["instrument", "rn", "r"]].assign(planted=responses(frame["r"].to_numpy(), np.array([beta]), state)[:, 0])

    return in_state(dealt, block_starts(dealt, block)).groupBy("instrument", "block").applyInPandas(run, "instrument string, rn long, r double, planted double")


def planted_candles(rows: DataFrame, beta: float, block: int = BLOCK) -> DataFrame:
    """Candles whose closes follow the planted returns; a bar keeps its shape, and opens where the shift before it was."""
    d = running_sum(planted_returns(rows, beta, block).withColumn("_step", F.col("planted") - F.col("r")), KEYS, {"shift": "_step"})
    d = rows.join(d.select("instrument", "rn", "shift", (F.col("shift") - F.col("_step")).alias("before")), [*KEYS, "rn"])
    up = F.exp("shift")
    opened, closed = F.col("open") * F.exp("before"), F.col("close") * up
    return d.select(
        "instrument", "ts", "rn", opened.alias("open"), F.greatest(F.col("high") * up, opened, closed).alias("high"), F.least(F.col("low") * up, opened, closed).alias("low"),
        closed.alias("close"), (F.col("bid_close") * up).alias("bid_close"), (F.col("ask_close") * up).alias("ask_close"), "volume",
    )


def oracle_hits(rows: DataFrame, betas: DataFrame, block: int = BLOCK) -> DataFrame:
    """(instrument, beta, n, hit): how often the sign of the mean of the last LOOKBACK planted returns is that of the next one.

    ``betas`` has (instrument, betas), a list each. Rows of which either is 0 do not count, nor do the
    first ones, which have fewer returns before them. One pass over the rows for all betas of a series.
    """
    dealt = returns_in_blocks(rows, betas, block)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rn")
        betas = np.array(frame["betas"].iloc[0], float)
        state = np.array(frame["state"].iloc[0], float).reshape(len(betas), LOOKBACK)
        planted = responses(frame["r"].to_numpy(), betas, state)
        past = np.vstack([state.T[::-1], planted])
        total = np.cumsum(np.vstack([np.zeros(len(betas)), past]), axis=0)
        mean = (total[LOOKBACK:-1] - total[: -LOOKBACK - 1])[: len(planted)]
        mean = np.where(np.abs(mean) < 1e-15, 0.0, mean)
        known = (mean != 0) & (planted != 0) & (frame["rn"].to_numpy() > LOOKBACK)[:, None]
        hits = known & (np.sign(mean) == np.sign(planted))
        return pd.DataFrame({"instrument": frame["instrument"].iloc[0], "beta": betas, "n": known.sum(axis=0), "hits": hits.sum(axis=0)})

    counts = in_state(dealt, block_starts(dealt, block)).groupBy("instrument", "block").applyInPandas(run, "instrument string, beta double, n long, hits long")
    return counts.groupBy("instrument", "beta").agg(F.sum("n").alias("n"), (F.sum("hits") / F.nullif(F.sum("n"), F.lit(0))).alias("hit"))


def calibrated(rows: DataFrame, targets: list[float], rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """(instrument, target, beta, hit): the smallest beta of a grid whose hit rate reaches each target.

    The grid has POINTS betas between 0 and 1, drawn anew ``rounds`` - 1 times between the beta found and
    the one before it; all series and targets are one job per round. A target up to one half needs no
    edge; one that no beta reaches gets beta 1.
    """
    spark = rows.sparkSession
    wanted = rows.select("instrument").distinct().join(F.broadcast(spark.createDataFrame([(float(t),) for t in targets], "target double")))  # a stated list of targets
    step = 1.0
    found = settled(wanted.withColumn("beta", F.lit(1.0)))
    hits = None
    for _ in range(rounds):
        lower, step = F.greatest(F.col("beta") - step, F.lit(0.0)), step / (POINTS - 1)
        grid = F.array(*(F.round(lower + i * step, 9) for i in range(POINTS)))
        points = found.withColumn("point", F.explode(grid)).where("point <= 1")
        hits = settled(oracle_hits(rows, points.groupBy("instrument").agg(F.sort_array(F.collect_set("point")).alias("betas")), block))
        reached = points.join(hits.select("instrument", F.col("beta").alias("point"), "hit"), ["instrument", "point"]).where("hit >= target")
        least = reached.groupBy("instrument", "target").agg(F.min("point").alias("beta"))
        found = settled(wanted.join(least, ["instrument", "target"], "left").select("instrument", "target", F.coalesce("beta", F.lit(1.0)).alias("beta")))
    last = found.join(hits.select("instrument", "beta", "hit"), ["instrument", "beta"], "left").select("instrument", "target", "beta", "hit")
    return last.withColumn("beta", F.when(F.col("target") <= 0.5, 0.0).otherwise(F.col("beta")))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Betas that plant hit rates of 52, 55 and 60 % into the daily bars."""
    return calibrated(settled(bars(spark, sf_dir)), [0.52, 0.55, 0.60])


BETA = 0.3
_PLANTED = f""", r AS (SELECT *, coalesce(ln(close / lag(close) OVER (PARTITION BY instrument ORDER BY rn)), 0) AS r FROM bars)
, p AS (SELECT instrument, rn, r, r AS p1, 0.0::DOUBLE AS p2, 0.0::DOUBLE AS p3, 0.0::DOUBLE AS p4, 0.0::DOUBLE AS p5, 0.0::DOUBLE AS p6 FROM r WHERE rn = 1
  UNION ALL SELECT r.instrument, r.rn, r.r, r.r + {BETA} * (p1 + p2 + p3 + p4 + p5 + p6) / 6, p1, p2, p3, p4, p5 FROM p JOIN r ON r.instrument = p.instrument AND r.rn = p.rn + 1)
, s AS (SELECT instrument, rn, sum(p1 - r) OVER (PARTITION BY instrument ORDER BY rn) AS shift, p1 - r AS step FROM p)
, o AS (SELECT b.instrument, b.ts, b.rn, b.volume, open * exp(shift - step) AS o1, close * exp(shift) AS c1, greatest(high * exp(shift), o1, c1) AS h1, least(low * exp(shift), o1, c1) AS l1, bid_close * exp(shift) AS b1, ask_close * exp(shift) AS a1 FROM bars AS b JOIN s USING (instrument, rn))"""
R.add(
    "p11_planted_edge", lambda k, d: planted_candles(bars(k, d), BETA),
    sql("bars", _PLANTED + " SELECT instrument, ts, rn, volume, " + ", ".join(f"round({a}1, 8) + 0.0 AS {b}" for a, b in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("b", "bid_close"), ("a", "ask_close"))) + " FROM o").replace("WITH ", "WITH RECURSIVE ", 1), 8,
)
R.add("p13_calibration", calibration)
QUERIES, ORACLE_SQL = R.queries, R.sql
