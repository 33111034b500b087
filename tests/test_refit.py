"""Refit windows, models on them, block regimes, planted edges: against loops over whole series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.operators import power, refit
from tidewright.sources.views import bars

SF = "/root/testdata/sf0.01"


def series(spark, n=700, seed=5, name="a"):
    r = np.random.default_rng(seed)
    close = np.exp(np.cumsum(r.standard_t(4, n) * 1e-3))
    ts = pd.date_range("2020-01-01", periods=n, freq="D")
    frame = pd.DataFrame({"instrument": name, "ts": ts, "rn": np.arange(1, n + 1), "close": close, "open": close * 0.999, "high": close * 1.002, "low": close * 0.998, "bid_close": close - 1e-4, "ask_close": close + 1e-4, "volume": r.integers(1, 99, n)})
    return spark.createDataFrame(frame), frame


def planted(close, beta):
    r = np.append(0.0, np.diff(np.log(close)))
    out = []
    for t in range(len(r)):
        out.append(r[t] + beta / 6 * sum(out[max(0, t - 6) : t]))
    return r, np.array(out)


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_planted_returns_equal_the_recurrence(spark, block):
    rows, frame = series(spark)
    got = power.planted_returns(rows, 0.7, block).orderBy("rn").toPandas()
    r, want = planted(frame["close"].to_numpy(), 0.7)
    assert np.allclose(got["r"], r, atol=1e-12) and np.allclose(got["planted"], want, atol=1e-12)


def test_planted_candles_keep_their_shape(spark):
    rows, frame = series(spark, 90)
    got = power.planted_candles(rows, 0.4, 32).orderBy("rn").toPandas()
    r, p = planted(frame["close"].to_numpy(), 0.4)
    shift = np.cumsum(p - r)
    assert np.allclose(got["close"], frame["close"] * np.exp(shift)) and np.allclose(got["open"], frame["open"] * np.exp(np.append(0, shift[:-1])))
    assert (got["high"] >= got[["open", "close", "low"]].max(axis=1) - 1e-15).all() and (got["low"] <= got[["open", "close"]].min(axis=1) + 1e-15).all()


def test_calibrated_beta_reaches_its_target(spark):
    both = [series(spark, 900, s, n) for s, n in ((5, "a"), (6, "b"))]
    rows = both[0][0].unionByName(both[1][0])
    out = {(r["instrument"], r["target"]): r for r in power.calibrated(rows, [0.5, 0.56, 0.62], block=128).collect()}
    assert len(out) == 6
    for (_, frame), name in zip(both, "ab", strict=True):
        assert out[name, 0.5]["beta"] == 0
        for target in (0.56, 0.62):
            r = out[name, target]
            _, p = planted(frame["close"].to_numpy(), r["beta"])
            mean = np.convolve(p, np.ones(6), "valid")[:-1]
            ok = (np.abs(mean) > 1e-15) & (p[6:] != 0)
            assert abs((np.sign(mean) == np.sign(p[6:]))[ok].mean() - r["hit"]) < 1e-12
            assert target <= r["hit"] < target + 0.01 and 0 < r["beta"] < 1


def plan(spark):
    rows = bars(spark, SF).cache()
    return rows, refit.refit_blocks(refit.walk_forward(rows), rows).cache()


def test_windows_roll_with_an_embargo(spark):
    rows, blocks = plan(spark)
    b = blocks.toPandas().sort_values(["instrument", "block_id"])
    assert len(b) and (b["train_end"] == b["test_start"] - pd.Timedelta(days=5)).all()
    assert (b["train_start"] >= b["test_start"] - pd.DateOffset(months=12)).all()
    for _, of in b.groupby("instrument"):
        assert of["block_id"].tolist() == list(range(len(of))) and of["n_train"].iloc[0] >= refit.LEAST
    all_data = refit.refit_blocks(refit.walk_forward(rows), rows, train=None, least=0).toPandas().sort_values("block_id")
    assert (all_data.groupby("instrument")["n_train"].is_monotonic_increasing).all()


def test_models_equal_least_squares_and_a_flat_gradient(spark):
    rows, blocks = plan(spark)
    of = blocks.where("instrument = 'N' and block_id < 4").cache()
    got = refit.classified(rows, of).toPandas().set_index("ts")
    plain = refit.regression(rows, of).toPandas().set_index("ts")["pos"]
    x = refit.lagged(rows.where("instrument = 'N'")).toPandas().sort_values("ts")
    names = [f"lag_{i}" for i in range(5)]
    for b in of.toPandas().itertuples():
        train = x[(x["ts"] >= b.train_start) & (x["ts"] <= b.train_end)].iloc[:-1].dropna()
        test = x[(x["ts"] >= b.test_start) & (x["ts"] <= b.test_end)]
        z = test[names].fillna(0.0).to_numpy()
        want = np.sign(np.round(z @ np.linalg.lstsq(train[names].to_numpy(), train["next"].to_numpy(), rcond=None)[0], 12))
        assert (plain[test["ts"]].to_numpy() == want).all() and (got.loc[test["ts"], "linear"].to_numpy() == want).all()
        train = train[train["next"] != 0]
        mean, std = train[names].mean().to_numpy(), train[names].std(ddof=0).to_numpy()
        a, up, w = np.hstack([np.ones((len(train), 1)), (train[names].to_numpy() - mean) / std]), (train["next"] > 0).to_numpy(float), np.zeros(6)
        for _ in range(20_000):  # plain descent on the same loss
            w -= 0.002 * (a.T @ (1 / (1 + np.exp(-a @ w)) - up) + np.append(0, w[1:]))
        told = np.hstack([np.ones((len(z), 1)), (z - mean) / std]) @ w
        sure = np.abs(told) > 1e-6
        assert (got.loc[test["ts"], "logistic"].to_numpy()[sure] == np.where(told > 0, 1.0, -1.0)[sure]).all()


def test_block_regimes_and_their_filter(spark):
    rows, blocks = plan(spark)
    d = rows.where("instrument = 'N'").select("instrument", "ts", "rn", *((F.hash("rn", F.lit(i)) % 1000 / 500.0).alias(n) for i, n in enumerate(refit.REGIME_FEATURES))).cache()
    of = blocks.where("instrument = 'N' and block_id in (0, 5)").cache()
    models = refit.regime_models(d, of).cache()
    out = refit.filtered_tests(d, of, models).toPandas()
    x = d.toPandas().sort_values("rn")
    for b in of.toPandas().itertuples():
        m = models.where(F.col("block_id") == b.block_id).orderBy("regime").toPandas()
        train = x[(x["ts"] >= b.train_start) & (x["ts"] <= b.train_end)]
        assert m["n"].sum() == len(train) == b.n_train and abs(m["weight"].sum() - 1) < 1e-6
        # states of a fitted mixture are a fixed point: one more step by plain loops gives the same weights
        z = (train[list(refit.REGIME_FEATURES)].to_numpy() - m["centre"][0]) / m["scale"][0]
        share = np.zeros(4)
        for row in z:
            p = [w * np.prod([np.exp(-((v - c) ** 2) / (2 * s)) / np.sqrt(2 * np.pi * s) for v, c, s in zip(row, mean, var, strict=True)]) for w, mean, var in zip(m["weight"], m["mean"], m["var"], strict=True)]
            share += np.array(p) / sum(p)
        assert np.allclose(share / len(z), m["weight"], atol=0.05)
        test = x[(x["ts"] >= b.test_start) & (x["ts"] <= b.test_end + pd.Timedelta(days=0))]
        run = x[(x["rn"] >= test["rn"].min() - refit.WARM_UP) & (x["rn"] <= test["rn"].max())]
        v, want = None, {}
        for rn, row in zip(run["rn"], (run[list(refit.REGIME_FEATURES)].to_numpy() - m["centre"][0]) / m["scale"][0], strict=True):
            e = np.array([np.prod([np.exp(-((a - c) ** 2) / (2 * s)) / np.sqrt(s) for a, c, s in zip(row, mean, var, strict=True)]) for mean, var in zip(m["mean"], m["var"], strict=True)])
            v = (np.full(4, 0.25) if v is None else v @ np.stack(m["moves"])) * e
            v = v / v.sum()
            want[rn] = v
        mine = out[out["block_id"] == b.block_id].merge(x[["ts", "rn"]], on="ts").sort_values("rn")
        assert mine["rn"].tolist() == test["rn"].tolist()
        assert np.allclose(mine[["p0", "p1", "p2", "p3"]], np.stack([want[r] for r in mine["rn"]]), atol=1e-6)


def test_names_of_regimes():
    states = np.repeat(np.arange(4), 5)
    ret, vol = np.repeat([0.1, -0.2, 0.0, 0.3], 5), np.repeat([1.0, 1.0, 1.0, 5.0], 5)
    assert refit.canonical(np.arange(4), states, ret, vol).tolist() == [0, 1, 2, 3]
