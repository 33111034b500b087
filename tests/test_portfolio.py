"""Allocation against a plain greedy loop; models per block against plain fits."""

import datetime
import random

import numpy as np

from pyspark.sql import functions as F

from tidewright.operators import portfolio as pf

DAY = datetime.datetime(2024, 1, 1)


def greedy(rows, equity=10_000.0, lim=pf.Limits()):
    """The loop over candidates in order: (instrument, units, notional, risk, outcome)."""
    n, total, used, net, gross, out = 0, 0.0, {"fx": 0.0, "metal": 0.0}, {}, {}, []
    for name, side, mid, stop in rows:
        kind, base, quote, least, most = pf.SPECS[name]
        budget = min(equity * lim.position_risk, equity * lim.total_risk - total, equity * (lim.metal_risk if kind == "metal" else lim.fx_risk) - used[kind])
        if n >= lim.positions:
            out.append((name, 0.0, 0.0, 0.0, "position_limit"))
            continue
        if round(budget, 9) <= 0:
            out.append((name, 0.0, 0.0, 0.0, "risk_budget_exhausted"))
            continue
        want = min(budget / stop, equity * lim.position_notional)
        for c, s in ((base, side), (quote, -side)):
            want = min(want, max(0.0, equity * lim.gross_currency - gross.get(c, 0.0)), max(0.0, equity * lim.net_currency - (net.get(c, 0.0) if s > 0 else -net.get(c, 0.0))))
        units = min(int(round((want / mid if quote == "USD" else want) / least, 6)) * least, most)
        if units < least:
            out.append((name, 0.0, 0.0, 0.0, "currency_exposure_limit"))
            continue
        notional = units * mid if quote == "USD" else float(units)
        n, total, used[kind] = n + 1, total + notional * stop, used[kind] + notional * stop
        for c, s in ((base, side), (quote, -side)):
            net[c], gross[c] = net.get(c, 0.0) + s * notional, gross.get(c, 0.0) + notional
        out.append((name, float(side * units), notional, notional * stop, "taken"))
    return out


def test_allocation_equals_a_greedy_loop(spark):
    r = random.Random(4)
    rows, want = [], {}
    for k in range(60):
        day, names = DAY + datetime.timedelta(days=k), r.sample(sorted(pf.SPECS), r.randrange(1, 6))
        picks = [(n, r.choice([-1, 1]), r.choice([0.9, 1.1, 2_000.0 if n == "signup" else 1.2]), r.choice([0.0005, 0.002, 0.02])) for n in names]
        rows += [(day, n, i + 1, s, m, st) for i, (n, s, m, st) in enumerate(picks)]
        want[day] = greedy(picks)
    got = {}
    for x in pf.allocated(spark.createDataFrame(rows, "as_of timestamp, instrument string, place int, signal int, mid double, stop double")).collect():
        got.setdefault(x["as_of"], []).append((x["instrument"], x["units"], x["notional"], x["risk"], x["outcome"]))
    assert set(got) == set(want)
    for day, plan in want.items():
        for a, b in zip(sorted(plan), sorted(got[day]), strict=True):
            assert a[0] == b[0] and a[4] == b[4] and np.allclose(a[1:4], b[1:4])
    assert {x[4] for p in want.values() for x in p} == {"taken", "position_limit", "currency_exposure_limit", "risk_budget_exhausted"} or len({x[4] for p in want.values() for x in p}) >= 3


def test_screening_names_the_first_reason(spark):
    t = DAY + datetime.timedelta(hours=20)
    now = DAY + datetime.timedelta(days=1)

    def row(name, **over):
        base = dict(as_of=DAY, now=now, instrument=name, ts=t, expires=t + datetime.timedelta(hours=12), event_id=1, signal=1, p50=0.001, confidence=0.8, uncertainty=0.1)
        return {**base, **over}

    preds = [row("a"), row("b", expires=t), row("c"), row("d", signal=0), row("e", confidence=0.5), row("f", uncertainty=0.5), row("g", p50=-0.001), row("h", p50=0.0001), row("i"), row("j")]
    schema = "as_of timestamp, now timestamp, instrument string, ts timestamp, expires timestamp, event_id long, signal int, p50 double, confidence double, uncertainty double"
    q = [(DAY, n, now - datetime.timedelta(minutes=5 if n != "j" else 90), 0.99996, 1.00004, n != "i", 0.004, 0.0) for n in "abdefghij"]
    quotes = spark.createDataFrame(q, "as_of timestamp, instrument string, quote_ts timestamp, bid double, ask double, tradeable boolean, stop double, financing double")
    out = {x["instrument"]: (x["reason"], x["place"]) for x in pf.screened(spark.createDataFrame([tuple(p.values()) for p in preds], schema), quotes).collect()}
    assert out == {
        "a": (None, 1), "b": ("stale_prediction", None), "c": ("missing_quote", None), "d": ("flat_prediction", None), "e": ("low_confidence", None), "f": ("high_uncertainty", None), "g": ("inconsistent_expected_return", None),
        "h": ("insufficient_net_edge", None), "i": ("instrument_not_tradeable", None), "j": ("stale_quote", None),
    }


def returns(spark, r):
    rows = []
    for t in range(len(r)):
        lags = [float(r[t - k]) if t >= k else None for k in range(5)]
        rows.append(("x", DAY + datetime.timedelta(hours=t), t // 150, *lags, float(r[t + 1]) if t + 1 < len(r) else None))
    return spark.createDataFrame(rows, "instrument string, ts timestamp, block int, lag_0 double, lag_1 double, lag_2 double, lag_3 double, lag_4 double, next double")


def test_block_models_learn_from_the_block_before(spark):
    g = np.random.default_rng(5)
    r = g.normal(size=600) * 0.01
    for t in range(1, 600):
        r[t] -= 0.4 * r[t - 1]
    out = pf.block_models(returns(spark, r)).orderBy("ts").toPandas()
    assert (out["block"] >= 0).all() and (out.loc[out["block"] == 0, ["linear", "logistic"]] == 0).all().all()
    x = np.array([[r[t - k] for k in range(5)] for t in range(4, 149)])
    beta = np.linalg.lstsq(x, r[5:150], rcond=None)[0]
    z = np.array([[r[t - k] for k in range(5)] for t in range(150, 300)])
    assert (out.loc[out["block"] == 1, "linear"].to_numpy() == np.sign(z @ beta)).all()
    late = out[out["block"] > 0].iloc[:-1]
    hit = [np.mean(late[c].to_numpy() == np.sign(r[late.index.to_numpy() + 1])) for c in ("linear", "logistic")]
    assert min(hit) > 0.54
    changed = r.copy()
    changed[450:] *= -3  # a later block does not change earlier ones
    again = pf.block_models(returns(spark, changed)).orderBy("ts").toPandas()
    assert (again.iloc[:449][["linear", "logistic"]] == out.iloc[:449][["linear", "logistic"]]).all().all()
