"""State that a stream keeps per key with ``transformWithStateInPandas``: carried decisions, seeded state, alerts with timers, ledgers, regimes and weights.

Every operator has a batch twin that gives the same rows. State lives in RocksDB and is restored from
the checkpoint of its query. A micro-batch is what one trigger reads, some files at a time; the rows of
a key in it are put in order inside the task. Keys come to their tasks by a shuffle on the key.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.windows import carried, numbered, running_max, settled, with_halo
from ..operators.decisions import PRICE_WEIGHTS, decisions
from ..operators.live_reports import _LG, _OFF, PIP, REFERENCE, SERIES, regime_model
from ..operators.market import ORACLE_SQL as MARKET_SQL
from ..operators.market import as_of, availability, derived, six
from ..operators.reports import ORACLE_SQL as REPORT_SQL
from ..plans.registry import Registry, columns
from ..sources.store import commit_batch, read_journal
from ..sources.views import KEYS, bars, forecasts, macro_obs, news, sql, ticks
from .live import landed, replayed, stream_distinct, stream_folder

R = Registry()
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocks(spark: SparkSession):
    """State in RocksDB for the queries that start inside, as several state variables and timers need it, in two partitions a core at most.

    A query keeps the number of state partitions that it begins with; each costs a store and a worker per batch.
    """
    wanted = {PROVIDER: ROCKS, PARTITIONS: str(min(int(spark.conf.get(PARTITIONS)), 2 * spark.sparkContext.defaultParallelism))}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


def in_order(parts: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """The rows of a key in one micro-batch, in order."""
    return pd.concat(list(parts)).sort_values(order)


def stateful(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, mode: str = "None", seed: DataFrame | None = None) -> DataFrame:
    """``rows`` through a processor per key, with the state that ``seed`` gives its keys."""
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", mode, seed.groupBy(*keys) if seed is not None else None)


# Carried decisions (O5, O10) --------------------------------------------------------------------

#: Bars over which a decision holds while none can be made.
HOLD = 12


class Carry(StatefulProcessor):
    """The last decision and its age; a bar without a decision keeps it for HOLD bars, then is flat."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("carry", "value double, age int")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.state.update((float(initialState["value"].iloc[0]), int(initialState["age"].iloc[0])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        value, age = self.state.get() if self.state.exists() else (0.0, HOLD)
        frame = in_order(rows, ["ts", "event_id"])
        held = []
        for target in frame["target"].tolist():
            if target == target and target is not None:
                value, age = float(target), 0
                held.append(value)
            else:
                held.append(value if age < HOLD else 0.0)
                age = min(age + 1, HOLD)
        self.state.update((value, age))
        yield pd.DataFrame({"instrument": key[0], "event_id": frame["event_id"].to_numpy(), "held": held})

    def close(self) -> None:
        pass


CARRIED = "instrument string, event_id long, held double"


def stream_carry(rows: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """What is held at each bar (instrument, ts, event_id, target), where a null target is no decision; ``seed`` has (instrument, value, age)."""
    return stateful(rows, KEYS, Carry(), CARRIED, seed=seed)


def batch_carry(rows: DataFrame) -> DataFrame:
    """The batch twin on numbered rows, with the age of the decision."""
    d = carried(rows.withColumn("_at", F.when(F.col("target").isNotNull(), F.struct("rn", "target"))), KEYS, "_at", "_last")
    d = d.withColumn("age", F.least(F.coalesce(F.col("rn") - F.col("_last.rn"), F.lit(HOLD + 1)), F.lit(HOLD + 1)))
    return d.withColumn("value", F.coalesce("_last.target", F.lit(0.0))).withColumn("held", F.when(F.col("age") <= HOLD, F.col("value")).otherwise(0.0)).drop("_at", "_last")


def sparse_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of forecasts of which only those on bars of certain volumes can be made."""
    return forecasts(spark, sf_dir).select("instrument", "ts", "rn", "event_id", F.when(F.pmod("volume", F.lit(16)) == 0, F.col("signal").cast("double")).alias("target"))


def carry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carried decisions of a stream from its start."""
    with rocks(spark):
        return replayed(stream_carry(landed(sparse_decisions(spark, sf_dir).drop("rn"))))


#: Where the seeded stream takes over.
TAKE_OVER = "2024-01-15"


def seeded_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that starts at TAKE_OVER with the state that the rows before it leave, computed in batch."""
    rows = settled(sparse_decisions(spark, sf_dir))
    late = F.col("ts") >= F.lit(TAKE_OVER).cast("timestamp")
    seed = batch_carry(rows.where(~late)).groupBy(*KEYS).agg(F.max_by(F.struct("value", "age"), "rn").alias("s")).select(*KEYS, "s.value", F.least(F.col("s.age"), F.lit(HOLD)).cast("int").alias("age"))
    with rocks(spark):
        return replayed(stream_carry(landed(rows.where(late).drop("rn")), settled(seed)))


_CARRY = f""", a AS (SELECT *, CASE WHEN volume % 16 = 0 THEN CAST(signal AS DOUBLE) END AS target FROM forecasts)
, o AS (SELECT instrument, ts, event_id, coalesce(last_value(target IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY rn ROWS BETWEEN {HOLD} PRECEDING AND CURRENT ROW), 0) AS held FROM a)"""
R.add("o05_stream_carry", carry_query, sql("forecasts", _CARRY + columns("instrument event_id", "held", "o")))
R.add("o10_seeded_carry", seeded_query, sql("forecasts", _CARRY + columns("instrument event_id", "held", f"o WHERE ts >= '{TAKE_OVER}'")))

# Alerts (O8) ------------------------------------------------------------------------------------

#: Drawdowns, loss of a day that are reported, the loss that trips the breaker, and minutes of silence.
DRAWDOWN_HIGH, DRAWDOWN, DAY_LOSS, BREAKER, SILENT = 0.12, 0.08, -0.025, -0.15, 60
ALERTS = "instrument string, raised_at timestamp, tick_id long, alert string"
DELAY = "10 seconds"


class Alerts(StatefulProcessor):
    """Alerts of equity and of silence: peak, start of the day, breaker, and the last tick are state; silence is a timer."""

    def __init__(self, minutes: int = SILENT):
        self.wait = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.equity = handle.getValueState("equity", "peak double, day string, start double, broken boolean")
        self.last = handle.getValueState("last", "ms long, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        peak, day, start, broken = self.equity.get() if self.equity.exists() else (0.0, "", 0.0, False)
        last, told = self.last.get() if self.last.exists() else (None, False)
        out = []
        for r in in_order(rows, ["ts", "tick_id"]).itertuples():
            now = int(r.ts.value // 1_000_000)
            if last is not None and now - last > self.wait and not told:
                out.append((key[0], last + self.wait, None, "silent"))
            last, told = now, False
            if str(r.ts.date()) != day:
                day, start = str(r.ts.date()), r.equity
            peak = max(peak, r.equity)
            loss, down = r.equity / start - 1, 1 - r.equity / peak
            broken = broken or loss <= BREAKER
            out += [(key[0], now, r.tick_id, a) for a in named(broken, down, loss)]
        self.equity.update((peak, day, start, broken))
        self.last.update((last, told))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(last + self.wait)
        yield alert_frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, told = self.last.get()
        if told or expiredTimerInfo.getExpiryTimeInMs() != last + self.wait:
            return
        self.last.update((last, True))
        yield alert_frame([(key[0], last + self.wait, None, "silent")])

    def close(self) -> None:
        pass


def named(broken: bool, down: float, loss: float) -> list[str]:
    """Names of the alerts of a tick."""
    return ["breaker"] * broken + (["drawdown_high"] if down > DRAWDOWN_HIGH else ["drawdown"] if down > DRAWDOWN else []) + ["day_loss"] * (loss < DAY_LOSS)


def alert_frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["instrument", "raised_at", "tick_id", "alert"])
    return frame.assign(raised_at=pd.to_datetime(frame["raised_at"], unit="ms", utc=True).dt.tz_localize(None), tick_id=frame["tick_id"].astype("Int64"))


def stream_alerts(rows: DataFrame, minutes: int = SILENT) -> DataFrame:
    """Alerts of (instrument, ts, tick_id, equity); silence is told when event time has passed it, without a later tick."""
    return stateful(rows.withWatermark("ts", DELAY), KEYS, Alerts(minutes), ALERTS, "EventTime")


def batch_alerts(rows: DataFrame, minutes: int = SILENT) -> DataFrame:
    """The batch twin: running peaks, the first equity of a day, a latched breaker, and gaps up to the end of event time."""
    d = numbered(rows.withColumn("day", F.to_date("ts")), KEYS, ["ts", "tick_id"], "day")
    first = d.groupBy(*KEYS, "day").agg(F.min_by("equity", "rn").alias("start"))
    d = running_max(d.join(first, [*KEYS, "day"]), KEYS, {"peak": "equity"}).withColumn("loss", F.col("equity") / F.col("start") - 1).withColumn("down", 1 - F.col("equity") / F.col("peak"))
    tripped = d.where(F.col("loss") <= BREAKER).groupBy(*KEYS).agg(F.min("rn").alias("trip"))
    d = d.join(tripped, KEYS, "left")
    when = lambda test, name: F.when(test, F.lit(name))
    names = F.array_compact(F.array(
        when(F.col("rn") >= F.col("trip"), "breaker"), when(F.col("down") > DRAWDOWN_HIGH, "drawdown_high"),
        when((F.col("down") > DRAWDOWN) & (F.col("down") <= DRAWDOWN_HIGH), "drawdown"), when(F.col("loss") < DAY_LOSS, "day_loss"),
    ))
    ticked = d.select("instrument", F.col("ts").alias("raised_at"), "tick_id", F.explode(names).alias("alert"))
    gap = F.expr(f"interval {minutes} minutes")
    end = rows.agg((F.max("ts") - F.expr(f"interval {DELAY}")).alias("end"))
    gaps = with_halo(d.select("instrument", "ts", "rn"), KEYS, 1, lambda x, w: x.withColumn("next", F.lead("ts").over(w.base)), ahead=1)
    told = gaps.join(F.broadcast(end)).where((F.col("ts") + gap < F.col("next")) | (F.col("next").isNull() & (F.col("ts") + gap <= F.col("end"))))  # the end of event time is one row
    return ticked.unionByName(told.select("instrument", (F.col("ts") + gap).alias("raised_at"), F.lit(None).cast("long").alias("tick_id"), F.lit("silent").alias("alert")))


def equities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks as the equity of a position five times its money; whole seconds, as timers count milliseconds."""
    return ticks(spark, sf_dir).select("instrument", F.date_trunc("second", "ts").alias("ts"), "tick_id", F.round(10_000 * (1 + 5 * (F.col("price") - 1)), 6).alias("equity"))


def alerts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of a stream of ticks."""
    with rocks(spark):
        return replayed(stream_alerts(landed(equities(spark, sf_dir))))


_Q = "(PARTITION BY instrument ORDER BY ts, tick_id)"
_ALERTS = f""", e AS (SELECT instrument, date_trunc('second', ts) AS ts, tick_id, round(10000 * (1 + 5 * (price - 1)), 6) AS equity FROM ticks)
, f AS (SELECT *, first_value(equity) OVER (PARTITION BY instrument, CAST(ts AS DATE) ORDER BY ts, tick_id) AS start, max(equity) OVER {_Q} AS peak, lead(ts) OVER {_Q} AS next FROM e)
, g AS (SELECT *, equity / start - 1 AS loss, 1 - equity / peak AS down, max(CASE WHEN equity / start - 1 <= {BREAKER} THEN 1 ELSE 0 END) OVER {_Q} AS broken FROM f)
, o AS (SELECT instrument, ts AS raised_at, tick_id, 'breaker' AS alert FROM g WHERE broken = 1 UNION ALL SELECT instrument, ts, tick_id, CASE WHEN down > {DRAWDOWN_HIGH} THEN 'drawdown_high' ELSE 'drawdown' END FROM g WHERE down > {DRAWDOWN}
  UNION ALL SELECT instrument, ts, tick_id, 'day_loss' FROM g WHERE loss < {DAY_LOSS}
  UNION ALL SELECT instrument, ts + INTERVAL {SILENT} MINUTE, NULL, 'silent' FROM g WHERE ts + INTERVAL {SILENT} MINUTE < next OR next IS NULL AND ts + INTERVAL {SILENT} MINUTE <= (SELECT max(ts) FROM e) - INTERVAL 10 SECOND)"""
R.add("o08_stream_alerts", alerts_query, sql("ticks", _ALERTS + columns("instrument raised_at tick_id alert", "", "o")))
R.add("o08_batch_alerts", lambda k, d: batch_alerts(equities(k, d)), sql("ticks", _ALERTS + columns("instrument raised_at tick_id alert", "", "o")))

# Ledger (O6) --------------------------------------------------------------------------------------


class LedgerStep(StatefulProcessor):
    """A strategy's paper ledger: marks what is held at the new mid, moves to the target, and books costs twice."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ledger", "position double, mid double, gross double, ref double, quoted double, trades long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, out = self.state.get() if self.state.exists() else None, []
        for r in in_order(rows, ["ts"]).itertuples():
            held, mid, gross, ref, quoted, trades = state or (0.0, r.mid, 0.0, 0.0, 0.0, 0)
            moved = abs(r.pos - held)
            begins = r.pos != 0 and (held == 0 or (r.pos > 0) != (held > 0))
            state = (r.pos, r.mid, gross + held * (r.mid - mid) / PIP, ref + moved * REFERENCE / 2, quoted + moved * (r.ask - r.bid) / PIP / 2, trades + begins)
            out.append((*key, r.ts, *state))
        self.state.update(state)
        yield pd.DataFrame(out, columns=[*SERIES, "ts", "position", "mid", "gross_pips", "cost_ref_pips", "cost_quoted_pips", "trades"])

    def close(self) -> None:
        pass


LEDGER = "strategy string, instrument string, ts timestamp, position double, mid double, gross_pips double, cost_ref_pips double, cost_quoted_pips double, trades long"


def stream_ledger(rows: DataFrame) -> DataFrame:
    """The paper ledger of (strategy, instrument, ts, pos, mid, bid, ask); ``paper_ledger`` is its batch twin."""
    return stateful(rows, SERIES, LedgerStep(), LEDGER)


def ledger_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paper ledger of all rules as a stream."""
    from ..operators.evaluation_queries import positions

    quotes = bars(spark, sf_dir).select("instrument", "ts", F.col("close").alias("mid"), F.col("bid_close").alias("bid"), F.col("ask_close").alias("ask"))
    rows = positions(spark, sf_dir).select(*SERIES, "ts", "pos").join(quotes, ["instrument", "ts"])
    with rocks(spark):
        out = replayed(stream_ledger(landed(rows, "year")))
    return out.select(*SERIES, "ts", "position", "trades", *((F.col(c) + _OFF).alias(c) for c in ("gross_pips", "cost_ref_pips", "cost_quoted_pips")))


R.add("o06_stream_ledger", ledger_query, sql("bars", _LG + f", o AS (SELECT strategy, instrument, ts, position, trades, gross_pips + {_OFF} AS gross_pips, cost_ref_pips + {_OFF} AS cost_ref_pips, cost_quoted_pips + {_OFF} AS cost_quoted_pips FROM lgr)" + columns("strategy instrument ts trades", "position gross_pips cost_ref_pips cost_quoted_pips", "o", 3)), 3)

# Regimes and weights (O6) -------------------------------------------------------------------------

#: Calls of a rate, and what a weight keeps of itself at each update.
RECENT, MEMORY, STATES = 20, 0.95, 4
ONLINE = "instrument string, event_id long, rn long, p0 double, p1 double, p2 double, p3 double, regime int, updates long, price_weight double, text_weight double"


class Online(StatefulProcessor):
    """Per instrument: the filtered regime, the weights of each regime, and the decision whose outcome the next bar shows.

    The regime model comes as initial state and stays a state variable of its own.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.model = handle.getValueState("model", "emit string, trans string")
        self.filter = handle.getValueState("filter", "p0 double, p1 double, p2 double, p3 double")
        self.pending = handle.getValueState("pending", "close double, regime int, f double, b double, d double")
        self.weights = handle.getMapState("weights", "regime int", "updates long, price double, text double, f string, b string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.model.update((initialState["emit"].iloc[0], initialState["trans"].iloc[0]))

    def learn(self, known: dict, before: tuple, close: float) -> None:
        """Counts the calls of the decision before, now that the price has moved, and moves the weights of its regime."""
        price, regime, f, b, d = before
        if d == 0:
            return
        move = (close > price) - (close < price)
        updates, w_price, w_text, hits_f, hits_b = known[regime]
        hits_f = (hits_f + [int(f == move)])[-RECENT:] if f else hits_f
        hits_b = (hits_b + [int(b == move)])[-RECENT:] if b else hits_b
        if len(hits_f) >= RECENT and len(hits_b) >= RECENT:
            rate_f, rate_b = sum(hits_f) / RECENT, sum(hits_b) / RECENT
            total = rate_f + rate_b + 1e-8
            w_price = MEMORY * w_price + (1 - MEMORY) * rate_f / total
            w_text = MEMORY * w_text + (1 - MEMORY) * rate_b / total
            updates += 1
        known[regime] = (updates, w_price, w_text, hits_f, hits_b)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import numpy as np

        emit, trans = (np.array(json.loads(x)) for x in self.model.get())
        v = np.array(self.filter.get()) if self.filter.exists() else None
        before = self.pending.get() if self.pending.exists() else None
        known = {}
        for r in range(STATES):
            stored = self.weights.getValue((r,)) if self.weights.containsKey((r,)) else None
            known[r] = (0, PRICE_WEIGHTS[r], 1 - PRICE_WEIGHTS[r], [], []) if stored is None else (*stored[:3], json.loads(stored[3]), json.loads(stored[4]))
        out = []
        for r in in_order(rows, ["rn"]).itertuples():
            seen = -0.5 * ((r.x - emit[:, 0]) / emit[:, 1]) ** 2 - np.log(emit[:, 1])
            v = (np.full(STATES, 1 / STATES) if v is None else v @ trans) * np.exp(seen - seen.max())
            v = v / v.sum()
            if before is not None:
                self.learn(known, before, r.close)
            of = before[1] if before is not None else int(r.regime)
            out.append((key[0], r.event_id, r.rn, *v.tolist(), of, *known[of][:3]))
            before = (r.close, int(r.regime), float(r.f_signal), float(r.b_signal), float(r.d_signal))
        self.filter.update(tuple(v.tolist()))
        self.pending.update(before)
        for r, (n, p, t, f, b) in known.items():
            self.weights.updateValue((r,), (n, p, t, json.dumps(f), json.dumps(b)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ONLINE.split(", ")])

    def close(self) -> None:
        pass


def model_seed(states: DataFrame, moves: DataFrame) -> DataFrame:
    """(instrument, emit, trans): the regime model of each instrument as JSON matrices, for the initial state."""
    n = F.explode(F.array(*(F.lit(i) for i in range(STATES)))).alias("state")
    grid = states.select("instrument").distinct().select("instrument", n)
    full = grid.join(states, ["instrument", "state"], "left").select("instrument", "state", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("vol", F.lit(1.0)).alias("vol"))
    emit = full.groupBy("instrument").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("state", "mean", "vol"))), lambda s: F.array(s["mean"], s["vol"]))).alias("emit"))
    line = moves.groupBy("instrument", "before").agg(F.transform(F.sort_array(F.collect_list(F.struct("state", "p"))), lambda s: s["p"]).alias("line"))
    trans = line.groupBy("instrument").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("before", "line"))), lambda s: s["line"])).alias("trans"))
    return emit.join(trans, "instrument")


def online_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions with their log returns, as the regime filter and the weights take them."""
    d = with_halo(decisions(spark, sf_dir), KEYS, 1, lambda x, w: x.withColumn("x", F.coalesce(F.log(F.col("close") / w.lag("close")), F.lit(0.0))))
    return settled(d.select("instrument", "ts", "event_id", "rn", "close", "x", "regime", *(F.col(c).cast("double").alias(c) for c in ("f_signal", "b_signal", "d_signal"))))


def stream_online(rows: DataFrame, seed: DataFrame) -> DataFrame:
    """Filtered regimes and learned weights after each row; the twins are ``forward_filter`` and ``learned_weights``."""
    return stateful(rows, KEYS, Online(), ONLINE, seed=seed)


def online(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regimes and weights of all decisions as a stream."""
    rows = online_rows(spark, sf_dir)
    seed = settled(model_seed(*regime_model(rows)))
    with rocks(spark):
        return replayed(stream_online(landed(rows), seed))


def newest_weights(out: DataFrame) -> DataFrame:
    """The weights that each regime was left with."""
    return out.groupBy("instrument", "regime").agg(F.max_by(F.struct("updates", "price_weight", "text_weight"), "rn").alias("s")).select("instrument", "regime", "s.*")


_NEWEST = REPORT_SQL["d03_learned_weights"]
R.add("o06_stream_filter", lambda k, d: online(k, d).select("instrument", "event_id", "rn", "p0", "p1", "p2", "p3"))
R.add("o06_stream_weights", lambda k, d: newest_weights(online(k, d)).join(took_sides(decisions(k, d)), ["instrument", "regime"], "left_semi"), _NEWEST)


def took_sides(rows: DataFrame) -> DataFrame:
    """(instrument, regime) in which a decision took a side and saw the next bar."""
    d = with_halo(rows, KEYS, 1, lambda x, w: x.withColumn("_next", F.lead("close").over(w.base)), ahead=1)
    return d.where("d_signal <> 0 and _next is not null").select("instrument", "regime").distinct()


# Sinks of micro-batches (O3, O7, S19) ---------------------------------------------------------------


def to_journal(stream: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, keys: list[str], first: bool = False, order: list[str] | None = None, checkpoint: str | None = None) -> None:
    """Runs a stream to its end; each micro-batch goes through ``build`` and is committed to a journal under its own number.

    A batch that is replayed after a failure overwrites what it wrote before, and touches nothing else.
    With ``first``, a key that an earlier batch has is never written again.
    """

    def commit(batch: DataFrame, number: int) -> None:
        commit_batch(build(batch), path, number, keys, first=first, order=order)

    query = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint or f"{stream_folder(stream.sparkSession)}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def orders_of(rows: DataFrame, strategy: str = "top", units: int = 10_000) -> DataFrame:
    """One order per row whose target is not flat, tagged with its bar and strategy."""
    tag = F.concat_ws("-", F.date_format("ts", "yyyyMMddHHmm"), F.lit(strategy), "instrument")
    return rows.where("target <> 0").select(tag.alias("tag"), "instrument", "ts", "event_id", (F.col("target") * units).cast("long").alias("units"), F.to_date("ts").alias("day"))


def orders_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a stream in which every bar arrives again a week later with the opposite target: a tag is ordered once."""
    rows = forecasts(spark, sf_dir).select("instrument", "ts", "event_id", F.col("signal").cast("double").alias("target"))
    again = rows.select("instrument", "ts", "event_id", (-F.col("target")).alias("target"), (F.col("ts") + F.expr("interval 7 days")).alias("arrived"))
    path = f"{stream_folder(spark)}/orders"
    to_journal(landed(rows.withColumn("arrived", F.col("ts")).unionByName(again), by="arrived"), orders_of, path, ["tag"], first=True, order=["ts", "event_id"])
    return read_journal(spark, path, ["tag"]).groupBy("instrument").agg(F.count("*").alias("orders"), F.count_distinct("tag").alias("tags"), F.sum("units").alias("units"))


R.add(
    "o03_orders_once", orders_query,
    sql("forecasts", ", t AS (SELECT instrument, strftime(ts, '%Y%m%d%H%M') AS tag, arg_min(signal, (ts, event_id)) AS s FROM forecasts WHERE signal <> 0 GROUP BY ALL) SELECT instrument, count(*) AS orders, count(*) AS tags, CAST(sum(s * 10000) AS BIGINT) AS units FROM t GROUP BY instrument"),
)


def macro_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of a stream, each with the macro values public at its time, from a snapshot that every batch rereads."""
    base, names = stream_folder(spark), ["value", "zscore"]
    obs = six(derived(availability(macro_obs(spark, sf_dir)))).select("series", "date", "available_at", *names)
    obs.write.parquet(f"{base}/snapshot")

    def joined(batch: DataFrame) -> DataFrame:
        snapshot = batch.sparkSession.read.parquet(f"{base}/snapshot")
        return as_of(settled(batch), snapshot, names).withColumn("day", F.date_trunc("year", "ts").cast("date"))

    to_journal(landed(bars(spark, sf_dir).select("instrument", "ts", "close"), "year", 3), joined, f"{base}/out", ["instrument", "series", "ts"])
    return read_journal(spark, f"{base}/out", ["instrument", "series", "ts"]).select("instrument", "series", "ts", *names)


R.add("o07_stream_macro", macro_query, MARKET_SQL["m04_as_of_join"], 9)
# Distinct news (O4) -----------------------------------------------------------------------------------


def news_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashes of a stream of news, each told once, however often and in whatever batch it comes again."""
    rows = news(spark, sf_dir).select("text_hash", "doc_id", F.col("published_at").alias("ts")).where("text_hash is not null")
    return replayed(stream_distinct(landed(rows), ["text_hash"], "90 days")).select("text_hash")


R.add("o04_stream_news", news_query, sql("news", " SELECT DISTINCT text_hash FROM news WHERE text_hash IS NOT NULL"))

# Price stream (S12) ---------------------------------------------------------------------------------

PRICE = "id long, type string, instrument string, bids array<struct<price:string>>, asks array<struct<price:string>>"


def price_lines(rows: DataFrame) -> DataFrame:
    """(ts, value): ticks as lines of a price feed: prices and heartbeats, of which some break off and some lack a side."""
    side = lambda c: F.array(F.struct(F.col(c).cast("string").alias("price")))
    k = F.pmod("tick_id", F.lit(50))
    kind = F.when(k == 7, "HEARTBEAT").otherwise("PRICE")
    line = F.to_json(F.struct(F.col("tick_id").alias("id"), kind.alias("type"), "instrument", side("bid").alias("bids"), F.when(k != 11, side("ask")).alias("asks")))
    return rows.select("ts", F.when(k == 23, F.substring(line, 1, 40)).otherwise(line).alias("value"))


def parsed_prices(lines: DataFrame) -> DataFrame:
    """Lines of a feed with best bid and ask, mid and spread (five digits), and ``fault``: null, 'heartbeat', 'broken' or 'no price'."""
    d = lines.withColumn("_p", F.from_json("value", PRICE, {"mode": "PERMISSIVE"}))
    d = d.withColumn("bid", F.expr("try_cast(get(_p.bids, 0).price as double)")).withColumn("ask", F.expr("try_cast(get(_p.asks, 0).price as double)"))
    broken = F.col("_p.type").isNull() | F.col("_p.id").isNull() | (~F.trim("value").endswith("}"))
    fault = F.when(broken, "broken").when(F.col("_p.type") == "HEARTBEAT", "heartbeat").when(F.col("bid").isNull() | F.col("ask").isNull(), "no price")
    return d.select(
        F.col("_p.id").alias("tick_id"), F.col("_p.instrument").alias("instrument"), "bid", "ask", ((F.col("bid") + F.col("ask")) / 2).alias("mid"), F.round(F.col("ask") - F.col("bid"), 5).alias("spread"), fault.alias("fault"), "value"
    )


def feed(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Runs the price stream of all ticks to its end: folders of good prices and of dead letters.

    Lines are read as text; each micro-batch is parsed once, and written to both under its number.
    """
    base = stream_folder(spark)

    def both(batch: DataFrame, number: int) -> None:
        parsed = settled(parsed_prices(batch).where("fault is null or fault <> 'heartbeat'"))
        good, dead = F.col("fault").isNull(), F.col("fault").isNotNull()
        for name, rows in (("prices", parsed.where(good).drop("fault", "value")), ("dead", parsed.where(dead).select("fault", "value"))):
            rows.write.mode("overwrite").parquet(f"{base}/{name}/batch={number}")

    lines = landed(price_lines(ticks(spark, sf_dir))).select("value")
    lines.writeStream.foreachBatch(both).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return f"{base}/prices", f"{base}/dead"


R.add(
    "s12_price_stream", lambda k, d: k.read.parquet(feed(k, d)[0]).drop("batch"),
    sql("ticks", ", o AS (SELECT tick_id, instrument, bid, ask, (bid + ask) / 2 AS mid, round(ask - bid, 5) AS spread FROM ticks WHERE tick_id % 50 NOT IN (7, 11, 23))" + columns("tick_id instrument", "bid ask mid spread", "o", 8)), 8,
)
R.add("s12_dead_letters", lambda k, d: k.read.parquet(feed(k, d)[1]).groupBy("fault").agg(F.count("*").alias("n")), sql("ticks", " SELECT CASE WHEN tick_id % 50 = 23 THEN 'broken' ELSE 'no price' END AS fault, count(*) AS n FROM ticks WHERE tick_id % 50 IN (11, 23) GROUP BY 1"))
QUERIES, ORACLE_SQL = R.queries, R.sql
