"""Splits, macro views and training panels in full: purged folds, deployment windows, run-ups, release calendars, daily derivations, scaled targets, windows of several features, scaling per block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import numbered, ratio, with_halo
from ..plans.registry import Registry, columns
from ..sources.views import KEYS, bars, macro_obs, news, sql, table
from .decisions import N
from .feature_queries import _CAL
from .features import future_calendar
from .market import RULES
from .quality import candles
from .refit import _BLOCKS, WARM_UP, blocks_of, run_up, test_rows, train_rows

R = Registry()

# Folds and windows (J3, J4, J12) --------------------------------------------------------------------

#: Folds, rows kept away on either side, least rows of a training and of a test part.
FOLDS, EMBARGO, LEAST_TRAIN, LEAST_TEST = 6, 10, 50, 10


def purged_rows(rows: DataFrame, folds: int = FOLDS, embargo: int = EMBARGO) -> DataFrame:
    """(instrument, fold, rn, role): each row once per fold, as test or as train; rows within ``embargo`` of a test part are in neither.

    Folds are contiguous; the first ones have a row more where the rows don't divide. A fold with fewer than
    LEAST_TRAIN or LEAST_TEST rows is left out.
    """
    n = rows.groupBy("instrument").agg(F.count("*").alias("n"))
    base, extra = F.floor(F.col("n") / folds), F.col("n") % folds
    bounds = n.select("instrument", "n", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    bounds = bounds.withColumn("first", F.col("fold") * base + F.least("fold", extra) + 1).withColumn("last", F.col("first") + base + F.when(F.col("fold") < extra, 1).otherwise(0) - 1)
    train = F.greatest(F.col("first") - 1 - embargo, F.lit(0)) + F.greatest(F.col("n") - F.col("last") - embargo, F.lit(0))
    kept = bounds.where((train >= LEAST_TRAIN) & (F.col("last") - F.col("first") + 1 >= LEAST_TEST))
    place = F.col("rn")
    role = F.when(place.between(F.col("first"), F.col("last")), "test").when((place < F.col("first") - embargo) | (place > F.col("last") + embargo), "train")
    return rows.select("instrument", "rn").join(kept, "instrument").withColumn("role", role).where("role is not null").select("instrument", "fold", "rn", "role")


R.add(
    "j03_purged_rows", lambda k, d: purged_rows(bars(k, d)).groupBy("instrument", "fold", "role").agg(F.count("*").alias("n"), F.min("rn").alias("first"), F.max("rn").alias("last"), F.sum("rn").alias("total")),
    sql("bars", f""", f AS (SELECT *, ntile({FOLDS}) OVER (PARTITION BY instrument ORDER BY rn) - 1 AS fold FROM bars), b AS (SELECT instrument, fold, min(rn) AS a, max(rn) AS z FROM f GROUP BY ALL)
, r AS (SELECT f.instrument, CAST(b.fold AS INTEGER) AS fold, f.rn, CASE WHEN f.rn BETWEEN a AND z THEN 'test' WHEN f.rn < a - {EMBARGO} OR f.rn > z + {EMBARGO} THEN 'train' END AS role FROM f JOIN b USING (instrument))
, k AS (SELECT instrument, fold FROM r GROUP BY ALL HAVING count(*) FILTER (role = 'train') >= {LEAST_TRAIN} AND count(*) FILTER (role = 'test') >= {LEAST_TEST})
SELECT instrument, fold, role, count(*) AS n, min(rn) AS first, max(rn) AS last, CAST(sum(rn) AS BIGINT) AS total FROM r JOIN k USING (instrument, fold) WHERE role IS NOT NULL GROUP BY ALL"""),
)


def deployment_split(rows: DataFrame, months: int = 12, embargo: int = 5, held: int = 2, least: int = 200) -> DataFrame:
    """(instrument, train_start, train_end, n_train, n_fit, n_validation): the newest ``months`` up to the embargo, of which the last ``held`` months validate, if they have over ``least`` rows."""
    end = rows.groupBy("instrument").agg((F.max("ts") - F.expr(f"interval {embargo} days")).alias("end"))
    inside = rows.join(end, "instrument").where((F.col("ts") <= F.col("end")) & (F.col("ts") > F.expr(f"end - interval {months} months")))
    cut = inside.groupBy("instrument").agg(F.expr(f"max(ts) - interval {held} months").alias("cut"))
    late = F.count(F.when(F.col("ts") >= F.col("cut"), 1))
    out = inside.join(cut, "instrument").groupBy("instrument").agg(F.min("ts").alias("train_start"), F.max("ts").alias("train_end"), F.count("*").alias("n_train"), late.alias("late"))
    validation = F.when(F.col("late") > least, F.col("late")).otherwise(0).cast("long")
    return out.select("instrument", "train_start", "train_end", "n_train", (F.col("n_train") - validation).alias("n_fit"), validation.alias("n_validation"))


for _name, _least in (("", 200), ("_of_days", 40)):  # 200 rows are two months of short bars; days have fewer
    R.add(
        f"j04_deployment_split{_name}", lambda k, d, least=_least: deployment_split(bars(k, d), least=least),
        sql("bars", f""", i AS (SELECT *, max(ts) OVER (PARTITION BY instrument) - INTERVAL 5 DAY AS z FROM bars), w AS (SELECT *, max(ts) OVER (PARTITION BY instrument) - INTERVAL 2 MONTH AS cut FROM i WHERE ts <= z AND ts > z - INTERVAL 12 MONTH)
, c AS (SELECT instrument, min(ts) AS train_start, max(ts) AS train_end, count(*) AS n_train, count(*) FILTER (ts >= cut) AS late FROM w GROUP BY ALL) SELECT instrument, train_start, train_end, n_train, n_train - CASE WHEN late > {_least} THEN late ELSE 0 END AS n_fit, CASE WHEN late > {_least} THEN late ELSE 0 END AS n_validation FROM c"""),
    )


def blocks_with_run_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per refit block: rows of its window, of its test, and of the run-up of WARM_UP rows before it, as a model that is asked for the test reads them."""
    rows, blocks = bars(spark, sf_dir), blocks_of(spark, sf_dir)
    tests = test_rows(rows, blocks)
    parts = [(train_rows(rows, blocks), "train"), (tests, "test"), (run_up(rows, tests), "run_up")]
    counts = [d.groupBy("instrument", "block_id").agg(F.count("*").alias(f"n_{n}"), F.min("rn").alias(f"first_{n}")) for d, n in parts]
    return counts[0].join(counts[1], ["instrument", "block_id"]).join(counts[2], ["instrument", "block_id"], "left")


R.add(
    "j12_blocks_with_run_up", blocks_with_run_up,
    sql("bars", _BLOCKS + f""", t AS (SELECT blk.instrument, block_id, count(*) AS n_test, min(rn) AS first_test FROM blk JOIN bars ON bars.instrument = blk.instrument AND date_trunc('month', ts) BETWEEN test_start AND test_end GROUP BY ALL)
, r AS (SELECT blk.instrument, block_id, n_train, min(rn) AS first_train FROM blk JOIN bars ON bars.instrument = blk.instrument AND ts BETWEEN train_start AND train_end GROUP BY ALL)
SELECT instrument, block_id, n_train, first_train, n_test, first_test, least(first_test - 1, {WARM_UP}) AS n_run_up, greatest(first_test - {WARM_UP}, 1) AS first_run_up FROM t JOIN r USING (instrument, block_id)"""),
)

# Macro (M1, M2) --------------------------------------------------------------------------------------


def availability(obs: DataFrame, releases: DataFrame) -> DataFrame:
    """Adds ``available_at``: daily series a day later at 14:00, weekly ones on the next Monday at 21:00, monthly ones on their day of ``releases`` (series, date, release) at 14:00, or a month and 19 days later where none is known."""
    rule = F.element_at(F.create_map(*(F.lit(x) for kv in RULES.items() for x in kv)), F.col("series"))
    d = obs.join(releases, ["series", "date"], "left")
    public = F.when(rule == "daily", F.expr("date + interval 38 hours")).when(rule == "weekly", F.expr("date + make_interval(0, 0, 0, 7 - weekday(date), 21)"))
    return d.withColumn("available_at", public.when(rule == "monthly", F.coalesce("release", F.expr("date + interval 1 month + interval 19 days")) + F.expr("interval 14 hours"))).drop("release")


def release_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, date, release): an observation is released ten days after the day its month's last order was made; some releases are unknown."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.date_trunc("month", "o_orderdate").alias("date")).agg(F.max("o_orderdate").alias("_last"))
    return o.where(F.month("date") % 4 != 0).select("series", "date", (F.date_trunc("day", "_last") + F.expr("interval 10 days")).alias("release"))


R.add(
    "m01_release_calendar", lambda k, d: availability(macro_obs(k, d), release_calendar(k, d)),
    sql("macro_obs", """, rel AS (SELECT o_orderpriority AS series, date_trunc('month', o_orderdate) AS date, date_trunc('day', max(o_orderdate)) + INTERVAL 10 DAY AS release FROM orders WHERE month(o_orderdate) % 4 <> 0 GROUP BY 1, 2)
, o AS (SELECT m.*, CASE WHEN m.series IN ('1-URGENT', '2-HIGH') THEN m.date + INTERVAL 38 HOUR WHEN m.series = '3-MEDIUM' THEN m.date + to_days(CAST(8 - isodow(m.date) AS INTEGER)) + INTERVAL 21 HOUR ELSE coalesce(release, m.date + INTERVAL 1 MONTH + INTERVAL 19 DAY) + INTERVAL 14 HOUR END AS available_at FROM macro_obs AS m LEFT JOIN rel ON rel.series = m.series AND rel.date = m.date)""" + columns("series date available_at", "value", "o", 8)), 8,
)

#: Observations of a z-score and of a yearly change; levels that are flagged.
Z_ROWS, YEAR_ROWS, HIGH, LOW = 252, 12, 180_000.0, 120_000.0


def daily_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily macro observations: the mean order total per priority and day, from whole cents."""
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.date_trunc("day", "o_orderdate").alias("date")).agg((cents / F.count("*") / 100).alias("value"))


def derivations(obs: DataFrame) -> DataFrame:
    """Per series in its own observations: z-score over Z_ROWS, flags of a high and of a low level, and the percent change over YEAR_ROWS."""
    d = numbered(obs.withColumnRenamed("date", "ts"), ["series"], ["ts"], "year")

    def build(x: DataFrame, w) -> DataFrame:
        z = ratio(F.col("value") - w.full(F.avg, "value", Z_ROWS), w.full(F.stddev_samp, "value", Z_ROWS))
        return x.withColumn("zscore", z).withColumn("change", (F.col("value") / F.nullif(w.lag("value", YEAR_ROWS), F.lit(0.0)) - 1) * 100)

    d = with_halo(d, ["series"], Z_ROWS, build)
    flagged = lambda test: F.when(test, 1.0).otherwise(0.0)
    return d.select("series", F.col("ts").alias("date"), "zscore", flagged(F.col("value") > HIGH).alias("high"), flagged(F.col("value") < LOW).alias("low"), "change")


R.add(
    "m02_daily_derivations", lambda k, d: derivations(daily_obs(k, d)),
    f"""WITH m AS (SELECT o_orderpriority AS series, date_trunc('day', o_orderdate) AS date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS value FROM orders GROUP BY ALL)
, o AS (SELECT series, date, CASE WHEN count(value) OVER l = {Z_ROWS} THEN (value - avg(value) OVER l) / nullif(stddev_samp(value) OVER l, 0) END AS zscore, CASE WHEN value > {HIGH} THEN 1.0::DOUBLE ELSE 0 END AS high, CASE WHEN value < {LOW} THEN 1.0::DOUBLE ELSE 0 END AS low, (value / nullif(lag(value, {YEAR_ROWS}) OVER w, 0) - 1) * 100 AS change
  FROM m WINDOW w AS (PARTITION BY series ORDER BY date), l AS (PARTITION BY series ORDER BY date ROWS BETWEEN {Z_ROWS - 1} PRECEDING AND CURRENT ROW))""" + columns("series date", "zscore high low change", "o"),
)

# Targets, windows, scaling (L5, L6, L7) ---------------------------------------------------------------

HORIZONS = range(1, 13)
#: Lengths of model windows.
LENGTHS = (60, 120, 128)


def scaled_targets(rows: DataFrame) -> DataFrame:
    """(instrument, ts, target_1..target_12): sums of the next returns over each horizon, by the population deviation of that horizon in the series."""

    def build(d: DataFrame, w) -> DataFrame:
        d = d.withColumn("_r", F.log(F.col("close") / w.lag("close")))
        return d.select(*d.columns, *(F.when(F.count("_r").over(w(1, h)) == h, F.sum("_r").over(w(1, h))).alias(f"_c{h}") for h in HORIZONS))

    d = with_halo(rows, KEYS, 1, build, ahead=max(HORIZONS) + 1).where(f"_c{max(HORIZONS)} is not null")
    std = d.groupBy(*KEYS).agg(*(F.stddev_pop(f"_c{h}").alias(f"_s{h}") for h in HORIZONS))
    return d.join(std, KEYS).select("instrument", "ts", *(ratio(F.col(f"_c{h}"), F.col(f"_s{h}")).alias(f"target_{h}") for h in HORIZONS))


_T12 = " ".join(f"target_{h}" for h in HORIZONS)
R.add(
    "l05_scaled_targets", lambda k, d: scaled_targets(bars(k, d)),
    sql("bars", ", a AS (SELECT *, " + ", ".join(f"ln(lead(close, {h}) OVER {N} / close) AS c{h}" for h in HORIZONS) + " FROM bars), w AS (SELECT * FROM a WHERE c12 IS NOT NULL), o AS (SELECT instrument, ts, " + ", ".join(f"c{h} / nullif(stddev_pop(c{h}) OVER (PARTITION BY instrument), 0) AS target_{h}" for h in HORIZONS) + " FROM w)" + columns("instrument ts", _T12, "o", 5)), 5,
)


def model_windows(rows: DataFrame, length: int) -> DataFrame:
    """(instrument, ts, window, label): the last ``length`` bars as structs of return, range and volume, where all are known, labelled by the sign of the next move."""

    def build(d: DataFrame, w) -> DataFrame:
        d = d.withColumn("_r", F.log(F.col("close") / w.lag("close"))).withColumn("_label", F.signum(F.lead("close").over(w.base) - F.col("close")).cast("int"))
        one = F.when(F.col("_r").isNotNull(), F.struct(F.col("_r").alias("ret"), ((F.col("high") - F.col("low")) / F.col("close")).alias("range"), F.col("volume").cast("double").alias("volume")))
        return d.withColumn("window", F.collect_list(one).over(w(1 - length))).where(F.size("window") == length)

    return with_halo(rows, KEYS, length + 1, build, ahead=1).select("instrument", "ts", "window", F.col("_label").alias("label"))


def total_of(name: str) -> Column:
    """Sum of a field over a window."""
    return F.aggregate("window", F.lit(0.0), lambda s, x: s + x[name])


for _len in LENGTHS:
    _v = f"v AS (PARTITION BY instrument ORDER BY rn ROWS BETWEEN {_len - 1} PRECEDING AND CURRENT ROW)"
    R.add(
        f"l06_windows_{_len}", lambda k, d, n=_len: model_windows(bars(k, d), n).select("instrument", "ts", "label", F.size("window").alias("n"), *(total_of(c).alias(f"sum_{c}") for c in ("ret", "range", "volume")), F.col("window")[0]["ret"].alias("first_ret")),
        sql("bars", f""", a AS (SELECT *, ln(close / lag(close) OVER {N}) AS r, (high - low) / close AS g, CAST(sign(lead(close) OVER {N} - close) AS INTEGER) AS label FROM bars), o AS (SELECT instrument, ts, label, {_len} AS n, count(r) OVER v AS k, sum(r) OVER v AS sum_ret, sum(g) OVER v AS sum_range, CAST(sum(volume) OVER v AS DOUBLE) AS sum_volume, first_value(r) OVER v AS first_ret FROM a WINDOW {_v})"""
            + columns("instrument ts label n", "sum_ret sum_range sum_volume first_ret", f"o WHERE k = {_len}")),
    )


def block_scaled(rows: DataFrame, blocks: DataFrame, names: list[str]) -> DataFrame:
    """(instrument, ts, block_id, names): test rows of each block, missing values as the window's median, standardised by mean and population deviation of the window.

    Medians are exact; a window is a stated number of months.
    """
    train = train_rows(rows, blocks)
    middle = train.groupBy("instrument", "block_id").agg(*(F.percentile(c, F.lit(0.5)).alias(f"_m_{c}") for c in names))
    filled = train.join(middle, ["instrument", "block_id"]).select("instrument", "block_id", *(F.coalesce(c, f"_m_{c}").alias(c) for c in names))
    fit = filled.groupBy("instrument", "block_id").agg(*(F.avg(c).alias(f"_a_{c}") for c in names), *(F.stddev_pop(c).alias(f"_s_{c}") for c in names)).join(middle, ["instrument", "block_id"])
    out = test_rows(rows, blocks).join(fit, ["instrument", "block_id"])
    return out.select("instrument", "ts", "block_id", *(ratio(F.coalesce(c, f"_m_{c}") - F.col(f"_a_{c}"), F.col(f"_s_{c}")).alias(c) for c in names))


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with three features, of which two are missing at times."""

    def build(d: DataFrame, w) -> DataFrame:
        d = d.withColumn("ret", F.log(F.col("close") / w.lag("close"))).withColumn("away", F.when(F.col("rn") % 5 != 0, F.col("close") / w.full(F.avg, "close", 200) - 1))
        return d.withColumn("busy", F.when(F.col("volume") % 7 != 0, F.col("volume").cast("double")))

    return with_halo(bars(spark, sf_dir), KEYS, 201, build).select("instrument", "ts", "rn", "ret", "away", "busy")


_NAMES = ("ret", "away", "busy")
R.add(
    "l07_block_scaling", lambda k, d: block_scaled(gappy(k, d), blocks_of(k, d), list(_NAMES)),
    sql("bars", _BLOCKS + f""", g AS (SELECT instrument, ts, rn, ln(close / lag(close) OVER {N}) AS ret, CASE WHEN rn % 5 <> 0 AND rn >= 200 THEN close / avg(close) OVER (PARTITION BY instrument ORDER BY rn ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) - 1 END AS away, CASE WHEN volume % 7 <> 0 THEN CAST(volume AS DOUBLE) END AS busy FROM bars)
, t AS (SELECT g.*, block_id FROM g JOIN blk ON blk.instrument = g.instrument AND ts BETWEEN train_start AND train_end), md AS (SELECT instrument, block_id, {', '.join(f'quantile_cont({c}, 0.5) AS m_{c}' for c in _NAMES)} FROM t GROUP BY ALL)
, ft AS (SELECT instrument, block_id, {', '.join(f'avg(coalesce({c}, m_{c})) AS a_{c}, stddev_pop(coalesce({c}, m_{c})) AS s_{c}, any_value(m_{c}) AS m_{c}' for c in _NAMES)} FROM t JOIN md USING (instrument, block_id) GROUP BY ALL)
, o AS (SELECT g.instrument, g.ts, blk.block_id, {', '.join(f'(coalesce({c}, m_{c}) - a_{c}) / nullif(s_{c}, 0) AS {c}' for c in _NAMES)} FROM g JOIN blk ON blk.instrument = g.instrument AND date_trunc('month', g.ts) BETWEEN test_start AND test_end JOIN ft ON ft.instrument = blk.instrument AND ft.block_id = blk.block_id)""" + columns("instrument ts block_id", "ret away busy", "o")),
)

# Calendar of the next bars (F23) ----------------------------------------------------------------------

_CYCLES = "hour_sin hour_cos dow_sin dow_cos dom_sin dom_cos"
R.add(
    "f23_next_candles", lambda k, d: future_calendar(candles(k, d), minutes=5),
    sql("ticks", f""", l AS (SELECT event_type AS instrument, time_bucket(INTERVAL 5 MINUTE, max(ts)) AS z FROM events GROUP BY 1), n AS (SELECT instrument, unnest(generate_series(z + INTERVAL 5 MINUTE, z + INTERVAL 60 MINUTE, INTERVAL 5 MINUTE)) AS ts FROM l), o AS ({_CAL} FROM n)""" + columns("instrument ts is_overlap is_london", _CYCLES, "o")),
)

# News that was not seen before (N7) ---------------------------------------------------------------------


def unseen(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """The first article of each hash in a batch, by time and id, whose hash is not among those seen."""
    first = Window.partitionBy("text_hash").orderBy("published_at", "doc_id")
    fresh = batch.where("text_hash is not null").withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    return fresh.join(seen.select("text_hash").distinct(), "text_hash", "left_anti")


CUT = "2024-01-16"
R.add(
    "n07_unseen_news", lambda k, d: unseen((x := news(k, d)).where(F.col("published_at") >= F.lit(CUT).cast("timestamp")), x.where(F.col("published_at") < F.lit(CUT).cast("timestamp"))).select("doc_id", "published_at", "text_hash"),
    sql("news", f", b AS (SELECT * FROM news WHERE published_at >= '{CUT}' AND text_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text_hash ORDER BY published_at, doc_id) = 1) SELECT doc_id, published_at, text_hash FROM b WHERE text_hash NOT IN (SELECT text_hash FROM news WHERE published_at < '{CUT}' AND text_hash IS NOT NULL)"),
)
QUERIES, ORACLE_SQL = R.queries, R.sql
