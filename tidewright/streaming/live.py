"""Streams over landed files: bars, distinct news, and state per key, each with a batch twin.

A stream is read with a schema, its times cast to instants (watermarks need them), and run with
``availableNow``, so that the queries below replay a folder to its end. On a cluster, the same plans
run with a processing-time trigger and a topic as source. State is kept by Spark: windows and
deduplication under a watermark, and ``applyInPandasWithState`` per key where a value depends on its
own past.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.windows import numbered, running_sum, shared_folder, with_halo
from ..plans.registry import Registry, columns
from ..sources.views import HALF_SPREAD, sql, ticks

R = Registry()


def stream_folder(spark: SparkSession) -> str:
    """A new folder for a stream's output and checkpoint, below the one that all executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream of ticks."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)
    price = 1 + F.col("value") / 1e4
    return rows.select(
        F.col("event_type").alias("instrument"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tick_id"), price.alias("price"),
        (price - HALF_SPREAD).alias("bid"), (price + HALF_SPREAD).alias("ask"), F.get_json_object("props", "$.k").cast("int").alias("size"),
    )


def replayed(stream: DataFrame, mode: str = "append", base: str | None = None) -> DataFrame:
    """Runs a stream to the end of its source into files, and reads them; with the ``base`` of an earlier run, it goes on from there."""
    spark = stream.sparkSession
    base = base or stream_folder(spark)
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").format("parquet").trigger(availableNow=True).start(f"{base}/out")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def landed(rows: DataFrame, unit: str = "week", per_trigger: int = 1, by: str = "ts") -> DataFrame:
    """``rows`` written as a file per calendar unit of ``by``, and read as a stream in that order.

    The source takes files by their times, which are set in the order of units: one call per file.
    """
    spark, base = rows.sparkSession, stream_folder(rows.sparkSession)
    unit_of = F.date_format(F.date_trunc(unit, by), "yyyyMMddHH")
    rows.withColumn("_unit", unit_of).repartition("_unit").sortWithinPartitions("_unit", by).write.partitionBy("_unit").parquet(base)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(p.getPath().toString() for p in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/_unit=*/*.parquet")))
    for i, p in enumerate(parts):
        files.setTimes(spark._jvm.org.apache.hadoop.fs.Path(p), 1_000_000_000_000 + i * 60_000, -1)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{base}/_unit=*")


def stream_bars(rows: DataFrame, length: str = "5 minutes", delay: str = "10 seconds", offset: str = "0 seconds") -> DataFrame:
    """Bars of a stream, each emitted once, when the watermark has passed its end."""
    seq = F.struct("ts", "tick_id")
    out = rows.withWatermark("ts", delay).groupBy("instrument", F.window("ts", length, length, offset).alias("w")).agg(
        F.min_by("price", seq).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", seq).alias("close"), F.sum("size").cast("long").alias("volume")
    )
    return out.select("instrument", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_distinct(rows: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def book(old: tuple[float, float, float, int], units: float, price: float) -> tuple[float, float, float, int]:
    """A position (units, average price, realised, fills) after a fill."""
    held, average, realised, n = old
    new = held + units
    if held and (held > 0) != (units > 0):
        realised += min(abs(held), abs(units)) * (price - average) * (1 if held > 0 else -1)
        average = 0.0 if new == 0 else average if (new > 0) == (held > 0) else price
    else:
        average = (abs(held) * average + abs(units) * price) / (abs(held) + abs(units)) if new else 0.0
    return new, average, realised, n + 1


BOOK = "instrument string, tick_id long, units double, average double, realised double, fills long"


def fills(rows: DataFrame) -> DataFrame:
    """Every tick as a fill: units from its size, bought or sold by the parity of its id."""
    signed = F.when(F.pmod("tick_id", F.lit(2)) == 0, 100.0).otherwise(-100.0) * (F.col("size") + 1)
    return rows.select("instrument", "ts", "tick_id", signed.alias("units"), "price")


def stream_book(rows: DataFrame) -> DataFrame:
    """Position after each fill, per instrument, with its state kept between batches."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (0.0, 0.0, 0.0, 0)
        frame = pd.concat(list(parts)).sort_values(["ts", "tick_id"])  # a key's rows of one trigger, some files
        out = []
        for r in frame.itertuples():
            now = book(now, r.units, r.price)
            out.append((key[0], r.tick_id, *now))
        state.update(now)
        yield pd.DataFrame(out, columns=["instrument", "tick_id", "units", "average", "realised", "fills"])

    return rows.groupBy("instrument").applyInPandasWithState(update, BOOK, "units double, average double, realised double, fills long", "append", GroupStateTimeout.NoTimeout)


def batch_book(rows: DataFrame) -> DataFrame:
    """The batch twin: the last position of each instrument (units, average price, realised, fills), by scans.

    Units held are a running sum. The cost of what is held grows with a fill on its side, shrinks in
    proportion with one against it, and starts anew where the side changes: an affine recurrence, of which
    only the rows from the last start on matter; with the running logarithm of the shrinkage, it is a
    weighted sum. What is realised is that cost, signed, less all money paid so far.
    """
    d = numbered(rows, ["instrument"], ["ts", "tick_id"], "day").withColumn("_money", F.col("units") * F.col("price"))
    d = running_sum(d, ["instrument"], {"held": "units"}).withColumn("_old", F.col("held") - F.col("units"))
    more = F.signum("_old") == F.signum("units")
    starts = (F.signum("held") != F.signum("_old")) | (F.col("_old") == 0)
    d = d.withColumn("_start", starts).withColumn("_add", F.when(starts, F.abs("held") * F.col("price")).when(more, F.abs("units") * F.col("price")).otherwise(0.0))
    d = d.withColumn("_log", F.when(starts | more, 0.0).otherwise(F.log(F.abs("held") / F.nullif(F.abs("_old"), F.lit(0.0)))))
    whole = d.groupBy("instrument").agg(F.max(F.when(F.col("_start"), F.col("rn"))).alias("_from"), F.max_by("held", "rn").alias("units"), F.sum("_money").alias("_paid"), F.count("*").alias("fills"))
    late = running_sum(d.join(whole.select("instrument", "_from"), "instrument").where("rn >= _from"), ["instrument"], {"_so_far": "_log"})
    total = late.groupBy("instrument").agg(F.sum("_log").alias("_total"))
    cost = late.join(total, "instrument").groupBy("instrument").agg(F.sum(F.col("_add") * F.exp(F.col("_total") - F.col("_so_far"))).alias("_cost"))
    out = whole.join(cost, "instrument").withColumn("average", F.when(F.col("units") == 0, 0.0).otherwise(F.col("_cost") / F.nullif(F.abs("units"), F.lit(0.0))))
    return out.select("instrument", "units", "average", (F.signum("units") * F.when(F.col("units") == 0, 0.0).otherwise(F.col("_cost")) - F.col("_paid")).alias("realised"), "fills")


_N = "(PARTITION BY instrument ORDER BY ts, tick_id)"
_BOOK = f""", f AS (SELECT *, CASE WHEN tick_id % 2 = 0 THEN 100.0 ELSE -100.0 END::DOUBLE * (size + 1) AS units FROM ticks), h AS (SELECT *, sum(units) OVER {_N} AS held, row_number() OVER {_N} AS rn FROM f), g AS (SELECT *, held - units AS old, sign(held) <> sign(old) OR old = 0 AS starts FROM h)
, m AS (SELECT *, CASE WHEN starts THEN abs(held) * price WHEN sign(old) = sign(units) THEN abs(units) * price ELSE 0 END AS plus, CASE WHEN starts OR sign(old) = sign(units) THEN 0 ELSE ln(abs(held) / abs(old)) END AS lg FROM g)
, w AS (SELECT instrument, max(rn) FILTER (starts) AS since, arg_max(held, rn) AS units, sum(units * price) AS paid, count(*) AS fills FROM m GROUP BY ALL)
, l AS (SELECT m.instrument, plus, sum(lg) OVER (PARTITION BY m.instrument) - sum(lg) OVER (PARTITION BY m.instrument ORDER BY rn) AS rest FROM m JOIN w ON m.instrument = w.instrument AND rn >= since)
, c AS (SELECT instrument, sum(plus * exp(rest)) AS cost FROM l GROUP BY ALL)
, o AS (SELECT w.instrument, units, CASE WHEN units = 0 THEN 0 ELSE cost / abs(units) END AS average, sign(units) * CASE WHEN units = 0 THEN 0 ELSE cost END - paid AS realised, fills FROM w JOIN c USING (instrument))"""
_END = "(SELECT max(ts) FROM ticks) - INTERVAL 10 SECOND"
R.add(
    "o01_stream_bars", lambda k, d: replayed(stream_bars(tick_stream(k, d))),
    sql("ticks", f", b AS (SELECT instrument, time_bucket(INTERVAL 5 MINUTE, ts) AS t, first(price ORDER BY ts, tick_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, tick_id) AS close, CAST(sum(size) AS BIGINT) AS volume FROM ticks GROUP BY 1, 2) SELECT instrument, t AS ts, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, volume FROM b WHERE t + INTERVAL 5 MINUTE <= {_END}"), 8,
)
R.add(
    "o02_stream_h4", lambda k, d: replayed(stream_bars(tick_stream(k, d), "4 hours", "10 seconds", "2 hours")),
    sql("ticks", f", b AS (SELECT instrument, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '2000-01-01 02:00:00') AS t, first(price ORDER BY ts, tick_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, tick_id) AS close, CAST(sum(size) AS BIGINT) AS volume FROM ticks GROUP BY 1, 2) SELECT instrument, t AS ts, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, volume FROM b WHERE t + INTERVAL 4 HOUR <= {_END}"), 8,
)
R.add("o03_stream_once_per_bar", lambda k, d: replayed(stream_distinct(tick_stream(k, d).select("instrument", F.date_trunc("hour", "ts").alias("ts")), ["instrument", "ts"], "40 days")), sql("ticks", "SELECT DISTINCT instrument, date_trunc('hour', ts) AS ts FROM ticks"))
R.add("t07_o06_stream_book", lambda k, d: replayed(stream_book(landed(fills(ticks(k, d))))).groupBy("instrument").agg(F.max_by(F.struct("units", "average", "realised", "fills"), "fills").alias("s")).select("instrument", "s.*"), sql("ticks", _BOOK + columns("instrument fills", "units average realised", "o", 4)), 4)
R.add("t07_batch_book", lambda k, d: batch_book(fills(ticks(k, d))), sql("ticks", _BOOK + columns("instrument fills", "units average realised", "o", 4)), 4)


def staleness(rows: DataFrame, minutes: int = 60) -> DataFrame:
    """Silent spells: ticks that come more than ``minutes`` after the one before, per instrument."""
    d = numbered(rows, ["instrument"], ["ts", "tick_id"], "day")
    d = with_halo(d, ["instrument"], 1, lambda x, w: x.withColumn("silent", (F.col("ts").cast("double") - w.lag("ts").cast("double")) / 60))
    return d.where(F.col("silent") > minutes).select("instrument", "tick_id", "silent")


R.add("o08_silent_spells", lambda k, d: staleness(ticks(k, d)), sql("ticks", ", a AS (SELECT *, (epoch(ts) - epoch(lag(ts) OVER (PARTITION BY instrument ORDER BY ts, tick_id))) / 60 AS silent FROM ticks) SELECT instrument, tick_id, round(silent, 6) AS silent FROM a WHERE silent > 60"))
QUERIES, ORACLE_SQL = R.queries, R.sql
