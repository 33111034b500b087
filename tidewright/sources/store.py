"""Sources and sinks: payload parsing, keep-last merges, incremental appends, partitioned stores, journals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import settled, shared_folder
from ..plans.registry import Registry, columns
from .views import bars, daily_bars, forecasts, macro_obs, sql, table, ticks

R = Registry()

CANDLE = "time timestamp, complete boolean, volume long, mid struct<o:string,h:string,l:string,c:string>, bid struct<c:string>, ask struct<c:string>"
QUOTE = "instrument string, time timestamp, tradeable boolean, bids array<struct<price:string,liquidity:long>>, asks array<struct<price:string,liquidity:long>>"
#: Fixed value: first time of the sealed holdout.
HOLDOUT = "2001-03-07"


def parse_candles(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Typed candles of JSON payloads; forming ones are left out, broken numbers are null."""
    c = F.from_json(column, CANDLE)
    d = payloads.withColumn("_c", c).where("_c.complete")
    price = {n: F.expr(f"try_cast(_c.{p} as double)") for n, p in (("open", "mid.o"), ("high", "mid.h"), ("low", "mid.l"), ("close", "mid.c"), ("bid_close", "bid.c"), ("ask_close", "ask.c"))}
    return d.select("instrument", F.col("_c.time").alias("ts"), *(v.alias(n) for n, v in price.items()), F.col("_c.volume").alias("volume"))


def candle_payloads(candles: DataFrame) -> DataFrame:
    """Candles as the nested JSON that a price service sends; every tenth is still forming."""
    s = lambda c: F.col(c).cast("string")
    body = F.struct(
        F.col("ts").alias("time"), (F.pmod("rn", F.lit(10)) != 0).alias("complete"), "volume",
        F.struct(s("open").alias("o"), s("high").alias("h"), s("low").alias("l"), s("close").alias("c")).alias("mid"), F.struct(s("bid_close").alias("c")).alias("bid"), F.struct(s("ask_close").alias("c")).alias("ask"),
    )
    return candles.select("instrument", F.to_json(body).alias("payload"))


def keep_last(parts: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the highest ``seq`` of each key."""
    return parts.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in parts.columns if c not in keys)), seq).alias("_r")).select(*keys, "_r.*")


def new_rows(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored rows and the incoming ones after the last stored time of their instrument, on the columns both have."""
    both = [c for c in stored.columns if c in incoming.columns]
    last = stored.groupBy("instrument").agg(F.max("ts").alias("_last"))
    fresh = incoming.join(last, "instrument", "left").where("_last is null or ts > _last")
    return stored.select(*both).unionByName(fresh.select(*both))


def folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


def write_store(candles: DataFrame, path: str, open_month: str = "9999-12") -> None:
    """Merges candles into a store: a part per finished month, and one per day of the months from ``open_month`` on.

    Stored rows of the parts that are written are kept, unless a new row has their time. New parts are
    settled before the old ones are replaced.
    """
    month, day = F.date_format("ts", "yyyy-MM"), F.date_format("ts", "yyyy-MM-dd")
    d = candles.withColumn("period", F.when(month < open_month, month).otherwise(day)).withColumn("_seq", F.lit(2))
    old = existing(candles.sparkSession, path)
    if old is not None:
        touched = [r[0] for r in d.select("period").distinct().collect()]  # the periods of one write, named literally so that the scan is pruned
        d = d.unionByName(old.where(F.col("period").isin(touched)).withColumn("_seq", F.lit(1)), allowMissingColumns=True)
        d = settled(keep_last(d, ["instrument", "ts"], "_seq"))
    d.drop("_seq").repartition("instrument", "period").sortWithinPartitions("ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("instrument", "period").parquet(path)


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored rows, or None where nothing is stored yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    d = spark.read.option("partitionColumnTypeInference.enabled", "false").parquet(path)
    return d.withColumn("period", F.col("period").cast("string")) if "period" in d.columns else d


def compact(spark: SparkSession, path: str, open_month: str) -> int:
    """Folds the day parts of finished months into their month's part; returns the number of day parts.

    The month's part is written first; ``read_store`` passes over the day parts of a month that has one,
    so that a reader sees every row once whenever it looks, and a fold that is cut off can be repeated.
    """
    old = existing(spark, path)
    if old is None:
        return 0
    days = old.where((F.length("period") == 10) & (F.substring("period", 1, 7) < open_month))
    parts = days.select("instrument", "period").distinct().collect()  # one row per folder
    write_store(settled(days.drop("period")), path, open_month)
    for r in parts:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/instrument={r['instrument']}/period={r['period']}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(parts)


def read_store(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, sealed: bool = True) -> DataFrame:
    """Candles of a store between two times; the sealed holdout is left out unless unlocked."""
    d = existing(spark, path)
    months = [r[0] for r in d.where(F.length("period") == 7).select("period").distinct().collect()]  # one row per folder
    folded = spark.createDataFrame([(m,) for m in months], "month string")
    day = F.length("period") == 10
    held = d.where(~day).select("instrument", "period").distinct().withColumnRenamed("period", "month")
    days = d.where(day & F.substring("period", 1, 7).isin(months)).withColumn("month", F.substring("period", 1, 7)).join(F.broadcast(held.join(folded, "month")), ["instrument", "month"], "left_anti").drop("month")
    d = d.where(~day | ~F.substring("period", 1, 7).isin(months)).unionByName(days).drop("period")
    if start:
        d = d.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        d = d.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    return d.where(F.col("ts") < F.lit(HOLDOUT).cast("timestamp")) if sealed else d


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily candles through a store: written, merged with a second write of the last months, and read back."""
    path = folder(spark)
    candles = daily_bars(spark, sf_dir)
    write_store(candles, path, "2001-10")
    write_store(candles.where("ts >= '2001-08-01'"), path, "2001-10")
    compact(spark, path, "2001-11")
    return read_store(spark, path)


# Blocks of forecasts ----------------------------------------------------------------------------


def block_plan(rows: DataFrame) -> DataFrame:
    """(block_id, rows): the blocks that a design needs, one per day of its forecasts."""
    return rows.groupBy("block_id").agg(F.count("*").alias("rows"))


def blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts with the block that they belong to: the day of the month."""
    return forecasts(spark, sf_dir).select("event_id", "instrument", "ts", "signal", "confidence", "regime", F.dayofmonth("ts").alias("block_id"))


def write_blocks(rows: DataFrame, path: str) -> None:
    """Adds blocks to a store, a folder per block; a block that is there already is left as it is."""
    there = stored_blocks(rows.sparkSession, path)
    fresh = rows if there is None else rows.join(there, "block_id", "left_anti")
    fresh.repartition("block_id").write.mode("append").partitionBy("block_id").parquet(path)


def stored_blocks(spark: SparkSession, path: str) -> DataFrame | None:
    """(block_id) of the blocks of a store that hold rows; unreadable files hold none."""
    d = existing(spark, path)
    return None if d is None else spark.read.option("ignoreCorruptFiles", "true").parquet(path).select(F.col("block_id").cast("int")).distinct()


def missing_blocks(plan: DataFrame, path: str, shard: tuple[int, int] | None = None, skip: str = "", limit: int | None = None) -> DataFrame:
    """The blocks of ``plan`` to be made next: not stored, of this shard (i of n), not in ``skip`` (ranges as text), ``limit`` at most."""
    there = stored_blocks(plan.sparkSession, path)
    d = plan if there is None else plan.join(there, "block_id", "left_anti")
    if shard:
        d = d.where(F.pmod("block_id", F.lit(shard[1])) == shard[0])
    if skip:
        one = plan.limit(1).select(F.lit(0).alias("part"), F.lit(skip).alias("text"))
        d = d.join(parse_ranges(one).select(F.col("id").cast("int").alias("block_id")), "block_id", "left_anti")
    return d.orderBy("block_id").limit(limit) if limit is not None else d


def merge_blocks(source: str, path: str, spark: SparkSession) -> None:
    """Adds the blocks of another store that are not here yet; its unreadable and empty files are passed over."""
    other = spark.read.option("ignoreCorruptFiles", "true").parquet(source)
    write_blocks(other, path)


def read_design(plan: DataFrame, path: str) -> DataFrame:
    """All forecasts of a design; raises an error while blocks are missing."""
    gone = missing_blocks(plan, path).count()
    if gone:
        raise ValueError(f"{gone} blocks are missing")
    return plan.sparkSession.read.parquet(path)


def resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of three runs (a first few, those of another store, the rest of two shards) and what was to do before each."""
    rows, path, other = settled(blocks_of(spark, sf_dir)), folder(spark), folder(spark)
    plan = settled(block_plan(rows))
    steps = []

    def note(step: int, todo: DataFrame) -> DataFrame:
        steps.append(settled(todo.select(F.lit(step).alias("step"), "block_id")))
        return steps[-1]

    write_blocks(rows.join(note(1, missing_blocks(plan, path, limit=5)), "block_id", "left_semi"), path)
    write_blocks(rows.where("block_id between 4 and 9"), other)
    merge_blocks(other, path, spark)
    write_blocks(rows.join(note(2, missing_blocks(plan, path, shard=(0, 2), skip="20-22,26")), "block_id", "left_semi"), path)
    write_blocks(rows.join(note(3, missing_blocks(plan, path)), "block_id", "left_semi"), path)
    done = read_design(plan, path).groupBy("block_id").agg(F.count("*").alias("n"))
    return steps[0].union(steps[1]).union(steps[2]).join(done.select(F.col("block_id").cast("int"), "n"), "block_id")


# Sinks --------------------------------------------------------------------------------------------


def sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as CSV (pooled, daily with a column per instrument) and JSON (the design), and read back."""
    base, rows = folder(spark), settled(forecasts(spark, sf_dir).select("instrument", F.to_date("ts").alias("day"), "signal"))
    rows.groupBy("instrument").agg(F.count("*").alias("n"), F.sum("signal").alias("signals")).write.option("header", True).csv(f"{base}/pooled")
    rows.groupBy("day").pivot("instrument", ["click", "error", "purchase", "signup", "view"]).agg(F.sum("signal")).write.option("header", True).csv(f"{base}/daily")
    rows.agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("n")).write.json(f"{base}/design")
    pooled = spark.read.option("header", True).schema("instrument string, n long, signals long").csv(f"{base}/pooled")
    daily = spark.read.option("header", True).schema("day date, click long, error long, purchase long, signup long, view long").csv(f"{base}/daily")
    design = spark.read.schema("first date, last date, n long").json(f"{base}/design")
    tall = daily.unpivot(["day"], ["click", "error", "purchase", "signup", "view"], "instrument", "signals")
    per_day = tall.groupBy("instrument").agg(F.count("signals").alias("days"), F.sum("signals").alias("daily_signals"))
    return pooled.join(per_day, "instrument").join(F.broadcast(design.select(F.col("n").alias("of"))))  # one row of totals is broadcast


def commit_batch(rows: DataFrame, path: str, batch: int, keys: list[str], part: str = "day", first: bool = False, order: list[str] | None = None) -> None:
    """Writes the rows of one numbered batch to a journal, below the partitions ``part`` and ``batch``.

    Nothing that another batch wrote is read or rewritten, so the cost is that of the batch, and a batch
    that is replayed overwrites itself. With ``first``, keys that earlier batches hold in the same parts
    are left out, and of rows that share a key the first one by ``order`` stays; ``part`` must follow from
    the keys. The parts that a batch touches are named literally, so that the scan is pruned to them.
    """
    spark, now = rows.sparkSession, settled(rows)
    old = existing(spark, path) if first else None
    if first and order:
        now = now.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")
    if old is not None:
        touched = [r[0] for r in now.select(F.col(part).cast("string")).distinct().collect()]  # the parts of one batch
        earlier = old.where(F.col(part).isin(touched) & (F.col("batch").cast("long") < batch))
        now = now.join(earlier.select(*keys), keys, "left_anti")
    out = now.withColumn("batch", F.lit(batch)).repartition(part)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part, "batch").parquet(path)


def read_journal(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The rows of a journal: of those that share a key, the one of the latest batch."""
    return keep_last(spark.read.parquet(path), keys, "batch").drop("batch")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal of decisions after two writes of which the second revises the regimes above 1, and its newest row per instrument."""
    path = folder(spark)
    rows = forecasts(spark, sf_dir).select("instrument", "ts", "event_id", "regime", F.col("signal").cast("long").alias("signal"), F.to_date("ts").alias("day"))
    commit_batch(rows, path, 0, ["instrument", "ts"])
    commit_batch(rows.where("regime > 1").withColumn("signal", F.col("signal") * 10), path, 1, ["instrument", "ts"])
    now = read_journal(spark, path, ["instrument", "ts"])
    newest = now.groupBy("instrument").agg(F.max_by("event_id", "ts").alias("newest"))
    return now.groupBy("instrument").agg(F.count("*").alias("n"), F.sum("signal").alias("signals")).join(newest, "instrument")


def parse_observations(payloads: DataFrame) -> DataFrame:
    """Macro observations of JSON payloads; a value of "." is missing and dropped."""
    d = payloads.withColumn("_o", F.explode(F.from_json("payload", "struct<observations:array<struct<date:string,value:string>>>")["observations"]))
    return d.select("series", F.expr("try_cast(_o.date as timestamp)").alias("date"), F.expr("try_cast(_o.value as double)").alias("value")).dropna()


def observation_payloads(obs: DataFrame) -> DataFrame:
    """Observations as one payload per series and year; every seventh month is missing."""
    value = F.when(F.pmod(F.month("date"), F.lit(7)) == 0, ".").otherwise(F.col("value").cast("string"))
    one = F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"), value.alias("value"))
    return obs.groupBy("series", F.year("date").alias("year")).agg(F.to_json(F.struct(F.collect_list(one).alias("observations"))).alias("payload"))


def parse_quotes(payloads: DataFrame) -> DataFrame:
    """Best bid and ask, mid and spread (five digits) of price payloads."""
    d = payloads.withColumn("_q", F.from_json("payload", QUOTE))
    best = {n: F.expr(f"try_cast(get(_q.{n}s, 0).price as double)") for n in ("bid", "ask")}
    d = d.select("tick_id", F.col("_q.instrument").alias("instrument"), *(v.alias(n) for n, v in best.items()))
    return d.withColumn("mid", (F.col("bid") + F.col("ask")) / 2).withColumn("spread", F.round(F.col("ask") - F.col("bid"), 5))


def changed_years(old: DataFrame, new: DataFrame) -> DataFrame:
    """Series and years whose rows differ, by count and a hash that does not depend on order."""
    def mark(d: DataFrame) -> DataFrame:
        return d.groupBy("series", F.year("date").alias("year")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("date", "value")).alias("h"))

    a, b = mark(old), mark(new)
    return b.join(a, ["series", "year"], "left").where(~(b["n"].eqNullSafe(a["n"]) & b["h"].eqNullSafe(a["h"]))).select("series", "year")


def net_positions(payloads: DataFrame) -> DataFrame:
    """Net units and average price of the live side of broker positions; both sides at once is an error."""
    p = F.from_json("payload", "struct<long:struct<units:string,averagePrice:string>,short:struct<units:string,averagePrice:string>>")
    d = payloads.withColumn("_p", p).withColumn("l", F.expr("coalesce(try_cast(_p.long.units as double), 0)")).withColumn("s", F.expr("coalesce(try_cast(_p.short.units as double), 0)"))
    price = F.expr("try_cast(if(l <> 0, _p.long.averagePrice, _p.short.averagePrice) as double)")
    return d.select("id", (F.col("l") + F.col("s")).alias("units"), price.alias("average"), ((F.col("l") != 0) & (F.col("s") != 0)).alias("hedged")).where("units <> 0 or hedged")


def position_payloads(rows: DataFrame) -> DataFrame:
    """Broker positions as JSON from ticks: long, short, both or none by the id."""
    k = F.pmod("tick_id", F.lit(5))
    long = F.struct(F.when(k.isin(0, 3), F.col("size").cast("string")).otherwise("0").alias("units"), F.col("price").cast("string").alias("averagePrice"))
    short = F.struct(F.when(k.isin(1, 3), (-F.col("size")).cast("string")).otherwise("0").alias("units"), F.col("price").cast("string").alias("averagePrice"))
    return rows.select(F.col("tick_id").alias("id"), F.to_json(F.struct(long.alias("long"), short.alias("short"))).alias("payload"))


def id_ranges(ids: DataFrame, block: int = 4_096) -> DataFrame:
    """(part, a, b, text): the ranges of consecutive ids of each part, as gaps and islands.

    Islands are found inside blocks of ids first; only those that touch the border of a block are then
    joined in the order of their part, so that a part of any size is spread. Repeated ids count once.
    """
    own = Window.partitionBy("part", "_block").orderBy("id")
    d = ids.select("part", "id").distinct().withColumn("_block", F.floor(F.col("id") / block))
    d = d.withColumn("_island", F.col("id") - F.row_number().over(own)).groupBy("part", "_block", "_island").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    open_end = (F.col("a") == F.col("_block") * block) | (F.col("b") == F.col("_block") * block + block - 1)
    part = Window.partitionBy("part").orderBy("a")
    bordering = d.where(open_end).withColumn("_new", F.when(F.lag("b").over(part) == F.col("a") - 1, 0).otherwise(1))
    joined = bordering.withColumn("_run", F.sum("_new").over(part)).groupBy("part", "_run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    out = d.where(~open_end).select("part", "a", "b").union(joined.select("part", "a", "b"))
    return out.withColumn("text", F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b")))


def parse_ranges(texts: DataFrame) -> DataFrame:
    """(part, id): the ids of texts of ranges, one or several with commas."""
    d = texts.select("part", F.explode(F.transform(F.split("text", ","), lambda t: F.split(t, "-"))).alias("x")).select("part", F.element_at("x", 1).cast("long").alias("a"), F.element_at("x", -1).cast("long").alias("b"))
    return d.select("part", F.explode(F.sequence("a", "b")).alias("id"))


_OPEN = "open high low close"
R.add("s01_s02_candle_payloads", lambda k, d: parse_candles(candle_payloads(bars(k, d))), sql("bars", columns("instrument ts volume", f"{_OPEN} bid_close ask_close", "bars WHERE rn % 10 <> 0", 9)), 9)
R.add("s03_keep_last", lambda k, d: keep_last(daily_bars(k, d).select("instrument", "ts", "close", F.lit(1).alias("seq")).unionByName(daily_bars(k, d).where("ts >= '2000-01-01'").select("instrument", "ts", (F.col("close") + 1).alias("close"), F.lit(2).alias("seq"))), ["instrument", "ts"], "seq"), sql("daily_bars", ", o AS (SELECT instrument, ts, CASE WHEN ts >= '2000-01-01' THEN close + 1 ELSE close END AS close, CASE WHEN ts >= '2000-01-01' THEN 2 ELSE 1 END AS seq FROM daily_bars)" + columns("instrument ts seq", "close", "o", 9)), 9)
R.add("s04_s06_s14_store", lambda k, d: stored(k, d).groupBy("instrument").agg(F.count("*").alias("n"), F.max("ts").alias("last"), F.sum("volume").alias("volume")), sql("daily_bars", "SELECT instrument, count(*) AS n, max(ts) AS last, CAST(sum(volume) AS BIGINT) AS volume FROM daily_bars WHERE ts < '2001-03-07' GROUP BY ALL"))
R.add("s07_incremental_append", lambda k, d: new_rows(daily_bars(k, d).where("ts < '2000-06-01'").drop("volume"), daily_bars(k, d).where("ts >= '2000-01-01'")).groupBy("instrument").agg(F.count("*").alias("n"), F.count_distinct("ts").alias("times")), sql("daily_bars", "SELECT instrument, count(*) AS n, count(*) AS times FROM daily_bars GROUP BY ALL"))
R.add("s08_observations", lambda k, d: parse_observations(observation_payloads(macro_obs(k, d))), sql("macro_obs", columns("series date", "value", "macro_obs WHERE month(date) % 7 <> 0", 9)), 9)
R.add("s09_changed_years", lambda k, d: changed_years(macro_obs(k, d), macro_obs(k, d).withColumn("value", F.when(F.year("date") == 1997, F.col("value") + 1).otherwise(F.col("value")))), sql("macro_obs", "SELECT DISTINCT series, CAST(year(date) AS INTEGER) AS year FROM macro_obs WHERE year(date) = 1997"))
R.add("s11_quote_payloads", lambda k, d: parse_quotes(ticks(k, d).select("tick_id", F.to_json(F.struct("instrument", F.array(F.struct(F.col("bid").cast("string").alias("price"))).alias("bids"), F.array(F.struct(F.col("ask").cast("string").alias("price"))).alias("asks"))).alias("payload"))), sql("ticks", ", o AS (SELECT tick_id, instrument, bid, ask, (bid + ask) / 2 AS mid, round(ask - bid, 5) AS spread FROM ticks)" + columns("tick_id instrument", "bid ask mid spread", "o", 9)), 9)
R.add("s13_range_loader", lambda k, d: daily_bars(k, d).where("ts between '1996-01-01' and '1998-12-31'").groupBy("instrument").agg(F.count("*").alias("n"), F.min("ts").alias("first")), sql("daily_bars", "SELECT instrument, count(*) AS n, min(ts) AS first FROM daily_bars WHERE ts BETWEEN '1996-01-01' AND '1998-12-31' GROUP BY ALL"))
R.add("s15_s17_block_store", resumed, sql("forecasts", """, p AS (SELECT CAST(day(ts) AS INTEGER) AS block_id, count(*) AS n FROM forecasts GROUP BY 1), s1 AS (SELECT block_id FROM p ORDER BY 1 LIMIT 5), h1 AS (SELECT block_id FROM p WHERE block_id IN (SELECT block_id FROM s1) OR block_id BETWEEN 4 AND 9)
, s2 AS (SELECT block_id FROM p WHERE block_id NOT IN (SELECT block_id FROM h1) AND block_id % 2 = 0 AND block_id NOT IN (20, 21, 22, 26)), s3 AS (SELECT block_id FROM p WHERE block_id NOT IN (SELECT block_id FROM h1 UNION SELECT block_id FROM s2))
SELECT CAST(step AS INTEGER) AS step, block_id, n FROM (SELECT 1 AS step, block_id FROM s1 UNION ALL SELECT 2, block_id FROM s2 UNION ALL SELECT 3, block_id FROM s3) JOIN p USING (block_id)"""))
_ISLANDS = "WITH i AS (SELECT event_type AS part, event_id AS id, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM (SELECT DISTINCT event_type, event_id FROM events))"
event_ids = lambda k, d: table(k, d, "events").select(F.col("event_type").alias("part"), F.col("event_id").alias("id"))
R.add("s16_id_ranges", lambda k, d: id_ranges(event_ids(k, d)), _ISLANDS + " SELECT part, min(id) AS a, max(id) AS b, CASE WHEN min(id) = max(id) THEN CAST(min(id) AS VARCHAR) ELSE concat(min(id), '-', max(id)) END AS text FROM i GROUP BY part, g")
R.add("s16_parse_ranges", lambda k, d: parse_ranges(id_ranges(event_ids(k, d))).groupBy("part").agg(F.count("*").alias("n"), F.sum("id").alias("total")), "SELECT event_type AS part, count(DISTINCT event_id) AS n, CAST(sum(DISTINCT event_id) AS BIGINT) AS total FROM events GROUP BY ALL")
R.add("s18_result_sinks", sinks, sql("forecasts", ", d AS (SELECT instrument, CAST(ts AS DATE) AS day, sum(signal) AS s FROM forecasts GROUP BY ALL), p AS (SELECT instrument, count(*) AS days, CAST(sum(s) AS BIGINT) AS daily_signals FROM d GROUP BY ALL) SELECT instrument, count(*) AS n, CAST(sum(signal) AS BIGINT) AS signals, any_value(days) AS days, any_value(daily_signals) AS daily_signals, (SELECT count(*) FROM forecasts) AS of FROM forecasts JOIN p USING (instrument) GROUP BY ALL"))
R.add("s19_journal_upsert", journal, sql("forecasts", "SELECT instrument, count(*) AS n, CAST(sum(CASE WHEN regime > 1 THEN signal * 10 ELSE signal END) AS BIGINT) AS signals, arg_max(event_id, ts) AS newest FROM forecasts GROUP BY ALL"))
R.add("s20_broker_positions", lambda k, d: net_positions(position_payloads(ticks(k, d))), sql("ticks", ", p AS (SELECT tick_id AS id, CAST(CASE WHEN tick_id % 5 IN (0, 3) THEN size ELSE 0 END AS DOUBLE) AS l, CAST(CASE WHEN tick_id % 5 IN (1, 3) THEN -size ELSE 0 END AS DOUBLE) AS s, price FROM ticks), o AS (SELECT id, l + s AS units, price AS average, l <> 0 AND s <> 0 AS hedged FROM p WHERE l + s <> 0 OR l <> 0 AND s <> 0)" + columns("id hedged", "units average", "o", 9)), 9)


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast rows appended to an audit log by day in two writes, and counted from it."""
    path = folder(spark)
    rows = forecasts(spark, sf_dir).select("event_id", "instrument", "signal", F.to_date("ts").alias("day"))
    for half in (0, 1):
        rows.where(F.pmod("event_id", F.lit(2)) == half).write.mode("append").partitionBy("day").parquet(path)
    return spark.read.parquet(path).groupBy("day").agg(F.count("*").alias("n"), F.sum("signal").cast("long").alias("signals"))


R.add("s21_audit_log", audited, sql("forecasts", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(signal) AS BIGINT) AS signals FROM forecasts GROUP BY 1"))
QUERIES, ORACLE_SQL = R.queries, R.sql
