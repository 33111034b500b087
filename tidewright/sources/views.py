"""Domain views over the given tables: bars, ticks, macro observations, news and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import numbered

KEYS = ["instrument"]
#: Half the quoted spread and the pip of the views' instruments.
HALF_SPREAD, PIP = 0.00004, 0.0001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table with its timestamps as instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*(F.col(n).cast("timestamp").alias(n) if t == "timestamp_ntz" else F.col(n) for n, t in df.dtypes))


def quoted(df: DataFrame) -> DataFrame:
    """Adds bid_close and ask_close around close."""
    return df.withColumn("bid_close", F.col("close") - HALF_SPREAD).withColumn("ask_close", F.col("close") + HALF_SPREAD)


def trades_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as trades: instrument, ts, price, volume and an order inside the day."""
    price = 1 + (F.col("l_extendedprice") / F.col("l_quantity")) / 1e6
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("instrument"),
        F.date_trunc("day", "l_shipdate").alias("ts"),
        price.alias("price"),
        F.col("l_quantity").cast("long").alias("volume"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("seq"),
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily candles per instrument."""
    bars = trades_of_day(spark, sf_dir).groupBy("instrument", "ts").agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("volume").alias("volume")
    )
    return quoted(bars)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily candles with their place ``rn`` in the series."""
    return numbered(daily_bars(spark, sf_dir), KEYS, ["ts"], "year")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as ticks."""
    price = 1 + F.col("value") / 1e4
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("instrument"), "ts", F.col("event_id").alias("tick_id"), price.alias("price"),
        (price - HALF_SPREAD).alias("bid"), (price + HALF_SPREAD).alias("ask"), F.get_json_object("props", "$.k").cast("int").alias("size"), "user_id",
    )


def count_bars(spark: SparkSession, sf_dir: str, per_bar: int = 4) -> DataFrame:
    """Bars of a fixed number of ticks; ts and event_id are those of the first tick."""
    placed = numbered(ticks(spark, sf_dir), KEYS, ["ts", "tick_id"], "day", "n").withColumn("rn", F.floor((F.col("n") - 1) / per_bar) + 1)
    out = placed.groupBy("instrument", "rn").agg(
        F.min("ts").alias("ts"), F.min_by("tick_id", "n").alias("event_id"), F.min_by("price", "n").alias("open"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.max_by("price", "n").alias("close"), F.sum("size").cast("long").alias("volume"),
    )
    return quoted(out)


def macro_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly macro observations: the mean order total per priority, from whole cents."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.date_trunc("month", "o_orderdate").alias("date")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / F.count("*") / 100).alias("value"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with ``labels`` as scored news; texts are hashed before the join, so that they are shuffled only where they are read."""
    labels = table(spark, sf_dir, "labels")
    score = (F.coalesce("quality", F.lit(0)) - F.coalesce("toxic", F.lit(0))).cast("double")
    articles = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.timestamp_micros((F.lit(1704067200) + F.pmod(F.col("doc_id") * 37, F.lit(43200)) * 60) * 1000000).alias("published_at"),
        F.col("text").alias("full_text"), F.md5(F.lower("text")).alias("text_hash"),
    )
    return articles.join(labels, "doc_id", "left").select(*articles.columns, score.alias("score"), F.abs(score).alias("intensity"))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast rows on count bars, by integer arithmetic on the event id."""
    e = F.col("event_id")
    p50 = (F.pmod(e * 31, F.lit(200)) - 100) / 1e5
    return count_bars(spark, sf_dir).select(
        "*", (F.pmod(e * 7919, F.lit(3)) - 1).cast("int").alias("signal"), (F.pmod(e * 104729, F.lit(1000)) / 1000.0).alias("confidence"), F.pmod(e, F.lit(4)).cast("int").alias("regime"),
        p50.alias("p50"), (p50 - 0.0005 - F.pmod(e, F.lit(7)) / 1e5).alias("p10"), (p50 + 0.0005 + F.pmod(e, F.lit(5)) / 1e5).alias("p90"),
    )


def bar_range(df: DataFrame) -> DataFrame:
    """(instrument, first, last) of a bar table."""
    return df.groupBy("instrument").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))


#: The same views for DuckDB.
SQL_VIEWS = {
    "daily_bars": """SELECT l_returnflag AS instrument, date_trunc('day', l_shipdate) AS ts,
        first(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open, max(price) AS high, min(price) AS low,
        last(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume, close - 0.00004 AS bid_close, close + 0.00004 AS ask_close
        FROM (SELECT *, 1 + (l_extendedprice / l_quantity) / 1e6 AS price FROM lineitem) GROUP BY ALL""",
    "bars": "SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts) AS rn FROM daily_bars",
    "ticks": """SELECT event_type AS instrument, ts, event_id AS tick_id, 1 + value / 1e4 AS price, price - 0.00004 AS bid, price + 0.00004 AS ask,
        CAST(props ->> '$.k' AS INTEGER) AS size, user_id FROM events""",
    "count_bars": """SELECT instrument, rn, min(ts) AS ts, arg_min(tick_id, n) AS event_id, arg_min(price, n) AS open, max(price) AS high, min(price) AS low,
        arg_max(price, n) AS close, CAST(sum(size) AS BIGINT) AS volume, close - 0.00004 AS bid_close, close + 0.00004 AS ask_close
        FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts, tick_id) AS n, (n - 1) // 4 + 1 AS rn FROM ticks) GROUP BY instrument, rn""",
    "macro_obs": "SELECT o_orderpriority AS series, date_trunc('month', o_orderdate) AS date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS value FROM orders GROUP BY ALL",
    "news": """SELECT d.doc_id, d.source, make_timestamp((1704067200 + (d.doc_id * 37 % 43200) * 60) * 1000000) AS published_at, text AS full_text, md5(lower(text)) AS text_hash,
        CAST(coalesce(quality, 0) - coalesce(toxic, 0) AS DOUBLE) AS score, abs(score) AS intensity FROM documents AS d LEFT JOIN labels AS l USING (doc_id)""",
    "forecasts": """SELECT *, CAST(event_id * 7919 % 3 - 1 AS INTEGER) AS signal, (event_id * 104729 % 1000) / 1000.0 AS confidence, CAST(event_id % 4 AS INTEGER) AS regime,
        (event_id * 31 % 200 - 100) / 1e5 AS p50, p50 - 0.0005 - (event_id % 7) / 1e5 AS p10, p50 + 0.0005 + (event_id % 5) / 1e5 AS p90 FROM count_bars""",
}
NEEDS = {"bars": ["daily_bars"], "count_bars": ["ticks"], "forecasts": ["ticks", "count_bars"]}


def sql(views: str, body: str) -> str:
    """``body`` with the named views (comma-separated) in front; further CTEs may start the body with a comma."""
    names: list[str] = []
    for v in filter(None, views.split(",")):
        names += [n for n in [*NEEDS.get(v, []), v] if n not in names]
    head = "WITH " + ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names)
    return f"{head}{body}" if body.lstrip().startswith(",") else f"{head} {body}"
