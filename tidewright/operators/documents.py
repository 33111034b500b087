"""Documents, stores and monitors in full: articles, snapshots with cutoff and edition, standings, distributions, weekly exports, yearly rewrites, feature loads, split files, rolling monitors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import numbered, settled, with_halo
from ..plans.registry import Registry, columns
from ..sources.store import changed_years, existing, folder
from ..sources.views import KEYS, bars, macro_obs, sql, table
from . import decisions as dec
from . import evaluation as e
from .decisions import _D, _FILLS, N, decisions, sized
from .evaluation_queries import scored
from .features import flag
from .live_reports import _LG, ledger_of_rules
from .orders import _CHECK, checked
from .split_metrics import _SPLIT, _WEEKS, LEAST, YEAR, split_returns, weekly_report

R = Registry()
SERIES = ["strategy", "instrument"]

# Articles (S10) -----------------------------------------------------------------------------------


def articles(payloads: DataFrame) -> DataFrame:
    """Articles (doc_id, published_at, headline, description, full_text, text_hash), the newest first.

    Blanks around headline and description go; articles without a headline, or with a removed one, are
    dropped. The full text is both, without dots and blanks at its ends; its hash does not mind case.
    """
    trimmed = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    d = payloads.withColumn("headline", trimmed(F.col("title"))).withColumn("description", trimmed(F.col("description"))).where("headline <> '' and headline <> '[Removed]'")
    text = F.regexp_replace(F.concat("headline", F.lit(". "), "description"), r"^[. ]+|[. ]+\z", "")
    return d.withColumn("full_text", text).select("doc_id", "published_at", "headline", "description", "full_text", F.md5(F.lower("full_text")).alias("text_hash")).orderBy(F.desc("published_at"), "doc_id")


def article_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as articles: the first 60 characters are the title, some of them removed or missing."""
    i = F.col("doc_id")
    title = F.when(F.pmod(i, F.lit(19)) == 0, " [Removed] ").when(F.pmod(i, F.lit(23)) != 0, F.substring("text", 1, 60))
    return table(spark, sf_dir, "documents").select("doc_id", F.timestamp_seconds(F.lit(1704067200) + F.pmod(i * 37, F.lit(43200)) * 60).alias("published_at"), title.alias("title"), F.when(F.pmod(i, F.lit(5)) != 0, F.expr("substring(text, 61)")).alias("description"))


R.add(
    "s10_parsed_articles", lambda k, d: articles(article_payloads(k, d)).select("doc_id", "published_at", F.md5("headline").alias("headline_md5"), F.md5("full_text").alias("text_md5"), "text_hash"),
    r"""WITH p AS (SELECT doc_id, make_timestamp((1704067200 + (doc_id * 37 % 43200) * 60) * 1000000) AS published_at, CASE WHEN doc_id % 19 = 0 THEN ' [Removed] ' WHEN doc_id % 23 <> 0 THEN substring(text, 1, 60) END AS title, CASE WHEN doc_id % 5 <> 0 THEN substring(text, 61) END AS description FROM documents)
, t AS (SELECT *, regexp_replace(coalesce(title, ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z', '', 'g') AS headline, regexp_replace(coalesce(description, ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z', '', 'g') AS descr FROM p)
, f AS (SELECT *, regexp_replace(headline || '. ' || descr, '^[. ]+|[. ]+\z', '', 'g') AS full_text FROM t WHERE headline <> '' AND headline <> '[Removed]')
SELECT doc_id, published_at, md5(headline) AS headline_md5, md5(full_text) AS text_md5, md5(lower(full_text)) AS text_hash FROM f""",
)

# Snapshot (X5), standings (X6), distributions (X7), export (X8) ---------------------------------------

#: Minutes of a day at which editions come out.
EDITIONS = (("dawn", 20), ("day", 740), ("dusk", 1220))


def edition(ts: Column) -> Column:
    """The edition that was last due at a time: of the day, or the last one of the day before."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    out = F.when(minute < EDITIONS[0][1], EDITIONS[-1][0])
    for i, (name, _) in enumerate(EDITIONS[:-1]):
        out = out.when(minute < EDITIONS[i + 1][1], name)
    return out.otherwise(EDITIONS[-1][0])


def snapshot(ledger: DataFrame, now: Column, cutoff: Column) -> DataFrame:
    """One JSON document per instrument of the ledger's rows before ``cutoff`` (a whole day): edition, span, days, and the last state of every strategy in the order of names."""
    d = ledger.where(F.col("ts") < F.date_trunc("day", cutoff))
    last = d.groupBy("instrument", "strategy").agg(F.max_by(F.struct("position", "trades", F.round("gross_pips", 3).alias("gross_pips")), "rn").alias("s"))
    states = last.groupBy("instrument").agg(F.sort_array(F.collect_list(F.struct("strategy", "s.*"))).alias("strategies"))
    span = d.groupBy("instrument").agg(F.min("ts").alias("start"), F.max("ts").alias("last_bar"), F.count_distinct(F.to_date("ts")).alias("n_days"), F.count("*").alias("n_rows"))
    doc = F.to_json(F.struct(F.lit("paper").alias("phase"), edition(now).alias("edition"), F.date_format(F.date_trunc("day", cutoff), "yyyy-MM-dd").alias("cutoff"), "start", "last_bar", "n_days", "n_rows", "strategies"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"})
    return span.join(states, "instrument").select("instrument", doc.alias("document"))


def snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots as of a time of the daily ledger, read back from their JSON: one row per instrument and strategy."""
    now, cutoff = F.lit("2001-01-10 13:05:00").cast("timestamp"), F.lit("2001-01-09 18:00:00").cast("timestamp")
    schema = "phase string, edition string, cutoff string, start timestamp, last_bar timestamp, n_days long, n_rows long, strategies array<struct<strategy:string,position:double,trades:long,gross_pips:double>>"
    d = snapshot(ledger_of_rules(spark, sf_dir), now, cutoff).select("instrument", F.from_json("document", schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias("d")).select("instrument", "d.*")
    return d.withColumn("s", F.explode("strategies")).select("instrument", "phase", "edition", "cutoff", "start", "last_bar", "n_days", "n_rows", "s.*")


R.add(
    "x05_snapshot_document", snapshot_read,
    sql("bars", _LG + """, d AS (SELECT * FROM lgr WHERE ts < TIMESTAMP '2001-01-09 00:00:00'), sp AS (SELECT instrument, min(ts) AS start, max(ts) AS last_bar, count(DISTINCT CAST(ts AS DATE)) AS n_days, count(*) AS n_rows FROM d GROUP BY ALL)
, l AS (SELECT instrument, strategy, arg_max(position, rn) AS position, arg_max(trades, rn) AS trades, round(arg_max(gross_pips, rn), 3) AS gross_pips FROM d GROUP BY ALL), o AS (SELECT instrument, 'paper' AS phase, 'day' AS edition, '2001-01-09' AS cutoff, start, last_bar, n_days, n_rows, strategy, position, trades, gross_pips FROM l JOIN sp USING (instrument))"""
        + columns("instrument phase edition cutoff start last_bar n_days n_rows strategy trades", "position gross_pips", "o", 2)), 2,
)
R.add("x05_editions", lambda k, d: table(k, d, "events").select("event_id", edition(F.col("ts")).alias("edition")), "SELECT event_id, CASE WHEN hour(ts) * 60 + minute(ts) < 20 THEN 'dusk' WHEN hour(ts) * 60 + minute(ts) < 740 THEN 'dawn' WHEN hour(ts) * 60 + minute(ts) < 1220 THEN 'day' ELSE 'dusk' END AS edition FROM events")


def standings(ledger: DataFrame) -> DataFrame:
    """The newest ledger row of every series, with what is left at the reference and at the quoted cost."""
    last = ledger.groupBy(*SERIES).agg(F.max_by(F.struct("ts", "position", "gross_pips", "cost_ref_pips", "cost_quoted_pips", "trades"), "rn").alias("s")).select(*SERIES, "s.*")
    return last.withColumn("net_ref_pips", F.col("gross_pips") - F.col("cost_ref_pips")).withColumn("net_quoted_pips", F.col("gross_pips") - F.col("cost_quoted_pips")).orderBy(*SERIES)


_STAND = "position gross_pips cost_ref_pips cost_quoted_pips net_ref_pips net_quoted_pips"
R.add("x06_strategy_standings", lambda k, d: standings(ledger_of_rules(k, d)), sql("bars", _LG + ", o AS (SELECT strategy, instrument, ts, position, gross_pips, cost_ref_pips, cost_quoted_pips, trades, gross_pips - cost_ref_pips AS net_ref_pips, gross_pips - cost_quoted_pips AS net_quoted_pips FROM lgr QUALIFY row_number() OVER (PARTITION BY strategy, instrument ORDER BY rn DESC) = 1)" + columns("strategy instrument ts trades", _STAND, "o", 3)), 3)


def distributions(df: DataFrame) -> DataFrame:
    """Per instrument and week: shares of buys, sells and flats, of agreement, of what may act, of each regime and of decisions that stay flat, mean confidence and mean units of the others."""
    share = lambda c: F.avg(flag(c).cast("double"))
    d = df.withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    return d.groupBy("instrument", "week").agg(
        F.count("*").alias("n"), *(share(F.col("f_signal") == s).alias(f"share_{n}") for n, s in (("buy", 1), ("sell", -1), ("flat", 0))), share(F.col("agree")).alias("agreement"), share(F.col("actionable")).alias("actionable"),
        *(share(F.col("regime") == r).alias(f"regime_{r}") for r in range(4)), share(F.col("units") == 0).alias("flat_rate"), F.avg(F.when(F.col("units") != 0, F.abs("units").cast("double"))).alias("mean_units"), F.avg("f_confidence").alias("mean_confidence"),
    )


_DIST = "share_buy share_sell share_flat agreement actionable regime_0 regime_1 regime_2 regime_3 flat_rate mean_units mean_confidence"
R.add(
    "x07_weekly_distributions", lambda k, d: distributions(decisions(k, d)),
    sql("forecasts", _D + ", o AS (SELECT instrument, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n, " + ", ".join(f"avg(CASE WHEN {t} THEN 1.0 ELSE 0 END) AS {n}" for n, t in (("share_buy", "f_signal = 1"), ("share_sell", "f_signal = -1"), ("share_flat", "f_signal = 0"), ("agreement", "agree"), ("actionable", "actionable"), *((f"regime_{r}", f"regime = {r}") for r in range(4)), ("flat_rate", "units = 0")))
        + ", avg(abs(units)) FILTER (units <> 0) AS mean_units, avg(f_confidence) AS mean_confidence FROM dec GROUP BY ALL)" + columns("instrument week n", _DIST, "o")),
)

SCALE = 10_000_000


def export(scored_bars: DataFrame) -> DataFrame:
    """One row per series for a page: months, weekly gross and reference returns as whole 1e-7, in order, monthly gross pips and trades, and the moments of its days."""
    listed = lambda order, value: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, value.alias("v")))), lambda s: s["v"].cast("string")), ",")
    whole = lambda c: F.round(F.col(c) * SCALE).cast("long")
    w = weekly_report(scored_bars).where("pips = 0").groupBy(*SERIES).agg(listed("week", whole("gross")).alias("weekly_gross"), listed("week", whole("reference")).alias("weekly_ref"))
    months = e.trades(scored_bars).groupBy(*SERIES, "split").agg(F.sum("gross_pips").alias("gross"), F.count("*").alias("trades"))
    m = months.groupBy(*SERIES).agg(listed("split", F.date_format("split", "yyyy-MM")).alias("months"), listed("split", F.round(F.col("gross") * 10 + 0.0137).cast("long")).alias("monthly_tenths"), listed("split", F.col("trades")).alias("monthly_trades"))
    return w.join(m, SERIES).join(e.moments(scored_bars), SERIES)


_MOMENTS = "sg sd sgg sdd sgd"
R.add(
    "x08_weekly_export", lambda k, d: export(scored(k, d)),
    sql("bars", _WEEKS + f""", we AS (SELECT strategy, instrument, string_agg(CAST(CAST(round(gross * {SCALE}) AS BIGINT) AS VARCHAR), ',' ORDER BY week) AS weekly_gross, string_agg(CAST(CAST(round(reference * {SCALE}) AS BIGINT) AS VARCHAR), ',' ORDER BY week) AS weekly_ref FROM wk GROUP BY ALL)
, mo AS (SELECT strategy, instrument, split, sum(gross_pips) AS gross, count(*) AS trades FROM trades GROUP BY ALL), ml AS (SELECT strategy, instrument, string_agg(strftime(split, '%Y-%m'), ',' ORDER BY split) AS months, string_agg(CAST(CAST(round(gross * 10 + 0.0137) AS BIGINT) AS VARCHAR), ',' ORDER BY split) AS monthly_tenths, string_agg(CAST(trades AS VARCHAR), ',' ORDER BY split) AS monthly_trades FROM mo GROUP BY ALL)
, gd AS (SELECT strategy, instrument, CAST(ts AS DATE) AS day, sum(held * r_log) AS g, sum(turnover / 2 * 0.0001 / close) AS d FROM scored GROUP BY ALL), mm AS (SELECT strategy, instrument, count(*) AS n, sum(g) AS sg, sum(d) AS sd, sum(g * g) AS sgg, sum(d * d) AS sdd, sum(g * d) AS sgd FROM gd GROUP BY ALL)
, o AS (SELECT * FROM we JOIN ml USING (strategy, instrument) JOIN mm USING (strategy, instrument))""" + columns("strategy instrument weekly_gross weekly_ref months monthly_tenths monthly_trades n", _MOMENTS, "o", 9)), 9,
)

# Stores (S9, S13, S18) ---------------------------------------------------------------------------------


def rewrite_years(obs: DataFrame, path: str) -> int:
    """Writes observations by series and year into a store, only those years whose rows differ from the stored ones; returns their number."""
    spark, new = obs.sparkSession, settled(obs)
    old = existing(spark, path)
    touched = new.select("series", F.year("date").alias("year")).distinct() if old is None else settled(changed_years(old, new))
    out = new.withColumn("year", F.year("date")).join(touched, ["series", "year"], "left_semi")
    out.repartition("series", "year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("series", "year").parquet(path)
    return touched.count()


def yearly_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of observations after a first write, one that changes 1997 of two series, and one that changes nothing: rows, sum, newest date per series, and the years that each write rewrote."""
    path, obs = folder(spark), settled(macro_obs(spark, sf_dir))
    revised = obs.withColumn("value", F.when((F.year("date") == 1997) & F.col("series").isin("1-URGENT", "2-HIGH"), F.col("value") + 1).otherwise(F.col("value")))
    written = [rewrite_years(x, path) for x in (obs, revised, revised)]
    out = existing(spark, path).groupBy("series").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("date").alias("newest"))
    return out.select("*", *(F.lit(n).cast("long").alias(f"rewritten_{i}") for i, n in enumerate(written)))


R.add("s09_rewrite_years", yearly_store, sql("macro_obs", ", y AS (SELECT count(*) AS k FROM (SELECT DISTINCT series, year(date) FROM macro_obs)), o AS (SELECT series, count(*) AS n, sum(value) + CASE WHEN series IN ('1-URGENT', '2-HIGH') THEN count(*) FILTER (year(date) = 1997) ELSE 0 END AS total, max(date) AS newest, (SELECT k FROM y) AS rewritten_0, CAST(2 AS BIGINT) AS rewritten_1, CAST(0 AS BIGINT) AS rewritten_2 FROM macro_obs GROUP BY series)" + columns("series n newest rewritten_0 rewritten_1 rewritten_2", "total", "o", 5)), 5)


def load_features(spark: SparkSession, base: str, granularity: str, start: str | None = None, end: str | None = None, fallbacks: tuple[str, ...] = ("features",)) -> DataFrame:
    """Features of a bar length between two times: the first folder there of ``<length>_features`` and its other names. Another bar length never stands in: it raises."""
    for name in (f"{granularity}_features", *(f"{granularity}_{f}" for f in fallbacks)):
        d = existing(spark, f"{base}/{name}")
        if d is not None:
            break
    else:
        raise FileNotFoundError(f"no features of {granularity} bars")
    d = d.withColumn("year", F.col("year").cast("int"))
    if start:
        d = d.where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("year") >= int(start[:4])))  # the year prunes folders
    if end:
        d = d.where((F.col("ts") <= F.lit(end).cast("timestamp")) & (F.col("year") <= int(end[:4])))
    return d.drop("year")


def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily features written by year and loaded for two stretches."""
    base = folder(spark)
    d = with_halo(bars(spark, sf_dir), KEYS, 1, lambda x, w: x.withColumn("r", F.log(F.col("close") / w.lag("close")))).select("instrument", "ts", "close", "r", F.year("ts").alias("year"))
    d.repartition("year").write.partitionBy("year").parquet(f"{base}/D_features")
    parts = [load_features(spark, base, "D", a, b).groupBy("instrument").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.sum("r").alias("total")).withColumn("stretch", F.lit(n)) for n, a, b in (("all", None, None), ("inside", "1996-03-01", "1998-12-31"))]
    return parts[0].unionByName(parts[1])


R.add("s13_feature_loads", loaded, sql("bars", f", a AS (SELECT *, ln(close / lag(close) OVER {N}) AS r FROM bars), o AS (SELECT instrument, 'all' AS stretch, count(*) AS n, min(ts) AS first, max(ts) AS last, sum(r) AS total FROM a GROUP BY ALL UNION ALL SELECT instrument, 'inside', count(*), min(ts), max(ts), sum(r) FROM a WHERE ts BETWEEN '1996-03-01' AND '1998-12-31' GROUP BY ALL)" + columns("instrument stretch n first last", "total", "o")))


def split_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results per strategy, instrument and split, written as CSV and read back."""
    path = f"{folder(spark)}/per_split"
    rows = split_returns(spark, sf_dir).groupBy(*SERIES, "split").agg(F.count("*").alias("n"), F.round(F.sum("net"), 9).alias("net"), F.round(F.sum("gross"), 9).alias("gross"))
    rows.write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("strategy string, instrument string, split timestamp, n long, net double, gross double").csv(path)


R.add("s18_split_file", split_file, sql("bars", _SPLIT + ", o AS (SELECT strategy, instrument, split, count(*) AS n, sum(net) AS net, sum(gross) AS gross FROM sr GROUP BY ALL)" + columns("strategy instrument split n", "net gross", "o")))

# Rolling monitor (O9) ------------------------------------------------------------------------------------


def rolling_monitor(rows: DataFrame) -> DataFrame:
    """Per row of (rn, ret, slippage, passed): annual Sharpe ratio of the last 100 returns (0 under LEAST), hit rate of the last 50 returns of trades (one half under five), mean slippage of the last 20 fills, pass rate of the last 50 checks.

    Trades and fills are numbered by themselves and carried to the rows after them.
    """
    d = settled(rows)
    year = F.sqrt(F.lit(float(YEAR)))

    def sharpe(x: DataFrame, w) -> DataFrame:
        r, last = F.col("ret"), w(-99)
        ratio = F.avg(r).over(last) / (F.stddev_pop(r).over(last) + 1e-10) * year
        return x.withColumn("sharpe_100", F.when(F.count(r).over(last) >= LEAST, ratio).otherwise(0.0)).withColumn("pass_50", F.avg(flag(F.col("passed")).cast("double")).over(w(-49)))

    def among(test: str, column: Column, n: int, name: str, least: int) -> DataFrame:
        own = numbered(d.where(test).withColumn("_place", F.col("rn")).drop("rn"), KEYS, ["ts", "event_id"], "day")
        value = lambda x, w: x.withColumn(name, F.when(F.count(column).over(w(1 - n)) >= least, F.avg(column).over(w(1 - n))))
        return with_halo(own, KEYS, n, value).select("instrument", F.col("_place").alias("rn"), name)

    from ..functions.windows import carried

    out = with_halo(d, KEYS, 101, sharpe)
    out = out.join(among("ret <> 0", flag(F.col("ret") > 0).cast("double"), 50, "hit_50", 5), ["instrument", "rn"], "left").join(among("slippage is not null", F.col("slippage"), 20, "slippage_20", 1), ["instrument", "rn"], "left")
    out = carried(carried(out, KEYS, "hit_50", "_hit"), KEYS, "slippage_20", "_slip")
    return out.select("event_id", "sharpe_100", F.coalesce("_hit", F.lit(0.5)).alias("hit_50"), F.coalesce("_slip", F.lit(0.0)).alias("slippage_20"), "pass_50")


def monitored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monitor over decisions: returns of the signal so far, slippage of executed fills, and whether all checks passed."""
    filled = dec.fills(sized(decisions(spark, sf_dir))).select("event_id", F.when(F.col("executed"), F.col("slippage_pips")).alias("slippage"))
    d = with_halo(checked(spark, sf_dir), KEYS, 1, lambda x, w: x.withColumn("ret", F.coalesce(w.lag("d_signal") * F.log(F.col("close") / w.lag("close")), F.lit(0.0))))
    return rolling_monitor(d.select("instrument", "ts", "event_id", "rn", "ret", (F.col("failures") == "").alias("passed")).join(filled, "event_id"))


R.add(
    "o09_full_monitor", monitored,
    sql("forecasts", _CHECK + _FILLS.removeprefix(_FILLS[: _FILLS.index(", n AS (SELECT *, coalesce(lead(open)")]) + f""", mo AS (SELECT cg.instrument, cg.rn, cg.event_id, coalesce(lag(cg.d_signal) OVER v * ln(cg.close / lag(cg.close) OVER v), 0) AS ret, cg.failures = '' AS passed, CASE WHEN fl.executed THEN fl.slippage_pips END AS slippage FROM cg JOIN fl USING (event_id) WINDOW v AS (PARTITION BY cg.instrument ORDER BY cg.rn))
, th AS (SELECT instrument, rn, CASE WHEN count(*) OVER v >= 5 THEN avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) OVER v END AS hit FROM mo WHERE ret <> 0 WINDOW v AS (PARTITION BY instrument ORDER BY rn ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
, ts2 AS (SELECT instrument, rn, avg(slippage) OVER (PARTITION BY instrument ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS slip FROM mo WHERE slippage IS NOT NULL)
, o AS (SELECT event_id, CASE WHEN count(*) OVER w >= {LEAST} THEN avg(ret) OVER w / (stddev_pop(ret) OVER w + 1e-10) * sqrt({YEAR}) ELSE 0 END AS sharpe_100, coalesce(last_value(hit IGNORE NULLS) OVER u, 0.5) AS hit_50, coalesce(last_value(slip IGNORE NULLS) OVER u, 0) AS slippage_20, avg(CASE WHEN passed THEN 1.0 ELSE 0 END) OVER h AS pass_50
  FROM mo LEFT JOIN th USING (instrument, rn) LEFT JOIN ts2 USING (instrument, rn) WINDOW w AS (PARTITION BY instrument ORDER BY rn ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), h AS (PARTITION BY instrument ORDER BY rn ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), u AS (PARTITION BY instrument ORDER BY rn))""" + columns("event_id", "sharpe_100 hit_50 slippage_20 pass_50", "o", 5)), 5,
)
QUERIES, ORACLE_SQL = R.queries, R.sql
