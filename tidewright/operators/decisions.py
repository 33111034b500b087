"""Regimes, forecasts, sentiment, fusion, costs, risk, compliance and orders, with queries and SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import normal_cdf, numbered, ratio, running_max, running_sum, settled, with_halo
from ..plans.registry import Registry, columns
from ..sources.views import bars, forecasts, news, sql, ticks
from .features import KEYS, flag

R = Registry()
N = "(PARTITION BY instrument ORDER BY rn)"

#: Weights, thresholds and limits by regime (bull, bear, sideways, crisis).
MODEL_WEIGHTS = {0: 0.65, 1: 0.65, 2: 0.35, 3: 0.50}
PRICE_WEIGHTS = {0: 0.80, 1: 0.75, 2: 0.70, 3: 0.40}
THRESHOLDS = {0: 0.52, 1: 0.52, 2: 0.55, 3: 0.62}
TEXT_WEIGHTS = {0: 0.20, 1: 0.25, 2: 0.20, 3: 0.50}
KELLY_CAPS = {0: 0.25, 1: 0.25, 2: 0.20, 3: 0.10}
MAX_POSITION = {0: 0.20, 1: 0.20, 2: 0.15, 3: 0.05}
#: Spread multipliers by session, and the spreads in pips of the views' instruments.
SESSIONS = {"overlap": 0.70, "london": 0.85, "new_york": 0.90, "asian": 1.40, "weekend": 2.50}
TYPICAL, WIDE, TIGHTEST = 0.8, 2.5, 0.3
#: Units of a lot, most units of a position, least confidence of a trade, least share of a position for a limit order.
LOT, MOST_UNITS, TRADE_FROM, LIMIT_FROM = 100_000, 500_000, 0.52, 0.58
PIP = 0.0001


def by(table: dict, key: Column) -> Column:
    """The value of ``table`` for a key column."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def sign(x: Column, zone: float) -> Column:
    """-1, 0 or 1, with a dead zone."""
    x = F.round(x, 9)
    return F.when(x > zone, 1).when(x < -zone, -1).otherwise(0)


# Forecast signals ----------------------------------------------------------------------------


def quantile_signal(df: DataFrame, pip: float = PIP) -> DataFrame:
    """Signal (dead zone of two pips) and confidence 2 Phi(|p50| / sigma) - 1, sigma = (p90 - p10) / 2.5631."""
    sigma = (F.col("p90") - F.col("p10")) / 2.5631
    return df.withColumn("q_signal", sign(F.col("p50"), 2 * pip)).withColumn("q_confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * normal_cdf(F.abs("p50") / sigma) - 1)))


def second_model(df: DataFrame) -> DataFrame:
    """A second signed confidence, from class probabilities derived from the event id."""
    e = F.col("event_id")
    weights = [(F.pmod(e * k, F.lit(10)) + 1).cast("double") for k in (3, 7, 11)]
    total = weights[0] + weights[1] + weights[2]
    probs = F.array(*(w / total for w in weights))
    top = F.sort_array(probs, asc=False)
    d = df.withColumn("b_probs", probs)
    return d.withColumn("b_signal", (F.array_position("b_probs", F.array_max("b_probs")) - 2).cast("int")).withColumn("b_confidence", top[0] - top[1])


def fused(df: DataFrame) -> DataFrame:
    """Regime-weighted mean of two signed confidences; dead zone 0.05; 1.15 times the confidence on agreement."""
    w = by(MODEL_WEIGHTS, F.col("regime"))
    d = df.withColumn("combined", w * F.col("signal") * F.col("confidence") + (1 - w) * F.col("b_signal") * F.col("b_confidence"))
    agree = (F.col("signal") == F.col("b_signal")) & (F.col("signal") != 0)
    strength = F.least(F.abs("combined"), F.lit(1.0))
    d = d.withColumn("f_signal", sign(F.col("combined"), 0.05)).withColumn("agree", agree).withColumn("f_confidence", F.when(agree, F.least(strength * 1.15, F.lit(1.0))).otherwise(strength))
    return d.withColumn("actionable", (F.col("f_signal") != 0) & (F.round("f_confidence", 9) >= by(THRESHOLDS, F.col("regime"))))


_CASE = lambda t: "[" + ", ".join(str(t[i]) for i in range(4)) + "][regime + 1]"
_Q = """, qs AS (SELECT *, CASE WHEN round(p50, 9) > 0.0002 THEN 1 WHEN round(p50, 9) < -0.0002 THEN -1 ELSE 0 END AS q_signal, abs(p50) / ((p90 - p10) / 2.5631) / sqrt(2) AS z, 1 / (1 + 0.3275911 * z) AS t,
  greatest(0, least(1, 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z))) AS q_confidence FROM forecasts)"""
_B = """, w AS (SELECT *, CAST(event_id * 3 % 10 + 1 AS DOUBLE) AS w1, CAST(event_id * 7 % 10 + 1 AS DOUBLE) AS w2, CAST(event_id * 11 % 10 + 1 AS DOUBLE) AS w3, w1 + w2 + w3 AS wt, [w1 / wt, w2 / wt, w3 / wt] AS b_probs FROM forecasts)
, b AS (SELECT *, CAST(list_position(b_probs, list_max(b_probs)) - 2 AS INTEGER) AS b_signal, list_reverse_sort(b_probs)[1] - list_reverse_sort(b_probs)[2] AS b_confidence FROM w)"""
_F = _B + f""", c AS (SELECT *, {_CASE(MODEL_WEIGHTS)} * signal * confidence + (1 - {_CASE(MODEL_WEIGHTS)}) * b_signal * b_confidence AS combined, signal = b_signal AND signal <> 0 AS agree FROM b)
, f AS (SELECT *, CASE WHEN round(combined, 9) > 0.05 THEN 1 WHEN round(combined, 9) < -0.05 THEN -1 ELSE 0 END AS f_signal, CASE WHEN agree THEN least(least(abs(combined), 1) * 1.15, 1) ELSE least(abs(combined), 1) END AS f_confidence, f_signal <> 0 AND round(f_confidence, 9) >= {_CASE(THRESHOLDS)} AS actionable FROM c)"""
full = lambda k, d: fused(second_model(forecasts(k, d)))
R.add("n01_quantile_signal", lambda k, d: quantile_signal(forecasts(k, d)).select("event_id", "q_signal", "q_confidence"), sql("forecasts", _Q + columns("event_id q_signal", "q_confidence", "qs")))
R.add("n02_class_signal", lambda k, d: second_model(forecasts(k, d)).select("event_id", "b_signal", "b_confidence"), sql("forecasts", _B + columns("event_id b_signal", "b_confidence", "b")))


def pinball(df: DataFrame) -> DataFrame:
    """Mean quantile loss of p10, p50 and p90 against the next log return."""
    d = with_halo(df, KEYS, 1, lambda x, w: x.withColumn("next", F.log(F.lead("close").over(w.base) / F.col("close"))), ahead=1).where("next is not null")
    d = d.select("instrument", "next", F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.col(c).alias("p")) for q, c in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90"))))).alias("x"))
    e = F.col("next") - F.col("x.p")
    return d.groupBy("instrument", F.col("x.q").alias("q")).agg(F.avg(F.greatest((F.col("x.q") - 1) * e, F.col("x.q") * e)).alias("loss"))


R.add("n03_pinball_loss", lambda k, d: pinball(forecasts(k, d)), sql("forecasts", f", a AS (SELECT *, ln(lead(close) OVER {N} / close) AS next FROM forecasts), u AS (SELECT instrument, next, 0.1 AS q, p10 AS p FROM a UNION ALL SELECT instrument, next, 0.5, p50 FROM a UNION ALL SELECT instrument, next, 0.9, p90 FROM a), o AS (SELECT instrument, CAST(q AS DOUBLE) AS q, avg(greatest((q - 1) * (next - p), q * (next - p))) AS loss FROM u WHERE next IS NOT NULL GROUP BY ALL)" + columns("instrument q", "loss", "o")))
R.add("n04_n06_fusion", lambda k, d: full(k, d).select("event_id", "f_signal", "agree", "f_confidence", "actionable"), sql("forecasts", _F + columns("event_id f_signal agree actionable", "f_confidence", "f", 9)), 9)


def tuned_weights(df: DataFrame, grid: tuple[float, ...] = (0.2, 0.35, 0.5, 0.65, 0.8)) -> DataFrame:
    """Per regime, the first weight of the grid with the best hit rate of active calls against the next move."""
    d = with_halo(df, KEYS, 1, lambda x, w: x.withColumn("truth", F.signum(F.lead("close").over(w.base) - F.col("close"))), ahead=1).where("truth is not null")
    d = d.withColumn("alpha", F.explode(F.array(*(F.lit(a) for a in grid))))
    pred = sign(F.col("alpha") * F.col("signal") + (1 - F.col("alpha")) * F.col("b_signal"), 0.1)
    hits = d.groupBy("regime", "alpha").agg(F.count(F.when(pred != 0, 1)).alias("active"), F.avg(F.when(pred != 0, F.when(pred == F.col("truth"), 1.0).otherwise(0.0))).alias("hit"))
    return hits.where("active >= 5").groupBy("regime").agg(F.max_by("alpha", F.struct(F.round("hit", 12), -F.col("alpha"))).alias("alpha"), F.max("hit").alias("hit"))


R.add("n05_tuned_weights", lambda k, d: tuned_weights(second_model(forecasts(k, d))), sql("forecasts", _B + f", t AS (SELECT *, sign(lead(close) OVER {N} - close) AS truth FROM b), g AS (SELECT *, unnest([0.2, 0.35, 0.5, 0.65, 0.8]) AS alpha FROM t WHERE truth IS NOT NULL), p AS (SELECT *, round(alpha * signal + (1 - alpha) * b_signal, 9) AS s, CASE WHEN s > 0.1 THEN 1 WHEN s < -0.1 THEN -1 ELSE 0 END AS pred FROM g), h AS (SELECT regime, alpha, count(*) FILTER (pred <> 0) AS active, avg(CASE WHEN pred <> 0 THEN CASE WHEN pred = truth THEN 1.0 ELSE 0 END END) AS hit FROM p GROUP BY ALL), o AS (SELECT regime, CAST(alpha AS DOUBLE) AS alpha, hit FROM h WHERE active >= 5 QUALIFY row_number() OVER (PARTITION BY regime ORDER BY round(hit, 12) DESC, alpha) = 1)" + columns("regime", "alpha hit", "o")))
R.add("n16_probability_entropy", lambda k, d: second_model(forecasts(k, d)).select("event_id", (-F.aggregate("b_probs", F.lit(0.0), lambda s, p: s + p * F.log(p + 1e-8))).alias("entropy")), sql("forecasts", _B + ", o AS (SELECT event_id, -list_sum(list_transform(b_probs, lambda p: p * ln(p + 1e-8))) AS entropy FROM b)" + columns("event_id", "entropy", "o")))

# News ----------------------------------------------------------------------------------------


def in_window(bars: DataFrame, articles: DataFrame, hours: int, most: int = 1_024, times: int = 64, places: int | None = None) -> DataFrame:
    """Pairs of a bar and an article published in (ts - hours, ts], with its age in hours (rounded to ``places``): an equi-join on hours, then the bounds.

    Up to ``times`` bars of an hour and up to ``most`` articles of one instant meet in a row, are cut to the
    bounds and then listed, so a task holds the pairs of one row at most. The result is far larger than both
    sides: ages are computed once for a bar and an instant, and the same bars follow each article of a row, in
    which order files hold them in the least space. Its partitions are fixed in number, since by the size of
    its input they would be merged.
    """
    others = [c for c in articles.columns if c != "published_at"]
    place = F.row_number().over(Window.partitionBy("published_at").orderBy("doc_id"))
    dealt = articles.where("published_at is not null").withColumn("_part", F.floor((place - 1) / most))
    together = dealt.groupBy("published_at", "_part").agg(F.collect_list(F.struct(*others)).alias("_articles")).drop("_part")
    spread = together.withColumn("hour", F.explode(F.expr(f"sequence(date_trunc('hour', published_at), date_trunc('hour', published_at) + interval {hours} hours, interval 1 hour)")))
    parts = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hourly = bars.where("ts is not null").withColumn("hour", F.date_trunc("hour", "ts")).repartition(parts, "hour")
    placed = hourly.withColumn("_part", F.floor((F.row_number().over(Window.partitionBy("hour").orderBy("ts")) - 1) / times))
    near = placed.groupBy("hour", "_part").agg(F.collect_list(F.struct(*bars.columns)).alias("_bars"), F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    until = F.col("published_at") + F.expr(f"interval {hours} hours")
    seen = lambda b: (b["ts"] >= F.col("published_at")) & (b["ts"] < until)
    both = near.hint("merge").join(spread, "hour").where((F.col("_last") >= F.col("published_at")) & (F.col("_first") < until) & F.exists("_bars", seen))

    def aged(b: Column) -> Column:
        age = (b["ts"].cast("double") - F.col("published_at").cast("double")) / 3600
        return F.struct(*(b[c].alias(c) for c in bars.columns), (age if places is None else F.round(age, places) + F.lit(0.0)).alias("age"))

    met = both.select("published_at", "_articles", F.transform(F.filter("_bars", seen), aged).alias("_bars"))
    # no list is empty; of plain inlines Spark would test the size of the lists, and for that compute them twice
    listed = met.select("published_at", "_bars", F.inline_outer("_articles")).select("published_at", *others, F.inline_outer("_bars"))
    return listed.select(*bars.columns, "published_at", "age", *others)


def distinct_news(articles: DataFrame) -> DataFrame:
    """The first article of each text hash."""
    return articles.groupBy("text_hash").agg(F.min_by(F.struct("doc_id", "published_at", "score", "intensity"), F.struct("published_at", "doc_id")).alias("a")).select("text_hash", "a.*")


def window_totals(bars: DataFrame, articles: DataFrame, hours: int, decay: float, weighed: dict[str, Column], plain: dict[str, Column], most: dict[str, Column]) -> DataFrame:
    """Per time ``ts`` of a bar, over the articles published in (ts - hours, ts]: sums weighed by decay^age, plain sums and maxima, without pairs.

    Time is cut into blocks as long as the window, so a window is the end of one block and the start of the
    next: running totals of a block, forwards up to ts and backwards down to ts - hours, meet in one row.
    Articles of one instant are one row first. Weights inside a block refer to its end, so they stay
    between 1 and decay^hours. The work grows with bars plus articles. Times without articles have no row.
    """
    span = hours * 3_600_000_000
    sums = weighed | plain
    at = articles.where("published_at is not null").groupBy(F.unix_micros("published_at").alias("_at")).agg(*(F.sum(c).alias(n) for n, c in sums.items()), *(F.max(c).alias(n) for n, c in most.items()))
    at = at.withColumn("_block", F.col("_at") - F.pmod("_at", F.lit(span)))
    faded = F.pow(F.lit(decay), (F.col("_block") + span - F.col("_at")) / 3.6e9)
    side = F.explode(F.array(F.lit(1), F.lit(-1))).alias("_side")
    totals = at.select("_block", "_at", side, *((F.col(n) * faded if n in weighed else F.col(n)).alias(n) for n in [*sums, *most]))
    times = bars.where("ts is not null").select(F.unix_micros("ts").alias("_ts")).distinct().select("_ts", side)
    times = times.withColumn("_at", F.when(F.col("_side") == 1, F.col("_ts")).otherwise(F.col("_ts") - span)).withColumn("_block", F.col("_at") - F.pmod("_at", F.lit(span)))
    # forwards an article counts at its own instant, backwards it does not: there the bar comes first
    so_far = Window.partitionBy("_block", "_side").orderBy(F.col("_at") * F.col("_side"), F.col("_ts").isNotNull().cast("int") * F.col("_side")).rowsBetween(Window.unboundedPreceding, 0)
    run = times.unionByName(totals, allowMissingColumns=True).select(
        "_ts", "_block", *(F.sum(n).over(so_far).alias(n) for n in sums), *(F.max(n).over(so_far).alias(n) for n in most)
    ).where("_ts is not null")
    grown = F.pow(F.lit(decay), (F.col("_ts") - F.col("_block") - span) / 3.6e9)
    both = run.groupBy("_ts").agg(*(F.sum(F.col(n) * grown if n in weighed else F.col(n)).alias(n) for n in sums), *(F.max(n).alias(n) for n in most))
    return both.where(F.coalesce(*plain).isNotNull()).select(F.timestamp_micros("_ts").alias("ts"), *sums, *most)


def decayed_sentiment(bars: DataFrame, articles: DataFrame, hours: int = 4, decay: float = 0.9) -> DataFrame:
    """Per bar: score and intensity weighted by decay^hours, number of articles, shares, and the signal beyond 0.15."""
    rows = settled(bars.select("instrument", "ts"))
    weighed = {"_w": F.lit(1.0), "_s": F.col("score"), "_i": F.col("intensity")}
    plain = {"articles": F.lit(1), "_p": F.when(F.col("score") > 0, 1.0).otherwise(0.0), "_m": F.when(F.col("score") < 0, 1.0).otherwise(0.0)}
    seen = window_totals(rows, articles, hours, decay, weighed, plain, {}).select(
        "ts", (F.col("_s") / F.col("_w")).alias("score"), (F.col("_i") / F.col("_w")).alias("intensity"), "articles", (F.col("_p") / F.col("articles")).alias("positive"), (F.col("_m") / F.col("articles")).alias("negative")
    )
    out = rows.join(seen, "ts", "left").na.fill(0.0, ["score", "intensity", "positive", "negative"]).na.fill(0, ["articles"])
    return out.withColumn("signal", sign(F.col("score"), 0.15))


_NEWS = ", dn AS (SELECT * FROM news QUALIFY row_number() OVER (PARTITION BY text_hash ORDER BY published_at, doc_id) = 1)"
_J8 = ", tb AS (SELECT DISTINCT ts FROM count_bars), j AS (SELECT tb.ts, n.*, (epoch(tb.ts) - epoch(n.published_at)) / 3600 AS age FROM tb JOIN dn AS n ON n.published_at <= tb.ts AND n.published_at > tb.ts - INTERVAL 4 HOUR)"
R.add("n07_distinct_news", lambda k, d: distinct_news(news(k, d)).select("doc_id", "text_hash"), sql("news", _NEWS + " SELECT doc_id, text_hash FROM dn"))
R.add("j08_interval_join", lambda k, d: in_window(forecasts(k, d).select("ts").distinct(), distinct_news(news(k, d)).select("doc_id", "published_at"), 4, places=6).select("ts", "doc_id", "age"), sql("count_bars,news", _NEWS + _J8 + columns("ts doc_id", "age", "j")), None)
R.add("n10_decayed_sentiment", lambda k, d: decayed_sentiment(forecasts(k, d), distinct_news(news(k, d))), sql("count_bars,news", _NEWS + _J8 + ", s AS (SELECT ts, sum(power(0.9, age) * score) / sum(power(0.9, age)) AS score, sum(power(0.9, age) * intensity) / sum(power(0.9, age)) AS intensity, count(*) AS articles, avg(CASE WHEN score > 0 THEN 1.0 ELSE 0 END) AS positive, avg(CASE WHEN score < 0 THEN 1.0 ELSE 0 END) AS negative FROM j GROUP BY ALL), o AS (SELECT b.instrument, b.ts, coalesce(score, 0) AS score, coalesce(intensity, 0) AS intensity, coalesce(articles, 0) AS articles, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative, CASE WHEN round(coalesce(score, 0), 9) > 0.15 THEN 1 WHEN round(coalesce(score, 0), 9) < -0.15 THEN -1 ELSE 0 END AS signal FROM count_bars AS b LEFT JOIN s USING (ts))" + columns("instrument ts articles signal", "score intensity positive negative", "o")))
R.add("n08_keyword_budget", lambda k, d: news(k, d).where(F.lower("full_text").rlike("license|password|pivot|inflation")).withColumn("day", F.to_date("published_at")).withColumn("k", F.row_number().over(Window.partitionBy("day").orderBy("published_at", "doc_id"))).where("k <= 20").select("doc_id", "day"), sql("news", "SELECT doc_id, CAST(published_at AS DATE) AS day FROM news WHERE regexp_matches(lower(full_text), 'license|password|pivot|inflation') QUALIFY row_number() OVER (PARTITION BY CAST(published_at AS DATE) ORDER BY published_at, doc_id) <= 20"))
R.add("n09_score_reuse", lambda k, d: news(k, d).join(distinct_news(news(k, d)).select("text_hash", F.col("doc_id").alias("scored_as"), F.col("score").alias("reused")), "text_hash").select("doc_id", "scored_as", "reused"), sql("news", _NEWS + " SELECT n.doc_id, dn.doc_id AS scored_as, dn.score AS reused FROM news AS n JOIN dn USING (text_hash)"))
R.add("s10_articles", lambda k, d: news(k, d).where(F.trim("full_text") != "").select("doc_id", "published_at", F.length(F.trim("full_text")).alias("length"), "text_hash"), sql("news", "SELECT doc_id, published_at, CAST(length(trim(full_text, ' ')) AS INTEGER) AS length, text_hash FROM news WHERE trim(full_text, ' ') <> ''"))


# Text scores ------------------------------------------------------------------------------------


def composite(df: DataFrame) -> DataFrame:
    """Composite of two text scores: 0.4 and 0.6, 0.25 and 0.75 on surprise, the first alone without confidence in the second."""
    a, b, conf, surprise = F.col("p50") * 1000, F.col("b_signal") * F.lit(0.5), F.col("b_confidence"), F.col("confidence") - 0.5
    wb = F.when(F.round(conf, 9) < 0.15, 0.0).when((F.abs(F.round(surprise, 9)) > 0.4) & (F.round(conf, 9) > 0.5), 0.75).otherwise(0.6)
    raw = (1 - wb) * a + wb * b
    agree = sign(a, 0.15) == F.col("b_signal")
    return df.withColumn("composite", raw).withColumn("c_signal", sign(raw, 0.10)).withColumn("c_confidence", F.least(F.greatest(F.abs(a), conf) * F.when(agree, 1.15).otherwise(0.85), F.lit(1.0)))


_CP = """, cp AS (SELECT *, p50 * 1000 AS ta, b_signal * 0.5 AS tb, CASE WHEN round(b_confidence, 9) < 0.15 THEN 0.0 WHEN abs(round(confidence - 0.5, 9)) > 0.4 AND round(b_confidence, 9) > 0.5 THEN 0.75 ELSE 0.6 END AS wb, (1 - wb) * ta + wb * tb AS composite,
  CASE WHEN round(composite, 9) > 0.1 THEN 1 WHEN round(composite, 9) < -0.1 THEN -1 ELSE 0 END AS c_signal, least(greatest(abs(ta), b_confidence) * CASE WHEN CASE WHEN round(ta, 9) > 0.15 THEN 1 WHEN round(ta, 9) < -0.15 THEN -1 ELSE 0 END = b_signal THEN 1.15 ELSE 0.85 END, 1) AS c_confidence FROM b)"""
_C = _B + _CP
R.add("n12_composite", lambda k, d: composite(second_model(forecasts(k, d))).select("event_id", "c_signal", "composite", "c_confidence"), sql("forecasts", _C + columns("event_id c_signal", "composite c_confidence", "cp")))


def adaptive_weight(df: DataFrame) -> DataFrame:
    """Text weight by the hit rate of the last 20 active calls before a bar: x 1.3 above 0.60, x 0.7 below 0.45, capped."""
    def past(d: DataFrame, w) -> DataFrame:
        return d.withColumn("_move", F.when(F.abs(F.col("close") - w.lag("close")) > 1e-5, F.signum(F.col("close") - w.lag("close"))))

    d = with_halo(df, KEYS, 1, past)
    d = running_sum(d.withColumn("_active", flag((F.col("c_signal") != 0) & F.col("_move").isNotNull())), KEYS, {"_calls": "_active"})
    calls = d.where("_active = 1").select("instrument", F.col("_calls").alias("rn"), flag(F.col("c_signal") == F.col("_move")).cast("double").alias("hit"))
    rates = with_halo(calls, KEYS, 20, lambda x, w: x.withColumn("rate", F.when(F.count("hit").over(w(-19)) >= 5, F.avg("hit").over(w(-19)))))
    rates = rates.select("instrument", F.col("rn").alias("_before"), "rate")
    d = d.withColumn("_before", F.col("_calls") - F.col("_active")).join(rates, ["instrument", "_before"], "left")
    base, rate = by(TEXT_WEIGHTS, F.col("regime")), F.round(F.coalesce("rate", F.lit(0.5)), 9)
    moved = F.when(rate > 0.60, F.least(base * 1.3, F.lit(0.6))).when(rate < 0.45, F.greatest(base * 0.7, F.lit(0.05))).otherwise(base)
    return d.withColumn("weight", F.least(moved, F.when(F.col("regime") == 3, 0.6).otherwise(0.35))).drop("_move", "_active", "_calls", "_before", "rate")


_AW = f""", mv AS (SELECT *, CASE WHEN abs(close - lag(close) OVER {N}) > 1e-5 THEN sign(close - lag(close) OVER {N}) END AS move, c_signal <> 0 AND move IS NOT NULL AS active FROM cp)
, cs AS (SELECT *, sum(CASE WHEN active THEN 1 ELSE 0 END) OVER {N} AS calls FROM mv), cl AS (SELECT instrument, calls, CASE WHEN c_signal = move THEN 1.0 ELSE 0 END AS hit FROM cs WHERE active)
, rt AS (SELECT instrument, calls, CASE WHEN count(*) OVER v >= 5 THEN avg(hit) OVER v END AS rate FROM cl WINDOW v AS (PARTITION BY instrument ORDER BY calls ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
, aw AS (SELECT event_id, round(coalesce(rate, 0.5), 9) AS rr, {_CASE(TEXT_WEIGHTS)} AS base, least(CASE WHEN rr > 0.6 THEN least(base * 1.3, 0.6) WHEN rr < 0.45 THEN greatest(base * 0.7, 0.05) ELSE base END, CASE WHEN regime = 3 THEN 0.6 ELSE 0.35 END) AS weight FROM cs LEFT JOIN rt ON rt.instrument = cs.instrument AND rt.calls = cs.calls - CASE WHEN active THEN 1 ELSE 0 END)"""
R.add("n13_adaptive_weight", lambda k, d: adaptive_weight(composite(second_model(forecasts(k, d)))).select("event_id", "weight"), sql("forecasts", _C + _AW + columns("event_id", "weight", "aw")))

# Decision fusion -----------------------------------------------------------------------------


def decide(df: DataFrame) -> DataFrame:
    """Price and text signals to a decision: weights, 1.2 on agreement, 0.6 on conflict, dead zone 0.08, 0.85 if uncertain.

    The adaptive weight of the text (``weight``), where there is one above 0, overrides that of the
    regime. A decision trades 10,000 units from a confidence of 0.52 on; stops and targets are 12 and
    24 pips where the row has none.
    """
    text = F.col("b_signal") * F.col("b_confidence")
    w = F.when(F.col("weight") > 0, 1 - F.col("weight")).otherwise(by(PRICE_WEIGHTS, F.col("regime")))
    raw = F.col("f_signal") * F.col("f_confidence") * w + text * (1 - w)
    given = {c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in (("stop_pips", 12.0), ("target_pips", 24.0))}
    both = (F.col("f_signal") != 0) & (F.col("b_signal") != 0)
    raw = raw * F.when(both & (F.col("f_signal") == F.col("b_signal")), 1.2).when(both, 0.6).otherwise(1.0)
    certain = F.pmod("event_id", F.lit(5)) != 0
    d = df.withColumn("raw", raw).withColumn("d_signal", sign(raw, 0.08)).withColumn("d_confidence", F.least(F.abs("raw"), F.lit(1.0)) * F.when(certain, 1.0).otherwise(0.85))
    trade = (F.col("d_signal") != 0) & (F.round("d_confidence", 9) >= TRADE_FROM)
    return d.withColumns(given).withColumn("action", F.when(trade, "trade").otherwise("flat")).withColumn("units", F.when(trade, F.col("d_signal") * 10_000).otherwise(0))


_D = _F + _CP + _AW + f""", d1 AS (SELECT *, CASE WHEN weight > 0 THEN 1 - weight ELSE {_CASE(PRICE_WEIGHTS)} END AS pw, (f_signal * f_confidence * pw + b_signal * b_confidence * (1 - pw)) * CASE WHEN f_signal <> 0 AND f_signal = b_signal THEN 1.2 WHEN f_signal <> 0 AND b_signal <> 0 THEN 0.6 ELSE 1.0 END AS raw FROM f LEFT JOIN aw USING (event_id))
, dec AS (SELECT *, CASE WHEN round(raw, 9) > 0.08 THEN 1 WHEN round(raw, 9) < -0.08 THEN -1 ELSE 0 END AS d_signal, least(abs(raw), 1) * CASE WHEN event_id % 5 <> 0 THEN 1.0 ELSE 0.85 END AS d_confidence, CASE WHEN d_signal <> 0 AND round(d_confidence, 9) >= 0.52 THEN 'trade' ELSE 'flat' END AS action, CASE WHEN action = 'trade' THEN d_signal * 10000 ELSE 0 END AS units FROM d1)"""
decisions = lambda k, d: decide(adaptive_weight(composite(full(k, d))))
R.add("d01_d02_decisions", lambda k, d: decisions(k, d).select("event_id", "d_signal", "action", "units", "d_confidence", "stop_pips", "target_pips"), sql("forecasts", _D + columns("event_id d_signal action units", "d_confidence stop_pips target_pips", "(SELECT *, CAST(12 AS DOUBLE) AS stop_pips, CAST(24 AS DOUBLE) AS target_pips FROM dec)", 9)), 9)
R.add("d04_rule_fallback", lambda k, d: forecasts(k, d).select("event_id", F.when((F.col("regime") == 3) & (F.col("confidence") < 0.7), "flat").when((F.col("signal") != 0) & (F.col("confidence") >= 0.52), "trade").otherwise("flat").alias("action"), ((F.col("signal") != 0) | (F.col("regime") == 3)).alias("call_needed")), sql("forecasts", "SELECT event_id, CASE WHEN regime = 3 AND confidence < 0.7 THEN 'flat' WHEN signal <> 0 AND confidence >= 0.52 THEN 'trade' ELSE 'flat' END AS action, signal <> 0 OR regime = 3 AS call_needed FROM forecasts"))
R.add("d05_state_memo", lambda k, d: forecasts(k, d).select("instrument", F.sha2(F.concat_ws("|", "regime", "signal", F.floor(F.col("confidence") * 10).cast("string")), 256).alias("state")).groupBy("instrument").agg(F.count("*").alias("n"), F.count_distinct("state").alias("states")), sql("forecasts", "SELECT instrument, count(*) AS n, count(DISTINCT sha256(concat_ws('|', regime, signal, CAST(floor(confidence * 10) AS BIGINT)))) AS states FROM forecasts GROUP BY ALL"))


# Regimes -------------------------------------------------------------------------------------


def transitions(df: DataFrame) -> DataFrame:
    """Counts of regime changes from one row to the next, as a matrix."""
    d = with_halo(df, KEYS, 1, lambda x, w: x.withColumn("before", w.lag("regime"))).where("before is not null")
    return d.groupBy("instrument", "before").pivot("regime", [0, 1, 2, 3]).count().na.fill(0).select("instrument", "before", *(F.col(str(i)).alias(f"to_{i}") for i in range(4)))


R.add("e14_g04_transitions", lambda k, d: transitions(forecasts(k, d)), sql("forecasts", f", a AS (SELECT *, lag(regime) OVER {N} AS before FROM forecasts) SELECT instrument, before, {', '.join(f'count(*) FILTER (regime = {i}) AS to_{i}' for i in range(4))} FROM a WHERE before IS NOT NULL GROUP BY ALL"))
R.add("e13_regime_quality", lambda k, d: (x := forecasts(k, d).groupBy("instrument", "regime").agg(F.count("*").alias("n"))).join(x.groupBy("instrument").agg(F.sum("n").alias("t")), "instrument").groupBy("instrument").agg((-F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") / F.col("t")))).alias("entropy"), F.max(F.col("n") / F.col("t")).alias("largest")), sql("forecasts", ", x AS (SELECT instrument, regime, count(*) AS n FROM forecasts GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY instrument) AS p FROM x), o AS (SELECT instrument, -sum(p * log2(p)) AS entropy, max(p) AS largest FROM s GROUP BY ALL)" + columns("instrument", "entropy largest", "o")))


def named_states(df: DataFrame) -> DataFrame:
    """Canonical names of raw states: most volatile crisis, then highest mean bull, lowest bear, the rest sideways."""
    d = with_halo(df, KEYS, 1, lambda x, w: x.withColumn("r", F.log(F.col("close") / w.lag("close")))).where("r is not null")
    s = d.groupBy("instrument", F.col("regime").alias("state")).agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("vol"))
    w = Window.partitionBy("instrument")
    s = s.withColumn("crisis", F.row_number().over(w.orderBy(F.desc(F.round("vol", 9)), "state")) == 1)
    calm = Window.partitionBy("instrument", "crisis")
    s = s.withColumn("high", F.row_number().over(calm.orderBy(F.desc(F.round("mean", 9)), "state"))).withColumn("low", F.row_number().over(calm.orderBy(F.round("mean", 9), "state")))
    return s.select("instrument", "state", F.when(F.col("crisis"), 3).when(F.col("high") == 1, 0).when(F.col("low") == 1, 1).otherwise(2).alias("name"), "mean", "vol")


R.add("g03_named_states", lambda k, d: named_states(forecasts(k, d)), sql("forecasts", f", a AS (SELECT *, ln(close / lag(close) OVER {N}) AS r FROM forecasts), s AS (SELECT instrument, regime AS state, avg(r) AS mean, stddev_samp(r) AS vol FROM a WHERE r IS NOT NULL GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY round(vol, 9) DESC, state) = 1 AS crisis FROM s), o AS (SELECT *, CASE WHEN crisis THEN 3 WHEN row_number() OVER (PARTITION BY instrument, crisis ORDER BY round(mean, 9) DESC, state) = 1 THEN 0 WHEN row_number() OVER (PARTITION BY instrument, crisis ORDER BY round(mean, 9), state) = 1 THEN 1 ELSE 2 END AS name FROM c)" + columns("instrument state name", "mean vol", "o")))

# Costs and risk ------------------------------------------------------------------------------


def session(ts: Column) -> Column:
    """Trading session of a time."""
    h = F.hour(ts)
    return F.when(F.weekday(ts) >= 5, "weekend").when((h >= 12) & (h < 16), "overlap").when((h >= 7) & (h < 12), "london").when((h >= 16) & (h < 21), "new_york").otherwise("asian")


def cost(df: DataFrame, units: Column, price: Column, vol: float = 0.001, commission: float = 0.0, high_impact: Column | None = None) -> DataFrame:
    """Adds spread, slippage, commission, impact and total cost (log returns) and the break-even pips of a trade.

    ``commission`` is money per lot; while ``high_impact`` news is out, the spread is the wide one.
    """
    pips = F.greatest(TYPICAL * by(SESSIONS, F.col("session")), F.lit(TIGHTEST))
    if high_impact is not None:
        pips = F.when(high_impact, WIDE).otherwise(pips)
    d = df.withColumn("spread_cost", pips * PIP / price)
    d = d.withColumn("slippage_cost", F.least(0.2 * F.col("spread_cost") + 0.3 * vol, 2 * F.col("spread_cost")))
    d = d.withColumn("impact_cost", F.least(0.1 * vol * F.sqrt(F.abs(units) / 1e10), 0.5 * F.col("spread_cost")))
    d = d.withColumn("commission_cost", F.when(F.abs(units) * price > 0, commission / LOT / price).otherwise(0.0))
    return d.withColumn("total_cost", F.col("spread_cost") + F.col("slippage_cost") + F.col("commission_cost") + F.col("impact_cost")).withColumn("breakeven_pips", F.col("total_cost") * price / PIP)


_SESSION = "CASE WHEN isodow(ts) >= 6 THEN 'weekend' WHEN hour(ts) >= 12 AND hour(ts) < 16 THEN 'overlap' WHEN hour(ts) >= 7 AND hour(ts) < 12 THEN 'london' WHEN hour(ts) >= 16 AND hour(ts) < 21 THEN 'new_york' ELSE 'asian' END"
_COST = f"""session, greatest(0.8 * CASE session WHEN 'overlap' THEN 0.7 WHEN 'london' THEN 0.85 WHEN 'new_york' THEN 0.9 WHEN 'asian' THEN 1.4 ELSE 2.5 END, 0.3) * 0.0001 / price AS spread_cost, least(0.2 * spread_cost + 0.0003, 2 * spread_cost) AS slippage_cost, least(0.0001 * sqrt(abs(units) / 1e10), 0.5 * spread_cost) AS impact_cost, spread_cost + slippage_cost + impact_cost AS total_cost, total_cost * price / 0.0001 AS breakeven_pips"""
_COST_NEWS = _COST.replace("session, greatest(", "session, CASE WHEN hour(ts) = 13 THEN 2.5 ELSE greatest(", 1).replace("END, 0.3) *", "END, 0.3) END *", 1).replace("spread_cost + slippage_cost + impact_cost AS", "CASE WHEN abs(units) * price > 0 THEN 3.5 / 100000 / price ELSE 0 END AS commission_cost, spread_cost + slippage_cost + commission_cost + impact_cost AS")
# news of high impact comes out in the hour from 13:00 on; 3.5 per lot
R.add("c01_c02_costs", lambda k, d: cost(ticks(k, d).withColumn("session", session(F.col("ts"))), F.col("size") * 1000, F.col("price"), commission=3.5, high_impact=F.hour("ts") == 13).select("tick_id", "session", "spread_cost", "slippage_cost", "commission_cost", "impact_cost", "total_cost", F.round("breakeven_pips", 6).alias("breakeven_pips")), sql("ticks", f", x AS (SELECT *, size * 1000 AS units, {_SESSION} AS session FROM ticks), o AS (SELECT * REPLACE (round(breakeven_pips, 6) AS breakeven_pips) FROM (SELECT tick_id, {_COST_NEWS} FROM x))" + columns("tick_id session", "spread_cost slippage_cost commission_cost impact_cost total_cost breakeven_pips", "o", 8)), 8)
R.add("c04_break_even", lambda k, d: cost(ticks(k, d).withColumn("session", session(F.col("ts"))), F.col("size") * 1000, F.col("price")).groupBy("instrument", "session").agg(F.avg("breakeven_pips").alias("breakeven_pips"), F.avg(F.col("total_cost") * 10000).alias("least_return_bps"), F.lit(0.5 + 1 / 3).alias("breakeven_hit_ratio")), sql("ticks", f", x AS (SELECT *, size * 1000 AS units, {_SESSION} AS session FROM ticks), y AS (SELECT instrument, {_COST} FROM x), o AS (SELECT instrument, session, avg(breakeven_pips) AS breakeven_pips, avg(total_cost * 10000) AS least_return_bps, CAST(0.5 AS DOUBLE) + 1.0 / 3 AS breakeven_hit_ratio FROM y GROUP BY ALL)" + columns("instrument session", "breakeven_pips least_return_bps breakeven_hit_ratio", "o")))


def cost_curves(df: DataFrame) -> DataFrame:
    """Costs of position changes over a series: drag so far, gross and net curves."""
    d = with_halo(df, KEYS, 1, lambda x, w: x.withColumn("_before", F.coalesce(w.lag("signal"), F.lit(0))).withColumn("r", F.coalesce(F.log(F.col("close") / w.lag("close")), F.lit(0.0))))
    d = d.withColumn("paid", F.abs(F.col("signal") - F.col("_before")) * 0.4 * PIP / F.col("close")).withColumn("gross", F.col("_before") * F.col("r"))
    return running_sum(d, KEYS, {"drag": "paid", "gross_sum": "gross"}).withColumn("gross_curve", F.exp("gross_sum")).withColumn("net_curve", F.exp(F.col("gross_sum") - F.col("drag")))


R.add("c03_cost_curves", lambda k, d: cost_curves(forecasts(k, d)).select("event_id", "drag", "gross_curve", "net_curve"), sql("forecasts", f", a AS (SELECT *, coalesce(lag(signal) OVER {N}, 0) AS b, coalesce(ln(close / lag(close) OVER {N}), 0) AS r FROM forecasts), o AS (SELECT event_id, sum(abs(signal - b) * 0.4 * 0.0001 / close) OVER {N} AS drag, sum(b * r) OVER {N} AS g, exp(g) AS gross_curve, exp(g - drag) AS net_curve FROM a)" + columns("event_id", "drag gross_curve net_curve", "o")))
R.add("c05_hard_gates", lambda k, d: forecasts(k, d).select("event_id", F.coalesce(F.when(F.col("signal") == 0, "flat_signal"), F.when(F.col("confidence") < 0.52, "low_confidence"), F.when((F.col("regime") == 3) & (F.col("confidence") < 0.62), "crisis_regime_low_confidence"), F.when(F.pmod("event_id", F.lit(11)) == 0, "high_impact_news_blackout"), F.lit("pass")).alias("gate")), sql("forecasts", "SELECT event_id, CASE WHEN signal = 0 THEN 'flat_signal' WHEN confidence < 0.52 THEN 'low_confidence' WHEN regime = 3 AND confidence < 0.62 THEN 'crisis_regime_low_confidence' WHEN event_id % 11 = 0 THEN 'high_impact_news_blackout' ELSE 'pass' END AS gate FROM forecasts"))


def kelly(df: DataFrame, equity: float = 10_000.0, leverage: float = 30.0, unit_cap: int = 100_000, fee: float = 0.00008, drawdown: str | None = None) -> DataFrame:
    """Kelly units from the 20 returns before a bar, capped by regime, scaled by confidence; 1,000 units at least.

    With a column ``drawdown``, sizes shrink from 8 % of it on, down to a tenth at 15 %.
    """
    def build(d: DataFrame, w) -> DataFrame:
        d = d.withColumn("_r", F.coalesce(w.lag("signal"), F.lit(0)) * F.log(F.col("close") / w.lag("close")))
        n = F.count("_r").over(w(-20, -1))
        d = d.withColumn("_mu", F.when(n >= 5, F.avg("_r").over(w(-20, -1))).otherwise((F.col("confidence") - 0.5) * 0.001))
        return d.withColumn("_s2", F.when(n >= 5, F.var_samp("_r").over(w(-20, -1)) + 1e-10).otherwise(1e-6))

    d = with_halo(df, KEYS, 22, build).withColumn("_net", F.col("_mu") - fee).withColumn("kelly", F.col("_net") / F.col("_s2"))
    share = F.least(F.col("kelly"), by(KELLY_CAPS, F.col("regime"))) * F.when(F.col("confidence") < 0.55, F.least(0.5 + F.col("confidence"), F.lit(1.0))).otherwise(1.0)
    deep = F.col(drawdown) > 0.08 if drawdown else F.lit(False)
    if drawdown:
        share = share * F.when(deep, F.greatest(F.lit(0.1), 1 - (F.col(drawdown) - 0.08) / (0.15 - 0.08))).otherwise(1.0)
    most = F.least(F.floor(equity * leverage * by(MAX_POSITION, F.col("regime")) / F.col("close")), F.lit(unit_cap))
    units = F.greatest(F.lit(1000), F.least(F.floor(F.round(equity * leverage * share / F.col("close"), 6)), most)) * F.col("signal")
    reason = F.when(F.col("signal") == 0, "flat_signal").when(F.round("_net", 12) <= 0, "negative_edge_after_costs").when(deep, "drawdown_derisking").when(F.col("confidence") < 0.55, "low_confidence").when(F.round("kelly", 9) <= by(KELLY_CAPS, F.col("regime")), "within_kelly").otherwise("regime_cap")
    d = d.withColumn("reason", reason)
    return d.withColumn("units", F.when(F.col("reason").isin("flat_signal", "negative_edge_after_costs"), 0).otherwise(units).cast("long"))


R.add("c06_kelly", lambda k, d: kelly(forecasts(k, d)).select("event_id", "reason", "units"), sql("forecasts", f""", a AS (SELECT *, coalesce(lag(signal) OVER {N}, 0) * ln(close / lag(close) OVER {N}) AS r FROM forecasts)
, m AS (SELECT *, CASE WHEN count(r) OVER v >= 5 THEN avg(r) OVER v ELSE (confidence - 0.5) * 0.001 END - 0.00008 AS net, CASE WHEN count(r) OVER v >= 5 THEN var_samp(r) OVER v + 1e-10 ELSE 1e-6 END AS s2, net / s2 AS kelly FROM a WINDOW v AS (PARTITION BY instrument ORDER BY rn ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
, r AS (SELECT *, CASE WHEN signal = 0 THEN 'flat_signal' WHEN round(net, 12) <= 0 THEN 'negative_edge_after_costs' WHEN confidence < 0.55 THEN 'low_confidence' WHEN round(kelly, 9) <= {_CASE(KELLY_CAPS)} THEN 'within_kelly' ELSE 'regime_cap' END AS reason, least(kelly, {_CASE(KELLY_CAPS)}) * CASE WHEN confidence < 0.55 THEN least(0.5 + confidence, 1.0) ELSE 1.0 END AS share FROM m)
SELECT event_id, reason, CAST(CASE WHEN reason IN ('flat_signal', 'negative_edge_after_costs') THEN 0 ELSE greatest(1000, least(floor(round(300000.0 * share / close, 6)), least(floor(300000.0 * {_CASE(MAX_POSITION)} / close), 100000))) * signal END AS BIGINT) AS units FROM r"""))
R.add("c07_haircut", lambda k, d: decisions(k, d).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.when(F.col("units") != 0, 1)).alias("active")).withColumn("haircut", 1 / F.sqrt(F.greatest(F.col("active"), F.lit(1)))), sql("forecasts", _D + ", o AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (units <> 0) AS active, 1 / sqrt(greatest(active, 1)) AS haircut FROM dec GROUP BY 1)" + columns("day active", "haircut", "o")))
R.add("c08_stops", lambda k, d: (x := forecasts(k, d).withColumn("_lo", F.abs("p10") * F.col("close") / PIP).withColumn("_hi", F.abs("p90") * F.col("close") / PIP).withColumn("_sl", F.greatest(F.when(F.col("signal") == 1, F.col("_lo")).otherwise(F.col("_hi")), F.lit(3.0)))).withColumn("_tp", F.greatest(F.when(F.col("signal") == 1, F.col("_hi")).otherwise(F.col("_lo")), 1.5 * F.col("_sl"))).select("event_id", (F.col("_sl") * (0.8 + 0.4 * F.col("confidence"))).alias("stop_pips"), (F.col("_tp") * (0.8 + 0.4 * F.col("confidence"))).alias("target_pips")), sql("forecasts", ", a AS (SELECT *, abs(p10) * close / 0.0001 AS lo, abs(p90) * close / 0.0001 AS hi, greatest(CASE WHEN signal = 1 THEN lo ELSE hi END, 3.0) AS sl, greatest(CASE WHEN signal = 1 THEN hi ELSE lo END, 1.5 * sl) AS tp FROM forecasts), o AS (SELECT event_id, sl * (0.8 + 0.4 * confidence) AS stop_pips, tp * (0.8 + 0.4 * confidence) AS target_pips FROM a)" + columns("event_id", "stop_pips target_pips", "o", 5)), 5)
R.add("c09_edge_filter", lambda k, d: forecasts(k, d).select("event_id", (F.round(F.col("signal") * F.col("p50") * F.col("close") / PIP, 9) >= 1.3).alias("enough_edge")), sql("forecasts", "SELECT event_id, round(signal * p50 * close / 0.0001, 9) >= 1.3 AS enough_edge FROM forecasts"))


def rolling_tail(df: DataFrame, n: int = 60, least: int = 10) -> DataFrame:
    """Conditional value at risk of the last n returns: the cut by linear interpolation, then the mean of the tail."""
    def build(d: DataFrame, w) -> DataFrame:
        d = d.withColumn("_r", F.log(F.col("close") / w.lag("close")))
        d = d.withColumn("_all", F.collect_list("_r").over(w(1 - n))).withColumn("_cut", F.percentile("_r", 0.05).over(w(1 - n)))
        tail = F.filter("_all", lambda x: F.round(x, 12) <= F.round("_cut", 12))
        mean = F.aggregate(tail, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(tail), F.lit(0))
        return d.withColumn("cvar", F.when(F.size("_all") < least, 0.002).otherwise(-mean))

    return with_halo(df, KEYS, n + 1, build)


R.add("c10_rolling_cvar", lambda k, d: rolling_tail(forecasts(k, d)).select("event_id", "cvar"), sql("forecasts", f", a AS (SELECT *, ln(close / lag(close) OVER {N}) AS r FROM forecasts), b AS (SELECT event_id, list(r) FILTER (r IS NOT NULL) OVER v AS l, quantile_cont(r, 0.05) OVER v AS cut FROM a WINDOW v AS (PARTITION BY instrument ORDER BY rn ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)), o AS (SELECT event_id, CASE WHEN coalesce(len(l), 0) < 10 THEN 0.002 ELSE -list_avg(list_filter(l, lambda x: round(x, 12) <= round(cut, 12))) END AS cvar FROM b)" + columns("event_id", "cvar", "o")))
R.add("c11_day_pnl", lambda k, d: ticks(k, d).withColumn("day", F.to_date("ts")).select("tick_id", (F.col("price") / F.first("price").over(Window.partitionBy("instrument", "day").orderBy("ts", "tick_id")) - 1).alias("day_return")), sql("ticks", ", o AS (SELECT tick_id, price / first_value(price) OVER (PARTITION BY instrument, CAST(ts AS DATE) ORDER BY ts, tick_id) - 1 AS day_return FROM ticks)" + columns("tick_id", "day_return", "o")))


def sized(df: DataFrame) -> DataFrame:
    """Adds the position fraction of a decision, an input of its own, by integer arithmetic on the event id."""
    return df.withColumn("fraction", F.pmod(F.col("event_id") * 37, F.lit(100)) / 100.0)


def fills(df: DataFrame) -> DataFrame:
    """Next-bar fills: market orders at the open; limit orders 0.3 pips inside, if the next bar trades through; slippage and quality.

    A limit order needs a position ``fraction`` of LIMIT_FROM, no crisis and no thin session.
    """
    def build(d: DataFrame, w) -> DataFrame:
        return d.select("*", *(F.coalesce(F.lead(c).over(w.base), F.col(c)).alias(f"n_{c}") for c in ("open", "high", "low", "close")))

    d = with_halo(df, KEYS, 1, build, ahead=1).withColumn("session", session(F.col("ts")))
    limit = (F.col("regime") != 3) & ~F.col("session").isin("asian", "weekend") & (F.abs(F.round("fraction", 9)) >= LIMIT_FROM)
    d = d.withColumn("limit", limit).withColumn("px", F.col("close") - F.signum("units") * 0.3 * PIP)
    through = F.when(F.col("units") > 0, F.round("n_low", 9) <= F.round("px", 9)).otherwise(F.round("n_high", 9) >= F.round("px", 9))
    traded = F.col("units") != 0
    d = d.withColumn("executed", traded & (~F.col("limit") | through))
    d = d.withColumn("fill_price", F.when(F.col("executed"), F.when(F.col("limit"), F.col("px")).otherwise(F.col("n_open"))))
    d = d.withColumn("order_type", F.when(~traded, "none").when(~F.col("limit"), "MARKET").when(F.col("executed"), "LIMIT").otherwise("LIMIT_EXPIRED"))
    typical = F.round((F.col("n_high") + F.col("n_low") + F.col("n_close")) / 3, 9)
    good = F.when(F.col("units") > 0, F.round("fill_price", 9) <= typical).otherwise(F.round("fill_price", 9) >= typical)
    return d.withColumn("slippage_pips", F.abs(F.col("fill_price") - F.col("close")) / PIP).withColumn("fill_quality", F.when(F.col("executed"), good.cast("double")))


_FILLS = _D + f""", n AS (SELECT *, {', '.join(f'coalesce(lead({c}) OVER {N}, {c}) AS n_{c}' for c in ('open', 'high', 'low', 'close'))}, {_SESSION} AS session, regime <> 3 AND session NOT IN ('asian', 'weekend') AND abs(event_id * 37 % 100 / 100.0) >= 0.58 AS lim, close - sign(units) * 0.3 * 0.0001 AS px FROM dec)
, fl AS (SELECT *, units <> 0 AND (NOT lim OR CASE WHEN units > 0 THEN round(n_low, 9) <= round(px, 9) ELSE round(n_high, 9) >= round(px, 9) END) AS executed, CASE WHEN executed THEN CASE WHEN lim THEN px ELSE n_open END END AS fill_price, CASE WHEN units = 0 THEN 'none' WHEN NOT lim THEN 'MARKET' WHEN executed THEN 'LIMIT' ELSE 'LIMIT_EXPIRED' END AS order_type,
  abs(fill_price - close) / 0.0001 AS slippage_pips, CASE WHEN executed THEN CASE WHEN CASE WHEN units > 0 THEN round(fill_price, 9) <= round((n_high + n_low + n_close) / 3, 9) ELSE round(fill_price, 9) >= round((n_high + n_low + n_close) / 3, 9) END THEN 1.0 ELSE 0 END END AS fill_quality FROM n)"""
R.add("c12_c13_fills", lambda k, d: fills(sized(decisions(k, d))).select("event_id", "order_type", "executed", "slippage_pips", "fill_quality"), sql("forecasts", _FILLS + columns("event_id order_type executed", "slippage_pips fill_quality", "fl", 5)), 5)
R.add("c14_fill_summary", lambda k, d: fills(sized(decisions(k, d))).groupBy("instrument").agg(F.count(F.when(F.col("executed"), 1)).alias("executed"), F.count("*").alias("n"), F.avg("slippage_pips").alias("slippage_pips"), F.avg("fill_quality").alias("fill_quality")), sql("forecasts", _FILLS + ", o AS (SELECT instrument, count(*) FILTER (executed) AS executed, count(*) AS n, avg(slippage_pips) AS slippage_pips, avg(fill_quality) AS fill_quality FROM fl GROUP BY ALL)" + columns("instrument executed n", "slippage_pips fill_quality", "o", 5)), 5)
R.add("c19_best_execution", lambda k, d: fills(sized(decisions(k, d))).where("executed").select("event_id", (F.round("slippage_pips", 6) <= 3).alias("best_execution"), (F.round("slippage_pips", 6) <= 5).alias("slippage_normal")), sql("forecasts", _FILLS + " SELECT event_id, round(slippage_pips, 6) <= 3 AS best_execution, round(slippage_pips, 6) <= 5 AS slippage_normal FROM fl WHERE executed"))


def pre_trade(df: DataFrame, equity: float = 10_000.0, leverage: float = 0.9) -> DataFrame:
    """Pre-trade checks of decisions; names of those that fail, joined by a bar."""
    size = F.abs("units") * F.col("close")
    checks = {"position_limit": size <= equity * 30 * 0.2, "leverage_limit": size / equity <= leverage, "order_size": F.abs("units") <= 500_000, "news_blackout": F.pmod("event_id", F.lit(11)) != 0, "market_hours": F.weekday("ts") < 5}
    return df.withColumn("failures", F.concat_ws("|", *(F.when(~ok, name) for name, ok in checks.items())))


_PRE = _D + ", pt AS (SELECT *, concat_ws('|', CASE WHEN NOT abs(units) * close <= 60000 THEN 'position_limit' END, CASE WHEN NOT abs(units) * close / 10000 <= 0.9 THEN 'leverage_limit' END, CASE WHEN NOT abs(units) <= 500000 THEN 'order_size' END, CASE WHEN event_id % 11 = 0 THEN 'news_blackout' END, CASE WHEN isodow(ts) >= 6 THEN 'market_hours' END) AS failures FROM dec)"
R.add("c17_pre_trade", lambda k, d: pre_trade(decisions(k, d)).select("event_id", "failures"), sql("forecasts", _PRE + " SELECT event_id, failures FROM pt"))
R.add("c20_daily_report", lambda k, d: pre_trade(decisions(k, d)).withColumn("day", F.to_date("ts")).groupBy("day").agg(F.count("*").alias("n"), F.avg((F.col("failures") == "").cast("double")).alias("pass_rate"), F.count(F.when(F.col("failures").contains("news_blackout"), 1)).alias("blackouts")), sql("forecasts", _PRE + ", o AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, avg(CASE WHEN failures = '' THEN 1.0 ELSE 0 END) AS pass_rate, count(*) FILTER (contains(failures, 'news_blackout')) AS blackouts FROM pt GROUP BY 1)" + columns("day n blackouts", "pass_rate", "o")))

def target_units(df: DataFrame, most: int = MOST_UNITS) -> DataFrame:
    """``units`` that a ledger may hold: of compliant rows that trade or reduce, within ``most`` units; else 0."""
    allowed = F.coalesce("compliant", F.lit(True)) & F.coalesce("action", F.lit("flat")).isin("trade", "reduce")
    return df.withColumn("units", F.when(allowed, F.greatest(F.lit(-most), F.least(F.lit(most), F.coalesce("units", F.lit(0))))).otherwise(0))


def ledger(df: DataFrame, equity: float = 10_000.0, stop: float = 0.15, quote_is_home: bool | str = True) -> DataFrame:
    """Causal ledger: a decision fills at the next open; the gap is earned on the old position, the bar on the new one.

    Money is that of the quote currency, or, with ``quote_is_home`` false, of the base currency: gains are
    then divided by the price; the name of a boolean column decides it row by row. The drawdown stop is absorbing, for a flat ledger keeps its drawdown: the
    path without the stop is computed first, and from the first bar whose open drawdown reaches the limit
    all targets are 0. The last bar closes what is held, at its close and at the cost of its session.
    """
    home = F.col(quote_is_home) if isinstance(quote_is_home, str) else F.lit(quote_is_home)

    def money(gain: Column, price: str) -> Column:
        return F.when(home, gain).otherwise(gain / F.col(price))

    def moves(d: DataFrame, w, target: str) -> DataFrame:
        d = d.withColumn("pos", F.coalesce(w.lag(target), F.lit(0)))
        d = d.withColumn("old", F.coalesce(w.lag("pos"), F.lit(0)))
        d = d.withColumn("gap", F.coalesce(money(F.col("old") * (F.col("open") - w.lag("close")), "open"), F.lit(0.0)))
        d = d.withColumn("delta", F.col("pos") - F.col("old")).withColumn("session", session(F.col("ts"))).withColumn("last", F.lead("rn").over(w.base).isNull())
        d = cost(d, F.col("delta"), F.col("open")).withColumn("paid", F.when(F.col("delta") != 0, F.col("total_cost") * F.abs("delta") * F.when(home, F.col("open")).otherwise(1.0)).otherwise(0.0))
        return d.withColumn("net", F.col("gap") + money(F.col("pos") * (F.col("close") - F.col("open")), "close") - F.col("paid"))

    keep = df.columns

    def path(d: DataFrame, target: str) -> DataFrame:
        d = with_halo(d, KEYS, 3, lambda x, w: moves(x, w, target), ahead=1)
        d = running_sum(d, KEYS, {"total": "net"}).withColumn("equity", equity + F.col("total"))
        d = d.withColumn("at_open", F.col("equity") - F.col("net") + F.col("gap")).withColumn("top", F.greatest("equity", "at_open", F.lit(equity)))
        return running_max(d, KEYS, {"peak": "top"})

    df = settled(df)
    first = path(df, "units")
    first = with_halo(first.select(*keep, "equity", "at_open", "peak"), KEYS, 1, lambda x, w: x.withColumn("_peak", F.greatest(F.coalesce(w.lag("peak"), F.lit(equity)), F.col("at_open"))))
    broken = first.where((F.col("_peak") - F.col("at_open")) / F.col("_peak") >= stop).groupBy("instrument").agg(F.min("rn").alias("stopped"))
    flat = df.join(broken, "instrument", "left").withColumn("units", F.when(F.col("rn") >= F.col("stopped") - 1, 0).otherwise(F.col("units")))
    d = path(settled(flat), "units")
    d = cost(d, F.col("pos"), F.col("close")).withColumn("closing", F.when(F.col("last"), F.col("total_cost") * F.abs("pos") * F.when(home, F.col("close")).otherwise(1.0)).otherwise(0.0))
    d = d.withColumn("delta", F.when(F.col("last"), F.col("delta") - F.col("pos")).otherwise(F.col("delta"))).withColumn("pos", F.when(F.col("last"), 0).otherwise(F.col("pos")))
    d = d.withColumn("paid", F.col("paid") + F.col("closing")).withColumn("net", F.col("net") - F.col("closing")).withColumn("equity", F.col("equity") - F.col("closing"))
    return d.withColumn("drawdown", F.greatest(F.lit(0.0), (F.col("peak") - F.col("equity")) / F.col("peak")))


def _ledger_sql(target: str, source: str, tag: str, several: bool = False) -> str:
    money = lambda gain, price: f"CASE WHEN home THEN {gain} ELSE ({gain}) / {price} END" if several else gain
    size = "CASE WHEN home THEN open ELSE 1 END" if several else "open"
    return f""", {tag}1 AS (SELECT *, coalesce(lag({target}) OVER {N}, 0) AS pos FROM {source}), {tag}2 AS (SELECT *, coalesce(lag(pos) OVER {N}, 0) AS old, lag(pos) OVER {N} * (open - lag(close) OVER {N}) AS gap0, coalesce({money('gap0', 'open')}, 0) AS gap, pos - old AS delta, {_SESSION} AS session FROM {tag}1)
, {tag}3 AS (SELECT * EXCLUDE (session), delta AS u, {_COST.replace('/ price', '/ open').replace('* price', '* open').replace('abs(units)', 'abs(delta)')}, CASE WHEN delta <> 0 THEN total_cost * abs(delta) * {size} ELSE 0 END AS paid, gap + {money('pos * (close - open)', 'close')} - paid AS net FROM {tag}2)
, {tag}4 AS (SELECT *, 10000 + sum(net) OVER {N} AS equity, equity - net + gap AS at_open FROM {tag}3), {tag}5 AS (SELECT *, max(greatest(equity, at_open, 10000)) OVER {N} AS peak FROM {tag}4)"""


_TARGET = ", tgt AS (SELECT * REPLACE (CASE WHEN failures = '' AND action IN ('trade', 'reduce') THEN greatest(-500000, least(500000, units)) ELSE 0 END AS units) FROM pt)"


def ledger_sql_tail(several: bool = False) -> str:
    """The ledger ``led`` of table ``tgt``; with ``several``, its column ``home`` tells whose money it is."""
    size = "CASE WHEN home THEN close ELSE 1 END" if several else "close"
    return _ledger_sql("units", "tgt", "a", several) + f""", bp AS (SELECT *, greatest(coalesce(lag(peak) OVER {N}, 10000), at_open) AS opeak FROM a5), br AS (SELECT instrument, min(rn) AS stopped FROM bp WHERE (opeak - at_open) / opeak >= 0.15 GROUP BY ALL)
, fz AS (SELECT tgt.* REPLACE (CASE WHEN rn >= stopped - 1 THEN 0 ELSE units END AS units) FROM tgt LEFT JOIN br USING (instrument))""" + _ledger_sql("units", "fz", "b", several) + f"""
, b6 AS (SELECT event_id, lead(rn) OVER {N} IS NULL AS last, {_COST.replace('/ price', '/ close').replace('* price', '* close').replace('abs(units)', 'abs(pos)')}, CASE WHEN last THEN total_cost * abs(pos) * {size} ELSE 0 END AS closing FROM b5)
, led AS (SELECT b5.* REPLACE (CASE WHEN last THEN delta - pos ELSE delta END AS delta, CASE WHEN last THEN 0 ELSE pos END AS pos, paid + closing AS paid, net - closing AS net, equity - closing AS equity), greatest(0, (peak - (b5.equity - closing)) / peak) AS drawdown FROM b5 JOIN b6 USING (event_id))"""


_LED = _PRE.replace("/ 10000 <= 0.9", "/ 10000 <= 30") + _TARGET + ledger_sql_tail()
compliant = lambda k, d: target_units(pre_trade(decisions(k, d), leverage=30.0).withColumn("compliant", F.col("failures") == ""))
R.add("c15_c16_ledger", lambda k, d: ledger(compliant(k, d)).select("event_id", F.col("pos").cast("int").alias("pos"), F.col("delta").cast("int").alias("delta"), "paid", "net", "equity", "drawdown"), sql("forecasts", _LED + columns("event_id pos delta", "paid net equity drawdown", "led", 4)), 4)


def order_flow(df: DataFrame) -> DataFrame:
    """Surveillance of orders: number of the day, orders of the last minute, time since a change of side."""
    d = df.withColumn("units", F.when(F.pmod("event_id", F.lit(4)) == 0, 100).otherwise(-100))
    day = Window.partitionBy("instrument", F.to_date("ts")).orderBy("ts", "event_id")
    minute = Window.partitionBy("instrument", F.to_date("ts")).orderBy(F.col("ts").cast("long")).rangeBetween(-59, 0)
    flip = F.signum("units") != F.lag(F.signum("units")).over(day)
    return d.select("event_id", F.row_number().over(day).alias("of_day"), F.count("*").over(minute).alias("in_minute"), F.coalesce(flip & (F.col("ts").cast("long") - F.lag(F.col("ts").cast("long")).over(day) < 900), F.lit(False)).alias("wash"))


R.add("c18_order_flow", lambda k, d: order_flow(forecasts(k, d)), sql("forecasts", ", f AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN 100 ELSE -100 END AS units, CAST(ts AS DATE) AS day, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM forecasts) SELECT event_id, CAST(row_number() OVER d AS INTEGER) AS of_day, count(*) OVER (PARTITION BY instrument, day ORDER BY sec RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS in_minute, coalesce(units <> lag(units) OVER d AND sec - lag(sec) OVER d < 900, false) AS wash FROM f WINDOW d AS (PARTITION BY instrument, day ORDER BY ts, event_id)"))


# Orders -------------------------------------------------------------------------------------------


def order_plan(df: DataFrame) -> DataFrame:
    """Orders from the position held to the target: a reversal closes first; a reason and a repeatable id."""
    d = with_halo(df, KEYS, 1, lambda x, w: x.withColumn("held", F.coalesce(w.lag("units"), F.lit(0)))).where("held <> units")
    reverse = (F.col("held") != 0) & (F.col("units") != 0) & (F.signum("held") != F.signum("units"))
    result = F.when(reverse, 0).otherwise(F.col("units"))
    d = d.withColumn("result", result).withColumn("delta", F.col("result") - F.col("held"))
    reason = F.when(reverse, "close_for_reversal").when(F.col("held") == 0, "open").when(F.col("units") == 0, "close").when(F.abs("units") > F.abs("held"), "increase").otherwise("reduce")
    price = F.when(F.col("delta") > 0, F.col("ask_close") * (1 + 2e-4)).otherwise(F.col("bid_close") * (1 - 2e-4))
    return d.withColumn("reason", reason).withColumn("price_bound", price).withColumn("order_id", F.substring(F.sha2(F.concat_ws("|", "instrument", F.col("event_id").cast("string"), F.col("held").cast("string"), F.col("result").cast("string")), 256), 1, 16))


_ORD = _D + f", hd AS (SELECT *, coalesce(lag(units) OVER {N}, 0) AS held FROM dec), od AS (SELECT *, held <> 0 AND units <> 0 AND sign(held) <> sign(units) AS rev, CASE WHEN rev THEN 0 ELSE units END AS result, result - held AS delta, CASE WHEN rev THEN 'close_for_reversal' WHEN held = 0 THEN 'open' WHEN units = 0 THEN 'close' WHEN abs(units) > abs(held) THEN 'increase' ELSE 'reduce' END AS reason, CASE WHEN delta > 0 THEN ask_close * (1 + 2e-4) ELSE bid_close * (1 - 2e-4) END AS price_bound, substring(sha256(concat_ws('|', instrument, event_id, held, result)), 1, 16) AS order_id FROM hd WHERE held <> units)"
R.add("t04_order_plan", lambda k, d: order_plan(decisions(k, d)).select("event_id", F.col("delta").cast("int").alias("delta"), "reason", "order_id", "price_bound"), sql("forecasts", _ORD + columns("event_id delta reason order_id", "price_bound", "od", 7)), 7)
R.add("t05_fill_audit", lambda k, d: order_plan(decisions(k, d)).select("order_id", F.when(F.pmod("event_id", F.lit(13)) == 0, "stale_quote").when((F.col("delta") > 0) & (F.col("ask_close") > F.col("price_bound")), "buy_price_bound_exceeded").when(F.abs("delta") > 500_000, "too_large").otherwise("filled").alias("status")), sql("forecasts", _ORD + " SELECT order_id, CASE WHEN event_id % 13 = 0 THEN 'stale_quote' WHEN delta > 0 AND ask_close > price_bound THEN 'buy_price_bound_exceeded' WHEN abs(delta) > 500000 THEN 'too_large' ELSE 'filled' END AS status FROM od"))
R.add("t06_reconciliation", lambda k, d: (o := order_plan(decisions(k, d))).groupBy("instrument").agg(F.sum("delta").alias("expected")).join(o.where("event_id % 13 <> 0").groupBy("instrument").agg(F.sum("delta").alias("actual")), "instrument", "full_outer").select("instrument", F.coalesce("expected", F.lit(0)).cast("long").alias("expected"), F.coalesce("actual", F.lit(0)).cast("long").alias("actual"), (F.coalesce("expected", F.lit(0)) == F.coalesce("actual", F.lit(0))).alias("in_sync")), sql("forecasts", _ORD + " SELECT instrument, CAST(coalesce(sum(delta), 0) AS BIGINT) AS expected, CAST(coalesce(sum(delta) FILTER (event_id % 13 <> 0), 0) AS BIGINT) AS actual, expected = actual AS in_sync FROM od GROUP BY ALL"))

# Reports -------------------------------------------------------------------------------------

R.add("x06_standings", lambda k, d: ledger(compliant(k, d)).groupBy("instrument").agg(F.max_by(F.struct("equity", "drawdown", "ts"), "rn").alias("x"), F.sum("paid").alias("paid")).select("instrument", "x.ts", "x.equity", "x.drawdown", "paid"), sql("forecasts", _LED + ", o AS (SELECT instrument, arg_max(ts, rn) AS ts, arg_max(equity, rn) AS equity, arg_max(drawdown, rn) AS drawdown, sum(paid) AS paid FROM led GROUP BY ALL)" + columns("instrument ts", "equity drawdown paid", "o", 4)), 4)
R.add("x07_distributions", lambda k, d: full(k, d).groupBy("instrument").agg(*(F.avg((F.col("f_signal") == s).cast("double")).alias(n) for n, s in (("buy", 1), ("sell", -1), ("flat", 0))), F.avg(F.col("agree").cast("double")).alias("agreement"), F.avg(F.col("actionable").cast("double")).alias("acting")), sql("forecasts", _F + ", o AS (SELECT instrument, avg(CASE WHEN f_signal = 1 THEN 1.0 ELSE 0 END) AS buy, avg(CASE WHEN f_signal = -1 THEN 1.0 ELSE 0 END) AS sell, avg(CASE WHEN f_signal = 0 THEN 1.0 ELSE 0 END) AS flat, avg(CASE WHEN agree THEN 1.0 ELSE 0 END) AS agreement, avg(CASE WHEN actionable THEN 1.0 ELSE 0 END) AS acting FROM f GROUP BY ALL)" + columns("instrument", "buy sell flat agreement acting", "o")))
R.add("s19_latest_journal", lambda k, d: decisions(k, d).groupBy("instrument").agg(F.max_by(F.struct("event_id", "action", "units", "ts"), "rn").alias("x")).select("instrument", "x.*"), sql("forecasts", _D + " SELECT instrument, event_id, action, units, ts FROM dec QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY rn DESC) = 1"))
R.add("o09_rolling_monitor", lambda k, d: with_halo(forecasts(k, d), KEYS, 101, lambda x, w: (y := x.withColumn("r", F.col("signal") * F.log(F.lead("close").over(w.base) / F.col("close")))).withColumn("sharpe_100", F.when(F.count("r").over(w(-99)) >= 10, ratio(F.avg("r").over(w(-99)), F.stddev_samp("r").over(w(-99))))).withColumn("hit_50", F.avg(F.when(F.col("r") != 0, F.when(F.col("r") > 0, 1.0).otherwise(0.0))).over(w(-49))), ahead=1).select("event_id", "sharpe_100", "hit_50"), sql("forecasts", f", a AS (SELECT *, signal * ln(lead(close) OVER {N} / close) AS r FROM forecasts), o AS (SELECT event_id, CASE WHEN count(r) OVER s >= 10 THEN avg(r) OVER s / nullif(stddev_samp(r) OVER s, 0) END AS sharpe_100, avg(CASE WHEN r <> 0 THEN CASE WHEN r > 0 THEN 1.0 ELSE 0 END END) OVER h AS hit_50 FROM a WINDOW s AS (PARTITION BY instrument ORDER BY rn ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), h AS (PARTITION BY instrument ORDER BY rn ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))" + columns("event_id", "sharpe_100 hit_50", "o")))
QUERIES, ORACLE_SQL = R.queries, R.sql
