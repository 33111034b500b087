"""Ensembles, signal evaluation, lexicon polarity, attributions, exports and models per block, with queries and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import numbered, running_sum, settled, with_halo
from ..plans.registry import Registry, columns
from ..sources.views import bars, forecasts, sql, table
from .decisions import _B, _D, _F, N, PRICE_WEIGHTS, by, decisions, full, second_model
from .evaluation import costed, net_log
from .evaluation_queries import COSTED_SQL, scored
from .evaluation_queries import ORACLE_SQL as EVALUATION_SQL
from .features import KEYS, flag

R = Registry()


def ensemble(df: DataFrame, alpha: float = 0.6) -> DataFrame:
    """alpha x first + (1 - alpha) x second probabilities; the first largest wins, certain from 0.45 on."""
    first = F.array(*(F.when(F.col("regime") == i, 0.7).otherwise(0.1) for i in range(3)))
    d = df.withColumn("mixed", F.zip_with(first, "b_probs", lambda a, b: alpha * a + (1 - alpha) * b))
    d = d.withColumn("best", F.array_max("mixed"))
    return d.withColumn("state", F.array_position("mixed", F.col("best")).cast("int") - 1).withColumn("certain", F.round("best", 9) >= 0.45)


R.add("g05_ensemble", lambda k, d: ensemble(second_model(forecasts(k, d))).select("event_id", "state", "certain", "best"), sql("forecasts", _B + ", e AS (SELECT event_id, list_transform([1, 2, 3], lambda i: 0.6 * CASE WHEN regime = i - 1 THEN 0.7 ELSE 0.1 END + 0.4 * b_probs[i]) AS m FROM b), o AS (SELECT event_id, list_max(m) AS best, CAST(list_position(m, list_max(m)) - 1 AS INTEGER) AS state, round(list_max(m), 9) >= 0.45 AS certain FROM e)" + columns("event_id state certain", "best", "o")))


def agreement_grid(df: DataFrame) -> DataFrame:
    """Share of rows in which the ensemble agrees with the regime, for each weight of a grid."""
    parts = [ensemble(df, a).select(F.lit(a).alias("alpha"), flag(F.col("state") == F.col("regime")).cast("double").alias("ok")) for a in (0.2, 0.4, 0.6, 0.8)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("alpha").agg(F.avg("ok").alias("agreement"))


R.add("g06_agreement_grid", lambda k, d: agreement_grid(second_model(forecasts(k, d))), sql("forecasts", _B + ", g AS (SELECT *, unnest([0.2, 0.4, 0.6, 0.8]) AS alpha FROM b), e AS (SELECT alpha, regime, list_transform([1, 2, 3], lambda i: alpha * CASE WHEN regime = i - 1 THEN 0.7 ELSE 0.1 END + (1 - alpha) * b_probs[i]) AS m FROM g), o AS (SELECT CAST(alpha AS DOUBLE) AS alpha, avg(CASE WHEN list_position(m, list_max(m)) - 1 = regime THEN 1.0 ELSE 0 END) AS agreement FROM e GROUP BY 1)" + columns("alpha", "agreement", "o", 3)), 3)


def signal_hits(df: DataFrame, horizon: int = 3) -> DataFrame:
    """Hit rate of actionable signals at a horizon, per regime with ten rows at least."""
    d = with_halo(df, KEYS, 1, lambda x, w: x.withColumn("move", F.signum(F.lead("close", horizon).over(w.base) - F.col("close"))), ahead=horizon).where("actionable and move is not null")
    return d.groupBy("regime").agg(F.count("*").alias("n"), F.avg(flag(F.col("f_signal") == F.col("move")).cast("double")).alias("hit")).where("n >= 10")


R.add("e12_signal_hits", lambda k, d: signal_hits(full(k, d)), sql("forecasts", _F + f", m AS (SELECT *, sign(lead(close, 3) OVER {N} - close) AS move FROM f), o AS (SELECT regime, count(*) AS n, avg(CASE WHEN f_signal = move THEN 1.0 ELSE 0 END) AS hit FROM m WHERE actionable AND move IS NOT NULL GROUP BY ALL HAVING count(*) >= 10)" + columns("regime n", "hit", "o")))
R.add("e15_agreement_lift", lambda k, d: (x := with_halo(full(k, d), KEYS, 1, lambda y, w: y.withColumn("move", F.signum(F.lead("close").over(w.base) - F.col("close"))), ahead=1).where("move is not null and f_signal <> 0")).groupBy("agree").agg(F.count("*").alias("n"), F.avg(flag(F.col("f_signal") == F.col("move")).cast("double")).alias("accuracy")), sql("forecasts", _F + f", m AS (SELECT *, sign(lead(close) OVER {N} - close) AS move FROM f), o AS (SELECT agree, count(*) AS n, avg(CASE WHEN f_signal = move THEN 1.0 ELSE 0 END) AS accuracy FROM m WHERE move IS NOT NULL AND f_signal <> 0 GROUP BY ALL)" + columns("agree n", "accuracy", "o")))

#: A small lexicon of weights.
LEXICON = {"the": 0.1, "and": 0.2, "pathetic": -1.0, "stupid": -1.0, "idiot": -1.0, "licensed": 0.5}


def polarity(docs: DataFrame) -> DataFrame:
    """Mean weight of the lexicon's words in every whole text."""
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^a-z]+")
    weight = F.transform(words, lambda w: F.element_at(F.create_map(*(F.lit(x) for kv in LEXICON.items() for x in kv)), w))
    known = F.filter(weight, lambda x: x.isNotNull())
    return docs.select("doc_id", F.size(known).alias("n"), F.coalesce(F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(known), F.lit(0)), F.lit(0.0)).alias("polarity"))


_LEX = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in LEXICON.items()) + "}"
R.add("n15_lexicon_polarity", lambda k, d: polarity(table(k, d, "documents")), f"WITH w AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda x: CAST({_LEX}[x] AS DOUBLE)), lambda x: x IS NOT NULL) AS k FROM documents) SELECT doc_id, CAST(len(k) AS INTEGER) AS n, round(coalesce(list_sum(k) / nullif(len(k), 0), 0), 6) + 0.0 AS polarity FROM w")


def latest_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest position of every rule and instrument."""
    from .evaluation_queries import positions

    return positions(spark, sf_dir).groupBy("strategy", "instrument").agg(F.max("ts").alias("ts"), F.max_by("pos", "rn").alias("pos"))


from .evaluation_queries import RULES_SQL  # noqa: E402

R.add("p09_latest_targets", latest_targets, sql("bars", RULES_SQL + ", o AS (SELECT strategy, instrument, max(ts) AS ts, arg_max(pos, rn) AS pos FROM positions GROUP BY ALL)" + columns("strategy instrument ts", "pos", "o")))


def latest_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest position of every forecast variant and instrument."""
    from .evaluation_queries import gated

    names = ["ungated", "gated", "top"]
    return gated(spark, sf_dir).groupBy("instrument").agg(F.max("ts").alias("ts"), *(F.max_by(n, "rn").alias(n) for n in names)).unpivot(["instrument", "ts"], names, "strategy", "pos")


R.add("p09_latest_forecasts", latest_forecasts, f"WITH v AS ({EVALUATION_SQL['p08_forecast_variants']}), l AS (SELECT instrument, max(ts) AS ts, arg_max(ungated, rn) AS ungated, arg_max(gated, rn) AS gated, arg_max(top, rn) AS top FROM v GROUP BY ALL) SELECT instrument, ts, strategy, pos FROM (UNPIVOT l ON ungated, gated, top INTO NAME strategy VALUE pos)")


def learned_weights(df: DataFrame, recent: int = 20, memory: float = 0.95) -> DataFrame:
    """Price and text weights per instrument and regime, learned from the outcomes of decisions.

    ``df`` has decisions with f_signal, b_signal, d_signal and rn. Each decision that took a side and saw
    the price move counts the calls of both sources as right or wrong; once both have ``recent`` calls in
    the regime, the weights move by 1 - ``memory`` towards the shares of their recent hit rates. The newest
    weights are a closed form: the first ones and all targets, weighed by powers of ``memory``.
    """
    keys = ["instrument", "regime"]
    d = with_halo(settled(df).select("instrument", "regime", "ts", "event_id", "rn", "close", "f_signal", "b_signal", "d_signal"), KEYS, 1, lambda x, w: x.withColumn("move", F.signum(F.lead("close").over(w.base) - F.col("close"))), ahead=1)
    d = settled(numbered(d.where("d_signal <> 0 and move is not null").drop("rn"), keys, ["ts", "event_id"], "day"))
    for c in ("f", "b"):
        d = running_sum(d.withColumn(f"_{c}", flag(F.col(f"{c}_signal") != 0)), keys, {f"_n_{c}": f"_{c}"})
        calls = d.where(f"_{c} = 1").select(*keys, F.col(f"_n_{c}").alias("rn"), flag(F.col(f"{c}_signal") == F.col("move")).cast("double").alias("hit"))
        rates = with_halo(calls, keys, recent, lambda x, w: x.withColumn("rate", F.when(F.count("hit").over(w(1 - recent)) >= recent, F.avg("hit").over(w(1 - recent)))))
        d = d.join(rates.select(*keys, F.col("rn").alias(f"_n_{c}"), F.col("rate").alias(f"rate_{c}")), [*keys, f"_n_{c}"], "left")
        d = settled(d)
    steps = numbered(d.where("rate_f is not null and rate_b is not null").drop("rn"), keys, ["ts", "event_id"], "day")
    total = F.col("rate_f") + F.col("rate_b") + 1e-8
    counts = d.select(*keys).distinct().join(steps.groupBy(*keys).agg(F.max("rn").alias("updates")), keys, "left").withColumn("updates", F.coalesce("updates", F.lit(0)).cast("long"))
    power = (1 - memory) * F.pow(F.lit(memory), F.col("updates") - F.col("rn"))
    moved = steps.join(counts, keys).groupBy(*keys).agg(F.sum(power * F.col("rate_f") / total).alias("_f"), F.sum(power * F.col("rate_b") / total).alias("_b"))
    first, left = by(PRICE_WEIGHTS, F.col("regime")), F.pow(F.lit(memory), F.col("updates"))
    return counts.join(moved, keys, "left").select(*keys, "updates", (left * first + F.coalesce("_f", F.lit(0.0))).alias("price_weight"), (left * (1 - first) + F.coalesce("_b", F.lit(0.0))).alias("text_weight"))


_RATE = lambda c: f"""SELECT *, CASE WHEN count(*) OVER v >= 20 THEN avg(hit) OVER v END AS rate FROM (SELECT instrument, regime, n_{c}, CASE WHEN {c}_signal = move THEN 1.0::DOUBLE ELSE 0 END AS hit FROM e2 WHERE {c}_signal <> 0) WINDOW v AS (PARTITION BY instrument, regime ORDER BY n_{c} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""
R.add("d03_learned_weights", lambda k, d: learned_weights(decisions(k, d)), sql("forecasts", _D + f""", e1 AS (SELECT *, sign(lead(close) OVER {N} - close) AS move FROM dec)
, e2 AS (SELECT *, count(*) FILTER (f_signal <> 0) OVER q AS n_f, count(*) FILTER (b_signal <> 0) OVER q AS n_b FROM e1 WHERE d_signal <> 0 AND move IS NOT NULL WINDOW q AS (PARTITION BY instrument, regime ORDER BY ts, event_id))
, rf AS ({_RATE('f')}), rb AS ({_RATE('b')})
, us AS (SELECT e2.instrument, e2.regime, rf.rate AS a, rb.rate AS b, row_number() OVER (PARTITION BY e2.instrument, e2.regime ORDER BY ts, event_id) AS k FROM e2 JOIN rf ON rf.instrument = e2.instrument AND rf.regime = e2.regime AND rf.n_f = e2.n_f JOIN rb ON rb.instrument = e2.instrument AND rb.regime = e2.regime AND rb.n_b = e2.n_b WHERE rf.rate IS NOT NULL AND rb.rate IS NOT NULL)
, ct AS (SELECT e.instrument, e.regime, [0.8, 0.75, 0.7, 0.4][e.regime + 1]::DOUBLE AS w0, count(us.k) AS updates FROM (SELECT DISTINCT instrument, regime FROM e2) AS e LEFT JOIN us ON us.instrument = e.instrument AND us.regime = e.regime GROUP BY ALL)
, o AS (SELECT ct.instrument, ct.regime, updates, power(0.95, updates) * w0 + coalesce(sum(0.05 * power(0.95, updates - k) * a / (a + b + 1e-8)), 0) AS price_weight, power(0.95, updates) * (1 - w0) + coalesce(sum(0.05 * power(0.95, updates - k) * b / (a + b + 1e-8)), 0) AS text_weight FROM ct LEFT JOIN us ON us.instrument = ct.instrument AND us.regime = ct.regime GROUP BY ct.instrument, ct.regime, updates, w0)""" + columns("instrument regime updates", "price_weight text_weight", "o")))


def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly net pips per strategy and instrument at the quoted spread, and the month's number of bars."""
    d = costed(scored(spark, sf_dir), {"spread": 0.8})
    return d.groupBy("strategy", "instrument", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum(F.col("pnl_pips") - F.col("turnover") * 0.4).alias("pips"), F.count("*").alias("bars"), F.round(F.sum(net_log()) * 1e7).cast("long").alias("scaled"))


R.add("x08_monthly_export", export, sql("bars", COSTED_SQL + ", o AS (SELECT strategy, instrument, strftime(ts, '%Y-%m') AS month, sum(pnl_pips - turnover * 0.4) AS pips, count(*) AS bars, CAST(round(sum(net) * 1e7) AS BIGINT) AS scaled FROM priced WHERE cost = 'spread' GROUP BY ALL)" + columns("strategy instrument month bars scaled", "pips", "o", 5)), 5)


def attributions(df: DataFrame) -> DataFrame:
    """A long table (event_id, feature, value) of the parts of each fused decision."""
    return df.select("event_id", F.explode(F.create_map(F.lit("price_signal"), F.col("signal") * F.col("confidence"), F.lit("price_p50"), F.col("p50") * 1000, F.lit("text_signal"), F.col("b_signal") * F.col("b_confidence"))).alias("feature", "value"))


_ATT = _F + ", att AS (SELECT event_id, 'price_signal' AS feature, signal * confidence AS value FROM f UNION ALL SELECT event_id, 'price_p50', p50 * 1000 FROM f UNION ALL SELECT event_id, 'text_signal', b_signal * b_confidence FROM f)"
R.add("x09_global_attribution", lambda k, d: attributions(full(k, d)).groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.avg(flag(F.col("value") > 0).cast("double")).alias("positive"), F.count("*").alias("n")), sql("forecasts", _ATT + ", o AS (SELECT feature, avg(abs(value)) AS mean_abs, avg(value) AS mean, stddev_pop(value) AS std, avg(CASE WHEN value > 0 THEN 1.0 ELSE 0 END) AS positive, count(*) AS n FROM att GROUP BY ALL)" + columns("feature n", "mean_abs mean std positive", "o")))
R.add("x10_group_attribution", lambda k, d: (a := attributions(full(k, d)).withColumn("part", F.split("feature", "_")[0])).join(a.groupBy("event_id").agg(F.sum(F.abs("value")).alias("all")), "event_id").groupBy("event_id", "part").agg((F.sum(F.abs("value")) / F.nullif(F.first("all"), F.lit(0.0))).alias("share")).groupBy("part").agg(F.avg("share").alias("share")), sql("forecasts", _ATT + ", s AS (SELECT event_id, string_split(feature, '_')[1] AS part, sum(abs(value)) AS v FROM att GROUP BY ALL), h AS (SELECT part, v / nullif(sum(v) OVER (PARTITION BY event_id), 0) AS share FROM s), o AS (SELECT part, avg(share) AS share FROM h GROUP BY ALL)" + columns("part", "share", "o")))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document per instrument: its newest decision and its number of trades, with the time of day's slot."""
    d = decisions(spark, sf_dir).groupBy("instrument").agg(F.max_by(F.struct("event_id", "action", "units"), "rn").alias("x"), F.count(F.when(F.col("action") == "trade", 1)).alias("trades"), F.max("ts").alias("ts"))
    slot = F.when(F.hour("ts") < 6, "dawn").when(F.hour("ts") < 18, "day").otherwise("dusk")
    return d.select("instrument", F.to_json(F.struct(F.col("x.event_id").alias("event_id"), F.col("x.action").alias("action"), F.col("x.units").cast("int").alias("units"), "trades", slot.alias("slot"))).alias("document"))


R.add("x05_snapshot", snapshot, sql("forecasts", _D + ", o AS (SELECT instrument, arg_max(event_id, rn) AS e, arg_max(action, rn) AS a, arg_max(units, rn) AS u, count(*) FILTER (action = 'trade') AS t, max(ts) AS ts FROM dec GROUP BY ALL) SELECT instrument, concat('{\"event_id\":', e, ',\"action\":\"', a, '\",\"units\":', u, ',\"trades\":', t, ',\"slot\":\"', CASE WHEN hour(ts) < 6 THEN 'dawn' WHEN hour(ts) < 18 THEN 'day' ELSE 'dusk' END, '\"}') AS document FROM o"))


def lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five lags of log returns and the sign of the next one."""
    def build(d: DataFrame, w) -> DataFrame:
        d = d.withColumn("r", F.log(F.col("close") / w.lag("close")))
        return d.select("*", *(F.lag("r", i).over(w.base).alias(f"lag_{i}") for i in range(5)), F.lead("r").over(w.base).alias("next"))

    return with_halo(bars(spark, sf_dir), KEYS, 7, build, ahead=1).where("next <> 0").dropna(subset=[f"lag_{i}" for i in range(5)]).withColumn("y", (F.col("next") > 0).cast("double"))


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four Gaussian regimes of return and range per bar, fitted on the bars before 2000 and applied to all."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["lag_0", "range"], outputCol="x").transform(lagged(spark, sf_dir).withColumn("range", (F.col("high") - F.col("low")) / F.col("close")))
    fitted = GaussianMixture(k=4, featuresCol="x", predictionCol="state", probabilityCol="p", seed=3, maxIter=20).fit(rows.where("ts < '2000-01-01'"))
    return fitted.transform(rows).groupBy("instrument", "state").agg(F.count("*").alias("n"), F.avg("lag_0").alias("mean"), F.stddev_samp("lag_0").alias("vol"))


R.add("g01_gaussian_regimes", mixture)
QUERIES, ORACLE_SQL = R.queries, R.sql
