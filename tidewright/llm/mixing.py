"""Mixing sources to target weights by capped water-filling.

Sources share a budget of words in proportion to their weights. A source is clamped at a maximum
number of epochs over its own words and the excess goes to the others by weight, again and again,
until no source is above its cap. The result is the level at which water stands: with sources in
the order of cap / weight, those below the level are full and the rest share what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, buckets_for, key_bucket, running_total, seeded_key, word_count


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to a table of (source_size, weight), one row per source.

    Source i is clamped if, with all sources before it in the order of cap / weight clamped, its
    share of the rest would still exceed its cap. This closed form is where repeated resharing ends.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "src", "no_src")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = (
        sources.withColumn("cap", cap)
        .withColumn("left", F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(rest))
        .withColumn("open", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    )
    # the water level is the first level that fits; there is none if every source is full
    final = F.first("open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.withColumn("target", F.least("cap", F.coalesce(final * F.col("weight"), F.col("cap")))).drop("cap", "left", "level", "open")


def mix(docs: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), seed: int = 29, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, source) with the words that the mix takes of it.

    Returns doc_id, size, source_size, target, taken, epochs (whole repetitions) and part (words of
    the fractional repetition), and the columns in ``keep``. A source takes all its documents
    floor(target / source_size) times and, for the rest of its target, the first documents of a
    seeded random order; the document at the cut gives its first words only, so that the words
    taken are the target rounded to whole words. The order is a two-level running sum: a hot source
    is spread over buckets. Sources weigh ``weights`` in turn in the order of code points, null
    last. Null and empty texts have no words and take none; repeated rows are each a document;
    sources without words have target 0; an empty table gives no rows.
    """
    tie = F.md5(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(
        "doc_id",
        *(keep or []),
        F.coalesce(F.col("source"), F.lit("")).alias("src"),
        F.col("source").isNull().cast("int").alias("no_src"),
        word_count(F.col("text")).alias("size"),
        seeded_key(seed, F.col("doc_id"), tie).alias("key"),  # rows without an id are spread by their texts
        tie.alias("tie"),
    )
    by_source = rows.groupBy("src", "no_src").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("no_src", "src"))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    targets = water_fill(by_source.withColumn("weight", F.element_at(cycle, ((place - 1) % len(weights) + 1).cast("int"))), share, max_epochs)
    rows = rows.withColumn("bucket", key_bucket(F.col("key"), buckets_for(docs.count())))
    placed = running_total(rows, ["src", "no_src"], "bucket", ["key", "tie", "size"], "size", "before")
    whole = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long")
    part = F.round("target").cast("long") - F.col("epochs") * F.col("source_size")
    return (
        placed.join(targets, ["src", "no_src"])
        .withColumn("epochs", whole)
        .withColumn("part", F.least(F.col("size"), F.greatest(F.lit(0), part - F.col("before"))).cast("long"))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
        .select("doc_id", *(keep or []), "size", F.col("source_size").cast("long"), F.col("target").cast("double"), F.col("taken").cast("long"), "epochs", "part")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document once per repetition, with the columns of ``docs``.

    A fractional repetition that ends inside a document gives the text up to that word, with
    ``n_chars``, where there is such a column, counted anew.
    """
    names = docs.columns
    row = "_tw_row"
    kept = mix(docs.select("doc_id", "text", "source", F.struct(*(F.col(f"`{c}`") for c in names)).alias(row)), keep=[row], **options)
    text = F.col(f"{row}.text")
    lead = F.regexp_extract(text, r"^[\x20\x09-\x0D]*", 0)
    words = F.regexp_extract_all(text, F.lit(rf"({WORD}[\x20\x09-\x0D]*)"), F.lit(1))
    first = F.rtrim(F.concat(lead, F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), "")))
    copies = F.concat(
        F.array_repeat(text, F.col("epochs").cast("int")),
        F.when(F.col("part") == 0, F.array().cast("array<string>")).when(F.col("part") >= F.col("size"), F.array(text)).otherwise(F.array(first)),
    )
    out = kept.where(F.col("taken") > 0).select(row, F.explode(copies).alias("_tw_text"))
    new = {"text": F.col("_tw_text")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("_tw_text") == text, F.col(f"{row}.n_chars")).otherwise(F.char_length("_tw_text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col(f"{row}.`{c}`")).alias(c) for c in names))
