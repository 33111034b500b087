"""Edges of the training-data operators: very long texts, rows without ids, empty tables, brute force of numberings."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import forest, lines, maxscore, mixing, neardup, passages, pieces, secrets, sharding, toxicity
from tidewright.llm.queries import piece_model

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, shard int"


def frame(spark, rows):
    """Documents of (doc_id, text, source), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2) for i, t, s in rows], SCHEMA)


def test_shards_by_brute_force(spark):
    """Ranks, order and cuts, computed by plain sorting."""
    r = random.Random(2)
    rows = [(i if i % 9 else None, f"text {r.randrange(40)}", r.choice([None, "", "a", "b", "c"])) for i in range(300)]
    got = collections.Counter((x["doc_id"], x["source"], x["text_crc32"], round(x["frac"], 12), x["shard"], x["slot"]) for x in sharding.interleave(frame(spark, rows), shards=7).collect())
    keyed = []
    for i, t, s in rows:
        crc, size = zlib.crc32(t.encode()), len(t.encode()) + 1
        keyed.append((s or "", int(s is None), hashlib.md5(f"17:{'' if i is None else i}:{crc}".encode()).hexdigest(), crc, size, i, s))
    by = collections.defaultdict(list)
    for x in keyed:
        by[x[:2]].append(x)
    placed = sorted(((2 * k + 1) / (2 * len(g)), x[1], x[0], x[2:5], x[5], x[6]) for g in by.values() for k, x in enumerate(sorted(g, key=lambda x: x[2:5])))
    want = collections.Counter()
    for p, (frac, _, _, (_, crc, _), i, s) in enumerate(placed):
        shard = p * 7 // 300
        want[i, s, crc, round(frac, 12), shard, p - -(-shard * 300 // 7)] += 1
    assert got == want


def test_rows_without_ids_are_spread(spark):
    from tidewright.llm.common import key_bucket, seeded_key

    rows = spark.range(4_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    counts = rows.groupBy(key_bucket(seeded_key(17, F.col("doc_id"), F.crc32(F.col("text").cast("binary"))), 8).alias("b")).count().collect()
    assert len(counts) == 8 and max(c["count"] for c in counts) < 700
    assert mixing.mix(rows.withColumn("source", F.lit("s"))).agg(F.sum("taken")).first()[0] == 6_000


@pytest.fixture(scope="module")
def long_texts(spark):
    """Texts of several MB: words, one word, one line after the other, and a copy with a changed word."""
    r = random.Random(3)
    many = " ".join(f"w{r.randrange(10**6)}" for _ in range(300_000))
    rows = [(0, many, "a"), (1, many.replace(" w", " changed w", 1), "a"), (2, "z" * 3_000_000, None), (3, "\n".join(f"line {i} of many with words" for i in range(60_000)), "b"), (4, "short", "b")]
    return frame(spark, rows).cache()


def test_long_texts(spark, long_texts):
    assert sharding.interleave(long_texts).count() == 5 and mixing.mix(long_texts).count() == 5
    assert secrets.scan_secrets(long_texts).count() == 5
    same = {x["doc_id"]: x["class_id"] for x in neardup.classes(long_texts).collect()}
    assert same == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    kept = {x["row"]["doc_id"]: x["n_deleted"] for x in lines.deduplicated(long_texts).collect()}
    assert kept == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0}
    found = {(x["doc_id"], x["source_id"]) for x in passages.repeated_passages(long_texts).collect()}
    assert found == {(1, 0)}
    model = toxicity.Model(("idiot",), (), (), (1.0, 0.0, 1.0, 1.0), -3.0)
    assert {x["predicted"] for x in toxicity.score(long_texts, model).collect()} == {0}


def test_long_texts_encode_exactly(spark, long_texts):
    import sentencepiece

    path = piece_model()
    theirs = sentencepiece.SentencePieceProcessor(model_file=path)
    both = pieces.decode_documents(pieces.encode_documents(long_texts.where("doc_id in (0, 4)"), path), path)
    texts = {x["doc_id"]: x["text"] for x in long_texts.collect()}
    for x in both.collect():
        ids = theirs.encode(texts[x["doc_id"]], add_bos=True, add_eos=True)
        assert np.frombuffer(x["ids"], np.uint32).tolist() == ids and x["text"] == theirs.decode(ids)


def test_empty_tables(spark):
    none = frame(spark, [(0, "x", "a")]).where("false")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(none, labels)
    assert toxicity.score(none, model).count() == 0 and toxicity.without_toxic(none, model).count() == 0
    one = toxicity.score(frame(spark, [(0, "x", "a"), (1, None, "a")]), model).collect()
    assert all(0 <= x["score"] <= 1 for x in one)
    assert passages.without_passages(none).count() == 0 and neardup.one_of_each(none).columns == none.columns
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert maxscore.search_exact(vectors).count() == 0 and forest.search_near(vectors).count() == 0


def test_rows_that_repeat_whole(spark):
    text = " ".join(f"w{i}" for i in range(60))
    twice = frame(spark, [(5, text, "a"), (5, text, "a"), (None, "y", "a"), (None, "y", "a"), (7, text, "b")])
    first = [(x["doc_id"], x["first"]) for x in neardup.classes(twice).collect()]
    assert sorted(map(str, first)) == sorted(map(str, [(5, True), (5, False), (7, False), (None, True), (None, False)]))
    assert sorted(str(x["doc_id"]) for x in neardup.one_of_each(twice).collect()) == ["5", "None"]
    vectors = spark.createDataFrame([(20, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")
    for search in (maxscore.search_exact, forest.search_near):
        got = sorted((x["query_id"], x["rank"], x["vec_id"]) for x in search(vectors).collect())
        assert got == [(20, 1, 20), (20, 1, 20), (20, 2, 3), (20, 2, 3)]


def test_pipeline_by_hand(spark, tmp_path):
    """The stages on a small table: what each has to drop, keep or shorten, and the ids at the end."""
    import corpus_pipeline as p

    r = random.Random(9)
    body = [" ".join(f"k{r.randrange(10**6)}" for _ in range(40)) for _ in range(12)]
    footer = "this footer of ten words stands in many of them"
    rows = [(i, f"{b}\n{footer}", "ab"[i % 2]) for i, b in enumerate(body)]
    rows += [(20, rows[0][1], "a"), (21, body[3].replace("k", "q", 1) + f"\n{footer}", "b")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = p.run(spark, str(tmp_path)).collect()
    codec = pieces.codec(piece_model())
    texts = collections.defaultdict(set)
    for x in out:
        texts[x["doc_id"]].add(codec.decode(bytes(x["ids"])))
    assert set(texts) <= set(range(12)) and 0 in texts
    whole = {t for t in texts[0] if len(t.split()) > 40}
    assert all(footer in t for t in whole)  # the first copy of the footer stays
    assert all(footer not in t for i in texts if i for t in texts[i])
    words = sum(len(t.split()) for _, t, _ in rows[:12]) - 11 * 10
    assert abs(sum(len(codec.decode(bytes(x["ids"])).split()) for x in out) - 1.5 * words) <= 0.02 * words
