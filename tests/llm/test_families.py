"""Families of template texts below the threshold: bounded work, and classes as by brute force."""

import random

import numpy as np
import pytest

from tidewright.llm import neardup


def family(size, seed):
    """Texts of 130 words that share all but every eleventh run of two words: about 0.67 alike, with some near copies."""
    r = random.Random(seed)
    frame = [f"t{i}" for i in range(130)]
    texts = []
    for _ in range(size):
        if texts and r.random() < 0.1:
            now = texts[r.randrange(len(texts))].split(" ")
            now[-1] = f"c{r.randrange(10**9)}"
        else:
            now = list(frame)
            for at in (30, 60, 90, 110):
                now[at] = f"n{r.randrange(10**9)}"
        texts.append(" ".join(now))
    return texts


def weighted(texts, weigh):
    out = []
    for t in texts:
        values, counts, _ = neardup.shingles(neardup.pa.array([t]), 0, 1)
        out.append((values, weigh(values, counts)))
    return out


def all_pairs(sets):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if neardup.similarity(sets[i], sets[j]) >= neardup.SIMILARITY:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in range(len(sets))}


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 48)
    monkeypatch.setattr(neardup, "FLOOR", 1.0)  # as if the family were a small part of a corpus


def test_families_equal_brute_force(spark, small_blocks):
    texts = family(260, 5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weigh = neardup.Weights(*neardup.common_shingles(df))
    sets = weighted(texts, weigh)
    some = [neardup.similarity(sets[0], s) for s in sets[1:]]
    assert 0.6 < np.median(some) < 0.8
    rows = neardup.keyed(df, weigh)
    nodes = rows.select("h1", "h2", "bytes", "keys").distinct()
    crowded = nodes.selectExpr("h1 as a", "bytes", "h1 as root")
    assert neardup.split_blocks(crowded, df.selectExpr("xxhash64(text) as h1", "text"), weigh).count() > 0
    assert {x["doc_id"]: x["class_id"] for x in neardup.classes(df).collect()} == all_pairs(sets)


def test_similar_texts_meet_by_rare_tokens(spark, small_blocks):
    """Every similar pair with other roots meets in a block, whatever the lengths and repetitions of its texts."""
    r = random.Random(9)
    texts = []
    for _ in range(30):
        now = [f"w{r.randrange(40)}" for _ in range(r.randrange(30, 200))]
        texts.append(" ".join(now))
        for _ in range(4):
            other = list(now)
            for _ in range(r.randrange(1, 3)):
                other[r.randrange(len(other))] = f"w{r.randrange(40)}"
            texts.append(" ".join(other + other[: r.randrange(1 + len(other) // 9)]))
    texts = sorted(set(texts))
    df = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("xxhash64(text) as h1", "text")
    ids = {x["text"]: x["h1"] for x in df.collect()}
    weigh = neardup.Weights(len(texts), np.empty(0, np.uint64), np.empty(0))
    sets = weighted(texts, weigh)
    near = {(ids[texts[i]], ids[texts[j]]) for i in range(len(texts)) for j in range(i) if neardup.similarity(sets[i], sets[j]) >= neardup.SIMILARITY}
    assert len(near) > 40
    crowded = df.selectExpr("h1 as a", "cast(octet_length(text) as long) as bytes", "h1 as root")
    met = {}
    for x in neardup.split_blocks(crowded, df, weigh).collect():
        met.setdefault((x["key"], x["i"], x["j"]), ([], []))[int(x["rest"])].append(x["a"])
    pairs = {(a, b) for others, rest in met.values() for a in others for b in rest}
    assert all((a, b) in pairs or (b, a) in pairs for a, b in near)


def test_family_blocks_grow_linearly(spark, small_blocks):
    def dealt(size):
        texts = family(size, 6)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        weigh = neardup.Weights(*neardup.common_shingles(df))
        members = neardup.keyed(df, weigh).selectExpr("h1 as a", "bytes", "explode(keys) as key").distinct()
        links = spark.createDataFrame([], "a long, b long")
        return neardup.blocks_across(members, links, df.selectExpr("xxhash64(text) as h1", "text"), weigh).count()

    small, large = dealt(400), dealt(1_600)
    assert large < 5 * small
