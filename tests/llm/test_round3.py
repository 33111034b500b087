"""Decontamination, tokenizer alignment and hard negatives against brute force; searches and passages however rows are dealt."""

import collections
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewright.llm import alignment, decontaminate, forest, maxscore, negatives, passages, queries, sharding
from tidewright.llm.queries import BYTE_MODEL, piece_model

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def contaminated_by_hand(docs, items):
    windows = collections.defaultdict(set)
    for i, text in items:
        w = words(text)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add(i)
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= {str(i) for i in windows[tuple(w[s : s + n])] if i is not None}
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r[0], r["n_words"], sum(e - b for b, e in r["spans"]), r["items"]) for r in df.collect()), key=str)


def some_docs(spark):
    r = random.Random(3)
    pool = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(r.choice(pool) for _ in range(n))
    items = [(1, text(12)), (2, text(3)), (3, "one"), (4, text(10)), (5, None), (6, ""), (7, "-- !!"), (None, text(14)), (9, text(40)), (9, text(11)), (10, "a b c d"), (11, "é ü x " * 5)]
    known = {i: t for i, t in items if t}
    docs = [(0, None), (1, ""), (2, " .. "), (3, known[1]), (4, f"x {known[1]} y {known[4]}"), (5, known[9][:-1]), (6, (known[1] + " ") * 400), (7, known[1].upper().replace(" ", "--")), (8, text(500)), (8, text(500)), (None, f"a b c d {known[None]}"), (12, "ONE"), (13, "É ü x É ü x")]
    docs += [(i, text(60) + " " + " ".join(known[1].split()[i % 4 : 11])) for i in range(20, 40)]
    schema = "doc_id long, text string, key long, rid long, words string, spans int, place int"
    return docs, items, spark.createDataFrame([(i, t, 1, 2, "w", 3, 4) for i, t in docs], schema), spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, window string")


def test_decontamination_equals_brute_force(spark, monkeypatch):
    docs, items, d, i = some_docs(spark)
    want = contaminated_by_hand(docs, items)
    assert result(decontaminate.contaminated(d, i)) == want
    # however rows are dealt, and when the bitmap lets every key through
    monkeypatch.setattr(decontaminate, "LEAST_BITS", 1 << 15)
    monkeypatch.setattr(decontaminate, "KEY_BITS", 1)
    assert result(decontaminate.contaminated(d.repartition(7), i.repartition(3))) == want


def test_decontamination_of_empty_tables(spark):
    docs, _, d, i = some_docs(spark)
    out = decontaminate.contaminated(d, i.where("false")).collect()
    assert len(out) == len(docs) and all(r["spans"] == [] and r["items"] == [] for r in out)
    assert decontaminate.contaminated(d.where("false"), i).count() == 0


def test_decontamination_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours = queries.op11_decontamination(spark, SF)
    theirs = con.sql(queries.OP11_SQL)
    at = [theirs.columns.index(c) for c in ours.columns]
    assert sorted(map(str, map(tuple, ours.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in theirs.fetchall())


def test_very_common_windows_and_prefixes(spark):
    """A line of the benchmark in every document, and items that share all their rare shingles."""
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    items = [(i, f"{line} tail{i}") for i in range(50)]
    docs = [(i, f"head{i} {line} tail{i % 60} end") for i in range(300)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert result(decontaminate.contaminated(d, i)) == contaminated_by_hand(docs, items)


# Alignment -----------------------------------------------------------------------------------------

ODD = [None, "", " ", "  a  b ", "▁x", "<|endoftext|> a </s><s> <0x41> 😀‍ é 　 x\ty\n\n z", "x" * 5_000, "\n", " \n ", "don't it's I'll 1234567 ...!!", "same words here", "same words here", "中文 русский ﬁ", "a b"]


def byte_table():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def aligned_by_hand(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(piece_model(BYTE_MODEL))
    t.encode_special_tokens = True
    sp, table = sentencepiece.SentencePieceProcessor(model_file=piece_model()), byte_table()
    done, counts, links_of = {}, collections.Counter(), {}
    for d, text in docs:
        done[d] = (0, 0, 0, 0, "")
        if not text:
            continue
        a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        left = [bytes(table[c] for c in t.id_to_token(i)) for i in a]
        right = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(left) == b"".join(right) == (" " + text).encode():
            continue
        spans = []
        for tokens in (left, right):
            at, out = 0, []
            for x in tokens:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(a[i], b[j]) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if x[0] < y[1] and y[0] < x[1]] if len(a) * len(b) < 4_000_000 else None
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, i, j = [], 0, 0
        for e in ends:
            ga, gb = [], []
            while i < len(a) and spans[0][i][1] <= e:
                ga.append(str(a[i]))
                i += 1
            while j < len(b) and spans[1][j][1] <= e:
                gb.append(str(b[j]))
                j += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        done[d] = (len(a), len(b), len(ends), len(links), ";".join(groups))
        links_of[d] = links
        counts.update(set(links))
    best = collections.Counter()
    for (x, _), c in counts.items():
        best[x] = max(best[x], c)
    return {d: (*v[:4], sum(counts[x] == best[x[0]] for x in links_of.get(d, [])), sum(counts[x] for x in links_of.get(d, [])), v[4]) for d, v in done.items()}


def alignments(df, columns=("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")):
    out = alignment.with_link_sums(alignment.align(df, piece_model(BYTE_MODEL), piece_model()))
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in out.collect()}


def test_alignment_equals_brute_force(spark, monkeypatch):
    docs = [(i, t) for i, t in enumerate(ODD)]
    docs += [(1_000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000").orderBy("doc_id").limit(60).collect()]
    df = spark.createDataFrame([(i, t, 1, 2, "g") for i, t in docs], "doc_id long, text string, a int, rid long, groups string")
    want = aligned_by_hand(docs)
    assert alignments(df) == want
    monkeypatch.setattr("tidewright.llm.shingles.SLICE_BYTES", 2_000)  # many bundles
    assert alignments(df.repartition(5)) == want
    assert alignments(df.where("false")) == {}


def test_byte_side_encodes_as_its_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(piece_model(BYTE_MODEL))
    t.encode_special_tokens = True
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").collect()] + [x for x in ODD if x]
    side = alignment.byte_side(piece_model(BYTE_MODEL))
    assert side.encode(texts) == [e.ids for e in t.encode_batch([" " + x for x in texts], add_special_tokens=False)]


# Hard negatives ------------------------------------------------------------------------------------


def mined_by_hand(rows):
    usable = [(i, la, [math.floor(256 * x) for x in v]) for i, la, v in rows if i is not None and la is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (a, la, v) in enumerate(usable):
        if a % 50:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w, strict=False)), i, other) for k, (i, other, w) in enumerate(usable) if k != at))
        for s, p, _ in [x for x in scored if x[2] == la][:5]:
            fit = [(n, i) for n, i, other in scored if other != la and 50 * -s <= 100 * -n <= 95 * -s][:3]
            out += [(a, p, r + 1, i, -s, -n) for r, (n, i) in enumerate(fit)]
    return sorted(out)


def labelled(spark, rows):
    return spark.createDataFrame([(i, v, la, 5, 6) for i, la, v in rows], "vec_id long, embedding array<double>, label int, rid int, limits int")


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    r = random.Random(9)
    point = lambda: [r.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(6)]
    rows = [(i, r.randrange(3), point()) for i in range(400)]
    rows += [(400, 1, None), (401, None, point()), (402, 1, [0.1, None]), (403, 1, [float("nan")] * 6), (None, 1, point()), (404, 2, [0.5, 0.5]), (405, 2, [])]
    rows += [rows[50], rows[50], (50, 2, point()), rows[7]]  # repeated rows, and an id twice
    want = mined_by_hand(rows)
    assert want and sorted(map(tuple, negatives.hard_negatives(labelled(spark, rows)).collect())) == want
    monkeypatch.setattr(negatives, "SHARD_ROWS", 60)
    monkeypatch.setattr(negatives, "BLOCK_QUERIES", 3)
    assert sorted(map(tuple, negatives.hard_negatives(labelled(spark, rows).repartition(5)).collect())) == want
    assert negatives.hard_negatives(labelled(spark, rows).where("false")).count() == 0
    assert negatives.hard_negatives(labelled(spark, rows).where("label = 1")).count() == 0


def test_hard_negative_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(map(tuple, queries.op13_hard_negatives(spark, SF).collect())) == sorted(con.sql(queries.OP13_SQL).fetchall())


# Results do not depend on how rows are dealt --------------------------------------------------------


@pytest.mark.parametrize("module, search", [(maxscore, maxscore.search_exact), (forest, forest.search_near)])
def test_searches_do_not_depend_on_partitions(spark, monkeypatch, module, search):
    monkeypatch.setattr(module, "SHARD_ROWS", 150)
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(12)]) for i in range(600)]
    rows += [rows[20]] * 40 + [rows[3]] * 30 + [(None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [sorted(map(tuple, search(d).collect())) for d in (df.coalesce(1), df.repartition(7), df.orderBy(F.desc("vec_id")))]
    assert found[0] == found[1] == found[2]
    assert collections.Counter(x[0] for x in found[0])[20] == 41 * 20  # each copy of a query has its own results


def test_postings_of_other_terms_are_not_touched():
    import numpy as np

    x = np.random.default_rng(3).normal(size=(8_192, 32))
    x[:, :4] *= 10  # a few terms decide
    shard = maxscore.Postings(np.floor(64 * x).astype(np.int64), np.arange(len(x)), np.arange(len(x)), 4_000.0)
    for q in range(0, 400, 20):
        places, scores = shard.best(np.floor(64 * x[q]).astype(shard.kind), q, 20)
        whole = np.floor(64 * x).astype(np.int64) @ np.floor(64 * x[q]).astype(np.int64)
        whole[q] = whole.min() - 1
        order = np.lexsort((np.arange(len(x)), -whole))[:20]
        assert places.tolist() == order.tolist() and scores.astype(int).tolist() == whole[order].tolist()
    assert shard.done < 0.5 * shard.whole


def test_passages_of_documents_that_share_an_id(spark):
    r = random.Random(5)
    word = lambda: f"v{r.randrange(9_999)}"
    pairs = []
    for _ in range(12):
        shared = " ".join(word() for _ in range(70))
        pairs += [(None, " ".join(word() for _ in range(20)) + " " + shared), (None, shared + " " + " ".join(word() for _ in range(30)))]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    found = [sorted(map(str, passages.repeated_passages(d).collect())) for d in (df.coalesce(1), df.orderBy(F.desc("text")).coalesce(1), df.repartition(7))]
    assert len(found[0]) == 12 and found[0] == found[1] == found[2]


def test_many_small_sources_are_spread(spark):
    """Sources of one row share a fraction; the ranges of the whole order still hold few rows each."""
    docs = spark.range(120_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.concat(F.lit("site"), "id").alias("source"))
    out = sharding.interleave(docs)
    counts = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert len(counts) == 8 and max(counts) - min(counts) <= 1
    assert out.select("position").distinct().count() == 120_000
