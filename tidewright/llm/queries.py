"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, forest, lines, maxscore, mixing, neardup, negatives, passages, pieces, secrets, sharding, toxicity
from .common import table

#: The public model whose encoding op5 gives.
PIECE_MODEL = "piece_bpe_32k.model"
#: The public byte-level vocabulary that op12 aligns with it.
BYTE_MODEL = "byte_bpe_50k.json"


def piece_model(name: str = PIECE_MODEL) -> str:
    """Path of a vocabulary file, as the installed package of vocabularies names it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of ``documents``; counts differ by one at most (law ``rows``)."""
    out = sharding.interleave(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the secrets in every text of ``documents``."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select(
        "doc_id",
        *(count(k) for k in secrets.BASE_KINDS),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every row of ``documents``."""
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", F.col("first").alias("kept"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every text of ``documents`` by a model of ``labels.toxic``."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text of ``documents``, encoded and decoded."""
    model = piece_model()
    both = pieces.decode_documents(pieces.encode_documents(table(spark, sf_dir, "documents"), model), model)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and deleted lines of every row of ``documents``, and a digest of the text that is left."""
    done = lines.deduplicated(table(spark, sf_dir, "documents"))
    return done.select("row.doc_id", "n_lines", "n_deleted", F.md5(F.coalesce("kept", F.lit(""))).alias("kept_md5"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, by source targets."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows of ``embeddings``, as integers, for each row whose id is divisible by 20."""
    return maxscore.search_exact(table(spark, sf_dir, "embeddings"))


def op9_near_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of ``embeddings`` found for each row whose id is divisible by 20."""
    return forest.search_near(table(spark, sf_dir, "embeddings"))


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of ``documents`` that stand in an earlier document too."""
    return passages.repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "start_word", "n_words", "source_id")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every row of ``documents`` in windows of ``benchmark``, and which items these are of."""
    out = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of two tokenizers in every row of ``documents``."""
    aligned = alignment.align(table(spark, sf_dir, "documents"), piece_model(BYTE_MODEL), piece_model())
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    out = alignment.with_link_sums(aligned.withColumn("groups_sha256", F.when(F.col("a").isNull(), digest)).drop("groups"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of the five positives of every row of ``embeddings`` whose id is divisible by 50."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label=label)


#: A line goes if it is in a window of ten words that stands earlier: the shortest one from its first
#: line on, or the shortest one up to its last line. Every run of ten words is a union of such windows.
OP6_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS did, coalesce(text, '') AS text, text IS NULL AS no_text FROM documents
), s AS (
    SELECT r, did, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d
), n AS (
    SELECT r, did, i, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM s
), b AS (
    SELECT r, did, i, t, row_number() OVER (PARTITION BY r ORDER BY i) AS pos, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w,
           sum(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY r ORDER BY i) AS upto FROM n WHERE t <> ''
), l AS (
    SELECT r, list(t ORDER BY pos) AS ts FROM b GROUP BY r
), w AS (
    SELECT 'on' AS kind, x.r, x.did, x.pos AS s, y.pos AS e FROM b AS x ASOF JOIN (SELECT r, pos, upto FROM b) AS y ON x.r = y.r AND x.upto - x.w + 10 <= y.upto
    UNION ALL
    SELECT 'back', x.r, x.did, y.pos, x.pos FROM b AS x ASOF JOIN (SELECT r, pos, upto - w AS before FROM b) AS y ON x.r = y.r AND x.upto - 10 >= y.before
), c AS (
    SELECT kind, w.r, s, e, row_number() OVER (PARTITION BY kind, array_to_string(ts[s:e], chr(10)) ORDER BY did, w.r, s) AS copy FROM w JOIN l ON w.r = l.r
), g AS (
    SELECT DISTINCT r, unnest(range(s, e + 1)) AS pos FROM c WHERE copy > 1
), k AS (
    SELECT n.r, n.i, n.line, g.r IS NOT NULL AS gone FROM n LEFT JOIN b ON n.r = b.r AND n.i = b.i LEFT JOIN g ON b.r = g.r AND b.pos = g.pos
), o AS (
    SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_deleted, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM k GROUP BY r
)
SELECT doc_id, CASE WHEN no_text THEN 0 ELSE n_lines END AS n_lines, n_deleted, md5(kept) AS kept_md5 FROM d JOIN o USING (r)
"""

OP7_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS src, CASE WHEN source IS NULL THEN 1 ELSE 0 END AS no_src,
           CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
           md5('29:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key, md5(coalesce(text, '')) AS tie
    FROM documents
), s AS (
    SELECT src, no_src, CAST(sum(size) AS BIGINT) AS source_size, 2.0 * CAST(sum(size) AS BIGINT) AS cap FROM d GROUP BY ALL
), w AS (
    SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY no_src, src) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight FROM s
), l AS (
    SELECT *, (1.5 * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / weight, src, no_src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY cap / weight, src, no_src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
    SELECT *, least(cap, coalesce((SELECT arg_min(level, cap / weight) FROM l WHERE level * weight <= cap) * weight, cap)) AS target FROM l
), r AS (
    SELECT d.*, source_size, target,
           coalesce(sum(size) OVER (PARTITION BY src, no_src ORDER BY key, tie, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
           CASE WHEN source_size > 0 THEN floor(round(target) / source_size) ELSE 0 END AS epochs
    FROM d JOIN t USING (src, no_src)
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, round(target) - epochs * source_size - before)) AS BIGINT) AS taken
FROM r
"""

OP8_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS c FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.c, v.c) AS BIGINT) AS score
    FROM v AS q, v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

#: Windows of items and of documents meet as whole texts of words.
OP11_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), i AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), j AS (
    SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS s FROM i WHERE len(ws) > 0
), w AS (
    SELECT DISTINCT item_id, n, array_to_string(ws[s:s + n - 1], ' ') AS t FROM j
), k AS (
    SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM w)
), x AS (
    SELECT r, n, s, array_to_string(ws[s:s + n - 1], ' ') AS t FROM k
), h AS (
    SELECT r, s, x.n, item_id FROM x JOIN w ON x.n = w.n AND x.t = w.t
), c AS (
    SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + n)) AS p FROM h) GROUP BY r
), m AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)
"""

OP13_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS alike, CAST(list_dot_product(a.c, v.c) AS BIGINT) AS score
    FROM v AS a, v WHERE a.vec_id % 50 = 0 AND a.vec_id <> v.vec_id
), p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
    SELECT p.*, vec_id AS negative_id, score AS negative_score,
           CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_secret_scan": op2_secret_scan,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_toxicity": op4_toxicity,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_line_dedup": op6_line_dedup,
    "op7_mixing": op7_mixing,
    "op8_exact_search": op8_exact_search,
    "op9_near_search": op9_near_search,
    "op10_passage_dedup": op10_passage_dedup,
    "op11_decontamination": op11_decontamination,
    "op12_alignment": op12_alignment,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL = {"op6_line_dedup": OP6_SQL, "op7_mixing": OP7_SQL, "op8_exact_search": OP8_SQL, "op11_decontamination": OP11_SQL, "op13_hard_negatives": OP13_SQL}
