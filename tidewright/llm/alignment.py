"""Cross-tokenizer alignment: which tokens of two encodings of a text cover the same bytes.

Per batch of documents, the tokens of either side are a table of byte offsets, and ``merge_asof``,
keyed by document, finds for each token start the token of the other side that covers it. Two tokens
overlap exactly if one of them starts inside of the other, so the union of both directions is all
overlaps. Offsets at which tokens of both sides end cut a document into groups.

How many documents hold a pair of ids linked is a count over the corpus. Documents do not meet it by
themselves: a bundle of documents keeps, for each pair of ids, postings of (document, links). Bundles
are joined with the counts on the pair, once per bundle and not once per document, and postings then
add up per document inside a bundle. Texts are encoded once and are never shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, lean
from .shingles import slices

#: The pattern by which byte-level BPE cuts a text before merging (a fixed value of this vocabulary's family).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Bytes that byte-level vocabularies write as themselves; the others follow from code point 256 on.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


class Side:
    """One tokenizer: ids of texts, and the bytes of each id."""

    def __init__(self, encode, surface: list[bytes]):
        self.encode, self.surface = encode, surface
        self.size = np.array([len(b) for b in surface], np.int64)

    def tokens(self, texts: list[str], wanted: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, tokens per text); a text whose tokens are not the wanted bytes has count -1."""
        ids = self.encode(texts)
        surface = self.surface.__getitem__
        counts = np.array([len(i) if b"".join(map(surface, i)) == w else -1 for i, w in zip(ids, wanted, strict=True)], np.int64)
        return ids, counts


@lru_cache(2)
def byte_side(path: str) -> Side:
    """Byte-level BPE from a tokenizers JSON file, once per worker. Special tokens are plain text.

    The vocabulary's ids are its merge ranks, so tiktoken gives the ids that the file's library gives.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["id"] for t in model.get("added_tokens", [])}
    rest = [b for b in range(256) if b not in PLAIN]
    byte = {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if i not in special}
    surface = [b""] * (max([*ranks.values(), *special]) + 1)
    for token, i in ranks.items():
        surface[i] = token
    coder = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Side(lambda texts: [coder.encode_ordinary(" " + t) for t in texts], surface)


@lru_cache(2)
def piece_side(path: str) -> Side:
    """A SentencePiece model, once per worker; its own leading space stands for the one before the text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    surface = [
        b"" if model.is_control(i) or model.is_unknown(i) else bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
        for i in range(model.get_piece_size())
    ]
    return Side(lambda texts: model.encode(texts, num_threads=1), surface)


def starts_of(counts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of tokens with these sizes, in bytes from the first document of the batch on."""
    ends = np.cumsum(size)
    return np.repeat(np.arange(len(counts)), counts), ends - size, ends


def covering(starts: np.ndarray, doc: np.ndarray, other: np.ndarray, other_doc: np.ndarray) -> np.ndarray:
    """For each token start, the token of the other side, of the same document, that covers it."""
    left = pd.DataFrame({"start": starts, "doc": doc})
    right = pd.DataFrame({"start": other, "doc": other_doc, "token": np.arange(len(other))})
    return pd.merge_asof(left, right, on="start", by="doc")["token"].to_numpy()


class Aligned:
    """The alignment of a batch of documents whose sides cover the same bytes."""

    def __init__(self, a_counts: np.ndarray, a_size: np.ndarray, b_counts: np.ndarray, b_size: np.ndarray):
        self.a_doc, a_start, a_end = starts_of(a_counts, a_size)
        b_doc, b_start, b_end = starts_of(b_counts, b_size)
        over_a = covering(a_start, self.a_doc, b_start, b_doc)
        over_b = covering(b_start, b_doc, a_start, self.a_doc)
        late = a_start[over_b] != b_start  # equal starts are links of the first direction already
        #: token places of all links
        self.a = np.concatenate([np.arange(len(a_start)), over_b[late]])
        self.b = np.concatenate([over_a, np.flatnonzero(late)])
        # a group ends where both sides end
        a_last = b_end[np.minimum(np.searchsorted(b_end, a_end), len(b_end) - 1)] == a_end
        b_last = a_end[np.minimum(np.searchsorted(a_end, b_end), len(a_end) - 1)] == b_end
        self.a_last, self.b_last = np.flatnonzero(a_last), np.flatnonzero(b_last)
        #: documents of groups
        self.group_doc = self.a_doc[self.a_last]


@lru_cache(1)
def labels(n: int) -> list[str]:
    """Decimal ids with what follows them: a comma inside a group's side, a bar after A's, a semicolon after B's."""
    return [f"{i}{c}" for i in range(n) for c in ",|;"]


def groups_text(both: Aligned, a: np.ndarray, b: np.ndarray, a_counts: np.ndarray, b_counts: np.ndarray) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of every document of a batch."""
    # A's tokens come after all of B's earlier groups, B's after A's own group
    a_upto, b_upto = both.a_last + 1, both.b_last + 1
    a_group = np.repeat(np.arange(len(a_upto)), np.diff(a_upto, prepend=0))
    b_group = np.repeat(np.arange(len(b_upto)), np.diff(b_upto, prepend=0))
    codes = np.empty(len(a) + len(b), np.int64)
    a_code, b_code = a * 3, b * 3
    a_code[both.a_last] += 1
    b_code[both.b_last] += 2
    codes[np.arange(len(a)) + np.append(0, b_upto[:-1])[a_group]] = a_code
    codes[np.arange(len(b)) + a_upto[b_group]] = b_code
    parts = list(map(labels(65_536).__getitem__, codes.tolist()))
    cuts = np.append(0, np.cumsum(a_counts + b_counts)).tolist()
    return ["".join(parts[x:y])[:-1] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def pair_postings(both: Aligned, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(A id, B id, documents, postings) of every linked pair of ids; postings are (document, links) as 32-bit integers."""
    doc = both.a_doc[both.a]
    bits = max(1, int(doc.max()).bit_length())
    code = ((a[both.a] << 16 | b[both.b]) << bits) | doc
    code.sort()
    new = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    links = np.diff(np.append(new, len(code)))
    code = code[new]
    pair = code >> bits
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    docs = np.diff(np.append(first, len(pair)))
    body = np.stack([code & ((1 << bits) - 1), links], axis=1).astype(np.int32)
    offsets = np.append(first * 8, len(body) * 8).astype(np.int32)
    postings = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
    return pair[first] >> 16, pair[first] & 0xFFFF, docs, postings


def align(docs: DataFrame, byte_path: str, piece_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows of documents (rid, id, n_a, n_b, n_groups, n_links, groups), and rows of bundles (rid, a, b, docs, postings).

    A is byte-level BPE of space+text by the tokenizers file ``byte_path``, B SentencePiece of the text by
    ``piece_path``. Groups are written ``a1,a2|b1;a3|b2,b3`` in ids. Null and empty texts, and texts that
    the tokens of a side do not give back byte for byte, have no tokens: zeros and an empty text. In rows
    of bundles ``a`` and ``b`` are a linked pair of ids, ``docs`` the number of the bundle's documents
    that hold it, and postings their places after ``rid`` and their links; ``a`` is null in rows of
    documents. Texts are whole: a very long one is a bundle of its own. Rows that repeat are documents of
    their own; other columns play no part; an empty table gives no rows. rids hold for one evaluation of
    this plan only: settle it before it is used twice.
    """
    more = [("rid", T.LongType()), *((n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups", T.StringType())]
    more += [("a", T.IntegerType()), ("b", T.IntegerType()), ("docs", T.LongType()), ("postings", T.BinaryType())]
    rows = docs.select(F.col(id_column), F.monotonically_increasing_id().alias("rid"), F.col(text_column).cast("string").alias("text"))
    schema = T.StructType([rows.schema[id_column], *(T.StructField(n, t) for n, t in more)])
    kinds = {n: {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[t.simpleString().replace("bigint", "long")] for n, t in more}

    def batch_of(n: int, id_type: pa.DataType, **columns) -> pa.RecordBatch:
        arrays = [columns.get(id_column, pa.nulls(n, id_type))]
        for name, kind in kinds.items():
            values = columns.get(name)
            arrays.append(pa.nulls(n, kind) if values is None else values if isinstance(values, pa.Array) else pa.array(values, kind))
        return pa.RecordBatch.from_arrays(arrays, [id_column, *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = byte_side(byte_path), piece_side(piece_path)
        for batch in batches:
            for at, to in slices(batch.column(2)):
                part = batch.slice(at, to - at)
                texts = part.column(2).to_pylist()
                full = [i for i, t in enumerate(texts) if t]
                some = [texts[i] for i in full]
                wanted = [b" " + t.encode() for t in some]
                (a_ids, a_n), (b_ids, b_n) = (side.tokens(some, wanted) for side in sides)
                whole = np.flatnonzero((a_n >= 0) & (b_n >= 0))
                n = {name: np.zeros(len(texts), np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
                groups = [""] * len(texts)
                pairs = None
                if len(whole):
                    place = np.array(full)[whole]
                    a, b = (np.concatenate([np.asarray(ids[i], np.int64) for i in whole.tolist()]) for ids in (a_ids, b_ids))
                    a_n, b_n = a_n[whole], b_n[whole]
                    both = Aligned(a_n, sides[0].size[a], b_n, sides[1].size[b])
                    n["n_a"][place], n["n_b"][place] = a_n, b_n
                    n["n_groups"][place] = np.bincount(both.group_doc, minlength=len(place))
                    n["n_links"][place] = np.bincount(both.a_doc[both.a], minlength=len(place))
                    for i, g in zip(place.tolist(), groups_text(both, a, b, a_n, b_n), strict=True):
                        groups[i] = g
                    both.a_doc = place[both.a_doc]
                    pairs = pair_postings(both, a, b)
                yield batch_of(len(texts), part.schema.field(0).type, **{id_column: part.column(0)}, rid=part.column(1), groups=groups, **n)
                if pairs is not None:
                    yield batch_of(len(pairs[0]), part.schema.field(0).type, rid=np.full(len(pairs[0]), part.column(1)[0].as_py()), a=pairs[0].astype(np.int32), b=pairs[1].astype(np.int32), docs=pairs[2], postings=pairs[3])

    return rows.mapInArrow(lean(run), schema)


def pair_counts(settled: DataFrame) -> DataFrame:
    """(a, b, count, best): in how many documents a pair of ids is linked, and whether that is the most of its A id.

    There are no more pairs than both vocabularies allow, whatever the corpus.
    """
    counts = settled.where("a is not null").groupBy("a", "b").agg(F.sum("docs").alias("count"))
    counts = checkpointed(counts)
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def link_sums(settled: DataFrame) -> DataFrame:
    """(rid, n_best, count_sum) of every document with links, from settled rows of ``align``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            postings = batch.column(3)
            offsets = np.frombuffer(postings.buffers()[1], np.int32)[postings.offset : postings.offset + len(postings) + 1]
            body = np.frombuffer(postings.buffers()[2], np.int32)[offsets[0] // 4 : offsets[-1] // 4].reshape(-1, 2).astype(np.int64)
            n = np.diff(offsets) // 8
            rid = np.repeat(batch.column(0).to_numpy(), n) + body[:, 0]
            count, best = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64), n) for i in (1, 2))
            ids, at = np.unique(rid, return_inverse=True)
            sums = [np.zeros(len(ids), np.int64) for _ in range(2)]
            np.add.at(sums[0], at, best * body[:, 1])
            np.add.at(sums[1], at, count * body[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(ids), *map(pa.array, sums)], ["rid", "n_best", "count_sum"])

    pairs = settled.where("a is not null").select("rid", "a", "b", "postings").join(checkpointed(pair_counts(settled)), ["a", "b"])
    # rows of a bundle come together, so that a document has few partial sums
    near = pairs.select("rid", "count", "best", "postings").repartition("rid").sortWithinPartitions("rid")
    return near.mapInArrow(lean(run), "rid long, n_best long, count_sum long").groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def with_link_sums(aligned: DataFrame) -> DataFrame:
    """Rows of documents of ``align`` (whatever was made of ``groups``) with n_best and count_sum.

    ``n_best`` are a document's links whose pair is in the most documents of all pairs of its A id, ties
    included; ``count_sum`` adds up, over its links, the number of documents that hold the pair.
    """
    settled = checkpointed(aligned)
    docs = settled.where("a is null").drop("a", "b", "docs", "postings")
    none = F.lit(0).cast("long")
    both = docs.join(link_sums(settled), "rid", "left")
    return both.withColumn("n_best", F.coalesce("n_best", none)).withColumn("count_sum", F.coalesce("count_sum", none)).drop("rid")
