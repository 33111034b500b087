"""Secret scans: keyword prefilter, anchored expressions near hits, embedded checksums.

An Aho-Corasick automaton runs once over the lower-cased bytes of a text. Only where it meets a
keyword is the expression of that keyword tried, anchored there. Hexadecimal runs have no keyword;
they are found by looking at every 12th byte, since a run of 24 covers two such places in a row.
Kinds whose format embeds a checksum are reported only if it is right.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fields, lean

#: The kinds of the base scan, in the order in which spans at one place are listed.
BASE_KINDS = ("assign", "access", "hex")

#: Keyword (in lower case), kind, expression and shortest length of the group or match.
ASSIGN = rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    (("password", "passwd", "secret", "token", "apikey", "api_key"), "assign", ASSIGN, 1, 6),
    (("akia",), "access", rb"AKIA[A-Z0-9]+", 0, 20),
    (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "github", rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", 0, 40),
    (("npm_",), "npm", rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])", 0, 40),
    (("glsa_",), "grafana", rb"glsa_[A-Za-z0-9]{32}_[0-9a-f]{8}(?![A-Za-z0-9])", 0, 46),
)
HEX_LEAST = 24
DIGITS62 = (string.digits + string.ascii_uppercase + string.ascii_lowercase).encode()

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def base62(n: int, width: int) -> bytes:
    """``n`` in base 62, padded with zeros."""
    out = b""
    while n:
        n, d = divmod(n, 62)
        out = DIGITS62[d : d + 1] + out
    return out.rjust(width, b"0")


def checksum_holds(kind: str, found: bytes) -> bool:
    """Whether the checksum that a token of this kind embeds is right; true for kinds without one."""
    if kind in ("github", "npm"):
        return base62(zlib.crc32(found[4:34]), 6) == found[34:40]
    if kind == "grafana":
        return b"%08x" % zlib.crc32(found[5:37]) == found[38:46]
    return True


@lru_cache(1)
def automaton():
    """The keyword automaton: each hit gives the keyword's length and the rules to try."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, (keywords, *_) in enumerate(RULES):
        for word in keywords:
            out.add_word(word, (len(word), i))
    out.make_automaton()
    return out


EXPRESSIONS = [re.compile(rule[2]) for rule in RULES]
IS_HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))
HEX_RUN = re.compile(rb"[0-9a-f]+")


def hex_runs(data: bytes) -> Iterator[tuple[int, int]]:
    """Maximal runs of at least HEX_LEAST hexadecimal digits."""
    step = HEX_LEAST // 2
    if len(data) < HEX_LEAST:
        return
    seen = IS_HEX[np.frombuffer(data, np.uint8)[step - 1 :: step]]
    end = 0
    for i in np.flatnonzero(seen[:-1] & seen[1:]).tolist():
        at = step - 1 + i * step
        if at >= end:
            start = at
            while start > 0 and IS_HEX[data[start - 1]]:
                start -= 1
            end = HEX_RUN.match(data, start).end()
            if end - start >= HEX_LEAST:
                yield start, end


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of a whole text, in code points, by start and then kind."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    found = [("hex", *span) for span in hex_runs(data)]
    free = [0] * len(RULES)
    for last, (length, i) in sorted(automaton().iter(data.lower().decode("latin-1")), key=lambda hit: hit[0] - hit[1][0]):
        start = last - length + 1
        if start >= free[i] and (m := EXPRESSIONS[i].match(data, start)):
            _, kind, _, group, least = RULES[i]
            free[i] = m.end()
            if m.end(group) - m.start(group) >= least and checksum_holds(kind, m.group()):
                found.append((kind, start, m.end()))
    if not found:
        return []
    order = {k: i for i, k in enumerate((*BASE_KINDS, "github", "npm", "grafana"))}
    found.sort(key=lambda s: (s[1], order[s[0]], s[2]))
    if len(data) != len(text):  # bytes to code points, for the ends of spans only
        ends = sorted({x for _, a, b in found for x in (a, b)})
        at, points, place = 0, 0, {}
        for x in ends:
            points += len(data[at:x].decode("utf-8", "surrogatepass"))
            at = x
            place[x] = points
        found = [(k, place[a], place[b]) for k, a, b in found]
    return found


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, spans) of every row: spans is an array of (kind, start, end), empty for clean texts.

    Whole texts are scanned, each in the task that reads it, so nothing is shuffled. Null and empty
    texts have no spans; repeated rows each get their own; other columns are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPANS_ARROW)], [id_column, "spans"])

    rows = docs.select(id_column, text_column)
    return rows.mapInArrow(lean(scan), fields(rows, [id_column], [("spans", SPANS)]))
