"""SentencePiece BPE encoding by backtracking, and decoding.

Instead of merging pairs from the bottom up, a text is covered from left to right with the longest
piece that starts at each place (found by Aho-Corasick). A piece may follow another only if the two
are compatible: merging their joined characters anew gives these two pieces back. Where no piece
fits, the last one is taken back and replaced by its next shorter prefix; a bitfield of places from
which no cover can go on keeps this linear. A cover whose neighbours are all compatible is the
result of merging.

Texts are cut at places that no piece spans, so that the parts are independent and a bounded cache
of parts answers most of them.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fields, lean

#: The character that stands for a space inside pieces.
SPACE = "▁"
#: Parts of each of two generations, and pairs, that a worker remembers at most: some 70 MB together.
CACHE_PARTS = 150_000
CACHE_PAIRS = 200_000
#: Rows of one output batch.
SLICE = 512


class Parts(dict):
    """Encoded parts by text, in two generations: what is used again moves on from the old one."""

    def __init__(self, encode, old: dict | None = None):
        self.encode, self.old = encode, old or {}

    def __missing__(self, part: str) -> bytes:
        out = self.old.get(part) or array("I", self.encode(part)).tobytes()
        if len(part) <= 32:
            self[part] = out
        return out

    def renewed(self) -> Parts:
        """Itself, or, once full, a new generation with this one as the old; nothing is copied."""
        if len(self) < CACHE_PARTS:
            return self
        self.old = {}
        return Parts(self.encode, self)


class PieceCodec:
    """Encoder and decoder of a SentencePiece BPE model with byte fallback and no normalisation."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], bos: int, eos: int):
        import ahocorasick

        self.pieces, self.bos, self.eos = pieces, bos, eos
        normal = [i for i, k in enumerate(kinds) if k == "normal"]
        self.id = {pieces[i]: i for i in normal}
        self.rank = {pieces[i]: (-scores[i]) for i in normal}
        self.byte_id = {int(pieces[i][3:5], 16): i for i, k in enumerate(kinds) if k == "byte"}
        self.surface = [
            b"" if k == "control" else bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(SPACE, " ").encode() if k == "normal" else " ⁇ ".encode()
            for p, k in zip(pieces, kinds, strict=True)
        ]
        words = [p for p in self.id if p.strip(SPACE)]
        inner = [p for p in words if SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2)]
        if inner:
            raise ValueError(f"pieces that span words are not supported: {inner[:3]}")
        self.known = {c for p in self.id for c in p}
        self.matcher = ahocorasick.Automaton()
        for p in (*words, SPACE):
            self.matcher.add_word(p, (len(p), self.id[p]))
        self.size = [len(p) for p in pieces]
        self.matcher.make_automaton()
        self.shorter = {}
        for p in words:
            q = p[:-1]
            while q and q not in self.id:
                q = q[:-1]
            self.shorter[self.id[p]] = self.id[q] if q else -1
        self.shorter[self.id[SPACE]] = -1
        self.pairs: dict[int, bool] = {}
        self.runs = lru_cache(4096)(self.encode_run)
        self.parts = Parts(self.encode_part)
        # a cut between word characters and others holds only if no piece spans one
        mixed = any(re.search(rf"\w[^\w{SPACE}]|[^\w{SPACE}]\w", p) for p in words)
        lines = any("\n" in p for p in words)
        rest = rf"\w+|{SPACE}*[^\w{SPACE}\n]+" if not mixed else rf"[^{SPACE}\n]+"
        self.cut = re.compile(rf"{SPACE}*{rest}|\n|{SPACE}+" if not lines else rf"{SPACE}*[^{SPACE}]+|{SPACE}+")

    @classmethod
    def from_file(cls, path: str) -> PieceCodec:
        """The codec of a model file."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        kinds = ["control" if model.is_control(i) else "byte" if model.is_byte(i) else "unknown" if model.is_unknown(i) else "normal" for i in ids]
        return cls([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], kinds, model.bos_id(), model.eos_id())

    def merged(self, text: str) -> list[str]:
        """Merging from the bottom up: the best pair first, the leftmost of equals. For short texts."""
        symbols = list(text)
        rank = self.rank
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                r = rank.get(symbols[i] + symbols[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' characters anew gives the two back (left -1: the start of the text)."""
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        b = self.pieces[right]
        both = [b] if left < 0 else [self.pieces[left], b]
        self.pairs[(left + 1) << 16 | right] = out = self.merged("".join(both)) == both
        return out

    def cover(self, text: str) -> list[int]:
        """Pieces of a text of known characters, by backtracking."""
        n = len(text)
        longest = [-1] * n
        for end, (k, i) in self.matcher.iter(text):
            longest[end - k + 1] = i  # of those that start here, the longest ends last
        size, shorter, pairs = self.size, self.shorter, self.pairs
        out: list[int] = []
        failed = bytearray(n + 1)
        at, last, piece = 0, -1, longest[0]
        while True:
            end = at + size[piece]
            if not failed[end]:
                fit = pairs.get((last + 1) << 16 | piece)
                if fit or fit is None and self.fits(last, piece):
                    out.append(piece)
                    if end == n:
                        return out
                    at, last, piece = end, piece, longest[end]
                    continue
            piece = shorter[piece]
            while piece < 0:  # no piece fits here: take the last one back and try its next shorter prefix
                failed[at] = 1
                piece = out.pop()
                at -= size[piece]
                last = out[-1] if out else -1
                piece = shorter[piece]

    def encode_run(self, n: int) -> list[int]:
        """Pieces of n spaces in a row: all pairs rank alike, so the leftmost merges first."""
        rank = self.rank
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < n and (r := rank.get(SPACE * (size[i] + size[j]))) is not None:
                heapq.heappush(heap, (r, i, size[i] + size[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, total = heapq.heappop(heap)
            j = after[i]
            if size[i] == 0 or j >= n or size[i] + size[j] != total:
                continue
            size[i], size[j], after[i] = total, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            offer(before[i], i)
        return [self.id[SPACE * s] for s in size if s]

    def encode_part(self, part: str) -> list[int]:
        """Pieces of a part: spaces and what follows them up to the next cut."""
        body = part.lstrip(SPACE)
        spaces = len(part) - len(body)
        if not body:
            return self.runs(spaces)
        out: list[int] = []
        held = min(spaces, 1)
        word = SPACE * held
        if self.known.issuperset(body):
            word, body = word + body, ""
        for c in body:
            if c in self.known:
                word += c
                continue
            if word:
                out += self.cover(word)
            word = ""
            out += [self.byte_id[b] for b in c.encode("utf-8", "replace")]
        if word:
            out += self.cover(word)
        if held and out[0] == self.id[SPACE]:
            return [*self.runs(spaces), *out[1:]]  # nothing took the last space: it merges with its run
        return [*self.runs(spaces - 1), *out] if spaces > 1 else out

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, with begin and end."""
        parts = self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []
        self.parts = self.parts.renewed()
        return array("I", [self.bos]).tobytes() + b"".join(map(self.parts.__getitem__, parts)) + array("I", [self.eos]).tobytes()

    def decode(self, ids: bytes) -> str:
        """The text of such ids."""
        body = b"".join(map(self.surface.__getitem__, array("I", ids))).decode("utf-8", "replace")
        return body[1:] if body[:1] == " " else body


@lru_cache(2)
def codec(path: str) -> PieceCodec:
    """The codec of a model file, once per worker."""
    return PieceCodec.from_file(path)


def encode_documents(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids) of every row: ids is binary, little-endian unsigned 32-bit, with begin and end ids.

    Null and empty texts give the begin and end ids alone. Rows are encoded whole, one by one, in
    the task that reads them; repeated rows each get their own; other columns are ignored; an empty
    table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(own.encode, part.column(1).to_pylist()), pa.binary())], [id_column, "ids"])

    rows = docs.select(id_column, text_column)
    return rows.mapInArrow(lean(run), fields(rows, [id_column], [("ids", T.BinaryType())]))


def decode_documents(encoded: DataFrame, model: str, id_column: str = "doc_id") -> DataFrame:
    """(id, ids, text) of rows that ``encode_documents`` gives; null ids give the empty text, an empty table no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = [own.decode(x or b"") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], [id_column, "ids", "text"])

    rows = encoded.select(id_column, "ids")
    return rows.mapInArrow(lean(run), fields(rows, [id_column], [("ids", T.BinaryType()), ("text", T.StringType())]))
