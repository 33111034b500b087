"""Words and word shingles of Arrow text columns as 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer text is hashed alone.
SLICE_BYTES = 2_000_000
#: Words of a shingle.
SHINGLE = 5

_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE_BYTES."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield at, min(to, len(texts))
        at = min(to, len(texts))


def word_spans(texts: pa.Array, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words per row) of rows at..to; null texts have none."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    offsets = offsets[texts.offset + at : texts.offset + to + 1].astype(np.int64)
    none = np.zeros(to - at, np.int64)
    if texts.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint64), none
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = inside[first]
    places = np.flatnonzero(inside)
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), none
    word_at = np.searchsorted(places, starts)  # where each word starts among the bytes of words
    length = np.diff(np.append(word_at, len(places)))
    power = np.full(int(length.max()), _BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    within = np.arange(len(places)) - np.repeat(word_at, length)
    hashes = np.add.reduceat(_BYTE[data[places]] * power[within], word_at)
    counts = np.diff(np.searchsorted(starts, offsets))
    if texts.null_count:  # what a null row's bytes are is not defined
        null = texts.slice(at, to - at).is_null().to_numpy(zero_copy_only=False)
        if counts[null].any():
            keep = np.repeat(~null, counts)
            hashes, counts = hashes[keep], np.where(null, 0, counts)
    return mixed(hashes), counts


def prefix_sums(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums over words, and inverse powers that undo the place of a run."""
    n = len(hashes)
    power = np.full(n + 1, _BASE, np.uint64)
    inverse = np.full(n + 1, _INVERSE, np.uint64)
    power[0] = inverse[0] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * np.cumprod(power)[:n], out=sums[1:])
    return sums, np.cumprod(inverse)


def runs_at(sums: np.ndarray, inverse: np.ndarray, first: np.ndarray, span) -> np.ndarray:
    """Hashes of the runs of ``span`` words that begin at ``first``."""
    return mixed(((sums[first + span] - sums[first]) * inverse[first]) ^ np.asarray(span).astype(np.uint64))


def windows(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all runs of ``size`` words, number of runs per row); a shorter row of words is one run."""
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    if not len(hashes):
        return np.empty(0, np.uint64), runs
    ends = np.cumsum(counts)
    first = np.repeat(ends - counts, runs) + np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
    return runs_at(*prefix_sums(hashes), first, np.repeat(np.minimum(counts, size), runs)), runs


def distinct(values: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values of each row in order, how often each occurs, number of them per row)."""
    if not len(values):
        return values, np.empty(0, np.int64), runs
    values = values.copy()
    ends = np.cumsum(runs)
    for a, b in zip((ends - runs).tolist(), ends.tolist(), strict=True):
        values[a:b].sort()
    new = np.empty(len(values), bool)
    new[0] = True
    new[1:] = values[1:] != values[:-1]
    new[(ends - runs)[runs > 0]] = True
    places = np.flatnonzero(new)
    return values[places], np.diff(np.append(places, len(values))), np.diff(np.searchsorted(places, np.append(0, ends)))


def shingles(texts: pa.Array, at: int, to: int, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, their counts, and the number of distinct ones per row, for rows at..to."""
    return distinct(*windows(*word_spans(texts, at, to), size))
