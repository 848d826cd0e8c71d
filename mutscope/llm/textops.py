"""Vectorised text helpers for Arrow batches (numpy inside Spark tasks).

Texts of a batch are handled as one byte array with document offsets; words,
hashes and counts come from whole-array numpy operations, never from a Python
loop over characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20     # texts handled at a time; a longer text makes a slice of its own

BATCH_BYTES = 4 << 20     # of an Arrow batch; long texts would otherwise fill memory by row count
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def bound_batches(spark) -> None:
    """Lower the session's limit for the bytes of an Arrow batch to BATCH_BYTES, if it is higher."""
    now = spark.conf.get(_BATCH_KEY, None)
    if not (now or "").isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = arr.cast(pa.large_string()).fill_null("")
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64, len(arr) + 1, arr.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(column, max_bytes: int = SLICE_BYTES):
    """(first, last) row ranges of at most ``max_bytes`` of text (one row at least)."""
    n = len(column)
    if n == 0:
        return
    _, off = utf8(column)
    at = 0
    while at < n:
        end = int(np.searchsorted(off, off[at] + max_bytes, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)


def word_bounds(data: np.ndarray, offsets: np.ndarray):
    """(starts, ends, document of each word) of the words [^\\x20\\x09-\\x0D]+."""
    n = len(data)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e, e
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:n]
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_POW = {"n": 0}


def _powers(n: int):
    """_BASE**i and its inverse modulo 2**64, kept for the next slice."""
    if _POW["n"] < n:
        size = max(n, SLICE_BYTES + 1)
        inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for key, base in (("up", _BASE), ("down", inv)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POW[key] = np.multiply.accumulate(p)
        _POW["n"] = size
    return _POW["up"], _POW["down"]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * _STEP)


def shingle_hashes(words: np.ndarray, doc: np.ndarray, n_docs: int, width: int):
    """(hashes, offsets): shingles of ``width`` words, in document order.

    A document with fewer words (but one at least) has one shingle, its whole
    word sequence; without words it has none.
    """
    per_doc = np.bincount(doc, minlength=n_docs)
    word_off = np.concatenate(([0], np.cumsum(per_doc)))
    n_sh = np.where(per_doc >= width, per_doc - width + 1, (per_doc > 0).astype(np.int64))
    off = np.concatenate(([0], np.cumsum(n_sh)))
    out = np.zeros(off[-1], np.uint64)
    if len(out) == 0:
        return out, off
    owner = np.repeat(np.arange(n_docs), n_sh)
    first = word_off[owner] + np.arange(len(out)) - off[owner]
    size = np.minimum(per_doc[owner], width)
    mult = np.uint64(1)
    for j in range(width):
        inside = j < size
        at = np.where(inside, first + j, 0)
        out += np.where(inside, words[at], np.uint64(0)) * mult
        mult = mult * _BASE
    return mix64(out + size.astype(np.uint64) * _STEP), off


def null_free(column, fill):
    return column.fill_null(fill) if column.null_count else column
