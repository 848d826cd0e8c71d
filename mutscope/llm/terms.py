"""Terms of texts in Arrow batches: runs of member bytes, only A-Z lower-cased."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import textops as T


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Which bytes belong to a term: the given inclusive ranges and every byte of a non-ASCII character."""
    member = np.zeros(256, bool)
    member[0x80:] = True
    for lo, hi in ranges:
        member[lo:hi + 1] = True
    return member


LETTERS = byte_set((0x41, 0x5A), (0x61, 0x7A))
LETTERS_DIGITS = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))


def term_codes(column, member: np.ndarray):
    """(code of each term, row of each term, distinct terms) of a string column, in text order; null has no terms."""
    data, offsets = T.utf8(column)
    n = len(data)
    data = T.lower_ascii(data)
    inside = np.concatenate((member[data], [False]))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True                                   # a term never goes on into the next text
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    sizes = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(sizes), pa.py_buffer(data[inside[:n]].tobytes()))
    coded = words.dictionary_encode()
    row = np.searchsorted(offsets, starts, "right") - 1
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), row, coded.dictionary


def counted(row: np.ndarray, code: np.ndarray, n_codes: int):
    """(row, code, occurrences) of the distinct pairs, by row and code."""
    pair, times = np.unique(row * max(1, n_codes) + code, return_counts=True)
    return pair // max(1, n_codes), pair % max(1, n_codes), times
