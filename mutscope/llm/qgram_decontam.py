"""Benchmark decontamination by the q-gram lemma.

Texts are folded to lower-case letters and digits with single spaces between
words. A document leaks an item if it holds one of these passages of it:

* ``WINDOW`` folded characters in a row (a shorter item: all of it), from any
  character on, with at most ``EDITS`` of ``WINDOW`` characters inserted,
  deleted or replaced;
* ``WORDS`` whole words in a row, unchanged: the shortest passage that is
  found wherever it begins;
* an item of fewer than ``MIN_CHARS`` characters: all of its words, unchanged.

If a window of m characters occurs with k edits, the occurrence shares at
least ``m + 1 - Q * (k + 1)`` q-grams with it, on diagonals at most k apart.
So, for a slice of documents at a time:

1. q-gram codes of all positions are looked up in a bit table of the
   benchmark's codes; stretches with too few hits for any passage go;
2. hits that follow each other on one diagonal are runs of unchanged text,
   which give the whole words and the windows without an edit;
3. the other hits are counted in diagonal bands of width 2k, overlapping by k,
   for every place of the window in the item; where the bound is met, a banded
   alignment, free at both ends of the region, decides.

The benchmark goes to the tasks in blocks of ``BLOCK_CHARS`` characters, so
what is broadcast is bounded whatever its size; each block is one pass over
the documents, which are neither shuffled nor joined.

Defined results: null, empty or blank texts leak nothing; repeated rows are
judged one by one; an item leaked several times is one row spanning them; an
item without id (or whose id is no long) has a row of its own with a null
item_id; empty tables give no leaks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

Q = 8
WINDOW = 80
STRIDE = 1                    # windows begin at every folded character
WORDS = 13
EDITS = 6
MIN_CHARS = 24
BLOCK_CHARS = 1 << 19
BITS = 21

_GAP = 2 * EDITS + 4          # characters between documents, more than any edit budget
_SEPARATOR = 1
_MULT = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """Lower-case letter or digit, or space, for each code point below 65,536."""
    table = np.full(65536, 32, np.uint32)
    for i in range(65536):
        low = chr(i).lower()
        if len(low) == 1 and low.isalnum():
            table[i] = ord(low)
    return table


def folded(texts: list[str]):
    """(characters, source): texts folded one after another, with a gap after each.

    ``source`` gives each folded character's place in the texts joined with
    gaps.
    """
    gap = " " * _GAP
    raw = np.frombuffer((gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _fold_table()
    c = np.where(raw < 65536, table[np.minimum(raw, 65535)], raw)
    ends = np.cumsum([len(t) + _GAP for t in texts])
    gaps = (ends[:, None] - np.arange(1, _GAP + 1)).ravel()
    c[gaps] = _SEPARATOR
    space = c == 32
    keep = np.ones(len(c), bool)
    keep[1:] = ~(space[1:] & (space[:-1] | (c[:-1] == _SEPARATOR)))
    source = np.flatnonzero(keep)
    return c[source], source


def fold(text: str) -> np.ndarray:
    c, _ = folded([text])
    c = c[c != _SEPARATOR]
    return c[int(len(c) > 0 and c[0] == 32):len(c) - int(len(c) > 1 and c[-1] == 32)]


def codes(c: np.ndarray) -> np.ndarray:
    """Code of the q-gram at each position (of the last ones: none)."""
    n = len(c) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h, width, mult = c.astype(np.uint64), 1, _MULT
        while width < Q:
            h = h[:-width] * mult + h[width:]
            mult = mult * mult
            width *= 2
        return h * _MULT


def edit_budget(m: int) -> int:
    return m * EDITS // WINDOW


def _prefix_codes(chars: np.ndarray, n: int) -> np.ndarray:
    """Code of the first ``n`` characters of each row."""
    code = np.zeros(len(chars), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            code = (code + chars[:, j].astype(np.uint64)) * _MULT
    return code


def _between(c: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether no letter or digit of ``c`` is at these places (beyond its ends, none is)."""
    x = c[np.clip(at, 0, len(c) - 1)]
    return (at < 0) | (at >= len(c)) | (x == 32) | (x == _SEPARATOR)


def _spans(lo: np.ndarray, hi: np.ndarray):
    """(index, value) of every whole number in each of the ranges [lo, hi)."""
    n = np.maximum(hi - lo, 0)
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + lo[i]


class Windows:
    """The search structures of one block of benchmark items.

    The items' folded characters stand one after another in ``text``; a window
    is named by its place there.
    """

    def __init__(self, items: list[tuple]):
        self.item = [i for i, _ in items]
        chars, short, words, at = [np.zeros(0, np.uint32)], {}, [], 0
        first, size = [], []
        for i, (_, text) in enumerate(items):
            c = fold(text or "")
            first.append(at)
            size.append(len(c) if len(c) >= MIN_CHARS else 0)
            if 0 < len(c) < MIN_CHARS:
                short.setdefault(len(c), []).append((c, i))
            if len(c) < MIN_CHARS:
                continue
            chars += [c, np.full(_GAP, _SEPARATOR, np.uint32)]
            space = np.flatnonzero(c == 32)
            begin, end = np.concatenate(([0], space + 1)), np.append(space, len(c))
            words.append(np.stack((begin[:len(begin) - WORDS + 1], end[WORDS - 1:])) + at if len(begin) >= WORDS
                         else np.zeros((2, 0), np.int64))
            at += len(c) + _GAP
        self.first, self.size = np.array(first, np.int64), np.array(size, np.int64)
        self.length = np.minimum(self.size, WINDOW)
        self.budget = self.length * EDITS // WINDOW
        self.bound = self.length + 1 - Q * (self.budget + 1)
        self.text = np.concatenate(chars)
        # (first, end) of each passage of WORDS words, both in increasing order
        self.words = np.concatenate(words, axis=1) if words else np.zeros((2, 0), np.int64)
        self.long = np.flatnonzero(self.size)            # items searched by q-grams
        here = np.zeros(len(self.text), bool)
        for f, n in zip(self.first[self.long], self.size[self.long]):
            here[f:f + n - Q + 1] = True
        place = np.flatnonzero(here)
        grams = codes(self.text)[place] if len(place) else np.zeros(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        self.place = place[order]
        self.grams, self.at, self.times = np.unique(grams[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << BITS, bool)
        self.table[self.grams >> np.uint64(64 - BITS)] = True
        if len(self.long):
            runs = self.words[1] - self.words[0] - Q + 1
            self.least = int(min(self.bound[self.long].min(), runs.min(initial=1 << 30)))
            self.span = int(max((self.length + self.budget).max(), (self.words[1] - self.words[0]).max(initial=0)))
        self.short = {}                                  # by length: sorted codes, and their items
        for n, x in short.items():
            code = _prefix_codes(np.array([c for c, _ in x]), n)
            order = np.argsort(code, kind="stable")
            self.short[n] = code[order], np.array([i for _, i in x])[order]

    def owner(self, place: np.ndarray) -> np.ndarray:
        """The item of each place in ``text``."""
        return self.long[np.searchsorted(self.first[self.long], place, "right") - 1]

    def hits(self, c: np.ndarray):
        """(position in ``c``, place in ``text``) of shared q-grams, where there are enough of them."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.long):
            return none
        h = codes(c)
        hit = self.table[h >> np.uint64(64 - BITS)]
        span, n = self.span, len(h)
        if n > span:
            total = np.concatenate(([0], np.cumsum(hit, dtype=np.int32)))
            dense = total[span:] - total[:n + 1 - span] >= self.least
            # a position stays if one of the dense stretches of ``span`` positions holds it
            before = np.zeros(n + span, np.int32)
            np.cumsum(dense, out=before[span:n + 1])
            if not before[n]:
                return none
            before[n + 1:] = before[n]
            hit &= before[span:] > before[:n]
        at = np.flatnonzero(hit)
        if not len(at):
            return none
        k = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        real = self.grams[k] == h[at]
        at, k = at[real], k[real]
        i, row = _spans(self.at[k], self.at[k] + self.times[k])
        return at[i], self.place[row]

    def runs(self, pos: np.ndarray, place: np.ndarray):
        """(diagonal, first place, end) of the stretches of unchanged text."""
        diagonal = pos - place
        order = np.lexsort((place, diagonal))
        d, p = diagonal[order], place[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)
        start = np.flatnonzero(new)
        last = np.append(start[1:], len(d)) - 1
        return d[start], p[start], p[last] + Q

    def _bands(self, item: np.ndarray, diagonal: np.ndarray, place: np.ndarray) -> np.ndarray:
        """A key (band, place) for both bands of each diagonal."""
        band = (diagonal + len(self.text)) // np.maximum(self.budget[item], 1)
        return np.concatenate(((band + 1) << 32 | place, band << 32 | place))

    def candidates(self, pos: np.ndarray, place: np.ndarray, same: np.ndarray):
        """(window, first diagonal) where a band meets the window's bound; ``same``: bands known already."""
        hits = key = np.sort(self._bands(self.owner(place), pos - place, place))
        p = key & 0xFFFFFFFF
        item = self.owner(p)
        reach, bound = self.length[item] - Q, self.bound[item]
        nth = np.arange(len(key)) + bound - 1
        ok = (nth < len(key)) & (key[np.minimum(nth, len(key) - 1)] <= key + reach)
        key, p, item, nth = key[ok], p[ok], item[ok], nth[ok]
        if not len(key):
            return key, key
        # windows whose first hit can be this one: they hold the hit ``bound`` on as well
        low = np.maximum(hits[nth] - (self.length[item] - Q), (key - p) + self.first[item])
        high = np.minimum(key, (key - p) + self.first[item] + self.size[item] - self.length[item])
        low[1:] = np.maximum(low[1:], high[:-1] + 1)
        _, at = _spans(low, high + 1)
        at = np.setdiff1d(at, same)
        window = at & 0xFFFFFFFF
        step = np.maximum(self.budget[self.owner(window)], 1)
        return window, ((at >> 32) - 1) * step - len(self.text) + window

    def verify(self, c: np.ndarray, window: np.ndarray, diagonal: np.ndarray):
        """(edits, end): best alignment of each window in its band, and where it ends in ``c``."""
        k = EDITS
        width = 2 * max(k, 1) + 2 * k + 1
        low = diagonal - k
        n = len(window)
        length = self.length[self.owner(window)]
        d = np.zeros((n, width), np.int32)
        step = np.arange(width, dtype=np.int32)
        best = np.full(n, 1 << 20, np.int32)
        end = np.zeros(n, np.int64)
        for i in range(1, int(length.max()) + 1):
            at = low[:, None] + (i - 1) + step
            inside = (at >= 0) & (at < len(c))
            text = np.where(inside, c[np.clip(at, 0, len(c) - 1)], np.uint32(_SEPARATOR))
            mine = self.text[np.minimum(window + i - 1, len(self.text) - 1)]
            x = d + (text != mine[:, None])
            x[:, :-1] = np.minimum(x[:, :-1], d[:, 1:] + 1)
            x = np.minimum.accumulate(x - step, axis=1) + step
            d = x.astype(np.int32)
            done = length == i
            if done.any():
                j = d[done].argmin(axis=1)
                best[done] = d[done][np.arange(len(j)), j]
                end[done] = low[done] + i + j
        return best, end

    def _long_leaks(self, c: np.ndarray):
        """Lists of (passage, item, first, end, edits) arrays; first and end are places in ``c``."""
        pos, place = self.hits(c)
        if not len(pos):
            return
        diagonal, p, q = self.runs(pos, place)
        item = self.owner(p)
        run, at = _spans(p, q - self.length[item] + 1)
        known = np.zeros(0, np.int64)
        if len(at):
            first = diagonal[run] + at
            yield at, item[run], first, first + self.length[item[run]], np.zeros(len(at), np.int64)
            known = self._bands(item[run], diagonal[run], at)
        begin, end = self.words
        run, w = _spans(np.searchsorted(begin, p), np.searchsorted(end, q, "right"))
        first, last = diagonal[run] + begin[w], diagonal[run] + end[w]
        ok = _between(c, first - 1) & _between(c, last)
        yield -1 - w[ok], item[run[ok]], first[ok], last[ok], np.zeros(ok.sum(), np.int64)
        window, start = self.candidates(pos, place, known)
        for lo in range(0, len(window), 4096):
            w = window[lo:lo + 4096]
            edits, end = self.verify(c, w, start[lo:lo + 4096])
            own = self.owner(w)
            ok = edits <= self.budget[own]
            yield w[ok], own[ok], (end - self.length[own])[ok], end[ok], edits[ok]

    def _short_leaks(self, c: np.ndarray):
        """The same of the items of fewer than MIN_CHARS characters, found as whole words."""
        word = (c != 32) & (c != _SEPARATOR)
        begin = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
        code = np.zeros(len(begin), np.uint64)
        for n in range(1, max(self.short) + 1):
            begin, code = begin[begin + n <= len(c)], code[begin + n <= len(c)]
            with np.errstate(over="ignore"):
                code = (code + c[begin + n - 1].astype(np.uint64)) * _MULT
            if n not in self.short or not len(begin):
                continue
            grams, owner = self.short[n]
            at, row = _spans(np.searchsorted(grams, code), np.searchsorted(grams, code, "right"))
            ok = _between(c, begin[at] + n)
            first, item = begin[at[ok]], owner[row[ok]]
            yield len(self.text) + item, item, first, first + n, np.zeros(len(item), np.int64)

    def leaks(self, texts: list[str]):
        """(document, passage, item, start, end, edits) arrays; document and item are indexes."""
        c, source = folded(texts)
        found = list(self._long_leaks(c))
        if self.short:
            found += self._short_leaks(c)
        if not sum(len(f[0]) for f in found):
            return None
        passage, item, first, end, edits = (np.concatenate(x) for x in zip(*found))
        starts = np.concatenate(([0], np.cumsum([len(t) + _GAP for t in texts])))
        last = source[np.minimum(end, len(source)) - 1]
        doc = np.searchsorted(starts, last, "right") - 1
        size = np.array([len(t) for t in texts])
        first = source[np.clip(first, 0, len(source) - 1)]
        return (doc, passage, item, np.clip(first - starts[doc], 0, size[doc]),
                np.clip(last + 1 - starts[doc], 0, size[doc]), edits)


LEAK = "item_id long, start long, end long, edits int, windows int"


def _texts(column) -> list[str]:
    return T.null_free(column.cast(pa.string()), "").to_pylist()


def _leak_batches(search, batches):
    windows = search.value
    for b in batches:
        ids, col = b.column(0), b.column(1)
        for lo, hi in T.slices(col):
            found = windows.leaks(_texts(col.slice(lo, hi - lo)))
            if found is None:
                continue
            rows: dict[tuple, list] = {}
            for doc, w, i, start, end, edits in zip(*(x.tolist() for x in found)):
                name = windows.item[i]
                r = rows.setdefault((doc, name is None, i if name is None else name), [start, end, edits, set()])
                r[:3] = min(r[0], start), max(r[1], end), min(r[2], edits)
                r[3].add(w)
            keys = sorted(rows)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo).take(pa.array([k[0] for k in keys], pa.int64())),
                 pa.array([None if k[1] else k[2] for k in keys], pa.int64()), pa.array([rows[k][0] for k in keys], pa.int64()),
                 pa.array([rows[k][1] for k in keys], pa.int64()), pa.array([rows[k][2] for k in keys], pa.int32()),
                 pa.array([len(rows[k][3]) for k in keys], pa.int32())],
                names=["id", "item_id", "start", "end", "edits", "windows"])


def _clean_batches(search, place, batches):
    windows = search.value
    for b in batches:
        col = b.column(place)
        for lo, hi in T.slices(col):
            found = windows.leaks(_texts(col.slice(lo, hi - lo)))
            part = b.slice(lo, hi - lo)
            if found is not None:
                keep = np.ones(hi - lo, bool)
                keep[found[0]] = False
                part = part.filter(pa.array(keep))
            yield part


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """The benchmark as broadcast search structures, one for each block."""
    items = benchmark.select(F.col(item_col).try_cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    items = items.where("text is not null")
    T.bound_batches(benchmark.sparkSession)
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = chars // BLOCK_CHARS + 1
    spark = benchmark.sparkSession
    for i in range(n):
        # the texts of one id are searched together, so that a document and an id give one row
        at = F.coalesce(F.xxhash64("item", F.when(F.col("item").isNull(), F.col("text"))), F.lit(0))
        block = items.where(F.pmod(at, F.lit(n)) == i).orderBy("item", "text")
        yield spark.sparkContext.broadcast(Windows([(r["item"], r["text"]) for r in block.collect()]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item that it leaks.

    doc id, item_id, start and end (code points of the text, end exclusive;
    from the first to the last leaked passage), the fewest edits of a passage,
    and the number of passages (places in the item) that were found.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    out = None
    for search in _blocks(benchmark, item_col, item_text_col):
        part = narrow.mapInArrow(lambda batches, s=search: _leak_batches(s, batches), f"id {kind}, {LEAK}")
        out = part if out is None else out.union(part)
    return out.withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that leak no benchmark item."""
    place = docs.columns.index(text_col)
    out = docs
    for search in _blocks(benchmark, item_col, item_text_col):
        out = out.mapInArrow(lambda batches, s=search: _clean_batches(s, place, batches), docs.schema)
    return out
