"""Ranked lexical search by range-maximum queries over posting lists.

Score. Terms are runs of letters and digits, only A-Z lower-cased. N counts
the documents with a term, L all their terms, n one document's terms, df a
term's documents, tf its occurrences in a document. A term weighs
w = floor(1000 ln((2N + 2) / (2 df + 1))), a document's length factor is
m = 25 + (75 n N) div L, and a term's impact on a document is
w ((10^9 tf) div (1000 tf + 8 m)). A document's score for an item is the sum
of the impacts of the item's terms, repeats included: whole numbers throughout.

Search. Documents are numbered by id within blocks of ``BLOCK_DOCS``. Each
posting list of a block (a term's documents and impacts) has a sparse table of
range-maximum queries over its impacts. A search starts with the block as one
interval of documents. An interval's bound is the sum, over the item's terms,
of the greatest impact within it, one table lookup a term. The interval of the
greatest bound is opened next: the document of its greatest single impact is
scored and the documents before and after it become two intervals, which keep
only the terms that still occur in them. An interval goes when its bound does
not reach the item's k-th best score so far (at an equal bound, when its first
document comes after that of the k-th best). The search ends without intervals,
so results are exact. All items are searched together, the ``FIRST`` to
``MOST`` best intervals of each item a round; a task carries each item's best
documents from block to block and returns k of them.

Spark. Items are taken in blocks of ``ITEM_BYTES`` of text (one block for
benchmarks up to that size). Each block's terms are broadcast; one pass over
the documents writes, for each, n and the occurrences of these terms, from
which N, L and df come; the search reads that table. Its tasks return k rows
an item, and a window limit merges them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..util import bounded_broadcast, materialize
from . import textops as T
from .ordering import LIST_BYTES, global_running_total
from .terms import LETTERS_DIGITS, counted, term_codes

ITEM_BYTES = 8 << 20         # of the texts of a block of items; an item is never split
BLOCK_DOCS = 8192
BLOCK_POSTINGS = 1 << 20
ITEM_TERMS = 1 << 14         # terms of the items searched together
FIRST, MOST = 4, 64
NO_ID = np.iinfo(np.int64).max   # a null id in the search: last among equal scores


# ---------------------------------------------------------------- postings

def _item_terms(batches):
    for b in batches:
        for lo, hi in T.slices(b.column(1), T.BATCH_BYTES):
            part = b.slice(lo, hi - lo)
            code, row, terms = term_codes(part.column(1), LETTERS_DIGITS)
            row, code, times = counted(row, code, len(terms))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(row)), terms.take(pa.array(code)).cast(pa.string()), pa.array(times, pa.int64())],
                names=["item_id", "term", "r"])


def _postings(vocabulary, batches):
    """doc_id, text to doc_id, n, and the vocabulary's terms in the text with their occurrences."""
    known = vocabulary.value
    for b in batches:
        for lo, hi in T.slices(b.column(1), T.BATCH_BYTES):
            part = b.slice(lo, hi - lo)
            code, row, terms = term_codes(part.column(1), LETTERS_DIGITS)
            n = np.bincount(row, minlength=hi - lo)
            at = pc.index_in(terms, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)[code]
            row, term, times = counted(row[at >= 0], at[at >= 0], len(known))
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=hi - lo)))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))], names=["doc_id", "n", "terms", "tf"])


def _holders(n_terms, batches):
    """(term, df) of a task's documents."""
    df = np.zeros(n_terms, np.int64)
    for b in batches:
        df += np.bincount(b.column(0).flatten().to_numpy(), minlength=n_terms)
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(df[held])], names=["term", "df"])


# ---------------------------------------------------------------- a block's lists

class Block:
    """Posting lists of a block of documents, in order of (term, document), and their range-maximum tables."""

    def __init__(self, ids, n, doc, term, tf, weight, n_docs, n_terms):
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.size = ids[order], len(ids)
        m = 25 + (75 * n * n_docs) // max(1, n_terms)
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        some = impact > 0
        key = term[some] * self.size + place[doc[some]]
        by = np.argsort(key)
        self.key, self.impact = key[by], impact[some][by]
        self.doc = self.key % max(1, self.size)
        lists = self.key // max(1, self.size)
        self.start = np.searchsorted(lists, np.arange(len(weight) + 1))
        longest = int(np.diff(self.start).max(initial=0))
        # best[l][i]: place of the greatest impact among i .. i + 2^l - 1 (the first of equal ones)
        self.best = [np.arange(len(self.key), dtype=np.int32)]
        while (2 << (len(self.best) - 1)) <= longest:
            last, step = self.best[-1], 1 << (len(self.best) - 1)
            a, b = last[:-step], last[step:]
            self.best.append(np.concatenate((np.where(self.impact[b] > self.impact[a], b, a), last[-step:])))
        self.best = np.stack(self.best)

    def greatest(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Places of the greatest impacts in the ranges s .. e - 1 of single lists, none of them empty."""
        level = np.frexp((e - s).astype(np.float64))[1] - 1
        a, b = self.best[level, s], self.best[level, e - (1 << level)]
        return np.where(self.impact[b] > self.impact[a], b, a)


def _ragged(off: np.ndarray, cnt: np.ndarray) -> np.ndarray:
    """The places off .. off + cnt - 1 of each range, one after another."""
    return np.repeat(off - np.concatenate(([0], np.cumsum(cnt)[:-1])), cnt) + np.arange(cnt.sum())


class Frontier:
    """Intervals of documents still open: item, lo, hi, bound, split, and the list ranges (r, s, e) of their terms."""

    def __init__(self, block: Block, item, lo, hi, cnt, r, s, e):
        some = e > s
        owner = np.repeat(np.arange(len(item)), cnt)[some]
        cnt = np.bincount(owner, minlength=len(item))
        self.r, self.s, self.e = r[some], s[some], e[some]
        have = cnt > 0
        self.item, self.lo, self.hi, self.cnt = item[have], lo[have], hi[have], cnt[have]
        self.off = np.cumsum(self.cnt) - self.cnt
        self.bound = self.split = np.zeros(0, np.int64)
        if len(self.item):
            top = block.greatest(self.s, self.e)
            gain = self.r * block.impact[top]
            self.bound = np.add.reduceat(gain, self.off)
            most = np.repeat(np.maximum.reduceat(gain, self.off), self.cnt) == gain
            place = np.where(most, np.arange(len(gain)), len(gain))
            self.split = block.doc[top[np.minimum.reduceat(place, self.off)]]

    def take(self, which: np.ndarray) -> "Frontier":
        out = object.__new__(Frontier)
        flat = _ragged(self.off[which], self.cnt[which])
        out.r, out.s, out.e = self.r[flat], self.s[flat], self.e[flat]
        for name in ("item", "lo", "hi", "cnt", "bound", "split"):
            setattr(out, name, getattr(self, name)[which])
        out.off = np.cumsum(out.cnt) - out.cnt
        return out

    def extended(self, other: "Frontier") -> "Frontier":
        out = object.__new__(Frontier)
        for name in ("item", "lo", "hi", "cnt", "bound", "split", "r", "s", "e"):
            setattr(out, name, np.concatenate((getattr(self, name), getattr(other, name))))
        out.off = np.cumsum(out.cnt) - out.cnt
        return out


class Best:
    """The k best (score, id) of each item so far; an id of ``NO_ID`` with score 0 fills free places."""

    def __init__(self, n_items: int, k: int):
        self.score = np.zeros((n_items, k), np.int64)
        self.id = np.full((n_items, k), NO_ID, np.int64)
        self.k = k

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        items = np.unique(item)
        who = np.concatenate((np.repeat(items, self.k), item))
        score = np.concatenate((self.score[items].ravel(), score))
        ids = np.concatenate((self.id[items].ravel(), ids))
        by = np.lexsort((ids, -score, who))
        first = np.searchsorted(who[by], items)
        chosen = by[first[:, None] + np.arange(self.k)]
        self.score[items], self.id[items] = score[chosen], ids[chosen]

    def open(self, front: Frontier, ids: np.ndarray) -> np.ndarray:
        """Which intervals can still change the result."""
        least, last = self.score[front.item, -1], self.id[front.item, -1]
        return (front.bound > least) | ((front.bound == least) & (ids[front.lo] < last))


def search_block(block: Block, items: list[tuple[np.ndarray, np.ndarray]], best: Best, first_item: int = 0) -> int:
    """Best-first search of the block for ``items``, pairs (terms, repeats); returns the documents scored."""
    if not block.size or not len(block.key):
        return 0
    cnt = np.array([len(t) for t, _ in items])
    term = np.concatenate([t for t, _ in items])
    r = np.concatenate([r for _, r in items])
    n = len(items)
    front = Frontier(block, first_item + np.arange(n), np.zeros(n, np.int64), np.full(n, block.size), cnt, r,
                     block.start[term], block.start[term + 1])
    at_once, scored = FIRST, 0
    while True:
        front = front.take(np.flatnonzero(best.open(front, block.ids)))
        if not len(front.item):
            return scored
        by = np.lexsort((front.lo, -front.bound, front.item))
        items_by = front.item[by]
        nth = np.arange(len(by)) - np.searchsorted(items_by, items_by)
        now = front.take(by[nth < at_once])
        front = front.take(by[nth >= at_once])
        split = np.repeat(now.split, now.cnt)
        at = np.searchsorted(block.key, block.key[now.s] - block.doc[now.s] + split)
        there = (at < now.e) & (block.doc[np.minimum(at, len(block.doc) - 1)] == split)
        gain = np.where(there, now.r * block.impact[np.minimum(at, len(block.impact) - 1)], 0)
        best.add(now.item, np.add.reduceat(gain, now.off), block.ids[now.split])
        scored += len(now.item)
        for lo, hi, s, e in ((now.lo, now.split, now.s, at), (now.split + 1, now.hi, at + there, now.e)):
            part = Frontier(block, now.item, lo, hi, now.cnt, now.r, s, e)
            front = front.extended(part.take(np.flatnonzero(best.open(part, block.ids))))
        at_once = min(MOST, at_once * 2)


def _groups(items):
    """Runs of items of at most ``ITEM_TERMS`` terms (one item at least)."""
    start = size = 0
    for i, (t, _) in enumerate(items):
        if i > start and size + len(t) > ITEM_TERMS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(items):
        yield start, len(items)


def _search(shared, k, batches):
    """doc_id, n, terms, tf of a task's documents to its k best of each item."""
    weight, items, keys, n_docs, n_terms = shared.value
    best = Best(len(items), k)
    held, docs, postings = [], 0, 0

    def flush():
        table = pa.Table.from_batches(held)
        lens = pc.list_value_length(table.column("terms")).to_numpy()
        ids = table.column("doc_id").fill_null(NO_ID).to_numpy()
        flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy().astype(np.int64)
        block = Block(ids, table.column("n").to_numpy(), np.repeat(np.arange(len(ids)), lens), flat("terms"), flat("tf"),
                      weight, n_docs, n_terms)
        for a, b in _groups(items):
            search_block(block, items[a:b], best, a)

    for b in batches:
        lens = np.cumsum(pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            done = lens[at - 1] if at else 0
            end = min(at + BLOCK_DOCS - docs, int(np.searchsorted(lens, done + BLOCK_POSTINGS - postings, "right")), b.num_rows)
            end = max(end, at + 1)
            held.append(b.slice(at, end - at))
            docs, postings, at = docs + end - at, postings + int(lens[end - 1] - done), end
            if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                flush()
                held, docs, postings = [], 0, 0
    if held:
        flush()
    item, place = np.nonzero(best.score)
    ids = best.id[item, place]
    yield pa.RecordBatch.from_arrays(
        [keys.take(pa.array(item)), pa.array(ids, mask=ids == NO_ID), pa.array(best.score[item, place])],
        names=["item_id", "doc_id", "score"])


# ---------------------------------------------------------------- the jobs

def _item_block(terms: pa.Table):
    """(vocabulary, items, item ids): terms as places in the vocabulary, with their repeats, by item."""
    coded = terms.column("term").combine_chunks().dictionary_encode()
    ids, at = terms.column("item_id").combine_chunks(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    r = terms.column("r").to_numpy()
    places = {}
    for i, key in enumerate(ids.to_pylist()):
        places.setdefault(key, []).append(i)
    items = [(at[p], r[p]) for p in map(np.array, places.values())]
    return coded.dictionary, items, pa.array(list(places), pa.int64())


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                   item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents with a score above 0.

    Equal scores go by ascending doc_id, null ids last; every row of ``docs``
    is a document, so a repeated row takes a rank of its own. Rows of
    ``items`` with one item_id are one item with the terms of all their
    distinct texts; a null item_id is an item as well. A null text has no
    terms. Ids that are no long are null. Empty tables give no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    T.bound_batches(spark)
    read = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_id).try_cast("long").alias("item_id"),
                         F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")).distinct()
    terms = (asked.mapInArrow(_item_terms, "item_id long, term string, r long")
             .groupBy("item_id", "term").agg(F.sum("r").alias("r")))
    terms = materialize(terms, "items")
    size = terms.groupBy("item_id").agg(F.sum(F.octet_length("term") + 16).alias("bytes"))
    size = global_running_total(size, ["item_id"], F.col("bytes"), "before")
    size = size.select(F.col("item_id").alias("_item"), F.floor(F.col("before") / ITEM_BYTES).cast("long").alias("block"))
    terms = materialize(terms.join(bounded_broadcast(size, LIST_BYTES), terms["item_id"].eqNullSafe(size["_item"]))
                        .drop("_item"), "items")
    last = terms.agg(F.max("block")).first()[0]
    found = []
    for number in range(0 if last is None else last + 1):
        block = terms.where(F.col("block") == number).select("item_id", "term", "r").orderBy("item_id", "term").toArrow()
        if block.num_rows:
            found.append(_rank_block(read, block, k))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _rank_block(read: DataFrame, block: pa.Table, k: int) -> DataFrame:
    """Each task's k best documents for a block of items."""
    context = read.sparkSession.sparkContext
    words, items, keys = _item_block(block)
    vocabulary = context.broadcast(words)
    postings = materialize(read.mapInArrow(lambda it: _postings(vocabulary, it),
                                           "doc_id long, n long, terms array<int>, tf array<long>"), "postings")
    vocabulary.destroy()
    n_docs, n_terms = postings.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_words = len(words)
    held = (postings.select("terms").mapInArrow(lambda it: _holders(n_words, it), "term int, df long")
            .groupBy("term").agg(F.sum("df").alias("df"))).toArrow()      # a row a word of the vocabulary at most
    df = np.zeros(n_words, np.int64)
    df[held.column("term").to_numpy()] = held.column("df").to_numpy()
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    shared = context.broadcast((weight, items, keys, n_docs, n_terms))
    best = postings.where(F.size("terms") > 0).mapInArrow(lambda it: _search(shared, k, it),
                                                          "item_id long, doc_id long, score long")
    best = materialize(best, "best")
    shared.destroy()
    return best
