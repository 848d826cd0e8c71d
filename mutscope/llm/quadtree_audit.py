"""Divergence of sources within a language, over quadtrees of the group-term count matrix.

Terms and shares. A term is a run of letters, only A-Z lower-cased. A language
keeps the V terms that at least ``min_docs`` of its documents hold. A group
(language, source), and the language as a whole, gives every kept term the
share p = 1 + floor(10^9 (count + 5) / (N + 5 V)), N the sum of its counts of
kept terms. Everything is whole-number arithmetic.

Matrix. Within a language, rows are its sources in order, columns its kept
terms, ordered by how many sources hold them and which is the first, so that
terms of the same few sources stand side by side and the rest of their columns
is zero. The matrix is cut into tiles of ``ROWS`` x ``COLS`` cells. Tiles
without a count are never made.

Quadtree. A tile is a K²-tree (K = 2): level bitmaps tell which quadrants hold
a count, down to leaves of one row and ``LEAF`` columns. A pair of tiles (rows
of two blocks, the same columns) is traversed jointly from both roots. Where
both quadrants are zero, every cell of row a has the share of count 0, p0(a),
so the quadrant costs (its columns) x |p0(a) - p0(b)| for each pair of its
rows, priced by counting columns, without visiting cells. Other quadrants are
opened; at the leaves the rows' shares are compared cell by cell. Columns
outside of all tiles are priced at once.

Sizes. A task holds two tiles and their pairs of rows. A cell is copied once
for each block of ``ROWS`` sources of its language, which the result, a row
for each ordered pair of sources, outgrows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..util import bounded_broadcast, materialize
from . import textops as T
from .ordering import LIST_BYTES, global_rank
from .terms import LETTERS, counted, term_codes

ROWS = 128
LEAF = 32
DEPTH = 7                     # levels below the root: 2**DEPTH rows, 2**DEPTH leaves a row
COLS = LEAF << DEPTH
LEAF_PAIRS = 1 << 14          # compared at a time: 4 MB a side
SCALE = 1_000_000_000
PRIOR = 5

_TILE = "lang string, i int, j int, cb int, width long, row long, col long, p long"


def _count_batches(batches):
    """(lang, source, term, n, d) of text, lang, source: occurrences and documents, summed within a batch."""
    for b in batches:
        for lo, hi in T.slices(b.column(0), T.BATCH_BYTES):
            part = b.slice(lo, hi - lo)
            code, row, terms = term_codes(part.column(0), LETTERS)
            row, code, times = counted(row, code, len(terms))
            lang, source = (part.column(i).dictionary_encode() for i in (1, 2))
            n_source = max(1, len(source.dictionary))
            group = (lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n_source
                     + source.indices.to_numpy(zero_copy_only=False))
            cell, at = np.unique(group[row] * max(1, len(terms)) + code, return_inverse=True)
            n = np.zeros(len(cell), np.int64)
            np.add.at(n, at, times)
            g, c = cell // max(1, len(terms)), cell % max(1, len(terms))
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(g // n_source)), source.dictionary.take(pa.array(g % n_source)),
                 terms.take(pa.array(c)).cast(pa.string()), pa.array(n, pa.int64()),
                 pa.array(np.bincount(at, minlength=len(cell)), pa.int64())],
                names=["lang", "source", "term", "n", "d"])


class Tile:
    """Counted cells of up to ``ROWS`` rows and ``width`` columns as a K²-tree with dense leaves.

    ``row`` and ``col`` are places within the tile, ``p`` shares, ``p0`` each row's share of a zero count.
    """

    def __init__(self, row: np.ndarray, col: np.ndarray, p: np.ndarray, p0: np.ndarray):
        side = 1 << DEPTH
        leaf = row * side + col // LEAF
        used, at = np.unique(leaf, return_inverse=True)
        # rows of ``leaves``: the leaves with a count, then a uniform leaf for each row
        self.leaves = np.repeat(np.concatenate((p0[used // side], p0)), LEAF).reshape(-1, LEAF)
        self.leaves[at, col % LEAF] = p
        self.where = np.repeat(len(used) + np.arange(side), side).reshape(side, side)
        self.where.ravel()[used] = np.arange(len(used))
        bits = np.zeros((side, side), bool)
        bits.ravel()[used] = True
        self.levels = [bits]
        while len(bits) > 1:
            bits = bits[0::2] | bits[1::2]
            bits = bits[:, 0::2] | bits[:, 1::2]
            self.levels.insert(0, bits)
        self.p0 = p0


def joint_price(a: Tile, b: Tile, width: int, same: bool = False) -> np.ndarray:
    """(rows of a, rows of b) sums of |p - q| over the first ``width`` columns; with ``same`` only for row a <= row b."""
    n_a, n_b = len(a.p0), len(b.p0)
    side = 1 << DEPTH
    zero = np.zeros((side, side), np.int64)        # columns priced analytically, of each pair of rows
    opened = np.zeros((side, side), np.int64)
    ra = rb = c = np.zeros(1, np.int64)
    for level in range(DEPTH + 1):
        size = side >> level                       # rows, and leaves, of a quadrant here
        inside = (ra * size < n_a) & (rb * size < n_b) & (c * size * LEAF < width)
        if same:
            inside &= ra <= rb
        ra, rb, c = ra[inside], rb[inside], c[inside]
        full = a.levels[level][ra, c] | b.levels[level][rb, c]
        cols = np.minimum(width, (c + 1) * size * LEAF) - c * size * LEAF
        priced = np.bincount((ra * (1 << level) + rb)[~full], cols[~full], (1 << level) ** 2).astype(np.int64)
        zero += np.kron(priced.reshape(1 << level, -1), np.ones((size, size), np.int64))
        ra, rb, c = ra[full], rb[full], c[full]
        if level < DEPTH:
            step = np.arange(8)
            ra, rb, c = ((2 * x[:, None] + (step >> k & 1)).ravel() for x, k in ((ra, 0), (rb, 1), (c, 2)))
    for at in range(0, len(c), LEAF_PAIRS):
        x, y, k = (v[at:at + LEAF_PAIRS] for v in (ra, rb, c))
        apart = np.abs(a.leaves[a.where[x, k]] - b.leaves[b.where[y, k]]).sum(axis=1)
        # beyond ``width`` a leaf holds its row's p0
        apart -= np.maximum(0, (k + 1) * LEAF - width) * np.abs(a.p0[x] - b.p0[y])
        # at most COLS shares of 10^9 a pair: exact in the doubles of bincount
        opened += np.bincount(x * side + y, apart, side * side).astype(np.int64).reshape(side, side)
    return zero[:n_a, :n_b] * np.abs(a.p0[:, None] - b.p0[None, :]) + opened[:n_a, :n_b]


def _price_tiles(key, table):
    """One pair of row blocks over one block of columns: (lang, a, b, value) for rows a < b."""
    lang, i, j, _ = (k.as_py() for k in key)
    row, col, p = (table.column(c).to_numpy() for c in ("row", "col", "p"))
    width = pc.max(table.column("width")).as_py()
    tiles = []
    for block in (i, j):
        mine = row // ROWS == block
        head, cell = mine & (col < 0), mine & (col >= 0)
        p0 = p[head][np.argsort(row[head])]
        tiles.append(Tile(row[cell] % ROWS, col[cell] % COLS, p[cell], p0))
    value = joint_price(*tiles, width, same=i == j)
    a, b = np.triu_indices(len(value), 1) if i == j else (x.ravel() for x in np.indices(value.shape))
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a + i * ROWS, pa.int64()),
                     "b": pa.array(b + j * ROWS, pa.int64()), "value": pa.array(value[a, b], pa.int64())})


def _share(count: Column | str, total: str) -> Column:
    """1 + floor(SCALE (count + 5) / (N + 5 V)) of ``count``, N in ``total``, V in ``v``; decimals, so that nothing overflows."""
    d = lambda c: f"cast({c} as decimal(28, 0))"
    return F.expr(f"1 + case when v > 0 then ({SCALE} * ({d(count)} + {PRIOR})) div ({d(total)} + {PRIOR} * {d('v')}) end")


def count_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                min_docs: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, terms, cells) of the group-term count matrix; null text, language and source read ''.

    groups: lang, source, row, n_kept, v, p0. terms: lang, term, col, total,
    lang_kept. cells: lang, source, row, term, col, n, p, q (the language's share).
    """
    T.bound_batches(docs.sparkSession)
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
                         for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    found = (read.mapInArrow(_count_batches, "lang string, source string, term string, n long, d long")
             .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")))
    found = materialize(found, "cells", compression="zstd")
    kept = (found.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("d").alias("d"),
                                              F.count(F.lit(1)).alias("sources"), F.min("source").alias("first"))
            .where(F.col("d") >= min_docs).drop("d"))
    kept = global_rank(kept, ["lang", "sources", "first", "term"], "at")
    start = kept.groupBy("lang").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("v"),
                                     F.sum("total").alias("lang_kept"))
    kept = materialize(kept.join(bounded_broadcast(start, LIST_BYTES), "lang")
                       .select("lang", "term", (F.col("at") - F.col("start")).alias("col"), "total", "v", "lang_kept"), "kept")
    cells = found.drop("d").join(bounded_broadcast(kept, LIST_BYTES), ["lang", "term"])
    cells = materialize(cells, "counts")

    groups = global_rank(read.select("lang", "source").distinct(), ["lang", "source"], "at")
    first = groups.groupBy("lang").agg(F.min("at").alias("start"))
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("n_kept"))
    groups = (groups.join(bounded_broadcast(first, LIST_BYTES), "lang").join(bounded_broadcast(size, LIST_BYTES), "lang", "left")
              .join(sums, ["lang", "source"], "left")
              .select("lang", "source", (F.col("at") - F.col("start")).alias("row"),
                      F.coalesce("n_kept", F.lit(0)).alias("n_kept"), F.coalesce("v", F.lit(0)).alias("v")))
    groups = materialize(groups.withColumn("p0", _share(0, "n_kept")), "groups")
    cells = (cells.drop("v").join(bounded_broadcast(groups, LIST_BYTES), ["lang", "source"])
             .withColumn("p", _share("n", "n_kept")).withColumn("q", _share("total", "lang_kept")))
    return groups, kept, cells


def pair_divergence(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, a, b, value): rows a < b of each language and their sum of |p - q| over all its kept terms."""
    blocks = groups.groupBy("lang").agg(F.floor((F.max("row") + ROWS) / ROWS).cast("int").alias("blocks"),
                                        F.max("v").alias("v"))
    blocks = materialize(blocks, "blocks")
    placed = cells.select("lang", F.floor(F.col("row") / ROWS).cast("int").alias("block"),
                          F.floor(F.col("col") / COLS).cast("int").alias("cb"), "row", "col", "p")
    placed = placed.join(bounded_broadcast(blocks, LIST_BYTES), "lang")

    def with_other(df):
        df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return df.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    width = F.least(F.lit(COLS), F.col("v") - F.col("cb") * COLS).cast("long")
    made = with_other(placed.select("lang", "block", "cb", "blocks", "v").distinct())
    made = materialize(made.select("lang", "i", "j", "cb", width.alias("width")).distinct(), "tiles")
    # the columns of no tile: one analytic task for each pair of row blocks
    covered = made.groupBy("lang", "i", "j").agg(F.sum("width").alias("covered"))
    every = blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = (with_other(every).select("lang", "i", "j", "v").distinct().join(covered, ["lang", "i", "j"], "left")
            .select("lang", "i", "j", F.lit(-1).alias("cb"), (F.col("v") - F.coalesce("covered", F.lit(0))).alias("width")))
    heads = made.union(rest).withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    rows = groups.select("lang", F.floor(F.col("row") / ROWS).cast("int").alias("block"), "row",
                         F.coalesce("p0", F.lit(0)).cast("long").alias("p"))
    heads = heads.join(rows, ["lang", "block"]).select("lang", "i", "j", "cb", "width", "row", F.lit(-1).cast("long").alias("col"), "p")
    filled = with_other(placed).select("lang", "i", "j", "cb", F.lit(None).cast("long").alias("width"), "row", "col",
                                       F.col("p").cast("long").alias("p"))
    priced = (heads.union(filled).groupBy("lang", "i", "j", "cb")
              .applyInArrow(_price_tiles, "lang string, a long, b long, value long"))
    return priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                  min_docs: int = 30, top_terms: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): how far sources of a language lie apart, and by which terms.

    Part ``pair``: every other source of the language, with the sum of
    |p - q| over all kept terms (0 without any). Part ``term``: the
    ``top_terms`` kept terms that the group holds and gives a greater share
    than the language does, with the difference of the shares. Ranks start
    at 1, greatest value first, ties by item in UTF-8 order. Null text,
    language and source read ''; a repeated row counts as a document; a
    group without terms has its pairs; an empty table gives no rows; other
    columns are not read.
    """
    groups, _, cells = count_terms(docs, text, lang, source, min_docs)
    apart = materialize(pair_divergence(groups, cells), "apart")
    both = apart.union(apart.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    named = lambda c, n: bounded_broadcast(
        groups.select("lang", F.col("row").alias(c), F.col("source").alias(n)), LIST_BYTES)
    pairs = both.join(named("a", "source"), ["lang", "a"]).join(named("b", "item"), ["lang", "b"])
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(ranked)).select(out)
    over = cells.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                       (F.col("p") - F.col("q")).cast("long").alias("value"))
    over = over.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top_terms).select(out)
    return pairs.unionByName(over)
