"""Nearest neighbours by collision counting over single random projections.

Vectors are dealt into blocks of about ``BLOCK_ROWS`` and queries into blocks
of about ``BLOCK_QUERIES``; each pair of blocks is a task of its own, so no
task or broadcast grows with the table. In a block, equal vectors are one, and
the distinct ones are cut into ranges by norm: in a range of more than
``RANGE_TIMES`` the neighbours asked for, the norms differ by a factor of
``NORM_RATIO`` at most. Largest inner product is nearest distance after one
more component: with M the greatest norm of the range, a vector x becomes
(x, sqrt(M^2 - |x|^2)) and a query q, scaled to norm M, becomes (q, 0). Ranges
come with falling norms; one whose M times the query's norm is below the
scores found already is left out, since nothing in it can be better.

In a range every projection is one sorted array. A query's window around its
own projection starts narrow and widens by ``GROWTH`` a round in all arrays
(virtual rehashing: the window is the bucket, whatever its width; the search
for the last round begins at the last query's, with the same result). A vector
that lies in the windows of ``THRESHOLD`` of the projections is verified,
that is, its inner product is computed on the original components in double
precision. A range ends when ``VERIFY_SHARE`` of its vectors and
``VERIFY_TIMES`` the neighbours asked for have been verified, or when the
windows hold everything; every vector that passed the threshold by then has
been verified, however many. A range of so few vectors is verified whole.

Defined results: vectors that are null, empty, zero or hold a null or
non-finite component, and rows without id, take no part; of rows with one id
the least vector counts; vectors of another length are no candidates; ties go
to the smaller id; with fewer candidates than asked for, all are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16384
BLOCK_QUERIES = 1024
PROJECTIONS = 96
THRESHOLD = 0.6           # share of the projections
VERIFY_SHARE = 0.2        # of a range's vectors
VERIFY_TIMES = 12         # and so many times the neighbours asked for
RANGE_TIMES = 12          # a range has at least so many times the neighbours asked for
NORM_RATIO = 1.1          # between a larger range's greatest and least norm
START = 0.4               # first half-width, in units of the projections' spread
GROWTH = 1.1
SEED = 7


def _valid(v):
    """The vector as doubles, or null where it takes no part."""
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return F.when(sound & F.exists(v, lambda x: x != 0), F.transform(v, lambda x: x.cast("double")))


def _matrix(column) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return arr.flatten().to_numpy(zero_copy_only=False).reshape(len(arr), -1)


class Range:
    """Sorted projections of distinct vectors of like norm."""

    def __init__(self, vectors: np.ndarray, norms: np.ndarray, at: int):
        self.vectors, self.at, self.top = vectors, at, float(norms.max())
        self.order = None

    def _project(self) -> None:
        more = np.sqrt(np.maximum(self.top ** 2 - (self.vectors ** 2).sum(axis=1), 0))
        self.axes = np.random.default_rng(SEED).standard_normal((self.vectors.shape[1] + 1, PROJECTIONS))
        place = np.hstack((self.vectors, more[:, None])) @ self.axes
        self.order = order = np.argsort(place, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(place, order.T, axis=0).T.copy()
        # where each vector stands in each sorted array
        self.rank = np.empty(order.shape, np.uint16 if len(place) < 1 << 16 else np.uint32)
        np.put_along_axis(self.rank, order, np.arange(len(place), dtype=self.rank.dtype)[None, :], axis=1)
        self.spread = float(place.std()) or 1.0

    def _counted(self, centre: np.ndarray, turn: int):
        """(whether each vector lies in enough of the windows, whether the windows hold everything)."""
        n, width = len(self.vectors), START * self.spread * GROWTH ** turn
        lo = np.array([s.searchsorted(c, "left") for s, c in zip(self.sorted, centre - width)])
        span = np.array([s.searchsorted(c, "right") for s, c in zip(self.sorted, centre + width)]) - lo
        kind = self.rank.dtype
        # ranks below the window wrap around and fall outside
        np.subtract(self.rank, lo[:, None].astype(kind), out=self.place)
        np.less(self.place, span[:, None].astype(kind), out=self.inside)
        counts = self.inside.view(np.uint8).sum(axis=0, dtype=np.uint8 if PROJECTIONS < 256 else np.uint16)
        return counts >= int(np.ceil(THRESHOLD * PROJECTIONS)), span.min() == n

    def passed(self, queries: np.ndarray, k: int):
        """(query, indexes of the vectors to verify) for each query, in any order.

        The last width is the first of the series at which enough vectors
        pass. Wider windows never hold less, so the search for it begins at
        the last query's width and goes down or up from there.
        """
        n = len(self.vectors)
        goal = min(n, int(VERIFY_SHARE * n) + VERIFY_TIMES * k)
        if goal == n:
            yield from ((i, np.arange(n)) for i in range(len(queries)))
            return
        if self.order is None:
            self._project()
            self.place, self.inside = np.empty_like(self.rank), np.empty(self.rank.shape, bool)
            self.turn = 0
        scaled = queries * (self.top / np.sqrt((queries ** 2).sum(axis=1)))[:, None]
        for q, centre in enumerate(scaled @ self.axes[:-1]):
            found, low, turn = None, -1, self.turn        # ``low``: a width known to be too narrow
            while found is None or turn > low:
                ok, whole = self._counted(centre, turn)
                if whole or np.count_nonzero(ok) >= goal:
                    found, self.turn = ok, turn
                    turn -= 1
                else:
                    low, turn = turn, turn + 1
                    if found is not None:
                        break
            yield q, np.flatnonzero(found)


class Block:
    """The ranges of one block of vectors, in the order of falling norms."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order] + 0.0)
        row = vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
        _, first, copy = np.unique(row, return_index=True, return_inverse=True)
        norms = np.sqrt((vectors[first] ** 2).sum(axis=1))
        fall = np.lexsort((first, -norms))
        self.vectors, norms = vectors[first[fall]], norms[fall]
        # the ids of each distinct vector, in increasing order; more than k + 1 of them are never asked for
        turn = np.empty(len(fall), np.int64)
        turn[fall] = np.arange(len(fall))
        copy = turn[copy]
        by = np.argsort(copy, kind="stable")
        start = np.concatenate(([0], np.cumsum(np.bincount(copy))))
        few = np.arange(len(by)) - start[copy[by]] <= k
        self.ids, self.k = ids[by][few], k
        self.start = np.concatenate(([0], np.cumsum(np.bincount(copy[by][few]))))
        self.ranges, at, n = [], 0, len(norms)
        while at < n:
            end = int(np.searchsorted(-norms, -norms[at] / NORM_RATIO, "right"))
            end = min(n, max(end, at + RANGE_TIMES * k))
            self.ranges.append(Range(self.vectors[at:end], norms[at:end], at))
            at = end

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray):
        """For each query (ids, scores) of the k best verified vectors, best first."""
        k = self.k
        size, slack = np.sqrt((queries ** 2).sum(axis=1)), 1e-15 * (16 + queries.shape[1])
        least = np.full(len(queries), -np.inf)           # the (k + 1)th best score so far
        held = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        for part in self.ranges:
            asked = np.flatnonzero(size * part.top * (1 + 1e-9) >= least)
            for i, at in part.passed(queries[asked], k) if len(asked) else ():
                q = asked[i]
                score = part.vectors[at] @ queries[q]
                if len(score) > k:
                    # a product's last digits depend on its place in the matrix: those in reach are summed alike
                    least_here = max(least[q], np.partition(score, len(score) - k - 1)[len(score) - k - 1])
                    at = at[score >= least_here - slack * part.top * size[q]]
                score = np.concatenate((held[q][1], (part.vectors[at] * queries[q]).sum(axis=1)))
                at = np.concatenate((held[q][0], at + part.at))
                if len(score) > k:
                    least[q] = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                    at, score = at[score >= least[q]], score[score >= least[q]]
                held[q] = at, score
        found = []
        for q, (at, score) in enumerate(held):
            n = self.start[at + 1] - self.start[at]
            ids = self.ids[np.repeat(self.start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            score = np.repeat(score, n)
            ids, score = ids[ids != query_ids[q]], score[ids != query_ids[q]]
            best = np.lexsort((ids, -score))[:k]
            found.append((ids[best], score[best]))
        return found


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()
        block = Block(vectors.column("vec_id").to_numpy(), _matrix(vectors.column("v")), k)
        q = _matrix(queries.column("v"))
        ids = queries.column("vec_id").to_numpy()
        found = block.nearest(ids, q)
        return pa.table([pa.array(np.repeat(ids, [len(f[0]) for f in found]), pa.int64()),
                         pa.array(np.concatenate([f[0] for f in found]), pa.int64()),
                         pa.array(np.concatenate([f[1] for f in found]), pa.float64())], schema=schema)

    return run


def nearest(df: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest rows of ``df`` for each row of ``queries``.

    Both tables have ``id_col`` (long) and ``vector_col`` (array of numbers);
    a row with a query's id is not its neighbour.
    """
    def sound(t: DataFrame) -> DataFrame:
        v = t.select(F.col(id_col).cast("long").alias("vec_id"), _valid(F.col(vector_col)).alias("v"))
        v = v.where("vec_id is not null and v is not null").groupBy("vec_id").agg(F.min("v").alias("v"))
        return v.withColumn("dim", F.size("v"))

    vectors, asked = sound(df), sound(queries)
    blocks = max(1, -(-vectors.count() // BLOCK_ROWS))
    groups = max(1, -(-asked.count() // BLOCK_QUERIES))
    rows = (vectors.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
            .withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    asks = (asked.withColumn("g", F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.lit(groups)).cast("int"))
            .withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))))
    found = (rows.groupBy("b", "g", "dim").cogroup(asks.groupBy("b", "g", "dim"))
             .applyInArrow(_search(k), "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
