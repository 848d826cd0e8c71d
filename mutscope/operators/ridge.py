"""M4, M7: ridge regressions of all groups and bootstrap members from one read of the rows.

The normal equations of a system (group, member) need the sums of w·zzᵀ over
its rows, z = (features, 1, label). Tasks add these up for all their systems,
``ROWS_BYTES`` of rows at a time, and hand them on as tiles of the upper
triangle, ``TILE`` x ``TILE`` numbers each. A task keeps its sums while they
fit ``HELD_BYTES`` and hands them on otherwise, so that wide features cost
more tiles, never more memory. Tiles with the same place are added as they
come, one at a time. One task solves a system from its tiles: directly up to
``DIRECT`` features, beyond that by conjugate gradients on the tiles, which
are never put together. The work of a solve does not depend on the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..util import bounded_broadcast, materialize, null_safe_join
from .selection import ensemble_summary

TILE = 256
ROWS_BYTES = 64 << 20
HELD_BYTES = 256 << 20
DIRECT = 1024
RESIDUAL = 1e-13


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _tiles(keys, schema, batches):
    """Sums of w·zzᵀ of a task's rows: keys, member, i, j, width, and the tile."""
    types = [pa.int32()] * 4 + [pa.binary()]
    held: dict = {}
    buffer: dict = {}
    waiting = 0

    def handed_on():
        for (key, member), sums in held.items():
            d = len(sums)
            places = [(i, j) for i in range(0, d, TILE) for j in range(i, d, TILE)]
            for at in range(0, len(places), 64):
                some = places[at:at + 64]
                fixed = [pa.array([k] * len(some), schema[c].type) for c, k in zip(keys, key)]
                cols = ([member] * len(some), [i // TILE for i, _ in some], [j // TILE for _, j in some], [d] * len(some),
                        [sums[i:i + TILE, j:j + TILE].tobytes() for i, j in some])
                yield pa.RecordBatch.from_arrays([*fixed, *(pa.array(c, t) for c, t in zip(cols, types))],
                                                 names=[*keys, "member", "i", "j", "width", "tile"])
        held.clear()

    def add_up():
        for key, parts in buffer.items():
            x, y, w = (np.concatenate(p) for p in zip(*parts))
            z = np.column_stack((x, np.ones(len(x)), y))
            for m in range(w.shape[1]):
                if len(held) * z.shape[1] ** 2 * 8 > HELD_BYTES and (key, m) not in held:
                    yield from handed_on()
                sums = (z * w[:, m:m + 1]).T @ z
                held[key, m] = held[key, m] + sums if (key, m) in held else sums
        buffer.clear()

    for b in batches:
        if not b.num_rows:
            continue
        x, y, w = _matrix(b.column("x")), b.column("y").to_numpy(), _matrix(b.column("w"))
        coded = [b.column(k).dictionary_encode("encode") for k in keys]
        code = np.zeros(b.num_rows, np.int64)
        for c in coded:
            code = code * len(c.dictionary) + c.indices.to_numpy()
        for c in np.unique(code):
            rows = np.flatnonzero(code == c)
            key = tuple(b.column(k)[int(rows[0])].as_py() for k in keys)
            buffer.setdefault(key, []).append((x[rows], y[rows], w[rows]))
        waiting += x.nbytes
        if waiting > ROWS_BYTES:
            yield from add_up()
            waiting = 0
    yield from add_up()
    yield from handed_on()


def add_tiles(by: list[str], batches):
    """Adds the tiles of equal place, which follow each other, holding one sum at a time."""
    at = total = schema = None
    for b in batches:
        schema = b.schema
        rows = b.select(by).to_pylist()
        for row, raw in zip(rows, b.column("tile")):
            key = tuple(row.values())
            tile = np.frombuffer(raw.as_buffer())
            if key == at:
                total = total + tile
                continue
            if at is not None:
                yield _tile_batch(schema, by, at, total)
            at, total = key, tile
    if at is not None:
        yield _tile_batch(schema, by, at, total)


def _tile_batch(schema, by, key, total):
    return pa.RecordBatch.from_arrays([*(pa.array([k], schema.field(c).type) for c, k in zip(by, key)),
                                       pa.array([total.tobytes()], pa.binary())], names=[*by, "tile"])


class Tiles:
    """A symmetric matrix kept as the tiles of its upper triangle, with a product."""

    def __init__(self, width: int):
        self.width, self.parts = width, {}

    def put(self, i: int, j: int, raw) -> None:
        lo, hi = i * TILE, j * TILE
        self.parts[i, j] = np.frombuffer(raw).reshape(min(TILE, self.width - lo), min(TILE, self.width - hi))

    def times(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for (i, j), t in self.parts.items():
            a, b = slice(i * TILE, i * TILE + t.shape[0]), slice(j * TILE, j * TILE + t.shape[1])
            out[a] += t @ v[b]
            if i != j:
                out[b] += t.T @ v[a]
        return out

    def dense(self) -> np.ndarray:
        out = np.zeros((self.width, self.width))
        for (i, j), t in self.parts.items():
            out[i * TILE:i * TILE + t.shape[0], j * TILE:j * TILE + t.shape[1]] = t
            out[j * TILE:j * TILE + t.shape[1], i * TILE:i * TILE + t.shape[0]] = t.T
        return out

    def diagonal(self) -> np.ndarray:
        return np.concatenate([np.diag(self.parts[i, i]) for i in range(-(-self.width // TILE))])


def solve_ridge(tiles: Tiles, alpha: float, direct: int = DIRECT) -> np.ndarray:
    """(intercept, coefficients) from the sums of zzᵀ; the intercept is not penalised.

    Without weight the coefficients are 0; a singular system (alpha 0) has its least-squares solution of least length.
    """
    p = tiles.width - 2                                      # features; then the constant and the label
    last = np.zeros(tiles.width)
    last[p + 1] = 1.0
    one = np.zeros(tiles.width)
    one[p] = 1.0
    zy, z1 = tiles.times(last), tiles.times(one)
    n = z1[p]
    if n <= 0:
        return np.zeros(p + 1)
    mean, mean_y = z1[:p] / n, z1[p + 1] / n
    b = zy[:p] - n * mean * mean_y                           # centred by the weighted means, so the intercept drops out
    if p <= direct:
        a = tiles.dense()[:p, :p] - n * np.outer(mean, mean) + alpha * np.eye(p)
        beta = np.linalg.solve(a, b) if alpha > 0 else np.linalg.lstsq(a, b, rcond=None)[0]
    else:
        beta = _conjugate_gradients(tiles, alpha, mean, n, b)
    return np.concatenate(([mean_y - mean @ beta], beta))


def _conjugate_gradients(tiles: Tiles, alpha: float, mean: np.ndarray, n: float, b: np.ndarray) -> np.ndarray:
    """The centred, penalised system by conjugate gradients with its diagonal as preconditioner."""
    p = len(b)
    scale = np.maximum(tiles.diagonal()[:p] - n * mean * mean + alpha, 1e-300)

    def times(v):
        wide = np.concatenate((v, np.zeros(2)))
        return tiles.times(wide)[:p] - n * mean * (mean @ v) + alpha * v

    x, r = np.zeros(p), b.copy()
    d = r / scale
    gain, goal = r @ d, RESIDUAL * np.sqrt(b @ b)
    for _ in range(10 * p):
        if np.sqrt(r @ r) <= goal:
            break
        q = times(d)
        step = gain / (d @ q)
        x += step * d
        r -= step * q
        z = r / scale
        gain, before = r @ z, gain
        d = z + gain / before * d
    return x


def _solver(keys, alpha):
    def run(table):
        tiles = Tiles(table.column("width")[0].as_py())
        for i, j, raw in zip(table.column("i").to_pylist(), table.column("j").to_pylist(), table.column("tile")):
            tiles.put(i, j, raw.as_buffer())
        coef = solve_ridge(tiles, alpha)
        names = [*keys, "member"]
        return pa.table([*(table.column(c).slice(0, 1) for c in names), pa.array([coef.tolist()], pa.list_(pa.float64()))],
                        names=[*names, "coef"])

    return run


def fit_ridges(df: DataFrame, keys: list[str], features: str, label: str, weights: Column, alpha: float = 1.0) -> DataFrame:
    """keys, member, coef (intercept first): a ridge for every group and every entry of ``weights``, an array column.

    Rows without features, label or weights are left out; NULL keys are a
    group; a member that drew no row has zeros.
    """
    rows = df.select(*[F.col(k) for k in keys], F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"),
                     weights.cast("array<double>").alias("w")).where("x is not null and y is not null and w is not null")
    fields = [rows.schema[k] for k in keys]
    schema = T.StructType([*fields, *T.StructType.fromDDL("member int, i int, j int, width int, tile binary").fields])
    arrow = {c: f for c, f in zip(keys, rows.select(*keys).limit(0).toArrow().schema)} if keys else {}
    by = [*keys, "member", "i", "j", "width"]
    tiles = rows.mapInArrow(lambda it: _tiles(keys, arrow, it), schema)
    summed = tiles.repartition(*by).sortWithinPartitions(*by).mapInArrow(lambda it: add_tiles(by, it), schema)
    summed = materialize(summed, "tiles")
    out = T.StructType([*fields, *T.StructType.fromDDL("member int, coef array<double>").fields])
    return summed.groupBy(*keys, "member").applyInArrow(_solver(keys, alpha), out)


def predict_ridges(df: DataFrame, coefs: DataFrame, keys: list[str], features: str) -> DataFrame:
    """``df`` with components (each member's prediction), prediction (their mean) and uncertainty (population σ).

    A row of a group without a fit has NULLs.
    """
    members = coefs.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("member", "coef"))),
                                                   lambda s: s["coef"]).alias("_coefs"))
    members = bounded_broadcast(materialize(members, "ridges"))
    x = F.col(features).cast("array<double>")
    dot = lambda c: F.aggregate(F.zip_with(x, F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: a * b),
                                F.element_at(c, 1), lambda a, v: a + v)
    df = df.drop("components", "prediction", "uncertainty")
    joined = null_safe_join(df, members, keys, "left") if keys else df.withColumn("_coefs", members.scalar())
    out = joined.withColumn("components", F.transform("_coefs", dot))
    mean, sd = ensemble_summary("components")
    return out.withColumn("prediction", mean).withColumn("uncertainty", sd).drop("_coefs")
