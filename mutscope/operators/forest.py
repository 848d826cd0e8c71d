"""M3, M7: random forests of all groups (data set, run, simulation, round) in one job, grown until leaves are pure.

A forest is ``trees`` regression trees on Poisson(1) bootstrap weights from a
seeded hash; every feature is tried at every split, the split with the least
squared error wins (ties: the first feature, then the smallest threshold), a
threshold is the middle of two neighbouring values, and a node is split as long
as its labels differ and a feature does.

Growth. A node of at most ``NODE_ROWS`` rows is grown to its leaves inside one
task, all its nodes a level at a time in numpy. For a group of that size this
is the whole tree: the group's rows go to one task for each ``TREE_BLOCK``
trees. A larger group is first cut level by level: each row carries its node
in every tree; tasks add up histograms of weight and label by (tree, node,
feature, bin), Spark sums them by node, the best cut of each node is one row,
and rows move to the child nodes. Bins are the group's ``BINS`` quantiles. A
node that its bins cannot cut is given quantiles of its own, so that only
nodes whose rows agree in all features stay whole; those are leaves.

A forest is a table: ``units`` holds the subtrees as arrays, ``upper`` the cuts
above them. Rows are predicted by following the cuts, then meeting their
subtrees in a cogroup, at most about ``PREDICT_ROWS`` rows of a group in each.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..util import bounded_broadcast, materialize, null_safe_join
from .selection import ensemble_summary

NODE_ROWS = 4096
TREE_BLOCK = 10
BINS = 64
PREDICT_ROWS = 1 << 14
CUT_BYTES = 32 << 20          # of the quantiles that are broadcast: larger groups are cut in turns
HIST_ROWS = 1 << 15           # rows whose histograms a task adds up at a time
HIST_BYTES = 32 << 20         # of the histograms that a task holds
ROUTE_ROWS = 1 << 15          # rows, one for each tree, that are routed at a time
MAX_NODES = 1 << 18           # nodes cut in one level; more trees than that are grown in turns

TREE = ("feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>")


# ---------------------------------------------------------------- one tree, in numpy

def grow_tree(x: np.ndarray, y: np.ndarray, w: np.ndarray):
    """(feature, threshold, left, right, value) of a tree on the rows with w > 0; feature -1 marks a leaf.

    All nodes of a level are split together: rows stand sorted by (node,
    value) in every feature, and running sums give each place's gain.
    """
    some = w > 0
    x, y, w = np.ascontiguousarray(x[some].T), y[some], w[some].astype(float)
    wy = w * y
    feature, threshold, left, right = [-1], [0.0], [-1], [-1]
    value = [wy.sum() / w.sum()]
    order = np.argsort(x, axis=1, kind="stable")
    node = np.zeros(len(y), np.int64)                  # of this level, by row
    out = np.zeros(1, np.int64)                        # a level's nodes among all
    if y.min() == y.max():
        order = order[:, :0]
    while order.shape[1]:
        here = node[order[0]]
        off = np.flatnonzero(np.concatenate(([True], here[1:] != here[:-1])))
        total = lambda v: np.add.reduceat(v[order[0]], off)          # noqa: E731
        all_w, all_wy = total(w), total(wy)

        def running(v):
            c = np.cumsum(v[order], axis=1)
            base = np.concatenate((np.zeros((len(c), 1)), c[:, off[1:] - 1]), axis=1)
            return c - base[:, here]

        lw, lwy = running(w), running(wy)
        xs = np.take_along_axis(x, order, axis=1)
        able = np.zeros(xs.shape, bool)
        able[:, :-1] = (xs[:, 1:] > xs[:, :-1]) & (here[1:] == here[:-1])
        rw, rwy = np.where(able, all_w[here] - lw, 1.0), all_wy[here] - lwy
        gain = np.where(able, lwy * lwy / lw + rwy * rwy / rw, -np.inf)
        best = np.maximum.reduceat(gain, off, axis=1)
        f = best.argmax(axis=0)
        top = best[f, np.arange(len(off))]
        place = np.arange(len(here))
        at = np.minimum.reduceat(np.where(gain[f[here], place] == top[here], place, len(here)), off)
        cut = top > -np.inf
        lo, hi = xs[f, at], xs[f, np.minimum(at + 1, len(here) - 1)]
        middle = lo + (hi - lo) / 2
        middle = np.where(middle < hi, middle, lo)
        # children, two for each node that is cut
        first = len(feature) + 2 * (np.cumsum(cut) - 1)
        rows, of = order[0], here
        goes_right = x[f[of], rows] > middle[of]
        child = np.where(cut[of], first[of] - len(feature) + goes_right, -1)
        for i in np.flatnonzero(cut):
            feature[out[i]], threshold[out[i]], left[out[i]], right[out[i]] = int(f[i]), float(middle[i]), int(first[i]), int(first[i]) + 1
        n_child = 2 * int(cut.sum())
        sums = lambda v: np.bincount(child[child >= 0], v[rows][child >= 0], n_child)
        value += list(sums(wy) / sums(w)) if n_child else []
        smallest, largest = np.full(n_child, np.inf), np.full(n_child, -np.inf)
        np.minimum.at(smallest, child[child >= 0], y[rows][child >= 0])
        np.maximum.at(largest, child[child >= 0], y[rows][child >= 0])
        goes_on = smallest < largest
        out = len(feature) + np.flatnonzero(goes_on)
        for column, fill in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1)):
            column += [fill] * n_child
        number = np.where(goes_on, np.cumsum(goes_on) - 1, -1)
        node = np.full(len(y), -1)
        node[rows] = np.where(child >= 0, number[child], -1) if n_child else -1
        of = node.astype(np.int16)[order] if n_child < 1 << 15 else node[order]       # two bytes are sorted by radix
        keep = of >= 0
        order, of = order[keep].reshape(len(x), -1), of[keep].reshape(len(x), -1)
        order = np.take_along_axis(order, np.argsort(of, axis=1, kind="stable"), axis=1)
    return feature, threshold, left, right, value


def predict_tree(tree, x: np.ndarray) -> np.ndarray:
    feature, threshold, left, right, value = (np.asarray(a) for a in tree)
    at, open_ = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(open_):
        open_ = open_[feature[at[open_]] >= 0]
        here = at[open_]
        at[open_] = np.where(x[open_, feature[here]] <= threshold[here], left[here], right[here])
    return value[at].astype(float)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


# ---------------------------------------------------------------- weights and units

def poisson_draw(u: Column) -> Column:
    """A Poisson(1) count from a uniform number: the inverse distribution function in doubles, up to where it reaches 1."""
    steps, cdf, p = [], 0.0, math.exp(-1.0)
    while cdf + p > cdf:
        cdf += p
        steps.append(F.lit(cdf))
        p /= len(steps)
    return F.size(F.filter(F.array(*steps), lambda s: s <= u))


def poisson_weights(members: int, seed: Column, row: Column) -> Column:
    """array<int>: a Poisson(1) draw for each member, from a hash of (seed, member, row)."""
    uniform = lambda m: F.shiftrightunsigned(F.xxhash64(seed, m, row), 11) / F.lit(float(1 << 53))
    return F.transform(F.sequence(F.lit(0), F.lit(members - 1)), lambda m: poisson_draw(uniform(m)))


@dataclass
class Forests:
    """``units``: keys, tree, node, subtree arrays. ``upper``: keys, tree, node, feature, threshold, left, right (None without)."""
    keys: list[str]
    trees: int
    units: DataFrame
    upper: DataFrame | None


def _grow(keys, schema):
    def run(table):
        x, y, w = _matrix(table.column("x")), table.column("y").to_numpy(), _matrix(table.column("w"))
        rows = []
        for j in range(w.shape[1]):
            weights = w[:, j] if w[:, j].any() else np.ones(len(y))    # an empty draw takes every row once
            rows.append(grow_tree(x, y, weights))
        n = len(rows)
        fixed = [pa.array([table.column(k)[0].as_py()] * n, table.schema.field(k).type) for k in keys]
        tree = pa.array(table.column("tree")[0].as_py() + np.arange(n), pa.int32())
        node = pa.array([table.column("node")[0].as_py()] * n, pa.int64())
        kinds = (pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64())
        arrays = [pa.array([r[i] for r in rows], pa.list_(kind)) for i, kind in enumerate(kinds)]
        return pa.table([*fixed, tree, node, *arrays], names=schema.fieldNames())

    return run


def _tree_schema(key_fields) -> T.StructType:
    return T.StructType([*key_fields, *T.StructType.fromDDL("tree int, node long, " + TREE).fields])


def fit_forests(df: DataFrame, keys: list[str], features: str, label: str, id_col: str, trees: int = 100,
                seed: Column | None = None, node_rows: int = NODE_ROWS) -> Forests:
    """M3/M7: a forest for every group of ``keys``.

    ``seed`` is a column, so that each (simulation, round) draws its own
    weights. Rows without features or label are left out; rows that share an
    id share their draws; NULL keys are a group.
    """
    keys = list(keys)
    rows = df.select(*[F.col(k) for k in keys], F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"),
                     poisson_weights(trees, F.lit(42) if seed is None else seed, F.col(id_col)).alias("w"))
    rows = materialize(rows.where("x is not null and y is not null and not isnan(y)"), "forest-rows")
    fields = [rows.schema[k] for k in keys]
    counts = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "forest-groups")
    one = counts.where(F.col("_n") <= node_rows).drop("_n")
    blocks = F.explode(F.sequence(F.lit(0), F.lit(trees - 1), F.lit(TREE_BLOCK)))
    small = null_safe_join(rows, bounded_broadcast(one), keys)
    small = small.select(*keys, "x", "y", "w", blocks.alias("tree"), F.lit(0).cast("long").alias("node"))
    small = small.withColumn("w", F.slice("w", F.col("tree") + 1, F.lit(TREE_BLOCK)))
    # at most the rows / node_rows groups
    large = [r.asDict() for r in counts.where(F.col("_n") > node_rows).drop("_n").collect()]
    parts, upper = [small], []
    if large:
        width = rows.agg(F.max(F.size("x"))).first()[0]
        turn = max(1, CUT_BYTES // (max(1, width) * BINS * 8))
        for at in range(0, len(large), turn):
            cut, above = _cut_large(rows, keys, fields, large[at:at + turn], trees, node_rows)
            parts.append(cut)
            upper += above
    grown = (reduce(DataFrame.union, [p.select(*keys, "tree", "node", "x", "y", "w") for p in parts])
             .groupBy(*keys, "tree", "node").applyInArrow(_grow(keys, _tree_schema(fields)), _tree_schema(fields)))
    above = None
    if upper:
        schema = T.StructType([*fields, *T.StructType.fromDDL(
            "tree int, node long, feature int, threshold double, left long, right long").fields])
        above = materialize(df.sparkSession.createDataFrame(upper, schema), "forest-upper")
    return Forests(keys, trees, materialize(grown, "forest"), above)


# ---------------------------------------------------------------- cuts above the subtrees

def _gathered(batches):
    """Tables of about ``HIST_ROWS`` rows, or what is left: the batches as they come, put together."""
    some, n = [], 0
    for b in batches:
        if b.num_rows:
            some.append(b)
            n += b.num_rows
        if n >= HIST_ROWS:
            yield pa.Table.from_batches(some)
            some, n = [], 0
    if some:
        yield pa.Table.from_batches(some)


def _histograms(shared, batches):
    """(unit, tree, node, hist): weight, weighted label, rows, least and greatest value by feature and bin; then of the label."""
    open_nodes, width = shared.value                   # {(unit, tree): nodes, sorted}
    held: dict = {}
    for b in _gathered(batches):
        unit, bins = b.column("unit").to_numpy(), _matrix(b.column("bin"))
        x, y, w, node = _matrix(b.column("x")), b.column("y").to_numpy(), _matrix(b.column("w")), _matrix(b.column("node"))
        offset = np.arange(width) * BINS
        for u in np.unique(unit):
            mine = unit == u
            for t in range(w.shape[1]):
                want = open_nodes.get((int(u), t))
                if want is None:
                    continue
                rows = np.flatnonzero(mine & (w[:, t] > 0) & np.isin(node[:, t], want))
                if not len(rows):
                    continue
                rows = rows[np.argsort(node[rows, t], kind="stable")]
                at = node[rows, t]
                for r in np.split(rows, np.flatnonzero(at[1:] != at[:-1]) + 1):
                    h = np.zeros((5, width * BINS + 1))
                    place = (bins[r] + offset).ravel()
                    for i, v in enumerate((w[r, t], w[r, t] * y[r], np.ones(len(r)))):
                        h[i, :-1] = np.bincount(place, np.repeat(v, width), width * BINS)
                    h[3], h[4] = np.inf, -np.inf
                    np.minimum.at(h[3], place, x[r].ravel())
                    np.maximum.at(h[4], place, x[r].ravel())
                    h[3, -1], h[4, -1] = y[r].min(), y[r].max()
                    key = (int(u), t, int(node[r[0], t]))
                    held[key] = _merged(held[key], h) if key in held else h
                    if len(held) * width * BINS * 40 > HIST_BYTES:
                        yield _hist_batch(held)
                        held = {}
    if held:
        yield _hist_batch(held)


def _merged(a, b):
    return np.concatenate((a[:3] + b[:3], np.minimum(a[3:4], b[3:4]), np.maximum(a[4:], b[4:])))


def _hist_batch(held):
    cols = zip(*held) if held else ((), (), ())
    types = (pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types)),
                                       pa.array([h.tobytes() for h in held.values()], pa.binary())],
                                      names=["unit", "tree", "node", "hist"])


def _best_cut(key, h: np.ndarray, width: int):
    """unit, tree, node, feature, bin (-1 without a cut), threshold, rows left, rows, whether labels are equal, mean label."""
    w, wy, n = (part.reshape(width, BINS).cumsum(axis=1) for part in h[:3, :-1])
    lw, lwy, rw, rwy = w[:, :-1], wy[:, :-1], w[:, -1:] - w[:, :-1], wy[:, -1:] - wy[:, :-1]
    able = (n[:, :-1] > 0) & (n[:, :-1] < n[:, -1:])
    gain = np.where(able, lwy ** 2 / np.where(able, lw, 1) + rwy ** 2 / np.where(able, rw, 1), -np.inf)
    f, k = divmod(int(gain.argmax()), BINS - 1)
    pure = h[3, -1] == h[4, -1]
    whole = (int(n[0, -1]), bool(pure), float(wy[0, -1] / w[0, -1]))
    if pure or not able.any():
        return (*key, 0, -1, 0.0, 0, *whole)
    lo, hi = h[4, :-1].reshape(width, BINS)[f, :k + 1].max(), h[3, :-1].reshape(width, BINS)[f, k + 1:].min()
    middle = lo + (hi - lo) / 2
    return (*key, f, k, float(middle if middle < hi else lo), int(n[f, k]), *whole)


_CUTS = ("unit int, tree int, node long, feature int, bin int, threshold double, n_left long, n long, pure boolean, "
         "value double")


def _best_cuts(width, batches):
    """Sums the sorted histograms of each node as they come and returns its best cut: one histogram is held at a time."""
    at, total, out = None, None, []
    for b in batches:
        for key, raw in zip(zip(*(b.column(i).to_pylist() for i in range(3))), b.column(3)):
            h = np.frombuffer(raw.as_buffer()).reshape(5, -1)
            if key == at:
                total = _merged(total, h)
                continue
            if at is not None:
                out.append(_best_cut(at, total, width))
            at, total = key, h
        if len(out) > 10_000:
            yield _cut_batch(out)
            out = []
    if at is not None:
        out.append(_best_cut(at, total, width))
    yield _cut_batch(out)


def _cut_batch(out):
    schema = pa.schema([("unit", pa.int32()), ("tree", pa.int32()), ("node", pa.int64()), ("feature", pa.int32()), ("bin", pa.int32()),
                        ("threshold", pa.float64()), ("n_left", pa.int64()), ("n", pa.int64()), ("pure", pa.bool_()), ("value", pa.float64())])
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)


def _binned(shared, names, first, batches):
    """Adds bin (of each feature: how many of the unit's cuts lie below the value) and node (the unit's first, in each tree)."""
    cuts = shared.value                                # {unit: [sorted cuts of each feature]}
    for b in batches:
        if not b.num_rows:
            continue
        unit, x, w = b.column("unit").to_numpy(), _matrix(b.column("x")), b.column("w")
        bins = np.zeros(x.shape, np.int32)
        for u in np.unique(unit):
            mine = unit == u
            for f, c in enumerate(cuts[int(u)]):
                bins[mine, f] = np.searchsorted(c, x[mine, f], "left")
        node = np.repeat(np.array(first)[unit], len(w.flatten()) // b.num_rows)
        lists = lambda v, kind: pa.FixedSizeListArray.from_arrays(pa.array(v.ravel(), kind), len(v.ravel()) // b.num_rows).cast(pa.list_(kind))
        yield pa.RecordBatch.from_arrays([*b.columns, lists(bins, pa.int32()), lists(node, pa.int64())], names=[*names, "bin", "node"])


def _moved(shared, batches):
    """Rows move to the child nodes of this level's cuts."""
    cuts = shared.value                                # {(unit, tree): (nodes sorted, feature, bin, left)}
    for b in batches:
        if not b.num_rows:
            continue
        unit, bins, node = b.column("unit").to_numpy(), _matrix(b.column("bin")), _matrix(b.column("node")).copy()
        for u in np.unique(unit):
            mine = np.flatnonzero(unit == u)
            for t in range(node.shape[1]):
                if (int(u), t) not in cuts:
                    continue
                nodes, f, k, left = cuts[int(u), t]
                at = np.minimum(np.searchsorted(nodes, node[mine, t]), len(nodes) - 1)
                hit = nodes[at] == node[mine, t]
                r, at = mine[hit], at[hit]
                node[r, t] = left[at] + (bins[r, f[at]] > k[at])
        i = b.schema.get_field_index("node")
        moved = pa.FixedSizeListArray.from_arrays(pa.array(node.ravel()), node.shape[1]).cast(pa.list_(pa.int64()))
        yield b.set_column(i, "node", moved)


def _quantiles(rows: DataFrame) -> dict:
    """{unit: [cuts of each feature]}: values that stand at BINS - 1 even places and below the greatest."""
    share = [i / (BINS - 1) for i in range(BINS)]
    q = (rows.select("unit", F.posexplode("x").alias("f", "v")).groupBy("unit", "f")
         .agg(F.percentile_approx("v", share, 10_000).alias("q")).toArrow())
    out: dict = {}
    for u, f, c in sorted(zip(q.column("unit").to_pylist(), q.column("f").to_pylist(), q.column("q").to_pylist())):
        out.setdefault(u, []).append(np.unique(c)[:-1])
    return out


def _cut_large(rows: DataFrame, keys, fields, groups: list[dict], trees: int, node_rows: int):
    """(rows of the subtrees, cuts above them) of groups too large for one task."""
    spark, context = rows.sparkSession, rows.sparkSession.sparkContext
    # a unit starts trees: (key values, first tree, node); later a node that gets quantiles of its own
    units = [(tuple(g[k] for k in keys), 0, 0) for g in groups]
    named = spark.createDataFrame([(i, *u[0]) for i, u in enumerate(units)], T.StructType([T.StructField("unit", T.IntegerType()), *fields]))
    pool = null_safe_join(rows, F.broadcast(named), keys).select("unit", "x", "y", "w")
    last = defaultdict(int)                            # the last node number given out in (key values, tree)
    done, above, n_trees = [], [], trees
    while units:
        pool = materialize(pool, "forest-pool")
        cuts = _quantiles(pool)
        width = max(len(c) for c in cuts.values())
        shared, names = context.broadcast(cuts), pool.columns
        schema = T.StructType([*pool.schema.fields, *T.StructType.fromDDL("bin array<int>, node array<long>").fields])
        first = [units[u][2] for u in range(len(units))]
        state = pool.mapInArrow(lambda it, s=shared, c=names, f=first: _binned(s, c, f, it), schema)
        state = materialize(state, "forest-state")
        open_nodes = {(u, t): np.array([first[u]]) for u in range(len(units)) for t in range(n_trees)}
        leaves, stuck = [], []                         # (unit, tree, node), with the label of a leaf
        while open_nodes:
            moves, following = defaultdict(list), {}
            for u, t, node, f, k, threshold, n_left, n, pure, value in _level(state, open_nodes, width):
                keyvals, first_tree, root = units[u]
                if k < 0:
                    constant = node == root and n_trees == 1 and not any(len(c) for c in cuts[u])
                    (leaves if pure or constant else stuck).append((u, t, node, value))
                    continue
                tree = (keyvals, first_tree + t)
                left, last[tree] = last[tree] + 1, last[tree] + 2
                above.append((*keyvals, first_tree + t, node, f, threshold, left, left + 1))
                moves[u, t].append((node, f, k, left))
                more = [child for child, size in ((left, n_left), (left + 1, n - n_left)) if size > node_rows]
                following[u, t] = following.get((u, t), []) + more
            if moves:
                move = context.broadcast({key: tuple(np.array(c) for c in zip(*sorted(m))) for key, m in moves.items()})
                state = materialize(state.mapInArrow(lambda it, s=move: _moved(s, it), state.schema), "forest-state")
            open_nodes = {key: np.array(sorted(nodes)) for key, nodes in following.items() if nodes}
        long = state.select("unit", "x", "y", F.posexplode(F.arrays_zip("node", "w")).alias("t", "at"))
        long = long.select("unit", "t", F.col("at.node").alias("node"), "x", "y", F.array("at.w").alias("w")).where("w[0] > 0")
        told = spark.createDataFrame([(u, *unit[0], unit[1]) for u, unit in enumerate(units)], T.StructType([
            T.StructField("unit", T.IntegerType()), *fields, T.StructField("_first", T.IntegerType())]))
        ends = spark.createDataFrame([(u, t, node, None, value) for u, t, node, value in leaves]
                                     + [(u, t, node, i, None) for i, (u, t, node, _) in enumerate(stuck)],
                                     "unit int, t int, node long, stuck int, leaf double")
        long = long.join(bounded_broadcast(told), "unit").join(bounded_broadcast(ends), ["unit", "t", "node"], "left")
        long = materialize(long.withColumn("tree", F.col("_first") + F.col("t")), "forest-long")
        done.append(long.where("stuck is null and leaf is null").select(*keys, "tree", "node", "x", "y", "w"))
        # a leaf's rows are alike in label or in all features: one row with their mean stands for them
        done.append(long.where("leaf is not null").groupBy(*keys, "tree", "node")
                    .agg(F.min("x").alias("x"), F.first("leaf").alias("y"), F.array(F.lit(1)).alias("w")))
        pool = long.where("stuck is not null").select(F.col("stuck").alias("unit"), "x", "y", "w")
        units = [(units[u][0], units[u][1] + t, node) for u, t, node, _ in stuck]
        n_trees = 1
    return reduce(DataFrame.union, [p.select(*keys, "tree", "node", "x", "y", "w") for p in done]), above


def _level(state: DataFrame, open_nodes: dict, width: int) -> list:
    """The best cut of every open node, at most ``MAX_NODES`` nodes a job."""
    context, out = state.sparkSession.sparkContext, []
    todo, some, size = list(open_nodes.items()), {}, 0
    while todo or some:
        if todo and (not some or size + len(todo[-1][1]) <= MAX_NODES):
            key, nodes = todo.pop()
            some[key], size = nodes, size + len(nodes)
            if todo:
                continue
        shared = context.broadcast((some, width))
        hist = state.mapInArrow(lambda it, s=shared: _histograms(s, it), "unit int, tree int, node long, hist binary")
        hist = hist.repartition("unit", "tree", "node").sortWithinPartitions("unit", "tree", "node")
        found = hist.mapInArrow(lambda it: _best_cuts(width, it), _CUTS)
        out += [tuple(r.values()) for r in materialize(found, "forest-cuts").toArrow().to_pylist()]
        some, size = {}, 0
    return sorted(out, key=lambda r: r[:3])


# ---------------------------------------------------------------- prediction

def _routes(shared, keys, trees, batches):
    """Rows of cut groups, once for each tree: _row, keys, x, tree and the node whose subtree the row meets."""
    cuts = shared.value                                # {key values: {tree: {node: (feature, threshold, left, right)}}}
    step = max(1, ROUTE_ROWS // len(trees))
    for b in (whole.slice(lo, step) for whole in batches for lo in range(0, whole.num_rows, step)):
        x = _matrix(b.column("x"))
        at, nodes = [], []
        for i, key in enumerate(zip(*(b.column(k).to_pylist() for k in keys))):
            mine = cuts[key]
            for t in trees:
                node, tree = 0, mine.get(t, {})
                while node in tree:
                    f, limit, left, right = tree[node]
                    node = left if x[i, f] <= limit else right
                at.append(i)
                nodes.append((t, node))
        taken = b.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array([t for t, _ in nodes], pa.int32()),
                                          pa.array([n for _, n in nodes], pa.int64())], names=[*b.schema.names, "tree", "node"])


def _meet(rows, units):
    """_row, first tree and predictions of consecutive trees, for rows that meet the same subtrees."""
    if not rows.num_rows or not units.num_rows:
        return pa.table({"_row": pa.array([], pa.int64()), "tree": pa.array([], pa.int32()), "part": pa.array([], pa.list_(pa.float64()))})
    units = units.sort_by("tree")
    x = _matrix(rows.column("x"))
    parts = np.stack([predict_tree([units.column(c)[i].as_py() for c in ("feature", "threshold", "left", "right", "value")], x)
                      for i in range(units.num_rows)], axis=1)
    part = pa.FixedSizeListArray.from_arrays(pa.array(parts.ravel()), parts.shape[1]).cast(pa.list_(pa.float64()))
    return pa.table({"_row": rows.column("_row"), "tree": pa.array([units.column("tree")[0].as_py()] * rows.num_rows, pa.int32()), "part": part})


def _meetings(rows: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and subtrees of equal ``keys`` in one task, in shares of about ``PREDICT_ROWS`` rows."""
    shares = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PREDICT_ROWS).cast("int").alias("_shares"))
    shares = bounded_broadcast(materialize(shares, "shares"))
    rows = null_safe_join(rows, shares, keys).withColumn("_share", F.pmod(F.xxhash64("_row"), F.col("_shares")).cast("int")).drop("_shares")
    units = null_safe_join(units, shares, keys).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
    met = rows.groupBy(*keys, "_share").cogroup(units.groupBy(*keys, "_share"))
    return met.applyInArrow(_meet, "_row long, tree int, part array<double>")


def predict_forests(model: Forests, df: DataFrame, features: str) -> DataFrame:
    """M3/M5/M7: ``df`` with components (each tree's prediction), prediction (their mean) and uncertainty (population σ).

    A row without features, or of a group without a forest, has NULLs.
    """
    keys, names = model.keys, df.columns
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "forest-asked")
    asked = rows.select("_row", *[F.col(k) for k in keys], F.col(features).cast("array<double>").alias("x")).where("x is not null")
    if model.upper is None:
        parts = [_meetings(asked, model.units, keys)]
    else:
        cut = materialize(model.upper.select(*keys).distinct(), "forest-cut")
        whole = null_safe_join(asked, bounded_broadcast(cut), keys, "left_anti")
        whole_units = null_safe_join(model.units, bounded_broadcast(cut), keys, "left_anti")
        parts = [_meetings(whole, whole_units, keys)]
        routed = null_safe_join(asked, bounded_broadcast(cut), keys, "left_semi")
        schema = T.StructType([*routed.schema.fields, *T.StructType.fromDDL("tree int, node long").fields])
        sizes = dict(model.upper.groupBy("tree").count().collect())
        trees, some = list(range(model.trees)), []
        while trees:
            some.append(trees.pop(0))
            if trees and sum(sizes.get(t, 0) for t in [*some, trees[0]]) <= MAX_NODES:
                continue
            cuts: dict = {}
            for r in model.upper.where(F.col("tree").isin(some)).toLocalIterator():
                mine = cuts.setdefault(tuple(r[k] for k in keys), {}).setdefault(r["tree"], {})
                mine[r["node"]] = (r["feature"], r["threshold"], r["left"], r["right"])
            for r in cut.collect():
                cuts.setdefault(tuple(r), {})
            shared = df.sparkSession.sparkContext.broadcast(cuts)
            long = materialize(routed.mapInArrow(lambda it, s=shared, t=tuple(some): _routes(s, keys, t, it), schema), "forest-routes")
            shared.destroy()
            parts.append(_meetings(long, model.units.where(F.col("tree").isin(some)), [*keys, "tree", "node"]))
            some = []
    parts = [p.select("_row", "tree", "part") for p in parts]
    found = reduce(DataFrame.union, parts).groupBy("_row").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("tree", "part"))), lambda s: s["part"])).alias("components"))
    mean, sd = ensemble_summary("components")
    out = rows.drop("components", "prediction", "uncertainty").join(found, "_row", "left")
    kept = [c for c in names if c not in ("components", "prediction", "uncertainty")]
    return out.select(*[F.col(c) for c in kept], "components", mean.alias("prediction"), sd.alias("uncertainty"))
