"""Forests of all groups in one job against a plain recursive tree."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mutscope.operators import forest as FO


def plain_tree(x, y, w):
    """Recursive best-split tree by trying every threshold; returns a predicting function."""
    keep = w > 0
    x, y, w = x[keep], y[keep], w[keep].astype(float)
    mean = (w * y).sum() / w.sum()
    if y.min() == y.max():
        return lambda r: mean
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values[:-1], values[1:]):
            left = x[:, f] <= a
            lw, lwy, rw, rwy = w[left].sum(), (w * y)[left].sum(), w[~left].sum(), (w * y)[~left].sum()
            gain = lwy * lwy / lw + rwy * rwy / rw
            if best is None or gain > best[0]:
                best = (gain, f, a + (b - a) / 2)
    if best is None:
        return lambda r: mean
    _, f, t = best
    left = x[:, f] <= t
    sides = plain_tree(x[left], y[left], w[left]), plain_tree(x[~left], y[~left], w[~left])
    return lambda r: sides[0](r) if r[f] <= t else sides[1](r)


@pytest.mark.parametrize("seed", range(6))
def test_tree_equals_the_recursive_one(seed):
    """Whole labels, so that all sums are exact and ties fall alike; repeated rows and values."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 90))
    x = rng.integers(0, 8, (n, 3)).astype(float)
    y = rng.integers(0, 4, n).astype(float)
    w = rng.poisson(1, n)
    w[0] = 1
    want = plain_tree(x, y, w)
    at = rng.integers(-1, 9, (50, 3)) + 0.25
    assert FO.predict_tree(FO.grow_tree(x, y, w), at).tolist() == [want(r) for r in at]


def rows_of(rng, groups, n, whole=True):
    out = []
    for g in groups:
        for i in range(n):
            x = rng.integers(0, 12, 3).astype(float)
            out.append((g, f"{g}-{i}", x.tolist(), float((x[0] * x[1]) // 7 + rng.integers(0, 2))))
    return out


def test_all_groups_in_one_job_equal_plain_trees(spark):
    rng = np.random.default_rng(1)
    rows = rows_of(rng, ["a", "b", None], 40) + [("one", "one-0", [1.0, 2.0, 3.0], 5.0), ("a", "no-label", [0.0, 0.0, 0.0], None),
                                                ("b", "no-x", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, id string, x array<double>, y double").repartition(5)
    seed = F.lit(7)
    model = FO.fit_forests(df, ["g"], "x", "y", "id", trees=13, seed=seed)
    out = {r.id: r for r in FO.predict_forests(model, df, "x").collect()}
    weights = {r.id: np.array(r.w) for r in df.select("id", FO.poisson_weights(13, seed, F.col("id")).alias("w")).collect()}
    for g in ("a", "b", None, "one"):
        mine = [r for r in rows if r[0] == g and r[3] is not None and r[2] is not None]
        x, y, w = np.array([r[2] for r in mine]), np.array([r[3] for r in mine]), np.array([weights[r[1]] for r in mine])
        trees = [plain_tree(x, y, w[:, t] if w[:, t].any() else np.ones(len(y))) for t in range(13)]
        for r in mine:
            want = [t(np.array(r[2])) for t in trees]
            assert out[r[1]].components == want
            assert out[r[1]].prediction == pytest.approx(np.mean(want)) and out[r[1]].uncertainty == pytest.approx(np.std(want))
    assert out["no-x"].components is None and out["no-x"].prediction is None and out["no-label"].prediction is not None
    unseen = spark.createDataFrame([("zz", [1.0, 1.0, 1.0])], "g string, x array<double>")
    assert FO.predict_forests(model, unseen, "x").first().components is None


def test_weights_are_poisson_and_follow_the_seed(spark):
    df = spark.range(4000).select("id", FO.poisson_weights(5, F.lit(1), F.col("id")).alias("a"),
                                  FO.poisson_weights(5, F.lit(2), F.col("id")).alias("b"))
    a, b = (np.array([r[c] for r in df.orderBy("id").collect()]) for c in ("a", "b"))
    assert abs(a.mean() - 1) < 0.03 and abs(a.var() - 1) < 0.06 and (a != b).mean() > 0.5
    assert abs((a == 0).mean() - np.exp(-1)) < 0.02


@pytest.mark.parametrize("node_rows", [30, 7])
def test_groups_cut_by_histograms_grow_until_pure(spark, node_rows):
    """Few distinct values, so that the quantiles are exact: the same trees as grown in one task."""
    rng = np.random.default_rng(4)
    rows = rows_of(rng, ["a", "b"], 150) + [("b", f"copy-{i}", [3.0, 3.0, 3.0], float(i % 2)) for i in range(60)] \
        + rows_of(rng, ["small"], 5)
    df = spark.createDataFrame(rows, "g string, id string, x array<double>, y double").repartition(4)
    whole = FO.fit_forests(df, ["g"], "x", "y", "id", trees=4)
    cut = FO.fit_forests(df, ["g"], "x", "y", "id", trees=4, node_rows=node_rows)
    assert whole.upper is None and cut.upper.count() > 8
    a = {r.id: r.components for r in FO.predict_forests(whole, df, "x").collect()}
    b = {r.id: r.components for r in FO.predict_forests(cut, df, "x").collect()}
    assert a == b


def test_nodes_that_quantiles_cannot_cut_get_their_own(spark):
    """One feature, most rows within one bin of the group's quantiles: still grown until pure."""
    rng = np.random.default_rng(9)
    values = np.concatenate([np.linspace(0, 1e-6, 300), np.arange(1, 4001)])
    rows = [(int(i), [float(v)], float(rng.integers(0, 1000))) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y double").withColumn("g", F.lit(1))
    model = FO.fit_forests(df, ["g"], "x", "y", "id", trees=1, node_rows=20)
    drawn = df.where(FO.poisson_weights(1, F.lit(42), F.col("id"))[0] > 0)
    wrong = FO.predict_forests(model, drawn, "x").where("abs(prediction - y) > 1e-9").count()
    assert wrong == 0


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "g string, id string, x array<double>, y double")
    model = FO.fit_forests(df, ["g"], "x", "y", "id", trees=3)
    assert FO.predict_forests(model, df, "x").collect() == []


def _state(rows, width, trees, nodes, seed=5):
    rng = np.random.default_rng(seed)
    lists = lambda v, kind: pa.array(v.tolist(), pa.list_(kind))
    node = rng.integers(0, nodes, (rows, trees))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(rows, np.int32)), lists(rng.normal(size=(rows, width)), pa.float64()), pa.array(rng.integers(0, 9, rows).astype(float)),
         lists(rng.poisson(1, (rows, trees)), pa.int32()), lists(rng.integers(0, FO.BINS, (rows, width)), pa.int32()), lists(node, pa.int64())],
        names=["unit", "x", "y", "w", "bin", "node"])


def test_histograms_of_many_nodes_leave_a_task_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(FO, "HIST_BYTES", 1 << 16)
    width, trees, nodes = 3, 6, 40
    shared = SimpleNamespace(value=({(0, t): np.arange(nodes) for t in range(trees)}, width))
    batch = _state(900, width, trees, nodes)
    found = list(FO._histograms(shared, iter([batch.slice(0, 500), batch.slice(500)])))
    assert max(b.num_rows for b in found) * width * FO.BINS * 40 <= (1 << 16) + width * FO.BINS * 40
    got = [tuple(r.values())[:3] for b in found for r in b.to_pylist()]
    assert len(got) == len(set(got))                   # both batches are added up before a node leaves
    w, node = (np.array(batch.column(c).to_pylist()) for c in ("w", "node"))
    told = {tuple(r.values())[:3]: np.frombuffer(r["hist"]).reshape(5, -1)[2, :FO.BINS].sum() for b in found for r in b.to_pylist()}
    assert told == {(0, t, n): c for t in range(trees) for n in range(nodes) if (c := ((w[:, t] > 0) & (node[:, t] == n)).sum())}


def test_rows_are_routed_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(FO, "ROUTE_ROWS", 50)
    batch = pa.RecordBatch.from_pydict({"_row": list(range(100)), "g": [0] * 100, "x": [[float(i)] for i in range(100)]})
    cuts = {(0,): {t: {0: (0, 10.0 * t, 1, 2)} for t in range(10)}}
    found = list(FO._routes(SimpleNamespace(value=cuts), ["g"], tuple(range(10)), iter([batch])))
    assert max(b.num_rows for b in found) <= 50
    rows = [(r["_row"], r["tree"], r["node"]) for b in found for r in b.to_pylist()]
    assert rows == [(i, t, 1 if i <= 10 * t else 2) for i in range(100) for t in range(10)]
