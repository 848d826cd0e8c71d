"""Ridges of all groups and members from one read, against closed forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mutscope.operators import ridge as R
from mutscope.operators.forest import poisson_weights


def closed_form(x, y, w, alpha):
    z = np.column_stack((np.ones(len(x)), x))
    penalty = np.eye(z.shape[1]) * alpha
    penalty[0, 0] = 0
    return np.linalg.solve((z.T * w) @ z + penalty, (z.T * w) @ y)


def test_every_group_and_member_in_one_read(spark):
    rng = np.random.default_rng(3)
    rows = [(g, i, rng.normal(size=4).tolist(), float(rng.normal())) for g in ("a", "b", None) for i in range(50)]
    rows += [("a", 1000, None, 1.0), ("b", 1001, [1.0] * 4, None)]
    df = spark.createDataFrame(rows, "g string, id long, v array<double>, y double").repartition(6)
    weights = poisson_weights(7, F.lit(5), F.concat_ws("|", "g", "id"))
    coefs = R.fit_ridges(df, ["g"], "v", "y", weights, alpha=0.8)
    got = {(r.g, r.member): r.coef for r in coefs.collect()}
    drawn = {(r.g, r.id): r.w for r in df.select("g", "id", weights.alias("w")).collect()}
    out = {(r.g, r.id): r for r in R.predict_ridges(df, coefs, ["g"], "v").collect()}
    assert len(got) == 21
    for g in ("a", "b", None):
        mine = [r for r in rows if r[0] == g and r[2] is not None and r[3] is not None]
        x, y, w = np.array([r[2] for r in mine]), np.array([r[3] for r in mine]), np.array([drawn[g, r[1]] for r in mine], float)
        want = [closed_form(x, y, w[:, m], 0.8) for m in range(7)]
        for m in range(7):
            assert got[g, m] == pytest.approx(want[m].tolist(), abs=1e-10)
        for r in mine:
            parts = [c[0] + c[1:] @ r[2] for c in want]
            assert out[g, r[1]].components == pytest.approx(parts) and out[g, r[1]].prediction == pytest.approx(np.mean(parts))
            assert out[g, r[1]].uncertainty == pytest.approx(np.std(parts))


@pytest.mark.parametrize("p", [3, 254, 255, 600])
def test_tiles_solve_like_the_whole_matrix(p):
    """Over tile edges, directly and by conjugate gradients, tiles in any order."""
    rng = np.random.default_rng(p)
    n = 2 * p + 5
    x, y, w = rng.normal(size=(n, p)) * rng.uniform(0.1, 10, p) + 3, rng.normal(size=n), rng.poisson(1, n).astype(float)
    z = np.column_stack((x, np.ones(n), y))
    sums = (z.T * w) @ z
    tiles = R.Tiles(p + 2)
    for i in range(0, p + 2, R.TILE):
        for j in range(i, p + 2, R.TILE):
            tiles.put(i // R.TILE, j // R.TILE, sums[i:i + R.TILE, j:j + R.TILE].tobytes())
    v = rng.normal(size=p + 2)
    assert tiles.times(v) == pytest.approx(sums @ v) and (tiles.diagonal() == np.diag(sums)).all()
    want = closed_form(x, y, w, 2.0)
    assert R.solve_ridge(tiles, 2.0) == pytest.approx(want, abs=1e-8)
    assert R.solve_ridge(tiles, 2.0, direct=0) == pytest.approx(want, abs=1e-7)


def test_sums_handed_on_early_are_the_same(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=(90, 300)), rng.normal(size=90), rng.poisson(1, (90, 3)).astype(float)
    lists = lambda m: pa.array(m.tolist(), pa.list_(pa.float64()))
    g = pa.array([i % 2 for i in range(90)], pa.int32())
    whole = pa.RecordBatch.from_arrays([g, lists(x), pa.array(y), lists(w)], names=["g", "x", "y", "w"])
    batches = [whole.slice(i, 10) for i in range(0, 90, 10)]
    schema = {"g": pa.field("g", pa.int32())}

    def collected():
        got = {}
        for b in R._tiles(["g"], schema, iter(batches)):
            for r in b.to_pylist():
                key = (r["g"], r["member"], r["i"], r["j"])
                got.setdefault(key, []).append(np.frombuffer(r["tile"]))
        return got

    once = collected()
    monkeypatch.setattr(R, "HELD_BYTES", 1)
    monkeypatch.setattr(R, "ROWS_BYTES", 1)
    often = collected()
    assert set(once) == set(often) and max(map(len, once.values())) == 1 and max(map(len, often.values())) > 1
    for k in once:
        assert sum(often[k]) == pytest.approx(once[k][0], abs=1e-9)


def test_wide_features_over_spark(spark):
    """1,300 features: several tiles, conjugate gradients, no row of d² numbers."""
    rng = np.random.default_rng(2)
    n, p = 60, 1300
    x, y = rng.normal(size=(n, p)), rng.normal(size=n)
    df = spark.createDataFrame([(1, x[i].tolist(), float(y[i])) for i in range(n)], "g int, v array<double>, y double")
    coef = np.array(R.fit_ridges(df, ["g"], "v", "y", F.array(F.lit(1)), alpha=5.0).first().coef)
    xm = x - x.mean(axis=0)                                       # fewer rows than features: the dual form
    dual = np.linalg.solve(xm @ xm.T + 5.0 * np.eye(n), y - y.mean())
    assert coef[1:] == pytest.approx(xm.T @ dual, abs=1e-8)


def test_empty_table_and_members_without_rows(spark):
    df = spark.createDataFrame([], "g int, v array<double>, y double")
    assert R.fit_ridges(df, ["g"], "v", "y", F.array(F.lit(1))).collect() == []
    one = spark.createDataFrame([(1, [2.0], 3.0)], "g int, v array<double>, y double")
    got = {r.member: r.coef for r in R.fit_ridges(one, ["g"], "v", "y", F.array(F.lit(0), F.lit(2))).collect()}
    assert got[0] == [0.0, 0.0] and got[1] == pytest.approx([3.0, 0.0])
