"""Learner registry with seeds, fitted mixtures as data, principal axes without a d x d matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mutscope.operators import features as FT
from mutscope.operators import learners as LR


def frame(spark, rng, n=30):
    rows = [(g, i, rng.normal(size=3).tolist(), float(rng.integers(0, 9)), float(i)) for g in (1, 2, None) for i in range(n)]
    return spark.createDataFrame(rows, "g int, id long, x array<double>, y double, llr double")


@pytest.mark.parametrize("name,size", [("RandomForestRegression", 4), ("RidgeRegression", 4)])
def test_one_seed_repeats_and_two_differ(spark, name, size):
    df = frame(spark, np.random.default_rng(0))

    def run(simulation, round_num):
        out = LR.train_job(df, df, name, ["g"], "x", "y", "id", F.lit(simulation), F.lit(round_num), n_estimators=size)
        return {(r.g, r.id): r.components for r in out.collect()}

    a = run(1, 2)
    assert len(a) == 90 and all(len(c) == size for c in a.values())
    assert run(1, 2) == a and run(2, 2) != a and run(1, 3) != a


def test_seeds_are_columns_and_groups_stand_alone(spark):
    """All groups with a seed column of their own in one job equal each group alone."""
    df = frame(spark, np.random.default_rng(1)).where("g is not null")
    for name in ("RandomForestRegression", "RidgeRegression"):
        one = {(r.g, r.id): r.components for r in LR.train_job(
            df, df, name, ["g"], "x", "y", "id", F.col("g"), F.lit(5), n_estimators=3).collect()}
        for g in (1, 2):
            part = df.where(F.col("g") == g)
            alone = LR.train_job(part, part, name, ["g"], "x", "y", "id", F.lit(g), F.lit(5), n_estimators=3)
            alone = {r.id: r.components for r in alone.collect()}
            assert len(alone) == 30 and all(alone[i] == pytest.approx(one[g, i]) for i in alone)


def test_scores_without_a_fit_and_unknown_names(spark):
    df = frame(spark, np.random.default_rng(2))
    out = LR.train_job(df, df, "ESM2LogLikelihood", ["g"], "llr", "y", "id", F.lit(1), F.lit(1)).collect()
    assert all(r.prediction == r.llr and r.uncertainty is None and r.components is None for r in out)
    with pytest.raises(KeyError, match="RandomForestRegression"):
        LR.learner("nope")
    with pytest.raises(KeyError):
        LR.train_job(df, df, "nope", ["g"], "x", "y", "id", F.lit(1), F.lit(1))


def plain_fisher(x, w, mu, var):
    d = x[:, None, :] - mu
    lp = np.log(w) - 0.5 * (np.log(2 * np.pi * var) + d * d / var).sum(axis=2)
    g = np.exp(lp - lp.max(axis=1, keepdims=True))
    g /= g.sum(axis=1, keepdims=True)
    one = (g[:, :, None] * d / var).sum(axis=0) / (len(x) * np.sqrt(w)[:, None])
    two = (g[:, :, None] * (d * d / var - 1)).sum(axis=0) / (len(x) * np.sqrt(w)[:, None])
    v = np.concatenate((one.ravel(), two.ravel()))
    v = np.sign(v) * np.sqrt(np.abs(v))
    return v / np.linalg.norm(v)


def test_fisher_vectors_of_a_fitted_stored_mixture(spark, tmp_path):
    """K = 64 components of D = 64 numbers, written as a table and read again; the plan does not grow with them."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 64)) + 4 * rng.integers(-1, 2, (600, 1))
    rows = [(i % 7 if i % 7 else None, i, x[i].tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "seq_id long, pos int, vec array<double>").repartition(5)
    FT.fit_mixture(df, 64, max_iter=3).table(spark).write.parquet(str(tmp_path / "mixture"))
    mix = FT.Mixture.read(spark.read.parquet(str(tmp_path / "mixture")))
    assert mix.means.shape == (64, 64) and mix.weights.sum() == pytest.approx(1)
    encoded = FT.fisher_vectors(df, mix.weights, mix.means, mix.variances)
    small = FT.fisher_vectors(df, [1.0], [[0.0] * 64], [[1.0] * 64])
    plan = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString())
    assert abs(plan(encoded) - plan(small)) < 200
    for r in encoded.collect():
        mine = x[[i for s, i, _ in rows if s == r.seq_id]]
        assert r.fisher_vector == pytest.approx(plain_fisher(mine, mix.weights, mix.means, mix.variances), abs=1e-8)


def test_em_steps_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(-2, 1, (80, 3)), rng.normal(100, 0.5, (50, 3))])
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "seq_id long, pos int, vec array<double>").repartition(3)
    a, b = FT.fit_mixture(df, 3, max_iter=1), FT.fit_mixture(df, 3, max_iter=2, tolerance=-np.inf)
    d = x[:, None, :] - a.means
    lp = np.log(a.weights) - 0.5 * (np.log(2 * np.pi * a.variances) + d * d / a.variances).sum(axis=2)
    g = np.exp(lp - np.logaddexp.reduce(lp, axis=1, keepdims=True))
    assert b.weights == pytest.approx(g.mean(axis=0))
    mu = g.T @ x / g.sum(axis=0)[:, None]
    assert b.means == pytest.approx(mu)
    assert b.variances == pytest.approx(np.maximum(g.T @ (x * x) / g.sum(axis=0)[:, None] - mu * mu, 1e-6), rel=1e-6)


@pytest.mark.parametrize("spread", [0.8, 0.97])
def test_randomised_axes_span_the_exact_subspace(spark, spread):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 64)) * spread ** np.arange(64) * 3 + rng.normal(size=64)
    x = x @ np.linalg.qr(rng.normal(size=(64, 64)))[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id int, v array<double>").repartition(4)
    fit = FT.fit_wide_pca(df, "v", 8, max_passes=60, tolerance=1e-12)
    centred = x - x.mean(axis=0)
    _, s, axes = np.linalg.svd(centred, full_matrices=False)
    cosines = np.linalg.svd(fit.axes.T @ axes[:8].T)[1]
    assert fit.axes.T @ fit.axes == pytest.approx(np.eye(8), abs=1e-10)
    assert cosines.min() > 1 - 1e-5 and fit.variance == pytest.approx(s[:8] ** 2 / 499, rel=1e-4)
    got = {r.id: r.pca for r in fit.transform(df).collect()}
    assert got[999] is None
    # the reconstruction error is that of the exact axes
    p = np.array([got[i] for i in range(500)])
    assert (centred ** 2).sum() - (p ** 2).sum() == pytest.approx((s[8:] ** 2).sum(), rel=1e-4)


def test_wide_vectors_go_by_the_range_finder(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 1500)) + 0.001 * rng.normal(size=(40, 1500))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    fit = FT.fit_pca(df, "v", 3)
    assert isinstance(fit, FT.WidePca) and fit.axes.shape == (1500, 3)
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    assert fit.variance == pytest.approx(s[:3] ** 2 / 39, rel=1e-6)
