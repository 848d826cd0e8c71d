"""Expressions (HGVS, CDF), interval merge, batch selection, window pooling,
models — hand-made fixtures and brute-force references."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from mutscope.functions import expr as E
from mutscope.functions import labels as L
from mutscope.operators import domains as D
from mutscope.operators import features as FT
from mutscope.operators import models as M
from mutscope.operators import selection as SEL


def test_hgvs_parsing(spark):
    cases = {"MAGOHB:p.Leu9Gln": "L9Q", "X:p.Leu9Ter": None, "X:p.Leu9=": None, "_wt": None,
             "X:p.Xaa4Gly": None, "G:p.Trp0120Cys": "W120C"}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    got = {r.h: r.v for r in df.select("h", E.hgvs_to_variant_id("h").alias("v")).collect()}
    assert got == cases


def test_norm_cdf_accuracy(spark):
    xs = [-40.0, -8.0, -7.07, -3.3, -1.0, 0.0, 0.4, 1.96, 7.1, 12.0, 39.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", E.norm_cdf("x").alias("c"), E.norm_pdf("x").alias("p")).collect():
        assert abs(r.c - 0.5 * math.erfc(-r.x / math.sqrt(2))) < 1e-14
        assert r.p == pytest.approx(math.exp(-r.x * r.x / 2) / math.sqrt(2 * math.pi))


def test_first_difference_and_substitution(spark):
    df = spark.createDataFrame([("ACDE", "ACFE"), ("AC", "AC"), ("", "A")], "a string, b string")
    got = [r.f for r in df.select(E.first_difference("a", "b").alias("f")).collect()]
    assert got == [3, None, None]
    assert df.select(E.apply_substitution("a", F.lit(2), F.lit("W")).alias("s")).first().s == "AWDE"


def _merge_brute(intervals, gap):
    merged = []
    for s, e in sorted(intervals):
        if merged and s <= merged[-1][1] + gap:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return sorted(tuple(x) for x in merged)


@pytest.mark.parametrize("gap", [1, 5])
def test_merge_intervals(spark, gap):
    iv = [(1, 3), (2, 6), (8, 10), (12, 13), (30, 31), (15, 20), (21, 22), (8, 9)]
    df = spark.createDataFrame([("k", s, e) for s, e in iv], "k string, start_pos int, end_pos int")
    got = sorted((r.start_pos, r.end_pos) for r in D.merge_intervals(df, ["k"], gap=gap).collect())
    assert got == _merge_brute(iv, gap)


def _select_brute(acq, pred, a, b):
    ids = sorted(acq)
    top_a = sorted(ids, key=lambda i: (-acq[i], i))[:a]
    top_p = sorted(ids, key=lambda i: (-pred[i], i))[:a + b]
    add = [i for i in top_p if i not in top_a][: a + b - len(top_a)]
    chosen = top_a + add
    return {i: (i in top_a, i in top_p) for i in chosen}


def test_select_batch_overlapping_orders(spark):
    acq = {1: 5.0, 2: 4.0, 3: 4.0, 4: 1.0, 5: 0.5, 6: 3.0}
    pred = {1: 0.9, 2: 0.1, 3: 0.8, 4: 0.95, 5: 0.7, 6: 0.2}
    df = spark.createDataFrame([("g", i, pred[i], acq[i]) for i in acq],
                               "g string, id int, score double, acquisition_score double")
    got = {r.id: (r.top_acquisition_score, r.top_prediction)
           for r in SEL.select_batch(df, 2, 2, ["g"]).collect()}
    assert got == _select_brute(acq, pred, 2, 2)


def test_seeded_split_is_exact_and_reproducible(spark):
    df = spark.createDataFrame([("g", i) for i in range(37)] + [("h", i) for i in range(5)], "g string, id int")
    a = {(r.g, r.id): r.split for r in SEL.seeded_split(df, 0.2, 42, ["g"]).collect()}
    b = {(r.g, r.id): r.split for r in SEL.seeded_split(df.repartition(7), 0.2, 42, ["g"]).collect()}
    assert a == b
    assert sum(1 for (g, _), s in a.items() if g == "g" and s == "simulation") == math.floor(37 * 0.8)
    assert sum(1 for (g, _), s in a.items() if g == "h" and s == "simulation") == 4


def _pool_brute(tokens, S, f, how):
    L_, dim = tokens.shape
    w = max(1, L_ // S)
    stride = max(1, w - int(w * f))
    out = []
    for s in range(S):
        st, en = s * stride, min(s * stride + w, L_)
        seg = tokens[st:en]
        if len(seg) == 0:
            out.extend([0.0] * dim if how == "mean" else [FT.EMPTY_MAX] * dim)
        else:
            out.extend(seg.mean(axis=0) if how == "mean" else seg.max(axis=0))
    return out


@pytest.mark.parametrize("length", [1, 7, 16])
@pytest.mark.parametrize("overlap", [0.0, 0.5])
@pytest.mark.parametrize("how", ["mean", "max"])
def test_window_pooling(spark, length, overlap, how):
    rng = np.random.default_rng(length)
    tok = rng.normal(size=(length, 3))
    rows = [(1, p, d, float(tok[p, d])) for p in range(length) for d in range(3)]
    df = FT.tokens_from_long(spark.createDataFrame(rows, "seq_id long, pos int, dim int, value double"))
    got = FT.pool_windows(df, 8, overlap, how).first().vector
    assert got == pytest.approx(_pool_brute(tok, 8, overlap, how))


def _pool_fixed_brute(tokens, S, f):
    L_, dim = tokens.shape
    w = max(1, L_ // S)
    stride = max(1, w - int(w * f))
    out = []
    for s in range(S):
        st, en = s * stride, s * stride + w
        if en > L_:
            en = L_
            st = max(0, en - w)
        out.extend(tokens[st:en].mean(axis=0))
    return out


@pytest.mark.parametrize("length", [1, 7, 16, 23])
@pytest.mark.parametrize("overlap", [0.0, 0.5])
def test_window_pooling_fixed(spark, length, overlap):
    rng = np.random.default_rng(length + 100)
    tok = rng.normal(size=(length, 2))
    rows = [(1, p, d, float(tok[p, d])) for p in range(length) for d in range(2)]
    df = FT.tokens_from_long(spark.createDataFrame(rows, "seq_id long, pos int, dim int, value double"))
    got = FT.pool_windows_fixed(df, 8, overlap, "mean").first().vector
    assert got == pytest.approx(_pool_fixed_brute(tok, 8, overlap))


def test_forest_components_mean_equals_ensemble(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist(), float(rng.normal())) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y double")
    model = M.fit_forest(df, "x", "y", num_trees=5, max_depth=4)
    pred = M.predict_forest(model, df, "x")
    ens = model.transform(df.select("id", array_to_vector("x").alias("_f")))
    e = {r.id: r.prediction for r in ens.collect()}
    for r in pred.collect():
        assert r.prediction == pytest.approx(e[r.id])
        assert r.uncertainty == pytest.approx(float(np.std(r.components)))


def test_group_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(2)
    rows = []
    for g in range(3):
        for i in range(40):
            x = rng.normal(size=2)
            rows.append((g, x.tolist(), float(x @ [1.5, -2.0] + g + rng.normal() * 0.1)))
    df = spark.createDataFrame(rows, "g int, x array<double>, y double").repartition(5)
    coefs = {r.g: r.coef for r in M.group_ridge(df, ["g"], "x", "y", alpha=0.7).collect()}
    for g in range(3):
        X = np.array([[1.0, *r[1]] for r in rows if r[0] == g])
        y = np.array([r[2] for r in rows if r[0] == g])
        pen = np.eye(3) * 0.7
        pen[0, 0] = 0
        want = np.linalg.solve(X.T @ X + pen, X.T @ y)
        assert coefs[g] == pytest.approx(want.tolist())


def test_label_by_fdr_runs_and_labels_extremes(spark):
    vals = [1.0] * 200 + [4.0, 4.2, 0.1, 0.12]
    df = spark.createDataFrame([("d", i, v) for i, v in enumerate(vals)], "ds string, id int, v double")
    got = {r.id: r.label for r in L.label_by_fdr(df, ["ds"], "v").collect()}
    assert got.get(200) == 1 and got.get(201) == 1
    assert got.get(202) == 0 and got.get(203) == 0


def test_label_strategy_registry():
    with pytest.raises(KeyError):
        L.label_strategy("nope")
    with pytest.raises(KeyError):
        SEL.acquisition("nope")
