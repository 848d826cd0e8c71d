"""Hand-made fixtures for the numeric core (ties, single class, one row, BH ties)
and the skew path of the ordered scan checked against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mutscope.operators import ordered, stats as S


def _auc_brute(scores, labels):
    pos = [s for s, l in zip(scores, labels) if l == 1]
    neg = [s for s, l in zip(scores, labels) if l == 0]
    if not pos or not neg:
        return None
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_with_ties_and_single_class(spark):
    rows = [("a", 1.0, 0), ("a", 2.0, 1), ("a", 2.0, 0), ("a", 5.0, 1),
            ("b", 3.0, 1), ("b", 4.0, 1)]  # group b has one class only
    df = spark.createDataFrame(rows, "g string, score double, label int")
    out = {r.g: r for r in S.roc_auc(df, ["g"]).collect()}
    assert out["a"].auc == pytest.approx(_auc_brute([1, 2, 2, 5], [0, 1, 0, 1]))
    assert out["b"].auc is None
    assert (out["a"].n_pos, out["a"].n_neg) == (2, 2)


def test_average_ranks_ties(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 5.0)], "id int, v double")
    got = {r.id: r.avg_rank for r in S.average_ranks(df, [], "v").collect()}
    assert got == {1: 1.0, 2: 2.5, 3: 2.5, 4: 4.0}


def test_spearman_constant_is_null(spark):
    df = spark.createDataFrame([("g", 1.0, 0.0), ("g", 2.0, 0.0), ("g", 3.0, 0.0)], "k string, x double, y double")
    assert S.spearman(df, ["k"], "x", "y").first().spearman is None


def test_one_row_stddev_is_null(spark):
    df = spark.createDataFrame([("s", 1.0)], "k string, v double")
    assert df.groupBy("k").agg(F.stddev_samp("v").alias("s")).first().s is None


def _bh_brute(ps):
    m = len(ps)
    order = sorted(range(m), key=lambda i: ps[i])
    q = [0.0] * m
    prev = 1.0
    for rank in range(m, 0, -1):
        i = order[rank - 1]
        prev = min(prev, ps[i] * m / rank)
        q[i] = prev
    # ties share the value of the largest rank in their group
    out = {}
    for i in range(m):
        out.setdefault(ps[i], []).append(q[i])
    return [min(out[p]) for p in ps]


def test_bh_with_ties(spark):
    ps = [0.01, 0.04, 0.04, 0.03, 0.5, 0.5, 0.2, 0.001]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "id int, p double")
    got = {r.id: r.q for r in S.bh_fdr(df, [], "p").collect()}
    want = _bh_brute(ps)
    for i in range(len(ps)):
        assert got[i] == pytest.approx(want[i])


def test_percentiles_match_numpy(spark):
    rnd = random.Random(3)
    vals = [rnd.randint(0, 20) * 1.0 for _ in range(101)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = S.percentiles(df, [], "v", {"p10": 0.1, "p50": 0.5, "p80": 0.8}).first()
    for name, p in (("p10", 10), ("p50", 50), ("p80", 80)):
        assert getattr(got, name) == pytest.approx(np.percentile(vals, p))


@pytest.fixture
def many_ranges(spark):
    """Keep small ranges apart, so that groups go on from range to range."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, old)


def test_ordered_scan_over_several_ranges_matches_brute_force(spark, many_ranges):
    """A group in all ranges, small ones, and NULL keys."""
    rnd = random.Random(7)
    rows = [("hot", float(rnd.randint(0, 500)), rnd.randint(1, 3)) for _ in range(3000)]
    rows += [("cold", float(i), 1) for i in range(20)] + [(None, float(i), 2) for i in range(400)] + [(None, None, 7)]
    df = spark.createDataFrame(rows, "k string, v double, c int").groupBy("k", "v").agg(F.sum("c").alias("c"))
    got = ordered.ordered_scan(df, ["k"], F.col("v"), {"cum": ("sum", "c"), "mx": ("max", "c")})
    got = {(r.k, r.v): (r.cum, r.mx) for r in got.collect()}
    want = {}
    for k in ("hot", "cold", None):
        pts = sorted(((v, c) for (kk, v), c in ((key, val) for key, val in
                      {(r.k, r.v): r.c for r in df.collect()}.items()) if kk == k),
                     key=lambda p: (p[0] is not None, p))
        run, mx = 0, None
        for v, c in pts:
            run += c
            mx = c if mx is None else max(mx, c)
            want[(k, v)] = (run, mx)
    assert got == want


def test_null_keys_keep_their_rows(spark, many_ranges):
    rows = [(None if i % 2 else "a", float(i % 40), i % 2 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v double, label boolean")
    assert S.average_ranks(df, ["k"], "v").filter("avg_rank is not null").count() == 400
    assert S.standardise(df, ["v"], ["k"]).count() == 400
    assert S.bh_fdr(df.withColumn("p", F.col("v") / 40), ["k"]).filter("q is not null").count() == 400
    assert {r.k for r in S.percentiles(df, ["k"], "v", {"m": 0.5}).collect()} == {None, "a"}


def test_regression_metrics_of_null_values_and_empty_splits(spark):
    rows = [("g", "train", 1.0, 2.0), ("g", "train", 2.0, 2.5), ("g", "train", 3.0, 5.0), ("g", "train", 9.0, None)]
    df = spark.createDataFrame(rows, "k string, split string, prediction double, assay_score double")
    got = {r.split: r for r in S.regression_metrics(df, ["k"], splits=("train", "test")).collect()}
    p, a = np.array([1.0, 2.0, 3.0]), np.array([2.0, 2.5, 5.0])
    assert got["train"].r2 == pytest.approx(1 - ((p - a) ** 2).sum() / ((a - a.mean()) ** 2).sum())
    assert got["train"].spearman == pytest.approx(1.0)
    assert (got["test"].rmse, got["test"].r2, got["test"].spearman) == (None, None, None)


def test_ordered_scan_exclusive(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 7), (3.0, 1)], "v double, c int")
    got = sorted((r.v, r.prev) for r in ordered.ordered_scan(df, [], F.col("v"), {"prev": ("max", "c")},
                                                             inclusive=False).collect())
    assert got == [(1.0, None), (2.0, 5), (3.0, 7)]


def test_roc_curve_and_youden(spark):
    rows = [(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1), (0.2, 0), (0.1, 0)]
    df = spark.createDataFrame(rows, "score double, label int")
    curve = S.roc_curve(df, [])
    pts = sorted(((r.fpr, r.tpr) for r in curve.collect()))
    assert pts[0] == (0.0, 0.0) and pts[-1] == (1.0, 1.0)
    best = S.youden_point(curve, []).first()
    assert best.threshold == 0.6 and best.youden == pytest.approx(2 / 3)


def _tied_rows():
    """Splits with ties on both sides, heavy values, a NULL key and split, NULL values, a constant and a single row."""
    rnd = random.Random(3)
    rows = [(k, s, float(rnd.choice([0, 0, 0, 1, 2, rnd.randint(0, 50)])), float(rnd.choice([5, 5, 7, rnd.randint(0, 9)])))
            for k in ("g", None) for s in ("train", "validation", "test", None) for _ in range(150)]
    rows += [("c", "train", float(i), 0.1) for i in range(30)] + [("c", "test", 1.0, float(i)) for i in range(30)]
    return rows + [("one", "validation", 1.0, 2.0), ("g", "train", None, 1.0), ("g", "test", 1.0, None), ("none", "test", None, 1.0)]


def _average_rank(v):
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def _metrics_brute(rows):
    groups = {}
    for k, s, p, a in rows:
        if p is not None and a is not None:
            for name in [s] + ["train_validation"] * (s in ("train", "validation")):
                groups.setdefault((k, name), []).append((p, a))
    out = {}
    for g, v in groups.items():
        p, a = np.array(v).T
        dp, da = (_average_rank(x) - (len(x) + 1) / 2 for x in (p, a))
        spread = math.sqrt((dp * dp).sum()) * math.sqrt((da * da).sum())
        out[g] = (math.sqrt(((p - a) ** 2).mean()), None if a.min() == a.max() else 1 - ((p - a) ** 2).sum() / ((a - a.mean()) ** 2).sum(),
                  (dp * da).sum() / spread if spread else None)
    return out


@pytest.mark.parametrize("limit", [0, 1 << 18])
@pytest.mark.parametrize("swapped", [False, True])
def test_regression_metrics_by_windows_and_by_scans(spark, monkeypatch, limit, swapped):
    monkeypatch.setattr(S, "GROUP_ROWS", limit)
    rows = [(k, s, a, p) if swapped else (k, s, p, a) for k, s, p, a in _tied_rows()]
    df = spark.createDataFrame(rows, "k string, split string, prediction double, assay_score double")
    found = S.regression_metrics(df, ["k"]).collect()
    got, want = {(r.k, r.split): (r.rmse, r.r2, r.spearman) for r in found}, _metrics_brute(rows)
    assert len(found) == len(want) and set(got) == set(want)
    for g, values in want.items():
        assert [v is None for v in got[g]] == [v is None for v in values], g
        assert [v for v in got[g] if v is not None] == pytest.approx([v for v in values if v is not None]), g


@pytest.mark.parametrize("limit", [0, 1 << 18])
def test_spearman_without_keys(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "GROUP_ROWS", limit)
    rows = [(p, a) for _, _, p, a in _tied_rows()]
    df = spark.createDataFrame(rows, "x double, y double")
    v = np.array([r for r in rows if None not in r]).T
    assert S.spearman(df, [], "x", "y").first().spearman == pytest.approx(np.corrcoef(*map(_average_rank, v))[0, 1])


def test_regression_metrics_exchange_rows_few_times(spark, monkeypatch):
    """Large groups: rows of a column with few values are exchanged once, summed by the other column's value."""
    monkeypatch.setattr(S, "GROUP_ROWS", 0)
    written = {}
    original = S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, tag="stage": written.setdefault(tag, original(df, tag)))
    df = spark.range(4000).select(F.lit("g").alias("k"), F.lit("train").alias("split"), F.col("id").cast("double").alias("prediction"),
                                  (F.col("id") % 5).cast("double").alias("assay_score"))
    assert S.regression_metrics(df, ["k"]).count() == 2
    assert written["rows"].count() == 4000 and written["counts"].count() == 10      # not a line a pair and pooled split


def test_regression_metrics_against_numpy(spark):
    rnd = random.Random(1)
    rows = [("g", "train" if i % 3 else "test", rnd.random(), rnd.random()) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, split string, prediction double, assay_score double")
    got = {r.split: r for r in S.regression_metrics(df, ["k"]).collect()}
    tr = [(p, a) for _, s, p, a in rows if s == "train"]
    p, a = np.array([x[0] for x in tr]), np.array([x[1] for x in tr])
    assert got["train"].rmse == pytest.approx(math.sqrt(np.mean((p - a) ** 2)))
    assert got["train"].r2 == pytest.approx(1 - np.sum((p - a) ** 2) / np.sum((a - a.mean()) ** 2))
    rp = np.argsort(np.argsort(p)) + 1.0
    ra = np.argsort(np.argsort(a)) + 1.0
    assert got["train"].spearman == pytest.approx(np.corrcoef(rp, ra)[0, 1])
    assert "train_validation" not in got or got["train_validation"].rmse == pytest.approx(got["train"].rmse)
