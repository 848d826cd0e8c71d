"""Property tests: random inputs, Spark result vs brute force."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mutscope.operators import ordered, stats as S
from tests.test_stats import _auc_brute, _bh_brute

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 1)), min_size=2, max_size=40))
def test_auc_property(spark, rows):
    df = spark.createDataFrame([(float(s), l) for s, l in rows], "score double, label int")
    got = S.roc_auc(df, []).first().auc
    want = _auc_brute([float(s) for s, _ in rows], [l for _, l in rows])
    assert (got is None and want is None) or abs(got - want) < 1e-12


@SETTINGS
@given(st.lists(st.integers(1, 50), min_size=1, max_size=40))
def test_bh_property(spark, ps):
    vals = [p / 50.0 for p in ps]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, p double")
    got = {r.id: r.q for r in S.bh_fdr(df, [], "p").collect()}
    want = _bh_brute(vals)
    assert all(abs(got[i] - want[i]) < 1e-12 for i in range(len(vals)))


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 200)), min_size=1, max_size=120))
def test_bucketed_scan_property(spark, rows):
    df = (spark.createDataFrame([(k, float(v)) for k, v in rows], "k string, v double")
          .groupBy("k", "v").agg(F.count(F.lit(1)).alias("c")))
    got = {(r.k, r.v): r.cum for r in ordered.ordered_scan(
        df, ["k"], F.col("v"), {"cum": ("sum", "c")}).collect()}
    want = {}
    for k in "ab":
        run = 0
        for v in sorted({float(v) for kk, v in rows if kk == k}):
            run += sum(1 for kk, vv in rows if kk == k and float(vv) == v)
            want[(k, v)] = run
    assert got == want
