"""Rows attached to counted values: heavy values and NULLs are spread, results are those of a plain join."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from mutscope.operators import attach as A
from mutscope.operators import stats as S


def frame(spark, n=8000):
    """Half of the rows hold one value, a fifth none."""
    v = F.when(F.col("id") % 10 < 5, 0.25).when(F.col("id") % 10 < 7, None).otherwise((F.col("id") % 701) / 700.0)
    return spark.range(n).select("id", F.when(F.col("id") % 7 == 0, None).otherwise("g").alias("g"), v.alias("p")).repartition(5)


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_attached_as_by_a_plain_join(spark, limit):
    df = frame(spark)
    table = df.where("p is not null").groupBy("g", "p").agg(F.count(F.lit(1)).alias("_cnt"), F.max("id").alias("top"))
    want = {}
    for r in table.collect():
        want[r.g, r.p] = r.top
    got = A.attach_by_value(df, table, ["g"], "p", limit=limit)
    assert got.columns == ["id", "g", "p", "top"]
    rows = got.collect()
    assert len(rows) == 8000 and all(r.top == want.get((r.g, r.p)) for r in rows)
    assert sum(r.p is None for r in rows) == 1600


def test_heavy_values_and_nulls_go_to_many_partitions(spark):
    df = frame(spark)
    table = df.where("p is not null").groupBy("g", "p").agg(F.count(F.lit(1)).alias("_cnt"))
    rows, lines = A.spread(df, table, ["g"], "p", "_cnt")
    sizes = Counter((r.g, r.p, r._salt) for r in rows.collect())
    assert max(sizes.values()) < 8000 / 30                      # of 4,000 rows of one value and 1,600 without one
    repeated = Counter((r.g, r.p) for r in lines.collect())
    assert {k: n for k, n in repeated.items() if n > 1} == {("g", 0.25): A.SALTS, (None, 0.25): A.SALTS}


def test_ranks_and_q_values_with_heavy_ties(spark, monkeypatch):
    df = frame(spark)
    plain = {r.id: r for r in S.bh_fdr(S.average_ranks(df, ["g"], "p"), ["g"], "p").collect()}
    original = A.attach_by_value
    monkeypatch.setattr(S, "attach_by_value", lambda *a, size, **k: original(*a, **k, limit=0))
    spreadout = {r.id: r for r in S.bh_fdr(S.average_ranks(df, ["g"], "p"), ["g"], "p").collect()}
    assert plain == spreadout and all((r.q is None) == (r.p is None) == (r.avg_rank is None) for r in plain.values())
