"""Order statistics by selection against numpy, on groups far larger than the sketch, ties and NULLs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mutscope.operators import select_rank as SR
from mutscope.operators import selection as SEL
from mutscope.operators import stats as S

PROBS = {"a": 0.0, "b": 0.2, "c": 0.5, "d": 0.777, "e": 1.0}


def frame(spark, n=60_000):
    """Group "big" far beyond the sketch's accuracy, "ties" with half of the rows alike, small groups, a NULL key."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 < 2, "big").when(F.col("id") % 3000 == 2, None).when(F.col("id") % 300 == 5, "small").otherwise("ties").alias("g"),
        F.when(F.col("id") % 100 != 7, F.exp(F.pmod(F.xxhash64("id"), F.lit(99991)) / 5000.0)).alias("v"),
        F.when(F.col("id") % 2 == 0, 1.5).otherwise((F.col("id") % 1000) / 7.0).alias("w"), "id").repartition(7)


@pytest.mark.parametrize("window", [SR.WINDOW_ROWS, 10])
def test_percentiles_are_exact(spark, window, monkeypatch):
    monkeypatch.setattr(SR, "WINDOW_ROWS", window)
    df = frame(spark)
    rows = df.collect()
    got = {(r.g, r._col): r for r in SR.percentiles_of(df, ["g"], ["v", "w"], PROBS, deviation=True).collect()}
    for g in ("big", "ties", "small", None):
        for c in ("v", "w"):
            x = np.array([r[c] for r in rows if r.g == g and r[c] is not None])
            for name, p in PROBS.items():
                assert got[g, c][name] == pytest.approx(np.percentile(x, 100 * p), rel=1e-12)
            assert got[g, c]._away == pytest.approx(np.abs(x - x.mean()).mean())
    v = np.array([r.v for r in rows if r.v is not None])
    assert S.percentiles(df, None, "v", {"m": 0.5}).first().m == pytest.approx(np.median(v))
    empty = df.where("false")
    assert S.percentiles(empty, ["g"], "v", {"m": 0.5}).collect() == []


def test_no_sort_of_the_rows_in_the_plan(spark):
    """Rows are only aggregated: neither ranges nor sorts stand above the scan of the rows."""
    df = frame(spark)
    q = df.where("v is not null").groupBy("g").agg(F.percentile_approx("v", [0.5], SR.ACCURACY))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    out = S.percentiles(df, ["g"], "v", {"m": 0.5})
    assert "rangepartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_seeded_split_takes_exactly_the_first_hashes(spark):
    df = frame(spark, 40_000).drop("v", "w")
    hashes = {r.id: r.h for r in df.select("id", SEL.seeded_hash(F.lit(9), "id").alias("h")).collect()}
    for fraction in (0.0, 0.2, 1.0):
        got = SEL.seeded_split(df, fraction, 9, ["g"]).collect()
        assert len(got) == 40_000
        for g in ("big", "ties", "small", None):
            mine = sorted((hashes[r.id], r.id, r.split) for r in got if r.g == g)
            cut = int(np.floor(len(mine) * (1 - fraction)))
            assert [s for _, _, s in mine] == ["simulation"] * cut + ["test"] * (len(mine) - cut)


def test_rows_that_share_an_id_share_the_cut(spark):
    df = spark.createDataFrame([("g", 1)] * 30 + [("g", i) for i in range(2, 12)], "g string, id long")
    got = SEL.seeded_split(df, 0.5, 3, ["g"]).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"simulation": 20, "test": 20}
