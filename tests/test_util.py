"""Utilities behind the scale design: size-checked broadcast, materialisation
under spark.checkpoint.dir, engine-independent rounding."""

import duckdb
from pyspark.sql import functions as F

from mutscope import util
from mutscope.catalog.bind_sql import rounded
from mutscope.session import ensure_checkpoint_dir, stage_folder


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bounded_broadcast_respects_limit(spark):
    small = spark.range(10).withColumnRenamed("id", "k")
    big = spark.range(1000).withColumnRenamed("id", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hinted = big.join(util.bounded_broadcast(small), "k")
        assert "BroadcastHashJoin" in _plan(hinted)
        unhinted = big.join(util.bounded_broadcast(small, limit=1), "k")
        assert "BroadcastHashJoin" not in _plan(unhinted)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_materialize_writes_under_checkpoint_dir(spark):
    base = ensure_checkpoint_dir(spark)
    df = util.materialize(spark.range(5).withColumn("x", F.col("id") * 2), "t")
    paths = df.inputFiles()
    assert paths and all(base.rstrip("/").split(":")[-1] in p for p in paths)
    assert sorted(r.x for r in df.collect()) == [0, 2, 4, 6, 8]


def test_rounding_is_identical_in_both_engines(spark):
    vals = [17.5394175, 0.1234565, -2.0000005, 1e20, 3.9999995, 9.3e12, 1e14, -1e14, 9.3e12 + 0.25, 2e15, 1e-8]
    got = [r.v for r in util.finish(spark.createDataFrame([(v,) for v in vals], "v double")).collect()]
    con = duckdb.connect()
    sql = rounded("SELECT * FROM (VALUES " + ", ".join(f"({v!r}::DOUBLE)" for v in vals) + ") t(v)", "v")
    want = [r[0] for r in con.execute(sql).fetchall()]
    assert got == want and got[5:8] == [9.3e12, 1e14, -1e14]
    fine = util.finish(spark.createDataFrame([(1e-8,)], "v double"), digits=12).first().v
    assert fine == 1e-8


def test_checkpoint_folder_without_setting(spark):
    class Other:
        conf = spark.conf

        class sparkContext:
            master, applicationId = "spark://host:7077", "other"

    assert ensure_checkpoint_dir(spark)
    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            ensure_checkpoint_dir(Other)


def test_clear_stages(spark):
    df = util.materialize(spark.range(5), "gone")
    folder = stage_folder(spark)
    assert any(folder.split(":")[-1] in p for p in df.inputFiles())
    assert util.null_safe_join(spark.createDataFrame([(None, 1)], "k string, a int"),
                               spark.createDataFrame([(None, 2)], "k string, b int"), ["k"]).collect()[0].b == 2


def test_attach_group_stats_keyless_is_scalar_subquery(spark):
    df = spark.range(4).withColumn("v", F.col("id") * 1.0)
    tot = df.agg(F.sum("v").alias("total"))
    out = util.attach_group_stats(df, tot, [])
    assert {r.total for r in out.collect()} == {6.0}
    plan = _plan(out)
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
