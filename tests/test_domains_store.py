"""Interval join on dyadic blocks; replacing and re-writing stored tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mutscope.catalog.sources_q import stored_log
from mutscope.operators import domains as D
from mutscope.operators.runlog import RunLog
from mutscope.sources.runlog_store import RunLogStore


def test_blocks_cover_each_interval_once(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(a), int(a + n)) for i, (a, n) in enumerate(zip(rng.integers(-50, 200, 80), rng.integers(0, 70, 80)))]
    df = spark.createDataFrame(rows, "id int, start_pos int, end_pos int")
    covered = {}
    for r in D.dyadic_blocks(df, 7).collect():
        covered.setdefault(r.id, []).extend(range(r._block << r._level, (r._block + 1) << r._level))
    for i, a, b in rows:
        assert sorted(covered[i]) == list(range(a, b + 1))


@pytest.mark.parametrize("few", [D.FEW_DOMAINS, 0])
def test_interval_join_equals_brute_force(spark, few, monkeypatch):
    monkeypatch.setattr(D, "FEW_DOMAINS", few)
    rng = np.random.default_rng(1)
    doms = [(f"d{i % 3}" if i % 11 else None, f"n{i}", int(a), int(a + n)) for i, (a, n) in enumerate(
        zip(rng.integers(0, 300, 40), rng.integers(0, 90, 40)))] + [("d1", "backwards", 9, 3), ("d1", "point", 5, 5)]
    rows = [(f"d{i % 4}" if i % 13 else None, i, int(p)) for i, p in enumerate(rng.integers(-5, 400, 500))] + [("d1", 900, None)]
    df = spark.createDataFrame(rows, "dataset_name string, id int, position int")
    dom = spark.createDataFrame(doms, "dataset_name string, domain string, start_pos int, end_pos int")
    out = D.join_domains(df, dom)
    assert out.columns == ["dataset_name", "id", "position", "domain", "start_pos", "end_pos"]
    want = sorted((i, n) for k, i, p in rows for d, n, a, b in doms if k is not None and k == d and p is not None and a <= p <= b)
    assert sorted((r.id, r.domain) for r in out.collect()) == want
    none = D.join_domains(df, dom.where("false"))
    assert none.count() == 0


def test_many_domains_of_one_dataset(spark):
    """100,000 domains: an equi join without a range condition over the dataset's whole product."""
    dom = spark.range(100_000).select(F.lit("x").alias("dataset_name"), F.col("id").alias("domain"), (F.col("id") * 3).alias("start_pos"),
                                      (F.col("id") * 3 + F.col("id") % 40).alias("end_pos"))
    df = spark.range(2000).select(F.lit("x").alias("dataset_name"), "id", (F.col("id") * 149).alias("position"))
    out = D.join_domains(df, dom)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and ">= start_pos" not in plan
    got = {}
    for r in out.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("domain").alias("s")).collect():
        got[r.id] = (r.n, r.s)
    start = 3 * np.arange(100_000)
    end = start + np.arange(100_000) % 40
    for i in range(2000):
        hit = np.flatnonzero((start <= i * 149) & (i * 149 <= end))
        assert got.get(i, (0, None)) == (len(hit), int(hit.sum()) if len(hit) else None)


def rows(store, name="round"):
    return sorted(tuple(r) for r in store.read(name).select("run_id", "v").collect())


def test_a_failed_replacement_keeps_the_table(spark, tmp_path):
    store = RunLogStore(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([(1, "x"), (2, "y")], "run_id int, v string")
    store.append("round", df, "a")
    broken = df.withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        store.replace("round", broken)
    assert rows(store) == [(1, "x"), (2, "y")]
    # from the table's own content, twice
    for _ in range(2):
        store.replace("round", store.read("round").withColumn("v", F.concat("v", F.lit("+"))))
    assert rows(store) == [(1, "x++"), (2, "y++")]


def test_a_replacement_that_broke_between_its_renames(spark, tmp_path):
    store = RunLogStore(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([(1, "x")], "run_id int, v string")
    store.append("round", df, "a")
    store._rename(store.path("round"), store.path("round") + ".old")
    assert rows(store) == [(1, "x")]
    store.replace("round", df.withColumn("v", F.lit("z")))
    assert rows(store) == [(1, "z")]


def test_a_batch_written_again_must_cover_its_runs(spark, tmp_path):
    store = RunLogStore(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([(1, "x"), (2, "y")], "run_id int, v string")
    store.append("round", df, "a")
    store.append("round", df.where("run_id = 2").withColumn("v", F.lit("other")), "b")
    with pytest.raises(ValueError, match="leave out"):
        store.append("round", df.where("run_id = 2"), "a")
    store.append("round", df.withColumn("v", F.lit("new")), "a")
    assert rows(store) == [(1, "new"), (2, "new"), (2, "other")]


def test_top_variants_and_rounds_of_a_stored_log_are_computed_once(spark):
    seen = {n: spark.sparkContext.accumulator(0) for n in ("round", "top")}

    def counted(name):
        def f(v):
            seen[name].add(1)
            return v
        return F.udf(f, "long").asNondeterministic()

    frame = spark.createDataFrame
    scores = "variant_id string, assay_score double"
    rounds = frame([(r, r // 10, r) for r in range(50)], "round_id long, simulation_id long, n long")
    variants = frame([(i % 50, str(i), i / 2) for i in range(200)], f"round_id long, {scores}")
    log = RunLog(run=frame([(r, "a") for r in range(5)], "run_id long, name string"),
                 sub_run=frame([(r, r if r != 1 else None) for r in range(5)], "sub_run_id long, run_id long"),
                 simulation=frame([(r, r) for r in range(5)], "simulation_id long, sub_run_id long"),
                 round=rounds.withColumn("n", counted("round")("n")),
                 top_variant=variants.withColumn("m", counted("top")("round_id")), acquired_variant=variants,
                 last_round_score=frame([(r, "v", 1.0) for r in range(5)], f"simulation_id long, {scores}"))
    store = stored_log(spark, log)
    assert {n: a.value for n, a in seen.items()} == {"round": 50, "top": 200}
    runs = {s: s for s in range(5)} | {1: None}
    assert sorted((r["run_id"], r["variant_id"]) for r in store.read("round_top_variant").collect()) == sorted(
        (runs[i % 50 // 10], str(i)) for i in range(200) if i % 50 // 10 != 1)       # a batch of the log names runs
    assert {(r["run_id"], r["variant_id"]) for r in store.read("round_acquired_variant").collect()} == {
        (runs[i % 50 // 10], str(i)) for i in range(200)}
