"""Stored run metrics: appended batches equal a full rebuild, without the detail rows of earlier batches."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from mutscope.operators import runlog as R
from mutscope.plans import metrics_store as MS
from mutscope.sources.runlog_store import RunLogStore
from tests.conftest import SF001


@pytest.fixture(scope="module")
def log(spark):
    log = R.RunLog.bound(spark, SF001)
    runs = R.latest_completed_runs(log.run)
    return replace(log, run=runs, sub_run=log.sub_run.join(runs.select("run_id"), "run_id", "left_semi"))


def lines(df):
    return sorted(({k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in df.collect()),
                  key=lambda r: (r["end_round_num"], r["run_id"], r["sub_run_id"]))


def test_batches_equal_a_full_rebuild(spark, log, tmp_path):
    once = RunLogStore(spark, str(tmp_path / "once"))
    MS.append_batch(once, log, "all", at_rounds=(1, 2))
    whole = lines(once.read("run_metrics"))
    assert len(whole) > 4 and {"data_loader_type", "random_seed", "strategy_parameters"} <= set(whole[0])
    twice = RunLogStore(spark, str(tmp_path / "twice"))
    part = F.pmod(F.xxhash64("round_id", "variant_id"), F.lit(2))
    for i in (0, 1):
        MS.append_batch(twice, replace(log, top_variant=log.top_variant.where(part == i)), f"b{i}", at_rounds=(1, 2))
    assert lines(twice.read("run_metrics")) == whole
    # a batch given again replaces its own lines
    MS.append_batch(twice, replace(log, top_variant=log.top_variant.where(part == 1)), "b1", at_rounds=(1, 2))
    assert lines(twice.read("run_metrics")) == whole


def test_measures_and_deviation_against_numpy(spark, log):
    perf = {(r.run_id, r.sub_run_id, r.round_num): r for r in MS.performance(MS.merged_rounds(MS.round_moments(log)), (1, 2)).collect()}
    plain = {(r.run_id, r.sub_run_id, r.round_num): r for r in R.run_performance(log, log.run, (1, 2), by_sub_run=True).collect()}
    assert set(perf) == set(plain)
    for k, r in plain.items():
        for m, _, _ in R.LEADERBOARD:
            assert (perf[k][m] is None) == (r[m] is None) and (r[m] is None or perf[k][m] == pytest.approx(r[m]))
    rows = log.top_variant.join(R.round_dimension(log, log.run), "round_id").select(
        "run_id", "sub_run_id", "simulation_id", "round_id", "round_num", "assay_score").collect()
    by_round = {}
    for r in rows:
        by_round.setdefault((r.run_id, r.sub_run_id, r.round_num), {}).setdefault(r.simulation_id, {}).setdefault(r.round_id, []).append(r.assay_score)
    for k, sims in by_round.items():
        if k in perf:
            per_sim = [[np.std(v, ddof=1) for v in rounds.values() if len(v) > 1] for rounds in sims.values()]
            means = [np.mean(s) for s in per_sim if s]
            assert (perf[k].stddev_activity is None) == (not means)
            assert not means or perf[k].stddev_activity == pytest.approx(np.mean(means))


def test_merging_moments_of_uneven_parts(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(1e6, 1, 500)
    cut = [0, 1, 1, 300, 500]
    parts = [(len(p), float(p.mean()) if len(p) else None, float(((p - p.mean()) ** 2).sum()) if len(p) else None)
             for p in (x[a:b] for a, b in zip(cut[:-1], cut[1:]))]
    df = spark.createDataFrame([(parts,)], "p array<struct<n: bigint, mean: double, m2: double>>")
    got = df.select(MS._merge(F.col("p")).alias("m")).first().m
    assert got.n == 500 and got.mean == pytest.approx(x.mean(), rel=1e-14) and got.m2 == pytest.approx(((x - x.mean()) ** 2).sum(), rel=1e-9)
