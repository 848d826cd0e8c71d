"""C9 as a stored table kept current: ``run_metrics``, and the mergeable moments behind it.

When a batch of rounds is appended, its detail rows are folded into one line a
round: how many, how many above the run's threshold, mean, sum of squared
deviations, and the maximum. These lines are stored under the batch's name.
Lines of one round from several batches merge exactly as moments do, so the
leaderboard is rebuilt from a table of the size of the rounds, and the detail
rows of earlier batches are never read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import runlog as R
from ..sources.runlog_store import RunLogStore
from ..util import bounded_broadcast, null_safe_join

ROUND_KEYS = ("run_id", "sub_run_id", "simulation_id", "round_id", "round_num")

# The descriptive columns of a stored run_metrics row, from the run and from the sub-run.
RUN_COLUMNS = (
    "data_loader_type", "embedder_type", "embedder_model_name", "embedder_parameters", "num_simulations", "num_rounds",
    "num_variants", "num_variants_first_round", "num_top_acq_var_per_round", "num_top_pred_var_per_round",
    "num_top_n_pred_per_round", "batch_size", "test_fraction", "random_seed", "max_assay_score", "binary_score_cutoff")
SUB_RUN_COLUMNS = ("model_name", "model_parameters", "first_round_strategy_name", "first_round_strategy_params",
                   "strategy_parameters", "start_ts", "end_ts")


def round_moments(log: R.RunLog, runs: DataFrame | None = None) -> DataFrame:
    """One line for each round of ``log`` with top variants: its keys, regression metrics and moments of the assay score."""
    dims = R.round_dimension(log, log.run if runs is None else runs)
    rows = log.top_variant.join(dims, "round_id")
    high = R.high_activity_flag(F.col("wt_assay_score"))
    g = rows.groupBy(*ROUND_KEYS, *R.METRICS).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(high).alias("n_high"), F.count("assay_score").alias("n"),
        F.avg("assay_score").alias("mean"), F.var_pop("assay_score").alias("_var"), F.max("assay_score").alias("top"))
    return g.withColumn("m2", F.col("_var") * F.col("n")).drop("_var")


def _merge(parts: Column) -> Column:
    """(n, mean, m2) of all parts together; parts without a value change nothing."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(a, b):
        n, far = a["n"] + b["n"], b["mean"] - a["mean"]
        both = F.struct(n.alias("n"), (a["mean"] + far * b["n"] / n).alias("mean"),
                        (a["m2"] + b["m2"] + far * far * a["n"] * b["n"] / n).alias("m2"))
        return F.when(b["n"] > 0, both).otherwise(a)

    return F.aggregate(parts, start, step)


def merged_rounds(moments: DataFrame) -> DataFrame:
    """Lines of the same round (one a batch that touched it) as one line."""
    g = moments.groupBy(*ROUND_KEYS).agg(
        *[F.max(m).alias(m) for m in R.METRICS], F.sum("n_rows").alias("n_rows"), F.sum("n_high").alias("n_high"), F.max("top").alias("top"),
        _merge(F.array_sort(F.collect_list(F.struct("n", "mean", "m2")))).alias("_m"))
    return g.select(*ROUND_KEYS, *R.METRICS, "n_rows", "n_high", "top", "_m.n", F.when(F.col("_m.n") > 0, F.col("_m.mean")).alias("mean"), "_m.m2")


def performance(rounds: DataFrame, at_rounds=(5, 10)) -> DataFrame:
    """A7 by sub-run from merged lines, and the mean sample deviation of a round's scores."""
    r = rounds.where(F.col("round_num").isin(list(at_rounds))).select(
        *ROUND_KEYS, *R.METRICS, (F.col("n_high") / F.col("n_rows")).alias("mean_fha"), F.col("mean").alias("mean_activity"),
        F.sqrt(F.try_divide(F.col("m2"), F.col("n") - 1)).alias("stddev_activity"), F.col("top").alias("max_activity"))
    named = {"train_rmse": "train_rmse", "train_r2": "train_r2", "train_spearman": "train_spearm", "validation_rmse": "val_rmse",
             "validation_r2": "val_r2", "validation_spearman": "val_spearm"}
    measures = ["mean_fha", "mean_activity", "stddev_activity", "max_activity"]
    keys = ["run_id", "sub_run_id", "round_num"]
    per_sim = r.groupBy(*keys, "simulation_id").agg(*[F.avg(c).alias(c) for c in measures], *[F.avg(c).alias(n) for c, n in named.items()])
    return per_sim.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in [*measures, *named.values()]])


def leaderboard_rows(perf: DataFrame, runs: DataFrame, sub_runs: DataFrame) -> DataFrame:
    """The rows of ``run_metrics``: names, descriptive columns (NULL where the log has none), measures, ranks."""
    run = runs.withColumnsRenamed({"name": "run_name", "descrip": "run_descrip"})
    have = {f.name for f in run.schema}
    sub_have = {f.name for f in sub_runs.schema}
    pick = lambda c, found, alias: (F.col(alias) if c in found else F.lit(None).cast("string")).alias(c)
    run = run.select("run_id", "run_name", "run_descrip", "config_id", "dataset_name", *[pick(c, have, c) for c in RUN_COLUMNS])
    sub = sub_runs.select("sub_run_id", "strategy_name", *[pick(c, sub_have, c) for c in SUB_RUN_COLUMNS])
    full = R.leaderboard(perf).join(bounded_broadcast(sub), "sub_run_id").join(bounded_broadcast(run), "run_id")
    named = full.select(
        "run_id", "sub_run_id", R.run_display_name().alias("name"), "run_name", "run_descrip", "config_id", "dataset_name", *RUN_COLUMNS,
        *SUB_RUN_COLUMNS, "strategy_name", F.col("round_num").alias("end_round_num"), "stddev_activity",
        *[c for m, _, _ in R.LEADERBOARD for c in (m, f"{m}_rank")], "total_rank")
    return R.total_rank(named)


def append_batch(store: RunLogStore, log: R.RunLog, batch: str, at_rounds=(5, 10)) -> None:
    """Folds the rows of ``log`` (a batch's new rows; its dimension tables may hold more) into the store and renews ``run_metrics``.

    A batch given again replaces its own lines, so a broken append is just run
    again. Ranks compare all runs that the store has lines of.
    """
    store.append("round_moments", round_moments(log), batch)
    perf = performance(merged_rounds(store.read("round_moments")), at_rounds)
    runs = null_safe_join(log.run, bounded_broadcast(store.read("round_moments").select("run_id").distinct()), ["run_id"], "left_semi")
    store.replace("run_metrics", leaderboard_rows(perf, runs, log.sub_run))
