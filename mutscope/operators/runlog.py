"""Run-log analytics: filters, the log join, per-round aggregates, leaderboard.

All functions take the seven run-log DataFrames (``RunLog``) and work on every
run at once; ``run_id`` is always part of the grouping keys.

Plan shape: the dimension chain round ⋈ simulation ⋈ sub_run ⋈ run is built
first (sub_run and run are bounded and broadcast behind a size check), the
big variant tables are pre-aggregated per ``round_id`` (map-side partial
aggregation), and only then joined to the chain — one shuffle of the big side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import bindings
from ..util import bounded_broadcast, materialize
from .ordered import ordered_scan

RUN_KEYS = ("config_id", "dataset_name", "name")


@dataclass
class RunLog:
    run: DataFrame
    sub_run: DataFrame
    simulation: DataFrame
    round: DataFrame
    top_variant: DataFrame
    acquired_variant: DataFrame
    last_round_score: DataFrame

    @classmethod
    def bound(cls, spark: SparkSession, d: str) -> "RunLog":
        return cls(
            run=bindings.runs(spark, d),
            sub_run=bindings.sub_runs(spark, d),
            simulation=bindings.simulations(spark, d),
            round=bindings.rounds(spark, d),
            top_variant=bindings.top_variants(spark, d),
            acquired_variant=bindings.acquired_variants(spark, d),
            last_round_score=bindings.last_round_scores(spark, d),
        )


# ---------------------------------------------------------------- filters (P)

def optional_eq(df: DataFrame, **values) -> DataFrame:
    """``(:p is null or c = :p)`` — the predicate is only added when set."""
    for c, v in values.items():
        if v is not None:
            df = df.filter(F.col(c) == F.lit(v))
    return df


def latest_completed_runs(run: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """Newest (max id) run with an end time per (config, dataset, name)."""
    newest = (run.filter(F.col("end_ts").isNotNull())
              .groupBy(*keys).agg(F.max("run_id").alias("run_id")))
    return run.join(newest.select("run_id"), "run_id", "left_semi")


def completed_runs(run: DataFrame) -> DataFrame:
    """Completed runs ordered by end time."""
    return (run.filter(F.col("end_ts").isNotNull())
            .select("run_id", "config_id", "name", "dataset_name", "start_ts", "end_ts")
            .orderBy("end_ts"))


def completed_run_order(run: DataFrame) -> DataFrame:
    """P7 with ``end_order``, the 1-based place of each run by end time, from the ordered scan (no single-task window)."""
    done = completed_runs(run).withColumn("_one", F.lit(1).cast("long"))
    return ordered_scan(done, [], F.col("end_ts"), {"end_order": ("sum", "_one")}).drop("_one")


def train_size(round_num: Column | None = None) -> Column:
    """0 in round 1, else first + (round-2)·(acq + pred)."""
    round_num = F.col("round_num") if round_num is None else round_num
    return (F.when(round_num == 1, F.lit(0))
            .otherwise(F.col("num_variants_first_round")
                       + (round_num - 2) * (F.col("num_top_acq_var_per_round")
                                            + F.col("num_top_pred_var_per_round"))))


def run_display_name() -> Column:
    """P10: model/first-strategy/strategy/first/acq/pred/top-n with coalesce(top-n, 0)."""
    return F.concat_ws(
        "/", "model_name", "first_round_strategy_name", "strategy_name",
        F.col("num_variants_first_round").cast("string"),
        F.col("num_top_acq_var_per_round").cast("string"),
        F.col("num_top_pred_var_per_round").cast("string"),
        F.coalesce(F.col("num_top_n_pred_per_round"), F.lit(0)).cast("string"))


# ---------------------------------------------------------------- joins (J)

def round_dimension(log: RunLog, runs: DataFrame | None = None, with_run: bool = True) -> DataFrame:
    """Round rows enriched with simulation, sub-run and (optionally) run columns.

    ``runs`` restricts the chain to a run subset before the large joins; their
    columns are added unless they are run ids only.
    """
    sub = log.sub_run
    if runs is not None:
        sub = sub.join(bounded_broadcast(runs.select("run_id")), "run_id", "left_semi")
    dims = log.simulation.join(bounded_broadcast(sub), "sub_run_id")
    if with_run and (runs is None or runs.columns != ["run_id"]):
        run = log.run if runs is None else runs
        dims = dims.join(bounded_broadcast(run), "run_id")
    return log.round.join(dims, "simulation_id")


def log_join(log: RunLog, detail: DataFrame | None = None, runs: DataFrame | None = None,
             with_run: bool = True) -> DataFrame:
    """Detail rows (top variants by default) joined up the FK chain."""
    detail = log.top_variant if detail is None else detail
    return detail.join(round_dimension(log, runs, with_run), "round_id")


def with_group_stats(df: DataFrame, value: str, keys, mean_name="avg_value",
                     std_name="std_value") -> DataFrame:
    """Attach mean and sample σ of ``value`` per ``keys`` (aggregate + join)."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias(mean_name),
                                  F.stddev_samp(value).alias(std_name))
    return df.join(bounded_broadcast(stats), list(keys))


# ---------------------------------------------------------------- aggregates (A)

def _per_round(detail: DataFrame, aggs: list[Column]) -> DataFrame:
    """Pre-aggregate a big per-variant table to one row per round."""
    return detail.groupBy("round_id").agg(*aggs)


def mean_activity_by_round(log: RunLog, runs: DataFrame, strategy: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """A1: avg assay per round row, then mean and sample σ over simulations
    (also apart by the sub-run columns ``by``)."""
    per_round = _per_round(log.top_variant, [F.avg("assay_score").alias("mean_score")])
    dims = optional_eq(round_dimension(log, runs), strategy_name=strategy)
    rs = per_round.join(dims, "round_id")
    return (rs.groupBy("run_id", "strategy_name", *by, "round_num", "num_variants")
            .agg(F.avg("mean_score").alias("mean_score"),
                 F.stddev_samp("mean_score").alias("stddev")))


def high_activity_fraction(log: RunLog, runs: DataFrame, threshold: float | None = None) -> DataFrame:
    """A2: share of top variants above the WT score (or a fixed threshold),
    per simulation, then mean and σ over simulations per round."""
    dims = round_dimension(log, runs)
    thr = F.col("wt_assay_score") if threshold is None else F.lit(threshold)
    # the threshold is a run attribute: join first, then aggregate per round row
    rs = (log.top_variant.join(dims, "round_id")
          .groupBy("round_id", "run_id", "round_num", "simulation_id", "num_variants")
          .agg(F.avg(high_activity_flag(thr)).alias("fraction_high_activity")))
    return (rs.groupBy("run_id", "round_num", "num_variants")
            .agg(F.avg("fraction_high_activity").alias("mean_fha"),
                 F.stddev_samp("fraction_high_activity").alias("stddev")))


def last_round_ensemble(log: RunLog, runs: DataFrame) -> DataFrame:
    """A3: average prediction per variant across simulations in the final round,
    with a z-score against the run's mean and sample σ (rounded to 3).

    Runs that kept all predictions read the top-variant table at round
    ``num_rounds``; the others read ``last_round_score``.
    """
    keep_all = runs.filter("save_all_predictions")
    others = runs.filter(~F.col("save_all_predictions"))
    a = (log_join(log, runs=keep_all)
         .filter(F.col("round_num") == F.col("num_rounds"))
         .select("run_id", "variant_id", "assay_score", "prediction_score", "num_variants"))
    sim_run = log.simulation.join(
        bounded_broadcast(log.sub_run.join(bounded_broadcast(others), "run_id")
                          .select("sub_run_id", "run_id", "num_variants")), "sub_run_id")
    b = (log.last_round_score.join(sim_run, "simulation_id")
         .select("run_id", "variant_id", "assay_score", "prediction_score", "num_variants"))
    pred = (a.unionByName(b)
            .groupBy("run_id", "variant_id", "assay_score", "num_variants")
            .agg(F.avg("prediction_score").alias("prediction_score")))
    pred = materialize(pred, "ensemble")         # the statistics and the z-scores both read it
    pred = with_group_stats(pred, "prediction_score", ["run_id"], "avg_prediction_score",
                            "std_prediction_score")
    z = F.round(F.try_divide(F.col("prediction_score") - F.col("avg_prediction_score"),
                             F.col("std_prediction_score")), 3)
    return pred.select("run_id", "variant_id", "assay_score", "prediction_score",
                       "num_variants", z.alias("z_score"))


def best_by_round(log: RunLog, runs: DataFrame) -> DataFrame:
    """A4: best assay per round row, then mean and σ over simulations."""
    per_round = _per_round(log.top_variant, [F.max("assay_score").alias("max_score")])
    rs = per_round.join(round_dimension(log, runs), "round_id")
    return (rs.groupBy("run_id", "round_num")
            .agg(F.avg("max_score").alias("avg_max_score"),
                 F.stddev_samp("max_score").alias("stddev")))


def selection_counts(log: RunLog, runs: DataFrame) -> DataFrame:
    """A5: acquired variants per round and how many were chosen by each criterion."""
    per_round = _per_round(log.acquired_variant, [
        F.count(F.lit(1)).alias("cnt"),
        F.sum(F.col("top_acquisition_score").cast("int")).alias("cnt_acquired"),
        F.sum(F.col("top_prediction_score").cast("int")).alias("cnt_predicted")])
    rs = per_round.join(round_dimension(log, runs), "round_id")
    return (rs.groupBy("run_id", "round_num")
            .agg(F.avg("cnt").alias("avg_count"),
                 F.avg("cnt_acquired").alias("avg_cnt_acquired"),
                 F.avg("cnt_predicted").alias("avg_cnt_predicted")))


METRICS = ("train_rmse", "train_r2", "train_spearman", "validation_rmse", "validation_r2",
           "validation_spearman", "test_rmse", "test_r2", "test_spearman")
SHORT = dict(zip(METRICS, ("tr_rmse", "tr_r2", "tr_spearm", "v_rmse", "v_r2", "v_spearm",
                           "t_rmse", "t_r2", "t_spearm")))


def round_metric_means(log: RunLog, runs: DataFrame | None = None, by_run: bool = True) -> DataFrame:
    """Mean of the nine regression metrics per round (and run)."""
    keys = ["run_id", "round_num"] if by_run else ["round_num"]
    dims = round_dimension(log, runs, with_run=False)
    return dims.groupBy(*keys).agg(*[F.avg(m).alias(SHORT[m]) for m in METRICS])


def run_summary(log: RunLog, runs: DataFrame, round_num: int = 2) -> DataFrame:
    """P11 over A6: per run at one round — model tag, rounded metrics, train
    size, the model's ``alpha`` parameter and the end date."""
    means = round_metric_means(log, runs).filter(F.col("round_num") == round_num)
    param = (log.sub_run.join(bounded_broadcast(runs.select("run_id")), "run_id", "left_semi")
             .groupBy("run_id")
             .agg(F.min(F.get_json_object("model_parameters", "$.alpha")).alias("mod_param")))
    m = means.join(bounded_broadcast(runs), "run_id").join(param, "run_id", "left")
    return m.select(
        F.col("run_id").alias("rid"),
        F.substring("embedder_model_name", 3, 6).alias("model"),
        F.col("dataset_name").alias("dataset"),
        *[F.round(SHORT[c], 3).alias(SHORT[c]) for c in METRICS[:6]],
        train_size().alias("train_sz"),
        "mod_param",
        F.date_format("end_ts", "yyyy-MM-dd").alias("end_ts"))


def high_activity_flag(threshold: Column) -> Column:
    return F.when(F.col("assay_score") > threshold, 1).otherwise(0)


def run_performance(log: RunLog, runs: DataFrame, at_rounds=(5, 10), by_sub_run=False) -> DataFrame:
    """Nine measures per run (or sub-run) at chosen rounds, three levels:
    round row → simulation → run."""
    dims = round_dimension(log, runs).filter(F.col("round_num").isin(list(at_rounds)))
    keys = ["run_id", "sub_run_id"] if by_sub_run else ["run_id"]
    # the threshold is a run attribute: join first, then aggregate per round row
    # (the join's hash partitioning on round_id is reused by the aggregate)
    rs = (log.top_variant.join(dims, "round_id")
          .groupBy("round_id", *keys, "round_num", "simulation_id", *METRICS)
          .agg(F.avg(high_activity_flag(F.col("wt_assay_score"))).alias("fraction_high_activity"),
               F.avg("assay_score").alias("mean_activity"),
               F.max("assay_score").alias("max_activity")))
    per_sim = rs.groupBy(*keys, "round_num", "simulation_id").agg(
        F.avg("fraction_high_activity").alias("fraction_high_activity"),
        F.avg("mean_activity").alias("mean_activity"),
        F.avg("max_activity").alias("max_activity"),
        F.avg("train_rmse").alias("train_rmse"), F.avg("train_r2").alias("train_r2"),
        F.avg("train_spearman").alias("train_spearm"),
        F.avg("validation_rmse").alias("val_rmse"), F.avg("validation_r2").alias("val_r2"),
        F.avg("validation_spearman").alias("val_spearm"))
    measures = ["fraction_high_activity", "mean_activity", "max_activity", "train_rmse",
                "train_r2", "train_spearm", "val_rmse", "val_r2", "val_spearm"]
    out = per_sim.groupBy(*keys, "round_num").agg(
        *[F.avg(c).alias("mean_fha" if c == "fraction_high_activity" else c) for c in measures])
    return out


def round_row_counts(log: RunLog, runs: DataFrame) -> DataFrame:
    """Number of top-variant rows per (simulation, round)."""
    per_round = _per_round(log.top_variant, [F.count(F.lit(1)).alias("cnt")])
    rs = per_round.join(round_dimension(log, runs), "round_id")
    return rs.groupBy("run_id", "simulation_id", "round_num").agg(F.sum("cnt").alias("cnt"))


# ---------------------------------------------------------------- windows (W)

# (measure, descending?, weight) — fixed values of the leaderboard definition.
LEADERBOARD = (
    ("mean_fha", True, 2.0), ("mean_activity", True, 2.0), ("max_activity", True, 2.0),
    ("train_rmse", False, 1.0), ("train_r2", True, 1.0), ("train_spearm", True, 1.0),
    ("val_rmse", False, 1.2), ("val_r2", True, 1.2), ("val_spearm", True, 1.2),
)


def leaderboard(perf: DataFrame, partition=("round_num",), weights=LEADERBOARD) -> DataFrame:
    """Rank of every measure within a round (desc for benefit, asc for
    error, NULLs last) and a weighted rank total rounded to 3.

    The partition is a round number, so the window input is one row per
    (run, sub-run, round) — a bounded, already-aggregated table.
    """
    cols = []
    total = None
    for m, desc, w in weights:
        order = F.col(m).desc_nulls_last() if desc else F.col(m).asc_nulls_last()
        r = F.rank().over(Window.partitionBy(*partition).orderBy(order))
        cols.append(r.alias(f"{m}_rank"))
    ranked = perf.select("*", *cols)
    for m, _, w in weights:
        term = F.col(f"{m}_rank") * F.lit(w)
        total = term if total is None else total + term
    return ranked.withColumn("total_rank", F.round(total, 3))


def total_rank(df: DataFrame, partition="end_round_num") -> DataFrame:
    """Final place by ascending weighted total within an end round."""
    w = Window.partitionBy(partition).orderBy(F.col("total_rank").asc_nulls_last())
    return df.withColumn("final_rank", F.rank().over(w))


def run_metrics(log: RunLog, runs: DataFrame, at_rounds=(5, 10)) -> DataFrame:
    """Per sub-run performance → ranks → display name → final rank."""
    perf = run_performance(log, runs, at_rounds, by_sub_run=True)
    ranked = leaderboard(perf)
    sub = bounded_broadcast(log.sub_run.drop("run_id"))
    full = ranked.join(sub, "sub_run_id").join(bounded_broadcast(runs), "run_id")
    named = full.select(
        "run_id", "sub_run_id", run_display_name().alias("name"),
        F.col("name").alias("run_name"), F.col("descrip").alias("run_descrip"),
        "config_id", "dataset_name", "strategy_name",
        F.col("round_num").alias("end_round_num"),
        *[c for m, _, _ in LEADERBOARD for c in (m, f"{m}_rank")], "total_rank")
    return total_rank(named)


def run_metrics_view(metrics: DataFrame) -> DataFrame:
    """The narrow leaderboard view."""
    return metrics.select("run_id", "sub_run_id", "name", "strategy_name", "end_round_num",
                          *[m for m, _, _ in LEADERBOARD], "total_rank", "final_rank")


# ---------------------------------------------------------------- retention (U)

def purge(log: RunLog, keys=RUN_KEYS) -> dict[str, DataFrame]:
    """U4: keep only the newest completed run per (config, dataset, name) in all
    seven tables, via semi joins down the FK chain (never ``NOT IN``)."""
    keep = latest_completed_runs(log.run, keys)
    sub = log.sub_run.join(bounded_broadcast(keep.select("run_id")), "run_id", "left_semi")
    sim = log.simulation.join(bounded_broadcast(sub.select("sub_run_id")), "sub_run_id", "left_semi")
    rnd = log.round.join(sim.select("simulation_id"), "simulation_id", "left_semi")
    return {
        "run": keep,
        "sub_run": sub,
        "simulation": sim,
        "round": rnd,
        "round_top_variant": log.top_variant.join(rnd.select("round_id"), "round_id", "left_semi"),
        "round_acquired_variant": log.acquired_variant.join(rnd.select("round_id"), "round_id",
                                                            "left_semi"),
        "last_round_score": log.last_round_score.join(sim.select("simulation_id"), "simulation_id",
                                                      "left_semi"),
    }


def run_state(events: DataFrame, id_col: str, ts_col: str, tie_col: str,
              state_cols: list[str]) -> DataFrame:
    """Last state of each entity from an append-only event table —
    ``max_by`` on (timestamp, tie-break), first timestamp and event count."""
    order = F.struct(F.col(ts_col), F.col(tie_col))
    return events.groupBy(id_col).agg(
        F.min(ts_col).alias("first_ts"),
        F.max(ts_col).alias("last_ts"),
        F.count(F.lit(1)).alias("n_events"),
        *[F.max_by(c, order).alias(f"last_{c}") for c in state_cols])
