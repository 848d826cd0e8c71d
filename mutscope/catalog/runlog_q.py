"""Catalog entries for run-log analytics (P*, J1–J3, J8, A1–A8, W1, W5, U4, U5, C1, C9)."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import runlog as R
from ..plans import metrics_store as MS
from ..session import stage_folder, table
from ..sources.runlog_store import RUN_TABLES, RunLogStore
from ..util import bounded_broadcast, finish
from .bind_sql import rounded, with_
from .registry import register

LATEST = """SELECT * FROM b_run WHERE run_id IN (
    SELECT max(run_id) FROM b_run WHERE end_ts IS NOT NULL GROUP BY config_id, dataset_name, name)"""

DIMS = """SELECT rnd.*, s.sub_run_id, s.simulation_num, sr.strategy_name, sr.model_name,
       sr.first_round_strategy_name, sr.model_parameters, r.* EXCLUDE (run_id), r.run_id
FROM b_round rnd JOIN b_simulation s ON rnd.simulation_id = s.simulation_id
JOIN b_sub_run sr ON s.sub_run_id = sr.sub_run_id
JOIN latest r ON sr.run_id = r.run_id"""

BASE = ("b_run", "b_sub_run", "b_simulation", "b_round", "b_top_variant")


def W(*extra_names, **extra):
    return with_(*BASE, *extra_names, extra={"latest": LATEST, "dims": DIMS, **extra})


def _log(spark, d):
    log = R.RunLog.bound(spark, d)
    return log, R.latest_completed_runs(log.run)


# ---------------------------------------------------------------- A1

@register("A1", rounded(W() + """
, rs AS (SELECT d.run_id, d.strategy_name, d.round_num, d.num_variants, d.round_id,
                avg(tv.assay_score) AS mean_score
         FROM b_top_variant tv JOIN dims d ON tv.round_id = d.round_id
         GROUP BY d.run_id, d.strategy_name, d.round_num, d.num_variants, d.round_id)
SELECT run_id, strategy_name, round_num, num_variants, avg(mean_score) AS mean_score,
       stddev_samp(mean_score) AS stddev
FROM rs GROUP BY run_id, strategy_name, round_num, num_variants""", "mean_score", "stddev"))
def q_a1(spark, d):
    log, runs = _log(spark, d)
    return finish(R.mean_activity_by_round(log, runs))


@register("A2", rounded(W() + """
, rs AS (SELECT d.run_id, d.round_num, d.num_variants, d.round_id,
                avg(CASE WHEN tv.assay_score > d.wt_assay_score THEN 1 ELSE 0 END) AS f
         FROM b_top_variant tv JOIN dims d ON tv.round_id = d.round_id
         GROUP BY d.run_id, d.round_num, d.num_variants, d.round_id)
SELECT run_id, round_num, num_variants, avg(f) AS mean_fha, stddev_samp(f) AS stddev
FROM rs GROUP BY run_id, round_num, num_variants""", "mean_fha", "stddev"))
def q_a2(spark, d):
    log, runs = _log(spark, d)
    return finish(R.high_activity_fraction(log, runs))


@register("A3", rounded(with_(*BASE, "b_last_round", extra={"latest": LATEST, "dims": DIMS}) + """
, src AS (
    SELECT d.run_id, tv.variant_id, tv.assay_score, tv.prediction_score, d.num_variants
    FROM b_top_variant tv JOIN dims d ON tv.round_id = d.round_id
    WHERE d.save_all_predictions AND d.round_num = d.num_rounds
    UNION ALL
    SELECT r.run_id, l.variant_id, l.assay_score, l.prediction_score, r.num_variants
    FROM b_last_round l JOIN b_simulation s ON l.simulation_id = s.simulation_id
    JOIN b_sub_run sr ON s.sub_run_id = sr.sub_run_id JOIN latest r ON sr.run_id = r.run_id
    WHERE NOT r.save_all_predictions),
pred AS (SELECT run_id, variant_id, assay_score, num_variants, avg(prediction_score) AS prediction_score
         FROM src GROUP BY run_id, variant_id, assay_score, num_variants),
ms AS (SELECT run_id, avg(prediction_score) AS m, stddev_samp(prediction_score) AS s
       FROM pred GROUP BY run_id)
SELECT p.run_id, variant_id, assay_score, prediction_score, num_variants,
       round((prediction_score - m) / s, 3) AS z_score
FROM pred p JOIN ms ON p.run_id = ms.run_id""", "assay_score", "prediction_score", "z_score"))
def q_a3(spark, d):
    log, runs = _log(spark, d)
    return finish(R.last_round_ensemble(log, runs))


@register("A4", rounded(W() + """
, rs AS (SELECT d.run_id, d.round_num, d.round_id, max(tv.assay_score) AS max_score
         FROM b_top_variant tv JOIN dims d ON tv.round_id = d.round_id
         GROUP BY d.run_id, d.round_num, d.round_id)
SELECT run_id, round_num, avg(max_score) AS avg_max_score, stddev_samp(max_score) AS stddev
FROM rs GROUP BY run_id, round_num""", "avg_max_score", "stddev"))
def q_a4(spark, d):
    log, runs = _log(spark, d)
    return finish(R.best_by_round(log, runs))


@register("A5", rounded(with_(*BASE, "b_acquired", extra={"latest": LATEST, "dims": DIMS}) + """
, rs AS (SELECT d.run_id, d.round_num, d.round_id, count(*) AS cnt,
                sum(CAST(a.top_acquisition_score AS INTEGER)) AS cnt_acquired,
                sum(CAST(a.top_prediction_score AS INTEGER)) AS cnt_predicted
         FROM b_acquired a JOIN dims d ON a.round_id = d.round_id
         GROUP BY d.run_id, d.round_num, d.round_id)
SELECT run_id, round_num, avg(cnt) AS avg_count, avg(cnt_acquired) AS avg_cnt_acquired,
       avg(cnt_predicted) AS avg_cnt_predicted
FROM rs GROUP BY run_id, round_num""", "avg_count", "avg_cnt_acquired", "avg_cnt_predicted"))
def q_a5(spark, d):
    log, runs = _log(spark, d)
    return finish(R.selection_counts(log, runs))


_A6_COLS = ("tr_rmse", "tr_r2", "tr_spearm", "v_rmse", "v_r2", "v_spearm", "t_rmse", "t_r2", "t_spearm")
_A6_SQL = ", ".join(f"avg({m}) AS {R.SHORT[m]}" for m in R.METRICS)


@register("A6", rounded(with_(*BASE, extra={"latest": "SELECT * FROM b_run", "dims": DIMS})
                        + f"SELECT run_id, round_num, {_A6_SQL} FROM dims GROUP BY run_id, round_num",
                        *_A6_COLS))
def q_a6(spark, d):
    log = R.RunLog.bound(spark, d)
    return finish(R.round_metric_means(log))


_A7_CTE = """
, rs AS (SELECT d.run_id, d.sub_run_id, d.round_num, d.simulation_id, d.round_id,
                avg(CASE WHEN tv.assay_score > d.wt_assay_score THEN 1 ELSE 0 END) AS f,
                avg(tv.assay_score) AS mean_activity, max(tv.assay_score) AS max_activity,
                any_value(d.train_rmse) AS train_rmse, any_value(d.train_r2) AS train_r2,
                any_value(d.train_spearman) AS train_spearman,
                any_value(d.validation_rmse) AS validation_rmse,
                any_value(d.validation_r2) AS validation_r2,
                any_value(d.validation_spearman) AS validation_spearman
         FROM b_top_variant tv JOIN dims d ON tv.round_id = d.round_id
         WHERE d.round_num IN (5, 10)
         GROUP BY d.run_id, d.sub_run_id, d.round_num, d.simulation_id, d.round_id),
sim AS (SELECT {keys}, round_num, simulation_id, avg(f) AS f, avg(mean_activity) AS mean_activity,
               avg(max_activity) AS max_activity, avg(train_rmse) AS train_rmse,
               avg(train_r2) AS train_r2, avg(train_spearman) AS train_spearm,
               avg(validation_rmse) AS val_rmse, avg(validation_r2) AS val_r2,
               avg(validation_spearman) AS val_spearm
        FROM rs GROUP BY {keys}, round_num, simulation_id),
perf AS (SELECT {keys}, round_num, avg(f) AS mean_fha, avg(mean_activity) AS mean_activity,
                avg(max_activity) AS max_activity, avg(train_rmse) AS train_rmse,
                avg(train_r2) AS train_r2, avg(train_spearm) AS train_spearm,
                avg(val_rmse) AS val_rmse, avg(val_r2) AS val_r2, avg(val_spearm) AS val_spearm
         FROM sim GROUP BY {keys}, round_num)
"""
_PERF_COLS = ("mean_fha", "mean_activity", "max_activity", "train_rmse", "train_r2",
              "train_spearm", "val_rmse", "val_r2", "val_spearm")


@register("A7", rounded(W() + _A7_CTE.format(keys="run_id") + "SELECT * FROM perf", *_PERF_COLS))
def q_a7(spark, d):
    log, runs = _log(spark, d)
    return finish(R.run_performance(log, runs))


@register("A8", W() + """
, c AS (SELECT d.run_id, d.simulation_id, d.round_num, count(*) AS cnt
        FROM b_top_variant tv JOIN dims d ON tv.round_id = d.round_id
        GROUP BY d.run_id, d.simulation_id, d.round_num)
SELECT * FROM c""")
def q_a8(spark, d):
    log, runs = _log(spark, d)
    return finish(R.round_row_counts(log, runs))


def _rank_sql(partition: str) -> str:
    parts = []
    for m, desc, _ in R.LEADERBOARD:
        order = "DESC NULLS LAST" if desc else "ASC NULLS LAST"
        parts.append(f"CAST(rank() OVER (PARTITION BY {partition} ORDER BY {m} {order}) AS INTEGER) AS {m}_rank")
    total = " + ".join(f"{m}_rank * {w}" for m, _, w in R.LEADERBOARD)
    return ", ".join(parts), total


_RANKS, _TOTAL = _rank_sql("round_num")


@register("W1", rounded(W() + _A7_CTE.format(keys="run_id") + f"""
, ranked AS (SELECT *, {_RANKS} FROM perf)
SELECT *, round(CAST({_TOTAL} AS DOUBLE), 3) AS total_rank FROM ranked""", *_PERF_COLS, "total_rank"))
def q_w1(spark, d):
    log, runs = _log(spark, d)
    return finish(R.leaderboard(R.run_performance(log, runs)))


_C9_NAME = """sr.model_name || '/' || sr.first_round_strategy_name || '/' || sr.strategy_name || '/'
    || CAST(r.num_variants_first_round AS VARCHAR) || '/' || CAST(r.num_top_acq_var_per_round AS VARCHAR)
    || '/' || CAST(r.num_top_pred_var_per_round AS VARCHAR) || '/'
    || CAST(coalesce(r.num_top_n_pred_per_round, 0) AS VARCHAR)"""
_LB_COLS = ", ".join(f"p.{m}, p.{m}_rank" for m, _, _ in R.LEADERBOARD)


ORACLE_C9 = W() + _A7_CTE.format(keys="run_id, sub_run_id") + f"""
, ranked AS (SELECT *, {_RANKS} FROM perf),
tot AS (SELECT *, round(CAST({_TOTAL} AS DOUBLE), 3) AS total_rank FROM ranked),
named AS (SELECT p.run_id, p.sub_run_id, {_C9_NAME} AS name, r.name AS run_name,
                 r.descrip AS run_descrip, r.config_id, r.dataset_name, sr.strategy_name,
                 p.round_num AS end_round_num, {_LB_COLS}, p.total_rank
          FROM tot p JOIN b_sub_run sr ON p.sub_run_id = sr.sub_run_id
          JOIN latest r ON p.run_id = r.run_id)
SELECT *, CAST(rank() OVER (PARTITION BY end_round_num ORDER BY total_rank ASC NULLS LAST) AS INTEGER)
       AS final_rank FROM named"""


@register("C9", rounded(W() + _A7_CTE.format(keys="run_id, sub_run_id") + f"""
, ranked AS (SELECT *, {_RANKS} FROM perf),
tot AS (SELECT *, round(CAST({_TOTAL} AS DOUBLE), 3) AS total_rank FROM ranked),
named AS (SELECT p.run_id, p.sub_run_id, {_C9_NAME} AS name, r.name AS run_name,
                 r.descrip AS run_descrip, r.config_id, r.dataset_name, sr.strategy_name,
                 p.round_num AS end_round_num, {_LB_COLS}, p.total_rank
          FROM tot p JOIN b_sub_run sr ON p.sub_run_id = sr.sub_run_id
          JOIN latest r ON p.run_id = r.run_id)
SELECT *, CAST(rank() OVER (PARTITION BY end_round_num ORDER BY total_rank ASC NULLS LAST) AS INTEGER)
       AS final_rank FROM named""", *_PERF_COLS, "total_rank"))
def q_c9(spark, d):
    log, runs = _log(spark, d)
    return finish(R.run_metrics(log, runs))


_STORED_RUN = ("embedder_model_name", "num_rounds", "num_variants", "num_variants_first_round", "num_top_acq_var_per_round",
               "num_top_pred_var_per_round", "num_top_n_pred_per_round")
_STORED_SUB = ("model_name", "model_parameters", "first_round_strategy_name")


@register("C9_stored", rounded(ORACLE_C9.replace("r.dataset_name, sr.strategy_name,", "r.dataset_name, sr.strategy_name, "
                                                 + "".join(f"r.{c}, " for c in _STORED_RUN) + "".join(f"sr.{c}, " for c in _STORED_SUB)),
                               *_PERF_COLS, "total_rank"))
def q_c9_stored(spark, d):
    """C9 read from the stored table after two appended batches, some rounds split between them."""
    log, runs = _log(spark, d)
    # configured runs that are not ranked stay out of the log that is stored
    sub = log.sub_run.join(bounded_broadcast(runs.select("run_id")), "run_id", "left_semi")
    log = replace(log, run=runs, sub_run=sub)
    early = F.pmod(F.xxhash64("round_id", "variant_id"), F.lit(3)) > 0
    store = RunLogStore(spark, f"{stage_folder(spark)}/metrics-{uuid.uuid4().hex}")
    MS.append_batch(store, replace(log, top_variant=log.top_variant.where(early)), "b1")
    MS.append_batch(store, replace(log, top_variant=log.top_variant.where(~early)), "b2")
    kept = ["run_id", "sub_run_id", "name", "run_name", "run_descrip", "config_id", "dataset_name", "strategy_name", *_STORED_RUN, *_STORED_SUB,
            "end_round_num", *[c for m, _, _ in R.LEADERBOARD for c in (m, f"{m}_rank")], "total_rank", "final_rank"]
    return finish(store.read("run_metrics").select(kept))


@register("P12", rounded(W() + _A7_CTE.format(keys="run_id, sub_run_id") + f"""
, ranked AS (SELECT *, {_RANKS} FROM perf),
tot AS (SELECT *, round(CAST({_TOTAL} AS DOUBLE), 3) AS total_rank FROM ranked),
named AS (SELECT p.run_id, p.sub_run_id, {_C9_NAME} AS name, sr.strategy_name,
                 p.round_num AS end_round_num, {", ".join(f"p.{m}" for m, _, _ in R.LEADERBOARD)},
                 p.total_rank
          FROM tot p JOIN b_sub_run sr ON p.sub_run_id = sr.sub_run_id
          JOIN latest r ON p.run_id = r.run_id)
SELECT *, CAST(rank() OVER (PARTITION BY end_round_num ORDER BY total_rank ASC NULLS LAST) AS INTEGER)
       AS final_rank FROM named""", *_PERF_COLS, "total_rank"))
def q_p12(spark, d):
    log, runs = _log(spark, d)
    return finish(R.run_metrics_view(R.run_metrics(log, runs)))


# ---------------------------------------------------------------- filters / projections

@register("P2", with_("b_run") + "SELECT run_id, config_id, dataset_name, name FROM b_run WHERE run_id IN "
          "(SELECT max(run_id) FROM b_run WHERE end_ts IS NOT NULL GROUP BY config_id, dataset_name, name)")
def q_p2(spark, d):
    log = R.RunLog.bound(spark, d)
    return finish(R.latest_completed_runs(log.run).select("run_id", "config_id", "dataset_name", "name"))


@register("P7", with_("b_run") + """SELECT run_id, config_id, name, dataset_name,
    strftime(start_ts, '%Y-%m-%d') AS start_day, strftime(end_ts, '%Y-%m-%d') AS end_day,
    CAST(row_number() OVER (ORDER BY end_ts) AS INTEGER) AS end_order
    FROM b_run WHERE end_ts IS NOT NULL""")
def q_p7(spark, d):
    """Completed runs with their position in end-time order (the ordering is
    kept as a column so an order-insensitive compare still checks it)."""
    log = R.RunLog.bound(spark, d)
    return finish(R.completed_run_order(log.run).select(
        "run_id", "config_id", "name", "dataset_name",
        F.date_format("start_ts", "yyyy-MM-dd").alias("start_day"),
        F.date_format("end_ts", "yyyy-MM-dd").alias("end_day"),
        F.col("end_order").cast("int").alias("end_order")))


@register("P8", rounded(with_(*BASE, extra={"newest": "SELECT max(run_id) AS run_id FROM b_run"}) + """
SELECT rnd.* FROM b_round rnd JOIN b_simulation s ON rnd.simulation_id = s.simulation_id
JOIN b_sub_run sr ON s.sub_run_id = sr.sub_run_id
WHERE sr.run_id = (SELECT run_id FROM newest)""", *R.METRICS))
def q_p8(spark, d):
    """Rounds of the newest run (scalar subquery → broadcast of one id)."""
    log = R.RunLog.bound(spark, d)
    newest = log.run.agg(F.max("run_id").alias("run_id"))
    sub = log.sub_run.join(F.broadcast(newest), "run_id", "left_semi")  # one row by construction
    sims = log.simulation.join(sub.select("sub_run_id"), "sub_run_id", "left_semi")
    return finish(log.round.join(sims.select("simulation_id"), "simulation_id", "left_semi"))


@register("P6", with_(*BASE) + """
SELECT sr.run_id, rnd.round_num, count(*) AS n_rounds
FROM b_round rnd JOIN b_simulation s ON rnd.simulation_id = s.simulation_id
JOIN b_sub_run sr ON s.sub_run_id = sr.sub_run_id
WHERE sr.run_id IN (3, 4) AND rnd.round_num BETWEEN 2 AND 6
GROUP BY sr.run_id, rnd.round_num""")
def q_p6(spark, d):
    log = R.RunLog.bound(spark, d)
    dims = R.round_dimension(log, with_run=False)
    return finish(dims.filter(F.col("run_id").isin(3, 4) & F.col("round_num").between(2, 6))
                  .groupBy("run_id", "round_num").agg(F.count(F.lit(1)).alias("n_rounds")))


@register("P9", W() + """
SELECT DISTINCT run_id, round_num,
  CASE WHEN round_num = 1 THEN 0 ELSE num_variants_first_round + (round_num - 2) *
       (num_top_acq_var_per_round + num_top_pred_var_per_round) END AS train_size
FROM dims""")
def q_p9(spark, d):
    log, runs = _log(spark, d)
    dims = R.round_dimension(log, runs)
    return finish(dims.select("run_id", "round_num", R.train_size().alias("train_size")).distinct())


@register("P10", with_("b_run", "b_sub_run") + f"""
SELECT sr.sub_run_id, {_C9_NAME} AS display_name
FROM b_sub_run sr JOIN b_run r ON sr.run_id = r.run_id""")
def q_p10(spark, d):
    log = R.RunLog.bound(spark, d)
    return finish(log.sub_run.join(log.run, "run_id")
                  .select("sub_run_id", R.run_display_name().alias("display_name")))


@register("P11", with_(*BASE, extra={"latest": LATEST, "dims": DIMS}) + f"""
, m AS (SELECT run_id, round_num, {_A6_SQL} FROM dims GROUP BY run_id, round_num),
p AS (SELECT run_id, min(json_extract_string(model_parameters, '$.alpha')) AS mod_param
      FROM b_sub_run GROUP BY run_id)
SELECT m.run_id AS rid, substr(r.embedder_model_name, 3, 6) AS model, r.dataset_name AS dataset,
       round(tr_rmse, 3) AS tr_rmse, round(tr_r2, 3) AS tr_r2, round(tr_spearm, 3) AS tr_spearm,
       round(v_rmse, 3) AS v_rmse, round(v_r2, 3) AS v_r2, round(v_spearm, 3) AS v_spearm,
       CASE WHEN m.round_num = 1 THEN 0 ELSE r.num_variants_first_round + (m.round_num - 2) *
            (r.num_top_acq_var_per_round + r.num_top_pred_var_per_round) END AS train_sz,
       p.mod_param, strftime(r.end_ts, '%Y-%m-%d') AS end_ts
FROM m JOIN latest r ON m.run_id = r.run_id LEFT JOIN p ON m.run_id = p.run_id
WHERE m.round_num = 2""")
def q_p11(spark, d):
    log, runs = _log(spark, d)
    return finish(R.run_summary(log, runs, round_num=2))


@register("P1", rounded(W() + """
SELECT d.run_id, tv.variant_id, d.strategy_name, d.round_num, d.simulation_id, d.simulation_num,
       tv.prediction_score, tv.assay_score, d.num_variants
FROM b_top_variant tv JOIN dims d ON tv.round_id = d.round_id
WHERE d.strategy_name = 'NATION_4'""", "prediction_score", "assay_score"))
def q_p1(spark, d):
    """Score trace restricted by the optional strategy predicate."""
    return _score_trace(spark, d, strategy="NATION_4")


def _score_trace(spark, d, strategy=None):
    log, runs = _log(spark, d)
    dims = R.optional_eq(R.round_dimension(log, runs), strategy_name=strategy)
    return finish(log.top_variant.join(dims, "round_id").select(
        "run_id", "variant_id", "strategy_name", "round_num", "simulation_id", "simulation_num",
        "prediction_score", "assay_score", "num_variants"))


@register("C1", rounded(W() + """
SELECT d.run_id, tv.variant_id, d.strategy_name, d.round_num, d.simulation_id, d.simulation_num,
       tv.prediction_score, tv.assay_score, d.num_variants
FROM b_top_variant tv JOIN dims d ON tv.round_id = d.round_id""", "prediction_score", "assay_score"))
def q_c1(spark, d):
    """The five-way log join for the latest runs, all strategies."""
    return _score_trace(spark, d)


@register("J2", with_(*BASE) + """
SELECT sr.run_id, rnd.round_num, count(*) AS n_variants, count(DISTINCT tv.variant_id) AS n_distinct
FROM b_top_variant tv JOIN b_round rnd ON tv.round_id = rnd.round_id
JOIN b_simulation s ON rnd.simulation_id = s.simulation_id
JOIN b_sub_run sr ON s.sub_run_id = sr.sub_run_id
GROUP BY sr.run_id, rnd.round_num""")
def q_j2(spark, d):
    """Four-way join without the run table, all runs."""
    log = R.RunLog.bound(spark, d)
    j = R.log_join(log, with_run=False)
    return finish(j.groupBy("run_id", "round_num").agg(
        F.count(F.lit(1)).alias("n_variants"), F.countDistinct("variant_id").alias("n_distinct")))


@register("J3", rounded(with_(*BASE, extra={"latest": "SELECT * FROM b_run", "dims": DIMS}) + """
, st AS (SELECT run_id, avg(test_rmse) AS avg_value, stddev_samp(test_rmse) AS std_value
         FROM dims GROUP BY run_id)
SELECT d.round_id, d.run_id, d.test_rmse, st.avg_value, st.std_value
FROM dims d JOIN st ON d.run_id = st.run_id""", "test_rmse", "avg_value", "std_value"))
def q_j3(spark, d):
    log = R.RunLog.bound(spark, d)
    dims = R.round_dimension(log).select("round_id", "run_id", "test_rmse")
    return finish(R.with_group_stats(dims, "test_rmse", ["run_id"]))


@register("J8", rounded(W() + """
SELECT tv.round_id, tv.variant_id, tv.assay_score FROM b_top_variant tv
WHERE tv.round_id IN (SELECT round_id FROM dims)""", "assay_score"))
def q_j8(spark, d):
    """Semi join: top variants whose round belongs to a latest run."""
    log, runs = _log(spark, d)
    rounds = R.round_dimension(log, runs).select("round_id")
    return finish(log.top_variant.join(rounds, "round_id", "left_semi")
                  .select("round_id", "variant_id", "assay_score"))


# ---------------------------------------------------------------- retention

_PURGE_SQL = with_("b_run", "b_sub_run", "b_simulation", "b_round", "b_top_variant", "b_acquired",
                   "b_last_round", extra={"latest": LATEST}) + """
, sr AS (SELECT * FROM b_sub_run WHERE run_id IN (SELECT run_id FROM latest)),
sim AS (SELECT * FROM b_simulation WHERE sub_run_id IN (SELECT sub_run_id FROM sr)),
rnd AS (SELECT * FROM b_round WHERE simulation_id IN (SELECT simulation_id FROM sim))
SELECT 'run' AS table_name, count(*) AS kept_rows FROM latest
UNION ALL SELECT 'sub_run', count(*) FROM sr
UNION ALL SELECT 'simulation', count(*) FROM sim
UNION ALL SELECT 'round', count(*) FROM rnd
UNION ALL SELECT 'round_top_variant', count(*) FROM b_top_variant WHERE round_id IN (SELECT round_id FROM rnd)
UNION ALL SELECT 'round_acquired_variant', count(*) FROM b_acquired WHERE round_id IN (SELECT round_id FROM rnd)
UNION ALL SELECT 'last_round_score', count(*) FROM b_last_round WHERE simulation_id IN (SELECT simulation_id FROM sim)"""


@register("U4", _PURGE_SQL)
def q_u4(spark, d):
    """Written, purged and read back: rows left in each stored table."""
    from .sources_q import stored_log

    store = stored_log(spark, R.RunLog.bound(spark, d))
    store.purge(R.latest_completed_runs(store.read("run")))
    out = None
    for name in RUN_TABLES:
        df = store.read(name)
        c = df.agg(F.count(F.lit(1)).alias("kept_rows")).select(F.lit(name).alias("table_name"), "kept_rows")
        out = c if out is None else out.unionByName(c)
    return finish(out)


@register("U5", rounded("""
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events,
       arg_max(event_type, (ts, event_id)) AS last_event_type,
       arg_max(value, (ts, event_id)) AS last_value
FROM events GROUP BY user_id""", "last_value"))
def q_u5(spark, d):
    """Last-state fold over an append-only lifecycle event table (events)."""
    ev = table(spark, d, "events")
    return finish(R.run_state(ev, "user_id", "ts", "event_id", ["event_type", "value"]))


# ---------------------------------------------------------------- explicit ids for combined entries

@register("J1", W() + """SELECT d.run_id, d.strategy_name, count(*) AS n_rows, count(DISTINCT tv.variant_id) AS n_variants
FROM b_top_variant tv JOIN dims d ON tv.round_id = d.round_id GROUP BY d.run_id, d.strategy_name""")
def q_j1(spark, d):
    """Five-way log join (top_variant ⋈ round ⋈ simulation ⋈ sub_run ⋈ run)."""
    log, runs = _log(spark, d)
    j = R.log_join(log, runs=runs)
    return finish(j.groupBy("run_id", "strategy_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("variant_id").alias("n_variants")))


@register("W5", rounded(f"SELECT run_id, sub_run_id, end_round_num, total_rank, final_rank FROM ({ORACLE_C9})",
                        "total_rank"))
def q_w5(spark, d):
    """Final place by weighted total rank within each end round."""
    log, runs = _log(spark, d)
    return finish(R.run_metrics(log, runs).select("run_id", "sub_run_id", "end_round_num", "total_rank",
                                                  "final_rank"))
