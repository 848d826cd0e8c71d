"""Catalog entries for domains, landscapes, class summaries and the composite
analyses (J4, J4_check, J5, J7, W6, A10–A14, A19, A22–A24, A26, C2–C8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import domains as D
from ..operators import runlog as R
from ..plans import evaluation as EV
from ..session import table
from ..sources import bindings as B
from ..util import finish
from .bind_sql import rounded, with_
from .registry import register
from .runlog_q import BASE, DIMS, LATEST
from .variants_q import _CLIN_CTE, _CLIN_SQL, _H_CTE, _clinical, _hgvs_sql_expr, clinical_labels

# ---------------------------------------------------------------- SQL generators

A3_CTES = """, src AS (
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
ms AS (SELECT run_id, avg(prediction_score) AS m, stddev_samp(prediction_score) AS s FROM pred GROUP BY run_id),
a3 AS (SELECT p.run_id, variant_id, assay_score, prediction_score, num_variants,
              round((prediction_score - m) / s, 3) AS z_score FROM pred p JOIN ms ON p.run_id = ms.run_id),
res AS (SELECT a3.run_id, r.dataset_name, v.part_id, v.variant_id, v.position, a3.assay_score,
               a3.prediction_score, a3.num_variants, a3.z_score
        FROM a3 JOIN b_variant v ON CAST(a3.variant_id AS BIGINT) = v.part_id JOIN latest r ON a3.run_id = r.run_id),
lb AS (SELECT DISTINCT run_id, part_id, assay_score FROM res),
lq AS (SELECT run_id, quantile_cont(assay_score, 0.7) AS gof, quantile_cont(assay_score, 0.3) AS lof
       FROM lb GROUP BY run_id),
lab AS (SELECT lb.run_id, lb.part_id, lb.assay_score,
               CASE WHEN lb.assay_score > lq.gof THEN 1 WHEN lb.assay_score <= lq.lof THEN 0 END AS label
        FROM lb JOIN lq ON lb.run_id = lq.run_id),
rl AS (SELECT res.*, lab.label FROM res JOIN lab ON res.run_id = lab.run_id AND res.part_id = lab.part_id
       AND res.assay_score = lab.assay_score WHERE lab.label IS NOT NULL),
dom AS (SELECT ds.dataset_name, d.domain, d.start_pos, d.end_pos
        FROM (SELECT DISTINCT dataset_name FROM latest) ds
        CROSS JOIN (VALUES ('A', 1, 10), ('B', 11, 30), ('C', 31, 50), ('D', 5, 15)) d(domain, start_pos, end_pos))
"""


def WR():
    return with_(*BASE, "b_last_round", "b_variant", extra={"latest": LATEST, "dims": DIMS}) + A3_CTES


def sql_auc(src: str, keys: str, score: str, label: str = "label") -> str:
    return f"""SELECT {keys}, CASE WHEN sum({label}) * (count(*) - sum({label})) = 0 THEN NULL ELSE
  (sum(CASE WHEN {label} = 1 THEN ar END) - sum({label}) * (sum({label}) + 1) / 2.0)
  / (sum({label}) * (count(*) - sum({label}))) END AS auc,
  CAST(sum({label}) AS BIGINT) AS n_pos, CAST(count(*) - sum({label}) AS BIGINT) AS n_neg
FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY {score})
            + (count(*) OVER (PARTITION BY {keys}, {score}) - 1) / 2.0 AS ar
      FROM {src} WHERE {score} IS NOT NULL AND {label} IS NOT NULL) GROUP BY {keys}"""


def sql_roc(src: str, keys: str, score: str, label: str = "label") -> str:
    v = f"""(SELECT {keys}, {score} AS s, CAST(sum({label}) AS BIGINT) AS p, CAST(count(*) - sum({label}) AS BIGINT) AS n
             FROM {src} WHERE {score} IS NOT NULL AND {label} IS NOT NULL GROUP BY {keys}, {score})"""
    return f"""SELECT {keys}, threshold, tp, fp, CASE WHEN P = 0 THEN NULL ELSE tp / P END AS tpr,
  CASE WHEN N = 0 THEN NULL ELSE fp / N END AS fpr,
  (CASE WHEN P = 0 THEN NULL ELSE tp / P END) - (CASE WHEN N = 0 THEN NULL ELSE fp / N END) AS youden
FROM (SELECT {keys}, CAST(s AS DOUBLE) AS threshold,
             CAST(sum(p) OVER (PARTITION BY {keys} ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp,
             CAST(sum(n) OVER (PARTITION BY {keys} ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fp,
             sum(p) OVER (PARTITION BY {keys}) AS P, sum(n) OVER (PARTITION BY {keys}) AS N FROM {v}
      UNION ALL SELECT {keys}, NULL, 0, 0, sum(p), sum(n) FROM {v} GROUP BY {keys})"""


def sql_youden(roc: str, keys: str) -> str:
    return f"""SELECT {keys}, nullif(arg_max(coalesce(threshold, 'inf'::DOUBLE),
  (youden, coalesce(threshold, 'inf'::DOUBLE))), 'inf'::DOUBLE) AS optimal_threshold
FROM {roc} WHERE youden IS NOT NULL GROUP BY {keys}"""


# ---------------------------------------------------------------- Spark bindings

def _ctx(spark, d):
    log, runs = R.RunLog.bound(spark, d), None
    runs = R.latest_completed_runs(log.run)
    return log, runs


def _results(spark, d):
    log, runs = _ctx(spark, d)
    return EV.last_round_results(log, runs, B.variants(spark, d)), runs


def _labelled(spark, d):
    res, runs = _results(spark, d)
    lab = EV.quantile_labels(res, ["run_id"])
    return D.attach_label(res, lab, ["run_id", "part_id", "assay_score"]), runs


_RES_COLS = ("assay_score", "prediction_score", "z_score")


@register("J5", rounded(WR() + "SELECT * FROM rl", *_RES_COLS))
def q_j5(spark, d):
    """Last-round results ⋈ class labels (inner; unlabeled rows dropped)."""
    r, _ = _labelled(spark, d)
    return finish(r)


@register("J4_check", WR() + """SELECT run_id, part_id, assay_score, count(*) AS n
FROM (SELECT * FROM lab WHERE label IS NOT NULL UNION ALL SELECT * FROM lab WHERE label IS NOT NULL AND part_id % 50 = 0)
GROUP BY run_id, part_id, assay_score HAVING count(*) > 1""")
def q_j4c(spark, d):
    """J4 uniqueness check of the label side; some labels occur twice here."""
    res, _ = _results(spark, d)
    lab = EV.quantile_labels(res, ["run_id"])
    lab = lab.unionByName(lab.filter(F.col("part_id") % 50 == 0))
    return finish(D.duplicate_labels(lab, ["run_id", "part_id", "assay_score"]))


@register("J7", rounded(WR() + """SELECT res.*, dom.domain, dom.start_pos, dom.end_pos FROM res JOIN dom
  ON res.dataset_name = dom.dataset_name AND res.position BETWEEN dom.start_pos AND dom.end_pos""", *_RES_COLS))
def q_j7(spark, d):
    res, runs = _results(spark, d)
    return finish(D.join_domains(res, EV.domain_table(runs)))


@register("A19", rounded(WR() + """SELECT res.run_id, dom.domain, dom.start_pos, dom.end_pos,
  avg(res.prediction_score - res.assay_score) AS metric FROM res JOIN dom
  ON res.dataset_name = dom.dataset_name AND res.position BETWEEN dom.start_pos AND dom.end_pos
  GROUP BY res.run_id, dom.domain, dom.start_pos, dom.end_pos""", "metric"))
def q_a19(spark, d):
    res, runs = _results(spark, d)
    return finish(EV.signed_error_by_domain(res, EV.domain_table(runs)))


@register("C4", rounded(WR() + """, sd AS (SELECT res.* REPLACE (
    (assay_score - avg(assay_score) OVER (PARTITION BY run_id)) / stddev_samp(assay_score) OVER (PARTITION BY run_id) AS assay_score,
    (prediction_score - avg(prediction_score) OVER (PARTITION BY run_id)) / stddev_samp(prediction_score) OVER (PARTITION BY run_id) AS prediction_score)
  FROM res)
SELECT sd.run_id, dom.domain, dom.start_pos, dom.end_pos, avg(sd.prediction_score - sd.assay_score) AS metric
FROM sd JOIN dom ON sd.dataset_name = dom.dataset_name AND sd.position BETWEEN dom.start_pos AND dom.end_pos
GROUP BY sd.run_id, dom.domain, dom.start_pos, dom.end_pos""", "metric"))
def q_c4(spark, d):
    """C4: mean signed error by domain on scores standardised within each run."""
    res, runs = _results(spark, d)
    return finish(EV.signed_error_by_domain(res, EV.domain_table(runs), standardise=True))


@register("C3", rounded(WR() + f""", rd AS (SELECT rl.*, dom.domain FROM rl JOIN dom ON rl.dataset_name = dom.dataset_name
  AND rl.position BETWEEN dom.start_pos AND dom.end_pos),
auc AS ({sql_auc('rd', 'run_id, domain', 'prediction_score')}),
roc AS ({sql_roc('rd', 'run_id, domain', 'prediction_score')}),
yj AS ({sql_youden('roc', 'run_id, domain')})
SELECT auc.*, yj.optimal_threshold FROM auc LEFT JOIN yj ON auc.run_id = yj.run_id AND auc.domain = yj.domain""",
                        "auc", "optimal_threshold"))
def q_c3(spark, d):
    res, runs = _results(spark, d)
    return finish(EV.auc_by_domain(res, EV.domain_table(runs)))


@register("C5", rounded(WR() + f", roc AS ({sql_roc('rl', 'run_id', 'prediction_score')}) SELECT * FROM roc",
                        "threshold", "tpr", "fpr", "youden"))
def q_c5(spark, d):
    res, _ = _results(spark, d)
    return finish(EV.roc_export(res))


_LAND = """, lk AS (SELECT *, TRY_CAST(substr(variant_id, 2, length(variant_id) - 2) AS INTEGER) - 1 AS mutation_position,
  CASE WHEN instr('LAGVSERTIDPKQNFYMHWCXBUZO', substr(variant_id, -1, 1)) > 0
       THEN instr('LAGVSERTIDPKQNFYMHWCXBUZO', substr(variant_id, -1, 1)) - 1 END AS mutation_aa_index,
  (assay_score - prediction_score) * (assay_score - prediction_score) AS squared_error FROM {src}),
lk2 AS (SELECT *, round_even((mutation_position * 25 + mutation_aa_index) / 25.0::DOUBLE, 2) AS mutation_position_aa_index
        FROM lk WHERE mutation_position IS NOT NULL)
"""


@register("C6", rounded(WR() + _LAND.format(src="rl") + """, land AS (SELECT run_id, mutation_position,
  avg(assay_score) AS assay_score, avg(prediction_score) AS prediction_score, avg(squared_error) AS squared_error,
  count(*) AS count FROM lk2 GROUP BY run_id, mutation_position),
th AS (SELECT run_id, min(CASE WHEN label = 1 THEN assay_score END) AS gof_min,
              max(CASE WHEN label = 0 THEN assay_score END) AS lof_max FROM rl GROUP BY run_id)
SELECT land.*, th.gof_min, th.lof_max FROM land JOIN th ON land.run_id = th.run_id""",
                        "assay_score", "prediction_score", "squared_error", "gof_min", "lof_max"))
def q_c6(spark, d):
    res, _ = _results(spark, d)
    return finish(EV.landscape_with_thresholds(res))


@register("A10", rounded(WR() + _LAND.format(src="res") + """SELECT run_id, mutation_position,
  avg(assay_score) AS assay_score, avg(prediction_score) AS prediction_score, avg(squared_error) AS squared_error,
  count(*) AS count FROM lk2 GROUP BY run_id, mutation_position""", "assay_score", "prediction_score", "squared_error"))
def q_a10(spark, d):
    res, _ = _results(spark, d)
    return finish(D.landscape_by_position(res, ["run_id"]))


def _a11_sql(num_bins: int) -> str:
    return rounded(WR() + _LAND.format(src="res") + f""", st AS (SELECT run_id, min(mutation_position) - 1 AS lo,
  count(*) AS nrows, CAST(greatest(1, floor((max(mutation_position) - min(mutation_position) + 1) / {num_bins})) AS INTEGER) AS w
  FROM lk2 GROUP BY run_id),
bn AS (SELECT lk2.*, CASE WHEN st.nrows < {num_bins} THEN lk2.mutation_position_aa_index
  ELSE CAST(floor((2 * st.lo + (2 * ceil((lk2.mutation_position - st.lo) / st.w) - 1) * st.w) / 2) AS DOUBLE) END AS position_bin
  FROM lk2 JOIN st ON lk2.run_id = st.run_id)
SELECT run_id, position_bin, avg(assay_score) AS assay_score, avg(prediction_score) AS prediction_score,
  avg(squared_error) AS squared_error, count(*) AS count FROM bn GROUP BY run_id, position_bin""",
                   "position_bin", "assay_score", "prediction_score", "squared_error")


@register("A11", _a11_sql(7))
def q_a11(spark, d):
    res, _ = _results(spark, d)
    return finish(D.landscape_by_bin(res, ["run_id"], 7))


@register("A11_raw", _a11_sql(100000))
def q_a11r(spark, d):
    """A11 with more bins than rows: the raw position/residue key is kept."""
    res, _ = _results(spark, d)
    return finish(D.landscape_by_bin(res, ["run_id"], 100000))


@register("A13", WR() + """SELECT run_id, CAST(sum(label) AS BIGINT) AS num_positive,
  CAST(sum(1 - label) AS BIGINT) AS num_negative FROM rl GROUP BY run_id""")
def q_a13(spark, d):
    r, _ = _labelled(spark, d)
    return finish(D.class_counts(r, ["run_id"]))


@register("A14", rounded(WR() + """SELECT run_id, min(CASE WHEN label = 1 THEN assay_score END) AS gof_min,
  max(CASE WHEN label = 0 THEN assay_score END) AS lof_max FROM rl GROUP BY run_id""", "gof_min", "lof_max"))
def q_a14(spark, d):
    r, _ = _labelled(spark, d)
    return finish(D.class_thresholds(r, ["run_id"]))


@register("A23", rounded(WR() + """SELECT run_id, label, min(prediction_score) AS min_score,
  max(prediction_score) AS max_score FROM rl GROUP BY run_id, label""", "min_score", "max_score"))
def q_a23(spark, d):
    r, _ = _labelled(spark, d)
    return finish(D.class_ranges(r, ["run_id"], "prediction_score"))


@register("A24", rounded(WR() + "SELECT DISTINCT run_id, variant_id, assay_score FROM res", "assay_score"))
def q_a24(spark, d):
    res, _ = _results(spark, d)
    return finish(res.select("run_id", "variant_id", "assay_score").dropDuplicates())


@register("A24_strategies", with_("b_sub_run") + "SELECT DISTINCT model_name FROM b_sub_run")
def q_a24s(spark, d):
    return finish(R.RunLog.bound(spark, d).sub_run.select("model_name").dropDuplicates())


@register("A12", rounded(with_(*BASE, extra={"latest": LATEST, "dims": DIMS}) + """
, tr AS (SELECT d.run_id, tv.variant_id, d.round_num, tv.prediction_score,
                CASE WHEN tv.assay_score > 25 THEN 1 ELSE 0 END AS label
         FROM b_top_variant tv JOIN dims d ON tv.round_id = d.round_id)
SELECT run_id, variant_id, round_num, avg(prediction_score) AS mean_prediction, max(label) AS label
FROM tr GROUP BY run_id, variant_id, round_num""", "mean_prediction"))
def q_a12(spark, d):
    log, runs = _ctx(spark, d)
    tr = log.top_variant.join(R.round_dimension(log, runs), "round_id").withColumn(
        "label", F.when(F.col("assay_score") > 25, 1).otherwise(0))
    return finish(D.round_ensemble(tr, ["run_id"]))


@register("A22", _CLIN_SQL + """, cl AS (SELECT coalesce(gene_symbol, '') AS gene_symbol,
  CAST(category = 'LP/P' AS INTEGER) AS label FROM clin WHERE stars >= 1 AND category <> 'US')
SELECT gene_symbol, CAST(count(*) FILTER (WHERE label = 0) AS BIGINT) AS "0",
       CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS "1" FROM cl GROUP BY gene_symbol""")
def q_a22(spark, d):
    lab = clinical_labels(_clinical(spark, d))
    return finish(D.label_pivot(lab, "gene_symbol"))


@register("A26", """SELECT p_brand AS dataset_name, count(*) AS num_variants,
  CAST(CASE WHEN count(*) < 500 THEN floor(count(*) * 0.1) ELSE 100 END AS BIGINT) AS batch_size,
  CAST(floor(count(*) * 0.2) AS BIGINT) AS num_variants_first_round FROM part GROUP BY p_brand""")
def q_a26(spark, d):
    return finish(D.batch_size_plan(B.variants(spark, d)))


@register("A26_large", """SELECT l_returnflag AS dataset_name, count(*) AS num_variants,
  CAST(CASE WHEN count(*) < 500 THEN floor(count(*) * 0.1) ELSE 100 END AS BIGINT) AS batch_size,
  CAST(floor(count(*) * 0.2) AS BIGINT) AS num_variants_first_round FROM lineitem GROUP BY l_returnflag""")
def q_a26l(spark, d):
    """A26 on datasets above the 500-variant cut (fixed batch of 100)."""
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("dataset_name"))
    return finish(D.batch_size_plan(li))


def _intervals(spark, d):
    o = table(spark, d, "orders")
    start = F.datediff(F.col("o_orderdate"), F.lit("1992-01-01").cast("date"))
    return o.select(F.col("o_custkey").alias("k"), start.alias("start_pos"),
                    (start + (F.col("o_orderkey") % 10).cast("int")).alias("end_pos"))


def _w6_sql(gap: int) -> str:
    return f"""WITH iv AS (SELECT o_custkey AS k,
    CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS start_pos,
    CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) + CAST(o_orderkey % 10 AS INTEGER) AS end_pos
  FROM orders),
bs AS (SELECT k, start_pos, max(end_pos) AS e FROM iv GROUP BY k, start_pos),
p AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY start_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM bs),
f AS (SELECT *, CASE WHEN prev IS NULL OR start_pos > prev + {gap} THEN 1 ELSE 0 END AS new FROM p),
b AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY start_pos ROWS UNBOUNDED PRECEDING) AS blk FROM f)
SELECT k, min(start_pos) AS start_pos, max(e) AS end_pos FROM b GROUP BY k, blk"""


@register("W6", _w6_sql(1))
def q_w6(spark, d):
    return finish(D.merge_intervals(_intervals(spark, d), ["k"], gap=1))


@register("W6_gap5", _w6_sql(5))
def q_w6g(spark, d):
    return finish(D.merge_intervals(_intervals(spark, d), ["k"], gap=5))


_C2_SQL = with_(*BASE, extra={"latest": LATEST, "dims": DIMS}) + f"""
, zs AS (SELECT run_id, dataset_name FROM b_run WHERE run_id < 2),
trace AS (SELECT d.run_id, tv.variant_id, d.model_name, d.round_num, d.simulation_num, tv.prediction_score,
                   tv.assay_score FROM b_top_variant tv JOIN dims d ON tv.round_id = d.round_id),
pv AS (SELECT run_id, variant_id, avg(assay_score) AS assay_score FROM trace GROUP BY run_id, variant_id),
q AS (SELECT run_id, quantile_cont(assay_score, 0.7) AS gof, quantile_cont(assay_score, 0.3) AS lof FROM pv GROUP BY run_id),
lab AS (SELECT pv.run_id, pv.variant_id, CASE WHEN pv.assay_score > q.gof THEN 1 WHEN pv.assay_score <= q.lof THEN 0 END AS label
        FROM pv JOIN q ON pv.run_id = q.run_id),
t AS (SELECT trace.* EXCLUDE (assay_score), lab.label FROM trace JOIN lab ON trace.run_id = lab.run_id
      AND trace.variant_id = lab.variant_id WHERE lab.label IS NOT NULL),
ens AS (SELECT run_id, variant_id, round_num, avg(prediction_score) AS mean_prediction, max(label) AS label
        FROM t GROUP BY run_id, variant_id, round_num),
auc AS ({sql_auc('ens', 'run_id, round_num', 'mean_prediction')}),
roc AS ({sql_roc('ens', 'run_id, round_num', 'mean_prediction')}),
yj AS ({sql_youden('roc', 'run_id, round_num')}),
base AS (SELECT lab.run_id, tv.prediction_score, lab.label FROM b_top_variant tv JOIN b_round r ON tv.round_id = r.round_id
  JOIN b_simulation s ON r.simulation_id = s.simulation_id JOIN b_sub_run sr ON s.sub_run_id = sr.sub_run_id
  JOIN zs ON sr.run_id = zs.run_id JOIN latest ON latest.dataset_name = zs.dataset_name
  JOIN lab ON lab.run_id = latest.run_id AND lab.variant_id = tv.variant_id WHERE r.round_num = 2 AND lab.label IS NOT NULL),
bauc AS ({sql_auc('base', 'run_id', 'prediction_score')}),
cnt AS (SELECT run_id, CAST(sum(label) AS BIGINT) AS num_positive, CAST(sum(1 - label) AS BIGINT) AS num_negative
        FROM t WHERE simulation_num = 1 AND round_num = 1 GROUP BY run_id)
SELECT auc.run_id, auc.round_num, auc.auc, yj.optimal_threshold, bauc.auc AS llr_auc, cnt.num_positive, cnt.num_negative
FROM auc LEFT JOIN yj ON auc.run_id = yj.run_id AND auc.round_num = yj.round_num
LEFT JOIN bauc ON auc.run_id = bauc.run_id LEFT JOIN cnt ON auc.run_id = cnt.run_id"""


@register("C2", rounded(_C2_SQL, "auc", "optimal_threshold", "llr_auc"))
def q_c2(spark, d):
    """AUC by round, next to a baseline of another configuration's run on the same dataset."""
    log, runs = _ctx(spark, d)
    return finish(EV.auc_by_round(log, runs, B.zero_shot_runs(spark, d)))


@register("C7", rounded(with_(*BASE, extra={"latest": LATEST, "dims": DIMS}) + """
, rs AS (SELECT d.run_id, d.strategy_name, d.round_num, d.num_variants, d.round_id, avg(tv.assay_score) AS mean_score
         FROM b_top_variant tv JOIN dims d ON tv.round_id = d.round_id
         GROUP BY d.run_id, d.strategy_name, d.round_num, d.num_variants, d.round_id),
a1 AS (SELECT run_id, strategy_name, round_num, num_variants, avg(mean_score) AS mean_score,
              stddev_samp(mean_score) AS stddev FROM rs GROUP BY run_id, strategy_name, round_num, num_variants),
a1m AS (SELECT a1.*, sr.model_name FROM a1 JOIN (SELECT DISTINCT strategy_name, model_name FROM b_sub_run) sr
        ON a1.strategy_name = sr.strategy_name),
base AS (SELECT run_id, avg(mean_score) AS baseline_score FROM a1m WHERE model_name = 'llr' AND round_num = 2 GROUP BY run_id)
SELECT a1m.*, base.baseline_score, a1m.mean_score - base.baseline_score AS delta_vs_baseline
FROM a1m LEFT JOIN base ON a1m.run_id = base.run_id""", "mean_score", "stddev", "baseline_score", "delta_vs_baseline"))
def q_c7(spark, d):
    log, runs = _ctx(spark, d)
    return finish(EV.mean_activity_vs_baseline(log, runs))


@register("C8", rounded(WR() + f""", h AS ({_H_CTE}), clin AS ({_CLIN_CTE})
, cl AS (SELECT coalesce(gene_symbol, '') AS gene_symbol, {_hgvs_sql_expr('protein_change')} AS variant_id,
                CAST(category = 'LP/P' AS INTEGER) AS label FROM clin WHERE stars >= 1 AND category <> 'US'),
gm AS (SELECT dataset_name, CASE WHEN dataset_name = 'ds0' THEN 'EN' END AS gene_symbol FROM latest),
rg AS (SELECT res.*, coalesce(gm.gene_symbol, res.dataset_name) AS gene_symbol FROM res
       LEFT JOIN gm ON res.dataset_name = gm.dataset_name),
j AS (SELECT rg.run_id, -rg.prediction_score AS prediction_score, cl.label FROM rg
      JOIN cl ON rg.gene_symbol = cl.gene_symbol AND rg.variant_id = cl.variant_id),
auc AS ({sql_auc('j', 'run_id', 'prediction_score')})
SELECT j.run_id, CAST(sum(label) AS BIGINT) AS num_positive, CAST(sum(1 - label) AS BIGINT) AS num_negative,
       any_value(auc.auc) AS auc FROM j JOIN auc ON j.run_id = auc.run_id GROUP BY j.run_id""", "auc"))
def q_c8(spark, d):
    res, runs = _results(spark, d)
    clin = clinical_labels(_clinical(spark, d))
    gm = runs.select("dataset_name", F.when(F.col("dataset_name") == "ds0", F.lit("EN")).alias("gene_symbol"))
    return finish(EV.calibration(res, clin, gm))


# ---------------------------------------------------------------- explicit ids for combined entries

@register("J4", with_(*BASE, extra={"latest": LATEST, "dims": DIMS}) + """
, trace AS (SELECT d.run_id, tv.variant_id, d.round_num, d.simulation_num, tv.assay_score
            FROM b_top_variant tv JOIN dims d ON tv.round_id = d.round_id),
pv AS (SELECT run_id, variant_id, avg(assay_score) AS assay_score FROM trace GROUP BY run_id, variant_id),
q AS (SELECT run_id, quantile_cont(assay_score, 0.7) AS gof, quantile_cont(assay_score, 0.3) AS lof FROM pv GROUP BY run_id),
lab AS (SELECT pv.run_id, pv.variant_id, CASE WHEN pv.assay_score > q.gof THEN 1 WHEN pv.assay_score <= q.lof THEN 0 END AS label
        FROM pv JOIN q ON pv.run_id = q.run_id)
SELECT t.run_id, t.variant_id, t.round_num, t.simulation_num, lab.label FROM trace t
JOIN lab ON t.run_id = lab.run_id AND t.variant_id = lab.variant_id WHERE lab.label IS NOT NULL""")
def q_j4(spark, d):
    """Variant → class label map on the score trace; unlabeled rows dropped."""
    log, runs = _ctx(spark, d)
    dims = R.round_dimension(log, runs)
    trace = log.top_variant.join(dims, "round_id").select(
        "run_id", "variant_id", "round_num", "simulation_num", "assay_score")
    per_var = trace.groupBy("run_id", "variant_id").agg(F.avg("assay_score").alias("assay_score"))
    lab = EV.L.label_strategy("quantile", lof_q=0.3, gof_q=0.7)(per_var, ["run_id"], "assay_score")
    t = D.attach_label(trace.drop("assay_score"), lab, ["run_id", "variant_id"])
    return finish(t.select("run_id", "variant_id", "round_num", "simulation_num", "label"))
