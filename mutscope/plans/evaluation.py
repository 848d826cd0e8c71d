"""Composite evaluation analyses (C2–C8): one DataFrame job for every run at once.

Each analysis starts from the run log (latest completed runs), attaches
class labels from a label strategy, and reports per run (and round/domain)
— the reference loops over datasets and runs in Python; here the loop is a
grouping key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import domains as D
from ..operators import runlog as R
from ..operators import stats as S
from ..util import bounded_broadcast, materialize

# Fixed domain layout used by the binding (name, start, end; inclusive, 1-based).
DOMAINS = (("A", 1, 10), ("B", 11, 30), ("C", 31, 50), ("D", 5, 15))


def domain_table(datasets: DataFrame) -> DataFrame:
    """Domain intervals for every dataset (exploded from a literal array)."""
    arr = F.array(*[F.struct(F.lit(n).alias("domain"), F.lit(s).alias("start_pos"), F.lit(e).alias("end_pos"))
                    for n, s, e in DOMAINS])
    return (datasets.select("dataset_name").distinct()
            .select("dataset_name", F.inline(arr)))


def last_round_results(log: R.RunLog, runs: DataFrame, variants: DataFrame) -> DataFrame:
    """A3 per run with substitution ids (L9Q form) and positions from the
    variant table (part_id = the logged numeric variant id)."""
    a3 = R.last_round_ensemble(log, runs)
    v = variants.select("part_id", F.col("variant_id").alias("variant"), "position")
    j = a3.join(v, a3.variant_id.cast("long") == v.part_id).drop("variant_id")
    out = (j.join(bounded_broadcast(runs.select("run_id", "dataset_name")), "run_id")
           .withColumnRenamed("variant", "variant_id"))
    # one row per (run, variant): far smaller than the log, read by several
    # aggregates downstream — written once instead of recomputing the log join
    return materialize(out, "results")


def quantile_labels(df: DataFrame, keys, lof_q: float = 0.3, gof_q: float = 0.7) -> DataFrame:
    """L5 on the distinct (variant, assay) rows of each run."""
    base = df.select(*keys, "part_id", "assay_score").distinct()
    return L.label_strategy("quantile", lof_q=lof_q, gof_q=gof_q)(base, list(keys), "assay_score")


def auc_by_domain(results: DataFrame, domains: DataFrame) -> DataFrame:
    """Labels → domain join → AUC, Youden threshold and class counts per
    (run, domain)."""
    lab = quantile_labels(results, ["run_id"])
    r = D.attach_label(results, lab, ["run_id", "part_id", "assay_score"])
    j = D.join_domains(r, domains).select("run_id", "domain", "prediction_score", "label")
    keys = ["run_id", "domain"]
    auc, curve = S.roc_summary(j, keys, "prediction_score", "label")
    yj = S.youden_point(curve, keys).select(*keys, F.col("threshold").alias("optimal_threshold"))
    return auc.join(yj, keys, "left")


def signed_error_by_domain(results: DataFrame, domains: DataFrame, standardise: bool = False) -> DataFrame:
    """C4: mean signed error per (run, domain), optionally on scores
    standardised within each run."""
    r = results
    if standardise:
        r = S.standardise(r, ["assay_score", "prediction_score"], ["run_id"])
    return D.signed_error_by_domain(r, domains, ["run_id"])


def roc_export(results: DataFrame) -> DataFrame:
    """The ROC curve per run (one point per distinct prediction)."""
    lab = quantile_labels(results, ["run_id"])
    r = D.attach_label(results, lab, ["run_id", "part_id", "assay_score"])
    return S.roc_curve(r, ["run_id"], "prediction_score", "label")


def landscape_with_thresholds(results: DataFrame) -> DataFrame:
    """Per-position landscape plus the run's class thresholds."""
    lab = quantile_labels(results, ["run_id"])
    r = D.attach_label(results, lab, ["run_id", "part_id", "assay_score"])
    land = D.landscape_by_position(r, ["run_id"])
    return land.join(D.class_thresholds(r, ["run_id"]), "run_id")


def auc_by_round(log: R.RunLog, runs: DataFrame, baseline_runs: DataFrame, baseline_round: int = 2) -> DataFrame:
    """Per (run, round) AUC of the variant-level mean prediction, with the
    AUC of a baseline and the class counts of simulation 1, round 1.

    The baseline is every prediction of round ``baseline_round`` of
    ``baseline_runs`` (another configuration and run) on the same dataset,
    judged by the run's own class labels; NULL where no baseline run of the
    dataset has a labelled variant.
    """
    roles = runs.select("run_id", "dataset_name", F.lit(False).alias("is_base")).union(
        baseline_runs.select("run_id", "dataset_name", F.lit(True)))
    wanted = roles.select("run_id").distinct()
    dims = R.round_dimension(log, wanted).select("round_id", "run_id", "round_num", "simulation_num")
    trace = log.top_variant.join(dims, "round_id").select(
        "run_id", "variant_id", "round_num", "simulation_num", "prediction_score", "assay_score")
    # labels, curves and the baseline read it
    trace = materialize(trace, "trace").join(bounded_broadcast(roles), "run_id")
    main = trace.where("not is_base")
    per_var = main.groupBy("run_id", "dataset_name", "variant_id").agg(F.avg("assay_score").alias("assay_score"))
    lab = materialize(per_var, "variants")
    lab = L.label_strategy("quantile", lof_q=0.3, gof_q=0.7)(lab, ["run_id"], "assay_score")
    lab = materialize(lab.select("run_id", "dataset_name", "variant_id", "label"), "labels")
    t = D.attach_label(main, lab, ["run_id", "variant_id"])
    keys = ["run_id", "round_num"]
    ens = D.round_ensemble(t, ["run_id"]).select(*keys, F.col("mean_prediction").alias("score"), "label")
    base = (trace.where(F.col("is_base") & (F.col("round_num") == baseline_round)).select("dataset_name", "variant_id", "prediction_score")
            .join(lab, ["dataset_name", "variant_id"])
            .select("run_id", F.lit(None).cast("int").alias("round_num"), F.col("prediction_score").alias("score"), "label"))
    # the baseline is one more curve of the run, without a round: one ordered scan for all
    auc, curve = S.roc_summary(ens.unionByName(base), keys, "score", "label")
    yj = S.youden_point(curve.where("round_num is not null"), keys).select(*keys, F.col("threshold").alias("optimal_threshold"))
    base_auc = auc.where("round_num is null").select("run_id", F.col("auc").alias("llr_auc"))
    counts = D.class_counts(t.filter((F.col("simulation_num") == 1) & (F.col("round_num") == 1)), ["run_id"])
    rounds = auc.where("round_num is not null").select(*keys, "auc")
    return rounds.join(yj, keys, "left").join(base_auc, "run_id", "left").join(counts, "run_id", "left")


def mean_activity_vs_baseline(log: R.RunLog, runs: DataFrame, baseline_model: str = "llr",
                              baseline_round: int = 2) -> DataFrame:
    """A1 per strategy of every run next to the run's zero-shot reference
    (mean over ``baseline_model`` strategies at ``baseline_round``)."""
    # the model comes with each round's own sub-run: one strategy name may
    # occur under several models and runs
    a1 = R.mean_activity_by_round(log, runs, by=("model_name",))
    base = (a1.filter((F.col("model_name") == baseline_model) & (F.col("round_num") == baseline_round))
            .groupBy("run_id").agg(F.avg("mean_score").alias("baseline_score")))
    return (a1.join(base, "run_id", "left")
            .withColumn("delta_vs_baseline", F.col("mean_score") - F.col("baseline_score")))


def calibration(results: DataFrame, clinical: DataFrame, gene_map: DataFrame) -> DataFrame:
    """Results ⋈ clinical labels of the dataset's gene (default gene =
    dataset name), prediction sign flipped, class counts and AUC per run.
    A dataset named several times in the map has the first gene by name."""
    genes = gene_map.groupBy("dataset_name").agg(F.min("gene_symbol").alias("gene_symbol"))
    r = results.join(bounded_broadcast(genes), "dataset_name", "left").withColumn(
        "gene_symbol", F.coalesce("gene_symbol", "dataset_name"))
    j = r.join(clinical.select("gene_symbol", "variant_id", "label"), ["gene_symbol", "variant_id"])
    j = j.withColumn("prediction_score", D.sign_flip("prediction_score"))
    counts = D.class_counts(j, ["run_id"])
    auc = S.roc_auc(j, ["run_id"], "prediction_score", "label").select("run_id", "auc")
    return counts.join(auc, "run_id")
