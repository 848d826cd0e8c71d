"""Bind the driver's tables to the run-log / variant data model.

The run log is a five-level hierarchy run → sub_run → simulation → round →
{top_variant, acquired_variant}.  The driver's region → nation → customer →
orders → lineitem chain has exactly that shape, so the bindings below are pure
projections (plus one per-simulation ``row_number`` for ``round_num``).  The
SQL twins of every binding live in ``mutscope.catalog.bind_sql``; both must
stay in step.

Sizes at scale: run (region) and sub_run (nation) are bounded dimension
tables; simulation (customer), round (orders) and the variant tables
(lineitem) grow with the data and are never broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table

# Fixed values of the binding (they define the synthetic run parameters).
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"  # 20 standard residues, alphabetical one-letter codes
WT_LENGTH = 50  # p_size ranges over 1..50
N_ROUNDS = 10
WT_ASSAY_SCORE = 25.0


def runs(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("r_regionkey")
    return table(spark, d, "region").select(
        r.alias("run_id"),
        F.lit("al_sweep").alias("name"),
        F.col("r_name").alias("descrip"),
        F.concat(F.lit("c"), (r % 2).cast("string")).alias("config_id"),
        F.concat(F.lit("ds"), (r % 2).cast("string")).alias("dataset_name"),
        F.concat(F.lit("esm2_t"), (r * 6 + 6).cast("string"), F.lit("_model")).alias("embedder_model_name"),
        F.lit(N_ROUNDS).alias("num_rounds"),
        ((r + 1) * 100).alias("num_variants"),
        (r + 10).alias("num_variants_first_round"),
        (r % 2 + 1).alias("num_top_acq_var_per_round"),
        F.lit(3).alias("num_top_pred_var_per_round"),
        F.when(r != 0, F.lit(5)).alias("num_top_n_pred_per_round"),
        F.lit(WT_ASSAY_SCORE).alias("wt_assay_score"),
        (r % 2 == 0).alias("save_all_predictions"),
        F.to_timestamp(F.concat(F.lit("2023-12-2"), (r + 1).cast("string"))).alias("start_ts"),
        F.when(r != 2, F.to_timestamp(F.concat(F.lit("2024-01-0"), (5 - r).cast("string")))).alias("end_ts"),
    )


def zero_shot_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of another configuration over the same datasets, for analyses that compare with one: the two oldest runs."""
    return runs(spark, d).where("run_id < 2").withColumn("config_id", F.lit("zs")).withColumn("name", F.lit("zero_shot"))


def sub_runs(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        n.alias("sub_run_id"),
        F.col("n_regionkey").alias("run_id"),
        F.col("n_name").alias("strategy_name"),
        F.when(n % 3 == 0, "rf").when(n % 3 == 1, "ridge").otherwise("llr").alias("model_name"),
        F.lit("random").alias("first_round_strategy_name"),
        F.concat(F.lit('{"alpha": '), (n % 4 + 1).cast("string"),
                 F.lit(', "n_estimators": '), (n + 50).cast("string"), F.lit("}")).alias("model_parameters"),
    )


def simulations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("simulation_id"),
        F.col("c_nationkey").alias("sub_run_id"),
        (F.col("c_custkey").cast("long") / 25).cast("long").alias("simulation_num"),
    )


def _metric(t, m: int, scale: float, shift: float):
    return (t % m) / F.lit(float(scale)) + F.lit(shift)


def rounds(spark: SparkSession, d: str) -> DataFrame:
    """One row per round; ``round_num`` numbers a simulation's orders by date.

    The window is partitioned by simulation (a customer's orders), a bounded
    group in the run-log model: one simulation runs ``num_rounds`` rounds.
    """
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    t = F.col("o_totalprice")
    first = F.col("round_num") == 1
    return (
        table(spark, d, "orders")
        .select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
        .withColumn("round_num", F.row_number().over(w))
        .select(
            F.col("o_orderkey").alias("round_id"),
            F.col("o_custkey").alias("simulation_id"),
            "round_num",
            _metric(t, 1000, 1000, 0.0).alias("train_rmse"),
            (1 - _metric(t, 997, 500, 0.0)).alias("train_r2"),
            F.when(~first, _metric(t, 991, 991, -0.5)).alias("train_spearman"),
            _metric(t, 983, 983, 0.1).alias("validation_rmse"),
            (1 - _metric(t, 977, 400, 0.0)).alias("validation_r2"),
            F.when(~first, _metric(t, 971, 971, -0.3)).alias("validation_spearman"),
            _metric(t, 967, 967, 0.2).alias("test_rmse"),
            (1 - _metric(t, 953, 450, 0.0)).alias("test_r2"),
            F.when(~first, _metric(t, 947, 947, -0.4)).alias("test_spearman"),
        )
    )


def top_variants(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("round_id"),
        F.col("l_partkey").cast("string").alias("variant_id"),
        F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("variant_name"),
        F.col("l_quantity").alias("assay_score"),
        (F.col("l_extendedprice") / 2503.0).alias("prediction_score"),
    )


def acquired_variants(spark: SparkSession, d: str) -> DataFrame:
    pred = F.col("l_extendedprice") / 2503.0
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("round_id"),
        F.col("l_partkey").cast("string").alias("variant_id"),
        F.col("l_quantity").alias("assay_score"),
        pred.alias("prediction_score"),
        (pred + F.col("l_discount") * 10).alias("acquisition_score"),
        (F.col("l_linenumber") <= 2).alias("top_acquisition_score"),
        (F.col("l_linenumber") > 2).alias("top_prediction_score"),
    )


def last_round_scores(spark: SparkSession, d: str) -> DataFrame:
    """Top variants of each simulation's final round (max round_num)."""
    rnd = rounds(spark, d).select("round_id", "simulation_id", "round_num")
    last = rnd.groupBy("simulation_id").agg(F.max("round_num").alias("round_num"))
    final = rnd.join(last, ["simulation_id", "round_num"], "left_semi")
    return top_variants(spark, d).join(final, "round_id").select(
        "simulation_id", "variant_id", "assay_score", "prediction_score")


def datasets(spark: SparkSession, d: str) -> DataFrame:
    """Variant datasets are the part brands; WT residue at position i is
    ``AMINO_ACIDS[(7 i + brand_no) mod 20]``."""
    brands = table(spark, d, "part").select(F.col("p_brand").alias("dataset_name")).distinct()
    b = F.regexp_extract("dataset_name", r"#(\d+)", 1).cast("int")
    seq = F.array_join(
        F.transform(F.sequence(F.lit(1), F.lit(WT_LENGTH)),
                    lambda i: F.substring(F.lit(AMINO_ACIDS), (i * 7 + b) % 20 + 1, 1)),
        "")
    return brands.select("dataset_name", seq.alias("wt_sequence"))


def variants(spark: SparkSession, d: str) -> DataFrame:
    """One substitution per part: dataset = brand, position = p_size,
    ref = WT residue, alt = ``AMINO_ACIDS[p_partkey mod 20]``."""
    p = table(spark, d, "part")
    b = F.regexp_extract("p_brand", r"#(\d+)", 1).cast("int")
    ref = F.substring(F.lit(AMINO_ACIDS), (F.col("p_size") * 7 + b) % 20 + 1, 1)
    alt = F.substring(F.lit(AMINO_ACIDS), (F.col("p_partkey") % 20 + 1).cast("int"), 1)
    return p.select(
        F.col("p_brand").alias("dataset_name"),
        F.col("p_partkey").alias("part_id"),
        F.col("p_size").alias("position"),
        ref.alias("ref_aa"),
        alt.alias("alt_aa"),
        F.concat(ref, F.col("p_size").cast("string"), alt).alias("variant_id"),
        (F.col("p_retailprice") / 1000.0).alias("assay_score"),
    )


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Per order: ensemble components = its line prices; score and population
    uncertainty derived from them; key = customer."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.col("l_extendedprice") / 100003.0)).alias("components"))
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("sim_key"),
        (F.col("o_totalprice") / 100003.0).alias("score"))
    return o.join(li, o.id == li.l_orderkey, "left").drop("l_orderkey")
