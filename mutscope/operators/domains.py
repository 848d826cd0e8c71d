"""Position-level analytics: domain interval join, interval merge, landscapes,
class summaries (J4, J5, J7, W6, A10–A14, A19, A22–A24, A26).

The interval join is an equi join: on the dataset key with a range predicate
where a dataset has a few intervals, on dyadic blocks of positions where it
has many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..util import attach_group_stats, bounded_broadcast, materialize
from .ordered import ordered_scan


FEW_DOMAINS = 64             # of a dataset, up to which each row is compared with all of them


def join_domains(df: DataFrame, domains: DataFrame, key: str = "dataset_name",
                 pos: str = "position") -> DataFrame:
    """Variant ⋈ domain where start ≤ position ≤ end (inclusive); a variant
    lands in 0..n domains (overlapping domains repeat it).

    With few domains a dataset: an equi join on the dataset and a range
    condition.  With many: an equi join on blocks (``dyadic_blocks``), whose
    work grows with the result.
    """
    most = domains.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > FEW_DOMAINS:
        return _join_blocks(df, domains, key, pos)
    d = bounded_broadcast(domains.withColumnRenamed(key, "_dk"))
    cond = (F.col(key) == F.col("_dk")) & F.col(pos).between(F.col("start_pos"), F.col("end_pos"))
    return df.join(d, cond).drop("_dk")


def dyadic_blocks(intervals: DataFrame, levels: int, start: str = "start_pos", end: str = "end_pos") -> DataFrame:
    """Every interval as disjoint blocks: ``_level`` l and ``_block`` i stand for the positions i·2^l … (i + 1)·2^l − 1.

    At each level the blocks inside the interval whose parent is not: the
    first one if its number is odd, the last one if its number is even.
    """
    lo = lambda l: F.expr(f"shiftright(cast({start} as bigint) + shiftleft(1L, {l}) - 1L, {l})")  # noqa: E731,E741
    hi = lambda l: F.expr(f"shiftright(cast({end} as bigint) + 1L, {l})")  # noqa: E731,E741
    d = intervals.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    d = d.withColumn("_a", lo("_level")).withColumn("_b", hi("_level")).where("_a < _b")
    ends = F.array(F.when(F.col("_a").bitwiseAND(F.lit(1)) == 1, F.col("_a")),
                   F.when(F.col("_b").bitwiseAND(F.lit(1)) == 1, F.col("_b") - 1))
    return d.withColumn("_block", F.explode(F.array_distinct(F.array_compact(ends)))).drop("_a", "_b")


def _join_blocks(df: DataFrame, domains: DataFrame, key: str, pos: str) -> DataFrame:
    length = F.col("end_pos").cast("long") - F.col("start_pos").cast("long") + 1
    levels = int(domains.agg(F.max(F.floor(F.log2(F.greatest(length, F.lit(1)))))).first()[0] or 0) + 1
    blocks = materialize(dyadic_blocks(domains, levels).withColumnRenamed(key, "_dk"), "blocks")
    used = [r[0] for r in blocks.select("_level").distinct().collect()]
    blocks = blocks.withColumnsRenamed({"_level": "_l", "_block": "_b"})
    rows = df.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in sorted(used)]))) if used else df.withColumn("_level", F.lit(-1))
    rows = rows.withColumn("_at", F.expr(f"shiftright(cast({pos} as bigint), _level)"))
    on = (F.col(key) == F.col("_dk")) & (F.col("_level") == F.col("_l")) & (F.col("_at") == F.col("_b"))
    return rows.join(bounded_broadcast(blocks), on).drop("_dk", "_level", "_at", "_l", "_b")


def merge_intervals(df: DataFrame, keys, start: str = "start_pos", end: str = "end_pos",
                    gap: int = 1) -> DataFrame:
    """Gaps-and-islands merge — sorted by start, an interval opens a new
    block when start > (max end of all earlier intervals) + gap.

    Intervals sharing a start are merged first (they overlap); the running
    max and the block counter use the skew-safe ``ordered_scan``.
    """
    keys = list(keys)
    by_start = df.groupBy(*keys, start).agg(F.max(end).alias("_e"))
    s = ordered_scan(by_start, keys, F.col(start), {"_prev": ("max", "_e")}, inclusive=False)
    s = s.withColumn("_new", F.when(F.col("_prev").isNull() | (F.col(start) > F.col("_prev") + gap), 1)
                     .otherwise(0))
    s = ordered_scan(s.select(*keys, start, "_e", "_new"), keys, F.col(start), {"_blk": ("sum", "_new")})
    return (s.groupBy(*keys, "_blk").agg(F.min(start).alias(start), F.max("_e").alias(end))
            .drop("_blk"))


def with_landscape_keys(df: DataFrame, variant: str = "variant_id") -> DataFrame:
    """E3 + E21 on a result table: 0-based position, residue index, combined
    key and squared error."""
    return df.select("*",
                     E.landscape_position(variant).alias("mutation_position"),
                     E.landscape_aa_index(variant).alias("mutation_aa_index"),
                     E.landscape_key(variant).alias("mutation_position_aa_index"),
                     E.squared_error("assay_score", "prediction_score").alias("squared_error"))


def landscape_by_position(df: DataFrame, keys) -> DataFrame:
    """A10: per 0-based position: mean assay, mean prediction, mean squared
    error and count (NULL positions dropped, as pandas does)."""
    d = with_landscape_keys(df).filter(F.col("mutation_position").isNotNull())
    return d.groupBy(*keys, "mutation_position").agg(
        F.avg("assay_score").alias("assay_score"), F.avg("prediction_score").alias("prediction_score"),
        F.avg("squared_error").alias("squared_error"), F.count(F.lit(1)).alias("count"))


def landscape_by_bin(df: DataFrame, keys, num_bins: int = 50) -> DataFrame:
    """Position bins (a, b] of width max(1, positions div num_bins)
    starting at min−1, labelled by the floored mid-point; every position,
    including the highest, falls in a bin.  Groups with fewer rows than
    ``num_bins`` keep the raw position/residue key."""
    keys = list(keys)
    d = with_landscape_keys(df).filter(F.col("mutation_position").isNotNull())
    st = d.groupBy(*keys).agg(F.min("mutation_position").alias("_lo0"), F.max("mutation_position").alias("_hi"),
                              F.count(F.lit(1)).alias("_rows"))
    st = st.select(*keys, (F.col("_lo0") - 1).alias("_lo"), "_rows",
                   F.greatest(F.lit(1), F.floor((F.col("_hi") - F.col("_lo0") + 1) / num_bins)).cast("int").alias("_w"))
    j = attach_group_stats(d, st, keys)
    i = F.ceil((F.col("mutation_position") - F.col("_lo")) / F.col("_w"))
    label = F.floor((2 * F.col("_lo") + (2 * i - 1) * F.col("_w")) / 2)
    j = j.withColumn("position_bin", F.when(F.col("_rows") < num_bins, F.col("mutation_position_aa_index"))
                     .otherwise(label.cast("double")))
    return j.groupBy(*keys, "position_bin").agg(
        F.avg("assay_score").alias("assay_score"), F.avg("prediction_score").alias("prediction_score"),
        F.avg("squared_error").alias("squared_error"), F.count(F.lit(1)).alias("count"))


def signed_error_by_domain(df: DataFrame, domains: DataFrame, keys) -> DataFrame:
    """mean(prediction − assay) per domain (the reference calls it "mse")."""
    j = join_domains(df, domains)
    return j.groupBy(*keys, "domain", "start_pos", "end_pos").agg(
        F.avg(F.col("prediction_score") - F.col("assay_score")).alias("metric"))


def attach_label(df: DataFrame, labels: DataFrame, keys, label: str = "label") -> DataFrame:
    """Map rows to a class label by key and drop unlabeled rows; the
    label side must be unique per key (see ``duplicate_labels``)."""
    return df.join(labels.select(*keys, label).filter(F.col(label).isNotNull()), list(keys))


def duplicate_labels(labels: DataFrame, keys) -> DataFrame:
    """J4 check: keys that carry more than one label row (empty when valid)."""
    return labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def round_ensemble(df: DataFrame, keys, variant: str = "variant_id", round_col: str = "round_num",
                   score: str = "prediction_score", label: str = "label") -> DataFrame:
    """Mean prediction and max label per (variant, round)."""
    return (df.filter(F.col(variant).isNotNull() & F.col(round_col).isNotNull())
            .groupBy(*keys, variant, round_col)
            .agg(F.avg(score).alias("mean_prediction"), F.max(label).alias(label)))


def class_counts(df: DataFrame, keys, label: str = "label") -> DataFrame:
    """Positives and negatives per group."""
    pos = F.col(label).cast("int")
    return df.groupBy(*keys).agg(F.sum(pos).cast("long").alias("num_positive"),
                                 F.sum(1 - pos).cast("long").alias("num_negative"))


def class_thresholds(df: DataFrame, keys, score: str = "assay_score", label: str = "label") -> DataFrame:
    """Min score of class 1 and max score of class 0."""
    return df.groupBy(*keys).agg(F.min(F.when(F.col(label) == 1, F.col(score))).alias("gof_min"),
                                 F.max(F.when(F.col(label) == 0, F.col(score))).alias("lof_max"))


def label_pivot(df: DataFrame, row: str, label: str = "label", values=(0, 1)) -> DataFrame:
    """Counts row × label with listed label values; missing → 0."""
    out = df.groupBy(row).pivot(label, list(values)).count()
    return out.fillna(0, subset=[str(v) for v in values])


def class_ranges(df: DataFrame, keys, score: str = "score", label: str = "label") -> DataFrame:
    """Score range per class."""
    return df.groupBy(*keys, label).agg(F.min(score).alias("min_score"), F.max(score).alias("max_score"))


def batch_size_plan(df: DataFrame, key: str = "dataset_name", small: int = 500,
                    small_fraction: float = 0.1, large_batch: int = 100,
                    first_fraction: float = 0.2) -> DataFrame:
    """Per dataset — fewer than ``small`` variants → batch = 10 % of them,
    else 100; first round = 20 % of the variants (computed per dataset)."""
    n = F.col("num_variants")
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("num_variants")).select(
        key, "num_variants",
        F.when(n < small, F.floor(n * small_fraction)).otherwise(F.lit(large_batch)).cast("long").alias("batch_size"),
        F.floor(n * first_fraction).cast("long").alias("num_variants_first_round"))


def sign_flip(col: str) -> Column:
    """P16."""
    return -F.col(col)
