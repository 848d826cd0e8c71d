"""Acquisition scoring and batch selection.

Every operator works on a prediction table with grouping ``keys`` (one group
per simulation/round), so a whole sweep is one job.  Per-group top-k uses
``row_number() <= k`` which Spark turns into a WindowGroupLimit: each map
task keeps only its k best rows per group before the shuffle, so even a
group holding a third of the data ships only k rows per task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..util import attach_group_stats, attach_written, bounded_broadcast, materialize, null_safe_join
from .select_rank import bracketed, counted_ranks


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- seeded randomness

def seeded_hash(seed, id_col, digits: int = 15) -> Column:
    """Integer from the first ``digits`` hex digits of md5(seed|id):
    reproducible at any parallelism and in any SQL engine with md5."""
    h = F.md5(F.concat_ws("|", _c(seed).cast("string"), _c(id_col).cast("string")))
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("long")


def seeded_uniform(seed, id_col) -> Column:
    """Q1 helper: uniform [0, 1) from md5(seed|id) (13 hex digits, a double's 52 bits)."""
    return seeded_hash(seed, id_col, 13) / F.lit(float(1 << 52))


# ---------------------------------------------------------------- acquisition (Q)

def ensemble_summary(components: str = "components") -> tuple[Column, Column]:
    """M5: mean and population σ of an ensemble's component predictions."""
    c = F.col(components)
    n = F.size(c).cast("double")
    mean = F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x) / n
    var = F.aggregate(c, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / n
    return F.when(n > 0, mean), F.when(n > 0, F.sqrt(var))


def acq_random(seed: int, id_col: str = "id") -> Column:
    return seeded_uniform(F.lit(seed), id_col)


def acq_greedy(score: str = "score") -> Column:
    return F.col(score)


def acq_ucb(weight: float, score: str = "score", uncertainty: str = "uncertainty") -> Column:
    return F.col(score) + F.lit(weight) * F.col(uncertainty)


def acq_variance(uncertainty: str = "uncertainty") -> Column:
    return F.col(uncertainty)


def acq_expected_improvement(best: str = "best_score", score: str = "score",
                             uncertainty: str = "uncertainty") -> Column:
    """Q5: (μ − best)·Φ(Z) + σ·φ(Z), Z = (μ − best)/σ; 0 when σ is NULL or 0."""
    mu, sigma = F.col(score), F.col(uncertainty)
    imp = mu - F.col(best)
    z = F.try_divide(imp, sigma)
    ei = imp * E.norm_cdf(z) + sigma * E.norm_pdf(z)
    return F.when(sigma.isNull() | (sigma == 0), F.lit(0.0)).otherwise(ei)


def acq_thompson(sim_col: str, round_col: str, components: str = "components", members: str = "members") -> Column:
    """Q6: one ensemble member per (simulation, round), chosen by a seeded
    hash of cantor(simulation, round) among ``members`` (a column that is the
    same in all rows of the round, see ``ensemble_size``); the score is that
    member's prediction, NULL where a row lacks it."""
    seed = E.cantor_pair(sim_col, round_col)
    h = seeded_hash(seed, F.lit("thompson"), 8)
    n = F.col(members)
    return F.when(n > 0, F.get(components, F.pmod(h, n).cast("int")))


def ensemble_size(df: DataFrame, keys, components: str = "components", out: str = "members") -> DataFrame:
    """``df`` with the largest number of ensemble members of its key group."""
    n = df.groupBy(*keys).agg(F.max(F.coalesce(F.size(components), F.lit(0))).alias(out))
    return attach_group_stats(df, n, keys)


# Q7: registry name → builder(**params) → Column
ACQUISITION: dict[str, Callable[..., Column]] = {
    "random": acq_random,
    "greedy": acq_greedy,
    "ucb": acq_ucb,
    "variance": acq_variance,
    "ei": acq_expected_improvement,
    "thompson": acq_thompson,
}


def acquisition(name: str, **params) -> Column:
    if name not in ACQUISITION:
        raise KeyError(f"unknown acquisition strategy {name!r}; known: {sorted(ACQUISITION)}")
    return ACQUISITION[name](**params)


def best_observed(train: DataFrame, keys, score: str = "assay_score") -> DataFrame:
    """Best observed training score per key (for EI), joined back by the caller."""
    return train.groupBy(*keys).agg(F.max(score).alias("best_score"))


# ---------------------------------------------------------------- top-k (T)

def top_k(df: DataFrame, k: int, keys, score: str, id_col: str = "id", out: str | None = None) -> DataFrame:
    """K highest ``score`` per group; ties broken by ascending id."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), F.col(id_col).asc())
    rn = out or "_rn"
    r = df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= k)
    return r if out else r.drop(rn)


def top_predicted(df: DataFrame, n: int, keys, score: str = "score", id_col: str = "id",
                  keep_all: bool = False) -> DataFrame:
    """The n best predicted rows per group (train and remaining alike), or
    every row with ``keep_all`` (runs that save all predictions)."""
    return df if keep_all else top_k(df, n, keys, score, id_col)


def select_batch(df: DataFrame, n_acq: int, n_pred: int, keys, acq: str = "acquisition_score",
                 pred: str = "score", id_col: str = "id") -> DataFrame:
    """Top-``n_acq`` by acquisition; then the top-(n_acq+n_pred) by
    prediction not already chosen fill the batch up to n_acq+n_pred.

    Flags: ``top_acquisition_score`` = chosen by acquisition;
    ``top_prediction`` = chosen and within the top-(n_acq+n_pred) predictions.
    Only the two top-k candidate sets (≤ 2·n_acq + n_pred rows per group) are
    ever ranked together; they carry their rows, so ``df`` is not joined again.
    A repeated id of a group is one candidate.
    """
    keys = list(keys)
    total = n_acq + n_pred
    rest = [c for c in df.columns if c not in (*keys, id_col)]
    none = F.lit(None).cast("int")
    a = top_k(df, n_acq, keys, acq, id_col, "_ra").withColumn("_rp", none)
    p = top_k(df, total, keys, pred, id_col, "_rp").withColumn("_ra", none)
    cand = a.unionByName(p).groupBy(*keys, id_col).agg(
        F.min("_ra").alias("_ra"), F.min("_rp").alias("_rp"), F.min_by(F.struct(*rest), F.coalesce("_ra", "_rp")).alias("_row"))
    in_a = F.col("_ra").isNotNull()
    n_a = F.sum(in_a.cast("int")).over(Window.partitionBy(*keys))
    fill_w = Window.partitionBy(*keys).orderBy(F.when(in_a, F.lit(None)).otherwise(F.col("_rp")).asc_nulls_last())
    cand = cand.withColumn("_na", n_a).withColumn("_rf", F.when(~in_a, F.row_number().over(fill_w)))
    chosen = cand.filter(in_a | (F.col("_rf") <= F.lit(total) - F.col("_na")))
    return chosen.select(*keys, id_col, *[F.col(f"_row.{c}").alias(c) for c in rest],
                         in_a.alias("top_acquisition_score"), F.col("_rp").isNotNull().alias("top_prediction"))


def seeded_split(df: DataFrame, test_fraction: float, seed: int, keys, id_col: str = "id") -> DataFrame:
    """T4: reproducible shuffle by md5(seed|id); the first ⌊n(1−f)⌋ rows of
    each group are 'simulation', the rest 'test'.

    The hash of the last 'simulation' row is found by selection
    (``select_rank``); rows are compared with it, and only those that share
    it are ordered by id.
    """
    keys = list(keys)
    d = df.withColumn("_h", seeded_hash(F.lit(seed), id_col))
    # 60 bits: without the last eight the hash is a double, and rises with it
    coarse = F.shiftright(F.col("_h"), 8).cast("double")
    rows = d.select(*keys, "_h")
    brackets = bracketed(rows, keys, coarse, [1 - test_fraction])
    cut = F.floor(F.col("_n") * (1 - test_fraction))
    ranks = attach_written(counted_ranks(rows, keys, F.col("_h"), coarse, brackets), brackets.select(*keys, "_n"), keys)
    # the value at the cut, and how many of its rows are still 'simulation'
    at = (F.col("_cum") - F.col("_cnt") <= cut) & (cut < F.col("_cum"))
    found = ranks.where(at).select(*keys, F.col("_v").alias("_at"), (cut - F.col("_cum") + F.col("_cnt")).alias("_more"))
    j = null_safe_join(d, bounded_broadcast(materialize(found, "cuts")), keys, "left")
    other = j.where("_at is null or _h <> _at").withColumn("split", F.when(
        F.col("_at").isNull() | (F.col("_h") < F.col("_at")), "simulation").otherwise("test"))
    nth = F.row_number().over(Window.partitionBy(*keys, "_h").orderBy(F.col(id_col)))
    equal = j.where("_h = _at").withColumn("_nth", nth)
    equal = equal.withColumn("split", F.when(F.col("_nth") <= F.col("_more"), "simulation").otherwise("test")).drop("_nth")
    return other.unionByName(equal).drop("_h", "_at", "_more")


def seeded_sample(df: DataFrame, n: int, seed: int, keys, id_col: str = "id") -> DataFrame:
    """T5: n rows per group in md5(seed|id) order (top-k on the hash)."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(seeded_hash(F.lit(seed), id_col), F.col(id_col))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def check_sample_size(df: DataFrame, n: int, keys) -> DataFrame:
    """T5 guard: groups with fewer than n rows (empty when the sample is valid)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("available")).filter(F.col("available") < n)


def newest(df: DataFrame, order_col: str) -> DataFrame:
    """The single newest row (TakeOrderedAndProject)."""
    return df.orderBy(F.col(order_col).desc()).limit(1)


# ---------------------------------------------------------------- set ops / joins

def attach_assay(pred: DataFrame, assay: DataFrame, id_col: str = "id") -> DataFrame:
    """Predictions ⋈ assay results by id (hash join, not a nested loop)."""
    return pred.join(assay, id_col)


def remaining(pool: DataFrame, chosen: DataFrame, keys) -> DataFrame:
    """Set difference by key (left anti join)."""
    return pool.join(chosen.select(*keys).distinct(), list(keys), "left_anti")


def stack_splits(**parts: DataFrame) -> DataFrame:
    """Union of named splits with a ``split`` column."""
    out = None
    for name, df in parts.items():
        d = df.withColumn("split", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


def best_result(df: DataFrame, keys, score: str = "assay_score", id_col: str = "id") -> DataFrame:
    """Max score per group and its row (first id on ties)."""
    order = F.struct((-F.col(score)).alias("s"), F.col(id_col).alias("i"))
    return df.groupBy(*keys).agg(F.max(score).alias("best_score"),
                                 F.min_by(F.col(id_col), order).alias("best_id"))


def validate_splits(df: DataFrame, keys, id_col: str = "id", split: str = "split",
                    has_pred: str = "has_prediction", has_assay: str = "has_assay") -> DataFrame:
    """One pass by id → violations: id in train and validation, test id
    also in train/validation, or prediction/assay coverage differing."""
    g = df.groupBy(*keys, id_col).agg(
        F.sum((F.col(split) == "train").cast("int")).alias("n_train"),
        F.sum((F.col(split) == "validation").cast("int")).alias("n_validation"),
        F.sum((F.col(split) == "test").cast("int")).alias("n_test"),
        F.sum(F.col(has_pred).cast("int")).alias("n_pred"),
        F.sum(F.col(has_assay).cast("int")).alias("n_assay"))
    problem = (F.when((F.col("n_train") > 0) & (F.col("n_validation") > 0), "train_validation_overlap")
               .when((F.col("n_test") > 0) & (F.col("n_train") + F.col("n_validation") > 0), "test_overlap")
               .when(F.col("n_pred") != F.col("n_assay"), "coverage_mismatch"))
    return g.withColumn("violation", problem).filter(F.col("violation").isNotNull())
