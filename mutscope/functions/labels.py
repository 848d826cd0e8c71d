"""Class-label builders (L1–L8): score → 1 / 0 / NULL per dataset.

The inequalities differ on purpose between builders (≥/≤, >/≤, >/<) and are
kept separate.  Thresholds that depend on the data (percentiles, medians) are
aggregates per ``keys`` joined back — never values collected to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stats as S
from ..util import attach_group_stats, materialize
from . import expr as E


def _join_keys(df: DataFrame, other: DataFrame, keys) -> DataFrame:
    return attach_group_stats(df, other, keys)


def _finish(df: DataFrame, out: str, keep_unlabeled: bool) -> DataFrame:
    return df if keep_unlabeled else df.filter(F.col(out).isNotNull())


def label_by_category(df: DataFrame, col: str, positive, negative, out: str = "label",
                      keep_unlabeled: bool = False) -> DataFrame:
    """L1: two categorical values → 1 / 0; other rows dropped."""
    lab = F.when(F.col(col) == positive, 1).when(F.col(col) == negative, 0)
    return _finish(df.withColumn(out, lab), out, keep_unlabeled)


def label_by_class_threshold(df: DataFrame, class_col: str, score: str, pos_class=4,
                             threshold: float = 1.1, neg_class=1, out: str = "label",
                             keep_unlabeled: bool = True) -> DataFrame:
    """L2: class ``pos_class`` with score > threshold → 1; class ``neg_class`` → 0."""
    lab = (F.when((F.col(class_col) == pos_class) & (F.col(score) > threshold), 1)
           .when(F.col(class_col) == neg_class, 0))
    return _finish(df.withColumn(out, lab), out, keep_unlabeled)


def label_by_significance(df: DataFrame, score: str, p_adj: str, alpha: float,
                          out: str = "label", keep_unlabeled: bool = True) -> DataFrame:
    """L3: sign of the score when the adjusted p is below α, else NULL."""
    lab = F.when(F.col(p_adj) < alpha, (F.col(score) > 0).cast("int"))
    return _finish(df.withColumn(out, lab), out, keep_unlabeled)


def label_by_ntile(df: DataFrame, keys, value: str, top: float = 80, bottom: float = 20,
                   out: str = "label", keep_unlabeled: bool = True) -> DataFrame:
    """L4: value ≥ top percentile → 1, ≤ bottom percentile → 0 (per keys)."""
    cut = S.percentiles(df, keys, value, {"_top": top / 100.0, "_bottom": bottom / 100.0})
    j = _join_keys(df, cut, keys)
    lab = F.when(F.col(value) >= F.col("_top"), 1).when(F.col(value) <= F.col("_bottom"), 0)
    return _finish(j.withColumn(out, lab).drop("_top", "_bottom"), out, keep_unlabeled)


def label_by_quantile(df: DataFrame, keys, value: str, lof_q: float = 0.5, gof_q: float = 0.5,
                      out: str = "label", keep_unlabeled: bool = False) -> DataFrame:
    """Value > gof quantile → 1, ≤ lof quantile → 0; others dropped."""
    cut = S.percentiles(df, keys, value, {"_gof": gof_q, "_lof": lof_q})
    j = _join_keys(df, cut, keys)
    lab = F.when(F.col(value) > F.col("_gof"), 1).when(F.col(value) <= F.col("_lof"), 0)
    return _finish(j.withColumn(out, lab).drop("_gof", "_lof"), out, keep_unlabeled)


def label_by_threshold(df: DataFrame, value: str, lof: float, gof: float, out: str = "label",
                       keep_unlabeled: bool = False) -> DataFrame:
    """Value > gof → 1, value < lof → 0; others dropped."""
    lab = F.when(F.col(value) > gof, 1).when(F.col(value) < lof, 0)
    return _finish(df.withColumn(out, lab), out, keep_unlabeled)


def label_by_fdr(df: DataFrame, keys, value: str, uncertainty: str | None = None,
                 log2fc_threshold: float = 0.3, q_threshold: float = 0.05,
                 count_col: str | None = None, min_count: int = 0, out: str = "label",
                 keep_unlabeled: bool = False) -> DataFrame:
    """Robust z against the median (σ = 1.4826 × mean absolute deviation
    around the mean, pooled with per-row uncertainty when given), normal
    p-values for loss and gain, BH q-values per family, log2 fold change.

    gain (1): log2fc ≥ t and q_gain < q; loss (0): log2fc ≤ −t and q_loss < q.
    """
    keys = list(keys or [])
    base = S.robust_baseline(df, keys, value)  # keys, median, mad
    j = _join_keys(df, base, keys)
    sigma = F.col("mad")  # already 1.4826 × mean absolute deviation
    if uncertainty is None:
        z = F.try_divide(F.col(value) - F.col("median"), sigma)
    else:
        z = E.pooled_z(value, "median", uncertainty, sigma)
    j = j.withColumn("z_score", z).withColumn("p_value_lof", E.norm_cdf("z_score"))
    j = j.filter(F.col("p_value_lof").isNotNull()).withColumn("p_value_gof", 1 - F.col("p_value_lof"))
    # the two BH passes each read the per-row table twice: write it once
    j = materialize(j, "fdr")
    j = S.bh_fdr_many(j, keys, {"p_value_gof": "q_value_gof", "p_value_lof": "q_value_lof"})
    j = j.withColumn("log2fc_baseline", E.log2_fold_change(value, "median"))
    enough = F.lit(True) if count_col is None else (F.col(count_col) >= min_count)
    gain = (F.col("log2fc_baseline") >= log2fc_threshold) & (F.col("q_value_gof") < q_threshold) & enough
    loss = (F.col("log2fc_baseline") <= -log2fc_threshold) & (F.col("q_value_lof") < q_threshold) & enough
    j = j.withColumn(out, F.when(gain, 1).when(loss, 0)).drop("median", "mad")
    return _finish(j, out, keep_unlabeled)


# Registry of label strategies by name (each: df, keys, value → labelled df).
LABELERS: dict[str, Callable[..., DataFrame]] = {
    "ntile": lambda df, keys, value, **kw: label_by_ntile(df, keys, value, **kw),
    "quantile": lambda df, keys, value, **kw: label_by_quantile(df, keys, value, **kw),
    "threshold": lambda df, keys, value, **kw: label_by_threshold(df, value, **kw),
    "fdr": lambda df, keys, value, **kw: label_by_fdr(df, keys, value, **kw),
}


def label_strategy(name: str, **params) -> Callable[[DataFrame, list, str], DataFrame]:
    """Pick a label builder by name; unknown names raise."""
    if name not in LABELERS:
        raise KeyError(f"unknown label strategy {name!r}; known: {sorted(LABELERS)}")
    fn = LABELERS[name]
    return lambda df, keys, value: fn(df, keys, value, **params)
