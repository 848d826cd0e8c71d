"""Numeric core: ranks, ROC/AUC, BH-FDR, exact percentiles, regression metrics.

Every statistic is computed per ``keys`` (dataset, run, round, …) in one job.
Rank-based steps first collapse rows to distinct values with counts and then
use the skew-safe ``ordered_scan``; scalars per group (means, σ, medians)
are aggregates joined back, never collected to the driver.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..util import attach_group_stats, estimated_bytes, materialize, null_safe_join
from .attach import attach_by_value
from .ordered import scan_and_rows
from .select_rank import percentiles_of

GROUP_ROWS = 1 << 18         # rows of a group that are ranked in one window; larger groups are dealt over buckets
MAX_BUCKETS = 1 << 13        # of a job; beyond GROUP_ROWS times as many rows the buckets grow


def _keys(keys) -> list[str]:
    return list(keys or [])


# ---------------------------------------------------------------- ranks

def value_counts(df: DataFrame, keys, value: str) -> DataFrame:
    return (df.filter(F.col(value).isNotNull())
            .groupBy(*_keys(keys), value).agg(F.count(F.lit(1)).alias("_cnt")))


def rank_table(df: DataFrame, keys, value: str, out: str = "avg_rank") -> DataFrame:
    """Distinct (keys, value) with its average rank: rows below + (ties + 1)/2."""
    return rank_tables(df, keys, {value: out})[0][value].drop("_cnt")


def _tagged_counts(df: DataFrame, keys, cols) -> DataFrame:
    """Distinct values of several columns with counts, stacked with a tag
    column so one ordered scan serves all of them."""
    k = _keys(keys)
    parts = [value_counts(df, k, c).select(*k, F.lit(c).alias("_col"), F.col(c).cast("double").alias("_v"), "_cnt")
             for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rank_tables(df: DataFrame, keys, cols: dict[str, str]) -> tuple[dict[str, DataFrame], int | None]:
    """Average-rank tables for several columns, with the values' counts (``_cnt``), from a single ordered scan; a bound of their size."""
    return _ranked(_tagged_counts(df, _keys(keys), list(cols)), df, keys, cols)


def _ranked(counts: DataFrame, df: DataFrame, keys, cols: dict[str, str]):
    k = _keys(keys)
    s, written = scan_and_rows(counts, [*k, "_col"], F.col("_v"), {"_cum": ("sum", "_cnt")})
    r = F.col("_cum") - F.col("_cnt") + (F.col("_cnt") + 1) / 2.0
    return {c: s.filter(F.col("_col") == c).select(*k, F.col("_v").cast(df.schema[c].dataType).alias(c), r.alias(out), "_cnt")
            for c, out in cols.items()}, estimated_bytes(written)


def average_ranks(df: DataFrame, keys, value: str, out: str = "avg_rank") -> DataFrame:
    """1-based rank of ``value`` within ``keys``, ties get the mean rank.

    rank = (rows below) + (ties + 1) / 2; NULL values get a NULL rank.
    """
    k = _keys(keys)
    tables, size = rank_tables(df, k, {value: out})
    return attach_by_value(df, tables[value], k, value, size=size)


def spearman(df: DataFrame, keys, x: str, y: str, out: str = "spearman") -> DataFrame:
    """Spearman correlation per group: Pearson on average ranks (``_with_spearman``)."""
    k = _keys(keys)
    rows = materialize(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*k, x, y), "rows")
    return _with_spearman(rows, k, x, y, out, _largest_group(rows, k) <= GROUP_ROWS)


def _largest_group(rows: DataFrame, k: list[str]) -> int:
    return rows.groupBy(*k).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0


def _with_spearman(rows: DataFrame, k: list[str], x: str, y: str, out: str, small: bool, extra: list[Column] = ()) -> DataFrame:
    """Per group the rank correlation of rows without NULL values, and ``extra`` aggregates.

    The mean rank of n rows is (n + 1) / 2, so the moments are sums around a
    known centre.  NULL when either side is constant (``try_divide``; ANSI
    ``corr`` raises).  Groups that are ``small`` are ranked by windows, which
    share one exchange.  Else the column with fewer values is ranked by an
    ordered scan and its ranks are attached to the rows, which are then summed
    by the other column's value (``_rank_moments``).
    """
    if small:
        group = Window.partitionBy(*k)
        n1 = F.count(F.lit(1)).over(group) + 1
        for c in (x, y):
            ties = F.count(F.lit(1)).over(Window.partitionBy(*k, c))
            rows = rows.withColumn(f"_d_{c}", F.rank().over(group.orderBy(c)) + (ties - 1) / 2.0 - n1 / 2.0)
        dx, dy = F.col(f"_d_{x}"), F.col(f"_d_{y}")
        return rows.groupBy(*k).agg(_correlation(F.sum(dx * dy), F.sum(dx * dx), F.sum(dy * dy)).alias(out), *extra)

    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(x).alias("x"), F.approx_count_distinct(y).alias("y")).first()
    if seen.x > seen.y:
        x, y = y, x
    counts = materialize(value_counts(rows, k, x), "counts")
    ranks, size = _ranked(counts.select(*k, F.lit(x).alias("_col"), F.col(x).cast("double").alias("_v"), "_cnt"), rows, k, {x: "_r"})
    n1 = counts.groupBy(*k).agg((F.sum("_cnt") + 1).alias("_n1"))
    ranks = attach_group_stats(ranks[x], n1, k).select(*k, x, (F.col("_r") - F.col("_n1") / 2.0).alias("_d"), "_cnt")
    moments = _rank_moments(attach_by_value(rows, ranks, k, x, size=size), k, y, seen.n)
    xx = ranks.groupBy(*k).agg(F.sum(F.col("_cnt") * F.col("_d") * F.col("_d")).alias("_xx"))
    g = attach_group_stats(moments, xx, k).select(*k, _correlation(F.col("_xy"), F.col("_xx"), F.col("_yy")).alias(out))
    return null_safe_join(rows.groupBy(*k).agg(*extra), g, k) if extra else g


def _rank_moments(rows: DataFrame, k: list[str], y: str, n: int) -> DataFrame:
    """Per group ``_xy`` and ``_yy``: sums of ``_d`` times, and of, the centred average ranks of ``y``, squared.

    Rows are summed by value, and the values dealt over buckets with edges at
    quantiles of all rows, so that a group of any size is many windows.  A
    bucket gives its moments around its own middle rank; the groups add them
    up with the distances of these from the group's middle.
    """
    count = max(2, min(MAX_BUCKETS, n // max(1, GROUP_ROWS)))
    value = F.col(y).cast("double") + 0.0                     # no negative zero
    edges = rows.agg(F.percentile_approx(value, [i / count for i in range(1, count)], 10 * count)).first()[0] or [0.0]
    edges = sorted({e + 0.0 for e in edges if math.isfinite(e)}) or [0.0]
    buckets = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="_value", outputCol="_bucket", handleInvalid="keep")
    v = (buckets.transform(rows.select(*k, y, "_d", value.alias("_value"))).groupBy(*k, "_bucket", y)
         .agg(F.count(F.lit(1)).alias("_cnt"), F.sum("_d").alias("_sx")))
    bucket = Window.partitionBy(*k, "_bucket")
    below = F.sum("_cnt").over(bucket.orderBy(y).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_cnt")
    v = v.withColumn("_dy", below + F.col("_cnt") / 2.0 - F.sum("_cnt").over(bucket) / 2.0)
    b = v.groupBy(*k, "_bucket").agg(
        F.sum("_cnt").alias("_n"), F.sum("_sx").alias("_sx"), F.sum(F.col("_sx") * F.col("_dy")).alias("_xy"),
        F.sum(F.col("_cnt") * F.col("_dy") * F.col("_dy")).alias("_yy"))
    group = Window.partitionBy(*k)
    before = F.sum("_n").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    b = b.withColumn("_away", before + F.col("_n") / 2.0 - F.sum("_n").over(group) / 2.0)
    return b.groupBy(*k).agg(F.sum(F.col("_xy") + F.col("_sx") * F.col("_away")).alias("_xy"),
                             F.sum(F.col("_yy") + F.col("_n") * F.col("_away") * F.col("_away")).alias("_yy"))


def _correlation(xy: Column, xx: Column, yy: Column) -> Column:
    return F.try_divide(xy, F.sqrt(xx) * F.sqrt(yy))


# ---------------------------------------------------------------- ROC / AUC

def _class_counts(df: DataFrame, keys, score: str, label: str) -> DataFrame:
    pos = F.col(label).cast("int")
    return (df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
            .groupBy(*_keys(keys), score)
            .agg(F.sum(pos).cast("long").alias("_p"),
                 F.sum(1 - pos).cast("long").alias("_n")))


def _roc_scan(df: DataFrame, keys, score: str, label: str) -> DataFrame:
    """Distinct scores with class counts, running counts (ascending) and totals."""
    k = _keys(keys)
    cc = _class_counts(df, k, score, label)
    s, written = scan_and_rows(cc, k, F.col(score), {"_cp": ("sum", "_p"), "_cn": ("sum", "_n")})
    tot = written.groupBy(*k).agg(F.sum("_p").alias("_pos_total"), F.sum("_n").alias("_neg_total"))
    return attach_group_stats(s, tot, k)


def _auc_from_scan(s: DataFrame, keys, out: str = "auc") -> DataFrame:
    k = _keys(keys)
    below = F.col("_cn") - F.col("_n")
    agg = s.groupBy(*k).agg(
        F.sum(F.col("_p") * (below + F.col("_n") / 2.0)).alias("_u"),
        F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"))
    return agg.select(*k, F.try_divide(F.col("_u"), F.col("n_pos") * F.col("n_neg")).alias(out),
                      "n_pos", "n_neg")


def _curve_from_scan(s: DataFrame, keys, score: str) -> DataFrame:
    k = _keys(keys)
    pts = s.select(*k, F.col(score).cast("double").alias("threshold"),
                   (F.col("_pos_total") - F.col("_cp") + F.col("_p")).alias("tp"),
                   (F.col("_neg_total") - F.col("_cn") + F.col("_n")).alias("fp"), "_pos_total", "_neg_total")
    origin = (s.groupBy(*k).agg(F.first("_pos_total").alias("_pos_total"), F.first("_neg_total").alias("_neg_total"))
              .select(*k, F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("long").alias("tp"),
                      F.lit(0).cast("long").alias("fp"), "_pos_total", "_neg_total"))
    pts = pts.unionByName(origin)
    tpr = F.try_divide(F.col("tp"), F.col("_pos_total"))
    fpr = F.try_divide(F.col("fp"), F.col("_neg_total"))
    return pts.select(*k, "threshold", "tp", "fp", tpr.alias("tpr"), fpr.alias("fpr"),
                      (tpr - fpr).alias("youden"))


def roc_auc(df: DataFrame, keys, score: str = "score", label: str = "label",
            out: str = "auc") -> DataFrame:
    """ROC AUC with ties counted half (Mann–Whitney form).

    Per distinct score: AUC = Σ p·(negatives below + n/2) / (P·N); NULL if a
    class is empty.  Also returns the class counts ``n_pos`` / ``n_neg``.
    """
    return _auc_from_scan(_roc_scan(df, keys, score, label), keys, out)


def roc_curve(df: DataFrame, keys, score: str = "score", label: str = "label") -> DataFrame:
    """One ROC point per distinct threshold (predict 1 when score ≥
    threshold), ties as one step, plus the (0, 0) origin with a NULL threshold.

    Columns: keys, threshold, tp, fp, tpr, fpr, youden (= tpr − fpr).
    """
    return _curve_from_scan(_roc_scan(df, keys, score, label), keys, score)


def roc_summary(df: DataFrame, keys, score: str = "score", label: str = "label"):
    """AUC table and ROC curve from a single ordered scan."""
    s = _roc_scan(df, keys, score, label)
    return _auc_from_scan(s, keys), _curve_from_scan(s, keys, score)


def youden_point(curve: DataFrame, keys) -> DataFrame:
    """Optimal point = max Youden J, first in descending-threshold order
    (i.e. the highest threshold among ties)."""
    k = _keys(keys)
    best = F.max_by(F.struct("threshold", "tpr", "fpr", "youden"),
                    F.struct("youden", F.coalesce("threshold", F.lit(float("inf")))))
    return (curve.filter(F.col("youden").isNotNull()).groupBy(*k).agg(best.alias("_b"))
            .select(*k, "_b.threshold", "_b.tpr", "_b.fpr", "_b.youden"))


# ---------------------------------------------------------------- FDR

def bh_fdr(df: DataFrame, keys, p: str = "p", out: str = "q") -> DataFrame:
    """Benjamini–Hochberg q-values within each family (``keys``).

    Per distinct p with count k: rank r = cumulative k, m = Σk;
    q = min(1, min over p' ≥ p of p'·m/r').  NULL p → NULL q.
    """
    return bh_fdr_many(df, keys, {p: out})


def bh_fdr_many(df: DataFrame, keys, cols: dict[str, str]) -> DataFrame:
    """BH q-values for several p-value columns, sharing two ordered scans
    (ascending running counts, then a descending running minimum)."""
    k = _keys(keys)
    s, written = scan_and_rows(_tagged_counts(df, k, list(cols)), k + ["_col"], F.col("_v"), {"_r": ("sum", "_cnt")})
    m = written.groupBy(*k, "_col").agg(F.sum("_cnt").alias("_m"))
    s = attach_group_stats(s, m, [*k, "_col"])
    s = s.select(*k, "_col", "_v", "_cnt", (F.col("_v") * F.col("_m") / F.col("_r")).alias("_raw"))
    s, written = scan_and_rows(s, k + ["_col"], -F.col("_v"), {"_qmin": ("min", "_raw")})
    size = estimated_bytes(written)
    q = s.select(*k, "_col", "_v", "_cnt", F.least(F.lit(1.0), F.col("_qmin")).alias("_q"))
    out = df
    for c, name in cols.items():
        qc = q.filter(F.col("_col") == c).select(*k, F.col("_v").cast(df.schema[c].dataType).alias(c),
                                                 F.col("_q").alias(name), "_cnt")
        out = attach_by_value(out, qc, k, c, size=size)
    return out


# ---------------------------------------------------------------- order statistics

def percentiles(df: DataFrame, keys, value: str, probs: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation (numpy 'linear').

    Found by selection (``select_rank``): two aggregations over the rows, no
    sort of them; no value list is ever gathered.
    """
    k = _keys(keys)
    return percentiles_of(df, k, [value], probs).select(*k, *probs)


def robust_baseline(df: DataFrame, keys, value: str) -> DataFrame:
    """Median and 1.4826 × mean absolute deviation around the mean, from the same two passes."""
    k = _keys(keys)
    g = percentiles_of(df, k, [value], {"median": 0.5}, deviation=True)
    return g.select(*k, "median", (F.col("_away") * 1.4826).alias("mad"))


def standardise(df: DataFrame, cols, keys) -> DataFrame:
    """(x − mean) / σ_sample within ``keys`` (aggregate + join back)."""
    k = _keys(keys)
    st = df.groupBy(*k).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols],
                            *[F.stddev_samp(c).alias(f"_s_{c}") for c in cols])
    j = attach_group_stats(df, st, k)
    for c in cols:
        j = j.withColumn(c, F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")))
    return j.drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])


# ---------------------------------------------------------------- regression metrics

def regression_metrics(df: DataFrame, keys, split: str = "split", pred: str = "prediction",
                       actual: str = "assay_score",
                       pooled: tuple[str, str, str] | None = ("train", "validation",
                                                              "train_validation"),
                       splits: tuple[str, ...] | None = None) -> DataFrame:
    """RMSE, R² and Spearman per (keys, split) over the rows that have
    both values; a pooled split of two named splits is added when ``pooled``
    is given.  With ``splits`` every group has a row for each of these splits,
    NULL metrics where it holds no such row."""
    k = _keys(keys)
    by = k + [split]
    groups = df.select(*k).distinct() if k else df.sparkSession.range(1).select()
    written = materialize(df.filter(F.col(pred).isNotNull() & F.col(actual).isNotNull()).select(*by, pred, actual), "rows")
    # a bound of every split's rows, but for a pooled one named like one of its parts
    small = _largest_group(written, k) <= GROUP_ROWS
    # the exchange by ``k`` serves the splits, too
    rows = written.repartition(*k) if small and k else written
    if pooled:
        a, b, name = pooled
        own = F.array(F.col(split))
        rows = rows.withColumn(split, F.explode(F.when(F.col(split).isin(a, b), F.array_append(own, F.lit(name))).otherwise(own)))
    err, away = F.col(pred) - F.col(actual), F.max(actual).cast("double") - F.min(actual).cast("double")
    moments = [F.sqrt(F.avg(err * err)).alias("rmse"),
               F.when(away == 0, None).otherwise(1 - F.try_divide(F.avg(err * err), F.var_pop(actual))).alias("r2")]
    g = _with_spearman(rows, by, pred, actual, "spearman", small, moments).select(*by, "rmse", "r2", "spearman")
    if splits is None:
        return g
    asked = groups.withColumn(split, F.explode(F.array(*map(F.lit, splits))))
    return null_safe_join(asked, g, k + [split], "left")


def squared_error(pred: str = "prediction", actual: str = "assay_score") -> Column:
    """E21."""
    return F.pow(F.col(pred) - F.col(actual), 2)
