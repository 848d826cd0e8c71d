"""Catalog entries for the numeric core.

Bindings: ``b_label`` = labels ⋈ documents with score = n_chars and
label = quality, families by ``lang``; BH p-values from events; regression
metrics on lineitem with a split by line number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as S
from ..session import table
from ..util import finish
from .bind_sql import rounded
from .registry import register

B_LABEL_SQL = """b AS (SELECT d.doc_id, d.lang, d.source, CAST(d.n_chars AS DOUBLE) AS score,
                  l.quality AS label
               FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def b_label(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return (table(spark, d, "labels").join(docs, "doc_id")
            .select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("score"),
                    F.col("quality").alias("label")))


_AVG_RANK = "(rank() OVER (PARTITION BY {k} ORDER BY {v}) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2.0)"


def _auc_sql(key: str) -> str:
    ar = _AVG_RANK.format(k=key, v="score")
    return rounded(f"""WITH {B_LABEL_SQL},
r AS (SELECT *, {ar} AS ar FROM b)
SELECT {key}, CASE WHEN sum(label) * (count(*) - sum(label)) = 0 THEN NULL ELSE
       (sum(CASE WHEN label = 1 THEN ar END) - sum(label) * (sum(label) + 1) / 2.0)
       / (sum(label) * (count(*) - sum(label))) END AS auc,
       CAST(sum(label) AS BIGINT) AS n_pos, CAST(count(*) - sum(label) AS BIGINT) AS n_neg
FROM r GROUP BY {key}""", "auc")


@register("A20", _auc_sql("lang"))
def q_a20(spark, d):
    return finish(S.roc_auc(b_label(spark, d), ["lang"]))


@register("A20_by_source", _auc_sql("source"))
def q_a20_src(spark, d):
    return finish(S.roc_auc(b_label(spark, d), ["source"]))


_ROC_SQL = f"""WITH {B_LABEL_SQL},
v AS (SELECT lang, score, CAST(sum(label) AS BIGINT) AS p, CAST(count(*) - sum(label) AS BIGINT) AS n
      FROM b GROUP BY lang, score),
c AS (SELECT lang, score AS threshold,
             CAST(sum(p) OVER (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp,
             CAST(sum(n) OVER (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fp,
             sum(p) OVER (PARTITION BY lang) AS P, sum(n) OVER (PARTITION BY lang) AS N
      FROM v
      UNION ALL
      SELECT lang, NULL, 0, 0, sum(p), sum(n) FROM v GROUP BY lang),
curve AS (SELECT lang, threshold, tp, fp,
                 CASE WHEN P = 0 THEN NULL ELSE tp / P END AS tpr,
                 CASE WHEN N = 0 THEN NULL ELSE fp / N END AS fpr
          FROM c)"""


@register("W4", rounded(_ROC_SQL + " SELECT *, tpr - fpr AS youden FROM curve",
                        "threshold", "tpr", "fpr", "youden"))
def q_w4(spark, d):
    return finish(S.roc_curve(b_label(spark, d), ["lang"]))


@register("A21", rounded(_ROC_SQL + """, j AS (SELECT *, tpr - fpr AS youden FROM curve)
SELECT lang, nullif(arg_max(coalesce(threshold, 'inf'::DOUBLE), (youden, coalesce(threshold, 'inf'::DOUBLE))),
         'inf'::DOUBLE) AS threshold,
       arg_max(tpr, (youden, coalesce(threshold, 'inf'::DOUBLE))) AS tpr,
       arg_max(fpr, (youden, coalesce(threshold, 'inf'::DOUBLE))) AS fpr,
       max(youden) AS youden
FROM j WHERE youden IS NOT NULL GROUP BY lang""", "threshold", "tpr", "fpr", "youden"))
def q_a21(spark, d):
    return finish(S.youden_point(S.roc_curve(b_label(spark, d), ["lang"]), ["lang"]))


@register("W2", rounded(f"""WITH d AS (SELECT doc_id, lang, CAST(n_chars AS DOUBLE) AS score FROM documents)
SELECT doc_id, lang, score, {_AVG_RANK.format(k="lang", v="score")} AS avg_rank FROM d""",
                        "score", "avg_rank"))
def q_w2(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", "lang", F.col("n_chars").cast("double").alias("score"))
    return finish(S.average_ranks(docs, ["lang"], "score"))


def b_pvalues(spark, d):
    return table(spark, d, "events").select(
        "event_id", "event_type", ((F.col("event_id") % 1000) / F.lit(1000.0)).alias("p"))


@register("W3", rounded("""WITH b AS (SELECT event_id, event_type, (event_id % 1000) / 1000.0::DOUBLE AS p FROM events),
v AS (SELECT event_type, p, count(*) AS k FROM b GROUP BY event_type, p),
c AS (SELECT event_type, p, sum(k) OVER (PARTITION BY event_type ORDER BY p ROWS UNBOUNDED PRECEDING) AS r,
             sum(k) OVER (PARTITION BY event_type) AS m FROM v),
q AS (SELECT event_type, p, least(1.0, min(p * m / r) OVER (PARTITION BY event_type ORDER BY p DESC
             ROWS UNBOUNDED PRECEDING)) AS q FROM c)
SELECT b.event_id, b.event_type, b.p, q.q FROM b JOIN q ON b.event_type = q.event_type AND b.p = q.p""",
                        "p", "q"))
def q_w3(spark, d):
    return finish(S.bh_fdr(b_pvalues(spark, d), ["event_type"], "p", "q"))


@register("A16", rounded("""SELECT lang, quantile_cont(CAST(n_chars AS DOUBLE), 0.25) AS p25,
       quantile_cont(CAST(n_chars AS DOUBLE), 0.5) AS p50, quantile_cont(CAST(n_chars AS DOUBLE), 0.9) AS p90
FROM documents GROUP BY lang""", "p25", "p50", "p90"))
def q_a16(spark, d):
    docs = table(spark, d, "documents").select("lang", F.col("n_chars").cast("double").alias("v"))
    return finish(S.percentiles(docs, ["lang"], "v", {"p25": 0.25, "p50": 0.5, "p90": 0.9}))


@register("A16_global", rounded("""SELECT quantile_cont(l_extendedprice, 0.8) AS p80,
       quantile_cont(l_extendedprice, 0.2) AS p20 FROM lineitem""", "p80", "p20"))
def q_a16g(spark, d):
    li = table(spark, d, "lineitem").select("l_extendedprice")
    return finish(S.percentiles(li, [], "l_extendedprice", {"p80": 0.8, "p20": 0.2}))


@register("A17", rounded("""WITH m AS (SELECT lang, avg(CAST(n_chars AS DOUBLE)) AS mu FROM documents GROUP BY lang)
SELECT d.lang, quantile_cont(CAST(d.n_chars AS DOUBLE), 0.5) AS median,
       avg(abs(CAST(d.n_chars AS DOUBLE) - m.mu)) * 1.4826 AS mad
FROM documents d JOIN m ON d.lang = m.lang GROUP BY d.lang""", "median", "mad"))
def q_a17(spark, d):
    docs = table(spark, d, "documents").select("lang", F.col("n_chars").cast("double").alias("v"))
    return finish(S.robust_baseline(docs, ["lang"], "v"))


@register("W7", rounded("""SELECT doc_id, lang,
  (CAST(n_chars AS DOUBLE) - avg(n_chars) OVER (PARTITION BY lang))
    / stddev_samp(n_chars) OVER (PARTITION BY lang) AS n_chars_z
FROM documents""", "n_chars_z"))
def q_w7(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars_z"))
    return finish(S.standardise(docs, ["n_chars_z"], ["lang"]).select("doc_id", "lang", "n_chars_z"))


@register("A9", rounded("""SELECT o_custkey AS simulation_id, count(*) AS n,
  stddev_samp(o_totalprice) AS stddev FROM orders GROUP BY o_custkey""", "stddev"))
def q_a9(spark, d):
    o = table(spark, d, "orders")
    return finish(o.groupBy(F.col("o_custkey").alias("simulation_id")).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("o_totalprice").alias("stddev")))


def b_splits(spark, d):
    ln = F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        "l_returnflag",
        F.when(ln <= 4, "train").when(ln == 5, "validation").otherwise("test").alias("split"),
        (F.col("l_extendedprice") / 2500.0).alias("prediction"),
        F.col("l_quantity").alias("assay_score"))


_RX = _AVG_RANK.format(k="l_returnflag, split", v="prediction")
_RY = _AVG_RANK.format(k="l_returnflag, split", v="assay_score")


@register("A18", rounded(f"""WITH b AS (SELECT l_returnflag,
    CASE WHEN l_linenumber <= 4 THEN 'train' WHEN l_linenumber = 5 THEN 'validation' ELSE 'test' END AS split,
    l_extendedprice / 2500.0::DOUBLE AS prediction, l_quantity AS assay_score FROM lineitem),
u AS (SELECT * FROM b UNION ALL
      SELECT l_returnflag, 'train_validation', prediction, assay_score FROM b WHERE split IN ('train', 'validation')),
r AS (SELECT *, {_RX} AS rx, {_RY} AS ry FROM u)
SELECT l_returnflag, split, sqrt(avg((prediction - assay_score) * (prediction - assay_score))) AS rmse,
       1 - sum((prediction - assay_score) * (prediction - assay_score)) / (var_pop(assay_score) * count(*)) AS r2,
       covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) AS spearman
FROM r GROUP BY l_returnflag, split""", "rmse", "r2", "spearman"))
def q_a18(spark, d):
    return finish(S.regression_metrics(b_splits(spark, d), ["l_returnflag"], "split",
                                       "prediction", "assay_score"))
