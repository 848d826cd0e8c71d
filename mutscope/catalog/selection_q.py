"""Catalog entries for acquisition and selection
(Q1–Q7, M5, T1–T6, A15, A27, J9, J11, J12, J14, U1, U3, C10).

Binding ``b_pred``: one prediction per order (id = o_orderkey), group = the
customer (a simulation), score = o_totalprice/1e5, ensemble components = the
order's line prices/1e5; assay = a deterministic perturbation of the score.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selection as SEL
from ..operators import stats as S
from ..plans.acquisition import acquisition_step
from ..session import table
from ..sources import bindings as B
from ..util import finish
from .bind_sql import rounded, with_
from .registry import register
from .variants_q import _cdf_sql


def pred(spark, d):
    p = B.predictions(spark, d)
    mean, sd = SEL.ensemble_summary("components")
    return p.withColumn("uncertainty", sd).withColumn("ens_mean", mean)


def assay(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"),
                    (F.col("o_totalprice") / 100003.0 * (1 + ((F.col("o_orderkey") % 5) - 2) / 10.0)).alias("assay_score"),
                    F.col("o_orderstatus").alias("status"))


PRED_SQL = with_("b_pred", extra={
    "pr": """SELECT *, list_aggregate(components, 'stddev_pop') AS uncertainty, list_avg(components) AS ens_mean
             FROM b_pred""",
    "asy": """SELECT o_orderkey AS id, o_totalprice / 100003.0::DOUBLE * (1 + ((o_orderkey % 5) - 2) / 10.0::DOUBLE)
                     AS assay_score, o_orderstatus AS status FROM orders"""})


def _h(seed_sql: str, id_sql: str, digits: int = 15) -> str:
    return f"('0x' || substr(md5(CAST({seed_sql} AS VARCHAR) || '|' || CAST({id_sql} AS VARCHAR)), 1, {digits}))::BIGINT"


@register("M5", rounded(PRED_SQL + "SELECT id, ens_mean, uncertainty FROM pr", "ens_mean", "uncertainty"))
def q_m5(spark, d):
    return finish(pred(spark, d).select("id", "ens_mean", "uncertainty"))


@register("Q1", rounded(PRED_SQL + f"SELECT id, {_h('7', 'id', 13)} / 4503599627370496.0 AS acquisition_score FROM pr",
                        "acquisition_score"))
def q_q1(spark, d):
    return finish(pred(spark, d).select("id", SEL.acq_random(7).alias("acquisition_score")))


@register("Q2", rounded(PRED_SQL + """SELECT id, score AS greedy, score + 2.0 * uncertainty AS ucb,
  uncertainty AS variance FROM pr""", "greedy", "ucb", "variance"))
def q_q2(spark, d):
    """Q2–Q4: greedy, UCB (w = 2) and variance scores."""
    p = pred(spark, d)
    return finish(p.select("id", SEL.acq_greedy().alias("greedy"), SEL.acq_ucb(2.0).alias("ucb"),
                           SEL.acq_variance().alias("variance")))


@register("Q7", rounded(PRED_SQL + """SELECT 'greedy' AS strategy, id, score AS acquisition_score FROM pr
UNION ALL SELECT 'ucb', id, score + 0.5 * uncertainty FROM pr
UNION ALL SELECT 'variance', id, uncertainty FROM pr""", "acquisition_score"))
def q_q7(spark, d):
    """Q7: strategies looked up by name in the registry, stacked."""
    p = pred(spark, d)
    parts = [("greedy", {}), ("ucb", {"weight": 0.5}), ("variance", {})]
    out = None
    for name, params in parts:
        s = p.select(F.lit(name).alias("strategy"), "id", SEL.acquisition(name, **params).alias("acquisition_score"))
        out = s if out is None else out.unionByName(s)
    return finish(out)


@register("Q5", rounded(PRED_SQL + f""", best AS (SELECT o_custkey AS sim_key, max(o_totalprice / 100003.0::DOUBLE) AS best_score
  FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
z AS (SELECT p.id, p.score, p.uncertainty, b.best_score, p.score - b.best_score AS imp,
             CASE WHEN p.uncertainty <> 0 THEN (p.score - b.best_score) / p.uncertainty END AS zz
      FROM pr p LEFT JOIN best b ON p.sim_key = b.sim_key)
SELECT id, CASE WHEN uncertainty IS NULL OR uncertainty = 0 THEN 0.0::DOUBLE
  ELSE imp * {_cdf_sql('zz')} + uncertainty * (exp(-zz * zz / 2) / {(2 * 3.141592653589793) ** 0.5!r}) END AS ei
FROM z""", "ei"))
def q_q5(spark, d):
    p = pred(spark, d)
    train = table(spark, d, "orders").filter(F.col("o_orderstatus") == "F").select(
        F.col("o_custkey").alias("sim_key"), (F.col("o_totalprice") / 100003.0).alias("assay_score"))
    # a group without a training score has no best, and no improvement over it
    best = SEL.best_observed(train, ["sim_key"])
    return finish(p.join(best, "sim_key", "left").select("id", SEL.acq_expected_improvement().alias("ei")))


@register("Q6", rounded(PRED_SQL + f""", t AS (SELECT id, components, sim_key,
  max(coalesce(len(components), 0)) OVER (PARTITION BY sim_key) AS members,
  {_h('(sim_key + 3) * (sim_key + 3 + 1) // 2 + 3', "'thompson'", 8)} AS h FROM pr)
SELECT id, CASE WHEN members > 0 THEN components[CAST(h % members + 1 AS INTEGER)] END AS thompson
FROM t""", "thompson"))
def q_q6(spark, d):
    p = SEL.ensemble_size(pred(spark, d).withColumn("round_num", F.lit(3)), ["sim_key", "round_num"])
    return finish(p.select("id", SEL.acq_thompson("sim_key", "round_num").alias("thompson")))


@register("Q1_seed", rounded(PRED_SQL + f"SELECT id, {_h('42', 'id', 15)} AS h FROM pr"))
def q_q1_seed(spark, d):
    """Seeded md5 order key (shared by Q1, T4, T5): equal in both engines."""
    return finish(pred(spark, d).select("id", SEL.seeded_hash(F.lit(42), "id").alias("h")))


@register("T1", rounded(PRED_SQL + """SELECT sim_key, id, score FROM (SELECT *, row_number() OVER
  (PARTITION BY sim_key ORDER BY score DESC NULLS LAST, id) AS rn FROM pr) WHERE rn <= 3""", "score"))
def q_t1(spark, d):
    return finish(SEL.top_k(pred(spark, d), 3, ["sim_key"], "score").select("sim_key", "id", "score"))


_T2_SQL = """, sc AS (SELECT sim_key, id, score, score + 1.0 * uncertainty AS acquisition_score FROM pr),
ra AS (SELECT sim_key, id, row_number() OVER (PARTITION BY sim_key ORDER BY acquisition_score DESC NULLS LAST, id) AS ra FROM sc),
rp AS (SELECT sim_key, id, row_number() OVER (PARTITION BY sim_key ORDER BY score DESC NULLS LAST, id) AS rp FROM sc),
c AS (SELECT sc.*, ra.ra, rp.rp FROM sc JOIN ra USING (sim_key, id) JOIN rp USING (sim_key, id)
      WHERE ra.ra <= 2 OR rp.rp <= 4),
f AS (SELECT *, sum(CASE WHEN ra <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY sim_key) AS na,
             CASE WHEN ra > 2 THEN row_number() OVER (PARTITION BY sim_key ORDER BY CASE WHEN ra > 2 THEN rp END NULLS LAST) END AS rf
      FROM c),
chosen AS (SELECT sim_key, id, score, acquisition_score, ra <= 2 AS top_acquisition_score, rp <= 4 AS top_prediction
           FROM f WHERE ra <= 2 OR rf <= 4 - na)
"""


def _t2(spark, d):
    p = pred(spark, d).withColumn("acquisition_score", SEL.acq_ucb(1.0))
    return SEL.select_batch(p.select("sim_key", "id", "score", "acquisition_score"), 2, 2, ["sim_key"])


@register("T2", rounded(PRED_SQL + _T2_SQL + "SELECT * FROM chosen", "score", "acquisition_score"))
def q_t2(spark, d):
    return finish(_t2(spark, d))


@register("J9", rounded(PRED_SQL + _T2_SQL + """SELECT sim_key, id, score FROM pr
WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.sim_key = pr.sim_key AND c.id = pr.id)""", "score"))
def q_j9(spark, d):
    """Remaining pool after the batch (left anti join)."""
    p = pred(spark, d).select("sim_key", "id", "score")
    return finish(SEL.remaining(p, _t2(spark, d), ["sim_key", "id"]))


_T4_SQL = f""", hh AS (SELECT sim_key, id, score, {_h('42', 'id')} AS h FROM pr),
sp AS (SELECT sim_key, id, score, CASE WHEN row_number() OVER (PARTITION BY sim_key ORDER BY h, id)
            <= floor(count(*) OVER (PARTITION BY sim_key) * (1 - 0.2)) THEN 'simulation' ELSE 'test' END AS split
       FROM hh)
"""


def _t4(spark, d):
    return SEL.seeded_split(pred(spark, d).select("sim_key", "id", "score"), 0.2, 42, ["sim_key"])


@register("T4", rounded(PRED_SQL + _T4_SQL + "SELECT * FROM sp", "score"))
def q_t4(spark, d):
    return finish(_t4(spark, d))


@register("T5", rounded(PRED_SQL + f"""SELECT sim_key, id, score FROM (SELECT *, row_number() OVER
  (PARTITION BY sim_key ORDER BY {_h('42', 'id')}, id) AS rn FROM pr) WHERE rn <= 2""", "score"))
def q_t5(spark, d):
    return finish(SEL.seeded_sample(pred(spark, d).select("sim_key", "id", "score"), 2, 42, ["sim_key"]))


@register("T5_check", PRED_SQL + "SELECT sim_key, count(*) AS available FROM pr GROUP BY sim_key HAVING count(*) < 2")
def q_t5c(spark, d):
    """T5 guard: groups that cannot supply the requested sample size."""
    return finish(SEL.check_sample_size(pred(spark, d), 2, ["sim_key"]))


@register("T6", rounded("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC
  LIMIT 1""", "o_totalprice"))
def q_t6(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return finish(o.orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(1)
                  .select("o_orderkey", "o_totalprice"))


@register("J11", rounded(PRED_SQL + "SELECT p.id, p.score, a.assay_score FROM pr p JOIN asy a ON p.id = a.id",
                         "score", "assay_score"))
def q_j11(spark, d):
    p = pred(spark, d).select("id", "score")
    return finish(SEL.attach_assay(p, assay(spark, d).select("id", "assay_score")))


@register("A15", rounded(PRED_SQL + """SELECT p.sim_key, max(a.assay_score) AS best_score,
  arg_min(p.id, (-a.assay_score, p.id)) AS best_id FROM pr p JOIN asy a ON p.id = a.id GROUP BY p.sim_key""",
                         "best_score"))
def q_a15(spark, d):
    j = SEL.attach_assay(pred(spark, d).select("sim_key", "id"), assay(spark, d))
    return finish(SEL.best_result(j, ["sim_key"]))


@register("T3", rounded(PRED_SQL + _T4_SQL + """, u AS (SELECT s.*, a.assay_score FROM sp s JOIN asy a ON s.id = a.id)
SELECT sim_key, id, score, assay_score, split FROM (SELECT *, row_number() OVER
  (PARTITION BY sim_key ORDER BY score DESC NULLS LAST, id) AS rn FROM u) WHERE rn <= 5""", "score", "assay_score"))
def q_t3(spark, d):
    """Top-5 predicted over train ∪ remaining with their assay scores."""
    sp = _t4(spark, d)
    u = SEL.attach_assay(sp, assay(spark, d).select("id", "assay_score"))
    return finish(SEL.top_predicted(u, 5, ["sim_key"]).select("sim_key", "id", "score", "assay_score", "split"))


@register("T3_all", rounded(PRED_SQL + _T4_SQL + """SELECT s.sim_key, s.id, s.score, a.assay_score, s.split
FROM sp s JOIN asy a ON s.id = a.id""", "score", "assay_score"))
def q_t3_all(spark, d):
    """T3 for runs that keep all predictions."""
    u = SEL.attach_assay(_t4(spark, d), assay(spark, d).select("id", "assay_score"))
    return finish(SEL.top_predicted(u, 5, ["sim_key"], keep_all=True).select("sim_key", "id", "score", "assay_score", "split"))


_U1_SPLIT = "CASE WHEN split = 'test' THEN 'test' WHEN id % 5 = 0 THEN 'validation' ELSE 'train' END"


def _three_splits(spark, d):
    sp = _t4(spark, d)
    held = F.col("id") % 5 == 0
    sim = sp.filter("split = 'simulation'").drop("split")
    return SEL.stack_splits(train=sim.filter(~held), validation=sim.filter(held), test=sp.filter("split = 'test'").drop("split"))


@register("U1", rounded(PRED_SQL + _T4_SQL + f"""SELECT sim_key, id, score, {_U1_SPLIT} AS split FROM sp""", "score"))
def q_u1(spark, d):
    return finish(_three_splits(spark, d).select("sim_key", "id", "score", "split"))


@register("A27", PRED_SQL + _T4_SQL + """, rows AS (
  SELECT sim_key, id, CASE WHEN split = 'test' THEN 'test' WHEN id % 5 = 0 THEN 'validation' ELSE 'train' END AS split
  FROM sp
  UNION ALL SELECT sim_key, id, 'test' FROM sp WHERE id % 97 = 0 AND split <> 'test'),
r2 AS (SELECT r.*, TRUE AS has_prediction, a.status <> 'P' AS has_assay FROM rows r JOIN asy a ON r.id = a.id),
g AS (SELECT sim_key, id, CAST(sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS n_train,
             CAST(sum(CASE WHEN split = 'validation' THEN 1 ELSE 0 END) AS BIGINT) AS n_validation,
             CAST(sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS BIGINT) AS n_test,
             CAST(sum(CAST(has_prediction AS INTEGER)) AS BIGINT) AS n_pred,
             CAST(sum(CAST(has_assay AS INTEGER)) AS BIGINT) AS n_assay FROM r2 GROUP BY sim_key, id),
v AS (SELECT *, CASE WHEN n_train > 0 AND n_validation > 0 THEN 'train_validation_overlap'
                     WHEN n_test > 0 AND n_train + n_validation > 0 THEN 'test_overlap'
                     WHEN n_pred <> n_assay THEN 'coverage_mismatch' END AS violation FROM g)
SELECT * FROM v WHERE violation IS NOT NULL""")
def q_a27(spark, d):
    sp = _t4(spark, d)
    rows = sp.select("sim_key", "id", F.when(F.col("split") == "test", "test")
                     .when(F.col("id") % 5 == 0, "validation").otherwise("train").alias("split"))
    extra = sp.filter((F.col("id") % 97 == 0) & (F.col("split") != "test")).select(
        "sim_key", "id", F.lit("test").alias("split"))
    a = assay(spark, d).select("id", (F.col("status") != "P").alias("has_assay"))
    r = rows.unionByName(extra).join(a, "id").withColumn("has_prediction", F.lit(True))
    out = SEL.validate_splits(r, ["sim_key"])
    return finish(out.select(*[F.col(c).cast("long") if c.startswith("n_") else F.col(c) for c in out.columns]))


@register("J12", """SELECT o.o_orderkey, c.c_name FROM orders o
LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c ON o.o_custkey = c.c_custkey""")
def q_j12(spark, d):
    """Look-up with missing → NULL (left join to a filtered dimension)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name")
    return finish(o.join(c, o.o_custkey == c.c_custkey, "left").select("o_orderkey", "c_name"))


@register("J14", """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT DISTINCT o_custkey FROM orders
  WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P')""")
def q_j14(spark, d):
    """Coverage gap — rows of the left side with no match (left anti):
    customers without an order of status P."""
    c = table(spark, d, "customer").select("c_custkey")
    o = table(spark, d, "orders").filter(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return finish(c.join(o, "c_custkey", "left_anti"))


@register("C10", rounded(PRED_SQL + _T2_SQL + """, ch AS (SELECT c.*, a.assay_score FROM chosen c JOIN asy a ON c.id = a.id),
best AS (SELECT sim_key, max(assay_score) AS best_score, arg_min(id, (-assay_score, id)) AS best_id,
                sqrt(avg((score - assay_score) * (score - assay_score))) AS batch_rmse,
                count(*) AS n_chosen FROM ch GROUP BY sim_key),
rem AS (SELECT sim_key, count(*) AS n_remaining FROM pr
        WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.sim_key = pr.sim_key AND c.id = pr.id) GROUP BY sim_key)
SELECT b.*, coalesce(r.n_remaining, 0) AS n_remaining FROM best b LEFT JOIN rem r ON b.sim_key = r.sim_key""",
                         "best_score", "batch_rmse"))
def q_c10(spark, d):
    """One acquisition step — score (UCB) → select batch → attach assays →
    best variant and batch RMSE → remaining pool size, per simulation."""
    return finish(_step(spark, d).best)


def _step(spark, d):
    p = pred(spark, d).withColumn("acquisition_score", SEL.acq_ucb(1.0))
    p = p.select("sim_key", "id", "score", "acquisition_score",
                 F.when(F.col("id") % 4 == 0, "test").when(F.col("id") % 4 == 1, "validation").otherwise("train").alias("split"))
    return acquisition_step(p, assay(spark, d), 2, 2, ["sim_key"])


@register("C10_batch", rounded(PRED_SQL + _T2_SQL + """SELECT c.sim_key, c.id, c.score, c.acquisition_score,
  c.top_acquisition_score, c.top_prediction, a.assay_score FROM chosen c JOIN asy a ON c.id = a.id""",
                               "score", "acquisition_score", "assay_score"))
def q_c10_batch(spark, d):
    """The chosen rows of the step."""
    return finish(_step(spark, d).batch.drop("split"))


@register("C10_metrics", rounded(PRED_SQL + """, j AS (SELECT p.sim_key, p.score, a.assay_score,
  CASE WHEN p.id % 4 = 0 THEN 'test' WHEN p.id % 4 = 1 THEN 'validation' ELSE 'train' END AS split
  FROM pr p JOIN asy a ON p.id = a.id),
u AS (SELECT * FROM j UNION ALL SELECT sim_key, score, assay_score, 'train_validation' FROM j WHERE split <> 'test'),
g AS (SELECT sim_key, split, sqrt(avg((score - assay_score) * (score - assay_score))) AS rmse, count(*) AS n FROM u GROUP BY sim_key, split)
SELECT sim_key, split, rmse FROM g""", "rmse"))
def q_c10_metrics(spark, d):
    """RMSE of every split and of the pooled one (R² and Spearman are A18's)."""
    return finish(_step(spark, d).metrics.select("sim_key", "split", "rmse"))


# ---------------------------------------------------------------- explicit ids for combined entries

@register("Q3", rounded(PRED_SQL + "SELECT id, score + 2.0 * uncertainty AS ucb FROM pr", "ucb"))
def q_q3(spark, d):
    """Q3: UCB = score + w·uncertainty (w = 2)."""
    return finish(pred(spark, d).select("id", SEL.acq_ucb(2.0).alias("ucb")))


@register("Q4", rounded(PRED_SQL + "SELECT id, uncertainty AS variance FROM pr", "variance"))
def q_q4(spark, d):
    """Q4: variance acquisition = ensemble uncertainty."""
    return finish(pred(spark, d).select("id", SEL.acq_variance().alias("variance")))


@register("U3", rounded(PRED_SQL + _T2_SQL + """SELECT sim_key, id, score FROM pr
WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.sim_key = pr.sim_key AND c.id = pr.id)""", "score"))
def q_u3(spark, d):
    """Difference by id (pool minus batch) — the anti join of J9."""
    p = pred(spark, d).select("sim_key", "id", "score")
    return finish(SEL.remaining(p, _t2(spark, d), ["sim_key", "id"]))
