"""Catalog entries for feature and model jobs.

Binding ``b_tokens``: each embedding row (64 floats) is 16 tokens × 4 dims, all
of which are used; sequence s goes on over the rows s² … (s+1)² − 1, so
sequences of many lengths occur.
``b_features``: the embedding vector with ``label`` as regression target.
MLlib fits (forest, ridge, PCA, mixtures) are rows-only entries; their
invariants are checked in tests.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import features as FT
from ..operators import forest as FO
from ..operators import learners as LR
from ..operators import models as M
from ..operators import ridge as RG
from ..operators import variants as V
from ..session import table
from ..sources import bindings as B
from ..util import finish, materialize
from .bind_sql import rounded
from .registry import register
from .variants_q import _LLR_SQL

S, OVERLAP = 8, 0.5
GMM_W = (0.4, 0.6)
GMM_MU = ((-0.1,) * 4, (0.1,) * 4)
GMM_VAR = ((0.01,) * 4, (0.02,) * 4)

TOK_SQL = """WITH tok AS (SELECT s AS seq_id, CAST((vec_id - s * s) * 16 + t AS INTEGER) AS pos, CAST(dm AS INTEGER) AS dim,
    CAST(embedding[t * 4 + dm + 1] AS DOUBLE) AS value
  FROM (SELECT vec_id, CAST(floor(sqrt(vec_id)) AS BIGINT) AS s, embedding, unnest(range(0, 16)) AS t FROM embeddings) a,
       range(0, 4) r(dm))
"""


def tokens(spark, d):
    s = F.floor(F.sqrt("vec_id")).cast("long")
    return FT.tokens_from_flat(table(spark, d, "embeddings"), s, (F.col("vec_id") - s * s) * 16, "embedding", 16, 4)


@register("M8", rounded(TOK_SQL + """, m AS (SELECT seq_id, dim, avg(value) AS v FROM tok GROUP BY seq_id, dim)
SELECT seq_id, list(v ORDER BY dim) AS vector FROM m GROUP BY seq_id""", arrays=("vector",)))
def q_m8(spark, d):
    return finish(FT.pool_mean(tokens(spark, d)))


@register("M9", rounded(TOK_SQL + "SELECT seq_id, list(value ORDER BY dim) AS vector FROM tok WHERE pos = 0 GROUP BY seq_id",
                        arrays=("vector",)))
def q_m9(spark, d):
    return finish(FT.pool_first(tokens(spark, d)))


def _win_sql(how: str, fixed: bool) -> str:
    agg = "avg" if how == "mean" else "max"
    empty = "0.0" if how == "mean" else repr(FT.EMPTY_MAX)
    if fixed:
        bounds = """CASE WHEN seg * stride + w > len THEN greatest(0, len - w) ELSE seg * stride END AS st,
                    CASE WHEN seg * stride + w > len THEN len ELSE seg * stride + w END AS en"""
    else:
        bounds = "seg * stride AS st, least(seg * stride + w, len) AS en"
    tail = ("SELECT seq_id, list(v ORDER BY seg, dim) AS vector FROM pooled GROUP BY seq_id" if fixed else
            f"""grid AS (SELECT seq_id, seg, d AS dim FROM win2, range(0, 4) r(d)),
fullg AS (SELECT grid.seq_id, grid.seg, grid.dim, coalesce(pooled.v, {empty}) AS v FROM grid
         LEFT JOIN pooled ON grid.seq_id = pooled.seq_id AND grid.seg = pooled.seg AND grid.dim = pooled.dim)
SELECT seq_id, list(v ORDER BY seg, dim) AS vector FROM fullg GROUP BY seq_id""")
    return rounded(TOK_SQL + f""", geo AS (SELECT seq_id, max(pos) + 1 AS len FROM tok GROUP BY seq_id),
g2 AS (SELECT *, greatest(1, len // {S}) AS w FROM geo),
g3 AS (SELECT *, greatest(1, w - CAST(floor(w * {OVERLAP}) AS BIGINT)) AS stride FROM g2),
win AS (SELECT seq_id, len, w, stride, unnest(range(0, {S})) AS seg FROM g3),
win2 AS (SELECT seq_id, seg, {bounds} FROM win),
pooled AS (SELECT w.seq_id, w.seg, t.dim, {agg}(t.value) AS v FROM win2 w JOIN tok t
           ON w.seq_id = t.seq_id AND t.pos >= w.st AND t.pos < w.en GROUP BY w.seq_id, w.seg, t.dim)
{"" if fixed else ","}{tail}""", arrays=("vector",))


@register("M10", _win_sql("mean", False))
def q_m10(spark, d):
    return finish(FT.pool_windows(tokens(spark, d), S, OVERLAP, "mean"))


@register("M10_max", _win_sql("max", False))
def q_m10m(spark, d):
    return finish(FT.pool_windows(tokens(spark, d), S, OVERLAP, "max"))


@register("M11", _win_sql("mean", True))
def q_m11(spark, d):
    return finish(FT.pool_windows_fixed(tokens(spark, d), S, OVERLAP, "mean"))


def _fisher_sql() -> str:
    K, D = len(GMM_W), 4
    comps = " UNION ALL ".join(
        f"SELECT {k} AS k, {GMM_W[k]!r}::DOUBLE AS w, {d} AS dim, {GMM_MU[k][d]!r}::DOUBLE AS mu, {GMM_VAR[k][d]!r}::DOUBLE AS var"
        for k in range(K) for d in range(D))
    return rounded(TOK_SQL + f""", gm AS ({comps}),
tk AS (SELECT t.seq_id, t.pos, g.k, g.w, t.dim, t.value, g.mu, g.var FROM tok t JOIN gm g ON t.dim = g.dim),
lp AS (SELECT seq_id, pos, k, any_value(w) AS w,
              ln(any_value(w)) - 0.5 * sum(ln({2 * math.pi!r} * var) + (value - mu) * (value - mu) / var) AS logp
       FROM tk GROUP BY seq_id, pos, k),
lm AS (SELECT *, max(logp) OVER (PARTITION BY seq_id, pos) AS mx FROM lp),
ga AS (SELECT seq_id, pos, k, exp(logp - (mx + ln(sum(exp(logp - mx)) OVER (PARTITION BY seq_id, pos)))) AS gamma
       FROM lm),
st AS (SELECT tk.seq_id, tk.k, tk.dim, any_value(tk.w) AS w,
              sum(ga.gamma * (tk.value - tk.mu) / tk.var) AS s1,
              sum(ga.gamma * ((tk.value - tk.mu) * (tk.value - tk.mu) / tk.var - 1)) AS s2
       FROM tk JOIN ga ON tk.seq_id = ga.seq_id AND tk.pos = ga.pos AND tk.k = ga.k
       GROUP BY tk.seq_id, tk.k, tk.dim),
ln_ AS (SELECT seq_id, count(DISTINCT pos) AS L FROM tok GROUP BY seq_id),
lg AS (SELECT st.seq_id, k, dim, 0 AS ord, s1 / (L * sqrt(w)) AS v FROM st JOIN ln_ ON st.seq_id = ln_.seq_id
       UNION ALL SELECT st.seq_id, k, dim, 1, s2 / (L * sqrt(w)) FROM st JOIN ln_ ON st.seq_id = ln_.seq_id),
pw AS (SELECT seq_id, k, dim, ord, sign(v) * sqrt(abs(v)) AS v FROM lg),
nm AS (SELECT seq_id, sqrt(sum(v * v)) AS n FROM pw GROUP BY seq_id),
fv AS (SELECT pw.seq_id, pw.k, pw.dim, pw.ord, CASE WHEN nm.n > 0 THEN pw.v / nm.n ELSE pw.v END AS v
       FROM pw JOIN nm ON pw.seq_id = nm.seq_id)
SELECT seq_id, list(v ORDER BY ord, k, dim) AS fisher_vector FROM fv GROUP BY seq_id""", arrays=("fisher_vector",))


@register("M13", _fisher_sql())
def q_m13(spark, d):
    """Fisher vectors against a fixed diagonal mixture (K = 2)."""
    return finish(FT.fisher_vectors(tokens(spark, d), GMM_W, GMM_MU, GMM_VAR))


@register("M2", rounded("""WITH x AS (SELECT vec_id, d, CAST(embedding[d + 1] AS DOUBLE) AS v
  FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS d FROM embeddings)),
s AS (SELECT d, avg(v) AS m, stddev_pop(v) AS sd FROM x GROUP BY d)
SELECT vec_id, list((v - m) / sd ORDER BY x.d) AS scaled FROM x JOIN s ON x.d = s.d GROUP BY vec_id""",
                        arrays=("scaled",)))
def q_m2(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return finish(FT.scale_features(e, "embedding").select("vec_id", "scaled"))


@register("M6", rounded(f"SELECT part_id, llr AS prediction FROM ({_LLR_SQL})", "prediction"))
def q_m6(spark, d):
    """Zero-shot scorer: the prediction is the substitution's LLR."""
    ds = B.datasets(spark, d)
    r = V.llr(B.variants(spark, d), ds, V.logprob_table(ds))
    return finish(M.predict_llr(r).select("part_id", "prediction"))


def _features(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("double").alias("y"))


@register("M1")
def q_m1(spark, d):
    """PCA to 8 dims of centred embeddings (rows-only: component signs are arbitrary)."""
    f = _features(spark, d)
    return FT.fit_pca(f, "embedding", 8).transform(f).select("vec_id", "pca")


@register("M1_wide", rounded("""WITH x AS (SELECT vec_id, d, CAST(embedding[d + 1] AS DOUBLE) AS v
  FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS d FROM embeddings)),
m AS (SELECT d, avg(v) AS m FROM x GROUP BY d)
SELECT vec_id, sum((v - m) * (v - m)) AS square FROM x JOIN m USING (d) GROUP BY vec_id""", "square"))
def q_m1w(spark, d):
    """Randomised axes, all 64 of them: without sign, the squared length of every projected vector."""
    f = _features(spark, d)
    p = FT.fit_wide_pca(f, "embedding", 64, max_passes=2).transform(f)
    return finish(p.select("vec_id", F.aggregate("pca", F.lit(0.0), lambda a, v: a + v * v).alias("square")))


@register("M3")
def q_m3(spark, d):
    """Random forest on embeddings, 100 trees grown until leaves are pure; components per tree, mean, population σ."""
    f = _features(spark, d).withColumn("g", F.lit(0))
    model = FO.fit_forests(f, ["g"], "embedding", "y", "vec_id")
    return finish(FO.predict_forests(model, f, "embedding").select("vec_id", "components", "prediction", "uncertainty"))


@register("M4")
def q_m4(spark, d):
    """Bagged ridge (10 members, α = 1) on embeddings."""
    f = _features(spark, d)
    models = M.fit_bagged_ridge(f, "embedding", "y", "vec_id", members=10)
    return finish(M.predict_bagged(models, f, "embedding").select("vec_id", "components", "prediction", "uncertainty"))


def _poisson_sql(u: str) -> str:
    """The Poisson(1) count of a uniform number, as in ``poisson_draw``."""
    steps, cdf, p = [], 0.0, math.exp(-1.0)
    while cdf + p > cdf:
        cdf += p
        steps.append(f"({u} >= {cdf!r}::DOUBLE)::INTEGER")
        p /= len(steps)
    return " + ".join(steps)


@register("M4_line", rounded(f"""WITH f AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(label AS DOUBLE) AS y, m,
    ('0x' || substr(md5(CAST(42000 + m AS VARCHAR) || '|' || CAST(vec_id AS VARCHAR)), 1, 13))::BIGINT / {float(1 << 52)!r} AS u
  FROM (SELECT *, unnest(range(0, 10)) AS m FROM embeddings)),
w AS (SELECT *, {_poisson_sql("u")} AS w FROM f),
a AS (SELECT m, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w GROUP BY m),
c AS (SELECT a.m, any_value(mx) AS mx, any_value(my) AS my,
    sum(w * (x - mx) * (y - my)) / (sum(w * (x - mx) * (x - mx)) + 1.0) AS slope FROM w JOIN a USING (m) GROUP BY a.m),
p AS (SELECT vec_id, m, my + slope * (x - mx) AS p FROM w JOIN c USING (m))
SELECT vec_id, list(p ORDER BY m) AS components, avg(p) AS prediction, stddev_pop(p) AS uncertainty FROM p GROUP BY vec_id""",
                             "prediction", "uncertainty", arrays=("components",)))
def q_m4_line(spark, d):
    """Bagged ridge on one feature, where every member has a closed form."""
    f = _features(spark, d).withColumn("x", F.slice("embedding", 1, 1))
    coefs = RG.fit_ridges(f, [], "x", "y", M.bootstrap_weights(10, 42, "vec_id"), alpha=1.0)
    return finish(RG.predict_ridges(f, coefs, [], "x").select("vec_id", "components", "prediction", "uncertainty"))


def _group_features(spark, d):
    return _features(spark, d).withColumn("grp", (F.col("vec_id") % 5).cast("int")).withColumn(
        "x", F.col("embedding").cast("array<double>"))


@register("M7")
def q_m7(spark, d):
    """Ridge per group (vec_id mod 5) in one job: Gram sums → small solves."""
    f = _group_features(spark, d)
    coefs = M.group_ridge(f, ["grp"], "x", "y", alpha=1.0)
    return finish(M.predict_group_ridge(f, coefs, ["grp"], "x").select("vec_id", "grp", "prediction"))


@register("M7_line", rounded("""WITH f AS (SELECT vec_id, CAST(vec_id % 5 AS INTEGER) AS grp, CAST(embedding[1] AS DOUBLE) AS x,
  CAST(label AS DOUBLE) AS y FROM embeddings),
a AS (SELECT grp, avg(x) AS mx, avg(y) AS my FROM f GROUP BY grp),
c AS (SELECT grp, any_value(mx) AS mx, any_value(my) AS my,
  sum((x - mx) * (y - my)) / (sum((x - mx) * (x - mx)) + 0.5) AS slope FROM f JOIN a USING (grp) GROUP BY grp)
SELECT vec_id, grp, my + slope * (x - mx) AS prediction FROM f JOIN c USING (grp)""", "prediction"))
def q_m7_line(spark, d):
    """Ridge per group on one feature, in closed form."""
    f = _group_features(spark, d).withColumn("x", F.slice("x", 1, 1))
    coefs = M.group_ridge(f, ["grp"], "x", "y", alpha=0.5)
    return finish(M.predict_group_ridge(f, coefs, ["grp"], "x").select("vec_id", "grp", "prediction"))


@register("M7_forest")
def q_m7_forest(spark, d):
    """A training job by name: forests of all (simulation, round) groups at once, seeded by both."""
    f = _features(spark, d).withColumn("simulation_num", (F.col("vec_id") % 3).cast("int")).withColumn(
        "round_num", (F.col("vec_id") % 2).cast("int"))
    out = LR.train_job(f, f, "RandomForestRegression", ["simulation_num", "round_num"], "embedding", "y", "vec_id",
                       F.col("simulation_num"), F.col("round_num"), n_estimators=20)
    return finish(out.select("vec_id", "simulation_num", "round_num", "components", "prediction", "uncertainty"))


@register("M12")
def q_m12(spark, d):
    """Diagonal Gaussian mixture (K = 2) over residue vectors: weights, means, variances."""
    return FT.fit_mixture(tokens(spark, d), 2).table(spark)


@register("M13_fitted")
def q_m13_fitted(spark, d):
    """Fisher vectors against the mixture that M12 fits to the same tokens, stored as a table and read again."""
    t = tokens(spark, d)
    mix = FT.Mixture.read(materialize(FT.fit_mixture(t, 8).table(spark), "mixture"))
    return finish(FT.fisher_vectors(t, mix.weights, mix.means, mix.variances))


@register("M14")
def q_m14(spark, d):
    """Bimodal threshold of document lengths (log scale) in each language."""
    docs = table(spark, d, "documents").select("lang", F.log1p("n_chars").alias("v"))
    return finish(FT.bimodal_threshold(docs, "v", ["lang"]))
