"""Model jobs (M3, M4, M6, M7): ensembles whose members' predictions are kept.

* Forests of all groups, grown until leaves are pure: ``forest.py``. The
  bounded MLlib forest stays for trees of a given depth.
* Ridge for many groups and bootstrap members from one read: ``ridge.py``;
  here the single bagged ridge (M4) and the plain ridge of each group (M7).
* Learners by name, with seeds: ``learners.py``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..util import bounded_broadcast, null_safe_join
from .forest import poisson_draw
from .ridge import fit_ridges, predict_ridges
from .selection import seeded_uniform


def _summary(cols: list[str]) -> tuple[Column, Column, Column]:
    comps = F.array(*[F.col(c) for c in cols])
    n = float(len(cols))
    mean = F.aggregate(comps, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(comps, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    return comps, mean, F.sqrt(var)


def fit_forest(df: DataFrame, features: str, label: str, num_trees: int = 20, max_depth: int = 8,
               seed: int = 42):
    """M3: forest on embedding vectors (all features per split, leaves of 1)."""
    v = df.withColumn("_f", array_to_vector(F.col(features).cast("array<double>")))
    rf = RandomForestRegressor(featuresCol="_f", labelCol=label, numTrees=num_trees, maxDepth=max_depth,
                               featureSubsetStrategy="all", minInstancesPerNode=1, seed=seed)
    return rf.fit(v)


def predict_forest(model, df: DataFrame, features: str) -> DataFrame:
    """M3/M5: per-tree components, mean prediction, population σ over trees."""
    out = df.withColumn("_f", array_to_vector(F.col(features).cast("array<double>")))
    cols = []
    for i, tree in enumerate(model.trees):
        c = f"_tree{i}"
        out = tree.copy().setFeaturesCol("_f").setPredictionCol(c).transform(out)
        cols.append(c)
    comps, mean, sd = _summary(cols)
    return out.select(*df.columns, comps.alias("components"), mean.alias("prediction"),
                      sd.alias("uncertainty"))


def poisson1(u: Column) -> Column:
    """Poisson(1) bootstrap weight of a uniform column."""
    return poisson_draw(u).cast("double")


@dataclass
class RidgeMember:
    intercept: float
    coefficients: DenseVector


def bootstrap_weights(members: int, seed: int, id_col: str) -> Column:
    """array<double>: every member's md5-seeded weight of a row, equal in any engine with md5."""
    return F.array(*[poisson1(seeded_uniform(F.lit(seed * 1000 + m), id_col)) for m in range(members)])


def fit_bagged_ridge(df: DataFrame, features: str, label: str, id_col: str, members: int = 10,
                     alpha: float = 1.0, seed: int = 42) -> list[RidgeMember]:
    """M4: ``members`` ridge models (penalty α‖β‖², free intercept) on Poisson(1) bootstrap weights, from one read."""
    fitted = fit_ridges(df, [], features, label, bootstrap_weights(members, seed, id_col), alpha)
    return [RidgeMember(r["coef"][0], DenseVector(r["coef"][1:])) for r in fitted.orderBy("member").collect()]


def predict_bagged(models: list[RidgeMember], df: DataFrame, features: str) -> DataFrame:
    """M4/M5: member predictions, mean and population σ."""
    rows = [(m, [x.intercept, *x.coefficients.toArray().tolist()]) for m, x in enumerate(models)]
    return predict_ridges(df, df.sparkSession.createDataFrame(rows, "member int, coef array<double>"), [], features)


def predict_llr(df: DataFrame, llr_col: str = "llr") -> DataFrame:
    """M6: zero-shot scorer — the prediction is the log-likelihood ratio."""
    return df.withColumn("prediction", F.col(llr_col)).withColumn("uncertainty", F.lit(None).cast("double"))


# ---------------------------------------------------------------- M7: ridge for many groups

def group_ridge(df: DataFrame, keys: list[str], features: str, label: str, alpha: float = 1.0,
                weight: str | None = None) -> DataFrame:
    """M7: one ridge (intercept unpenalised) per group in a single job.

    Returns keys + ``coef`` (intercept first) — one small row per group.
    """
    w = F.array(F.col(weight) if weight else F.lit(1.0))
    return fit_ridges(df, keys, features, label, w, alpha).select(*keys, "coef")


def predict_group_ridge(df: DataFrame, coefs: DataFrame, keys: list[str], features: str) -> DataFrame:
    """Apply per-group coefficients (joined by key; one row per group)."""
    j = null_safe_join(df, bounded_broadcast(coefs), keys)
    dot = F.aggregate(F.zip_with(F.col(features).cast("array<double>"), F.slice("coef", F.lit(2), F.size("coef") - 1),
                                 lambda x, b: x * b), F.lit(0.0), lambda a, v: a + v)
    return j.withColumn("prediction", F.element_at("coef", 1) + dot).drop("coef")
