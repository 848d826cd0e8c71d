"""M7: learners by name, fitted and applied to all groups at once, with seeds.

A training job takes the labelled rows and the rows to score of every group
(run, sub-run, simulation, round), and a learner's name from the run's
configuration. A seeded learner's bootstrap weights come from (simulation,
round, row), so a simulation repeats itself and another one differs; rows
whose seeds are equal draw alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .forest import fit_forests, poisson_weights, predict_forests
from .models import predict_llr
from .ridge import fit_ridges, predict_ridges

SEED = "_seed"


@dataclass(frozen=True)
class Learner:
    """``fit(train, keys, features, label, id_col, **parameters)`` gives a model, ``predict(model, pool, keys, features)`` the pool
    with components, prediction and uncertainty. ``uses_random_seed``: the fit reads the seed column."""
    fit: Callable
    predict: Callable
    uses_random_seed: bool


def _fit_ridge(train, keys, features, label, id_col, n_estimators: int = 10, alpha: float = 1.0):
    weights = poisson_weights(n_estimators, F.col(SEED), F.col(id_col))
    return fit_ridges(train, keys, features, label, weights, alpha)


def _fit_forest(train, keys, features, label, id_col, n_estimators: int = 100):
    return fit_forests(train, keys, features, label, id_col, trees=n_estimators, seed=F.col(SEED))


def _predict_llr(model, pool, keys, features):
    out = predict_llr(pool, features)
    return out.withColumn("components", F.lit(None).cast("array<double>"))


_FOREST = Learner(_fit_forest, lambda model, pool, keys, features: predict_forests(model, pool, features), True)

# Learner names as run configurations give them.
LEARNERS: dict[str, Learner] = {
    "RidgeRegression": Learner(_fit_ridge, lambda model, pool, keys, features: predict_ridges(pool, model, keys, features), True),
    "RandomForestRegression": _FOREST,
    "ESM2RandomForestRegression": _FOREST,
    "ESM2LogLikelihood": Learner(lambda *a, **k: None, _predict_llr, False),
}


def learner(name: str) -> Learner:
    """The learner called ``name``; KeyError lists the known names."""
    try:
        return LEARNERS[name]
    except KeyError:
        raise KeyError(f"unknown learner {name!r}; known: {', '.join(sorted(LEARNERS))}") from None


def train_job(train: DataFrame, pool: DataFrame, name: str, keys: list[str], features: str, label: str, id_col: str,
              simulation: Column, round_num: Column, **parameters) -> DataFrame:
    """M7: ``pool`` with components, prediction and uncertainty of the learner ``name`` fitted on ``train``, group by group.

    ``keys`` are columns of both frames; ``simulation`` and ``round_num`` are
    columns of ``train``. A pool row of a group without training rows has
    NULLs; its columns of the results' names are replaced.
    """
    chosen = learner(name)
    if chosen.uses_random_seed:
        part = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
        train = train.withColumn(SEED, F.concat_ws("|", part(simulation), part(round_num)))
    model = chosen.fit(train, keys, features, label, id_col, **parameters)
    return chosen.predict(model, pool, keys, features)
