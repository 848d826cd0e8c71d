"""One acquisition step as a table job, for all simulations at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import selection as SEL
from ..operators import stats as S
from ..util import materialize, null_safe_join


@dataclass(frozen=True)
class AcquisitionStep:
    """The results of a step; each is planned, and its intermediates are written, when it is first asked for."""

    pred: DataFrame         # scored predictions
    known: DataFrame        # id, ``assay_score``
    batch: DataFrame        # chosen rows with their flags and assay scores
    keys: list[str]
    split: str
    score: str
    id_col: str
    n_top: int
    keep_all: bool

    @cached_property
    def remaining(self) -> DataFrame:
        """Rows that were not chosen."""
        return SEL.remaining(self.pred, self.batch, [*self.keys, self.id_col])

    @cached_property
    def best(self) -> DataFrame:
        """Per group: best result, RMSE and size of the batch, rows that remain."""
        err = F.col(self.score) - F.col("assay_score")
        sizes = self.batch.groupBy(*self.keys).agg(F.sqrt(F.avg(err * err)).alias("batch_rmse"), F.count(F.lit(1)).alias("n_chosen"))
        left = self.remaining.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n_remaining"))
        best = null_safe_join(SEL.best_result(self.batch, self.keys, id_col=self.id_col), sizes, self.keys)
        best = null_safe_join(best, left, self.keys, "left")
        return best.withColumn("n_remaining", F.coalesce("n_remaining", F.lit(0)).cast("long"))

    @cached_property
    def assayed(self) -> DataFrame:
        """Predictions that have an assay score, with it."""
        return SEL.attach_assay(self.pred, self.known, self.id_col)

    @cached_property
    def metrics(self) -> DataFrame:
        """Per group and split: RMSE, R², Spearman, and for the pooled split; all are written, whichever are read."""
        return materialize(S.regression_metrics(self.assayed, self.keys, self.split, self.score, "assay_score"), "metrics")

    @cached_property
    def top(self) -> DataFrame:
        """Best predicted rows over train and remaining, with assay scores."""
        return SEL.top_predicted(self.assayed, self.n_top, self.keys, self.score, self.id_col, self.keep_all)


def acquisition_step(pred: DataFrame, assay: DataFrame, n_acq: int, n_pred: int, keys, split: str = "split",
                     acq: str = "acquisition_score", score: str = "score", id_col: str = "id", n_top: int = 5,
                     keep_all: bool = False) -> AcquisitionStep:
    """Scored predictions (``acq``, ``score``, ``split`` of the model's data) and
    assay results (id, ``assay_score``) → batch, best result, metrics, top
    predictions, remaining pool."""
    keys = list(keys)
    known = assay.select(id_col, "assay_score")
    # scored predictions feed the batch and every result, the batch three of them: each is written once
    pred = materialize(pred, "scored")
    batch = materialize(SEL.attach_assay(SEL.select_batch(pred, n_acq, n_pred, keys, acq, score, id_col), known, id_col), "batch")
    return AcquisitionStep(pred, known, batch, keys, split, score, id_col, n_top, keep_all)
