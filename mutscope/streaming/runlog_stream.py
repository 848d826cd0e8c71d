"""Incremental run-log ingestion with Structured Streaming.

The reference has no streaming operators; its only incremental behaviour is
that a running simulation appends rows to the run log as rounds finish and
updates the run row when it ends.  These two helpers express exactly that
on a stream of log rows:

* ``sink_to_store`` — each micro-batch is a batch of the run-log store, named
  by its id, so a retried one replaces itself; batch and streaming writes share
  one table.
* ``run_state_stream`` — the U5 last-state fold as a streaming aggregation
  (``max_by`` per run id, update mode); state is one row per run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.runlog_store import RunLogStore


def sink_to_store(stream: DataFrame, root: str, table: str, checkpoint: str, name: str = "stream",
                  trigger_once: bool = False) -> StreamingQuery:
    """``name`` tells the batches of several streams into one table apart."""
    def write_batch(batch: DataFrame, batch_id: int):
        RunLogStore(batch.sparkSession, root).append(table, batch, f"{name}-{batch_id}")

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def run_state_stream(events: DataFrame, id_col: str, ts_col: str, tie_col: str,
                     state_cols: list[str]) -> DataFrame:
    """Streaming twin of ``operators.runlog.run_state`` (use outputMode 'update'
    or 'complete')."""
    order = F.struct(F.col(ts_col), F.col(tie_col))
    return events.groupBy(id_col).agg(
        F.min(ts_col).alias("first_ts"), F.max(ts_col).alias("last_ts"),
        F.count(F.lit(1)).alias("n_events"),
        *[F.max_by(c, order).alias(f"last_{c}") for c in state_cols])
