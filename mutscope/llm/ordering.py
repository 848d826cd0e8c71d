"""A global row order without a single-task window, and a join that splits hot keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..util import bounded_broadcast, materialize

HOT_SHARE = 64       # a key with more than 1/64 of the rows is hot, so 63 at most
SALTS = 64
LIST_BYTES = 4 << 20  # of a list that is broadcast: the estimate of a written table is its compressed
                      # size, and sorted ids are ten times larger in memory


def _numbered(batches, names):
    """Adds the running sum of ``_w`` before each row of this task, and the task's number."""
    part, total = TaskContext.get().partitionId(), 0
    for b in batches:
        w = b.column(len(names)).to_numpy()
        run = np.cumsum(w) + total
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:len(names)], pa.array(np.full(len(w), part, np.int32)), pa.array(run - w, pa.int64()),
             pa.array(w, pa.int64())], names=[*names, "_part", "_before", "_w"])
        total = run[-1] if len(w) else total


def global_running_total(df: DataFrame, order: list[str], weight: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``weight`` (long) over all rows before, in ``order``.

    Rows are dealt out by ranges of ``order`` and sorted; each task numbers
    its range and writes it, each range's total gives the following ranges
    their offset (one row a range). Rows alike in all of ``order`` come in
    any order and in one range.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()),
                           T.StructField("_before", T.LongType()), T.StructField("_w", T.LongType())])
    names = df.columns
    rows = (df.withColumn("_w", weight.cast("long")).repartitionByRange(*order).sortWithinPartitions(*order)
            .mapInArrow(lambda batches: _numbered(batches, names), schema))
    rows = materialize(rows, "ranges")
    totals = rows.groupBy("_part").agg(F.sum("_w").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    return (rows.join(bounded_broadcast(offsets), "_part")
            .withColumn(name, F.col("_before") + F.col("_offset"))
            .drop("_w", "_part", "_before", "_offset"))


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: how many rows come before, in ``order`` (0, 1, ...).

    Like ``global_running_total`` with weight 1, but without Python: a sorted
    range's rows are numbered by ``monotonically_increasing_id``, whose upper
    bits are the range and whose lower 33 bits count its rows.
    """
    rows = (df.repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn("_row", F.monotonically_increasing_id()))
    rows = materialize(rows, "ranges").withColumn("_part", F.shiftright("_row", 33))
    totals = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    return (rows.join(bounded_broadcast(offsets), "_part")
            .withColumn(name, F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_offset"))
            .drop("_part", "_row", "_offset"))


def hot_keys(counts: DataFrame, key: str, n: str) -> list:
    """Keys with more than 1/HOT_SHARE of all rows (fewer than HOT_SHARE of them)."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(n) * HOT_SHARE > total).where(F.col(key).isNotNull()).select(key).collect()]


def hot_key_join(rows: DataFrame, table: DataFrame, key: str, hot: list, spread: Column) -> DataFrame:
    """Left join of ``rows`` with ``table`` (a row for each ``key``), null keys equal.

    A small table is broadcast. Otherwise the rows of hot keys, and the null
    key's, are spread over ``SALTS`` partitions by ``spread``, and their few
    rows of ``table`` are repeated for each.
    """
    if bounded_broadcast(table, LIST_BYTES) is not table:
        t = table.withColumnRenamed(key, "_key")
        return rows.join(F.broadcast(t), rows[key].eqNullSafe(t["_key"]), "left").drop("_key")
    is_hot = lambda c: c.isNull() | (c.isin(hot) if hot else F.lit(False))
    salt = F.when(is_hot(F.col(key)), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    t = table.withColumn("_salt2", F.explode(F.when(is_hot(F.col(key)), F.sequence(F.lit(0), F.lit(SALTS - 1)))
                                             .otherwise(F.array(F.lit(0))))).withColumnRenamed(key, "_key")
    rows = rows.withColumn("_salt", salt)
    on = rows[key].eqNullSafe(t["_key"]) & (rows["_salt"] == t["_salt2"])
    return rows.join(t, on, "left").drop("_key", "_salt", "_salt2")
