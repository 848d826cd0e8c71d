"""Rows joined with a counted table of their values, heavy values and NULLs spread out.

A table with a line for each value (a rank, a q-value) and the count of its
rows tells which values are heavy: those with more than 1 / ``HOT`` of all
rows, fewer than ``HOT`` of them. Their rows, and rows without a value, are
dealt over ``SALTS`` partitions in place of one; the few lines of heavy values
are repeated for each. A table whose written size allows it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import BROADCAST_LIMIT_BYTES, estimated_bytes, materialize, null_safe_join

HOT = 64
SALTS = 64


def spread(df: DataFrame, table: DataFrame, keys: list[str], value: str, counts: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_salt``: 0, but for rows of heavy values and rows without one."""
    total = table.agg(F.sum(counts)).first()[0] or 0
    on = [*keys, value]
    hot = table.where(F.col(counts) * HOT > total).select(*on, F.lit(True).alias("_heavy"))
    # the place of a row within its partition: the same whenever the partition is computed again
    place = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    rows = null_safe_join(df.withColumn("_place", place), F.broadcast(hot), on, "left")
    rows = rows.withColumn("_salt", F.when(F.col("_heavy") | F.col(value).isNull(), F.col("_place")).otherwise(F.lit(0))).drop("_heavy", "_place")
    lines = null_safe_join(table, F.broadcast(hot), on, "left")
    each = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows, lines.withColumn("_salt", F.explode(each)).drop("_heavy")


def attach_by_value(df: DataFrame, table: DataFrame, keys: list[str], value: str, counts: str = "_cnt",
                    size: int | None = None, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Left join of ``df`` with ``table`` (a line for each ``keys`` and ``value``, its number of rows in ``counts``).

    NULL keys find their group's lines; a NULL value finds none. ``size`` is a
    known bound of the table in bytes, such as the size of the written rows it
    is computed from; without one within ``limit`` the table is written.
    """
    keys = list(keys)
    if size is None or size > limit:
        table = materialize(table, "values")
        size = estimated_bytes(table)
    if size is not None and size <= limit:
        return null_safe_join(df, F.broadcast(table.drop(counts)), [*keys, value], "left")
    rows, lines = spread(df, table, keys, value, counts)
    return null_safe_join(rows, lines.drop(counts), [*keys, value, "_salt"], "left").drop("_salt")
