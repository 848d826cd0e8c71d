"""Small helpers shared by operators: size-checked broadcast, output rounding."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import stage_folder

# A side is broadcast only when the optimizer's size estimate is below this.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the optimized plan (no job is run)."""
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    except Exception:  # pragma: no cover - e.g. Spark Connect sessions
        return None
    # py4j hands Scala's BigInt over as a Python int; keep a string fallback
    return int(size) if isinstance(size, int) else int(str(size.toString()))


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Broadcast ``df`` only if its estimated size is known and under ``limit``.

    Otherwise the plan is left alone: the join shuffles both sides on the key
    (and AQE may still switch to a broadcast once it sees runtime sizes).
    """
    size = estimated_bytes(df)
    if size is not None and size <= limit:
        return F.broadcast(df)
    return df


ROUND_LIMIT = 1e15  # beyond this magnitude a double has no 6th decimal to round


def _round_expr(c: Column, digits: int) -> Column:
    x = c.cast("double")
    scale = float(10 ** digits)
    y = x * scale + 0.5
    # beyond 2**53 a double is whole already, and ``floor`` would squeeze it into a long
    whole = F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)
    return F.when(F.abs(x) < ROUND_LIMIT, whole / scale).otherwise(x)


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column so results compare across engines.

    ``floor(x·10^d + 0.5) / 10^d`` is plain IEEE arithmetic, so any engine
    evaluating it on the same double returns the same double (``round``
    differs: Spark rounds the shortest decimal string, others the binary value).
    """
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(_round_expr(F.col(f.name), digits).alias(f.name))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType)):
            cols.append(F.transform(F.col(f.name), lambda v: _round_expr(v, digits)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def nan_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(float("nan")))


def materialize(df: DataFrame, tag: str = "stage", **options: str) -> DataFrame:
    """Write ``df`` once under the shared ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage (later steps that read the result several times neither
    recompute nor re-plan the upstream) and survives executor loss, unlike a
    cache.  One job, unlike ``Dataset.checkpoint`` which computes twice.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path, **options)
    return spark.read.parquet(path)


def null_safe_join(df: DataFrame, other: DataFrame, keys, how: str = "inner") -> DataFrame:
    """``df`` joined with ``other`` on ``keys``, NULL equal to NULL; key columns come from ``df``."""
    other = other.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(other[f"_r_{k}"]) for k in keys])
    return df.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def attach_group_stats(df: DataFrame, stats: DataFrame, keys) -> DataFrame:
    """Join per-group statistics (one row per group) back to rows.

    NULL keys find their group's row. Without grouping keys the statistics
    are a single row, attached as a scalar subquery (computed once, no join).
    """
    keys = list(keys or [])
    if keys:
        if (estimated_bytes(stats) or BROADCAST_LIMIT_BYTES + 1) > BROADCAST_LIMIT_BYTES:
            # a row a group, but an estimate of the aggregate's input: the written table tells
            stats = materialize(stats, "group-stats")
        return attach_written(df, stats, keys)
    packed = stats.select(F.struct(*[F.col(c) for c in stats.columns]).alias("_s")).scalar()
    return df.withColumn("_s", packed).select("*", "_s.*").drop("_s")


def attach_written(df: DataFrame, stats: DataFrame, keys) -> DataFrame:
    """``df`` with the per-group rows of ``stats``, a written table, so that its size on disk decides on a broadcast.

    The estimate of an aggregate that is not written yet is its input's size.
    """
    return null_safe_join(df, bounded_broadcast(stats), list(keys))
