"""Skew-safe running aggregates over an ordered value within groups.

Rank-type statistics (average ranks, ROC steps, AUC, Benjamini–Hochberg,
exact order statistics) all need a running sum/min/max over the values of a
group in sorted order.  A plain ``Window.partitionBy(keys).orderBy(v)`` sends
each group to one task, so a group holding a third of the data becomes a
single straggler task.

``ordered_scan`` has one path for every size:

1. rows are dealt out by ranges of (keys, value) and sorted within them; a
   large group covers several ranges, rows with equal (keys, value) never part;
2. each task goes through its range once and adds the running aggregate of
   each group so far, and the rows are written with their range number (lineage
   cut): the ranges are the only exchange of the rows;
3. only the first group of a range can have begun in an earlier one, so there
   is at most one group a range that needs an offset.  The groups that go on
   are found from each range's first and last key, their totals per range are
   aggregated, and the offsets (at most one row a range) are broadcast.

NULL keys are a group like any other.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..util import materialize

_OPS = {"sum": F.sum, "min": F.min, "max": F.max}


def _combine(op: str, off: Column, loc: Column) -> Column:
    if op == "sum":
        return F.coalesce(off, F.lit(0)) + F.coalesce(loc, F.lit(0))
    if op == "min":
        return F.least(off, loc)
    return F.greatest(off, loc)


def _same(a: DataFrame, b: DataFrame, keys, prefix: str) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[prefix + k]) for k in keys], F.lit(True))


def _as_numbers(column):
    """(int64 or float64 values, which are not NULL) of a numeric, date or timestamp column."""
    valid = np.asarray(column.is_valid())
    kind = column.type
    if pa.types.is_date32(kind):
        column = column.cast(pa.int32())
    target = pa.float64() if pa.types.is_floating(kind) or pa.types.is_decimal(kind) else pa.int64()
    return column.cast(target).fill_null(0).to_numpy(zero_copy_only=False), valid


class _Running:
    """One running aggregate over the sorted rows of a task, batch by batch."""

    def __init__(self, op: str, inclusive: bool):
        self.op, self.inclusive = op, inclusive
        self.value, self.seen = None, False            # of the last row's group so far

    def add(self, column, group: np.ndarray, goes_on: bool):
        """(values, which are not NULL); ``group`` counts from 0, ``goes_on``: group 0 began in an earlier batch."""
        v, valid = _as_numbers(column)
        if self.op != "sum":
            worst = (np.iinfo(np.int64) if v.dtype == np.int64 else np.finfo(float))
            v = np.where(valid, v, worst.max if self.op == "min" else worst.min)
        by = pd.Series(v).groupby(group)
        run = {"sum": by.cumsum, "min": by.cummin, "max": by.cummax}[self.op]().to_numpy().copy()
        seen = pd.Series(valid).groupby(group).cummax().to_numpy().copy()
        if goes_on and self.seen:
            first = group == 0
            run[first] = {"sum": np.add, "min": np.minimum, "max": np.maximum}[self.op](run[first], self.value)
            seen[first] = True
        before, before_seen = (self.value, self.seen) if goes_on and self.seen else (0, False)
        self.value, self.seen = run[-1], bool(seen[-1])
        if self.inclusive:
            return run, seen
        same = np.concatenate(([goes_on], group[1:] == group[:-1]))
        return (np.where(same, np.concatenate(([before], run[:-1])).astype(run.dtype), 0),
                same & np.concatenate(([before_seen], seen[:-1])))


def _run_batches(keys, names, aggs, inclusive, schema, batches):
    running = {o: _Running(op, inclusive) for o, (op, _) in aggs.items()}
    last = None                                        # the previous batch's last row of the keys
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        goes_on = last is not None
        for i, k in enumerate(keys):
            column = b.column(k)
            whole = pa.concat_arrays([last[i], column]) if last is not None else column
            code = whole.dictionary_encode("encode").indices.to_numpy()
            step = code[1:] != code[:-1]
            if last is not None:
                goes_on &= not step[0]
                step = step[1:]
            change[1:] |= step
        last = [b.column(k).slice(b.num_rows - 1) for k in keys]
        group = np.cumsum(change)
        out = []
        for o, (_, c) in aggs.items():
            v, seen = running[o].add(b.column(c), group, goes_on)
            kind = schema.field(f"_loc_{o}").type
            arr = pa.array(v, mask=~seen)
            out.append(arr.cast(pa.int32()).cast(kind) if pa.types.is_date32(kind) else arr.cast(kind))
        yield pa.RecordBatch.from_arrays([*b.columns, *out], names=[*b.schema.names, *(f"_loc_{o}" for o in aggs)])


def ordered_scan(df: DataFrame, keys, order: Column, aggs: dict[str, tuple[str, str]],
                 inclusive: bool = True) -> DataFrame:
    """Add running aggregates in ascending ``order`` within ``keys``; see ``scan_and_rows``."""
    return scan_and_rows(df, keys, order, aggs, inclusive)[0]


def scan_and_rows(df: DataFrame, keys, order: Column, aggs: dict[str, tuple[str, str]],
                  inclusive: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows with running aggregates, the written rows without them).

    Totals of a group are best summed from the written rows: their size, and
    so a bound for anything summed from them, is known.

    ``aggs`` maps output column → (op, input column), op in sum/min/max, over
    numbers, dates or timestamps (sums: numbers).  ``inclusive=False``
    aggregates strictly earlier rows only (empty → 0 for sums, NULL for
    min/max).
    """
    keys = list(keys)
    names = df.columns
    if not keys:
        df = df.withColumn("_g", F.lit(0))
        keys = ["_g"]
    d = df.withColumn("_o", order)
    d = d.repartitionByRange(*keys, "_o").sortWithinPartitions(*keys, "_o").withColumn("_part", F.spark_partition_id())
    added = d.limit(0).select(*[_OPS[op](c).over(Window.orderBy(F.lit(0))).alias(f"_loc_{o}") for o, (op, c) in aggs.items()])
    schema = T.StructType([*d.schema.fields, *added.schema.fields])
    arrow = to_arrow_schema(added.schema)
    d = materialize(d.mapInArrow(lambda it: _run_batches(keys, names, aggs, inclusive, arrow, it), schema), "scan")

    key = F.struct(*keys)
    ends = d.groupBy("_part").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    before = F.lag("_last").over(Window.orderBy("_part"))          # one row a range
    going = (ends.withColumn("_prev", before).where(F.col("_prev").isNotNull() & F.col("_prev").eqNullSafe(F.col("_first")))
             .select(*[F.col(f"_first.{k}").alias(f"_k_{k}") for k in keys]).distinct())
    totals = (d.join(F.broadcast(going), _same(d, going, keys, "_k_"), "left_semi").groupBy(*keys, "_part")
              .agg(*[_OPS[op](c).alias(f"_t_{o}") for o, (op, c) in aggs.items()]))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_k__part"),
                            *[_OPS[op](f"_t_{o}").over(earlier).alias(f"_off_{o}") for o, (op, _) in aggs.items()])
    rows = d.join(F.broadcast(offsets), _same(d, offsets, [*keys, "_part"], "_k_"), "left")
    rows = rows.select(*names, *[_combine(op, F.col(f"_off_{o}"), F.col(f"_loc_{o}")).alias(o)
                                 for o, (op, _) in aggs.items()])
    return rows, d.select(*names)
