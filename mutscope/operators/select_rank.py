"""Exact order statistics by selection: no sort of the rows.

The first pass summarises every group with a mergeable quantile sketch
(``percentile_approx``, rank error n / ``ACCURACY``) and takes from it, for
each asked share, a bracket of values ``MARGIN`` rank errors to both sides, so
that the asked order statistics lie within. The second pass counts: values
within a bracket one by one, everything between brackets as a single number.
Both are aggregations with partial sums in every task, whatever the size or
skew of a group. What is left, at most about ``2 * MARGIN / ACCURACY`` of a
group's values for each share, gives exact positions by running counts. Groups
of up to ``ACCURACY`` rows are bracketed whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..util import attach_written, materialize
from .ordered import ordered_scan

ACCURACY = 10_000
MARGIN = 4
WINDOW_ROWS = 1 << 20        # values of a group within brackets, beyond which positions come from the ordered scan


def bracketed(rows: DataFrame, keys: list[str], coarse: Column, shares: list[float], extra: list[Column] = ()) -> DataFrame:
    """First pass: keys, ``_n`` rows, ``_lo`` and ``_hi`` (arrays: the bracket of each share, in terms of ``coarse``).

    ``coarse`` is a double that rises with the value that is asked for;
    ``extra`` are further aggregates of the same pass.
    """
    away = MARGIN / ACCURACY
    ends = [max(0.0, s - away) for s in shares] + [min(1.0, s + away) for s in shares]
    q = F.percentile_approx(coarse, ends, ACCURACY)
    g = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), q.alias("_q"), F.min(coarse).alias("_min"), F.max(coarse).alias("_max"), *extra)
    k = len(shares)
    small = F.col("_n") <= ACCURACY
    ends = lambda first, whole, edge: F.array(*[
        whole if edge(s) else F.when(small, whole).otherwise(F.col("_q")[first + i]) for i, s in enumerate(shares)])
    lo = ends(0, F.col("_min"), lambda s: s <= away)
    hi = ends(k, F.col("_max"), lambda s: s >= 1 - away)
    return materialize(g.withColumn("_lo", lo).withColumn("_hi", hi).drop("_q", "_min", "_max"), "brackets")


def counted_ranks(rows: DataFrame, keys: list[str], value: Column, coarse: Column, brackets: DataFrame,
                  extra: dict[str, Column] | None = None) -> DataFrame:
    """Second pass: keys, ``_v`` (NULL between brackets), ``_cnt``, and ``_cum``, the rows up to and with this value.

    ``extra`` are sums over the rows that stand behind each line.
    """
    extra = extra or {}
    j = attach_written(rows, brackets, keys)
    within = F.exists(F.arrays_zip("_lo", "_hi"), lambda b: (coarse >= b["_lo"]) & (coarse <= b["_hi"]))
    # rises with the value: how many brackets have begun and ended before it
    region = F.size(F.filter("_lo", lambda e: e <= coarse)) + F.size(F.filter("_hi", lambda e: e < coarse))
    c = (j.withColumn("_region", region).withColumn("_v", F.when(within, value))
         .groupBy(*keys, "_region", "_v").agg(F.count(F.lit(1)).alias("_cnt"), *[F.sum(e).alias(n) for n, e in extra.items()]))
    order = F.struct("_region", "_v")
    # values within brackets: all of a small group's, else a rank error's worth on both sides of each share
    k = F.size("_lo")
    values = F.when(F.col("_n") <= ACCURACY, F.col("_n")).otherwise(F.col("_n") * (2 * MARGIN + 2) / ACCURACY * k)
    if (brackets.agg(F.max(values)).first()[0] or 0) > WINDOW_ROWS:
        return ordered_scan(c, keys, order, {"_cum": ("sum", "_cnt")})
    running = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return c.withColumn("_cum", F.sum("_cnt").over(running))


def at_index(index: Column) -> Column:
    """The value at a 0-based index of its group, as an aggregate over ``counted_ranks``."""
    return F.max(F.when((F.col("_cum") - F.col("_cnt") <= index) & (index < F.col("_cum")), F.col("_v")))


def percentiles_of(df: DataFrame, keys: list[str], cols: list[str], probs: dict[str, float], deviation: bool = False) -> DataFrame:
    """keys, ``_col``, and the exact linearly interpolated percentiles ``probs`` of every column in ``cols``.

    ``df`` is read twice, whatever the number of columns. With ``deviation``
    also ``_mean`` and ``_away``, the mean distance from it, of the same two
    passes. A column without values in a group has no row.
    """
    # a frame without keys is one group
    whole = not keys
    keys = list(keys) or ["_g"]
    df = df.withColumn("_g", F.lit(0)) if whole else df
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_x")) for c in cols]))
    rows = df.select(*[F.col(k) for k in keys], each.alias("_e")).select(*keys, "_e._col", "_e._x").where("_x is not null")
    by = [*keys, "_col"]
    names, shares = list(probs), [float(p) for p in probs.values()]
    brackets = bracketed(rows, by, F.col("_x"), shares, [F.avg("_x").alias("_mean")])
    extra = {"_far": F.abs(F.col("_x") - F.col("_mean"))} if deviation else {}
    ranks = attach_written(counted_ranks(rows, by, F.col("_x"), F.col("_x"), brackets, extra), brackets.select(*by, "_n", "_mean"), by)
    aggs = [F.first("_n").alias("_n")]
    if deviation:
        aggs += [F.first("_mean").alias("_mean"), (F.sum("_far") / F.first("_n")).alias("_away")]
    for name, share in zip(names, shares):
        pos = F.lit(share) * (F.col("_n") - 1)
        aggs += [at_index(F.floor(pos)).alias(f"_{name}_lo"), at_index(F.ceil(pos)).alias(f"_{name}_hi")]
    g = ranks.groupBy(*by).agg(*aggs)
    value = lambda n, s: F.col(f"_{n}_lo") + (F.lit(s) * (F.col("_n") - 1) - F.floor(F.lit(s) * (F.col("_n") - 1))) * (
        F.col(f"_{n}_hi") - F.col(f"_{n}_lo"))
    out = [F.col(k) for k in by if k != "_g" or not whole]
    return g.select(*out, *(["_mean", "_away"] if deviation else []), *[value(n, s).alias(n) for n, s in zip(names, shares)])
