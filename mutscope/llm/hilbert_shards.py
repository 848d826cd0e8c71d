"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is cut into equally filled bins (rows with an equal value
share a bin); the bins are the coordinates of a cell, and the cell's place on
a Hilbert curve orders the rows. Runs of equal row count become the shards,
so each shard covers a compact box of the dimensions, and a reader that
filters on any of them skips most shards by their minima and maxima
(``shard_manifest``).

Law: ``rows``, the shards' row counts are at most one apart.

Defined results: a null dimension comes before all values; rows alike in
cell and tie-break columns are interchangeable; an empty table gives no rows;
with fewer rows than shards, the last shards are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import global_rank, global_running_total

BITS = 5
SHARDS = 16


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """(next state, digit) by ``state * 2**n + corner`` for an n-dimensional curve.

    A state is (entry corner, direction); corners are visited along a Gray
    code that is turned and mirrored to enter and leave where neighbours do.
    """
    size = 1 << n
    turn = lambda x, k: ((x >> k % n) | (x << (n - k % n))) & (size - 1)
    gray = [i ^ i >> 1 for i in range(size)]
    rank = {g: i for i, g in enumerate(gray)}
    entry = [0 if i == 0 else gray[2 * ((i - 1) // 2)] for i in range(size)]
    ones = lambda i: (~i & i + 1).bit_length() - 1  # noqa: E731  trailing ones
    axis = [0 if i == 0 else ones(i - 1) % n if i % 2 == 0 else ones(i) % n for i in range(size)]
    back = lambda x, k: turn(x, n - k % n)
    nxt, digit = [], []
    for state in range(size * n):
        e, d = divmod(state, n)
        for corner in range(size):
            w = rank[turn(corner ^ e, d + 1)]
            digit.append(w)
            nxt.append((e ^ back(entry[w], d + 1)) * n + (d + axis[w] + 1) % n)
    return nxt, digit


def hilbert_index(bins: list[str], bits: int = BITS) -> Column:
    """Place on the curve of the cell whose coordinates are in columns ``bins``."""
    n = len(bins)
    nxt, digit = curve_tables(n)
    corner = " + ".join(f"(shiftright({b}, i) & 1) * {1 << k}" for k, b in enumerate(bins))
    at = f"a.s * {1 << n} + {corner} + 1"
    lit = lambda xs: f"array({', '.join(map(str, xs))})"
    return F.expr(
        f"aggregate(sequence({bits - 1}, 0, -1), named_struct('s', 0, 'h', 0L), (a, i) -> named_struct("
        f"'s', element_at({lit(nxt)}, {at}), 'h', a.h * {1 << n} + element_at({lit(digit)}, {at})), a -> a.h)")


def _complement(digits: Column) -> Column:
    return F.translate(digits, "0123456789", "9876543210")


def _sortable_double(x: Column) -> Column:
    """Sign, exponent and 17 digits, each so that text order is value order; NaN last, as Spark sorts it."""
    told = F.format_string("%.16e", F.abs(x))
    power = F.substring_index(told, "e", -1).try_cast("int")
    digits = F.substring_index(told, "e", 1)
    key = lambda exponent: F.lpad((exponent + 500).cast("string"), 4, "0")
    endless = F.abs(x) == float("inf")
    return (F.when(F.isnan(x), F.lit("3")).when(x == 0, F.lit("1"))
            .when(x > 0, F.when(endless, F.lit("29")).otherwise(F.concat(F.lit("2"), key(power), digits)))
            .when(x < 0, F.when(endless, F.lit("00")).otherwise(F.concat(F.lit("00"), key(-power), _complement(digits)))))


def _sortable(df: DataFrame, dim: str) -> Column:
    """The dimension as a string that sorts as its values do, null first."""
    kind = df.schema[dim].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        c = F.col(dim).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
        return F.coalesce(F.concat(F.lit("+"), F.lpad(c.cast("string"), 20, "0")), F.lit(""))
    if kind in ("float", "double"):
        return F.coalesce(F.concat(F.lit("+"), _sortable_double(F.col(dim).cast("double"))), F.lit(""))
    if kind.startswith("decimal"):
        size = F.lpad(F.abs(F.col(dim)).cast("string"), 40, "0")
        return F.coalesce(F.concat(F.lit("+"), F.when(F.col(dim) < 0, F.concat(F.lit("0"), _complement(size)))
                                   .otherwise(F.concat(F.lit("1"), size))), F.lit(""))
    return F.coalesce(F.concat(F.lit("+"), F.col(dim).cast("string")), F.lit(""))


def bin_bounds(df: DataFrame, dims: list[str], bits: int = BITS) -> list[list[str]]:
    """For each dimension the least value of each bin but the first, as sortable strings.

    Counts cover all rows; at most 2**bits bounds a dimension come to the driver.
    """
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("dim"), _sortable(df, d).alias("value")) for i, d in enumerate(dims)])).alias("x"))
    counts = cells.groupBy("x.dim", "x.value").agg(F.count(F.lit(1)).alias("n"))
    run = global_running_total(counts, ["dim", "value"], F.col("n"), "before")
    total = run.agg((F.sum("n") / len(dims)).cast("long").alias("rows"))
    rows = total.first()["rows"] or 0
    if not rows:
        return [[] for _ in dims]
    place = ((F.col("before") - F.col("dim") * F.lit(rows)) * (1 << bits) / F.lit(rows)).cast("int")
    bounds = run.withColumn("bin", place).groupBy("dim", "bin").agg(F.min("value").alias("value")).collect()
    return [sorted(r["value"] for r in bounds if r["dim"] == i and r["bin"] > 0) for i in range(len(dims))]


def _bin(value: Column, bounds: list[str]) -> Column:
    """How many of the bounds are at most ``value``."""
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= value)) if bounds else F.lit(0)


def hilbert_order(df: DataFrame, dims: list[str], bits: int = BITS) -> DataFrame:
    """``df`` with ``hilbert``: each row's place on the curve."""
    bounds = bin_bounds(df, dims, bits)
    out = df
    for i, (d, b) in enumerate(zip(dims, bounds)):
        out = out.withColumn(f"_bin{i}", _bin(_sortable(df, d), b))
    names = [f"_bin{i}" for i in range(len(dims))]
    return out.withColumn("hilbert", hilbert_index(names, bits)).drop(*names)


def hilbert_shards(df: DataFrame, dims: list[str], ties: list[str], shards: int = SHARDS,
                   bits: int = BITS) -> DataFrame:
    """``df`` with hilbert, shard (0 to shards - 1) and slot (0, 1, ... in each shard).

    ``ties`` orders the rows of a cell. A cell with a large part of all rows
    is split by them like any other run. Columns of ``df`` with the added
    columns' names are replaced.
    """
    df = df.drop("hilbert", "shard", "slot")
    rows = hilbert_order(df, dims, bits)
    rows = global_rank(rows, ["hilbert", *ties], "_rank")
    n = rows.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if not n:
        return rows.select(*df.columns, "hilbert", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    base, more = divmod(n, shards)       # the first ``more`` shards have a row more
    split, rank = more * (base + 1), F.col("_rank")
    shard = F.when(rank < split, F.floor(rank / (base + 1))).otherwise(more + F.floor((rank - split) / max(base, 1)))
    slot = F.when(rank < split, F.pmod(rank, F.lit(base + 1))).otherwise(F.pmod(rank - split, F.lit(max(base, 1))))
    return rows.select(*df.columns, "hilbert", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str) -> None:
    """Write rows with shard and slot as one folder a shard, in slot order."""
    (df.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))


def shard_manifest(df: DataFrame, dims: list[str]) -> DataFrame:
    """For each shard its row count and the least and greatest value of each dimension."""
    return df.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"),
        *[f(d).alias(f"{d}_{name}") for d in dims for name, f in (("min", F.min), ("max", F.max))])
