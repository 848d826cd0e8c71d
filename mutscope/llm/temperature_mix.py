"""Mixing sources by temperature, realised as budgeted block permutations.

A source's share p of all tokens becomes the weight p**e / sum of all p**e.
The exponent e lies between 1 (as the corpus is) and 0 (all sources alike)
and is bisected until the weights' entropy reaches a target, or until no
source repeats more often than a limit. Each pass tries ``GRID`` exponents in
one aggregation over the table of sources, so the sources may be any number.

A source's budget is its weight times the token budget. It is filled with
whole passes over the source and a last, partial pass. Every pass puts the
source's blocks, and the documents in each block, in a new pseudo-random
order. The partial pass takes blocks in that order while they fit, then
documents of the next block while they fit; it is described by two cut
values a source, so realising it is a filter, not a sort of the corpus.

Defined results: a null source is a source of its own; documents without
tokens cost nothing and come in every whole pass, and in a partial pass if
their block is taken; a corpus without tokens is returned once, as it is;
repeated rows are documents of their own, and rows alike in id and text are
taken or left together; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..util import materialize
from .ordering import hot_key_join, hot_keys

GRID = 32
PASSES = 5                    # precision GRID ** -PASSES
BLOCK_TOKENS = 1 << 16
MAX_BLOCKS = 1 << 16          # of a source; beyond, its blocks grow
SEED = 20240229


def tokens(text: str) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"\S+")), F.lit(0)).cast("long")


def _measure(totals: DataFrame, exponents: list[float], budget: float) -> list[tuple[float, float]]:
    """(entropy, most passes over a source) of each exponent."""
    cols = []
    for i, e in enumerate(exponents):
        w = F.pow("p", F.lit(e))
        cols += [F.sum(w).alias(f"z{i}"), F.sum(w * F.log(w)).alias(f"a{i}"), F.max(w / F.col("t")).alias(f"m{i}")]
    r = totals.agg(*cols).first()
    return [(math.log(r[f"z{i}"]) - r[f"a{i}"] / r[f"z{i}"], budget * r[f"m{i}"] / r[f"z{i}"])
            for i in range(len(exponents))]


def solve_exponent(totals: DataFrame, budget: float, entropy_share: float | None = None,
                   max_passes: float | None = None) -> float:
    """The exponent in [0, 1] for the table of sources (p: share, t: tokens).

    ``entropy_share``: the largest exponent whose entropy reaches this share
    of the greatest possible one. ``max_passes``: the smallest exponent with
    no more passes over any source. Where the target lies beyond what [0, 1]
    gives, the nearer end.
    """
    if (entropy_share is None) == (max_passes is None):
        raise ValueError("give entropy_share or max_passes")
    lo, hi = 0.0, 1.0
    ends = _measure(totals, [lo, hi], budget)
    # true up to some exponent, false beyond it
    low = (lambda h, _: h >= entropy_share * ends[0][0]) if max_passes is None else (lambda _, m: m > max_passes)
    if low(*ends[1]):
        return hi
    if not low(*ends[0]):
        return lo
    for _ in range(PASSES):
        grid = [lo + (hi - lo) * i / GRID for i in range(GRID + 1)]
        ok = [low(*x) for x in _measure(totals, grid, budget)]
        at = max(i for i, x in enumerate(ok[:-1]) if x)
        lo, hi = grid[at], grid[at + 1]
    return lo if max_passes is None else hi


def source_plan(docs: DataFrame, source_col: str, id_col: str, text_col: str, entropy_share: float | None,
                max_passes: float | None, budget_share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(narrow rows, a row for each source: weight, whole passes and cuts of the partial pass)."""
    rows = docs.select(F.col(source_col).cast("string").alias("source"), tokens(text_col).alias("tokens"),
                       document_key(id_col, text_col, seed).alias("doc_key"))
    rows = materialize(rows, "tokens")
    totals = materialize(rows.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")), "sources")
    total = totals.agg(F.sum("t")).first()[0] or 0
    if not total:
        return rows, totals.select("source", "n", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("passes"),
                                   F.lit(1).cast("long").alias("blocks"), F.lit(None).cast("long").alias("block_cut"),
                                   F.lit(None).cast("long").alias("part_block"), F.lit(None).cast("long").alias("doc_cut"))
    budget = budget_share * total
    shares = totals.where("t > 0").withColumn("p", F.col("t") / F.lit(float(total)))
    e = solve_exponent(shares, budget, entropy_share, max_passes)
    z = shares.agg(F.sum(F.pow("p", F.lit(e)))).first()[0]
    plan = (totals.withColumn("weight", F.when(F.col("t") > 0, F.pow(F.col("t") / F.lit(float(total)), F.lit(e)) / F.lit(z))
                              .otherwise(F.lit(0.0)))
            .withColumn("want", F.floor(F.col("weight") * F.lit(float(budget))))
            .withColumn("passes", F.when(F.col("t") > 0, F.floor(F.col("want") / F.col("t"))).otherwise(F.lit(1)).cast("long"))
            .withColumn("rest", F.when(F.col("t") > 0, F.col("want") - F.col("passes") * F.col("t")).otherwise(F.lit(0)))
            .withColumn("blocks", F.least(F.lit(MAX_BLOCKS), F.floor(F.col("t") / BLOCK_TOKENS) + 1).cast("long"))
            .select("source", "n", "weight", "passes", "rest", "blocks"))
    plan = materialize(plan, "plan")

    # the partial pass: blocks in this pass's order while they fit ...
    hot = hot_keys(totals, "source", "n")
    dealt = hot_key_join(rows, plan.select("source", "passes", "rest", "blocks"), "source", hot, F.col("doc_key"))
    dealt = dealt.where("rest > 0").withColumn("block", block_of("doc_key", "blocks"))
    blocks = (dealt.groupBy("source", "passes", "rest", "block").agg(F.sum("tokens").alias("tokens"))
              .withColumn("key", block_key(seed, F.col("source"), F.col("passes"), F.col("block"))))
    run = Window.partitionBy("source").orderBy("key", "block")
    blocks = blocks.withColumn("upto", F.sum("tokens").over(run))
    cut = materialize(
        blocks.groupBy("source").agg(
            F.max(F.when(F.col("upto") <= F.col("rest"), F.col("key"))).alias("block_cut"),
            F.min(F.when(F.col("upto") > F.col("rest"), F.struct("key", "block", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left")))).alias("part"))
        .select("source", "block_cut", F.col("part.block").alias("part_block"), F.col("part.left").alias("left")), "cuts")
    # ... then documents of the next block while they fit
    part = cut.where("left > 0").select("source", F.col("part_block").alias("block"), "left")
    inside = Window.partitionBy("source").orderBy("order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    docs_in = (dealt.join(part, dealt["source"].eqNullSafe(part["source"]) & (dealt["block"] == part["block"]))
               .select(dealt["source"], "tokens", "left", pass_key(F.col("doc_key"), F.col("passes")).alias("order")))
    doc_cut = (docs_in.withColumn("upto", F.sum("tokens").over(inside)).where("upto <= left")
               .groupBy("source").agg(F.max("order").alias("doc_cut")))
    cut, doc_cut = cut.drop("left").withColumnRenamed("source", "s1"), doc_cut.withColumnRenamed("source", "s2")
    plan = (plan.join(cut, plan["source"].eqNullSafe(cut["s1"]), "left")
            .join(doc_cut, plan["source"].eqNullSafe(doc_cut["s2"]), "left").drop("s1", "s2", "rest"))
    return rows, materialize(plan, "plan")


def document_key(id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col).cast("string"))


def block_of(doc_key: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), F.col(doc_key)), F.col(blocks))


def block_key(seed: int, source: Column, pass_: Column, block: Column) -> Column:
    """Where a source's block comes in a pass."""
    return F.xxhash64(F.lit(seed), source, pass_.cast("long"), block)


def pass_key(doc_key: Column, pass_: Column) -> Column:
    """Where a document comes in its block in a pass."""
    return F.xxhash64(F.lit(2), doc_key, pass_.cast("long"))


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
        entropy_share: float | None = None, max_passes: float | None = None, budget_share: float = 1.0,
        seed: int = SEED) -> DataFrame:
    """``docs`` repeated or left out as the weights ask.

    Added columns: weight (of the source), pass (0, 1, ...), block, block_key
    and doc_key; sorting by pass, block_key and doc_key gives the training
    order, in which sources alternate block by block.
    """
    docs = docs.drop("weight", "pass", "block", "block_key", "doc_key")
    _, plan = source_plan(docs, source_col, id_col, text_col, entropy_share, max_passes, budget_share, seed)
    added = ("weight", "passes", "blocks", "block_cut", "part_block", "doc_cut")
    plan = plan.select(F.col("source").alias("_s"), "n", *[F.col(c).alias(f"_{c}") for c in added])
    rows = (docs.withColumn("_s", F.col(source_col).cast("string"))
            .withColumn("_k", document_key(id_col, text_col, seed)))
    rows = hot_key_join(rows, plan.drop("n"), "_s", hot_keys(plan, "_s", "n"), F.col("_k"))
    block = block_of("_k", "_blocks")
    key = block_key(seed, F.col("_s"), F.col("_passes"), block)
    more = (F.coalesce(key <= F.col("_block_cut"), F.lit(False))
            | (F.coalesce(block == F.col("_part_block"), F.lit(False))
               & F.coalesce(pass_key(F.col("_k"), F.col("_passes")) <= F.col("_doc_cut"), F.lit(False))))
    last = F.col("_passes") - F.when(more, F.lit(0)).otherwise(F.lit(1))
    rows = (rows.withColumn("_last", last).where("_last >= 0")
            .withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last")))))
    return rows.select(*docs.columns, F.col("_weight").alias("weight"), "pass", block.alias("block"),
                       block_key(seed, F.col("_s"), F.col("pass"), block).alias("block_key"),
                       pass_key(F.col("_k"), F.col("pass")).alias("doc_key"))
