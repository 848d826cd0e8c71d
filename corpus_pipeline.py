"""Corpus pipeline: stages over the documents table, each written and read again.

Columns beyond those of ``documents`` go through every stage unread and
unchanged, whatever their names; only ``shard`` and ``slot`` are replaced, by
the last stage's own.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutscope.llm.bottomk_dedup import grouped
from mutscope.llm.hilbert_shards import hilbert_shards
from mutscope.llm.lang_fusion import fit_text_model, identify
from mutscope.llm.ordering import LIST_BYTES
from mutscope.llm.qgram_decontam import decontaminate
from mutscope.llm.temperature_mix import mix
from mutscope.session import stage_folder, table
from mutscope.util import bounded_broadcast, materialize

ENTROPY_SHARE = 0.92          # of the greatest possible entropy of the source weights


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _stage(work: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``work`` with the further columns under names that no operator uses, and their own names again after it."""
    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        held = {c if c in COLUMNS else f"_beside{i}": c for i, c in enumerate(docs.columns)}
        out = work(spark, docs.toDF(*held), sf_dir)
        added = [c for c in out.columns if c not in held]
        out = out.drop(*[h for h, c in held.items() if c in added])
        return out.toDF(*[held.get(c, c) for c in out.columns])

    return run_stage


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id.

    Of repeated rows (same doc_id and text) one stays; of a group's rows that
    share its smallest doc_id, or of a group without any id, the one whose text
    has the smallest hash. Documents without words stay.
    """
    kept = grouped(docs).where("kept").groupBy("group", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    kept = materialize(kept, "kept")
    one = (kept.where("group is not null").groupBy("group")
           .agg(F.min(F.struct("text_hash", "doc_id", "n")).alias("k")).select("k.doc_id", "k.text_hash", "k.n"))
    chosen = one.union(kept.where("group is null").select("doc_id", "text_hash", "n"))
    chosen = materialize(chosen.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}), "chosen")
    hashed = docs.withColumn("_t", F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_hash"))
    once = bounded_broadcast(chosen.where("n = 1").drop("n"), LIST_BYTES)
    more = bounded_broadcast(chosen.where("n > 1").drop("n"), LIST_BYTES)
    repeated = hashed.join(more, same, "left_semi").dropDuplicates(["doc_id", "_t"])
    return hashed.join(once, same, "left_semi").union(repeated).drop("_t")


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go.

    The declared language is ``lang``, the host is ``source``; the text model
    is fitted on a bounded sample of the same documents. Null, empty and blank
    texts have no language and go; a null language or source is no evidence;
    repeated rows are judged alike, and all stay or go; of languages that are
    equally likely the first in the model's order counts.
    """
    model = fit_text_model(docs, "text", "lang", "doc_id")
    return identify(docs, model, "text", "source", "lang").where("kept").select(docs.columns)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go.

    Null and empty texts hold none and stay; repeated rows all stay or go;
    without benchmark items all documents stay.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out as the source weights ask.

    A null source is a source of its own; texts without words cost nothing;
    rows alike in id and text are taken or left together.
    """
    return mix(docs, entropy_share=ENTROPY_SHARE).select(docs.columns)


@_stage
def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in Hilbert order, with shard and slot.

    Null source or language comes before all others, a null text has size 1;
    rows alike in cell, id and text are interchangeable, and each has a slot
    of its own.
    """
    sized = docs.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)) + 1)
    sized = sized.withColumn("text_hash", F.xxhash64("text"))
    out = hilbert_shards(sized, ["source", "lang", "size"], ["doc_id", "text_hash"])
    return out.select(*docs.columns, "shard", "slot")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{stage_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
