"""File sources and sinks (S1–S10, S15): assay CSV/TSV, FASTA, wide embeddings.

All readers are splittable Spark readers with explicit column handling; no
file is parsed on the driver.  FASTA is read with a '>' at a line's start as
the record separator, so each record (header + wrapped sequence lines) is one
row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import ordered_scan

ASSAY_FIELDS = ("id_col", "name_col", "sequence_col", "score_col", "uncertainty_col")
LOGICAL = {"id_col": "id", "name_col": "name", "sequence_col": "sequence", "score_col": "score",
           "uncertainty_col": "uncertainty"}


class MissingColumnError(ValueError):
    pass


def read_assay(spark: SparkSession, path: str, mapping: dict[str, str], sep: str = ",") -> DataFrame:
    """Assay table with logical → physical column mapping; a mapped column
    absent from the header raises ``MissingColumnError``."""
    raw = spark.read.option("header", "true").option("sep", sep).csv(path)
    missing = [phys for phys in mapping.values() if phys not in raw.columns]
    if missing:
        raise MissingColumnError(f"columns {missing} not in {path} (have {raw.columns})")
    cols = []
    for field, phys in mapping.items():
        c = F.col(f"`{phys}`")
        if field in ("score_col", "uncertainty_col"):
            c = c.try_cast("double")
        cols.append(c.alias(LOGICAL[field]))
    return raw.select(*cols)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated source with a header (all columns as strings)."""
    return spark.read.option("header", "true").option("sep", "\t").csv(path)


def surrogate_ids(df: DataFrame, order_col: str, out: str = "id") -> DataFrame:
    """1-based row number in ``order_col`` order (NULL first; rows with one
    order value by a hash of the row), computed as a distributed running count
    — no single-partition window.  Every row gets a number of its own."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    s = ordered_scan(one, [], F.struct(F.col(order_col), F.xxhash64(*df.columns)), {out: ("sum", "_one")})
    return s.drop("_one")


def canonicalise(df: DataFrame, order_col: str | None = None) -> DataFrame:
    """Surrogate id when the table has none (row position in
    ``order_col`` order), ``name`` default ``variant_<id>``, NULL score → 0.0,
    NULL uncertainty kept NULL."""
    if "id" not in df.columns:
        if order_col is None:
            raise ValueError("an explicit order column is needed to number rows")
        df = surrogate_ids(df, order_col).withColumn("id", F.col("id").cast("string"))
    name = F.coalesce(F.col("name"), F.concat(F.lit("variant_"), F.col("id"))) if "name" in df.columns \
        else F.concat(F.lit("variant_"), F.col("id"))
    out = df.withColumn("name", name).withColumn("score", F.coalesce(F.col("score"), F.lit(0.0)))
    if "uncertainty" not in out.columns:
        out = out.withColumn("uncertainty", F.lit(None).cast("double"))
    return out


def clean_record_id(col) -> F.Column:
    """Keep the first whitespace-separated token of a header/id."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract(c, r"^\s*(\S+)", 1)


def read_fasta(spark: SparkSession, path: str, partition_cols=()) -> DataFrame:
    """S3: (record_id = first header token, sequence = wrapped lines joined).

    ``partition_cols`` are folder partitions (e.g. one FASTA set per dataset
    written with ``partitionBy``); ids are unique within them.  A record
    begins at a ``>`` that begins a line; one inside a header is text.  Of a
    duplicated id the last record counts: by file name, then by its place in
    the file, however the files are split or dealt out.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    keys = list(partition_cols)
    # only a file's first record still has its mark; the splits of a file are in block order
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                     F.monotonically_increasing_id().alias("i"))
    rec = raw.select(*keys, F.regexp_replace("value", r"^>", "").alias("value"), place.alias("_ord"))
    rec = rec.filter(F.length(F.trim("value")) > 0).select(
        *keys,
        clean_record_id(F.regexp_extract("value", r"^([^\n]*)", 1)).alias("record_id"),
        F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("sequence"), "_ord")
    return rec.groupBy(*keys, "record_id").agg(F.max_by("sequence", "_ord").alias("sequence"))


def read_fasta_variants(spark: SparkSession, path: str, wt_id: str = "WT",
                        partition_cols=()) -> tuple[DataFrame, DataFrame]:
    """FASTA-only datasets — variants without assay (score NULL) and the
    WT record of each dataset split out."""
    keys = list(partition_cols)
    rec = read_fasta(spark, path, keys)
    variants = (rec.filter(F.col("record_id") != wt_id)
                .select(*keys, F.col("record_id").alias("id"), "sequence",
                        F.lit(None).cast("double").alias("score")))
    return variants, rec.filter(F.col("record_id") == wt_id)


def write_fasta(df: DataFrame, path: str, id_col: str = "id", seq_col: str = "sequence", width: int = 60,
                partition_by=()):
    """FASTA export, sequence lines wrapped at ``width`` characters
    (optionally one folder per ``partition_by`` value, e.g. per dataset)."""
    wrapped = F.regexp_replace(F.col(seq_col), f"(.{{{width}}})(?=.)", "$1\n")
    w = df.select(*partition_by, F.concat(F.lit(">"), F.col(id_col).cast("string"), F.lit("\n"), wrapped)
                  .alias("value")).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.text(path)


def read_embeddings(spark: SparkSession, path: str, id_col: str = "id") -> DataFrame:
    """Wide embedding CSV ``id,e_0..e_{d-1}`` → (id, embedding ARRAY<DOUBLE>)."""
    raw = spark.read.option("header", "true").csv(path)
    dims = sorted((c for c in raw.columns if c.startswith("e_")), key=lambda c: int(c[2:]))
    return raw.select(F.col(id_col).alias("id"),
                      F.array(*[F.col(c).cast("double") for c in dims]).alias("embedding"))


def attach_embeddings(variants: DataFrame, emb: DataFrame, id_col: str = "id",
                      strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Left join of embeddings to variants; the second frame lists
    variants with no embedding.  With ``strict`` the job fails at the first
    variant without one and names it."""
    joined = variants.join(emb, id_col, "left")
    if strict:
        gap = F.raise_error(F.concat(F.lit("no embedding for variant "), F.col(id_col).cast("string")))
        joined = joined.withColumn("embedding", F.when(F.col("embedding").isNull(), gap.cast("array<double>"))
                                   .otherwise(F.col("embedding")))
    missing = variants.join(emb.select(id_col), id_col, "left_anti")
    return joined, missing


def write_embeddings_wide(df: DataFrame, path: str, dim: int, id_col: str = "id",
                          vec_col: str = "embedding"):
    """Wide export ``id,e_0..e_{dim-1}``."""
    df.select(F.col(id_col).alias("id"), *[F.col(vec_col)[i].cast("double").alias(f"e_{i}") for i in range(dim)]) \
        .write.mode("overwrite").option("header", "true").csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None, header: bool = True):
    """Label or analysis export; many datasets stacked in one frame,
    partitioned by dataset instead of a concat loop."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", str(header).lower()).csv(path)
    else:
        w.parquet(path)
