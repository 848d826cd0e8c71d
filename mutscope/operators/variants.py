"""Variant algebra: sequences, WT residues, log-likelihood ratios, reference build.

Tables (long form, one convention: 1-based ``position``):

* variants  (dataset_name, variant_id, position, ref_aa, alt_aa, …)
* datasets  (dataset_name, wt_sequence) — one row per protein, bounded size
* logprob   (dataset_name, position, aa, logp) — dataset × length × 20 rows

Per-dataset tables (WT sequence, logprob) are far smaller than variant tables
and are broadcast behind a size check; everything else is a keyed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..util import bounded_broadcast

AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def residues_of(datasets: DataFrame) -> DataFrame:
    """WT residue table (dataset_name, position, aa) from WT sequences."""
    return datasets.select(
        "dataset_name",
        F.posexplode(F.split("wt_sequence", "(?!$)")).alias("p0", "aa")
    ).select("dataset_name", (F.col("p0") + 1).alias("position"), "aa")


def assemble_sequence(residues: DataFrame, keys=("dataset_name",), pos="position",
                      aa="aa") -> DataFrame:
    """Residues concatenated in position order (one protein per group,
    so the collected list is bounded by the protein length)."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos), F.col(aa))))
    return residues.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda x: x[aa]), "").alias("sequence"))


def attach_sequence(df: DataFrame, datasets: DataFrame) -> DataFrame:
    """WT sequence by dataset, missing → NULL (left join)."""
    return df.join(bounded_broadcast(datasets), "dataset_name", "left")


def mutant_sequences(variants: DataFrame, datasets: DataFrame) -> DataFrame:
    """E6 over a table: WT sequence with the substitution applied."""
    j = attach_sequence(variants, datasets)
    return j.withColumn("sequence", E.apply_substitution("wt_sequence", "position", "alt_aa"))


def silent_variants(variants: DataFrame, datasets: DataFrame) -> DataFrame:
    """Variants whose sequence equals their dataset's WT sequence
    (equi join on (dataset, sequence))."""
    muts = mutant_sequences(variants, datasets).drop("wt_sequence")
    wt = datasets.select("dataset_name", F.col("wt_sequence").alias("sequence"))
    return muts.join(bounded_broadcast(wt), ["dataset_name", "sequence"], "left_semi")


def join_wt_residue(df: DataFrame, wt: DataFrame, keys=("dataset_name", "position")) -> DataFrame:
    """Position join to the WT residue table; clashing columns get ``_wt``."""
    keys = list(keys)
    clash = [c for c in wt.columns if c in df.columns and c not in keys]
    wt = wt.select(*keys, *[F.col(c).alias(f"{c}_wt") if c in clash else F.col(c)
                            for c in wt.columns if c not in keys])
    return df.join(wt, keys)


def logprob_table(datasets: DataFrame) -> DataFrame:
    """b_logprob: a deterministic log-probability for every (dataset,
    position, residue), generated per dataset row with ``explode``."""
    b = F.regexp_extract("dataset_name", r"#(\d+)", 1).cast("int")
    aas = F.split(F.lit(AMINO_ACIDS), "(?!$)")
    return (datasets.select("dataset_name", b.alias("_b"),
                            F.explode(F.sequence(F.lit(1), F.length("wt_sequence"))).alias("position"))
            .select("dataset_name", "_b", "position", F.posexplode(aas).alias("_i", "aa"))
            .select("dataset_name", "position", "aa",
                    (-((F.col("position") * 31 + F.col("_i") * 17 + F.col("_b") * 7) % 97) / 10.0
                     - 0.5).alias("logp")))


def llr(variants: DataFrame, datasets: DataFrame, logprob: DataFrame) -> DataFrame:
    """E7 + E8: locate the substitution by comparing mutant and WT sequences,
    LLR = logp(mutant residue) − logp(WT residue) there; 0 without mutation."""
    m = mutant_sequences(variants, datasets)
    m = m.withColumn("mut_pos", E.first_difference("wt_sequence", "sequence"))
    m = (m.withColumn("mut_aa", F.substring("sequence", F.col("mut_pos"), 1))
          .withColumn("wt_aa", F.substring("wt_sequence", F.col("mut_pos"), 1)))
    lp = bounded_broadcast(logprob)
    mut = lp.select("dataset_name", F.col("position").alias("mut_pos"), F.col("aa").alias("mut_aa"),
                    F.col("logp").alias("lp_mut"))
    wt = lp.select("dataset_name", F.col("position").alias("mut_pos"), F.col("aa").alias("wt_aa"),
                   F.col("logp").alias("lp_wt"))
    j = (m.join(mut, ["dataset_name", "mut_pos", "mut_aa"], "left")
          .join(wt, ["dataset_name", "mut_pos", "wt_aa"], "left"))
    return j.withColumn("llr", F.when(F.col("mut_pos").isNull(), F.lit(0.0))
                        .otherwise(F.col("lp_mut") - F.col("lp_wt")))


def llr_matrix(logprob: DataFrame, datasets: DataFrame) -> DataFrame:
    """Every substitution's LLR = logp − logp(WT residue at that position)."""
    wt_res = residues_of(datasets).withColumnRenamed("aa", "wt_aa")
    wt_lp = (logprob.join(wt_res, ["dataset_name", "position"])
             .filter(F.col("aa") == F.col("wt_aa"))
             .select("dataset_name", "position", "wt_aa", F.col("logp").alias("lp_wt")))
    return (logprob.join(wt_lp, ["dataset_name", "position"])
            .select("dataset_name", "position", "wt_aa", "aa",
                    (F.col("logp") - F.col("lp_wt")).alias("llr")))


def llr_wide(matrix: DataFrame) -> DataFrame:
    """Pivot the LLR matrix to one column per residue (values listed, so the
    pivot needs no extra pass to discover them)."""
    return (matrix.groupBy("dataset_name", "position", "wt_aa")
            .pivot("aa", list(AMINO_ACIDS)).agg(F.first("llr")))


def melt_llr(wide: DataFrame) -> DataFrame:
    """Wide matrix → (variant_id, score, position) via ``unpivot``."""
    long = wide.unpivot(["dataset_name", "position", "wt_aa"], list(AMINO_ACIDS), "aa", "score")
    return long.select("dataset_name",
                       E.make_variant_id("wt_aa", "position", "aa").alias("variant_id"),
                       "score", "position")


def pseudo_log_likelihood(logprob: DataFrame, datasets: DataFrame) -> DataFrame:
    """Σ over positions of logp at the WT residue."""
    wt_res = residues_of(datasets)
    return (logprob.join(wt_res, ["dataset_name", "position", "aa"])
            .groupBy("dataset_name").agg(F.sum("logp").alias("pll")))


def min_llr_after(matrix: DataFrame, stops: DataFrame) -> DataFrame:
    """For each (dataset, stop position) the minimum LLR over positions
    ≥ stop — a suffix minimum per dataset (bounded by protein length)."""
    per_pos = matrix.groupBy("dataset_name", "position").agg(F.min("llr").alias("_m"))
    w = (Window.partitionBy("dataset_name").orderBy(F.col("position").desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    suffix = per_pos.select("dataset_name", "position", F.min("_m").over(w).alias("min_llr"))
    return stops.join(suffix, ["dataset_name", "position"])


def drop_nonmissense(df: DataFrame, alt: str = "alt_aa", ref: str | None = "ref_aa") -> DataFrame:
    """Drop synonymous ('=' or alt = ref), stop ('*') and unparsable rows."""
    c = F.col(alt)
    keep = c.isNotNull() & ~c.contains("=") & ~c.contains("*") & (F.length(c) > 0)
    if ref is not None:
        keep = keep & (c != F.col(ref))
    return df.filter(keep)


def filter_condition(df: DataFrame, pathway: str | None = None, compound: str | None = None,
                     dose: str | None = None) -> DataFrame:
    """P5: pathway / compound+dose filter; an absent compound selects rows
    whose compound is NULL (NULL-aware equality otherwise)."""
    if pathway is not None:
        df = df.filter(F.col("pathway") == pathway)
    if compound is None:
        df = df.filter(F.col("compound").isNull())
    else:
        df = df.filter(F.col("compound").eqNullSafe(compound))
        if dose is not None:
            df = df.filter(F.col("dose").eqNullSafe(dose))
    return df


def split_wild_type(df: DataFrame, wt_id: str = "WT", fasta: DataFrame | None = None) -> DataFrame:
    """Per dataset, the WT row's score and sequence (FASTA value preferred)
    attached to every variant row; the WT row itself is removed."""
    wt = df.filter(F.col("variant_id") == wt_id).select(
        "dataset_name", F.col("score").alias("wt_score"), F.col("sequence").alias("_wt_seq"))
    out = df.filter(F.col("variant_id") != wt_id).join(bounded_broadcast(wt), "dataset_name", "left")
    if fasta is not None:
        out = out.join(bounded_broadcast(fasta.select("dataset_name", F.col("wt_sequence").alias("_fa"))),
                       "dataset_name", "left")
        return out.withColumn("wt_sequence", F.coalesce("_fa", "_wt_seq")).drop("_fa", "_wt_seq")
    return out.withColumnRenamed("_wt_seq", "wt_sequence")


def append_wt_row(df: DataFrame, datasets: DataFrame) -> DataFrame:
    """One WT row per dataset (position 1, score 0) unioned into variants."""
    wt = datasets.select("dataset_name", F.lit("WT").alias("variant_id"),
                         F.lit(1).alias("position"), F.lit(0.0).alias("assay_score"))
    return df.unionByName(wt, allowMissingColumns=True)


def ensure_wt(records: DataFrame, wt: DataFrame, key: str = "dataset_name") -> DataFrame:
    """Add the WT record to datasets that lack one (anti join + union)."""
    has = records.filter(F.col("record_id") == "WT").select(key)
    missing = wt.join(has, key, "left_anti")
    return records.unionByName(missing, allowMissingColumns=True)


def gene_symbol(datasets: DataFrame, genes: DataFrame) -> DataFrame:
    """Gene symbol of every dataset, by default the dataset's name.

    ``genes`` holds dataset_name and gene_symbol; of several symbols the first
    by name counts.
    """
    g = genes.groupBy("dataset_name").agg(F.min("gene_symbol").alias("_gene"))
    return (datasets.select("dataset_name").join(g, "dataset_name", "left")
            .select("dataset_name", F.coalesce("_gene", "dataset_name").alias("gene_symbol")))
