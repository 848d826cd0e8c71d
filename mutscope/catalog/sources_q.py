"""Catalog entries for sources and sinks.

Each query writes data derived from the driver's tables to a fresh folder
under the session's ``spark.checkpoint.dir`` with one of our writers and
reads it back with the matching reader, so the oracle is the original data.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import runlog as R
from ..operators import variants as V
from ..session import ensure_checkpoint_dir, table
from ..sources import bindings as B
from ..sources import files as IO
from ..sources import runlog_store as RS
from ..util import finish, materialize
from .bind_sql import rounded, with_
from .registry import ORACLES, register
from .variants_q import _MUT_SQL, WV, _clinical, clinical_labels


def scratch(spark, tag: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/mutscope-io-{tag}-{uuid.uuid4().hex}"


def _mutants(spark, d):
    return V.mutant_sequences(B.variants(spark, d), B.datasets(spark, d))


@register("S1", rounded(WV(m=_MUT_SQL) + "SELECT variant_id AS id, sequence, assay_score AS score FROM m", "score"))
def q_s1(spark, d):
    """Assay CSV with physical column names, read through a logical mapping."""
    path = scratch(spark, "assay")
    m = _mutants(spark, d).select(F.col("variant_id").alias("mutant"), F.col("sequence").alias("seq"),
                                  F.col("assay_score").alias("DMS_score"), F.lit("x").alias("unused"))
    m.write.option("header", "true").csv(path)
    return finish(IO.read_assay(spark, path, {"id_col": "mutant", "sequence_col": "seq", "score_col": "DMS_score"}))


@register("S2", rounded(WV() + """SELECT CAST(row_number() OVER (ORDER BY part_id) AS VARCHAR) AS id, part_id,
  coalesce(CASE WHEN part_id % 7 <> 0 THEN variant_id END,
           'variant_' || CAST(row_number() OVER (ORDER BY part_id) AS VARCHAR)) AS name,
  coalesce(CASE WHEN part_id % 11 <> 0 THEN assay_score END, 0.0) AS score, NULL::DOUBLE AS uncertainty
FROM b_variant""", "score", "uncertainty"))
def q_s2(spark, d):
    """Canonicalise a table without ids: surrogate id by part order, name and
    score defaults (distributed numbering, no single-task window)."""
    v = B.variants(spark, d).select(
        "part_id", F.when(F.col("part_id") % 7 != 0, F.col("variant_id")).alias("name"),
        F.when(F.col("part_id") % 11 != 0, F.col("assay_score")).alias("score"))
    return finish(IO.canonicalise(v, order_col="part_id").select("id", "part_id", "name", "score", "uncertainty"))


@register("S3", with_("b_dataset") + "SELECT dataset_name AS record_id, wt_sequence AS sequence FROM b_dataset")
def q_s3(spark, d):
    """FASTA round trip: headers with descriptions, sequences wrapped at 20."""
    path = scratch(spark, "fasta")
    ds = B.datasets(spark, d).select(F.concat("dataset_name", F.lit(" WT sequence of "), "dataset_name").alias("id"),
                                     F.col("wt_sequence").alias("sequence"))
    IO.write_fasta(ds, path, width=20)
    return finish(IO.read_fasta(spark, path))


@register("S4", rounded(WV(m=_MUT_SQL) + """SELECT DISTINCT dataset_name, variant_id AS id, sequence, NULL::DOUBLE AS score
FROM m""", "score"))
def q_s4(spark, d):
    """FASTA-only datasets: per dataset one WT record plus its variants, written
    as one folder per dataset; WT split out on read."""
    path = scratch(spark, "fasta-only")
    m = _mutants(spark, d).select("dataset_name", F.col("variant_id").alias("id"), "sequence")
    wt = B.datasets(spark, d).select("dataset_name", F.lit("WT").alias("id"), F.col("wt_sequence").alias("sequence"))
    IO.write_fasta(m.unionByName(wt), path, partition_by=["dataset_name"])
    variants, _wt = IO.read_fasta_variants(spark, path, partition_cols=["dataset_name"])
    return finish(variants)


@register("S5", """SELECT l.doc_id, d.lang, CAST(l.quality AS VARCHAR) AS quality FROM labels l
JOIN documents d ON l.doc_id = d.doc_id""")
def q_s5(spark, d):
    """TSV round trip (all columns read as strings)."""
    path = scratch(spark, "tsv")
    lab = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    lab.select("doc_id", "lang", "quality").write.option("header", "true").option("sep", "\t").csv(path)
    t = IO.read_tsv(spark, path)
    return finish(t.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "quality"))


def _emb_roundtrip(spark, d):
    path = scratch(spark, "emb")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    IO.write_embeddings_wide(e, path, 64)
    return IO.read_embeddings(spark, path).withColumn("id", F.col("id").cast("long"))


@register("S6", rounded("""SELECT d.doc_id AS id, CAST(e.embedding AS DOUBLE[]) AS embedding FROM documents d
LEFT JOIN embeddings e ON d.doc_id = e.vec_id""", arrays=("embedding",)))
def q_s6(spark, d):
    """Wide embedding CSV → array column, attached to variants (documents);
    a variant without one keeps NULL (``strict`` fails on it)."""
    emb = _emb_roundtrip(spark, d)
    variants = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    joined, _missing = IO.attach_embeddings(variants, emb)
    return finish(joined)


@register("S6_missing", """SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def q_s6m(spark, d):
    """Variants with no embedding (the completeness check of S6)."""
    emb = _emb_roundtrip(spark, d)
    variants = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return finish(IO.attach_embeddings(variants, emb)[1])


@register("S7", rounded("SELECT vec_id AS id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e_{i}" for i in range(64))
                        + " FROM embeddings", *[f"e_{i}" for i in range(64)]))
def q_s7(spark, d):
    """Wide export written as CSV and read back unchanged."""
    path = scratch(spark, "wide")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    IO.write_embeddings_wide(e, path, 64)
    raw = spark.read.option("header", "true").csv(path)
    return finish(raw.select(F.col("id").cast("long").alias("id"),
                             *[F.col(f"e_{i}").cast("double").alias(f"e_{i}") for i in range(64)]))


@register("S8", with_("b_dataset") + """SELECT '>' || dataset_name AS line FROM b_dataset
UNION ALL SELECT substr(wt_sequence, 1 + 20 * k, 20) FROM b_dataset, range(0, 3) t(k)""")
def q_s8(spark, d):
    """FASTA text lines as written: header, then 20-residue lines."""
    path = scratch(spark, "fasta-lines")
    ds = B.datasets(spark, d).select(F.col("dataset_name").alias("id"), F.col("wt_sequence").alias("sequence"))
    IO.write_fasta(ds, path, width=20)
    return finish(spark.read.text(path).select(F.col("value").alias("line")))


@register("S9", ORACLES["P15"])
def q_s9(spark, d):
    """Label CSV export (P15 labels) read back."""
    path = scratch(spark, "labels")
    IO.write_table(clinical_labels(_clinical(spark, d)), path, fmt="csv")
    back = spark.read.option("header", "true").csv(path)
    return finish(back.select(F.coalesce("gene_symbol", F.lit("")).alias("gene_symbol"), "variant_id",
                              F.col("label").cast("int").alias("label"), F.col("doc_id").cast("long").alias("doc_id")))


@register("S10", rounded(with_("b_variant") + """SELECT dataset_name, part_id, assay_score FROM b_variant""",
                         "assay_score"))
def q_s10(spark, d):
    """Analysis export of all datasets in one frame, partitioned by dataset, read back whole."""
    path = scratch(spark, "export")
    IO.write_table(B.variants(spark, d).select("dataset_name", "part_id", "assay_score"), path,
                   partition_by=["dataset_name"])
    return finish(spark.read.parquet(path).select("dataset_name", "part_id", "assay_score"))


@register("S11", rounded(with_("b_run", "b_sub_run", "b_simulation", "b_round", "b_top_variant") + """
SELECT sr.run_id, tv.round_id, tv.variant_id, tv.assay_score FROM b_top_variant tv
JOIN b_round r ON tv.round_id = r.round_id JOIN b_simulation s ON r.simulation_id = s.simulation_id
JOIN b_sub_run sr ON s.sub_run_id = sr.sub_run_id
WHERE sr.run_id IN (SELECT max(run_id) FROM b_run WHERE end_ts IS NOT NULL GROUP BY config_id, dataset_name, name)""",
                         "assay_score"))
def q_s11(spark, d):
    """All run-log tables appended (the variants in two batches, one of them
    twice) and read back: the stored log is joined up its key chain for the
    latest completed runs, whose partitions alone are read."""
    store = stored_log(spark, R.RunLog.bound(spark, d))
    latest = R.latest_completed_runs(store.read("run")).select("run_id")
    back = store.read_runs("round_top_variant", latest)
    for name, key in (("round", "round_id"), ("simulation", "simulation_id"), ("sub_run", "sub_run_id")):
        cols = {"round": ["round_id", "simulation_id"], "simulation": ["simulation_id", "sub_run_id"], "sub_run": ["sub_run_id"]}
        back = back.join(store.read_runs(name, latest).select(*cols[name]), key)
    return finish(back.select("run_id", "round_id", "variant_id", "assay_score"))


def stored_log(spark, log) -> RS.RunLogStore:
    """The bound run log, written to a new store with ``run_id`` in every table.

    Rounds are numbered once: the tables below them find their run in the
    stored rounds. The top variants are joined once and written, then appended.
    """
    store = RS.RunLogStore(spark, scratch(spark, "runlog"))
    sim = log.simulation.join(log.sub_run.select("sub_run_id", "run_id"), "sub_run_id")
    rnd = log.round.join(sim.select("simulation_id", "run_id"), "simulation_id")
    for name, df in (("run", log.run), ("sub_run", log.sub_run), ("simulation", sim), ("round", rnd)):
        store.append(name, df, "all")
    runs = store.read("round").select("round_id", F.col("run_id").cast(rnd.schema["run_id"].dataType).alias("run_id"))
    of_round = lambda t: t.join(runs, "round_id")
    for name, df in (("round_acquired_variant", of_round(log.acquired_variant)),
                     ("last_round_score", log.last_round_score.join(sim.select("simulation_id", "run_id"), "simulation_id"))):
        store.append(name, df, "all")
    top = materialize(of_round(log.top_variant), "top-variants", compression="zstd")
    for batch, part in (("low", F.col("run_id") < 3), ("high", F.col("run_id") >= 3), ("high", F.col("run_id") >= 3)):
        store.append("round_top_variant", top.filter(part), batch)
    return store


_DIM_SQL = """dim AS (SELECT dataset_name AS name, 'G' || regexp_extract(dataset_name, '#(\\d+)', 1) AS gene_symbol,
                 wt_sequence, 1.0::DOUBLE AS wt_assay_score FROM b_dataset
          WHERE CAST(regexp_extract(dataset_name, '#(\\d+)', 1) AS INTEGER) % 2 = 0),
upd AS (SELECT dataset_name AS name, NULL::VARCHAR AS gene_symbol,
               CASE WHEN CAST(regexp_extract(dataset_name, '#(\\d+)', 1) AS INTEGER) % 3 = 0 THEN reverse(wt_sequence) END AS wt_sequence,
               CAST(regexp_extract(dataset_name, '#(\\d+)', 1) AS INTEGER) / 10.0::DOUBLE AS wt_assay_score
        FROM b_dataset WHERE CAST(regexp_extract(dataset_name, '#(\\d+)', 1) AS INTEGER) >= 10)"""


def _dim_frames(spark, d):
    ds = B.datasets(spark, d)
    no = F.regexp_extract("dataset_name", r"#(\d+)", 1).cast("int")
    dim = ds.filter(no % 2 == 0).select(F.col("dataset_name").alias("name"),
                                        F.concat(F.lit("G"), F.regexp_extract("dataset_name", r"#(\d+)", 1)).alias("gene_symbol"),
                                        "wt_sequence", F.lit(1.0).alias("wt_assay_score"))
    upd = ds.filter(no >= 10).select(F.col("dataset_name").alias("name"), F.lit(None).cast("string").alias("gene_symbol"),
                                     F.when(no % 3 == 0, F.reverse("wt_sequence")).alias("wt_sequence"),
                                     (no / F.lit(10.0)).alias("wt_assay_score"))
    return dim, upd


@register("S12", rounded(with_("b_dataset", extra={}) + ", " + _DIM_SQL + """
SELECT coalesce(dim.name, upd.name) AS name, coalesce(dim.gene_symbol, upd.gene_symbol, coalesce(dim.name, upd.name)) AS gene_symbol,
       CASE WHEN upd.name IS NULL THEN dim.wt_sequence ELSE upd.wt_sequence END AS wt_sequence,
       CASE WHEN upd.name IS NULL THEN dim.wt_assay_score ELSE upd.wt_assay_score END AS wt_assay_score
FROM dim FULL OUTER JOIN upd ON dim.name = upd.name""", "wt_assay_score"))
def q_s12(spark, d):
    """The stored dimension is updated in place and read back."""
    dim, upd = _dim_frames(spark, d)
    store = RS.RunLogStore(spark, scratch(spark, "dim"))
    store.append("dataset", dim, "first")
    store.replace("dataset", RS.upsert_dataset(store.read("dataset"), upd))
    return finish(store.read("dataset"))


@register("S13", rounded(with_("b_variant") + """SELECT dataset_name AS assay_source, variant_id, assay_score,
  CAST(part_id % 2 AS INTEGER) AS class_label FROM b_variant WHERE part_id % 2 = 0
UNION ALL SELECT dataset_name, variant_id, assay_score, NULL FROM b_variant WHERE part_id % 2 = 1""", "assay_score"))
def q_s13(spark, d):
    """Bulk activity append: the second batch lacks ``class_label`` → NULL."""
    v = B.variants(spark, d)
    a = v.filter(F.col("part_id") % 2 == 0).select(F.col("dataset_name").alias("assay_source"), "variant_id",
                                                   "assay_score", (F.col("part_id") % 2).cast("int").alias("class_label"))
    b = v.filter(F.col("part_id") % 2 == 1).select(F.col("dataset_name").alias("assay_source"), "variant_id", "assay_score")
    store = RS.RunLogStore(spark, scratch(spark, "activity"))
    store.append("variant_assay_activity", RS.append_activity(a.limit(0), a), "1")
    store.append("variant_assay_activity", RS.append_activity(a.limit(0), b), "2")
    return finish(store.read("variant_assay_activity"))


def _headers(spark, d):
    ds = B.datasets(spark, d)
    return ds.select(F.col("dataset_name").alias("assay_source"),
                     F.concat(F.lit("P"), F.regexp_extract("dataset_name", r"#(\d+)", 1)).alias("protein_symbol"),
                     F.lit("GENE").alias("gene_symbol"))


@register("S14", with_("b_dataset") + """SELECT dataset_name AS assay_source,
  'P' || regexp_extract(dataset_name, '#(\\d+)', 1) AS protein_symbol, TRUE AS has_insert_ts FROM b_dataset""")
def q_s14(spark, d):
    """Header append with default insert time (checked as present, not by value)."""
    h = _headers(spark, d)
    empty = h.limit(0).withColumn("insert_ts", F.lit(None).cast("timestamp"))
    store = RS.RunLogStore(spark, scratch(spark, "header"))
    store.append("variant_assay", RS.append_assay_header(empty, h), "1")
    out = store.read("variant_assay")
    return finish(out.select("assay_source", "protein_symbol", F.col("insert_ts").isNotNull().alias("has_insert_ts")))


@register("S15", with_("b_dataset") + """SELECT dataset_name AS record_id FROM b_dataset""")
def q_s15(spark, d):
    """Header-id clean-up: keep the first whitespace token."""
    ds = B.datasets(spark, d).select(F.concat(F.lit("  "), "dataset_name", F.lit(" description\tmore")).alias("h"))
    return finish(ds.select(IO.clean_record_id("h").alias("record_id")))


@register("S17", with_("b_sub_run") + """SELECT run_id, learner, strategy FROM
  (SELECT run_id, unnest(list(DISTINCT model_name)) AS learner FROM b_sub_run GROUP BY run_id) a
  JOIN (SELECT run_id AS rid, unnest(list(DISTINCT strategy_name)) AS strategy FROM b_sub_run GROUP BY run_id) b
  ON a.run_id = b.rid""")
def q_s17(spark, d):
    """Config grid per run (JSON with learner and strategy lists) → one row per
    (learner, strategy)."""
    sr = R.RunLog.bound(spark, d).sub_run
    cfg = sr.groupBy("run_id").agg(F.to_json(F.struct(
        F.array_sort(F.collect_set("model_name")).alias("learners"),
        F.array_sort(F.collect_set("strategy_name")).alias("strategies"))).alias("config"))
    return finish(RS.expand_grid(cfg).select("run_id", "learner", "strategy"))


@register("J10", rounded(with_("b_dataset", "b_variant") + """, hdr AS (SELECT dataset_name AS assay_source,
    'P' || regexp_extract(dataset_name, '#(\\d+)', 1) AS protein_symbol, 'GENE' AS gene_symbol FROM b_dataset),
act AS (SELECT dataset_name AS assay_source, 'P' || regexp_extract(dataset_name, '#(\\d+)', 1) AS protein_symbol,
               CASE WHEN part_id % 2 = 0 THEN 'abundance' ELSE 'activity' END AS assay_type,
               CASE WHEN part_id % 3 = 0 THEN 'high' END AS assay_subtype, variant_id, assay_score FROM b_variant)
SELECT act.*, hdr.gene_symbol FROM act JOIN hdr ON act.assay_source = hdr.assay_source
  AND act.protein_symbol = hdr.protein_symbol WHERE assay_type = 'abundance'""", "assay_score"))
def q_j10(spark, d):
    v = B.variants(spark, d)
    act = v.select(F.col("dataset_name").alias("assay_source"),
                   F.concat(F.lit("P"), F.regexp_extract("dataset_name", r"#(\d+)", 1)).alias("protein_symbol"),
                   F.when(F.col("part_id") % 2 == 0, "abundance").otherwise("activity").alias("assay_type"),
                   F.when(F.col("part_id") % 3 == 0, "high").alias("assay_subtype"), "variant_id", "assay_score")
    return finish(RS.variant_assay(_headers(spark, d), act, assay_type="abundance"))
