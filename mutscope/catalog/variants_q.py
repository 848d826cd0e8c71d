"""Catalog entries for expressions, labels and variant algebra
(E1–E21, L1–L8, P3–P5, P13–P16, J6, J13, J15, A25, U2, S16, C11, C12)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import labels as L
from ..operators import variants as V
from ..operators.runlog import RunLog
from ..session import table
from ..sources import bindings as B
from ..util import finish
from .bind_sql import rounded, with_
from .registry import register

AA = V.AMINO_ACIDS
ONE_TO_THREE = {v: k for k, v in E.THREE_TO_ONE.items()}
VRE = E.VARIANT_PATTERN


def _case(expr: str, mapping: dict) -> str:
    return "CASE " + expr + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


RESIDUE_SQL = """SELECT dataset_name, CAST(i AS INTEGER) AS position, substr(wt_sequence, i, 1) AS aa
FROM (SELECT dataset_name, wt_sequence, unnest(range(1, length(wt_sequence) + 1)) AS i FROM b_dataset)"""
LOGPROB_SQL = f"""SELECT dataset_name, position, substr('{AA}', i + 1, 1) AS aa,
       -((position * 31 + i * 17 + b * 7) % 97) / 10.0::DOUBLE - 0.5 AS logp
FROM (SELECT dataset_name, b, position, CAST(unnest(range(0, 20)) AS INTEGER) AS i
      FROM (SELECT dataset_name, CAST(regexp_extract(dataset_name, '#(\\d+)', 1) AS INTEGER) AS b,
                   CAST(unnest(range(1, 51)) AS INTEGER) AS position FROM b_dataset))"""


def WV(**extra):
    return with_("b_variant", "b_dataset", extra=extra)


def _variants(spark, d):
    return B.variants(spark, d)


def _datasets(spark, d):
    return B.datasets(spark, d)


# ---------------------------------------------------------------- E1–E4

def _hgvs(spark, d):
    v = _variants(spark, d)
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(ONE_TO_THREE.items())])
    suffix = (F.when(F.col("part_id") % 13 == 0, F.lit("="))
              .when(F.col("part_id") % 11 == 0, F.lit("Ter"))
              .otherwise(m[F.col("alt_aa")]))
    return v.select("part_id", F.concat(F.col("dataset_name"), F.lit(":p."), m[F.col("ref_aa")],
                                        F.col("position").cast("string"), suffix).alias("hgvs"))


_H_CTE = f"""SELECT part_id, dataset_name || ':p.' || {_case('ref_aa', ONE_TO_THREE)}
    || CAST(position AS VARCHAR) || CASE WHEN part_id % 13 = 0 THEN '=' WHEN part_id % 11 = 0 THEN 'Ter'
    ELSE {_case('alt_aa', ONE_TO_THREE)} END AS hgvs FROM b_variant"""
_P_CTE = "SELECT part_id, hgvs, string_split(hgvs, '.')[2] AS part FROM h"
_HGVS_SQL = WV(h=_H_CTE, p=_P_CTE)


@register("E1", _HGVS_SQL + f"""SELECT part_id, hgvs,
  CASE WHEN regexp_matches(part, '{VRE}') AND regexp_extract(part, '{VRE}', 3) <> 'Ter' THEN
    {_case(f"regexp_extract(part, '{VRE}', 1)", E.THREE_TO_ONE)}
    || CAST(CAST(regexp_extract(part, '{VRE}', 2) AS INTEGER) AS VARCHAR)
    || {_case(f"regexp_extract(part, '{VRE}', 3)", E.THREE_TO_ONE)} END AS variant_id
FROM p""")
def q_e1(spark, d):
    h = _hgvs(spark, d)
    return finish(h.select("part_id", "hgvs", E.hgvs_to_variant_id("hgvs").alias("variant_id")))


@register("E2", WV() + f"""SELECT part_id, variant_id,
  CASE WHEN regexp_matches(variant_id, '{VRE}') THEN CAST(regexp_extract(variant_id, '{VRE}', 2) AS INTEGER) END AS position
FROM b_variant""")
def q_e2(spark, d):
    v = _variants(spark, d)
    return finish(v.select("part_id", "variant_id", E.variant_position("variant_id").alias("position")))


@register("E3", rounded(WV(k=f"""SELECT part_id, variant_id,
  TRY_CAST(substr(variant_id, 2, length(variant_id) - 2) AS INTEGER) - 1 AS mutation_position,
  CASE WHEN instr('{E.LANDSCAPE_ORDER}', substr(variant_id, -1, 1)) > 0
       THEN CAST(instr('{E.LANDSCAPE_ORDER}', substr(variant_id, -1, 1)) - 1 AS INTEGER) END AS mutation_aa_index
  FROM b_variant""") + """SELECT *, round_even((mutation_position * 25 + mutation_aa_index) / 25.0::DOUBLE, 2)
  AS mutation_position_aa_index FROM k""", "mutation_position_aa_index"))
def q_e3(spark, d):
    v = _variants(spark, d)
    return finish(v.select("part_id", "variant_id",
                           E.landscape_position("variant_id").alias("mutation_position"),
                           E.landscape_aa_index("variant_id").alias("mutation_aa_index"),
                           E.landscape_key("variant_id").alias("mutation_position_aa_index")))


@register("E4", rounded(WV() + "SELECT dataset_name, part_id, position, ref_aa, alt_aa, variant_id, assay_score FROM b_variant",
                        "assay_score"))
def q_e4(spark, d):
    """E4 (b_variant): id = ref ‖ position ‖ alt."""
    return finish(_variants(spark, d))


# ---------------------------------------------------------------- E5–E12, J6, J13, J15, A25

@register("E5", WV() + """SELECT v.part_id, v.ref_aa, substr(d.wt_sequence, v.position, 1) AS wt_residue,
  substr(d.wt_sequence, v.position, 1) || CAST(v.position AS VARCHAR) || v.alt_aa AS id_from_sequence
FROM b_variant v JOIN b_dataset d ON v.dataset_name = d.dataset_name""")
def q_e5(spark, d):
    j = V.attach_sequence(_variants(spark, d), _datasets(spark, d))
    wt = E.residue_at("wt_sequence", "position", 0)
    return finish(j.select("part_id", "ref_aa", wt.alias("wt_residue"),
                           E.make_variant_id(wt, "position", "alt_aa").alias("id_from_sequence")))


_MUT_SQL = """SELECT v.*, d.wt_sequence,
  substr(d.wt_sequence, 1, v.position - 1) || v.alt_aa || substr(d.wt_sequence, v.position + 1) AS sequence
FROM b_variant v LEFT JOIN b_dataset d ON v.dataset_name = d.dataset_name"""


@register("E6", WV(m=_MUT_SQL) + "SELECT part_id, sequence FROM m")
def q_e6(spark, d):
    return finish(V.mutant_sequences(_variants(spark, d), _datasets(spark, d)).select("part_id", "sequence"))


_FIRST_DIFF = """CASE WHEN least(length(wt_sequence), length(sequence)) >= 1 THEN
  list_filter(range(1, least(length(wt_sequence), length(sequence)) + 1),
              lambda i: substr(wt_sequence, i, 1) <> substr(sequence, i, 1))[1] END"""


@register("E7", WV(m=_MUT_SQL) + f"SELECT part_id, CAST({_FIRST_DIFF} AS INTEGER) AS mut_pos FROM m")
def q_e7(spark, d):
    m = V.mutant_sequences(_variants(spark, d), _datasets(spark, d))
    return finish(m.select("part_id", E.first_difference("wt_sequence", "sequence").alias("mut_pos")))


_LLR_SQL = WV(m=_MUT_SQL, lp=LOGPROB_SQL, f=f"SELECT *, CAST({_FIRST_DIFF} AS INTEGER) AS mut_pos FROM m") + """
SELECT f.part_id, f.dataset_name, f.variant_id, f.mut_pos,
       CASE WHEN f.mut_pos IS NULL THEN 0.0::DOUBLE ELSE a.logp - w.logp END AS llr
FROM f LEFT JOIN lp a ON a.dataset_name = f.dataset_name AND a.position = f.mut_pos
                      AND a.aa = substr(f.sequence, f.mut_pos, 1)
       LEFT JOIN lp w ON w.dataset_name = f.dataset_name AND w.position = f.mut_pos
                      AND w.aa = substr(f.wt_sequence, f.mut_pos, 1)"""


@register("E8", rounded(_LLR_SQL, "llr"))
def q_e8(spark, d):
    ds = _datasets(spark, d)
    r = V.llr(_variants(spark, d), ds, V.logprob_table(ds))
    return finish(r.select("part_id", "dataset_name", "variant_id", "mut_pos", "llr"))


@register("C12", rounded(_LLR_SQL.replace("SELECT f.part_id, f.dataset_name, f.variant_id, f.mut_pos,",
                                          "SELECT f.dataset_name, f.variant_id,", 1), "llr"))
def q_c12(spark, d):
    """Substitution-scan zero-shot job — LLR for every variant of every dataset."""
    ds = _datasets(spark, d)
    r = V.llr(_variants(spark, d), ds, V.logprob_table(ds))
    return finish(r.select("dataset_name", "variant_id", "llr"))


_MATRIX_SQL = WV(lp=LOGPROB_SQL, res=RESIDUE_SQL, wlp="""SELECT lp.dataset_name, lp.position, res.aa AS wt_aa,
  lp.logp AS lp_wt FROM lp JOIN res ON lp.dataset_name = res.dataset_name AND lp.position = res.position
  AND lp.aa = res.aa""", mx="""SELECT lp.dataset_name, lp.position, w.wt_aa, lp.aa, lp.logp - w.lp_wt AS llr
  FROM lp JOIN wlp w ON lp.dataset_name = w.dataset_name AND lp.position = w.position""")


@register("E9", rounded(_MATRIX_SQL + "SELECT * FROM mx", "llr"))
def q_e9(spark, d):
    ds = _datasets(spark, d)
    return finish(V.llr_matrix(V.logprob_table(ds), ds))


@register("E10", rounded(_MATRIX_SQL + """SELECT dataset_name, wt_aa || CAST(position AS VARCHAR) || aa AS variant_id,
  llr AS score, position FROM mx""", "score"))
def q_e10(spark, d):
    ds = _datasets(spark, d)
    return finish(V.melt_llr(V.llr_wide(V.llr_matrix(V.logprob_table(ds), ds))))


@register("E11", rounded(_MATRIX_SQL + """SELECT dataset_name, sum(lp_wt) AS pll FROM wlp GROUP BY dataset_name""",
                         "pll"))
def q_e11(spark, d):
    ds = _datasets(spark, d)
    return finish(V.pseudo_log_likelihood(V.logprob_table(ds), ds))


@register("E12", rounded(_MATRIX_SQL + """, stops AS (SELECT DISTINCT dataset_name, position FROM b_variant
  WHERE alt_aa = 'W')
SELECT s.dataset_name, s.position, min(mx.llr) AS min_llr FROM stops s
JOIN mx ON mx.dataset_name = s.dataset_name AND mx.position >= s.position
GROUP BY s.dataset_name, s.position""", "min_llr"))
def q_e12(spark, d):
    """Stop-gain score; stop sites stand in as positions with a W substitution."""
    ds = _datasets(spark, d)
    stops = _variants(spark, d).filter(F.col("alt_aa") == "W").select("dataset_name", "position").distinct()
    return finish(V.min_llr_after(V.llr_matrix(V.logprob_table(ds), ds), stops))


@register("J6", WV(res=RESIDUE_SQL) + """SELECT v.dataset_name, v.position, v.part_id, v.ref_aa, v.alt_aa,
  r.aa AS aa FROM b_variant v JOIN res r ON v.dataset_name = r.dataset_name AND v.position = r.position""")
def q_j6(spark, d):
    v = _variants(spark, d).select("dataset_name", "position", "part_id", "ref_aa", "alt_aa")
    return finish(V.join_wt_residue(v, V.residues_of(_datasets(spark, d))))


@register("J6_suffix", WV(res=RESIDUE_SQL) + """SELECT v.dataset_name, v.position, v.part_id, v.aa,
  r.aa AS aa_wt FROM (SELECT dataset_name, position, part_id, alt_aa AS aa FROM b_variant) v
  JOIN res r ON v.dataset_name = r.dataset_name AND v.position = r.position""")
def q_j6s(spark, d):
    """J6 with a clashing column: the WT side's ``aa`` becomes ``aa_wt``."""
    v = _variants(spark, d).select("dataset_name", "position", "part_id", F.col("alt_aa").alias("aa"))
    return finish(V.join_wt_residue(v, V.residues_of(_datasets(spark, d))))


@register("J13", WV() + """SELECT v.part_id, d.wt_sequence FROM b_variant v
LEFT JOIN (SELECT * FROM b_dataset WHERE dataset_name <> 'Brand#1') d ON v.dataset_name = d.dataset_name""")
def q_j13(spark, d):
    """Left sequence attach; one dataset is missing from the FASTA side → NULL."""
    ds = _datasets(spark, d).filter(F.col("dataset_name") != "Brand#1")
    return finish(V.attach_sequence(_variants(spark, d), ds).select("part_id", "wt_sequence"))


@register("J15", WV(m=_MUT_SQL) + """SELECT part_id, dataset_name, variant_id FROM m
WHERE (dataset_name, sequence) IN (SELECT dataset_name, wt_sequence FROM b_dataset)""")
def q_j15(spark, d):
    s = V.silent_variants(_variants(spark, d), _datasets(spark, d))
    return finish(s.select("part_id", "dataset_name", "variant_id"))


@register("A25", WV(res=RESIDUE_SQL) + """SELECT dataset_name, string_agg(aa, '' ORDER BY position) AS sequence
FROM res GROUP BY dataset_name""")
def q_a25(spark, d):
    return finish(V.assemble_sequence(V.residues_of(_datasets(spark, d))))


@register("U2", rounded(WV() + """SELECT dataset_name, variant_id, position, assay_score FROM b_variant
UNION ALL SELECT dataset_name, 'WT', 1, 0.0::DOUBLE FROM b_dataset""", "assay_score"))
def q_u2(spark, d):
    v = _variants(spark, d).select("dataset_name", "variant_id", "position", "assay_score")
    return finish(V.append_wt_row(v, _datasets(spark, d)))


@register("S16", WV() + """, rec AS (SELECT dataset_name, 'WT' AS record_id, wt_sequence AS sequence FROM b_dataset
                  WHERE CAST(regexp_extract(dataset_name, '#(\\d+)', 1) AS INTEGER) % 3 <> 0
                  UNION ALL SELECT dataset_name, variant_id, NULL FROM b_variant)
SELECT * FROM rec UNION ALL
SELECT dataset_name, 'WT', wt_sequence FROM b_dataset
WHERE dataset_name NOT IN (SELECT dataset_name FROM rec WHERE record_id = 'WT')""")
def q_s16(spark, d):
    """Datasets lacking a WT record get one appended (left_anti + union)."""
    ds = _datasets(spark, d)
    bno = F.regexp_extract("dataset_name", r"#(\d+)", 1).cast("int")
    wt_rows = ds.select("dataset_name", F.lit("WT").alias("record_id"), F.col("wt_sequence").alias("sequence"))
    recs = wt_rows.filter(bno % 3 != 0).unionByName(
        _variants(spark, d).select("dataset_name", F.col("variant_id").alias("record_id"),
                                   F.lit(None).cast("string").alias("sequence")))
    return finish(V.ensure_wt(recs, wt_rows))


# ---------------------------------------------------------------- filters P3–P5, P13–P16

def _raw_scan(spark, d):
    """A receptor-scan style raw table from part: aa (with '*' stops and '='
    synonymous rows), pathway = p_type, compound NULL for brands < 10."""
    v = _variants(spark, d)
    p = table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), "p_type", "p_name")
    aa = (F.when(F.col("part_id") % 23 == 0, F.lit("*"))
          .when(F.col("part_id") % 19 == 0, F.lit("=")).otherwise(F.col("alt_aa")))
    bno = F.regexp_extract("dataset_name", r"#(\d+)", 1).cast("int")
    return v.join(p, "part_id").select(
        "part_id", "dataset_name", "position", "ref_aa", aa.alias("alt_aa"),
        F.col("p_type").alias("pathway"),
        F.when(bno >= 10, F.col("p_name")).alias("compound"),
        F.when(bno >= 10, (F.col("part_id") % 3).cast("string")).alias("dose"),
        ((F.col("assay_score") - 1.0) * 10).alias("statistic"),
        ((F.col("part_id") % 100) / F.lit(1000.0)).alias("p_adj"))


_RAW_SQL = """SELECT v.part_id, v.dataset_name, v.position, v.ref_aa,
  CASE WHEN v.part_id % 23 = 0 THEN '*' WHEN v.part_id % 19 = 0 THEN '=' ELSE v.alt_aa END AS alt_aa,
  p.p_type AS pathway,
  CASE WHEN CAST(regexp_extract(v.dataset_name, '#(\\d+)', 1) AS INTEGER) >= 10 THEN p.p_name END AS compound,
  CASE WHEN CAST(regexp_extract(v.dataset_name, '#(\\d+)', 1) AS INTEGER) >= 10 THEN CAST(v.part_id % 3 AS VARCHAR) END AS dose,
  (v.assay_score - 1.0) * 10 AS statistic, (v.part_id % 100) / 1000.0::DOUBLE AS p_adj
FROM b_variant v JOIN part p ON v.part_id = p.p_partkey"""


@register("P4", WV(raw=_RAW_SQL) + """SELECT part_id FROM raw WHERE alt_aa IS NOT NULL AND NOT contains(alt_aa, '=')
  AND NOT contains(alt_aa, '*') AND length(alt_aa) > 0 AND alt_aa <> ref_aa""")
def q_p4(spark, d):
    return finish(V.drop_nonmissense(_raw_scan(spark, d)).select("part_id"))


@register("P5", WV(raw=_RAW_SQL) + """SELECT part_id FROM raw WHERE pathway = 'SMALL' AND compound IS NULL
UNION ALL SELECT part_id FROM raw WHERE pathway = 'LARGE' AND compound = 'red widget' AND dose = '1'""")
def q_p5(spark, d):
    raw = _raw_scan(spark, d)
    a = V.filter_condition(raw, pathway="SMALL")
    b = V.filter_condition(raw, pathway="LARGE", compound="red widget", dose="1")
    return finish(a.select("part_id").unionByName(b.select("part_id")))


@register("P3", rounded(WV() + """, rows AS (
  SELECT dataset_name, variant_id, assay_score AS score, NULL AS sequence FROM b_variant
  UNION ALL SELECT dataset_name, 'WT', 1.5::DOUBLE, wt_sequence FROM b_dataset),
wt AS (SELECT dataset_name, score AS wt_score, sequence AS wt_seq FROM rows WHERE variant_id = 'WT'),
fa AS (SELECT * FROM b_dataset WHERE dataset_name <> 'Brand#3')
SELECT r.dataset_name, r.variant_id, r.score, r.sequence, wt.wt_score,
       coalesce(fa.wt_sequence, wt.wt_seq) AS wt_sequence
FROM rows r LEFT JOIN wt ON r.dataset_name = wt.dataset_name
LEFT JOIN fa ON r.dataset_name = fa.dataset_name WHERE r.variant_id <> 'WT'""", "score", "wt_score"))
def q_p3(spark, d):
    ds = _datasets(spark, d)
    rows = _variants(spark, d).select("dataset_name", "variant_id", F.col("assay_score").alias("score"),
                                      F.lit(None).cast("string").alias("sequence"))
    rows = rows.unionByName(ds.select("dataset_name", F.lit("WT").alias("variant_id"),
                                      F.lit(1.5).alias("score"), F.col("wt_sequence").alias("sequence")))
    fasta = ds.filter(F.col("dataset_name") != "Brand#3")
    return finish(V.split_wild_type(rows, "WT", fasta))


def _clinical(spark, d):
    """Clinical-style table from documents: stars, category, protein change."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    v = _hgvs(spark, d)
    cat = F.when(F.col("doc_id") % 4 == 0, "LP/P").when(F.col("doc_id") % 4 == 1, "US").otherwise("LB/B")
    return docs.join(v, docs.doc_id == v.part_id).select(
        "doc_id", (F.col("n_chars") % 4).cast("int").alias("stars"), cat.alias("category"),
        F.col("hgvs").alias("protein_change"),
        F.when(F.col("lang") != "de", F.upper("lang")).alias("gene_symbol"))


_CLIN_CTE = """SELECT d.doc_id, CAST(d.n_chars % 4 AS INTEGER) AS stars,
  CASE WHEN d.doc_id % 4 = 0 THEN 'LP/P' WHEN d.doc_id % 4 = 1 THEN 'US' ELSE 'LB/B' END AS category,
  h.hgvs AS protein_change, CASE WHEN d.lang <> 'de' THEN upper(d.lang) END AS gene_symbol
  FROM documents d JOIN h ON d.doc_id = h.part_id"""
_CLIN_SQL = _HGVS_SQL + f", clin AS ({_CLIN_CTE})\n"


def _hgvs_sql_expr(col: str) -> str:
    part = f"string_split({col}, '.')[2]"
    return (f"CASE WHEN regexp_matches({part}, '{VRE}') AND regexp_extract({part}, '{VRE}', 3) <> 'Ter' THEN "
            f"{_case(f"regexp_extract({part}, '{VRE}', 1)", E.THREE_TO_ONE)} || "
            f"CAST(CAST(regexp_extract({part}, '{VRE}', 2) AS INTEGER) AS VARCHAR) || "
            f"{_case(f"regexp_extract({part}, '{VRE}', 3)", E.THREE_TO_ONE)} END")


def clinical_labels(df):
    """Stars ≥ 1, category ≠ 'US', HGVS → id, label = 1 iff 'LP/P', gene NULL → ''."""
    return (df.filter((F.col("stars") >= 1) & (F.col("category") != "US"))
            .select(F.coalesce("gene_symbol", F.lit("")).alias("gene_symbol"),
                    E.hgvs_to_variant_id("protein_change").alias("variant_id"),
                    (F.col("category") == "LP/P").cast("int").alias("label"), "doc_id"))


@register("P15", _CLIN_SQL + f"""SELECT coalesce(gene_symbol, '') AS gene_symbol,
  {_hgvs_sql_expr('protein_change')} AS variant_id,
  CAST(category = 'LP/P' AS INTEGER) AS label, doc_id
FROM clin WHERE stars >= 1 AND category <> 'US'""")
def q_p15(spark, d):
    return finish(clinical_labels(_clinical(spark, d)))


@register("P13", _CLIN_SQL + f"""SELECT {_hgvs_sql_expr('protein_change')} AS variant_id,
  CAST(category = 'LP/P' AS INTEGER) AS label FROM clin
WHERE stars >= 1 AND category <> 'US' AND coalesce(gene_symbol, '') = 'EN'""")
def q_p13(spark, d):
    lab = clinical_labels(_clinical(spark, d))
    return finish(lab.filter(F.col("gene_symbol") == "EN").select("variant_id", "label"))


@register("P14", with_("b_dataset") + """SELECT dataset_name,
  CASE WHEN CAST(regexp_extract(dataset_name, '#(\\d+)', 1) AS INTEGER) % 2 = 0
       THEN 'GENE' || regexp_extract(dataset_name, '#(\\d+)', 1) ELSE dataset_name END AS gene_symbol FROM b_dataset""")
def q_p14(spark, d):
    """Gene symbol per dataset; every second one is in the map, twice."""
    ds = B.datasets(spark, d)
    no = F.regexp_extract("dataset_name", r"#(\d+)", 1)
    genes = ds.filter(no.cast("int") % 2 == 0).select("dataset_name", F.concat(F.lit("GENE"), no).alias("gene_symbol"))
    again = genes.withColumn("gene_symbol", F.concat("gene_symbol", F.lit("b")))
    return finish(V.gene_symbol(ds, genes.unionByName(again)))


@register("P16", rounded(WV() + "SELECT part_id, -assay_score AS clinical_score FROM b_variant", "clinical_score"))
def q_p16(spark, d):
    return finish(_variants(spark, d).select("part_id", (-F.col("assay_score")).alias("clinical_score")))


# ---------------------------------------------------------------- E13–E21

def _cdf_sql(x: str) -> str:
    """The normal-CDF column expression of ``expr.norm_cdf`` written in SQL."""
    a = f"abs({x})"

    def horner(cs):
        acc = f"{cs[0]!r}::DOUBLE"
        for c in cs[1:]:
            acc = f"({acc}) * {a} + {c!r}::DOUBLE"
        return acc

    frac = f"{a} + 0.65::DOUBLE"
    for k in (4, 3, 2, 1):
        frac = f"{a} + {float(k)!r} / ({frac})"
    e = f"exp(-{a} * {a} / 2)"
    tail = (f"(CASE WHEN {a} > {E.CDF_TAIL_CUTOFF!r} THEN 0.0::DOUBLE WHEN {a} < {E.CDF_SPLIT!r} "
            f"THEN {e} * ({horner(E.CDF_NUM)}) / ({horner(E.CDF_DEN)}) "
            f"ELSE {e} / ({frac}) / {E.SQRT_2PI!r}::DOUBLE END)")
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def _z_events(spark, d):
    return table(spark, d, "events").select("event_id", ((F.col("value") - 50.0) / 20.0).alias("z"))


@register("E13", rounded(f"""WITH z AS (SELECT event_id, (value - 50.0) / 20.0 AS z FROM events)
SELECT event_id, z, {_cdf_sql('z')} AS cdf, exp(-z * z / 2) / {(2 * 3.141592653589793) ** 0.5!r} AS pdf FROM z""",
                         "z", "cdf", "pdf"))
def q_e13(spark, d):
    """Normal CDF/PDF of standardised event values (checked against erfc in tests)."""
    z = _z_events(spark, d)
    return finish(z.select("event_id", "z", E.norm_cdf("z").alias("cdf"), E.norm_pdf("z").alias("pdf")))


@register("E14", rounded(WV() + """, st AS (SELECT dataset_name, avg(assay_score) AS m FROM b_variant GROUP BY dataset_name)
SELECT v.part_id, (v.assay_score - st.m) / sqrt((v.position / 100.0::DOUBLE) * (v.position / 100.0::DOUBLE) + 0.25)
  AS z_score FROM b_variant v JOIN st ON v.dataset_name = st.dataset_name""", "z_score"))
def q_e14(spark, d):
    v = _variants(spark, d)
    st = v.groupBy("dataset_name").agg(F.avg("assay_score").alias("m"))
    j = v.join(st, "dataset_name").withColumn("u", F.col("position") / F.lit(100.0))
    return finish(j.select("part_id", E.pooled_z("assay_score", "m", "u", F.lit(0.5)).alias("z_score")))


@register("E15", rounded(WV() + """, st AS (SELECT dataset_name, avg(assay_score) - 1.0 AS m FROM b_variant GROUP BY dataset_name)
SELECT v.part_id, CASE WHEN (v.assay_score - 1.0) / st.m > 0 THEN log2((v.assay_score - 1.0) / st.m) END AS log2fc
FROM b_variant v JOIN st ON v.dataset_name = st.dataset_name""", "log2fc"))
def q_e15(spark, d):
    v = _variants(spark, d).withColumn("x", F.col("assay_score") - 1.0)
    st = v.groupBy("dataset_name").agg((F.avg("assay_score") - 1.0).alias("m"))
    return finish(v.join(st, "dataset_name").select("part_id", E.log2_fold_change("x", "m").alias("log2fc")))


def _ss_residues(spark, d):
    """Secondary-structure track per dataset residue: DSSP-like code, chain,
    author label ('?' every 17th residue)."""
    r = V.residues_of(_datasets(spark, d))
    codes = "HGIEBTSC"
    code = F.substring(F.lit(codes), (F.col("position") * 3 + F.length("dataset_name")) % 8 + 1, 1)
    return r.select("dataset_name", "position", "aa", code.alias("ss"),
                    F.when(F.col("position") <= 30, "A").otherwise("B").alias("chain"),
                    F.when(F.col("position") % 17 == 0, F.lit("?"))
                    .otherwise((F.col("position") + 100).cast("string")).alias("auth_label"))


_SS_SQL = """SELECT dataset_name, position, aa,
  substr('HGIEBTSC', CAST((position * 3 + length(dataset_name)) % 8 + 1 AS INTEGER), 1) AS ss,
  CASE WHEN position <= 30 THEN 'A' ELSE 'B' END AS chain,
  CASE WHEN position % 17 = 0 THEN '?' ELSE CAST(position + 100 AS VARCHAR) END AS auth_label FROM res"""


@register("E16", WV(res=RESIDUE_SQL, ss=_SS_SQL) + """SELECT dataset_name, position,
  CASE WHEN ss IN ('H', 'G', 'I') THEN 'H' WHEN ss IN ('E', 'B') THEN 'E' ELSE 'C' END AS ss3 FROM ss""")
def q_e16(spark, d):
    s = _ss_residues(spark, d)
    return finish(s.select("dataset_name", "position", E.collapse_ss("ss").alias("ss3")))


@register("E17", WV(res=RESIDUE_SQL, ss=_SS_SQL) + """, m AS (SELECT dataset_name, position,
  TRY_CAST(auth_label AS INTEGER) AS author_num FROM ss WHERE auth_label <> '?')
SELECT s.dataset_name, s.position, m.author_num FROM ss s
LEFT JOIN m ON s.dataset_name = m.dataset_name AND s.position = m.position""")
def q_e17(spark, d):
    s = _ss_residues(spark, d)
    m = s.filter(F.col("auth_label") != "?").select(
        "dataset_name", "position", F.col("auth_label").try_cast("int").alias("author_num"))
    return finish(s.select("dataset_name", "position").join(m, ["dataset_name", "position"], "left"))


@register("E18", WV(res=RESIDUE_SQL, ss=_SS_SQL) + """SELECT dataset_name, string_agg(ss, '' ORDER BY position) AS track
FROM ss WHERE chain = 'A' GROUP BY dataset_name""")
def q_e18(spark, d):
    s = _ss_residues(spark, d).filter(F.col("chain") == "A")
    return finish(V.assemble_sequence(s, ("dataset_name",), "position", "ss")
                  .withColumnRenamed("sequence", "track"))


@register("E19", with_("b_round") + """SELECT round_id, simulation_id, round_num,
  CAST((simulation_id + round_num) * (simulation_id + round_num + 1) // 2 + round_num AS BIGINT) AS seed
FROM b_round""")
def q_e19(spark, d):
    r = RunLog.bound(spark, d).round
    return finish(r.select("round_id", "simulation_id", "round_num",
                           E.cantor_pair("simulation_id", "round_num").cast("long").alias("seed")))


@register("E20", with_("b_sub_run") + """SELECT sub_run_id, json_extract_string(model_parameters, '$.alpha') AS alpha,
  json_extract_string(model_parameters, '$.n_estimators') AS n_estimators,
  json_extract_string(NULLIF('', ''), '$.alpha') AS empty_param FROM b_sub_run""")
def q_e20(spark, d):
    s = RunLog.bound(spark, d).sub_run
    return finish(s.select("sub_run_id", E.json_param("model_parameters", "$.alpha").alias("alpha"),
                           E.json_param("model_parameters", "$.n_estimators").alias("n_estimators"),
                           E.json_param(F.lit(""), "$.alpha").alias("empty_param")))


@register("E21", rounded(with_("b_top_variant") + """SELECT round_id, variant_id,
  (prediction_score - assay_score) * (prediction_score - assay_score) AS squared_error FROM b_top_variant""",
                         "squared_error"))
def q_e21(spark, d):
    tv = RunLog.bound(spark, d).top_variant
    return finish(tv.select("round_id", "variant_id",
                            E.squared_error("prediction_score", "assay_score").alias("squared_error")))


# ---------------------------------------------------------------- labels L1–L8

def _lab_input(spark, d):
    v = _variants(spark, d)
    p = table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), "p_type", "p_size")
    return v.join(p.drop("p_size"), "part_id").withColumn("cls", (F.col("part_id") % 5).cast("int"))


_LAB_SQL = WV(li="""SELECT v.*, p.p_type, CAST(v.part_id % 5 AS INTEGER) AS cls FROM b_variant v
  JOIN part p ON v.part_id = p.p_partkey""")


@register("L1", _LAB_SQL + """SELECT part_id, CASE WHEN p_type = 'SMALL' THEN 1 WHEN p_type = 'LARGE' THEN 0 END AS label
FROM li WHERE p_type IN ('SMALL', 'LARGE')""")
def q_l1(spark, d):
    return finish(L.label_by_category(_lab_input(spark, d), "p_type", "SMALL", "LARGE").select("part_id", "label"))


@register("L2", _LAB_SQL + """SELECT part_id, CASE WHEN cls = 4 AND assay_score > 1.1 THEN 1 WHEN cls = 1 THEN 0 END AS label
FROM li""")
def q_l2(spark, d):
    return finish(L.label_by_class_threshold(_lab_input(spark, d), "cls", "assay_score").select("part_id", "label"))


@register("L3", WV(raw=_RAW_SQL) + """SELECT part_id,
  CASE WHEN p_adj < 0.05 THEN CAST(statistic > 0 AS INTEGER) END AS label_05,
  CASE WHEN p_adj < 0.01 THEN CAST(statistic > 0 AS INTEGER) END AS label_01 FROM raw""")
def q_l3(spark, d):
    raw = _raw_scan(spark, d)
    a = L.label_by_significance(raw, "statistic", "p_adj", 0.05, "label_05")
    b = L.label_by_significance(a, "statistic", "p_adj", 0.01, "label_01")
    return finish(b.select("part_id", "label_05", "label_01"))


@register("L4", WV(c="""SELECT dataset_name, quantile_cont(assay_score, 0.8) AS top,
  quantile_cont(assay_score, 0.2) AS bottom FROM b_variant GROUP BY dataset_name""") + """
SELECT v.part_id, CASE WHEN v.assay_score >= c.top THEN 1 WHEN v.assay_score <= c.bottom THEN 0 END AS label
FROM b_variant v JOIN c ON v.dataset_name = c.dataset_name""")
def q_l4(spark, d):
    return finish(L.label_by_ntile(_variants(spark, d), ["dataset_name"], "assay_score").select("part_id", "label"))


@register("L5", WV(c="""SELECT dataset_name, quantile_cont(assay_score, 0.7) AS gof,
  quantile_cont(assay_score, 0.3) AS lof FROM b_variant GROUP BY dataset_name""") + """
, l AS (SELECT v.part_id, CASE WHEN v.assay_score > c.gof THEN 1 WHEN v.assay_score <= c.lof THEN 0 END AS label
FROM b_variant v JOIN c ON v.dataset_name = c.dataset_name) SELECT * FROM l WHERE label IS NOT NULL""")
def q_l5(spark, d):
    lab = L.label_by_quantile(_variants(spark, d), ["dataset_name"], "assay_score", 0.3, 0.7)
    return finish(lab.select("part_id", "label"))


@register("L6", WV() + """, l AS (SELECT part_id, CASE WHEN assay_score > 1.18 THEN 1 WHEN assay_score < 0.96 THEN 0 END
  AS label FROM b_variant) SELECT * FROM l WHERE label IS NOT NULL""")
def q_l6(spark, d):
    return finish(L.label_by_threshold(_variants(spark, d), "assay_score", 0.96, 1.18).select("part_id", "label"))


def _bh_sql(src: str, p: str, keys: str, out: str) -> str:
    return f"""(SELECT s.*, q.{out} FROM {src} s JOIN (
    SELECT {keys}, {p}, least(1.0, min({p} * m / r) OVER (PARTITION BY {keys} ORDER BY {p} DESC
           ROWS UNBOUNDED PRECEDING)) AS {out}
    FROM (SELECT {keys}, {p}, sum(k) OVER (PARTITION BY {keys} ORDER BY {p} ROWS UNBOUNDED PRECEDING) AS r,
                 sum(k) OVER (PARTITION BY {keys}) AS m
          FROM (SELECT {keys}, {p}, count(*) AS k FROM {src} WHERE {p} IS NOT NULL GROUP BY {keys}, {p}) v) c
  ) q ON s.dataset_name = q.dataset_name AND s.{p} = q.{p})"""


def _l7_sql(pooled: bool) -> str:
    z = ("(v.assay_score - b.median) / sqrt((v.position / 100.0::DOUBLE) * (v.position / 100.0::DOUBLE) + b.mad * b.mad)"
         if pooled else "(v.assay_score - b.median) / b.mad")
    cdf = _cdf_sql("z_score")
    return rounded(WV(
        bv="SELECT part_id, dataset_name, position, 2 + power((assay_score * 1000 - 950) / 20, 5) / 60 AS assay_score FROM b_variant",
        mu="SELECT dataset_name, avg(assay_score) AS mu, quantile_cont(assay_score, 0.5) AS median FROM bv GROUP BY dataset_name",
        b="""SELECT v.dataset_name, any_value(mu.median) AS median, avg(abs(v.assay_score - mu.mu)) * 1.4826 AS mad
             FROM bv v JOIN mu ON v.dataset_name = mu.dataset_name GROUP BY v.dataset_name""",
        z=f"""SELECT v.part_id, v.dataset_name, v.assay_score, {z} AS z_score, b.median
              FROM bv v JOIN b ON v.dataset_name = b.dataset_name""",
        p=f"SELECT *, {cdf} AS p_value_lof FROM z",
        p2="SELECT *, 1 - p_value_lof AS p_value_gof FROM p WHERE p_value_lof IS NOT NULL",
        g=_bh_sql("p2", "p_value_gof", "dataset_name", "q_value_gof"),
        l=_bh_sql("g", "p_value_lof", "dataset_name", "q_value_lof"),
        f="""SELECT *, CASE WHEN assay_score / median > 0 THEN log2(assay_score / median) END AS log2fc_baseline FROM l""",
    ) + """, out AS (SELECT part_id, z_score, p_value_lof, q_value_gof, q_value_lof, log2fc_baseline,
  CASE WHEN log2fc_baseline >= 0.3 AND q_value_gof < 0.05 THEN 1
       WHEN log2fc_baseline <= -0.3 AND q_value_lof < 0.05 THEN 0 END AS label FROM f)
SELECT * FROM out WHERE label IS NOT NULL""", "z_score", "p_value_lof", "q_value_gof", "q_value_lof",
                   "log2fc_baseline")


def _activity(spark, d):
    """Variants with an activity spread wide enough for fold-change labels."""
    return _variants(spark, d).withColumn(
        "assay_score", 2 + F.pow((F.col("assay_score") * 1000 - 950) / 20, 5) / 60)


@register("L7", _l7_sql(False))
def q_l7(spark, d):
    lab = L.label_by_fdr(_activity(spark, d), ["dataset_name"], "assay_score")
    return finish(lab.select("part_id", "z_score", "p_value_lof", "q_value_gof", "q_value_lof",
                             "log2fc_baseline", "label"))


@register("L7_uncertainty", _l7_sql(True))
def q_l7u(spark, d):
    v = _activity(spark, d).withColumn("u", F.col("position") / F.lit(100.0))
    lab = L.label_by_fdr(v, ["dataset_name"], "assay_score", uncertainty="u")
    return finish(lab.select("part_id", "z_score", "p_value_lof", "q_value_gof", "q_value_lof",
                             "log2fc_baseline", "label"))


@register("L8", WV(c="""SELECT dataset_name, quantile_cont(assay_score, 0.8) AS top,
  quantile_cont(assay_score, 0.2) AS bottom FROM b_variant GROUP BY dataset_name""") + """
SELECT v.part_id, 'ntile' AS strategy, CASE WHEN v.assay_score >= c.top THEN 1 WHEN v.assay_score <= c.bottom THEN 0 END AS label
FROM b_variant v JOIN c ON v.dataset_name = c.dataset_name
UNION ALL SELECT part_id, 'threshold', CASE WHEN assay_score > 1.18 THEN 1 WHEN assay_score < 0.96 THEN 0 END
FROM b_variant WHERE assay_score > 1.18 OR assay_score < 0.96""")
def q_l8(spark, d):
    """The same input labelled by two registry strategies picked by name."""
    v = _variants(spark, d)
    a = L.label_strategy("ntile")(v, ["dataset_name"], "assay_score").withColumn("strategy", F.lit("ntile"))
    b = (L.label_strategy("threshold", lof=0.96, gof=1.18)(v, ["dataset_name"], "assay_score")
         .withColumn("strategy", F.lit("threshold")))
    return finish(a.select("part_id", "strategy", "label").unionByName(b.select("part_id", "strategy", "label")))


# ---------------------------------------------------------------- C11 reference build

@register("C11", rounded(WV(raw=_RAW_SQL, res=RESIDUE_SQL) + """
, mis AS (SELECT * FROM raw WHERE alt_aa IS NOT NULL AND NOT contains(alt_aa, '=') AND NOT contains(alt_aa, '*')
          AND length(alt_aa) > 0 AND alt_aa <> ref_aa AND pathway = 'SMALL' AND compound IS NULL),
wt AS (SELECT m.*, r.aa AS wt_aa FROM mis m JOIN res r ON m.dataset_name = r.dataset_name AND m.position = r.position),
seq AS (SELECT dataset_name, string_agg(aa, '' ORDER BY position) AS wt_sequence FROM res GROUP BY dataset_name)
SELECT w.dataset_name, w.wt_aa || CAST(w.position AS VARCHAR) || w.alt_aa AS variant_id, w.position,
       w.wt_aa AS ref_aa, w.alt_aa AS var_aa, w.statistic AS assay_score,
       CASE WHEN w.p_adj < 0.05 THEN CAST(w.statistic > 0 AS INTEGER) END AS class_label,
       substr(s.wt_sequence, 1, w.position - 1) || w.alt_aa || substr(s.wt_sequence, w.position + 1) AS sequence
FROM wt w JOIN seq s ON w.dataset_name = s.dataset_name""", "assay_score"))
def q_c11(spark, d):
    """C11: raw scan → missense filter → condition → WT residue join → WT
    sequence assembly → ids → mutant sequences → significance labels."""
    raw = V.filter_condition(V.drop_nonmissense(_raw_scan(spark, d)), pathway="SMALL")
    res = V.residues_of(_datasets(spark, d))
    j = V.join_wt_residue(raw, res.withColumnRenamed("aa", "wt_aa"))
    seq = V.assemble_sequence(res).withColumnRenamed("sequence", "wt_sequence")
    j = j.join(seq, "dataset_name")
    lab = L.label_by_significance(j, "statistic", "p_adj", 0.05, "class_label")
    return finish(lab.select(
        "dataset_name", E.make_variant_id("wt_aa", "position", "alt_aa").alias("variant_id"), "position",
        F.col("wt_aa").alias("ref_aa"), F.col("alt_aa").alias("var_aa"),
        F.col("statistic").alias("assay_score"), "class_label",
        E.apply_substitution("wt_sequence", "position", "alt_aa").alias("sequence")))
