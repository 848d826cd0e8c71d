"""One registered query for each operator of this subpackage, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_folder, table
from .bottomk_dedup import near_duplicates
from .chat_repair import repair_roles
from .hilbert_shards import hilbert_shards
from .huffman_ids import decode, encode
from .indexed_quality import fit_quality, fit_vectors, score_quality
from .lang_fusion import fit_text_model, identify, page_evidence
from .pii_crf import PATTERN_KINDS, find_pii
from .qalsh import nearest
from .qgram_decontam import find_leaks
from .quadtree_audit import audit_sources
from .rmq_search import rank_documents
from .temperature_mix import mix
from .window_lm import score, train


def _size(text: str) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _crc32(text: str) -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def op1_chat_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_roles(table(spark, sf_dir, "conversations"))


def op2_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_huffman_ids(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    import public_tokenizers

    path = f"{stage_folder(spark)}/huffman-{uuid.uuid4().hex}"
    encode(table(spark, sf_dir, "documents"), path, tokenizer_path or public_tokenizers.path("word_bpe_49k.json"))
    return decode(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_masked_window_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs))


def op5_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", _size("text").alias("size"), _crc32("text").alias("text_crc32"))
    out = hilbert_shards(docs, ["source", "lang", "size"], ["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op7_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (host: the source, declaration: ``lang``) and web pages, judged together."""
    docs = table(spark, sf_dir, "documents")
    model = fit_text_model(docs, "text", "lang", "doc_id")
    rows = docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.col("source").alias("host"),
                       F.col("lang").alias("declared"))
    pages = page_evidence(table(spark, sf_dir, "pages")).withColumn("doc_id", F.lit(None).cast("long"))
    return identify(rows.unionByName(pages), model, "text", "host", "declared").drop("text")


def op8_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    told = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, PATTERN_KINDS), F.sha2(told(base), 256).alias("base_sha256"),
                        told(F.col("spans")).alias("spans"))


def op9_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, entropy_share=0.92).drop("text")


def op10_bottomk_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_indexed_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", "quality")
    vectors = fit_vectors(docs)
    net = fit_quality(docs, labels, vectors)
    scored = score_quality(docs, vectors, net)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op12_quadtree_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


def op13_rmq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _terms_sql(text: str, rest: str) -> str:
    return f"regexp_extract_all(translate({text}, '{_AZ}', '{_AZ.lower()}'), '[^{rest}\\x5B-\\x60\\x7B-\\x7F]+')"


_OP12_SQL = f"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    {_terms_sql("coalesce(text, '')", "\\x00-\\x40")} AS t
  FROM documents),
tf AS (SELECT id, lang, source, term, count(*) AS n FROM (SELECT id, lang, source, unnest(t) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS total FROM tf GROUP BY lang, term HAVING count(*) >= 30),
size AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS kept FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
cell AS (SELECT tf.lang, tf.source, tf.term, sum(tf.n)::HUGEINT AS n FROM tf JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT g.lang, g.source, coalesce(sum(cell.n), 0)::HUGEINT AS kept FROM g LEFT JOIN cell USING (lang, source) GROUP BY ALL),
p AS (SELECT gn.lang, gn.source, kept.term, coalesce(cell.n, 0) AS n,
    1 + (1000000000 * (coalesce(cell.n, 0)::HUGEINT + 5)) // (gn.kept + 5 * size.v) AS p,
    1 + (1000000000 * (kept.total + 5)) // (size.kept + 5 * size.v) AS q
  FROM gn JOIN kept USING (lang) JOIN size USING (lang) LEFT JOIN cell ON cell.lang = gn.lang AND cell.source = gn.source AND cell.term = kept.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
  ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term),
ranked AS (SELECT lang, source, part, item, value::BIGINT AS value,
    row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM both_parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50"""

_OP13_SQL = f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, {_terms_sql("text", "\\x00-\\x2F\\x3A-\\x40")} AS t FROM documents WHERE text IS NOT NULL),
doc AS (SELECT id, doc_id, len(t)::BIGINT AS n, t FROM d WHERE len(t) > 0),
st AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM doc),
asked AS (SELECT item_id, term, count(*)::BIGINT AS r FROM (SELECT item_id, unnest({_terms_sql("text", "\\x00-\\x2F\\x3A-\\x40")}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)) GROUP BY ALL),
tf AS (SELECT id, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT id, doc_id, n, unnest(t) AS term FROM doc)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, st GROUP BY term),
imp AS (SELECT tf.id, tf.doc_id, tf.term, w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 75 + (75 * tf.n * st.n_docs) // st.n_terms))) AS impact
  FROM tf JOIN w USING (term), st),
score AS (SELECT a.item_id, imp.id, imp.doc_id, sum(a.r * imp.impact)::BIGINT AS score FROM asked a JOIN imp USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
  FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""


QUERIES = {
    "op1_chat_role_repair": op1_chat_role_repair,
    "op2_qgram_decontamination": op2_qgram_decontamination,
    "op3_huffman_ids": op3_huffman_ids,
    "op4_masked_window_lm": op4_masked_window_lm,
    "op5_collision_counting": op5_collision_counting,
    "op6_hilbert_shards": op6_hilbert_shards,
    "op7_language_fusion": op7_language_fusion,
    "op8_pii_crf": op8_pii_crf,
    "op9_temperature_mix": op9_temperature_mix,
    "op10_bottomk_near_dedup": op10_bottomk_near_dedup,
    "op11_indexed_quality": op11_indexed_quality,
    "op12_quadtree_audit": op12_quadtree_audit,
    "op13_rmq_search": op13_rmq_search,
}
ORACLES: dict[str, str] = {"op12_quadtree_audit": _OP12_SQL, "op13_rmq_search": _OP13_SQL}
