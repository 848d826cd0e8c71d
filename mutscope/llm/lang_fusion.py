"""Language identification by Bayesian evidence fusion.

Four kinds of evidence about a row's language are added as log-probabilities:

* the text: a naive Bayes model of letter trigrams, fitted on a labelled
  sample; beside the languages there is a background class ("und") whose
  trigrams are all equally likely, which wins on text in no known language;
* the declared markup language: P(declared | language), estimated from all
  rows;
* the address suffix: how much more common a language is under it than in
  all rows;
* the host: P(language | host), smoothed towards its domain, which is
  smoothed towards all rows.

The last three come from sums, over all rows, of the text model's
probabilities (in millionths, so that sums do not depend on their order),
grouped by host and declaration; a row's own share is taken out of its host's,
domain's and suffix's sums.

A row is kept if a language other than "und" reaches ``MIN_POSTERIOR``.

Defined results: null, empty or letterless text is "und" and rejected; null
host or declaration, no evidence from it (a null host shares the null hosts'
prior); repeated rows count as often as they occur; an empty table, no rows.

Every label of the labelled rows is a language, however rare; its spellings
are folded as declarations are ("EN" and "en-US" are "en"; "und" is no label). The text model is
fitted on at most ``SAMPLE_ROWS`` rows a label, the first by hash; it takes
``BUCKETS`` numbers a label.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..util import bounded_broadcast, materialize
from . import textops as T
from .ordering import hot_key_join, hot_keys

SAMPLE_ROWS = 500
SALTS = 64               # tasks over which the rows of one label are dealt out
BROADCAST_ROWS = 1 << 17  # of the sample's ids
BUCKETS = 1 << 14
TEXT_WEIGHT = 200        # trigrams at most that a text's evidence counts as
ADD = 0.1
BACKGROUND = 1e-4        # prior share of the background class
PSEUDO_ROWS = 50.0
MIN_POSTERIOR = 0.5
UNIT = 1_000_000
UNKNOWN = "und"
_TAG = r"^\s*([A-Za-z]{2,3})\s*(?:[-_].*)?$"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case letter, or 32, for each code point below 65,536."""
    table = np.full(65536, 32, np.uint32)
    for i in range(65536):
        low = chr(i).lower()
        if len(low) == 1 and low.isalpha():
            table[i] = ord(low)
    return table


def _trigrams(texts: list[str]):
    """(bucket, document) of every letter trigram; words are apart by one space."""
    raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(raw < 65536, _letters()[np.minimum(raw, 65535)], raw)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    c[ends] = 0
    keep = np.ones(len(c), bool)
    keep[1:] = ~((c[1:] == 32) & ((c[:-1] == 32) | (c[:-1] == 0)))
    c = c[keep]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.cumsum(c == 0)[:-2]
    whole = (c[:-2] != 0) & (c[1:-1] != 0) & (c[2:] != 0)
    h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(18)).astype(np.int64)[whole], doc[whole]


def _count_batches(batches):
    for b in batches:
        label, col = b.column(0).to_pylist(), b.column(1)
        total: dict[str, np.ndarray] = {}
        for lo, hi in T.slices(col):
            bucket, doc = _trigrams(T.null_free(col.slice(lo, hi - lo), "").to_pylist())
            for name in set(label[lo:hi]):
                mine = np.array([x == name for x in label[lo:hi]])
                n = np.bincount(bucket[mine[doc]], minlength=BUCKETS)
                total[name] = total.get(name, 0) + n
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())],
                names=["label", "bucket", "n"])


class TextModel:
    """Log-probability of each trigram bucket under each language, and the background."""

    def __init__(self, labels: list[str], counts: np.ndarray):
        self.labels = [*labels, UNKNOWN]
        p = (counts + ADD) / (counts.sum(axis=0) + ADD * BUCKETS) if labels else np.zeros((BUCKETS, 0))
        p = np.hstack((p, np.full((BUCKETS, 1), 1 / BUCKETS)))
        self.table = np.log(p).astype(np.float32)

    def evidence(self, texts: list[str]):
        """(log-likelihoods, trigrams) of each text; long texts count as ``TEXT_WEIGHT`` trigrams."""
        bucket, doc = _trigrams(texts)
        n = np.bincount(doc, minlength=len(texts))
        out = np.zeros((len(texts), len(self.labels)))
        have = np.flatnonzero(n)
        if len(have):
            first = np.concatenate(([0], np.cumsum(n[have])[:-1]))
            for k in range(len(self.labels)):
                out[have, k] = np.add.reduceat(self.table[:, k][bucket], first, dtype=np.float64)
            out[have] *= (np.minimum(n[have], TEXT_WEIGHT) / n[have])[:, None]
        return out, n

    def prior(self) -> np.ndarray:
        p = np.full(len(self.labels), (1 - BACKGROUND) / max(1, len(self.labels) - 1))
        p[-1] = BACKGROUND
        return p


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def language_code(c):
    """Lower-case language of a tag of two or three letters and subtags; else null."""
    return F.lower(F.regexp_extract(F.when(c.rlike(_TAG), c), _TAG, 1))


def fit_text_model(rows: DataFrame, text_col: str, label_col: str, id_col: str) -> TextModel:
    """Trigram counts of a bounded labelled sample; rows without id, label or text are not in it."""
    said = F.col(label_col).cast("string")
    label = F.coalesce(language_code(said), F.lower(F.trim(said)))
    named = rows.select(F.col(id_col).alias("id"), label.alias("label"), F.col(text_col).cast("string").alias("text"))
    named = named.where(F.col("id").isNotNull() & ~F.col("label").isin("", UNKNOWN))
    labels = [r["label"] for r in named.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), "label").collect()]
    if not labels:
        return TextModel([], np.zeros((BUCKETS, 0)))
    ids = named.select("id", "label").withColumn("h", F.xxhash64("id"))
    # window limits: each task keeps SAMPLE_ROWS rows a label at most, their
    # first ones are found by SALTS tasks a label, and the first of these by one
    # (the same rows, whichever task read them)
    chosen = ids.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    for by in (["label", "salt"], ["label"]):
        first = Window.partitionBy(*by).orderBy("h", "id")
        chosen = chosen.withColumn("r", F.row_number().over(first)).where(F.col("r") <= SAMPLE_ROWS)
    chosen = chosen.select("id", "label").distinct()
    if len(labels) * SAMPLE_ROWS <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    sample = named.join(chosen, ["id", "label"], "left_semi").select("label", "text")
    counts = (sample.mapInArrow(_count_batches, "label string, bucket long, n long")
              .groupBy("label", "bucket").agg(F.sum("n").alias("n"))).toArrow()
    table = np.zeros((BUCKETS, len(labels)))
    if counts.num_rows:
        at = pc.index_in(counts.column("label"), pa.array(labels, pa.string()))
        table[counts.column("bucket").to_numpy(), at.to_numpy()] = counts.column("n").to_numpy()
    return TextModel(labels, table)


def _share_batches(model, batches):
    m = model.value
    for b in batches:
        for lo, hi in T.slices(b.column(0)):
            part = b.slice(lo, hi - lo)
            ll, n = m.evidence(T.null_free(part.column(0), "").to_pylist())
            p = np.rint(_softmax(ll + np.log(m.prior())) * UNIT).astype(np.int64)
            p[n == 0] = 0
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], *(pa.array(p[:, k], pa.int64()) for k in range(p.shape[1]))],
                names=["host", "declared", *(f"s{k}" for k in range(p.shape[1]))])


def _matrix(column, k: int) -> np.ndarray:
    """An Arrow column of long arrays as (rows, k); null rows are zeros."""
    out = np.zeros((len(column), k))
    have = np.flatnonzero(np.asarray(column.is_valid()))
    if len(have):
        out[have] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    return out


def _fuse_batches(shared, names, text_at, declared_at, batches):
    model, everywhere, by_declared = shared.value
    k = len(model.labels)
    overall = (everywhere + 1) / (everywhere + 1).sum()
    # P(declared | language), a count added for each declared value
    n_lang = sum(by_declared.values(), np.zeros(k))
    likely = {d: np.log((n + PSEUDO_ROWS * overall) / (n_lang + PSEUDO_ROWS * overall * (len(by_declared) + 1)))
              for d, n in by_declared.items()}
    for b in batches:
        for lo, hi in T.slices(b.column(text_at)):
            part = b.slice(lo, hi - lo)
            ll, n = model.evidence(T.null_free(part.column(text_at).cast(pa.string()), "").to_pylist())
            alone = _softmax(ll + np.log(model.prior()))
            own = np.where((n > 0)[:, None], np.rint(alone * UNIT), 0) / UNIT
            host, domain, suffix = (np.maximum(_matrix(part.column(part.num_columns - 3 + i), k) / UNIT - own, 0)
                                    for i in range(3))
            smooth = lambda c, base: (c + PSEUDO_ROWS * base) / (c.sum(axis=1, keepdims=True) + PSEUDO_ROWS)
            x = ll + np.log(smooth(host, smooth(domain, overall)))
            x += np.log(smooth(suffix, overall) / overall)
            for i, d in enumerate(part.column(declared_at).to_pylist()):
                if d in likely:
                    x[i] += likely[d]
            p = _softmax(x)
            best = p.argmax(axis=1)
            best[n == 0] = k - 1
            post = np.where(n > 0, p[np.arange(len(best)), best], 0.0)
            kept = (best != k - 1) & (post >= MIN_POSTERIOR)
            label = np.array(model.labels, object)
            said = np.where(n > 0, alone.argmax(axis=1), k - 1)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:len(names)], pa.array(label[best], pa.string()), pa.array(post, pa.float64()),
                 pa.array(label[said], pa.string()), pa.array(kept)],
                names=[*names, "language", "posterior", "text_language", "kept"])


def identify(df: DataFrame, model: TextModel, text_col: str, host_col: str, declared_col: str) -> DataFrame:
    """``df`` with language, posterior, text_language (of the text alone) and kept.

    ``declared_col`` holds language tags; columns of
    ``df`` with the result columns' names are replaced.
    """
    spark = df.sparkSession
    T.bound_batches(spark)
    df = df.drop("language", "posterior", "text_language", "kept")
    shared = spark.sparkContext.broadcast(model)
    k = len(model.labels)
    df = df.withColumn("_host", F.col(host_col).cast("string")).withColumn("_declared", language_code(F.col(declared_col)))
    sums = [F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]
    shares = (df.select(F.col(text_col).cast("string").alias("text"), "_host", "_declared")
              .mapInArrow(lambda it: _share_batches(shared, it),
                          "host string, declared string, " + ", ".join(f"s{i} long" for i in range(k)))
              .groupBy("host", "declared").agg(F.count(F.lit(1)).alias("rows"), *sums))
    shares = materialize(shares, "shares")
    vector = F.array(*[F.col(f"s{i}") for i in range(k)])

    hosts = shares.groupBy("host").agg(F.sum("rows").alias("rows"), *sums)
    hosts = (hosts.withColumn("domain", F.substring_index("host", ".", -2))
             .withColumn("suffix", F.when(F.col("host").contains("."), F.lower(F.substring_index("host", ".", -1)))))
    by = lambda c: hosts.groupBy(c).agg(*sums).select(F.col(c).alias(f"_{c}"), vector.alias(f"{c}_n"))
    domains, suffixes = by("domain"), by("suffix").where("_suffix is not null")
    hosts = materialize(
        hosts.select("host", "rows", "domain", "suffix", vector.alias("host_n"))
        .join(domains, F.col("domain").eqNullSafe(F.col("_domain")), "left")
        .join(bounded_broadcast(suffixes), F.col("suffix") == F.col("_suffix"), "left")
        .select("host", "rows", "host_n", "domain_n", "suffix_n"), "hosts")

    # codes of two or three letters: 18,252 rows at most
    said = shares.where("declared is not null").groupBy("declared").agg(*sums).toArrow()
    counts = np.stack([said.column(f"s{i}").to_numpy() for i in range(k)], axis=1) / UNIT
    declared = dict(zip(said.column("declared").to_pylist(), counts))
    total = shares.agg(*sums).first()
    everywhere = np.array([total[f"s{i}"] or 0 for i in range(k)]) / UNIT

    facts = spark.sparkContext.broadcast((model, everywhere, declared))
    names = [c for c in df.columns if c not in ("_host", "_declared")]
    prior = hosts.select(F.col("host").alias("_host"), "host_n", "domain_n", "suffix_n")
    joined = hot_key_join(df, prior, "_host", hot_keys(hosts, "host", "rows"), F.col(text_col))
    joined = joined.select(*[df[c] for c in names], "_declared", "host_n", "domain_n", "suffix_n")
    at, declared_at = names.index(text_col), len(names)
    schema = ST.StructType([*(df.schema[c] for c in names), ST.StructField("language", ST.StringType()),
                            ST.StructField("posterior", ST.DoubleType()),
                            ST.StructField("text_language", ST.StringType()), ST.StructField("kept", ST.BooleanType())])
    return joined.mapInArrow(lambda it: _fuse_batches(facts, names, at, declared_at, it), schema)


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text, host and declared language of raw web pages."""
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    declared = F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]{3}(?![A-Za-z])|[A-Za-z]{2})", 1)
    host = F.lower(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    blank = lambda c: F.when(c != "", c)
    return pages.select("page_id", text.alias("text"), blank(host).alias("host"), blank(declared).alias("declared"))
