"""Feature jobs on token embeddings (M8–M13) and embedding tables.

Token embeddings are rows ``(seq_id, pos, vec ARRAY<DOUBLE>)`` — no padding
exists, so masks are unnecessary.  Pooling and statistics sum whole vectors
(``Summarizer``), never one row per number.  Window membership is computed
per token (which windows cover position p) and exploded, so no token × window
join is needed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..util import bounded_broadcast, materialize, null_safe_join
from .ridge import add_tiles
from .selection import seeded_hash

# Value of an empty max-pooling window: the most negative float32 (fixed value).
EMPTY_MAX = -3.4028234663852886e38

MIXTURE_BYTES = 32 << 20
VECTORS_AT_ONCE = 4096
EXACT_WIDTH = 1024            # features up to which a principal component analysis forms the d x d matrix
OVERSAMPLING = 10
BASIS_ROWS = 1024             # rows of a basis that travel together


def tokens_from_flat(df: DataFrame, seq: Column, first_pos: Column, vec_col: str, n_tokens: int, dim: int) -> DataFrame:
    """Reshape flat vectors (n_tokens·dim numbers) into token rows; a sequence
    may go on over several rows, ``first_pos`` is a row's first position."""
    t = df.select(seq.alias("seq_id"), first_pos.alias("_p"), F.col(vec_col).alias("_v"),
                  F.explode(F.sequence(F.lit(0), F.lit(n_tokens - 1))).alias("_t"))
    vec = F.slice("_v", F.col("_t") * dim + 1, F.lit(dim)).cast("array<double>")
    return t.select("seq_id", (F.col("_p") + F.col("_t")).cast("int").alias("pos"), vec.alias("vec"))


def tokens_from_long(df: DataFrame) -> DataFrame:
    """Token rows from a table of single numbers (seq_id, pos, dim, value)."""
    s = F.array_sort(F.collect_list(F.struct("dim", "value")))
    return df.groupBy("seq_id", "pos").agg(F.transform(s, lambda x: x["value"]).alias("vec"))


def _pooled(how: str) -> Column:
    return vector_to_array((Summarizer.mean if how == "mean" else Summarizer.max)(array_to_vector("vec")))


def pool_mean(tokens: DataFrame) -> DataFrame:
    """M8: mean over a sequence's tokens, per dimension."""
    return tokens.groupBy("seq_id").agg(_pooled("mean").alias("vector"))


def pool_first(tokens: DataFrame) -> DataFrame:
    """M9: the first token's vector."""
    return tokens.filter(F.col("pos") == 0).select("seq_id", F.col("vec").alias("vector"))


def _lengths(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("seq_id").agg((F.max("pos") + 1).alias("len"))


def _pool_segments(t: DataFrame, segments: int, how: str) -> DataFrame:
    """One vector per (seq_id, seg), then the segments of a sequence in order;
    a segment without tokens reads 0 (mean) or ``EMPTY_MAX`` (max)."""
    pooled = t.groupBy("seq_id", "seg").agg(_pooled(how).alias("v"))
    by_seg = F.map_from_entries(F.collect_list(F.struct(F.col("seg").cast("int"), "v")))
    out = pooled.groupBy("seq_id").agg(by_seg.alias("m"), F.max(F.size("v")).alias("d"))
    empty = F.array_repeat(F.lit(0.0 if how == "mean" else EMPTY_MAX), F.col("d"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(segments - 1)),
                         lambda s: F.coalesce(F.try_element_at("m", s), empty))
    return out.select("seq_id", F.flatten(vector).alias("vector"))


def _windows(tokens: DataFrame, segments: int, overlap: float) -> DataFrame:
    """Tokens with their sequence's length, window width and stride."""
    w = F.greatest(F.lit(1), F.floor(F.col("len") / segments)).cast("long")
    stride = F.greatest(F.lit(1).cast("long"), w - F.floor(w * F.lit(float(overlap))).cast("long"))
    geo = _lengths(tokens).select("seq_id", "len", w.alias("w"), stride.alias("stride"))
    return tokens.join(geo, "seq_id")


def pool_windows(tokens: DataFrame, segments: int = 8, overlap: float = 0.5, how: str = "mean") -> DataFrame:
    """Adaptive windows per sequence length L — w = max(1, L div S),
    stride = max(1, w − trunc(w·f)), window s = [s·stride, min(s·stride+w, L)).
    Output: S·D values, segment-major.  With overlap the tail beyond the last
    window is not covered (as in the reference)."""
    t = _windows(tokens, segments, overlap)
    s_lo = F.greatest(F.lit(0), F.ceil((F.col("pos") - F.col("w") + 1) / F.col("stride")))
    s_hi = F.least(F.lit(segments - 1), F.floor(F.col("pos") / F.col("stride")))
    t = t.filter(s_lo <= s_hi).select("seq_id", "vec", F.explode(F.sequence(s_lo.cast("int"), s_hi.cast("int"))).alias("seg"))
    return _pool_segments(t, segments, how)


def pool_windows_fixed(tokens: DataFrame, segments: int = 8, overlap: float = 0.5, how: str = "mean") -> DataFrame:
    """Older fixed-length windows — same sizes, but a window running past
    the end is shifted back inside the sequence: end = L, start = max(0, L − w).

    Windows s < s_c = ⌊(L − w)/stride⌋ + 1 are [s·stride, s·stride + w); all
    later ones are the shifted last window [L − w, L).  Each token explodes
    into the windows covering it (two index ranges), so tokens are never
    paired with every window of their sequence.
    """
    t = _windows(tokens, segments, overlap)
    t = t.withColumn("s_c", F.least(F.lit(segments).cast("long"),
                                    F.floor((F.col("len") - F.col("w")) / F.col("stride")).cast("long") + 1))
    lo1 = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("pos") - F.col("w") + 1) / F.col("stride")).cast("long"))
    hi1 = F.least(F.col("s_c") - 1, F.floor(F.col("pos") / F.col("stride")).cast("long"))
    none = F.array().cast("array<long>")
    first = F.when(lo1 <= hi1, F.sequence(lo1, hi1)).otherwise(none)
    shifted = F.when((F.col("pos") >= F.col("len") - F.col("w")) & (F.col("s_c") <= segments - 1),
                     F.sequence(F.col("s_c"), F.lit(segments - 1).cast("long"))).otherwise(none)
    t = t.select("seq_id", "vec", F.explode(F.array_union(first, shifted)).alias("seg"))
    return _pool_segments(t, segments, how)


# ---------------------------------------------------------------- mixtures and Fisher vectors

@dataclass
class Mixture:
    """A diagonal Gaussian mixture: weights (K), means and variances (K x D).

    Tasks get it as a broadcast value of K·(2D + 1) numbers, at most
    ``MIXTURE_BYTES``, so that plans do not grow with it.
    """
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    @classmethod
    def of(cls, weights, means, variances) -> "Mixture":
        m = cls(*(np.asarray(v, float) for v in (weights, means, variances)))
        if m.means.nbytes > MIXTURE_BYTES:
            raise ValueError("a mixture of this size is not sent to tasks; reduce the vectors first (fit_pca)")
        return m

    @classmethod
    def read(cls, table: DataFrame) -> "Mixture":
        """From a stored table (k, weight, mean, var) of K rows."""
        rows = table.orderBy("k").collect()
        return cls.of([r["weight"] for r in rows], [r["mean"] for r in rows], [r["var"] for r in rows])

    def table(self, spark) -> DataFrame:
        rows = [(k, float(w), m.tolist(), v.tolist()) for k, (w, m, v) in enumerate(zip(self.weights, self.means, self.variances))]
        return spark.createDataFrame(rows, "k int, weight double, mean array<double>, var array<double>")

    def posteriors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(posterior of each component, log-likelihood) of the rows of ``x``.

        A log-density is linear in (x, x²), measured from the mixture's middle, by log-sum-exp over components.
        """
        middle = self.weights @ self.means
        x, mu = x - middle, self.means - middle
        constant = np.log(self.weights) - 0.5 * (np.log(2 * np.pi * self.variances) + mu * mu / self.variances).sum(axis=1)
        logp = x @ (mu / self.variances).T - 0.5 * (x * x) @ (1 / self.variances).T + constant
        top = logp.max(axis=1, keepdims=True)
        ll = top + np.log(np.exp(logp - top).sum(axis=1, keepdims=True))
        return np.exp(logp - ll), ll[:, 0]


def _vectors(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _posterior_batches(shared, at, names, batches):
    for b in batches:
        if b.num_rows:
            gamma, ll = shared.value.posteriors(_vectors(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ll), pa.array(list(gamma), pa.list_(pa.float64()))],
                                             names=[*names, "ll", "gamma"])


def with_posteriors(tokens: DataFrame, weights, means, variances) -> DataFrame:
    """Tokens with ``ll`` (log-likelihood) and ``gamma`` (posterior of each component)."""
    shared = tokens.sparkSession.sparkContext.broadcast(Mixture.of(weights, means, variances))
    schema = T.StructType([*tokens.schema.fields, *T.StructType.fromDDL("ll double, gamma array<double>").fields])
    names, at = tokens.columns, tokens.columns.index("vec")
    return tokens.mapInArrow(lambda it: _posterior_batches(shared, at, names, it), schema)


def _component_sums(mix: Mixture, x: np.ndarray):
    """(K, 2 + 2D): sums of posterior, of log-likelihood (in the first component), of posterior · x and · x²."""
    gamma, ll = mix.posteriors(x)
    told = np.zeros((len(mix.weights), 1))
    told[0] = ll.sum()
    return np.hstack((gamma.sum(axis=0)[:, None], told, gamma.T @ x, gamma.T @ (x * x)))


def _moment_batches(shared, batches):
    """(k, tile): a task's sums, a row a component."""
    total = None
    for b in batches:
        for at in range(0, b.num_rows, VECTORS_AT_ONCE):
            s = _component_sums(shared.value, _vectors(b.column(0).slice(at, VECTORS_AT_ONCE)))
            total = s if total is None else total + s
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())],
                                         names=["k", "tile"])


def _fisher_batches(shared, batches):
    """(seq_id, stats, n): a batch's sums of first- and second-order statistics of each sequence."""
    mix = shared.value
    for b in batches:
        for at in range(0, b.num_rows, VECTORS_AT_ONCE):
            part = b.slice(at, VECTORS_AT_ONCE)
            x = _vectors(part.column(1))
            gamma, _ = mix.posteriors(x)
            code = part.column(0).dictionary_encode("encode")
            seq = code.indices.to_numpy()
            stats = []
            for s in range(len(code.dictionary)):
                g, v = gamma[seq == s], x[seq == s]
                n, first, second = g.sum(axis=0)[:, None], g.T @ v, g.T @ (v * v)
                d1 = (first - n * mix.means) / mix.variances
                d2 = (second - 2 * mix.means * first + n * mix.means ** 2) / mix.variances - n
                stats.append(np.concatenate((d1.ravel(), d2.ravel())))
            yield pa.RecordBatch.from_arrays(
                [code.dictionary, pa.array(stats, pa.list_(pa.float64())), pa.array(np.bincount(seq, minlength=len(stats)), pa.int64())],
                names=["seq_id", "stats", "n"])


def fisher_vectors(tokens: DataFrame, weights, means, variances, normalize: bool = True) -> DataFrame:
    """Fisher-vector encoding against a diagonal mixture (K components).

    Tasks sum each sequence's first- and second-order statistics, Spark adds
    the sums up per sequence; they are divided by L·√π_k; then signed square
    root and L2 normalisation.  Output length 2·K·D (first-order block, then
    second-order block; component-major).  ``fisher_vectors(tokens,
    *astuple(mixture))`` encodes with a fitted one.
    """
    spark = tokens.sparkSession
    mix = Mixture.of(weights, means, variances)
    shared = spark.sparkContext.broadcast(mix)
    kind = tokens.schema["seq_id"].dataType.simpleString()
    parts = tokens.select("seq_id", "vec").mapInArrow(lambda it: _fisher_batches(shared, it), f"seq_id {kind}, stats array<double>, n long")
    sums = (parts.groupBy("seq_id")
            .agg(vector_to_array(Summarizer.sum(array_to_vector("stats"))).alias("_s"), F.sum("n").alias("n")))
    scaled = spark.sparkContext.broadcast(np.tile(np.repeat(np.sqrt(mix.weights), mix.means.shape[1]), 2))

    def finished(batches):
        for b in batches:
            if not b.num_rows:
                continue
            fv = _vectors(b.column(1)) / (b.column(2).to_numpy()[:, None] * scaled.value)
            if normalize:
                fv = np.sign(fv) * np.sqrt(np.abs(fv))
                norm = np.sqrt((fv * fv).sum(axis=1, keepdims=True))
                fv = fv / np.where(norm > 0, norm, 1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(fv), pa.list_(pa.float64()))], names=["seq_id", "fisher_vector"])

    return sums.mapInArrow(finished, f"seq_id {kind}, fisher_vector array<double>")


def fit_mixture(tokens: DataFrame, k: int, seed: int = 42, max_iter: int = 50, tolerance: float = 1e-4,
                floor: float = 1e-6) -> Mixture:
    """Diagonal Gaussian mixture over token vectors by EM.

    Each iteration reads the vectors once: tasks sum posterior-weighted
    moments (K·(2 + 2D) numbers each), which are added component by component
    before they reach the driver.  Starts from the k tokens that come first by
    a seeded hash, with the overall variances; ends when the mean
    log-likelihood rises by less than ``tolerance``.  Reduce the vectors first
    (``fit_pca``) for a mixture in fewer dimensions.
    """
    context = tokens.sparkSession.sparkContext
    t = materialize(tokens.select("seq_id", "pos", "vec"), "tokens")
    whole = t.agg(Summarizer.variance(array_to_vector("vec")).alias("v"), F.count(F.lit(1)).alias("n")).first()
    n, var = whole["n"], np.maximum(whole["v"].toArray(), floor)
    order = seeded_hash(F.lit(seed), F.concat_ws(":", "seq_id", "pos"))
    first = t.select("vec", order.alias("h"), "seq_id", "pos").orderBy("h", "seq_id", "pos").limit(k).collect()
    mix = Mixture.of(np.full(len(first), 1 / len(first)), [r["vec"] for r in first], np.tile(var, (len(first), 1)))
    last, d = -math.inf, len(var)
    for _ in range(max_iter):
        shared = context.broadcast(mix)
        parts = t.select("vec").mapInArrow(lambda it, s=shared: _moment_batches(s, it), "k int, tile binary")
        added = parts.repartition("k").sortWithinPartitions("k").mapInArrow(lambda it: add_tiles(["k"], it), "k int, tile binary")
        m = np.stack([np.frombuffer(r["tile"]) for r in added.orderBy("k").collect()])
        shared.destroy()
        g, ll = np.maximum(m[:, :1], 1e-300), m[0, 1] / n
        mu = m[:, 2:2 + d] / g
        mix = Mixture(np.maximum(m[:, 0] / n, 1e-300), mu, np.maximum(m[:, 2 + d:] / g - mu * mu, floor))
        if ll - last < tolerance:
            break
        last = ll
    return mix


def fit_gmm(tokens: DataFrame, k: int, **parameters) -> tuple[list[float], list[list[float]], list[list[float]]]:
    """M12 as plain lists: weights, means, variances."""
    m = fit_mixture(tokens, k, **parameters)
    return m.weights.tolist(), m.means.tolist(), m.variances.tolist()


# ---------------------------------------------------------------- MLlib-backed jobs

def to_vector(df: DataFrame, array_col: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array_col).cast("array<double>")))


def scale_features(df: DataFrame, array_col: str, with_mean: bool = True) -> DataFrame:
    """M2: standardise with the *population* σ (scikit-learn convention):
    MLlib's scaler divides by the sample σ, so its output is multiplied by
    √(n/(n−1)) per element."""
    v = to_vector(df, array_col, "_f")
    model = StandardScaler(inputCol="_f", outputCol="_s", withMean=with_mean, withStd=True).fit(v)
    n = df.count()
    factor = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    out = model.transform(v).withColumn(
        "scaled", F.transform(vector_to_array("_s"), lambda x: x * F.lit(factor)))
    return out.drop("_f", "_s")


class FittedPca:
    """M1: centring and projection fitted once, applied to any later frame."""

    def __init__(self, centre, model, array_col: str):
        self.centre, self.model, self.array_col = centre, model, array_col

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``pca``; the unchanged vector where the fit was skipped."""
        if self.model is None:
            return df.withColumn("pca", F.col(self.array_col).cast("array<double>"))
        out = self.model.transform(self.centre.transform(to_vector(df, self.array_col, "_f")))
        return out.withColumn("pca", vector_to_array("_p")).drop("_f", "_c", "_p")


class WidePca:
    """M1 for wide vectors: the mean, the axes (d x k, orthonormal) and the variance along each."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray, variance: np.ndarray, array_col: str):
        self.mean, self.axes, self.variance, self.array_col = mean, axes, variance, array_col

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``pca``; NULL where the vector is."""
        df = df.drop("pca")
        shared = df.sparkSession.sparkContext.broadcast((self.mean, self.axes))
        names = df.columns

        def projected(batches):
            mean, axes = shared.value
            for b in batches:
                column = b.column(len(names))
                p = iter((_vectors(column.drop_null()) - mean) @ axes if column.null_count < len(column) else ())
                out = [next(p) if v else None for v in column.is_valid().to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.list_(pa.float64()))], names=[*names, "pca"])

        schema = T.StructType([*df.schema.fields, T.StructField("pca", T.ArrayType(T.DoubleType()))])
        return df.withColumn("_x", F.col(self.array_col).cast("array<double>")).mapInArrow(projected, schema)


def _scatter_batches(shared, batches):
    """(k, tile): a task's sums of (x - mean) (x - mean)ᵀ times the basis, in blocks of rows of the product."""
    mean, basis = shared.value
    total = np.zeros(basis.shape)
    for b in batches:
        for at in range(0, b.num_rows, VECTORS_AT_ONCE):
            x = _vectors(b.column(0).slice(at, VECTORS_AT_ONCE)) - mean
            total += x.T @ (x @ basis)
    blocks = range(0, len(total), BASIS_ROWS)
    yield pa.RecordBatch.from_arrays([pa.array(list(range(len(blocks))), pa.int32()),
                                      pa.array([total[i:i + BASIS_ROWS].tobytes() for i in blocks], pa.binary())], names=["k", "tile"])


def fit_wide_pca(df: DataFrame, array_col: str, k: int, seed: int = 42, max_passes: int = 40, tolerance: float = 1e-9) -> WidePca:
    """M1: principal axes by a randomised range finder, without a d x d matrix anywhere.

    A seeded random basis of k + ``OVERSAMPLING`` columns is multiplied by the
    scatter matrix, a pass over the rows at a time (tasks sum xxᵀ·basis, d x
    (k + ``OVERSAMPLING``) numbers), and made orthonormal again; the small
    matrix basisᵀ·scatter·basis gives axes and variances. Ends when the
    leading variances rise by less than ``tolerance`` of their sum.
    """
    context = df.sparkSession.sparkContext
    rows = materialize(df.select(F.col(array_col).cast("array<double>").alias("x")).where("x is not null"), "vectors")
    whole = rows.agg(Summarizer.mean(array_to_vector("x")).alias("m"), F.count(F.lit(1)).alias("n")).first()
    mean, n = whole["m"].toArray(), whole["n"]
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(mean), min(len(mean), k + OVERSAMPLING))))[0]
    last = -math.inf
    for _ in range(max_passes):
        shared = context.broadcast((mean, basis))
        parts = rows.mapInArrow(lambda it, s=shared: _scatter_batches(s, it), "k int, tile binary")
        added = parts.repartition("k").sortWithinPartitions("k").mapInArrow(lambda it: add_tiles(["k"], it), "k int, tile binary")
        product = np.concatenate([np.frombuffer(r["tile"]) for r in added.orderBy("k").collect()]).reshape(basis.shape)
        shared.destroy()
        small = basis.T @ product
        value, turn = np.linalg.eigh((small + small.T) / 2)
        by = np.argsort(-value)
        value, axes = value[by][:k], (basis @ turn[:, by])[:, :k]
        if value.sum() - last <= tolerance * max(value.sum(), 1e-300):
            break
        last = value.sum()
        basis = np.linalg.qr(product)[0]
    return WidePca(mean, axes, value / max(1, n - 1), array_col)


def fit_pca(df: DataFrame, array_col: str, k: int) -> FittedPca | WidePca:
    """M1: PCA to k dimensions on centred features (MLlib's PCA does not centre
    at transform); skipped when k > n − 1.  Vectors of more than
    ``EXACT_WIDTH`` numbers go the way of ``fit_wide_pca``."""
    if k > df.count() - 1:
        return FittedPca(None, None, array_col)
    if (df.agg(F.max(F.size(array_col))).first()[0] or 0) > EXACT_WIDTH:
        return fit_wide_pca(df, array_col, k)
    v = to_vector(df, array_col, "_f")
    centre = StandardScaler(inputCol="_f", outputCol="_c", withMean=True, withStd=False).fit(v)
    return FittedPca(centre, PCA(k=k, inputCol="_c", outputCol="_p").fit(centre.transform(v)), array_col)


def bimodal_threshold(df: DataFrame, value: str, keys=(), starts: int = 10, iterations: int = 100,
                      grid: int = 1000, floor: float = 1e-9, tol: float = 1e-3) -> DataFrame:
    """Per key a two-component 1-D mixture; the threshold is the density
    minimum between the two means on a ``grid``-point grid over [min−1, max+1].

    EM runs on counted values for all keys and ``starts`` at once: one
    aggregation an iteration gives every start's new parameters, the best
    log-likelihood per key is kept (ties: the first start).  Start s places
    the means (s + 1)/4 deviations below and above the mean.  A start whose
    log-likelihood a value changes by less than ``tol`` is fitted and goes
    through no further iteration (of at most ``iterations``).  A key whose
    values are all equal has a NULL threshold.
    """
    keys = list(keys)
    g = keys or ["_g"]
    base = df if keys else df.withColumn("_g", F.lit(0))
    counts = materialize(base.filter(F.col(value).isNotNull()).groupBy(*g, F.col(value).cast("double").alias("v"))
                         .agg(F.count(F.lit(1)).alias("n")), "values")
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("v")) / F.sum("n")
    st = counts.groupBy(*g).agg(n.alias("total"), mean.alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    dev = null_safe_join(counts, bounded_broadcast(st), g)
    spread = dev.groupBy(*g).agg(F.sqrt(F.sum(F.col("n") * (F.col("v") - F.col("m")) ** 2) / F.first("total")).alias("sd"))
    st = materialize(null_safe_join(st, spread, g).filter("sd > 0"), "moments")
    away = F.col("sd") * (F.col("s") + 1) / 4
    p = st.select(*g, "sd", "m", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("s")).select(
        *g, "s", F.lit(0.5).alias("w"), (F.col("m") - away).alias("a"), (F.col("m") + away).alias("b"),
        (F.col("sd") ** 2).alias("x"), (F.col("sd") ** 2).alias("y"), F.lit(None).cast("double").alias("ll"), F.lit(False).alias("_done"))
    normal = lambda v, mu, var: F.exp(-(v - mu) * (v - mu) / (2 * var)) / F.sqrt(2 * math.pi * var)
    v, c = F.col("v"), F.col("n")
    for _ in range(iterations):
        j = null_safe_join(counts, bounded_broadcast(p.where("not _done")), g)
        j = j.withColumn("fa", F.col("w") * normal(v, F.col("a"), F.col("x")) + 1e-300)
        j = j.withColumn("fb", (1 - F.col("w")) * normal(v, F.col("b"), F.col("y")) + 1e-300)
        j = j.withColumn("ra", F.col("fa") / (F.col("fa") + F.col("fb"))).withColumn("rb", 1 - F.col("ra"))
        t = j.groupBy(*g, "s").agg(
            F.sum(c * F.col("ra")).alias("na"), F.sum(c * F.col("rb")).alias("nb"),
            F.sum(c * F.col("ra") * v).alias("sa"), F.sum(c * F.col("rb") * v).alias("sb"),
            F.sum(c * F.col("ra") * v * v).alias("qa"), F.sum(c * F.col("rb") * v * v).alias("qb"),
            F.sum(c * F.log(F.col("fa") + F.col("fb"))).alias("ll"),
            F.first("ll").alias("_before"), F.sum(c).alias("_total"))
        t = t.withColumn("na", F.greatest("na", F.lit(1e-12))).withColumn("nb", F.greatest("nb", F.lit(1e-12)))
        a, b = F.col("sa") / F.col("na"), F.col("sb") / F.col("nb")
        near = F.abs(F.col("ll") - F.col("_before")) < tol * F.col("_total")
        t = t.select(
            *g, "s", (F.col("na") / (F.col("na") + F.col("nb"))).alias("w"), a.alias("a"), b.alias("b"),
            F.greatest(F.col("qa") / F.col("na") - a * a, F.lit(floor)).alias("x"),
            F.greatest(F.col("qb") / F.col("nb") - b * b, F.lit(floor)).alias("y"), "ll", F.coalesce(near, F.lit(False)).alias("_done"))
        p = materialize(t.unionByName(p.where("_done").select(*t.columns)), "mixture")
        if p.where("not _done").isEmpty():
            break
    best = p.groupBy(*g).agg(F.max_by(F.struct("w", "a", "b", "x", "y"), F.struct("ll", -F.col("s"))).alias("p")).select(*g, "p.*")
    best = null_safe_join(best, st.select(*g, "lo", "hi"), g)
    pts = best.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"))
    pts = pts.withColumn("at", (F.col("lo") - 1) + F.col("i") * (F.col("hi") - F.col("lo") + 2) / (grid - 1))
    between = (F.col("at") > F.least("a", "b")) & (F.col("at") < F.greatest("a", "b"))
    at = F.col("at")
    pdf = F.col("w") * normal(at, F.col("a"), F.col("x")) + (1 - F.col("w")) * normal(at, F.col("b"), F.col("y"))
    out = pts.groupBy(*g).agg(F.min_by(F.when(between, at), F.when(between, pdf)).alias("threshold"),
                              F.first(F.least("a", "b")).alias("mean_low"), F.first(F.greatest("a", "b")).alias("mean_high"))
    return out.select(*keys, "threshold", "mean_low", "mean_high")
