"""Quality classifier: random-indexing word vectors, pooled, through a two-layer network with a calibrated temperature.

Words. A token is a run of letters and digits (every non-ASCII character counts
as a letter), as written, or a run of other visible characters. A token found
in at least ``MIN_SHARE`` of the documents (and in ``MIN_DOCS``) is a word with
a vector of its own. All other tokens are words by their shape: kind, case and
length, ``SHAPES`` of them. A share of the documents bounds the words: there
are at most (mean distinct tokens of a document) / share of them. Where even
that is more than ``MAX_WORDS``, the share is doubled until it is not, so the
vectors that tasks are sent never exceed ``MAX_WORDS`` x ``DIM`` x 4 bytes.

Random indexing. A token's index vector has ``ONES`` entries of +1 or -1 at
places given by its hash; it is never stored. A word's vector is the sum of
the index vectors of the tokens within ``WINDOW`` places, over the whole
corpus, scaled to length 1. Every task adds up its documents' counts, and the
sums of all tasks are added by blocks of words: each task's block goes to the
block's task, which holds one running sum.

Documents. A document is pooled to the mean and the deviation of its tokens'
vectors and the logarithm of its length; whole texts, in blocks of tokens.
The network (one hidden layer, a logistic output) is fitted in numpy on at
most ``TRAIN_ROWS`` labelled documents, those with the smallest hashes of
their ids. One in ``HOLD`` of them is kept out of the weights; on these one
temperature divides the output, chosen for the least cross-entropy.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..util import materialize
from . import textops as T

DIM = 64
ONES = 4
WINDOW = 2
MIN_DOCS = 5
MIN_SHARE = 1 / 2000
MAX_WORDS = 1 << 18
WORD_BLOCK = 64              # words whose sums travel together
HELD_COUNTS = 1 << 21        # distinct tokens a task adds up before it hands them on
TOKENS_AT_ONCE = 1 << 15

TRAIN_ROWS = 20_000
HOLD = 5
HIDDEN = 32
EPOCHS = 60
BATCH = 128
RATE = 3e-3
DECAY = 1e-4
THRESHOLD = 0.7

_CLASS = np.full(256, 2, np.uint8)               # 0 space and control, 1 letters and digits, 2 other visible
_CLASS[:0x21] = _CLASS[0x7F] = 0
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _CLASS[_lo:_hi + 1] = 1
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
SHAPES = 3 * 4 * 4


def tokens(column):
    """(hash, shape, row) of each token of a string column, in text order; null has none."""
    data, offsets = T.utf8(column)
    n = len(data)
    kind = np.concatenate((_CLASS[data], [0]))
    change = np.ones(n + 1, bool)
    change[1:] = kind[1:] != kind[:-1]
    change[offsets] = True
    bounds = np.flatnonzero(change)
    bounds = bounds[bounds <= n]
    starts, ends = bounds[:-1], bounds[1:]
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    total = lambda flag: np.concatenate(([0], np.cumsum(flag[data])))
    within = lambda run: run[ends] - run[starts]
    size, upper, digits = ends - starts, within(total(_UPPER)), within(total(_DIGIT))
    sort = np.where(kind[starts] == 2, 0, np.where(digits > 0, 1, 2))
    case = np.where(upper == 0, 0, np.where(upper == size, 1, np.where((upper == 1) & _UPPER[data[starts]], 2, 3)))
    length = np.searchsorted([3, 6, 12], size, "right")
    return (T.word_hashes(data, starts, ends), (sort * 4 + case) * 4 + length,
            np.searchsorted(offsets, starts, "right") - 1)


def _pieces(batches, at: int = 0):
    for b in batches:
        for lo, hi in T.slices(b.column(at)):
            yield b.slice(lo, hi - lo)


# ---------------------------------------------------------------- words

def _added(keys: list, counts: list):
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)


def _count_documents(batches):
    """(token, df) of a task's documents; a token comes again only where a task holds more than ``HELD_COUNTS``."""
    keys, counts, held = [], [], 0

    def batch(key, n):
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["token", "df"])

    for piece in _pieces(batches):
        key, _, row = tokens(piece.column(0))
        if not len(key):
            continue
        token, code = np.unique(key, return_inverse=True)
        pairs = np.unique(row * len(token) + code)
        keys.append(token)
        counts.append(np.bincount(pairs % len(token), minlength=len(token)))
        held += len(token)
        if held > HELD_COUNTS:
            key, n = _added(keys, counts)
            keys, counts, held = [key], [n], len(key)
            if held > HELD_COUNTS // 2:
                yield batch(key, n)
                keys, counts, held = [], [], 0
    if keys:
        yield batch(*_added(keys, counts))


def vocabulary(texts: DataFrame) -> np.ndarray:
    """Sorted hashes of the words with a vector of their own; ``texts`` has one column."""
    n = texts.count()
    least = max(float(MIN_DOCS), n * MIN_SHARE)
    found = (texts.mapInArrow(_count_documents, "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))
             .where(F.col("df") >= least))
    found = materialize(found, "words")
    while found.where(F.col("df") >= least).count() > MAX_WORDS:
        least *= 2
    return np.sort(found.where(F.col("df") >= least).toArrow().column("token").to_numpy().view(np.uint64))


def word_codes(words: np.ndarray, key: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Each token's word: its place among ``words``, or after them the place of its shape."""
    if not len(words):
        return shape
    at = np.minimum(np.searchsorted(words, key), len(words) - 1)
    return np.where(words[at] == key, at, len(words) + shape)


def context_sums(words: np.ndarray, column, sums: np.ndarray) -> None:
    """Adds to ``sums`` (words and shapes, DIM) the index vectors of each token's neighbours."""
    key, shape, row = tokens(column)
    code = word_codes(words, key, shape)
    flat = sums.reshape(-1)
    for j in range(ONES):
        mixed = T.mix64(key + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        place = (mixed % np.uint64(DIM)).astype(np.int64)
        sign = np.where(mixed >> np.uint64(63), 1, -1).astype(sums.dtype)
        for step in range(1, WINDOW + 1):
            near = np.flatnonzero(row[step:] == row[:-step])
            np.add.at(flat, code[near] * DIM + place[near + step], sign[near + step])
            np.add.at(flat, code[near + step] * DIM + place[near], sign[near])


def _context_batches(shared, batches):
    """(block, sums) of a task's documents, sums compressed."""
    words = shared.value
    sums = np.zeros((-(-(len(words) + SHAPES) // WORD_BLOCK) * WORD_BLOCK, DIM), np.int32)
    held = 0
    blocks = sums.reshape(-1, WORD_BLOCK, DIM)

    def handed_on():
        used = np.flatnonzero(blocks.any(axis=(1, 2)))
        for at in range(0, len(used), 256):
            some = used[at:at + 256]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([zlib.compress(blocks[i].tobytes(), 1) for i in some], pa.binary())],
                names=["block", "sums"])

    for piece in _pieces(batches):
        context_sums(words, piece.column(0), sums)
        held += piece.num_rows
        if np.abs(sums[-SHAPES:]).max(initial=0) > 1 << 30 or held > 1 << 24:   # far from where 32 bits end
            yield from handed_on()
            sums[:], held = 0, 0
    yield from handed_on()


def _sum_blocks(batches):
    sums = {}
    for b in batches:
        for block, raw in zip(b.column(0).to_pylist(), b.column(1)):
            part = np.frombuffer(zlib.decompress(raw.as_buffer()), np.int32)
            if block in sums:
                sums[block] += part
            else:
                sums[block] = part.astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
                                     names=["block", "sums"])


@dataclass
class WordVectors:
    """Sorted hashes of the words, and a vector of length 1 (or 0) for each word and shape."""
    words: np.ndarray
    vectors: np.ndarray

    def pooled(self, column) -> np.ndarray:
        """(rows, 2 DIM + 1): mean and deviation of the token vectors and the logarithm of 1 + their number."""
        key, shape, row = tokens(column)
        code, n = word_codes(self.words, key, shape), np.bincount(row, minlength=len(column))
        total = np.zeros((len(column), 2 * DIM))
        for at in range(0, len(code), TOKENS_AT_ONCE):
            x = self.vectors[code[at:at + TOKENS_AT_ONCE]].astype(np.float64)
            here = row[at:at + TOKENS_AT_ONCE]
            first = np.flatnonzero(np.concatenate(([True], here[1:] != here[:-1])))
            total[here[first], :DIM] += np.add.reduceat(x, first, axis=0)
            total[here[first], DIM:] += np.add.reduceat(x * x, first, axis=0)
        total /= np.maximum(n, 1)[:, None]
        mean = total[:, :DIM]
        spread = np.sqrt(np.maximum(total[:, DIM:] - mean * mean, 0))
        return np.hstack((mean, spread, np.log1p(n)[:, None]))


def fit_vectors(docs: DataFrame, text: str = "text") -> WordVectors:
    """Random-indexing vectors of the words of all documents."""
    context = docs.sparkSession.sparkContext
    T.bound_batches(docs.sparkSession)
    texts = docs.select(F.col(text).cast("string").alias("text"))
    words = vocabulary(texts)
    shared = context.broadcast(words)
    parts = texts.mapInArrow(lambda it: _context_batches(shared, it), "block int, sums binary")
    summed = materialize(parts.repartition("block").mapInArrow(_sum_blocks, "block int, sums binary"), "vectors").toArrow()
    vectors = np.zeros((-(-(len(words) + SHAPES) // WORD_BLOCK), WORD_BLOCK * DIM), np.float32)
    for block, raw in zip(summed.column("block").to_pylist(), summed.column("sums")):
        vectors[block] = np.frombuffer(raw.as_buffer(), np.int64)
    vectors = vectors.reshape(-1, DIM)[:len(words) + SHAPES]
    norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return WordVectors(words, (vectors / np.maximum(norm, 1e-12)).astype(np.float32))


# ---------------------------------------------------------------- the network

def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


@dataclass
class Network:
    """Standardised input, one hidden layer of tanh units, a logistic output divided by a temperature."""
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.centre) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(x) / self.temperature)


def _gradient(net: Network, z: np.ndarray, y: np.ndarray):
    """Gradients of the mean cross-entropy at temperature 1, in the order w1, b1, w2, b2; ``z`` is standardised."""
    h = np.tanh(z @ net.w1 + net.b1)
    d = (_sigmoid(h @ net.w2 + net.b2) - y) / len(y)
    back = d[:, None] * net.w2 * (1 - h * h)
    return z.T @ back, back.sum(axis=0), h.T @ d, d.sum()


def best_temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The temperature between 1/20 and 20 with the least cross-entropy, by bisection on its slope in 1 / T."""
    lo, hi = 1 / 20, 20.0                       # of 1 / T, in which the cross-entropy is convex
    for _ in range(60):
        mid = (lo * hi) ** 0.5
        if ((_sigmoid(mid * logit) - y) * logit).sum() > 0:
            hi = mid
        else:
            lo = mid
    return 1 / (lo * hi) ** 0.5


def fit_network(x: np.ndarray, y: np.ndarray, held: np.ndarray, seed: int = 7) -> Network:
    """Weights by Adam on the rows that are not ``held``, the temperature on those that are.

    Without rows every score is 0.5; with one class only, or without held
    rows, the temperature stays 1.
    """
    rng = np.random.default_rng(seed)
    tx, ty = x[~held], y[~held]
    if not len(tx):
        d = x.shape[1]
        return Network(np.zeros(d), np.ones(d), np.zeros((d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    deviation = tx.std(axis=0)
    prior = np.clip(ty.mean(), 0.5 / len(ty), 1 - 0.5 / len(ty))
    net = Network(tx.mean(axis=0), np.where(deviation > 1e-9, deviation, 1.0),
                  rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, 0.1 / np.sqrt(HIDDEN), HIDDEN), float(np.log(prior / (1 - prior))))
    z = (tx - net.centre) / net.scale
    names = ("w1", "b1", "w2", "b2")
    first, second = ({k: np.zeros_like(getattr(net, k), dtype=float) for k in names} for _ in range(2))
    t = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(z))
        for at in range(0, len(z), BATCH):
            some = order[at:at + BATCH]
            t += 1
            for k, g in zip(names, _gradient(net, z[some], ty[some])):
                if k in ("w1", "w2"):
                    g = g + DECAY * getattr(net, k)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                step = RATE * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)
                setattr(net, k, getattr(net, k) - step)
    if held.any() and len(np.unique(y[held])) == 2:
        net.temperature = best_temperature(net.logit(x[held]), y[held])
    return net


# ---------------------------------------------------------------- the jobs

def _pool_batches(shared, batches):
    """text, id, label, held to features, id, label, held."""
    vectors = shared.value
    for piece in _pieces(batches):
        x = vectors.pooled(piece.column(0))
        yield pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())), *piece.columns[1:]],
            names=["x", "id", "label", "held"])


def _score_batches(shared, names, at, batches):
    vectors, net = shared.value
    for piece in _pieces(batches, at):
        s = np.round(net.score(vectors.pooled(piece.column(at))), 9)      # below, matrix products vary with the batch
        yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                                         names=[*names, "score", "predicted"])


def fit_quality(docs: DataFrame, labels: DataFrame, vectors: WordVectors, text: str = "text", id_col: str = "doc_id",
                label: str = "quality") -> Network:
    """The network of documents with a label 0 or 1 (``labels`` has a row an id); other labels and null ids are left out.

    At most ``TRAIN_ROWS`` ids, by the smallest hash, are learnt from; an id with both labels counts with both,
    an id of several documents with one of them.
    """
    context = docs.sparkSession.sparkContext
    named = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    named = named.where("id is not null and label in (0, 1)").distinct()
    chosen = named.withColumn("h", F.xxhash64("id")).orderBy("h", "id", "label").limit(TRAIN_ROWS)
    chosen = materialize(chosen.select("id", "label", (F.pmod("h", F.lit(HOLD)) == 0).alias("held")), "labelled")
    shared = context.broadcast(vectors)
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"))
    rows = rows.join(F.broadcast(chosen), "id").select("text", "id", "label", "held")     # TRAIN_ROWS rows
    pooled = rows.mapInArrow(lambda it: _pool_batches(shared, it), "x array<double>, id long, label int, held boolean")
    table = pooled.groupBy("id", "label", "held").agg(F.min("x").alias("x")).orderBy("id", "label").toArrow()
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, 2 * DIM + 1)
    return fit_network(x, table.column("label").to_numpy().astype(float), table.column("held").to_numpy())


def score_quality(docs: DataFrame, vectors: WordVectors, net: Network, text: str = "text") -> DataFrame:
    """``docs`` with score (that the quality label is 1) and predicted (1 from ``THRESHOLD`` on).

    Only the text is read: a null or empty one is pooled to zeros. Equal texts
    have equal scores; repeated rows stay; columns of ``docs`` named like the
    results are replaced; an empty table stays empty.
    """
    T.bound_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in ("score", "predicted") if c != text])
    names = docs.columns
    docs = docs.withColumn("_text", F.col(text).cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))
    schema = ST.StructType([*docs.schema.fields, ST.StructField("score", ST.DoubleType()),
                            ST.StructField("predicted", ST.IntegerType())])
    columns = docs.columns
    scored = docs.mapInArrow(lambda it: _score_batches(shared, columns, len(columns) - 1, it), schema)
    return scored.select(*names, "score", "predicted")
