"""Masked pseudo-likelihood of documents under a bidirectional window network.

Words are white-space-separated, lower-cased (A-Z) and known by a 64-bit hash.
All are counted over the whole corpus, in a Spark table with a row a word. The
network predicts words: with T words of text it has C = ``SIDE`` * T**(1/6)
classes of C words, the C * C most frequent ones, dealt out by frequency, so
its vocabulary grows with the corpus. A word's probability given the two words
before and the two after it is

    P(class | neighbours) * P(word | class, neighbours),

two softmaxes over one hidden layer. A class has one more member, which stands
for all rarer words whose hash belongs to the class; they share its
probability as their counts stand: (count + ADD) / (their sum + ADD * (their
number + 1)); an unseen word has count 0. The neighbours enter as embeddings:
the most frequent words have their own, the others share some by hash. The
masked word is never an input. The sum of the words' log-probabilities scores
a document.

Counts of the ``KNOWN`` * C * C most frequent words go to the tasks with the
vocabulary; scoring lists a document's other words, which are joined with the
table of counts. Both sides of that join are shuffled by word; no frequent
word is among them.

Training goes over all windows of all documents: round r takes every
``ROUNDS``-th window from the r-th on; each task runs Adam on its own rows
from the round's common start, and the tasks' weights are averaged, weighted
by their windows, chunk by chunk in Spark. At most ``TASKS`` tasks train, so
weights shuffled are bounded by TASKS times the network.

Defined results: null, empty or blank text has no words, log-likelihood 0 and
null mean; repeated rows count as often as they occur; words of equal count
are ordered by hash; in an empty corpus every word is unseen; an empty table
gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import materialize
from . import textops as T
from .ordering import global_rank

SIDE = 3.0                # classes, and words of a class, for one word of text
KNOWN = 16                # words with their counts in the tasks, for each word of the network
REACH = 2
EMBED = 12
HIDDEN = 24
ROUNDS = 2
BATCH = 4096
TILE = 32                 # rows of one class that are multiplied together
RATE = 0.01
TASKS = 4096
CHUNK = 1 << 12           # weights in a row
ADD = 0.5
FIXED = float(1 << 20)
SEED = 11
_OFFSETS = [o for o in range(-REACH, REACH + 1) if o]


def _words(column):
    """(hash, document) of every word of an Arrow column."""
    with np.errstate(over="ignore"):
        data, off = T.utf8(column)
        starts, ends, doc = T.word_bounds(data, off)
        return T.word_hashes(T.lower_ascii(data), starts, ends), doc


def _count_batches(batches):
    for b in batches:
        for lo, hi in T.slices(b.column(0)):
            word, n = np.unique(_words(b.column(0).slice(lo, hi - lo))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n, pa.int64())], names=["word", "n"])


class Vocabulary:
    """The known words by falling count, and what a rarer word shares.

    ``words`` and ``counts``: the known words; the first ``side`` ** 2 are the
    network's. ``rest`` and ``kinds``: for each class the count and the number
    of all its rarer words.
    """

    def __init__(self, side: int, words: np.ndarray, counts: np.ndarray, rest: np.ndarray, kinds: np.ndarray):
        self.side, self.words, self.counts, self.rest, self.kinds = side, words, counts, rest, kinds
        self.own = max(1, side * 3 // 4)          # words with an embedding of their own
        self.index = None

    def __getstate__(self):
        return self.__dict__ | {"index": None}

    def _build(self) -> None:
        order = np.argsort(self.words)
        self.sorted, self.order = self.words[order], order
        self.shift = np.uint64(64 - max(1, (4 * len(order)).bit_length()))
        prefix = (self.sorted >> self.shift).astype(np.int64)
        held = np.bincount(prefix, minlength=1 << (64 - int(self.shift)))
        self.index = np.concatenate(([0], np.cumsum(held)[:-1])).astype(np.int32)
        self.longest = int(held.max()) if len(order) else 0

    def rank(self, h: np.ndarray) -> np.ndarray:
        """Place by falling count, -1 for a word that is not known."""
        if self.index is None:
            self._build()
        at = np.full(len(h), -1, np.int64)
        if not len(self.sorted):
            return at
        first = self.index[(h >> self.shift).astype(np.int64)]
        for i in range(self.longest):
            j = np.minimum(first + i, len(self.sorted) - 1)
            same = self.sorted[j] == h
            at[same] = self.order[j[same]]
        return at

    def codes(self, h: np.ndarray):
        """(input, class, member, rank) of words."""
        rank, side = self.rank(h), self.side
        rare = (rank < 0) | (rank >= side * side)
        klass = np.where(rare, h.view(np.int64) % side, rank % side)
        member = np.where(rare, side, rank // side)
        spread = self.own + (h >> np.uint64(32)).astype(np.int64) % (side - self.own)
        return np.where((rank >= 0) & (rank < self.own), rank, spread), klass, member, rank

    def share(self, klass: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log of a rarer word's share of its class's last member."""
        return np.log((counts + ADD) / (self.rest[klass] + ADD * (self.kinds[klass] + 1)))

    def start(self) -> Network:
        """A network that predicts words by their counts alone."""
        side, net = self.side, Network(self.side)
        n = np.zeros((side, side + 1))
        n[:, side] = self.rest
        rank = np.arange(min(len(self.words), side * side))
        n[rank % side, rank // side] = self.counts[rank]
        n += ADD
        net.b2[:] = np.log(n.sum(axis=1) / n.sum())
        net.b3[:] = np.log(n / n.sum(axis=1, keepdims=True))
        return net


def contexts(code: np.ndarray, doc: np.ndarray, edge: int) -> np.ndarray:
    """(words, 2 * REACH) codes of the neighbours; beyond a document's ends, ``edge``."""
    n = len(code)
    at = np.arange(n) + REACH * (doc + 1)
    padded = np.full(n + REACH * (int(doc[-1]) + 2 if n else 1), edge, np.int64)
    padded[at] = code
    return padded[at[:, None] + np.array(_OFFSETS)]


def _exponentials(z: np.ndarray, reach: float):
    """(exp(z) in place of z, their sums, what was taken off first); ``reach``: all values lie within it."""
    off = z.max(axis=-1, keepdims=True) if reach > 60 else np.float32(0)
    if reach > 60:
        z -= off
    np.exp(z, out=z)
    return z, (z.reshape(-1, z.shape[-1]) @ np.ones(z.shape[-1], z.dtype)).reshape(*z.shape[:-1], 1), off


def _sums(values: np.ndarray, code: np.ndarray, codes: int) -> np.ndarray:
    """The sum of the rows of ``values`` of each code."""
    order = np.argsort(code.astype(np.uint16), kind="stable")
    upto = np.zeros((len(code) + 1, values.shape[1]))
    np.cumsum(values[order], axis=0, dtype=np.float64, out=upto[1:])
    ends = np.cumsum(np.bincount(code, minlength=codes))
    return np.diff(upto[ends], axis=0, prepend=0).astype(np.float32)


class Network:
    """Weights as one flat vector with named parts."""

    def __init__(self, side: int, flat: np.ndarray | None = None):
        self.side = side
        shapes = (("embed", (side + 1, EMBED)), ("w1", (2 * REACH * EMBED, HIDDEN)), ("b1", (HIDDEN,)),
                  ("w2", (HIDDEN, side)), ("b2", (side,)), ("w3", (side, HIDDEN, side + 1)), ("b3", (side, side + 1)))
        if flat is None:
            flat = np.random.default_rng(SEED).standard_normal(sum(math.prod(s) for _, s in shapes)) * 0.1
        self.flat = flat.astype(np.float32)
        at = 0
        for name, shape in shapes:
            size = math.prod(shape)
            setattr(self, name, self.flat[at:at + size].reshape(shape))
            at += size

    def _hidden(self, x: np.ndarray):
        e = self.embed[x].reshape(len(x), -1)
        return e, np.tanh(e @ self.w1 + self.b1)

    def _tiles(self, klass: np.ndarray):
        """(class of each tile, tile and row in it of each word): a tile has TILE words of one class at most."""
        order = np.argsort(klass.astype(np.uint16), kind="stable")
        n = np.bincount(klass, minlength=self.side)
        tiles = -(-n // TILE)
        within = np.arange(len(klass)) - np.repeat(np.cumsum(n) - n, n)
        tile, row = np.empty(len(klass), np.int64), np.empty(len(klass), np.int64)
        tile[order] = np.repeat(np.cumsum(tiles) - tiles, n) + within // TILE
        row[order] = within % TILE
        return np.repeat(np.arange(self.side), tiles), tile, row

    def _classes(self, h: np.ndarray):
        """The classes' logits and a bound of their size."""
        return h @ self.w2 + self.b2, float((np.abs(self.w2).sum(axis=0) + np.abs(self.b2)).max())

    def _members(self, h: np.ndarray, klass: np.ndarray):
        """The tiles, their hidden rows, their members' logits and a bound of their size."""
        of, tile, row = self._tiles(klass)
        rows = np.zeros((len(of), TILE, HIDDEN), np.float32)
        rows[tile, row] = h
        reach = float((np.abs(self.w3).sum(axis=1) + np.abs(self.b3)).max())
        z = rows @ self.w3[of]
        z += self.b3[of][:, None, :]
        return of, tile, row, rows, z, reach

    def log_probability(self, x: np.ndarray, klass: np.ndarray, member: np.ndarray) -> np.ndarray:
        """Of ``member`` of ``klass`` given contexts ``x``."""
        one_row = np.arange(len(x))
        _, h = self._hidden(x)
        z, reach = self._classes(h)
        value = z[one_row, klass]
        _, total, off = _exponentials(z, reach)
        value -= (np.log(total) + off)[:, 0]
        _, tile, row, _, z, reach = self._members(h, klass)
        value += z[tile, row, member]
        _, total, off = _exponentials(z, reach)
        return value - (np.log(total) + off)[tile, row, 0]

    def gradient(self, x: np.ndarray, klass: np.ndarray, member: np.ndarray) -> np.ndarray:
        """Of the mean log-loss given contexts ``x``, as a flat vector."""
        n = len(x)
        e, h = self._hidden(x)
        d, total, _ = _exponentials(*self._classes(h))
        d *= 1 / (n * total)
        d[np.arange(n), klass] -= 1 / n
        of, tile, row, rows, z, reach = self._members(h, klass)
        inner, total, _ = _exponentials(z, reach)
        told = np.zeros(total.shape, np.float32)
        told[tile, row] = 1 / n
        inner *= told / total
        inner[tile, row, member] -= 1 / n
        w3, b3, back = np.zeros_like(self.w3), np.zeros_like(self.b3), np.empty_like(rows)
        begin = np.searchsorted(of, np.arange(self.side + 1))
        for c in np.unique(of):                        # a class's tiles lie side by side
            part = slice(begin[c], begin[c + 1])
            x3, d3 = rows[part].reshape(-1, HIDDEN), inner[part].reshape(-1, self.side + 1)
            w3[c], b3[c] = x3.T @ d3, d3.sum(axis=0)
            back[part] = (d3 @ self.w3[c].T).reshape(-1, TILE, HIDDEN)
        dh = (d @ self.w2.T + back[tile, row]) * (1 - h * h)
        de = (dh @ self.w1.T).reshape(n * 2 * REACH, EMBED)
        return np.concatenate([_sums(de, x.ravel(), self.side + 1).ravel(), (e.T @ dh).ravel(), dh.sum(axis=0), (h.T @ d).ravel(),
                               d.sum(axis=0), w3.ravel(), b3.ravel()])


class Adam:
    def __init__(self, size: int):
        self.m, self.v, self.t = np.zeros(size, np.float32), np.zeros(size, np.float32), 0

    def step(self, net: Network, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        net.flat -= RATE * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.999 ** self.t)) + 1e-6)


def _train_batches(shared, turn, batches):
    vocabulary, start = shared.value
    net, seen = Network(vocabulary.side, start.copy()), 0
    adam, held, n = Adam(len(net.flat)), [], 0
    for b in batches:
        for lo, hi in T.slices(b.column(0)):
            word, doc = _words(b.column(0).slice(lo, hi - lo))
            if not len(word):
                continue
            code, klass, member, _ = vocabulary.codes(word)
            x = contexts(code, doc, vocabulary.side)
            held.append([a[turn::ROUNDS] for a in (x, klass, member)])
            n += len(held[-1][1])
            if n >= BATCH:
                parts = [np.concatenate(p) for p in zip(*held)]
                full = n // BATCH * BATCH
                for i in range(0, full, BATCH):
                    adam.step(net, net.gradient(*(p[i:i + BATCH] for p in parts)))
                seen, n, held = seen + full, n - full, [[p[full:] for p in parts]]
    if n:
        adam.step(net, net.gradient(*(np.concatenate(p) for p in zip(*held))))
        seen += n
    if seen:
        parts = [net.flat[i:i + CHUNK].tobytes() for i in range(0, len(net.flat), CHUNK)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(parts)), pa.int32()), pa.array(np.full(len(parts), seen), pa.int64()),
             pa.array(parts, pa.binary())], names=["chunk", "windows", "weights"])


def _average(key, table):
    """One chunk's mean over the tasks, added up in an order of its own."""
    rows = sorted(zip(table.column("windows").to_pylist(), table.column("weights").to_pylist()))
    total, windows = 0.0, sum(w for w, _ in rows)
    for w, v in rows:
        total = total + np.frombuffer(v, np.float32).astype(np.float64) * (w / windows)
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())],
                    names=["chunk", "weights"])


def count_words(texts: DataFrame) -> DataFrame:
    """word (64-bit hash) and n of all words of column ``text``, written."""
    rows = texts.mapInArrow(_count_batches, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(rows, "words")


def build_vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.sum("n")).first()[0] or 0
    side = max(4, math.ceil(SIDE * total ** (1 / 6)))
    # words of at least 2**e occurrences, for the greatest e that leaves enough of them
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).agg(F.count(F.lit(1)).alias("words")).collect()
    least, held = 0, 0
    for r in sorted(sizes, key=lambda r: -r["e"]):
        least, held = r["e"], held + r["words"]
        if held >= KNOWN * side * side:
            break
    top = counts.where(F.col("n") >= 1 << least).withColumn("less", -F.col("n"))
    top = global_rank(top, ["less", "word"], "rank").where(F.col("rank") < KNOWN * side * side).select("rank", "word", "n").toArrow()
    top = top.sort_by("rank")
    words, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    rest, kinds = np.zeros(side), np.zeros(side)
    by = counts.groupBy(F.pmod("word", F.lit(side)).alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect()
    for r in by:
        rest[r["c"]], kinds[r["c"]] = r["n"], r["k"]
    inside = slice(0, side * side)
    klass = words[inside].view(np.int64) % side
    rest -= np.bincount(klass, n[inside], side)
    kinds -= np.bincount(klass, minlength=side)
    return Vocabulary(side, words, n.astype(np.float64), rest, kinds)


def train(df: DataFrame, text_col: str = "text") -> tuple[Vocabulary, Network, DataFrame]:
    """Vocabulary, network and word counts from all rows of ``df``."""
    spark = df.sparkSession
    T.bound_batches(spark)
    texts = df.select(F.col(text_col).cast("string").alias("text"))
    counts = count_words(texts)
    vocabulary = build_vocabulary(counts)
    net = vocabulary.start()
    few = texts.coalesce(TASKS)
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((vocabulary, net.flat))
        mean = (few.mapInArrow(lambda it, s=shared, t=turn: _train_batches(s, t, it), "chunk int, windows long, weights binary")
                .groupBy("chunk").applyInArrow(_average, "chunk int, weights binary").toArrow())   # the network
        if mean.num_rows:
            flat = b"".join(mean.sort_by("chunk").column("weights").to_pylist())
            net = Network(vocabulary.side, np.frombuffer(flat, np.float32))
    return vocabulary, net, counts


def log_likelihoods(vocabulary: Vocabulary, net: Network, column):
    """(words, summed log-probability, unknown words, their documents) of every text of an Arrow column.

    An unknown word's count, of which the logarithm is still to be added, is in the table of counts.
    """
    word, doc = _words(column)
    code, klass, member, rank = vocabulary.codes(word)
    x = contexts(code, doc, vocabulary.side)
    value = np.zeros(len(word))
    for i in range(0, len(word), BATCH):
        part = slice(i, i + BATCH)
        value[part] = net.log_probability(x[part], klass[part], member[part])
    rare = np.flatnonzero(member == vocabulary.side)
    known = rare[rank[rare] >= 0]
    value[known] += vocabulary.share(klass[known], vocabulary.counts[rank[known]])
    unknown = rare[rank[rare] < 0]
    value[unknown] += vocabulary.share(klass[unknown], 1 - ADD)
    n = np.bincount(doc, minlength=len(column))
    return n, np.bincount(doc, value, len(column)), word[unknown], doc[unknown]


def _score_batches(shared, batches):
    vocabulary, flat = shared.value
    net = Network(vocabulary.side, flat)
    for b in batches:
        for lo, hi in T.slices(b.column(1)):
            part = b.slice(lo, hi - lo)
            n, total, word, doc = log_likelihoods(vocabulary, net, part.column(1))
            ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=hi - lo))))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(total, pa.float64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(word.view(np.int64)))],
                names=["id", "n_words", "known", "words"])


def score(df: DataFrame, model: tuple[Vocabulary, Network, DataFrame], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_words, log_likelihood and mean_log_likelihood of every row."""
    vocabulary, net, counts = model
    T.bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((vocabulary, net.flat))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = (rows.mapInArrow(lambda it: _score_batches(shared, it), f"id {kind}, n_words long, known double, words array<long>")
            .withColumn("row", F.monotonically_increasing_id()))
    rows = materialize(rows, "scored")               # the row numbers are fixed by now
    asked = rows.select("row", F.explode("words").alias("word"))
    # logarithms in fixed point, so that their sum has no order
    more = F.round(F.log(F.coalesce(F.col("n"), F.lit(0)) + F.lit(ADD)) * F.lit(FIXED)).cast("long")
    found = asked.join(counts, "word", "left").groupBy("row").agg(F.sum(more).alias("more"))
    total = F.round(F.col("known") + F.coalesce(F.col("more"), F.lit(0)) / F.lit(FIXED), 4) + F.lit(0.0)
    out = rows.drop("words").join(found, "row", "left").withColumn("log_likelihood", total)
    return out.select(F.col("id").alias(id_col), "n_words", "log_likelihood",
                      F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")).alias("mean_log_likelihood"))
