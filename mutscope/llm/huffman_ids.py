"""Token ids in canonical, length-limited Huffman code, in independent blocks.

The format is a folder of Parquet tables, so that Spark commits each task's
files as a whole and reads them from any store:

* ``codebook``: id, length. Codes are canonical: shorter first, then by id.
* ``blocks``: a row for each block of whole documents (``BLOCK_IDS`` ids or
  more): shard, at (ids of the shard before the block), doc_ids and counts
  (a directory of its documents), bits (the codes, most significant bit
  first, zero bits at the end) and checkpoints (bit offset of every
  ``CHECKPOINT``-th id). Shards are ranges of the document id, ascending.

Any checkpoint can be decoded without what comes before it; the decoder runs
through all checkpoints of some blocks in step, one table look-up an id.

Documents come in ascending id, null first, then by a hash of the text.
Defined results: a null text is encoded as the empty one, which is the end id
alone; repeated rows are encoded each; an empty table gives an empty folder
of blocks and no rows.
"""

from __future__ import annotations

import itertools
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..util import bounded_broadcast, materialize
from . import textops as T

END_ID = 2
LIMIT = 16                # longest code, in bits
BLOCK_IDS = 1 << 16
CHECKPOINT = 256
STEP_IDS = 1 << 20        # ids decoded at a time
CACHE_WORDS = 700_000     # pieces of words that a worker keeps

# Fixed values of the public tokenizer file: its split pattern.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class _Numbers(dict):
    """Numbers new keys in turn and notes them."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class _Ragged:
    """Arrays of different lengths, one after another."""

    def __init__(self):
        self.flat, self.off = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = np.concatenate((self.flat, flat.astype(np.int32)))
        self.off = np.concatenate((self.off, self.off[-1] + np.cumsum(sizes)))

    def take(self, at: np.ndarray):
        """(items of the arrays ``at``, where each begins)."""
        size = self.off[at + 1] - self.off[at]
        total = np.concatenate(([0], np.cumsum(size)))
        return self.flat[np.repeat(self.off[at] - total[:-1], size) + np.arange(total[-1])], total


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """(letter 1, number 2 or other 0 for each ASCII byte; the same for the letters of two bytes from U+0080 to U+00FF)."""
    kind = [1 if chr(c).isalpha() else 2 if unicodedata.category(chr(c))[0] == "N" else 0 for c in range(256)]
    return np.array(kind[:128] + [0] * 128, np.int8), np.array(kind[128:], np.int8)


_KIND, _KIND_TWO = _kinds()


class WordIds:
    """Ids of texts, those of each piece of a word found once and kept for later batches.

    The distinct white-space-separated words of a batch are split together.
    Words of Latin-1 letters are split by the tokenizer's pattern, in numpy
    where no contraction is possible, and new pieces go to the library's model
    together; other words, and those that may hold a special token, go through
    the whole library tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = dict(enumerate(_byte_letters())) | {32: " "}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)        # ids that end a piece
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.reset()

    def reset(self) -> None:
        self.pieces, self.piece_ids = _Numbers(), _Ragged()

    def _numbered(self, pieces) -> np.ndarray:
        return np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces))

    @staticmethod
    def _split(word: str) -> list[str]:
        """The pieces of a word that is not split in numpy."""
        try:
            word.encode("latin-1")
        except UnicodeEncodeError:
            return ["\x1c" + word]
        return ["\x1c" + word] if "<|" in word else _PIECES.findall(word.lower())

    def _split_all(self, words: pa.Array):
        """(numbers of the pieces, how many each word has)."""
        raw, off = T.utf8(words)
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        low, kind = T.lower_ascii(raw).copy(), _KIND[raw]
        lead = np.flatnonzero((raw == 0xC2) | (raw == 0xC3))
        kind[lead] = kind[lead + 1] = _KIND_TWO[(raw[lead] - 0xC2) * 64 + (raw[lead + 1] & 0x3F)]
        capital = lead[(raw[lead] == 0xC3) & (raw[lead + 1] <= 0x9E) & (raw[lead + 1] != 0x97)] + 1
        low[capital] += 0x20
        start = np.ones(len(raw), bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        start[off[:-1][off[:-1] < len(raw)]] = True
        start &= (raw & 0xC0) != 0x80
        starts = np.flatnonzero(start)
        size = np.diff(np.searchsorted(starts, off))
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw)).astype(np.int64)), pa.py_buffer(low))
        slow = (raw >= 0xC4) | (raw == 0x27)
        slow[:-1] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)
        slow = np.unique(np.searchsorted(off, np.flatnonzero(slow), "right") - 1)
        owner = np.repeat(np.arange(len(words)), size)
        if len(slow):
            quick = np.ones(len(words), bool)
            quick[slow] = False
            pieces, owner = pieces.filter(pa.array(quick[owner])), owner[quick[owner]]
        coded = pieces.dictionary_encode()
        at = self._numbered(coded.dictionary.to_numpy(zero_copy_only=False))[coded.indices.to_numpy()]
        if len(slow):
            split = [self._split(w) for w in words.take(pa.array(slow)).to_pylist()]
            size[slow] = [len(x) for x in split]
            owner = np.concatenate((owner, np.repeat(slow, size[slow])))
            at = np.concatenate((at, self._numbered(list(itertools.chain.from_iterable(split)))))
            at = at[np.argsort(owner, kind="stable")]
        return at, size

    def _learn(self) -> None:
        """Ids of the pieces that were new."""
        new = self.pieces.new
        if not new:
            return
        plain = [p for p in new if p[0] != "\x1c"]
        ids = np.zeros(0, np.int64)
        if plain:
            joined = " ".join(plain).encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(plain):
            raise ValueError("the vocabulary does not mark where words end")
        size = np.diff(ends, prepend=0)
        if len(plain) != len(new):
            parts = iter(np.split(ids, ends[:-1]))
            found = [next(parts) if p[0] != "\x1c" else
                     np.array(self.tokenizer.encode(p[1:], add_special_tokens=False).ids, np.int64) for p in new]
            ids, size = np.concatenate(found), np.array([len(f) for f in found])
        self.piece_ids.add(ids, size)
        self.pieces.new = []

    def encode(self, texts):
        """(ids, count for each text), the ids without end ids; ``texts`` is a list or an Arrow column without nulls."""
        if len(self.pieces) > CACHE_WORDS:
            self.reset()
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string())
        raw, off = T.utf8(column)
        # white space to Python and Arrow only
        whole = np.unique(np.searchsorted(off, np.flatnonzero((raw >= 0x1C) & (raw <= 0x1F)), "right") - 1)
        apart = {int(i): np.array(self.tokenizer.encode(column[int(i)].as_py(), add_special_tokens=False).ids, np.int64) for i in whole}
        if apart:
            mask = np.zeros(len(column), bool)
            mask[whole] = True
            column = pc.if_else(pa.array(mask), pa.scalar("", pa.large_string()), column)
        # an empty word, as of a text without words, has no pieces
        words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(column))
        coded = words.flatten().dictionary_encode()
        at, size = self._split_all(coded.dictionary)
        self._learn()
        flat, total = self.piece_ids.take(at)
        word_ids = _Ragged()
        word_ids.add(flat, np.diff(total[np.concatenate(([0], np.cumsum(size)))]))
        ids, total = word_ids.take(coded.indices.to_numpy())
        n_words = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        bounds = total[np.concatenate(([0], np.cumsum(n_words)))]
        count = np.diff(bounds)
        if apart:
            parts = [apart[i] if i in apart else ids[bounds[i]:bounds[i + 1]] for i in range(len(column))]
            ids, count = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, count


_KEPT: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # Spark's tasks are the parallel ones
    if path not in _KEPT:
        _KEPT[path] = WordIds(path)
    return _KEPT[path]


def _binary(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value for each count of items of ``data``."""
    off = np.concatenate(([0], np.cumsum(counts))) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(off.astype(np.int32).tobytes()),
                                                             pa.py_buffer(data.tobytes())])


def _token_batches(path, kind, end_id, batches):
    words, shard, done = _word_ids(path), TaskContext.get().partitionId(), 0
    for b in batches:
        ids_col, col = b.column(0), b.column(1)
        for lo, hi in T.slices(col, T.BATCH_BYTES):
            ids, count = words.encode(T.null_free(col.slice(lo, hi - lo), ""))
            last = np.cumsum(count)
            ids = np.insert(ids, last, end_id).astype(kind)
            count = count + 1
            at = done + np.concatenate(([0], np.cumsum(count)[:-1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(hi - lo, shard, np.int32)), pa.array(at, pa.int64()), ids_col.slice(lo, hi - lo),
                 pa.array(count, pa.int64()), _binary(ids, count)], names=["shard", "at", "doc_id", "n", "ids"])
            done += int(count.sum())


def _numbers(column, kind) -> np.ndarray:
    """All items of a binary column, one value after another."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int32, len(arr) + 1, arr.offset * 4)
    return np.frombuffer(data.slice(int(off[0]), int(off[-1] - off[0])) if data else b"", kind)


def _count_batches(kind, batches):
    total = np.zeros(0, np.int64)
    for b in batches:
        n = np.bincount(_numbers(b.column(0), kind))
        if len(n) > len(total):
            n[:len(total)] += total
            total = n
        else:
            total[:len(n)] += n
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of a least-cost prefix code of at most ``limit`` bits (package-merge)."""
    n = len(counts)
    if n == 0:
        return np.zeros(0, np.int64)
    if n == 1:
        return np.ones(1, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols have no code of {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    is_leaf, row = [], leaves
    for _ in range(limit):
        is_leaf.append(np.ones(n, bool) if not is_leaf else leaf)
        pairs = row[:len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((leaves, pairs))
        by = np.argsort(both, kind="stable")
        row, leaf = both[by], by < n
    length = np.zeros(n, np.int64)
    take = 2 * n - 2
    for level in reversed(is_leaf):
        chosen = int(level[:take].sum())
        length[:chosen] += 1
        take = 2 * (min(take, len(level)) - chosen)
    out = np.zeros(n, np.int64)
    out[order] = length
    return out


class Codebook:
    """Canonical codes of the ids that occur."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order], lengths[order]
        size = int(ids.max()) + 1 if len(ids) else 0
        self.length, self.code = np.zeros(size, np.int64), np.zeros(size, np.uint64)
        self.longest = int(lengths.max()) if len(ids) else 1
        # canonical codes, left-aligned, are running sums of 2 ** (longest - length)
        width = np.int64(1) << (self.longest - lengths)
        first = np.cumsum(width) - width
        self.length[ids] = lengths
        self.code[ids] = (first >> (self.longest - lengths)).astype(np.uint64)
        kind = np.uint32 if self.longest <= 17 else np.uint64
        self.table = np.zeros(1 << self.longest, kind)
        entry = (ids.astype(kind) << kind(6)) | lengths.astype(kind)
        self.table[:int(width.sum())] = np.repeat(entry, width)

    def pack(self, ids: np.ndarray):
        """(bytes, bit offset of every CHECKPOINT-th id)."""
        length = self.length[ids]
        end = np.cumsum(length)
        start = end - length
        word, shift = start >> 5, (64 - (start & 31) - length).astype(np.uint64)
        code = self.code[ids] << shift
        n = int(end[-1] >> 5) + 2 if len(ids) else 1
        out = np.bincount(word, (code >> np.uint64(32)).astype(np.float64), n)
        out += np.bincount(word + 1, (code & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        total = int(end[-1]) if len(ids) else 0
        return out.astype(">u4").tobytes()[:(total + 7) // 8], start[::CHECKPOINT]

    def unpack(self, payloads: list[bytes], checkpoints: list[np.ndarray], counts: list[int]) -> np.ndarray:
        """The ids of some blocks, one block after another."""
        base, joined, at = [], [], 0
        for p in payloads:
            base.append(at * 8)
            joined += [p, b"\0" * 8]
            at += len(p) + 8
        # each byte with the bytes after it: enough for the longest code from any bit of it
        kind, n_bytes = (np.uint32, 3) if self.longest <= 17 else (np.uint64, 5)
        data = np.frombuffer(b"".join(joined), np.uint8).astype(kind)
        window = np.zeros(len(data) - n_bytes + 1, kind)
        for i in range(n_bytes):
            window = (window << kind(8)) | data[i:len(window) + i]
        pos = np.concatenate([c + b for c, b in zip(checkpoints, base)]).astype(np.int64)
        last = (len(window) - 1) * 8
        mask, top = kind((1 << self.longest) - 1), 8 * n_bytes - self.longest
        out = np.empty((CHECKPOINT, len(pos)), kind)
        for i in range(CHECKPOINT):
            entry = self.table[(window[pos >> 3] >> (top - (pos & 7)).astype(kind)) & mask]
            out[i] = entry >> kind(6)
            pos += (entry & kind(63)).astype(np.int64)
            np.minimum(pos, last, out=pos)
        # the last checkpoint of a block may hold fewer ids
        full = np.full(len(pos), CHECKPOINT)
        ends = np.cumsum([len(c) for c in checkpoints]) - 1
        full[ends] = [n - (len(c) - 1) * CHECKPOINT for n, c in zip(counts, checkpoints)]
        return out.T[np.arange(CHECKPOINT) < full[:, None]]


BLOCK = "shard int, at long, doc_ids array<long>, counts array<long>, bits binary, checkpoints array<long>"


def _block(book, shard, at, docs, counts, ids):
    bits, marks = book.pack(ids.astype(np.int64))
    return (shard, at, docs, counts, bits, marks)


def _block_batches(shared, kind, block_ids, batches):
    book = shared.value
    schema = pa.schema([("shard", pa.int32()), ("at", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                        ("counts", pa.list_(pa.int64())), ("bits", pa.binary()), ("checkpoints", pa.list_(pa.int64()))])
    held: list[tuple] = []          # (shard, at, doc id, n, ids) of the block being filled
    size, due = 0, None

    def flush():
        ids = np.concatenate([h[4] for h in held])
        row = _block(book, held[0][0], held[0][1], [h[2] for h in held], [h[3] for h in held], ids)
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    for b in batches:
        shard, at, doc, n = (b.column(i).to_pylist() for i in range(4))
        off = np.concatenate(([0], np.cumsum(n)))
        ids = _numbers(b.column(4), kind)
        for i in range(len(n)):
            if held and (size >= block_ids or due != (shard[i], at[i])):
                yield flush()
                held, size = [], 0
            held.append((shard[i], at[i], doc[i], n[i], ids[off[i]:off[i + 1]]))
            size += n[i]
            due = (shard[i], at[i] + n[i])
    if held:
        yield flush()


def encode(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           end_id: int = END_ID, limit: int = LIMIT, block_ids: int = BLOCK_IDS) -> None:
    """Write all texts of ``docs`` as token ids to the folder ``path``."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    T.bound_batches(spark)
    kind = "<u2" if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # texts are dealt out once, by ranges of the id; from here on order is kept by (shard, at)
    rows = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    made = (rows.select("doc_id", "text")
            .mapInArrow(lambda it: _token_batches(tokenizer_path, kind, end_id, it),
                        "shard int, at long, doc_id long, n long, ids binary"))
    made = materialize(made, "ids", compression="zstd")
    counts = (made.select("ids").mapInArrow(lambda it: _count_batches(kind, it), "id long, n long")
              .groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toPandas())    # a row for each id of the vocabulary
    ids = counts["id"].to_numpy(np.int64)
    lengths = code_lengths(counts["n"].to_numpy(np.int64), limit)
    book = spark.sparkContext.broadcast(Codebook(ids, lengths))
    table = pa.table({"id": pa.array(ids, pa.int64()), "length": pa.array(lengths, pa.int64())})
    spark.createDataFrame(table, "id long, length long").coalesce(1).write.parquet(f"{path}/codebook")
    made.mapInArrow(lambda it: _block_batches(book, kind, block_ids, it), BLOCK).write.parquet(f"{path}/blocks")


def _decode_batches(shared, batches):
    book = shared.value
    for b in batches:
        cols = {n: b.column(n) for n in b.schema.names}
        counts = cols["counts"].to_pylist()
        sizes = [sum(c) for c in counts]
        lo = 0
        while lo < len(sizes):
            hi, total = lo, 0
            while hi < len(sizes) and (hi == lo or total + sizes[hi] <= STEP_IDS):
                total += sizes[hi]
                hi += 1
            part = range(lo, hi)
            ids = book.unpack([cols["bits"][i].as_py() for i in part],
                              [np.array(cols["checkpoints"][i].as_py(), np.int64) for i in part], sizes[lo:hi])
            n = np.concatenate([np.array(counts[i], np.int64) for i in part])
            first = np.concatenate([cols["start"][i].as_py() + np.cumsum([0, *counts[i][:-1]]) for i in part])
            docs = pa.concat_arrays([cols["doc_ids"].slice(i, 1).flatten() for i in part])
            yield pa.RecordBatch.from_arrays(
                [docs, pa.array(first, pa.int64()), pa.array(n, pa.int64()), _binary(ids.astype("<u4"), n)],
                names=["doc_id", "start", "n_tokens", "ids"])
            lo = hi


def decode(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids of every document.

    ids are little-endian unsigned 32-bit integers in one binary value.
    """
    T.bound_batches(spark)
    book = spark.read.parquet(f"{path}/codebook").toPandas()         # a row for each id of the vocabulary
    shared = spark.sparkContext.broadcast(Codebook(book["id"].to_numpy(np.int64), book["length"].to_numpy(np.int64)))
    blocks = spark.read.parquet(f"{path}/blocks")
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = blocks.groupBy("shard").agg(F.sum(size).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = blocks.join(bounded_broadcast(shards), "shard")
    return (placed.select((F.col("before") + F.col("at")).alias("start"), "doc_ids", "counts", "bits", "checkpoints")
            .mapInArrow(lambda it: _decode_batches(shared, it), "doc_id long, start long, n_tokens long, ids binary"))
