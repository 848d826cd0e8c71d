"""Quality classifier, divergence audit and ranked search against plain Python, numpy and SQL."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from mutscope.llm import indexed_quality as Q
from mutscope.llm import queries
from mutscope.llm import quadtree_audit as A
from mutscope.llm import rmq_search as R
from mutscope.llm import terms as W
from mutscope.llm import textops as T
from tests.conftest import SF01, SF001


def sql_rows(name, d):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return sorted(c.execute(queries.ORACLES[name]).fetchall())


def plain_terms(text, pattern):
    return re.findall(pattern, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LETTERS_DIGITS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ODD = ["", None, "A b", "a\x00B", "Ünï-Çöde ÀB", "1st 2nd", "日本語 text", "x", "  ", "é", "Zz[zz]zz{z}", "a" * 5000, "é\x7fé"]


def test_terms_match_the_patterns():
    for member, pattern in ((W.LETTERS, LETTERS), (W.LETTERS_DIGITS, LETTERS_DIGITS)):
        for texts in (ODD, ODD[::-1], ["ab", "cd"], [None, ""], []):
            code, row, words = W.term_codes(pa.array(texts, pa.string()), member)
            words = words.to_pylist()
            got = [[] for _ in texts]
            for c, r in zip(code, row):
                got[r].append(words[c])
            assert got == [plain_terms(t, pattern) for t in texts]


# ---------------------------------------------------------------- op12

def brute_audit(rows, min_docs, top):
    """rows of (text, lang, source)."""
    rows = [(plain_terms(t, LETTERS), lang or "", s or "") for t, lang, s in rows]
    out = []
    for lang in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == lang]
        df = Counter(t for r in mine for t in set(r[0]))
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        count = defaultdict(Counter)
        for words, _, s in mine:
            count[s].update(t for t in words if df[t] >= min_docs)
            count[None].update(t for t in words if df[t] >= min_docs)
        share = {s: [1 + 10**9 * (count[s][t] + 5) // (sum(count[s].values()) + 5 * len(kept)) for t in kept]
                 for s in {r[2] for r in mine} | {None}}
        sources = {r[2] for r in mine}
        for s in sources:
            pairs = [(sum(abs(x - y) for x, y in zip(share[s], share[o])), o) for o in sources - {s}]
            over = [(p - q, t) for p, q, t in zip(share[s], share[None], kept) if count[s][t] and p > q]
            for part, found, limit in (("pair", pairs, len(pairs)), ("term", over, top)):
                found.sort(key=lambda v: (-v[0], v[1].encode()))
                out += [(lang, s, part, o, v, i + 1) for i, (v, o) in enumerate(found[:limit])]
    return sorted(out)


def test_op12_query_matches_sql(spark):
    for d in (SF001, SF01):
        got = sorted(map(tuple, queries.op12_quadtree_audit(spark, d).collect()))
        assert got == sql_rows("op12_quadtree_audit", d) and len(got) > 100


@pytest.mark.parametrize("width,same", [(1, False), (31, True), (A.COLS, True), (777, False)])
def test_joint_traversal_prices_every_cell(width, same):
    rng = np.random.default_rng(width)

    def tile(n, share):
        p0 = rng.integers(1, 50, n)
        dense = np.repeat(p0[:, None], width, axis=1)
        hit = rng.random((n, width)) < share
        hit[:, width // 3: width // 2] = False                 # whole quadrants without a count
        dense[hit] = rng.integers(1, 10**9, hit.sum())
        row, col = np.nonzero(hit)
        return A.Tile(row, col, dense[hit], p0), dense

    a, da = tile(41, 0.05)
    b, db = (a, da) if same else tile(A.ROWS, 0.001)
    want = np.abs(da[:, None, :] - db[None, :, :]).sum(axis=2)
    got = A.joint_price(a, b, width, same)
    assert (np.triu(got) == np.triu(want)).all() if same else (got == want).all()


def test_op12_many_sources_and_columns(spark, monkeypatch):
    """Several row blocks (more than 128 sources) and a language without kept terms, against brute force."""
    rng = np.random.default_rng(3)
    words = [f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6]}" for i in range(500)]
    rows = [(" ".join(rng.choice(words[s % 7:s % 7 + 60], 12)), "xx", f"s{s}") for s in range(290)]
    rows += [("only here", "yy", "a"), ("nothing shared", "yy", "b"), ("", "yy", None)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    got = sorted(map(tuple, A.audit_sources(df, min_docs=3, top_terms=5).collect()))
    assert got == brute_audit(rows, 3, 5)


def test_op12_edges(spark):
    rows = [(None, None, None), ("", "", ""), ("A a ä", None, "s"), ("A a ä", None, "s"), ("a b b Ä", "", None),
            ("word " * 30000, "en", "long"), ("word", "en", "one"), ("x y", "en", "one"), ("lone", "de", "only")]
    extra = [(*r, 1, "t") for r in rows]
    df = spark.createDataFrame(extra, "text string, lang string, source string, value long, term string")
    for least in (1, 2):
        assert sorted(map(tuple, A.audit_sources(df, min_docs=least, top_terms=2).collect())) == brute_audit(rows, least, 2)
    empty = A.audit_sources(df.where("false"))
    assert empty.collect() == [] and empty.columns == ["lang", "source", "part", "item", "value", "rank"]


# ---------------------------------------------------------------- op13

def brute_rank(docs, items, k=10):
    """docs of (doc_id, text), items of (item_id, text)."""
    tf = [(i, Counter(plain_terms(t, LETTERS_DIGITS))) for i, t in docs]
    tf = [(i, c, sum(c.values())) for i, c in tf if c]
    n_docs, n_terms = len(tf), sum(n for _, _, n in tf)
    df = Counter(t for _, c, _ in tf for t in c)
    asked = defaultdict(Counter)
    for i, t in set(items):
        asked[i].update(plain_terms(t, LETTERS_DIGITS))
    out = []
    for item, want in asked.items():
        scores = []
        for i, c, n in tf:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t, r in want.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        scores.sort(key=lambda v: (v[0], v[1], v[2] or 0))
        out += [(item, n + 1, i, -s) for n, (s, _, i) in enumerate(scores[:k])]
    return sorted(out, key=str)


def test_op13_query_matches_sql(spark):
    for d in (SF001, SF01):
        got = sorted(map(tuple, queries.op13_rmq_search(spark, d).collect()))
        assert got == sql_rows("op13_rmq_search", d) and len(got) == 400


def test_range_maximum_tables():
    rng = np.random.default_rng(1)
    n, terms = 200, 6
    held = [(d, t) for d in range(n) for t in range(terms) if rng.random() < (t + 1) / terms]
    doc, term = np.array(held).T
    block = R.Block(rng.permutation(n) * 3, np.full(n, 50), doc, term, rng.integers(1, 9, len(doc)), np.full(terms, 1000), 1000, 50000)
    for t in range(terms):
        lo, hi = block.start[t], block.start[t + 1]
        for _ in range(50):
            s, e = sorted(rng.choice(np.arange(lo, hi + 1), 2, replace=False))
            top = block.greatest(np.array([s]), np.array([e]))[0]
            assert s <= top < e and block.impact[top] == block.impact[s:e].max()


def test_search_over_blocks_equals_scoring_all():
    """Best documents carried over blocks, many equal scores, ids out of order; far fewer documents scored than there are."""
    rng = np.random.default_rng(2)
    n, terms, k = 3000, 40, 7
    ids = rng.permutation(n) + 5
    tf = (rng.random((n, terms)) < 1 / (1 + np.arange(terms))) * rng.integers(1, 3, (n, terms))
    tf[1000:2000] = tf[0]                                      # a third are copies
    length = np.maximum(1, tf.sum(axis=1))
    df = (tf > 0).sum(axis=0)
    weight = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
    items = [(np.sort(rng.choice(terms, 6, replace=False)), rng.integers(1, 3, 6)) for _ in range(30)] + [
        (np.zeros(0, np.int64), np.zeros(0, np.int64))]
    m = 25 + 75 * length * n // length.sum()
    impact = weight * (10**9 * tf // (1000 * tf + 8 * m[:, None]))
    best, scored = R.Best(len(items), k), 0
    for at in range(0, n, 700):
        part = slice(at, at + 700)
        doc, term = np.nonzero(tf[part])
        block = R.Block(ids[part], length[part], doc, term, tf[part][doc, term], weight, n, int(length.sum()))
        for a, b in ((0, 10), (10, 31)):
            scored += R.search_block(block, items[a:b], best, a)
    for i, (t, r) in enumerate(items):
        score = (impact[:, t] * r).sum(axis=1)
        by = np.lexsort((ids, -score))[:k]
        assert best.score[i].tolist() == score[by].tolist()
        assert [x for x, s in zip(best.id[i], best.score[i]) if s] == [x for x, s in zip(ids[by], score[by]) if s]
    assert scored < 0.6 * n * 30


def test_op13_edges(spark):
    docs = [(5, "Alpha beta"), (5, "Alpha beta"), (4, "alpha BETA"), (None, "alpha beta"), (3, None), (2, ""), (9, "- . -"),
            (1, "gamma " * 20000 + "alpha"), (7, "beta 12 ünï"), (8, "12 12 ünï")] + [(100 + i, "alpha delta") for i in range(15)]
    items = [(1, "alpha beta beta"), (1, "ünï"), (1, "alpha beta beta"), (2, "12"), (None, "gamma"), (3, ""), (4, None), (5, "unknown")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, score long")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank long")
    assert sorted(map(tuple, R.rank_documents(d, b).collect()), key=str) == brute_rank(docs, items)
    for x, y in ((d.where("false"), b), (d, b.where("false"))):
        out = R.rank_documents(x, y)
        assert out.collect() == [] and out.columns == ["item_id", "rank", "doc_id", "score"]


def test_op13_blocks_of_items_make_no_difference(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    items = spark.read.parquet(f"{SF001}/benchmark.parquet")
    monkeypatch.setattr(R, "ITEM_BYTES", 5000)                 # read by the driver alone
    got = sorted(map(tuple, R.rank_documents(docs, items).collect()))
    assert got == sql_rows("op13_rmq_search", SF001)


# ---------------------------------------------------------------- op11

def plain_tokens(text):
    return re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7F])+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+", text or "")


def test_tokens_and_context_sums():
    texts = ODD + ["a, b!! C-3 a, b!!", "the the the"]
    column = pa.array(texts, pa.string())
    key, shape, row = Q.tokens(column)
    want = [plain_tokens(t) for t in texts]
    assert np.bincount(row, minlength=len(texts)).tolist() == [len(w) for w in want]
    flat = [w for t in want for w in t]
    names = {}
    for k, w in zip(key.tolist(), flat):
        assert names.setdefault(k, w) == w
    assert len(names) == len(set(flat)) and 0 <= shape.min() and shape.max() < Q.SHAPES
    words = np.sort(np.array([k for k, w in names.items() if w in ("the", "a", "!!", ",")], np.uint64))
    sums = np.zeros((len(words) + Q.SHAPES, Q.DIM), np.int32)
    Q.context_sums(words, column, sums)

    def index_vector(k):
        v = np.zeros(Q.DIM, int)
        for j in range(Q.ONES):
            x = int(T.mix64(np.array([(k + (j + 1) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
            v[x % Q.DIM] += 1 if x >> 63 else -1
        return v

    brute = np.zeros_like(sums)
    code = Q.word_codes(words, key, shape)
    for i in range(len(key)):
        for j in range(max(0, i - Q.WINDOW), min(len(key), i + Q.WINDOW + 1)):
            if j != i and row[i] == row[j]:
                brute[code[i]] += index_vector(int(key[j]))
    assert (sums == brute).all()
    vectors = Q.WordVectors(words, np.random.default_rng(0).normal(size=sums.shape).astype(np.float32))
    got = vectors.pooled(column)
    for i, t in enumerate(want):
        x = vectors.vectors[code[row == i]].astype(float) if t else np.zeros((1, Q.DIM))
        assert np.allclose(got[i], [*x.mean(axis=0), *x.std(axis=0), math.log1p(len(t))], atol=1e-5)


def test_gradient_and_temperature():
    rng = np.random.default_rng(5)
    net = Q.Network(np.zeros(4), np.ones(4), rng.normal(size=(4, 3)), rng.normal(size=3), rng.normal(size=3), 0.3)
    z, y = rng.normal(size=(20, 4)), (rng.random(20) < 0.5).astype(float)

    def loss():
        s = net.score(z)
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for name, g in zip(("w1", "b1", "w2", "b2"), Q._gradient(net, z, y)):
        value = np.array(getattr(net, name), float)
        for at in np.ndindex(value.shape):
            moved = []
            for step in (1e-5, -1e-5):
                other = value.copy()
                other[at] += step
                setattr(net, name, other if value.shape else float(other))
                moved.append(loss())
            setattr(net, name, value if value.shape else float(value))
            assert abs((moved[0] - moved[1]) / 2e-5 - np.asarray(g)[at]) < 1e-6
    logit = rng.normal(size=4000) * 2
    label = (rng.random(4000) < 1 / (1 + np.exp(-logit / 3))).astype(float)      # the logit is three times too sure
    t = Q.best_temperature(logit, label)
    cost = lambda u: np.log1p(np.exp(-(2 * label - 1) * logit / u)).sum()        # noqa: E731
    assert 2.4 < t < 3.6 and all(cost(t) <= cost(t * f) for f in (0.9, 0.99, 1.01, 1.1))


def test_op11_query_on_held_out_labels(spark):
    got = {r["doc_id"]: r for r in queries.op11_indexed_quality(spark, SF01).collect()}
    import zlib
    assert len(got) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    truth = [(got[r["doc_id"]]["score"], r["quality"]) for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()
             if got[r["doc_id"]]["held_out"]]
    good, bad = [s for s, q in truth if q == 1], [s for s, q in truth if q == 0]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert len(bad) >= 10 and auc >= 0.95
    assert np.mean([(s >= 0.7) == q for s, q in truth]) >= 0.9


def test_op11_edges(spark):
    good, bad = "a quiet line of plain words here", "BUY!! NOW!! $$$ | | |"
    docs = [(i, (good if i % 2 else bad) + f" n{i % 5}", 9.0, 1) for i in range(200)]
    docs += [(None, None, 1.0, 1), (500, "", 1.0, 1), (501, "x " * 60000, 1.0, 1), (501, "x " * 60000, 1.0, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score double, predicted int")
    rows = [(i, i % 2) for i in range(0, 120)] + [(None, 1), (3, None), (4, 7), (6, 1), (6, 0), (6, 0), (999, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    vectors = Q.fit_vectors(d)
    net = Q.fit_quality(d, labels, vectors)
    out = Q.score_quality(d, vectors, net)
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    got = [tuple(r) for r in out.collect()]
    assert Counter((r[0], r[1]) for r in got) == Counter((i, t) for i, t, _, _ in docs)
    by = {r[0]: r for r in got}
    assert all(by[i][3] == i % 2 for i in range(120, 200)) and 0 <= by[500][2] <= 1
    assert by[500][2] == by[None][2] and len({r[2] for r in got if r[0] == 501}) == 1
    none = Q.fit_quality(d, labels.where("false"), vectors)
    assert {r["score"] for r in Q.score_quality(d, vectors, none).collect()} == {0.5}
    one = Q.fit_quality(d, labels.where("quality = 1"), vectors)
    assert all(r["score"] > 0.5 for r in Q.score_quality(d.where("doc_id < 200"), vectors, one).collect())
    empty = d.where("false")
    vectors = Q.fit_vectors(empty)
    assert Q.score_quality(empty, vectors, Q.fit_quality(empty, labels, vectors)).collect() == []


def test_op11_sums_are_the_same_for_any_partitions(spark):
    d = spark.read.parquet(f"{SF001}/documents.parquet").select("text")
    a, b = Q.fit_vectors(d.repartition(7)), Q.fit_vectors(d.coalesce(1))
    assert (a.words == b.words).all() and (a.vectors == b.vectors).all()
