"""Token ids, personal data and neighbours against brute force, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mutscope.llm import huffman_ids as H
from mutscope.llm import pii_crf as P
from mutscope.llm import qalsh as N
from mutscope.llm import queries
from tests.conftest import SF001

PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")

# ---- token ids ------------------------------------------------------------


def _library_ids(texts):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(PATH)
    return [[*tk.encode(t or "", add_special_tokens=False).ids, H.END_ID] for t in texts]


def _expected(rows):
    """{doc_id: (start, n_tokens, crc)} of documents in the order of their ids."""
    at, out = 0, {}
    for (doc, _), ids in zip(rows, _library_ids([t for _, t in rows])):
        out[doc] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


def test_op3_query_matches_the_library(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op3_huffman_ids(spark, SF001).collect()}
    assert got == _expected([tuple(r) for r in docs])


ODD = ["", "  ", "a\x1cb <|endoftext|> x", "café ÉCOLE's don't i'LL we've", "é ́x 　y\xa0z", "İstanbul ΣΣ ﬁ 123abc --!!",
       "<|startoftext|>hi\x85you", "a\u0000b ²½ ªº ßµ ×", "\U0001f600 ok​.", "x" * 3000, "3.14,15 'S 's", "the. the, the! THE?"]


def test_words_found_once_equal_whole_texts():
    ids, count = H.WordIds(PATH).encode(ODD)
    off = np.concatenate(([0], np.cumsum(count)))
    assert [ids[a:b].tolist() + [H.END_ID] for a, b in zip(off, off[1:])] == _library_ids(ODD)


def test_latin_1_words_are_split_without_a_call_for_each(monkeypatch):
    texts = [*(f"{chr(c)}Ab {chr(c)} {chr(c)}{chr(d)}9z" for c in range(33, 256) if c not in (39, 0x85, 0xA0) for d in (65, 0xB2, 0xD7, 0xE9)),
             " ", "two  Words. 12"]
    asked = []
    split = H.WordIds._split
    monkeypatch.setattr(H.WordIds, "_split", lambda *a: asked.append(a[-1]) or split(a[-1]))
    ids, count = H.WordIds(PATH).encode(pa.array(texts))
    off = np.concatenate(([0], np.cumsum(count)))
    assert [ids[a:b].tolist() + [H.END_ID] for a, b in zip(off, off[1:])] == _library_ids(texts)
    assert asked == []


def test_a_full_cache_starts_again(monkeypatch):
    monkeypatch.setattr(H, "CACHE_WORDS", 3)
    words = H.WordIds(PATH)
    for _ in range(3):
        ids, count = words.encode(ODD)
        assert len(ids) == sum(count) == sum(len(x) - 1 for x in _library_ids(ODD))


def test_round_trip_of_odd_and_many_documents(spark, tmp_path):
    rows = [(i * 3 % 50, t) for i, t in enumerate(ODD)] + [(100 + i, "word " * i) for i in range(60)] + [(70, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(5)
    H.encode(df, str(tmp_path / "f"), PATH, block_ids=50)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in H.decode(spark, str(tmp_path / "f")).collect()}
    assert got == _expected(sorted(rows))
    assert spark.read.parquet(str(tmp_path / "f" / "blocks")).count() > 5


def test_null_ids_repeated_rows_and_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    H.encode(df, str(tmp_path / "a"), PATH)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"]) for r in H.decode(spark, str(tmp_path / "a")).collect()), key=lambda r: r[1])
    assert got == [(None, 0, 2), (1, 2, 3), (1, 5, 3)]
    H.encode(df.limit(0), str(tmp_path / "b"), PATH)
    assert H.decode(spark, str(tmp_path / "b")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10 ** 6), min_size=1, max_size=40), st.integers(6, 16))
def test_code_lengths_are_complete_and_no_worse_than_any_limited_code(counts, limit):
    counts = np.array(counts)
    length = H.code_lengths(counts, limit)
    assert length.max() <= limit
    if len(counts) > 1:
        assert sum(2.0 ** -x for x in length) == 1
    if len(counts) <= 7:
        best = min(sum(a * b for a, b in zip(x, counts)) for x in itertools.product(range(1, min(limit, 7) + 1), repeat=len(counts))
                   if sum(2.0 ** -i for i in x) <= 1) if len(counts) <= 5 else None
        assert best is None or (length * counts).sum() == best


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), min_size=1, max_size=700), min_size=1, max_size=4))
def test_pack_and_unpack(blocks):
    flat = np.concatenate([np.array(b) for b in blocks])
    ids, n = np.unique(flat, return_counts=True)
    book = H.Codebook(ids, H.code_lengths(n))
    packed = [book.pack(np.array(b)) for b in blocks]
    back = book.unpack([p[0] for p in packed], [p[1] for p in packed], [len(b) for b in blocks])
    assert back.tolist() == flat.tolist()


# ---- personal data --------------------------------------------------------

def brute_patterns(text):
    """The four definitions, word for word."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@ -+()0925é%_", max_size=60))
def test_patterns_match_their_definitions(text):
    assert P.pattern_spans(text) == brute_patterns(text)


def test_op8_query_matches_the_definitions(spark):
    docs = {d["doc_id"]: d["text"] or "" for d in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = queries.op8_pii_crf(spark, SF001).collect()
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        base = brute_patterns(docs[r["doc_id"]])
        told = [f"{k}:{s}:{e}" for k, s, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        for kind in P.PATTERN_KINDS:
            assert r[f"n_{kind}"] == sum(b[0] == kind for b in base)
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if s.split(":")[0] in P.PATTERN_KINDS] == told
        for s in spans[len(told):]:
            kind, a, b = s.split(":")
            assert kind in P.CRF_KINDS and not any(int(a) < y and x < int(b) for _, x, y in base)


def test_viterbi_matches_all_paths():
    model, rng = P.train(rounds=60), np.random.default_rng(0)
    for _ in range(40):
        doc, score = np.sort(rng.integers(0, 3, 8)), rng.normal(0, 4, (8, 4)).astype(np.float32)
        want = []
        for d in np.unique(doc):
            s = score[doc == d]
            value = lambda y: (model.step[0, y[0]] + sum(model.step[a, b] for a, b in zip(y, y[1:]))
                               + model.step[y[-1], 0] + sum(s[i, k] for i, k in enumerate(y)))
            want += max(itertools.product(range(4), repeat=len(s)), key=value)
        assert model.decode(score, doc).tolist() == want


def test_crf_labels_held_out_rows():
    rows = list(P.labelled_rows())
    model, right, total, found, there = P.train(rows[::2] + rows[1::4]), 0, 0, 0, 0
    for words, labels in rows[3::4]:
        shape, cue = P._design(words)
        doc = np.zeros(len(words), int)
        got = model.decode(model.scores(shape, cue, doc), doc)
        right += (got == labels).sum()
        total += len(words)
        found += sum(g == y != 0 for g, y in zip(got, labels))
        there += sum(y != 0 for y in labels)
    assert right / total >= 0.9 and found / there >= 0.6


def test_pii_spans_and_masking(spark):
    texts = ["Ünt token = \"9f86d081884c7d659a2feaa0c55ad015\" und", "mail a.b@c.de, call +1 (743) 555-3824 now", None, "",
             "konto 4316522678525457 bei", "plain words and nothing else", "x " * 30000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    out = {r["doc_id"]: r["spans"] for r in P.find_pii(df).collect()}
    named = {i: [(s["kind"], texts[i][s["start"]:s["end"]], s["base"]) for s in x] for i, x in out.items() if x}
    assert named == {0: [("secret", "9f86d081884c7d659a2feaa0c55ad015", False)],
                     1: [("email", "a.b@c.de", True), ("phone", "+1 (743) 555-3824", True)],
                     4: [("account", "4316522678525457", False)]}
    joined = P.find_pii(df).join(df.select("doc_id", "text"), "doc_id")
    hidden = {r["doc_id"]: r["m"] for r in joined.select("doc_id", P.masked(F.col("text"), F.col("spans")).alias("m")).collect()}
    assert hidden[1] == "mail [email], call [phone] now" and hidden[5] == texts[5] and hidden[2] is None
    assert P.find_pii(df.limit(0)).collect() == []


# ---- neighbours -----------------------------------------------------------

def _brute_neighbours(rows, k, queries_):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = min(ok[i], list(v)) if i in ok else list(v)
    out = {}
    for q in queries_:
        if q in ok:
            scored = sorted((-float((np.array(v, float) * np.array(ok[q], float)).sum()), i)
                            for i, v in ok.items() if i != q and len(v) == len(ok[q]))
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def test_op5_query_recall_and_scores(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    asked = [i for i, _ in rows if i % 20 == 0]
    want = _brute_neighbours(rows, 20, asked)
    got = {}
    for r in queries.op5_collision_counting(spark, SF001).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    vec = {i: np.array(v, float) for i, v in rows}
    for q, found in got.items():
        assert [f[0] for f in found] == list(range(1, 21)) and found == sorted(found, key=lambda f: (-f[2], f[1]))
        assert all(f[2] == pytest.approx(vec[q] @ vec[f[1]], abs=1e-12) for f in found)
    recall = np.mean([len({f[1] for f in got[q]} & {w[1] for w in want[q]}) / 20 for q in want])
    assert recall >= 0.9


def test_neighbours_in_blocks_and_of_unequal_norms(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 300)
    monkeypatch.setattr(N, "BLOCK_QUERIES", 20)
    rng = np.random.default_rng(4)
    rows = [(i, (v * rng.uniform(0.2, 3)).tolist()) for i, v in enumerate(rng.standard_normal((1500, 16)))]
    rows += [(2000 + i, rows[0][1]) for i in range(400)]                   # one very common vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [i for i, _ in rows if i % 25 == 0]
    got = {}
    for r in N.nearest(df, df.where("vec_id % 25 = 0"), 10).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    want = _brute_neighbours(rows, 10, asked)
    assert np.mean([len(set(got[q].values()) & {w[1] for w in want[q]}) / 10 for q in want]) >= 0.9
    assert [got[0][r] for r in range(1, 11)] == [w[1] for w in want[0]]    # ties: the smallest ids


def test_neighbour_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]),
            (120, []), (1, [1.0, 1.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0, 5.0]), (None, [9.0, 9.0]),
            (140, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    asked = df.where("vec_id % 20 = 0")
    got = {}
    for r in N.nearest(df, asked, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got == _brute_neighbours(rows, 20, [0, 20, 40, 60, 80, 100, 120, 140])
    assert N.nearest(df.limit(0), asked, 20).collect() == [] == N.nearest(df, asked.limit(0), 20).collect()


@pytest.mark.parametrize("sigma, hot", [(0.0, 0), (0.3, 0), (0.6, 0), (0.3, 6000)])
def test_recall_of_a_full_block_with_unequal_norms_and_a_hot_vector(sigma, hot):
    rng, n, k = np.random.default_rng(0), N.BLOCK_ROWS, 20
    v = rng.standard_normal((n, 64))
    v *= np.exp(sigma * rng.standard_normal((n, 1))) / np.linalg.norm(v, axis=1, keepdims=True)
    v[rng.permutation(n)[:hot]] = v[17]
    asked = np.arange(0, n, 400)
    product = v[asked] @ v.T
    product[np.arange(len(asked)), asked] = -np.inf
    worst = np.partition(product, n - k, axis=1)[:, n - k]                # the k-th best score
    found = N.Block(np.arange(n), v, k).nearest(asked, v[asked])
    assert all(len(set(ids.tolist()) - {q}) == k for q, (ids, _) in zip(asked, found))
    assert np.mean([(score >= w - 1e-12).mean() for w, (_, score) in zip(worst, found)]) >= 0.95


def test_windows_found_from_any_width_are_those_of_the_plain_search():
    rng, k = np.random.default_rng(3), 5
    v = rng.standard_normal((2000, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    part, asked = N.Range(v, np.linalg.norm(v, axis=1), 0), v[:40] * rng.uniform(0.1, 9, (40, 1))
    forth = {q: at.tolist() for q, at in part.passed(asked, k)}
    place = np.hstack((v, np.sqrt(np.maximum(part.top ** 2 - (v ** 2).sum(axis=1), 0))[:, None])) @ part.axes
    centre = asked / np.linalg.norm(asked, axis=1, keepdims=True) * part.top @ part.axes[:-1]
    goal, need = int(N.VERIFY_SHARE * len(v)) + N.VERIFY_TIMES * k, int(np.ceil(N.THRESHOLD * N.PROJECTIONS))
    for q, c in enumerate(centre):
        width = N.START * part.spread
        while (ok := (np.abs(place - c) <= width).sum(axis=1) >= need).sum() < goal:
            width *= N.GROWTH
        assert forth[q] == np.flatnonzero(ok).tolist()
    for turn in (0, 40):
        part.turn = turn
        assert {q: at.tolist() for q, at in part.passed(asked, k)} == forth
