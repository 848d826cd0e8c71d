"""Chat repair, language model and language identification against plain Python."""

import itertools
import random

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mutscope.llm import chat_repair as C
from mutscope.llm import lang_fusion as L
from mutscope.llm import queries
from mutscope.llm import textops as T
from mutscope.llm import window_lm as W
from tests.conftest import SF001

# ---- chat -----------------------------------------------------------------


def _legal(roles):
    body = list(roles)
    if body[:1] == ["system"]:
        body = body[1:]
    return len(body) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(body)) and len(body) >= 2


def brute_cost(turns):
    """Least cost over every way to merge, relabel and insert, tried one by one."""
    kinds = [C.kind_of(r, t) for r, t in turns]
    best = None
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for choice in itertools.product([*C.ROLES, "merge"], repeat=len(kinds)):
        if choice[0] == "merge":
            continue
        for gap in itertools.product(gaps, repeat=choice.count("merge") * 0 + sum(c != "merge" for c in choice) + 1):
            roles, cost, at, last = [], 0, 0, None
            for (role, blank), c in zip(kinds, choice):
                if c == "merge":
                    cost += 0 if blank else C.MERGE + C._relabel(role, last)
                else:
                    roles += [*gap[at], c]
                    cost += C.INSERT * len(gap[at]) + C._relabel(role, c)
                    at, last = at + 1, c
            roles += gap[at]
            cost += C.INSERT * len(gap[at])
            if (best is None or cost < best) and _legal(roles):
                best = cost
    return best


def _parse(rendered):
    parts = rendered.split("<|im_end|>\n")
    assert parts.pop() == ""
    return [p.removeprefix("<|im_start|>").split("\n", 1) for p in parts]


@pytest.mark.parametrize("seed", range(25))
def test_repair_costs_match_brute_force(seed):
    rnd = random.Random(seed)
    turns = [(rnd.choice(["system", "user", "assistant", "tool", None]), rnd.choice(["a", "", None, "b c"]))
             for _ in range(rnd.randint(1, 4))]
    rows = C._rows(turns, C.START, None, True)
    assert sum(r[4] for r in rows) == brute_cost(turns)
    messages = _parse("".join(r[5] for r in rows))
    assert _legal([m[0] for m in messages])
    assert "".join(m[1] for m in messages).replace("\n", "") == "".join(t or "" for _, t in turns)


def test_op1_query_is_legal_and_cheapest(spark):
    turns = {}
    for r in spark.read.parquet(f"{SF001}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    out = queries.op1_chat_role_repair(spark, SF001).orderBy("conv_id", "pos").collect()
    got = {}
    for r in out:
        got.setdefault(r["conv_id"], []).append(r)
    assert {c: len(x) for c, x in got.items()} == {c: len(x) for c, x in turns.items()}
    for c, rows in got.items():
        assert [r["pos"] for r in rows] == list(range(len(rows)))
        messages = _parse("".join(r["piece"] for r in rows))
        assert _legal([m[0] for m in messages])
        kinds = [C.kind_of(*t) for t in turns[c]]
        assert sum(r["cost"] for r in rows) == min(C.cost_matrix(kinds)[e] + C.END_COSTS[e] for e in range(4))
        assert all((t[1] or "") in "".join(m[1] for m in messages) for t in turns[c])


def test_long_conversations_are_repaired_as_if_whole(spark):
    rnd = random.Random(2)
    rows = [(1, i // 2, rnd.choice(["user", "assistant", "system", "x", None]), rnd.choice(["t%d" % i, "", None])) for i in range(300)]
    rows += [(None, i, rnd.choice(["user", "assistant"]), "n") for i in range(40)] + [(2, 0, "user", "hi")] * 30 + [(3, 0, "assistant", "x")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn int, role string, text string, piece string")
    key = lambda d: sorted((r["conv_id"] is None, r["conv_id"], r["pos"], r["turn"], r["new_role"], r["merged"], tuple(r["inserted"]),
                            tuple(r["appended"]), r["cost"], r["piece"]) for r in d.collect())
    assert key(C.repair_roles(df, segment=16)) == key(C.repair_roles(df))
    assert C.repair_roles(df.limit(0)).collect() == []
    told = {r["conv_id"]: r["rendered"] for r in C.transcripts(C.repair_roles(df)).collect()}
    assert all(_legal([m[0] for m in _parse(t)]) for t in told.values()) and set(told) == {1, 2, 3, None}


# ---- language model -------------------------------------------------------

def _brute_scores(model, texts, counts):
    """Every word from its four neighbours, one at a time."""
    vocabulary, net, _ = model
    side, out = vocabulary.side, []
    place = {int(h): i for i, h in enumerate(vocabulary.words)}
    seen = sum(counts.values())
    assert seen == vocabulary.counts[:side * side].sum() + vocabulary.rest.sum()
    soft = lambda z: z - z.max() - np.log(np.exp(z - z.max()).sum())
    for t in texts:
        words = [int(h) for h in W._words(pa.array([t]))[0]]
        ranks = [place.get(h, -1) for h in words]
        codes = [r if 0 <= r < vocabulary.own else vocabulary.own + (h >> 32) % (side - vocabulary.own) for h, r in zip(words, ranks)]
        total = 0.0
        for i, (h, r) in enumerate(zip(words, ranks)):
            near = [codes[i + o] if 0 <= i + o < len(codes) else side for o in (-2, -1, 1, 2)]
            hid = np.tanh(np.concatenate([net.embed[k] for k in near]) @ net.w1 + net.b1)
            own = 0 <= r < side * side
            k = r % side if own else (h - (1 << 64) if h >> 63 else h) % side
            inner = soft((hid @ net.w3[k] + net.b3[k]).astype(float))
            total += soft((hid @ net.w2 + net.b2).astype(float))[k] + inner[r // side if own else side]
            if not own:
                total += np.log((counts.get(h, 0) + W.ADD) / (vocabulary.rest[k] + W.ADD * (vocabulary.kinds[k] + 1)))
        out.append((len(words), total))
    return out


@pytest.mark.parametrize("known", [16, 1])
def test_scores_match_word_by_word_sums(spark, monkeypatch, known):
    monkeypatch.setattr(W, "KNOWN", known)                 # 1: the rarer words' counts all come by the join
    texts = ["the cat sat on the mat and the dog", None, "", " \n ", "one", "One TWO", "w " * 5000,
             " ".join(f"rare{i}" for i in range(400)), "the cat sat on the mat and the dog"]
    df = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(None, "the null id", 1)], "doc_id long, text string, n_words int")
    model = W.train(df)
    counts = Counter(int(h) for t in [*texts, "the null id"] for h in W._words(pa.array([t]))[0])
    got = {r["doc_id"]: r for r in W.score(df, model).collect()}
    for i, (n, total) in enumerate(_brute_scores(model, texts, counts)):
        assert got[i]["n_words"] == n and got[i]["log_likelihood"] == pytest.approx(total, abs=1e-3 * max(1, n / 100))
        assert (got[i]["mean_log_likelihood"] is None) == (n == 0)
    assert got[0]["log_likelihood"] == got[8]["log_likelihood"] and got[None]["n_words"] == 3
    other = spark.createDataFrame([(1, "never seen here, the cat")], "doc_id long, text string")
    (n, total), = _brute_scores(model, ["never seen here, the cat"], counts | Counter())
    assert W.score(other, model).first()["log_likelihood"] == pytest.approx(total, abs=1e-3)


def test_probabilities_of_all_words_add_up_to_one():
    rng, side = np.random.default_rng(5), 4
    words = rng.integers(0, 1 << 63, 60).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    counts = np.sort(rng.integers(1, 50, 60))[::-1].astype(float)
    klass = words[side * side:].view(np.int64) % side
    v = W.Vocabulary(side, words, counts, np.bincount(klass, counts[side * side:], side), np.bincount(klass, minlength=side))
    assert v.rank(words).tolist() == list(range(60)) and v.rank(np.array([2, 4], np.uint64)).tolist() == [-1, -1]
    _, k, m, _ = v.codes(words)
    x = np.tile(rng.integers(0, side + 1, (1, 4)), (60, 1))
    p = v.start().log_probability(x, k, m).astype(float)
    rare = m == side
    p[rare] += v.share(k[rare], counts[rare])
    unseen = v.start().log_probability(x[:side], np.arange(side), np.full(side, side)) + v.share(np.arange(side), 0)
    assert np.exp(p).sum() + np.exp(unseen).sum() == pytest.approx(1, abs=1e-4)


def test_gradient_matches_differences():
    rng, side = np.random.default_rng(1), 5
    net = W.Network(side)
    net.flat *= 3
    x, k, m = rng.integers(0, side + 1, (90, 4)), rng.choice(side, 90, p=[0.6, 0.2, 0.1, 0.1, 0]), rng.integers(0, side + 1, 90)
    loss = lambda flat: -W.Network(side, flat).log_probability(x, k, m).astype(float).mean()
    g = net.gradient(x, k, m)
    assert g.shape == net.flat.shape
    for i in rng.choice(len(g), 80, replace=False):
        up, down = net.flat.copy(), net.flat.copy()
        up[i] += 0.02
        down[i] -= 0.02
        assert (loss(up) - loss(down)) / 0.04 == pytest.approx(g[i], abs=2e-3)


def test_model_counts_all_rows_and_beats_the_unigram(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = docs.where("doc_id % 10 = 0")
    vocabulary, net, counts = W.train(docs.where("doc_id % 10 <> 0"))
    columns = pa.array([r["text"] for r in held.collect()])
    n, total, _, _ = W.log_likelihoods(vocabulary, net, columns)
    _, unigram, _, _ = W.log_likelihoods(vocabulary, _blind(vocabulary), columns)
    assert counts.agg({"n": "sum"}).first()[0] == sum(
        len((r["text"] or "").split()) for r in docs.where("doc_id % 10 <> 0").collect())
    assert total.sum() > unigram.sum() + 0.02 * n.sum()


def _blind(vocabulary):
    """The network that sees no neighbours: words by their counts."""
    net = vocabulary.start()
    net.w2[:], net.w3[:] = 0, 0
    return net


def test_op4_query_scores_every_document(spark):
    out = queries.op4_masked_window_lm(spark, SF001).collect()
    docs = {d["doc_id"]: d["text"] for d in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    assert {r["doc_id"]: r["n_words"] for r in out} == {i: len((t or "").split()) for i, t in docs.items()}
    assert all(r["log_likelihood"] < 0 for r in out if r["n_words"])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert W.score(empty, W.train(empty)).collect() == []


def test_word_and_shingle_hashes_follow_the_texts():
    texts = ["A b  c\td e f", "", None, "a b c d e", "one", " lead trail ", "x" * 4000, "é è ê ë ē"]
    data, off = T.utf8(pa.array(texts))
    with np.errstate(over="ignore"):
        s, e, doc = T.word_bounds(data, off)
        h = T.word_hashes(T.lower_ascii(data), s, e)
        sh, at = T.shingle_hashes(h, doc, len(texts), 5)
    words = [w for t in texts for w in (t or "").lower().split()]
    assert [data[a:b].tobytes().decode().lower() for a, b in zip(s, e)] == words
    assert len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))
    assert np.diff(at).tolist() == [2, 0, 0, 1, 1, 1, 1, 1] and sh[0] == sh[2]
    assert [list(range(a, b)) for a, b in T.slices(pa.array(texts), 10)][0] == [0] if len(texts[0]) > 10 else True


# ---- language identification ----------------------------------------------

WORDS = {"aa": "gora mila tuno pek", "bb": "strand wicht duch zell", "cc": "quiou eaux rhien taile"}


def _text(rnd, lang, n):
    return " ".join(rnd.choice(WORDS[lang].split()) for _ in range(n))


def _labelled(spark, rnd):
    rows = [(i, _text(rnd, lang, 30), lang) for i, lang in enumerate(rnd.choice(sorted(WORDS)) for _ in range(200))]
    return spark.createDataFrame(rows, "id long, text string, lang string")


def _brute_posterior(model, rows):
    """The docstring's sums, row by row, in floating point."""
    k = len(model.labels)
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    ll, own = [], []
    for text, *_ in rows:
        e, n = model.evidence([text or ""])
        ll.append(e[0])
        own.append(np.round(soft(e[0] + np.log(model.prior())), 6) if n[0] else np.zeros(k))
    total = lambda pick: sum((o for o, r in zip(own, rows) if pick(r)), np.zeros(k))
    overall = (total(lambda r: True) + 1) / (total(lambda r: True) + 1).sum()
    said = sorted({r[2] for r in rows if r[2]})
    spoken = total(lambda r: r[2])
    smooth = lambda c, base: (c + L.PSEUDO_ROWS * base) / (c.sum() + L.PSEUDO_ROWS)
    domain = lambda h: h and ".".join(h.split(".")[-2:])
    suffix = lambda h: h.split(".")[-1] if h and "." in h else None
    out = []
    for e, o, (_, host, declared) in zip(ll, own, rows):
        x = e + np.log(smooth(total(lambda r: r[1] == host) - o,
                              smooth(total(lambda r: domain(r[1]) == domain(host)) - o, overall)))
        with_suffix = total(lambda r: suffix(r[1]) == suffix(host)) - o if suffix(host) else np.zeros(k)
        x = x + np.log(smooth(np.maximum(with_suffix, 0), overall) / overall)
        if declared:
            x = x + np.log((total(lambda r: r[2] == declared) + L.PSEUDO_ROWS * overall)
                           / (spoken + L.PSEUDO_ROWS * overall * (len(said) + 1)))
        out.append(soft(x))
    return out


def test_fusion_matches_row_by_row_sums(spark):
    rnd = random.Random(6)
    model = L.fit_text_model(_labelled(spark, rnd), "text", "lang", "id")
    rows = []
    for i in range(120):
        lang = rnd.choice(sorted(WORDS))
        host = rnd.choice([f"www.{lang}.net", f"m.{lang}.net", "big.example.org", "big.example.org", None, "plain"])
        rows.append((_text(rnd, lang, rnd.choice([0, 1, 2, 20])), host, rnd.choice([lang, lang, None, "aa"])))
    rows += [("!!! 123", "plain", "aa"), ("жщю ъыэ фхц " * 9, None, None), (None, None, None)]
    df = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)],
                               "id long, text string, host string, declared string, kept string")
    got = {r["id"]: r for r in L.identify(df, model, "text", "host", "declared").collect()}
    assert len(got) == len(rows)
    for i, (p, r) in enumerate(zip(_brute_posterior(model, rows), rows)):
        if any(c.isalpha() for c in r[0] or ""):
            best = int(p.argmax())
            assert got[i]["posterior"] == pytest.approx(p[best], abs=1e-4)
            assert got[i]["language"] == model.labels[best] or sorted(p)[-1] - sorted(p)[-2] < 1e-4
            assert got[i]["kept"] == (best < len(model.labels) - 1 and p[best] >= L.MIN_POSTERIOR)
        else:
            assert (got[i]["language"], got[i]["posterior"], got[i]["kept"]) == (L.UNKNOWN, 0.0, False)
    assert got[len(rows) - 2]["language"] == L.UNKNOWN and not got[len(rows) - 2]["kept"]
    assert L.identify(df.limit(0), model, "text", "host", "declared").collect() == []


def test_held_out_accuracy_and_op7_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit_text_model(docs.where("doc_id % 2 = 0"), "text", "lang", "doc_id")
    out = L.identify(docs.where("doc_id % 2 = 1"), model, "text", "source", "source").collect()
    assert np.mean([r["language"] == r["lang"] for r in out]) >= 0.95
    pages = {p["page_id"]: p for p in spark.read.parquet(f"{SF001}/pages.parquet").collect()}
    found = queries.op7_language_fusion(spark, SF001).collect()
    told = {d["doc_id"]: d["lang"] for d in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    assert {r["doc_id"]: r["language"] for r in found if r["page_id"] is None}.keys() == told.keys()
    assert np.mean([r["language"] == told[r["doc_id"]] for r in found if r["page_id"] is None]) >= 0.95
    rows = [r for r in found if r["page_id"] is not None]
    assert {r["page_id"] for r in rows} == set(pages) and len(rows) == len(pages) == len(found) - len(told)
    assert np.mean([f'lang="{r["language"]}"' in pages[r["page_id"]]["html"] for r in rows]) >= 0.95
    assert np.mean([r["kept"] for r in found]) >= 0.95


def test_model_without_labels_rejects_everything(spark):
    none = spark.createDataFrame([], "id long, text string, lang string")
    model = L.fit_text_model(none, "text", "lang", "id")
    df = spark.createDataFrame([("some text", "h", "aa")], "text string, host string, declared string")
    assert [(r["language"], r["kept"]) for r in L.identify(df, model, "text", "host", "declared").collect()] == [(L.UNKNOWN, False)]


def test_page_evidence(spark):
    html = "<HTML class=x lang='FR-ca'><script>var a = '<p>';</script><p>Bonjour<!-- no --> le</p>"
    df = spark.createDataFrame([(1, "HTTP://u@Www.Ex.Com:80/a", html), (2, None, None), (3, "nonsense", "plain")],
                               "page_id long, url string, html string")
    got = [tuple(r) for r in L.page_evidence(df).orderBy("page_id").collect()]
    assert got[0][1].split() == ["Bonjour", "le"] and got[0][2:] == ("www.ex.com", "FR")
    assert got[1] == (2, None, None, None) and got[2] == (3, "plain", None, None)
    assert F is not None


def test_every_label_is_a_language_in_all_its_spellings(spark):
    rnd, rows = random.Random(12), []
    codes = [a + b for a in "abcdefgh" for b in "abcdefghij"] + ["yue"]
    for k, code in enumerate(codes):
        letters = [chr(0x4E00 + 40 * k + j) for j in range(40)]           # a script of its own
        for i in range(4):
            told = [code, code.upper(), f"{code}-XX", f" {code}_yy"][i]
            text = " ".join("".join(rnd.choice(letters[:8]) for _ in range(4)) for _ in range(60))
            rows.append((len(rows), text, told, code))
    df = spark.createDataFrame(rows, "id long, text string, lang string, code string")
    model = L.fit_text_model(df, "text", "lang", "id")
    assert sorted(model.labels) == sorted([*codes, L.UNKNOWN])
    out = L.identify(df.withColumn("host", F.lit("h")), model, "text", "host", "lang").collect()
    assert len(out) == len(rows) and all(r["language"] == r["code"] and r["kept"] for r in out)


def test_far_logits_are_brought_near_first():
    rng, side = np.random.default_rng(2), 5
    near, far = W.Network(side), W.Network(side)
    far.b2[:], far.b3[:] = far.b2 + 200, far.b3 - 200
    x, k, m = rng.integers(0, side + 1, (50, 4)), rng.integers(0, side, 50), rng.integers(0, side + 1, 50)
    assert far.log_probability(x, k, m) == pytest.approx(near.log_probability(x, k, m), abs=1e-3)
    assert far.gradient(x, k, m) == pytest.approx(near.gradient(x, k, m), abs=1e-4)


def test_sample_is_the_same_however_rows_are_dealt_out(spark, monkeypatch):
    rows = [(i, f"word{i % 7} text{i}", ("en", "de", "EN-us")[i % 3]) for i in range(400)] + [(3, "word3 text3", "en")] * 3
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    monkeypatch.setattr(L, "SAMPLE_ROWS", 20)
    one, many = (L.fit_text_model(df.repartition(n, "text"), "text", "lang", "id") for n in (1, 9))
    assert one.labels == many.labels and (one.table == many.table).all()
