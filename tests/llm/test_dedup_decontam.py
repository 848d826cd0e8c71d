"""Near duplicates and decontamination against brute force, and their edge cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from mutscope.llm import bottomk_dedup as B
from mutscope.llm import qgram_decontam as Q
from mutscope.llm import queries
from mutscope.llm.components import components
from tests.conftest import SF001

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return set(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    """{doc_id: (n_shingles, component_id, kept)} by comparing all pairs."""
    sets = {i: _shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def _result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def _near_copies(seed=3, groups=6):
    """Groups of edited copies, with similarities on both sides of the threshold."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))) for _ in range(400)]
    shared = [rnd.choice(words) for _ in range(40)]
    rows = []
    for g in range(groups):
        base = [rnd.choice(words) for _ in range(rnd.choice([6, 12, 40, 120, 300]))]
        for _ in range(rnd.choice([3, 10, 40])):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 12))):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            rows.append(" ".join(w))
    rows += [" ".join(shared + [rnd.choice(words) for _ in range(30)]) for _ in range(40)]
    return list(enumerate(rows))


def test_op10_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    assert _result(queries.op10_bottomk_near_dedup(spark, SF001)) == brute_components([tuple(r) for r in docs])


@pytest.mark.parametrize("short", [B.SHORT_LIST, 1])
def test_near_copies_match_brute_force(spark, monkeypatch, short):
    monkeypatch.setattr(B, "SHORT_LIST", short)          # 1: every list goes the way of the long ones
    rows = _near_copies()
    got = _result(B.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute_components(rows)


def test_clusters_in_several_blocks_match_brute_force(spark):
    """Blocks of few classes: a cluster is compared as pairs of blocks."""
    rows = _near_copies(seed=5, groups=2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    old = B.BLOCK_CLASSES
    try:
        B.BLOCK_CLASSES, B.SHORT_LIST = 8, 1
        assert _result(B.near_duplicates(docs)) == want
    finally:
        B.BLOCK_CLASSES, B.SHORT_LIST = old, 16


def test_dedup_edge_cases(spark):
    text = "one two three four five six seven"
    rows = [(1, None), (2, ""), (3, " \t\n"), (5, text), (4, text.upper()), (6, "one two"), (7, "ONE  two"),
            (8, "one two three"), (9, text), (9, text), (None, text), (None, "alone in the world of words"),
            (10, "x " * 20000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_shingles string")
    out = B.near_duplicates(df)
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in out.collect()}
    assert out.count() == len(rows)
    assert got[1, 0] == (1, True) and got[2, 0] == (2, True) and got[3, 0] == (3, True)
    assert got[4, 3] == (4, True) and got[5, 3] == (4, False) and got[9, 3] == (4, False)
    assert got[6, 1] == (6, True) and got[7, 1] == (6, False) and got[8, 1] == (8, True)
    assert got[10, 1] == (10, True)
    nameless = {(r["component_id"], r["kept"]) for r in out.where("doc_id is null").collect()}
    assert nameless == {(4, False), (None, True)}


def test_dedup_of_an_empty_table(spark):
    out = B.near_duplicates(spark.createDataFrame([], DOCS))
    assert out.collect() == [] and out.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (200, 201), (201, 200), (9, None)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


# ---- decontamination ------------------------------------------------------

def _distance_in(pattern, text):
    """Least edits that turn ``pattern`` into some part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute_leaks(docs, items):
    out = set()
    for item, t in items:
        c = Q.fold(t or "")
        if len(c) < Q.MIN_CHARS:
            continue
        last = max(0, len(c) - Q.WINDOW)
        windows = [c[a:a + Q.WINDOW].tolist() for a in {*range(0, last + 1, Q.STRIDE), last}]
        for doc, text in docs:
            f = Q.fold(text or "").tolist()
            if any(_distance_in(w, f) <= Q.edit_budget(len(w)) for w in windows):
                out.add((doc, item))
    return out


def _sentence(rnd, n):
    return " ".join("".join(rnd.choice("aeinorst") for _ in range(rnd.randint(2, 8))) for _ in range(n))


def test_leaks_match_brute_force(spark):
    rnd = random.Random(1)
    items = [(i, _sentence(rnd, 5 + 6 * i)) for i in range(5)] + [(9, "too short"), (10, None)]
    docs = []
    for i in range(14):
        base = items[i % 5][1]
        cut = base[rnd.randrange(max(1, len(base) // 3)):]
        edits = list(cut)
        for _ in range(i // 2 * len(edits) // 60):
            k = rnd.randrange(len(edits))
            edits[k:k + 1] = rnd.choice(["", "q", "qz", "É"])
        docs.append((i, _sentence(rnd, 8) + ". " + "".join(edits).upper() + "!\n" + _sentence(rnd, 8)))
    docs += [(50, _sentence(rnd, 60)), (51, None), (52, ""), (53, items[2][1]), (54, "x" * 5000)]
    found = Q.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                         spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert got == brute_leaks(docs, items) and len(got) > 5


def test_op2_query_finds_every_whole_passage_and_nothing_else(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF001}/benchmark.parquet").collect()
    key = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    folded = [(d["doc_id"], key(d["text"])) for d in docs]
    want = {(i, b["item_id"]) for b in items for i, t in folded if key(b["text"]) in t}
    rows = queries.op2_qgram_decontamination(spark, SF001).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want
    text = {d["doc_id"]: d["text"] for d in docs}
    item = {b["item_id"]: key(b["text"]) for b in items}
    for r in rows:
        assert r["edits"] == 0 and item[r["item_id"]][10:-10] in key(text[r["doc_id"]][r["start"]:r["end"]])


def test_blocks_of_the_benchmark_give_the_same_leaks(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "benchmark"))
    key = lambda d: {tuple(r) for r in d.collect()}
    want = key(Q.find_leaks(docs, items))
    monkeypatch.setattr(Q, "BLOCK_CHARS", 3000)
    assert key(Q.find_leaks(docs, items)) == want
    clean = Q.decontaminate(docs, items)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - {x[0] for x in want}


def test_decontamination_keeps_columns_with_clashing_names(spark):
    df = spark.createDataFrame([("hello", 1, None), (None, 2, 5)], "text string, item_id int, start int")
    empty = spark.createDataFrame([], "item_id long, text string")
    assert Q.decontaminate(df, empty).where(F.lit(True)).collect() == df.collect()
    assert Q.find_leaks(df.withColumn("doc_id", F.lit(1)), empty).collect() == []


def brute_quotes(docs, items, words=13):
    """Leaks by whole words in a row, without windows; short items by all of their words."""
    told = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for item, t in items:
        w = told(t)
        n = len(w) if len(" ".join(w)) < 24 else words
        parts = {" " + " ".join(w[i:i + n]) + " " for i in range(len(w) - n + 1)} if w else set()
        out |= {(d, item) for d, x in docs if any(p in " " + " ".join(told(x)) + " " for p in parts)}
    return out


def test_quotes_are_found_at_every_offset(spark):
    rnd = random.Random(8)
    items = [(1, _sentence(rnd, 36)), (2, " ".join(rnd.choice("abcdefgh") for _ in range(40)))]
    docs, n = [], 0
    for item, text in items:
        words = text.split()
        for size in (12, 13, 17):
            for at in range(len(words) - size + 1):
                n += 1
                docs.append((n, _sentence(rnd, n % 7) + " " + " ".join(words[at:at + size]).title() + ", " + _sentence(rnd, 9)))
    docs.append((0, "x" + " ".join(items[0][1].split()[:13])))            # the first word is not whole
    text = items[0][1]
    for at in range(0, len(text) - 80, 3):                                # a window's length from any character on
        n += 1
        part = list(text[at:at + 80])
        for k in range(5, 80, 13):
            part[k] = "q"
        docs.append((n, _sentence(rnd, 9) + "".join(part) + _sentence(rnd, 9)))
    found = {(r["doc_id"], r["item_id"]) for r in Q.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                                                               spark.createDataFrame(items, "item_id long, text string")).collect()}
    edited = {(i, 1) for i, _ in docs[-len(range(0, len(text) - 80, 3)):]}
    want = brute_quotes(docs, items)
    assert want | edited <= found
    more = {i for i, _ in found - want - edited}                          # fewer words, but a window with edits
    assert found - want - edited <= brute_leaks([d for d in docs if d[0] in more], items)


def test_short_items_and_items_without_id_are_searched(spark):
    rnd = random.Random(9)
    items = [(1, "Who wrote Hamlet?"), (2, "yes"), (None, _sentence(rnd, 20)), (None, "Pi is 3"), (3, "  "), (4, "who  wrote")]
    docs = [(1, "Who wrote Hamlet?"), (2, "so, WHO wrote\nhamlet"), (3, "who wrote hamlets"), (4, "yesterday"), (5, "Yes!"),
            (6, "see " + items[2][1]), (7, "(pi is 3)"), (8, "pi is 31"), (9, None), (10, "no answer")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in Q.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
                  .collect()), key=str)
    assert got == sorted([(1, 1), (1, 4), (2, 1), (2, 4), (3, 4), (5, 2), (6, None), (7, None)], key=str)
    assert [r["doc_id"] for r in Q.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
            .orderBy("doc_id").collect()] == [4, 8, 9, 10]
    named = spark.createDataFrame([("q1", "Who wrote Hamlet?")], "item_id string, text string")
    assert {(r["doc_id"], r["item_id"]) for r in Q.find_leaks(docs, named).collect()} == {(1, None), (2, None)}


def test_texts_of_one_item_id_give_one_row(spark, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK_CHARS", 50)
    first, second = (" ".join(f"{c}{i}word" for i in range(20)) for c in "pq")
    items = spark.createDataFrame([(5, first), (5, second), (None, first), (None, second), (6, second)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{first} and between them {second}")], "doc_id long, text string")
    got = [(r["item_id"], r["start"], r["end"]) for r in Q.find_leaks(docs, items).collect()]
    size, at = len(first), len(first) + len(" and between them ")
    assert sorted(got, key=str) == sorted([(5, 0, at + len(second)), (6, at, at + len(second)), (None, 0, size), (None, at, at + len(second))], key=str)
