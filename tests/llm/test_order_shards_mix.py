"""Hilbert shards and temperature mixing against plain Python."""

import itertools
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mutscope.llm import hilbert_shards as H
from mutscope.llm import queries
from mutscope.llm import temperature_mix as M
from mutscope.llm.ordering import global_running_total, hot_key_join
from tests.conftest import SF001


@pytest.mark.parametrize("n,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(n, bits):
    nxt, digit = H.curve_tables(n)
    at = {}
    for cell in itertools.product(range(1 << bits), repeat=n):
        state = h = 0
        for i in range(bits - 1, -1, -1):
            k = state * (1 << n) + sum(((x >> i) & 1) << j for j, x in enumerate(cell))
            h, state = h * (1 << n) + digit[k], nxt[k]
        at[h] = cell
    assert sorted(at) == list(range(1 << n * bits))
    assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1])) == 1 for i in range(len(at) - 1))


def _brute_order(rows, dims, ties, bits=H.BITS):
    """Rows in curve order: equally filled bins by counting, and the curve's tables."""
    n, size = len(dims), 1 << bits
    bins = {}
    for d in dims:
        values = sorted((r[d] is not None, r[d] if r[d] is not None else 0) for r in rows)
        first = {}
        for i, v in enumerate(values):
            first.setdefault(v, i * size // len(rows))
        starts = sorted(set(first.values()))                     # bins that hold something, renumbered
        bins[d] = {v: starts.index(b) for v, b in first.items()}
    nxt, digit = H.curve_tables(n)

    def place(r):
        cell = [bins[d][r[d] is not None, r[d] if r[d] is not None else 0] for d in dims]
        state = h = 0
        for i in range(bits - 1, -1, -1):
            k = state * (1 << n) + sum(((x >> i) & 1) << j for j, x in enumerate(cell))
            h, state = h * (1 << n) + digit[k], nxt[k]
        return h

    return sorted(rows, key=lambda r: (place(r), *((r[t] is not None, r[t] or 0) for t in ties)))


def test_op6_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    rows = [{"doc_id": d["doc_id"], "source": d["source"], "lang": d["lang"], "size": len((d["text"] or "").encode()) + 1,
             "text_crc32": zlib.crc32((d["text"] or "").encode())} for d in docs]
    order = _brute_order(rows, ["source", "lang", "size"], ["doc_id"])
    base, more = divmod(len(rows), 16)
    want, at = {}, 0
    for shard in range(16):
        for slot in range(base + (shard < more)):
            r = order[at]
            want[r["doc_id"]] = (r["size"], r["text_crc32"], "rows", shard, slot, None)
            at += 1
    got = {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["shard"], r["slot"], r["grown_shard"])
           for r in queries.op6_hilbert_shards(spark, SF001).collect()}
    assert got == want


def test_shards_of_ties_nulls_few_rows_and_none(spark):
    schema = "a string, b long, slot string, t long"
    rows = [("x", 1, "clash", i) for i in range(70)] + [(None, None, None, 100), (None, 5, None, 101)]
    out = H.hilbert_shards(spark.createDataFrame(rows, schema), ["a", "b"], ["t"]).collect()
    sizes = Counter(r["shard"] for r in out)
    assert sorted(sizes) == list(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
    want = _brute_order([{"a": r[0], "b": r[1], "t": r[3]} for r in rows], ["a", "b"], ["t"])
    assert [r["t"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))] == [r["t"] for r in want]
    few = H.hilbert_shards(spark.createDataFrame(rows[:3], schema), ["a", "b"], ["t"]).collect()
    assert [(r["shard"], r["slot"]) for r in sorted(few, key=lambda r: r["t"])] == [(0, 0), (1, 0), (2, 0)]
    none = H.hilbert_shards(spark.createDataFrame([], schema), ["a", "b"], ["t"])
    assert none.collect() == [] and none.columns[-2:] == ["shard", "slot"]


def test_written_shards_and_manifest(spark, tmp_path):
    df = spark.range(200).select("id", F.concat(F.lit("s"), F.pmod("id", F.lit(7))).alias("src"))
    out = H.hilbert_shards(df, ["src", "id"], ["id"])
    H.write_shards(out, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 200 and len(list((tmp_path / "shards").glob("shard=*"))) == 16
    boxes = H.shard_manifest(back, ["src", "id"]).collect()
    assert sum(r["rows"] for r in boxes) == 200
    hit = [r for r in boxes if r["src_min"] <= "s3" <= r["src_max"]]
    assert len(hit) < 16                                        # a filter on one dimension skips shards


def test_running_total_and_hot_join(spark):
    df = spark.range(1000).select(F.pmod("id", F.lit(7)).alias("k"), "id")
    got = {r["id"]: r["before"] for r in global_running_total(df, ["k", "id"], F.col("id"), "before").collect()}
    at = 0
    for i in sorted(range(1000), key=lambda i: (i % 7, i)):
        assert got[i] == at
        at += i
    rows = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), (None, 2), ("c", 3)], "k string, i long")
    table = spark.createDataFrame([("a", 10), ("b", 20), (None, 30)], "k string, v long")
    import mutscope.llm.ordering as O
    want = sorted([("a", i, 10) for i in range(50)] + [("b", 1, 20), ("c", 3, None)], key=str) + [(None, 2, 30)]
    old = O.bounded_broadcast
    for cast in (old, lambda d, *_: d):                            # broadcast, and spread over salts
        O.bounded_broadcast = cast
        try:
            out = [tuple(r) for r in hot_key_join(rows, table, "k", ["a"], F.col("i")).select("k", "i", "v").collect()]
        finally:
            O.bounded_broadcast = old
        assert sorted([r for r in out if r[0]], key=str) + [r for r in out if not r[0]] == want


# ---- mixing ---------------------------------------------------------------

def _corpus(spark, sizes=(("big", 400), ("mid", 60), ("low", 12), (None, 20))):
    rows = [(i, s, " ".join(["w"] * (1 + (i * 7) % 50))) for i, s in enumerate(s for s, n in sizes for _ in range(n))]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, text string")


def _brute_weights(totals, share=None, passes=None, budget=1.0):
    total = sum(totals.values())
    weights = lambda e: {s: (t / total) ** e / sum((x / total) ** e for x in totals.values()) for s, t in totals.items()}
    entropy = lambda e: -sum(w * math.log(w) for w in weights(e).values())
    most = lambda e: max(w * budget * total / totals[s] for s, w in weights(e).items())
    low = (lambda e: entropy(e) >= share * math.log(len(totals))) if share else (lambda e: most(e) > passes)
    if low(1.0) or not low(0.0):
        return weights(1.0 if low(1.0) else 0.0)
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if low(mid) else (lo, mid)
    return weights(lo)


@pytest.mark.parametrize("ask", [{"entropy_share": 0.95}, {"max_passes": 3.0}, {"max_passes": 1.0},
                                 {"entropy_share": 0.1}, {"entropy_share": 0.9, "budget_share": 0.5}])
def test_weights_budgets_and_repeats(spark, ask):
    rows, df = _corpus(spark)
    out = M.mix(df, **ask).collect()
    totals = defaultdict(int)
    for _, s, t in rows:
        totals[s] += len(t.split())
    budget = ask.get("budget_share", 1.0)
    want = _brute_weights(totals, ask.get("entropy_share"), ask.get("max_passes"), budget)
    spent, copies = Counter(), defaultdict(Counter)
    for r in out:
        assert r["weight"] == pytest.approx(want[r["source"]], abs=1e-6)
        spent[r["source"]] += len(r["text"].split())
        copies[r["source"]][r["doc_id"]] += 1
        assert r["pass"] < 40
    size = Counter(s for _, s, _ in rows)
    for s in totals:
        aim = want[s] * budget * sum(totals.values())
        assert aim - 51 <= spent[s] <= aim + 1e-3 * aim + 1        # whole documents, up to the budget
        n = [copies[s][i] for i, x, _ in rows if x == s]
        assert max(n) - min(n) <= 1 and sum(n) >= size[s] * int((aim - 1) // totals[s])   # a whole pass, but for rounding
    if "max_passes" in ask:
        assert max(c for s in copies for c in copies[s].values()) <= math.ceil(ask["max_passes"])


def test_passes_are_different_orders(spark):
    _, df = _corpus(spark)
    out = M.mix(df, max_passes=3.0).where("source = 'low'").collect()
    order = {p: [r["doc_id"] for r in sorted(out, key=lambda r: (r["block_key"], r["doc_key"])) if r["pass"] == p] for p in (0, 1)}
    assert sorted(order[0]) == sorted(order[1]) and order[0] != order[1]


def test_mix_edge_cases(spark):
    schema = "doc_id long, source string, text string, weight string, pass string"
    assert M.mix(spark.createDataFrame([], schema), entropy_share=0.9).collect() == []
    blank = spark.createDataFrame([(1, "a", None, "x", "y"), (2, None, " ", "x", "y")], schema)
    assert sorted(r["doc_id"] for r in M.mix(blank, entropy_share=0.9).collect()) == [1, 2]
    twice = spark.createDataFrame([(1, "a", "u v", None, None)] * 2 + [(2, "b", "u v w x", None, None)], schema)
    assert Counter(r["doc_id"] for r in M.mix(twice, entropy_share=0.5).collect()) == {1: 2, 2: 1}
    with pytest.raises(ValueError):
        M.mix(twice)


def test_op9_query(spark):
    docs = {d["doc_id"]: d for d in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    totals = defaultdict(int)
    for d in docs.values():
        totals[d["source"]] += len((d["text"] or "").split())
    want = _brute_weights(totals, 0.92)
    spent = Counter()
    for r in queries.op9_temperature_mix(spark, SF001).collect():
        assert r["weight"] == pytest.approx(want[r["source"]], abs=1e-6)
        spent[r["source"]] += len((docs[r["doc_id"]]["text"] or "").split())
    longest = max(len((d["text"] or "").split()) for d in docs.values())
    for s in totals:
        assert 0 <= want[s] * sum(totals.values()) - spent[s] + 2 <= longest + 2


@pytest.mark.parametrize("kind, values", [
    ("double", [float("-inf"), -1e300, -10.0, -1.5, -1e-300, 0.0, 5e-324, 0.1, 2.0, 9.0, 10.0, 100.0, 1e17, float("inf"), float("nan")]),
    ("float", [-10.0, -1.5, 0.0, 2.0, 9.0, 10.0, 100.0]),
    ("decimal(20,3)", [-100, -10, -2, 0, 2, 9, 10, 100]),
    ("bigint", [-100, -10, -2, 0, 2, 9, 10, 100])])
def test_sort_keys_of_numbers_follow_their_values(spark, kind, values):
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double").withColumn("v", F.col("v").cast(kind))
    rows = rows.union(spark.range(1).select(F.lit(-1), F.lit(None).cast(kind)))
    got = rows.select("i", H._sortable(rows, "v").alias("key")).collect()
    assert [r["i"] for r in sorted(got, key=lambda r: r["key"])] == list(range(-1, len(values)))
