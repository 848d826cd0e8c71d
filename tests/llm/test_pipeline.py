"""The pipeline's stages and their registration."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from mutscope.llm import queries
from tests.conftest import SF001
from tests.llm.test_dedup_decontam import brute_components


def test_every_operator_has_one_query():
    import __spark_entry__ as E

    names = E.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns, rows = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    kept = set(rows)
    for name, stage in P.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, SF001).toArrow(), docs.schema)
        got = [tuple(r) for r in docs.collect()]
        assert docs.columns == columns and all(r == tuple(rows[r[0]]) for r in got)
        after = {r[0] for r in got}
        if name == "language_id":
            assert len(after) >= 0.95 * len(kept)
        if name == "near_dedup":
            groups = brute_components([(i, rows[i]["text"]) for i in kept])
            assert after == {i for i, g in groups.items() if g[2]}
        if name == "decontamination":
            items = [re.findall(r"[^\W_]+", b["text"].lower()) for b in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
            told = {i: " ".join(re.findall(r"[^\W_]+", (rows[i]["text"] or "").lower())) for i in kept}
            assert kept - after == {i for i in kept if any(" ".join(b) in told[i] for b in items)}
        if name != "mixing":
            assert max(Counter(r[0] for r in got).values()) == 1
        kept = after
    n = docs.count()
    out = P.STAGES[4][1](spark, docs, SF001).collect()
    sizes = Counter(r["shard"] for r in out)
    assert len(out) == n and max(sizes.values()) - min(sizes.values()) <= 1


def test_near_dedup_stage_keeps_one_of_repeated_rows_and_those_without_id(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "en", "s", 1)] * 2 + [(2, text, "en", "s", 1), (None, "other words", "en", "s", 1), (None, None, None, None, None),
                                            (3, None, "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(P.near_dedup(spark, df, SF001).collect(), key=str)
    assert sorted((r["doc_id"], r["text"]) for r in got if r["doc_id"]) == [(1, text), (3, None)] and len(got) == 4


def test_near_dedup_stage_decides_by_text_where_ids_repeat_or_are_missing(spark):
    copied, alone = "one two three four five six seven", "a text that has no copy in this table"
    near = [f"{' '.join(f'w{i}' for i in range(60))} {end}" for end in ("x", "y", "z")]
    twice = [f"{' '.join(f'v{i}' for i in range(60))} {end}" for end in ("x", "y")]
    rows = [(1, copied), (None, copied), (None, alone), (5, copied), (5, "the second text of document five"),
            *((None, t) for t in near), *((7, t) for t in twice), (None, ""), (None, " "), (8, None)]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = P.near_dedup(spark, df, SF001)
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert out.columns == df.columns
    assert sum(t in near for _, t in got) == 1 and sum(t in twice for _, t in got) == 1
    assert sorted((r for r in got if r[1] not in near + twice), key=str) == sorted(
        [(1, copied), (None, alone), (5, "the second text of document five"), (None, ""), (None, " "), (8, None)], key=str)


def test_an_empty_table_passes_through(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF001).toArrow())
        assert docs.count() == 0


BESIDE = ("kept", "language", "posterior", "weight", "pass", "block", "_t", "_hash", "size", "text_hash", "hilbert", "_beside3", "group")


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_stages_carry_columns_of_any_name_nulls_and_repeated_rows(spark, name, stage):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    some = docs.where("doc_id = 1").select("doc_id", "text", F.lit(None).cast("string").alias("lang"),
                                           F.lit(None).cast("string").alias("source"), "n_chars")
    odd = spark.createDataFrame([(None, None, None, None, None), (900001, "", "en", "", 0), (900002, None, "", None, None)], docs.schema)
    docs = docs.union(some).union(docs.where("doc_id = 2")).union(odd)
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in BESIDE} | {"shard": F.lit(77), "slot": F.lit("x")})
    rows = Counter(str(r) for r in docs.collect()) if name != "sharding" else None
    docs = spark.createDataFrame(docs.toArrow(), docs.schema)
    out = stage(spark, docs, SF001)
    got = out.collect()
    if name == "sharding":
        assert out.columns == [*docs.columns[:-2], "shard", "slot"]
        assert all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for r in got for c in BESIDE)
        assert len(got) == docs.count() and {r["shard"] for r in got} == set(range(16))
        return
    assert out.columns == docs.columns and got
    assert set(map(str, got)) <= set(rows)
    if name in ("language_id", "decontamination"):
        assert all(rows[r] == n for r, n in Counter(map(str, got)).items())
    blank = sum(not (r["text"] or "").strip() for r in got)
    assert blank == 0 if name == "language_id" else blank >= 3
