"""Driver contract, source readers and a small sample of catalog queries
against their DuckDB oracles (the full sweep is tools/check.py)."""

import duckdb
import pytest

import __spark_entry__ as E
from mutscope.session import TABLES
from mutscope.sources import files as IO
from tests.conftest import SF001, SF01

SAMPLE = ["A1", "A3", "C9", "A20", "W3", "T2", "T4", "E1", "L4", "C11", "J7", "S3", "M10"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert {"run_id", "strategy_name", "round_num", "mean_score", "stddev"} <= set(df.columns)


def test_every_query_has_callable_and_oracles_are_subset():
    qs, sql = E.queries(), E.oracle_sql()
    assert len(qs) > 100
    assert set(sql) <= set(qs)


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return v


@pytest.mark.parametrize("qid", SAMPLE)
def test_query_matches_oracle(spark, qid):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF01}/{t}.parquet'")
    sdf = E.queries()[qid](spark, SF01)
    cols = sorted(sdf.columns)
    srows = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    cur = con.execute(E.oracle_sql()[qid])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    drows = sorted((tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()), key=repr)
    assert srows == drows


def test_read_assay_missing_column_raises(spark, tmp_path):
    p = str(tmp_path / "a.csv")
    spark.createDataFrame([("v1", 1.0)], "mutant string, score double").write.option("header", "true").csv(p)
    with pytest.raises(IO.MissingColumnError):
        IO.read_assay(spark, p, {"id_col": "mutant", "score_col": "DMS_score"})


def test_fasta_wrapped_and_duplicate(spark, tmp_path):
    p = tmp_path / "x.fasta"
    p.write_text(">a desc\nACD\nEF\n>b\nGG\n>a again\nWW\n")
    got = {r.record_id: r.sequence for r in IO.read_fasta(spark, str(p)).collect()}
    assert got == {"a": "WW", "b": "GG"}


def test_canonicalise_defaults(spark):
    df = spark.createDataFrame([(3, None, None), (1, "n1", 2.0)], "k int, name string, score double")
    got = {r.k: (r.id, r.name, r.score, r.uncertainty) for r in IO.canonicalise(df, order_col="k").collect()}
    assert got == {1: ("1", "n1", 2.0, None), 3: ("2", "variant_2", 0.0, None)}


def test_smoke_dir_all_queries_build(spark):
    """Every registered query runs on the smallest scale (rows ≥ 0)."""
    for name, fn in E.queries().items():
        assert fn(spark, SF001).count() >= 0, name
