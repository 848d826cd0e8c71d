"""Plain inputs that earlier gave wrong answers, and models against closed forms."""

import uuid

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mutscope.functions import expr as E
from mutscope.operators import features as FT
from mutscope.operators import models as M
from mutscope.operators import selection as SEL
from mutscope.operators import variants as V
from mutscope.operators.selection import seeded_uniform
from mutscope.plans import evaluation as EV
from mutscope.session import stage_folder
from mutscope.sources import files as IO
from mutscope.sources.runlog_store import RUN_TABLES, RunLogStore, upsert_dataset
from mutscope.streaming import runlog_stream as RS


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_cantor_pair_of_large_numbers(spark):
    for a, b in ((200000001, 2), (0, 0), (3, 4), (1 << 31, 5), (2999999999, 1)):
        assert _one(spark, E.cantor_pair(F.lit(a), F.lit(b))) == (a + b) * (a + b + 1) // 2 + b


def test_positions_too_large_are_null(spark):
    assert _one(spark, E.variant_position(F.lit("L99999999999Q"))) is None
    assert _one(spark, E.variant_position(F.lit("L9Q"))) == 9
    assert _one(spark, E.hgvs_to_variant_id(F.lit("G:p.Leu99999999999Gln"))) is None


def test_first_difference(spark):
    rows = [("ABCD", "ABXD", 3), ("ABC", "ABCD", None), ("", "A", None), ("ABCD", "AB", None), ("A" * 3000 + "B", "A" * 3000 + "C", 3001),
            (None, "A", None), ("X", "Y", 1)]
    df = spark.createDataFrame([r[:2] for r in rows], "w string, m string")
    assert [r.x for r in df.select(E.first_difference("w", "m").alias("x")).collect()] == [r[2] for r in rows]


def test_surrogate_ids_are_unique_and_keep_null_rows(spark):
    df = spark.createDataFrame([(5, "a"), (5, "b"), (None, "c"), (1, "d"), (5, "a")], "o int, v string")
    got = sorted((r.id, r.o) for r in IO.surrogate_ids(df, "o").collect())
    assert got == [(1, None), (2, 1), (3, 5), (4, 5), (5, 5)]


def test_fasta_records_begin_at_line_starts_and_the_last_one_wins(spark, tmp_path):
    path = tmp_path / "x.fasta"
    path.write_text(">r1 NM_1:c.76A>T note\nACD\nEF\n>r2\nGG\n\n>r1 again\nKK LL\n>r3 a>b\n" + "M" * 70 + "\n")
    got = {r.record_id: r.sequence for r in IO.read_fasta(spark, str(path)).collect()}
    assert got == {"r1": "KKLL", "r2": "GG", "r3": "M" * 70}
    (tmp_path / "many").mkdir()
    for i in range(3):
        (tmp_path / "many" / f"{i}.fasta").write_text("".join(f">s\n{c * (200 - 60 * i)}\n" for c in "AB") + f">t{i}\nW\n")
    got = {r.record_id: r.sequence for r in IO.read_fasta(spark, str(tmp_path / "many")).collect()}
    assert got["s"] == "B" * 80 and set(got) == {"s", "t0", "t1", "t2"}


def test_missing_embedding_fails_when_strict(spark):
    v = spark.createDataFrame([("a",), ("b",)], "id string")
    e = spark.createDataFrame([("a", [1.0])], "id string, embedding array<double>")
    joined, missing = IO.attach_embeddings(v, e)
    assert joined.count() == 2 and [r.id for r in missing.collect()] == ["b"]
    with pytest.raises(PySparkException, match="no embedding for variant b"):
        IO.attach_embeddings(v, e, strict=True)[0].collect()


def test_thompson_takes_one_member_for_a_round(spark):
    rows = [(1, 2, [1.0, 2.0, 3.0]), (1, 2, [1.0, 2.0, 3.0, 4.0]), (1, 2, None), (2, 2, [5.0])]
    df = SEL.ensemble_size(spark.createDataFrame(rows, "s long, r int, components array<double>"), ["s", "r"])
    got = df.select("s", "components", SEL.acq_thompson("s", "r").alias("x")).collect()
    member = {r.x for r in got if r.s == 1 and r.components and len(r.components) == 4}.pop()
    assert {r.x for r in got if r.s == 1 and r.components and len(r.components) == 3} == {member if member <= 3 else None}
    assert [r.x for r in got if r.s == 2] == [5.0]


def test_gene_map_with_several_genes_doubles_nothing(spark):
    res = spark.createDataFrame([(1, "ds", f"A{i}C", float(i)) for i in range(1, 7)],
                                "run_id int, dataset_name string, variant_id string, prediction_score double")
    clin = spark.createDataFrame([("G", f"A{i}C", int(i < 3)) for i in range(1, 7)], "gene_symbol string, variant_id string, label int")
    genes = spark.createDataFrame([("ds", "G"), ("ds", "H"), ("ds", "G")], "dataset_name string, gene_symbol string")
    out = EV.calibration(res, clin, genes).collect()
    assert [(r.num_positive, r.num_negative, r.auc) for r in out] == [(2, 4, 1.0)]
    named = V.gene_symbol(spark.createDataFrame([("ds",), ("other",)], "dataset_name string"), genes)
    assert sorted(tuple(r) for r in named.collect()) == [("ds", "G"), ("other", "other")]


# ---- stored tables --------------------------------------------------------

def test_store_appends_once_and_purges(spark):
    store = RunLogStore(spark, f"{stage_folder(spark)}/store-{uuid.uuid4().hex}")
    rows = spark.createDataFrame([(r, f"v{r}{i}") for r in (1, 2, 3) for i in range(3)], "run_id int, v string")
    for name in RUN_TABLES:
        for _ in range(2):
            store.append(name, rows.filter("run_id < 3"), "first")
        store.append(name, rows.filter("run_id >= 2"), "second")
        assert store.read(name).count() == 12 and set(store.read(name).columns) == {"run_id", "v"}
    for _ in range(2):
        store.purge(spark.createDataFrame([(2,)], "run_id int"))
        assert all({r.run_id for r in store.read(n).collect()} == {2} and store.read(n).count() == 6 for n in RUN_TABLES)


def test_upsert_is_stored_and_overwrites_with_nulls(spark):
    store = RunLogStore(spark, f"{stage_folder(spark)}/store-{uuid.uuid4().hex}")
    schema = "name string, gene_symbol string, wt_sequence string, wt_assay_score double"
    store.append("dataset", spark.createDataFrame([("a", "G", "AAA", 1.0), ("b", "H", "BBB", 2.0)], schema), "1")
    update = spark.createDataFrame([("a", None, None, 5.0), ("c", None, "CCC", None)], schema)
    for _ in range(2):
        store.replace("dataset", upsert_dataset(store.read("dataset"), update))
    assert sorted(tuple(r) for r in store.read("dataset").select("name", "gene_symbol", "wt_sequence", "wt_assay_score").collect()) == [
        ("a", "G", None, 5.0), ("b", "H", "BBB", 2.0), ("c", "c", "CCC", None)]


def test_stream_and_batch_share_a_table(spark):
    base = f"{stage_folder(spark)}/mixed-{uuid.uuid4().hex}"
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "run_id int, v string")
    rows.write.parquet(base + "/src")
    store = RunLogStore(spark, base + "/store")
    store.append("round", rows, "batch")
    stream = spark.readStream.schema(rows.schema).parquet(base + "/src")
    RS.sink_to_store(stream, base + "/store", "round", base + "/check", trigger_once=True).awaitTermination()
    assert sorted(tuple(r) for r in store.read("round").select("run_id", "v").collect()) == [(1, "x"), (1, "x"), (2, "y"), (2, "y")]


# ---- models ---------------------------------------------------------------

def test_pca_is_fitted_once_and_reused(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)) @ np.diag([5, 3, 1, 0.5, 0.1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    fit = FT.fit_pca(df.filter("id < 40"), "v", 2)
    got = np.array([r.pca for r in fit.transform(df.filter("id >= 40")).orderBy("id").collect()])
    centre = x[:40].mean(axis=0)
    axes = np.linalg.svd(x[:40] - centre, full_matrices=False)[2][:2]
    assert np.abs(got) == pytest.approx(np.abs((x[40:] - centre) @ axes.T), abs=1e-8)
    small = df.limit(2)
    assert FT.fit_pca(small, "v", 2).transform(small).first().pca == small.first().v


def test_bagged_ridge_matches_each_members_closed_form(spark):
    rng = np.random.default_rng(5)
    x, e = rng.normal(size=(80, 3)), rng.normal(size=80)
    y = x @ [1.0, -2.0, 0.5] + 0.3 * e + 4
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(80)], "id long, v array<double>, y double")
    models = M.fit_bagged_ridge(df, "v", "y", "id", members=3, alpha=2.0)
    for m, model in enumerate(models):
        w = np.array([r.w for r in df.select("id", M.poisson1(seeded_uniform(F.lit(42 * 1000 + m), "id")).alias("w")).orderBy("id").collect()])
        xm, ym = np.average(x, axis=0, weights=w), np.average(y, weights=w)
        a = ((x - xm).T * w) @ (x - xm) + 2.0 * np.eye(3)
        assert model.coefficients.toArray() == pytest.approx(np.linalg.solve(a, ((x - xm).T * w) @ (y - ym)), abs=1e-8)


def test_group_ridge_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g int, x array<double>, y double")
    assert M.group_ridge(df, ["g"], "x", "y").collect() == []


def test_mixture_is_diagonal_and_finds_two_groups(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal([-3, 0], [0.5, 1.5], (300, 2)), rng.normal([3, 1], [1.0, 0.3], (100, 2))])
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)], "seq_id long, pos int, vec array<double>")
    w, mu, var = FT.fit_gmm(df, 2)
    low = int(mu[0][0] > mu[1][0])
    assert w[low] == pytest.approx(0.75, abs=0.02)
    assert np.array(mu)[[low, 1 - low]] == pytest.approx(np.array([[-3, 0], [3, 1]]), abs=0.25)
    assert np.sqrt(np.array(var))[[low, 1 - low]] == pytest.approx(np.array([[0.5, 1.5], [1.0, 0.3]]), abs=0.15)

    def mean_ll(w, mu, var):
        d = x[:, None, :] - np.array(mu)
        lp = np.log(w) - 0.5 * (np.log(2 * np.pi * np.array(var)) + d * d / var).sum(axis=2)
        return np.log(np.exp(lp).sum(axis=1)).mean()

    assert mean_ll(w, mu, var) > mean_ll([0.5, 0.5], [[-2, 0], [2, 0]], [[1, 1], [1, 1]])
    got = FT.with_posteriors(df, w, mu, var).agg(F.avg("ll")).first()[0]
    assert got == pytest.approx(mean_ll(w, mu, var), abs=1e-9)


def test_bimodal_threshold_of_every_key(spark):
    rng = np.random.default_rng(2)
    rows = [("a", v) for v in np.concatenate([rng.normal(0, 0.5, 200), rng.normal(6, 1, 300)])]
    rows += [(None, v) for v in np.concatenate([rng.normal(-10, 1, 100), rng.normal(10, 1, 100)])] + [("flat", 1.0)] * 5
    got = {r.k: r for r in FT.bimodal_threshold(spark.createDataFrame([(k, float(v)) for k, v in rows], "k string, v double"), "v", ["k"],
                                               starts=4).collect()}
    assert set(got) == {"a", None}
    assert (got["a"].mean_low, got["a"].mean_high) == (pytest.approx(0, abs=0.2), pytest.approx(6, abs=0.3))
    assert 1 < got["a"].threshold < 4 and -7 < got[None].threshold < 7


def _em(values, start, tol, cap):
    """Two components of one variable by plain EM: (log-likelihood, means), and the iterations it took."""
    v = np.array(values)
    sd, w = v.std(), 0.5
    mu = v.mean() + np.array([-1, 1]) * sd * (start + 1) / 4
    var, before = np.array([sd ** 2] * 2), None
    for i in range(cap):
        f = np.array([w, 1 - w])[:, None] * np.exp(-(v - mu[:, None]) ** 2 / (2 * var[:, None])) / np.sqrt(2 * np.pi * var[:, None]) + 1e-300
        r, ll = f / f.sum(axis=0), np.log(f.sum(axis=0)).sum()
        n = np.maximum(r.sum(axis=1), 1e-12)
        w, mu = n[0] / n.sum(), (r * v).sum(axis=1) / n
        var = np.maximum((r * v * v).sum(axis=1) / n - mu ** 2, 1e-9)
        if before is not None and abs(ll - before) < tol * len(v):
            break
        before = ll
    return ll, mu, i + 1


def test_bimodal_fit_stops_where_each_start_does(spark, monkeypatch):
    rng = np.random.default_rng(3)
    near = np.round(np.concatenate([rng.normal(0, 1, 150), rng.normal(2.5, 1, 150)]), 3).tolist()
    apart = np.round(np.concatenate([rng.normal(0, 1, 80), rng.normal(30, 1, 120)]), 3).tolist()
    fits = {k: [_em(x, s, 1e-3, 100) for s in range(3)] for k, x in (("near", near), ("apart", apart))}
    written, write = [], FT.materialize
    monkeypatch.setattr(FT, "materialize", lambda df, tag="stage", **o: (written.append(tag), write(df, tag, **o))[1])
    rows = [("near", x) for x in near] + [("apart", x) for x in apart]
    got = FT.bimodal_threshold(spark.createDataFrame(rows, "k string, v double"), "v", ["k"], starts=3).collect()
    for r in got:
        _, mu, _ = max(fits[r.k], key=lambda f: f[0])
        assert np.allclose([r.mean_low, r.mean_high], sorted(mu), atol=1e-6)
    assert len(got) == 2 and written.count("mixture") == max(f[2] for x in fits.values() for f in x) < 100
