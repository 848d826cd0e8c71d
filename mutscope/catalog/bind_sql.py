"""DuckDB twins of ``mutscope.sources.bindings`` for the SQL oracles.

``with_(...)`` returns a ``WITH`` clause holding the requested binding views
and everything they depend on, in dependency order.
"""

from __future__ import annotations

AA = "ACDEFGHIKLMNPQRSTVWY"

_DEFS: dict[str, tuple[tuple[str, ...], str]] = {
    "b_run": ((), """
        SELECT r_regionkey AS run_id, 'al_sweep' AS name, r_name AS descrip,
               'c' || CAST(r_regionkey % 2 AS VARCHAR) AS config_id,
               'ds' || CAST(r_regionkey % 2 AS VARCHAR) AS dataset_name,
               'esm2_t' || CAST(r_regionkey * 6 + 6 AS VARCHAR) || '_model' AS embedder_model_name,
               CAST(10 AS INTEGER) AS num_rounds,
               CAST((r_regionkey + 1) * 100 AS INTEGER) AS num_variants,
               CAST(r_regionkey + 10 AS INTEGER) AS num_variants_first_round,
               CAST(r_regionkey % 2 + 1 AS INTEGER) AS num_top_acq_var_per_round,
               CAST(3 AS INTEGER) AS num_top_pred_var_per_round,
               CASE WHEN r_regionkey <> 0 THEN CAST(5 AS INTEGER) END AS num_top_n_pred_per_round,
               CAST(25.0 AS DOUBLE) AS wt_assay_score,
               (r_regionkey % 2 = 0) AS save_all_predictions,
               CAST('2023-12-2' || CAST(r_regionkey + 1 AS VARCHAR) AS TIMESTAMP) AS start_ts,
               CASE WHEN r_regionkey <> 2
                    THEN CAST('2024-01-0' || CAST(5 - r_regionkey AS VARCHAR) AS TIMESTAMP) END AS end_ts
        FROM region"""),
    "b_sub_run": ((), """
        SELECT n_nationkey AS sub_run_id, n_regionkey AS run_id, n_name AS strategy_name,
               CASE WHEN n_nationkey % 3 = 0 THEN 'rf' WHEN n_nationkey % 3 = 1 THEN 'ridge'
                    ELSE 'llr' END AS model_name,
               'random' AS first_round_strategy_name,
               '{"alpha": ' || CAST(n_nationkey % 4 + 1 AS VARCHAR) || ', "n_estimators": '
                 || CAST(n_nationkey + 50 AS VARCHAR) || '}' AS model_parameters
        FROM nation"""),
    "b_simulation": ((), """
        SELECT c_custkey AS simulation_id, c_nationkey AS sub_run_id,
               c_custkey // 25 AS simulation_num
        FROM customer"""),
    "b_round0": ((), """
        SELECT o_orderkey, o_custkey, o_totalprice AS t,
               CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
                    AS INTEGER) AS round_num
        FROM orders"""),
    "b_round": (("b_round0",), """
        SELECT o_orderkey AS round_id, o_custkey AS simulation_id, round_num,
               fmod(t, 1000) / 1000.0::DOUBLE + 0.0::DOUBLE AS train_rmse,
               1 - (fmod(t, 997) / 500.0::DOUBLE + 0.0::DOUBLE) AS train_r2,
               CASE WHEN round_num <> 1 THEN fmod(t, 991) / 991.0::DOUBLE + (-0.5)::DOUBLE END AS train_spearman,
               fmod(t, 983) / 983.0::DOUBLE + 0.1::DOUBLE AS validation_rmse,
               1 - (fmod(t, 977) / 400.0::DOUBLE + 0.0::DOUBLE) AS validation_r2,
               CASE WHEN round_num <> 1 THEN fmod(t, 971) / 971.0::DOUBLE + (-0.3)::DOUBLE END AS validation_spearman,
               fmod(t, 967) / 967.0::DOUBLE + 0.2::DOUBLE AS test_rmse,
               1 - (fmod(t, 953) / 450.0::DOUBLE + 0.0::DOUBLE) AS test_r2,
               CASE WHEN round_num <> 1 THEN fmod(t, 947) / 947.0::DOUBLE + (-0.4)::DOUBLE END AS test_spearman
        FROM b_round0"""),
    "b_top_variant": ((), """
        SELECT l_orderkey AS round_id, CAST(l_partkey AS VARCHAR) AS variant_id,
               'v' || CAST(l_partkey AS VARCHAR) AS variant_name,
               l_quantity AS assay_score, l_extendedprice / 2503.0::DOUBLE AS prediction_score
        FROM lineitem"""),
    "b_acquired": ((), """
        SELECT l_orderkey AS round_id, CAST(l_partkey AS VARCHAR) AS variant_id,
               l_quantity AS assay_score, l_extendedprice / 2503.0::DOUBLE AS prediction_score,
               l_extendedprice / 2503.0::DOUBLE + l_discount * 10 AS acquisition_score,
               l_linenumber <= 2 AS top_acquisition_score,
               l_linenumber > 2 AS top_prediction_score
        FROM lineitem"""),
    "b_last_round": (("b_round", "b_top_variant"), """
        SELECT r.simulation_id, tv.variant_id, tv.assay_score, tv.prediction_score
        FROM b_top_variant tv
        JOIN b_round r ON tv.round_id = r.round_id
        WHERE r.round_num = (SELECT max(r2.round_num) FROM b_round r2
                             WHERE r2.simulation_id = r.simulation_id)"""),
    "b_dataset": ((), f"""
        SELECT dataset_name,
               array_to_string(list_transform(range(1, 51), lambda i: substr('{AA}',
                   CAST((i * 7 + CAST(regexp_extract(dataset_name, '#(\\d+)', 1) AS INTEGER)) % 20 + 1
                        AS INTEGER), 1)), '') AS wt_sequence
        FROM (SELECT DISTINCT p_brand AS dataset_name FROM part)"""),
    "b_variant": ((), f"""
        SELECT p_brand AS dataset_name, p_partkey AS part_id, p_size AS position,
               substr('{AA}', CAST((p_size * 7 + CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS INTEGER)) % 20 + 1 AS INTEGER), 1) AS ref_aa,
               substr('{AA}', CAST(p_partkey % 20 + 1 AS INTEGER), 1) AS alt_aa,
               substr('{AA}', CAST((p_size * 7 + CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS INTEGER)) % 20 + 1 AS INTEGER), 1)
                 || CAST(p_size AS VARCHAR)
                 || substr('{AA}', CAST(p_partkey % 20 + 1 AS INTEGER), 1) AS variant_id,
               p_retailprice / 1000.0::DOUBLE AS assay_score
        FROM part"""),
    "b_pred": ((), """
        SELECT o.o_orderkey AS id, o.o_custkey AS sim_key, o.o_totalprice / 100003.0::DOUBLE AS score,
               li.components
        FROM orders o
        LEFT JOIN (SELECT l_orderkey, list_sort(list(l_extendedprice / 100003.0::DOUBLE)) AS components
                   FROM lineitem GROUP BY l_orderkey) li ON o.o_orderkey = li.l_orderkey"""),
}


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for dep in _DEFS[n][0]:
            visit(dep)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_(*names: str, extra: dict[str, str] | None = None) -> str:
    """WITH clause for the given binding views plus ``extra`` named CTEs (kept in order)."""
    parts = [f"{n} AS ({_DEFS[n][1]})" for n in _order(names)]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v})")
    return "WITH " + ",\n".join(parts) + "\n"


def rounded(sql: str, *cols: str, digits: int = 6, arrays: tuple[str, ...] = ()) -> str:
    """Wrap ``sql`` so the named double columns are rounded like ``util.finish``
    (the same IEEE expression in both engines, so ties round identically)."""
    if not cols and not arrays:
        return sql
    scale = f"{10 ** digits}.0::DOUBLE"

    def r(x):
        return f"CASE WHEN abs({x}) < 1e15 THEN floor({x} * {scale} + 0.5) / {scale} ELSE {x} END"

    parts = [f"{r(c)} AS {c}" for c in cols]
    parts += [f"list_transform({c}, lambda v: {r('CAST(v AS DOUBLE)')}) AS {c}" for c in arrays]
    repl = ", ".join(parts)
    return f"SELECT * REPLACE ({repl}) FROM ({sql}) _q"
