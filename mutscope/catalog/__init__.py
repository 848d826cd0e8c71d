"""Registered queries (one per operator of SURVEY §2) and their SQL oracles."""

from . import eval_q, features_q, runlog_q, selection_q, sources_q, stats_q, variants_q  # noqa: F401  (registers entries)
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
