"""Imports every query module so that the registry is complete."""

from __future__ import annotations

from . import q_agg, q_clean, q_dfs, q_encode, q_mart, q_model, q_neighbours, q_rank, q_scalar, q_search, q_sources, q_trees  # noqa: F401
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
