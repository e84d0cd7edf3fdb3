"""Imports every query module of the subpackage."""

from __future__ import annotations

from . import bpe_transducer, collocations, decontaminate, hash_forest, license_scan, mixing, ngram_join, quality_cnn, rlz_dedup, secret_scan, sharding, token_alignment, toxicity  # noqa: F401
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
