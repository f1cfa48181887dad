"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from . import audit, exact_dedup, mixing, negatives, packing, pii, pu_quality, quality, secrets, sharding, simhash, substring, toxicity

MODULES = [secrets, simhash, mixing, pii, exact_dedup, toxicity, substring, sharding, packing, quality, negatives, pu_quality, audit]


def queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
