"""The registered query catalogue: Spark queries and their DuckDB oracles."""

from __future__ import annotations

import importlib

_MODULES = [
    "rivulet.plans.q_topics",
    "rivulet.plans.q_tables",
    "rivulet.plans.q_stream",
    "rivulet.plans.q_rules",
    "rivulet.plans.q_datasets",
    "rivulet.plans.q_service",
    "rivulet.plans.q_passthrough",
]


def _load():
    queries, oracles = {}, {}
    for name in _MODULES:
        mod = importlib.import_module(name)
        for k in mod.QUERIES:
            if k in queries:
                raise ValueError(f"query {k} registered twice")
        queries.update(mod.QUERIES)
        oracles.update(mod.ORACLES)
    return queries, oracles


def all_queries():
    return _load()[0]


def all_oracles():
    return _load()[1]
