"""A per-module registry of (query, oracle SQL) pairs."""

from __future__ import annotations


def make_registry():
    queries: dict = {}
    oracles: dict[str, str] = {}

    def register(name: str, oracle: str | None = None):
        def deco(fn):
            if name in queries:
                raise ValueError(f"query {name} registered twice")
            queries[name] = fn
            if oracle is not None:
                oracles[name] = oracle
            return fn
        return deco

    return queries, oracles, register
