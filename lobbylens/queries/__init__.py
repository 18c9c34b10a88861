"""The checked queries, grouped by topic."""

from __future__ import annotations

from importlib import import_module

TOPICS = ("catalog", "frames", "events", "scores", "streams")


def collect() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for topic in TOPICS:
        registry = import_module(f"lobbylens.queries.{topic}").R
        queries.update(registry.queries)
        oracles.update(registry.oracles)
    return queries, oracles
