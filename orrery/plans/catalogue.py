"""Loads every module that registers queries."""

from __future__ import annotations

from orrery.plans import loader_queries, metric_queries, model_queries, moment_queries, registry, search_queries  # noqa: F401


def load():
    return registry
