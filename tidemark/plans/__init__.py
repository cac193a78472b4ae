"""Registered queries over the driver tables."""

import importlib

_MODULES = ("q_opinions", "q_documents", "q_stores", "q_series", "q_signals", "q_relevance", "q_streams")


def all_queries():
    from tidemark.plans.registry import ORACLES, QUERIES

    for module in _MODULES:
        try:
            importlib.import_module(f"tidemark.plans.{module}")
        except ModuleNotFoundError as exc:
            if exc.name != f"tidemark.plans.{module}":
                raise
    return QUERIES, ORACLES
