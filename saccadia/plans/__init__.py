"""Queries over the driver's tables."""

import importlib

MODULES = ["queries_sources", "queries_signal", "queries_features", "queries_space", "queries_fusion", "queries_stats", "queries_insight", "queries_models", "queries_streaming", "queries_plugins"]


def load_queries():
    from saccadia.plans import catalog

    for name in MODULES:
        importlib.import_module(f"saccadia.plans.{name}")
    return catalog.QUERIES, catalog.ORACLES
