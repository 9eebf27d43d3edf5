"""Queries over the supplied tables."""

from __future__ import annotations

import importlib

_MODULES = [
    "audit_queries",
    "text_queries",
    "metric_queries",
    "feature_queries",
    "model_queries",
    "leakage_queries",
    "calibration_queries",
    "stream_queries",
]


def load():
    """Import every query module and return ``(queries, sql)``."""
    from recordlens.workload import registry

    for name in _MODULES:
        importlib.import_module(f"recordlens.workload.{name}")
    return registry.QUERIES, registry.SQL
