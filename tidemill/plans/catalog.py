"""All registered queries."""

from __future__ import annotations

import importlib

from tidemill.plans.registry import QUERIES

MODULES = [
    "queries_models",
    "queries_loads",
    "queries_quality",
    "queries_anomalies",
    "queries_remediate",
    "queries_learning",
    "queries_observe",
    "queries_log",
    "queries_workload",
    "queries_model_stream",
]

for _module in MODULES:
    importlib.import_module(f"tidemill.plans.{_module}")

__all__ = ["QUERIES"]
