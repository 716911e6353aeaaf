"""Registered queries, grouped by area."""

import importlib

MODULES = ["feature_queries", "clean_queries", "report_queries", "veto_queries", "model_queries", "experiment_queries", "stream_queries", "fit_queries", "profile_queries", "long_report_queries", "path_queries"]


def load_all() -> None:
    """Imports every query module once, which registers its queries."""
    for name in MODULES:
        importlib.import_module(f"rivalry.plans.{name}")
