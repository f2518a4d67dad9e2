"""Queries on the driver tables and end-to-end jobs."""

from __future__ import annotations

from importlib import import_module

THEMES = ("scoring", "run_reports", "ordering", "geometry_checks", "records", "corpus", "storage", "live_log", "edge_cases")


def load_queries():
    """(queries, their SQL) of all themes."""
    from .registry import ORACLE, QUERIES
    for t in THEMES:
        import_module(f"{__name__}.{t}")
    return QUERIES, ORACLE
