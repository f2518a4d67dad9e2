"""Operators of a training-data pipeline, their queries and SQL. Nothing else in the library imports this."""

from __future__ import annotations


def load_queries():
    """(queries, their SQL) of the subpackage, and of the pipeline at the repository top."""
    from importlib import import_module

    from .registry import ORACLE, QUERIES
    for module in ("pii", "toxicity", "mixing", "bpe", "sharding", "fingerprints", "topk", "jaccard_join", "suffix_dedup", "licenses", "line_dedup", "centroids", "filter_audit", "pipeline_query"):
        import_module(f"{__name__}.{module}")
    return QUERIES, ORACLE
