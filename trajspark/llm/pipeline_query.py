"""The pipeline at the repository top, as a query."""

from __future__ import annotations

import corpus_pipeline

from .registry import query


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
