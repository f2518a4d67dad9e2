"""The pipeline, stage by stage against brute force, and the queries on the smallest tables."""

from __future__ import annotations

import hashlib
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from trajspark.llm import load_queries, mixing, pii

SF = "/root/testdata/sf0.001"
with_tables = pytest.mark.skipif(not Path(SF).is_dir(), reason="driver tables are not here")


@with_tables
def test_stages_take_edge_rows(spark, edge, empty):
    for docs in (edge, empty):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.filter("not restored").count() == 0
        assert docs.columns == ["doc_id", "source", "n_tokens", "token_ids", "restored"]


def test_mixing_stage_repeats_and_cuts(spark, edge):
    out = corpus_pipeline.mix_sources(spark, edge, SF)
    taken = {r[0]: r[1] for r in mixing.mix(edge, prefix="m_").groupBy("source").agg(F.sum("m_taken")).collect() if r[1]}
    words = {r[0]: r[1] for r in out.groupBy("source").agg(F.sum(mixing.count_words(F.col("text")))).collect()}
    assert words == taken
    assert out.filter(F.col("n_chars") != F.length("text")).count() == 0


def test_redaction_stage(spark):
    docs = spark.createDataFrame([(1, "mail ann@x.org now", "en", "s", 18), (2, None, "en", "s", None), (3, "clean text", "en", "s", 10)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(corpus_pipeline.redact_personal_data(spark, docs, SF).collect())
    assert [(r["text"], r["n_chars"]) for r in got] == [("mail [EMAIL] now", 16), (None, None), ("clean text", 10)]


@with_tables
def test_queries_run(spark):
    queries, oracle = load_queries()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    # one row per vector; 120 orders of five steps per source
    other = {"op12_orchard_clusters": spark.read.parquet(f"{SF}/embeddings.parquet").count(), "op13_filter_audit": 600 * docs.select("source").distinct().count()}
    for name, q in queries.items():
        rows = q(spark, SF).count()
        assert rows == other.get(name, n) or name in ("op4_license_scan", "op10_mtree_top_k", "pipeline"), name
    assert set(oracle) <= set(queries)


@with_tables
def test_pii_query_digests(spark):
    queries, _ = load_queries()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries["op2_pii_boosting"](spark, SF).collect():
        base = pii.base_spans(texts[r["doc_id"]])
        line = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and r["n_email"] == sum(k == "email" for _, _, k in base)
        assert set(line.split(",")) - {""} <= set(r["spans"].split(","))
