from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parent)]

from llm_samples import SCHEMA, doc, prose


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows, clashing column names."""
    near = prose(1, 300)
    rows = [doc(k, prose(10 + k, 40 + 13 * k), f"s{k % 4}") for k in range(12)]
    rows += [doc(20, near), doc(21, near), doc(22, near.replace("stones", "pebbles", 1)), doc(23, near + " end"), doc(23, near + " end")]
    rows += [doc(30, None), doc(31, ""), doc(32, " \n\t "), doc(33, "one"), doc(34, "one two three four", None), doc(None, "no id here at all", None), doc(None, None, None)]
    rows += [doc(40, "lone" * 30_000, "s2"), doc(41, prose(99, 20_000), "s3"), doc(42, "ünï©ødé 日本語 \u0000 \U0001f600 " * 40)]
    rows += [(None,) * 11, (None,) * 11]
    return rows


@pytest.fixture
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(5)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
