from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from trajspark.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[*]", 8, spark__ui__enabled="false", spark__driver__memory="8g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def value(spark):
    """Evaluate a column on one row."""
    def run(column):
        return spark.range(1).select(column.alias("v")).first()[0]
    return run
