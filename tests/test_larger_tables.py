"""Queries on tables that repeat the smallest ones with shifted keys, beside their SQL: what a larger driver table looks like."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import __spark_entry__ as entry
import check_oracle

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="driver tables are not here")


def status(spark, folder, table, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return check_oracle.compare(spark, con, name, str(folder), entry.queries()[name], entry.oracle_sql()[name])[::3]


@pytest.mark.parametrize("name", ["stream_stuck_r2", "stream_failures_r3", "stream_stalls_r4"])
def test_alerts_where_times_run_against_numbers(spark, tmp_path, name):
    duckdb.sql(f"COPY (SELECT * REPLACE (event_id + 1000 * c AS event_id) FROM '{SF}/events.parquet', range(3) t(c)) TO '{tmp_path}/events.parquet'")
    assert status(spark, tmp_path, "events", name) == ("ok", "")


def test_session_files_and_folders_do_not_grow_with_documents_alone(spark, tmp_path):
    from trajspark.plans.storage import read_text_documents, written_sessions
    duckdb.sql(f"COPY (SELECT * REPLACE (event_id + 1000 * c AS event_id) FROM '{SF}/events.parquet', range(20) t(c)) TO '{tmp_path}/events.parquet'")
    root = Path(written_sessions(spark, str(tmp_path)))
    assert len(list(root.glob("part=*/name=*"))) == 4 and len(list(root.rglob("*.txt"))) <= 50      # 200 documents, 4 of them broken
    assert read_text_documents(spark, str(root)).count() == 200


def test_pieces_of_hot_groups_do_not_grow_with_the_limit_alone(spark):
    from pyspark.sql import functions as F
    from trajspark.operators.ordered import OrderedRows
    d = spark.range(20_000).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"))
    rows = OrderedRows(d, "k", "o", 10).position("p").previous("b", F.col("o"), 1)
    assert rows._parts[1][0].select("_segment").distinct().count() <= 64
    assert rows.df().filter("p <> o div 2 + 1 or size(b) <> if(p = 1, 0, 1) or (p > 1 and b[0] <> o - 2)").isEmpty()
