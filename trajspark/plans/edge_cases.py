"""Operators on null keys, very long keys and odd texts, with the size switches turned both ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import actions as A
from ..functions.udfs import token_counter
from ..operators import conformance as O
from ..operators import matching as J
from ..operators import quality as Q
from ..operators import splits as U
from ..operators.ordered import OrderedRows
from ..operators.ranking import global_rank
from . import tables as D
from .jobs import sample_order
from .registry import query


@query("respect_holdout_nulls_u5", """SELECT part, count(*) AS n FROM (
  SELECT CASE WHEN doc_id % 7 <> 0 AND doc_id % 6 = 0 THEN 'held_out' ELSE 'pool' END AS part FROM documents) GROUP BY part""")
def _(s, sf):
    i = F.col("doc_id")
    d = D.table(s, sf, "documents").select("doc_id", F.when(i % 7 == 0, None).when(i % 6 == 0, "test").otherwise("train").alias("split"))
    pool, held = U.respect_holdout(d)
    return pool.withColumn("part", F.lit("pool")).unionByName(held.withColumn("part", F.lit("held_out"))).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


LOOKUP_SQL = "SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 0 THEN c_name END AS c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey"


def looked_up(s, sf, **kw):
    rows = D.table(s, sf, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("c_custkey"))
    return J.lookup_join(rows, D.table(s, sf, "customer").select("c_custkey", "c_name"), "c_custkey", **kw).select("o_orderkey", "c_name")


@query("lookup_join_nulls_j1", LOOKUP_SQL)
def _(s, sf):
    return looked_up(s, sf)


@query("lookup_join_nulls_hot_j1", LOOKUP_SQL)
def _(s, sf):
    return looked_up(s, sf, max_rows=0, hot_rows=10)


@query("sample_order_long_keys_t10", """SELECT doc_id, row_number() OVER (ORDER BY length(k), k) AS place FROM (
  SELECT doc_id, (doc_id + 1) || '0' || repeat('7', CAST(doc_id % 25 AS INT)) AS k FROM documents)""")
def _(s, sf):
    k = F.concat((F.col("doc_id") + 1).cast("string"), F.lit("0"), F.expr("repeat('7', cast(doc_id % 25 as int))"))
    d = D.table(s, sf, "documents").select("doc_id", k.alias("k")).withColumn("o", sample_order("k"))
    return global_rank(d, ["o"], "place").select("doc_id", "place")


NULL_KEY_SQL = """SELECT event_id, count(*) OVER (PARTITION BY k ORDER BY event_id) AS place, max(event_id) OVER (PARTITION BY k ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS before
 FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS k FROM events)"""


def null_keyed(s, sf, hot_rows):
    d = D.table(s, sf, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("k"))
    o = OrderedRows(d, "k", "event_id", hot_rows).position("place").previous("_b", F.col("event_id"), 1).df()
    return o.select("event_id", F.col("place").cast("long").alias("place"), F.try_element_at("_b", F.lit(1)).alias("before"))


@query("ordered_null_keys_w1", NULL_KEY_SQL)
def _(s, sf):
    return null_keyed(s, sf, None)


@query("ordered_null_keys_cut_w1", NULL_KEY_SQL)
def _(s, sf):
    return null_keyed(s, sf, 100)


@query("quoted_odd_letters_p28", r"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '''a\r\u3000\xa0' || doc_id || '''' WHEN 1 THEN '"it''s\x00\u200b' || doc_id || '"' ELSE '''plain 中文 ' || doc_id || '''' END AS shown FROM documents""")
def _(s, sf):
    i = F.col("doc_id")
    t = F.when(i % 3 == 0, F.lit("a\r\u3000\u00a0")).when(i % 3 == 1, F.lit("it's\x00\u200b")).otherwise(F.lit("plain 中文 "))
    return D.table(s, sf, "documents").select("doc_id", A.quoted(F.concat(t, i.cast("string"))).alias("shown"))


@query("length_filter_hook_f1_q7", """SELECT doc_id, len(string_split(text, ' ')) AS tokens FROM documents WHERE len(string_split(text, ' ')) <= 300""")
def _(s, sf):
    count = token_counter(lambda text: text.count(" ") + 1)
    d = D.table(s, sf, "documents").select("doc_id", "text").withColumn("tokens", count(F.col("text")))
    return Q.length_filter(d, F.col("tokens"), 300)[0].select("doc_id", "tokens")


@query("parse_outputs_malformed_points_q12", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'bad_point' WHEN 1 THEN 'bad_point' WHEN 2 THEN 'bad_point' WHEN 3 THEN 'bad_point' END AS reject_reason FROM events""")
def _(s, sf):
    m = F.col("event_id") % 6
    act = (F.when(m == 0, '{"type": "type", "text": "a", "point": "x"}').when(m == 1, '{"type": "wait", "point": [0.5, "a"]}')
           .when(m == 2, '{"type": "click", "point": [0.5]}').when(m == 3, '{"type": "click", "point": [0.5, 0.5], "point2": {"x": 1}}')
           .when(m == 4, '{"type": "click", "point": [0.5, 1e-1], "point2": null}').otherwise('{"type": "wait"}'))
    d = D.table(s, sf, "events").select("event_id", F.concat(F.lit('ok {"thought": "", "action": '), act, F.lit("}")).alias("raw"))
    return O.parse_outputs(d).select("event_id", "reject_reason")
