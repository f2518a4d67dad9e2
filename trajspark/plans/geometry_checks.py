"""Driver-table queries for coordinates, boxes and points in boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import matching as J
from ..operators import selection as S
from ..operators.counts import rate_table
from . import tables as D
from .registry import query, with_


def r(c, name=None):
    return F.round(c, 6).alias(name or c)


def r4(b):
    return [F.round(F.col(b)[k], 6).alias(k) for k in ("x1", "y1", "x2", "y2")]


def emb(s, sf):
    return D.table(s, sf, "embeddings")


U = D.unit_sql


@query("to_unit_p5", f"""WITH p AS (SELECT vec_id, {U(0)} * 2400 - 300 AS px, {U(1)} * 1300 - 150 AS py FROM embeddings)
SELECT vec_id, CASE WHEN ok THEN round(px / 1600, 6) END AS x, CASE WHEN ok THEN round(py / 900, 6) END AS y
FROM (SELECT *, px / 1600 BETWEEN 0 AND 1 AND py / 900 BETWEEN 0 AND 1 AS ok FROM p)""")
def _(s, sf):
    p = G.to_unit(D.unit(0) * 2400 - 300, D.unit(1) * 1300 - 150, F.lit(1600), F.lit(900))
    return emb(s, sf).select("vec_id", p.alias("p")).select("vec_id", r("p.x", "x"), r("p.y", "y"))


@query("to_pixel_p6", f"""SELECT vec_id, CAST(round_even({U(0)} * 1920, 0) AS INT) AS x, CAST(round_even({U(1)} * 1080, 0) AS INT) AS y,
 CAST(least(greatest(round_even(({U(0)} * 2 - 0.5) * 1920, 0), 0), 1919) AS INT) AS cx, CAST(least(greatest(round_even(({U(1)} * 2 - 0.5) * 1080, 0), 0), 1079) AS INT) AS cy FROM embeddings""")
def _(s, sf):
    a = G.to_pixel(G.point(D.unit(0), D.unit(1)), F.lit(1920), F.lit(1080))
    b = G.to_pixel(G.point(D.unit(0) * 2 - 0.5, D.unit(1) * 2 - 0.5), F.lit(1920), F.lit(1080), clamped=True)
    return emb(s, sf).select("vec_id", a["x"].alias("x"), a["y"].alias("y"), b["x"].alias("cx"), b["y"].alias("cy"))


@query("from_space_p7", f"""WITH p AS (SELECT vec_id, {U(0)} * 1200 AS cx, {U(1)} * 800 AS cy, CASE vec_id % 3 WHEN 0 THEN 1504 WHEN 1 THEN 1000 ELSE 1280 END AS dx,
  CASE vec_id % 3 WHEN 0 THEN 848 WHEN 1 THEN 1000 ELSE 720 END AS dy FROM embeddings)
SELECT vec_id, round(cx / dx, 6) AS x, round(cy / dy, 6) AS y, round(least(greatest(cx * 1.5 / dx, 0), 1), 6) AS lx, round(least(greatest(cy * 1.5 / dy, 0), 1), 6) AS ly FROM p""")
def _(s, sf):
    space = F.when(F.col("vec_id") % 3 == 0, "pixel").when(F.col("vec_id") % 3 == 1, "rel1000").otherwise("original")
    size = [F.lit(v) for v in (1280, 720, 1504, 848)]
    a = G.from_space(D.unit(0) * 1200, D.unit(1) * 800, space, *size)
    b = G.from_space(D.unit(0) * 1200 * 1.5, D.unit(1) * 800 * 1.5, space, *size, clamped=True)
    return emb(s, sf).select("vec_id", r(a["x"], "x"), r(a["y"], "y"), r(b["x"], "lx"), r(b["y"], "ly"))


@query("auto_unit_p8", f"""WITH p AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN {U(0)} ELSE {U(0)} * 1400 END AS x, CASE WHEN vec_id % 2 = 0 THEN {U(1)} ELSE {U(1)} * 900 END AS y FROM embeddings)
SELECT vec_id, round(CASE WHEN greatest(x, y) > 1 THEN least(x / 924, 1) ELSE x END, 6) AS x, round(CASE WHEN greatest(x, y) > 1 THEN least(y / 504, 1) ELSE y END, 6) AS y FROM p""")
def _(s, sf):
    even = F.col("vec_id") % 2 == 0
    d = emb(s, sf).select("vec_id", G.point(F.when(even, D.unit(0)).otherwise(D.unit(0) * 1400),
                                            F.when(even, D.unit(1)).otherwise(D.unit(1) * 900)).alias("p"))
    return d.withColumn("q", G.auto_unit("p", F.lit(924), F.lit(504))).select("vec_id", r("q.x", "x"), r("q.y", "y"))


BOX = f"least({U(2)}, {U(3)}) AS x1, least({U(4)}, {U(5)}) AS y1, greatest({U(2)}, {U(3)}) AS x2, greatest({U(4)}, {U(5)}) AS y2"


@query("rescale_box_p9", f"""SELECT vec_id, round(x1 * 1280 * (924.0::DOUBLE / 1280), 6) AS x1, round(y1 * 720 * (504.0::DOUBLE / 720), 6) AS y1,
 round(x2 * 1280 * (924.0::DOUBLE / 1280), 6) AS x2, round(y2 * 720 * (504.0::DOUBLE / 720), 6) AS y2 FROM (SELECT vec_id, {BOX} FROM embeddings)""")
def _(s, sf):
    b = D.unit_box(2)
    px = G.box(b["x1"] * 1280, b["y1"] * 720, b["x2"] * 1280, b["y2"] * 720)
    d = emb(s, sf).select("vec_id", px.alias("b"))
    return d.withColumn("q", G.rescale_box("b", F.lit(1280), F.lit(720), F.lit(924), F.lit(504))).select("vec_id", *r4("q"))


CROP_SQL = f"""t AS (SELECT vec_id, {U(0)} * 1400 AS bx, {U(1)} * 5600 AS by_, abs({U(2)} - {U(3)}) * 400 AS bw, abs({U(4)} - {U(5)}) * 300 AS bh,
  CASE WHEN vec_id % 5 = 0 THEN 900 ELSE 1400 END AS w, CASE WHEN vec_id % 7 = 0 THEN 600 ELSE 5429 END AS h FROM embeddings),
win AS (SELECT *, CAST(trunc(least(greatest(bx + bw / 2 - 640, 0), greatest(w - 1280, 0))) AS INT) AS x0,
  CAST(trunc(least(greatest(by_ + bh / 2 - 360, 0), greatest(h - 720, 0))) AS INT) AS y0 FROM t),
win2 AS (SELECT *, least(x0 + 1280, w) AS x1, least(y0 + 720, h) AS y1 FROM win)"""


def crops(s, sf):
    d = emb(s, sf).select("vec_id", (D.unit(0) * 1400).alias("bx"), (D.unit(1) * 5600).alias("by"),
                          (F.abs(D.unit(2) - D.unit(3)) * 400).alias("bw"), (F.abs(D.unit(4) - D.unit(5)) * 300).alias("bh"),
                          F.when(F.col("vec_id") % 5 == 0, 900).otherwise(1400).alias("w"),
                          F.when(F.col("vec_id") % 7 == 0, 600).otherwise(5429).alias("h"))
    return d.withColumn("win", G.crop_window("bx", "by", "bw", "bh", "w", "h"))


@query("crop_window_p10", with_(CROP_SQL) + "SELECT vec_id, x0, y0, x1, y1 FROM win2")
def _(s, sf):
    return crops(s, sf).select("vec_id", "win.*")


@query("translate_box_p10", with_(CROP_SQL) + """, b AS (SELECT *, bx - x0 AS tx, by_ - y0 AS ty, x1 - x0 AS cw, y1 - y0 AS ch FROM win2),
ok AS (SELECT *, tx >= 0 AND tx < cw AND ty >= 0 AND ty < ch AS inside FROM b)
SELECT vec_id, CASE WHEN inside THEN round(least(greatest(tx, 0), cw), 6) END AS x1, CASE WHEN inside THEN round(least(greatest(ty, 0), ch), 6) END AS y1,
  CASE WHEN inside THEN round(least(greatest(tx + bw, 0), cw), 6) END AS x2, CASE WHEN inside THEN round(least(greatest(ty + bh, 0), ch), 6) END AS y2 FROM ok""")
def _(s, sf):
    d = crops(s, sf).withColumn("q", G.translate_box("bx", "by", "bw", "bh", "win"))
    return d.select("vec_id", *r4("q"))


@query("scale_factor_p11", """SELECT p_partkey, round(least(1.0::DOUBLE, 1280.0::DOUBLE / greatest(w, h), sqrt(1000000.0::DOUBLE / (CAST(w AS DOUBLE) * h))), 6) AS scale
FROM (SELECT p_partkey, p_size * 60 AS w, (p_partkey % 40 + 1) * 50 AS h FROM part)""")
def _(s, sf):
    d = D.table(s, sf, "part").select("p_partkey", (F.col("p_size") * 60).alias("w"), ((F.col("p_partkey") % 40 + 1) * 50).alias("h"))
    return d.select("p_partkey", r(G.scale_factor("w", "h", 1280, 1_000_000), "scale"))


@query("quad_to_box_p12", f"""WITH q AS (SELECT vec_id, [{', '.join(f'{U(i)} * 1.4 - 0.2' for i in (0, 2, 4, 6))}] AS xs, [{', '.join(f'{U(i)} * 1.4 - 0.2' for i in (1, 3, 5, 7))}] AS ys FROM embeddings)
SELECT vec_id, round(least(1, greatest(0, list_min(xs) * 1920 / 1920)), 6) AS x1, round(least(1, greatest(0, list_min(ys) * 1080 / 1080)), 6) AS y1,
 round(least(1, greatest(0, list_max(xs) * 1920 / 1920)), 6) AS x2, round(least(1, greatest(0, list_max(ys) * 1080 / 1080)), 6) AS y2 FROM q""")
def _(s, sf):
    quad = F.array(*[G.point((D.unit(i) * 1.4 - 0.2) * 1920, (D.unit(i + 1) * 1.4 - 0.2) * 1080) for i in (0, 2, 4, 6)])
    d = emb(s, sf).select("vec_id", G.quad_to_box(quad, F.lit(1920), F.lit(1080)).alias("q"))
    return d.select("vec_id", *r4("q"))


@query("box_center_p13", with_(D.boxes_sql()) + "SELECT box_id, round((x1 + x2) / 2, 6) AS x, round((y1 + y2) / 2, 6) AS y FROM boxes")
def _(s, sf):
    c = G.box_center("bbox")
    return D.boxes(s, sf).select("box_id", r(c["x"], "x"), r(c["y"], "y"))


# --- points in boxes --------------------------------------------------------------

@query("locate_points_j3", with_(D.POINTS_SQL, D.boxes_sql()) + """SELECT point_id, box_id, box_text FROM points LEFT JOIN (
 SELECT point_id, box_id, text AS box_text, row_number() OVER (PARTITION BY point_id ORDER BY (x2 - x1) * (y2 - y1), ord) AS rn
 FROM points p JOIN boxes b ON p.screen_id = b.screen_id AND p.x BETWEEN b.x1 - 0.01 AND b.x2 + 0.01 AND p.y BETWEEN b.y1 - 0.01 AND b.y2 + 0.01 AND trim(b.text) <> ''
) m USING (point_id) WHERE coalesce(rn, 1) = 1""")
def _(s, sf):
    return J.locate_points(D.points(s, sf), D.boxes(s, sf), pad=0.01).select("point_id", "box_id", "box_text")


COVER_SQL = D.ELEMENTS_SQL + """,
truth AS (SELECT o_orderkey AS truth_id, o_orderkey AS screen_id, CAST(o_custkey % 80 AS DOUBLE) / 100 AS tx1, CAST(o_orderkey % 60 AS DOUBLE) / 100 AS ty1,
  CASE WHEN o_orderstatus = 'F' THEN 'text' ELSE 'icon' END AS element_type FROM orders),
cov AS (SELECT t.*, EXISTS (SELECT 1 FROM elements e WHERE e.screen_id = t.screen_id AND (x1 + x2) / 2 BETWEEN tx1 AND tx1 + 0.3 AND (y1 + y2) / 2 BETWEEN ty1 AND ty1 + 0.3) AS covered FROM truth t)"""


def truth(s, sf):
    o = D.table(s, sf, "orders")
    x, y = (F.col("o_custkey") % 80) / 100.0, (F.col("o_orderkey") % 60) / 100.0
    return o.select(F.col("o_orderkey").alias("truth_id"), F.col("o_orderkey").alias("screen_id"), G.box(x, y, x + 0.3, y + 0.3).alias("bbox"),
                    F.when(F.col("o_orderstatus") == "F", "text").otherwise("icon").alias("element_type"))


@query("covered_j5", with_(COVER_SQL) + "SELECT truth_id, covered FROM cov")
def _(s, sf):
    return J.covered(truth(s, sf), D.elements(s, sf)).select("truth_id", "covered")


QUOTA4 = """, k AS (SELECT *, trim(text) <> '' AS named FROM elements WHERE trim(text) <> '' OR source = 'cv'),
c AS (SELECT *, row_number() OVER (PARTITION BY screen_id, named ORDER BY id) AS rn, count(*) FILTER (WHERE named) OVER (PARTITION BY screen_id) AS a,
        count(*) FILTER (WHERE NOT named) OVER (PARTITION BY screen_id) AS b FROM k),
q AS (SELECT *, least(least(greatest(2, 4 - a), 4), b) AS keep FROM c),
shown AS (SELECT * FROM q WHERE CASE WHEN named THEN rn <= least(a, 4 - keep) ELSE rn <= keep END),
cov2 AS (SELECT t.*, EXISTS (SELECT 1 FROM shown e WHERE e.screen_id = t.screen_id AND (x1 + x2) / 2 BETWEEN tx1 AND tx1 + 0.3 AND (y1 + y2) / 2 BETWEEN ty1 AND ty1 + 0.3) AS covered_shown FROM cov t)"""


@query("coverage_report_a14", with_(COVER_SQL) + QUOTA4 + """
SELECT 'all' AS dimension, 'all' AS value, count(*) FILTER (WHERE covered) AS hit, count(*) FILTER (WHERE covered_shown) AS hit_shown, count(*) AS total FROM cov2
UNION ALL SELECT 'element_type', element_type, count(*) FILTER (WHERE covered), count(*) FILTER (WHERE covered_shown), count(*) FROM cov2 GROUP BY element_type""")
def _(s, sf):
    el, t = D.elements(s, sf), truth(s, sf)
    shown = S.select_with_quota(el, limit=4, reserved=3).select("screen_id", "bbox", F.lit(True).alias("listed"))
    both = el.select("screen_id", "bbox", F.lit(False).alias("listed")).unionByName(shown)
    d = J.covered_by(t, both, {"covered": F.lit(True), "covered_shown": F.col("listed")})
    table = rate_table(d, F.col("covered"), ("element_type",), {"hit_shown": F.col("covered_shown")})
    return table.select("dimension", "value", "hit", "hit_shown", "total")


@query("elements_per_image_a14", with_(D.ELEMENTS_SQL) + """SELECT count(*) AS images, round(avg(n), 6) AS elements_per_image FROM (SELECT screen_id, count(*) AS n FROM elements GROUP BY 1)""")
def _(s, sf):
    per = D.elements(s, sf).groupBy("screen_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("images"), r(F.avg("n"), "elements_per_image"))


IOU = """(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))
 / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"""

MERGE_SQL = f"""WITH RECURSIVE {D.boxes_sql(2, 'p')}, {D.boxes_sql(6, 'c')},
allb AS (SELECT screen_id, 0 AS tier, ord, x1, y1, x2, y2 FROM p UNION ALL SELECT screen_id, 1, ord, x1, y1, x2, y2 FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY screen_id ORDER BY tier, ord) AS i FROM allb),
bad AS (SELECT a.screen_id, a.i AS ai, b.i AS bi FROM o a JOIN o b ON a.screen_id = b.screen_id AND a.i < b.i AND b.tier = 1 WHERE {IOU} > 0.3),
f AS (SELECT screen_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT screen_id FROM o)
  UNION ALL SELECT f.screen_id, f.i + 1, CASE WHEN EXISTS (SELECT 1 FROM bad WHERE bad.screen_id = f.screen_id AND bad.bi = f.i + 1 AND list_contains(f.kept, bad.ai)) THEN f.kept ELSE list_append(f.kept, f.i + 1) END
  FROM f WHERE f.i < (SELECT max(i) FROM o WHERE o.screen_id = f.screen_id)),
last AS (SELECT screen_id, arg_max(kept, i) AS kept FROM f GROUP BY 1)
SELECT o.screen_id, CAST(list_position(kept, o.i) - 1 AS INT) AS id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2
FROM o JOIN last ON o.screen_id = last.screen_id WHERE list_contains(kept, o.i)"""


def merge_inputs(s, sf):
    p = D.boxes(s, sf, 2).withColumn("source", F.lit("ocr"))
    return p, D.boxes(s, sf, 6).withColumn("source", F.lit("cv"))


@query("merge_boxes_j12_w9", MERGE_SQL)
def _(s, sf):
    return J.merge_boxes(*merge_inputs(s, sf)).select("screen_id", "id", *r4("bbox"))


@query("merge_boxes_crowded_j12", MERGE_SQL)
def _(s, sf):
    return J.merge_boxes(*merge_inputs(s, sf), fold_rows=20).select("screen_id", "id", *r4("bbox"))


@query("filter_detections_q10", with_(D.ELEMENTS_SQL) + "SELECT screen_id, id, CAST(row_number() OVER (PARTITION BY screen_id ORDER BY id) - 1 AS INT) AS new_id FROM elements WHERE confidence >= 0.3")
def _(s, sf):
    return S.filter_detections(D.elements(s, sf)).select("screen_id", "id", "new_id")


@query("resolve_element_ids_q17", """WITH e AS (SELECT l_orderkey AS screen_id, l_linenumber AS id, min(l_quantity) AS q FROM lineitem GROUP BY ALL),
c AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_custkey % 9 || '.0' WHEN 1 THEN '1.9' WHEN 2 THEN 'true' ELSE CAST(o_custkey % 9 AS VARCHAR) END AS element,
  CASE WHEN o_orderkey % 5 IN (0, 3, 4) THEN o_custkey % 9 END AS eid FROM orders)
SELECT o_orderkey, eid AS element_id, round(q / 100 + 0.05, 6) AS x, CASE WHEN eid IS NULL THEN 'element_not_integer' WHEN q IS NULL THEN 'element_unknown' END AS reject_reason
FROM c LEFT JOIN e ON e.screen_id = c.o_orderkey AND e.id = c.eid""")
def _(s, sf):
    el = D.table(s, sf, "lineitem").groupBy(F.col("l_orderkey").alias("screen_id"), F.col("l_linenumber").alias("id")).agg(
        F.min("l_quantity").alias("q"))
    el = el.select("screen_id", "id", G.box(F.col("q") / 100, F.lit(0.0), F.col("q") / 100 + 0.1, F.lit(0.1)).alias("bbox"))
    o = D.table(s, sf, "orders")
    k, n = F.col("o_orderkey") % 5, (F.col("o_custkey") % 9).cast("string")
    c = o.select("o_orderkey", F.col("o_orderkey").alias("screen_id"), F.when(k == 0, F.concat(n, F.lit(".0")))
                 .when(k == 1, "1.9").when(k == 2, "true").otherwise(n).alias("element"))
    out = J.resolve_element_ids(c, el)
    return out.select("o_orderkey", "element_id", r("point.x", "x"), "reject_reason")
