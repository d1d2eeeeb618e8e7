"""Queries of the geometry operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlake.operators import geometry as G
from loomlake.plans.fixtures import DETECTIONS, OBJECTS, duck, frame

QUERIES, ORACLES = {}, {}
O, D = duck(OBJECTS), duck(DETECTIONS)
ID = ["image_id", "object_index"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def boxes(spark, sf):
    return frame(spark, sf, OBJECTS).withColumn("points", G.corners(tilt="tilt"))


PTS = f"(select *, [{{'x': cx-w/2, 'y': cy-h/2}}, {{'x': cx+w/2, 'y': cy-h/2+tilt}}, {{'x': cx+w/2, 'y': cy+h/2+tilt}}, {{'x': cx-w/2, 'y': cy+h/2}}] as points from ({O}))"


@query("g1_poly_area", f"select image_id, object_index, w * h as area from ({O})")
def _(spark, sf):
    return boxes(spark, sf).select(*ID, G.poly_area(F.col("points")).alias("area"))


@query("g2_canonical_obb", f"""with p as (select image_id, object_index, unnest([0,1,2,3]) as i, points[unnest([1,2,3,4])] as q, cx, cy, tilt from {PTS}),
 a as (select *, atan2(q.y - (cy + tilt/2), q.x - cx) as ang from p),
 o as (select *, row_number() over (partition by image_id, object_index order by ang, q.x, q.y) - 1 as k from a),
 f as (select image_id, object_index, arg_min(k, (q.y, q.x)) as f from o group by all)
 select image_id, object_index, max(case when (k - f + 4) % 4 = 0 then q.x end) as x1, max(case when (k - f + 4) % 4 = 0 then q.y end) as y1,
  max(case when (k - f + 4) % 4 = 1 then q.x end) as x2, max(case when (k - f + 4) % 4 = 1 then q.y end) as y2,
  max(case when (k - f + 4) % 4 = 2 then q.x end) as x3, max(case when (k - f + 4) % 4 = 2 then q.y end) as y3,
  max(case when (k - f + 4) % 4 = 3 then q.x end) as x4, max(case when (k - f + 4) % 4 = 3 then q.y end) as y4 from o join f using (image_id, object_index) group by image_id, object_index""")
def _(spark, sf):
    df = boxes(spark, sf).select(*ID, G.canonical_corners(F.col("points")).alias("p"))
    return df.select(*ID, *[F.get("p", i)[k].alias(f"{k}{i + 1}") for i in range(4) for k in "xy"])


@query("g3_hbb", f"select image_id, object_index, cx - w/2 as x1, cy - h/2 + least(tilt, 0) as y1, cx + w/2 as x2, cy + h/2 + greatest(tilt, 0) as y2 from ({O})")
def _(spark, sf):
    return boxes(spark, sf).select(*ID, G.hbb(F.col("points")).alias("b")).select(*ID, "b.*")


_IOU = """with d as (select *, greatest(0, least(x2, px2) - greatest(x1, px1)) * greatest(0, least(y2, py2) - greatest(y1, py1)) as i,
 (x2-x1)*(y2-y1) + (px2-px1)*(py2-py1) as s from ({d}))"""


@query("g4_hbb_iou", _IOU.replace("{d}", D) + " select image_id, object_index, round(i / (s - i), 6) as iou from d where found")
def _(spark, sf):
    df = frame(spark, sf, DETECTIONS).where("found")
    return df.select(*ID, F.round(G.iou([F.col(c) for c in ("x1", "y1", "x2", "y2")], [F.col(c) for c in ("px1", "py1", "px2", "py2")]), 6).alias("iou"))


@query("g5_obb_iou")
def _(spark, sf):
    """IoU of every tilted box with its own moved copy."""
    df = boxes(spark, sf).withColumn("moved", F.transform("points", lambda p: G.point(p["x"] + F.col("line") % 7 - 3, p["y"] + F.col("line") % 5 - 2)))
    return G.with_obb_iou(df, "points", "moved").select(*ID, "iou")


@query("g6_norm", f"select image_id, object_index, cast(round(cx / 1000 * 100, 4) as double) as x100, cast(round(cy / 1000 * 1000, 4) as double) as y1000, cx as x_back from ({O})")
def _(spark, sf):
    w, h = F.col("image_width"), F.col("image_height")
    df = boxes(spark, sf).withColumn("x100", G.to_norm(F.col("cx"), w, 100.0)).withColumn("y1000", G.to_norm(F.col("cy"), h, 1000.0))
    return df.select(*ID, "x100", "y1000", F.bround(F.col("x100") / 100 * w, 4).alias("x_back"))


@query("g7_infer_points", f"""with s as (select image_id, object_index, case object_index % 4 when 0 then cx / 1000 when 1 then cx / 10 when 2 then cx else cx * 2 end as v from ({O})),
 m as (select *, case when abs(v) <= 1.5 then 'normalized_0_1' when abs(v) <= 100.5 then 'normalized_0_100' when abs(v) <= 1000.5 then 'normalized_0_1000' else 'pixel' end as mode from s)
 select image_id, object_index, mode, round(greatest(0, least(1199, case mode when 'normalized_0_1' then v * 1200 when 'normalized_0_100' then v / 100 * 1200 when 'normalized_0_1000' then v / 1000 * 1200 else v end)), 6) as x from m""")
def _(spark, sf):
    k, cx, size = F.col("object_index") % 4, F.col("cx"), F.lit(1200)
    df = boxes(spark, sf).withColumn("v", F.when(k == 0, cx / 1000).when(k == 1, cx / 10).when(k == 2, cx).otherwise(cx * 2))
    df = df.withColumn("mode", G.coordinate_mode(F.abs("v"), size, size))
    return df.select(*ID, "mode", F.round(G.from_mode(F.col("v"), F.col("mode"), size), 6).alias("x"))


@query("g8_to_int1000", f"""with s as (select image_id, object_index, case when image_id % 3 = 0 then 0.001 when image_id % 3 = 1 then 0.1 else 1 end as k, cx, cy, w, h from ({O})),
 m as (select image_id, max(greatest(cx, cy) * k) as largest from s group by image_id)
 select image_id, object_index, cast(least(1000, greatest(0, round_even(cx * k * f, 0))) as int) as x, cast(least(1000, greatest(0, round_even(cy * k * f, 0))) as int) as y
 from (select *, case when largest <= 1.5 then 1000.0 when largest <= 100.5 then 10.0 else 1.0 end as f from s join m using (image_id))""")
def _(spark, sf):
    from pyspark.sql import Window as W

    k = F.when(F.col("image_id") % 3 == 0, 0.001).when(F.col("image_id") % 3 == 1, 0.1).otherwise(1.0)
    df = boxes(spark, sf).withColumn("x", F.col("cx") * k).withColumn("y", F.col("cy") * k).withColumn("m", F.max(F.greatest("x", "y")).over(W.partitionBy("image_id")))
    return df.select(*ID, *[G.scale_int1000(F.col(c), F.col("m")).alias(c) for c in "xy"])


_REASONS = """list_filter([case when w * h <= 400 then 'degenerate_area' end, case when cx - w/2 < 0 or cy - h/2 + least(tilt, 0) < 0 or cx + w/2 > 899 or cy + h/2 + greatest(tilt, 0) > 899 then 'out_of_bounds' end], lambda x: x is not null)"""


@query("g9_object_reasons", f"select image_id, object_index, array_to_string({_REASONS}, ',') as reasons from ({O})")
def _(spark, sf):
    small = F.lit(900)
    return boxes(spark, sf).select(*ID, F.array_join(G.object_reasons(F.col("points"), small, small, 400.0), ",").alias("reasons"))


@query("g10_sanitize", f"""select action, count(*) as n, sum(cast(x as bigint)) as x from (
 with c as (select *, greatest(0, least(799, cx - w/2)) as a, greatest(0, least(799, cx + w/2)) as b from ({O})),
 q as (select *, [{{'x': a, 'y': greatest(0, least(799, cy-h/2))}}, {{'x': b, 'y': greatest(0, least(799, cy-h/2+tilt))}}, {{'x': b, 'y': greatest(0, least(799, cy+h/2+tilt))}}, {{'x': a, 'y': greatest(0, least(799, cy+h/2))}}] as p from c),
 s as (select *, abs((p[1].x*p[2].y - p[2].x*p[1].y) + (p[2].x*p[3].y - p[3].x*p[2].y) + (p[3].x*p[4].y - p[4].x*p[3].y) + (p[4].x*p[1].y - p[1].x*p[4].y)) / 2 as area,
  w * h <= 1 or cx - w/2 < 0 or cy - h/2 + least(tilt, 0) < 0 or cx + w/2 > 799 or cy + h/2 + greatest(tilt, 0) > 799 as bad from q)
 select case when not bad then 'keep' when area > 1 then 'clamp' else 'drop_after_clamp' end as action, floor(case when bad then a else cx - w/2 end) as x from s) group by action""")
def _(spark, sf):
    df = boxes(spark, sf).withColumn("image_width", F.lit(800)).withColumn("image_height", F.lit(800))
    df = G.sanitize(df, "clamp").withColumn("x", F.floor(F.get("points", 0)["x"]).cast("long"))
    return df.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"))


@query("g11_quad_status", f"""select image_id, object_index, case object_index % 5 when 0 then 'repeated_points' when 1 then 'degenerate_area' else 'ok' end as status from ({O})""")
def _(spark, sf):
    """Every fifth box gets a corner twice, the next one its corners in crossing order (of no area)."""
    p, k = F.col("points"), F.col("object_index") % 5
    twice, crossed = F.array(F.get(p, 0), F.get(p, 0), F.get(p, 2), F.get(p, 3)), F.array(F.get(p, 0), F.get(p, 2), F.get(p, 1), F.get(p, 3))
    return boxes(spark, sf).select(*ID, G.quad_status(F.when(k == 0, twice).when(k == 1, crossed).otherwise(p)).alias("status"))


@query("g12_shape", f"""with e as (select image_id, object_index, w, h, tilt, sqrt(w*w + tilt*tilt) as s from ({O})),
 a as (select *, greatest(s, h) / least(s, h) as aspect from e)
 select image_id, object_index, round_even(aspect, 4) as aspect_ratio, case when aspect >= 3.5 then 'strongly elongated' when aspect >= 1.8 then 'elongated' when aspect <= 1.25 then 'compact' else 'moderately rectangular' end as shape_phrase from a""")
def _(spark, sf):
    df = G.shape_columns(boxes(spark, sf))
    return df.select(*ID, "aspect_ratio", "shape_phrase")


@query("g13_region", f"""select image_id, object_index, case when rx = 1 and ry = 1 then 'central area' else ['upper', 'middle', 'lower'][ry + 1] || '-' || ['left', 'center', 'right'][rx + 1] || ' area' end as region
 from (select *, cast(least(2, floor(cx / 1000 * 3)) as int) as rx, cast(least(2, floor(cy / 1000 * 3)) as int) as ry from ({O}))""")
def _(spark, sf):
    return boxes(spark, sf).select(*ID, G.region_name(F.col("cx"), F.col("cy"), F.col("image_width"), F.col("image_height")).alias("region"))


@query("g14_relation", f"""with p as (select a.image_id, a.object_index, b.object_index as anchor, b.cx - a.cx as dx, b.cy - a.cy as dy from ({O}) a join ({O}) b on a.image_id = b.image_id and a.object_index <> b.object_index)
 select image_id, object_index, anchor, case when abs(dx) >= 1.5 * abs(dy) then case when dx > 0 then 'left of' else 'right of' end when abs(dy) >= 1.5 * abs(dx) then case when dy > 0 then 'above' else 'below' end
  else (case when dy > 0 then 'above' else 'below' end) || ' and ' || (case when dx > 0 then 'left' else 'right' end) || ' of' end as relation,
  ['right of', 'upper-right of', 'above', 'upper-left of', 'left of', 'lower-left of', 'below', 'lower-right of'][cast(floor((((degrees(atan2(-dy, dx)) % 360) + 360) % 360 + 22.5) / 45) as int) % 8 + 1] as compass from p""")
def _(spark, sf):
    a = boxes(spark, sf).select(*ID, "cx", "cy")
    b = a.select("image_id", F.col("object_index").alias("anchor"), F.col("cx").alias("ax"), F.col("cy").alias("ay"))
    dx, dy = F.col("ax") - F.col("cx"), F.col("ay") - F.col("cy")
    return a.join(b, "image_id").where("object_index <> anchor").select(*ID, "anchor", G.relation(dx, dy).alias("relation"), G.compass(dx, dy).alias("compass"))


@query("g15_focus_box", f"""select image_id, object_index, greatest(0.0, cx - greatest(w * 2.5, 80) / 2) as x1, greatest(0.0, cy - greatest(h * 2.5, 80) / 2) as y1,
 least(1000.0, cx + greatest(w * 2.5, 80) / 2) as x2, least(1000.0, cy + greatest(h * 2.5, 80) / 2) as y2 from ({O})""")
def _(spark, sf):
    x, y, w, h = map(F.col, ("cx", "cy", "w", "h"))
    return boxes(spark, sf).select(*ID, G.focus_box(x - w / 2, y - h / 2, x + w / 2, y + h / 2).alias("b")).select(*ID, "b.*")


@query("g16_center_gate", f"""select image_id, object_index, (px1+px2)/2 between x1 - greatest(1, (x2-x1)*0.02) and x2 + greatest(1, (x2-x1)*0.02) and (py1+py2)/2 between y1 - greatest(1, (y2-y1)*0.02) and y2 + greatest(1, (y2-y1)*0.02) as inside from ({D}) where found""")
def _(spark, sf):
    df = frame(spark, sf, DETECTIONS).where("found")
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    return df.select(*ID, G.center_in_expanded((F.col("px1") + F.col("px2")) / 2, (F.col("py1") + F.col("py2")) / 2, box, 0.02).alias("inside"))


@query("g17_map_crop", f"""select image_id, object_index, round(cx/2 + cx / 1000 * 200, 6) as x, round(cy/2 + cy / 1000 * 300, 6) as y, (w * h) / (1000.0 * 1000) >= 0.94 as whole from ({O})""")
def _(spark, sf):
    cx, cy = F.col("cx"), F.col("cy")
    x, y = G.map_crop(cx, cy, [cx / 2, cy / 2, cx / 2 + 200, cy / 2 + 300])
    return boxes(spark, sf).select(*ID, F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), (F.col("w") * F.col("h") / 1e6 >= 0.94).alias("whole"))


@query("g18_center_score", f"""select image_id, object_index, round(r / greatest(d, r), 6) as score from (select *, sqrt(((x1+x2-px1-px2)/2)**2 + ((y1+y2-py1-py2)/2)**2) as d, sqrt((px2-px1)**2 + (py2-py1)**2) / 2 as r from ({D})) where found""")
def _(spark, sf):
    df = frame(spark, sf, DETECTIONS).where("found")
    return df.select(*ID, F.round(G.center_score([F.col(c) for c in ("x1", "y1", "x2", "y2")], [F.col(c) for c in ("px1", "py1", "px2", "py2")]), 6).alias("score"))


def _cut(level: int) -> str:
    """One level of cuts of all nodes that are too large, in SQL."""
    w = "partition by scene, roi"
    return f"""n{level} as (select *, count(*) over ({w}) as n, row_number() over ({w} order by cx, key) as ox, row_number() over ({w} order by cy, key) as oy, max(cx) over ({w}) - min(cx) over ({w}) >= max(cy) over ({w}) - min(cy) over ({w}) as wide from s{level}),
 e{level} as (select *, max(case when ox <= n // 2 then cx end) over ({w}) as lx, min(case when ox > n // 2 then cx end) over ({w}) as hx, max(case when oy <= n // 2 then cy end) over ({w}) as ly, min(case when oy > n // 2 then cy end) over ({w}) as hy from n{level}),
 a{level} as (select *, case when n <= 8 then null when wide and lx < hx then 'x' when ly < hy then 'y' when lx < hx then 'x' end as along from e{level}),
 r{level} as (select *, case along when 'x' then ox > n // 2 when 'y' then oy > n // 2 end as r from a{level}),
 s{level + 1} as (select scene, key, cx, cy, case when r is null then roi else roi * 2 + cast(r as int) end as roi, case when along = 'x' and r then (lx + hx) / 2 else rx1 end as rx1, case when along = 'y' and r then (ly + hy) / 2 else ry1 end as ry1,
  case when along = 'x' and not r then (lx + hx) / 2 else rx2 end as rx2, case when along = 'y' and not r then (ly + hy) / 2 else ry2 end as ry2 from r{level})"""


@query("g19_split_rois", f"""with s0 as (select image_id // 10 as scene, image_id || ':' || object_index as key, cx, cy, 1 as roi, 0.0 as rx1, 0.0 as ry1, 1000.0 as rx2, 1000.0 as ry2 from ({O})), {', '.join(map(_cut, range(6)))}
 select scene, roi, count(*) as objects, any_value(rx1) as x1, any_value(ry1) as y1, any_value(rx2) as x2, any_value(ry2) as y2 from s6 group by scene, roi""")
def _(spark, sf):
    """Scenes of ten images cut into regions of at most eight objects; what shares a centre stays together."""
    df = boxes(spark, sf).withColumns({"scene": F.floor(F.col("image_id") / 10), "key": F.concat_ws(":", "image_id", "object_index")})
    df = G.split_rois(df, ["scene"], 8, order="key", inseparable="keep")
    return df.groupBy("scene", "roi").agg(F.count(F.lit(1)).alias("objects"), *[F.first(f"r{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
