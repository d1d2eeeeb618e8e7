"""Box geometry as Catalyst expressions: boxes are (cx, cy, w, h) columns, corner arrays, or x1..y2 columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomlake.operators.columns import let

REGIONS = ["upper-left area", "upper-center area", "upper-right area", "middle-left area", "central area", "middle-right area", "lower-left area", "lower-center area", "lower-right area"]
#: Rows that a task gets where it sorts them several times.
TASK_ROWS = 100_000
EIGHT = ["right of", "upper-right of", "above", "upper-left of", "left of", "lower-left of", "below", "lower-right of"]


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def corners(cx="cx", cy="cy", w="w", h="h", tilt=None) -> Column:
    """Four corners of a box, the right side moved down by ``tilt``."""
    c = lambda v: F.col(v) if isinstance(v, str) else v
    cx, cy, w, h = map(c, (cx, cy, w, h))
    t = F.lit(0.0) if tilt is None else c(tilt)
    return F.array(point(cx - w / 2, cy - h / 2), point(cx + w / 2, cy - h / 2 + t), point(cx + w / 2, cy + h / 2 + t), point(cx - w / 2, cy + h / 2))


def poly_area(points: Column) -> Column:
    """Shoelace area of a polygon; 0 below three points."""
    n = F.size(points)
    terms = F.transform(points, lambda p, i: p["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * p["y"])
    return F.when(n < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)) / 2)


def canonical_corners(points: Column) -> Column:
    """Clockwise corners (y points down), the topmost, then leftmost, first."""
    mean = lambda c, k: F.aggregate(c, F.lit(0.0), lambda a, p: a + p[k]) / F.size(c)
    middle = lambda c: F.struct(mean(c, "x").alias("x"), mean(c, "y").alias("y"))
    # sort_array compares structs natively, array_sort by a lambda for each pair
    turned = lambda c: let(middle(c), lambda m: F.sort_array(F.transform(c, lambda p: F.struct(F.atan2(p["y"] - m["y"], p["x"] - m["x"]).alias("a"), p["x"].alias("x"), p["y"].alias("y")))))

    def from_first(t: Column) -> Column:
        first = F.array_min(F.transform(t, lambda p, i: F.struct(p["y"], p["x"], i.alias("i"))))["i"]
        plain = lambda some: F.transform(some, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
        return let(first, lambda f: plain(F.concat(F.slice(t, f + 1, F.size(t)), F.slice(t, 1, f))))

    return let(points, lambda c: let(turned(c), from_first))


def hbb(points: Column) -> Column:
    """Axis-aligned box of points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of axis-aligned boxes x1, y1, x2, y2; 0 for an empty union."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), hi - lo)
    inter = side(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * side(F.greatest(a[1], b[1]), F.least(a[3], b[3]))
    union = side(a[0], a[2]) * side(a[1], a[3]) + side(b[0], b[2]) * side(b[1], b[3]) - inter
    return F.when(union > 1e-9, inter / union).otherwise(F.lit(0.0))


def to_norm(v: Column, size: Column, scale: float) -> Column:
    return F.bround(v / F.greatest(size, F.lit(1)) * scale, 4)


def coordinate_mode(largest: Column, width: Column, height: Column) -> Column:
    """Whether coordinates are shares, percent, thousandths or pixels, by their largest absolute value."""
    side = F.greatest(width, height)
    return F.when(largest <= 1.5, "normalized_0_1").when((largest <= 100.5) & (side > 200), "normalized_0_100").when((largest <= 1000.5) & (side > 1000), "normalized_0_1000").otherwise("pixel")


def from_mode(v: Column, mode: Column, size: Column) -> Column:
    pixel = F.when(mode == "normalized_0_1", v * size).when(mode == "normalized_0_100", v / 100 * size).when(mode == "normalized_0_1000", v / 1000 * size).otherwise(v)
    return F.greatest(F.lit(0.0), F.least(size - 1.0, pixel))


def scale_int1000(v: Column, largest: Column) -> Column:
    """Values of 0-1, 0-100 or 0-1000 scale as whole thousandths, clipped."""
    k = F.when(largest <= 1.5, 1000.0).when(largest <= 100.5, 10.0).otherwise(1.0)
    return F.least(F.lit(1000), F.greatest(F.lit(0), F.bround(v * k, 0).cast("int")))


def object_reasons(points: Column, width: Column, height: Column, min_area: float = 1.0) -> Column:
    """Why a box is invalid, in fixed order: not_four_points, non_finite, degenerate_area, out_of_bounds."""
    return let(points, lambda p: _reasons(p, width, height, min_area))


def _reasons(points: Column, width: Column, height: Column, min_area: float) -> Column:
    four = F.size(points) == 4
    finite = F.forall(points, lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) != float("inf")) & (F.abs(p["y"]) != float("inf")))
    inside = F.forall(points, lambda p: (p["x"] >= 0) & (p["y"] >= 0) & (p["x"] <= F.greatest(F.lit(0.0), width - 1.0)) & (p["y"] <= F.greatest(F.lit(0.0), height - 1.0)))
    area = F.when(four, poly_area(points)).otherwise(F.lit(0.0))
    flags = [(~four, "not_four_points"), (~finite, "non_finite"), (area <= min_area, "degenerate_area"), (~(four & finite & inside), "out_of_bounds")]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in flags]))


def sanitize(df: DataFrame, policy: str = "drop", min_area: float = 1.0, points: str = "points") -> DataFrame:
    """Adds reasons, action and the points after the policy: drop, clamp (invalid ones are moved inside and judged
    again) or fail (raises in the job). Rows stay, so that drops can be counted; filter on ``action``."""
    w, h = F.col("image_width"), F.col("image_height")
    df = df.withColumn("reasons", object_reasons(F.col(points), w, h, min_area))
    ok = F.size("reasons") == 0
    if policy == "fail":
        return df.withColumn("action", F.when(ok, F.lit("keep")).otherwise(F.raise_error(F.concat(F.lit("invalid box: "), F.array_join("reasons", ",")))))
    if policy == "drop":
        return df.withColumn("action", F.when(ok, "keep").otherwise("drop"))
    if policy != "clamp":
        raise ValueError(f"unknown policy {policy}")
    hi = lambda v, s: F.greatest(F.lit(0.0), F.least(F.greatest(F.lit(0.0), s - 1.0), v))
    moved = F.transform(points, lambda p: point(hi(p["x"], w), hi(p["y"], h)))
    df = df.withColumn("moved", F.when(ok, F.col(points)).otherwise(moved))
    again = F.size(object_reasons(F.col("moved"), w, h, min_area)) == 0
    return df.withColumn("action", F.when(ok, "keep").when(again, "clamp").otherwise("drop_after_clamp")).withColumn(points, F.col("moved")).drop("moved")


def quad_area(x: list[Column], y: list[Column]) -> Column:
    """Shoelace area of four corners."""
    terms = [x[i] * y[(i + 1) % 4] - x[(i + 1) % 4] * y[i] for i in range(4)]
    return F.abs(terms[0] + terms[1] + terms[2] + terms[3]) / 2


def quad_fault(x: list[Column], y: list[Column]) -> Column:
    """ok, or why four corners are no box: not distinct (to four places), too small, or crossing edges."""
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    finite = F.abs(reduce(lambda a, b: a + b, [*x, *y])) < 1e300
    apart = reduce(lambda a, b: a & b, [(F.abs(x[i] - x[j]) > 1e-3) | (F.abs(y[i] - y[j]) > 1e-3) for i, j in pairs], finite)  # these need no rounding, which is slow
    distinct = F.size(F.array_distinct(F.array(*[F.struct(F.bround(a, 4), F.bround(b, 4)) for a, b in zip(x, y)])))
    turn = lambda a, b, c: (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])
    cross = lambda a, b, c, d: (turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)
    repeated = F.when(apart, F.lit(False)).otherwise(distinct < 4)
    return F.when(repeated, "repeated_points").when(quad_area(x, y) < 1, "degenerate_area").when(cross(0, 1, 2, 3) | cross(1, 2, 3, 0), "self_intersecting").otherwise("ok")


def quad_status(points: Column) -> Column:
    """ok, or why a quadrilateral is no box: not four distinct points, too small, or crossing edges."""
    flat = lambda p: F.struct(*[F.get(p, i)[k].alias(f"{k}{i}") for i in range(4) for k in "xy"])
    fault = lambda q: quad_fault(*([q[f"{k}{i}"] for i in range(4)] for k in "xy"))
    return let(points, lambda p: F.when(p.isNull(), "ok").when(F.size(p) != 4, "not_four_points").otherwise(let(flat(p), fault)))


def shape_columns(df: DataFrame, points: str = "points") -> DataFrame:
    """aspect_ratio, orientation_degrees, orientation_phrase, shape_phrase of the canonical corners."""
    p = F.col("__p")
    edges = F.transform(p, lambda q, i: F.struct((F.get(p, (i + 1) % 4)["x"] - q["x"]).alias("dx"), (F.get(p, (i + 1) % 4)["y"] - q["y"]).alias("dy")))
    n = [F.hypot(F.get("__e", i)["dx"], F.get("__e", i)["dy"]) for i in range(4)]
    longest = F.when((n[0] >= n[1]) & (n[0] >= n[2]) & (n[0] >= n[3]), 0).when((n[1] >= n[2]) & (n[1] >= n[3]), 1).when(n[2] >= n[3], 2).otherwise(3)
    df = df.withColumn("__p", canonical_corners(F.col(points))).withColumn("__e", edges).withColumn("__l", F.get("__e", longest))
    aspect = F.greatest(*n) / F.greatest(F.lit(1e-6), F.least(*n))
    angle = F.pmod(F.degrees(F.atan2(F.col("__l.dy"), F.col("__l.dx"))), F.lit(180.0))
    df = df.withColumn("__a", aspect).withColumn("__d", angle)
    d, a = F.col("__d"), F.col("__a")
    turn = F.when((d < 22.5) | (d >= 157.5), "roughly horizontal").when((d >= 67.5) & (d < 112.5), "roughly vertical").when(d < 67.5, "diagonally descending to the right").otherwise("diagonally ascending to the right")
    shape = F.when(a >= 3.5, "strongly elongated").when(a >= 1.8, "elongated").when(a <= 1.25, "compact").otherwise("moderately rectangular")
    return df.withColumns({"aspect_ratio": F.bround(a, 4), "orientation_degrees": F.bround(d, 3), "orientation_phrase": turn, "shape_phrase": shape}).drop("__p", "__e", "__l", "__a", "__d")


def region_name(cx: Column, cy: Column, width: Column, height: Column) -> Column:
    third = lambda v, s: F.least(F.lit(2), F.greatest(F.lit(0), F.floor(v / F.greatest(s, F.lit(1)) * 3).cast("int")))
    return F.get(F.array(*map(F.lit, REGIONS)), third(cy, height) * 3 + third(cx, width))


def relation(dx: Column, dy: Column) -> Column:
    """Where the target is as seen from the anchor; dx, dy: anchor minus target."""
    diagonal = F.concat(F.when(dy > 0, "above").otherwise("below"), F.lit(" and "), F.when(dx > 0, "left").otherwise("right"), F.lit(" of"))
    return F.when(F.abs(dx) >= 1.5 * F.abs(dy), F.when(dx > 0, "left of").otherwise("right of")).when(F.abs(dy) >= 1.5 * F.abs(dx), F.when(dy > 0, "above").otherwise("below")).otherwise(diagonal)


def compass(dx: Column, dy: Column) -> Column:
    degrees = F.pmod(F.degrees(F.atan2(-dy, dx)), F.lit(360.0))
    return F.get(F.array(*map(F.lit, EIGHT)), (F.floor((degrees + 22.5) / 45) % 8).cast("int"))


def focus_box(x1: Column, y1: Column, x2: Column, y2: Column, factor: float = 2.5, least: float = 80.0, top: float = 1000.0) -> Column:
    """A coarse region around a box: widened, of a least span, inside 0..top."""
    def axis(lo: Column, hi: Column) -> tuple[Column, Column]:
        mid, half = (lo + hi) / 2, F.greatest((hi - lo) * factor, F.lit(least)) / 2
        return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(top), mid + half)

    (a, c), (b, d) = axis(x1, x2), axis(y1, y2)
    return F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"))


def center_in_expanded(cx: Column, cy: Column, box: list[Column], ratio: float = 0.5, margin: float = 1.0) -> Column:
    """Whether a centre lies in a box grown on each side by ``ratio`` of its span, at least ``margin``."""
    mx, my = (F.greatest(F.lit(margin), (box[i + 2] - box[i]) * ratio) for i in (0, 1))
    return (cx >= box[0] - mx) & (cx <= box[2] + mx) & (cy >= box[1] - my) & (cy <= box[3] + my)


def map_crop(x: Column, y: Column, crop: list[Column]) -> tuple[Column, Column]:
    """Crop-local thousandths to coordinates of the whole image."""
    return crop[0] + x / 1000 * (crop[2] - crop[0]), crop[1] + y / 1000 * (crop[3] - crop[1])


def center_score(a: list[Column], b: list[Column]) -> Column:
    """r / max(distance of centres, r), r half the diagonal of ``b``."""
    d = F.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)
    r = F.hypot(b[2] - b[0], b[3] - b[1]) / 2
    return F.when(F.greatest(d, r) > 0, r / F.greatest(d, r)).otherwise(F.lit(1.0))


def _turned(p: np.ndarray) -> np.ndarray:
    """Corners (n, 4, 2) in the order of ``canonical_corners``."""
    x, y = p[:, :, 0], p[:, :, 1]
    middle = p.sum(axis=1, keepdims=True) / 4
    angle = np.arctan2(y - middle[:, :, 1], x - middle[:, :, 0])
    p = np.take_along_axis(p, np.lexsort((y, x, angle), axis=1)[:, :, None], axis=1)
    first = np.lexsort((p[:, :, 0], p[:, :, 1]), axis=1)[:, :1]
    return np.take_along_axis(p, ((first + np.arange(4)) % 4)[:, :, None], axis=1)


def _cross(p: np.ndarray) -> np.ndarray:
    """Cross products of each corner with the next one."""
    q = np.roll(p, -1, axis=1)
    return p[:, :, 0] * q[:, :, 1] - q[:, :, 0] * p[:, :, 1]


def _inside(p: np.ndarray, o: np.ndarray, common: bool) -> np.ndarray:
    """Twice the signed area that the part of each of ``p``'s edges inside ``o`` sweeps; ``common``: edges on an edge of ``o`` count."""
    step, side = np.roll(p, -1, axis=1) - p, np.roll(o, -1, axis=1) - o
    lo, hi = np.zeros(p.shape[:2]), np.ones(p.shape[:2])
    for j in range(4):
        dx, dy = side[:, j, 0, None], side[:, j, 1, None]
        near = dx * (p[:, :, 1] - o[:, j, 1, None]) - dy * (p[:, :, 0] - o[:, j, 0, None])
        along = dx * step[:, :, 1] - dy * step[:, :, 0]
        enters, leaves = along > 1e-9, along < -1e-9
        at = -near / np.where(enters | leaves, along, 1.0)
        out = ~enters & ~leaves & (near < -1e-9 if common else near <= 1e-9)
        lo = np.where(enters, np.maximum(lo, at), lo)
        hi = np.minimum(hi, np.where(leaves, at, np.where(out, -1.0, 1.0)))
    return np.maximum(hi - lo, 0.0) * (p[:, :, 0] * step[:, :, 1] - p[:, :, 1] * step[:, :, 0])


def with_obb_iou(df: DataFrame, a: str, b: str, out: str = "iou") -> DataFrame:
    """Adds the IoU of two convex quads given as corner arrays; 0 where a corner is missing or no number.

    The outline of the intersection is made of the parts of each quad's edges inside the other one. Each
    edge is cut to the stretch t0..t1 that all four half-planes of the other quad allow, and the stretches'
    cross products sum to twice the area (Green). A stretch on a common edge counts for ``a`` only. Done for Arrow
    batches: as one expression the sum took several times as long.
    """

    @F.pandas_udf("double")
    def quad_iou(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for c in parts:
            q = np.stack([s.to_numpy(dtype="float64", na_value=np.nan) for s in c], axis=1).reshape(-1, 2, 4, 2)
            with np.errstate(all="ignore"):
                a, b = _turned(q[:, 0]), _turned(q[:, 1])
                both = np.abs(_cross(a).sum(axis=1)) / 2 + np.abs(_cross(b).sum(axis=1)) / 2
                b, a = b - a[:, :1], a - a[:, :1]  # from the first corner of a, so that numbers stay small
                inter = np.abs(sum(np.concatenate([_inside(a, b, True), _inside(b, a, False)], axis=1).T)) / 2
                union = both - inter
                yield pd.Series(np.where(union > 1e-9, inter / np.where(union > 1e-9, union, 1.0), 0.0))

    return df.withColumn(out, quad_iou(*[F.get(F.col(q), i)[k] for q in (a, b) for i in range(4) for k in "xy"]))


def split_rois(df: DataFrame, keys: list[str], max_objects: int, width: Column | float = 1000.0, height: Column | float = 1000.0, x: str = "cx", y: str = "cy", order: str = "object_index", inseparable: str = "fail") -> DataFrame:
    """Adds ``roi`` and its box rx1, ry1, rx2, ry2: groups of at most ``max_objects`` rows, in disjoint regions of the image.

    A group that is too large is cut between its two middle centres on the axis of larger extent, or, if these two are
    equal there, on the other one; each level cuts every such node, with windows over the node, as often as the largest group needs.
    Where neither axis can tell the two middle rows apart, the job fails, or with ``inseparable="keep"`` the group stays as it is.
    Whole images are dealt to tasks of some ``TASK_ROWS`` rows by one shuffle for all levels; only if an image is larger, each level is shuffled by its nodes.
    """
    size = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    largest, rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if largest <= TASK_ROWS:
        # all levels sort the same rows of a task, so their number must not grow with the table
        parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
        df = df.repartition(parts, *keys)
    levels = max(0, (-(-largest // max(1, max_objects)) - 1).bit_length())
    df = df.withColumns({"roi": F.lit(1).cast("long"), "rx1": F.lit(0.0), "ry1": F.lit(0.0), "rx2": size(width).cast("double"), "ry2": size(height).cast("double")})
    for _ in range(levels):
        node = W.partitionBy(*keys, "roi")
        df = df.withColumns({"__n": F.count(F.lit(1)).over(node), "__rx": F.row_number().over(node.orderBy(x, order)), "__ry": F.row_number().over(node.orderBy(y, order)), "__wide": F.max(x).over(node) - F.min(x).over(node) >= F.max(y).over(node) - F.min(y).over(node)})
        middle = F.floor(F.col("__n") / 2)
        edge = {f"__{k}{a}": f(F.when((F.col(f"__r{a}") <= middle) == low, F.col(c))).over(node).cast("double") for a, c in (("x", x), ("y", y)) for k, f, low in (("l", F.max, True), ("h", F.min, False))}
        df = df.withColumns(edge)
        fits = lambda a: F.col(f"__l{a}") < F.col(f"__h{a}")
        large = F.col("__n") > max_objects
        along = F.when(F.col("__wide") & fits("x"), "x").when(fits("y"), "y").when(fits("x"), "x")
        if inseparable == "fail":
            along = F.coalesce(along, F.when(large, F.raise_error(F.lit("too many objects share a centre: no disjoint regions"))))
        df = df.withColumn("__a", F.when(large, along))
        cut = lambda a: (F.col(f"__l{a}") + F.col(f"__h{a}")) / 2
        right = F.when(F.col("__a") == "x", F.col("__rx") > middle).otherwise(F.col("__ry") > middle)
        df = df.withColumn("__r", F.when(F.col("__a").isNotNull(), right))
        move = lambda a, side: F.when((F.col("__a") == a) & (F.col("__r") == side), cut(a))
        df = df.withColumns({"rx1": F.coalesce(move("x", True), "rx1"), "ry1": F.coalesce(move("y", True), "ry1"), "rx2": F.coalesce(move("x", False), "rx2"), "ry2": F.coalesce(move("y", False), "ry2"), "roi": F.when(F.col("__r").isNotNull(), F.col("roi") * 2 + F.col("__r").cast("long")).otherwise(F.col("roi"))})
        df = df.drop(*[c for c in df.columns if c.startswith("__")])
    return df
