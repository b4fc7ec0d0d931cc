"""Measurements, snapping, hit tests, area redaction and interval merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans import blocks, spatial

# ---- fixed values
KINDS = {"Line": "Distance", "PolyLine": "Perimeter", "Polygon": "Area"}
COVERED_SHARE = 0.25
# -----------------


def _distance(p: Column, q: Column) -> Column:
    dx, dy = (q["x"] - p["x"]) * F.col("x_factor"), (q["y"] - p["y"]) * F.col("y_factor")
    return F.sqrt(dx * dx + dy * dy) * F.col("distance_factor")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def path_length(points: Column, closed: bool = False) -> Column:
    steps = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), _distance)
    open_ = _sum(steps)
    return F.when(F.size(points) > 2, open_ + _distance(F.element_at(points, -1), F.get(points, F.lit(0)))).otherwise(open_) if closed else open_


def polygon_area(points: Column) -> Column:
    """The shoelace area; a polygon that crosses itself counts its signed parts."""
    turned = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    xf, yf = F.col("x_factor"), F.col("y_factor")
    parts = F.zip_with(points, turned, lambda p, q: p["x"] * xf * (q["y"] * yf) - q["x"] * xf * (p["y"] * yf))
    return F.when(F.size(points) < 3, 0.0).otherwise(F.abs(_sum(parts)) / 2 * F.col("area_factor"))


def angle(p: Column, q: Column) -> Column:
    """Degrees from the x axis, counter-clockwise, 0 up to 360."""
    degrees = F.degrees(F.atan2((q["y"] - p["y"]) * F.col("y_factor"), (q["x"] - p["x"]) * F.col("x_factor")))
    turned = F.when(degrees < 0, degrees + 360).otherwise(degrees)
    return F.when(F.abs(turned - 360) < 1e-9, 0.0).otherwise(turned)


def measure(annotations: DataFrame, scales: DataFrame, closed: bool = False) -> DataFrame:
    """What measuring annotations `(doc_id, id, subtype, points)` say under their document's scale."""
    kind = F.lit(None).cast("string")
    for subtype, name in KINDS.items():
        kind = F.when(F.col("subtype") == subtype, name).otherwise(kind)
    p = F.col("points")
    known = annotations.withColumn("kind", kind).where("kind is not null").join(scales, "doc_id")
    first, last = F.get(p, F.lit(0)), F.get(p, F.size(p) - 1)
    value = (
        F.when(F.col("kind") == "Distance", F.when(F.size(p) >= 2, _distance(first, last)).otherwise(0.0))
        .when(F.col("kind") == "Perimeter", path_length(p, closed)).otherwise(polygon_area(p))
    )
    return known.select("doc_id", "id", "kind", value.alias("value"), F.when(F.size(p) >= 2, angle(first, last)).alias("angle"))


def measure_totals(measured: DataFrame) -> DataFrame:
    return measured.groupBy("doc_id", "kind").agg(
        F.count(F.lit(1)).alias("count"), F.sum(F.round("value", 4).cast("decimal(28,4)")).alias("total"))


def snap(points: DataFrame, segments: DataFrame, tolerance: float) -> DataFrame:
    """Where each point `(doc_id, page_no, id, x, y)` snaps to on segments `(doc_id, page_no, seg_id, x0, y0, x1, y1)`.

    The nearest end within the tolerance, else the nearest middle, else the nearest point on a segment.
    Segments are dealt to the cells within the tolerance and listed there; a point is moved once, to the list of
    its own cell, and nothing is counted or sorted per pair. What a segment offers is worked out only for points near the
    box around it. Equal segments count once.
    """
    # Most segments are lines of text or under them, so cells are wide: a point has few segments to look at.
    width, height, key, around = tolerance * 32, tolerance * 4, ["doc_id", "page_no", "_cx", "_cy"], tolerance + 1e-6
    segments = segments.withColumns({c: F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")})
    ends = ("x0", "y0", "x1", "y1")
    paths = segments.groupBy("doc_id", "page_no", *ends).agg(F.min("seg_id").alias("seg_id"))
    box = {"_low": F.least("y0", "y1") - around, "_high": F.greatest("y0", "y1") + around, "_left": F.least("x0", "x1") - around, "_right": F.greatest("x0", "x1") + around}
    paths = paths.withColumns(box).withColumn("_c", F.explode(spatial.segment_cells(*map(F.col, ends), width, tolerance, height)))
    dealt = paths.withColumns({"_cx": F.col("_c.cx"), "_cy": F.col("_c.cy")}).drop("_c").repartition(*key)
    listed = dealt.groupBy(*key).agg(F.collect_list(F.struct("seg_id", *ends, *box)).alias("_segments"))
    at = points.withColumns({"_cx": spatial.cell(F.col("x"), width), "_cy": spatial.cell(F.col("y"), height)})
    close = F.filter("_segments", lambda s: (F.col("y") >= s["_low"]) & (F.col("y") <= s["_high"]) & (F.col("x") >= s["_left"]) & (F.col("x") <= s["_right"]))

    def near(s: Column, rank: int, tx: Column, ty: Column) -> Column:
        d2 = (tx - F.col("x")) * (tx - F.col("x")) + (ty - F.col("y")) * (ty - F.col("y"))
        return F.when(d2 <= tolerance * tolerance, F.struct(F.lit(rank).alias("rank"), d2.alias("_d"), s["seg_id"].alias("seg_id"), tx.alias("tx"), ty.alias("ty")))

    def offer(s: Column) -> Column:
        x0, y0, x1, y1 = (s[c] for c in ends)
        dx, dy = x1 - x0, y1 - y0
        long2 = dx * dx + dy * dy
        along = F.when(long2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - x0) * dx + (F.col("y") - y0) * dy) / F.when(long2 > 0, long2).otherwise(1.0)))).otherwise(0.0)
        end = F.least(near(s, 0, x0, y0), near(s, 0, x1, y1))
        return F.coalesce(end, near(s, 1, (x0 + x1) / 2, (y0 + y1) / 2), near(s, 2, x0 + along * dx, y0 + along * dy))

    # Points are not sorted: the lists of a partition are held in its task, and they are short beside the points. Nearly all points
    # have one segment near them; for one, no list is gone through.
    met = at.join(listed.hint("shuffle_hash"), key, "left").select("doc_id", "page_no", "id", "x", "y", close.alias("_close"))
    best = F.when(F.size("_close") == 1, offer(F.get("_close", F.lit(0)))).when(F.size("_close") > 1, F.array_min(F.transform("_close", offer)))
    found = met.select("doc_id", "page_no", "id", "x", "y", best.alias("_b"))
    kind = F.when(F.col("_b.rank") == 0, "Endpoint").when(F.col("_b.rank") == 1, "Midpoint").when(F.col("_b.rank") == 2, "OnPath").otherwise("None")
    return found.select("doc_id", "page_no", "id", kind.alias("kind"), F.coalesce("_b.tx", "x").alias("x"), F.coalesce("_b.ty", "y").alias("y"))


def hit_test(points: DataFrame, rects: DataFrame, slack: float = 0.0, size: float = 64.0) -> DataFrame:
    """The last rectangle `(doc_id, page_no, ord, x, y, w, h)` that holds each point; if none, the last within the slack."""
    key = ["doc_id", "page_no", "_c"]
    at = points.withColumn("_c", F.struct(spatial.cell(F.col("x"), size).alias("cx"), spatial.cell(F.col("y"), size).alias("cy")))
    areas = rects.where("w > 0 and h > 0").select(
        "doc_id", "page_no", "ord", F.col("x").alias("_x0"), F.col("y").alias("_y0"), (F.col("x") + F.col("w")).alias("_x1"), (F.col("y") + F.col("h")).alias("_y1"))
    areas = areas.withColumn("_c", F.explode(spatial.box_cells(F.col("_x0") - slack, F.col("_y0") - slack, F.col("_x1") + slack, F.col("_y1") + slack, size)))
    inside = lambda s: (F.col("x") >= F.col("_x0") - s) & (F.col("x") <= F.col("_x1") + s) & (F.col("y") >= F.col("_y0") - s) & (F.col("y") <= F.col("_y1") + s)
    found = at.join(areas, key).where(inside(slack))
    return found.groupBy("doc_id", "page_no", "id").agg(F.max(F.struct(inside(0.0).alias("exact"), "ord")).alias("_m")).select(
        "doc_id", "page_no", "id", "_m.ord", "_m.exact")


def with_areas(rows: DataFrame, areas: DataFrame) -> DataFrame:
    """Lines or words `(doc_id, page_no, y, h, …)` with the marks of their page, as the list `_marks`, that reach their height."""
    key = ["doc_id", "page_no"]
    listed = areas.groupBy(*key).agg(F.collect_set(F.struct(*[F.col(c).cast("double").alias(c) for c in "xywh"])).alias("_marks"))
    near = F.filter("_marks", lambda m: (m["y"] <= F.col("y") + F.col("h")) & (m["y"] + m["h"] >= F.col("y")))
    return rows.join(listed, key, "left").withColumn("_marks", near)


def outside_areas(words: DataFrame) -> DataFrame:
    """The words without those whose middle is in one of their `_marks`, or a quarter of whose box is."""
    whole = F.col("w") * F.col("h")

    def hit(m: Column) -> Column:
        side = lambda a, s: F.greatest(F.lit(0.0), F.least(F.col(a) + F.col(s), m[a] + m[s]) - F.greatest(F.col(a), m[a]))
        middle = lambda a, s: (F.col(a) + F.col(s) / 2).between(m[a], m[a] + m[s])
        share = F.when(whole > 0, side("x", "w") * side("y", "h") / F.when(whole > 0, whole).otherwise(1.0)).otherwise(0.0)
        return (share >= COVERED_SHARE) | (middle("x", "w") & middle("y", "h"))

    none = F.col("_marks").isNull() | (F.size("_marks") == 0)
    return words.where(none | ~F.coalesce(F.exists("_marks", hit), F.lit(False))).drop("_marks")


def redact_areas(words: DataFrame, areas: DataFrame) -> DataFrame:
    """The words left outside the marks."""
    return outside_areas(with_areas(words, areas))


def merge_intervals(intervals: DataFrame, keys: Sequence[str], gap: int = 0, width: int = 65536) -> DataFrame:
    """Whole-number intervals `(start, end)` that overlap or lie within `gap` joined; empty ones dropped."""
    keys = list(keys)
    widest = intervals.where("end > start").groupBy(*keys, "start").agg(F.max("end").alias("end"))
    seen = blocks.scan(blocks.by_value(widest, "start", width), keys, ["start"], _reach=("max_before", "end"))
    fresh = seen.withColumn("_new", (F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + gap)).cast("long"))
    runs = blocks.scan(blocks.by_value(fresh, "start", width), keys, ["start"], _run=("sum", "_new"))
    return runs.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def split_intervals(intervals: DataFrame, longest: int, alignment: int = 1) -> DataFrame:
    """Intervals cut into pieces of at most `longest`, each after the first starting at a multiple of `alignment`."""
    longest = max(alignment, longest // alignment * alignment)
    first = F.floor((F.col("start") + longest) / alignment) * alignment
    first = F.when(first <= F.col("start"), F.col("start") + longest).otherwise(first)
    more = F.when(first < F.col("end"), F.sequence(first, F.col("end") - 1, F.lit(longest))).otherwise(F.array().cast("array<bigint>"))
    cuts = F.concat(F.array("start"), more)
    rows = intervals.withColumn("_cuts", cuts).withColumn("_ends", F.concat(F.expr("slice(_cuts, 2, size(_cuts))"), F.array("end")))
    rows = rows.select(*[c for c in intervals.columns if c not in ("start", "end")], F.explode(F.arrays_zip("_cuts", "_ends")).alias("_p"))
    return rows.select("*", F.col("_p._cuts").alias("start"), F.col("_p._ends").alias("end")).drop("_p")
