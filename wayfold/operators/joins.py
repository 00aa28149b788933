"""Joins that Spark has no operator for: near places, polygons, nearest, overlap, latest before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayfold.functions import geo
from wayfold.operators.asof import asof


def within_distance(left: DataFrame, right: DataFrame, metres: float, **made: Column) -> DataFrame:
    """Pairs at most `metres` apart, with their distance_m. left has lat, lon; right has r_lat, r_lon. made: columns from distance_m.

    An equi-join by grid cell: each place meets the cells around its own, so that rows far apart never meet. Distances
    and what is made from them are computed once for two places; the rows that lie there are put to them after that.
    """
    row, column = geo.cell(F.col("lat"), F.col("lon"), metres)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = left.select("lat", "lon").distinct().withColumn("_cell", F.explode(geo.neighbour_cells(row, column)))
    r_row, r_column = geo.cell(F.col("r_lat"), F.col("r_lon"), metres)
    keyed = right.select("r_lat", "r_lon").distinct().withColumn("_cell", F.struct(r_row.alias("row"), r_column.alias("column")))
    met = near.join(keyed, "_cell").withColumn("distance_m", geo.haversine(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")))
    # Dealt anew: the few places become many rows, in all tasks; and without a shuffle between, Spark computes the columns for each row of the join.
    places = met.where(F.col("distance_m") <= metres).drop("_cell").withColumns(made).repartition(parts, "lat", "lon", "r_lat", "r_lon")
    return left.join(places, ["lat", "lon"]).join(right, ["r_lat", "r_lon"])


def within_radius(points: DataFrame, lat: float, lon: float, metres: float) -> DataFrame:
    """Points around one place, nearest last decided by the caller; the box goes to the scan, the distance after it."""
    bounds = geo.box(F.lit(lat), F.lit(lon), metres)
    return points.where(geo.in_box(F.col("lat"), F.col("lon"), bounds)).withColumn("distance_m", geo.haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).where(F.col("distance_m") <= metres)


def in_fence(lat: Column, lon: Column, fence: str = "") -> Column:
    """Whether a place is in a fence: its boundary if it has one, else the circle of its radius."""
    c = lambda n: F.col(f"{fence}{n}")
    return F.when(c("boundary").isNotNull(), geo.in_ring(lat, lon, c("boundary"))).otherwise(geo.haversine(lat, lon, c("lat"), c("lon")) <= c("radius"))


def fence_box(fence: str = "") -> dict[str, Column]:
    """The bounds of a fence's boundary, or of its circle."""
    c = lambda n: F.col(f"{fence}{n}")
    side = lambda f, n: f(F.transform(c("boundary"), lambda p: p[n]))
    circle = geo.box(c("lat"), c("lon"), c("radius"))
    ring = {"south": side(F.array_min, "lat"), "north": side(F.array_max, "lat"), "west": side(F.array_min, "lon"), "east": side(F.array_max, "lon")}
    return {k: F.coalesce(ring[k], circle[k]) for k in ring}


def fenced(points: DataFrame, fences: DataFrame, size_m: float = 1000.0) -> DataFrame:
    """points (lat, lon, ...) with each fence (g_lat, g_lon, g_radius, g_boundary, ...) in whose bounds they lie, and `inside`.

    An equi-join by grid cell: a fence has the cells of its bounds, so points far from all fences meet none.
    """
    bounds = fence_box("g_")
    boxed = fences.select("*", *[v.alias(f"_{k}") for k, v in bounds.items()])
    south, west = geo.cell(F.col("_south"), F.col("_west"), size_m)
    north, east = geo.cell(F.col("_north"), F.col("_east"), size_m)
    cells = boxed.withColumn("_row", F.explode(F.sequence(south, north))).withColumn("_column", F.explode(F.sequence(west, east)))
    row, column = geo.cell(F.col("lat"), F.col("lon"), size_m)
    met = points.withColumn("_row", row).withColumn("_column", column).join(cells, ["_row", "_column"])
    held = met.where(geo.in_box(F.col("lat"), F.col("lon"), {k: F.col(f"_{k}") for k in bounds}))
    return held.withColumn("inside", in_fence(F.col("lat"), F.col("lon"), "g_")).drop("_row", "_column", *[f"_{k}" for k in bounds])


def near_lines(points: DataFrame, segs: DataFrame, metres: float, key: str) -> DataFrame:
    """(key, route_id, direction, distance_m) for each point (key, lat, lon) and line at most `metres` from it.

    Segments are laid out in grid cells twice as wide as that: a place of a segment at every cell's half, with the
    cells around it. Whatever is near a segment lies in one of them, so an equi-join by cell finds all pairs.
    """
    size = 2 * metres
    steps = F.greatest(F.ceil(F.col("length_m") / (size / 2)).cast("int"), F.lit(1))
    laid = segs.withColumn("_at", F.explode(F.transform(F.sequence(F.lit(0), steps), lambda i: i / steps)))
    row, column = geo.cell(F.expr("a_lat + (b_lat - a_lat) * _at"), F.expr("a_lon + (b_lon - a_lon) * _at"), size)
    cells = laid.withColumn("_cell", F.explode(geo.neighbour_cells(row, column))).select("_cell", "route_id", "direction", "a_lat", "a_lon", "b_lat", "b_lon").distinct()
    # What depends on the segment alone is computed before the join; pairs are first held apart on the plane.
    flat = cells.withColumn("_k", F.cos(F.radians((F.col("a_lat") + F.col("b_lat")) / 2))).withColumn("_dx", F.expr("(b_lon - a_lon) * _k")).withColumn("_dy", F.expr("b_lat - a_lat")).withColumn("_n", F.expr("_dx * _dx + _dy * _dy"))
    p_row, p_column = geo.cell(F.col("lat"), F.col("lon"), size)
    met = points.select(key, "lat", "lon", F.struct(p_row.alias("row"), p_column.alias("column")).alias("_cell")).join(flat, "_cell")
    met = met.withColumn("_t", F.expr("case when _n = 0 then 0.0D else greatest(0.0D, least(1.0D, ((lon - a_lon) * _k * _dx + (lat - a_lat) * _dy) / _n)) end"))
    met = met.withColumn("_lat", F.expr("a_lat + _dy * _t")).withColumn("_lon", F.expr("a_lon + (b_lon - a_lon) * _t"))
    close = met.where(F.expr("(lat - _lat) * (lat - _lat) + (lon - _lon) * (lon - _lon) * _k * _k") <= (1.02 * metres / geo.DEGREE_M) ** 2)
    away = geo.haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    # The limit is a condition on the minimum: as one on pairs it would become part of the join, with all of this in it.
    return close.select(key, "route_id", "direction", away.alias("d")).groupBy(key, "route_id", "direction").agg(F.min("d").alias("distance_m")).where(F.col("distance_m") <= metres)


def nearest(left: DataFrame, right: DataFrame, on: list[str], left_key: str, right_key: str) -> DataFrame:
    """For each left row the right row of the same `on` that is nearest; ties go to the smaller right_key.

    left has lat, lon; right has r_lat, r_lon. The right rows of an `on` are an array, so a left row stays one row.
    """
    kept = [right_key, *[c for c in right.columns if c not in (*on, right_key, "r_lat", "r_lon")]]
    held = right.groupBy(*on).agg(F.collect_list(F.struct("r_lat", "r_lon", *kept)).alias("_held"))
    away = F.transform("_held", lambda x: F.struct(geo.haversine(F.col("lat"), F.col("lon"), x["r_lat"], x["r_lon"]).alias("distance_m"), *[x[c].alias(c) for c in kept]))
    best = left.join(F.broadcast(held), on).select(left_key, F.array_min(away).alias("_b")).groupBy(left_key).agg(F.min("_b").alias("_b"))
    return best.select(left_key, *[F.col(f"_b.{c}").alias(c) for c in right.columns if c in kept], F.col("_b.distance_m").alias("distance_m"))


def overlapping(df: DataFrame, on: list[str], key: str, start: str, end: str, slot: int) -> DataFrame:
    """Pairs (a_key < b_key) of rows with equal `on` whose periods overlap; a null end is open.

    Rows are dealt to time slots of length `slot`, so that only rows of a common slot meet; a pair counts in the
    slot where its overlap starts. Open ends have a slot of their own before that, the `tail`.
    """
    row = df.select(*on, F.col(key).alias("key"), F.col(start).alias("s"), F.col(end).alias("e"))
    last = row.agg(F.max(F.greatest("s", F.coalesce("e", "s"))).alias("last"))
    bounded = row.crossJoin(F.broadcast(last)).withColumn("stop", F.coalesce("e", "last"))
    cut = bounded.withColumn("slot", F.explode(F.sequence(F.floor(F.col("s") / slot), F.floor(F.greatest("stop", "s") / slot))))
    a = cut.select(*on, "slot", F.col("key").alias("a_key"), F.col("s").alias("a_s"), F.col("stop").alias("a_e"))
    b = cut.select(*on, "slot", F.col("key").alias("b_key"), F.col("s").alias("b_s"), F.col("stop").alias("b_e"))
    met = a.join(b, [*on, "slot"]).where("a_key < b_key and a_s <= b_e and b_s <= a_e").where(F.floor(F.greatest("a_s", "b_s") / slot) == F.col("slot"))
    return met.select(*on, "a_key", "b_key", F.greatest("a_s", "b_s").alias("from"))


def latest_before(facts: DataFrame, asked: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each asked row (key, time, ...) with the value of the last fact at or before its time."""
    return asof(asked, facts, [key], time, [value])


def segments(placed_stops: DataFrame) -> DataFrame:
    """Segments of each route and direction: (a_lat, a_lon) to (b_lat, b_lon), numbered from 0, with start_m and length_m."""
    w = W.partitionBy("route_id", "direction").orderBy("seq")
    ends = placed_stops.select("route_id", "direction", "seq", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.lead("lat").over(w).alias("b_lat"), F.lead("lon").over(w).alias("b_lon")).where("b_lat is not null")
    cut = ends.withColumn("length_m", geo.haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")))
    before = W.partitionBy("route_id", "direction").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return cut.select("route_id", "direction", (F.col("seq") - 1).alias("segment"), "a_lat", "a_lon", "b_lat", "b_lon", "length_m", F.coalesce(F.sum("length_m").over(before), F.lit(0.0)).alias("start_m"))


def snap(points: DataFrame, segs: DataFrame, on: list[str], key: str) -> DataFrame:
    """Each point (key, on, lat, lon) on the nearest segment of its line: segment, snap_lat, snap_lon, distance_m, along_m, fraction.

    Equally near segments: the first. A line's segments are an array, so a point stays one row.
    """
    parts = ["segment", "a_lat", "a_lon", "b_lat", "b_lon", "length_m", "start_m"]
    lines = segs.groupBy(*on).agg(F.collect_list(F.struct(*parts)).alias("_line"), F.max(F.col("start_m") + F.col("length_m")).alias("line_m"))

    def place(s):
        # Passes of their own, so that each part is computed once for a segment.
        t = geo.project_t(F.col("lat"), F.col("lon"), s["a_lat"], s["a_lon"], s["b_lat"], s["b_lon"])
        return F.transform(F.array(t), lambda u: F.struct(s["segment"].alias("segment"), (s["a_lat"] + (s["b_lat"] - s["a_lat"]) * u).alias("s_lat"), (s["a_lon"] + (s["b_lon"] - s["a_lon"]) * u).alias("s_lon"), (s["start_m"] + s["length_m"] * u).alias("along_m")))

    away = F.transform(F.flatten(F.transform("_line", place)), lambda q: F.struct(F.round(geo.haversine(F.col("lat"), F.col("lon"), q["s_lat"], q["s_lon"]), 6).alias("d"), q["segment"].alias("segment"), q["s_lat"].alias("s_lat"), q["s_lon"].alias("s_lon"), q["along_m"].alias("along_m")))
    met = points.join(F.broadcast(lines), on).select(key, *on, "line_m", F.array_min(away).alias("b"))
    out = met.groupBy(key, *on, "line_m").agg(F.min("b").alias("b"))
    return out.select(key, *on, F.col("b.segment").alias("segment"), F.col("b.s_lat").alias("snap_lat"), F.col("b.s_lon").alias("snap_lon"), F.col("b.d").alias("distance_m"), F.col("b.along_m").alias("along_m"), F.expr("case when line_m > 0 then b.along_m / line_m else 0.0D end").alias("fraction"))
