"""Which line a track follows: matches by distance, and swaps of routes.

Tracks meet only lines that come near their fixes (joins.near_lines); the network is never crossed with the fixes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators.joins import near_lines
from wayfold.operators.storage import scratch, stored

#: Metres of a near fix and of no likeness, weights of both parts, the least score of a match.
NEAR_M, FAR_M, NEAR_WEIGHT, FAR_WEIGHT, LEAST = 100.0, 500.0, 0.6, 0.4, 0.7
#: Metres of a fix off its line, moving fixes of a window, shares near the own and the foreign line.
OFF_M, LEAST_FIXES, MOST_OWN, LEAST_FOREIGN = 300.0, 3, 0.3, 0.6


def match_routes(fixes: DataFrame, segs: DataFrame) -> DataFrame:
    """vehicle_id, route_id, direction, points, score, confidence of the best route with at least the least score.

    fixes: fix_id, vehicle_id, lat, lon. A line scores that much only if at least half of the fixes are near it, so
    only such pairs of vehicle and line are candidates.
    """
    line_keys, fixes = ["vehicle_id", "route_id", "direction"], fixes.select("fix_id", "vehicle_id", "lat", "lon")
    points = fixes.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("points"))
    close = stored(near_lines(fixes, segs, NEAR_M, "fix_id"), scratch(fixes.sparkSession, "near-lines"))
    near = close.join(fixes.select("fix_id", "vehicle_id"), "fix_id").groupBy(*line_keys).agg(F.count(F.lit(1)).alias("near"), F.sum("distance_m").alias("near_m"))
    share = (LEAST - FAR_WEIGHT) / NEAR_WEIGHT
    candidates = near.join(points, "vehicle_id").where(F.col("near") >= F.col("points") * share - 1e-6)
    lines = segs.groupBy("route_id", "direction").agg(F.collect_list(F.struct("a_lat", "a_lon", "b_lat", "b_lon")).alias("line"))

    def place(s):
        # A pass of its own, so that the projection is computed once for each segment.
        u = geo.project_t(F.col("lat"), F.col("lon"), s["a_lat"], s["a_lon"], s["b_lat"], s["b_lon"])
        return F.transform(F.array(u), lambda x: F.struct((s["a_lat"] + (s["b_lat"] - s["a_lat"]) * x).alias("lat"), (s["a_lon"] + (s["b_lon"] - s["a_lon"]) * x).alias("lon")))

    away = F.array_min(F.transform(F.flatten(F.transform("line", place)), lambda q: geo.haversine(F.col("lat"), F.col("lon"), q["lat"], q["lon"])))
    # Distances of near fixes are known; only the others of a candidate are measured against its whole line.
    others = fixes.join(candidates.where("near < points").select(*line_keys), "vehicle_id").join(close.select("fix_id", "route_id", "direction"), ["fix_id", "route_id", "direction"], "left_anti")
    far = others.join(lines, ["route_id", "direction"]).withColumn("d", away).groupBy(*line_keys).agg(F.sum("d").alias("far_m"))
    scored = candidates.join(far, line_keys, "left").withColumn("mean_m", (F.col("near_m") + F.coalesce("far_m", F.lit(0.0))) / F.col("points"))
    score = F.round(F.col("near") / F.col("points") * NEAR_WEIGHT + (1 - F.least(F.col("mean_m") / FAR_M, F.lit(1.0))) * FAR_WEIGHT, 9)
    side = lambda k: F.coalesce(F.max(F.when(F.col("direction") == k, F.col("score"))), F.lit(0.0))
    both = scored.withColumn("score", score).groupBy("vehicle_id", "route_id").agg(F.max("points").alias("points"), side(0).alias("forward"), side(1).alias("backward")).withColumn("score", F.greatest("forward", "backward"))
    best = both.where(F.col("score") >= LEAST).groupBy("vehicle_id").agg(F.min(F.struct((-F.col("score")).alias("o"), "route_id", F.expr("case when forward >= backward then 0 else 1 end").alias("direction"), "points", "score")).alias("b"))
    return best.select("vehicle_id", "b.route_id", "b.direction", "b.points", "b.score", F.round(F.col("b.score") * 100).cast("int").alias("confidence"))


def swap_windows(moving: DataFrame, segs: DataFrame) -> DataFrame:
    """vehicle_id, window_no, fixes, own_share, off_share, foreign_share, verdict over moving fixes (fix_id, vehicle_id, window_no, assigned, lat, lon)."""
    keys = ["vehicle_id", "window_no"]
    near = near_lines(moving, segs, OFF_M, "fix_id").groupBy("fix_id", "route_id").agg(F.min("distance_m").alias("d"))
    own = near.withColumnRenamed("route_id", "assigned").withColumnRenamed("d", "own_m")
    sizes = moving.join(own, ["fix_id", "assigned"], "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("fixes"), F.avg(F.coalesce(F.col("own_m") <= NEAR_M, F.lit(False)).cast("int")).alias("own_share"), F.avg(F.col("own_m").isNull().cast("int")).alias("off_share"))
    other = near.where(F.col("d") <= NEAR_M).join(moving.select("fix_id", *keys, "assigned"), "fix_id").where("route_id <> assigned").groupBy(*keys, "route_id").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max("n").alias("n"))
    met = sizes.join(other, keys, "left").withColumn("foreign_share", F.coalesce(F.col("n") / F.col("fixes"), F.lit(0.0)))
    verdict = F.when(F.col("fixes") < LEAST_FIXES, "INVALID").when((F.col("own_share") <= MOST_OWN) & (F.col("foreign_share") >= LEAST_FOREIGN), "SWAP").otherwise("NONE")
    return met.withColumn("verdict", verdict).drop("n")
