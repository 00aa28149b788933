"""Trip options put together from rides: walks, waits and rides as one array of legs, held against limits along it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo

#: Minutes of a walk at either end, metres between the ends of legs, minutes of a wait and of all rides and waits by transfers.
MOST_WALK_MIN, JOIN_M, MOST_WAIT_MIN, MOST_MIN = 15, 100.0, (None, 30, 25), (None, 100, 150)
PLACE = "stop_id: bigint, lat: double, lon: double"
LEG = f"struct<kind: string, route_id: bigint, start: struct<{PLACE}>, stop: struct<{PLACE}>, minutes: bigint>"


def _leg(kind: str, route: Column, start: Column, stop: Column, minutes: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), route.cast("bigint").alias("route_id"), start.alias("start"), stop.alias("stop"), minutes.cast("bigint").alias("minutes")).cast(LEG)


def _apart(a: Column, b: Column) -> Column:
    return F.round(geo.haversine(a["lat"], a["lon"], b["lat"], b["lon"]), 3)


def _walk(a: Column, b: Column) -> Column:
    """The walk between two places as an array of one leg, or of none where they are one place or stop."""
    none = F.array().cast(f"array<{LEG}>")
    same = F.coalesce(a["stop_id"] == b["stop_id"], F.lit(False)) | (_apart(a, b) == 0)
    return F.when(same, none).otherwise(F.array(_leg("WALK", F.lit(None), a, b, geo.walk_minutes(_apart(a, b)))))


def assemble(journeys: DataFrame) -> DataFrame:
    """journeys with legs, walk_min, wait_min, ride_min, minutes, transfers and verdict.

    journeys: origin and target (struct of stop_id, lat, lon; a place that is no stop has none) and rides, an array in
    order of (route_id, start, stop, ride_s, wait_s). A wait is put before each ride, and a walk between places that differ.
    Minutes of rides and waits are whole ones, at least one for a ride. verdict: the first that applies of NO_RIDE, WALK
    (an end's walk is too long), ROUTES (one route twice), WAIT, TOTAL (by the number of transfers; more than two is none),
    GAP (legs whose ends are too far apart), UNKNOWN (a place or time is missing), else OK.
    """
    ride = lambda x: _leg("RIDE", x["route_id"], x["start"], x["stop"], F.when(x["ride_s"].isNotNull(), F.greatest(F.lit(1), F.floor(x["ride_s"] / 60))))
    wait = lambda x: _leg("WAIT", x["route_id"], x["start"], x["start"], F.floor(x["wait_s"] / 60))
    end = F.element_at("rides", -1)["stop"]
    reached = lambda i: F.when(i == 0, F.col("origin")).otherwise(F.get("rides", i - 1)["stop"])
    body = F.flatten(F.transform("rides", lambda x, i: F.concat(_walk(reached(i), x["start"]), F.array(wait(x), ride(x)))))
    legs = F.when(F.size("rides") > 0, F.concat(body, _walk(end, F.col("target"))))
    total = lambda kind: F.aggregate(F.filter("legs", lambda g: g["kind"] == kind), F.lit(0).cast("bigint"), lambda acc, g: acc + g["minutes"])
    out = journeys.withColumn("legs", legs).withColumns({f"{k.lower()}_min": total(k) for k in ("WALK", "WAIT", "RIDE")})
    out = out.withColumn("minutes", F.expr("walk_min + wait_min + ride_min")).withColumn("transfers", F.size("rides") - 1)
    far = lambda g: (g["kind"] == "WALK") & (g["minutes"] > MOST_WALK_MIN)
    by_transfers = lambda limits: F.when(F.col("transfers") == 1, limits[1]).when(F.col("transfers") == 2, limits[2])
    gaps = F.zip_with(F.slice("legs", 1, F.size("legs") - 1), F.slice("legs", 2, F.size("legs") - 1), lambda a, b: _apart(a["stop"], b["start"]) > JOIN_M)
    routes = F.transform("rides", lambda x: x["route_id"])
    verdict = (
        F.when(F.coalesce(F.size("rides"), F.lit(0)) <= 0, "NO_RIDE")
        .when(far(F.element_at("legs", 1)) | far(F.element_at("legs", -1)), "WALK")
        .when(F.size(F.array_distinct(routes)) < F.size(routes), "ROUTES")
        .when(F.exists("legs", lambda g: (g["kind"] == "WAIT") & (g["minutes"] > by_transfers(MOST_WAIT_MIN))), "WAIT")
        .when((F.col("wait_min") + F.col("ride_min") > by_transfers(MOST_MIN)) | (F.col("transfers") > 2), "TOTAL")
        .when(F.exists(gaps, lambda g: g), "GAP")
        .when(F.col("minutes").isNull(), "UNKNOWN")
        .otherwise("OK")
    )
    return out.withColumn("verdict", verdict)


def path(legs: Column) -> Column:
    """Legs as text: kind:route:minutes, joined by semicolons."""
    return F.array_join(F.transform(legs, lambda g: F.concat(g["kind"], F.lit(":"), F.coalesce(g["route_id"].cast("string"), F.lit("")), F.lit(":"), g["minutes"].cast("string"))), ";")
