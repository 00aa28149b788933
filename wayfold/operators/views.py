"""Analytical views of a network and of trip searches, DataFrames in and out.

Counts of distinct things on two sides of a key (a route's stops and its vehicles) are made on each side first, so
that the sides never multiply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decimal_round(x: Column, places: int) -> Column:
    """Half up on the decimal value."""
    return F.round(x.cast("decimal(20,10)"), places).cast("double")


def vehicle_counts(vehicles: DataFrame) -> DataFrame:
    """All, active and moving vehicles of each route, and the last update of any."""
    return vehicles.where("route_id is not null").groupBy("route_id").agg(F.count(F.lit(1)).alias("total_vehicles"), F.count_if("is_active").alias("active_vehicles"), F.count_if("in_motion").alias("moving_vehicles"), F.max("updated_us").alias("last_update_us"))


def ordered_pairs(route_stops: DataFrame, most_apart: int | None = None, equal: bool = False) -> DataFrame:
    """Stop pairs of a route and direction in travel order; pairs of a stop with itself only if asked for."""
    a = route_stops.select("route_id", "direction", F.col("stop_id").alias("from_stop"), F.col("seq").alias("from_seq"))
    b = route_stops.select("route_id", "direction", F.col("stop_id").alias("to_stop"), F.col("seq").alias("to_seq"))
    near = F.lit(True) if most_apart is None else F.col("to_seq") - F.col("from_seq") <= most_apart
    return a.join(b, ["route_id", "direction"]).where((F.col("from_seq") < F.col("to_seq")) & (F.lit(equal) | (F.col("from_stop") != F.col("to_stop"))) & near)


def between_active(pairs: DataFrame, routes: DataFrame, stops: DataFrame) -> DataFrame:
    """Stop pairs of active routes whose stops are both active, with the route's number and the stops' names and places."""
    active = stops.where("is_active")
    end = lambda side: active.select(F.col("stop_id").alias(f"{side}_stop"), F.col("name").alias(f"{side}_name"), F.col("lat").alias(f"{side}_lat"), F.col("lon").alias(f"{side}_lon"))
    return pairs.join(routes.where("is_active").select("route_id", "number"), "route_id").join(end("from"), "from_stop").join(end("to"), "to_stop")


def popular_direct_routes(routes: DataFrame, route_stops: DataFrame, vehicles: DataFrame, stops: DataFrame) -> DataFrame:
    pairs = between_active(ordered_pairs(route_stops, 20, equal=True), routes, stops)
    counts = vehicle_counts(vehicles).select("route_id", "active_vehicles")
    out = pairs.join(counts, "route_id", "left")
    return out.select("from_stop", "to_stop", "route_id", "number", "direction", ((F.col("to_seq") - F.col("from_seq")) * 2).alias("est_minutes"), F.coalesce("active_vehicles", F.lit(0)).cast("bigint").alias("active_vehicles"), "from_name", "from_lat", "from_lon", "to_name", "to_lat", "to_lon")


def route_statistics(routes: DataFrame, route_stops: DataFrame, vehicles: DataFrame) -> DataFrame:
    stops = route_stops.groupBy("route_id").agg(F.count_distinct("stop_id").alias("total_stops"), F.count_distinct(F.expr("case when direction = 0 then stop_id end")).alias("forward_stops"), F.count_distinct(F.expr("case when direction = 1 then stop_id end")).alias("backward_stops"), F.max("seq").alias("max_seq"))
    out = routes.join(stops, "route_id", "left").join(vehicle_counts(vehicles), "route_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select("route_id", "number", "is_active", *[zero(c) for c in ("total_stops", "forward_stops", "backward_stops", "total_vehicles", "active_vehicles")], F.col("max_seq").cast("int").alias("max_seq"))


def stop_connections(route_stops: DataFrame, routes: DataFrame, stops: DataFrame) -> DataFrame:
    pairs = between_active(ordered_pairs(route_stops), routes, stops).withColumn("minutes", (F.col("to_seq") - F.col("from_seq")) * 2)
    return pairs.groupBy("from_stop", "to_stop", "from_name", "to_name").agg(F.count_distinct("route_id").alias("routes"), F.array_join(F.array_sort(F.collect_set("number")), ",").alias("numbers"), F.min("minutes").cast("int").alias("least_minutes"), F.round(F.avg("minutes"), 6).alias("mean_minutes"))


def active_routes_summary(routes: DataFrame, route_stops: DataFrame, vehicles: DataFrame) -> DataFrame:
    stops = route_stops.groupBy("route_id").agg(F.count_distinct("stop_id").alias("stops"))
    out = routes.where("is_active").join(vehicle_counts(vehicles), "route_id", "left").join(stops, "route_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select("route_id", "number", "color", "duration_min", zero("active_vehicles"), zero("moving_vehicles"), zero("stops"), "last_update_us")


def search_hourly(plans: DataFrame, options: DataFrame) -> DataFrame:
    """Searches by hour, those with and without options, and the mean number of options, none counting as 0."""
    counts = options.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"))
    hours = plans.join(counts, "plan_id", "left").withColumn("hour_us", F.expr("created_us - created_us % 3600000000"))
    return hours.groupBy("hour_us").agg(F.count(F.lit(1)).alias("searches"), F.count_if(F.col("n").isNotNull()).alias("successful"), F.count_if(F.col("n").isNull()).alias("failed"), F.round(F.avg(F.coalesce("n", F.lit(0))), 6).alias("mean_options"))


def search_heatmap(plans: DataFrame) -> DataFrame:
    ends = plans.select(F.lit("origin").alias("kind"), F.col("o_lat").alias("lat"), F.col("o_lon").alias("lon")).unionByName(plans.select(F.lit("destination").alias("kind"), F.col("d_lat").alias("lat"), F.col("d_lon").alias("lon")))
    return ends.groupBy("kind", decimal_round(F.col("lat"), 3).alias("lat3"), decimal_round(F.col("lon"), 3).alias("lon3")).agg(F.count(F.lit(1)).alias("searches"))


def popular_od_pairs(plans: DataFrame, options: DataFrame, least: int = 2) -> DataFrame:
    counts = options.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"))
    r = lambda c: decimal_round(F.col(c), 2).alias(f"{c}2")
    return plans.join(counts, "plan_id", "left").groupBy(*[r(c) for c in ("o_lat", "o_lon", "d_lat", "d_lon")]).agg(F.count(F.lit(1)).alias("searches"), F.round(F.avg(F.coalesce("n", F.lit(0))), 6).alias("mean_options")).where(F.col("searches") >= least)


def plan_statistics(plans: DataFrame, options: DataFrame) -> DataFrame:
    """By day: plans, those with options, mean options and minutes, and the route most often in an option."""
    by_plan = options.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"), F.sum("minutes").alias("minutes"))
    day = F.expr("created_us div 86400000000").alias("day")
    totals = plans.join(by_plan, "plan_id", "left").groupBy(day).agg(F.count(F.lit(1)).alias("plans"), F.count("n").alias("successful"), F.round(F.avg(F.coalesce("n", F.lit(0))), 6).alias("mean_options"), F.round(F.sum("minutes") / F.sum("n"), 6).alias("mean_minutes"))
    used = plans.select("plan_id", day).join(options.select("plan_id", "route_id"), "plan_id").groupBy("day", "route_id").agg(F.count(F.lit(1)).alias("uses"))
    mode = used.groupBy("day").agg(F.max_by("route_id", F.struct("uses", -F.col("route_id"))).alias("top_route"))
    return totals.join(mode, "day", "left")
