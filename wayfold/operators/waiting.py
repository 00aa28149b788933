"""How long a rider waits at a stop and rides from there: by vehicles that come, else by what is usual, else by the timetable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayfold.operators.asof import asof

#: How far ahead a vehicle and how far back the last one count, the longest usual wait, seconds of a leg without history, gaps or trips that a mean needs.
AHEAD_S, BACK_S, MOST_WAIT_S, LEG_S, TRUSTED = 3600, 600, 1800, 120, 3
STOP = ["route_id", "direction", "seq"]


def headways(visits: DataFrame) -> DataFrame:
    """The mean time between arrivals at the stops of a route and direction, in whole microseconds, where there are enough."""
    w = W.partitionBy(*STOP).orderBy("arrived_us", "vehicle_id", "trip")
    gaps = visits.withColumn("gap_us", F.col("arrived_us") - F.lag("arrived_us").over(w)).where("gap_us is not null")
    g = gaps.groupBy("route_id", "direction").agg(F.sum("gap_us").alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= TRUSTED)
    return g.select("route_id", "direction", F.expr("s div n").alias("gap_us"))


def along(visits: DataFrame, stops: DataFrame) -> DataFrame:
    """Seconds from a line's first stop to each of its stops: the mean of each leg, or a fixed value where too few rode it."""
    us = F.expr("cast(round(travel_s * 1e6D) as bigint)")
    g = visits.where("travel_s > 0").groupBy(*STOP).agg(F.sum(us).alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= TRUSTED).select(*STOP, F.expr("s div n div 1000000").alias("leg"))
    legs = stops.select(*STOP).join(g, STOP, "left").withColumn("leg", F.expr(f"case when seq > 1 then coalesce(leg, {LEG_S}) else 0 end"))
    return legs.select(*STOP, F.sum("leg").over(W.partitionBy("route_id", "direction").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)).alias("along_s"))


def waits(asked: DataFrame, visits: DataFrame, stops: DataFrame, timetable: DataFrame) -> DataFrame:
    """asked (request, route_id, direction, seq, to_seq, at_us) with source, wait_s, vehicle_id, since_s, travel_s and stops_between.

    source: VEHICLE, the next to arrive within AHEAD_S; STATISTICS, half the mean time between arrivals; TIMETABLE, half the
    headway (timetable: route_id, headway_s); NONE. since_s: since the last one left, within BACK_S.
    """
    came = visits.select(*STOP, "vehicle_id", F.col("arrived_us").alias("at_us"), F.col("arrived_us").alias("next_us"))
    left = visits.select(*STOP, F.col("departed_us").alias("at_us"), F.col("departed_us").alias("last_us"))
    met = asof(asked, came, STOP, "at_us", ["next_us", "vehicle_id"], after=True, tolerance=AHEAD_S * 1_000_000)
    met = asof(met, left, STOP, "at_us", ["last_us"], tolerance=BACK_S * 1_000_000)
    met = met.join(headways(visits), ["route_id", "direction"], "left").join(timetable, "route_id", "left")
    line = along(visits, stops)
    met = met.join(line.withColumnRenamed("along_s", "from_s"), STOP, "left").join(line.selectExpr("route_id", "direction", "seq as to_seq", "along_s as to_s"), ["route_id", "direction", "to_seq"], "left")
    return met.selectExpr(
        "request", "route_id", "direction", "seq", "to_seq", "at_us",
        "case when next_us is not null then 'VEHICLE' when gap_us is not null then 'STATISTICS' when headway_s is not null then 'TIMETABLE' else 'NONE' end as source",
        f"case when next_us is not null then (next_us - at_us) div 1000000 when gap_us is not null then least(gap_us div 2 div 1000000, {MOST_WAIT_S}) when headway_s is not null then headway_s div 2 end as wait_s",
        "vehicle_id", "(at_us - last_us) div 1000000 as since_s", "to_s - from_s as travel_s", "cast(to_seq - seq - 1 as bigint) as stops_between",
    )
