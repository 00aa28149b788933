"""Round-based earliest arrival over a timetable, all requests at once.

Requests that can walk to the same stops of lines, in the same seconds from the same departure, share one search: a
source. Targets that are walked to from the same stops are one as well. So searches grow with the places that differ
for the lines, not with the requests, and only results come back to each request.

A round is a join: labels (source, stop, arrival) board every line that calls at their stop, at the first departure
from then on, ride to all later stops, and walk one transfer. Labels improve by a minimum; a round goes on from stops
that improved only. Labels carry their legs, so paths need no pointers back. Each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayfold.operators.storage import scratch, stored

LEGS = "array<struct<kind:string,route_id:bigint,direction:int,from_stop:bigint,to_stop:bigint,start_s:bigint,end_s:bigint>>"


def boardings(timetable: DataFrame) -> DataFrame:
    """Rides between stops of a line: board offset, ride and total."""
    a = timetable.select("route_id", "direction", F.col("position").alias("p1"), F.col("stop_id").alias("stop"), F.col("offset_s").alias("o1"))
    b = timetable.select("route_id", "direction", F.col("position").alias("p2"), F.col("stop_id").alias("to_stop"), F.col("offset_s").alias("o2"))
    return a.join(b, ["route_id", "direction"]).where("p1 < p2 and stop <> to_stop").select("route_id", "direction", "stop", "to_stop", "o1", (F.col("o2") - F.col("o1")).alias("ride_s"))


def _least(labels: DataFrame, *by: str) -> DataFrame:
    best = labels.groupBy(*by).agg(F.min(F.struct("arrival_s", F.size("legs").alias("n"), "legs")).alias("b"))
    return best.select(*by, F.col("b.arrival_s").alias("arrival_s"), F.col("b.legs").alias("legs"))


def _leg(kind: str, route_id: Column, direction: Column, from_stop: str, to_stop: str, start_s: Column, seconds: Column) -> Column:
    return F.array(F.struct(F.lit(kind).alias("kind"), route_id.cast("bigint").alias("route_id"), direction.cast("int").alias("direction"), F.col(from_stop).alias("from_stop"), F.col(to_stop).alias("to_stop"), start_s.alias("start_s"), (start_s + seconds).alias("end_s"))).cast(LEGS)


def _walk(from_stop: str, to_stop: str, start_s: str) -> Column:
    """The leg of walk_s, none where that is null."""
    walk = _leg("WALK", F.lit(None), F.lit(None), from_stop, to_stop, F.col(start_s), F.col("walk_s"))
    return F.when(F.col("walk_s").isNotNull(), walk).otherwise(F.array().cast(LEGS))


def shared(ways: DataFrame, stop: str, name: str) -> DataFrame:
    """stop, its ways (stop, walk_s) in order, and as `name` the first of the stops that have the same ones. ways: `stop`, way, walk_s."""
    listed = ways.groupBy(stop).agg(F.sort_array(F.collect_set(F.struct(F.col("way").alias("stop"), "walk_s"))).alias("ways"))
    return listed.join(listed.groupBy("ways").agg(F.min(stop).alias(name)), "ways")


def journeys(requests: DataFrame, timetable: DataFrame, transfers: DataFrame, rounds: int = 4, first_s: int = 6 * 3600, last_s: int = 23 * 3600, headway_s: int = 600) -> DataFrame:
    """Journeys (request, rides, arrival_s, legs), one for each number of rides that arrives earlier than with fewer.

    requests: request, from_stop, to_stop, departure_s. transfers: from_stop, to_stop, walk_s. Lines run every
    headway_s from first_s to last_s. Riding one line twice in a journey is allowed only by leaving it between.

    Requests whose start or target no line comes near have no journey. A search has no target, so none is pruned by
    it but in the last round; results are the same, as what arrives no earlier at a stop cannot do so later on.
    """
    where = scratch(requests.sparkSession, "journeys")
    rides = stored(boardings(timetable), f"{where}/rides")
    boarded_at, left_at = rides.select("stop").distinct(), rides.select(F.col("to_stop").alias("stop")).distinct()
    walking = stored(transfers.groupBy("from_stop", "to_stop").agg(F.min("walk_s").alias("walk_s")), f"{where}/walks")
    # a way without seconds: the stop itself, to which nobody walks
    here = lambda stops, name: stops.select(F.col("stop").alias(name), F.col("stop").alias("way"), F.lit(None).cast("bigint").alias("walk_s"))
    links = walking.join(boarded_at.withColumnRenamed("stop", "to_stop"), "to_stop", "left_semi")
    doors = walking.join(left_at.withColumnRenamed("stop", "from_stop"), "from_stop", "left_semi")
    out_of = links.select("from_stop", F.col("to_stop").alias("way"), "walk_s").unionByName(here(boarded_at, "from_stop"))
    into = doors.select("to_stop", F.col("from_stop").alias("way"), "walk_s").unionByName(here(left_at, "to_stop"))
    origins = stored(shared(out_of.join(requests.select("from_stop").distinct(), "from_stop", "left_semi"), "from_stop", "origin"), f"{where}/origins")
    targets = stored(shared(into.join(requests.select("to_stop").distinct(), "to_stop", "left_semi"), "to_stop", "target"), f"{where}/targets")
    source = F.struct("origin", "departure_s").alias("source")
    asked = requests.where("from_stop <> to_stop").join(origins.select("from_stop", "origin"), "from_stop").join(targets.select("to_stop", "target"), "to_stop")
    asked = stored(asked.select("request", "from_stop", "to_stop", "departure_s", source, "target"), f"{where}/asked")
    ends = targets.where("to_stop = target").select("target", F.inline("ways"))
    wanted = stored(asked.select("source", "target").distinct().join(ends, "target"), f"{where}/wanted")
    between = stored(links.join(left_at.withColumnRenamed("stop", "from_stop"), "from_stop", "left_semi").withColumnRenamed("from_stop", "stop"), f"{where}/between")

    begun = asked.select("source").distinct().select("source", "source.origin", "source.departure_s").join(origins.where("from_stop = origin").select("origin", F.inline("ways")), "origin")
    start = begun.select("source", "stop", (F.col("departure_s") + F.coalesce("walk_s", F.lit(0))).alias("arrival_s"), _walk("origin", "stop", "departure_s").alias("legs"))
    best = fresh = stored(_least(start, "source", "stop"), f"{where}/round-0")
    found = []
    for k in range(1, rounds + 1):
        ready = F.greatest(F.col("arrival_s") - F.col("o1") - first_s, F.lit(0))
        leave = first_s + F.ceil(ready / headway_s) * headway_s
        boarded = fresh.join(rides, "stop").withColumn("start_s", leave.cast("bigint")).where(F.col("start_s") <= last_s)
        if k == rounds:
            boarded = boarded.join(wanted.select("source", F.col("stop").alias("to_stop")).distinct(), ["source", "to_stop"], "left_semi")
        ride = _leg("RIDE", F.col("route_id"), F.col("direction"), "stop", "to_stop", F.col("start_s") + F.col("o1"), F.col("ride_s"))
        landed = boarded.select("source", F.col("to_stop").alias("stop"), (F.col("start_s") + F.col("o1") + F.col("ride_s")).alias("arrival_s"), F.concat("legs", ride).alias("legs"))
        reached = stored(_least(landed, "source", "stop"), f"{where}/reached-{k}")
        found.append(reached.withColumn("rides", F.lit(k)))
        if k == rounds:
            break
        on = reached.join(between, "stop").select("source", F.col("to_stop").alias("stop"), (F.col("arrival_s") + F.col("walk_s")).alias("arrival_s"), F.concat("legs", _walk("stop", "to_stop", "arrival_s")).alias("legs"))
        known = best.select("source", "stop", F.col("arrival_s").alias("known_s"))
        better = _least(reached.unionByName(on), "source", "stop").join(known, ["source", "stop"], "left").where("known_s is null or arrival_s < known_s")
        fresh = stored(better.select("source", "stop", "arrival_s", "legs"), f"{where}/round-{k}")
        if fresh.isEmpty():
            break
        if k < rounds - 1:
            best = stored(_least(best.unionByName(fresh), "source", "stop"), f"{where}/best-{k}")

    come = None
    for reached in found:
        come = reached if come is None else come.unionByName(reached)
    come = come.join(wanted, ["source", "stop"]).select("source", "target", "rides", (F.col("arrival_s") + F.coalesce("walk_s", F.lit(0))).alias("arrival_s"), F.concat("legs", _walk("stop", "target", "arrival_s")).alias("legs"))
    fewer = W.partitionBy("source", "target").orderBy("rides").rowsBetween(W.unboundedPreceding, -1)
    come = _least(come, "source", "target", "rides").withColumn("bound_s", F.min("arrival_s").over(fewer)).where("bound_s is null or arrival_s < bound_s").drop("bound_s")
    afoot = asked.select("request", "from_stop", "to_stop", "departure_s", "source", "target").join(walking, ["from_stop", "to_stop"], "left")
    own = F.transform("legs", lambda leg, i: leg.withField("from_stop", F.when(i == 0, F.col("from_stop")).otherwise(leg["from_stop"])).withField("to_stop", F.when(i == F.size("legs") - 1, F.col("to_stop")).otherwise(leg["to_stop"])))
    met = come.join(afoot, ["source", "target"]).where("walk_s is null or arrival_s < departure_s + walk_s")
    return met.select("request", "rides", "arrival_s", own.cast(LEGS).alias("legs"))
