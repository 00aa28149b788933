"""Timetables, journeys and the ranking of trip options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Headway and service hours of generated trips in seconds, walking speed in m/s, cost of a leg.
HEADWAY_S, FIRST_S, LAST_S, WALK_MS = 600, 6 * 3600, 23 * 3600, 5000.0 / 3600


def timetable(placed_stops: DataFrame, routes: DataFrame, segments: DataFrame) -> DataFrame:
    """Seconds from the start of each route and direction to its stops, spread evenly over its total time.

    The total is the route's duration, else its length at 5 km/h; lines without either are left out.
    """
    line = segments.groupBy("route_id", "direction").agg(F.sum("length_m").alias("line_m"))
    sized = placed_stops.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("route_id", "direction"))).withColumn("k", F.row_number().over(W.partitionBy("route_id", "direction").orderBy("seq")))
    met = sized.where("n >= 2").join(routes.select("route_id", "duration_min"), "route_id").join(line, ["route_id", "direction"], "left")
    met = met.withColumn("total_s", F.coalesce(F.col("duration_min") * 60, F.round(F.col("line_m") / WALK_MS)).cast("bigint")).where("total_s > 0")
    return met.select("route_id", "direction", F.col("k").cast("int").alias("position"), "stop_id", "total_s", F.round((F.col("k") - 1) * F.col("total_s") / (F.col("n") - 1)).cast("bigint").alias("offset_s"))


def departures(trips: DataFrame) -> DataFrame:
    """Starts of frequency trips (start_s, end_s, headway_s), the end included; one start if there is no headway."""
    starts = F.when(F.col("headway_s") > 0, F.sequence("start_s", "end_s", "headway_s")).otherwise(F.array("start_s"))
    return trips.withColumn("departure_s", F.explode(starts))


def pareto(options: DataFrame, group: str, axes: list[str], key: str, keep: Column | None = None) -> DataFrame:
    """Options of each group that no other beats: none is as good on all axes and better on one.

    Equal options collapse first; a group, the options of one request, is sorted once and held against its front,
    never paired with itself. Options that `keep` holds for stay in any case.
    """
    points = options.select(group, *axes).distinct()
    a, b, c = axes

    def beaten(front: Column, p: Column) -> Column:
        return F.exists(front, lambda q: (q[a] <= p[a]) & (q[b] <= p[b]) & (q[c] <= p[c]))

    # In rising order no later point beats an earlier one, so a point only has to be held against the front so far.
    grown = F.aggregate("_points", F.slice("_points", 1, 0), lambda front, p: F.when(beaten(front, p), front).otherwise(F.concat(front, F.array(p))))
    best = points.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*axes))).alias("_points")).select(group, F.explode(grown).alias("_p")).select(group, *[F.col(f"_p.{x}").alias(x) for x in axes], F.lit(True).alias("_best"))
    met = options.join(best, [group, *axes], "left")
    return met.where(F.coalesce("_best", F.lit(False)) | (keep if keep is not None else F.lit(False))).select(group, key, *axes)


def ranked(options: DataFrame, group: str, key: str, fewer_transfers: bool, speed: bool, most: int) -> DataFrame:
    """The best options of each group: by transfers or minutes first, as asked, then by walking."""
    first = ["transfers"] if fewer_transfers else []
    first += ["minutes"] if speed else []
    order = list(dict.fromkeys([*first, "transfers", "minutes", "walk_min", key]))
    w = W.partitionBy(group).orderBy(*order)
    return options.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def direct_journeys(asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """Journeys without a change: asked (request, from_stop, to_stop) met with ordered stop pairs."""
    return asked.join(pairs, ["from_stop", "to_stop"]).select("request", "from_stop", "to_stop", "route_id", "direction", "ride_s")


def one_transfer_journeys(asked: DataFrame, pairs: DataFrame, least_ride_s: int = 60, most_s: int = 6000, rides: bool = False) -> DataFrame:
    """Journeys with one change at a stop, onto another route; rides: also the seconds of each."""
    first = asked.join(pairs.select(F.col("from_stop"), F.col("to_stop").alias("change"), F.col("route_id").alias("route_1"), F.col("ride_s").alias("ride_1")), "from_stop")
    second = pairs.select(F.col("from_stop").alias("change"), "to_stop", F.col("route_id").alias("route_2"), F.col("ride_s").alias("ride_2"))
    met = first.join(second, ["change", "to_stop"]).where(F.col("route_1") != F.col("route_2"))
    return met.where((F.col("ride_1") >= least_ride_s) & (F.col("ride_2") >= least_ride_s) & (F.col("ride_1") + F.col("ride_2") <= most_s)).select("request", "change", "route_1", "route_2", (F.col("ride_1") + F.col("ride_2")).alias("ride_s"), *(["ride_1", "ride_2"] if rides else []))


def two_transfer_journeys(asked: DataFrame, pairs: DataFrame, wait_s: int = 300, least_ride_s: int = 60, most_s: int = 9000, best: int = 5, rides: bool = False) -> DataFrame:
    """The best journeys of each request with two changes onto other routes, waiting wait_s at each.

    Both ends are fixed: first rides from the origin and last rides to the target are made on their own, and meet in
    the middle ride, so no more than its pairs come between them. Of the rides between two stops only the quickest
    can be in a best journey: as many as are wanted, and those of the two other routes, in both directions. Rides are
    ranked by route and direction, each by its quickest, so a loop line does not push others out.
    """
    quick = W.partitionBy("from_stop", "to_stop").orderBy("ride_s", "route_id", "direction")
    pairs = pairs.where(F.col("ride_s") >= least_ride_s)
    # a line that joins two stops several times counts as one ride of them in the choice, by its quickest
    kinds = pairs.groupBy("from_stop", "to_stop", "route_id", "direction").agg(F.min("ride_s").alias("ride_s")).withColumn("rn", F.row_number().over(quick)).where(F.col("rn") <= best + 4)
    pairs = pairs.join(kinds.select("from_stop", "to_stop", "route_id", "direction"), ["from_stop", "to_stop", "route_id", "direction"])
    ride = lambda k, a, b: pairs.select(F.col("from_stop").alias(a), F.col("to_stop").alias(b), F.col("route_id").alias(f"route_{k}"), F.col("direction").alias(f"d{k}"), F.col("ride_s").alias(f"ride_{k}"))
    first = asked.join(ride(1, "from_stop", "change_1"), "from_stop")
    last = asked.select("request", "to_stop").join(ride(3, "change_2", "to_stop"), "to_stop").drop("to_stop")
    met = first.join(ride(2, "change_1", "change_2"), "change_1").where("route_1 <> route_2").join(last, ["request", "change_2"]).where("route_2 <> route_3 and route_1 <> route_3")
    timed = met.withColumn("total_s", F.expr("ride_1 + ride_2 + ride_3") + 2 * wait_s).where(F.col("total_s") <= most_s)
    w = W.partitionBy("request").orderBy("total_s", "route_1", "route_2", "route_3", "change_1", "change_2", "d1", "d2", "d3")
    return timed.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= best).select("request", "change_1", "change_2", "route_1", "route_2", "route_3", "total_s", *(["ride_1", "ride_2", "ride_3"] if rides else []))


def scores(options: DataFrame) -> DataFrame:
    """options (minutes, transfers, walk_min) with comfort, quality, reliability and cost.

    Fixed values: baselines, penalties for transfers, minutes and walking beyond what is free, and weights.
    """
    above = lambda c, free: F.greatest(F.lit(0), F.col(c) - free)
    left = lambda spent: F.greatest(F.lit(0), 100 - spent)
    comfort = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - F.col("transfers") * 15.0 - above("walk_min", 5) * 2.0 - above("minutes", 30) * 0.5))
    quality = left(F.col("minutes")) * 0.4 + left(F.col("transfers") * 25) * 0.3 + left(F.col("walk_min") * 3) * 0.2 + F.col("comfort") * 0.1
    reliability = F.greatest(F.lit(0.5), 0.95 - F.col("transfers") * 0.05 - above("walk_min", 10) * 0.01)
    return options.withColumn("comfort", comfort).withColumn("quality", quality).withColumn("reliability", reliability).withColumn("cost", (F.col("transfers") + 1).cast("double"))
