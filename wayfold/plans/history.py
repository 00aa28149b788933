"""Queries over runs: stop visits, their history, arrival times, lines that runs follow, fences they cross."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayfold.functions import geo
from wayfold.operators import arrivals as ar
from wayfold.operators import joins as j
from wayfold.operators import matching as mt
from wayfold.operators import tracks as k
from wayfold.operators import waiting as wt
from wayfold.plans.book import Book
from wayfold.plans.business import HOUR, WEEKEND
from wayfold.plans.fleet import BOX_SQL, FENCE_SQL, SEGMENTS_SQL, SNAP_SQL, T_SQL, fences
from wayfold.sources.transit import BASE_US, NOW_US, ROUTE_STOPS, Transit, haversine_sql

book = Book()
query = book.query
LOCAL_HOUR, LOCAL_WEEKEND = (x.replace("t_us", "arrived_us") for x in (HOUR, WEEKEND))
VISITS = f"""met0 AS (SELECT r.vehicle_id, r.trip, r.n, r.t_us, r.route_id, r.direction, s.seq, s.stop_id, {haversine_sql('r.lat', 'r.lon', 's.lat', 's.lon')} <= 50 AND r.speed < 5 AS standing FROM runs r JOIN placed_stops s ON s.route_id = r.route_id AND s.direction = r.direction),
first0 AS (SELECT vehicle_id, trip, seq, min(n) AS arr FROM met0 WHERE standing GROUP BY ALL),
one AS (SELECT m.vehicle_id, m.trip, m.route_id, m.direction, m.seq, m.stop_id, f.arr, min(m.t_us) AS arrived_us, coalesce(min(m.n) FILTER (WHERE m.n > f.arr AND NOT m.standing), max(m.n)) AS dep, coalesce(min(m.t_us) FILTER (WHERE m.n > f.arr AND NOT m.standing), max(m.t_us)) AS departed_us FROM met0 m JOIN first0 f ON f.vehicle_id = m.vehicle_id AND f.trip = m.trip AND f.seq = m.seq AND m.n >= f.arr GROUP BY ALL),
ordered AS (SELECT * FROM (SELECT *, max(dep) OVER (PARTITION BY vehicle_id, trip ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM one) WHERE before IS NULL OR arr >= before),
visits AS (SELECT *, (departed_us - arrived_us) / 1e6 AS dwell_s, CASE WHEN lag(seq) OVER w = seq - 1 THEN lag(stop_id) OVER w END AS from_stop, (arrived_us - CASE WHEN lag(seq) OVER w = seq - 1 THEN lag(departed_us) OVER w END) / 1e6 AS travel_s FROM ordered WINDOW w AS (PARTITION BY vehicle_id, trip ORDER BY seq)),
dwell AS (SELECT route_id, direction, stop_id, avg(dwell_s) AS dwell_s, count(*) AS n FROM visits WHERE dwell_s <= 600 GROUP BY ALL),
travel AS (SELECT route_id, direction, from_stop, stop_id AS to_stop, {LOCAL_HOUR}::INT AS hour, {LOCAL_WEEKEND} AS weekend, avg(travel_s) AS mean_s, count(*) AS trips FROM visits WHERE travel_s > 0 GROUP BY ALL),
live AS (SELECT route_id, direction, from_stop, stop_id AS to_stop, greatest(0.5, least(3.0, avg(travel_s) FILTER (WHERE late) / avg(travel_s) FILTER (WHERE NOT late))) AS factor FROM (SELECT *, arrived_us > (SELECT max(arrived_us) FROM visits) - 900000000 AS late FROM visits WHERE travel_s > 0) GROUP BY ALL HAVING count(*) FILTER (WHERE late) >= 2 AND count(*) FILTER (WHERE NOT late) >= 3 AND avg(travel_s) FILTER (WHERE NOT late) > 0)"""


def _visits(t: Transit) -> DataFrame:
    return ar.visits(t.runs, t.placed_stops)


@query("SELECT vehicle_id, trip, seq, stop_id, arrived_us, departed_us, round(dwell_s, 6) AS dwell_s, from_stop, round(travel_s, 6) AS travel_s FROM visits", VISITS)
def stop_visits(t: Transit) -> DataFrame:
    """Every visit of a run at a stop of its line, with how long it stood and how long it took from the stop before."""
    return _visits(t).select("vehicle_id", "trip", "seq", "stop_id", "arrived_us", "departed_us", F.round("dwell_s", 6).alias("dwell_s"), "from_stop", F.round("travel_s", 6).alias("travel_s"))


def _mean_us(mean: str, n: str) -> Column:
    """A mean in seconds as whole microseconds, rounded down; both engines agree on integers."""
    return F.expr(f"cast(round({mean} * {n} * 1e6D) as bigint) div {n}")


@query("SELECT route_id, direction, stop_id, (sum(departed_us - arrived_us) // count(*))::BIGINT AS mean_us, count(*) AS n FROM visits WHERE dwell_s <= 600 GROUP BY ALL", VISITS)
def stop_dwell_stats(t: Transit) -> DataFrame:
    return ar.dwell_stats(_visits(t)).select("route_id", "direction", "stop_id", _mean_us("dwell_s", "n").alias("mean_us"), "n")


@query("SELECT route_id, direction, from_stop, to_stop, hour, weekend, trips, (round(mean_s * trips * 1e6)::BIGINT // trips)::BIGINT AS mean_us, trips >= 3 AS trusted FROM travel", VISITS)
def segment_travel_stats(t: Transit) -> DataFrame:
    """Travel times between stops that were visited one after the other, and whether there are enough to trust."""
    return ar.travel_stats(_visits(t)).withColumn("mean_us", _mean_us("mean_s", "trips")).drop("mean_s").withColumn("trusted", F.col("trips") >= ar.TRUSTED)


@query("SELECT route_id, direction, from_stop, to_stop, round(factor, 6) AS factor FROM live", VISITS)
def live_factors(t: Transit) -> DataFrame:
    return ar.live_factors(_visits(t)).withColumn("factor", F.round("factor", 6))


STOPS_M = """stops_m AS (SELECT route_id, direction, seq, stop_id, round(coalesce(sum(length_m) OVER (PARTITION BY route_id, direction ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 3) AS stop_m FROM (SELECT p.route_id, p.direction, p.seq, p.stop_id, g.length_m FROM placed_stops p LEFT JOIN segs g ON g.route_id = p.route_id AND g.direction = p.direction AND g.segment = p.seq - 2))"""
TIME_SQL = "CASE WHEN leg_m <= 0 THEN 0 WHEN leg_m >= (12.5 * 12.5 - {v} * {v}) / 2 + 12.5 * 12.5 / 2 THEN (12.5 - {v}) + (leg_m - (12.5 * 12.5 - {v} * {v}) / 2 - 12.5 * 12.5 / 2) / 12.5 + 12.5 ELSE 2 * sqrt(greatest(0.0, (2 * leg_m + {v} * {v}) / 2)) - {v} END"


def stops_along(t: Transit) -> DataFrame:
    """The stops of each line with their metres from its start."""
    before = j.segments(t.placed_stops).select("route_id", "direction", (F.col("segment") + 2).alias("seq"), "length_m")
    w = W.partitionBy("route_id", "direction").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return t.placed_stops.join(before, ["route_id", "direction", "seq"], "left").select("route_id", "direction", "seq", "stop_id", F.round(F.coalesce(F.sum("length_m").over(w), F.lit(0.0)), 3).alias("stop_m"))


@query(
    f"""SELECT vehicle_id, k, seq, stop_id, round(sum(leg_s) OVER (PARTITION BY vehicle_id ORDER BY seq) + coalesce(sum(stand_s) OVER (PARTITION BY vehicle_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS eta_s, from_history, reliable
FROM (SELECT *, CASE WHEN k = 0 THEN {TIME_SQL.format(v='v0')} ELSE coalesce(mean_s, {TIME_SQL.format(v='0.0')}) * CASE WHEN k < 5 THEN 1 + (coalesce(factor, 1.0) - 1) * (5 - k) / 5 ELSE 1.0 END END AS leg_s, coalesce(dwell_s, 20.0) AS stand_s, k > 0 AND mean_s IS NOT NULL AS from_history, t_us >= (SELECT max(t_us) FROM last_fix) - 15000000 AS reliable
FROM (SELECT l.*, tr.mean_s, li.factor, d.dwell_s FROM legs l
 LEFT JOIN travel tr ON tr.trips >= 3 AND tr.route_id = l.route_id AND tr.direction = l.direction AND tr.from_stop = l.from_stop AND tr.to_stop = l.stop_id AND tr.hour = ((l.t_us // 1000000 + 18000) // 3600 % 24) AND tr.weekend = (((l.t_us // 1000000 + 18000) // 86400 + 3) % 7 >= 5)
 LEFT JOIN live li ON li.route_id = l.route_id AND li.direction = l.direction AND li.from_stop = l.from_stop AND li.to_stop = l.stop_id
 LEFT JOIN dwell d ON d.n >= 3 AND d.route_id = l.route_id AND d.direction = l.direction AND d.stop_id = l.stop_id))""",
    "last_fix AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY n DESC) = 1), asked AS (SELECT vehicle_id AS key, route_id, direction, lat AS q_lat, lon AS q_lon FROM last_fix), "
    + SNAP_SQL + ", " + STOPS_M + ", " + VISITS
    + """, ahead AS (SELECT f.vehicle_id, f.t_us, f.route_id, f.direction, CASE WHEN f.speed >= 5 THEN f.speed / 3.6 ELSE 0.0 END AS v0, s.seq, s.stop_id, s.stop_m, x.at_m, row_number() OVER (PARTITION BY f.vehicle_id ORDER BY s.seq) - 1 AS k FROM last_fix f JOIN (SELECT key, round(start_m + length_m * t, 3) AS at_m FROM snapped) x ON x.key = f.vehicle_id JOIN stops_m s ON s.route_id = f.route_id AND s.direction = f.direction WHERE s.stop_m >= x.at_m - 10),
legs AS (SELECT *, lag(stop_id) OVER w AS from_stop, greatest(0.0, stop_m - coalesce(lag(stop_m) OVER w, at_m)) AS leg_m FROM ahead WHERE k < 5 WINDOW w AS (PARTITION BY vehicle_id ORDER BY seq))""",
)
def stop_etas(t: Transit) -> DataFrame:
    """Seconds to the next five stops of every vehicle, from its last fix and the history of its line."""
    w = W.partitionBy("vehicle_id").orderBy(F.desc("n"))
    last = t.runs.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    at = j.snap(last.select("vehicle_id", "route_id", "direction", "lat", "lon"), j.segments(t.placed_stops), ["route_id", "direction"], "vehicle_id").select("vehicle_id", F.round("along_m", 3).alias("at_m"))
    found = _visits(t)
    etas = ar.stop_etas(last.select("vehicle_id", "t_us", "route_id", "direction", "speed").join(at, "vehicle_id"), stops_along(t), ar.travel_stats(found), ar.dwell_stats(found), ar.live_factors(found))
    return etas.withColumn("eta_s", F.round("eta_s", 4)).withColumn("k", F.col("k").cast("bigint"))


@query(
    "SELECT vehicle_id, route_id, direction, seq, running, total FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY seq) AS running, count(*) OVER (PARTITION BY vehicle_id) AS total FROM (SELECT s.key AS vehicle_id, s.route_id, s.direction, m.seq FROM snapped s JOIN line l USING (route_id, direction) JOIN stops_m m ON m.route_id = s.route_id AND m.direction = s.direction WHERE l.line_m > 0 AND round(m.stop_m / l.line_m, 6) > round((s.start_m + s.length_m * s.t) / l.line_m, 6) + 0.0001)) WHERE running <= 5",
    "asked AS (SELECT vehicle_id AS key, route_id, direction, lat AS q_lat, lon AS q_lon FROM vehicles WHERE lat IS NOT NULL AND route_id IS NOT NULL), " + SNAP_SQL + ", " + STOPS_M,
)
def next_stops(t: Transit) -> DataFrame:
    """The next five stops of each vehicle by how far along its line they are, and how many are left."""
    segs = j.segments(t.placed_stops)
    placed = t.vehicles.where("lat is not null and route_id is not null").select("vehicle_id", "route_id", "direction", "lat", "lon")
    at = j.snap(placed, segs, ["route_id", "direction"], "vehicle_id").select("vehicle_id", "route_id", "direction", F.round("fraction", 6).alias("at"))
    lines = segs.groupBy("route_id", "direction").agg(F.max(F.col("start_m") + F.col("length_m")).alias("line_m")).where("line_m > 0")
    stops = stops_along(t).join(lines, ["route_id", "direction"]).select("route_id", "direction", "seq", F.round(F.col("stop_m") / F.col("line_m"), 6).alias("fraction"))
    lists = stops.groupBy("route_id", "direction").agg(F.array_sort(F.collect_list(F.struct("seq", "fraction"))).alias("stops"))
    ahead = at.join(F.broadcast(lists), ["route_id", "direction"]).withColumn("left", F.filter("stops", lambda x: x["fraction"] > F.col("at") + 0.0001))
    first = F.transform(F.slice("left", 1, 5), lambda x: F.struct(x["seq"].alias("seq"), F.col("route_id").alias("route_id"), F.col("direction").alias("direction")))
    # one row a vehicle; should its row be there twice, the stops of both
    met = ahead.select("vehicle_id", F.size("left").alias("n"), first.alias("first")).groupBy("vehicle_id").agg(F.sum("n").alias("total"), F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, 5).alias("first"))
    return met.select("vehicle_id", "total", F.posexplode("first").alias("pos", "x")).select("vehicle_id", "x.route_id", "x.direction", "x.seq", (F.col("pos") + 1).cast("bigint").alias("running"), "total")


#: Every fix of a run against every line, without any index.
ALL_LINES = SEGMENTS_SQL + f""", far AS (SELECT fix_id, route_id, direction, min({haversine_sql('q_lat', 'q_lon', '(a_lat + (b_lat - a_lat) * t)', '(a_lon + (b_lon - a_lon) * t)')}) AS d FROM (SELECT q.fix_id, q.q_lat, q.q_lon, s.*, {T_SQL} AS t FROM (SELECT fix_id, lat AS q_lat, lon AS q_lon FROM runs) q, segs s) GROUP BY 1, 2, 3)"""


@query(
    """SELECT vehicle_id, route_id, CASE WHEN forward >= backward THEN 0 ELSE 1 END AS direction, points, round(greatest(forward, backward), 6) AS score, round(greatest(forward, backward) * 100)::INT AS confidence
FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY greatest(forward, backward) DESC, route_id) AS rn FROM (SELECT vehicle_id, route_id, max(points) AS points, coalesce(max(CASE WHEN direction = 0 THEN score END), 0) AS forward, coalesce(max(CASE WHEN direction = 1 THEN score END), 0) AS backward
 FROM (SELECT r.vehicle_id, f.route_id, f.direction, count(*) AS points, round(avg((d <= 100)::INT) * 0.6 + (1 - least(avg(d) / 500, 1)) * 0.4, 9) AS score FROM far f JOIN runs r USING (fix_id) GROUP BY 1, 2, 3) GROUP BY 1, 2)) WHERE rn = 1 AND greatest(forward, backward) >= 0.7""",
    ALL_LINES,
)
def route_match(t: Transit) -> DataFrame:
    """The route whose line fits each vehicle's fixes best, if it fits well enough, and the better direction."""
    return mt.match_routes(t.runs, j.segments(t.placed_stops)).withColumn("score", F.round("score", 6))


@query(
    """SELECT vehicle_id, window_no, fixes, round(own, 6) AS own_share, round(off, 6) AS off_share, round(coalesce(foreign0, 0), 6) AS foreign_share, CASE WHEN fixes < 3 THEN 'INVALID' WHEN own <= 0.3 AND coalesce(foreign0, 0) >= 0.6 THEN 'SWAP' ELSE 'NONE' END AS verdict
FROM (SELECT vehicle_id, window_no, count(*) AS fixes, avg((own_m <= 100)::INT) AS own, avg((own_m > 300)::INT) AS off FROM moving GROUP BY ALL)
LEFT JOIN (SELECT vehicle_id, window_no, max(n * 1.0 / fixes) AS foreign0 FROM (SELECT m.vehicle_id, m.window_no, f.route_id, count(DISTINCT m.fix_id) AS n FROM moving m JOIN far f ON f.fix_id = m.fix_id AND f.route_id <> m.assigned AND f.d <= 100 GROUP BY ALL) JOIN (SELECT vehicle_id, window_no, count(*) AS fixes FROM moving GROUP BY ALL) USING (vehicle_id, window_no) GROUP BY ALL) USING (vehicle_id, window_no)""",
    ALL_LINES + ", moving AS (SELECT r.fix_id, r.vehicle_id, r.t_us // 600000000 AS window_no, (CASE WHEN r.vehicle_id % 4 = 0 THEN (r.route_id + 7) % 25 ELSE r.route_id END) AS assigned, min(f.d) AS own_m FROM runs r JOIN far f ON f.fix_id = r.fix_id AND f.route_id = (CASE WHEN r.vehicle_id % 4 = 0 THEN (r.route_id + 7) % 25 ELSE r.route_id END) WHERE r.speed >= 5 GROUP BY ALL)",
)
def route_swap(t: Transit) -> DataFrame:
    """Verdicts by 10 minutes from how much of the moving fixes is near the assigned line and near another one.

    Every fourth vehicle is assigned to a route that it does not run.
    """
    moving = t.runs.where("speed >= 5").selectExpr("fix_id", "vehicle_id", "t_us div 600000000 as window_no", "case when vehicle_id % 4 = 0 then (route_id + 7) % 25 else route_id end as assigned", "lat", "lon")
    found = mt.swap_windows(moving, j.segments(t.placed_stops))
    return found.select("vehicle_id", "window_no", "fixes", *[F.round(c, 6).alias(c) for c in ("own_share", "off_share", "foreign_share")], "verdict")


IN_GARAGE = f"held AS (SELECT v.fix_id, min(g.garage_id) AS garage FROM runs v JOIN garages g ON {BOX_SQL} WHERE {FENCE_SQL} GROUP BY 1)"


@query(
    "SELECT fix_id, vehicle_id, was AS from_garage, garage AS to_garage, CASE WHEN was IS NULL THEN 'ENTER' WHEN garage IS NULL THEN 'EXIT' ELSE 'MOVE' END AS kind, CASE WHEN garage IS NULL THEN speed > 5 ELSE speed < 2 END AS confirmed FROM (SELECT r.*, garage, lag(garage) OVER w AS was, lag(r.fix_id) OVER w AS p_fix FROM runs r LEFT JOIN held USING (fix_id) WINDOW w AS (PARTITION BY vehicle_id ORDER BY n)) WHERE p_fix IS NOT NULL AND was IS DISTINCT FROM garage",
    IN_GARAGE,
)
def garage_transitions(t: Transit) -> DataFrame:
    """Fixes at which a run enters or leaves a garage's fence; confirmed if it drives out or comes to rest."""
    held = j.fenced(t.runs.select("fix_id", "lat", "lon"), fences(t)).where("inside").groupBy("fix_id").agg(F.min("garage_id").alias("garage"))
    w = W.partitionBy("vehicle_id").orderBy("n")
    e = t.runs.join(held, "fix_id", "left").withColumn("was", F.lag("garage").over(w)).withColumn("p_fix", F.lag("fix_id").over(w)).where("p_fix is not null and not was <=> garage")
    return e.select("fix_id", "vehicle_id", F.col("was").alias("from_garage"), F.col("garage").alias("to_garage"), F.expr("case when was is null then 'ENTER' when garage is null then 'EXIT' else 'MOVE' end").alias("kind"), F.expr("case when garage is null then speed > 5 else speed < 2 end").alias("confirmed"))


@query(f"SELECT route_id, number FROM routes r WHERE is_active AND NOT EXISTS (SELECT 1 FROM vehicles v WHERE v.route_id = r.route_id AND v.is_active AND v.in_motion AND v.updated_us > {NOW_US} - 60000000)")
def empty_routes(t: Transit) -> DataFrame:
    """Active routes on which no active vehicle moved within the last minute."""
    heard = t.vehicles.where(f"is_active and in_motion and updated_us > {NOW_US} - 60000000")
    return t.routes.where("is_active").join(heard, "route_id", "left_anti").select("route_id", "number")


@query(
    "SELECT vehicle_id, round(avg(nis), 6) AS mean_nis, count(*) AS n, avg(nis) BETWEEN 1 - 1.96 * sqrt(2.0 / count(*)) AND 1 + 1.96 * sqrt(2.0 / count(*)) AS consistent FROM (SELECT r.vehicle_id, pow(r.speed - f.x, 2) / (f.p + 9) AS nis FROM fold f JOIN ranked r ON r.vehicle_id = f.vehicle_id AND r.rn = f.rn + 1) GROUP BY 1",
    "ranked AS (SELECT vehicle_id, speed, row_number() OVER (PARTITION BY vehicle_id ORDER BY t_us, fix_id) AS rn FROM fixes), fold(vehicle_id, rn, x, p) AS (SELECT vehicle_id, rn, speed, 25.0::DOUBLE FROM ranked WHERE rn = 1 UNION ALL SELECT r.vehicle_id, r.rn, f.x + (f.p + 5) / (f.p + 9) * (r.speed - f.x), (1 - (f.p + 5) / (f.p + 9)) * (f.p + 5) FROM fold f JOIN ranked r ON r.vehicle_id = f.vehicle_id AND r.rn = f.rn + 1)",
)
def consistency_metrics(t: Transit) -> DataFrame:
    """The mean squared innovation over its variance of each vehicle's speed filter, and whether it is in its chi-squared band."""
    g = k.innovations(t.fixes).where("n > 0")
    band = 1.96 * F.sqrt(2.0 / F.col("n"))
    return g.select("vehicle_id", F.round("mean_nis", 6).alias("mean_nis"), F.col("n").cast("bigint").alias("n"), F.col("mean_nis").between(1 - band, 1 + band).alias("consistent"))


@query(
    f"""SELECT p.route_id, p.direction, p.stop_id, CASE WHEN d_last < d_first THEN hi + lo - p.seq ELSE p.seq END AS seq FROM recorded p JOIN (SELECT e.*, {haversine_sql('g.lat', 'g.lon', 'a.lat', 'a.lon')} AS d_first, {haversine_sql('g.lat', 'g.lon', 'b.lat', 'b.lon')} AS d_last FROM (SELECT route_id, direction, min(seq) AS lo, max(seq) AS hi, arg_min(stop_id, seq) AS first_stop, arg_max(stop_id, seq) AS last_stop FROM recorded GROUP BY 1, 2) e JOIN stops a ON a.stop_id = e.first_stop JOIN stops b ON b.stop_id = e.last_stop JOIN placed_stops g ON g.route_id = e.route_id AND g.direction = e.direction AND g.seq = 1) x ON x.route_id = p.route_id AND x.direction = p.direction""",
    "recorded AS (SELECT route_id, direction, stop_id, (CASE WHEN (route_id + direction) % 3 = 1 THEN 13 - seq ELSE seq END) AS seq FROM route_stops)",
)
def inverted_sequences(t: Transit) -> DataFrame:
    """Recorded stop sequences, some of them backwards, turned round where the line starts nearer their last stop than their first."""
    recorded = t.route_stops.withColumn("seq", F.expr("case when (route_id + direction) % 3 = 1 then 13 - seq else seq end"))
    place = lambda side: t.stops.select(F.col("stop_id").alias(f"{side}_stop"), F.col("lat").alias(f"{side}_lat"), F.col("lon").alias(f"{side}_lon"))
    ends = recorded.groupBy("route_id", "direction").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.min_by("stop_id", "seq").alias("first_stop"), F.max_by("stop_id", "seq").alias("last_stop"))
    starts = j.segments(t.placed_stops).where("segment = 0").select("route_id", "direction", "a_lat", "a_lon")
    away = lambda side: geo.haversine(F.col("a_lat"), F.col("a_lon"), F.col(f"{side}_lat"), F.col(f"{side}_lon"))
    turned = ends.join(place("first"), "first_stop").join(place("last"), "last_stop").join(starts, ["route_id", "direction"]).select("route_id", "direction", "lo", "hi", (away("last") < away("first")).alias("inverted"))
    return recorded.join(turned, ["route_id", "direction"]).select("route_id", "direction", "stop_id", F.expr("case when inverted then hi + lo - seq else seq end").alias("seq"))


@query("SELECT r.route_id, round(a.m, 3) AS forward_m, round(b.m, 3) AS backward_m, round(abs(a.m + b.m - 2 * r.distance_m) / (2 * r.distance_m), 6) AS closure, coalesce(abs(a.m + b.m - 2 * r.distance_m) / (2 * r.distance_m) > 0.02, true) AS flagged FROM routes r LEFT JOIN lens a ON a.route_id = r.route_id AND a.direction = 0 LEFT JOIN lens b ON b.route_id = r.route_id AND b.direction = 1", SEGMENTS_SQL + ", lens AS (SELECT route_id, direction, sum(length_m) AS m FROM segs GROUP BY 1, 2)")
def half_turns(t: Transit) -> DataFrame:
    """The two half turns of each route against its recorded length, and which routes do not close."""
    m = j.segments(t.placed_stops).groupBy("route_id").agg(F.sum(F.expr("case when direction = 0 then length_m end")).alias("a"), F.sum(F.expr("case when direction = 1 then length_m end")).alias("b"))
    out = t.routes.join(m, "route_id", "left").withColumn("closure", F.expr("abs(a + b - 2 * distance_m) / (2 * distance_m)"))
    return out.select("route_id", F.round("a", 3).alias("forward_m"), F.round("b", 3).alias("backward_m"), F.round("closure", 6).alias("closure"), F.expr("coalesce(closure > 0.02, true)").alias("flagged"))


RIDERS = f"riders0 AS (SELECT plan_id AS request, plan_id % 25 AS route_id, (plan_id // 25 % 2)::INT AS direction, (1 + plan_id % {ROUTE_STOPS - 1})::INT AS seq, {BASE_US} + plan_id * 7919 % 4200 * 1000000 AS at_us FROM plans), riders AS (SELECT *, (seq + 1 + request // 7 % ({ROUTE_STOPS} - seq))::INT AS to_seq FROM riders0)"


def riders(t: Transit) -> DataFrame:
    """A rider for each plan: a line, two of its stops, and when they come to the first one."""
    r = t.plans.selectExpr("plan_id as request", "plan_id % 25 as route_id", "cast(plan_id div 25 % 2 as int) as direction", f"cast(1 + plan_id % {ROUTE_STOPS - 1} as int) as seq", f"{BASE_US} + plan_id * 7919 % 4200 * 1000000 as at_us")
    return r.selectExpr("*", f"cast(seq + 1 + request div 7 % ({ROUTE_STOPS} - seq) as int) as to_seq")


@query(
    """SELECT request, r.route_id, r.direction, r.seq, r.to_seq, r.at_us, CASE WHEN next_us IS NOT NULL THEN 'VEHICLE' WHEN gap_us IS NOT NULL THEN 'STATISTICS' WHEN r.route_id % 5 <> 0 THEN 'TIMETABLE' ELSE 'NONE' END AS source,
 CASE WHEN next_us IS NOT NULL THEN (next_us - r.at_us) // 1000000 WHEN gap_us IS NOT NULL THEN least(gap_us // 2 // 1000000, 1800) WHEN r.route_id % 5 <> 0 THEN 300 END::BIGINT AS wait_s,
 (SELECT max(v.vehicle_id) FROM visits v WHERE v.route_id = r.route_id AND v.direction = r.direction AND v.seq = r.seq AND v.arrived_us = next_us) AS vehicle_id,
 ((r.at_us - last_us) // 1000000)::BIGINT AS since_s, (b.along_s - a.along_s)::BIGINT AS travel_s, (r.to_seq - r.seq - 1)::BIGINT AS stops_between
FROM (SELECT r.*, min(v.arrived_us) FILTER (WHERE v.arrived_us >= r.at_us AND v.arrived_us <= r.at_us + 3600000000) AS next_us, max(v.departed_us) FILTER (WHERE v.departed_us <= r.at_us AND v.departed_us >= r.at_us - 600000000) AS last_us FROM riders r LEFT JOIN visits v ON v.route_id = r.route_id AND v.direction = r.direction AND v.seq = r.seq GROUP BY ALL) r
LEFT JOIN gaps g ON g.route_id = r.route_id AND g.direction = r.direction LEFT JOIN line a ON a.route_id = r.route_id AND a.direction = r.direction AND a.seq = r.seq LEFT JOIN line b ON b.route_id = r.route_id AND b.direction = r.direction AND b.seq = r.to_seq""",
    VISITS + ", " + RIDERS + """, gaps AS (SELECT route_id, direction, sum(gap)::BIGINT // count(*) AS gap_us FROM (SELECT route_id, direction, arrived_us - lag(arrived_us) OVER (PARTITION BY route_id, direction, seq ORDER BY arrived_us) AS gap FROM visits) WHERE gap IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3),
legs AS (SELECT route_id, direction, seq, sum(round(travel_s * 1e6)::BIGINT)::BIGINT // count(*) // 1000000 AS leg FROM visits WHERE travel_s > 0 GROUP BY 1, 2, 3 HAVING count(*) >= 3),
line AS (SELECT p.route_id, p.direction, p.seq, sum(CASE WHEN p.seq > 1 THEN coalesce(leg, 120) ELSE 0 END) OVER (PARTITION BY p.route_id, p.direction ORDER BY p.seq) AS along_s FROM placed_stops p LEFT JOIN legs l ON l.route_id = p.route_id AND l.direction = p.direction AND l.seq = p.seq)""",
)
def waiting_times(t: Transit) -> DataFrame:
    """How long riders wait for their line and ride on it: by the next vehicle, else by headways there were, else by the timetable."""
    return wt.waits(riders(t), _visits(t), t.placed_stops, t.routes.where("route_id % 5 <> 0").selectExpr("route_id", "600L as headway_s"))
