"""Queries of timetables, journeys, options and search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayfold.functions import geo
from wayfold.functions import text as tx
from wayfold.operators import joins as j
from wayfold.operators import options as op
from wayfold.operators import raptor as rp
from wayfold.operators import routing as r
from wayfold.operators import views as v
from wayfold.plans.book import Book
from wayfold.plans.business import NORM
from wayfold.plans.fleet import SEGMENTS_SQL, SNAP_SQL, walks
from wayfold.sources.transit import Transit, haversine_sql

book = Book()
query = book.query
TIMES = SEGMENTS_SQL + """,
sized AS (SELECT *, count(*) OVER (PARTITION BY route_id, direction) AS n, row_number() OVER (PARTITION BY route_id, direction ORDER BY seq) AS k FROM placed_stops),
times AS (SELECT route_id, direction, k::INT AS position, stop_id, total_s, round((k - 1) * total_s / (n - 1))::BIGINT AS offset_s FROM (SELECT s.*, coalesce(r.duration_min * 60, round(l.line_m / (5000.0::DOUBLE / 3600)))::BIGINT AS total_s FROM sized s JOIN routes r USING (route_id) LEFT JOIN (SELECT route_id, direction, sum(length_m) AS line_m FROM segs GROUP BY 1, 2) l USING (route_id, direction) WHERE n >= 2) WHERE total_s > 0),
pairs AS (SELECT a.route_id, a.direction, a.stop_id AS from_stop, b.stop_id AS to_stop, b.offset_s - a.offset_s AS ride_s FROM times a JOIN times b ON a.route_id = b.route_id AND a.direction = b.direction AND a.position < b.position AND a.stop_id <> b.stop_id),
asked0 AS (SELECT stop_id AS request, stop_id AS from_stop, (stop_id * 7 + 3) % (SELECT count(*) FROM stops) AS to_stop FROM stops)"""


def _timetable(t: Transit) -> DataFrame:
    return r.timetable(t.placed_stops, t.routes, j.segments(t.placed_stops))


def _pairs(t: Transit) -> DataFrame:
    return rp.boardings(_timetable(t)).select("route_id", "direction", F.col("stop").alias("from_stop"), "to_stop", "ride_s")


def _asked(t: Transit) -> DataFrame:
    n = t.stops.agg(F.count(F.lit(1)).alias("n"))
    return t.stops.crossJoin(F.broadcast(n)).selectExpr("stop_id as request", "stop_id as from_stop", "(stop_id * 7 + 3) % n as to_stop").where("from_stop <> to_stop")


@query("SELECT * FROM times", TIMES)
def raptor_timetable(t: Transit) -> DataFrame:
    return _timetable(t)


@query("SELECT route_id, direction, k, departure_s FROM (SELECT route_id, direction, k, s + k * h AS departure_s, e FROM (SELECT DISTINCT route_id, direction, 21600 + route_id * 60 AS s, 82800 AS e, CASE WHEN route_id % 5 <> 0 THEN 600 ELSE 0 END AS h FROM times), range(200) x(k) WHERE h > 0 OR k = 0) WHERE departure_s <= e", TIMES)
def trip_departures(t: Transit) -> DataFrame:
    trips = _timetable(t).select("route_id", "direction").distinct().selectExpr("route_id", "direction", "21600 + route_id * 60 as start_s", "82800L as end_s", "case when route_id % 5 <> 0 then 600L else 0L end as headway_s")
    return r.departures(trips).select("route_id", "direction", F.expr("case when headway_s > 0 then (departure_s - start_s) div headway_s else 0 end").alias("k"), "departure_s")


@query("SELECT request, a.from_stop, a.to_stop, route_id, direction, ride_s FROM asked0 a JOIN pairs p ON p.from_stop = a.from_stop AND p.to_stop = a.to_stop", TIMES)
def direct_journeys(t: Transit) -> DataFrame:
    return r.direct_journeys(_asked(t), _pairs(t))


@query("SELECT request, p.to_stop AS change, p.route_id AS route_1, q.route_id AS route_2, p.ride_s + q.ride_s AS ride_s FROM asked0 a JOIN pairs p ON p.from_stop = a.from_stop JOIN pairs q ON q.from_stop = p.to_stop AND q.to_stop = a.to_stop WHERE a.from_stop <> a.to_stop AND p.route_id <> q.route_id AND p.ride_s >= 60 AND q.ride_s >= 60 AND p.ride_s + q.ride_s <= 6000", TIMES)
def one_transfer_journeys(t: Transit) -> DataFrame:
    return r.one_transfer_journeys(_asked(t), _pairs(t))


def line_walks(t: Transit, asked: DataFrame, most_s: int) -> DataFrame:
    """The walks of stop_transfers of at most most_s that a journey can have: to or from a stop on a line, or from its first stop to its last."""
    s = t.stops.where("is_active").select("stop_id", "lat", "lon")
    metres = (most_s + 1) * r.WALK_MS
    met = walks(s, s.join(t.route_stops.select("stop_id").distinct(), "stop_id", "left_semi"), metres).select("from_stop", "to_stop", "walk_s")
    ends = asked.select("from_stop", "to_stop").distinct()
    ends = ends.join(s.toDF("from_stop", "lat", "lon"), "from_stop").join(s.toDF("to_stop", "r_lat", "r_lon"), "to_stop")
    m = F.round(geo.haversine(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")), 3)
    own = ends.where(m <= metres).select("from_stop", "to_stop", F.greatest(F.lit(1), F.round(m / r.WALK_MS).cast("bigint")).alias("walk_s"))
    back = met.select(F.col("to_stop").alias("from_stop"), F.col("from_stop").alias("to_stop"), "walk_s")
    return met.unionByName(back).unionByName(own).where(F.col("walk_s") <= most_s).distinct()


@query()
def raptor_journeys(t: Transit) -> DataFrame:
    """Earliest arrivals at 8:00 between stops, by number of rides; rounds are iterative."""
    asked = _asked(t).withColumn("departure_s", F.lit(8 * 3600).cast("bigint"))
    return rp.journeys(asked, _timetable(t), line_walks(t, asked, 400)).select("request", "rides", "arrival_s", F.size("legs").alias("legs"), F.to_json("legs").alias("path"))


@query("SELECT plan_id, option_no, minutes, transfers, walk_min FROM options o WHERE walk_min = 0 OR NOT EXISTS (SELECT 1 FROM options p WHERE p.plan_id = o.plan_id AND p.minutes <= o.minutes AND p.transfers <= o.transfers AND p.walk_min <= o.walk_min AND (p.minutes < o.minutes OR p.transfers < o.transfers OR p.walk_min < o.walk_min))")
def pareto_trips(t: Transit) -> DataFrame:
    """Options that no other of their plan beats, and those that need no walk."""
    return r.pareto(t.options, "plan_id", ["minutes", "transfers", "walk_min"], "option_no", F.col("walk_min") == 0)


@query("SELECT plan_id, option_no, item, rank FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY transfers, minutes, walk_min, option_no, item) AS rank FROM options) WHERE rank <= 3")
def ranked_options(t: Transit) -> DataFrame:
    keyed = t.options.withColumn("key", F.struct("option_no", "item"))
    return r.ranked(keyed, "plan_id", "key", True, False, 3).select("plan_id", "option_no", "item", F.col("rank").cast("bigint").alias("rank"))


COMFORT_SQL = "greatest(0.0, least(100.0, 100.0 - transfers * 15.0 - greatest(0, walk_min - 5) * 2.0 - greatest(0, minutes - 30) * 0.5))::DOUBLE"


@query(
    f"SELECT plan_id, option_no, item, round({COMFORT_SQL}, 6) AS comfort, round(greatest(0, 100 - minutes) * 0.4 + greatest(0, 100 - transfers * 25) * 0.3 + greatest(0, 100 - walk_min * 3) * 0.2 + {COMFORT_SQL} * 0.1, 6) AS quality, round(greatest(0.5, 0.95 - transfers * 0.05 - greatest(0.0, (walk_min - 10) * 0.01))::DOUBLE, 6) AS reliability, (transfers + 1)::DOUBLE AS cost, minutes <= 240 AND walk_min <= 15 AND transfers <= 1 AS acceptable, walk_min <= 5 AND transfers <= 1 AS accessible, CASE transfers WHEN 0 THEN 'DIRECT' WHEN 1 THEN 'ONE_TRANSFER' ELSE 'TWO_TRANSFERS' END AS kind FROM options"
)
def option_scores(t: Transit) -> DataFrame:
    """Comfort, quality, reliability and cost of every option, and whether it is acceptable and accessible."""
    s = r.scores(t.options)
    return s.select("plan_id", "option_no", "item", *[F.round(c, 6).alias(c) for c in ("comfort", "quality", "reliability")], "cost", F.expr("minutes <= 240 and walk_min <= 15 and transfers <= 1").alias("acceptable"), F.expr("walk_min <= 5 and transfers <= 1").alias("accessible"), F.expr("case transfers when 0 then 'DIRECT' when 1 then 'ONE_TRANSFER' else 'TWO_TRANSFERS' end").alias("kind"))


@query(
    "SELECT request, p.to_stop AS change_1, q.to_stop AS change_2, p.route_id AS route_1, q.route_id AS route_2, r.route_id AS route_3, p.ride_s + q.ride_s + r.ride_s + 600 AS total_s FROM asked0 a JOIN pairs p ON p.from_stop = a.from_stop JOIN pairs q ON q.from_stop = p.to_stop JOIN pairs r ON r.from_stop = q.to_stop AND r.to_stop = a.to_stop WHERE a.from_stop <> a.to_stop AND p.route_id <> q.route_id AND q.route_id <> r.route_id AND p.route_id <> r.route_id AND least(p.ride_s, q.ride_s, r.ride_s) >= 60 AND p.ride_s + q.ride_s + r.ride_s + 600 <= 9000 QUALIFY row_number() OVER (PARTITION BY request ORDER BY p.ride_s + q.ride_s + r.ride_s, p.route_id, q.route_id, r.route_id, p.to_stop, q.to_stop, p.direction, q.direction, r.direction) <= 5",
    TIMES,
)
def two_transfer_journeys(t: Transit) -> DataFrame:
    """The five quickest journeys with two changes of each request, half a headway of waiting at each."""
    return r.two_transfer_journeys(_asked(t), _pairs(t))


@query("SELECT DISTINCT plan_id, transfers, minutes FROM options WHERE transfers < 2")
def combined_trips(t: Transit) -> DataFrame:
    """Trips of two searches together, each once."""
    parts = [t.options.where(f"transfers = {k}").select("plan_id", "transfers", "minutes") for k in (0, 1)]
    return parts[0].unionByName(parts[1]).distinct()


@query("""SELECT from_stop, to_stop, least_rides FROM (SELECT a.from_stop, a.to_stop, CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.from_stop = a.from_stop AND p.to_stop = a.to_stop) THEN 1 WHEN EXISTS (SELECT 1 FROM pairs p JOIN pairs q ON q.from_stop = p.to_stop WHERE p.from_stop = a.from_stop AND q.to_stop = a.to_stop) THEN 2 ELSE 9 END AS least_rides FROM asked0 a WHERE a.from_stop <> a.to_stop) WHERE least_rides < 9""", TIMES)
def least_rides(t: Transit) -> DataFrame:
    """The fewest rides, up to two, between stops."""
    edges = _pairs(t).select("from_stop", "to_stop").distinct()
    two = edges.select("from_stop", F.col("to_stop").alias("mid")).join(edges.select(F.col("from_stop").alias("mid"), "to_stop"), "mid").select("from_stop", "to_stop").withColumn("least_rides", F.lit(2))
    reach = edges.withColumn("least_rides", F.lit(1)).unionByName(two).groupBy("from_stop", "to_stop").agg(F.min("least_rides").alias("least_rides"))
    return _asked(t).select("from_stop", "to_stop").join(reach, ["from_stop", "to_stop"])


ETA = (
    "asked AS (SELECT vehicle_id AS key, route_id, direction, lat AS q_lat, lon AS q_lon FROM vehicles WHERE lat IS NOT NULL AND route_id IS NOT NULL AND in_motion AND speed >= 5), "
    + SNAP_SQL
    + """, buses AS (SELECT key AS vehicle_id, route_id, direction, round(start_m + length_m * t, 3) AS at_m FROM snapped),
stops_m AS (SELECT route_id, direction, seq, stop_id, round(coalesce(sum(length_m) OVER (PARTITION BY route_id, direction ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS stop_m FROM (SELECT p.route_id, p.direction, p.seq, p.stop_id, g.length_m FROM placed_stops p LEFT JOIN segs g ON g.route_id = p.route_id AND g.direction = p.direction AND g.segment = p.seq - 1))"""
)


@query(
    "SELECT route_id, direction, stop_id, vehicle_id, eta_min FROM (SELECT s.route_id, s.direction, s.stop_id, v.vehicle_id, ceil((stop_m - at_m) / (speed / 3.6) / 60)::BIGINT AS eta_min, row_number() OVER (PARTITION BY s.route_id, s.direction, s.stop_id ORDER BY ceil((stop_m - at_m) / (speed / 3.6) / 60), stop_m - at_m, v.vehicle_id) AS rn FROM buses b JOIN vehicles v USING (vehicle_id) JOIN stops_m s ON s.route_id = b.route_id AND s.direction = b.direction WHERE stop_m >= at_m AND stop_m - at_m <= 5000 AND (stop_m - at_m) / (speed / 3.6) / 60 <= 20) WHERE rn = 1",
    ETA,
)
def nearest_bus_eta(t: Transit) -> DataFrame:
    """The moving bus that reaches each stop first, within 5 km and 20 minutes."""
    segs = j.segments(t.placed_stops)
    moving = t.vehicles.where("lat is not null and route_id is not null and in_motion and speed >= 5")
    at = j.snap(moving.select("vehicle_id", "route_id", "direction", "lat", "lon"), segs, ["route_id", "direction"], "vehicle_id").select("vehicle_id", "route_id", "direction", F.round("along_m", 3).alias("at_m")).join(moving.select("vehicle_id", "speed"), "vehicle_id")
    ends = t.placed_stops.join(segs.select("route_id", "direction", (F.col("segment") + 1).alias("seq"), "length_m"), ["route_id", "direction", "seq"], "left")
    w = W.partitionBy("route_id", "direction").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    stops = ends.select("route_id", "direction", "stop_id", F.round(F.coalesce(F.sum("length_m").over(w), F.lit(0.0)), 3).alias("stop_m"))
    met = at.join(stops, ["route_id", "direction"]).withColumn("d", F.expr("stop_m - at_m")).withColumn("m", F.expr("d / (speed / 3.6D) / 60")).where("d >= 0 and d <= 5000 and m <= 20")
    best = met.groupBy("route_id", "direction", "stop_id").agg(F.min(F.struct(F.ceil("m").alias("eta_min"), "d", "vehicle_id")).alias("b"))
    return best.select("route_id", "direction", "stop_id", "b.vehicle_id", "b.eta_min")


@query(
    f"SELECT vehicle_id, CASE WHEN least(abs((course - b + 540) % 360 - 180), 180) <= 90 THEN 0 ELSE 1 END AS direction_by_course FROM (SELECT v.vehicle_id, v.course, (degrees(atan2((s.b_lon - s.a_lon) * cos(radians((s.a_lat + s.b_lat) / 2)), s.b_lat - s.a_lat)) + 360) % 360 AS b FROM snapped s JOIN vehicles v ON v.vehicle_id = s.key)",
    "asked AS (SELECT vehicle_id AS key, route_id, 0 AS direction, lat AS q_lat, lon AS q_lon FROM vehicles WHERE lat IS NOT NULL AND route_id IS NOT NULL), " + SNAP_SQL,
)
def direction_by_course(t: Transit) -> DataFrame:
    """The direction whose nearest segment runs the way the vehicle does."""
    segs = j.segments(t.placed_stops).where("direction = 0")
    points = t.vehicles.where("lat is not null and route_id is not null").select("vehicle_id", "route_id", F.lit(0).alias("direction"), "lat", "lon")
    met = j.snap(points, segs, ["route_id", "direction"], "vehicle_id").join(F.broadcast(segs), ["route_id", "direction", "segment"]).join(t.vehicles.select("vehicle_id", "course"), "vehicle_id")
    off = geo.angle_between(F.col("course"), geo.planar_course(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")))
    return met.select("vehicle_id", F.when(off <= 90, 0).otherwise(1).alias("direction_by_course"))


CATALOG = f"""source AS (
 SELECT 'STOP' AS kind, stop_id AS id, x.term, name AS title, 1.0::DOUBLE AS weight, 0 AS prio FROM stops, LATERAL (VALUES (name), (name_tm)) x(term) WHERE is_active AND x.term IS NOT NULL
 UNION ALL SELECT 'ROUTE', route_id, number, number, 2.0, 0 FROM routes WHERE is_active
 UNION ALL SELECT 'ROUTE', route_id, name, number, 1.0, 0 FROM routes WHERE is_active
 UNION ALL SELECT 'PLACE', place_id, name, name, 1.0, 0 FROM places WHERE is_active
 UNION ALL SELECT 'PLACE', place_id, alias, name, 0.5, 1 + place_id % 3 FROM places WHERE is_active),
normed AS (SELECT *, {NORM.format('term')} AS term_norm FROM source),
catalog AS (SELECT kind, id, term_norm, title, weight FROM (SELECT *, row_number() OVER (PARTITION BY kind, id, term_norm ORDER BY prio, weight DESC, title) AS rn FROM normed WHERE term_norm <> '') WHERE rn = 1)"""


def _catalog(t: Transit) -> DataFrame:
    """Search terms of all objects, one row for each object and normal form."""
    stops = t.stops.where("is_active").select(F.lit("STOP").alias("kind"), F.col("stop_id").alias("id"), F.explode(F.array_compact(F.array("name", "name_tm"))).alias("term"), F.col("name").alias("title"), F.lit(1.0).alias("weight"), F.lit(0).cast("bigint").alias("prio"))
    active = t.routes.where("is_active")
    routes = active.select(F.lit("ROUTE").alias("kind"), F.col("route_id").alias("id"), F.explode(F.array(F.struct(F.col("number").alias("term"), F.lit(2.0).alias("weight")), F.struct(F.col("name").alias("term"), F.lit(1.0).alias("weight")))).alias("x"), F.col("number").alias("title")).select("kind", "id", "x.term", "title", "x.weight", F.lit(0).cast("bigint").alias("prio"))
    places = t.places.where("is_active").select(F.lit("PLACE").alias("kind"), F.col("place_id").alias("id"), F.explode(F.array(F.struct(F.col("name").alias("term"), F.lit(1.0).alias("weight"), F.lit(0).cast("bigint").alias("prio")), F.struct(F.col("alias").alias("term"), F.lit(0.5).alias("weight"), F.expr("1 + place_id % 3").alias("prio")))).alias("x"), F.col("name").alias("title")).select("kind", "id", "x.term", "title", "x.weight", "x.prio")
    rows = stops.unionByName(routes).unionByName(places).withColumn("term_norm", tx.search_norm(F.col("term"))).where("term_norm <> ''")
    return rows.groupBy("kind", "id", "term_norm").agg(F.min(F.struct("prio", (-F.col("weight")).alias("w"), "title", "weight")).alias("b")).select("kind", "id", "term_norm", "b.title", "b.weight")


@query("SELECT * FROM catalog", CATALOG)
def catalog_search(t: Transit) -> DataFrame:
    return _catalog(t)


GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split({0}, ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(
    f"SELECT kind, id, round(max(sim), 6) AS similarity, arg_max(title, (round(sim, 6), title)) AS title FROM (SELECT *, len(list_intersect(q, g)) / len(q) AS sim FROM (SELECT *, {GRAMS.format('term_norm')} AS g, {GRAMS.format(chr(39) + 'blue ring 12' + chr(39))} AS q FROM catalog)) WHERE sim >= 0.6 GROUP BY 1, 2 ORDER BY similarity DESC, title, id, kind LIMIT 20",
    CATALOG,
)
def place_search(t: Transit) -> DataFrame:
    """The twenty objects most like a query, by the share of its trigrams in their best term."""
    sim = F.round(tx.word_similarity(tx.search_norm(F.lit("Blue  ring-12")), F.col("term_norm")), 6)
    met = _catalog(t).withColumn("sim", sim).where("sim >= 0.6")
    best = met.groupBy("kind", "id").agg(F.max(F.struct("sim", "title")).alias("b"))
    return best.select("kind", "id", F.col("b.sim").alias("similarity"), "b.title").orderBy(F.desc("similarity"), "title", "id", "kind").limit(20)


@query("SELECT DISTINCT kind, id, title FROM catalog WHERE term_norm LIKE 'red%' ORDER BY title, id LIMIT 15", CATALOG)
def autocomplete(t: Transit) -> DataFrame:
    return _catalog(t).where(F.col("term_norm").startswith("red")).select("kind", "id", "title").distinct().orderBy("title", "id").limit(15)


@query(f"SELECT place_id, name, round(d, 3) AS distance_m FROM (SELECT *, {haversine_sql('37.95', '58.375', 'lat', 'lon')} AS d FROM places WHERE category = 'SMALL') WHERE d <= 2000 ORDER BY round(d, 3), place_id LIMIT 25")
def places_nearby(t: Transit) -> DataFrame:
    near = j.within_radius(t.places.where("category = 'SMALL'"), 37.95, 58.375, 2000.0)
    return near.select("place_id", "name", F.round("distance_m", 3).alias("distance_m")).orderBy("distance_m", "place_id").limit(25)


AUDIT = (
    "relabelled AS (SELECT route_id, direction, seq, CASE WHEN stop_id % 9 = 0 THEN (stop_id * 5 + 1) % (SELECT count(*) FROM stops) ELSE stop_id END AS stop_id FROM route_stops), asked AS (SELECT route_id * 100 + d.direction * 50 + seq AS key, x.route_id, o.direction, x.direction AS own, x.seq, x.stop_id, s.lat AS q_lat, s.lon AS q_lon FROM relabelled x JOIN stops s USING (stop_id), (VALUES (0), (1)) o(direction), (SELECT 0 AS direction) d WHERE d.direction = 0), "
    + SNAP_SQL.replace("PARTITION BY key, route_id, direction", "PARTITION BY key, own, route_id, direction")
    + """, sides AS (SELECT route_id, own AS direction, seq, stop_id, max(CASE WHEN direction = own THEN round(d, 1) END) AS own_m, max(CASE WHEN direction <> own THEN round(d, 1) END) AS other_m, max(CASE WHEN direction = own THEN round(start_m + length_m * t, 3) END) AS along_m FROM snapped GROUP BY ALL),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY route_id, direction ORDER BY seq) AS by_seq, dense_rank() OVER (PARTITION BY route_id, direction ORDER BY along_m) AS by_line, count(*) OVER (PARTITION BY route_id, direction) AS stops FROM sides),
audit AS (SELECT *, CASE WHEN own_m > 200 AND other_m < 50 THEN 'HIGH_WRONG_DIRECTION' WHEN own_m > 200 THEN 'HIGH_FAR_FROM_ROUTE' WHEN abs(by_seq - by_line) >= 2 THEN 'MEDIUM_BAD_SEQUENCE' WHEN own_m > 80 THEN 'LOW_BORDERLINE' ELSE 'OK' END AS tier FROM ranked)"""
)


def _audit(t: Transit) -> DataFrame:
    """Each stop of a route against the lines of both directions, some stops relabelled to be wrong."""
    n = t.stops.agg(F.count(F.lit(1)).alias("n"))
    relabelled = t.route_stops.crossJoin(F.broadcast(n)).selectExpr("route_id", "direction as own", "seq", "case when stop_id % 9 = 0 then (stop_id * 5 + 1) % n else stop_id end as stop_id").join(t.stops.select("stop_id", "lat", "lon"), "stop_id")
    keyed = relabelled.withColumn("key", F.struct("route_id", "own", "seq", "stop_id"))
    asked = keyed.withColumn("direction", F.explode(F.array(F.lit(0), F.lit(1)))).select("key", "route_id", "direction", "lat", "lon")
    snapped = j.snap(asked, j.segments(t.placed_stops), ["route_id", "direction"], "key").select("key.own", "key.seq", "key.stop_id", "route_id", "direction", F.round("distance_m", 1).alias("d"), F.round("along_m", 3).alias("along"))
    same = F.col("direction") == F.col("own")
    sides = snapped.groupBy("route_id", "own", "seq", "stop_id").agg(F.max(F.when(same, F.col("d"))).alias("own_m"), F.max(F.when(~same, F.col("d"))).alias("other_m"), F.max(F.when(same, F.col("along"))).alias("along_m")).withColumnRenamed("own", "direction")
    w = W.partitionBy("route_id", "direction")
    ranks = sides.withColumn("by_seq", F.dense_rank().over(w.orderBy("seq"))).withColumn("by_line", F.dense_rank().over(w.orderBy("along_m"))).withColumn("stops", F.count(F.lit(1)).over(w))
    tier = F.expr("case when own_m > 200 and other_m < 50 then 'HIGH_WRONG_DIRECTION' when own_m > 200 then 'HIGH_FAR_FROM_ROUTE' when abs(by_seq - by_line) >= 2 then 'MEDIUM_BAD_SEQUENCE' when own_m > 80 then 'LOW_BORDERLINE' else 'OK' end")
    return ranks.withColumn("tier", tier)


@query("SELECT route_id, direction, seq, stop_id, own_m, other_m, tier, stops FROM audit WHERE tier <> 'OK'", AUDIT)
def stop_audit(t: Transit) -> DataFrame:
    return _audit(t).where("tier <> 'OK'").select("route_id", "direction", "seq", "stop_id", "own_m", "other_m", "tier", "stops")


@query("SELECT route_id, count(*) AS total, count(*) FILTER (WHERE tier LIKE 'HIGH%') AS high, count(*) FILTER (WHERE tier LIKE 'MEDIUM%') AS medium, count(*) FILTER (WHERE tier LIKE 'LOW%') AS low FROM audit WHERE tier <> 'OK' GROUP BY 1 ORDER BY total DESC, route_id LIMIT 20", AUDIT)
def stop_audit_summary(t: Transit) -> DataFrame:
    g = _audit(t).where("tier <> 'OK'").groupBy("route_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("tier").startswith(p.upper())).alias(p) for p in ("high", "medium", "low")])
    return g.orderBy(F.desc("total"), "route_id").limit(20)


@query("SELECT route_id, direction, seq, stop_id, CASE WHEN abs(own_m - other_m) > 30 AND least(own_m, other_m) < 100 AND other_m < own_m THEN CASE WHEN EXISTS (SELECT 1 FROM audit b WHERE b.route_id = a.route_id AND b.direction <> a.direction AND b.stop_id = a.stop_id) THEN 'DELETE' ELSE 'RELABEL' END WHEN least(own_m, other_m) > 100 THEN 'REMOVE_FAR' ELSE 'KEEP' END AS action FROM audit a", AUDIT)
def direction_relabel(t: Transit) -> DataFrame:
    """What to do with each stop label: move it to the nearer direction, drop it, or leave it."""
    a = _audit(t)
    there = a.select("route_id", (1 - F.col("direction")).alias("direction"), "stop_id").distinct().withColumn("there", F.lit(True))
    met = a.join(there, ["route_id", "direction", "stop_id"], "left")
    return met.select("route_id", "direction", "seq", "stop_id", F.expr("case when abs(own_m - other_m) > 30 and least(own_m, other_m) < 100 and other_m < own_m then case when there then 'DELETE' else 'RELABEL' end when least(own_m, other_m) > 100 then 'REMOVE_FAR' else 'KEEP' end").alias("action"))


@query("SELECT route_id, direction, from_stop, to_stop FROM stats s WHERE NOT EXISTS (SELECT 1 FROM route_stops a JOIN route_stops b ON a.route_id = b.route_id AND a.direction = b.direction AND b.seq = a.seq + 1 WHERE a.route_id = s.route_id AND a.direction = s.direction AND a.stop_id = s.from_stop AND b.stop_id = s.to_stop)", "stats AS (SELECT a.route_id, a.direction, a.stop_id AS from_stop, b.stop_id AS to_stop FROM route_stops a JOIN route_stops b ON a.route_id = b.route_id AND a.direction = b.direction AND b.seq - a.seq IN (1, 2))")
def stale_segment_stats(t: Transit) -> DataFrame:
    """Statistics of stop pairs that no longer follow each other."""
    pairs = v.ordered_pairs(t.route_stops, 2)
    stats = t.route_stops.select("route_id", "direction", F.col("stop_id").alias("from_stop"), F.col("seq").alias("s")).join(t.route_stops.select("route_id", "direction", F.col("stop_id").alias("to_stop"), F.col("seq").alias("e")), ["route_id", "direction"]).where("e - s in (1, 2)").select("route_id", "direction", "from_stop", "to_stop")
    consecutive = pairs.where("to_seq = from_seq + 1").select("route_id", "direction", "from_stop", "to_stop")
    return stats.join(consecutive, ["route_id", "direction", "from_stop", "to_stop"], "left_anti")


@query("SELECT vehicle_id, coalesce(a.route_id, b.route_id) AS route_id FROM (SELECT vehicle_id, (vehicle_id % 5)::INT AS city_id, (vehicle_id % 25 + 1)::VARCHAR AS number FROM vehicles) v LEFT JOIN routes a ON a.city_id = v.city_id AND a.number = v.number LEFT JOIN (SELECT number, min(route_id) AS route_id FROM routes WHERE city_id <> 4 GROUP BY 1 HAVING count(*) = 1) b ON b.number = v.number WHERE coalesce(a.route_id, b.route_id) IS NOT NULL")
def backfill_unique_match(t: Transit) -> DataFrame:
    """Routes by city and number, else by a number that is unique; others are left out."""
    rows = t.vehicles.selectExpr("vehicle_id", "cast(vehicle_id % 5 as int) as city_id", "cast(vehicle_id % 25 + 1 as string) as number")
    exact = t.routes.select("city_id", "number", F.col("route_id").alias("a"))
    unique = t.routes.where("city_id <> 4").groupBy("number").agg(F.min("route_id").alias("b"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return rows.join(exact, ["city_id", "number"], "left").join(unique, "number", "left").select("vehicle_id", F.coalesce("a", "b").alias("route_id")).where("route_id is not null")


OPTIONS = TIMES + f""",
rides AS (SELECT request, 1 AS n, p.route_id AS r1, p.ride_s AS s1, NULL::BIGINT AS r2, NULL::BIGINT AS s2, NULL::BIGINT AS r3, NULL::BIGINT AS s3 FROM asked0 a JOIN pairs p ON p.from_stop = a.from_stop AND p.to_stop = a.to_stop WHERE a.from_stop <> a.to_stop
 UNION ALL SELECT request, 2, p.route_id, p.ride_s, q.route_id, q.ride_s, NULL, NULL FROM asked0 a JOIN pairs p ON p.from_stop = a.from_stop JOIN pairs q ON q.from_stop = p.to_stop AND q.to_stop = a.to_stop WHERE a.from_stop <> a.to_stop AND p.route_id <> q.route_id AND p.ride_s >= 60 AND q.ride_s >= 60 AND p.ride_s + q.ride_s <= 6000
 UNION ALL SELECT * FROM (SELECT request, 3, p.route_id, p.ride_s, q.route_id, q.ride_s, r.route_id, r.ride_s FROM asked0 a JOIN pairs p ON p.from_stop = a.from_stop JOIN pairs q ON q.from_stop = p.to_stop JOIN pairs r ON r.from_stop = q.to_stop AND r.to_stop = a.to_stop WHERE a.from_stop <> a.to_stop AND p.route_id <> q.route_id AND q.route_id <> r.route_id AND p.route_id <> r.route_id AND least(p.ride_s, q.ride_s, r.ride_s) >= 60 AND p.ride_s + q.ride_s + r.ride_s + 600 <= 9000 QUALIFY row_number() OVER (PARTITION BY request ORDER BY p.ride_s + q.ride_s + r.ride_s, p.route_id, q.route_id, r.route_id, p.to_stop, q.to_stop, p.direction, q.direction, r.direction) <= 5)),
ends AS (SELECT request, ceil(round({haversine_sql('a.lat + 0.002::DOUBLE * (request % 7)', 'a.lon', 'a.lat', 'a.lon')}, 3) / 83.33)::BIGINT AS w1, ceil(round({haversine_sql('b.lat', 'b.lon', 'b.lat - 0.002::DOUBLE * (request % 8)', 'b.lon')}, 3) / 83.33)::BIGINT AS w2 FROM asked0 JOIN stops a ON a.stop_id = from_stop JOIN stops b ON b.stop_id = to_stop),
timed AS (SELECT request, n, w1, w2, r1, r2, r3, greatest(1, s1 // 60) AS m1, greatest(1, s2 // 60) AS m2, greatest(1, s3 // 60) AS m3, greatest(1, s1 // 60) + CASE WHEN n > 1 THEN greatest(1, s2 // 60) ELSE 0 END + CASE WHEN n > 2 THEN greatest(1, s3 // 60) ELSE 0 END AS ride_min FROM rides JOIN ends USING (request))"""


@query(
    """SELECT request, (n - 1)::INT AS transfers, concat_ws(';', CASE WHEN w1 > 0 THEN 'WALK::' || w1 END, 'WAIT:' || r1 || ':5', 'RIDE:' || r1 || ':' || m1, CASE WHEN n > 1 THEN 'WAIT:' || r2 || ':5;RIDE:' || r2 || ':' || m2 END, CASE WHEN n > 2 THEN 'WAIT:' || r3 || ':5;RIDE:' || r3 || ':' || m3 END, CASE WHEN w2 > 0 THEN 'WALK::' || w2 END) AS path,
 (w1 + w2)::BIGINT AS walk_min, (5 * n)::BIGINT AS wait_min, ride_min::BIGINT AS ride_min, (w1 + w2 + 5 * n + ride_min)::BIGINT AS minutes, CASE WHEN w1 > 15 OR w2 > 15 THEN 'WALK' WHEN n > 1 AND ride_min + 5 * n > CASE n WHEN 2 THEN 100 ELSE 150 END THEN 'TOTAL' ELSE 'OK' END AS verdict FROM timed""",
    OPTIONS,
)
def option_assembly(t: Transit) -> DataFrame:
    """Journeys without, with one and with two changes as legs with walks and waits between, and whether they can be offered.

    A rider starts some way north of the first stop and goes some way south of the last one.
    """
    asked, pairs = _asked(t), _pairs(t)
    direct = r.direct_journeys(asked, pairs).select("request", F.lit(None).cast("bigint").alias("change_1"), F.lit(None).cast("bigint").alias("change_2"), F.array("route_id").alias("routes"), F.array("ride_s").alias("seconds"))
    one = r.one_transfer_journeys(asked, pairs, rides=True).select("request", F.col("change").alias("change_1"), F.lit(None).cast("bigint").alias("change_2"), F.array("route_1", "route_2").alias("routes"), F.array("ride_1", "ride_2").alias("seconds"))
    two = r.two_transfer_journeys(asked, pairs, rides=True).select("request", "change_1", "change_2", F.array("route_1", "route_2", "route_3").alias("routes"), F.array("ride_1", "ride_2", "ride_3").alias("seconds"))
    place = lambda name: t.stops.select(F.col("stop_id").alias(name), F.struct("stop_id", "lat", "lon").alias(f"{name}_at"))
    found = direct.unionByName(one).unionByName(two).join(asked, "request")
    for name in ("from_stop", "to_stop", "change_1", "change_2"):
        found = found.join(place(name), name, "left")
    moved = lambda c, by: F.struct(F.lit(None).cast("bigint").alias("stop_id"), (F.col(f"{c}.lat") + F.expr(by)).alias("lat"), F.col(f"{c}.lon").alias("lon"))
    stops = F.filter(F.array("from_stop_at", "change_1_at", "change_2_at", "to_stop_at"), lambda p: p.isNotNull())
    rides = F.transform("routes", lambda route, i: F.struct(route.alias("route_id"), F.get("at", i).alias("start"), F.get("at", i + 1).alias("stop"), F.get("seconds", i).alias("ride_s"), F.lit(300).alias("wait_s")))
    ready = found.withColumn("at", stops).select("request", moved("from_stop_at", "0.002D * (request % 7)").alias("origin"), moved("to_stop_at", "-0.002D * (request % 8)").alias("target"), rides.alias("rides"))
    return op.assemble(ready).select("request", "transfers", op.path(F.col("legs")).alias("path"), "walk_min", "wait_min", "ride_min", "minutes", "verdict")
