"""Queries over vehicles, places and areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayfold.functions import geo
from wayfold.operators import joins as j
from wayfold.operators import predicates as p
from wayfold.plans.book import Book
from wayfold.sources.transit import NOW_US, Transit, haversine_sql

book = Book()
query = book.query
RECENT = f"coalesce(updated_us > {NOW_US} - 300000000, false)"
CENTRE = (37.95, 58.375)


@query(f"""SELECT vehicle_id, coalesce(in_motion AND speed > 1, false) AS moving, NOT in_motion OR coalesce(speed, 0) <= 1 AS stationary, {RECENT} AS recent, updated_us IS NULL OR updated_us < {NOW_US} - 600000000 AS stale, route_id IS NOT NULL AS assigned, lat IS NOT NULL AS placed,
 is_active AND route_id IS NOT NULL AND lat IS NOT NULL AND {RECENT} AS ready, is_active AND {RECENT} AS operational, is_active AND (updated_us IS NULL OR updated_us < {NOW_US} - 600000000 OR route_id IS NULL) AS attention,
 is_active AND route_id IS NOT NULL AND lat IS NOT NULL AND {RECENT} AND in_motion AND speed > 1 AS working FROM vehicles""")
def vehicle_predicates(t: Transit) -> DataFrame:
    return t.vehicles.select(
        "vehicle_id", p.in_motion().alias("moving"), p.is_stationary().alias("stationary"), p.recent(NOW_US).alias("recent"), p.stale(NOW_US).alias("stale"), p.is_assigned().alias("assigned"), p.has_position().alias("placed"),
        p.ready_for_service(NOW_US).alias("ready"), p.operational(NOW_US).alias("operational"), p.requires_attention(NOW_US).alias("attention"), p.actively_working(NOW_US).alias("working"),
    )


@query("""SELECT route_id, distance_m IS NOT NULL AS has_distance, coalesce(distance_m > 9000, false) AS is_long, coalesce(distance_m < 7000, false) AS is_short, coalesce(duration_min > 45, false) AS is_slow, color IS NOT NULL AS has_color, city_id IN (0, 2) AS in_cities, lower(name) LIKE '%tion_1%' AS named, is_active AND color IS NOT NULL AND NOT coalesce(distance_m < 7000, false) AS shown FROM routes""")
def route_predicates(t: Transit) -> DataFrame:
    long, short = p.yes(F.col("distance_m") > 9000), p.yes(F.col("distance_m") < 7000)
    return t.routes.select("route_id", F.col("distance_m").isNotNull().alias("has_distance"), long.alias("is_long"), short.alias("is_short"), p.yes(F.col("duration_min") > 45).alias("is_slow"), F.col("color").isNotNull().alias("has_color"), F.col("city_id").isin(0, 2).alias("in_cities"), p.contains_ignoring_case("name", "tion_1").alias("named"), p.all_of(p.is_active(), F.col("color").isNotNull(), ~short).alias("shown"))


@query("""SELECT s.stop_id, s.is_major, coalesce(r.n, 0) AS serving, coalesce(r.n, 0) >= 2 AS multiple, s.is_major AND coalesce(r.n, 0) >= 2 AS transfer_point, s.lat BETWEEN 37.92 AND 37.98 AND s.lon BETWEEN 58.32 AND 58.4 AS in_box, s.name_tm IS NOT NULL AS translated, NOT s.is_active OR s.name_tm IS NULL AS attention FROM stops s LEFT JOIN (SELECT stop_id, count(DISTINCT route_id) AS n FROM route_stops GROUP BY 1) r USING (stop_id)""")
def stop_predicates(t: Transit) -> DataFrame:
    serving = t.route_stops.groupBy("stop_id").agg(F.count_distinct("route_id").alias("serving"))
    s = t.stops.join(serving, "stop_id", "left").withColumn("serving", F.coalesce("serving", F.lit(0)))
    bounds = {"south": F.lit(37.92), "north": F.lit(37.98), "west": F.lit(58.32), "east": F.lit(58.4)}
    return s.select("stop_id", "is_major", "serving", (F.col("serving") >= 2).alias("multiple"), (F.col("is_major") & (F.col("serving") >= 2)).alias("transfer_point"), geo.in_box(F.col("lat"), F.col("lon"), bounds).alias("in_box"), F.col("name_tm").isNotNull().alias("translated"), (~p.is_active() | F.col("name_tm").isNull()).alias("attention"))


@query("""SELECT vehicle_id, regexp_matches(plate, '^[0-9]{4}\\s[A-Z]{3}$') AS plate_ok, speed BETWEEN 0 AND 200 AS speed_ok, lat IS NULL OR (lat BETWEEN 35 AND 43 AND lon BETWEEN 52 AND 67) AS place_ok FROM vehicles""".replace("\\\\", "\\"))
def check_constraints(t: Transit) -> DataFrame:
    return t.vehicles.select("vehicle_id", F.col("plate").rlike(p.PLATE).alias("plate_ok"), F.col("speed").between(0, 200).alias("speed_ok"), (F.col("lat").isNull() | p.in_area(F.col("lat"), F.col("lon"))).alias("place_ok"))


@query("SELECT vehicle_id FROM vehicles WHERE provider = 1 AND lower(plate) LIKE '%1%'")
def optional_filters(t: Transit) -> DataFrame:
    """Filters that are given apply, those that are null do not."""
    return t.vehicles.where(p.optional("provider", 1) & p.optional("route_id", None) & p.contains_ignoring_case("plate", "1")).select("vehicle_id")


@query("SELECT plan_id, option_no FROM options WHERE transfers <= 1 AND walk_min <= 1000 / 66.67 AND minutes <= 240 AND reliability >= 0.95")
def trip_option_filter(t: Transit) -> DataFrame:
    return t.options.where((F.col("transfers") <= 1) & (F.col("walk_min") <= 1000 / 66.67) & (F.col("minutes") <= 240) & (F.col("reliability") >= 0.95)).select("plan_id", "option_no")


@query("""SELECT v.vehicle_id, mode FROM vehicles v LEFT JOIN routes r USING (route_id), (VALUES ('routes'), ('bounds'), ('city'), ('all')) m(mode)
WHERE CASE mode WHEN 'routes' THEN r.number IN ('3', '8', '21') WHEN 'bounds' THEN v.lat BETWEEN 37.93 AND 37.96 AND v.lon BETWEEN 58.33 AND 58.38 WHEN 'city' THEN coalesce(r.city_id, 2) = 2 ELSE true END""")
def subscription_filter(t: Transit) -> DataFrame:
    """The vehicles that each kind of subscription lets through; an unknown city passes."""
    v = t.vehicles.join(F.broadcast(t.routes.select("route_id", "number", "city_id")), "route_id", "left")
    passes = {
        "routes": F.trim("number").isin("3", "8", "21"),
        "bounds": geo.in_box(F.col("lat"), F.col("lon"), {"south": F.lit(37.93), "north": F.lit(37.96), "west": F.lit(58.33), "east": F.lit(58.38)}),
        "city": F.coalesce("city_id", F.lit(2)) == 2,
        "all": F.lit(True),
    }
    return v.select("vehicle_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(m)) for m, c in passes.items()]))).alias("mode"))


@query(f"""SELECT vehicle_id, route_id IS NOT DISTINCT FROM 3 AS by_route, lat BETWEEN 37.93 AND 37.96 AND lon BETWEEN 58.33 AND 58.38 AS by_area, {haversine_sql('37.95', '58.375', 'lat', 'lon')} <= 3000 AS by_radius FROM vehicles WHERE lat IS NOT NULL AND {RECENT} AND NOT in_garage""")
def active_vehicles(t: Transit) -> DataFrame:
    """Vehicles online, and which query modes they fit."""
    online = t.vehicles.where(p.has_position() & p.recent(NOW_US) & ~F.col("in_garage"))
    area = {"south": F.lit(37.93), "north": F.lit(37.96), "west": F.lit(58.33), "east": F.lit(58.38)}
    return online.select("vehicle_id", p.optional("route_id", 3).alias("by_route"), geo.in_box(F.col("lat"), F.col("lon"), area).alias("by_area"), (geo.haversine(F.lit(CENTRE[0]), F.lit(CENTRE[1]), F.col("lat"), F.col("lon")) <= 3000).alias("by_radius"))


@query("SELECT fix_id, lag_us > 30000000 AS buffered, (hdop IS NULL OR hdop <= 5) AND (satellites IS NULL OR satellites >= 4) AS good, coalesce(CASE WHEN fix_id % 5 <> 0 THEN in_motion END, speed > 0) AS moving FROM fixes")
def fix_quality(t: Transit) -> DataFrame:
    return t.fixes.select("fix_id", (F.col("lag_us") > 30_000_000).alias("buffered"), F.expr("(hdop is null or hdop <= 5) and (satellites is null or satellites >= 4)").alias("good"), F.expr("coalesce(case when fix_id % 5 <> 0 then in_motion end, speed > 0)").alias("moving"))


def walks(here: DataFrame, there: DataFrame, metres: float) -> DataFrame:
    """Walks from stops to other stops (stop_id, lat, lon) at most so far apart."""
    d = F.round("distance_m", 3)
    seconds = F.greatest(F.lit(1), F.round(d / (5000.0 / 3600)).cast("bigint"))
    met = j.within_distance(here.withColumnRenamed("stop_id", "from_stop"), there.toDF("to_stop", "r_lat", "r_lon"), metres, _m=d, walk_s=seconds)
    return met.where("from_stop <> to_stop").select("from_stop", "to_stop", F.col("_m").alias("distance_m"), "walk_s")


@query(
    f"""SELECT from_stop, to_stop, distance_m, greatest(1, round(distance_m / (5000.0 / 3600)))::BIGINT AS walk_s FROM (SELECT a, b, d FROM near UNION ALL SELECT b, a, d FROM near) x(from_stop, to_stop, distance_m)""",
    f"""near AS (SELECT a.stop_id AS a, b.stop_id AS b, round({haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 3) AS d FROM stops a JOIN stops b ON b.stop_id > a.stop_id WHERE a.is_active AND b.is_active AND {haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 1500)""",
)
def stop_transfers(t: Transit) -> DataFrame:
    """Walks between active stops at most 1500 m apart, either way."""
    s = t.stops.where("is_active").select("stop_id", "lat", "lon")
    return walks(s, s, 1500.0)


@query(f"""SELECT stop_id, name, round(d, 3) AS distance_m FROM (SELECT *, {haversine_sql('37.95', '58.375', 'lat', 'lon')} AS d FROM stops) WHERE d <= 2500""")
def stops_within_radius(t: Transit) -> DataFrame:
    return j.within_radius(t.stops, *CENTRE, 2500.0).select("stop_id", "name", F.round("distance_m", 3).alias("distance_m"))


@query(f"""SELECT stop_id, round({haversine_sql('37.95', '58.375', 'lat', 'lon')}, 3) AS distance_m FROM stops ORDER BY distance_m, stop_id LIMIT 15""")
def nearest_stops(t: Transit) -> DataFrame:
    return t.stops.select("stop_id", F.round(geo.haversine(F.lit(CENTRE[0]), F.lit(CENTRE[1]), F.col("lat"), F.col("lon")), 3).alias("distance_m")).orderBy("distance_m", "stop_id").limit(15)


@query(f"""SELECT layer, stop_id, distance_m FROM (SELECT layer, most, stop_id, distance_m, row_number() OVER (PARTITION BY layer ORDER BY distance_m, stop_id) AS rn FROM (SELECT stop_id, round({haversine_sql('37.95', '58.375', 'lat', 'lon')}, 3) AS distance_m FROM stops), (VALUES (1, 600.0, 4), (2, 1500.0, 6), (3, 3000.0, 8)) l(layer, radius, most) WHERE distance_m <= radius) WHERE rn <= most""")
def layered_nearest_stops(t: Transit) -> DataFrame:
    """The nearest stops within ever wider rings, each with its own number."""
    near = j.within_radius(t.stops, *CENTRE, 3000.0).select("stop_id", F.round("distance_m", 3).alias("distance_m"))
    layers = [near.where(F.col("distance_m") <= r).orderBy("distance_m", "stop_id").limit(n).select(F.lit(k).alias("layer"), "stop_id", "distance_m") for k, r, n in ((1, 600.0, 4), (2, 1500.0, 6), (3, 3000.0, 8))]
    return layers[0].unionByName(layers[1]).unionByName(layers[2])


RING_SQL = """(SELECT count(*) FROM (SELECT boundary[i] AS a, boundary[i + 1] AS b FROM range(1, len(boundary)) r(i)) WHERE ((a.lat > v.lat) <> (b.lat > v.lat)) AND v.lon < (b.lon - a.lon) * (v.lat - a.lat) / (b.lat - a.lat) + a.lon) % 2 = 1"""


FENCE_SQL = f"""CASE WHEN boundary IS NOT NULL THEN {RING_SQL} ELSE {haversine_sql('v.lat', 'v.lon', 'g.lat', 'g.lon')} <= g.radius END"""
#: Whether v lies in the bounds of g's boundary or circle.
BOX_SQL = """CASE WHEN boundary IS NOT NULL THEN v.lat BETWEEN list_min(list_transform(boundary, lambda p: p.lat)) AND list_max(list_transform(boundary, lambda p: p.lat)) AND v.lon BETWEEN list_min(list_transform(boundary, lambda p: p.lon)) AND list_max(list_transform(boundary, lambda p: p.lon))
 ELSE v.lat BETWEEN g.lat - g.radius / 111000.0 AND g.lat + g.radius / 111000.0 AND v.lon BETWEEN g.lon - g.radius / 111000.0 / cos(radians(g.lat)) AND g.lon + g.radius / 111000.0 / cos(radians(g.lat)) END"""


def fences(t: Transit) -> DataFrame:
    return t.garages.select("garage_id", F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"), F.col("radius").alias("g_radius"), F.col("boundary").alias("g_boundary"))


@query(f"""SELECT v.vehicle_id, g.garage_id, {FENCE_SQL} AS inside FROM vehicles v JOIN garages g ON {BOX_SQL} WHERE v.lat IS NOT NULL""")
def garage_geofence(t: Transit) -> DataFrame:
    """Placed vehicles and the garages in whose bounds they lie: whether they are inside the fence."""
    return j.fenced(t.vehicles.where(p.has_position()).select("vehicle_id", "lat", "lon"), fences(t)).select("vehicle_id", "garage_id", "inside")


@query(
    f"""SELECT vehicle_id, stop_id, seq, round(d, 3) AS distance_m FROM (SELECT v.vehicle_id, r.stop_id, r.seq, {haversine_sql('v.lat', 'v.lon', 'r.lat', 'r.lon')} AS d, row_number() OVER (PARTITION BY v.vehicle_id ORDER BY {haversine_sql('v.lat', 'v.lon', 'r.lat', 'r.lon')}, r.stop_id, r.seq) AS rn FROM vehicles v JOIN placed_stops r ON r.route_id = v.route_id AND r.direction = v.direction WHERE v.lat IS NOT NULL) WHERE rn = 1"""
)
def nearest_stop(t: Transit) -> DataFrame:
    """The nearest stop of each vehicle's route and direction."""
    found = j.nearest(t.vehicles.where(p.has_position()).select("vehicle_id", "route_id", "direction", "lat", "lon"), t.placed_stops.withColumnsRenamed({"lat": "r_lat", "lon": "r_lon"}), ["route_id", "direction"], "vehicle_id", "stop_id")
    return found.select("vehicle_id", "stop_id", "seq", F.round("distance_m", 3).alias("distance_m"))


#: Segments in SQL, and the nearest place on each to a point (q_lat, q_lon).
SEGMENTS_SQL = f"""segs0 AS (SELECT route_id, direction, seq, lat AS a_lat, lon AS a_lon, lead(lat) OVER w AS b_lat, lead(lon) OVER w AS b_lon FROM placed_stops WINDOW w AS (PARTITION BY route_id, direction ORDER BY seq)),
segs1 AS (SELECT *, {haversine_sql('a_lat', 'a_lon', 'b_lat', 'b_lon')} AS length_m FROM segs0 WHERE b_lat IS NOT NULL),
segs AS (SELECT route_id, direction, seq - 1 AS segment, a_lat, a_lon, b_lat, b_lon, length_m, coalesce(sum(length_m) OVER (PARTITION BY route_id, direction ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_m FROM segs1)"""
T_SQL = """CASE WHEN a_lat = b_lat AND a_lon = b_lon THEN 0.0 ELSE greatest(0.0, least(1.0, ((q_lon - a_lon) * cos(radians((a_lat + b_lat) / 2)) * ((b_lon - a_lon) * cos(radians((a_lat + b_lat) / 2))) + (q_lat - a_lat) * (b_lat - a_lat)) / (pow((b_lon - a_lon) * cos(radians((a_lat + b_lat) / 2)), 2) + pow(b_lat - a_lat, 2)))) END"""
SNAP_SQL = SEGMENTS_SQL + f""",
met AS (SELECT *, {T_SQL} AS t FROM asked JOIN segs USING (route_id, direction)),
away AS (SELECT *, round({haversine_sql('q_lat', 'q_lon', '(a_lat + (b_lat - a_lat) * t)', '(a_lon + (b_lon - a_lon) * t)')}, 6) AS d FROM met),
snapped AS (SELECT * FROM away QUALIFY row_number() OVER (PARTITION BY key, route_id, direction ORDER BY d, segment) = 1),
line AS (SELECT route_id, direction, max(start_m + length_m) AS line_m FROM segs GROUP BY 1, 2)"""


@query(
    "SELECT key AS vehicle_id, segment, round(a_lat + (b_lat - a_lat) * t, 6) AS snap_lat, round(a_lon + (b_lon - a_lon) * t, 6) AS snap_lon, round(d, 3) AS distance_m, round((start_m + length_m * t) / line_m, 6) AS fraction FROM snapped JOIN line USING (route_id, direction)",
    "asked AS (SELECT vehicle_id AS key, route_id, direction, lat AS q_lat, lon AS q_lon FROM vehicles WHERE lat IS NOT NULL AND route_id IS NOT NULL), " + SNAP_SQL,
)
def snap_to_route(t: Transit) -> DataFrame:
    points = t.vehicles.where(p.has_position() & p.is_assigned()).select("vehicle_id", "route_id", "direction", "lat", "lon")
    r = lambda c, n: F.round(c, n).alias(c)
    return j.snap(points, j.segments(t.placed_stops), ["route_id", "direction"], "vehicle_id").select("vehicle_id", "segment", r("snap_lat", 6), r("snap_lon", 6), r("distance_m", 3), r("fraction", 6))


@query(
    "SELECT route_id, direction, stop_id, seq, round((start_m + length_m * t) / line_m, 6) AS fraction FROM snapped JOIN line USING (route_id, direction)",
    "asked AS (SELECT route_id * 100 + direction * 50 + seq AS key, route_id, direction, stop_id, seq, lat AS q_lat, lon AS q_lon FROM placed_stops), " + SNAP_SQL.replace("FROM asked JOIN segs USING (route_id, direction)", "FROM asked JOIN (SELECT * FROM segs) g USING (route_id, direction)"),
)
def stop_fractions(t: Transit) -> DataFrame:
    """How far along its route each stop lies, 0 to 1."""
    points = t.placed_stops.withColumn("key", F.expr("route_id * 100 + direction * 50 + seq"))
    return j.snap(points.select("key", "route_id", "direction", "lat", "lon"), j.segments(t.placed_stops), ["route_id", "direction"], "key").join(points.select("key", "stop_id", "seq"), "key").select("route_id", "direction", "stop_id", "seq", F.round("fraction", 6).alias("fraction"))


@query(
    "SELECT route_id, direction, count(*) FILTER (WHERE f < before - 0.002) AS inversions FROM (SELECT route_id, direction, f, lag(f) OVER (PARTITION BY route_id, direction ORDER BY seq) AS before FROM (SELECT route_id, direction, seq, round((start_m + length_m * t) / line_m, 6) AS f FROM snapped JOIN line USING (route_id, direction))) GROUP BY 1, 2",
    "asked AS (SELECT route_id * 100 + direction * 50 + seq AS key, route_id, direction, seq, lat AS q_lat, lon AS q_lon FROM placed_stops), " + SNAP_SQL,
)
def sequence_inversions(t: Transit) -> DataFrame:
    """Stops that lie before the one that precedes them."""
    w = W.partitionBy("route_id", "direction").orderBy("seq")
    return stop_fractions(t).withColumn("before", F.lag("fraction").over(w)).groupBy("route_id", "direction").agg(F.count_if(F.col("fraction") < F.col("before") - 0.002).alias("inversions"))


@query(
    "SELECT route_id, direction, round(min(d), 3) AS distance_m, min_by(segment, d * 1000 + segment) AS segment FROM away GROUP BY 1, 2 HAVING min(d) <= 1000",
    "asked AS (SELECT 1 AS key, route_id, direction, 37.95::DOUBLE AS q_lat, 58.375::DOUBLE AS q_lon FROM (SELECT DISTINCT route_id, direction FROM route_stops)), " + SNAP_SQL,
)
def routes_in_area(t: Transit) -> DataFrame:
    """Routes that come within 1000 m of a place, with the nearest segment."""
    segs = j.segments(t.placed_stops).withColumns({"lat": F.lit(CENTRE[0]), "lon": F.lit(CENTRE[1]), "key": F.lit(1)})
    points = segs.select("key", "route_id", "direction", "lat", "lon").distinct()
    return j.snap(points, segs.drop("lat", "lon", "key"), ["route_id", "direction"], "key").where("distance_m <= 1000").select("route_id", "direction", F.round("distance_m", 3).alias("distance_m"), "segment")


@query(
    f"SELECT route_id, direction, segment, k, round(a_lat + (b_lat - a_lat) * k / n, 9) AS lat, round(a_lon + (b_lon - a_lon) * k / n, 9) AS lon FROM (SELECT *, greatest(1, ceil(length_m / 500))::INT AS n FROM segs), range(64) r(k) WHERE k < n",
    SEGMENTS_SQL,
)
def densified_routes(t: Transit) -> DataFrame:
    """Route lines with a point at least every 500 m."""
    s = j.segments(t.placed_stops).withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("length_m") / 500)).cast("int"))
    return s.withColumn("k", F.explode(F.expr("sequence(0, n - 1)"))).select("route_id", "direction", "segment", F.col("k").cast("bigint").alias("k"), F.expr("round(a_lat + (b_lat - a_lat) * k / n, 9)").alias("lat"), F.expr("round(a_lon + (b_lon - a_lon) * k / n, 9)").alias("lon"))


@query(
    "SELECT route_id, direction, count(*) AS segments, round(sum(length_m), 3) AS length_m, round(min(length_m), 3) AS least_m, round(max(length_m), 3) AS most_m FROM segs GROUP BY 1, 2",
    SEGMENTS_SQL,
)
def route_lengths(t: Transit) -> DataFrame:
    return j.segments(t.placed_stops).groupBy("route_id", "direction").agg(F.count(F.lit(1)).alias("segments"), F.round(F.sum("length_m"), 3).alias("length_m"), F.round(F.min("length_m"), 3).alias("least_m"), F.round(F.max("length_m"), 3).alias("most_m"))


@query(
    "SELECT route_id, direction, q, round(a_lat + (b_lat - a_lat) * (q * line_m - start_m) / length_m, 6) AS lat, round(a_lon + (b_lon - a_lon) * (q * line_m - start_m) / length_m, 6) AS lon FROM segs JOIN (SELECT route_id, direction, max(start_m + length_m) AS line_m FROM segs GROUP BY 1, 2) USING (route_id, direction), (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) f(q) WHERE length_m > 0 AND q * line_m >= start_m AND q * line_m < start_m + length_m",
    SEGMENTS_SQL,
)
def points_at_fraction(t: Transit) -> DataFrame:
    """The places at fractions of each line."""
    s = j.segments(t.placed_stops)
    line = s.groupBy("route_id", "direction").agg(F.max(F.expr("start_m + length_m")).alias("line_m"))
    met = s.join(line, ["route_id", "direction"]).withColumn("q", F.explode(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))).where("length_m > 0 and q * line_m >= start_m and q * line_m < start_m + length_m")
    return met.select("route_id", "direction", "q", F.expr("round(a_lat + (b_lat - a_lat) * (q * line_m - start_m) / length_m, 6)").alias("lat"), F.expr("round(a_lon + (b_lon - a_lon) * (q * line_m - start_m) / length_m, 6)").alias("lon"))


@query(f"""SELECT a.vehicle_id, round({haversine_sql('a.lat', 'a.lon', '37.95', '58.375')}, 3) AS distance_m, round(bearing, 6) AS bearing, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][floor((bearing + 22.5) / 45.0)::INT % 8 + 1] AS wind, ceil({haversine_sql('a.lat', 'a.lon', '37.95', '58.375')} / 83.33)::BIGINT AS walk_min
FROM (SELECT *, (degrees(atan2(sin(radians(58.375 - lon)) * cos(radians(37.95)), cos(radians(lat)) * sin(radians(37.95)) - sin(radians(lat)) * cos(radians(37.95)) * cos(radians(58.375 - lon)))) + 360.0) % 360.0 AS bearing FROM vehicles WHERE lat IS NOT NULL) a""")
def geo_functions(t: Transit) -> DataFrame:
    """Distance, course, wind and walk from each vehicle to a place."""
    v = t.vehicles.where(p.has_position())
    there = (F.lit(CENTRE[0]), F.lit(CENTRE[1]))
    d, b = geo.haversine(F.col("lat"), F.col("lon"), *there), geo.bearing(F.col("lat"), F.col("lon"), *there)
    return v.select("vehicle_id", F.round(d, 3).alias("distance_m"), F.round(b, 6).alias("bearing"), geo.cardinal(b).alias("wind"), geo.walk_minutes(d).alias("walk_min"))


@query("""SELECT garage_id, 'POLYGON((' || array_to_string(list_transform(boundary, lambda p: printf('%.6f %.6f', p.lon, p.lat)), ', ') || '))' AS wkt, round(list_sum(list_transform(boundary[1:len(boundary) - 1], lambda p: p.lat)) / (len(boundary) - 1), 6) AS centre_lat, round(list_sum(list_transform(boundary[1:len(boundary) - 1], lambda p: p.lon)) / (len(boundary) - 1), 6) AS centre_lon, len(boundary)::INT AS corners FROM garages WHERE boundary IS NOT NULL""")
def garage_shapes(t: Transit) -> DataFrame:
    """Garage rings as text and back, closed, with their centres."""
    g = t.garages.where("boundary is not null").withColumn("wkt", geo.to_wkt(F.col("boundary"), "POLYGON"))
    again = g.withColumn("ring", geo.closed(geo.from_wkt(F.col("wkt"))))
    c = geo.ring_centre(F.col("ring"))
    return again.select("garage_id", "wkt", F.round(c["lat"], 6).alias("centre_lat"), F.round(c["lon"], 6).alias("centre_lon"), F.size("ring").alias("corners"))


@query("""SELECT a.id AS a_key, b.id AS b_key, a.kind, greatest(a.s, b.s) AS "from" FROM placements a JOIN placements b ON a.kind = b.kind AND a.pos = b.pos AND a.id < b.id AND a.s <= coalesce(b.e, 99999) AND b.s <= coalesce(a.e, 99999)""", "placements AS (SELECT stop_id AS id, city_id AS kind, (stop_id % 4)::INT AS pos, (stop_id * 37 % 300) AS s, CASE WHEN stop_id % 9 <> 0 THEN stop_id * 37 % 300 + stop_id * 11 % 60 END AS e FROM stops)")
def placement_conflicts(t: Transit) -> DataFrame:
    """Placements of one kind and position whose periods overlap; no end is for ever."""
    pl = t.stops.selectExpr("stop_id as id", "city_id as kind", "cast(stop_id % 4 as int) as pos", "stop_id * 37 % 300 as s", "case when stop_id % 9 <> 0 then stop_id * 37 % 300 + stop_id * 11 % 60 end as e")
    return j.overlapping(pl, ["kind", "pos"], "id", "s", "e", 50).select("a_key", "b_key", "kind", "from")


@query("""SELECT v.vehicle_id, v.seq0, v.rn - 1 AS chunk FROM (SELECT vehicle_id, row_number() OVER (ORDER BY vehicle_id) AS seq0, (row_number() OVER (ORDER BY vehicle_id) - 1) // 500 + 1 AS rn FROM vehicles WHERE is_active ORDER BY vehicle_id LIMIT 2000) v""")
def snapshot_chunks(t: Transit) -> DataFrame:
    """The first 2000 active vehicles in chunks of 500."""
    first = t.vehicles.where("is_active").select("vehicle_id").orderBy("vehicle_id").limit(2000)
    return first.withColumn("seq0", F.row_number().over(W.orderBy("vehicle_id")).cast("bigint")).select("vehicle_id", "seq0", F.expr("(seq0 - 1) div 500").alias("chunk"))


@query(
    f"""SELECT * FROM own UNION ALL SELECT g.place_id, g.name, 'geocoder' FROM geo g WHERE (SELECT count(*) FROM own) < 300 AND NOT EXISTS (SELECT 1 FROM places p WHERE p.name LIKE 'blue%' AND abs(p.lat - g.lat) < 0.0005 AND abs(p.lon - g.lon) < 0.0005)""",
    "own AS (SELECT place_id, name, 'db' AS origin FROM places WHERE name LIKE 'blue%'), geo AS (SELECT stop_id AS place_id, name, lat, lon FROM stops)",
)
def place_geocoder_merge(t: Transit) -> DataFrame:
    """Our places, and those of a geocoder that are not near one of ours, while ours are few."""
    own = t.places.where(F.col("name").startswith("blue"))
    few = own.agg((F.count(F.lit(1)) < 300).alias("few"))
    step = 0.0005
    cells = own.select(F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), F.floor(F.col("lat") / step).alias("row"), F.floor(F.col("lon") / step).alias("column"))
    other = t.stops.select(F.col("stop_id").alias("place_id"), "name", "lat", "lon")
    around = other.withColumn("cell", F.explode(geo.neighbour_cells(F.floor(F.col("lat") / step), F.floor(F.col("lon") / step)))).select("place_id", "lat", "lon", "cell.row", "cell.column")
    close = around.join(cells, ["row", "column"]).where(f"abs(p_lat - lat) < {step} and abs(p_lon - lon) < {step}").select("place_id").distinct()
    added = other.join(close, "place_id", "left_anti").crossJoin(F.broadcast(few)).where("few").select("place_id", "name", F.lit("geocoder").alias("origin"))
    return own.select("place_id", "name", F.lit("db").alias("origin")).unionByName(added)


@query("""SELECT route_id, direction, '{"type":"LineString","coordinates":[' || string_agg(printf('[%.6f,%.6f]', lon, lat), ',' ORDER BY seq) || ']}' AS geojson FROM placed_stops GROUP BY 1, 2""")
def route_geojson(t: Transit) -> DataFrame:
    """The line of each route and direction as GeoJSON."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))), lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon")))
    return t.placed_stops.groupBy("route_id", "direction").agg(points.alias("line")).select("route_id", "direction", geo.to_geojson(F.col("line")).alias("geojson"))


@query(
    f"SELECT stop_id, garage_id, round(min({haversine_sql('q_lat', 'q_lon', '(a_lat + (b_lat - a_lat) * t)', '(a_lon + (b_lon - a_lon) * t)')}), 3) AS edge_m FROM (SELECT *, {T_SQL} AS t FROM (SELECT s.stop_id, g.garage_id, s.lat AS q_lat, s.lon AS q_lon, g.boundary[k + 1].lat AS a_lat, g.boundary[k + 1].lon AS a_lon, g.boundary[k + 2].lat AS b_lat, g.boundary[k + 2].lon AS b_lon FROM stops s JOIN garages g ON g.garage_id = s.city_id, range(4) r(k) WHERE g.boundary IS NOT NULL)) GROUP BY 1, 2"
)
def garage_edges(t: Transit) -> DataFrame:
    """How far each stop is from the fence of its city's garage."""
    met = t.stops.select("stop_id", "city_id", "lat", "lon").join(t.garages.where("boundary is not null").select("garage_id", "boundary"), F.col("city_id") == F.col("garage_id"))
    return met.select("stop_id", "garage_id", F.round(geo.ring_distance(F.col("lat"), F.col("lon"), F.col("boundary")), 3).alias("edge_m"))
