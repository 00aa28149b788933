"""Queries over the network and the trip searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayfold.operators import views as v
from wayfold.plans.book import Book
from wayfold.sources.transit import Transit

book = Book()
query = book.query


@query("""SELECT r.route_id, r.number, r.is_active, count(DISTINCT rs.stop_id) AS total_stops, count(DISTINCT CASE WHEN rs.direction = 0 THEN rs.stop_id END) AS forward_stops, count(DISTINCT CASE WHEN rs.direction = 1 THEN rs.stop_id END) AS backward_stops,
 count(DISTINCT v.vehicle_id) AS total_vehicles, count(DISTINCT CASE WHEN v.is_active THEN v.vehicle_id END) AS active_vehicles, max(rs.seq) AS max_seq
FROM routes r LEFT JOIN route_stops rs USING (route_id) LEFT JOIN vehicles v ON v.route_id = r.route_id GROUP BY ALL""")
def mv_route_statistics(t: Transit) -> DataFrame:
    return v.route_statistics(t.routes, t.route_stops, t.vehicles)


@query("""SELECT a.stop_id AS from_stop, b.stop_id AS to_stop, a.route_id, r.number, a.direction, (b.seq - a.seq) * 2 AS est_minutes, (SELECT count(*) FROM vehicles v WHERE v.route_id = a.route_id AND v.is_active) AS active_vehicles,
 x.name AS from_name, x.lat AS from_lat, x.lon AS from_lon, y.name AS to_name, y.lat AS to_lat, y.lon AS to_lon
FROM route_stops a JOIN route_stops b ON a.route_id = b.route_id AND a.direction = b.direction AND a.seq < b.seq AND b.seq - a.seq <= 20 JOIN routes r ON r.route_id = a.route_id AND r.is_active JOIN stops x ON x.stop_id = a.stop_id AND x.is_active JOIN stops y ON y.stop_id = b.stop_id AND y.is_active""")
def mv_popular_direct_routes(t: Transit) -> DataFrame:
    return v.popular_direct_routes(t.routes, t.route_stops, t.vehicles, t.stops)


@query("""SELECT a.stop_id AS from_stop, b.stop_id AS to_stop, x.name AS from_name, y.name AS to_name, count(DISTINCT a.route_id) AS routes, array_to_string(list_sort(list(DISTINCT r.number)), ',') AS numbers, min((b.seq - a.seq) * 2)::INT AS least_minutes, round(avg((b.seq - a.seq) * 2), 6) AS mean_minutes
FROM route_stops a JOIN route_stops b ON a.route_id = b.route_id AND a.direction = b.direction AND a.seq < b.seq AND a.stop_id <> b.stop_id JOIN routes r ON r.route_id = a.route_id AND r.is_active JOIN stops x ON x.stop_id = a.stop_id AND x.is_active JOIN stops y ON y.stop_id = b.stop_id AND y.is_active GROUP BY ALL""")
def mv_stop_connections(t: Transit) -> DataFrame:
    return v.stop_connections(t.route_stops, t.routes, t.stops)


@query("""SELECT r.route_id, r.number, r.color, r.duration_min, count(DISTINCT CASE WHEN v.is_active THEN v.vehicle_id END) AS active_vehicles, count(DISTINCT CASE WHEN v.in_motion THEN v.vehicle_id END) AS moving_vehicles, count(DISTINCT rs.stop_id) AS stops, max(v.updated_us) AS last_update_us
FROM routes r LEFT JOIN route_stops rs USING (route_id) LEFT JOIN vehicles v ON v.route_id = r.route_id WHERE r.is_active GROUP BY ALL""")
def mv_active_routes_summary(t: Transit) -> DataFrame:
    return v.active_routes_summary(t.routes, t.route_stops, t.vehicles)


@query("""SELECT created_us - created_us % 3600000000 AS hour_us, count(*) AS searches, count(*) FILTER (WHERE n IS NOT NULL) AS successful, count(*) FILTER (WHERE n IS NULL) AS failed, round(avg(coalesce(n, 0)), 6) AS mean_options
FROM plans LEFT JOIN (SELECT plan_id, count(*) AS n FROM options GROUP BY 1) USING (plan_id) GROUP BY 1""")
def mv_search_hourly_stats(t: Transit) -> DataFrame:
    return v.search_hourly(t.plans, t.options)


@query("""SELECT kind, round(lat::DECIMAL(20,10), 3)::DOUBLE AS lat3, round(lon::DECIMAL(20,10), 3)::DOUBLE AS lon3, count(*) AS searches
FROM (SELECT 'origin' AS kind, o_lat AS lat, o_lon AS lon FROM plans UNION ALL SELECT 'destination', d_lat, d_lon FROM plans) GROUP BY ALL""")
def mv_search_heatmap(t: Transit) -> DataFrame:
    return v.search_heatmap(t.plans)


@query("""SELECT round(o_lat::DECIMAL(20,10), 2)::DOUBLE AS o_lat2, round(o_lon::DECIMAL(20,10), 2)::DOUBLE AS o_lon2, round(d_lat::DECIMAL(20,10), 2)::DOUBLE AS d_lat2, round(d_lon::DECIMAL(20,10), 2)::DOUBLE AS d_lon2, count(*) AS searches, round(avg(coalesce(n, 0)), 6) AS mean_options
FROM plans LEFT JOIN (SELECT plan_id, count(*) AS n FROM options GROUP BY 1) USING (plan_id) GROUP BY ALL HAVING count(*) >= 2""")
def mv_popular_od_pairs(t: Transit) -> DataFrame:
    return v.popular_od_pairs(t.plans, t.options)


@query(
    """SELECT p.day, p.plans, p.successful, p.mean_options, p.mean_minutes, m.top_route FROM totals p LEFT JOIN modes m USING (day)""",
    """by_plan AS (SELECT plan_id, count(*) AS n, sum(minutes) AS minutes FROM options GROUP BY 1),
totals AS (SELECT created_us // 86400000000 AS day, count(*) AS plans, count(n) AS successful, round(avg(coalesce(n, 0)), 6) AS mean_options, round(sum(minutes) / sum(n), 6) AS mean_minutes FROM plans LEFT JOIN by_plan USING (plan_id) GROUP BY 1),
used AS (SELECT created_us // 86400000000 AS day, route_id, count(*) AS uses FROM plans JOIN options USING (plan_id) GROUP BY 1, 2),
modes AS (SELECT day, route_id AS top_route FROM used QUALIFY row_number() OVER (PARTITION BY day ORDER BY uses DESC, route_id) = 1)""",
)
def trip_plan_statistics(t: Transit) -> DataFrame:
    return v.plan_statistics(t.plans, t.options)


@query("SELECT count(*) AS plans, count(DISTINCT plan_id) FILTER (WHERE status = 'F') AS finished, round(avg(price), 4) AS mean_price, min(created_us) AS first_us, max(created_us) AS last_us FROM plans")
def analytics_overview(t: Transit) -> DataFrame:
    return t.plans.agg(F.count(F.lit(1)).alias("plans"), F.count_distinct(F.expr("case when status = 'F' then plan_id end")).alias("finished"), F.round(F.avg("price"), 4).alias("mean_price"), F.min("created_us").alias("first_us"), F.max("created_us").alias("last_us"))


@query("SELECT transfers, count(*) AS options, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM options GROUP BY 1")
def transfer_distribution(t: Transit) -> DataFrame:
    counts = t.options.groupBy("transfers").agg(F.count(F.lit(1)).alias("options"))
    total = counts.agg(F.sum("options").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("transfers", "options", F.round(100.0 * F.col("options") / F.col("total"), 6).alias("percent"))


@query("SELECT route_id, count(*) AS uses FROM plans JOIN options USING (plan_id) WHERE created_us BETWEEN 800000000000000 AND 900000000000000 GROUP BY 1 ORDER BY uses DESC, route_id LIMIT 10")
def route_popularity_top(t: Transit) -> DataFrame:
    """The ten routes with most options in a time range."""
    chosen = t.plans.where("created_us between 800000000000000 and 900000000000000").select("plan_id")
    return t.options.join(chosen, "plan_id").groupBy("route_id").agg(F.count(F.lit(1)).alias("uses")).orderBy(F.desc("uses"), "route_id").limit(10)


@query("SELECT plan_id, created_us, status FROM plans WHERE created_us >= 900000000000000 ORDER BY created_us DESC, plan_id LIMIT 20")
def recent_plans(t: Transit) -> DataFrame:
    return t.plans.where("created_us >= 900000000000000").select("plan_id", "created_us", "status").orderBy(F.desc("created_us"), "plan_id").limit(20)


@query("SELECT plan_id, (SELECT count(*) FROM options o WHERE o.plan_id = p.plan_id) AS n_options, EXISTS (SELECT 1 FROM options o WHERE o.plan_id = p.plan_id AND transfers = 0) AS has_direct FROM plans p")
def search_success(t: Transit) -> DataFrame:
    """Correlated counts and EXISTS as one aggregation and a left join."""
    counts = t.options.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("transfers") == 0).alias("direct"))
    return t.plans.join(counts, "plan_id", "left").select("plan_id", F.coalesce("n", F.lit(0)).alias("n_options"), F.coalesce("direct", F.lit(False)).alias("has_direct"))


@query("SELECT stop_id, name, city_id FROM stops s WHERE NOT EXISTS (SELECT 1 FROM route_stops r WHERE r.stop_id = s.stop_id)")
def orphan_stops(t: Transit) -> DataFrame:
    return t.stops.join(t.route_stops, "stop_id", "left_anti").select("stop_id", "name", "city_id")


@query("""SELECT rs.route_id, r.number, rs.direction, rs.seq, rs.stop_id, s.name, s.is_major FROM route_stops rs JOIN stops s USING (stop_id) JOIN routes r USING (route_id) WHERE s.is_active""")
def route_stop_details(t: Transit) -> DataFrame:
    return t.route_stops.join(t.stops.where("is_active").select("stop_id", "name", "is_major"), "stop_id").join(F.broadcast(t.routes.select("route_id", "number")), "route_id").select("route_id", "number", "direction", "seq", "stop_id", "name", "is_major")


@query("""SELECT v.vehicle_id, v.plate, coalesce(r.number, 'none') AS number, coalesce(r.city_id, -1) AS city_id FROM vehicles v LEFT JOIN routes r USING (route_id)""")
def vehicle_route_lookup(t: Transit) -> DataFrame:
    """Vehicles with their route's number and city, and defaults where there is none."""
    dim = t.routes.select("route_id", "number", "city_id")
    return t.vehicles.join(F.broadcast(dim), "route_id", "left").select("vehicle_id", "plate", F.coalesce("number", F.lit("none")).alias("number"), F.coalesce("city_id", F.lit(-1)).alias("city_id"))


@query("SELECT a.route_id, a.direction, a.stop_id AS from_stop, b.stop_id AS to_stop, b.seq - a.seq AS apart FROM route_stops a JOIN route_stops b ON a.route_id = b.route_id AND a.direction = b.direction AND a.seq < b.seq AND a.stop_id <> b.stop_id")
def direct_routes(t: Transit) -> DataFrame:
    return v.ordered_pairs(t.route_stops).select("route_id", "direction", "from_stop", "to_stop", (F.col("to_seq") - F.col("from_seq")).alias("apart"))


@query("""SELECT stop_id, kind, term FROM stops, LATERAL (VALUES ('name', name), ('name_tm', name_tm), ('city', 'city ' || city_id)) x(kind, term) WHERE term IS NOT NULL""")
def unnest_terms(t: Transit) -> DataFrame:
    """A row for each name of a stop."""
    return t.stops.select("stop_id", F.expr("stack(3, 'name', name, 'name_tm', name_tm, 'city', concat('city ', city_id)) as (kind, term)")).where("term is not null")


@query("""SELECT city_id, status, verdicts, total FROM (SELECT city_id, CASE WHEN is_active THEN 'ACTIVE' ELSE 'INACTIVE' END AS status, count(*) AS verdicts, sum(count(*)) OVER (PARTITION BY city_id)::BIGINT AS total FROM stops GROUP BY 1, 2)""")
def status_counts(t: Transit) -> DataFrame:
    counts = t.stops.groupBy("city_id", F.expr("case when is_active then 'ACTIVE' else 'INACTIVE' end").alias("status")).agg(F.count(F.lit(1)).alias("verdicts"))
    return counts.withColumn("total", F.sum("verdicts").over(W.partitionBy("city_id")))


@query("""SELECT city_id, is_major, count(*) AS stops, grouping(city_id)::INT AS all_cities FROM stops GROUP BY ROLLUP (city_id, is_major)""")
def stops_rollup(t: Transit) -> DataFrame:
    return t.stops.rollup("city_id", "is_major").agg(F.count(F.lit(1)).alias("stops"), F.grouping("city_id").cast("int").alias("all_cities"))


@query("""SELECT is_active, in_motion, count(*) AS vehicles, round(avg(speed), 6) AS mean_speed FROM vehicles GROUP BY CUBE (is_active, in_motion)""")
def vehicles_cube(t: Transit) -> DataFrame:
    return t.vehicles.cube("is_active", "in_motion").agg(F.count(F.lit(1)).alias("vehicles"), F.round(F.avg("speed"), 6).alias("mean_speed"))


@query("""SELECT r.route_id, coalesce(v.vehicles, 0) AS vehicles, coalesce(v.in_motion, 0) AS in_motion, coalesce(v.recent, 0) AS recent, s.stops, s.forward, s.backward, s.major FROM routes r
LEFT JOIN (SELECT route_id, count(*) AS vehicles, count(*) FILTER (WHERE in_motion AND speed > 1) AS in_motion, count(*) FILTER (WHERE updated_us > 1704070800000000 - 300000000) AS recent FROM vehicles GROUP BY 1) v USING (route_id)
JOIN (SELECT route_id, count(*) AS stops, count(*) FILTER (WHERE direction = 0) AS forward, count(*) FILTER (WHERE direction = 1) AS backward, count(*) FILTER (WHERE is_major) AS major FROM route_stops JOIN stops USING (stop_id) GROUP BY 1) s USING (route_id)""")
def route_vehicle_and_stop_statistics(t: Transit) -> DataFrame:
    vehicles = t.vehicles.groupBy("route_id").agg(F.count(F.lit(1)).alias("vehicles"), F.count_if(F.expr("in_motion and speed > 1")).alias("in_motion"), F.count_if(F.expr("updated_us > 1704070800000000 - 300000000")).alias("recent"))
    stops = t.route_stops.join(t.stops.select("stop_id", "is_major"), "stop_id").groupBy("route_id").agg(F.count(F.lit(1)).alias("stops"), F.count_if(F.col("direction") == 0).alias("forward"), F.count_if(F.col("direction") == 1).alias("backward"), F.count_if("is_major").alias("major"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return t.routes.select("route_id").join(vehicles, "route_id", "left").join(stops, "route_id").select("route_id", zero("vehicles"), zero("in_motion"), zero("recent"), "stops", "forward", "backward", "major")


@query("""SELECT city_id, number, route_id FROM (SELECT *, row_number() OVER (PARTITION BY city_id, number ORDER BY is_active DESC, route_id) AS rn FROM (SELECT city_id, (route_id % 4)::VARCHAR AS number, route_id, is_active FROM routes)) WHERE rn = 1""")
def preferred_route(t: Transit) -> DataFrame:
    """One route for each number and city: active before inactive, then the smallest id."""
    keyed = t.routes.select("city_id", F.expr("cast(route_id % 4 as string)").alias("number"), "route_id", "is_active")
    return keyed.groupBy("city_id", "number").agg(F.min_by("route_id", F.struct(~F.col("is_active"), "route_id")).alias("route_id"))


@query("SELECT stop_id, name, (SELECT count(*) FROM stops WHERE is_active) AS total FROM stops WHERE is_active ORDER BY name DESC, stop_id LIMIT 10 OFFSET 20")
def page_of_stops(t: Transit) -> DataFrame:
    """A page and the number of all rows."""
    active = t.stops.where("is_active")
    total = active.agg(F.count(F.lit(1)).alias("total"))
    return active.select("stop_id", "name").orderBy(F.desc("name"), "stop_id").offset(20).limit(10).crossJoin(F.broadcast(total))


@query("SELECT EXISTS (SELECT 1 FROM stops WHERE stop_id = 7) AS found, (SELECT count(*) FROM stops) AS stops, (SELECT name FROM stops WHERE stop_id = 7) AS name")
def point_lookup(t: Transit) -> DataFrame:
    return t.stops.agg(F.bool_or(F.col("stop_id") == 7).alias("found"), F.count(F.lit(1)).alias("stops"), F.max(F.when(F.col("stop_id") == 7, F.col("name"))).alias("name"))


@query("SELECT provider, count(*) AS devices, array_to_string(list_sort(list(device_id)), ',') AS device_ids FROM vehicles WHERE is_active GROUP BY 1")
def provider_devices(t: Transit) -> DataFrame:
    """The devices to fetch from each provider."""
    return t.vehicles.where("is_active").groupBy("provider").agg(F.count(F.lit(1)).alias("devices"), F.array_join(F.array_sort(F.collect_list("device_id")), ",").alias("device_ids"))


@query(
    """SELECT (SELECT count(*) FROM polled) AS rows, (SELECT count(*) - count(DISTINCT device_id) FROM polled) AS repeats, (SELECT count(*) FROM (SELECT device_id FROM polled WHERE provider = 0 INTERSECT SELECT device_id FROM polled WHERE provider = 1)) AS in_both""",
    """polled AS (SELECT provider, device_id FROM vehicles UNION ALL SELECT 1, device_id FROM vehicles WHERE provider = 0 AND vehicle_id % 2 = 0)""",
)
def provider_overlap(t: Transit) -> DataFrame:
    """Rows of a poll, those beyond one a device, and devices that two providers have."""
    polled = t.vehicles.select("provider", "device_id").unionByName(t.vehicles.where("provider = 0 and vehicle_id % 2 = 0").select(F.lit(1).alias("provider"), "device_id"))
    by_device = polled.groupBy("device_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("provider") == 0).alias("a"), F.bool_or(F.col("provider") == 1).alias("b"))
    return by_device.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("repeats"), F.count_if(F.expr("a and b")).alias("in_both"))


@query("SELECT device_id FROM vehicles WHERE is_active INTERSECT SELECT device_id FROM vehicles WHERE in_motion")
def devices_in_both(t: Transit) -> DataFrame:
    return t.vehicles.where("is_active").select("device_id").intersect(t.vehicles.where("in_motion").select("device_id"))


@query("SELECT vehicle_id FROM vehicles WHERE route_id IS NOT NULL EXCEPT SELECT vehicle_id FROM vehicles WHERE is_active")
def assignments_to_clear(t: Transit) -> DataFrame:
    """Vehicles with a route, but for those to be kept."""
    return t.vehicles.where("route_id is not null").join(t.vehicles.where("is_active"), "vehicle_id", "left_anti").select("vehicle_id")
