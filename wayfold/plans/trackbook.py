"""Queries over vehicle tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayfold.functions import geo
from wayfold.operators import tracks as k
from wayfold.plans.book import Book
from wayfold.sources.transit import BASE_US, Transit, haversine_sql

book = Book()
query = book.query
LAG = f"""kin0 AS (SELECT *, lag(t_us) OVER w AS p_us, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon, lag(speed) OVER w AS p_speed FROM fixes WINDOW w AS (PARTITION BY vehicle_id ORDER BY t_us, fix_id)),
kin1 AS (SELECT *, floor((t_us - p_us) / 1000000)::BIGINT AS dt_s, {haversine_sql('p_lat', 'p_lon', 'lat', 'lon')} AS step_m FROM kin0),
kin AS (SELECT *, CASE WHEN dt_s > 0 THEN step_m / dt_s * 3.6 END AS kmh FROM kin1)"""


@query("SELECT fix_id, vehicle_id, dt_s, round(step_m, 3) AS step_m, round(kmh, 4) AS kmh FROM kin", LAG)
def track_kinematics(t: Transit) -> DataFrame:
    return k.kinematics(t.fixes).select("fix_id", "vehicle_id", "dt_s", F.round("step_m", 3).alias("step_m"), F.round("kmh", 4).alias("kmh"))


OUT_SQL = "CASE WHEN dt_s IS NULL THEN 'NO_HISTORY' WHEN dt_s < 3 THEN 'TIME_GAP_TOO_SMALL' WHEN step_m < 10 AND speed >= 10 THEN 'FROZEN' WHEN step_m < 10 THEN 'DISTANCE_TOO_SMALL' WHEN kmh > 150 THEN 'SPEED_EXCEEDED' ELSE 'VALID' END"


@query(f"SELECT fix_id, vehicle_id, {OUT_SQL} AS verdict FROM kin", LAG)
def gps_outliers(t: Transit) -> DataFrame:
    return k.outliers(t.fixes).select("fix_id", "vehicle_id", "verdict")


@query(
    "SELECT fix_id, vehicle_id, CASE WHEN dt_s IS NULL OR dt_s <= 0 THEN 'ACCEPT' WHEN dt_s < 2 AND step_m > 500 THEN 'HARD' WHEN step_m > dt_s * 22.0 * 1.5 THEN CASE WHEN step_m > 2000 THEN 'TELEPORT' ELSE 'SOFT' END ELSE 'ACCEPT' END AS decision FROM kin",
    LAG,
)
def gps_gate(t: Transit) -> DataFrame:
    return k.gate(t.fixes).select("fix_id", "vehicle_id", "decision")


@query(
    "SELECT vehicle_id, min(t_us) AS from_us, max(t_us) AS to_us, count(*) AS events, max(t_us) - min(t_us) >= 600000000 AS chronic FROM (SELECT *, sum(cut) OVER (PARTITION BY vehicle_id ORDER BY t_us, fix_id) AS n FROM (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY vehicle_id ORDER BY t_us, fix_id) > 300000000 THEN 1 ELSE 0 END AS cut FROM frozen)) GROUP BY vehicle_id, n",
    LAG + f", frozen AS (SELECT * FROM kin WHERE {OUT_SQL} IN ('FROZEN', 'DISTANCE_TOO_SMALL', 'TIME_GAP_TOO_SMALL'))",
)
def frozen_episodes(t: Transit) -> DataFrame:
    """Runs of fixes that hardly move, closed by 5 minutes without one; chronic from 10 minutes on."""
    w = k.ordered()
    frozen = k.outliers(t.fixes).where(F.col("verdict").isin("FROZEN", "DISTANCE_TOO_SMALL", "TIME_GAP_TOO_SMALL"))
    cut = F.coalesce(F.col("t_us") - F.lag("t_us").over(w) > 300_000_000, F.lit(False)).cast("int")
    runs = frozen.withColumn("_cut", cut).withColumn("n", F.sum("_cut").over(w))
    return runs.groupBy("vehicle_id", "n").agg(F.min("t_us").alias("from_us"), F.max("t_us").alias("to_us"), F.count(F.lit(1)).alias("events")).select("vehicle_id", "from_us", "to_us", "events", F.expr("to_us - from_us >= 600000000").alias("chronic"))


@query("SELECT fix_id, coalesce(abs(lat - p_lat) > 5e-5 OR abs(lon - p_lon) > 5e-5 OR abs(speed - p_speed) > 2, true) AS significant FROM kin", LAG)
def significant_changes(t: Transit) -> DataFrame:
    return k.significant_changes(t.fixes).select("fix_id", "significant")


@query("SELECT fix_id, vehicle_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY t_us DESC, fix_id DESC) AS rn FROM fixes) WHERE rn <= 10")
def newest_fixes(t: Transit) -> DataFrame:
    """The ten newest fixes of each vehicle."""
    w = W.partitionBy("vehicle_id").orderBy(F.desc("t_us"), F.desc("fix_id"))
    return t.fixes.withColumn("rn", F.row_number().over(w).cast("bigint")).where("rn <= 10").select("fix_id", "vehicle_id", "rn")


@query("SELECT fix_id, round(avg(speed) OVER (PARTITION BY vehicle_id ORDER BY t_us, fix_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS smoothed FROM fixes")
def moving_average_speed(t: Transit) -> DataFrame:
    return t.fixes.select("fix_id", F.round(F.avg("speed").over(k.ordered().rowsBetween(-4, 0)), 6).alias("smoothed"))


FOLD = "ranked AS (SELECT vehicle_id, speed, row_number() OVER (PARTITION BY vehicle_id ORDER BY t_us, fix_id) AS rn FROM fixes)"


@query(
    "SELECT vehicle_id, round(m, 6) AS mean, rn AS fixes FROM fold QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY rn DESC) = 1",
    FOLD + ", fold(vehicle_id, rn, m) AS (SELECT vehicle_id, rn, speed FROM ranked WHERE rn = 1 UNION ALL SELECT r.vehicle_id, r.rn, f.m + 0.05::DOUBLE * (r.speed - f.m) FROM fold f JOIN ranked r ON r.vehicle_id = f.vehicle_id AND r.rn = f.rn + 1)",
)
def long_term_speed(t: Transit) -> DataFrame:
    return k.exponential_mean(t.fixes, 0.05).select("vehicle_id", F.round("mean", 6).alias("mean"), F.col("fixes").cast("bigint").alias("fixes"))


@query(
    "SELECT vehicle_id, round(x, 6) AS speed, round(p, 6) AS variance FROM fold QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY rn DESC) = 1",
    FOLD + ", fold(vehicle_id, rn, x, p) AS (SELECT vehicle_id, rn, speed, 25.0::DOUBLE FROM ranked WHERE rn = 1 UNION ALL SELECT r.vehicle_id, r.rn, f.x + (f.p + 5) / (f.p + 9) * (r.speed - f.x), (1 - (f.p + 5) / (f.p + 9)) * (f.p + 5) FROM fold f JOIN ranked r ON r.vehicle_id = f.vehicle_id AND r.rn = f.rn + 1)",
)
def kalman_speed(t: Transit) -> DataFrame:
    return k.kalman_speed(t.fixes).select("vehicle_id", F.round("speed", 6).alias("speed"), F.round("variance", 6).alias("variance"))


EPISODES = """numbered AS (SELECT *, sum(cut) OVER (PARTITION BY vehicle_id ORDER BY t_us, fix_id)::BIGINT AS episode FROM (SELECT *, CASE WHEN t_us - p_us > 60000000 THEN 1 ELSE 0 END AS cut FROM kin)),
episodes AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY vehicle_id, episode) AS n FROM numbered) WHERE n >= 3)"""


@query("SELECT vehicle_id, episode, count(*) AS fixes, min(t_us) AS from_us, max(t_us) AS to_us FROM episodes GROUP BY 1, 2", LAG + ", " + EPISODES)
def episodes(t: Transit) -> DataFrame:
    return k.episodes(t.fixes, 60, 3).groupBy("vehicle_id", "episode").agg(F.count(F.lit(1)).alias("fixes"), F.min("t_us").alias("from_us"), F.max("t_us").alias("to_us"))


@query("SELECT fix_id, CASE WHEN speed < 20 THEN row_number() OVER (PARTITION BY vehicle_id, grp, speed < 20 ORDER BY t_us, fix_id) ELSE 0 END AS streak FROM (SELECT *, sum(CASE WHEN speed < 20 THEN 0 ELSE 1 END) OVER (PARTITION BY vehicle_id ORDER BY t_us, fix_id) AS grp FROM fixes)")
def slow_streaks(t: Transit) -> DataFrame:
    return k.streaks(t.fixes, F.col("speed") < 20).select("fix_id", "streak")


@query(
    "SELECT vehicle_id, episode, round(max(step), 3) AS most_step, round(avg(step), 3) AS mean_step, round(list_sort(list(step))[floor(0.95 * (count(step) - 1))::INT + 1], 3) AS p95_step, count(*) FILTER (WHERE step > 1500) AS teleports, count(*) FILTER (WHERE event_type <> p_type) AS changes FROM (SELECT *, CASE WHEN rn > 1 THEN step_m END AS step, CASE WHEN rn > 1 THEN p_type0 END AS p_type FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, episode ORDER BY t_us, fix_id) AS rn, lag(event_type) OVER (PARTITION BY vehicle_id, episode ORDER BY t_us, fix_id) AS p_type0 FROM episodes)) GROUP BY 1, 2",
    LAG + ", " + EPISODES,
)
def position_metrics(t: Transit) -> DataFrame:
    """Steps within each episode: the largest, the mean, the 95th percentile by lower nearest rank; jumps and changes of mode."""
    w = W.partitionBy("vehicle_id", "episode").orderBy("t_us", "fix_id")
    e = k.episodes(t.fixes, 60, 3).withColumn("step", geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))).withColumn("before", F.lag("event_type").over(w))
    return e.groupBy("vehicle_id", "episode").agg(F.round(F.max("step"), 3).alias("most_step"), F.round(F.avg("step"), 3).alias("mean_step"), F.round(k.exact_percentile(F.col("step"), 0.95), 3).alias("p95_step"), F.count_if(F.col("step") > 1500).alias("teleports"), F.count_if(F.col("event_type") != F.col("before")).alias("changes"))


@query(
    "SELECT vehicle_id, count(*) FILTER (WHERE step_m / (greatest(dt_s, 1) * 22.0) > 1.5 AND event_type <> 'signup') AS flights, count(*) FILTER (WHERE step_m / (greatest(dt_s, 1) * 22.0) > 1.5 AND event_type = 'signup') AS sanctioned, round(max(step_m / (greatest(dt_s, 1) * 22.0)), 6) AS worst FROM kin WHERE dt_s IS NOT NULL GROUP BY 1",
    LAG,
)
def marker_flight(t: Transit) -> DataFrame:
    """Steps beyond one and a half times what the top speed allows, and those at sanctioned moments."""
    e = k.kinematics(t.fixes).where("dt_s is not null").withColumn("share", F.expr("step_m / (greatest(dt_s, 1) * 22.0D)"))
    return e.groupBy("vehicle_id").agg(F.count_if(F.expr("share > 1.5 and event_type <> 'signup'")).alias("flights"), F.count_if(F.expr("share > 1.5 and event_type = 'signup'")).alias("sanctioned"), F.round(F.max("share"), 6).alias("worst"))


@query("SELECT vehicle_id, round(sum(step_m), 2) AS path_m, round(min(step_m), 3) AS least_m, round(max(step_m), 3) AS most_m, round(avg(step_m), 3) AS mean_m FROM kin GROUP BY 1", LAG)
def path_lengths(t: Transit) -> DataFrame:
    return k.kinematics(t.fixes).groupBy("vehicle_id").agg(F.round(F.sum("step_m"), 2).alias("path_m"), F.round(F.min("step_m"), 3).alias("least_m"), F.round(F.max("step_m"), 3).alias("most_m"), F.round(F.avg("step_m"), 3).alias("mean_m"))


@query("SELECT fix_id, round(sum(step_m) OVER (PARTITION BY vehicle_id ORDER BY t_us, fix_id ROWS UNBOUNDED PRECEDING), 2) AS travelled_m FROM kin", LAG)
def cumulative_distance(t: Transit) -> DataFrame:
    return k.kinematics(t.fixes).select("fix_id", F.round(F.sum("step_m").over(k.ordered().rowsBetween(W.unboundedPreceding, 0)), 2).alias("travelled_m"))


@query(
    f"""SELECT vehicle_id, stop_id, min(t_us) AS arrived_us, count(*) AS fixes FROM fixes f JOIN (SELECT stop_id, route_id, direction, lat AS s_lat, lon AS s_lon FROM placed_stops) s USING (route_id, direction) WHERE speed < 20 AND {haversine_sql('lat', 'lon', 's_lat', 's_lon')} <= 400 GROUP BY 1, 2"""
)
def stop_arrivals(t: Transit) -> DataFrame:
    """The first slow fix near each stop of the vehicle's route."""
    s = t.placed_stops.select("stop_id", "route_id", "direction", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    met = t.fixes.where("speed < 20").join(s, ["route_id", "direction"]).where(geo.haversine(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon")) <= 400)
    return met.groupBy("vehicle_id", "stop_id").agg(F.min("t_us").alias("arrived_us"), F.count(F.lit(1)).alias("fixes"))


@query("SELECT vehicle_id, t_us // 500000 AS tick, arg_max(fix_id, (t_us, fix_id)) AS fix_id, max(t_us) AS t_us FROM fixes GROUP BY 1, 2")
def latest_per_vehicle(t: Transit) -> DataFrame:
    """The last fix of each vehicle in each half second."""
    return k.latest_per_window(t.fixes, 500_000).select("vehicle_id", "tick", "fix_id", "t_us")


@query(
    "SELECT fix_id, vehicle_id FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, t_us // 1000000 ORDER BY t_us, fix_id) AS rn FROM both_feeds) WHERE rn = 1",
    "both_feeds AS (SELECT fix_id, vehicle_id, t_us FROM fixes UNION ALL SELECT fix_id + 1000000000, vehicle_id, t_us + 1 FROM fixes WHERE fix_id % 3 = 0)",
)
def deduplicated_feeds(t: Transit) -> DataFrame:
    """The first of the fixes that two feeds have of one vehicle and second."""
    both = t.fixes.select("fix_id", "vehicle_id", "t_us").unionByName(t.fixes.where("fix_id % 3 = 0").selectExpr("fix_id + 1000000000 as fix_id", "vehicle_id", "t_us + 1 as t_us"))
    return both.groupBy("vehicle_id", F.expr("t_us div 1000000").alias("s")).agg(F.min_by("fix_id", F.struct("t_us", "fix_id")).alias("fix_id")).select("fix_id", "vehicle_id")


@query(
    f"""SELECT fix_id, vehicle_id, q, conf FROM (SELECT *, lag(q) OVER w AS pq, lag(conf) OVER w AS pc, lag(t_us) OVER w AS pt FROM (SELECT *, round(lat::DECIMAL(20,10), 3)::DOUBLE AS q, round((1.0 / (1.0 + speed / 25))::DECIMAL(20,10), 1)::DOUBLE AS conf FROM fixes) WINDOW w AS (PARTITION BY vehicle_id ORDER BY t_us, fix_id)) WHERE pq IS NULL OR q <> pq OR conf <> pc OR t_us - pt >= 5000000"""
)
def change_suppressed(t: Transit) -> DataFrame:
    """Fixes whose rounded place or confidence changed, or after 5 s without one."""
    w = k.ordered()
    r = lambda e, n: F.round(F.expr(e).cast("decimal(20,10)"), n).cast("double")
    e = t.fixes.withColumn("q", r("lat", 3)).withColumn("conf", r("1.0D / (1.0D + speed / 25)", 1))
    e = e.withColumn("pq", F.lag("q").over(w)).withColumn("pc", F.lag("conf").over(w)).withColumn("pt", F.lag("t_us").over(w))
    return e.where("pq is null or q <> pq or conf <> pc or t_us - pt >= 5000000").select("fix_id", "vehicle_id", "q", "conf")


@query(f"SELECT route_id, ({BASE_US} + (t_us - {BASE_US}) // 600000000 * 600000000) AS window_us, count(*) AS fixes, count(DISTINCT vehicle_id) AS vehicles, round(avg(speed), 9) AS mean_speed FROM fixes GROUP BY 1, 2")
def tumbling_route_windows(t: Transit) -> DataFrame:
    w = F.window(F.timestamp_micros("t_us"), "10 minutes")
    return t.fixes.groupBy("route_id", w.alias("w")).agg(F.count(F.lit(1)).alias("fixes"), F.count_distinct("vehicle_id").alias("vehicles"), F.round(F.avg("speed"), 9).alias("mean_speed")).select("route_id", F.unix_micros("w.start").alias("window_us"), "fixes", "vehicles", "mean_speed")


@query(f"SELECT start_us AS window_us, count(*) AS fixes FROM (SELECT (t_us // 600000000 - k) * 600000000 AS start_us FROM fixes, range(6) r(k)) GROUP BY 1")
def sliding_windows(t: Transit) -> DataFrame:
    w = F.window(F.timestamp_micros("t_us"), "60 minutes", "10 minutes")
    return t.fixes.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("fixes")).select(F.unix_micros("w.start").alias("window_us"), "fixes")


@query(
    """SELECT vehicle_id, min(t_us) AS from_us, max(t_us) + 30000000 AS to_us, count(*) AS fixes FROM (SELECT *, sum(cut) OVER (PARTITION BY vehicle_id ORDER BY t_us, fix_id) AS n FROM (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY vehicle_id ORDER BY t_us, fix_id) >= 30000000 THEN 1 ELSE 0 END AS cut FROM fixes)) GROUP BY vehicle_id, n"""
)
def vehicle_sessions(t: Transit) -> DataFrame:
    w = F.session_window(F.timestamp_micros("t_us"), "30 seconds")
    return t.fixes.groupBy("vehicle_id", w.alias("w")).agg(F.count(F.lit(1)).alias("fixes")).select("vehicle_id", F.unix_micros("w.start").alias("from_us"), F.unix_micros("w.end").alias("to_us"), "fixes")


@query("SELECT v.vehicle_id, v.route_id FROM vehicles v WHERE v.is_active AND NOT EXISTS (SELECT 1 FROM fixes f WHERE f.vehicle_id = v.vehicle_id AND f.t_us > (SELECT max(t_us) FROM fixes) - 900000000)")
def silent_vehicles(t: Transit) -> DataFrame:
    last = t.fixes.agg((F.max("t_us") - 900_000_000).alias("since"))
    heard = t.fixes.crossJoin(F.broadcast(last)).where("t_us > since").select("vehicle_id").distinct()
    return t.vehicles.where("is_active").join(heard, "vehicle_id", "left_anti").select("vehicle_id", "route_id")


@query(
    """SELECT provider, tick, polls, failures, polls < 0.5 * base AND base >= 10 AS dropped, failures * 100 >= 95 * polls AS stale FROM (SELECT *, avg(polls) OVER (PARTITION BY provider ORDER BY tick ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS base FROM (SELECT vehicle_id % 3 AS provider, t_us // 300000000 AS tick, count(*) AS polls, count(*) FILTER (WHERE event_type = 'error') AS failures FROM fixes GROUP BY 1, 2))"""
)
def provider_health(t: Transit) -> DataFrame:
    """Providers by 5 minutes: whether rows fell below half of the recent mean, or nearly all are errors."""
    counts = t.fixes.groupBy(F.expr("vehicle_id % 3").alias("provider"), F.expr("t_us div 300000000").alias("tick")).agg(F.count(F.lit(1)).alias("polls"), F.count_if(F.col("event_type") == "error").alias("failures"))
    base = F.avg("polls").over(W.partitionBy("provider").orderBy("tick").rowsBetween(-6, -1))
    return counts.withColumn("base", base).select("provider", "tick", "polls", "failures", F.expr("polls < 0.5D * base and base >= 10").alias("dropped"), F.expr("failures * 100 >= 95 * polls").alias("stale"))


@query()
def gps_validate(t: Transit) -> DataFrame:
    """Verdicts against the last accepted fix, in order of arrival: a fold that SQL windows cannot express."""
    arriving = t.fixes.withColumn("wall_us", F.expr("t_us + (fix_id * 13 % 50 - 45) * 1000000")).withColumn("t_us", F.expr("t_us - fix_id % 4 * 20000000")).withColumn("lat", F.expr("case when fix_id % 10 < 3 then 37.9D else lat end")).withColumn("lon", F.expr("case when fix_id % 10 < 3 then 58.3D else lon end"))
    return k.validate(arriving)
