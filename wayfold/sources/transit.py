"""Transit-shaped tables over the driver's star schema, by integer rules that Spark and DuckDB share."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.sources.tables import table

#: Stops of a route and direction; the start of the events, in microseconds; the time of a "now" for recency.
ROUTE_STOPS, BASE_US, NOW_US = 12, 1_704_067_200_000_000, 1_704_070_800_000_000


def _place(key: str, salt_lat: int = 7919, salt_lon: int = 104729) -> tuple[str, str]:
    return f"37.90D + ((({key}) * {salt_lat}) % 1000) / 10000.0D", f"58.30D + ((({key}) * {salt_lon}) % 1500) / 10000.0D"


class Transit:
    """The tables of a network, its vehicles and its users, each read when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def stops(self) -> DataFrame:
        lat, lon = _place("s_suppkey")
        return self.raw("supplier").selectExpr(
            "s_suppkey as stop_id", "s_name as name", "case when s_suppkey % 3 <> 0 then concat('Duralga ', s_suppkey) end as name_tm", f"{lat} as lat", f"{lon} as lon", "cast(s_nationkey % 5 as int) as city_id", "s_acctbal > 0 as is_active", "s_suppkey % 7 = 0 as is_major"
        )

    @cached_property
    def routes(self) -> DataFrame:
        return self.raw("nation").selectExpr(
            "cast(n_nationkey as bigint) as route_id", "cast(n_nationkey + 1 as string) as number", "n_name as name", "n_regionkey as city_id", "n_nationkey % 7 <> 0 as is_active", "case when n_nationkey % 11 <> 0 then 30 + (n_nationkey % 5) * 10 end as duration_min", "case when n_nationkey % 4 <> 0 then concat('#', lpad(cast(n_nationkey * 4711 % 10000 as string), 6, '0')) end as color", "case when n_nationkey % 6 <> 0 then 5000.0D + n_nationkey * 400 end as distance_m"
        )

    @cached_property
    def route_stops(self) -> DataFrame:
        size = self.raw("supplier").agg(F.count(F.lit(1)).alias("n_stops"))
        return self.raw("nation").crossJoin(F.broadcast(size)).selectExpr("n_nationkey", "n_stops", f"explode(sequence(0, {ROUTE_STOPS - 1})) as k").selectExpr("*", "explode(array(0, 1)) as direction").selectExpr(
            "cast(n_nationkey as bigint) as route_id", "cast((n_nationkey * 13 + k * 7) % n_stops as bigint) as stop_id", "direction", f"case when direction = 0 then k + 1 else {ROUTE_STOPS} - k end as seq"
        )

    @cached_property
    def placed_stops(self) -> DataFrame:
        """route_stops with the place of each stop."""
        return self.route_stops.join(self.stops.select("stop_id", "lat", "lon"), "stop_id").select("route_id", "direction", "seq", "stop_id", "lat", "lon")

    @cached_property
    def vehicles(self) -> DataFrame:
        lat, lon = _place("c_custkey", 6151, 86028)
        return self.raw("customer").selectExpr(
            "c_custkey as vehicle_id", "concat('dev-', c_custkey) as device_id", "cast(c_custkey % 3 as int) as provider", "case when c_custkey % 17 = 0 then concat(c_custkey % 1000, ' agh') else concat(lpad(cast(c_custkey % 10000 as string), 4, '0'), ' AGH') end as plate", "case when c_custkey % 13 <> 0 then cast(c_nationkey as bigint) end as route_id", "c_acctbal > 0 as is_active", "c_mktsegment in ('MACHINERY', 'BUILDING') as in_motion", "(c_custkey * 37 % 2100) / 10.0D as speed",
            f"case when c_custkey % 29 <> 0 then {lat} end as lat", f"case when c_custkey % 29 <> 0 then {lon} end as lon", "cast(c_custkey % 2 as int) as direction", f"case when c_custkey % 19 <> 0 then {NOW_US} - (c_custkey * 97 % 1800) * 1000000 end as updated_us", "c_custkey % 23 = 0 as in_garage", "cast(c_custkey * 53 % 360 as double) as course",
        )

    @cached_property
    def fixes(self) -> DataFrame:
        return self.raw("events").selectExpr("event_id", "user_id", "event_type", "value", "unix_micros(cast(ts as timestamp)) as us").selectExpr(
            "event_id as fix_id", "user_id as vehicle_id", f"{BASE_US} + (us - {BASE_US}) div 1000 as t_us", "value % 80 as speed", "event_type", "event_type <> 'error' as in_motion", "cast(user_id % 25 as bigint) as route_id", "cast(user_id % 2 as int) as direction",
            "37.90D + ((user_id * 7919) % 1000) / 10000.0D + case when event_id % 10 = 0 then 0.0D else ((event_id * 31) % 41 - 20) / 20000.0D end as lat", "58.30D + ((user_id * 104729) % 1500) / 10000.0D + case when event_id % 10 = 0 then 0.0D else ((event_id * 17) % 41 - 20) / 20000.0D end as lon",
            "case when event_id % 8 <> 0 then (event_id * 7 % 80) / 10.0D end as hdop", "case when event_id % 9 <> 0 then cast(event_id % 12 as int) end as satellites", "us % 90000000 as lag_us",
        )

    @cached_property
    def runs(self) -> DataFrame:
        """The fixes again, placed along their vehicle's line: two at a stop, two on the way to the next; trips change direction."""
        w = Window.partitionBy("vehicle_id").orderBy("t_us", "fix_id")
        f = self.fixes.select("fix_id", "vehicle_id", "t_us", "route_id", (F.row_number().over(w) - 1).cast("bigint").alias("n")).selectExpr(
            "*", f"n div {4 * (ROUTE_STOPS - 1)} as trip", f"cast(n div 4 % {ROUTE_STOPS - 1} as int) + 1 as seq", "n % 4 as phase"
        ).selectExpr("*", "cast((vehicle_id + trip) % 2 as int) as direction")
        a = self.placed_stops.selectExpr("route_id", "direction", "seq", "lat as a_lat", "lon as a_lon")
        b = self.placed_stops.selectExpr("route_id", "direction", "seq - 1 as seq", "lat as b_lat", "lon as b_lon")
        met = f.join(a, ["route_id", "direction", "seq"]).join(b, ["route_id", "direction", "seq"]).withColumn("share", F.expr("case phase when 2 then 1.0D / 3 when 3 then 2.0D / 3 else 0.0D end"))
        return met.selectExpr(
            "fix_id", "vehicle_id", "trip", "n", "t_us", "route_id", "direction", "case when phase < 2 then (fix_id % 5) * 0.9D else 20.0D + fix_id % 40 end as speed",
            "a_lat + (b_lat - a_lat) * share + ((fix_id * 31) % 41 - 20) / 200000.0D as lat", "a_lon + (b_lon - a_lon) * share + ((fix_id * 17) % 41 - 20) / 200000.0D as lon",
        )

    @cached_property
    def plans(self) -> DataFrame:
        a, b = _place("o_custkey")
        c, d = _place("o_orderkey", 6151, 86028)
        return self.raw("orders").selectExpr("o_orderkey as plan_id", f"{a} as o_lat", f"{b} as o_lon", f"{c} as d_lat", f"{d} as d_lon", "unix_micros(cast(o_orderdate as timestamp)) + (o_orderkey % 1440) * 60000000 as created_us", "o_orderstatus as status", "o_totalprice as price")

    @cached_property
    def options(self) -> DataFrame:
        return self.raw("lineitem").selectExpr("l_orderkey as plan_id", "l_linenumber as option_no", "cast(l_quantity as int) as minutes", "l_linenumber % 3 as transfers", "cast(l_partkey % 20 as int) as walk_min", "1 - l_discount as reliability", "l_suppkey % 25 as route_id", "l_partkey as item")

    @cached_property
    def garages(self) -> DataFrame:
        lat, lon = _place("r_regionkey * 137 + 11")
        return self.raw("region").selectExpr("r_regionkey as garage_id", f"{lat} as lat", f"{lon} as lon", "2000.0D + r_regionkey * 500 as radius").selectExpr(
            "*", "case when garage_id % 2 = 0 then array(struct(lat - 0.02D as lat, lon - 0.03D as lon), struct(lat - 0.02D as lat, lon + 0.03D as lon), struct(lat + 0.01D as lat, lon + 0.02D as lon), struct(lat + 0.03D as lat, lon - 0.01D as lon), struct(lat - 0.02D as lat, lon - 0.03D as lon)) end as boundary"
        )

    @cached_property
    def places(self) -> DataFrame:
        lat, lon = _place("p_partkey", 3571, 5003)
        return self.raw("part").selectExpr("p_partkey as place_id", "concat(p_name, ' ', p_partkey % 40) as name", "p_type as category", "p_size % 5 as city_id", f"{lat} as lat", f"{lon} as lon", "p_brand as alias", "p_partkey % 6 <> 0 as is_active")


#: The same tables as DuckDB common table expressions.
SQL_TABLES = f"""
stops AS (SELECT s_suppkey AS stop_id, s_name AS name, CASE WHEN s_suppkey % 3 <> 0 THEN 'Duralga ' || s_suppkey END AS name_tm, 37.90::DOUBLE + ((s_suppkey * 7919) % 1000) / 10000.0::DOUBLE AS lat, 58.30::DOUBLE + ((s_suppkey * 104729) % 1500) / 10000.0::DOUBLE AS lon, (s_nationkey % 5)::INT AS city_id, s_acctbal > 0 AS is_active, s_suppkey % 7 = 0 AS is_major FROM supplier),
routes AS (SELECT n_nationkey::BIGINT AS route_id, (n_nationkey + 1)::VARCHAR AS number, n_name AS name, n_regionkey AS city_id, n_nationkey % 7 <> 0 AS is_active, CASE WHEN n_nationkey % 11 <> 0 THEN 30 + (n_nationkey % 5) * 10 END AS duration_min, CASE WHEN n_nationkey % 4 <> 0 THEN '#' || lpad((n_nationkey * 4711 % 10000)::VARCHAR, 6, '0') END AS color, CASE WHEN n_nationkey % 6 <> 0 THEN 5000.0::DOUBLE + n_nationkey * 400 END AS distance_m FROM nation),
route_stops AS (SELECT n_nationkey::BIGINT AS route_id, ((n_nationkey * 13 + k * 7) % n_stops)::BIGINT AS stop_id, d::INT AS direction, (CASE WHEN d = 0 THEN k + 1 ELSE {ROUTE_STOPS} - k END)::INT AS seq FROM nation, (SELECT count(*) AS n_stops FROM supplier), range({ROUTE_STOPS}) a(k), range(2) b(d)),
placed_stops AS (SELECT route_id, direction, seq, stop_id, lat, lon FROM route_stops JOIN stops USING (stop_id)),
vehicles AS (SELECT c_custkey AS vehicle_id, 'dev-' || c_custkey AS device_id, (c_custkey % 3)::INT AS provider, CASE WHEN c_custkey % 17 = 0 THEN (c_custkey % 1000) || ' agh' ELSE lpad((c_custkey % 10000)::VARCHAR, 4, '0') || ' AGH' END AS plate, CASE WHEN c_custkey % 13 <> 0 THEN c_nationkey::BIGINT END AS route_id, c_acctbal > 0 AS is_active, c_mktsegment IN ('MACHINERY', 'BUILDING') AS in_motion, (c_custkey * 37 % 2100) / 10.0::DOUBLE AS speed,
  CASE WHEN c_custkey % 29 <> 0 THEN 37.90::DOUBLE + ((c_custkey * 6151) % 1000) / 10000.0::DOUBLE END AS lat, CASE WHEN c_custkey % 29 <> 0 THEN 58.30::DOUBLE + ((c_custkey * 86028) % 1500) / 10000.0::DOUBLE END AS lon, (c_custkey % 2)::INT AS direction, CASE WHEN c_custkey % 19 <> 0 THEN {NOW_US} - (c_custkey * 97 % 1800) * 1000000 END AS updated_us, c_custkey % 23 = 0 AS in_garage, (c_custkey * 53 % 360)::DOUBLE AS course FROM customer),
fixes AS (SELECT event_id AS fix_id, user_id AS vehicle_id, {BASE_US} + (epoch_us(ts) - {BASE_US}) // 1000 AS t_us, value % 80 AS speed, event_type, event_type <> 'error' AS in_motion, (user_id % 25)::BIGINT AS route_id, (user_id % 2)::INT AS direction,
  37.90::DOUBLE + ((user_id * 7919) % 1000) / 10000.0::DOUBLE + CASE WHEN event_id % 10 = 0 THEN 0.0::DOUBLE ELSE ((event_id * 31) % 41 - 20) / 20000.0::DOUBLE END AS lat, 58.30::DOUBLE + ((user_id * 104729) % 1500) / 10000.0::DOUBLE + CASE WHEN event_id % 10 = 0 THEN 0.0::DOUBLE ELSE ((event_id * 17) % 41 - 20) / 20000.0::DOUBLE END AS lon,
  CASE WHEN event_id % 8 <> 0 THEN (event_id * 7 % 80) / 10.0::DOUBLE END AS hdop, CASE WHEN event_id % 9 <> 0 THEN (event_id % 12)::INT END AS satellites, epoch_us(ts) % 90000000 AS lag_us FROM events),
runs AS (SELECT fix_id, vehicle_id, trip, n, t_us, f.route_id, f.direction, CASE WHEN phase < 2 THEN (fix_id % 5) * 0.9::DOUBLE ELSE 20.0::DOUBLE + fix_id % 40 END AS speed,
  a.lat + (b.lat - a.lat) * share + ((fix_id * 31) % 41 - 20) / 200000.0::DOUBLE AS lat, a.lon + (b.lon - a.lon) * share + ((fix_id * 17) % 41 - 20) / 200000.0::DOUBLE AS lon
  FROM (SELECT *, CASE phase WHEN 2 THEN 1.0::DOUBLE / 3 WHEN 3 THEN 2.0::DOUBLE / 3 ELSE 0.0::DOUBLE END AS share, ((vehicle_id + trip) % 2)::INT AS direction FROM (SELECT fix_id, vehicle_id, t_us, route_id, n, n // {4 * (ROUTE_STOPS - 1)} AS trip, (n // 4 % {ROUTE_STOPS - 1})::INT + 1 AS seq, n % 4 AS phase FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY t_us, fix_id) - 1 AS n FROM fixes))) f
  JOIN placed_stops a ON a.route_id = f.route_id AND a.direction = f.direction AND a.seq = f.seq JOIN placed_stops b ON b.route_id = f.route_id AND b.direction = f.direction AND b.seq = f.seq + 1),
plans AS (SELECT o_orderkey AS plan_id, 37.90::DOUBLE + ((o_custkey * 7919) % 1000) / 10000.0::DOUBLE AS o_lat, 58.30::DOUBLE + ((o_custkey * 104729) % 1500) / 10000.0::DOUBLE AS o_lon, 37.90::DOUBLE + ((o_orderkey * 6151) % 1000) / 10000.0::DOUBLE AS d_lat, 58.30::DOUBLE + ((o_orderkey * 86028) % 1500) / 10000.0::DOUBLE AS d_lon, epoch_us(o_orderdate) + (o_orderkey % 1440) * 60000000 AS created_us, o_orderstatus AS status, o_totalprice AS price FROM orders),
options AS (SELECT l_orderkey AS plan_id, l_linenumber AS option_no, l_quantity::INT AS minutes, l_linenumber % 3 AS transfers, (l_partkey % 20)::INT AS walk_min, 1 - l_discount AS reliability, l_suppkey % 25 AS route_id, l_partkey AS item FROM lineitem),
garages0 AS (SELECT r_regionkey AS garage_id, 37.90::DOUBLE + (((r_regionkey * 137 + 11) * 7919) % 1000) / 10000.0::DOUBLE AS lat, 58.30::DOUBLE + (((r_regionkey * 137 + 11) * 104729) % 1500) / 10000.0::DOUBLE AS lon, 2000.0::DOUBLE + r_regionkey * 500 AS radius FROM region),
garages AS (SELECT *, CASE WHEN garage_id % 2 = 0 THEN [{{'lat': lat - 0.02::DOUBLE, 'lon': lon - 0.03::DOUBLE}}, {{'lat': lat - 0.02::DOUBLE, 'lon': lon + 0.03::DOUBLE}}, {{'lat': lat + 0.01::DOUBLE, 'lon': lon + 0.02::DOUBLE}}, {{'lat': lat + 0.03::DOUBLE, 'lon': lon - 0.01::DOUBLE}}, {{'lat': lat - 0.02::DOUBLE, 'lon': lon - 0.03::DOUBLE}}] END AS boundary FROM garages0),
places AS (SELECT p_partkey AS place_id, p_name || ' ' || (p_partkey % 40) AS name, p_type AS category, p_size % 5 AS city_id, 37.90::DOUBLE + ((p_partkey * 3571) % 1000) / 10000.0::DOUBLE AS lat, 58.30::DOUBLE + ((p_partkey * 5003) % 1500) / 10000.0::DOUBLE AS lon, p_brand AS alias, p_partkey % 6 <> 0 AS is_active FROM part)"""


def sql(query: str, more: str = "") -> str:
    """query (and further tables) over the tables above."""
    return f"WITH RECURSIVE {SQL_TABLES.strip()}{', ' + more.strip() if more else ''}\n{query.strip()}"


def haversine_sql(a: str, b: str, c: str, d: str) -> str:
    """Metres between two places as a DuckDB expression."""
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(2 * 6371000.0 * atan2(sqrt({h}), sqrt(1 - {h})))"
