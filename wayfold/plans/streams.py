"""Queries that run as streams over all events there are; most have the same answer as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayfold.operators import hypotheses, motion
from wayfold.operators import joins as j
from wayfold.operators import map_matching as mm
from wayfold.plans.book import Book
from wayfold.plans.trackbook import LAG, OUT_SQL
from wayfold.sources.transit import BASE_US, Transit
from wayfold.streaming import fixes as st
from wayfold.streaming import positions

book = Book()
query = book.query


def _events(t: Transit) -> DataFrame:
    return st.event_stream(t.spark, f"{t.sf_dir.rstrip('/')}/events.parquet")


def _fixes(t: Transit) -> DataFrame:
    """The events as fixes, like Transit.fixes."""
    return _events(t).select(
        F.col("event_id").alias("fix_id"), F.col("user_id").alias("vehicle_id"), F.expr(f"{BASE_US} + (unix_micros(at) - {BASE_US}) div 1000").alias("t_us"),
        F.expr("37.90D + ((user_id * 7919) % 1000) / 10000.0D + case when event_id % 10 = 0 then 0.0D else ((event_id * 31) % 41 - 20) / 20000.0D end").alias("lat"),
        F.expr("58.30D + ((user_id * 104729) % 1500) / 10000.0D + case when event_id % 10 = 0 then 0.0D else ((event_id * 17) % 41 - 20) / 20000.0D end").alias("lon"), F.expr("value % 80").alias("speed"), "at",
        F.expr("case when event_id % 8 <> 0 then (event_id * 7 % 80) / 10.0D end").alias("hdop"),
    )


@query("SELECT event_type, from_us, n, round(total, 4) AS total FROM (SELECT event_type, epoch_us(ts) // 3600000000 * 3600000000 AS from_us, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2)")
def stream_hourly_windows(t: Transit) -> DataFrame:
    """Hourly counts by type; complete mode, as the last windows have to be there."""
    w = F.window("at", "1 hour")
    counts = _events(t).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    done = st.run_available(counts.select("event_type", F.unix_micros("w.start").alias("from_us"), "n", "total"), "complete", "hourly")
    return done.select("event_type", "from_us", "n", F.round("total", 4).alias("total"))


@query("SELECT event_id, user_id FROM events")
def stream_deduplicated(t: Transit) -> DataFrame:
    """Events that come twice, by two feeds, once."""
    twice = _events(t).withColumn("feed", F.explode(F.array(F.lit("a"), F.lit("b"))))
    return st.run_available(st.deduplicated(twice, ["event_id"]).select("event_id", "user_id"), "append", "dedup")


@query(f"SELECT fix_id, vehicle_id, {OUT_SQL} AS verdict FROM kin", LAG)
def stream_outliers(t: Transit) -> DataFrame:
    """Outlier verdicts with the last fix of each vehicle as state."""
    return st.run_available(st.stateful_outliers(_fixes(t)), "append", "outliers", idle_batches=False)


@query("SELECT user_id, arg_max(event_id, (epoch_us(ts), event_id)) AS event_id, max(epoch_us(ts)) AS at_us FROM events GROUP BY 1")
def stream_latest(t: Transit) -> DataFrame:
    """The newest event of each user, by a stream's complete aggregation."""
    best = _events(t).groupBy("user_id").agg(F.max(F.struct(F.unix_micros("at").alias("at_us"), "event_id")).alias("b"))
    return st.run_available(best.select("user_id", "b.event_id", "b.at_us"), "complete", "latest")


@query()
def motion_filter(t: Transit) -> DataFrame:
    """Filtered positions of all vehicles: a fold over each track."""
    return motion.filter_tracks(t.fixes, t.placed_stops)


def turning(t: Transit) -> DataFrame:
    """The fixes once more, 12 s and 150 m apart along the vehicle's line, which turns round before its end; `driven` is the direction."""
    n = (F.row_number().over(W.partitionBy("vehicle_id").orderBy("t_us", "fix_id")) - 1).cast("bigint")
    f = t.fixes.select("fix_id", "vehicle_id", "route_id", n.alias("n"), F.expr("24 + vehicle_id % 8").alias("turn")).withColumn("phase", F.expr("n % (2 * turn)"))
    f = f.selectExpr("*", f"{BASE_US} + n * 12000000 as t_us", "(turn - abs(phase - turn)) * 150.0D as along_m", "cast(phase >= turn as int) as driven")
    ends = j.segments(t.placed_stops).where("direction = 0 and length_m > 0").withColumn("last", F.max("segment").over(W.partitionBy("route_id")))
    met = f.join(ends, "route_id").where("along_m >= start_m and (along_m < start_m + length_m or segment = last)").withColumn("share", F.expr("least((along_m - start_m) / length_m, 1)"))
    return met.selectExpr(
        "fix_id", "vehicle_id", "route_id", "t_us", "driven", "a_lat + (b_lat - a_lat) * share + ((fix_id * 31) % 41 - 20) / 400000.0D as lat", "a_lon + (b_lon - a_lon) * share + ((fix_id * 17) % 41 - 20) / 400000.0D as lon", "45.0D as speed", "cast(null as double) as hdop"
    )


@query()
def bank_positions(t: Transit) -> DataFrame:
    """The filter with a bank of hypotheses over vehicles that turn between terminals, and whether its direction is the one driven."""
    driven = turning(t)
    placed = motion.follow(driven, t.placed_stops, guide=hypotheses.guide).where("state is null")
    return placed.join(driven.select("fix_id", "driven"), "fix_id").select(*POSITION, (F.col("direction") == F.col("driven")).alias("right"))


POSITION = [c.split()[0] for c in motion.POSITION.split(", ")]


@query()
def live_positions(t: Transit) -> DataFrame:
    """Positions at each fix and each second without one, losses by timeout: the filter over all there is, to the last fix."""
    last = t.fixes.agg(F.max("t_us").alias("t")).first()["t"]
    return motion.follow(t.fixes, t.placed_stops, True, last).where("state is null").select(*POSITION)


@query()
def stream_positions(t: Transit) -> DataFrame:
    """The same by a stream with typed state and timers, up to its watermark."""
    lines = motion.vehicle_lines(t.fixes, t.placed_stops).select("vehicle_id", "lines")
    stream = _fixes(t).withColumn("at", F.timestamp_micros("t_us"))
    return st.run_available(positions.live_positions(stream, lines), "append", "positions")


def one_way(t: Transit) -> DataFrame:
    """The stops of the lines, where the second direction passes some by: it has streets of its own."""
    return t.placed_stops.where("direction = 0 or seq % 4 <> 2")


def astray(t: Transit) -> DataFrame:
    """Vehicles on their lines again, some fixes far off, some further on along the line, and a pause after each fifteenth."""
    wrong = "case when fix_id % 17 = 0 then 0.02D else 0.0D end"
    n = F.expr(f"(t_us - {BASE_US}) div 12000000")
    f = turning(t).withColumn("n", n).withColumn("ahead", F.lead("lat", 8).over(W.partitionBy("vehicle_id").orderBy("t_us"))).withColumn("ahead_lon", F.lead("lon", 8).over(W.partitionBy("vehicle_id").orderBy("t_us")))
    return f.selectExpr(
        "fix_id", "vehicle_id", "route_id", "t_us + n div 15 * 200000000 as t_us", "cast(vehicle_id % 2 as int) as direction",
        f"case when fix_id % 13 = 0 then coalesce(ahead, lat) else lat end + {wrong} as lat", "case when fix_id % 13 = 0 then coalesce(ahead_lon, lon) else lon end as lon",
    )


@query()
def map_matching(t: Transit) -> DataFrame:
    """Every fix on its vehicle's line, with the branch that found it: a fold with an anchor, its window and its age."""
    return mm.match_tracks(astray(t), one_way(t)).where("state is null").drop("state", "route_id")
