"""Structured streams of fixes: sources, watermarks, windows, stateful operators and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayfold.functions import geo
from wayfold.operators.storage import scratch, ship_package

#: How long fixes may be late, and how long a silent vehicle's state is kept.
LATENESS, IDLE_MS = "2 minutes", 30 * 60 * 1000
FIX_SCHEMA = (
    "vehicleId string, licensePlate string, routeNumber string, latitude double, longitude double, speedKmh double, course double, inMotion boolean, "
    "timestamp timestamp, direction int, hdop double, satellites int, accuracy double, wallClock timestamp"
)


def json_fixes(spark: SparkSession, path: str, files: int = 10) -> DataFrame:
    """Fixes as JSON lines from a folder, a few files a batch."""
    return spark.readStream.schema(FIX_SCHEMA).option("maxFilesPerTrigger", files).json(path)


def read_fixes(spark: SparkSession, path: str) -> DataFrame:
    """The same as a table."""
    return spark.read.schema(FIX_SCHEMA).json(path)


def event_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """The driver's events as a stream, with an event time that watermarks take.

    The table may be a file or a folder; a pattern lets the streaming source take either.
    """
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}*").withColumn("at", F.col("ts").cast("timestamp"))


def deduplicated(stream: DataFrame, keys: list[str], time: str = "at") -> DataFrame:
    """One row for each key within the lateness, whichever feed it came by."""
    return stream.withWatermark(time, LATENESS).dropDuplicatesWithinWatermark(keys)


def window_counts(stream: DataFrame, keys: list[str], every: str, time: str = "at", slide: str | None = None) -> DataFrame:
    """Counts and sums of values by window; a window is emitted once no more rows can come for it."""
    w = F.window(time, every, slide) if slide else F.window(time, every)
    return stream.withWatermark(time, LATENESS).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.unix_micros("w.start").alias("from_us"), *keys, "n", "total")


def sessions(stream: DataFrame, key: str, gap: str, time: str = "at") -> DataFrame:
    w = F.session_window(time, gap)
    return stream.withWatermark(time, LATENESS).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("w.start").alias("from_us"), F.unix_micros("w.end").alias("to_us"), key, "n")


VERDICTS = "fix_id bigint, vehicle_id bigint, verdict string"
LAST_FIX = "t_us bigint, lat double, lon double"


def stateful_outliers(stream: DataFrame) -> DataFrame:
    """Verdicts on fixes (fix_id, vehicle_id, t_us, lat, lon, speed) against the vehicle's last fix, kept as state."""

    ship_package(stream.sparkSession)

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["t_us", "fix_id"])
        last = state.get if state.exists else None
        verdicts = []
        for t, lat, lon, speed in zip(rows["t_us"], rows["lat"], rows["lon"], rows["speed"], strict=True):
            verdicts.append(verdict(last, t, lat, lon, speed))
            last = (int(t), float(lat), float(lon))
        state.update(last)
        state.setTimeoutDuration(IDLE_MS)
        yield pd.DataFrame({"fix_id": rows["fix_id"], "vehicle_id": rows["vehicle_id"], "verdict": verdicts})

    return stream.groupBy("vehicle_id").applyInPandasWithState(judge, VERDICTS, LAST_FIX, "append", GroupStateTimeout.ProcessingTimeTimeout)


def verdict(last: tuple | None, t_us: int, lat: float, lon: float, speed: float) -> str:
    """The outlier rules for one fix; see operators.tracks.outliers."""
    from math import atan2, cos, radians, sin, sqrt

    if last is None:
        return "NO_HISTORY"
    dt = (t_us - last[0]) // 1_000_000
    if dt < 3:
        return "TIME_GAP_TOO_SMALL"
    a, b = radians(last[1]), radians(lat)
    h = sin((b - a) / 2) ** 2 + cos(a) * cos(b) * sin(radians(lon - last[2]) / 2) ** 2
    d = 2 * geo.R * atan2(sqrt(h), sqrt(1 - h))
    if d < 10:
        return "FROZEN" if speed >= 10 else "DISTANCE_TOO_SMALL"
    return "SPEED_EXCEEDED" if d / dt * 3.6 > 150 else "VALID"


def run_available(stream: DataFrame, mode: str = "append", name: str = "stream", idle_batches: bool = True) -> DataFrame:
    """Run a stream over all that is there now, into a table on shared storage; the table.

    idle_batches: False for state with processing-time timeouts, for which batches without data would never end.
    """
    spark = stream.sparkSession
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, str(idle_batches and before == "true").lower())
    where = scratch(spark, name)
    schema = stream.schema
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    else:
        query = stream.writeStream.outputMode(mode).foreachBatch(overwrite(f"{where}/out")).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    spark.conf.set(key, before)
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{where}/out")


def overwrite(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the last complete result."""
    return lambda batch, _: batch.write.mode("overwrite").parquet(path)


def latest_sink(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the newest row of each key: the last snapshot and the batch, merged into a new version.

    Versions are folders by batch, so that a batch that is run again after a failure writes the same folder.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch
        if number > 0:
            rows = batch.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/{number - 1}"))
        names = batch.columns
        best = rows.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("b"))
        best.select("b.*").write.mode("overwrite").parquet(f"{path}/{number}")

    return merge


def hourly_json_sink(stream: DataFrame, path: str, checkpoint: str, time: str = "timestamp"):
    """A recorder: JSON lines in folders by hour."""
    return stream.withColumn("hour", F.date_format(time, "yyyyMMdd-HH")).writeStream.format("json").partitionBy("hour").option("path", path).option("checkpointLocation", checkpoint)


def fan_out(sinks: list[Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """One batch to several sinks, read once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return write
