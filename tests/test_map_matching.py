"""Map matching against a plain version: every branch, states handed on, the stream."""

import math

import pytest
from pyspark.sql import functions as F

from wayfold.operators import map_matching as mm
from wayfold.operators import motion
from wayfold.plans import catalog, streams
from wayfold.sources.transit import Transit

SF = "/root/testdata/sf0.001"
FIX = "vehicle_id bigint, t_us bigint, fix_id bigint, route_id bigint, lat double, lon double, direction int"
NAMES = [c.split()[0] for c in mm.MATCHED.split(", ")]


def nearest(points, lat, lon, low=-math.inf, high=math.inf):
    """(along, distance, length) by looking at each segment in turn; points: (lat, lon)."""
    k = motion.DEGREE_PLANE_M * math.cos(math.radians(sum(p[0] for p in points) / len(points)))
    best, at = None, 0.0
    px, py = lon * k, lat * motion.DEGREE_PLANE_M
    for (a, b), (c, d) in zip(points, points[1:]):
        ax, ay, dx, dy = b * k, a * motion.DEGREE_PLANE_M, (d - b) * k, (c - a) * motion.DEGREE_PLANE_M
        n = dx * dx + dy * dy
        size = math.sqrt(n)
        if at + size >= low and at <= high:
            t = min(max(((px - ax) * dx + (py - ay) * dy) / n, 0), 1) if n else 0
            away = math.hypot(ax + t * dx - px, ay + t * dy - py)
            if best is None or away < best[1]:
                best = (at + t * size, away)
        at += size
    return (*best, at)


def plain(fixes, lines):
    """One vehicle's rows; lines: direction to points."""
    way = anchor = since = shown = before = None
    odd, out = [], []
    for vehicle, t, fix, _, lat, lon, direction in sorted(fixes, key=lambda f: (f[1], f[2])):
        if before is not None and t <= before:
            continue
        before = t
        if way is None:
            way = direction if direction in lines else min(lines)
        z, d, length = nearest(lines[way], lat, lon)
        fresh = anchor is not None and t - since <= 120_000_000
        whole = True
        if fresh:
            inner = nearest(lines[way], lat, lon, anchor - length / 10, anchor + length / 10)
            if inner[1] <= 50:
                (z, d, _), whole = inner, False
        if d <= 50:
            allowed = 33 * (t - since) / 1e6 + 100 if fresh else math.inf
            if not fresh or abs(z - anchor) <= allowed:
                shown = max(shown, z) if fresh else z
                anchor, since, odd = z, t, []
                out.append((vehicle, t, fix, "PRIMARY", way, z, shown, d, whole))
                continue
            odd = [*odd, z] if odd and abs(z - odd[-1]) <= allowed else [z]
            if len(odd) == 3:
                anchor, since, shown, odd = z, t, z, []
            out.append((vehicle, t, fix, "PRIMARY_RESET", way, z, shown, d, whole))
            continue
        away = nearest(lines[1 - way], lat, lon) if 1 - way in lines else (0, math.inf)
        if away[1] <= 50:
            way, anchor, since, shown, odd = 1 - way, away[0], t, away[0], []
            out.append((vehicle, t, fix, "OPPOSITE_FALLBACK", way, anchor, shown, away[1], True))
        else:
            out.append((vehicle, t, fix, "NO_SNAP", way, None, shown, d, True))
    return out


def rounded(rows):
    return sorted(tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in rows)


def rows_of(df):
    return rounded(tuple(r[c] for c in NAMES) for r in df.collect())


@pytest.fixture(scope="module")
def drives(spark):
    t = Transit(spark, SF)
    fixes = [tuple(r) for r in streams.astray(t).select(*[c.split()[0] for c in FIX.split(", ")]).collect()]
    lines = {}
    for r in streams.one_way(t).orderBy("seq").collect():
        lines.setdefault(r["route_id"], {}).setdefault(r["direction"], []).append((r["lat"], r["lon"]))
    by = {}
    for f in fixes:
        by.setdefault((f[0], f[3]), []).append(f)
    return fixes, streams.one_way(t).cache(), rounded(r for (_, route), fs in by.items() for r in plain(fs, lines[route]))


def test_query_equals_the_plain_version(spark, drives):
    got = rows_of(catalog.QUERIES["map_matching"](spark, SF))
    assert got == drives[2]
    assert {r[3] for r in got} == {"PRIMARY", "PRIMARY_RESET", "OPPOSITE_FALLBACK", "NO_SNAP"}
    assert {(r[3], r[8]) for r in got} >= {("PRIMARY", False), ("PRIMARY", True)}


def test_batches_hand_the_anchor_on(spark, drives):
    fixes, placed, want = drives
    df = spark.createDataFrame(fixes, FIX)
    cut = sorted(f[1] for f in fixes)[len(fixes) // 2]
    a = mm.match_tracks(df.where(f"t_us <= {cut}"), placed).cache()
    b = mm.match_tracks(df.where(f"t_us > {cut}"), placed, a.where("state is not null").select("vehicle_id", "route_id", "state"))
    assert rows_of(a.where("state is null").unionByName(b.where("state is null"))) == want


def test_stream_equals_batch(spark, drives, tmp_path):
    """Two runs from one checkpoint, the fixes in time order over them."""
    fixes, placed, want = drives
    df = spark.createDataFrame(fixes, FIX)
    placed.write.parquet(f"{tmp_path}/placed")
    cut = sorted(f[1] for f in fixes)[len(fixes) // 2]
    for part in (f"t_us <= {cut}", f"t_us > {cut}"):
        df.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        live = mm.match_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), spark.read.parquet(f"{tmp_path}/placed"))
        live.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert rows_of(spark.read.schema(mm.MATCHED).parquet(f"{tmp_path}/out")) == want


def test_odd_rows(spark, drives):
    """No rows, null places and times, an unknown route, repeats, a clashing column."""
    placed = drives[1]
    assert mm.match_tracks(spark.createDataFrame([], FIX), placed).isEmpty()
    rows = [(1, 5, 1, 3, None, 58.3, 0), (1, None, 2, 3, 37.9, 58.3, 0), (2, 5, 3, 99, 37.9, 58.3, 0), (None, 5, 4, 3, 37.9, 58.3, None), (4, 5, 5, 3, 37.9, 58.3, 7), (4, 5, 5, 3, 37.9, 58.3, 7)]
    got = mm.match_tracks(spark.createDataFrame(rows, FIX).withColumn("state", F.lit("x")).withColumn("lines", F.lit(1)), placed).where("state is null")
    assert [(r["fix_id"], r["direction"]) for r in got.collect()] == [(5, 0)]
