"""Folds and searches that SQL cannot express, against plain versions, and the motion filter on tracks made here."""

import heapq
import json
import math
import random

from pyspark.sql import functions as F

from wayfold.operators import motion
from wayfold.plans import catalog, journeys
from wayfold.plans.fleet import stop_transfers
from wayfold.sources.transit import Transit

SF = "/root/testdata/sf0.001"


def test_gps_validate(spark):
    rows = Transit(spark, SF).fixes.orderBy("fix_id").collect()
    last, want = {}, {}
    for r in rows:
        i, v = r["fix_id"], r["vehicle_id"]
        wall, t = r["t_us"] + (i * 13 % 50 - 45) * 1_000_000, r["t_us"] - i % 4 * 20_000_000
        place = (37.9, 58.3) if i % 10 < 3 else (r["lat"], r["lon"])
        before, seen = last.get(v, (None, None))
        if t > wall + 30_000_000:
            want[i] = "FUTURE_TS"
        elif before is not None and t <= before:
            want[i] = "DUPLICATE_TS" if t == before else "NON_INCREASING_TS"
        elif seen == place and r["speed"] >= 5:
            want[i], last[v] = "FROZEN_COORDS", (t, seen)
        else:
            want[i], last[v] = "ACCEPTED", (t, place)
    got = {r["fix_id"]: r["verdict"] for r in catalog.QUERIES["gps_validate"](spark, SF).collect()}
    assert got == want and len(set(want.values())) >= 4


def earliest(source, target, lines, walks):
    """By rides from 0 to 4 the earliest arrival at target: a label search over (time, rides, stop), at 8:00."""
    best, heap, found = {}, [(8 * 3600, 0, source, False)], {}
    while heap:
        at, rides, stop, walked = heapq.heappop(heap)
        if best.get((stop, rides, walked), math.inf) <= at and (stop, rides, walked) in best:
            continue
        best[stop, rides, walked] = at
        if stop == target:
            found[rides] = min(found.get(rides, math.inf), at)
        if not walked:
            for to, seconds in walks.get(stop, ()):
                heapq.heappush(heap, (at + seconds, rides, to, True))
        if rides == 4:
            continue
        for line in lines:
            for k, (s, offset) in enumerate(line):
                if s == stop:
                    wait = max(0, at - offset - 6 * 3600)
                    start = 6 * 3600 + -(-wait // 600) * 600
                    if start <= 23 * 3600:
                        for to, off in line[k + 1 :]:
                            if to != stop:
                                heapq.heappush(heap, (start + off, rides + 1, to, False))
    out, least = {}, math.inf
    for rides in sorted(found):
        if found[rides] < least:
            out[rides] = least = found[rides]
    return out


def test_raptor_journeys(spark):
    t = Transit(spark, SF)
    table, lines, walks = journeys._timetable(t).orderBy("route_id", "direction", "position").collect(), {}, {}
    for r in table:
        lines.setdefault((r["route_id"], r["direction"]), []).append((r["stop_id"], r["offset_s"]))
    for r in stop_transfers(t).where("walk_s <= 400").collect():
        walks.setdefault(r["from_stop"], []).append((r["to_stop"], r["walk_s"]))
    got: dict = {}
    for r in catalog.QUERIES["raptor_journeys"](spark, SF).collect():
        got.setdefault(r["request"], {})[r["rides"]] = r["arrival_s"]
        legs = json.loads(r["path"])
        assert sum(x["kind"] == "RIDE" for x in legs) == r["rides"] and legs[-1]["end_s"] == r["arrival_s"]
        assert all(a["to_stop"] == b["from_stop"] and a["end_s"] <= b["start_s"] for a, b in zip(legs, legs[1:]))
    asked = journeys._asked(t).collect()
    for r in asked:
        want = {k: v for k, v in earliest(r["from_stop"], r["to_stop"], list(lines.values()), walks).items()}
        walk = want.pop(0, math.inf)
        assert got.get(r["request"], {}) == {k: v for k, v in want.items() if v < walk}, r


def straight(metres=6000.0, stops=7):
    """A line to the east, with its stops at equal distances."""
    k = motion.DEGREE_PLANE_M * math.cos(math.radians(37.95))
    return motion.Line([37.95] * stops, [58.3 + metres * i / (stops - 1) / k for i in range(stops)]), k


def drive(rng, seconds, speed, sigma, every=5.0, gap=None):
    """(x, t_us, lat, lon, kmh) of a vehicle at an even speed, with noise; no fixes within the gap."""
    line, k = straight()
    for n in range(int(seconds / every)):
        t = n * every
        if gap and gap[0] < t < gap[1]:
            continue
        x = 200 + speed * t
        yield x, int((t + 1) * 1e6), 37.95 + rng.gauss(0, sigma) / motion.DEGREE_PLANE_M, 58.3 + (x + rng.gauss(0, sigma)) / k, speed * 3.6


def run(track):
    line, _ = straight()
    state, out = motion.State(), []
    for x, t, lat, lon, kmh in track:
        event, away = motion.step(state, {0: line}, t, lat, lon, kmh, 1.0)
        out.append((x, state.x, state.mode, event, away))
    return out


def test_motion_filter_follows_a_noisy_track():
    for seed in range(20):
        out = run(drive(random.Random(seed), 400, 10.0, 5.0))
        errors = sorted(abs(x - at) for x, at, *_ in out[10:])
        assert errors[-1] <= 25 and errors[int(0.95 * len(errors))] <= 15
        assert all(b[1] >= a[1] - 25 for a, b in zip(out, out[1:]))


def test_motion_filter_says_when_the_signal_was_lost():
    events = [e for *_, e, _ in run(drive(random.Random(1), 400, 10.0, 5.0, gap=(100, 140)))]
    assert events.count("GPS_LOST") == 1
    out = run(drive(random.Random(1), 400, 10.0, 5.0, gap=(100, 260)))
    assert {"NO_GPS", "REINITIALISED"} & {e for *_, e, _ in out}
    assert abs(out[-1][0] - out[-1][1]) <= 40


def test_motion_filter_leaves_no_track_out_of_its_line(spark):
    rows = catalog.QUERIES["motion_filter"](spark, SF)
    bad = rows.where("x < 0 or v < 0 or v > 22 or variance <= 0 or deviation_m < 0")
    assert bad.isEmpty()
    assert rows.select("fix_id").distinct().count() == rows.count()
    assert {"GPS_LOST", "NO_GPS"} & {r["event"] for r in rows.select("event").distinct().collect()} or rows.where(F.col("mode") == "NO_GPS").isEmpty()
