"""The bank of hypotheses on tracks made here: turns that the filter alone misses, no false ones; batch, batches that hand on, stream."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.test_positions import DRIVES, FIX, K, all_fixes, line_points, lines, placed, rows_of, track  # noqa: F401
from wayfold.operators import hypotheses, motion
from wayfold.plans import catalog, streams
from wayfold.sources.transit import Transit
from wayfold.streaming import positions

SF = "/root/testdata/sf0.01"


def drive(fixes, guide=hypotheses.guide, along=None):
    who = motion.Follower(along or lines(), guide=guide)
    return [who.fix(f[2], f[1], *f[4:]) for f in fixes]


def turned(seed, sigma=5.0, every=7):
    """To 3 km and back on the same street."""
    return track(1, [(280, 10, True), (280, -10, True)], start=200.0, every=every, seed=seed, sigma=sigma)


def forwards(fixes):
    return [(*f[:6], abs(f[6]), f[7]) for f in fixes]


def test_a_missed_turn_is_found():
    for seed in range(20):
        fixes = forwards(turned(seed))
        turn = 280 // 7
        out = drive(fixes)
        assert [n for n, r in enumerate(out) if "SWITCHED" in r[3]], seed
        at = next(n for n, r in enumerate(out) if "SWITCHED" in r[3])
        assert turn < at <= turn + 22 and all(r[4] == 0 for r in out[:at]) and all(r[4] == 1 for r in out[at:])
        truth = [motion_x(f) for f in fixes]
        assert all(abs(6000 - x - r[6]) <= 60 for x, r in list(zip(truth, out))[at + 3 :])
        alone = drive(fixes, None)
        assert all(r[4] == 0 for r in alone)


def motion_x(fix):
    return (fix[5] - 58.3) * K


def test_no_false_turns():
    """Where nothing was missed, the rows are those of the filter alone: driving, standing, silence, the turn at a terminal."""
    profiles = [*DRIVES.values(), [(300, 10, True), (200, 0, True), (200, 8, True)]]
    for seed in range(20):
        for p in profiles:
            fixes = track(1, p, start=100.0, seed=seed, sigma=5.0)
            assert drive(fixes) == drive(fixes, None)
        end = forwards(track(1, [(580, 10, True), (60, 0, True), (300, -10, True)], start=200.0, seed=seed, sigma=1.0))
        out = drive(end)
        assert "NEW_TRIP" in [r[3] for r in out] and out == drive(end, None)


@pytest.mark.parametrize("silence", [80, 200])
def test_a_turn_in_silence_at_the_terminal_is_found(silence):
    """The filter alone keeps the direction it had."""
    fixes = forwards(track(1, [(580, 10, True), (silence, -10, False), (200, -10, True)], start=200.0))
    assert drive(fixes, None)[-1][4] == 0
    out = drive(fixes)
    assert out[-1][4] == 1 and out[-1][2] != "AT_TERMINAL" and sum("SWITCHED" in r[3] for r in out) == 1


def side_by_side(metres):
    """Two lines in one direction, the second one further north."""
    north = metres / motion.DEGREE_PLANE_M
    return motion.to_lines({d: [{"lat": a + d * north, "lon": b} for a, b in line_points(0)] for d in (0, 1)})


def test_a_line_that_advances_too_needs_a_run():
    """On the first line, then on a parallel one 60 m away: it takes over after 300 m, back again within 120 s after 600 m."""
    along = side_by_side(60.0)
    north = 60.0 / motion.DEGREE_PLANE_M
    fixes = track(1, [(500, 10, True)], start=100.0, sigma=0.0)
    moved = [(*f[:4], f[4] + (north if 1000 < motion_x(f) < 2500 else 0.0), *f[5:]) for f in fixes]
    out = drive(moved, along=along)
    at = [n for n, r in enumerate(out) if "SWITCHED" in r[3]]
    assert len(at) == 2 and motion_x(moved[at[0]]) > 1000 and motion_x(moved[at[1]]) > 2500
    state = motion.State(t_us=100_000_000, mode="TRACKING", rival=[1.0, 5.0])
    leader = hypotheses.Guess(0.0, 0, 10, 0.0, 500.0, 0.0, 500.0, 1.0)
    rival = lambda run: {0: leader, 1: hypotheses.Guess(1.0, 0, 10, 0.4, run, 0.0, run, 1.0)}
    assert hypotheses.vote(state, rival(299.0)) is None and hypotheses.vote(state, rival(300.0)).line == 1.0
    state.switched_us = 10_000_000
    assert hypotheses.vote(state, rival(599.0)) is None and hypotheses.vote(state, rival(600.0)).line == 1.0
    state.t_us = 131_000_000
    assert hypotheses.vote(state, rival(300.0)).line == 1.0


def test_margin_and_row_of_fixes():
    state = motion.State(t_us=1, mode="TRACKING")
    bank = lambda score: {0: hypotheses.Guess(0.0, 0, 10), 1: hypotheses.Guess(1.0, 0, 10, score, 10.0, 0.0, 10.0, 1.0)}
    assert [hypotheses.vote(state, bank(0.25)) is not None for _ in range(4)] == [False, False, True, True]
    assert hypotheses.vote(state, bank(0.249)) is None and state.rival == []


def test_guesses_are_dropped_and_bred_anew():
    """A line 200 m away has no guess; once the vehicle is near it, it has one, and the line left behind loses its own."""
    along = side_by_side(200.0)
    north = 200.0 / motion.DEGREE_PLANE_M
    fixes = track(1, [(500, 10, True)], start=100.0, sigma=0.0)
    who = motion.Follower(along, guide=hypotheses.guide)
    held = []
    for f in fixes:
        who.fix(f[2], f[1], f[4] + (north if motion_x(f) > 1500 else 0.0), *f[5:])
        held.append([g[0] for g in who.state.bank])
    assert held[10] == [0.0] and [0.0, 1.0] in held and held[-1] == [1.0] and who.state.direction == 1


def tracks():
    return [*all_fixes(), *[(7, *f[1:]) for f in forwards(turned(3))]]


def plainly(until_us=900_000_000):
    """Every vehicle by itself, a clock of seconds between fixes."""
    out = []
    for v in sorted({f[0] for f in tracks()}):
        who = motion.Follower(lines(), guide=hypotheses.guide)
        for f in sorted((f for f in tracks() if f[0] == v), key=lambda f: f[1]):
            if who.state.mode != "NEW":
                out.extend((v, *r) for r in who.seconds(f[1] - 1))
            out.append((v, *who.fix(f[2], f[1], *f[4:])))
        out.extend((v, *r) for r in who.seconds(until_us))
    return sorted(out, key=lambda r: (r[0], r[1], r[2] is None))


def test_batches_hand_the_bank_on(spark, placed):  # noqa: F811
    until, cut = 900_000_000, 380_000_000  # within the row of fixes before the switch
    fixes = spark.createDataFrame(tracks(), FIX)
    a = motion.follow(fixes.where(f"t_us <= {cut}"), placed, True, cut, guide=hypotheses.guide).cache()
    b = motion.follow(fixes.where(f"t_us > {cut}"), placed, True, until, a.where("state is not null").select("vehicle_id", "route_id", "state"), hypotheses.guide)
    got = rows_of(a.where("state is null").unionByName(b.where("state is null")))
    assert got == plainly() and any("SWITCHED" in r[4] for r in got)


def test_stream_equals_batch(spark, placed, tmp_path):  # noqa: F811
    """Two runs of a stream from one checkpoint, the second one with the fixes after the first's."""
    clock = [(99, 1_100_000_000, 1, 98, 0.0, 0.0, 0.0, 1.0)]
    vehicles = motion.vehicle_lines(spark.createDataFrame(tracks(), FIX), placed)
    schema = spark.createDataFrame([], FIX).schema
    rows = sorted(tracks(), key=lambda f: f[1] + random.Random(f[2]).random() * 50e6)
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :] + clock):
        spark.createDataFrame(part, FIX).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withColumn("at", F.timestamp_micros("t_us"))
        live = positions.live_positions(stream, vehicles, "100 seconds", hypotheses.guide)
        live.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert rows_of(spark.read.schema(motion.POSITION).parquet(f"{tmp_path}/out")) == plainly(1_000_000_000)


@pytest.mark.parametrize("kmh", [0.0, 36.0])
def test_a_line_of_one_place_and_far_fixes(kmh):
    who = motion.Follower(motion.to_lines({0: [{"lat": 37.95, "lon": 58.3}] * 2}), guide=hypotheses.guide)
    rows = [who.fix(n, n * 5_000_000, 37.95 + n, 58.3, kmh, None) for n in range(1, 30)]
    assert all(math.isfinite(r[6]) for r in rows) and not any("SWITCHED" in r[3] for r in rows)


def test_query_finds_the_turns(spark):
    """Vehicles that turn between terminals: the bank has their direction right far more often than the filter alone."""
    t = Transit(spark, SF)
    driven = streams.turning(t).cache()
    rows = catalog.QUERIES["bank_positions"](spark, SF)
    assert rows.count() == driven.count() == t.fixes.count()
    alone = motion.follow(driven, t.placed_stops).where("state is null").join(driven.select("fix_id", "driven"), "fix_id").where("direction = driven").count()
    right = rows.where("right").count()
    assert right > 0.65 * driven.count() and right > 1.15 * alone
