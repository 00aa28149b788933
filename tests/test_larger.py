"""Steps that grow with the tables: the same results by ways that make fewer rows."""

import math

from pyspark.sql import functions as F

from wayfold.operators import joins as j
from tests.test_folds import earliest
from wayfold.operators import motion
from wayfold.operators import raptor as rp
from wayfold.operators import tracks as k
from wayfold.operators.storage import stored
from wayfold.plans import fleet, history
from wayfold.sources.transit import Transit


def apart(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_distances_are_made_once_for_two_places(spark):
    """Many rows at few places: all pairs of rows, with columns made from distances of places."""
    rows = [(i, 37.9 + i % 3 * 0.004, 58.3 + i % 5 * 0.006) for i in range(60)]
    left, right = spark.createDataFrame(rows, "a bigint, lat double, lon double"), spark.createDataFrame(rows, "b bigint, r_lat double, r_lon double")
    got = j.within_distance(left, right, 700.0, half=F.round(F.col("distance_m") / 2, 3))
    assert sorted((r["a"], r["b"]) for r in got.collect()) == sorted((x[0], y[0]) for x in rows for y in rows if apart(*x[1:], *y[1:]) <= 700.0)
    assert all(abs(r["half"] - r["distance_m"] / 2) < 1e-3 for r in got.collect())


def test_rows_of_a_period_are_numbered_by_slots(spark):
    """All rows in one hour, many at one time: the numbers of a plain count."""
    rows = [(i, i * 7919 % 50 * 40_000_000 + i % 3) for i in range(400)] + [(1000 + i, 3_600_000_000 + i) for i in range(5)]
    got = {r["fix_id"]: r["line"] for r in k.numbered(spark.createDataFrame(rows, "fix_id bigint, t_us bigint"), "t_us", "fix_id", 3_600_000_000, "line").collect()}
    want = {}
    for hour in (0, 1):
        want |= {i: n + 1 for n, (_, i) in enumerate(sorted((t, i) for i, t in rows if t // 3_600_000_000 == hour))}
    assert got == want


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_row_meets_its_line_as_an_array(spark):
    """Points and fixes are not put to each stop or segment of their line as rows of their own."""
    t = Transit(spark, "/root/testdata/sf0.001")
    assert "array_min" in plan(fleet.nearest_stop(t)) and "array_min" in plan(fleet.snap_to_route(t))
    assert "filter(stops" in plan(history.stop_visits(t)) and "filter(stops" in plan(history.next_stops(t))


def test_calm_seconds_are_those_of_single_steps():
    """Seconds taken at once equal seconds one by one, in every mode and beyond both timeouts."""
    for mode, v in (("TRACKING", 9.5), ("DWELL", 0.0), ("OFF_ROUTE", 3.0), ("AT_TERMINAL", 0.0), ("GPS_LOST", 7.1), ("DEPARTING", 1.0)):
        one, many = (motion.State(t_us=1_000_000, advanced_us=1_000_000, x=100.3, v=v, mode=mode) for _ in range(2))
        for until in range(2_000_000, 120_000_000, 1_000_000):
            motion.predict(one, until, 1500.0)
        motion.predict(one, 120_400_000, 1500.0)
        assert motion.calm_seconds(many, 120_400_000) in ((0,) if mode == "DEPARTING" else (15, 90))
        motion.predict(many, 120_400_000, 1500.0)
        assert one.row() == many.row()


def asked_between(copies):
    """Lines over stops 0 to 9, both ways, stops of equal walks (a copy each) off the lines, and requests between all of them."""
    lines = [[(0, 0), (1, 300), (2, 700), (3, 900)], [(4, 0), (2, 200), (5, 650), (6, 1000)], [(6, 0), (7, 250), (3, 800), (8, 1150), (9, 1400)]]
    lines += [[(s, line[-1][1] - o) for s, o in reversed(line)] for line in lines]
    near = {10: [(0, 120), (4, 90)], 20: [(1, 60), (5, 200)], 30: [(9, 150), (8, 30)], 40: [(3, 45), (6, 210)]}
    off = {k * 100 + i: near[k] for k in near for i in range(copies)}
    walks = {(s, to): w for s in off for to, w in off[s]} | {(2, 7): 100, (5, 4): 70, (6, 8): 333}
    walks |= {(1000 + i, 4000 + i): 1500 for i in range(copies)}
    walks |= {(b, a): w for (a, b), w in walks.items()}
    trips = [(k * 100 + i, m * 100 + i) for k in near for m in near if k != m for i in range(copies)]
    return lines, walks, trips + [(0, 9), (2, 8), (4, 3000), (2000, 3), (0, 0), (9, 0), (5000, 9), (6, 8)]


def test_journeys_of_equal_places_are_searched_once(spark, monkeypatch):
    """Requests whose ends have the same walks share a search: labels do not grow with them, and each has its own path."""
    rows = {}
    monkeypatch.setattr(rp, "stored", lambda df, path: rows.update({path.rsplit("/", 1)[1]: (kept := stored(df, path)).count()}) or kept)
    written = []
    for copies in (1, 8):
        lines, walks, trips = asked_between(copies)
        table = spark.createDataFrame([(n, 0, k, s, o) for n, line in enumerate(lines) for k, (s, o) in enumerate(line, 1)], "route_id bigint, direction int, position int, stop_id bigint, offset_s bigint")
        asked = spark.createDataFrame([(late * 10000 + i, a, b, 28800 + late * 1200) for late in (0, 1) for i, (a, b) in enumerate(trips)], "request bigint, from_stop bigint, to_stop bigint, departure_s bigint")
        rows.clear()
        got: dict = {}
        for r in rp.journeys(asked, table, spark.createDataFrame([(a, b, w) for (a, b), w in walks.items()], "from_stop bigint, to_stop bigint, walk_s bigint")).collect():
            got.setdefault(r["request"], {})[r["rides"]] = r["arrival_s"]
            a, b = trips[r["request"] % 10000]
            assert (r["legs"][0]["from_stop"], r["legs"][-1]["to_stop"], r["legs"][-1]["end_s"]) == (a, b, r["arrival_s"])
            assert all(x["to_stop"] == y["from_stop"] and x["end_s"] <= y["start_s"] for x, y in zip(r["legs"], r["legs"][1:]))
            assert all(walks[x["from_stop"], x["to_stop"]] == x["end_s"] - x["start_s"] for x in r["legs"] if x["kind"] == "WALK")
        written.append(sum(n for name, n in rows.items() if name.startswith(("round-", "reached-", "best-"))))
        for i, (a, b) in enumerate(trips):
            want = earliest(a, b, lines, {s: [(to, w) for (f, to), w in walks.items() if f == s] for s, _ in walks})
            walk = want.pop(0, math.inf)
            assert got.get(i, {}) == {k: v for k, v in want.items() if v < walk}, (a, b)
            assert got.get(10000 + i, {}) == {k: v + 1200 for k, v in got.get(i, {}).items()}, (a, b)
        assert len(got) > len(trips)
    assert written[0] == written[1]
