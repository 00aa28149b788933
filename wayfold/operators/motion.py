"""A motion filter for vehicles on routes: position along the line and speed, a Kalman filter under a mode machine.

State per vehicle: arc position x, speed v, covariance P, mode, direction and trip. Each fix is snapped to the
line near x, gated by its innovation, and corrects the state within bounds; rejected fixes in a row re-anchor it.
Stops and terminals are zones of the line; at a terminal the other direction becomes the line. Between fixes the
position goes on by its speed, in steps of a second from the last fix; silence makes it GPS_LOST, then NO_GPS, where
it stands. `Follower` gives a row for each fix and, if asked, for each such second: batch folds (mapInArrow over
sorted vehicles) and the stream (`streaming.positions`) both call it, and hand its typed state on. Without seconds,
the first fix after a gap has the loss as its event, unless it has another one; the estimates are the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.geo import DEGREE_PLANE_M
from wayfold.operators.storage import ship_package

#: Metres, seconds, m/s.
WINDOW_M, WINDOW_K, SIGMA_M, ACC_REF, SNAP_M, OFF_M, GATE = 150.0, 1.5, 15.0, 5.0, 80.0, 120.0, 3.0
Q_POS, Q_VEL, P0 = 0.5, 0.8, (1600.0, 25.0)
WEAK_V, A_MAX, A_DEPART, V_DEPART, V_MAX, REANCHOR_M, PERSIST, OFF_AFTER, OFF_EXIT = 0.1, 1.5, 1.0, 12.5, 22.0, 150.0, 4, 5, 2
LOST_S, GONE_S, ARRIVE_M, STOP_M, TERMINAL_M, STOP_KMH, MOVE_KMH = 15.0, 90.0, 60.0, 15.0, 30.0, 1.0, 5.0
STOP_FIXES, DEPART_FIXES, DWELL_MIN_S, DWELL_MAX_S = 2, 3, 10.0, 600.0
TURN_STEP_M, TURN_ZONE_M, TURN_CONFIRMS, FREEZE_M = 40.0, 600.0, 3, 200.0

ESTIMATE = "fix_id bigint, vehicle_id bigint, mode string, event string, direction int, trip int, x double, v double, variance double, deviation_m double"


class Line:
    """A polyline with its cumulative metres and its stops' positions."""

    def __init__(self, lats: list[float], lons: list[float]) -> None:
        lat, lon = np.asarray(lats, float), np.asarray(lons, float)
        k = DEGREE_PLANE_M * math.cos(math.radians(float(lat.mean()))) if len(lat) else 1.0
        self.k, self.x, self.y = k, lon * k, lat * DEGREE_PLANE_M
        self.cum = np.concatenate([[0.0], np.cumsum(np.hypot(np.diff(self.x), np.diff(self.y)))])
        self.length, self.stops = float(self.cum[-1]), self.cum
        dx, dy = np.diff(self.x), np.diff(self.y)
        n = dx * dx + dy * dy
        self.parts = self.x[:-1], self.y[:-1], self.cum[:-1], dx, dy, np.where(n > 0, n, 1), n > 0, np.sqrt(n)

    def snap(self, lat: float, lon: float, low: float = -math.inf, high: float = math.inf) -> tuple[float, float]:
        """(position, distance) of the nearest point between two positions; of the whole line if none is between."""
        px, py = lon * self.k, lat * DEGREE_PLANE_M
        x, y, cum, dx, dy, n, long, sides = self.parts
        t = np.minimum(np.maximum(np.where(long, ((px - x) * dx + (py - y) * dy) / n, 0.0), 0.0), 1.0)
        at = cum + t * sides
        d = np.hypot(x + t * dx - px, y + t * dy - py)
        if low > -math.inf or high < math.inf:
            near = (at >= low) & (at <= high)
            d = np.where(near, d, np.inf) if near.any() else d
        i = int(d.argmin())
        return float(at[i]), float(d[i])


@dataclass
class State:
    """What is kept of a vehicle between fixes."""

    t_us: int = 0
    x: float = 0.0
    v: float = 0.0
    p: list[float] = field(default_factory=lambda: [P0[0], 0.0, P0[1]])
    mode: str = "NEW"
    direction: int = 0
    trip: int = 0
    misses: int = 0
    candidates: list[float] = field(default_factory=list)
    turns: list[float] = field(default_factory=list)
    next_stop: int = 0
    advanced_us: int = 0
    resume: str = ""
    low_kmh: float = math.inf
    streak: int = 0
    dwell_s: float = 0.0
    bank: list[list[float]] = field(default_factory=list)
    rival: list[float] = field(default_factory=list)
    switched_us: int = 0

    def row(self) -> tuple:
        """The state as a row of STATE."""
        return tuple(asdict(self).values())


STATE = (
    "t_us bigint, x double, v double, p array<double>, mode string, direction int, trip int, misses int, candidates array<double>, turns array<double>, "
    "next_stop int, advanced_us bigint, resume string, low_kmh double, streak int, dwell_s double, bank array<array<double>>, rival array<double>, switched_us bigint"
)


def calm_seconds(s: State, until_us: int) -> int:
    """Whole seconds up to a time in which `predict` changes position and variance only."""
    whole = (until_us - s.advanced_us) // 1_000_000
    if s.mode in ("DEPARTING", "NO_GPS"):
        return whole if s.mode == "NO_GPS" else 0
    limit = GONE_S if s.mode in ("OFF_ROUTE", "AT_TERMINAL", "GPS_LOST") else LOST_S
    return max(0, min(whole, (int(limit * 1e6) - s.advanced_us + s.t_us) // 1_000_000))


def coast(s: State, n: int, length: float) -> Iterator[tuple[float, float]]:
    """(position, variance) of each of the next n calm seconds; the state is as after them at the end."""
    moves = s.mode not in ("DWELL", "NO_GPS", "OFF_ROUTE", "AT_TERMINAL")
    x, v, (a, b, c) = s.x, s.v, s.p
    for _ in range(n):
        if moves:
            x = min(max(x + v, 0.0), length)
        a, b, c = a + 2.0 * b + c + Q_POS, b + c, c + Q_VEL
        yield x, a
    s.x, s.p, s.advanced_us = x, [a, b, c], s.advanced_us + n * 1_000_000


def predict(s: State, until_us: int, length: float) -> None:
    """Move on to a time in steps of a second since the last fix; no motion while standing, and none beyond the line."""
    while s.advanced_us < until_us:
        if n := calm_seconds(s, until_us):
            for _ in coast(s, n, length):
                pass
            continue
        step = min((until_us - s.advanced_us) / 1e6, 1.0)
        s.advanced_us = min(s.advanced_us + 1_000_000, until_us)
        since = (s.advanced_us - s.t_us) / 1e6
        if since > LOST_S and s.mode not in ("GPS_LOST", "NO_GPS", "OFF_ROUTE", "AT_TERMINAL"):
            s.resume, s.mode = s.mode, "GPS_LOST"
        if since > GONE_S and s.mode != "NO_GPS":
            s.resume = s.resume if s.mode == "GPS_LOST" else s.mode
            s.mode, s.v = "NO_GPS", 0.0
        if s.mode == "DEPARTING":
            s.v = max(s.v, min(s.v + A_DEPART * step, V_DEPART))
        if s.mode not in ("DWELL", "NO_GPS", "OFF_ROUTE", "AT_TERMINAL"):
            s.x = min(max(s.x + s.v * step, 0.0), length)
        a, b, c = s.p
        s.p = [a + 2 * step * b + step * step * c + Q_POS * step, b + step * c, c + Q_VEL * step]


def correct(s: State, z: float, d: float, sigma: float, dt: float) -> bool:
    """Take a snapped position in if its innovation passes the gate."""
    r = (sigma * (1 + d / SNAP_M)) ** 2
    a, b, c = s.p
    innovation = z - s.x
    if abs(innovation) > GATE * math.sqrt(a + r):
        return False
    most = 0.5 * max(s.v, 1.0) * max(dt, 1.0) + 30.0
    s.x += min(max(a / (a + r) * innovation, -most), most)
    s.v = min(max(s.v + min(max(b / (a + r) * innovation, -A_MAX * max(dt, 1.0)), A_MAX * max(dt, 1.0)), 0.0), V_MAX)
    k0, k1 = a / (a + r), b / (a + r)
    s.p = [(1 - k0) * a, (1 - k0) * b, c - k1 * b]
    return True


def stop_layer(s: State, line: Line, kmh: float, dt: float, z: float) -> list[str]:
    """Events at the next stop that is not a terminal's: nearing it, standing, leaving, standing too long, or passing it by."""
    events: list[str] = []
    while s.next_stop < len(line.stops) and not TERMINAL_M < line.stops[s.next_stop] < line.length - TERMINAL_M:
        s.next_stop += 1
    if s.next_stop >= len(line.stops):
        return events
    at = float(line.stops[s.next_stop])
    ahead, seen = at - s.x, at - z
    if -STOP_M <= ahead <= ARRIVE_M or -STOP_M <= seen <= ARRIVE_M:
        s.low_kmh = min(s.low_kmh, kmh)

    def leave() -> None:
        s.next_stop, s.low_kmh, s.streak = s.next_stop + 1, math.inf, 0

    if s.mode == "DWELL":
        before, s.x = s.dwell_s, at
        s.dwell_s += max(dt, 1.0)
        if before <= DWELL_MAX_S < s.dwell_s:
            events.append("DWELL_OUTLIER")
        if kmh >= MOVE_KMH and s.dwell_s >= DWELL_MIN_S:
            s.mode = "DEPARTING"
            events.append("DWELL_EXIT")
            leave()
        return events
    if s.mode == "DEPARTING":
        s.streak = s.streak + 1 if kmh >= MOVE_KMH else 0
        if s.streak >= DEPART_FIXES:
            s.mode, s.streak = "TRACKING", 0
        return events
    if s.mode == "TRACKING" and (0 <= ahead <= ARRIVE_M or -STOP_M <= seen <= ARRIVE_M):
        s.mode, s.streak = "DECELERATING", 0
        events.append("DECEL_ENTER")
    elif s.mode == "DECELERATING":
        s.streak = s.streak + 1 if abs(ahead) <= STOP_M and kmh < STOP_KMH else 0
        if s.streak >= STOP_FIXES:
            s.mode, s.x, s.v, s.dwell_s = "DWELL", at, 0.0, 0.0
            return [*events, "DWELL_ENTER"]
    if at - max(s.x, z) < -STOP_M:
        if s.low_kmh >= MOVE_KMH:
            events.append("SKIP")
            s.v = max(s.v, 0.8 * kmh / 3.6)
        s.mode = "TRACKING"
        leave()
    return events


def step(s: State, lines: dict[int, Line], t_us: int, lat: float, lon: float, kmh: float, hdop: float | None, accuracy: float | None = None) -> tuple[str, float]:
    """One fix: (event, distance from the line)."""
    line = lines[s.direction]
    sigma = accuracy if accuracy else hdop * ACC_REF if hdop else SIGMA_M
    if s.mode == "NEW":
        found = {k: g.snap(lat, lon) for k, g in lines.items()}
        s.direction = min(found, key=lambda k: (found[k][1], k))
        s.x, d = found[s.direction]
        s.t_us, s.advanced_us, s.v = t_us, t_us, min(kmh / 3.6, V_MAX)
        s.mode = "OFF_ROUTE" if d > OFF_M else "TRACKING"
        s.next_stop = int(np.searchsorted(lines[s.direction].stops, s.x))
        return "ACQUIRED", d
    dt = max((t_us - s.t_us) / 1e6, 0.0)
    before = s.mode
    predict(s, t_us, line.length)
    s.t_us = s.advanced_us = t_us
    lost = s.mode if s.mode in ("GPS_LOST", "NO_GPS") and s.mode != before else ""
    reach = WINDOW_M + WINDOW_K * max(s.v, 1.0) * max(dt, 1.0)
    z, d = line.snap(lat, lon, s.x - reach, s.x + reach)
    if d > OFF_M:
        whole = line.snap(lat, lon)
        z, d = whole if whole[1] < d else (z, d)
    if s.mode == "NO_GPS" and abs(z - s.x) > FREEZE_M and d <= OFF_M:
        s.x, s.v, s.p, s.mode, s.misses = z, min(kmh / 3.6, V_MAX), list((P0[0], 0.0, P0[1])), "TRACKING", 0
        s.next_stop = int(np.searchsorted(line.stops, s.x))
        return "REINITIALISED", d
    if s.mode in ("GPS_LOST", "NO_GPS"):
        s.mode, s.resume = s.resume or "TRACKING", ""
    if s.mode == "AT_TERMINAL":
        return turn(s, lines, lat, lon, d)
    good = d <= OFF_M and correct(s, z, d, sigma, dt)
    if good:
        s.misses, s.candidates = 0, []
        s.v = min(max(s.v + WEAK_V * (min(kmh / 3.6, V_MAX) - s.v), 0.0), V_MAX)
        if s.mode in ("OFF_ROUTE", "RECOVERING"):
            s.turns.append(z)
            if s.mode == "RECOVERING" or len(s.turns) >= OFF_EXIT:
                s.mode, s.turns = "TRACKING", []
                return "BACK_ON_ROUTE", d
            return lost, d
        event = ",".join(stop_layer(s, line, kmh, dt, z))
        if s.x >= line.length - TERMINAL_M and s.direction in lines:
            s.mode, s.turns = "AT_TERMINAL", []
            return "AT_TERMINAL", d
        return event or lost, d
    s.misses += 1
    if d <= OFF_M:
        s.candidates = [*s.candidates[-PERSIST:], z] if not s.candidates or abs(z - s.candidates[-1]) <= REANCHOR_M + V_MAX * max(dt, 1.0) else [z]
        if len(s.candidates) >= PERSIST:
            s.x, s.p, s.mode, s.candidates, s.misses = z, list((P0[0], 0.0, P0[1])), "TRACKING", [], 0
            s.next_stop = int(np.searchsorted(line.stops, s.x))
            return "REANCHORED", d
    elif s.misses >= OFF_AFTER:
        s.mode = "OFF_ROUTE"
        return "OFF_ROUTE", d
    elif s.misses >= PERSIST:
        s.mode = "RECOVERING"
    return lost, d


def turn(s: State, lines: dict[int, Line], lat: float, lon: float, d: float) -> tuple[str, float]:
    """At a terminal: a new trip on the other direction once its snaps advance near its start."""
    other = lines.get(1 - s.direction)
    if other is None:
        return "", d
    z, away = other.snap(lat, lon)
    if away <= OFF_M and z <= TURN_ZONE_M and (not s.turns or z - s.turns[-1] >= TURN_STEP_M):
        s.turns.append(z)
    if len(s.turns) >= TURN_CONFIRMS or (s.turns and z > TURN_ZONE_M and away <= OFF_M):
        s.direction, s.trip, s.x, s.mode, s.turns = 1 - s.direction, s.trip + 1, z, "TRACKING", []
        s.p, s.next_stop, s.low_kmh, s.streak = list((P0[0], 0.0, P0[1])), int(np.searchsorted(other.stops, z)), math.inf, 0
        return "NEW_TRIP", away
    return "", d


def line_table(placed_stops: DataFrame) -> DataFrame:
    """A row for each route: its lines by direction, as arrays of (lat, lon) in travel order."""
    ordered = placed_stops.groupBy("route_id", "direction").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("line"))
    return ordered.groupBy("route_id").agg(F.map_from_entries(F.collect_list(F.struct("direction", "line"))).alias("lines"))


def to_lines(raw: dict | list) -> dict[int, Line]:
    return {int(k): Line([p["lat"] for p in v], [p["lon"] for p in v]) for k, v in (raw.items() if isinstance(raw, dict) else raw) if len(v) > 1}


POSITION = "vehicle_id bigint, t_us bigint, fix_id bigint, mode string, event string, direction int, trip int, x double, v double, variance double, deviation_m double"


#: Looks at a fix that was taken (state, lines, seconds since the one before, lat, lon, kmh), may change the state, and gives an event.
Guide = Callable[[State, dict[int, Line], float, float, float, float], str]


class Follower:
    """One vehicle: its lines and state. Gives (t_us, fix_id, event, deviation) and the state's numbers for fixes and seconds."""

    def __init__(self, lines: dict[int, Line], state: State | None = None, guide: Guide | None = None) -> None:
        self.lines, self.state, self.guide = lines, state or State(direction=min(lines, default=0)), guide

    def _row(self, t_us: int, fix: int | None, event: str, away: float | None) -> tuple:
        s = self.state
        return t_us, fix, s.mode, event, s.direction, s.trip, s.x, s.v, s.p[0], away

    def seconds(self, until_us: int) -> Iterator[tuple]:
        """A row for each whole second since the last fix up to a time; the last one says NO_GPS."""
        s = self.state
        if s.mode == "NEW" or s.direction not in self.lines:
            return
        length = self.lines[s.direction].length
        while s.mode != "NO_GPS" and (at := s.advanced_us + 1_000_000) <= until_us:
            before = s.mode
            if n := calm_seconds(s, until_us):
                mode, direction, trip, v, began = s.mode, s.direction, s.trip, s.v, s.advanced_us
                for i, (x, variance) in enumerate(coast(s, n, length), 1):
                    yield began + i * 1_000_000, None, mode, "", direction, trip, x, v, variance, None
                continue
            predict(s, at, length)
            yield self._row(at, None, s.mode if s.mode != before else "", None)

    def fix(self, fix: int, t_us: int, lat: float, lon: float, kmh: float, hdop: float | None) -> tuple | None:
        """The row of a fix; none without a line or if it is not later than the last one."""
        if not self.lines or t_us <= self.state.t_us:
            return None
        before = self.state.t_us or t_us
        event, away = step(self.state, self.lines, t_us, lat, lon, kmh, hdop)
        if self.guide and (said := self.guide(self.state, self.lines, (t_us - before) / 1e6, lat, lon, kmh)):
            event = f"{event},{said}" if event else said
        return self._row(t_us, fix, event, away)


def vehicle_lines(fixes: DataFrame, placed_stops: DataFrame) -> DataFrame:
    """(vehicle_id, route_id, lines): the lines of the routes that each vehicle has fixes on."""
    return fixes.select("vehicle_id", "route_id").distinct().join(line_table(placed_stops), "route_id")


def follow(fixes: DataFrame, placed_stops: DataFrame, seconds: bool = False, until_us: int | None = None, states: DataFrame | None = None, guide: Guide | None = None) -> DataFrame:
    """Rows of POSITION and, at a vehicle's end, one with its route_id and state: what the next batch of fixes takes as states.

    fixes: vehicle_id, t_us, fix_id, route_id, lat, lon, speed, hdop, in any order; those not later than the last are
    passed over. seconds: also a row for each second between fixes, and up to until_us behind the last. states:
    (vehicle_id, route_id, state) as an earlier call gave them. guide: looks at each fix
    after the filter, as `hypotheses.guide` does. Geometry and state go along with the first row of a
    vehicle and route only.
    """
    ship_package(fixes.sparkSession)
    columns = ["vehicle_id", "t_us", "fix_id", "route_id", "lat", "lon", "speed", "hdop"]
    # null order: a vehicle's first row has no time
    known = fixes.select("vehicle_id", "route_id")
    known = (known.unionByName(states.select("vehicle_id", "route_id")) if states is not None else known).distinct()
    first = known.join(line_table(placed_stops), "route_id")
    first = first.join(states.select("vehicle_id", "route_id", "state"), ["vehicle_id", "route_id"], "left") if states is not None else first.withColumn("state", F.lit(None).cast(f"struct<{STATE_FIELDS}>"))
    rows = fixes.select(*columns).unionByName(first, allowMissingColumns=True).select(*columns, "lines", "state")
    # A number of parts, as those left to adaptive execution are few: it goes by bytes, and the fold is slow by its rows.
    parts = int(fixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "vehicle_id").sortWithinPartitions("vehicle_id", "route_id", F.col("t_us").asc_nulls_first(), "fix_id")

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, who = None, None
        out: list[tuple] = []

        def end() -> None:
            if who is not None and who.lines:
                if seconds and until_us is not None:
                    out.extend((key[0], *r, None, None) for r in who.seconds(until_us))
                out.append((key[0], who.state.t_us, *[None] * 9, key[1], dict(zip(STATE_NAMES, who.state.row(), strict=True))))

        for b in batches:
            for vehicle, t, fix, route, lat, lon, kmh, hdop, raw, state in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (vehicle, route) != key:
                    end()
                    key, who = (vehicle, route), Follower({}, guide=guide)
                if raw is not None:
                    who = Follower(to_lines(raw), State(**state) if state else None, guide)
                    continue
                if t is None:
                    continue
                if seconds and t > who.state.t_us:
                    out.extend((vehicle, *r, None, None) for r in who.seconds(t - 1))
                if row := who.fix(fix, t, lat, lon, kmh, hdop):
                    out.append((vehicle, *row, None, None))
            yield _rows(out)
            out.clear()
        end()
        yield _rows(out)

    return dealt.mapInArrow(fold, f"{POSITION}, route_id bigint, state struct<{STATE_FIELDS}>")


STATE_NAMES = [c.split()[0] for c in STATE.split(", ")]
STATE_FIELDS = ", ".join(f"{n}: {t}" for n, t in (c.split(" ", 1) for c in STATE.split(", ")))
_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64()), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}
_OUT = [*(_TYPES[c.split()[1]] for c in POSITION.split(", ")), pa.int64(), pa.struct([(n, _TYPES[t]) for n, t in (c.split(" ", 1) for c in STATE.split(", "))])]


def _rows(out: list[tuple]) -> pa.RecordBatch:
    names = [*(c.split()[0] for c in POSITION.split(", ")), "route_id", "state"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * len(_OUT), _OUT, strict=True)], names=names)


def filter_tracks(fixes: DataFrame, placed_stops: DataFrame) -> DataFrame:
    """An estimate for each fix of a vehicle with a route, in time order."""
    return follow(fixes, placed_stops).where("state is null").select(*(c.split()[0] for c in ESTIMATE.split(", ")))
