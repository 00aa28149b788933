"""Map matching with memory: each fix on its vehicle's line, looked for near the last one, with a label of how it was found.

State per vehicle: direction, an anchor (the last snap and its time), the position shown, and snaps that were too far
ahead or behind to believe. A fresh anchor limits the search to the segments in a window about it; beyond the window,
or with a stale anchor, the whole line is searched. What is shown never goes back within a direction.

PRIMARY: on the vehicle's line. PRIMARY_RESET: on it, but further from the anchor than the time allows; what is shown
stays until REPEATS such snaps in a row agree, the last of them is taken. OPPOSITE_FALLBACK: off its line but on the
other direction's, which becomes its own. NO_SNAP: off both; all stays. The rules for jumps are this library's own.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.geo import DEGREE_PLANE_M
from wayfold.operators.motion import Line, line_table, to_lines
from wayfold.operators.storage import ship_package

#: Metres from the line; share of the line each side of the anchor; seconds; m/s and metres allowed since the anchor; snaps in a row.
SNAP_M, WINDOW, STALE_S, FAST, FREE_M, REPEATS = 50.0, 0.1, 120.0, 33.0, 100.0, 3

MATCHED = "vehicle_id bigint, t_us bigint, fix_id bigint, branch string, direction int, along_m double, shown_m double, distance_m double, whole boolean"
STATE = "last_us bigint, direction int, anchor_m double, anchor_us bigint, shown_m double, odd_m double, odd int"


def near(line: Line, lat: float, lon: float, low: float = -math.inf, high: float = math.inf) -> tuple[float, float]:
    """(position, distance) on the nearest segment of those that reach into [low, high]; the first of equally near ones."""
    first = max(int(np.searchsorted(line.cum, low, "left")) - 1, 0)
    last = min(max(int(np.searchsorted(line.cum, high, "right")), first + 1), len(line.cum) - 1)
    x, y, cum = line.x[first : last + 1], line.y[first : last + 1], line.cum[first : last + 1]
    px, py, dx, dy = lon * line.k, lat * DEGREE_PLANE_M, np.diff(x), np.diff(y)
    n = dx * dx + dy * dy
    t = np.clip(((px - x[:-1]) * dx + (py - y[:-1]) * dy) / np.where(n > 0, n, 1.0), 0, 1)
    d = np.hypot(x[:-1] + t * dx - px, y[:-1] + t * dy - py)
    i = int(np.argmin(d))
    return float(cum[i] + t[i] * math.sqrt(n[i])), float(d[i])


@dataclass
class Anchor:
    """What is kept of a vehicle; positions are -1 where there is none."""

    last_us: int = -1
    direction: int = -1
    anchor_m: float = -1.0
    anchor_us: int = -1
    shown_m: float = -1.0
    odd_m: float = -1.0
    odd: int = 0


class Matcher:
    """One vehicle on the lines of its route."""

    def __init__(self, lines: dict[int, Line], state: Anchor | None = None) -> None:
        self.lines, self.state = lines, state or Anchor()

    def _take(self, z: float, t_us: int, anew: bool) -> None:
        s = self.state
        s.anchor_m, s.anchor_us, s.odd, s.odd_m = z, t_us, 0, -1.0
        s.shown_m = z if anew else max(s.shown_m, z)

    def match(self, t_us: int, lat: float, lon: float, direction: int | None) -> tuple | None:
        """(branch, direction, along_m, shown_m, distance_m, whole); none without a line, a place or a later time than the last."""
        s = self.state
        if not self.lines or lat is None or lon is None or t_us is None or t_us <= s.last_us:
            return None
        s.last_us = t_us
        if s.direction not in self.lines:
            s.direction = direction if direction in self.lines else min(self.lines)
        line, fresh = self.lines[s.direction], s.anchor_m >= 0 and t_us - s.anchor_us <= STALE_S * 1e6
        reach, whole = WINDOW * line.length, not fresh
        z, d = near(line, lat, lon, s.anchor_m - reach, s.anchor_m + reach) if fresh else near(line, lat, lon)
        if fresh and d > SNAP_M:
            (z, d), whole = near(line, lat, lon), True
        if d <= SNAP_M:
            allowed = FAST * (t_us - s.anchor_us) / 1e6 + FREE_M
            if not fresh or abs(z - s.anchor_m) <= allowed:
                self._take(z, t_us, not fresh)
                return "PRIMARY", s.direction, z, s.shown_m, d, whole
            s.odd = s.odd + 1 if s.odd and abs(z - s.odd_m) <= allowed else 1
            s.odd_m = z
            if s.odd >= REPEATS:
                self._take(z, t_us, True)
            return "PRIMARY_RESET", s.direction, z, s.shown_m, d, whole
        other = self.lines.get(1 - s.direction)
        if other is not None:
            at, away = near(other, lat, lon)
            if away <= SNAP_M:
                s.direction = 1 - s.direction
                self._take(at, t_us, True)
                return "OPPOSITE_FALLBACK", s.direction, at, s.shown_m, away, True
        return "NO_SNAP", s.direction, None, s.shown_m if s.shown_m >= 0 else None, d, True


_FIELDS = [c.split() for c in STATE.split(", ")]
_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
_STATE = pa.struct([(n, _KINDS[k]) for n, k in _FIELDS])
_OUT = pa.schema([*((n, _KINDS[k]) for n, k in (c.split() for c in MATCHED.split(", "))), ("route_id", pa.int64()), ("state", _STATE)])
STRUCT = ", ".join(f"{n}: {k}" for n, k in _FIELDS)


def match_tracks(fixes: DataFrame, placed_stops: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Rows of MATCHED for the fixes, and one at a vehicle's end with its route_id and state, which the next batch takes as states.

    fixes: vehicle_id, t_us, fix_id, route_id, lat, lon, direction, in any order; those without a vehicle, a line, a place or
    a later time than the last are passed over, other columns too. A vehicle and route lie sorted in one task, one fix at a time;
    the lines come once, before their first fix.
    """
    ship_package(fixes.sparkSession)
    columns = ["vehicle_id", "t_us", "fix_id", "route_id", "lat", "lon", "direction"]
    fixes = fixes.where("t_us is not null and vehicle_id is not null").select(*columns)
    known = fixes.select("vehicle_id", "route_id")
    if states is not None:
        known = known.unionByName(states.select("vehicle_id", "route_id"))
    first = known.distinct().join(line_table(placed_stops), "route_id")
    if states is not None:
        first = first.join(states.select("vehicle_id", "route_id", "state"), ["vehicle_id", "route_id"], "left")
    else:
        first = first.withColumn("state", F.lit(None).cast(f"struct<{STRUCT}>"))
    rows = fixes.unionByName(first, allowMissingColumns=True).select(*columns, "lines", "state")
    dealt = rows.repartition("vehicle_id").sortWithinPartitions("vehicle_id", "route_id", F.col("t_us").asc_nulls_first(), "fix_id")

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, who, out = None, Matcher({}), []

        def end() -> None:
            if who.lines:
                out.append((key[0], *[None] * 8, key[1], asdict(who.state)))

        def batch() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [[]] * len(_OUT), _OUT, strict=True)], schema=_OUT)
            out.clear()
            return done

        for b in batches:
            for vehicle, t, fix, route, lat, lon, direction, raw, state in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (vehicle, route) != key:
                    end()
                    key, who = (vehicle, route), Matcher({})
                if raw is not None:
                    who = Matcher(to_lines(raw), Anchor(**state) if state else None)
                elif row := who.match(t, lat, lon, direction):
                    out.append((vehicle, t, fix, *row, None, None))
            yield batch()
        end()
        yield batch()

    return dealt.mapInArrow(fold, f"{MATCHED}, route_id bigint, state struct<{STRUCT}>")


def match_stream(stream: DataFrame, placed_stops: DataFrame) -> DataFrame:
    """Rows of MATCHED from a stream of fixes, as match_tracks has them if no fix comes in a later micro-batch than a later one.

    Lines are joined to the fixes of each micro-batch; the anchors are state by vehicle and route.
    """
    ship_package(stream.sparkSession)
    met = stream.where("t_us is not null and vehicle_id is not null").select("vehicle_id", "route_id", "t_us", "fix_id", "lat", "lon", "direction").join(line_table(placed_stops).withColumn("lines", F.to_json("lines")), "route_id")
    names = [c.split()[0] for c in MATCHED.split(", ")]

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        import json

        rows = pd.concat(list(parts)).sort_values(["t_us", "fix_id"])
        lines = {int(k): v for k, v in json.loads(rows["lines"].iloc[0]).items()} if len(rows) else {}
        who = Matcher(to_lines(lines), Anchor(*state.get) if state.exists else None)
        plain = ([None if pd.isna(v) else v for v in r] for r in rows[["t_us", "fix_id", "lat", "lon", "direction"]].itertuples(index=False))
        out = [(key[0], int(t), fix, *row) for t, fix, lat, lon, direction in plain if (row := who.match(int(t), lat, lon, direction))]
        state.update(tuple(asdict(who.state).values()))
        yield pd.DataFrame(out, columns=names)

    return met.groupBy("vehicle_id", "route_id").applyInPandasWithState(fold, MATCHED, STATE, "append", "NoTimeout")
