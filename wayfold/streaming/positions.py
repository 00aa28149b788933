"""Live positions of vehicles as a stream: the motion filter as typed state, with timers for the seconds without fixes.

A fix waits in state until the watermark has passed it, so that fixes are taken in time order whatever batch they come
by. Event-time timers fire as the watermark moves, which other vehicles' fixes do too: a silent vehicle goes on at 1 Hz,
says GPS_LOST after 15 s and NO_GPS after 90 s, without any row of its own. A vehicle's lines are its initial state.
The rows are those of the batch fold (`operators.motion.follow`) up to the watermark; a restart goes on from the checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wayfold.operators import motion
from wayfold.operators.storage import ship_package
from wayfold.streaming.fixes import LATENESS

WAITING = "t_us bigint, fix_id bigint, lat double, lon double, speed double, hdop double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NAMES = [c.split()[0] for c in motion.POSITION.split(", ")]


class Positions(StatefulProcessor):
    """State of a vehicle: its lines, its filter, and the fixes that wait for the watermark."""

    def __init__(self, guide: motion.Guide | None = None) -> None:
        self.guide = guide

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.filter = handle.getValueState("filter", motion.STATE)
        self.lines = handle.getValueState("lines", "lines string")
        self.waiting = handle.getListState("waiting", WAITING)
        self.timer = handle.getValueState("timer", "ms bigint")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self.lines.update((initialState["lines"].iloc[0],))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [tuple(None if pd.isna(v) else v for v in r) for part in rows for r in part[["t_us", "fix_id", "lat", "lon", "speed", "hdop"]].itertuples(index=False)]
        yield from self._go_on(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        yield from self._go_on(key, [], timerValues.getCurrentWatermarkInMs())

    def _go_on(self, key: Any, new: list[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        if not self.lines.exists():
            return
        until = watermark_ms * 1000
        held = sorted([*(tuple(r) for r in self.waiting.get()), *((int(t), int(f), *rest) for t, f, *rest in new)], key=lambda r: r[:2])
        state = motion.State(**dict(zip(motion.STATE_NAMES, self.filter.get(), strict=True))) if self.filter.exists() else None
        if state is not None:
            state.p, state.candidates, state.turns = list(state.p), list(state.candidates), list(state.turns)
            state.bank, state.rival = [list(g) for g in state.bank], list(state.rival)
        lines = {int(k): v for k, v in json.loads(self.lines.get()[0]).items()}
        who, out = motion.Follower(motion.to_lines(lines), state, self.guide), []
        for t, fix, lat, lon, kmh, hdop in (r for r in held if r[0] <= until):
            if t > who.state.t_us:
                out.extend(who.seconds(t - 1))
            if row := who.fix(fix, t, lat, lon, kmh, hdop):
                out.append(row)
        out.extend(who.seconds(until))
        left = [r for r in held if r[0] > until]
        self.waiting.put(left) if left else self.waiting.clear()
        self.filter.update(who.state.row())
        self._wake(who.state, left)
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=NAMES).astype({"fix_id": "Int64"})

    def _wake(self, s: motion.State, left: list[tuple]) -> None:
        """A timer for the next fix that waits or the next second, whichever is first; a silent vehicle has none."""
        due = [left[0][0]] if left else []
        if s.mode not in ("NEW", "NO_GPS"):
            due.append(s.advanced_us + 1_000_000)
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if due:
            at = -(-min(due) // 1000)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def close(self) -> None:
        pass


def live_positions(stream: DataFrame, lines: DataFrame, lateness: str = LATENESS, guide: motion.Guide | None = None) -> DataFrame:
    """Rows of motion.POSITION. stream: vehicle_id, t_us, fix_id, lat, lon, speed, hdop and at, the event time; lines: (vehicle_id, lines), one a vehicle.

    The session's state store becomes RocksDB, which typed state needs.
    """
    spark = stream.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    known = lines.select("vehicle_id", F.to_json("lines").alias("lines")).groupBy("vehicle_id")
    return stream.withWatermark("at", lateness).groupBy("vehicle_id").transformWithStateInPandas(Positions(guide), motion.POSITION, "append", "eventTime", known)
