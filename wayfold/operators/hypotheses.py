"""A bank of hypotheses beside the motion filter: which line a vehicle is on, scored line by line at every fix.

Each line of the route has a guess of position and speed of its own, a small g-h filter, and a score: an exponential
mean of how well fixes fit it and whether they advance along it. The line that the filter is on leads. Another one takes
over when its score is ahead by a margin for some fixes in a row, it advances, and, while the leader's line advances too
or the vehicle is at a terminal, it has advanced far enough. So a turn between terminals, or one that fell into silence,
is found though both directions use one street. A guess that misses too often is dropped, and bred anew at the first fix
near its line. `guide` is what `motion.follow` and `streaming.positions` take; the bank lies in the filter's typed state.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass

import numpy as np

from wayfold.operators import motion
from wayfold.operators.motion import Line, State

#: Weight of the past, bonus and penalty of a fix; margin, fixes in a row; metres, seconds.
KEEP, BONUS, PENALTY, MARGIN, TICKS, RUN_M, GUARD_S, DROP_AFTER = 0.9, 0.5, 1.0, 0.25, 3, 300.0, 120.0, 10
GAIN_X, GAIN_V, LEAST_STEP_M, SLACK_M = 0.5, 0.2, 0.5, 15.0


@dataclass
class Guess:
    """What is thought of a vehicle if it is on one line; z is its last snap, from `start` to `top` its present run."""

    line: float
    x: float
    v: float
    score: float = 0.0
    z: float = -1.0
    start: float = -1.0
    top: float = -1.0
    forward: float = 0.0
    misses: float = 0.0

    def run_m(self) -> float:
        return self.top - self.start

    def settle(self, z: float) -> None:
        """Take a snap in; a run goes on through noise and ends by moving back."""
        self.z, self.misses = z, 0.0
        if self.start < 0 or z < self.top - SLACK_M:
            self.start = self.top = z
        self.top = max(self.top, z)

    def observe(self, line: Line, lat: float, lon: float, kmh: float, dt: float) -> None:
        """Predict over dt seconds, snap near the guess, correct it and score the fix."""
        dt = max(dt, 1.0)
        self.x = min(max(self.x + self.v * dt, 0.0), line.length)
        reach = motion.WINDOW_M + motion.WINDOW_K * max(self.v, 1.0) * dt
        z, d = line.snap(lat, lon, self.x - reach, self.x + reach)
        self.forward = 0.0
        if d <= motion.SNAP_M and abs(z - self.x) <= reach:
            off, step = z - self.x, z - self.z if self.z >= 0 else 0.0
            self.x += GAIN_X * off
            self.v = min(max(self.v + GAIN_V * off / dt, 0.0), motion.V_MAX)
            self.forward = float(LEAST_STEP_M < step <= motion.V_MAX * dt + SLACK_M and kmh >= motion.MOVE_KMH)
            value = BONUS * self.forward - (d / motion.SNAP_M) ** 2
            self.settle(z)
        else:
            z, d = line.snap(lat, lon)
            value = -1.0 if d <= motion.SNAP_M else -1.0 - PENALTY
            self.misses += 1
            if d <= motion.SNAP_M and self.misses > 1:
                value = -((d / motion.SNAP_M) ** 2)
                self.x, self.v, self.start = z, min(kmh / 3.6, motion.V_MAX), -1.0
                self.settle(z)
        self.score = KEEP * self.score + (1 - KEEP) * value


def breed(guesses: dict[int, Guess], lines: dict[int, Line], leader: int, lat: float, lon: float, kmh: float, score: float) -> None:
    """A guess for the leading line, and for each line that has none and is near the fix."""
    for key in lines.keys() - guesses.keys():
        z, d = lines[key].snap(lat, lon)
        if key == leader or d <= motion.SNAP_M:
            guesses[key] = Guess(float(key), z, min(kmh / 3.6, motion.V_MAX), score)
            guesses[key].settle(z)


def vote(s: State, guesses: dict[int, Guess]) -> Guess | None:
    """The guess that takes over, if one does: ahead by the margin for TICKS fixes in a row, and moving as it should."""
    leader = guesses[s.direction]
    best = max(guesses.values(), key=lambda g: (g.score, g is leader, -g.line))
    if best is leader or best.score - leader.score < MARGIN:
        s.rival = []
        return None
    s.rival = [best.line, s.rival[1] + 1] if s.rival and s.rival[0] == best.line else [best.line, 1.0]
    needed = 0.0
    if leader.forward or s.mode == "AT_TERMINAL":
        lately = s.switched_us > 0 and s.t_us - s.switched_us <= GUARD_S * 1e6
        needed = 2 * RUN_M if lately else RUN_M
    return best if s.rival[1] >= TICKS and best.forward and best.run_m() >= needed else None


def guide(s: State, lines: dict[int, Line], seconds: float, lat: float, lon: float, kmh: float) -> str:
    """Score a fix that the filter has taken, `seconds` after the one before; SWITCHED if another line took over."""
    guesses = {int(row[0]): Guess(*row) for row in s.bank}
    for key, g in guesses.items():
        g.observe(lines[key], lat, lon, kmh, seconds)
    guesses = {k: g for k, g in guesses.items() if k == s.direction or g.misses < DROP_AFTER}
    breed(guesses, lines, s.direction, lat, lon, kmh, -1.0 if s.bank else 0.0)
    won = vote(s, guesses)
    s.bank = [list(astuple(guesses[k])) for k in sorted(guesses)]
    if won is None:
        return ""
    line = lines[int(won.line)]
    s.direction, s.trip, s.x, s.v, s.p = int(won.line), s.trip + 1, won.x, won.v, list((motion.P0[0], 0.0, motion.P0[1]))
    s.mode, s.misses, s.candidates, s.turns, s.resume, s.rival, s.switched_us = "TRACKING", 0, [], [], "", [], s.t_us
    s.next_stop, s.low_kmh, s.streak, s.dwell_s = int(np.searchsorted(line.stops, s.x)), float("inf"), 0, 0.0
    return "SWITCHED"
