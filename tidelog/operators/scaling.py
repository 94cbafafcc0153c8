"""The scale state machine, replayed on event time as an ordered fold."""

from __future__ import annotations

import math
from dataclasses import dataclass

#: Scales below are as good as none; what a hibernating group may wake to at most.
IDLE, BOOTSTRAP = 1e-7, 1.0
BUCKETS, LEAST_SAMPLES = 100, 10


@dataclass(frozen=True)
class Bounds:
    """What a proposal is read from: samples are clamped to scale * [low, high], and taken within scale * [least, most]."""

    low: float
    high: float
    least: float
    most: float
    percentile: float


#: Fixed values of the four kinds of proposal.
UP = Bounds(1.0, 2.0, 1.2, 2.0, 0.5)
DOWN = Bounds(0.5, 1.0, 0.5, 0.8, 0.99)
SLEEP = Bounds(0.0, 1.0, 0.0, 0.0, 0.99)
WAKE = Bounds(0.0, 1.0, IDLE, 1.0, 0.5)


@dataclass(frozen=True)
class Durations:
    """Window lengths in ms, and how long calibration lasts."""

    up: int = 5 * 60_000
    down: int = 24 * 3_600_000
    sleep: int = 72 * 3_600_000
    calibrating: int = 5 * 60_000
    calibration: int = 30 * 60_000


class Proposer:
    """A tumbling histogram of samples; once mature it proposes its percentile or, if that is out of bounds, starts anew."""

    def __init__(self, bounds: Bounds, scale: float, length: int, now: int):
        self.bounds, self.scale, self.length = bounds, scale, length
        self.low = scale * bounds.low
        self.width = (scale * bounds.high - self.low) / BUCKETS
        self._restart(now)

    def _restart(self, now: int) -> None:
        self.began, self.counts, self.n = now, [0] * BUCKETS, 0

    def sample(self, now: int, value: float) -> float | None:
        self.counts[min(BUCKETS - 1, max(0, math.ceil((value - self.low) / self.width)))] += 1
        self.n += 1
        if self.n < LEAST_SAMPLES or now - self.began <= self.length:
            return None
        pivot, run, at = int(self.bounds.percentile * self.n), 0, 0
        for at, count in enumerate(self.counts):  # noqa: B007
            run += count
            if run >= pivot:
                break
        proposal = self.low + at * self.width
        if self.scale * self.bounds.least <= proposal <= self.scale * self.bounds.most:
            return proposal
        self._restart(now)
        return None


class ScaleState:
    """Scale of a job group from samples of (ms, scale).

    It starts asleep with scale 0, calibrating if its scale stands for a quota,
    else running.  Calibrating and running groups go up or down by windows of
    their own lengths; tiny ones only go up.  Any change starts both windows
    anew; the window for sleep belongs to the running state and survives its
    changes.  A proposal after the calibration period ends it.  A sample that
    changes the scale is not seen by the windows after the one that took it.
    """

    def __init__(self, now: int, scale: float, from_quota: bool = False, sleeps: bool = True, durations: Durations = Durations()):  # noqa: B008
        self.durations, self.sleeps = durations, sleeps
        if scale == 0:
            self._sleep(now)
        elif from_quota:
            self.since = now
            self._windows(now, scale, True)
        else:
            self._run(now, scale)

    def _windows(self, now: int, scale: float, calibrating: bool) -> None:
        self.mode, self.scale = "CALIBRATING" if calibrating else "RUNNING", scale
        d = self.durations
        self.movers = [Proposer(UP, scale, d.calibrating if calibrating else d.up, now)]
        if scale > IDLE:
            self.movers.append(Proposer(DOWN, scale, d.calibrating if calibrating else d.down, now))

    def _run(self, now: int, scale: float) -> None:
        self._windows(now, scale, False)
        self.sleeper = Proposer(SLEEP, scale, self.durations.sleep, now) if self.sleeps else None

    def _sleep(self, now: int) -> None:
        self.mode, self.scale = "HIBERNATE", 0.0
        self.waker = Proposer(WAKE, BOOTSTRAP, self.durations.up, now)

    def snapshot(self) -> tuple[str, float, list[int]]:
        """Mode, scale and the samples that each window holds."""
        held = [self.waker] if self.mode == "HIBERNATE" else [*self.movers, *([self.sleeper] if self.mode == "RUNNING" and self.sleeper is not None else [])]
        return self.mode, self.scale, [p.n for p in held]

    def sample(self, now: int, value: float) -> float:
        if self.mode == "HIBERNATE":
            proposal = self.waker.sample(now, value)
            if proposal is not None:
                self._run(now, proposal)
            return self.scale
        for mover in self.movers:
            proposal = mover.sample(now, value)
            if proposal is None:
                continue
            if self.mode == "RUNNING":
                self._windows(now, proposal, False)
            elif now - self.since > self.durations.calibration:
                self._run(now, proposal)
            else:
                self._windows(now, proposal, True)
            return self.scale
        if self.mode == "RUNNING" and self.sleeper is not None and self.sleeper.sample(now, value) is not None:
            self._sleep(now)
        return self.scale
