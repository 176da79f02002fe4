"""Phone-to-vehicle alignment in stages: gravity, an interim level, the forward axis from motion, its sign, and the lock."""

from __future__ import annotations

from collections import deque

import numpy as np

NOT_CALIBRATED, GRAVITY_STAGE, FORWARD_STAGE, CALIBRATED = "NOT_CALIBRATED", "CALIBRATING_GRAVITY", "CALIBRATING_FORWARD", "CALIBRATED"
# Rows of standstill and their most variance, gravity's range, rows and energy of motion, dominance, ring.
STILL_ROWS, STILL_VARIANCE, LIGHT, HEAVY = 15, 0.25, 7.0, 12.5
MOTION_ROWS, ENERGY, DOMINANCE, RING = 5, 0.05, 2.0, 150


def unit(v: np.ndarray, least: float = 1e-4) -> np.ndarray | None:
    size = float(np.linalg.norm(v))
    return v / size if size > least else None


def across(v: np.ndarray, up: np.ndarray) -> np.ndarray:
    """The part of ``v`` (or of its rows) that is level."""
    return v - np.multiply.outer(v @ up, up)


def frame(forward: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Right-handed rotation whose rows are forward, left and up."""
    left = unit(np.cross(up, forward))
    left = np.array([0.0, 1.0, 0.0]) if left is None else left
    return np.stack([np.cross(left, up), left, up])


def level(up: np.ndarray) -> np.ndarray:
    """A rotation with the phone's top (or side, if the top points up) taken as forward, until motion shows better."""
    top = np.array([0.0, 1.0, 0.0]) if abs(up[1]) < 0.9 else np.array([1.0, 0.0, 0.0])
    return frame(unit(across(top, up)), up)


def main_axis(motion: np.ndarray, up: np.ndarray, energy: float, dominance: float | None) -> np.ndarray | None:
    """Level unit vector along which the motion's second moment is largest; None if weak or without one direction."""
    moment = motion.T @ motion / len(motion)
    if not np.isfinite(moment).all() or np.trace(moment) < energy:
        return None
    values, vectors = np.linalg.eigh(moment)
    if dominance is not None and values[1] > 1e-5 and values[2] / (values[1] + 1e-6) < dominance:
        return None
    axis = across(vectors[:, 2], up)
    return unit(axis * np.sign(axis[np.abs(axis).argmax()]))  # of the two signs the one whose largest part is positive


class Staged:
    """One recording's alignment, a frame at a time. It never looks ahead."""

    def __init__(self) -> None:
        self.state, self.rotation, self.up = NOT_CALIBRATED, np.eye(3), None
        self.still: deque[np.ndarray] = deque(maxlen=STILL_ROWS)
        self.motion: deque[np.ndarray] = deque(maxlen=RING)
        self.speeds: deque[float] = deque(maxlen=RING)

    def update(self, acc: np.ndarray, still: bool, speed: float = np.nan, velocities: np.ndarray | None = None) -> str:
        """``speed`` and ``velocities`` (rows of east, north, up; the latest last) may be missing; broken rows change nothing."""
        if self.state != CALIBRATED and np.isfinite(acc).all():
            if self.state != FORWARD_STAGE:
                self._gravity(acc, still)
            if self.state == FORWARD_STAGE and not still:
                self._forward(acc, speed, velocities)
        return self.state

    def _gravity(self, acc: np.ndarray, still: bool) -> None:
        if self.up is None and LIGHT <= np.linalg.norm(acc) <= HEAVY:
            self._upright(acc)
        if not still:
            if self.up is not None:
                self.state = FORWARD_STAGE
            return
        self.state = GRAVITY_STAGE
        self.still.append(acc)
        if len(self.still) == STILL_ROWS:
            rows = np.array(self.still)
            mean = rows.mean(0)
            if np.linalg.norm(rows, axis=1).var() <= STILL_VARIANCE and LIGHT <= np.linalg.norm(mean) <= HEAVY:
                self._upright(mean)
                self.state = FORWARD_STAGE

    def _upright(self, gravity: np.ndarray) -> None:
        self.up = gravity / np.linalg.norm(gravity)
        self.rotation = level(self.up)

    def _forward(self, acc: np.ndarray, speed: float, velocities: np.ndarray | None) -> None:
        self.motion.append(across(acc, self.up))
        if np.isfinite(speed):
            self.speeds.append(speed)
        if len(self.motion) < MOTION_ROWS:
            return
        motion = np.array(self.motion)
        axis = main_axis(motion, self.up, ENERGY, DOMINANCE)
        sign = 0.0 if axis is None else self._sign(axis, motion.mean(0), velocities)
        if sign:
            self.rotation, self.state = frame(sign * axis, self.up), CALIBRATED

    def _sign(self, axis: np.ndarray, push: np.ndarray, velocities: np.ndarray | None) -> float:
        """1 or -1 by the first evidence that speaks: satellite velocity, the speed's change, a burst; 0 if none does."""
        if velocities is not None and len(velocities) > 1 and np.isfinite(velocities).all():
            gained = velocities[-1] - velocities[0]
            if np.linalg.norm(gained[:2]) > 0.5 and abs(axis @ gained) > 1e-3:
                return float(np.sign(axis @ gained))
        along = float(push @ axis)
        if len(self.speeds) >= MOTION_ROWS and abs(self.speeds[-1] - self.speeds[0]) > 0.8 and abs(along) > 1e-3:
            return float(np.sign(along * (self.speeds[-1] - self.speeds[0])))
        return float(np.sign(along)) if np.linalg.norm(push) > 0.4 and abs(along) > 0.1 else 0.0


_NAMES = (NOT_CALIBRATED, GRAVITY_STAGE, FORWARD_STAGE, CALIBRATED)


class Stages:
    """:class:`Staged` of many recordings side by side, without satellite velocities: rings are arrays, a frame of each is one call."""

    def __init__(self, n: int) -> None:
        self.stage, self.rotation = np.zeros(n, np.int8), np.tile(np.eye(3), (n, 1, 1))
        self.up, self.upright = np.tile([0.0, 0.0, 1.0], (n, 1)), np.zeros(n, bool)
        # rings with the number of rows that were ever put in
        self.still, self.rested = np.zeros((n, STILL_ROWS, 3)), np.zeros(n, int)
        self.motion, self.moved = np.zeros((n, RING, 3)), np.zeros(n, int)
        self.speeds, self.known = np.zeros((n, RING)), np.zeros(n, int)

    @property
    def done(self) -> np.ndarray:
        return self.stage == 3

    def states(self) -> list[str]:
        return [_NAMES[k] for k in self.stage]

    def update(self, acc: np.ndarray, still: np.ndarray, speed: np.ndarray, on: np.ndarray) -> None:
        """A frame of each recording in ``on``; see :meth:`Staged.update`."""
        live = on & (self.stage != 3) & np.isfinite(acc).all(1)
        level_ = np.flatnonzero(live & (self.stage != 2))
        if len(level_):
            self._gravity(level_, acc[level_], still[level_])
        ahead = np.flatnonzero(live & (self.stage == 2) & ~still)
        if len(ahead):
            self._forward(ahead, acc[ahead], speed[ahead])

    def _gravity(self, at: np.ndarray, acc: np.ndarray, still: np.ndarray) -> None:
        size = np.linalg.norm(acc, axis=1)
        first = ~self.upright[at] & (LIGHT <= size) & (size <= HEAVY)
        self._upright(at[first], acc[first])
        self.stage[at[~still & self.upright[at]]] = 2
        at, acc = at[still], acc[still]
        self.stage[at] = 1
        self.still[at, self.rested[at] % STILL_ROWS] = acc
        self.rested[at] += 1
        at = at[self.rested[at] >= STILL_ROWS]
        rows = self.still[at]
        mean = rows.mean(1)
        size = np.linalg.norm(mean, axis=1)
        fine = (np.linalg.norm(rows, axis=2).var(1) <= STILL_VARIANCE) & (LIGHT <= size) & (size <= HEAVY)
        self._upright(at[fine], mean[fine])
        self.stage[at[fine]] = 2

    def _upright(self, at: np.ndarray, gravity: np.ndarray) -> None:
        if len(at):
            up = gravity / np.linalg.norm(gravity, axis=1, keepdims=True)
            top = np.where((np.abs(up[:, 1]) < 0.9)[:, None], [0.0, 1.0, 0.0], [1.0, 0.0, 0.0])
            flat = top - (top * up).sum(1, keepdims=True) * up
            self.up[at], self.upright[at] = up, True
            self.rotation[at] = _frames(flat / np.linalg.norm(flat, axis=1, keepdims=True), up)

    def _forward(self, at: np.ndarray, acc: np.ndarray, speed: np.ndarray) -> None:
        up = self.up[at]
        self.motion[at, self.moved[at] % RING] = acc - (acc * up).sum(1, keepdims=True) * up
        self.moved[at] += 1
        seen = np.isfinite(speed)
        self.speeds[at[seen], self.known[at[seen]] % RING] = speed[seen]
        self.known[at[seen]] += 1
        at = at[self.moved[at] >= MOTION_ROWS]
        if not len(at):
            return
        count = np.minimum(self.moved[at], RING)
        motion = self.motion[at, : count.max()]  # rows that were not filled yet are zero
        count = count[:, None]
        with np.errstate(over="ignore", invalid="ignore"):
            moment, push = motion.transpose(0, 2, 1) @ motion / count[..., None], motion.sum(1) / count
        strong = np.isfinite(moment).all((1, 2)) & ~(np.trace(moment, axis1=1, axis2=2) < ENERGY)
        at, moment, push = at[strong], moment[strong], push[strong]
        values, vectors = np.linalg.eigh(moment)
        up, axis = self.up[at], vectors[:, :, 2]
        axis = axis - (axis * up).sum(1, keepdims=True) * up
        axis = axis * np.sign(np.take_along_axis(axis, np.abs(axis).argmax(1)[:, None], 1))
        size = np.linalg.norm(axis, axis=1)
        fine = ~((values[:, 1] > 1e-5) & (values[:, 2] / (values[:, 1] + 1e-6) < DOMINANCE)) & (size > 1e-4)
        axis = axis / np.where(fine, size, 1.0)[:, None]
        along, known = (push * axis).sum(1), self.known[at]
        ring = self.speeds[at]
        rows = np.arange(len(at))
        gained = ring[rows, (known - 1) % RING] - ring[rows, np.where(known > RING, known % RING, 0)]
        by_speed = (known >= MOTION_ROWS) & (np.abs(gained) > 0.8) & (np.abs(along) > 1e-3)
        burst = (np.linalg.norm(push, axis=1) > 0.4) & (np.abs(along) > 0.1)
        sign = np.where(by_speed, np.sign(along * gained), np.where(burst, np.sign(along), 0.0))
        found = fine & (sign != 0)
        self.rotation[at[found]], self.stage[at[found]] = _frames(sign[found, None] * axis[found], up[found]), 3


def _frames(forward: np.ndarray, up: np.ndarray) -> np.ndarray:
    """:func:`frame` of each row."""
    left = np.cross(up, forward)
    size = np.linalg.norm(left, axis=1, keepdims=True)
    left = np.where(size > 1e-4, left / np.where(size > 1e-4, size, 1.0), [0.0, 1.0, 0.0])
    return np.stack([np.cross(left, up), left, up], 1)


def whole(still: np.ndarray, motion: np.ndarray, velocities: np.ndarray | None = None) -> tuple[np.ndarray, str]:
    """(rotation, state) from a stretch of standstill and one of motion, each (rows, 3); broken rows are left out."""
    still, motion = (x[np.isfinite(x).all(1)] for x in (still, motion))
    up = unit(still.mean(0), 1e-3) if len(still) else None
    up = np.array([0.0, 0.0, 1.0]) if up is None else up
    flat = across(motion, up)
    axis = main_axis(flat, up, 1e-5, None) if len(motion) > 1 else None
    if axis is None:
        return level(up), FORWARD_STAGE
    if velocities is not None and len(velocities) > 1:
        gained = velocities[-1] - velocities[0]
        axis = -axis if np.isfinite(velocities).all() and axis @ gained < 0 else axis
    elif axis @ flat.mean(0) < 0 and np.linalg.norm(flat.mean(0)) > 0.05:
        axis = -axis
    return frame(axis, up), CALIBRATED
