"""The live frame step: clock, standstill, alignment, filter, trust, outage and return, for many devices side by side.

A :class:`Frames` holds one state for each of ``n`` devices; :meth:`Frames.step`
takes one frame of each. Batch jobs advance a bucket of recordings together,
the stream processor a single device, so both give the same rows.
"""

from __future__ import annotations

import numpy as np

from .alignment import Stages
from .inertial import Inertial
from .planar import Planar
from .rotation import wrap
from .solving import solve

GRAVITY = 9.80665
# Nominal step, the range of a believed step, seconds until a fix is stale, rows of a return's blend.
STEP, LEAST_STEP, MOST_STEP = 0.1, 0.001, 0.5
STALE = 6.0
BLEND = 15
TRUSTED, DEGRADED, JUMP, SPOOFED, BLACKOUT = "TRUSTED", "DEGRADED", "SUSPICIOUS_JUMP", "REJECTED_SPOOFED", "BLACKOUT"

#: What a frame holds. Fix columns are NaN where the frame carries none; a fix is repeated until a new one comes.
INPUTS = ("t", "ax", "ay", "az", "gx", "gy", "gz", "yaw", "east", "north", "fix_t", "accuracy", "fix_speed", "fix_heading", "denied", "model_speed")
#: What a step returns, with its type.
OUTPUTS = {"pe": "double", "pn": "double", "v": "double", "heading": "double", "sd": "double", "mode": "string", "status": "string", "score": "double", "still": "boolean", "blackout": "boolean", "aligned": "boolean", "out_of_order": "boolean", "dark_metres": "double"}


def _nan(n: int) -> np.ndarray:
    return np.full(n, np.nan)


class Frames:
    def __init__(self, n: int, kind: str = "inertial"):
        self.kind = kind
        self.filter = Planar.start(n) if kind == "planar" else Inertial.start(n)
        self.aligner = Stages(n)
        self.clock, self.levelled = _nan(n), np.zeros(n, bool)
        self.ring, self.pushed, self.calm = np.zeros((n, 10, 6)), np.zeros(n, int), np.zeros(n, int)
        # the last fix seen, the last trusted one, and the trust in them
        self.seen = np.full((n, 3), np.nan)
        self.good = np.full((n, 3), np.nan)
        self.score, self.rejected = np.ones(n), np.zeros(n, int)
        self.status = np.full(n, DEGRADED, object)
        self.arrived, self.valid, self.anchored = _nan(n), np.zeros(n, bool), np.zeros(n, bool)
        self.origin = np.zeros((n, 2))
        # outage and return
        self.dark, self.dark_at, self.dark_metres = np.zeros(n, bool), np.zeros((n, 2)), np.zeros(n)
        self.blend, self.target = np.full(n, BLEND), np.zeros((n, 2))

    @property
    def n(self) -> int:
        return len(self.clock)

    # -- the filter's view -------------------------------------------------

    def position(self) -> np.ndarray:
        return (self.filter.x if self.kind == "planar" else self.filter.p)[:, :2]

    def velocity(self) -> np.ndarray:
        return self.filter.x[:, 3:6] if self.kind == "planar" else self.filter.v

    def yaw(self) -> np.ndarray:
        if self.kind == "planar":
            return self.filter.x[:, 6]
        return np.arctan2(self.filter.body[:, 1, 0], self.filter.body[:, 0, 0])

    def spread(self) -> np.ndarray:
        return (self.filter.p if self.kind == "planar" else self.filter.cov)[:, :2, :2]

    # -- parts of a step ---------------------------------------------------

    def _time(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gone = t - self.clock
        late = gone <= 0
        dt = np.where((gone >= LEAST_STEP) & (gone <= MOST_STEP), gone, STEP)
        self.clock = t.copy()
        return dt, late

    def _still(self, acc: np.ndarray, gyro: np.ndarray, speed: np.ndarray, on: np.ndarray) -> np.ndarray:
        """Ten calm rows and two of them in a row; a satellite speed above 0.8 m/s vetoes."""
        veto = speed > 0.8
        push = on & ~veto
        self.ring[push] = np.concatenate([self.ring[push, 1:], np.concatenate([acc, gyro], 1)[push, None]], 1)
        self.pushed += push
        size = np.linalg.norm(self.ring[:, :, :3], axis=2)
        rate = np.linalg.norm(self.ring[:, :, 3:], axis=2)
        mean = self.ring.mean(1)
        calm = (np.abs(np.linalg.norm(mean[:, :3], axis=1) - GRAVITY) <= 1.2) & (size.var(1) < 0.15) & (np.linalg.norm(mean[:, 3:], axis=1) < 0.05) & (rate.max(1) < 0.125)
        self.calm = np.where(push & (self.pushed >= 10) & calm, self.calm + 1, 0)
        return (self.calm >= 2) & (np.linalg.norm(acc - GRAVITY * self.aligner.up, axis=1) <= 0.40)

    def _judge(self, fix: np.ndarray, accuracy: np.ndarray, t: np.ndarray, new: np.ndarray) -> np.ndarray:
        """The trust engine on the new fixes; which of them are taken."""
        off = fix - self.position()
        own = np.where(np.isfinite(accuracy) & (accuracy != 0), accuracy, 3.0)
        cov = self.spread() + own[:, None, None] ** 2 * np.eye(2)
        far = np.sqrt(np.maximum(0, (off * solve(cov, off[..., None])[0][..., 0]).sum(1)))
        moved = np.hypot(*(fix - self.good[:, :2]).T)
        quick = moved / np.maximum(t - self.good[:, 2], 1e-3) > np.hypot(*self.velocity()[:, :2].T) * 2.5 + 15
        case = np.select([accuracy > 50, (moved > 25) & quick, (far > 3.5) & (self.rejected > 15), far > 3.5], [0, 1, 2, 3], 4)
        goal = np.choose(case, [0.2, 0.0, 0.5, np.maximum(0, 1 - (far - 3.5) * 0.2), 1.0])
        self.score = np.where(new, np.clip(0.75 * self.score + 0.25 * goal, 0, 1), self.score)
        names = np.array([DEGRADED, JUMP, DEGRADED, SPOOFED, TRUSTED], object)[case]
        self.status = np.where(new, np.where((case == 3) & (far <= 6), JUMP, names), self.status)
        self.rejected = np.where(new, np.choose(case, [self.rejected + 1, self.rejected + 1, self.rejected, self.rejected + 1, 0]), self.rejected)
        passed = new & (case == 4)
        self.good[passed] = np.column_stack([fix, t])[passed]
        return new & ((case == 4) | (case == 2))

    # -- a step ------------------------------------------------------------

    def step(self, a: dict[str, np.ndarray], on: np.ndarray) -> dict[str, np.ndarray]:
        """One frame of each device in ``on``; the others' answers are void."""
        f = self.filter
        acc, gyro = (np.stack([a[c] for c in names], 1) for names in (("ax", "ay", "az"), ("gx", "gy", "gz")))
        broken = ~np.isfinite(acc).all(1)
        acc = np.nan_to_num(acc, nan=0.0, posinf=9.81, neginf=-9.81)
        acc[broken & (np.linalg.norm(acc, axis=1) < 1e-3), 2] = 9.81
        gyro = np.nan_to_num(gyro, nan=0.0, posinf=0.0, neginf=0.0)
        dt, late = self._time(a["t"])
        has_fix = np.isfinite(a["east"]) & np.isfinite(a["north"])
        still = self._still(acc, gyro, np.where(has_fix & self.anchored, a["fix_speed"], np.nan), on) & on
        self.aligner.update(acc, still, np.where(has_fix, a["fix_speed"], np.nan), on)
        acc, gyro = (np.einsum("nij,nj->ni", self.aligner.rotation, x) for x in (acc, gyro))
        compass = wrap(np.deg2rad(90.0 - a["yaw"]))

        if self.kind == "planar":
            f.predict(acc[:, 0], gyro[:, 2])
            f.heading(compass, 0.15**0.5, where=still & np.isfinite(compass))
        else:
            first = on & ~self.levelled
            if first.any():
                fresh = Inertial.start(self.n)
                fresh.level(acc, np.nan_to_num(compass))
                f.q[first], self.levelled = fresh.q[first], self.levelled | first
            f.predict(acc, gyro, dt)
            slow = ~(a["fix_speed"] >= 1.5)
            flat = np.stack([np.zeros(self.n), np.zeros(self.n), np.where(slow, compass, np.nan)], 1)
            f.attitude(flat, 0.08, where=on)
            if still.any():
                f.attitude(np.stack([np.zeros(self.n), np.zeros(self.n), compass], 1), 0.04, where=still)
        if still.any():
            f.standstill(gyro[:, 2] if self.kind == "planar" else gyro, where=still)

        allowed = has_fix & on & ~(a["denied"] > 0.5)
        raw = np.stack([a["east"], a["north"], a["fix_t"]], 1)
        again = (np.abs(raw[:, 2] - self.seen[:, 2]) <= 1e-4) & (np.abs(raw[:, :2] - self.seen[:, :2]) <= 1e-4).all(1)
        new = allowed & ~again
        anchor = new & np.isnan(self.arrived)
        self.origin[anchor] = raw[anchor, :2]
        self.arrived = np.where(new, a["t"], self.arrived)
        fix = raw[:, :2] - self.origin
        taken = self._judge(np.nan_to_num(fix), a["accuracy"], a["t"], new)
        self.seen[new] = raw[new]
        back = taken & self.dark
        self.blend = np.where(back, 0, self.blend)
        self.dark &= ~back
        self.target[taken] = fix[taken]
        own = np.where(np.isfinite(a["accuracy"]) & (a["accuracy"] != 0), a["accuracy"], 3.0)
        for sigma in np.unique(own[taken]).tolist():  # few: receivers report round figures
            f.position(np.column_stack([np.nan_to_num(fix), np.zeros(self.n)]), sigma, where=taken & (own == sigma))
        course = wrap(np.deg2rad(90.0 - a["fix_heading"]))
        fast = taken & (a["fix_speed"] >= 1.5) & np.isfinite(course)
        f.heading(course, 0.05**0.5 if self.kind == "planar" else 0.05, where=fast)
        if self.kind != "planar":
            way = np.where(fast, course, self.yaw())
            v = np.nan_to_num(np.stack([a["fix_speed"] * np.cos(way), a["fix_speed"] * np.sin(way), np.zeros(self.n)], 1))
            f.velocity(v, where=taken & (a["fix_speed"] >= 0.5))
        self.anchored |= taken
        held = ~new & np.isfinite(self.arrived) & ~(a["denied"] > 0.5) & (a["t"] - self.arrived <= STALE) & self.valid
        fine = taken | held
        self.valid = np.where(on, fine, self.valid)
        shown = np.where(new | held, self.status, np.where(self.anchored | np.isfinite(self.arrived) | (a["denied"] > 0.5), BLACKOUT, DEGRADED))
        trust = np.where(new | held, self.score, 0.0)

        lost = on & ~fine & (self.anchored | (a["denied"] > 0.5))
        enter = lost & ~self.dark
        self.dark |= enter
        self.dark_at[enter] = self.position()[enter]
        loose = on & ~fine & ~still
        if loose.any():
            f.sideways(where=loose)
        model = on & ~fine & np.isfinite(a["model_speed"])
        if model.any():
            f.speed(np.where(still, 0.0, a["model_speed"]), 1.5, where=model)
        gone = np.hypot(*(self.position() - self.dark_at).T)
        self.dark_metres += np.where(on & ~fine & ~still & self.dark, gone, 0.0)
        self.dark_at = np.where((on & ~fine)[:, None], self.position(), self.dark_at)

        mode = np.where(fine, np.where(trust > 0.7, "GNSS", "GNSS_DEGRADED"), np.where(np.nan_to_num(a["model_speed"]) > 0.1, "DEAD_RECKONING_MODEL", "DEAD_RECKONING"))
        mode = np.where(still, "STATIONARY", mode)
        blending = on & (self.blend < BLEND)
        w = 0.5 * (1 - np.cos(np.pi * (self.blend + 1) / BLEND))
        out = np.where(blending[:, None], (1 - w)[:, None] * self.position() + w[:, None] * self.target, self.position()) + self.origin
        mode = np.where(blending, "REACQUISITION", mode)
        self.blend = self.blend + blending
        if still.any() and self.kind != "planar":
            f.v[still] = 0.0
        yaw, v = self.yaw(), self.velocity()
        return {
            "pe": out[:, 0], "pn": out[:, 1], "v": np.where(still, 0.0, v[:, 0] * np.cos(yaw) + v[:, 1] * np.sin(yaw)), "heading": (90 - np.rad2deg(yaw)) % 360,
            "sd": np.sqrt(np.maximum(np.trace(self.spread(), axis1=1, axis2=2), 0)), "mode": mode, "status": shown, "score": trust, "still": still, "blackout": self.dark.copy(),
            "aligned": self.aligner.done, "out_of_order": late & on, "dark_metres": self.dark_metres.copy(),
        }
