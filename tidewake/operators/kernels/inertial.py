"""Fifteen-state error-state filter: position, velocity, attitude, accelerometer and gyro biases."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import rotation as rot
from .solving import solve

GRAVITY = np.array([0.0, 0.0, -9.80665])
# Noise densities, initial deviations, chi-square gates at 99 %.
NOISE = {"acc": 0.1, "gyro": 0.01, "acc_walk": 0.001, "gyro_walk": 0.0001}
INITIAL = np.repeat([5.0, 0.5, 0.05, 0.05, 0.005], 3)
GATES = {1: 6.635, 2: 9.210, 3: 11.345}
MOST_SPEED = 80.0
_TURN = [6, 7, 8, 12, 13, 14]
POLICIES = ("decouple", "disable_lateral", "coupled")


def _nobody(where: np.ndarray | None) -> bool:
    return where is not None and not where.any()


@dataclass
class Inertial:
    """A batch of filters: p, v, ba, bg (n, 3), q (n, 4), cov (n, 15, 15)."""

    p: np.ndarray
    v: np.ndarray
    q: np.ndarray
    ba: np.ndarray
    bg: np.ndarray
    cov: np.ndarray
    rate: np.ndarray

    @staticmethod
    def start(n: int) -> Inertial:
        z = lambda: np.zeros((n, 3))
        q = np.zeros((n, 4))
        q[:, 0] = 1
        return Inertial(z(), z(), q, z(), z(), np.tile(np.diag(INITIAL**2), (n, 1, 1)), z())

    @property
    def body(self) -> np.ndarray:
        """Rotation body to east-north-up."""
        return rot.matrix(self.q)

    @property
    def body_velocity(self) -> np.ndarray:
        return rot.turned(self.body.transpose(0, 2, 1), self.v)

    def level(self, acc: np.ndarray, yaw: np.ndarray) -> None:
        """Roll and pitch from gravity, yaw given; the norm's excess becomes bias."""
        size = np.linalg.norm(acc, axis=1, keepdims=True)
        bad = ~np.isfinite(acc).all(1) | (size[:, 0] < 1e-3)
        acc = np.where(bad[:, None], -GRAVITY, acc)
        size = np.linalg.norm(acc, axis=1, keepdims=True)
        u = acc / size
        self.q = rot.of_euler(np.arctan2(u[:, 1], u[:, 2]), np.arcsin(np.clip(-u[:, 0], -1, 1)), yaw)
        self.ba = (size + GRAVITY[2]) * u

    def transition(self, force: np.ndarray, omega: np.ndarray, dt: np.ndarray) -> np.ndarray:
        """The derivative F of a step, whole; :meth:`moved` applies its blocks."""
        f = np.zeros((len(self.p), 15, 15))
        push, spin = self.blocks(self.body, force, omega, dt)
        dt = dt[:, None, None]
        f[:, range(15), range(15)] = 1
        f[:, :3, 3:6] = np.eye(3) * dt
        f[:, :3, 6:12], f[:, 3:6, 6:12] = 0.5 * dt * push, push
        f[:, 6:9, 6:9], f[:, 6:9, 12:15] = spin[:, :, :3], spin[:, :, 3:]
        return f

    @staticmethod
    def blocks(r: np.ndarray, force: np.ndarray, omega: np.ndarray, dt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Velocity by attitude and accelerometer bias, attitude by itself and gyroscope bias: (n, 3, 6) each."""
        push, spin, dt = np.empty((len(r), 3, 6)), np.empty((len(r), 3, 6)), dt[:, None, None]
        x, y, z = (force[:, k, None] for k in range(3))
        # -R [force]x by columns, then -R
        push[:, :, 0], push[:, :, 1], push[:, :, 2] = r[:, :, 2] * y - r[:, :, 1] * z, r[:, :, 0] * z - r[:, :, 2] * x, r[:, :, 1] * x - r[:, :, 0] * y
        push[:, :, 3:] = -r
        turn = omega * dt[:, 0]
        spin[:, :, :3] = rot.matrix(rot.exponential(-turn))
        spin[:, :, 3:] = rot.right_jacobian(turn) * -dt
        return push * dt, spin

    def moved(self, r: np.ndarray, force: np.ndarray, omega: np.ndarray, dt: np.ndarray) -> np.ndarray:
        """F cov F' for the transition F, by its blocks: rows first, then columns."""
        (push, spin), cov = self.blocks(r, force, omega, dt), self.cov.copy()
        dt = dt[:, None, None]
        pushed, spun = push @ cov[:, 6:12], spin @ cov[:, _TURN]
        cov[:, :3] += dt * (cov[:, 3:6] + 0.5 * pushed)
        cov[:, 3:6] += pushed
        cov[:, 6:9] = spun
        push, spin = push.transpose(0, 2, 1), spin.transpose(0, 2, 1)
        pushed, spun = cov[:, :, 6:12] @ push, cov[:, :, _TURN] @ spin
        cov[:, :, :3] += dt * (cov[:, :, 3:6] + 0.5 * pushed)
        cov[:, :, 3:6] += pushed
        cov[:, :, 6:9] = spun
        return cov

    def predict(self, acc: np.ndarray, gyro: np.ndarray, dt: np.ndarray | float = 0.1) -> None:
        dt = np.broadcast_to(np.asarray(dt, float), (len(self.p),))
        dt = np.where(np.isfinite(dt) & (dt > 0) & (dt <= 1), dt, 0.1)
        acc = np.nan_to_num(acc, nan=0.0, posinf=9.81, neginf=-9.81)
        gyro = np.nan_to_num(gyro, nan=0.0, posinf=0.0, neginf=0.0)
        self.rate = gyro
        force, omega = acc - self.ba, gyro - self.bg
        q = rot.product(self.q, rot.exponential(omega * dt[:, None]))
        self.q = q / np.sqrt((q * q).sum(1, keepdims=True))
        r = self.body
        push = rot.turned(r, force) + GRAVITY
        self.p = self.p + self.v * dt[:, None] + 0.5 * push * dt[:, None] ** 2
        v = self.v + push * dt[:, None]
        self.v = v * np.minimum(1.0, MOST_SPEED / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-9))
        cov = self.moved(r, force, omega, dt)
        noise = np.zeros((len(dt), 15))
        for k, (density, power) in enumerate(((NOISE["acc"] / 2, 4), (NOISE["acc"], 1), (NOISE["gyro"], 1), (NOISE["acc_walk"], 1), (NOISE["gyro_walk"], 1))):
            noise[:, 3 * k : 3 * k + 3] = (density**2 * dt**power)[:, None]
        cov = (cov + cov.transpose(0, 2, 1)) / 2
        cov.reshape(len(dt), 225)[:, ::16] += noise
        self.cov = cov

    def update(self, innovation: np.ndarray, h: np.ndarray | slice, r: np.ndarray, gate: float | None = None, where: np.ndarray | None = None) -> np.ndarray:
        """Gated Joseph update, multiplied out, error injection and covariance reset; returns which runs took it.

        Only the runs in ``where`` are worked on. ``h`` is a derivative for each
        run, or the slice of states that is measured itself.
        """
        take = np.isfinite(innovation).all(1) & (True if where is None else where)
        at = np.flatnonzero(take)
        if not len(at):
            return take
        whole = len(at) == len(take)
        pick = (lambda x: x) if whole else (lambda x: x[at])
        cov, clean = pick(self.cov), pick(innovation)
        if isinstance(h, slice):
            hc = cov[:, h]
            s = hc[:, :, h] + (r if r.ndim == 2 else pick(r))
        else:
            h = pick(h)
            hc = h @ cov
            s = hc @ h.transpose(0, 2, 1) + (r if r.ndim == 2 else pick(r))
        both = np.concatenate([hc, clean[..., None]], 2)
        solved, fit = (both / s, np.ones(len(at), bool)) if s.shape[1] == 1 else solve(s, both)
        if gate is not None:
            fit &= (clean * solved[..., -1]).sum(1) <= gate
        if not fit.all():
            take[at[~fit]] = False
            at, whole, cov, clean, hc, s, solved = at[fit], False, cov[fit], clean[fit], hc[fit], s[fit], solved[fit]
            if not len(at):
                return take
        gain = solved[..., :-1].transpose(0, 2, 1)
        step = rot.turned(gain, clean) if gain.shape[2] == 3 else (gain * clean[:, None]).sum(2)
        lost = gain @ hc
        cov = cov - (lost + lost.transpose(0, 2, 1) - (gain @ s) @ gain.transpose(0, 2, 1))
        half = 0.5 * rot.skew(step[:, 6:9])
        cov[:, 6:9] -= half @ cov[:, 6:9]
        cov[:, :, 6:9] -= cov[:, :, 6:9] @ half.transpose(0, 2, 1)
        cov = (cov + cov.transpose(0, 2, 1)) / 2
        q = rot.product(self.q if whole else self.q[at], rot.exponential(step[:, 6:9]))
        q /= np.sqrt((q * q).sum(1, keepdims=True))
        if whole:
            self.p, self.v, self.ba, self.bg, self.q, self.cov = self.p + step[:, :3], self.v + step[:, 3:6], self.ba + step[:, 9:12], self.bg + step[:, 12:15], q, cov
            return take
        for name, value in (("p", self.p[at] + step[:, :3]), ("v", self.v[at] + step[:, 3:6]), ("ba", self.ba[at] + step[:, 9:12]), ("bg", self.bg[at] + step[:, 12:15]), ("q", q), ("cov", cov)):
            held = getattr(self, name).copy()
            held[at] = value
            setattr(self, name, held)
        return take

    def _rows(self, m: int) -> np.ndarray:
        return np.zeros((len(self.p), m, 15))

    def velocity_jacobian(self, axes: tuple[int, ...]) -> np.ndarray:
        """Derivative of the given components of the body's velocity, which is R'v: R' by velocity, [R'v]x by attitude."""
        at = list(axes)
        h = self._rows(len(at))
        h[:, :, 3:6] = self.body.transpose(0, 2, 1)[:, at]
        h[:, :, 6:9] = rot.skew(self.body_velocity)[:, at]
        return h

    def position(self, enu: np.ndarray, sigma: float = 3.0, trusted: bool = True, where: np.ndarray | None = None) -> np.ndarray:
        return self.update(enu - self.p, slice(0, 3), np.diag([sigma**2, sigma**2, 4 * sigma**2]), None if trusted else GATES[3], where)

    def velocity(self, enu: np.ndarray, sigma: float = 0.2, trusted: bool = True, where: np.ndarray | None = None) -> np.ndarray:
        return self.update(enu - self.v, slice(3, 6), np.eye(3) * sigma**2, None if trusted else GATES[3], where)

    def speed(self, forward: np.ndarray, sigma: float = 1.5, where: np.ndarray | None = None) -> np.ndarray:
        """A model's forward speed (0..80); a run that is fast while the model says slow is anchored anew."""
        if _nobody(where):
            return np.zeros(len(self.p), bool)
        sigma = float(np.clip(sigma, 0.5, 10.0))
        r, vb = self.body, self.body_velocity
        h = self.velocity_jacobian((0,))
        fit = np.isfinite(forward) & (forward >= 0) & (forward <= 80) & (True if where is None else where)
        took = self.update((forward - vb[:, 0])[:, None], h, np.eye(1) * sigma**2, 9.0, fit)
        anchor = fit & ~took & (np.abs(vb[:, 0]) > 15) & (forward < 5)
        if anchor.any():
            vb[anchor, 0] = forward[anchor]
            self.v[anchor] = (r[anchor] @ vb[anchor][..., None])[..., 0]
            self.cov[anchor, 3:6, 3:6] = np.eye(3) * 4 * sigma**2
        return took | anchor

    def attitude(self, angles: np.ndarray, sigma: float = 0.08, floor: bool = True, where: np.ndarray | None = None) -> np.ndarray:
        """Roll, pitch and yaw measured; NaN angles are left out. ``floor`` keeps the prior variance at 4 sigma^2 at least."""
        known = np.isfinite(angles) & (np.ones(len(self.p), bool) if where is None else where)[:, None]
        for k in range(3):
            if floor:
                at = self.cov[:, 6 + k, 6 + k]
                self.cov[:, 6 + k, 6 + k] = np.where(known[:, k] & (at < 4 * sigma**2), 4 * sigma**2, at)
        off = rot.wrap(np.where(known, angles, 0) - rot.euler(self.body))
        r = np.zeros((len(self.p), 3, 3))
        r[:, range(3), range(3)] = np.where(known, sigma**2, 1e12)
        return self.update(np.where(known, off, 0.0), slice(6, 9), r, None, known.any(1))

    def heading(self, yaw: np.ndarray, sigma: float = 0.05, where: np.ndarray | None = None) -> np.ndarray:
        h = self._rows(1)
        h[:, 0, 6:9] = self.body[:, 2, :]  # the body's turn about the vertical
        return self.update(rot.wrap(yaw - rot.euler(self.body)[:, 2])[:, None], h, np.eye(1) * sigma**2, None, where)

    def sideways(self, lateral: float = 0.05, vertical: float = 0.05, policy: str = "decouple", cornering: float = 0.5, where: np.ndarray | None = None) -> np.ndarray:
        """No sideways and no vertical body velocity. In sharp turns the policy decouples the sideways row from attitude or drops it."""
        if _nobody(where):
            return np.zeros(len(self.p), bool)
        vb = self.body_velocity
        turning = np.abs((self.rate[:, 2] - self.bg[:, 2]) * vb[:, 0]) > cornering
        h = self.velocity_jacobian((1, 2))
        if policy == "decouple":
            h[turning, 0, 6:9] = 0
        cov = np.tile(np.diag([lateral**2, vertical**2]), (len(vb), 1, 1))
        if policy == "disable_lateral":
            cov[turning, 0, 0] = 1e12
        return self.update(-vb[:, 1:], h, cov, GATES[2], where)

    def standstill(self, gyro: np.ndarray, sigma: float = 0.01, rate_sigma: float = 0.001, where: np.ndarray | None = None) -> None:
        self.velocity(np.zeros_like(self.v), sigma, True, where)
        self.update(gyro - self.bg, slice(12, 15), np.eye(3) * rate_sigma**2, None, where)

    def gravity(self, acc: np.ndarray, sigma: float | np.ndarray = 0.5, forward: np.ndarray | float = 0.0, where: np.ndarray | None = None) -> np.ndarray:
        """Levelling by the two horizontal body axes, gated at 99 %.

        The specific force less the motion's own acceleration (``forward`` along
        the body, yaw rate times speed across it) and less the bias must be
        gravity's reaction. ``sigma`` is one deviation or one a run and axis.
        """
        across = (self.rate[:, 2] - self.bg[:, 2]) * self.body_velocity[:, 0]
        up = -GRAVITY[2] * self.body[:, 2, :]
        h = self._rows(2)
        h[:, :, 6:9], h[:, [0, 1], [9, 10]] = rot.skew(up)[:, :2], 1
        r = np.zeros((len(up), 2, 2))
        r[:, [0, 1], [0, 1]] = np.broadcast_to(np.asarray(sigma, float) ** 2, (len(up), 2))
        moving = np.stack([np.broadcast_to(np.asarray(forward, float), across.shape), across], 1)
        return self.update(acc[:, :2] - moving - self.ba[:, :2] - up[:, :2], h, r, GATES[2], where)

    def deviations(self) -> dict[str, np.ndarray]:
        """Mean standard deviation of each block."""
        d = np.sqrt(np.maximum(self.cov[:, range(15), range(15)], 0))
        return {name: d[:, 3 * k : 3 * k + 3].mean(1) for k, name in enumerate(("position", "velocity", "attitude", "acc_bias", "gyro_bias"))}
