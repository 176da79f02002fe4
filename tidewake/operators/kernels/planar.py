"""Nine-state planar filter: position, velocity, yaw, forward-acceleration bias, yaw-rate bias."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .rotation import wrap
from .solving import solve

GRAVITY = 9.80665
# Initial deviations and process noise per step, by state.
INITIAL = np.array([10**0.5] * 3 + [1.0] * 3 + [np.deg2rad(5.0), 0.2, 0.02])
PROCESS = np.array([0.05] * 3 + [0.10] * 3 + [0.01, 5e-3, 1e-4])


@dataclass
class Planar:
    """A batch of filters: ``x`` (n, 9), ``p`` (n, 9, 9)."""

    x: np.ndarray
    p: np.ndarray
    dt: float = 0.1

    @staticmethod
    def start(n: int, dt: float = 0.1) -> Planar:
        return Planar(np.zeros((n, 9)), np.tile(np.diag(INITIAL**2), (n, 1, 1)), dt)

    def move(self, x: np.ndarray, acc: np.ndarray, rate: np.ndarray, pitch: np.ndarray) -> np.ndarray:
        """One step of the motion model."""
        dt, out = self.dt, x.copy()
        c, s = np.cos(x[:, 6]), np.sin(x[:, 6])
        a = acc - x[:, 7] - GRAVITY * np.sin(pitch)
        w = rate - x[:, 8]
        v = x[:, 3] * c + x[:, 4] * s
        push = np.stack([a * c - v * w * s, a * s + v * w * c, a * np.sin(pitch) - 0.5 * x[:, 5]], 1)
        out[:, :3] += x[:, 3:6] * dt + 0.5 * push * dt * dt
        out[:, 3:6] += push * dt
        out[:, 6] = wrap(x[:, 6] + w * dt)
        return out

    def jacobian(self, x: np.ndarray, acc: np.ndarray, rate: np.ndarray, pitch: np.ndarray) -> np.ndarray:
        """Derivative of :meth:`move`: the acceleration's derivative first, then its two integrals."""
        n, dt = len(x), self.dt
        c, s, sp = np.cos(x[:, 6]), np.sin(x[:, 6]), np.sin(pitch)
        a, w = acc - x[:, 7] - GRAVITY * sp, rate - x[:, 8]
        v, side = x[:, 3] * c + x[:, 4] * s, -x[:, 3] * s + x[:, 4] * c
        push = np.zeros((n, 3, 9))
        push[:, 0, 3], push[:, 0, 4] = -w * s * c, -w * s * s
        push[:, 1, 3], push[:, 1, 4] = w * c * c, w * s * c
        push[:, 2, 5] = -0.5
        push[:, 0, 6] = -a * s - w * (side * s + v * c)
        push[:, 1, 6] = a * c + w * (side * c - v * s)
        push[:, 0, 7], push[:, 1, 7], push[:, 2, 7] = -c, -s, -sp
        push[:, 0, 8], push[:, 1, 8] = v * s, -v * c
        f = np.tile(np.eye(9), (n, 1, 1))
        f[:, [0, 1, 2], [3, 4, 5]] += dt
        f[:, :3] += 0.5 * dt * dt * push
        f[:, 3:6] += dt * push
        f[:, 6, 8] = -dt
        return f

    def predict(self, acc: np.ndarray, rate: np.ndarray, pitch: np.ndarray | float = 0.0) -> None:
        """The covariance moves with the derivative at the state reached."""
        pitch = np.broadcast_to(np.asarray(pitch, float), acc.shape)
        self.x = self.move(self.x, acc, rate, pitch)
        f = self.jacobian(self.x, acc, rate, pitch)
        self.p = f @ self.p @ f.transpose(0, 2, 1) + np.diag(PROCESS**2)

    def update(self, innovation: np.ndarray, h: np.ndarray, r: np.ndarray, gate: float | None = None, where: np.ndarray | None = None) -> np.ndarray:
        """Joseph-form update, multiplied out, of the runs in ``where`` whose innovation passes the gate; returns which were taken."""
        take = np.isfinite(innovation).all(1) & (True if where is None else where)
        at = np.flatnonzero(take)
        if not len(at):
            return take
        p, h, clean = self.p[at], h[at], innovation[at]
        hp = h @ p
        cov = hp @ h.transpose(0, 2, 1) + (r if r.ndim == 2 else r[at])
        both = np.concatenate([hp, clean[..., None]], 2)
        solved, fit = (both / cov, np.ones(len(at), bool)) if cov.shape[1] == 1 else solve(cov, both)
        if gate is not None:
            fit &= (clean * solved[..., -1]).sum(1) <= gate
        if not fit.all():
            take[at[~fit]] = False
            at, p, hp, clean, cov, solved = at[fit], p[fit], hp[fit], clean[fit], cov[fit], solved[fit]
        gain = solved[..., :-1].transpose(0, 2, 1)
        x, lost = self.x[at] + (gain * clean[:, None]).sum(2), gain @ hp
        x[:, 6] = wrap(x[:, 6])
        self.x, self.p = self.x.copy(), self.p.copy()
        self.x[at], self.p[at] = x, p - (lost + lost.transpose(0, 2, 1) - (gain @ cov) @ gain.transpose(0, 2, 1))
        return take

    def _rows(self, m: int) -> np.ndarray:
        return np.zeros((len(self.x), m, 9))

    def position(self, enu: np.ndarray, sigma: float = 3.0, where: np.ndarray | None = None) -> np.ndarray:
        h = self._rows(3)
        h[:, [0, 1, 2], [0, 1, 2]] = 1
        return self.update(enu - self.x[:, :3], h, np.eye(3) * sigma**2, None, where)

    def velocity(self, enu: np.ndarray, sigma: float = 0.1, where: np.ndarray | None = None) -> np.ndarray:
        h = self._rows(3)
        h[:, [0, 1, 2], [3, 4, 5]] = 1
        return self.update(enu - self.x[:, 3:6], h, np.eye(3) * sigma**2, None, where)

    def heading(self, yaw: np.ndarray, sigma: float = 0.05, where: np.ndarray | None = None) -> np.ndarray:
        h = self._rows(1)
        h[:, 0, 6] = 1
        return self.update(wrap(yaw - self.x[:, 6])[:, None], h, np.eye(1) * sigma**2, None, where)

    def speed(self, forward: np.ndarray, sigma: float = 3.0, where: np.ndarray | None = None) -> np.ndarray:
        """A model's forward speed: range 0..60, three-sigma gate, deviation between 1 and 10."""
        c, s = np.cos(self.x[:, 6]), np.sin(self.x[:, 6])
        h = self._rows(1)
        h[:, 0, 3], h[:, 0, 4], h[:, 0, 6] = c, s, -s * self.x[:, 3] + c * self.x[:, 4]
        fit = np.isfinite(forward) & (forward >= 0) & (forward <= 60) & (True if where is None else where)
        return self.update((forward - (c * self.x[:, 3] + s * self.x[:, 4]))[:, None], h, np.eye(1) * np.clip(sigma, 1, 10) ** 2, 9.0, fit)

    def sideways(self, lateral: float | np.ndarray = 0.05, vertical: float = 0.05, where: np.ndarray | None = None) -> np.ndarray:
        """No sideways and no vertical velocity; couples to yaw."""
        c, s = np.cos(self.x[:, 6]), np.sin(self.x[:, 6])
        h = self._rows(2)
        h[:, 0, 3], h[:, 0, 4], h[:, 0, 6], h[:, 1, 5] = -s, c, -c * self.x[:, 3] - s * self.x[:, 4], 1
        r = np.zeros((len(self.x), 2, 2))
        r[:, 0, 0], r[:, 1, 1] = np.asarray(lateral) ** 2, vertical**2
        return self.update(np.stack([s * self.x[:, 3] - c * self.x[:, 4], -self.x[:, 5]], 1), h, r, None, where)

    def standstill(self, rate: np.ndarray, sigma: float = 0.01, rate_sigma: float = 0.001, where: np.ndarray | None = None) -> None:
        """Zero velocity, and the yaw rate read as bias."""
        self.velocity(np.zeros((len(self.x), 3)), sigma, where)
        h = self._rows(1)
        h[:, 0, 8] = 1
        self.update((rate - self.x[:, 8])[:, None], h, np.eye(1) * rate_sigma**2, None, where)
