"""Quaternions (w, x, y, z) and rotations; the last axes are the object's own."""

import numpy as np


def skew(v: np.ndarray) -> np.ndarray:
    out = np.zeros((*v.shape, 3))
    out[..., 2, 1], out[..., 0, 2], out[..., 1, 0] = v[..., 0], v[..., 1], v[..., 2]
    out[..., 1, 2], out[..., 2, 0], out[..., 0, 1] = -v[..., 0], -v[..., 1], -v[..., 2]
    return out


def matrix(q: np.ndarray) -> np.ndarray:
    """Body to navigation frame."""
    w, x, y, z = (q[..., k] for k in range(4))
    xx, yy, zz, xy, xz, yz, wx, wy, wz = x * x, y * y, z * z, x * y, x * z, y * z, w * x, w * y, w * z
    out = np.empty((*q.shape[:-1], 3, 3))
    out[..., 0, 0], out[..., 1, 1], out[..., 2, 2] = 1 - 2 * (yy + zz), 1 - 2 * (xx + zz), 1 - 2 * (xx + yy)
    out[..., 0, 1], out[..., 1, 0] = 2 * (xy - wz), 2 * (xy + wz)
    out[..., 0, 2], out[..., 2, 0] = 2 * (xz + wy), 2 * (xz - wy)
    out[..., 1, 2], out[..., 2, 1] = 2 * (yz - wx), 2 * (yz + wx)
    return out


def turned(r: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Each vector by its own matrix; a sum of three columns, which is faster than many small matrix products."""
    return r[..., 0] * v[..., 0:1] + r[..., 1] * v[..., 1:2] + r[..., 2] * v[..., 2:3]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    (aw, ax, ay, az), (bw, bx, by, bz) = ([q[..., k] for k in range(4)] for q in (a, b))
    parts = (aw * bw - (ax * bx + ay * by + az * bz), aw * bx + bw * ax + (ay * bz - az * by), aw * by + bw * ay + (az * bx - ax * bz), aw * bz + bw * az + (ax * by - ay * bx))
    return np.stack(parts, -1)


def exponential(theta: np.ndarray) -> np.ndarray:
    """Quaternion of a rotation vector."""
    half = np.sqrt((theta * theta).sum(-1, keepdims=True)) / 2
    return np.concatenate([np.cos(half), theta / 2 * np.sinc(half / np.pi)], -1)


def right_jacobian(theta: np.ndarray) -> np.ndarray:
    square = (theta * theta).sum(-1)
    angle = np.sqrt(square)
    small = angle < 1e-6
    a = np.where(small, 1.0, angle)
    first = np.where(small, 0.5, (1 - np.cos(a)) / a**2)[..., None, None]
    second = np.where(small, 1 / 6, (a - np.sin(a)) / a**3)[..., None, None]
    out = second * (theta[..., :, None] * theta[..., None, :]) - first * skew(theta)
    for k in range(3):
        out[..., k, k] += 1 - second[..., 0, 0] * square
    return out


def euler(r: np.ndarray) -> np.ndarray:
    """Roll, pitch and yaw; at the poles the roll is given as 0."""
    pitch = np.arcsin(np.clip(-r[..., 2, 0], -1, 1))
    pole = np.abs(np.cos(pitch)) < 1e-6
    roll = np.where(pole, 0.0, np.arctan2(r[..., 2, 1], r[..., 2, 2]))
    yaw = np.where(pole, np.arctan2(-r[..., 0, 1], r[..., 1, 1]), np.arctan2(r[..., 1, 0], r[..., 0, 0]))
    return np.stack([roll, pitch, yaw], -1)


def of_euler(roll: np.ndarray, pitch: np.ndarray, yaw: np.ndarray) -> np.ndarray:
    axis = lambda a, k: exponential(np.stack([a if i == k else np.zeros_like(a) for i in range(3)], -1))
    return product(axis(yaw, 2), product(axis(pitch, 1), axis(roll, 0)))


def wrap(a: np.ndarray) -> np.ndarray:
    return (a + np.pi) % (2 * np.pi) - np.pi
