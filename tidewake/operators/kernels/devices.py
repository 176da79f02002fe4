"""States of many devices kept side by side: arrays by device, lists by device, and objects or dicts of those."""

from __future__ import annotations

import copy

import numpy as np


def taken(state, at: np.ndarray):
    """The state of the devices ``at``, copied."""
    if isinstance(state, np.ndarray):
        return state[at]
    if isinstance(state, list):
        return [state[k] for k in at]
    if isinstance(state, dict):
        return {k: taken(v, at) for k, v in state.items()}
    if hasattr(state, "__dict__"):
        out = copy.copy(state)
        vars(out).update({k: taken(v, at) for k, v in vars(state).items()})
        return out
    return state


def joined(states: list):
    """The states of several groups of devices as one, in their order."""
    first = states[0]
    if len(states) == 1:
        return first
    if isinstance(first, np.ndarray):
        return np.concatenate(states)
    if isinstance(first, list):
        return [x for s in states for x in s]
    if isinstance(first, dict):
        return {k: joined([s[k] for s in states]) for k in first}
    if hasattr(first, "__dict__"):
        out = copy.copy(first)
        vars(out).update({k: joined([vars(s)[k] for s in states]) for k in vars(first)})
        return out
    return first


def plain(state):
    """The state without its classes, for storage."""
    if isinstance(state, list):
        return [plain(x) for x in state]
    if isinstance(state, dict):
        return {k: plain(v) for k, v in state.items()}
    return {k: plain(v) for k, v in vars(state).items()} if hasattr(state, "__dict__") else state


def restored(fresh, kept):
    """What :func:`plain` kept, put into a ``fresh`` state of as many devices."""
    if isinstance(fresh, list):
        return [restored(a, b) for a, b in zip(fresh, kept, strict=True)]
    if isinstance(fresh, dict):
        return {k: restored(v, kept[k]) for k, v in fresh.items()}
    if hasattr(fresh, "__dict__"):
        out = copy.copy(fresh)
        vars(out).update({k: restored(v, kept[k]) for k, v in vars(fresh).items()})
        return out
    return kept


def advance(state, counts: np.ndarray, step) -> tuple[object, dict[str, np.ndarray]]:
    """Devices with ``counts`` rows each, most first: the state after all rows, and the outputs by row, device after device.

    ``step(state, rows)`` takes the devices' next rows (their places) and
    returns outputs by name. A device whose rows are done leaves the state at
    once, so nothing moves it further.
    """
    first, done, out, running = np.r_[0, np.cumsum(counts)[:-1]], [], None, len(counts)
    for k in range(int(counts[0])):
        still = int(np.count_nonzero(counts > k))
        if still < running:
            done.append(taken(state, np.arange(still, running)))
            state, running = taken(state, np.arange(still)), still
        at = first[:running] + k
        found = step(state, at)
        if out is None:
            out = {c: np.empty(int(counts.sum()), v.dtype) for c, v in found.items()}
        for c, v in found.items():
            out[c][at] = v
    return joined([state, *reversed(done)]), out
