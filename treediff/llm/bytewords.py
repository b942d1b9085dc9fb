"""Words of many texts as byte arrays: positions and hashes without a loop over words."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
#: Values that are hashed at once, but for longer runs.
SLICE = 1 << 19
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n; those of up to 2 * SLICE values are kept."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    found = []
    for x in (_BASE, _INVERSE):
        p = np.full(1 << (n - 1).bit_length(), x, np.uint64)
        p[0] = 1
        found.append(np.cumprod(p))
    if len(found[0]) <= 2 * SLICE:
        _powers[:] = found
    return found[0][:n], found[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    sums[1:] = values
    sums[1:] += np.uint64(1)
    sums[1:] *= up[: len(values)]
    np.cumsum(sums, out=sums)
    return mix((sums[ends] - sums[starts]) * down[starts])


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each pair (starts and ends ascend); equal runs have equal hashes wherever they stand.

    Values are taken SLICE at a time, so that memory goes with the runs, not the values.
    """
    if len(values) <= SLICE:
        return _run_hashes(values, starts, ends)
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + SLICE, "right")))
        out[at:to] = _run_hashes(values[low : int(ends[to - 1])], starts[at:to] - low, ends[at:to] - low)
        at = to
    return out


def word_bounds(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of buf, which single spaces or line feeds part, and the bytes."""
    b = np.frombuffer(buf, np.uint8)
    gaps = np.flatnonzero((b == 32) | (b == 10))
    return np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(b)]]), b


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of x[i : i + width]; len(x) - width + 1 values."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
