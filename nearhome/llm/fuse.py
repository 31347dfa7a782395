"""Static binary-fuse filters: 8-bit fingerprints, three positions a key, built by peeling in layers."""

from __future__ import annotations

import math

import numpy as np

LIMIT = 100  # seeds to try; one attempt fails with a probability of a few percent


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys.astype(np.uint64) + np.uint64(seed)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _positions(h: np.ndarray, segment: int, count: int) -> np.ndarray:
    """Three positions a hash, in three neighbouring segments."""
    mask = np.uint64(segment - 1)
    first = ((h >> np.uint64(32)) * np.uint64(count * segment)) >> np.uint64(32)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third], axis=1).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))).astype(np.uint8)


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, fingerprints) of a filter that accepts all ``keys`` and 1 in 256 others."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    size = max(n, 2)
    segment = 1 << min(18, max(2, int(math.floor(math.log(size) / math.log(3.33) + 2.25))))
    capacity = int(size * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(size)))
    count = max(1, -(-capacity // segment) - 2)
    length = (count + 2) * segment
    for attempt in range(LIMIT):
        seed = (0x9E3779B97F4A7C15 * (attempt + 1)) & 0xFFFFFFFFFFFFFFFF
        h = _mixed(keys, seed)
        places = _positions(h, segment, count)
        layers = _peel(places, length)
        if layers is not None:
            table, prints = np.zeros(length, np.uint8), _prints(h)
            for key, at in reversed(layers):
                others = table[places[key]]
                value = prints[key] ^ others[:, 0] ^ others[:, 1] ^ others[:, 2]
                table[at] = value  # still zero in ``others``, so it does not disturb the sum
            return seed, segment, count, table.tobytes()
    raise RuntimeError(f"no filter for {n} keys after {LIMIT} seeds")


def _peel(places: np.ndarray, length: int) -> list | None:
    """Layers of (keys, their lone positions), or None when some keys stay entangled."""
    n = len(places)
    count = np.bincount(places.ravel(), minlength=length)
    total = np.zeros(length, np.int64)  # sum of the keys at a position: the key itself where there is one
    np.add.at(total, places.ravel(), np.repeat(np.arange(n), 3))
    layers, left = [], n
    lone = np.flatnonzero(count == 1)
    while len(lone):
        key, first = np.unique(total[lone], return_index=True)
        layers.append((key, lone[first]))
        left -= len(key)
        touched = places[key].ravel()
        np.subtract.at(count, touched, 1)
        np.subtract.at(total, touched, np.repeat(key, 3))
        touched = np.unique(touched)
        lone = touched[count[touched] == 1]
    return layers if left == 0 else None


def contains(keys: np.ndarray, seed: int, segment: int, count: int, table: bytes) -> np.ndarray:
    h = _mixed(keys.astype(np.uint64), int(seed))
    found = np.frombuffer(table, np.uint8)[_positions(h, segment, count)]
    return _prints(h) == found[:, 0] ^ found[:, 1] ^ found[:, 2]
