"""Double-array tries over byte strings: two numbers a state, a step by two lookups for any number of positions at once."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

FREE, ROUNDS = -1, 8


class DoubleArray(NamedTuple):
    """State ``s`` goes on by byte ``c`` to ``t = base[s] ^ c`` where ``check[t] == s``; ``value[s]`` is a key's value or -1.

    The root is state 0. A byte changes the last eight bits of a state only, so ``t`` never leaves the arrays.
    """

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``states`` can go on by their symbol, where those get to)."""
        following = self.base[states] ^ symbols
        known = self.check[following] == states
        return known, following[known]

    def state_of(self, key: bytes, state: int = 0) -> int:
        """The state after ``key``, -1 where no key begins with it."""
        for symbol in key:
            following = int(self.base[state]) ^ symbol
            if self.check[following] != state:
                return -1
            state = following
        return state


def build(data: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> DoubleArray:
    """The trie of keys that lie one after another in the bytes ``data``, with their values; no key is empty or occurs twice."""
    starts, states = np.cumsum(lengths) - lengths, np.zeros(len(lengths), np.int64)
    arrays, active, depth = _Arrays(len(data) // 2), np.arange(len(lengths)), 0
    while len(active):
        codes, branch = np.unique(states[active] * 256 + data[starts[active] + depth], return_inverse=True)
        states[active] = arrays.place(codes >> 8, codes & 255)[branch]
        depth += 1
        active = active[lengths[active] > depth]
    value = np.full(len(arrays.check), -1, np.int32)
    value[states] = values
    return DoubleArray(arrays.base, arrays.check, value)


class _Arrays:
    """Grows in blocks of 256. Random free places are tried for all parents at once; colliding ones are tried again."""

    def __init__(self, places: int):
        self.base, self.check = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.random = np.random.default_rng(1)
        self.grow(places)
        self.check[0] = -2  # the root is nobody's child

    def grow(self, places: int) -> None:
        more = (places // 256 + 1) * 256
        self.base = np.append(self.base, np.zeros(more, np.int32))
        self.check = np.append(self.check, np.full(more, FREE, np.int32))

    def place(self, parents: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states of all (parent, symbol) pairs, which are sorted by parent."""
        first = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
        counts = np.diff(np.append(first, len(parents)))
        pending, tries, found = np.argsort(-counts, kind="stable"), 0, np.zeros(len(parents), np.int64)
        while len(pending):
            wanted, free = int(counts[pending].sum()), np.flatnonzero(self.check == FREE)
            if tries == ROUNDS or len(free) < 2 * wanted:
                self.grow(2 * wanted)
                tries, free = 0, np.flatnonzero(self.check == FREE)
            base = free[self.random.integers(0, len(free), len(pending))] ^ symbols[first[pending]]
            owner = np.repeat(np.arange(len(pending)), counts[pending])
            at = np.arange(wanted) + (first[pending] - np.cumsum(counts[pending]) + counts[pending])[owner]
            places = base[owner] ^ symbols[at]
            claimed = np.zeros(wanted, bool)
            claimed[np.unique(places, return_index=True)[1]] = True
            good = np.bincount(owner[~claimed | (self.check[places] != FREE)], minlength=len(pending)) == 0
            taken = good[owner]
            self.check[places[taken]] = parents[at[taken]]
            self.base[parents[first[pending[good]]]] = base[good]
            found[at[taken]] = places[taken]
            pending, tries = pending[~good], tries + 1
        return found
