"""Minimal acyclic transducers: a sorted list of byte strings as an automaton that numbers them.

States with equal continuations are merged while the sorted strings come in, so no more
than the current string's path is ever unmerged. An arc carries how many strings are
passed over by taking it; the sum along a path is the string's place in sorted order.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from os.path import commonprefix

import numpy as np


@dataclass(frozen=True)
class Transducer:
    """Arcs by (state, byte) in sorted order; numbers are counted from ``first``."""

    arcs: np.ndarray  # state << 8 | byte
    targets: np.ndarray
    skipped: np.ndarray
    final: np.ndarray  # for each state
    root: int
    first: int

    def start(self, prefix: bytes) -> tuple[int, int] | None:
        """State and number reached over ``prefix``; None if no string begins with it."""
        state, number = self.root, self.first
        for byte in prefix:
            at = int(np.searchsorted(self.arcs, state << 8 | byte))
            if at == len(self.arcs) or self.arcs[at] != state << 8 | byte:
                return None
            state, number = int(self.targets[at]), number + int(self.skipped[at])
        return state, number

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: tuple[int, int]) -> np.ndarray:
        """Numbers of those of the given stretches of ``data`` that are in the list.

        All stretches are read side by side, a byte of each at a time; what has no arc
        leaves at once.
        """
        state = np.full(len(starts), begin[0], np.int64)
        number = np.full(len(starts), begin[1], np.int64)
        at, found = starts, []
        while len(at):
            over = at == ends
            if over.any():
                found.append(number[over & self.final[state]])
                state, number, at, ends = (x[~over] for x in (state, number, at, ends))
            wanted = state << 8 | data[at]
            arc = np.searchsorted(self.arcs, wanted)
            # One arc beyond all keys ends the array, so every place can be looked at.
            there = self.arcs[arc] == wanted
            arc = arc[there]
            state, number = self.targets[arc], number[there] + self.skipped[arc]
            at, ends = at[there] + 1, ends[there]
        return np.concatenate(found) if found else np.empty(0, np.int64)


#: Greater than every (state, byte).
NO_ARC = np.int64(np.iinfo(np.int64).max)


def build(strings: Iterable[bytes], first: int = 0) -> Transducer:
    """The transducer of strictly ascending strings."""
    known: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, arcs), targets before sources
    path: list[tuple[list[bool], list[tuple[int, int]]]] = [([False], [])]
    last = b""

    def merged(node: tuple[list[bool], list[tuple[int, int]]]) -> int:
        key = (node[0][0], tuple(node[1]))
        state = known.setdefault(key, len(states))
        if state == len(states):
            states.append(key)
        return state

    def close(depth: int) -> None:
        """Merge the states of the last string beyond ``depth``."""
        while len(path) > depth + 1:
            state = merged(path.pop())
            path[-1][1].append((last[len(path) - 1], state))

    for string in strings:
        common = len(commonprefix([last, string]))
        close(common)
        path.extend(([False], []) for _ in range(len(string) - common))
        path[-1][0][0] = True
        last = string
    close(0)
    root = merged(path[0])

    below = np.zeros(len(states), np.int64)  # strings that continue from a state
    arcs, targets, skipped = [], [], []
    for state, (final, out) in enumerate(states):
        passed = int(final)
        for byte, target in out:
            arcs.append(state << 8 | byte)
            targets.append(target)
            skipped.append(passed)
            passed += int(below[target])
        below[state] = passed
    return Transducer(
        np.array([*arcs, NO_ARC], np.int64),
        np.array([*targets, 0], np.int64),
        np.array([*skipped, 0], np.int64),
        np.array([final for final, _ in states], bool),
        root,
        first,
    )


def packed(t: Transducer) -> bytes:
    """As bytes: four numbers, then the arrays."""
    head = np.array([t.root, t.first, len(t.arcs), len(t.final)], np.int64)
    narrow = (t.targets.astype(np.int32), t.skipped.astype(np.int32), t.final)
    return b"".join([head.tobytes(), t.arcs.tobytes(), *(x.tobytes() for x in narrow)])


def unpacked(data: bytes) -> Transducer:
    root, first, n, states = np.frombuffer(data, np.int64, 4).tolist()
    at = 32
    arcs = np.frombuffer(data, np.int64, n, at)
    targets = np.frombuffer(data, np.int32, n, at + 8 * n).astype(np.int64)
    skipped = np.frombuffer(data, np.int32, n, at + 12 * n).astype(np.int64)
    return Transducer(arcs, targets, skipped, np.frombuffer(data, bool, states, at + 16 * n), root, first)
