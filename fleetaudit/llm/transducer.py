"""Minimal acyclic transducers: a sorted list of byte strings as an automaton whose arc outputs add up to the ordinal.

States with the same right language are one state. The output of an arc is the number of strings that branch off before
it, so the outputs along an accepted string sum to its place in byte order (from 0)."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np


class Transducer:
    def __init__(self, root: int, keys: np.ndarray, targets: np.ndarray, outs: np.ndarray, final: np.ndarray):
        """``keys`` (ascending) are state * 256 + byte of every arc, ``final`` marks accepting states."""
        self.root, self.keys, self.targets, self.outs, self.final = root, keys, targets, outs, final

    @classmethod
    def build(cls, terms: Iterable[bytes]) -> Transducer:
        """From distinct terms in ascending byte order. Only the path of the last term is open; a state that no later
        term can reach is replaced by its equal, if there is one."""
        register: dict[tuple, int] = {}
        size: list[int] = []  # accepted strings from a state on
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        path: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]
        last = b""

        def close(depth: int) -> int:
            """Number of the finished state at the end of the open path, from ``depth`` on."""
            child = -1
            while len(path) > depth:
                accepts, arcs = path.pop()
                shape = (accepts, tuple(arcs))
                child = register.get(shape, -1)
                if child < 0:
                    child = register[shape] = len(states)
                    states.append(shape)
                    size.append(accepts + sum(size[t] for _, t in arcs))
                if path:
                    path[-1][1].append((last[len(path) - 1], child))
            return child

        for term in terms:
            shared = 0
            while shared < len(last) and shared < len(term) and last[shared] == term[shared]:
                shared += 1
            close(shared + 1)
            path.extend((False, []) for _ in range(len(term) - shared))
            path[-1] = (True, path[-1][1])
            last = term
        root = close(0)
        keys, targets, outs = [], [], []
        for state, (accepts, arcs) in enumerate(states):
            before = int(accepts)
            for label, target in arcs:
                keys.append(state * 256 + label)
                targets.append(target)
                outs.append(before)
                before += size[target]
        return cls(root, np.array(keys, np.int64), np.array(targets, np.int64), np.array(outs, np.int64),
                   np.array([s[0] for s in states], bool))

    def ordinals(self, terms: list[bytes]) -> np.ndarray:
        """The ordinal of every term, -1 of those not accepted. All terms advance a byte at a time, together."""
        length = np.fromiter(map(len, terms), np.int64, len(terms))
        start = np.cumsum(length) - length
        raw = np.frombuffer(b"".join(terms), np.uint8)
        ordinal, state = np.zeros(len(terms), np.int64), np.full(len(terms), self.root)
        alive, step = np.arange(len(terms)), 0
        while len(alive):
            ended = length[alive] == step
            done = alive[ended]
            ordinal[done[~self.final[state[done]]]] = -1
            alive = alive[~ended]
            key = state[alive] * 256 + raw[start[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key if len(self.keys) else np.zeros(len(alive), bool)
            ordinal[alive[~hit]] = -1
            alive, at = alive[hit], at[hit]
            state[alive] = self.targets[at]
            ordinal[alive] += self.outs[at]
            step += 1
        return ordinal

    def to_bytes(self) -> bytes:
        return (struct.pack("<qqq", self.root, len(self.keys), len(self.final)) + self.keys.astype("<i8").tobytes()
                + self.targets.astype("<i4").tobytes() + self.outs.astype("<i4").tobytes() + self.final.tobytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        root, arcs, states = struct.unpack_from("<qqq", data)
        at = 24
        keys = np.frombuffer(data, "<i8", arcs, at)
        targets = np.frombuffer(data, "<i4", arcs, at + 8 * arcs).astype(np.int64)
        outs = np.frombuffer(data, "<i4", arcs, at + 12 * arcs).astype(np.int64)
        return cls(root, keys, targets, outs, np.frombuffer(data, bool, states, at + 16 * arcs))
