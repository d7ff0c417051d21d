"""Ids of text units, encoded once for each different unit.

A unit is a piece of text whose ids do not depend on its neighbours. Words repeat,
so a task encodes each different unit of a slice once and keeps recent ones.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from caseloom.llm import arrow


class UnitCache:
    """Ids by unit. Emptied before a slice that would take it beyond ``most`` bytes."""

    UNIT_BYTES = 150  # of a unit's string and entries, besides its characters and ids

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 96 << 20):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.size = 0
        self.flat = np.empty(1 << 16, np.int32)
        self.edges = np.zeros(1 << 12, np.int64)
        self.used = 0

    def _add(self, units: list[str]) -> None:
        ids = self.encode(units)
        n, first = len(units), len(self.place)
        while len(self.edges) < first + n + 1:
            self.edges = np.concatenate([self.edges, np.zeros_like(self.edges)])
        lengths = np.fromiter(map(len, ids), np.int64, n)
        self.edges[first + 1 : first + n + 1] = self.edges[first] + np.cumsum(lengths)
        end = int(self.edges[first + n])
        while len(self.flat) < end:
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : end] = np.fromiter(chain.from_iterable(ids), np.int32, end - self.used)
        self.used = end
        self.place.update(zip(units, range(first, first + n)))

    def __call__(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in order, and the number of ids of each piece."""
        number, unique = arrow.dictionary(pieces)
        units = unique.cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist()
        size = self.UNIT_BYTES * len(units) + 2 * unique.nbytes
        if self.size + size > self.most:
            self._clear()
        known = np.fromiter(map(self.place.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(known < 0)
        if len(new):
            known[new] = len(self.place) + np.arange(len(new))
            self.size += size * len(new) // len(units)
            self._add([units[i] for i in new.tolist()])
        known = known[number]
        begin, lengths = self.edges[known], self.edges[known + 1] - self.edges[known]
        at = np.repeat(begin - (np.cumsum(lengths) - lengths), lengths)
        at += np.arange(len(at))
        return self.flat[at], lengths


def unit_array(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Pieces of ``data`` cut at the flagged bytes and at text edges, and the first piece of each text."""
    begin = np.zeros(len(data) + 1, bool)
    begin[:-1] = cuts
    begin[offsets] = True
    begin[len(data)] = False
    starts = np.flatnonzero(begin[:-1])
    return arrow.binary_array(data, np.diff(np.append(starts, len(data)))), np.searchsorted(starts, offsets)
