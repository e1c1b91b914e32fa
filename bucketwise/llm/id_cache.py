"""Ids of pieces of text that a worker has met, in flat arrays."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, islice, repeat

import numpy as np

#: Pieces that a worker keeps; beyond, the half that came last is forgotten.
CACHED = 1_500_000


def joined(ids: list) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array and their lengths."""
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths


class IdCache:
    """A dictionary from pieces of text to their ids; unknown pieces are
    learned through ``learn``, which calls :meth:`add`."""

    def __init__(self, learn: Callable[[set[str]], None], most: int = CACHED):
        self.learn, self.most = learn, most
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 16, dtype=np.int64)
        self.length = np.zeros(1 << 16, dtype=np.int64)

    def __contains__(self, piece: str) -> bool:
        return piece in self.index

    def add(self, pieces: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        n, first = len(pieces), len(self.index)
        while first + n > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        ends = self.used + np.cumsum(lengths)
        self.start[first : first + n] = ends - lengths
        self.length[first : first + n] = lengths
        self.used += len(flat)
        self.index.update(zip(pieces, range(first, first + n)))

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces by their codes, one after another, and their numbers."""
        start, length = self.start[codes], self.length[codes]
        at = np.repeat(start - (np.cumsum(length) - length), length)
        at += np.arange(len(at))
        return self.flat[at], length

    def codes(self, pieces: list[str]) -> np.ndarray:
        """Codes of pieces, learning those that are new."""
        if len(self.index) > self.most:
            kept = self.most // 2  # common pieces come early
            self.index = dict(islice(self.index.items(), kept))
            self.used = int(self.start[kept - 1] + self.length[kept - 1])
        found = np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            new = [pieces[i] for i in missing]
            self.learn(set(new))
            found[missing] = np.fromiter(map(self.index.__getitem__, new), np.int64, len(new))
        return found
