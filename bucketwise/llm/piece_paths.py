"""Best paths through many short parts at once: one Aho-Corasick automaton, walked
for all parts character by character in numpy."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_CHARACTER_BITS = 21
#: Parts that are walked together.
TOGETHER = 1 << 14


class PiecePaths:
    """The automaton over ``pieces`` (id, text, score) as arrays: failure links,
    output links and a hash table of edges."""

    def __init__(self, pieces: list[tuple[int, str, float]]):
        edges: dict[int, int] = {}
        children: list[list[tuple[int, int]]] = [[]]
        own: list[tuple[int, int, float]] = [(0, 0, 0.0)]
        for i, text, score in pieces:
            node = 0
            for c in map(ord, text):
                key = node << _CHARACTER_BITS | c
                if key not in edges:
                    edges[key] = len(own)
                    children[node].append((c, len(own)))
                    children.append([])
                    own.append((0, 0, 0.0))
                node = edges[key]
            own[node] = (i, len(text), score)
        fail, first, after = ([0] * len(own) for _ in range(3))
        queue = [0]
        for node in queue:
            for c, child in children[node]:
                at = node
                while at:
                    at = fail[at]
                    if (met := edges.get(at << _CHARACTER_BITS | c)) is not None:
                        fail[child] = met
                        break
                after[child] = first[fail[child]]
                first[child] = child if own[child][1] else after[child]
                queue.append(child)
        self.fail, self.first, self.after = (np.array(x, dtype=np.int64) for x in (fail, first, after))
        self.piece = np.array([p for p, _, _ in own], dtype=np.uint32)
        self.size = np.array([n for _, n, _ in own], dtype=np.int64)
        self.score = np.array([s for _, _, s in own], dtype=np.float64)
        bits = max(4, (8 * len(edges)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.targets = np.full(1 << bits, _NONE), np.zeros(1 << bits, dtype=np.int64)
        key, target = np.array(list(edges), dtype=np.uint64), np.array(list(edges.values()), dtype=np.int64)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] == _NONE
            self.keys[slot[free]] = key[free]
            mine = self.keys[slot] == key
            self.targets[slot[mine]] = target[mine]
            key, target, slot = key[~mine], target[~mine], (slot[~mine] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * _SPREAD) >> self.shift).astype(np.int64)

    def _step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Where edges lead, -1 where there is none."""
        key = (state << _CHARACTER_BITS | c).astype(np.uint64)
        slot = self._slot(key)
        met = self.keys[slot]
        out = np.where(met == key, self.targets[slot], -1)
        open_ = np.flatnonzero((met != key) & (met != _NONE))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            met = self.keys[slot]
            hit = met == key[open_]
            out[open_[hit]] = self.targets[slot[hit]]
            go = ~hit & (met != _NONE)
            open_, slot = open_[go], slot[go]
        return out

    def _walk(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The automaton's next states."""
        out = self._step(state, c)
        lost = np.flatnonzero(out < 0)
        at = state[lost]
        while len(lost):
            out[lost[at == 0]] = 0
            lost, at = lost[at != 0], self.fail[at[at != 0]]
            met = self._step(at, c[lost])
            out[lost] = met
            lost, at = lost[met < 0], at[met < 0]
        return out

    def best(self, parts: Iterable[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Parts by length, the ids of their best paths one after another, and how many
        each has.  Every character of a part must be a piece; ties go to the longer piece."""
        ordered = sorted(parts, key=len, reverse=True)
        found = [self._best(ordered[i : i + TOGETHER]) for i in range(0, len(ordered), TOGETHER)]
        if not found:
            return [], np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        return ordered, *(np.concatenate(x) for x in zip(*found))

    def _best(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        starts, many, longest = np.cumsum(sizes) - sizes, len(parts), int(sizes[0])
        best = np.full((longest + 1) * many, -np.inf)
        best[:many] = 0.0
        back = np.zeros((longest + 1) * many, dtype=np.int64)
        active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # parts longer than a place come first
        state = np.zeros(many, dtype=np.int64)
        for end, n in enumerate(active.tolist(), 1):
            state = self._walk(state[:n], codes[starts[:n] + (end - 1)])
            row, node = np.arange(n), self.first[state]
            here, chosen = np.full(n, -np.inf), np.zeros(n, dtype=np.int64)
            while len(row):
                score = best[(end - self.size[node]) * many + row] + self.score[node]
                better = score > here[row]
                here[row[better]], chosen[row[better]] = score[better], node[better]
                node = self.after[node]
                row, node = row[node > 0], node[node > 0]
            if not chosen.all():
                raise ValueError("a character is no piece")
            best[end * many : end * many + n], back[end * many : end * many + n] = here, chosen
        row, at, rows, ids = np.flatnonzero(sizes), sizes[sizes > 0], [], []
        while len(row):
            node = back[at * many + row]
            rows.append(row)
            ids.append(self.piece[node])
            at = at - self.size[node]
            row, at = row[at > 0], at[at > 0]
        counts = np.zeros(many, dtype=np.int64)
        for r in rows:
            counts[r] += 1
        ends = np.cumsum(counts)
        flat = np.empty(int(counts.sum()), dtype=np.uint32)
        for k, (r, i) in enumerate(zip(rows, ids), 1):
            flat[ends[r] - k] = i
        return flat, counts
