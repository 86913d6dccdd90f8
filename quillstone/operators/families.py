"""Similar names among families: names of as many words and characters that differ in one word only, as numbered ones do.

Where no character occurs in two places of the words, a common subsequence is one of each word, so that two families have to be compared in that word alone, less what all begin and end with. Of what is left, names have
a common subsequence of n characters if they share one of the texts that leaving out all but n gives: that finds partners and classes by keys. Numbers of links are counted over one family's names as an automaton, in
which names that end alike share their ends, so that a name meets few nodes instead of every other name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from itertools import combinations
from math import comb

import numpy as np

from ..functions.similarity import common

#: Fewer names than this are no family, and are compared one by one.
LEAST = 64
#: Keys of all names of a family at most, states of a name in a step at most, and characters of a differing part at most: above, names are compared one by one.
KEYS, STATES, PART = 1 << 24, 128, 16
#: Names that are counted at once.
CHUNK = 4096


@dataclass(frozen=True)
class Family:
    """rows: places among all rows, in order of names; words: the common words, with None for the one that differs; word: that word of each name."""

    rows: np.ndarray
    words: tuple[str | None, ...]
    word: np.ndarray
    size: int
    met: bool

    @cached_property
    def letters(self) -> tuple[frozenset[str], ...]:
        return tuple(frozenset(w if w is not None else "".join(set("".join(self.word)))) for w in self.words)

    @cached_property
    def firsts(self) -> tuple[frozenset[str], ...]:
        return tuple(frozenset(w[0] if w is not None else {x[0] for x in self.word}) for w in self.words)


def families(plain: list[str], core: list[str], before: list, rows: np.ndarray) -> tuple[list[Family], np.ndarray]:
    """The families among those rows, which stand in order of names, and the rows of no family."""
    split = {r: plain[r].split(" ") for r in rows}
    kinds: dict[int, list[int]] = {}
    for r, words in split.items():
        kinds.setdefault(len(words) if core[r] == plain[r] else 0, []).append(r)
    found, rest = [], kinds.pop(0, [])
    for n, members in kinds.items():
        at = max(range(n), key=lambda k: len({split[r][k] for r in members}))
        groups: dict[tuple, list[int]] = {}
        for r in members:
            words = split[r]
            groups.setdefault((*words[:at], None, *words[at + 1 :], len(plain[r])), []).append(r)
        for (*words, size), group in groups.items():
            if len(group) < LEAST:
                rest += group
            else:
                found.append(Family(np.array(group), tuple(words), np.array([split[r][at] for r in group], dtype=object), size, any(len(before[r]) for r in group)))
    return found, np.array(sorted(rest), int)


def _codes(words: np.ndarray, start: int, end: int) -> np.ndarray:
    """A row of characters' numbers for each word, less start characters and end characters."""
    text = "".join(words)
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(words), -1)[:, start : len(words[0]) - end]


def _subsequences(codes: np.ndarray, base: int, n: int) -> np.ndarray:
    """Keys of what leaving out all but n characters gives, a row for each text."""
    out = np.empty((len(codes), comb(codes.shape[1], n)), np.int64)
    for i, places in enumerate(combinations(range(codes.shape[1]), n)):
        key = np.zeros(len(codes), np.int64)
        for p in places:
            key = key * base + codes[:, p]
        out[:, i] = key
    return out


class _Automaton:
    """Distinct texts of one length in order, with weights: for each place a node's next by character (the last node is none), and the weight below each node."""

    def __init__(self, codes: np.ndarray, weight: np.ndarray, letters: int):
        values, node = np.unique(weight, return_inverse=True)
        self.next, self.below = [], [np.append(values, 0)]
        first = np.arange(len(codes))
        for i in range(codes.shape[1] - 1, -1, -1):
            at = codes[first]
            new = np.ones(len(first), bool)
            new[1:] = (at[1:, :i] != at[:-1, :i]).any(axis=1)
            of = np.cumsum(new) - 1
            step = np.full((of[-1] + 1, letters), len(self.below[0]) - 1)
            step[of, at[:, i]] = node
            step, node = np.unique(step, axis=0, return_inverse=True)
            node, first = node.ravel(), first[new]
            self.next.insert(0, np.vstack([step, np.full((1, letters), len(self.below[0]) - 1)]))
            self.below.insert(0, self.below[0][self.next[0]].sum(axis=1))


class Met:
    """Two families side by side; least is the similarity that links."""

    def __init__(self, a: Family, b: Family, least: float):
        self.a, self.b = a, b
        self.fits = self._fits() and self._prepared(least)

    def _fits(self) -> bool:
        a, b = self.a, self.b
        if len(a.words) != len(b.words) or [w is None for w in a.words] != [w is None for w in b.words] or (a.met and b.met):
            return False
        letters, firsts = ([x | y for x, y in zip(p, q, strict=True)] for p, q in ((a.letters, b.letters), (a.firsts, b.firsts)))
        return all(not letters[i] & letters[j] and (max(firsts[i]) < min(firsts[j]) or min(firsts[i]) > max(firsts[j])) for i, j in combinations(range(len(letters)), 2))

    def _prepared(self, least: float) -> bool:
        a, b = self.a, self.b
        low, high = min(a.word[0], b.word[0]), max(a.word[-1], b.word[-1])
        shortest = min(len(low), len(high), len(a.word[0]), len(b.word[0]))
        start = next((k for k in range(shortest) if low[k] != high[k]), shortest)
        x, y = _codes(a.word, start, 0), _codes(b.word, start, 0)
        end = 0
        while end < shortest - start and (x[:, -1 - end] == x[0, -1 - end]).all() and (y[:, -1 - end] == x[0, -1 - end]).all():
            end += 1
        x, y = x[:, : x.shape[1] - end], y[:, : y.shape[1] - end]
        same = sum(common(v, w) for v, w in zip(a.words, b.words, strict=True) if v is not None) + len(a.words) - 1 + start + end
        self.same, self.p, self.q = same, x.shape[1], y.shape[1]
        if max(self.p, self.q) > PART:
            return False
        letters, numbers = np.unique(np.concatenate([x.ravel(), y.ravel()]), return_inverse=True)
        self.base = max(1, len(letters))
        self.x, self.y = numbers[: x.size].reshape(x.shape), numbers[x.size :].reshape(y.shape)
        self.most = min(self.p, self.q)
        #: How much of the parts that differ has to be in common.
        self.need = next((n for n in range(self.most + 1) if self.similarity(n) >= least), self.most + 1)
        keys = max((max(comb(self.p, n), comb(self.q, n)) for n in range(max(self.need, 0), self.most + 1)), default=1)
        states = max((len(s) for p, q in ((self.p, self.q), (self.q, self.p)) for s in self._states(p, q)), default=0)
        return self.base**self.most < 1 << 62 and keys * max(len(a.word), len(b.word)) <= KEYS and states <= STATES

    def similarity(self, n: int) -> float:
        ratio = 2 * (n + self.same) / (self.a.size + self.b.size)
        return 0.85 * ratio + 0.15 * ratio

    def _states(self, p: int, q: int) -> list[np.ndarray]:
        """For each number of characters read of q, the states (a 0 for each character in common) that may still come to need, and haven't."""
        bits = np.bitwise_count(np.arange(1 << p, dtype=np.uint64))
        return [np.flatnonzero((p - bits >= self.need - (q - i)) & (p - bits < min(i + 1, self.need))).astype(np.uint64) for i in range(q + 1)]

    def counted(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The weight of those of y with which each of x is linked."""
        if self.need > self.most:
            return np.zeros(len(x), np.int64)
        if self.need == 0:
            return np.full(len(x), weight.sum())
        (_, p), q = x.shape, y.shape[1]
        if self.need == p == q:
            keys, mine = _subsequences(y, self.base, q)[:, 0], _subsequences(x, self.base, p)[:, 0]  # in order, as y is
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            return np.where(keys[at] == mine, weight[at], 0)
        known, states = _Automaton(y, weight, self.base), self._states(p, q)
        bits, full = np.bitwise_count(np.arange(1 << p, dtype=np.uint64)), np.uint64((1 << p) - 1)
        out = np.empty(len(x), np.int64)
        for at in range(0, len(x), CHUNK):
            part = x[at : at + CHUNK]
            masks = np.zeros((self.base, len(part)), np.uint64)
            for k in range(p):
                masks[part[:, k], np.arange(len(part))] |= np.uint64(1 << k)
            # of a node and a state, two more: need is met, and can't be met
            got = np.zeros((len(known.below[q]), len(part), 2), np.int64)
            got[:, :, 0] = known.below[q][:, None]
            for i in range(q - 1, -1, -1):
                after = states[i + 1]
                place = np.where(p - bits >= self.need, len(after), len(after) + 1)
                place[after] = np.arange(len(after))
                flat, wide = got.reshape(len(got), -1), np.arange(len(part))[:, None] * got.shape[2]
                mine = states[i]
                got = np.zeros((len(known.below[i]), len(part), len(mine) + 2), np.int64)
                got[:, :, -2] = known.below[i][:, None]
                for c in range(self.base):
                    to = known.next[i][:, c]
                    if len(mine) and (to < len(flat) - 1).any():
                        u = mine[None, :] & masks[c][:, None]
                        step = place[((mine + u) | (mine - u)) & full] + wide
                        got[:, :, : len(mine)] += flat[to][:, step]
            out[at : at + CHUNK] = got[0, :, 0]
        return out

    def best(self, x: np.ndarray, y: np.ndarray, itself: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of each of x, how much it has in common with its most similar of y, -1 if it is linked with none, and the first of those; itself: x is y, and a text isn't its own partner."""
        found, partner = np.full(len(x), -1), np.zeros(len(x), np.int64)
        left = np.arange(len(x))
        for n in range(self.most - itself, max(self.need, 0) - 1, -1):
            keys = _subsequences(y, self.base, n)
            order = np.argsort(keys.ravel(), kind="stable")
            keys, who = keys.ravel()[order], order // keys.shape[1]
            once = np.ones(len(keys), bool)
            once[1:] = (keys[1:] != keys[:-1]) | (who[1:] != who[:-1])
            keys, who = keys[once], who[once]
            mine = _subsequences(x[left], self.base, n)
            at = np.searchsorted(keys, mine)
            if itself:
                own = (at < len(keys)) & (who[np.minimum(at, len(keys) - 1)] == left[:, None]) & (keys[np.minimum(at, len(keys) - 1)] == mine)
                at += own
            there = at < len(keys)
            at = np.minimum(at, len(keys) - 1)
            first = np.where(there & (keys[at] == mine), who[at], len(y)).min(axis=1)
            hit = first < len(y)
            found[left[hit]], partner[left[hit]] = n, first[hit]
            left = left[~hit]
            if not len(left):
                break
        return found, partner

    def connections(self, itself: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows that links connect, as pairs: all that share a key, where both families have it, with the first that has it."""
        if self.need > self.most:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sides = [(self.a.rows, self.x)] if itself else [(self.a.rows, self.x), (self.b.rows, self.y)]
        keys = [_subsequences(part, self.base, self.need) for _, part in sides]
        rows = np.concatenate([np.repeat(r, k.shape[1]) for (r, _), k in zip(sides, keys, strict=True)])
        flat = np.concatenate([k.ravel() for k in keys])
        if not itself:
            both = np.isin(flat, np.intersect1d(*keys))
            rows, flat = rows[both], flat[both]
        _, first, of = np.unique(flat, return_index=True, return_inverse=True)
        return rows, rows[first][of]


def united(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Labels (a row of its class each) after u and v are connected, and the pairs of labels that this took."""
    edges: list[tuple[int, int]] = []
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label, edges
        low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        parent = np.arange(len(label))
        np.minimum.at(parent, high, low)
        moved = np.flatnonzero(parent != np.arange(len(label)))
        edges += zip(moved.tolist(), parent[moved].tolist(), strict=True)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]
