"""Words and word shingles as 64-bit hashes, in numpy."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
SHINGLE = 5
#: Words that a task's table holds at most before it starts anew; bounds memory, not results.
TABLE = 150_000


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (Steele, Lea, Flood 2014), element by element."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordHashes:
    """The words of texts (runs of letters, digits and _, in lower case) as hashes, each distinct word hashed once a task."""

    def __init__(self):
        self.table: dict[str, int] = {}

    def words(self, text: str | None) -> list[str]:
        return WORD.findall(text.lower()) if text else []

    def of(self, words: list[str]) -> np.ndarray:
        table = self.table
        try:
            return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(table) > TABLE:
                table.clear()
            table.update((w, xxhash.xxh3_64_intdigest(w)) for w in set(words) if w not in table)
            return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words."""
    k = len(hashes) - n + 1
    h = splitmix(hashes[:k])
    for j in range(1, n):
        h = splitmix(h ^ (hashes[j : k + j] << np.uint64(1)))
    return h


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the runs of five words; of fewer words, one of all; none of none."""
    return runs(hashes, min(SHINGLE, len(hashes))) if len(hashes) else hashes
