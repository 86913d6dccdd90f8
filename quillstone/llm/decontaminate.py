"""Benchmark decontamination under edit distance: CGK embeddings, bit-sampling LSH over item-sized windows, exact verification.

Texts are compared word by word. CGK's random walk copies a word at every step and moves on by a coin that depends on the step and the
word, so that two sequences within a small edit distance agree at most steps (Chakraborty, Goldenberg, Koucký). Each repetition
samples a few steps of a walk; an item-sized window of a document is a candidate where its samples equal the item's in some
repetition, and the number of repetitions follows from the recall that is asked for. Candidates are verified by their exact edit distance.

Windows are cut only where they can match: of an item cut into (edits allowed + 1) segments, one must stand in any match unchanged,
at a place that differs by no more than the edits allowed. That drops no match. An item that allows no edit (under five words) is one segment,
and found where that stands.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded
from .pieces import few
from .words import WordHashes, runs, splitmix

SIMILARITY = 0.8
#: Words of items that go to the tasks at once; a larger benchmark takes more passes over the documents.
BLOCK_WORDS = 4_000_000
SAMPLES = 2
#: Hamming distance, relative to the walk, of pairs at the edit bound, as measured; and the recall to reach at that distance.
HAMMING, RECALL = 0.62, 0.995


def allowed(n: int, similarity: float = SIMILARITY) -> int:
    """Edits allowed for an item of n words."""
    return math.floor(n * (1 - similarity) + 1e-9)


def repetitions(recall: float = RECALL, hamming: float = HAMMING, samples: int = SAMPLES) -> int:
    """Independent repetitions until a pair at that Hamming distance agrees in all samples of one, with that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - hamming) ** samples))


def embed(words: np.ndarray, starts: np.ndarray, n: int, steps: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """The sampled steps of the walks over words[start : start + n]: repetitions times starts times samples; 0 past the end.

    steps has a row of sampled steps for each repetition, salts its coins' randomness for each step."""
    at = np.repeat(starts.astype(np.int64)[None, :], len(steps), axis=0)
    end = np.minimum(at + n, len(words))
    out = np.zeros((len(steps), len(starts), steps.shape[1]), np.uint64)
    padded = np.append(words, np.uint64(0))
    for j in range(int(steps.max()) + 1):
        word = padded[np.where(at < end, at, len(words))]
        for r, k in zip(*np.nonzero(steps == j), strict=True):
            out[r, :, k] = word[r]
        at += (at < end) & ((splitmix(word ^ salts[:, j, None]) & np.uint64(1)) == 1)
    return out


def edits(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int]:
    """The least edit distance between item and any stretch of text, with the stretch's start and end (the earliest end, of those the latest start)."""
    n = len(text)
    row, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    for i, w in enumerate(item):
        swap = row[:-1] + (text != w)
        drop = row[1:] + 1
        best, begin = np.empty_like(row), np.empty_like(start)
        best[0], begin[0] = i + 1, 0
        take = swap <= drop
        best[1:], begin[1:] = np.where(take, swap, drop), np.where(take, start[:-1], start[1:])
        low = np.minimum.accumulate(best - np.arange(n + 1)) + np.arange(n + 1)  # insertions, running from the left
        source = np.maximum.accumulate(np.where(best == low, np.arange(n + 1), 0))
        row, start = low, begin[source]
        if row.min() > most:
            return int(row.min()), 0, 0
    end = int(row.argmin())
    return int(row[end]), int(start[end]), end


class Items:
    """Benchmark items, ready for search: segments by hash, and the items' samples for each repetition."""

    def __init__(self, items: list[tuple[int | None, str]], similarity: float = SIMILARITY):
        self.table = WordHashes()
        kept = [(i, w) for i, t in items if (w := self.table.words(t))]
        self.ids = [i for i, _ in kept]
        self.words = [self.table.of(w) for _, w in kept]
        self.similarity, self.repeats = similarity, repetitions()
        seeds: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for at, w in enumerate(self.words):
            k = allowed(len(w), similarity)
            cuts = np.linspace(0, len(w), k + 2).astype(int)
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(b - a, {}).setdefault(int(runs(w[a:b], b - a)[0]), []).append((at, int(a)))
        self.seeds = {n: by_hash for n, by_hash in sorted(seeds.items())}
        self.maybe = {n: np.zeros(1 << 20, bool) for n in self.seeds}
        for n, by_hash in self.seeds.items():
            self.maybe[n][(np.fromiter(by_hash, np.uint64, len(by_hash)) >> np.uint64(44)).astype(np.int64)] = True
        self.plans: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.samples: dict[int, np.ndarray] = {}

    def plan(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The sampled steps and the salts of all repetitions for items of n words."""
        if n not in self.plans:
            rng = np.random.default_rng(n)
            steps = np.array([np.sort(rng.choice(2 * n, SAMPLES, replace=False)) for _ in range(self.repeats)])
            self.plans[n] = steps, splitmix(np.arange(self.repeats * 2 * n, dtype=np.uint64).reshape(self.repeats, 2 * n) ^ np.uint64(n << 32))
        return self.plans[n]

    def item_samples(self, at: int) -> np.ndarray:
        if at not in self.samples:
            w = self.words[at]
            self.samples[at] = embed(w, np.zeros(1, np.int64), len(w), *self.plan(len(w)))
        return self.samples[at]

    def places(self, texts: list[np.ndarray]) -> list[dict[int, set[int]]]:
        """For each text and each item that it may contain: where the item's first word would stand."""
        found: list[dict[int, set[int]]] = [{} for _ in texts]
        first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        words = np.zeros(first[-1], np.uint64)  # a 0, which no item has, stands behind each text
        for t, at in zip(texts, first, strict=False):
            words[at : at + len(t)] = t
        h, done = splitmix(words), 1
        for n, by_hash in self.seeds.items():
            while done < n:
                h = splitmix(h[:-1] ^ (words[done:] << np.uint64(1)))
                done += 1
            for p in np.flatnonzero(self.maybe[n][(h >> np.uint64(44)).astype(np.int64)]) if len(h) else ():
                if hits := by_hash.get(int(h[p])):
                    d = int(np.searchsorted(first, p, "right")) - 1
                    for item, offset in hits:
                        found[d].setdefault(item, set()).add(int(p) - int(first[d]) - offset)
        return found

    def matches(self, words: np.ndarray, places_of: dict[int, set[int]]) -> list[tuple[int | None, int, int, int, int]]:
        """(item's id, start, end, edits, words) of the best match of each item that the words contain."""
        out = []
        for item, places in places_of.items():
            w = self.words[item]
            n, k = len(w), allowed(len(w), self.similarity)
            if not k:  # the one segment is the whole item
                if exact := [p for p in places if np.array_equal(words[p : p + n], w)]:
                    out.append((self.ids[item], min(exact), min(exact) + n, 0, n))
                continue
            starts = np.unique((np.array(sorted(places))[:, None] + np.arange(-k, k + 1)).ravel())
            starts = starts[(starts >= 0) & (starts < len(words))]
            hit = np.zeros(len(starts), bool)
            for at in range(0, len(starts), 256):
                part = starts[at : at + 256]
                hit[at : at + 256] = (embed(words, part, n, *self.plan(n)) == self.item_samples(item)).all(axis=2).any(axis=0)
            best = None
            near, ranges = starts[hit], []
            for s in near:  # windows that overlap are verified together
                a, b = max(0, s - k), min(len(words), s + n + 2 * k)
                if ranges and a <= ranges[-1][1]:
                    ranges[-1][1] = max(b, ranges[-1][1])
                else:
                    ranges.append([a, b])
            for a, b in ranges:
                d, s, e = edits(w, words[a:b], k)
                if d <= k and (best is None or d < best[0]):
                    best = (d, a + s, a + e)
            if best:
                out.append((self.ids[item], best[1], best[2], best[0], n))
        return sorted(out, key=lambda m: (m[0] is None, m[0] or 0, m[1:]))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, item_id, start_word, end_word, edits, item_words, similarity) of every document and item that it contains.

    A document contains an item if a stretch of its words is within (1 - similarity) edits (words put in, left out or changed) per word of the item; of several
    stretches the one with the fewest edits counts, then the first. Words are runs of letters, digits and _, in any case. Null
    and empty texts contain nothing, and nothing contains items without words; items of one to four words allow no edit. Items that repeat an id are searched each, and
    the best counts; those of null id share the item_id null. Repeated rows give one row; long texts are searched whole. Extra columns aren't read. Either table
    empty: no rows. Benchmarks beyond BLOCK_WORDS words are searched block by block, each with a pass over the documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("d"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"), F.col(f"`{text_col}`").alias("t"))
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{item_text}`").alias("t")).where("t is not null")
    sizes = items.select("i", (F.length("t") / 2 + 1).alias("n"))
    blocks = max(1, math.ceil((sizes.agg(F.sum("n")).first()[0] or 0) / BLOCK_WORDS))
    kind = rows.schema["d"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, item_id long, start_word int, end_word int, edits int, item_words int, similarity double"
    parts = [_search(spark, rows, items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b), similarity, schema) for b in range(blocks)]
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    best = F.min(F.struct("edits", "start_word", "end_word", "item_words", "similarity")).alias("best")
    return found.groupBy("doc_id", "text_hash", "item_id").agg(best).select("doc_id", "text_hash", "item_id", "best.start_word", "best.end_word", "best.edits", "best.item_words", "best.similarity")


def _search(spark, rows: DataFrame, items: DataFrame, similarity: float, schema: str) -> DataFrame:
    listed = sorted(((r.i, r.t) for r in items.toLocalIterator()), key=lambda item: (item[0] is None, item[0] or 0, item[1]))  # one block, of bounded size
    shared = spark.sparkContext.broadcast(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Items(shared.value, similarity)
        for big in batches:
            for batch in few(big):
                out = []
                texts = [search.table.of(search.table.words(t.as_py())) for t in batch.column(2)]
                for d, h, words, places in zip(batch.column(0), batch.column(1), texts, search.places(texts), strict=True):
                    out += [(d.as_py(), h.as_py(), *m) for m in search.matches(words, places)]
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[3:7]), pa.array([1 - k / m for k, m in zip(cols[5], cols[6], strict=True)], pa.float64())], names=["doc_id", "text_hash", "item_id", "start_word", "end_word", "edits", "item_words", "similarity"])

    return bounded(rows).mapInArrow(run, schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that contain no item, with their columns."""
    bad = contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("b_id"), F.col("text_hash").alias("b_text")).distinct()
    return docs.join(bad, docs[f"`{id_col}`"].eqNullSafe(bad["b_id"]) & (F.xxhash64(docs[f"`{text_col}`"]) == bad["b_text"]), "left_anti")
