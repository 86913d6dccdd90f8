"""Token counts by pre-token: pieces are counted once per distinct pre-token, joined to each document's frequencies, and summed.

A pre-token is here a text between white space (or a chunk, for sentencepiece models). Frequent ones are joined by a broadcast
table of bounded size; the others, of which each is in few documents or long, by a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, without, written
from .pieces import chunks, few, processor, splits_at_marks

#: Entries of the table within a task at most before it starts anew; bounds memory, not results.
TABLE = 150_000
#: Pre-tokens that are broadcast at most, and the characters of each: about 40 MB. The others are joined by a shuffle.
HEAD, SHORT = 400_000, 64


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def drops_space(path: str) -> bool:
    """Whether white space parts pre-tokens and gives no tokens itself, so that words can be counted one by one."""
    t = tokenizer(path)
    words = ["a", "b1", "c's", "é!", "...", "中文"]
    count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    return all(count(s) == 0 for s in (" ", "\n", "\t \r\n")) and count(" \n".join(words)) == sum(map(count, words))


#: Letters whose words need no normalizer but lower case, and marks that end words.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?"
PLAIN = re.compile(f"([{LETTERS}]+)([{MARKS}]*)")


def byte_alphabet() -> dict[int, str]:
    """For str.translate: the characters that byte-level BPE writes for a character's UTF-8 bytes."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    shown = {b: chr(b) if b in printable else chr(next(other)) for b in range(256)}
    return {c: "".join(shown[b] for b in chr(c).encode()) for c in range(256)}


ALPHABET = byte_alphabet()


class CountTable:
    """From a text between white space to its number of tokens, through its pre-tokens."""

    def __init__(self, path: str):
        self.tokenizer = t = tokenizer(path)
        self.pieces: dict[str, int] = {}
        special = [x.content for x in t.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        letters = "".join(chr(c) for c in range(65, 256) if re.match(f"[{LETTERS}]", chr(c)))
        #: Whether a plain word's pre-tokens are its letters in lower case and then its marks.
        self.plain = bool(t.pre_tokenizer) and [p for p, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(letters + MARKS) if t.normalizer else letters + MARKS)] == [letters.lower().translate(ALPHABET), MARKS]

    def of_pretoken(self, p: str) -> int:
        if (n := self.pieces.get(p)) is None:
            n = self.pieces[p] = len(self.tokenizer.model.tokenize(p))
        return n

    def of_word(self, word: str) -> int:
        t = self.tokenizer
        if self.plain and (m := PLAIN.fullmatch(word)):
            return self.of_pretoken(m[1].lower().translate(ALPHABET)) + (self.of_pretoken(m[2]) if m[2] else 0)
        if self.special and self.special.search(word):
            return len(t.encode(word, add_special_tokens=False).ids)
        text = t.normalizer.normalize_str(word) if t.normalizer else word
        return sum(self.of_pretoken(p) for p, _ in t.pre_tokenizer.pre_tokenize_str(text)) if t.pre_tokenizer else self.of_pretoken(text)

    def of_words(self, words: list[str]) -> list[int]:
        if len(self.pieces) > TABLE:
            self.pieces.clear()
        return [self.of_word(w) for w in words]


def _frequencies(path: str) -> Callable[[str], Counter] | None:
    """What counts a text's pre-tokens; None where white space doesn't part tokens."""
    if path.endswith(".model"):
        return (lambda text: Counter(chunks(text))) if splits_at_marks(path) else None
    if not drops_space(path):
        return None

    def words(text: str) -> Counter:
        found = Counter(text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))
        found.pop("", None)
        return found

    return words


def _sizes(path: str) -> Callable[[list[str]], list[int]]:
    """What counts the tokens of pre-tokens, or of whole texts where _frequencies has none."""
    if not path.endswith(".model"):
        return CountTable(path).of_words if drops_space(path) else lambda texts: [len(tokenizer(path).encode(t, add_special_tokens=False).ids) for t in texts]
    alone = splits_at_marks(path)
    return lambda texts: [len(x) if t or not alone else 1 for t, x in zip(texts, processor(path).encode(texts, num_threads=1), strict=True)]


def token_counts(docs: DataFrame, path: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(other columns, n_bytes, n_tokens, over_limit) of every row: bytes in UTF-8 (long), tokens (long; as the library for the file
    counts, special strings inside texts as by its default), and whether n_tokens > limit (boolean).

    Null and empty texts count 0. A tokenizer for which white space doesn't part tokens is run on whole texts. Whole texts are
    counted, however long; repeated rows each. The text itself isn't passed on; other input columns of the three names are replaced.
    An empty table gives an empty table.
    """
    others = without(docs, ["n_bytes", "n_tokens", "over_limit", text_col]).columns
    text = F.col(f"`{text_col}`")
    own = F.struct(*[F.col(f"`{c}`") for c in others], F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")).alias("own")
    rows = docs.select(own, F.coalesce(text, F.lit("")).alias("t"))
    summed = _by_pretoken(rows, path) if _frequencies(path) else _whole(rows, path)
    return summed.select("own.*", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _whole(rows: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _sizes(path)
        for big in batches:
            for batch in few(big):
                n = pa.array([sizes([t])[0] if t else 0 for t in batch.column(1).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), n], names=["own", "n_tokens"])

    return bounded(rows).mapInArrow(run, T.StructType([rows.schema["own"], T.StructField("n_tokens", T.LongType())]))


def _by_pretoken(rows: DataFrame, path: str) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequencies = _frequencies(path)
        for big in batches:
            for batch in few(big):
                found = [frequencies(t) if t else {} for t in batch.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype("<i4")
                w = pa.array([w for x in found for w in x], pa.string())
                n = pa.array([n for x in found for n in x.values()], pa.int32())
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([w, n], ["w", "n"]))
                yield pa.RecordBatch.from_arrays([batch.column(0), listed], names=["own", "f"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _sizes(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes(batch.column(0).to_pylist()), pa.int64())], names=["w", "n_docs", "pieces"])

    schema = T.StructType([rows.schema["own"], T.StructField("f", T.DataType.fromDDL("array<struct<w:string,n:int>>"))])
    counted = written(bounded(rows).mapInArrow(count, schema).withColumn("row", F.monotonically_increasing_id()), "frequencies", "zstd")
    flat = counted.select("row", F.inline("f"))
    pieces = written(flat.groupBy("w").agg(F.count(F.lit(1)).alias("n_docs")).mapInArrow(measure, "w string, n_docs long, pieces long"), "pieces")

    n, least = pieces.count(), 0
    head = pieces.where(F.length("w") <= SHORT)
    while (n_head := head.where(F.col("n_docs") > least).count()) > HEAD:
        least = max(1, 2 * least)
    head = F.broadcast(head.where(F.col("n_docs") > least).select("w", "pieces"))
    weighed = [flat.join(head, "w").select("row", (F.col("n") * F.col("pieces")).alias("k"))]
    if n_head < n:
        tail = pieces.where((F.length("w") > SHORT) | (F.col("n_docs") <= least)).select("w", "pieces")
        weighed.append(flat.join(head.select("w"), "w", "left_anti").join(tail, "w").select("row", (F.col("n") * F.col("pieces")).alias("k")))
    per_row = [x.groupBy(F.col("row").alias("r")).agg(F.sum("k").alias("k")) for x in weighed]
    sums = per_row[0] if len(per_row) == 1 else per_row[0].union(per_row[1]).groupBy("r").agg(F.sum("k").alias("k"))
    return counted.join(sums, F.col("row") == F.col("r"), "left").select("own", F.coalesce("k", F.lit(0)).cast("long").alias("n_tokens"))
