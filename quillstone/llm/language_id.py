"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from all training documents, counted in tasks. The weights are trained in one task over a bounded
sample of them (SAMPLE_PER_LANG rows a language on average, fewer where languages are many), with follow-the-regularised-leader per coordinate and elastic-net penalties (the
L1 part keeps weights at zero), and a temperature is then fitted on a fifth of the sample that training leaves out. Prediction runs on every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, plus, without

#: Buckets of hashed n-grams; a power of two.
BUCKETS = 1 << 14
#: The bound on training: so many rows of each language on average, fewer where all languages would give more than SAMPLE together. No language is left out.
SAMPLE_PER_LANG, SAMPLE = 1200, 1200 * 256
#: Labels up to this size are broadcast with their quotas, so that only sampled texts are shuffled.
QUOTA_BYTES = 8 << 20
UNDETERMINED = "und"


def _letter_table() -> np.ndarray:
    """For every character of the basic plane: its lower-case letter's code, 0 if it is no letter."""
    table = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_LETTERS: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Codes of a text's lower-case letters, each run of other characters as one 0."""
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    high = codes >= 1 << 16
    out = _LETTERS[0][np.where(high, 0, codes)]
    if high.any():
        out[high] = [c if chr(c).isalpha() else 0 for c in codes[high]]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def gram_counts(text: str) -> np.ndarray | None:
    """How often each bucket's n-grams (1 to 3 characters) occur in the whole text; None if it has no letter."""
    c = letters(text)
    if not c.any():
        return None
    c = np.concatenate([[0], c, [0]]).astype(np.uint32) if c[0] or c[-1] else c
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    one = c[c != 0] * np.uint32(0x9E3779B1)
    two = (c[:-1] * np.uint32(0x85EBCA6B) + c[1:] + np.uint32(7)) * np.uint32(0x9E3779B1)
    three = ((c[:-2] * np.uint32(0x85EBCA6B) + c[1:-1]) * np.uint32(0xC2B2AE35) + c[2:] + np.uint32(13)) * np.uint32(0x9E3779B1)
    return np.bincount(np.concatenate([one >> shift, two >> shift, three >> shift]).astype(np.int64), minlength=BUCKETS)


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, values) of a text's TF-IDF vector of length 1; None if it has no letter."""
    counts = gram_counts(text)
    if counts is None:
        return None
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    return at, (x / max(np.sqrt((x * x).sum()), 1e-12)).astype(np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Ftrl:
    """Follow-the-regularised-leader, proximal, for a softmax; the elastic net is l1 and l2."""

    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02

    def __post_init__(self):
        self.z = np.zeros((self.classes, BUCKETS + 1))
        self.n = np.zeros((self.classes, BUCKETS + 1))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        at, x = np.append(at, BUCKETS), np.append(x, 1.0)  # the last is the bias
        w = self.weights(at)
        p = softmax(w @ x)
        p[y] -= 1
        g = p[:, None] * x
        n = self.n[:, at]
        self.z[:, at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[:, at] = n + g * g


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that makes the labels likeliest, between 1/4 and 8."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _train(pdf: pd.DataFrame, langs: list[str], epochs: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["o", "y"], kind="stable")  # one order, however rows arrive
    rows = [(np.frombuffer(a, "<i4"), np.frombuffer(x, "<f4").astype(float), y) for a, x, y in zip(pdf["at"], pdf["x"], pdf["y"], strict=True)]
    fit, rest = [r for k, r in enumerate(rows) if k % 5], rows[::5]
    model = Ftrl(len(langs))
    for _ in range(epochs):
        for r in fit or rest:
            model.learn(*r)
    w = model.weights(slice(None))
    t = temperature(np.array([w[:, a] @ x + w[:, BUCKETS] for a, x, _ in rest]), np.array([y for *_, y in rest])) if rest else 1.0
    return pd.DataFrame({"lang": langs, "temperature": t, "w": [v.astype("<f4").tobytes() for v in w]})


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray
    temperature: float
    idf: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        f = features(text, self.idf) if text and self.langs else None
        if f is None:
            return UNDETERMINED, 0.0
        at, x = f
        p = softmax((self.weights[:, at] @ x + self.weights[:, BUCKETS]) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(min(1.0, p[k]))


def train(labelled: DataFrame, order_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", epochs: int = 3) -> Model:
    """A model from labelled texts. Rows of null text or lang teach nothing; texts without letters count only as documents.

    order_col spreads the sample and fixes its order; ties in it fall in language order. Document frequencies cover every row; the weights see rows
    of which each language gives SAMPLE_PER_LANG on average, or an equal share of SAMPLE if that is less. Every label is learned, however rare. Without a row the model knows no language, and predicts none.
    """
    rows = labelled.select(F.xxhash64(F.col(f"`{order_col}`"), F.lit("sample")).alias("o"), F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").alias("l")).where("t is not null and l is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                n += 1
                if (counts := gram_counts(t.as_py())) is not None:
                    df += counts > 0
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"b": pa.array(np.append(at, BUCKETS), pa.int32()), "n": pa.array(np.append(df[at], n), pa.int64())})

    seen = bounded(rows.select("t")).mapInArrow(frequencies, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()  # a row for each bucket at most
    df = np.zeros(BUCKETS + 1)
    for r in seen:
        df[r.b] = r.n
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1
    shares = [(r.l, r.n) for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()]  # a row for each language
    langs = sorted(lang for lang, _ in shares)
    if not langs:
        return Model([], np.zeros((0, BUCKETS + 1), np.float32), 1.0, idf)
    each, place = min(SAMPLE_PER_LANG, max(1, SAMPLE // len(langs))), {lang: k for k, lang in enumerate(langs)}
    quotas = rows.sparkSession.createDataFrame([(lang, place[lang], min(1.0, each / n)) for lang, n in shares], T.StructType([T.StructField("l", rows.schema["l"].dataType), T.StructField("y", T.IntegerType()), T.StructField("quota", T.DoubleType())]))
    if sum(len(str(lang)) + 64 for lang in langs) <= QUOTA_BYTES:  # else Spark joins as it sees fit, and whole texts may be shuffled
        quotas = F.broadcast(quotas)
    sample = rows.join(quotas, "l").where(F.pmod("o", F.lit(1 << 20)) < F.col("quota") * (1 << 20)).select("o", "y", "t")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for o, y, t in zip(*(batch.column(k) for k in range(3)), strict=True):
                if (f := features(t.as_py(), idf)) is not None:
                    out.append((o.as_py(), y.as_py(), f[0].astype("<i4").tobytes(), f[1].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["o", "y", "at", "x"])

    few_rows = bounded(sample).mapInArrow(vectors, "o long, y int, at binary, x binary").withColumn("one", F.lit(1))
    fitted = few_rows.groupBy("one").applyInPandas(lambda pdf: _train(pdf, langs, epochs), "lang string, temperature double, w binary").collect()  # a row for each language
    if not fitted:
        return Model([], np.zeros((0, BUCKETS + 1), np.float32), 1.0, idf)
    return Model([r.lang for r in fitted], np.array([np.frombuffer(r.w, "<f4") for r in fitted]), fitted[0].temperature, idf)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred (string) and score (double, 0 to 1: the calibrated probability of that language).

    Null, empty and letterless texts: und and 0. Equal probabilities: the language that sorts first. Whole texts, repeated rows each. Other columns
    pass through; input columns of the two names are replaced. An empty table gives an empty table.
    """
    kept = without(docs, [n for n in ("lang_pred", "score") if n != text_col])
    place = kept.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages times buckets, both bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.predict(t.as_py()) for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return bounded(kept).mapInArrow(run, plus(kept, ("lang_pred", "string"), ("score", "double")))


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, mod 4, is 2. Null ids: false."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(4)) == 2, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """Trains on the documents that aren't held out and predicts all: what the query returns. Rows of null id teach nothing."""
    model = train(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


