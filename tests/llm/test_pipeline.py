"""The pipeline on a small table, stage by stage, against plain code."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quillstone.llm import language_id, pieces
from quillstone.llm.common import tokenizer_path

from .test_operators import brute_lines, classes, near_copies

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    texts = near_copies(10) + ["first line\nsecond line\nthird line\nown one", "first line\nsecond line\nthird line\nown two", f"some {item} more words", "12 34"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows


def test_stage_by_stage(spark, tables):
    at, rows = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    known = P.keep_known_languages(spark, docs, at)
    assert known.columns == docs.columns
    assert {r.doc_id for r in known.collect()} == {i for i, t, *_ in rows if re.search(r"[^\W\d_]", t or "")}
    cut = P.drop_repeated_lines(spark, known, at)
    kept = [(r.doc_id, r.text) for r in known.collect()]
    want = {i: t for i, (t, n) in brute_lines(kept).items() if n == 0 or t.strip()}
    assert {r.doc_id: r.text for r in cut.collect()} == want
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    alone = P.drop_near_duplicates(spark, cut, at)
    assert {r.doc_id for r in alone.collect()} == set(classes(sorted(want.items())).values())
    clean = P.drop_benchmark_leaks(spark, alone, at)
    leak = next(i for i, t, *_ in rows if t and "epsilon zeta" in t)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in alone.collect()} - {leak}
    sp = pieces.processor(tokenizer_path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert {r.doc_id: r.n_tokens for r in P.encode_pieces(spark, clean, at).collect()} == {i: len(sp.encode(t)) for i, t in texts.items()}
    assert {r.doc_id for r in P.run(spark, at).collect()} == set(texts)


def test_empty_documents(spark, tables, tmp_path):
    at, _ = tables
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{at}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_crc_is_the_contracts(spark):
    ids = [0, 1, 7, 12, 12, 10**12, -3, None]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", language_id.held_out(F.col("doc_id")).alias("held")).collect()
    assert [(r.doc_id, r.held) for r in rows] == [(i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i in ids]


def test_nulls_repeats_and_long_texts(spark, tables, tmp_path):
    """Null ids and repeated rows pass or go like others, a long text stays whole, and no stage gives a row twice."""
    at, rows = tables
    long = "these are words of a long text that say something new each time " + " ".join(f"word{n}" for n in range(60000))
    odd = [(None, "a text without an id but with a language and some words in it", None, None, None), (900, long, "en", "s", len(long)), (901, None, None, None, None), (902, "", "en", None, 0)]
    spark.createDataFrame(rows + odd, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{at}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    sp = pieces.processor(tokenizer_path("piece_bpe_32k.model"))
    out = P.run(spark, str(tmp_path)).collect()
    counts = {r.doc_id: r.n_tokens for r in out}
    assert len(counts) == len(out) and None in counts and counts[900] == len(sp.encode(long)) and not {901, 902} & set(counts)


def test_extra_columns_of_clashing_names_pass_through(spark, tables):
    """Columns named like those that stages add or use inside keep their values, and change nothing else."""
    at, _ = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    names = ["lang_pred", "score", "n_lines", "n_removed", "n_id", "n_key", "label", "kept", "k_id", "item_id", "text_hash", "w_id", "key", "h", "band"]
    for (name, stage), (_, again) in zip(P.STAGES[:-1], P.STAGES[:-1], strict=True):
        wide = docs
        for n in names:
            wide = wide.withColumn(n, F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")))
        plain = sorted(map(tuple, stage(spark, docs, at).collect()), key=str)
        found = again(spark, wide, at)
        assert found.columns == wide.columns, name
        rows = found.collect()
        assert sorted((tuple(r)[: len(docs.columns)] for r in rows), key=str) == plain, name
        assert all(r[n] == f"{n} of {r.doc_id}" for r in rows for n in names), name
