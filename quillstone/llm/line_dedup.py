"""Line dedup: overlapping three-line windows, hashed, compared over all documents; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without

WINDOW = 3


def _windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text hash, position, two 64-bit hashes) of every window that isn't blank throughout.

    The text's hash stands beside the id so that two texts under one id stay two documents."""
    lines = docs.select(F.col(f"`{id_col}`").alias("w_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("w_text"), F.split(F.col(f"`{text_col}`"), "\n").alias("w_lines"))
    at = lambda i, k: F.get(F.col("w_lines"), i + F.lit(k))

    def window(i: Column) -> Column:
        parts = [at(i, k) for k in range(WINDOW)]
        return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"), F.concat(*parts).rlike(r"[^ \t\r\f\x0B]").alias("said"))

    starts = F.when(F.size("w_lines") >= WINDOW, F.sequence(F.lit(0), F.size("w_lines") - WINDOW)).otherwise(F.array().cast("array<int>"))
    return lines.select("w_id", "w_text", F.posexplode(F.transform(starts, window)).alias("w_pos", "w")).where("w.said").select("w_id", "w_text", "w_pos", F.col("w.a").alias("w_a"), F.col("w.b").alias("w_b"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes from every text the lines that windows repeated from earlier cover; adds n_lines and n_removed (long).

    A window is three consecutive lines, compared exactly (by 128 bits of hash). Its first occurrence, by id, then position,
    stays; every later one, in the same or another document, covers its three lines, covered lines go, and the others are
    joined again. Every removed line stays somewhere. Null texts stay null, with 0 lines; texts of under three lines and windows
    of blank lines are left alone; a text whose lines all go becomes empty. Rows that repeat id and text are one document
    and keep the same text each; null ids sort first. Other columns pass through; input columns n_lines and n_removed
    are replaced. An empty table gives an empty table.
    """
    docs = without(docs, [c for c in ("n_lines", "n_removed") if c not in (id_col, text_col)])
    windows = _windows(docs, id_col, text_col)
    first = windows.groupBy("w_a", "w_b").agg(F.min(F.struct("w_id", "w_text", "w_pos")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("w_a").alias("f_a"), F.col("w_b").alias("f_b"), "f")
    later = windows.join(first, (F.col("w_a") == F.col("f_a")) & (F.col("w_b") == F.col("f_b"))).where(~F.struct("w_id", "w_text", "w_pos").eqNullSafe(F.col("f")))
    cuts = later.groupBy("w_id", "w_text").agg(F.sort_array(F.collect_set("w_pos")).alias("w_cuts"))
    own = F.col("w_row")[text_col]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("w_row"))  # apart from this operator's own names
    joined = rows.join(cuts, F.col("w_row")[id_col].eqNullSafe(F.col("w_id")) & (F.xxhash64(own) == F.col("w_text")), "left")
    left = joined.withColumn("w_lines", F.split(own, "\n")).withColumn("w_edges", F.concat(F.array(F.lit(-WINDOW)), F.col("w_cuts"), F.array(F.size("w_lines"))))
    left = left.withColumn("w_kept", F.when(F.col("w_cuts").isNotNull(), kept_of("w_lines", "w_edges", "w_cuts")))
    text = F.when(F.col("w_cuts").isNull(), own).otherwise(F.array_join("w_kept", "\n"))
    n_lines = F.coalesce(F.when(own.isNotNull(), F.size("w_lines")), F.lit(0)).cast("long")
    removed = F.when(F.col("w_cuts").isNull(), F.lit(0)).otherwise(F.size("w_lines") - F.size("w_kept")).cast("long")
    return left.select(*[text.alias(c) if c == text_col else F.col("w_row")[c].alias(c) for c in docs.columns], n_lines.alias("n_lines"), removed.alias("n_removed"))


def kept_of(lines: str, edges: str, cuts: str) -> Column:
    """The lines between the covered stretches: from three after one cut to just before the next."""
    e = lambda k: F.get(F.col(edges), k)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda k: F.slice(F.col(lines), e(k) + WINDOW + 1, F.greatest(F.lit(0), e(k + 1) - e(k) - WINDOW))))


#: The same in DuckDB, windows compared as text.
SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS p FROM l WHERE len(ls) >= 3),
k AS (SELECT doc_id, p, ls[p] || chr(10) || ls[p + 1] || chr(10) || ls[p + 2] AS key FROM w),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY key ORDER BY doc_id, p) AS nth FROM k WHERE regexp_matches(key, '[^ \t\r\n\f\x0B]')),
c AS (SELECT DISTINCT doc_id, p + o AS p FROM r, (VALUES (0), (1), (2)) AS v(o) WHERE nth > 1),
e AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS p FROM l),
k2 AS (SELECT e.doc_id, string_agg(line, chr(10) ORDER BY e.p) FILTER (WHERE c.p IS NULL) AS text, count(*) AS n_lines, count(c.p) AS n_removed FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.p = e.p GROUP BY e.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k2.text, '') END AS text, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN k2 USING (doc_id)
"""
