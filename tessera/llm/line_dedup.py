"""Line dedup over overlapping three-line windows.

Every run of ``WINDOW`` consecutive lines of a document is hashed (128 bits).  A
window seen before - in a document with a smaller ``doc_id``, or further up in
the same document - marks its lines as covered; the covered positions of all such
windows are merged and those lines are removed.  The first occurrence of each
window stays where it is.

Everything is one DataFrame plan: windows of a document are built by a
``transform`` over its line array, the first occurrence per window is a
``min`` that combines map-side (a window in a third of all documents sends one
row per task), and the join back to the occurrences is a plain equi-join, which
adaptive execution splits when one window is hot.

Defined results
  * null text: no lines are removed, the text stays null, ``n_lines`` is 0;
  * empty text: one empty line, kept; texts shorter than the window stay whole;
  * windows of blank lines only are never counted as repeated;
  * repeated rows (same ``doc_id`` and text) are one document and get the same
    result; rows sharing only the ``doc_id`` are ordered by a hash of the text;
    null ids come first;
  * an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import same

WINDOW = 3


def _windows(docs: DataFrame, width: int) -> DataFrame:
    """(id, th, pos, w): one row per window with a word in it; w is the window's 128-bit hash."""
    lines = docs.select("id", "th", F.split("text", "\n", -1).alias("lines")).where(F.size("lines") >= width)
    grams = F.expr(
        f"transform(sequence(0, size(lines) - {width}), p -> named_struct('pos', p, 'w', "
        f"concat_ws('\\n', slice(lines, p + 1, {width}))))")
    return (lines.select("id", "th", F.explode(grams).alias("g"))
            .where(F.col("g.w").rlike(r"\S"))
            .select("id", "th", F.col("g.pos").alias("pos"), F.unhex(F.md5("g.w")).alias("w")))


def covered_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(id, th, starts): per document the starts of the windows seen before (documents without one are absent)."""
    occ = _windows(docs, width)
    here = F.struct("id", "th", "pos")
    first = (occ.groupBy("w").agg(F.min(here).alias("first"), F.max(here).alias("last"))
             .where(~same(F.col("first"), F.col("last"))).select("w", "first"))
    later = occ.join(first, "w").where(~same(here, F.col("first")))
    return later.groupBy("id", "th").agg(F.collect_set("pos").alias("starts"))


def line_dedup(docs: DataFrame, width: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text without the repeated lines, n_lines, n_removed, and the columns ``keep``."""
    own = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"),
                      (F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(None)).alias("others"))
    hits = covered_lines(own.where(F.col("text").isNotNull()).select("id", "th", "text"), width).select(
        F.col("id").alias("hit_id"), F.col("th").alias("hit_th"), "starts")
    joined = own.join(hits, same(F.col("id"), F.col("hit_id")) & (F.col("th") == F.col("hit_th")), "left")
    gone = F.expr(f"flatten(transform(starts, p -> sequence(p, p + {width - 1})))")
    cut = (joined.withColumn("lines", F.split("text", "\n", -1))
           .withColumn("kept", F.when(F.col("starts").isNotNull(), F.array_except(F.expr("sequence(0, size(lines) - 1)"), gone))))
    return cut.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("starts").isNull(), F.col("text"))
        .otherwise(F.expr("array_join(transform(array_sort(kept), p -> element_at(lines, p + 1)), '\n')")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("bigint").alias("n_lines"),
        F.when(F.col("starts").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).cast("bigint").alias("n_removed"),
        *(F.col(f"others.`{c}`").alias(c) for c in keep))


SQL = """
WITH lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
occ AS (
  SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS pos FROM lines WHERE len(lines) >= 3),
win AS (
  SELECT doc_id, pos, lines[pos + 1] || chr(10) || lines[pos + 2] || chr(10) || lines[pos + 3] AS w FROM occ),
ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS rn
  FROM win WHERE regexp_matches(w, '[^ \\t\\n\\f\\r\\x0B]')),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps
  FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM ranked WHERE rn > 1) GROUP BY doc_id)
SELECT l.doc_id AS doc_id,
       array_to_string([l.lines[i + 1] FOR i IN range(0, len(l.lines))
                        IF NOT coalesce(list_contains(g.ps, i), false)], chr(10)) AS text,
       CAST(len(l.lines) AS BIGINT) AS n_lines,
       CAST(coalesce(len(g.ps), 0) AS BIGINT) AS n_removed
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id
"""
