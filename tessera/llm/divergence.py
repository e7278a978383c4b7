"""How far each source of a language lies from the others, by in-mapper stripes.

A partition folds whole documents into hash stripes: language -> term ->
(document frequency, occurrences by source).  A task that holds ``CELLS``
stripe cells spills them as rows and goes on with an empty table; the rows are merged by
(language, term), so a term of any frequency sends one stripe per spill and not one row per
occurrence.  The stripe of the empty term counts documents and thereby lists the groups, also those
without terms: the texts are read once.

The merged stripes of terms kept by their language (in ``LEAST_DOCUMENTS`` documents or more) directly emit
the divergences: as a dense block of terms x sources in numpy, the sum of |p - q| for each pair of
sources and, for terms more frequent in a source than in its language, p - q.  Shares
are whole billionths found by long division in 64-bit integers, exact for
up to 9 * 10**15 occurrences in a group.

Terms are runs of ASCII letters and of characters beyond ASCII; only A-Z are lower-cased.
A text is folded in pieces of about ``PIECE`` bytes that end between terms.

Defined results: null text, lang and source are the empty string; repeated rows are documents of their own;
empty texts count as documents of their group; a language without kept terms has pairs of value 0 and no
term rows; a language with one source has no pairs; equal values are ranked by the item's UTF-8
bytes; an empty table gives an empty result; doc_id and extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, prepare

LEAST_DOCUMENTS = 30
TOP_TERMS = 50
PRIOR = 5
#: Stripe cells (term x source) held by a task before it spills, and rows per spilled batch.
CELLS = 300_000
SPILL_ROWS = 20_000
PIECE = 1 << 20
#: Copies of a language's totals, dealt by term: no language's stripes meet in one task.
SALTS = 64
#: Cells of pair sums a task holds before it emits them.
PAIR_CELLS = 2_000_000

TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BETWEEN = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
DOCUMENT = ""                 # the term of the stripe that counts documents


def terms(text: bytes, piece: int = PIECE) -> Counter:
    """Occurrences by term of a whole text."""
    if len(text) <= piece:
        return Counter(text.translate(TABLE).split())
    found, start = Counter(), 0
    while start < len(text):
        cut = BETWEEN.search(text, start + piece)
        end = cut.start() if cut else len(text)
        found.update(text[start:end].translate(TABLE).split())
        start = end
    return found


class Stripes:
    """language -> term -> {None: document frequency, source: occurrences}."""

    def __init__(self):
        self.table, self.cells = {}, 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        stripes, new = self.table.setdefault(lang, {}), 0
        found = terms(text)
        found[b""] = 1
        for term, n in found.items():
            stripe = stripes.get(term)
            if stripe is None:
                stripes[term] = {None: 1, source: n}
                new += 1
                continue
            stripe[None] += 1
            if source in stripe:
                stripe[source] += n
            else:
                stripe[source] = n
                new += 1
        self.cells += new

    def spill(self):
        """Record batches (lang, term, df, sources, counts) of all stripes; the table is empty after."""
        table, self.table, self.cells = self.table, {}, 0
        for lang, stripes in table.items():
            keys = list(stripes)
            for at in range(0, len(keys), SPILL_ROWS):
                part = keys[at:at + SPILL_ROWS]
                df, sources, counts, ends = [], [], [], [0]
                for term in part:
                    stripe = stripes.pop(term)
                    df.append(stripe.pop(None))
                    sources.extend(stripe)
                    counts.extend(stripe.values())
                    ends.append(len(sources))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array(df, pa.int64()),
                     pa.ListArray.from_arrays(ends, pa.array(sources, pa.string())),
                     pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))], ["lang", "term", "df", "sources", "counts"])


def fold(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """lang, term, df, sources, counts: the stripes each partition spilled."""
    def run(batches):
        held = Stripes()
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                held.add(lang, source, text.as_py())
                if held.cells >= cells:
                    yield from held.spill()
        yield from held.spill()

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    return docs.select(*named, text.alias("text")).mapInArrow(
        run, "lang string, term string, df bigint, sources array<string>, counts array<bigint>")


def merge(folded: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, cells (source, n): one stripe per term its language keeps, and per language that of its documents."""
    dealt = folded.repartition("lang", "term")
    cells = dealt.select("lang", "term", F.posexplode(F.arrays_zip("sources", "counts")).alias("place", "cell"),
                         "df").select("lang", "term", F.col("cell.sources").alias("source"), F.col("cell.counts").alias("n"),
                                      F.when(F.col("place") == 0, F.col("df")).otherwise(0).alias("df"))
    by = cells.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    return (by.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("cells"))
            .where((F.col("df") >= least) | (F.col("term") == DOCUMENT)).drop("df"))


def share(counts: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(10**9 * (count + PRIOR) / (total + PRIOR * kept)), by long division in steps of a thousand."""
    divisor = total + PRIOR * kept
    whole, rest = np.divmod(counts + PRIOR, divisor)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, divisor)
        whole = whole * 1000 + digit
    return whole + 1


def emit(stripes: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, part, item, value: pair sums by task, and the terms more frequent in a source than in its language."""
    names = ["lang", "source", "part", "item", "value"]
    kinds = [pa.string()] * 4 + [pa.int64()]

    def pairs(sums):
        for lang, (sources, found) in sums.items():
            g, other = np.nonzero(~np.eye(len(sources), dtype=bool))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(g), kinds[0]), pa.array(sources).take(pa.array(g)), pa.array(["pair"] * len(g), kinds[0]),
                 pa.array(sources).take(pa.array(other)), pa.array(found[g, other], kinds[4])], names)

    def run(batches):
        sums = {}
        for b in batches:
            langs = b.column(0).to_pylist()
            for lang in dict.fromkeys(langs):
                rows = [k for k, x in enumerate(langs) if x == lang]
                sources, total = b.column(3)[rows[0]].as_py(), np.array(b.column(4)[rows[0]].as_py(), np.int64)
                kept = b.column(5)[rows[0]].as_py()
                place = {s: k for k, s in enumerate(sources)}
                counts = np.zeros((len(rows), len(sources)), np.int64)
                for k, row in enumerate(rows):
                    for cell in b.column(2)[row].as_py():
                        counts[k, place[cell["source"]]] = cell["n"]
                p = share(counts, total, kept)
                q = share(counts.sum(axis=1), total.sum(), kept)
                if lang not in sums:
                    if sum(len(s) ** 2 for s, _ in sums.values()) > PAIR_CELLS:
                        yield from pairs(sums)
                        sums = {}
                    sums[lang] = (sources, np.zeros((len(sources),) * 2, np.int64))
                found = sums[lang][1]
                for g in range(len(sources)):
                    found[g] += np.abs(p - p[:, g:g + 1]).sum(axis=0)
                t, g = np.nonzero((counts > 0) & (p > q[:, None]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(t), kinds[0]), pa.array(sources).take(pa.array(g)), pa.array(["term"] * len(t), kinds[0]),
                     b.column(1).take(pa.array(np.array(rows)[t])), pa.array((p - q[:, None])[t, g], kinds[4])], names)
        yield from pairs(sums)

    dealt = stripes.withColumn("salt", F.pmod(F.hash("term"), F.lit(SALTS)))
    copies = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (dealt.join(copies, ["lang", "salt"]).select("lang", "term", "cells", "all", "totals", "kept")
            .mapInArrow(run, "lang string, source string, part string, item string, value bigint"))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank for the rows of ``docs`` (lang, source, text)."""
    prepare(docs.sparkSession)
    merged = materialise(merge(fold(docs, cells), least), "divergence-stripes")
    stripes = merged.where(F.col("term") != DOCUMENT)
    groups = merged.where(F.col("term") == DOCUMENT).select("lang", F.explode("cells.source").alias("source"), F.lit(0).alias("n"))
    occurring = stripes.select("lang", F.explode("cells").alias("c")).select("lang", "c.source", "c.n")
    by = groups.unionByName(occurring).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kept = stripes.groupBy("lang").agg(F.count("*").alias("kept"))
    rows = F.sort_array(F.collect_list(F.struct("source", "n")))          # one row per language, one entry per source of it
    totals = (by.groupBy("lang").agg(rows.alias("by")).join(kept, "lang", "left")
              .select("lang", F.col("by.source").alias("all"), F.col("by.n").alias("totals"), F.coalesce("kept", F.lit(0)).alias("kept")))
    totals = materialise(totals, "divergence-totals")
    found = materialise(emit(stripes, totals), "divergence-emitted")

    none = (totals.select("lang", "all", F.explode("all").alias("source")).select("lang", "source", F.explode("all").alias("item"))
            .where("source != item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("bigint").alias("value")))
    pair = (none.unionByName(found.where("part = 'pair'")).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(order)) for x in (pair, found.where("part = 'term'"))]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
 t AS (SELECT doc, lang, source, term, count(*) AS n FROM (SELECT doc, lang, source, unnest(words) AS term FROM d) GROUP BY ALL),
 kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(*) >= 30),
 size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
 g AS (SELECT DISTINCT lang, source FROM d),
 c AS (SELECT lang, source, term, sum(n) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
 cell AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang)
          LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
 total AS (SELECT lang, source, sum(n) AS s FROM cell GROUP BY ALL),
 p AS (SELECT lang, source, term, n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (s + 5 * v) AS BIGINT) AS p
       FROM cell JOIN total USING (lang, source) JOIN size USING (lang)),
 l AS (SELECT lang, term, sum(n) AS n FROM cell GROUP BY ALL),
 lt AS (SELECT lang, sum(n) AS s FROM l GROUP BY lang),
 q AS (SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (s + 5 * v) AS BIGINT) AS q
       FROM l JOIN lt USING (lang) JOIN size USING (lang)),
 pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
          GROUP BY ALL),
 term AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
 r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
       UNION ALL
       SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""
