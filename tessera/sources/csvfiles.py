"""CSV folders whose files differ (rows A1-A3): every file with its own header and its own types.

* ``header_index`` reads the first line of each file (one narrow pass over the
  first split of each): one row per file with the dataset it belongs to.
* files of one header are read together, each header by its own names, and the
  parts are united by name; a column a file does not have is null there.
* ``type_catalog`` counts, in one aggregate keyed by dataset, how many values of
  each column are whole numbers and how many are numbers: a column is numeric in
  a dataset only if every value of that dataset parses, whatever other files hold.
* ``read_groups`` gives one DataFrame per distinct (columns, types), so every later
  check sees a file's own schema; each file is read by one of them.

What reaches the driver is one row per file (path, dataset, header) and one row per dataset
(three counts per column), as many as the file listing Spark holds itself.

Defined results: an empty file has no header and is no dataset; a file with a header only has no
rows and is no dataset either; unnamed and repeated header names are numbered; the files of
a dataset may differ in header, its columns are then those of all its files; a header
that itself spans lines is not supported.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import profiles as P
from ..frame import DATASET, col

#: What counts as a number in text (no type suffixes such as 12D).
NUMBER = r"(?i)^[+-]?([0-9]+[.]?[0-9]*(e[+-]?[0-9]+)?|[.][0-9]+(e[+-]?[0-9]+)?|inf|infinity)$"
INTEGER = r"^[+-]?[0-9]+$"
GLOB_CHARACTERS = "\\{}[]*?"


@dataclass(frozen=True)
class File:
    """One CSV file: its path, the dataset it belongs to, its column names."""

    path: str
    dataset: str
    names: tuple


def header_names(line: str) -> tuple:
    """Column names of a header line; unnamed and repeated ones are numbered."""
    found, seen = [], {}
    for i, name in enumerate(next(csv.reader([line.lstrip("﻿")]), [])):
        name = name if name != "" else f"Unnamed: {i}"
        k = seen.get(name, 0)
        seen[name] = k + 1
        found.append(name if not k else f"{name}.{k}")
    return tuple(found)


def file_name() -> Column:
    return F.col("_metadata.file_name")


def plain_path(file_path: str) -> str:
    """A path of file metadata (URI-encoded) as a reader takes it: decoded, glob characters escaped."""
    return "".join("\\" + c if c in GLOB_CHARACTERS else c for c in unquote(file_path))


def header_index(spark: SparkSession, paths, glob: str | None = None, dataset: Column | None = None) -> list[File]:
    """The files under ``paths`` with their datasets (default: file name) and headers, in path order."""
    r = spark.read
    if glob:
        r = r.option("pathGlobFilter", glob)
    lines = (r.text(paths).where(F.col("_metadata.file_block_start") == 0)
             .select(F.col("_metadata.file_path").alias("path"), (file_name() if dataset is None else dataset).alias(DATASET),
                     F.col("value"), F.monotonically_increasing_id().alias("at")))
    first = lines.groupBy("path").agg(F.min_by(F.struct(DATASET, "value"), "at").alias("first"))
    rows = sorted((r["path"], r["first"][DATASET], r["first"]["value"]) for r in first.collect())
    return [File(plain_path(p), d, header_names(v)) for p, d, v in rows]


def null_tokens(df: DataFrame, columns=None, tokens=None) -> DataFrame:
    """A2: the CSV reader's NA tokens become nulls (string columns only)."""
    toks = list(tokens if tokens is not None else P.NA_TOKENS)
    cols = set(columns if columns is not None else [c for c in df.columns if c != DATASET])
    return df.select(*[F.when(col(c).isin(toks), None).otherwise(col(c)).alias(c) if c in cols else col(c)
                       for c in df.columns])


READ_ORDER = "read_order"


def read_order() -> Column:
    """Place of a row in its input: file, split of the file, place in the split - the same under any partitioning."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("place"))


def string_rows(spark: SparkSession, files: list[File], dataset: Column | None = None, multi_line: bool = False,
                ordered: bool = False) -> DataFrame:
    """A1 + A2: the rows of ``files``, every column a string, each file read by its own header.

    With ``ordered`` their ``read_order`` comes along.
    """
    by = {}
    for f in files:
        by.setdefault(f.names, []).append(f.path)
    parts = []
    for names, paths in by.items():
        schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
        rows = (spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", multi_line)
                .option("escape", '"').option("nullValue", None).csv(paths))
        ds = (file_name() if dataset is None else dataset).alias(DATASET)
        more = [read_order().alias(READ_ORDER)] if ordered else []
        parts.append(null_tokens(rows.select(*[col(n) for n in names], ds, *more), names))
    if not parts:
        return spark.createDataFrame([], f"`{DATASET}` string")
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    last = [DATASET] + [READ_ORDER] * ordered
    return whole.select(*[col(c) for c in whole.columns if c not in last], *last)


def type_counts(columns: list[str]) -> list[Column]:
    """Three counts per column: values, whole numbers, numbers."""
    aggs = []
    for i, c in enumerate(columns):
        name = c.replace("`", "``")
        s = F.trim(col(c))
        aggs += [F.count(col(c)).alias(f"n{i}"),
                 F.count_if(s.rlike(INTEGER) & F.expr(f"try_cast(trim(`{name}`) as bigint)").isNotNull()).alias(f"i{i}"),
                 F.count_if(s.rlike(NUMBER) & F.expr(f"try_cast(trim(`{name}`) as double)").isNotNull()).alias(f"d{i}")]
    return aggs


def type_of(row, i: int) -> str:
    """A3: bigint or double only if there are values and all of them parse."""
    n = row[f"n{i}"]
    return "bigint" if n and row[f"i{i}"] == n else "double" if n and row[f"d{i}"] == n else "string"


def type_catalog(rows: DataFrame) -> dict[str, dict[str, str]]:
    """A3: dataset -> column -> type, from one aggregate over string ``rows`` keyed by dataset."""
    columns = [c for c in rows.columns if c != DATASET]
    found = rows.groupBy(DATASET).agg(F.lit(0).alias("_"), *type_counts(columns)).collect()
    return {r[DATASET]: {c: type_of(r, i) for i, c in enumerate(columns)} for r in found}


def cast_to(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """String columns cast to their numeric types (numbers may stand between blanks)."""
    exprs = []
    for c in rows.columns:
        name = c.replace("`", "``")
        exprs.append(F.expr(f"try_cast(trim(`{name}`) as {types[c]})").alias(c) if types.get(c) in ("bigint", "double") else col(c))
    return rows.select(*exprs)


def signatures(spark: SparkSession, files: list[File], dataset: Column | None = None, multi_line: bool = False,
               promote: bool = True) -> dict[tuple, list[File]]:
    """((column, type), ...) -> the files whose dataset has these columns and types."""
    columns = {}
    for f in files:
        columns.setdefault(f.dataset, dict.fromkeys(f.names)).update(dict.fromkeys(f.names))
    types = type_catalog(string_rows(spark, files, dataset, multi_line)) if promote and files else {}
    by = {}
    for f in files:
        if promote and f.dataset not in types:          # a header without rows
            continue
        of = types.get(f.dataset, {})
        by.setdefault(tuple((c, of.get(c, "string")) for c in columns[f.dataset]), []).append(f)
    return by


def read_groups(spark: SparkSession, paths, dataset: Column | None = None, multi_line: bool = False,
                glob: str | None = None, promote: bool = True) -> list[DataFrame]:
    """One DataFrame (with ``dataset``) per distinct schema among the files under ``paths``."""
    files = header_index(spark, paths, glob, dataset)
    out = []
    for signature, own in signatures(spark, files, dataset, multi_line, promote).items():
        rows = string_rows(spark, own, dataset, multi_line).select(*[col(c) for c, _ in signature], DATASET)
        out.append(cast_to(rows, dict(signature)))
    return out


def united_types(found: list[tuple]) -> dict[str, str]:
    """One type per column of several signatures: numeric where every dataset with the column agrees."""
    types = {}
    for signature in found:
        for c, t in signature:
            types.setdefault(c, set()).add(t)
    return {c: "string" if "string" in ts else "double" if "double" in ts else "bigint" for c, ts in types.items()}
