"""Sources and sinks (rows A1-A13).

Readers add a ``dataset`` column taken from each file's name
(``_metadata.file_name``), so a folder of many files is one DataFrame and
every later result is keyed by file.  CSV is read all-string, each file by its
own header, NA tokens are nulled, then columns are promoted to numbers
all-or-nothing per file with one profiling aggregate (:mod:`.csvfiles`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import DATASET, col
from . import csvfiles as CSV
from .csvfiles import null_tokens  # noqa: F401  (part of this module's interface)

# FIXED VALUES -- format by extension; what the automatic path accepts.
FORMATS = {"csv": "csv", "parquet": "parquet", "json": "json", "xlsx": "excel", "xls": "excel"}
SUPPORTED_EXTENSIONS = (".csv", ".parquet", ".json", ".xlsx", ".xls")


def format_of(path: str) -> str:
    """Format from the extension; unknown -> csv."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    ext = name.rsplit(".", 1)[-1] if "." in name else "csv"
    return FORMATS.get(ext, "csv")


def is_supported(path: str) -> bool:
    """A6 skip rule of the automatic path."""
    return path.lower().endswith(SUPPORTED_EXTENSIONS)


def _with_file_dataset(df: DataFrame, dataset: Column | None = None) -> DataFrame:
    return df.withColumn(DATASET, CSV.file_name() if dataset is None else dataset)


def read_csv_strings(spark: SparkSession, paths, multi_line: bool = False, glob: str | None = None,
                     dataset: Column | None = None) -> DataFrame:
    """A1 + A2: header CSV, every column a string, NA tokens as null; each file is read by its own header.

    Files are split across tasks; ``multi_line=True`` accepts quoted fields
    with embedded newlines, at the price of reading each file in one task.
    """
    return CSV.string_rows(spark, CSV.header_index(spark, paths, glob, dataset), dataset, multi_line)


def numeric_profile(df: DataFrame, columns=None) -> dict:
    """A3 profile: for each string column, is every non-null value an integer / a number?

    One aggregate over the whole input; returns a small dict on the driver
    (three counts per column -- metadata, not data).
    """
    cols = columns if columns is not None else [f.name for f in df.schema.fields
                                                if f.dataType.simpleString() == "string" and f.name != DATASET]
    if not cols:
        return {}
    row = df.agg(*CSV.type_counts(cols)).collect()[0]
    return {c: CSV.type_of(row, i) for i, c in enumerate(cols)}


def promote_numeric(df: DataFrame, profile: dict | None = None) -> DataFrame:
    """A3: whole-column numeric promotion (keep numeric only if every value parses)."""
    return CSV.cast_to(df, profile if profile is not None else numeric_profile(df))


def read_any(spark: SparkSession, path, fmt: str | None = None, promote: bool = True,
             multi_line: bool | None = None, dataset: Column | None = None) -> DataFrame:
    """Read a file or folder in its format, with ``dataset`` = file name (or an expression of the file's metadata).

    CSV files may differ in header; a column is numeric here if it is in every
    file that has it.  ``read_groups`` keeps the types of each file.

    JSON: of ``*.json`` files each is read by its own form (``json_forms``): an array
    of records, as exported by the original tool, or one record per line; a
    folder as JSON lines (as Spark writes it).  ``multi_line`` overrides the choice; for
    CSV it enables quoted fields spanning lines (unsplittable files).
    """
    first = path[0] if isinstance(path, (list, tuple)) else path
    fmt = fmt or format_of(first)
    if fmt == "parquet":
        return _with_file_dataset(spark.read.parquet(*([path] if isinstance(path, str) else path)), dataset)
    if fmt == "json":
        paths = [path] if isinstance(path, str) else list(path)
        if multi_line is None and first.lower().endswith(".json"):
            parts = [_with_file_dataset(spark.read.option("multiLine", ml).json(list(own)), dataset)
                     for ml, own in sorted(json_forms(spark, paths).items())]
            return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return _with_file_dataset(spark.read.option("multiLine", bool(multi_line)).json(paths), dataset)
    if fmt == "excel":
        raise ValueError("excel is not supported by the Spark readers; convert the file to csv or parquet")
    files = CSV.header_index(spark, path, dataset=dataset)
    rows = CSV.string_rows(spark, files, dataset, bool(multi_line))
    return CSV.cast_to(rows, CSV.united_types(CSV.signatures(spark, files, dataset, bool(multi_line)))) if promote else rows


def read_ordered(spark: SparkSession, path, fmt: str | None = None, dataset: Column | None = None) -> DataFrame:
    """K5: the rows under ``path`` (CSV as text) with ``read_order``, their place in the input."""
    first = path[0] if isinstance(path, (list, tuple)) else path
    kind = fmt or format_of(first)
    if kind == "csv":
        return CSV.string_rows(spark, CSV.header_index(spark, path, dataset=dataset), dataset, ordered=True)
    ds = (CSV.file_name() if dataset is None else dataset).alias(DATASET)
    return spark.read.format(kind).load(path).select("*", ds, CSV.read_order().alias(CSV.READ_ORDER))


def read_groups(spark: SparkSession, path, fmt: str | None = None, multi_line: bool | None = None,
                dataset: Column | None = None) -> list[DataFrame]:
    """A1-A6 with each file's own columns: one DataFrame per distinct schema.

    CSV files keep their own types too; JSON files are told apart by the columns their dataset has
    values in (a column that is null throughout a dataset is not there); Parquet is read with the schema it carries.
    """
    first = path[0] if isinstance(path, (list, tuple)) else path
    kind = fmt or format_of(first)
    if kind == "csv":
        return CSV.read_groups(spark, path, dataset, bool(multi_line))
    if kind == "json":
        return _json_groups(spark, path, multi_line, dataset)
    return [read_any(spark, path, fmt, multi_line=multi_line, dataset=dataset)]


def json_forms(spark: SparkSession, paths, dataset: Column | None = None) -> dict[bool, dict[str, str]]:
    """Of JSON files, path -> dataset by form: True if the text is one document (an array, or a record over several
    lines), False if it is a record per line."""
    lines = (spark.read.text(paths).where((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""))
             .select(F.col("_metadata.file_path").alias("path"), (CSV.file_name() if dataset is None else dataset).alias(DATASET),
                     "value", F.monotonically_increasing_id().alias("at")))
    first = lines.groupBy("path").agg(F.first(DATASET).alias(DATASET), F.trim(F.min_by("value", "at")).alias("v"))
    whole = F.col("v").startswith("[") | F.col("v").isin("{")
    by: dict[bool, dict[str, str]] = {}
    for r in first.select("path", DATASET, whole.alias("whole")).orderBy("path").collect():      # one row per file, as the listing has
        by.setdefault(r["whole"], {})[CSV.plain_path(r["path"])] = r[DATASET]
    return by


def _json_groups(spark: SparkSession, paths, multi_line: bool | None, dataset: Column | None) -> list[DataFrame]:
    """JSON files by form and by the columns their dataset has values in."""
    out = []
    for form, files in sorted(json_forms(spark, paths, dataset).items()):
        ml = form if multi_line is None else multi_line

        def read(own, ml=ml):
            return _with_file_dataset(spark.read.option("multiLine", ml).json(own), dataset)

        rows = read(list(files))
        columns = [c for c in rows.columns if c != DATASET]
        had = rows.groupBy(DATASET).agg(F.lit(0).alias("_"), *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)])
        by = {}
        for r in had.collect():                                               # one row per dataset
            by[r[DATASET]] = tuple(c for i, c in enumerate(columns) if r[f"n{i}"])
        groups = {}
        for path, ds in files.items():
            if ds in by:
                groups.setdefault(by[ds], []).append(path)
        out += [read(own).select(*[col(c) for c in names], DATASET) for names, own in groups.items()]
    return out


def write_any(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite",
              partition_by: list[str] | None = None) -> None:
    """Write csv (header) / parquet / json (one record per line)."""
    fmt = (fmt or "csv").lower()
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "json":
        w.json(path)
    elif fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"unsupported output format {fmt!r}")


def convert(spark: SparkSession, src: str, dst: str, out_fmt: str, in_fmt: str | None = None) -> DataFrame:
    """A10: read a stored dataset in any format and write it in another; returns the read frame."""
    df = read_any(spark, src, in_fmt)
    write_any(df.drop(DATASET), dst, out_fmt)
    return df


#: Bytes of cell text per silver file.
SILVER_FILE_BYTES = 128 << 20


def save_clean(df: DataFrame, silver: str, fmt: str = "parquet", mode: str = "append",
               file_bytes: int = SILVER_FILE_BYTES, sizes: DataFrame | None = None) -> None:
    """Silver (cleansed) data, partitioned by dataset, in files of about ``file_bytes``.

    The bytes of each dataset decide how many files it gets: a large dataset
    is dealt to as many tasks by a salt, a small one is written by one.  The number of files
    is bounded by size, not by tasks x datasets.  ``sizes`` may name a cheaper frame with the same
    datasets to take the bytes from.
    """
    src = df if sizes is None else sizes
    cells = [F.coalesce(F.octet_length(col(f.name).cast("string")), F.lit(0)) + 1 for f in src.schema.fields
             if f.name != DATASET and isinstance(f.dataType, (T.AtomicType, T.NullType))]
    each = reduce(lambda a, b: a + b, cells, F.lit(1)).cast("bigint")
    files = src.groupBy(DATASET).agg(F.ceil(F.sum(each) / file_bytes).cast("int").alias("_files"))
    dealt = (df.join(files.withColumnRenamed(DATASET, "_of"), F.col(DATASET).eqNullSafe(F.col("_of")), "left")
             .withColumn("_salt", F.floor(F.rand(7) * F.coalesce("_files", F.lit(1))).cast("int")).drop("_of", "_files"))
    out = dealt.repartition(DATASET, "_salt").drop("_salt")
    write_any(out, silver, fmt, mode=mode, partition_by=[DATASET])


def save_results(results: DataFrame, path: str) -> None:
    """One JSON document per scan, appended."""
    results.write.mode("append").json(path)


def results_index(spark: SparkSession, path: str) -> DataFrame:
    """The stored scan results, newest first, from file metadata alone (no result is read)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).load(path)
    return (files.select(F.col("modificationTime").alias("stored_at"), F.element_at(F.split("path", "/"), -1).alias("stored_file"),
                         F.col("length").alias("bytes"), "path")
            .where("bytes > 0").orderBy(F.desc("stored_at"), F.desc("stored_file")))


def load_result(spark: SparkSession, path: str) -> DataFrame:
    """The scan documents of one stored result (a ``path`` of ``results_index``)."""
    return spark.read.json(path)


def results_history(spark: SparkSession, path: str) -> DataFrame:
    """Stored scan documents, newest file first."""
    return (spark.read.json(path)
            .withColumn("stored_at", F.col("_metadata.file_modification_time"))
            .withColumn("stored_file", F.col("_metadata.file_name"))
            .orderBy(F.desc("stored_at"), F.desc("stored_file")))
