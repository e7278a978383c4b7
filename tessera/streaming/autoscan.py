"""Automatic scan of arriving files (rows M1, M2, A6).

A Structured Streaming file source over the incoming folder; every
micro-batch runs the same batch plans (scan -> remediate -> results, findings,
silver, alerts, gold), keyed by ``dataset`` = the file the rows came from.  Each sink
writes into a ``batch_id=N`` partition with overwrite, so a replayed batch
(after a failure, from the checkpoint) replaces its own output instead of
appending twice.  The checkpoint lies under the output root, so a restarted
stream goes on counting batches and keeps what earlier runs wrote.  A file always lands whole
in one micro-batch; a dataset of many files may come in several, its score state
is merged (:mod:`.state`).

``autoscan`` takes the files of one format and schema; ``autoscan_folder`` takes files of any
supported format as they arrive.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import frame
from ..frame import DATASET
from ..operators import gold as J
from ..operators import remediate as R
from ..operators import score as I
from ..plans import pipeline as PL
from ..sources import io as A
from .state import BatchState, EarlierState

CONF_SENSITIVITY = "spark.tessera.autoscan.sensitivity"
CONF_OUTPUT_FORMAT = "spark.tessera.autoscan.outputFormat"
CONF_ENCRYPT = "spark.tessera.autoscan.encryptHighRisk"
CONF_ALERT_THRESHOLD = "spark.tessera.autoscan.alertThreshold"
FORMATS = ("csv", "parquet", "json")


def glob_of(fmt: str) -> str:
    """The files of one format, by extension in either case."""
    return "*." + "".join(f"[{c}{c.upper()}]" for c in fmt)


def run_options(spark: SparkSession, input_format: str, sensitivity=None, output_format=None, encrypt=None) -> dict:
    """M2: options from arguments, else session conf, else defaults (output = input format)."""
    conf = spark.conf
    return {
        "sensitivity": sensitivity or conf.get(CONF_SENSITIVITY, "medium"),
        "output_format": output_format or conf.get(CONF_OUTPUT_FORMAT, None) or input_format,
        "encrypt": encrypt if encrypt is not None else conf.get(CONF_ENCRYPT, "false").lower() == "true",
        "threshold": int(conf.get(CONF_ALERT_THRESHOLD, "70")),
    }


def process_batch(batch: DataFrame, batch_id: int, out_root: str, opts: dict, profile="function",
                  key: str | None = None, promote: bool = False, trigger: str = "blob_automatic",
                  input_format: str = "csv") -> None:
    """One micro-batch of one schema: scan, remediate and write every sink for this batch id."""
    raw = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        process_groups([(input_format, A.promote_numeric(raw) if promote else raw)], batch_id, out_root, opts, profile, key, trigger)
    finally:
        raw.unpersist()


def _united(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _together(spark: SparkSession, writes: list) -> list:
    """Results of parts of a batch that do not need each other, run at once: one is planned while another's tasks run."""
    inherits = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max_workers=4) as pool:
        return [f.result() for f in [pool.submit(inherits(w)) for w in writes]]


def process_groups(groups: list[tuple[str, DataFrame]], batch_id: int, out_root: str, opts: dict, profile="function",
                   key: str | None = None, trigger: str = "blob_automatic") -> None:
    """One micro-batch of (input format, frame) parts of any schemas: one scan each, one set of sinks for all.

    Scores, alerts and gold rows cover all batches a dataset came with (``BatchState``); findings and silver
    rows are those of this batch, silver without rows that an earlier batch held.
    """
    spark = groups[0][1].sparkSession
    root, part = out_root.rstrip("/"), f"batch_id={batch_id}"
    enc_key: Column | None = R.encryption_key(spark) if opts["encrypt"] else None
    held, silver = [], {}
    earlier = EarlierState(spark, f"{root}/_state", batch_id)

    def hold(df: DataFrame) -> DataFrame:
        held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return held[-1]

    def scan(i: int, fmt: str, df: DataFrame):
        # the surrogate row key is fixed once, on the persisted batch; few files are dealt to all cores
        batch, k = frame.with_row_key(df, key if key in df.columns else None)
        state = BatchState(f"{root}/_state", batch_id, i, earlier)
        batch = state.hold_digests(frame.spread(batch), k, hold)
        res = PL.run_scan(batch, profile, opts["sensitivity"], key=k, state=state)
        # the scores feed three sinks and the findings two: keep both for this batch
        res.findings, res.scores = hold(res.findings), hold(res.scores)
        output = opts["output_format"] or fmt
        doc = PL.scan_document(res, opts["sensitivity"], trigger=trigger, input_format=fmt,
                               output_format=output, encrypted=opts["encrypt"])
        clean = R.remediate(state.unseen(batch, k), profile, opts["sensitivity"], key=k, encrypt_key=enc_key)
        return res, doc, output, clean.drop(frame.ROW_KEY) if k == frame.ROW_KEY else clean, batch.drop(frame.ROW_KEY)

    try:
        scans = _together(spark, [partial(scan, i, fmt, df) for i, (fmt, df) in enumerate(groups)])
        results = [s[0] for s in scans]
        scores = _united([r.scores for r in results])
        found = _united([PL.stored_findings(r).withColumn("row_key", F.col("row_key").cast("string")) if len(results) > 1
                         else PL.stored_findings(r) for r in results])
        for _, _, output, clean, batch in scans:
            silver.setdefault(output, []).append((clean, batch))

        def write_silver(output: str, parts: list) -> None:
            path = f"{root}/silver/{part}" if len(silver) == 1 else f"{root}/silver/{part}/format={output}"
            A.save_clean(_united([c for c, _ in parts]), path, output, mode="overwrite", sizes=_united([b for _, b in parts]))

        _together(spark, [
            lambda: _united([s[1] for s in scans]).write.mode("overwrite").json(f"{root}/results/{part}"),              # A12
            lambda: found.write.mode("overwrite").parquet(f"{root}/findings/{part}"),                                   # D1, all
            *[partial(write_silver, output, parts) for output, parts in silver.items()],                                # A11
            lambda: I.alerts(scores, opts["threshold"]).write.mode("overwrite").parquet(f"{root}/alerts/{part}")])      # K4
        J.GoldTable(spark, f"{root}/gold").append(J.gold_rows(scores, trigger=trigger), batch_id)                       # A14
    finally:
        for df in held:
            df.unpersist()


def autoscan(spark: SparkSession, incoming: str, out_root: str, input_format: str = "csv", schema=None,
             profile="function", key: str | None = None, dataset: Column | None = None,
             sensitivity=None, output_format=None, encrypt=None, available_now: bool = True,
             processing_time: str | None = None, max_files_per_trigger: int | None = None,
             checkpoint: str | None = None, drop: list[str] | None = None, multi_line: bool = False):
    """M1: start the automatic scan stream; returns the ``StreamingQuery``.

    ``dataset`` defaults to the arriving file's name; ``drop`` removes columns
    (e.g. the partition column the dataset was taken from).  CSV is read all-string
    and promoted per micro-batch (A1-A3).  ``available_now`` processes what is
    there and stops; otherwise ``processing_time`` keeps polling.  Only files of
    ``input_format`` are taken; CSV files must have one header (``autoscan_folder`` takes any).
    """
    opts = run_options(spark, input_format, sensitivity, output_format, encrypt)
    if schema is None:
        schema = (A.read_csv_strings(spark, incoming, multi_line=multi_line, glob=glob_of(input_format)).drop(DATASET).schema
                  if input_format == "csv"
                  else spark.read.option("pathGlobFilter", glob_of(input_format)).format(input_format)
                  .load(incoming).schema)
    reader = spark.readStream.format(input_format).schema(schema).option("pathGlobFilter", glob_of(input_format))
    if input_format == "csv":
        reader = reader.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.load(incoming)
    ds = dataset if dataset is not None else F.col("_metadata.file_name")
    stream = stream.withColumn(DATASET, ds)
    if drop:
        stream = stream.drop(*drop)
    if input_format == "csv":
        stream = A.null_tokens(stream, [c for c in schema.fieldNames()])
    ckpt = checkpoint or f"{out_root.rstrip('/')}/_checkpoint"
    writer = (stream.writeStream.option("checkpointLocation", ckpt)
              .foreachBatch(lambda b, i: process_batch(b, i, out_root, opts, profile, key,
                                                       promote=input_format == "csv",
                                                       input_format=input_format)))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime=processing_time or "1 minute")
    return writer.start()


LISTING = "path string, modificationTime timestamp, length bigint, content binary"


def autoscan_folder(spark: SparkSession, incoming: str, out_root: str, profile="function", key: str | None = None,
                    dataset: Column | None = None, sensitivity=None, output_format=None, encrypt=None,
                    available_now: bool = True, processing_time: str | None = None,
                    max_files_per_trigger: int | None = None, checkpoint: str | None = None, multi_line: bool = False):
    """M1 + A6 over a folder of any formats, whenever they arrive: one stream and one set of sinks.

    The stream lists files (their contents are not read by it); within a batch the listed
    paths go to the reader of their extension, CSV files each by its own header
    and types.  ``dataset`` (default: the file's name) may be any expression of the file's
    metadata, e.g. its folder; a dataset may come in any number of batches.
    Returns the ``StreamingQuery``.
    """
    opts = run_options(spark, "", sensitivity, output_format, encrypt)
    glob = "*.{" + ",".join(x for f in FORMATS for x in (f, f.upper())) + "}"
    reader = spark.readStream.format("binaryFile").schema(LISTING).option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))

    def run(batch: DataFrame, batch_id: int) -> None:
        by = {}
        for r in batch.select("path").where("length > 0").orderBy("path").collect():        # the batch's file listing
            by.setdefault(A.format_of(r["path"]), []).append(A.CSV.plain_path(r["path"]))
        groups = [(fmt, g) for fmt, paths in by.items()
                  for g in A.read_groups(batch.sparkSession, paths, fmt, multi_line=multi_line or None, dataset=dataset)]
        if groups:
            process_groups(groups, batch_id, out_root, opts, profile, key)

    writer = (reader.load(incoming).select("path", "length").writeStream
              .option("checkpointLocation", checkpoint or f"{out_root.rstrip('/')}/_checkpoint").foreachBatch(run))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time or "1 minute")
    return writer.start()
