"""Score state of datasets that arrive over several micro-batches (row M1).

A batch leaves, per dataset, what a score is made of in a form that merges:

* ``sums``: row, check and risk counts, and how many of its rows (and of their normal forms) no earlier batch held;
* ``rows``: one digest per different row, against which later batches are compared (by merge joins: there are as many as
  rows, and a broadcast would send them through the driver);
* ``unique``: counts per value of the columns under a unique rule.

Each is written under ``batch_id=N/part=K`` with overwrite, and a batch is merged only with
batches of smaller number, so a replayed batch replaces its own part and gives the
same result.  Only datasets that are in the batch are merged.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import DATASET
from ..operators import duplicates as G
from ..operators.quality import Check

DIGEST = "_exact"
RISKS = ["pii_high", "pii_medium", "pii_low"]


def check_id(ch: Check) -> str:
    """Names a check the same way in every batch, whatever its place in the suite."""
    what = repr((ch.kind, ch.column, ch.name, ch.pattern, ch.search, ch.min, ch.max, ch.mostly, ch.strict_key))
    return hashlib.md5(what.encode()).hexdigest()[:16]


class EarlierState:
    """What batches before ``batch_id`` left under ``root``: listed once, before any part of this batch is written."""

    NAMES = {"rows": f"{DATASET} string, exact binary, near binary, n bigint",
             "sums": f"{DATASET} string",
             "unique": f"{DATASET} string, column string, key binary, n bigint"}

    def __init__(self, spark: SparkSession, root: str, batch_id: int):
        self.root, self.batch_id = root.rstrip("/"), int(batch_id)
        self.frames = {name: self._read(spark, name, empty) for name, empty in self.NAMES.items()}

    def _read(self, spark: SparkSession, name: str, empty: str) -> DataFrame:
        try:
            rows = spark.read.option("mergeSchema", True).parquet(f"{self.root}/{name}")
        except AnalysisException as none:
            if none.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return spark.createDataFrame([], empty)
        return rows.where(F.col("batch_id") < self.batch_id).drop("batch_id", "part")


class BatchState:
    """The state under ``root`` as batch ``batch_id`` sees it; ``part`` keeps frames of one batch apart.

    Parts of one batch may be merged at the same time if they are given the same ``earlier``.
    """

    def __init__(self, root: str, batch_id: int, part: int = 0, earlier: EarlierState | None = None):
        self.root, self.batch_id, self.part = root.rstrip("/"), int(batch_id), part
        self.earlier = earlier
        self.digested: DataFrame | None = None

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch_id={self.batch_id}/part={self.part}")
        return df.sparkSession.read.parquet(f"{self.root}/{name}/batch_id={self.batch_id}/part={self.part}")

    def _read(self, spark, name: str, datasets: DataFrame | None = None) -> DataFrame:
        """Rows of earlier batches (of ``datasets``)."""
        if self.earlier is None:
            self.earlier = EarlierState(spark, self.root, self.batch_id)
        rows = self.earlier.frames[name]
        return rows if datasets is None else rows.join(datasets, DATASET, "left_semi")

    def merge(self, df: DataFrame, key: str | None, base: DataFrame, risk: DataFrame, uniques: DataFrame | None,
              checks: list[Check], near: bool) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame]:
        """(base, risk, uniques, duplicates) of the datasets in ``df`` over this and all earlier batches."""
        spark = df.sparkSession
        names = {f"{k}{i}": f"{k}_{check_id(ch)}" for i, ch in enumerate(checks) for k in ("nn", "u")}
        kept = {c: names.get(c, c) for c in base.columns if c != DATASET}
        rows = self._write(G.row_states(self._digested(df, key), key, near, DIGEST), "rows")
        datasets = rows.select(DATASET).distinct()
        earlier = self._read(spark, "rows", datasets)

        def fresh(column: str, alias: str) -> DataFrame:
            now = rows.select(DATASET, column).where(F.col(column).isNotNull())
            now = now if column == "exact" else now.distinct()                  # of "exact" each is there once
            new = now.join(earlier.select(DATASET, column).hint("merge"), [DATASET, column], "left_anti")
            return new.groupBy(DATASET).agg(F.count(F.lit(1)).alias(alias))

        sums = base.select(DATASET, *[F.col(c).alias(n) for c, n in kept.items()]).join(risk.select(DATASET, *RISKS), DATASET, "left")
        sums = sums.join(fresh("exact", "new_rows"), DATASET, "left")
        sums = (sums.join(fresh("near", "new_near"), DATASET, "left") if near
                else sums.withColumn("new_near", F.lit(None).cast("bigint")))
        sums = self._write(sums, "sums")
        whole = sums.unionByName(self._read(spark, "sums", datasets), allowMissingColumns=True)
        total = whole.groupBy(DATASET).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums.columns if c != DATASET])
        base = total.select(DATASET, *[F.col(n).alias(c) for c, n in kept.items()])
        repeated = total.select(DATASET, F.col("n_total").alias("total_rows"), (F.col("n_total") - F.col("new_rows")).alias("exact_duplicates"),
                                F.when(F.col("new_near") > 0, F.col("n_total") - F.col("new_near")).otherwise(0).alias("near_duplicates"))
        if uniques is not None:
            columns = {i: ch.column for i, ch in enumerate(checks)}
            named = F.create_map(*[x for i, c in columns.items() for x in (F.lit(i), F.lit(c))])
            now = self._write(uniques.select(DATASET, named[F.col("rule")].alias("column"), "key", "n"), "unique")
            seen = now.unionByName(self._read(spark, "unique", datasets))
            first = {}
            for i, ch in enumerate(checks):
                if ch.kind == "unique":
                    first.setdefault(ch.column, i)
            place = F.create_map(*[x for c, i in first.items() for x in (F.lit(c), F.lit(i))])
            uniques = (seen.groupBy(DATASET, "column", "key").agg(F.sum("n").alias("n"))
                       .select(DATASET, place[F.col("column")].alias("rule"), "key", "n").where("rule IS NOT NULL"))
        return base, total.select(DATASET, *RISKS), uniques, G.finish(repeated)

    def unseen(self, df: DataFrame, key: str | None) -> DataFrame:
        """The rows of ``df`` that no earlier batch held (call after ``merge``)."""
        earlier = self._read(df.sparkSession, "rows").select(DATASET, F.col("exact").alias(DIGEST)).hint("merge")
        return self._digested(df, key).join(earlier, [DATASET, DIGEST], "left_anti").select(*df.columns)

    def hold_digests(self, df: DataFrame, key: str | None, hold) -> DataFrame:
        """``df`` as ``hold`` keeps it (e.g. persisted), its digests beside it: they are computed once for all uses of this state."""
        self.digested = hold(df.withColumn(DIGEST, G.row_digest(df, key)))
        return self.digested.drop(DIGEST)

    def _digested(self, df: DataFrame, key: str | None) -> DataFrame:
        return self.digested if self.digested is not None else df.withColumn(DIGEST, G.row_digest(df, key))
