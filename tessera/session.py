"""Session helpers: a local session for tests/bench, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


#: AES keys of 16, 24 and 32 bytes (base64 or hex) and tokens are hidden in plan strings.
REDACTED = "[A-Za-z0-9+/]{22}==|[A-Za-z0-9+/]{32,}={0,2}"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tessera") -> SparkSession:
    """Local session for tests and the bench (no UI, AQE on, UTC)."""
    return (SparkSession.builder.master(f"local[{cores}]").appName(app)
            .config("spark.ui.enabled", "false")
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", "16g")
            .config("spark.redaction.string.regex", REDACTED)
            .getOrCreate())


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names storage every executor can reach and is
    used as is (unset on a cluster is an error).  Only for a local master with
    the setting unset (tests, local runs) a folder under the system temp
    directory is created and recorded in the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder every executor can reach "
                             "(streaming checkpoints and staged tables are written there)")
        root = tempfile.mkdtemp(prefix="tessera-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
    try:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(root)
    except Exception:  # pragma: no cover - connect sessions have no context
        pass
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint root for one job's written tables."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def cluster_conf(total_input_bytes: int | None = None, target_partition_bytes: int = 256 << 20) -> dict:
    """Suggested settings for a large cluster (not applied automatically).

    Shuffle partitions are sized so each holds about ``target_partition_bytes``
    of the input (AQE coalesces small ones at runtime and splits skewed join
    partitions); file splits of 512 MB keep scan tasks in the minutes range;
    the scans here are CPU-bound regexes, so splits are not made larger.
    """
    parts = 2000 if not total_input_bytes else max(200, total_input_bytes // target_partition_bytes)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(512 << 20),
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.redaction.string.regex": REDACTED,
    }
