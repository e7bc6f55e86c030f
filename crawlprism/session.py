"""Session settings the operators rely on. Only runtime SQL settings: safe on a shared session."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    # Skewed join keys (one owner, visit or host with a third of the rows) are split at run time,
    # also where the split costs one more shuffle further down.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # The driver gathers a side that is broadcast and builds its hash table. Dictionaries and compression
    # let files hide seventy times their size and more, so files count up to this size only; what was
    # measured at run time, in rows, counts up to the next. Beyond them, a sort-merge join.
    "spark.sql.autoBroadcastJoinThreshold": str(128 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(16 * 1024 * 1024),
    # A task that writes a few partition values keeps a file open for each instead of sorting its rows.
    "spark.sql.maxConcurrentOutputFileWriters": "8",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_tuned: set[str] = set()


def tune(spark: SparkSession) -> SparkSession:
    """Give the session these settings where its owner set none; what was set stays."""
    app = spark.sparkContext.applicationId
    if app not in _tuned:
        chosen = {key for key, _ in spark.sparkContext.getConf().getAll()}
        if "spark.sql.autoBroadcastJoinThreshold" in chosen:  # an owner's bound holds at run time as well
            chosen.add("spark.sql.adaptive.autoBroadcastJoinThreshold")
        for key, value in RUNTIME_CONF.items():
            if key not in chosen:
                spark.conf.set(key, value)
        _tuned.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    A cluster names its shared folder in ``spark.checkpoint.dir``. Only where it is unset, a session
    whose tasks are threads of one process gets a temporary folder; the configuration is not changed.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_folder:
        _local_folder[app] = tempfile.mkdtemp(prefix="crawlprism-")
    return _local_folder[app]


def fits_broadcast(df: DataFrame) -> bool:
    """Whether a frame may be sent whole to every executor: its size as Spark measures it (files, or
    their share by the columns read), times five for what compression hides, is within the session's
    threshold. Beyond it, leave the join to Spark."""
    spark = df.sparkSession
    if not hasattr(df, "_jdf"):
        return False
    threshold = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    measured = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(measured)) * 5 <= threshold


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared folder and read back: for a small result that several branches
    of a plan need and that is dear to work out. Survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/written-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_local_folder: dict[str, str] = {}
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, as `--py-files` would, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    base = Path(tempfile.mkdtemp(prefix="crawlprism-pkg-")) / root.name
    archive = shutil.make_archive(str(base), "zip", root_dir=root.parent, base_dir=root.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
