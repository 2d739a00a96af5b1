"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every query relies on (UTC, adaptive execution)."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("eventlake")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # no call-site capture per column expression; it takes much of the time of building a wide plan
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


_local_shared: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a plain local session without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_shared:
        folder = tempfile.mkdtemp(prefix="eventlake-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local_shared[context.applicationId] = folder
    return _local_shared[context.applicationId]


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark)}/eventlake/{purpose}-{uuid.uuid4().hex}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pinned(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read back: computed once, lineage cut, size known.

    The shuffles that led to it are deleted once it is written, as nothing reads them again."""
    spark = df.sparkSession
    folder, before = scratch_dir(spark, "pinned"), spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(folder)
    out.pinned_folder = folder
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of pinned frames that nothing reads any more; other frames have none."""
    for frame in frames:
        if getattr(frame, "pinned_folder", None) is None:
            continue
        jvm = frame.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(frame.pinned_folder)
        path.getFileSystem(frame.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
