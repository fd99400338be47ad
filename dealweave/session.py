"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Codec of tables that a run writes for itself: texts of documents take less than half of what they take with snappy.
CODEC = "zstd"
SHUFFLES_REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "8", memory: str = "20g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("dealweave")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """New folder for one run's tables below the cluster's ``spark.checkpoint.dir``.

    Executors come and go, so everything that has to outlive a stage is written here. A session without the setting
    is refused; ``local_session`` sets one for tests and laptops.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return f"{root.rstrip('/')}/dealweave-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Each query in here removes its shuffle files when it ends, instead of when the driver's garbage is collected."""
    held = spark.conf.get(SHUFFLES_REMOVED, None)
    spark.conf.set(SHUFFLES_REMOVED, "true")
    try:
        yield
    finally:
        if held is None:
            spark.conf.unset(SHUFFLES_REMOVED)
        else:
            spark.conf.set(SHUFFLES_REMOVED, held)


def materialised(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The same rows read back from a written table: a cut in the lineage that survives lost executors.

    What was shuffled to make it is removed once it is written.
    """
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path, compression=CODEC)
    return spark.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, folder: str) -> bool:
    """Delete a run's folder on whatever file system it is, once its results are no longer read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Existing paths that match a glob pattern, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or ())
