"""Session settings, and the shared folder for intermediate tables."""

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table may be broadcast when it is below both bounds (both are measured, never guessed).
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pathlode")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PATHLODE_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="pathlode-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


# Per thread the folder names given out while some ``removed_after`` of that thread is open.
_GIVEN = threading.local()


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder."""
    folder = f"{shared_folder(spark).rstrip('/')}/pathlode/{label}-{uuid.uuid4().hex}"
    for given in getattr(_GIVEN, "lists", ()):
        given.append(folder)
    return folder


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def removed_after(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables that this thread writes inside, once their readers are done.

    Tables of other threads are left alone, whenever they are written.
    """
    lists = _GIVEN.__dict__.setdefault("lists", [])
    given: list[str] = []
    lists.append(given)
    try:
        yield
    finally:
        lists[:] = [other for other in lists if other is not given]
        for folder in given:
            remove_folder(spark, folder)


def folder_bytes(spark: SparkSession, folder: str) -> int:
    """The bytes of all files below a folder; 0 where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(path).getLength() if files.exists(path) else 0


def folders_in(spark: SparkSession, place: str) -> list[str]:
    """The names of the folders right below ``place``; none where there is no such place."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.listStatus(path) if files.exists(path) else []
    return sorted(f.getPath().getName() for f in found if f.isDirectory())


def has_file(spark: SparkSession, place: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def is_folder(spark: SparkSession, place: str) -> bool:
    """Whether ``place`` is a folder, in any store that Spark reaches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(path) and files.getFileStatus(path).isDirectory()


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Cuts the lineage in a way that survives lost executors, fixes
    non-deterministic columns, and gives the planner the true table size.
    """
    spark = df.sparkSession
    folder = new_folder(spark, label)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def measure(df: DataFrame, *text_columns: str) -> tuple[int, int]:
    """Row count and approximate bytes (8 per column plus the text) of a written table."""
    text = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in text_columns), F.lit(0))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(text), F.lit(0)).alias("b")).first()
    return row["n"], row["b"] + 8 * len(df.columns) * row["n"]


def fits_broadcast(rows: int, size: int, max_rows: int = BROADCAST_ROWS) -> bool:
    return rows <= max_rows and size <= BROADCAST_BYTES
