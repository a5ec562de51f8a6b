"""What the operators share: input tables, stored intermediate tables, row numbers."""

import os
from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StringType

from pathlode.session import new_folder

# Words and blanks of the contracts: the six ASCII blanks only.
WORD = r"[^\x20\x09-\x0D]+"


# Rows and bytes of one Arrow batch: texts are long, so Spark's defaults would hold tens of megabytes.
BATCH_ROWS, BATCH_BYTES = 1000, 4 * 1024 * 1024


def prepare(spark: SparkSession) -> None:
    """Ready the session for Python workers.

    Workers that see this folder can import the package, wherever they start; elsewhere
    install it on the executors, or pass it as ``--py-files``. Arrow batches get
    ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` at most, for the whole session.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    Cuts the lineage so that lost executors cost no more than their own tasks,
    and fixes row numbers that depend on the partitioning.
    """
    folder = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def partition_of(row_id: Column) -> Column:
    """The partition in a number of ``monotonically_increasing_id``."""
    return F.shiftright(row_id, 33)


def key_kind(kind: DataType) -> DataType:
    """The type in which a key passes through pandas: whole numbers go as text.

    A column of whole numbers with a null would become floating point there.
    """
    return StringType() if isinstance(kind, IntegralType) else kind


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file lies; executors have it at the same place."""
    return public_tokenizers.path(name)
