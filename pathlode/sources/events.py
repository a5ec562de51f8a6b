"""Change events from files, as a batch or as a stream."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlode.operators.changes import as_changes
from pathlode.schema import CHANGE


def read_changes(
    spark: SparkSession, location: str, format: str = "parquet", **options: str
) -> DataFrame:
    return as_changes(spark.read.format(format).schema(CHANGE).options(**options).load(location))


def stream_changes(
    spark: SparkSession, location: str, format: str = "parquet", **options: str
) -> DataFrame:
    """New files in a folder as a stream of events."""
    reader = spark.readStream.format(format).schema(CHANGE).options(**options)
    return as_changes(reader.load(location))


def changes_from_json(rows: DataFrame, column: str = "value") -> DataFrame:
    """Events from JSON texts, as message queues deliver them.

    A text that cannot be read is an event of nulls: folding puts it aside and
    counts it, as it may stand for any change.
    """
    event = F.from_json(F.col(column).cast("string"), CHANGE).alias("event")
    return rows.select(event).select("event.*")
