"""Tables that tell how the catalogue and its change feed are doing."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlode.operators.changes import EVERYWHERE, Scope, as_changes, events_in_scope

LOG_ROWS = 50  # fixed value: the newest events kept in the log


def event_text() -> Column:
    """An event as text."""
    path = F.coalesce("path", F.lit(""))
    suffix = F.when(F.coalesce("is_dir", F.lit(False)), " (dir)").otherwise("")
    return (
        F.when(F.col("kind") == "create", F.concat(F.lit("create "), path, suffix))
        .when(
            F.col("kind") == "move",
            F.concat(F.lit("move "), path, F.lit(" -> "), F.coalesce("to_path", F.lit(""))),
        )
        .otherwise(F.concat(F.col("kind"), F.lit(" "), path))
    )


def change_log_tail(
    events: DataFrame, rows: int = LOG_ROWS, scope: Scope = EVERYWHERE
) -> DataFrame:
    """The newest events of the scope as text."""
    newest = events_in_scope(as_changes(events), scope).orderBy(F.col("seq").desc()).limit(rows)
    return newest.select("seq", event_text().alias("text"))


def status_row(
    entries: DataFrame, events: DataFrame, since_seq: int | None = None, watch_failures: int = 0
) -> DataFrame:
    """One row: entry count, overflows, health, and the last update.

    Healthy means no failed watch and no overflow in the last batch (the events
    after ``since_seq``).
    """
    events = as_changes(events)
    is_overflow = F.col("kind") == "overflow"
    recent = is_overflow if since_seq is None else is_overflow & (F.col("seq") > since_seq)
    feed = events.agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(is_overflow).alias("overflow_count"),
        ((F.count_if(recent) == 0) & F.lit(watch_failures == 0)).alias("healthy"),
        F.coalesce(F.unix_timestamp(F.max("ts")), F.lit(0)).alias("last_updated"),
    )
    count = entries.agg(F.count(F.lit(1)).alias("entry_count")).scalar()
    return feed.withColumn("entry_count", count).select(
        "entry_count",
        F.format_string("Indexed %d entries", "entry_count").alias("message"),
        "event_count",
        "overflow_count",
        F.lit(watch_failures).cast("bigint").alias("watch_failure_count"),
        "healthy",
        "last_updated",
    )


def changes_per_day(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events per UTC day and kind, for a batch or a stream."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day").alias("w"), "kind")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.to_date("w.start").alias("day"), "kind", "n")
    )
