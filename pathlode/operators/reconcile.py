"""Comparing a saved catalogue with a fresh listing; both have one row per path."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlode.schema import ENTRY_FIELDS, META_FIELDS


def reconcile_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Every path of either side as added, removed, changed or same."""
    compared = ["is_dir", *META_FIELDS]
    left = old.select("path", F.struct(*compared).alias("before"))
    right = new.select("path", F.struct(*compared).alias("after"))
    status = (
        F.when(F.col("before").isNull(), "added")
        .when(F.col("after").isNull(), "removed")
        .when(F.col("before") == F.col("after"), "same")
        .otherwise("changed")
    )
    return left.join(right, "path", "full_outer").select(
        "path",
        status.alias("status"),
        F.col("before.size").alias("old_size"),
        F.col("after.size").alias("new_size"),
    )


def stale(old: DataFrame, new: DataFrame) -> DataFrame:
    """Saved entries that the listing no longer has."""
    return old.join(new.select("path"), "path", "left_anti").select(*old.columns)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Saved entries with the listed ones put over them; nothing is removed."""
    left = old.select("path", F.struct(*ENTRY_FIELDS).alias("before"))
    right = new.select("path", F.struct(*ENTRY_FIELDS).alias("after"))
    both = left.join(right, "path", "full_outer")
    return both.select(F.coalesce("after", "before").alias("e")).select("e.*")
