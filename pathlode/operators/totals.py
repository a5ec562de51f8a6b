"""Aggregates over a set of entries."""

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pathlode.functions.paths import with_parts
from pathlode.session import written


def totals(entries: DataFrame) -> DataFrame:
    """One row: count and total size, directories included."""
    return entries.agg(
        F.count(F.lit(1)).alias("total_count"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
    )


def with_totals(page: DataFrame, matched: DataFrame) -> DataFrame:
    """The page with the totals of all matches on every row (a scalar subquery, no join)."""
    both = totals(matched).select(F.struct("total_count", "total_size").alias("t")).scalar()
    return (
        page.withColumn("_t", both)
        .withColumn("total_count", F.col("_t.total_count"))
        .withColumn("total_size", F.col("_t.total_size"))
        .drop("_t")
    )


def taken_with_totals(matched: DataFrame, take: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``take(matched)`` with the totals of ``matched``, counted while the page is taken.

    One scan and one job; the page, which ``take`` keeps small, is written. A plan that
    never meets the matches gets its totals by :func:`with_totals`.
    """
    seen = Observation()
    page = take(
        matched.observe(
            seen,
            F.count(F.lit(1)).alias("total_count"),
            F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
        )
    )
    if "CollectMetrics" not in page._jdf.queryExecution().optimizedPlan().toString():
        return with_totals(take(matched), matched)
    rows = written(page, "page")
    return rows.withColumns({k: F.lit(v).cast("bigint") for k, v in seen.get.items()})


def extension_counts(entries: DataFrame) -> DataFrame:
    """Files per extension, the empty extension included."""
    files = with_parts(entries).filter(~F.col("is_dir"))
    return files.groupBy("extension").agg(F.count(F.lit(1)).alias("n_files"))


def extension_postings(entries: DataFrame) -> DataFrame:
    """The (extension, path) pairs of all files: posting lists as rows."""
    return with_parts(entries).filter(~F.col("is_dir")).select("extension", "path")
