"""Saved catalogues: immutable versions, and a log table that says which one holds.

A version becomes visible by one appended log row, after its files are complete;
readers of an older version are never disturbed. Entries lie in one folder per run of
a writer and bucket, a range of paths (or of the clustering column); a version names
its buckets with the run that wrote each. A full save writes all of them, a compaction
only those that changed, and the others keep their files. Beside the entries a version
keeps the state of paths that are not alive, for events that arrive later.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathlode.functions.paths import range_number, with_parts
from pathlode.schema import ENTRY, ORDERS, STORED
from pathlode.session import folder_bytes, remove_folder

LOG = (
    "version bigint, folder string, entries bigint, bytes bigint, "
    "through_batch bigint, reason string, millis bigint, saved timestamp, floor_seq bigint, "
    "known_seq bigint, through_seq bigint, moved_seq bigint, base bigint, pruned_seq bigint, "
    "events bigint, overflows bigint, last_ts timestamp, "
    "buckets array<struct<bucket: int, run: string, first: string, entries: bigint, past: bigint>>"
)

_PAST = T.StructType([T.StructField(f.name, f.dataType) for f in [*ENTRY.fields, *ORDERS.fields]])
# Where a row is stored; partition columns of the files.
PLACE = T.StructType([T.StructField("run", T.StringType()), T.StructField("bucket", T.IntegerType())])


@dataclass(frozen=True)
class SaveStats:
    """The version, its entries, and the bytes that were written for it."""

    version: int
    entries: int
    bytes: int


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """The log of saved versions."""
    return spark.read.schema(LOG).parquet(f"{folder}/versions")


def latest_version(spark: SparkSession, folder: str) -> Row | None:
    try:
        return versions(spark, folder).orderBy(F.col("version").desc()).first()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def version_row(spark: SparkSession, folder: str, version: int) -> Row | None:
    return versions(spark, folder).filter(F.col("version") == version).first()


def log_of(folder: str, version: int) -> str:
    """Every version has its own log of events, so a reader lists only what came after it."""
    return f"{folder}/log/version={version}"


def save_catalogue(
    entries: DataFrame,
    folder: str,
    through_batch: int = -1,
    reason: str = "save",
    cluster_by: str = "path",
    partitions: int | None = None,
    past: DataFrame | None = None,
    carry: DataFrame | None = None,
    **known,
) -> SaveStats:
    """Write a new version with its derived columns, in ranges of ``cluster_by``.

    A folder has one writer at a time, and any number of readers. A path that
    occurs twice is an error.

    Parquet statistics then prune lookups and subtree searches by path (or, in a
    copy clustered by ``name_lc`` or ``extension``, searches by prefix or by
    extension).  The path is part of the range key, so an extension that holds
    a large part of all files is spread over many of them.  ``partitions`` sets
    the number of ranges where ``spark.sql.shuffle.partitions`` is too few for
    the data (a range is one task and one file; aim at some hundred megabytes).

    Entries may hold the columns of ``ORDERS``; ``past`` is the state of paths that are
    not alive, ``carry`` the events that the new version's log starts with, and
    ``known`` what else the log row says of the version.
    """
    started = time.monotonic()
    spark = entries.sparkSession
    last = latest_version(spark, folder)
    version = last["version"] + 1 if last else 0
    run = new_run()
    keys = list(dict.fromkeys([cluster_by, "path"]))
    stored = with_parts(entries)
    orders = [c for c in ORDERS.fieldNames() if c in stored.columns]
    stored = stored.select(*STORED.fieldNames(), *orders)
    ranges = [partitions, *keys] if partitions else keys
    ranged = stored.repartitionByRange(*ranges).withColumn("bucket", F.spark_partition_id())
    seen = Observation()
    if cluster_by == "path":
        # Equal paths are neighbours in their range, so they are counted while they are written.
        same = Window.partitionBy("bucket", "path").orderBy("path")
        ranged = ranged.withColumn("_nth", F.row_number().over(same)).observe(
            seen, F.count_if(F.col("_nth") > 1).alias("repeats")
        )
        ranged = ranged.drop("_nth")
    data = f"{folder}/data/run={run}"
    ranged.sortWithinPartitions("bucket", *keys).write.partitionBy("bucket").parquet(data)
    repeats = seen.get["repeats"] if cluster_by == "path" else _repeats(spark, data)
    if repeats:
        raise ValueError(f"{repeats} entries repeat the path of another one")
    buckets = _written_buckets(spark, data)
    if cluster_by != "path":
        buckets = [b | {"first": None} for b in buckets]
    if past is not None:
        buckets = _with_past(past, buckets, folder, run, cluster_by == "path")
    if carry is not None:
        carry.write.mode("overwrite").parquet(f"{log_of(folder, version)}/batch={through_batch}")
    row = {"reason": reason, "buckets": [b | {"run": run} for b in buckets], "base": version}
    size = folder_bytes(spark, data) + folder_bytes(spark, f"{folder}/past/run={run}")
    return _publish(spark, folder, version, through_batch, started, size, row | known)


def new_run() -> str:
    return f"r{uuid.uuid4().hex}"


def _repeats(spark: SparkSession, data: str) -> int:
    paths = spark.read.schema(STORED).parquet(data).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("paths")
    )
    return paths.select(F.col("n") - F.col("paths")).first()[0]


def _written_buckets(spark: SparkSession, data: str) -> list[dict]:
    """A row per bucket of a run, in the order of their first paths."""
    schema = T.StructType([STORED["path"], T.StructField("bucket", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(data).groupBy("bucket")
    found = rows.agg(F.min("path").alias("first"), F.count(F.lit(1)).alias("entries")).collect()
    return [r.asDict() | {"past": 0} for r in sorted(found, key=lambda r: r["first"])]


def place_of(path: Column, buckets: list) -> Column:
    """The place, in the order of paths, of the bucket whose range holds a path.

    The first one also has all paths before it.
    """
    starts = sorted(b["first"] for b in buckets)
    return F.greatest(range_number(path, starts) - 1, F.lit(0))


def bucket_of(path: Column, buckets: list) -> Column:
    """The bucket whose range of paths holds a path."""
    ordered = sorted(buckets, key=lambda b: b["first"])
    numbers = F.expr(f"array({', '.join(str(b['bucket']) for b in ordered)})")
    return F.get(numbers, place_of(path, buckets))


def _as_past(state: DataFrame) -> DataFrame:
    """The state of paths that are not alive: no event can bring back what a delete has ended.

    What was reported for them stays, as a late create may make them known.
    """
    return state.withColumn("create_ord", F.lit(None).cast("bigint")).select(*_PAST.fieldNames())


def _with_past(past: DataFrame, buckets: list[dict], folder: str, run: str, ranged: bool) -> list[dict]:
    """Write the state of paths that are not alive beside the buckets of their ranges."""
    buckets = buckets or [{"bucket": 0, "first": "", "entries": 0, "past": 0}]
    number = bucket_of(F.col("path"), buckets) if ranged else F.lit(buckets[0]["bucket"])
    counts = _write_by_bucket(_as_past(past), number, f"{folder}/past/run={run}")
    return [b | {"past": counts.get(b["bucket"], 0)} for b in buckets]


def _write_by_bucket(rows: DataFrame, number: Column, place: str, tasks: int | None = None) -> dict[int, int]:
    """Rows per bucket, written in order, one task per bucket."""
    dealt = rows.withColumn("bucket", number)
    dealt = dealt.repartition(tasks, "bucket") if tasks else dealt.repartition("bucket")
    dealt.sortWithinPartitions("bucket", "path").write.partitionBy("bucket").parquet(place)
    spark = rows.sparkSession
    found = spark.read.schema("path string, bucket int").parquet(place).groupBy("bucket").count()
    return {r["bucket"]: r["count"] for r in found.collect()}


def save_buckets(
    state: DataFrame, folder: str, last: Row, touched: Iterable[int], through_batch: int, reason: str, **known
) -> SaveStats:
    """Write a new version in which only the ``touched`` buckets have new files.

    ``state`` has all paths of these buckets, with ``alive``; its rows go to the bucket of their
    range, and the ranges stay.
    """
    started, spark, run, touched = time.monotonic(), state.sparkSession, new_run(), set(touched)
    number = bucket_of(F.col("path"), last["buckets"])
    orders = ORDERS.fieldNames()
    tasks = max(len(touched), 1)
    data, past = f"{folder}/data/run={run}", f"{folder}/past/run={run}"
    alive = with_parts(state.filter("alive")).select(*STORED.fieldNames(), *orders)
    entries = _write_by_bucket(alive, number, data, tasks)
    others = _write_by_bucket(_as_past(state.filter("NOT alive")), number, past, tasks)
    buckets = []
    for b in last["buckets"]:
        k = b["bucket"]
        new = {"run": run, "entries": entries.get(k, 0), "past": others.get(k, 0)} if k in touched else {}
        buckets.append(b.asDict() | new)
    size = folder_bytes(spark, data) + folder_bytes(spark, past)
    row = {"reason": reason, "buckets": buckets}
    return _publish(spark, folder, last["version"] + 1, through_batch, started, size, row | known)


def _publish(
    spark: SparkSession, folder: str, version: int, through_batch: int, started: float, size: int, row: dict
) -> SaveStats:
    """Append the log row that makes a version visible."""
    schema = T.StructType.fromDDL(LOG)
    entries = sum(b["entries"] for b in row["buckets"])
    values = {"events": 0, "overflows": 0} | row | {
        "version": version,
        "folder": folder,
        "entries": entries,
        "bytes": size,
        "through_batch": through_batch,
        "millis": round(1000 * (time.monotonic() - started)),
    }
    line = spark.createDataFrame([tuple(values.get(f.name) for f in schema.fields)], schema)
    line = line.withColumn("saved", F.current_timestamp()).coalesce(1)
    line.write.mode("append").parquet(f"{folder}/versions")
    return SaveStats(version, entries, size)


def _stored_rows(
    spark: SparkSession, row: Row, kind: str, schema: T.StructType, buckets: Iterable[int] | None = None
) -> DataFrame:
    """The stored rows of a version (or of some of its buckets) with their ``run`` and ``bucket``."""
    count, wanted = ("entries" if kind == "data" else "past"), None if buckets is None else set(buckets)
    runs: dict[str, list[int]] = {}
    for b in row["buckets"]:
        if b[count] and (wanted is None or b["bucket"] in wanted):
            runs.setdefault(b["run"], []).append(b["bucket"])
    whole = T.StructType([*schema.fields, *PLACE.fields])
    if not runs:
        return spark.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType) for f in whole]))
    place = f"{row['folder']}/{kind}"
    files = spark.read.schema(whole).option("basePath", place)
    found = files.parquet(*[f"{place}/run={run}" for run in runs])
    if len(runs) == 1 and wanted is None:
        return found
    held = F.lit(False)
    for run, numbers in runs.items():
        held |= (F.col("run") == run) & F.col("bucket").isin(numbers)
    return found.filter(held)


def read_version(spark: SparkSession, row: Row) -> DataFrame:
    """The entries of a version, with the ``version``, and the ``run`` and ``bucket`` they are stored in."""
    return _stored_rows(spark, row, "data", STORED).withColumn("version", F.lit(row["version"]))


def read_state(
    spark: SparkSession, row: Row, buckets: Iterable[int] | None = None, flagged: bool = False
) -> DataFrame:
    """Entries and past paths of a version with the orders of their parts, ``run`` and ``bucket``.

    ``flagged`` tells which are ``alive``.
    """
    columns = [*_PAST.fieldNames(), *PLACE.fieldNames()]
    alive = _stored_rows(spark, row, "data", T.StructType([*ENTRY.fields, *ORDERS.fields]), buckets)
    # Versions that were saved without orders come before all events.
    first = {c: F.coalesce(c, F.lit(-1)) for c in ORDERS.fieldNames() if c != "delete_ord"}
    alive = alive.withColumns(first).select(*columns)
    if flagged:
        alive = alive.withColumn("alive", F.lit(True))
    if not any(b["past"] for b in row["buckets"]):
        return alive
    past = _stored_rows(spark, row, "past", _PAST, buckets).select(*columns)
    return alive.unionByName(past.withColumn("alive", F.lit(False)) if flagged else past)


def load_catalogue(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The latest (or a given) version; a folder without one is an error."""
    row = latest_version(spark, folder) if version is None else version_row(spark, folder, version)
    if row is None:
        raise FileNotFoundError(f"no saved catalogue in {folder}")
    return read_version(spark, row)


def forget_versions(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Remove the runs that none of the newest ``keep`` versions name, and give their names.

    Nobody may still read a version that is older; the log of versions itself stays.
    """
    rows = versions(spark, folder).orderBy(F.col("version").desc()).select("version", "base", "buckets").collect()
    bases = {r["base"] for r in rows[:keep]}
    named = {b["run"] for r in rows if r in rows[:keep] or r["version"] in bases for b in r["buckets"]}
    gone = sorted({b["run"] for r in rows for b in r["buckets"]} - named)
    for run in gone:
        for kind in ("data", "past", "grams"):
            remove_folder(spark, f"{folder}/{kind}/run={run}")
    return gone
