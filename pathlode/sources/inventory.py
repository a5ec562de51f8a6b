"""Entries from inventories, file listings and other tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlode.functions.paths import without_slash
from pathlode.operators.hierarchy import derive_directories
from pathlode.schema import ENTRY, ENTRY_FIELDS, META_FIELDS


def as_entries(rows: DataFrame) -> DataFrame:
    """Any table with a ``path`` as entries: missing or null values become 0 or false.

    Times may be timestamps or epoch seconds.  Symbolic links and empty paths
    are dropped.
    """
    if "is_symlink" in rows.columns:
        rows = rows.filter(~F.coalesce("is_symlink", F.lit(False)))
    columns = []
    for field in ENTRY.fields[1:]:
        value = F.lit(0).cast(field.dataType)
        if field.name in rows.columns:
            value = F.coalesce(F.col(field.name).cast(field.dataType), value)
        columns.append(value.alias(field.name))
    return rows.filter(F.col("path") != "").select("path", *columns)


TEXT_FORMATS = ("csv", "json")
_RAW = "_corrupt_record"


def _fields(spark: SparkSession, format: str, skip_unreadable: bool, options: dict, raw: bool = False):
    """A reader of an inventory's files; text is read as text, to be judged value by value."""
    kind = "string" if format in TEXT_FORMATS else None
    schema = ", ".join(f"{f.name} {kind or f.dataType.simpleString()}" for f in ENTRY.fields)
    reader = spark.read.format(format).options(**options)
    if raw:
        schema += f", {_RAW} string"
        reader = reader.option("columnNameOfCorruptRecord", _RAW)
    skip = str(skip_unreadable).lower()
    return reader.schema(schema).option("ignoreMissingFiles", skip).option("ignoreCorruptFiles", skip)


def _typed() -> dict[str, Column]:
    return {f.name: F.col(f.name).try_cast(f.dataType) for f in ENTRY.fields}


def read_inventory(
    spark: SparkSession,
    locations: str | list[str],
    format: str = "parquet",
    skip_unreadable: bool = False,
    **options: str,
) -> DataFrame:
    """Inventory reports (Parquet, ORC, CSV, JSON) with the entry columns.

    Lines without a path or with a value of another type are left out; :func:`lost_lines`
    has them. Damaged and vanished files are an error, unless ``skip_unreadable``; then
    :func:`silent_files` has them. A listing that lacks some of either is not ``complete``
    for ``refresh``; ``refresh_from_inventory`` sees to that.
    """
    rows = _fields(spark, format, skip_unreadable, options).load(locations)
    if format in TEXT_FORMATS:
        # A line is judged by all its columns, also when a query asks for few of them.
        typed = _typed()
        fine = [F.col(c).isNull() | value.isNotNull() for c, value in typed.items()]
        rows = rows.filter(reduce(and_, fine)).withColumns(typed)
    return as_entries(rows)


def lost_lines(
    spark: SparkSession,
    locations: str | list[str],
    format: str = "csv",
    skip_unreadable: bool = False,
    **options: str,
) -> DataFrame:
    """What :func:`read_inventory` leaves out: ``file``, ``line``, ``faults``, in no order.

    ``faults`` names the columns whose values have another type, and ``path`` where there is
    none. ``line`` is the text where that is no JSON at all, else the values as JSON. In
    Parquet and ORC only rows without a path can be lost. Wanted: the options of the reading.
    """
    raw = format == "json"
    rows = _fields(spark, format, skip_unreadable, options, raw).load(locations)
    bad = {c: F.col(c).isNotNull() & value.isNull() for c, value in _typed().items()}
    bad["path"] = F.coalesce(F.col("path"), F.lit("")) == ""
    faults = F.filter(F.array(*[F.when(is_bad, c) for c, is_bad in bad.items()]), lambda c: c.isNotNull())
    line = F.to_json(F.struct(*ENTRY_FIELDS))
    found = rows.select(
        plain_file(F.col("_metadata.file_path")).alias("file"),
        (F.coalesce(F.col(_RAW), line) if raw else line).alias("line"),
        faults.alias("faults"),
    )
    return found.filter(F.size("faults") > 0)


def plain_file(path: Column) -> Column:
    return F.regexp_replace(path, r"^file:/+", "/")


def silent_files(
    spark: SparkSession, locations: str | list[str], format: str = "parquet", **options: str
) -> DataFrame:
    """Files of an inventory (``file``, ``size``) that gave no row: damaged ones, and empty ones."""
    listed = spark.read.format("binaryFile").load(locations)
    reader = spark.read.format(format).schema(ENTRY).options(**options)
    reader = reader.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
    # A column is read as well, or a damaged file could count by its footer alone.
    rows = reader.load(locations).select("_metadata.file_path", "path")
    heard = rows.groupBy("file_path").agg(F.count("path").alias("n"))
    return (
        listed.select(plain_file(F.col("path")).alias("file"), F.col("length").alias("size"))
        .join(heard.select(plain_file(F.col("file_path")).alias("file")), "file", "left_anti")
    )


def without_metadata(entries: DataFrame) -> DataFrame:
    """Entries taken without looking at the files: size and times are 0."""
    return entries.withColumns({c: F.lit(0).cast("bigint") for c in META_FIELDS})


def one_per_path(entries: DataFrame) -> DataFrame:
    """Overlapping listings give each path once (the most recently modified report)."""
    rest = [c for c in entries.columns if c != "path"]
    newest = F.max(F.struct("modified", *[c for c in rest if c != "modified"])).alias("e")
    return entries.groupBy("path").agg(newest).select(
        "path", *[F.col(f"e.{c}").alias(c) for c in rest]
    )


def union_roots(*listings: DataFrame) -> DataFrame:
    """Several roots in one catalogue."""
    selected = [as_entries(listing).select(*ENTRY_FIELDS) for listing in listings]
    return one_per_path(reduce(DataFrame.unionByName, selected))


def with_directories(files: DataFrame) -> DataFrame:
    """Add a directory entry for every directory above some entry that has none yet."""
    missing = derive_directories(files).join(files.select("path"), "path", "left_anti")
    directories = as_entries(missing.withColumn("is_dir", F.lit(True)))
    return files.select(*ENTRY_FIELDS).unionByName(directories)


def scan_files(
    spark: SparkSession, locations: str | list[str], glob: str | None = None
) -> DataFrame:
    """Files below the locations (a listing only; no content is read).

    For folders of a bounded number of files: the listing passes through the
    driver. Larger stores are listed by their inventories. Spark lists files, not
    directories, leaves out names starting with ``.`` or ``_`` (so a refresh from
    such a listing is not ``complete``), and knows size and modification time only.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("ignoreMissingFiles", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    listed = reader.load(locations).select(
        without_slash(plain_file(F.col("path"))).alias("path"),
        F.col("length").alias("size"),
        F.unix_timestamp("modificationTime").alias("modified"),
    )
    return as_entries(listed)
