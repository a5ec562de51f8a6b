"""Columns derived from a path string."""

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def name_of(path: Column) -> Column:
    """Text after the last ``/``; the whole path when there is none."""
    return F.substring_index(path, "/", -1)


def extension_of(name: Column, is_dir: Column) -> Column:
    """Text after the last dot of a file name, case kept; empty for directories."""
    return F.when(is_dir | ~name.contains("."), F.lit("")).otherwise(
        F.substring_index(name, ".", -1)
    )


def parent_of(path: Column, name: Column) -> Column:
    """Path up to, and without, the slash before the name."""
    return F.when(~path.contains("/"), F.lit("")).otherwise(
        F.substring(path, F.lit(1), F.length(path) - F.length(name) - 1)
    )


def with_parts(entries: DataFrame) -> DataFrame:
    """Add ``name``, ``parent``, ``extension`` and ``name_lc`` where they are missing."""
    path, name = F.col("path"), name_of(F.col("path"))
    is_dir = F.col("is_dir") if "is_dir" in entries.columns else F.lit(False)
    parts = {
        "name": name,
        "parent": parent_of(path, name),
        "extension": extension_of(name, is_dir),
        "name_lc": F.lower(name),
    }
    return entries.withColumns({k: v for k, v in parts.items() if k not in entries.columns})


def level_of(path: Column) -> Column:
    """Number of path pieces, the empty one before a leading slash included."""
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) + 1


def prefix_at(path: Column, level: Column) -> Column:
    """The first ``level`` pieces of a path: its ancestor at that level."""
    return F.call_function("substring_index", path, F.lit("/"), level.cast("int"))


def without_slash(path: Column) -> Column:
    """A directory path without trailing slashes (the root becomes the empty text)."""
    return F.rtrim(path, F.lit("/"))


def at_or_under(path: Column, folder: str) -> Column:
    """Component-wise prefix test: ``/a/b`` covers itself and ``/a/b/c``, not ``/a/bc``."""
    folder = folder.rstrip("/")
    return (path == F.lit(folder)) | path.startswith(folder + "/")


def range_number(value: Column, starts: list[str]) -> Column:
    """How many of the sorted ``starts`` are not above the value.

    The starts are one constant array, so that rows meet a table of ranges without a join.
    """
    literal = F.from_json(F.lit(json.dumps(starts)), "array<string>")
    return count_begun(literal, len(starts), lambda start: start <= value)


def count_begun(starts: Column, count: int, begun: Callable[[Column], Column]) -> Column:
    """How many of an array's ``count`` sorted starts have ``begun`` at a row, by binary search."""
    widths = [1 << k for k in range(count.bit_length() - 1, -1, -1)]

    def step(below: Column, width: Column) -> Column:
        return F.when(begun(F.get(starts, below + width - 1)), below + width).otherwise(below)

    return F.aggregate(F.array(*map(F.lit, widths)), F.lit(0), step)
