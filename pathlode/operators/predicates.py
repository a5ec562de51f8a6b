"""Search criteria as one boolean column, cheap conditions first."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlode.functions.dates import day_bounds
from pathlode.functions.filetypes import FILE_TYPES
from pathlode.functions.paths import with_parts
from pathlode.functions.sizes import Bounds, size_bounds
from pathlode.operators.terms import TextOptions, all_terms, as_terms


def between(column: Column, bounds: Bounds) -> Column:
    """Closed range with optional ends."""
    low, high = bounds
    conditions = [column >= low] if low is not None else []
    conditions += [column <= high] if high is not None else []
    return reduce(and_, conditions, F.lit(True))


def has_extension(extensions: str | list[str]) -> Column:
    """Files with one of the extensions.

    The list is lowercased and the stored extension is not, so ``mkv`` does not
    find ``x.MKV``.  An empty list is no condition.
    """
    if isinstance(extensions, str):
        extensions = extensions.split(";")
    wanted = [e.strip().lower() for e in extensions]
    wanted = list(dict.fromkeys(e for e in wanted if e))
    return (~F.col("is_dir") & F.col("extension").isin(wanted)) if wanted else F.lit(True)


def criteria(
    *,
    terms=(),
    files: bool = False,
    folders: bool = False,
    ext: str | list[str] = (),
    file_type: str | None = None,
    path: str | None = None,
    size: str | Bounds | None = None,
    modified: str | Bounds | None = None,
    created: str | Bounds | None = None,
    accessed: str | Bounds | None = None,
    attrib: str = "",
    match_case: bool = False,
    match_path: bool | None = None,
    whole_word: bool = False,
    whole_filename: bool = False,
    now: int | None = None,
) -> Column:
    """All given criteria, over the columns of :func:`pathlode.functions.paths.with_parts`.

    ``path`` asks for a text anywhere in the full path and makes the terms read
    the full path too, unless ``match_path=False``.  Of the ``attrib`` letters
    only ``D`` (directory) has a meaning; ``H``, ``R`` and ``S`` are accepted.
    """
    if ext and file_type:
        raise ValueError("give ext or file_type, not both")
    conditions: list[Column] = []
    if files:
        conditions.append(~F.col("is_dir"))
    if folders or "D" in attrib.upper():
        conditions.append(F.col("is_dir"))
    if size is not None:
        bounds = size_bounds(size) if isinstance(size, str) else size
        conditions.append(between(F.col("size"), bounds))
    for column, day in (("modified", modified), ("created", created), ("accessed", accessed)):
        if day is not None:
            bounds = day_bounds(day, now) if isinstance(day, str) else day
            conditions.append(between(F.col(column), bounds))
    if file_type is not None:
        conditions.append(has_extension(FILE_TYPES[file_type]))
    elif ext:
        conditions.append(has_extension(ext))

    full_path = F.col("path") if match_case else F.lower(F.col("path"))
    if path:
        conditions.append(full_path.contains(path if match_case else path.lower()))
    if match_path if match_path is not None else bool(path):
        text = full_path
    else:
        text = F.col("name") if match_case else F.col("name_lc")
    options = TextOptions(match_case, whole_word, whole_filename)
    conditions.append(all_terms(as_terms(terms), text, options))
    return reduce(and_, conditions)


def matches(entries: DataFrame, **wanted) -> DataFrame:
    """The entries that meet all criteria."""
    return with_parts(entries).filter(criteria(**wanted))


def name_starts_with(entries: DataFrame, prefix: str) -> DataFrame:
    """Entries whose name starts with ``prefix``, in any case."""
    return with_parts(entries).filter(F.col("name_lc").startswith(prefix.lower()))


def lookup(entries: DataFrame, path: str) -> DataFrame:
    """The entry with exactly this path; in a stored catalogue a pruned read."""
    return entries.filter(F.col("path") == path)


