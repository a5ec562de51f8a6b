"""Sort orders, pages, and positions in a sorted result."""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlode.functions.paths import count_begun
from pathlode.session import fits_broadcast, measure, written

# Above this many rows a page is cut out by position: a top-n keeps n rows per task and
# merges them all in one, so give ``page`` a smaller bound where there are many tasks.
TOP_ROWS = 10_000

# Ranges into which a whole is cut to find a deep page; their first rows pass the driver.
PAGE_RANGES = 1024

# Accepted spellings of the sort keys.
SORT_KEYS = {
    "name": "name",
    "path": "path",
    "size": "size",
    "modified": "modified",
    "date-modified": "modified",
    "created": "created",
    "date-created": "created",
    "accessed": "accessed",
    "date-accessed": "accessed",
    "extension": "extension",
    "ext": "extension",
}

# Short command-line sort flags.
SHORT_SORTS = {
    "N": "name-asc",
    "-N": "name-desc",
    "S": "size-desc",
    "-S": "size-asc",
    "E": "extension-asc",
    "-E": "extension-desc",
    "D": "date-modified-desc",
    "-D": "date-modified-asc",
}


def sort_order(sort: str = "name") -> list[Column]:
    """Order columns of ``size``, ``size-asc``, ``size-desc`` ...; ties go by path."""
    spelled = sort.strip().lower()
    key = spelled.removesuffix("-desc").removesuffix("-asc")
    if key not in SORT_KEYS or spelled not in (key, f"{key}-asc", f"{key}-desc"):
        raise ValueError(f"unknown sort: {sort}")
    column = F.col(SORT_KEYS[key])
    first = column.desc() if spelled.endswith("-desc") else column.asc()
    return [first] if SORT_KEYS[key] == "path" else [first, F.col("path").asc()]


def flag_sort(flag: str, ascending: bool = False) -> str:
    """Sort of a command-line flag: a bare key sorts downwards unless ``ascending``."""
    if flag in SHORT_SORTS:
        return SHORT_SORTS[flag]
    if flag.lower().endswith(("-asc", "-desc")):
        return flag
    return f"{flag}-asc" if ascending else f"{flag}-desc"


def with_position(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Add the 1-based position of every row in the sorted whole.

    One range shuffle and no single-task step: rows are numbered within each
    sorted partition, the sorted rows are written once, and only one count per
    partition goes through the driver.
    """
    numbered = written(
        df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()), "sorted"
    )
    part = F.shiftright("_row", 33)
    row = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    counts = (
        numbered.groupBy(part.alias("part")).agg((F.max(row) + 1).alias("n")).orderBy("part")
    ).collect()
    starts = accumulate([0] + [c["n"] for c in counts])
    offsets = df.sparkSession.createDataFrame(
        [(c["part"], start) for c, start in zip(counts, starts)], "_part bigint, _start bigint"
    )
    return (
        numbered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_start") + row + 1)
        .drop("_part", "_start", "_row")
    )


@dataclass(frozen=True)
class Ranges:
    """A sorted whole cut into ranges: their first rows, how many rows each has, and their size."""

    starts: list[dict]  # key, path; the first range begins before all of them
    rows: list[int]
    sizes: list[int]

    @property
    def totals(self) -> dict[str, int]:
        return {"total_count": sum(self.rows), "total_size": sum(self.sizes)}

    def holding(self, offset: int, limit: int | None) -> tuple[range, int]:
        """The ranges that hold a page, and the rows before the first of them."""
        before = [0, *accumulate(self.rows)]
        if offset >= before[-1] or limit == 0:
            return range(0), 0
        last = len(self.rows) if limit is None else min(bisect_left(before, offset + limit), len(self.rows))
        first = bisect_right(before, offset) - 1
        return range(first, last), before[first]


def _key_of(sort: str) -> tuple[str, bool]:
    spelled = sort.strip().lower()
    return SORT_KEYS[spelled.removesuffix("-desc").removesuffix("-asc")], spelled.endswith("-desc")


def _range_of(df: DataFrame, sort: str, starts: list[dict]) -> Column:
    """The range of a row among sorted starts."""
    if not starts:
        return F.lit(0)
    key, downwards = _key_of(sort)
    kind = df.schema[key].dataType.simpleString()
    literal = F.from_json(F.lit(json.dumps(starts)), f"array<struct<key: {kind}, path: string>>")
    # Structs compare nulls too, and put them first, as the order does.
    mine, path = F.struct(key), F.col("path")

    def begun(start: Column) -> Column:
        theirs = F.struct(start["key"])
        if key == "path":
            return mine <= theirs if downwards else mine >= theirs
        beyond = mine < theirs if downwards else mine > theirs
        return beyond | ((mine == theirs) & (path >= start["path"]))

    return count_begun(literal, len(starts), begun)


def ranges_of(df: DataFrame, sort: str = "name", count: int = PAGE_RANGES) -> Ranges:
    """Cut the sorted whole into about ``count`` ranges. Two scans and no shuffle of rows.

    The starts are the keys of the rows with the smallest hashes of their paths, so they follow
    the distribution of keys, of which a hot one is cut by path.
    """
    key, downwards = _key_of(sort)
    keyed = df.select(F.col(key).alias("key"), "path")
    drawn = keyed.orderBy(F.xxhash64("path"), "path").limit(count - 1)
    drawn = drawn.orderBy(F.col("key").desc() if downwards else F.col("key"), "path")
    starts = [r.asDict() for r in drawn.collect()]
    size = F.coalesce(F.sum("size"), F.lit(0)) if "size" in df.columns else F.lit(0)
    found = df.groupBy(_range_of(df, sort, starts).alias("range")).agg(
        F.count(F.lit(1)).alias("n"), size.alias("size")
    )
    counted = {r["range"]: (r["n"], r["size"]) for r in found.collect()}  # a row per range
    both = [counted.get(k, (0, 0)) for k in range(len(starts) + 1)]
    return Ranges(starts, [n for n, _ in both], [s for _, s in both])


def page_of_ranges(
    df: DataFrame, sort: str, ranges: Ranges, offset: int, limit: int | None, top_rows: int = TOP_ROWS
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit``: only the ranges that hold them are read and sorted.

    A page near the start of its ranges is a top-n there; another one is cut out by position,
    for which the sort keys and paths of its ranges are written.
    """
    wanted, before = ranges.holding(offset, limit)
    if not wanted:
        return df.filter(F.lit(False))
    key, downwards = _key_of(sort)
    number = _range_of(df, sort, ranges.starts)
    held = df.filter((number >= wanted[0]) & (number <= wanted[-1]))
    # The same by the key alone, for the scan to prune by.
    lower = ranges.starts[wanted[0] - 1]["key"] if wanted[0] else None
    upper = ranges.starts[wanted[-1]]["key"] if wanted[-1] < len(ranges.starts) else None
    if downwards:
        lower, upper = upper, lower
    if lower is not None:
        held = held.filter(F.col(key) >= F.lit(lower))
    if upper is not None:
        held = held.filter((F.col(key) <= F.lit(upper)) | F.col(key).isNull())
    order, skipped = sort_order(sort), offset - before
    if limit is not None and skipped + limit <= top_rows:
        return held.orderBy(*order).offset(skipped).limit(limit)
    placed = with_position(held.select(*dict.fromkeys([key, "path"])), *order)
    inside = F.col("position") > skipped
    if limit is not None:
        inside &= F.col("position") <= skipped + limit
    places = written(placed.filter(inside).select("path", "position"), "places")
    if fits_broadcast(*measure(places, "path")):
        places = F.broadcast(places)
    return held.join(places, "path").orderBy("position").select(*df.columns)


def deep_page(
    df: DataFrame, sort: str = "name", offset: int = 0, limit: int | None = None, top_rows: int = TOP_ROWS
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the sorted whole (paths are unique).

    The whole is counted in ranges and never sorted. Runs jobs at once.
    """
    return page_of_ranges(df, sort, ranges_of(df, sort), offset, limit, top_rows)


def page_after(df: DataFrame, sort: str, last: tuple, limit: int) -> DataFrame:
    """The ``limit`` rows behind the one with the sort key and path of ``last``.

    Costs a filter and a top-n however deep the page is; ``last`` is ``(key, path)``.
    """
    order = sort_order(sort)
    name, downwards = _key_of(sort)
    column = F.col(name)
    key, path = last
    beyond = column < F.lit(key) if downwards else column > F.lit(key)
    if len(order) > 1:
        beyond |= (column == F.lit(key)) & (F.col("path") > F.lit(path))
    return df.filter(beyond).orderBy(*order).limit(limit)


def page(
    df: DataFrame,
    sort: str = "name",
    offset: int = 0,
    limit: int | None = None,
    top_rows: int = TOP_ROWS,
) -> DataFrame:
    """Sort, then skip ``offset`` rows and keep ``limit``; past the end the page is empty.

    Pages that end within ``top_rows`` are a lazy top-n, deeper ones a :func:`deep_page`;
    the rows are the same.
    """
    order = sort_order(sort)
    if limit is None and not offset:
        return df.orderBy(*order)
    if limit is not None and offset + limit <= top_rows:
        return df.orderBy(*order).offset(offset).limit(limit)
    return deep_page(df, sort, offset, limit, top_rows)
