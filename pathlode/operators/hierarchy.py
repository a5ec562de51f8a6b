"""Directories above entries: ancestors, subtree membership, cascades.

"At or under a directory" is an equality on an ancestor of the path, so it is
an equi-join and never a comparison of all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlode.functions.paths import (
    at_or_under,
    level_of,
    name_of,
    prefix_at,
    without_slash,
)
from pathlode.session import fits_broadcast, measure, written

# A hot ancestor (the root of most paths, say) is split into so many join keys: at least the
# first number, and one per so many paths.
SALTS, PATHS_PER_SALT = 32, 10_000_000
# With marks on more levels than this, one exploding join is cheaper than one join per level.
MAX_LEVELS = 24


def derive_directories(entries: DataFrame) -> DataFrame:
    """Every directory above some entry, each once.

    Files shrink to their distinct parents first, which are written, and these to their
    distinct parents again before ancestors are listed, so the widening step runs over a
    small part of the directories. Where these ancestors are few the parents are not
    shuffled once more.
    """
    path = F.col("path")
    parents = written(_parents(entries.select("path")).distinct(), "parents")
    tops = _parents(parents).distinct()
    levels = F.explode(F.sequence(F.lit(1), level_of(path))).alias("level")
    above = tops.select("path", levels).select(prefix_at(path, F.col("level")).alias("path"))
    above = written(above.filter(path != "").distinct(), "above")
    if fits_broadcast(*measure(above, "path")):
        return parents.join(F.broadcast(above), "path", "left_anti").union(above)
    return parents.union(above).distinct()


def _parents(paths: DataFrame) -> DataFrame:
    """The parent of every path that has one other than the root."""
    path = F.col("path")
    below_top = paths.filter(F.call_function("locate", F.lit("/"), path, F.lit(2)) > 0)
    return below_top.select(F.left(path, F.length(path) - F.length(name_of(path)) - 1).alias("path"))


@dataclass(frozen=True)
class Marks:
    """Marked directories with one long value each, written and measured."""

    table: DataFrame  # mark, value, level
    sizes: dict[int, tuple[int, int]]  # level -> rows, bytes

    @property
    def levels(self) -> list[int]:
        return sorted(self.sizes)

    def shallow(self, broadcast: bool | None = None) -> list[int]:
        """The levels that can be broadcast together, fewest marks first.

        Levels near the root have few marks, and these are the hot ones; so they are
        spared the shuffle even when all marks together are too many.
        """
        chosen, rows, size = [], 0, 0
        for level in sorted(self.sizes, key=lambda k: (self.sizes[k][0], k)):
            rows, size = rows + self.sizes[level][0], size + self.sizes[level][1]
            if broadcast is False or not fits_broadcast(rows, size) or len(chosen) == MAX_LEVELS:
                break
            chosen.append(level)
        return sorted(chosen)


def marks(paths: DataFrame, path: Column, value: Column) -> Marks:
    """The largest value per marked path."""
    table = written(
        paths.select(without_slash(path).alias("mark"), value.alias("value"))
        .groupBy("mark")
        .agg(F.max("value").alias("value"))
        .withColumn("level", level_of(F.col("mark"))),
        "marks",
    )
    # A row per level: bounded by the depth of paths, not by their number.
    size = F.sum(F.octet_length("mark") + 24)
    rows = table.groupBy("level").agg(F.count(F.lit(1)).alias("n"), size.alias("b")).collect()
    return Marks(table, {r["level"]: (r["n"], r["b"]) for r in rows})


def with_mark(
    entries: DataFrame,
    marked: Marks,
    name: str,
    broadcast: bool | None = None,
    paths: DataFrame | None = None,
) -> DataFrame:
    """Add the largest value marked at the path or at any directory above it (or null).

    Levels whose marks were measured as few are broadcast (never with
    ``broadcast=False``), one join each, so the entries are neither exploded nor
    shuffled.  For the others the ancestors of the paths meet the marks in a salted
    shuffle join; ``paths`` may give these paths from a cheaper table than ``entries``.
    """
    if not marked.levels:
        return entries.withColumn(name, F.lit(None).cast("bigint"))
    shallow = marked.shallow(broadcast)
    deep = [level for level in marked.levels if level not in shallow]
    out = near_marks(entries, marked, shallow, name)
    if deep:
        hits = far_marks(entries if paths is None else paths, marked, deep)
        best = F.greatest(name, "_far").alias(name)
        out = out.join(hits.groupBy("path").agg(F.max("value").alias("_far")), "path", "left")
        out = out.select(*entries.columns, best)
    return out


def near_marks(entries: DataFrame, marked: Marks, levels: list[int], name: str) -> DataFrame:
    """``with_mark`` for levels that can be broadcast."""
    out = entries
    for level in levels:
        at_level = marked.table.filter(F.col("level") == level).select(
            F.col("mark").alias(f"_mark{level}"), F.col("value").alias(f"_value{level}")
        )
        ancestor = prefix_at(F.col("path"), F.lit(level))
        out = out.join(F.broadcast(at_level), ancestor == F.col(f"_mark{level}"), "left")
    # Two nulls more, so that there are always several values to compare.
    nothing = F.lit(None).cast("bigint")
    values = [F.col(f"_value{level}") for level in levels]
    return out.select(*entries.columns, F.greatest(nothing, nothing, *values).alias(name))


def far_marks(paths: DataFrame, marked: Marks, levels: list[int]) -> DataFrame:
    """(``path``, ``value``) for every mark of the levels at or above a path."""
    path = F.col("path")
    salts = max(SALTS, paths.count() // PATHS_PER_SALT)
    ancestors = (
        paths.select("path", F.explode(F.sequence(F.lit(1), level_of(path))).alias("level"))
        .filter(F.col("level").isin(levels))
        .select(
            "path",
            prefix_at(path, F.col("level")).alias("mark"),
            F.pmod(F.xxhash64("path"), F.lit(salts)).alias("salt"),
        )
    )
    salted = marked.table.filter(F.col("level").isin(levels)).select(
        "mark", "value", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    )
    salted = salted.withColumn("salt", F.col("salt").cast("bigint"))
    return ancestors.join(salted, ["mark", "salt"]).select("path", "value")


def under(entries: DataFrame, folders: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """Entries at or under any path of ``folders`` (a table with a ``path`` column)."""
    marked = marks(folders, F.col("path"), F.lit(1).cast("bigint"))
    found = with_mark(entries, marked, "_under", broadcast)
    return found.filter(F.col("_under").isNotNull()).drop("_under")


def not_under(entries: DataFrame, folders: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """Cascade delete: entries that are neither in ``folders`` nor under one of them."""
    marked = marks(folders, F.col("path"), F.lit(1).cast("bigint"))
    found = with_mark(entries, marked, "_under", broadcast)
    return found.filter(F.col("_under").isNull()).drop("_under")


def under_any(path: Column, folders) -> Column:
    """The same test for a short literal list of folders; true for an empty list."""
    tests = [at_or_under(path, folder) for folder in folders]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(True)
