"""One search: conditions, order, page, totals, marks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlode.functions.marks import mark_path, render_ansi
from pathlode.operators import grams as grams_
from pathlode.operators.predicates import matches
from pathlode.operators.sorting import TOP_ROWS, Ranges, page_after, page_of_ranges, ranges_of, sort_order
from pathlode.operators.sorting import page as page_of
from pathlode.operators.terms import as_terms, needles_of
from pathlode.operators.totals import taken_with_totals, with_totals
from pathlode.operators.totals import totals as totals_of

RESULT_COLUMNS = [
    "path",
    "name",
    "parent",
    "extension",
    "is_dir",
    "size",
    "modified",
    "created",
    "accessed",
]
DESKTOP_COLUMNS = ["path", "name", "parent", "extension", "is_dir", "size", "modified"]


@dataclass(frozen=True)
class SearchResult:
    """Parts of an answer; each is planned and run on its own, and none before it is asked for."""

    matched: DataFrame
    sort: str = "name"
    offset: int = 0
    limit: int | None = None
    needles: tuple[str, ...] = ()

    def _page(self, matched: DataFrame) -> DataFrame:
        return self._marked(page_of(matched, self.sort, self.offset, self.limit))

    def _marked(self, page: DataFrame) -> DataFrame:
        if self.needles:
            page = page.withColumn("path", mark_path(F.col("path"), list(self.needles)))
        return page

    @property
    def _is_deep(self) -> bool:
        return bool(self.offset) if self.limit is None else self.offset + self.limit > TOP_ROWS

    @cached_property
    def _ranges(self) -> Ranges:
        return ranges_of(self.matched, self.sort)

    @cached_property
    def page(self) -> DataFrame:
        """The rows asked for; a page beyond the bound of a top-n runs its jobs here."""
        if self._is_deep:
            return self._marked(page_of_ranges(self.matched, self.sort, self._ranges, self.offset, self.limit))
        return self._page(self.matched)

    @property
    def totals(self) -> DataFrame:
        """One row with the count and size of all matches, before paging."""
        return totals_of(self.matched)

    @cached_property
    def page_with_totals(self) -> DataFrame:
        """The page with the totals on every row.

        Both come from one scan where that is a top-n; deeper pages are found by counts, whose
        sums are the totals.
        """
        if self._is_deep:
            return self.page.withColumns({k: F.lit(v).cast("bigint") for k, v in self._ranges.totals.items()})
        if self.limit is None:
            return with_totals(self.page, self.matched)
        position = F.monotonically_increasing_id()
        # A top-n is one partition, so the numbers keep its order.
        taken = taken_with_totals(
            self.matched, lambda m: self._page(m).withColumn("_position", position)
        )
        return taken.orderBy("_position").drop("_position")

    def page_after(self, last: tuple, limit: int) -> DataFrame:
        """The next rows behind ``last``, the sort key and path of the last row shown."""
        return page_after(self.matched, self.sort, last, limit)


def search(
    entries: DataFrame,
    terms=(),
    *,
    sort: str = "name",
    offset: int = 0,
    limit: int | None = None,
    highlight: bool = False,
    grams: grams_.GramIndex | None = None,
    **wanted,
) -> SearchResult:
    """Search a catalogue; ``wanted`` are the criteria of ``operators.predicates.criteria``.

    With ``grams`` the search reads only the buckets that can hold its texts. Runs no job.
    """
    terms = as_terms(terms)
    if grams is None:
        matched = matches(entries, terms=terms, **wanted)
    else:
        matched = grams_.seeded_matches(entries, grams, terms=terms, **wanted)
    sort_order(sort)  # an unknown sort is an error here and not later
    needles = tuple(needles_of(terms)) if highlight and terms else ()
    return SearchResult(matched.select(*RESULT_COLUMNS), sort, offset, limit, needles)


def colored(page: DataFrame, color: int = 2) -> DataFrame:
    """A page whose marked paths show in terminal colours."""
    return page.withColumn("path", render_ansi(F.col("path"), color))


DESKTOP_LIMIT = 10_000  # fixed value: the page size of the desktop list


def desktop_rows(
    found: SearchResult, limit: int = DESKTOP_LIMIT, size_indexed: bool = True
) -> DataFrame:
    """The narrower rows of the desktop list: the first ``limit`` ones."""
    page = page_of(found.matched, found.sort, found.offset, limit)
    return page.select(*DESKTOP_COLUMNS, F.lit(size_indexed).alias("size_indexed"))
