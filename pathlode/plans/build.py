"""Building a catalogue from a listing, and bringing a saved one up to date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlode.functions.paths import with_parts
from pathlode.operators.excludes import Excludes, apply_excludes
from pathlode.operators.reconcile import reconcile_diff
from pathlode.session import written
from pathlode.sources.catalogue import SaveStats, latest_version, load_catalogue
from pathlode.sources.inventory import (
    as_entries,
    lost_lines,
    one_per_path,
    read_inventory,
    silent_files,
    without_metadata,
)
from pathlode.streaming.fold import logged_events, save_listing


def build_catalogue(
    listing: DataFrame,
    roots: tuple[str, ...] = (),
    excludes: Excludes = Excludes(),
    metadata: bool = True,
) -> DataFrame:
    """Listing to catalogue: rules, one row per path, derived columns.

    Without roots every path counts, those of object stores included.
    """
    kept = apply_excludes(as_entries(listing), excludes, roots)
    return with_parts(one_per_path(kept if metadata else without_metadata(kept)))


def refresh(
    spark: SparkSession,
    folder: str,
    listing: DataFrame,
    roots: tuple[str, ...] = (),
    excludes: Excludes = Excludes(),
    as_of_seq: int | None = None,
    complete: bool = True,
) -> tuple[SaveStats, DataFrame | None]:
    """Save the listing as the new version of the catalogue.

    The listing wins: unseen entries go, new ones come.  It knows the events up to
    ``as_of_seq``, so those that arrive later change nothing; later ones are carried into
    the new version's log. That number is needed as soon as events are logged. From a
    listing that is not ``complete`` nothing is removed, and of paths that it does not list
    older events still count. With an earlier version the differences to it come back too;
    without one there is nothing to compare.
    """
    last = latest_version(spark, folder)
    before = load_catalogue(spark, folder) if last else None
    if last and as_of_seq is None and not logged_events(spark, folder).isEmpty():
        raise ValueError("events are logged: say up to which seq the listing knows them")
    entries = build_catalogue(listing, roots, excludes)
    through = last["through_batch"] if last else -1
    stats = save_listing(spark, folder, entries, through, "refresh", as_of_seq, complete)
    after = load_catalogue(spark, folder, stats.version)
    return stats, None if before is None else reconcile_diff(before, after)


@dataclass(frozen=True)
class Intake:
    """What a refresh from inventory files has saved, and what it could not read."""

    stats: SaveStats
    changes: DataFrame | None
    lost_lines: int
    silent_files: int

    @property
    def complete(self) -> bool:
        return not self.lost_lines and not self.silent_files


def refresh_from_inventory(
    spark: SparkSession,
    folder: str,
    locations: str | list[str],
    format: str = "parquet",
    roots: tuple[str, ...] = (),
    excludes: Excludes = Excludes(),
    as_of_seq: int | None = None,
    skip_unreadable: bool = False,
    **options: str,
) -> Intake:
    """:func:`refresh` from inventory files, which removes nothing if any line or file was lost.

    Lost lines are appended to ``<folder>/lost_lines`` with the ``version`` that lacks them.
    With ``skip_unreadable`` damaged files are passed over; files without a row count as such.
    """
    lost = lost_lines(spark, locations, format, skip_unreadable, **options)
    lost = written(lost, "lost-lines")
    n_lost = lost.count()
    n_silent = silent_files(spark, locations, format, **options).count() if skip_unreadable else 0
    listing = read_inventory(spark, locations, format, skip_unreadable, **options)
    stats, changes = refresh(spark, folder, listing, roots, excludes, as_of_seq, not n_lost and not n_silent)
    if n_lost:
        kept = lost.withColumn("version", F.lit(stats.version).cast("bigint"))
        kept.write.mode("append").parquet(f"{folder}/lost_lines")
    return Intake(stats, changes, n_lost, n_silent)
