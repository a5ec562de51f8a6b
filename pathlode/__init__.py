"""Search and upkeep of large file catalogues on Spark."""

from pathlode.operators.changes import Scope, apply_changes
from pathlode.operators.excludes import Excludes
from pathlode.operators.grams import gram_search, load_grams, name_grams, save_grams
from pathlode.operators.reconcile import reconcile_diff
from pathlode.operators.sorting import flag_sort, with_position
from pathlode.operators.terms import AnyOf, Glob, Not, Regex, Substring
from pathlode.plans.build import build_catalogue, refresh, refresh_from_inventory
from pathlode.plans.search import SearchResult, colored, search
from pathlode.sources.catalogue import load_catalogue, save_catalogue
from pathlode.sources.events import changes_from_json, read_changes, stream_changes
from pathlode.sources.export import NoResults, export
from pathlode.sources.inventory import lost_lines, read_inventory, scan_files, silent_files
from pathlode.streaming.fold import (
    current_catalogue,
    current_status,
    fold_stream,
    start_catalogue,
)

__all__ = [
    "AnyOf",
    "Excludes",
    "Glob",
    "NoResults",
    "Not",
    "Regex",
    "Scope",
    "SearchResult",
    "Substring",
    "apply_changes",
    "build_catalogue",
    "changes_from_json",
    "colored",
    "current_catalogue",
    "current_status",
    "export",
    "flag_sort",
    "fold_stream",
    "gram_search",
    "load_catalogue",
    "load_grams",
    "lost_lines",
    "name_grams",
    "read_changes",
    "read_inventory",
    "reconcile_diff",
    "refresh",
    "refresh_from_inventory",
    "save_catalogue",
    "save_grams",
    "scan_files",
    "search",
    "silent_files",
    "start_catalogue",
    "stream_changes",
    "with_position",
]
