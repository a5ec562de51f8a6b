"""Rules that keep entries out of the catalogue.

A directory that is ruled out hides its whole subtree, and the root itself is
exempt; so a rule is tested on every path component strictly below the root.
The rules become regular expressions over the path (no arrays, no lambdas), so
the filter stays in generated code.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlode.functions.globs import glob_component, literal_runs
from pathlode.functions.paths import at_or_under, name_of

# System directories.
SYSTEM_PATHS = ("/proc", "/sys", "/dev")

# What stands before the first component of a path, tried longest first and never shorter.
_ANY_ROOT = r"(?>[A-Za-z][A-Za-z0-9+.-]*://[^/]*/|/|)"

MAX_TEXTS = 16  # longer lists of globs are tested without looking for their texts first


def in_hidden_directory(path: Column) -> Column:
    """Some directory above the path has a hidden name (a lone dot is not hidden)."""
    maybe = path.contains("/.") | path.startswith(".")  # cheap, and false for most paths
    return maybe & path.rlike(r"(?:^|/)\.[^/]+/")


def is_hidden_directory(path: Column, is_dir: Column) -> Column:
    """Below a hidden directory, or one itself.  Hidden files alone do not count."""
    name = name_of(path)
    return in_hidden_directory(path) | (is_dir & name.startswith(".") & (F.length(name) > 1))


def _one_of(patterns) -> str:
    return "|".join(glob_component(p) for p in patterns)


def _has_component(path: Column, globs: list[str]) -> Column:
    """Some component of the path matches one of the globs."""
    found = path.rlike(rf"(?s)(?:^|/)(?:{_one_of(globs)})(?:/|\z)")
    longest = [max(literal_runs(g), key=len, default="") for g in globs]
    if all(longest) and len(globs) <= MAX_TEXTS:
        # Most paths hold none of the fixed texts and never reach the expression.
        found = reduce(or_, [path.contains(text) for text in longest]) & found
    return found


@dataclass(frozen=True)
class Excludes:
    """The rule set.  Globs are case-sensitive and match a whole name.

    ``paths`` is for short lists; for a table of folders use
    ``operators.hierarchy.not_under``.
    """

    skip_hidden: bool = False
    skip_system_paths: bool = False
    patterns: tuple[str, ...] = ()
    folders: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    include_only: tuple[str, ...] = ()

    def keep(self, roots: tuple[str, ...] = ()) -> Column:
        """True for entries that stay: found below some root under all rules.

        Without roots every path stays that the rules do not drop; its root is then
        the scheme and authority, or the leading slash.
        """
        path, is_dir = F.col("path"), F.col("is_dir")
        everywhere = [~is_hidden_directory(path, is_dir)]
        if self.paths:
            everywhere.append(~reduce(or_, [at_or_under(path, p) for p in self.paths]))
        if self.skip_hidden:
            everywhere.append(~name_of(path).startswith("."))
        if self.folders:
            everywhere.append(~self._in_folder(path))
        return reduce(and_, [*everywhere, self._found_below(path, roots)])

    def _in_folder(self, path: Column) -> Column:
        """Some component of the whole path matches; the root of a path counts as ``/``."""
        globs = [p.removeprefix("**/") for p in self.folders]
        named = [g for g in globs if "/" not in g]
        tests = [_has_component(path, named)] if named else []
        if any(g == "/" or g == "?" or (g and set(g) == {"*"}) for g in globs):
            tests.append(path.startswith("/"))
        return reduce(or_, tests, F.lit(False))

    def _found_below(self, path: Column, roots: tuple[str, ...]) -> Column:
        """Strictly below some root, with no component on the way ruled out.

        Rules that could hit a component of a root itself go into one regular
        expression that starts at the root; the others read the whole path.
        """
        starts = [root.rstrip("/") + "/" for root in roots]
        anywhere = not roots
        # A glob holding a slash matches no name.
        patterns = [p for p in self.patterns if "/" not in p]
        globs = [p for p in self.include_only if "/" not in p]
        if self.include_only and not globs:
            return F.lit(False)
        tests, rest, system = [], "", ""
        if patterns:
            one_of = _one_of(patterns)
            in_root = re.compile(rf"(?s)(?:^|/)(?:{one_of})(?:/|\Z)")
            if anywhere:
                # The names of a store and its bucket are part of the root.
                below = path.rlike(rf"(?s)\A(?:{_ANY_ROOT})(?!(?:.*/)?(?:{one_of})(?:/|\z))")
                tests.append(~_has_component(path, patterns) | (path.contains("://") & below))
            elif any(in_root.search(root) for root in roots):
                rest += rf"(?!(?:.*/)?(?:{one_of})(?:/|\z))"
            else:
                tests.append(~_has_component(path, patterns))
        if globs:
            rest += rf"(?:{_one_of(globs)})(?:/(?:{_one_of(globs)}))*\z"
        # System directories lie strictly below no root but "/".
        if self.skip_system_paths and (anywhere or starts == ["/"]):
            tests += [~at_or_under(path, s) for s in SYSTEM_PATHS]
        elif self.skip_system_paths and "/" in starts:
            names = "|".join(s.removeprefix("/") for s in SYSTEM_PATHS)
            system = rf"(?!(?:{names})(?:/|\z))"
        if anywhere:
            if rest:
                tests.insert(0, path.rlike(rf"(?s)\A(?:{_ANY_ROOT}){rest}"))
        elif rest or system:
            some_root = "|".join(re.escape(s) + (system if s == "/" else "") for s in starts)
            tests.insert(0, path.rlike(rf"(?s)\A(?:{some_root}){rest}"))
        else:
            tests.insert(0, reduce(or_, [path.startswith(start) for start in starts]))
        return reduce(and_, tests, F.lit(True))


def apply_excludes(
    entries: DataFrame, excludes: Excludes, roots: tuple[str, ...] = ()
) -> DataFrame:
    return entries.filter(excludes.keep(roots))
