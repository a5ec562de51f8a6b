"""Globs with ``*`` (any run) and ``?`` (one character) as columns.

One rule is special: a ``?`` directly after a ``*`` stands only for a literal
question mark, so ``*?o`` finds ``f?o`` and not ``xfoo``.
"""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PIECE = re.compile(r"\*+|\?|[^*?]+")


def glob_regex(pattern: str, run: str = ".*", one: str = ".") -> str:
    """The regular expression (unanchored) of a glob."""
    out, after_run = [], False
    for piece in _PIECE.findall(pattern):
        if piece[0] == "*":
            out.append(run)
        elif piece == "?":
            out.append(r"\?" if after_run else one)
        else:
            out.append(re.escape(piece))
        after_run = piece[0] == "*"
    return "".join(out)


def literal_runs(pattern: str) -> list[str]:
    """The fixed texts of a glob, each of which a matching text must hold."""
    return [piece for piece in _PIECE.findall(pattern) if piece[0] not in "*?"]


def glob_whole(text: Column, pattern: str) -> Column:
    """The whole text matches.  One fixed text becomes a pushable string predicate."""
    pieces = ["*" if p[0] == "*" else p for p in _PIECE.findall(pattern)]
    if "?" not in pieces:
        if not pieces:
            return text == F.lit("")
        if pieces == ["*"]:
            return text.isNotNull()
        if len(pieces) == 1:
            return text == F.lit(pieces[0])
        if len(pieces) == 2:
            return text.endswith(pieces[1]) if pieces[0] == "*" else text.startswith(pieces[0])
        if len(pieces) == 3 and pieces[0] == "*":
            return text.contains(pieces[1])
    return text.rlike(r"(?s)\A" + glob_regex(pattern) + r"\z")


def glob_suffix(text: Column, pattern: str) -> Column:
    """Some non-empty suffix matches the whole pattern: free start, anchored end."""
    if "*" not in pattern and "?" not in pattern:
        return text.contains(pattern)
    pieces = ["*" if p[0] == "*" else p for p in _PIECE.findall(pattern)]
    if "?" not in pieces:
        fixed = [p for p in pieces if p != "*"]
        if not fixed:
            return text != F.lit("")
        if len(fixed) == 1:
            return text.contains(fixed[0]) if pieces[-1] == "*" else text.endswith(fixed[0])
    # The start is free, so a leading run adds nothing but backtracking.
    return text.rlike("(?s)" + glob_regex(pattern).removeprefix(".*") + r"\z")


def glob_component(pattern: str) -> str:
    """Regular expression of a glob that must stay within one path component."""
    return glob_regex(pattern, run="[^/]*", one="[^/]")
