"""Marking matches in result paths, and terminal colours for the marks."""

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathlode.functions.paths import name_of

ESC = "\x1b"


def _hits(text: Column, needle: str) -> Column:
    """``start`` (from 1) and ``end`` (exclusive) of the hits of ``needle``, which do not overlap."""
    pieces = F.split(text, re.escape(needle))
    nothing = F.array().cast("array<struct<start:int,end:int>>")

    def add(before: Column, piece: Column) -> Column:
        start = before["at"] + F.length(piece)
        end = start + len(needle)
        hit = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(before["hits"], F.array(hit)).alias("hits"))

    found = F.aggregate(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        F.struct(F.lit(1).alias("at"), nothing.alias("hits")),
        add,
        lambda all_: all_["hits"],
    )
    return F.when(text.contains(needle), found).otherwise(nothing)


def _lower_in_place(text: Column) -> Column:
    """Lower case with every character in its place: one that would become several stays."""
    lower = F.lower(text)
    each = F.transform(
        F.split(text, ""), lambda c: F.when(F.length(F.lower(c)) == 1, F.lower(c)).otherwise(c)
    )
    return F.when(F.length(lower) == F.length(text), lower).otherwise(F.array_join(each, ""))


def mark_name(name: Column, needles: list[str]) -> Column:
    """Put ``*`` around every run of characters covered by hits of the needles.

    Hits of one needle do not overlap; hits of several needles that touch or
    overlap become one mark.
    """
    needles = list(dict.fromkeys(n.lower() for n in needles if n))
    if not needles:
        return name

    def marked(both: Column) -> Column:
        name, lowered = both["name"], both["lowered"]
        hits = F.array_sort(F.concat(*[_hits(lowered, n) for n in needles]))

        def part(start: Column, end: Column) -> Column:
            return F.substring(name, start, end - start)

        def run(before: Column) -> Column:
            return F.concat(before["done"], F.lit("*"), part(before["start"], before["end"]), F.lit("*"))

        def add(before: Column, hit: Column) -> Column:
            touches = hit["start"] <= before["end"]
            done = F.concat(run(before), part(before["end"], hit["start"]))
            return F.struct(
                F.when(touches, before["done"]).otherwise(done).alias("done"),
                F.when(touches, before["start"]).otherwise(hit["start"]).alias("start"),
                F.when(touches, F.greatest(before["end"], hit["end"])).otherwise(hit["end"]).alias("end"),
            )

        def merged(hits: Column) -> Column:
            first = F.get(hits, F.lit(0))
            begin = F.struct(
                part(F.lit(1), first["start"]).alias("done"),
                first["start"].alias("start"),
                first["end"].alias("end"),
            )
            rest = lambda last: F.concat(run(last), part(last["end"], F.length(name) + 1))
            return F.aggregate(hits, begin, add, rest)

        return F.when(F.size(hits) == 0, name).otherwise(_with(hits, merged))

    both = F.struct(name.alias("name"), _lower_in_place(name).alias("lowered"))
    return _with(both, marked)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: what a lambda names several times is not shared."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def mark_path(path: Column, needles: list[str]) -> Column:
    """The path with the matches in its name marked."""
    name = name_of(path)
    parent = F.left(path, F.length(path) - F.length(name))
    return F.concat(parent, mark_name(name, needles))


def render_ansi(text: Column, color: int = 1) -> Column:
    """Marks become terminal colours, ``**`` a plain ``*``; unclosed marks stay text."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?s)(\*\*|\*[^*]+\*|[^*]+|\*)"), F.lit(1))
    colored = lambda t: F.concat(
        F.lit(f"{ESC}[3{color % 8}m"), F.trim(t, F.lit("*")), F.lit(f"{ESC}[0m")
    )
    return F.array_join(
        F.transform(
            tokens,
            lambda t: F.when(t == "**", F.lit("*"))
            .when(t.startswith("*") & (F.length(t) > 2), colored(t))
            .otherwise(t),
        ),
        "",
    )


def strip_ansi(text: Column) -> Column:
    """Drop everything from an escape character to the next ``m``."""
    return F.regexp_replace(text, ESC + "[^m]*m?", "")
