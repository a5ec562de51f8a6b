"""Text terms of a search: small objects that become one boolean column."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathlode.functions.globs import glob_suffix, glob_whole, literal_runs
from pathlode.functions.patterns import spark_regex
from pathlode.functions.words import has_word, words


@dataclass(frozen=True)
class TextOptions:
    """How terms read the text; one set of options holds for a whole search."""

    match_case: bool = False
    whole_word: bool = False
    whole_filename: bool = False


@dataclass(frozen=True)
class Substring:
    """The text holds this text; under whole-word, one of its words is this text."""

    text: str

    def column(self, text: Column, options: TextOptions) -> Column:
        wanted = self.text if options.match_case else self.text.lower()
        return has_word(text, wanted) if options.whole_word else text.contains(wanted)

    def needles(self) -> list[str]:
        return [self.text]


@dataclass(frozen=True)
class Glob:
    """``*`` and ``?``: anchored at the end only, unless whole-filename or whole-word."""

    pattern: str

    def column(self, text: Column, options: TextOptions) -> Column:
        pattern = self.pattern if options.match_case else self.pattern.lower()
        if options.whole_filename:
            return glob_whole(text, pattern)
        if options.whole_word:
            holds = [text.contains(run) for run in literal_runs(pattern)]
            some_word = F.exists(words(text), lambda word: glob_whole(word, pattern))
            return reduce(and_, [*holds, some_word])
        return glob_suffix(text, pattern)

    def needles(self) -> list[str]:
        return [re.sub(r"[*?]", "", self.pattern)]


@dataclass(frozen=True)
class Regex:
    """Found anywhere in the text.

    Without match-case the text, and not the pattern, is lowercased, so capital
    letters in the pattern find nothing.
    """

    pattern: str

    def __post_init__(self) -> None:
        spark_regex(self.pattern)

    def column(self, text: Column, options: TextOptions) -> Column:
        pattern = spark_regex(self.pattern)
        if not options.whole_word:
            return text.rlike(pattern)
        # Only the first match in a word can start at its first character.
        return F.exists(words(text), lambda word: F.regexp_extract(word, pattern, 0) == word)

    def needles(self) -> list[str]:
        return ["".join(c for c in self.pattern if c.isalnum())]


@dataclass(frozen=True)
class Not:
    term: Term

    def column(self, text: Column, options: TextOptions) -> Column:
        return ~self.term.column(text, options)

    def needles(self) -> list[str]:
        return []


@dataclass(frozen=True, init=False)
class AnyOf:
    terms: tuple[Term, ...]

    def __init__(self, *terms: Term | str) -> None:
        object.__setattr__(self, "terms", tuple(as_terms(terms)))

    def column(self, text: Column, options: TextOptions) -> Column:
        return reduce(or_, [t.column(text, options) for t in self.terms], F.lit(False))

    def needles(self) -> list[str]:
        return [n for t in self.terms for n in t.needles()]


Term = Substring | Glob | Regex | Not | AnyOf


def from_text(text: str) -> list[Term]:
    """Plain search text: ``*`` or ``?`` makes a glob, ``|`` separates alternatives."""
    parts: list[Term] = [
        Glob(part) if re.search(r"[*?]", part) else Substring(part)
        for part in text.split("|")
        if part
    ]
    return parts if len(parts) < 2 else [AnyOf(*parts)]


def as_terms(terms) -> list[Term]:
    """A term, a text, or a sequence of these, as a list of terms."""
    if isinstance(terms, (str, Substring, Glob, Regex, Not, AnyOf)):
        terms = [terms]
    out: list[Term] = []
    for term in terms:
        out.extend(from_text(term) if isinstance(term, str) else [term])
    return out


def all_terms(terms: list[Term], text: Column, options: TextOptions) -> Column:
    """All terms hold; true when there are none."""
    return reduce(and_, [t.column(text, options) for t in terms], F.lit(True))


def needles_of(terms: list[Term]) -> list[str]:
    """The texts to mark in a result."""
    return [n for t in terms for n in t.needles() if n]
