"""Benchmark decontamination by pigeonhole edit matching.

A test item of which at most k characters may differ is cut into k + 1 pieces; wherever
it occurs with at most k errors, one piece occurs exactly. One Aho-Corasick pass finds the
piece hits of a whole text. A hit is then verified outwards: pieces are the leaves of a
binary tree, a node of n pieces may have n - 1 errors, and some piece always has all nodes
above it within their budgets. Distances are Myers' bit-parallel ones on whole integers,
so chance hits die after a few characters and nothing is missed.

Texts and items are lower-cased and their blanks are made single spaces; positions count
characters of that form.
"""

import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from pathlode.llm.common import key_kind, stored

# Share of an item's characters that may differ.
ERROR_RATE = 0.1
# Characters of items held in memory at once; more items are matched block by block.
BLOCK_CHARS = 2_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


class Pattern:
    """One text to find with at most ``budget`` errors."""

    def __init__(self, text: str, budget: int):
        self.length, self.budget = len(text), budget
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """The least distance of any substring, and the first end where it is reached."""
        full, top = (1 << self.length) - 1, 1 << self.length - 1
        pv, mv, score = full, 0, self.length
        best = (score, 0)
        masks = self.masks.get
        for end, c in enumerate(text, 1):
            eq = masks(c, 0)
            xh = ((eq & pv) + pv ^ pv | eq) & full
            ph, mh = mv | full & ~(xh | pv), pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best[0]:
                    best = (score, end)
            ph = ph << 1 & full
            xv = eq | mv
            pv = mh << 1 & full | full & ~(xv | ph)
            mv = ph & xv
        return best


class Item:
    """A test item, its pieces and, made when first needed, the patterns of its tree."""

    def __init__(self, text: str, rate: float):
        self.text, self.budget = text, int(rate * len(text))
        pieces = self.budget + 1
        self.cuts = [len(text) * j // pieces for j in range(pieces + 1)]
        self.patterns: dict[tuple[int, int], Pattern] = {}
        self.reverse = None

    def pieces(self) -> Iterator[tuple[int, str]]:
        for j, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            yield j, self.text[a:b]

    def _path(self, piece: int) -> list[tuple[int, int]]:
        """The nodes above a piece, from the smallest to the whole item."""
        lo, hi, path = 0, len(self.cuts) - 1, []
        while hi - lo > 1:
            path.append((lo, hi))
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if piece < mid else (mid, hi)
        return path[::-1]

    def verify(self, text: str, piece: int, at: int) -> tuple[int, int, int] | None:
        """(distance, start, end) near a hit of ``piece`` at ``at``, if within the budget."""
        origin = at - self.cuts[piece]
        if text.startswith(self.text, origin) and origin >= 0:
            return 0, origin, origin + len(self.text)
        distance, end, low = 0, at, at
        for lo, hi in self._path(piece):
            node = self.patterns.get((lo, hi))
            if node is None:
                part = self.text[self.cuts[lo] : self.cuts[hi]]
                node = self.patterns[lo, hi] = Pattern(part, hi - lo - 1)
            low = max(origin + self.cuts[lo] - node.budget, 0)
            distance, end = node.best(text[low : origin + self.cuts[hi] + node.budget])
            if distance > node.budget:
                return None
        end += low
        if self.reverse is None:
            self.reverse = Pattern(self.text[::-1], self.budget)
        low = max(end - len(self.text) - self.budget, 0)
        _, length = self.reverse.best(text[low:end][::-1])
        return distance, end - length, end


class Matcher:
    """All items of a block, found in one pass over a text."""

    def __init__(self, items: list[tuple[int | None, str | None]], rate: float):
        self.ids = [i for i, _ in items]
        self.items = [Item(normal(t), rate) for _, t in items]
        hits: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            for j, piece in item.pieces() if item.text else ():
                hits.setdefault(piece, []).append((n, j))
        self.automaton = ahocorasick.Automaton()
        for piece, places in hits.items():
            self.automaton.add_word(piece, (len(piece), places))
        if hits:
            self.automaton.make_automaton()
        self.empty = not hits

    def find(self, text: str | None) -> dict[int, tuple[int, int, int]]:
        """Item number -> (distance, start, end) of its best and then first match."""
        found: dict[int, tuple[int, int, int]] = {}
        if self.empty or not text:
            return found
        line, tried = normal(text), set()
        for end, (length, places) in self.automaton.iter(line):
            at = end - length + 1
            for n, j in places:
                item = self.items[n]
                # An exact match cannot be bettered; hits on one diagonal see one window.
                if found.get(n, (1,))[0] == 0 or (n, at - item.cuts[j]) in tried:
                    continue
                match = item.verify(line, j, at)
                if match:
                    tried.add((n, at - item.cuts[j]))
                    found[n] = min(match, found.get(n, match))
        return found


_MATCHERS: dict[int, Matcher] = {}


def _matcher(held: Broadcast, rate: float, mark: str) -> Matcher:
    """One matcher per worker: that of the block at hand."""
    if mark not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[mark] = Matcher(held.value, rate)
    return _MATCHERS[mark]


def _blocks(items: DataFrame, key: str, text: str, chars: int) -> Iterator[list[tuple]]:
    block, size = [], 0
    for row in items.select(key, text).toLocalIterator():
        block.append(tuple(row))
        size += len(row[1] or "")
        if size >= chars:
            yield block
            block, size = [], 0
    yield block


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    error_rate: float = ERROR_RATE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per document row and test item that it holds: ``key``, ``item_key``,
    ``distance``, ``start``, ``end``.

    An item is held if some substring of the whole normalised text is within
    ``error_rate`` of the item's length in edits; the least distance and its first place are
    given. Null, empty and blank texts and items match nothing. Repeated rows are found
    each by itself; items that share an id are found each by itself too. Any number of
    documents may hold an item: nothing is grouped.
    """
    fields = [docs.schema[key], items.schema[item_key]]
    if key == item_key:
        raise ValueError("documents and items need keys of different names")
    names = ("distance", "start", "end")
    schema = StructType(
        [StructField(f.name, key_kind(f.dataType)) for f in fields]
        + [StructField(n, LongType()) for n in names]
    )
    spark, found = docs.sparkSession, None
    texts = docs.select(F.col(key).cast(schema[key].dataType), text)
    items = items.select(F.col(item_key).cast(schema[item_key].dataType), item_text)
    for block in _blocks(items, item_key, item_text, block_chars):
        held = spark.sparkContext.broadcast(block)
        if found is not None:
            found = stored(found, "leaks")
        rows = texts.mapInPandas(_find(held, error_rate, schema.names), schema)
        found = rows if found is None else found.unionByName(rows)
    return found.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in fields})


def _find(held: Broadcast, rate: float, names: list[str]):
    mark = uuid.uuid4().hex

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = _matcher(held, rate, mark)
        for batch in batches:
            out = [
                (key, matcher.ids[n], *match)
                for key, text in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True)
                for n, match in sorted(matcher.find(text).items())
            ]
            yield pd.DataFrame(out, columns=names)

    return rows


def drop_leaks(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_text: str = "text",
    error_rate: float = ERROR_RATE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``docs`` without the rows that hold any test item, as ``find_leaks`` finds them."""
    item_key = items.columns[0]
    for block in _blocks(items, item_key, item_text, block_chars):
        held = docs.sparkSession.sparkContext.broadcast(block)
        docs = docs.filter(~_holds(held, error_rate)(text))
    return docs


def _holds(held: Broadcast, rate: float):
    mark = uuid.uuid4().hex

    @pandas_udf(BooleanType())
    def holds(texts: pd.Series) -> pd.Series:
        matcher = _matcher(held, rate, mark)
        return pd.Series([bool(matcher.find(t)) for t in texts], dtype=bool)

    return holds
