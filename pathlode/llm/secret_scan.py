"""Secrets by known patterns, and by formats learnt from what the patterns find.

Three patterns give the base spans. Their values are labelled credentials: for each kind the
prefix tree of a bounded sample becomes a probabilistic automaton, by merging states whose
ways on do not differ more than chance allows: first those at the same position, so that few
credentials tell a format, then those of different positions. All other runs of credential characters, and
their parts at ``=`` and ``/``, are then scored by every automaton: the mean log-likelihood of a
run's characters, end and length. A run that is as likely as the credentials themselves is a further
span, of kind ``like_`` and that kind; of runs that overlap the likeliest is taken.

Texts are read twice, to learn and to score, so that only spans are stored: most runs are words.
"""

import math
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from pathlode.llm.common import key_kind, stored

# The kinds in their order, with the pattern, the group measured, and its least length.
KINDS = {
    "assign": (
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}

# Distinct credentials of a kind (about) and characters of one that an automaton is learnt from.
SAMPLE, SAMPLE_CHARS = 1500, 200
# Significance of the test that keeps two states apart, and weight of what was never seen. Weight of the
# characters of all credentials in the likelihoods of one state.
ALPHA, UNSEEN, BACKOFF = 0.05, 0.01, 4.0
# Shortest run that is scored, and the share of credentials that may score below the threshold.
CANDIDATE_CHARS, MISSED = 8, 0.02
# Credentials that must end in a state for it to have a threshold of its own.
ENDS = 20

_ASSIGN = re.compile(KINDS["assign"][0], re.I | re.A)
_ACCESS = re.compile(KINDS["access"][0])
# Runs that are too short fail as a whole, so they need not be matched.
_HEX = re.compile(rf"[0-9a-f]{{{KINDS['hex'][2]},}}")
_RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{CANDIDATE_CHARS},}}")
_CUT = re.compile(r"[=/]")
# Distinct runs whose scores a worker remembers, and the longest of them.
_SCORES, _SCORED_CHARS = 1 << 16, 64
_ALPHABET = 67


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's number, end, value) of the patterns' matches, in this order."""
    found = []
    if ":" in text or "=" in text:
        found += [
            (m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= KINDS["assign"][2]
        ]
    found += [
        (m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= KINDS["access"][2]
    ]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def candidates(
    text: str, taken: Sequence[tuple[int, int, int, str]], longest: int = 4 * SAMPLE_CHARS
) -> list[tuple[int, int, str]]:
    """(start, end, run) of the maximal runs outside the base spans, and of their parts.

    Parts lie between two cuts (``=`` or ``/``), or go from a cut to the run's end. Parts overlap
    their run. Runs and parts over ``longest``, the longest credential learnt, fit no automaton
    and are left out.
    """
    found, at = [], 0
    for m in _RUN.finditer(text):
        # Spans stand in order of their start; those that end before this run never matter again.
        while at < len(taken) and taken[at][2] <= m.start():
            at += 1
        start = m.start()
        for span in _near(taken, at, m.end()):
            _parts(text, start, span[0], longest, found)
            start = max(start, span[2])
        _parts(text, start, m.end(), longest, found)
    return found


def _parts(text: str, start: int, end: int, longest: int, found: list[tuple[int, int, str]]) -> None:
    """Add the run from ``start`` to ``end``, and its parts, if they are long enough and not too long."""
    run = text[start:end].rstrip(".")
    end = start + len(run)

    def add(a: int, b: int) -> None:
        if CANDIDATE_CHARS <= b - a <= longest:
            found.append((a, b, text[a:b]))

    add(start, end)
    before = start
    for m in _CUT.finditer(run):
        cut = start + m.start()
        add(before, cut)
        add(cut + 1, end)
        before = cut + 1


def _near(spans, at: int, end: int):
    while at < len(spans) and spans[at][0] < end:
        yield spans[at]
        at += 1


@dataclass
class Automaton:
    """Transition and length log-likelihoods of one kind, and the least scores to accept.

    ``moves`` has every character that any credential has, for every state; ``onward`` is where
    all others lead, and ``rare`` what they cost; ``stops`` is for a run that ends in the state.
    ``thresholds`` goes by the state in which a run ends: formats differ in their usual scores.
    """

    moves: list[dict[str, tuple[int, float]]]
    onward: list[int]
    rare: list[float]
    stops: list[float]
    lengths: dict[int, float]
    odd_length: float
    thresholds: list[float]

    @property
    def longest(self) -> int:
        """The longest credential learnt; a longer run fits no format."""
        return max(self.lengths)

    def margin(self, run: str) -> float | None:
        """The run's score above the threshold; None if it is below.

        The score is the mean log-likelihood of the characters, the end and the length.
        """
        state, total = 0, self.lengths.get(len(run), self.odd_length)
        least = min(self.thresholds) * (len(run) + 1) - 1e-6
        for c in run:
            move = self.moves[state].get(c)
            if move is None:
                total += self.rare[state]
                state = self.onward[state]
            else:
                state = move[0]
                total += move[1]
            if total < least:  # no later character adds to it
                return None
        over = (total + self.stops[state]) / (len(run) + 1) - self.thresholds[state]
        return over if over >= 0 else None


class _Tree:
    """The prefix tree with its counts; merging turns it into an automaton.

    A merged state stands for all that went into it: ``at`` gives the one that stands for a state.
    """

    def __init__(self, runs: Sequence[str]):
        self.next: list[dict[str, int]] = [{}]
        self.passed: list[Counter] = [Counter()]
        self.ended, self.into = [0], [0]
        # Pairs known to differ, until a merge changes counts.
        self.differ: set[tuple[int, int]] = set()
        for run in runs:
            state = 0
            for c in run:
                self.passed[state][c] += 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.into.append(len(self.next))
                    self.next.append({})
                    self.passed.append(Counter())
                    self.ended.append(0)
                state = self.next[state][c]
            self.ended[state] += 1

    def at(self, state: int) -> int:
        while self.into[state] != state:
            self.into[state] = state = self.into[self.into[state]]
        return state

    def to(self, state: int, symbol: str) -> int:
        return self.at(self.next[state][symbol])

    def seen(self, state: int) -> int:
        return self.ended[state] + self.passed[state].total()

    def _apart(self, a: int, b: int) -> bool | None:
        """Whether two states differ by themselves; None if too few went there to tell."""
        n, m = self.seen(a), self.seen(b)
        bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (n**-0.5 + m**-0.5) if n and m else 1
        if bound >= 1:  # and so are all states below the rarer one
            return None
        p, q = self.passed[a], self.passed[b]
        return abs(self.ended[a] / n - self.ended[b] / m) > bound or any(
            abs(p[c] / n - q[c] / m) > bound for c in p.keys() | q.keys()
        )

    def alike(self, a: int, b: int) -> bool:
        """Whether no way on from the two states differs by more than Hoeffding's bound."""
        first: dict[tuple[int, int], tuple[int, int] | None] = {(a, b): None}
        pairs = [(a, b)]
        while pairs:
            pair = pairs.pop()
            apart = pair in self.differ or self._apart(*pair)
            if apart:
                # What leads to a difference differs too.
                while pair is not None:
                    self.differ.add(pair)
                    pair = first[pair]
                return False
            if apart is None:
                continue
            x, y = pair
            for c in self.next[x].keys() & self.next[y].keys():
                below = (self.to(x, c), self.to(y, c))
                if below[0] != below[1] and below not in first:
                    first[below] = pair
                    pairs.append(below)
        return True

    def merge(self, a: int, b: int) -> None:
        """Let ``a`` stand for ``b`` too, and merge where both lead by the same symbol."""
        self.differ.clear()
        pairs = [(a, b)]
        while pairs:
            a, b = map(self.at, pairs.pop())
            if a == b:
                continue
            self.into[b] = a
            self.ended[a] += self.ended[b]
            self.passed[a].update(self.passed[b])
            for c, child in self.next[b].items():
                if c in self.next[a]:
                    pairs.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def merge_layers(self) -> None:
        """Merge states at the same position, unless they differ: first those after the same state.

        Few credentials pass any one state of the tree, too few to tell it from others. Together
        those of a position tell what stands there, and formats with a start of their own stay apart.
        """
        layer = [0]
        while layer:
            after = [self._merged([self.to(k, c) for c in sorted(self.next[k])]) for k in layer]
            layer = self._merged([state for states in after for state in states])

    def _merged(self, states: list[int]) -> list[int]:
        """What stays of states at the same position, the most seen ones first."""
        kept: list[int] = []
        for state in sorted(dict.fromkeys(map(self.at, states)), key=lambda k: (-self.seen(k), k)):
            twin = next((k for k in kept if self.alike(k, state)), None)
            if twin is None:
                kept.append(state)
            else:
                self.merge(twin, state)
        return kept

    def merge_positions(self) -> list[int]:
        """Merge states of different positions, unless they differ; the states that stay."""
        kept, border = [0], [(0, c) for c in sorted(self.next[0])]
        while border:
            child = self.to(*border[0])
            if child in kept:
                border = border[1:]
                continue
            twin = next((k for k in kept if self.alike(k, child)), None)
            if twin is None:
                kept.append(child)
            else:
                self.merge(twin, child)
                kept = list(dict.fromkeys(map(self.at, kept)))
            # Merging may have given any kept state new ways on.
            border = [(k, c) for k in kept for c in sorted(self.next[k]) if self.to(k, c) not in kept]
        return kept


def learn(runs: Sequence[str], sizes: Sequence[int] | None = None) -> Automaton:
    """The automaton of distinct labelled runs (at least one); ``sizes`` if they are only their starts.

    A state's likelihoods are its counts and ``BACKOFF`` more that are dealt as the characters of all
    runs are. Thresholds come from the runs' own scores, each without what it counts itself, so that they
    hold for runs that were not learnt. A state in which fewer than ``ENDS`` runs end takes the
    strictest one.
    """
    sizes = list(map(len, runs)) if sizes is None else list(sizes)
    starts = [run[:SAMPLE_CHARS] for run in runs]
    tree = _Tree(sorted(starts))
    tree.merge_layers()
    kept = tree.merge_positions()
    number = {state: n for n, state in enumerate(kept)}
    every = Counter(c for run in starts for c in run)
    mass = every.total() + UNSEEN * _ALPHABET
    share = {c: (k + UNSEEN) / mass for c, k in every.items()}

    def likelihood(state: int, c: str, less: int = 0) -> float:
        passed = tree.passed[state]
        odds = passed[c] - less + BACKOFF * share.get(c, UNSEEN / mass)
        return math.log(odds / (passed.total() - less + BACKOFF))

    def stop(state: int, less: int = 0) -> float:
        odds = (tree.ended[state] - less + UNSEEN) / (tree.seen(state) - less + 2 * UNSEEN)
        return math.log(odds)

    moves, onward, rare = [], [], []
    for state in kept:
        ways, passed = tree.next[state], tree.passed[state]
        usual = min(ways, key=lambda c: (-passed[c], c), default=None)
        go = number[tree.to(state, usual)] if usual else number[state]
        onward.append(go)
        moves.append(
            {c: (number[tree.to(state, c)] if c in ways else go, likelihood(state, c)) for c in sorted(share)}
        )
        rare.append(likelihood(state, ""))
    held = Counter(sizes)
    total = math.log(len(runs) + 1)
    lengths = {n: math.log(k) - total for n, k in held.items()}

    def without_itself(run: str, size: int) -> tuple[int, float]:
        state, score = 0, math.log(max(held[size] - 1, UNSEEN) / len(runs))
        for c in run:
            score += likelihood(kept[state], c, 1)
            state = moves[state][c][0]
        return state, (score + stop(kept[state], 1)) / (len(run) + 1)

    def threshold(scores: list[float]) -> float:
        return sorted(scores)[int(MISSED * len(scores))]

    ends: dict[int, list[float]] = {}
    for state, score in map(without_itself, starts, sizes):
        ends.setdefault(state, []).append(score)
    own = {state: threshold(scores) for state, scores in ends.items() if len(scores) >= ENDS}
    strictest = max([*own.values(), threshold(sum(ends.values(), []))])
    thresholds = [own.get(n, strictest) for n in range(len(kept))]
    stops = list(map(stop, kept))
    return Automaton(moves, onward, rare, stops, lengths, math.log(UNSEEN) - total, thresholds)


def recognise(automata: dict[str, Automaton], run: str) -> tuple[str, float] | None:
    """The kind that a run fits best and by how much, if it fits any."""
    fits = [
        (over, kind)
        for kind, a in automata.items()
        if len(run) <= a.longest and (over := a.margin(run)) is not None
    ]
    return (max(fits)[1], max(fits)[0]) if fits else None


def _learnt(automata: dict[str, Automaton], runs: Sequence[tuple[int, int, str]], known: dict) -> list[dict]:
    """The spans among ``runs``, without overlaps: by score, then the longer and the earlier one."""
    fits = []
    for start, end, run in runs:
        if run in known:
            fit = known[run]
        else:
            fit = recognise(automata, run)
            if len(run) <= _SCORED_CHARS and len(known) < _SCORES:
                known[run] = fit
        if fit:
            fits.append((-fit[1], start - end, start, end, run, fit))
    # Free of overlaps: a span's neighbours in order of start are the only ones that it can touch.
    chosen: list[tuple[int, int, dict]] = []
    for _, _, start, end, run, (kind, score) in sorted(fits):
        at = bisect(chosen, start, key=lambda c: c[0])
        if (at and chosen[at - 1][1] > start) or (at < len(chosen) and chosen[at][0] < end):
            continue
        span = dict(kind=f"like_{kind}", start=start, end=end, value=run, score=score)
        chosen.insert(at, (start, end, span))
    return [c[2] for c in chosen]


def _base(found: Sequence[tuple[int, int, int, str]]) -> list[dict]:
    names = list(KINDS)
    return [dict(kind=names[k], start=a, end=b, value=v) for a, k, b, v in found]


_SPAN = StructType().add("kind", "string").add("start", "long").add("end", "long").add("value", "string")


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"base": [_base(base_spans(text or "")) for text in batch["text"]]})


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct credentials that the patterns find: ``kind`` and ``value``."""
    found = docs.select(F.col(text).alias("text")).mapInPandas(
        _scan, StructType().add("base", ArrayType(_SPAN))
    )
    return stored(found.select(F.inline("base")).select("kind", "value").distinct(), "credentials")


def train(values: DataFrame, sample: int = SAMPLE) -> dict[str, Automaton]:
    """An automaton per kind from about ``sample`` of its distinct values, chosen by digest.

    Of a value the first ``SAMPLE_CHARS`` characters and the whole length are learnt.
    """
    counts = {r["kind"]: r["count"] for r in values.groupBy("kind").count().collect()}
    if not counts:
        return {}
    share = F.create_map(
        *[F.lit(v) for k, n in counts.items() for v in (k, int(min(1.0, sample / n) * 0xFFFFFFF))]
    )
    mark = F.conv(F.substring(F.md5("value"), 1, 7), 16, 10).cast("long")
    rows = (
        values.filter(mark <= share[F.col("kind")])
        .select("kind", F.substring("value", 1, SAMPLE_CHARS).alias("start"), F.length("value").alias("size"))
        .limit(2 * sample * len(counts))
        .collect()
    )
    by_kind: dict[str, set[tuple[str, int]]] = {}
    for row in rows:
        by_kind.setdefault(row["kind"], set()).add((row["start"], row["size"]))
    return {kind: learn(*zip(*sorted(runs), strict=True)) for kind, runs in sorted(by_kind.items())}


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, ``base`` and ``learnt``.

    Both are arrays of spans (``kind``, ``start``, ``end`` in code points, end exclusive,
    ``value``), in order of start and kind; ``learnt`` has the ``score`` above the threshold
    as well. Null texts are empty. Repeated rows and null keys have a row each. Without any
    base span in the table nothing can be learnt, and ``learnt`` is empty throughout.
    """
    automata = train(scan(docs, text))
    longest = max((a.longest for a in automata.values()), default=0)
    held = docs.sparkSession.sparkContext.broadcast(automata)
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).cast(key_kind(kind)).alias("key"), F.col(text).alias("text"))
    learnt = StructType([*_SPAN.fields]).add("score", "double")
    schema = rows.select("key").schema.add("base", ArrayType(_SPAN)).add("learnt", ArrayType(learnt))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for batch in batches:
            base, more = [], []
            for text in batch["text"]:
                found = base_spans(text or "")
                base.append(_base(found))
                runs = candidates(text or "", found, longest) if held.value else []
                more.append(_learnt(held.value, runs, known))
            yield pd.DataFrame({"key": batch["key"], "base": base, "learnt": more})

    return rows.mapInPandas(scored, schema).select(F.col("key").cast(kind).alias(key), "base", "learnt")
