"""Moved directories and what lies in them.

A move takes all that lives strictly below its source to the same places below its target. What
an event reported for a path at ``ord`` is therefore a thing that travels: from its place, the
earliest later cut above it decides. A delete ends it; a move takes it on, until no cut is left.
Things that share a place share all later moves, so of two things that end at one path the one
that came there later is told by comparing the orders of their moves, newest first, and then
their own order. That keeps the closed form: what has arrived is one more create at its path.

Only paths below some moved directory take part. Events are first combined per path and gap
between moves, so a path with very many events is few things; each round reads the things that
move once more, so there are as many rounds as moves of one thing within what is folded at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from pathlode.functions.paths import level_of, prefix_at, without_slash
from pathlode.operators.hierarchy import marks, with_mark
from pathlode.schema import META_FIELDS, ORDERS
from pathlode.session import fits_broadcast, measure, written

# Gaps are at least so many stretches of the order, and finer where there are more moves.
STRETCHES, MOVES_PER_STRETCH = 256, 16
# With fewer moved directories than this the state is read by ranges of paths only.
FEW_MOVES = 50

_PLACE = ["path", "ord"]


def gaps(steps: DataFrame, moves: DataFrame) -> DataFrame:
    """``steps`` with ``gap``: no move lies between steps of one gap.

    The order is cut into even stretches and these at their moves, so a step meets the moves of
    its stretch only. A move opens a gap: the delete of its source must not hide an earlier one.
    """
    ends = moves.agg(F.min("ord").alias("a"), F.max("ord").alias("b"), F.count(F.lit(1)).alias("n")).first()
    width = max((ends["b"] - ends["a"]) // max(STRETCHES, ends["n"] // MOVES_PER_STRETCH), 1)
    stretch = F.greatest(F.floor((F.col("ord") - ends["a"]) / width), F.lit(-1)).cast("bigint")
    cuts = moves.groupBy(stretch.alias("_stretch")).agg(F.collect_set("ord").alias("_cuts"))
    if fits_broadcast(ends["n"], 16 * ends["n"]):
        cuts = F.broadcast(cuts)
    placed = steps.withColumn("_stretch", stretch).join(cuts, "_stretch", "left")
    before = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("ord"))), F.lit(0))
    return placed.withColumn("gap", F.struct("_stretch", before.alias("nth"))).drop("_stretch", "_cuts")


def _below(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """Rows below a source that is moved later than some part of the row (``first``)."""
    marked = marks(moves, F.col("source"), F.col("ord"))
    return with_mark(rows, marked, "_moved").filter(F.col("_moved") > F.col("first")).drop("_moved")


def _near_sources(state: DataFrame, moves: DataFrame) -> DataFrame:
    """The state restricted to the ranges of few sources, which the scan then reads alone."""
    sources = [r["source"] for r in moves.select("source").distinct().limit(FEW_MOVES + 1).collect()]
    if len(sources) > FEW_MOVES:
        return state
    inside = F.lit(False)
    for source in sources:
        inside |= (F.col("path") > F.lit(f"{source}/")) & (F.col("path") < F.lit(f"{source}0"))
    return state.filter(inside)


def _things(epochs: DataFrame) -> DataFrame:
    """One row per reported part: its place, its order and its value."""
    orders = ORDERS.fieldNames()[:-1]
    parts = [
        F.struct(
            F.col(order).alias("ord"),
            F.lit(None if name == "is_dir" else name).alias("field"),
            F.col(name).cast("bigint").alias("value"),
        )
        for order, name in zip(orders, ("is_dir", *META_FIELDS), strict=True)
    ]
    return epochs.select("path", F.inline(F.array(*parts))).filter(F.col("ord").isNotNull())


def _next_cuts(places: DataFrame, cuts: DataFrame, few: bool) -> DataFrame:
    """``places`` with the earliest later move above them, and ``died`` where a delete is earlier.

    A place meets no list of cuts: per directory places and cuts are sorted by their order, from
    the last back, and each place sees the cut that came just before it in that sort.
    """
    loc = F.col("loc")
    above = places.select("*", F.explode(F.sequence(F.lit(1), level_of(loc))).alias("level"))
    above = above.withColumn("mark", prefix_at(loc, F.col("level"))).drop("level")
    # Directories that nothing cuts, such as the root, gather no places; one row of each stays.
    known = cuts.select("mark", F.lit(True).alias("cut")).distinct()
    met = above.join(F.broadcast(known) if few else known, "mark", "left")
    met = met.filter(F.col("cut") | (F.col("mark") == loc)).drop("cut").withColumn("at", F.col("since"))
    there = F.struct(F.col("at"), F.min("target").alias("target"), F.col("mark"))
    at_once = cuts.groupBy("mark", "at").agg(
        F.when(F.min("target").isNotNull(), there).alias("move"),
        F.when(F.count_if(F.col("target").isNull()) > 0, F.col("at")).alias("death"),
    )
    rows = met.unionByName(at_once, allowMissingColumns=True)
    # A cut at the very order of a place comes after it here: only later ones count.
    back = Window.partitionBy("mark").orderBy(F.desc("at"), F.col("since").isNull())
    back = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumns({c: F.last(c, ignorenulls=True).over(back) for c in ("move", "death")})
    first = seen.filter(F.col("since").isNotNull()).groupBy(*_PLACE).agg(
        *[F.any_value(c).alias(c) for c in ("loc", "since", "key")],
        F.min(F.when(F.col("mark") != loc, F.col("move"))).alias("move"),
        F.min("death").alias("died"),
    )
    ended = F.col("died") < F.coalesce("move.at", F.col("died") + 1)
    return first.withColumn("died", F.coalesce(ended, F.lit(False)))


def _arrivals(places: DataFrame, cuts: DataFrame, stays: Column) -> DataFrame:
    """``path``, ``ord`` of the things that moved, with their last ``loc`` and their ``key``.

    The key lists the orders of a thing's arrivals, the newest first, and its own order last.
    """
    few = fits_broadcast(*measure(cuts.select("mark").distinct(), "mark"))
    landed = []
    while True:
        seen = Observation()
        goes_on = ~F.col("died") & F.col("move").isNotNull()
        step = _next_cuts(places, cuts, few).observe(seen, F.count_if(goes_on).alias("n"))
        step = written(step, "places")
        landed.append(step.filter("NOT died AND move IS NULL AND size(key) > 1").select(*_PLACE, "loc", "key"))
        if not seen.get["n"]:
            return reduce(DataFrame.unionByName, landed)
        places = step.filter(goes_on).select(
            *_PLACE,
            F.concat("move.target", F.expr("substring(loc, length(move.mark) + 1)")).alias("loc"),
            (F.col("move.at") + 1).alias("since"),
            F.concat(F.array(F.col("move.at") + 1), "key").alias("key"),
        ).filter(stays)


def carried_contents(
    state: DataFrame, epochs: DataFrame, moves: DataFrame, stays: Column
) -> DataFrame:
    """What the moves have brought to its last place: one state row per path.

    ``epochs`` is the summary of the events per path and gap (with ``first``, the least order of
    its parts), ``moves`` a written table of ``ord``, ``source`` and ``target``; ``stays`` tells
    by ``loc`` whether a place is in the scope.
    """
    orders = ORDERS.fieldNames()
    first = F.least(*[F.coalesce(c, F.lit(2**62)) for c in orders[:-1]])
    near = _near_sources(state, moves).withColumn("first", first)
    rows = epochs.unionByName(near.select(*epochs.columns))
    things = written(_things(_below(rows, moves)), "things")
    deletes = epochs.select("path", "delete_ord").unionByName(state.select("path", "delete_ord"))
    cuts = written(
        deletes.filter("delete_ord IS NOT NULL")
        .select(F.col("path").alias("mark"), F.col("delete_ord").alias("at"), F.lit(None).cast("string").alias("target"))
        .unionByName(moves.select(F.col("source").alias("mark"), F.col("ord").alias("at"), "target")),
        "cuts",
    )
    places = things.select(*_PLACE).distinct().select(
        *_PLACE, F.col("path").alias("loc"), F.col("ord").alias("since"), F.array("ord").alias("key")
    )
    landed = _arrivals(places, cuts, stays)
    there = written(things.join(landed, _PLACE).select("loc", "key", "ord", "field", "value"), "arrived")
    # Arrays compare element by element, so the greatest key came last to the place.
    winner = there.filter("field IS NULL").groupBy(F.col("loc").alias("to")).agg(
        F.max(F.struct("key", "ord", "value")).alias("w")
    )
    own_moves = F.filter("w.key", lambda m: m > F.col("ord"))
    same = (F.col("ord") >= F.col("w.ord")) & (F.slice("key", F.lit(1), F.size("key") - 1) == own_moves)
    reports = there.filter("field IS NOT NULL").join(winner, F.col("loc") == F.col("to")).filter(same)
    last = reports.groupBy("loc").agg(
        *[
            F.max_by("value", F.when(F.col("field") == f, F.col("ord"))).alias(f)
            for f in META_FIELDS
        ]
    )
    arrived = F.get("w.key", F.lit(0))
    return (
        winner.join(last, F.col("to") == F.col("loc"), "left")
        .select(
            F.col("to").alias("path"),
            F.col("w.value").cast("boolean").alias("is_dir"),
            *[F.coalesce(f, F.lit(0)).cast("bigint").alias(f) for f in META_FIELDS],
            *[(F.lit(None).cast("bigint") if c == "delete_ord" else arrived).alias(c) for c in orders],
        )
    )


def moved_directories(moves: DataFrame, in_scope) -> DataFrame:
    """``ord``, ``source``, ``target`` of the moves that take contents along.

    Those are the moves whose event does not say that they are of a file, from one place in the
    scope to another; what leaves the scope is deleted.
    """
    columns = ["is_dir", *META_FIELDS]
    out = moves.filter((F.col("kind") == "move") & F.coalesce("is_dir", F.lit(True))).select(
        (F.col("seq") * 2).alias("ord"), F.lit("delete").alias("kind"), "path", "to_path", *columns
    )
    source = in_scope(out).withColumns(
        {"kind": F.lit("create"), "source": without_slash(F.col("path")), "path": F.col("to_path")}
    )
    return in_scope(source).select("ord", "source", without_slash(F.col("path")).alias("target"))
