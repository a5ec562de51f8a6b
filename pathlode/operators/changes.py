"""Folding change events into the catalogue.

The result of a sequence of events has a closed form, so no event is replayed.
With a total order ``ord`` on the events (the catalogue itself counts as
creates before all of them):

* a path is alive when its last create is later than the last delete of the
  path or of any directory above it;
* its kind is that of its last create;
* each metadata field is the last one reported by a create or a modify.

All parts are maxima, so they pre-aggregate, merge, and do not depend on the
order of arrival. A state table holds them per path, with the order of each
part; it also has the paths that are not alive but may matter to late events.
What a moved directory takes along enters as creates below its new place, see
:mod:`pathlode.operators.moves`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlode.functions.paths import without_slash
from pathlode.operators.excludes import Excludes, in_hidden_directory
from pathlode.operators.hierarchy import far_marks, marks, near_marks, under_any, with_mark
from pathlode.operators.moves import carried_contents, gaps, moved_directories
from pathlode.schema import CHANGE, ENTRY_FIELDS, META_FIELDS
from pathlode.session import fits_broadcast, measure, written

BASE_ORD = -1
KINDS = ("create", "delete", "modify", "move", "overflow")
ORD_FIELDS = ["create_ord", *(f"{f}_ord" for f in META_FIELDS), "delete_ord"]
STATE_FIELDS = [*ENTRY_FIELDS, *ORD_FIELDS]


def as_changes(events: DataFrame) -> DataFrame:
    """The event layout, with null for the columns a source does not have."""
    columns = [
        (F.col(f.name) if f.name in events.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in CHANGE.fields
    ]
    return events.select(*columns)


def split_moves(events: DataFrame) -> DataFrame:
    """A move becomes a delete of its source and a create of its target.

    ``ord`` is twice ``seq``, so that the two halves keep their order.
    """
    events = as_changes(events)
    rest = [F.col(c) for c in ("is_dir", *META_FIELDS)]
    ord_ = F.coalesce("seq", F.raise_error(F.lit("an event has no seq"))) * 2

    def step(order: Column, kind: Column, path: Column) -> Column:
        return F.struct(order.alias("ord"), kind.alias("kind"), path.alias("path"), *rest)

    steps = F.when(
        F.col("kind") == "move",
        F.array(
            step(ord_, F.lit("delete"), F.col("path")),
            step(ord_ + 1, F.lit("create"), F.col("to_path")),
        ),
    ).otherwise(F.array(step(ord_, F.col("kind"), F.col("path"))))
    return events.select(F.inline(steps))


@dataclass(frozen=True)
class Scope:
    """Which events count: at or under a root, outside the tool's own folders.

    With ``excludes`` the ingest rules hold for created paths too.
    """

    roots: tuple[str, ...] = ()
    own_folders: tuple[str, ...] = ()
    excludes: Excludes | None = None


EVERYWHERE = Scope()


def in_scope(steps: DataFrame, scope: Scope = EVERYWHERE) -> DataFrame:
    """Steps within the scope and outside hidden directories.

    The steps are those of :func:`split_moves`: both halves of a move are tested.
    """
    path = F.col("path")
    creates_dir = (F.col("kind") == "create") & F.coalesce(F.col("is_dir"), F.lit(False))
    name_hidden = F.substring_index(path, "/", -1).rlike(r"^\..")
    keep = under_any(path, scope.roots) & ~in_hidden_directory(path)
    keep &= ~(creates_dir & name_hidden)
    if scope.own_folders:
        keep &= ~under_any(path, scope.own_folders)
    if scope.excludes is not None:
        steps = steps.withColumn("is_dir", F.coalesce("is_dir", F.lit(False)))
        keep &= (F.col("kind") != "create") | scope.excludes.keep(scope.roots)
    return steps.filter(keep)


def events_in_scope(events: DataFrame, scope: Scope = EVERYWHERE) -> DataFrame:
    """Events of which some step is in the scope; overflows concern every scope."""
    lost = events.filter(F.col("kind") == "overflow")
    rest = events.filter(F.col("kind") != "overflow")
    if scope == EVERYWHERE:
        return events
    steps = in_scope(split_moves(rest), scope)
    known = steps.select((F.col("ord") - F.col("ord") % 2).alias("ord")).distinct()
    kept = rest.join(known, F.col("seq") * 2 == F.col("ord"), "left_semi")
    return kept.unionByName(lost)


def latest_by_path(rows: DataFrame, *order: Column) -> DataFrame:
    """One row per path, the last one in the given order (the order must be total).

    Both forms combine before the shuffle, so a path with a third of all rows
    costs one row per task.  A single order column needs no structs, which makes
    it a hash aggregate when the other columns have a fixed width.
    """
    payload = [c for c in rows.columns if c != "path"]
    by_path = rows.groupBy("path")
    if len(order) == 1:
        return by_path.agg(*[F.max_by(c, order[0]).alias(c) for c in payload])
    keys = [o.alias(f"_{i}") for i, o in enumerate(order)]
    last = F.max(F.struct(*keys, F.struct(*payload).alias("row"))).alias("last")
    return by_path.agg(last).select("path", "last.row.*")


def summarise(steps: DataFrame, *more: str) -> DataFrame:
    """The state of the paths that the steps name, in one pass; ``more`` columns part it further.

    All buffers but the path are fixed-width, so this is a hash aggregate with
    map-side combine: a path that holds a third of all events costs one row per task.
    """
    is_create, is_delete = F.col("kind") == "create", F.col("kind") == "delete"
    known = steps.filter(F.col("kind").isin("create", "modify", "delete")).withColumns(
        # A create without metadata resets it; a modify without it keeps the old value.
        {
            f: F.when(is_create, F.coalesce(f, F.lit(0))).when(~is_delete, F.col(f))
            for f in META_FIELDS
        }
        | {
            "is_dir": F.coalesce("is_dir", F.lit(False)),
            "path": F.when(is_delete, without_slash(F.col("path"))).otherwise(F.col("path")),
        }
    )
    created = F.when(is_create, F.col("ord"))
    reported = {f: F.when(F.col(f).isNotNull(), F.col("ord")) for f in META_FIELDS}
    return (
        known.groupBy("path", *more)
        .agg(
            F.max_by("is_dir", created).alias("is_dir"),
            *[F.max_by(f, ord_).alias(f) for f, ord_ in reported.items()],
            F.max(created).alias("create_ord"),
            *[F.max(ord_).alias(f"{f}_ord") for f, ord_ in reported.items()],
            F.max(F.when(is_delete, F.col("ord"))).alias("delete_ord"),
        )
        .select(*STATE_FIELDS, *more)
    )


def state_of(entries: DataFrame) -> DataFrame:
    """A catalogue as the state before all events; one that has the orders keeps them."""
    orders = [
        F.col(c) if c in entries.columns else F.lit(None if c == "delete_ord" else BASE_ORD)
        for c in ORD_FIELDS
    ]
    named = [o.cast("bigint").alias(c) for o, c in zip(orders, ORD_FIELDS)]
    return entries.select(*ENTRY_FIELDS, *named)


_ORDER_OF = {"is_dir": "create_ord"} | {f: f"{f}_ord" for f in META_FIELDS}


def _carried(state: DataFrame) -> list[str]:
    """Columns beside the state, such as where a row is stored; new paths have null there."""
    return [c for c in state.columns if c not in STATE_FIELDS]


def _merged_by_broadcast(state: DataFrame, news: DataFrame, ghosts: bool) -> DataFrame:
    """The state is read and updated without being shuffled."""
    carried = _carried(state)

    def later(part: str) -> Column:
        order = _ORDER_OF.get(part, part)
        newer = F.coalesce(F.col(f"_{order}") > F.col(order), F.col(f"_{order}").isNotNull())
        return F.when(newer, F.col(f"_{part}")).otherwise(F.col(part)).alias(part)

    named = news.select("path", *[F.col(c).alias(f"_{c}") for c in STATE_FIELDS[1:]])
    updated = state.join(F.broadcast(named), "path", "left")
    updated = updated.select("path", *map(later, STATE_FIELDS[1:]), *carried)
    known = state.select("path").join(F.broadcast(news.select("path")), "path", "left_semi")
    fresh = news if ghosts else news.filter(F.col("create_ord").isNotNull())
    added = fresh.join(known, "path", "left_anti").select(*STATE_FIELDS)
    return updated.unionByName(added, allowMissingColumns=True)


def _merged_by_path(state: DataFrame, news: DataFrame, kills: DataFrame | None) -> DataFrame:
    """One aggregate by path over both states and the deletes above each path."""
    carried = _carried(state)
    rows = state.unionByName(news.select(*STATE_FIELDS), allowMissingColumns=True)
    if kills is not None:
        nothing = {c: F.lit(None) for c in [*STATE_FIELDS[1:], *carried]}
        above = kills.select("path", F.col("value").alias("_kill")).withColumns(nothing)
        rows = rows.withColumn("_kill", F.lit(None).cast("bigint")).unionByName(above)
    else:
        rows = rows.withColumn("_kill", F.lit(None).cast("bigint"))
    return rows.groupBy("path").agg(
        *[F.max_by(part, order).alias(part) for part, order in _ORDER_OF.items()],
        *[F.max(order).alias(order) for order in ORD_FIELDS],
        F.max("_kill").alias("_kill"),
        *[F.max(c).alias(c) for c in carried],
    )


def news_of(state: DataFrame, events: DataFrame, scope: Scope = EVERYWHERE) -> DataFrame:
    """The written state that the events alone give, with what moved directories took along.

    From ``state`` come the rows below moved directories, and nothing without such moves.
    """
    events = as_changes(events)
    steps = in_scope(split_moves(events), scope)
    news = written(summarise(steps), "summary")
    moves = written(moved_directories(events, lambda m: in_scope(m, scope)), "moved")
    if moves.isEmpty():
        return news
    epochs = summarise(gaps(steps, moves), "gap").drop("gap")
    orders = [F.coalesce(c, F.lit(2**62)) for c in ORD_FIELDS[:-1]]
    epochs = written(epochs.withColumn("first", F.least(*orders)), "epochs")
    arrived = carried_contents(state, epochs, moves, _stays(scope))
    both = _merged_by_path(news, arrived, None).select(*STATE_FIELDS)
    return written(both, "summary")


def _stays(scope: Scope) -> Column:
    """Whether a place in ``loc`` is one where contents of directories are kept."""
    loc = F.col("loc")
    keep = under_any(loc, scope.roots) & ~in_hidden_directory(loc)
    return keep & ~under_any(loc, scope.own_folders) if scope.own_folders else keep


def fold_news(
    state: DataFrame,
    news: DataFrame,
    deletes: DataFrame,
    broadcast: bool | None = None,
    ghosts: bool = True,
) -> DataFrame:
    """The state after written news, with ``alive``; ``deletes`` are the older ones that count."""
    marked = [
        df.filter(F.col("delete_ord").isNotNull()).select("path", "delete_ord") for df in (deletes, news)
    ]
    killed = marks(marked[0].union(marked[1]), F.col("path"), F.col("delete_ord"))
    if broadcast is not False and fits_broadcast(*measure(news, "path")):
        paths = state.select("path").union(news.select("path"))
        merged = with_mark(_merged_by_broadcast(state, news, ghosts), killed, "_kill", broadcast, paths)
    else:
        shallow = killed.shallow(broadcast)
        deep = [level for level in killed.levels if level not in shallow]
        paths = state.select("path").union(news.select("path"))
        kills = far_marks(paths, killed, deep) if deep else None
        merged = near_marks(_merged_by_path(state, news, kills), killed, shallow, "_near")
        merged = merged.withColumn("_kill", F.greatest("_kill", "_near")).drop("_near")
    lives = F.col("create_ord") > F.coalesce("_kill", F.lit(BASE_ORD - 1))
    alive = F.coalesce(lives, F.lit(False)).alias("alive")
    return merged.select(*STATE_FIELDS, *_carried(state), alive)


def fold_state(
    state: DataFrame,
    events: DataFrame,
    scope: Scope = EVERYWHERE,
    broadcast: bool | None = None,
    ghosts: bool = True,
) -> DataFrame:
    """The state after the events, with ``alive``; the later report of each part counts.

    Further columns of ``state`` stay with its rows, and are null for new paths. Measured-small news are broadcast (never with ``broadcast=False``). Others meet the
    state in one aggregate by path, together with the deletes above each path that
    are too many to broadcast. Without ``ghosts`` paths never created may be left out.
    """
    return fold_news(state, news_of(state, events, scope), state, broadcast, ghosts)


def apply_changes(
    entries: DataFrame,
    events: DataFrame,
    scope: Scope = EVERYWHERE,
    broadcast: bool | None = None,
) -> DataFrame:
    """The catalogue after the events (see :func:`fold_state` for ``broadcast``)."""
    folded = fold_state(state_of(entries), events, scope, broadcast, ghosts=False)
    return folded.filter("alive").select(*ENTRY_FIELDS)
