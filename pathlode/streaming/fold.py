"""Keeping a saved catalogue current from a stream of change events.

A micro-batch costs as much as its events: they are appended to a log, and
readers fold the log into the saved version (a broadcast merge while the log is
small).  The log is folded into a new version only now and then, and only buckets
that an event concerns are written again, so no batch rewrites the catalogue.

Events take effect in the order of ``seq``, in whatever batches they arrive and
whenever the log is folded: a version keeps the order of every part of its state,
and the paths that are not alive. Events from before a directory move that is folded
already are replayed from the version before it (its ``base``). ``keep_past`` bounds
for how long; events that come later still, and events that cannot be read, are put
aside, counted, and treated like events that were lost.

A listing counts as all events up to its ``known_seq``: later arrivals of these change
nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pathlode.functions.paths import with_parts
from pathlode.operators.changes import (
    EVERYWHERE,
    KINDS,
    ORD_FIELDS,
    STATE_FIELDS,
    Scope,
    as_changes,
    fold_news,
    fold_state,
    in_scope,
    news_of,
    split_moves,
)
from pathlode.operators.hierarchy import under
from pathlode.plans.search import RESULT_COLUMNS, search
from pathlode.schema import CHANGE, ENTRY_FIELDS
from pathlode.session import folders_in, remove_folder, removed_after, written
from pathlode.sources.catalogue import (
    PLACE,
    SaveStats,
    bucket_of,
    latest_version,
    log_of,
    place_of,
    read_state,
    read_version,
    save_buckets,
    save_catalogue,
    version_row,
    versions,
)

# Sequence numbers of one folder of folded events.
BLOCK = 1_000_000
# A bucket that has grown to so many times the mean (and to so many rows) has the ranges cut anew.
GROWN, GROWN_ROWS = 4, 1_000_000
# Answers of a standing search that are kept, and batches after which its matches are written whole.
KEPT_ANSWERS, WHOLE_EVERY = 100, 20

_LOGGED = T.StructType(
    [T.StructField(f.name, f.dataType) for f in CHANGE.fields]
    + [T.StructField("version", T.LongType()), T.StructField("batch", T.LongType())]
)


def _read_or_none(spark: SparkSession, schema: T.StructType, location: str) -> DataFrame:
    """The table there; without rows when nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(location)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _read_log(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """The events logged for one version, with their ``version`` and ``batch``."""
    schema = T.StructType([f for f in _LOGGED.fields if f.name != "version"])
    log = _read_or_none(spark, schema, log_of(folder, version))
    return log.withColumn("version", F.lit(version).cast("bigint")).select(*_LOGGED.fieldNames())


def _log_since(spark: SparkSession, folder: str, version: int, seq: int | None = None) -> DataFrame:
    """Events logged for this version and later ones; with ``seq`` only later events.

    Old logs lie in blocks of ``seq``, of which only those from ``seq`` on are read.
    """
    logs = [int(f.removeprefix("version=")) for f in folders_in(spark, f"{folder}/log")]
    blocks = T.StructType([*_LOGGED.fields, T.StructField("block", T.LongType())])
    # A log that is filed and not yet removed is in both places.
    events = _read_or_none(spark, blocks, f"{folder}/history").filter(
        (F.col("version") >= version) & ~F.col("version").isin([-1, *logs])
    )
    if seq is not None:
        events = events.filter((F.col("block") >= (seq + 1) // BLOCK) & (F.col("seq") > seq))
    events = events.drop("block")
    for k in logs:
        if k >= version:
            log = _read_log(spark, folder, k)
            events = events.unionByName(log if seq is None else log.filter(F.col("seq") > seq))
    return events


def start_catalogue(entries: DataFrame, folder: str) -> SaveStats:
    """Save the first version, the base of the log."""
    return save_catalogue(entries, folder, reason="start")


def logged_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events since the latest version."""
    version = latest_version(spark, folder)
    return _read_or_none(spark, CHANGE, log_of(folder, version["version"])).select(*CHANGE.fieldNames())


def events_after(spark: SparkSession, folder: str, seq: int) -> DataFrame:
    """All kept events with a later ``seq``, each once, whatever version they were logged for."""
    pruned = latest_version(spark, folder)["pruned_seq"]
    if pruned is not None and seq < pruned:
        raise ValueError(f"events up to {pruned} are no longer kept")
    return _log_since(spark, folder, 0, seq).select(*CHANGE.fieldNames()).distinct()


def _unknown(events: DataFrame, version: Row) -> DataFrame:
    """Events that the version's listing does not know already."""
    events = events.select(*CHANGE.fieldNames())
    known = version["known_seq"]
    return events if known is None else events.filter(F.col("seq") > known)


# Whether an event moves a directory with its contents.
_TAKES_CONTENTS = "kind = 'move' AND coalesce(is_dir, true)"


def _to_fold(spark: SparkSession, folder: str, version: Row) -> tuple[Row, DataFrame] | None:
    """The version and the events whose fold is the current state; none without events.

    That is the latest version and its log, unless an event is older than a move of a directory
    that the version has folded, or is itself such a move and older than anything folded. The
    version kept of each path only what came last, so these are replayed from its base.
    """
    events = _unknown(_read_or_none(spark, CHANGE, log_of(folder, version["version"])), version)
    first, move = events.agg(F.min("seq"), F.min(F.when(F.expr(_TAKES_CONTENTS), F.col("seq")))).first()
    if first is None:
        return None
    through, moved = version["through_seq"], version["moved_seq"]
    late_move = move is not None and through is not None and move <= through
    if late_move or (moved is not None and first <= moved):
        base = version_row(spark, folder, version["base"])
        return base, _unknown(_log_since(spark, folder, version["base"]).distinct(), version)
    return version, events


def _folded(spark: SparkSession, fold: tuple[Row, DataFrame], scope: Scope) -> DataFrame:
    state = read_state(spark, fold[0])
    return fold_news(state, news_of(state, fold[1], scope), _older_deletes(state, *fold))


def current_state(spark: SparkSession, folder: str, scope: Scope = EVERYWHERE) -> DataFrame:
    """The state of all paths, with ``alive``, and where the rows of the version are stored."""
    version = latest_version(spark, folder)
    fold = _to_fold(spark, folder, version)
    return read_state(spark, version, flagged=True) if fold is None else _folded(spark, fold, scope)


def current_catalogue(spark: SparkSession, folder: str, scope: Scope = EVERYWHERE) -> DataFrame:
    """The latest version with the events logged since folded in.

    Entries keep the place they are stored in, so a search through grams still reads
    only the buckets of candidates, and beside them the paths that are new in the log.
    """
    version = latest_version(spark, folder)
    fold = _to_fold(spark, folder, version)
    if fold is None:
        return read_version(spark, version)
    entries = _folded(spark, fold, scope).filter("alive").select(*ENTRY_FIELDS, *PLACE.fieldNames())
    return with_parts(entries).withColumn("version", F.lit(version["version"]))


def _touched_buckets(news: DataFrame, buckets: list) -> list[int]:
    """The buckets with a path that the news name, or with paths below one that they delete."""
    path = F.col("path")
    at = lambda p: place_of(p, buckets)
    below = F.sequence(at(F.concat(path, F.lit("/"))), at(F.concat(path, F.lit("0"))))
    below = F.when(F.col("delete_ord").isNotNull(), below).otherwise(F.array().cast("array<int>"))
    touched = F.explode(F.array_distinct(F.concat(F.array(at(path)), below)))
    # At most one row per bucket.
    places = [r["k"] for r in news.select(touched.alias("k")).distinct().collect()]
    ordered = sorted(buckets, key=lambda b: b["first"])
    return sorted(ordered[k]["bucket"] for k in places)


def _file_old_logs(spark: SparkSession, folder: str, version: int) -> None:
    """File the logs of older versions by blocks of ``seq``, and remove those no reader needs.

    Only logs that nobody writes any more are filed; the newest of them stays where it is, for
    readers that have just begun.
    """
    logs = {int(f.removeprefix("version=")) for f in folders_in(spark, f"{folder}/log")}
    filed = {int(f.removeprefix("version=")) for f in folders_in(spark, f"{folder}/filed")}
    for k in sorted(v for v in logs if v < version):
        if k not in filed:
            log = _read_log(spark, folder, k)
            blocks = log.withColumn("block", F.floor(F.col("seq") / BLOCK).cast("bigint"))
            blocks = blocks.repartition("block").sortWithinPartitions("block", "seq")
            blocks.write.mode("append").partitionBy("block").parquet(f"{folder}/history")
            log.limit(0).write.mode("overwrite").parquet(f"{folder}/filed/version={k}")
        if k < version - 1:
            remove_folder(spark, log_of(folder, k))
            remove_folder(spark, f"{folder}/filed/version={k}")


def _prune_history(spark: SparkSession, folder: str, seq: int) -> int | None:
    """Remove the blocks that hold no event after ``seq``; up to which ``seq`` they are gone."""
    gone = None
    for name in folders_in(spark, f"{folder}/history"):
        if name.startswith("block=") and (int(name.removeprefix("block=")) + 1) * BLOCK - 1 <= seq:
            remove_folder(spark, f"{folder}/history/{name}")
            gone = max(gone or 0, (int(name.removeprefix("block=")) + 1) * BLOCK - 1)
    return gone


def compact(
    spark: SparkSession,
    folder: str,
    through_batch: int,
    scope: Scope = EVERYWHERE,
    keep_past: int | None = None,
) -> SaveStats:
    """Fold the log into a new version, which writes only the buckets that it changes.

    With ``keep_past`` the version forgets what happened more than that many
    ``seq`` ago to paths that are not alive; events as old are refused from then on, and
    blocks of them are removed as soon as no move needs them.
    """
    version = latest_version(spark, folder)
    _file_old_logs(spark, folder, version["version"])
    seen = _counted(_read_log(spark, folder, version["version"]), version)
    known = {c: version[c] for c in ("floor_seq", "known_seq", "base", "pruned_seq")}
    known["through_seq"] = _latest(version["through_seq"], seen["seq"])
    known["moved_seq"] = _latest(version["moved_seq"], seen["moved"])
    known |= _totals(version, seen)
    if keep_past is not None and seen["seq"] is not None:
        known["floor_seq"] = _latest(seen["seq"] - keep_past, version["floor_seq"] or -1)
    floor = known["floor_seq"]
    if known["moved_seq"] is not None and floor is not None and known["moved_seq"] <= floor:
        known["moved_seq"] = None
    if known["moved_seq"] is None:
        known["base"] = version["version"] + 1
    if floor is not None and known["moved_seq"] is None:
        known["pruned_seq"] = _latest(version["pruned_seq"], _prune_history(spark, folder, floor))
    fold = _to_fold(spark, folder, version)
    if fold is None:
        nothing = read_state(spark, version, (), flagged=True)
        return save_buckets(nothing, folder, version, (), through_batch, "compact", **known)
    whole = read_state(spark, fold[0])
    news = news_of(whole, fold[1], scope)
    ranged = all(b["first"] is not None for b in version["buckets"]) and version["entries"]
    touched = _touched_buckets(news, version["buckets"]) if fold[0] == version and ranged else None
    part = whole if touched is None else read_state(spark, version, touched)
    state = written(fold_news(part, news, _older_deletes(whole, *fold)), "state")
    kept = state if floor is None else state.filter(F.col("alive") | (F.greatest(*ORD_FIELDS) > 2 * floor + 1))
    mean = max(version["entries"] / max(len(version["buckets"]), 1), GROWN_ROWS / GROWN)
    # Paths that are alive again keep their last delete beside their entry.
    if touched is not None and _largest(kept, version["buckets"]) <= GROWN * mean:
        return save_buckets(kept, folder, version, touched, through_batch, "compact", **known)
    if touched is not None:
        others = [b["bucket"] for b in version["buckets"] if b["bucket"] not in touched]
        kept = kept.unionByName(read_state(spark, version, others, flagged=True))
    past = kept.filter("NOT alive").select(*STATE_FIELDS)
    base = known.pop("base")
    return save_catalogue(
        kept.filter("alive").select(*STATE_FIELDS), folder, through_batch, "compact", past=past, base=base, **known
    )


def _latest(*values):
    return max((v for v in values if v is not None), default=None)


def _counted(log: DataFrame, version: Row) -> Row:
    """What a log says in one row; carried events were counted for an earlier version."""
    own, known = F.col("batch") > version["through_batch"], version["known_seq"]
    moves = F.expr(_TAKES_CONTENTS) & (F.lit(True) if known is None else F.col("seq") > known)
    return log.agg(
        F.max("seq").alias("seq"),
        F.max(F.when(moves, F.col("seq"))).alias("moved"),
        F.count_if(own).alias("events"),
        F.count_if(own & (F.col("kind") == "overflow")).alias("overflows"),
        F.max("ts").alias("ts"),
        F.max("batch").alias("batch"),
    ).first()


def _totals(version: Row, seen: Row) -> dict:
    """The counts of all events up to the end of a version's log."""
    return {
        "events": (version["events"] or 0) + seen["events"],
        "overflows": (version["overflows"] or 0) + seen["overflows"],
        "last_ts": _latest(version["last_ts"], seen["ts"]),
    }


def _older_deletes(state: DataFrame, version: Row, events: DataFrame) -> DataFrame:
    """Deletes of the state that count for the events: none, when all events are later."""
    first = events.agg(F.min("seq")).first()[0]
    if version["through_seq"] is None or first is None or first > version["through_seq"]:
        return state.filter("false")
    return state


def _largest(state: DataFrame, buckets: list) -> int:
    """Rows of the largest bucket that is to be written."""
    counts = state.groupBy(bucket_of(F.col("path"), buckets).alias("b")).count()
    return counts.agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


def save_listing(
    spark: SparkSession,
    folder: str,
    listing: DataFrame,
    through_batch: int,
    reason: str,
    as_of_seq: int | None,
    complete: bool = True,
    scope: Scope = EVERYWHERE,
) -> SaveStats:
    """Save entries as they were after the events up to ``as_of_seq``; later events stay logged.

    The entries count as created right after that event, so older events that arrive later
    change nothing. Where the listing is not ``complete`` that holds for what it lists; of other
    paths the state stays, and older events about them still count.
    """
    last = latest_version(spark, folder)
    if last is None:
        return save_catalogue(listing, folder, through_batch, reason)
    _file_old_logs(spark, folder, last["version"])
    log = _read_log(spark, folder, last["version"])
    seen = _counted(log, last)
    counts = _totals(last, seen) | {"pruned_seq": last["pruned_seq"]}
    if as_of_seq is None and complete:
        return save_catalogue(listing, folder, through_batch, reason, **counts)
    as_of = -1 if as_of_seq is None else as_of_seq
    floor = last["floor_seq"] if (last["floor_seq"] or -1) > as_of else None
    order = max(2 * as_of + 1, -1)
    listed = listing.select(*ENTRY_FIELDS).withColumns(
        {c: F.lit(None if c == "delete_ord" else order).cast("bigint") for c in ORD_FIELDS}
    )
    if complete:
        later = written(events_after(spark, folder, as_of_seq).filter("kind <> 'overflow'"), "carried")
        return save_catalogue(
            listed, folder, through_batch, reason, carry=later, floor_seq=floor,
            known_seq=as_of_seq, through_seq=as_of_seq, **counts,
        )
    state = current_state(spark, folder, scope).select(*STATE_FIELDS)
    both = written(fold_news(state, written(listed, "listed"), state), "state")
    return save_catalogue(
        both.filter("alive").select(*STATE_FIELDS),
        folder,
        through_batch,
        reason,
        past=both.filter("NOT alive").select(*STATE_FIELDS),
        # What was moved before cannot be replayed from here, so older events are refused.
        floor_seq=_latest(last["floor_seq"], last["moved_seq"], seen["moved"]),
        known_seq=last["known_seq"],
        through_seq=_latest(as_of_seq, last["through_seq"], seen["seq"]),
        **counts,
    )


def refused(spark: SparkSession, folder: str) -> DataFrame:
    """Events put aside, with the ``reason`` and the ``batch``."""
    return _read_or_none(spark, _REFUSED, f"{folder}/refused")


_REFUSED = T.StructType(
    [
        T.StructField("reason", T.StringType()),
        *[T.StructField(f.name, f.dataType) for f in CHANGE.fields],
        T.StructField("batch", T.LongType()),
    ]
)
_REFUSED_COLUMNS = [f.name for f in _REFUSED.fields if f.name != "batch"]


def _why_refused(floor: int | None) -> Column:
    late = F.lit(False) if floor is None else F.col("seq") <= floor
    return (
        F.when(F.col("seq").isNull(), "no seq")
        .when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown kind")
        .when(F.col("path").isNull() & (F.col("kind") != "overflow"), "no path")
        .when((F.col("kind") == "move") & F.col("to_path").isNull(), "no path")
        .when(late, "too late")
    )


def entry_count(spark: SparkSession, folder: str, scope: Scope = EVERYWHERE) -> int:
    """The entries of the current catalogue; of the version only buckets that the log concerns are read."""
    version = latest_version(spark, folder)
    fold = _to_fold(spark, folder, version)
    if fold is None:
        return version["entries"]
    if fold[0] != version or not version["entries"] or any(b["first"] is None for b in version["buckets"]):
        return current_catalogue(spark, folder, scope).count()
    whole = read_state(spark, version)
    news = news_of(whole, fold[1], scope)
    touched = _touched_buckets(news, version["buckets"])
    state = fold_news(read_state(spark, version, touched), news, _older_deletes(whole, *fold))
    others = sum(b["entries"] for b in version["buckets"] if b["bucket"] not in touched)
    return others + state.filter("alive").count()


def current_status(spark: SparkSession, folder: str, scope: Scope = EVERYWHERE) -> DataFrame:
    """The status row of the catalogue and its feed, with the last build time.

    Healthy means that the last batch held no overflow, and that nothing of it was refused.
    Events that were folded are counted in the version's row, so only its own log is read.
    """
    version = latest_version(spark, folder)
    log = _read_log(spark, folder, version["version"])
    seen = _counted(log, version)
    total, batch = _totals(version, seen), _latest(seen["batch"], version["through_batch"])
    lost = version["reason"] == "overflow" and batch == version["through_batch"]
    lost |= not log.filter((F.col("kind") == "overflow") & (F.col("batch") == batch)).isEmpty()
    aside = not refused(spark, folder).filter(F.col("batch") == max(batch, 0)).isEmpty()
    entries = F.lit(entry_count(spark, folder, scope)).cast("bigint")
    return spark.range(1).select(
        entries.alias("entry_count"),
        F.format_string("Indexed %d entries", entries).alias("message"),
        F.lit(total["events"]).cast("bigint").alias("event_count"),
        F.lit(total["overflows"]).cast("bigint").alias("overflow_count"),
        F.lit(0).cast("bigint").alias("watch_failure_count"),
        F.lit(not lost and not aside).alias("healthy"),
        F.coalesce(F.unix_timestamp(F.lit(total["last_ts"]).cast("timestamp")), F.lit(0)).alias("last_updated"),
        F.lit(version["millis"]).alias("build_millis"),
    )


def _base_of(spark: SparkSession, folder: str) -> int:
    """The last version that came from elsewhere than the log."""
    rows = versions(spark, folder).filter("reason <> 'compact'")
    return rows.agg(F.max("version")).first()[0]


# --- Standing searches -------------------------------------------------------


def _parts(spark: SparkSession, location: str, kind: str) -> list[int]:
    names = folders_in(spark, location)
    return sorted(int(n.removeprefix(f"{kind}=")) for n in names if n.startswith(f"{kind}="))


def _matches_before(spark: SparkSession, location: str, batch_id: int) -> DataFrame | None:
    """The matches after the batch before, from the last whole set and the changes since.

    None if a batch is missing. A set that has this batch already serves as well, as the paths
    of the batch are looked at again.
    """
    whole = max((k for k in _parts(spark, location, "whole") if k <= batch_id), default=None)
    if whole is None:
        return None
    since = [k for k in _parts(spark, location, "delta") if whole < k < batch_id]
    if len(since) != max(batch_id - 1 - whole, 0):
        return None
    found = spark.read.parquet(f"{location}/whole={whole}")
    if not since:
        return found
    columns = [c for c in found.columns if c != "path"]
    changes = spark.read.option("basePath", location).parquet(*[f"{location}/delta={k}" for k in since])
    last = changes.groupBy("path").agg(F.max_by(F.struct("matched", *columns), "delta").alias("row"))
    kept = last.filter("row.matched").select("path", *[F.col(f"row.{c}").alias(c) for c in columns])
    return found.join(last, "path", "left_anti").unionByName(kept)


def _moved_late(spark: SparkSession, folder: str, batch: DataFrame) -> bool:
    """Whether a directory move may carry what the batch reports, or is in the batch itself."""
    version = latest_version(spark, folder)
    first = batch.agg(F.min("seq")).first()[0]
    if first is None:
        return False
    log = _read_log(spark, folder, version["version"])
    moved = _latest(version["moved_seq"], log.agg(F.max(F.when(F.expr(_TAKES_CONTENTS), F.col("seq")))).first()[0])
    return moved is not None and moved >= first


def _touched(batch: DataFrame, matches: Iterable[DataFrame], scope: Scope) -> DataFrame:
    """Paths that a batch names, and kept matches at or below a path that it deletes."""
    usable = batch.filter(_why_refused(None).isNull() & (F.col("kind") != "overflow"))
    steps = written(in_scope(split_moves(usable), scope).select("kind", "path"), "steps")
    deleted = steps.filter("kind = 'delete'").select("path")
    kept = reduce(DataFrame.unionByName, [m.select("path") for m in matches])
    below = under(kept, deleted)
    return written(steps.select("path").unionByName(below.select("path")).distinct(), "touched")


def _current_rows(spark: SparkSession, folder: str, paths: DataFrame, scope: Scope) -> DataFrame:
    """The rows that these paths have in the current catalogue: one scan of their buckets."""
    version = latest_version(spark, folder)
    events = _unknown(_read_log(spark, folder, version["version"]), version)
    state = read_state(spark, version)
    if version["entries"] and all(b["first"] is not None for b in version["buckets"]):
        named = paths.withColumn("delete_ord", F.lit(None).cast("bigint"))
        some = read_state(spark, version, _touched_buckets(named, version["buckets"]))
    else:
        some = state
    some = some.join(paths, "path", "left_semi")
    rows = fold_news(some, news_of(some, events, scope), _older_deletes(state, version, events))
    return with_parts(rows.filter("alive").select(*ENTRY_FIELDS).join(paths, "path", "left_semi"))


def _answer(
    spark: SparkSession, folder: str, batch: DataFrame, batch_id: int, searches: dict[str, dict], scope: Scope
) -> None:
    """Write the answers after a batch, and what it changed in the sets of matches."""
    base = _base_of(spark, folder)
    kept = {name: f"{folder}/matches/{name}/base={base}" for name in searches}
    before = {name: _matches_before(spark, kept[name], batch_id) for name in searches}
    touched = None
    if all(df is not None for df in before.values()) and not _moved_late(spark, folder, batch):
        touched = _touched(batch, before.values(), scope)
        fresh = written(_current_rows(spark, folder, touched, scope), "fresh")
    for name, wanted in searches.items():
        whole, delta = f"{kept[name]}/whole={batch_id}", f"{kept[name]}/delta={batch_id}"
        if touched is None:
            found = search(current_catalogue(spark, folder, scope), **wanted)
            found.matched.write.mode("overwrite").parquet(whole)
        else:
            found = search(fresh, **wanted)
            now = touched.join(found.matched.withColumn("matched", F.lit(True)), "path", "left")
            now.withColumn("matched", F.col("matched").isNotNull()).write.mode("overwrite").parquet(delta)
            now = spark.read.schema(now.schema).parquet(delta).filter("matched").select(*RESULT_COLUMNS)
            found = replace(found, matched=before[name].join(touched, "path", "left_anti").unionByName(now))
            if batch_id % WHOLE_EVERY == 0:
                found.matched.write.mode("overwrite").parquet(f"{whole}-new")
                spark.read.schema(found.matched.schema).parquet(f"{whole}-new").write.mode("overwrite").parquet(whole)
        answers = f"{folder}/searches/{name}"
        found.page.write.mode("overwrite").parquet(f"{answers}/batch={batch_id}")
        _forget(spark, kept[name], batch_id)
        for k in _parts(spark, answers, "batch"):
            if k <= batch_id - KEPT_ANSWERS:
                remove_folder(spark, f"{answers}/batch={k}")


def _forget(spark: SparkSession, location: str, batch_id: int) -> None:
    """Remove what the last whole set of matches makes superfluous, and sets of older bases."""
    wholes = _parts(spark, location, "whole")
    for kind, gone in (("whole", wholes[:-1]), ("delta", [k for k in _parts(spark, location, "delta") if k <= wholes[-1]])):
        for k in gone:
            remove_folder(spark, f"{location}/{kind}={k}")
    parent, own = location.rsplit("/", 1)
    for name in folders_in(spark, parent):
        if name != own:
            remove_folder(spark, f"{parent}/{name}")


# --- The stream --------------------------------------------------------------


def fold_stream(
    events: DataFrame,
    folder: str,
    *,
    scope: Scope = EVERYWHERE,
    relist: Callable[[], tuple[DataFrame, int]] | None = None,
    searches: dict[str, dict] | None = None,
    compact_every: int = 100,
    keep_past: int | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Run the stream into the catalogue in ``folder`` (its checkpoint lies there too).

    A batch that holds an overflow, or events that are refused, throws the catalogue
    away and saves a listing instead: ``relist()`` returns it with the ``seq`` up to
    which it knows the events; later ones are carried over. Without ``relist`` an
    overflow is an error, and refused events show in :func:`current_status`.

    After every batch the standing ``searches`` (keyword arguments of ``search`` by
    name) are answered, into ``folder/searches/<name>/batch=<id>``, the newest ones being
    kept. A batch looks only at paths that it touched or deleted and writes only what it
    changed in the set of matches; after moves of directories it searches anew.
    Every step can be repeated for the same batch without harm.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = latest_version(spark, folder)
        with removed_after(spark):
            if version["through_batch"] < batch_id:
                take_batch(spark, version, as_changes(batch), batch_id)
            if searches:
                _answer(spark, folder, as_changes(batch), batch_id, searches, scope)

    def take_batch(spark: SparkSession, version: Row, batch: DataFrame, batch_id: int) -> None:
        judged = written(batch.withColumn("reason", _why_refused(version["floor_seq"])), "batch")
        good = judged.filter("reason IS NULL").select(*CHANGE.fieldNames())
        aside = judged.filter("reason IS NOT NULL").select(*_REFUSED_COLUMNS)
        some_aside, place = not aside.isEmpty(), f"{folder}/refused/batch={batch_id}"
        if some_aside:
            aside.write.mode("overwrite").parquet(place)
        else:
            remove_folder(spark, place)
        target = f"{log_of(folder, version['version'])}/batch={batch_id}"
        good.write.mode("overwrite").parquet(target)
        lost = not good.filter("kind = 'overflow'").isEmpty()
        if lost and relist is None:
            raise RuntimeError("events were lost, and there is no listing to rebuild from")
        if lost or (relist and some_aside):
            listing, seq = relist()
            save_listing(spark, folder, listing, batch_id, "overflow", seq, scope=scope)
        elif (batch_id + 1) % compact_every == 0:
            compact(spark, folder, batch_id, scope, keep_past)

    writer = events.writeStream.foreachBatch(on_batch).option(
        "checkpointLocation", f"{folder}/checkpoint"
    )
    return writer.trigger(**(trigger or {"availableNow": True})).start()
