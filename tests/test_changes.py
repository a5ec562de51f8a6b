import glob
import random
import threading
import time

import pytest
from conftest import paths
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathlode import (
    Excludes,
    apply_changes,
    current_catalogue,
    fold_stream,
    gram_search,
    load_catalogue,
    load_grams,
    refresh,
    save_catalogue,
    save_grams,
    start_catalogue,
    stream_changes,
)
from pathlode.operators import changes as ch
from pathlode.operators import moves
from pathlode.operators.monitor import change_log_tail, changes_per_day, status_row
from pathlode.schema import CHANGE, ENTRY_FIELDS
from pathlode.session import new_folder, removed_after, shared_folder
from pathlode.sources.catalogue import forget_versions, versions
from pathlode.sources.events import changes_from_json
from pathlode.streaming import fold
from pathlode.streaming.fold import compact, current_status, events_after, logged_events, refused


def event(seq, kind, path=None, to_path=None, is_dir=None, size=None, modified=None):
    return (seq, None, kind, path, to_path, is_dir, size, modified, None, None)


def replay(base, events):
    """The plain meaning of a change feed, one event after the other."""
    state = {r["path"]: tuple(r[c] for c in ENTRY_FIELDS[1:]) for r in base}

    def delete(path):
        for p in [p for p in state if p == path or p.startswith(path + "/")]:
            del state[p]

    for _, _, kind, path, to_path, is_dir, *meta in sorted(events, key=lambda e: e[0]):
        inside = {}
        if kind == "move" and is_dir is not False:
            inside = {to_path + p[len(path) :]: v for p, v in state.items() if p.startswith(path + "/")}
        if kind in ("delete", "move"):
            delete(path)
        if kind in ("create", "move"):
            target = path if kind == "create" else to_path
            state[target] = (bool(is_dir), *[v or 0 for v in meta])
        state.update(inside)
        if kind == "modify" and path in state:
            old = state[path]
            state[path] = (old[0], *[o if v is None else v for o, v in zip(old[1:], meta)])
    return state


def random_feed(rng, n, first=0):
    def some_path():
        parts = [rng.choice("abc") for _ in range(rng.randint(1, 3))]
        return "/" + "/".join(parts) + rng.choice(["", "", "1"])

    out = []
    for seq in range(first, first + n):
        kind = rng.choice(["create"] * 4 + ["modify"] * 3 + ["delete"] + ["move"])
        size = rng.choice([None, rng.randint(1, 99)])
        to_path = some_path() if kind == "move" else None
        is_dir = {"create": rng.random() < 0.3, "move": rng.random() < 0.1}.get(kind)
        out.append(event(seq, kind, some_path(), to_path, is_dir, size, rng.randint(1, 99)))
    return out


def state_of(df):
    return {r["path"]: tuple(r[c] for c in ENTRY_FIELDS[1:]) for r in df.collect()}


BASE = [("/a", 1), "/a/b/", ("/a/b/c", 3), ("/b/c1", 4), "/c/", ("/c/a/b", 5)]


@pytest.mark.parametrize("seed, broadcast", [(0, None), (1, False), (2, None), (2, False)])
def test_fold_equals_replay(spark, entries, seed, broadcast):
    base = entries(*BASE)
    feed = random_feed(random.Random(seed), 150)
    expected = replay(base.collect(), feed)
    random.Random(seed).shuffle(feed)
    folded = apply_changes(base, spark.createDataFrame(feed, CHANGE), broadcast=broadcast)
    assert state_of(folded) == expected


def test_single_cases(spark, entries):
    base = entries("/shed/rack/", "/shed/rack/box/nails", "/shed/rack.old", ("/shed/saw", 10, 100))

    def fold(*feed):
        return apply_changes(base, spark.createDataFrame(list(feed), CHANGE))

    gone = fold(event(1, "delete", "/shed/rack"))
    assert paths(gone) == ["/shed/rack.old", "/shed/saw"]
    unknown = fold(event(1, "modify", "/shed/new", size=5))
    assert "/shed/new" not in paths(unknown)
    twice = fold(event(1, "create", "/shed/saw", is_dir=False, size=20, modified=200))
    saw = twice.filter("path = '/shed/saw'").first()
    assert (saw["size"], saw["modified"]) == (20, 200)
    other_kind = fold(event(1, "create", "/shed/rack", is_dir=False, size=1))
    assert other_kind.count() == 4
    assert not other_kind.filter("path = '/shed/rack'").first()["is_dir"]
    kept = fold(event(1, "modify", "/shed/saw", modified=7))
    saw = kept.filter("path = '/shed/saw'").first()
    assert (saw["size"], saw["modified"]) == (10, 7)
    nothing = fold(event(1, "overflow"))
    assert nothing.count() == 4


def test_scope(spark, entries):
    feed = [
        event(1, "create", "/r/a"),
        event(2, "create", "/other/a"),
        event(3, "create", "/r/.hidden/x"),
        event(4, "create", "/r/.file"),
        event(5, "create", "/r/.dir", is_dir=True),
        event(6, "delete", "/r/.dir2"),
        event(7, "create", "/r/state/x"),
        event(8, "move", "/other/b", "/r/b"),
        event(9, "move", "/r/c", "/rr/c"),
    ]
    steps = ch.split_moves(spark.createDataFrame(feed, CHANGE))
    kept = ch.in_scope(steps, ch.Scope(("/r/",), ("/r/state",))).orderBy("ord").collect()
    assert [(r["ord"], r["kind"], r["path"]) for r in kept] == [
        (2, "create", "/r/a"),
        (8, "create", "/r/.file"),
        (12, "delete", "/r/.dir2"),
        (17, "create", "/r/b"),
        (18, "delete", "/r/c"),
    ]


def test_rules_on_the_feed(spark, entries):
    feed = [
        event(1, "create", "/r/a.tmp"),
        event(2, "create", "/r/a"),
        event(3, "delete", "/r/b.tmp"),
    ]
    events = spark.createDataFrame(feed, CHANGE)
    base = entries("/r/b.tmp")
    assert paths(apply_changes(base, events)) == ["/r/a", "/r/a.tmp"]
    strict = ch.Scope(("/r",), excludes=Excludes(patterns=("*.tmp",)))
    assert paths(apply_changes(base, events, strict)) == ["/r/a"]


def test_events_from_json(spark):
    texts = ['{"seq": 1, "kind": "create", "path": "/x", "size": 5}', "no json", "{}"]
    rows = spark.createDataFrame([(t,) for t in texts], "value string")
    got = changes_from_json(rows).collect()
    assert [(r["seq"], r["kind"], r["path"], r["size"]) for r in got] == [
        (1, "create", "/x", 5),
        (None, None, None, None),
        (None, None, None, None),
    ]


def test_latest_by_path(spark):
    rows = spark.createDataFrame(
        [("/v", 1, 10), ("/v", 2, 20), ("/w", 1, 5)], "path string, at int, size int"
    )
    for order in ([F.col("at")], [F.col("at"), F.col("size")]):
        last = ch.latest_by_path(rows, *order).collect()
        assert {r["path"]: (r["at"], r["size"]) for r in last} == {"/v": (2, 20), "/w": (1, 5)}


def run_stream(spark, tmp_path, base, batches, **options):
    folder, feed = str(tmp_path / "store"), tmp_path / "feed"
    feed.mkdir()
    start_catalogue(base, folder)
    for batch in batches:
        spark.createDataFrame(batch, CHANGE).coalesce(1).write.mode("append").parquet(str(feed))
        fold_stream(stream_changes(spark, str(feed)), folder, **options).awaitTermination()
    return folder


@pytest.mark.parametrize("compact_every", [2, 100])
def test_stream_equals_replay(spark, entries, tmp_path, compact_every):
    base = entries(*BASE)
    scratch = lambda: glob.glob(f"{shared_folder(spark)}/pathlode/*")
    known = set(scratch())
    rng = random.Random(11)
    batches = [random_feed(rng, 40, first=40 * i) for i in range(3)]
    folder = run_stream(
        spark,
        tmp_path,
        base,
        batches,
        compact_every=compact_every,
        searches={"a-names": {"terms": "a", "sort": "path"}},
    )
    expected = replay(base.collect(), sum(batches, []))
    assert versions(spark, folder).count() == (2 if compact_every == 2 else 1)
    # What the batches wrote in between is gone again.
    assert set(scratch()) <= known
    assert state_of(current_catalogue(spark, folder)) == expected
    answers = spark.read.parquet(f"{folder}/searches/a-names")
    # The answer after each batch is that of a full search of the catalogue at that time.
    for i in range(3):
        so_far = replay(base.collect(), sum(batches[: i + 1], []))
        wanted = sorted(p for p in so_far if "a" in p.rsplit("/", 1)[1])
        assert paths(answers.filter(F.col("batch") == i)) == wanted, i


def test_late_events_take_effect_in_order_of_seq(spark, entries, tmp_path):
    feed = random_feed(random.Random(5), 60)
    batches = [feed[1::2], feed[0::2]]
    folder = run_stream(spark, tmp_path, entries(*BASE), batches)
    assert state_of(current_catalogue(spark, folder)) == replay(entries(*BASE).collect(), feed)


def test_overflow_rebuilds_from_a_listing(spark, entries, tmp_path):
    batches = [
        [event(1, "create", "/x", size=1)],
        [event(2, "delete", "/a"), event(3, "overflow", "/")],
        [event(4, "create", "/y", size=2)],
    ]
    listing = entries("/fresh/one", "/fresh/two")
    folder = run_stream(spark, tmp_path, entries(*BASE), batches, relist=lambda: (listing, 3))
    assert paths(current_catalogue(spark, folder)) == ["/fresh/one", "/fresh/two", "/y"]
    reasons = [r["reason"] for r in versions(spark, folder).orderBy("version").collect()]
    assert reasons == ["start", "overflow"]
    assert logged_events(spark, folder).count() == 1
    status = current_status(spark, folder).first()
    assert (status["entry_count"], status["overflow_count"], status["healthy"]) == (3, 1, True)
    assert status["message"] == "Indexed 3 entries" and status["build_millis"] > 0


def test_a_repeated_batch_changes_nothing(spark, entries, tmp_path):
    folder = str(tmp_path / "store")
    start_catalogue(entries(*BASE), folder)
    feed = spark.createDataFrame(random_feed(random.Random(2), 30), CHANGE)
    for _ in range(2):
        feed.write.mode("overwrite").parquet(f"{folder}/log/version=0/batch=0")
    expected = state_of(apply_changes(entries(*BASE), feed))
    assert state_of(current_catalogue(spark, folder)) == expected
    save_catalogue(current_catalogue(spark, folder), folder, through_batch=0)
    assert state_of(current_catalogue(spark, folder)) == expected


def test_batches_and_folding_do_not_matter(spark, entries, tmp_path):
    """One feed in any batches, folded at any time, is its replay."""
    base, rng = entries(*BASE), random.Random(20)
    feed = random_feed(rng, 90)
    expected = replay(base.collect(), feed)
    rng.shuffle(feed)
    cuts = sorted(rng.sample(range(1, len(feed)), 2))
    batches = [feed[a:b] for a, b in zip([0, *cuts], [*cuts, len(feed)])]
    for compact_every in (1, 2, 100):
        folder = tmp_path / f"every-{compact_every}"
        folder.mkdir()
        store = run_stream(spark, folder, base, batches, compact_every=compact_every)
        assert state_of(current_catalogue(spark, store)) == expected, compact_every


def test_a_late_create_stays_deleted(spark, entries, tmp_path):
    batches = [[event(10, "delete", "/a")], [event(5, "create", "/a")]]
    for compact_every in (1, 100):
        folder = tmp_path / f"{compact_every}"
        folder.mkdir()
        store = run_stream(spark, folder, entries("/x", "/a"), batches, compact_every=compact_every)
        assert paths(current_catalogue(spark, store)) == ["/x"]


def test_what_is_forgotten_is_refused(spark, entries, tmp_path):
    batches = [
        [event(10, "delete", "/a"), event(100, "create", "/y")],
        [event(50, "create", "/late"), event(96, "create", "/in-time"), event(101, "modify", "/y", size=4)],
    ]
    store = run_stream(spark, tmp_path, entries("/x", "/a"), batches, compact_every=1, keep_past=5)
    assert paths(current_catalogue(spark, store)) == ["/in-time", "/x", "/y"]
    assert [(r["seq"], r["reason"]) for r in refused(spark, store).collect()] == [(50, "too late")]
    assert not current_status(spark, store).first()["healthy"]


def test_events_that_cannot_be_used(spark, entries, tmp_path):
    bad = [event(None, "delete", "/x"), event(7, "rename", "/x"), event(8, "delete")]
    loose = T.StructType([T.StructField(f.name, f.dataType) for f in CHANGE.fields])
    with pytest.raises(Exception, match="no seq"):
        apply_changes(entries("/x"), spark.createDataFrame(bad[:1], loose)).collect()
    folder, feed = str(tmp_path / "store"), str(tmp_path / "feed")
    start_catalogue(entries("/x"), folder)
    spark.createDataFrame([*bad, event(9, "create", "/y")], loose).write.parquet(feed)
    fold_stream(stream_changes(spark, feed), folder).awaitTermination()
    assert paths(current_catalogue(spark, folder)) == ["/x", "/y"]
    assert sorted(r["reason"] for r in refused(spark, folder).collect()) == [
        "no path",
        "no seq",
        "unknown kind",
    ]
    assert not current_status(spark, folder).first()["healthy"]


def some_path(rng):
    return "/" + "/".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))


def moving_feed(rng, n, first=0):
    """A feed in which directories are moved into, over and out of each other again and again."""
    out = []
    for seq in range(first, first + n):
        kind = rng.choice(["create"] * 4 + ["modify"] * 3 + ["delete"] + ["move"] * 3)
        to_path = some_path(rng) if kind == "move" else None
        is_dir = {"move": rng.choice([None, True, True, False]), "create": rng.random() < 0.3}.get(kind)
        size = rng.choice([None, rng.randint(1, 99)])
        out.append(event(seq, kind, some_path(rng), to_path, is_dir, size, rng.randint(1, 99)))
    return out


@pytest.mark.parametrize("seed, broadcast", [(0, None), (1, False), (2, None)])
def test_moved_directories_take_their_contents_along(spark, entries, seed, broadcast):
    rng = random.Random(seed)
    base = entries(*{(some_path(rng), rng.randint(1, 9)) for _ in range(6)}, *{some_path(rng) + "/x" for _ in range(6)})
    base = base.dropDuplicates(["path"])
    feed = moving_feed(rng, (12, 30, 60)[seed])
    expected = replay(base.collect(), feed)
    rng.shuffle(feed)
    folded = apply_changes(base, spark.createDataFrame(feed, CHANGE), broadcast=broadcast)
    assert state_of(folded) == expected


def test_single_moves(spark, entries):
    """Cases side by side, each in a directory of its own."""
    held = ["d/", ("d/f", 1), ("d/s/g", 2), ("e/f", 9), "d2/f", ("e/old", 4)]
    rest = {"e/f": 9, "d2/f": 0, "e/old": 4}
    moved = {"e": 0, "e/f": 1, "e/s/g": 2, "e/old": 4, "d2/f": 0}
    cases = {
        "plain": ([(5, "move", "d", "e", True)], moved),
        "unsaid": ([(5, "move", "d/", "e")], moved),
        # A file has no contents: what the catalogue has below it goes.
        "file": ([(5, "move", "d", "x", False)], rest | {"x": 0}),
        # Reports from before the move go along, later ones do not; a late event counts by its order.
        "reports": (
            [(9, "modify", "e/f", None, None, 7), (5, "move", "d", "e", True), (3, "modify", "d/s/g", None, None, 8)]
            + [(8, "modify", "d/f", None, None, 6), (4, "create", "d/new")],
            moved | {"e/f": 7, "e/s/g": 8, "e/new": 0},
        ),
        "deleted": ([(2, "delete", "d/s"), (5, "move", "d", "x", True)], rest | {"x": 0, "x/f": 1}),
        "twice": (
            [(5, "move", "d", "x", True), (6, "move", "x/s", "d/t", True)],
            rest | {"x": 0, "x/f": 1, "d/t": 0, "d/t/g": 2},
        ),
        "emptied": ([(4, "delete", "d"), (5, "move", "d", "x", True)], rest | {"x": 0}),
        "inside": ([(5, "move", "d", "d/s", True)], rest | {"d/s": 0, "d/s/f": 1, "d/s/s/g": 2}),
        "hidden": ([(5, "move", "d", ".h/d", True)], rest),
        "outside": ([(5, "move", "d", "/elsewhere", True)], rest),
    }
    base, feed, expected = [], [], {}
    for name, (events, wanted) in cases.items():
        place = lambda p: p if p is None or p.startswith("/") else f"/{name}/{p}"  # noqa: B023, E731
        for p in held:
            base.append((place(p[0]), p[1]) if isinstance(p, tuple) else place(p))
        feed += [event(k, kind, place(p), *[place(t) for t in more[:1]], *more[1:]) for k, kind, p, *more in events]
        expected |= {place(p): size for p, size in wanted.items()}
    # Cases do not meet, so equal numbers do not matter once they are spread.
    feed = [(e[0] + 100 * k, *e[1:]) for k, e in enumerate(feed)]
    feed = [(e[0] % 100 * 100 + e[0] // 100, *e[1:]) for e in feed]
    scope = ch.Scope(tuple(f"/{name}" for name in cases))
    folded = apply_changes(entries(*base), spark.createDataFrame(feed, CHANGE), scope)
    assert {p: v[1] for p, v in state_of(folded).items()} == expected


def test_a_path_with_very_many_events_below_a_moved_directory(spark, entries):
    feed = [event(k, ("create", "modify", "delete")[k % 3], "/d/lock", size=k) for k in range(3, 6000)]
    feed += [event(1, "create", "/d/f", size=1), event(6001, "move", "/d", "/e", is_dir=True), event(6002, "create", "/d/f")]
    events = spark.createDataFrame(feed, CHANGE)
    folded = apply_changes(entries("/d/", ("/d/lock", 5)), events)
    assert state_of(folded) == replay(entries("/d/", ("/d/lock", 5)).collect(), feed)


def test_late_events_follow_moves_that_are_folded(spark, entries, tmp_path):
    """Directory moves in any batches, folded at any time: older events are replayed."""
    base, rng = entries(*BASE), random.Random(7)
    feed = moving_feed(rng, 30)
    expected = replay(base.collect(), feed)
    rng.shuffle(feed)
    batches = [feed[:15], feed[15:]]
    store = run_stream(spark, tmp_path, base, batches, compact_every=1)
    assert state_of(current_catalogue(spark, store)) == expected
    assert refused(spark, store).isEmpty()


def test_refresh_keeps_later_events(spark, entries, tmp_path):
    store = run_stream(spark, tmp_path, entries("/x"), [[event(1, "create", "/old"), event(5, "create", "/new")]])
    listing = entries("/x", "/old", "/seen").drop("name", "parent", "extension", "name_lc")
    with pytest.raises(ValueError, match="up to which seq"):
        refresh(spark, store, listing)
    refresh(spark, store, listing, as_of_seq=3)
    assert paths(current_catalogue(spark, store)) == ["/new", "/old", "/seen", "/x"]
    # Events that were folded into a version meanwhile are carried as well.
    compact(spark, store, 1)
    refresh(spark, store, listing.filter("path = '/x'"), as_of_seq=3)
    assert paths(current_catalogue(spark, store)) == ["/new", "/x"]


@pytest.mark.parametrize("rebuilt, folded", [(False, True), (True, False)])
def test_late_events_do_not_undo_a_listing(spark, entries, tmp_path, rebuilt, folded):
    listing = entries(("/a", 7), "/b", "/c")
    late = [event(50, "delete", "/a"), event(60, "create", "/gone"), event(70, "modify", "/a", size=1)]
    later = [event(110, "create", "/d"), event(120, "delete", "/b"), event(99, "delete", "/")]
    first = [event(40, "create", "/x"), *([event(41, "overflow", "/")] if rebuilt else [])]
    store = run_stream(spark, tmp_path, entries("/a"), [first], relist=lambda: (listing, 100))
    if not rebuilt:
        refresh(spark, store, listing, as_of_seq=100)
    feed = tmp_path / "feed"
    for batch in (late, later):
        spark.createDataFrame(batch, CHANGE).coalesce(1).write.mode("append").parquet(str(feed))
        every = 1 if folded else 100
        fold_stream(stream_changes(spark, str(feed)), store, compact_every=every).awaitTermination()
    assert {p: v[1] for p, v in state_of(current_catalogue(spark, store)).items()} == {"/a": 7, "/c": 0, "/d": 0}
    assert refused(spark, store).isEmpty()


def test_an_incomplete_listing_knows_only_what_it_lists(spark, entries, tmp_path):
    store = run_stream(spark, tmp_path, entries("/a", "/b", "/d/x"), [[event(10, "create", "/c"), event(150, "delete", "/d")]])
    refresh(spark, store, entries(("/a", 7), "/n", "/d/x"), as_of_seq=100, complete=False)
    assert paths(current_catalogue(spark, store)) == ["/a", "/b", "/c", "/n"]
    late = [event(50, "delete", "/a"), event(60, "delete", "/b"), event(70, "create", "/late"), event(101, "delete", "/n")]
    spark.createDataFrame(late, CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    fold_stream(stream_changes(spark, str(tmp_path / "feed")), store).awaitTermination()
    assert paths(current_catalogue(spark, store)) == ["/a", "/c", "/late"]


def test_compaction_writes_what_changed(spark, entries, tmp_path, monkeypatch):
    """Bytes follow the events, old versions stay readable, folders stay few, the index stays valid."""
    monkeypatch.setattr(fold, "BLOCK", 4)
    data = entries(*[f"/d{i % 40:02d}/file-{i:05d}" for i in range(4000)], "/d20/unique-name")
    store = str(tmp_path / "store")
    whole = save_catalogue(data, store, partitions=16)
    index = save_grams(spark, store)
    feed = tmp_path / "feed"

    def fed(*batch):
        spark.createDataFrame(list(batch), CHANGE).coalesce(1).write.mode("append").parquet(str(feed))
        fold_stream(stream_changes(spark, str(feed)), store, compact_every=1, keep_past=5).awaitTermination()
        return versions(spark, store).orderBy(F.col("version").desc()).first()

    wanted = {r["path"] for r in data.select("path").collect()}
    last = fed(event(1, "create", "/d03/new", size=3), event(2, "modify", "/d03/file-00003", size=9))
    assert last["reason"] == "compact" and last["bytes"] < whole.bytes / 4
    assert len({b["run"] for b in last["buckets"]}) == 2
    last = fed(event(11, "delete", "/d39"), event(12, "create", "/zz"), event(13, "create", "/d20/unique-name-2"))
    gone = {p for p in wanted if p.startswith("/d39/")}
    now = wanted - gone | {"/d03/new", "/zz", "/d20/unique-name-2"}
    assert set(paths(load_catalogue(spark, store))) == now and last["entries"] == len(now)
    assert set(paths(load_catalogue(spark, store, 0))) == wanted
    # The index of the first run still serves its buckets; the next one reads new runs only.
    current = load_catalogue(spark, store)
    names = ["/d20/unique-name", "/d20/unique-name-2"]
    for known in (index, load_grams(spark, store)):
        assert paths(gram_search(current, known, "unique")) == names
    grown = save_grams(spark, store)
    assert set(index.runs) < set(grown.runs)
    assert paths(gram_search(current, grown, "unique")) == names
    # With a log the stored buckets are still told apart, and new paths are found.
    late = [event(31, "create", "/q/unique-too"), event(32, "delete", names[0])]
    spark.createDataFrame(late, CHANGE).coalesce(1).write.mode("append").parquet(str(feed))
    fold_stream(stream_changes(spark, str(feed)), store, compact_every=100).awaitTermination()
    now = current_catalogue(spark, store)
    found = gram_search(now, grown, "unique")
    assert paths(found) == [names[1], "/q/unique-too"]
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    # Folded events lie in blocks; those that are too old to be asked for are gone.
    blocks = {p.name for p in (tmp_path / "store" / "history").glob("block=*")}
    assert blocks == set()
    assert len(list((tmp_path / "store" / "log").glob("version=*"))) <= 3
    assert sorted(r["seq"] for r in events_after(spark, store, 12).collect()) == [13, 31, 32]
    with pytest.raises(ValueError, match="no longer kept"):
        events_after(spark, store, 2)
    # The newest version still names all runs; after a full save it names one.
    assert forget_versions(spark, store, keep=1) == []
    held = set(paths(load_catalogue(spark, store)))
    save_catalogue(load_catalogue(spark, store), store)
    assert len(forget_versions(spark, store, keep=1)) == 3
    assert set(paths(load_catalogue(spark, store))) == held >= {"/zz"}


def test_scratch_tables_of_other_threads_stay(spark, tmp_path):
    seen = {}

    def other():
        seen["folder"] = new_folder(spark, "other")
        spark.range(3).write.parquet(seen["folder"])

    with removed_after(spark):
        own = new_folder(spark, "own")
        spark.range(2).write.parquet(own)
        thread = threading.Thread(target=other)
        thread.start()
        thread.join()
    assert spark.read.parquet(seen["folder"]).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(own)


def test_monitoring(spark, entries):
    feed = [event(i, "modify", f"/f{i}") for i in range(60)]
    feed += [
        event(60, "create", "/d", is_dir=True),
        event(61, "move", "/a", "/b"),
        event(62, "overflow", "/m"),
        event(63, "delete", "/z"),
    ]
    events = spark.createDataFrame(feed, CHANGE)
    scoped = change_log_tail(events, scope=ch.Scope(("/d", "/b"))).collect()
    assert [r["text"] for r in scoped] == ["overflow /m", "move /a -> /b", "create /d (dir)"]
    log = change_log_tail(events).collect()
    assert len(log) == 50
    newest = ["delete /z", "overflow /m", "move /a -> /b", "create /d (dir)"]
    assert [r["text"] for r in log[:4]] == newest
    row = status_row(entries("/a", "/b"), events).first()
    assert (row["entry_count"], row["event_count"], row["overflow_count"]) == (2, 64, 1)
    assert not row["healthy"]
    assert status_row(entries("/a"), events, since_seq=62).first()["healthy"]
    assert not status_row(entries("/a"), events, since_seq=62, watch_failures=1).first()["healthy"]


def test_changes_per_day_as_a_stream(spark, tmp_path):
    rows = spark.range(48).select(
        F.col("id").alias("seq"),
        F.timestamp_seconds(F.col("id") * 3600 * 2).alias("ts"),
        F.lit("create").alias("kind"),
        F.lit("/x").alias("path"),
    )
    ch.as_changes(rows).coalesce(1).write.parquet(str(tmp_path / "feed"))
    stream = changes_per_day(stream_changes(spark, str(tmp_path / "feed")), late="0 seconds")
    query = (
        stream.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "check"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    closed = {str(r["day"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert closed == {"1970-01-01": 12, "1970-01-02": 12, "1970-01-03": 12}


def test_places_meet_no_list_of_cuts(spark):
    """A directory with very many things and cuts: their pairs would be 3 billion."""
    n, cuts_n = 150_000, 20_000
    places = spark.range(n, numPartitions=4).select(
        F.concat(F.lit("/a/f"), "id").alias("path"), (F.col("id") * 2).alias("ord")
    ).selectExpr("path", "ord", "path AS loc", "ord AS since", "array(ord) AS key")
    moved = F.when(F.col("id") % 3 == 0, F.lit("/b"))
    cuts = spark.range(cuts_n).select(F.lit("/a").alias("mark"), (F.col("id") * 14).alias("at"), moved.alias("target"))
    begun = time.monotonic()
    got = {r["ord"]: r for r in moves._next_cuts(places, cuts, True).select("ord", "move", "died").collect()}
    assert time.monotonic() - begun < 60 and len(got) == n
    moved_at, died_at = [14 * k for k in range(0, cuts_n, 3)], [14 * k for k in range(cuts_n) if k % 3]
    for since in (0, 2, 14, 16, 42, 41_998, 279_956, 279_972, 279_986, 299_998):
        move = next((at for at in moved_at if at > since), None)
        death = next((at for at in died_at if at > since), None)
        assert (got[since]["move"] and got[since]["move"]["at"]) == move
        assert got[since]["died"] == (death is not None and (move is None or death < move))
