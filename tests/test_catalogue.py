import glob

import pytest
from conftest import names, paths
from pyspark.sql import functions as F

from pathlode import (
    Excludes,
    NoResults,
    build_catalogue,
    export,
    load_catalogue,
    lost_lines,
    read_inventory,
    refresh,
    refresh_from_inventory,
    save_catalogue,
    scan_files,
    search,
    session,
    silent_files,
)
from pathlode.functions.paths import with_parts
from pathlode.operators.hierarchy import derive_directories, not_under, under
from pathlode.operators.reconcile import reconcile_diff, stale, upsert
from pathlode.operators.sorting import (
    flag_sort,
    page,
    page_after,
    page_of_ranges,
    ranges_of,
    sort_order,
    with_position,
)
from pathlode.operators.totals import extension_counts
from pathlode.schema import ENTRY
from pathlode.sources.inventory import as_entries, one_per_path, union_roots, with_directories


def test_parts(entries):
    data = entries(
        "/srv/dump.tar.zst", "/a/.bashrc", "/a/foo.", "/a/README", "/a/d.x/", "rel", "/x"
    )
    got = {r["path"]: (r["name"], r["extension"], r["parent"]) for r in data.collect()}
    assert got == {
        "/srv/dump.tar.zst": ("dump.tar.zst", "zst", "/srv"),
        "/a/.bashrc": (".bashrc", "bashrc", "/a"),
        "/a/foo.": ("foo.", "", "/a"),
        "/a/README": ("README", "", "/a"),
        "/a/d.x": ("d.x", "", "/a"),
        "rel": ("rel", "", ""),
        "/x": ("x", "", ""),
    }
    assert {r[0]: r[1] for r in extension_counts(data).collect()} == {"zst": 1, "bashrc": 1, "": 4}


TREE = [
    "/w/maps/",
    "/w/maps/alps.gpx",
    "/w/maps/roads",
    "/w/maps/2023/",
    "/w/maps/2023/coast.kml",
    "/w/letter.odt",
    "/w/.git/",
    "/w/.git/config",
    "/w/.profile",
    "/w/scratch.bak",
    "/w/copy.bak/",
    "/w/copy.bak/ledger.ods",
    "/w/build/",
    "/w/build/out.o",
    "/w/./q",
]
VISIBLE = sorted(p.rstrip("/") for p in TREE if "/.git" not in p)


def all_but(*kept):
    return [p for p in VISIBLE if p not in kept]


@pytest.mark.parametrize(
    "excludes, dropped",
    [
        (Excludes(), []),
        (Excludes(skip_hidden=True), ["/w/.profile"]),
        (Excludes(patterns=("*.bak",)), ["/w/scratch.bak", "/w/copy.bak", "/w/copy.bak/ledger.ods"]),
        (Excludes(patterns=("*.BAK", "maps/2023")), []),
        (Excludes(patterns=("w", "letter.*")), ["/w/letter.odt"]),
        (Excludes(patterns=("?", "letter.*")), ["/w/./q", "/w/letter.odt"]),
        (Excludes(patterns=("*",)), VISIBLE),
        (Excludes(folders=("**/build",)), ["/w/build", "/w/build/out.o"]),
        (Excludes(folders=("w",)), VISIBLE),
        (Excludes(folders=("?",)), VISIBLE),
        (Excludes(paths=("/w/maps/2023/",)), ["/w/maps/2023", "/w/maps/2023/coast.kml"]),
        (Excludes(paths=("/w/maps/20",)), []),
        (Excludes(include_only=("*s", "*.gpx")), all_but("/w/maps", "/w/maps/alps.gpx", "/w/maps/roads")),
        (Excludes(include_only=("w", "*s")), all_but("/w/maps", "/w/maps/roads")),
        (Excludes(include_only=("maps/roads",)), VISIBLE),
    ],
)
def test_excludes(entries, excludes, dropped):
    data = entries(*TREE).drop("name", "parent", "extension", "name_lc")
    kept = build_catalogue(data, ("/w",), excludes)
    assert paths(kept) == sorted(set(VISIBLE) - set(dropped))


def test_system_paths_and_roots(entries):
    data = entries("/proc/", "/proc/1/", "/processor", "/sys/a", "/home/dev/x", "/srv/a", "/srv")
    rule = Excludes(skip_system_paths=True)
    visible = ["/home/dev/x", "/processor", "/srv", "/srv/a"]
    assert paths(build_catalogue(data, ("/",), rule)) == visible
    assert paths(build_catalogue(data, ("/proc",), rule)) == ["/proc/1"]
    assert paths(build_catalogue(data, ("/srv/", "/home/dev"))) == ["/home/dev/x", "/srv/a"]
    assert paths(build_catalogue(data, ("/", "/sys"), rule)) == [
        "/home/dev/x",
        "/processor",
        "/srv",
        "/srv/a",
        "/sys/a",
    ]
    # A path stays when some root keeps it, also when the roots are nested.
    nested = entries("/a/b.tmp/", "/a/b.tmp/c")
    kept = build_catalogue(nested, ("/a", "/a/b.tmp"), Excludes(patterns=("*.tmp",)))
    assert paths(kept) == ["/a/b.tmp/c"]


def test_inventory_sources(spark, tmp_path):
    rows = spark.createDataFrame(
        [("/a", 1, False), ("/link", 2, True), ("", 3, False), ("/n", None, None)],
        "path string, size bigint, is_symlink boolean",
    )
    got = as_entries(rows)
    assert [tuple(r) for r in got.orderBy("path").collect()] == [
        ("/a", False, 1, 0, 0, 0),
        ("/n", False, 0, 0, 0, 0),
    ]
    timed = spark.sql("SELECT '/t' AS path, TIMESTAMP '1970-01-02 00:00:00' AS modified")
    assert as_entries(timed).first()["modified"] == 86_400
    (tmp_path / "inv.csv").write_text("/x,true,1,2,3,4\nbroken,zz,zz,,,\n/y,false,5,6,7,8\n")
    read = read_inventory(spark, str(tmp_path / "inv.csv"), "csv")
    assert paths(read) == ["/x", "/y"]
    lost = lost_lines(spark, str(tmp_path / "inv.csv")).collect()
    assert [(r["file"], r["faults"]) for r in lost] == [(str(tmp_path / "inv.csv"), ["is_dir", "size"])]
    assert '"path":"broken"' in lost[0]["line"]
    for name in ("parquet", "orc", "json"):
        got.write.format(name).save(str(tmp_path / name))
        assert paths(read_inventory(spark, str(tmp_path / name), name)) == ["/a", "/n"]


def test_lost_lines_block_removals(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.json").write_text('{"path":"/a","size":1}\n{"path":"/b","size":2}\n{"path":"/c"}\n')
    store = str(tmp_path / "store")
    first = refresh_from_inventory(spark, store, str(tmp_path / "one"), "json")
    assert first.complete and first.changes is None and first.stats.entries == 3
    (tmp_path / "two").mkdir()
    bad = ['{"path":"/b","size":"many"}', '{"path":"/c", ', '{"size":4}', '{"path":"","size":4}', "7"]
    (tmp_path / "two" / "a.json").write_text("\n".join([*bad, '{"path":"/d","size":4}', ""]))
    second = refresh_from_inventory(spark, store, str(tmp_path / "two"), "json")
    assert (second.complete, second.lost_lines, second.silent_files) == (False, 5, 0)
    assert paths(load_catalogue(spark, store)) == ["/a", "/b", "/c", "/d"]
    kept = spark.read.parquet(f"{store}/lost_lines").collect()
    assert {r["version"] for r in kept} == {second.stats.version}
    assert sorted(",".join(r["faults"]) for r in kept) == ["path"] * 4 + ["size"]
    assert '{"path":"/c", ' in {r["line"] for r in kept}
    third = refresh_from_inventory(spark, store, str(tmp_path / "one"), "json", skip_unreadable=True)
    assert third.complete and paths(load_catalogue(spark, store)) == ["/a", "/b", "/c"]


def test_several_roots_give_each_path_once(entries):
    a = entries(("/r/x", 1, 5), "/r/y")
    b = entries(("/r/x", 2, 9), "/s/z")
    merged = union_roots(a, b)
    assert paths(merged) == ["/r/x", "/r/y", "/s/z"]
    assert merged.filter("path = '/r/x'").first()["size"] == 2
    assert one_per_path(a.union(a)).count() == 2


def test_scan_files(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "one.txt").write_text("hello")
    (tmp_path / "d" / "e" / "two.rs").write_text("fn")
    found = scan_files(spark, str(tmp_path / "d"))
    assert {r["path"]: r["size"] for r in found.collect()} == {
        f"{tmp_path}/d/one.txt": 5,
        f"{tmp_path}/d/e/two.rs": 2,
    }
    assert found.filter("modified > 0").count() == 2
    assert names(search(found, "two").page) == ["two.rs"]
    assert paths(scan_files(spark, str(tmp_path / "d"), "*.rs")) == [f"{tmp_path}/d/e/two.rs"]


def test_directories_are_shuffled_once(entries):
    found = derive_directories(entries("/a/b/c.txt", "/a/b/d/e.txt", "/top", "rel/x"))
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_directories(entries):
    data = entries("/a/b/c.txt", "/a/b/d/e.txt", "/top", "rel/x")
    assert paths(derive_directories(data)) == ["/a", "/a/b", "/a/b/d", "rel"]
    assert with_directories(data).filter("is_dir").count() == 4
    # Directories that are listed stay as they are, and are not added again.
    listed = with_directories(entries(("/a/", 7), "/a/b/c.txt")).orderBy("path").collect()
    assert [(r["path"], r["size"]) for r in listed] == [("/a", 7), ("/a/b", 0), ("/a/b/c.txt", 0)]


@pytest.mark.parametrize("broadcast", [None, False])
def test_subtrees(spark, entries, broadcast):
    data = entries("/shed/rack/", "/shed/rack/box/", "/shed/rack/box/nails", "/shed/rack.old", "rel/a")
    folders = spark.createDataFrame([("/shed/rack/",), ("/no",), ("rel",)], "path string")
    assert paths(not_under(data, folders, broadcast)) == ["/shed/rack.old"]
    assert len(paths(under(data, folders, broadcast))) == 4
    root = spark.createDataFrame([("/",)], "path string")
    assert paths(not_under(data, root, broadcast)) == ["rel/a"]
    assert not_under(data, root.filter("false"), broadcast).count() == 5


def test_save_load_refresh(spark, entries, tmp_path):
    folder = str(tmp_path / "c")
    with pytest.raises(FileNotFoundError):
        load_catalogue(spark, folder)
    stats, diff = refresh(spark, folder, entries("/x/removed.txt", "/x/file.txt", ("/x/grow", 1)))
    assert (stats.version, stats.entries, diff) == (0, 3, None) and stats.bytes > 0
    held = load_catalogue(spark, folder)
    stats, diff = refresh(spark, folder, entries("/x/added.txt", "/x/file.txt", ("/x/grow", 14)))
    assert stats.version == 1
    assert {r["path"]: r["status"] for r in diff.collect()} == {
        "/x/removed.txt": "removed",
        "/x/added.txt": "added",
        "/x/file.txt": "same",
        "/x/grow": "changed",
    }
    assert paths(held) == ["/x/file.txt", "/x/grow", "/x/removed.txt"]
    assert paths(load_catalogue(spark, folder)) == ["/x/added.txt", "/x/file.txt", "/x/grow"]
    assert paths(load_catalogue(spark, folder, version=0)) == paths(held)
    save_catalogue(held, folder, cluster_by="extension", partitions=2)
    assert paths(load_catalogue(spark, folder)) == paths(held)


def test_reconcile_parts(entries):
    old, new = entries(("/a", 1), "/b"), entries(("/a", 2), "/c")
    assert paths(stale(old, new)) == ["/b"]
    merged = upsert(old, new)
    assert {r["path"]: r["size"] for r in merged.collect()} == {"/a": 2, "/b": 0, "/c": 0}
    assert reconcile_diff(old, old).filter("status <> 'same'").isEmpty()


def test_sorts(entries):
    data = entries("/k/9/b.ods", "/k/1/a.ods", "/k/5/Z.eml", "/k/2/b", "/K/c.eml")
    by_name = [r["path"] for r in page(data, "name").collect()]
    assert by_name == ["/k/5/Z.eml", "/k/1/a.ods", "/k/2/b", "/k/9/b.ods", "/K/c.eml"]
    by_path = [r["name"] for r in page(data, "path-desc").collect()]
    assert by_path == ["b.ods", "Z.eml", "b", "a.ods", "c.eml"]
    ties = [r["path"] for r in page(data, "ext-desc", limit=4).collect()]
    assert ties == ["/k/1/a.ods", "/k/9/b.ods", "/K/c.eml", "/k/5/Z.eml"]
    for spelling in ("date-modified-desc", " Size ", "accessed", "created-asc", "extension"):
        sort_order(spelling)
    for bad in ("not-a-sort", "", "size-up", "name-asc-asc"):
        with pytest.raises(ValueError):
            sort_order(bad)
    assert flag_sort("size") == "size-desc"
    assert flag_sort("size", ascending=True) == "size-asc"
    assert flag_sort("name-asc") == "name-asc"
    assert [flag_sort(f) for f in ("N", "S", "E", "D", "-D")] == [
        "name-asc",
        "size-desc",
        "extension-asc",
        "date-modified-desc",
        "date-modified-asc",
    ]


def test_positions_and_deep_pages(spark):
    rows = spark.range(30_000).select(
        F.concat(F.lit("/f/"), F.col("id")).alias("path"),
        F.pmod(F.hash("id"), F.lit(50)).alias("size"),
    )
    placed = with_position(rows, *sort_order("size-desc")).collect()
    expected = sorted(rows.collect(), key=lambda r: (-r["size"], r["path"]))
    got = {r["position"]: r["path"] for r in placed}
    assert [got[i + 1] for i in range(len(expected))] == [r["path"] for r in expected]
    deep = page(rows, "size-desc", offset=20_000, limit=7).collect()
    assert [r["path"] for r in deep] == [r["path"] for r in expected[20_000:20_007]]
    rest = page(rows, "size-desc", offset=29_998).collect()
    assert [r["path"] for r in rest] == [r["path"] for r in expected[29_998:]]
    assert page(rows, "size", offset=10**9, limit=5).isEmpty()


@pytest.mark.parametrize("sort", ["size", "size-desc", "path", "path-desc"])
def test_pages_by_ranges(spark, sort):
    """Hot keys, null keys, empty ranges: every page is a piece of the sorted whole."""
    rows = spark.range(2_000).select(
        F.concat(F.lit("/f/"), F.col("id")).alias("path"),
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.hash("id") % 40)
        .cast("bigint").alias("size"),
    )
    whole = rows.orderBy(*sort_order(sort)).collect()
    cut = ranges_of(rows, sort, count=16)
    assert cut.totals == {"total_count": 2_000, "total_size": sum(r["size"] or 0 for r in whole)}
    assert len(cut.starts) == 15 and max(cut.rows) < 800
    for offset, limit in ((0, 3), (cut.rows[0], 1), (650, 100), (1_990, 50), (700, None), (2_000, 5), (9, 0)):
        for top_rows in (1, 10_000):
            got = page_of_ranges(rows, sort, cut, offset, limit, top_rows).collect()
            assert got == whole[offset : None if limit is None else offset + limit], (offset, limit)
    assert page_of_ranges(rows, sort, ranges_of(rows.limit(0), sort), 0, 5).isEmpty()


def test_a_deep_page_writes_no_sorted_copy(spark):
    rows = spark.range(40_000).select(F.concat(F.lit("/f/"), F.col("id")).alias("path"), F.col("id").alias("size"))
    with session.removed_after(spark):
        found = search(with_parts(as_entries(rows)), sort="size", offset=20_000, limit=20)
        page = found.page_with_totals
        assert [r["size"] for r in page.collect()] == list(range(20_000, 20_020))
        assert page.first()["total_count"] == 40_000
        assert session._GIVEN.lists[-1] == []


def test_page_after(spark, entries):
    data = entries(*[(f"/f/{i:03d}", i % 7) for i in range(100)])
    for sort in ("size-desc", "size", "path", "path-desc", "name"):
        whole = page(data, sort).collect()
        key = sort_order(sort)
        column = "size" if sort.startswith("size") else "path" if "path" in sort else "name"
        for at in (0, 13, 98):
            last = (whole[at][column], whole[at]["path"])
            got = [r["path"] for r in page_after(data, sort, last, 10).collect()]
            assert got == [r["path"] for r in whole[at + 1 : at + 11]], (sort, at, key)


def jobs(spark, work):
    """How many jobs the work started."""
    group = f"count-{id(work)}"
    spark.sparkContext.setJobGroup(group, "")
    result = work()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), result


def test_searches_are_lazy_and_totals_take_no_second_scan(spark, entries, tmp_path):
    save_catalogue(entries(*[(f"/f/{i:03d}", i) for i in range(50)]), str(tmp_path / "c"))
    data = load_catalogue(spark, str(tmp_path / "c"))
    n, found = jobs(spark, lambda: search(data, "0", sort="size-desc", offset=3, limit=20_000))
    assert n == 0
    n, _ = jobs(spark, lambda: found.totals)
    assert n == 0
    small = search(data, "0", sort="size-desc", offset=3, limit=4)
    n, rows = jobs(spark, lambda: small.page_with_totals)
    assert n == 1
    got = rows.collect()
    expected = small.page.collect()
    assert [r["path"] for r in got] == [r["path"] for r in expected]
    totals = small.totals.first()
    assert {(r["total_count"], r["total_size"]) for r in got} == {tuple(totals)}
    assert search(data, "nothing", limit=4).page_with_totals.collect() == []
    assert search(data, files=True, folders=True, limit=4).page_with_totals.collect() == []
    assert search(data, "0", limit=0).page_with_totals.collect() == []


def test_nothing_vanishes_in_silence(spark, entries, tmp_path):
    rows = entries(*[f"/d/{i}" for i in range(100)]).select(*ENTRY.fieldNames())
    rows.repartition(4).write.parquet(str(tmp_path / "inv"))
    part = sorted((tmp_path / "inv").glob("part-*"))[0]
    part.write_bytes(b"damaged" + part.read_bytes()[100:200])
    for crc in (tmp_path / "inv").glob(".part-*.crc"):
        crc.unlink()
    with pytest.raises(Exception):
        read_inventory(spark, str(tmp_path / "inv")).collect()
    kept = read_inventory(spark, str(tmp_path / "inv"), skip_unreadable=True)
    assert 0 < kept.count() < 100
    silent = silent_files(spark, str(tmp_path / "inv")).collect()
    assert [r["file"] for r in silent] == [str(part)]
    refresh(spark, str(tmp_path / "c"), rows)
    stats, diff = refresh(spark, str(tmp_path / "c"), kept, complete=False)
    assert stats.entries == 100 and diff.filter("status <> 'same'").isEmpty()


def test_paths_of_every_store_are_taken(entries):
    data = entries("s3a://bucket/tmp.d/x", "hdfs://n/a/b.tmp", "rel/x", "/abs", "s3a://b.tmp/.h/y", "s3a://b.tmp/z")
    bare = data.drop("name", "parent", "extension", "name_lc")
    assert paths(build_catalogue(bare)) == ["/abs", "hdfs://n/a/b.tmp", "rel/x", "s3a://b.tmp/z", "s3a://bucket/tmp.d/x"]
    rule = Excludes(patterns=("*.tmp",))
    assert paths(build_catalogue(bare, excludes=rule)) == ["/abs", "rel/x", "s3a://b.tmp/z", "s3a://bucket/tmp.d/x"]
    only = Excludes(include_only=("x", "rel", "tmp.d"))
    assert paths(build_catalogue(bare, excludes=only)) == ["rel/x", "s3a://bucket/tmp.d/x"]


def test_repeated_paths_are_an_error(spark, entries, tmp_path):
    with pytest.raises(ValueError, match="repeat the path"):
        save_catalogue(entries("/a", "/b", "/a"), str(tmp_path / "c"))
    with pytest.raises(FileNotFoundError):
        load_catalogue(spark, str(tmp_path / "c"))


def written_text(folder):
    return "".join(open(f, newline="").read() for f in sorted(glob.glob(f"{folder}/part-*")))


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([('/tmp/a"b,c.txt',), ("/tmp/d e",)], "path string").coalesce(1)
    cases = {
        ("csv", True): '"Name"\r\n"/tmp/a""b,c.txt"\r\n"/tmp/d e"\r\n',
        ("csv", False): '"/tmp/a""b,c.txt"\r\n"/tmp/d e"\r\n',
        ("tsv", True): 'Name\n/tmp/a"b,c.txt\n/tmp/d e\n',
        ("tsv", False): '/tmp/a"b,c.txt\n/tmp/d e\n',
        ("txt", True): '/tmp/a"b,c.txt\n/tmp/d e\n',
        ("efu", True): '/tmp/a"b,c.txt\n/tmp/d e\n',
    }
    for (format, header), expected in cases.items():
        folder = str(tmp_path / f"{format}-{header}")
        export(rows, format, folder, header=header)
        assert written_text(folder) == expected, format
    # Many parts still have one header, and keep the order.
    many = spark.range(1000).selectExpr("concat('/p/', id) AS path").repartition(7).orderBy("path")
    export(many, "csv", str(tmp_path / "many"))
    lines = written_text(str(tmp_path / "many")).split("\r\n")[:-1]
    assert lines == ['"Name"', *sorted(f'"/p/{i}"' for i in range(1000))]
    none = rows.filter("false")
    export(none, "txt", str(tmp_path / "none"))
    assert written_text(str(tmp_path / "none")) == ""
    with pytest.raises(NoResults):
        export(none, "csv", str(tmp_path / "err"), on_empty="error")
    export(none, "csv", str(tmp_path / "hide"), on_empty="hide")
    assert not (tmp_path / "hide").exists()
    with pytest.raises(ValueError):
        export(rows, "xml", str(tmp_path / "xml"))


def test_schema_of_a_catalogue(entries):
    assert entries("/a").select(*ENTRY.fieldNames()).schema == ENTRY
