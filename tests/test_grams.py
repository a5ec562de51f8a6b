from conftest import names, paths

from pathlode import (
    gram_search,
    load_catalogue,
    load_grams,
    name_grams,
    save_catalogue,
    save_grams,
    search,
)
from pathlode.operators.grams import (
    candidate_buckets,
    gram_candidates,
    grams_of,
    prefix_buckets,
    refresh_postings,
    seeded_matches,
)
from pathlode.operators.terms import Not, Substring
from pathlode.plans.queries import QUERIES


def saved(spark, data, folder, partitions=6):
    """The entries as a catalogue of several buckets, and its index."""
    save_catalogue(data, str(folder), partitions=partitions)
    return load_catalogue(spark, str(folder)), save_grams(spark, str(folder))


def test_grams_of_names(entries):
    data = entries("/x/AbAbab", "/x/ab", "/x/äöü")
    got = sorted((r["path"], r["gram"]) for r in name_grams(data).collect())
    assert got == [("/x/AbAbab", "aba"), ("/x/AbAbab", "bab"), ("/x/äöü", "äöü")]
    assert grams_of("AAAA") == ["aaa"]


def test_search_reads_candidates_and_checks_them(spark, entries, tmp_path):
    documents = [f"/tmp/document-{i:04d}.txt" for i in range(2_000)]
    data = entries(*documents, "/videos/movie-one.mkv", "/videos/movie-two.MKV")
    assert paths(gram_candidates(name_grams(data), ".mkv")) == [
        "/videos/movie-one.mkv",
        "/videos/movie-two.MKV",
    ]
    data, index = saved(spark, data, tmp_path / "g")
    movies = ["/videos/movie-one.mkv", "/videos/movie-two.MKV"]
    assert paths(gram_search(data, index, ".mkv")) == movies
    assert paths(gram_search(data, index, "MOVIE-T")) == movies[1:]
    assert gram_search(data, index, "document").count() == 2_000
    assert gram_search(data, index, "never-present").isEmpty()
    assert gram_search(data, index, "1t").isEmpty()
    assert gram_search(data, index, "").count() == 2_002
    # Every gram of this text occurs, the text itself does not.
    assert gram_search(data, index, "ment-0000.t").count() == 1
    assert gram_search(data, index, "ment-000-one").isEmpty()
    case = seeded_matches(data, index, terms=".MKV", match_case=True)
    assert paths(case) == movies[1:]
    both = search(data, [".mkv", Not(Substring("two"))], grams=index, size=(0, 5))
    assert paths(both.matched) == movies[:1]
    in_path = seeded_matches(data, index, terms="videos", match_path=True)
    assert paths(in_path) == movies


def test_only_some_buckets_are_read(spark, entries, tmp_path):
    data = entries(*[f"/{c}/{c * 3}-{i:03d}.txt" for c in "abcdefgh" for i in range(40)])
    data, index = saved(spark, data, tmp_path / "g", partitions=8)
    buckets = candidate_buckets(index, ["ccc-0"]).count()
    assert 1 <= buckets < data.select("bucket").distinct().count()
    found = gram_search(data, index, "ccc-01")
    assert len(paths(found)) == 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "StringContains(name_lc,ccc-01)" in plan
    assert plan.count("FileScan parquet") < 5
    # The index is a small fraction of the catalogue.
    size = lambda f: sum(p.stat().st_size for p in (tmp_path / "g" / f).rglob("*.parquet"))
    assert size("grams") < size("data")


def test_answers_come_from_the_given_entries(spark, entries, tmp_path):
    data, index = saved(spark, entries("/a/report.txt", "/b/report.txt", "/a/x"), tmp_path / "g")
    for text in ("report", "re"):
        some = data.filter("path LIKE '/a/%'")
        assert paths(search(some, text, grams=index).matched) == ["/a/report.txt"]
    # A later version: the old index neither hides what is new nor shows what is gone.
    save_catalogue(entries("/b/report.txt", "/c/report-2.txt"), str(tmp_path / "g"))
    later = load_catalogue(spark, str(tmp_path / "g"))
    assert load_grams(spark, str(tmp_path / "g")) is None
    for known in (index, None, save_grams(spark, str(tmp_path / "g"))):
        assert paths(gram_search(later, known, "report")) == ["/b/report.txt", "/c/report-2.txt"]
    # Saving it again changes nothing; entries that are not stored are all read.
    again = save_grams(spark, str(tmp_path / "g"))
    assert len(again.runs) == 1
    assert paths(gram_search(entries("/z/report"), again, "report")) == ["/z/report"]


def test_repeated_grams(spark, entries, tmp_path):
    data, index = saved(
        spark, entries("/tmp/aaaa.txt", "/tmp/common-prefix-document.txt"), tmp_path / "g"
    )
    assert names(gram_search(data, index, "aaa")) == ["aaaa.txt"]
    assert gram_search(data, index, "common-never-present").isEmpty()


def test_refresh(entries):
    before = entries("/a/one.txt", "/a/two.txt", ("/a/three", 3))
    after = entries("/a/one.txt", ("/a/three", 4), "/a/four")
    changed = after.filter("path IN ('/a/three', '/a/four')")
    fresh = refresh_postings(name_grams(before), before.filter("path = '/a/two.txt'"), changed)
    key = lambda df: sorted((r["gram"], r["path"]) for r in df.collect())
    assert key(fresh) == key(name_grams(after))


def test_prefix_buckets(entries):
    data = entries("/a/Foo", "/a/fig", "/a/bar", "/a/b/")
    assert {r[0]: r[1] for r in prefix_buckets(data).collect()} == {"f": 2, "b": 2}


def test_a_refresh_reads_the_lines_once(spark):
    plan = QUERIES["gram_postings_refresh"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
    assert "lineitem" not in plan.toString()
