import random

import pytest
from conftest import names
from pyspark.sql import functions as F

from pathlode import AnyOf, Glob, Not, Regex, Substring, colored, search
from pathlode.functions.globs import glob_suffix, glob_whole
from pathlode.operators.predicates import lookup, matches, name_starts_with
from pathlode.operators.terms import from_text, needles_of

ALL = [
    "NOTICE",
    "Old",
    "Plan A.ods",
    "Seeds.CSV",
    "draft_one.eml",
    "in.mbox",
    "seeds-2024.csv",
    "seeds-2024.csv.gz",
    "store",
]
POST = ["NOTICE", "draft_one.eml", "in.mbox"]
SEEDS = ["Seeds.CSV", "seeds-2024.csv", "seeds-2024.csv.gz"]


def without(*gone):
    return [n for n in ALL if n not in gone]


@pytest.mark.parametrize(
    "terms, wanted, expected",
    [
        ((), {}, ALL),
        ("sEEds", {}, SEEDS),
        ("Seeds", {"match_case": True}, SEEDS[:1]),
        ("sEEds", {"match_case": True}, []),
        ("post", {}, []),
        ("post", {"match_path": True}, POST),
        ("n a", {}, ["Plan A.ods"]),
        (["n", "a"], {"whole_word": True}, []),
        ("*.csv", {"whole_filename": True}, SEEDS[:2]),
        ("seed?-*", {}, SEEDS[1:]),
        ("o*", {"whole_word": True}, ["Old", "Plan A.ods"]),
        ("", {"ext": "csv"}, SEEDS[1:2]),
        ("", {"ext": "gz;eml"}, ["draft_one.eml", SEEDS[2]]),
        ((), {"folders": True}, ["Old", "store"]),
        ((), {"files": True}, without("Old", "store")),
        ((), {"files": True, "folders": True}, []),
        ((), {"attrib": "sd"}, ["Old", "store"]),
        ((), {"attrib": "rsh"}, ALL),
        ((), {"size": (640, 7_000)}, ["Plan A.ods", SEEDS[2]]),
        ((), {"size": ">7kb"}, SEEDS[1:2]),
        ([Not(Substring("e"))], {}, ["Old", "Plan A.ods", "in.mbox"]),
        ("draft|mbox", {}, ["draft_one.eml", "in.mbox"]),
        (["seeds", "gz"], {}, SEEDS[2:]),
        (["seeds", "mbox"], {}, []),
        ("draft", {"whole_word": True}, []),
        ("draft_one", {"whole_word": True}, ["draft_one.eml"]),
        ("2024", {"whole_word": True}, SEEDS[1:]),
        ([Regex("notic")], {"whole_word": True}, []),
        ([Regex("notice")], {"whole_word": True}, ["NOTICE"]),
        ([Regex("NOTICE")], {}, []),
        ([Regex("NOTICE")], {"match_case": True}, ["NOTICE"]),
        ([Regex(r"\.(eml|gz)$")], {}, ["draft_one.eml", SEEDS[2]]),
        ([Regex("in|i")], {"whole_word": True}, ["in.mbox"]),
        ([Regex("i|in")], {"whole_word": True}, []),
        ((), {"path": "attic"}, []),
        ("old", {"path": "STORE/o"}, ["Old", "Seeds.CSV"]),
        ("old", {"path": "STORE/o", "match_path": False}, ["Old"]),
    ],
)
def test_criteria(depot, terms, wanted, expected):
    assert names(matches(depot, terms=terms, **wanted)) == expected


def test_prefix_and_lookup(depot):
    assert names(name_starts_with(depot, "SEEDS")) == SEEDS
    assert names(name_starts_with(depot, "eeds")) == []
    assert names(name_starts_with(depot, "")) == ALL
    assert names(lookup(depot, "/store/Old")) == ["Old"]
    assert names(lookup(depot, "/store/old")) == []


def test_unicode(entries):
    data = entries("/tmp/Äpfel.txt", "/tmp/straße.rs", "/tmp/straßenbahn.rs")
    assert names(matches(data, terms="äpf")) == ["Äpfel.txt"]
    assert names(matches(data, terms="straße", whole_word=True)) == ["straße.rs"]
    assert names(matches(data, terms=[Regex(r"^\w+\.rs$")])) == ["straße.rs", "straßenbahn.rs"]


def test_extension_list_is_lower_case_and_the_stored_extension_is_not(entries):
    data = entries("/videos/lower.mkv", "/videos/upper.MKV", "/videos/mkv/")
    assert names(matches(data, ext="MKV")) == ["lower.mkv"]
    assert names(matches(data, terms=".MKV", match_case=True)) == ["upper.MKV"]
    assert names(matches(data, file_type="video")) == ["lower.mkv"]
    assert names(matches(data, ext=" ; ")) == ["lower.mkv", "mkv", "upper.MKV"]
    with pytest.raises(ValueError):
        matches(data, ext="mkv", file_type="video")


def test_glob_question_mark_after_star_is_literal(entries):
    data = entries("/foo.txt", "/f?o", "/xfoo")
    assert names(matches(data, terms="f?o")) == ["f?o", "xfoo"]
    assert names(matches(data, terms="*?o")) == ["f?o"]
    assert names(matches(data, terms="foo*")) == ["foo.txt", "xfoo"]


def slow_glob(text, pattern):
    """The glob rules, one character at a time."""
    if not pattern:
        return not text
    if pattern[0] == "*":
        rest = pattern.lstrip("*")
        if not rest:
            return True
        return any(
            text[i] == rest[0] and slow_glob(text[i + 1 :], rest[1:]) for i in range(len(text))
        )
    return bool(text) and pattern[0] in ("?", text[0]) and slow_glob(text[1:], pattern[1:])


def test_globs_against_brute_force(spark):
    rng = random.Random(7)
    texts = sorted({"".join(rng.choices("ab?.\n", k=rng.randint(0, 6))) for _ in range(300)})
    patterns = sorted({"".join(rng.choices("ab.**??", k=rng.randint(1, 5))) for _ in range(120)})
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t",
        F.array(*[glob_whole(F.col("t"), p) for p in patterns]).alias("whole"),
        F.array(*[glob_suffix(F.col("t"), p) for p in patterns]).alias("suffix"),
    )
    for row in rows.collect():
        for p, whole, suffix in zip(patterns, row["whole"], row["suffix"]):
            assert whole == slow_glob(row["t"], p), (row["t"], p)
            if "*" in p or "?" in p:
                found = any(slow_glob(row["t"][i:], p) for i in range(len(row["t"])))
            else:
                found = p in row["t"]
            assert suffix == found, (row["t"], p)


def test_plain_text_terms():
    assert from_text("foo|b*r||baz") == [AnyOf(Substring("foo"), Glob("b*r"), Substring("baz"))]
    assert from_text("|") == []
    terms = [Substring("foo"), Glob("b*a?"), Regex(r"x\d+"), Not(Substring("no")), AnyOf("p", "q")]
    assert needles_of(terms) == ["foo", "ba", "xd", "p", "q"]


def test_totals_before_paging(entries):
    data = entries(("/t/foo.txt", 5), ("/t/food.txt", 6), ("/t/bar", 9))
    found = search(data, "foo", limit=1)
    assert found.totals.first().asDict() == {"total_count": 2, "total_size": 11}
    assert names(found.page) == ["foo.txt"]
    assert [r["total_size"] for r in found.page_with_totals.collect()] == [11]
    assert search(data, "zzz").totals.first().asDict() == {"total_count": 0, "total_size": 0}


def test_highlighted_search(entries):
    data = entries("/tmp/foo_bar.txt", "/tmp/foo/BARfoo.txt")
    found = search(data, ["foo", "bar"], highlight=True)
    assert [r["path"] for r in found.page.collect()] == [
        "/tmp/foo/*BARfoo*.txt",
        "/tmp/*foo*_*bar*.txt",
    ]
    assert [r["path"] for r in search(data, highlight=True).page.collect()][1] == "/tmp/foo_bar.txt"
    shown = [r["path"] for r in colored(found.page).collect()]
    assert shown[0] == "/tmp/foo/\x1b[32mBARfoo\x1b[0m.txt"


def test_conditions_are_pushed_down_to_a_stored_catalogue(spark, depot, tmp_path):
    from pathlode import load_catalogue, save_catalogue

    save_catalogue(depot, str(tmp_path / "c"))
    stored = load_catalogue(spark, str(tmp_path / "c"))
    found = matches(stored, terms="foo", ext="txt;rs", size=">10").select("path")
    plan = found._jdf.queryExecution().executedPlan().toString()
    for pushed in ("StringContains(name_lc,foo)", "In(extension", "GreaterThanOrEqual(size,11)"):
        assert pushed in plan
    assert "created" not in plan.split("ReadSchema")[1]
