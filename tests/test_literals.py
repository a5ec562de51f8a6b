import pytest
from pyspark.sql import functions as F

from pathlode.functions.dates import day_bounds, day_start_of_text, epoch_day, start_of_day
from pathlode.functions.patterns import PatternError, spark_regex
from pathlode.functions.sizes import (
    format_size,
    format_size_ui,
    parse_size,
    size_bounds,
    size_of_text,
)


def test_size_bounds():
    assert size_bounds(">1mb") == (1_000_001, None)
    assert size_bounds("1mb..10mb") == (1_000_000, 10_000_000)
    assert size_bounds("tiny-small") == (10_240, 102_400)
    assert size_bounds(">= 2 KB") == (2_000, None)
    assert size_bounds("<=7") == (None, 7)
    assert size_bounds("<1kb") == (None, 999)
    assert size_bounds("gigantic") == (134_217_729, 134_217_729)
    for bad in ("<0", "1mb..", "..5", "1.5kb", "5tb", "", "kb", "-5", "99999999999gb"):
        with pytest.raises(ValueError):
            size_bounds(bad)


def test_size_column_agrees_with_the_literal_form(spark):
    texts = ["5", " 5kb", "5 KB", "7mb", "2 gb", "Empty", "huge", "+4", "1.5kb", "5tb", "", "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in rows.select("t", size_of_text(F.col("t")).alias("v")).collect():
        try:
            expected = parse_size(row["t"])
        except ValueError:
            expected = None
        assert row["v"] == expected, row["t"]


def test_day_bounds():
    assert day_bounds("2025-01-01") == (1_735_689_600, 1_735_775_999)
    assert day_bounds("2025-1-1") == day_bounds("2025-01-01")
    assert day_bounds(" Today ", now=86_400 * 3 + 5) == (86_400 * 3, 86_400 * 4 - 1)
    assert day_bounds("yesterday", now=86_400 * 3 + 5) == (86_400 * 2, 86_400 * 3 - 1)
    assert epoch_day(1970, 1, 1) == 0
    assert epoch_day(1600, 2, 29) == -135_081
    for bad in ("2025-02-29", "2025-13-01", "2025-01", "not-a-date", "2025-1-1-1", "2025-0-1", ""):
        with pytest.raises(ValueError):
            day_bounds(bad)


def test_day_columns(spark):
    rows = spark.createDataFrame([("2025-1-1", 90_000), ("2025-02-29", -5)], "t string, s bigint")
    got = rows.select(day_start_of_text(F.col("t")).alias("d"), start_of_day(F.col("s")).alias("s"))
    assert [tuple(r) for r in got.collect()] == [(1_735_689_600, 86_400), (None, 0)]


def test_shown_sizes(spark):
    kb = 1024
    cases = {
        0: ("0 B", "0 B"),
        512: ("512 B", "512.0 B"),
        1023: ("1023 B", "1023.0 B"),
        kb: ("1.0 KB", "1.0 KB"),
        1280: ("1.2 KB", "1.3 KB"),
        1792: ("1.8 KB", "1.8 KB"),
        1536: ("1.5 KB", "1.5 KB"),
        kb * kb - 1: ("1024.0 KB", "1024.0 KB"),
        kb**2 * 5: ("5.0 MB", "5.0 MB"),
        kb**3 * 7 // 2: ("3.5 GB", "3.5 GB"),
        kb**4: ("1.0 TB", "1.0 TB"),
        kb**5 * 3000: ("3000.0 PB", "3000.0 PB"),
    }
    rows = spark.createDataFrame([(n,) for n in cases], "n bigint")
    n = F.col("n")
    shown = rows.select("n", format_size(n).alias("a"), format_size_ui(n).alias("b"))
    for row in shown.collect():
        assert (row["a"], row["b"]) == cases[row["n"]]


@pytest.mark.parametrize(
    "pattern",
    [
        "(foo",
        "foo)",
        "[a",
        "a]",
        "a{2",
        "(?P< foo",
        "a" * 513,
        "(" * 9 + "a" + ")" * 9,
        "|".join(f"p{i}" for i in range(34)),
        "[(]",
        r"(a)\1",
        "a(?=b)",
        "a(?!b)",
        "(?<=a)b",
        "(?<!a)b",
        r"\Qa\E",
        "*a",
        "a*+",
        "a{2}{3}",
        "a*??",
        "a{b}",
        "[a--b]",
        "[a~~b]",
        "(?R)a",
        "[[:nope:]]",
        r"\<word",
        r"word\>",
    ],
)
def test_refused_patterns(spark, pattern):
    with pytest.raises(PatternError):
        spark_regex(pattern)


@pytest.mark.parametrize(
    "pattern, text, expected",
    [
        (r"^foo\d+", "foo12", True),
        (r"b$", "ab\n", False),
        (r"(?m)b$", "ab\nc", True),
        (r"a.c", "a\rc", True),
        (r"a.c", "a\nc", False),
        (r"(?P<first>a)(?<second_one>b)", "ab", True),
        (r"[[:digit:]]{3}", "x123", True),
        (r"[[:digit:]]{3}", "x12", False),
        (r"[$]", "a$", True),
        (r"\$", "a$", True),
        (r"\w", "ß", True),
        (r"\d", "٣", True),
        (r"a{2,3}?b", "aab", True),
        (r"^a??b+?$", "ab", True),
        (r"(?i)ABC", "xabc", True),
        (r"(?i:a)B", "AB", True),
        (r"[+*{2}]", "{", True),
        (r"[a-c&&[b]]", "a", False),
        (r"\x{41}\v", "A\x0b", True),
        (r"[^[:space:]]", "\t ", False),
        (r"x\z", "x", True),
        (r"\p{L}+\.txt", "straße.txt", True),
    ],
)
def test_pattern_dialect(spark, pattern, text, expected):
    row = spark.createDataFrame([(text,)], "t string")
    assert row.select(F.col("t").rlike(spark_regex(pattern))).first()[0] is expected
