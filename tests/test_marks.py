import random
import time

from pyspark.sql import functions as F

from pathlode.functions.marks import mark_name, mark_path, render_ansi, strip_ansi


def slow_mark(name, needles):
    covered = set()
    for needle in needles:
        at = name.lower().find(needle.lower())
        while needle and at >= 0:
            covered.update(range(at, at + len(needle)))
            at = name.lower().find(needle.lower(), at + len(needle))
    out = ""
    for i, c in enumerate(name):
        opens = "*" if i in covered and i - 1 not in covered else ""
        closes = "*" if i in covered and i + 1 not in covered else ""
        out += opens + c + closes
    return out


def test_marks(spark):
    row = spark.createDataFrame([("/tmp/foo_bar.txt", "foobar")], "p string, n string")
    got = row.select(
        mark_path(F.col("p"), ["foo", "bar"]),
        mark_path(F.col("p"), ["missing"]),
        mark_path(F.col("p"), ["tmp"]),
        mark_name(F.col("n"), ["foo", "bar"]),
    ).first()
    assert tuple(got) == (
        "/tmp/*foo*_*bar*.txt",
        "/tmp/foo_bar.txt",
        "/tmp/foo_bar.txt",
        "*foobar*",
    )


def test_marks_against_brute_force(spark):
    rng = random.Random(3)
    names = sorted({"".join(rng.choices("abAB.", k=rng.randint(0, 9))) for _ in range(300)})
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    groups = [["aba", "bab"], ["ab"], ["a", "bb"], [".", "AA", "a.b"], ["b", "b"]]
    got = rows.select("n", F.array(*[mark_name(F.col("n"), g) for g in groups]).alias("m"))
    for row in got.collect():
        assert row["m"] == [slow_mark(row["n"], g) for g in groups], row["n"]


def test_colours(spark):
    texts = {
        "*foo*.txt": "\x1b[32mfoo\x1b[0m.txt",
        "**foo**.txt": "*foo*.txt",
        "*foo**bar*": "\x1b[32mfoo\x1b[0m\x1b[32mbar\x1b[0m",
        "a*b": "a*b",
        "a*": "a*",
        "***": "**",
        "": "",
        "x": "x",
        "*a\nb*": "\x1b[32ma\nb\x1b[0m",
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    shown = rows.select("t", render_ansi(F.col("t"), 10).alias("r"))
    for row in shown.select("t", "r", strip_ansi(F.col("r")).alias("s")).collect():
        assert row["r"] == texts[row["t"]]
        assert "\x1b" not in row["s"]
    back = rows.select(strip_ansi(F.lit("\x1b[32mfoo\x1b[0m.txt\x1b[3"))).first()[0]
    assert back == "foo.txt"


def long_names(spark):
    """Names of several thousand characters: work per character times length takes minutes on them."""
    name = F.concat(F.repeat(F.lit("small ring_bolt "), 250), F.col("id").cast("string"))
    return spark.range(200, numPartitions=1).select(name.alias("n"))


def test_long_names_are_marked_in_linear_time(spark):
    begun = time.monotonic()
    rows = long_names(spark).select("n", mark_name(F.col("n"), ["Ring", "SMALL", "g_b"]).alias("m")).collect()
    assert time.monotonic() - begun < 20
    assert all(r["m"] == slow_mark(r["n"], ["ring", "small", "g_b"]) for r in rows[:3])
