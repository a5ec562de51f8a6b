"""Mixing against its SQL, its arithmetic, and awkward rows."""

import pytest
from compare import compare, connect

from pathlode.llm import mixing
from pathlode.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_query(spark):
    assert compare(spark, connect(FOLDER), FOLDER, QUERIES["op2_mix"], ORACLE["op2_mix"]) is None


def test_plan_is_native(spark):
    plan = QUERIES["op2_mix"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def fill(sizes, weights=(5, 2, 1), most=3):
    """Targets by handing out shares until nothing is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= most * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        target |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 10, "b": 1000, "c": 500, None: 3},
        {"a": 1, "b": 1, "c": 1000, "d": 5, "e": 0},
        {"only": 7},
        {None: 4},
        {"a": 0, "b": 0},
    ],
)
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(fill(sizes))


def test_taken_words_come_near_the_targets(spark):
    rows = [
        (i, None if i % 11 == 0 else f"s{i % 3}", (i * 7919) % 97 + (500 if i % 100 == 0 else 0))
        for i in range(4000)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and max(r["copies"] for r in got) <= 3
    largest = max(size for *_, size in rows)
    for source in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == source]
        assert sum(r["size"] * r["copies"] for r in mine) == pytest.approx(mine[0]["target"], abs=2 * largest)
    # The same whatever the partitions and the order of the rows.
    again = mixing.mix(docs.orderBy("size", "doc_id").repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_awkward_rows(spark):
    rows = [
        (1, "a b  c", "x"),
        (1, "a b  c", "x"),
        (None, None, None),
        (2, "", None),
        (3, "w " * 100_000, "x"),
        (4, "\xa0 é\tü", "y"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr(
        "*", "'t' AS target", "9 AS copies", "7L AS size", "5 AS doc", "3 AS key"
    )
    sizes = docs.select(mixing.word_count("text").alias("n")).collect()
    assert sorted(r["n"] for r in sizes) == [0, 0, 3, 3, 3, 100_000]
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    assert {r["target"] for r in taken.collect()} <= {"t"}
    mixed = mixing.mix(docs.drop("size").withColumn("size", mixing.word_count("text")))
    assert mixed.count() == len(rows)
    assert mixing.mix(docs.limit(0)).collect() == [] and mixing.take(docs.limit(0)).collect() == []
