"""Edit matching against the distance table."""

import random

from pathlode.llm import decontamination as d
from pathlode.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def least_distance(item, text):
    """The least distance of the item to any substring, by the full table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
        row, best = new, min(best, new[-1])
    return best


def edited(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        at, what = rng.randrange(len(text)), rng.random()
        if what < 0.4:
            text[at] = rng.choice("abcde")
        elif what < 0.7 and len(text) > 1:
            del text[at]
        else:
            text.insert(at, rng.choice("abcde"))
    return "".join(text)


def test_matches_are_those_of_the_table():
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abc de") for _ in range(n))
    found = 0
    for _ in range(600):
        items = [(i, some(rng.randint(1, 45))) for i in range(3)]
        text = some(rng.randint(0, 50))
        source = d.normal(rng.choice(items)[1])
        if source and rng.random() < 0.7:
            text += f" {edited(rng, source, rng.randint(0, 5))} {some(10)}"
        got = d.Matcher(items, 0.15).find(text)
        line = d.normal(text)
        for n, (_, item) in enumerate(items):
            item = d.normal(item)
            least = least_distance(item, line) if item and line else 99
            if least > int(0.15 * len(item)):
                assert n not in got
                continue
            distance, start, end = got[n]
            assert distance == least == least_distance(item, line[start:end])
            found += 1
    assert found > 100


def test_awkward_rows(spark):
    item = "the quick brown fox jumps over the lazy dog and runs"
    near = item.replace("quick", "quack").replace("dog", "dig")
    rows = [(1, f"So: {item.upper()}!"), (2, f"x {near}"), (3, None), (4, ""), (5, "clean"), (1, f"So: {item.upper()}!")]
    rows += [(2**62 + 1, item), (None, item.replace(" ", " \n\t")), (6, "word " * 300_000 + item), (7, item[: len(item) // 2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS distance")
    items = spark.createDataFrame([(10, item), (11, None), (12, ""), (10, item), (None, "clean as can be"), (2**62 + 1, "large")], "item_id long, text string")
    got = d.find_leaks(docs.drop("item_id"), items).collect()
    places = sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in got), key=str)
    want = [(1, 10, 0), (1, 10, 0), (2, 10, 2), (None, 10, 0), (6, 10, 0), (2**62 + 1, 10, 0)]
    assert places == sorted(want * 2, key=str)
    assert {(r["start"], r["end"]) for r in got if r["doc_id"] == 1} == {(4, 4 + len(item))}
    # The same block by block.
    parts = d.find_leaks(docs.drop("item_id"), items, block_chars=10)
    assert sorted(map(str, parts.collect())) == sorted(map(str, got))
    kept = d.drop_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 7]
    assert d.find_leaks(docs.limit(0).drop("item_id"), items).collect() == []
    assert d.find_leaks(docs.drop("item_id"), items.limit(0)).collect() == []
    assert d.drop_leaks(docs, items.limit(0)).count() == len(rows)


def test_query(spark):
    """Exact holders by plain search; the others are within their budget."""
    docs = {r["doc_id"]: d.normal(r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = {r["item_id"]: d.normal(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    got = QUERIES["op6_leaks"](spark, FOLDER).collect()
    exact = {(i, j) for i, text in docs.items() for j, item in items.items() if item in text}
    assert exact and exact == {(r["doc_id"], r["item_id"]) for r in got if r["distance"] == 0}
    for r in got:
        item = items[r["item_id"]]
        assert r["distance"] <= d.ERROR_RATE * len(item)
        assert least_distance(item, docs[r["doc_id"]][r["start"] : r["end"]]) == r["distance"]
