"""Removal of shared lines against plain Python."""

import hashlib
import random
import time

import pytest
from compare import compare, connect

from pathlode.llm import line_dedup
from pathlode.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_query(spark):
    assert compare(spark, connect(FOLDER), FOLDER, QUERIES["op12_lines"], ORACLE["op12_lines"]) is None


def key_of(line):
    bare = line.strip(" \t\n\x0b\x0c\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in bare)


def brute(texts, least, chars=1):
    documents = {}
    for text in texts:
        for key in {key_of(x) for x in (text or "").split("\n")}:
            documents[key] = documents.get(key, 0) + 1
    out = []
    for text in texts:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key_of(x)) < chars or documents[key_of(x)] < least]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def ran(spark, texts, least, broadcast, chars=1):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = line_dedup.drop_lines(docs, min_documents=least, min_chars=chars, broadcast=broadcast)
    return [tuple(r)[1:] for r in sorted(got.collect())]


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("hot", [3, 100_000])
def test_random_texts(spark, monkeypatch, broadcast, hot):
    """Also with a line in nearly every document, which takes the path of hot lines."""
    monkeypatch.setattr(line_dedup.flags, "__defaults__", (hot, True))
    rng = random.Random(hot)
    pool = ["", " ", "\t\x0b", "Share this", "share THIS ", "\x0cshare this\r", "É é", "é É", "É É", "\xa0x", "x", "KK"]
    pool += [f"line {k}" for k in range(30)]
    texts = [None, "", "\n", "a\n\n", "same\nsame\nsame"]
    for _ in range(300):
        lines = rng.choices(pool, k=rng.randrange(9))
        texts.append("\n".join([*lines, "All rights reserved"] if rng.random() < 0.9 else lines))
    for least, chars in ((1, 1), (2, 1), (20, 0), (20, 2), (10_000, 1)):
        assert ran(spark, texts, least, broadcast, chars) == brute(texts, least, chars)


def test_each_row_is_a_document(spark):
    rows = [(None, "a\nb", 1, "x"), (1, "a", 2, "x"), (1, "a", 2, "x"), (2, None, 3, "x"), (3, "", 4, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long, hashes string").selectExpr(
        "*", "1 AS key", "2 AS dropped", "3 AS kept", "4 AS n_lines"
    )
    got = line_dedup.drop_lines(docs, min_documents=3)
    assert got.columns == ["doc_id", "kept", "n_lines", "n_dropped"]
    found = sorted(map(tuple, got.collect()), key=repr)
    assert found == [(1, "", 1, 1), (1, "", 1, 1), (2, "", 1, 0), (3, "", 1, 0), (None, "b", 2, 1)]
    # Blank lines alone, however many, and repeats within a document never count.
    assert ran(spark, ["x\nx\nx", "\n" * 50, "\n"], 2, True) == brute(["x\nx\nx", "\n" * 50, "\n"], 2)
    assert line_dedup.drop_lines(docs.limit(0)).collect() == []


def test_very_long_text(spark):
    lines = [f"line {k % 70_000}" for k in range(300_000)]
    texts = ["\n".join(lines), "\n".join(lines[:100]), "\n".join(reversed(lines))]
    began = time.time()
    got = ran(spark, texts, 3, False)
    assert time.time() - began < 60
    want = brute(texts, 3)
    digest = lambda rows: [(hashlib.md5(t.encode()).hexdigest(), *n) for t, *n in rows]
    assert digest(got) == digest(want)


def test_text_is_hashed_once_and_not_shuffled_for_few_lines(spark):
    docs = spark.createDataFrame([(i, f"a\n{i}") for i in range(40)], "doc_id long, text string")
    plan = line_dedup.drop_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in plan and "Python" not in plan
    assert plan.count("Exchange") == 1 and "BroadcastExchange" in plan
