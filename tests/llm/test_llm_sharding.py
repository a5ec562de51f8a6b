"""Shards against their SQL and their rules."""

import hashlib
from collections import Counter

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from pathlode.llm import sharding
from pathlode.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_query(spark):
    assert compare(spark, connect(FOLDER), FOLDER, QUERIES["op8_shards"], ORACLE["op8_shards"]) is None


def bits(key):
    return bin(int(hashlib.md5(str(key).encode()).hexdigest()[:15], 16))[2:].zfill(60)


def brute(rows, limit):
    """Key -> shortest prefix of its bits whose rows fit, for keys that fit."""
    out = {}
    for key, _ in rows:
        for depth in range(61):
            same = [size for k, size in rows if bits(k)[:depth] == bits(key)[:depth]]
            if sum(same) <= limit or len(same) == 1:
                out[key] = (f"b{bits(key)[:depth]}", depth, sum(same), len(same))
                break
    return out


def check(rows, got, limit):
    """Every row is in one shard, and only lone rows are over the limit."""
    assert len(got) == len(rows)
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r)
    for members in shards.values():
        total = sum(r["bytes"] for r in members)
        assert {(r["shard_bytes"], r["shard_rows"]) for r in members} == {(total, len(members))}
        assert total <= limit or len(members) == 1
    names = sorted(shards)
    assert not any(b.startswith(a) and "r" not in b[len(a) :] for a, b in zip(names, names[1:], strict=False))


def test_directory(spark):
    rows = [(i, (i * 37) % 200 + (5000 if i % 150 == 0 else 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, bytes long")
    got = sharding.assign_shards(docs, 1000).collect()
    check(rows, got, 1000)
    want = brute(rows, 1000)
    assert all((r["shard"], r["depth"], r["shard_bytes"], r["shard_rows"]) == want[r["doc_id"]] for r in got)


def test_a_key_over_the_limit_is_spread(spark):
    rows = [(None if i % 3 == 0 else i, 10) for i in range(3000)] + [("", 4)]
    docs = spark.createDataFrame([(None if k is None else str(k), s) for k, s in rows], "doc_id string, bytes long")
    got = sharding.assign_shards(docs, 500).collect()
    check(rows, got, 500)
    heavy = {r["shard"] for r in got if r["doc_id"] is None}
    assert len(heavy) > 20 and all("r" in s for s in heavy)


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, 0), (2, 10**12), (None, 5)], "doc_id long, bytes long").selectExpr(
        "*", "1 AS shard", "2 AS depth", "3 AS bits", "4 AS key", "5 AS rows"
    )
    got = sharding.assign_shards(docs, 100).collect()
    check([1, 2, 3, 4], got, 100)
    assert sorted(r["bytes"] for r in got) == [0, 0, 5, 10**12]
    assert sharding.assign_shards(docs.limit(0), 100).collect() == []
    small = sharding.assign_shards(docs.filter("doc_id = 1"), 100).collect()
    assert {(r["shard"], r["depth"]) for r in small} == {("b", 0)}


def test_write(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(300)], "doc_id long, text string")
    shards = sharding.assign_shards(docs.selectExpr("doc_id", "octet_length(text) AS bytes"), 1000)
    sharding.write_shards(docs, shards, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 300
    sizes = back.groupBy("shard").agg({"text": "count"}).count()
    assert sizes == shards.select("shard").distinct().count() == len(list((tmp_path / "out").glob("shard=*")))


def test_rows_of_null_and_repeated_keys(spark, tmp_path):
    rows = [(None if i % 3 == 0 else i % 40, f"t{i}", 9) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bytes long").withColumn("shard", F.lit("own"))
    got = sharding.shard_rows(docs, 300).collect()
    assert sorted(r["text"] for r in got) == sorted(t for _, t, _ in rows)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["bytes"]
    assert max(sizes.values()) <= 300 and len(sizes) > 18
    for some in (docs.filter("doc_id IS NULL").limit(1), docs.filter("doc_id = 7")):
        with pytest.raises(ValueError, match="null or repeated"):
            sharding.write_shards(some, sharding.assign_shards(some, 300), str(tmp_path / "out"))
    assert sharding.shard_rows(docs.limit(0), 300).collect() == []


@pytest.mark.parametrize("rows_at_most", [0, 3, 40])
def test_prefixes_beyond_a_broadcast(spark, monkeypatch, rows_at_most):
    """Prefixes that are too many to be broadcast are met by a shuffle, with the same shards."""
    rows = [(i, (i * 37) % 200 + (5000 if i % 150 == 0 else 0)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, bytes long")
    monkeypatch.setattr(sharding, "fits_broadcast", lambda n, size: n <= rows_at_most)
    want = brute(rows, 1000)
    got = sharding.assign_shards(docs, 1000).collect()
    assert {r["doc_id"]: (r["shard"], r["depth"], r["shard_bytes"], r["shard_rows"]) for r in got} == want
