"""Top-k search against all products."""

import random

import pytest
from compare import compare, connect

from pathlode.llm import topk
from pathlode.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_query(spark):
    assert compare(spark, connect(FOLDER), FOLDER, QUERIES["op5_topk"], ORACLE["op5_topk"]) is None


def brute(rows, wanted, best):
    out = set()
    for q, v in wanted:
        scored = [(-sum(a * b for a, b in zip(v, x, strict=False)), i) for i, x in rows if i != q]
        for rank, (score, i) in enumerate(sorted(scored)[:best], 1):
            out.add((q, rank, i, -score))
    return out


@pytest.mark.parametrize("copies", [0, 60])
def test_search(spark, monkeypatch, copies):
    rng = random.Random(4)
    centres = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(copies)]
    monkeypatch.setattr(topk, "SAMPLE", 50)
    monkeypatch.setattr(topk, "PIVOTS", 8)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 8 * 8 * 15)  # several blocks of queries
    vectors = topk.stored(topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "v")
    index = topk.build_index(vectors, annulus=16)
    got = {tuple(r) for r in topk.search(index, vectors.filter("vec_id % 10 = 0"), 5).collect()}
    whole = [(r["vec_id"], r["v"]) for r in vectors.collect()]
    assert got == brute(whole, [(i, v) for i, v in whole if i % 10 == 0], 5)


def test_bounds_skip_annuli(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [float(k == i % 8) * 4 + rng.gauss(0, 0.02) for k in range(8)]) for i in range(800)]
    vectors = topk.stored(topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "v")
    index = topk.build_index(vectors, annulus=32)
    annuli = index.annuli.toPandas()
    opened = []
    real = topk._products
    monkeypatch.setattr(topk, "_products", lambda a, b: opened.append(len(b)) or real(a, b))
    query = [r for r in vectors.filter("vec_id = 8").collect()]
    q = topk._matrix([r["v"] for r in query], index.width)
    flat = topk.np.hstack([q.astype(float), topk.np.zeros((1, 1))])
    ids = topk.np.array([8])
    floor = topk._first_floor(index, ids, q, 10)
    opened.clear()
    held = type("Held", (), {})()
    held.value = (ids, q, topk._distances(flat, index.pivots), (flat**2).sum(axis=1), floor, index.longest)
    list(topk._searched(held, 10)([annuli]))
    assert 0 < len(opened) < len(annuli) / 2


def test_blocks_go_to_few_lanes(spark, monkeypatch):
    """Clustered queries are sent to the lanes near them only, and the driver takes no query."""
    rng = random.Random(6)
    rows = [(i, [float(k == i % 8) * 4 + rng.gauss(0, 0.02) for k in range(8)]) for i in range(1600)]
    vectors = topk.stored(topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "v")
    monkeypatch.setattr(topk, "BLOCK_BYTES", 8 * 8 * 4)
    sent = []
    real = topk.stored
    monkeypatch.setattr(topk, "stored", lambda df, label: sent.append((label, real(df, label))) or sent[-1][1])
    index = topk.build_index(vectors, annulus=16)
    got = topk.search(index, vectors.filter("vec_id % 20 = 0"), 3)
    whole = [(r["vec_id"], r["v"]) for r in vectors.collect()]
    assert {tuple(r) for r in got.collect()} == brute(whole, [(i, v) for i, v in whole if i % 20 == 0], 3)
    blocks = dict(sent)["query-blocks"].selectExpr("size(lanes) AS n", "length(q_ids) / 8 AS q").collect()
    lanes = index.lanes["lane"].nunique()
    assert len(blocks) >= 20 and max(b["q"] for b in blocks) <= 4
    assert sum(b["n"] for b in blocks) < 0.5 * lanes * len(blocks)


def test_queries_longer_than_the_index(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0]), (3, [1.0, 1.0, 9.0])], "vec_id long, embedding array<double>")
    vectors = topk.stored(topk.usable(rows), "v")
    index = topk.build_index(topk.stored(vectors.filter("vec_id < 3"), "v"))
    got = sorted(map(tuple, topk.search(index, vectors.filter("vec_id = 3")).collect()))
    k = 1024 * 1024
    assert got == [(3, 1, 1, 3 * k), (3, 2, 2, 3 * k)]


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 0.0]), (None, [9.0, 9.0])]
    rows += [(5, [1.0]), (6, []), (100, [1.0, -1.0]), (100, [1.0, -1.0]), (7, [-0.0001, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr(
        "*", "1 AS rank", "2 AS score", "3 AS v"
    )
    vectors = topk.stored(topk.usable(table), "v")
    assert sorted(r["vec_id"] for r in vectors.collect()) == [0, 5, 6, 7, 100, 100]
    got = sorted(map(tuple, topk.search(topk.build_index(vectors), vectors.filter("vec_id % 100 = 0")).collect()))
    k = 1024
    assert [r for r in got if r[0] == 0] == [
        (0, 1, 5, k * k),
        (0, 2, 6, 0),
        (0, 3, 7, -k),
        (0, 4, 100, -k * k),
        (0, 5, 100, -k * k),
    ]
    assert [r for r in got if r[0] == 100] == [(100, 1, 5, k * k), (100, 2, 6, 0), (100, 3, 7, -k), (100, 4, 0, -k * k)]
    none = topk.stored(vectors.limit(0), "v")
    assert topk.search(topk.build_index(none), none).collect() == []
    assert topk.search(topk.build_index(vectors), none).collect() == []


def test_products_beyond_floating_point():
    a = topk.np.array([[2**31, 1]], dtype=topk.np.int64)
    assert topk._products(a, a).tolist() == [[2**62 + 1]]
