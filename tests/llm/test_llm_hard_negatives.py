"""Hard negatives against all scores."""

import random

import numpy as np
import pytest
from compare import compare, connect

from pathlode.llm import hard_negatives as hn
from pathlode.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_query(spark):
    assert compare(spark, connect(FOLDER), FOLDER, QUERIES["op13_negatives"], ORACLE["op13_negatives"]) is None


@pytest.mark.parametrize("least,most", [(-256, 256), (-1, 0), (0, 0), (-(2**20), 3), (0, 255), (-7, 2**24)])
def test_lookups_give_inner_products(least, most):
    rng = np.random.default_rng(most + 3)
    width = 19
    a, c = (rng.integers(least, most + 1, (n, width)) for n in (13, 40))
    c[0], c[1] = least, most
    shape = hn.Shape(3, max((-least - 1).bit_length() if least < 0 else 0, most.bit_length()) + 1)
    planes = hn.bit_planes(shape.matrix(c), shape.planes)
    assert planes.shape == (shape.planes, 3, 40) and planes.dtype == np.uint8
    assert (hn.scores(planes, hn.subset_sums(shape.matrix(a))) == c @ a.T).all()
    assert (hn.scores(planes, shape.sums(shape.matrix(a))) == c @ a.T).all()


def test_subset_sums():
    sums = hn.subset_sums(np.arange(1, 9)[None])
    assert [sums[0, k, 0] for k in (0, 1, 2, 3, 0b10000001, 255)] == [0, 1, 2, 3, 9, 36]


def brute(rows, anchors, positives=5, negatives=10):
    out = []
    for a, label, v in {(i, g, tuple(v)) for i, g, v in anchors}:
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=False)), i, g) for i, g, w in rows if i != a)
        for s, i, _ in [r for r in scored if r[2] == label][:positives]:
            fit = [r for r in scored if r[2] != label and 30 * -s <= 100 * -r[0] <= 90 * -s][:negatives]
            out += [(a, i, k, r[1], -s, -r[0]) for k, r in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("copies", [0, 150])
def test_mine(spark, copies):
    rng = random.Random(13)
    centres = [[rng.uniform(-1, 1) for _ in range(11)] for _ in range(5)]
    rows = [(i, rng.randrange(4), [x + rng.gauss(0, 0.4) for x in rng.choice(centres)]) for i in range(400)]
    rows += [(1000 + i, i % 4, rows[10][2]) for i in range(copies)]  # many equal scores
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    vectors = hn.stored(hn.usable(frame.repartition(6)), "v")
    whole = [tuple(r) for r in vectors.collect()]
    wanted = [r for r in whole if r[0] % 10 == 0]
    index = hn.build_index(vectors, block_rows=37)
    assert index.blocks.agg({"c_rows": "sum"}).first()[0] == len(rows)
    found = hn.mine(index, vectors.filter("vec_id % 10 = 0"), block_rows=16)
    assert sorted(map(tuple, found.collect())) == brute(whole, wanted)
    few = hn.mine(index, vectors.filter("vec_id % 10 = 0"), positives=2, negatives=3)
    assert sorted(map(tuple, few.collect())) == brute(whole, wanted, 2, 3)


def test_scores_of_zero_and_below(spark):
    """A positive of score 0 takes negatives of score 0 only, one below 0 takes none."""
    rows = [(0, 0, [1.0, 0.0]), (1, 0, [0.0, 1.0]), (2, 0, [-1.0, 0.0]), (3, 1, [0.0, -1.0]), (4, 1, [-0.5, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    vectors = hn.stored(hn.usable(frame), "v")
    got = hn.mine(hn.build_index(vectors), vectors.filter("vec_id = 0")).collect()
    assert list(map(tuple, got)) == [(0, 1, 1, 3, 0, 0)]


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (1, 1, None), (2, None, [1.0, 1.0]), (3, 1, [nan, 1.0]), (4, 1, [inf, 0.0])]
    rows += [(None, 1, [1.0, 1.0]), (5, 1, [None, 1.0]), (6, 1, [1.0]), (7, 2, []), (8, 2, [0.5]), (8, 2, [0.5])]
    rows += [(0, 1, [1.0, 2.0]), (9, 2, [0.25, 0.25])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr(
        "*", "1 AS v", "2 AS x", "3 AS lane", "4 AS block"
    )
    vectors = hn.stored(hn.usable(table), "v")
    whole = [tuple(r) for r in vectors.collect()]
    assert sorted(r[0] for r in whole) == [0, 0, 6, 7, 8, 8, 9]
    index = hn.build_index(vectors)
    got = sorted(map(tuple, hn.mine(index, vectors.filter("vec_id % 100 = 0")).collect()))
    assert got == brute(whole, [r for r in whole if r[0] == 0])
    assert [r[3] for r in got] == [9, 8, 8]
    none = vectors.limit(0)
    assert hn.mine(index, none).collect() == []
    empty = hn.build_index(hn.stored(none, "v"))
    assert hn.mine(empty, none).collect() == [] and hn.mine(empty, vectors).collect() == []
    short = hn.stored(vectors.filter("vec_id = 7"), "v")  # vectors without components
    assert hn.mine(hn.build_index(short), short).collect() == []
