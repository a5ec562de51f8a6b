"""Centroid clustering against plain Python."""

import hashlib
import math
import random

from compare import compare, connect

from pathlode.llm import clustering
from pathlode.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_query(spark):
    frames = []

    def query(*args):
        frames.append(QUERIES["op11_clusters"](*args))
        return frames[0]

    assert compare(spark, connect(FOLDER), FOLDER, query, ORACLE["op11_clusters"]) is None


def brute(rows, clusters, rounds):
    """Cluster and distance by key, and the centroids, by the definition."""

    def near(v, centres):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centres))

    mark = lambda r: hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()
    centres = [v for _, v in sorted(rows, key=lambda r: (mark(r), r[1]))[:clusters]]
    for _ in range(rounds):
        groups = {}
        for _, v in rows:
            groups.setdefault(near(v, centres)[1], []).append(v)
        for k, group in groups.items():
            centres[k] = [sum(x) // len(group) for x in zip(*group, strict=True)]
    return sorted((key, *near(v, centres)) for key, v in rows), centres


def test_rounds(spark):
    rng = random.Random(11)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(5)]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(80)]  # copies, so that centroids meet and some stay empty
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = clustering.stored(clustering.usable(frame, width=5), "v")
    for count, rounds in ((1, 2), (7, 0), (7, 3), (40, 4)):
        centres = clustering.fit(vectors, count, rounds)
        got = clustering.assign(vectors, centres).collect()
        whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
        want, final = brute(whole, count, rounds)
        assert centres == final
        assert sorted((r["vec_id"], r["distance"], r["cluster"]) for r in got) == want
        assert {r["inertia"] for r in got} == {sum(d for _, d, _ in want)}
        for r in got:
            assert r["cluster_inertia"] == sum(d for _, d, k in want if k == r["cluster"])
            text = ",".join(map(str, final[r["cluster"]]))
            assert r["centroid_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_no_python_and_one_row_a_cluster_to_the_driver(spark):
    frame = spark.createDataFrame([(i, [float(i % 9), 1.0]) for i in range(50)], "vec_id long, embedding array<float>")
    vectors = clustering.usable(frame, width=2)
    step = vectors.withColumn("c", clustering.nearest("v", [[0, 0], [64, 64]])["cluster"]).groupBy("c").count()
    plan = step._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan
    assert plan.count("HashAggregate") == 2


def test_equal_distances_go_to_the_smaller_number(spark):
    frame = spark.createDataFrame([(0, [1, 0]), (1, [3, 0]), (2, [-1, 0])], "key long, v array<long>")
    got = frame.select("key", clustering.nearest("v", [[2, 0], [2, 0], [0, 0]]).alias("n")).collect()
    assert {r["key"]: (r["n"]["cluster"], r["n"]["distance"]) for r in got} == {0: (0, 1), 1: (0, 1), 2: (2, 1)}


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [-inf, 0.0]), (5, [1.0]), (6, [])]
    rows += [(7, [1.0, 2.0, 3.0]), (None, [9.0, 9.0]), (8, [-0.01, 0.0]), (8, [-0.01, 0.0]), (8, [5.0, 5.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr(
        "*", "1 AS key", "2 AS v", "3 AS cluster", "4 AS distance", "5 AS x"
    )
    vectors = clustering.stored(clustering.usable(table, width=2), "v")
    assert sorted((r["key"] is None, r["key"] or 0, r["v"]) for r in vectors.collect()) == [
        (False, 0, [64, 128]),
        (False, 8, [-1, 0]),
        (False, 8, [-1, 0]),
        (False, 8, [320, 320]),
        (True, 0, [576, 576]),
    ]
    centres = clustering.fit(vectors, 16, 3)  # more than there are vectors; equal ones leave some empty
    got = clustering.assign(vectors, centres).collect()
    assert len(centres) == 5 and len(got) == 5
    assert {r["distance"] for r in got} == {0} and {r["inertia"] for r in got} == {0}
    assert [r["cluster"] for r in got if r["vec_id"] is None] == [4]
    none = vectors.limit(0)
    assert clustering.fit(none) == [] and clustering.assign(none, []).collect() == []
    assert clustering.assign(none, centres).collect() == []
    assert clustering.assign(vectors, []).columns == clustering.assign(vectors, centres).columns
