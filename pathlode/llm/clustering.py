"""Centroid clustering of whole-number vectors in built-in expressions only.

All centroids are one literal array of arrays. Per row, ``zip_with`` and ``aggregate`` give the
squared distance to each, and ``array_min`` of (distance, number) structs picks the cluster. A
round sums the components as plain columns grouped by cluster, combined before the shuffle, so
what reaches the driver is one row per cluster. No Python runs on the executors.
"""

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlode.llm.common import stored

SCALE, WIDTH, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1

Centroids = list[list[int]]


def usable(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = SCALE,
    width: int = WIDTH,
) -> DataFrame:
    """``key``, ``v``: components floor(scale x) of the vectors of ``width`` finite components.

    Null vectors and those of another width, or with null, NaN or infinite components, are left
    out; null keys stay. Squared distances and sums must fit 64 bits.
    """
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = F.transform("x", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    kept = vectors.select(F.col(key).alias("key"), F.col(vector).alias("x")).filter(F.size("x") == width)
    return kept.filter(~bad).select("key", whole.alias("v"))


def first_centroids(vectors: DataFrame, count: int = CLUSTERS, seed: int = SEED) -> Centroids:
    """The ``count`` vectors with the smallest SHA-256 of ``seed:key``, in that order (all, if fewer).

    Repeated keys are ordered by their vectors; null keys come last.
    """
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    rows = vectors.orderBy(mark.asc_nulls_last(), "v").limit(count).select("v").collect()
    return [list(r["v"]) for r in rows]


def nearest(vector: str | Column, centroids: Centroids) -> Column:
    """Struct of ``distance`` and ``cluster``: the nearest centroid, the smaller number of equals."""
    column = F.col(vector) if isinstance(vector, str) else vector
    literal = F.expr(
        f"array({', '.join('array(' + ', '.join(f'{x}L' for x in c) + ')' for c in centroids)})"
    )

    def distance(centroid: Column) -> Column:
        squares = F.zip_with(column, centroid, lambda a, b: (a - b) * (a - b))
        return F.aggregate(squares, F.lit(0).cast("long"), lambda total, x: total + x)

    return F.array_min(
        F.transform(literal, lambda c, k: F.struct(distance(c).alias("distance"), k.alias("cluster")))
    )


def updated(vectors: DataFrame, centroids: Centroids) -> Centroids:
    """Each centroid replaced by the floor of its vectors' mean; one without vectors stays."""
    sums = [F.sum(F.get("v", F.lit(k))).alias(f"s{k}") for k in range(len(centroids[0]))]
    rows = (
        vectors.withColumn("cluster", nearest("v", centroids)["cluster"])
        .groupBy("cluster")
        .agg(F.count(F.lit(1)).alias("n"), *sums)
        .collect()
    )
    moved = list(centroids)
    for row in rows:
        _, n, *totals = row
        moved[row["cluster"]] = [total // n for total in totals]
    return moved


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> Centroids:
    """Centroids after ``rounds`` rounds; ``vectors`` as from ``usable``, best a stored table."""
    centroids = first_centroids(vectors, clusters, seed)
    for _ in range(rounds if centroids else 0):
        centroids = updated(vectors, centroids)
    return centroids


def digest(centroid: Sequence[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def assign(vectors: DataFrame, centroids: Centroids, key: str = "vec_id") -> DataFrame:
    """``key``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``.

    One row per row of ``vectors``, repeated ones included; no vectors or no centroids give none.
    """
    schema = vectors.select(F.col("key").alias(key)).schema[key].dataType.simpleString()
    if not centroids:
        return vectors.sparkSession.createDataFrame(
            [],
            f"`{key}` {schema}, cluster int, distance long, cluster_inertia long, inertia long, "
            "centroid_sha256 string",
        )
    placed = stored(
        vectors.select("key", nearest("v", centroids).alias("to")).select("key", "to.cluster", "to.distance"),
        "clusters",
    )
    sums = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}

    def of_cluster(values: Sequence[str]) -> Column:
        return F.get(F.expr(f"array({', '.join(values)})"), F.col("cluster"))

    return placed.select(
        F.col("key").alias(key),
        "cluster",
        "distance",
        of_cluster([f"{sums.get(k, 0)}L" for k in range(len(centroids))]).alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        of_cluster([f"'{digest(c)}'" for c in centroids]).alias("centroid_sha256"),
    )
