"""Connected components of a graph given as edges, by alternating star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlode.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count("*"),
            F.coalesce(F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)")), F.lit(0)),
        ).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """Edges (``child``, ``parent``) to one row (``child``, ``parent``) per node but the roots.

    A root is its component's smallest node. Each round hangs every node's larger
    neighbours below its smallest one, then does the same with the smaller ones; the number
    of rounds grows with the logarithm of a component's diameter. Neighbours are never
    collected: a node's minimum is an aggregate, joined back to its edges. Edges with a null
    and loops say nothing and are left out.
    """
    now = stored(
        edges.filter("child <> parent")
        .select(F.greatest("child", "parent").alias("child"), F.least("child", "parent").alias("parent"))
        .distinct(),
        "edges",
    )
    before, state = None, _state(now)
    while state != before and state[0]:
        both = now.select(F.col("child").alias("u"), F.col("parent").alias("v")).unionByName(
            now.select(F.col("parent").alias("u"), F.col("child").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            both.filter("v > u")
            .join(least, "u")
            .select(F.col("v").alias("child"), F.col("m").alias("parent"))
            .distinct()
        )
        lowest = large.groupBy("child").agg(F.min("parent").alias("m"))
        small = (
            large.join(lowest, "child")
            .select(F.explode(F.array("child", "parent")).alias("child"), F.col("m").alias("parent"))
            .filter("child <> parent")
            .distinct()
        )
        now = stored(small, "edges")
        before, state = state, _state(now)
    return now
