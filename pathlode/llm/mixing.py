"""Mix sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, its source's target
over its source's size. The documents of a source stand in order of size, their
expected copies are summed up, one offset is added, and a document is emitted once for
every integer that the running sum passes. Neighbours in that order are alike in size,
so the words taken stay within about one large document of the target.

Only built-in functions are used. The running sum needs a document's rank within its
source; ranks come from one range sort of all sources together, so a source that holds
most rows is spread over many partitions, and from the counts per partition.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlode.llm.common import WORD, partition_of, stored

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3


def word_count(text: str | Column) -> Column:
    """Runs of anything but the six ASCII blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    docs: DataFrame,
    size: str = "size",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    max_copies: int = MAX_COPIES,
) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``.

    Sources in code point order, null last, take the weights in turn and share the size
    of all documents. A target stops at ``max_copies`` times its source's size and the
    excess is shared again by weight: with sources in order of the level at which they
    fill up, the common level is the largest that the sources not yet full could reach.
    An empty source has target 0. The windows run over one row per source.
    """
    ordered = Window.orderBy(F.col(source).asc_nulls_last())
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("nth"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.col("nth") % len(weights) + 1).cast("int"),
    )
    total = F.sum("source_size").over(everything).cast("double")
    full = F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("double")
    rest = F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return (
        docs.groupBy(source)
        .agg(F.sum(size).alias("source_size"))
        .withColumn("nth", F.row_number().over(ordered) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * max_copies)
        .withColumn("level", (total - full) / rest)
        .withColumn("level", F.max("level").over(everything))
        .withColumn(
            "target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))
        )
        .select(source, "source_size", "target")
    )


def offset(source: str, seed: int) -> Column:
    """The source's offset in (0, 1), a fixed one for each seed."""
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(source), F.lit(""))))
    return (F.conv(F.substring(mark, 1, 3), 16, 10).cast("long") + 0.5) / 4096


def mix(
    docs: DataFrame,
    size: str = "size",
    source: str = "source",
    key: str = "doc_id",
    weights: tuple[float, ...] = WEIGHTS,
    max_copies: int = MAX_COPIES,
    seed: int = 0,
    tie_breaker: str | None = None,
) -> DataFrame:
    """``docs`` with ``source_size``, ``target`` and the ``copies`` the mix takes of each row.

    Columns of these names are replaced; all others are carried along, so select what is
    needed first. Rows of equal size stand in order of the key's digest, then of
    ``tie_breaker`` (a text column), so results depend on neither partitioning nor order
    of the input; rows equal in all of these are interchangeable. Null keys and sources
    are values like any other; a null size counts as 0. No rows give no rows.
    """
    docs = docs.drop("source_size", "target", "copies")
    names = docs.columns
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    tie = F.xxhash64(tie_breaker) if tie_breaker else F.lit(0)
    order = [source, size, "_llm_key", "_llm_tie"]
    placed = stored(
        docs.withColumn(size, F.coalesce(F.col(size), F.lit(0)).cast("long"))
        .withColumns({"_llm_key": digest, "_llm_tie": tie})
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .drop("_llm_key", "_llm_tie")
        .withColumn("_llm_row", F.monotonically_increasing_id())
        .withColumn("_llm_part", partition_of(F.col("_llm_row"))),
        "mix",
    )
    earlier = Window.partitionBy(source).orderBy("_llm_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        placed.groupBy(source, "_llm_part")
        .agg(
            F.min("_llm_row").alias("_llm_first"),
            F.count(F.lit(1)).alias("_llm_rows"),
            F.sum(size).alias("_llm_size"),
        )
        .withColumn("_llm_before", F.coalesce(F.sum("_llm_rows").over(earlier), F.lit(0)))
    )
    targets = source_targets(parts, "_llm_size", source, weights, max_copies)
    starts = parts.select(
        F.col(source).alias("_llm_source"),
        F.col("_llm_part").alias("_llm_at"),
        (F.col("_llm_before") - F.col("_llm_first")).alias("_llm_shift"),
    ).join(targets, F.col("_llm_source").eqNullSafe(F.col(source))).drop(source)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("_llm_row") + F.col("_llm_shift")
    u = offset(source, seed)
    copies = F.floor(rate * (rank + 1) + u) - F.floor(rate * rank + u)
    at = (F.col("_llm_part") == F.col("_llm_at")) & F.col(source).eqNullSafe(F.col("_llm_source"))
    return (
        placed.join(starts, at)
        .withColumn("copies", copies.cast("long"))
        .select(*names, "source_size", "target", "copies")
    )


def take(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it has copies, by words of ``text``.

    Takes the options of ``mix``; the columns stay as they are.
    """
    source, key = options.get("source", "source"), options.get("key", "doc_id")
    whole = docs.select(
        F.struct(*docs.columns).alias("doc"),
        F.col(source).alias("source"),
        F.col(key).alias("key"),
        word_count(text).alias("size"),
        F.xxhash64(text).alias("tie"),
    )
    taken = mix(whole, **options | {"source": "source", "key": "key", "tie_breaker": "tie"})
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return taken.filter("copies > 0").select("doc", copies).select("doc.*")
