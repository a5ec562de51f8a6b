"""Shards of bounded size by extendible hashing.

A directory is indexed by the leading bits of a key's hash. A bucket takes another bit
only while it is over the limit, so a key's shard is its shortest prefix whose rows fit.
Rows of one key go together unless they alone are over the limit; such a key counts as
one unit of the directory, and its rows go on with the bits of a hash of the row.

The bytes of all prefixes come from one aggregate per round over fine buckets, whose
number is a small multiple of the number of shards. Only units that no prefix of a round
could settle, such as the neighbours of a very large row, go on to the next round.
"""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlode.llm.common import stored
from pathlode.session import fits_broadcast

# Bits of a hash: 15 hexadecimal digits of a digest.
BITS = 60
# Bits a round looks at beyond those an even spread would need, and at most.
SPARE_BITS, ROUND_BITS = 4, 24


def key_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5 digest as a number; null counts as empty."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def prefix(bits: str, depth: str | int, of: str | int = BITS) -> Column:
    """The leading ``depth`` bits of a number of ``of`` bits."""
    return F.expr(f"shiftright({bits}, cast({of} - {depth} as int))")


def directory(units: DataFrame, limit: int, group: tuple[str, ...] = ()) -> DataFrame:
    """``units`` (distinct ``bits`` per group, ``bytes``, ``rows``) with their shard's figures.

    Adds ``depth``, ``shard_bytes`` and ``shard_rows``. A prefix fits when its bytes are
    within ``limit`` or it holds one unit only.
    """
    group = list(group)
    settled, start = [], 0
    while True:
        worst = (
            units.groupBy(*group, prefix("bits", start))
            .agg(*(f("bytes").alias(n) for f, n in ((F.sum, "b"), (F.max, "top"))), F.count("*").alias("n"))
            .agg(F.max("b").alias("b"), F.max("top").alias("top"), F.max("n").alias("n"))
            .first()
        )
        if worst["n"] is None:
            break
        # A unit over the limit must be parted from all the others in its bucket.
        parts = worst["n"] if worst["top"] > limit else min(worst["n"], worst["b"] // limit + 1)
        end = min(start + min((parts - 1).bit_length() + SPARE_BITS, ROUND_BITS), BITS)
        fine = stored(
            units.groupBy(*group, prefix("bits", end).alias("fine")).agg(
                F.sum("bytes").alias("b"), F.sum("rows").alias("r"), F.count("*").alias("n")
            ),
            "fine-buckets",
        )
        fits = stored(
            _at_depths(fine, F.sequence(F.lit(start), F.lit(end)), end)
            .groupBy(*group, "depth", "p")
            .agg(F.sum("b").alias("shard_bytes"), F.sum("r").alias("shard_rows"), F.sum("n").alias("n"))
            .filter((F.col("shard_bytes") <= limit) | (F.col("n") == 1))
            .drop("n"),
            "fitting-prefixes",
        )
        shortest = (
            _meetings(fine, fits, group, end)
            .groupBy(*group, "fine")
            .agg(F.min(F.struct("depth", "shard_bytes", "shard_rows")).alias("s"))
        )
        found = stored(
            units.withColumn("fine", prefix("bits", end))
            .join(shortest, [*group, "fine"], "left")
            .select(*units.columns, "s.*"),
            "shards",
        )
        settled.append(found.filter("depth IS NOT NULL"))
        if end == BITS:
            break
        units, start = found.filter("depth IS NULL").select(*units.columns), end + 1
    return reduce(DataFrame.unionByName, settled) if settled else found_nothing(units)


def _at_depths(fine: DataFrame, depths: Column, end: int) -> DataFrame:
    """Each fine bucket once per depth, with its prefix ``p`` there."""
    return fine.withColumn("depth", F.explode(depths)).withColumn("p", prefix("fine", "depth", end))


def _meetings(fine: DataFrame, fits: DataFrame, group: list[str], end: int) -> DataFrame:
    """Fine buckets with the fitting prefixes above them.

    A prefix of few bits is shared by very many fine buckets, so prefixes are broadcast from the
    shortest on, as long as they are measured as few; the fine buckets are not shuffled for them.
    What is left is so deep that without groups a prefix has few fine buckets: more than
    ``BROADCAST_ROWS`` prefixes fit no depth below 19, and a round has ``ROUND_BITS`` of them.
    """
    counts = fits.groupBy("depth").agg(F.count("*").alias("n")).collect()  # a row per depth
    near, total = [], 0
    for depth, n in sorted((r["depth"], r["n"]) for r in counts):
        total += n
        if not fits_broadcast(total, total * 8 * len(fits.columns)):
            break
        near.append(depth)
    far = sorted({r["depth"] for r in counts} - set(near)) if counts else [end]
    parts = []
    for depths, hint in ((near, F.broadcast), (far, lambda df: df)):
        if depths:
            tried = _at_depths(fine.select(*group, "fine"), F.array(*map(F.lit, depths)), end)
            parts.append(tried.join(hint(fits.filter(F.col("depth").isin(depths))), [*group, "depth", "p"]))
    return reduce(DataFrame.unionByName, parts)


def found_nothing(units: DataFrame) -> DataFrame:
    return units.selectExpr("*", "0 AS depth", "0L AS shard_bytes", "0L AS shard_rows")


def assign_shards(
    docs: DataFrame, limit: int, key: str = "doc_id", size: str = "bytes", row: str | None = None
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``bytes``, ``shard``, ``depth``, ``shard_bytes``,
    ``shard_rows``.

    ``size`` names the column of a row's bytes (null: 0). A shard is named ``b`` and its
    bits; a key over the limit is spread over shards with a further ``r`` and bits of its
    rows' own hash. Only a single row can be over the limit; it has a shard of its own.
    Null keys are one key. Rows are never cut or dropped; no rows give no rows. ``row`` names
    a column of distinct row numbers, which then comes along.
    """
    if limit < 1:
        raise ValueError("the limit must be at least one byte")
    rows = stored(
        docs.select(
            F.col(key).alias("key"),
            F.coalesce(F.col(size), F.lit(0)).cast("long").alias("bytes"),
            key_bits(F.col(key)).alias("bits"),
            (F.monotonically_increasing_id() if row is None else F.col(row).cast("long")).alias("row"),
        ),
        "shard-rows",
    )
    keys = rows.groupBy("bits").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
    units = stored(
        keys.withColumn("heavy", (F.col("bytes") > limit) & (F.col("rows") > 1)), "shard-keys"
    )
    placed = rows.join(
        directory(units, limit).drop("bytes", "rows"), "bits"
    )
    name = F.concat(F.lit("b"), _digits(prefix("bits", "depth"), "depth"))
    light = placed.filter("NOT heavy").withColumn("shard", name)
    heavy = placed.filter("heavy").select(
        "key",
        "row",
        "bytes",
        F.col("bits").alias("owner"),
        name.alias("own"),
        F.col("depth").alias("own_depth"),
        F.shiftrightunsigned(F.xxhash64("row"), 64 - BITS).alias("bits"),
        F.lit(1).cast("long").alias("rows"),
    )
    spread = directory(stored(heavy, "shard-heavy"), limit, ("owner",))
    spread = spread.withColumn(
        "shard",
        F.concat("own", F.lit("r"), _digits(prefix("bits", "depth"), "depth")),
    ).withColumn("depth", F.col("own_depth") + F.col("depth"))
    out = [F.col("key").alias(key), "bytes", "shard", "depth", "shard_bytes", "shard_rows"]
    out += [] if row is None else [F.col("row").alias(row)]
    return light.select(*out).unionByName(spread.select(*out))


def _digits(number: Column, length: str) -> Column:
    return F.lpad(F.bin(number), F.col(length), "0")


def write_shards(docs: DataFrame, shards: DataFrame, folder: str, key: str = "doc_id") -> None:
    """Write ``docs`` as one folder ``shard=...`` per shard; a null or repeated key is an error.

    :func:`shard_rows` names the shards of any rows.
    """
    named = shards.select(F.col(key).alias("_llm_key"), "shard")
    seen = named.groupBy("_llm_key").count().filter("count > 1 OR _llm_key IS NULL")
    if not seen.isEmpty():
        raise ValueError(f"{key} is null or repeated: number the rows with shard_rows")
    _write(docs.join(named, docs[key] == F.col("_llm_key")).drop("_llm_key"), folder, key)


def shard_rows(docs: DataFrame, limit: int, key: str = "doc_id", size: str = "bytes") -> DataFrame:
    """All rows of ``docs`` with ``shard``, whatever their keys; a ``shard`` of theirs goes.

    Shards are those of :func:`assign_shards`, to whose rows these ones are numbered.
    """
    marked = stored(
        docs.drop("shard").withColumn("_llm_row", F.monotonically_increasing_id()), "shard-docs"
    )
    named = assign_shards(marked, limit, key, size, row="_llm_row").select("_llm_row", "shard")
    return marked.join(named, "_llm_row").drop("_llm_row")


def _write(placed: DataFrame, folder: str, key: str) -> None:
    placed.repartition("shard").sortWithinPartitions("shard", key).write.partitionBy("shard").parquet(folder)
