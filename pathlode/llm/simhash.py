"""Near-duplicates by SimHash fingerprints, linked through a vantage-point tree.

Fingerprints are computed on whole texts, one row at a time. The distinct ones are dealt
to the leaves of a vantage-point tree: a level has one random vantage point and a radius;
fingerprints nearer than the radius go inside, the others outside, and those that the
triangle bound cannot tell from their neighbours across the border go to both. Any two
fingerprints within the link distance therefore meet in some leaf. A leaf goes on splitting
in memory and gives the edges of a spanning forest, never all pairs. The number of levels
follows from the number of distinct fingerprints; a leaf that is larger than a task should
hold, as its fingerprints lie close together, is shared by tasks, block against block.
"""

import random

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from pathlode.llm.common import stored
from pathlode.llm.components import components
from pathlode.session import fits_broadcast, measure

SHINGLE_WORDS = 3
HASH_SEED = 42
LINK_DISTANCE = 2
# Distinct fingerprints a leaf should hold, and below which memory is searched through.
LEAF, SCANNED = 4096, 1024
# Measured rows of a leaf beyond which several tasks share it.
PART = 1 << 16
# Shingles whose bits are counted at once, and cells of one block of distances.
_BLOCK, _CELLS = 1 << 16, 1 << 20


def fingerprint(text: bytes | None) -> int:
    """The SimHash of one UTF-8 text, unsigned: 3-word shingles with repeats, XXH64.

    A bit is set if it is set in over half the hashes; fewer words than three are one
    shingle; null, empty and blank texts give 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends.tolist()][: max(len(words) - SHINGLE_WORDS + 1, 1)]
    ends = (ends - 1).tolist()[min(SHINGLE_WORDS, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), _BLOCK):
        spans = zip(starts[k : k + _BLOCK], ends[k : k + _BLOCK], strict=True)
        hashes = np.array([digest(line[a:b], HASH_SEED) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(counts * 2 > len(starts), bitorder="little")
    return int(set_bits.view("<u8")[0])


@pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    values = np.array([fingerprint(t) for t in texts], dtype=np.uint64)
    return pd.Series(values.view(np.int64))


def fingerprint_of(text: str) -> Column:
    """The fingerprint of a text column as a signed long."""
    return _fingerprints(F.col(text).cast("binary"))


def as_hex(fingerprints: str) -> Column:
    return F.lower(F.lpad(F.hex(fingerprints), 16, "0"))


# --- The tree over all fingerprints ------------------------------------------


def _vantage(level: int) -> int:
    return random.Random(level).getrandbits(64) - (1 << 63)


def _radius(counts: dict[int, int], reach: int) -> tuple[int, int]:
    """The radius that splits distances most evenly, and the size of its larger side."""

    def larger(radius):
        inner = sum(n for d, n in counts.items() if d < radius)
        return max(inner, sum(n for d, n in counts.items() if d >= radius - reach))

    best = min(range(66), key=larger)
    return best, larger(best)


def leaves(fingerprints: DataFrame, reach: int = LINK_DISTANCE, leaf: int = LEAF) -> DataFrame:
    """Distinct ``fp`` to rows (``fp``, ``leaf``): each fingerprint in every leaf it may link in."""
    total = fingerprints.count()
    levels, size = [], float(total)
    while size > leaf and len(levels) < 40:
        # A level leaves about 0.6 of its members on either side.
        levels.append(_vantage(len(levels)))
        size *= 0.6
    if not levels:
        return fingerprints.withColumn("leaf", F.lit(0).cast("long"))
    distance = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(v))) for v in levels]
    counted = (
        fingerprints.select(F.posexplode(F.array(*distance)).alias("level", "d"))
        .groupBy("level", "d")
        .count()
        .collect()  # at most 65 rows a level
    )
    sides = []
    for k, d in enumerate(distance):
        radius, _ = _radius({r["d"]: r["count"] for r in counted if r["level"] == k}, reach)
        sides.append(
            F.when(d < radius - reach, F.array(F.lit(0)))
            .when(d < radius, F.array(F.lit(0), F.lit(1)))
            .otherwise(F.array(F.lit(1)))
        )

    def below(leaves: Column, sides: Column) -> Column:
        return F.flatten(F.transform(leaves, lambda n: F.transform(sides, lambda s: n * 2 + s)))

    root = F.array(F.lit(0).cast("long"))
    return fingerprints.select("fp", F.explode(F.aggregate(F.array(*sides), root, below)).alias("leaf"))


def _in_parts(placed: DataFrame, most: int) -> DataFrame:
    """Leaves with ``part``: those of more than ``most`` rows are compared block against block.

    Vantage points cannot part a cloud of fingerprints that lie close together. Such a leaf is
    dealt to blocks by hash, and each two blocks are one part of at most about ``most`` rows; so
    any two rows of the leaf meet in some part. Other leaves are part 0.
    """
    big = stored(placed.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > most), "big-leaves")
    rows, size = measure(big)
    if not rows:
        return placed.withColumn("part", F.lit(0).cast("long"))
    blocks = F.ceil(F.col("n") * 2 / most)
    own = F.pmod(F.xxhash64("fp"), blocks)
    pairs = F.transform(
        F.filter(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda other: other != own),
        lambda other: F.least(own, other) * blocks + F.greatest(own, other),
    )
    parts = F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)
    known = placed.join(F.broadcast(big) if fits_broadcast(rows, size) else big, "leaf", "left")
    return known.select("fp", "leaf", F.explode(parts).alias("part"))


# --- Within a leaf -----------------------------------------------------------


def _scan(values: np.ndarray, reach: int) -> list[tuple[np.ndarray, int]]:
    """Spanning forest by search outwards from seeds; what was reached is not compared again."""
    found, free = [], values
    while len(free) > 1:
        seed, free = free[0], free[1:]
        frontier = free[:0]
        frontier = np.append(frontier, seed)
        while len(frontier) and len(free):
            step = max(_CELLS // len(free), 1)
            block, frontier = frontier[:step], frontier[step:]
            near = np.bitwise_count(block[:, None] ^ free[None, :]) <= reach
            hit = near.any(axis=0)
            if hit.any():
                found.append((free[hit], seed))
                frontier = np.append(frontier, free[hit])
                free = free[~hit]
    return found


def links(values: np.ndarray, reach: int = LINK_DISTANCE) -> list[tuple[np.ndarray, int]]:
    """Edges (array of fingerprints, one fingerprint) that connect all within ``reach``.

    ``values`` are distinct unsigned fingerprints. Splits on vantage points while that
    makes parts smaller, then scans.
    """
    found, open_parts, rng = [], [values], random.Random(0)
    while open_parts:
        part = open_parts.pop()
        if len(part) > SCANNED:
            d = np.bitwise_count(part ^ part[rng.randrange(len(part))])
            counts = dict(enumerate(np.bincount(d, minlength=65).tolist()))
            radius, larger = _radius(counts, reach)
            if larger < 0.85 * len(part):
                open_parts += [part[d < radius], part[d.astype(int) >= radius - reach]]
                continue
        found += _scan(part, reach)
    return found


def _leaf_edges(reach: int):
    def edges(leaf: pd.DataFrame) -> pd.DataFrame:
        values = np.unique(leaf["fp"].to_numpy(np.int64).view(np.uint64))
        found = links(values, reach)
        child = np.concatenate([c for c, _ in found] or [values[:0]])
        parent = np.repeat(
            np.array([p for _, p in found], dtype=np.uint64), [len(c) for c, _ in found]
        )
        return pd.DataFrame({"child": child.view(np.int64), "parent": parent.view(np.int64)})

    return edges


def linked(fingerprints: DataFrame, reach: int = LINK_DISTANCE) -> DataFrame:
    """Distinct ``fp`` to (``fp``, ``root``) for all that link to others but the roots themselves."""
    parts = _in_parts(leaves(fingerprints, reach), PART)
    edges = parts.groupBy("leaf", "part").applyInPandas(_leaf_edges(reach), "child long, parent long")
    return components(edges).select(F.col("child").alias("fp"), F.col("parent").alias("root"))


def near_duplicates(prints: DataFrame, key: str = "doc_id", reach: int = LINK_DISTANCE) -> DataFrame:
    """Rows with ``fp`` to the same rows with ``component_id``, the smallest key reachable.

    ``prints`` should be a stored table. Equal fingerprints link too, those of empty texts
    (0) included. Keys that are null are never the smallest; a component with no other key
    has a null id. Repeated rows stay. Other columns are carried along.
    """
    prints = prints.drop("component_id")
    each = stored(
        prints.groupBy("fp").agg(F.min(key).alias("first"), F.count("*").alias("n")), "prints"
    )
    roots = linked(each.select("fp"), reach)
    classes = each.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = classes.groupBy("root").agg(
        F.min("first").alias("component_id"), F.sum("n").alias("n")
    )
    # Documents that are alone need no row here: they are their own component.
    several = classes.select("fp", "root").join(first.filter("n > 1").drop("n"), "root")
    return (
        prints.join(several.select("fp", "component_id"), "fp", "left")
        .withColumn("component_id", F.coalesce("component_id", key))
        .select(*prints.columns, "component_id")
    )


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest key, null keys last.

    Of repeated rows one stays. Only the numbers of rows to drop meet the texts again.
    """
    marked = stored(
        docs.withColumn("_llm_fp", fingerprint_of(text)).withColumn(
            "_llm_row", F.monotonically_increasing_id()
        ),
        "fingerprinted",
    )
    prints = marked.select(
        F.col("_llm_fp").alias("fp"), F.col(key).alias("key"), F.col("_llm_row").alias("row")
    )
    each = stored(prints.select("fp").distinct(), "prints")
    classes = prints.join(linked(each), "fp", "left").select(
        F.coalesce("root", "fp").alias("root"), "key", "row"
    )
    classes = stored(classes, "classes")
    best = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row"))["row"]
    kept = classes.groupBy("root").agg(best.alias("row"))
    dropped = classes.join(kept, "row", "left_anti").select(F.col("row").alias("_llm_row"))
    return marked.join(dropped, "_llm_row", "left_anti").select(*docs.columns)
