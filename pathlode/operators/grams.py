"""Inverted tables over names: three-character grams, and first characters.

The stored index says in which buckets of a run of the catalogue's writer a gram
occurs: one bitmap of buckets per gram. A search intersects the bitmaps of its grams,
reads only the buckets they share of the entries it is given, and checks them in full;
entries of other runs, or without a bucket, are all read. So the index decides what is
read and never what is found. Files of a run never change, so its part of the index
holds for every version that names it, with or without a log of later events.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from pathlode.functions.paths import with_parts
from pathlode.operators.predicates import criteria
from pathlode.operators.terms import Substring, as_terms
from pathlode.session import fits_broadcast, folders_in, has_file, measure, written
from pathlode.sources.catalogue import latest_version, read_version

GRAM = 3


def grams_of(text: str) -> list[str]:
    """The distinct grams of a lowercased text."""
    text = text.lower()
    return list(dict.fromkeys(text[i : i + GRAM] for i in range(len(text) - GRAM + 1)))


def name_grams(entries: DataFrame) -> DataFrame:
    """The (path, gram) pairs of all distinct grams of lowercased names.

    A gram is kept where it first occurs in its name, which makes it distinct
    without a shuffle. A ``bucket`` column is carried along.
    """
    carried = [c for c in ("bucket",) if c in entries.columns]
    places = (
        with_parts(entries)
        .select("path", *carried, "name_lc")
        .filter(F.length("name_lc") >= GRAM)
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.length("name_lc") - (GRAM - 1))))
    )
    gram = F.substring(F.col("name_lc"), F.col("at"), F.lit(GRAM))
    return (
        places.withColumn("gram", gram)
        .filter(F.call_function("instr", F.col("name_lc"), F.col("gram")) == F.col("at"))
        .select("path", "gram", *carried)
    )


def gram_counts(postings: DataFrame) -> DataFrame:
    """Entries per gram."""
    return postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


# Buckets of one bitmap.
BITS = 32_768


@dataclass(frozen=True)
class GramIndex:
    """Per run of the writer a bitmap of the buckets that hold each gram."""

    bitmaps: DataFrame  # gram, part, bitmap, run
    runs: tuple[str, ...]


_BITMAPS = "gram string, part int, bitmap binary, run string"


def _runs_of(version: Row) -> dict[str, list[int]]:
    """The buckets that a version has of each run."""
    runs: dict[str, list[int]] = {}
    for b in version["buckets"]:
        if b["entries"]:
            runs.setdefault(b["run"], []).append(b["bucket"])
    return runs


def save_grams(spark: SparkSession, folder: str, partitions: int | None = None) -> GramIndex | None:
    """Build and store the index of the latest version of the catalogue in ``folder``.

    Only runs without an index are read, so after a compaction that is what it wrote. A gram is
    one row per run and 32,768 buckets, and the rows are clustered by gram, in ``partitions``
    ranges if given. None for a version without entries.
    """
    version = latest_version(spark, folder)
    there = set(_indexed_runs(spark, folder))
    for run, buckets in _runs_of(version).items():
        if run in there:
            continue
        entries = read_version(spark, version).filter(F.col("run") == run)
        found = name_grams(entries).select("gram", "bucket").distinct()
        part = F.floor(F.col("bucket") / BITS).cast("int").alias("part")
        bits = F.bitmap_construct_agg((F.col("bucket") % BITS).cast("bigint")).alias("bitmap")
        # All bitmaps of a part end with the byte of the highest bucket.
        ends = F.expr(f"map({', '.join(f'{k}, {_last_byte(buckets, k)}' for k in {b // BITS for b in buckets})})")
        rows = found.groupBy("gram", part).agg(bits).withColumn(
            "bitmap", F.substring("bitmap", F.lit(1), F.element_at(ends, F.col("part")))
        )
        ranges = [partitions, "gram", "part"] if partitions else ["gram", "part"]
        rows = rows.repartitionByRange(*ranges).sortWithinPartitions("gram", "part")
        place = f"{folder}/grams/run={run}"
        rows.write.mode("overwrite").option("compression", "zstd").parquet(place)
    return load_grams(spark, folder)


def _last_byte(buckets: list[int], part: int) -> int:
    return max(b % BITS for b in buckets if b // BITS == part) // 8 + 1


def _indexed_runs(spark: SparkSession, folder: str) -> list[str]:
    """The runs whose index was written to its end."""
    runs = [n.removeprefix("run=") for n in folders_in(spark, f"{folder}/grams")]
    return [r for r in runs if has_file(spark, f"{folder}/grams/run={r}/_SUCCESS")]


def load_grams(spark: SparkSession, folder: str) -> GramIndex | None:
    """The index of the runs of the latest version, or none if none of them has one."""
    wanted = _runs_of(latest_version(spark, folder))
    runs = tuple(r for r in _indexed_runs(spark, folder) if r in wanted)
    if not runs:
        return None
    place = f"{folder}/grams"
    files = spark.read.schema(_BITMAPS).option("basePath", place)
    return GramIndex(files.parquet(*[f"{place}/run={r}" for r in runs]), runs)


def gram_candidates(postings: DataFrame, text: str) -> DataFrame:
    """Paths whose name holds every gram of ``text``: the intersection of its lists."""
    grams = grams_of(text)
    if not grams:
        raise ValueError(f"a text needs {GRAM} characters to have grams")
    return (
        postings.filter(F.col("gram").isin(grams))
        .groupBy("path")
        .agg(F.count(F.lit(1)).alias("n_grams"))
        .filter(F.col("n_grams") == len(grams))
        .select("path")
    )


def candidate_buckets(index: GramIndex, texts: list[str]) -> DataFrame:
    """The buckets (``run``, ``bucket``) that hold every gram of all the texts.

    One aggregate intersects the bitmaps; what is left of them is turned into rows.
    """
    grams = list(dict.fromkeys(g for text in texts for g in grams_of(text)))
    shared = (
        index.bitmaps.filter(F.col("gram").isin(grams))
        .groupBy("run", "part")
        .agg(
            F.bitmap_and_agg("bitmap").alias("bits"),
            F.max(F.octet_length("bitmap")).alias("bytes"),
            F.count(F.lit(1)).alias("n"),
        )
        .filter(F.col("n") == len(grams))
    )
    hexed = F.hex(F.substring("bits", F.lit(1), F.col("bytes")))
    one = shared.select("run", "part", F.posexplode(F.split(hexed, "(?<=\\G..)")).alias("at", "byte"))
    byte = F.conv("byte", 16, 10).cast("int")
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.getbit(byte, k) == 1)).alias("bit")
    found = one.filter((F.col("byte") != "") & (F.col("byte") != "00")).select("run", "part", "at", bit)
    return found.select("run", (F.col("part") * BITS + F.col("at") * 8 + F.col("bit")).cast("int").alias("bucket"))


def gram_search(entries: DataFrame, index: GramIndex | None, text: str) -> DataFrame:
    """Entries whose name holds ``text`` in any case."""
    return seeded_matches(entries, index, terms=[Substring(text)])


def seeded_matches(entries: DataFrame, index: GramIndex | None, **wanted) -> DataFrame:
    """A search that reads only the buckets which can hold its texts.

    Usable are substring terms of at least three characters that read the name
    and stand outside any alternative or negation. The full condition is checked
    on every entry that is read, and entries come from ``entries`` alone.
    """
    terms = as_terms(wanted.get("terms", ()))
    reads_path = wanted.get("match_path")
    reads_path = bool(wanted.get("path")) if reads_path is None else reads_path
    seeds = [t.text for t in terms if isinstance(t, Substring) and len(t.text.lower()) >= GRAM]
    found = with_parts(entries).filter(criteria(**wanted))
    stored = {"bucket", "run"} <= set(entries.columns)
    if reads_path or not seeds or index is None or not stored:
        return found
    known = F.coalesce(F.col("run").isin(list(index.runs)) & F.col("bucket").isNotNull(), F.lit(False))
    buckets = candidate_buckets(index, seeds)
    seeded = found.filter(known).join(F.broadcast(buckets), ["run", "bucket"], "left_semi")
    return seeded.select(*found.columns).unionByName(found.filter(~known))


def refresh_postings(postings: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Postings after entries were removed (a table with ``path``), added or changed.

    Rows are keyed by path, so nothing has to be renumbered.
    """
    added = written(added, "added")
    gone = written(removed.select("path").union(added.select("path")).distinct(), "gone")
    if fits_broadcast(*measure(gone, "path")):
        gone = F.broadcast(gone)  # the postings are then not shuffled
    kept = postings.join(gone, "path", "left_anti").select(*postings.columns)
    return kept.unionByName(name_grams(added))


def prefix_buckets(entries: DataFrame) -> DataFrame:
    """Entries per first character of the lowercased name; empty names have no bucket."""
    first = F.substring("name_lc", 1, 1)
    named = with_parts(entries).filter(F.col("name_lc") != "")
    return named.groupBy(first.alias("first_char")).agg(F.count(F.lit(1)).alias("n"))
