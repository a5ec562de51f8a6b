"""Removal of lines that many documents share.

Lines are normalised and hashed once, in the pass that numbers and stores the documents. The
distinct hashes of a document are exploded and counted, which counts documents without a second
shuffle and combines before the only one. The lines of frequent hashes are flagged by position,
the flags of a document meet its text again, and the other lines are joined in their order.

Frequent hashes that are too many to broadcast are parted: those on a hundred-thousandth of all
lines, so at most 100,000 of them, are broadcast, and the rest meets the lines in a shuffled join,
where none is on more than that share.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlode.llm.common import stored
from pathlode.session import fits_broadcast, measure

MIN_DOCUMENTS, MIN_CHARS = 10, 1
# Frequent hashes that are broadcast in any case, at most; each is on more than this share of lines.
HOT_LINES = 100_000

BLANKS = " \t\n\x0b\x0c\r"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines_of(text: str | Column) -> Column:
    """The parts of a text between line feeds; null and empty texts are one empty line."""
    column = F.col(text) if isinstance(text, str) else text
    return F.split(F.coalesce(column, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line without ASCII blanks at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    # Where all characters are ASCII the built-in function changes nothing else, and is faster.
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(
        F.translate(bare, _CAPITALS, _CAPITALS.lower())
    )


def line_hash(line: Column, row: Column, min_chars: int = MIN_CHARS) -> Column:
    """MD5 of the line's key; of keys under ``min_chars`` code points the number of their row.

    Those are never counted; as a number they spread over a join, which one value would not.
    """
    key = line_key(line)
    return F.when(F.length(key) < min_chars, row.cast("string")).otherwise(F.md5(key))


def numbered(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS
) -> DataFrame:
    """A stored table of ``row``, ``key``, ``text`` and the ``hashes`` of its lines."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn(
        "row", F.monotonically_increasing_id()
    )
    hashes = F.transform(lines_of("text"), lambda line: line_hash(line, F.col("row"), min_chars))
    return stored(rows.withColumn("hashes", hashes), "line-hashes")


def frequent_lines(rows: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``hash``, ``documents`` of the hashes on at least so many rows of ``numbered``."""
    found = rows.select(F.explode(F.array_distinct("hashes")).alias("hash"))
    counts = found.filter(F.length("hash") == 32).groupBy("hash").agg(F.count(F.lit(1)).alias("documents"))
    return counts.filter(F.col("documents") >= min_documents)


def flags(rows: DataFrame, frequent: DataFrame, hot_lines: int = HOT_LINES, broadcast: bool = True) -> DataFrame:
    """``row``, ``dropped``: a flag per line, of the rows that lose one; ``frequent`` is stored."""
    lines = rows.select("row", F.posexplode("hashes").alias("at", "hash"))
    known = frequent.select("hash", F.lit(True).alias("drop"))
    if broadcast and fits_broadcast(*measure(frequent, "hash")):
        marked = lines.join(F.broadcast(known), "hash", "left")
    else:
        total = frequent.agg(F.sum("documents")).first()[0] or 0
        often = F.col("documents") * hot_lines > total
        hot = frequent.filter(often).select("hash", F.lit(True).alias("hot"))
        marked = lines.join(F.broadcast(hot), "hash", "left")
        # Hot lines need no partner any more; the number of their row keeps them spread.
        marked = (
            marked.withColumn("hash", F.when(F.col("hot"), F.col("row").cast("string")).otherwise(F.col("hash")))
            .join(known.join(F.broadcast(hot), "hash", "left_anti"), "hash", "left")
            .withColumn("drop", F.coalesce("drop", "hot"))
        )
    by_row = marked.groupBy("row").agg(
        F.max("drop").alias("any"),
        F.sort_array(F.collect_list(F.struct("at", F.coalesce("drop", F.lit(False)).alias("drop")))).alias("all"),
    )
    return by_row.filter("any").select("row", F.col("all")["drop"].alias("dropped"))


def drop_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_documents: int = MIN_DOCUMENTS,
    min_chars: int = MIN_CHARS,
    broadcast: bool = True,
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``kept`` (the text left), ``n_lines``, ``n_dropped``.

    A line goes from every document when its key is on at least ``min_documents`` rows and has
    ``min_chars`` code points. Each row is a document, also one whose key is null or repeated;
    its own repeats of a line count once. Null and empty texts are one empty line, which stays;
    a text that loses all lines is empty. No rows give no rows. Other columns are left out.
    """
    rows = numbered(docs, key, text, min_chars)
    frequent = stored(frequent_lines(rows, min_documents), "frequent-lines")
    marks = stored(flags(rows, frequent, broadcast=broadcast), "line-flags")
    count, lines = marks.agg(F.count(F.lit(1)), F.sum(F.size("dropped"))).first()
    if broadcast and fits_broadcast(count, (lines or 0) + 32 * count):
        marks = F.broadcast(marks)
    left = F.array_join(F.filter(lines_of("text"), lambda _, at: ~F.get("dropped", at)), "\n")
    return rows.join(marks, "row", "left").select(
        F.col("key").alias(key),
        F.when(F.col("dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(left).alias("kept"),
        F.size("hashes").cast("long").alias("n_lines"),
        F.coalesce(F.size(F.filter("dropped", lambda d: d)), F.lit(0)).cast("long").alias("n_dropped"),
    )
