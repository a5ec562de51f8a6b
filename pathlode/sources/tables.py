"""The given tables seen as catalogue entries and change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlode.functions.filetypes import FILE_TYPES
from pathlode.operators.changes import as_changes
from pathlode.schema import ENTRY_FIELDS

FIRST_DAY = 1_704_067_200  # 2024-01-01 UTC


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _whole(column: str) -> Column:
    return F.floor(F.col(column)).cast("bigint")


def _pick(number: Column, texts: list[str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for i, text in enumerate(texts):
        out = F.when(number == i, text).otherwise(out)
    return out


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def doc_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Files with mixed-case, double and missing extensions, and their directories."""
    docs = table(spark, folder, "documents")
    home = F.concat(F.lit("/data/"), "source", F.lit("/"), "lang")
    ending = _pick(F.col("doc_id") % 6, [".txt", ".PDF", ".mkv", ".MKV", ".tar.gz"], "")
    modified = F.lit(FIRST_DAY) + F.col("doc_id") * 3600
    files = docs.select(
        F.concat(home, F.lit("/doc_"), _text("doc_id"), ending).alias("path"),
        F.lit(False).alias("is_dir"),
        F.col("n_chars").alias("size"),
        modified.alias("modified"),
        (modified - 86400 * (F.col("doc_id") % 30)).alias("created"),
        (modified + 60 * (F.col("doc_id") % 1000)).alias("accessed"),
    )
    folders = docs.select(home.alias("path")).distinct()
    return files.unionByName(
        folders.select(
            "path",
            F.lit(True).alias("is_dir"),
            F.lit(4096).cast("bigint").alias("size"),
            *[_zero().alias(c) for c in ("modified", "created", "accessed")],
        )
    )


def _untimed(rows: DataFrame, path: Column, size: Column) -> DataFrame:
    return rows.select(
        path.alias("path"),
        F.lit(False).alias("is_dir"),
        size.alias("size"),
        *[_zero().alias(c) for c in ("modified", "created", "accessed")],
    )


def part_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Names made of words."""
    name = F.concat("p_name", F.lit("_"), _text("p_partkey"), F.lit("."), F.lower("p_type"))
    path = F.concat(F.lit("/parts/"), "p_brand", F.lit("/"), name)
    return _untimed(
        table(spark, folder, "part"), path, F.col("p_size").cast("bigint") * 1024
    )


def asked_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Names with question marks."""
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("?")), F.lit("_"), _text("p_partkey"))
    path = F.concat(F.lit("/asked/"), name)
    return _untimed(table(spark, folder, "part"), path, F.col("p_size").cast("bigint"))


def page_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts and their paths; some end in a slash and so have an empty name."""
    bare = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^https?://", "")
    return _untimed(
        table(spark, folder, "pages"),
        F.concat(F.lit("/"), bare),
        F.length("html").cast("bigint"),
    )


LINE_ORDER = [
    "l_shipdate",
    "l_extendedprice",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_discount",
    "l_tax",
]


def line_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The large one; paths repeat.  Keeps the columns that order the repetitions."""
    flag = F.col("l_returnflag")
    ending = F.when(flag == "A", ".csv").when(flag == "N", ".jpg").otherwise(".zip")
    return table(spark, folder, "lineitem").select(
        F.concat(
            F.lit("/orders/"),
            flag,
            "l_linestatus",
            F.lit("/o_"),
            _text("l_orderkey"),
            F.lit("/line_"),
            _text("l_linenumber"),
            ending,
        ).alias("path"),
        F.lit(False).alias("is_dir"),
        _whole("l_extendedprice").alias("size"),
        F.unix_timestamp("l_shipdate").alias("modified"),
        _zero().alias("created"),
        _zero().alias("accessed"),
        *LINE_ORDER,
    )


def line_entries(spark: SparkSession, folder: str) -> DataFrame:
    return line_rows(spark, folder).select(*ENTRY_FIELDS)


def order_entries(spark: SparkSession, folder: str) -> DataFrame:
    """One file per order, with a numbered name (unique paths)."""
    path = F.concat(
        F.lit("/archive/c_"),
        _text("o_custkey"),
        F.lit("/file_"),
        F.lpad(_text("o_orderkey"), 8, "0"),
        F.when(F.col("o_orderstatus") == "F", ".txt").otherwise(".bin"),
    )
    rows = table(spark, folder, "orders").select(
        path.alias("path"),
        F.lit(False).alias("is_dir"),
        _whole("o_totalprice").alias("size"),
        F.unix_timestamp("o_orderdate").alias("modified"),
        _zero().alias("created"),
        _zero().alias("accessed"),
    )
    return rows


def typed_entries(spark: SparkSession, folder: str) -> DataFrame:
    """One file per order, with the extensions of all file types, some in capitals, and one more."""
    extensions = [e for listed in FILE_TYPES.values() for e in listed] + ["log"]
    number = F.col("o_orderkey")
    extension = F.get(
        F.array(*map(F.lit, extensions)), (number % len(extensions)).cast("int")
    )
    extension = F.when(number % 4 == 0, F.upper(extension)).otherwise(extension)
    return _untimed(
        table(spark, folder, "orders"),
        F.concat(
            F.lit("/typed/"),
            _text("o_custkey"),
            F.lit("/f"),
            _text("o_orderkey"),
            F.lit("."),
            extension,
        ),
        _whole("o_totalprice"),
    )


def tree_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Trees with hidden, system, vendor and temporary places, for the ingest rules."""
    docs = table(spark, folder, "documents")
    number = F.col("doc_id")
    home = F.when(
        number % 9 == 8, F.concat(F.lit("/proc/"), (number % 5).cast("string"))
    ).otherwise(F.concat(F.lit("/home/u"), (number % 20).cast("string")))
    place = _pick(
        number % 9,
        ["/.cache/img", "/node_modules/pkg", "/src/build.tmp", "/docs", "/src.rs", "/src.rs/x.rs"],
        "/src",
    )
    name = F.concat(
        F.when(number % 7 == 0, ".").otherwise(""),
        F.lit("doc_"),
        _text("doc_id"),
        _pick(number % 5, [".tmp", ".rs", ".txt", ".RS"], ""),
    )
    files = docs.select(
        F.concat(home, place, F.lit("/"), name).alias("path"),
        F.lit(False).alias("is_dir"),
        F.col("n_chars").alias("size"),
        *[_zero().alias(c) for c in ("modified", "created", "accessed")],
    )
    folders = docs.select(F.concat(home, place).alias("path")).distinct()
    return files.unionByName(
        folders.select(
            "path",
            F.lit(True).alias("is_dir"),
            *[_zero().alias(c) for c in ("size", "modified", "created", "accessed")],
        )
    )


def _number(column: str) -> Column:
    return F.regexp_extract(column, "([0-9]+)", 1).cast("int")


def changes(spark: SparkSession, folder: str, moves: bool = False) -> DataFrame:
    """Events as a changelog; an error deletes (a whole directory at every tenth number).

    With ``moves`` a click moves the file to another user, and a view of a high
    value says that events were lost.
    """
    return change_columns(table(spark, folder, "events"), moves)


def change_columns(events: DataFrame, moves: bool = False) -> DataFrame:
    """The changelog columns of the events table, as a batch or a stream."""
    kind_of = {"signup": "create", "purchase": "create", "error": "delete"}
    kind = F.lit("modify")
    for event, name in kind_of.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    number = _number("props")
    home = F.concat(F.lit("/u/"), (F.col("user_id") % 50).cast("string"))
    file = F.concat(home, F.lit("/f_"), (number % 20).cast("string"), F.lit(".log"))
    to_path = F.lit(None).cast("string")
    if moves:
        kind = F.when(F.col("event_type") == "click", "move").otherwise(kind)
        lost = (F.col("event_type") == "view") & (F.col("value") > 400)
        kind = F.when(lost, "overflow").otherwise(kind)
        target = F.concat(
            F.lit("/u/"),
            ((F.col("user_id") + 7) % 50).cast("string"),
            F.lit("/moved_"),
            (number % 20).cast("string"),
            F.lit(".log"),
        )
        to_path = F.when(kind == "move", target)
    rows = events.select(
        F.col("event_id").alias("seq"),
        "ts",
        kind.alias("kind"),
        F.when((F.col("event_type") == "error") & (number % 10 == 0), home)
        .otherwise(file)
        .alias("path"),
        to_path.alias("to_path"),
        F.lit(False).alias("is_dir"),
        _whole("value").alias("size"),
        F.unix_timestamp("ts").alias("modified"),
    )
    return as_changes(rows)


def directory_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The changelog with moves, in which now and then a home directory is moved.

    It goes into another one, or over it; moved homes move again when their number comes up.
    """
    events = table(spark, folder, "events")
    rows = change_columns(events, moves=True)
    seq, moves = F.col("seq"), (F.col("kind") == "move") & (F.col("seq") % 199 == 0)
    home = F.concat(F.lit("/u/"), (seq % 7).cast("string"))
    target = F.concat(F.lit("/u/"), (seq % 5).cast("string"), F.when(seq % 2 == 0, "/in").otherwise(""))
    return rows.withColumns(
        {
            "is_dir": F.when(moves, True).otherwise(F.col("is_dir")),
            "path": F.when(moves, home).otherwise(F.col("path")),
            "to_path": F.when(moves, target).otherwise(F.col("to_path")),
        }
    )


def user_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Home directories and log files of customers: a catalogue the changes act on."""
    customers = table(spark, folder, "customer")
    home = F.concat(F.lit("/u/"), (F.col("c_custkey") % 60).cast("string"))
    file = F.concat(home, F.lit("/f_"), _text("c_nationkey"), F.lit(".log"))
    files = customers.groupBy(file.alias("path")).agg(
        F.lit(False).alias("is_dir"), F.max(F.abs(_whole("c_acctbal"))).alias("size")
    )
    homes = customers.select(home.alias("path")).distinct()
    size = F.lit(4096).cast("bigint")
    homes = homes.select("path", F.lit(True).alias("is_dir"), size.alias("size"))
    return files.unionByName(homes).select(
        "path",
        "is_dir",
        "size",
        *[_zero().alias(c) for c in ("modified", "created", "accessed")],
    )
