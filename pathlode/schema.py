"""The two fixed record layouts: catalogue entries and change events."""

from pyspark.sql import types as T

ENTRY_FIELDS = ["path", "is_dir", "size", "modified", "created", "accessed"]
META_FIELDS = ["size", "modified", "created", "accessed"]
PART_FIELDS = ["name", "parent", "extension", "name_lc"]

# One file or directory.  Times are epoch seconds; 0 means unknown.
ENTRY = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("is_dir", T.BooleanType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("modified", T.LongType(), False),
        T.StructField("created", T.LongType(), False),
        T.StructField("accessed", T.LongType(), False),
    ]
)

# An entry as it is stored: with its derived columns.
STORED = T.StructType(
    ENTRY.fields + [T.StructField(name, T.StringType(), False) for name in PART_FIELDS]
)

# What a stored entry keeps for events that arrive later: the order of its last create, of each
# field's last report, and of the last delete of the path itself.
ORDERS = T.StructType(
    [
        T.StructField(name, T.LongType(), True)
        for name in ("create_ord", *(f"{f}_ord" for f in META_FIELDS), "delete_ord")
    ]
)

# One change event; kind is create, delete, modify, move or overflow.
CHANGE = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("ts", T.TimestampType(), True),
        T.StructField("kind", T.StringType(), False),
        T.StructField("path", T.StringType(), True),
        T.StructField("to_path", T.StringType(), True),
        T.StructField("is_dir", T.BooleanType(), True),
        T.StructField("size", T.LongType(), True),
        T.StructField("modified", T.LongType(), True),
        T.StructField("created", T.LongType(), True),
        T.StructField("accessed", T.LongType(), True),
    ]
)
