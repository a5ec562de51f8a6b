"""Token ids in compressed packs with a shared dictionary and an offset index.

The format, below one folder:

* ``dictionary`` one row: ``hash`` (hex SHA-256) and ``content`` of a zstandard dictionary
  trained on serialized id arrays (empty if there were too few to train on), ``width`` (bytes
  of an id) and ``tokenizer`` (SHA-256 of the tokenizer's file);
* ``packs`` rows of about ``PACK_BYTES``: ``part`` and ``pack`` (their order), ``hash`` of the
  dictionary, ``keys``, ``n_tokens`` and ``offsets`` per document (one offset more, for the end),
  and ``payload``, in which each document is a zstandard frame of its little-endian ids;
* ``index`` one row per pack: ``part``, ``pack``, ``first_key``, ``last_key``, ``start`` (ids of all
  packs before it), ``rows``, ``tokens``.

One document is read by its pack's offsets, without decompressing its neighbours. Packs are
rows of Parquet files, so they can be written to and read from any store that Spark reaches.
"""

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from pathlode.llm.common import key_kind, stored
from pathlode.llm.encoding import KEPT, encoder
from pathlode.llm.token_cache import tokenizer_version

END_ID = 2
PACK_BYTES = 4 * 1024 * 1024
# The dictionary's size, and the documents (about) and bytes (at most) it is trained on.
DICTIONARY_BYTES, SAMPLE_DOCS, SAMPLE_BYTES = 64 * 1024, 2000, 8 * 1024 * 1024
LEVEL = 2


def _serial(ids: bytes, width: int) -> bytes:
    """Ids of four bytes each as ids of ``width`` bytes."""
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _width(tokenizer: str, end_id: int) -> int:
    top = max(encoder(tokenizer).tokenizer.get_vocab_size(True) - 1, end_id)
    return 2 if top < 1 << 16 else 4


def train_dictionary(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = END_ID,
    key: str = "doc_id",
    text: str = "text",
    kept: int = KEPT,
) -> bytes:
    """A dictionary from about ``SAMPLE_DOCS`` documents, chosen by a digest of key and size."""
    count = docs.count()
    width = _width(tokenizer, end_id)
    mark = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.octet_length(text).cast("string")))
    share = int(min(1.0, SAMPLE_DOCS / max(count, 1)) * 0xFFFFFFF)
    chosen = (
        docs.select(F.col(text).alias("text"), mark.alias("mark"))
        .filter(F.conv(F.substring("mark", 1, 7), 16, 10).cast("long") <= share)
        .limit(2 * SAMPLE_DOCS)
    )

    def serial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                _serial(encoder(tokenizer, kept).encode(t or "")[: SAMPLE_BYTES // 512], width)
                for t in batch["text"]
            ]
            yield pd.DataFrame({"mark": batch["mark"], "ids": rows})

    samples, size = [], 0
    rows = chosen.mapInPandas(serial, "mark string, ids binary").collect()
    for row in sorted(rows, key=lambda r: (r["mark"], bytes(r["ids"]))):
        if row["ids"] and size < SAMPLE_BYTES:
            samples.append(bytes(row["ids"]))
            size += len(row["ids"])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little to train on
        return b""


def _zstd_dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if content else None


def _frames(tokenizer: str, end_id: int, width: int, dictionary: bytes, kept: int):
    end = end_id.to_bytes(4, "little")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer, kept).encode
        shared = _zstd_dictionary(dictionary)
        if shared is not None:
            shared.precompute_compress(level=LEVEL)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        for batch in batches:
            ids = [encode(t) + end for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "key": batch["key"],
                    "n_tokens": [len(i) // 4 for i in ids],
                    "crc": [zlib.crc32(i) for i in ids],
                    "frame": [packer.compress(_serial(i, width)) for i in ids],
                }
            )

    return rows


def _pack(dictionary_hash: str, pack_bytes: int):
    def packed(keys, counts, frames, part, number):
        return pd.DataFrame(
            {
                "part": [part],
                "pack": [number],
                "hash": [dictionary_hash],
                "keys": [keys],
                "n_tokens": [counts],
                "offsets": [np.cumsum([0, *map(len, frames)], dtype=np.int64)],
                "payload": [b"".join(frames)],
            }
        )

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number = TaskContext.get().partitionId(), 0
        keys, counts, frames, size = [], [], [], 0
        for batch in batches:
            for key, count, frame in batch[["key", "n_tokens", "frame"]].itertuples(index=False):
                keys.append(key)
                counts.append(count)
                frames.append(frame)
                size += len(frame) + 32
                if size >= pack_bytes:
                    yield packed(keys, counts, frames, part, number)
                    number, size = number + 1, 0
                    keys, counts, frames = [], [], []
        if keys:
            yield packed(keys, counts, frames, part, number)

    return rows


def write_ids(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = END_ID,
    key: str = "doc_id",
    text: str = "text",
    pack_bytes: int = PACK_BYTES,
    kept: int = KEPT,
) -> None:
    """Encode every whole text, append ``end_id``, and write all in ascending key order.

    Null texts are empty (the end id alone); null keys come last. Rows of equal keys stand in
    order of their ids' checksum, then of their number of ids, so that reruns agree. A text
    is never cut: a very long one is a pack of its own. No rows give a readable empty folder.
    ``kept`` bounds what an encoding worker remembers.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    if not docs.schema[key].dataType.typeName() in ("long", "integer", "string", "short"):
        raise TypeError(f"keys of type {kind.simpleString()} cannot be packed")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    width = _width(tokenizer, end_id)
    dictionary = train_dictionary(rows, tokenizer, end_id, "key", "text", kept)
    mark = hashlib.sha256(dictionary).hexdigest()
    # Literals: local rows would start one more set of Python workers, which stay.
    spark.range(0, 1, 1, 1).select(
        F.lit(mark).alias("hash"),
        F.lit(dictionary).alias("content"),
        F.lit(width).alias("width"),
        F.lit(tokenizer_version(tokenizer)).alias("tokenizer"),
    ).write.parquet(f"{folder}/dictionary")

    carried = key_kind(kind)
    framed = StructType([StructField("key", carried), StructField("n_tokens", LongType())])
    framed = framed.add("crc", "long").add("frame", "binary")
    encoded = rows.withColumn("key", F.col("key").cast(carried)).mapInPandas(
        _frames(tokenizer, end_id, width, dictionary, kept), framed
    )
    frames = stored(encoded.withColumn("key", F.col("key").cast(kind)), "frames")
    # Rows alike in key and ids are dealt out by their number, or they would meet in one task.
    order = [F.col("key").asc_nulls_last(), F.col("crc"), F.col("n_tokens")]
    spread = F.xxhash64(F.monotonically_increasing_id())
    # A row group a pack: writers keep whole row groups in memory, readers many rows of them.
    groups = {"parquet.block.size": str(pack_bytes), "parquet.page.size.row.check.min": "1"}
    pack = StructType().add("part", "long").add("pack", "long").add("hash", "string")
    pack.add("keys", ArrayType(carried)).add("n_tokens", ArrayType(LongType()))
    pack.add("offsets", ArrayType(LongType())).add("payload", "binary")
    (
        frames.withColumn("spread", spread)
        .repartitionByRange(*order, F.col("spread"))
        .sortWithinPartitions(*order, F.col("spread"))
        .withColumn("key", F.col("key").cast(carried))
        .mapInPandas(_pack(mark, pack_bytes), pack)
        .withColumn("keys", F.col("keys").cast(ArrayType(kind)))
        .write.options(**groups, compression="none")
        .parquet(f"{folder}/packs")
    )

    packs = spark.read.parquet(f"{folder}/packs").select(
        "part",
        "pack",
        F.element_at("keys", 1).alias("first_key"),
        F.element_at("keys", -1).alias("last_key"),
        F.size("keys").cast("long").alias("rows"),
        F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n).alias("tokens"),
    )
    packs = stored(packs, "packs")
    within = Window.partitionBy("part").orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task that wrote packs.
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = packs.groupBy("part").agg(F.sum("tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("before")
    )
    start = F.col("before") + F.coalesce(F.sum("tokens").over(within), F.lit(0))
    packs.join(before, "part").select(
        "part", "pack", "first_key", "last_key", start.alias("start"), "rows", "tokens"
    ).write.parquet(f"{folder}/index")


def _opened(dictionary: bytes, mark: str, width: int, with_ids: bool, only=None):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = zstandard.ZstdDecompressor(dict_data=_zstd_dictionary(dictionary))
        for batch in batches:
            for part, pack, hash_, keys, counts, offsets, payload in batch.itertuples(index=False):
                if hash_ != mark:
                    raise ValueError("a pack was written with another dictionary")
                starts = np.cumsum([0, *counts])
                out = []
                for n, key in enumerate(keys):
                    if only is not None and key not in only:
                        continue
                    frame = payload[offsets[n] : offsets[n + 1]]
                    ids = np.frombuffer(reader.decompress(frame), f"<u{width}").astype("<u4")
                    if len(ids) != counts[n]:
                        raise ValueError("a document has another number of ids than its index says")
                    row = (part, pack, key, int(starts[n]), len(ids))
                    row += (zlib.crc32(ids.tobytes()),) + ((ids.astype(np.int64),) if with_ids else ())
                    out.append(row)
                names = ["part", "pack", "key", "at", "n_tokens", "ids_crc32", "ids"]
                yield pd.DataFrame(out, columns=names[: 6 + with_ids]).astype({"key": object})

    return rows


def read_ids(
    spark: SparkSession,
    folder: str,
    key: str = "doc_id",
    with_ids: bool = True,
    keys: list | None = None,
) -> DataFrame:
    """One row per document: ``key``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids``.

    ``start`` counts the ids of all documents before it. With ``keys`` only these documents are
    decompressed, in packs whose range of keys can hold them. A pack of another dictionary
    or with other counts than its index says is an error.
    """
    shared = spark.read.parquet(f"{folder}/dictionary").first()
    packs, index = spark.read.parquet(f"{folder}/packs"), spark.read.parquet(f"{folder}/index")
    kind = packs.schema["keys"].dataType.elementType
    only = None
    if keys is not None:
        packs = packs.filter(F.exists("keys", lambda k: k.isin(list(keys))))
        only = {str(k) for k in keys}
    opened = StructType([StructField("part", LongType()), StructField("pack", LongType())])
    opened.add("key", key_kind(kind)).add("at", "long").add("n_tokens", "long").add("ids_crc32", "long")
    if with_ids:
        opened.add("ids", ArrayType(LongType()))
    packs = packs.withColumn("keys", F.col("keys").cast(ArrayType(key_kind(kind))))
    rows = packs.select("part", "pack", "hash", "keys", "n_tokens", "offsets", "payload").mapInPandas(
        _opened(bytes(shared["content"]), shared["hash"], shared["width"], with_ids, only), opened
    )
    return rows.join(index.select("part", "pack", F.col("start").alias("before")), ["part", "pack"]).select(
        F.col("key").cast(kind).alias(key),
        (F.col("before") + F.col("at")).alias("start"),
        "n_tokens",
        "ids_crc32",
        *(["ids"] if with_ids else []),
    )
