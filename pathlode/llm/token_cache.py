"""Token counts through a cache keyed by digests of content and tokenizer.

The cache is a folder of Parquet files that only grows. A run digests every text, looks the
distinct digests up, encodes one text for each that is missing, appends the counts, and joins
them back. Copies are merged in every task before texts are moved, so a text that a third of
the rows share is moved once per task and encoded once. The normal form is the text itself
(null as empty): counts must not change, and the tokenizers normalise by themselves.
"""

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlode.llm.common import stored
from pathlode.llm.encoding import encoder

TOKEN_LIMIT = 1024

_CACHE = "digest binary, tokenizer string, n_tokens long"


def content_digest(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def cached(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """The counts stored for one tokenizer; runs at the same time may have stored one twice."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return spark.createDataFrame([], _CACHE).drop("tokenizer")
    return (
        spark.read.schema(_CACHE)
        .parquet(cache)
        .filter(F.col("tokenizer") == tokenizer)
        .groupBy("digest")
        .agg(F.max("n_tokens").alias("n_tokens"))
    )


def _count(path: str):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).encode
        for batch in batches:
            counts = [len(encode(t)) // 4 for t in batch["text"]]
            yield pd.DataFrame({"digest": batch["digest"], "n_tokens": counts})

    return rows


def count_tokens(
    docs: DataFrame, tokenizer: str, cache: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_bytes``, ``n_tokens``; fills ``cache``.

    ``tokenizer`` is the path of a ``.json`` file, the same on every executor. Counts have no
    begin, end or template tokens; nothing is cut. A null text counts as empty. Null and
    repeated keys are values like any other.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    texts = docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        content_digest(text).alias("digest"),
    )
    rows = stored(texts.select("key", "digest", F.octet_length("text").alias("n_bytes")), "digests")
    missing = stored(
        rows.select("digest").distinct().join(cached(spark, cache, version), "digest", "left_anti"),
        "misses",
    )
    if not missing.isEmpty():
        new = texts.groupBy("digest").agg(F.first("text").alias("text"))
        (
            new.join(missing, "digest", "left_semi")
            .mapInPandas(_count(tokenizer), "digest binary, n_tokens long")
            .select("digest", F.lit(version).alias("tokenizer"), "n_tokens")
            .write.mode("append")
            .parquet(cache)
        )
    # Stored, so that a digest which many rows share can be dealt to several tasks.
    counts = rows.select("digest").distinct().join(cached(spark, cache, version), "digest")
    return rows.join(stored(counts, "counts"), "digest").select(
        F.col("key").alias(key), F.col("n_bytes").cast("long").alias("n_bytes"), "n_tokens"
    )
