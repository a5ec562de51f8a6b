"""The corpus pipeline: stages in order, each on all that its predecessor kept."""

from pyspark.sql import DataFrame, SparkSession

from pathlode.llm import decontamination, language, mixing, simhash, token_file
from pathlode.llm.common import prepare, stored, table, tokenizer_path
from pathlode.session import new_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; missing labels are filled in."""
    prepare(spark)
    return language.reject_undetermined(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id."""
    prepare(spark)
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take(docs)


# An executor may keep twice as many workers as cores, and a heap that earlier stages filled; so
# the encoder gets less memory than alone, which costs time and changes no result.
KEPT_RUNS = 50_000


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids in one folder; a row of its index per document."""
    prepare(spark)
    target = new_folder(spark, "pipeline-tokens")
    token_file.write_ids(docs, target, tokenizer_path(), kept=KEPT_RUNS)
    return token_file.read_ids(spark, target, with_ids=False)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_output", token_output),
]

# Models, fingerprints, edit distances and token ids are beyond SQL; see the tests instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
