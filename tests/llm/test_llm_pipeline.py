"""The pipeline against its stages done by hand on the small table."""

import random
import zlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from __spark_entry__ import oracle_sql, queries
from pathlode.llm import decontamination, mixing, simhash
from pathlode.llm.common import stored, table, tokenizer_path
from test_llm_simhash import brute_fingerprint, brute_roots

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, FOLDER, "documents"), []
    for _, stage in pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, FOLDER), "stage")
        out.append((before, docs))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns(stages):
    for before, after in stages[:4]:
        assert after.columns == before.columns
    assert stages[4][1].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_language_keeps_what_has_letters(stages):
    assert ids(stages[0][1]) == ids(stages[0][0])


def test_near_dedup_keeps_the_smallest_of_each_group(stages):
    docs = {r["doc_id"]: r["text"] for r in stages[1][0].collect()}
    prints = {i: brute_fingerprint(t) for i, t in docs.items()}
    roots, first = brute_roots(prints.values()), {}
    for i, v in prints.items():
        first[roots[v]] = min(i, first.get(roots[v], i))
    assert ids(stages[1][1]) == sorted(first.values())


def test_decontamination_drops_holders_only(spark, stages):
    items = {r["item_id"]: decontamination.normal(r["text"]) for r in table(spark, FOLDER, "benchmark").collect()}
    texts = {r["doc_id"]: decontamination.normal(r["text"]) for r in stages[2][0].collect()}
    gone = set(ids(stages[2][0])) - set(ids(stages[2][1]))
    assert gone >= {i for i, t in texts.items() if any(x in t for x in items.values())}
    leaks = decontamination.find_leaks(stages[2][0], table(spark, FOLDER, "benchmark"))
    assert gone == {r["doc_id"] for r in leaks.collect()} and gone


def test_mix(stages):
    before = stages[3][0].select("doc_id", "source", mixing.word_count("text").alias("size"))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect()}
    assert ids(stages[3][1]) == sorted(i for i, n in copies.items() for _ in range(n))


def test_tokens(stages):
    library, start = Tokenizer.from_file(tokenizer_path()), 0
    rows = stages[4][0].select("doc_id", "text").collect()
    got = sorted(map(tuple, stages[4][1].collect()), key=lambda r: r[1])
    assert sorted(r[0] for r in got) == [r[0] for r in got] == sorted(r["doc_id"] for r in rows)
    texts = {r["doc_id"]: r["text"] for r in rows}
    for doc_id, at, n, crc in got:
        own = [*library.encode(texts[doc_id], add_special_tokens=False).ids, 2]
        assert (at, n) == (start, len(own))
        assert crc == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))
        start += n


def test_run_is_the_stages(spark, stages):
    got = sorted(map(tuple, queries()["pipeline"](spark, FOLDER).collect()))
    assert got == sorted(map(tuple, stages[4][1].collect()))
    assert "pipeline" not in oracle_sql()


def test_awkward_rows(spark, tmp_path):
    rng = random.Random(9)
    words = "the house that stood with nothing there and this of all things".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)), "en", "s", 1) for i in range(50)]
    rows += [(None, None, None, None, None), (60, "", "en", None, 0), (3, rows[3][1], "en", "s", 1), (61, "12", "en", "s", 2)]
    rows += [(62, "house " * 200_000, "en", "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 AS copies", "2 AS score", "3 AS doc", "4 AS fp", "5 AS size", "6 AS key")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for some in (docs, docs.limit(0)):
        for name, stage in pipeline.STAGES:
            some = stored(stage(spark, some, str(tmp_path)), name)
            assert name == "token_output" or some.columns == docs.columns
        kept = {r["doc_id"] for r in some.collect()}
        assert not kept & {None, 60, 61}
    assert simhash.keep_one(docs).count() == 53
