"""Token counts and token files against the tokenizers library."""

import glob
import random
import struct
import zlib

import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from pathlode.llm import encoding, token_cache, token_file
from pathlode.llm.common import tokenizer_path
from pathlode.llm.queries import QUERIES
from pathlode.session import new_folder

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(tokenizer_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


AWKWARD = [
    "",
    " ",
    "  \n\n x \t",
    "a  b   c",
    "don't we'll I'm 'tis 'S",
    "x<|endoftext|>y <|endoftext|>",
    "naïve façade — “quoted” … 3½ ²",
    "日本語 text ελληνικά עברית",
    "tab\tnew\nline\r\nend ",
    "\x1c\x85\xa0 odd blanks here",
    "é combining ​ zero",
    "😀 emoji 👩‍👩‍👧",
    "a" * 5000,
    " a" * 5000,
    "ª º ʰ ǅ _under_ 1_000",
]


def test_encoder_gives_the_librarys_ids(library):
    own = encoding.Encoder(tokenizer_path())
    assert own.runs is not None
    rng = random.Random(7)
    parts = [*"abzAZ09'. ,\n\t\r_-é½²ß", "  ", " '", "'s", "'re ", "<|endoftext|>", "<|", "—", "漢", "\x1f", "\xa0"]
    texts = AWKWARD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    for text in texts:
        assert own.encode(text) == packed(library(text)), repr(text)


def test_encoder_with_small_tables(library):
    own = encoding.Encoder(tokenizer_path(), 3)
    text = "one two three four five six seven one two three"
    assert own.encode(text) == own.encode(text) == packed(library(text))


def test_other_tokenizers_go_to_the_library_whole():
    path = tokenizer_path("word_bpe_49k.json")
    own, plain = encoding.Encoder(path), Tokenizer.from_file(path)
    assert own.runs is None
    for text in ("", "Some Words, here", "naïve"):
        assert own.encode(text) == packed(plain.encode(text, add_special_tokens=False).ids)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 AS key", "2 AS digest", "3 AS n_tokens", "4 AS start"
    )


def test_count_through_the_cache(spark, library, monkeypatch):
    rows = list(enumerate(AWKWARD)) + [(None, None), (0, ""), (90, AWKWARD[3]), (91, None)]
    docs, cache = documents(spark, rows), new_folder(spark, "cache")
    want = sorted(((i, len((t or "").encode()), len(library(t))) for i, t in rows), key=str)
    got = token_cache.count_tokens(docs, tokenizer_path(), cache)
    assert sorted(map(tuple, got.collect()), key=str) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len(set(AWKWARD))
    # A second run encodes only what is new.
    more = documents(spark, rows + [(200, "new text"), (201, "new text")])
    again = token_cache.count_tokens(more, tokenizer_path(), cache)
    assert again.count() == len(rows) + 2 and spark.read.parquet(cache).count() == len(set(AWKWARD)) + 1
    # Another tokenizer has counts of its own.
    token_cache.count_tokens(more, tokenizer_path("word_bpe_49k.json"), cache)
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2
    assert token_cache.count_tokens(docs.limit(0), tokenizer_path(), new_folder(spark, "cache")).collect() == []


def test_count_query(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in QUERIES["op9_token_counts"](spark, FOLDER).collect()}
    counts = {r["doc_id"]: (len(r["text"].encode()), len(library(r["text"]))) for r in docs}
    assert got == {(i, b, n, n > 1024) for i, (b, n) in counts.items()}


def expected(rows, library):
    """Rows in key order (nulls last, ties by checksum and length) with their starts."""
    out = []
    for key, text in rows:
        ids = [*library(text), 2]
        out.append((key is None, key or 0, zlib.crc32(packed(ids)), len(ids), ids))
    start, want = 0, []
    for none, key, crc, n, ids in sorted(out):
        want.append((None if none else key, start, n, crc, ids))
        start += n
    return want


@pytest.mark.parametrize("pack_bytes", [200, token_file.PACK_BYTES])
def test_file_round_trip(spark, library, pack_bytes):
    rng = random.Random(8)
    words = "one two three four five six seven eight nine ten".split()
    rows = [(i * 3 % 400, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(1000 + i, t) for i, t in enumerate(AWKWARD)] + [(None, None), (5, "tie"), (5, "tie"), (None, "x")]
    rows += [(2**62 + 1, "large"), (2**62, "keys")]
    folder = new_folder(spark, "file")
    token_file.write_ids(documents(spark, rows).repartition(4), folder, tokenizer_path(), pack_bytes=pack_bytes)
    got = token_file.read_ids(spark, folder).collect()
    want = expected(rows, library)
    assert sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"], list(r["ids"])) for r in got) == [
        (start, key, n, crc, ids) for key, start, n, crc, ids in want
    ]
    shared = spark.read.parquet(f"{folder}/dictionary").first()
    assert shared["width"] == 2 and len(shared["content"]) > 0
    assert {r["hash"] for r in spark.read.parquet(f"{folder}/packs").collect()} == {shared["hash"]}
    # Some documents alone, and in order within the packs of the index.
    few = token_file.read_ids(spark, folder, keys=[5, 1003], with_ids=False).collect()
    assert sorted(r["doc_id"] for r in few) == sorted(k for k, _ in rows if k in (5, 1003))
    index = spark.read.parquet(f"{folder}/index").orderBy("part", "pack").collect()
    assert [r["start"] for r in index] == [sum(r["tokens"] for r in index[:k]) for k in range(len(index))]
    assert (len(index) > 20) == (pack_bytes == 200)


def test_a_foreign_dictionary_is_an_error(spark):
    folder = new_folder(spark, "file")
    token_file.write_ids(documents(spark, [(1, "a"), (2, "b")]), folder, tokenizer_path())
    other = spark.createDataFrame([("no", b"", 2, "")], "hash string, content binary, width int, tokenizer string")
    other.write.mode("overwrite").parquet(f"{folder}/dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        token_file.read_ids(spark, folder).collect()


def test_a_pack_is_a_row_group(spark):
    folder, rng = new_folder(spark, "file"), random.Random(9)
    rows = [(i, " ".join(str(rng.random()) for _ in range(200))) for i in range(300)]
    token_file.write_ids(documents(spark, rows), folder, tokenizer_path(), pack_bytes=20_000)
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{folder}/packs/*.parquet")]
    assert max(f.num_rows for f in files) > 3
    assert all(f.num_row_groups == f.num_rows for f in files)


def test_empty_file(spark):
    folder = new_folder(spark, "file")
    token_file.write_ids(documents(spark, []), folder, tokenizer_path())
    assert token_file.read_ids(spark, folder).collect() == []


def test_file_query(spark, library):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, QUERIES["op10_token_file"](spark, FOLDER).collect()))
    assert got == [w[:4] for w in expected([tuple(r) for r in rows], library)]


def test_signs_behind_words_as_the_library_cuts_them():
    rng = random.Random(17)
    parts = ["word", "Ab", "7", "é", ",", ".", ", ", ". ", " ", "\n", "'s", "|", "!", ",.", "\x01", "x"]
    tool, mine = Tokenizer.from_file(tokenizer_path()), encoding.Encoder(tokenizer_path())
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert mine.encode(text) == encoding.id_bytes(tool.encode(text, add_special_tokens=False).ids), text
