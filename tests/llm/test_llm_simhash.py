"""SimHash against a count of bits, and components against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from pathlode.llm import components, simhash
from pathlode.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(values):
    """Value -> smallest value reachable by links, from all pairs."""
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    array = np.array(values, dtype=np.uint64)
    for i, v in enumerate(values):
        for j in np.nonzero(np.bitwise_count(array ^ array[i]) <= 2)[0]:
            a, b = find(v), find(values[j])
            root[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def clustered(n, seed):
    """Random fingerprints with chains, dense balls and copies."""
    rng = random.Random(seed)
    values = [rng.getrandbits(64) for _ in range(n)]
    for i in range(n // 4):
        values[i + 1] = values[i] ^ (1 << rng.randrange(64))
    for i in range(n // 2, n * 3 // 4):
        values[i] = values[n // 2] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
    return values + values[:20]


@pytest.mark.parametrize(
    "text",
    [None, "", " \t\n", "one", "A b", "a B c", "x\x1cy \xa0 z w", "É é\nß", "w " * 70_000, "a b c a b c a b c"],
)
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


def joined(pairs):
    root = {}

    def find(v):
        root.setdefault(v, v)
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in root}


def test_links_within_a_leaf_lose_nothing(monkeypatch):
    monkeypatch.setattr(simhash, "SCANNED", 64)
    values = clustered(3000, 1)
    found = simhash.links(np.unique(np.array(values, dtype=np.uint64)))
    got = joined((int(c), int(p)) for cs, p in found for c in cs)
    want = {v: r for v, r in brute_roots(values).items()}
    assert all(got.get(v, v) == r for v, r in want.items())


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_components_across_leaves(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 50)
    values = clustered(1500, 2)
    fps = spark.createDataFrame([(signed(v),) for v in sorted(set(values))], "fp long")
    dealt = simhash.leaves(fps, leaf=50)
    assert dealt.select("leaf").distinct().count() > 16
    edges = dealt.groupBy("leaf").applyInPandas(simhash._leaf_edges(2), "child long, parent long")
    got = {r["child"]: r["parent"] for r in components.components(edges).collect()}
    classes = {}
    for v, r in brute_roots(values).items():
        classes.setdefault(r, set()).add(signed(v))
    for members in classes.values():
        assert {got.get(v, v) for v in members} == {min(members)}


@pytest.mark.parametrize("most", [40, 100, 10_000])
def test_a_cloud_is_shared_by_tasks(spark, monkeypatch, most):
    """Thousands of slightly edited copies: no vantage point parts them, no task gets them all."""
    rng = random.Random(8)
    centre, values = rng.getrandbits(64), {rng.getrandbits(64) for _ in range(200)}
    while len(values) < 900:
        values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))))
    fps = spark.createDataFrame([(signed(v),) for v in sorted(values)], "fp long")
    placed = simhash.leaves(fps, leaf=200)
    parts = simhash._in_parts(placed, most)
    sizes = [r["count"] for r in parts.groupBy("leaf", "part").count().collect()]
    assert max(sizes) <= max(1.5 * most, most + 40)
    if most < 900:
        assert placed.groupBy("leaf").count().filter(f"count > {2 * most}").count() >= 1
    monkeypatch.setattr(simhash, "PART", most)
    got = {r["fp"]: r["root"] for r in simhash.linked(fps).collect()}
    classes = {}
    for v, r in brute_roots(values).items():
        classes.setdefault(r, set()).add(signed(v))
    assert max(map(len, classes.values())) > 300
    for members in classes.values():
        assert {got.get(v, v) for v in members} == {min(members)}


def test_components_of_long_chains(spark):
    pairs = [(i + 1, i) for i in range(200)] + [(500, 300), (300, 400), (400, 500), (7, 7)]
    edges = spark.createDataFrame(pairs + pairs[:5], "child long, parent long")
    got = {r["child"]: r["parent"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {400: 300, 500: 300}
    assert components.components(edges.limit(0)).collect() == []


def test_awkward_rows(spark):
    rows = [(3, "same words here now"), (2, "same words here now"), (None, "same words here now")]
    rows += [(9, None), (8, ""), (2, "same words here now"), (None, "other text of its own kind")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 AS fp", "2 AS component_id", "3 AS root", "4 AS key"
    )
    prints = docs.select("doc_id", simhash.fingerprint_of("text").alias("fp"))
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(prints).collect()]
    assert sorted(got, key=str) == sorted(
        [(3, 2), (2, 2), (None, 2), (9, 8), (8, 8), (2, 2), (None, None)], key=str
    )
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [2, 8, None]
    assert simhash.keep_one(docs.limit(0)).collect() == []
    assert simhash.near_duplicates(prints.limit(0)).collect() == []


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs}
    roots, first = brute_roots(prints.values()), {}
    for i, v in prints.items():
        first[roots[v]] = min(i, first.get(roots[v], i))
    got = {tuple(r) for r in QUERIES["op4_simhash"](spark, FOLDER).collect()}
    assert got == {(i, f"{v:016x}", first[roots[v]]) for i, v in prints.items()}
