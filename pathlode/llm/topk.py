"""Exact top-k search by inner product with a pivot-distance index.

Vectors become whole numbers. One more coordinate gives all of them the same length, so the
largest inner product is the smallest Euclidean distance and the triangle inequality holds.
Each vector is keyed by its nearest pivot and its distance to it; sorted by that key, runs of
vectors are annuli around a pivot. A query's distance to the pivot bounds its score with every
vector of an annulus; annuli are expanded nearest first, and those whose bound is below the
k-th score so far are not opened. Pivots come from a bounded sample; every vector is indexed.

Annuli that follow each other make up lanes, and queries blocks, both in tasks. A block goes to
those lanes whose bounds it cannot miss, where an equi-join on the lane lets it meet the annuli.
Only the lanes' bounds pass the driver: a row per lane and pivot in it.
"""

from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathlode.llm.common import stored

SCALE, BEST = 1024, 10
# Vectors the pivots are fitted on (and first scores come from), pivots, vectors of an annulus.
SAMPLE, PIVOTS, ANNULUS = 4096, 64, 512
# Bytes of one block of queries, which is sent once for every annulus it meets; lanes per core.
BLOCK_BYTES, LANES_PER_CORE = 512 * 1024, 8


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``v``: components floor(1024 x) of the vectors that take part.

    Left out are null keys, and vectors that are null or hold nulls, NaN or infinities.
    """
    bad = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).filter(~bad).select(
        F.col(key).cast("long").alias("vec_id"), whole.alias("v")
    )


def _matrix(rows, width: int) -> np.ndarray:
    """Rows as a matrix; components that a shorter vector lacks are 0, those beyond are left out."""
    out = np.zeros((len(rows), width), dtype=np.int64)
    for to, row in zip(out, rows, strict=True):
        to[: len(row)] = row[:width]
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact as long as they fit 64 bits."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the coordinate that brings them to length sqrt(``longest``)."""
    x = x.astype(np.float64)
    rest = np.sqrt(np.maximum(longest - (x**2).sum(axis=1), 0))
    return np.hstack([x, rest[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0))


def fit_pivots(x: np.ndarray, count: int = PIVOTS, rounds: int = 8) -> np.ndarray:
    """Centres of ``x`` (k-means from evenly spaced rows)."""
    pivots = x[np.linspace(0, len(x) - 1, min(count, len(x))).astype(int)]
    for _ in range(rounds):
        nearest = _distances(x, pivots).argmin(axis=1)
        for k in range(len(pivots)):
            if (nearest == k).any():
                pivots[k] = x[nearest == k].mean(axis=0)
    return pivots


class Index:
    """Annuli as a stored table, with what queries need to know of them."""

    def __init__(self, annuli: DataFrame, pivots: np.ndarray, longest: float, width: int):
        self.annuli, self.pivots, self.longest, self.width = annuli, pivots, longest, width
        self.sample_ids = np.zeros(0, dtype=np.int64)
        self.sample = np.zeros((0, width), dtype=np.int64)
        # A row per lane and pivot: lane, pivot, near, far.
        self.lanes = pd.DataFrame()


def _keyed(pivots: np.ndarray, longest: float, width: int):
    """Vectors with their nearest pivot and the distance to it."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                far = _distances(_lifted(_matrix(batch["v"], width), longest), pivots)
                nearest = far.argmin(axis=1)
                yield batch.assign(pivot=nearest, far=far[np.arange(len(far)), nearest])

    return rows


_KEYED = "vec_id long, v array<long>, pivot int, far double"


def build_index(vectors: DataFrame, annulus: int = ANNULUS) -> Index:
    """An index of all rows of ``usable`` (a stored table). Equal keys of copies spread over annuli."""
    norm = F.aggregate(
        "v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")
    )
    size = vectors.agg(F.max(norm).alias("longest"), F.max(F.size("v")).alias("width")).first()
    longest, width = size["longest"] or 0.0, size["width"] or 0
    sample = (
        vectors.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id", "v").limit(SAMPLE).collect()
    )
    drawn = _matrix([r["v"] for r in sample], width)
    pivots = fit_pivots(_lifted(drawn, longest)) if sample else np.zeros((0, width + 1))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, lane = None, TaskContext.get().partitionId()
        for batch in batches:
            left = batch if left is None else pd.concat([left, batch], ignore_index=True)
            *full, left = _cut(left, annulus)
            yield from (_annulus(width)(run).assign(lane=lane) for run in full)
        if left is not None and len(left):
            yield _annulus(width)(left).assign(lane=lane)

    lanes = LANES_PER_CORE * vectors.sparkSession.sparkContext.defaultParallelism
    annuli = (
        vectors.mapInPandas(_keyed(pivots, longest, width), _KEYED)
        .repartitionByRange(lanes, "pivot", "far", "vec_id")
        .sortWithinPartitions("pivot", "far", "vec_id")
        .mapInPandas(packed, "lane int, pivot int, near double, far double, ids binary, v binary")
    )
    index = Index(stored(annuli, "annuli"), pivots, longest, width)
    bounds = index.annuli.groupBy("lane", "pivot").agg(F.min("near").alias("near"), F.max("far").alias("far"))
    # Lanes follow the order of pivots, so there are fewer rows than lanes and pivots together.
    index.lanes = bounds.toPandas()
    index.sample_ids = np.array([r["vec_id"] for r in sample], dtype=np.int64)
    index.sample = drawn
    return index


def _cut(rows: pd.DataFrame, annulus: int) -> list[pd.DataFrame]:
    """Runs of one pivot and at most ``annulus`` rows; the last one may still grow."""
    runs = []
    for _, same in rows.groupby("pivot", sort=False):
        runs += [same.iloc[k : k + annulus] for k in range(0, len(same), annulus)]
    return runs or [rows]


def _annulus(width: int):
    def row(run: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "pivot": [run["pivot"].iloc[0]],
                "near": [run["far"].min()],
                "far": [run["far"].max()],
                "ids": [run["vec_id"].to_numpy(np.int64).tobytes()],
                "v": [_matrix(run["v"], width).tobytes()],
            }
        )

    return row


class _Best:
    """The best scores of each query so far, and the k-th of them."""

    def __init__(self, queries: int, best: int, floor: np.ndarray):
        self.best, self.floor = best, floor.copy()
        self.rows = np.zeros((3, 0), dtype=np.int64)  # query, score, vec_id

    def add(self, query: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        rows = np.hstack([self.rows, np.array([query, score, vec_id], dtype=np.int64)])
        rows = rows[:, np.lexsort((rows[2], -rows[1], rows[0]))]
        first = np.searchsorted(rows[0], rows[0])
        rank = np.arange(rows.shape[1]) - first
        self.rows = rows[:, rank < self.best]
        last = rows[:, rank == self.best - 1]
        self.floor[last[0]] = np.maximum(self.floor[last[0]], last[1])


_LEAST = np.iinfo(np.int64).min


def _first_floor(index: Index, ids: np.ndarray, queries: np.ndarray, best: int) -> np.ndarray:
    """For each query a score that its k-th best cannot be below: its k-th best in the sample."""
    floor = np.full(len(ids), _LEAST)
    if len(index.sample_ids) > best:
        for k in range(0, len(ids), 512):
            scores = _products(queries[k : k + 512], index.sample)
            scores[ids[k : k + 512, None] == index.sample_ids[None, :]] = _LEAST
            floor[k : k + 512] = np.partition(scores, -best, axis=1)[:, -best]
    return floor


def _bounds(to_pivots: np.ndarray, lengths: np.ndarray, longest: float, rings: pd.DataFrame) -> np.ndarray:
    """For each query and ring (``pivot``, ``near``, ``far``) what no score of theirs exceeds."""
    # Rounding of the bound stays far below one unit of score plus this share.
    slack = 1 + 1e-9 * (lengths + longest)
    d = to_pivots[:, rings["pivot"]]
    gap = np.maximum(d - rings["far"].to_numpy(), rings["near"].to_numpy() - d)
    return ((lengths + longest)[:, None] - np.maximum(gap, 0) ** 2) / 2 + slack[:, None]


def _searched(held: Broadcast | SimpleNamespace, best: int):
    """Annuli to the best rows of the queries of ``held.value``."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, queries, to_pivots, lengths, floor, longest = held.value
        found, width = _Best(len(ids), best, floor), queries.shape[1]
        for batch in batches:
            if not len(batch):
                continue
            bound = _bounds(to_pivots, lengths, longest, batch)
            for k in np.argsort(-bound.max(axis=0), kind="stable"):
                live = np.nonzero(bound[:, k] >= found.floor)[0]
                if not len(live):
                    continue
                vec_ids = np.frombuffer(batch["ids"].iloc[k], dtype=np.int64)
                v = np.frombuffer(batch["v"].iloc[k], dtype=np.int64).reshape(len(vec_ids), width)
                scores = _products(queries[live], v)
                good = scores >= found.floor[live][:, None]
                good &= ids[live][:, None] != vec_ids[None, :]
                a, b = np.nonzero(good)
                found.add(live[a], scores[a, b], vec_ids[b])
        query, score, vec_id = found.rows
        yield pd.DataFrame({"query": query, "score": score, "vec_id": vec_id})

    return rows


def _from_pivots(q: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of queries, which have no further coordinate, to the pivots; their squared lengths."""
    flat = np.hstack([q.astype(np.float64), np.zeros((len(q), 1))])
    return _distances(flat, pivots), (flat**2).sum(axis=1)


def _blocks(held: Broadcast, width: int, best: int, rows_of_block: int):
    """Queries to blocks with first floors and the lanes that they cannot leave out."""

    def block(run: pd.DataFrame) -> pd.DataFrame:
        index = held.value
        ids, q = run["vec_id"].to_numpy(np.int64), _matrix(run["v"], width)
        floor = _first_floor(index, ids, q, best)
        bound = _bounds(*_from_pivots(q, index.pivots), index.longest, index.lanes)
        lanes = index.lanes["lane"][(bound >= floor[:, None]).any(axis=0)].unique()
        return pd.DataFrame(
            {"lanes": [lanes], "q_ids": [ids.tobytes()], "q": [q.tobytes()], "floor": [floor.tobytes()]}
        )

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for batch in batches:
            left = batch if left is None else pd.concat([left, batch], ignore_index=True)
            while len(left) > rows_of_block:
                yield block(left[:rows_of_block])
                left = left[rows_of_block:]
        if left is not None and len(left):
            yield block(left)

    return rows


def _met(held: Broadcast, width: int, best: int):
    """Pairs of a block and an annulus to the block's best rows; pairs of a block follow each other."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
        for batch in batches:
            yield from batch.groupby("block", sort=False)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = held.value
        for number, same in groupby(pieces(batches), key=itemgetter(0)):
            first = next(same)[1]
            ids, floor = (np.frombuffer(first[c].iloc[0], dtype=np.int64) for c in ("q_ids", "floor"))
            q = np.frombuffer(first["q"].iloc[0], dtype=np.int64).reshape(len(ids), width)
            block = SimpleNamespace(value=(ids, q, *_from_pivots(q, index.pivots), floor, index.longest))
            for found in _searched(block, best)(chain([first], (rest for _, rest in same))):
                yield found.assign(block=number, query_id=ids[found["query"].to_numpy()])

    return rows


def search(index: Index, queries: DataFrame, best: int = BEST) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the best rows but those of the query's own id.

    ``queries`` has the columns of ``usable``. Equal scores go to the smaller ``vec_id``; rows
    that repeat count each, repeated queries once. Fewer candidates than ``best`` give fewer
    rows; an empty index or no queries give none.
    """
    spark, width = queries.sparkSession, index.width
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    held = spark.sparkContext.broadcast(
        SimpleNamespace(
            pivots=index.pivots, longest=index.longest, lanes=index.lanes,
            sample_ids=index.sample_ids, sample=index.sample,
        )
    )
    rows_of_block = max(BLOCK_BYTES // (8 * width), 1)
    # Queries near each other share a block, so that it needs few lanes.
    blocks = (
        queries.select("vec_id", "v")
        .distinct()
        .mapInPandas(_keyed(index.pivots, index.longest, width), _KEYED)
        .repartitionByRange("pivot", "far", "vec_id")
        .sortWithinPartitions("pivot", "far", "vec_id")
        .mapInPandas(
            _blocks(held, width, best, rows_of_block),
            "lanes array<int>, q_ids binary, q binary, floor binary",
        )
        .withColumn("block", F.monotonically_increasing_id())
    )
    dealt = stored(blocks, "query-blocks").withColumn("lane", F.explode("lanes")).drop("lanes")
    tasks = LANES_PER_CORE * spark.sparkContext.defaultParallelism
    pairs = dealt.repartition(tasks, "lane").join(
        index.annuli.repartition(tasks, "lane").hint("merge"), "lane"
    )
    hits = pairs.drop("lane").mapInPandas(
        _met(held, width, best), "block long, query int, query_id long, score long, vec_id long"
    )
    order = Window.partitionBy("block", "query").orderBy(F.col("score").desc(), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return stored(ranked.select("query_id", "rank", "vec_id", "score"), "top")
