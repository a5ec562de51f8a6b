"""Hard negatives by exact scores of all rows, looked up in tables of subset sums.

Vectors are whole numbers. A candidate is stored as bit planes: for each bit of its components
and each group of eight dimensions one byte that holds the group's eight bits. An anchor has a
table of 256 sums per group: the sum of its components over every subset of the group. So the
inner product needs no multiplication: plane by plane, from the sign's plane down, the score so
far is doubled and the looked-up sums of the groups are added.

Anchors and candidates are packed into blocks of bounded size. Candidate blocks are dealt to
lanes, every anchor block goes to every lane once, and a join on the lane lets each task score
block against block and keep the best rows per anchor only. The first pass finds the positives;
the second one, which carries their scores, the negatives.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlode.llm.common import stored

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
# A negative's score lies between these hundredths of its positive's.
LEAST_SHARE, MOST_SHARE = 30, 90
# Rows of a block of anchors and of candidates, and candidate blocks of a lane, at most.
ANCHOR_ROWS, CANDIDATE_ROWS, LANE_BLOCKS = 256, 1024, 64
GROUP = 8

_BLOCK = "rows int, ids binary, labels binary, data binary"
# Below every score; its negative is a number, too.
_NONE = np.iinfo(np.int64).min + 1


def usable(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    scale: int = SCALE,
) -> DataFrame:
    """``vec_id``, ``label``, ``v``: components floor(scale x) of the rows that take part.

    Left out are rows with a null key, label or vector and those with a null, NaN or infinite
    component. Components that a shorter vector lacks count as 0. Scores must fit 62 bits.
    """
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    whole = F.transform("x", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.select(
        F.col(key).cast("long").alias("vec_id"),
        (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"),
        F.col(vector).alias("x"),
    )
    return rows.dropna().filter(~bad).select("vec_id", "label", whole.alias("v"))


@dataclass(frozen=True)
class Shape:
    """What all blocks share: groups of dimensions, and bit planes."""

    groups: int
    planes: int

    @classmethod
    def of(cls, vectors: DataFrame) -> "Shape":
        row = vectors.agg(
            F.max(F.size("v")).alias("width"),
            F.min(F.array_min("v")).alias("least"),
            F.max(F.array_max("v")).alias("most"),
        ).first()
        width, least, most = row["width"] or 0, row["least"] or 0, row["most"] or 0
        planes = max((-least - 1).bit_length() if least < 0 else 0, most.bit_length() if most > 0 else 0) + 1
        return cls(-(-width // GROUP), planes)

    def matrix(self, rows) -> np.ndarray:
        out = np.zeros((len(rows), self.groups * GROUP), dtype=np.int64)
        for to, row in zip(out, rows, strict=True):
            to[: len(row)] = row[: len(to)]  # no candidate has a component beyond
        return out

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Subset sums in the smallest type that holds all scores with rows of so many planes."""
        most = int(np.abs(x).max(initial=1)) * max(x.shape[1], 1) << self.planes
        return subset_sums(x, np.int32 if most < 2**31 else np.int64)


def bit_planes(x: np.ndarray, planes: int) -> np.ndarray:
    """Bytes by (plane, group, row): bit ``i`` of a byte belongs to dimension ``i`` of its group."""
    bits = (x[None] >> np.arange(planes)[:, None, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").transpose(0, 2, 1).copy()


def subset_sums(x: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """Sums by (group, subset, row): the components of a row's group whose bit the subset has."""
    groups = x.shape[1] // GROUP
    parts = x.reshape(len(x), groups, GROUP).transpose(1, 2, 0).astype(kind)
    sums = np.zeros((groups, 1 << GROUP, len(x)), dtype=kind)
    for i in range(GROUP):
        sums[:, 1 << i : 2 << i] = sums[:, : 1 << i] + parts[:, i : i + 1]
    return sums


def scores(planes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Inner products by (candidate, anchor), by lookups, shifts and additions."""
    total = np.zeros((planes.shape[2], sums.shape[2]), dtype=sums.dtype)
    for k in range(len(planes) - 1, -1, -1):
        total <<= 1
        for group, table in zip(planes[k], sums, strict=True):
            # In two's complement the highest plane counts negatively.
            if k == len(planes) - 1:
                total -= table[group]
            else:
                total += table[group]
    return total


def _packed(shape: Shape, most: int, data: Callable[[np.ndarray], np.ndarray]):
    """Rows to blocks of at most ``most`` rows in the order of ids."""

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        return pd.DataFrame(
            {
                "rows": [len(rows)],
                "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()],
                "labels": [rows["label"].to_numpy(np.int64).tobytes()],
                "data": [data(shape.matrix(rows["v"])).tobytes()],
            }
        )

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = []
        for batch in batches:
            for at in range(0, len(batch), most):
                left.append(batch.iloc[at : at + most])
                while sum(map(len, left)) >= most:
                    whole = pd.concat(left, ignore_index=True)
                    yield block(whole.iloc[:most])
                    left = [whole.iloc[most:]]
        whole = pd.concat(left, ignore_index=True) if left else []
        if len(whole):
            yield block(whole)

    return blocks


def best_rows(total: np.ndarray, good: np.ndarray, ids: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids by (anchor, place) of the best ``good`` rows; ``ids`` ascend, equal scores too.

    Places without a row have the least number as their score.
    """
    n = len(ids)
    # Score and place in one number, so that equal scores go to the smaller id.
    both = np.where(good, total.astype(np.int64) * n + np.arange(n - 1, -1, -1)[:, None], _NONE).T
    if n > best:
        both = np.partition(both, n - best, axis=1)[:, n - best :]
    both = -np.sort(-both, axis=1)
    empty = both == _NONE
    place = np.where(empty, 0, n - 1 - both % n)
    return np.where(empty, _NONE, both // n), ids[place]


def _merged(old: tuple | None, new: tuple, best: int) -> tuple:
    """The best of two such pairs."""
    if old is None:
        return new
    score, ids = (np.concatenate(pair, axis=1) for pair in zip(old, new, strict=True))
    order = np.lexsort((ids, -score), axis=1)[:, :best]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


class _Block:
    """An anchor block in a task: its tables, and the best rows found for each anchor so far."""

    def __init__(self, row, shape: Shape):
        self.number = row.block
        self.ids = np.frombuffer(row.ids, dtype=np.int64)
        self.labels = np.frombuffer(row.labels, dtype=np.int64)
        x = np.frombuffer(row.data, dtype=np.int64).reshape(row.rows, -1)
        self.sums = shape.sums(x)
        self.found: dict[int, tuple] = {}

    def against(self, row, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, scores, and whether labels are the same, for a candidate block."""
        ids = np.frombuffer(row.c_ids, dtype=np.int64)
        labels = np.frombuffer(row.c_labels, dtype=np.int64)
        planes = np.frombuffer(row.c_data, dtype=np.uint8).reshape(shape.planes, shape.groups, len(ids))
        return ids, scores(planes, self.sums), labels[:, None] == self.labels[None, :]

    def add(self, which: int, new: tuple, best: int) -> None:
        self.found[which] = _merged(self.found.get(which), new, best)

    def rows(self, name: str) -> Iterator[pd.DataFrame]:
        for which, (score, ids) in self.found.items():
            slot, place = np.nonzero(score != _NONE)
            yield pd.DataFrame(
                {"block": self.number, "slot": slot, "positive": which, name: ids[slot, place], "score": score[slot, place]}
            )


def _scored(shape: Shape, name: str, meet: Callable[[_Block, object], None]):
    """Pairs of blocks to the best rows; pairs of one anchor block mostly follow each other."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if held is None or held.number != row.block:
                    if held is not None:
                        yield from held.rows(name)
                    held = _Block(row, shape)
                meet(held, row)
        if held is not None:
            yield from held.rows(name)

    return rows


@dataclass(frozen=True)
class Index:
    """All rows as stored blocks of bit planes, each in one of ``lanes`` lanes."""

    blocks: DataFrame
    shape: Shape
    lanes: int
    tasks: int


def build_index(vectors: DataFrame, block_rows: int = CANDIDATE_ROWS) -> Index:
    """Every row of ``usable`` (a stored table) in blocks; no row is left out."""
    shape = Shape.of(vectors)
    packed = stored(
        vectors.select("vec_id", "label", "v").mapInPandas(
            _packed(shape, block_rows, lambda x: bit_planes(x, shape.planes)), _BLOCK
        ),
        "bit-planes",
    )
    tasks = 4 * vectors.sparkSession.sparkContext.defaultParallelism
    # Several lanes a task, so that tasks get about the same work.
    lanes = max(4 * tasks, -(-packed.count() // LANE_BLOCKS))
    number = F.monotonically_increasing_id()
    dealt = packed.select(
        F.pmod(F.xxhash64(number), F.lit(lanes)).cast("int").alias("lane"),
        *[F.col(c).alias(f"c_{c}") for c in packed.columns],
    )
    return Index(stored(dealt, "lanes"), shape, lanes, max(tasks, lanes // 4))


def _pairs(anchors: DataFrame, index: Index) -> DataFrame:
    """Every anchor block with every candidate block, by an equi-join on the lane."""
    lanes = index.blocks.select("lane").distinct()
    dealt = anchors.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(index.lanes - 1))))
    left = dealt.join(F.broadcast(lanes), "lane", "left_semi").repartition(index.tasks, "lane")
    return left.join(index.blocks.repartition(index.tasks, "lane").hint("merge"), "lane")


def _best(found: DataFrame, group: list[str], row_id: str, best: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col("score").desc(), row_id)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


def mine(
    index: Index,
    anchors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST_SHARE,
    most: int = MOST_SHARE,
    block_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``anchors`` has the columns of ``usable``. An anchor's positives are the first ``positives``
    rows of its label, by score and then the smaller id; for each of them come the first
    ``negatives`` rows of other labels whose score is ``least`` to ``most`` hundredths of the
    positive's. Rows with the anchor's own id are neither. Candidates that repeat count each,
    anchors that repeat count once. No index, anchors or positives give no rows.
    """
    shape, spark = index.shape, anchors.sparkSession
    prepared = (
        anchors.select("vec_id", "label", "v")
        .distinct()
        .mapInPandas(_packed(shape, block_rows, lambda x: x), _BLOCK)
        .withColumn("block", F.monotonically_increasing_id())
    )
    blocks = stored(prepared, "anchors")

    def meet_same(block: _Block, row) -> None:
        ids, total, same = block.against(row, shape)
        good = same & (ids[:, None] != block.ids[None, :])
        block.add(0, best_rows(total, good, ids, positives), positives)

    columns = "block long, slot int, positive int, {} long, score long"
    near = _pairs(blocks, index).mapInPandas(
        _scored(shape, "positive_id", meet_same), columns.format("positive_id")
    )
    chosen = stored(
        _best(near, ["block", "slot"], "positive_id", positives).select(
            "block", "slot", F.col("rank").alias("positive"), "positive_id", F.col("score").alias("positive_score")
        ),
        "positives",
    )
    wanted = chosen.groupBy("block").agg(
        F.collect_list(F.struct("slot", "positive", "positive_score")).alias("wanted")
    )

    def meet_other(block: _Block, row) -> None:
        if not hasattr(block, "bounds"):
            block.bounds = np.full((positives + 1, len(block.ids)), _NONE)
            for slot, positive, score in ((w["slot"], w["positive"], w["positive_score"]) for w in row.wanted):
                block.bounds[positive, slot] = score
        ids, total, same = block.against(row, shape)
        other = ~same & (ids[:, None] != block.ids[None, :])
        hundred = total.astype(np.int64) * 100
        for positive in range(1, positives + 1):
            bound = block.bounds[positive]
            known = bound != _NONE
            if not known.any():
                break
            bound = np.where(known, bound, 0)
            good = other & known[None] & (hundred >= least * bound) & (hundred <= most * bound)
            if good.any():
                block.add(positive, best_rows(total, good, ids, negatives), negatives)

    far = _pairs(stored(blocks.join(wanted, "block"), "anchors-wanted"), index).mapInPandas(
        _scored(shape, "negative_id", meet_other), columns.format("negative_id")
    )
    ranked = _best(far, ["block", "slot", "positive"], "negative_id", negatives)
    owners = stored(
        blocks.mapInPandas(_owners, "block long, slot int, anchor_id long"), "anchor-ids"
    )
    named = chosen.join(owners, ["block", "slot"])
    return ranked.join(named, ["block", "slot", "positive"]).select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        "negative_id",
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def _owners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            ids = np.frombuffer(row.ids, dtype=np.int64)
            yield pd.DataFrame({"block": row.block, "slot": np.arange(len(ids)), "anchor_id": ids})
