"""Hard-negative mining: Strassen products of integer tiles, mergeable heaps.

Vectors are quantised to 64-bit integers. The anchors, a stated set of rows,
go through the corpus in blocks of bounded bytes; every task multiplies its
candidates with a block tile by tile, by Strassen's seven products on tiles
padded with zeros. A first pass keeps each anchor's best rows of its own label
in a heap, a second one the best rows of other labels inside the score window
of each positive. Heaps of tiles merge inside a task, those of tasks in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cauce.llm.common import staged, work_folder

POSITIVES, NEGATIVES = 5, 10
#: A negative's score, in hundredths of the positive's.
LOW, HIGH = 30, 90
SCALE = 256
#: Bytes of a block of anchors (broadcast), candidates of a tile, least side of a product that is split.
BLOCK_BYTES = 4 << 20
TILE = 1024
LEAF = 32
_NONE = np.iinfo(np.int64).min
_FAR = np.iinfo(np.int64).max


def strassen(a: np.ndarray, c: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ c.T`` of integer matrices. Sides that are odd get a row or column of
    zeros before a split; a product with a side below ``2 * leaf`` is not split.

    Sums wrap around at 64 bits, a ring, so the result is exact whenever its
    entries fit; arrays of Python integers (dtype object) have no such bound.
    """
    (m, d), n = a.shape, len(c)
    if min(m, d, n) < 2 * leaf:
        if a.dtype == object:
            return a @ c.T
        return np.einsum("ik,jk->ij", np.ascontiguousarray(a), np.ascontiguousarray(c))
    if m % 2 or d % 2:
        a = np.pad(a, ((0, m % 2), (0, d % 2)))
    if n % 2 or d % 2:
        c = np.pad(c, ((0, n % 2), (0, d % 2)))
    i, k, j = len(a) // 2, a.shape[1] // 2, len(c) // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    # quadrants of c.T: the first index is c's column half
    b11, b12, b21, b22 = c[:j, :k], c[j:, :k], c[:j, k:], c[j:, k:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * j), a.dtype)
    out[:i, :j] = p1 + p4 - p5 + p7
    out[:i, j:] = p3 + p5
    out[i:, :j] = p2 + p4
    out[i:, j:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))


def scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all of ``c``, the narrower padded
    with zeros. Products beyond 64 bits are made of Python integers and saturate."""
    width = max(a.shape[1], c.shape[1])
    a, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, c))
    if _largest(a) * _largest(c) * max(1, width) <= _FAR:
        return strassen(a, c)
    return np.clip(strassen(a.astype(object), c.astype(object)), _NONE + 1, _FAR).astype(np.int64)


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of a list column as a matrix, short ones padded with zeros."""
    values, offsets = column.flatten().to_numpy(), column.offsets.to_numpy()
    length = np.diff(offsets)
    out = np.zeros((len(length), int(length.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(length)), length), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], length)] = values
    return out


class Heaps:
    """The best ``k`` entries of every owner: highest score, then smallest id,
    then smallest row. Merging two is putting one's entries into the other."""

    def __init__(self, owners: int, k: int):
        self.k = k
        self.least = np.full(owners, _NONE)
        self.owner, self.score, self.id, self.row = (np.zeros(0, np.int64) for _ in range(4))

    def put(self, owner: np.ndarray, score: np.ndarray, vec: np.ndarray, row: np.ndarray) -> None:
        owner, score, vec, row = (np.concatenate(x) for x in ((self.owner, owner), (self.score, score), (self.id, vec), (self.row, row)))
        order = np.lexsort((row, vec, -score, owner))
        owner = owner[order]
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
        place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
        keep = order[place < self.k]
        self.owner, self.score, self.id, self.row = owner[place < self.k], score[keep], vec[keep], row[keep]
        full = place[place < self.k] == self.k - 1
        self.least[self.owner[full]] = self.score[full]

    def offer(self, tile: np.ndarray, fits: np.ndarray, owners: np.ndarray, vec: np.ndarray, row: np.ndarray) -> None:
        """Entries of a tile (owners x candidates) that fit. Those below an
        owner's last full heap, or below the tile's own k-th, cannot enter."""
        fits &= tile >= self.least[owners][:, None]
        if tile.shape[1] > self.k:
            masked = np.where(fits, tile, _NONE)
            fits &= tile >= np.partition(masked, -self.k, axis=1)[:, -self.k][:, None]
        at, who = np.nonzero(fits)
        if len(at):
            self.put(owners[at], tile[at, who], vec[who], row[who])


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """row, id, label, vector (floor of 256 times each component) of the rows that take part.

    Rows with a null id, label or vector, or any null or non-finite component
    take no part. Components beyond 64 bits saturate; an empty vector scores 0.
    """
    scaled = F.transform("vector", lambda x: F.floor(x.cast("double") * SCALE))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"))
    return rows.where("id is not null and label is not null and vector is not null").where(sound).select("row", "id", "label", scaled.alias("vector"))


def _tiles(batches, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, id, label, matrix) of runs of candidates; wide vectors come in shorter runs."""
    step = max(1, min(TILE, BLOCK_BYTES // (8 * max(1, width))))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield (*(part.column(k).to_numpy() for k in range(3)), matrix(part.column(3)))


def _first(rows: DataFrame, owner: list[str], k: int) -> DataFrame:
    """Heaps of all tasks merged: the best ``k`` of each owner, with their rank."""
    order = Window.partitionBy(*owner).orderBy(F.col("score").desc(), "id", "row")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _mine_block(rows: DataFrame, anchors: pa.Table, width: int, k_positive: int, k_negative: int) -> DataFrame:
    """Results for one block of anchors: anchor_id, positive_id, rank, negative_id and both scores."""
    spark = rows.sparkSession
    a = {name: anchors.column(name).to_numpy() for name in ("row", "id", "label")}
    a["vector"] = matrix(anchors.column("vector").combine_chunks())
    held = spark.sparkContext.broadcast(a)

    def positives(batches):
        a = held.value
        heaps, owners = Heaps(len(a["id"]), k_positive), np.arange(len(a["id"]))
        for row, vec, label, c in _tiles(batches, width):
            heaps.offer(scores(a["vector"], c), (a["label"][:, None] == label) & (a["row"][:, None] != row), owners, vec, row)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (heaps.owner, heaps.score, heaps.id, heaps.row)], ["owner", "score", "id", "row"])

    best = _first(rows.mapInArrow(positives, "owner long, score long, id long, row long"), ["owner"], k_positive).toArrow()
    # a positive's negatives are wanted from 30 to 90 hundredths of its score
    chosen = {name: best.column(name).to_numpy() for name in ("owner", "score", "id", "rank")}
    pairs = spark.sparkContext.broadcast(chosen)

    def windows(batches):
        a, p = held.value, pairs.value
        heaps = Heaps(len(p["owner"]), k_negative)
        # window ends as whole scores: ceil and floor of hundredths, by parts so that they cannot overflow
        whole, rest = p["score"] // 100, p["score"] % 100
        low, high = whole * LOW - (-rest * LOW // 100), whole * HIGH + rest * HIGH // 100
        by_rank = [np.flatnonzero(p["rank"] == r) for r in range(1, k_positive + 1)]
        for row, vec, label, c in _tiles(batches, width):
            tile = scores(a["vector"], c)
            other = a["label"][:, None] != label
            for at in by_rank:
                if len(at):
                    own = tile[p["owner"][at]]
                    heaps.offer(own, other[p["owner"][at]] & (own >= low[at][:, None]) & (own <= high[at][:, None]), at, vec, row)
        o = heaps.owner
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (o, p["owner"][o], p["id"][o], p["score"][o], heaps.score, heaps.id, heaps.row)],
                                         ["pair", "owner", "positive_id", "positive_score", "score", "id", "row"])

    found = rows.mapInArrow(windows, "pair long, owner long, positive_id long, positive_score long, score long, id long, row long")
    ids = F.element_at(F.lit([int(x) for x in a["id"]]), (F.col("owner") + 1).cast("int"))
    return _first(found, ["pair"], k_negative).select(ids.alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   k_positive: int = POSITIVES, k_negative: int = NEGATIVES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor``: an expression on the column ``id`` (the row's id); null is no.
    Scores are inner products of the quantised vectors; higher ones come first,
    ties by smaller id, then by row, so each of several rows with one id counts
    by itself: such an anchor is mined once a row. An anchor without a row of
    its label, or a positive without a score in its window (all with a negative
    score), gives no rows; an empty table gives none. Vectors of different
    lengths meet as if the shorter ended in zeros. Further columns are not read.
    """
    spark = vectors.sparkSession
    rows = staged(quantised(vectors, id_col, vector_col, label_col), "quantised")
    anchors = rows.where(F.coalesce(is_anchor, F.lit(False)))
    n, width = anchors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    blocks = -(-n * 8 * (width + 3) // block_bytes)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], schema)
    folder = work_folder(spark, "hard-negatives")
    for k in range(blocks):
        block = anchors.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k).toArrow()
        if block.num_rows:
            _mine_block(rows, block, width, k_positive, k_negative).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)
