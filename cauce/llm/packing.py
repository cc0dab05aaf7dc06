"""Best-fit packing of documents into fixed-length sequences by linear grouping.

Lengths are integers up to the capacity, so their histogram (at most
``capacity`` rows, whatever the corpus size) describes the whole instance. The
driver plans on that histogram only: large lengths are sorted, cut into groups
of equal cardinality and rounded up to each group's largest; configurations of
these few sizes are optimised by a knapsack over the remaining demand; the
groups' actual lengths are put in their places; small lengths then go best-fit
into the room that is really left. The plan is run-length coded ("ranks a..b of
length L go to sequences s..t at offset o"), and Spark applies it to every
piece by its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cauce.llm.bpe import codec
from cauce.llm.common import slices, staged

CAPACITY = 2048
END_ID = 0
#: Lengths above this share of the capacity are large.
LARGE_SHARE = 1 / 8
#: Number of groups of equal cardinality that large lengths are rounded up in.
GROUPS = 1000


@dataclass
class _Run:
    """``count`` equal sequences that hold ``lengths`` and have ``free`` room."""
    count: int
    lengths: list[int]
    free: int


@dataclass
class Plan:
    """Rows (length, first rank, first sequence, offset), sorted; number of sequences."""
    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    n_sequences: int
    runs: list[_Run] = field(repr=False, default_factory=list)


def _groups(lengths: list[int], counts: dict[int, int], k: int) -> list[tuple[int, list[list[int]]]]:
    """Large lengths, descending, in ``k`` groups of equal cardinality:
    (size rounded up to, [[actual length, count], ...])."""
    total = sum(counts[x] for x in lengths)
    per = max(1, -(-total // k))
    out, room = [], 0
    for x in sorted(lengths, reverse=True):
        left = counts[x]
        while left:
            if not room:
                out.append((x, []))
                room = per
            take = min(left, room)
            out[-1][1].append([x, take])
            left -= take
            room -= take
    return out


def _configuration(sizes: list[int], demand: list[int], capacity: int) -> list[int]:
    """Uses of each size in one sequence: the largest size with demand, and what
    fills the rest best (bounded knapsack; larger sizes are tried first)."""
    first = next(i for i, d in enumerate(demand) if d)
    use = [0] * len(sizes)
    use[first] = 1
    room = capacity - sizes[first]
    parent = np.full(room + 1, -1, np.int32)
    parent[0] = len(sizes)
    for i, (s, d) in enumerate(zip(sizes, demand)):
        for _ in range(min(d - use[i], room // s)):
            fresh = (parent[s:] < 0) & (parent[:room + 1 - s] >= 0)
            if not fresh.any():
                break
            parent[s:][fresh] = i
            if parent[room] >= 0:
                break
        if parent[room] >= 0:
            break
    at = int(np.flatnonzero(parent >= 0)[-1])
    while at:
        i = int(parent[at])
        use[i] += 1
        at -= sizes[i]
    return use


def _take(queue: list[list[int]], n: int) -> list[tuple[int, int]]:
    out = []
    while n:
        length, have = queue[0]
        k = min(n, have)
        out.append((length, k))
        n -= k
        queue[0][1] -= k
        if not queue[0][1]:
            queue.pop(0)
    return out


def _substitute(slots: list[list[tuple[int, int]]], capacity: int) -> list[_Run]:
    """Cut a configuration's copies wherever a slot's actual length changes."""
    edges = sorted({e for slot in slots for e in np.cumsum([c for _, c in slot]).tolist()})
    out, at, place = [], 0, [[0, slot[0][1]] for slot in slots]
    for edge in edges:
        lengths = []
        for slot, p in zip(slots, place):
            while p[1] <= at:
                p[0] += 1
                p[1] += slot[p[0]][1]
            lengths.append(slot[p[0]][0])
        out.append(_Run(edge - at, lengths, capacity - sum(lengths)))
        at = edge
    return out


def _best_fit(runs: list[_Run], counts: dict[int, int], small: list[int], capacity: int) -> list[_Run]:
    """Small lengths, descending, each into the fullest sequence that takes it."""
    by_free: dict[int, list[_Run]] = defaultdict(list)
    for r in runs:
        by_free[r.free].append(r)
    frees = sorted(by_free)

    def put(run: _Run) -> None:
        if run.count:
            if not by_free[run.free]:
                bisect.insort(frees, run.free)
            by_free[run.free].append(run)

    for x in sorted(small, reverse=True):
        n = counts[x]
        while n:
            i = bisect.bisect_left(frees, x)
            if i < len(frees):
                free = frees[i]
                run = by_free[free].pop()
                if not by_free[free]:
                    frees.pop(i)
            else:
                run = _Run(-(-n // (capacity // x)), [], capacity)
            each = run.free // x
            full = min(run.count, n // each)
            n -= full * each
            rest = run.count - full
            put(_Run(full, run.lengths + [x] * each, run.free - each * x))
            if rest and n:
                put(_Run(1, run.lengths + [x] * n, run.free - n * x))
                rest, n = rest - 1, 0
            put(_Run(rest, run.lengths, run.free))
    return [r for rs in by_free.values() for r in rs if r.lengths]


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large_share: float = LARGE_SHARE) -> Plan:
    """Linear grouping on a histogram of lengths (1..capacity -> number of pieces)."""
    counts = {int(k): int(v) for k, v in counts.items() if v}
    large = [x for x in counts if x > capacity * large_share]
    grouped = _groups(large, counts, groups)
    sizes = [s for s, _ in grouped]
    demand = [sum(c for _, c in q) for _, q in grouped]
    runs: list[_Run] = []
    while any(demand):
        use = _configuration(sizes, demand, capacity)
        copies = min(d // u for d, u in zip(demand, use) if u)
        slots = []
        for i, u in enumerate(use):
            for _ in range(u):
                slots.append(_take(grouped[i][1], copies))
            demand[i] -= u * copies
        runs += _substitute(slots, capacity)
    runs = _best_fit(runs, counts, [x for x in counts if x <= capacity * large_share], capacity)
    rows, used, sequence = [], defaultdict(int), 0
    for r in runs:
        offset = 0
        for x in r.lengths:
            rows.append((x, used[x], sequence, offset))
            used[x] += r.count
            offset += x
        sequence += r.count
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Plan(table[:, 0], table[:, 1], table[:, 2], table[:, 3], sequence, runs)


_PIECE_FIELDS = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                 T.StructField("ids_crc32", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())]


def tokenize_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each document (its ids, then the end id): only documents above
    the capacity are cut, the first piece taking the remainder. ``part`` is the
    task and ``place`` the piece's number among those of its length there."""
    end = np.array([END_ID], "<u4").tobytes()
    source = docs.select(id_col, text_col)
    schema = T.StructType([source.schema[0], *_PIECE_FIELDS])

    def encoded(batch):
        for _, texts in slices(batch, [], text_col):
            for ids in codec(path).encode_all(texts):
                yield ids + end

    def run(batches):
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows, piece, start, length, crc, place = [], [], [], [], [], []
            for i, ids in enumerate(encoded(batch)):
                n = len(ids) // 4
                at, k, size = 0, 0, n % capacity or capacity
                while at < n:
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at:4 * (at + size)]))
                    place.append(seen[size])
                    seen[size] += 1
                    at, k, size = at + size, k + 1, capacity
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(crc, pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(place, pa.int64())], schema.names)

    return source.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, groups: int = GROUPS, large_share: float = LARGE_SHARE,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of length 1 (the end id). Repeated rows
    and ids are packed each on their own; an empty table gives no rows.
    """
    pieces = staged(tokenize_pieces(docs, path, capacity, id_col, text_col), "pieces")
    per_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    plan = plan_packing({r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}, capacity, groups, large_share)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = pieces.join(shift, ["part", "length"]).select(id_col, "piece", "start", "length", "ids_crc32", (F.col("shift") + F.col("place")).alias("rank"))
    key = (plan.length << 44) | plan.rank
    table = (key, plan.rank, plan.sequence, plan.offset)

    def assign(batches):
        keys, first, sequence, offset = table
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            i = np.searchsorted(keys, (length << 44) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence[i] + rank - first[i]), pa.array(offset[i])],
                                             [*batch.schema.names[:5], "sequence_id", "offset"])

    schema = T.StructType([*ranked.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(assign, schema)
