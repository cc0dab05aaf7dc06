"""Blocked Bloom filter: a key sets one bit in each of the eight words of one block.

Tasks make the bits of their keys, Spark joins them block by block, and the
filter, of a fixed largest size, goes to all tasks. More keys than it is meant
for make more false positives and never a false negative.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = 8
#: Keys a block should get, and most blocks: the filter has at most 4 MiB.
KEYS_PER_BLOCK, MAX_BLOCKS = 16, 1 << 17
_SALTS = (np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32) | np.uint64(1)).astype(np.uint32)


def _places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and its bit in each of the block's words."""
    h = h.view(np.uint64)
    block = ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    return block, (h.astype(np.uint32)[:, None] * _SALTS) >> np.uint32(27)


def bloom(hashes: DataFrame, blocks: int) -> np.ndarray:
    """The filter of a column ``h`` of 64-bit hashes: blocks x words. Tasks make
    the bits of their keys, which are joined block by block."""
    names = [f"w{k}" for k in range(WORDS)]

    def bits(batches):
        for batch in batches:
            block, bit = _places(batch.column(0).to_numpy(), blocks)
            words = (np.uint32(1) << bit).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(block), *(pa.array(words[:, k]) for k in range(WORDS))], ["block", *names])

    schema = "block long, " + ", ".join(f"{n} int" for n in names)
    merged = hashes.mapInArrow(bits, schema).groupBy("block").agg(*(F.bit_or(n).alias(n) for n in names)).toArrow()
    out = np.zeros((blocks, WORDS), np.uint32)
    for k, n in enumerate(names):
        out[merged["block"].to_numpy(), k] = merged[n].to_numpy().view(np.uint32)
    return out


def maybe_listed(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """False only where the hash was never put in."""
    block, bit = _places(h, len(filter_))
    return ((filter_[block] >> bit) & np.uint32(1)).all(axis=1)


def blocks_for(n: int) -> int:
    """Blocks of a filter of ``n`` keys: a power of two, up to the fixed most."""
    blocks = 1
    while blocks < min(MAX_BLOCKS, -(-n // KEYS_PER_BLOCK)):
        blocks *= 2
    return blocks


def rows_without(rows: DataFrame, listed: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` (never null) is not in ``listed``, a written table.

    Rows that the filter rules out stay where they are; only the others, listed
    or not, are moved and meet the list itself in a join.
    """
    n = listed.count()
    if not n:
        return rows
    hashed = F.xxhash64(column)
    held = rows.sparkSession.sparkContext.broadcast(bloom(listed.select(hashed.alias("h")), blocks_for(n)))
    extra = "h"
    while extra in (c.lower() for c in rows.columns):
        extra += "_"
    source = rows.withColumn(extra, hashed)

    def part(suspected: bool) -> DataFrame:
        def run(batches):
            for batch in batches:
                found = maybe_listed(held.value, batch.column(batch.num_columns - 1).to_numpy())
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(found == suspected))

        return source.mapInArrow(run, T.StructType(rows.schema.fields))

    return part(False).unionByName(part(True).join(listed.select(column), column, "left_anti").select(*rows.columns))
