"""Exact deduplication by deterministic block naming.

Each text (A-Z lower-cased, null as empty) is cut into blocks of fixed size.
Sorting the blocks gives every distinct one an integer name; adjacent names
are then paired, and sorted distinct pairs get integer names in turn, until
each document has one. Documents with as many blocks and the same last name
are equal, with no chance of collision: no hash stands in for a text.

A block that many documents share travels once per task and flush, with the
list of places it occurs at there, so a hot group of copies is spread out.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cauce.llm.blocked_bloom import rows_without
from cauce.llm.common import numbered, row_number_of, staged

BLOCK_BYTES = 4096
#: Bytes of distinct blocks a task gathers before it passes them on.
FLUSH_BYTES = 16 << 20


def _place_type(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("row", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("n", T.LongType()),
                         T.StructField("id", id_type), T.StructField("sha", T.StringType())])


def _blocks(docs: DataFrame, id_col: str, text_col: str, size: int, row_col: str | None) -> DataFrame:
    """(block, places): each distinct block of a flush with where it occurs.
    The first place of a document also carries its id and SHA-256."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"), row_number_of(row_col).alias("row"))
    place = _place_type(source.schema["id"].dataType)

    def flush(found, ids, arrow):
        order = sorted(found)
        offsets, row, pos, n, at, sha = [0], [], [], [], [], []
        for block in order:
            for r, p, k, i, s in found[block]:
                row.append(r); pos.append(p); n.append(k); at.append(i); sha.append(s)  # noqa: E702
            offsets.append(len(row))
        taken = pa.concat_arrays([x.cast(arrow) for x in ids]).take(pa.array(at, pa.int64())) if ids else pa.nulls(0, arrow)
        struct = pa.StructArray.from_arrays([pa.array(row, pa.int64()), pa.array(pos, pa.int64()), pa.array(n, pa.int64()), taken, pa.array(sha, pa.string())],
                                            names=["row", "pos", "n", "id", "sha"])
        return pa.RecordBatch.from_arrays([pa.array(order, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)], ["block", "places"])

    def run(batches):
        found, held, ids, before, arrow = {}, 0, [], 0, None
        for batch in batches:
            arrow = batch.schema.field(0).type
            ids.append(batch.column(0))
            for i, (value, number) in enumerate(zip(batch.column(1), batch.column(2))):
                data, row = value.as_py().lower(), number.as_py()
                digest, n = hashlib.sha256(data).hexdigest(), max(1, -(-len(data) // size))
                for p in range(n):
                    block = data[p * size:(p + 1) * size]
                    places = found.get(block)
                    if places is None:
                        places = found[block] = []
                        held += len(block)
                    places.append((row, p, n, before + i, digest if not p else None))
                    held += 100
                if held > FLUSH_BYTES:
                    yield flush(found, ids, arrow)
                    found, held = {}, 0
            before += batch.num_rows
            if not found:
                ids, before = [], 0
        if found:
            yield flush(found, ids, arrow)

    return source.mapInArrow(run, T.StructType([T.StructField("block", T.BinaryType()), T.StructField("places", T.ArrayType(place))]))


def _name_blocks(blocks: DataFrame) -> DataFrame:
    """One row per place with its block's integer name: the rank of the block
    in its sorted partition, after the partition's number."""
    place = blocks.schema["places"].dataType.elementType
    schema = T.StructType([*place.fields, T.StructField("name", T.LongType())])

    def run(batches):
        name, last = (TaskContext.get().partitionId() << 33) - 1, None
        for batch in batches:
            names, block = [], batch.column(0)
            for i in range(batch.num_rows):
                value = block[i].as_py()
                if value != last:
                    name, last = name + 1, value
                names.append(name)
            places = batch.column(1)
            flat, parents = places.flatten(), places.value_parent_indices()
            yield pa.RecordBatch.from_arrays([*flat.flatten(), pa.array(names, pa.int64()).take(parents)], schema.names)

    return blocks.repartition(F.col("block")).sortWithinPartitions("block").mapInArrow(run, schema)


def _pair_up(rows: DataFrame) -> DataFrame:
    """Pairs of adjacent names get names themselves; an odd last one pairs with -1."""
    even = F.col("pos") % 2 == 0
    pairs = staged(rows.groupBy("row", F.shiftright("pos", 1).alias("pos")).agg(
        F.max("n").alias("n"), F.max("id").alias("id"), F.max("sha").alias("sha"),
        F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b")), "pairs")
    names = staged(pairs.select("a", "b").distinct().sortWithinPartitions("a", "b").withColumn("name", F.monotonically_increasing_id()), "pair-names")
    return pairs.join(names, ["a", "b"]).select("row", "pos", "n", "id", "sha", "name")


def name_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per document: row (``row_col`` or a number made here), id, sha (SHA-256 of the
    normalised text) and its identity, the pair (n, name)."""
    rows = staged(_name_blocks(_blocks(docs, id_col, text_col, block_bytes, row_col)), "block-names")
    blocks = rows.agg(F.max("n")).first()[0] or 1
    done, width = [rows.where("n = 1")], 1
    if blocks > 1:
        rows = rows.where("n > 1")
    while width < blocks:
        width *= 2
        rows = staged(_pair_up(rows), "names")
        done.append(rows.where(F.col("n") <= width))
        rows = rows.where(F.col("n") > width)
    out = done[0]
    for level in done[1:]:
        out = out.unionByName(level)
    return out.select("row", "id", "sha", "n", "name")


def _decided(docs: DataFrame, block_bytes: int, id_col: str, text_col: str, row_col: str | None) -> DataFrame:
    named = staged(name_documents(docs, block_bytes, id_col, text_col, row_col), "identities")
    groups = staged(named.groupBy("n", "name").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("id", "row")).alias("stays")).where("size > 1"), "groups")
    stays = F.coalesce(F.col("stays"), F.struct("id", "row"))
    return named.join(groups, ["n", "name"], "left").select(
        "row", F.col("id").alias(id_col), stays["id"].alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (stays["row"] == F.col("row")).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, keep_id, group_size, kept, text_sha256: one row per input row.

    Of equal texts the row with the largest id stays; among rows that repeat
    it (or have no id at all) one stays. Null text counts as empty.
    """
    return _decided(docs, block_bytes, id_col, text_col, None).drop("row")


def kept_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the rows that stay."""
    rows, number = numbered(docs, "documents")
    dropped = staged(_decided(rows, block_bytes, id_col, text_col, number).where(~F.col("kept")).select(F.col("row").alias(number)), "dropped")
    return rows_without(rows, dropped, number).select(*docs.columns)
