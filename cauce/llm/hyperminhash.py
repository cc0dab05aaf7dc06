"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct shingles of five lower-cased words. The
shingles' hashes fall into buckets; each bucket's smallest is kept compressed,
as its number of leading zeros and the mantissa bits after them. Short
documents hash several times into fewer buckets, so that registers are hardly
ever empty; documents near a change of this layout carry both. Bands of
registers give candidate buckets. Inside one, candidates are compared with its
most popular members only; where members of different components remain, the
last round forms the pairs of different components that are left, each in one
bucket, so that no link is lost. Pairs that cannot be linked are never formed:
set sizes rule them out, and after the first round the shingles that a member
shares with no other one. Candidates pass the collision-corrected Jaccard
estimate, and links are confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cauce.llm.blocked_bloom import blocks_for, bloom, maybe_listed, rows_without
from cauce.llm.common import Tables, Words, mix64, numbered, row_number_of, slices, staged
from cauce.llm.components import components

SHINGLE = 5
#: A link: 100 * intersection >= percent * union. op2's own contract; callers may name another.
PERCENT = 85
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
MANTISSA_BITS = 10
_EMPTY = np.uint16(0xFFFF)
#: Shingles a bucket should get on average, and the most repetitions.
_PER_BUCKET, _MOST = 8, 64
#: Standard errors below the threshold at which the estimate still lets a candidate pass.
_SIGMAS = 5.0


def shingles(words: Words, hashed: np.ndarray, d: int) -> np.ndarray:
    """Sorted distinct shingle hashes of text ``d``; with fewer words, all of them as one."""
    w = hashed[words.first[d]:words.first[d + 1]]
    n = len(w)
    if not n:
        return w
    c = np.uint64(0x9FB21C651E98DF25)
    width = min(n, SHINGLE)
    h = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        h = h * c + w[k:n - width + 1 + k]
    return np.unique(mix64(h))


def repetitions(n: int) -> int:
    """How often a set of ``n`` is hashed: a power of two, falling with n."""
    return min(_MOST, 1 << max(0, math.ceil(math.log2(REGISTERS * _PER_BUCKET / n))))


def layouts(n: int, percent: int = PERCENT) -> list[int]:
    """Layouts a set of ``n`` is sketched in: its own, and that of the smallest
    set it may be linked to, if that differs."""
    return sorted({repetitions(n), repetitions(-(-n * percent // 100))})


def registers(hashes: np.ndarray, times: int) -> np.ndarray:
    """Compressed registers of a set hashed ``times`` times into REGISTERS/times buckets."""
    buckets = REGISTERS // times
    seeds = mix64(np.arange(1, times + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    h = mix64(hashes[None, :] ^ seeds[:, None])
    product = (h >> np.uint64(32)) * np.uint64(buckets)
    place = (product >> np.uint64(32)).astype(np.int64) + np.arange(times)[:, None] * buckets
    value = (product << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
    least = np.full(REGISTERS, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(least, place.ravel(), value.ravel())
    zeros = 64 - np.frexp(np.maximum(least >> np.uint64(1), 1).astype(np.float64))[1] - 1
    zeros = np.clip(zeros, 0, 62)
    mantissa = (least << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA_BITS)
    out = ((zeros.astype(np.uint64) << np.uint64(MANTISSA_BITS)) | mantissa).astype(np.uint16)
    out[least == np.uint64(0xFFFFFFFFFFFFFFFF)] = _EMPTY
    return out


def band_keys(reg: np.ndarray, times: int) -> np.ndarray:
    """One key per band that has a non-empty register."""
    bands = reg.reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64) + np.uint64(times * BANDS)
    for k in range(ROWS):
        h = mix64(h * np.uint64(0x9FB21C651E98DF25) + bands[:, k].astype(np.uint64))
    return h[(bands != _EMPTY).any(axis=1)]


def chance_of_collision(n: float, times: int) -> float:
    """Probability that registers of two disjoint sets of ``n`` are equal."""
    mean = n * times / REGISTERS
    zeros = np.arange(0, 40)[:, None]
    cells = 1 << MANTISSA_BITS
    low = (1 + np.arange(cells) / cells) * 2.0 ** -(zeros + 1)
    high = (1 + (np.arange(cells) + 1) / cells) * 2.0 ** -(zeros + 1)
    return float(((np.exp(-mean * low) - np.exp(-mean * high)) ** 2).sum())


_SKETCH = T.StructType([T.StructField("times", T.IntegerType()), T.StructField("registers", T.BinaryType())])


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None,
             percent: int = PERCENT) -> DataFrame:
    """One row per document: row (``row_col`` or a number made here), id, n (set size), print
    (digest of the whole set), keys of its bands, sketches by layout."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_number_of(row_col).alias("row"))
    schema = T.StructType([T.StructField("row", T.LongType()), source.schema[0], T.StructField("n", T.LongType()), T.StructField("print", T.BinaryType()),
                           T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sketches", T.ArrayType(_SKETCH))])
    arrow = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.struct([("times", pa.int32()), ("registers", pa.binary())]))]

    def run(batches):
        for batch in batches:
            for kept, texts in slices(batch, ["id", "row"], "text", 1 << 20):
                words = Words(texts)
                hashed = words.hashes()
                out = [kept["row"], kept["id"], [], [], [], []]
                for d in range(len(texts)):
                    s = shingles(words, hashed, d)
                    keys, held = [], []
                    for times in layouts(len(s), percent) if len(s) else ():
                        reg = registers(s, times)
                        keys.append(band_keys(reg, times))
                        held.append({"times": times, "registers": reg.tobytes()})
                    for column, value in zip((2, 3, 4, 5), (len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(),
                                                    np.concatenate(keys).view(np.int64) if keys else [], held)):
                        out[column].append(value)
                yield pa.RecordBatch.from_arrays([*out[:2], *(pa.array(v, kind) for v, kind in zip(out[2:], arrow))], schema.names)

    return source.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wanted: np.ndarray | None = None) -> DataFrame:
    """id, print, set (array of hashes) of each document that has words.

    ``wanted``: a Bloom filter of ids (hashed by ``id_hash``); documents it
    rules out are left out before their words are looked at.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("h", id_hash("id"))
    held = None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)
    schema = T.StructType([source.schema[0], T.StructField("print", T.BinaryType()), T.StructField("set", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            if held is not None:
                batch = batch.filter(pa.array(maybe_listed(held.value, batch.column("h").to_numpy())))
            for kept, texts in slices(batch, ["id"], "text", 1 << 20):
                words = Words(texts)
                hashed = words.hashes()
                sets = [shingles(words, hashed, d) for d in range(len(texts))]
                some = pa.array([len(s) > 0 for s in sets])
                rows = pa.RecordBatch.from_arrays([kept["id"], pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                                                   pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], schema.names)
                yield rows.filter(some)

    return source.mapInArrow(run, schema)


def id_hash(column: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def _estimated(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose estimated similarity may reach the threshold, with it."""
    left = held.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketches").alias("s_a"))
    right = held.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketches").alias("s_b"))
    near = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    both = pairs.join(left, "a").join(right, "b").where(near)
    layout = F.transform(F.filter("s_a", lambda x: F.exists("s_b", lambda y: y["times"] == x["times"])), lambda x: x["times"])
    both = both.select("a", "b", "n_a", "n_b", "s_a", "s_b", F.get(layout, F.lit(0)).alias("times")).where("times is not null")
    pick = lambda c: F.get(F.filter(c, lambda x: x["times"] == F.col("times")), F.lit(0))["registers"]
    both = both.select("a", "b", "n_a", "n_b", "times", pick("s_a").alias("r_a"), pick("s_b").alias("r_b"))
    chance: dict[tuple[int, int], float] = {}

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (5, 6))
            used = ((x != _EMPTY) | (y != _EMPTY)).sum(axis=1)
            same = ((x == y) & (x != _EMPTY)).sum(axis=1) / used
            size = np.sqrt(batch.column(2).to_numpy().astype(float) * batch.column(3).to_numpy())
            times, steps = batch.column(4).to_numpy(), np.round(4 * np.log2(size)).astype(int)
            for key in set(zip(times.tolist(), steps.tolist())) - chance.keys():
                chance[key] = chance_of_collision(2 ** (key[1] / 4), key[0])
            c = np.array([chance[k] for k in zip(times.tolist(), steps.tolist())])
            similarity = (same - c) / (1 - c)
            t = percent / 100
            passed = similarity >= t - _SIGMAS * np.sqrt(t * (1 - t) / used)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similarity)], ["a", "b", "similarity"]).filter(pa.array(passed))

    return both.mapInArrow(run, "a long, b long, similarity double")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) confirmed on the full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a")
    return both.select("a", "b", common.alias("i"), (F.size("x") + F.size("y") - common).alias("u")).where(F.col("i") * 100 >= F.col("u") * percent).select("a", "b")


def _labelled(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return nodes.withColumn("label", F.col("node"))
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _across(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs whose ends have different labels."""
    if labels is None:
        return pairs
    out = pairs.join(labels.select(F.col("node").alias("a"), F.col("label").alias("l_a")), "a", "left")
    out = out.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l_b")), "b", "left")
    return out.where(F.coalesce("l_a", "a") != F.coalesce("l_b", "b")).drop("l_a", "l_b")


def _possible(other: str, percent: int) -> Column:
    """Whether two members may be linked at all, from their set sizes and the
    shingles that no other open member has (those are in no intersection)."""
    n, m = F.col("n"), F.col(f"{other}_n")
    common = F.least(n - F.col("alone"), m - F.col(f"{other}_alone"))
    return common * (100 + percent) >= (n + m) * percent


def _with_alone(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Members with ``alone``: how many of their shingles no other member has."""
    nodes = members.select("node").distinct()
    held = sets.join(nodes, "node").select("node", F.explode("set").alias("shingle"))
    once = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.max("node").alias("node")).where("n = 1")
    alone = once.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    return members.drop("alone").join(alone, "node", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))


def _open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their labels, of the buckets that hold different components."""
    marked = _labelled(members.drop("label"), labels)
    ends = marked.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    return marked.join(ends, "key", "left_semi")


def _as_other(members: DataFrame) -> DataFrame:
    return members.select("key", *(F.col(c).alias(f"other_{c}") for c in members.columns if c != "key"))


def _star_pairs(members: DataFrame, leaders: int, percent: int) -> DataFrame:
    """Pairs of each bucket's ``leaders`` most popular members with all others."""
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), "node")
    lead = _as_other(members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= leaders).drop("place", "score"))
    met = members.join(lead, "key").where((F.col("node") != F.col("other_node")) & (F.col("label") != F.col("other_label")) & _possible("other", percent))
    return met.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")).distinct()


def _rest_pairs(members: DataFrame, percent: int) -> DataFrame:
    """All pairs of open buckets that can be linked and would join two
    components, each in the smallest of its buckets only."""
    mine = members.groupBy("node").agg(F.collect_set("key").alias("keys"))
    members = members.drop("score").join(mine, "node")
    once = F.array_min(F.array_intersect("keys", "other_keys")) == F.col("key")
    met = members.join(_as_other(members), "key").where((F.col("node") < F.col("other_node")) & (F.col("label") != F.col("other_label")) & _possible("other", percent) & once)
    return met.select(F.col("node").alias("a"), F.col("other_node").alias("b"))


#: Leaders of a bucket in the rounds before the last, which takes what is left.
_LEADERS = (1, 8)


def link_nodes(members: DataFrame, held: DataFrame, sets: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """(node, label) of linked nodes. ``members``: (key, node, n, score) of all band
    buckets with two nodes or more."""
    links, labels, tested = None, None, None
    members = members.withColumn("alone", F.lit(0).cast("long")).withColumn("label", F.col("node"))
    for leaders in (*_LEADERS, None):
        if labels is not None:
            members = _open_members(members, labels)
            members = tables.staged(_with_alone(members, sets) if leaders == _LEADERS[1] else members, "members")
            if members.isEmpty():
                break
        pairs = _star_pairs(members, leaders, percent) if leaders else _rest_pairs(members, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = tables.staged(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        near = tables.staged(_estimated(pairs, held, percent), "estimated")
        # first each node's best partner, then what still joins two components
        best = near.groupBy("b").agg(F.max_by("a", F.struct("similarity", "a")).alias("a"))
        for chosen in (best.select("a", "b"), near.select("a", "b")) if leaders else (near.select("a", "b"),):
            chosen = tables.staged(_across(chosen, labels), "chosen")
            if chosen.isEmpty():
                continue
            more = tables.staged(_confirmed(chosen, sets, percent), "links")
            links = more if links is None else links.unionByName(more)
            labels = tables.staged(components(links), "components")
        if labels is None:
            labels = tables.staged(components(pairs.select("a", "b").limit(0)), "components")
    return labels


def _buckets(rows: DataFrame, others: DataFrame) -> DataFrame:
    """(key, node, size) of the buckets with two nodes or more. Of buckets with
    the same nodes, as copies with few changes have in most bands, one stays."""
    keyed = rows_without(rows.select(F.col("row").alias("node"), "keys"), others.withColumnRenamed("row", "node"), "node").select("node", F.explode("keys").alias("key"))
    held = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("y"))
    one = held.where("size > 1").groupBy("size", "least", "x", "y").agg(F.min("key").alias("key"))
    return keyed.join(one.select("key", "size"), "key")


def _wanted_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, set) of the wanted nodes. A Bloom filter of their ids spares the other texts the way."""
    sets = shingle_sets(docs, id_col, text_col, bloom(wanted.select(id_hash("id").alias("h")), blocks_for(wanted.count()))).dropDuplicates(["id", "print"])
    pick = (sets["id"].eqNullSafe(wanted["id"])) & (sets["print"] == wanted["print"])
    return sets.join(wanted.select("node", "id", "print"), pick).select("node", "set")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, percent: int = PERCENT) -> DataFrame:
    """``id_col``, n_shingles, component_id, kept, and row: one row per input row.

    ``percent``: the least similarity of a link, in hundredths.

    Null text, empty text and text without words have no shingles and are
    linked with nothing. The component's smallest id names it; among rows that
    repeat that id (or have none) one is kept. Null ids never name a component
    that has another id. An empty table gives no rows.
    """
    tables = Tables(docs.sparkSession)
    rows = tables.staged(sketches(docs, id_col, text_col, row_col, percent), "sketches")
    copies = rows.where("n > 0").groupBy("print").agg(F.count(F.lit(1)).alias("size"), F.min("row").alias("node")).where("size > 1").select("print", "node")
    placed = rows.select("row", "id", "n", "print").join(copies, "print", "left").withColumn("node", F.coalesce("node", "row"))
    placed = tables.staged(placed, "placed")
    members = tables.staged(_buckets(rows, placed.where("node <> row").select("row")), "members")
    labels = None
    if not members.isEmpty():
        popular = tables.staged(members.groupBy("node").agg(F.sum("size").alias("score")), "scores")
        wanted = tables.staged(rows.join(popular, rows["row"] == popular["node"]).select("node", "id", "n", "print", "score", "sketches"), "wanted")
        members = tables.staged(members.join(wanted.select("node", "n", "score"), "node").select("key", "node", "n", "score"), "members")
        sets = tables.staged(_wanted_sets(docs, wanted, id_col, text_col), "sets")
        labels = link_nodes(members, wanted.select("node", "n", "sketches"), sets, percent, tables)
    first = _labelled(placed, labels).groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    first = first.where("size > 1").select("label", "first")
    out = _labelled(placed, labels).join(first, "label", "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("component_id"),
                     F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"), "row")
    out = staged(out, "near-duplicates")
    tables.discard()
    return out


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """All columns of one row of each component: that with the smallest id.

    Null and empty texts stay; of rows that repeat an id inside a component one
    stays. An empty table gives no rows.
    """
    rows, number = numbered(docs, "documents")
    dropped = near_duplicates(rows, id_col, text_col, number, percent).where(~F.col("kept")).select(F.col("row").alias(number))
    return rows_without(rows, dropped, number).select(*docs.columns)
