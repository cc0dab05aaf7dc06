"""Helpers shared by the operators of this subpackage.

Every operator reads only the columns it names (``id_col``, ``text_col``), so
further columns, whatever they are called, never meet its internal ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cauce.session import ensure_checkpoint_dir

#: Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\u000b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/cauce-llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage ends
    there, and every reader sees the same rows after an executor is lost."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Written tables that are removed once what is made of them is written itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(work_folder(self.spark, name))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def discard(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
        self.paths = []


#: Bytes of an Arrow batch on its way to a Python worker.
ARROW_BYTES = 1 << 18
_ARROW_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Have this session cut Arrow batches by bytes and not only by rows, so that
    long texts do not fill an executor. A smaller bound that is set stays."""
    now = spark.conf.get(_ARROW_KEY).rstrip("bB")
    if not now.isdigit() or int(now) <= 0 or int(now) > ARROW_BYTES:
        spark.conf.set(_ARROW_KEY, str(ARROW_BYTES))


def row_number_of(row_col: str | None) -> Column:
    """A unique number per row: a column that has one, or one made here."""
    return F.col(row_col) if row_col else F.monotonically_increasing_id()


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` written with a unique row number, and the number's column name
    (one that ``docs`` does not have)."""
    column = "row_number"
    while column in (c.lower() for c in docs.columns):
        column += "_"
    return staged(docs.withColumn(column, F.monotonically_increasing_id()), name), column


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast built-in ``lower``."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id's text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


# ---------------------------------------------------------------- numpy text

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_TABLE, _INSIDE_TABLE = _LOWER.tobytes(), (~_IS_SPACE).tobytes()
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit integers (public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def powers_of_base(n: int) -> np.ndarray:
    """At least the first ``n`` weights of the hashes' polynomial."""
    global _POWERS
    if len(_POWERS) < n:
        m = max(n, 4096)
        _POWERS = np.cumprod(np.full(m, _BASE, np.uint64)) * np.uint64(0x2545F4914F6CDD1D)
    return _POWERS


@lru_cache(maxsize=2)
def _running_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` weights, and what turns each place's weight into the first one's."""
    back = np.full(n, pow(int(_BASE), -1, 1 << 64), np.uint64)
    back[0] = 1
    return powers_of_base(n)[:n], np.cumprod(back)


class Words:
    """Words of a batch of texts as flat arrays.

    ``doc`` gives each word's text, ``start`` and ``end`` its byte place in
    ``data`` (the UTF-8 of all texts, A-Z lower-cased if asked, one blank
    between texts), ``first`` the number of words before each text.
    """

    def __init__(self, texts: list[bytes], lower: bool = True):
        joined = b" ".join(texts) + b" "
        # bytes.translate: several times as fast as indexing a table by bytes
        self.data = np.frombuffer(joined.translate(_LOWER_TABLE) if lower else joined, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.base = np.concatenate([[0], np.cumsum(lengths)])
        inside = np.frombuffer(joined.translate(_INSIDE_TABLE), bool)
        # the last byte is a blank, so every word ends
        edge = np.empty(len(inside), bool)
        edge[0] = inside[0]
        np.not_equal(inside[1:], inside[:-1], out=edge[1:])
        edges = np.flatnonzero(edge)
        self.start, self.end = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.start, self.base)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of the bytes of each word (or of given spans inside words)."""
        start = self.start if start is None else start
        end = self.end if end is None else end
        if not len(start):
            return np.zeros(0, np.uint64)
        length = end - start
        width = int(length.max())
        powers = powers_of_base(width + 1)
        out = np.zeros(len(start), np.uint64)
        if width <= 64:
            alive = np.arange(len(start))
            for k in range(width):
                alive = alive[length[alive] > k] if k else alive
                out[alive] += (self.data[start[alive] + k].astype(np.uint64) + np.uint64(1)) * powers[k]
        else:
            order = np.arange(len(start))
            short = order[length <= 64]
            out[short] = self.hashes(start[short], end[short])
            for i in order[length > 64]:
                seg = self.data[start[i]:end[i]].astype(np.uint64) + np.uint64(1)
                out[i] = np.sum(seg * powers[:len(seg)], dtype=np.uint64)
            return out
        return mix64(out + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def whole_hashes(self, piece: int = 1 << 17) -> np.ndarray:
        """``hashes()`` of the whole words, from running sums over about ``piece`` bytes at a
        time: a word's sum is a difference of two, divided by the weight of its place."""
        length = self.end - self.start
        out = np.empty(len(self), np.uint64)
        weights, inverse = _running_powers(piece)
        at = 0
        while at < len(self):
            base = self.start[at]
            last = int(np.searchsorted(self.end, base + piece, side="right"))
            if last <= at:
                # one word longer than a piece
                out[at] = self.hashes(self.start[at:at + 1], self.end[at:at + 1])[0]
                at += 1
                continue
            value = self.data[base:self.end[last - 1]].astype(np.uint64)
            value += np.uint64(1)
            value *= weights[:len(value)]
            sums = np.zeros(len(value) + 1, np.uint64)
            np.cumsum(value, out=sums[1:])
            first = self.start[at:last] - base
            here = sums.take(self.end[at:last] - base)
            here -= sums.take(first)
            here *= inverse.take(first)
            size = length[at:last]
            out[at:last] = np.where(size > 64, here, mix64(here + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
            at = last
        return out

    def text(self, i: int) -> str:
        return self.data[self.start[i]:self.end[i]].tobytes().decode("utf-8")


def slices(batch, columns: list[str], text: str, budget: int = 4 << 20) -> Iterator[tuple[dict, list[bytes]]]:
    """Cut an Arrow batch into runs of rows of about ``budget`` text bytes, so
    memory follows the longest text and not the batch; null text is empty."""
    names = batch.schema.names
    texts = batch.column(names.index(text))
    others = {c: batch.column(names.index(c)) for c in columns}
    at, size, rows = 0, 0, []
    for i in range(batch.num_rows):
        value = texts[i].as_py()
        data = value.encode("utf-8") if value else b""
        rows.append(data)
        size += len(data)
        if size >= budget:
            yield {c: v.slice(at, len(rows)) for c, v in others.items()}, rows
            at, size, rows = i + 1, 0, []
    if rows:
        yield {c: v.slice(at, len(rows)) for c, v in others.items()}, rows
