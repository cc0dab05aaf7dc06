"""Upload readers and person exports.

ID files: every non-empty cell of every line, trimmed, one flat list; a
UTF-8 BOM is removed; ragged rows are legal. ``spark.read.csv`` is not
used for ids because it drops cells beyond the first row's width.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cauce.functions.ids import strip_ws

#: Largest id file that is one row; larger ones are read in splits.
WHOLE_FILE_BYTES = 1 << 26

#: Stands for a break that splits; no text file has it.
_MARK = "\u0001\ue000\u0001"


def _split_unquoted(text: Column, pattern: str) -> Column:
    """Pieces of ``text`` between breaks (``pattern``) that an even number of quotes
    follows, in one pass over the text however many quotes it has."""
    from_end = F.transform(F.reverse(F.split(text, '"')), lambda x, i: F.when(i % 2 == 0, F.regexp_replace(x, pattern, _MARK)).otherwise(x))
    return F.split(F.array_join(F.reverse(from_end), '"'), _MARK)


def id_lines(files: DataFrame) -> DataFrame:
    """Lines of whole files: adds ``line_no`` and ``value``. A quoted CSV cell may hold line breaks."""
    csv = F.endswith(F.lower("file_path"), F.lit(".csv"))
    text = F.regexp_replace("content", "^\uFEFF", "")
    lines = F.when(csv & F.contains(text, F.lit('"')), _split_unquoted(text, r"\r?\n")).otherwise(F.split(text, r"\r?\n"))
    return files.select(*[c for c in files.columns if c != "content"], F.posexplode(lines).alias("line_no", "value"))


def _number_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``line_no`` = first byte of the line's file block + lines of that block so far.
    A line has a byte at least, so numbers of one block end before the next begins."""
    block, done = None, 0
    for batch in batches:
        paths, starts = batch.column("file_path").dictionary_encode(), batch.column("start").to_numpy()
        codes = paths.indices.to_numpy()
        cuts = [0, *(np.flatnonzero((starts[1:] != starts[:-1]) | (codes[1:] != codes[:-1])) + 1).tolist(), len(starts)]
        numbers = np.empty(len(starts), np.int64)
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                here = (paths.dictionary[codes[a]].as_py(), starts[a])
                done = done if here == block else 0
                numbers[a:b] = starts[a] + done + np.arange(b - a)
                block, done = here, done + b - a
        yield pa.RecordBatch.from_arrays([batch.column("file_path"), pa.array(numbers), batch.column("value")], ["file_path", "line_no", "value"])


def split_id_lines(spark: SparkSession, paths: str | list[str], above: int = 0) -> DataFrame:
    """Lines of id files of any size, read in splits by many tasks: (file_path,
    line_no, value). ``line_no`` orders the lines of a file and has gaps. A line
    break always ends a cell here, also inside quotes. Only files above ``above`` bytes."""
    lines = (spark.read.format("text").option("lineSep", "\n").option("pathGlobFilter", "*.{csv,txt}").load(paths)
             .filter(F.col("_metadata.file_size") > above)
             .select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("start"), F.regexp_replace("value", "\r$", "").alias("value")))
    return lines.mapInArrow(_number_lines, "file_path string, line_no bigint, value string")


def read_id_files(spark: SparkSession, path: str, whole_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """Lines of ``.csv``/``.txt`` files under ``path`` with file and line identity.

    A file of at most ``whole_bytes`` is one row (``wholetext``), so quoted cells
    may hold line breaks; a larger one is read in splits by ``split_id_lines``.
    No size is refused: the gate judges the ids. Empty files have no lines.
    """
    size = F.col("_metadata.file_size")
    files = (spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.{csv,txt}").load(path)
             .filter((size > 0) & (size <= whole_bytes)).select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("file_path")))
    small = id_lines(files).withColumn("line_no", F.col("line_no").cast("bigint"))
    return small.unionByName(split_id_lines(spark, path, above=whole_bytes))


def parse_id_lines(lines: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Cells of each line as rows: (keep..., pos, raw_id).

    ``pos`` is the struct (line, cell), so it orders cells however long a line
    is. Lines of ``.txt`` files (by ``file_path``) are one id each; others are
    CSV: cells end at commas outside quotes, quotes around a cell go and
    doubled ones inside become one. Blank cells are dropped; cells are stripped.
    """
    keep = keep or []
    line_no = F.col("line_no") if "line_no" in lines.columns else F.lit(0)
    txt = F.endswith(F.lower("file_path"), F.lit(".txt")) if "file_path" in lines.columns else F.lit(False)
    value = F.regexp_replace(F.col("value"), "^\uFEFF", "")
    split = F.when(F.contains(value, F.lit('"')), _split_unquoted(value, ",")).otherwise(F.split(value, ","))
    cells = lines.select(*keep, line_no.alias("__line"), txt.alias("__txt"), F.posexplode(F.when(txt, F.array(value)).otherwise(split)).alias("__cell", "__raw"))
    bare = strip_ws(F.col("__raw"))
    quoted = F.regexp_like(bare, F.lit(r'(?s)\A".*"\z')) & ~F.col("__txt") & (F.length(bare) >= 2)
    inner = strip_ws(F.replace(F.substring(bare, 2, F.length(bare) - 2), F.lit('""'), F.lit('"')))
    raw = F.when(quoted, inner).otherwise(bare)
    pos = F.struct(F.col("__line").cast("bigint").alias("line"), F.col("__cell").cast("bigint").alias("cell"))
    return cells.select(*keep, pos.alias("pos"), raw.alias("raw_id")).filter(F.length("raw_id") > 0)


def export_persons_csv(persons: DataFrame, path: str) -> None:
    """Person CSV export: header, label arrays as JSON text, booleans as 0/1."""
    cols = []
    for f in persons.schema.fields:
        if f.dataType.typeName() == "array":
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        elif f.dataType.typeName() == "boolean":
            cols.append(F.col(f.name).cast("int").alias(f.name))
        else:
            cols.append(F.col(f.name))
    persons.select(*cols).write.mode("overwrite").option("header", True).csv(path)
