"""Source divergence audit: term distributions of sources, compared in Arrow.

Counting is an Arrow compute pipeline inside ``mapInArrow``: texts are
lower-cased (``ascii_lower``), split at runs of other characters
(``split_pattern_regex``), encoded (``dictionary_encode``) and counted by hash
``group_by``, first per document, then per language, source and term. Spark
merges the partial counts. The kept terms are dealt into columnar shards that
hold all sources of their terms; each shard gives its part of every pair's
distance and its best terms of every source, which add up and merge exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cauce.llm.common import staged

#: Fixed value: what separates terms, runs of ASCII characters that are no letters.
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCUMENTS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Text bytes counted at once, rows of partial counts a task holds, rows a shard should get, sources compared at once.
SLICE_BYTES, HELD_ROWS, SHARD_ROWS, SOURCES = 8 << 20, 1 << 20, 200_000, 512
_COUNTS = "lang string, source string, term string, n long, docs long"


def _counted(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """lang, source, term, n, docs of some documents; a null term counts the documents."""
    rows = len(text)
    groups = pa.table({"lang": lang, "source": source, "docs": pa.array(np.ones(rows, np.int64))}).group_by(["lang", "source"], use_threads=False).aggregate([("docs", "sum")])
    empty = pa.table({"lang": groups["lang"], "source": groups["source"], "term": pa.nulls(groups.num_rows, pa.string()),
                      "n": pa.array(np.zeros(groups.num_rows, np.int64)), "docs": groups["docs_sum"]})
    parts = pc.split_pattern_regex(pc.ascii_lower(text), pattern=SEPARATORS)
    terms, doc = parts.flatten(), pc.list_parent_indices(parts)
    some = pc.not_equal(pc.binary_length(terms), 0)
    coded = terms.filter(some).dictionary_encode()
    per_doc = pa.table({"doc": doc.filter(some), "term": coded.indices}).group_by(["doc", "term"], use_threads=False).aggregate([([], "count_all")])
    # documents of one language and source share a number
    own = pa.table({"lang": lang.dictionary_encode().indices, "source": source.dictionary_encode().indices})
    number = pc.add(pc.multiply(own["lang"].cast(pa.int64()), rows), own["source"].cast(pa.int64())).combine_chunks()
    by_term = pa.table({"group": number.take(per_doc["doc"].combine_chunks()), "term": per_doc["term"], "n": per_doc["count_all"], "doc": per_doc["doc"]})
    merged = by_term.group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("n", "count"), ("doc", "min")])
    at = merged["doc_min"].combine_chunks()
    return pa.concat_tables([empty, pa.table({"lang": lang.take(at), "source": source.take(at), "term": coded.dictionary.take(merged["term"].combine_chunks()),
                                              "n": merged["n_sum"], "docs": merged["n_count"]})])


def _runs(texts: pa.Array):
    """(start, length) of runs of rows of about ``SLICE_BYTES``."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(size):
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES)) + 1
        yield at, min(end, len(size)) - at
        at = end


def partial_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n, docs: counts of each task's documents, a few rows a key."""
    source = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))

    def run(batches):
        held, rows = [], 0

        def merged():
            table = pa.concat_tables(held).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
            return table.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])

        for batch in batches:
            lang, source, text = (batch.column(k).cast(pa.string()) for k in range(3))
            for at, n in _runs(text):
                held.append(_counted(lang.slice(at, n), source.slice(at, n), text.slice(at, n)))
                rows += held[-1].num_rows
                if rows > HELD_ROWS:
                    held = [merged()]
                    rows = held[0].num_rows
                    if rows > HELD_ROWS // 2:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if held:
            yield from merged().to_batches()

    return source.mapInArrow(run, _COUNTS)


def probability(count: np.ndarray, total, terms: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)), by parts of a
    thousand so that no step leaves 64 bits."""
    over, out = count + SMOOTHING, np.zeros_like(count)
    under = total + SMOOTHING * terms
    for _ in range(3):
        over = over * 1000
        out = out * 1000 + over // under
        over = over % under
    return out + 1


def _shard(left: pa.Table, right: pa.Table) -> pa.Table:
    """One shard of a language's terms, for the sources of one or two blocks.

    ``left``: term, source, n, in_lang (the term's count in the language);
    ``right``: block, source, total (its count of kept terms), and lang, terms,
    lang_total, shard, low, high (the blocks). Gives parts of pair distances, each the
    sum over the shard's terms of |p - q| less what the pair has where both counts are 0
    (shard 0 adds that for all terms), and, for one block, its sources' best terms.
    """
    right = right.sort_by([("block", "ascending"), ("source", "ascending")])
    names, totals = right["source"].combine_chunks(), right["total"].to_numpy()
    terms, lang_total, shard, low, high = (right[k][0].as_py() for k in ("terms", "lang_total", "shard", "low", "high"))
    coded = left["term"].combine_chunks().dictionary_encode()
    column, n = coded.indices.to_numpy(), left["n"].to_numpy()
    row = pc.index_in(left["source"].combine_chunks(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
    width, rows = len(coded.dictionary), len(names)
    out = []

    def emit(source: np.ndarray, part: str, item: pa.Array, value: np.ndarray) -> None:
        out.append(pa.table({"lang": pa.array([right["lang"][0].as_py()] * len(source), pa.string()), "source": names.take(pa.array(source)),
                             "part": pa.array([part] * len(source), pa.string()), "item": item, "value": pa.array(value, pa.int64())}))

    if low == high:
        value = probability(n, totals[row], terms) - probability(left["in_lang"].to_numpy(), lang_total, terms)
        by_text = np.empty(width, np.int64)
        by_text[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(width)
        best = np.flatnonzero((value > 0) & (n > 0))
        best = best[np.lexsort((by_text[column[best]], -value[best], row[best]))]
        first = np.searchsorted(row[best], np.arange(rows))
        best = best[np.arange(len(best)) - first[row[best]] < TOP]
        emit(row[best], "term", coded.dictionary.take(pa.array(column[best])), value[best])

    absent = probability(np.zeros(rows, np.int64), totals, terms) if terms else np.zeros(rows, np.int64)
    apart = np.abs(absent[:, None] - absent)
    total = apart * (terms if shard == 0 else 0)
    step = max(1, (1 << 22) // rows)
    by_column = np.argsort(column, kind="stable")
    for at in range(0, width, step):
        own = by_column[np.searchsorted(column[by_column], at):np.searchsorted(column[by_column], at + step)]
        counts = np.zeros((rows, min(step, width - at)), np.int64)
        counts[row[own], column[own] - at] = n[own]
        p = probability(counts, totals[:, None], terms)
        for i in range(rows):
            total[i] += np.abs(p - p[i]).sum(axis=1) - apart[i] * p.shape[1]
    block = right["block"].to_numpy()
    i, j = np.nonzero((block[:, None] == low) & (block == high) & (np.arange(rows)[:, None] < np.arange(rows)))
    emit(i, "pair", names.take(pa.array(j)), total[i, j])
    return pa.concat_tables(out)


def divergences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_documents: int = MIN_DOCUMENTS, sources: int = SOURCES) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: every other source of the language, by the distance of the
    two distributions over the language's kept terms. Part ``term``: the 50
    terms that the source has most above its language. Ties by text. Null text,
    language and source count as empty; a source without kept terms has the
    smoothed distribution, a language without any has distances of 0. Repeated
    rows count each. An empty table gives no rows; a single source has no pairs.
    ``sources``: how many sources a task compares with as many others.
    """
    counts = staged(partial_counts(docs, text_col, lang_col, source_col).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    found = counts.where("term is not null")
    kept = found.groupBy("lang", "term").agg(F.sum("docs").alias("in_docs"), F.sum("n").alias("in_lang")).where(F.col("in_docs") >= min_documents)
    kept = staged(kept.select("lang", "term", "in_lang"), "kept")
    cells = staged(found.select("lang", "term", "source", "n").join(kept.hint("merge"), ["lang", "term"]), "cells")
    langs = kept.groupBy("lang").agg(F.sum("in_lang").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("cells"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "lang_total", "terms", "cells")))
    in_lang = Window.partitionBy("lang")
    groups = groups.withColumn("block", ((F.row_number().over(in_lang.orderBy("source")) - 1) / sources).cast("int"))
    groups = groups.withColumn("blocks", F.max("block").over(in_lang) + 1).withColumn("shards", F.ceil(F.greatest(F.sum("cells").over(in_lang), F.lit(1)) / SHARD_ROWS).cast("int"))
    groups = staged(groups, "groups")

    def with_blocks(rows: DataFrame) -> DataFrame:
        """Rows go to every pair of blocks that their own block is in."""
        other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return other.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    keys = ["lang", "shard", "low", "high"]
    left = with_blocks(cells.join(groups.select("lang", "source", "block", "blocks", "shards"), ["lang", "source"]))
    left = left.select(F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "lang", "low", "high", "term", "source", "n", "in_lang")
    right = with_blocks(groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))).select(*keys, "block", "source", "total", "terms", "lang_total")
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_shard, "lang string, source string, part string, item string, value long")
    parts = staged(parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "parts")
    both = parts.unionByName(parts.where("part = 'pair'").select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return both.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= TOP)).select("lang", "source", "part", "item", "value", "rank")
