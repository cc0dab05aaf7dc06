"""URL filter: blocked Bloom filter of listed keys, then an exact hash join.

The list holds prefix rules (a host with all its subdomains, a path's start,
allow or block) and single canonical URLs to block. Both become text keys. A
URL asks for its canonical form and for the pairs of host suffix and path
start that a rule may have. The blocked Bloom filter, one block of eight words
a key, drops nearly all keys that are not listed; the rest are joined with the
list on the whole key, which removes the false positives. The filter has a
fixed largest size: a longer list makes more false positives, no wrong verdict.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cauce.llm.blocked_bloom import KEYS_PER_BLOCK, MAX_BLOCKS, bloom, maybe_listed
from cauce.llm.common import lower_ascii, staged

#: Query parameters that name a visit and not a page: dropped from canonical URLs.
VISIT_PARAMETERS = r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"


# ---------------------------------------------------------------- URLs

def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """Between the host and ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    """Empty where ``url`` is null or has no ``://``."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def canonical(url: Column) -> Column:
    """Host without default port or final dot, path without a final slash, and
    the sorted query without parameters that only name the visit; null where
    there is no host. Scheme and fragment are left out."""
    host = F.regexp_replace(host_of(url), r"\.?(:80|:443)?$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(VISIT_PARAMETERS)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def _rule_key(host: Column, path: Column) -> Column:
    return F.concat(F.lit("r"), host, path)


def _url_key(url: Column) -> Column:
    return F.concat(F.lit("u"), url)


# ---------------------------------------------------------------- verdicts

def listing(rules: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """(key, rule, verdict, length) of the list, one row a key.

    ``rules``: host, path, verdict. Rows with a null are no rules; of equal
    rules with both verdicts, block stays. ``blocked``: column ``url`` of URLs
    that are blocked unless a rule fits; those without a host are left out.
    """
    host = lower_ascii(F.col("host"))
    rows = rules.where("host is not null and path is not null and verdict is not null").select(
        _rule_key(host, F.col("path")).alias("key"), F.concat(host, "path").alias("rule"), "verdict", F.length(F.concat(host, "path")).alias("length"))
    if blocked is not None:
        url = canonical(F.col("url"))
        rows = rows.unionByName(blocked.select(_url_key(url).alias("key"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"), F.lit(-1).alias("length")).where("key is not null"))
    return rows.groupBy("key").agg(F.max("rule").alias("rule"), F.max("verdict").alias("verdict"), F.max("length").alias("length"))


def judged(pages: DataFrame, rules: DataFrame, blocked: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``id_col``, host, path, rule, verdict of every row.

    A rule fits its host and all subdomains (whole labels) where the path
    starts with the rule's path; the longest host and path together wins (of
    equally long ones the last in text order). Where none fits, rule is null and
    the verdict is block for a canonical URL in ``blocked``, else allow. Null URLs, those without ``://``
    and empty hosts meet no list; an empty list allows all. Repeated rows are
    judged one by one.
    """
    spark = pages.sparkSession
    # labels and path lengths that rules have: no other keys are asked for
    shapes = rules.where("host is not null and path is not null and verdict is not null").agg(
        F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0)), F.sort_array(F.collect_set(F.length("path")))).first()
    labels, starts = shapes
    listed = staged(listing(rules, blocked), "listed")
    blocks = 1
    wanted = min(max_blocks, -(-listed.count() // KEYS_PER_BLOCK))
    while blocks < wanted:
        blocks *= 2
    held = spark.sparkContext.broadcast(bloom(listed.select(F.xxhash64("key").alias("h")), blocks))

    source = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    source = source.select("row", "id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = F.split("host", r"\.")
    last = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice("parts", -k, k), "."))
    source = source.withColumn("parts", parts).withColumn("ends", last if labels else F.array().cast("array<string>"))

    def asked(n: int) -> Column:
        """Rule keys of all host ends with the path's first ``n`` characters."""
        found = F.transform("ends", lambda h: _rule_key(h, F.left("path", F.lit(n))))
        return F.when(F.length("path") >= n, found).otherwise(F.array().cast("array<string>"))

    keys = F.concat(F.array_compact(F.array(_url_key(canonical(F.col("url"))))), *(asked(n) for n in starts))
    source = source.select("row", "id", "host", "path", F.when(F.col("host") != "", keys).otherwise(F.array().cast("array<string>")).alias("keys"))
    source = source.withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))

    def probe(batches):
        for batch in batches:
            keys, hashes = batch.column("keys"), batch.column("hashes")
            hit = maybe_listed(held.value, hashes.flatten().to_numpy())
            counts = np.concatenate([[0], np.cumsum(hit)])[hashes.offsets.to_numpy() - hashes.offsets[0].as_py()]
            hits = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), keys.flatten().filter(pa.array(hit)))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("row", "id", "host", "path")] + [hits], ["row", "id", "host", "path", "hits"])

    schema = T.StructType([*source.schema.fields[:4], T.StructField("hits", T.ArrayType(T.StringType()))])
    probed = staged(source.mapInArrow(probe, schema), "probed")
    # the join moves only rows with a possible hit; the list grows, so it is merged and never broadcast
    possible = probed.where("size(hits) > 0").select("row", F.explode("hits").alias("key"))
    found = possible.join(listed.hint("merge"), "key").groupBy("row").agg(F.max(F.struct("length", "rule", "verdict")).alias("best"))
    out = probed.select("row", "id", "host", "path").join(found.hint("merge"), "row", "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit("allow")).alias("verdict"))


def mirror_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Column ``url``: URLs of pages whose article a page with a smaller id holds too.

    The article is what stands before the first ``</article>`` and after the
    last ``<article>`` in that; without these marks the whole html. Null and
    empty html, empty articles and null ids mirror nothing. Only digests move.
    """
    article = F.substring_index(F.substring_index(F.col(html_col), "</article>", 1), "<article>", -1)
    body = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), article.alias("article")).where(F.octet_length("article") > 0)
    body = body.select("id", "url", F.sha2("article", 256).alias("digest"))
    first = body.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    return body.join(first.hint("merge"), "digest").where("id > first").select("url")
