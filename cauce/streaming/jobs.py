"""Structured Streaming jobs.

X-01 dropped id files -> parsed cells -> triage (one batch per file content)
X-02 duplicate-safe intake: a file with stored content is not processed again
X-03 campaign per micro-batch with the size gate and idempotent tables
     (``foreachBatch``, anti-join on the keys stored for the batches in hand)
X-04 live batch progress: finished over total of each accepted batch
X-05 interaction stream -> windowed channel accept counts, by segment too, and smoothed rates

All jobs take their checkpoint folder under ``spark.checkpoint.dir`` so a
restarted driver resumes exactly where it stopped.
"""

from __future__ import annotations

import os
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cauce import fixed
from cauce.operators.campaign import person_results
from cauce.operators.intake import accepted_ids, intake_counts, triage_ids
from cauce.operators.messages import compose_messages
from cauce.operators.nbo import segment
from cauce.session import shared_path
from cauce.sources.uploads import WHOLE_FILE_BYTES, id_lines, parse_id_lines, split_id_lines

INTERACTION_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def id_file_stream(spark: SparkSession, in_dir: str, max_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """X-01: whole dropped ``.csv``/``.txt`` files; the batch id is the hash of
    the content, so a file sent again is the same batch, whatever its name.
    ``maxFileAge`` keeps files that arrive with an old time (the source would
    leave out those a week behind the newest). A file above ``max_bytes`` is not
    held as one row: its content is null (its lines are read in splits) and its
    id the hash of its path, size and time."""
    def source(kind: str, schema: str) -> DataFrame:
        return (spark.readStream.format(kind).schema(schema).option("wholetext", True).option("pathGlobFilter", "*.{csv,txt}")
                .option("maxFilesPerTrigger", 100).option("maxFileAge", "36500d").load(in_dir))

    small = (source("text", "value string").select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("size"))
             .filter((F.col("size") > 0) & (F.col("size") <= max_bytes))
             .select("content", "file_path", F.sha2(F.col("content").cast("binary"), 256).alias("batch_id")))
    large = (source("binaryFile", "path string, modificationTime timestamp, length long, content binary").filter(F.col("length") > max_bytes)
             .select(F.lit(None).cast("string").alias("content"), F.col("_metadata.file_path").alias("file_path"),
                     F.sha2(F.concat_ws("|", "path", "length", F.unix_micros("modificationTime")).cast("binary"), 256).alias("batch_id")))
    return small.unionByName(large)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a table folder exists; an unreachable store raises."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _stored(spark: SparkSession, path: str, batches: DataFrame) -> DataFrame | None:
    """Rows already stored for the batches in hand: the table is partitioned
    by ``bucket`` and ``batch_id``, so only their folders are read."""
    if not _exists(spark, path):
        return None
    return spark.read.parquet(path).join(F.broadcast(batches), ["bucket", "batch_id"], "left_semi")


def run_campaign_stream(spark: SparkSession, in_dir: str, persons: DataFrame, out_dir: str,
                        checkpoint: str | None = None, available_now: bool = True, max_bytes: int = WHOLE_FILE_BYTES):
    """X-02, X-03: per micro-batch triage -> size gate -> offers -> messages.

    Uploads are told apart by content hash: one that is stored already (in any
    earlier micro-batch, however old its file) is not processed again, so a
    replay or a re-sent file changes nothing. Three tables, each partitioned by
    ``bucket`` (64 by batch id), hold batches (with the gate's verdict and
    counts), results and outbox. The batch row is written last; a micro-batch
    that broke off before it is redone, and what it had written is left out by
    key. A failing read fails the micro-batch. Uploads above ``max_bytes`` are
    read in splits; the gate judges the ids of every file, whatever its size.
    """
    checkpoint = checkpoint or shared_path(spark, "stream-campaign")
    paths = {t: os.path.join(out_dir, t) for t in ("batches", "results", "outbox")}

    def write(df: DataFrame, table: str, keys: list[str], batches: DataFrame) -> None:
        done = _stored(spark, paths[table], batches)
        if done is not None:
            df = df.join(done.select(*keys), keys, "left_anti")
        df.write.mode("append").partitionBy("bucket").parquet(paths[table])

    def handle(files: DataFrame, number: int) -> None:
        files = files.dropDuplicates(["batch_id"]).withColumn("bucket", F.pmod(F.crc32(F.col("batch_id").cast("binary")), F.lit(64)).cast("int")).persist()
        try:
            batches = files.select("bucket", "batch_id")  # at most maxFilesPerTrigger rows
            done = _stored(spark, paths["batches"], batches)
            fresh = files if done is None else files.join(F.broadcast(done.select("batch_id")), "batch_id", "left_anti")
            if fresh.isEmpty():
                return
            lines = id_lines(fresh.filter(F.col("content").isNotNull()).select("batch_id", "file_path", "content")).withColumn("line_no", F.col("line_no").cast("bigint"))
            large = [r["file_path"] for r in fresh.filter(F.col("content").isNull()).select("file_path").collect()]  # at most maxFilesPerTrigger
            if large:
                ids = F.broadcast(fresh.select("batch_id", "file_path"))
                lines = lines.unionByName(split_id_lines(spark, [unquote(p) for p in large]).join(ids, "file_path"))
            cells = parse_id_lines(lines, keep=["batch_id", "file_path"])
            triaged = triage_ids(cells).persist()
            counts = intake_counts(triaged)
            results = person_results(accepted_ids(triaged, counts), persons).join(F.broadcast(batches), "batch_id").persist()
            write(results.select("bucket", "batch_id", "person_id", "result_status"), "results", ["batch_id", "person_id"], batches)
            messages = compose_messages(results.filter(F.col("result_status") == "processed"))
            write(messages.select("bucket", "batch_id", "person_id", "product_id", "channel", "contact_window", "message_text", "message_source"),
                  "outbox", ["batch_id", "person_id"], batches)
            gated = fresh.select("bucket", "batch_id").join(counts, "batch_id", "left").withColumn("gate", F.coalesce("gate", F.lit("too_small")))
            write(gated.select("bucket", "batch_id", "gate", "raw_count", "count", "invalid_count", "duplicate_count"), "batches", ["batch_id"], batches)
            results.unpersist()
            triaged.unpersist()
        finally:
            files.unpersist()

    q = (id_file_stream(spark, in_dir, max_bytes).writeStream.foreachBatch(handle)
         .option("checkpointLocation", checkpoint))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="30 seconds")
    return q.start()


def progress(spark: SparkSession, out_dir: str) -> DataFrame:
    """X-04: finished persons over all valid ids of each accepted batch, from
    the tables the stream writes (0 while a batch has no result yet)."""
    batches = spark.read.parquet(os.path.join(out_dir, "batches")).filter(F.col("gate") == "accepted")
    finished = spark.read.parquet(os.path.join(out_dir, "results")).groupBy("batch_id").agg(F.count(F.lit(1)).alias("finished"))
    return batches.join(finished, "batch_id", "left").select(
        "batch_id", F.coalesce("finished", F.lit(0)).alias("finished"), F.col("count").alias("total"),
        F.try_divide(F.coalesce("finished", F.lit(0)), F.col("count")).alias("progress"))


def interaction_stream(spark: SparkSession, source_dir: str, file_glob: str = "events.parquet") -> DataFrame:
    """Interactions as a stream over parquet files (same binding as the batch table)."""
    from cauce.sources.derived import CEDULA_BASE, _pick  # noqa: PLC0415
    e = (spark.readStream.schema(INTERACTION_SCHEMA).option("pathGlobFilter", file_glob)
         .option("maxFilesPerTrigger", 1).parquet(source_dir))
    eid = F.col("event_id")
    return e.select(
        (F.lit(CEDULA_BASE) + F.col("user_id")).cast("string").alias("member_id"),
        _pick(eid, 6, fixed.CHANNELS).alias("channel"),
        F.col("ts").alias("contacted_at"),
        (F.col("event_type") == "purchase").alias("accepted"),
    )


def channel_window_stream(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str | None = None,
                          window: str = "1 day", watermark: str = "2 days", members: DataFrame | None = None, file_glob: str = "events.parquet"):
    """X-05: accepts and sends per (window, channel), and per segment of ``members`` when they are given.

    Update mode: a micro-batch writes the windows it changed to a folder of its
    own (``window_state`` reads the latest count of each), so a replayed one
    writes the same folder again. Windows older than the watermark leave the
    state, and rows that come later are dropped, so the state holds
    the open windows x segments x channels. The members are joined as a static
    table; interactions of unknown members have no segment and do not count there.
    """
    checkpoint = checkpoint or shared_path(spark, "stream-channel-windows")
    s = interaction_stream(spark, source_dir, file_glob)
    keys = ["channel"]
    if members is not None:
        s = s.join(members.select("member_id", segment().alias("segment")), "member_id")
        keys = ["segment", "channel"]
    agg = s.withWatermark("contacted_at", watermark).groupBy(F.window("contacted_at", window).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("sends"), F.count_if("accepted").alias("accepts"))

    def handle(changed: DataFrame, number: int) -> None:
        changed.select(F.col("w.start").alias("window_start"), *keys, "sends", "accepts").write.mode("overwrite").parquet(os.path.join(out_dir, f"batch={number}"))

    return (agg.writeStream.outputMode("update").foreachBatch(handle)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def window_state(spark: SparkSession, out_dir: str) -> DataFrame:
    """Latest counts of every window that ``channel_window_stream`` wrote."""
    log = spark.read.parquet(out_dir)
    keys = [c for c in log.columns if c not in ("batch", "sends", "accepts")]
    last = log.groupBy(*keys).agg(F.max(F.struct("batch", "sends", "accepts")).alias("s"))
    return last.select(*keys, "s.sends", "s.accepts")


def window_rates(state: DataFrame, alpha: int = fixed.BAYES_ALPHA) -> DataFrame:
    """Adds the smoothed accept rate of each window; the prior is the rate over all windows."""
    prior = state.agg(F.try_divide(F.sum("accepts"), F.sum("sends"))).scalar()
    return state.withColumn("rate", (F.col("accepts") + F.lit(alpha) * prior) / (F.col("sends") + F.lit(alpha)))
