"""Incremental ingest, and a daily count kept current."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from doclake.functions.scalars import file_extension
from doclake.operators import stores
from doclake.plans.ingest import ingest
from doclake.sources.files import admit_files, extract_pages
from doclake.sources.shared import path_exists

_FILES = "path string, modificationTime timestamp, length long, content binary"


def _before(spark: SparkSession, out_dir: str, batch_id: int) -> DataFrame | None:
    """(collection_id, last) as the batch before left it; none before the first."""
    path = f"{out_dir}/positions"
    if not path_exists(spark, path):
        return None
    rows = spark.read.parquet(path).where(F.col("batch_id") < batch_id)
    newest = rows.agg(F.max("batch_id")).first()[0]  # from the folders' names
    return None if newest is None else rows.where(F.col("batch_id") == newest).drop("batch_id")


def stream_ingest(
    spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, collections: DataFrame, extract: Callable[[bytes], list[tuple[int | None, str]]] | None = None, files_per_batch: int | None = None
) -> StreamingQuery:
    """Each new file becomes a document once; each batch overwrites its own folders, so a replay adds nothing.

    Members' positions go on from batch to batch: each batch reads where the one
    before left every collection (``positions``) and writes where it leaves them
    itself, a row a collection.  A replayed batch reads the same state again, as
    it looks at batches before its own alone.  All batches go to the collection
    that is the oldest one when the stream is started; with an empty table each start
    makes a new one, so give a table that has one.  ``extract`` finds the pages of .pdf and
    .docx files; without it these are rejected.
    """
    home = stores.default_collection(collections, F.current_timestamp()).persist()  # a new one gets a random id: once
    target = home.collect()[0]
    home.unpersist()
    kept = spark.createDataFrame([target], home.schema)

    def write(files: DataFrame, batch_id: int) -> None:
        good, bad = admit_files(files)
        text = F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n")
        readable = file_extension(F.col("path")).isin(".txt", ".md") & F.is_valid_utf8(F.col("content").cast("string"))
        pages = good.where(readable).select(F.col("path").alias("source"), F.lit(None).cast("int").alias("page"), text.alias("text"))
        paged = file_extension(F.col("path")).isin(".pdf", ".docx")
        left = good.where(~readable)
        if extract is not None:
            pages, left = pages.unionByName(extract_pages(good.where(paged), extract)), left.where(~paged)
        unread = left.select("path", F.lit("not readable as text").alias("reason"))
        pages.persist()
        # The batch's own time, so a replay makes the same ids.
        now = F.lit(files.agg(F.max("modificationTime")).first()[0])
        before = _before(spark, out_dir, batch_id)
        docs, chunks, members = ingest(pages, kept, now, last=before)
        rejects = bad.select("path", "reason").unionByName(unread)
        for name, df in (("documents", docs), ("chunks", chunks), ("members", members), ("rejects", rejects)):
            df.write.mode("overwrite").parquet(f"{out_dir}/{name}/batch_id={batch_id}")
        reached = stores.last_positions(spark.read.schema(members.schema).parquet(f"{out_dir}/members/batch_id={batch_id}"))
        if before is not None:
            reached = reached.unionByName(before).groupBy("collection_id").agg(F.max("last").alias("last"))
        reached.write.mode("overwrite").parquet(f"{out_dir}/positions/batch_id={batch_id}")
        pages.unpersist()

    stream = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true")
    if files_per_batch is not None:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    return stream.load(in_dir).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_queries_per_day(history: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(day, n) over a stream with ``timestamp``; rows later than the watermark are dropped."""
    counts = history.withWatermark("timestamp", delay).groupBy(F.window("timestamp", "1 day")).agg(F.count("*").alias("n"))
    return counts.select(F.to_date("window.start").alias("day"), "n")


def stream_daily_counts(history: DataFrame, out_dir: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Keeps the counts of ``stream_queries_per_day`` as a table; ``daily_counts`` reads it.

    Each batch writes the days that it changed to its own folder, which a replay
    overwrites, so every row counts once.  Late rows change no day that is closed.
    """

    def write(days: DataFrame, batch_id: int) -> None:
        days.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    return stream_queries_per_day(history, delay).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """(day, n): each day as its newest batch left it."""
    return spark.read.schema("day date, n long, batch_id long").parquet(out_dir).groupBy("day").agg(F.max_by("n", "batch_id").alias("n"))
