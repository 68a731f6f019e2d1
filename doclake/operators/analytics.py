"""Dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.functions.scalars import clean_source


def source_counts(history: DataFrame) -> DataFrame:
    return history.select(F.explode("context").alias("c")).groupBy(F.coalesce("c.source", F.lit("Unknown")).alias("source")).agg(F.count("*").alias("n"))


def most_queried(history: DataFrame) -> DataFrame:
    """One row: the source asked for most; ties go to the one seen first, newest entry first."""
    seen = history.select("id", "timestamp", F.posexplode("context").alias("pos", "c")).withColumn("source", F.coalesce("c.source", F.lit("Unknown")))
    # Seen first: latest time, then smallest id and place.
    per_entry = seen.groupBy("source", "timestamp", "id").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    ranked = per_entry.groupBy("source").agg(F.sum("n").alias("n"), F.min(F.struct((-F.unix_micros(F.col("timestamp").cast("timestamp"))).alias("t"), "id", "pos")).alias("first"))
    top = ranked.orderBy(F.desc("n"), "first").limit(1).select(clean_source(F.col("source")).alias("most_queried"))
    return top.agg(F.max("most_queried").alias("most_queried"))


def queries_on(history: DataFrame, day: str) -> DataFrame:
    return history.agg(F.count_if(F.to_date("timestamp") == F.lit(day).cast("date")).alias("n"))


def queries_per_day(history: DataFrame) -> DataFrame:
    return history.groupBy(F.to_date("timestamp").alias("day")).agg(F.count("*").alias("n"))


def summarized_count(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("summary").alias("n"))


def collection_info(chunks: DataFrame, name: str, path: str) -> DataFrame:
    """``document_count`` counts chunks."""
    return chunks.agg(F.count("*").alias("document_count")).select(F.lit(name).alias("name"), "document_count", F.lit(path).alias("path"))


def chunk_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.select("doc_id").join(counts, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("chunk_count"))


def embedding_dimension(chunks: DataFrame) -> DataFrame:
    sizes = F.array_sort(F.collect_set(F.size("embedding")))
    return chunks.agg(sizes.alias("d")).select(F.get("d", F.lit(0)).alias("dimension"), (F.size("d") > 1).alias("mixed"))


def dashboard(docs: DataFrame, chunks: DataFrame, history: DataFrame, collections: DataFrame, day: str, provider: str, model: str) -> DataFrame:
    """One row, from one-row aggregates joined by scalar subqueries."""
    one = docs.agg(F.count("*").alias("total_documents"), F.count("summary").alias("summarized_documents"))
    count = lambda df: df.agg(F.count("*").alias("n")).scalar()
    return one.select(
        "total_documents", count(chunks).alias("total_chunks"), count(history).alias("total_queries"), queries_on(history, day).scalar().alias("queries_today"),
        count(collections).alias("total_collections"), "summarized_documents", most_queried(history).scalar().alias("most_queried_document"),
        F.lit(provider).alias("llm_provider"), F.lit(model).alias("llm_model"),
    )
