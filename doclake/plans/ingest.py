"""Pages to documents, chunks and members."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake import schemas
from doclake.functions.scalars import clean_source
from doclake.operators import stores
from doclake.operators.text import assemble_full_text, chunk_recursive, embed, vector

Embedder = Callable[[list[str]], list[list[float]]]


def with_vectors(chunks: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Chunks (chunk_id, content, ...) with ``embedding``."""
    if embedder is None:
        return chunks.withColumn("embedding", vector(F.col("content")))
    return chunks.join(embed(chunks, "chunk_id", "content", embedder), "chunk_id")


def ingest(
    pages: DataFrame, collections: DataFrame, now: Column, collection_id: str | None = None, embedder: Embedder | None = None, members: DataFrame | None = None, last: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, chunks with vectors, and new members of the given or default collection.

    ``members`` are those there already: positions go on after them, or after
    ``last`` (collection_id, last), where only that is known.  Each output reads the
    pages anew; persist these where that is dear.
    """
    target = stores.default_collection(collections, now) if collection_id is None else stores.get_collection_row(collections, collection_id)
    if target.isEmpty():
        raise ValueError(f"unknown collection {collection_id}")
    doc_id = F.sha2(F.concat_ws("|", "source", now.cast("string")), 256)
    cut = chunk_recursive(pages.withColumn("doc_id", doc_id))
    cut = cut.withColumn("chunk_id", F.concat_ws("#", "doc_id", F.coalesce(F.col("page").cast("string"), F.lit("")), "pos"))
    counts = cut.groupBy("doc_id").agg(F.count("*").cast("int").alias("chunk_count"))
    chunks = with_vectors(cut, embedder).select("chunk_id", "doc_id", "source", "page", "pos", "content", "embedding")
    docs = assemble_full_text(pages).withColumn("doc_id", doc_id).join(counts, "doc_id", "left")
    docs = docs.select(
        "doc_id", clean_source(F.col("source")).alias("filename"), F.col("source").alias("file_path"), "full_text",
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.lit(None).cast(schemas.SUMMARY).alias("summary"), now.alias("uploaded_at"),
    )
    if members is None:
        members = docs.sparkSession.createDataFrame([], f"collection_id {target.schema['collection_id'].dataType.simpleString()}, doc_id string, position long")
    new = pages.select(target.select("collection_id").scalar().alias("collection_id"), doc_id.alias("doc_id"), F.lit(0).cast("long").alias("position")).distinct()
    return docs, chunks, stores.new_members(members, new, target, last)
