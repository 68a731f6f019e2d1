"""Documents to packed training sequences: five stages, each over all that the one before kept.

The first stage writes its input with a key for each row, and all stages match
rows by it, as a doc_id may be null, repeated or used for several texts.  Columns beside
those of documents are dropped; an empty table gives an empty table at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm import common
from doclake.llm.near_dedup import near_duplicates
from doclake.llm.packing import pack
from doclake.llm.pii import mask_pii
from doclake.llm.quality import quality_rules
from doclake.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


ROW = "row_key"
#: What a key made here says in its column's metadata, which Parquet keeps: a column of that name alone is not trusted.
OWN = {"corpus_pipeline": "key of each row"}


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key of their own, written so that each read gives the same ones; a column of the caller's with that name is dropped as others are."""
    if ROW in docs.columns and docs.schema[ROW].metadata == OWN:
        return docs
    return common.written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias(ROW, metadata=OWN)), "zstd")


def _chosen(docs: DataFrame, kept: DataFrame) -> DataFrame:
    return docs.join(kept, ROW, "left_semi").select(*COLUMNS, ROW)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and lie in their language's perplexity band; null and empty texts go, repeated rows are judged alike."""
    common.small_batches(spark)
    docs = _keyed(docs)
    labels = common.table(spark, sf_dir, "labels") if sf_dir else None
    return _chosen(docs, quality_rules(docs, labels, key=ROW, label_key="doc_id").where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least doc_id (nulls last) and key of each group of near duplicates (five-word shingles, 0.8).

    Of repeated rows one stays; a text without words is like no other and stays.
    """
    common.small_batches(spark)
    docs = _keyed(docs)
    named = docs.select(ROW, "doc_id").join(near_duplicates(docs, width=5, key=ROW), ROW)
    least = named.groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", ROW)).alias("m"))
    return _chosen(docs, least.select(f"m.{ROW}"))


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 35-word windows that are found twice or more; a text may become empty, a null one does."""
    common.small_batches(spark)
    docs = _keyed(docs)
    kept = substring_dedup(docs, key=ROW).select(ROW, F.col("kept").alias("text"))
    joined = docs.drop("text", "n_chars").join(kept, ROW)
    return joined.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS, ROW)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; null texts stay null."""
    common.small_batches(spark)
    return mask_pii(_keyed(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS, ROW)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with row key and doc_id; a null or empty text is one end token."""
    common.small_batches(spark)
    return pack(_keyed(docs), key=ROW, also="doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", dedup_substrings),
    ("pii", pii),
    ("packing", packing),
]

#: Perplexity, CRF and tokens can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.written(docs)
            if before is not None:
                common.forget(before)  # the stage after it is written
            before = docs
    return docs
