"""Reading files and sidecar stores, and writing tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake import schemas
from doclake.functions.scalars import file_extension

#: Accepted suffixes and bytes (fixed values).
EXTENSIONS = (".pdf", ".txt", ".docx", ".md")
MOST_BYTES = 50 * 1024 * 1024


def load_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Pages of .txt and .md files, one a file, and the files that aren't UTF-8."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(file_extension(F.col("path")).isin(".txt", ".md"))
    good = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n")
    pages = raw.where(good).select(F.col("path").alias("source"), F.lit(None).cast("int").alias("page"), text.alias("text"))
    return pages, raw.where(~good).select(F.col("path").alias("source"), F.lit("not valid UTF-8").alias("reason"))


def load_with(spark: SparkSession, path: str, extract: Callable[[bytes], list[tuple[int | None, str]]]) -> DataFrame:
    """Pages that ``extract`` finds in each file's bytes; one row a page."""

    return extract_pages(spark.read.format("binaryFile").load(path), extract)


def extract_pages(files: DataFrame, extract: Callable[[bytes], list[tuple[int | None, str]]]) -> DataFrame:
    """As ``load_with``, of rows (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, page, text) for p, content in zip(batch["path"], batch["content"], strict=True) for page, text in extract(content)]
            yield pd.DataFrame(rows, columns=["source", "page", "text"]).astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(run, schemas.PAGES)


def admit_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected (with reason) rows of (path, length); the suffix is tested first."""
    reason = F.when(~file_extension(F.col("path")).isin(*EXTENSIONS), "type").when(F.col("length") > MOST_BYTES, "size")
    judged = files.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def read_store(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A legacy JSON store: documents, collections (keyed objects) or history (an array); a missing one is empty, a broken one an error."""
    of = {"documents": schemas.DOCUMENT, "collections": schemas.COLLECTION, "history": f"struct<{', '.join(f.replace(' ', ':', 1) for f in schemas.HISTORY.split(', '))}>"}[kind]
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"s {of}").select("s.*")
    if kind == "history":
        shape = spark.createDataFrame([], schemas.HISTORY).schema
        return spark.read.schema(shape).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return raw.select(F.explode(F.from_json("value", f"map<string,{of}>", {"mode": "FAILFAST"}))).select("value.*")


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def export_store(df: DataFrame, path: str) -> None:
    """JSON lines, UTF-8."""
    df.write.mode("overwrite").json(path)


def clear_history(spark: SparkSession, path: str) -> None:
    """An empty table with the history's schema."""
    shape = spark.read.parquet(path).schema
    spark.createDataFrame([], shape).write.mode("overwrite").parquet(path)
