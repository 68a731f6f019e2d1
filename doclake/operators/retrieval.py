"""Nearest chunks for a table of questions, and what is shown of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclake.functions import scalars as S
from doclake.operators.neighbours import CELLS, build_index, search
from doclake.sources.shared import stored

#: What is answered without any hit (fixed value).
NOTHING = "No relevant documents found in the knowledge base."
#: Hits, of about 100 bytes, that are broadcast at most.
SENT = 1_000_000


def oversample(k: int) -> int:
    if k < 1:
        raise ValueError("k must be at least 1")
    return 2 * k


def l2sq(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def knn(questions: DataFrame, chunks: DataFrame, k: int, metric: str = "l2sq", cells: int | None = None) -> DataFrame:
    """hits(qid, chunk_id, distance, rank): exact nearest chunks of each question; ties by chunk id.

    Null, empty, unfinished or wrong-sized vectors are in no hit, whatever the size
    of the tables (see ``neighbours``).
    """
    oversample(k)
    return search(build_index(chunks, metric, cells), questions, k)


def knn_approx(questions: DataFrame, chunks: DataFrame, k: int, cells: int | None = None, recall: float = 0.97) -> DataFrame:
    """Nearest chunks among those of the cells nearest to each question, by exact distance.

    A question looks into so many cells that vectors of a bounded sample find ``recall``
    of their neighbours there.
    """
    oversample(k)
    if cells is None:
        cells = max(1, min(CELLS, round(chunks.count() ** 0.5 / 2)))
    return search(build_index(chunks, "l2sq", cells, k, recall), questions, k, exact=False)


def filter_section(hits: DataFrame, sections: DataFrame) -> DataFrame:
    """Hits whose content holds their question's section; all of them where none does."""
    flagged = hits.join(sections, "qid", "left").withColumn("_in", F.coalesce(F.contains(F.lower("content"), F.col("section")), F.lit(True)))
    any_in = F.max("_in").over(Window.partitionBy("qid"))
    return flagged.withColumn("_any", any_in).filter("_in or not _any").drop("_in", "_any", "section")


def dedup_hits(hits: DataFrame, k: int) -> DataFrame:
    """The best hit of each stripped content, then the first k."""
    best = Window.partitionBy("qid", "_key").orderBy("rank")
    first = hits.withColumn("_key", S.pystrip(F.col("content"))).withColumn("_n", F.row_number().over(best)).filter("_n = 1")
    place = Window.partitionBy("qid").orderBy("rank")
    return first.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).drop("_key", "_n")


def hits_without_scores(hits: DataFrame) -> DataFrame:
    return hits.drop("distance")


def retrieval_trace(questions: DataFrame, cands: DataFrame, kept: DataFrame) -> DataFrame:
    """Counts and scores of each question; ``duplicates_removed`` also counts what k cut off."""
    before = cands.groupBy("qid").agg(F.count("*").alias("before"), F.countDistinct(S.pystrip(F.col("content"))).alias("different"))
    scores = F.transform(F.array_sort(F.collect_list(F.struct("rank", S.confidence(F.col("distance")).alias("c")))), lambda x: x["c"])
    after = kept.groupBy("qid").agg(F.count("*").alias("after"), scores.alias("scores"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    return questions.select("qid", F.col("question").alias("query")).join(before, "qid", "left").join(after, "qid", "left").select(
        "qid", "query", zero("after").alias("chunks_retrieved"), zero("before").alias("chunks_before_dedup"), (zero("before") - zero("after")).alias("duplicates_removed"),
        (zero("before") - zero("different")).alias("exact_duplicates"), F.coalesce("scores", F.array().cast("array<double>")).alias("scores"),
    )


def context_pack(hits: DataFrame) -> DataFrame:
    """(qid, context): sources and contents in rank order, with full source paths."""
    line = F.concat(F.lit("Source: "), F.coalesce("source", F.lit("Unknown")), F.lit("\n"), "content")
    rows = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return hits.groupBy("qid").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n---\n").alias("context"))


def kept_hits(questions: DataFrame, chunks: DataFrame, k: int = 4, keywords: tuple[str, ...] = S.SECTIONS) -> tuple[DataFrame, DataFrame]:
    """Candidates after the section filter, and the hits that are shown."""
    near = stored(knn(questions, chunks, oversample(k)), "hits")  # 2k rows a question
    # Contents stay where they are, and are looked up once.
    if near.count() <= SENT:
        near = F.broadcast(near)
    hits = stored(chunks.select("chunk_id", "source", "page", "content").join(near, "chunk_id"), "contents")
    sections = questions.select("qid", S.detect_section(F.col("question"), keywords).alias("section"))
    cands = filter_section(hits, sections)
    return cands, dedup_hits(cands, k)


def retrieve_context(questions: DataFrame, chunks: DataFrame, k: int = 4, keywords: tuple[str, ...] = S.SECTIONS) -> DataFrame:
    """One row a question: context items, success, trace. Questions without hits stay."""
    return context_of(questions, *kept_hits(questions, chunks, k, keywords))


def context_of(questions: DataFrame, cands: DataFrame, kept: DataFrame) -> DataFrame:
    """As ``retrieve_context``, from the candidates and the hits that are shown."""
    item = F.struct("content", S.clean_source(F.col("source")).alias("source"), S.confidence(F.col("distance")).alias("confidence_percent"), S.display_page(F.col("page")).alias("page"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))), lambda x: x["item"])
    context = kept.groupBy("qid").agg(items.alias("context"))
    out = retrieval_trace(questions, cands, kept).join(context, "qid", "left")
    success = F.col("context").isNotNull()
    return out.withColumn("success", success).withColumn("answer", F.when(~success, NOTHING))
