"""Documents, collections and history as keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclake.sources.shared import shared_folder


def get_document(docs: DataFrame, doc_id) -> DataFrame:
    return docs.filter(F.col("doc_id") == F.lit(doc_id))


def light_documents(docs: DataFrame) -> DataFrame:
    return docs.drop("full_text")


def delete_document(docs: DataFrame, doc_id) -> DataFrame:
    return docs.filter(~F.col("doc_id").eqNullSafe(F.lit(doc_id)))


def get_collection_row(collections: DataFrame, collection_id) -> DataFrame:
    return collections.filter(F.col("collection_id") == F.lit(collection_id))


def delete_collection(collections: DataFrame, collection_id) -> DataFrame:
    return collections.filter(~F.col("collection_id").eqNullSafe(F.lit(collection_id)))


def remove_member(members: DataFrame, collection_id, doc_id) -> DataFrame:
    gone = F.col("collection_id").eqNullSafe(F.lit(collection_id)) & F.col("doc_id").eqNullSafe(F.lit(doc_id))
    return members.filter(~gone)


def uncached(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("summary").isNull())


def collection_members(collections: DataFrame, members: DataFrame, docs: DataFrame) -> DataFrame:
    """Each collection's columns with ``position`` and ``document`` (a light row): a row for each known member, so that a collection of any size is many small rows.

    Unknown ids are dropped; a collection without members has no row here.
    """
    light = light_documents(docs)
    held = members.join(light, "doc_id").select("collection_id", "position", F.struct(*(F.col(c) for c in light.columns)).alias("document"))
    return collections.join(held, "collection_id")


def collection_documents(collections: DataFrame, members: DataFrame, docs: DataFrame) -> DataFrame:
    """Each collection with an array of its documents' light rows in member order, for collections that fit a row (else ``collection_members``)."""
    held = collection_members(collections.select("collection_id"), members, docs)
    arrays = held.groupBy("collection_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "document"))), lambda r: r["document"]).alias("documents"))
    none = F.array().cast(arrays.schema["documents"].dataType)
    return collections.join(arrays, "collection_id", "left").withColumn("documents", F.coalesce("documents", none))


def latest_by_filename(docs: DataFrame, filename: str | None = None) -> DataFrame:
    """The newest record of each file name; ties go to the smaller id."""
    docs = docs if filename is None else docs.filter(F.col("filename") == filename)
    newest = Window.partitionBy("filename").orderBy(F.desc("uploaded_at"), "doc_id")
    return docs.withColumn("_nth", F.row_number().over(newest)).filter("_nth = 1").drop("_nth")


def resolve_documents(idents: DataFrame, docs: DataFrame) -> DataFrame:
    """(ident, document): by id first, else the newest record of that file name; null if neither."""
    whole = F.struct(*(F.col(c) for c in docs.columns))
    by_id = docs.select(F.col("doc_id").cast("string").alias("ident"), whole.alias("a"))
    by_name = latest_by_filename(docs).select(F.col("filename").alias("ident"), whole.alias("b"))
    return idents.join(by_id, "ident", "left").join(by_name, "ident", "left").select(*idents.columns, F.coalesce("a", "b").alias("document"))


def select_documents(docs: DataFrame, doc_ids: list | None = None) -> DataFrame:
    """Known ids in request order, repeats kept; all, newest first, without ids. Fewer than two is an error."""
    if not doc_ids:
        chosen = docs.orderBy(F.desc("uploaded_at"), "doc_id")
    else:
        asked = docs.sparkSession.createDataFrame([(i, d) for i, d in enumerate(doc_ids)], ["_at", "doc_id"])
        chosen = docs.join(asked, "doc_id").orderBy("_at").select(*docs.columns)
    if chosen.limit(2).count() < 2:
        raise ValueError("at least two documents are needed")
    return chosen


def upsert_summaries(docs: DataFrame, new: DataFrame) -> DataFrame:
    fresh = new.select("doc_id", F.col("summary").alias("_new"))
    return docs.join(fresh, "doc_id", "left").withColumn("summary", F.coalesce("_new", "summary")).select(*docs.columns)


def pair_documents(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Both documents of pairs (a, b) of identifiers, and what is missing (a is named first)."""
    a = resolve_documents(pairs.select(F.col("a").alias("ident")).distinct(), docs).select(F.col("ident").alias("a"), F.col("document").alias("doc_a"))
    b = resolve_documents(pairs.select(F.col("b").alias("ident")).distinct(), docs).select(F.col("ident").alias("b"), F.col("document").alias("doc_b"))
    error = F.when(F.col("doc_a").isNull(), F.concat(F.lit("Document not found: "), "a")).when(F.col("doc_b").isNull(), F.concat(F.lit("Document not found: "), "b"))
    return pairs.join(a, "a", "left").join(b, "b", "left").withColumn("error", error)


def list_documents(docs: DataFrame) -> DataFrame:
    return light_documents(docs).orderBy(F.desc("uploaded_at"), "doc_id")


def list_collections(collections: DataFrame) -> DataFrame:
    return collections.orderBy("created_at", "collection_id")


def create_collections(collections: DataFrame, names: DataFrame, now: Column) -> DataFrame:
    """Adds rows for ``names`` (name, and collection_id where the caller gives one)."""
    given = F.col("collection_id") if "collection_id" in names.columns else F.uuid()
    return collections.unionByName(names.select(given.alias("collection_id"), "name", now.alias("created_at")))


def default_collection(collections: DataFrame, now: Column) -> DataFrame:
    """The oldest collection; a new one named General where there is none."""
    if collections.isEmpty():
        seed = collections.sparkSession.createDataFrame([("General",)], ["name"])
        collections = create_collections(collections, seed, now)
    return list_collections(collections).limit(1)


def _ranges(rows: DataFrame, *order: str) -> DataFrame:
    """The rows dealt to tasks by ranges of their order, with the ``_range`` of each; cut once, as ranges come from samples."""
    shared_folder(rows.sparkSession)
    return rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint()


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Adds ``nth``, from 1: each row's place in its group, in the given order, which has to be total.

    Rows are sorted over all tasks by ranges, and each range counts what it holds of
    each group; a row's place is that in its range after the counts of those before.
    So one group may have any number of rows: no task has more of it than a range.
    """
    ranged = _ranges(rows, group, *order)
    counts = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).select(F.col(group).alias("_group"), F.col("_range").alias("_of"), "_ahead")
    inside = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order))
    placed = ranged.withColumn("_inside", inside).join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
    return placed.withColumn("nth", F.col("_ahead") + F.col("_inside")).drop("_range", "_of", "_group", "_ahead", "_inside")


def add_members(members: DataFrame, new: DataFrame, collections: DataFrame) -> DataFrame:
    """Set-add of (collection_id, doc_id, position); unknown collections add nothing."""
    return members.unionByName(new_members(members, new, collections))


def last_positions(members: DataFrame) -> DataFrame:
    """(collection_id, last) of each collection with members."""
    return members.groupBy("collection_id").agg(F.max("position").alias("last"))


def new_members(members: DataFrame, new: DataFrame, collections: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """The rows that ``add_members`` adds, with positions after those there (or after ``last``), in order of position, then id.

    A row without a document or collection adds nothing; of repeated ones the first counts.
    """
    known = new.where("doc_id is not null").join(collections.select("collection_id").distinct(), "collection_id", "left_semi")
    fresh = known.groupBy("collection_id", "doc_id").agg(F.min("position").alias("_at")).join(members, ["collection_id", "doc_id"], "left_anti")
    before = (last_positions(members) if last is None else last).select("collection_id", F.col("last").alias("_last"))
    placed = numbered(fresh, "collection_id", "_at", "doc_id").join(before, "collection_id", "left")
    position = (F.coalesce("_last", F.lit(-1)) + F.col("nth")).cast(members.schema["position"].dataType)
    return placed.select("collection_id", "doc_id", position.alias("position"))


def get_history(history: DataFrame, limit: int | None = 100) -> DataFrame:
    newest = history.orderBy(F.desc("timestamp"), "id")
    return newest if limit is None else newest.limit(limit)
