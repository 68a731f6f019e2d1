"""Prompt, response and parse jobs with a user's model function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake import schemas
from doclake.functions import scalars as S
from doclake.operators import retrieval, stores
from doclake.operators.text import concept_listing, listing_text
from doclake.sources.shared import new_path, path_exists, stored

Respond = Callable[[list[str]], list[str]]
#: Before the error in an answer (fixed value).
FAILED = "Error processing query: "

#: Prompt wording: text before and after the document text, and what limits it.
_JSON = "Reply with JSON only, in this form:\n"
TEMPLATES: dict[str, tuple[str, str, str | None]] = {
    "summary": ("Summarise the document below. " + _JSON + '{"executive_summary": "", "key_topics": [], "key_takeaways": [], "important_entities": []}\n\nDocument:\n', "", "summary"),
    "questions": ("Write 5 questions that the document below answers. " + _JSON + '["", ""]\n\nDocument:\n', "", "questions"),
    "notes": ("Write study notes on the document below. " + _JSON + '{"summary": "", "key_concepts": [], "flashcards": [], "viva_questions": [], "mcqs": []}\n\nDocument:\n', "", "notes"),
    "concepts": ("Name up to 15 key concepts of the document below. " + _JSON + '["", ""]\n\nDocument:\n', "", "concepts"),
    "cross": ("Name the concepts that two or more of these documents share. " + _JSON + '[{"concept": "", "found_in": [], "relevance": ""}]\n\n', "", None),
}


ANSWER = ("Answer from the context alone.\n\nContext:\n", "\n\nQuestion: ", "\nAnswer:")
_COMPARED = '{"matching_points": [], "missing_in_a": [], "missing_in_b": [], "recommendations": [], "overall_match_percent": 0}'
COMPARE = ("Compare the documents A and B. " + _JSON + _COMPARED + "\n\nA:\n", "\n\nB:\n")


def render(task: str, text: Column) -> Column:
    before, after, limit = TEMPLATES[task]
    return F.concat(F.lit(before), S.truncate(text, S.LIMITS[limit]) if limit else text, F.lit(after))


def render_short_summary(text: Column, max_length: int = 150) -> Column:
    return F.concat(F.lit(f"Summarise in {max_length} words at most:\n\n"), text)


def render_answer(question: Column, context: Column) -> Column:
    return F.concat(F.lit(ANSWER[0]), context, F.lit(ANSWER[1]), question, F.lit(ANSWER[2]))


def render_compare(a: Column, b: Column) -> Column:
    cut = lambda c: S.truncate(c, S.LIMITS["compare"])
    return F.concat(F.lit(COMPARE[0]), cut(a), F.lit(COMPARE[1]), cut(b))


#: Rows of a table of answers: the prompt's hash, and what came back.
ANSWERS = "hash string, raw string, error string"


def map_responses(prompts: DataFrame, respond: Respond, key: str, batch: int = 32, answers: str | None = None, wave: int = 50_000) -> DataFrame:
    """(key, raw, error): the model's answer to each prompt; a failed prompt gives an error row, and so does a null one.

    Answers are kept as a table, by the prompts' hashes, in the folder ``answers`` (by
    default a new one in the shared folder), and the result reads that table:
    however often it is read, and however many keys have one prompt, the model is
    asked once.  A later call with the same folder asks what has no answer there yet,
    which includes prompts that failed.  Prompts are asked in waves of about ``wave``,
    each of them saved before the next: a lost executor costs its part of one wave.
    Use one folder for one model.
    """
    spark = prompts.sparkSession
    path = answers or new_path(spark, "answers")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                asked = part["prompt"].tolist()
                try:
                    raw, errors = respond(asked), [None] * len(asked)
                    if len(raw) != len(asked):
                        raise ValueError(f"{len(raw)} answers to {len(asked)} prompts")
                except Exception:
                    raw, errors = [], []
                    for prompt in asked:
                        try:
                            raw.append(respond([prompt])[0])
                            errors.append(None)
                        except Exception as e:
                            raw.append(None)
                            errors.append(str(e))
                yield pd.DataFrame({"hash": part["hash"], "raw": raw, "error": errors})

    held = stored(prompts.select(key, "prompt", F.sha2("prompt", 256).alias("hash")), "prompts")
    todo = held.where("prompt is not null").groupBy("hash").agg(F.any_value("prompt").alias("prompt"))
    if path_exists(spark, path):
        todo = todo.join(spark.read.schema(ANSWERS).parquet(path).where("raw is not null"), "hash", "left_anti")
    todo = stored(todo, "asked")
    waves = max(1, -(-todo.count() // wave))
    for i in range(waves):
        some = todo.where(F.pmod(F.xxhash64("hash"), F.lit(waves)) == i)
        some.mapInPandas(run, ANSWERS).write.mode("append").parquet(path)
    # An answer comes before errors of earlier calls.
    best = spark.read.schema(ANSWERS).parquet(path).groupBy("hash").agg(F.max(F.struct(F.col("raw").isNotNull().alias("good"), "raw", "error")).alias("b"))
    error = F.when(F.col("hash").isNull(), "there is no prompt").otherwise(F.col("b.error"))
    return held.select(key, "hash").join(best, "hash", "left").select(key, F.col("b.raw").alias("raw"), error.alias("error"))


def _parsed(df: DataFrame, schema: str) -> DataFrame:
    """Adds _t (the answer's text), _valid (it is JSON), _kind (its outer type) and _p (its fields)."""
    with_text = df.withColumn("_t", S.strip_fences(F.coalesce("raw", F.lit(""))))
    kind = F.expr("CASE WHEN _t <> '' THEN schema_of_variant(try_parse_json(_t)) END")
    typed = with_text.withColumn("_kind", kind).withColumn("_valid", F.col("_kind").isNotNull())
    return typed.withColumn("_p", F.when(F.col("_valid"), F.from_json("_t", schema)))


def _with_error(p: DataFrame, kind: str, broken: Column | None) -> DataFrame:
    """Adds ``error`` where JSON is not of the outer type, or (if that is an error) is none; JSON null is an empty answer."""
    wrong = F.when(F.col("_valid") & ~F.col("_kind").startswith(kind) & (F.col("_kind") != "VOID"), f"the answer is JSON, but not {'an object' if kind == 'OBJECT' else 'a list'}")
    if broken is not None:
        wrong = F.coalesce(wrong, F.when(~F.col("_valid"), broken))
    return p.withColumn("error", F.coalesce("error", wrong) if "error" in p.columns else wrong).drop("_t", "_valid", "_p", "_kind")


def _list(c: str) -> Column:
    return F.coalesce(F.col(f"_p.{c}"), F.array().cast("array<string>"))


def parse_summary(answers: DataFrame) -> DataFrame:
    """Adds ``summary``; an answer that isn't JSON is the executive summary itself, JSON of another type sets ``error``; without an answer there is no summary."""
    p = _parsed(answers, schemas.SUMMARY)
    text = F.when(F.col("_valid"), F.coalesce("_p.executive_summary", F.lit(""))).otherwise(F.col("_t"))
    summary = F.struct(text.alias("executive_summary"), *(_list(c).alias(c) for c in ("key_topics", "key_takeaways", "important_entities")))
    out = _with_error(p.withColumn("summary", summary), "OBJECT", None)
    return out.withColumn("summary", F.when(F.col("raw").isNotNull() & F.col("error").isNull(), F.col("summary")))


def parse_comparison(answers: DataFrame) -> DataFrame:
    """Adds ``comparison`` and, where the answer isn't JSON, ``raw_response``; JSON of another type sets ``error``."""
    p = _parsed(answers, schemas.COMPARISON)
    lists = (_list(c).alias(c) for c in ("matching_points", "missing_in_a", "missing_in_b", "recommendations"))
    out = p.withColumn("comparison", F.struct(*lists, F.coalesce("_p.overall_match_percent", F.lit(0.0)).alias("overall_match_percent")))
    return _with_error(out.withColumn("raw_response", F.when(~F.col("_valid"), F.col("_t"))), "OBJECT", None)


def parse_notes(answers: DataFrame) -> DataFrame:
    """Adds ``notes``; an answer that isn't a JSON object sets ``error``."""
    p = _parsed(answers, schemas.NOTES)
    fields = []
    for f in ("key_concepts", "flashcards", "viva_questions", "mcqs"):
        fields.append(F.coalesce(F.col(f"_p.{f}"), F.from_json(F.lit("[]"), p.schema["_p"].dataType[f].dataType.simpleString())).alias(f))
    notes = F.struct(F.coalesce("_p.summary", F.lit("")).alias("summary"), *fields)
    out = _with_error(p.withColumn("notes", F.when(F.col("_valid"), notes)), "OBJECT", F.lit("the answer is not JSON"))
    return out.withColumn("notes", F.when(F.col("error").isNull(), F.col("notes")))


def parse_questions(answers: DataFrame) -> DataFrame:
    """Adds ``questions``, five at most: a JSON list, or the lines of other text."""
    p = _parsed(answers, "array<string>")
    lines = F.transform(F.filter(F.split("_t", "\n"), lambda x: S.pystrip(x) != ""), lambda x: F.btrim(x, F.lit("- •\t")))
    found = F.when(F.col("_valid"), F.coalesce("_p", F.array().cast("array<string>"))).otherwise(lines)
    return p.withColumn("questions", S.cap_questions(F.coalesce(found, F.array().cast("array<string>")))).drop("_t", "_valid", "_p", "_kind")


def parse_concepts(answers: DataFrame) -> DataFrame:
    """Adds ``concepts``; anything but a JSON list is no concept."""
    return _parsed(answers, "array<string>").withColumn("concepts", F.coalesce("_p", F.array().cast("array<string>"))).drop("_t", "_valid", "_p", "_kind")


def parse_cross(answers: DataFrame) -> DataFrame:
    """Adds ``shared``, by number of documents; bad JSON sets ``error``."""
    p = _parsed(answers, schemas.CROSS)
    more_first = lambda a, b: F.when(F.size(a["found_in"]) > F.size(b["found_in"]), -1).when(F.size(a["found_in"]) < F.size(b["found_in"]), 1).otherwise(0)
    shared = F.array_sort(F.coalesce("_p", F.from_json(F.lit("[]"), schemas.CROSS)), more_first)
    return _with_error(p.withColumn("shared", F.when(F.col("_valid"), shared)), "ARRAY", F.lit("the answer is not JSON"))


def notes_counts(notes: DataFrame) -> DataFrame:
    size = lambda c: F.coalesce(F.when(F.col(f"notes.{c}").isNotNull(), F.size(f"notes.{c}")), F.lit(0))
    return notes.withColumn("counts", F.struct(*(size(c).alias(c) for c in ("key_concepts", "flashcards", "viva_questions", "mcqs"))))


def short_summary(docs: DataFrame, respond: Respond, max_length: int = 150, answers: str | None = None) -> DataFrame:
    return map_responses(docs.select("doc_id", render_short_summary(F.col("full_text"), max_length).alias("prompt")), respond, "doc_id", answers=answers)


def summarize_documents(docs: DataFrame, respond: Respond, doc_ids: list | None = None, answers: str | None = None) -> DataFrame:
    """(doc_id, summary, cached, error) of the given ids, or of all: only documents without a summary go to the model; unknown ids have an error."""
    chosen, missing = docs, None
    if doc_ids is not None:
        asked = docs.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(doc_ids)], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")
        chosen = docs.join(asked, "doc_id", "left_semi")
        unknown = F.concat(F.lit("Document not found: "), F.col("doc_id").cast("string"))
        missing = asked.join(docs, "doc_id", "left_anti").select("doc_id", F.lit(None).cast(docs.schema["summary"].dataType).alias("summary"), F.lit(False).alias("cached"), unknown.alias("error"))
    todo = stores.uncached(chosen).select("doc_id", render("summary", F.col("full_text")).alias("prompt"))
    fresh = parse_summary(map_responses(todo, respond, "doc_id", answers=answers)).select("doc_id", "summary", F.lit(False).alias("cached"), "error")
    held = chosen.filter(F.col("summary").isNotNull()).select("doc_id", "summary", F.lit(True).alias("cached"), F.lit(None).cast("string").alias("error"))
    out = held.unionByName(fresh)
    return out if missing is None else out.unionByName(missing)


def store_summaries(docs: DataFrame, summaries: DataFrame) -> DataFrame:
    """The documents with the fresh summaries written back."""
    return stores.upsert_summaries(docs, summaries.filter("not cached and summary is not null").select("doc_id", "summary"))


def compare_documents(pairs: DataFrame, docs: DataFrame, respond: Respond, answers: str | None = None) -> DataFrame:
    both = stores.pair_documents(pairs, docs).withColumn("_key", F.concat_ws("\0", "a", "b"))
    asked = both.filter("error is null").select("_key", render_compare(F.col("doc_a.full_text"), F.col("doc_b.full_text")).alias("prompt")).distinct()
    answered = parse_comparison(map_responses(asked, respond, "_key", answers=answers)).withColumnRenamed("error", "_failed")
    found = both.select("a", "b", "error", "_key").join(answered, "_key", "left")
    return found.withColumn("error", F.coalesce("error", "_failed")).drop("_key", "raw", "_failed")


def suggest_questions(docs: DataFrame, respond: Respond, answers: str | None = None) -> DataFrame:
    asked = docs.select("doc_id", render("questions", F.col("full_text")).alias("prompt"))
    return parse_questions(map_responses(asked, respond, "doc_id", answers=answers)).select("doc_id", "questions", "error")


def study_notes(docs: DataFrame, respond: Respond, answers: str | None = None) -> DataFrame:
    asked = docs.select("doc_id", render("notes", F.col("full_text")).alias("prompt"))
    noted = notes_counts(parse_notes(map_responses(asked, respond, "doc_id", answers=answers)))
    return docs.select("doc_id", "filename").join(noted, "doc_id").select("doc_id", "filename", "notes.*", "counts", "error")


def cross_document(docs: DataFrame, doc_ids: list | None, respond: Respond, answers: str | None = None) -> DataFrame:
    """One row: number of documents, shared concepts, concepts of each file."""
    chosen = stores.select_documents(docs, doc_ids)
    asked = chosen.select("doc_id", render("concepts", F.col("full_text")).alias("prompt"))
    own = parse_concepts(map_responses(asked, respond, "doc_id", answers=answers)).select("doc_id", "concepts")
    named = chosen.select("doc_id", "filename", F.unix_micros(F.col("uploaded_at").cast("timestamp")).alias("position")).join(own, "doc_id").persist()
    listing = listing_text(concept_listing(named)).select(F.lit(1).alias("one"), render("cross", F.col("listing")).alias("prompt"))
    answer = parse_cross(map_responses(listing, respond, "one", answers=answers))
    latest = named.groupBy("filename").agg(F.max_by("concepts", "position").alias("c"))
    per_document = latest.agg(F.map_from_entries(F.collect_list(F.struct("filename", "c"))).alias("m")).scalar()
    return answer.select(named.agg(F.count("*")).scalar().alias("document_count"), "shared", per_document.alias("per_document_concepts"), "error")


def answer_questions(questions: DataFrame, chunks: DataFrame, respond: Respond, now: Column, k: int = 4, answers: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Answers of all questions, and history rows of those that succeeded; a failed one has no trace and no context."""
    cands, kept = retrieval.kept_hits(questions, chunks, k)
    found = retrieval.context_of(questions, cands, kept).drop("answer", "success")
    asked = questions.join(retrieval.context_pack(kept).withColumnRenamed("context", "_packed"), "qid").select("qid", render_answer(F.col("question"), F.col("_packed")).alias("prompt"))
    raw = map_responses(asked, respond, "qid", answers=answers)
    failed = F.concat(F.lit(FAILED), "error")
    answer = F.when(F.col("context").isNull(), retrieval.NOTHING).when(F.col("error").isNotNull(), failed).otherwise(F.col("raw"))
    out = found.join(raw, "qid", "left").withColumn("answer", answer).withColumn("success", F.col("raw").isNotNull())
    for c in found.columns:
        if c not in ("qid", "query"):
            out = out.withColumn(c, F.when(F.col("error").isNull(), F.col(c)))
    ok = out.filter("success")
    history = ok.select(F.sha2(F.concat_ws("|", "qid", now.cast("string")), 256).alias("id"), now.alias("timestamp"), F.col("query").alias("question"), "answer", "context")
    return out.drop("raw"), history
