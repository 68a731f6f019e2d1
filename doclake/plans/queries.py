"""The registered queries over the given tables, and DuckDB SQL with the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclake.functions import scalars as S
from doclake.operators import analytics as A
from doclake.operators import retrieval as R
from doclake.operators import stores as K
from doclake.operators import text as X
from doclake.plans import tasks
from doclake.plans.ingest import ingest, with_vectors
from doclake.sources import files
from doclake.sources.shared import new_path
from doclake.streaming.jobs import daily_counts, stream_daily_counts, stream_ingest

#: Section words that occur in the given texts.
KEYWORDS = ("tion", "the", "que")

FIXTURES = r"""
docs AS (SELECT doc_id, source AS filename, source AS file_path, text AS full_text, TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS uploaded_at,
  CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 40) END AS summary FROM documents),
chunks AS (SELECT vec_id AS chunk_id, doc_id, '/in/' || source || '.txt' AS source, CASE WHEN vec_id % 4 > 0 THEN CAST(vec_id % 7 AS INTEGER) END AS page, text AS content, embedding
  FROM embeddings JOIN documents ON vec_id = doc_id),
questions AS (SELECT vec_id AS qid, text AS question, embedding FROM embeddings JOIN documents ON vec_id = doc_id WHERE vec_id % 50 = 0),
collections AS (SELECT label AS collection_id, 'c' || label AS name, TIMESTAMP '2024-01-01' + to_days(label) AS created_at FROM (SELECT DISTINCT label FROM embeddings)),
members AS (SELECT label AS collection_id, vec_id AS doc_id, vec_id AS position FROM embeddings),
history AS (SELECT * FROM (SELECT conv_id || '-' || turn AS id, TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS timestamp, conv_id, turn, text AS question,
  lead(text) OVER w AS answer, role, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'),
asked AS (SELECT h.id, h.timestamp, d.source, i AS pos FROM history h CROSS JOIN range(4) r(i) JOIN documents d ON d.doc_id = (h.conv_id * 31 + h.turn * 7 + i * 13) % (SELECT count(*) FROM documents)),
scored AS (SELECT qid, chunk_id, list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda t: (t[1]::DOUBLE - t[2]::DOUBLE) * (t[1]::DOUBLE - t[2]::DOUBLE))) AS distance FROM questions q, chunks c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, chunk_id) AS rank FROM scored),
cands0 AS (SELECT r.*, c.source, c.page, c.content, CASE WHEN lower(q.question) LIKE '%tion%' THEN 'tion' WHEN lower(q.question) LIKE '%the%' THEN 'the' WHEN lower(q.question) LIKE '%que%' THEN 'que' END AS section
  FROM ranked r JOIN chunks c USING (chunk_id) JOIN questions q USING (qid) WHERE rank <= 8),
cands1 AS (SELECT *, coalesce(contains(lower(content), section), true) AS inside FROM cands0),
cands AS (SELECT * FROM (SELECT *, bool_or(inside) OVER (PARTITION BY qid) AS any_inside FROM cands1) WHERE inside OR NOT any_inside),
stripped AS (SELECT *, regexp_replace(regexp_replace(content, '^[\t-\r\x1c-\x20\x{85}\p{Z}]+', ''), '[\t-\r\x1c-\x20\x{85}\p{Z}]+$', '') AS k FROM cands),
firsts AS (SELECT *, row_number() OVER (PARTITION BY qid, k ORDER BY rank) AS nth FROM stripped),
kept AS (SELECT * FROM (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM firsts WHERE nth = 1) WHERE rank <= 4),
conf AS (SELECT *, round_even(greatest(0, least(1, 1 - distance / 2)) * 100, 1) AS confidence FROM kept),
all_terms AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(full_text), '[^\p{L}]+'), lambda x: length(x) > 3)) AS term FROM docs),
tf AS (SELECT doc_id, term, count(*) AS tf FROM all_terms GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
weighted AS (SELECT doc_id, term, round(tf * ln(((SELECT count(*) FROM docs) + 1) / (df + 1)), 6) AS weight FROM tf JOIN df USING (term)),
concepts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM weighted) WHERE rank <= 15)
"""


#: Conversations as uploaded files: a page a turn.
TURNS = "turns AS (SELECT row_number() OVER () AS doc_id, conv_id, turn, text AS full_text FROM conversations)"


def _level_sql(level: int, mark: str) -> str:
    """Parts (doc_id, unit, i, off, len, big) of the texts that are cut at this separator, and the texts for the next level."""
    if not mark:  # single characters: they are told by their places alone
        return f"p{level} AS (SELECT doc_id, off AS unit, i, off + i AS off, 1::BIGINT AS len, '' AS part, false AS big FROM (SELECT doc_id, off, unnest(range(length(t))) AS i FROM u{level}))"
    q = "".join(f"chr({ord(c)}) || " for c in mark).removesuffix(" || ")
    return f"""x{level} AS (SELECT doc_id, off, unnest(x) AS part, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, off, list_transform(string_split(t, {q}), lambda e, j: CASE WHEN j > 1 THEN {q} || e ELSE e END) AS x FROM u{level} WHERE contains(t, {q}))),
p{level} AS (SELECT doc_id, off AS unit, i, off + coalesce(sum(length(part)) OVER (PARTITION BY doc_id, off ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, length(part) AS len, part, length(part) >= 1000 AS big FROM x{level} WHERE part <> ''),
u{level + 1} AS (SELECT doc_id, off, t FROM u{level} WHERE NOT contains(t, {q}) UNION ALL SELECT doc_id, off, part FROM p{level} WHERE big)"""


def _chunked_sql(texts: str = "docs") -> str:
    """``cut`` (doc_id, pos, content): chunks of 1000 characters, 200 of them shared, of a table's ``full_text``.

    Texts are cut at the coarsest separator, long parts at finer ones; runs of short
    parts are put together window by window.
    """
    return (
        f"u0 AS (SELECT doc_id, 0::BIGINT AS off, full_text AS t FROM {texts}), "
        + ", ".join(_level_sql(i, mark) for i, mark in enumerate(X.SEPARATORS))
        + """, parts AS (SELECT l, doc_id, unit, off, len, big, sum(CAST(big AS INTEGER)) OVER (PARTITION BY l, doc_id, unit ORDER BY off) AS seg FROM ("""
        + " UNION ALL ".join(f"SELECT {i} AS l, doc_id, unit, off, len, big FROM p{i}" for i in range(len(X.SEPARATORS)))
        + """)), segs AS (SELECT doc_id, list_append(list(off ORDER BY off), max(off + len)) AS st, count(*) AS m FROM parts WHERE NOT big GROUP BY l, doc_id, unit, seg),
windows AS (SELECT doc_id, st, m, 1::BIGINT AS ws, list_min(list_filter(range(2, m + 1), lambda i: st[i + 1] - st[1] > 1000)) AS nx FROM segs
  UNION ALL SELECT doc_id, st, m, w2, list_min(list_filter(range(w2 + 1, m + 1), lambda i: st[i + 1] - st[w2] > 1000)) FROM
  (SELECT doc_id, st, m, list_min(list_filter(range(ws + 1, nx + 1), lambda j: st[nx] - st[j] <= 200 AND (st[nx + 1] - st[j] <= 1000 OR st[nx] = st[j]))) AS w2 FROM windows WHERE nx IS NOT NULL)),
raw_chunks AS (SELECT doc_id, st[ws] AS off, regexp_replace(regexp_replace(substr(full_text, CAST(st[ws] + 1 AS BIGINT), CAST(coalesce(st[nx], st[m + 1]) - st[ws] AS BIGINT)), '^[\\t-\\r\\x1c-\\x20\\x{85}\\p{Z}]+', ''), '[\\t-\\r\\x1c-\\x20\\x{85}\\p{Z}]+$', '') AS content FROM windows JOIN TEXTS USING (doc_id)),
cut AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY off) - 1 AS INTEGER) AS pos, content FROM raw_chunks WHERE content <> '')""".replace("TEXTS", texts)
    )


def fixtures(spark: SparkSession, sf_dir: str) -> SimpleNamespace:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    raw, vectors = read("documents"), read("embeddings")
    start = "timestamp_ntz'2024-01-01 00:00:00'"
    docs = raw.select(
        "doc_id", F.col("source").alias("filename"), F.col("source").alias("file_path"), F.col("text").alias("full_text"),
        F.expr(f"{start} + make_dt_interval(0, 0, 0, doc_id)").alias("uploaded_at"), F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 40)).alias("summary"),
    )
    joined = vectors.join(raw, vectors.vec_id == raw.doc_id)
    chunks = joined.select(
        F.col("vec_id").alias("chunk_id"), "doc_id", F.concat(F.lit("/in/"), "source", F.lit(".txt")).alias("source"),
        F.when(F.col("vec_id") % 4 > 0, (F.col("vec_id") % 7).cast("int")).alias("page"), F.col("text").alias("content"), "embedding",
    )
    questions = joined.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("text").alias("question"), "embedding")
    collections = vectors.select("label").distinct().select(F.col("label").alias("collection_id"), F.concat(F.lit("c"), "label").alias("name"), F.expr(f"{start} + make_dt_interval(label)").alias("created_at"))
    members = vectors.select(F.col("label").alias("collection_id"), F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("position"))
    turns = Window.partitionBy("conv_id").orderBy("turn")
    talk = read("conversations").select("*", F.lead("text").over(turns).alias("answer"), F.lead("role").over(turns).alias("next")).filter("role = 'user' and next = 'assistant'")
    # Each entry was answered from four documents.
    picked = (F.col("conv_id") * 31 + F.col("turn") * 7 + F.col("pos") * 13) % raw.agg(F.count("*")).scalar()
    asked = talk.select("conv_id", "turn", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos")).withColumn("doc_id", picked)
    sources = asked.join(raw.select("doc_id", "source"), "doc_id").groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", "source"))).alias("s"))
    history = talk.join(sources, ["conv_id", "turn"], "left").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.expr(f"{start} + make_dt_interval(0, conv_id, turn)").alias("timestamp"), F.col("text").alias("question"), "answer",
        F.coalesce(F.transform("s", lambda x: F.struct(x["source"].alias("source"))), F.expr("cast(array() as array<struct<source:string>>)")).alias("context"),
    )
    pairs = raw.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    return SimpleNamespace(raw=raw, turns=read("conversations"), docs=docs, chunks=chunks, questions=questions, collections=collections, members=members, history=history, pairs=pairs, sf_dir=sf_dir)


def _kept(f: SimpleNamespace) -> tuple[DataFrame, DataFrame]:
    return R.kept_hits(f.questions, f.chunks, 4, KEYWORDS)


def _confidence(df: DataFrame) -> DataFrame:
    return df.withColumn("confidence", S.confidence(F.col("distance")))


def _retrieve(f: SimpleNamespace) -> DataFrame:
    found = R.retrieve_context(f.questions, f.chunks, 4, KEYWORDS)
    items = F.transform("context", lambda c: F.concat_ws("|", c["source"], F.format_string("%.1f", c["confidence_percent"]), F.coalesce(c["page"].cast("string"), F.lit("-")), F.sha2(c["content"], 256)))
    return found.select("qid", "query", "chunks_retrieved", "chunks_before_dedup", "duplicates_removed", "exact_duplicates", F.array_join(items, ";").alias("items"), "success")


def _placed(df: DataFrame, *columns: str) -> DataFrame:
    """With each row's place in a short ordered result."""
    return df.select(*columns, F.monotonically_increasing_id().alias("_m")).withColumn("place", F.row_number().over(Window.orderBy("_m")).cast("long")).drop("_m")


def _sets(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.array_join(c, ","))
    return df


def _digests(prompts: list[str]) -> list[str]:
    """Stands in for a model: the digest of each prompt."""
    return [hashlib.md5(p.encode()).hexdigest() for p in prompts]


def _answers(f: SimpleNamespace, answer: Column) -> DataFrame:
    """A fenced JSON answer for each document."""
    return f.docs.select("doc_id", F.concat(F.lit("```json\n"), F.to_json(answer), F.lit("\n```")).alias("raw"))


def _files(f: SimpleNamespace) -> DataFrame:
    """(path, length) of files, some not to be admitted."""
    ends = F.array(*map(F.lit, (".txt", ".pdf", ".exe", ".d/noext", ".tar.md")))
    return f.docs.select(F.concat(F.lit("/in/"), "doc_id", F.get(ends, (F.col("doc_id") % 5).cast("int"))).alias("path"), (F.lit(52428000) + F.col("doc_id")).alias("length"))


def _admitted(good: DataFrame, bad: DataFrame) -> DataFrame:
    return good.select("path", F.lit("accepted").alias("verdict")).unionByName(bad.select("path", F.col("reason").alias("verdict")))


def _ingested(f: SimpleNamespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations uploaded as files, a page for each turn, to the oldest collection."""
    pages = f.turns.select(F.concat(F.lit("/in/c"), "conv_id", F.lit(".txt")).alias("source"), F.col("turn").cast("int").alias("page"), "text")
    members = f.members.withColumn("doc_id", F.col("doc_id").cast("string"))
    return ingest(pages, f.collections, F.expr("timestamp_ntz'2024-03-01 00:00:00'"), members=members)


def _notes(f: SimpleNamespace) -> DataFrame:
    some = lambda n, *of: F.transform(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: i < F.col("doc_id") % n), lambda i: F.struct(*(x(i).alias(c) for c, x in of)))
    return _answers(f, F.struct(F.col("full_text").alias("summary"), some(4, ("concept", lambda i: F.col("filename")), ("explanation", lambda i: i.cast("string"))).alias("key_concepts"), some(3, ("question", lambda i: F.col("filename")), ("answer", lambda i: F.lit("a"))).alias("viva_questions")))


def _comparisons(f: SimpleNamespace) -> DataFrame:
    """Answers in JSON, in words, of another type, and JSON null."""
    good = F.to_json(F.struct(F.array("filename", F.lit("x")).alias("matching_points"), (F.col("doc_id") % 100 + 0.5).alias("overall_match_percent")))
    return f.docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, good).when(F.col("doc_id") % 4 == 1, F.col("filename")).when(F.col("doc_id") % 4 == 2, "[1, 2]").otherwise("null").alias("raw"))


def _crosses(f: SimpleNamespace) -> DataFrame:
    row = lambda name, *files: F.struct(F.lit(name).alias("concept"), F.array(*map(F.lit, files)).alias("found_in"))
    good = F.to_json(F.array(row("one", "a"), row("two", "a", "b")))
    return f.docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, good).when(F.col("doc_id") % 3 == 1, '{"a": 1}').otherwise(F.col("filename")).alias("raw"))


def _summarised(f: SimpleNamespace) -> DataFrame:
    """Documents with summaries as structs."""
    none = F.array().cast("array<string>")
    held = F.struct(F.col("summary").alias("executive_summary"), *(none.alias(c) for c in ("key_topics", "key_takeaways", "important_entities")))
    return f.docs.withColumn("summary", F.when(F.col("summary").isNotNull(), held))


def _own_vectors(f: SimpleNamespace) -> SimpleNamespace:
    """All documents cut to chunks with vectors of their own, and questions with vectors made the same way."""
    pages = f.docs.select("doc_id", F.concat(F.lit("/in/"), "filename").alias("source"), F.lit(None).cast("int").alias("page"), F.col("full_text").alias("text"))
    chunks = with_vectors(X.chunk_recursive(pages).withColumn("chunk_id", F.concat_ws("#", "doc_id", "pos")))
    questions = f.docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), F.col("full_text").alias("question"))
    return SimpleNamespace(chunks=chunks, questions=questions.withColumn("embedding", X.vector(F.col("question"))))


def _all_prompts(f: SimpleNamespace) -> DataFrame:
    """Digests of the prompts of all eight kinds."""
    t = F.col("full_text")
    prompts = {task: tasks.render(task, t) for task in tasks.TEMPLATES} | {"short": tasks.render_short_summary(t), "answer": tasks.render_answer(F.col("filename"), t), "compare": tasks.render_compare(t, F.col("filename"))}
    return f.docs.select("doc_id", F.explode(F.array(*(F.struct(F.lit(k).alias("task"), F.md5(p).alias("prompt")) for k, p in prompts.items()))).alias("p")).select("doc_id", "p.*")


def _all_prompts_sql() -> str:
    parts = [f"SELECT doc_id, '{task}' AS task, md5('{before}' || {f'substr(full_text, 1, {S.LIMITS[limit]})' if limit else 'full_text'}) AS prompt FROM docs" for task, (before, _, limit) in tasks.TEMPLATES.items()]
    parts.append("SELECT doc_id, 'short', md5('Summarise in 150 words at most:' || chr(10) || chr(10) || full_text) FROM docs")
    parts.append(f"SELECT doc_id, 'answer', md5('{tasks.ANSWER[0]}' || full_text || '{tasks.ANSWER[1]}' || filename || '{tasks.ANSWER[2]}') FROM docs")
    parts.append(f"SELECT doc_id, 'compare', md5('{tasks.COMPARE[0]}' || substr(full_text, 1, 8000) || '{tasks.COMPARE[1]}' || filename) FROM docs")
    return " UNION ALL ".join(parts)


def _streamed_days(f: SimpleNamespace) -> DataFrame:
    """The events table read as a stream to its end, counted by day in a table."""
    spark, path = f.raw.sparkSession, f"{f.sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    out, state = new_path(spark, "days"), new_path(spark, "days-state")
    stream_daily_counts(stream.select(F.col("ts").cast("timestamp").alias("timestamp")), out, state).awaitTermination()
    return daily_counts(spark, out)


def _text_files(f: SimpleNamespace) -> str:
    """A folder of text files, each with the texts of fifty ids, a line end after each."""
    out = new_path(f.raw.sparkSession, "texts")
    rows = f.raw.select(F.floor(F.col("doc_id") / 50).alias("file"), "doc_id", "text").repartition("file").sortWithinPartitions("file", "doc_id")
    rows.select("file", "text").write.partitionBy("file").text(out)
    return out


def _stream_ingested(f: SimpleNamespace) -> DataFrame:
    """The text files ingested by a stream in about three batches; ``placed``: all their members follow each other without gaps or repeats."""
    spark, n = f.raw.sparkSession, f.raw.select(F.floor(F.col("doc_id") / 50)).distinct().count()
    out, state = new_path(spark, "ingested"), new_path(spark, "ingested-state")
    stream_ingest(spark, _text_files(f), out, state, f.collections, files_per_batch=max(1, -(-n // 3))).awaitTermination()
    members = spark.read.parquet(f"{out}/members")
    whole = members.agg(((F.count("*") == n) & (F.countDistinct("position") == n) & (F.min("position") == 0) & (F.max("position") == n - 1)).alias("x")).scalar()
    docs = spark.read.parquet(f"{out}/documents").join(members.select("doc_id"), "doc_id")
    return docs.select(_file_number("file_path"), "full_text", "chunk_count", whole.alias("placed"))


def _file_number(source: str) -> Column:
    return F.regexp_extract(source, "file=([0-9]+)", 1).cast("long").alias("file")


def _lines(content: bytes) -> list[tuple[int | None, str]]:
    return list(enumerate(content.decode().split("\n")))


def _appended(f: SimpleNamespace) -> DataFrame:
    """Documents added to a table in three runs, with a column that only the last has to fill."""
    out = new_path(f.raw.sparkSession, "appended")
    for i in range(3):
        files.append_rows(f.docs.where(F.pmod("doc_id", F.lit(3)) == i).drop("uploaded_at"), out)
    return f.raw.sparkSession.read.parquet(out)


def _exported(f: SimpleNamespace) -> DataFrame:
    """The history written as JSON lines, over an older export, and read again."""
    out = new_path(f.raw.sparkSession, "exported")
    files.export_store(f.history.limit(1), out)
    files.export_store(f.history, out)
    return f.raw.sparkSession.read.schema(f.history.schema).json(out)


def _cleared(f: SimpleNamespace) -> DataFrame:
    """How many entries a history has before it is cleared, after that, and when one conversation's are added again."""
    spark, out = f.raw.sparkSession, new_path(f.raw.sparkSession, "history")
    files.append_rows(f.history, out)
    counts = [spark.read.parquet(out).count()]
    files.clear_history(spark, out)
    counts.append(spark.read.parquet(out).count())
    files.append_rows(f.history.where("id like '7-%'"), out)
    return spark.read.parquet(out).agg(F.lit(counts[0]).cast("long").alias("before"), F.lit(counts[1]).cast("long").alias("cleared"), F.count("*").alias("again"))


def _sometimes(prompts: list[str]) -> list[str]:
    """Fails on some prompts."""
    if any(p.startswith("FAIL") for p in prompts):
        raise ValueError("no answer")
    return _digests(prompts)


def _answering(prompts: list[str]) -> list[str]:
    """Fails on half of the prompts."""
    found = _digests(prompts)
    if any(d[0] >= "8" for d in found):
        raise ValueError("no answer")
    return found


def _line_digests(prompts: list[str]) -> list[str]:
    """Answers in words: a bare digest is a JSON number now and then, and JSON without a list has no question."""
    return [f"- {d}" for d in _digests(prompts)]


def _json_digests(prompts: list[str]) -> list[str]:
    return [f'```json\n{{"executive_summary": "{d}"}}\n```' for d in _digests(prompts)]


def _note_digests(prompts: list[str]) -> list[str]:
    return [f'{{"summary": "{d}", "viva_questions": [{{"question": "q", "answer": "a"}}]}}' for d in _digests(prompts)]


def _cross_digests(prompts: list[str]) -> list[str]:
    whole = tasks.TEMPLATES["cross"][0]
    return [f'[{{"concept": "{d}", "found_in": ["x"]}}]' if p.startswith(whole) else f'["{d}"]' for p, d in zip(prompts, _digests(prompts), strict=True)]


Rows = Callable[[SimpleNamespace], DataFrame]

#: name -> (rows, SQL after the fixtures' WITH).
TABLE: dict[str, tuple[Rows, str | None]] = {
    "a1_load_text": (
        lambda f: files.load_text(f.raw.sparkSession, _text_files(f))[0].select(_file_number("source"), F.col("page").isNull().alias("whole"), "text"),
        r"SELECT doc_id // 50 AS file, true AS whole, regexp_replace(string_agg(text || chr(10), '' ORDER BY doc_id), '\r\n?', chr(10), 'g') AS text FROM documents GROUP BY 1",
    ),
    "a2_load_with": (
        lambda f: files.load_with(f.raw.sparkSession, f"{_text_files(f)}/*", _lines).select(_file_number("source"), "page", "text"),
        "SELECT file, CAST(i AS INTEGER) AS page, lines[i + 1] AS text FROM (SELECT file, lines, unnest(range(len(lines))) AS i FROM (SELECT doc_id // 50 AS file, string_split(string_agg(text || chr(10), '' ORDER BY doc_id), chr(10)) AS lines FROM documents GROUP BY 1))",
    ),
    "a7_append_rows": (lambda f: _appended(f), "SELECT doc_id, filename, file_path, full_text, summary FROM docs"),
    "a8_export_store": (
        lambda f: _exported(f).select("id", F.col("timestamp").cast("string").alias("timestamp"), "question", "answer", F.array_join(F.transform("context", lambda c: c["source"]), ",").alias("context")),
        "SELECT h.id, strftime(h.timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, question, answer, coalesce(string_agg(source, ',' ORDER BY pos), '') AS context FROM history h LEFT JOIN asked USING (id) GROUP BY ALL",
    ),
    "a9_clear_history": (lambda f: _cleared(f), "SELECT count(*) AS before, 0::BIGINT AS cleared, count(*) FILTER (id LIKE '7-%') AS again FROM history"),
    "a4_assemble_full_text": (
        lambda f: X.assemble_full_text(f.turns.select(F.col("conv_id").alias("source"), F.col("turn").alias("page"), "text")),
        "SELECT conv_id AS source, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS full_text FROM conversations GROUP BY 1",
    ),
    "p1_get_document": (lambda f: K.get_document(f.docs, 7).select("doc_id", "filename", "full_text"), "SELECT doc_id, filename, full_text FROM docs WHERE doc_id = 7"),
    "p2_light_documents": (lambda f: K.light_documents(f.docs).withColumn("uploaded_at", F.col("uploaded_at").cast("string")), "SELECT doc_id, filename, file_path, CAST(uploaded_at AS VARCHAR) AS uploaded_at, summary FROM docs"),
    "p3_filter_section": (lambda f: _kept(f)[0].select("qid", "chunk_id", "rank"), "SELECT qid, chunk_id, rank FROM cands"),
    "p4_delete_document": (lambda f: K.delete_document(f.docs, 7).select("doc_id"), "SELECT doc_id FROM docs WHERE doc_id <> 7"),
    "p5_get_collection": (lambda f: K.get_collection_row(f.collections, 3).select("collection_id", "name"), "SELECT collection_id, name FROM collections WHERE collection_id = 3"),
    "p5_delete_collection": (lambda f: K.delete_collection(f.collections, 3).select("collection_id", "name"), "SELECT collection_id, name FROM collections WHERE collection_id <> 3"),
    "p6_remove_member": (lambda f: K.remove_member(f.members, 3, 13), "SELECT * FROM members WHERE NOT (collection_id = 3 AND doc_id = 13)"),
    "p7_uncached": (lambda f: K.uncached(f.docs).select("doc_id"), "SELECT doc_id FROM docs WHERE summary IS NULL"),
    "p8_hits_without_scores": (lambda f: R.hits_without_scores(R.knn(f.questions, f.chunks, 4)), "SELECT qid, chunk_id, rank FROM ranked WHERE rank <= 4"),
    "j1_collection_documents": (
        lambda f: K.collection_documents(f.collections, f.members, f.docs).select("collection_id", "name", F.array_join(F.transform("documents", lambda d: F.concat_ws("|", d["doc_id"], d["filename"], d["file_path"], d["uploaded_at"].cast("string"), F.coalesce(d["summary"], F.lit("-")))), ",").alias("documents")),
        "SELECT c.collection_id, c.name, coalesce(string_agg(concat_ws('|', d.doc_id, d.filename, d.file_path, strftime(d.uploaded_at, '%Y-%m-%d %H:%M:%S'), coalesce(d.summary, '-')), ',' ORDER BY m.position), '') AS documents FROM collections c LEFT JOIN (members m JOIN docs d USING (doc_id)) USING (collection_id) GROUP BY ALL",
    ),
    "j1_collection_members": (
        lambda f: K.collection_members(f.collections, f.members, f.docs).select("collection_id", "name", "position", "document.doc_id", "document.filename", "document.summary"),
        "SELECT c.collection_id, c.name, m.position, d.doc_id, d.filename, d.summary FROM collections c JOIN members m USING (collection_id) JOIN docs d USING (doc_id)",
    ),
    "j2_resolve_documents": (
        lambda f: K.resolve_documents(f.docs.select(F.col("doc_id").cast("string").alias("ident")).union(f.docs.select("filename").distinct()), f.docs).select("ident", F.col("document.doc_id").alias("doc_id")),
        "SELECT CAST(doc_id AS VARCHAR) AS ident, doc_id FROM docs UNION ALL SELECT filename, max(doc_id) FROM docs GROUP BY filename",
    ),
    "j3_select_documents": (lambda f: _placed(K.select_documents(f.docs, [9, -1, 4, 9]), "doc_id", "filename"), "SELECT doc_id, filename, place FROM docs JOIN (VALUES (9, 1::BIGINT), (4, 2), (9, 3)) v(i, place) ON doc_id = i"),
    "j4_knn": (lambda f: R.knn(f.questions, f.chunks, 8).withColumn("distance", F.round("distance", 6)), "SELECT qid, chunk_id, round(distance, 6) AS distance, rank FROM ranked WHERE rank <= 8"),
    "j4_knn_arrow": (lambda f: R.knn(f.questions, f.chunks, 8, cells=12).withColumn("distance", F.round("distance", 6)), "SELECT qid, chunk_id, round(distance, 6) AS distance, rank FROM ranked WHERE rank <= 8"),
    "j5_knn_approx": (lambda f: R.knn_approx(f.questions, f.chunks, 4), None),
    "j6_upsert_summaries": (
        lambda f: K.upsert_summaries(f.docs, f.docs.filter("doc_id % 5 = 0").select("doc_id", F.lit("new").alias("summary"))).select("doc_id", "summary"),
        "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE summary END AS summary FROM docs",
    ),
    "j7_pair_documents": (
        lambda f: K.pair_documents(f.pairs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")), f.docs).select("a", "b", F.col("doc_a.doc_id").alias("ia"), F.col("doc_b.doc_id").alias("ib"), "error"),
        "SELECT CAST(p.doc_id AS VARCHAR) AS a, CAST(p.doc_id + 1 AS VARCHAR) AS b, p.doc_id AS ia, d.doc_id AS ib, CASE WHEN d.doc_id IS NULL THEN 'Document not found: ' || (p.doc_id + 1) END AS error FROM docs p LEFT JOIN docs d ON d.doc_id = p.doc_id + 1",
    ),
    "e1_source_counts": (lambda f: A.source_counts(f.history), "SELECT coalesce(source, 'Unknown') AS source, count(*) AS n FROM asked GROUP BY 1"),
    "e2_most_queried": (
        lambda f: A.most_queried(f.history),
        "SELECT max(source) AS most_queried FROM (SELECT s.source FROM (SELECT source, count(*) AS n FROM asked GROUP BY 1) s JOIN (SELECT source, row_number() OVER (PARTITION BY source ORDER BY timestamp DESC, id, pos) AS k, timestamp, id, pos FROM asked) a ON s.source = a.source AND k = 1 ORDER BY n DESC, timestamp DESC, id, pos LIMIT 1)",
    ),
    "e3_queries_on": (lambda f: A.queries_on(f.history, "2024-01-02"), "SELECT count(*) AS n FROM history WHERE CAST(timestamp AS DATE) = DATE '2024-01-02'"),
    "e3_queries_per_day": (lambda f: A.queries_per_day(f.history), "SELECT CAST(timestamp AS DATE) AS day, count(*) AS n FROM history GROUP BY 1"),
    "e4_summarized_count": (lambda f: A.summarized_count(f.docs), "SELECT count(summary) AS n FROM docs"),
    "e5_dashboard": (
        lambda f: A.dashboard(f.docs, f.chunks, f.history, f.collections, "2024-01-02", "own", "none"),
        "SELECT (SELECT count(*) FROM docs) AS total_documents, (SELECT count(*) FROM chunks) AS total_chunks, (SELECT count(*) FROM history) AS total_queries, (SELECT count(*) FROM history WHERE CAST(timestamp AS DATE) = DATE '2024-01-02') AS queries_today, (SELECT count(*) FROM collections) AS total_collections, (SELECT count(summary) FROM docs) AS summarized_documents, (SELECT s.source FROM (SELECT source, count(*) AS n FROM asked GROUP BY 1) s JOIN (SELECT source, row_number() OVER (PARTITION BY source ORDER BY timestamp DESC, id, pos) AS k, timestamp, id, pos FROM asked) a ON s.source = a.source AND k = 1 ORDER BY n DESC, timestamp DESC, id, pos LIMIT 1) AS most_queried_document, 'own' AS llm_provider, 'none' AS llm_model",
    ),
    "e6_collection_info": (lambda f: A.collection_info(f.chunks, "all", "/db"), "SELECT 'all' AS name, count(*) AS document_count, '/db' AS path FROM chunks"),
    "e7_chunk_counts": (lambda f: A.chunk_counts(f.docs, f.chunks), "SELECT d.doc_id, count(c.chunk_id) AS chunk_count FROM docs d LEFT JOIN chunks c USING (doc_id) GROUP BY 1"),
    "e8_retrieval_trace": (
        lambda f: R.retrieval_trace(f.questions, *_kept(f)).withColumn("scores", F.array_join(F.transform("scores", lambda s: F.format_string("%.1f", s)), ",")),
        "SELECT q.qid, q.question AS query, CAST(count(k.rank) AS INTEGER) AS chunks_retrieved, CAST(any_value(b.n) AS INTEGER) AS chunks_before_dedup, CAST(any_value(b.n) - count(k.rank) AS INTEGER) AS duplicates_removed, CAST(any_value(b.n - b.d) AS INTEGER) AS exact_duplicates, coalesce(string_agg(printf('%.1f', confidence), ',' ORDER BY k.rank), '') AS scores FROM questions q LEFT JOIN conf k USING (qid) LEFT JOIN (SELECT qid, count(*) AS n, count(DISTINCT k) AS d FROM stripped GROUP BY 1) b USING (qid) GROUP BY 1, 2",
    ),
    "e9_embedding_dimension": (lambda f: A.embedding_dimension(f.chunks), "SELECT CAST(min(len(embedding)) AS INTEGER) AS dimension, count(DISTINCT len(embedding)) > 1 AS mixed FROM chunks"),
    "e10_context_pack": (lambda f: R.context_pack(_kept(f)[1]), "SELECT qid, string_agg('Source: ' || coalesce(source, 'Unknown') || chr(10) || content, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM kept GROUP BY 1"),
    "e11_concept_listing": (
        lambda f: X.concept_listing(X.top_concepts(f.docs, 5).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("concepts")).join(f.docs, "doc_id").select("filename", F.col("doc_id").alias("position"), "concepts")),
        "SELECT p AS place, filename, 'Document: ' || filename || chr(10) || 'Concepts: ' || c AS block FROM (SELECT filename, min(doc_id) AS p, max_by(c, doc_id) AS c FROM (SELECT doc_id, string_agg(term, ', ' ORDER BY rank) AS c FROM concepts WHERE rank <= 5 GROUP BY 1) JOIN docs USING (doc_id) GROUP BY 1)",
    ),
    "w1_latest_by_filename": (lambda f: K.latest_by_filename(f.docs).select("filename", "doc_id"), "SELECT filename, max(doc_id) AS doc_id FROM docs GROUP BY 1"),
    "w2_dedup_hits": (lambda f: _kept(f)[1].select("qid", "chunk_id", "rank"), "SELECT qid, chunk_id, rank FROM kept"),
    "w3_topk": (lambda f: R.knn(f.questions, f.chunks, 3, metric="l2sq").select("qid", "chunk_id", "rank"), "SELECT qid, chunk_id, rank FROM ranked WHERE rank <= 3"),
    "t1_list_documents": (lambda f: K.list_documents(f.docs).select("doc_id", "filename"), "SELECT doc_id, filename FROM docs ORDER BY uploaded_at DESC, doc_id"),
    "t2_list_collections": (lambda f: _placed(K.list_collections(f.collections), "collection_id", "name"), "SELECT collection_id, name, row_number() OVER (ORDER BY created_at, collection_id) AS place FROM collections"),
    "t3_default_collection": (lambda f: K.default_collection(f.collections, F.expr("timestamp_ntz'2024-01-01 00:00:00'")).select("collection_id", "name"), "SELECT collection_id, name FROM collections ORDER BY created_at, collection_id LIMIT 1"),
    "t4_get_history": (lambda f: _placed(K.get_history(f.history, 100), "id", "question"), "SELECT id, question, row_number() OVER (ORDER BY timestamp DESC, id) AS place FROM history ORDER BY timestamp DESC, id LIMIT 100"),
    "t6_order_shared": (
        lambda f: X.order_shared(X.shared_concepts(X.top_concepts(f.docs).join(f.docs, "doc_id").select("filename", F.col("term").alias("concept"))).withColumn("pos", F.col("concept"))).select("concept", F.size("found_in").alias("n")),
        "SELECT term AS concept, CAST(count(DISTINCT filename) AS INTEGER) AS n FROM concepts JOIN docs USING (doc_id) GROUP BY 1 HAVING count(DISTINCT filename) > 1",
    ),
    "m2_add_members": (
        lambda f: K.add_members(f.members, f.docs.select((F.col("doc_id") % 12).alias("collection_id"), F.col("doc_id"), F.col("doc_id").alias("position")), f.collections),
        "WITH_MORE fresh AS (SELECT doc_id % 12 AS collection_id, doc_id FROM docs WHERE doc_id % 12 IN (SELECT collection_id FROM collections) AND NOT EXISTS (SELECT 1 FROM members m WHERE m.collection_id = docs.doc_id % 12 AND m.doc_id = docs.doc_id)) SELECT * FROM members UNION ALL SELECT collection_id, doc_id, coalesce(last, -1) + row_number() OVER (PARTITION BY collection_id ORDER BY doc_id) FROM fresh LEFT JOIN (SELECT collection_id, max(position) AS last FROM members GROUP BY 1) USING (collection_id)",
    ),
    "g1_top_concepts": (lambda f: X.top_concepts(f.docs), "SELECT doc_id, term, weight, rank FROM concepts"),
    "g2_shared_concepts": (
        lambda f: _sets(X.shared_concepts(X.top_concepts(f.docs).join(f.docs, "doc_id").select("filename", F.col("term").alias("concept"))), "found_in"),
        "SELECT term AS concept, string_agg(DISTINCT filename, ',' ORDER BY filename) AS found_in, CAST(count(DISTINCT filename) AS INTEGER) AS n FROM concepts JOIN docs USING (doc_id) GROUP BY 1 HAVING count(DISTINCT filename) > 1",
    ),
    "g2_concept_files": (
        lambda f: X.concept_files(X.top_concepts(f.docs).join(f.docs, "doc_id").select("filename", F.col("term").alias("concept"))),
        "SELECT DISTINCT term AS concept, filename, CAST(n AS INTEGER) AS n FROM concepts JOIN docs USING (doc_id) JOIN (SELECT term, count(DISTINCT filename) AS n FROM concepts JOIN docs USING (doc_id) GROUP BY 1) USING (term) WHERE n > 1",
    ),
    "g2_shared_examples": (
        lambda f: _sets(X.shared_concepts(X.top_concepts(f.docs).join(f.docs, "doc_id").select("filename", F.col("term").alias("concept")), 3), "found_in"),
        "SELECT term AS concept, array_to_string(list_sort(list(DISTINCT filename))[1:3], ',') AS found_in, CAST(count(DISTINCT filename) AS INTEGER) AS n FROM concepts JOIN docs USING (doc_id) GROUP BY 1 HAVING count(DISTINCT filename) > 1",
    ),
    "g3_compare_terms": (
        lambda f: X.compare_terms(f.pairs, f.docs).select("a", "b", *(F.array_join(c, ",").alias(c) for c in ("matching_points", "missing_in_a", "missing_in_b")), "overall_match_percent"),
        r"WITH_MORE own AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(full_text), '[^\p{L}]+'), lambda x: length(x) > 3)) AS t FROM docs), s AS (SELECT a.doc_id AS a, b.doc_id AS b, list_intersect(a.t, b.t) AS shared, a.t AS ta, b.t AS tb, len(list_intersect(a.t, b.t)) AS i, len(a.t) AS na, len(b.t) AS nb FROM own a JOIN own b ON b.doc_id = a.doc_id + 1) SELECT a, b, array_to_string(list_sort(shared), ',') AS matching_points, array_to_string(list_sort(list_filter(tb, lambda x: NOT list_contains(shared, x))), ',') AS missing_in_a, array_to_string(list_sort(list_filter(ta, lambda x: NOT list_contains(shared, x))), ',') AS missing_in_b, CASE WHEN na + nb = 0 THEN 0.0 ELSE round(100 * i / (na + nb - i), 1) END AS overall_match_percent FROM s",
    ),
    "g4_extractive_summary": (
        lambda f: _sets(X.extractive_summary(f.docs), "topics"),
        r"WITH_MORE t12 AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(full_text), '[^\p{L}]+'), lambda x: length(x) > 3)) AS term FROM docs), tf12 AS (SELECT doc_id, term, count(*) AS tf FROM t12 GROUP BY ALL), df12 AS (SELECT term, count(*) AS df FROM tf12 GROUP BY ALL), w12 AS (SELECT doc_id, term, round(tf * ln(((SELECT count(*) FROM docs) + 1) / (df + 1)), 6) AS weight FROM tf12 JOIN df12 USING (term)), c12 AS (SELECT * FROM w12 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) <= 15), parts AS (SELECT doc_id, regexp_split_to_array(full_text, '[.!?\n]+') AS p FROM docs), sent0 AS (SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS s FROM parts), sent AS (SELECT doc_id, pos, trim(s, ' ') AS s FROM sent0 WHERE trim(s, ' ') <> ''), st AS (SELECT doc_id, pos, s, list_filter(regexp_split_to_array(lower(s), '[^\p{L}]+'), lambda x: length(x) > 3) AS ts FROM sent), m AS (SELECT doc_id, pos, s, round(avg(coalesce(weight, 0)), 6) AS w FROM (SELECT doc_id, pos, s, unnest(CASE WHEN len(ts) = 0 THEN ['?'] ELSE ts END) AS term FROM st) LEFT JOIN c12 USING (doc_id, term) GROUP BY ALL), best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, pos) <= 3) SELECT doc_id, summary, coalesce(topics, '') AS topics FROM (SELECT doc_id, string_agg(s, '. ' ORDER BY pos) AS summary FROM best GROUP BY 1) LEFT JOIN (SELECT doc_id, string_agg(term, ',' ORDER BY rank) AS topics FROM concepts GROUP BY 1) USING (doc_id)",
    ),
    "g5_concept_questions": (
        lambda f: _sets(X.concept_questions(X.top_concepts(f.docs)), "questions"),
        "SELECT doc_id, string_agg('What does the document say about ' || term || '?', ',' ORDER BY rank) AS questions FROM concepts WHERE rank <= 5 GROUP BY 1",
    ),
    "b1_chunk_recursive": (
        lambda f: X.chunk_recursive(f.docs.select("doc_id", F.col("file_path").alias("source"), F.lit(None).cast("int").alias("page"), F.col("full_text").alias("text"))),
        "WITH_MORE " + _chunked_sql() + " SELECT cut.doc_id, file_path AS source, CAST(NULL AS INTEGER) AS page, pos, content FROM cut JOIN docs USING (doc_id)",
    ),
    "b1_chunk_characters": (
        lambda f: X.chunk_recursive(f.docs.select("doc_id", F.col("file_path").alias("source"), F.lit(None).cast("int").alias("page"), F.col("full_text").alias("text")), separators=("",)).select("doc_id", "pos", "content"),
        r"WITH_MORE cut AS (SELECT doc_id, i, regexp_replace(regexp_replace(substr(full_text, CAST(i * 800 + 1 AS BIGINT), 1000), '^[\t-\r\x1c-\x20\x{85}\p{Z}]+', ''), '[\t-\r\x1c-\x20\x{85}\p{Z}]+$', '') AS content FROM (SELECT doc_id, full_text, unnest(range(1 + greatest(0, length(full_text) - 201) // 800)) AS i FROM docs)) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, content FROM cut WHERE content <> ''",
    ),
    "h1_stream_ingest": (
        lambda f: _stream_ingested(f),
        r"WITH_MORE files AS (SELECT doc_id // 50 AS doc_id, regexp_replace(string_agg(text || chr(10), '' ORDER BY doc_id), '\r\n?', chr(10), 'g') AS full_text FROM documents GROUP BY 1), " + _chunked_sql("files") + " SELECT doc_id AS file, full_text, CAST(coalesce(n, 0) AS INTEGER) AS chunk_count, true AS placed FROM files LEFT JOIN (SELECT doc_id, count(*) AS n FROM cut GROUP BY 1) USING (doc_id)",
    ),
    "h2_stream_queries_per_day": (
        lambda f: _streamed_days(f),
        "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1",
    ),
    "b2_chunk_fixed": (
        lambda f: X.chunk_fixed(f.raw.select("doc_id", "text")),
        "SELECT doc_id, CAST(i AS INTEGER) AS pos, substr(text, CAST(i * 800 + 1 AS BIGINT), 1000) AS content FROM (SELECT doc_id, text, unnest(range(1 + greatest(0, length(text) - 201) // 800)) AS i FROM documents)",
    ),
    "b3_embed": (
        lambda f: X.hashed_terms(f.raw, "doc_id", "text"),
        r"SELECT doc_id, CAST(('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS BIGINT) AS dim, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda x: length(x) > 3)) AS term FROM documents) GROUP BY ALL",
    ),
    "b3_embed_dense": (
        lambda f: X.embed(f.raw, "doc_id", "text").select("doc_id", F.posexplode("embedding").alias("dim", "value")).select("doc_id", "dim", F.round(F.col("value").cast("double"), 6).alias("value")),
        r"WITH_MORE counted AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS dim, count(*) AS n FROM all_terms GROUP BY ALL), norms AS (SELECT doc_id, sqrt(sum(n * n)::DOUBLE) AS norm FROM counted GROUP BY 1) SELECT d.doc_id, CAST(i AS INTEGER) AS dim, round(CAST(CAST(coalesce(n / norm, 0) AS FLOAT) AS DOUBLE), 6) AS value FROM documents d CROSS JOIN range(64) r(i) LEFT JOIN norms USING (doc_id) LEFT JOIN counted c ON c.doc_id = d.doc_id AND c.dim = i",
    ),
    "s1_detect_section": (lambda f: f.docs.select("doc_id", S.detect_section(F.col("full_text"), KEYWORDS).alias("section")), "SELECT doc_id, CASE WHEN contains(lower(full_text), 'tion') THEN 'tion' WHEN contains(lower(full_text), 'the') THEN 'the' WHEN contains(lower(full_text), 'que') THEN 'que' END AS section FROM docs"),
    "s2_confidence": (lambda f: _confidence(_kept(f)[1]).select("qid", "chunk_id", "confidence"), "SELECT qid, chunk_id, confidence FROM conf"),
    "s3_clean_source": (lambda f: f.chunks.select("chunk_id", S.clean_source(F.col("source")).alias("name")), r"SELECT chunk_id, regexp_extract(source, '[^/]+$') AS name FROM chunks"),
    "s4_display_page": (lambda f: f.chunks.select("chunk_id", S.display_page(F.col("page")).alias("page")), "SELECT chunk_id, page + 1 AS page FROM chunks"),
    "s5_pystrip": (lambda f: f.docs.select("doc_id", S.pystrip(F.col("full_text")).alias("t")), r"SELECT doc_id, regexp_replace(regexp_replace(full_text, '^[\t-\r\x1c-\x20\x{85}\p{Z}]+', ''), '[\t-\r\x1c-\x20\x{85}\p{Z}]+$', '') AS t FROM docs"),
    "s6_truncate": (lambda f: f.docs.select("doc_id", S.truncate(F.col("full_text"), 6000).alias("t")), "SELECT doc_id, substr(full_text, 1, 6000) AS t FROM docs"),
    "s7_snippet": (lambda f: f.docs.select("doc_id", S.snippet(F.col("full_text")).alias("t")), "SELECT doc_id, CASE WHEN length(full_text) > 200 THEN substr(full_text, 1, 200) || '…' ELSE full_text END AS t FROM docs"),
    "s8_terms": (lambda f: f.docs.select("doc_id", F.explode(S.terms(F.col("full_text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n")), r"SELECT term, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(full_text), '[^\p{L}]+'), lambda x: length(x) > 3)) AS term FROM docs) GROUP BY 1"),
    "f1_render_prompts": (
        lambda f: f.docs.select("doc_id", tasks.render("concepts", F.col("full_text")).alias("prompt")),
        "SELECT doc_id, '" + tasks.TEMPLATES["concepts"][0] + "' || substr(full_text, 1, 6000) AS prompt FROM docs",
    ),
    "f3_short_summary": (
        lambda f: tasks.short_summary(f.docs, _digests).select("doc_id", "raw"),
        "SELECT doc_id, md5('Summarise in 150 words at most:' || chr(10) || chr(10) || full_text) AS raw FROM docs",
    ),
    "f4_parse_summary": (
        lambda f: tasks.parse_summary(_answers(f, F.struct(F.col("full_text").alias("executive_summary"), F.array("filename").alias("key_topics")))).select("doc_id", "summary.executive_summary", F.array_join("summary.key_topics", ",").alias("key_topics"), F.size("summary.key_takeaways").alias("n_takeaways")),
        "SELECT doc_id, full_text AS executive_summary, filename AS key_topics, CAST(0 AS INTEGER) AS n_takeaways FROM docs",
    ),
    "f5_parse_questions": (
        lambda f: tasks.parse_questions(_answers(f, F.array("filename", "full_text", *map(F.lit, "cdef")))).select("doc_id", F.array_join("questions", "|").alias("questions")),
        "SELECT doc_id, filename || '|' || full_text || '|c|d|e' AS questions FROM docs",
    ),
    "f6_parse_concepts": (
        lambda f: tasks.parse_concepts(_answers(f, F.array_distinct(S.terms(F.col("full_text"))))).select("doc_id", F.explode("concepts").alias("concept")),
        r"SELECT DISTINCT doc_id, term AS concept FROM all_terms",
    ),
    "s9_file_extension": (lambda f: f.chunks.select("chunk_id", S.file_extension(F.col("source")).alias("ext")), r"SELECT chunk_id, lower(regexp_extract(source, '[^/.][^/]*(\.[^./]+)$', 1)) AS ext FROM chunks"),
    "q1_retrieve_context": (
        _retrieve,
        "SELECT q.qid, q.question AS query, CAST(count(k.rank) AS INTEGER) AS chunks_retrieved, CAST(any_value(b.n) AS INTEGER) AS chunks_before_dedup, CAST(any_value(b.n) - count(k.rank) AS INTEGER) AS duplicates_removed, CAST(any_value(b.n - b.d) AS INTEGER) AS exact_duplicates, string_agg(regexp_extract(source, '[^/]+$') || '|' || printf('%.1f', confidence) || '|' || coalesce(CAST(page + 1 AS VARCHAR), '-') || '|' || sha256(content), ';' ORDER BY k.rank) AS items, count(k.rank) > 0 AS success FROM questions q LEFT JOIN conf k USING (qid) LEFT JOIN (SELECT qid, count(*) AS n, count(DISTINCT k) AS d FROM stripped GROUP BY 1) b USING (qid) GROUP BY 1, 2",
    ),
    "a3_admit_files": (
        lambda f: _admitted(*files.admit_files(_files(f))),
        "SELECT path, CASE WHEN regexp_extract(path, '[^/.][^/]*([.][^./]+)$', 1) NOT IN ('.pdf', '.txt', '.docx', '.md') THEN 'type' WHEN length > 52428800 THEN 'size' ELSE 'accepted' END AS verdict FROM (SELECT '/in/' || doc_id || ['.txt', '.pdf', '.exe', '.d/noext', '.tar.md'][doc_id % 5 + 1] AS path, 52428000 + doc_id AS length FROM docs)",
    ),
    "a5_ingest_documents": (
        lambda f: _ingested(f)[0].select("filename", "file_path", "full_text", "chunk_count", F.col("uploaded_at").cast("string").alias("uploaded_at"), F.col("summary").isNull().alias("new")),
        f"WITH_MORE {TURNS}, " + _chunked_sql("turns") + " SELECT 'c' || conv_id || '.txt' AS filename, '/in/c' || conv_id || '.txt' AS file_path, string_agg(full_text, chr(10) || chr(10) ORDER BY turn) AS full_text, CAST(sum(coalesce(n, 0)) AS INTEGER) AS chunk_count, '2024-03-01 00:00:00' AS uploaded_at, true AS new FROM turns LEFT JOIN (SELECT doc_id, count(*) AS n FROM cut GROUP BY 1) USING (doc_id) GROUP BY conv_id",
    ),
    "a5_ingest_chunks": (
        lambda f: _ingested(f)[1].select("source", "page", "pos", "content", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("norm")),
        f"WITH_MORE {TURNS}, " + _chunked_sql("turns") + r" SELECT '/in/c' || conv_id || '.txt' AS source, CAST(turn AS INTEGER) AS page, pos, content, CASE WHEN len(list_filter(regexp_split_to_array(lower(content), '[^\p{L}]+'), lambda x: length(x) > 3)) > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS norm FROM cut JOIN turns USING (doc_id)",
    ),
    "a5_ingest_members": (
        lambda f: _ingested(f)[2].groupBy("collection_id").agg(F.count("*").alias("n"), F.min("position").alias("first"), F.max("position").alias("last")),
        "SELECT 0 AS collection_id, n, last_one + 1 AS first, last_one + n AS last FROM (SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS n, (SELECT max(vec_id) FROM embeddings WHERE label = 0) AS last_one)",
    ),
    "e12_notes_counts": (
        lambda f: tasks.notes_counts(tasks.parse_notes(_notes(f))).select("doc_id", "counts.*"),
        "SELECT doc_id, CAST(doc_id % 4 AS INTEGER) AS key_concepts, CAST(0 AS INTEGER) AS flashcards, CAST(doc_id % 3 AS INTEGER) AS viva_questions, CAST(0 AS INTEGER) AS mcqs FROM docs",
    ),
    "t5_oversample": (lambda f: R.knn(f.questions, f.chunks, R.oversample(3)).select("qid", "chunk_id", "rank"), "SELECT qid, chunk_id, rank FROM ranked WHERE rank <= 6"),
    "t7_cap_questions": (
        lambda f: f.docs.select("doc_id", F.array_join(S.cap_questions(S.terms(F.col("full_text"))), ",").alias("questions")),
        r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(full_text), '[^\p{L}]+'), lambda x: length(x) > 3)[1:5], ',') AS questions FROM docs",
    ),
    "m1_create_collections": (
        lambda f: K.create_collections(f.collections, f.docs.select(F.col("doc_id").cast("int").alias("collection_id"), F.col("filename").alias("name")), F.expr("timestamp_ntz'2024-05-01 00:00:00'")).withColumn("created_at", F.col("created_at").cast("string")),
        "SELECT collection_id, name, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM collections UNION ALL SELECT doc_id, filename, '2024-05-01 00:00:00' FROM docs",
    ),
    "s10_strip_fences": (
        lambda f: f.docs.select("doc_id", S.strip_fences(F.concat(F.lit("  ```json\n"), "full_text", F.lit("\n``` "))).alias("t")),
        r"SELECT doc_id, regexp_replace(regexp_replace(full_text, '^[\t-\r\x1c-\x20\x{85}\p{Z}]+', ''), '[\t-\r\x1c-\x20\x{85}\p{Z}]+$', '') AS t FROM docs",
    ),
    "s11_join_parts": (
        lambda f: f.docs.select("doc_id", S.join_parts(F.array(*(F.struct(c.alias("text")) for c in (F.lit(" "), F.col("filename"), F.lit(None).cast("string"), F.col("summary"))))).alias("t")),
        r"SELECT doc_id, regexp_replace(filename || '  ' || coalesce(summary, ''), '[\t-\r\x1c-\x20\x{85}\p{Z}]+$', '') AS t FROM docs",
    ),
    "s12_utc_iso": (
        lambda f: f.docs.select("doc_id", S.utc_iso(F.to_timestamp(F.concat(F.col("uploaded_at").cast("string"), F.lit("+00:00")))).alias("t")),
        "SELECT doc_id, strftime(uploaded_at, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS t FROM docs",
    ),
    "f1_render_all_prompts": (
        lambda f: _all_prompts(f),
        _all_prompts_sql(),
    ),
    "f2_map_responses": (
        lambda f: tasks.map_responses(f.docs.select("doc_id", F.concat(F.when(F.col("doc_id") % 7 == 0, "FAIL ").otherwise(""), "full_text").alias("prompt")), _sometimes, "doc_id"),
        "SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN md5(full_text) END AS raw, CASE WHEN doc_id % 7 = 0 THEN 'no answer' END AS error FROM docs",
    ),
    "f4_parse_comparison": (
        lambda f: tasks.parse_comparison(_comparisons(f)).select("doc_id", F.array_join("comparison.matching_points", ",").alias("matching_points"), F.size("comparison.missing_in_a").alias("n_a"), "comparison.overall_match_percent", "raw_response", "error"),
        "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN filename || ',x' ELSE '' END AS matching_points, CAST(0 AS INTEGER) AS n_a, CASE WHEN doc_id % 4 = 0 THEN doc_id % 100 + 0.5 ELSE 0.0 END::DOUBLE AS overall_match_percent, CASE WHEN doc_id % 4 = 1 THEN filename END AS raw_response, CASE WHEN doc_id % 4 = 2 THEN 'the answer is JSON, but not an object' END AS error FROM docs",
    ),
    "f4_parse_notes": (
        lambda f: tasks.parse_notes(_notes(f)).select("doc_id", "notes.summary", F.array_join(F.transform("notes.key_concepts", lambda c: F.concat_ws("=", c["concept"], c["explanation"])), ",").alias("concepts"), F.size("notes.mcqs").alias("n_mcqs"), "error"),
        "SELECT doc_id, full_text AS summary, coalesce(array_to_string(list_transform(range(doc_id % 4), lambda i: filename || '=' || i), ','), '') AS concepts, CAST(0 AS INTEGER) AS n_mcqs, CAST(NULL AS VARCHAR) AS error FROM docs",
    ),
    "f6_parse_cross": (
        lambda f: tasks.parse_cross(_crosses(f)).select("doc_id", F.array_join(F.transform("shared", lambda c: F.concat(c["concept"], F.lit(":"), F.size(c["found_in"]))), ",").alias("shared"), "error"),
        "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'two:2,one:1' WHEN doc_id % 3 = 1 THEN '' END AS shared, CASE WHEN doc_id % 3 = 1 THEN 'the answer is JSON, but not a list' WHEN doc_id % 3 = 2 THEN 'the answer is not JSON' END AS error FROM docs",
    ),
    "f7_summarize_documents": (
        lambda f: tasks.summarize_documents(_summarised(f), _json_digests).select("doc_id", "summary.executive_summary", "cached", "error"),
        "SELECT doc_id, CASE WHEN summary IS NOT NULL THEN summary ELSE md5('" + tasks.TEMPLATES["summary"][0] + "' || substr(full_text, 1, 12000)) END AS executive_summary, summary IS NOT NULL AS cached, CAST(NULL AS VARCHAR) AS error FROM docs",
    ),
    "f7_summarize_asked": (
        lambda f: tasks.summarize_documents(_summarised(f), _json_digests, [3, 4, -5, 4]).select("doc_id", "summary.executive_summary", "cached", "error"),
        "SELECT doc_id, CASE WHEN summary IS NOT NULL THEN summary ELSE md5('" + tasks.TEMPLATES["summary"][0] + "' || substr(full_text, 1, 12000)) END AS executive_summary, summary IS NOT NULL AS cached, CAST(NULL AS VARCHAR) AS error FROM docs WHERE doc_id IN (3, 4) UNION ALL SELECT -5, NULL, false, 'Document not found: -5'",
    ),
    "f7_store_summaries": (
        lambda f: tasks.store_summaries(_summarised(f), tasks.summarize_documents(_summarised(f), _json_digests)).select("doc_id", "summary.executive_summary"),
        "SELECT doc_id, CASE WHEN summary IS NOT NULL THEN summary ELSE md5('" + tasks.TEMPLATES["summary"][0] + "' || substr(full_text, 1, 12000)) END AS executive_summary FROM docs",
    ),
    "f8_compare_documents": (
        lambda f: tasks.compare_documents(f.pairs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")), f.docs, _digests).select("a", "b", "error", "raw_response"),
        "SELECT CAST(p.doc_id AS VARCHAR) AS a, CAST(p.doc_id + 1 AS VARCHAR) AS b, CASE WHEN d.doc_id IS NULL THEN 'Document not found: ' || (p.doc_id + 1) END AS error, md5('" + tasks.COMPARE[0] + "' || substr(p.full_text, 1, 8000) || '" + tasks.COMPARE[1] + "' || substr(d.full_text, 1, 8000)) AS raw_response FROM docs p LEFT JOIN docs d ON d.doc_id = p.doc_id + 1",
    ),
    "f9_suggest_questions": (
        lambda f: _sets(tasks.suggest_questions(f.docs, _line_digests), "questions"),
        "SELECT doc_id, md5('" + tasks.TEMPLATES["questions"][0] + "' || substr(full_text, 1, 8000)) AS questions, CAST(NULL AS VARCHAR) AS error FROM docs",
    ),
    "f9_study_notes": (
        lambda f: tasks.study_notes(f.docs, _note_digests).select("doc_id", "filename", "summary", F.col("counts.viva_questions").alias("n_viva"), "error"),
        "SELECT doc_id, filename, md5('" + tasks.TEMPLATES["notes"][0] + "' || substr(full_text, 1, 12000)) AS summary, CAST(1 AS INTEGER) AS n_viva, CAST(NULL AS VARCHAR) AS error FROM docs",
    ),
    "f10_cross_document": (
        lambda f: tasks.cross_document(f.docs, None, _cross_digests).select("document_count", F.array_join(F.transform("shared", lambda c: c["concept"]), ",").alias("shared"), F.size("per_document_concepts").alias("n_files"), F.array_join(F.array_sort(F.transform(F.map_entries("per_document_concepts"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+")))), ",").alias("per_document"), "error"),
        "WITH_MORE own AS (SELECT filename, doc_id, md5('" + tasks.TEMPLATES["concepts"][0] + "' || substr(full_text, 1, 6000)) AS c FROM docs), per AS (SELECT filename, min(doc_id) AS p, max_by(c, doc_id) AS c FROM own GROUP BY 1) SELECT (SELECT count(*) FROM own) AS document_count, (SELECT md5('" + tasks.TEMPLATES["cross"][0] + "' || string_agg('Document: ' || filename || chr(10) || 'Concepts: ' || c, chr(10) || chr(10) ORDER BY p, filename)) FROM per) AS shared, CAST((SELECT count(*) FROM per) AS INTEGER) AS n_files, (SELECT string_agg(filename || '=' || c, ',' ORDER BY filename || '=' || c) FROM per) AS per_document, CAST(NULL AS VARCHAR) AS error",
    ),
    "q1_own_vectors": (
        lambda f: _retrieve(_own_vectors(f)).select("qid", "chunks_retrieved", "chunks_before_dedup", "success", "items"),
        "WITH_MORE "
        + _chunked_sql()
        + r""", texts AS (SELECT doc_id, pos, content FROM cut UNION ALL SELECT doc_id, -1, full_text FROM docs WHERE doc_id % 50 = 0),
own_terms AS (SELECT doc_id, pos, unnest(list_filter(regexp_split_to_array(lower(content), '[^\p{L}]+'), lambda x: length(x) > 3)) AS term FROM texts),
counted AS (SELECT doc_id, pos, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS dim, count(*) AS n FROM own_terms GROUP BY ALL),
norms AS (SELECT doc_id, pos, greatest(sqrt(sum(n * n)::DOUBLE), 1e-9) AS norm FROM counted GROUP BY ALL),
vecs AS (SELECT t.doc_id, t.pos, list(CAST(CAST(coalesce(c.n / norm, 0) AS FLOAT) AS DOUBLE) ORDER BY i) AS v FROM texts t CROSS JOIN range(64) r(i) LEFT JOIN norms USING (doc_id, pos) LEFT JOIN counted c ON c.doc_id = t.doc_id AND c.pos = t.pos AND c.dim = i GROUP BY ALL),
own_scored AS (SELECT q.doc_id AS qid, c.doc_id, c.pos, c.doc_id || '#' || c.pos AS chunk_id, list_sum(list_transform(list_zip(q.v, c.v), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS distance FROM vecs q JOIN vecs c ON q.pos = -1 AND c.pos >= 0),
own_ranked AS (SELECT * FROM own_scored QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(distance, 12), chunk_id) <= 8),
own_cands AS (SELECT r.*, d.filename, cut.content, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 12), chunk_id) AS rank, CASE WHEN contains(lower(q.full_text), 'tion') THEN 'tion' WHEN contains(lower(q.full_text), 'the') THEN 'the' WHEN contains(lower(q.full_text), 'que') THEN 'que' END AS section
  FROM own_ranked r JOIN cut ON cut.doc_id = r.doc_id AND cut.pos = r.pos JOIN docs d ON d.doc_id = r.doc_id JOIN docs q ON q.doc_id = qid),
own_inside AS (SELECT *, coalesce(contains(lower(content), section), true) AS inside FROM own_cands),
own_left AS (SELECT * FROM (SELECT *, bool_or(inside) OVER (PARTITION BY qid) AS any_inside FROM own_inside) WHERE inside OR NOT any_inside),
own_first AS (SELECT *, row_number() OVER (PARTITION BY qid, content ORDER BY rank) AS nth FROM own_left),
own_kept AS (SELECT * FROM own_first WHERE nth = 1 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) <= 4)
SELECT qid, CAST(any_value(k) AS INTEGER) AS chunks_retrieved, CAST(any_value(b) AS INTEGER) AS chunks_before_dedup, true AS success, any_value(items) AS items
FROM (SELECT qid, count(*) AS k, string_agg(filename || '|' || printf('%.1f', round_even(greatest(0, least(1, 1 - distance / 2)) * 100, 1)) || '|-|' || sha256(content), ';' ORDER BY rank) AS items FROM own_kept GROUP BY 1) JOIN (SELECT qid, count(*) AS b FROM own_left GROUP BY 1) USING (qid) GROUP BY 1""",
    ),
    "q2_answer_questions": (
        lambda f: tasks.answer_questions(f.questions, f.chunks, _answering, F.expr("timestamp'2024-04-01 00:00:00'"))[0].select("qid", "query", "answer", "success", "error", F.size("context").alias("n_context"), "chunks_retrieved"),
        "WITH_MORE plain AS (SELECT r.qid, r.rank, c.source, c.content FROM ranked r JOIN chunks c USING (chunk_id) WHERE rank <= 8), pk AS (SELECT *, regexp_replace(regexp_replace(content, '^[\\t-\\r\\x1c-\\x20\\x{85}\\p{Z}]+', ''), '[\\t-\\r\\x1c-\\x20\\x{85}\\p{Z}]+$', '') AS kk FROM plain), pf AS (SELECT * FROM pk QUALIFY row_number() OVER (PARTITION BY qid, kk ORDER BY rank) = 1), pn AS (SELECT * FROM pf QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) <= 4), packed AS (SELECT qid, count(*) AS n, string_agg('Source: ' || source || chr(10) || content, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM pn GROUP BY 1), asked_now AS (SELECT q.qid, q.question, n, '" + tasks.ANSWER[0] + "' || context || '" + tasks.ANSWER[1] + "' || q.question || '" + tasks.ANSWER[2] + "' AS prompt FROM questions q JOIN packed USING (qid)), told AS (SELECT *, substr(md5(prompt), 1, 1) < '8' AS ok FROM asked_now) SELECT qid, question AS query, CASE WHEN ok THEN md5(prompt) ELSE 'Error processing query: no answer' END AS answer, ok AS success, CASE WHEN NOT ok THEN 'no answer' END AS error, CASE WHEN ok THEN CAST(n AS INTEGER) END AS n_context, CASE WHEN ok THEN CAST(n AS INTEGER) END AS chunks_retrieved FROM told",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, rows=rows: rows(fixtures(spark, sf_dir))) for name, (rows, _) in TABLE.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (_, sql) in TABLE.items():
        if sql:
            out[name] = f"WITH RECURSIVE {FIXTURES.strip()}, {sql.removeprefix('WITH_MORE ')}" if sql.startswith("WITH_MORE") else f"WITH {FIXTURES.strip()} {sql}"
    return out
