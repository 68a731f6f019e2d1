import json
import os

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from doclake.functions import scalars as S
from doclake.operators import neighbours as N
from doclake.operators import retrieval as R
from doclake.operators import stores as K
from doclake.operators import text as X
from doclake.operators.text import split_text
from doclake.plans import queries as plans
from doclake.plans import tasks
from doclake.sources import files
from doclake.streaming import jobs

DATA = "/root/testdata/sf0.001"


def now():
    return F.lit("2024-01-05 00:00:00").cast("timestamp")



@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = plans.queries()[name](spark, DATA)
    found = duck.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in sorted(columns)]
    expected = sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(sorted(df.columns)).collect()) == expected


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], [*values]) if values else spark.range(1)
    return row.select(expr.alias("x")).first().x


@pytest.mark.parametrize("text,size,overlap,pieces", [
    ("aa bb cc dd ee", 6, 3, ["aa bb", "bb cc", "cc dd", "dd ee"]),
    ("abcdefghijklmno", 6, 2, ["abcdef", "efghij", "ijklmn", "mno"]),
    ("p one\n\np two long\nline", 8, 2, ["p one", "p two", "long", "line"]),
    ("short", 10, 2, ["short"]), ("", 10, 2, []), (" \n ", 10, 2, []),
])
def test_chunks(text, size, overlap, pieces):
    assert split_text(text, size, overlap) == pieces


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=80), st.integers(4, 12))
def test_chunks_are_short_and_not_empty(text, size):
    pieces = split_text(text, size, size // 4)
    assert all(0 < len(p) <= size for p in pieces)
    assert {*"".join(pieces)} >= {c for c in text if not c.isspace()}


def test_scalars(spark):
    assert one(spark, S.detect_section(F.lit("What are the RESULTS and conclusion?"))) == "conclusion"
    assert one(spark, S.detect_section(F.lit("Show the result"))) is None
    assert [one(spark, S.confidence(F.lit(float(d)))) for d in (0, 0.5, 2, 3, -1)] == [100.0, 75.0, 0.0, 0.0, 100.0]
    assert one(spark, S.clean_source(F.lit("/a/b/c.pdf"))) == "c.pdf"
    assert one(spark, S.clean_source(F.lit(None).cast("string"))) == "Unknown"
    assert one(spark, S.snippet(F.lit("x" * 201))) == "x" * 200 + "…"
    assert one(spark, S.snippet(F.lit("x" * 200))) == "x" * 200
    assert one(spark, S.file_extension(F.lit("/a/B.TXT"))) == ".txt"
    assert one(spark, S.strip_fences(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, S.join_parts(F.expr("array(named_struct('text', 'a'), named_struct('text', 'b'))"))) == "a b"
    assert one(spark, S.utc_iso(now())) == "2024-01-05T00:00:00.000000+00:00"
    with pytest.raises(ValueError):
        R.oversample(0)


def test_admission(spark):
    rows = [("/a.PDF", 52_428_800), ("/b.PDF", 52_428_801), ("/c.xyz", 1)]
    good, bad = files.admit_files(spark.createDataFrame(rows, "path string, length long"))
    assert [r.path for r in good.collect()] == ["/a.PDF"]
    assert {r.path: r.reason for r in bad.collect()} == {"/b.PDF": "size", "/c.xyz": "type"}


def test_dedup_and_trace(spark):
    q = spark.createDataFrame([(1, "q"), (2, "r")], "qid long, question string")
    hits = spark.createDataFrame([(1, i, i + 1, 0.1 * i, f"text {i}", None) for i in range(8)] + [(2, i, i + 1, 0.1 * i, f" text {i % 2} ", "s") for i in range(8)], "qid long, chunk_id long, rank int, distance double, content string, source string")
    kept = R.dedup_hits(hits, 4)
    trace = {r.qid: r for r in R.retrieval_trace(q, hits, kept).collect()}
    assert (trace[1].chunks_retrieved, trace[1].duplicates_removed, trace[1].exact_duplicates) == (4, 4, 0)
    assert (trace[2].chunks_retrieved, trace[2].exact_duplicates) == (2, 6)
    assert R.context_pack(kept).where("qid = 1").first().context.startswith("Source: Unknown\ntext 0")
    sections = spark.createDataFrame([(1, "absent"), (2, None)], "qid long, section string")
    assert R.filter_section(hits, sections).count() == 16


def test_selection(spark):
    docs = spark.createDataFrame([("a", "f", "t"), ("b", "f", "t")], "doc_id string, filename string, full_text string").withColumn("uploaded_at", now())
    assert [r.doc_id for r in K.select_documents(docs, ["b", "x", "b"]).collect()] == ["b", "b"]
    with pytest.raises(ValueError):
        K.select_documents(docs, ["a"])
    empty = spark.createDataFrame([], "collection_id string, name string, created_at timestamp")
    assert K.default_collection(empty, now()).first().name == "General"


def test_parsers(spark):
    raw = lambda *x: spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id int, raw string")
    s = tasks.parse_summary(raw("not json", '{"executive_summary": "e", "key_topics": null}')).orderBy("id").collect()
    assert s[0].summary.executive_summary == "not json" and s[0].summary.key_topics == []
    assert s[1].summary.executive_summary == "e" and s[1].summary.key_topics == []
    assert tasks.parse_questions(raw("- a\n\n• b\n---")).first().questions == ["a", "b", ""]
    assert tasks.parse_questions(raw('["1","2","3","4","5","6"]')).first().questions == ["1", "2", "3", "4", "5"]
    assert tasks.parse_concepts(raw("oops")).first().concepts == []
    assert tasks.parse_comparison(raw("oops")).first().raw_response == "oops"
    assert tasks.parse_notes(raw("oops")).first().error
    n = tasks.notes_counts(tasks.parse_notes(raw('{"flashcards": [{"front": "f", "back": "b"}]}'))).first().counts
    assert (n.flashcards, n.mcqs) == (1, 0)
    x = tasks.parse_cross(raw('[{"concept": "a", "found_in": ["1"]}, {"concept": "b", "found_in": ["1", "2"]}]')).first()
    assert [c.concept for c in x.shared] == ["b", "a"]


def make_respond():
    def respond(prompts):
        if any("FAIL" in p for p in prompts):
            raise RuntimeError("no")
        return ['["alpha", "beta"]' if "concepts of" in p else '[{"concept": "alpha", "found_in": ["f"]}]' if "share" in p else "{}" for p in prompts]

    return respond


respond = make_respond()


def test_model_tasks(spark):
    docs = spark.createDataFrame([("a", "f", "one", None), ("b", "g", "two FAIL", None), ("c", "h", "three", "kept")], "doc_id string, filename string, full_text string, s string")
    docs = docs.withColumn("uploaded_at", now()).withColumn("summary", F.when(F.col("s").isNotNull(), F.from_json(F.lit('{"executive_summary":"kept"}'), tasks.schemas.SUMMARY))).drop("s")
    got = {r.doc_id: r for r in tasks.map_responses(docs.select("doc_id", F.col("full_text").alias("prompt")), respond, "doc_id").collect()}
    assert got["b"].error == "no" and got["a"].raw == "{}"
    done = {r.doc_id: r.cached for r in tasks.summarize_documents(docs, respond).collect()}
    assert done == {"a": False, "b": False, "c": True}
    row = tasks.cross_document(docs, ["a", "c"], respond).first()
    assert row.document_count == 2 and row.shared[0].concept == "alpha" and row.per_document_concepts["f"] == ["alpha", "beta"]
    pairs = spark.createDataFrame([("a", "c"), ("a", "zz")], "a string, b string")
    compared = {r.b: r for r in tasks.compare_documents(pairs, docs, respond).collect()}
    assert compared["c"].comparison.overall_match_percent == 0 and "zz" in compared["zz"].error


def test_answers(spark):
    f = plans.fixtures(spark, DATA)
    answers, history = tasks.answer_questions(f.questions, f.chunks, respond, now())
    assert {r.success for r in answers.collect()} == {True} and history.count() == f.questions.count() > 0


def test_files_and_stores(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes("é one\r\ntwo".encode())
    (tmp_path / "in/b.md").write_bytes(b"\xff\xfe")
    pages, bad = files.load_text(spark, str(tmp_path / "in"))
    assert [r.text for r in pages.collect()] == ["é one\ntwo"] and bad.count() == 1
    assert files.load_with(spark, str(tmp_path / "in"), lambda b: [(0, "x"), (1, "y")]).count() == 4
    (tmp_path / "documents.json").write_text(json.dumps({"d": {"doc_id": "d", "filename": "f"}}))
    assert files.read_store(spark, str(tmp_path / "documents.json"), "documents").first().filename == "f"
    (tmp_path / "bad.json").write_text("{oops")
    with pytest.raises(Exception):
        files.read_store(spark, str(tmp_path / "bad.json"), "documents").collect()
    h = spark.createDataFrame([("1", None, "q", "a", [])], files.schemas.HISTORY)
    files.append_rows(h, str(tmp_path / "h"))
    files.append_rows(h, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2
    files.clear_history(spark, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 0
    files.export_store(h, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_streams(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    (tmp_path / "in/a.txt").write_text("some words here")
    (tmp_path / "in/b.xyz").write_text("no")
    collections = spark.createDataFrame([("c", "General")], "collection_id string, name string").withColumn("created_at", now())
    for text in (None, "more words"):
        if text:
            (tmp_path / "in/c.md").write_text(text)
        jobs.stream_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), collections).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/documents")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out/rejects")).count() == 1
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    stream = spark.readStream.schema(events).parquet("/root/testdata/sf0.001/events.parquet*")
    query = jobs.stream_queries_per_day(stream.select(F.col("ts").cast("timestamp").alias("timestamp"))).writeStream.format("memory").queryName("days").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("days").groupBy("day").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] == 1000


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_approximate_neighbours(spark, sf):
    f = plans.fixtures(spark, f"/root/testdata/sf{sf}")
    exact = {(r.qid, r.chunk_id) for r in R.knn(f.questions, f.chunks, 4).collect()}
    near = {(r.qid, r.chunk_id) for r in plans.queries()["j5_knn_approx"](spark, f"/root/testdata/sf{sf}").collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_wrong_answers_are_reported(spark):
    raw = lambda *x: spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id int, raw string")
    got = tasks.parse_summary(raw("[1, 2]", '"x"', None, "null", "words")).orderBy("id").collect()
    assert [r.error is not None for r in got] == [True, True, False, False, False]
    assert got[0].summary is None and got[2].summary is None and got[3].summary.executive_summary == "" and got[4].summary.executive_summary == "words"
    assert tasks.parse_notes(raw("[]")).first().error and tasks.parse_comparison(raw("[]")).first().error and tasks.parse_cross(raw("{}")).first().error


def test_failed_answers_have_no_trace(spark):
    f = plans.fixtures(spark, DATA)

    def fails(prompts):
        raise RuntimeError("down")

    answers, history = tasks.answer_questions(f.questions, f.chunks, fails, now())
    row = answers.first()
    assert row.answer == "Error processing query: down" and not row.success and row.chunks_retrieved is None and row.scores is None and row.context is None and history.count() == 0


def test_missing_store_is_empty(spark, tmp_path):
    for kind in ("documents", "collections", "history"):
        assert files.read_store(spark, str(tmp_path / "none.json"), kind).count() == 0
    assert "doc_ids" in files.read_store(spark, str(tmp_path / "none.json"), "collections").columns


def test_streams_read_pages_with_extract(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    (tmp_path / "in/a.pdf").write_bytes(b"one|two")
    (tmp_path / "in/b.txt").write_text("words")
    collections = spark.createDataFrame([("c", "General")], "collection_id string, name string").withColumn("created_at", now())
    pages = lambda content: list(enumerate(content.decode().split("|")))
    jobs.stream_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), collections, pages).awaitTermination(120)
    assert {r.full_text for r in spark.read.parquet(str(tmp_path / "out/documents")).collect()} == {"one\n\ntwo", "words"}
    assert [r.position for r in spark.read.parquet(str(tmp_path / "out/members")).orderBy("position").collect()] == [0, 1]
    assert spark.read.parquet(str(tmp_path / "out/rejects")).count() == 0


def test_retrieval_over_own_vectors(spark):
    rows = plans.queries()["q1_own_vectors"](spark, DATA).collect()
    assert rows and all(r.success and 0 < r.chunks_retrieved <= 4 and r.chunks_before_dedup <= 8 for r in rows)


def test_numbers_of_a_group_come_from_many_tasks(spark):
    """A million new members of one collection beside a small one; no task sorts all of them."""
    n = 1_000_000
    new = spark.range(n).select(F.lit("hot").alias("collection_id"), F.col("id").cast("string").alias("doc_id"), (F.lit(n) - F.col("id")).alias("position"))
    new = new.union(spark.createDataFrame([("small", "b", 2), ("small", "a", 2), ("small", "z", 1), ("small", "z", 9), ("gone", "a", 1), (None, "a", 1), ("small", None, 1)], "collection_id string, doc_id string, position long")).repartition(5)
    members = spark.createDataFrame([("small", "y", 7), ("small", "b", 3)], new.schema)
    collections = spark.createDataFrame([("hot",), ("small",)], "collection_id string")
    conf = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(conf, "2m")
    try:
        got = K.new_members(members, new, collections).persist()
        hot = got.where("collection_id = 'hot'")
        assert hot.where("position <> 999999 - cast(doc_id as long)").count() == 0 and hot.count() == n
        assert [tuple(r) for r in got.where("collection_id = 'small'").orderBy("position").collect()] == [("small", "z", 8), ("small", "a", 9)]
        shares = [r["count"] for r in K._ranges(new, "collection_id", "position", "doc_id").where("collection_id = 'hot'").groupBy("_range").count().collect()]
        assert len(shares) > 2 and max(shares) < n / 2
    finally:
        spark.conf.unset(conf)


def test_stream_positions_go_on_over_batches(spark, tmp_path):
    where = {k: str(tmp_path / k) for k in ("in", "out", "cp")}
    os.makedirs(where["in"])
    collections = spark.createDataFrame([("c", "General")], "collection_id string, name string").withColumn("created_at", now())
    told = []
    for i, names in enumerate((("a", "b"), ("c",), ("d", "e", "f"))):
        for name in names:
            with open(f"{where['in']}/{name}.txt", "w") as file:
                file.write(f"words of {name}")
        jobs.stream_ingest(spark, where["in"], where["out"], where["cp"], collections).awaitTermination(120)
        rows = spark.read.parquet(f"{where['out']}/members").collect()
        told.append({r.doc_id: r.position for r in rows})
        assert sorted(r.position for r in rows) == list(range(len(rows))) and {r.batch_id for r in rows} == set(range(i + 1))
    assert told[0].items() <= told[1].items() <= told[2].items()  # nobody moves
    # The last batch runs again, as after a crash between its writing and its commit.
    for name in os.listdir(f"{where['cp']}/commits"):
        if name.strip(".").split(".")[0] == "2":
            os.remove(f"{where['cp']}/commits/{name}")
    jobs.stream_ingest(spark, where["in"], where["out"], where["cp"], collections).awaitTermination(120)
    again = {r.doc_id: r.position for r in spark.read.parquet(f"{where['out']}/members").collect()}
    assert again == told[2] and spark.read.parquet(f"{where['out']}/documents").count() == 6
    # Many small batches in one run, into a collection that has to be made.
    jobs.stream_ingest(spark, where["in"], str(tmp_path / "out2"), str(tmp_path / "cp2"), collections.limit(0), files_per_batch=2).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out2/members")).collect()
    assert sorted(r.position for r in rows) == list(range(6)) and len({r.collection_id for r in rows}) == 1 and len({r.batch_id for r in rows}) == 3


def test_late_rows_are_dropped_and_replays_count_once(spark, tmp_path):
    source = str(tmp_path / "events")
    days = [("2024-01-05 10:00:00", 2), ("2024-01-09 10:00:00", 3), ("2024-01-05 11:00:00", 4), ("2024-01-09 11:00:00", 1)]
    shape = "timestamp timestamp"

    def run():
        stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(source)
        jobs.stream_daily_counts(stream, str(tmp_path / "days"), str(tmp_path / "cp")).awaitTermination(120)
        return {str(r.day): r.n for r in jobs.daily_counts(spark, str(tmp_path / "days")).collect()}

    for i, (at, n) in enumerate(days):
        spark.range(n).select(F.lit(at).cast("timestamp").alias("timestamp")).coalesce(1).write.mode("append").parquet(source)
        got = run()
        assert got == {"2024-01-05": 2} | ({"2024-01-09": 3} if i else {}) | ({"2024-01-09": 4} if i == 3 else {})  # four rows of the fifth come too late
    assert run() == {"2024-01-05": 2, "2024-01-09": 4}


def counting(path):
    def respond(prompts):
        with open(path, "a") as log:
            log.write("".join(f"{p}\n" for p in prompts))
        if any("FAIL" in p for p in prompts):
            raise RuntimeError("no")
        return [p.upper() for p in prompts]

    return respond


def test_each_prompt_is_asked_once(spark, tmp_path):
    log, kept = str(tmp_path / "log"), str(tmp_path / "answers")
    rows = [(i, f"prompt {i % 40}") for i in range(300)] + [(900, None), (901, "")]
    prompts = spark.createDataFrame(rows, "id int, prompt string").repartition(5)
    asked = lambda: sorted(open(log).read().split("\n")[:-1])  # noqa: E731, SIM115
    for wave in (7, 50_000):
        got = tasks.map_responses(prompts, counting(log), "id", answers=kept, wave=wave)
        for _ in range(2):  # read twice
            assert {r.id: r.raw for r in got.collect()} == {i: None if p is None else p.upper() for i, p in rows}
            assert {r.id for r in got.where("error is not null").collect()} == {900}
        assert asked() == sorted({p for _, p in rows if p is not None})
    # More prompts: only the new ones; one that failed is asked again by the next call.
    more = prompts.union(spark.createDataFrame([(1000, "new"), (1001, "FAIL")], prompts.schema))
    before = len(asked())
    got = {r.id: (r.raw, r.error) for r in tasks.map_responses(more, counting(log), "id", answers=kept).collect()}
    assert got[1000] == ("NEW", None) and got[1001] == (None, "no") and set(asked()[:]) >= {"new", "FAIL"}
    assert all(p in ("new", "FAIL") for p in open(log).read().split("\n")[before:-1])  # noqa: SIM115
    cured = lambda ps: [p.lower() for p in ps]
    got = {r.id: (r.raw, r.error) for r in tasks.map_responses(more, cured, "id", answers=kept).collect()}
    assert got[1001] == ("fail", None) and got[1000] == ("NEW", None) and got[3] == ("PROMPT 3", None)
    assert tasks.map_responses(prompts.limit(0), cured, "id").count() == 0


def test_summaries_are_asked_once_through_store(spark, tmp_path):
    log = str(tmp_path / "log")
    docs = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "one")], "doc_id string, full_text string").withColumn("summary", F.lit(None).cast(tasks.schemas.SUMMARY))
    fresh = tasks.summarize_documents(docs, counting(log))
    held = tasks.store_summaries(docs, fresh)
    assert {r.summary.executive_summary[:9] for r in held.collect()} == {"SUMMARISE"} and fresh.where("cached").count() == 0
    assert sum(line.startswith("Summarise") for line in open(log)) == 2  # noqa: SIM115


def test_shared_concepts_as_rows_and_examples(spark):
    rows = [(f"f{i:02d}", "all") for i in range(30)] * 2 + [("a", "two"), ("b", "two"), ("a", "one"), (None, "all"), ("a", None)]
    concepts = spark.createDataFrame(rows, "filename string, concept string")
    files = X.concept_files(concepts)
    assert files.count() == 32 and {(r.concept, r.n) for r in files.collect()} == {("all", 30), ("two", 2)}
    few = X.shared_concepts(concepts, 3).collect()
    assert [(r.concept, r.found_in, r.n) for r in few] == [("all", ["f00", "f01", "f02"], 30), ("two", ["a", "b"], 2)]
    assert [len(r.found_in) for r in X.shared_concepts(concepts).collect()] == [30, 2]


def test_collection_rows(spark):
    docs = spark.createDataFrame([("a", "f", "t"), ("b", "g", "t")], "doc_id string, filename string, full_text string")
    members = spark.createDataFrame([("c", "b", 0), ("c", "zz", 1), ("c", "a", 2)], "collection_id string, doc_id string, position long")
    collections = spark.createDataFrame([("c", "n"), ("e", "n")], "collection_id string, name string")
    assert [(r.position, r.document.doc_id) for r in K.collection_members(collections, members, docs).orderBy("position").collect()] == [(0, "b"), (2, "a")]
    got = {r.collection_id: [d.doc_id for d in r.documents] for r in K.collection_documents(collections, members, docs).collect()}
    assert got == {"c": ["b", "a"], "e": []}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_utc_text_in_any_session(spark, zone):
    kept = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        at = {"2024-01-05T00:00:00.000000+00:00": 1704412800000000, "2024-11-03T05:30:00.000001+00:00": 1730611800000001, "2024-11-03T06:30:00.999999+00:00": 1730615400999999, "1969-12-31T23:59:59.500000+00:00": -500000, "2024-03-10T07:30:00.000000+00:00": 1710055800000000}
        rows = spark.createDataFrame(list(at.items()), "wanted string, micros long").select("wanted", S.utc_iso(F.timestamp_micros("micros")).alias("t"))
        assert all(r.wanted == r.t for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)


def test_frequent_terms_beyond_those_that_are_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(["common", "other", f"word{'x' * (i % 7)}", "letters" * 20])) for i in range(60)] + [(60, None)], "doc_id long, full_text string")
    wanted = sorted(map(tuple, X.top_concepts(docs).collect()))
    monkeypatch.setattr(X, "OFTEN", 1)
    assert sorted(map(tuple, X.top_concepts(docs).collect())) == wanted and len(wanted) == 240
