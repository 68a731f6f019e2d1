"""Language-model scores: prediction by partial matching over bytes.

Training documents give a trie of byte contexts up to three bytes long.  At
each context, a symbol seen there gets count / (total + distinct); the rest of
the probability escapes to the next shorter context, where symbols already
seen in the longer ones are excluded, and at last to all other bytes alike.
The counts of contexts up to two bytes are broadcast; there are 65,793 of them
at most, so counts and code lengths are bounded by 135 MB whatever the corpus.
All three-byte contexts stay in a table that grows with the corpus: each chunk
of documents asks once for each of its contexts, with the symbols it needs.

Beside it, each document gets the smoothed unigram score of its words.  Word
counts are asked for once per chunk of documents and distinct word, so no
vocabulary is broadcast or collected.  The ``FREQUENT`` words of most documents
in a bounded sample, and the end token, are in nearly all chunks: each task adds
them up and sends one row a word, salted by task, and their totals, of bounded
number, come back to all chunks as one list.

Nulls: a null text is the empty text (one token, the end; model score 0).  A
null id counts as the empty id.  Repeated rows count and score separately.  Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclake.llm import common

#: Documents in which frequent words are sought, how many words are taken at most, and parts of their sums.
SAMPLE, FREQUENT, SALTS = 10_000, 16_384, 64


def held_out(key: int | None, parts: int = 5, part: int = 1) -> bool:
    return zlib.crc32(b"" if key is None else str(key).encode()) % parts == part


def _codes(text: bytes) -> np.ndarray:
    """Each byte with the three before it (zeros before the text) as one number."""
    a = np.frombuffer(b"\0\0\0" + text, dtype=np.uint8).astype(np.uint32)
    return a[:-3] << 24 | a[1:-2] << 16 | a[2:-1] << 8 | a[3:]


def byte_grams(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(context, symbol, n) over the training documents; contexts are three bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for ids, texts in common.text_groups(batches):
            codes = [_codes(t) for i, t in zip(ids, texts, strict=True) if not held_out(i)]
            if codes:
                held = common.distinct_sums(np.concatenate(codes), held)
        if held is not None:
            yield pa.record_batch({"context": (held[0] >> 8).astype(np.int32), "symbol": (held[0] & 255).astype(np.int32), "n": held[1]})

    rows = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(count, "context int, symbol int, n long")
    return rows.groupBy("context", "symbol").agg(F.sum("n").alias("n"))


def symbol_rows(contexts: np.ndarray, own: np.ndarray, shorter: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Log10 probabilities of all bytes (contexts x 256), from their counts and those of the shorter contexts.

    ``shorter[k]`` has the sorted contexts of k bytes and their counts.
    """
    left = np.ones(len(contexts))
    free = np.ones((len(contexts), 256), dtype=bool)
    p = np.zeros((len(contexts), 256))
    for k in range(len(shorter), -1, -1):
        n = own if k == len(shorter) else shorter[k][1][np.searchsorted(shorter[k][0], contexts & ((1 << 8 * k) - 1))]
        c = n * free
        total, distinct = c.sum(1), (c > 0).sum(1)
        p += (left / np.maximum(total + distinct, 1))[:, None] * c
        left = left * np.where(distinct > 0, distinct / np.maximum(total + distinct, 1), 1)
        free &= c == 0
    p += (left / np.maximum(free.sum(1), 1))[:, None] * free
    return np.log10(np.maximum(p, 1e-30)).astype(np.float32)


def code_rows(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    """The contexts of each length, and the rows of them all, order 0 first."""
    rows = []
    for k, (contexts, own) in enumerate(counts):
        for at in range(0, len(contexts), 2048):
            rows.append(symbol_rows(contexts[at : at + 2048], own[at : at + 2048], counts[:k]))
    return [c for c, _ in counts], np.concatenate(rows)


def _short_contexts(grams: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Contexts of no, one and two bytes with their counts."""
    counts = []
    for k in range(3):
        own = grams.groupBy(F.col("context").bitwiseAND((1 << 8 * k) - 1).alias("context"), "symbol").agg(F.sum("n").alias("n"))
        found = own.toArrow()  # 65,536 contexts x 256 symbols at most
        context, at = np.unique(found["context"].to_numpy().astype(np.int64), return_inverse=True)
        n = np.zeros((len(context), 256), dtype=np.float32)
        n[at, found["symbol"].to_numpy()] = found["n"].to_numpy()
        if k == 0 and not len(context):
            context, n = np.zeros(1, np.int64), np.zeros((1, 256), np.float32)
        counts.append((context, n))
    return counts


def _row_of(contexts: list[np.ndarray]) -> np.ndarray:
    """For each two bytes, the row of the longest context known."""
    first = np.cumsum([0, *map(len, contexts)])
    one = np.zeros(1 << 8, dtype=np.int32)
    one[contexts[1]] = first[1] + np.arange(len(contexts[1]))
    two = np.tile(one, 256)
    two[contexts[2]] = first[2] + np.arange(len(contexts[2]))
    return two


def _long_contexts(grams: DataFrame, chunks: DataFrame, shorter: Broadcast) -> DataFrame:
    """(chunk, codes): for each chunk, (context, symbols, log10 probabilities) of its known three-byte contexts.

    A context is asked for at most once a chunk.  As most chunks ask for the same
    thousands of contexts, no one of them has more than its share of the rows.
    """

    @F.arrow_udf("array<float>")
    def lengths(contexts: pa.Array, found: pa.Array) -> pa.Array:
        pairs, size = found.flatten(), found.value_lengths().to_numpy()
        n = np.zeros((len(contexts), 256), dtype=np.float32)
        n[np.repeat(np.arange(len(contexts)), size), pairs.field(0).to_numpy()] = pairs.field(1).to_numpy()
        rows = symbol_rows(contexts.to_numpy().astype(np.int64), n, shorter.value[0])
        return pa.ListArray.from_arrays(np.arange(len(contexts) + 1, dtype=np.int32) * 256, rows.ravel())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = np.unique(np.concatenate([np.unique(_codes(t)) for t in common.unpack(blob)[1]]))
                context, first = np.unique(codes >> 8, return_index=True)
                symbols = pa.ListArray.from_arrays(np.append(first, len(codes)).astype(np.int32), (codes & 255).astype(np.int16))
                yield pa.record_batch({"context": context.astype(np.int32), "chunk": np.full(len(context), chunk), "symbols": symbols})

    known = grams.groupBy("context").agg(F.collect_list(F.struct("symbol", "n")).alias("found")).select("context", lengths("context", "found").alias("row"))
    asked = chunks.mapInArrow(ask, "context int, chunk long, symbols array<smallint>")
    # The table of contexts has no bound that would allow a broadcast.
    told = asked.join(known.hint("merge"), "context").select("chunk", F.struct("context", "symbols", F.transform("symbols", lambda s: F.get("row", s)).alias("p")).alias("code"))
    return told.groupBy("chunk").agg(F.collect_list("code").alias("codes"))


def _told(found: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes (context and symbol) of a chunk's answer, and their log10 probabilities."""
    if not found.is_valid or not len(found.values):
        return np.zeros(1, np.uint32), np.full(1, np.nan, np.float32)
    context, symbols, p = found.values.flatten()
    codes = np.repeat(context.to_numpy().astype(np.uint32) << 8, symbols.value_lengths().to_numpy()) | symbols.flatten().to_numpy().astype(np.uint32)
    order = np.argsort(codes)
    return codes[order], p.flatten().to_numpy()[order]


def _distinct(ids: list, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct lower-cased words of a chunk, their place for each word, where documents begin, and training counts."""
    data, at = common.joined(texts)
    start, _, words = common.hash_words(data, lower=True)
    first = np.searchsorted(start, at)
    distinct, _, back = common.numbered(words)
    train = np.repeat([not held_out(i) for i in ids], np.diff(first)) if ids else np.zeros(0, bool)
    return distinct, back, first, np.bincount(back[train], minlength=len(distinct))


def _frequent(docs: DataFrame, key: str, text: str) -> np.ndarray:
    """Sorted hashes of the words that most documents of a bounded sample have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for ids, texts in common.text_groups(batches):
            distinct, back, first, _ = _distinct(ids, texts)
            owner = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(first))
            pairs = np.unique(owner * len(distinct) + back) % max(1, len(distinct))
            held = common.distinct_sums(distinct[pairs], held)
        if held is not None:
            some = held[1] >= 3
            yield pa.record_batch({"h": held[0][some].view(np.int64), "n": held[1][some]})

    some = common.thinned(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where(F.octet_length("t") < 1 << 20), "k", SAMPLE).limit(SAMPLE)
    found = some.repartition(1).mapInArrow(count, "h long, n long").orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    return np.sort(found["h"].to_numpy().view(np.uint64))


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in sorted keys the wanted ones are, and which of them are there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of all documents."""
    grams = common.checkpointed(byte_grams(docs, key, text))
    counts = _short_contexts(grams)
    context = docs.sparkSession.sparkContext
    trie, frequent = context.broadcast((counts, code_rows(counts))), context.broadcast(_frequent(docs, key, text))
    chunks = common.to_chunks(docs, key, text)
    long = _long_contexts(grams, chunks, trie)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each chunk its words; of all of a task's chunks together the frequent words (place -2) and ends (-1)."""
        from pyspark import TaskContext

        hot, sums, ends = frequent.value, np.zeros(len(frequent.value), dtype=np.int64), 0
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, texts = common.unpack(blob)
                distinct, _, _, n = _distinct(ids, texts)
                ends += sum(not held_out(i) for i in ids)
                at, there = _at(hot, distinct)
                sums[at[there]] += n[there]
                rest = np.flatnonzero(~there)
                yield _asked(distinct[rest], rest, chunk, n[rest], 0)
        salt = TaskContext.get().partitionId() % SALTS
        seen = np.flatnonzero(sums)
        yield _asked(hot[seen], np.full(len(seen), -2), -1, sums[seen], salt)
        if ends:
            yield _asked(np.zeros(1, np.uint64), np.full(1, -1), -1, np.array([ends]), salt)

    def _asked(h: np.ndarray, place: np.ndarray, chunk: int, n: np.ndarray, salt: int) -> pa.RecordBatch:
        return pa.record_batch({"h": np.ascontiguousarray(h).view(np.int64), "place": place.astype(np.int32), "chunk": np.full(len(h), chunk), "n": n.astype(np.int64), "salt": np.full(len(h), salt, dtype=np.int32)})

    asked = chunks.mapInArrow(ask, "h long, place int, chunk long, n long, salt int")
    same = Window.partitionBy("end", "h", "salt")
    known = (
        asked.withColumn("end", F.col("place") == -1)
        .withColumn("total", F.sum("n").over(same))
        .withColumn("nth", F.row_number().over(same.orderBy("chunk")))
        .where("total > 0")
    )
    # The sums read every column that the answers do, so both use one exchange.
    parts = known.where("nth = 1 and place >= -2").withColumn("word", F.when(F.col("place") < 0, F.struct("place", "h"))).groupBy("word").agg(F.sum("total").alias("total"), F.count("*").alias("n"))
    listed = F.collect_list(F.when(F.col("word.place") == -2, F.struct("word.h", "total")))
    sums = parts.agg(
        F.struct(
            F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n")).otherwise(1)), F.lit(0)).alias("v"),
            F.coalesce(F.max(F.when(F.col("word.place") == -1, F.col("total"))), F.lit(0)).alias("ends"), listed.alias("frequent"),
        ).alias("s")
    ).scalar()
    answers = known.where("place >= 0").groupBy("chunk").agg(F.collect_list(F.struct("place", "total")).alias("found"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, rows = trie.value[1]
        row_of = _row_of(contexts)
        for batch in batches:
            for blob, found, told, ends, often in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist(), batch.column(4), strict=True):
                ids, texts = common.unpack(blob)
                distinct, back, first, _ = _distinct(ids, texts)
                c = np.zeros(len(distinct) + 1)
                c[-1] = ends
                if len(often.values):
                    h, total = (often.values.field(i).to_numpy() for i in (0, 1))
                    order = np.argsort(h.view(np.uint64))
                    at, there = _at(h.view(np.uint64)[order], distinct)
                    c[:-1][there] = total[order][at[there]]
                if found.is_valid and len(found.values):
                    c[found.values.field(0).to_numpy()] = found.values.field(1).to_numpy()
                log = np.concatenate([[0.0], np.cumsum(np.log10(c[:-1] + 0.5)[back])])
                seen = np.concatenate([[0], np.cumsum(c[:-1][back] > 0)])
                known, p = _told(told)
                model = []
                for t in texts:
                    codes = _codes(t)
                    place = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                    logs = np.where((known[place] == codes) & ~np.isnan(p[place]), p[place], rows[row_of[codes >> 8 & 0xFFFF], codes & 255])
                    model.append(float(logs.sum(dtype=np.float64)))
                yield pa.record_batch({
                    key: pa.array(ids, pa.int64()),
                    "held_out": pa.array([held_out(i) for i in ids]),
                    "n_tokens": np.diff(first) + 1,
                    "n_known": seen[first[1:]] - seen[first[:-1]] + int(c[-1] > 0),
                    "logs": log[first[1:]] - log[first[:-1]] + np.log10(c[-1] + 0.5),
                    "score": np.array(model, dtype=np.float64),
                })

    scored = chunks.join(answers, "chunk", "left").join(long, "chunk", "left").withColumn("sums", sums).select("blob", "found", "codes", "sums.ends", "sums.frequent").mapInArrow(score, f"{key} long, held_out boolean, n_tokens long, n_known long, logs double, score double")
    scored = scored.withColumn("sums", sums)
    return scored.select(
        key, "held_out", "n_tokens", "n_known", F.col("sums.n").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.log10(F.col("sums.n") + 0.5 * (F.col("sums.v") + 1))).alias("base_score"), "score",
    )


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return lm_scores(common.table(spark, sf_dir, "documents"))
