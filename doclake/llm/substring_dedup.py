"""Exact substring dedup by difference-cover anchors.

Any two equal runs of ``window`` words, wherever they begin, hold equal shorter
runs at one common offset whose start is a cover position in both documents
(residues of the start modulo the period form a perfect difference set).  So:

1. hash short runs at cover positions only, keep those found twice or more;
2. extend: hash the full windows that hold a shared anchor, on both sides;
3. remove every word that a window found twice or more covers.

Windows are equal when two hashes of 96 bits together are, inside a chunk and
across chunks; an anchor shared by chance costs time, not results.  Both
questions are asked per chunk of documents and distinct hash.  What a bounded
sample of documents (``SAMPLE``) already holds twice is known to be repeated and
is not asked, so a passage that is in most chunks makes no row in any; what is
asked is rare, and no key has more than a small share of the rows.

Nulls: a null text has no words; a null id is kept as it is.  Repeated rows and
ids count as separate documents.  Texts shorter than the window are kept whole;
an empty text has an empty rest.  Extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclake.llm import common

#: Perfect difference sets: period -> residues with every difference once.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
#: Words of the shortest anchor that is taken when the window allows it.
LEAST_ANCHOR = 12
#: Documents, and bytes of them, that are searched for frequent passages first.
SAMPLE, SAMPLE_BYTES = 1_500, 4 << 20


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """Period, residues and anchor width (window - period + 1) for a window."""
    if window < 1:
        raise ValueError("window must be at least 1")
    fit = [p for p in COVERS if window - p + 1 >= min(LEAST_ANCHOR, max(1, window // 2))]
    if not fit:
        return 1, (0,), window
    return max(fit), COVERS[max(fit)], window - max(fit) + 1


class _Words:
    """Word hashes of some documents, and each word's place in its document."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids, self.texts = ids, texts
        data, at = common.joined(self.texts)
        start, _, self.hash = common.hash_words(data)
        self.first = np.searchsorted(start, at)
        count = np.diff(self.first)
        self.left = np.repeat(self.first[1:], count) - np.arange(len(start))  # words to the document's end
        self.place = np.arange(len(start)) - np.repeat(self.first[:-1], count)

    def whole(self, width: int) -> np.ndarray:
        """Starts of the runs of ``width`` words inside one document."""
        return np.flatnonzero(self.left >= width)


def _anchors(words: _Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    period, residues, width = cover_for(window)
    at = words.whole(width)
    at = at[np.isin(words.place[at] % period, residues)]
    return at, common.window_hashes(words.hash, width, 3)[at] if len(at) else np.zeros(0, np.uint64)


def _window_keys(words: _Words, window: int, at: np.ndarray) -> np.ndarray:
    """Two hashes (rows) of the windows that begin there; the second has 32 bits."""
    if not len(at):
        return np.zeros((0, 2), np.uint64)
    return np.stack([common.window_hashes(words.hash, window, 5)[at], common.window_hashes(words.hash, window, 7)[at] >> np.uint64(32)], axis=1)


def _alike(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each key, where each number's first key is, and how many keys it has."""
    if keys.ndim == 2:
        _, _, one = common.numbered(np.ascontiguousarray(keys[:, 0]))
        _, _, two = common.numbered(np.ascontiguousarray(keys[:, 1]))
        keys = one * (two.max(initial=0) + 1) + two
    _, first, back = common.numbered(keys)
    return back, first, np.bincount(back, minlength=len(first))


def _known(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are surely among the known ones, which are sorted (one of equal first hashes is looked at)."""
    if not len(known) or not len(keys):
        return np.zeros(len(keys), dtype=bool)
    if keys.ndim == 1:
        return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys
    return (known[np.minimum(np.searchsorted(known[:, 0], keys[:, 0]), len(known) - 1)] == keys).all(axis=1)


class _Question:
    """The distinct keys of a chunk that are not known to be repeated; an answer names their places."""

    def __init__(self, keys: np.ndarray, known: np.ndarray):
        self.keys = keys
        self.back, self.first, n = _alike(keys)
        self.shared = _known(keys[self.first], known)
        self.asked = np.flatnonzero(~self.shared)
        self.shared |= n > 1

    def rows(self, chunk: int) -> pa.RecordBatch:
        """(h, h2 of windows, place, chunk): a key that the chunk holds twice needs no answer, and has place -1."""
        keys = self.keys[self.first[self.asked]]
        place = np.where(self.shared[self.asked], -1, np.arange(len(keys))).astype(np.int32)
        parts = {"h": keys.view(np.int64)} if keys.ndim == 1 else {"h": np.ascontiguousarray(keys[:, 0]).view(np.int64), "h2": keys[:, 1].astype(np.uint32).view(np.int32)}
        return pa.record_batch({**parts, "place": place, "chunk": np.full(len(keys), chunk)})

    def found(self, places: pa.ListScalar) -> np.ndarray:
        """Which keys are found twice, here or in all chunks."""
        shared = self.shared.copy()
        if places.is_valid:
            shared[self.asked[places.values.to_numpy()]] = True
        return shared[self.back]


def _windows(words: _Words, window: int, anchors: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Starts of the full windows that hold a shared anchor."""
    period, _, _ = cover_for(window)
    hit = np.zeros(len(words.hash) + period + 1, dtype=np.int64)
    hit[anchors[shared] + 1] = 1
    np.cumsum(hit, out=hit)
    starts = words.whole(window)
    return starts[hit[starts + period] > hit[starts]]


def _ask(rows: DataFrame, *keys: str) -> DataFrame:
    """Per chunk, the places of the keys that it holds once and that some other chunk holds too."""
    total = F.sum(F.when(F.col("place") < 0, 2).otherwise(1)).over(Window.partitionBy(*keys))
    again = rows.withColumn("total", total).where("total > 1 and place >= 0")
    return again.groupBy("chunk").agg(F.collect_list("place").alias("found"))


def _frequent(docs: DataFrame, window: int, key: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Anchors and windows that a bounded sample holds twice or more; half of its words at most."""

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = [], []
        for some, more in common.text_groups(batches):
            ids, texts = ids + some, texts + more
            if sum(map(len, texts)) >= SAMPLE_BYTES:
                break
        words = _Words(ids, texts)
        at, anchors = _anchors(words, window)
        back, first, n = _alike(anchors)
        h = anchors[first[n > 1]]
        yield pa.record_batch({"h": h.view(np.int64), "h2": pa.nulls(len(h), pa.int64())})
        keys = _window_keys(words, window, _windows(words, window, at, n[back] > 1))
        _, first, n = _alike(keys)
        keys = keys[first[n > 1]]
        yield pa.record_batch({"h": np.ascontiguousarray(keys[:, 0]).view(np.int64), "h2": np.ascontiguousarray(keys[:, 1]).view(np.int64)})

    some = common.thinned(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where(F.octet_length("t") < 1 << 20), "k", SAMPLE).limit(SAMPLE)
    found = some.repartition(1).mapInArrow(twice, "h long, h2 long").toArrow()
    h, h2 = found["h"].to_numpy().view(np.uint64), found["h2"]
    anchor = h2.is_null().to_numpy()
    pairs = h2.fill_null(0).to_numpy().view(np.uint64)
    windows = np.stack([h, pairs], axis=1)[~anchor]
    return np.sort(h[anchor]), windows[np.lexsort((windows[:, 1], windows[:, 0]))]


def substring_dedup(docs: DataFrame, window: int = 35, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept): each document without its repeated windows.

    ``kept`` is the remaining words joined by one space.
    """
    chunks = common.to_chunks(docs, key, text)
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, window, key, text))

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                yield _Question(_anchors(_Words(*common.unpack(blob)), window)[1], frequent.value[0]).rows(chunk)

    def asked_windows(blob: bytes, anchors: pa.ListScalar) -> tuple[_Words, np.ndarray, _Question]:
        words = _Words(*common.unpack(blob))
        at, keys = _anchors(words, window)
        at = _windows(words, window, at, _Question(keys, frequent.value[0]).found(anchors))
        return words, at, _Question(_window_keys(words, window, at), frequent.value[1])

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob, anchors in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), strict=True):
                yield asked_windows(blob, anchors)[2].rows(chunk)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, a, w in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words, at, question = asked_windows(blob, a)
                at = at[question.found(w)]
                edge = np.zeros(len(words.hash) + window + 1, dtype=np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                keep = np.cumsum(edge)[: len(words.hash)] == 0
                n = np.diff(words.first)
                before = np.concatenate([[0], np.cumsum(~keep)])
                removed = before[words.first[1:]] - before[words.first[:-1]]
                kept = [b" ".join(compress(t.split(), keep[s:e]) if r else t.split()) for t, s, e, r in zip(words.texts, words.first[:-1].tolist(), words.first[1:].tolist(), removed.tolist(), strict=True)]
                yield pa.record_batch({key: pa.array(words.ids, pa.int64()), "n_words": n, "n_removed": removed, "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    anchors = _ask(chunks.mapInArrow(ask_anchors, "h long, place int, chunk long"), "h").withColumnRenamed("found", "anchors")
    with_anchors = chunks.join(anchors, "chunk", "left")
    windows = _ask(with_anchors.mapInArrow(ask_windows, "h long, h2 int, place int, chunk long"), "h", "h2").withColumnRenamed("found", "windows")
    full = with_anchors.join(windows, "chunk", "left").select("blob", "anchors", "windows")
    return full.mapInArrow(remove, f"{key} long, n_words long, n_removed long, kept string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    out = substring_dedup(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS pos FROM documents),
runs AS (SELECT doc_id, pos, word, CASE WHEN count(*) OVER w = 35 THEN md5(string_agg(word, ' ') OVER w) END AS h FROM t
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
hits AS (SELECT doc_id, pos, word, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS hit FROM runs),
marked AS (SELECT doc_id, pos, word, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM hits)
SELECT d.doc_id, count(word) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY 1
"""
