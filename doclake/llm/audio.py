"""Chroma fingerprints of recordings, and their alignment.

A recording is a binary column of 16-bit mono samples.  Short-time spectra are
folded to twelve pitch classes; box filters over the integral image of these
frames, each quantised to two bits, give one 32-bit item a frame.  Two
recordings are aligned where most of their equal items agree on an offset, and
compared there by the share of unequal bits.

Two recordings are linked when the offset with most votes has ``LEAST_VOTES`` of
them, ``LEAST_FRAMES`` frames lie over each other there, and at most
``MOST_ERRORS`` of their bits differ.

Recordings with the same fingerprint are one class, so copies are compared
once.  The queries, a stated set, and all classes are dealt to blocks, and each
pair of blocks is one small task; no row is made for a pair of items.
``alignments`` returns every link of classes, ``best_matches`` the number of
recordings that each query is linked with, and the best of them.

The given tables hold no audio.  ``derive_audio`` plays each vector of
``embeddings`` as a tune, so close vectors give close recordings.

Nulls: a null or too short recording has no items, is in no class and matches
nothing; so is a class without any id.  An odd last byte is ignored.  Of equal
votes an offset of least value is taken; ties of matches go to fewer bit errors,
then to the smaller id.  Repeated ids are recordings of their own in counts.  An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm import common

RATE, FRAME, HOP, NOTE = 2000, 256, 128, 200
#: Box filters by rule: kind, first pitch class, height, width in frames.
FILTERS = tuple((k % 4, (5 * k) % 12, 2 + k % 5, (4, 6, 8, 12)[k // 4]) for k in range(16))
WIDEST = max(f[3] for f in FILTERS)
QUERIES, CLASSES = 200, 1000
#: What links two recordings: equal items at one offset, frames that lie over each other there, share of unequal bits.
LEAST_VOTES, LEAST_FRAMES, MOST_ERRORS = 8, 24, 0.2


def tune(vector: np.ndarray) -> bytes:
    """Samples of a vector played note by note; a value sets its note's pitch."""
    steps = np.clip(np.round((vector * 3 + 0.5) * 24), 0, 24)
    frequency = np.repeat(110 * 2 ** (steps / 12), NOTE)
    return (np.sin(2 * np.pi * np.cumsum(frequency) / RATE) * 12000).astype("<i2").tobytes()


def derive_audio(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sound = [None if v is None else tune(np.nan_to_num(np.array(v, dtype=np.float64))) for v in batch.column(1).to_pylist()]
            yield pa.record_batch({key: batch.column(0), "pcm": pa.array(sound, pa.binary())})

    return vectors.select(F.col(key).cast("long").alias(key), vector).mapInArrow(run, f"{key} long, pcm binary")


def _classes() -> np.ndarray:
    """Which pitch class each spectrum bin belongs to."""
    frequency = np.fft.rfftfreq(FRAME, 1 / RATE)
    fold = np.zeros((len(frequency), 12))
    heard = np.flatnonzero((frequency >= 80) & (frequency <= 900))
    fold[heard, np.round(12 * np.log2(frequency[heard] / 110)).astype(int) % 12] = 1
    return fold


_FOLD, _WINDOW = _classes(), np.hanning(FRAME)


def fingerprint(pcm: bytes | None) -> np.ndarray:
    """32-bit items, one a frame, the last ``WIDEST`` - 1 frames excepted."""
    x = np.frombuffer((pcm or b"")[: len(pcm or b"") // 2 * 2], dtype="<i2").astype(np.float64)
    n = (len(x) - FRAME) // HOP + 1
    if n < WIDEST:
        return np.zeros(0, np.uint32)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n]
    chroma = np.abs(np.fft.rfft(frames * _WINDOW)) @ _FOLD
    chroma /= np.maximum(np.linalg.norm(chroma, axis=1, keepdims=True), 1e-9)
    image = np.zeros((n + 1, 25))
    np.cumsum(np.cumsum(np.concatenate([chroma, chroma], axis=1), axis=0), axis=1, out=image[1:, 1:])
    at = np.arange(n - WIDEST + 1)

    def box(left: int, right: int, low: int, high: int) -> np.ndarray:
        return image[at + right, high] - image[at + left, high] - image[at + right, low] + image[at + left, low]

    items = np.zeros(len(at), dtype=np.uint32)
    for kind, low, height, width in FILTERS:
        high, half = low + height, width // 2
        if kind == 0:  # the box against its pitch neighbours above
            value = box(0, width, low, high) - box(0, width, low + height // 2, high) * 2
        elif kind == 1:  # first half against second
            value = box(0, half, low, high) - box(half, width, low, high)
        elif kind == 2:  # middle against both ends
            value = box(width // 4, width - width // 4, low, high) * 2 - box(0, width, low, high)
        else:  # the box against an even spread
            value = box(0, width, low, high) - box(0, width, 0, 12) * height / 12
        step = 0.08 * width
        level = (value > -step).astype(np.uint32) + (value > 0) + (value > step)
        items = items << np.uint32(2) | (level ^ level >> np.uint32(1))
    return items


def fingerprints(recordings: DataFrame, key: str = "vec_id", pcm: str = "pcm") -> DataFrame:
    """(key, items, n_items, sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(p) for p in batch.column(1).to_pylist()]
            yield pa.record_batch({key: batch.column(0), "items": pa.array([m.astype("<u4").tobytes() for m in made], pa.binary()), "n_items": np.array([len(m) for m in made], dtype=np.int64), "sha256": [hashlib.sha256(m.astype("<u4").tobytes()).hexdigest() for m in made]})

    return recordings.select(F.col(key).cast("long").alias(key), pcm).mapInArrow(run, f"{key} long, items binary, n_items long, sha256 string")


def align(q: np.ndarray, q_of: np.ndarray, q_at: np.ndarray, r: np.ndarray, r_of: np.ndarray, r_at: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """For each query and recording with an equal item: the offset with most votes. Items come with owner and place."""
    order = np.argsort(r, kind="stable")
    low, high = np.searchsorted(r[order], q, "left"), np.searchsorted(r[order], q, "right")
    n = high - low
    mine = np.repeat(np.arange(len(q)), n)
    theirs = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
    offset = r_at[theirs] - q_at[mine] + span
    pair = q_of[mine].astype(np.int64) << 32 | r_of[theirs]
    both, votes = np.unique(np.stack([pair, offset], axis=1), axis=0, return_counts=True) if len(pair) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
    by = np.lexsort((both[:, 1], -votes, both[:, 0]))
    first = by[np.concatenate([[True], both[by][1:, 0] != both[by][:-1, 0]])] if len(by) else by
    return both[first, 0] >> 32, both[first, 0] & 0xFFFFFFFF, both[first, 1] - span, votes[first]


def bit_errors(q: np.ndarray, r: np.ndarray, offset: int) -> tuple[int, int]:
    """Unequal bits, and bits compared, with recording place = query place + offset."""
    a, b = max(0, -offset), min(len(q), len(r) - offset)
    if a >= b:
        return 0, 0
    x = q[a:b] ^ r[a + offset : b + offset]
    return int(np.unpackbits(x.view(np.uint8)).sum()), 32 * (b - a)


def _classes_of(prints: DataFrame, key: str) -> DataFrame:
    """(sha256, class_id, class_size, items): recordings of one fingerprint."""
    return prints.where("n_items > 0").groupBy("sha256").agg(F.min(key).alias("class_id"), F.count("*").alias("class_size"), F.first("items").alias("items")).where("class_id is not null")


def _links(rows: pa.Table) -> list[tuple]:
    """Links (query, size of the query's class, class, its size, votes, offset, bit errors, bits) of two blocks."""
    side = rows["as_query"].to_numpy(zero_copy_only=False).astype(bool)
    ids, sizes = rows["class_id"].to_pylist(), rows["class_size"].to_pylist()
    prints = [np.frombuffer(x, "<u4") for x in rows["items"].to_pylist()]

    def flat(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = [len(prints[i]) for i in which]
        return (np.concatenate([prints[i] for i in which]) if len(which) else np.zeros(0, np.uint32)), np.repeat(which, size), np.concatenate([np.arange(s) for s in size]) if len(which) else np.zeros(0, np.int64)

    found = align(*flat(np.flatnonzero(side)), *flat(np.flatnonzero(~side)), max(map(len, prints)))
    enough = found[3] >= LEAST_VOTES
    out = []
    for i, j, offset, votes in zip(*(x[enough].tolist() for x in found), strict=True):
        if ids[i] != ids[j]:
            errors, bits = bit_errors(prints[i], prints[j], offset)
            if bits >= 32 * LEAST_FRAMES and errors <= MOST_ERRORS * bits:
                out.append((ids[i], sizes[i], ids[j], sizes[j], votes, offset, errors, bits))
    return out


def _blocks(classes: DataFrame, asked: DataFrame, n_c: int, n_q: int):
    """Queries and classes, dealt so that each query meets each class in one block."""
    blocks_q, blocks_c = -(-n_q // QUERIES) or 1, -(-n_c // CLASSES) or 1
    deal = lambda n: F.pmod(F.xxhash64("class_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["class_id", "class_size", "items"]
    queries = asked.select(*columns, F.lit(True).alias("as_query"), deal(blocks_q).alias("p"), each(blocks_c).alias("q"))
    others = classes.select(*columns, F.lit(False).alias("as_query"), each(blocks_q).alias("p"), deal(blocks_c).alias("q"))
    return queries.unionByName(others).groupBy("p", "q")


def alignments(prints: DataFrame, is_query, key: str = "vec_id") -> DataFrame:
    """(class_id, other_class, votes, offset, bit_errors, bits): every link of a query's class."""
    classes = common.checkpointed(_classes_of(prints, key))
    asked = prints.where(is_query).select("sha256").distinct().join(classes, "sha256")
    names = ["class_id", "size", "other_class", "other_size", "votes", "offset", "bit_errors", "bits"]

    def compare(rows: pa.Table) -> pa.Table:
        links = _links(rows)
        return pa.table([pa.array([x[c] for x in links], pa.int64()) for c in range(8)], names=names)

    found = _blocks(classes, asked, classes.count(), asked.count()).applyInArrow(compare, ", ".join(f"{n} long" for n in names))
    return found.drop("size", "other_size")


def best_matches(prints: DataFrame, is_query, key: str = "vec_id") -> DataFrame:
    """All recordings with their class; queries also with their number of links and the best other class, its offset, votes and bit errors."""
    classes = common.checkpointed(_classes_of(prints, key))
    asked = prints.where(is_query).select("sha256").distinct().join(classes, "sha256")
    names = ["class_id", "links", "votes", "nearness", "best_match", "offset", "bit_errors", "bits"]
    kinds = [pa.float64() if n == "nearness" else pa.int64() for n in names]

    def compare(rows: pa.Table) -> pa.Table:
        best: dict[int, tuple] = {}
        links: dict[int, int] = {}
        for query, _, other, size, votes, offset, errors, bits in _links(rows):
            links[query] = links.get(query, 0) + size
            rank = (votes, -errors / bits, -other)
            if query not in best or rank > best[query][:3]:
                best[query] = (*rank, offset, errors, bits)
        out = [(q, links[q], v, r, -m, o, e, b) for q, (v, r, m, o, e, b) in best.items()]
        return pa.table([pa.array([row[c] for row in out], kinds[c]) for c in range(len(names))], names=names)

    schema = ", ".join(f"{n} {'double' if n == 'nearness' else 'long'}" for n in names)
    found = _blocks(classes, asked, classes.count(), asked.count()).applyInArrow(compare, schema)
    rank = F.struct("votes", "nearness", (-F.col("best_match")).alias("m"))
    best = found.groupBy("class_id").agg(F.sum("links").alias("links"), F.max_by(F.struct("best_match", "offset", "votes", "bit_errors", "bits"), rank).alias("b"))
    named = prints.select(key, "n_items", "sha256").join(classes.select("sha256", "class_id", "class_size"), "sha256", "left").join(best, "class_id", "left")
    fields = [F.when(is_query, F.col(f"b.{c}")).alias(c) for c in ("best_match", "offset", "votes", "bit_errors", "bits")]
    # Copies of the query are links too.
    links = F.when(is_query, F.coalesce(F.col("class_size") - 1, F.lit(0)) + F.coalesce("links", F.lit(0)))
    return named.select(key, "n_items", "sha256", "class_id", "class_size", links.alias("n_links"), *fields)


def op8_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark, 200)
    prints = common.checkpointed(fingerprints(derive_audio(common.table(spark, sf_dir, "embeddings"))))
    return best_matches(prints, F.col("vec_id") % 50 == 0)
