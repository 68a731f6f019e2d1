"""Packing along a space-filling curve.

Each document's hashed word vector is projected to a few dimensions and placed
on a Hilbert curve; the documents are range-partitioned and sorted by that key
and cut, in this order, into sequences of ``length`` tokens.  Only the end of a
partition doesn't fill a sequence; it is cut into powers of two, which need no
padding.

Nulls: a null text is the empty text, whose only token is the closing one.
Equal texts lie side by side, ordered by id; a hot group of equal keys is split
by id, and one of equal ids and texts by a number of its own.  Repeated and null
ids are packed as separate documents.  Extra columns are ignored; an empty table
gives no pieces.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm import common

WORD_BPE = "word_bpe_49k.json"
#: Dimensions of the projected vector, and bits of each on the curve.
DIMS, BITS = 4, 12
#: Pieces that a worker's lookup holds in each of its two generations.
CACHE_ENTRIES = 400_000
#: What marks a piece's last token in the public vocabulary (fixed value), and pieces looked up at a time.
WORD_END, RUN = "</w>", 1000

#: Kinds of bytes: white space, letter, digit, apostrophe, other ASCII, beyond ASCII; and between which a piece ends.
_KIND = np.full(256, 4, dtype=np.uint8)
_KIND[128:] = 5
_KIND[common._SPACE] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[39] = 3
_CUT = np.zeros((6, 6), dtype=bool)
_CUT[0, :] = _CUT[:, 0] = _CUT[2, 1:5] = _CUT[1, 2:5] = _CUT[3:5, 2] = _CUT[4, 1] = True


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows), by Gray-code exchange."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(texts: list[bytes]) -> np.ndarray:
    """The Hilbert key of each text's hashed, projected word vector; 0 without words."""
    data, at = common.joined(texts)
    start, _, words = common.hash_words(data, lower=True)
    first = np.searchsorted(start, at)
    count = np.diff(first)
    points = np.empty((len(texts), DIMS), dtype=np.int64)
    mixed = common.mix(words, 11)
    for d in range(DIMS):  # each dimension's weight is a quarter of the hash
        side = (mixed >> np.uint64(16 * d) & np.uint64(0xFFFF)).astype(np.float64) * 2.0**-15 - 1
        total = np.concatenate([[0.0], np.cumsum(side)])
        mean = (total[first[1:]] - total[first[:-1]]) / np.maximum(count, 1)
        # Means lie near 0; the square root spreads them over the grid.
        spread = np.sign(mean) * np.sqrt(np.minimum(np.abs(mean), 1))
        points[:, d] = np.clip(((spread + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return np.where(count > 0, hilbert(points, BITS), 0)


class _Memo:
    """A bounded lookup of two generations: when the new one is full it becomes the old one; what is asked for again moves on."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def many(self, keys: list) -> list:
        """The keys' values; None where unknown."""
        found = list(map(self.new.get, keys))
        if None in found:
            for i, value in enumerate(found):
                if value is None and (value := self.old.get(keys[i])) is not None:
                    found[i] = self.new[keys[i]] = value
        return found

    def age(self) -> None:
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}


def pieces(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text with capitals made small, and where its pieces begin and end.

    Both sides of each cut are ASCII, and the vocabulary cuts there too, so
    pieces are encoded apart.  A capital before a byte beyond ASCII stays, as a
    mark could join it.
    """
    buf = np.frombuffer(data, dtype=np.uint8)
    kind = _KIND[buf]
    cut = np.ones(len(buf) + 1, dtype=bool)
    cut[1:-1] = _CUT[kind[:-1], kind[1:]]
    inside = kind != 0
    start, end = np.flatnonzero(inside & cut[:-1]), np.flatnonzero(inside & cut[1:]) + 1
    after = np.append(buf[1:], 0).astype(np.uint8) if len(buf) else buf
    return np.where(after < 128, common.LOWER[buf], buf), start, end


class _Words:
    """Token ids of texts: each group of texts looks up its distinct pieces only, by their 64-bit hash."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.known = _Memo(CACHE_ENTRIES)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(1 + max(vocab.values()), dtype=bool)  # ids that end a piece
        self.ends[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _run(self, words: list[str]) -> list[bytes]:
        """Words of letters together, as a call for each costs twice the time."""
        ids = self.whole(" ".join(words))
        if len(words) == 1:
            return [ids.tobytes()]
        to = (np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1) * 4
        if len(to) != len(words):  # some word is more than one piece
            return self._run(words[: len(words) // 2]) + self._run(words[len(words) // 2 :])
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *to.tolist()], to.tolist(), strict=False)]

    def _new(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        letters = [i for i, w in enumerate(words) if len(w) <= 64 and w.isalpha()]
        for at in range(0, len(letters), RUN):
            some = letters[at : at + RUN]
            for i, value in zip(some, self._run([words[i] for i in some]), strict=True):
                out[i] = value
        for i, w in enumerate(words):
            if not out[i]:
                out[i] = self.whole(w).tobytes()
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and where each text's begin (one more at the end)."""
        odd = [i for i, t in enumerate(texts) if any(x in t for x in self.special)]
        if odd:  # control tokens are found before text is cut
            given = {i: self.whole(texts[i].decode("utf-8", "replace")) for i in odd}
            ids, at = self.encode([b"" if i in given else t for i, t in enumerate(texts)])
            parts = [given.get(i, ids[at[i] : at[i + 1]]) for i in range(len(texts))]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        data, begins = common.joined(texts)
        buf, start, end = pieces(data)
        distinct, first, back = common.numbered(common.hash_spans(buf, start, end))
        keys = distinct.tolist()
        self.known.age()
        found = self.known.many(keys)
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            small, at = buf.tobytes(), first[missing]
            words = [small[s:e].decode("utf-8", "replace") for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            for i, word, value in zip(missing, words, self._new(words), strict=True):
                found[i] = value
                if len(word) <= 64:
                    self.known.new[keys[i]] = value
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        n = size[back]
        to = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat((np.cumsum(size) - size)[back] - to[:-1], n) + np.arange(to[-1])] if len(back) else np.zeros(0, "<u4")
        return ids, to[np.searchsorted(start, begins)]


@cache
def _words(path: str) -> _Words:
    return _Words(path)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 4096, end_id: int = 2, vocab: str | None = None, also: str | None = None) -> DataFrame:
    """Pieces (key, start, length, ids, doc_tokens, sequence_id, offset) of all documents.

    ``ids`` is the piece as little-endian unsigned 32-bit integers, ``vocab`` a
    tokenizers file that every executor has, ``also`` another integer column that
    each piece takes along.
    """
    also = also or key
    own = [key] if also == key else [key, also]

    @F.arrow_udf("long")
    def place(texts: pa.Array) -> pa.Array:
        rows = pa.record_batch({"i": pa.nulls(len(texts), pa.int64()), "text": texts})
        keys = [curve_keys(group) for _, group in common.text_groups([rows])]
        return pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64), pa.int64())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = _words(vocab or public_tokenizers.path(WORD_BPE))
        end = np.array([end_id], dtype="<u4").tobytes()
        sequence, filled = TaskContext.get().partitionId() << 33, 0
        waiting: list[tuple] = []  # pieces of the sequence that is not full
        pairs = (pa.record_batch({"k": pa.StructArray.from_arrays([b.column(0), b.column(1)], ["a", "b"]), "t": b.column(2)}) for b in batches)
        for keys, texts in common.text_groups(pairs):
            done: list[tuple] = []
            coded, begins = words.encode(texts)
            bounds = begins.tolist()
            for doc, a, b in zip(keys, bounds, bounds[1:], strict=False):
                ids = coded[a:b].tobytes() + end
                total, at = len(ids) // 4, 0
                while at < total:
                    n = min(total - at, length - filled)
                    waiting.append((doc, at, n, ids[4 * at : 4 * (at + n)], total, sequence, filled))
                    at, filled = at + n, filled + n
                    if filled == length:
                        done += waiting
                        waiting, filled, sequence = [], 0, sequence + 1
            if done:
                yield _rows(done)
        # The rest is cut at the powers of two that add up to it.
        done, size, filled = [], 1 << max(0, filled.bit_length() - 1), filled
        left, inside = filled, 0
        for doc, at, n, ids, total, _, _ in waiting:
            used = 0
            while used < n:
                take = min(n - used, size - inside)
                done.append((doc, at + used, take, ids[4 * used : 4 * (used + take)], total, sequence, inside))
                used, inside = used + take, inside + take
                if inside == size:
                    left, inside, sequence = left - size, 0, sequence + 1
                    size = 1 << max(0, left.bit_length() - 1)
        if done:
            yield _rows(done)

    def _rows(pieces: list[tuple]) -> pa.RecordBatch:
        doc, at, n, ids, total, sequence, offset = zip(*pieces, strict=True)
        keys = [pa.array([d[c] for d in doc], pa.int64()) for c in "ab"[: len(own)]]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.record_batch([*keys, *(pa.array(x, k) for x, k in zip((at, n, ids, total, sequence, offset), kinds, strict=True))], names=[*own, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    # The range borders come from a first pass over the keys, so these are written, not computed twice.
    columns = [F.col(key).cast("long").alias("_key"), F.col(also).cast("long").alias("_also"), F.col(text).alias("_text")]
    placed = common.written(docs.select(*columns).withColumn("place", place("_text")).withColumn("_row", F.monotonically_increasing_id()), "zstd")
    # A number of its own splits rows that are alike in key and text.
    ordered = placed.repartitionByRange("place", "_key", "_row").sortWithinPartitions("place", "_key", "_row").select("_key", "_also", "_text")
    return ordered.mapInArrow(cut, f"{', '.join(f'{c} long' for c in own)}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    pieces = pack(common.table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
