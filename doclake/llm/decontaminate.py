"""Benchmark decontamination by Wu-Manber search of many test strings at once.

Test strings are the windows of ``window`` consecutive words of each item (an item
of fewer words, but not none, is one string).  Strings of one length share tables
over blocks of ``BLOCK`` words:

1. the *shift* table says for the block that ends at a position how far the search
   may jump: past every place at which no string can end;
2. where the shift is 0 the block is the suffix of some strings: these lie together
   in a *bucket*, in order of the hash of their first block;
3. the strings of a bucket that agree in both hashes are compared word by word, as
   bytes, with the text.

All segments of a group of texts are searched in step, one pointer each, so the
jumps are array operations.

The strings of at most ``PART_BYTES`` of item text make one part, which is broadcast; more
items are dealt to more parts, by hash, and long items are cut into overlapping
pieces first.  Each part searches all documents, and what it hits is put together
by row.  So neither the driver nor a task holds more than one part of the items.

Nulls: a null text has no words; a null doc_id is kept; a null item_id is one item
of its own with an empty name.  Rows of items with one item_id are one item;
documents with repeated rows or ids are judged on their own, each row once.  An
empty table of items hits nothing; an empty table of documents gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm import common

#: Words of a block (or the string's length, where that is less).
BLOCK = 3
#: Words that one pointer searches.
SEGMENT = 256
#: Bytes of item text in a part, and words of a piece of an item.
PART_BYTES, PIECE = 4 << 20, 4_096

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lower case; whatever is no part of a word becomes a space.
PLAIN = bytes(int(common.LOWER[i]) if _WORD[common.LOWER[i]] else 0x20 for i in range(256))


def plain_words(data: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The text in lower case with spaces between words; start, end and hash of its words."""
    plain = data.translate(PLAIN)
    return plain, *common.hash_words(plain)


def _blocks(words: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words that end at each of the places."""
    out = np.zeros(len(end), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = common.mix(out * np.uint64(3) + words[end - k], k)
    return out


class Strings:
    """Shift table and buckets for distinct strings of ``m`` words (rows of word hashes)."""

    def __init__(self, m: int, hashes: np.ndarray, texts: list[bytes]):
        self.m, self.width, self.hashes, self.texts = m, min(BLOCK, m), hashes, texts
        flat, n = hashes.ravel(), len(hashes)
        self.bits = max(12, int(16 * n).bit_length())  # windows overlap: about one new block each
        self.shift = np.full(1 << self.bits, m - self.width + 1, dtype=np.uint16 if m > 255 else np.uint8)
        row = np.arange(n) * m
        for end in range(self.width - 1, m):  # later ends have smaller shifts, and are written last
            self.shift[self._slot(_blocks(flat, row + end, self.width))] = m - 1 - end
        key = self._key(_blocks(flat, row + m - 1, self.width), _blocks(flat, row + self.width - 1, self.width))
        self.order = np.argsort(key, kind="stable")
        self.bucket = key[self.order]

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - self.bits)).astype(np.int64)

    @staticmethod
    def _key(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """Buckets in order of the suffix hash; inside, strings by prefix hash."""
        return (suffix & np.uint64(0xFFFFFFFF00000000)) | (prefix >> np.uint64(32))

    def ends(self, words: np.ndarray) -> np.ndarray:
        """Places that shifts don't rule out: the last word of a possible occurrence."""
        first = np.arange(self.m - 1, len(words), SEGMENT)
        last = np.minimum(first + SEGMENT, len(words))
        found = []
        while len(first):
            jump = self.shift[self._slot(_blocks(words, first, self.width))].astype(np.int64)
            found.append(first[jump == 0])
            first = first + np.maximum(jump, 1)
            more = first < last
            first, last = first[more], last[more]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def search(self, words: np.ndarray, left: np.ndarray, plain: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words and numbers of the strings that occur; ``left`` has each word's distance to its document's end."""
        begin = self.ends(words) - self.m + 1
        begin = begin[left[begin] >= self.m]
        if not len(begin):
            return begin, begin
        key = self._key(_blocks(words, begin + self.m - 1, self.width), _blocks(words, begin + self.width - 1, self.width))
        low, high = np.searchsorted(self.bucket, key), np.searchsorted(self.bucket, key, side="right")
        n = high - low
        begin, which = np.repeat(begin, n), np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        which = self.order[which]
        same = np.ones(len(begin), dtype=bool)
        for k in range(self.m):
            same[same] = words[begin[same] + k] == self.hashes[which[same], k]
        begin, which = begin[same], which[same]
        exact = [b" ".join(plain[s:e].split()) == self.texts[w] for s, e, w in zip(start[begin].tolist(), end[begin + self.m - 1].tolist(), which.tolist(), strict=True)]
        return begin[exact], which[exact]


class Part:
    """The strings of some items by length, and which items each of them is from."""

    def __init__(self, items: list[str], texts: list[bytes], window: int):
        self.names, item = np.unique(np.array(items, dtype=object), return_inverse=True) if items else (np.zeros(0, object), np.zeros(0, np.int64))
        data, at = common.joined(texts)
        plain, start, end, words = plain_words(data)
        first = np.searchsorted(start, at)
        count = np.diff(first)
        self.strings: list[Strings] = []
        self.items: list[tuple[np.ndarray, np.ndarray]] = []  # for each string, where its items begin, and they
        for m in sorted({min(window, int(n)) for n in count if n}):
            long = (count >= m) if m == window else (count == m)
            n = np.where(long, count - m + 1, 0)
            begin = np.repeat(first[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            owner = np.repeat(item, n)
            texts_of = [b" ".join(plain[s:e].split()) for s, e in zip(start[begin].tolist(), end[begin + m - 1].tolist(), strict=True)]
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(t, len(number)) for t in texts_of], dtype=np.int64)
            where = np.zeros(len(number), dtype=np.int64)
            where[which[::-1]] = begin[::-1]
            self.strings.append(Strings(m, words[where[:, None] + np.arange(m)], list(number)))
            pairs = np.unique(np.stack([which, owner], axis=1), axis=0)
            self.items.append((np.searchsorted(pairs[:, 0], np.arange(len(number) + 1)), pairs[:, 1]))

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Words of each text; for each text the numbers of the items that it holds; first and last + 1 of each hit word run."""
        data, at = common.joined(texts)
        plain, start, end, words = plain_words(data)
        first = np.searchsorted(start, at)
        count = np.diff(first)
        left = np.repeat(first[1:], count) - np.arange(len(start))
        edge = np.zeros(len(start) + 1, dtype=np.int32)
        held: list[list[np.ndarray]] = [[] for _ in texts]
        for strings, (of, item) in zip(self.strings, self.items, strict=True):
            begin, which = strings.search(words, left, plain, start, end)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + strings.m, -1)
            doc = np.searchsorted(first, begin, side="right") - 1
            seen = np.unique(doc * len(strings.texts) + which)  # each string once a document
            for d, w in zip((seen // max(1, len(strings.texts))).tolist(), (seen % max(1, len(strings.texts))).tolist(), strict=True):
                held[d].append(item[of[w] : of[w + 1]])
        hit = np.diff(np.concatenate([[0], np.cumsum(edge)[:-1] > 0, [0]]).astype(np.int8))
        return first, [np.unique(np.concatenate(h)) if h else np.zeros(0, np.int64) for h in held], np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)


def _parts(benchmark: DataFrame, window: int, item: str, text: str) -> Iterator[Part]:
    """The items in parts of bounded size, one at a time through the driver."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, texts in common.text_groups(batches):
            rows = []
            for name, t in zip(names, texts, strict=True):
                words = t.translate(PLAIN).split()
                step = PIECE - window + 1
                rows += [(name or "", at, b" ".join(words[at : at + PIECE])) for at in range(0, max(1, len(words) - window + 1), step) if words]
            yield pa.record_batch({"item": pa.array([r[0] for r in rows], pa.string()), "at": pa.array([r[1] for r in rows], pa.int64()), "words": pa.array([r[2] for r in rows], pa.binary())})

    pieces = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).mapInArrow(cut, "item string, at long, words binary")
    size = pieces.agg(F.sum(F.octet_length("words") + F.coalesce(F.octet_length("item"), F.lit(0)) + 16)).first()[0] or 0
    n = max(1, -(-size // PART_BYTES))
    for i in range(n):
        own = pieces.where(F.pmod(F.xxhash64("item", "at"), F.lit(n)) == i).toArrow()  # about PART_BYTES
        rows = sorted(zip(own["item"].to_pylist(), own["at"].to_pylist(), own["words"].to_pylist(), strict=True))
        yield Part([r[0] for r in rows], [r[2] for r in rows], window)


def _items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, n_words, n_hit, items, hits): for each document the items it holds, sorted by name, and the runs [first word, last word + 1] that they hit."""
    context = docs.sparkSession.sparkContext
    parts = [context.broadcast(p) for p in _parts(benchmark, window, item, item_text)]  # PART_BYTES of item text each
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    shape = "id long, n_words long, items array<string>, hits array<array<long>>"

    def search(part):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, texts in common.text_groups(batches):
                first, held, begin, end = part.value.hits(texts)
                doc = np.searchsorted(first, begin, side="right") - 1
                # A run may go on from one document into the next: cut it there.
                runs: list[list[list[int]]] = [[] for _ in ids]
                for d, b, e in zip(doc.tolist(), begin.tolist(), end.tolist(), strict=True):
                    while b < e:
                        to = min(e, int(first[d + 1]))
                        if to > b:
                            runs[d].append([b - int(first[d]), to - int(first[d])])
                        b, d = to, d + 1
                names = [[part.value.names[i] for i in h] for h in held]
                yield pa.record_batch({"id": pa.array(ids, pa.int64()), "n_words": np.diff(first), "items": pa.array([sorted(n) for n in names], pa.list_(pa.string())), "hits": pa.array(runs, pa.list_(pa.list_(pa.int64())))})

        return run

    if len(parts) == 1:
        found = rows.mapInArrow(search(parts[0]), shape)
        return found.select(F.col("id").alias(key), "n_words", "items", "hits")
    keyed = common.written(rows.select(F.monotonically_increasing_id().alias("row"), "id", "text"), "zstd")
    each = [keyed.select("row", "text").mapInArrow(search(p), shape).where(F.size("items") > 0) for p in parts]
    together = reduce(DataFrame.unionByName, each).groupBy("id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))  # at most a row a part
    counted = keyed.select("row", "text").mapInArrow(_count_words, "row long, n_words long").join(together.withColumnRenamed("id", "row"), "row", "left")
    none = lambda c, of: F.coalesce(c, F.array().cast(of)).alias(c)
    return keyed.select("row", "id").join(counted, "row").select(F.col("id").alias(key), "n_words", none("items", "array<string>"), _merged(F.coalesce("hits", F.array().cast("array<array<bigint>>"))).alias("hits"))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in common.text_groups(batches):
        data, at = common.joined(texts)
        yield pa.record_batch({"row": pa.array(ids, pa.int64()), "n_words": np.diff(np.searchsorted(plain_words(data)[1], at))})


def _merged(runs):
    """Sorted runs of several parts without overlaps."""
    grow = lambda have, r: F.when((F.size(have) > 0) & (r[0] <= F.element_at(have, -1)[1]), F.concat(F.slice(have, 1, F.size(have) - 1), F.array(F.array(F.element_at(have, -1)[0], F.greatest(F.element_at(have, -1)[1], r[1]))))).otherwise(F.concat(have, F.array(r)))
    return F.aggregate(runs, F.array().cast("array<array<bigint>>"), grow)


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    out = decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_LIST = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_LIST.format("text")} AS w FROM documents),
b AS (SELECT item_id, {_LIST.format("text")} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS m FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT m, item_id, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM sized)),
places AS (SELECT row, m, i, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT row, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT m FROM sized) WHERE len(w) >= m)),
found AS (SELECT row, p.m, i, item_id FROM places p JOIN windows x ON p.m = x.m AND p.s = x.s),
hit AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(i, i + m)) AS place FROM found) GROUP BY 1),
items AS (SELECT row, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT row, coalesce(CAST(item_id AS VARCHAR), '') AS name FROM found) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (row) LEFT JOIN items USING (row)
"""
