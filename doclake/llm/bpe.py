"""Byte-pair encoding by per-prefix dynamic programming, and decoding.

For every prefix of a piece exactly one vocabulary token can end its encoding.
An automaton over the vocabulary lists the tokens that end at each byte; of
these, the one that starts the prefix, or is compatible with the last token of
the prefix before it, is stored.  Following the stored tokens back gives the
ids that merging by rank would give.

Two tokens are compatible when no merge crosses their border before both are
complete; this is found by undoing merges on the border, latest first.

Nulls: a null text encodes as the empty text.  An id outside the vocabulary
decodes to nothing.  Ids (null ones too), ties and repeated rows pass through as
they are.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm import common

BYTE_BPE = "byte_bpe_50k.json"
#: Entries that each of a worker's lookups holds before it starts afresh.
CACHE_ENTRIES = 300_000

_S = r"\t-\r \x85\xa0  -     　"
#: How the public vocabulary cuts text into pieces (fixed pattern).
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_TWO_SPACES = re.compile(r"\s\s")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class BytePairs:
    """A byte-level vocabulary with its merges."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte_of = spec["model"], {x: bytes([b]) for b, x in enumerate(byte_letters())}
        self.text = {i: b"".join(byte_of[c] for c in t) for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.text |= {i: t.encode() for t, i in self.special.items()}
        self.length = {i: len(t) for i, t in self.text.items()}
        vocab = model["vocab"]
        #: (left, right) -> rank; token -> (rank, left, right), a single byte has rank -1.
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(model["merges"]):
            self.rank[vocab[a], vocab[b]] = r
            self.made.setdefault(vocab[a + b], (r, vocab[a], vocab[b]))
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            if i not in self.special.values():
                self.automaton.add_word(self.text[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self._fits: dict[int, bool] = {}
        self._split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = _Lookup(self._encode_piece)
        self.parts = _Lookup(self._encode_part)

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= CACHE_ENTRIES:
                self._fits.clear()
            known = self._fits[key] = self._undo(a, b)
        return known

    def _undo(self, a: int, b: int) -> bool:
        """Undo merges at the border, latest first; a cross merge of lower rank spoils the pair."""
        rank, made = self.rank, self.made
        until = 1 << 60  # the rank of the merge undone last; on the right, an equal rank comes later
        while True:
            if (r := rank.get((a, b))) is not None and r < until:
                return False
            ra, rb = made[a][0] if a in made else -1, made[b][0] if b in made else -1
            if ra < 0 and rb < 0:
                return True
            # What was made later is taken apart first; of equal ranks the right one, as merging goes left to right.
            if ra > rb:
                until, a = ra, made[a][2]
            else:
                until, b = rb + 1, made[b][1]

    def _encode_piece(self, piece: str) -> bytes:
        data = piece.encode()
        if len(data) == 1:
            return pack("<i", next(i for _, i in self.automaton.iter(data.decode("latin-1"))))
        last = [-1] * len(data)
        length, fits, known = self.length, self.compatible, self._fits
        for end, token in self.automaton.iter(data.decode("latin-1")):
            if last[end] < 0:
                start = end + 1 - length[token]
                if start:
                    before = last[start - 1]
                    if before < 0:
                        continue
                    fit = known.get(before << 32 | token)
                    if not (fits(before, token) if fit is None else fit):
                        continue
                last[end] = token
        out, at = [], len(data)
        while at > 0:
            out.append(last[at - 1])
            at -= length[last[at - 1]]
        return pack(f"<{len(out)}i", *reversed(out))

    def _encode_part(self, part: str) -> bytes:
        """A word with the space before it."""
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(" " + part)))

    def _plain(self, text: str) -> bytes:
        if _TWO_SPACES.search(text):
            return b"".join(map(self.pieces.__getitem__, PIECES.findall(text)))
        # With single spaces only, cutting before each space cuts between pieces.
        first, *rest = text.split(" ")
        return b"".join([*map(self.pieces.__getitem__, PIECES.findall(first)), *map(self.parts.__getitem__, rest)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        if self._split is None or not any(t in text for t in self.special):
            return self._plain(text)
        return b"".join(pack("<i", self.special[x]) if x in self.special else self._plain(x) if x else b"" for x in self._split.split(text))

    @property
    def decoder(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens' bytes, and where each id's begin and how many they are."""
        if not hasattr(self, "_decoder"):
            n = max(self.text) + 1
            size = np.array([len(self.text.get(i, b"")) for i in range(n)], dtype=np.int64)
            self._decoder = np.frombuffer(b"".join(self.text.get(i, b"") for i in range(n)), np.uint8), np.cumsum(size) - size, size
        return self._decoder

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Bytes of consecutive lists of ids; ``ends`` has where each list ends."""
        data, start, size = self.decoder
        ids = np.where((ids >= 0) & (ids < len(size)), ids, len(size))
        start, size = np.append(start, 0), np.append(size, 0)
        n = size[ids]
        to = np.cumsum(n)
        out = data[np.repeat(start[ids] - to + n, n) + np.arange(to[-1] if len(to) else 0)].tobytes()
        at = np.concatenate([[0], to])[np.concatenate([[0], ends])].tolist()
        return [out[a:b] for a, b in zip(at, at[1:], strict=False)]


class _Lookup(dict):
    """Remembers what a function gave; starts afresh when full."""

    def __init__(self, make):
        super().__init__()
        self._make = make

    def __missing__(self, key):
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self._make(key)
        if len(key) <= 64:
            self[key] = value
        return value


@cache
def vocabulary(path: str) -> BytePairs:
    return BytePairs(path)


def _path(path: str | None) -> str:
    return path or public_tokenizers.path(BYTE_BPE)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocab: str | None = None) -> DataFrame:
    """(key, ids): each text's token ids. ``vocab``: a file that every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(_path(vocab))
        for batch in batches:
            coded = [coder.encode(t or "") for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in coded)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), dtype="<i4")))
            yield pa.record_batch({key: batch.column(0), "ids": ids})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text)).mapInArrow(run, f"{key} {kind}, ids array<int>")


def decode(coded: DataFrame, key: str = "doc_id", ids: str = "ids", vocab: str | None = None) -> DataFrame:
    """(key, ids, text): ids as they came, and the text they spell; bad UTF-8 becomes U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(_path(vocab))
        for batch in batches:
            lists = batch.column(1)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            spelt = coder.decode(lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(size))
            texts = [x.decode("utf-8", "replace") for x in spelt]
            yield pa.record_batch({key: batch.column(0), "ids": lists, "text": pa.array(texts, pa.string())})

    kind = coded.schema[key].dataType.simpleString()
    return coded.select(key, F.col(ids).alias("ids")).mapInArrow(run, f"{key} {kind}, ids array<int>, text string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    coded = decode(encode(common.table(spark, sf_dir, "documents")))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
