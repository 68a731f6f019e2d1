"""Shared helpers: Arrow batches cut by bytes, vectorised word hashes, chunks.

A *chunk* is a few megabytes of whole documents in one row, compressed.  An
operator that has to ask a corpus-wide question about every word or window asks
it once per chunk and distinct key, so a key that fills a third of the corpus
makes at most one row a chunk, and answers return to the chunk, not to a key.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raw bytes of text that one chunk holds before it is closed.
CHUNK_BYTES = 2 << 20
#: Bytes of text hashed at a time.
BLOCK_BYTES = 4 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240117))
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_Q = 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows, as one row may be a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, BLOCK_BYTES + 1 if n > 1 << 16 else 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hash_block(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = np.ones(len(buf) + 2, dtype=np.int8)
    space[1:-1] = _SPACE[buf]
    edge = np.diff(space)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    forward, back = powers(_P, len(buf)), powers(pow(_P, -1, 1 << 64), len(buf))
    with np.errstate(over="ignore"):
        total = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[buf] * forward[: len(buf)], out=total[1:])
        return start, end, mix((total[end] - total[start]) * back[start])


def hash_words(data: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (byte offsets) and 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+``."""
    buf = np.frombuffer(data, dtype=np.uint8)
    if lower:
        buf = LOWER[buf]
    parts, at = [], 0
    while at < len(buf):
        to = min(len(buf), at + BLOCK_BYTES)
        while to < len(buf) and not _SPACE[buf[to]]:  # a block ends where a word does
            ahead = np.flatnonzero(_SPACE[buf[to : to + BLOCK_BYTES]])
            to = to + int(ahead[0]) if len(ahead) else min(len(buf), to + BLOCK_BYTES)
        s, e, h = _hash_block(buf[at:to])
        parts.append((s + at, e + at, h))
        at = to
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each of the spans, which are sorted and don't overlap."""
    out, i = np.empty(len(start), dtype=np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + BLOCK_BYTES)))
        base, size = int(start[i]), int(end[j - 1] - start[i])
        forward, back = powers(_P, size), powers(pow(_P, -1, 1 << 64), size)
        with np.errstate(over="ignore"):
            total = np.zeros(size + 1, dtype=np.uint64)
            np.cumsum(_VALUE[buf[base : base + size]] * forward[:size], out=total[1:])
            out[i:j] = mix((total[end[i:j] - base] - total[start[i:j] - base]) * back[start[i:j] - base])
        i = j
    return out


def window_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` words; a run's hash depends on its words alone."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    forward, back = powers(_Q, len(words)), powers(pow(_Q, -1, 1 << 64), len(words))
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(mix(words, seed + 1) * forward[: len(words)], out=total[1:])
        return mix((total[width:] - total[:n]) * back[:n], seed)


def text_groups(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """(doc ids, UTF-8 texts) of about ``limit`` bytes each; a null text is empty."""
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            ids.append(key)
            texts.append(text or b"")
            size += len(texts[-1]) + 16
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Texts with a line end after each, and where each begins (one more at the end)."""
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return b"\n".join(texts) + b"\n" if texts else b"", at


def _squeeze(ids: list, texts: list[bytes]) -> bytes:
    rows = pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_binary())})
    out = io.BytesIO()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as to:
        to.write_batch(rows)
    return out.getvalue()


def unpack(blob: bytes) -> tuple[list, list[bytes]]:
    rows = pa.ipc.open_stream(blob).read_all()
    return rows["doc_id"].to_pylist(), rows["text"].to_pylist()


def to_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(chunk, blob): whole documents packed into compressed rows, dealt out by chunk.

    Chunk ids come from the input partition and a counter over its sorted rows, so a
    lost task makes the same ones again, in whatever order its input arrives.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for i, (ids, texts) in enumerate(text_groups(batches)):
            yield pa.record_batch({"chunk": pa.array([part + i], pa.int64()), "blob": pa.array([_squeeze(ids, texts)], pa.binary())})

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).sortWithinPartitions("id", "text")
    return rows.mapInArrow(pack, "chunk long, blob binary").repartition("chunk")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset and all is local, a temporary one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        given = sc.getConf().get("spark.checkpoint.dir")
        if not given and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not given:
            import tempfile

            given = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(given)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """The rows as a Parquet table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path, compression=compression)
    table = df.sparkSession.read.parquet(path)
    table._written = path
    return table


def forget(table: DataFrame) -> None:
    """Delete a table made by ``written``, once nothing reads it any more."""
    spark = table.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._written)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order of appearance, where each is first, and each value's number (by hashing, not sorting)."""
    back, distinct = pd.factorize(values)
    first = np.flatnonzero(np.diff(np.maximum.accumulate(back), prepend=-1) > 0) if len(back) else np.zeros(0, np.int64)
    return distinct, first, back


def distinct_sums(codes: np.ndarray, held: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes with their counts, added to those counted before."""
    values, n = np.unique(codes, return_counts=True)
    if held is None:
        return values, n
    all_values, back = np.unique(np.concatenate([held[0], values]), return_inverse=True)
    total = np.zeros(len(all_values), dtype=np.int64)
    np.add.at(total, back, np.concatenate([held[1], n]))
    return all_values, total


def thinned(df: DataFrame, column: str, rows: int) -> DataFrame:
    """About ``rows`` rows to train on, by a hash of a column, so that their number is bounded; all if there are fewer."""
    every = max(1, df.count() // rows)
    return df.where(F.pmod(F.xxhash64(column), F.lit(every)) == 0)


def least_hashes(df: DataFrame, column: str, rows: int) -> DataFrame:
    """The ``rows`` rows of least hash among some that were chosen by hash."""
    return thinned(df, column, 4 * rows).orderBy(F.xxhash64(column), column).limit(rows)
