"""MinHash near-dedup by fast similarity sketching.

A document's set of word shingles fills ``t`` bins in rounds: in each of the
first t rounds every shingle is thrown into one random bin, in round t + i all
go into bin i, so every bin is filled after 2t rounds at the latest; a bin keeps
the least (round, hash).  Runs of bins make band keys, and documents that share
a band are compared on their full sets.

No pairs are made within a group.  Documents of one set are one class.  In a
band, every class is compared with the band's first one; the confirmed links
give components.  Where a band still holds several components, the members
outside the largest (strays) are compared with those of other components, so
each pair that shares a band is either compared or joined already.  In large
bands this is done block by block, without a row for each pair.

A link of similarity 0.8 shares none of the 40 bands of 5 bins with a
probability of 1.3e-7; a pair of similarity 0.5 shares one with a probability of
72 %, one of 0.3 with 9 %.

Nulls: a null or empty text has an empty set and is linked with nothing.  Ids
should be unique and not null; repeated ids are judged on their united rows'
smallest class.  Ties don't matter: a component is named by its smallest id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm import common

BINS, BAND = 200, 5
#: Comparisons from which a band is compared in blocks, and the members of a block.
LARGE, BLOCK = 300, 400
#: Size of the broadcast filter of candidates: 16 bits for each, 16 MB in all at most.
FILTER_BITS = 1 << 27


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; of all words, if there are fewer."""
    data, at = common.joined(texts)
    start, _, words = common.hash_words(data, lower=True)
    first = np.searchsorted(start, at).tolist()
    runs = common.window_hashes(words, width, 13)
    out = []
    for s, e in zip(first, first[1:], strict=False):
        if e - s >= width:
            out.append(np.unique(runs[s : e - width + 1]))
        else:
            out.append(common.window_hashes(words[s:e], e - s, 17) if e > s else np.zeros(0, np.uint64))
    return out


def sketch(items: np.ndarray, t: int = BINS) -> np.ndarray:
    """The least (round, hash) in each of t bins, as one number."""
    bits = max(1, (t - 1).bit_length())
    rounds = min(2 * t, max(1, int(t * (np.log(t) + 1.5) / len(items)) + 1))
    while True:
        i = np.arange(rounds, dtype=np.uint64)[:, None]
        with np.errstate(over="ignore"):
            h = common.mix(items[None, :] + i * np.uint64(0xA24BAED4963EE407), 21)
        bin_ = np.where(i < t, (h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32), i - np.uint64(min(t, rounds)) if rounds > t else 0)
        key = (bin_ << np.uint64(64 - bits) | i << np.uint64(54 - bits) | h & np.uint64((1 << (54 - bits)) - 1)).ravel()
        key.sort()
        at = np.searchsorted(key, np.arange(t, dtype=np.uint64) << np.uint64(64 - bits))
        if at[-1] < len(key) and np.array_equal(key[at] >> np.uint64(64 - bits), np.arange(t, dtype=np.uint64)):
            return key[at]
        rounds = min(2 * t, 2 * rounds)


def bands(values: np.ndarray, width: int = BAND) -> np.ndarray:
    """A key for each run of ``width`` bins."""
    rows = values.reshape(-1, width)
    with np.errstate(over="ignore"):
        weight = common.powers(common._Q, width)[:width]
        return common.mix((common.mix(rows, 3) * weight).sum(1, dtype=np.uint64) + np.arange(len(rows), dtype=np.uint64), 5)


def components(links: DataFrame) -> DataFrame:
    """(id, component): for ids in links (a, b), the smallest id reachable; min label and pointer jumping."""
    both = common.checkpointed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = common.checkpointed(both.groupBy("a").agg(F.least("a", F.min("b")).alias("c")))
    while True:
        near = both.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("c").alias("n"))
        least = label.join(near, "a", "left").select("a", "c", F.least("c", "n").alias("m"))
        jump = label.select(F.col("a").alias("m"), F.col("c").alias("j"))
        after = common.checkpointed(least.join(jump, "m", "left").select("a", F.least("m", "j").alias("d"), (F.least("m", "j") != F.col("c")).alias("moved")))
        label = after.select("a", F.col("d").alias("c"))
        if after.where("moved").isEmpty():
            return label.select(F.col("a").alias("id"), F.col("c").alias("component"))


def _maybe(ids: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A test of xxhash64(id) that all ids of a table pass and, of others, few while the filter is not full."""
    bits = min(FILTER_BITS, max(1 << 10, 1 << (16 * ids.count()).bit_length()))
    at = ids.select(F.pmod(F.xxhash64("id"), F.lit(bits)).alias("at"))
    rows = at.selectExpr("shiftright(at, 6) AS k", "shiftleft(1L, cast(at % 64 AS int)) AS v").groupBy("k").agg(F.bit_or("v").alias("v")).toArrow()
    words = np.zeros(bits // 64, dtype=np.int64)
    words[rows["k"].to_numpy()] = rows["v"].to_numpy()
    held = ids.sparkSession.sparkContext.broadcast(words)
    return lambda h: held.value[(h % bits) >> 6] >> (h % bits & 63) & 1 == 1


def _candidate_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, s): the shingle sets of the wanted ids, written."""
    maybe = _maybe(wanted)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select([0, 1]).filter(pa.array(maybe(batch.column(2).to_numpy()), pa.bool_()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.text_groups(batches):
            yield pa.record_batch({"id": pa.array(ids, pa.int64()), "s": pa.array([x.tobytes() for x in shingle_sets(texts, width)], pa.binary())})

    few = docs.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(some, "id long, text string")
    return common.written(few.join(wanted, "id", "left_semi").mapInArrow(sets, "id long, s binary"), "zstd")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                n, m = len(x) // 8, len(y) // 8
                if 100 * min(n, m) < percent * max(n, m):
                    keep.append(False)
                    continue
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort()
                common_n = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common_n >= percent * (n + m - common_n))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    with_both = with_a.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return with_both.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")


def _large_bands(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of strays and members of other components that seem similar, on sets folded to 32 bits.

    A band's strays and members are dealt to blocks, and each pair of blocks is
    one small task.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = [np.unique((np.frombuffer(x, np.uint64) >> np.uint64(32)).astype(np.uint32)).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.record_batch({"id": batch.column(0), "s": pa.array(folded, pa.binary())})

    def compare(rows: pa.Table) -> pa.Table:
        ids, c = rows["id"].to_numpy(), rows["c"].to_numpy()
        side = rows["as_stray"].to_numpy(zero_copy_only=False).astype(bool)
        sets = [np.frombuffer(x, np.uint32) for x in rows["s"].to_pylist()]
        size = np.array([len(x) for x in sets])
        _, back = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.concatenate([[0], np.cumsum(size)])
        members = np.flatnonzero(~side)
        of = np.concatenate([back[at[i] : at[i + 1]] for i in members]) if len(members) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(members)), size[members])
        mark = np.zeros(len(back) + 1, dtype=bool)
        a, b = [], []
        for x in np.flatnonzero(side):
            own = back[at[x] : at[x + 1]]
            mark[own] = True
            n = np.bincount(owner[mark[of]], minlength=len(members))
            mark[own] = False
            near = members[(100 * n >= (percent - 2) * (size[members] + size[x] - n)) & (c[members] != c[x])]
            a.append(np.minimum(ids[near], ids[x]))
            b.append(np.maximum(ids[near], ids[x]))
        found = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b)]
        return pa.table({"a": found[0], "b": found[1]})

    few = sets.join(mixed.select("id").distinct(), "id", "left_semi").mapInArrow(fold, "id long, s binary")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    deal = lambda n: F.pmod(F.xxhash64("id"), blocks(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    columns = ["band", "id", "c"]
    strays = mixed.where("stray").select(*columns, F.lit(True).alias("as_stray"), deal(F.col("strays")).alias("p"), each(F.col("m")).alias("q"))
    members = mixed.select(*columns, F.lit(False).alias("as_stray"), each(F.col("strays")).alias("p"), deal(F.col("m")).alias("q"))
    return strays.unionByName(members).join(few, "id").groupBy("band", "p", "q").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept): one row a document; kept is its component's smallest id."""
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, group in common.text_groups(batches):
            sets = shingle_sets(group, width)
            weight = [common.mix(x, 31) for x in sets]
            with np.errstate(over="ignore"):
                one = np.array([x.sum(dtype=np.uint64) for x in sets], dtype=np.uint64)
                two = np.array([common.mix(x, 32).sum(dtype=np.uint64) for x in weight], dtype=np.uint64)
            keys = [bands(sketch(x)).view(np.int64) if len(x) else np.zeros(0, np.int64) for x in sets]
            yield pa.record_batch({
                "id": pa.array(ids, pa.int64()),
                "n": np.array([len(x) for x in sets], dtype=np.int64),
                "h1": one.view(np.int64),
                "h2": two.view(np.int64),
                "bands": pa.array(keys, pa.list_(pa.int64())),
            })

    described = common.written(texts.mapInArrow(describe, "id long, n long, h1 long, h2 long, bands array<long>"), "zstd")
    # Documents of one set are one class, named by its smallest id.
    of_set = described.where("n > 0").groupBy("n", "h1", "h2")
    banded = of_set.agg(F.min("id").alias("id"), F.first("bands").alias("bands")).where("id is not null").select(F.explode("bands").alias("band"), "id")
    # Written, so that the join below reads plain exchanges and Spark can split a frequent band.
    counted = common.written(banded.groupBy("band").agg(F.count("*").alias("m"), F.min("id").alias("a")).where("m > 1"), "zstd")
    shared = common.written(banded.join(counted, "band"), "zstd")
    stars = common.checkpointed(shared.where("a < id").select("a", F.col("id").alias("b")).distinct())
    sets = _candidate_sets(texts, shared.select("id").distinct(), width)
    links = common.checkpointed(_confirm(stars, sets, percent))
    known = components(links)
    # Bands that still hold several components.
    labelled = shared.join(known, "id", "left").select("band", "id", "m", F.coalesce("component", "id").alias("c"))
    sizes = labelled.groupBy("band", "c").agg(F.count("*").alias("n")).groupBy("band").agg(F.count("*").alias("parts"), F.max_by("c", "n").alias("main"), (F.sum("n") - F.max("n")).alias("strays"))
    mixed = labelled.join(sizes.where("parts > 1"), "band").withColumn("stray", F.col("c") != F.col("main"))
    mixed = common.checkpointed(mixed.drop("main", "parts"))
    large = F.col("m") * F.col("strays") >= LARGE
    few = mixed.where(~large)
    other = few.select("band", F.col("id").alias("y"), F.col("c").alias("cy"), F.col("stray").alias("y_stray"))
    crossed = few.where("stray").select("band", F.col("id").alias("x"), F.col("c").alias("cx")).join(other, "band").where("cx <> cy and (not y_stray or x < y)")
    pairs = crossed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = pairs.unionByName(_large_bands(mixed.where(large), sets, percent)).distinct().join(stars, ["a", "b"], "left_anti")
    more = common.checkpointed(_confirm(common.checkpointed(pairs), sets, percent))
    for table in (sets, shared, counted):
        common.forget(table)
    final = known if more.isEmpty() else components(links.unionByName(more))
    classes = common.checkpointed(of_set.agg(F.min("id").alias("class")))
    named = described.select("id", "n", "h1", "h2").join(classes, ["n", "h1", "h2"], "left")
    out = named.join(final.withColumnRenamed("id", "class"), "class", "left")
    component = F.coalesce("component", "class", "id")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return near_duplicates(common.table(spark, sf_dir, "documents"), width=2)


OP5_SQL = r"""
WITH RECURSIVE low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS pos FROM low),
two AS (SELECT doc_id, pos, word, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM words),
sets AS (SELECT DISTINCT doc_id, CASE WHEN after IS NULL THEN word ELSE word || ' ' || after END AS s FROM two WHERE after IS NOT NULL OR pos = 1),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
arcs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT a, b FROM arcs UNION SELECT r.id, l.b FROM reach r JOIN arcs l ON l.a = r.other),
least_id AS (SELECT id, min(other) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, component_id = d.doc_id AS kept
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN least_id l ON l.id = d.doc_id
"""
