"""Periodic runs of words by an enhanced suffix array: branching tandem repeats.

A *run* is a stretch of words with smallest period q, of at least ``least`` words and
``times`` periods, that can't be extended.  Inside each document:

1. suffixes are sorted by prefix doubling; documents in which no sequence of
   ``need`` words comes twice can't hold a run, and end here;
2. LCP values: those that follow from the one before by taking a word away are not
   compared, all others are (their sum is bounded by n log n);
3. one pass over the LCP values finds its intervals (depth, left, right) and their
   children; there are no tree nodes;
4. for each suffix i of all children but the largest, ISA[i + depth] and
   ISA[i - depth] are looked up: inside the interval and outside the own child, they
   make a branching square of period depth (any suffix is in a smaller child only
   log n times);
5. a square is rotated to the left as long as the words agree: that is the run, as
   it branches at its right end.  Squares of the same end inside a run of a smaller
   period are multiples of it and merge into it.

Words are equal when their 64-bit hashes are.  Work and memory are in
proportion to n log n and n for n words, whatever the texts.

Nulls: a null text has no words; a null id is kept.  Repeated rows and ids count as
separate documents.  Texts without words have no runs and an empty rest; an empty
table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm import common

Run = tuple[int, int, int]


def _regroup(rank: np.ndarray, at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Orders the suffixes ``at`` inside their groups by ``after``, updates their ranks, and returns those still in groups of two or more."""
    key = rank[at] * (len(rank) + 2) + after
    order = np.argsort(key)
    at, key = at[order], key[order]
    group = rank[at]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    opens = np.concatenate([[True], group[1:] != group[:-1]])
    place = np.arange(len(at))
    rank[at] = group + (np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(opens, place, 0)))
    size = np.diff(np.append(np.flatnonzero(new), len(at)))
    return at[np.repeat(size > 1, size)]


def _doubled(rank: np.ndarray, at: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
    """From ranks by ``width`` words to ranks by twice as many; ``last`` is the end of each word's document."""
    to = at + width
    return _regroup(rank, at, np.where(to < last[at], rank[np.minimum(to, len(rank) - 1)] + 1, 0))


def suffix_ranks(words: np.ndarray, first: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank of each suffix among all, documents one after the other (0.. in ``first``), of the documents in which ``need`` words come twice; their numbers; each word's document end.

    In other documents, ranks are by less than the whole suffix.
    """
    n, count = len(words), np.diff(first)
    last = np.repeat(first[1:], count)
    rank = np.repeat(first[:-1], count)  # groups begin as whole documents
    _, code = np.unique(words, return_inverse=True)
    at, width = np.arange(n), 1
    at = _regroup(rank, at, code + 1) if n else at
    while 2 * width <= need and len(at):
        at = _doubled(rank, at, last, width)
        width *= 2
    kept = np.unique(np.searchsorted(first, at, side="right") - 1)
    while len(at):
        at = _doubled(rank, at, last, width)
        width *= 2
    return rank, kept, last


def _common_length(words: np.ndarray, a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many words agree from a and from b > a on, up to the end; both are compared in step, long agreements block by block."""
    length = np.zeros(len(a), dtype=np.int64)
    live, step = np.flatnonzero(b < end), 0
    while len(live) and step < 32:
        same = words[a[live] + step] == words[b[live] + step]
        length[live[same]] += 1
        live, step = live[same], step + 1
        live = live[b[live] + step < end[live]]
    for i in live.tolist():
        x, y, stop, block = int(a[i]) + step, int(b[i]) + step, int(end[i]), 64
        while y < stop:
            block = min(block, stop - y)
            differ = words[x : x + block] != words[y : y + block]
            k = int(differ.argmax())
            if differ[k]:
                x, y = x + k, y + k
                break
            x, y, block = x + block, y + block, 2 * block
        length[i] = y - int(b[i])
    return length


def lcp_values(words: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """LCP of neighbours in the suffix array of one document; the first is 0."""
    n = len(sa)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    one_back = np.where((place > 0) & (before > 0), words[np.maximum(place, 1) - 1] == words[np.maximum(before, 1) - 1], False)
    lead = np.flatnonzero(~one_back & (before >= 0))  # irreducible: to be compared
    low, high = np.minimum(lead, before[lead]), np.maximum(lead, before[lead])
    plcp = np.zeros(n, dtype=np.int64)
    plcp[lead] = _common_length(words, low, high, np.full(len(lead), n))
    from_ = np.maximum.accumulate(np.where(~one_back, place, 0))
    plcp = np.where(one_back, np.maximum(plcp[from_] - (place - from_), 0), plcp)
    return plcp[sa]


def _intervals(lcp: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Depth, left and right of each LCP interval of depth 1 or more, and each value's interval (-1: none), from one pass with a stack."""
    depth: list[int] = []
    left: list[int] = []
    right: list[int] = []
    owner = [-1] * len(lcp)
    stack: list[int] = []
    for k, h in enumerate(lcp):
        edge = k - 1
        while stack and depth[stack[-1]] > h:
            top = stack.pop()
            right[top], edge = k - 1, left[top]
        if h:
            if not stack or depth[stack[-1]] < h:
                stack.append(len(depth))
                depth.append(h)
                left.append(edge)
                right.append(-1)
            owner[k] = stack[-1]
    for top in stack:
        right[top] = len(lcp) - 1
    return tuple(np.array(x, dtype=np.int64) for x in (depth, left, right, owner))  # type: ignore[return-value]


def branching_squares(words: np.ndarray, sa: np.ndarray, isa: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of the squares that can't be moved to the right, with periods that leave room for ``times`` of them."""
    n = len(sa)
    depth, left, right, owner = _intervals(lcp_values(words, sa).tolist())
    cut = np.flatnonzero(owner >= 0)
    cut = cut[times * depth[owner[cut]] <= n]
    cut = cut[np.argsort(owner[cut], kind="stable")]  # places between children, by interval
    own = owner[cut]
    if not len(own):
        return own, own
    opens = np.concatenate([[True], own[1:] != own[:-1]])
    shuts = np.concatenate([opens[1:], [True]])
    # Children: the one left of each cut, and behind an interval's last cut one more.
    from_ = np.concatenate([np.where(opens, left[own], np.concatenate([[0], cut[:-1]])), cut[shuts]])
    to = np.concatenate([cut - 1, right[own[shuts]]])
    of = np.concatenate([own, own[shuts]])
    size = to - from_ + 1
    by_size = np.lexsort((size, of))
    largest = by_size[np.concatenate([of[by_size][1:] != of[by_size][:-1], [True]])]
    small = np.ones(len(of), dtype=bool)
    small[largest] = False
    from_, to, of, size = from_[small], to[small], of[small], size[small]
    child = np.repeat(np.arange(len(of)), size)
    i = sa[np.repeat(from_, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    d = depth[of][child]
    starts, periods = [], []
    for j, begin in ((i + d, i), (i - d, i - d)):
        inside = (j >= 0) & (j < n)
        r = isa[np.where(inside, j, 0)]
        there = inside & (r >= left[of][child]) & (r <= right[of][child]) & ((r < from_[child]) | (r > to[child]))
        starts.append(begin[there])
        periods.append(d[there])
    both = np.unique(np.stack([np.concatenate(starts), np.concatenate(periods)], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def _rotated(words: np.ndarray, start: int, period: int) -> int:
    """The first place to which the square can be moved to the left."""
    block = 16
    while start > 0:
        block = min(block, start)
        differ = words[start - block : start][::-1] != words[start - block + period : start + period][::-1]
        k = int(differ.argmax())
        if differ[k]:
            return start - k
        start, block = start - block, 2 * block
    return start


def document_runs(words: np.ndarray, rank: np.ndarray, least: int, times: int) -> list[Run]:
    """(start, length, period) of a document's runs by start and period; ``rank`` is the inverse suffix array."""
    sa = np.empty(len(rank), dtype=np.int64)
    sa[rank] = np.arange(len(rank))
    start, period = branching_squares(words, sa, rank, times)
    end = start + 2 * period
    runs: list[Run] = []
    here, same_end = -1, []
    for k in np.lexsort((period, end)).tolist():
        s, q, e = int(start[k]), int(period[k]), int(end[k])
        if e != here:
            here, same_end = e, []
        if any(q % p == 0 and first <= s for first, p in same_end):
            continue  # a multiple of a smaller period
        first = _rotated(words, s, q)
        same_end.append((first, q))
        if e - first >= max(least, times * q):
            runs.append((first, e - first, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def find_runs(texts: list[bytes], least: int = 24, times: int = 3) -> tuple[np.ndarray, dict[int, list[Run]]]:
    """Number of words of each text, and the runs of those texts that have any."""
    data, at = common.joined(texts)
    start, _, words = common.hash_words(data)
    first = np.searchsorted(start, at)
    # From a run's first word and one period later the same words come: so many at least.
    need = min(max(least - q, (times - 1) * q) for q in range(1, least + 1))
    rank, kept, _ = suffix_ranks(words, first, need)
    found = {}
    for d in kept.tolist():
        a, b = int(first[d]), int(first[d + 1])
        if runs := document_runs(words[a:b], rank[a:b] - a, least, times):
            found[d] = runs
    return np.diff(first), found


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, runs, collapsed): each document's runs (start, length, period), and its words, joined by one space, without those behind a run's first period."""
    if least < 2 or times < 2:
        raise ValueError("a run has at least two words and two periods")
    shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.text_groups(batches):
            count, found = find_runs(texts, least, times)
            collapsed = []
            for d, t in enumerate(texts):
                words = t.split()
                if d in found:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    for s, length, q in found[d]:
                        edge[s + q] += 1
                        edge[s + length] -= 1
                    words = list(compress(words, np.cumsum(edge)[:-1] == 0))
                collapsed.append(b" ".join(words))
            runs = [[{"start": s, "length": n, "period": q} for s, n, q in found.get(d, ())] for d in range(len(texts))]
            yield pa.record_batch({key: pa.array(ids, pa.int64()), "n_words": count, "runs": pa.array(runs, shape), "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string())})

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"{key} long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def best_run(runs: list[Run]) -> Run | None:
    """The run of greatest length by period; ties by start, then period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def with_planted_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): in about a tenth of the documents, by a hash of the id, the words from some place on repeat with a period; other texts, and those without an id, stay."""
    h = F.crc32(F.col(key).cast("string"))
    g, words = F.floor(h / 10), F.regexp_extract_all(F.col(text), F.lit("([^\\x20\\x09-\\x0D]+)"))
    n = F.size("_w")
    a = F.col("_g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("_g") % 8))
    # Word i is the original word min(i, a + (i - a) mod p).
    repeated = F.transform("_w", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.element_at("_w", (F.col("_a") + F.pmod(i - F.col("_a"), F.col("_p")) + 1).cast("int"))))
    planted = docs.select(F.col(key), F.col(text), F.when(h % 10 == 0, words).alias("_w"), g.alias("_g")).withColumn("_a", F.when(n > 0, a)).withColumn("_p", F.when(n > 0, p))
    return planted.select(key, F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col(text)).alias(text))


def _best(runs: Column) -> Column:
    """As ``best_run``, on a column: exact, by cross products."""
    better = lambda r, b: r["length"] * b["period"] > b["length"] * r["period"]  # noqa: E731  # runs come by start and period: ties keep the first
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda b, r: F.when(better(r, b), r).otherwise(b))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    out = periodic_runs(with_planted_runs(common.table(spark, sf_dir, "documents"))).withColumn("b", _best(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("b.start").alias("start"), F.col("b.length").alias("length"), F.col("b.period").alias("period"),
        F.expr("1000 * b.length div b.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
