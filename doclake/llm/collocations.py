"""Phrases whose words come together more often than apart, by multikey quicksort of suffix pointers.

A suffix is the words from a place on to the end of its piece, at most ``longest`` of
them.  Suffixes are sent by their leading words to tasks, which sort pointers to
them by three-way partitioning, one word at a time: the partition of pointers equal
to the pivot holds all occurrences of one phrase, so its size is the phrase's count,
and it is partitioned further by the next word.  Partitions below the least count
are abandoned, whether they are equal or not: nothing inside can be frequent.

Before, words are counted.  The most frequent ones get short numbers, so that a suffix
is one 64-bit value, and those below the least count end a suffix.  Words beyond
``VOCABULARY`` keep 62-bit hashes as numbers; such suffixes are wider rows of the same
shuffle.  A word of more than ``HOT`` occurrences is not routed by itself but with the
word after it, and so on; a phrase of such words alone has marked rows of its own,
so each phrase is counted whole in one task.  Each task counts what it reads
before it sends it.

Words are equal when their 64-bit hashes (with the language) are; scores are exact.

Nulls: a null text is empty; a null language is ``und``, as is that name.  Repeated
rows count again.  Pieces shorter than a phrase hold none; an empty table gives no
rows.  Ties go to the phrase that is first in UTF-8.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclake.llm import common

#: Bytes of text that are counted together before they are sent.
UNIT = 4 << 20
#: Words with short numbers at most (16 bytes each are broadcast).
VOCABULARY = (1 << 21) - 2
#: Suffixes that a task sorts, and occurrences beyond which a word is routed with the next one.
SORTED, HOT = 1_000_000, 100_000

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
#: Lower case; what ends a word or a piece becomes a space.
PLAIN = bytes(0x20 if _BREAK[i] or i == 9 else int(common.LOWER[i]) for i in range(256))
UNKNOWN = "und"
_HASHED = np.int64(1 << 62)


class Words:
    """Words of some texts: a 64-bit key of each with its language, and whether the next one is in the same piece."""

    def __init__(self, langs: list, texts: list[bytes]):
        self.langs = [x if x is not None else UNKNOWN for x in langs]
        data, at = common.joined(texts)
        self.plain = data.translate(PLAIN)
        self.start, self.end, words = common.hash_words(self.plain)
        self.count = np.diff(np.searchsorted(self.start, at))
        seed = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(self.langs)}
        with np.errstate(over="ignore"):
            self.key = common.mix(words + np.repeat(np.array([seed[x] for x in self.langs], dtype=np.uint64), self.count), 11)
        piece = np.cumsum(_BREAK[np.frombuffer(data, dtype=np.uint8)], dtype=np.int32)[self.start]
        self.goes_on = np.append(piece[1:] == piece[:-1], False) if len(piece) else np.zeros(0, dtype=bool)

    def counts(self) -> pa.RecordBatch:
        """(key, lang, word, n) of the distinct words; and without a word, the number of all words of a language."""
        _, first, back = common.numbered(self.key)
        doc = np.searchsorted(np.cumsum(self.count), first, side="right")
        words = [self.plain[s:e] for s, e in zip(self.start[first].tolist(), self.end[first].tolist(), strict=True)]
        total: dict[str, int] = {}
        for x, n in zip(self.langs, self.count.tolist(), strict=True):
            total[x] = total.get(x, 0) + n
        langs = [self.langs[d] for d in doc.tolist()] + list(total)
        key = np.append(self.key[first].view(np.int64), np.zeros(len(total), np.int64))
        return pa.record_batch({"key": key, "lang": pa.array(langs, pa.string()), "word": pa.array([*words, *[None] * len(total)], pa.binary()).cast(pa.string()), "n": np.append(np.bincount(back, minlength=len(first)), list(total.values())).astype(np.int64)})


class Numbers:
    """The number of each word: by frequency from 1; else, 0 for words known to be rare, or a hash."""

    def __init__(self, keys: np.ndarray, whole: bool):
        order = np.argsort(keys.view(np.uint64))
        self.keys, self.number, self.whole = keys.view(np.uint64)[order], (order + 1).astype(np.int64), whole

    def of(self, keys: np.ndarray) -> np.ndarray:
        other = np.zeros(len(keys), dtype=np.int64) if self.whole else (keys >> np.uint64(2)).view(np.int64) | _HASHED
        if not len(self.keys):
            return other
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.number[at], other)


def _suffixes(words: Words, numbers: Numbers, longest: int) -> np.ndarray:
    """(longest, n) word numbers of the suffixes of two words or more, 0 behind their ends."""
    distinct, _, back = common.numbered(words.key)
    number = numbers.of(distinct)[back]
    out = np.zeros((longest, len(number)), dtype=np.int64)
    out[0], goes_on = number, words.goes_on
    for k in range(1, longest):
        out[k, :-k] = np.where((out[k - 1, :-k] != 0) & goes_on[k - 1 : len(number) - 1], number[k:], 0)
    return out[:, (out[0] != 0) & (out[1] != 0)] if longest > 1 else out


def _combined(digits: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns and how often each is there, or the sum of its weights."""
    flat, _, back = common.numbered(digits.ravel())
    local = back.reshape(digits.shape)
    bits = max(1, int(len(flat)).bit_length())
    if bits * len(digits) < 63:
        packed = np.zeros(digits.shape[1], dtype=np.int64)
        for row in local:
            packed = packed << bits | row
        order = np.argsort(packed)
        packed = packed[order]
        first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])[: len(packed)])
        ends = np.append(first[1:], len(packed))[: len(first)]
        total = np.append(0, np.cumsum(weight[order])) if weight is not None else np.arange(len(packed) + 1)
        return digits[:, order[first]], total[ends] - total[first]
    values, of = np.unique(digits, axis=1, return_inverse=True)
    return values, np.bincount(of.ravel(), weights=weight, minlength=values.shape[1]).astype(np.int64)


def _with_hot_heads(digits: np.ndarray, n: np.ndarray, hot: int, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that begin with hot words are routed by more than these: a row with a mark behind them counts each such beginning."""
    rows, weights = [digits], [n]
    for words in range(2, len(digits)):
        all_hot = ((digits[:words] > 0) & (digits[:words] <= hot)).all(axis=0)
        heads, sums = _combined(digits[:words, all_hot], n[all_hot])
        marked = np.zeros((len(digits), heads.shape[1]), dtype=np.int64)
        marked[:words], marked[words] = heads, mark
        rows.append(marked)
        weights.append(sums)
    return np.concatenate(rows, axis=1), np.concatenate(weights)


def equal_partitions(digits: np.ndarray, weight: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, suffixes, counts) of the frequent phrases: multikey three-way quicksort of pointers, all partitions in step.

    ``digits`` has a row for each word of a suffix (0: none); a phrase is given by
    one suffix that begins with it.  Partitions of less weight than ``least`` are abandoned.
    """
    pointer = np.arange(digits.shape[1])
    bounds, depth = np.array([0, len(pointer)]), np.zeros(1, dtype=np.int64)
    while len(pointer):
        start, size = bounds[:-1], np.diff(bounds)
        part = np.repeat(np.arange(len(start)), size)
        value = digits[depth[part], pointer]
        a, b, c = value[start], value[start + size // 2], value[bounds[1:] - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))  # the middle of three
        less, equal = value < pivot[part], value == pivot[part]
        n_less, n_equal = np.add.reduceat(less, start, dtype=np.int64), np.add.reduceat(equal, start, dtype=np.int64)
        below, same = np.cumsum(less) - less, np.cumsum(equal) - equal  # before each one
        below -= below[start][part]
        same -= same[start][part]
        here = np.arange(len(pointer)) - start[part]
        place = np.where(less, below, np.where(equal, n_less[part] + same, (n_less + n_equal)[part] + here - below - same))
        moved = np.empty_like(pointer)
        moved[start[part] + place] = pointer
        begin = np.stack([start, start + n_less, start + n_less + n_equal], axis=1)
        sizes = np.stack([n_less, n_equal, size - n_less - n_equal], axis=1).ravel()
        begin, is_equal, deep, at_pivot = begin.ravel()[sizes > 0], np.tile([False, True, False], len(start))[sizes > 0], np.repeat(depth, 3)[sizes > 0], np.repeat(pivot, 3)[sizes > 0]
        sizes = sizes[sizes > 0]
        total = np.add.reduceat(weight[moved], begin)
        keep = total >= least
        phrase = keep & is_equal & (at_pivot != 0)
        for d in np.unique(deep[phrase]).tolist():
            which = phrase & (deep == d)
            yield d + 1, moved[begin[which]], total[which]
        deep = deep + is_equal
        keep &= ~is_equal | ((at_pivot != 0) & (deep < len(digits)))
        pointer = moved[np.repeat(keep, sizes)]
        bounds, depth = np.concatenate([[0], np.cumsum(sizes[keep])]), deep[keep]


def word_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(key, lang, word, n): how often each word comes in each language; the row without a word counts all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in common.text_groups(batches, UNIT):
            yield Words(langs, texts).counts()

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(count, "key long, lang string, word string, n long")
    return rows.groupBy("key", "lang", "word").agg(F.sum("n").alias("n"))


def _phrase_counts(docs: DataFrame, numbers: Numbers, longest: int, least: int, hot: int, tasks: int, lang: str, text: str) -> DataFrame:
    """(phrase, n): the phrases of two words or more of the least count, as arrays of word numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)  # VOCABULARY words at most
    bits, wide = 63 // longest, not numbers.whole
    mark = (1 << bits) - 1
    names = [f"d{i}" for i in range(longest)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in common.text_groups(batches, UNIT):
            digits, n = _with_hot_heads(*_combined(_suffixes(Words(langs, texts), shared.value, longest)), hot, mark)
            short = (digits < 1 << bits).all(axis=0)
            packed = np.zeros(digits.shape[1], dtype=np.int64)
            for row in digits:
                packed = packed << bits | row
            columns = {"k": pa.array(packed, mask=~short), "n": n.astype(np.int32)}
            if wide:
                columns |= {name: pa.array(row, mask=short) for name, row in zip(names, digits, strict=True)}
            yield pa.record_batch(columns)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, weights = [np.zeros((longest, 0), dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for batch in batches:
            k = batch.column(0).fill_null(0).to_numpy()
            rows = [(k >> bits * (longest - 1 - i)) & ((1 << bits) - 1) for i in range(longest)]
            if wide:
                short = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                rows = [np.where(short, row, batch.column(2 + i).fill_null(0).to_numpy()) for i, row in enumerate(rows)]
            found.append(np.array(rows))
            weights.append(batch.column(1).to_numpy().astype(np.int64))
        digits, weight = np.concatenate(found, axis=1), np.concatenate(weights)
        found.clear()
        weights.clear()
        for words, at, n in equal_partitions(digits, weight, least):
            phrase = digits[:words, at]
            marked = phrase[-1] == mark
            # What begins with hot words is counted by its mark alone: others of its suffixes are in other tasks.
            whole = ~marked & ((words == longest) | (phrase > hot).any(axis=0))
            for some, size in ((phrase[:, whole], words), (phrase[:, marked], words - 1)):
                if size > 1 and some.shape[1]:
                    yield pa.record_batch({"phrase": pa.array(some[:size].T.tolist(), pa.list_(pa.int64())), "n": n[whole] if size == words else n[marked]})

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(send, "k long, n int" + "".join(f", {name} long" for name in names if wide))
    digit = [F.shiftright("k", bits * (longest - 1 - i)).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(longest)]
    if wide:
        digit = [F.coalesce(F.col(name), d) for name, d in zip(names, digit, strict=True)]
    # The leading word; a word behind hot ones only belongs to the route too.
    route, led = [digit[0]], F.lit(True)
    for i in range(1, longest):
        led = led & (digit[i - 1] > 0) & (digit[i - 1] <= hot)
        route.append(F.when(led, digit[i]))
    return rows.repartition(tasks, *route).mapInArrow(sort, "phrase array<long>, n long")


def _slice(of: str, start: Column, length: Column) -> Column:
    return F.slice(F.col(of), start, length)


def collocations(docs: DataFrame, top: int = 2000, longest: int = 3, least: int = 10, inside: int = 50, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``longest`` words.

    a, l and r count the phrase and both sides of its worst cut, n all words; the
    score is floor(10**6 a a / (l r)).  A phrase inside a longer one that has
    ``inside`` percent of its count or more is left out.
    """
    if not 2 <= longest <= 4 or least < 1:
        raise ValueError("phrases have 2 to 4 words, and come once at least")
    spark = docs.sparkSession
    words = common.written(word_counts(docs, lang, text).where((F.col("n") >= least) | F.col("word").isNull()), "zstd")
    known = words.where("word is not null")
    limit = min(VOCABULARY, (1 << 63 // longest) - 2)  # one number is the mark
    best = known.orderBy(F.desc("n"), "key").limit(limit).select("key", "n").toArrow()  # VOCABULARY rows at most
    count, total, keys = *known.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first(), best["key"].to_numpy()
    numbers = Numbers(np.ascontiguousarray(keys), count <= limit)
    hot = int((best["n"].to_numpy() > HOT).sum())
    tasks = max(1, -(-int(total) // SORTED))
    counts = common.written(_phrase_counts(docs, numbers, longest, least, hot, tasks, lang, text), "zstd")
    shared = spark.sparkContext.broadcast(numbers)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            yield pa.record_batch({"code": shared.value.of(keys), "lang": batch.column(1), "word": batch.column(2), "f": batch.column(3)})

    coded = common.written(known.mapInArrow(number, "code long, lang string, word string, f long"), "zstd")
    ranked = _best(_scored(counts, coded, least, inside), coded, top)
    return ranked.join(words.where("word is null").select("lang", F.col("n").alias("n")), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _scored(counts: DataFrame, coded: DataFrame, least: int, inside: int) -> DataFrame:
    """(phrase, a, score, l, r) of the phrases that are not inside a longer one too often."""
    f = counts.unionByName(coded.select(F.array("code").alias("phrase"), F.col("f").alias("n")))
    size = F.size("phrase")
    cuts = counts.select("phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("left", _slice("phrase", F.lit(1), F.col("k"))).withColumn("right", _slice("phrase", F.col("k") + 1, size - F.col("k")))
    cuts = cuts.join(f.select(F.col("phrase").alias("left"), F.col("n").alias("l")), "left").join(f.select(F.col("phrase").alias("right"), F.col("n").alias("r")), "right")
    # Counts below 10**15: all products have 38 digits at most.
    score = F.expr("(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    worst = cuts.withColumn("score", score).groupBy("phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("w")).select("phrase", "a", "w.score", "w.l", "w.r")
    # Each phrase's greatest count inside a longer one.
    longer = counts.where(size > 2).select(F.col("n").alias("b"), F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("phrase", i, m))))).alias("phrase"))
    held = longer.groupBy("phrase").agg(F.max("b").alias("b"))
    return worst.join(held, "phrase", "left").where(F.col("b").isNull() | (100 * F.col("b") < inside * F.col("a"))).drop("b")


def _best(scored: DataFrame, coded: DataFrame, top: int) -> DataFrame:
    """The best of each language: first inside shares of its phrases, so that no task sorts all of them."""
    spark = scored.sparkSession
    shares = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.desc("score"), F.desc("a")]
    with_lang = scored.join(coded.select(F.col("code").alias("_c"), "lang"), F.col("phrase")[0] == F.col("_c")).drop("_c").withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    # Ties with the last one stay until they have their words.
    near = with_lang.withColumn("rank", F.rank().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    near = near.withColumn("at", F.monotonically_increasing_id())
    near = common.written(near, "zstd")
    spelled = near.select("at", F.posexplode("phrase").alias("i", "code")).join(coded.select("code", "word"), "code").groupBy("at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("spelled"))
    named = near.drop("phrase").join(spelled, "at").withColumnRenamed("spelled", "phrase")
    order = [*order, F.col("phrase")]
    own = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return collocations(common.table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d)),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p CROSS JOIN range(1, 4) r(m) WHERE len(w) >= m) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
cuts AS (SELECT *, array_to_string(w[:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
scored AS (SELECT u.lang, u.m, u.phrase, a, l.f AS l, r.f AS r, k, CAST((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cuts u JOIN f l ON l.lang = u.lang AND l.phrase = x JOIN f r ON r.lang = u.lang AND r.phrase = y QUALIFY row_number() OVER (PARTITION BY u.lang, u.phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, s AS phrase, max(a) AS b FROM (SELECT lang, a, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) AS s FROM c WHERE m = 3) GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM scored LEFT JOIN longer USING (lang, phrase) JOIN n USING (lang) WHERE b IS NULL OR 100 * b < 50 * a) WHERE rank <= 2000
"""
