"""Quality rules: line, word and symbol counts, and n-gram perplexity bands.

The language model is an interpolated modified Kneser-Ney model of byte
``ORDER``-grams.  Spark counts the n-grams of every document labelled good.  These
are cut into two halves by a hash of the text, each with a model of its own, and
a document is scored by the half that does not hold its text, so no model judges
what it has seen.

Models of up to ``held`` n-grams are broadcast as sorted arrays of n-gram hashes,
looked up by binary search.  Of a larger model, tasks hold the longest n-grams of
which there are at most that many, all shorter ones, and the most frequent ones of
full length with their finished bits.  The rest stays a table: each document asks
it for its other n-grams, and the answers are added up by document.  Both ways give
equal bits but for rounding.

The bits per byte of all documents, counted to ``GRAIN`` parts of a bit, give each
language's exact quartiles, and these a lower and an upper band; documents
outside are rejected.

Nulls: a null text is empty and fails the base rules; a null language is a
language of its own.  Documents of fewer than ``least_words`` words don't shape
the bands.  Labels that are null, or of no document, count for nothing; without
any good label Spark counts the n-grams of all documents, and the model is made
of all of them, unless a caller asks for the ``most_grams`` most frequent ones;
without any text each byte has 8 bits.
Repeated rows are judged alike.  An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclake.llm import common

#: Bytes of an n-gram, and parts of a bit to which scores are counted for the bands.
ORDER, GRAIN = 5, 1000
#: N-grams that a task sums up before it sends them on, rows of n-grams asked for in one batch, and rows of good ids that are broadcast.
TASK_GRAMS, ASKED_ROWS, GOOD_ROWS = 1 << 20, 100_000, 1 << 20

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_LETTER = (~common._SPACE & ((np.arange(256) & 0xC0) != 0x80)).astype(np.int64)  # first bytes of code points outside white space


class Rules(NamedTuple):
    """Parameters: base rules, bands in robust deviations (IQR / 1.349), and what tasks hold of a model."""

    least_words: int = 50
    most_repeated: float = 0.5
    lower_sigmas: float = 10.0
    upper_sigmas: float = 15.0
    least_sigma: float = 0.01  # as a share of the median
    sample: int | None = None  # without effect, as is the next: all good documents are counted
    sample_bytes: int | None = None
    held: int = 1 << 21  # n-grams of one length that are broadcast; of further ones there is a table
    most_grams: int | None = None  # of a model that all documents are counted for, if a caller wants a smaller one


class Level(NamedTuple):
    """The n-grams of one length: sorted hashes of those seen and of their contexts."""

    grams: np.ndarray
    gram_bits: np.ndarray  # -log2 of the last byte's probability
    contexts: np.ndarray
    context_bits: np.ndarray  # -log2 of the weight given to the shorter context


class Model(NamedTuple):
    """What tasks hold of one half's model: all n-grams up to a length, and some of full length if that is shorter."""

    levels: list[Level]
    codes: np.ndarray  # sorted
    code_bits: np.ndarray


class Asked(NamedTuple):
    """N-grams of some texts that the table of one half is asked for."""

    half: int
    text: np.ndarray
    code: np.ndarray
    n: np.ndarray
    low: np.ndarray  # bits by the n-grams that are held


def _codes(text: bytes, order: int = ORDER) -> np.ndarray:
    """Each byte with those before it as one number; zero bytes stand before the text."""
    a = np.frombuffer(bytes(order - 1) + text, dtype=np.uint8).astype(np.uint64)
    code = np.zeros(len(text), dtype=np.uint64)
    for i in range(order):
        code = code << np.uint64(8) | a[i : i + len(text)]
    return code


def _tail(codes: np.ndarray, k: int) -> np.ndarray:
    """The last k bytes."""
    return codes & np.uint64((1 << 8 * k) - 1)


def _half(texts: list[bytes]) -> np.ndarray:
    """In which half of a sample each text would be."""
    data, at = common.joined(texts)
    hashes = common.hash_spans(np.frombuffer(data, dtype=np.uint8), at[:-1], at[1:])
    return (hashes >> np.uint64(63)).astype(np.int64)


def _sums(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    of, distinct = pd.factorize(np.concatenate([codes for codes, _ in parts]))
    return distinct, np.bincount(of, np.concatenate([n for _, n in parts]), len(distinct)).astype(np.int64)


def count_grams(docs: DataFrame, text: str = "text") -> DataFrame:
    """(half, code, n): how often each byte n-gram occurs in each half of the texts."""

    def rows(h: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        codes, n = _sums(parts)
        return pa.record_batch({"half": np.full(len(codes), h, dtype=np.int32), "code": codes.view(np.int64), "n": n})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        for _, texts in common.text_groups(batches):
            half = _half(texts)
            for h in (0, 1):
                codes = [_codes(t) for t, of in zip(texts, half, strict=True) if of == h]
                if codes:
                    of, distinct = pd.factorize(np.concatenate(codes))
                    held[h].append((distinct, np.bincount(of, minlength=len(distinct))))
                if sum(len(c) for c, _ in held[h]) > TASK_GRAMS:
                    held[h] = [_sums(held[h])]
                    if len(held[h][0][0]) > TASK_GRAMS // 2:
                        yield rows(h, held[h])
                        held[h] = []
        for h in (0, 1):
            if held[h]:
                yield rows(h, held[h])

    counted = docs.select(F.lit(0).cast("long").alias("k"), F.col(text)).mapInArrow(count, "half int, code long, n long")
    return counted.groupBy("half", "code").agg(F.sum("n").alias("n"))


def good_documents(docs: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """(text): all documents labelled good.

    Good ids are the bits of rows of 64 ids each.  Up to ``GOOD_ROWS`` rows go to the
    documents, so that no text is shuffled; from there on both sides are.
    """
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i.bitwiseAND(63).cast("int"))
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("good"))
    rows = common.checkpointed(good.groupBy(F.shiftright("good", 6).alias("ids")).agg(F.bit_or(bit(F.col("good"))).alias("bits")))
    some = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).withColumn("ids", F.shiftright("id", 6))
    found = some.join(F.broadcast(rows) if rows.count() <= GOOD_ROWS else rows.hint("merge"), "ids")
    return found.where(F.col("bits").bitwiseAND(bit(F.col("id"))) != 0).select("text")


def _discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Kneser-Ney discounts for counts 0, 1, 2 and 3 or more, from how many n-grams have counts 1 to 4."""
    if not n1 or not n2:
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0, *np.clip(d, 0.05, [0.95, 1.95, 2.95])])


def kneser_ney(codes: np.ndarray, n: np.ndarray, order: int = ORDER) -> list[Level]:
    """The model of distinct n-grams and their counts, shortest n-grams first."""
    held = [(codes.astype(np.uint64), n.astype(np.float64))]
    for k in range(order - 1, 0, -1):  # shorter ones count the distinct bytes before them
        code, follows = np.unique(_tail(held[-1][0], k), return_counts=True)
        held.append((code, follows.astype(np.float64)))
    levels: list[Level] = []
    shorter, p = np.arange(256, dtype=np.uint64), np.full(256, 1 / 256)
    bits = lambda x: -np.log2(np.maximum(x, 1e-30)).astype(np.float32)
    for k, (code, count) in enumerate(reversed(held), 1):
        context, of = np.unique(code >> np.uint64(8), return_inverse=True)
        d = _discounts(*(int((count == i).sum()) for i in (1, 2, 3, 4)))[np.minimum(count, 3).astype(np.int64)]
        total = np.bincount(of, count, len(context))
        weight = np.bincount(of, d, len(context)) / total if len(total) else total
        below = p[np.searchsorted(shorter, _tail(code, max(1, k - 1)))] if k > 1 else np.full(len(code), 1 / 256)
        shorter, p = code, (count - d) / total[of] + weight[of] * below
        grams, contexts = common.mix(code, 2 * k), common.mix(context, 2 * k + 1)
        a, b = np.argsort(grams), np.argsort(contexts)
        levels.append(Level(grams[a], bits(p)[a], contexts[b], bits(weight)[b]))
    return levels


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def gram_bits(model: list[Level], codes: np.ndarray) -> np.ndarray:
    """-log2 of the probability of each n-gram's last byte after those before it."""
    out = np.zeros(len(codes))
    left = np.arange(len(codes))  # those not found in a longer n-gram
    for k in range(len(model), 0, -1):
        level, tail = model[k - 1], _tail(codes[left], k)
        at, there = _find(level.grams, common.mix(tail, 2 * k))
        out[left[there]] += level.gram_bits[at[there]]
        left, tail = left[~there], tail[~there]
        at, there = _find(level.contexts, common.mix(tail >> np.uint64(8), 2 * k + 1))
        out[left[there]] += level.context_bits[at[there]]
    out[left] += 8.0
    return out


def text_bits(models: list[Model], texts: list[bytes]) -> tuple[np.ndarray, list[Asked]]:
    """Bits of each text by the model of the half that does not hold it, and the n-grams left out, which tasks don't hold."""
    out, half, asked = np.zeros(len(texts)), _half(texts), []
    for h in (0, 1):
        own, model = np.flatnonzero(half == h), models[1 - h]
        if len(own):
            codes = [_codes(texts[i]) for i in own]
            of, distinct = pd.factorize(np.concatenate(codes))
            at, there = _find(model.codes, distinct)
            bits = np.zeros(len(distinct))
            bits[there] = model.code_bits[at[there]]
            bits[~there] = gram_bits(model.levels, distinct[~there])
            if len(model.levels) < ORDER and not there.all():
                rest = np.flatnonzero(~there[of])
                owner = np.repeat(own, [len(c) for c in codes])
                pairs, n = np.unique(owner[rest] * len(distinct) + of[rest], return_counts=True)
                i, k = pairs // len(distinct), pairs % len(distinct)
                asked.append(Asked(1 - h, i, distinct[k], n, bits[k]))
                bits[~there] = 0
            out[own] = _per_doc(bits[of], np.concatenate([[0], np.cumsum([len(c) for c in codes])]))
    return out, asked


def _key(code: Column, length: int, context: bool = False) -> Column:
    """An n-gram of ``length`` bytes (or its context) as one number that no other has."""
    tail = code.bitwiseAND((1 << 8 * length) - 1)
    return (F.shiftright(tail, 8) if context else tail).bitwiseOR(F.lit(2 * length + context << 8 * ORDER))


def _bits(p: Column) -> Column:
    return (-F.log2(F.greatest(p, F.lit(1e-30)))).cast("float")


def fitted(grams: DataFrame, held: int) -> tuple[Broadcast, DataFrame | None]:
    """The models of both halves as far as tasks hold them, and (half, key, bits) of all longer n-grams and their contexts, if there are any.

    The definition is that of ``kneser_ney``, which makes the part that is held.
    """
    context, levels, k = grams.sparkSession.sparkContext, {ORDER: grams}, ORDER
    while k > 1 and levels[k].count() > held:
        k -= 1
        tail = F.col("code").bitwiseAND((1 << 8 * k) - 1).alias("code")
        levels[k] = common.checkpointed(levels[k + 1].groupBy("half", tail).agg(F.count("*").alias("n")))
    found = levels[k].toArrow()  # ``held`` rows at most
    half, code, n = (found[c].to_numpy() for c in ("half", "code", "n"))
    order = np.argsort(code)
    half, code, n = half[order], code[order].view(np.uint64), n[order]
    shorter = [kneser_ney(code[half == h], n[half == h], k) for h in (0, 1)]
    none = np.zeros(0, np.uint64), np.zeros(0, np.float32)
    if k == ORDER:
        return context.broadcast([Model(levels, *none) for levels in shorter]), None
    told = context.broadcast(shorter)

    @F.arrow_udf("double")
    def probability(half: pa.Array, code: pa.Array) -> pa.Array:
        of, codes, p = half.to_numpy(), code.to_numpy().view(np.uint64), np.zeros(len(half))
        for h in (0, 1):
            p[of == h] = 2.0 ** -gram_bits(told.value[h], codes[of == h])
        return pa.array(p)

    below = levels[k].select("half", F.col("code").alias("tail"), probability("half", "code").alias("below"))
    parts = []
    for k in range(k + 1, ORDER + 1):
        counts = levels[k].groupBy("half").agg(*(F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4))).collect()  # two rows
        cut = F.lit(None).cast("double")
        for r in counts:
            for i, d in enumerate(_discounts(*r[1:])):
                cut = F.when((F.col("half") == r.half) & (F.least("n", F.lit(3)) == i), float(d)).otherwise(cut)
        of = F.shiftright("code", 8).alias("context")
        contexts = levels[k].groupBy("half", of).agg(F.sum("n").alias("total"), (F.sum(cut) / F.sum("n")).alias("weight"))
        tail = F.col("code").bitwiseAND((1 << 8 * (k - 1)) - 1).alias("tail")
        seen = levels[k].select("half", "code", "n", cut.alias("cut"), of, tail).join(contexts.hint("merge"), ["half", "context"]).join(below.hint("merge"), ["half", "tail"])
        p = (F.col("n") - F.col("cut")) / F.col("total") + F.col("weight") * F.col("below")
        level = common.checkpointed(seen.select("half", "code", "n", p.alias("p")))
        parts.append(level.select("half", _key(F.col("code"), k).alias("key"), _bits(F.col("p")).alias("bits")))
        parts.append(contexts.select("half", F.col("context").bitwiseOR(F.lit(2 * k + 1 << 8 * ORDER)).alias("key"), _bits(F.col("weight")).alias("bits")))
        below = level.select("half", F.col("code").alias("tail"), F.col("p").alias("below"))
    grade = F.floor(F.log2("n") * 16).cast("long")
    least, some = None, 0
    for r in level.groupBy(grade.alias("grade")).count().orderBy(F.desc("grade")).collect():  # a thousand rows at most
        some += r["count"]
        if some > held:
            break
        least = r.grade
    models = [Model(levels, *none) for levels in shorter]
    if least is not None:
        found = level.where(grade >= least).select("half", "code", _bits(F.col("p")).alias("bits")).orderBy("code").toArrow()  # ``held`` rows at most
        half, code, bits = (found[c].to_numpy() for c in ("half", "code", "bits"))
        models = [Model(shorter[h], code[half == h].view(np.uint64), bits[half == h]) for h in (0, 1)]
    return context.broadcast(models), common.checkpointed(functools.reduce(DataFrame.unionAll, parts))


def answered(asked: DataFrame, table: DataFrame, length: int) -> DataFrame:
    """(half, code, found): bits of n-grams, where ``low`` has those by n-grams of up to ``length`` bytes."""
    longer = range(length + 1, ORDER + 1)
    keys = F.array(*(_key(F.col("code"), k, context) for k in longer for context in (False, True)))
    rows = asked.groupBy("half", "code").agg(F.max("low").alias("low")).select("half", "code", "low", F.explode(keys).alias("key"))
    kind = F.shiftright("key", 8 * ORDER)
    bits = lambda k, context: F.max(F.when(kind == 2 * k + context, F.col("bits").cast("double")))
    best = F.max("low")
    for k in longer:
        best = F.coalesce(bits(k, False), F.coalesce(bits(k, True), F.lit(0.0)) + best)
    # Nothing here has a bound that would allow a broadcast.
    return rows.join(table.hint("merge"), ["half", "key"], "left").groupBy("half", "code").agg(best.alias("found"))


def _per_doc(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def _repeated_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) == len(set(lines)):
        return 0
    seen: set[bytes] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += bool(line.split())
        seen.add(line)
    return n


def measures(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Counts that the base rules use, for each text."""
    data, at = common.joined(texts)
    start, _, words = common.hash_words(data)
    first = np.searchsorted(start, at)
    buf = np.frombuffer(data, dtype=np.uint8)
    covered = np.zeros(len(words) + 3, dtype=np.int64)
    if len(words) > 2:
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        inside = np.flatnonzero(owner[2:] == owner[:-2])
        key = common.mix(common.window_hashes(words, 3, 2)[inside] ^ common.mix(owner[inside].astype(np.uint64), 9))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = inside[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]
        for i in range(3):
            covered[twice + i] = 1
    return {
        "n_words": np.diff(first),
        "word_chars": _per_doc(_LETTER[buf], at),
        "n_symbols": _per_doc(_SYMBOL[buf], at),
        "n_dup_lines": np.array([_repeated_lines(t) for t in texts], dtype=np.int64),
        "n_repeat_words": _per_doc(covered[: len(words)], first),
    }


def _batch(shape: pa.Schema, n: int, columns: dict) -> pa.RecordBatch:
    """Rows with some of the columns; the others are null."""
    return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in shape], schema=shape)


def quality_rules(docs: DataFrame, labels: DataFrame | None = None, rules: Rules = Rules(), key: str = "doc_id", text: str = "text", lang: str = "lang", label_key: str | None = None) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lang, bits_per_byte, base_failed, kept).

    ``labels`` has doc_id and quality, which is 1 for good documents; ``label_key``
    is the column of ``docs`` that holds that id, if it is not ``key``.
    """
    grams = None
    if labels is not None:
        grams = common.checkpointed(count_grams(good_documents(docs, labels, label_key or key, text)))
    if grams is None or grams.isEmpty():
        counted = count_grams(docs, text)
        grams = common.checkpointed(counted if rules.most_grams is None else counted.orderBy(F.desc("n"), "half", "code").limit(rules.most_grams))
    model, table = fitted(grams, rules.held)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, and after it one for each n-gram that the table is asked for."""
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 32
        rows = (pa.record_batch({"k": pa.StructArray.from_arrays([b.column(0), b.column(2)], ["i", "l"]), "t": b.column(1)}) for b in batches)
        for pairs, texts in common.text_groups(rows):
            bits, asked = text_bits(model.value, texts)
            numbers = row + np.arange(len(texts))
            row += len(texts)
            lang, own = pa.array([p["l"] for p in pairs], pa.string()), pa.array([p["i"] for p in pairs], pa.int64())
            yield _batch(shape, len(texts), {key: own, **measures(texts), "lang": lang, "row": numbers, "bits": bits, "size": [len(t) for t in texts]})
            for a in asked:
                for i in range(0, len(a.code), ASKED_ROWS):
                    to = slice(i, i + ASKED_ROWS)
                    yield _batch(shape, len(a.code[to]), {"row": numbers[a.text[to]], "half": np.full(len(a.code[to]), a.half), "code": a.code[to].view(np.int64), "n": a.n[to], "low": a.low[to]})

    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    types = {key: "long", **dict.fromkeys(counts, "long"), "lang": "string", "row": "long", "bits": "double", "size": "long", "half": "int", "code": "long", "n": "long", "low": "double"}
    arrow = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    shape = pa.schema([(name, arrow[t]) for name, t in types.items()])
    made = docs.select(F.col(key).cast("long"), F.col(text), F.col(lang)).mapInArrow(measure, ", ".join(f"{name} {t}" for name, t in types.items()))
    measured = rows = common.checkpointed(made) if table is None else common.written(made)
    if table is not None:
        asked = rows.where("code is not null").select("row", "half", "code", "n", "low")
        added = asked.join(answered(asked, table, len(model.value[0].levels)).hint("merge"), ["half", "code"]).groupBy("row").agg(F.sum(F.col("n") * F.col("found")).alias("added"))
        measured = rows.where("code is null").join(added.hint("merge"), "row", "left").withColumn("bits", F.col("bits") + F.coalesce("added", F.lit(0.0)))
    measured = measured.select(key, *counts, "lang", (F.col("bits") / F.greatest("size", F.lit(1))).alias("bits_per_byte"))
    if table is not None:
        measured = common.checkpointed(measured)
    grains = measured.where(F.col("n_words") >= rules.least_words).groupBy("lang", F.round(F.col("bits_per_byte") * GRAIN).cast("long").alias("grain")).agg(F.count("*").alias("n"))
    low, mid, high = (F.col("q")[i] / GRAIN for i in range(3))
    sigma = F.greatest((high - low) / 1.349, mid * rules.least_sigma)
    bands = (
        grains.groupBy("lang")
        .agg(F.percentile("grain", [0.25, 0.5, 0.75], F.col("n")).alias("q"))
        .select(F.col("lang").alias("of"), (mid - rules.lower_sigmas * sigma).alias("lower"), (mid + rules.upper_sigmas * sigma).alias("upper"))
    )
    failed = (F.col("n_words") < rules.least_words) | (F.col("n_repeat_words") > rules.most_repeated * F.col("n_words"))
    inside = F.col("bits_per_byte").between(F.col("lower"), F.col("upper"))
    return (
        measured.join(bands, F.col("lang").eqNullSafe(F.col("of")), "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
        .drop("of", "lower", "upper")
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return quality_rules(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")).drop("lang")
