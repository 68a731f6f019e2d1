"""Decontamination, periodic runs and collocations against brute force, with nulls, ties, repeated rows, long texts and clashing columns."""

import collections
import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest

from doclake.llm import collocations, decontaminate, periodic

WORD = re.compile("[^\x20\x09-\x0d]+")
ITEM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Decontamination


def contaminated(texts, items, window):
    """By trying every string at every place."""
    out = []
    for text in texts:
        w, hit, names = ITEM.findall(lower(text)), set(), set()
        for name, item in items:
            v = ITEM.findall(lower(item))
            m = min(window, len(v))
            for s in {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if m else ():
                for i in range(len(w) - m + 1):
                    if tuple(w[i : i + m]) == s:
                        hit |= set(range(i, i + m))
                        names.add("" if name is None else str(name))
        out.append((len(w), sorted(names), sorted(hit)))
    return out


def bench(spark, rows):
    return spark.createDataFrame([(n, t, "x") for n, t in rows], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("window", [1, 2, 3, 5, 10])
def test_decontamination_brute_force(spark, window, monkeypatch):
    rng = random.Random(window)
    vocabulary = ["a", "B", "c9", "é", "漢字", "of", "the"]
    some = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "_", "\x00"]) for _ in range(n))
    items = [(3, some(14)), (3, some(6)), (None, some(4)), (20, some(30)), (100, "The"), (7, None), (8, " ,. "), (9, some(9))]
    items.append((11, items[0][1]))
    texts = [None, "", " ", *[some(rng.randint(1, 80)) for _ in range(30)]]
    texts += [texts[-1], items[0][1], items[3][1].replace("a", "A") + some(5) + items[3][1], some(900) + items[0][1]]
    docs = spark.createDataFrame([(i if i != 4 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, hits int").repartition(3)
    wanted = sorted(zip([i if i != 4 else -1 for i in range(len(texts))], contaminated(texts, items, window), strict=True))
    for part in (1 << 20, 60):  # one part of the items, then several
        monkeypatch.setattr(decontaminate, "PART_BYTES", part)
        monkeypatch.setattr(decontaminate, "SEGMENT", 256 if part > 60 else 7)
        got = []
        for r in decontaminate.decontaminate(docs, bench(spark, items), window).collect():
            spans = [tuple(h) for h in r.hits]
            assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))
            got.append((-1 if r.doc_id is None else r.doc_id, (r.n_words, list(r["items"]), [i for a, b in spans for i in range(a, b)])))
        assert sorted(got) == wanted


def test_decontamination_long_items_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 13)
    item = [f"w{i}" for i in range(200)]
    texts = [" ".join(item[i : i + 10]) for i in range(191)] + [" ".join(item[5:14])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.hits for r in decontaminate.decontaminate(docs, bench(spark, [(1, " ".join(item))])).collect()}
    assert all(got[i] == [[0, 10]] for i in range(191)) and got[191] == []


def test_decontamination_empty_and_long(spark):
    docs = spark.createDataFrame([(1, "a b " * 200_000 + "x y z"), (2, None)], "doc_id long, text string")
    assert [r.hits for r in decontaminate.decontaminate(docs, bench(spark, [])).orderBy("doc_id").collect()] == [[], []]
    assert decontaminate.decontaminate(docs.limit(0), bench(spark, [(1, "x")])).count() == 0
    got = decontaminate.decontaminate(docs, bench(spark, [(1, "B x Y z")])).orderBy("doc_id").first()
    assert (got.n_words, got.hits) == (400_003, [[399_999, 400_003]])


def test_shifts_skip_places():
    strings = decontaminate.Strings(10, np.arange(10, dtype=np.uint64)[None] + np.uint64(10**9), [b"x"])
    words = np.arange(5_000, dtype=np.uint64)
    assert len(strings.ends(words)) < 20  # nothing can end there
    words[3000:3010] = np.arange(10, dtype=np.uint64) + np.uint64(10**9)
    assert 3009 in strings.ends(words)


# Periodic runs


def runs_of(words, least=24, times=3):
    """Of each period, the longest stretches; not where a smaller period holds."""
    n, runs = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            e = i + q
            if e - s >= max(least, times * q) and not any(all(words[k] == words[k + p] for k in range(s, e - p)) for p in range(1, q)):
                runs.append((s, e - s, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def test_runs_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            few = rng.random() < 0.5
            w = [rng.choice("ab" if few else "abc") for _ in range(rng.randint(0, 90))]
            for _ in range(rng.randint(0, 3)):
                unit = [rng.choice("abcd") for _ in range(rng.randint(1, 7))]
                k = rng.randint(0, len(w))
                w[k:k] = unit * rng.randint(2, 9) + unit[: rng.randint(0, len(unit))]
            texts.append(" ".join(w).encode())
        for least, times in ((24, 3), (2, 2), (5, 2), (9, 4)):
            count, found = periodic.find_runs(texts, least, times)
            for d, t in enumerate(texts):
                w = t.decode().split()
                assert count[d] == len(w) and found.get(d, []) == runs_of(w, least, times)


def test_suffix_array_and_lcp():
    rng = random.Random(1)
    for n in (1, 2, 30, 200):
        words = np.array([rng.choice([5, 6, 6, 7]) for _ in range(n)], dtype=np.uint64)
        rank, _, _ = periodic.suffix_ranks(words, np.array([0, n]), 1)
        order = sorted(range(n), key=lambda i: words[i:].tolist())
        if len(set(words.tolist())) < n:
            assert rank.tolist() == np.argsort(order).tolist()
        sa = np.array(order)
        same = [next((k for k in range(n) if max(a, b) + k >= n or words[a + k] != words[b + k]), n) for a, b in zip(order, order[1:], strict=False)]
        assert periodic.lcp_values(words, sa).tolist() == [0, *same]


@pytest.mark.parametrize("text,runs", [
    (" ".join(["a"] * 200_000), [(0, 200_000, 1)]),
    (" ".join(str(i % 5_000) for i in range(60_000)), [(0, 60_000, 5_000)]),
    (" ".join("xy"[bin(i).count("1") % 2] for i in range(1 << 15)), []),
])
def test_long_regular_texts(text, runs):
    began = time.time()
    assert periodic.find_runs([text.encode()])[1].get(0, []) == runs
    assert time.time() - began < 20


def planted(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def test_query_of_runs_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        text = " ".join(rng.choice(["é", "x", f"w{rng.randint(0, 30)}"]) for _ in range(rng.randint(0, 160)))
        rows.append((i if i % 97 else None, None if i == 5 else text + rng.choice(["", "\n\t "]), "clash"))
    rows += [rows[10], (10**12, "r s t " * 30 + "r s", "x"), (-7, "a " * 24 + "b " * 24, "x"), (10**12, "", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    wanted = []
    for doc_id, text, _ in rows:
        w = planted(doc_id, text)
        runs = runs_of(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        assert best == periodic.best_run(runs)
        end = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        wanted.append(repr((doc_id, len(runs), *end, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))))
    got = periodic.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(wanted)
    assert sum("None" not in x for x in wanted) > 5


def test_runs_of_an_empty_table(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string"), times=1)


# Collocations


def phrases(rows, top, longest, least, inside=50):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inner = {}
    for (lang, p), a in candidates.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inner[lang, p[i : i + m]] = max(inner.get((lang, p[i : i + m]), 0), a)
    out = collections.defaultdict(list)
    for (lang, p), a in candidates.items():
        if 100 * inner.get((lang, p), 0) >= inside * a:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, v in out.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:top]))


@pytest.mark.parametrize("longest,least,top", [(3, 10, 2000), (2, 3, 7), (4, 3, 2000), (3, 1, 40)])
def test_phrases_brute_force(spark, longest, least, top, monkeypatch):
    rng = random.Random(longest * 100 + least)
    vocabulary = ["The", "of", "x", "漢", "né", "z\x00z", *[f"w{i}" for i in range(25)]]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda n: "".join(w + rng.choice([" ", " ", " ", "\t ", ". ", "\n"]) for w in rng.choices(vocabulary, weights, k=n))
    rows = [(rng.choice(["en", "fr", None, "und"]), text(rng.randint(0, 120))) for _ in range(150)] + [("en", None), ("de", ""), ("de", "once only")]
    rows += [rows[0], ("en", "new york city " * 30)]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "lang string, text string, n int").repartition(4)
    wanted = phrases(rows, top, longest, least)
    assert wanted
    settings = ((1 << 20, 10**6, 10**6), (1 << 20, 40, 300), (6, 40, 300), (0, 10**6, 700))
    for vocabulary_size, hot, tasks in settings if (longest, least) == (3, 10) else settings[2:3]:
        monkeypatch.setattr(collocations, "VOCABULARY", vocabulary_size)
        monkeypatch.setattr(collocations, "HOT", hot)
        monkeypatch.setattr(collocations, "SORTED", tasks)
        monkeypatch.setattr(collocations, "UNIT", 2_000)
        got = collocations.collocations(docs, top, longest, least)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(tuple(r) for r in got.collect()) == wanted


def test_partitions_are_counts():
    rng = np.random.default_rng(4)
    digits = rng.integers(0, 6, (3, 3_000)) * rng.integers(1, 3, (3, 3_000))
    digits[0] += 1
    digits[1] += 1
    weight = rng.integers(1, 9, 3_000)
    for least in (1, 30):
        wanted = collections.Counter()
        for column, n in zip(digits.T.tolist(), weight.tolist(), strict=True):
            for m in (1, 2, 3):
                if column[m - 1]:
                    wanted[tuple(column[:m])] += n
        got = {tuple(digits[:m, i].tolist()): n for m, at, total in collocations.equal_partitions(digits, weight, least) for i, n in zip(at.tolist(), total.tolist(), strict=True)}
        assert got == {k: n for k, n in wanted.items() if n >= least}
    assert list(collocations.equal_partitions(digits[:, :0], weight[:0], 1)) == []


def test_scores_of_large_counts_are_exact(spark):
    """Products beyond 64 bits; of cuts with one floor, the smallest."""
    counts = spark.createDataFrame([([1, 2], 9_999_999_999), ([1, 2, 3], 6_999_999_999), ([2, 3], 8_000_000_001)], "phrase array<long>, n long")
    coded = spark.createDataFrame([(1, "x", "p", 10**13 + 1), (2, "x", "q", 10**13 + 7), (3, "x", "r", 10**12 + 9)], "code long, lang string, word string, f long")
    got = {tuple(r.phrase): (r.a, r.score, r.l, r.r) for r in collocations._scored(counts, coded, 10, 50).collect()}
    a, cuts = 6_999_999_999, [(10**13 + 1, 8_000_000_001), (9_999_999_999, 10**12 + 9)]
    score, k = min((10**6 * a * a // (l * r), k) for k, (l, r) in enumerate(cuts))
    assert got == {(1, 2, 3): (a, score, *cuts[k])}  # both pairs lie inside it too often


def test_phrases_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", "a, b"), (None, None)], "lang string, text string")).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(empty, longest=1)
