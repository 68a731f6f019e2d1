"""Tokens of a whole table against the tokenizers library, very long texts against brute force, and pipeline keys of the caller's."""

import collections
import hashlib
import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from doclake.llm import bpe, common, lm_score, packing, quality, substring_dedup

DATA = "/root/testdata/sf0.01"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table():
    rows = pq.read_table(f"{DATA}/documents.parquet").to_pydict()
    return dict(zip(rows["doc_id"], rows["text"], strict=True))


def test_coding_of_a_whole_table(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op9_bpe(spark, DATA).collect()}
    texts = table()
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))


def test_packing_of_a_whole_table(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.op3_packing(spark, DATA).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    texts = table()
    assert pieces.keys() == texts.keys()
    for i, t in texts.items():
        ids, at = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    padded = 0
    for rows in sequences.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 4096
        padded += 0 if at & (at - 1) == 0 else 4096 - at
    assert padded <= 0.01 * 4096 * len(sequences)


@pytest.fixture(scope="module")
def long_texts():
    rng = np.random.default_rng(21)
    words = np.array([f"{a}{b}" for a in "ba ce di fo gu".split() for b in "lam nor set tis vun éx 漢".split()])
    one = " ".join(words[rng.integers(0, 35, 40_000)])  # 200 KB
    two = " ".join(words[rng.integers(0, 35, 30_000)]) + "\n" + one[100_000:130_000] + "\n" + " ".join(words[rng.integers(0, 35, 10_000)])
    return [(1, one), (2, two), (3, "a" * 300_000 + " b"), (4, "short one"), (5, "a b c d e f g h i j\n" * 9_000)]


def test_long_texts_against_brute_force(spark, long_texts, tmp_path):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in long_texts], "doc_id long, text string, lang string, source string, n_chars long")
    own = {i: t.split() for i, t in long_texts}
    seen = collections.Counter(tuple(w[k : k + 35]) for w in own.values() for k in range(len(w) - 34))
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs).collect()}
    for i, w in own.items():
        edge = np.zeros(len(w) + 1, dtype=int)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                edge[k] += 1
                edge[k + 35] -= 1
        keep = np.cumsum(edge)[:-1] == 0
        assert (got[i].n_words, got[i].n_removed, sha(got[i].kept)) == (len(w), int((~keep).sum()), sha(" ".join(x for x, k in zip(w, keep, strict=True) if k)))
    assert got[2].n_removed > 4_000 and got[5].n_removed == 90_000
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coded = {r.doc_id: r for r in bpe.decode(bpe.encode(docs)).collect()}
    for i, t in long_texts:
        assert coded[i].ids == tokenizer.encode(t, add_special_tokens=False).ids and coded[i].text == t
    count = collections.Counter(w for i in own if not lm_score.held_out(i) for w in [*own[i], None])
    total, kinds = sum(count.values()), len(count)
    for r in lm_score.lm_scores(docs).collect():
        base = sum(np.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in [*own[r.doc_id], None])
        assert r.n_tokens == len(own[r.doc_id]) + 1 and np.isclose(r.base_score, base) and r.score <= 0
    for r in quality.quality_rules(docs).collect():
        w, lines = own[r.doc_id], dict(long_texts)[r.doc_id].split("\n")
        runs = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {k + j for k in range(len(w) - 2) if runs[tuple(w[k : k + 3])] > 1 for j in range(3)}
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(w), len(repeated), sum(bool(x.split()) for x in lines) - len({x for x in lines if x.split()}))


@pytest.mark.skipif(not os.path.exists("corpus_pipeline.py"), reason="no pipeline")
def test_a_caller_s_own_row_key_is_not_trusted(spark):
    """Three rows with one such key stay three, four equal texts become one."""
    import corpus_pipeline

    rows = [(i, f"text number {i} of its own", 7, "x") for i in range(3)]
    shape = "doc_id long, text string, row_key long, kept string"
    full = lambda df: df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    docs = full(spark.createDataFrame(rows, shape))
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.dedup_substrings(spark, docs, "").collect()) == [r[:2] for r in rows]
    same = full(spark.createDataFrame([(i, "one text that is the same in all four rows", None if i % 2 else 1, "y") for i in range(4)], shape))
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, same, "").collect()] == [0]
    # The pipeline's own key goes from stage to stage, through Parquet too.
    first = common.written(corpus_pipeline.near_dedup(spark, docs, ""))
    assert corpus_pipeline._keyed(first) is first
    assert corpus_pipeline.pii(spark, first, "").count() == corpus_pipeline.packing(spark, first, "").where("start = 0").count() == 3


def test_without_labels_all_documents_are_counted(spark):
    """The bound on labelled documents plays no part; neither do labels of other documents."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    verdict = lambda labels, rules: {r.doc_id: (r.kept, round(r.bits_per_byte, 6)) for r in quality.quality_rules(docs, labels, rules).collect()}
    none = spark.createDataFrame([(-5, 1), (None, 1)], "doc_id long, quality int")
    whole = verdict(None, quality.Rules())
    assert whole == verdict(None, quality.Rules(sample=1, sample_bytes=100)) == verdict(none, quality.Rules())
    few = verdict(None, quality.Rules(most_grams=2_000))  # a smaller model predicts less
    assert len(whole) == len(few) == 1_000 and np.mean([few[i][1] - whole[i][1] for i in whole]) > 0
    kept = sum(k for k, _ in whole.values())
    assert 500 < kept < 1_000


def by_all(texts, good):
    """Bits per byte of each text by all n-grams of the good texts in the other half."""
    raw = [t.encode() for t in texts]
    half, bits = quality._half(raw), np.zeros(len(raw))
    for h in (0, 1):
        codes = np.concatenate([quality._codes(t) for t, of, g in zip(raw, half, good, strict=True) if g and of != h])
        model = quality.kneser_ney(*np.unique(codes, return_counts=True))
        for i in np.flatnonzero(half == h):
            bits[i] = quality.gram_bits(model, quality._codes(raw[i])).sum() / len(raw[i])
    return bits


def test_all_good_documents_are_counted(spark):
    """Of 6,000 labelled documents and two of a megabyte and more each one counts, whether tasks hold the model or ask for it."""
    rng = np.random.default_rng(17)
    letters = np.array(list("abcdefghijklmnop"))
    texts = [" ".join("".join(rng.choice(letters, 4)) for _ in range(8)) for _ in range(6_000)]
    texts += [" ".join("".join(x) for x in rng.choice(letters, (220_000, 4))), " ".join("".join(x).upper() for x in rng.choice(letters, (220_000, 4)))]
    texts += [f"{texts[i]} {texts[i + 1].upper()} {'own words ' * 30}" for i in range(200)]
    labels = spark.createDataFrame([(i, int(i < 6_002)) for i in range(6_100)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(6)
    wanted = by_all(texts, [i < 6_002 for i in range(len(texts))])
    kept = []
    for held in (1 << 21, 200_000, 3_000):  # all n-grams, or the shorter ones of them
        got = {r.doc_id: r for r in quality.quality_rules(docs, labels, quality.Rules(held=held)).collect()}
        assert len(got) == len(texts) and np.allclose([got[i].bits_per_byte for i in range(len(texts))], wanted, atol=1e-5)
        kept.append([got[i].kept for i in range(len(texts))])
    assert kept[0] == kept[1] == kept[2]


def test_good_documents_by_bits_of_ids(spark, monkeypatch):
    """Any ids, negative, far apart, repeated or null, by a broadcast and by a shuffle."""
    ids = [0, 1, 63, 64, 65, -1, -64, -65, 2**62, -(2**63), 2**63 - 1, 1, None]
    docs = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)] + [(62, "no"), (-2, "no"), (2, "no")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in ids] + [(1, 1), (2, 0), (62, None)], "doc_id long, quality int")
    for rows in (1 << 20, 0):
        monkeypatch.setattr(quality, "GOOD_ROWS", rows)
        got = sorted(r.text for r in quality.good_documents(docs, labels, "doc_id", "text").collect())
        assert got == sorted(f"text {n}" for n in range(len(ids) - 1))


def test_models_that_tasks_ask_for_on_repeated_and_odd_rows(spark):
    """Null and repeated ids, null and empty texts and a text of many unknown n-grams get the same rows from a model that is held and from one that is not."""
    rng = np.random.default_rng(18)
    odd = "".join(map(chr, rng.integers(33, 2_000, 150_000)))
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 60)), "en") for i in range(40)]
    rows += [(None, rows[0][1], None), (3, rows[3][1], "en"), (3, None, "en"), (None, "", "en"), (41, odd, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    result = lambda held: sorted(((*r[:7], round(r.bits_per_byte, 4), *r[8:]) for r in quality.quality_rules(docs, labels, quality.Rules(held=held)).collect()), key=str)
    assert result(1 << 21) == result(10) and len(result(10)) == len(rows)


@pytest.mark.skipif(not os.path.exists("corpus_pipeline.py"), reason="no pipeline")
def test_pipeline_counts_all_good_documents(spark, tmp_path, monkeypatch):
    """Among others one of more than a megabyte, whose words the stage's model knows."""
    import corpus_pipeline

    rng = np.random.default_rng(19)
    letters = np.array(list("abcdefghijkl"))
    texts = [" ".join("".join(x) for x in rng.choice(letters, (60, 4))) for _ in range(300)]
    texts += [" ".join("".join(x).upper() for x in rng.choice(letters, (220_000, 4))), " ".join("".join(x).title() for x in rng.choice(letters, (220_000, 4)))]
    texts += [t.upper() for t in texts[:50]]
    spark.createDataFrame([(i, int(i < 302)) for i in range(320)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    monkeypatch.setattr(corpus_pipeline, "_chosen", lambda docs, kept: kept.join(docs.select("doc_id", corpus_pipeline.ROW), corpus_pipeline.ROW))
    got = {r.doc_id: r.bits_per_byte for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()}
    wanted = by_all(texts, [i < 302 for i in range(len(texts))])
    assert len(got) > 200 and all(abs(bits - wanted[i]) < 1e-5 for i, bits in got.items())


def test_without_labels_all_n_grams_make_the_model(spark):
    """More than the 2,097,152 that once were the most."""
    rng = np.random.default_rng(20)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .", dtype=np.uint8)
    texts = [letters[rng.integers(0, 64, 9_000)].tobytes().decode() for _ in range(300)]
    texts += [t[:4_500] + u[4_500:] for t, u in zip(texts[:20], texts[20:40], strict=True)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(4)
    wanted = by_all(texts, [True] * len(texts))
    got = {r.doc_id: r.bits_per_byte for r in quality.quality_rules(docs, rules=quality.Rules(held=1 << 22)).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], wanted, atol=1e-5)
