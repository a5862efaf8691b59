from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import lang_id, lm, words
from spanloom.llm.elias_fano import EliasFano

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_word_hashes_tell_words_apart():
    texts = ["a b  a\tB", None, "", " x ", "ab a", "é É e", "a" * 5000]
    data, offsets = words.utf8(pa.array(texts))
    hashes, at = words.word_hashes(data, offsets)
    seen = {}
    for i, t in enumerate(texts):
        own = WORD.findall(lower(t))
        assert len(own) == at[i + 1] - at[i]
        for w, h in zip(own, hashes[at[i] : at[i + 1]], strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("top", [3, 1000, 10**6, 2**40])
def test_elias_fano(top):
    rng = np.random.default_rng(top % 97)
    values = np.sort(rng.integers(0, top, 3000).astype(np.uint64))
    ef = EliasFano(values)
    assert (ef.get(np.arange(len(values))) == values).all()
    ask = np.concatenate((values, rng.integers(0, top + 10, 2000).astype(np.uint64), np.array([0, top * 2 + 5], np.uint64)))
    assert (ef.successor(ask) == np.searchsorted(values, ask)).all()
    empty = EliasFano(np.zeros(0, np.uint64))
    assert empty.n == 0 and (empty.successor(np.array([0, 5], np.uint64)) == 0).all()


def test_table():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(1, 2**63, 5000, dtype=np.uint64))
    table = words.Table(keys, np.zeros(0))
    ask = np.concatenate((keys, rng.integers(1, 2**63, 5000, dtype=np.uint64)))
    found = table.find(ask)
    assert (found[: len(keys)] == np.arange(len(keys))).all() and (found[len(keys) :] == -1).all()


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


def test_word_hashes_of_thue_morse_words():
    """Words that collide under polynomial hashes modulo 2^64 whatever their base."""
    texts = [thue_morse(n, x) for n in (2, 64, 1024, 4096, 8192) for x in ("ab", "ba")]
    hashes, _ = words.word_hashes(*words.utf8(pa.array(texts)))
    assert len(set(hashes.tolist())) == len(set(texts))


def brute_lm(rows, folds=7, left_out=2):
    def train(i):
        return zlib.crc32(str("" if i is None else i).encode()) % folds != left_out

    texts = [(r[0], WORD.findall(lower(r[1]))) for r in rows]
    c, pairs, triples, contexts, after = Counter(), Counter(), Counter(), Counter(), defaultdict(set)
    n_docs = 0
    for i, w in texts:
        if train(i):
            n_docs += 1
            c.update([*w, "</s>"])
            x = ["<s>", *w]
            pairs.update(zip(x, [*w, "</s>"]))
            for u, x, t in zip(["<s>", "<s>", *w], ["<s>", *w], [*w, "</s>"]):
                triples[u, x, t] += 1
                contexts[u, x] += 1
                after[u, x].add(t)
    n, v = sum(c.values()), len(c)
    out = []
    for i, w in texts:
        tokens = [*w, "</s>"]
        p1 = [(c[t] + 1) / (n + v + 1) for t in tokens]
        score = 0.0
        for u, x, t, p in zip(["<s>", "<s>", *w], ["<s>", *w], tokens, p1):
            p = (pairs[x, t] + lm.PRIOR * p) / ((n_docs if x == "<s>" else c[x]) + lm.PRIOR)
            if (k := contexts[u, x]) > 0:
                p = (max(triples[u, x, t] - lm.DISCOUNT, 0) + lm.DISCOUNT * len(after[u, x]) * p) / k
            score += math.log10(p)
        out.append((i, not train(i), len(tokens), sum(c[t] > 0 for t in tokens), n, sum(map(math.log10, p1)), score))
    return out


def check_lm(docs, rows, **options):
    got = lm.score(docs, **options).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    want = sorted(brute_lm(rows), key=key)
    for a, b in zip(sorted(map(tuple, got), key=key), want, strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], abs=1e-6)
        assert a[6] == pytest.approx(b[6], abs=1e-6 + 0.5 / lm.STEPS * b[2])  # a share is off by half a step at most


def test_lm_against_brute_force(docs, rows):
    check_lm(docs, rows)


def test_lm_is_a_distribution():
    """Over all words seen, the end and one unseen word, the probabilities after any context sum to one."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{rng.integers(5)}" for _ in range(12))) for i in range(40)]
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    vocabulary = sorted({w for _, t in train for w in t.split()}) + ["unseen"]
    data, offsets = words.utf8(pa.array([t for _, t in train]))
    learnt = lm.Grams(*lm.tokens(data, offsets), np.ones(len(train), bool))
    own = [f"w0 w1 {w}" for w in vocabulary]
    asked = lm.Grams(*lm.tokens(*words.utf8(pa.array(own))), np.zeros(len(own), bool))
    ends = lm.Grams(*lm.tokens(*words.utf8(pa.array(["w0 w1"]))), np.zeros(1, bool))
    coded = lm.Codes(learnt.words[:3])
    blobs = [blob for g in (learnt, asked, ends) for _, blob, _ in lm.asked(g, 1, coded)]
    (_, for_asked, for_ends), n, v = lm.answers(blobs, 0, 1, coded, {})
    token = lambda g, b: lm.token_scores(g, [b], n, v)[1]
    third = [10 ** token(asked, for_asked)[k] for k in asked.at[:-1] + 2]
    assert sum(third) + 10 ** token(ends, for_ends)[2] == pytest.approx(1, abs=1.5 / lm.STEPS)


def test_lm_many_shards_and_hot_words(spark):
    """One word is more than a third of all; shards and blocks are small, and contexts are split."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join("hot" if rng.random() < 0.4 else f"w{rng.integers(60)}" for _ in range(80))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_lm(docs, rows, shard_bytes=900, block_bytes=2000)
    shards = -(-sum(len(t) + 1 for _, t in rows) // 900)
    trained = docs.withColumn("train", lm.is_training(docs.doc_id, 7, 2))
    coded, hot = lm.sampled(trained, shards, lm.HOT, 1000, 2000)
    assert len(coded.sorted) and hot and lm.part_totals(trained, hot, 2000)


def test_lm_counts_every_context(spark):
    """Words and contexts that occur once have their successors like others."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{int(60 * rng.random() ** 2)}" for _ in range(60)) + f" only{i} then{i} 　 " + thue_morse(4096, "ab" if i % 2 else "ba")) for i in range(120)]
    check_lm(spark.createDataFrame(rows, "doc_id long, text string"), rows, shard_bytes=20_000)


def test_lm_tells_repeats_apart(spark):
    """Texts that occur twice in training score higher by token than texts that occur once."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{rng.integers(400)}" for _ in range(60))) for i in range(200)]
    rows += [(1000 + i, t) for i, t in rows[:40]]
    twice = {i for i in range(40) if all(zlib.crc32(str(k).encode()) % 7 != 2 for k in (i, 1000 + i))}
    got = {r.doc_id: r.score / r.n_tokens for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if not r.held_out}
    assert min(got[i] for i in twice) > max(v for i, v in got.items() if 40 <= i < 1000)


def test_lm_held_out_and_empty(spark, empty):
    assert lm.score(empty).count() == 0
    none = spark.createDataFrame([(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    assert all(r.held_out and r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in lm.score(none).collect())


def test_ppm_is_a_distribution():
    """The probabilities of all bytes after a context sum to one, seen bytes or not."""
    texts = [b"the cat sat on the mat. ", b"that is the thing of the thatch"]
    model = lang_id.Model({"en": lang_id.learn(texts)})
    for context in (b"the ", b"zzzz", b"hat ", b"q"):
        total = 0.0
        whole = [context + bytes([b]) for b in range(256)]
        data, offsets = np.frombuffer(b"".join(whole), np.uint8), np.cumsum([0, *map(len, whole)])
        bits = model.code_lengths(data, offsets)[:, 0]
        base = model.code_lengths(np.frombuffer(context, np.uint8), np.array([0, len(context)]))[0, 0]
        total = np.exp2(base - bits).sum()
        assert total == pytest.approx(1, abs=1.5 / lm.STEPS)


def brute_ppm(texts, text, order=lang_id.ORDER):
    """Code length in bits by walking dictionaries of counts."""
    counts = defaultdict(Counter)
    for t in texts:
        t = b"\n" * order + t
        for i in range(order, len(t)):
            for k in range(order + 1):
                counts[t[i - k : i]][t[i]] += 1

    def p(context, b):
        if context is None:
            return 1 / 256
        shorter = context[1:] if context else None
        own = counts.get(context)
        if own is None:
            return p(shorter, b)
        t, d = sum(own.values()), len(own)
        if b in own:
            return own[b] / (t + d)
        return d / (t + d) * p(shorter, b) / max(1 - sum(p(shorter, s) for s in own), 1e-9)

    t = b"\n" * order + text
    return -sum(math.log2(p(t[i - order : i], t[i])) for i in range(order, len(t)))


def test_ppm_against_brute_force():
    texts = [b"the cat sat on the mat. the hat", "über die Straße, über alles".encode(), b"a"]
    model = lang_id.Model({"x": lang_id.learn(texts), "y": lang_id.learn([b"otra cosa es la casa"])})
    for text in (b"the mat sat", b"zq\x00 new bytes", "über".encode(), b"\n\nthe"):
        got = model.code_lengths(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        assert got[0] == pytest.approx(brute_ppm(texts, text), rel=1e-4)
        assert got[1] == pytest.approx(brute_ppm([b"otra cosa es la casa"], text), rel=1e-4)


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_language_of_odd_rows(spark, empty):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "", "en"), (5, "12 !?", None), (6, "the", None), (None, "und die", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.predict(docs, model).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert got[6][0] == "en" and got[None][0] == "de" and 0 < got[6][1] <= 1
    assert lang_id.identify(empty).count() == 0
    assert all(r.lang_pred == "und" for r in lang_id.predict(docs, None).collect())
    labelled = lang_id.label(docs.withColumn("score", docs.doc_id), model)
    assert labelled.columns == ["doc_id", "text", "lang", "lang_pred", "score", "bits"]


def test_language_sample_does_not_depend_on_ids(spark):
    """Without ids, with one id for all, or with many copies of one text, every language is learned."""
    words = {"en": ["the", "cat", "sat", "here", "with", "hats"], "de": ["der", "hund", "sitzt", "hier", "und", "schläft"], "fr": ["le", "chat", "dort", "avec", "une", "souris"]}
    rng = random.Random(9)
    texts = [(" ".join(rng.choice(w) for _ in range(30)), x) for x, w in words.items() for _ in range(700)]
    texts += [("the cat sat here with hats", "en")] * 3000
    for i in (None, 7):
        table = spark.createDataFrame([(i, t, x) for t, x in texts], "doc_id long, text string, lang string")
        model = lang_id.fit(table)
        assert model.languages == ["de", "en", "fr"]
        got = lang_id.predict(table.where("text not like 'the cat sat here with hats%'").withColumn("doc_id", F.col("lang")), model).collect()
        assert sum(r.lang_pred == r.doc_id for r in got) == len(got)


def test_language_id_counts_by_slices(monkeypatch):
    """The same counts in slices of any size."""
    texts = [b"der Hund", b"", "die Kälte".encode(), b"a" * 50, b"die"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    for n in range(1, lang_id.ORDER + 2):
        keys, counts = np.unique(lang_id.grams(data, offsets, n), return_counts=True)
        for size in (1, 12, 10_000):
            monkeypatch.setattr(lang_id, "SLICE", size)
            got = lang_id.gram_counts(data, offsets, n)
            assert np.array_equal(got[0], keys) and np.array_equal(got[1], counts)


def test_labelled_texts_go_to_python_once(spark):
    docs = spark.createDataFrame([(1, "der Hund", "de"), (2, None, None), (3, "the dog", "en")], "doc_id long, `my.text` string, lang string")
    model = lang_id.fit(docs.withColumnRenamed("my.text", "text"))
    out = lang_id.label(docs, model, "my.text")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("MapInArrow" in x and "text#" in x for x in plan.splitlines())
    assert [(r.doc_id, r["my.text"], r.lang_pred) for r in out.orderBy("doc_id").collect()] == [(1, "der Hund", "de"), (2, None, "und"), (3, "the dog", "en")]
