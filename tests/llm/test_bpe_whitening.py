"""BPE by a tree against the library's own encoder; whitening against one plain matrix."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__
from spanloom.llm import byte_bpe, whitening

ALPHABETS = ["ab '", "  \n\tx", " 'srevmldt", "aA1_ ,.é　՘", "a", "  ", "the quick brown's 12 fox're", "日本語 \U00020000𝒳", "՘࢏౜\U00011de0 a1"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.encoder().ranks, special_tokens={})


def ids(text: str) -> list[int]:
    return np.frombuffer(byte_bpe.encoder().encode(text), "<u4").tolist()


@pytest.mark.parametrize("leaf", [8192, 4, 33])
def test_any_cut_of_a_text_gives_the_same_pieces(monkeypatch, library, leaf):
    monkeypatch.setattr(byte_bpe, "LEAF_CHARS", leaf)
    rng = random.Random(leaf)
    for _ in range(1500):
        alphabet = rng.choice(ALPHABETS)
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        got = ids(text)
        assert got == library.encode_ordinary(text), text
        assert byte_bpe.encoder().decode(got) == text.encode()


@pytest.mark.parametrize("leaf", [1, 3, 8])
def test_any_leaf_of_a_piece_gives_the_same_tokens(monkeypatch, leaf):
    monkeypatch.setattr(byte_bpe, "LEAF_BYTES", leaf)
    e, rng = byte_bpe.encoder(), random.Random(leaf)
    for _ in range(800):
        data = bytes(rng.choice(b"abcdet hs\xc3\xa9") for _ in range(rng.randint(1, 90)))
        assert list(e.tokens(data)) == e.merged(data)


def test_long_texts(library):
    rng = random.Random(3)
    for text in ["a" * 200_000, "\n" * 777 + "  x", "=-" * 30_000, "é" * 30_001, " the" * 30_000, "".join(rng.choice("abcdefghij") for _ in range(50_000)), "0123456789" * 7000]:
        assert ids(text) == library.encode_ordinary(text)
    spaces = ids(" " * 1_000_000 + "a")  # the library itself fails on this one
    assert byte_bpe.encoder().decode(spaces) == b" " * 1_000_000 + b"a" and ids(" " * 1000 + "a") == library.encode_ordinary(" " * 1000 + "a")


def test_a_vocabulary_whose_merges_miss_a_token():
    ranks = {bytes([k]): k for k in range(256)} | {b"bc": 256, b"abcd": 257}  # nothing merges to abcd
    e = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN)
    assert np.frombuffer(e.encode("abcd xabcd"), "<u4").tolist() == [257, 32, 120, 97, 256, 100]


def test_encode_and_decode_tables(spark, docs, rows, empty, library):
    clash = docs.withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded").withColumnRenamed("n_chars", "size")
    got = byte_bpe.encode(clash, decoded=True)
    assert got.columns == ["doc_id", "ids", "decoded"]
    want = sorted((r[0] is None, r[0] or 0, library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids, bytes(r.decoded)) for r in got.collect()) == want
    again = byte_bpe.decode(got.select("doc_id", "ids"))
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.decoded)) for r in again.collect()) == [(a, b, d) for a, b, _, d in want]
    assert byte_bpe.encode(empty).count() == 0 and byte_bpe.decode(byte_bpe.encode(empty)).count() == 0
    part = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in byte_bpe.decode(part).collect()} == {1: None, 2: bytearray()}


def test_op11_on_the_smallest_tables(spark, library):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in __spark_entry__.queries()["op11_bpe_monoid_tree"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        want, data = library.encode_ordinary(r.text or ""), (r.text or "").encode()
        assert got[r.doc_id].n_tokens == len(want)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(data).hexdigest()


def brute_whitening(rows, components, scale=256):
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(x) for _, x in kept)
    kept = [(i, x + [0] * (width - len(x))) for i, x in kept]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array(fit, float) - np.array(sums) / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for _, x in kept]
    z = (np.array([x for _, x in kept], float) - np.array(sums) / n) @ vectors / np.sqrt(values)
    return [i for i, _ in kept], n, deviation, z, values / np.trace(cov)


def check_whitening(got, rows, components=4):
    names, n, deviation, z, explained = brute_whitening(rows, components)
    assert len(got) == len(names) * min(components, z.shape[1])
    by = {}
    for r in got:
        assert r.n == n and r.identity_error <= 1e-4
        by.setdefault((r.vec_id, r.component), []).append(r)
    signs = [1] * z.shape[1]
    for c in range(z.shape[1]):
        top = int(np.abs(z[:, c]).argmax())
        signs[c] = np.sign(by[names[top], c + 1][0].whitened * z[top, c])
    for k, name in enumerate(names):
        for c in range(z.shape[1]):
            assert any(r.deviation == deviation[k] and r.whitened * signs[c] == pytest.approx(z[k, c], abs=1e-8) and r.explained == pytest.approx(explained[c], rel=1e-9) for r in by[name, c + 1])


@pytest.mark.parametrize("tile", [3, 32])
def test_whitening_against_one_matrix(spark, tile):
    rng = random.Random(tile)
    rows = [(i, [rng.gauss(0, 1 + k) + 3 * k for k in range(7)]) for i in range(300)]
    rows += [(300, rows[0][1]), (0, rows[5][1]), (None, rows[3][1]), *[(301 + k, rows[7][1]) for k in range(100)]]
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 7), (903, [float("-inf")] + [0.0] * 6), (904, [1.0, 2.0]), (905, [-0.0] * 7)]
    table = spark.createDataFrame([(i, v, "q", 1.0) for i, v in rows], "vec_id long, embedding array<double>, component string, n double")
    check_whitening(whitening.whiten(table.repartition(5), tile=tile).collect(), rows)


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], schema)).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(i, c, 1, 0, 0.0, 0.0, 0.0) for i in (1, 2) for c in (1, 2)}
    flat = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0])], schema)).collect()
    assert {(r.vec_id, r.component, abs(r.whitened), r.explained) for r in flat} == {(i, c, 2.0 - c, 2.0 - c) for i in (1, 2) for c in (1, 2)}
    huge = whitening.whiten(spark.createDataFrame([(1, [3e38, 1.0]), (2, [0.0, 1.0])], schema)).collect()
    assert {(r.deviation, abs(r.whitened)) for r in huge} == {(None, 1.0), (None, 0.0)}


def test_op13_on_the_smallest_tables(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check_whitening(__spark_entry__.queries()["op13_tiled_whitening"](spark, folder).collect(), rows)
