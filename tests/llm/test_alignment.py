"""Alignment against a plain walk over each whole text's tokens."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

import __spark_entry__
from spanloom.llm import alignment

HARD = [
    None, "", " ", "  ", "\n", "a ", "a  \n ", "trail\t", " lead", "   three", "x\n  y", "x \ny", "a　b 　c", "lit▁eral", "u ▁ v", "<|endoftext|> <s> <unk> <0x41>", "naïve café ﬁ ½ 日本語 \U0001f600!",
    "don't we'll I'M", "a" * 3000, "ab" * 2000 + " " * 500 + "z", "\x1c x \x85 y\x00", "tab\tand\nline\r\nend", "x" * 50 + "\U0001f9d9" * 40, "  \n\n  \n", "é", "1234567 89 0.5",
]


def brute(texts: list[str | None]) -> list[dict]:
    t = alignment.tokenizers(*alignment.vocabulary_paths())
    of, docs = alignment.byte_level(), []
    for text in texts:
        groups = []
        if text:
            whole = (" " + text).encode()
            a = t.a.encode(" " + text, add_special_tokens=False)
            a = [(k, bytes(of[c] for c in p)) for k, p in zip(a.ids, a.tokens, strict=True)]
            b = t.b.encode(text)
            b = [(k, t.b_bytes[k]) for k in b]
            if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b):
                ends_a, ends_b, at = [], [], 0
                for _, x in a:
                    ends_a.append(at := at + len(x))
                at = 0
                for _, x in b:
                    ends_b.append(at := at + len(x))
                i = j = 0
                for end in sorted({*ends_a} & {*ends_b}):
                    i2, j2 = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
                    groups.append(([k for k, _ in a[i:i2]], [k for k, _ in b[j:j2]]))
                    i, j = i2, j2
        docs.append(groups)
    count, most = defaultdict(int), defaultdict(int)
    for groups in docs:
        for pair in {(x, y) for ga, gb in groups for x in ga for y in gb}:
            count[pair] += 1
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for groups in docs:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        out.append(
            {
                "n_a": sum(len(x) for x, _ in groups), "n_b": sum(len(y) for _, y in groups), "n_groups": len(groups), "n_links": len(links),
                "n_best": sum(count[p] == most[p[0]] for p in links), "count_sum": sum(count[p] for p in links),
                "groups": ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups),
            }
        )
    return out


def same(got, want, texts):
    left = defaultdict(list)
    for w, text in zip(want, texts, strict=True):
        left[w["groups"], w["count_sum"]].append((w, text))
    for r in got:
        w, text = left[r.groups, r.count_sum].pop()
        assert {k: r[k] for k in w} == w, text
    assert not any(left.values())


@pytest.mark.parametrize("block_bytes", [1, 3000, 8_000_000])
def test_align(spark, rows, monkeypatch, block_bytes):
    monkeypatch.setattr(alignment, "PLAIN_LINKS", 6)
    rng = random.Random(block_bytes)
    texts = HARD + [r[1] for r in rows] + HARD[:20]
    texts += ["".join(rng.choice("ab  \n\t'é　日Z9.") for _ in range(rng.randint(1, 40))) for _ in range(150)]
    table = spark.createDataFrame([(k % 50 or None, t, "g", 1) for k, t in enumerate(texts)], "doc_id long, text string, groups string, n_a int").repartition(4)
    got = alignment.align(table, block_bytes=block_bytes)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    same(got.collect(), brute(texts), texts)


def test_long_texts(spark):
    texts = [" " * 1_000_000 + "a", "ab" * 100_000, "word " * 100_000]
    got = {r.doc_id: r for r in alignment.align(spark.createDataFrame([*enumerate(texts)], "doc_id int, text string")).collect()}
    assert got[2].n_groups >= 100_000 and got[0].n_a >= 1_000_000 and all(r.n_links for r in got.values())


def test_counts_and_empty(spark, empty):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a"), (3, "b")], "doc_id long, text string")
    rows = alignment.blocks(docs, *alignment.vocabulary_paths(), False)
    counts = {(r.a_id, r.b_id): (r.n, r.best) for r in alignment.pair_counts(rows).collect()}
    t = alignment.tokenizers(*alignment.vocabulary_paths())
    a, b = (t.a.encode(f" {c}", add_special_tokens=False).ids[0] for c in "ab")
    assert counts == {(a, t.b.encode("a")[0]): (2, True), (b, t.b.encode("b")[0]): (2, True)}
    assert alignment.align(empty).count() == 0


def test_op12_on_the_smallest_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in docs], brute([r.text for r in docs]), strict=True))
    got = __spark_entry__.queries()["op12_label_string_alignment"](spark, folder).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == tuple(w[k] for k in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
        assert r.groups_sha256 == (hashlib.sha256(w["groups"].encode()).hexdigest() if w["groups"] else "")
