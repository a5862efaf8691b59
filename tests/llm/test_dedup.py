from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import exact_dedup, near_dedup
from spanloom.llm.components import components


def test_exact_against_brute_force(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        top = max(known) if known else None
        done = False
        for i in ids:
            stays = i == top and not done
            done |= stays
            want[(i, top, len(ids), stays, hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in exact_dedup.mark_copies(docs).collect()) == want


def test_exact_drop_keeps_one_whole_row_of_each_text(docs, rows):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    got = [tuple(r) for r in kept.collect()]
    assert len(got) == len({r[1] or "" for r in rows})
    assert set(got) <= set(rows)


def test_exact_hot_text_and_clashing_names(spark):
    rows = [(i, "same" if i % 3 else f"own {i}", i, "x") for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, keep_id long, digest string")
    assert exact_dedup.hot_digests(table, "text").count() == 1
    got = exact_dedup.mark_copies(table)
    assert got.where("kept").count() == 1001
    assert got.where("keep_id = 2999 and group_size = 2000").count() == 2000
    assert exact_dedup.drop_copies(table).where("text = 'same'").first().doc_id == 2999


def test_exact_frequent_text_that_is_a_small_share(spark, capsys):
    """A text in one of 1500 rows is dealt over salts all the same; no row goes through a window."""
    rows = [(i, "often" if i % 1500 == 0 else f"own {i}") for i in range(6000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hot = exact_dedup.hot_digests(table, "text", piece_rows=2)
    assert [r[f"{exact_dedup._P}salts"] for r in hot.collect()] == [2]
    got = exact_dedup.mark_copies(table, piece_rows=2)
    assert got.where("group_size = 4 and keep_id = 4500").count() == 4 and got.where("kept").count() == 5997
    got.explain("formatted")
    plan = capsys.readouterr().out
    assert "Window" not in plan and "partial_collect_list" in plan


def test_exact_very_long_texts(spark):
    long = "x y " * 500_000
    table = spark.createDataFrame([(1, long), (2, long + "z"), (3, long)], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.mark_copies(table).collect()} == {(1, 3, False), (3, 3, True), (2, 2, True)}


def test_exact_hot_text_without_ids(spark, monkeypatch):
    """A third of all rows has one text and no id, another third one text and one id; salts are small."""
    monkeypatch.setattr(exact_dedup, "PIECE_ROWS", 50)
    rows = [(None, "no id")] * 1000 + [(7, "one id")] * 1000 + [(i, f"own {i}") for i in range(1000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert {r[f"{exact_dedup._P}salts"] for r in exact_dedup.hot_digests(table, "text").collect()} == {20}
    got = exact_dedup.mark_copies(table)
    assert got.count() == 3000
    assert got.where("kept and keep_id is null and group_size = 1000").count() == 1
    assert got.where("kept and keep_id = 7 and doc_id = 7 and group_size = 1000").count() == 1
    assert got.where("kept").count() == 1002
    assert exact_dedup.drop_copies(table).count() == 1002


def test_exact_tells_texts_of_one_digest_apart(docs, rows, monkeypatch):
    """Content decides: with a digest that is the same for all texts, results are the same."""
    want = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.mark_copies(docs).collect())
    monkeypatch.setattr(exact_dedup, "_digest", lambda text: F.unhex(F.sha2(F.lit("one"), 256)))
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.mark_copies(docs).collect()) == want
    assert exact_dedup.drop_copies(docs).count() == len({r[1] or "" for r in rows})


def test_exact_empty(empty):
    assert exact_dedup.mark_copies(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(words) < width:
        return {tuple(words)}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width=2, percent=80):
    sets = [shingles(r[1], width) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][0] == rows[j][0] and rows[i][0] is not None) or (sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(find(i)), r[0] is not None and r[0] == least.get(find(i))) for i, r in enumerate(rows))


def test_near_against_brute_force(docs, rows):
    assert Counter(tuple(r) for r in near_dedup.near_groups(docs).collect()) == brute(rows)


def test_near_wider_shingles(docs, rows):
    assert Counter(tuple(r) for r in near_dedup.near_groups(docs, width=5).collect()) == brute(rows, 5)


def test_near_chains_and_large_groups(spark):
    """Each text differs a little from the next, so that ends of the chain are not similar; and a group of many near copies."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:40] + [f"x{j}" for j in range(i)] + base[40 + i :])) for i in range(40)]
    other = [f"v{i}" for i in range(150)]
    rows += [(100 + i, " ".join(other[: i % 150] + [f"n{i}"] + other[i % 150 + 1 :])) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in near_dedup.near_groups(table).collect()) == brute(rows)


def test_near_many_blocks_and_thue_morse_words(spark, monkeypatch):
    """Blocks of a few sets; words that collide under polynomial hashes; columns named like working ones."""
    monkeypatch.setattr(near_dedup, "LEAST_BLOCK", 3000)
    odd, even = ("".join("ab"[(bin(i).count("1") + k) & 1] for i in range(4096)) for k in (0, 1))
    other = [f"v{i}" for i in range(150)]
    rows = [(i, odd if i % 2 else even) for i in range(4)] + [(10, f"{odd} x y"), (11, f"{even} x y"), (12, "z " * 30_000)]
    rows += [(100 + i, " ".join([f"n{i}" if k % 9 == i % 9 and k < 9 * (i % 4) else w for k, w in enumerate(other)])) for i in range(300)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node long, set_key string")
    assert Counter(tuple(r) for r in near_dedup.near_groups(table).collect()) == brute(rows)


def test_near_drop(docs, empty, rows):
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    groups = brute(rows)
    gone = {k[0] for k in groups if k[0] is not None and not k[3]}
    assert Counter(tuple(r) for r in kept.collect()) == Counter(r for r in rows if r[0] not in gone)
    assert near_dedup.near_groups(empty).count() == 0


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(1)
    for share in (0.7, 0.8, 0.9, 0.97):
        a = np.unique(rng.integers(1, 2**63, 2000, dtype=np.uint64))
        k = int(len(a) * 2 * share / (1 + share))
        b = np.unique(np.concatenate((a[:k], rng.integers(1, 2**63, len(a) - k, dtype=np.uint64))))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        samples = near_dedup.minhashes(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), 512)
        s = near_dedup.odd_sketches(samples)
        assert abs(near_dedup.sketch_similarity(s[:1], s[1:], 512)[0] - true) < 0.08


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
