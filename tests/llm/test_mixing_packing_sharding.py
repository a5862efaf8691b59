from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import mixing, packing, sharding
from spanloom.llm.shared import prefix_offsets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def goals(sizes: dict, total_share=1.5, cap=2.0) -> dict:
    """Targets by resharing what is cut off until nothing is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), total_share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        open_ -= over
    return target


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = goals(dict(sizes))
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    largest = max(r["size"] for r in got)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest
    again = mixing.mix(docs.repartition(3)).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in again) == Counter((r["doc_id"], r["taken"]) for r in got)
    emitted = Counter(r["doc_id"] for r in mixing.mixed(docs).collect())
    want_copies = Counter()
    for r in got:
        want_copies[r["doc_id"]] += r["copies"]
    assert emitted == +want_copies


def test_mixing_clashing_columns_and_empty(spark, empty):
    table = spark.createDataFrame([(1, "a b", "x", 9, "q"), (2, None, None, 9, "r")], "doc_id long, text string, source string, size long, _class string")
    got = {r["doc_id"]: r["size"] for r in mixing.mix(table.drop("_class")).collect()}
    assert got == {1: 2, 2: 0}
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


@pytest.mark.parametrize(("cell", "block"), [(1, 1), (2, 3), (1000, 4096)])
def test_mixing_in_cells_of_any_size(docs, monkeypatch, cell, block):
    """Whatever the cells, each source's places run from 1 to its number of rows, so its copies add up alike."""
    monkeypatch.setattr(mixing, "CELL_ROWS", cell)
    monkeypatch.setattr(mixing, "BLOCK_CELLS", block)
    got = mixing.mix(docs).groupBy("source").agg({"copies": "sum", "target": "max", "source_size": "max"}).collect()
    n = {r["source"]: r["count"] for r in docs.groupBy("source").count().collect()}
    for r in got:
        assert abs(r["sum(copies)"] - n[r["source"]] * r["max(target)"] / r["max(source_size)"]) <= 1


@pytest.mark.parametrize("n", [1_000_000, 10_000_000])
def test_packing_long_white_space(spark, n):
    """The fast pattern fails on white space as long as this; the ids are the tokenizer file's."""
    texts = [" " * n + "a", "\n" * n, "x" + "\t " * (n // 2) + "y"][: 3 if n == 1_000_000 else 1]
    got = packing.pack(spark.createDataFrame([*enumerate(texts)], "doc_id int, text string"))
    sums = {r.doc_id: r for r in got.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()}
    for i, text in enumerate(texts):
        assert sums[i]["sum(length)"] == sums[i]["max(doc_tokens)"] == len(packing.tokenizer(packing.vocabulary_path())(text)) + 1


def test_packing_round_trip(docs, rows, empty):
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    whole = Tokenizer.from_file(path)
    length = 128
    pieces = packing.pack(docs, length=length).collect()
    own = defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] > 0
        own[p["doc_id"]].append((p["start"], ids, p["doc_tokens"]))
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(whole.encode(r[1] or "", add_special_tokens=False).ids + [1])
    for i, parts in own.items():
        copies = len(texts[i])
        ids = texts[i][0]
        assert all(t == ids for t in texts[i])
        assert Counter(sum((p[1] for p in sorted(parts)), [])) == Counter(ids * copies)
        if copies == 1:
            assert sum((p[1] for p in sorted(parts)), []) == ids
            assert [p[0] for p in sorted(parts)] == list(np.cumsum([0] + [len(p[1]) for p in sorted(parts)])[:-1])
        assert all(p[2] == len(ids) for p in parts)
    assert set(own) == set(texts)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for k, parts in sequences.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or k == len(sequences) - 1
    assert packing.pack(empty).count() == 0


def test_packing_cuts_without_python_and_tokenises_small_batches(spark, monkeypatch):
    from pyspark.sql import functions as F

    sizes = []

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(1).nbytes])], names=["n"])

    texts = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 400).alias("text"))

    def tokenised(docs, *args):
        sizes.extend(r["n"] for r in docs.select("doc_id", "text").mapInArrow(run, "n long").collect())
        return whole(docs, *args)

    whole = packing.tokenised
    monkeypatch.setattr(packing, "tokenised", tokenised)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    pieces = packing.pack(texts)
    assert spark.conf.get(name) == before
    assert len(sizes) > 3 and max(sizes) < 4_000_000 and sum(sizes) > 13_000_000
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Python" not in plan
    assert pieces.agg(F.sum("length")).first()[0] == 3000 * (len(packing.tokenizer(packing.vocabulary_path())("some words " * 400)) + 1)


def test_fast_ids_are_the_files_ids():
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    whole, fast = Tokenizer.from_file(path), packing.tokenizer(path)
    for text in ["", " ", "\n\n  a", "it's 12345 x²", "汉字 かな 한글 ‍👩‍👩‍👧", "a<|endoftext|>b", "  x　", "ﬁ Ǆ ß İ ẞ", "é é", "\x00\x01", "-" * 3000, "ab" * 5000, "١٢٣ ⅷ ½", "don't WE'LL"]:
        assert fast(text).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_sharding(docs, rows, empty):
    got = sharding.shuffled_shards(docs, 7, bucket_bytes=2000).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shuffled_shards(empty).count() == 0


def test_sharding_orders_differ_by_seed_and_spread_copies(spark):
    table = spark.createDataFrame([(i, "same", i) for i in range(2000)], "doc_id long, text string, shard long")
    one = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shuffled_shards(table, 4, 1, bucket_bytes=20_000).collect()}
    two = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shuffled_shards(table, 4, 2, bucket_bytes=20_000).collect()}
    assert one != two
    places = np.array([s * 4 + k for k, s in (one[i] for i in range(2000))])
    assert abs(np.corrcoef(np.arange(2000), places)[0, 1]) < 0.1
    assert sum(places[i + 1] - places[i] == 1 for i in range(1999)) < 20


def test_sharding_reruns_agree_however_rows_are_partitioned(docs, rows):
    def places(table):
        return sorted(map(str, sharding.shuffled_shards(table, 7, bucket_bytes=2000, partition_bytes=5000).collect()))

    one = places(docs.repartition(3))
    assert one == places(docs.coalesce(1)) == places(docs.orderBy("n_chars"))


def test_sharding_numbers_equal_rows(spark, monkeypatch):
    """Rows that repeat in every column, ids null, are a third of all; they are numbered in pieces and spread over the buckets."""
    monkeypatch.setattr(sharding, "PIECE_ROWS", 100)
    rows = [(None, "same")] * 1000 + [(i, f"t{i}") for i in range(2000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (sharding.shuffled_shards(t, 5, bucket_bytes=10_000) for t in (table.repartition(7), table.repartition(2)))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    got = one.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(5) for k in range(600)]
    same = sorted(r.slot * 5 + r.shard for r in got if r.doc_id is None)
    assert sum(b - a == 1 for a, b in zip(same, same[1:])) < 450  # 333 expected if mixed


def test_write_shards(docs, spark, tmp_path):
    path = f"{tmp_path}/shards"
    sharding.write_shards(docs, path, 3)
    assert spark.read.parquet(path).count() == docs.count()


def test_prefix_offsets(spark):
    counts = spark.createDataFrame([(k, k % 5 + 1) for k in range(0, 1000, 3)], "k long, n long")
    got = {r["k"]: r["o"] for r in prefix_offsets(counts, "k", "n", "o", block=64).collect()}
    at = 0
    for k in range(0, 1000, 3):
        assert got[k] == at
        at += k % 5 + 1


def test_crc_of_pieces(spark):
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    row = packing.pack(table).withColumn("crc", F.crc32("ids")).first()
    assert row["crc"] == zlib.crc32(row["ids"])
