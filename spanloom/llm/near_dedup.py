"""Near-duplicates by MinHash bands, odd sketches and a check on full shingle sets.

A document's set holds its distinct 2-word shingles (64-bit hashes).  Rows
with equal sets form a class, and one row stands for it from there on.
BANDS x ROWS MinHash samples give band keys; each class also folds its samples
into an odd sketch, a bitmap in which a sample flips one bit.  The XOR of two
sketches has about m/2 * (1 - exp(-4k(1-J)/m)) bits, which tells a high
similarity J precisely: pairs far below the threshold go no further.  The rest
are confirmed on their full sets.

Candidates are no all-pairs lists.  In each band bucket the smallest member is
the hub and the others are tried against it.  Where the members of a bucket
then lie in more than one component, those outside its largest one are held
against the members of such buckets that lie in that component and against each
other, set by set, in blocks.  So every pair that shares a bucket and is not yet
connected is tested, once for all its buckets, and links inside a component need
no test.  At J = 0.8 a pair shares no bucket with probability
(1 - 0.8^8)^64 = 8e-6.  Sets hold 64-bit hashes without structure: two of n
different shingles share one with probability n^2 / 4e19.

Defined results: without words a document is linked with nothing; rows with
equal doc_id are one document; rows without doc_id get the component of their
equals, or null; a text of any length is read whole; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm import words
from spanloom.llm.components import components
from spanloom.llm.shared import small_or_shuffled, tidy, tidy_group, written

SHINGLE = 2
PERCENT = 80
BANDS, ROWS = 64, 8
SKETCH_BITS = 1024
#: A pair is dropped unread if its sketches estimate less than this below the threshold (six standard deviations).
MARGIN = 0.15
#: Bytes of sets in one block where nodes meet a component: MANY_BLOCKS a side, between these bounds.
LEAST_BLOCK, MOST_BLOCK, MANY_BLOCKS = 200_000, 8_000_000, 64
_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row in ascending order, and where each row's begin."""
    hashes, at = words.word_hashes(data, offsets)
    n = np.diff(at)
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), counts)
    first = np.repeat(at[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    key = np.zeros(len(row), _U)
    for k in range(width):
        here = k < n[row]
        part = hashes[np.minimum(first + k, len(hashes) - 1)] if len(hashes) else key
        key = words.mix(key * _U(0x9E3779B97F4A7C15) + np.where(here, part, _U(0)) + _U(k + 1))
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    key, row = key[new], row[new]
    return key, np.searchsorted(row, np.arange(len(n) + 1))


def set_keys(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two 64-bit sums for each row that name its set."""
    out = np.zeros((len(at) - 1, 2), _U)
    for k, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
        sums = np.zeros(len(keys) + 1, _U)
        np.cumsum(words.mix(keys ^ _U(salt)), out=sums[1:])
        out[:, k] = sums[at[1:]] - sums[at[:-1]]
    return out


def minhashes(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """n samples of each row's set (rows with an empty set: all ones), as rows x n."""
    out = np.full((len(at) - 1, n), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    begin = at[:-1][full]
    x = (keys >> _U(32)).astype(np.uint32)
    random = words.mix(np.arange(1, 2 * n + 1, dtype=_U)).astype(np.uint32)
    times, plus = random[:n] | np.uint32(1), random[n:]
    work, low = np.empty_like(x), np.empty((n, len(full)), np.uint32)
    for i in range(n):
        np.bitwise_xor(x, plus[i], out=work)
        np.multiply(work, times[i], out=work)
        np.minimum.reduceat(work, begin, out=low[i])
    out[full] = low.T
    return out


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = samples.reshape(len(samples), bands, rows).astype(_U)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=_U), s.shape[:2]).copy()
    for j in range(rows):
        key = words.mix(key * _U(0x9E3779B97F4A7C15) + s[:, :, j])
    return key.view(np.int64)


def odd_sketches(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Each sample flips the bit that it and its number hash to; rows x bits / 8 bytes."""
    n, k = samples.shape
    bit = words.mix(samples.astype(_U) + (np.arange(k, dtype=_U) << _U(32))) % _U(bits)
    flips = np.bincount((np.arange(n)[:, None] * bits + bit.astype(np.int64)).ravel(), minlength=n * bits)
    return np.packbits((flips & 1).astype(np.uint8).reshape(n, bits), axis=1)


def sketch_similarity(a: np.ndarray, b: np.ndarray, samples: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Estimated Jaccard similarity of each pair of sketches."""
    differ = np.bitwise_count(a ^ b).sum(axis=1).astype(float)
    return 1 + bits / (4 * samples) * np.log(np.maximum(1 - 2 * differ / bits, 1e-9))


def _profiles(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.utf8(batch.column(1))
            for i, j in words.slices(offsets, 400_000):
                here = offsets[i : j + 1] - offsets[i]
                keys, at = shingle_sets(data[offsets[i] : offsets[j]], here, width)
                samples = minhashes(keys, at, bands * rows)
                bands_of, sketches = band_keys(samples, bands, rows), odd_sketches(samples)
                lists = pa.ListArray.from_arrays(np.arange(0, (j - i + 1) * bands, bands, dtype=np.int32), pa.array(bands_of.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(at).astype(np.int64)), pa.array([x.tobytes() for x in set_keys(keys, at)], pa.binary()), lists, pa.array([x.tobytes() for x in sketches], pa.binary())],
                    names=["doc_id", "n", "set_key", "bands", "sketch"],
                )

    return docs.mapInArrow(tidy(run), "doc_id long, n long, set_key binary, bands array<long>, sketch binary")


def _likely(pairs: DataFrame, classes: DataFrame, samples: int, percent: int) -> DataFrame:
    """The pairs whose sizes and sketches allow the similarity, with the estimate."""
    least = percent / 100 - MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 4096) for b in batches for k in range(0, len(b), 4096)):
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(len(batch), -1) for k in (2, 3))
            estimate = sketch_similarity(a, b, samples)
            keep = pa.array(estimate >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(estimate).filter(keep)], names=["a", "b", "estimate"])

    side = classes.select("node", "n", "sketch")
    both = pairs.join(side.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    both = both.join(side.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    both = both.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return both.select("a", "b", "sa", "sb").mapInArrow(tidy(run), "a long, b long, estimate double")


def _sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, set (ascending 64-bit hashes): recomputed from the texts of the rows that stand for the nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.utf8(batch.column(1))
            wanted = batch.column(2).to_pylist()
            for i, j in words.slices(offsets, 2_000_000):
                keys, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                found = [x.tobytes() == w for x, w in zip(set_keys(keys, at), wanted[i:j], strict=True)]
                sets = [keys[p:q].tobytes() for p, q in zip(at[:-1], at[1:], strict=True)]
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sets, pa.binary())], names=["node", "set"])
                yield out.filter(pa.array(found))

    nodes = small_or_shuffled(nodes.select(F.col("node").alias("doc_id"), "set_key"))
    return docs.join(nodes, "doc_id").select("doc_id", "text", "set_key").mapInArrow(tidy(run), "node long, set binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 512) for b in batches for k in range(0, len(b), 512)):
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(a, _U), np.frombuffer(b, _U)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long").distinct()


def near_groups(
    docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    profiles = written(_profiles(docs, width, bands, rows), "profiles")
    classes = profiles.where("n > 0 and doc_id is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")
    )
    classes = written(classes, "classes")

    # Buckets of one band key.  Two members are one pair; larger buckets are kept as members.
    members = classes.select("node", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count("*").alias("m")).where("m > 1")
    buckets = written(buckets, "buckets")
    many = written(members.join(buckets.where("m > 2").select("key", "hub", "m"), "key"), "members")
    tried = buckets.where("m = 2").select(F.col("hub").alias("a"), F.col("last").alias("b"))
    tried = tried.unionByName(many.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))).where("a <> b").distinct()
    likely = written(_likely(tried, classes, bands * rows, percent), "likely")

    # Each node's most similar hub first: most links of the rest then lie inside a component and need no test.
    best = likely.groupBy("b").agg(F.max_by("a", "estimate").alias("a"))
    sets = _wanted_sets(docs, classes, _ends(likely), None, width)
    first = written(_confirmed(best, sets, percent), "confirmed")
    rest = _across(likely.join(best, ["a", "b"], "left_anti"), _three_up(first))
    labels = components(first.unionByName(_confirmed(rest, sets, percent)))

    # Buckets that hold more than one component: members outside the largest one meet that component and each other.
    inside = _labelled(many.select("key", "node"), labels)
    largest = inside.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = largest.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("core"), F.count("*").alias("roots")).where("roots > 1")
    asked = inside.join(largest.select("key", "core"), "key").select("core", "node", (F.col("root") != F.col("core")).alias("asks"))
    asked = written(asked.groupBy("core", "node").agg(F.max("asks").alias("asks")), "asking")
    asking, asked = asked.where("asks").select("core", "node"), asked.select("core", "node")
    if not asking.isEmpty():
        sets = _wanted_sets(docs, classes, asked.select("node").distinct(), sets, width)
        more = written(_block_links(asking, asked, sets, percent), "confirmed")
        if not more.isEmpty():  # links between components: join these, and their nodes follow
            ends = more.select("a", F.col("b").alias("node"))
            ends = _labelled(ends, labels).select(F.col("a").alias("node"), F.col("root").alias("b"))
            joined = components(_labelled(ends, labels).select(F.col("root").alias("a"), "b"))
            known = labels.unionByName(joined.select("node", F.col("node").alias("root"))).dropDuplicates(["node"])
            labels = known.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))

    # A node is its class's smallest doc_id and a root its component's smallest node: the smallest doc_id reachable.
    own = _labelled(classes.select("set_key", "node"), labels).select("set_key", F.col("root").alias("component_id"))
    # Rows without words have keys of their own, so that they are no hot key of the join.
    out = profiles.select("doc_id", "n", F.when(F.col("n") > 0, F.col("set_key")).otherwise(F.encode(F.col("doc_id").cast("string"), "UTF-8")).alias("set_key")).join(own, "set_key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """nodes with the root of their component (a node without links is its own)."""
    return nodes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _three_up(links: DataFrame) -> DataFrame:
    """node, root of links that give each b one smaller a: three steps up, which is the root of most."""
    up = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    for _ in range(2):
        step = links.select(F.col("b").alias("root"), F.col("a").alias("_a"))
        up = up.join(step, "root", "left").select("node", F.coalesce("_a", "root").alias("root"))
    return up


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs that lie in two components."""
    a, b = (labels.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")) for k in "ab")
    pairs = pairs.select("a", "b").join(a, "a", "left").join(b, "b", "left")
    return pairs.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _wanted_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, have: DataFrame | None, width: int) -> DataFrame:
    """node, set of the nodes, and of those there are already."""
    if have is not None:
        nodes = nodes.join(have.select("node"), "node", "left_anti")
    more = written(_sets(docs, nodes.join(classes.select("node", "set_key"), "node"), width), "sets")
    return more if have is None else have.unionByName(more)


def _block_links(asking: DataFrame, asked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the asking nodes to the nodes asked under the same core, one at least for each pair that is similar enough.

    Both sides of a core are dealt into blocks of sets by a hash, and each block
    of the one meets each block of the other: a query set against rows in
    blocks, with full sets, and rows grow with neither side's square.
    """

    def dealt(side: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        side = side.join(sets, "node")
        blocks = side.groupBy("core").agg(F.sum(F.length("set")).alias("bytes"))
        size = F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(MOST_BLOCK), F.col("bytes") / MANY_BLOCKS))
        blocks = blocks.select("core", F.ceil(F.col("bytes") / size).alias(f"{name}s"))
        return side, blocks

    q, q_blocks = dealt(asking, "q")
    t, t_blocks = dealt(asked, "t")
    blocks = written(q_blocks.join(t_blocks, "core"), "blocks")
    block = lambda n: F.pmod(F.xxhash64("node", F.lit(1)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    q = q.join(blocks, "core").withColumn("q", block("qs")).withColumn("t", every("ts")).select("core", "q", "t", "node", "set")
    t = t.join(blocks, "core").withColumn("t", block("ts")).withColumn("q", every("qs")).select("core", "q", "t", "node", "set")

    def run(asking: pa.Table, asked: pa.Table) -> pa.Table:
        nodes = asked.column("node").to_numpy()
        own = [np.frombuffer(x, _U) for x in asked.column("set").to_pylist()]
        sizes = np.array([len(x) for x in own], np.int64)
        keys, owner = np.concatenate([np.zeros(0, _U), *own]), np.repeat(np.arange(len(own)), sizes)
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        a, b = [], []
        for node, x in zip(asking.column("node").to_pylist(), asking.column("set").to_pylist(), strict=True):
            x = np.frombuffer(x, _U)
            begin = np.searchsorted(keys, x)
            n = np.searchsorted(keys, x, side="right") - begin
            at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(own))
            hits = nodes[(100 * both >= percent * (sizes + len(x) - both)) & (both > 0) & (nodes != node)]
            a += [node] * len(hits)
            b += hits.tolist()
        # A spanning forest of these links says as much as all of them.
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        keep = []
        for u, v in zip(a, b, strict=True):
            p, r = find(u), find(v)
            if p != r:
                root[max(p, r)] = min(p, r)
                keep.append((u, v))
        return pa.table([pa.array([u for u, _ in keep], pa.int64()), pa.array([v for _, v in keep], pa.int64())], names=["a", "b"])

    by = ["core", "q", "t"]
    t = t.select(*[F.col(c).alias(c) for c in t.columns])  # both sides come from the same tables; new columns keep them apart
    return q.groupBy(*by).cogroup(t.groupBy(*by)).applyInArrow(tidy_group(run, 2), "a long, b long")


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows that stay: one document of each group, with all columns."""
    doc_id = options.get("doc_id", "doc_id")
    groups = near_groups(docs, **options)
    gone = groups.where("not kept and component_id is not null").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(small_or_shuffled(gone), F.col(doc_id) == F.col("_gone"), "left_anti")
