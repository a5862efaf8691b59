"""Two-pass external shuffle, with DataFrame functions only.

First pass: records scatter uniformly into memory-sized buckets by a seeded
hash.  Second pass: each bucket is put in Fisher-Yates order (Spark's shuffle
function, which draws one index of the rest for every place) and written.
Prefix sums over the buckets' counts then give every record its place in one
global order; the place modulo the number of shards is its shard, so shard
counts differ by one at most (law `rows`).

The hash takes the seed, the whole row and, for rows that are equal in every
column, a running number, so the seed and the rows alone decide the result: not
how they are partitioned or how often a task ran.  Equal rows are numbered in
salted pieces, so that no number of them makes one task or bucket large.

Defined results: rows with null or repeated ids are ordinary records; null text
is empty; an empty table gives no rows; other columns are carried along
(columns of map type, which have no hash, don't decide places), but for input
columns named shard or slot, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from spanloom.llm.shared import prefix_offsets, small_or_shuffled, written

BUCKET_BYTES = 8_000_000
#: Buckets share shuffle partitions of so many bytes, one bucket at least.
PARTITION_BYTES = 16_000_000
#: Equal rows are numbered in pieces of about so many.
PIECE_ROWS = 50_000
_KEY = ["_h1", "_h2"]


def _numbered(keyed: DataFrame) -> DataFrame:
    """keyed with _tie: 0, or a running number among rows of equal keys."""
    repeats = written(keyed.groupBy(*_KEY).agg(F.count("*").alias("_n")).where("_n > 1"), "repeats")
    if repeats.isEmpty():
        return keyed.withColumn("_tie", F.lit(0).cast("long"))
    pieces = repeats.select(*_KEY, F.ceil(F.col("_n") / PIECE_ROWS).cast("long").alias("_pieces"))
    joined = keyed.join(small_or_shuffled(pieces), _KEY, "left")
    # Equal rows can stand for each other: any piece will do, as long as the numbers are 0, 1, 2 and so on.
    again = joined.where("_pieces is not null").withColumn("_piece", F.pmod(F.monotonically_increasing_id(), F.col("_pieces"))).drop("_pieces")
    again = written(again, "equal")
    before = W.partitionBy(*_KEY).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    counts = again.groupBy(*_KEY, "_piece").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(W.partitionBy(*_KEY, "_piece").orderBy(F.lit(0))) - 1
    again = again.withColumn("_place", place).join(counts, [*_KEY, "_piece"]).withColumn("_tie", F.col("_before") + F.col("_place"))
    return joined.where("_pieces is null").select(*_KEY, "row", F.lit(0).cast("long").alias("_tie")).unionByName(again.select(*_KEY, "row", "_tie"))


def shuffled_shards(
    docs: DataFrame, n_shards: int = 24, seed: int = 1, text: str = "text", bucket_bytes: int = BUCKET_BYTES, partition_bytes: int = PARTITION_BYTES
) -> DataFrame:
    """All rows and columns of docs, with shard and slot (its place in the shard, from 0)."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64)).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    columns = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # A null leaves Spark's hash as it was, so which columns are null is part of the hash too.
    nulls = F.concat(*[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in columns]) if columns else F.lit("")
    keyed = docs.select(*[F.xxhash64(F.lit(seed), F.lit(k), nulls, *columns).alias(k) for k in _KEY], row.alias("row"))
    scattered = _numbered(keyed)
    scattered = scattered.select(F.xxhash64(*_KEY, "_tie").alias("key"), *_KEY, "_tie", "row")
    scattered = scattered.withColumn("bucket", F.pmod("key", F.lit(buckets)))
    partitions = max(1, min(buckets, math.ceil(total / partition_bytes)))
    # Sorted by key, a bucket is the same whatever the order its records arrived in; sorted by bucket, so is the draw for each.
    gathered = (
        scattered.repartition(partitions, "bucket")
        .groupBy("bucket")
        .agg(F.array_sort(F.collect_list(F.struct("key", *_KEY, "_tie", "row"))).alias("rows"))
        .sortWithinPartitions("bucket")
    )
    ordered = gathered.select("bucket", F.posexplode(F.shuffle("rows", seed)).alias("pos", "record"))
    ordered = written(ordered.select("bucket", "pos", "record.row"), "buckets")
    counts = ordered.groupBy("bucket").agg(F.count("*").alias("n"))
    places = small_or_shuffled(prefix_offsets(counts, "bucket", "n", "base"), buckets)
    place = F.col("base") + F.col("pos")
    own = ["shard", "slot"]
    return ordered.join(places, "bucket").select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in own],
        F.pmod(place, F.lit(n_shards)).cast("int").alias("shard"), F.floor(place / n_shards).cast("long").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, seed: int = 1, file_rows: int = 100_000) -> None:
    """One folder for each shard, its records in slot order in files of at most file_rows."""
    placed = shuffled_shards(docs, n_shards, seed).withColumn("_file", F.floor(F.col("slot") / file_rows))
    n_files = max(1, math.ceil(docs.count() / file_rows))
    placed.repartition(max(n_shards, n_files), "shard", "_file").sortWithinPartitions("shard", "slot").drop("_file").write.partitionBy("shard").option("maxRecordsPerFile", file_rows).parquet(path)
