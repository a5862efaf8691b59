"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Sources share TOTAL_SHARE times all words by weight; no target exceeds CAP
times its source's words, and what is cut off goes to the others by weight.
A document's expected copies are target / source words.  Along each source,
in an order by size class, these are summed from one random offset, and the
document is taken once for each integer its stretch of the sum crosses.

The sum is not run by one task a source: a source's size classes are cut into
cells of about CELL_ROWS rows at every size of the table.  Classes are summed in
order, blocks of BLOCK_CELLS cells within their class, cells within their block,
and rows within their cell.

Defined results: null text has size 0; a null source is a source of its own,
last in order; a source without words has target 0 and nothing is taken; equal
rows are taken one by one; an empty table gives no rows; input columns named
like the results (size, source_size, target, copies, taken) are replaced.
The same rows give the same mix, however they are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.shared import small_or_shuffled, written

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
CAP = 2
CELL_ROWS = 1000
BLOCK_CELLS = 4096
OWN = ["size", "source_size", "target", "copies", "taken"]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """8 classes for each power of two, in order of size, in whole numbers."""
    bits = F.length(F.bin(size))
    return (bits * 8 + F.pmod(F.floor(size * 8 / F.pow(F.lit(2.0), bits - 1)), F.lit(8))).cast("int")


def hashed(*parts: Column) -> Column:
    """A whole number below 2^32 from the MD5 of the parts (nulls are empty)."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size -> source, source_size, target.

    With a common level, a target is the lesser of level * weight and cap *
    size.  Sources in order of cap * size / weight: the level follows from the
    first one that it leaves below its cap.  One row a source.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1)
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", weight.cast("double")).withColumn("most", (F.col("source_size") * cap).cast("double"))
    order = W.orderBy(F.col("most") / F.col("weight"), "rank")
    full = F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    everything = F.sum("source_size").over(W.partitionBy()) * F.lit(float(total_share))
    ranked = ranked.withColumn("level", (everything - full) / rest)
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "rank", "level"))).over(W.partitionBy())
    return ranked.select(
        "source", "source_size", F.least(F.coalesce(level["level"] * F.col("weight"), F.col("most")), "most").alias("target")
    )


def mix(
    docs: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, cap: int = CAP, seed: int = 7,
    source: str = "source", text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """docs with size, source_size, target, copies (how often the mix takes the row) and taken (copies * size)."""
    docs = docs.drop(*OWN)

    def sized(columns: list[str]) -> DataFrame:
        d = docs.withColumn("size", n_words(F.col(text)))
        tie = [F.xxhash64(text).alias("_tie")] * bool(columns)  # of rows of equal size and id
        return d.select(*columns, *tie, "size", F.col(source).alias("_source"), F.col(doc_id).alias("_id"), size_class(F.col("size")).alias("_class"))

    light = written(sized([]), "sizes")
    classes = light.groupBy("_source", "_class").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    classes = written(classes, "classes")
    n_classes = classes.count()
    # A source has a few hundred classes at most, 8 for each power of two.
    lower = F.coalesce(F.sum("n").over(W.partitionBy("_source").orderBy("_class").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    salts = classes.select("_source", "_class", F.ceil(F.col("n") / CELL_ROWS).cast("long").alias("_salts"), lower.alias("_lower"))
    salts = small_or_shuffled(salts.withColumnRenamed("_source", "_s").withColumnRenamed("_class", "_c"), n_classes)
    # Null-safe also where no null can be: a plain equality would add a filter on the class and count the words twice.
    same_class = F.col("_source").eqNullSafe(F.col("_s")) & F.col("_class").eqNullSafe(F.col("_c"))

    def celled(d: DataFrame) -> DataFrame:
        d = d.join(salts, same_class).drop("_s", "_c")
        return d.withColumn("_salt", F.pmod(hashed(F.lit(seed), F.col("_id")), F.col("_salts"))).drop("_salts")

    sources = classes.groupBy(F.col("_source").alias("source")).agg(F.sum("words").alias("source_size"))
    goal = targets(sources, weights, total_share, cap).withColumnRenamed("source", "_g")
    key = ["_source", "_class", "_lower"]
    cells = celled(light).groupBy(*key, "_salt").agg(F.count("*").alias("n")).withColumn("_block", F.floor(F.col("_salt") / BLOCK_CELLS))

    def earlier(by: list[str], order: str) -> Column:
        return F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    blocks = cells.groupBy(*key, "_block").agg(F.sum("n").alias("n")).withColumn("_base", F.col("_lower") + earlier(key, "_block"))
    blocks = blocks.select(F.col("_source").alias("_bs"), F.col("_class").alias("_bc"), F.col("_block").alias("_bb"), "_base")
    cells = cells.withColumn("_inside", earlier([*key, "_block"], "_salt"))
    cells = cells.join(blocks, F.col("_source").eqNullSafe(F.col("_bs")) & (F.col("_class") == F.col("_bc")) & (F.col("_block") == F.col("_bb")))
    cells = cells.withColumn("_before", F.col("_base") + F.col("_inside"))
    cells = cells.join(F.broadcast(goal) if n_classes <= 100_000 else goal, F.col("_source").eqNullSafe(F.col("_g")))
    cells = written(cells.select(F.col("_source").alias("_s"), F.col("_class").alias("_c"), F.col("_salt").alias("_k"), "_before", "source_size", "target"), "cells")

    place = F.row_number().over(W.partitionBy("_source", "_class", "_salt").orderBy("size", "_id", "_tie"))
    placed = celled(sized([f"`{c}`" for c in docs.columns])).drop("_lower").withColumn("_place", place)
    same_cell = same_class & F.col("_salt").eqNullSafe(F.col("_k"))
    placed = placed.join(small_or_shuffled(cells), same_cell)
    offset = hashed(F.lit(seed), F.col("_source")) / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    end = F.col("_before") + F.col("_place")
    copies = (F.floor(offset + end * rate) - F.floor(offset + (end - 1) * rate)).cast("long")
    return placed.select(
        *[F.col(f"`{c}`") for c in docs.columns], "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken."""
    taken = mix(docs, **options).where("copies > 0")
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns if c not in OWN], F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")
