"""Exact deduplication by skew-safe combining, with DataFrame functions only.

Texts are grouped by SHA-256 digest and full text, in three stages for every
row.  Each input task first combines its own copies (the partial aggregate).
Groups then meet under a salt: 0 for most, but a digest with more than
PIECE_ROWS rows is dealt over so many salts that each has about PIECE_ROWS.
Last, the winners of a digest's salts are combined into one.  Every grouping
and join has the text itself in its key, so content decides and not the digest
alone.  A text is shuffled once for each task that has it; its rows' ids travel
with it, so rows are never joined back to texts.

Defined results: null text counts as empty; of equal texts the row with the
largest doc_id stays (null ids are smallest); of rows that repeat both doc_id
and text exactly one stays; an empty table gives an empty table; other columns
are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import small_or_shuffled, written

#: Rows of one text that meet under one salt.
PIECE_ROWS = 1000
_P = "__xd_"  # prefix of working columns


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def hot_digests(docs: DataFrame, text: str, piece_rows: int | None = None) -> DataFrame:
    """Digests of more than piece_rows rows, at most one for so many rows of docs, and the number of salts of each."""
    piece_rows = piece_rows or PIECE_ROWS
    counts = docs.groupBy(_digest(F.coalesce(F.col(text), F.lit(""))).alias(f"{_P}digest")).agg(F.count("*").alias("n"))
    salts = F.ceil(F.col("n") / piece_rows).cast("long")
    return written(counts.where(F.col("n") > piece_rows).select(f"{_P}digest", salts.alias(f"{_P}salts")), "hot")


def _keyed(docs: DataFrame, hot: DataFrame, text: str) -> DataFrame:
    """docs with the text to compare, its digest, the number of salts (null unless the digest is hot) and a salt; no result depends on a row's salt."""
    full = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumn(f"{_P}text", full).withColumn(f"{_P}digest", _digest(full))
    docs = docs.join(small_or_shuffled(hot), f"{_P}digest", "left")
    salt = F.pmod(F.monotonically_increasing_id(), F.col(f"{_P}salts"))
    return docs.withColumn(f"{_P}salt", F.coalesce(salt, F.lit(0).cast("long")))


def _combined(keyed: DataFrame, first: list[Column], again: list[Column]) -> DataFrame:
    """One row for each distinct text: local and salted winners (first), then the salt winners of hot texts (again)."""
    by = [f"{_P}digest", f"{_P}text"]
    salted = keyed.groupBy(*by, f"{_P}salt", f"{_P}salts").agg(*first)
    hot = salted.where(f"{_P}salts is not null").groupBy(*by).agg(*again)
    return salted.where(f"{_P}salts is null").select(hot.columns).unionByName(hot)


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", piece_rows: int | None = None) -> DataFrame:
    """The rows that stay, with all their columns."""
    keyed = _keyed(docs, hot_digests(docs, text, piece_rows), text)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text], F.col(text).isNull().alias(f"{_P}null"))
    key = F.struct(F.col(doc_id))
    kept = _combined(
        keyed,
        [F.max_by(row, key).alias("row"), F.max(key).alias("key")],
        [F.max_by("row", "key").alias("row"), F.max("key").alias("key")],
    )
    value = F.when(~F.col(f"row.{_P}null"), F.col(f"{_P}text"))
    return kept.select([value.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def mark_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", piece_rows: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row, dropped ones too."""
    hot = hot_digests(docs, text, piece_rows)
    keyed = _keyed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias(text)), hot, text)
    by = [f"{_P}digest", f"{_P}text"]
    # Each salt's ids, the winner first; a salt has about piece_rows of them.
    ids = F.sort_array(F.collect_list(F.struct("doc_id")), asc=False).alias("ids")
    salted = keyed.groupBy(*by, f"{_P}salt", f"{_P}salts").agg(ids)
    alone = salted.where(f"{_P}salts is null").select(f"{_P}digest", "ids", F.col("ids")[0]["doc_id"].alias("keep_id"), F.size("ids").cast("long").alias("group_size"), F.lit(True).alias("wins"))
    if not hot.isEmpty():
        pieces = written(salted.where(f"{_P}salts is not null"), "pieces")
        winner = F.max(F.struct(F.col("ids")[0]["doc_id"].alias("doc_id"), F.col(f"{_P}salt").alias("salt")))
        best = pieces.groupBy(*by).agg(winner.alias("best"), F.sum(F.size("ids")).alias("group_size"))
        # Repeated texts look small when compressed: not to be broadcast.
        pieces = pieces.join(best.hint("merge"), by)
        pieces = pieces.select(f"{_P}digest", "ids", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col(f"{_P}salt") == F.col("best.salt")).alias("wins"))
        alone = alone.unionByName(pieces)
    sha = F.lower(F.hex(f"{_P}digest")).alias("text_sha256")
    rows = alone.select(F.posexplode("ids").alias("place", "id"), "keep_id", "group_size", "wins", sha)
    return rows.select(F.col("id.doc_id").alias(doc_id), "keep_id", "group_size", (F.col("wins") & (F.col("place") == 0)).alias("kept"), "text_sha256")
