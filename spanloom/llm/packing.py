"""Packing token sequences by concatenating and cutting.

First pass: each task tokenises its documents, appends the end id and sums
their tokens as it goes, so a document's start within its task's stretch is
known at once; the ids are written to the shared folder.  Second pass: prefix
sums over the tasks' token totals give each stretch its place in one long
row of ids, which fixed windows cut, without Python.  A document that meets a
window's edge gives one record on each side.  Ids are never shuffled; only the
last window is padded.

Defined results: null text is empty and a document without text is its end id
alone; null or repeated doc_ids are documents like others; an empty table
gives no pieces; texts of any length are tokenised whole; other columns are
ignored.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import prefix_offsets, small_batches, small_or_shuffled, tidy, written

LENGTH = 2048
END_ID = 1
SPECIAL = "<|endoftext|>"
LONG_SPACE = re.compile(r"\s{1000}")
_tokenizers: dict[str, tuple] = {}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer(path: str):
    """Text -> ids of the byte-level BPE file at path, as a numpy array.

    Where the same vocabulary lies beside it as ranks (.tiktoken), those are
    used: the ids are the same and come four times as fast.  A text that has
    the special token's string, or white space so long that the fast pattern
    fails on it, goes to the tokenizer file itself.
    """
    if path in _tokenizers:
        return _tokenizers[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    files: dict = {}

    def by_file(text: str) -> np.ndarray:
        if not files:
            from tokenizers import Tokenizer

            files["whole"] = Tokenizer.from_file(path)
        return np.array(files["whole"].encode(text, add_special_tokens=False).ids, np.uint32)

    encode = by_file
    if os.path.exists(ranks_path):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            return by_file(text) if SPECIAL in text or LONG_SPACE.search(text) else fast.encode_to_numpy(text).astype(np.uint32)

    _tokenizers[path] = encode
    return encode


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, part, start (in its part), doc_tokens, and ids as little-endian unsigned 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = tokenizer(path), TaskContext.get().partitionId(), 0
        tail = np.array([end_id], np.uint32)
        for batch in batches:
            for k in range(0, len(batch), 256):
                piece = batch.slice(k, 256)
                ids = [np.concatenate((encode(t), tail)) if t else tail for t in piece.column(1).to_pylist()]
                n = np.array([len(x) for x in ids], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(np.full(len(n), part, np.int64)), pa.array(starts), pa.array(n), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())],
                    names=["doc_id", "part", "start", "doc_tokens", "ids"],
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, part long, start long, doc_tokens long, ids binary")


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, ids (binary), doc_tokens, sequence_id and offset."""
    with small_batches(docs.sparkSession):
        tokens = written(tokenised(docs, path or vocabulary_path(), end_id, doc_id, text), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    bases = small_or_shuffled(prefix_offsets(totals, "part", "n", "base"))
    placed = tokens.join(bases, "part").select("doc_id", (F.col("base") + F.col("start")).alias("at"), "doc_tokens", "ids")
    at, end = F.col("at"), F.col("at") + F.col("doc_tokens")

    def piece(sequence: Column) -> Column:
        a, b = F.greatest(at, sequence * length), F.least(end, (sequence + 1) * length)
        ids = F.substring("ids", (4 * (a - at) + 1).cast("int"), (4 * (b - a)).cast("int"))
        return F.struct((a - at).alias("start"), (b - a).alias("length"), ids.alias("ids"), sequence.alias("sequence_id"), (a - sequence * length).alias("offset"))

    sequences = F.sequence(F.expr(f"at div {length}"), F.expr(f"(at + doc_tokens - 1) div {length}"))
    pieces = placed.select("doc_id", "doc_tokens", F.inline(F.transform(sequences, piece)))
    return pieces.select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
