"""Places of a pattern's matches by Arrow batches, for texts of many matches.

`text.spans` folds over arrays element by element, which costs some
microseconds a match.  Here Spark's own regular expression marks the matches in
one search (so they are the same), and starts add up from the gaps for a whole
batch at once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as T

#: Bytes of marked texts that are looked at together; a longer text is by itself.
SLICE = 2_000_000


def marked(text: Column, pattern: str) -> list[Column]:
    """marked: the text with a mark at both ends of each match; parts: gap and match by turns, for texts that hold the mark themselves."""
    text = F.coalesce(text, F.lit(""))
    own = text.contains(T.MARK)
    pairs = F.arrays_zip(F.split(text, pattern).alias("gap"), T.matches(text, pattern).alias("value"))
    parts = F.flatten(F.transform(F.filter(pairs, lambda p: p["value"].isNotNull()), lambda p: F.array(p["gap"], p["value"])))
    return [F.when(~own, F.regexp_replace(text, pattern, f"{T.MARK}$0{T.MARK}")).alias("marked"), F.when(own, parts).alias("parts")]


class Found(NamedTuple):
    """Matches of some texts, in order."""

    row: np.ndarray  #: the text's number
    at: np.ndarray  #: the match's number in its text
    start: np.ndarray
    len: np.ndarray
    element: np.ndarray  #: where the match is among pieces; the gap before it is there less one
    pieces: pa.Array  #: gap and match by turns

    @property
    def value(self) -> pa.Array:
        return self.pieces.take(pa.array(self.element))


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch (with marked) by about SLICE bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch["marked"]), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, side="right"))
        end = min(max(end, at + 1), len(batch))
        yield batch.slice(at, end - at)
        at = end


def located(batch: pa.RecordBatch) -> Found:
    """The matches of a batch with marked and parts."""
    lists = pc.split_pattern(pc.fill_null(batch["marked"], ""), T.MARK)
    if batch["parts"].null_count < len(batch):
        lists = pa.array([b if a is None else a for a, b in zip(batch["parts"].to_pylist(), lists.to_pylist(), strict=True)], pa.list_(pa.string()))
    offsets, pieces = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
    offsets = offsets - offsets[0]
    row = np.repeat(np.arange(len(lists)), np.diff(offsets))
    inside = np.arange(len(pieces)) - offsets[row]
    size = pc.utf8_length(pieces).to_numpy().astype(np.int64)
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
    element = np.flatnonzero(inside % 2)
    own = row[element]
    return Found(own, inside[element] // 2, ends[element] - ends[offsets[own]], size[element], element, pieces)


def model_words(docs: DataFrame, tlds: list[str], schemes: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tok_id, start, len and value of every word as `text.model_words` has them with addresses of these top-level domains and schemes."""
    if not all(any(c.isalpha() for c in x) for x in [*tlds, *schemes]):
        raise ValueError("a top-level domain or a scheme without a letter")

    def value(word: str) -> str:
        # An address has a letter, and none of the other forms has one.
        if any(unicodedata.category(c) == "Nd" for c in word) and not any(c.isalpha() for c in word):
            return T.NUMBER
        if len(word) <= 2:
            if all(c in "-—–‐‑‒―" for c in word):
                return "-"
            if word == "''" or (len(word) == 1 and word in "«»“”„‘’‚‹›‛"):
                return '"'
            if word == ",,":
                return ","
        return word

    def odd(words: pa.Array) -> np.ndarray:
        """Words without a letter of ASCII: only these may be numbers or marks."""
        return pc.invert(pc.match_substring_regex(words, "[A-Za-z]")).to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in sliced(batch):
                w = located(piece)
                coded = w.value.dictionary_encode()
                names, which = coded.dictionary, odd(coded.dictionary)
                names = pc.replace_with_mask(names, pa.array(which), pa.array([value(x) for x in names.filter(pa.array(which)).to_pylist()], pa.string()))
                code = coded.indices.to_numpy()
                number = pc.equal(names, T.NUMBER).to_numpy(zero_copy_only=False)[code]
                # A run of numbers is one word, from its first one's start to its last one's end.
                joined = np.zeros(len(code), bool)
                joined[1:] = number[1:] & number[:-1] & (w.row[1:] == w.row[:-1])
                first = np.flatnonzero(~joined)
                last = np.concatenate((first[1:], [len(code)]))[: len(first)] - 1
                row, start = w.row[first], w.start[first]
                ahead = np.searchsorted(row, np.arange(len(piece)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(pa.array(row)), pa.array(np.arange(len(row)) - ahead[row], pa.int32()), pa.array(start, pa.int32()), pa.array(w.start[last] + w.len[last] - start, pa.int32()), names.take(pa.array(code[first]))],
                    names=["doc_id", "tok_id", "start", "len", "value"],
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), *marked(F.col(text), T.model_pattern(T.url_pattern(tlds, schemes))))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, tok_id int, start int, len int, value string")
