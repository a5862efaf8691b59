"""Language identification by prediction by partial matching (PPM).

For each language a context tree over bytes, up to ORDER bytes deep, is
learned from a bounded sample of labelled rows and then frozen.  A byte seen
after a context has probability n / (T + d) (T occurrences of the context, d
different bytes after it); the rest d / (T + d) escapes to the next shorter
context, from which the bytes seen in the longer one are excluded.  With
frozen counts that exclusion is one factor for each context, so a text's exact
code length is a sum of table lookups.  The language of the shortest code wins;
the score is its share of 2^-length over all languages.

The sample: about SAMPLE_DOCS different texts for each language, by a hash of the
text, and SAMPLE_BYTES of them, whole texts throughout.  Neither null or repeated
ids nor many copies of a text change it.  This bounds training and the size of the broadcast tables, whatever the corpus holds; more
than MOST_LANGUAGES different labels are an error, not cut.

Defined results: null text, or text without a letter, is `und` with score 0;
so is every text if no row has a language to learn from; of equal code lengths
the language first in order wins; a text of any length is read whole; an empty
table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from spanloom.llm import words
from spanloom.llm.words import Table
from spanloom.llm.shared import release, small_or_shuffled, tidy, written

ORDER = 4
SAMPLE_DOCS = 400
SAMPLE_BYTES = 2_000_000
#: Languages that one model may have: their trees are gathered on the driver and broadcast, about 10 MB each.
MOST_LANGUAGES = 200
#: Bytes of text that are looked at together; a longer text stands alone.
SLICE = 250_000
_U = np.uint64


def grams(data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """For each byte, the n bytes that end there as one number tagged with n; before a text's start lie line feeds."""
    padded = np.empty(len(data) + ORDER * (len(offsets) - 1), np.uint64)
    at = offsets[:-1] + ORDER * np.arange(1, len(offsets))
    place = np.arange(len(data)) + ORDER * (np.searchsorted(offsets[1:], np.arange(len(data)), side="right") + 1)
    padded[:] = 10
    padded[place] = data
    key = np.zeros(len(padded), _U)
    for k in range(n):
        key[k:] |= padded[: len(padded) - k or None] << _U(8 * k)
    del at
    return key[place] | _U(n << 56)


def gram_counts(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The different grams of n bytes, in order, and how often each occurs: slice by slice, as a byte takes some 70 bytes meanwhile."""
    parts = [np.unique(grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n), return_counts=True) for i, j in words.slices(offsets, SLICE) if offsets[j] > offsets[i]]
    if not parts:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, which, np.concatenate([c for _, c in parts]))
    return keys, counts


def learn(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys and log2 probabilities of the grams seen, keys and log2 escape factors of their contexts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    gram_keys, gram_logs, context_keys, context_logs = [], [], [], []
    mask = lambda n: _U((1 << (8 * n)) - 1)
    lower = (np.zeros(0, _U), np.zeros(0))
    for n in range(1, ORDER + 2):
        keys, counts = gram_counts(data, offsets, n)
        context = ((keys & mask(n)) >> _U(8)) | _U((n - 1) << 56)
        own, first, which = np.unique(context, return_index=True, return_inverse=True)
        total, kinds = np.bincount(which, counts), np.bincount(which)
        p = counts / (total + kinds)[which]
        if n == 1:
            below = np.full(len(keys), 1 / 256)
        else:
            suffix = (keys & mask(n - 1)) | _U((n - 1) << 56)
            below = lower[1][np.searchsorted(lower[0], suffix)]
        rest = np.maximum(1 - np.bincount(which, below), 1e-9)
        escape = np.log2(kinds / (total + kinds) / rest)
        gram_keys.append(keys)
        gram_logs.append(np.log2(p))
        context_keys.append(own)
        context_logs.append(escape)
        lower = (keys, p)  # what the next longer contexts exclude
    return (*map(np.concatenate, (gram_keys, gram_logs, context_keys, context_logs)),)


class Model:
    """The frozen trees of all languages in two tables: each gram's log2 probability by language, and each context's escape."""

    def __init__(self, trees: dict[str, tuple]):
        self.languages = sorted(trees)
        width = len(self.languages)
        context_keys = np.unique(np.concatenate([trees[x][2] for x in self.languages]))
        escapes = np.zeros((len(context_keys), width))
        for k, x in enumerate(self.languages):
            escapes[np.searchsorted(context_keys, trees[x][2]), k] = trees[x][3]
        self.contexts = Table(context_keys, escapes.astype(np.float32))
        keys = np.unique(np.concatenate([trees[x][0] for x in self.languages]))
        logs = np.full((len(keys), width), np.nan)
        for k, x in enumerate(self.languages):
            logs[np.searchsorted(keys, trees[x][0]), k] = trees[x][1]
        size = (keys >> _U(56)).astype(int)
        for n in range(1, ORDER + 2):  # a language that lacks a gram escapes to the shorter one
            here = np.flatnonzero(size == n)
            body = keys[here] & _U((1 << (8 * n)) - 1)
            context = self.contexts.find((body >> _U(8)) | _U((n - 1) << 56))
            less = np.where(context[:, None] >= 0, escapes[context], 0.0)
            if n == 1:
                less = less - 8
            else:
                less = less + logs[np.searchsorted(keys, (body & _U((1 << (8 * n - 8)) - 1)) | _U((n - 1) << 56))]
            logs[here] = np.where(np.isnan(logs[here]), less, logs[here])
        self.grams = Table(keys, logs.astype(np.float32))

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text's code in each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        full = np.flatnonzero(np.diff(offsets))
        if not len(full):
            return out
        keys = grams(data, offsets, ORDER + 1)
        row = self.grams.find(keys)
        logs = self.grams.rows[row]
        open_ = np.flatnonzero(row < 0)
        logs[open_] = 0
        for n in range(ORDER + 1, 0, -1):
            if not len(open_):
                break
            body = keys[open_] & _U((1 << (8 * n)) - 1)
            context = self.contexts.find((body >> _U(8)) | _U((n - 1) << 56))
            logs[open_] += np.where(context[:, None] >= 0, self.contexts.rows[context], np.float32(0))
            if n == 1:
                logs[open_] -= 8
                break
            row = self.grams.find((body & _U((1 << (8 * n - 8)) - 1)) | _U((n - 1) << 56))
            hit = row >= 0
            logs[open_[hit]] += self.grams.rows[row[hit]]
            open_ = open_[~hit]
        out[full] = -np.add.reduceat(logs, offsets[:-1][full], axis=0, dtype=np.float64)
        return out


def fold(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(n))


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """A model from rows with text and lang."""
    labelled = labelled.where("lang is not null and text is not null")
    draw = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = labelled.groupBy("lang").agg((F.lit(float(sample_docs)) / F.approx_count_distinct(F.xxhash64("text"))).alias("share"))
    share = written(share, "languages")
    if share.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    sample = labelled.join(small_or_shuffled(share), "lang").where(draw < F.col("share")).select("lang", "text").distinct().withColumn("draw", draw)

    def tree(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["draw", "text"])
        texts, size = [], 0
        for t in map(str.encode, group["text"]):
            if texts and size + len(t) > sample_bytes:
                break
            texts.append(t)
            size += len(texts[-1])
        parts = learn(texts)
        release()
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], **{f"p{k}": [x.tobytes()] for k, x in enumerate(parts)}})

    rows = sample.where("text <> ''").groupBy("lang").applyInPandas(tree, "lang string, p0 binary, p1 binary, p2 binary, p3 binary").collect()
    trees = {r.lang: tuple(np.frombuffer(r[f"p{k}"], _U if k % 2 == 0 else np.float64) for k in range(4)) for r in rows}
    return Model(trees) if trees else None


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and bits (code length in that language) for every row.  text may be a field of a struct doc_id (`row.text`): it then goes to Python once."""
    field = text.removeprefix(f"{doc_id}.") if text.startswith(f"{doc_id}.") else None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = words.utf8(batch.column("text") if field is None else pc.struct_field(batch.column("doc_id"), field.strip("`")))
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            for i, j in words.slices(offsets, SLICE):
                names, scores, bits = np.full(j - i, "und", object), np.zeros(j - i), np.full(j - i, np.nan)
                if model is not None:
                    lengths = model.code_lengths(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    best, some = lengths.argmin(axis=1), letters[i:j].astype(bool)
                    least = lengths[np.arange(j - i), best]
                    names[some] = np.array(model.languages, object)[best[some]]
                    scores[some] = (1 / np.exp2(np.maximum(least[:, None] - lengths, -1000)).sum(axis=1))[some]
                    bits[some] = least[some]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(scores), pa.array(bits, from_pandas=True)], names=["doc_id", "lang_pred", "score", "bits"]
                )

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(doc_id).alias("doc_id"), *([F.col(text).alias("text")] if field is None else []), lettered.alias("letters"))
    schema = StructType([rows.schema["doc_id"], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("bits", DoubleType())])
    return rows.mapInArrow(tidy(run), schema)


def identify(docs: DataFrame, held_out: int = 5) -> DataFrame:
    """Learn from the labelled rows that are not held out (one fold of held_out) and predict every row."""
    model = fit(docs.where(fold(F.col("doc_id"), held_out) != 0).select("doc_id", "text", "lang"))
    out = predict(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id"), held_out) == 0).alias("held_out"), "lang_pred", "score", "bits")


def label(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All columns of docs with lang_pred, score and bits (which replace columns of these names)."""
    own = [c for c in docs.columns if c not in ("lang_pred", "score", "bits")]
    row = F.struct(*[F.col(f"`{c}`") for c in own])
    out = predict(docs.select(row.alias("row")), model, "row", f"row.`{text}`")
    return out.select(*[F.col(f"doc_id.`{c}`").alias(c) for c in own], "lang_pred", "score", "bits")
