"""Language-model scores from an Elias-Fano n-gram trie that is sharded over the cluster.

The model has order 3.  With counts c over all training rows (no n-gram is left
out, whatever its count and whatever the corpus holds):

    P(w | u x) = (c(u x w) - DISCOUNT) / c(u x) + DISCOUNT n(u x) / c(u x) * P(w | x)
    P(w | x)   = (c(x w) + PRIOR P(w)) / (c(x) + PRIOR)
    P(w)       = (c(w) + 1) / (N + V + 1)

where n(u x) is the number of different words after u x; the first term is 0 for
an unseen u x w, and P(w | u x) is P(w | x) after an unseen u x.  Each sums to 1.

Rows are taken in blocks of about BLOCK_BYTES of text.  A block asks for each of
its distinct words, pairs and triples once, and sends its own training counts of
them along.  A pair lies in the shard of its hash, and so does what follows it:
the task of a shard adds up the blocks' counts, lays them down as a trie
(contexts; monotone pointers; the words after each context as one rising
Elias-Fano sequence, relative to their context; the smoothed shares and back-off
weights as 16-bit fixed-point logarithms) in a memory-mapped file, and answers
each block in the block's own order.  The block then scores its rows.  Texts and
answers meet by block; no task or driver holds the whole model, nothing that
grows with the corpus is broadcast, and a frequent word, pair or triple is one
entry a block.  A context that would have more than HOT of a shard's entries is
split by the word that follows; its own totals are counted apart.  Which contexts
are split comes from a bounded sample of rows (SAMPLE_DOCS) and moves work only.

Shards are ranges of the hash, so what a block sends does not grow with their
number until they outnumber its entries; raise shard_bytes with the executors'
memory.  Words and pairs are told apart by 64-bit hashes, and the words after one
pair by 40 bits; words that the sample finds frequent are sent as 16-bit codes.

Defined results: null text is empty and scores its end alone; without training
rows every probability is 1 (a score of 0); rows with null or repeated ids are
rows like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm import words
from spanloom.llm.elias_fano import EliasFano
from spanloom.llm.shared import tidy, tidy_group, written

DISCOUNT = 0.9
PRIOR = 1000.0
BLOCK_BYTES = 6_000_000
SHARD_BYTES = 5_000_000
HOT = 0.25
SAMPLE_DOCS = 2000
#: Steps of a quantised logarithm in one decade (a share is within 0.5 % of its value); the largest code is none at all.
STEPS, NONE = 256, 65535
#: Words that have a short code between blocks and shards; one more code says that the word's own bits follow.
CODED = 65535
_U = np.uint64
#: Hashes of the end of a text and of what precedes its first word.
END, START = _U(0x452821E638D01377), _U(0xBE5466CF34E90C6C)
#: Bits that tell the words after one context apart.
_TAIL = 40
_TAIL_MASK = _U((1 << _TAIL) - 1)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words and its end, and where each row's begin (n + 1 offsets)."""
    hashes, at = words.word_hashes(data, offsets)
    out = np.full(len(hashes) + len(offsets) - 1, END, _U)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    out[np.arange(len(hashes)) + row] = hashes
    return out, at + np.arange(len(offsets))


def pair_keys(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return words.mix(words.mix(x) + w)


_FIRST = pair_keys(np.array([START]), np.array([START]))


def is_training(doc_id: Column, n: int, left_out: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(n)) != left_out


def codes(p: np.ndarray) -> np.ndarray:
    """Shares as 16-bit logarithms; 0 is NONE."""
    out = np.full(len(p), NONE, np.uint16)
    some = p > 0
    out[some] = np.minimum(np.rint(-np.log10(p[some]) * STEPS), NONE - 1)
    return out


_SHARES = 10.0 ** (np.arange(NONE + 1) / -STEPS)
_SHARES[NONE] = 0


def pack(arrays: list[np.ndarray], plain: list[int]) -> bytes:
    """Arrays as byte planes; the first planes of each, so many as plain says, are noise and are not compressed."""
    noise, rest, head = [], [], []
    for values, k in zip(arrays, plain, strict=True):
        planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T) if len(values) else np.zeros((0, 0), np.uint8)
        head.append(len(values))
        noise.append(planes[:k].tobytes())
        rest.append(planes[k:].tobytes())
    body = b"".join(rest)
    return np.array([*head, len(body)], np.uint32).tobytes() + b"".join(noise) + (pa.compress(body, codec="zstd", asbytes=True) if body else b"")


def unpack(blob: bytes, kinds: list, plain: list[int]) -> list[np.ndarray]:
    *head, size = np.frombuffer(blob, np.uint32, len(kinds) + 1).tolist()
    at, out, done = 4 * len(kinds) + 4, [], 0
    widths = [np.dtype(k).itemsize for k in kinds]
    body_at = at + sum(n * k for n, k in zip(head, plain, strict=True))
    body = np.frombuffer(pa.decompress(blob[body_at:], size, codec="zstd", asbytes=True) if size else b"", np.uint8)
    noise = np.frombuffer(blob, np.uint8)
    for n, kind, width, k in zip(head, kinds, widths, plain, strict=True):
        planes = np.empty((width, n), np.uint8)
        planes[:k] = noise[at : at + n * k].reshape(k, n)
        planes[k:] = body[done : done + n * (width - k)].reshape(width - k, n)
        at, done = at + n * k, done + n * (width - k)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
    return out


#: What a block sends to a shard: words, their counts, pairs, their counts, words after each pair, codes of these words, bits of those without (two parts), counts.
_ASKED = [_U, np.uint32, _U, np.uint32, np.uint32, np.uint16, np.uint32, np.uint8, np.uint32]
_ASKED_PLAIN = [5, 0, 5, 0, 0, 0, 4, 1, 0]
#: What comes back: counts of words, counts and back-off weights of pairs, shares of triples.
_ANSWERED = [np.int64, np.int64, np.uint16, np.uint16]
_ANSWERED_PLAIN = [0, 0, 0, 0]


class Grams:
    """The distinct words, pairs and triples of a block with their training counts, and where each token has its own."""

    def __init__(self, own: np.ndarray, at: np.ndarray, train: np.ndarray, hot: dict[int, int] | None = None):
        self.own, self.at = own, at
        weight = np.repeat(train.astype(np.float64), np.diff(at))
        x = np.empty_like(own)
        x[1:] = own[:-1]
        x[at[:-1]] = START
        pair = pair_keys(x, own)
        context = np.empty_like(own)
        context[1:] = pair[:-1]
        context[at[:-1]] = _FIRST
        tail = own & _TAIL_MASK
        moved = np.zeros(0, np.int64)
        if hot:  # parts of a hot context stand as contexts of their own
            keys = np.array(sorted(hot), _U)
            where = np.minimum(np.searchsorted(keys, context), len(keys) - 1)
            moved = np.flatnonzero(keys[where] == context)
            parts = np.array([hot[int(k)] for k in keys], _U)[where[moved]]
            context[moved] = part_keys(context[moved], tail[moved] % parts)
        self.words, self.word = np.unique(own, return_inverse=True)
        self.n_words = np.bincount(self.word, weight, minlength=len(self.words)).astype(np.uint32)
        self.pairs, which = np.unique(np.concatenate((pair, _FIRST, context[moved])), return_inverse=True)
        self.pair, self.first = which[: len(own)], which[len(own)]
        counts = np.bincount(self.pair, weight, minlength=len(self.pairs))
        counts[self.first] += train.sum()
        self.n_pairs = counts.astype(np.uint32)
        self.context = np.empty_like(self.pair)
        self.context[1:] = self.pair[:-1]
        self.context[at[:-1]] = self.first
        self.context[moved] = which[len(own) + 1 :]
        self.triples, self.triple = np.unique(self.context.astype(_U) << _U(_TAIL) | tail, return_inverse=True)
        self.n_triples = np.bincount(self.triple, weight, minlength=len(self.triples)).astype(np.uint32)
        self.last = np.empty(len(self.triples), np.int64)  # a triple's last word
        self.last[self.triple] = self.word


def part_keys(context: np.ndarray, part: np.ndarray) -> np.ndarray:
    return words.mix(context + (part.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> _U(32)) * _U(shards)) >> _U(32)


def first_key(shard: int, shards: int) -> np.uint64:
    return _U(-(-(shard << 32) // shards) << 32)


def _check(pairs: np.ndarray, found: np.ndarray) -> int:
    return (int(pairs.sum(dtype=_U)) + int(found.sum(dtype=_U))) & ((1 << 62) - 1)


class Codes:
    """Short codes of some words."""

    def __init__(self, coded: np.ndarray):
        """Hashes of distinct words, at most CODED; a word's place is its code."""
        self.tails = np.append(coded & _TAIL_MASK, _U(0))
        self.order = np.argsort(coded)
        self.sorted = coded[self.order]

    def of(self, own: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.full(len(own), CODED, np.uint16)
        at = np.minimum(np.searchsorted(self.sorted, own), len(self.sorted) - 1)
        return np.where(self.sorted[at] == own, self.order[at], CODED).astype(np.uint16)

    def words(self, code: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """The last bits of words by code; tails are those of words without one, in order."""
        plain = code == CODED
        out = self.tails[np.where(plain, 0, code)]
        out[plain] = tails
        return out


def asked(g: Grams, shards: int, coded: Codes) -> Iterator[tuple[int, bytes, int]]:
    """For each shard that a block has to do with: its number, the entries, and a check sum of them."""
    of_words, of_pairs = shard_of(g.words, shards), shard_of(g.pairs, shards)
    after = np.bincount((g.triples >> _U(_TAIL)).astype(np.int64), minlength=len(g.pairs)).astype(np.uint32)
    begin = np.concatenate(([0], np.cumsum(after, dtype=np.int64)))
    code = coded.of(g.words)[g.last]
    plain = code == CODED
    tail = (g.triples & _TAIL_MASK)[plain]
    low, top = tail.astype(np.uint32), (tail >> _U(32)).astype(np.uint8)
    tail_at = np.concatenate(([0], np.cumsum(plain)))
    present = np.union1d(of_words, of_pairs)
    edges = zip(present.tolist(), *(np.searchsorted(of, present, side).tolist() for of in (of_words, of_pairs) for side in ("left", "right")), strict=True)
    for s, a, b, c, d in edges:
        base = first_key(s, shards)
        e, f = begin[c], begin[d]
        p, q = tail_at[e], tail_at[f]
        arrays = [np.diff(g.words[a:b], prepend=base), g.n_words[a:b], np.diff(g.pairs[c:d], prepend=base), g.n_pairs[c:d], after[c:d], code[e:f], low[p:q], top[p:q], g.n_triples[e:f]]
        yield s, pack(arrays, _ASKED_PLAIN), _check(g.pairs[c:d], g.words[a:b])


class Trie:
    """Contexts, pointers and successors with quantised shares and back-off weights, in one mapped file."""

    def __init__(self, contexts: np.ndarray, starts: np.ndarray, successors: np.ndarray, shares: np.ndarray, backoffs: np.ndarray):
        """Contexts ascending; where the successors of each begin (n + 1 places); rank of the context << 40 | word, ascending."""
        self.levels = [EliasFano(contexts), EliasFano(starts), EliasFano(successors)]
        self.shares, self.backoffs = codes(shares), codes(backoffs)
        arrays = [(level, name) for level in self.levels for name in EliasFano.ARRAYS] + [(self, "shares"), (self, "backoffs")]
        with tempfile.TemporaryFile() as f:  # it has no name, and goes with the mapping
            places = []
            for owner, name in arrays:
                f.write(b"\0" * (-f.tell() % 8))
                places.append(f.tell())
                f.write(getattr(owner, name).tobytes() or b"\0")
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        for (owner, name), place in zip(arrays, places, strict=True):
            old = getattr(owner, name)
            setattr(owner, name, np.frombuffer(self.map, old.dtype, len(old), place))

    def lookup(self, contexts: np.ndarray, which: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the back-off weight of each context (weight 1 if it is unknown), and of the share of the word tail after contexts[which]."""
        backoffs, shares = np.zeros(len(contexts), np.uint16), np.full(len(which), NONE, np.uint16)
        nodes, pointers, successors = self.levels
        if not nodes.n:
            return backoffs, shares
        rank = np.minimum(nodes.successor(contexts), nodes.n - 1)
        known = nodes.get(rank) == contexts
        backoffs[known] = self.backoffs[rank[known]]
        begin, end = pointers.get(rank).astype(np.int64), pointers.get(rank + 1).astype(np.int64)
        ask = np.flatnonzero(known[which])
        context = which[ask]
        key = rank[context].astype(_U) << _U(_TAIL) | tail[ask]  # successors are stored relative to their context
        at = successors.successor(key)
        inside = (at >= begin[context]) & (at < end[context])
        ask, key, at = ask[inside], key[inside], at[inside]
        hit = successors.get(at) == key
        shares[ask[hit]] = self.shares[at[hit]]
        return backoffs, shares


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, which = np.unique(np.concatenate(keys), return_inverse=True)
    return own, which, np.bincount(which, np.concatenate(counts), minlength=len(own)).astype(np.int64)


def answers(blobs: list[bytes], shard: int, shards: int, coded: Codes, totals: dict[int, tuple[int, int]]) -> tuple[list[bytes], int, int]:
    """A shard's answers to the blocks' entries, and its training words and distinct ones.  totals: count and kinds of words of split contexts."""
    base = first_key(shard, shards)
    asked = [unpack(b, _ASKED, _ASKED_PLAIN) for b in blobs]
    _, i_words, n_words = _summed([base + np.cumsum(a[0], dtype=_U) for a in asked], [a[1] for a in asked])
    pairs, i_pairs, n_pairs = _summed([base + np.cumsum(a[2], dtype=_U) for a in asked], [a[3] for a in asked])
    after = np.concatenate([a[4] for a in asked])
    tail = np.concatenate([coded.words(a[5], a[7].astype(_U) << _U(32) | a[6]) for a in asked])
    triples, i_triples, n_triples = _summed([np.repeat(i_pairs, after).astype(_U) << _U(_TAIL) | tail], [a[8] for a in asked])
    node = (triples >> _U(_TAIL)).astype(np.int64)
    # The trie of what training rows have.
    learnt = n_triples > 0
    total = np.bincount(node, n_triples, minlength=len(pairs)).astype(np.int64)
    kinds = np.bincount(node[learnt], minlength=len(pairs))
    if totals:
        keys = np.array(sorted(totals), _U)
        where = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
        hot = np.flatnonzero((keys[where] == pairs) & (total > 0))
        total[hot], kinds[hot] = (np.array([totals[int(k)][j] for k in keys], np.int64)[where[hot]] for j in (0, 1))
    some = np.flatnonzero(total)
    rank = np.zeros(len(pairs), np.int64)
    rank[some] = np.arange(len(some))
    own = node[learnt]
    starts = np.searchsorted(own, np.append(some, len(pairs)))
    trie = Trie(pairs[some], starts, rank[own].astype(_U) << _U(_TAIL) | triples[learnt] & _TAIL_MASK, (n_triples[learnt] - DISCOUNT) / total[own], DISCOUNT * kinds[some] / total[some])
    backoffs, shares = trie.lookup(pairs, node, triples & _TAIL_MASK)
    out, at = [], [0, 0, 0]
    for a in asked:
        i, j, k = (slice(p, p + len(a[m])) for p, m in zip(at, (0, 2, 5), strict=True))
        out.append(pack([n_words[i_words[i]], n_pairs[i_pairs[j]], backoffs[i_pairs[j]], shares[i_triples[k]]], _ANSWERED_PLAIN))
        at = [i.stop, j.stop, k.stop]
    return out, int(n_words.sum()), int((n_words > 0).sum())


def token_scores(g: Grams, blobs: list[bytes], n: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 P(w), log10 P(w | u x) and c(w) > 0 of a block's tokens, from the answers of its shards in order; n and v of the corpus."""
    parts = [unpack(b, _ANSWERED, _ANSWERED_PLAIN) for b in blobs]
    n_words, n_pairs, backoffs, shares = (np.concatenate([p[k] for p in parts]) for k in range(4))
    if (len(n_words), len(n_pairs), len(shares)) != (len(g.words), len(g.pairs), len(g.triples)):
        raise RuntimeError("a block's rows changed between two readings: write docs first (stable=False)")
    p_word = (n_words + 1) / (n + v + 1)
    c_x = np.empty(len(g.own))
    c_x[1:] = n_words[g.word[:-1]]
    c_x[g.at[:-1]] = n_pairs[g.first]
    single = p_word[g.word]
    double = (n_pairs[g.pair] + PRIOR * single) / (c_x + PRIOR)
    triple = _SHARES[shares[g.triple]] + _SHARES[backoffs[g.context]] * double
    return np.log10(single), np.log10(triple), (n_words > 0)[g.word]


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows of about so many bytes of text (column 1), numbered over all tasks."""
    block = TaskContext.get().partitionId() << 24
    for batch in batches:
        _, offsets = words.utf8(batch.column(1))
        for i, j in words.slices(offsets, most):
            yield block, batch.slice(i, j - i)
            block += 1


def _grams(batch: pa.RecordBatch, hot: dict[int, int]) -> Grams:
    own, at = tokens(*words.utf8(batch.column(1)))
    return Grams(own, at, batch.column(2).to_numpy(zero_copy_only=False), hot)


def sampled(rows: DataFrame, shards: int, share: float, sample: int, most: int) -> tuple[Codes, dict[int, int]]:
    """From a sample of rows: codes of frequent words, and contexts with more than share of a shard's entries, with the number of their parts."""
    if shards == 1:
        return Codes(np.zeros(0, _U)), {}
    n = rows.count()
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts with more than one word after them, words, and (key 0) the number of triples."""
        for _, batch in _blocks(batches, most):
            g = _grams(batch, {})
            after = np.bincount((g.triples >> _U(_TAIL)).astype(np.int64), minlength=len(g.pairs))
            often = np.flatnonzero(after > 1)
            key, count = np.concatenate((g.pairs[often], g.words, [_U(0)])), np.concatenate((after[often], np.bincount(g.word), [len(g.triples)]))
            kind = np.repeat(np.array([0, 1, 2], np.int32), (len(often), len(g.words), 1))
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key.view(np.int64)), pa.array(count.astype(np.int64))], names=["kind", "key", "n"])

    found = rows.where(draw < sample / max(n, 1)).mapInArrow(tidy(entries), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    found = written(found, "sample")
    total = found.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    coded = found.where("kind = 1 and n > 1").orderBy(F.desc("n"), "key").limit(CODED).select("key").toArrow()  # bounded by CODED
    large = found.where((F.col("kind") == 0) & (F.col("n") * shards > F.lit(share * total))).toArrow()  # bounded by shards / share and by the sample
    hot = {int(np.int64(k).view(_U)): min(shards, int(n * shards / (share * total)) + 1) for k, n in zip(large.column("key").to_pylist(), large.column("n").to_pylist(), strict=True)}
    return Codes(coded.column("key").to_numpy().astype(np.int64).view(_U)), hot


def part_totals(rows: DataFrame, hot: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """Over all training rows, the count of each split context and of the different words after it, by its parts' keys."""
    if not hot:
        return {}
    shared = rows.sparkSession.sparkContext.broadcast(hot)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.array(sorted(shared.value), _U)
        for _, batch in _blocks(batches, most):
            g = _grams(batch, {})
            context = g.pairs[(g.triples >> _U(_TAIL)).astype(np.int64)]
            use = (keys[np.minimum(np.searchsorted(keys, context), len(keys) - 1)] == context) & (g.n_triples > 0)
            yield pa.RecordBatch.from_arrays([pa.array(context[use].view(np.int64)), pa.array((g.triples & _TAIL_MASK)[use].view(np.int64)), pa.array(g.n_triples[use].astype(np.int64))], names=["key", "word", "n"])

    counts = rows.mapInArrow(tidy(counted), "key long, word long, n long").groupBy("key", "word").agg(F.sum("n").alias("n"))
    totals = {int(np.int64(r["key"]).view(_U)): (r["n"], r["kinds"]) for r in counts.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}
    return {int(part_keys(np.array([k], _U), np.array([p], _U))[0]): totals[k] for k in totals for p in range(hot[k])}


def score(
    docs: DataFrame, folds: int = 7, left_out: int = 2, doc_id: str = "doc_id", text: str = "text", stable: bool = False,
    block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, hot_share: float = HOT, sample_docs: int = SAMPLE_DOCS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row.

    The rows are read twice and must come in the same order both times, as they
    do from files: say stable=True for a table that is read as it lies; any
    other is written to the shared folder first.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs = docs if stable else written(docs, "docs")
    rows = docs.withColumn("train", is_training(F.col("doc_id"), folds, left_out))
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    coded, hot = sampled(rows, shards, hot_share, sample_docs, block_bytes)
    shared = spark.sparkContext.broadcast((coded, hot, part_totals(rows, hot, block_bytes)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in _blocks(batches, block_bytes):
            shard, blob, check = zip(*asked(_grams(batch, shared.value[1]), shards, shared.value[0]), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array([block] * len(shard), pa.int64()), pa.array(blob, pa.binary()), pa.array(check, pa.int64())], names=["shard", "block", "blob", "check"])

    def looked_up(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        out, n, v = answers(table.column("blob").to_pylist(), shard, shards, shared.value[0], shared.value[2])
        nothing = pa.nulls(len(out), pa.int64())
        mine = [table.column("block"), table.column("shard"), table.column("check"), pa.array(out, pa.binary()), nothing, nothing]
        sums = [pa.array([x], t) for x, t in ((None, pa.int64()), (shard, pa.int64()), (None, pa.int64()), (None, pa.binary()), (n, pa.int64()), (v, pa.int64()))]
        names = ["block", "shard", "check", "blob", "n", "v"]
        return pa.concat_tables([pa.table(mine, names=names), pa.table(sums, names=names)])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(shards // 2 + 1, 50_000))
    questions = rows.mapInArrow(tidy(dealt), "shard long, block long, blob binary, check long").repartition(parts, "shard")
    found = written(questions.groupBy("shard").applyInArrow(tidy_group(looked_up), "block long, shard long, check long, blob binary, n long, v long"), "answers")
    n, v = (x or 0 for x in found.agg(F.sum("n"), F.sum("v")).first())

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's rows as one compressed record."""
        for block, batch in _blocks(batches, block_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([-1], pa.int64()), pa.array([0], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "shard", "check", "blob"])

    def finished(table: pa.Table) -> pa.Table:
        """One block: its rows with their scores."""
        table = table.sort_by("shard")
        head, *blobs = table.column("blob").to_pylist()
        batch = pa.ipc.open_stream(head).read_next_batch()
        g = _grams(batch, shared.value[1])
        if sum(table.column("check").to_pylist()) & ((1 << 62) - 1) != _check(g.pairs, g.words):
            raise RuntimeError("a block's rows changed between two readings: write docs first (stable=False)")
        base, model, known = (np.add.reduceat(x.astype(float), g.at[:-1]) for x in token_scores(g, blobs, n, v))
        return pa.table(
            [batch.column(0), pa.array(~batch.column(2).to_numpy(zero_copy_only=False)), pa.array(np.diff(g.at)), pa.array(known.astype(np.int64)), pa.array(np.full(len(base), n, np.int64)), pa.array(base), pa.array(model)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    blocks = rows.mapInArrow(tidy(heads), "block long, shard long, check long, blob binary").unionByName(found.where("block is not null").select("block", "shard", "check", "blob"))
    return blocks.groupBy("block").applyInArrow(
        tidy_group(finished), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
