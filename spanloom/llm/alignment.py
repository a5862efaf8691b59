"""Cross-tokenizer alignment: which tokens of A and B cover the same bytes.

Over the bytes of a text (a space before it) runs a string of labels, one a
byte: no token ends here, one of A's, one of B's, or both.  A regular
expression scans it for spans up to each both-label; such a span is a group,
and its counts of labels are the numbers of A's and B's tokens in it.  Every
A token of a group is linked with every B token.

A block of documents is labelled at once, each different stretch once: a text
is cut before each space that follows another character, where tokens of both
vocabularies end always (no A match goes from a non-space into a space, and no
piece of B has a space behind another character, which is checked when B is
read; else texts stay whole).  So documents are rows of stretch numbers.

How many documents hold an id pair is counted in three steps: each block writes
its documents' pairs as numbers in the block's own list of pairs; the lists are
summed by pair, with what is highest for each A id (at most as many pairs as B
has ids); and each block gets the counts of its list back.  A frequent pair is
one row a block, and nothing that grows with the corpus is broadcast.

Defined results: null or empty texts, and texts whose tokens' bytes are not the
text's (such as a literal U+2581, which B reads as a space), have no tokens:
zeros, and empty groups; a row is a document, so repeated rows count as often
as they stand; a text of any length is read whole; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm import words
from spanloom.llm.shared import release, tidy, written

#: Bytes of text in a block (a longer text is a block alone).
BLOCK_BYTES = 8_000_000
#: Groups with more links than this are linked by their different ids and how often each occurs.
PLAIN_LINKS = 4096
#: Longest stretch for the fast encoder, whose pattern fails on very long white space.
FAST_CHARS = 10_000
#: A stretch: a space and all up to the next space behind another character; white space at the end belongs to the last one.
STRETCH = re.compile(r" \s*(?:\S+(?:[^\S ]\s*\S*)*(?: \s*\Z)?)?")
#: No end, A's, B's, both.
LABELS = np.frombuffer(b".abx", np.uint8)
SPAN = re.compile(rb"[.ab]*x")
_pairs: dict[tuple[str, str], Tokenizers] = {}


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_level() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable ones stand for themselves, the rest for 256 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """A (a byte-level BPE file) and B (a sentencepiece model), and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of = byte_level()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.a_length, self.b_length = np.array([*map(len, self.a_bytes)]), np.array([*map(len, self.b_bytes)])
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.fast = self._fast(a_path)
        # Ids as text with what follows them: in a group "," between ids, "|" after A's last, ";" after B's last.
        self.words = [f"{k}{end}" for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for end in ends for k in range(n)]

    def _fast(self, a_path: str):
        """An encoder of the same vocabulary as ranks, for ASCII (there both split alike); None where there is none beside the file."""
        ranks_path = a_path.removesuffix(".json") + ".tiktoken"
        if not os.path.exists(ranks_path):
            return None
        import public_tokenizers
        import tiktoken

        from spanloom.llm.byte_bpe import read_ranks

        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(ranks_path), special_tokens={})

    def encode_a(self, stretches: list[str]) -> list[list[int]]:
        slow = [k for k, s in enumerate(stretches) if self.fast is None or len(s) > FAST_CHARS or not s.isascii()]
        if len(slow) == len(stretches):
            return [e.ids for e in self.a.encode_batch(stretches, add_special_tokens=False)]
        rest = dict(zip(slow, (e.ids for e in self.a.encode_batch([stretches[k] for k in slow], add_special_tokens=False)), strict=True))
        encode = self.fast.encode_ordinary
        return [rest[k] if k in rest else encode(s) for k, s in enumerate(stretches)]

    def encode_b(self, stretches: list[str]) -> list[list[int]]:
        return self.b.encode([s[1:] for s in stretches], num_threads=1)  # B puts the space there itself


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """One for each Python worker."""
    if (a_path, b_path) not in _pairs:
        _pairs[a_path, b_path] = Tokenizers(a_path, b_path)
    return _pairs[a_path, b_path]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for y in lists for x in y), np.int64, int(sizes.sum())), sizes


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


class Groups:
    """The groups of a list of stretches, one after another."""

    def __init__(self, t: Tokenizers, stretches: list[str]):
        data = [s.encode() for s in stretches]
        a, b = t.encode_a(stretches), t.encode_b(stretches)
        self.whole = np.ones(len(data), bool)  # whether the tokens' bytes are the stretch
        if b"".join([t.a_bytes[k] for x in a for k in x]) != b"".join(data) or b"".join([t.b_bytes[k] for x in b for k in x]) != b"".join(data):
            self.whole[:] = [b"".join([t.a_bytes[k] for k in x]) == d == b"".join([t.b_bytes[k] for k in y]) for d, x, y in zip(data, a, b, strict=True)]
            for k in np.flatnonzero(~self.whole):
                a[k], b[k], data[k] = [], [], b""
        (self.a, self.n_a), (self.b, self.n_b) = _flat(a), _flat(b)
        marks = np.zeros(sum(map(len, data)), np.uint8)
        marks[np.cumsum(t.a_length[self.a]) - 1] += 1
        marks[np.cumsum(t.b_length[self.b]) - 1] += 2
        labels = LABELS[marks].tobytes()
        spans = np.fromiter(map(len, SPAN.findall(labels)), np.int64)
        begin = _starts(spans)[:-1]
        both = marks == 3
        self.group_a = np.add.reduceat((marks & 1).astype(np.int64), begin) if len(spans) else np.zeros(0, np.int64)
        self.group_b = np.add.reduceat((marks >> 1).astype(np.int64), begin) if len(spans) else np.zeros(0, np.int64)
        closed = np.concatenate(([0], np.cumsum(both)))
        edges = _starts(np.fromiter(map(len, data), np.int64, len(data)))
        self.first = closed[edges]  # of each stretch's groups, and the end
        self.n_groups = np.diff(self.first)
        links = np.concatenate(([0], np.cumsum(self.group_a * self.group_b)))
        self.n_links = links[self.first[1:]] - links[self.first[:-1]]
        self.texts = self._texts(t)

    def _texts(self, t: Tokenizers) -> list[str]:
        """Each stretch's groups as text, "a1,a2|b1;a3|b2;" and so on."""
        first_a, first_b = _starts(self.group_a), _starts(self.group_b)
        of_a, of_b = np.repeat(np.arange(len(self.group_a)), self.group_a), np.repeat(np.arange(len(self.group_b)), self.group_b)
        code = np.empty(len(self.a) + len(self.b), np.int64)
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[first_a[1:] - 1] = last_b[first_b[1:] - 1] = 1
        n_a, n_b = len(t.a_bytes), len(t.b_bytes)
        code[np.arange(len(self.a)) + first_b[of_a]] = self.a + n_a * last_a
        code[np.arange(len(self.b)) + first_a[of_b + 1]] = 2 * n_a + self.b + n_b * last_b
        parts = [t.words[k] for k in code.tolist()]
        edges = (_starts(self.n_a) + _starts(self.n_b)).tolist()
        return ["".join(parts[i:j]) for i, j in zip(edges, edges[1:])]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linked id pairs (A id above bit 32) in order of stretches, how often each is linked there, and how many rows each stretch has."""
        links = self.group_a * self.group_b
        first_a, first_b = _starts(self.group_a), _starts(self.group_b)
        plain = np.flatnonzero(links <= PLAIN_LINKS)
        n = links[plain]
        group, at = np.repeat(plain, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        keys = [self.a[first_a[group] + at // self.group_b[group]] << 32 | self.b[first_b[group] + at % self.group_b[group]]]
        counts, groups = [np.ones(len(group), np.int64)], [group]
        for g in np.flatnonzero(links > PLAIN_LINKS):
            a, in_a = np.unique(self.a[first_a[g] : first_a[g + 1]], return_counts=True)
            b, in_b = np.unique(self.b[first_b[g] : first_b[g + 1]], return_counts=True)
            keys.append((a[:, None] << 32 | b[None, :]).ravel())
            counts.append((in_a[:, None] * in_b[None, :]).ravel())
            groups.append(np.full(len(keys[-1]), g))
        keys, counts, groups = map(np.concatenate, (keys, counts, groups))
        stretch = np.searchsorted(self.first, groups, side="right") - 1
        order = np.argsort(stretch, kind="stable")
        return keys[order], counts[order], np.bincount(stretch, minlength=len(self.n_groups))


def _block(t: Tokenizers, texts: list[str | None], digest: bool) -> tuple[dict, dict]:
    """Columns of a block's documents, and the block's list of pairs with how many of its documents have each."""
    number: dict[str, int] = defaultdict()
    number.default_factory = number.__len__
    cut = STRETCH.findall if t.cuts else lambda text: [text]
    rows = [np.array([*map(number.__getitem__, cut(" " + x))], np.int64) if x else np.zeros(0, np.int64) for x in texts]
    g = Groups(t, [*number])
    of = np.repeat(np.arange(len(rows)), [*map(len, rows)])
    stretch = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    broken = np.zeros(len(rows), bool)
    broken[of[~g.whole[stretch]]] = True
    of, stretch = of[~broken[of]], stretch[~broken[of]]
    out = {name: np.bincount(of, getattr(g, name)[stretch], len(rows)).astype(np.int64) for name in ("n_a", "n_b", "n_groups")}
    out["n_links"] = np.zeros(len(rows), np.int64)
    np.add.at(out["n_links"], of, g.n_links[stretch])
    groups = ["" if bad or not len(r) else "".join([g.texts[k] for k in r.tolist()])[:-1] for r, bad in zip(rows, broken, strict=True)]
    out["groups"] = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in groups] if digest else groups
    # Documents by stretches, stretches by pairs: documents by pairs.
    both, times = np.unique(of * len(g.n_groups) + stretch, return_counts=True) if len(of) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    of, stretch = both // max(1, len(g.n_groups)), both % max(1, len(g.n_groups))
    keys, counts, sizes = g.pairs()
    listed, which = np.unique(keys, return_inverse=True)
    n = sizes[stretch]
    at = np.repeat(_starts(sizes)[stretch], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    cells, where = np.unique(np.repeat(of, n) * max(1, len(listed)) + which[at], return_inverse=True)
    links = np.zeros(len(cells), np.int64)
    np.add.at(links, where, counts[at] * np.repeat(times, n))
    of, pair = cells // max(1, len(listed)), cells % max(1, len(listed))
    edges = np.searchsorted(of, np.arange(len(rows) + 1)).tolist()
    narrow = lambda x: (x.astype(np.uint8) if x.max(initial=0) < 256 else x).tobytes()
    out["pairs"] = [pair[i:j].astype(np.int32).tobytes() for i, j in zip(edges, edges[1:])]
    out["links"] = [narrow(links[i:j]) for i, j in zip(edges, edges[1:])]
    documents = np.bincount(pair, minlength=len(listed))
    used = np.flatnonzero(documents)  # all, but for pairs of documents whose other stretches are broken
    return out, {"k": used, "pair": listed[used], "documents": documents[used]}


def blocks(docs: DataFrame, a_path: str, b_path: str, digest: bool, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents (doc_id, counts, groups, and their pairs as numbers in the block's list) and, in rows of their own, each block's list."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType
    own = ["n_a", "n_b", "n_groups", "n_links"]
    schema = (
        f"block long, listed boolean, doc_id {kind.simpleString()}, {', '.join(f'{c} long' for c in own)}, groups string, pairs binary, links binary, list array<struct<k:int,pair:long,documents:long>>"
    )
    entry = pa.list_(pa.struct([("k", pa.int32()), ("pair", pa.int64()), ("documents", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, task, count = tokenizers(a_path, b_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            _, offsets = words.utf8(batch.column(1))
            for i, j in words.slices(offsets, block_bytes):
                block = (task << 32) + count
                count += 1
                out, pairs = _block(t, batch.column(1).slice(i, j - i).to_pylist(), digest)
                ids, n = batch.column(0).slice(i, j - i), j - i
                columns = [pa.array(np.full(n, block)), pa.array(np.zeros(n, bool)), ids, *(pa.array(out[c]) for c in own)]
                columns += [pa.array(out["groups"], pa.string()), pa.array(out["pairs"], pa.binary()), pa.array(out["links"], pa.binary()), pa.nulls(n, entry)]
                names = ["block", "listed", "doc_id", *own, "groups", "pairs", "links", "list"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                values = pa.StructArray.from_arrays([pa.array(pairs["k"].astype(np.int32)), pa.array(pairs["pair"]), pa.array(pairs["documents"])], ["k", "pair", "documents"])
                list_ = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                nothing = [pa.nulls(1, c.type) for c in columns[2:-1]]
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([True]), *nothing, list_], names=names)
                release()

    return rows.mapInArrow(tidy(run), schema)


def pair_counts(block_rows: DataFrame) -> DataFrame:
    """pair (A id above bit 32), a_id, b_id, n (documents that hold it linked) and best (no pair of that A id is in more)."""
    listed = block_rows.where("listed").select(F.inline("list"))
    counts = listed.groupBy("pair").agg(F.sum("documents").alias("n")).withColumn("a_id", F.shiftright("pair", 32).cast("int"))
    # An A id has as many pairs as B has ids at most.
    best = F.col("n") == F.max("n").over(W.partitionBy("a_id"))
    return counts.select("pair", "a_id", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b_id"), "n", best.alias("best"))


def align(
    docs: DataFrame, paths: tuple[str, str] | None = None, digest: bool = False, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups ("a1,a2|b1;a3|b2,b3"; with digest its SHA-256)."""
    rows = written(blocks(docs, *(paths or vocabulary_paths()), digest, doc_id, text, block_bytes), "aligned")
    asked = rows.where("listed").select("block", F.inline("list")).select("block", "k", "pair")
    answers = asked.join(pair_counts(rows).select("pair", "n", "best").hint("shuffle_merge"), "pair").select(F.col("block").alias("asker"), "k", "n", "best")
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]

    def weighed(documents: pa.Table, counts: pa.Table) -> pa.Table:
        k = counts["k"].to_numpy()
        n, best = np.zeros(int(k.max(initial=-1)) + 1, np.int64), np.zeros(int(k.max(initial=-1)) + 1, np.int64)
        n[k], best[k] = counts["n"].to_numpy(), counts["best"].to_numpy().astype(np.int64)
        sums = []
        for pairs, links in zip(documents["pairs"], documents["links"], strict=True):
            at = np.frombuffer(pairs.as_buffer(), np.int32)
            times = np.frombuffer(links.as_buffer(), np.uint8 if len(links.as_buffer()) == len(at) else np.int64).astype(np.int64)
            sums.append((int(times @ best[at]), int(times @ n[at])))
        out = documents.select([*own, "groups"])
        out = out.append_column("n_best", pa.array([s[0] for s in sums], pa.int64())).append_column("count_sum", pa.array([s[1] for s in sums], pa.int64()))
        release()
        return out.select([*own, "n_best", "count_sum", "groups"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    documents = rows.where("not listed").select("block", *own, "groups", "pairs", "links")
    return documents.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(weighed, schema)
