"""Byte-level BPE encoding and decoding by monoid tree reduction.

Encoded stretches of text form a monoid: the empty stretch is its unit, and two
neighbours are joined by looking at their common boundary alone.  Two levels:

- Text.  A text is cut in halves down to leaves, whose pieces (matches of the
  split pattern) are found alone.  A join drops the pieces of the left half that
  could have read past its end, matches again from there, and stops at the first
  match that ends where one of the right half ends: what a match takes depends
  only on the text behind its start, so all later pieces stay.
- Piece.  The bytes of a piece are cut in halves (the left one a power of two
  long) down to leaves of a few bytes.  A join re-encodes a window of tokens around the
  boundary and widens it until the token pair at each of its edges is stable,
  that is, encoding the pair's bytes gives the pair.

That is enough: merges are made in order of rank, so the first merge that
crosses a token's edge in the whole would also be made, at the same point, when
the two tokens at that edge are encoded alone.  Where no neighbouring pair has
such a merge, the tokens are the encoding of all their bytes.

Decoding is the homomorphism back: halves of the ids, their bytes concatenated.

Defined results: null text is empty and has no ids; a text of any length is
encoded whole, in time n log n; the strings of special tokens are plain text;
null or repeated doc_ids are rows like others; an empty table gives no rows;
other columns, whatever their names, are ignored; ids below 0 or above the
vocabulary are an error in decoding, null ids decode to null.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import tidy

#: Characters of a leaf of the text tree, ids of a leaf in decoding.
LEAF_CHARS, LEAF_IDS = 8192, 4096
#: Texts are handed on in batches of about so many characters.
BATCH_CHARS = 2_000_000
#: Bytes of a leaf of the piece tree.
LEAF_BYTES = 8
#: Remembered pieces and pairs; a table that is full starts anew.
MOST_PIECES, MOST_PAIRS = 400_000, 600_000
_encoders: dict[tuple[str, str], Encoder] = {}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _ranges(characters: set[str]) -> str:
    """Characters as ranges of a set in a pattern."""
    codes = sorted(map(ord, characters))
    firsts = [c for k, c in enumerate(codes) if not k or codes[k - 1] != c - 1]
    lasts = [c for k, c in enumerate(codes) if k == len(codes) - 1 or codes[k + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts, lasts, strict=True))


def split_patterns(pattern: str) -> tuple[regex.Pattern, set[str], regex.Pattern]:
    """The split pattern; the characters that this engine's Unicode tables put into another class than the library's; and the pattern for texts that have such characters.

    The library is asked once for all characters of each class.
    """
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([k]): k for k in range(256)}
    exact, odd = pattern, set()
    for name in (r"\p{L}", r"\p{N}"):
        own = set(regex.findall(name, every))
        e = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        theirs = set(bytes(e.encode_ordinary(every)).decode())
        odd |= own ^ theirs
        # Sets within sets, as the class also stands inside a negated one.
        more, less = _ranges(theirs - own), _ranges(own - theirs)
        exact = exact.replace(name, f"[[{name}{more}]--[{less}]]" if less else f"[{name}{more}]")
    return regex.compile(pattern), odd, regex.compile(exact, regex.V1)


class Encoder:
    """The ids of texts under a table of ranks and a split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, k in ranks.items():
            self.bytes_of[k] = token
        # Leaves and windows are merged by the library, which takes a window that is a token for that token: right if merges lead to every token.
        import tiktoken

        library = tiktoken.Encoding("windows", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.window = library if all(self.merged(t) == [k] for t, k in ranks.items()) else self.merged
        self.pattern, self.odd, self.exact = split_patterns(pattern)
        self.far = re.compile(f"[{min(self.odd, default=chr(0x10FFFF))}-\U0010ffff]")
        self.space = regex.compile(r"\s*")
        self.known: dict[str, bytes] = {}  # piece -> its ids, four bytes each
        self.pairs: dict[int, bool] = {}

    # Bytes of one piece

    def merged(self, data: bytes) -> list[int]:
        """Tokens of bytes without a tree: the neighbours of the lowest rank become one, the leftmost first, until none has a rank."""
        ranks, n = self.ranks, len(data)
        part, after, before = [data[k : k + 1] for k in range(n)], [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, k, 2) for k in range(n - 1) if (r := ranks.get(data[k : k + 2])) is not None]
        heapq.heapify(heap)

        def offer(k: int) -> None:
            if k >= 0 and after[k] < n and (r := ranks.get(both := part[k] + part[after[k]])) is not None:
                heapq.heappush(heap, (r, k, len(both)))

        while heap:
            _, k, size = heapq.heappop(heap)
            nxt = after[k]
            if not part[k] or nxt >= n or len(part[k]) + len(part[nxt]) != size:  # one of them has grown or gone meanwhile
                continue
            part[k] += part[nxt]
            part[nxt] = b""
            after[k] = after[nxt]
            if after[k] < n:
                before[after[k]] = k
            offer(k)
            offer(before[k])
        return [ranks[p] for p in part if p]

    def stable(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens stay as they are: no merge crosses the edge between them."""
        out = self.pairs.get(a << 32 | b)
        if out is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            out = self.pairs[a << 32 | b] = self.window(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return out

    def joined(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two neighbours' bytes from their encodings."""
        if self.stable(left[-1], right[0]):
            return left + right
        i, j = len(left) - 1, 1
        while True:
            window = tuple(self.window(b"".join([self.bytes_of[t] for t in left[i:] + right[:j]])))
            open_left = i > 0 and not self.stable(left[i - 1], window[0])
            open_right = j < len(right) and not self.stable(window[-1], right[j])
            if not open_left and not open_right:
                return left[:i] + window + right[j:]
            # Doubled, so that all windows of a join are at most twice as long as the last one.
            i = max(0, 2 * i - len(left)) if open_left else i
            j = min(len(right), 2 * j) if open_right else j

    def tokens(self, data: bytes) -> tuple[int, ...]:
        """The encoding of bytes: halves, joined."""
        n = len(data)
        if n <= LEAF_BYTES:
            return tuple(self.window(data))
        half = 1 << (n - 1).bit_length() - 1
        return self.joined(self.tokens(data[:half]), self.tokens(data[half:]))

    def piece(self, piece: str) -> bytes:
        """Ids of one piece, four bytes each; a piece that is a token as a whole is that token."""
        data = piece.encode()
        rank = self.ranks.get(data)
        ids = self.tokens(data) if rank is None else (rank,)
        out = array("I", ids).tobytes()
        if len(data) <= 64:
            if len(self.known) >= MOST_PIECES:
                self.known.clear()
            self.known[piece] = out
        return out

    # Texts

    def pieces(self, text: str) -> list[str]:
        """The matches of the split pattern, from the matches in halves."""
        odd = not text.isascii() and self.far.search(text) and not self.odd.isdisjoint(text)
        pattern = self.exact if odd else self.pattern
        return self._pieces(pattern, text, 0, len(text))

    def _pieces(self, pattern: regex.Pattern, text: str, a: int, b: int) -> list[str]:
        if b - a <= LEAF_CHARS:
            return pattern.findall(text, a, b)
        middle = (a + b) // 2
        return self._pieces_joined(pattern, text, a, self._pieces(pattern, text, a, middle), middle, self._pieces(pattern, text, middle, b), b)

    def _pieces_joined(self, pattern: regex.Pattern, text: str, a: int, left: list[str], middle: int, right: list[str], b: int) -> list[str]:
        at = middle
        while left:
            at -= len(left.pop())
            # A match reads at most two characters behind its end, or to the end of its white space.
            if at + 2 <= middle and (at == a or self.space.match(text, at - 1, middle).end() < middle):
                break
        right_end, used = middle, 0
        while True:
            found = pattern.match(text, at, b)
            left.append(found[0])
            at = found.end()
            while right_end < at:
                right_end += len(right[used])
                used += 1
            if at >= middle and right_end == at:
                left += right[used:]
                return left

    def encode(self, text: str) -> bytes:
        """Ids of a text, four bytes each, little-endian."""
        known, piece = self.known.get, self.piece
        return b"".join([known(p) or piece(p) for p in self.pieces(text)])

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids, concatenated up the tree."""
        if len(ids) <= LEAF_IDS:
            return b"".join([self.bytes_of[k] for k in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def encoder(path: str | None = None, pattern: str | None = None) -> Encoder:
    """The encoder of a rank file, one for each Python worker."""
    import public_tokenizers

    key = (path or vocabulary_path(), pattern or public_tokenizers.PATTERN)
    if key not in _encoders:
        _encoders[key] = Encoder(read_ranks(key[0]), key[1])
    return _encoders[key]


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(sizes):
        to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right")))
        yield at, to
        at = to


def _lists(parts: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(p) // 4 for p in parts)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, decoded: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every text; with decoded also the bytes that the ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            sizes = batch.column(2).to_numpy(zero_copy_only=False)
            for i, j in _slices(sizes, BATCH_CHARS):
                parts = [e.encode(t) if t else b"" for t in batch.column(1).slice(i, j - i).to_pylist()]
                columns = [batch.column(0).slice(i, j - i), _lists(parts)]
                if decoded:
                    columns.append(pa.array([e.decode(np.frombuffer(p, "<u4").tolist()) for p in parts], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.length(text), F.lit(0)).alias("size"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, ids array<int>" + ", decoded binary" * decoded)


def decode(tokens: DataFrame, path: str | None = None, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and decoded (binary: the tokens' bytes, which need not be whole characters) of every row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                rows = []
                for row in part.column(1).to_pylist():
                    if row is not None and any(x < 0 for x in row):
                        raise ValueError("ids below 0 have no bytes")
                    rows.append(None if row is None else e.decode(row))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], names=["doc_id", "decoded"])

    rows = tokens.select(F.col(doc_id).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, decoded binary")
