"""Byte-level BPE with a rank queue made of a hierarchical bitmap.

Each candidate pair of neighbouring symbols stands in the bucket of its merge rank, by the start of its
left symbol in a linked list over the piece. A bitmap with one bit for each rank, and above it a word with
one bit for each non-empty leaf below, tells the next rank by two find-first-set steps, however long the
piece is. Entries are never removed when a merge changes their pair; they
are skipped when they come up and their pair no longer has the bucket's rank.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm.common import map_texts

#: Ranks for each word of the lower bitmap, as a power of two; the upper bitmap is one word.
LEAF_SHIFT = 8
LEAF_MASK = (1 << LEAF_SHIFT) - 1
#: Pieces up to so many characters are remembered, at most twice so many of them in a worker.
CACHED_LENGTH, CACHED_PIECES = 48, 300_000


class RankQueue:
    """The parts of a queue of places by rank: a bucket (a heap of places) for each rank that has any, and a
    bit for each bucket in the leaf of its rank. The word above the leaves, one bit for each, is kept by
    BytePairs.merge, which works on all three itself, as calls would take longer than the work on short pieces.
    """

    __slots__ = ("buckets", "leaves")

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.leaves = [0] * ((max(ranks, 1) >> LEAF_SHIFT) + 1)


def _latin_pattern(pattern: str):
    """The same pattern for texts of Latin-1, with its classes written out: re runs it twice as fast as
    regex. None if it has classes other than letters, numbers and white space."""
    def members(test) -> str:
        return "".join(f"\\x{c:02x}" for c in range(256) if test(chr(c)))

    letters, numbers = (members(lambda c, k=k: unicodedata.category(c)[0] == k) for k in "LN")
    space = members(lambda c: c in "\t\n\x0b\x0c\r \x85\xa0")
    inside = re.sub(r"\[\^[^\]]*\]", lambda m: m[0].replace(r"\p{L}", letters).replace(r"\p{N}", numbers).replace(r"\s", space), pattern)
    for name, chars in ((r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\s", f"[{space}]"), (r"\S", f"[^{space}]")):
        inside = inside.replace(name, chars)
    return None if re.search(r"\\[^x]", inside) else re.compile(inside).findall


class BytePairs:
    """Encoder and decoder for a rank file (lines of base64 token and rank)."""

    def __init__(self, vocab_path: str, pattern: str):
        with open(vocab_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.any_pieces, self.latin_pieces = regex.compile(pattern).findall, _latin_pattern(pattern)
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.cache = _Pieces(self)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece: always the pair of least rank merges first, the leftmost among equals."""
        rank_of = self.ranks.get
        if (whole := rank_of(piece)) is not None:
            return [whole]
        n = len(piece)
        buckets, leaves, top = self.queue.buckets, self.queue.leaves, 0  # all empty between calls
        after, before, pair = list(range(1, n + 2)), list(range(-1, n)), [-1] * n
        for p in range(n - 1):
            if (r := rank_of(piece[p : p + 2])) is not None:
                pair[p] = r
                if r in buckets:
                    buckets[r].append(p)  # in order of place, which is a heap
                else:
                    buckets[r] = [p]
                    leaf = r >> LEAF_SHIFT
                    leaves[leaf] |= 1 << (r & LEAF_MASK)
                    top |= 1 << leaf
        while top:
            leaf = (top & -top).bit_length() - 1
            word = leaves[leaf]
            rank = leaf << LEAF_SHIFT | (word & -word).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                p = heappop(bucket)
            else:
                p = bucket[0]
                del buckets[rank]
                leaves[leaf] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if pair[p] != rank:
                continue
            q = after[p]
            after[p] = end = after[q]
            pair[q] = pair[p] = -1
            before[end] = p
            o = before[p]
            if o >= 0:
                pair[o] = -1
            for at, stop in ((p, after[end] if end < n else 0), (o, end if o >= 0 else 0)):
                if stop and (r := rank_of(piece[at:stop])) is not None:
                    pair[at] = r
                    if r in buckets:
                        heappush(buckets[r], at)
                    else:
                        buckets[r] = [at]
                        leaf = r >> LEAF_SHIFT
                        leaves[leaf] |= 1 << (r & LEAF_MASK)
                        top |= 1 << leaf
        ids, p = [], 0
        while p < n:
            ids.append(self.ranks[piece[p : after[p]]])
            p = after[p]
        return ids

    def pieces(self, text: str) -> list[str]:
        if self.latin_pieces is not None:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.any_pieces(text)
            return self.latin_pieces(text)
        return self.any_pieces(text)

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.cache.__getitem__, self.pieces(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        """The bytes of a list or array of ids."""
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_packed(self, packed: bytes) -> bytes:
        return self.decode(np.frombuffer(packed, "<u4").tolist())


class _Pieces(dict):
    """Packed ids by piece, in two generations: when one is full, it becomes the old one, and what is asked for again moves back."""

    def __init__(self, coder: BytePairs):
        self.coder, self.old = coder, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            packed = np.array(self.coder.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = packed
        return packed


_coders: dict[tuple[str, str], BytePairs] = {}


def coder(vocab_path: str, pattern: str) -> BytePairs:
    """One coder for each worker process and vocabulary."""
    key = (vocab_path, pattern)
    if key not in _coders:
        _coders[key] = BytePairs(vocab_path, pattern)
    return _coders[key]


def encode_decode(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each whole text and decodes the ids again.

    Returns one row per input row: the id column, of any type, ids_le32 (binary: the ids as little-endian unsigned
    32-bit integers) and decoded (binary: the bytes that these ids stand for). A null text counts as
    empty and gives empty results; a null id is passed on; repeated rows give repeated results; other
    columns of docs are not read. An empty table gives an empty table. vocab_path must exist on each executor.
    """

    def run(ids: list, texts: list) -> tuple[list[bytes], list[bytes]]:
        c = coder(vocab_path, pattern)
        packed = [c.encode_packed(t) if t else b"" for t in texts]
        return packed, [c.decode_packed(p) for p in packed]

    return map_texts(docs, id_col, text_col, run, [("ids_le32", pa.binary()), ("decoded", pa.binary())])


def encode(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and ids (array of int) of each text; nulls and repeats as in encode_decode."""

    def run(ids: list, texts: list) -> tuple[list]:
        c = coder(vocab_path, pattern)
        return ([np.frombuffer(c.encode_packed(t or ""), "<u4").astype("i4") for t in texts],)

    return map_texts(docs, id_col, text_col, run, [("ids", pa.list_(pa.int32()))])


def decode(encoded: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id column and decoded (binary) of each list of ids; a null list gives empty bytes, an unknown id raises."""

    def run(ids: list, lists: list) -> tuple[list[bytes]]:
        c = coder(vocab_path, pattern)
        return ([c.decode(x or ()) for x in lists],)

    return map_texts(encoded, id_col, ids_col, run, [("decoded", pa.binary())])


def digests(docs: DataFrame, vocab_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, derived from what encode_decode returns."""
    return encode_decode(docs, vocab_path, pattern).select(
        "doc_id",
        F.expr("cast(octet_length(ids_le32) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids_le32", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
