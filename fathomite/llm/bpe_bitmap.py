"""Byte-level BPE with a hierarchical-bitmap rank queue.

The bytes of a pre-token form a linked list. Every adjacent pair that the vocabulary can merge is filed under its merge
rank: a bucket per rank holds the list positions, and a bitmap over ranks, with summary bitmaps above it, marks the
buckets in use. Find-first-set from the top bitmap down gives the lowest rank; of its positions the leftmost merges.
Entries whose pair has changed meanwhile are stale and skipped when they come up. A pre-token of n bytes makes at most
3 n entries, each found in a fixed number of word operations, so very long pre-tokens take time close to n.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_rows

#: Pre-tokens remembered by a worker, and the characters that one may have for it; all are forgotten when it is full.
#: Together they bound memory in bytes, and change no result.
REMEMBERED, REMEMBERED_CHARS = 600_000, 64


class RankQueue:
    """Positions by rank; ``pop`` gives the leftmost position of the lowest rank in use.

    Two levels: ``words`` has a bit per rank, ``top`` a bit per word in use. The word width is the least power of two
    whose square covers the ranks (256 bits for 50 thousand), so both levels are short integers.
    """

    def __init__(self, ranks: int):
        self.shift = max(1, ((ranks - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.shift) - 1
        self.words = [0] * ((ranks >> self.shift) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        at = rank >> self.shift
        self.words[at] |= 1 << (rank & self.mask)
        self.top |= 1 << at

    def pop(self) -> tuple[int, int] | None:
        """(rank, position), or None when nothing is left."""
        top = self.top
        if not top:
            return None
        at = (top & -top).bit_length() - 1
        word = self.words[at]
        low = word & -word
        rank = (at << self.shift) + low.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        self.words[at] = word = word ^ low
        if not word:
            self.top = top & (top - 1)
        return rank, bucket[0]


class Encoder:
    """Ranks of a vocabulary (bytes to rank, which is also the id) and the pattern that cuts pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.longest = max(map(len, ranks), default=1)
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.numerals = [str(i) for i in range(len(self.bytes_of))]
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks, n = self.ranks, len(piece)
        whole = ranks.get(piece) if n <= self.longest else None
        if whole is not None:
            return [whole]
        longest, get, push, pop = self.longest, ranks.get, self.queue.push, self.queue.pop
        after, before = list(range(1, n + 2)), list(range(-1, n))
        filed = [-1] * (n + 1)
        for p in range(n - 1):
            r = get(piece[p : p + 2])
            if r is not None:
                filed[p] = r
                push(r, p)
        while (entry := pop()) is not None:
            r, p = entry
            if filed[p] != r:
                continue
            gone = after[p]
            end = after[gone]
            after[p], before[end], filed[gone] = end, p, -1
            new = get(piece[p : after[end]]) if end < n and after[end] - p <= longest else None
            if new is None:
                filed[p] = -1
            else:
                filed[p] = new
                push(new, p)
            left = before[p]
            if left >= 0:
                new = get(piece[left:end]) if end - left <= longest else None
                if new is None:
                    filed[left] = -1
                else:
                    filed[left] = new
                    push(new, left)
        ids, p = [], 0
        while p < n:
            ids.append(ranks[piece[p : after[p]]])
            p = after[p]
        return ids

    def encode(self, text: str | None) -> list[int]:
        known, pieces = self.known, self.pattern.findall(text or "")
        long: dict[str, tuple[int, ...]] = {}
        for piece in set(pieces).difference(known):
            if len(piece) > REMEMBERED_CHARS:
                long[piece] = tuple(self.merge(piece.encode()))
                continue
            if len(known) >= REMEMBERED:
                known.clear()
                return self._encode_afresh(pieces)
            known[piece] = tuple(self.merge(piece.encode()))
        if long:
            return list(chain.from_iterable(known[p] if p in known else long[p] for p in pieces))
        return list(chain.from_iterable(map(known.__getitem__, pieces)))

    def _encode_afresh(self, pieces: list[str]) -> list[int]:
        own = {piece: tuple(self.merge(piece.encode())) for piece in set(pieces)}
        short = {piece: ids for piece, ids in own.items() if len(piece) <= REMEMBERED_CHARS}
        if len(short) < REMEMBERED:
            self.known.update(short)
        return list(chain.from_iterable(map(own.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@cache
def _encoder(raw: bytes, pattern: str) -> Encoder:
    return Encoder({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}, pattern)


def _shared(docs: DataFrame, ranks_path: str, pattern: str):
    """A function that gives the worker's encoder. The rank file (fixed size, under 1 MB) is broadcast."""
    with open(ranks_path, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    return lambda: _encoder(raw.value, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), verify: bool = False) -> DataFrame:
    """(id, kept columns, n_tokens, ids) for every row. Null and empty texts have no ids. No special tokens.

    With ``verify`` each row's ids are decoded, and one that does not give the text's bytes ends the job.

    Rows with a null id and repeated rows are encoded like any other; other columns are dropped unless kept, so
    clashing names do not matter; an empty table gives an empty result.
    """
    get = _shared(docs, ranks_path, pattern)
    columns = [id_col, *keep]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = get()
        ids = [encoder.encode(t.as_py()) for t in batch.column(len(columns))]
        if verify:
            for text, coded in zip(batch.column(len(columns)), ids, strict=True):
                if encoder.decode(coded) != (text.as_py() or "").encode():
                    raise ValueError("the ids of a text decode to another text")
        own = [batch.column(i) for i in range(len(columns))]
        return pa.RecordBatch.from_arrays([*own, pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=[*columns, "n_tokens", "ids"])

    kinds = ", ".join(f"`{c}` {docs.select(c).schema[0].dataType.simpleString()}" for c in columns)
    return map_rows(docs, [*columns, text_col], f"{kinds}, n_tokens bigint, ids array<int>", run)


def decode(tokens: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) for every row of ids; null ids decode to no bytes."""
    get = _shared(tokens, ranks_path, pattern)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [get().decode(ids.as_py() or []) for ids in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=[id_col, "decoded"])

    kind = tokens.select(id_col).schema[0].dataType.simpleString()
    return map_rows(tokens, [id_col, ids_col], f"`{id_col}` {kind}, decoded binary", run)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids, in one pass over the texts.

    The digests are of the decimal ids joined by one space and of the decoded bytes. Null text counts as empty.
    """
    get = _shared(docs, ranks_path, pattern)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = get()
        counts, coded, decoded = [], [], []
        for text in batch.column(1):
            ids = encoder.encode(text.as_py())
            counts.append(len(ids))
            coded.append(hashlib.sha256(" ".join(map(encoder.numerals.__getitem__, ids)).encode()).hexdigest())
            decoded.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", run)
