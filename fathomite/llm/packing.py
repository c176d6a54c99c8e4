"""Packing documents into sequences of a fixed length by bounded-space online best-fit.

A packer keeps a fixed number of open bins, filed by their free space; a bitset has a bit for each free space that some
open bin has, so that the tightest bin for a piece is the lowest bit at or above its length. A piece that fits nowhere
opens a bin, for which the fullest open bin is closed when all places are taken. Pieces come in a pseudorandom order and
are read ahead by a fixed number, of which the longest goes first; twice as many as bins, so that few bins close early.

On Spark, pieces are dealt to packers by a hash, some ten thousand to each, whatever their number. The bins that a
packer leaves open are the pieces of a next round, with as many fewer packers, until one is left; so each round has a
bounded number of half-empty bins for each task, and only the last leaves any.
"""

from __future__ import annotations

import json
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .bpe_bitmap import Encoder
from .common import map_rows, materialize

LENGTH, END_ID = 1024, 2
#: Open bins of a packer, pieces that it reads ahead, and pieces that one packer is dealt.
OPEN_BINS, AHEAD, PIECES = 4096, 8192, 50_000


class BestFit:
    """Open bins by free space. ``put`` places a piece and tells (bin, offset); ``open`` has the bins still open."""

    def __init__(self, length: int = LENGTH, open_bins: int = OPEN_BINS):
        self.length, self.most = length, open_bins
        self.free = 0
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]
        self.n_open = self.made = 0

    def _take(self, space: int) -> int:
        own = self.bins[space]
        number = own.pop()
        if not own:
            self.free ^= 1 << space
        self.n_open -= 1
        return number

    def put(self, size: int) -> tuple[int, int]:
        fits = self.free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.length, self.made
            self.made += 1
            if self.n_open >= self.most and size < self.length:
                self._take((self.free & -self.free).bit_length() - 1)
        left = space - size
        if left:
            own = self.bins[left]
            if not own:
                self.free |= 1 << left
            own.append(number)
            self.n_open += 1
        return number, self.length - space

    def put_all(self, sizes: np.ndarray, ahead: int = AHEAD) -> tuple[np.ndarray, np.ndarray]:
        """Bins and offsets of pieces that come in this order. Pieces of the full length need no reading ahead."""
        bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        whole = sizes == self.length
        part = np.flatnonzero(~whole)
        blocks = [np.flatnonzero(whole)] + [part[at : at + ahead] for at in range(0, len(part), ahead)]
        for block in blocks:
            for i in block[np.argsort(-sizes[block], kind="stable")].tolist():
                bins[i], offsets[i] = self.put(int(sizes[i]))
        return bins, offsets

    @property
    def open(self) -> dict[int, int]:
        """The length in use of each open bin."""
        return {number: self.length - space for space, own in enumerate(self.bins) for number in own}


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others,
    in order, for what follows the first 256 characters."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Token ids of a tokenizer file, as the tokenizers library gives them without special tokens.

    Where the file is plain byte-level BPE whose merges are numbered in their order, ids depend on ranks only; an encoder
    by ranks gives the same ids in a fraction of the time. Any other file goes to the library itself.
    """

    def __init__(self, raw: bytes, pattern: str):
        model = json.loads(raw)
        ranks = self._ranks(model)
        self.library = self.by_ranks = self.slow = None
        if ranks is None:
            self.library = Tokenizer.from_str(raw.decode())
            self.library.encode_special_tokens = True
        else:
            self.by_ranks = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.slow = Encoder(ranks, pattern)

    @staticmethod
    def _ranks(model: dict) -> dict[bytes, int] | None:
        own, cut = model["model"], model.get("pre_tokenizer") or {}
        bytewise = own["type"] == "BPE" and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        other = model.get("normalizer") or own.get("dropout") or own.get("continuing_subword_prefix") or own.get("end_of_word_suffix") or own.get("ignore_merges")
        if not bytewise or other:
            return None
        of, special = _bytes_of(), {t["content"] for t in model["added_tokens"] if t["special"]}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in own["merges"]]
        ids = [own["vocab"][m] for m in merged]
        if ids != sorted(ids) or len(set(ids)) != len(ids):
            return None
        return {bytes(of[c] for c in token): i for token, i in own["vocab"].items() if token not in special}

    def encode(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit integers."""
        if self.library is not None:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        try:
            return np.asarray(self.by_ranks.encode_to_numpy(text, disallowed_special=()), "<u4")
        except ValueError:  # its pattern's stack is limited (some million spaces); the slower encoder has no limit
            return np.array(self.slow.encode(text), "<u4")


@cache
def _tokens(raw: bytes, pattern: str) -> Tokens:
    return Tokens(raw, pattern)


def pieces(docs: DataFrame, tokenizer_path: str, pattern: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) for each piece of each row: its tokens and ``end_id``, cut if longer
    than ``length`` into pieces of it, of which only the first may be shorter.

    Null and empty texts have the end only. Repeated rows and null ids are documents like any other; other columns are
    left out, so their names may clash. The tokenizer file (a few MB) is broadcast as its bytes.
    """
    with open(tokenizer_path, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = _tokens(raw.value, pattern)
        rows, number, start, size, crc, own = [], [], [], [], [], []
        for i, text in enumerate(batch.column(1)):
            ids = np.append(tokens.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
            bounds = [0, *range(len(ids) % length or length, len(ids) + 1, length)]
            for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                rows.append(i)
                number.append(k)
                start.append(a)
                size.append(b - a)
                crc.append(zlib.crc32(ids[a:b].tobytes()))
                if with_ids:
                    own.append(ids[a:b])
        columns = [batch.column(0).take(pa.array(rows)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, *([pa.array(own, pa.list_(pa.int32()))] if with_ids else [])], names=[id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint{', ids array<int>' if with_ids else ''}", run)


def _round(items: DataFrame, n: int, length: int, open_bins: int, per_packer: int, seed: int) -> DataFrame:
    """(item, sequence_id, offset, used) of (item, size): used is null but for the bins that are still open at the end."""
    packers = -(-n // per_packer)
    dealt = items.withColumn("_h", F.xxhash64(F.lit(seed), "item")).withColumn("_packer", F.pmod(F.xxhash64(F.lit(-1 - seed), "item"), F.lit(packers)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_h", "ascending"), ("item", "ascending")])
        bins, base = BestFit(length, open_bins), table["_packer"][0].as_py() << 24
        numbers, offsets = bins.put_all(table["size"].to_numpy())
        used = list(map(bins.open.get, numbers.tolist()))
        return pa.table([table["item"], pa.array(base + numbers), pa.array(offsets), pa.array(used, pa.int64())], names=["item", "sequence_id", "offset", "used"])

    # Each round's bins are numbered apart: bits 24 and up hold the packer, the top ones the round.
    made = dealt.groupBy("_packer").applyInArrow(run, "item bigint, sequence_id bigint, offset bigint, used bigint")
    return made.withColumn("sequence_id", F.col("sequence_id") + F.lit(seed << 56))


def packed(rows: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, per_packer: int = PIECES, size_col: str = "length") -> DataFrame:
    """``rows`` with sequence_id and offset: each row's place in a sequence of at most ``length``, gapless from 0.

    Sizes are from 1 to ``length``. Rows may repeat; columns of the same names are replaced. No packer sees more than about
    ``per_packer`` rows. Which rows meet depends on the number of rows, on nothing else of the cluster.
    """
    if per_packer < 2 * open_bins:
        raise ValueError("a packer must get twice as many pieces as it may leave bins open")
    own = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    rows = materialize(rows.select(F.struct(*own).alias("row"), F.monotonically_increasing_id().alias("item")), "pieces")
    items = rows.select("item", F.col("row")[size_col].alias("size"))
    n, seed = items.count(), 0
    made = materialize(_round(items, n, length, open_bins, per_packer, seed), "packed")
    places, last = made, made
    while n > per_packer:
        # What is left open, one row for each bin, is packed anew; those rows' places are moved with their bins.
        items = last.filter("used IS NOT NULL AND offset = 0").select(F.col("sequence_id").alias("item"), F.col("used").alias("size"))
        n, seed = items.count(), seed + 1
        last = materialize(_round(items, n, length, open_bins, per_packer, seed), "packed")
        moved = last.select(F.col("item").alias("sequence_id"), F.col("sequence_id").alias("_to"), F.col("offset").alias("_by"), F.col("used").alias("_used"))
        still = places.filter("used IS NOT NULL").join(moved, "sequence_id").select("item", F.col("_to").alias("sequence_id"), (F.col("offset") + F.col("_by")).alias("offset"), F.col("_used").alias("used"))
        places = materialize(places.filter("used IS NULL").unionByName(still), "placed")
    return rows.join(places.select("item", "sequence_id", "offset"), "item").select("row.*", "sequence_id", "offset")


def best_fit(docs: DataFrame, tokenizer_path: str, pattern: str, length: int = LENGTH, end_id: int = END_ID, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row, see ``pieces``."""
    return packed(pieces(docs, tokenizer_path, pattern, length, end_id, id_col=id_col, text_col=text_col), length, open_bins)


def sequences(docs: DataFrame, tokenizer_path: str, pattern: str, length: int = LENGTH, end_id: int = END_ID, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, ids, starts): the packed sequences, at most ``length`` ids each, and where their documents begin."""
    rows = packed(pieces(docs, tokenizer_path, pattern, length, end_id, True, id_col, text_col), length, open_bins)
    own = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    return own.select("sequence_id", F.flatten(F.col("_p.ids")).alias("ids"), F.col("_p.offset").alias("starts"))
