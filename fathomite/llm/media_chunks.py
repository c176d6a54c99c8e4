"""Media columns with content-defined chunking.

A text becomes an 8-bit mono WAV file: its UTF-8 bytes, padded with spaces to a positive multiple of ``ROW``, are the
samples. The payload is cut where a rolling gear hash of the last 32 bytes has its high bits zero, within a least and a
largest chunk size, so equal passages give equal chunks wherever they stand. Chunks are named by SHA-256. The header,
which tells the file's length, is kept beside the list, so that files of different length can share their first chunk.

What is stored: a manifest (one row per document: sizes, the media's digest), the header and ordered chunk list of each
distinct media file, and each distinct chunk once, in a table bucketed by digest. A task packs a chunk only when it has
not met its digest before; a grouping on the digest, combined before the shuffle, drops the copies of other tasks.
Reading back joins the lists with the bucketed chunks by digest, so stored bytes are not shuffled for the join, gathers
each media file's chunks (never more than one file in a group), unpacks one file at a time, checks it against its name,
computes its features there and then, and lets it go: files never leave the worker. Equal media are rebuilt once,
however many documents share them. Chunks with more than ``HOT_REFS`` references are joined apart, copied to ``SALTS``
keys, so that no task gets all references of one chunk.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import bounded_sample, map_rows, materialize, released, small_batches

ROW = 192
RATE = 8000
#: Bytes of a WAV file before its samples.
HEADER = 44
LEAST, MEAN_BITS, MOST = 512, 11, 8192
#: The compression dictionary: its size, and the texts at most that it is trained on (lossless with any dictionary).
DICTIONARY_BYTES, DICTIONARY_TEXTS = 112_640, 3000
LEVEL = 15
#: Digests that a task remembers as packed; all are forgotten when it is full. This bounds memory, not results.
REMEMBERED = 100_000
HOT_REFS, SALTS = 20_000, 64


@cache
def gear_table() -> np.ndarray:
    """256 pseudorandom 32-bit values: the first four bytes of SHA-256 of each byte value."""
    return np.array([struct.unpack("<I", hashlib.sha256(bytes([b])).digest()[:4])[0] for b in range(256)], np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of gear[b_i-j] << j over the last 32 bytes, mod 2**32, by five doublings."""
    h = gear_table()[data]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def cut(data: bytes) -> list[bytes]:
    """Content-defined chunks of ``data``; at least one, each of LEAST to MOST bytes but for the last."""
    if len(data) <= LEAST:
        return [data]
    h = gear_hashes(np.frombuffer(data, np.uint8))
    marks = np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1
    cuts, start = [0], 0
    while len(data) - start > LEAST:
        i = np.searchsorted(marks, start + LEAST)
        end = min(int(marks[i]) if i < len(marks) else len(data), start + MOST, len(data))
        cuts.append(end)
        start = end
    if cuts[-1] != len(data):
        cuts.append(len(data))
    return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, payload)."""
    raw = (text or "").encode()
    n = max(1, -(-len(raw) // ROW)) * ROW
    return len(raw), raw.ljust(n, b" ")


def wav_of(payload: bytes) -> bytes:
    """An 8-bit mono PCM WAV file with ``payload`` as samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples_of(wav: bytes) -> bytes:
    """The samples of a WAV file as ``wav_of`` writes it; raises where the header does not fit."""
    riff, size, wave, _, _, kind, channels, _, _, _, bits, data, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", wav)
    if (riff, wave, data) != (b"RIFF", b"WAVE", b"data") or (kind, channels, bits) != (1, 1, 8) or size != 36 + n or len(wav) != HEADER + n:
        raise ValueError("not an 8-bit mono WAV file")
    return wav[HEADER:]


def feature_of(samples: bytes) -> str:
    """Mean, root mean square, crossings of the middle and the loudest of 16 bands, of samples centred on 128."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    bands = np.bincount(np.frombuffer(samples, np.uint8) >> 4, minlength=16)
    return f"mean={int(x.sum()) / len(x):.6f};rms={(int((x * x).sum()) / len(x)) ** 0.5:.6f};crossings={crossings};band={int(bands.argmax())}"


def manifest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media, media_bytes, header, chunks): one row per document, with the digests of the payload's chunks
    in order.

    media is the SHA-256 of the file, as bytes; the file is the header followed by the payload.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, names, lengths, headers, lists = [], [], [], [], []
        for text in batch.column(1):
            n, payload = payload_of(text.as_py())
            wav = wav_of(payload)
            sizes.append(n)
            names.append(hashlib.sha256(wav).digest())
            lengths.append(len(wav))
            headers.append(wav[:HEADER])
            lists.append([hashlib.sha256(c).digest() for c in cut(payload)])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(lengths, pa.int64()), pa.array(headers, pa.binary()), pa.array(lists, pa.list_(pa.binary()))],
            names=[id_col, "n_bytes", "media", "media_bytes", "header", "chunks"],
        )

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], f"`{id_col}` {kind}, n_bytes bigint, media binary, media_bytes bigint, header binary, chunks array<binary>", run)


def train_dictionary(docs: DataFrame, text_col: str = "text") -> bytes:
    """A zstandard dictionary from a bounded sample of the texts, at most MOST characters of each, as many as a chunk may
    have; empty where there is too little text. It decides how small chunks get, and nothing else."""
    sample = bounded_sample(docs.select(F.substring(text_col, 1, MOST).alias("t")), F.col("t"), DICTIONARY_TEXTS).distinct().select(F.encode("t", "UTF-8").alias("t")).toArrow()
    rows = sorted(t.as_py() for t in sample["t"])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [t for t in rows if t]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


@cache
def _coder(dictionary: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if d:
        d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_dict_id=False), zstandard.ZstdDecompressor(dict_data=d)


def chunk_store(docs: DataFrame, text_col: str = "text", dictionary: bytes = b"") -> DataFrame:
    """(digest, packed): every distinct chunk of the payloads of ``docs`` once, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _coder(dictionary)[0]
        met: set[bytes] = set()
        for batch in batches:
            own: dict[bytes, bytes] = {}
            for text in batch.column(0):
                for chunk in cut(payload_of(text.as_py())[1]):
                    digest = hashlib.sha256(chunk).digest()
                    if digest not in met:
                        if len(met) >= REMEMBERED:
                            met.clear()
                        met.add(digest)
                        own[digest] = pack.compress(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.binary()), pa.array(own.values(), pa.binary())], names=["digest", "packed"])

    small_batches(docs.sparkSession)
    return docs.select(text_col).mapInArrow(run, "digest binary, packed binary").groupBy("digest").agg(F.first("packed").alias("packed"))


def gathered(lists: DataFrame, store: DataFrame, hot_refs: int = HOT_REFS) -> DataFrame:
    """(media, parts) for each row (media, header, chunks) of ``lists``: its stored chunks with their places, the header
    beside the first. Files of one chunk are whole where they are joined; only the others are gathered."""
    alone = lists.filter(F.size("chunks") == 1).select("media", "header", F.col("chunks")[0].alias("digest")).hint("merge").join(store, "digest", "left")
    alone = alone.select("media", F.array(F.struct(F.lit(0).alias("pos"), "header", "packed")).alias("parts"))
    refs = lists.filter(F.size("chunks") > 1).select("media", "header", F.posexplode("chunks").alias("pos", "digest")).withColumn("header", F.when(F.col("pos") == 0, F.col("header"))).hint("merge")
    hot = refs.groupBy("digest").count().filter(F.col("count") > hot_refs).select("digest")
    with released(lists.sparkSession):
        any_hot = not hot.isEmpty()
    if any_hot:
        hot = materialize(hot, "hot")
        salted = refs.join(hot, "digest", "left_semi").withColumn("salt", F.pmod(F.xxhash64("media", "pos"), F.lit(SALTS)).cast("int"))
        copies = store.join(hot, "digest", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = refs.join(hot, "digest", "left_anti").join(store, "digest", "left")
        found = found.unionByName(salted.join(copies, ["digest", "salt"], "left").drop("salt"))
    else:
        found = refs.join(store, "digest", "left")
    return found.groupBy("media").agg(F.collect_list(F.struct("pos", "header", "packed")).alias("parts")).unionByName(alone)


def file_of(name: bytes, parts: list[dict], unpack: zstandard.ZstdDecompressor) -> bytes:
    """The file that ``parts`` make up; raises where a chunk is missing or the file does not have its name."""
    parts = sorted(parts, key=lambda p: p["pos"])
    for part in parts:
        if part["packed"] is None:
            raise ValueError(f"chunk {part['pos']} of media {name.hex()} is not in the store")
    try:
        file = parts[0]["header"] + b"".join(unpack.decompress(p["packed"], max_output_size=MOST) for p in parts)
    except zstandard.ZstdError as e:
        raise ValueError(f"media {name.hex()} is damaged") from e
    if hashlib.sha256(file).digest() != name:
        raise ValueError(f"media {name.hex()} is damaged")
    return file


def _read(parts: DataFrame, dictionary: bytes, schema: str, row_of: Callable[[bytes, bytes], tuple], most: int) -> DataFrame:
    """A row for each file of ``parts``: one file is unpacked at a time; rows leave in batches of ``most`` bytes of file."""
    kinds = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, own = _coder(dictionary)[1], to_arrow_schema(kinds)
        for batch in batches:
            rows, n = [], 0
            for name, found in zip(batch.column(0), batch.column(1), strict=True):
                file = file_of(name.as_py(), found.as_py(), unpack)
                rows.append(row_of(name.as_py(), file))
                n += len(file)
                if n >= most:
                    yield pa.RecordBatch.from_pylist([dict(zip(own.names, r, strict=True)) for r in rows], schema=own)
                    rows, n = [], 0
            yield pa.RecordBatch.from_pylist([dict(zip(own.names, r, strict=True)) for r in rows], schema=own)

    small_batches(parts.sparkSession)
    return parts.select("media", "parts").mapInArrow(run, schema)


def rebuild(lists: DataFrame, store: DataFrame, dictionary: bytes = b"", hot_refs: int = HOT_REFS) -> DataFrame:
    """(media, file) for each row (media, header, chunks) of ``lists``, from the stored chunks.

    A chunk that is missing, or a file that does not have its name, ends the job.
    """
    return _read(gathered(lists, store, hot_refs), dictionary, "media binary, file binary", lambda name, file: (name, file), 1 << 20)


def features(lists: DataFrame, store: DataFrame, dictionary: bytes = b"", hot_refs: int = HOT_REFS) -> DataFrame:
    """(media, payload_bytes, payload_sha256, tail_crc32, feature) of media read back as by ``rebuild``, without the files."""

    def row_of(name: bytes, file: bytes) -> tuple:
        samples = samples_of(file)
        return name, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), feature_of(samples)

    return _read(gathered(lists, store, hot_refs), dictionary, "media binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, feature string", row_of, 16 << 20)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_refs: int = HOT_REFS) -> DataFrame:
    """Store every text as chunked media, read all of it back, and return a row of digests and features per document.

    Null text counts as empty; an empty text has one row of spaces as payload. Null ids and repeated rows are kept
    as they come; other columns are ignored; an empty table gives an empty result.
    """
    dictionary = train_dictionary(docs, text_col)
    listed = materialize(manifest(docs, id_col, text_col), "manifest")
    store = materialize(chunk_store(docs, text_col, dictionary), "chunks", codec="uncompressed", bucket_by="digest")
    lists = listed.groupBy("media").agg(F.first("header").alias("header"), F.first("chunks").alias("chunks"))
    made = materialize(features(lists, store, dictionary, hot_refs), "features")
    own = listed.drop("header", "chunks").join(made, "media", "left").withColumn("media_sha256", F.lower(F.hex("media")))
    return own.select(id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
