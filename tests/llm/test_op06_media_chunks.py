import hashlib
import io
import random
import wave
import zlib

import numpy as np
import pytest
from fathomite.llm import media_chunks as op


def test_gear_hash_matches_the_rolling_definition():
    data = bytes(random.Random(1).randbytes(500))
    table, h, want = op.gear_table(), 0, []
    for b in data:
        h = ((h << 1) + int(table[b])) % (1 << 32)
        want.append(h)
    assert op.gear_hashes(np.frombuffer(data, np.uint8)).tolist() == want


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000, 200_000])
def test_cut_is_lossless_and_bounded(n):
    data = random.Random(n).randbytes(n)
    chunks = op.cut(data)
    assert b"".join(chunks) == data
    assert all(op.LEAST <= len(c) <= op.MOST for c in chunks[:-1])
    assert op.cut(b"a" * n) and all(len(c) <= op.MOST for c in op.cut(b"a" * n))


def test_cuts_follow_content():
    rng = random.Random(2)
    shared = rng.randbytes(100_000)
    a, b = set(op.cut(rng.randbytes(777) + shared)), set(op.cut(rng.randbytes(4321) + shared))
    assert len(a & b) > 10


def test_wav_is_readable_by_the_standard_library():
    n, payload = op.payload_of("é" * 200)
    assert (n, len(payload)) == (400, 576)
    with wave.open(io.BytesIO(op.wav_of(payload))) as f:
        assert (f.getsampwidth(), f.getnchannels()) == (1, 1)
        assert f.readframes(f.getnframes()) == payload
    with pytest.raises(ValueError):
        op.samples_of(op.wav_of(payload)[:-1])


def test_tables(spark):
    rng = random.Random(3)
    long = " ".join(rng.choices("the cat sat on a mat".split(), k=30_000))
    assert op._coder(op.train_dictionary(spark.createDataFrame([(long[i : i + 2000],) for i in range(500)], "text string")))
    texts = [None, "", "x", "é" * 96, "a" * 193, long, long, "y " + long]
    docs = spark.createDataFrame([(i if i != 2 else None, t, "z") for i, t in enumerate(texts)] + [(1, "", "z")], "doc_id long, text string, packed string")
    got = op.media_columns(docs).collect()
    assert sorted(map(str, op.media_columns(docs, hot_refs=1).collect())) == sorted(map(str, got))
    assert len(got) == 9
    for r in got:
        text = texts[r.doc_id if r.doc_id is not None else 2] or ""
        raw = text.encode()
        payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        wav = op.wav_of(payload)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(wav))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.media_sha256 == hashlib.sha256(wav).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.feature == op.feature_of(payload)
    assert op.media_columns(docs.limit(0)).count() == 0


def test_equal_chunks_are_stored_once(spark):
    rng = random.Random(5)
    passage = " ".join(rng.choices([f"w{i}" for i in range(999)], k=20_000))
    texts = [passage, passage + " end", passage, "a beginning " + passage, "x" * 400 + passage]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    stored = op.chunk_store(docs).collect()
    wanted = {hashlib.sha256(c).digest(): c for t in texts for c in op.cut(op.payload_of(t)[1])}
    assert {bytes(r.digest) for r in stored} == set(wanted) and len(stored) == len(wanted)
    alone = sum(len(op.cut(op.payload_of(t)[1])) for t in texts)
    assert len(stored) < alone / 4, "the passage's chunks are shared, the first ones too"
    files = {bytes(r.media): bytes(r.file) for r in op.rebuild(op.manifest(docs).select("media", "header", "chunks").dropDuplicates(["media"]), op.chunk_store(docs)).collect()}
    assert files == {hashlib.sha256(w).digest(): w for w in (op.wav_of(op.payload_of(t)[1]) for t in texts)}


def test_damage_is_found(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    lists, store = op.manifest(docs).select("media", "header", "chunks"), op.chunk_store(docs)
    with pytest.raises(Exception, match="not in the store"):
        op.rebuild(lists, store.limit(0)).collect()
    other = op.chunk_store(spark.createDataFrame([("other",)], "text string")).select("packed")
    with pytest.raises(Exception, match="damaged"):
        op.rebuild(lists, store.drop("packed").crossJoin(other)).collect()
    with pytest.raises(Exception, match="damaged"):
        op.rebuild(lists, store.withColumn("packed", op.F.lit(b"no frame"))).collect()
