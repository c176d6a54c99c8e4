import base64
import random
import time

import public_tokenizers
import pytest
import tiktoken
from fathomite.llm import bpe_bitmap as op

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_match_the_library(ranks, library):
    rng = random.Random(5)
    encoder = op.Encoder(ranks, public_tokenizers.PATTERN)
    texts = ["", "a", "Hello, world! it's", "  \n\n x\t", "aaaaaaaaaaaaaaaaa", "çé ñß 漢字かな 🙂🙂", "<|endoftext|>", "Ueóue ra thntheorthtion 12345678 ===--==="]
    texts += ["".join(rng.choices("abcdeth in.,!é漢 \n0123", k=rng.randint(1, 300))) for _ in range(200)]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == library.encode_ordinary(t)
        assert encoder.decode(ids) == t.encode()


def test_long_pretokens(ranks, library):
    rng = random.Random(6)
    encoder = op.Encoder(ranks, public_tokenizers.PATTERN)
    long = "".join(rng.choices("etaoinshr", k=200_000))
    began = time.time()
    ids = encoder.encode(long)
    assert time.time() - began < 20
    assert encoder.decode(ids) == long.encode()
    assert encoder.encode(long[:5000]) == library.encode_ordinary(long[:5000])
    assert encoder.encode("a" * 4999) == library.encode_ordinary("a" * 4999)


def test_forgetting_does_not_change_ids(ranks, library, monkeypatch):
    monkeypatch.setattr(op, "REMEMBERED", 5)
    encoder = op.Encoder(ranks, public_tokenizers.PATTERN)
    for t in ["one two three four five six seven eight", "one two nine", "ten eleven twelve thirteen fourteen fifteen"] * 2:
        assert encoder.encode(t) == library.encode_ordinary(t)


def test_tables(spark, library):
    docs = spark.createDataFrame([(1, "the cat", "x"), (None, None, "y"), (1, "the cat", "x"), (2, "", None)], "doc_id long, text string, ids string")
    coded = op.encode(docs, PATH, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, list(r.ids)) for r in coded) == sorted([(1, 2, library.encode_ordinary("the cat"))] * 2 + [(0, 0, []), (2, 0, [])])
    back = op.decode(op.encode(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in back.collect()) == [(0, b""), (1, b"the cat"), (1, b"the cat"), (2, b"")]
    trip = {r.doc_id: r for r in op.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()}
    import hashlib

    assert trip[1].decoded_sha256 == hashlib.sha256(b"the cat").hexdigest()
    assert trip[1].ids_sha256 == hashlib.sha256(" ".join(map(str, library.encode_ordinary("the cat"))).encode()).hexdigest()
    assert trip[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert op.round_trip(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
