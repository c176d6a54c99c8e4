import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fathomite.llm import packing as op

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def texts():
    rng = random.Random(6)
    parts = ["word ", "Wort", "naïve ", "漢字", "😀", "\n\n", "  ", "1234", "'ll ", "don't", "<|endoftext|>", "\x00", "é", " ", "_", "!?", "\t"]
    return [None, "", " ", "a", "x" * 5000, "long text of words " * 3000, "<|endoftext|>"] + ["".join(rng.choices(parts, k=rng.choice([1, 5, 60, 400, 900]))) for _ in range(300)]


def expected(library, i, text, length=1024):
    ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
    cut = len(ids) % length or length
    bounds = [0, *range(cut, len(ids) + 1, length)]
    return [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]


def gapless(rows, length):
    own = defaultdict(list)
    for r in rows:
        own[r.sequence_id].append((r.offset, r.length))
    for places in own.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= length
    return len(own)


def first_fit_decreasing(sizes, length):
    """How many sequences it takes; never more than 11/9 of the fewest."""
    free = []
    for s in sorted(sizes, reverse=True):
        k = next((k for k, f in enumerate(free) if f >= s), None)
        if k is None:
            free.append(length - s)
        else:
            free[k] -= s
    return len(free)


def test_pieces_are_the_librarys_and_sequences_are_gapless(spark, library):
    rows = list(enumerate(texts())) + [(None, "no id"), (3, "a"), (3, "a"), (3, "another text")]
    docs = spark.createDataFrame([(i, t, "q", 1.5) for i, t in rows], "doc_id long, text string, piece string, item double")
    got = op.best_fit(docs, PATH, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    made = got.collect()
    assert sorted((tuple(r)[:5] for r in made), key=repr) == sorted((p for i, t in rows for p in expected(library, i, t)), key=repr)
    assert gapless(made, 1024) <= first_fit_decreasing([r.length for r in made], 1024)


def test_sequences_hold_the_ids(spark, library):
    rows = list(enumerate(texts()[:60]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = op.sequences(docs, PATH, public_tokenizers.PATTERN, length=100).collect()
    assert all(len(r.ids) <= 100 and r.starts[0] == 0 for r in made)
    want = sorted(i for _, t in rows for i in [*library.encode(t or "", add_special_tokens=False).ids, 2])
    assert sorted(i for r in made for i in r.ids) == want


def test_a_file_that_ranks_do_not_express_goes_to_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        own = op.Tokens(f.read(), public_tokenizers.PATTERN)
    t = Tokenizer.from_file(path)
    assert own.library is not None
    assert own.encode("Some words, and more").tolist() == t.encode("Some words, and more", add_special_tokens=False).ids


def test_a_text_beyond_the_patterns_stack(library):
    with open(PATH, "rb") as f:
        own = op.Tokens(f.read(), public_tokenizers.PATTERN)
    text = "a" + " " * 1_500_000
    ids = own.encode(text)
    assert own.by_ranks.decode_bytes(ids.tolist()) == text.encode()


def slow_best_fit(sizes, length, most):
    """The same by a plain list of open bins."""
    bins, made, out = [], 0, []
    for s in sizes:
        fits = [b for b in bins if b[1] >= s]
        if fits:
            best = min(b[1] for b in fits)
            b = [b for b in fits if b[1] == best][-1]
            bins.remove(b)
        else:
            if len(bins) >= most and s < length:
                fullest = min(b[1] for b in bins)
                bins.remove([b for b in bins if b[1] == fullest][-1])
            b, made = [made, length], made + 1
        out.append((b[0], length - b[1]))
        b[1] -= s
        if b[1]:
            bins.append(b)
    return out


def test_best_fit_against_plain_lists():
    rng = random.Random(8)
    for length, most in ((10, 1), (10, 3), (100, 8), (1024, 64)):
        sizes = [rng.randint(1, length) for _ in range(2000)]
        packer = op.BestFit(length, most)
        assert [packer.put(s) for s in sizes] == slow_best_fit(sizes, length, most)
        assert len(packer.open) == packer.n_open <= most


def test_rounds_pack_what_packers_leave_open(spark):
    rng = random.Random(9)
    sizes = [rng.randint(1, 1024) for _ in range(6000)]
    rows = spark.createDataFrame([(i, s, "own", "own") for i, s in enumerate(sizes)], "id int, length long, offset string, row string")
    made = op.packed(rows, open_bins=50, per_packer=150).collect()
    assert sorted((r.id, r.length, r.row) for r in made) == [(i, s, "own") for i, s in enumerate(sizes)]
    one = op.packed(rows, open_bins=50, per_packer=100_000).collect()
    n, least = gapless(made, 1024), sum(sizes) / 1024
    assert gapless(one, 1024) <= 1.3 * least and n <= 1.3 * least
    with pytest.raises(ValueError):
        op.packed(rows, open_bins=50, per_packer=99)


def test_repeats_share_no_place_and_empty_table(spark):
    rows = spark.createDataFrame([(1, 600)] * 40 + [(2, 424)] * 40, "doc_id long, length long")
    assert gapless(op.packed(rows).collect(), 1024) == 40
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op.best_fit(docs, PATH, public_tokenizers.PATTERN).count() == 0
