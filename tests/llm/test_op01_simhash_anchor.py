import random

import numpy as np
import pytest
import xxhash
from fathomite.llm import simhash_anchor as op


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """id -> least id, over fingerprints at 2 bits or fewer. prints: (id, fingerprint)."""
    group = list(range(len(prints)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 2:
                group[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return {(doc, least[find(i)]) for i, (doc, _) in enumerate(prints)}


def test_fingerprint_matches_brute_force():
    rng = random.Random(1)
    texts = ["", None, "  \t", "One", "one TWO", "É é E", "a b c d", *(" ".join(rng.choices("ab cd EF gh ij".split(), k=rng.randint(3, 60))) for _ in range(50))]
    assert [op.text_fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_every_near_pair_meets_at_the_home_anchor():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 300, dtype=np.uint64)
    b = a.copy()
    for _ in range(2):
        b ^= np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
    code = op.AnchorCode(2)
    rows, home = code.anchors(a, False)
    assert sorted(rows) == list(range(300))
    spread = set(zip(*(x.tolist() for x in code.anchors(b, True)), strict=True))
    assert all((i, h) in spread for i, h in zip(rows.tolist(), home.tolist(), strict=True))
    assert len(spread) / 300 < 90


@pytest.mark.parametrize("seed", [0, 1])
def test_components_match_brute_force(spark, seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choices([f"w{i}" for i in range(50)], k=rng.randint(1, 80))) for _ in range(25)]
    texts = base * 2 + [t + " x" for t in base] + ["", None, "  "]
    rows = [(i * 7 % 1009, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = op.near_duplicates(docs).collect()
    assert {(r.doc_id, r.component_id) for r in got} == brute_components([(i, brute_fingerprint(t)) for i, t, _ in rows])
    assert {(r.doc_id, r.fingerprint) for r in got} == {(i, f"{brute_fingerprint(t):016x}") for i, t, _ in rows}
    kept = {r.doc_id for r in op.keep_one(docs).collect()}
    assert kept == {c for _, c in brute_components([(i, brute_fingerprint(t)) for i, t, _ in rows])}


def test_chain_of_links_is_one_component(spark):
    chain = [0b11 << (2 * i) for i in range(1)]
    x = 0
    for i in range(20):
        x ^= 0b11 << (2 * i)
        chain.append(x)
    pairs = spark.createDataFrame([(a, b) for a, b in zip(chain, chain[1:], strict=False)], "a long, b long")
    assert {r.root for r in op.components(pairs).collect()} == {min(chain)}


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, None), (None, "zz yy xx ww")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in op.near_duplicates(docs).collect())
    assert got == [(-1, -1), (-1, -1), (-1, 5), (5, 5), (5, 5)]
    assert op.keep_one(docs).filter("doc_id = 5").count() == 1
    assert op.near_duplicates(docs.limit(0)).count() == 0
