import random

import pytest
from fathomite.llm import near_dedup as op


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_groups(rows):
    """Index -> group number, over all pairs at a Jaccard similarity of 0.8 or more. rows: (id, text)."""
    sets, group = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                group[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_one_of_each_group_of_edited_copies(spark, seed, monkeypatch):
    rng = random.Random(seed)
    base = [" ".join(rng.choices([f"w{i}" for i in range(60)], k=rng.randint(1, 150))) for _ in range(25)]
    line = "one very common line that is in nearly all of the texts here"
    texts = [line + " " + t for t in base] + base[:5] + [edited(rng, t, n) for t in base for n in (1, 1, 2, 3, 4)] + ["", None, "  ", line]
    chain = [base[0] + " " + " ".join(f"q{i}" for i in range(80))]
    for _ in range(6):
        chain.append(edited(rng, chain[-1], 2))
    texts += chain
    rng.shuffle(texts)
    rows = [(i * 7 % 1009, t, "x") for i, t in enumerate(texts)]
    groups = brute_groups([r[:2] for r in rows])
    want = {min(rows[i][0] for i in range(len(rows)) if groups[i] == g) for g in groups}
    got = [r.doc_id for r in op.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string, prefix string")).collect()]
    assert sorted(got) == sorted(want) and len(want) < len(rows) - 25
    monkeypatch.setattr(op, "SKETCH_BITS", 1)
    monkeypatch.setattr(op, "HEADS", 0)
    assert sorted(r.doc_id for r in op.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string, prefix string")).collect()) == sorted(want)


def test_repeated_and_null_ids(spark):
    rows = [(5, "a b c"), (5, "a b c"), (5, "z y x w v u"), (6, "Z y x w v u"), (None, "a b c"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.text or "") for r in op.keep_one_similar(docs).collect())
    assert got == [(-1, ""), (-1, "a b c"), (5, "a b c"), (5, "z y x w v u")]
    assert op.keep_one_similar(docs.limit(0)).count() == 0


def test_pipeline_stage(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    groups = brute_groups(rows)
    least = {}
    for (doc, _), g in zip(rows, groups, strict=True):
        least[g] = min(doc, least.get(g, doc))
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates_stage(spark, docs, sf).collect()) == sorted(least.values())


def test_parity_bits_never_refuse_a_similar_pair(spark):
    rng = random.Random(9)
    pairs = []
    for _ in range(60):
        text = " ".join(rng.choices([f"w{i}" for i in range(500)], k=rng.randint(20, 400)))
        pairs.append((text, edited(rng, text, rng.randint(0, 12))))
    rows = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    docs = spark.createDataFrame(rows, "row long, text string")
    sketch = op.frequency_sketch(docs, "text")
    made = {r.row: r for r in op.signatures(docs, "row", "text", sketch).collect()}
    assert sketch.sum() == sum(len(op.shingle_set(t)) for _, t in rows)
    differ = lambda x, y: sum(bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(x.bits, y.bits, strict=True))
    allowed = [(op.DEN + op.NUM) * differ(x, y) <= (op.DEN - op.NUM) * (x.n + y.n) for x, y in ((made[2 * i], made[2 * i + 1]) for i in range(60))]
    similar = [op.is_similar(op.shingle_set(a), op.shingle_set(b)) for a, b in pairs]
    assert 0 < sum(similar) < 60 and all(a for a, s in zip(allowed, similar, strict=True) if s)


def test_names_may_clash_and_ids_repeat(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(2, text, "k1"), (1, text, "k2"), (1, "other words here", "k3"), (None, text, "k4"), (None, None, "k5"), (1, text, "k6")]
    docs = spark.createDataFrame([(i, t, x, 1, 2, 3, 4, 5) for i, t, x in rows], "doc_id long, text string, _row string, key int, token int, root int, bits int, fp int")
    for keep in (op.keep_one_similar, __import__("fathomite.llm.simhash_anchor", fromlist=["x"]).keep_one):
        made = keep(docs)
        assert made.columns == docs.columns
        assert sorted((r.doc_id or 0, r.text or "") for r in made.collect()) == sorted([(1, text), (1, "other words here"), (0, text), (0, "")])
        assert keep(docs.limit(0)).count() == 0


def test_sets_with_one_key_are_told_apart(spark):
    own = spark.createDataFrame([(1, 7, -5, "a"), (2, 7, -5, "a"), (3, 7, 9, "b"), (4, 8, 9, "c")], "row int, key long, check long, text string")
    got = {r.row: r.key for r in op.named_apart(own).collect()}
    assert got[1] == got[2] == 7 and got[4] == 8 and got[3] not in (7, 8)
    assert op.named_apart(own.filter("row <> 3")).columns == ["row", "key", "text"]
