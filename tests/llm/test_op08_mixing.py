import random
from collections import Counter

import duckdb
import pandas as pd
import pytest
from fathomite.llm import mixing as op


def table(seed=8, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", "Z", "é", None])
        rows.append((i, None if i == 7 else " ".join(f"w{rng.randint(0, 99)}" for _ in range(0 if i == 9 else rng.randint(1, 900))), source))
    rows.append((n, " ".join(f"v{i}" for i in range(20_000)), "b"))
    return rows + [rows[3], rows[3], (None, "one two", "b")]


def brute_targets(sizes):
    """Reshare in rounds, as the rule is told."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, got, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(got.values())) / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        got |= {s: 2.0 * sizes[s] for s in above} if above else {s: level * weight[s] for s in open_}
        open_ = open_ - above if above else set()
    return got


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, r[2]) for r in table()], "doc_id long, text string, source string, size string")


def test_targets_taken_and_sql(spark, docs):
    got = op.mix(docs).toPandas()
    again = op.mix(docs.repartition(7)).toPandas()
    order = ["doc_id", "size", "taken"]
    assert got.sort_values(order).reset_index(drop=True).equals(again.sort_values(order).reset_index(drop=True))
    rows = table()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    by = {(r.source_size, round(r.target, 6)): 0 for r in got.itertuples()}
    for r in got.itertuples():
        by[(r.source_size, round(r.target, 6))] += r.taken
    assert set(by) == {(sizes[s], round(want[s], 6)) for s in sizes}
    assert all(abs(taken - target) <= 2 * op.BLOCK for (_, target), taken in by.items())
    db = duckdb.connect()
    db.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    sql = db.execute(op.oracle_sql()).df()
    assert sorted(map(repr, sql.fillna(-1).astype({"doc_id": int})[list(got.columns)].itertuples(index=False))) == sorted(map(repr, got.fillna(-1).astype({"doc_id": int}).itertuples(index=False)))


def test_slots_follow_the_drawn_counts(spark, docs):
    sources = op.targets(op.sized(docs)).cache()
    counts = op.shard_counts(sources).cache()
    held = op.slots(sources, counts).cache()
    for r in sources.join(held.groupBy("sid", "block").count(), "sid").collect():
        assert 0 <= r.block < r.blocks and r["count"] in (r.slots // r.blocks, -(-r.slots // r.blocks))
    assert sorted(held.groupBy("sid", "shard").count().collect()) == sorted(counts.collect())
    assert {r.sid: r.n for r in counts.groupBy("sid").agg(op.F.sum("n").alias("n")).collect()} == {r.sid: r.slots for r in sources.collect() if r.slots}
    # With another draw other slots are taken: one that holds back half of its shards leaves their blocks out.
    fewer = op.slots(sources, counts.filter("shard % 2 = 0"))
    assert fewer.count() == (counts.filter("shard % 2 = 0").agg(op.F.sum("n")).first()[0] or 0)


def test_counts_are_a_multinomial_draw(spark, monkeypatch):
    monkeypatch.setattr(op, "SHARD", 64)
    docs = spark.createDataFrame([(i, "w " * 1000, s) for i, s in enumerate("abc" * 40)], "doc_id long, text string, source string")
    sources = op.targets(op.sized(docs)).cache()
    n = {(r.sid, r.shard): r.n for r in op.shard_counts(sources).collect()}
    for s in sources.collect():
        mean = s.slots / s.shards
        own = [n.get((s.sid, k), 0) for k in range(s.shards)]
        assert sum(own) == s.slots and 0.3 < sum((x - mean) ** 2 for x in own) / s.shards / mean < 3


def test_documents_follow_the_mix(spark, docs):
    plain = docs.dropDuplicates()
    taken = Counter()
    for r in op.mix(plain).collect():
        taken[r.doc_id] += r.taken
    made = op.mix_documents(plain.withColumn("n_chars", op.F.lit(0)), length_col="n_chars").collect()
    words = Counter()
    texts = {r.doc_id: r.text or "" for r in plain.collect()}
    for r in made:
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
        assert r.text == texts[r.doc_id] or len(r.text.split()) < len(texts[r.doc_id].split())
    assert +words == +taken


def test_white_space_is_kept_and_names_may_clash(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 5)
    monkeypatch.setattr(op, "SHARD", 8)
    texts = {i: "".join(random.Random(i).choice([" ", "\n", "\t ", "\n\n  "]) + f"w{i}x{j}" for j in range(i * 3)) + "  " for i in range(1, 25)}
    rows = [(i, t, "ab"[i % 2], "1", 2, "3", "4", "5", "6", "7") for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _h string, _size int, _words string, key string, row string, picks string, way string")
    for shard_col in (None, "shard", "_h"):
        made = op.mix_documents(docs, shard_col=shard_col)
        assert made.columns == docs.columns + (["shard"] if shard_col == "shard" else [])
        words, times = Counter(), Counter()
        for r in made.collect():
            assert (r._size, r._words, r.key, r.row, r.picks, r.way) == (2, "3", "4", "5", "6", "7") and r.source == "ab"[r.doc_id % 2]
            words.update(r.text.split())
            left = texts[r.doc_id]
            for run in r.text.split():  # in order
                left = left[left.index(run) + len(run) :]
            times[r.doc_id] += len(r.text.split())
            if shard_col is None and len(r.text.split()) == 3 * r.doc_id:
                assert r.text == texts[r.doc_id]
        assert max(words.values()) <= 2
        assert times == +Counter({r.doc_id: r.taken for r in op.mix(docs).collect()})
    by_shard = {(r.doc_id, int(r._h)) for r in op.mix_documents(docs, shard_col="_h").collect()}
    assert Counter(d for d, _ in by_shard) == +Counter({r.doc_id: r.n_shards for r in op.mix(docs).collect()})


def test_empty(spark, docs):
    assert op.mix(docs.limit(0)).count() == 0
    assert op.mix(docs.filter("text is null or text = ''")).filter("taken <> 0 or target <> 0").count() == 0
