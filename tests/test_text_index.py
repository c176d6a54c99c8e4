import math
import random
import re

import pytest
from fathomite.operators import retrieval as R, text_index as TI
from fathomite.storage import prune
from pyspark.sql import functions as F


def okapi(texts, query, k1=1.5, b=0.75, epsilon=0.25):
    docs = [re.findall(r"\b[a-z0-9][a-z0-9'-]*\b", (t or "").lower()) for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: r if r >= 0 else epsilon * mean for t, r in raw.items()}
    return [round(sum(idf[q] * d.count(q) * (k1 + 1) / (d.count(q) + k1 * (1 - b + b * len(d) / avg)) for q in query.lower().split() if q in idf), 6) for d in docs]


def texts(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(5000)]
    return [None, ""] + [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(n)]


def best(scores, k, allowed=None):
    return sorted(((-s, i) for i, s in enumerate(scores) if s > 0 and (allowed is None or i in allowed)))[:k]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rows = texts(900)
    docs = spark.createDataFrame([(i, t, [f"d:{i % 7}", "all"] if i % 5 else None) for i, t in enumerate(rows)], "id long, text string, tags array<string>").repartition(5)
    path = f"file://{tmp_path_factory.mktemp('index')}/texts"
    return rows, docs, path, TI.build_text_index(docs, path)


def test_search_gives_the_best_rows_and_skips_blocks(spark, indexed):
    rows, _, _, index = indexed
    asked = [("a", "w1 w7 w350"), ("b", "w2 w2 w2 w311 none"), ("c", ""), ("d", None), ("e", "w1"), ("f", "w399 w398 w397 w1")]
    queries = spark.createDataFrame(asked, "slot_id string, query string")
    found = TI.search_blocks(index, queries, 4, first=1)
    got = {}
    for r in found.rows.collect():
        got.setdefault(r.slot_id, []).append((r.rank, r.id, r.score))
    for slot, query in asked:
        want = best(okapi(rows, query or ""), 4) if query else []
        have = sorted(got.get(slot, []))
        assert [s for _, _, s in have] == pytest.approx([-s for s, _ in want], abs=2e-6)
        assert [i for _, i, _ in have] == [i for _, i in want] or len({round(-s, 5) for s, _ in want}) < len(want)
    assert 0 < found.n_scored < found.n_blocks


def test_filter_inside(spark, indexed):
    rows, _, _, index = indexed
    asked = [("all", "w1 w3", None), ("none", "w1 w3", []), ("two", "w1 w3", ["d:2", "d:4", "d:99"]), ("gone", "w1", ["d:99"])]
    queries = spark.createDataFrame(asked, "slot_id string, query string, tags array<string>")
    got = {}
    for r in TI.search_blocks(index, queries, 6).rows.collect():
        got.setdefault(r.slot_id, []).append((r.rank, r.id))
    own = okapi(rows, "w1 w3")
    assert set(got) == {"all", "two"}
    assert [i for _, i in sorted(got["all"])] == [i for _, i in best(own, 6)]
    assert [i for _, i in sorted(got["two"])] == [i for _, i in best(own, 6, {i for i in range(len(rows)) if i % 5 and i % 7 in (2, 4)})]


def test_reopened_and_replaced_whole(spark, indexed, tmp_path):
    rows, docs, path, index = indexed
    again = TI.open_text_index(spark, path)
    q = spark.createDataFrame([("q", "w1 w5")], "slot_id string, query string")
    assert sorted(map(tuple, TI.scores(again, q).collect())) == sorted(map(tuple, R.bm25_scores(docs, q).collect()))
    own = f"file://{tmp_path}/own"
    TI.build_text_index(docs.limit(3), own)
    with pytest.raises(Exception):
        TI.build_text_index(docs.select("id", F.raise_error(F.lit("stop")).cast("string").alias("text")), own)
    assert TI.open_text_index(spark, own).documents.count() == 3, "a build that fails leaves the former index"
    prune(spark, own)
    TI.build_text_index(docs.limit(5), own)
    assert TI.open_text_index(spark, own).documents.count() == 5 and prune(spark, own) == 1
    with pytest.raises(FileNotFoundError):
        TI.open_text_index(spark, f"file://{tmp_path}/nothing")


def test_one_index_for_the_same_files(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame([(1, "a b"), (2, "b c")], "id long, text string").write.parquet(path)
    built = []
    write = TI._write
    monkeypatch.setattr(TI, "_write", lambda *a: (built.append(1), write(*a)))
    for _ in range(2):
        assert TI.text_index(spark.read.parquet(path), "t").documents.count() == 2
    assert len(built) == 1
    spark.createDataFrame([(3, "d")], "id long, text string").write.mode("append").parquet(path)
    assert TI.text_index(spark.read.parquet(path), "t").documents.count() == 3 and len(built) == 2
    TI.text_index(spark.read.parquet(path), None)
    assert len(built) == 3


def test_only_the_partitions_of_asked_terms_are_read(spark, indexed):
    index = indexed[3]
    blocks, _ = TI._own_blocks(index, spark.createDataFrame([("q", "w1", 1.0)], "slot_id string, term string, w double"))
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part", plan)
    assert blocks.select("part").distinct().count() == 1


def test_empty_corpus_and_documents_are_numbered_without_gaps(spark, indexed, tmp_path):
    rows, _, _, index = indexed
    assert sorted(r.pos for r in index.documents.collect()) == list(range(len(rows)))
    none = TI.build_text_index(spark.createDataFrame([], "id long, text string"), f"file://{tmp_path}/none")
    q = spark.createDataFrame([("q", "a")], "slot_id string, query string")
    assert TI.search_blocks(none, q, 3).rows.count() == 0 and TI.scores(none, q).count() == 0


def test_one_pass_for_many_queries_gives_what_joins_give(spark, indexed, monkeypatch):
    """Postings are dealt out once for all queries: tasks pass on their best rows, not a row for each query and document."""
    index = indexed[3]
    rng = random.Random(4)
    asked = [(f"s{i:03}", " ".join(f"w{rng.randint(1, 40)}" for _ in range(6)), [None, [], ["all"], ["d:1", "d:3"]][i % 4]) for i in range(300)]
    queries = spark.createDataFrame(asked, "slot_id string, query string, tags array<string>")
    sent = TI._searched(index, TI._asked(index, queries), queries, 3).filter("pos IS NOT NULL")
    every = TI.scores(index, queries).count()
    assert sent.count() < every / 5
    once = sorted(map(tuple, TI.search_blocks(index, queries, 3).rows.collect()))
    monkeypatch.setattr(TI, "MOST_AT_ONCE", 0)
    assert once == sorted(map(tuple, TI.search_blocks(index, queries, 3).rows.collect())) and len({r[0] for r in once}) == 225


def test_postings_of_ranges_keep_place_count_and_length(spark, tmp_path):
    texts = {i: " ".join(["every"] * (300 if i == 65 else 1) + [f"t{i}"] * (i % 3)) for i in range(130)} | {130: "", 131: None, 132: "?!"}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string").coalesce(1)
    index = TI.build_text_index(docs, f"file://{tmp_path}/places")
    for r in index.blocks.collect():
        assert [m.pos for m in r.members] == sorted(m.pos for m in r.members) and all(m.pos // TI.RANGE == r.range for m in r.members) and r.n == len(r.members)
    want = {(i, t): (t_all.count(t), len(t_all)) for i, text in texts.items() if (t_all := re.findall(r"[a-z0-9]+", text or "")) for t in t_all}
    assert {(r.id, r.term): (r.tf, r.dl) for r in index.postings.collect()} == want
    packed = spark.createDataFrame([(63, 2**28 - 1, 2**28 - 1, 0), (0, 1, 7, 0)], "pos long, dl int, tf int, range long").groupBy("range").agg(F.sort_array(F.collect_list(TI._packed())).alias("members"))
    assert [tuple(m) for m in packed.select(TI._unpacked().alias("m")).first().m] == [(0, 7, 1), (63, 2**28 - 1, 2**28 - 1)]
