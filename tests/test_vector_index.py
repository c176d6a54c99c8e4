import pickle
import re
import tracemalloc

import numpy as np
import pytest
from fathomite.operators import retrieval as R, tags as TG, vector_index as VI
from pyspark.sql import functions as F

import pyarrow as pa


def clustered(n, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    return centres[rng.integers(0, 40, n)] + 0.4 * rng.normal(size=(n, dim))


def frame(spark, x, tags=None):
    rows = [(i, [float(v) for v in row], tags(i) if tags else None) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id long, vector array<float>, tags array<string>").repartition(4)


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    x = clustered(3000)
    docs = frame(spark, x, lambda i: [f"d:{i % 9}"] + (["p:x"] if i % 50 == 0 else []))
    path = f"file://{tmp_path_factory.mktemp('index')}/vectors"
    VI.build_vector_index(docs, path, sample=1500)
    return x, docs, path


def exact(spark, docs, queries, k):
    scored = R.cosine_scores(docs.withColumn("seq", F.col("id")), queries, k).withColumn("slot_id", F.col("slot_id").cast("long")).withColumn("seq", F.col("id"))
    return {(r.slot_id, r.id): r.score for r in R.top_k(scored, k).collect()}


def files(rows):
    return rows.select(F.input_file_name()).distinct().count()


def test_recall_against_exact_search_after_reopening(spark, indexed):
    x, docs, path = indexed
    index = VI.open_vector_index(spark, path)
    queries = docs.filter("id % 20 = 0").select(F.col("id").alias("slot_id"), "vector")
    found = VI.search(index, queries, 10).collect()
    want = exact(spark, docs.drop("tags"), queries, 10)
    got = {(r.slot_id, r.id): r.score for r in found}
    assert len(set(got) & set(want)) >= 0.9 * len(want) == 0.9 * 1500
    assert all(abs(got[key] - want[key]) < 2e-6 for key in set(got) & set(want))
    assert index.quantiser.probes < len(index.quantiser.centres) / 2, "clustered vectors need few cells"
    ranks = {}
    for r in found:
        ranks.setdefault(r.slot_id, []).append((r.rank, -r.score, r.seq))
    assert all([a[0] for a in sorted(own)] == list(range(1, 11)) and [a[1:] for a in sorted(own)] == sorted(a[1:] for a in own) for own in ranks.values())


def test_only_probed_cells_are_read(spark, indexed):
    index = VI.open_vector_index(spark, indexed[2])
    one = indexed[1].filter("id = 40").select(F.col("id").alias("slot_id"), "vector")
    plan = VI.search(index, one, 5, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan)
    cells = VI.probed(index, VI._matrix(one.toArrow()["vector"]), [None], 5, 2)[0]
    read = index.rows.filter(F.col("cell").isin([int(c) for c in cells]))
    assert len(cells) == 2 and files(read) == 2 < files(index.rows) and read.count() < 1000
    assert VI.search(index, one, 1, probes=1).first().id == 40


def test_filters_inside(spark, indexed):
    x, docs, path = indexed
    index = VI.open_vector_index(spark, path)
    asked = [(0, ["d:3", "d:4"]), (20, ["p:x"]), (40, []), (60, ["d:77"]), (80, None)]
    own = spark.createDataFrame(asked, "slot_id long, tags array<string>").join(docs.select(F.col("id").alias("slot_id"), "vector"), "slot_id")
    got = {}
    for r in VI.search(index, own, 8).collect():
        got.setdefault(r.slot_id, set()).add(r.id)
    want = exact(spark, docs, own, 8)
    assert set(got) == {0, 20, 80} == {s for s, _ in want}
    assert all(i % 9 in (3, 4) for i in got[0]) and all(i % 50 == 0 for i in got[20]) and all(len(v) == 8 for v in got.values())
    assert sum(len(got[s] & {i for t, i in want if t == s}) for s in got) >= 0.9 * 24


def test_edges(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0]), (4, [0.0, 2.0])]
    docs = spark.createDataFrame(rows, "id long, vector array<float>").withColumn("cell", F.lit("clash"))
    index = VI.build_vector_index(docs, f"file://{tmp_path}/few")
    q = spark.createDataFrame([("a", [2.0, 0.0]), ("b", None), ("c", [0.0, 0.0])], "slot_id string, vector array<double>")
    got = {(r.slot_id, r.rank): (r.id, r.score) for r in VI.search(index, q, 2, probes=9).collect()}
    assert got == {("a", 1): (1, 1.0), ("a", 2): (4, 1.0), ("c", 1): (1, 0.0), ("c", 2): (2, 0.0)}
    assert VI.search(index, q.limit(0), 2).count() == 0
    none = VI.build_vector_index(docs.limit(0), f"file://{tmp_path}/none")
    assert VI.search(none, q, 2).count() == 0
    with pytest.raises(ValueError):
        VI.build_vector_index(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, vector array<float>"), f"file://{tmp_path}/mixed")
    with pytest.raises(FileNotFoundError):
        VI.open_vector_index(spark, f"file://{tmp_path}/mixed")


def test_a_cell_with_most_rows_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(VI, "CELL_ROWS", 100)
    x = np.concatenate([np.tile([[1.0, 0.0, 0.0]], (900, 1)), clustered(300, 3, 5)])
    index = VI.build_vector_index(frame(spark, x), f"file://{tmp_path}/copies", sample=400)
    hot = index.rows.groupBy("cell").count().orderBy(F.desc("count")).first()
    assert hot["count"] >= 900 and files(index.rows.filter(F.col("cell") == hot["cell"])) >= 3
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "slot_id long, vector array<double>")
    assert [r.score for r in VI.search(index, q, 5).collect()] == [1.0] * 5


def test_codes_approximate_the_cosine():
    x = VI._units(clustered(2000).astype(np.float32))
    quantiser = VI.fit(x[:1000], 2000)
    cell, codes = quantiser.encode(x)
    own = cell == np.bincount(cell).argmax()
    error = quantiser.scores(x[:50], int(cell[own][0]), codes[own]) - x[:50] @ x[own].T
    assert np.abs(error).mean() < 0.03


def test_cosine_scores_with_nulls_and_lengths(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id long, vector array<double>")
    ask = lambda *q: spark.createDataFrame(list(q), "slot_id string, vector array<double>")
    assert [tuple(r) for r in R.cosine_scores(vectors, ask(("a", None), ("b", [1.0, 1.0]))).collect()] == [("b", 1, 0.707107)]
    with pytest.raises(Exception, match="length"):
        R.cosine_scores(vectors, ask(("a", [1.0, 0.0, 0.0]))).collect()
    with pytest.raises(ValueError, match="length"):
        R.cosine_scores(vectors, ask(("a", [1.0]), ("b", [1.0, 1.0])))


def test_tags(spark):

    got = TG.fits(pa.array([["a"], [], [], ["b", "c"], ["c", "a"]], pa.list_(pa.string())), [None, {"a"}, {"c", "z"}, set()])
    assert got.tolist() == [[True] * 5, [True, False, False, False, True], [False, False, False, True, True], [False] * 5]
    d = spark.createDataFrame([("2022Q3", "nflx-10k-2022", "FY2022"), (None, None, None)], "period string, doc string, wanted string")
    own = d.select(TG.row_tags(F.col("period"), F.col("doc"), "fact").alias("f"), TG.row_tags(F.col("period"), F.col("doc"), "chunk").alias("c"), TG.slot_tags(F.col("wanted"), "fact").alias("sf"), TG.slot_tags(F.col("wanted"), "chunk").alias("sc")).collect()
    assert (own[0].f, own[0].c) == (["d:nflx-10k-2022", "p:2022Q3"], ["d:nflx-10k-2022"])
    assert (set(own[0].sf), own[0].sc) == ({"d:nflx-10k-2022", "p:FY2022", "p:2022-12-31"}, ["d:nflx-10k-2022"])
    assert (own[1].f, own[1].sf, own[1].sc) == ([], None, None)


def test_what_a_worker_holds_does_not_grow_with_cells_and_probes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, centres = rng.normal(size=(10_000, 8)).astype(np.float32), rng.normal(size=(1600, 8)).astype(np.float32)
    tracemalloc.start()
    near = VI._nearest(x, centres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6, "a matrix of all rows and cells would be 64 MB"
    assert np.array_equal(near[:50], ((x[:50, None] - centres) ** 2).sum(2).argmin(1))
    probing = [rng.permutation(1600)[:900] for _ in range(4096)] + [np.array([], np.int64)]
    cells, starts, owner = VI._askers(probing)
    assert len(pickle.dumps((cells, starts, owner))) < 8e6 and starts[-1] == len(owner) == 4096 * 900
    at = int(np.searchsorted(cells, 7))
    assert owner[starts[at] : starts[at + 1]].tolist() == [i for i, own in enumerate(probing) if 7 in own]
    # Matrices of few rows: each passes on only what may still be among the best.
    monkeypatch.setattr(R, "SCORES", 2 * 40)
    v = np.round(rng.normal(size=(400, 3)), 1)
    docs = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, vector array<double>").coalesce(1)
    q = docs.filter("id < 2").select(F.col("id").alias("slot_id"), "vector")
    every, most = R.cosine_scores(docs, q), R.cosine_scores(docs, q, 3)
    best = lambda d: [tuple(r) for r in R.top_k(d.withColumn("seq", F.col("id")), 3).orderBy("slot_id", "rank").collect()]
    assert best(most) == best(every) and most.count() < 40, "three of every forty rows would be 60"
