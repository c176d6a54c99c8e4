import math

from fathomite.operators import retrieval as R
from fathomite.plans import engine
from pyspark.sql import functions as F


def okapi(texts, query):
    docs = [t.lower().split() for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    terms = {t for d in docs for t in d}
    df = {t: sum(t in d for d in docs) for t in terms}
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: r if r >= 0 else 0.25 * mean for t, r in raw.items()}
    return [round(sum(idf[q] * d.count(q) * 2.5 / (d.count(q) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for q in query.lower().split() if q in idf), 6) for d in docs]


def test_bm25_matches_the_formula(spark):
    texts = ["a b c a", "a d", "a e f g h", "z z", "a d"]
    corpus = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id int, seq int, text string")
    got = {r.id: r.score for r in R.bm25_scores(corpus, spark.createDataFrame([("q", "a d D z none")], "slot_id string, query string")).collect()}
    want = okapi(texts, "a d d z none")
    assert all(math.isclose(got.get(i, 0), w, abs_tol=2e-6) for i, w in enumerate(want))
    top = R.top_k(spark.createDataFrame([("q", i, s, i) for i, s in got.items()], "slot_id string, id int, score double, seq int"), 3).orderBy("rank").collect()
    assert [r.id for r in top] == sorted(got, key=lambda i: (-got[i], i))[:3]


def ranked(spark, *ids):
    return spark.createDataFrame([("s", i, n, 1.0) for n, i in enumerate(ids, 1)], "slot_id string, id string, rank int, score double")


def test_fusion(spark):
    rows = R.fuse(ranked(spark, "a", "b", "c"), ranked(spark, "b", "d"), 10).orderBy("fused_rank").collect()
    assert [r.id for r in rows] == ["b", "a", "d", "c"]
    assert rows[0].rrf_score == round(1 / 62 + 1 / 61, 6) and rows[1].rrf_score == round(1 / 61, 6)
    assert [r.id for r in R.fuse(ranked(spark, "a"), ranked(spark, "z").limit(0), 5).collect()] == ["a"]
    assert [r.id for r in R.fuse(ranked(spark, "a"), ranked(spark, "b"), 5).orderBy("fused_rank").collect()] == ["a", "b"]
    left = R.exclude(ranked(spark, "a", "b", "c"), spark.createDataFrame([("s", "a"), ("t", "b")], "slot_id string, id string"))
    assert [(r.id, r.rank) for r in left.orderBy("rank").collect()] == [("b", 1), ("c", 2)]


def corpus(spark):
    rows = [
        ("f1", 1, "fact", "revenue grew", [1.0, 0.0], "2024Q3", "nflx-10q-2024-q3", "us-gaap:Revenues", 5.0),
        ("f2", 2, "fact", "revenue fell in the year", [0.9, 0.1], "FY2022", "nflx-10q-2024-q3", "us-gaap:Revenues", 6.0),
        ("f3", 3, "fact", "costs", [0.0, 1.0], None, "nflx-10q-2024-q3", None, None),
        ("c1", 4, "chunk", "revenue revenue revenue", [1.0, 0.05], None, "nflx-10q-2024-q3", None, None),
        ("c2", 5, "chunk", "weather", [0.5, 0.5], None, "nflx-10k-2020", None, None),
    ]
    return spark.createDataFrame(rows, "id string, seq int, layer string, text string, vector array<double>, period string, source_document string, concept_tag string, value double")


def test_retrieve_filters_before_and_after_top_k(spark):
    slots = spark.createDataFrame([("s", "revenue", "2024Q3"), ("t", "revenue", None)], "slot_id string, query string, period_filter string")
    vectors = spark.createDataFrame([("s", [1.0, 0.0]), ("t", [1.0, 0.0])], "slot_id string, vector array<double>")
    rows = R.retrieve(corpus(spark), slots, vectors).collect()
    s = [r.id for r in sorted(rows, key=lambda r: r.fused_rank) if r.slot_id == "s"]
    assert s[0] == "f1" and set(s) == {"f1", "f3", "c1"}, "f2 takes a place through its document and is dropped after; c2 is of another year"
    t = [r.id for r in sorted(rows, key=lambda r: r.fused_rank) if r.slot_id == "t"]
    assert set(t) == {"f1", "f2", "f3", "c1", "c2"} and t.index("f1") < t.index("c1"), "facts come before chunks"


def test_engine_runs_the_same_twice(spark):
    questions = spark.createDataFrame([(1, "What was the revenue in the year?"), (2, "What is the zebra of the moon like?"), (3, "")], "run_id long, query string")
    data = corpus(spark).withColumn("id", F.col("seq").cast("long"))
    vectors = spark.createDataFrame([("1::s1", [1.0, 0.0]), ("2::s1", [0.0, 1.0])], "slot_id string, vector array<double>")
    traces = [engine.run(data, questions, vectors).orderBy("run_id").collect() for _ in range(2)]
    assert traces[0] == traces[1] and [r.run_id for r in traces[0]] == [1, 2, 3]
    assert traces[0][1].level == "CLARIFICATION_REQUEST" or traces[0][1].exhausted == 1
    assert "iter 1" in engine.render_markdown(traces[0][0])


def test_refutation(spark):
    import datetime as dt

    facts = spark.createDataFrame(
        [("a", "c", "X", "d", "x", "financial_metric", "FY2023", 1.0, "k", dt.date(2024, 1, 1), 0.9), ("b", "c", "X", "d", "x", "financial_metric", "FY2023", 2.0, "k", dt.date(2024, 5, 1), 0.9), ("w", "c", "unknown", "d", "x", "financial_metric", "FY2023", 3.0, "k", dt.date(2024, 6, 1), 0.9)],
        "fact_id string, claim string, asserter string, source_document string, verbatim_anchor string, fact_type string, period string, value double, concept_tag string, assertion_date date, confidence double",
    )
    verified = facts.select(F.lit("r").alias("run_id"), "fact_id")
    got = {r.fact_id: (r.refutation_verdict, r.evidence) for r in engine.refute(facts, verified).collect()}
    assert got == {"a": ("strongly_refuted", ["b", "w"]), "b": ("weakly_refuted", ["w"]), "w": ("unrefuted", [])}
