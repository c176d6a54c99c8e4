import random
import zlib

import numpy as np
import pytest
from fathomite.llm import quality_ftrl as op

WORDS = "the cat sat on a mat and saw that it was good for them to be there".split()


def make(n=600):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        words = rng.choices(WORDS, k=rng.randint(20, 60))
        rows.append((i, " ".join(w + rng.choice(["###", "***"]) if bad and rng.random() < 0.6 else w for w in words), 0 if bad else 1))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = make()
    docs = spark.createDataFrame([(i, t, "x", 0.0) for i, t, _ in rows], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def test_features():
    assert len(op.features(None)) == len(op.features(" \n")) == 0
    assert op.features("a b").tolist() == sorted(set(op.features("a b").tolist()))
    assert set(op.features("x x")) & set(op.features("y y")), "a repeated word has a feature of its own"


def test_margin_is_the_dot_product_over_a_dense_vector():
    w = np.random.default_rng(1).normal(size=1 << op.BITS).astype(np.float32)
    at = op.features("one two three ### two")
    dense = np.zeros(1 << op.BITS)
    dense[at] = 1
    assert op.margin(w, 0.5, at) == pytest.approx(0.5 + w @ dense / np.linalg.norm(dense), rel=1e-5)


def test_held_out_rows(spark, tables):
    docs, labels = tables
    got = {r.doc_id: r for r in op.quality(docs, labels).collect()}
    truth = {i: y for i, _, y in make()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [i for i in got if got[i].held_out]
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.95
    assert {r.doc_id for r in op.keep_good(docs, labels).collect()} == {i for i in got if got[i].predicted}
    assert op.keep_good(docs, labels).columns == docs.columns


def test_held_out_labels_change_nothing(spark, tables):
    docs, labels = tables
    flipped = labels.withColumn("quality", op.F.when(op.fold(op.F.col("doc_id"), 5) == 0, 1 - op.F.col("quality")).otherwise(op.F.col("quality")))
    a, b = op.train(docs, labels), op.train(docs.withColumn("lang", op.F.lit("zz")), flipped)
    assert (a[0] == b[0]).all() and a[1] == b[1]


def test_nulls_repeats_and_empty_tables(spark, tables):
    _, labels = tables
    odd = spark.createDataFrame([(None, "a b"), (1, None), (1, None), (2, "")], "doc_id long, text string")
    got = op.quality(odd, labels).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got) and {r.held_out for r in got if r.doc_id is None} == {None}
    assert op.quality(odd.limit(0), labels).count() == 0
    assert {r.score for r in op.quality(odd, labels.limit(0)).collect()} == {0.5}
