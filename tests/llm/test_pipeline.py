from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from fathomite.llm import mixing, quality_ftrl, quality_rules
from fathomite.llm.common import materialize
from test_near_dedup import brute_groups
from test_op09_bpe_bitmap import library, ranks  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(materialize(stage(spark, docs[-1], SF), name))
    return docs


def test_columns(steps):
    assert all(d.columns == steps[0].columns for d in steps[:-1])
    assert len(corpus_pipeline.STAGES) == 5


def test_rules(steps):
    kept = {r.doc_id for r in quality_rules.quality_rules(steps[0]).filter("kept").collect()}
    assert {r.doc_id for r in steps[1].collect()} == kept and 0 < len(kept) < steps[0].count()
    assert sorted(steps[1].collect()) == sorted(r for r in steps[0].collect() if r.doc_id in kept)


def test_classifier(spark, steps):
    weights, bias = quality_ftrl.train(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    want = [r for r in steps[1].collect() if quality_ftrl.sigmoid(bias + weights[at := quality_ftrl.features(r.text)].sum() / max(1, len(at)) ** 0.5) >= 0.3]
    assert sorted(steps[2].collect()) == sorted(want)


def test_near_duplicates(steps):
    rows = steps[2].collect()
    groups = brute_groups([(r.doc_id, r.text) for r in rows])
    keep = {min(r.doc_id for r, g in zip(rows, groups, strict=True) if g == own) for own in groups}
    assert sorted(steps[3].collect()) == sorted(r for r in rows if r.doc_id in keep)


def test_mixing(steps):
    words = Counter()
    for r in steps[4].collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert words == Counter({r.doc_id: r.taken for r in mixing.mix(steps[3]).collect() if r.taken})


def test_encoding(steps, library):  # noqa: F811
    made = Counter((r.doc_id, tuple(r.ids)) for r in steps[5].collect())
    assert made == Counter((r.doc_id, tuple(library.encode_ordinary(r.text))) for r in steps[4].collect())


def test_run_repeats_the_stages(spark, steps):
    assert Counter(map(str, corpus_pipeline.run(spark, SF).collect())) == Counter(map(str, steps[5].collect()))
    assert public_tokenizers.path(corpus_pipeline.RANKS)
