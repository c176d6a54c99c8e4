import os

import numpy as np
import pytest
from fathomite.operators import embedding as E, retrieval as R
from hypothesis import given, strategies as st


def model():
    """A model by value: workers do not import tests."""

    def encode(texts):
        return np.array([[t.count(c) + 0.5 for c in "abc"] for t in texts])

    return encode


letters = model()


def by_hand(text, most, overlap):
    words = (text or "").split()
    if not words:
        return [0.0, 0.0, 0.0]
    parts, at = [], 0
    while True:
        parts.append(words[at : at + most])
        if at + most >= len(words):
            break
        at += most - overlap
    v = letters([" ".join(p) for p in parts])
    v = (v / np.linalg.norm(v, axis=1, keepdims=True) * [[len(p)] for p in parts]).sum(0)
    return (v / np.linalg.norm(v)).tolist()


@given(st.lists(st.sampled_from(["a", "bb", "cab"]), max_size=40), st.integers(1, 7), st.data())
def test_windows_cover_all_tokens_in_turn(words, most, data):
    overlap = data.draw(st.integers(0, most - 1))
    text = "  ".join(words)
    parts = [(p.split(), w) for p, w in E.windows(text, most, overlap)]
    assert all(len(p) == w <= most for p, w in parts)
    joined = parts[0][0] if parts else []
    for p, _ in parts[1:]:
        assert p[:overlap] == joined[len(joined) - overlap :]
        joined = joined + p[overlap:]
    assert joined == words and all(len(p) > overlap for p, _ in parts[1:])


def test_vectors_as_by_hand_and_one_load_a_worker(spark, tmp_path):
    log = str(tmp_path)

    own = model()

    def load():
        import os
        import tempfile

        tempfile.mkstemp(prefix=f"{os.getpid()}-", dir=log)
        return own

    texts = ["a b c " * 9, "", None, "aaa", "c  c\n\nc b", "ab " * 5000, "ab " * 5000]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, vector string").repartition(5)
    embed = E.model_embedder("letters-1", load, 3, most=7, overlap=2, batch=4)
    for _ in range(2):
        got = {r.id: r.vector for r in embed(rows, "text").collect()}
        assert all(np.allclose(got[i], by_hand(t, 7, 2)) for i, t in enumerate(texts))
    loads = [f.split("-")[0] for f in os.listdir(log)]
    assert loads and len(loads) == len(set(loads)), "a worker loads a model once, over batches, tasks and jobs"
    assert embed(rows.limit(0), "text").count() == 0


def test_faults_are_told(spark):
    own = model()
    with pytest.raises(ValueError):
        E.model_embedder("m", lambda: own, 3, most=4, overlap=4)
    rows = spark.createDataFrame([(1, "a")], "id long, text string")
    with pytest.raises(Exception, match="gave an array of"):
        E.model_embedder("m4", lambda: own, 4)(rows, "text").collect()


def test_hashed_embedder_sums_signed_terms(spark):
    rows = spark.createDataFrame([(1, "one two two"), (2, "two two one"), (3, ""), (4, None)], "id long, text string")
    got = {r.id: r.vector for r in R.hashed_embedder(16)(rows, "text").collect()}
    assert got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-12
    assert sorted(round(abs(x) * 5**0.5) for x in got[1] if x) in ([1, 2], [1], [3])
