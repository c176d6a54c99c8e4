import random
import zlib

import pytest
from fathomite.llm import toxicity_zdict as op


def make(n=700):
    rng = random.Random(3)
    syllables = "ta re mi so ful den gor ka li ve".split()
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(30, 120))]
        if i % 4 == 0:
            for at in rng.sample(range(len(words)), 5):
                words[at] = rng.choice(["Blockhead", "numbskull", "nincompoop"])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = make()
    docs = spark.createDataFrame([(i, t, "x", "?") for i, t, _ in rows], "doc_id long, text string, source string, score string")
    return docs, spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")


def test_windows_cover_the_text_and_copies_are_left_out():
    for n in (0, 1, 19, 20, 21, 39, 40, 41, 60, 61, 400):
        text = bytes(range(97, 123)) * 20
        assert len(op.distances(text[:n], b"", b"")) == max(1, -(-(n - 20) // 20))
    long = op.prepared(" ".join(f"word{i}" for i in range(200)))
    assert op.novel([op.sketch_of(t) for t in (long, long, long + b"x ", b"other", b"", b" ")]) == [0, 3, 4, 5]


def test_distances_by_plain_zstandard():
    rng = random.Random(6)
    ordinary, toxic = b" and so on it went " * 20, b" blockhead numbskull " * 5
    text = op.prepared(" ".join(rng.choices("and so on it went blockhead numbskull round".split(), k=300)))

    def size(content, window):
        own = op.zstandard.ZstdCompressionDict(content, dict_type=op.zstandard.DICT_TYPE_RAWCONTENT)
        return len(op.zstandard.ZstdCompressor(level=op.LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False).compress(window))

    windows = [text[i : i + op.WINDOW] for i in range(0, len(text), op.STEP) if i == 0 or i + op.WINDOW - op.STEP < len(text)]
    want = [size(ordinary, w) - size(toxic + ordinary, w) for w in windows]
    assert op.distances(text, ordinary, toxic).tolist() == want
    best = sorted(want, reverse=True)
    expected = [*(min(b, 12) for b in best[:3]), max(sum(want), 0) / len(want), sum(w >= op.FAR for w in want) / len(want)]
    got = op.figures(op.distances(text, ordinary, toxic))
    assert [*got[:3], got[3] ** 2, got[4] ** 2] == pytest.approx(expected)


def test_runs_by_brute_force():
    rng = random.Random(8)
    for _ in range(50):
        text = bytes(rng.choices(b"abc", k=rng.randint(0, 60)))
        lead = frozenset(g for g in op.grams_of(text) if rng.random() < 0.5)
        inside = [any(text[j : j + op.GRAM] in lead for j in [i]) for i in range(max(0, len(text) - op.GRAM + 1))]
        want, i = set(), 0
        for flag, size in ((f, len(list(g))) for f, g in __import__("itertools").groupby(inside)):
            if flag:
                want.add(text[i : i + size - 1 + op.GRAM])
            i += size
        assert op.runs_of(text, lead) == sorted(want)


def test_toxic_windows_are_closer(tables):
    model = op.train(*tables)
    far = op.distances(op.prepared("tare mi blockhead soful"), model.ordinary, model.toxic).max()
    assert far >= op.FAR > op.distances(op.prepared("tare mi gorka li soful"), model.ordinary, model.toxic).max()


def test_held_out_rows(tables):
    docs, labels = tables
    truth = {i: y for i, _, y in make()}
    got = {r.doc_id: r for r in op.toxicity(docs, labels).collect()}
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [i for i in got if got[i].held_out]
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.95
    flipped = labels.withColumn("toxic", op.F.when(op.fold(op.F.col("doc_id"), 5) == 0, 1 - op.F.col("toxic")).otherwise(op.F.col("toxic")))
    assert {r.doc_id: r.score for r in op.toxicity(docs, flipped).collect()} == {i: r.score for i, r in got.items()}


def test_a_toxic_passage_deep_in_a_long_text_counts(tables):
    docs, labels = tables
    model = op.train(docs, labels)
    rng = random.Random(4)
    long = " ".join("".join(rng.choices("ta re mi so ful den gor ka li ve".split(), k=3)) for _ in range(3000))
    assert model.score(long + " you blockhead you numbskull you nincompoop you blockhead numbskull") > model.score(long)


def test_nulls_repeats_and_empty_tables(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(None, "a b"), (1, None), (1, None), (2, "")], "doc_id long, text string")
    got = op.score(odd, op.train(docs, labels)).collect()
    assert len(got) == 4 and all(0 <= r.score < 0.5 for r in got)
    assert op.toxicity(odd.limit(0), labels).count() == 0
    assert {r.score for r in op.toxicity(odd, labels.limit(0)).collect()} == {0.0}


def test_an_id_with_two_labels_and_two_texts_is_learned_from_once(spark, tables):
    docs, labels = tables
    model = op.train(docs, labels)
    rows = labels.unionByName(labels.withColumn("toxic", op.F.lit(1)).filter("toxic = 0"))
    again = op.train(docs.unionByName(docs).repartition(5), rows.unionByName(rows).repartition(3))
    assert (model.ordinary, model.toxic, model.weights.tolist()) == (again.ordinary, again.toxic, again.weights.tolist())
