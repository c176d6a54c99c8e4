import random
import zlib

import numpy as np
import pytest
from fathomite.llm import lang_cnn as op

VOICES = {"aa": "the of and house tree", "bb": "ñandú él año qué más", "cc": "über straße für schön"}


def make(n=240):
    rng = random.Random(10)
    return [(i, lang := sorted(VOICES)[i % 3], " ".join(rng.choices(VOICES[lang].split(), k=rng.randint(4, 200)))) for i in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, 0.5) for i, lang, t in make()], "doc_id long, text string, lang string, score double")


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 253, 254, 255, 256, 257, 509, 510, 5000])
def test_windows_hold_every_filter_position(n):
    text = "".join(random.Random(n).choices("abcdefgh", k=n))
    rows, weights = op.windows_of(text)
    assert rows.shape[1] == op.WINDOW and len(rows) == len(weights) and (weights >= 1).all()
    grams = {text[i : i + op.WIDEST] for i in range(n - op.WIDEST + 1)}
    seen = {bytes(r[i : i + op.WIDEST].astype(np.uint8)).decode() for r in rows for i in range(op.WINDOW - op.WIDEST + 1) if (r[i : i + op.WIDEST] < op.PAD).all()}
    assert seen == grams


def test_responses_match_a_plain_convolution():
    net = op.Network(["x", "y"])
    rows, _ = op.windows_of("hello wörld")
    _, got = net._responses(rows)
    e = net.p["embedding"][rows[0]]
    for f, width in ((0, 2), (op.PER_WIDTH, 3), (2 * op.PER_WIDTH, 4)):
        w = net.p["filters"][: width * op.DIM, f]
        want = [float(e[i : i + width].reshape(-1) @ w) for i in range(op.WINDOW - op.WIDEST + 1)]
        assert np.allclose(got[0, :, f], want, atol=1e-4)


def test_gradients_match_differences():
    net = op.Network(["x", "y", "z"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows = np.concatenate([op.windows_of(t)[0] for t in ("the cat", "él año", "für über", "a b c d e")])
    truth = np.array([0, 1, 2, 0])
    _, g = net.gradients(rows, truth)
    for name, at in (("dense", (3, 1)), ("bias", (2,)), ("offset", (20,)), ("filters", (5, 20)), ("embedding", (ord("a"), 2))):
        step = 1e-5
        net.p[name][at] += step
        up = net.gradients(rows, truth)[0]
        net.p[name][at] -= 2 * step
        down = net.gradients(rows, truth)[0]
        net.p[name][at] += step
        assert g[name][at] == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=1e-5)


def test_held_out_documents(docs):
    got = {r.doc_id: r for r in op.languages(docs).collect()}
    truth = {i: lang for i, lang, _ in make()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i in got if got[i].held_out]
    assert sum(got[i].lang_pred == truth[i] for i in held) / len(held) > 0.95


def test_held_out_labels_change_nothing(docs):
    other = docs.withColumn("lang", op.F.when(op.fold(op.F.col("doc_id"), 4) == 2, "zz").otherwise(op.F.col("lang")))
    a, b = op.train(docs), op.train(other)
    assert a.languages == b.languages == sorted(VOICES) and all((a.p[k] == b.p[k]).all() for k in a.p)


def test_nulls_repeats_and_empty_tables(spark, docs):
    odd = spark.createDataFrame([(None, "the tree", "aa"), (1, None, None), (1, None, None), (2, "", "aa"), (3, "12 34 !!", "bb"), (4, "ñ", None)], "doc_id long, text string, lang string")
    net = op.train(docs)
    got = {r.doc_id: r for r in op.identify(odd, net).collect()}
    assert op.identify(odd, net).count() == 6
    assert {i: got[i].lang_pred for i in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"} and got[4].lang_pred in VOICES and got[None].lang_pred in VOICES
    assert op.languages(odd.limit(0)).count() == 0
    assert {r.lang_pred for r in op.languages(odd.withColumn("lang", op.F.lit(None).cast("string"))).collect()} == {"und"}


def test_letters_by_category():
    import unicodedata

    for c in map(chr, range(0x3000)):
        if unicodedata.category(c) != "Cn":  # two libraries may know different versions of Unicode
            assert bool(op.LETTER.search(c)) == (unicodedata.category(c)[0] == "L")
    network = op.Network(["x", "y"])
    assert network.predict(["² ½ ①", "12 _ !", None, "", "é"]) [:4] == [(op.UNKNOWN, 0.0)] * 4


def test_predict_by_brute_force():
    network = op.Network(["x", "y", "z"])
    texts = ["short", "é" * 300, "a longer text with Capitals " * 50, "ab" * 2000]
    for text, (lang, score) in zip(texts, network.predict(texts), strict=True):
        data = text.lower().encode()
        step, total, weight = op.WINDOW - op.WIDEST + 1, np.zeros(3), 0.0
        starts = range(0, max(1, len(data) - op.WIDEST + 1), step)
        for at in starts:
            own = list(data[at : at + op.WINDOW]) + [op.PAD] * max(0, op.WINDOW - len(data[at : at + op.WINDOW]))
            top = np.full(op.FILTERS, -np.inf)
            for i in range(op.WINDOW - op.WIDEST + 1):
                patch = network.p["embedding"][own[i : i + op.WIDEST]].reshape(-1)
                top = np.maximum(top, patch @ network.p["filters"])
            logits = np.maximum(top + network.p["offset"], 0) @ network.p["dense"] + network.p["bias"]
            p = np.exp(logits - logits.max())
            w = max(1, min(len(data) - at, step))
            total += p / p.sum() * w
            weight += w
        assert lang == network.languages[int(total.argmax())] and score == pytest.approx(total.max() / weight, abs=1e-4)
