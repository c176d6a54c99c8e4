import hashlib
import random
import re

import pytest

from fathomite.llm import fill_middle as op


def brute(i, text, unit=r"(?s:.)"):
    units = re.findall(f"{unit}|(?s:.)", text or "")
    text, n = text or "", len(units)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(5)
    parts = ["a", "Zeile\n", "é", "漢", "😀", "<", "P>", "<S", ">", "<P>", " ", "\x00", "é", "\r\n"]
    weights = [9, 3, 3, 3, 3, 3, 1, 1, 3, 0.1, 5, 1, 1, 1]
    out = [None, "", "x", "<M>", "<<P><S", "😀" * 5000, "long text " * 60_000]
    return out + ["".join(rng.choices(parts, weights, k=rng.choice([1, 2, 5, 40, 3000]))) for _ in range(400)]


def test_matches_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, "no id"), (3, "<M>"), (3, "<M>"), (-4, "below zero")]
    docs = spark.createDataFrame([(i, t, "f", 0) for i, t in rows], "doc_id long, text string, form string, n int")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, *b[:4], sha(b[4]), sha(t or "")) for i, t in rows for b in [brute(i, t)]]
    got = op.digests(docs)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", [r"\s*\S+", r"[a-z]{1,3}", r"\d+"])
def test_other_units(spark, unit):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = {r.doc_id: r for r in op.fill_in_middle(docs, unit).collect()}
    for i, t in rows:
        r = own[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(i, t, unit)


def test_matcher_passes_units_by_strides():
    for stride in (1, 2, 7, 1024):
        m = op.Matcher(r"a+?b?|aa", stride)
        for text in ("", "aab" * 5000, "a" * 3001, "xx", "b"):
            ends = [f.end() for f in re.finditer(r"a+?b?|aa|(?s:.)", text)]
            assert m.count(text) == len(ends)
            for k in {0, 1, len(ends) // 2, len(ends)} & set(range(len(ends) + 1)):
                assert m.advance(text, 0, k) == (ends[k - 1] if k else 0)
    with pytest.raises(ValueError):
        op.Matcher("a*")


def test_no_cut_and_all_cut_and_empty(spark):
    docs = spark.createDataFrame([(i, "some text") for i in range(50)], "doc_id long, text string")
    assert {r.form for r in op.fill_in_middle(docs, moved=0).collect()} == {"plain"}
    assert {r.form for r in op.fill_in_middle(docs, moved=100, suffix_first=100).collect()} == {"spm"}
    assert op.digests(docs.limit(0)).count() == 0
    assert [tuple(r) for r in op.digests(docs).collect()] == [tuple(r) for r in op.digests(docs.repartition(3)).orderBy("doc_id").collect()]
