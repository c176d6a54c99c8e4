import random
import re
from collections import Counter

from fathomite.llm import quality_rules as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    repeat = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeat),
        "base_failed": n < 20 or 100 * len(repeat) > 30 * n,
    }


def test_figures_match_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x\ny\nx\n\n \nx", "| # é b\x0bc\x0cd\re", "e " * 500]
    for _ in range(120):
        words = rng.choices(["the", "a", "Ab", "###", "b|", "é漢"], k=rng.randint(1, 60))
        texts.append("".join(w + rng.choice([" ", " ", "\n", "\t", "  "]) for w in words))
    for _ in range(20):
        part = " ".join(rng.choices("abcdefghij", k=rng.randint(5, 30)))
        texts.append(" ".join([part, " ".join(rng.choices("abcdefghij", k=40)), part, "z", part[: len(part) // 2]]))
    docs = spark.createDataFrame([(i, t, "?") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    for r in op.quality_rules(docs).collect():
        want = brute(texts[r.doc_id])
        assert {k: r[k] for k in want} == want, texts[r.doc_id]
        if r.base_failed:
            assert not r.kept


def test_rules_hold_on_their_bounds(spark):
    good = "the cat of the house sat on a mat and it was not that bad for a day in the sun\n" * 1 + "she had gone to town with some friends of hers"
    docs = spark.createDataFrame([(1, good), (1, good), (None, good.upper().replace(" ", "!! ")), (3, good.replace(" ", "### "))], "doc_id long, text string")
    got = {(r.doc_id, r.kept, tuple(r.failed)) for r in op.quality_rules(docs).collect()}
    assert got == {(1, True, ()), (None, False, ("bang_words",)), (3, False, ("symbol_ratio",))}
    assert [tuple(r) for r in op.keep_good(docs).collect()] == [(1, good), (1, good)]
    assert op.quality_rules(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = op.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
