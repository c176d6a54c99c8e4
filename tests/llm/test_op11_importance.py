import hashlib
import math
import random
import re
import zlib
from collections import Counter

from fathomite.llm import importance as op

SMALL = str.maketrans(op.UPPER, op.LOWER)


def features(text, orders, buckets):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(SMALL))
    runs = [" ".join(words[i : i + k]) for k in range(1, orders + 1) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def brute(rows, target, orders=2, buckets=10_000, share=25, least=20, seed="7"):
    own = [(i, t or "", *features(t, orders, buckets)) for i, t in rows]
    s, t = Counter(b for r in own for b in r[3]), Counter(b for x in target for b in features(x, orders, buckets)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for i, text, n, found in own:
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(found), weight, score, n))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    made = [(*r[:4], None) for r in out if r[4] < least]
    for k, r in enumerate(able):
        made.append((*r[:4], k + 1 if k < share * len(able) // 100 else None))
    return made


def as_sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def corpus(n, seed=3):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "ÉTÉ", "été", "x1", "77", "naïve", "İst", "漢字", "o", "the"]
    seps = [" ", " ", "-", "\n", "_", ", ", "'", "\x00", "\x7f", "\t"]
    return ["".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_matches_brute_force(spark):
    texts = corpus(300)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[5]), (None, "only a few words"), (7, texts[8]), (7, texts[7]), (9, texts[9]), (9, texts[9])]
    rows += [(400, None), (401, ""), (402, " \n-_"), (403, "one"), (404, "two words"), (405, "w " * 30_000)]
    target = ["alpha beta gamma x1 77", "the o the o", None, "", "été 漢字"]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, bucket string, n int")
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    got = op.resample(docs, aims)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {f.dataType.simpleString() for f in got.schema.fields} == {"bigint"}
    assert as_sorted(map(tuple, got.collect())) == as_sorted(brute(rows, target))


def test_other_orders_and_few_buckets(spark):
    rows = list(enumerate(corpus(80, 4)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    aims = spark.createDataFrame([("alpha beta gamma alpha",)], "text string")
    for orders, buckets in ((1, 7), (3, 50)):
        got = op.resample(docs, aims, orders, buckets, share=60, least_words=3, seed="q").collect()
        assert as_sorted(map(tuple, got)) == as_sorted(brute(rows, ["alpha beta gamma alpha"], orders, buckets, 60, 3, "q"))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    assert op.resample(docs.limit(0), none).count() == 0
    assert as_sorted(map(tuple, op.resample(docs, none).collect())) == as_sorted(brute([(1, "a b c " * 10)], []))


def test_plan_shuffles_the_texts_once(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = op.position_ngrams(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Window" in plan
