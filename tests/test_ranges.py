import datetime as dt
import random
from collections import defaultdict

import pytest
from fathomite.operators import facts as FA, ranges
from pyspark.sql import functions as F


@pytest.fixture(params=[1, 7])
def parts(spark, request):
    """Few and many ranges, so that groups lie in one and go through several."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows(n, seed=2):
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 6 + ["a", "b", "c", None]), i if rng.random() > 0.02 else None, rng.choice([0, 1, 2, 5, None]), i) for i in rng.sample(range(n), n)]


def test_numbers(spark, parts):
    data = rows(500)
    got = ranges.numbered(spark.createDataFrame(data, "g string, at int, v long, id int"), [F.col("at").asc_nulls_last(), "id"], "n").collect()
    want = sorted(data, key=lambda r: (r[1] is None, r[1] or 0, r[3]))
    assert [tuple(r)[:4] for r in sorted(got, key=lambda r: r.n)] == want and sorted(r.n for r in got) == list(range(1, 501))


def test_running_sums_and_totals(spark, parts):
    data = rows(800, 3)
    d = spark.createDataFrame(data, "g string, at int, v long, id int").withColumn("_own", F.lit("x"))
    got = {r.id: (r.upto, r.total) for r in ranges.running(d.drop("_own"), ["g"], [F.col("at").asc_nulls_first(), "id"], "v", "upto", "total").collect()}
    n = {r.id: r.n for r in ranges.running(d.drop("_own"), ["g"], [F.desc("id")], upto="n").collect()}
    by = defaultdict(list)
    for r in data:
        by[r[0]].append(r)
    for own in by.values():
        total, upto = sum(r[2] or 0 for r in own), 0
        for r in sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, r[3])):
            upto += r[2] or 0
            assert got[r[3]] == (upto, total)
        assert [n[r[3]] for r in sorted(own, key=lambda r: -r[3])] == list(range(1, len(own) + 1))


def test_empty_and_two_column_groups(spark, parts):
    d = spark.createDataFrame([], "g string, at int, v long, id int")
    assert ranges.numbered(d, ["at"]).count() == 0 and ranges.running(d, ["g"], ["at"]).count() == 0
    data = [(k % 2, k % 3, k) for k in range(60)]
    got = ranges.running(spark.createDataFrame(data, "a int, b int, id int"), ["a", "b"], ["id"], upto="n").collect()
    assert all(r.n == r.id // 6 + 1 for r in got)


def test_no_window_holds_a_group(spark):
    plan = ranges.running(spark.createDataFrame(rows(50), "g string, at int, v long, id int"), ["g"], ["id"], upto="n", total="t")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "_sum" not in line]
    assert windows and all("_part" in line for line in windows)


FACTS = "fact_id string, claim string, concept_tag string, period string, value double, assertion_date date"


def first_later(data):
    out = {}
    keyed = lambda r: [("c", r[2].strip().lower())] if r[2] and r[2].strip() else [("p", w) for w in ("operating margin", "free cash flow") if w in r[1].lower()]
    for t in data:
        if t[4] is None or t[5] is None:
            continue
        later = [(c[5], c[0]) for c in data if c[4] is not None and c[5] is not None and c[5] > t[5] and c[4] != t[4] and (c[3] or "") == (t[3] or "") and set(keyed(c)) & set(keyed(t))]
        if later:
            out[t[0]] = min(later)[::-1]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_first_restatements_against_pairs(spark, parts, seed):
    rng = random.Random(seed)
    day = dt.date(2020, 1, 1)
    data = []
    for i in range(300):
        concept = rng.choice(["Hot", " hot ", "hot", "x", None, ""])
        claim = rng.choice(["the operating margin", "free cash flow and operating margin", "nothing"])
        data.append((f"f{i:03}", claim, concept, rng.choice(["FY20", "FY20", None]), rng.choice([1.0, 1.0, 1.0, 2.0, 3.0, None]), rng.choice([None] + [day + dt.timedelta(rng.randint(0, 25)) for _ in range(9)])))
    got = FA.first_restatements(spark.createDataFrame(data, FACTS).withColumn("_d", F.lit(1))).collect()
    assert {r.target_id: (r.evidence_id, r.evidence_date) for r in got} == first_later(data) and len(got) == len({r.target_id for r in got})
    targets = spark.createDataFrame([("f000",), ("f001",), ("f001",)], "fact_id string")
    pairs = FA.restatements(spark.createDataFrame(data, FACTS))
    assert sorted(map(tuple, FA.restatements(spark.createDataFrame(data, FACTS), targets).collect())) == sorted(map(tuple, pairs.filter("target_id IN ('f000', 'f001')").collect()))


def test_a_concept_with_very_many_facts(spark, parts):
    """A value that stays for long and changes once: the sweep hands the change down through all ranges."""
    n = 300_000
    d = spark.range(n).select(F.format_string("f%07d", "id").alias("fact_id"), F.lit("c").alias("claim"), F.lit("hot").alias("concept_tag"), F.lit("FY20").alias("period"), F.when(F.col("id") == n - 1, 2.0).otherwise(1.0).alias("value"), F.date_add(F.lit("1000-01-01").cast("date"), F.col("id").cast("int")).alias("assertion_date"))
    got = FA.first_restatements(d).groupBy("evidence_id").count().collect()
    assert [tuple(r) for r in got] == [(f"f{n - 1:07d}", n - 1)]


def test_first_restatements_shuffles_facts_only_where_it_must(spark, parts, monkeypatch):
    """What is dealt out by ranges is sampled first, so it is a written table; ids that do not repeat are not brought together."""
    seen, in_order = [], FA.ranges.in_order
    monkeypatch.setattr(FA.ranges, "in_order", lambda rows, *a, **b: seen.append(rows._jdf.queryExecution().executedPlan().toString()) or in_order(rows, *a, **b))
    data = [(f"f{i:02}", "", "c", "FY20", float(i % 3), dt.date(2020, 1, 1 + i % 20)) for i in range(60)]
    for facts in (data, [*data, ("f00", "", "c", "FY20", 7.0, dt.date(2019, 1, 1))]):
        found = FA.first_restatements(spark.createDataFrame(facts, FACTS))
        by_id = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate(key" in x and "=[fact_id" in x]
        assert "Exchange" not in seen.pop() and bool(by_id) == (facts is not data)
        want = first_later(data) if facts is data else first_later(data) | {"f00": ("f01", dt.date(2020, 1, 2))}
        got = {r.target_id: (r.evidence_id, r.evidence_date) for r in found.collect()}
        assert set(got) == set(want) and all(got[k] == v for k, v in first_later(data).items() if k != "f00")
