import glob
from collections import Counter
from html.parser import HTMLParser

from fathomite.plans import catalog_records, engine, pages, views
from pyspark.sql import functions as F


class Reader(HTMLParser):
    def __init__(self):
        super().__init__()
        self.open, self.texts, self.bars = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.bars += tag == "rect"
        if tag not in ("meta", "br"):
            self.open.append(tag)

    def handle_endtag(self, tag):
        assert self.open.pop() == tag

    def handle_data(self, data):
        self.texts.append(data)


def read(html):
    r = Reader()
    r.feed(html)
    assert not r.open
    return r


def example(spark, n=1):
    slots = spark.range(n).select(F.col("id").alias("run_id"), F.concat(F.col("id").cast("string"), F.lit("::s1")).alias("slot_id"), F.lit("Is 1 < 2 & \"so\"?").alias("query"))
    said = "array(named_struct('iteration', 1, 'coverage', 0.4D, 'verdict', 'gap', 'gap_description', 'nothing <yet>'), named_struct('iteration', 2, 'coverage', 0.9D, 'verdict', 'covered', 'gap_description', NULL))"
    verdicts = slots.select("slot_id", F.explode(F.expr(said)).alias("v")).select("slot_id", "v.*", F.array(F.lit("a")).alias("supported"))
    found = slots.select("slot_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("iteration")).select("*", F.lit(1).alias("fused_rank"), F.lit("doc-1").alias("id"), F.lit(0.5).alias("rrf_score"))
    return engine.trace(slots, verdicts, found)


def test_a_page_has_all_sections_escaped(spark):
    got = read(pages.pages(example(spark).withColumn("answer_text", F.lit("one <b>\ntwo\n\nthree"))).first().html)
    text = "|".join(got.texts)
    assert "Is 1 < 2 & \"so\"?" in text and "one <b>|two|three" in text and "nothing <yet>" in text
    assert "0::s1: doc-1" in text and got.bars == 2


def test_a_rejected_run_and_nulls(spark):
    schema = "run_id long, level string, cause string, slots array<struct<slot_id:string,query:string,passes:array<struct<iteration:int,coverage:double,verdict:string,candidates:array<struct<fused_rank:int,id:string,rrf_score:double>>,gap_description:string>>>>"
    rows = spark.createDataFrame([(1, "HARD_HALT", "input_failure", None), (None, None, None, [("s", None, None)]), (3, "PARTIAL", "none", [(None, "q", [(1, None, None, None, None)])])], schema)
    got = [read(r.html) for r in pages.pages(rows).collect()]
    assert "HARD_HALT" in got[0].texts and "Slots" not in got[0].texts and "Slots" in got[1].texts and got[2].bars == 0
    assert pages.pages(rows.limit(0)).count() == 0


def test_ten_thousand_runs_one_file_each_and_reruns_are_equal(spark, tmp_path):
    traces = example(spark, 10_000)
    one = pages.pages(traces).select("run_id", F.md5("html").alias("m"))
    assert one.count() == 10_000 and one.exceptAll(pages.pages(traces).select("run_id", F.md5("html"))).isEmpty()
    some = traces.filter("run_id < 50")
    pages.write_pages(some, str(tmp_path))
    files = {f: open(f).read() for f in glob.glob(f"{tmp_path}/run=*/*.txt")}
    assert len(files) == 50 and all(read(v).bars == 2 for v in files.values())
    pages.write_pages(some.filter("run_id = 7"), str(tmp_path))
    assert sorted(open(f).read() for f in glob.glob(f"{tmp_path}/run=*/*.txt")) == sorted(files.values())


def test_pages_of_all_events_hold_every_pass(spark):
    sf = "/root/testdata/sf0.001"
    events = views.verdicts(spark, sf).select("run_id", "event_id", "verdict").collect()
    n, told = Counter(r.run_id for r in events), Counter((r.run_id, r.verdict) for r in events)
    rows = pages.pages(catalog_records.event_traces(spark, sf)).collect()
    assert {r.run_id for r in rows} == set(n)
    for r in rows:
        got = read(r.html)
        in_passes = got.texts[got.texts.index("Passes") : got.texts.index("Retrieved")]
        assert got.bars == n[r.run_id] and Counter(in_passes)["exhausted"] == told[r.run_id, "exhausted"]
        assert all(any(f"e{e.event_id}" in t.replace(":", ",").replace(" ", "").split(",") for t in got.texts) for e in events if e.run_id == r.run_id)
