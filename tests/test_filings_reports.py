import datetime as dt
import json

import pytest
from fathomite.operators import chunking, reports
from fathomite.sources import files, filings
from pyspark.sql import functions as F

DAY = dt.date


def test_find_a_filing_and_a_letter(spark):
    rows = [("10-K", "2022-12-31", DAY(2023, 1, 26), "a1", None), ("10-K", "2022-12-31", DAY(2023, 3, 1), "a2", None), ("8-K", "2022-12-31", DAY(2023, 1, 19), "b1", "2.02,9.01"), ("8-K", "2022-12-31", DAY(2023, 1, 25), "b2", "5.02"), ("8-K", "2023-03-31", DAY(2023, 4, 20), "b3", "5.02"), ("8-K", "x", DAY(2023, 4, 18), "b4", None)]
    table = spark.createDataFrame(rows, "form string, period_of_report string, filing_date date, accession string, items string")
    wanted = spark.createDataFrame([("10-K", "2022-12-31"), ("10-Q", "2022-12-31")], "form string, period_of_report string")
    assert {(r.form, r.accession) for r in filings.find_filing(table, wanted).collect()} == {("10-K", "a2"), ("10-Q", None)}
    windows = spark.createDataFrame([(1, "2023-01-01", "2023-01-31"), (2, "2023-04-01", "2023-04-30"), (3, "2024-01-01", "2024-02-28")], "window_id int, first string, last string")
    assert {(r.window_id, r.accession) for r in filings.find_letter(table, windows).collect()} == {(1, "b1"), (2, "b3"), (3, None)}
    listed = table.withColumn("items", F.split("items", ","))
    assert {(r.window_id, r.accession) for r in filings.find_letter(listed, windows).collect()} == {(1, "b1"), (2, "b3"), (3, None)}
    assert [r.accession for r in files.list_filings(table.withColumnRenamed("accession", "document_id").withColumn("accession", F.col("document_id")), "2023-01-20", "2023-03-01").collect()] == ["b2", "a1", "a2"]


def test_retained_items(spark):
    items = spark.createDataFrame([("k", "10-K/A", "Item 1", "business"), ("k", "10-K/A", "Item 2", "properties"), ("k", "10-K/A", "Item 7", "  "), ("q", "10-Q", "Item 3", "risk")], "document_id string, form string, section string, text string")
    legacy = spark.createDataFrame([("k", "Part II", "Item 7", "discussion"), ("k", "Part I", "Item 7A", "wrong part"), ("q", "Part II", "Item 1A", "factors"), ("q", "Part I", "Item 2", " ")], "document_id string, part string, item string, text string")
    notes = spark.createDataFrame([("k", "note 1"), ("q", " "), ("z", "no such filing")], "document_id string, text string")
    got = {(r.document_id, r.section): r.text for r in filings.retained_items(items, legacy, notes).collect()}
    assert got == {("k", "Item 1"): "business", ("k", "Item 7"): "discussion", ("q", "Item 3"): "risk", ("q", "Item 1A"): "factors", ("k", "Notes to Financial Statements"): "note 1"}
    with pytest.raises(Exception, match="only annual and quarterly"):
        filings.retained_items(items.withColumn("form", F.lit("8-K")), legacy).collect()


def test_landed_files_urls_and_copies(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("So Ted Sarandos then")
    (tmp_path / "sub" / "b.txt").write_text("x")
    landed = filings.read_landed(spark, str(tmp_path), "*.txt")
    assert {(r.stem, bytes(r.content)) for r in landed.collect()} == {("a", b"So Ted Sarandos then"), ("b", b"x")}
    assert "Ted Sarandos:" in filings.landed_text(landed).filter("stem = 'a'").first().text
    wanted = spark.createDataFrame([("a", 2023, 1, DAY(2023, 4, 18)), ("c", 2023, 2, DAY(2023, 7, 19))], "document_id string, year int, quarter int, release_date date")
    answers = spark.createDataFrame([("u/2023/1", 200), ("d/2023-04-18", 404), ("d/2023-07-19", 200), ("u/2023/2", 200)], "url string, status int")
    got = {r.document_id: r.url for r in filings.first_hit(wanted, ["d/{date}"], ["u/{year}/{quarter}"], answers).collect()}
    assert got == {"a": "u/2023/1", "c": "d/2023-07-19"}
    copies = {r.document_id: r.status for r in filings.local_copies(wanted.withColumn("status", F.lit("remote")), landed).collect()}
    assert copies == {"a": "local", "c": "remote"}


def test_skipped_sections(spark):
    rows = spark.createDataFrame([("d", "signatures", "Signed by me."), ("d", "item_1", "It is so.")], "document_id string, section string, text string")
    assert [r.section for r in chunking.chunks(rows).collect()] == ["item_1"]
    assert chunking.chunks(rows, skip=()).count() == 2


def test_reports(spark):
    facts = spark.createDataFrame(
        [("1", "Net income was $5 million", "strategic_claim", "d1", "A", 0.9, "c", "income"), ("2", "They will grow", "strategic_claim", "d1", "B", 0.5, None, "grow"), ("3", "Assets", "financial_metric", "d2", "A", 1.0, "c", "nowhere")],
        "fact_id string, claim string, fact_type string, source_document string, asserter string, confidence double, concept_tag string, verbatim_anchor string",
    )
    kept, dropped = reports.post_filtered(facts)
    assert {r.fact_id for r in kept.collect()} == {"2", "3"} and [tuple(r) for r in dropped.collect()] == [("gaap_keyword", 1)]
    proposed = facts.withColumn("drop_reason", F.when(F.col("fact_id") == "2", "anchor"))
    assert {(r.source_document, r.n_proposed, r.n_kept, r.n_anchor, r.kept_rate) for r in reports.extraction_stats(proposed).collect()} == {("d1", 2, 1, 1, 0.5), ("d2", 1, 1, 0, 1.0)}
    texts = spark.createDataFrame([("d1", "Net income rose"), ("d2", "something else")], "document_id string, text string")
    r = reports.anchor_failures(facts, texts).first()
    assert (r.n, r.n_missing, r.rate, r["sample"]) == (3, 2, 0.6667, ["2", "3"])
    found = reports.placeholders(spark.createDataFrame([("s", "1", 1), ("s", "9", 2)], "slot_id string, id string, fused_rank int"), facts).orderBy("fused_rank").collect()
    assert [(r.fact_id, r.resolved, r.claim) for r in found] == [("1", True, "Net income was $5 million"), ("9", False, "unresolved candidate 9")]
    made = json.loads(reports.summary(facts, texts).first().summary)
    assert made["n_facts"] == 3 and made["n_chunks"] == 2 and made["asserters"][0] == {"asserter": "A", "n": 2} and made["low_rate"] == 0.3333
    assert reports.summary(facts.limit(0), texts).count() == 1
