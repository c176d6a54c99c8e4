import datetime as dt

from fathomite.functions import xbrl as X
from fathomite.operators import facts as FA
from fathomite.sources import files
from pyspark.sql import functions as F

DAY = dt.date
COLUMNS = "fact_id string, claim string, asserter string, source_document string, verbatim_anchor string, fact_type string, period string, value double, concept_tag string, assertion_date date, confidence double, seq int"


def fact(i, value=1.0, day=DAY(2024, 1, 1), concept="us-gaap:Assets", period="FY2023", claim="c", confidence=0.9, asserter="A", anchor="x", doc="d", kind="financial_metric"):
    return (i, claim, asserter, doc, anchor, kind, period, value, concept, day, confidence, int(i[1:]))


def test_restatement_cases(spark):
    later = DAY(2024, 6, 1)
    rows = [
        fact("f1"), fact("f2", 2.0, later, " US-GAAP:assets "), fact("f3", 1.0, later), fact("f4", 3.0, DAY(2023, 1, 1)), fact("f5", 4.0, later, period="FY2022"),
        fact("f6", 5.0, concept=None, claim="paid memberships grew", period="P"), fact("f7", 6.0, later, None, "P", "our Paid  memberships"), fact("f8", 7.0, later, None, "P", "other"),
        fact("f9", None, later),
    ]
    table = spark.createDataFrame(rows, COLUMNS)
    pairs = {(r.target_id, r.evidence_id) for r in FA.restatements(table).collect()}
    assert pairs == {("f1", "f2"), ("f4", "f1"), ("f4", "f2"), ("f4", "f3"), ("f6", "f7")}
    assert {(r.fact_id, r.n_later) for r in FA.restated(table).collect()} == {("f1", 1), ("f4", 3)}


def test_restated_counts_repeats_and_leaves_out_undated_rows(spark):
    early, later = DAY(2022, 6, 1), DAY(2024, 6, 1)
    rows = [fact("f1", 1.0, early), fact("f3", 2.0, later), fact("f4", 2.0, later), fact("f5", 2.0, later), fact("f2", 1.0, early), fact("f6", 9.0, None), fact("f7", 1.0, later)]
    table = spark.createDataFrame(rows, COLUMNS)
    got = [(r.fact_id, r.n_later) for r in FA.restated(table).collect()]
    pairs = [r.target_id for r in FA.restatements(table).collect()]
    assert sorted(got) == [("f1", 3), ("f2", 3)] == sorted((t, pairs.count(t)) for t in set(pairs))
    assert FA.restated(table.limit(0)).count() == 0


def test_percentiles_of_repeated_null_and_empty(spark):
    rows = spark.createDataFrame([("g", v) for v in (2, 2, 2, 7, None)] + [(None, 4)], "g string, v int")
    assert {tuple(r) for r in FA.nearest_rank(rows, "g", "v", (0.0, 0.5, 1.0)).collect()} == {("g", 2, 2, 7), (None, 4, 4, 4)}
    assert FA.nearest_rank(rows.limit(0), "g", "v", (0.5,)).count() == 0


def test_dedup_keeps_the_confident_and_the_first_place(spark):
    rows = [fact("f1", claim="A  b", confidence=0.5), fact("f2", claim="x"), fact("f3", claim="a B", confidence=0.7), fact("f4", claim="a b", confidence=0.7), fact("f5", claim="a b", period=None), fact("f6", claim="a b", period=None)]
    got = sorted((r.position, r.fact_id) for r in FA.dedup_facts(spark.createDataFrame(rows, COLUMNS)).collect())
    assert got == [(1, "f3"), (2, "f2"), (5, "f5")]
    first = FA.first_wins(spark.createDataFrame([fact("f2", 1.0), fact("f1", 2.0), fact("f3", 2.0)], COLUMNS), ["period"], "seq").first()
    assert (first.value, first.n_duplicates, first.n_mismatches) == (2.0, 2, 1)


def test_gates(spark):
    rows = [fact("f1", confidence=0.79), fact("f2", confidence=0.80), fact("f3", asserter=" Unknown "), fact("f4", anchor=""), fact("f5", day=DAY(2023, 1, 1)), fact("f6", asserter=None)]
    table = spark.createDataFrame(rows, COLUMNS)
    held = lambda s: [r[0] for r in table.orderBy("seq").select(FA.passes_strong_gates(F.lit(s), F.lit("2023-06-01").cast("date"))).collect()]
    assert held("restated_value") == [False, True, False, False, False, False]
    assert held("alternative_cause") == [False, True, False, False, True, False]


def test_leakage_and_drop_reasons(spark):
    rows = [("free cash flow was $3 billion", "strategic_claim"), ("free cash flow was $3 billion", "forward_guidance"), ("a Repurchase Authorization", "forward_guidance"), ("net income grew", "risk_disclosure"), ("net income grew 5 %", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string, t string").select(FA.gaap_leakage(F.col("c"), F.col("t"))).collect()]
    assert got == ["gaap_keyword", None, "corporate_action", None, "gaap_keyword"]
    raw = [("financial_metric", "a", "1"), ("odd", "a", "1"), ("risk_disclosure", "", "1"), ("risk_disclosure", "zz", "1"), ("risk_disclosure", "a", "x"), ("risk_disclosure", "a", "0.4"), ("risk_disclosure", "A  B", "0.9"), (None, "a", "1")]
    rows = spark.createDataFrame([(*r, "c", None, "has a b") for r in raw], "fact_type string, verbatim_anchor string, confidence string, claim string, period string, chunk_text string")
    assert [r[0] for r in rows.select(FA.prose_drop_reason()).collect()] == ["financial_metric", "schema", "anchor", "anchor", "schema", "low_confidence", None, "schema"]


def test_displayed_and_claimed_values(spark):
    cases = [
        (9824703000.0, "USD", -3, "$9,824,703", "$9.82 billion"), (-48330000.0, "USD", -3, "$(48,330)", "-$48.3 million"), (5.4, "USDPerShare", 2, "$5.40", "$5.40 per share"), (-0.05, "USDPershares", 2, "$(0.05)", "$-0.05 per share"),
        (428000000.0, "shares", -3, "428,000", "428.0 million shares"), (1500.0, "USD", None, "$1,500", "$2 thousand"), (84803.0, "membership", 0, "84,803", "84,803"), (12.0, "EUR", None, "12 EUR", "12"),
    ]
    table = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, v double, u string, d int, a string, c string").orderBy("i")
    for r in table.select(X.anchor(F.col("v"), F.col("u"), F.col("d")).alias("x"), "a", X.claim_value(F.col("v"), F.col("u")).alias("y"), "c").collect():
        assert (r.x, r.y) == (r.a, r.c)


XML = """<xbrli:xbrl xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:us-gaap="http://g" xmlns:nflx="http://n" xmlns:xbrldi="http://xbrl.org/2006/xbrldi">
<xbrli:context id="q"><xbrli:entity><xbrli:segment/></xbrli:entity><xbrli:period><xbrli:startDate>2024-07-01</xbrli:startDate><xbrli:endDate>2024-09-30</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:context id="r"><xbrli:entity><xbrli:segment><xbrldi:explicitMember dimension="srt:StatementGeographicalAxis">us-gaap:EMEAMember</xbrldi:explicitMember></xbrli:segment></xbrli:entity><xbrli:period><xbrli:startDate>2024-07-01</xbrli:startDate><xbrli:endDate>2024-09-30</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:context id="i"><xbrli:period><xbrli:instant>2024-09-30</xbrli:instant></xbrli:period></xbrli:context>
<xbrli:context id="y"><xbrli:period><xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate>2024-09-30</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:unit id="usd"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit>
<us-gaap:Revenues contextRef="q" unitRef="usd" decimals="-3">9824703000</us-gaap:Revenues><us-gaap:Revenues contextRef="r" unitRef="usd" decimals="-3">3133466000</us-gaap:Revenues>
<us-gaap:Revenues contextRef="y" unitRef="usd" decimals="-3">1</us-gaap:Revenues><us-gaap:Assets contextRef="i" unitRef="usd" decimals="-3">52281550000</us-gaap:Assets>
<us-gaap:Odd contextRef="q" unitRef="usd">1</us-gaap:Odd><us-gaap:Assets contextRef="none">1</us-gaap:Assets><us-gaap:Assets contextRef="i">text</us-gaap:Assets></xbrli:xbrl>"""


def test_filing_to_facts(spark):
    raw = files.parse_xbrl(spark.createDataFrame([("nflx-10q-2024-q3", XML), ("x", None)], "document_id string, xml string"))
    assert raw.count() == 5
    made = {r.fact_id: r for r in FA.xbrl_facts(raw.withColumn("filing_date", F.lit("2024-10-18").cast("date"))).collect()}
    assert set(made) == {"F-XBRL-nflx-10q-2024-q3-us-gaap-Revenues-2024Q3", "F-XBRL-nflx-10q-2024-q3-us-gaap-Revenues-2024Q3-EMEA", "F-XBRL-nflx-10q-2024-q3-us-gaap-Assets-2024-09-30"}
    assert made["F-XBRL-nflx-10q-2024-q3-us-gaap-Revenues-2024Q3-EMEA"].claim == "Netflix's EMEA revenues for Q3 2024 was $3.13 billion."
    assert made["F-XBRL-nflx-10q-2024-q3-us-gaap-Assets-2024-09-30"].claim == "Netflix's total assets as of September 30, 2024 was $52.28 billion."
    kinds = raw.withColumn("kind", X.period_kind(F.col("instant"), F.col("period_start"), F.col("period_end")))
    assert {(r[0], r[1]) for r in kinds.select("concept", FA.xbrl_drop_reason()).collect()} >= {("us-gaap:Odd", "non_canonical_concept"), ("us-gaap:Revenues", "ytd_ytd_9m")}


def test_percentiles_and_files(spark, tmp_path):
    rows = spark.createDataFrame([("g", v) for v in (5, 1, 3, 2)], "g string, v int")
    assert tuple(FA.nearest_rank(rows, "g", "v", (0.5, 0.9)).first()) == ("g", 3, 5)
    table = spark.createDataFrame([fact("f1"), fact("f2", doc="e")], COLUMNS).drop("seq").withColumns({"source_section": F.lit("s"), "unit": F.lit("USD")})
    files.write_facts(table, str(tmp_path / "facts"))
    assert files.read_facts(spark, str(tmp_path / "facts")).count() == 2
    (tmp_path / "facts" / "more.json").write_text('{"fact_id": "f1", "claim": "later"}\nnot json\n')
    assert {r.fact_id for r in files.read_facts(spark, str(tmp_path / "facts"), strict=False).collect()} == {"f1", "f2"}
    (tmp_path / "doc").mkdir()
    (tmp_path / "doc" / "transcript.txt").write_text("Presentation\nhi\nQuestion and Answer\nyes")
    (tmp_path / "doc" / "mda.txt").write_text("body")
    got = {(r.document_id, r.section, r.text) for r in files.read_sections(spark, str(tmp_path / "doc")).collect()}
    assert got == {("doc", "mda", "body"), ("doc", "prepared_remarks", "hi"), ("doc", "qa", "yes")}


def test_validation_reports(spark):
    table = spark.createDataFrame([fact("f1", anchor="$(1,234)"), fact("f2", anchor="not there"), fact("f3", doc="none"), fact("f4", concept="us-gaap:Revenues")], COLUMNS)
    texts = spark.createDataFrame([("d", "The loss was 1,234 and x")], "document_id string, text string")
    assert {r.fact_id: r.status for r in FA.anchor_check(table, texts).collect()} == {"f1": "found", "f2": "missing", "f3": "doc_text_missing", "f4": "found"}
    cells = FA.coverage_matrix(texts, table)
    assert cells.count() == 36 and {(r.concept, r.n) for r in cells.filter("n > 0").collect()} == {("us-gaap:Assets", 2), ("us-gaap:Revenues", 1)}
    ends = spark.createDataFrame([("t1", "2023Q4", DAY(2023, 12, 31)), ("t2", "2023Q3", DAY(2023, 9, 30)), ("t3", "2023Q2", DAY(2023, 6, 30))], "document_id string, fiscal_period string, period_end date")
    letters = spark.createDataFrame([("2023Q2", DAY(2023, 7, 19))], "fiscal_period string, filing_date date")
    got = {r.document_id: r.assertion_date for r in FA.assertion_dates(ends, letters).collect()}
    assert got == {"t1": DAY(2024, 1, 18), "t2": DAY(2023, 10, 18), "t3": DAY(2023, 7, 19)}
    assert FA.index_projection(table.withColumn("fact_id", F.lit("x-EMEA"))).first().region == "EMEA"


def test_anchors_short_cut_and_repeated(spark):
    docs = spark.createDataFrame([(1, "The quick  brown fox jumps over the lazy dog and runs away at once"), (2, "a fox\njumps over the lazy dog"), (3, None), (4, "")], "document_id long, text string")
    anchors = [("a", "fox"), ("b", "ick brown fox jum"), ("c", "JUMPS over the"), ("d", "fox jumps"), ("e", "umps over the lazy do"), ("f", "no such words here"), ("g", " "), ("h", None), ("i", "quick  brown fox jumps over the lazy dog and runs"), ("j", "dog (and"), ("k", "fox jumps over the lazy dog")]
    got = FA.located_anchors(docs, spark.createDataFrame(anchors + [("l", "fox")], "anchor_id string, anchor string"))
    want = {("a", 1), ("a", 2), ("l", 1), ("l", 2), ("b", 1), ("c", 1), ("c", 2), ("d", 1), ("d", 2), ("e", 1), ("e", 2), ("i", 1), ("k", 1), ("k", 2)}
    assert {tuple(r) for r in got.collect()} == want
    assert FA.located_anchors(docs.limit(0), spark.createDataFrame(anchors, "anchor_id string, anchor string")).count() == 0


def test_ids_of_documents_with_more_than_9999_facts(spark, tmp_path):
    """The operator's ids stay apart; the query's are those of its SQL, whose lpad keeps four digits."""
    import __spark_entry__ as entry
    import duckdb

    n = 10_050
    one = spark.range(1, n + 1)
    minted = FA.mint_ids(one.select(F.lit("d").alias("doc"), F.format_string("f%06d", "id").alias("seq")), "doc", "seq")
    assert minted.select("fact_id").distinct().count() == n and minted.filter("fact_id = 'F-PROSE-d-10050'").count() == 1
    day = F.lit("1998-11-14").cast("timestamp_ntz")
    tables = {
        "lineitem": one.select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(1).alias("l_partkey"), F.lit(1).alias("l_suppkey"), day.alias("l_shipdate"), F.lit(5.0).alias("l_extendedprice"), F.lit(0.0).alias("l_discount")),
        "orders": one.select(F.col("id").alias("o_orderkey"), day.alias("o_orderdate")),
        "part": spark.range(1).select(F.lit(1).alias("p_partkey"), F.lit("Brand#1").alias("p_brand")), "supplier": spark.range(1).select(F.lit(1).alias("s_suppkey"), F.lit("S").alias("s_name")),
    }
    for name, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        duckdb.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(map(tuple, entry.queries()["q_fact_ids"](spark, f"file://{tmp_path}").collect()))
    assert len(got) == n and got == sorted(duckdb.sql(entry.oracle_sql()["q_fact_ids"]).fetchall())


def test_evidence_is_taken_from_lists_and_pairs_are_not_shuffled(spark):
    from fathomite.plans import engine

    later, both = DAY(2024, 6, 1), "net income and gross profit"
    rows = [fact("f1"), fact("f2", 2.0, later), fact("f2", 2.0, later), fact("f3", 5.0, concept=None, claim=both), fact("f4", 6.0, later, None, claim=both, confidence=0.1), fact("f5", None), fact("f6", 7.0, concept=None, claim="nothing")]
    table = spark.createDataFrame(rows, COLUMNS)
    pairs = FA.restatements(table)
    assert sorted(map(tuple, pairs.collect())) == [("f1", "f2"), ("f3", "f4")]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join ") < plan.index("Aggregate "), "no aggregate over the pairs"
    verified = spark.createDataFrame([("r", f"f{i}") for i in (1, 3, 4, 5, 6, 9)], "run_id string, fact_id string")
    found = engine.refute(table, verified)
    assert {r.fact_id: (r.refutation_verdict, r.evidence) for r in found.collect()} == {"f1": ("strongly_refuted", ["f2"]), "f3": ("weakly_refuted", ["f4"]), "f4": ("unrefuted", []), "f5": ("unrefuted", []), "f6": ("unrefuted", [])}


def test_columns_of_a_document_come_with_its_facts(spark):
    documents = spark.createDataFrame([("a", XML, DAY(2024, 10, 18)), ("b", None, None), ("c", XML, None)], "document_id string, xml string, filing_date date")
    got = files.parse_xbrl(documents, keep=("filing_date",)).groupBy("document_id", "filing_date").count().collect()
    assert {(r[0], r[1]) for r in got} == {("a", DAY(2024, 10, 18)), ("c", None)} and len({r[2] for r in got}) == 1


def test_pairs_are_dealt_out_in_blocks(spark, monkeypatch):
    """A concept's facts in blocks that all of its targets meet give the pairs of one block; targets may be a condition."""
    monkeypatch.setattr(FA, "BLOCK", 3)
    both = "net income and gross profit"
    rows = [fact(f"f{i}", float(i % 4), DAY(2024, 1 + i % 9, 1), confidence=0.9 + i % 2 / 10) for i in range(40)]
    rows += [fact("f50", 1.0, concept=None, claim=both, confidence=1.0), fact("f51", 2.0, DAY(2024, 2, 1), None, claim=both), fact("f52", 2.0, DAY(2024, 2, 1), period="FY2022"), rows[3]]
    table = spark.createDataFrame(rows, COLUMNS)
    sure = F.col("confidence") >= 0.98
    got = sorted(map(tuple, FA.restatements(table, sure, tasks=5).collect()))
    assert got == sorted(map(tuple, FA.restatements(table, table.filter(sure)).collect())) and len(set(got)) == len(got) > 100
    assert got == sorted(map(tuple, FA.restatements(table, sure).collect())) and FA.restatements(table.limit(0), sure, tasks=1).count() == 0


def test_pairs_of_quarters_join_and_write_only_facts_of_quarters(spark):
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.001"
    pairs = entry.queries()["q_restatement_pairs"](spark, sf_dir)
    read = pairs.inputFiles()
    assert read and all("/fathomite_facts_" in f for f in read), "the view's joins run once"
    written = spark.read.parquet(read[0].rsplit("/", 1)[0])
    assert written.count() == written.filter("period LIKE '____Q_'").count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_linenumber % 4 = 0").count()


def test_refutation_of_yearly_figures_joins_and_writes_only_yearly_facts(spark):
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.001"
    read = entry.queries()["q_refute"](spark, sf_dir).inputFiles()
    assert read and all("/fathomite_facts_" in f for f in read)
    written = spark.read.parquet(read[0].rsplit("/", 1)[0])
    assert written.count() == written.filter("period LIKE 'FY%'").count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_linenumber % 4 = 1").count()
