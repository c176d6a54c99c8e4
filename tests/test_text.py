from fathomite.functions import text as T
from fathomite.operators import chunking
from pyspark.sql import functions as F


def one(spark, expr, *args):
    return spark.createDataFrame([args], ", ".join(f"c{i} string" for i in range(len(args)))).select(expr).first()[0]


def test_tokens_and_words(spark):
    assert one(spark, T.tokenize(F.col("c0")), "It's Q3-2024 -x 1,234 x- y") == ["it's", "q3-2024", "x", "1", "234", "x", "y"]
    assert one(spark, T.tokenize(F.col("c0")), "déjà vu") == ["vu"]
    assert one(spark, T.word_count(F.col("c0")), " a  b c\n") == 3


def test_sentences(spark):
    assert one(spark, T.sentences(F.col("c0")), "This is one. This is two! And three? Yes.") == ["This is one.", "This is two!", "And three?", "Yes."]
    got = one(spark, T.sentences(F.col("c0")), "Acme, Inc. reported revenue. Mr. Smith commented.\n\nNew part")
    assert got == ["Acme, Inc. reported revenue.", "Mr. Smith commented.", "New part"]
    assert one(spark, T.sentences(F.col("c0")), "  ") == []


def plain_chunks(sentences, size, overlap):
    out, cur = [], []
    n = lambda xs: sum(len(x.split()) for x in xs)
    for s in sentences:
        if cur and n(cur) + n([s]) > size:
            out.append(" ".join(cur))
            keep = [cur[-1]]
            for x in reversed(cur[:-1]):
                if n(keep) + n([x]) > overlap:
                    break
                keep.insert(0, x)
            cur = keep
        cur = [*cur, s]
    return [*out, " ".join(cur)] if cur else out


def test_chunks(spark):
    import random

    rng = random.Random(1)
    for size, overlap in ((500, 50), (20, 5), (7, 0), (3, 9)):
        sentences = [" ".join([f"W{i}", *("w" for _ in range(rng.randint(0, 12)))]) + "." for i in range(60)]
        got = one(spark, chunking.chunk_arrays(F.col("c0"), size, overlap), " ".join(sentences))
        assert got == plain_chunks(sentences, size, overlap)
    long = "One " + "word " * 699 + "end."
    sections = spark.createDataFrame([("d", "s", "A b. " + long), ("d", "cover", "x"), ("d", "e", None), ("d", "f", "")], "document_id string, section string, text string")
    rows = chunking.chunks(sections, skip=("cover",)).orderBy("position_index").collect()
    assert [(r.chunk_id, r.position_index, r.word_count) for r in rows] == [("d__s__chunk_0", 0, 2), ("d__s__chunk_1", 1, 703)]


def test_normalize(spark):
    assert one(spark, T.normalize_text(F.col("c0")), "“a”–b…&amp;&NBSP;c\r\nd \t e  \n\n\n\n\x00f ") == '"a"-b...& c\nd e\n\nf'
    assert one(spark, T.nfc(F.col("c0")), "é") == "é"
    assert one(spark, T.normalize_claim(F.col("c0")), "  A\n B ") == "a b"


def test_transcripts(spark):
    text = "Operator intro\nPresentation\nHello all.\nNETFLIX, INC. FQ3 2024 EARNINGS CALL OCT\nMore.\nQuestion and Answer\nQ one?\n"
    got = one(spark, T.split_transcript(F.col("c0")), text)
    assert (got.prepared_remarks, got.qa) == ("Hello all.\n\nMore.", "Q one?")
    whole = one(spark, T.split_transcript(F.col("c0")), "Question and Answer\nx\nPresentation\ny")
    assert whole.qa == "" and whole.prepared_remarks.startswith("Question")
    assert one(spark, T.label_speakers(F.col("c0")), "x Theodore A. Sarandos hi") == "x \n\nTed Sarandos:\n hi"
    assert one(spark, T.trim_appendix(F.col("c0")), "Body text.\n\n12\nNetflix, Inc.\nConsolidated Balance Sheet\n1 2") == "Body text."
    assert one(spark, T.trim_appendix(F.col("c0")), "No appendix ") == "No appendix "


def test_numbers_terms_and_anchors(spark):
    assert one(spark, F.sort_array(T.significant_numbers(F.col("c0"))), "8,187 in 2024 and 12.9, 7 or 1,234,567.5 of 260") == sorted(["8,187", "8187", "12.9", "1,234,567.5", "1234567.5", "260"])
    assert one(spark, T.key_terms(F.col("c0")), "The Margin and margin could rise while Subscribers fell to 3x") == ["Margin", "rise", "Subscribers", "fell"]
    assert one(spark, T.metric_phrases(F.col("c0")), "Operating  Income and EPS and revenues") == ["operating income", "eps", "revenues"]
    assert one(spark, T.locate_anchor(F.col("c0"), F.col("c1")), "Grown our\n FY23 (margin) a lot", "grown our FY23 (margin)") == "Grown our\n FY23 (margin)"
    assert one(spark, T.locate_anchor(F.col("c0"), F.col("c1")), "abc", "x") is None
    assert one(spark, T.token_jaccard(F.col("c0"), F.col("c1")), "alpha beta cat", "beta gamma") == 1 / 3
    assert one(spark, T.coverage_bar(F.lit(0.5))["height"], "x") == 13
    assert one(spark, T.paragraphs_html(F.col("c0")), "a<b\nc\n\nd") == "<p>a&lt;b<br>c</p><p>d</p>"
    assert one(spark, T.lenient_json(F.col("c0")).cast("string"), 'x ```{"a": 1}``` y') == '{"a":1}'


def test_rounding_goes_by_the_stored_double(spark):
    import duckdb

    halves = [n / 1000 for n in range(-2000, 2001)] + [0.0, 1e300, 0.004999999999999999]
    rows = spark.createDataFrame([(x,) for x in halves], "x double")
    got = {r.x: r.y for r in rows.select("x", T.rounded(F.col("x"), 2).alias("y")).collect()}
    want = dict(duckdb.sql(f"SELECT x, round(x, 2) FROM (SELECT unnest({halves}::DOUBLE[]) AS x)").fetchall())
    assert got == want and got[0.285] == 0.28 and got[0.125] == 0.13


def test_bars_of_values_that_lie_between_two_steps(spark, tmp_path):
    import __spark_entry__ as entry
    import duckdb

    rows = [(i, None, i % 7, "click", i / 2) for i in range(4000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in entry.queries()["q_coverage_bars"](spark, f"file://{tmp_path}").collect()}
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == set(duckdb.sql(entry.oracle_sql()["q_coverage_bars"]).fetchall())


def test_only_texts_that_may_need_composing_go_to_python(spark):
    import unicodedata

    texts = ["plain", "d\u00e9j\u00e0 \u201cvu\u201d \u2013 5 \u20ac", "e\u0301", "\u212b", "\u1100\u1161", "\u2000", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in rows.select("t", T.nfc(F.col("t")), F.col("t").rlike(T.MAY_COMPOSE)).collect()]
    assert [g[1] for g in got] == [None if t is None else unicodedata.normalize("NFC", t) for t in texts]
    assert [g[2] for g in got] == [False, False, True, True, True, True, None, False]
    quiet = [chr(c) for lo, hi in ((0, 0x300), (0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20C0)) for c in range(lo, hi)]
    assert unicodedata.normalize("NFC", "".join(quiet)) == "".join(quiet) and not any(unicodedata.combining(c) for c in quiet)
