import pytest
from fathomite.functions import period as P
from pyspark.sql import functions as F


def values(spark, expr, *rows):
    cols = ", ".join(f"c{i} string" for i in range(len(rows[0])))
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + cols).orderBy("i").select(expr).collect()]


GOOD = ("2024Q3", "2016Q1", "FY2023", "FY2025-guidance", "2024-09-30")
BAD = ("2024Q5", "FY24", "2024/09/30", "Q3 2024", "", "garbage", "2024-13-01", "2024-02-30")


def test_round_trip(spark):
    assert values(spark, P.format_period(P.parse_period(F.col("c0"))), *[(g,) for g in GOOD]) == list(GOOD)
    assert values(spark, P.is_valid_period(F.col("c0")), *[(g,) for g in (*GOOD, *BAD, None)]) == [True] * 5 + [False] * 9


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("FY2024", "2024-12-31", True), ("2024Q4", "2024-12-31", True), ("2024Q1", "2024-03-31", True), ("2024Q2", "2024-06-30", True), ("2024Q3", "2024-09-30", True),
        ("FY2024", "2024Q4", False), ("FY2024", "2023-12-31", False), ("FY2024-guidance", "FY2024", False), ("FY2024-guidance", "FY2024-guidance", True),
        ("x", "x", True), ("2024Q3", "2024-09-29", False), (None, "FY2024", False), ("FY2024", None, False),
    ],
)
def test_equivalence_is_symmetric_and_not_transitive(spark, a, b, same):
    assert values(spark, P.periods_equivalent(F.col("c0"), F.col("c1")), (a, b), (b, a)) == [same, same]


def test_documents(spark):
    ids = ["nflx-q3-2024-letter", "nflx-Q1-2020-transcript", "nflx-10q-2024-q3", "NFLX-10K-2022", "nflx-8k-2022-q1", "x", None, "nflx-10k-2022-a"]
    assert values(spark, P.period_of_document(F.col("c0")), *[(i,) for i in ids]) == ["2024Q3", "2020Q1", "2024Q3", "FY2022", None, None, None, None]
    got = values(spark, P.equivalent_documents(F.col("c0")), ("FY2022",), ("2022Q4",), ("2022-12-31",), ("FY2022-guidance",), ("2022-05-05",), (None,))
    q4 = ["nflx-10q-2022-q4", "nflx-q4-2022-letter", "nflx-q4-2022-transcript"]
    assert got == [["nflx-10k-2022"], q4, ["nflx-10k-2022", *q4], [], [], []]
    assert values(spark, P.document_of_chunk(F.col("c0")), ("d__s__chunk_1",), ("d",)) == ["d", "d"]


def test_filter(spark):
    rows = [("2024Q3", "x", None), ("2024Q3", "x", "2024Q3"), ("2024Q2", "x", "2024Q3"), (None, "zzz", "2024Q3"), (None, "nflx-10k-2022", "FY2022"), (None, "nflx-10k-2021", "FY2022"), ("FY2022", "nflx-10k-2021", "FY2022")]
    assert values(spark, P.matches_filter(F.col("c0"), F.col("c1"), F.col("c2")), *rows) == [True, True, False, False, True, False, True]
