"""Reporting periods: parsing, formatting and the equivalence relation, as Column expressions.

A period is a string of one of four shapes: ``2024Q3``, ``FY2023``, ``FY2025-guidance`` or an ISO date. Equivalence is
symmetric but not transitive, so it is never a key: ``equivalent_periods`` gives the strings to look for.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

QUARTER, YEAR, GUIDANCE, INSTANT = r"^(\d{4})Q([1-4])$", r"^FY(\d{4})$", r"^FY(\d{4})-guidance$", r"^(\d{4})-(\d{2})-(\d{2})$"
QUARTER_ENDS = ("03-31", "06-30", "09-30", "12-31")


def parse_period(p: Column) -> Column:
    """STRUCT<kind, year, quarter, instant>; null for null and for what is no period."""
    day = F.try_to_date(p, "yyyy-MM-dd")
    year, none = F.substring, F.lit(None)
    shape = lambda kind, y, q, d: F.struct(F.lit(kind).alias("kind"), y.cast("int").alias("year"), q.cast("int").alias("quarter"), d.cast("date").alias("instant"))
    return (
        F.when(p.rlike(QUARTER), shape("quarter", year(p, 1, 4), year(p, 6, 1), none))
        .when(p.rlike(YEAR), shape("fiscal_year", year(p, 3, 4), none, none))
        .when(p.rlike(GUIDANCE), shape("fy_guidance", year(p, 3, 4), none, none))
        .when(p.rlike(INSTANT) & day.isNotNull(), shape("instant", year(p, 1, 4), none, day))
    )


def format_period(s: Column) -> Column:
    """The string of a parsed period."""
    year = F.lpad(s["year"].cast("string"), 4, "0")
    return (
        F.when(s["kind"] == "quarter", F.concat(year, F.lit("Q"), s["quarter"].cast("string")))
        .when(s["kind"] == "fiscal_year", F.concat(F.lit("FY"), year))
        .when(s["kind"] == "fy_guidance", F.concat(F.lit("FY"), year, F.lit("-guidance")))
        .when(s["kind"] == "instant", F.date_format(s["instant"], "yyyy-MM-dd"))
    )


def is_valid_period(p: Column) -> Column:
    return F.coalesce(parse_period(p).isNotNull(), F.lit(False))


def period_of_document(doc: Column, prefix: str = "nflx") -> Column:
    """Letters, transcripts and quarterly reports give ``YQn``, annual reports ``FYY``, other ids null."""
    letter, quarterly, annual = rf"(?i)^{prefix}-(q[1-4])-(\d{{4}})-(?:letter|transcript)$", rf"(?i)^{prefix}-10q-(\d{{4}})-(q[1-4])$", rf"(?i)^{prefix}-10k-(\d{{4}})$"
    return (
        F.when(doc.rlike(letter), F.concat(F.regexp_extract(doc, letter, 2), F.upper(F.regexp_extract(doc, letter, 1))))
        .when(doc.rlike(quarterly), F.concat(F.regexp_extract(doc, quarterly, 1), F.upper(F.regexp_extract(doc, quarterly, 2))))
        .when(doc.rlike(annual), F.concat(F.lit("FY"), F.regexp_extract(doc, annual, 1)))
    )


def document_of_chunk(chunk_id: Column) -> Column:
    return F.substring_index(chunk_id, "__", 1)


def _quarter_end(p: Column) -> Column:
    return F.concat(F.substring(p, 1, 5 - 1), F.lit("-"), F.element_at(F.array(*map(F.lit, QUARTER_ENDS)), F.try_to_number(F.substring(p, 6, 1), F.lit("9")).cast("int")))


def equivalent_periods(p: Column) -> Column:
    """All strings equivalent to the filter ``p``, itself first; empty for null."""
    s, year, month_day = parse_period(p), F.substring(p, 1, 4), F.substring(p, 6, 5)
    at_end = F.array(p)
    for q, end in enumerate(QUARTER_ENDS, 1):
        own = [p, *([F.concat(F.lit("FY"), year)] if q == 4 else []), F.concat(year, F.lit(f"Q{q}"))]
        at_end = F.when(month_day == end, F.array(*own)).otherwise(at_end)
    return (
        F.when(p.isNull(), F.array().cast("array<string>"))
        .when(s["kind"] == "fiscal_year", F.array(p, F.concat(F.substring(p, 3, 4), F.lit("-12-31"))))
        .when(s["kind"] == "quarter", F.array(p, _quarter_end(p)))
        .when(s["kind"] == "instant", at_end)
        .otherwise(F.array(p))
    )


def equivalent_documents(p: Column, prefix: str = "nflx") -> Column:
    """Ids of the documents whose own period is equivalent to ``p``; empty for null, guidance and other strings."""
    s, year, month_day = parse_period(p), F.substring(p, 1, 4), F.substring(p, 6, 5)
    of_quarter = lambda y, q: [F.concat(F.lit(f"{prefix}-10q-"), y, F.lit("-q"), q), F.concat(F.lit(f"{prefix}-q"), q, F.lit("-"), y, F.lit("-letter")), F.concat(F.lit(f"{prefix}-q"), q, F.lit("-"), y, F.lit("-transcript"))]
    annual = lambda y: F.concat(F.lit(f"{prefix}-10k-"), y)
    none = F.array().cast("array<string>")
    at_end = none
    for q, end in enumerate(QUARTER_ENDS, 1):
        at_end = F.when(month_day == end, F.array(*([annual(year)] if q == 4 else []), *of_quarter(year, F.lit(str(q))))).otherwise(at_end)
    return (
        F.when(s["kind"] == "fiscal_year", F.array(annual(F.substring(p, 3, 4))))
        .when(s["kind"] == "quarter", F.array(*of_quarter(year, F.substring(p, 6, 1))))
        .when(s["kind"] == "instant", at_end)
        .otherwise(none)
    )


def periods_equivalent(a: Column, b: Column) -> Column:
    """True where both denote the same anchor; false, never null, where either is null."""
    return F.coalesce(F.array_contains(equivalent_periods(b), a), F.lit(False))


def matches_filter(period: Column, document: Column, wanted: Column, prefix: str = "nflx") -> Column:
    """No filter keeps all; else the own period must be equivalent or, where it is null, the document's."""
    return wanted.isNull() | periods_equivalent(F.coalesce(period, period_of_document(document, prefix)), wanted)
