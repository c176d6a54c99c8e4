"""Functions over tagged financial facts: period kinds, dimensions, displayed and claimed values, ids and claims."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import values as V
from .period import format_period  # noqa: F401


def period_kind(instant: Column, start: Column, end: Column) -> Column:
    days = F.datediff(end, start) + 1
    return (
        F.when(instant.isNotNull(), "instant")
        .when(days.between(88, 95), "qtd")
        .when(days.between(178, 186), "ytd_6m")
        .when(days.between(268, 275), "ytd_9m")
        .when(days.between(360, 370), "fy")
        .otherwise("unknown")
    )


def canonical_period(kind: Column, instant: Column, end: Column) -> Column:
    """An ISO date for instants, ``YQn`` for quarters, ``FYY`` for years, else null."""
    year = F.year(end).cast("string")
    return F.when(kind == "instant", F.date_format(instant, "yyyy-MM-dd")).when(kind == "qtd", F.concat(year, F.lit("Q"), F.quarter(end).cast("string"))).when(kind == "fy", F.concat(F.lit("FY"), year))


def human_period(kind: Column, instant: Column, end: Column) -> Column:
    year = F.year(end).cast("string")
    return (
        F.when(kind == "instant", F.concat(F.lit("as of "), F.date_format(instant, "MMMM d, yyyy")))
        .when(kind == "qtd", F.concat(F.lit("Q"), F.quarter(end).cast("string"), F.lit(" "), year))
        .when(kind == "fy", F.concat(F.lit("fiscal year "), year))
    )


def _pairs(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def classify_dimensions(dimensions: Column) -> Column:
    """STRUCT<kind, region>: aggregate without dimensions but the product axis's no-op member, regional with exactly one
    known geographic member, else drop."""
    left = F.map_filter(dimensions, lambda axis, member: ~((axis == V.PRODUCT_AXIS) & (member == V.NOOP_MEMBER)))
    region = F.try_element_at(_pairs(V.REGIONS), F.try_element_at(left, F.lit(V.GEOGRAPHIC_AXIS)))
    size = F.coalesce(F.size(left), F.lit(0))
    kind = F.when(size <= 0, "aggregate").when((size == 1) & region.isNotNull(), "regional").otherwise("drop")
    return F.struct(kind.alias("kind"), F.when(kind == "regional", region).alias("region"))


def displayed_scale(decimals: Column) -> Column:
    return F.when(decimals < 0, F.pow(F.lit(10.0), -decimals)).otherwise(F.lit(1.0))


def _fixed(v: Column, places: int) -> Column:
    return F.replace(F.format_number(v, places), F.lit(","), F.lit(""))


def anchor(value: Column, unit: Column, decimals: Column) -> Column:
    """The value as a table cell shows it: scaled by ``decimals``, negatives in brackets for money."""
    shown = value / displayed_scale(decimals)
    money = lambda v, text: F.when(v < 0, F.concat(F.lit("$("), text(F.abs(v)), F.lit(")"))).otherwise(F.concat(F.lit("$"), text(v)))
    return (
        F.when(unit == "USD", money(shown, lambda v: F.format_number(v, 0)))
        .when(unit.isin(*V.PER_SHARE_UNITS), money(value, lambda v: _fixed(v, 2)))
        .when(unit.isin(*V.COUNT_UNITS), F.when(shown == F.floor(shown), F.format_number(shown, 0)).otherwise(F.format_number(shown, 2)))
        .otherwise(F.concat(F.format_number(value, 0), F.lit(" "), unit))
    )


def claim_value(value: Column, unit: Column) -> Column:
    """The value as a sentence states it, in billions, millions or thousands."""
    v, sign = F.abs(value), F.when(value < 0, "-").otherwise("")
    usd = (
        F.when(v >= 1e9, F.concat(sign, F.lit("$"), _fixed(v / 1e9, 2), F.lit(" billion")))
        .when(v >= 1e6, F.concat(sign, F.lit("$"), _fixed(v / 1e6, 1), F.lit(" million")))
        .when(v >= 1e3, F.concat(sign, F.lit("$"), F.format_number(v / 1e3, 0), F.lit(" thousand")))
        .otherwise(F.concat(sign, F.lit("$"), F.format_number(v, 2)))
    )
    millions = _fixed(value / 1e6, 1)
    return (
        F.when(unit == "USD", usd)
        .when(unit.isin(*V.PER_SHARE_UNITS), F.concat(F.lit("$"), _fixed(value, 2), F.lit(" per share")))
        .when(unit == "shares", F.concat(F.when(v >= 1e6, F.concat(millions, F.lit(" million"))).otherwise(F.format_number(value, 0)), F.lit(" shares")))
        .when(unit.isin(*V.COUNT_UNITS) & (v >= 1e6), F.concat(millions, F.lit(" million")))
        .otherwise(F.format_number(value, 0))
    )


def fact_id(document: Column, concept: Column, period: Column, region: Column) -> Column:
    return F.concat_ws("-", F.lit("F-XBRL"), document, F.replace(concept, F.lit(":"), F.lit("-")), period, region)


def claim(company: str, label: Column, region: Column, kind: Column, human: Column, stated: Column) -> Column:
    return F.concat(F.lit(f"{company}'s "), F.coalesce(F.concat(region, F.lit(" ")), F.lit("")), F.lower(label), F.when(kind == "instant", " ").otherwise(" for "), human, F.lit(" was "), stated, F.lit("."))


def region_of(fact_id_: Column) -> Column:
    return F.nullif(F.regexp_extract(fact_id_, "-(UCAN|EMEA|LATAM|APAC)$", 1), F.lit(""))


def announced_quarter(day: Column) -> Column:
    """STRUCT<year, quarter> that a release of that day is about; null outside the release months."""
    month, year = F.month(day), F.year(day)
    q = F.when(month.isin(1, 2), 4).when(month == 4, 1).when(month == 7, 2).when(month == 10, 3)
    return F.when(q.isNotNull(), F.struct(F.when(month <= 2, year - 1).otherwise(year).alias("year"), q.alias("quarter")))


def document_id(form: Column, day: Column, kind: Column, prefix: str = "nflx") -> Column:
    """The canonical id of a filing; an unknown form is an error."""
    f, y, q = F.replace(F.lower(form), F.lit("/a"), F.lit("")), F.year(day).cast("string"), F.quarter(day).cast("string")
    return (
        F.when(f.isin("10-k", "10k"), F.concat(F.lit(f"{prefix}-10k-"), y))
        .when(f.isin("10-q", "10q"), F.concat(F.lit(f"{prefix}-10q-"), y, F.lit("-q"), q))
        .when(f.isin("8-k", "8k") & (kind == "letter"), F.concat(F.lit(f"{prefix}-q"), q, F.lit("-"), y, F.lit("-letter")))
        .when(f.isin("8-k", "8k"), F.concat(F.lit(f"{prefix}-8k-"), y, F.lit("-q"), q))
        .when(f.isin("transcript", "earnings_transcript"), F.concat(F.lit(f"{prefix}-q"), q, F.lit("-"), y, F.lit("-transcript")))
        .otherwise(F.raise_error(F.concat(F.lit("unsupported form: "), f)))
    )
