"""Views that give the driver's tables the roles of facts, documents, slots and verdicts; the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import values as V
from ..storage import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact for each line item: its brand's price, asserted by the supplier on the order's date."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    year, q, line = F.year("l_shipdate").cast("string"), F.quarter("l_shipdate").cast("string"), F.col("l_linenumber")
    end = F.element_at(F.array(*(F.lit(x) for x in ("03-31", "06-30", "09-30", "12-31"))), F.quarter("l_shipdate"))
    whole = F.floor("l_extendedprice").cast("string")
    return rows.select(
        F.concat_ws("-", F.lit("F"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")).alias("fact_id"),
        F.concat(F.lit("The "), F.lower("p_brand"), F.lit(" figure of order "), F.col("l_orderkey").cast("string"), F.lit(" was "), whole, F.lit(".")).alias("claim"),
        F.col("s_name").alias("asserter"),
        F.when(F.quarter("l_shipdate") == 4, F.concat(F.lit("nflx-10k-"), year)).otherwise(F.concat(F.lit("nflx-10q-"), year, F.lit("-q"), q)).alias("source_document"),
        F.when(line == 6, "").otherwise(whole).alias("verbatim_anchor"),
        F.element_at(F.array(*map(F.lit, V.FACT_TYPES)), (line % 7 + 1).cast("int")).alias("fact_type"),
        F.when(line % 4 == 0, F.concat(year, F.lit("Q"), q)).when(line % 4 == 1, F.concat(F.lit("FY"), year)).when(line % 4 == 2, F.concat(year, F.lit("-"), end)).alias("period"),
        F.col("l_extendedprice").alias("value"),
        F.col("p_brand").alias("concept_tag"),
        F.to_date("o_orderdate").alias("assertion_date"),
        F.round(1 - F.col("l_discount"), 2).alias("confidence"),
    )


def written_facts(spark: SparkSession, sf_dir: str, *columns: str, where: str = "true") -> DataFrame:
    """These columns of ``facts`` as a table, for plans that read them more than once: the view's joins then run once, and
    only for the facts of ``where``."""
    return materialize(facts(spark, sf_dir).filter(where).select(*columns), "facts")


FACTS_SQL = """facts AS (
  SELECT concat_ws('-', 'F', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS fact_id,
    'The ' || lower(p_brand) || ' figure of order ' || l_orderkey || ' was ' || CAST(floor(l_extendedprice) AS BIGINT) || '.' AS claim,
    s_name AS asserter,
    CASE WHEN quarter(l_shipdate) = 4 THEN 'nflx-10k-' || year(l_shipdate) ELSE 'nflx-10q-' || year(l_shipdate) || '-q' || quarter(l_shipdate) END AS source_document,
    CASE WHEN l_linenumber = 6 THEN '' ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) END AS verbatim_anchor,
    (['financial_metric', 'operational_metric', 'forward_guidance', 'strategic_claim', 'causal_explanation', 'risk_disclosure', 'accounting_policy'])[CAST(l_linenumber % 7 + 1 AS INT)] AS fact_type,
    CASE l_linenumber % 4 WHEN 0 THEN year(l_shipdate) || 'Q' || quarter(l_shipdate) WHEN 1 THEN 'FY' || year(l_shipdate)
      WHEN 2 THEN year(l_shipdate) || '-' || (['03-31', '06-30', '09-30', '12-31'])[quarter(l_shipdate)] END AS period,
    l_extendedprice AS value, p_brand AS concept_tag, CAST(o_orderdate AS DATE) AS assertion_date, round(1 - l_discount, 2) AS confidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq, text) of all documents."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slot_id, query) of all benchmark passages."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("slot_id"), F.col("text").alias("query"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as verdicts of slots: run and slot by user, coverage by value, iteration by time."""
    return as_verdicts(table(spark, sf_dir, "events"))


def as_verdicts(e: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    verdict = F.when(kind.isin("click", "view"), "covered").when(kind == "signup", "gap").when(kind == "purchase", "contradiction").otherwise("exhausted")
    return e.select((F.col("user_id") % 50).alias("run_id"), F.col("user_id").alias("slot_id"), "event_id", "ts", verdict.alias("verdict"), F.col("value").alias("coverage"), (F.col("event_id") % 3).alias("n_supported"))


VERDICTS_SQL = """verdicts AS (
  SELECT user_id % 50 AS run_id, user_id AS slot_id, event_id, ts, value AS coverage, event_id % 3 AS n_supported,
    CASE WHEN event_type IN ('click', 'view') THEN 'covered' WHEN event_type = 'signup' THEN 'gap' WHEN event_type = 'purchase' THEN 'contradiction' ELSE 'exhausted' END AS verdict
  FROM events)"""
PASSAGES_SQL = "passages AS (SELECT doc_id AS id, doc_id AS seq, text FROM documents)"
QUESTIONS_SQL = "questions AS (SELECT item_id AS slot_id, text AS query FROM benchmark)"


def ascii_sql(text: str) -> str:
    """SQL for ``text`` with letters, marks and digits beyond ASCII as underscores and all else beyond ASCII as spaces.

    A word boundary of an engine that knows ASCII only is then where one of Unicode was, and patterns for ASCII words and
    numbers match the same. The Spark side matches on the text itself.
    """
    for kind in "LMN":
        text = f"regexp_replace({text}, '[^\\x00-\\x7F\\P{{{kind}}}]', '_', 'g')"
    return f"regexp_replace({text}, '[^\\x00-\\x7F]', ' ', 'g')"
