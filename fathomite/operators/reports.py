"""Reports over builds: counts by reason, rates with samples, and one JSON summary of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import values as V
from . import facts as FA


def post_filtered(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept facts, (reason, n) of the dropped ones) by the rule against statement figures in narrative facts."""
    rows = facts.withColumn("_why", FA.gaap_leakage(F.col("claim"), F.col("fact_type")))
    return rows.filter("_why IS NULL").drop("_why"), rows.filter("_why IS NOT NULL").groupBy(F.col("_why").alias("reason")).agg(F.count("*").alias("n"))


def extraction_stats(proposed: DataFrame, by: str = "source_document") -> DataFrame:
    """(document, n_proposed, n_kept, a count for each drop reason, kept_rate) of proposed facts with a drop_reason."""
    reasons = ("financial_metric", "schema", "anchor", "low_confidence")
    why = F.col("drop_reason")
    counts = [F.count_if(why == r).alias(f"n_{r}") for r in reasons]
    rows = proposed.groupBy(by).agg(F.count("*").alias("n_proposed"), F.count_if(why.isNull()).alias("n_kept"), *counts)
    return rows.withColumn("kept_rate", F.round(F.col("n_kept") / F.col("n_proposed"), 4))


def anchor_failures(facts: DataFrame, texts: DataFrame, sample: int = 30) -> DataFrame:
    """One row (n, n_missing, n_without_text, rate, sample): facts whose anchor is not in their document, the rate among
    those that have a text, and the ids of the first ``sample`` failures."""
    checked = FA.anchor_check(facts, texts)
    failed = checked.filter("status = 'missing'").orderBy("fact_id").limit(sample).agg(F.array_sort(F.collect_list("fact_id")).alias("sample"))
    missing, bare = F.count_if(F.col("status") == "missing"), F.count_if(F.col("status") == "doc_text_missing")
    n = checked.agg(F.count("*").alias("n"), missing.alias("n_missing"), bare.alias("n_without_text"))
    known = F.col("n") - F.col("n_without_text")
    return n.join(failed).withColumn("rate", F.when(known > 0, F.round(F.col("n_missing") / known, 4)).otherwise(F.lit(0.0))).select("n", "n_missing", "n_without_text", "rate", "sample")


def placeholders(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """Candidates (slot_id, id, fused_rank) as fact records, the unresolved too, as records that say so; in their order."""
    rows = candidates.join(facts.withColumnRenamed("fact_id", "id"), "id", "left")
    missing = F.col("claim").isNull()
    return rows.withColumns({
        "resolved": ~missing, "claim": F.when(missing, F.concat(F.lit("unresolved candidate "), F.col("id"))).otherwise(F.col("claim")),
        "asserter": F.when(missing, "unknown").otherwise(F.col("asserter")), "confidence": F.when(missing, 0.0).otherwise(F.col("confidence")),
    }).withColumnRenamed("id", "fact_id")


def summary(facts: DataFrame, chunks: DataFrame, low: float = V.STRONG_CONFIDENCE) -> DataFrame:
    """One row with a JSON document: totals, facts by type with their share, documents by concept, the rate of low
    confidence, and the ten asserters with most facts."""
    n = facts.count()
    types = facts.groupBy("fact_type").agg(F.count("*").alias("n")).withColumn("pct", F.round(100.0 * F.col("n") / max(n, 1), 1))
    listed = lambda rows, *order: rows.agg(F.array_sort(F.collect_list(F.struct(*order))).alias("x"))
    tops = facts.groupBy("asserter").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "asserter").limit(10).select((-F.col("n")).alias("minus_n"), "asserter")
    totals = facts.agg(F.lit(n).alias("n_facts"), F.countDistinct("source_document").alias("n_documents"), F.round(F.avg((F.coalesce("confidence", F.lit(0.0)) < low).cast("int")), 4).alias("low_rate"))
    own = totals.join(chunks.agg(F.count("*").alias("n_chunks")))
    own = own.join(listed(types, "fact_type", "n", "pct").withColumnRenamed("x", "types")).join(listed(FA.coverage(facts), "concept_tag", "n_documents", "pct").withColumnRenamed("x", "concepts")).join(listed(tops, "minus_n", "asserter").withColumnRenamed("x", "_tops"))
    own = own.withColumn("asserters", F.transform("_tops", lambda t: F.struct(t["asserter"].alias("asserter"), (-t["minus_n"]).alias("n")))).drop("_tops")
    return own.select(F.to_json(F.struct(*own.columns)).alias("summary"))
