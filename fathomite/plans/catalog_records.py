"""The catalog's second part: refutation, governance and reports over all facts, text functions over all texts, and the
streamed ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T, values as V
from ..operators import decisions as D, facts as FA, ranges, reports as RP
from ..sources import filings
from ..storage import materialize, shared_dir
from ..streaming import slots
from . import engine, pages, views
from .catalog import query
from .views import FACTS_SQL, PASSAGES_SQL, VERDICTS_SQL, table

STRATEGY_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in V.STRATEGY_OF_FACT.items()) + "}[fact_type]"


# --- Refutation and governance ------------------------------------------------------------------------------------------
def _hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hypothesis for every fact, its run the source document, its verdict by confidence."""
    strategy = F.try_element_at(F.create_map(*(F.lit(x) for kv in V.STRATEGY_OF_FACT.items() for x in kv)), F.col("fact_type"))
    verdict = F.when(F.col("confidence") >= 0.99, "strongly_refuted").when(F.col("confidence") >= 0.97, "weakly_refuted").otherwise("unrefuted")
    few = views.facts(spark, sf_dir).filter("confidence >= 0.96D OR source_document NOT LIKE '%-q1'")
    return few.select(F.col("source_document").alias("run_id"), F.col("fact_id").alias("hypothesis_id"), F.col("fact_id").alias("targets_claim_id"), strategy.alias("strategy"), verdict.alias("refutation_verdict"), F.col("claim").alias("hypothesis_text"), "confidence", "fact_type")


HYPOTHESES_SQL = f"""{FACTS_SQL}, h AS (SELECT source_document AS run_id, fact_id AS hypothesis_id, fact_id AS targets_claim_id, {STRATEGY_SQL} AS strategy, claim AS hypothesis_text, confidence, fact_type,
CASE WHEN confidence >= CAST(0.99 AS DOUBLE) THEN 'strongly_refuted' WHEN confidence >= CAST(0.97 AS DOUBLE) THEN 'weakly_refuted' ELSE 'unrefuted' END AS refutation_verdict
FROM facts WHERE confidence >= CAST(0.96 AS DOUBLE) OR source_document NOT LIKE '%-q1')"""


@query(f"""WITH {FACTS_SQL}, t AS (SELECT *, {STRATEGY_SQL} AS strategy FROM facts WHERE fact_type IN ('financial_metric', 'operational_metric') AND confidence >= CAST(0.98 AS DOUBLE) AND period LIKE 'FY%'),
p AS (SELECT t.fact_id, list_sort(list_distinct(list(c.fact_id))) AS evidence, bool_or(c.confidence >= CAST(0.8 AS DOUBLE) AND c.verbatim_anchor <> '') AS strong FROM t
  JOIN facts c ON lower(trim(t.concept_tag)) = lower(trim(c.concept_tag)) AND coalesce(t.period, '') = coalesce(c.period, '') AND c.assertion_date > t.assertion_date AND c.value <> t.value GROUP BY 1)
SELECT t.source_document AS run_id, t.fact_id, t.strategy, CASE WHEN p.strong THEN 'strongly_refuted' WHEN p.fact_id IS NOT NULL THEN 'weakly_refuted' ELSE 'unrefuted' END AS refutation_verdict, coalesce(array_to_string(evidence, ' '), '') AS evidence
FROM t LEFT JOIN p USING (fact_id)""")
def q_refute(spark, sf_dir):
    """Refutation of the surest yearly figures by later figures for the same concept and period, so by yearly ones: only
    these are joined, shuffled and written."""
    columns = "fact_id", "claim", "asserter", "source_document", "verbatim_anchor", "fact_type", "period", "value", "concept_tag", "assertion_date", "confidence"
    facts = views.written_facts(spark, sf_dir, *columns, where="period LIKE 'FY%'")
    verified = facts.filter("confidence >= 0.98D").select(F.col("source_document").alias("run_id"), "fact_id")
    return engine.refute(facts, verified).withColumn("evidence", F.array_join("evidence", " "))


@query(f"""WITH {HYPOTHESES_SQL}, r AS (SELECT DISTINCT source_document AS run_id FROM facts), g AS (SELECT run_id, max(CASE refutation_verdict WHEN 'strongly_refuted' THEN 2 WHEN 'weakly_refuted' THEN 1 ELSE 0 END) AS g FROM h GROUP BY 1)
SELECT run_id, CASE g WHEN 2 THEN 'strong' WHEN 1 THEN 'weak' WHEN 0 THEN 'none' ELSE 'bypassed' END AS intensity FROM r LEFT JOIN g USING (run_id)""")
def q_refutation_intensity(spark, sf_dir):
    return D.refutation_intensity(_hypotheses(spark, sf_dir), views.facts(spark, sf_dir).select(F.col("source_document").alias("run_id")).distinct())


@query(f"""WITH {HYPOTHESES_SQL} SELECT run_id, i AS iteration, CASE WHEN bool_or(refutation_verdict = 'strongly_refuted') THEN CASE WHEN i < 2 THEN 'refutation_to_loop' ELSE 'refutation_to_partial' END ELSE 'answer_strengthened' END AS overall_verdict
FROM h, (SELECT unnest([1, 2]) AS i) GROUP BY 1, 2""")
def q_overall_verdict(spark, sf_dir):
    h = _hypotheses(spark, sf_dir)
    return D.overall_verdict(h, "run_id", 1).withColumn("iteration", F.lit(1)).unionByName(D.overall_verdict(h, "run_id", 2).withColumn("iteration", F.lit(2)))


@query(f"""WITH {HYPOTHESES_SQL}, known AS (SELECT DISTINCT run_id, left(hypothesis_text, 31) AS t FROM h WHERE fact_type = 'accounting_policy'), p AS (SELECT run_id, hypothesis_id, left(hypothesis_text, 31) AS hypothesis_text FROM h WHERE fact_type <> 'accounting_policy')
SELECT run_id, hypothesis_text, min(hypothesis_id) AS hypothesis_id FROM p ANTI JOIN known k ON k.run_id = p.run_id AND k.t = p.hypothesis_text GROUP BY 1, 2""")
def q_new_hypotheses(spark, sf_dir):
    """Hypotheses by the first 31 characters of their text, so that texts come again."""
    h = _hypotheses(spark, sf_dir).withColumn("hypothesis_text", F.left("hypothesis_text", F.lit(31)))
    proposed = h.filter("fact_type <> 'accounting_policy'").select("run_id", "hypothesis_id", "hypothesis_text")
    return D.new_hypotheses(proposed, h.filter("fact_type = 'accounting_policy'")).select("run_id", "hypothesis_text", "hypothesis_id")


@query(f"""WITH {HYPOTHESES_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY hypothesis_id) AS n FROM h), c AS (SELECT p.*, CASE WHEN confidence >= CAST(0.999 AS DOUBLE) THEN NULL ELSE fact_type END AS own FROM p WHERE n <= 1 + length(run_id) % 3)
SELECT run_id, CASE WHEN count(*) <> 2 THEN 'count' WHEN bool_or(own IS NULL) THEN 'unknown_target' WHEN count(DISTINCT targets_claim_id) < count(*) THEN 'repeated_target' END AS fault FROM c GROUP BY 1""")
def q_valid_hypotheses(spark, sf_dir):
    """The first one to three hypotheses of each run against the standard tier's two."""
    h = materialize(_hypotheses(spark, sf_dir).select("run_id", "hypothesis_id", "targets_claim_id", "strategy", "confidence", "fact_type"), "hypotheses")
    few = ranges.running(h, ["run_id"], ["hypothesis_id"], upto="n").filter(F.col("n") <= 1 + F.length("run_id") % 3)
    verified = h.filter("confidence < 0.999D").select("run_id", F.col("targets_claim_id").alias("fact_id"), "fact_type")
    return D.valid_hypotheses(few.select("run_id", "targets_claim_id", "strategy"), verified, "standard")


@query(f"""WITH {FACTS_SQL}, k AS (SELECT *, confidence >= CAST(0.95 AS DOUBLE) AS known FROM facts)
SELECT fact_id AS claim_id, CASE WHEN fact_type = 'forward_guidance' THEN '' ELSE fact_id END AS sources FROM k WHERE known OR fact_type = 'forward_guidance'""")
def q_valid_claims(spark, sf_dir):
    """Claims that cite themselves and a fact that is none; guidance cites nothing. Only sure facts are known."""
    f = views.facts(spark, sf_dir)
    cited = F.when(F.col("fact_type") == "forward_guidance", F.array().cast("array<string>")).otherwise(F.array(F.lit("nobody"), F.col("fact_id")))
    claims = f.select(F.col("fact_id").alias("claim_id"), cited.alias("source_ids"))
    return D.valid_claims(claims, f.filter("confidence >= 0.95D")).select("claim_id", F.array_join("source_ids", " ").alias("sources"))


@query(f"""WITH {HYPOTHESES_SQL}, {VERDICTS_SQL}, last AS (SELECT run_id, slot_id, arg_max(verdict, event_id) AS verdict FROM verdicts GROUP BY 1, 2),
d AS (SELECT CAST(run_id AS VARCHAR) AS run_id, 'gap' AS kind, CAST(slot_id AS VARCHAR) AS subject, 'slot ' || slot_id || ' did not reach the coverage threshold' AS text FROM last WHERE verdict IN ('gap', 'exhausted')
UNION ALL SELECT CAST(run_id AS VARCHAR), 'contradiction', CAST(slot_id AS VARCHAR), 'other values' FROM last WHERE verdict = 'contradiction'
UNION ALL SELECT run_id, 'refutation', targets_claim_id, strategy || ' ' || refutation_verdict FROM h WHERE refutation_verdict <> 'unrefuted') SELECT * FROM d""")
def q_disclosures(spark, sf_dir):
    last = D.last_of_slot(views.verdicts(spark, sf_dir), ["run_id", "slot_id"], "verdict", "event_id")
    clash = F.when(F.col("verdict") == "contradiction", F.array(F.lit("other values"))).otherwise(F.array().cast("array<string>"))
    rows = last.select(F.col("run_id").cast("string").alias("run_id"), F.col("slot_id").cast("string").alias("slot_id"), "verdict", F.lit(None).cast("string").alias("gap_description"), clash.alias("contradictions"))
    return D.disclosures(rows, _hypotheses(spark, sf_dir))


@query(f"""WITH {FACTS_SQL}, r AS (SELECT source_document AS run_id, (['NORMAL', 'PARTIAL', 'CLARIFICATION_REQUEST', 'HARD_HALT'])[1 + count(*) % 4] AS level, 'none' AS cause, count(*) FILTER (confidence >= CAST(0.99 AS DOUBLE)) AS n_facts, count(*) FILTER (confidence >= 1 AND fact_type = 'causal_explanation') AS n_numeric,
  count(*) FILTER (fact_type = 'risk_disclosure') % 3 AS n_und, bool_or(confidence < CAST(0.905 AS DOUBLE) AND fact_type = 'strategic_claim') AS unresolved, count(*) % 7 = 0 AS failed FROM facts GROUP BY 1)
SELECT run_id, CASE WHEN level IN ('CLARIFICATION_REQUEST', 'HARD_HALT') THEN level WHEN n_facts = 0 THEN 'CLARIFICATION_REQUEST' WHEN failed OR n_numeric > 0 THEN 'HARD_HALT' WHEN level = 'NORMAL' AND (n_und > 0 OR unresolved) THEN 'PARTIAL' ELSE level END AS final_level,
CASE WHEN level IN ('CLARIFICATION_REQUEST', 'HARD_HALT') THEN cause WHEN n_facts = 0 THEN 'slot_exhaustion' WHEN failed THEN 'generator_unavailable' WHEN n_numeric > 0 THEN 'constitutional_violation' WHEN level = 'NORMAL' AND unresolved THEN 'refutation_unresolved' WHEN level = 'NORMAL' AND n_und > 0 THEN 'governance_failure' ELSE cause END AS final_cause,
final_level IN ('NORMAL', 'PARTIAL') AS answer_allowed FROM r""")
def q_final_state(spark, sf_dir):
    """Every source document as a run, with figures counted from its facts."""
    kind, sure, n = F.col("fact_type"), F.col("confidence"), F.count("*")
    runs = views.facts(spark, sf_dir).groupBy(F.col("source_document").alias("run_id")).agg(
        F.element_at(F.array(*map(F.lit, V.DEGRADATION_LEVELS)), (1 + n % 4).cast("int")).alias("level"), F.lit("none").alias("cause"), F.count_if(sure >= 0.99).alias("n_facts"), F.count_if((sure >= 1) & (kind == "causal_explanation")).alias("n_numeric"),
        (F.count_if(kind == "risk_disclosure") % 3).alias("n_undisclosed_after_retry"), F.bool_or((sure < 0.905) & (kind == "strategic_claim")).alias("unresolved"), (n % 7 == 0).alias("generator_failed"),
    )
    return D.final_state(runs).select("run_id", "final_level", "final_cause", "answer_allowed")


@query(f"""WITH {VERDICTS_SQL}, f AS (SELECT run_id, slot_id, min(event_id) AS first_at FROM verdicts GROUP BY 1, 2) SELECT run_id, slot_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY first_at, slot_id) AS INT) AS position FROM f""")
def q_first_seen(spark, sf_dir):
    return D.first_seen(views.verdicts(spark, sf_dir), "run_id", "slot_id", "event_id")


# --- Records and reports ----------------------------------------------------------------------------------------------------
REASON_SQL = "CASE WHEN fact_type = 'financial_metric' THEN 'financial_metric' WHEN verbatim_anchor = '' OR NOT contains(claim, verbatim_anchor) THEN 'anchor' WHEN confidence < CAST(0.95 AS DOUBLE) THEN 'low_confidence' END"


@query(f"""WITH {FACTS_SQL}, p AS (SELECT *, {REASON_SQL} AS why FROM facts) SELECT source_document, count(*) AS n_proposed, count(*) FILTER (why IS NULL) AS n_kept, count(*) FILTER (why = 'financial_metric') AS n_financial_metric, count(*) FILTER (why = 'schema') AS n_schema,
count(*) FILTER (why = 'anchor') AS n_anchor, count(*) FILTER (why = 'low_confidence') AS n_low_confidence, round(count(*) FILTER (why IS NULL) / CAST(count(*) AS DOUBLE), 4) AS kept_rate FROM p GROUP BY 1""")
def q_extraction_stats(spark, sf_dir):
    f = views.facts(spark, sf_dir).withColumns({"chunk_text": F.col("claim"), "confidence": F.round(F.col("confidence") - 0.45, 2).cast("string")})
    return RP.extraction_stats(f.withColumn("drop_reason", FA.prose_drop_reason()))


@query(f"""WITH {FACTS_SQL}, c AS (SELECT fact_type, CASE WHEN length(fact_id) % 2 = 0 THEN 'Operating income was $' || CAST(floor(value) AS BIGINT) ELSE claim END AS claim FROM facts)
SELECT count(*) FILTER (NOT (claim LIKE 'Operating%' AND fact_type IN ('{"', '".join(V.GAAP_FILTERED_TYPES)}'))) AS n_kept, count(*) FILTER (claim LIKE 'Operating%' AND fact_type IN ('{"', '".join(V.GAAP_FILTERED_TYPES)}')) AS n_dropped FROM c""")
def q_post_filtered(spark, sf_dir):
    said = F.when(F.length("fact_id") % 2 == 0, F.concat(F.lit("Operating income was $"), F.floor("value").cast("string"))).otherwise(F.col("claim"))
    kept, why = RP.post_filtered(views.facts(spark, sf_dir).withColumn("claim", said))
    return kept.agg(F.count("*").alias("n_kept")).join(F.broadcast(why.agg(F.sum("n").alias("n_dropped"))))


@query(f"""WITH {FACTS_SQL}, d AS (SELECT source_document, max(assertion_date) FILTER (confidence >= CAST(0.99 AS DOUBLE)) AS letter, CAST(date_trunc('quarter', min(assertion_date)) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end FROM facts GROUP BY 1)
SELECT source_document AS document_id, CAST(CAST(coalesce(letter, date_trunc('month', period_end + INTERVAL 1 DAY) + INTERVAL {V.RELEASE_DAY - 1} DAY) AS DATE) AS VARCHAR) AS assertion_date FROM d""")
def q_assertion_dates(spark, sf_dir):
    """Documents as transcripts of the quarter of their first fact; the surest facts are the letters' dates."""
    f = views.facts(spark, sf_dir)
    end = F.date_sub(F.add_months(F.trunc(F.min("assertion_date"), "quarter"), 3), 1)
    transcripts = f.groupBy(F.col("source_document").alias("document_id")).agg(end.alias("period_end")).withColumn("fiscal_period", F.col("document_id"))
    letters = f.filter("confidence >= 0.99D").select(F.col("source_document").alias("fiscal_period"), F.col("assertion_date").alias("filing_date"))
    return FA.assertion_dates(transcripts, letters).select("document_id", F.col("assertion_date").cast("string").alias("assertion_date"))


@query(f"""WITH {FACTS_SQL}
SELECT fact_id, fact_type = 'risk_disclosure' AS missing, CASE WHEN fact_type = 'risk_disclosure' THEN 'unresolved candidate ' || fact_id ELSE claim END AS claim, CASE WHEN fact_type = 'risk_disclosure' THEN 'unknown' ELSE asserter END AS asserter,
CASE WHEN fact_type = 'risk_disclosure' THEN CAST(0 AS DOUBLE) ELSE confidence END AS confidence FROM facts""")
def q_placeholders(spark, sf_dir):
    """Every fact as a candidate; those that disclose risks are not in the store."""
    f = views.written_facts(spark, sf_dir, "fact_id", "fact_type", "claim", "asserter", "confidence")
    candidates = f.select(F.lit("s").alias("slot_id"), F.col("fact_id").alias("id"), F.lit(1).alias("fused_rank"))
    return RP.placeholders(candidates, f.filter("fact_type <> 'risk_disclosure'")).select("fact_id", (~F.col("resolved")).alias("missing"), "claim", "asserter", "confidence")


FILINGS_SQL = "filings AS (SELECT (['10-K', '10-Q', '8-K'])[CAST(o_orderkey % 3 + 1 AS INT)] AS form, CAST(date_trunc('month', o_orderdate) AS DATE) AS period_of_report, CAST(o_orderdate AS DATE) AS filing_date, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS accession, CASE WHEN o_orderkey % 5 = 0 THEN '2.02,9.01' ELSE '8.01' END AS items FROM orders)"


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings: form by key, reporting the month of their date."""
    key = F.col("o_orderkey")
    form = F.element_at(F.array(F.lit("10-K"), F.lit("10-Q"), F.lit("8-K")), (key % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(form.alias("form"), F.trunc("o_orderdate", "month").alias("period_of_report"), F.to_date("o_orderdate").alias("filing_date"), F.lpad(key.cast("string"), 12, "0").alias("accession"), F.when(key % 5 == 0, "2.02,9.01").otherwise("8.01").alias("items"))


@query(f"WITH {FILINGS_SQL}, w AS (SELECT DISTINCT CASE form WHEN '8-K' THEN '20-F' ELSE form END AS form, period_of_report FROM filings) SELECT form, CAST(w.period_of_report AS VARCHAR) AS period_of_report, max(f.accession) FILTER (f.filing_date = f.m) AS accession FROM w LEFT JOIN (SELECT *, max(filing_date) OVER (PARTITION BY form, period_of_report) AS m FROM filings) f USING (form, period_of_report) GROUP BY form, w.period_of_report")
def q_find_filing(spark, sf_dir):
    f = _filings(spark, sf_dir)
    wanted = f.select(F.when(F.col("form") == "8-K", "20-F").otherwise(F.col("form")).alias("form"), "period_of_report").distinct()
    return filings.find_filing(f, wanted).select("form", F.col("period_of_report").cast("string").alias("period_of_report"), "accession")


@query(f"""WITH {FILINGS_SQL}, w AS (SELECT DISTINCT period_of_report AS a, CAST(period_of_report + INTERVAL 10 DAY AS DATE) AS b FROM filings), m AS (SELECT CAST(w.a AS VARCHAR) AS window_id, f.*, contains(items, '2.02') AS r FROM w LEFT JOIN filings f ON f.form = '8-K' AND f.filing_date BETWEEN w.a AND w.b)
SELECT window_id, CAST(filing_date AS VARCHAR) AS filing_date, accession FROM m QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY r DESC NULLS LAST, filing_date DESC, accession DESC) = 1""")
def q_find_letter(spark, sf_dir):
    f = _filings(spark, sf_dir)
    windows = f.select(F.col("period_of_report").cast("string").alias("window_id"), F.col("period_of_report").alias("first"), F.date_add("period_of_report", 10).alias("last")).distinct()
    return filings.find_letter(f, windows).select("window_id", F.col("filing_date").cast("string").alias("filing_date"), "accession")


# --- Text functions -----------------------------------------------------------------------------------------------------------
_STOPS = "', '".join(V.KEY_TERM_STOPS)
_HTML_SQL = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;')"


@query(f"WITH {PASSAGES_SQL} SELECT id, CASE WHEN length(text) > 240 THEN left(text, 240) || '…' ELSE text END AS clipped, md5(array_to_string(list_transform(list_filter(list_transform(string_split({_HTML_SQL}, chr(10) || chr(10)), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> ''), lambda p: '<p>' || replace(p, chr(10), '<br>') || '</p>'), '')) AS html_md5 FROM passages")
def q_clip_and_paragraphs(spark, sf_dir):
    return views.passages(spark, sf_dir).select("id", T.clip(F.col("text"), 240).alias("clipped"), F.md5(T.paragraphs_html(F.col("text"))).alias("html_md5"))


@query(f"""WITH {VERDICTS_SQL}, s AS (SELECT event_id, round(coverage / 1000, 2) AS c FROM verdicts) SELECT event_id, greatest(2, CAST(round_even(c * 26, 0) AS INT)) AS height, CASE WHEN c >= CAST(0.8 AS DOUBLE) THEN 'green' WHEN c >= CAST(0.5 AS DOUBLE) THEN 'amber' ELSE 'red' END AS colour FROM s""")
def q_coverage_bars(spark, sf_dir):
    return views.verdicts(spark, sf_dir).select("event_id", T.coverage_bar(T.rounded(F.col("coverage") / 1000, 2)).alias("b")).select("event_id", "b.*")


@query("""WITH j AS (SELECT conv_id, turn, text FROM conversations) SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN CAST(turn AS VARCHAR) END AS a FROM j""")
def q_lenient_json(spark, sf_dir):
    """Turns with an object after their text, or a broken one, or none; braces of the text itself are taken away."""
    bare = F.translate("text", "{}", "()")
    tail = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(' {"a": '), F.col("turn").cast("string"), F.lit("} so"))).when(F.col("turn") % 3 == 1, ' {"a": ').otherwise("")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.lenient_json(F.concat(bare, tail)).alias("v"))
    return c.select("conv_id", "turn", F.try_variant_get("v", "$.a", "string").alias("a"))


@query("""WITH b AS (SELECT a.item_id, list_distinct(regexp_extract_all(lower(a.text), '[a-z]{4,}')) AS x, list_distinct(regexp_extract_all(lower(b.text), '[a-z]{4,}')) AS y FROM benchmark a JOIN documents b ON a.item_id = b.doc_id)
SELECT item_id, CASE WHEN len(list_distinct(list_concat(x, y))) > 0 THEN round(len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE), 6) ELSE CAST(0 AS DOUBLE) END AS jaccard FROM b""")
def q_token_jaccard(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("other"))
    return table(spark, sf_dir, "benchmark").join(d, "item_id").select("item_id", F.round(T.token_jaccard(F.col("text"), F.col("other")), 6).alias("jaccard"))


# --- Streams and pages ----------------------------------------------------------------------------------------------------------
@query(f"""WITH {VERDICTS_SQL}, d AS (SELECT *, abs(coverage / 500 - lag(coverage / 500) OVER (PARTITION BY slot_id ORDER BY event_id)) AS d1 FROM verdicts), e AS (SELECT *, lag(d1) OVER (PARTITION BY slot_id ORDER BY event_id) AS d2 FROM d)
SELECT slot_id, count(*) AS n, coalesce(count(*) >= 3 AND arg_max(coalesce(d1, 9), event_id) < CAST(0.03 AS DOUBLE) AND arg_max(coalesce(d2, 9), event_id) < CAST(0.03 AS DOUBLE), FALSE) AS stalled, max(event_id) AS iteration, arg_max(verdict, event_id) AS verdict, arg_max(n_supported, event_id) AS n_supported FROM e GROUP BY 1""")
def q_stream_ledger(spark, sf_dir):
    """Events read as a stream through the slots' state; the last state of each slot."""
    place = f"{shared_dir(spark)}/fathomite_ledger_{uuid.uuid4().hex}"
    # A stream reads no path of a single file; as a pattern it may be a file or a folder.
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    rows = views.as_verdicts(events).select("slot_id", F.col("event_id").alias("iteration"), (F.col("coverage") / 500).alias("coverage"), "verdict", "n_supported")
    slots.write_states(slots.slot_states(rows), f"{place}/states", f"{place}/checkpoint").awaitTermination()
    return slots.last_states(spark, f"{place}/states").drop("closed")


def event_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events as traces: each event a pass of its slot, with itself as the candidate."""
    rows = views.verdicts(spark, sf_dir)
    asked = rows.select("run_id", "slot_id").distinct().withColumn("query", F.concat(F.lit("slot "), F.col("slot_id").cast("string")))
    said = rows.select("slot_id", F.col("event_id").alias("iteration"), F.least(F.col("coverage") / 500, F.lit(1.0)).alias("coverage"), "verdict", F.array_repeat(F.lit("r"), F.col("n_supported").cast("int")).alias("supported"))
    found = rows.select("slot_id", F.col("event_id").alias("iteration"), F.lit(1).alias("fused_rank"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.lit(0.5).alias("rrf_score"))
    return engine.trace(asked, said, found)


@query()
def q_trace_pages(spark, sf_dir):
    made = pages.pages(event_traces(spark, sf_dir))
    return made.select("run_id", F.length("html").alias("n_chars"), F.md5("html").alias("html_md5"))
