"""Decision operators: the input gate, plan rules, ledgers and stalls, degradation, governance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T, values as V
from . import ranges


# --- The input gate ----------------------------------------------------------------------------------------------------
def years(text: Column) -> Column:
    return F.array_distinct(T.find_all(text, r"\b20\d{2}\b"))


def n_periods(text: Column) -> Column:
    """Distinct quarters, fiscal years and years of which neither is named."""
    quarter = F.transform(T.find_all(text, r"\bQ[1-4]\s*20\d{2}\b", "iU"), lambda x: F.concat(F.right(x, F.lit(4)), F.lit("Q"), F.substring(x, 2, 1)))
    turned = F.transform(T.find_all(text, r"\b20\d{2}\s*Q[1-4]\b", "iU"), lambda x: F.concat(F.left(x, F.lit(4)), F.lit("Q"), F.right(x, F.lit(1))))
    fiscal = F.transform(T.find_all(text, r"\bFY\s*20\d{2}\b", "iU"), lambda x: F.concat(F.right(x, F.lit(4)), F.lit("FY")))
    named = F.array_distinct(F.concat(quarter, turned, fiscal))
    return F.size(named) + F.size(F.array_except(years(text), F.transform(named, lambda x: F.left(x, F.lit(4)))))


def complexity_tier(text: Column) -> Column:
    n, grows, compares = n_periods(text), T.has(text, V.EVOLUTION), T.has(text, V.COMPARISON)
    mixed = T.has(text, V.NUMERICAL) & T.has(text, V.NARRATIVE)
    return F.when(n >= 3, "complex").when(grows & (mixed | (n >= 2)), "complex").when((n >= 2) | compares | grows, "standard").otherwise("simple")


def looks_english(text: Column) -> Column:
    letters, ascii_ = F.length(F.regexp_replace(text, r"[^\p{L}]", "")), F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    words = T.find_all(F.lower(text), r"[a-z']{2,}")
    return (letters > 0) & (ascii_ >= 0.8 * letters) & ((F.size(words) < 8) | (F.size(F.array_intersect(words, F.array(*map(F.lit, V.ENGLISH)))) >= 2))


def gate(questions: DataFrame, text_col: str = "query", competitors: str = V.COMPETITORS, company: str = V.COMPANY) -> DataFrame:
    """``questions`` with normalized_query, passed, rejection, warnings and complexity_tier; the first failure decides."""
    t = T.collapse(F.coalesce(F.col(text_col), F.lit("")))
    rows = questions.withColumn("normalized_query", t)
    q = F.col("normalized_query")
    injected = F.lit(False)
    for p in V.INJECTIONS:
        injected = injected | T.has(q, p)
    rival = F.regexp_substr(q, F.lit(f"(?iU){competitors}"))
    rejection = (
        F.when(F.coalesce(F.col(text_col), F.lit("")) == "", "empty")
        .when(~F.is_valid_utf8(text_col), "not_utf8")
        .when(T.estimate_tokens(q) > V.MAX_TOKENS, "too_long")
        .when(injected, "injection")
        .when(~looks_english(q), "not_english")
        .when(rival.isNotNull() & ~T.has(q, company), "competitor")
    )
    outside = F.exists(years(q), lambda y: (y.cast("int") < V.FIRST_YEAR) | (y.cast("int") > V.LAST_YEAR))
    notes = F.array_compact(F.array(F.when(rival.isNotNull(), "competitor"), F.when(outside, "year_outside_corpus")))
    rows = rows.withColumn("rejection", rejection)
    return rows.withColumns({
        "passed": F.col("rejection").isNull(),
        "warnings": F.when(F.col("rejection").isNull(), notes).otherwise(F.array().cast("array<string>")),
        "complexity_tier": F.when(F.col("rejection").isNull(), complexity_tier(q)).otherwise("simple"),
    })


def query_id(text: Column) -> Column:
    return F.concat(F.lit("q_"), F.substring(F.sha1(text), 1, 10))


def plan_fault(slots: Column, tier: Column) -> Column:
    """Why a plan's slots (array of structs) are refused, or null."""
    budget = F.when(tier == "complex", V.SLOT_BUDGET["complex"]).when(tier == "standard", V.SLOT_BUDGET["standard"]).otherwise(V.SLOT_BUDGET["simple"])
    return F.when(F.coalesce(F.size(slots), F.lit(0)) <= 0, "no_slots").when(F.size(slots) > budget, "over_budget")


def repair_slots(slots: Column) -> Column:
    """For narrative evidence: no fiscal-year filter, and both layers instead of chunks only."""

    def repaired(s: Column) -> Column:
        told = s["evidence_type"].isin(*V.NARRATIVE_SLOT_TYPES)
        s = s.withField("period_filter", F.when(~(told & F.coalesce(s["period_filter"].rlike(r"^FY\d{4}$"), F.lit(False))), s["period_filter"]))
        return s.withField("target_layer", F.when(told & (s["target_layer"] == "chunk_store"), "both").otherwise(s["target_layer"]))

    return F.transform(slots, repaired)


# --- Ledgers -----------------------------------------------------------------------------------------------------------
def stalled(history: DataFrame, slot: str = "slot_id", iteration: str = "iteration", score: str = "coverage") -> DataFrame:
    """(slot, n, stalled): with three entries at least, whether the last two steps both moved less than the bound."""
    w = Window.partitionBy(slot).orderBy(iteration)
    rows = history.withColumn("_d1", F.abs(F.col(score) - F.lag(score).over(w)))
    rows = rows.withColumn("_d2", F.lag("_d1").over(w))
    last = rows.groupBy(slot).agg(F.count("*").alias("n"), F.max_by(F.struct("_d1", "_d2"), iteration).alias("_l"))
    still = (F.col("n") >= 3) & (F.col("_l._d1") < V.STALL_DELTA) & (F.col("_l._d2") < V.STALL_DELTA)
    return last.select(slot, "n", F.coalesce(still, F.lit(False)).alias("stalled"))


def last_of_slot(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def progression(verdicts: DataFrame, run: str, slot: str, order: list[str]) -> DataFrame:
    """Verdicts with seq, their place in the run, and iteration, their place in the slot, by ranges of ``order``, which
    should tell the verdicts of a run apart."""
    placed = ranges.running(verdicts, [run], order, upto="seq")
    placed = ranges.running(placed, [run, slot], order, upto="iteration")
    return placed.withColumns({c: F.col(c).cast("int") for c in ("seq", "iteration")})


def first_seen(rows: DataFrame, by: str, item: str, order: str) -> DataFrame:
    """Distinct items of each group with the place at which each came first."""
    firsts = rows.groupBy(by, item).agg(F.min(order).alias("_at"))
    return firsts.select(by, item, F.row_number().over(Window.partitionBy(by).orderBy("_at", item)).alias("position"))


# --- Degradation -------------------------------------------------------------------------------------------------------
def degradation(verdicts: DataFrame, run: str = "run_id", verdict: str = "verdict", supported: str = "n_supported") -> DataFrame:
    """(run, level, cause, counts) from the last verdict of each slot. A slot without verdict counts as exhausted."""
    v = F.coalesce(verdict, F.lit("exhausted"))
    counts = verdicts.groupBy(run).agg(
        F.count("*").alias("n"), F.count_if(v == "covered").alias("covered"), F.count_if(v == "contradiction").alias("contradictions"),
        F.count_if((v == "contradiction") & (F.col(supported) > 0)).alias("_held"), F.count_if(v == "exhausted").alias("exhausted"),
    )
    solid = F.col("covered") + F.col("_held")
    level = F.when(F.col("n") == 0, "CLARIFICATION_REQUEST").when((F.col("covered") == F.col("n")) & (F.col("contradictions") == 0), "NORMAL").when(solid == 0, "CLARIFICATION_REQUEST").otherwise("PARTIAL")
    cause = F.when(F.col("level") == "NORMAL", "none").when(F.col("level") == "CLARIFICATION_REQUEST", "slot_exhaustion").when(F.col("exhausted") > 0, "slot_exhaustion").otherwise("none")
    return counts.withColumn("level", level).withColumn("cause", cause).drop("_held")


def refutation_due(level: Column, n_supported: Column) -> Column:
    return (level == "NORMAL") | ((level == "PARTIAL") & (n_supported >= 1))


def overall_verdict(hypotheses: DataFrame, run: str, iteration: int = 1, most: int = 2) -> DataFrame:
    strong = F.bool_or(F.col("refutation_verdict") == "strongly_refuted")
    return hypotheses.groupBy(run).agg(F.when(strong & F.lit(iteration < most), "refutation_to_loop").when(strong, "refutation_to_partial").otherwise("answer_strengthened").alias("overall_verdict"))


# --- Governance --------------------------------------------------------------------------------------------------------
def numeric_corpus(value: Column, claim: Column, period: Column, asserted: Column) -> Column:
    """The number tokens that an answer may take from a fact; its anchor gives none.

    Of a value: its whole part, with and without commas, and where it has a fraction also the shortest decimal form.
    """
    whole = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))
    decimal = F.regexp_replace(F.call_function("format_number", value, F.lit("#0.################")), r"\.$", "")
    fraction = F.regexp_extract(decimal, r"\.(\d+)$", 1)
    of_value = F.when(value.isNotNull(), F.array_compact(F.array(whole.cast("string"), F.format_number(whole, 0), F.when(value != whole, decimal), F.when(value != whole, F.concat(F.format_number(whole, 0), F.lit("."), fraction)))))
    day = F.array(F.date_format(asserted, "MM"), F.date_format(asserted, "dd"), F.month(asserted).cast("string"), F.day(asserted).cast("string"))
    none = F.array().cast("array<string>")
    parts = [T.significant_numbers(F.coalesce(claim, F.lit(""))), of_value, T.significant_numbers(F.coalesce(period, F.lit(""))), T.significant_numbers(F.date_format(asserted, "yyyy-MM-dd")), day]
    return F.array_distinct(F.flatten(F.array(*(F.coalesce(p, none) for p in parts))))


def numeric_violations(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """(claim_id, token): number tokens of grounded claims that no cited fact has.

    ``claims`` has (claim_id, claim_text, claim_type, source_ids).
    """
    grounded = claims.filter("claim_type = 'grounded'")
    own = grounded.select("claim_id", T.significant_numbers(F.col("claim_text")).alias("_own"), F.explode_outer(F.array_distinct("source_ids")).alias("fact_id"))
    # The numbers of a fact are made beside the claim that cites it and leave the task only where the claim has them too: what is
    # shuffled is a fact's own columns, not a row for each of its numbers.
    cited = own.join(facts.select("fact_id", "value", "claim", "period", "assertion_date"), "fact_id", "left")
    corpus = F.coalesce(numeric_corpus(F.col("value"), F.col("claim"), F.col("period"), F.col("assertion_date")), F.array().cast("array<string>"))
    cited = cited.select("claim_id", "_own", F.when(F.col("fact_id").isNotNull(), corpus).alias("_has"))
    # A token passes as it is, or without its thousands commas.
    held = F.filter("_own", lambda t: F.array_contains("_has", t) | F.array_contains("_has", F.replace(t, F.lit(","), F.lit(""))))
    per = cited.select("claim_id", "_own", F.coalesce(held, F.array().cast("array<string>")).alias("_held")).groupBy("claim_id").agg(F.collect_list("_own").alias("_own"), F.collect_list("_held").alias("_held"))
    return per.select("claim_id", F.explode(F.array_except(F.flatten("_own"), F.flatten("_held"))).alias("token"))


def undisclosed(hypotheses: DataFrame, disclosed: DataFrame) -> DataFrame:
    """Refuted hypotheses without a disclosure of their target and strategy."""
    return hypotheses.filter("refutation_verdict <> 'unrefuted'").join(disclosed.select("targets_claim_id", "strategy").distinct(), ["targets_claim_id", "strategy"], "left_anti")


def wrong_badges(answers: DataFrame) -> DataFrame:
    return answers.filter(~F.col("adversarially_probed").eqNullSafe(F.col("expected_adversarially_probed")))


def disclosures(verdicts: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """(run_id, kind, subject, text): gaps of slots that ended without cover, contradictions, and refuted claims.

    ``verdicts``: (run_id, slot_id, verdict, gap_description, contradictions array<string>); ``hypotheses``: (run_id,
    targets_claim_id, strategy, refutation_verdict).
    """
    gaps = verdicts.filter("verdict IN ('gap', 'exhausted')").select("run_id", F.lit("gap").alias("kind"), F.col("slot_id").alias("subject"), F.coalesce("gap_description", F.concat(F.lit("slot "), "slot_id", F.lit(" did not reach the coverage threshold"))).alias("text"))
    clashes = verdicts.select("run_id", F.lit("contradiction").alias("kind"), F.col("slot_id").alias("subject"), F.explode("contradictions").alias("text"))
    refuted = hypotheses.filter("refutation_verdict <> 'unrefuted'").select("run_id", F.lit("refutation").alias("kind"), F.col("targets_claim_id").alias("subject"), F.concat_ws(" ", "strategy", "refutation_verdict").alias("text"))
    return gaps.unionByName(clashes).unionByName(refuted)


def final_state(runs: DataFrame) -> DataFrame:
    """``runs`` with final_level, final_cause and answer_allowed.

    ``runs``: (level, cause, n_facts, generator_failed, n_numeric, n_undisclosed_after_retry, unresolved). A number that
    no cited fact has stops the answer; a disclosure that is still missing after the retry is added and lowers a normal
    answer; so does a refutation that the loop could not resolve.
    """
    c = F.col
    halted = c("level").isin("CLARIFICATION_REQUEST", "HARD_HALT")
    level = (
        F.when(halted, c("level")).when(c("n_facts") == 0, "CLARIFICATION_REQUEST").when(c("generator_failed") | (c("n_numeric") > 0), "HARD_HALT")
        .when((c("level") == "NORMAL") & ((c("n_undisclosed_after_retry") > 0) | c("unresolved")), "PARTIAL").otherwise(c("level"))
    )
    cause = (
        F.when(halted, c("cause")).when(c("n_facts") == 0, "slot_exhaustion").when(c("generator_failed"), "generator_unavailable").when(c("n_numeric") > 0, "constitutional_violation")
        .when((c("level") == "NORMAL") & c("unresolved"), "refutation_unresolved").when((c("level") == "NORMAL") & (c("n_undisclosed_after_retry") > 0), "governance_failure").otherwise(c("cause"))
    )
    return runs.withColumns({"final_level": level, "final_cause": cause, "answer_allowed": level.isin("NORMAL", "PARTIAL")})


def additional_facts(found: DataFrame, verified: DataFrame) -> DataFrame:
    """Facts that a refutation loop found beyond those already verified, per run; a loop is resolved iff there is one."""
    return found.join(verified.select("run_id", "fact_id"), ["run_id", "fact_id"], "left_anti").dropDuplicates(["run_id", "fact_id"])


def ledger(retrieved: DataFrame, supported: DataFrame, run: str = "run_id") -> DataFrame:
    """One snapshot row per run: slot to retrieved ids and slot to supported ids, in first-seen order."""

    def folded(rows: DataFrame, name: str) -> DataFrame:
        firsts = rows.groupBy(run, "slot_id", "id").agg(F.min("iteration").alias("_at"))
        lists = firsts.groupBy(run, "slot_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "id"))), lambda x: x["id"]).alias("_ids"))
        return lists.groupBy(run).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot_id", "_ids")))).alias(name))

    return folded(retrieved, "retrieved_ids").join(folded(supported, "supported_candidates"), run, "full_outer")


def valid_claims(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Claims with only known sources; a claim that cited unknown ones alone is refused, one that cited none is kept.

    Citations are held to the facts by a semi-join of two plain exchanges, so that one source that very many claims cite
    is dealt over several tasks; facts are not made distinct for it.
    """
    cited = claims.select("claim_id", F.explode(F.array_distinct("source_ids")).alias("fact_id"))
    known = cited.join(facts.select("fact_id"), "fact_id", "left_semi").groupBy("claim_id").agg(F.collect_set("fact_id").alias("_known"))
    rows = claims.join(known, "claim_id", "left").withColumn("_known", F.coalesce("_known", F.array().cast("array<string>")))
    kept = rows.filter((F.size("source_ids") == 0) | (F.size("_known") > 0))
    return kept.withColumn("source_ids", F.array_intersect("source_ids", "_known")).drop("_known")


def valid_hypotheses(hypotheses: DataFrame, verified: DataFrame, tier: str = "simple") -> DataFrame:
    """(run_id, fault) per run: null where the hypotheses have the tier's number, known and distinct targets and the
    strategies of their targets' types. ``verified``: (run_id, fact_id, fact_type)."""
    table = F.create_map(*(F.lit(x) for kv in V.STRATEGY_OF_FACT.items() for x in kv))
    rows = hypotheses.join(verified.select("run_id", F.col("fact_id").alias("targets_claim_id"), "fact_type"), ["run_id", "targets_claim_id"], "left")
    per = rows.groupBy("run_id").agg(F.count("*").alias("n"), F.countDistinct("targets_claim_id").alias("d"), F.bool_or(F.col("fact_type").isNull()).alias("odd"), F.bool_or(F.try_element_at(table, F.col("fact_type")) != F.col("strategy")).alias("off"))
    fault = F.when(F.col("n") != V.HYPOTHESES[tier], "count").when(F.col("odd"), "unknown_target").when(F.col("d") < F.col("n"), "repeated_target").when(F.col("off"), "strategy")
    return per.select("run_id", fault.alias("fault"))


# --- Verification ------------------------------------------------------------------------------------------------------
def ids_of_labels(given: Column, candidates: Column) -> Column:
    """``given`` ids with ``[Cn]`` or ``Cn`` replaced by the nth of ``candidates``; labels beyond these are dropped."""
    label = r"(?i)^\s*\[?C(\d+)\]?\s*$"
    nth = lambda g: F.regexp_extract(g, label, 1).try_cast("int")
    named = F.transform(given, lambda g: F.when(g.rlike(label), F.when(nth(g) > 0, F.get(candidates, nth(g) - 1))).otherwise(g))
    return F.filter(named, lambda g: g.isNotNull())


def merged_verdict(verdicts: DataFrame, rejected: str = "rejected", ruled_out: str = "ruled_out") -> DataFrame:
    """``verdicts`` with the candidates that rules have ruled out before those that the judge rejects, each once."""
    none = F.array().cast("array<string>")
    return verdicts.withColumn(rejected, F.array_distinct(F.concat(F.coalesce(ruled_out, none), F.coalesce(rejected, none)))).drop(ruled_out)


def violations(answers: DataFrame, claims: DataFrame, facts: DataFrame, hypotheses: DataFrame, disclosed: DataFrame) -> DataFrame:
    """(run_id, severity, subject, message): what stops or changes an answer, all checks together.

    ``answers``: (run_id, adversarially_probed, expected_adversarially_probed); ``claims``: (run_id, claim_id, claim_text,
    claim_type, source_ids); ``hypotheses`` and ``disclosed`` as in ``undisclosed``, with run_id.
    """
    numeric = numeric_violations(claims, facts).join(claims.select("run_id", "claim_id"), "claim_id")
    numeric = numeric.select("run_id", F.lit("numerical_mismatch").alias("severity"), F.col("claim_id").cast("string").alias("subject"), F.concat(F.lit("number without source: "), "token").alias("message"))
    hidden = hypotheses.filter("refutation_verdict <> 'unrefuted'").join(disclosed.select("run_id", "targets_claim_id", "strategy").distinct(), ["run_id", "targets_claim_id", "strategy"], "left_anti")
    hidden = hidden.select("run_id", F.lit("undisclosed_refutation").alias("severity"), F.col("targets_claim_id").cast("string").alias("subject"), F.concat(F.lit("not disclosed: "), "strategy").alias("message"))
    badge = wrong_badges(answers).select("run_id", F.lit("badge_mismatch").alias("severity"), F.lit(None).cast("string").alias("subject"), F.lit("the badge does not tell whether the answer was probed").alias("message"))
    return numeric.unionByName(hidden).unionByName(badge)


def retry_text(found: DataFrame) -> DataFrame:
    """(run_id, feedback): the violations of a run as the text of a retry, in the order of severity, subject and message."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("severity", "subject", "message"))), lambda v: F.concat(F.lit("  - ["), v["severity"], F.lit("] "), v["message"]))
    return found.groupBy("run_id").agg(F.array_join(F.concat(F.array(F.lit(V.RETRY_HEAD)), lines, F.array(F.lit(V.RETRY_TAIL))), "\n").alias("feedback"))


def canned_answer(level: Column) -> Column:
    """The text of an answer that is given without a generator, null for levels that call one."""
    return F.when(level == "HARD_HALT", V.HARD_HALT_TEXT).when(level == "CLARIFICATION_REQUEST", V.CLARIFICATION_TEXT)


def refutation_intensity(hypotheses: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, intensity) of every run: strong, weak or none by its worst hypothesis, bypassed without any report."""
    grade = F.when(F.col("refutation_verdict") == "strongly_refuted", 2).when(F.col("refutation_verdict") == "weakly_refuted", 1).otherwise(0)
    worst = hypotheses.groupBy("run_id").agg(F.max(grade).alias("_g"))
    return runs.select("run_id").join(worst, "run_id", "left").select("run_id", F.when(F.col("_g") == 2, "strong").when(F.col("_g") == 1, "weak").when(F.col("_g") == 0, "none").otherwise("bypassed").alias("intensity"))


def new_hypotheses(proposed: DataFrame, known: DataFrame) -> DataFrame:
    """Proposed hypotheses of a run whose text it has not had before, each text once: the least id of equals."""
    fresh = proposed.join(known.select("run_id", "hypothesis_text").distinct(), ["run_id", "hypothesis_text"], "left_anti")
    least = fresh.groupBy("run_id", "hypothesis_text").agg(F.min("hypothesis_id").alias("hypothesis_id"))
    return fresh.join(least, ["run_id", "hypothesis_text", "hypothesis_id"], "left_semi").dropDuplicates(["run_id", "hypothesis_text"])
