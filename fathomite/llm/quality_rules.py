"""Quality rules as one Spark projection, compiled from a table of thresholds. Built-in functions only.

``measures`` adds the figures of a text. ``RULES`` is the table: a name, a ratio of two figures and the bounds within
which a text passes. ``judge`` turns the table into expressions over the figures.

Words repeated in 8-word windows are counted without a shuffle and without a quadratic step: word hashes are combined
into hashes of 8 words, and if no hash comes twice, nothing repeats, which is exact. Only else are the
positions sorted by hash and the windows whose hash comes again compared as texts, so a hash collision changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import spaced

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is that for it was on as with he be at by this from are have not "
    "der die das und ist von zu den mit sich des auf für im ein eine nicht als auch es an "
    "le la les de des et un une du en que qui est pour dans par sur pas au avec ce il "
    "el los las y se no lo con por su para del una al como más o pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes if ``least`` <= ``over`` / ``under`` <= ``most``; with ``under`` None, ``over`` itself is held
    against the bounds. A ratio over zero passes. A rule with ``from_words`` binds only texts of that many words."""

    name: str
    over: str
    under: str | None
    least: float | None = None
    most: float | None = None
    from_words: int = 0


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 18.0),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.25),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, None, 60),
    Rule("bang_words", "n_bangs", "n_words", None, 0.3),
)


def _twins(sorted_: str, key: str) -> Column:
    """Positions ``i`` of the entries of a sorted array whose ``key`` equals a neighbour's."""
    same = lambda x, at: F.coalesce(x[key] == F.get(sorted_, at - 1)[key], F.lit(False)) | F.coalesce(x[key] == F.get(sorted_, at + 1)[key], F.lit(False))
    return F.transform(F.filter(sorted_, same), lambda x: x["i"])


def _covered(starts: Column) -> Column:
    """Words inside the windows that begin at the sorted ``starts``."""
    steps = F.zip_with(F.slice(starts, 2, F.size(starts)), F.slice(starts, 1, F.size(starts) - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    return F.aggregate(steps, F.lit(WINDOW).cast("bigint"), lambda sum_, step: sum_ + step)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_bangs, n_repeat_words), all long.

    Null text counts as empty. Repeated rows and null ids are kept; other columns are ignored.
    """
    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    base = base.withColumns({"_flat": spaced(F.col("_t")), "_lines": F.filter(F.split("_t", "\n"), lambda x: F.ltrim(x, F.lit(" \t\x0b\x0c\r")) != "")})
    hashed = base.withColumn("_w", F.array_remove(F.split("_flat", " "), "")).withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    of_window = lambda i: F.xxhash64(*(F.get("_h", i + k) for k in range(WINDOW)))
    starts = F.when(F.size("_h") >= WINDOW, F.sequence(F.lit(0), F.size("_h") - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashed = hashed.withColumn("_h8", F.transform(starts, of_window))
    # Each step is a column of its own: inside one expression it would be computed once for every place that uses it.
    window = lambda i: F.array_join(F.slice("_w", i + 1, WINDOW), " ")
    some = hashed.withColumn("_by_hash", F.when(F.size(F.array_distinct("_h8")) < F.size("_h8"), F.sort_array(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    some = some.withColumn("_by_text", F.sort_array(F.transform(_twins("_by_hash", "h"), lambda i: F.struct(window(i).alias("t"), i.alias("i")))))
    some = some.withColumn("_again", F.sort_array(_twins("_by_text", "t")))
    bytes_of = lambda c: F.octet_length("_t") - F.octet_length(F.replace(F.col("_t"), F.lit(c), F.lit("")))
    symbols = bytes_of(SYMBOLS[0])
    for c in SYMBOLS[1:]:
        symbols = symbols + bytes_of(c)
    figures = F.struct(
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.replace(F.col("_flat"), F.lit(" "), F.lit(""))).cast("bigint").alias("word_chars"),
        symbols.cast("bigint").alias("n_symbols"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("bigint").alias("n_stop_words"),
        bytes_of("!").cast("bigint").alias("n_bangs"),
        F.when(F.size("_again") > 0, _covered(F.col("_again"))).otherwise(F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )
    # A row is unpacked from an array of one: a filter on a figure then stays above, where pushed down it would take
    # all the columns that the figure is made of into one expression and compute them over and over.
    return some.select(F.col(id_col), F.inline(F.array(figures)))


def passes(rule: Rule) -> Column:
    """Whether a row of figures passes ``rule``. Bounds are held by multiplication, so no ratio over zero arises."""
    over, under = F.col(rule.over), F.col(rule.under) if rule.under else F.lit(1)
    ok = F.lit(True)
    if rule.least is not None:
        ok = ok & (over >= F.lit(rule.least) * under)
    if rule.most is not None:
        ok = ok & (over <= F.lit(rule.most) * under)
    return ok | (F.col("n_words") < rule.from_words)


def judge(figures: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``figures`` with base_failed, failed (names of the rules that a text breaks) and kept."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    broken = F.array_compact(F.array(*(F.when(~passes(r), F.lit(r.name)) for r in rules)))
    all_pass = F.lit(True)
    for r in rules:
        all_pass = all_pass & passes(r)
    return figures.withColumns({"base_failed": base, "failed": broken, "kept": ~base & all_pass})


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: id, the figures, base_failed, failed and kept. See ``measures`` for nulls and repeats;
    an empty text has no words and fails the base; an empty table gives an empty result."""
    return judge(measures(docs, id_col, text_col), rules)


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns. No shuffle: figures are computed beside the row."""
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text"))
    return quality_rules(row, "_row", "_text", rules).filter("kept").select("_row.*")


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for the contract's figures and verdicts over the table documents; failed as one text."""

    def passes_sql(r: Rule) -> str:
        under = r.under or "1"
        held = [f"{r.over} >= CAST({r.least} AS DOUBLE) * {under}"] * (r.least is not None) + [f"{r.over} <= CAST({r.most} AS DOUBLE) * {under}"] * (r.most is not None)
        return f"(({' AND '.join(held) or 'TRUE'}) OR n_words < {r.from_words})"

    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    base = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"
    names = ", ".join(f"CASE WHEN NOT {passes_sql(r)} THEN '{r.name}' END" for r in rules)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
ln AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
win AS (SELECT rid, unnest(range(1, len(w) - {WINDOW - 2})) AS i, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda j: array_to_string(w[j:j + {WINDOW - 1}], ' '))) AS s FROM d WHERE len(w) >= {WINDOW}),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win),
cov AS (SELECT rid, sum(least({WINDOW}, coalesce(n - i, {WINDOW}))) AS r FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS n FROM rep WHERE c > 1) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words,
  CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_bangs, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN ln USING (rid) LEFT JOIN cov USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base} AS base_failed,
  NOT {base} AND {" AND ".join(map(passes_sql, rules)) or "TRUE"} AS kept, concat_ws(',', {names}) AS failed
FROM m
"""
