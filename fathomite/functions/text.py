"""Text functions as Column expressions. ``(?U)`` gives Java's classes and boundaries their Unicode meaning."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

from . import values as V


def find_all(text: Column, pattern: str, flags: str = "U") -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?{flags})({pattern})"), F.lit(1))


def has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iU){pattern}")


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters a-z, digits, apostrophes and hyphens; no stemming, no stop words."""
    return find_all(F.lower(text), V.TOKEN)


def word_count(text: Column) -> Column:
    return F.size(find_all(text, r"\S+"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_claim(text: Column) -> Column:
    """Composed, in lower case, white space runs to one space. Texts that may need composing pass through Python (``nfc``)."""
    return collapse(F.lower(nfc(text)))


def estimate_tokens(text: Column) -> Column:
    return F.floor(word_count(text) * F.lit(V.TOKENS_PER_WORD)).cast("int")


def normalize_text(text: Column) -> Column:
    """Canonical composition, straight quotes and dashes, entities decoded, control characters gone, line feeds only,
    single spaces, no space at line ends, at most one blank line together."""
    s = nfc(F.coalesce(text, F.lit("")))
    for old, new in V.PUNCTUATION.items():
        s = F.replace(s, F.lit(old), F.lit(new))
    for old, new in V.ENTITIES.items():
        for form in dict.fromkeys((old, old.upper())):
            s = F.replace(s, F.lit(form), F.lit(new))
    s = F.regexp_replace(s, r"[\x00\x0b\x0c]", "")
    s = F.regexp_replace(s, r"\r\n?", "\n")
    s = F.regexp_replace(s, "[ \t ]+", " ")
    s = F.regexp_replace(s, r" +(?=\n|$)", "")
    s = F.regexp_replace(s, r"\n[ \t]*\n[ \t]*\n+", "\n\n")
    return strip(s)


#: A character that is not known to be left alone by composition, whatever stands beside it.
MAY_COMPOSE = "[^\\x{0}-\\x{2FF}\\x{2010}-\\x{2027}\\x{2030}-\\x{205E}\\x{20A0}-\\x{20BF}]"


def nfc(text: Column) -> Column:
    """Unicode canonical composition (a vectorised UDF: Spark has no built-in). Only texts that have a character which may
    compose or be replaced are sent to Python; all below U+0300, dashes, quotes and currency signs stay as they are."""

    @F.pandas_udf("string")
    def composed(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFC")

    return F.coalesce(composed(F.when(text.rlike(MAY_COMPOSE), text)), text)


def sentences(text: Column) -> Column:
    """Split after . ! ? before white space and a capital, quote or bracket, and at blank lines; not after abbreviations."""
    names = "|".join(re.escape(a) for a in V.ABBREVIATIONS)
    s = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?U)\b({names})\.(?=\s)", "$1\x01")
    parts = F.flatten(F.transform(F.split(s, r"""(?U)(?<=[.!?])\s+(?=[A-Z"'(\[])"""), lambda p: F.split(p, r"\n{2,}")))
    return F.filter(F.transform(parts, lambda p: strip(F.replace(p, F.lit("\x01"), F.lit(".")))), lambda p: p != "")


def _distinct_lower(found: Column) -> Column:
    """First occurrence of each, compared in lower case, in order."""
    lower = F.transform(found, lambda x: F.lower(x))
    return F.filter(found, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def key_terms(text: Column, most: int = 8) -> Column:
    found = F.filter(find_all(text, V.KEY_TERM), lambda x: ~F.lower(x).isin(V.KEY_TERM_STOPS))
    return F.slice(_distinct_lower(found), 1, most)


def loop_terms(claims: Column, most: int = 8) -> Column:
    """Of the first three claims' first six words each: trimmed of punctuation, lower case, four letters at least."""
    words = F.flatten(F.transform(F.slice(claims, 1, 3), lambda c: F.slice(F.split(collapse(c), " "), 1, 6)))
    clean = F.transform(words, lambda w: F.lower(F.btrim(w, F.lit(".,;:()"))))
    return F.slice(F.array_distinct(F.filter(clean, lambda w: F.length(w) >= 4)), 1, most)


def significant_numbers(text: Column) -> Column:
    """Distinct number tokens but for years, each with and without its thousands commas."""
    found = F.filter(find_all(text, V.NUMBER), lambda x: ~F.replace(x, F.lit(","), F.lit("")).rlike(r"^(?:19|20)\d{2}$"))
    return F.array_distinct(F.concat(found, F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")))))


def metric_phrases(text: Column, pattern: str = V.METRIC_PHRASES) -> Column:
    return F.array_distinct(F.transform(find_all(text, pattern, "iU"), lambda x: collapse(F.lower(x))))


def token_jaccard(a: Column, b: Column) -> Column:
    """Of the sets of words with four letters or more; 0 where both are empty."""
    words = lambda t: F.array_distinct(find_all(F.lower(t), r"[a-z]{4,}"))
    both = F.size(F.array_union(words(a), words(b)))
    return F.when(both > 0, F.size(F.array_intersect(words(a), words(b))) / both).otherwise(F.lit(0.0))


def locate_anchor(text: Column, anchor: Column) -> Column:
    """The part of ``text`` that ``anchor`` stands for: exact, else with any white space, else also in any case."""
    loose = F.concat_ws(r"\s+", F.transform(F.split(collapse(anchor), " "), lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))))
    near = F.regexp_substr(text, F.concat(F.lit("(?U)"), loose))
    any_case = F.regexp_substr(text, F.concat(F.lit("(?iU)"), loose))
    return F.when(strip(anchor) == "", F.lit(None).cast("string")).when(F.contains(text, anchor), anchor).otherwise(F.coalesce(near, any_case))


def clip(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def clean_transcript(text: Column) -> Column:
    for footer in V.TRANSCRIPT_FOOTERS:
        text = F.regexp_replace(text, footer, "")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def split_transcript(text: Column) -> Column:
    """STRUCT<prepared_remarks, qa>; all in the first where a heading is missing or they are out of order."""
    t = clean_transcript(text)
    talk, ask = r"(?m)^Presentation\s*$", r"(?im)^Question\s+and\s+Answer\s*$"
    before = lambda p: F.length(F.split(t, p, 2)[0])
    found = t.rlike(talk) & t.rlike(ask) & (before(ask) > before(talk))
    rest = F.get(F.split(t, talk, 2), F.lit(1))
    remarks, qa = F.get(F.split(rest, ask, 2), F.lit(0)), F.get(F.split(t, ask, 2), F.lit(1))
    return F.struct(F.when(found, strip(remarks)).otherwise(t).alias("prepared_remarks"), F.when(found, strip(qa)).otherwise(F.lit("")).alias("qa"))


def label_speakers(text: Column) -> Column:
    """Known names become ``Name:`` on a line of their own after a blank line, formal forms as casual ones."""
    names = "|".join(re.escape(n) for n in (*V.SPEAKERS, *V.CASUAL_SPEAKERS))
    out = F.regexp_replace(text, f"({names})", "\x02$1\x03")
    for formal, casual in V.SPEAKERS.items():
        out = F.replace(out, F.lit(f"\x02{formal}\x03"), F.lit(f"\x02{casual}\x03"))
    out = F.replace(F.replace(out, F.lit("\x02"), F.lit("\n\n")), F.lit("\x03"), F.lit(":\n"))
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def trim_appendix(text: Column, company: str = "Netflix, Inc") -> Column:
    """Cut at the earliest appendix heading, then drop trailing blank, page-number and company lines."""
    starts = [F.nullif(F.instr(text, m), F.lit(0)) for m in V.LETTER_APPENDIX]
    at = F.least(*starts)
    body = F.regexp_replace(F.left(text, at - 1), rf"(?U)(?:(?:^|\n)[^\S\n]*(?:\d+|{re.escape(company)}\.?)?[^\S\n]*)+$", "")
    return F.when(at.isNull(), text).otherwise(F.regexp_replace(body, r"(?U)\s+$", ""))


def lenient_json(text: Column) -> Column:
    """The outermost braces of a text as a JSON variant, null where that is none."""
    return F.try_parse_json(F.regexp_substr(text, F.lit(r"(?s)\{.*\}")))


def escape_html(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def paragraphs_html(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(escape_html(text), "\n\n"), lambda p: strip(p)), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br>")), F.lit("</p>"))), "")


def rounded(x: Column, places: int) -> Column:
    """A double rounded half away from zero as it is stored: 0.285 is a little less, so 0.28. (``F.round`` goes by the
    shortest decimal form, which gives 0.29.)"""
    scaled = x * F.lit(10.0**places)
    near = F.rint(F.abs(scaled))
    up = F.when(F.abs(scaled) - near == 0.5, near + 1).otherwise(near)
    return F.signum(scaled) * up / F.lit(10.0**places)


def coverage_bar(score: Column) -> Column:
    """STRUCT<height, colour> of a bar for a score between 0 and 1."""
    colour = F.when(score >= 0.8, "green").when(score >= 0.5, "amber").otherwise("red")
    return F.struct(F.greatest(F.lit(2), F.bround(score * 26).cast("int")).alias("height"), colour.alias("colour"))
