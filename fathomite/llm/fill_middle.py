"""Fill-in-the-middle: a text's middle is moved behind its prefix and suffix, so that a model learns to fill gaps.

A text is cut into units by a pattern that is matched from left to right. A matcher streams over the text and knows
only how many units it has passed and where it stands: the first pass counts the units, the second goes on to the rank
at which the prefix ends and from there to the rank at which the middle ends. Units are passed in strides, a whole
stride by one match, and one by one where a rank lies inside a stride; no list of units or positions is ever made.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_rows

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CODE_POINT = "(?s:.)"
SEED = "1"
#: Of a hundred texts, those whose middle is moved, and of these the ones in the order suffix, prefix, middle.
MOVED, SUFFIX_FIRST = 90, 20
STRIDE = 1024
FIGURES = ("n", "prefix_units", "middle_units", "prefix_chars", "middle_chars")


class Matcher:
    """Units of a pattern that fits no empty text; where it does not fit, a character is a unit of its own.

    A unit is atomic: a stride never shortens one so that a later one fits, so it passes what single matches pass.
    """

    def __init__(self, pattern: str = CODE_POINT, stride: int = STRIDE):
        if re.compile(pattern).match("") is not None:
            raise ValueError("a unit must have a character")
        unit = f"(?>{pattern}|(?s:.))"
        self.steps = [(stride, re.compile(f"(?:{unit}){{{stride}}}")), (1, re.compile(unit))]

    def walk(self, text: str, at: int = 0, most: int | None = None) -> Iterator[tuple[int, int]]:
        """(units passed, position) after each match, from ``at`` on, until ``most`` units or the end of the text."""
        passed = 0
        for size, pattern in self.steps:
            while (most is None or passed + size <= most) and (found := pattern.match(text, at)) is not None:
                passed, at = passed + size, found.end()
                yield passed, at

    def count(self, text: str) -> int:
        n = 0
        for n, _ in self.walk(text):
            pass
        return n

    def advance(self, text: str, at: int, units: int) -> int:
        """The position ``units`` units after ``at``."""
        for _, at in self.walk(text, at, units):
            pass
        return at


def draws(id_: str, seed: str = SEED) -> tuple[int, int, int, int]:
    h = hashlib.sha256(f"{seed}:{id_}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in (0, 8, 16, 24))


def transformed(text: str, id_: str, matcher: Matcher, seed: str = SEED, moved: int = MOVED, suffix_first: int = SUFFIX_FIRST) -> tuple:
    """(output, form, then FIGURES: all units, those of prefix and middle, and their code points; None where plain)."""
    n = matcher.count(text)
    h1, h2, h3, h4 = draws(id_, seed)
    if not n or h3 % 100 >= moved or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return text, "plain", n, None, None, None, None
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a = matcher.advance(text, 0, first)
    b = matcher.advance(text, a, last - first)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", "spm", n, first, last - first, a, b - a
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", "psm", n, first, last - first, a, b - a


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINT, seed: str = SEED, moved: int = MOVED, suffix_first: int = SUFFIX_FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_units, middle_units, prefix_chars, middle_chars, output) for every row.

    The cuts and the form depend on id, seed and the number of units only. A text that holds one of the marks, or none
    of whose units can be cut (null or empty), stays plain; of a plain one the four figures are null. A null id is
    written as nothing. Repeated rows come out as often as they come in; other columns are left out, so their names may
    clash. A task holds a batch of texts, bounded in bytes, and one output beyond it.
    """

    keyed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_key"), F.col(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        matcher = Matcher(unit)
        made = [transformed(t.as_py() or "", k.as_py(), matcher, seed, moved, suffix_first) for k, t in zip(batch.column(1), batch.column(2), strict=True)]
        output, form, *figures = zip(*made, strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in figures), pa.array(form), pa.array(output)], names=[id_col, *FIGURES, "form", "output"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return map_rows(keyed, ["id", "_key", "text"], f"`{id_col}` {kind}, {', '.join(f'{c} bigint' for c in FIGURES)}, form string, output string", run)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. No text that was cut holds a mark, and a mark cannot begin inside another, so
    the marks are where the pieces meet."""
    part = lambda i: F.get(F.split(output, "<[PSM]>", -1), i)
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row's transformed text."""
    made = fill_in_middle(docs, id_col=id_col, text_col=text_col)
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(id_col, "n", "form", "prefix_chars", "middle_chars", hashed(F.col("output")).alias("output_sha256"), hashed(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def oracle_sql(seed: str = SEED, moved: int = MOVED, suffix_first: int = SUFFIX_FIRST) -> str:
    """DuckDB SQL for ``digests`` of the table documents."""
    h = lambda i: f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (SELECT *, least({h(0)} % (n + 1), {h(1)} % (n + 1)) AS a, greatest({h(0)} % (n + 1), {h(1)} % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR {h(2)} % 100 >= {moved} THEN 'plain' WHEN {h(3)} % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substr(t, 1, CAST(a AS BIGINT)) AS prefix, substr(t, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT)) AS middle, substr(t, CAST(b + 1 AS BIGINT)) AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN a END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN b - a END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
