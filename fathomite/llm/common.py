"""Shared plumbing: batch limits, words, label folds and bounded samples."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..storage import materialize, released, shared_dir  # noqa: F401

#: A word, wherever a contract says "word": no space and none of tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


BATCH_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def small_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by rows and bytes, so that long texts do not fill a Python worker.

    Spark reads these settings when a plan is made physical, long after ``map_rows`` has returned, so they cannot be put
    back here. They are only ever lowered: a session that asks for smaller batches keeps them.
    """
    for name, most in BATCH_SETTINGS.items():
        now = spark.conf.get(name, None)
        if now is None or _amount(now) <= 0 or _amount(now) > _amount(most):
            spark.conf.set(name, most)


def _amount(setting: str) -> int:
    """A number of rows or bytes, with Spark's suffixes."""
    found = re.fullmatch(r"\s*(-?\d+)\s*([kmgt]?)b?\s*", setting.lower())
    return int(found[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[found[2]] if found else 0


def map_rows(df: DataFrame, columns: list[str], schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]]) -> DataFrame:
    """``df.select(columns)`` through ``fn`` batch by batch. ``fn`` is pickled with what it closes over."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.select(*columns).mapInArrow(run, schema)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32(doc_id as text) mod ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % parts


def spaced(text: Column) -> Column:
    """``text`` with each of tab to carriage return made a space; null becomes empty. (``replace`` looks for bytes and
    is many times faster than ``translate``, which builds a string for each character.)"""
    out = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def words_of(text: Column) -> Column:
    """The words of ``text`` in order, as an array; null text has none. Built-in functions only."""
    return F.array_remove(F.split(spaced(text), " "), "")


def bounded_sample(rows: DataFrame, key: Column, limit: int) -> DataFrame:
    """The rows of the ``limit`` keys whose hash is lowest: the same rows in every run, whatever their order.

    Only hashes are ranked, and only the lowest few: a first bound on them, guessed from the number of rows, leaves about
    four times as many as needed, and is raised where keys repeat so much that too few are left. Repeats of a chosen key
    are all returned, for the caller to make one row of. Rows with a null key are left out.
    """
    h = F.xxhash64(key)
    known = rows.filter(key.isNotNull())
    share = min(1.0, 4 * limit / max(known.count(), 1))
    while True:
        guess = known if share >= 1 else known.filter(h <= F.lit(int(-(2**63) + share * 2**64)))
        found = guess.select(h.alias("h")).distinct().orderBy("h").limit(limit).agg(F.count("h").alias("n"), F.max("h").alias("lowest")).first()
        if found["n"] >= limit or share >= 1:
            return known.filter(h <= F.lit(found["lowest"])) if found["n"] else known.limit(0)
        share = min(1.0, share * 16)
