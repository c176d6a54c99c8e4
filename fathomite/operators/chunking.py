"""Sentence-aligned chunks with overlap: an ordered fold over a section's sentences, inside one expression.

A section is one row and stays one row: its sentences are folded by ``aggregate`` in the JVM, so no section is shuffled
or gathered, and sections of different documents spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, values as V


def _tail(chunk: Column, overlap: int) -> Column:
    """The trailing sentences that open the next chunk: the last always, more while their words fit the overlap."""

    def step(state: Column, s: Column) -> Column:
        takes = ~state["done"] & ((F.size(state["kept"]) == 0) | (state["n"] + s["n"] <= overlap))
        return F.struct(
            F.when(takes, F.concat(F.array(s), state["kept"])).otherwise(state["kept"]).alias("kept"),
            F.when(takes, state["n"] + s["n"]).otherwise(state["n"]).alias("n"),
            (state["done"] | ~takes).alias("done"),
        )

    start = F.struct(F.array().cast("array<struct<s:string,n:int>>").alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("done"))
    return F.aggregate(F.reverse(chunk), start, step)


def chunk_arrays(text: Column, size: int = V.CHUNK_WORDS, overlap: int = V.CHUNK_OVERLAP) -> Column:
    """ARRAY<STRING> of the chunks of a section; a sentence longer than ``size`` is a chunk of its own size."""
    counted = F.transform(T.sentences(T.strip(text)), lambda s: F.struct(s.alias("s"), T.word_count(s).alias("n")))
    joined = lambda chunk: T.strip(F.array_join(F.transform(chunk, lambda x: x["s"]), " "))

    def step(state: Column, s: Column) -> Column:
        over = (state["n"] + s["n"] > size) & (F.size(state["cur"]) > 0)
        tail = _tail(state["cur"], overlap)
        return F.struct(
            F.when(over, F.concat(state["out"], F.array(joined(state["cur"])))).otherwise(state["out"]).alias("out"),
            F.concat(F.when(over, tail["kept"]).otherwise(state["cur"]), F.array(s)).alias("cur"),
            (F.when(over, tail["n"]).otherwise(state["n"]) + s["n"]).alias("n"),
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<struct<s:string,n:int>>").alias("cur"), F.lit(0).alias("n"))
    return F.aggregate(counted, start, step, lambda st: F.when(F.size(st["cur"]) > 0, F.concat(st["out"], F.array(joined(st["cur"])))).otherwise(st["out"]))


def chunks(sections: DataFrame, skip: tuple[str, ...] = V.SKIPPED_SECTIONS, size: int = V.CHUNK_WORDS, overlap: int = V.CHUNK_OVERLAP) -> DataFrame:
    """Chunk records of sections (document_id, section, text); skipped sections (by default the statements and other parts
    without prose), null and blank ones have none."""
    rows = sections.filter(~F.col("section").isin(*skip)) if skip else sections
    rows = rows.select("document_id", "section", F.posexplode(chunk_arrays(F.coalesce("text", F.lit("")), size, overlap)).alias("position_index", "text"))
    return rows.select(
        F.concat_ws("__", "document_id", "section", F.concat(F.lit("chunk_"), F.col("position_index").cast("string"))).alias("chunk_id"),
        "text", F.col("document_id").alias("source_document"), "section", "position_index", T.word_count(F.col("text")).alias("word_count"),
    )
