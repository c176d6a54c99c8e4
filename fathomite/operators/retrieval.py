"""Retrieval for a batch of slots at once: BM25 and cosine channels, period filters, memory, rank fusion.

Corpora are DataFrames (seq, id, text or vector, period, source_document, layer). All slots of a run go through one
plan. Scores are rounded to six places before they are ranked, and ties go to the earlier seq, so ranks do not depend on
the order of additions. Top-k is written as a bounded row number, which Spark prunes before the shuffle.

A corpus is tokenised once, into an index that is stored (``text_index``); queries read the blocks of their own terms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import period as P, text as T, values as V
from . import text_index as TI
from .tags import fits, row_tags, slot_tags


def term_counts(corpus: DataFrame, terms: DataFrame | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, term, tf, dl): the postings of all terms, or of the given ones only, which are filtered before the shuffle."""
    tokens = T.tokenize(F.col(text_col))
    rows = corpus.select(id_col, tokens.alias("_t")).select(id_col, F.size("_t").alias("dl"), F.explode("_t").alias("term"))
    if terms is not None:
        rows = rows.join(terms, "term", "left_semi")
    return rows.groupBy(id_col, "term", "dl").agg(F.count("*").alias("tf"))


def corpus_figures(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """One row (n, avgdl) over the whole corpus."""
    return corpus.select(F.size(T.tokenize(F.col(text_col))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def inverse_frequencies(corpus: DataFrame, epsilon: float = V.BM25_EPSILON, text_col: str = "text") -> DataFrame:
    """(term, df, idf) over a whole corpus.

    A document's distinct terms are unrolled and counted by term with a partial count on each task; postings are not
    shuffled for it.
    """
    df = corpus.select(F.explode(F.array_distinct(T.tokenize(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return TI.weighed(df, corpus.count(), epsilon)


def bm25_scores(corpus: DataFrame | TI.TextIndex, queries: DataFrame) -> DataFrame:
    """(slot_id, id, score) of every document that shares a term with a query; ``queries`` is (slot_id, query).

    A term that a query repeats counts as often. Statistics are of the whole corpus. Queries are a batch of questions
    against all rows. For the best few rows of a query, ``text_index.search_blocks`` scores less.
    """
    return TI.scores(corpus if isinstance(corpus, TI.TextIndex) else TI.text_index(corpus, None), queries)


#: Query vectors at most that are held beside a batch of rows at a time.
QUERY_BLOCK = 4096
#: Scores that a worker holds as one matrix.
SCORES = 500_000


def unit_vectors(vectors: DataFrame, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, seq, vector) of length one in DOUBLE, what a vector index stores; a vector of zeros is kept, a null one left
    out. Written with ``mode("overwrite")`` it replaces a former index."""
    v = F.col(vector_col).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)
    return vectors.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col("seq") if "seq" in vectors.columns else F.col(id_col)).alias("seq"), unit.alias("vector"))


def cosine_scores(vectors: DataFrame, queries: DataFrame, most: int | None = None) -> DataFrame:
    """(slot_id, id, score) of every vector for every query vector, in DOUBLE; 0 where either is all zeros.

    The queries are the stated batch of questions: they are sent to all tasks in blocks of QUERY_BLOCK, and each batch of
    rows is scored by one matrix product. With ``most`` a batch passes on only rows that can be among the best ``most``
    of a query, ties included, so that pairs do not become rows. Where ``vectors`` and ``queries`` both have tags, only
    rows with a tag of the query get a score, and are filtered before the best are taken. A null vector, of a row or a
    query, has no scores; vectors of another length than the queries' end the job.
    """
    spark = vectors.sparkSession
    tagged = "tags" in vectors.columns and "tags" in queries.columns
    tags = (F.col("tags") if tagged else F.lit(None)).cast("array<string>").alias("tags")
    asked = queries.filter(F.col("vector").isNotNull()).select(F.col("slot_id").cast("string").alias("slot_id"), F.col("vector").cast("array<double>").alias("q"), tags).toArrow()
    kind = vectors.select("id").schema[0].dataType.simpleString()
    schema = f"slot_id string, id {kind}, score double"
    if not asked.num_rows:
        return spark.createDataFrame([], schema)
    dims = {len(q) for q in asked["q"]}
    if len(dims) > 1:
        raise ValueError(f"query vectors differ in length: {sorted(dims)[:5]}")
    dim, scores = dims.pop(), SCORES

    def units(rows: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(rows, axis=1, keepdims=True)
        return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)

    def part(lo: int) -> DataFrame:
        block = asked.slice(lo, QUERY_BLOCK)
        names = block["slot_id"].combine_chunks() if block["slot_id"].num_chunks != 1 else block["slot_id"].chunk(0)
        allowed = [None if t is None else set(t) for t in block["tags"].to_pylist()]
        shared = spark.sparkContext.broadcast((names, units(np.array(block["q"].to_pylist(), np.float64)), allowed if tagged else None))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slots, q, allowed = shared.value
            # The best that a slot's ``most``-th score has been in one matrix so far: what lies below is passed over.
            least = np.full((len(slots), 1), -np.inf)
            for batch in batches:
                step = max(1, scores // len(slots))
                for at in range(0, batch.num_rows, step):
                    own = batch.slice(at, step)
                    flat = own.column(1).flatten().to_numpy(zero_copy_only=False)
                    if len(flat) != own.num_rows * dim or (pc.list_value_length(own.column(1)).to_numpy(zero_copy_only=False) != dim).any():
                        raise ValueError(f"a vector has another length than the queries' {dim}")
                    score = q @ units(flat.reshape(-1, dim)).T
                    np.round(score, 6, out=score)
                    score += 0.0
                    if allowed is not None:
                        score[~fits(own.column(2), allowed)] = -np.inf
                    if most is not None and score.shape[1] > most:
                        np.maximum(least[:, 0], np.partition(score, -most, axis=1)[:, -most], out=least[:, 0])
                    i, j = np.nonzero(score >= least)
                    if allowed is not None:
                        known = np.isfinite(score[i, j])
                        i, j = i[known], j[known]
                    yield pa.RecordBatch.from_arrays([slots.take(pa.array(i)), own.column(0).take(pa.array(j)), pa.array(score[i, j])], names=["slot_id", "id", "score"])

        own = F.coalesce("tags", F.array().cast("array<string>")) if tagged else F.array().cast("array<string>")
        rows = vectors.filter(F.col("vector").isNotNull()).select("id", F.col("vector").cast("array<double>").alias("vector"), own.alias("tags"))
        return rows.mapInArrow(run, schema)

    out = part(0)
    for lo in range(QUERY_BLOCK, asked.num_rows, QUERY_BLOCK):
        out = out.unionByName(part(lo))
    return out


Embedder = Callable[[DataFrame, str], DataFrame]


def hashed_embedder(dim: int = 384, id_col: str = "id") -> Embedder:
    """A stand-in for an embedding model: counts of a text's terms by hash, signed by another, of length one.

    An ``Embedder`` turns (rows, text column) into (id, vector ARRAY<DOUBLE>).
    """

    def embed(rows: DataFrame, text_col: str) -> DataFrame:
        terms = T.tokenize(F.coalesce(F.col(text_col), F.lit("")))
        at = F.transform(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int"))
        sign = F.transform(terms, lambda t: F.when(F.pmod(F.crc32(t), F.lit(2)) == 0, 1.0).otherwise(-1.0))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                # A row at a time, one pass over its terms.
                made = [np.bincount(i.values.to_numpy(), s.values.to_numpy(zero_copy_only=False), dim) for i, s in zip(batch.column(1), batch.column(2), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64()))], names=["id", "vector"])

        kind = rows.schema[id_col].dataType.simpleString()
        sums = rows.select(F.col(id_col).alias("id"), at.alias("at"), sign.alias("sign")).mapInArrow(run, f"id {kind}, vector array<double>")
        return unit_vectors(sums).select("id", "vector")

    return embed


#: Rows of a batch's finds up to which they are sent to the corpus.
MOST_SENT = 200_000


def looked_up(found: DataFrame, corpus: DataFrame, by: str = "id") -> DataFrame:
    """Rows found, a written table, with their columns of ``corpus``.

    What a batch of questions finds is few rows beside a corpus, and is sent to it, so that the corpus with its texts is
    not shuffled. Beyond ``MOST_SENT`` rows it is a plain join.
    """
    return (F.broadcast(found) if found.count() <= MOST_SENT else found).join(corpus, by)


def eligible(scored: DataFrame, corpus: DataFrame, slots: DataFrame, layer: str, prefix: str = "nflx") -> DataFrame:
    """Scored rows with their metadata, before top-k: facts by own period or document, chunks by document only."""
    # Slots are a batch of questions; Spark sends them to all tasks only where they are small.
    rows = scored.join(corpus.select("id", "seq", "period", "source_document"), "id").join(slots.select("slot_id", "period_filter"), "slot_id")
    by_document = F.array_contains(P.equivalent_documents(F.col("period_filter"), prefix), F.col("source_document"))
    own = F.array_contains(P.equivalent_periods(F.col("period_filter")), F.col("period"))
    inside = F.coalesce(own, F.lit(False)) | F.coalesce(by_document, F.lit(False)) if layer == "fact" else F.coalesce(by_document, F.lit(False))
    return rows.filter(F.col("period_filter").isNull() | inside)


def top_k(scored: DataFrame, k: Column | int, by: str = "slot_id", tie: str = "seq") -> DataFrame:
    """The best rows of each slot, with their rank."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), tie)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def concatenate_layers(*layers: DataFrame) -> DataFrame:
    """Ranks over layers in the order given: every row of an earlier layer is ahead of all rows of a later one."""
    tagged = [d.withColumn("_layer", F.lit(i)) for i, d in enumerate(layers)]
    out = tagged[0]
    for d in tagged[1:]:
        out = out.unionByName(d)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("slot_id").orderBy("_layer", "rank"))).drop("_layer")


def after_filter(ranked: DataFrame, prefix: str = "nflx") -> DataFrame:
    """Rows whose own period, or document's where that is null, fits the slot's filter. Ranks are left as they are."""
    return ranked.filter(P.matches_filter(F.col("period"), F.col("source_document"), F.col("period_filter"), prefix))


def exclude(ranked: DataFrame, memory: DataFrame) -> DataFrame:
    """Without what a slot has seen (slot_id, id); ranks are made dense again."""
    left = ranked.join(memory.select("slot_id", "id").distinct(), ["slot_id", "id"], "left_anti")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("slot_id").orderBy("rank")))


def fuse(vector: DataFrame, bm25: DataFrame, n: Column | int, k: int = V.RRF_K) -> DataFrame:
    """Reciprocal rank fusion: (slot_id, id, fused_rank, rrf_score, vector_score, bm25_score); ties in first-seen order."""
    v = vector.select("slot_id", "id", F.col("rank").alias("vrank"), F.col("score").alias("vector_score"))
    b = bm25.select("slot_id", "id", F.col("rank").alias("brank"), F.col("score").alias("bm25_score"))
    both = v.join(b, ["slot_id", "id"], "full_outer")
    part = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    both = both.withColumn("rrf_score", F.round(part("vrank") + part("brank"), 6))
    order = Window.partitionBy("slot_id").orderBy(F.desc("rrf_score"), F.coalesce("vrank", 1_000_000 + F.col("brank")))
    return both.withColumn("fused_rank", F.row_number().over(order)).filter(F.col("fused_rank") <= n).select("slot_id", "id", "fused_rank", "rrf_score", "vector_score", "bm25_score")


def by_tier(table: dict[str, int], tier: str = "complexity_tier") -> Column:
    out = F.lit(table["simple"])
    for name, value in table.items():
        out = F.when(F.col(tier) == name, value).otherwise(out)
    return out


LAYERS = ("fact", "chunk")


def _layer(corpus: DataFrame, layer: str) -> DataFrame:
    """The rows of a layer with their tags."""
    return corpus.filter(F.col("layer") == layer).withColumn("tags", row_tags(F.col("period"), F.col("source_document"), layer))


def build_layer_indexes(corpus: DataFrame, name: str | None = None) -> dict[str, TI.TextIndex]:
    """A text index for each layer of ``corpus``, to be handed to ``retrieve`` again and again; with a ``name`` it is built
    once for the files that ``corpus`` reads."""
    return {layer: TI.text_index(_layer(corpus, layer).select("id", "seq", "tags", "text"), name and f"{name}_{layer}") for layer in LAYERS}


def retrieve(corpus: DataFrame, slots: DataFrame, query_vectors: DataFrame, memory: DataFrame | None = None, tier: str = "simple", prefix: str = "nflx", indexes: dict[str, TI.TextIndex] | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """One retrieval for every slot: both channels with filter, top-k, second filter and memory, then fusion.

    ``corpus`` has (id, seq, layer, text, vector, period, source_document); ``slots`` (slot_id, query, period_filter).
    ``vectors`` (id, vector) is for a corpus that has none: texts then need no join with them.
    Where ``slots`` has a complexity_tier, each slot's own tier decides how many rows it gets, else ``tier`` does. Both
    channels filter inside, so that no row that a filter rejects is scored into a table.
    """
    own = slots if "complexity_tier" in slots.columns else slots.withColumn("complexity_tier", F.lit(tier))
    limits = F.broadcast(own.select("slot_id", by_tier(V.CHANNEL_K).alias("_k"), by_tier(V.FUSED_N).alias("_n")))
    within = lambda rows, rank, most: rows.join(limits, "slot_id").filter(F.col(rank) <= F.col(most)).drop("_k", "_n")
    k, n = max(V.CHANNEL_K.values()), max(V.FUSED_N.values())
    indexes = indexes or build_layer_indexes(corpus)
    filters = slots.select("slot_id", "period_filter")
    about = corpus.select("id", "seq", "period", "source_document")

    def by_cosine(layer: str, part: DataFrame, wanted: DataFrame) -> DataFrame:
        asked = query_vectors.select("slot_id", "vector").join(wanted.select("slot_id", "tags"), "slot_id")
        if vectors is not None:
            part = vectors.select("id", "vector").join(part.select("id", "tags"), "id")
        return top_k(cosine_scores(part, asked, k).join(about.select("id", "seq"), "id"), k).drop("seq")

    def by_words(layer: str, part: DataFrame, wanted: DataFrame) -> DataFrame:
        return TI.search_blocks(indexes[layer], wanted, k).rows.drop("seq")

    channels = []
    for channel in (by_cosine, by_words):
        ranked = []
        for layer in LAYERS:
            wanted = slots.select("slot_id", "query", slot_tags(F.col("period_filter"), layer, prefix).alias("tags"))
            best = channel(layer, _layer(corpus, layer), wanted)
            ranked.append(within(best.join(about, "id").join(filters, "slot_id"), "rank", "_k"))
        kept = after_filter(concatenate_layers(*ranked), prefix)
        channels.append(exclude(kept, memory) if memory is not None else kept.withColumn("rank", F.row_number().over(Window.partitionBy("slot_id").orderBy("rank"))))
    return within(fuse(channels[0], channels[1], n), "fused_rank", "_n")
