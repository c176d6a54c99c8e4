"""A stored text index: postings in blocks with bounds, so that a search scores only blocks that can matter.

Documents are numbered as they are read, and a block has the postings of a term in ``RANGE`` documents with consecutive numbers,
with the most that the term can add to the score of any of them. For a query, the bounds of its terms are added up by
range: no document of a range can score more. The k-th best score found so far is a threshold, and of the ranges that
follow only those whose bound reaches it are scored. So the result is exact.

The postings of a batch of queries are read and shuffled once, by range, and not once for each query: a range is scored for
all queries at once, and what leaves a task is its best rows with their ties.

Blocks are partitioned by a hash of their term, which a query's terms choose from, and sorted by term; a term that is
everywhere is a row for each range, spread over files of ``FILE_RANGES`` ranges, so no row, file or task grows with it. Filters are
part of the index: for each tag (see ``tags``) a range has a bitmap of its documents, which is one BIGINT. A search
joins ranges with the bitmaps of its tags before it reads any posting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T, values as V
from ..storage import current, materialize, once, publish, released

#: Documents of a block (the bits of a BIGINT), partitions of the blocks, and ranges of a term that one file holds.
RANGE, PARTS, FILE_RANGES = 64, 32, 1 << 16
#: To be raised whenever what is written changes, so that no index of former code is opened.
LAYOUT = 1
#: Ranges that are scored for a query before it has a threshold, for each row asked for.
FIRST = 2
#: Rows of query terms up to which they are sent to all tasks; beyond, blocks are joined by term.
MOST_SENT = 1_000_000
#: Rows of query terms up to which a batch of queries is searched in one pass over the ranges; slots that are scored by one
#: matrix product; and rows that a task holds before it passes them on.
MOST_AT_ONCE, SLOTS, HELD = 100_000, 256, 500_000
FOUND = ["slot_id", "pos", "score", "n_blocks", "n_scored"]


@dataclass
class TextIndex:
    """blocks (term, range, bound, n, members: pos, tf, dl; part), terms (term, df, idf), figures (n, avgdl, k1, b: one
    row), documents (pos, range, id, seq), members (tag, range, bits)."""

    blocks: DataFrame
    terms: DataFrame
    figures: DataFrame
    documents: DataFrame
    members: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(id, term, tf, dl) of the whole index."""
        rows = self.blocks.select("term", F.explode("members").alias("m")).select("term", "m.*")
        return rows.join(self.documents, "pos").select("id", "term", "tf", "dl")


def weighed(df: DataFrame, n: int, epsilon: float) -> DataFrame:
    """(term, df, idf) of (term, df) among n texts: Okapi's, with those below zero raised to ``epsilon`` times the mean."""
    raw = df.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def _saturated(tf, dl, avgdl, k1, b):
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def _packed() -> Column:
    """A posting of a range as a BIGINT that sorts by document: its place in the range, dl and tf, which are below 2**28, as no
    array of more strings fits a row."""
    return F.shiftleft(F.col("pos") % RANGE, 56) + F.shiftleft(F.col("dl").cast("bigint"), 28) + F.col("tf")


def _unpacked() -> Column:
    low = F.lit((1 << 28) - 1)
    number = lambda m: m.bitwiseAND(low).cast("int")
    return F.transform("members", lambda m: F.struct((F.col("range") * RANGE + F.shiftright(m, 56)).alias("pos"), number(m).alias("tf"), number(F.shiftright(m, 28)).alias("dl")))


def _write(corpus: DataFrame, place: str, epsilon: float, k1: float, b: float) -> None:
    spark = corpus.sparkSession
    seq = F.col("seq") if "seq" in corpus.columns else F.col("id")
    tags = F.coalesce("tags", F.array().cast("array<string>")) if "tags" in corpus.columns else F.array().cast("array<string>")
    own = corpus.select("id", seq.alias("seq"), tags.alias("tags"), T.tokenize(F.coalesce("text", F.lit(""))).alias("terms"), F.monotonically_increasing_id().alias("_at"))
    with released(spark):
        own = materialize(own, "tokens")
        # The number of a document: those of the partitions read before, and its own place in its partition.
        part = F.shiftright("_at", 33)
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = own.groupBy(part.alias("part")).agg(F.count("*").alias("_n"))
        starts = starts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("start"))
        own = own.join(F.broadcast(starts), part == F.col("part")).withColumn("pos", F.col("start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).withColumn("range", F.floor(F.col("pos") / RANGE))
        own.select("pos", "range", "id", "seq").write.parquet(f"{place}/documents")
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("pos") % RANGE).cast("int"))
        own.select("pos", "range", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag", "range").agg(F.bit_or(bit).alias("bits")).write.parquet(f"{place}/members")
        n, total = own.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
        avgdl = total / max(n, 1)
        figures = "n bigint, avgdl double, k1 double, b double"
        spark.createDataFrame([(n, float(avgdl), k1, b)], figures).coalesce(1).write.parquet(f"{place}/figures")
        # All documents of a range in one task: counts by document and blocks by range need no further shuffle.
        # Terms have no spaces and are shuffled as one string, postings as a BIGINT each: arrays of strings and of structs
        # take two to five times as much.
        near = own.select("range", "pos", F.size("terms").alias("dl"), F.array_join("terms", " ").alias("terms")).filter("dl > 0").repartition("range")
        tf = near.select("range", "pos", "dl", F.explode(F.split("terms", " ")).alias("term")).groupBy("range", "pos", "dl", "term").agg(F.count("*").alias("tf"))
        most = F.max(_saturated(F.col("tf"), F.col("dl"), max(avgdl, 1e-9), k1, b))
        blocks = tf.groupBy("range", "term").agg(most.alias("bound"), F.count("*").alias("n"), F.sort_array(F.collect_list(_packed())).alias("members"))
        blocks = blocks.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")).repartition("part", F.floor(F.col("range") / FILE_RANGES))
        blocks.sortWithinPartitions("part", "term", "range").withColumn("members", _unpacked()).write.partitionBy("part").parquet(f"{place}/blocks")
        blocks = _blocks(spark, place)
        weighed(blocks.groupBy("term").agg(F.sum("n").alias("df")), n, epsilon).write.parquet(f"{place}/terms")


def _blocks(spark: SparkSession, place: str) -> DataFrame:
    return spark.read.schema("range bigint, term string, bound double, n bigint, members array<struct<pos:bigint,tf:int,dl:int>>, part int").parquet(f"{place}/blocks")


def build_text_index(corpus: DataFrame, path: str, epsilon: float = V.BM25_EPSILON, k1: float = V.BM25_K1, b: float = V.BM25_B) -> TextIndex:
    """Index ``corpus`` (id, text[, seq, tags]) under ``path``; a former index there is replaced whole, when this one is
    written. Null and empty texts have no postings and count among the n. Ids should not repeat; seq breaks ties and is
    the id where there is none."""
    publish(corpus.sparkSession, path, lambda place: _write(corpus, place, epsilon, k1, b))
    return open_text_index(corpus.sparkSession, path)


def open_text_index(spark: SparkSession, path: str) -> TextIndex:
    """The index that was published under ``path``."""
    place = current(spark, path)
    if place is None:
        raise FileNotFoundError(f"no index under {path}")
    return _open(spark, place)


def _open(spark: SparkSession, place: str) -> TextIndex:
    return TextIndex(_blocks(spark, place), *(spark.read.parquet(f"{place}/{name}") for name in ("terms", "figures", "documents", "members")))


def text_index(corpus: DataFrame, name: str | None, epsilon: float = V.BM25_EPSILON, k1: float = V.BM25_K1, b: float = V.BM25_B) -> TextIndex:
    """The index of ``corpus`` in the shared folder: built by the first call for the files that it reads, then opened.

    ``name`` tells apart corpora that are made of the same files; without a name it is built for this call only."""
    place = once(corpus, name and f"text{LAYOUT}_{name}_{epsilon}_{k1}_{b}", lambda place: _write(corpus, place, epsilon, k1, b))
    return _open(corpus.sparkSession, place)


def _asked(index: TextIndex, queries: DataFrame) -> DataFrame:
    """(slot_id, term, w): the terms of queries that the index has, with what a saturated occurrence of each adds."""
    terms = queries.select("slot_id", F.explode(T.tokenize(F.col("query"))).alias("term")).groupBy("slot_id", "term").agg(F.count("*").alias("qtf"))
    return terms.join(index.terms.select("term", "idf"), "term").select("slot_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))


def _own_blocks(index: TextIndex, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks in the partitions of the asked terms, and the asked terms as the side of a join by term."""
    part = F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")
    parts, n = asked.agg(F.collect_set(part), F.count("*")).first()
    return index.blocks.filter(F.col("part").isin(sorted(parts))), F.broadcast(asked) if n <= MOST_SENT else asked.hint("merge")


def _scored(blocks: DataFrame, asked: DataFrame, ranges: DataFrame, figures: DataFrame) -> DataFrame:
    """(slot_id, pos, score) of the documents that ``ranges`` (slot_id, range, bits) lets through; bits null lets all."""
    f = figures.select("k1", "b", F.greatest("avgdl", F.lit(1e-9)).alias("avgdl"))
    rows = blocks.select("term", "range", "members").join(asked, "term").join(ranges, ["slot_id", "range"])
    rows = rows.select("slot_id", "w", "bits", F.explode("members").alias("m")).select("slot_id", "w", "bits", "m.*").join(F.broadcast(f))
    inside = F.col("bits").isNull() | (F.call_function("shiftright", "bits", (F.col("pos") % RANGE).cast("int")).bitwiseAND(F.lit(1)) == 1)
    part = F.col("w") * _saturated(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("k1"), F.col("b"))
    return rows.filter(inside).groupBy("slot_id", "pos").agg(F.round(F.sum(part), 6).alias("score"))


def scores(index: TextIndex, queries: DataFrame) -> DataFrame:
    """(slot_id, id, score) of every document that shares a term with a query (slot_id, query); no block is skipped."""
    asked = materialize(_asked(index, queries), "asked")
    blocks, side = _own_blocks(index, asked)
    f = index.figures.select("k1", "b", F.greatest("avgdl", F.lit(1e-9)).alias("avgdl"))
    rows = blocks.select("term", "members").join(side, "term").select("slot_id", "w", F.explode("members").alias("m")).select("slot_id", "w", "m.*").join(F.broadcast(f))
    part = F.col("w") * _saturated(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("k1"), F.col("b"))
    return rows.groupBy("slot_id", "pos").agg(F.round(F.sum(part), 6).alias("score")).join(index.documents, "pos").select("slot_id", "id", "score")


@dataclass
class Found:
    """rows (slot_id, id, seq, score, rank); n_blocks and n_scored count the blocks of the queries' terms, and those of
    them that were scored."""

    rows: DataFrame
    counts: DataFrame

    def _sum(self, name: str) -> int:
        return self.counts.agg(F.coalesce(F.sum(name), F.lit(0))).first()[0]

    @property
    def n_blocks(self) -> int:
        return self._sum("n_blocks")

    @property
    def n_scored(self) -> int:
        return self._sum("n_scored")


class _Batch:
    """A batch of queries as it is sent to tasks: for each block of SLOTS slots the weights of its own terms as a matrix, and
    the slots' tags as sets of indices (None lets all documents through)."""

    def __init__(self, slots: pa.Array, slot: np.ndarray, term: np.ndarray, w: np.ndarray, n_terms: int, tags: list[frozenset[int] | None]):
        self.slots, self.parts = slots, []
        for lo in range(0, len(slots), SLOTS):
            own = (slot >= lo) & (slot < lo + SLOTS)
            terms, at = np.unique(term[own], return_inverse=True)
            weights = np.zeros((min(SLOTS, len(slots) - lo), len(terms)))
            weights[slot[own] - lo, at] = w[own]
            place = np.full(n_terms, -1, np.int32)
            place[terms] = np.arange(len(terms), dtype=np.int32)
            kinds = {t: i for i, t in enumerate(dict.fromkeys(tags[lo : lo + SLOTS]))}
            self.parts.append((lo, weights, np.maximum(weights, 0), place, list(kinds), np.array([kinds[t] for t in tags[lo : lo + SLOTS]])))


class _Best:
    """The k-th best score so far of each slot, and the documents found that reach it, ties included."""

    def __init__(self, n: int, k: int):
        self.top, self.found, self.held = np.zeros((n, k)), [], 0

    def least(self, lo: int, n: int) -> np.ndarray:
        return self.top[lo : lo + n, 0]

    def add(self, slots: np.ndarray, score: np.ndarray, first_pos: int) -> None:
        k = self.top.shape[1]
        better = np.concatenate([self.top[slots], score], axis=1)
        better.partition(better.shape[1] - k, axis=1)
        best = better[:, -k:]
        best.sort(axis=1)
        self.top[slots] = best
        i, j = np.nonzero((score > 0) & (score >= best[:, :1]))
        self.found.append((slots[i], first_pos + j, score[i, j]))
        self.held += len(i)

    def take(self) -> tuple[np.ndarray, ...]:
        """What is held and still among the best."""
        rows = tuple(np.concatenate(c) for c in zip(*self.found, strict=True)) if self.found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        keep = rows[2] >= self.top[rows[0], 0]
        self.found, self.held = [], 0
        return tuple(c[keep] for c in rows)


def _search_range(batch: _Batch, best: _Best, number: int, terms: np.ndarray, bound: np.ndarray, matrix: np.ndarray, bits: dict[int, int]) -> tuple[int, int]:
    """Score one range for the slots whose bound reaches their k-th best score; the numbers of their blocks, all and scored."""
    n_blocks = n_scored = 0
    for lo, weights, positive, place, kinds, kind in batch.parts:
        at = place[terms]
        own = at >= 0
        if not own.any():
            continue
        at = at[own]
        w = weights[:, at]
        n = (w != 0).sum(axis=1)
        masks = [np.ones(RANGE, bool) if tags is None else _mask(_united(bits, tags)) for tags in kinds]
        open_ = np.array([m.any() for m in masks])[kind] & (n > 0)
        n_blocks += int(n[open_].sum())
        # A score is rounded to six places, so a bound that is lower by less may still reach it.
        asked = np.flatnonzero(open_ & (positive[:, at] @ bound[own] >= best.least(lo, len(weights)) - 1e-5))
        if len(asked):
            n_scored += int(n[asked].sum())
            score = np.round(w[asked] @ matrix[own], 6)
            best.add(lo + asked, np.where(np.array(masks)[kind[asked]], score, 0.0), number * RANGE)
    return n_blocks, n_scored


def _united(bits: dict[int, int], tags: frozenset[int]) -> int:
    out = 0
    for t in tags:
        out |= bits.get(t, 0)
    return out


def _mask(bits: int) -> np.ndarray:
    return np.unpackbits(np.array([bits & (2**64 - 1)], "<u8").view(np.uint8), bitorder="little").astype(bool)


def _searched(index: TextIndex, asked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(slot_id, pos, score) of all that can be among the best ``k`` of a slot, and rows with n_blocks and n_scored only.

    The blocks of all asked terms are dealt out by range once, whatever the number of queries, with the bitmaps of the asked
    tags. A task reads its ranges one after the other, and scores a range for all slots that need it by a matrix product.
    """
    spark = queries.sparkSession
    rows = asked.filter(F.col("slot_id").isNotNull()).toArrow().combine_chunks()
    coded = [rows[c].combine_chunks().dictionary_encode() for c in ("slot_id", "term")]
    (slots, names), (slot, term) = ([c.dictionary for c in coded], [c.indices.to_numpy() for c in coded])
    tags: list = [None] * len(slots)
    labels: dict[str, int] = {}
    if "tags" in queries.columns:
        wanted = queries.select("slot_id", "tags").toArrow()
        given = dict(zip(wanted["slot_id"].to_pylist(), wanted["tags"].to_pylist(), strict=True))
        tags = [None if (t := given[s]) is None else frozenset(labels.setdefault(x, len(labels)) for x in t if x is not None) for s in slots.to_pylist()]
    n_terms = len(names)
    batch = _Batch(slots, slot, term, rows["w"].to_numpy(), n_terms, tags)
    figures = index.figures.select("avgdl", "k1", "b").first() or (0.0, 0.0, 0.0)
    shared = spark.sparkContext.broadcast((batch, max(figures[0], 1e-9), figures[1], figures[2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, avgdl, k1, b = shared.value
        best, counted, left = _Best(len(batch.slots), k), np.zeros(2, np.int64), None

        def out(found, counts=None):
            if counts is not None:
                return pa.RecordBatch.from_arrays([pa.nulls(1, batch.slots.type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), *(pa.array([int(c)], pa.int64()) for c in counts)], names=FOUND)
            return pa.RecordBatch.from_arrays([batch.slots.take(pa.array(found[0])), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64()), *[pa.nulls(len(found[0]), pa.int64())] * 2], names=FOUND)

        def search(rows: pa.Table) -> None:
            number, tid, bound, bits = (rows[c].to_numpy() for c in ("range", "tid", "bound", "bits"))
            members = rows["members"].combine_chunks()
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(members), 0).to_numpy(zero_copy_only=False))])
            flat = pc.list_flatten(members)
            pos, tf, dl = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "tf", "dl"))
            value, owner = _saturated(tf.astype(np.float64), dl, avgdl, k1, b), np.repeat(np.arange(len(tid)), np.diff(ends))
            starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
            for lo, hi in zip(starts, np.append(starts[1:], len(number)), strict=True):
                term = np.flatnonzero(tid[lo:hi] >= 0) + lo
                if not len(term):
                    continue
                where = slice(ends[lo], ends[hi])
                matrix = np.zeros((hi - lo, RANGE))
                matrix[owner[where] - lo, pos[where] % RANGE] = value[where]
                flags = {-1 - int(tid[i]): int(bits[i]) for i in range(lo, hi) if tid[i] < 0}
                counted[:] += _search_range(batch, best, int(number[lo]), tid[term], bound[term], matrix[term - lo], flags)

        for piece in batches:
            rows = pa.Table.from_batches([piece]) if left is None else pa.concat_tables([left, pa.Table.from_batches([piece])])
            number = rows["range"].to_numpy()
            # The last range of a batch may go on in the next.
            whole = int(np.searchsorted(number, number[-1])) if len(number) else 0
            left = rows.slice(whole)
            if whole:
                search(rows.slice(0, whole).combine_chunks())
            if best.held > HELD:
                yield out(best.take())
        if left is not None and left.num_rows:
            search(left.combine_chunks())
        yield out(best.take())
        yield out((), counted)

    kind = queries.schema["slot_id"].dataType.simpleString()
    schema = f"slot_id {kind}, pos bigint, score double, n_blocks bigint, n_scored bigint"
    if not len(slots):
        return spark.createDataFrame([], schema)
    sent = lambda names, column: F.broadcast(spark.createDataFrame(list(names), f"{column} string, tid int"))
    blocks = _own_blocks(index, asked)[0].select("term", "range", "bound", "members")
    read = blocks.join(sent(((t, i) for i, t in enumerate(names.to_pylist())), "term"), "term").select("range", "tid", "bound", F.lit(0).cast("bigint").alias("bits"), "members")
    if labels:
        flags = index.members.join(sent(((t, -1 - i) for t, i in labels.items()), "tag"), "tag")
        none = F.lit(None).cast(blocks.schema["members"].dataType)
        read = read.unionByName(flags.select("range", "tid", F.lit(0.0).alias("bound"), "bits", none.alias("members")))
    return read.repartition("range").sortWithinPartitions("range").mapInArrow(run, schema)


def search_blocks(index: TextIndex, queries: DataFrame, k: int, first: int = FIRST) -> Found:
    """The ``k`` best documents of each query (slot_id, query[, tags]), with a score above 0, ties to the lower seq.

    tags null is no filter; an empty array lets nothing through. A term that a query repeats counts as often; statistics
    are of the whole corpus. Null and empty queries find nothing.
    """
    asked = materialize(_asked(index, queries), "asked")
    if asked.count() > MOST_AT_ONCE:
        return _search_joined(index, queries, asked, k, first)
    found = materialize(_searched(index, asked, queries, k), "scores")
    # Each task has passed on its own best rows; of all, those below the k-th score go before ids are looked up.
    order = Window.partitionBy("slot_id").orderBy(F.desc("score"))
    near = found.filter(F.col("pos").isNotNull()).withColumn("_n", F.rank().over(order)).filter(F.col("_n") <= k).select("slot_id", "pos", "score")
    return Found(_ranked(index, near, k), found.filter(F.col("pos").isNull()))


def _ranked(index: TextIndex, found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("slot_id").orderBy(F.desc("score"), "seq")
    rows = found.join(index.documents.select("pos", "id", "seq"), "pos").drop("pos")
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("slot_id", "id", "seq", "score", "rank")


def _search_joined(index: TextIndex, queries: DataFrame, asked: DataFrame, k: int, first: int) -> Found:
    """The same by joins, for batches of queries that are too large to be sent to all tasks."""
    blocks, side = _own_blocks(index, asked)
    bounds = blocks.select("term", "range", "bound").join(side, "term").groupBy("slot_id", "range").agg(F.sum(F.greatest(F.col("w"), F.lit(0.0)) * F.col("bound")).alias("most"), F.count("*").alias("n"))
    if "tags" in queries.columns:
        wanted = queries.filter(F.col("tags").isNotNull()).select("slot_id", F.explode(F.array_distinct("tags")).alias("tag"))
        bits = wanted.join(index.members, "tag").groupBy("slot_id", "range").agg(F.bit_or("bits").alias("bits"))
        free = queries.select("slot_id", F.col("tags").isNull().alias("_free"))
        bounds = bounds.join(bits, ["slot_id", "range"], "left").join(free, "slot_id").filter(F.col("_free") | F.col("bits").isNotNull()).drop("_free")
    else:
        bounds = bounds.withColumn("bits", F.lit(None).cast("bigint"))
    bounds = materialize(bounds, "bounds")
    order = Window.partitionBy("slot_id").orderBy(F.desc("most"), "range")
    early = materialize(bounds.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= first * k).drop("_n"), "early")
    late = bounds.join(early.select("slot_id", "range"), ["slot_id", "range"], "left_anti")
    begun = materialize(_scored(blocks, side, early.select("slot_id", "range", "bits"), index.figures).filter("score > 0"), "scores")
    place = Window.partitionBy("slot_id").orderBy(F.desc("score"))
    least = begun.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") == k).select("slot_id", F.col("score").alias("least"))
    # A score is rounded to six places, so a bound that is lower by less may still reach it.
    needed = materialize(late.join(least, "slot_id", "left").filter(F.col("least").isNull() | (F.col("most") >= F.col("least") - 1e-5)).select("slot_id", "range", "bits", "n"), "needed")
    found = begun.unionByName(_scored(blocks, side, needed.drop("n"), index.figures).filter("score > 0"))
    none = F.lit(0).cast("bigint")
    counts = bounds.select(F.col("n").alias("n_blocks"), none.alias("n_scored")).unionByName(early.select("n").unionByName(needed.select("n")).select(none.alias("n_blocks"), F.col("n").alias("n_scored")))
    return Found(_ranked(index, found, k), counts)
