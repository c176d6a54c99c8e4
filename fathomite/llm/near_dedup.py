"""The pipeline's near-duplicates: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

At similarity 0.8 two 64-bit SimHash fingerprints differ in about ten bits, far beyond what anchors of a covering code
can reach (72 anchors at 2 bits, many thousands at 10). So the anchors give the first candidates, and an inverted index
over set prefixes gives all others: with the shingles of every set in one common order, two sets of similarity s share
one of their first n - ceil(s n) + 1 shingles. Every candidate is decided by the exact similarity of the whole sets, so
no pair is missed and none is added; the order, common shingles last, only decides how many candidates there are.

Common shingles last is by a sketch of their frequencies over all texts. So a text's prefix has its own shingles first,
and those of a passage or a family of copies only where its own do not fill it.

Candidates come in turns, so that a large group of near copies gives no square of pairs: in each turn the texts under a
shingle are compared with one of them, and those that are now in one component are no longer compared with one another.
Only what is still apart after the last turn is compared pair by pair, where the parity bits of both sets, a bound that
no similar pair fails, leave few pairs but the similar ones. Components are then those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_rows, materialize, small_batches
from .simhash_anchor import components, fingerprint_of, links, one_of_each, shingle_hashes, with_row_key

SHINGLE = 5
#: Similarity as a fraction of whole numbers: 0.8.
NUM, DEN = 4, 5
#: The sketch of shingle frequencies has 2**SKETCH_BITS counts. It bounds memory; any size gives the same pairs.
SKETCH_BITS = 20
#: Longs of parity bits kept of each set.
WORDS = 8
#: Turns in which the texts under a shingle are compared with one of them, before all that are still apart are.
HEADS = 2


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


@lru_cache(64)
def _remembered(text: str | None, shingle: int) -> np.ndarray:
    """A group's least text is compared with many."""
    return shingle_set(text, shingle)


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1 if n else 0


def is_similar(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return len(a) == len(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def frequency_sketch(docs: DataFrame, text_col: str, shingle: int = SHINGLE, bits: int | None = None) -> np.ndarray:
    """How many texts have a shingle whose hash begins with each of ``2**bits`` values, over all texts.

    Every task adds up its texts in one array and passes on the counts above zero, so what is shuffled does not depend
    on the number of texts, nor does what reaches the driver (8 bytes a count).
    """

    bits = SKETCH_BITS if bits is None else bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            if batch.num_rows:
                seen = np.concatenate([shingle_set(t.as_py(), shingle) for t in batch.column(0)]) >> np.uint64(64 - bits)
                at, n = np.unique(seen.astype(np.int64), return_counts=True)
                counts[at] += n
        used = np.flatnonzero(counts)
        for lo in range(0, len(used), 50_000):
            part = used[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part])], names=["at", "n"])

    small_batches(docs.sparkSession)
    found = docs.select(text_col).mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.least(F.sum("n"), F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    sketch = np.zeros(1 << bits, np.int32)
    sketch[found["at"].to_numpy()] = found["n"].to_numpy()
    return sketch


def signatures(docs: DataFrame, row_col: str, text_col: str, sketch: np.ndarray, shingle: int = SHINGLE) -> DataFrame:
    """(row, key, check, fp, n, bits, prefix) for each row: key and check, two hashes, name the shingle set, fp is its text's
    SimHash, n the set's size.

    The common order of shingles is by their count in ``sketch``, then by hash. ``bits`` has the parity of the number of
    shingles whose hash ends in each of ``64 * WORDS`` values: two sets differ in at least as many shingles as their
    bits differ in places.
    """
    shift = np.uint64(64 - (len(sketch).bit_length() - 1))
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def one(text: str | None) -> tuple[int, int, int, np.ndarray, np.ndarray, int]:
        every = shingle_hashes(text, shingle)
        own = np.unique(every)
        first = own[np.argsort(shared.value[(own >> shift).astype(np.int64)], kind="stable")][: prefix_length(len(own))]
        odd = np.bincount((own % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
        named = xxhash.xxh3_128_intdigest(own.tobytes())
        return named >> 64, fingerprint_of(every), len(own), first, np.packbits(odd.astype(np.uint8)).view(np.int64), named & (2**64 - 1)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [one(t.as_py()) for t in batch.column(1)]
        key, fp, check = (pa.array(np.array([m[i] for m in made], np.uint64).view(np.int64)) for i in (0, 1, 5))
        starts = np.cumsum([0, *(len(m[3]) for m in made)]).astype(np.int32)
        prefix = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate([m[3] for m in made]).view(np.int64)))
        bits = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * WORDS), pa.array(np.concatenate([m[4] for m in made])))
        return pa.RecordBatch.from_arrays([batch.column(0), key, check, fp, pa.array([m[2] for m in made], pa.int32()), bits, prefix], names=[row_col, "key", "check", "fp", "n", "bits", "prefix"])

    kind = docs.select(row_col).schema[0].dataType.simpleString()
    return map_rows(docs, [row_col, text_col], f"`{row_col}` {kind}, key bigint, check bigint, fp bigint, n int, bits array<bigint>, prefix array<bigint>", run)


def named_apart(own: DataFrame) -> DataFrame:
    """``own`` without check, and with a key of its own for each shingle set: sets are told apart by 128 bits.

    Two sets with one 64-bit key (about three among ten thousand million) would be one class, and a document would be lost. Where
    checks differ under a key, all but the least get a new key, of both hashes; there are next to none of these rows.
    """
    shared = own.groupBy("key").agg(F.min("check").alias("_least"), F.max("check").alias("_most")).filter("_least < _most").select("key", "_least")
    shared = materialize(shared, "collisions", files=1)
    if shared.isEmpty():
        return own.drop("check")
    return own.join(shared, "key", "left").withColumn("key", F.when(F.col("check") > F.col("_least"), F.xxhash64("key", "check")).otherwise(F.col("key"))).drop("check", "_least")


def _may_match(n: Column, pos: Column, other_n: Column, other_pos: Column) -> Column:
    """Whether sets of these sizes whose first common shingle is at these places can be similar."""
    sizes = DEN * F.least(n, other_n) >= NUM * F.greatest(n, other_n)
    return sizes & ((NUM + DEN) * F.least(n - pos, other_n - other_pos) >= NUM * (n + other_n))


def _bits_allow(n: Column, bits: Column, other_n: Column, other_bits: Column) -> Column:
    """Whether sets of these sizes can be similar by the places in which their bits differ. No similar pair fails."""
    differ = sum((F.bit_count(bits[i].bitwiseXOR(other_bits[i])) for i in range(WORDS)), F.lit(0))
    return (DEN + NUM) * differ <= (DEN - NUM) * (n + other_n)


def decided(pairs: DataFrame, texts: DataFrame, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) of keys whose sets are similar; ``texts`` has one text for each key."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        yes = [is_similar(_remembered(x.as_py(), shingle), _remembered(y.as_py(), shingle)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        return batch.select([0, 1]).filter(pa.array(yes, pa.bool_()))

    own = texts.select("key", F.col(text_col).alias("_text"))
    both = pairs.join(own.toDF("a", "_a").hint("merge"), "a").join(own.toDF("b", "_b").hint("merge"), "b")
    return map_rows(both, ["a", "b", "_a", "_b"], "a bigint, b bigint", run)


def similar_links(docs: DataFrame, own: DataFrame, row_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(node, root) of the components over all pairs of shingle sets at the similarity or above."""
    classes = materialize(own.select("key", "fp", "n", "bits", "prefix", row_col).dropDuplicates(["key"]), "classes")
    postings = classes.select("key", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = postings.groupBy("token").agg(F.min("key").alias("_first"), F.max("key").alias("_last")).filter("_first < _last").select("token")
    under = materialize(postings.join(shared.hint("merge"), "token"), "under")

    def checked(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
        rows = classes.select("key", row_col).join(asked, "key")
        texts = materialize(docs.select(row_col, text_col).join(rows, row_col).select("key", text_col).dropDuplicates(["key"]), "texts")
        return materialize(decided(pairs, texts, text_col, shingle), "links")

    def ordered(x: Column, y: Column) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    # The anchors' links; sets with one fingerprint are named by the least.
    prints = materialize(classes.groupBy("fp").agg(F.min("key").alias("key")), "prints")
    near = links(prints.select("fp")).join(prints.withColumnRenamed("key", "x"), "fp").join(prints.select(F.col("fp").alias("other"), F.col("key").alias("y")), "other")
    found = materialize(near.select(*ordered(F.col("x"), F.col("y"))).distinct(), "candidates")
    roots = materialize(components(checked(found)).withColumnRenamed("node", "key"), "roots")
    for turn in range(HEADS + 1):
        nodes = classes.select("key", "bits").join(roots.hint("merge"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        rooted = under.join(nodes.hint("merge"), "key")
        member = F.struct("key", "n", "pos", "root", "bits")
        # The head is a text with few shingles of its own, which is nearest to most of a group of edited copies: the one
        # with the fewest in the first turn, in later turns any that a set of its size could match, another for each
        # shingle, so that a text that is still apart meets many.
        able = (DEN + NUM) * (F.col("n") - F.col("pos")) >= 2 * NUM * F.col("n")
        order = F.struct("pos", F.xxhash64("key")) if turn == 0 else F.when(able, F.xxhash64("key", "token", F.lit(turn)))
        heads = rooted.groupBy("token").agg(F.min_by(member, order).alias("_h"), F.min("root").alias("_r"), F.max("root").alias("_s")).filter("_r < _s").select("token", "_h")
        if turn == HEADS:
            heads = rooted.join(heads.select("token").hint("merge"), "token").select("token", member.alias("_h"))
        h = F.col("_h")
        apart = (F.col("root") != h["root"]) & _may_match(F.col("n"), F.col("pos"), h["n"], h["pos"]) & _bits_allow(F.col("n"), F.col("bits"), h["n"], h["bits"])
        if turn == HEADS:
            apart = apart & (F.col("key") < h["key"])
        pairs = rooted.join(heads.hint("merge"), "token").filter(apart).select(*ordered(F.col("key"), h["key"])).distinct()
        new = materialize(pairs.join(found, ["a", "b"], "left_anti"), "candidates")
        linked = checked(new).unionByName(roots.filter("key <> root").select(F.col("root").alias("a"), F.col("key").alias("b")))
        found = found.unionByName(new)
        roots = materialize(components(linked).withColumnRenamed("node", "key"), "roots")
    return roots


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the least id.

    Null and empty texts are alike. A text of fewer words than a shingle has one shingle of all of them. Rows that
    repeat the kept id and text come once. Rows with a null id cannot be told apart and are all kept. Columns may have any
    names; an empty table gives none.
    """
    rows, key = with_row_key(docs, id_col, text_col)
    own = named_apart(materialize(signatures(rows, key, text_col, frequency_sketch(rows, text_col, shingle), shingle), "signatures"))
    roots = similar_links(rows, own, key, text_col, shingle)
    least = own.filter(F.col(key)["id"].isNotNull()).groupBy("key").agg(F.min(key).alias(key))
    grouped = least.join(roots, "key", "left").select(key, F.coalesce("root", "key").alias("group"))
    return one_of_each(rows, key, grouped, id_col).select(*docs.columns)
