"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints are 64 bits. The anchors are the codewords of a product of perfect codes: two binary Golay codes of
23 bits (covering radius 3) and two repetition codes of 9 bits (covering radius 4), 2**26 anchors in all. Each
fingerprint has exactly one anchor within the covering radius of every block: its home. Of two fingerprints that
differ in at most ``threshold`` bits, the second lies within radius + e_i of the first one's home in block i, with
the e_i summing to at most ``threshold``. So every fingerprint is replicated to all anchors within covering radius
plus threshold in that sense (72 on average for 2 bits), is compared there with the fingerprints that are at home,
and no link is missed. Replication is constant, candidates per anchor fall with 2**26.

Work is done on distinct fingerprints; copies of a text only count as members. Links are turned into components by
rounds of large-star and small-star contraction, each round written to the shared folder.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import map_rows, materialize

#: Generator polynomial of the binary Golay code [23, 12, 7], a published constant.
GOLAY = 0b110001110101
SEED = 42
#: Edges in a file of a contraction round, which never has more edges than links and nodes.
EDGES_PER_FILE = 500_000


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """A hash of each word shingle of a text, repeats included; all words are one shingle where there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)


def fingerprint_of(hashed: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashed), 65536):
        part = hashed[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashed), bitorder="little").tobytes(), "little")


def text_fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of one text over word shingles, repeats included; 0 where there is no word."""
    return fingerprint_of(shingle_hashes(text, shingle))


class BlockCode:
    """A perfect linear code on ``bits`` bits: for each syndrome, the error patterns up to radius + threshold.

    ``patterns[e]`` and ``starts[e]`` list by syndrome the patterns whose weight exceeds the radius by e
    (0 for all up to the radius, of which a perfect code has exactly one).
    """

    def __init__(self, bits: int, radius: int, columns: list[int], threshold: int):
        self.bits = bits
        syndromes = 1 << max(c.bit_length() for c in columns)
        self.tables = []
        for low in range(0, bits, 8):
            table = np.zeros(256, np.int64)
            for i, c in enumerate(columns[low : low + 8]):
                table[(np.arange(256) >> i & 1).astype(bool)] ^= c
            self.tables.append(table)
        self.patterns, self.starts = [], []
        for excess in range(threshold + 1):
            weights = range(radius + 1) if excess == 0 else [radius + excess]
            found = np.array([sum(1 << i for i in c) for w in weights if w <= bits for c in combinations(range(bits), w)], np.uint64)
            at = self.syndrome(found)
            self.patterns.append(found[np.argsort(at, kind="stable")])
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=syndromes))]))
        if np.diff(self.starts[0]).max() != 1:
            raise ValueError("the code is not perfect")

    def syndrome(self, block: np.ndarray) -> np.ndarray:
        out = np.zeros(len(block), np.int64)
        for i, table in enumerate(self.tables):
            out ^= table[(block >> np.uint64(8 * i) & np.uint64(255)).astype(np.int64)]
        return out


class AnchorCode:
    """The product code over 64 bits, and the anchors of given fingerprints."""

    def __init__(self, threshold: int = 2):
        golay = []
        for i in range(23):
            rest = 1 << i
            while rest.bit_length() > 11:
                rest ^= GOLAY << (rest.bit_length() - 12)
            golay.append(rest)
        repeat = [0b11111111, *(1 << i for i in range(8))]
        self.threshold = threshold
        g, r = BlockCode(23, 3, golay, threshold), BlockCode(9, 4, repeat, threshold)
        self.blocks = [g, g, r, r]

    def anchors(self, prints: np.ndarray, spread: bool) -> tuple[np.ndarray, np.ndarray]:
        """(index of the fingerprint, anchor) pairs: the homes, or all within radius + threshold if ``spread``."""
        rows, found = [], []
        parts, syndromes, shift = [], [], 0
        for code in self.blocks:
            parts.append(prints >> np.uint64(shift) & np.uint64((1 << code.bits) - 1))
            syndromes.append(code.syndrome(parts[-1]))
            shift += code.bits
        for excess in product(range(self.threshold + 1 if spread else 1), repeat=len(self.blocks)):
            if sum(excess) > self.threshold:
                continue
            row, anchor, shift = np.arange(len(prints)), np.zeros(len(prints), np.uint64), 0
            for code, part, syndrome, e in zip(self.blocks, parts, syndromes, excess, strict=True):
                first, last = code.starts[e][syndrome[row]], code.starts[e][syndrome[row] + 1]
                n = last - first
                pick = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                row, anchor = np.repeat(row, n), np.repeat(anchor, n)
                anchor |= (part[row] ^ code.patterns[e][pick]) << np.uint64(shift)
                shift += code.bits
            rows.append(row)
            found.append(anchor)
        return np.concatenate(rows), np.concatenate(found)


@cache
def _code(threshold: int) -> AnchorCode:
    return AnchorCode(threshold)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row (id, fp long) per row of ``docs``. Null and empty texts have fingerprint 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.fromiter((text_fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=[id_col, "fp"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], f"`{id_col}` {kind}, fp bigint", run)


def _anchored(prints: DataFrame, threshold: int, spread: bool) -> DataFrame:
    def run(batch: pa.RecordBatch):
        own = batch.column(0).to_numpy().view(np.uint64)
        row, anchor = _code(threshold).anchors(own, spread)
        return pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(own[row].view(np.int64))], names=["anchor", "other" if spread else "fp"])

    return map_rows(prints, ["fp"], "anchor bigint, " + ("other" if spread else "fp") + " bigint", run)


def links(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """All pairs (fp, other), fp < other, of the distinct column ``fp`` that differ in 1 to ``threshold`` bits."""
    home, spread = _anchored(prints, threshold, False), _anchored(prints, threshold, True)
    near = (F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= threshold)
    # By its statistics the replicated side is as small as its input, and could be broadcast.
    return home.join(spread.hint("merge"), "anchor").filter(near).select("fp", "other")


def components(pairs: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``pairs``, its first two columns; root is the least node of the component."""
    a, b = pairs.columns[:2]
    known = pairs.count()
    files = 1 + known // EDGES_PER_FILE
    edges = materialize(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges", files=files)
    state = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges", files=files)
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % (1 << 40)), F.lit(0))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select("v", "v").distinct().toDF("node", "root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, shingle: int = 3) -> DataFrame:
    """(id, fingerprint, component_id, n_links) for every row of ``docs``.

    component_id is the least non-null id reachable over links of ``threshold`` bits or fewer; equal fingerprints are
    linked. n_links counts the other distinct fingerprints that this one links to.

    Null or empty text: fingerprint 0, linked like any other. Repeated rows are returned as often as they come. A null
    id is kept and never names a component; a component of null ids only has component_id null. Other columns of
    ``docs`` are ignored. An empty table gives an empty result.
    """
    own = materialize(fingerprints(docs, id_col, text_col, shingle), "prints")
    classes = materialize(own.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    pairs = materialize(links(classes.select("fp"), threshold), "links")
    degree = pairs.unionByName(pairs.select(F.col("other").alias("fp"), F.col("fp").alias("other"))).groupBy("fp").agg(F.count("*").alias("n_links"))
    roots = components(pairs).withColumnRenamed("node", "fp")
    linked = classes.join(roots, "fp")
    named = linked.groupBy("root").agg(F.min("least").alias("least_of_all"))
    joined = linked.join(named, "root").join(degree, "fp").select("fp", "least_of_all", "n_links")
    classes = classes.join(joined, "fp", "left").select("fp", F.coalesce("least_of_all", "least").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # Written first, so that both sides of the last join are plain exchanges and a fingerprint of many copies is split.
    classes = materialize(classes, "components")
    return own.join(classes, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the component's least id.

    Ids may repeat with different texts; of rows with the least id the text whose hash is least stays. Rows that repeat
    the kept id and text come once. Rows with a null id cannot be told apart and are all kept. Columns may have any names.
    """
    rows, key = with_row_key(docs, id_col, text_col)
    found = near_duplicates(rows.filter(F.col(id_col).isNotNull()).select(F.col(key).alias("row"), F.col(text_col).alias("text")), "row", "text", threshold, shingle)
    keep = found.filter(F.col("row") == F.col("component_id")).select(F.col("row").alias(key), F.col("row").alias("group"))
    return one_of_each(rows, key, keep, id_col).select(*docs.columns)


def with_row_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """``docs`` with a column that has the id beside a hash of the text (ids may repeat with different texts), and that
    column's name, which none of ``docs`` has."""
    name = "_row"
    while name in map(str.lower, docs.columns):
        name = "_" + name
    return docs.withColumn(name, F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))), name


def one_of_each(rows: DataFrame, key: str, grouped: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``with_row_key`` whose key is the least of its group in ``grouped`` (key, group), once each, and those
    with a null id."""
    keep = grouped.groupBy("group").agg(F.min(key).alias(key)).select(key).distinct()
    return rows.join(keep, key, "left_semi").dropDuplicates([key]).unionByName(rows.filter(F.col(id_col).isNull()))
