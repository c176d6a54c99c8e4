"""A stored vector index: coarse cells, product-quantised codes, exact re-ranking, filters inside.

A coarse quantiser puts every vector of length one into the cell of its nearest centroid; what is left over is coded by
a product quantiser, one byte for each few dimensions. Cells are partitions of the written table, so a search reads the
cells that its queries probe and no others: first the codes, whose table look-ups give approximate scores, then the
vectors of the best candidates, which are scored exactly. Quantisers are fitted on a bounded sample (``SAMPLE`` rows, those with
the lowest hash of their id); every row is indexed. How many cells a search probes is calibrated at build, on
sample rows held against the rest of the sample, so that ``RECALL`` of their nearest rows lie in probed cells: for
vectors without structure that is most of the cells, for clustered ones few.

Rows carry tags (such as a period and a document). The index keeps which cells have rows of a tag; a query with tags
probes its nearest cells among those only, and rows without one of its tags get no score.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..storage import current, materialize, once, publish, released
from .tags import fits

SAMPLE, MOST_CELLS, RECALL = 20_000, 4096, 0.96
#: Dimensions that share a byte of the code, and candidates that are scored exactly for each row asked for.
DIMS_A_BYTE, CANDIDATES = 4, 20
#: Rows of a cell that one task writes, and queries scored side by side.
CELL_ROWS, SIDE_BY_SIDE = 500_000, 256
#: To be raised whenever what is written changes, so that no index of former code is opened.
LAYOUT = 2
#: Query vectors that are held beside the codes at a time.
QUERY_BLOCK = 4096
#: Scores that a worker holds as one matrix, whatever the number of cells, rows and queries.
SCORES = 500_000


def _units(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half, out, step = 0.5 * (centres * centres).sum(1), np.empty(len(x), np.int64), max(1, SCORES // len(centres))
    for lo in range(0, len(x), step):
        score = x[lo : lo + step] @ centres.T
        score -= half
        score.argmax(1, out=out[lo : lo + step])
    return out


def fit_centres(x: np.ndarray, k: int, rounds: int, seed: int, unit: bool = False) -> np.ndarray:
    """k-means centres of ``x``; ``unit`` keeps them at length one. An empty centre takes a row at random."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        order = np.argsort(own, kind="stable")
        found, starts = np.unique(own[order], return_index=True)
        counts = np.diff(np.append(starts, len(x)))[:, None]
        centres[found] = np.add.reduceat(x[order], starts, axis=0) / counts
        empty = np.setdiff1d(np.arange(k), found)
        centres[empty] = x[rng.choice(len(x), len(empty))]
        if unit:
            centres = _units(centres)
    return centres


@dataclass
class Quantiser:
    """Centres of the cells (cells, dim), code books (bytes, 256, dims a byte; the last padded with zeros), and how many
    cells a query probes: 0 where there are no rows."""

    centres: np.ndarray
    books: np.ndarray
    probes: int

    @property
    def padded(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def _split(self, x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), self.padded), np.float32)
        wide[:, : x.shape[1]] = x
        return wide.reshape(len(x), self.books.shape[0], self.books.shape[2])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, code bytes) of unit vectors."""
        cell = _nearest(x, self.centres)
        left = self._split(x - self.centres[cell])
        return cell, np.stack([_nearest(left[:, m], book) for m, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def scores(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Approximate cosines (queries, rows) of rows of one cell."""
        tables = np.einsum("qmd,mkd->mqk", self._split(q), self.books, optimize=True)
        out = np.repeat((q @ self.centres[cell])[:, None], len(codes), axis=1)
        for m, table in enumerate(tables):
            out += table[:, codes[:, m]]
        return out


def fit(sample: np.ndarray, rows: int, seed: int = 1) -> Quantiser:
    """A quantiser for ``rows`` rows, of which ``sample`` are unit vectors; about twice their root in cells."""
    n, dim = sample.shape
    cells = int(min(MOST_CELLS, max(1, n // 8), max(1, round(2 * rows**0.5))))
    centres = fit_centres(sample, cells, 10, seed, unit=True)
    own = _nearest(sample, centres)
    parts = -(-dim // DIMS_A_BYTE)
    left = np.zeros((n, parts * DIMS_A_BYTE), np.float32)
    left[:, :dim] = sample - centres[own]
    left = left.reshape(n, parts, DIMS_A_BYTE)
    books = np.stack([fit_centres(left[:, m], 256, 6, seed + m) if n >= 256 else np.resize(left[:, m], (256, DIMS_A_BYTE)) for m in range(parts)])
    asked = np.random.default_rng(seed).permutation(n)[:256]
    near = sample[asked] @ sample.T
    near[np.arange(len(asked)), asked] = -2
    top = np.argsort(-near, axis=1)[:, : min(10, n - 1)]
    place = np.argsort(np.argsort(-(sample[asked] @ centres.T), axis=1), axis=1)
    depth = np.sort(np.take_along_axis(place, own[top], axis=1).ravel())
    probes = int(depth[min(len(depth) - 1, int(np.ceil(RECALL * len(depth))))]) + 1 if len(depth) else 1
    return Quantiser(centres, books, probes)


@dataclass
class VectorIndex:
    """rows (cell, id, seq, tags, code, vector), partitioned by cell; cells_of (tag, cells: cell and number of rows)."""

    rows: DataFrame
    cells_of: DataFrame
    quantiser: Quantiser


def _sample(vectors: DataFrame, n: int, limit: int) -> np.ndarray:
    h = F.xxhash64("id")
    share = min(1.0, 2 * limit / max(n, 1))
    some = vectors if share >= 1 else vectors.filter(h <= F.lit(int(-(2**63) + share * 2**64)))
    table = some.select(h.alias("_h"), F.col("vector").cast("array<float>").alias("vector")).orderBy("_h").limit(limit).select("vector").toArrow()
    return _matrix(table["vector"].combine_chunks())


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    if len(column) and len(flat) % len(column):
        raise ValueError("vectors differ in length")
    return _units(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 1), np.float32)


def _write(vectors: DataFrame, place: str, sample: int) -> None:
    spark = vectors.sparkSession
    seq = F.col("seq") if "seq" in vectors.columns else F.col("id")
    tags = F.coalesce("tags", F.array().cast("array<string>")) if "tags" in vectors.columns else F.array().cast("array<string>")
    own = vectors.filter(F.col("vector").isNotNull()).select("id", seq.alias("seq"), tags.alias("tags"), F.col("vector").cast("array<float>").alias("vector"))
    n, lengths = own.agg(F.count("*"), F.collect_set(F.size("vector"))).first()
    if len(lengths) > 1:
        raise ValueError(f"vectors differ in length: {sorted(lengths)[:5]}")
    if n:
        quantiser = fit(_sample(own, n, sample), n)
    else:
        quantiser = Quantiser(np.zeros((1, 1), np.float32), np.zeros((1, 256, DIMS_A_BYTE), np.float32), 0)
    shared = spark.sparkContext.broadcast(quantiser)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _matrix(batch.column(3))
            cell, codes = shared.value.encode(unit)
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())
            vector = pa.ListArray.from_arrays(pa.array(np.arange(0, unit.size + 1, unit.shape[1], dtype=np.int32)), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *batch.columns[:3], flat, vector], names=["cell", "id", "seq", "tags", "code", "vector"])

    kinds = {c: own.schema[c].dataType.simpleString() for c in ("id", "seq")}
    coded = own.mapInArrow(code, f"cell int, id {kinds['id']}, seq {kinds['seq']}, tags array<string>, code binary, vector array<float>")
    with released(spark):
        coded = materialize(coded, "coded")
        sizes = coded.groupBy("cell").agg(F.count("*").alias("n"))
        heavy = sizes.filter(F.col("n") > CELL_ROWS).select("cell", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("salts"))
        salted = coded.join(F.broadcast(heavy), "cell", "left").withColumn("_salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1)))).drop("salts")
        salted.repartition("cell", "_salt").sortWithinPartitions("cell", "id").drop("_salt").write.option("maxRecordsPerFile", CELL_ROWS).partitionBy("cell").parquet(f"{place}/rows")
        counted = coded.select("cell", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag", "cell").agg(F.count("*").alias("n"))
        counted.groupBy("tag").agg(F.collect_list(F.struct("cell", "n")).alias("cells")).write.parquet(f"{place}/cells_of")
        model = [("centres", quantiser.centres), ("books", quantiser.books)]
        rows = [(name, json.dumps(list(x.shape)), bytearray(x.astype("<f4").tobytes())) for name, x in model]
        rows += [("probes", str(quantiser.probes), bytearray()), ("kinds", json.dumps(kinds), bytearray())]
        spark.createDataFrame(rows, "name string, shape string, data binary").coalesce(1).write.parquet(f"{place}/model")


def build_vector_index(vectors: DataFrame, path: str, sample: int = SAMPLE) -> VectorIndex:
    """Index ``vectors`` (id, vector[, seq, tags]) under ``path``; a former index there is replaced whole, when this one
    is written.

    seq breaks ties and is the id where there is none; tags is ARRAY<STRING>. A null vector is left out, one of zeros
    kept with score 0. Vectors must agree in length. A cell with very many rows (copies of one text) is written by
    several tasks. An empty table gives an index that finds nothing.
    """
    publish(vectors.sparkSession, path, lambda place: _write(vectors, place, sample))
    return open_vector_index(vectors.sparkSession, path)


def open_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    """The index that was published under ``path``."""
    place = current(spark, path)
    if place is None:
        raise FileNotFoundError(f"no index under {path}")
    return _open(spark, place)


def vector_index(vectors: DataFrame, name: str | None, sample: int = SAMPLE) -> VectorIndex:
    """The index of ``vectors`` in the shared folder: built by the first call for the files that it reads, then opened."""
    return _open(vectors.sparkSession, once(vectors, name and f"vector{LAYOUT}_{name}_{sample}", lambda place: _write(vectors, place, sample)))


def _open(spark: SparkSession, place: str) -> VectorIndex:
    # Centres and code books, a few MB at most, come to the driver.
    model = {r["name"]: r for r in spark.read.schema("name string, shape string, data binary").parquet(f"{place}/model").collect()}
    array = lambda name: np.frombuffer(bytes(model[name]["data"]), "<f4").reshape(json.loads(model[name]["shape"])).copy()
    kinds = json.loads(model["kinds"]["shape"])
    schema = f"id {kinds['id']}, seq {kinds['seq']}, tags array<string>, code binary, vector array<float>, cell int"
    rows = spark.read.schema(schema).parquet(f"{place}/rows")
    cells_of = spark.read.schema("tag string, cells array<struct<cell:int,n:bigint>>").parquet(f"{place}/cells_of")
    return VectorIndex(rows, cells_of, Quantiser(array("centres"), array("books"), int(model["probes"]["shape"])))


def probed(index: VectorIndex, q: np.ndarray, tags: list[list[str] | None], k: int, probes: int | None = None) -> list[np.ndarray]:
    """The cells that each query probes, nearest first: as many as calibrated, and more where a filter leaves them with
    fewer than four times the rows asked for."""
    quantiser = index.quantiser
    most = probes or quantiser.probes
    order = np.argsort(-(q @ quantiser.centres.T), axis=1, kind="stable")
    asked = sorted({t for own in tags if own is not None for t in own})
    held = {t: np.zeros(len(quantiser.centres), np.int64) for t in asked}
    if asked:
        wanted = index.rows.sparkSession.createDataFrame([(t,) for t in asked], "tag string")
        for r in index.cells_of.join(F.broadcast(wanted), "tag").collect():
            held[r["tag"]][[c["cell"] for c in r["cells"]]] = [c["n"] for c in r["cells"]]
    out = []
    for cells, own in zip(order, tags, strict=True):
        if own is not None:
            rows = sum((held[t] for t in set(own)), np.zeros(len(quantiser.centres), np.int64))
            cells = cells[rows[cells] > 0]
            enough = int(np.searchsorted(np.cumsum(rows[cells]), 4 * k)) + 1
            cells = cells[: max(most, enough)]
        out.append(cells[:most] if own is None else cells)
    return out


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, candidates: int = CANDIDATES) -> DataFrame:
    """(slot_id, id, seq, score, rank): the ``k`` rows nearest to each query, of those in the cells that it probes.

    ``queries`` is (slot_id, vector[, tags]), a stated batch: vectors come to the driver and go to all tasks, at most
    ``QUERY_BLOCK`` at a time. tags null means no filter, an empty array that no row fits. Scores are exact cosines rounded
    to six places, ties go to the lower seq. A null query vector finds nothing.
    """
    spark = index.rows.sparkSession
    tags = F.col("tags").cast("array<string>") if "tags" in queries.columns else F.lit(None).cast("array<string>")
    own = queries.filter(F.col("vector").isNotNull()).select("slot_id", F.col("vector").cast("array<float>").alias("vector"), tags.alias("tags"))
    asked, kind = own.toArrow(), own.schema["slot_id"].dataType.simpleString()
    schema = f"slot_id {kind}, cell int, id {index.rows.schema['id'].dataType.simpleString()}, approx float"
    if not index.quantiser.probes:
        asked = asked.slice(0, 0)
    dim = index.quantiser.centres.shape[1]
    if any(len(v) != dim for v in asked["vector"]):
        raise ValueError(f"a query vector has another length than the index's {dim}")
    found, read = spark.createDataFrame([], schema), set()
    for lo in range(0, asked.num_rows, QUERY_BLOCK):
        block = asked.slice(lo, QUERY_BLOCK)
        cells = probed(index, _matrix(block["vector"]), block["tags"].to_pylist(), k, probes)
        read.update(int(c) for own_cells in cells for c in own_cells)
        found = found.unionByName(_candidates(index, block, cells, schema, k * candidates))
    first = Window.partitionBy("slot_id").orderBy(F.desc("approx"), "id")
    best = found.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k * candidates).select("slot_id", "cell", "id").distinct()
    q = F.transform(F.col("_q"), lambda x: x.cast("double"))
    v = F.transform(F.col("vector"), lambda x: x.cast("double"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    # Candidates are few: slots times candidates; the rows that they stand for are read from the cells probed.
    wide = index.rows.filter(F.col("cell").isin(sorted(read))).select("cell", "id", "seq", "vector")
    scored = wide.join(best, ["cell", "id"]).join(own.select("slot_id", F.col("vector").alias("_q")), "slot_id")
    norm = F.sqrt(dot(q, q)) * F.sqrt(dot(v, v))
    scored = scored.select("slot_id", "id", "seq", F.when(norm > 0, F.round(dot(q, v) / norm, 6)).otherwise(0.0).alias("score"))
    order = Window.partitionBy("slot_id").orderBy(F.desc("score"), "seq")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _askers(probing: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells that queries probe, in order, where the queries of each start, and the numbers of these queries, two bytes
    each: every worker holds them, and there are as many as queries times probes."""
    cells = np.concatenate([np.asarray(c, np.int32) for c in probing]) if probing else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(len(probing), dtype=np.min_scalar_type(len(probing))), [len(c) for c in probing])
    order = np.argsort(cells, kind="stable")
    found, starts = np.unique(cells[order], return_index=True)
    return found, np.append(starts, len(cells)), owner[order]


def _candidates(index: VectorIndex, block: pa.Table, probing: list[np.ndarray], schema: str, most: int) -> DataFrame:
    """The best ``most`` rows of each batch of codes for each query of a block, by approximate score."""
    q, tags, names = _matrix(block["vector"]), block["tags"].to_pylist(), block["slot_id"].combine_chunks()
    askers = _askers(probing)
    allowed = [None if t is None else set(t) for t in tags]
    filtered = any(a is not None for a in allowed)
    shared = index.rows.sparkSession.sparkContext.broadcast((index.quantiser, q, names, askers, allowed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser, q, names, (known, starts, owner), allowed = shared.value
        for batch in batches:
            cells = batch.column(0).to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for a, b in zip(bounds, bounds[1:]):
                at = int(np.searchsorted(known, cells[a])) if b > a else len(known)
                if at == len(known) or known[at] != cells[a]:
                    continue
                asking = owner[starts[at] : starts[at + 1]].astype(np.int64)
                ids = batch.column(1).slice(a, b - a)
                codes = np.frombuffer(b"".join(batch.column(2).slice(a, b - a).to_pylist()), np.uint8).reshape(b - a, -1)
                side = max(1, min(SIDE_BY_SIDE, SCORES // (b - a)))
                for at in range(0, len(asking), side):
                    some = asking[at : at + side]
                    score = quantiser.scores(q[some], int(cells[a]), codes)
                    if filtered:
                        score[~fits(batch.column(3).slice(a, b - a), [allowed[i] for i in some])] = -np.inf
                    if score.shape[1] > most:
                        i, j = np.nonzero(score >= np.partition(score, -most, axis=1)[:, -most][:, None])
                    else:
                        i, j = (x.ravel() for x in np.indices(score.shape))
                    keep = np.isfinite(score[i, j])
                    i, j = i[keep], j[keep]
                    own = some[i]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(own)), pa.array(np.full(len(i), cells[a], np.int32)), ids.take(pa.array(j)), pa.array(score[i, j].astype(np.float32))], names=["slot_id", "cell", "id", "approx"])

    codes = index.rows.filter(F.col("cell").isin(askers[0].tolist())).select("cell", "id", "code", "tags")
    return codes.mapInArrow(run, schema)
