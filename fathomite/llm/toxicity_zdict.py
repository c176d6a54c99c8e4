"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on toxic text. Trained on whole toxic texts the second
fills with what both kinds share and does not separate them (README has the figures), so it is trained on those
segments of toxic texts that set them apart: runs of byte n-grams found in many toxic texts and, in proportion, in few
ordinary ones. Each window of a text is compressed twice, with the ordinary dictionary and with the toxic one in front
of it; a window is closer to toxic text by as many bytes as the second result is shorter. The largest distances, the
mean distance, the share of windows past a distance and the number of windows are calibrated on labelled rows that no
dictionary has seen, by a logistic fit whose one half is the threshold. All windows of a text are compressed, in
training as in scoring, so a long text is seen whole.

Training is on a bounded sample of labelled rows, exact and near copies left out so that a text which was copied often
does not fill a dictionary. Texts stay on the executors: the driver gets a sketch of fixed size and a few pieces of each
sampled text, counts of n-grams, the marked runs, and seven figures for each row to calibrate by. The model has a fixed
size.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import bounded_sample, fold, map_rows, materialize

WINDOW, STEP, LEVEL = 40, 20, 12
ORDINARY_BYTES, TOXIC_BYTES = 16_384, 4_096
GRAM, RATIO, LEAST_SHARE = 6, 12, 0.01
FAR = 3
FOLDS = 5
#: Labelled rows at most to train on.
TOXIC_ROWS, ORDINARY_ROWS = 2000, 6000
#: Of each sampled text, the shingle hashes kept to find copies, and the pieces, spread over all of it, that the
#: ordinary dictionary is trained on.
SKETCH, PIECES, PIECE = 64, 8, 256
THRESHOLD = 0.5


def prepared(text: str | None) -> bytes:
    """Lower-cased UTF-8 with single spaces, one at either end."""
    return (" " + " ".join((text or "").lower().split()) + " ").encode("utf-8", "replace")


def sketch_of(text: bytes) -> np.ndarray:
    """The SKETCH least hashes of the text's 32-byte shingles that begin with a word; sorted."""
    starts = [i for i in range(1, len(text) - 31) if text[i - 1] == 32] or [0]
    hashes = {xxhash.xxh64_intdigest(text[i : i + 32]) for i in starts}
    return np.array(sorted(hashes)[:SKETCH], np.uint64)


def novel(sketches: list[np.ndarray]) -> list[int]:
    """Places of the sketches of which at most a fifth came before."""
    seen: set[int] = set()
    out = []
    for i, sketch in enumerate(sketches):
        own = set(sketch.tolist())
        if len(own & seen) <= 0.2 * len(own):
            out.append(i)
        seen |= own
    return out


def pieces_of(text: bytes) -> list[bytes]:
    """The whole text if it is short, else PIECES pieces at even distances."""
    if len(text) <= PIECES * PIECE:
        return [text]
    return [text[at : at + PIECE] for at in np.linspace(0, len(text) - PIECE, PIECES).astype(int)]


def grams_of(text: bytes) -> set[bytes]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def runs_of(text: bytes, lead: frozenset[bytes]) -> list[bytes]:
    """The longest runs of leading n-grams in a text, each once."""
    own, i, n = set(), 0, len(text) - GRAM + 1
    while i < n:
        j = i
        while j < n and text[j : j + GRAM] in lead:
            j += 1
        if j > i:
            own.add(text[i : j - 1 + GRAM])
        i = j + 1
    return sorted(own)


def dictionary(size: int, samples: list[bytes], **options: int) -> bytes:
    """Dictionary content by zstandard's training; where there is too little for it, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, **options).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:]


def toxic_dictionary(runs: list[bytes], seed: int = 3) -> bytes:
    """A dictionary trained on samples of the marked runs, each drawn as often as texts have it."""
    rng = random.Random(seed)
    return dictionary(TOXIC_BYTES, [b"".join(rng.choices(runs, k=20)) for _ in range(800)], k=16, d=6) if runs else b""


@cache
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)


def distances(text: bytes, ordinary: bytes, toxic: bytes) -> np.ndarray:
    """For each window, by how many bytes the toxic dictionary shortens it more than the ordinary one alone."""
    plain, marked = _compressor(ordinary).compress, _compressor(toxic + ordinary).compress
    windows = [text[i : i + WINDOW] for i in range(0, max(1, len(text) - (WINDOW - STEP)), STEP)]
    return np.fromiter((len(plain(w)) - len(marked(w)) for w in windows), np.int32, len(windows))


def figures(found: np.ndarray) -> np.ndarray:
    top = np.zeros(3)
    best = np.sort(found)[::-1][:3]
    top[: len(best)] = np.minimum(best, 12)
    n = len(found)
    return np.array([*top, (max(int(found.sum()), 0) / n) ** 0.5, (int((found >= FAR).sum()) / n) ** 0.5, np.log(n), 1.0])


class Model:
    """Both dictionaries and the calibration; without toxic or ordinary rows to learn from, every score is 0."""

    def __init__(self, ordinary: bytes = b"", toxic: bytes = b""):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, None

    def figures(self, text: bytes) -> np.ndarray:
        return figures(distances(text, self.ordinary, self.toxic))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic weights of the figures ``x`` of texts labelled ``y``, by Newton's method."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.mean[-1], self.scale[-1] = 0, 1
        x = (x - self.mean) / self.scale
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), x.T @ (y - p) - 0.5 * w)
        self.weights = w

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        x = (self.figures(prepared(text)) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))))


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str) -> DataFrame:
    """(id, label, text) of a bounded sample of labelled rows with crc32(id) mod FOLDS not 0, one for each id.

    Ids are sampled by their hash, toxic and ordinary ones apart. An id with both labels counts as ordinary; of documents
    that share an id, the text that sorts first is taken.
    """
    known = labels.filter((fold(F.col(id_col), FOLDS) != 0) & F.col(label).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
    few = [bounded_sample(known.filter(F.col("label") == y), F.col("id"), most) for y, most in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS))]
    few = few[0].unionByName(few[1]).groupBy("id").agg(F.min("label").alias("label"))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id").groupBy("id").agg(F.min("label").alias("label"), F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from a bounded sample of labelled rows, the same in every run.

    Two thirds of the toxic and three fifths of the ordinary texts, copies left out, train the dictionaries; the others
    calibrate.
    """
    rows = materialize(labelled(docs, labels, label, id_col, text_col), "labelled", files=8)
    spark, key = docs.sparkSession, rows.select("id").schema[0].dataType.simpleString()

    def sketched(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [prepared(t.as_py()) for t in batch.column(2)]
        own = [pa.array([zlib.crc32(t) for t in texts], pa.int64()), pa.array([sketch_of(t).tobytes() for t in texts], pa.binary()), pa.array([pieces_of(t) if y.as_py() == 0 else [] for t, y in zip(texts, batch.column(1), strict=True)], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own], names=["id", "label", "crc", "sketch", "pieces"])

    seen = map_rows(rows, ["id", "label", "text"], f"id {key}, label int, crc bigint, sketch binary, pieces array<binary>", sketched).toArrow()
    order = sorted(range(len(seen)), key=lambda i: (seen["crc"][i].as_py(), str(seen["id"][i])))
    parts, samples, n_of = [], [], {}
    for y, share in ((1, 2 / 3), (0, 3 / 5)):
        own = [i for i in order if seen["label"][i].as_py() == y]
        own = [own[j] for j in novel([np.frombuffer(seen["sketch"][i].as_buffer(), np.uint64) for i in own])]
        if not own:
            return Model()
        n = max(1, int(len(own) * share))
        n_of[y] = n
        parts += [(seen["id"][i].as_py(), "train" if j < n or len(own) == 1 else "check") for j, i in enumerate(own)]
        samples += [p for i in own[:n] for p in seen["pieces"][i].as_py()]
    split = rows.join(F.broadcast(spark.createDataFrame(parts, f"id {key}, part string")), "id")
    learned = split.filter("part = 'train'")

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: Counter[tuple[bytes, int]] = Counter()
        for y, t in zip(batch.column(0), batch.column(1), strict=True):
            found.update((g, y.as_py()) for g in grams_of(prepared(t.as_py())))
        return pa.RecordBatch.from_arrays([pa.array([g for g, _ in found], pa.binary()), pa.array([y for _, y in found], pa.int32()), pa.array(found.values(), pa.int64())], names=["gram", "label", "n"])

    per = map_rows(learned, ["label", "text"], "gram binary, label int, n bigint", counted).groupBy("gram").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("o"))
    often = F.col("t") >= max(4, LEAST_SHARE * n_of[1])
    marked = F.col("t") / F.lit(n_of[1]) >= RATIO * (F.col("o") + 0.5) / F.lit(n_of[0])
    lead = frozenset(g.as_py() for g in per.filter(often & marked).select("gram").toArrow()["gram"])

    def run_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r for t in batch.column(0) for r in runs_of(prepared(t.as_py()), lead)], pa.binary())], names=["run"])

    runs = sorted(r.as_py() for r in map_rows(learned.filter("label = 1"), ["text"], "run binary", run_rows).toArrow()["run"])
    model = Model(dictionary(ORDINARY_BYTES, samples), toxic_dictionary(runs))
    checked = split.filter("part = 'check'") if any(part == "check" for _, part in parts) else split

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.figures(prepared(t.as_py())).tolist() for t in batch.column(1)], pa.list_(pa.float64()))], names=["label", "x"])

    made = map_rows(checked, ["label", "text"], "label int, x array<double>", measured).toArrow().to_pylist()
    made.sort(key=lambda r: (r["label"], r["x"]))
    model.calibrate(np.array([r["x"] for r in made]), np.array([r["label"] for r in made]))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row; null counts as empty text, which is one short window like any other."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = shared.value
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=[id_col, "score"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], f"`{id_col}` {kind}, score double", run)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``.

    Null and empty texts are scored as texts without content. A null id is held_out null and never trained on. Repeated
    rows are scored as often as they come; other columns are ignored; an empty table gives an empty result. Without
    toxic and ordinary labels every score is 0.
    """
    scored = score(docs, train(docs, labels, "toxic", id_col, text_col), id_col, text_col)
    return scored.select(id_col, (fold(F.col(id_col), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
