"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates.

Features of a text are hashed word unigrams and bigrams, each once, weighted so that the vector has length one. A token
is a run of word characters or of other characters; a bigram of two equal tokens has a feature of its own, whatever the
token, as has the class of a token (capitals, digits, symbols, other). Training is per coordinate (FTRL-proximal) on a
bounded sample of labelled rows at the driver; only hashed features leave the executors, not texts. Scoring is a sparse
dot product per text, on executors that each hold one copy of the weights (fixed size, ``2**BITS`` floats).
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_sample, fold, map_rows

BITS = 18
FOLDS = 5
#: Labelled rows at most that a model is fitted on, and passes over them.
TRAIN_ROWS, EPOCHS = 8000, 16
ALPHA, BETA, L1, L2 = 4.0, 1.0, 1.0, 0.0
THRESHOLD = 0.3
TOKEN = re.compile(r"\w+|[^\w\s]+")
REMEMBERED = 150_000

MIX = np.uint64(0x9E3779B97F4A7C15)
SHIFT = np.uint64(64 - BITS)


def _kind(token: str) -> int:
    """1 for words of capitals only (two letters at least), 2 for digits, 3 for symbols, 4 for all other words."""
    if not (token[0].isalnum() or token[0] == "_"):
        return 3
    return 2 if token.isdigit() else 1 if len(token) > 1 and token.isupper() else 4


class _Tokens(dict):
    """Token to (hash, kind) packed in one integer; forgets all when full, which bounds memory only."""

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        raw = token.encode("utf-8", "surrogatepass")
        self[token] = made = ((zlib.crc32(raw) << 24 | zlib.crc32(raw[::-1]) >> 8) << 3 | _kind(token)) & 0x7FFFFFFFFFFFFFFF
        return made


_tokens = _Tokens()


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature indices of one text; none for an empty one."""
    found = TOKEN.findall(text or "")
    if not found:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_tokens.__getitem__, found), np.uint64, len(found))
    pairs = h[:-1] * MIX + h[1:]
    pairs[h[:-1] == h[1:]] = 7
    kinds = (h & np.uint64(7)) + np.uint64(100)
    all_ = np.concatenate([h, pairs, np.unique(kinds), np.unique(kinds[:-1] * np.uint64(8) + kinds[1:])])
    return np.unique((all_ * MIX >> SHIFT).astype(np.int64))


def margin(weights: np.ndarray, bias: float, at: np.ndarray) -> float:
    return bias + (float(weights[at].sum()) / len(at) ** 0.5 if len(at) else 0.0)


def sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-min(max(x, -35.0), 35.0)))


class Ftrl:
    """FTRL-proximal logistic regression (McMahan et al. 2013) over sparse unit vectors, with a bias."""

    def __init__(self, size: int = 1 << BITS):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, label: int) -> None:
        at = np.append(at.astype(np.int64), len(self.z) - 1)
        x = np.full(len(at), 1 / max(len(at) - 1, 1) ** 0.5)
        x[-1] = 1.0
        w = self.weights(at)
        g = (sigmoid(float(w @ x)) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g

    def model(self) -> tuple[np.ndarray, float]:
        w = self.weights(np.arange(len(self.z)))
        return w[:-1].astype(np.float32), float(w[-1])


def hashed(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` with the text replaced by ``at``, its features as little-endian 32-bit integers in one binary value."""
    others = [c for c in rows.columns if c != text_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = pa.array([features(t.as_py()).astype("<i4").tobytes() for t in batch.column(len(others))], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns[: len(others)], made], names=[*others, "at"])

    kinds = ", ".join(f"`{c}` {rows.select(c).schema[0].dataType.simpleString()}" for c in others)
    return map_rows(rows, [*others, text_col], f"{kinds}, at binary", run)


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, limit: int) -> DataFrame:
    """(id, label, text) of a bounded sample of the training fold: labelled rows with crc32(id) mod FOLDS not 0.

    The sample has the ``limit`` ids whose hash is lowest. An id with several labels counts by the least of them.
    """
    train = labels.filter((fold(F.col(id_col), FOLDS) != 0) & F.col(label).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
    few = bounded_sample(train, F.col("id"), limit).groupBy("id").agg(F.min("label").alias("label"))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id").select("id", "label", "text")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Weights and bias. Without labelled rows all weights are 0, so every score is one half.

    Of documents that share an id, the one whose features sort first is learned from, so at most ``limit`` rows come to
    the driver: as Arrow columns of about 4 bytes a feature, which are read where they lie.
    """
    found = hashed(labelled(docs, labels, label, id_col, text_col, limit)).groupBy("id").agg(F.min("label").alias("label"), F.min("at").alias("at")).select("label", "at").toArrow()
    rows = [(zlib.crc32(at.as_buffer()), label_.as_py(), np.frombuffer(at.as_buffer(), "<i4")) for label_, at in zip(found["label"], found["at"], strict=True)]
    rows.sort(key=lambda r: (r[0], r[1]))
    model = Ftrl()
    for _ in range(EPOCHS):
        for _, label_, at in rows:
            model.update(at, label_)
    return model.model()


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, score) for every row; null counts as empty text, whose score is the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [id_col, *keep]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        weights, bias = shared.value
        made = [sigmoid(margin(weights, bias, features(t.as_py()))) for t in batch.column(len(columns))]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(made, pa.float64())], names=[*columns, "score"])

    kinds = ", ".join(f"`{c}` {docs.select(c).schema[0].dataType.simpleString()}" for c in columns)
    return map_rows(docs, [*columns, text_col], f"{kinds}, score double", run)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``.

    Null and empty texts are scored by the bias. A null id is held_out null and never trained on. Repeated rows are
    scored as often as they come; other columns are ignored; empty tables give an empty result, or scores of one half
    where only labels are missing.
    """
    scored = score(docs, train(docs, labels, "quality", id_col, text_col), id_col, text_col)
    return scored.select(id_col, (fold(F.col(id_col), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_scored(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with their columns, whatever these are called."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text"))
    return score(rows, model, "_row", "_text").filter(F.col("score") >= threshold).select("_row.*")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``keep_scored`` with a model trained on ``docs`` and ``labels``; the label fold is as in ``quality``."""
    return keep_scored(docs, train(docs, labels, "quality", id_col, text_col), text_col, threshold)
