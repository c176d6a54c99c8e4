"""Language identification by a byte convolutional network, in numpy.

The lower-cased UTF-8 bytes of a text are cut into windows of ``WINDOW`` bytes that overlap by the widest filter, so the
whole text is seen. Bytes are embedded, filters of several widths slide over them, each filter's greatest response in a
window passes a rectifier, and a softmax layer gives the languages' probabilities; a text's are the mean of its
windows', weighted by their bytes. The network is trained at the driver with Adam on windows of a bounded sample of
labelled documents, cut to random lengths so that short texts are learned too. Windows are scored in batches of fixed
size, so memory does not grow with a text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import bounded_sample, fold, map_rows

WINDOW, WIDTHS, PER_WIDTH, DIM = 256, (2, 3, 4), 16, 8
WIDEST = max(WIDTHS)
FILTERS = PER_WIDTH * len(WIDTHS)
PAD = 256
FOLDS, HELD_OUT = 4, 2
#: Labelled documents at most that the network is trained on, and windows at most from each, spread over its text.
TRAIN_DOCS, PER_DOC = 3000, 3
EPOCHS, BATCH, RATE = 4, 64, 0.01
SCORED = 512
UNKNOWN = "und"
#: A letter is a character of one of the letter categories; superscripts, circled digits and the like are none.
LETTER = regex.compile(r"\p{L}")


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(windows, weights): rows of WINDOW byte values, padded with PAD, and the bytes that each row adds."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    step = WINDOW - WIDEST + 1
    n = max(1, -(-(len(data) - WIDEST + 1) // step))
    flat = np.full((n - 1) * step + WINDOW, PAD, np.uint16)
    flat[: len(data)] = data
    rows = np.lib.stride_tricks.as_strided(flat, (n, WINDOW), (step * flat.itemsize, flat.itemsize))
    return rows.copy(), np.minimum(len(data) - np.arange(n) * step, step).clip(1).astype(np.float32)


class Network:
    def __init__(self, languages: list[str], seed: int = 10):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {
            "embedding": rng.normal(0, 0.5, (PAD + 1, DIM)).astype(np.float32),
            "filters": rng.normal(0, 0.3, (WIDEST * DIM, FILTERS)).astype(np.float32),
            "offset": np.zeros(FILTERS, np.float32),
            "dense": rng.normal(0, 0.3, (FILTERS, len(languages))).astype(np.float32),
            "bias": np.zeros(len(languages), np.float32),
        }
        self.mask = np.ones((WIDEST * DIM, FILTERS), np.float32)
        for i, width in enumerate(WIDTHS):
            self.mask[width * DIM :, i * PER_WIDTH : (i + 1) * PER_WIDTH] = 0
        self.freeze()

    def freeze(self) -> None:
        """Padding embeds to zero and a narrow filter has no weight beyond its width."""
        self.p["embedding"][PAD] = 0
        self.p["filters"] *= self.mask

    def _responses(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte values under each place, responses): the places of a window by the filters."""
        places = np.lib.stride_tricks.sliding_window_view(rows, WIDEST, axis=1)
        patches = self.p["embedding"][places].reshape(-1, WIDEST * DIM)
        return places, (patches @ self.p["filters"]).reshape(*places.shape[:2], FILTERS)

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        logits = pooled @ self.p["dense"] + self.p["bias"]
        logits = np.exp(logits - logits.max(1, keepdims=True))
        return logits / logits.sum(1, keepdims=True)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), len(self.languages)), np.float32)
        for at in range(0, len(rows), SCORED):
            top = self._responses(rows[at : at + SCORED])[1].max(1)
            out[at : at + SCORED] = self._softmax(np.maximum(top + self.p["offset"], 0))
        return out

    def gradients(self, rows: np.ndarray, truth: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of a batch and its gradients."""
        places, found = self._responses(rows)
        at = found.argmax(1)
        top = np.take_along_axis(found, at[:, None], 1)[:, 0] + self.p["offset"]
        pooled = np.maximum(top, 0)
        prob = self._softmax(pooled)
        n = len(rows)
        loss = float(-np.log(prob[np.arange(n), truth] + 1e-12).mean())
        d = prob.copy()
        d[np.arange(n), truth] -= 1
        d /= n
        g = {"dense": pooled.T @ d, "bias": d.sum(0)}
        back = (d @ self.p["dense"].T) * (top > 0)
        seen = places[np.arange(n)[:, None], at]
        patches = self.p["embedding"][seen].reshape(n, FILTERS, WIDEST * DIM)
        g["offset"] = back.sum(0)
        g["filters"] = np.einsum("nfk,nf->kf", patches, back) * self.mask
        into = (back[:, :, None] * self.p["filters"].T[None]).reshape(-1, DIM)
        flat = seen.reshape(-1)
        g["embedding"] = np.stack([np.bincount(flat, into[:, j], PAD + 1) for j in range(DIM)], 1)
        return loss, g

    def fit(self, rows: np.ndarray, truth: np.ndarray, seed: int = 11) -> None:
        rng, step = np.random.default_rng(seed), 0
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), BATCH):
                own = order[lo : lo + BATCH]
                batch = rows[own].copy()
                keep = np.where(rng.random(len(own)) < 0.5, WINDOW, rng.integers(4, WINDOW, len(own)))
                batch[np.arange(WINDOW)[None] >= keep[:, None]] = PAD
                _, g = self.gradients(batch, truth[own])
                step += 1
                for k, v in g.items():
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.99 * second[k] + 0.01 * v * v
                    self.p[k] -= (RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
                self.freeze()

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, probability) of each text; UNKNOWN with 0 for null, a text without letters or no languages."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return out
        held, rows, weights, n = [], [], [], 0

        def flush() -> None:
            if not held:
                return
            prob = self.probabilities(np.concatenate(rows)) * np.concatenate(weights)[:, None]
            lo = 0
            for (i, k), w in zip(held, weights, strict=True):
                mean = prob[lo : lo + k].sum(0) / w.sum()
                best = int(mean.argmax())
                out[i] = (self.languages[best], min(1.0, float(mean[best])))
                lo += k
            held.clear(), rows.clear(), weights.clear()

        for i, text in enumerate(texts):
            if text is not None and LETTER.search(text):
                r, w = windows_of(text)
                held.append((i, len(r)))
                rows.append(r)
                weights.append(w)
                n += len(r)
                if n >= 4 * SCORED:
                    flush()
                    n = 0
        flush()
        return out


def training_windows(docs: DataFrame, lang_col: str, id_col: str, text_col: str, limit: int) -> DataFrame:
    """(lang, bytes) of at most PER_DOC windows from each of a bounded sample of documents outside the held-out fold.

    Of documents that share an id, the one whose text sorts first is taken.
    """
    own = docs.select(id_col, text_col, F.col(lang_col).alias("_lang")).filter((fold(F.col(id_col), FOLDS) != HELD_OUT) & F.col("_lang").isNotNull())
    few = bounded_sample(own, F.col(id_col), limit).groupBy(id_col).agg(F.min(F.struct(text_col, "_lang")).alias("_d")).select(f"_d.{text_col}", "_d._lang")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, made = [], []
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            if text.as_py() and LETTER.search(text.as_py()):
                rows, _ = windows_of(text.as_py())
                for at in sorted({int(i) for i in np.linspace(0, len(rows) - 1, PER_DOC)}):
                    langs.append(lang.as_py())
                    made.append(bytes(rows[at][rows[at] < PAD].astype(np.uint8)))
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(made, pa.binary())], names=["lang", "bytes"])

    return map_rows(few, [text_col, "_lang"], "lang string, bytes binary", run)


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_DOCS) -> Network:
    """A network for the languages in the sample; one without languages where there is nothing to learn from."""
    found = training_windows(docs, lang_col, id_col, text_col, limit).toArrow()
    found = sorted({(zlib.crc32(data.as_py()), data.as_py(), lang.as_py()) for data, lang in zip(found["bytes"], found["lang"], strict=True)})
    network = Network(sorted({lang for *_, lang in found}))
    if found:
        rows = np.full((len(found), WINDOW), PAD, np.uint16)
        for row, (_, data, _) in zip(rows, found, strict=True):
            row[: len(data)] = np.frombuffer(data, np.uint8)
        network.fit(rows, np.array([network.languages.index(lang) for *_, lang in found]))
    return network


def identify(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row. The network (fixed size, about 25 KB) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = shared.value.predict(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], f"`{id_col}` {kind}, lang_pred string, score double", run)


def languages(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) for every row of ``docs``.

    Null text and text without a letter give ``und`` with score 0. A null id is held_out null and never trained on.
    Repeated rows are predicted as often as they come; other columns are ignored; an empty table gives an empty result.
    """
    found = identify(docs, train(docs, lang_col, id_col, text_col), id_col, text_col)
    return found.select(id_col, (fold(F.col(id_col), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
