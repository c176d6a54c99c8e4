"""Embedding models as plug-ins: loaded once in a worker, fed by windows of bounded length in batches of bounded size."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .retrieval import Embedder

#: From texts to their vectors, one row each.
Encode = Callable[[list[str]], np.ndarray]
_TOKEN = re.compile(r"\S+")
_loaded: dict[str, Encode] = {}


def model_of(name: str, load: Callable[[], Encode]) -> Encode:
    """The model ``name`` of this worker process, loaded when it is first asked for."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def windows(text: str, most: int, overlap: int) -> Iterator[tuple[str, int]]:
    """(part, weight) of at most ``most`` tokens, each beginning ``overlap`` tokens before the last one's end; the weight is
    the number of tokens. Parts are slices of the text as it is; only the starts of one window are held."""
    starts: list[int] = []
    end = fresh = 0
    for found in _TOKEN.finditer(text):
        if len(starts) == most:
            yield text[starts[0] : end], most
            starts, fresh = starts[most - overlap :], 0
        starts.append(found.start())
        end, fresh = found.end(), fresh + 1
    if fresh:
        yield text[starts[0] : end], len(starts)


def model_embedder(name: str, load: Callable[[], Encode], dim: int, most: int = 256, overlap: int = 32, batch: int = 64, id_col: str = "id") -> Embedder:
    """An ``Embedder`` over a model: ``load`` gives it, once in each worker process, ``name`` tells models and versions apart.

    A text is cut into windows of at most ``most`` tokens (runs that are not white space) that share ``overlap``, and whole
    texts are read however long they are. Windows of all rows are encoded ``batch`` at a time; a row's vector is the mean
    of its windows' unit vectors by their tokens, of length one. Null and empty texts, and a mean of zero, give zeros; ids
    and repeated rows stay as they are.
    """
    if not 0 <= overlap < most:
        raise ValueError("windows must share fewer tokens than they have")

    def embed(rows: DataFrame, text_col: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encode = model_of(name, load)
            for own in batches:
                sums = np.zeros((own.num_rows, dim))
                at: list[int] = []
                parts: list[str] = []
                weights: list[int] = []

                def flush() -> None:
                    made = np.asarray(encode(parts), np.float64)
                    if made.shape != (len(parts), dim):
                        raise ValueError(f"model {name} gave an array of {made.shape} for {len(parts)} texts of {dim}")
                    length = np.linalg.norm(made, axis=1, keepdims=True)
                    np.add.at(sums, at, np.divide(made, length, out=np.zeros_like(made), where=length > 0) * np.array(weights)[:, None])
                    at.clear(), parts.clear(), weights.clear()

                for i, text in enumerate(own.column(1)):
                    for part, weight in windows(text.as_py() or "", most, overlap):
                        at.append(i), parts.append(part), weights.append(weight)
                        if len(parts) == batch:
                            flush()
                if parts:
                    flush()
                length = np.linalg.norm(sums, axis=1, keepdims=True)
                flat = np.divide(sums, length, out=np.zeros_like(sums), where=length > 0).ravel()
                offsets = pa.array(np.arange(0, len(flat) + 1, dim), pa.int32())
                yield pa.RecordBatch.from_arrays([own.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["id", "vector"])

        kind = rows.schema[id_col].dataType.simpleString()
        return rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, vector array<double>")

    return embed
