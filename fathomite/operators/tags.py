"""Filters that an index can apply by itself: tags of rows, and of those that a slot lets through.

A row has a tag for its document and, where it is a fact, one for its own period. A slot's filter lets through rows with
one of its tags: the periods and documents that are equivalent to it. No filter is null, which every row passes; a filter
that is equivalent to nothing is an empty array, which none does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from ..functions import period as P


def row_tags(period: Column, document: Column, layer: str) -> Column:
    """ARRAY<STRING> of a row of a layer ("fact" or "chunk"); null values have no tag."""
    own = [F.concat(F.lit("d:"), document)] + ([F.concat(F.lit("p:"), period)] if layer == "fact" else [])
    return F.array_compact(F.array(*own))


def slot_tags(period_filter: Column, layer: str, prefix: str = "nflx") -> Column:
    """ARRAY<STRING> that a slot lets through in a layer, or null: facts by period or document, chunks by document."""
    documents = F.transform(P.equivalent_documents(period_filter, prefix), lambda d: F.concat(F.lit("d:"), d))
    periods = F.transform(P.equivalent_periods(period_filter), lambda p: F.concat(F.lit("p:"), p))
    return F.when(period_filter.isNotNull(), F.concat(documents, periods) if layer == "fact" else documents)


def fits(tags: pa.Array, allowed: list[set[str] | None]) -> np.ndarray:
    """(slots, rows) booleans: whether a row's list of tags has one that the slot lets through."""
    out = np.zeros((len(allowed), len(tags)), bool)
    out[[i for i, own in enumerate(allowed) if own is None]] = True
    coded = tags.flatten().dictionary_encode()
    passes = np.array([[own is not None and t in own for t in coded.dictionary.to_pylist()] for own in allowed], bool).reshape(len(allowed), -1)
    row, code = tags.value_parent_indices().to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False)
    place = np.arange(len(row)) - np.searchsorted(row, row)
    for k in range(place.max(initial=-1) + 1):  # a row's first tag, second, ...: no row twice
        at = place == k
        out[:, row[at]] |= passes[:, code[at]]
    return out
