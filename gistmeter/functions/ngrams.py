"""N-grams of token arrays and their clipped overlap, computed inside one row.

A text is one row, so both sides of a pair are already together: counting n-grams there needs no
shuffle, whatever the size of the table, and a hot key cannot pile rows up in one task. Grams are
numbers, numbered afresh from order to order, so no gram is ever spelt out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmeter.functions.places import list_sizes, numbered, slices

# Rows are counted together until they hold so many tokens.
_TOKENS_AT_ONCE = 1 << 18


def ngram_count(tokens: Column, n: int) -> Column:
    return F.greatest(F.size(tokens) - (n - 1), F.lit(0))


def shared_grams(token: np.ndarray, sizes: list[np.ndarray], orders: int) -> np.ndarray:
    """Clipped overlap of the first text with each other one (first axis), by row (second) and order (third).

    ``token`` holds numbers: those of all rows of the first text, then of the next; ``sizes`` says how many a row has.
    """
    rows, per_row = len(sizes[0]), np.concatenate(sizes)
    row = np.repeat(np.tile(np.arange(rows), len(sizes)), per_row)
    # Places left in the text from each token on; a gram must not run over its end.
    room = np.repeat(np.cumsum(per_row), per_row) - np.arange(len(row))
    bounds = np.cumsum([size.sum() for size in sizes])[:-1]
    kinds = int(token.max()) + 1 if len(token) else 0
    out = np.zeros((len(sizes) - 1, rows, orders), np.int32)
    # A text that equals the first has all of its grams; the others are counted without it.
    counted = np.ones(len(row), bool)
    starts = (np.cumsum(per_row) - per_row).reshape(len(sizes), rows).tolist()
    for k, size in enumerate(sizes[1:], 1):
        for r in np.flatnonzero((size == sizes[0]) & (size > 0)).tolist():
            own, first = slice(starts[k][r], starts[k][r] + size[r]), slice(starts[0][r], starts[0][r] + size[r])
            if (token[own] == token[first]).all():
                counted[own] = False
                out[k - 1, r] = np.maximum(size[r] - np.arange(orders), 0)
    at = np.flatnonzero(counted)
    gram = row[at]
    for n in range(1, orders + 1):
        inside = room[at] >= n
        at, gram = at[inside], gram[inside]
        if not len(at):
            break
        gram, found = pd.factorize(gram * kinds + token[at + n - 1])
        first, *others = [np.bincount(part, minlength=len(found)) for part in np.split(gram, np.searchsorted(at, bounds))]
        owner = np.empty(len(found), np.int64)
        owner[gram] = row[at]
        for k, other in enumerate(others):
            out[k, :, n - 1] += np.bincount(owner, np.minimum(first, other), rows).astype(np.int32)
        # Only what is shared can be the start of a longer gram that is.
        kept = ((first > 0) & (sum(others) > 0))[gram]
        at, gram = at[kept], gram[kept]
    return out


def _hits(left: pa.Array, right: pa.Array, orders: int) -> np.ndarray:
    """Clipped overlap of each row (first axis) and order (second)."""
    return shared_grams(numbered(left.flatten(), right.flatten()), [list_sizes(left), list_sizes(right)], orders)[0]


@cache
def gram_hits(orders: int) -> Callable[..., Column]:
    """``f(left, right)``: sizes of the multiset intersections of the n-grams of two string arrays, n from 1 to ``orders``."""

    def count(left: pa.Array, right: pa.Array) -> pa.Array:
        parts = [_hits(left.slice(*s), right.slice(*s), orders) for s in slices(_TOKENS_AT_ONCE, left, right)]
        flat = np.concatenate([part.ravel() for part in parts]) if parts else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(left) + 1, dtype=np.int32) * orders), pa.array(flat))

    return F.arrow_udf(count, T.ArrayType(T.IntegerType()))
