"""Overlap of one text with several others, counted from one numbering of a row's tokens."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmeter.functions.lcs import lcs_size, split, summary_hits
from gistmeter.functions.ngrams import shared_grams
from gistmeter.functions.places import list_sizes, numbered, slices

# Rows are numbered together until they hold so many tokens, in all texts.
_TOKENS_AT_ONCE = 1 << 18


def _by_row(lines: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(tokens of each row, tokens of each of its lines) of a column of line tokens."""
    sizes = list_sizes(lines.flatten())
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(list_sizes(lines))])]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), lines.flatten().flatten()), sizes


def _counts(texts: list[pa.Array], orders: int, sequence: bool, line_sizes: list[list[list]] | None) -> np.ndarray:
    """The numbers of ``overlap_counts``, by other text, row and kind."""
    sizes = [list_sizes(text) for text in texts]
    token = numbered(*[text.flatten() for text in texts])
    gold, *others = sizes
    out = [*np.moveaxis(shared_grams(token, sizes, orders), 2, 0)]
    if sequence or line_sizes:
        bounds = np.cumsum([size.sum() for size in sizes])[:-1]
        first, *rest = [split(part.tolist(), size.tolist()) for part, size in zip(np.split(token, bounds), sizes)]
        if sequence:
            out.append(np.array([[lcs_size(p, g) for p, g in zip(other, first)] for other in rest], np.int32))
        if line_sizes:
            first, *rest = [[split(t, s) for t, s in zip(*pair)] for pair in zip([first, *rest], line_sizes)]
            out.append(np.array([[summary_hits(g, p) for g, p in zip(first, other)] for other in rest], np.int32))
    return np.stack([*out, np.stack(others), np.broadcast_to(gold, (len(others), len(gold)))], axis=2)


@cache
def overlap_counts(
    orders: int, sequence: bool = False, lines: bool = False, cut: Callable[[pa.Array], pa.Array] | None = None
) -> Callable[..., Column]:
    """``f(gold, *others)``: for each other text a list of numbers.

    These are the sizes of the multiset intersections of n-grams, n from 1 to ``orders``; with ``sequence`` the length
    of the longest common subsequence; with ``lines`` the clipped union-LCS hits of the gold lines; the tokens of the
    other text; those of the gold text. A text is an array of tokens, with ``lines`` one of the tokens of each line;
    with ``cut`` it is whatever ``cut`` makes that of.
    """

    def count(*texts: pa.Array) -> pa.Array:
        texts = [cut(text) for text in texts] if cut else texts
        parted = [_by_row(text) if lines else (text, None) for text in texts]
        tokens = [part[0] for part in parted]
        held = [split(part[1].tolist(), list_sizes(text).tolist()) for part, text in zip(parted, texts)] if lines else []
        found = [
            _counts([t.slice(start, size) for t in tokens], orders, sequence, [h[start : start + size] for h in held])
            for start, size in slices(_TOKENS_AT_ONCE, *tokens)
        ]
        width = orders + sequence + lines + 2
        flat = np.concatenate([np.swapaxes(part, 0, 1).ravel() for part in found] or [[]]).astype(np.int32)
        each = len(texts) - 1
        starts = [pa.array(np.arange(n + 1, dtype=np.int32) * by) for n, by in ((len(texts[0]) * each, width), (len(texts[0]), each))]
        return pa.ListArray.from_arrays(starts[1], pa.ListArray.from_arrays(starts[0], pa.array(flat)))

    return F.arrow_udf(count, T.ArrayType(T.ArrayType(T.IntegerType())))
