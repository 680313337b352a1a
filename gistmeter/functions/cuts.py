"""Texts cut into tokens as Arrow bytes, by the rules of ``gistmeter.functions.text``.

A text goes to Python as it is, not as a list of its tokens: the rules tell bytes by their class, so a pass over the
bytes of many texts cuts them all. Every text comes with a closing character, which keeps its tokens from the next's.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmeter.functions.places import list_sizes, slices_of
from gistmeter.functions.text import bleu_line, rouge_line

# Texts are cut together until they have so many bytes.
_BYTES_AT_ONCE = 1 << 22
_WORD = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))
# Classes of bytes for the mteval-v13a rules.
_OTHER, _SPACE, _DIGIT, _POINT, _MARK, _DASH = range(6)
_KIND = np.zeros(256, np.uint8)
for _kind, _of in (
    (_SPACE, b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "),
    (_DIGIT, b"0123456789"),
    (_POINT, b".,"),
    (_MARK, b"{|}~[\\]^_`!\"#$%&()*+:;<=>?@/"),
    (_DASH, b"-"),
):
    _KIND[np.frombuffer(_of, np.uint8)] = _kind
# White space beyond ASCII, U+0085 and the separators of Unicode, by its number of bytes.
_WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_WIDE = {size: np.array([int.from_bytes(s, "big") for s in _WIDE_SPACES if len(s) == size]) for size in (2, 3)}


def _bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all texts, where each starts and the last ends)."""
    text = text.cast(pa.large_string())
    _, offsets, data = text.buffers()
    ends = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    return np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _tokens(data: np.ndarray, word: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The tokens that begin at ``starts`` and go on through the bytes that are ``word``."""
    kept = np.cumsum(word)
    offsets = np.append(kept[starts] - 1, kept[-1] if len(kept) else 0).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[word]))


def _lists(ends: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def _rouge_starts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = _WORD[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    return word, np.flatnonzero(begins)


def _rouge(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    word, starts = _rouge_starts(data)
    return _lists(np.searchsorted(starts, ends), _tokens(data, word, starts))


def _rouge_lines(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    word, starts = _rouge_starts(data)
    # A line counts if it has tokens.
    lines = np.unique(np.searchsorted(starts, np.append(0, np.flatnonzero(data == ord("\n")))))
    first = np.searchsorted(starts, ends)
    return _lists(np.searchsorted(lines, first), _lists(lines, _tokens(data, word, starts)))


def _spaces_marked(data: np.ndarray, kind: np.ndarray) -> None:
    for size, known in _WIDE.items():
        at = np.flatnonzero((data[: len(data) - size + 1] >> (7 - size)) == (1 << (size + 1)) - 2)
        number = sum(data[at + k].astype(np.int64) << (8 * (size - 1 - k)) for k in range(size))
        at = at[np.isin(number, known)]
        for k in range(size):
            kind[at + k] = _SPACE


def _bleu(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    kind = _KIND[data]
    if (data >= 0x80).any():
        _spaces_marked(data, kind)
    before = np.append(np.uint8(_SPACE), kind[:-1]) if len(kind) else kind
    cut = (before == _SPACE) | (before == _MARK) | (kind == _MARK)
    dash = (kind == _DASH) & (before == _DIGIT)
    point = kind == _POINT
    cut |= dash | point
    cut[1:] |= (dash | point)[:-1]
    # Points and commas stand alone, but between digits one joins both; of several, the rules take two at a time, and the
    # last may be left to a digit that follows.
    first = np.flatnonzero(point & (before != _POINT))
    last = np.flatnonzero(point[:-1] & ~point[1:])
    digit, odd, then = before[first] == _DIGIT, (last - first) % 2 == 0, kind[last + 1] == _DIGIT
    cut[first[digit & then & (first == last)]] = False
    cut[last[then & (digit == odd)] + 1] = False
    word = kind != _SPACE
    starts = np.flatnonzero(cut & word)
    return _lists(np.searchsorted(starts, ends), _tokens(data, word, starts))


def _cutter(one: Callable[[np.ndarray, np.ndarray], pa.Array], kind: pa.DataType) -> Callable[[pa.Array], pa.Array]:
    def cut(text: pa.Array) -> pa.Array:
        sizes = pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = [one(*_bytes(text.slice(start, length))) for start, length in slices_of(_BYTES_AT_ONCE, sizes)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return cut


#: Of texts that ``rouge_line`` or ``bleu_line`` made: the tokens of each, or of each of its lines that have any.
rouge_cut = _cutter(_rouge, pa.list_(pa.string()))
rouge_line_cut = _cutter(_rouge_lines, pa.list_(pa.list_(pa.string())))
bleu_cut = _cutter(_bleu, pa.list_(pa.string()))


def _distinct(*texts: pa.Array) -> pa.Array:
    """The distinct tokens of each row."""
    parts = [rouge_cut(text) for text in texts]
    held = pa.concat_arrays([part.flatten() for part in parts]).dictionary_encode()
    rows = len(texts[0])
    row = np.concatenate([np.repeat(np.arange(rows), list_sizes(part)) for part in parts])
    kinds = max(len(held.dictionary), 1)
    pair = np.sort(pd.unique(row * kinds + held.indices.to_numpy(zero_copy_only=False)))
    return _lists(np.searchsorted(pair, np.arange(rows + 1) * kinds), held.dictionary.take(pa.array(pair % kinds)))


_distinct_udf = F.arrow_udf(_distinct, T.ArrayType(T.StringType()))


def distinct_tokens(*texts: str) -> Column:
    """The distinct tokens of a row's texts, by the rule of ``rouge_tokens``, in no order."""
    return _distinct_udf(*[rouge_line(text) for text in texts])
