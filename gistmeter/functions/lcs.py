"""Longest common subsequences of token arrays, as Arrow functions.

Built-in expressions cannot carry a dynamic-programming row, so these run on Arrow batches. One
row of the table is one Python integer with a bit per token (the bit-vector recurrence of Hyyrö,
2004): about ``len(left) * len(right) / 64`` word operations a pair and no cut-off length.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from itertools import chain, islice
from math import isqrt

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmeter.functions.places import list_sizes, numbered, slices

# So many tokens, or rows of lines, become Python lists at once.
_TOKENS_AT_ONCE, _ROWS_AT_ONCE = 1 << 18, 64
# Tables of at most so many bits are kept whole.
_SMALL = 1 << 20
# Masks of all tokens are kept for lines of at most so many tokens (2 MB).
_SHORT = 4096


def _mask(places: list[int], width: int) -> int:
    bits = bytearray(width // 8 + 1)
    for place in places:
        bits[place >> 3] |= 1 << (place & 7)
    return int.from_bytes(bits, "little")


class _LongLine:
    """Masks of a long line: kept for its frequent tokens, made when asked for the others.

    At most ``sqrt(n)`` tokens stand in more than ``sqrt(n)`` places, so memory is about ``n ** 1.5`` bits.
    """

    def __init__(self, places: dict, width: int):
        self._places, self._width = places, width
        self._kept = {t: _mask(p, width) for t, p in places.items() if len(p) > isqrt(width)}

    def get(self, token, default=None):
        mask = self._kept.get(token)
        if mask is None and token in self._places:
            mask = _mask(self._places[token], self._width)
        return default if mask is None else mask


def _places(tokens) -> dict:
    places: dict = {}
    for place, token in enumerate(tokens):
        places.setdefault(token, []).append(place)
    return places


def _masks(places: dict, width: int) -> dict | _LongLine:
    if width > _SHORT:
        return _LongLine(places, width)
    return {token: sum(1 << place for place in at) for token, at in places.items()}


def _positions(tokens) -> dict | _LongLine:
    """Token to the mask of its places."""
    return _masks(_places(tokens), len(tokens))


def _runs_through(line, places: dict) -> bool:
    """Whether all of ``line`` stands, in its order, at some of these places."""
    at = -1
    for token in line:
        later = places.get(token, ())
        k = bisect_right(later, at)
        if k == len(later):
            return False
        at = later[k]
    return True


def _inside(part, whole) -> bool:
    rest = iter(whole)
    return all(token in rest for token in part)


def _rows(left, where: dict | _LongLine, width: int, row: int | None = None):
    """Table rows after each left token, from ``row`` on; a zero bit marks a column where the length grows."""
    full = (1 << width) - 1
    row = full if row is None else row
    for token in left:
        match = where.get(token)
        if match:
            shared = row & match
            row = ((row + shared) | (row - shared)) & full
        yield row


def lcs_size(left, right) -> int:
    if left == right:
        return len(right)
    # A text that the other holds in its order needs no table.
    short, long = sorted((left, right), key=len)
    if _inside(short, long):
        return len(short)
    row = (1 << len(right)) - 1
    for row in _rows(left, _positions(right), len(right)):
        pass
    return len(right) - row.bit_count()


def lcs_places(left, where: dict | _LongLine, width: int) -> set[int]:
    """Indices of ``left`` on the common subsequence that prefers the latest match.

    A small table is filled once. Of a larger one every ``sqrt(m)``-th row is kept; those between are filled again while
    walking back.
    """
    small = len(left) * width <= _SMALL
    step = max(len(left), 1) if small else isqrt(len(left)) + 1
    kept = [(1 << width) - 1, *(() if small else islice(_rows(left, where, width), step - 1, None, step))]
    places = set()
    end = width
    for block in range((len(left) - 1) // step, -1, -1):
        start = block * step
        part = left[start : start + step]
        rows = [kept[block], *_rows(part, where, width, kept[block])]
        for index in range(len(part) - 1, -1, -1):
            seen = (1 << end) - 1
            match = where.get(part[index], 0) & seen
            if not match:
                continue
            last = match.bit_length()
            # Below ``end`` this row holds fewer set bits than the one above: the token adds to the length.
            if last == end or (rows[index + 1] & seen).bit_count() < (rows[index] & seen).bit_count():
                places.add(start + index)
                end = last - 1
    return places


def summary_hits(gold_lines, predicted_lines) -> int:
    """Tokens of the gold lines covered by the union over predicted lines, each use counted once."""
    if len(predicted_lines) == 1:
        return _clipped(_covered_by_one(gold_lines, predicted_lines[0]), predicted_lines)
    tables: dict = {}
    places: dict = {}
    whole = set(map(tuple, predicted_lines))
    lines_of: dict = {}
    for number, line in enumerate(predicted_lines):
        for token in dict.fromkeys(line):
            lines_of.setdefault(token, []).append(number)
    covered: list = []
    for line in gold_lines:
        if tuple(line) in whole:
            covered += line
            continue
        # A token that no predicted line has is on no subsequence and moves none.
        reachable = [token for token in line if token in lines_of]
        # Only lines that share a token are visited, those with many first: the union is often complete early.
        shared: dict = {}
        for token in reachable:
            for number in lines_of[token]:
                shared[number] = shared.get(number, 0) + 1
        union: set[int] = set()
        for number in sorted(shared, key=lambda number: (-shared[number], number)):
            if len(union) == len(reachable):
                break
            other = predicted_lines[number]
            if number not in places:
                places[number] = _places(other)
            if shared[number] == len(line) <= len(other) and _runs_through(line, places[number]):
                union = set(range(len(line)))
                break
            if number not in tables:
                tables[number] = _masks(places[number], len(other))
            union |= lcs_places(reachable, tables[number], len(other))
        covered += reachable if len(union) == len(reachable) else [reachable[index] for index in union]
    return _clipped(covered, predicted_lines)


def _clipped(covered: list, predicted_lines) -> int:
    # In whatever order they are taken, the uses of a token end with the side that has fewer.
    if len(predicted_lines) == 1 and covered == predicted_lines[0]:
        return len(covered)
    have = Counter(chain.from_iterable(predicted_lines))
    return sum(min(n, have[token]) for token, n in Counter(covered).items())


def _covered_by_one(gold_lines, other) -> list:
    """Tokens of the gold lines on their common subsequences with one line."""
    tokens, places, table = set(other), None, None
    covered: list = []
    at = 0
    for line in gold_lines:
        # Often the line holds the gold lines one after the other, with or without some of them.
        if line == other[at : at + len(line)]:
            covered += line
            at += len(line)
            continue
        # A token that the line does not have is on no subsequence and moves none.
        reachable = [token for token in line if token in tokens]
        if len(reachable) > 1:
            places = _places(other) if places is None else places
            if not (len(reachable) == len(line) <= len(other) and _runs_through(line, places)):
                table = _masks(places, len(other)) if table is None else table
                reachable = [reachable[index] for index in lcs_places(reachable, table, len(other))]
        covered += reachable
    return covered


def _codes(*arrays: pa.Array) -> list[list]:
    """Each list column as Python lists of integer codes shared by all columns."""
    flat = [array.flatten() for array in arrays]
    codes = numbered(*flat)
    out, start = [], 0
    for array, values in zip(arrays, flat):
        part = codes[start : start + len(values)].tolist()
        start += len(values)
        out.append(split(part, list_sizes(array).tolist()))
    return out


def split(values: list, sizes: list) -> list[list]:
    """Lists of these sizes, one after the other."""
    out, start = [], 0
    for size in sizes:
        out.append(values[start : start + size])
        start += size
    return out


@F.arrow_udf(T.IntegerType())
def lcs_length(left: pa.Array, right: pa.Array) -> pa.Array:
    """Length of the longest common subsequence of two token arrays."""
    parts = [(left.slice(*s), right.slice(*s)) for s in slices(_TOKENS_AT_ONCE, left, right)]
    return pa.array([lcs_size(a, b) for part in parts for a, b in zip(*_codes(*part))], pa.int32())


@F.arrow_udf(T.IntegerType())
def union_lcs_hits(gold: pa.Array, predicted: pa.Array) -> pa.Array:
    """Clipped union-LCS hits of two ``array<array<string>>`` columns of line tokens."""
    hits = []
    # A few rows at a time become Python lists, however many a batch has and however long they are.
    for start in range(0, len(gold), _ROWS_AT_ONCE):
        some = [c.slice(start, _ROWS_AT_ONCE) for c in (gold, predicted)]
        lines = _codes(*[c.flatten() for c in some])
        texts = [split(codes, list_sizes(array).tolist()) for codes, array in zip(lines, some)]
        hits += [summary_hits(g, p) for g, p in zip(*texts)]
    return pa.array(hits, pa.int32())
