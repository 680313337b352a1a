"""Values of a row's items, found among keys that all rows share and the row's own distinct keys."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_items(column: pa.Array, row: int) -> pa.Array:
    """The items of a list column's row; none for null."""
    return column[row].values if column[row].is_valid else pa.array([], column.type.value_type)


def list_sizes(column: pa.Array) -> np.ndarray:
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(items: int, *columns: pa.Array):
    """(start, length) of runs of rows with about so many items in all columns."""
    yield from slices_of(items, sum(list_sizes(c) for c in columns))


def slices_of(items: int, sizes: np.ndarray):
    """(start, length) of runs of rows of these sizes with about so many items."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + items, "right")), start + 1)
        yield start, stop - start
        start = stop


def numbered(*flat: pa.Array) -> np.ndarray:
    """Numbers for the items of all arrays, one after the other: equal ones have the same."""
    # Arrays without items may come without offsets, which putting arrays together would read.
    codes = pa.concat_arrays([part for part in flat if len(part)] or [pa.array([], flat[0].type)]).dictionary_encode().indices
    return codes.to_numpy(zero_copy_only=False).astype(np.int64)


# Rows are looked up together until they hold so many items.
_ITEMS_AT_ONCE = 1 << 19


def places_of(items: pa.Array, shared: pa.Array, keys: pa.Array) -> np.ndarray:
    """For all items of a list column, one after the other: their place in ``shared``; else ``len(shared)`` plus their
    place among all ``keys``, where only the keys of the same row count; else -1."""
    flat = items.flatten()
    at = pc.index_in(flat, value_set=shared).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, own = np.cumsum(list_sizes(items)), np.cumsum(list_sizes(keys))
    open_ = np.flatnonzero(at < 0)
    cuts = np.searchsorted(open_, ends)
    for row in np.flatnonzero((np.diff(cuts, prepend=0) > 0) & (np.diff(own, prepend=0) > 0)):
        some = open_[cuts[row - 1] if row else 0 : cuts[row]]
        found = pc.index_in(flat.take(pa.array(some)), value_set=row_items(keys, row)).fill_null(-1).to_numpy(zero_copy_only=False)
        before = len(shared) + (own[row - 1] if row else 0)
        at[some] = np.where(found < 0, -1, before + found)
    return at


def items_outside(shared: pa.Array, kind: T.DataType) -> Callable[..., Column]:
    """``f(items)``: the items that are not in ``shared``."""

    def outside(items: pa.Array) -> pa.Array:
        parts, sizes = [], [np.zeros(1, np.int64)]
        for start, length in slices(_ITEMS_AT_ONCE, items):
            part = items.slice(start, length)
            flat = part.flatten()
            left = pc.invert(pc.is_in(flat, value_set=shared))
            before = np.concatenate([[0], np.cumsum(left.to_numpy(zero_copy_only=False))])
            sizes.append(np.diff(before[np.cumsum(list_sizes(part))], prepend=0))
            parts.append(flat.filter(left))
        flat = pa.concat_arrays(parts) if parts else pa.array([], items.type.value_type)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), flat)

    return F.arrow_udf(outside, T.ArrayType(kind))


def values_in_place(kind: T.DataType, missing, shared: pa.Array, shared_values: pa.Array, nested: bool = False) -> Callable[..., Column]:
    """``f(items, keys, values)``: for every item the value that stands at its key, ``missing`` for none.

    Keys that all rows share come with the function; a row has its own others. With ``nested`` the values are lists
    (of ``kind``) and are put one after the other.
    """
    value_type = {"int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    held_type = pa.list_(value_type) if nested else value_type
    shared_values = shared_values.cast(held_type)

    def place(items: pa.Array, keys: pa.Array, values: pa.Array) -> pa.Array:
        parts, sizes = [], [np.zeros(1, np.int64)]
        for start, length in slices(_ITEMS_AT_ONCE, items):
            part, own, held = (c.slice(start, length) for c in (items, keys, values))
            at = places_of(part, shared, own)
            found = pa.concat_arrays([shared_values, held.flatten().cast(held_type)]).take(pa.array(at, mask=at < 0))
            size = list_sizes(part)
            if nested:
                found = pc.if_else(found.is_valid(), found, pa.scalar([missing], found.type))
                many = np.concatenate([[0], np.cumsum(list_sizes(found))])
                size = np.diff(many[np.cumsum(size)], prepend=0)
                found = found.flatten()
            else:
                found = pc.fill_null(found, pa.scalar(missing, value_type))
            parts.append(found)
            sizes.append(size)
        flat = pa.concat_arrays(parts) if parts else pa.array([], value_type)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), flat)

    return F.arrow_udf(place, T.ArrayType(kind))
