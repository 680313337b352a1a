"""Math on dense vectors held as arrays; every sum runs in double."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmeter.functions.lets import let
from gistmeter.functions.places import list_sizes, places_of, slices

_BLOCK = 1024
# Rows are compared one by one, but their tokens are looked up together until they are so many.
_ITEMS_AT_ONCE = 1 << 18
_SIDES = T.StructType(
    [T.StructField("precision", T.DoubleType()), T.StructField("recall", T.DoubleType())]
)


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def l2_normalize(vector: Column) -> Column:
    """The vector scaled to length one; null for a zero vector."""
    size = F.when(norm(vector) > 0, norm(vector))
    return let(size, lambda n: F.when(n.isNotNull(), F.transform(vector, lambda x: x.cast("double") / n)))


def cosine(left: Column, right: Column) -> Column:
    """Dot product of the two normalised vectors."""
    return dot(l2_normalize(left), l2_normalize(right))


def pooled(vectors: Column, dim: int) -> Column:
    """Mean of an array of vectors; zeros when there is none."""
    below = F.greatest(F.size(vectors).cast("double"), F.lit(1e-9))
    zeros = F.array_repeat(F.lit(0.0), dim)
    return F.aggregate(
        vectors,
        zeros,
        lambda total, v: F.zip_with(total, v, lambda x, y: x + y.cast("double")),
        lambda total: F.transform(total, lambda x: x / below),
    )


def _unit_rows(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _has_direction(rows: np.ndarray) -> np.ndarray:
    return (rows != 0).any(axis=1)


def _matrices(array: pa.Array) -> list[np.ndarray]:
    """One matrix a row, as views on the batch's flat values."""
    vectors = array.flatten()
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    stacked = values.reshape(len(vectors), -1) if len(vectors) else values.reshape(0, 0)
    ends = np.cumsum([size or 0 for size in array.value_lengths().to_pylist()])
    return np.split(stacked, ends[:-1]) if len(ends) else []


def best_matches(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every vector its largest cosine with the other side, a block of the product at a time.

    A zero vector has no direction: it matches nothing (0) and no maximum sees it.
    """
    some_a, some_b = _has_direction(left), _has_direction(right)
    if not (some_a.all() and some_b.all()):
        out_a, out_b = np.zeros(len(left)), np.zeros(len(right))
        if some_a.any() and some_b.any():
            out_a[some_a], out_b[some_b] = best_matches(left[some_a], right[some_b])
        return out_a, out_b
    a, b = _unit_rows(left), _unit_rows(right)
    best_a = np.full(len(a), -np.inf)
    best_b = np.full(len(b), -np.inf)
    for i in range(0, len(a), _BLOCK):
        for j in range(0, len(b), _BLOCK):
            product = a[i : i + _BLOCK] @ b[j : j + _BLOCK].T
            best_a[i : i + _BLOCK] = np.maximum(best_a[i : i + _BLOCK], product.max(axis=1))
            best_b[j : j + _BLOCK] = np.maximum(best_b[j : j + _BLOCK], product.max(axis=0))
    return best_a, best_b


def _stacked(vectors: pa.Array) -> np.ndarray:
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


@F.arrow_udf(_SIDES)
def greedy_sides(predicted: pa.Array, gold: pa.Array) -> pa.Array:
    """Mean best cosine per side of two ``array<array<float>>`` columns; zero for an empty side."""
    rows = []
    for left, right in zip(_matrices(predicted), _matrices(gold)):
        if len(left) and len(right):
            best_left, best_right = best_matches(left, right)
            rows.append({"precision": float(best_left.mean()), "recall": float(best_right.mean())})
        else:
            rows.append({"precision": 0.0, "recall": 0.0})
    return pa.array(rows, pa.struct([("precision", pa.float64()), ("recall", pa.float64())]))


_TEXT_SCORES = T.ArrayType(
    T.StructType(
        [T.StructField(n, T.DoubleType()) for n in ("cosine", "matched_p", "matched_g")]
        + [T.StructField(n, T.LongType()) for n in ("size_p", "size_g")]
    )
)


def _matched(some: np.ndarray, count: np.ndarray, others: np.ndarray, unit: np.ndarray, turned: np.ndarray) -> float:
    """Summed best cosines of the rows ``some`` of ``unit``, each ``count`` times, with the rows ``others``.

    A row that is among the others matches itself; ``turned`` tells the rows that have a direction, all others match
    nothing (0) and no maximum sees them. A block of the product at a time.
    """
    best = turned[some].astype(np.float64)
    among = np.zeros(len(unit), bool)
    among[others] = True
    alone = np.flatnonzero(turned[some] & ~among[some])
    if not len(alone):
        return float(count @ best)
    seen = unit[others[turned[others]]]
    best[alone] = -np.inf if len(seen) else 0.0
    for i in range(0, len(alone), _BLOCK):
        part = alone[i : i + _BLOCK]
        for j in range(0, len(seen), _BLOCK):
            best[part] = np.maximum(best[part], (unit[some[part]] @ seen[j : j + _BLOCK].T).max(axis=1))
    return float(count @ best)


def text_vector_scores(shared: pa.Array, shared_vectors: pa.Array, cut: Callable[[pa.Array], pa.Array]) -> Callable[..., Column]:
    """``f(keys, vectors, gold, *predicted)``: for each predicted text the cosine of its and the gold text's mean vectors, the summed best cosines of each side's tokens, and how many tokens both have.

    ``cut`` makes lists of tokens of the texts. The vectors of frequent tokens come with the function; ``keys`` and ``vectors`` are
    a row's distinct others that have one. Repeated tokens are compared once and weighted, and the distinct tokens of
    all texts of a row are scaled once. No cosine and no sums for a pair with a side without vectors; the cosine is null
    too where a mean has no direction.
    """
    held = _stacked(shared_vectors)

    def score(keys: pa.Array, vectors: pa.Array, *texts: pa.Array) -> pa.Array:
        rows, texts = [], [cut(text) for text in texts]
        for start, length in slices(_ITEMS_AT_ONCE, *texts):
            sides = [c.slice(start, length) for c in texts]
            own = _stacked(vectors.slice(start, length).flatten())
            at = [places_of(side, shared, keys.slice(start, length)) for side in sides]
            sizes = [list_sizes(side) for side in sides]

            def vectors_at(place: np.ndarray) -> np.ndarray:
                near = place < len(held)
                out = np.empty((len(place), max(held.shape[1], own.shape[1])))  # noqa: B023
                if near.any():
                    out[near] = held[place[near]]
                if not near.all():
                    out[~near] = own[place[~near] - len(held)]  # noqa: B023
                return out

            split = zip(*[np.split(a, np.cumsum(size)[:-1]) for a, size in zip(at, sizes)])
            for parts, lengths in zip(split, zip(*[size.tolist() for size in sizes])):
                places, index = np.unique(np.concatenate(parts), return_inverse=True)
                missing = int(len(places) and places[0] < 0)
                some = vectors_at(places[missing:])
                turned = _has_direction(some)
                unit = np.zeros_like(some)
                unit[turned] = _unit_rows(some[turned])
                distinct = []
                for part in np.split(index, np.cumsum(lengths)[:-1]):
                    count = np.bincount(part, minlength=len(places))[missing:]
                    used = np.flatnonzero(count)
                    mean = count[used] @ some[used] / count.sum() if len(used) else None
                    distinct.append((used, count[used], mean))
                (g, m, b), *others = distinct
                scores = []
                for (p, n, a), size_p in zip(others, lengths[1:]):
                    found = {"size_p": size_p, "size_g": lengths[0]}
                    if len(p) and len(g):
                        size = np.linalg.norm(a) * np.linalg.norm(b)
                        found["cosine"] = float(a @ b / size) if size > 0 else None
                        found["matched_p"], found["matched_g"] = _matched(p, n, g, unit, turned), _matched(g, m, p, unit, turned)
                    scores.append(found)
                rows.append(scores)
        doubles, longs = ("cosine", "matched_p", "matched_g"), ("size_p", "size_g")
        return pa.array(rows, pa.list_(pa.struct([*[(n, pa.float64()) for n in doubles], *[(n, pa.int64()) for n in longs]])))

    return F.arrow_udf(score, _TEXT_SCORES)
