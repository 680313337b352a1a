"""Centroid clustering on bit planes.

Every component is an integer; less the smallest one of the table it is a small non-negative number, whose bits are
spread over planes: bit j of all 64 components of a vector is one 64-bit word. With a centroid in the same form,

    dot(u, c) = sum over j, k of 2 ** (j + k) * popcount(plane j of u AND plane k of c)

is exact, and so is the squared distance ``|u|^2 - 2 dot(u, c) + |c|^2``, which the shift does not change. Sums of
the members of a centroid come from the planes too: how often a bit is set, times its weight.

A vector is written once as its planes, a sixth of its size. Each round reads them, keeps one row of 64 sums for each
batch and centroid, and adds these up in Spark; the driver sees one row for each centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmeter.llm.shared import flat, lists
from gistmeter.session import materialize

WIDTH = 64
#: Components beyond this would make squared distances that no long holds.
LARGEST = 1 << 27
_SUMS = [f"s{d}" for d in range(WIDTH)]


def to_planes(values: np.ndarray, bits: int) -> np.ndarray:
    """Rows of 64 integers below ``2 ** bits`` as rows of ``bits`` words, the lowest plane first."""
    out = np.empty((len(values), bits), np.uint64)
    for j in range(bits):
        out[:, j] = np.packbits(values >> j & 1, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def dots(planes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Dot products of all rows of ``planes`` with all rows of ``centroids``."""
    out = np.zeros((len(planes), len(centroids)), np.int64)
    for j in range(planes.shape[1]):
        for k in range(centroids.shape[1]):
            out += np.bitwise_count(planes[:, j, None] & centroids[None, :, k]).astype(np.int64) << (j + k)
    return out


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of every row (the first of equals) and the squared distance to it."""
    own = np.zeros(len(planes), np.int64)
    for j in range(planes.shape[1]):
        for k in range(j, planes.shape[1]):
            own += np.bitwise_count(planes[:, j] & planes[:, k]).astype(np.int64) << (j + k + int(j < k))
    far = own[:, None] - 2 * dots(planes, centroids) + dots(centroids, centroids).diagonal()
    best = far.argmin(axis=1)
    return best, far[np.arange(len(far)), best]


def plane_sums(planes: np.ndarray, cluster: np.ndarray, count: int) -> np.ndarray:
    """Sum of the components of each cluster's rows."""
    out = np.zeros((count, WIDTH), np.int64)
    order = np.argsort(cluster, kind="stable")
    full, first = np.unique(cluster[order], return_index=True)
    if len(full):
        for j in range(planes.shape[1]):
            bits = np.unpackbits(np.ascontiguousarray(planes[order, j, None]).view(np.uint8), axis=1, bitorder="little")
            out[full] += np.add.reduceat(bits, first, axis=0, dtype=np.int64) << j
    return out


def _matrix(column: pa.ListArray) -> np.ndarray:
    values, counts = flat(column, np.int64)
    return values.reshape(len(counts), -1) if len(counts) else values.reshape(0, 1)


def _whole(column: pa.Array) -> np.ndarray:
    """Which lists have 64 components, none of them null or not finite."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    items = column.flatten()
    good = pc.fill_null(pc.is_finite(items), False).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(good)])
    ends = np.cumsum(size)
    return (size == WIDTH) & (total[ends] - total[ends - size] == WIDTH)


def _integers(scale: float):
    """``vec_id``, its integers as a list, and the least and largest of them, of the vectors that count."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            batch = batch.filter(pa.array(_whole(batch.column("embedding"))))
            if batch.num_rows:
                column = batch.column("embedding")
                real = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, WIDTH)
                with np.errstate(over="ignore"):
                    scaled = np.floor(real * scale)
                if np.abs(scaled).max() >= LARGEST:
                    raise ValueError(f"components times {scale:g} must stay below {LARGEST}")
                values = scaled.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), lists(values.ravel().astype(np.int32), np.full(len(values), WIDTH)), pa.array(values.min(axis=1)), pa.array(values.max(axis=1))],
                    names=["vec_id", "ints", "low", "high"],
                )

    return run


def _as_planes(low: int, bits: int):
    def run(batches):
        for batch in batches:
            planes = to_planes(_matrix(batch.column("ints")) - low, bits)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists(planes.ravel().view(np.int64), np.full(len(planes), bits))], names=["vec_id", "planes"])

    return run


def _sums(centroids: np.ndarray):
    """A row for each batch and centroid that has members in it: how many, and the sums of their components."""

    def run(batches):
        for batch in batches:
            planes = _matrix(batch.column("planes")).view(np.uint64)
            if not len(planes):
                continue
            cluster, _ = nearest(planes, centroids)
            count = np.bincount(cluster, minlength=len(centroids))
            sums = plane_sums(planes, cluster, len(centroids))
            full = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)), pa.array(count[full]), *(pa.array(np.ascontiguousarray(sums[full, d])) for d in range(WIDTH))],
                names=["cluster", "members", *_SUMS],
            )

    return run


def _assigned(centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            planes = _matrix(batch.column("planes")).view(np.uint64)
            if len(planes):
                cluster, distance = nearest(planes, centroids)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def clusters(vectors: DataFrame, count: int = 8, rounds: int = 10, scale: float = 1024.0, seed: int = 3, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every vector that counts.

    Vectors that are null, have another number of components than 64, or hold a null or non-finite one do not count
    and are not returned. A component x is ``floor(scale * x)``; one of ``2 ** 27`` or more is a ValueError in its
    task, since squared distances would not fit a long. The first centroids are the ``count`` vectors with the smallest
    sha256 of ``seed:vec_id`` (of repeated ids, those of the smaller planes; a null id counts as empty); fewer
    vectors make fewer centroids. Each round assigns every vector to the nearest centroid, the smaller number of
    equals, and moves every centroid that has members to the floor of their exact mean. Repeated rows count as often
    as they stand. Other columns are not read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    slim = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    ints = materialize(slim.mapInArrow(_integers(scale), "vec_id long, ints array<int>, low long, high long"), "ints")
    low, high = ints.agg(F.min("low"), F.max("high")).first()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if low is None:
        return spark.createDataFrame([], schema)
    bits = max(int(high - low).bit_length(), 1)
    planes = materialize(ints.mapInArrow(_as_planes(low, bits), "vec_id long, planes array<long>"), "planes")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = planes.select(order.alias("digest"), "planes").orderBy("digest", "planes").limit(count).collect()
    packed = np.array([r["planes"] for r in first], np.int64).view(np.uint64)
    values = np.zeros((len(first), WIDTH), np.int64)
    for j in range(bits):
        values += (packed[:, j, None] >> np.arange(WIDTH, dtype=np.uint64) & np.uint64(1)).astype(np.int64) << j
    ddl = ", ".join(["cluster int", "members long", *(f"{s} long" for s in _SUMS)])
    for _ in range(rounds):
        partial = planes.mapInArrow(_sums(to_planes(values, bits)), ddl)
        total = partial.groupBy("cluster").agg(F.sum("members").alias("members"), *(F.sum(s).alias(s) for s in _SUMS))
        moved = values.copy()
        for row in total.collect():  # one row for each centroid
            moved[row["cluster"]] = [row[s] // row["members"] for s in _SUMS]
        values = moved
    digests = [hashlib.sha256(",".join(map(str, (v + low).tolist())).encode()).hexdigest() for v in values]
    found = materialize(planes.mapInArrow(_assigned(to_planes(values, bits)), "vec_id long, cluster int, distance long"), "assigned")
    # One row for each centroid with members, at most ``count``, is collected and broadcast.
    per = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    facts = [(k, own, sum(per.values()), digests[k]) for k, own in per.items()]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
