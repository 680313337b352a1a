"""Embedding near-dedup by a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order (Chavez, Figueroa, Navarro, 2008). It
stands in the inverted list of each pair of its nearest pivots, so two vectors meet if they share two of these;
they are candidates if they share at least ``SHARED`` of a longer list, and are then verified by cosine in double
precision. The more pivots, the less short lists overlap, so both lists grow with the number of pivots (``reach``).
Equal vectors are one class. The links of a vector are counted inside its component, block by block: a block is what
lies round one pivot, and only blocks whose caps leave it open are compared, without a row for any pair of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmeter.llm.shared import flat, left_lookup, linked_groups, lists, partitions_of
from gistmeter.session import materialize

SHARED = 8
#: Vectors of a component that are multiplied with as many others at once.
BLOCK = 1024


def reach(pivots: int) -> tuple[int, int]:
    """How many nearest pivots are paired into lists, and how many are compared: 10 and 24 up to 512 pivots, 16 and 48 at 16,384."""
    doublings = max(float(np.log2(max(pivots, 1) / 512)), 0.0)
    return int(np.ceil(10 + 1.2 * doublings)), int(np.ceil(24 * 2 ** (doublings / 5)))


def matrices(batch: pa.RecordBatch, column: str = "embedding") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors in double precision, once for each length of vector in a batch."""
    values, counts = flat(batch.column(column), np.float64)
    starts = np.cumsum(counts) - counts
    for size in np.unique(counts[counts > 0]):
        rows = np.flatnonzero(counts == size)
        block = values[starts[rows][:, None] + np.arange(size)]
        # Divided by the largest component first, so that squares neither overflow nor vanish.
        block = block / np.abs(block).max(1, keepdims=True)
        yield rows, block / np.sqrt((block**2).sum(1, keepdims=True))


def _index(pivots: np.ndarray):
    lead, deep = reach(len(pivots))
    first, second = np.array(list(combinations(range(lead), 2))).T

    def run(batches):
        for batch in batches:
            node = batch.column("node").to_numpy()
            for rows, unit in matrices(batch):
                for k in range(0, len(rows), 1024):
                    part, some = unit[k : k + 1024], rows[k : k + 1024]
                    width = min(part.shape[1], pivots.shape[1])
                    order = np.argsort(-(part[:, :width] @ pivots[:, :width].T), axis=1, kind="stable")[:, :deep]
                    a, b = order[:, first % order.shape[1]], order[:, second % order.shape[1]]
                    key = (np.minimum(a, b) * len(pivots) + np.maximum(a, b)).astype(np.int64) + np.int64(part.shape[1]) * 2**40
                    # Angles are a distance only among vectors as long as the pivots.
                    cosine = (part[:, :width] * pivots[order[:, 0], :width]).sum(1)
                    angle = np.arccos(np.clip(cosine, -1, 1)) if part.shape[1] == pivots.shape[1] else np.full(len(part), np.pi)
                    columns = [pa.array(node[some]), lists(order.astype(np.int16).ravel(), np.full(len(order), order.shape[1])), lists(key.ravel(), np.full(len(key), key.shape[1]))]
                    columns += [pa.array(np.full(len(part), part.shape[1], np.int32)), pa.array(order[:, 0].astype(np.int32)), pa.array(angle)]
                    yield pa.RecordBatch.from_arrays(columns, names=["node", "near", "keys", "width", "cell", "angle"])

    return run


def _cosines(least: float):
    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            sides = {}
            for name in ("x", "y"):
                for rows, unit in matrices(batch, name):
                    sides.setdefault(unit.shape[1], {})[name] = (rows, unit)
            for pair in sides.values():
                if len(pair) == 2:
                    (r, x), (s, y) = pair["x"], pair["y"]
                    both, i, j = np.intersect1d(r, s, return_indices=True)
                    keep[both] = (x[i] * y[j]).sum(1) >= least
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


#: What names a pair of blocks: component, length of vector, and nearest pivot and piece of each side.
_PAIR = ["root", "width", "cell_i", "piece_i", "cell_j", "piece_j"]


def _compared(pivots: np.ndarray, least: float):
    """Pairs of blocks that may hold a link; ``whole`` says that all of their vectors link.

    A block lies in a cap round its pivot. By the triangle inequality its vectors are no farther from those of
    another block than the pivots' angle and both radii, and no nearer than that angle without them.
    """
    limit, slack = np.arccos(least), 1e-6

    def run(batches):
        for batch in batches:
            i, j = batch.column("cell_i").to_numpy(), batch.column("cell_j").to_numpy()
            radii = batch.column("angle_i").to_numpy() + batch.column("angle_j").to_numpy()
            between = np.arccos(np.clip((pivots[i] * pivots[j]).sum(1), -1, 1))
            between[i == j] = 0
            whole = between + radii < limit - slack
            near = between - radii < limit + slack
            columns = [*(batch.column(c) for c in _PAIR), batch.column("copies_j"), pa.array(whole)]
            yield pa.RecordBatch.from_arrays(columns, names=[*_PAIR, "copies_j", "whole"]).filter(pa.array(near))

    return run


def _links(least: float):
    """Rows come by component and pair of blocks; counts the links of the vectors of the left block."""

    def count(batch):
        side, copies, node = (batch.column(c).to_numpy() for c in ("side", "copies", "node"))
        for rows, unit in matrices(batch):
            left, right = side[rows] == 0, side[rows] == 1
            total = np.zeros(int(left.sum()), np.int64)
            weights = copies[rows][right]
            for k in range(0, len(total), BLOCK):
                total[k : k + BLOCK] = (unit[left][k : k + BLOCK] @ unit[right].T >= least) @ weights
            yield pa.RecordBatch.from_arrays([pa.array(node[rows][left]), pa.array(total)], names=["node", "links"])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([b for b in (held, batch) if b is not None]).combine_chunks()
            batch = table.to_batches()[0] if table.num_rows else batch
            key = np.stack([batch.column(c).to_numpy() for c in _PAIR], axis=1)
            cuts = [*(np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1)]
            start = 0
            for stop in cuts:
                yield from count(batch.slice(start, stop - start))
                start = stop
            held = batch.slice(start)
        if held is not None and held.num_rows:
            yield from count(held)

    return run


def _in_pieces(members: DataFrame, most: int = 2_000_000) -> DataFrame:
    """``members`` (written) with the piece of their cell they are in; a cell of a component has about ``BLOCK`` to a piece."""
    members = materialize(members, "members")
    cell = ["root", "width", "cell"]
    crowded = members.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("pieces")).where("pieces > 1")
    crowded = materialize(crowded, "crowded")  # at most one row for each BLOCK members
    small = crowded.limit(most + 1).count() <= most
    placed = members.join(F.broadcast(crowded) if small else crowded, cell, "left")
    return materialize(placed.withColumn("piece", F.pmod(F.xxhash64("node"), F.coalesce("pieces", F.lit(1))).cast("int")).drop("pieces"), "placed")


def near_vectors(vectors: DataFrame, least: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", pivots: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Vectors link at a cosine of ``least`` or more. ``n_links`` counts the rows linked directly, ``component_id``
    is the smallest id reachable, ``kept`` says whether it is the row's own. A vector that is null, empty or zero,
    or holds a null or a non-finite component, links with nothing; vectors of different lengths never link. Rows
    with a null id have no links and a null component. Rows that repeat an id count one by one as links, and link
    each other. Other columns are not read; an empty table gives an empty result. All vectors are indexed; the
    ``pivots`` (default twice the root of the number of vectors, between 512 and 16,384) are vectors chosen by a
    digest of the id. Links found are exact; pairs are missed only if neither their pivots nor other vectors connect
    them (recall by number of pivots: tests/llm and the README).
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    digest = F.when(usable, F.concat(F.hex(F.xxhash64("embedding")), F.lit("-"), F.hex(F.xxhash64(F.reverse("embedding"), F.lit(1)))))
    keyed = rows.select("vec_id", digest.alias("digest"), "embedding")
    classes = keyed.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    classes = materialize(classes, "classes")
    number = int(np.clip(2 * np.sqrt(classes.count()), 512, 16_384)) if pivots is None else pivots
    chosen = classes.select("node", "embedding").orderBy(F.xxhash64(F.lit(9), "node"), "node").limit(number).collect()
    width = max((len(r["embedding"]) for r in chosen), default=1)
    points = np.zeros((max(len(chosen), 1), width))
    for k, r in enumerate(chosen):
        v = np.array(r["embedding"])
        v = v / np.abs(v).max()
        points[k, : len(v)] = v / np.sqrt((v**2).sum())
    described = materialize(classes.select("node", "embedding").mapInArrow(_index(points), "node long, near array<short>, keys array<long>, width int, cell int, angle double"), "described")
    # All sizes fit here.
    none = [F.lit(0).alias(c) for c in ("weight", "size", "most")]
    postings = materialize(described.select(F.explode(F.array_distinct("keys")).alias("key"), "node", *none), "postings")

    def verify(pairs: DataFrame) -> DataFrame:
        # Pairs that share a list, once each; then the pivots they share are counted.
        near = [described.select(F.col("node").alias(c), F.col("near").alias(f"near_{c}")) for c in ("a", "b")]
        pairs = pairs.join(near[0], "a").join(near[1], "b").where(F.size(F.array_intersect("near_a", "near_b")) >= SHARED).select("a", "b")
        one = classes.select(F.col("node").alias("a"), F.col("embedding").alias("x"))
        two = classes.select(F.col("node").alias("b"), F.col("embedding").alias("y"))
        return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_cosines(least), "a long, b long")

    def close(x: str, y: str) -> Column:
        return F.size(F.array_intersect(f"{x}.near", f"{y}.near")) >= SHARED

    roots, _ = linked_groups(postings, verify, described.select("node", "near"), close)
    roots = materialize(roots, "roots")
    members = roots.join(described.select("node", "width", "cell", "angle"), "node").join(classes.select("node", "copies", "embedding"), "node")
    members = _in_pieces(members)
    block = ["root", "width", "cell", "piece"]
    caps = materialize(members.groupBy(*block).agg(F.sum("copies").alias("copies"), F.max("angle").alias("angle")), "caps")
    sides = [caps.withColumnsRenamed({c: f"{c}_{k}" for c in ("cell", "piece", "copies", "angle")}) for k in ("i", "j")]
    ddl = "root long, width int, cell_i int, piece_i int, cell_j int, piece_j int, copies_j long, whole boolean"
    pairs = materialize(sides[0].join(sides[1], ["root", "width"]).mapInArrow(_compared(points, least), ddl), "pairs")
    # Pairs of blocks that link as a whole are counted without their vectors.
    sure = pairs.where("whole").groupBy("root", "width", "cell_i", "piece_i").agg(F.sum("copies_j").alias("links"))
    sure = members.join(sure.withColumnsRenamed({"cell_i": "cell", "piece_i": "piece"}), block).select("node", "links")
    open_pairs = pairs.where("not whole").drop("copies_j", "whole")
    both = []
    for side, k in enumerate(("i", "j")):
        own = members.withColumnsRenamed({"cell": f"cell_{k}", "piece": f"piece_{k}"}).drop("angle")
        both.append(own.join(open_pairs, ["root", "width", f"cell_{k}", f"piece_{k}"]).select(*_PAIR, F.lit(side).alias("side"), "node", "copies", "embedding"))
    dealt = both[0].union(both[1]).repartition(partitions_of(vectors), *_PAIR).sortWithinPartitions(*_PAIR)
    links = dealt.mapInArrow(_links(least), "node long, links long").union(sure).groupBy("node").agg(F.sum("links").alias("links"))
    table = classes.select("digest", "node", "copies").join(roots, "node", "left").join(links, "node", "left")
    table = table.select("digest", (F.coalesce("links", "copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"), "copies")
    found = left_lookup(keyed.select("vec_id", "digest"), materialize(table, "found"), "digest", "copies")
    own = F.coalesce("component_id", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))
