"""N-gram Jaccard join by vertical partitioning.

A document is its set of distinct 5-word shingles, as 64-bit fingerprints. The global order of all shingles is
cut into fragments (ranges of the fingerprint); what documents share is counted fragment by fragment and summed.

1. Every document sends the first half of its set, fragment by fragment. A fragment's task sees which shingles
   other documents have too; the partial counts are summed per document. Two sets of similarity t share at least
   t * (t - 1/2) of the larger size within both first halves, so a document below that has no partner and is done.
2. Equal sets form one class, held by its smallest id. The classes left send their whole sets; each fragment
   counts its shingles, which orders them from rare to frequent, and the leading ``n - ceil(t n) + 1`` of a
   class's shingles in that order become postings. Classes that link share a posting.
   A posting tells how large a partner may be that shares nothing before it, since an overlap is at most what is
   left of either set from their first common shingle on.
3. Candidate pairs of the inverted lists are verified: each fragment of the sets counts its own partial overlap of the
   pair, in a row of its own, and the rows are summed per pair. ``shared.linked_groups`` keeps the number of pairs
   near the number of postings.

Shingles that are frequent within single tasks are found beforehand and put at the end of the order (a bounded
list, which changes the work but not the result), so no fragment receives a frequent shingle document by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmeter.llm.shared import Words, flat, id_values, linked_groups, lists, mixed, only, partitions_of, pieces, shard_of, signed, text_of, windows
from gistmeter.session import materialize

#: Fragments of the global order in which the overlaps of pairs are counted.
SLICES = 4
#: 64-bit words of a set's parity sketch.
SKETCH = 16
_SKETCH = [f"sketch{k}" for k in range(SKETCH)]
#: Most shingles put at the end of the order before any are counted.
FREQUENT = 100_000
#: Items that a task holds at once.
HELD = 2_000_000


def least_overlap(size: np.ndarray, percent: int) -> np.ndarray:
    """Smallest number of a set's items that a partner must share: ``ceil(percent / 100 * size)``."""
    return -(-percent * size // 100)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle fingerprints of every text, ascending within it, and how many each text has.

    A text with fewer than ``size`` words has one for its whole word sequence, one without words none.
    """
    words = Words(column, lower=True)
    prints, count = words.fingerprints(), words.count
    of_word = text_of(count)
    grams = windows(prints, size)
    owner = of_word[: len(grams)]
    inside = owner == of_word[len(of_word) - len(grams) :] if len(grams) else np.zeros(0, bool)
    values, owners = [grams[inside]], [owner[inside]]
    for k in range(1, size):
        short = np.flatnonzero(count == k)
        if len(short):
            values.append(windows(prints, k)[words.of_text[short]])
            owners.append(short)
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(value)
    narrow = owner[order].astype(np.uint16 if len(count) < 1 << 16 else np.uint32)
    order = order[np.argsort(narrow, kind="stable")]
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[fresh], np.bincount(owner[fresh], minlength=len(count))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts), np.uint64)
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


_PARTS = pa.schema([("part", pa.int32()), ("inner", pa.list_(pa.int32())), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("items", pa.list_(pa.int32())), ("seen", pa.list_(pa.int32())), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])
_PARTS_DDL = "part int, inner array<int>, docs array<long>, counts array<int>, items array<int>, seen array<int>, a array<long>, b array<long>"


def _cut(docs: np.ndarray, of_item: np.ndarray, items: np.ndarray, seen: np.ndarray, bits: int, parts: int) -> Iterator[pa.RecordBatch]:
    """A row for each task that reads it: documents, items of each, and items that need no answer, by fragment.

    A task reads a range of the ``2 ** bits`` fragments. ``inner`` has, for each fragment in the row, its number
    and how many documents, items and seen items belong to it; an item keeps 32 of its bits.
    """
    shift, rest = np.uint64(64 - bits), np.uint64(32 - bits)
    low = lambda v: ((v >> rest) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    fragment = (items >> shift).astype(np.int32)
    order = np.lexsort((of_item, fragment))
    fragment, of_item, values = fragment[order], of_item[order], low(items[order])
    seen = np.sort(seen)
    edges = np.arange((1 << bits) + 1)
    at, seen_at = np.searchsorted(fragment, edges), np.searchsorted((seen >> shift).astype(np.int32), edges)
    seen = low(seen)
    runs = np.flatnonzero(np.diff(of_item, prepend=-1) | np.diff(fragment, prepend=-1)) if len(items) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(runs, len(items))).astype(np.int32)
    run_at = np.searchsorted(runs, at)
    full = np.flatnonzero((np.diff(at) > 0) | (np.diff(seen_at) > 0))
    if not len(full):
        return
    inner = np.stack([full, np.diff(run_at)[full], np.diff(at)[full], np.diff(seen_at)[full]], axis=1)
    part = (full * parts) >> bits
    first = np.flatnonzero(np.diff(part, prepend=-1))
    stop = np.append(first[1:], len(full))
    for k in range(0, len(first), 256):
        lo, hi = first[k : k + 256], stop[k : k + 256]
        a, b = full[lo[0]], full[hi[-1] - 1] + 1
        per = np.add.reduceat(inner[lo[0] : hi[-1]], lo - lo[0], axis=0)
        none = np.zeros(len(lo), np.int64)
        columns = [
            pa.array(part[lo]),
            lists(inner[lo[0] : hi[-1]].ravel(), (hi - lo) * 4),
            lists(docs[of_item[runs[run_at[a] : run_at[b]]]], per[:, 1]),
            lists(sizes[run_at[a] : run_at[b]], per[:, 1]),
            lists(values[at[a] : at[b]], per[:, 2]),
            lists(seen[seen_at[a] : seen_at[b]], per[:, 3]),
            lists(np.zeros(0, np.int64), none),
            lists(np.zeros(0, np.int64), none),
        ]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _PARTS)], schema=_PARTS)


def dealt(sent: DataFrame, parts: int) -> DataFrame:
    """Rows of ``_cut`` in the task that reads them, those that only pass through (part below 0) spread and first."""
    to = F.when(F.col("part") < 0, F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")).otherwise(F.col("part"))
    return sent.withColumn("to", to).repartitionById(parts, "to").drop("to").sortWithinPartitions("part")


def _first_halves(size: int, bits: int, parts: int):
    def flush(ids, counts, keys_a, keys_b, prefix):
        ids, counts, a, b = (np.concatenate(x) for x in (ids, counts, keys_a, keys_b))
        header = [pa.array([-1], pa.int32()), lists(np.zeros(0, np.int32), [0]), lists(ids, [len(ids)]), lists(counts.astype(np.int32), [len(ids)]), lists(np.zeros(0, np.int32), [0]), lists(np.zeros(0, np.int32), [0]), lists(signed(a), [len(ids)]), lists(signed(b), [len(ids)])]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(header, _PARTS)], schema=_PARTS)
        # One of equal sets speaks for all of them.
        order = np.lexsort((counts, b, a))
        first = np.ones(len(order), bool)
        first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]) | (counts[order][1:] != counts[order][:-1])
        speaks = np.zeros(len(ids), bool)
        speaks[order[first]] = True
        values = np.concatenate(prefix)
        of_item = text_of((counts + 1) // 2)
        chosen = speaks[of_item]
        values, of_item = values[chosen], of_item[chosen]
        # What two sets of this task share is known here; others only have to see it.
        order = np.argsort(values)
        values, of_item = values[order], of_item[order]
        same = np.zeros(len(values) + 1, bool)
        same[1:-1] = values[1:] == values[:-1]
        shared = same[1:] | same[:-1]
        here = np.bincount(of_item[shared], minlength=len(ids))
        known = np.flatnonzero(here)
        rows = [pa.array([-2], pa.int32()), lists(np.zeros(0, np.int32), [0]), lists(ids[known], [len(known)]), lists(here[known].astype(np.int32), [len(known)]), *(lists(np.zeros(0, np.int32), [0]) for _ in range(4))]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(rows, _PARTS)], schema=_PARTS)
        yield from _cut(ids, of_item[~shared], values[~shared], values[shared & ~same[:-1]], bits, parts)

    def run(batches):
        kept: list[list] = [[], [], [], [], []]
        held = 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                value, count = shingle_sets(piece.column("text"), size)
                rank = np.arange(len(value)) - np.repeat(np.cumsum(count) - count, count)
                for to, x in zip(kept, (id_values(piece.column("doc_id")), count, _sums(mixed(value), count), _sums(mixed(value + np.uint64(0x9E3779B97F4A7C15)), count), value[rank < np.repeat((count + 1) // 2, count)])):
                    to.append(x)
                held += len(kept[4][-1])
                if held > HELD // 2:
                    yield from flush(*kept)
                    kept, held = [[], [], [], [], []], 0
        if kept[0]:
            yield from flush(*kept)

    return run


def _by_fragments(batches, answer):
    """Call ``answer(keys, documents, seen)`` for whole fragments, about ``HELD`` items at a time."""
    rows, last = [], None
    for batch in batches:
        for k, part in enumerate(batch.column("part").to_numpy()):
            if rows and part != last:
                yield from _answered(rows, answer)
                rows = []
            last = part
            one = batch.slice(k, 1)
            inner = flat(one.column("inner"), np.int64)[0].reshape(-1, 4)
            edges = np.vstack([np.zeros(3, np.int64), np.cumsum(inner[:, 1:], axis=0)])
            columns = [flat(one.column(c), t)[0] for c, t in (("docs", np.int64), ("counts", np.int32), ("items", np.int32), ("seen", np.int32))]
            rows.append((inner[:, 0], edges, *columns))
    if rows:
        yield from _answered(rows, answer)


def _answered(rows, answer):
    """The rows of one task, cut again into runs of fragments with about ``HELD`` items."""
    fragments = np.concatenate([r[0] for r in rows])
    weights = np.concatenate([np.diff(r[1][:, 1]) + np.diff(r[1][:, 2]) for r in rows])
    low = int(fragments.min())
    total = np.bincount(fragments - low, weights)
    cuts = np.flatnonzero(np.diff((np.cumsum(total) // HELD).astype(np.int64))) + 1
    bounds = [low, *(cuts + low), low + len(total)]
    for start, stop in zip(bounds[:-1], bounds[1:]):
        keys, owners, seen = [], [], []
        for fragment, edges, docs, counts, items, known in rows:
            i, j = np.searchsorted(fragment, [start, stop])
            if i == j:
                continue
            (d0, n0, s0), (d1, n1, s1) = edges[i], edges[j]
            base = fragment[i:j] << 32
            keys.append(np.repeat(base, np.diff(edges[i : j + 1, 1])) + items[n0:n1].view(np.uint32).astype(np.int64))
            owners.append(np.repeat(docs[d0:d1], counts[d0:d1]))
            seen.append(np.repeat(base, np.diff(edges[i : j + 1, 2])) + known[s0:s1].view(np.uint32).astype(np.int64))
        if keys:
            yield from answer(np.concatenate(keys), np.concatenate(owners), np.concatenate(seen))


def _shared_counts(shards: int):
    """By shard: headers as they are, and for documents how many of their items another task has too."""

    def answer(keys, owners, seen):
        both = np.concatenate([keys, seen])
        order = np.argsort(both)
        value = both[order]
        same = np.zeros(len(value) + 1, bool)
        same[1:-1] = value[1:] == value[:-1]
        shared = order[same[1:] | same[:-1]]
        docs, counts = np.unique(owners[shared[shared < len(keys)]], return_counts=True)
        yield from _told(docs, [None, None, None, counts.astype(np.int32)], _COUNTED, shards)

    def headers(batch):
        kind = batch.column("part").to_numpy()
        for row in np.flatnonzero(kind < 0):
            one = batch.slice(int(row), 1)
            docs, _ = flat(one.column("docs"), np.int64)
            counts, _ = flat(one.column("counts"), np.int32)
            if kind[row] == -2:
                yield from _told(docs, [None, None, None, counts], _COUNTED, shards)
            else:
                a, b = (flat(one.column(c), np.int64)[0] for c in ("a", "b"))
                yield from _told(docs, [counts, a, b, None], _COUNTED, shards)

    def run(batches):
        rest = []

        def fragments():
            for batch in batches:
                rest.extend(headers(batch))
                keep = np.flatnonzero(batch.column("part").to_numpy() >= 0)
                if len(keep):
                    yield batch.slice(int(keep[0]))

        for out in _by_fragments(fragments(), answer):
            yield from rest
            rest.clear()
            yield out
        yield from rest

    return run


def _by_shard(batches, done) -> Iterator[pa.RecordBatch]:
    """``done(parts)`` for the rows of each shard, which come one after the other."""
    held, last = [], None
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)] if len(shard) else [0]
        for start, stop in zip(cuts[:-1], cuts[1:]):
            if held and shard[start] != last:
                yield done(held)
                held = []
            last = shard[start]
            held.append(batch.slice(start, stop - start))
    if held:
        yield done(held)


def _joined(parts: list[pa.RecordBatch], column: str, dtype) -> np.ndarray:
    return np.concatenate([flat(part.column(column), dtype)[0] for part in parts])


def _set_rows(batches):
    """A row for each document, from what its shard was told: its header, and the sum of its partial counts."""

    def done(parts):
        # Only headers have set sizes, only partial counts have numbers of shared items.
        of_header = [p.filter(pc.greater(pc.list_value_length(p.column("n")), 0)) for p in parts]
        of_count = [p.filter(pc.greater(pc.list_value_length(p.column("shared")), 0)) for p in parts]
        docs = _joined(of_header, "nodes", np.int64)
        order = np.argsort(docs, kind="stable")
        docs = docs[order]
        first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])) if len(docs) else np.zeros(0, np.int64)
        top = lambda column: np.maximum.reduceat(_joined(of_header, column, np.int64)[order], first) if len(first) else first
        shared = np.zeros(len(first), np.int64)
        np.add.at(shared, np.searchsorted(docs[first], _joined(of_count, "nodes", np.int64)), _joined(of_count, "shared", np.int64))
        columns = [docs[first], top("n").astype(np.int32), top("a"), top("b"), shared]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "n", "a", "b", "shared"])

    return _by_shard(batches, done)


def _bags(size: int):
    """A row for each class and fragment that it has items in; the first of a class has the parity sketch of its set."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                value, count = shingle_sets(piece.column("text"), size)
                of_item = text_of(count)
                bit = (mixed(value) & np.uint64(64 * SKETCH - 1)).astype(np.int64)
                odd = np.bincount(of_item * 64 * SKETCH + bit, minlength=len(count) * 64 * SKETCH) & 1
                sketch = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(count), SKETCH)
                # Items ascend within a text, so its fragments are runs.
                cell = of_item * SLICES + (value >> np.uint64(64 - SLICES.bit_length() + 1)).astype(np.int64)
                full, per = np.unique(cell, return_counts=True)
                row = full // SLICES
                lead = np.append(True, row[1:] != row[:-1])[: len(row)]
                columns = [pa.array(id_values(piece.column("doc_id"))[row]), pa.array(count[row].astype(np.int32)), pa.array((full % SLICES).astype(np.int32)), pa.array(lead), lists(signed(value), per)]
                columns += [pa.array(np.where(lead, sketch[row, k], 0), mask=~lead) for k in range(SKETCH)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "slice", "lead", "items", *_SKETCH])

    return run


def _items(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The items of a batch of fragments, and the row of each."""
    value, counts = flat(batch.column("items"), np.int64)
    return value, text_of(counts)


def _frequent(batches):
    """Shingles that many classes of this task have, with their number."""

    def counted(values, nodes):
        value, count = np.unique(np.concatenate(values), return_counts=True)
        some = count >= max(32, nodes // 16)
        return pa.RecordBatch.from_arrays([pa.array(value[some]), pa.array(count[some])], names=["item", "n"])

    values, nodes, held = [], 0, 0
    for batch in batches:
        value, _ = _items(batch)
        values.append(value)
        nodes, held = nodes + pc.sum(batch.column("lead")).as_py(), held + len(value)
        if held > HELD:
            yield counted(values, nodes)
            values, nodes, held = [], 0, 0
    if values:
        yield counted(values, nodes)


def _whole_sets(frequent: np.ndarray, bits: int, parts: int):
    def run(batches):
        for batch in batches:
            value, of_item = _items(batch)
            rare = ~np.isin(value, frequent)
            yield from _cut(batch.column("node").to_numpy(), of_item[rare], value[rare].view(np.uint64), np.zeros(0, np.uint64), bits, parts)

    return run


def _told(nodes: np.ndarray, values: list[np.ndarray | None], fields: dict[str, type], shards: int) -> Iterator[pa.RecordBatch]:
    """A row for each shard (``shard_of``) with nodes and their values side by side; None leaves a list empty."""
    shard = shard_of(nodes, shards)
    order = np.argsort(shard, kind="stable")
    nodes, shard = nodes[order], shard[order]
    values = [None if v is None else v[order].astype(dtype, copy=False) for v, dtype in zip(values, fields.values())]
    first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(nodes) else np.zeros(0, np.int64)
    per = np.diff(np.append(first, len(nodes)))
    for k in range(0, len(first), 256):
        part = per[k : k + 256]
        cut = slice(first[k], first[k] + int(part.sum()))
        none = np.zeros(len(part), np.int64)
        columns = [lists(np.zeros(0, dtype), none) if v is None else lists(v[cut], part) for v, dtype in zip(values, fields.values())]
        yield pa.RecordBatch.from_arrays([pa.array(shard[first[k : k + 256]]), lists(nodes[cut], part), *columns], names=["shard", "nodes", *fields])


#: What a shard is told of a document's set, and of a class's items.
_COUNTED = {"n": np.int32, "a": np.int64, "b": np.int64, "shared": np.int32}
_COUNTED_DDL = "shard long, nodes array<long>, n array<int>, a array<long>, b array<long>, shared array<int>"
_ITEM = {"keys": np.int64, "df": np.int32}
_ITEM_DDL = "shard long, nodes array<long>, keys array<long>, df array<int>"


def _ranked(shards: int):
    """Classes with those of their items that other classes have, and the number of classes that have each."""

    def answer(keys, owners, seen):
        order = np.argsort(keys)
        value = keys[order]
        first = np.flatnonzero(np.diff(value, prepend=-1))
        size = np.diff(np.append(first, len(value)))
        df = np.repeat(size, size)
        shared = df > 1
        yield from _told(owners[order][shared], [value[shared], df[shared]], _ITEM, shards)

    return lambda batches: _by_fragments(batches, answer)


def _sizes_and_frequent(frequent: np.ndarray, bits: int, shards: int):
    """Classes with their set sizes (number 0), and with their frequent items, which come last in the order."""

    def run(batches):
        for batch in batches:
            node, lead = batch.column("node").to_numpy(), batch.column("lead").to_numpy(zero_copy_only=False)
            yield from _told(node[lead], [batch.column("n").to_numpy()[lead], np.zeros(int(lead.sum()))], _ITEM, shards)
            value, of_item = _items(batch)
            hit = np.isin(value, frequent)
            keys = (value[hit].view(np.uint64) >> np.uint64(32 - bits)).astype(np.int64)
            yield from _told(node[of_item[hit]], [keys, np.full(len(keys), 2**31 - 1)], _ITEM, shards)

    return run


def _postings(percent: int):
    """Postings of each class from what its shard was told: items of one class come first, frequent ones last."""

    def done(parts):
        nodes, keys, df = (_joined(parts, c, np.int64) for c in ("nodes", "keys", "df"))
        size_row = df == 0
        node, n = nodes[size_row], keys[size_row]
        order = np.argsort(node)
        node, n = node[order], n[order]
        of_item, keys, df = np.searchsorted(node, nodes[~size_row]), keys[~size_row], df[~size_row]
        order = np.lexsort((keys, df, of_item))
        keys, of_item = keys[order], of_item[order]
        shared = np.bincount(of_item, minlength=len(node))
        room = n - least_overlap(n, percent) + 1 - (n - shared)
        rank = np.arange(len(keys)) - np.repeat(np.cumsum(shared) - shared, shared)
        chosen = rank < room[of_item]
        of_item, keys, rank = of_item[chosen], keys[chosen], rank[chosen]
        weight = np.bincount(of_item, minlength=len(node))
        # An overlap of at least percent of a union, and at most what is left, bounds the partner's size.
        most = (shared[of_item] - rank) * (100 + percent) // percent - n[of_item]
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(node[of_item]), *(pa.array(v.astype(np.int32)) for v in (weight[of_item], n[of_item], most))], names=["key", "node", "weight", "size", "most"])

    return lambda batches: _by_shard(batches, done)


def jaccard_groups(docs: DataFrame, percent: int = 75, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every id of ``docs``.

    Documents link when ``100 * intersection >= percent * union`` of their shingle sets (``percent`` over 50);
    ``component_id`` is the smallest id reachable by links. Words are lower-cased in A-Z. A document with fewer
    than ``size`` words is one shingle, its whole sequence; a null text or one without words has none and links
    with nothing. Repeated rows count once. Rows with a null id are counted but cannot be named: their component
    is null and they link nothing. Other columns are not read; an empty table gives an empty result. No set is
    cut: only the order in which candidates are sought depends on how the table is split.
    """
    parts = partitions_of(docs)
    bits = int(np.clip(np.ceil(np.log2(parts * 8)), 6, 20))
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    halves = slim.where(F.col("doc_id").isNotNull()).mapInArrow(_first_halves(size, bits, parts), _PARTS_DDL)
    # One shard for each task that reads them: a row for every document and task would be many times the table.
    counted = dealt(halves, parts).mapInArrow(_shared_counts(parts), _COUNTED_DDL).repartitionById(parts, F.col("shard").cast("int"))
    sets = counted.sortWithinPartitions("shard").mapInArrow(_set_rows, "doc_id long, n int, a long, b long, shared long")
    sets = materialize(sets, "sets")
    need = F.ceil(F.col("n") * F.lit((percent - 50) * percent) / 10_000)
    classes = sets.where("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("node"), F.max((F.col("shared") >= F.greatest(need, F.lit(1))).cast("int")).alias("open"))
    classes = materialize(classes, "classes")
    texts = only(slim, classes.where("open = 1").select(F.col("node").alias("doc_id")), "doc_id")
    if slim.where("doc_id is not null").count() != sets.count():
        texts = texts.dropDuplicates(["doc_id"])
    bags = materialize(texts.mapInArrow(_bags(size), ", ".join(["node long", "n int", "slice int", "lead boolean", "items array<long>", *(f"{c} long" for c in _SKETCH)])), "bags")
    common = bags.mapInArrow(_frequent, "item long, n long").groupBy("item").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "item").limit(FREQUENT)
    frequent = np.sort(np.array([r["item"] for r in common.collect()], np.int64))
    sent = bags.mapInArrow(_whole_sets(frequent, bits, parts), _PARTS_DDL)
    ranked = dealt(sent, parts).mapInArrow(_ranked(parts), _ITEM_DDL)
    told = ranked.union(bags.mapInArrow(_sizes_and_frequent(frequent, bits, parts), _ITEM_DDL))
    by_shard = told.repartitionById(parts, F.col("shard").cast("int")).sortWithinPartitions("shard")
    postings = materialize(by_shard.mapInArrow(_postings(percent), "key long, node long, weight int, size int, most int"), "postings")

    def verify(pairs: DataFrame) -> DataFrame:
        one = bags.select(F.col("node").alias("a"), F.col("n").alias("na"), "slice", F.col("items").alias("x"))
        two = bags.select(F.col("node").alias("b"), F.col("n").alias("nb"), "slice", F.col("items").alias("y"))
        partial = pairs.join(one, "a").join(two, ["b", "slice"]).select("a", "b", "na", "nb", F.size(F.array_intersect("x", "y")).alias("part"))
        summed = partial.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("part").alias("common"))
        return summed.where(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("a", "b")

    def close(x: str, y: str) -> Column:
        # Items of one set only flip a bit each, so the sketches differ in no more bits than the sets in items.
        apart = [F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in _SKETCH]
        return sum(apart[1:], apart[0]) * (100 + percent) <= (F.col(f"{x}.size") + F.col(f"{y}.size")) * (100 - percent)

    roots, _ = linked_groups(postings, verify, bags.where("lead").select("node", *_SKETCH), close)
    named = classes.join(roots, "node", "left").select("n", "a", "b", F.coalesce("root", "node").alias("component_id"))
    hot = sets.alias("s").join(named.alias("c"), ["n", "a", "b"], "left")
    known = hot.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    missing = slim.where(F.col("doc_id").isNull())
    return known.union(missing.mapInArrow(_counts(size), "doc_id long, n_shingles long, component_id long"))


def _counts(size: int):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                _, count = shingle_sets(piece.column("text"), size)
                none = pa.nulls(len(count), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(count.astype(np.int64)), none], names=["doc_id", "n_shingles", "component_id"])

    return run
