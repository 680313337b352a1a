"""Periodic runs of words by Kruskal over descending LCPs.

A run is a stretch of words with smallest period q that cannot be made longer. Its suffixes at i and i + q share all
words up to its end, so they are found where suffixes are united:

1. Suffixes of all texts of a batch are ordered by prefix doubling (Larsson and Sadakane, 2007): ranks by 1, 2, 4, ...
   words, in which only groups of equal ranks are sorted again. The ranks of each step also give the LCP of any two
   suffixes, exactly.
2. Kruskal: suffixes next to each other in the order are united by decreasing LCP, with union-find. Every class keeps
   its positions in order, and the smaller class is put into the larger. When two positions become neighbours at a
   distance d of at most their LCP (divided by the exponent less one), they seed a run: from the first to the LCP's
   end behind the second, with smallest period d. The start of a run always is such a seed, so the run of a
   period and an end starts at the first of its seeds.

Words are 64-bit fingerprints. Classes without a short enough distance for their longest LCP are left out before,
and classes of two positions are settled without a set.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmeter.functions.lets import let
from gistmeter.llm.shared import PIECE, WORD, Words, lists, mixed, pieces, text_of

#: Positions in a block of an ordered set.
BLOCK = 1024
FAR = 1 << 62


class Positions:
    """A set of positions in order, in blocks so that putting one in moves few others."""

    __slots__ = ("blocks", "heads", "size")

    def __init__(self, items: list[int]):
        self.blocks, self.heads, self.size = [items], [items[0]], len(items)

    def around(self, x: int) -> tuple[int, int]:
        """The neighbours of ``x``, which is not in the set."""
        k = bisect_left(self.heads, x) - 1
        if k < 0:
            return -FAR, self.heads[0]
        block = self.blocks[k]
        j = bisect_left(block, x)
        if j < len(block):
            return block[j - 1], block[j]
        return block[j - 1], self.heads[k + 1] if k + 1 < len(self.heads) else FAR

    def add(self, x: int) -> None:
        k = max(bisect_left(self.heads, x) - 1, 0)
        block = self.blocks[k]
        block.insert(bisect_left(block, x), x)
        self.heads[k] = block[0]
        self.size += 1
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks.insert(k + 1, block[half:])
            self.heads.insert(k + 1, block[half])
            del block[half:]

    def __iter__(self):
        for block in self.blocks:
            yield from block


def suffix_order(first: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes side by side in the order that share at least ``least`` words.

    ``first`` is a number for each word (equal only within one text), ``ends`` where its text ends. Returns an array
    of three rows (position, next position in the order, LCP), and each column's place in the order.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    value = first[order]
    head = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(head, n))
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(head, size)
    slots = np.flatnonzero(np.repeat(size, size) > 1)
    shared_slots = slots
    levels, step = [rank], 1
    while len(slots):
        active = order[slots]
        after = active + step
        second = np.where(after < ends[active], rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
        key = rank[active].astype(np.int64) * (n + 1) + second
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        order[slots] = active
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(head, len(key)))
        rank = rank.copy()
        rank[active] = np.repeat(slots[head], size)
        levels.append(rank)
        slots = slots[np.repeat(size, size) > 1]
        step *= 2
    # Side by side in the order, with as many words in common as the ranks up to ``least`` can tell.
    at = shared_slots[:-1][np.diff(shared_slots) == 1] if len(shared_slots) else shared_slots
    for k in range(min(least.bit_length(), len(levels))):
        at = at[levels[k][order[at]] == levels[k][order[at + 1]]]
    a, b = order[at], order[at + 1]
    lcp = np.zeros(len(at), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        i, j = a + lcp, b + lcp
        inside = (i < ends[a]) & (j < ends[b])
        inside[inside] = levels[level][i[inside]] == levels[level][j[inside]]
        lcp[inside] += 1 << level
    enough = lcp >= least
    return np.stack([a, b, lcp])[:, enough], at[enough]


def least_lcp(exponent: int, shortest: int) -> int:
    """The least LCP at which a run can be seeded: its length less its period."""
    return min(max(shortest - q, (exponent - 1) * q) for q in range(1, max(shortest, 1) + 1))


def kruskal(edges: np.ndarray, at: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds ``position, distance, lcp`` from suffixes side by side in the order (``suffix_order``)."""
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none
    a, b, lcp = edges
    # Edges next to each other join one class in the end.
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    size = np.diff(np.append(first, len(at)))
    chain = np.repeat(np.arange(len(first)), size)
    members = np.concatenate([a, b[np.append(first[1:] - 1, len(at) - 1)]])
    of = np.concatenate([chain, np.arange(len(first))])
    order = np.lexsort((members, of))
    members, of = members[order], of[order]
    gap = np.where(of[1:] == of[:-1], members[1:] - members[:-1], FAR)
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    closest = np.minimum.reduceat(np.append(gap, FAR), starts)
    wanted = closest <= np.maximum.reduceat(lcp, first) // (exponent - 1)
    pair = wanted & (size == 1)
    e = first[pair]
    found = [np.minimum(a[e], b[e])], [np.abs(a[e] - b[e])], [lcp[e]]
    rest = np.repeat(wanted & (size > 1), size)
    a, b, lcp = a[rest], b[rest], lcp[rest]
    if len(a):
        for to, x in zip(found, _united(a, b, lcp, exponent)):
            to.append(x)
    return tuple(np.concatenate(x) for x in found)


def _united(a: np.ndarray, b: np.ndarray, lcp: np.ndarray, exponent: int):
    order = np.argsort(-lcp, kind="stable")
    nodes, at = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    one, two = at[: len(a)].tolist(), at[len(a) :].tolist()
    positions = nodes.tolist()
    parent = list(range(len(positions)))
    members: list[Positions | None] = [None] * len(positions)
    where, distance, shared = [], [], []
    for u, v, common in zip(one, two, lcp[order].tolist()):
        while parent[u] != u:
            parent[u] = parent[parent[u]]
            u = parent[u]
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        reach = common // (exponent - 1)
        large, small = members[u], members[v]
        if (large.size if large else 1) < (small.size if small else 1):
            u, v, large, small = v, u, small, large
        parent[v] = u
        if large is None:
            x, y = sorted((positions[u], positions[v]))
            members[u] = Positions([x, y])
            if y - x <= reach:
                where.append(x)
                distance.append(y - x)
                shared.append(common)
            continue
        items = [positions[v]] if small is None else list(small)
        members[v] = None
        last, ahead = -FAR, len(items)
        neighbours = [large.around(x) for x in items]
        for k, x in enumerate(items):
            before, after = neighbours[k]
            if before > last and x - before <= reach:
                where.append(before)
                distance.append(x - before)
                shared.append(common)
            if after - x <= reach and (k + 1 == ahead or items[k + 1] > after):
                where.append(x)
                distance.append(after - x)
                shared.append(common)
            last = x
        for x in items:
            large.add(x)
    return np.array(where, np.int64), np.array(distance, np.int64), np.array(shared, np.int64)


def runs_of(words: Words, exponent: int, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start (word of the text), length and period of every run, in this order."""
    text = text_of(words.count)
    first = mixed(words.fingerprints() ^ mixed(text.astype(np.uint64)))
    edges, at = suffix_order(first, words.of_text[text + 1] if len(text) else text, least_lcp(exponent, shortest))
    position, period, lcp = kruskal(edges, at, exponent)
    end = position + period + lcp
    order = np.lexsort((position, period, end))
    position, period, end = position[order], period[order], end[order]
    fresh = np.append(True, (period[1:] != period[:-1]) | (end[1:] != end[:-1]))[: len(position)]
    position, period, end = position[fresh], period[fresh], end[fresh]
    length = end - position
    long = length >= np.maximum(shortest, exponent * period)
    position, period, length = position[long], period[long], length[long]
    of = text[position]
    order = np.lexsort((period, position))
    return of[order], (position - words.of_text[of])[order], length[order], period[order]


def collapsed_words(words: Words, of: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> pa.Array:
    """The words of every text without those that a run repeats, with one space between them."""
    depth = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(depth, words.of_text[of] + start + period, 1)
    np.add.at(depth, words.of_text[of] + start + length, -1)
    kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
    size = words.ends[kept] - words.starts[kept] + 1  # with a space behind
    total = np.concatenate([[0], np.cumsum(size)])
    source = np.repeat(words.starts[kept] - total[:-1], size) + np.arange(total[-1])
    out = words.data[np.minimum(source, max(len(words.data) - 1, 0))]
    out[total[1:] - 1] = 0x20
    # The last space of a text goes.
    edges = np.searchsorted(kept, words.of_text)
    last = total[edges[1:][np.diff(edges) > 0]] - 1
    keep = np.ones(len(out), bool)
    keep[last] = False
    bounds = np.concatenate([[0], np.cumsum(keep)])[total[edges]]
    text = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(out[keep])))
    return text.cast(pa.string())


def periodic_runs(docs: DataFrame, exponent: int = 4, shortest: int = 6, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` replaced by ``n_words``, ``runs`` and ``collapsed``.

    ``runs`` are the stretches of words with smallest period q and a length of at least ``max(shortest, exponent * q)``
    (``exponent`` 2 or more) that no neighbouring word extends with that period: structs of start (word number), length
    and period, by start and period. ``collapsed`` is the text without the words a run repeats, all behind its first q
    words, with one space between words. A null text, or one without words, has no runs and collapses to the empty
    text. Texts are looked at whole and alone, so rows may repeat; their ties are settled by position. Other columns are
    kept as they are (a column named like a result is replaced), and an empty table gives an empty result. Working
    memory is about 100 bytes for each word and doubling of the longest repeat.
    """
    if exponent < 2:
        raise ValueError("an exponent of at least 2")
    added = ("n_words", "runs", "collapsed")
    kept = docs.select(*(c for c in docs.columns if c not in added), *([] if text not in added else [text]))
    other = [c for c in kept.columns if c != text]
    fields = ", ".join([*(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in other), "n_words long", "runs array<struct<start:long,length:long,period:long>>", "collapsed string"])

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, text, PIECE):
                words = Words(piece.column(text))
                of, start, length, period = runs_of(words, exponent, shortest)
                struct = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], names=["start", "length", "period"])
                offsets = np.searchsorted(of, np.arange(piece.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in other), pa.array(words.count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), struct), collapsed_words(words, of, start, length, period)],
                    names=[*other, *added],
                )

    return kept.withColumn(text, kept[text].cast("string")).mapInArrow(run, fields)


def looped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` in which every tenth text, by the crc32 of its id, repeats a stretch of its words to its end.

    With h the crc32 of the decimal id and g = floor(h / 10), texts of n > 0 words with h % 10 = 0 have in place of each
    word i >= a the word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)), with one space
    between words. Rows with a null id, null texts and texts without words stay as they are.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def loop(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        body = F.slice(words, (a + 1).cast("int"), p.cast("int"))
        tail = F.slice(F.flatten(F.array_repeat(body, (3 + g % 8 + 1).cast("int"))), F.lit(1), (n - a).cast("int"))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " "))

    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    changed = F.when(h % 10 == 0, let(words, loop))
    return docs.withColumn(text, F.coalesce(changed, F.col(text)))
