"""Substring dedup: seed on winnowed anchors, extend both ways, keep the maximal repeats.

An anchor is the smallest 5-word fingerprint of 9 consecutive ones (the last of equals), so every run of 13 words
holds an anchor at a place that its words alone decide (Schleimer et al., 2003).

1. Seeds: documents meet on anchors. Each learns which of its anchors another document has too.
2. Extension: around a shared anchor the 13-word windows that chose it reach from 0 to 8 words to its left and the
   rest to its right. An occurrence in a smaller document that agrees on such a window extends the seed to the
   threshold. What two documents share beyond it is reached from the next anchor, so the windows that follow
   each other make up the maximal repeats of 13 words or more.
3. The words of the repeats are removed.

Tasks settle among themselves what their own documents share and send one occurrence of each anchor or window
for all of them, so a passage in very many documents does not meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmeter.llm.ngram_join import _PARTS_DDL, _by_fragments, _cut, dealt
from gistmeter.llm.shared import Words, flat, id_values, lists, only, partitions_of, pieces, shard_column, shard_of, signed, text_of, windows, without
from gistmeter.session import materialize

ANCHOR = 5
HELD = 2_000_000


def anchors(words: Words, size: int, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, text and anchor fingerprint of every window of ``size`` words, and the word fingerprints."""
    prints, of_word = words.fingerprints(), text_of(words.count)
    total = len(prints) - size + 1
    if total <= 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), prints
    grams = windows(prints, anchor)
    best = grams[:total].copy()
    for k in range(1, size - anchor + 1):
        np.minimum(best, grams[k : k + total], out=best)
    start = np.flatnonzero(of_word[:total] == of_word[size - 1 :])
    return start, of_word[start], best[start], prints


def _answers(docs: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """Values by document, as one row for each."""
    order = np.argsort(docs, kind="stable")
    docs, values = docs[order], values[order]
    first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])) if len(docs) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(docs[first]), lists(values, np.diff(np.append(first, len(docs))))], names=["doc_id", "found"])


def _seeds(size: int, bits: int, parts: int):
    def flush(docs, values):
        docs, values = np.concatenate(docs), np.concatenate(values)
        order = np.lexsort((docs, values))
        docs, values = docs[order], values[order]
        fresh = np.ones(len(docs), bool)
        fresh[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
        docs, values = docs[fresh], values[fresh]
        same = np.zeros(len(values) + 1, bool)
        same[1:-1] = values[1:] == values[:-1]
        shared = same[1:] | same[:-1]
        known = _answers(docs[shared], (values[shared] >> np.uint64(32 - bits)).astype(np.int64))
        for k in range(0, known.num_rows, 20_000):
            part = known.slice(k, 20_000)
            empty = lists(np.zeros(0, np.int64), np.zeros(part.num_rows, np.int64))
            none = empty.cast(pa.list_(pa.int32()))
            one = lists(part.column("doc_id").to_numpy(), np.ones(part.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, -1, np.int32)), none, one, none, none, none, part.column("found"), empty], names=["part", "inner", "docs", "counts", "items", "seen", "a", "b"])
        ids, of_item = np.unique(docs[~shared], return_inverse=True)
        yield from _cut(ids, of_item, values[~shared], values[shared & ~same[:-1]], bits, parts)

    def run(batches):
        docs, values, held = [], [], 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = Words(piece.column("text"))
                start, text, best, _ = anchors(words, size)
                change = np.ones(len(start), bool)
                change[1:] = (best[1:] != best[:-1]) | (text[1:] != text[:-1])
                docs.append(id_values(piece.column("doc_id"))[text[change]])
                values.append(best[change])
                held += len(values[-1])
                if held > HELD:
                    yield from flush(docs, values)
                    docs, values, held = [], [], 0
        if held:
            yield from flush(docs, values)

    return run


def _by_shard(docs: np.ndarray, values: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """A row for each shard (``shard_of``) with documents and values side by side."""
    shard = shard_of(docs, shards)
    order = np.argsort(shard, kind="stable")
    docs, values, shard = docs[order], values[order], shard[order]
    first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(docs) else np.zeros(0, np.int64)
    per = np.diff(np.append(first, len(docs)))
    for k in range(0, len(first), 256):
        a, b = first[k], first[k] + int(per[k : k + 256].sum())
        yield pa.RecordBatch.from_arrays([pa.array(shard[first[k : k + 256]]), lists(docs[a:b], per[k : k + 256]), lists(values[a:b], per[k : k + 256])], names=["shard", "docs", "keys"])


def _merged(batches):
    """``doc_id, found`` from rows sorted by shard: what all tasks have told of each document, once."""

    def told(docs, keys):
        out = _answers(np.concatenate(docs), np.concatenate(keys))
        for k in range(0, out.num_rows, 20_000):
            yield out.slice(k, 20_000)

    docs, keys, last = [], [], None
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)] if len(shard) else [0]
        for start, stop in zip(cuts[:-1], cuts[1:]):
            if docs and shard[start] != last:
                yield from told(docs, keys)
                docs, keys = [], []
            part, last = batch.slice(start, stop - start), shard[start]
            docs.append(flat(part.column("docs"), np.int64)[0])
            keys.append(flat(part.column("keys"), np.int64)[0])
    if docs:
        yield from told(docs, keys)


def _shared_seeds(shards: int):
    """By shard, documents with the keys of those of their anchors that other documents have."""
    return lambda batches: _seed_answers(batches, shards)


def _seed_answers(batches, shards: int):
    def answer(keys, owners, seen):
        both = np.concatenate([keys, seen])
        order = np.argsort(both)
        value = both[order]
        same = np.zeros(len(value) + 1, bool)
        same[1:-1] = value[1:] == value[:-1]
        shared = order[same[1:] | same[:-1]]
        shared = shared[shared < len(keys)]
        yield from _by_shard(owners[shared], keys[shared], shards)

    known = []

    def fragments():
        for batch in batches:
            kind = batch.column("part").to_numpy()
            settled = batch.filter(pa.array(kind < 0))
            if settled.num_rows:
                docs, _ = flat(settled.column("docs"), np.int64)
                values, counts = flat(settled.column("a"), np.int64)
                known.extend(_by_shard(np.repeat(docs, counts), values, shards))
            rest = batch.filter(pa.array(kind >= 0))
            if rest.num_rows:
                yield rest

    for out in _by_fragments(fragments(), answer):
        yield from known
        known.clear()
        yield out
    yield from known


def _extensions(size: int, bits: int, parts: int):
    """Windows around shared anchors: settled repeats of this task (part -1), and a row for each task that reads the rest."""

    def row(part, docs, places, values, per):
        return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), lists(docs, per), lists(places.astype(np.int32), per), lists(signed(values), per)], names=["part", "docs", "places", "items"])

    def flush(docs, places, values):
        docs, places, values = np.concatenate(docs), np.concatenate(places), np.concatenate(values)
        order = np.lexsort((docs, values))
        docs, places, values = docs[order], places[order], values[order]
        first = np.ones(len(values), bool)
        first[1:] = values[1:] != values[:-1]
        owner = docs[np.maximum.accumulate(np.where(first, np.arange(len(values)), 0))]
        later = owner < docs
        if later.any():
            found = _answers(docs[later], places[later])
            per = pc.list_value_length(found.column("found")).to_numpy(zero_copy_only=False)
            for k in range(0, found.num_rows, 20_000):
                part, n = found.slice(k, 20_000), len(per[k : k + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1, np.int32)), lists(part.column("doc_id").to_numpy(), np.ones(n, np.int64)), part.column("found").cast(pa.list_(pa.int32())), lists(np.zeros(0, np.int64), np.zeros(n, np.int64))], names=["part", "docs", "places", "items"])
        docs, places, values = docs[~later], places[~later], values[~later]
        # Values ascend, so what a task reads is a run.
        full, begin = np.unique(((values >> np.uint64(64 - bits)).astype(np.int64) * parts) >> bits, return_index=True)
        ends = np.append(begin[1:], len(values))
        for k in range(0, len(full), 256):
            a, b = begin[k], ends[min(k + 256, len(full)) - 1]
            yield row(full[k : k + 256], docs[a:b], places[a:b], values[a:b], (ends - begin)[k : k + 256])

    def seeded(batches):
        """Texts, each with its shard's seeds, sorted by document; a shard's seeds come before its texts."""
        shard, docs, keys, sorted_ = None, [], [], None
        for batch in batches:
            number = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1), len(number)]
            for start, stop in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(start, stop - start)
                if part.num_rows == 0:
                    continue
                if number[start] != shard:
                    shard, docs, keys, sorted_ = number[start], [], [], None
                is_seed = part.column("docs").is_valid()
                told = part.filter(is_seed)
                if told.num_rows:
                    docs.append(flat(told.column("docs"), np.int64)[0])
                    keys.append(flat(told.column("keys"), np.int64)[0])
                texts = part.filter(pc.invert(is_seed))
                if texts.num_rows and docs:
                    if sorted_ is None:
                        all_docs, all_keys = np.concatenate(docs), np.concatenate(keys)
                        order = np.argsort(all_docs, kind="stable")
                        sorted_ = all_docs[order], all_keys[order]
                    for piece in pieces(texts, "text"):
                        yield piece, *sorted_

    def run(batches):
        held, kept = 0, [[], [], []]
        for piece, seed_docs, seed_keys in seeded(batches):
            ids = id_values(piece.column("doc_id"))
            low, high = np.searchsorted(seed_docs, ids), np.searchsorted(seed_docs, ids, "right")
            some = np.flatnonzero(high > low)
            if not len(some):
                continue
            piece, ids, count = piece.take(pa.array(some)), ids[some], (high - low)[some]
            seeds = seed_keys[np.repeat(low[some] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
            words = Words(piece.column("text"))
            start, text, best, prints = anchors(words, size)
            # A window is looked at if (text, key of its anchor) is among the text's seeds.
            key = (best >> np.uint64(32 - bits)).astype(np.int64)
            both_key, both_text = np.concatenate([seeds, key]), np.concatenate([text_of(count), text])
            order = np.lexsort((both_key, both_text))
            k, t = both_key[order], both_text[order]
            group = np.cumsum(np.append(True, (k[1:] != k[:-1]) | (t[1:] != t[:-1]))) - 1 if len(k) else np.zeros(0, np.int64)
            wanted = np.zeros(group[-1] + 1 if len(group) else 0, bool)
            wanted[group[order < len(seeds)]] = True
            hit = np.zeros(len(both_key), bool)
            hit[order] = wanted[group]
            hit = hit[len(seeds) :]
            grams = windows(prints, size)
            for to, x in zip(kept, (ids[text[hit]], start[hit] - words.of_text[text[hit]], grams[start[hit]])):
                to.append(x)
            held += int(hit.sum())
            if held > HELD:
                yield from flush(*kept)
                held, kept = 0, [[], [], []]
        if held:
            yield from flush(*kept)

    return run


def _repeats(shards: int):
    """By shard, documents with the places of those of their windows that a smaller document has."""
    return lambda batches: _later_windows(batches, shards)


def _later_windows(batches, shards: int):
    def answer(docs, places, values):
        order = np.lexsort((docs, values))
        docs, places, values = docs[order], places[order], values[order]
        first = np.ones(len(values), bool)
        first[1:] = values[1:] != values[:-1]
        owner = docs[np.maximum.accumulate(np.where(first, np.arange(len(values)), 0))]
        later = owner < docs
        yield from _by_shard(docs[later], places[later].astype(np.int64), shards)

    def told(docs, places):
        if docs:
            yield from _by_shard(np.concatenate(docs), np.concatenate(places).astype(np.int64), shards)

    def answers(rows):
        """About ``HELD`` windows at a time: ranges of the values, which ascend in every row."""
        count = -(-sum(len(r[2]) for r in rows) // HELD)
        low, high = min(int(r[2][0]) for r in rows), max(int(r[2][-1]) for r in rows)
        cuts = [low + (high - low) * k // count for k in range(1, count)]
        at = [np.concatenate([[0], np.searchsorted(r[2], np.array(cuts, np.uint64)), [len(r[2])]]).astype(np.int64) for r in rows]
        for k in range(count):
            yield from answer(*(np.concatenate([r[c][e[k] : e[k + 1]] for r, e in zip(rows, at)]) for c in range(3)))

    # What tasks have settled among their own documents comes first and travels along.
    rows, last, held, docs, places = [], None, 0, [], []
    for batch in batches:
        part = batch.column("part").to_numpy()
        settled = batch.filter(pa.array(part < 0))
        if settled.num_rows:
            own, _ = flat(settled.column("docs"), np.int64)
            found, counts = flat(settled.column("places"), np.int64)
            docs.append(np.repeat(own, counts))
            places.append(found)
            held += len(found)
            if held > HELD:
                yield from told(docs, places)
                held, docs, places = 0, [], []
        for k in np.flatnonzero(part >= 0):
            if rows and part[k] != last:
                yield from answers(rows)
                rows = []
            one, last = batch.slice(int(k), 1), part[k]
            rows.append((flat(one.column("docs"), np.int64)[0], flat(one.column("places"), np.int32)[0], flat(one.column("items"), np.int64)[0].view(np.uint64)))
    if rows:
        yield from answers(rows)
    yield from told(docs, places)


def _strip(size: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            found = batch.column("found") if "found" in batch.schema.names else None
            kept, n_words, n_removed = [], [], []
            for k, text in enumerate(texts):
                words = (text.as_py() or b"").split()
                total = len(words)
                places = found[k].values if found is not None and found[k].is_valid else None
                if places is not None and len(places):
                    at = places.to_numpy(zero_copy_only=False)
                    depth = np.zeros(total + 1, np.int64)
                    np.add.at(depth, at, 1)
                    np.add.at(depth, at + size, -1)
                    covered = np.cumsum(depth[:-1]) > 0
                    words = [w for w, c in zip(words, covered.tolist()) if not c]
                kept.append(b" ".join(words))
                n_words.append(total)
                n_removed.append(total - len(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def repeated_windows(docs: DataFrame, size: int = 13) -> DataFrame:
    """``doc_id, found``: for each id the starts of its windows of ``size`` words that a smaller id has too."""
    parts = partitions_of(docs)
    bits = int(np.clip(np.ceil(np.log2(parts * 8)), 6, 20))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    sent = slim.mapInArrow(_seeds(size, bits, parts), _PARTS_DDL)
    # One shard for each task that reads them: more would only multiply the rows that tell of them.
    seeds = dealt(sent, parts).mapInArrow(_shared_seeds(parts), "shard long, docs array<long>, keys array<long>")
    texts = slim.withColumn("shard", shard_column("doc_id", parts))
    both = seeds.unionByName(texts, allowMissingColumns=True).repartitionById(parts, F.col("shard").cast("int"))
    seeded = both.sortWithinPartitions("shard", F.col("docs").isNull())
    windows_of = seeded.mapInArrow(_extensions(size, bits, parts), "part int, docs array<long>, places array<int>, items array<long>")
    found = dealt(windows_of, parts).mapInArrow(_repeats(parts), "shard long, docs array<long>, keys array<long>")
    return found.repartitionById(parts, F.col("shard").cast("int")).sortWithinPartitions("shard").mapInArrow(_merged, "doc_id long, found array<long>")


def strip_repeats(docs: DataFrame, size: int = 13) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row of ``docs``; ``kept`` is what is left, one space between words.

    A word goes if a window of ``size`` (at least 13) consecutive words covers it whose word sequence also starts in
    a document with a smaller id; windows are judged on the input. Nothing is removed for repeats inside one
    document, in null or empty texts, in texts under ``size`` words, or in rows with a null id (which remove nothing
    either). Rows that repeat an id count as one document. Other columns are not read; an empty table gives an
    empty result.
    """
    if size < 13:
        raise ValueError("anchors are 5 words in windows of at least 13")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialize(repeated_windows(docs, size), "repeats")
    ddl = "doc_id long, n_words long, n_removed long, kept string"
    touched = only(slim, found, "doc_id").join(found, "doc_id").select("doc_id", "text", "found").mapInArrow(_strip(size), ddl)
    return without(slim, found, "doc_id").mapInArrow(_strip(size), ddl).union(touched)
