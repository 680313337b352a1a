"""Packing: length buckets that waste the least padding, and token-budget batches inside each bucket.

The global histogram of lengths goes through a dynamic programme that chooses the bucket bounds with the least
padding in total; batches of at most ``budget`` padded tokens are then cut inside each bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmeter.llm.mixing import word_count
from gistmeter.session import materialize

#: Documents of a bucket that are ordered together.
SHARD = 20_000


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int, apart: int | None = None) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least ``sum(count * (bound - length))``.

    ``lengths`` ascend. ``cost[j]`` after k rounds is the least padded total of the first j lengths in k
    buckets; the padding differs from it by the sum of all lengths, which no choice changes. Two or more buckets
    never hold lengths on both sides of ``apart`` (the longest that stays on the lower side).
    """
    size = len(lengths)
    if size == 0:
        return []
    before = np.concatenate([[0], np.cumsum(counts.astype(np.float64))])
    lengths_f = lengths.astype(np.float64)
    last = -1 if apart is None or buckets < 2 else int(np.searchsorted(lengths, apart, "right")) - 1
    # padded[i, j]: lengths i..j in one bucket, padded to lengths[j]
    cost = lengths_f * before[1:]
    if last >= 0:
        cost[last + 1 :] = np.inf
    back = [np.zeros(size, np.int64)]
    for _ in range(1, min(buckets, size)):
        option, at = _best_cuts(cost, lengths_f, before[1:], last)
        better = option < cost
        back.append(np.where(better, at, -1))
        cost = np.where(better, option, cost)
    bounds, j, k = [], size - 1, len(back) - 1
    while j >= 0:
        bounds.append(int(lengths[j]))
        while k > 0 and back[k][j] < 0:
            k -= 1
        if k == 0:
            break
        j, k = int(back[k][j]), k - 1
    return bounds[::-1]


def _best_cuts(cost: np.ndarray, lengths: np.ndarray, until: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """For each j the least ``cost[i] + lengths[j] * (until[j] - until[i])`` over i < j, and the smallest such i.

    The best i never falls as j grows, so the middle of a range bounds the search of both halves. All ranges of a
    level are searched at once: n log n steps in all. An i below ``last`` does not serve a j above it.
    """
    size = len(cost)
    least, where = np.full(size, np.inf), np.full(size, -1, np.int64)
    low, high = np.array([1]), np.array([size - 1])
    first, final = np.array([0]), np.array([size - 1])
    while len(low):
        middle = (low + high) // 2
        start = np.where((middle > last) & (last >= 0), np.maximum(first, last), first)
        count = np.minimum(final, middle - 1) - start + 1
        at = np.cumsum(count) - count
        i = np.arange(int(count.sum())) + np.repeat(start - at, count)
        j = np.repeat(middle, count)
        option = cost[i] + lengths[j] * (until[j] - until[i])
        best = np.minimum.reduceat(option, at)
        hits = np.flatnonzero(option == np.repeat(best, count))
        chosen = i[hits[np.searchsorted(hits, at)]]
        least[middle], where[middle] = best, chosen
        low, high = np.concatenate([low, middle + 1]), np.concatenate([middle - 1, high])
        first, final = np.concatenate([first, chosen]), np.concatenate([chosen, final])
        some = low <= high
        low, high, first, final = low[some], high[some], first[some], final[some]
    return least, where


def pack(docs: DataFrame, buckets: int = 16, budget: int = 65_536, seed: int = 23, length: Column | None = None) -> DataFrame:
    """``doc_id, length, bucket, padded_length, shard, batch, slot, batch_docs, over_budget`` for every row of ``docs``.

    ``length`` defaults to the number of words. A batch is ``bucket, batch``: at most
    ``budget // padded_length`` documents, and only the last of a bucket has fewer; ``shard`` numbers the runs of
    about ``SHARD`` documents in which its batches start; one longer than the budget has a batch to itself and
    ``over_budget``. Null and empty texts have length 0 and are packed like others (padded length at least 1).
    Repeated rows, ties and null ids are packed row by row, in a seeded order. Only ``doc_id`` and ``text`` are
    read; an empty table gives an empty result. With two buckets or more a document that fits is never padded beyond
    the budget. The driver sees one row per distinct length: n of them take more than n * n / 2 words of text.
    """
    size = word_count(F.col("text").cast("string")) if length is None else length
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.cast("long").alias("length"))
    rows = materialize(rows, "sized").withColumn("_least", F.greatest(F.col("length"), F.lit(1)))
    histogram = rows.groupBy("_least").agg(F.count(F.lit(1)).alias("n")).toArrow()
    lengths, counts = (histogram.column(c).to_numpy() for c in ("_least", "n"))
    order = np.argsort(lengths)
    lengths, counts = lengths[order], counts[order]
    bounds = best_bounds(lengths, counts, buckets, budget)
    if not bounds:
        bounds = [1]
    held = np.bincount(np.searchsorted(bounds, lengths), counts, len(bounds)) if len(lengths) else [0]
    shards = [max(1, -(-int(n) // SHARD)) for n in held]
    number = F.lit(len(bounds) - 1)
    for k in range(len(bounds) - 2, -1, -1):
        number = F.when(F.col("_least") <= bounds[k], k).otherwise(number)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("bucket") + 1)
    digest = F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), "length")
    placed = (
        rows.withColumn("bucket", number.cast("int"))
        .withColumn("padded_length", pick(bounds).cast("long"))
        .withColumn("_digest", digest)
        .withColumn("_part", F.pmod("_digest", pick(shards)).cast("int"))
    )
    # Parts are ordered each in a task; the sizes of the earlier ones continue their numbers through the bucket.
    parts = materialize(placed.groupBy("bucket", "_part").agg(F.count(F.lit(1)).alias("_rows")), "parts")
    earlier = Window.partitionBy("bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    order = Window.partitionBy("bucket", "_part").orderBy("_digest", "doc_id", "length")
    fits = F.greatest(F.floor(F.lit(budget) / F.col("padded_length")), F.lit(1)).cast("long")
    ranked = placed.withColumn("_fits", fits).withColumn("_within", F.row_number().over(order) - 1)
    numbered = ranked.join(parts.drop("_rows"), ["bucket", "_part"]).withColumn("_row", F.col("_before") + F.col("_within"))
    batch = F.floor(F.col("_row") / F.col("_fits")).cast("long")
    return numbered.select(
        "doc_id",
        "length",
        "bucket",
        "padded_length",
        F.floor(batch * F.col("_fits") / SHARD).cast("int").alias("shard"),
        batch.alias("batch"),
        F.pmod("_row", "_fits").cast("int").alias("slot"),
        F.least(F.col("_fits"), pick([int(n) for n in held]) - batch * F.col("_fits")).cast("long").alias("batch_docs"),
        (F.col("padded_length") > budget).alias("over_budget"),
    )
