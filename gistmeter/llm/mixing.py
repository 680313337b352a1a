"""Mixing sources to target weights: counts by exact length, bounded knapsack for the rest of a budget.

For each source the documents are counted by length. A share of every length is taken first, then a descending
fill brings the remaining budget to about half of ``cells``, and a bounded-knapsack reachability table over all of
that remainder says how many documents of which length close it. If none do, a wider remainder is left and tried.
Only (source, length, count) rows meet; the documents themselves are then picked by a seeded digest, as many per
source and length as the table says.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmeter.llm.shared import WORD
from gistmeter.session import materialize

#: Words of remaining budget that the knapsack table has room for at first.
CELLS = 1 << 16
#: The widest table has room for ``FEW`` of the longest text of a source, and for up to ``MANY`` within ``WIDE`` cells.
FEW, MANY, WIDE = 8, 64, 1 << 25
#: Documents of one source and length that one task orders at a time.
SHARD = 2000


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``source, source_size, weight, target`` from one row per source with its ``source_size``.

    Sources by code point, null last, weigh ``weights``, repeating. The budget, ``share`` times all sizes, is
    dealt by weight; no target exceeds ``most`` times its source, and the excess goes to the others by weight
    until none is above. In order of cap per weight the capped sources come first, so the level of the others
    follows from running sums. The windows see one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weigh = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weigh).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    rising = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # A source is capped if the level reckoned without the sources before it lies above its cap.
    staged = weighed.withColumn("_level", level).withColumn("_free", F.col("_cap") > F.col("weight") * F.col("_level"))
    common = F.min(F.when(F.col("_free"), F.struct(F.col("_cap") / F.col("weight"), F.col("source").isNull(), "source", "_level"))).over(everything)
    return staged.select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("_free"), F.col("weight") * common["_level"]).otherwise(F.col("_cap")).alias("target"),
    )


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, cells: int = CELLS) -> np.ndarray:
    """How many documents of each length to take, so that their words come as near to ``budget`` as they can.

    Never above ``budget``. A remainder that cannot be closed is tried again with less of every length taken before,
    up to a table for many of the longest text: budgets up to half of that get the nearest there is.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    longest = int(lengths.max())
    widest = max(cells, FEW * longest, min(MANY * longest, WIDE))
    best, reached, room = np.zeros_like(counts), -1, cells
    while reached < budget:
        taken = _closed(lengths, counts, budget, room // 2)
        if int((lengths * taken).sum()) > reached:
            best, reached = taken, int((lengths * taken).sum())
        if room >= min(widest, 2 * budget + 1):
            break
        room = min(8 * room, widest)
    return best


def _closed(lengths: np.ndarray, counts: np.ndarray, budget: int, half: int) -> np.ndarray:
    """A share and the fill down to about ``half``, and what comes nearest to the whole remainder."""
    total = int((lengths * counts).sum())
    part = max(0.0, (budget - half) / total)
    taken = np.floor(counts * part).astype(np.int64)
    left = budget - int((lengths * taken).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        if left <= half:
            break
        more = min(int(counts[i] - taken[i]), (left - half) // int(lengths[i])) if lengths[i] else 0
        taken[i] += max(more, 0)
        left -= max(more, 0) * int(lengths[i])
    # Bit w of reach: w words can be reached; first[w]: the piece that reached them first. Copies of a length come
    # as pieces of 1, 2, 4, ... of them, so that every number up to the room is a sum of pieces.
    reach, all_bits = 1, (1 << (left + 1)) - 1
    first, pieces = np.full(left + 1, -1, np.int32), []
    for i in order:
        room, step = int(counts[i] - taken[i]), 1
        if not 0 < lengths[i] <= left:
            continue
        room = min(room, left // int(lengths[i]))
        while room > 0 and not reach >> left:
            many = min(step, room)
            fresh = (reach << (many * int(lengths[i]))) & all_bits & ~reach
            if fresh:
                bits = np.frombuffer(fresh.to_bytes(left // 8 + 1, "little"), np.uint8)
                first[np.unpackbits(bits, count=left + 1, bitorder="little").view(bool)] = len(pieces)
                pieces.append((i, many))
                reach |= fresh
            room, step = room - many, step * 2
    at = reach.bit_length() - 1
    while at:
        i, many = pieces[first[at]]
        taken[i] += many
        at -= many * int(lengths[i])
    return taken


def _plan(cells: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lengths, counts = frame["size"].to_numpy(), frame["n"].to_numpy()
        budget = int(round(float(frame["target"].iloc[0])))
        whole, rest = divmod(budget, max(int(frame["source_size"].iloc[0]), 1))
        return frame[["source", "size", "n"]].assign(copies=whole, more=fit(lengths, counts, rest, cells))

    return run


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    cells: int = CELLS,
    row: str | None = None,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, times, taken``: how often the mix takes each document.

    ``times`` is 0, 1 or 2 with the default ``most`` of 2; ``taken`` is ``times * size``. Null and empty texts
    have size 0 and are taken as often as all documents of their source are. Null sources form a source of
    their own; a null id is like any other value. Ties in the seeded order (repeated rows) are cut by id and
    then freely among rows that are equal anyway, unless ``row`` names a column of numbers that tell rows apart: it
    cuts these ties, spreads null ids over the order, and is returned too. Only ``doc_id, text, source`` and that
    column are read. An empty table gives an empty result. Two runs agree.
    """
    number = [] if row is None else [F.col(row).cast("long").alias("_row")]
    sized = materialize(docs.select(*number, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size")), "sized")
    counts = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = materialize(targets(sizes, weights, share, most), "targets")
    cells_of = counts.join(goal, counts["source"].eqNullSafe(goal["source"])).select(counts["source"], "size", "n", "source_size", "target")
    plan = cells_of.groupBy("source").applyInPandas(_plan(cells), "source string, size long, n long, copies int, more long")
    plan = materialize(plan.join(goal, plan["source"].eqNullSafe(goal["source"])).select(plan["source"], "size", "n", "copies", "more", "source_size", "target"), "plan")
    # Each length of a source is cut into shards of the seeded order, so no group is ordered in one task.
    p = plan.withColumnsRenamed({"source": "_source", "size": "_size"})
    digest = F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1) if row is None else F.col("_row")))
    joined = sized.join(p, sized["source"].eqNullSafe(p["_source"]) & (sized["size"] == p["_size"])).drop("_source", "_size")
    keyed = joined.withColumn("_digest", digest).withColumn("_shard", F.when((F.col("more") > 0) & (F.col("more") < F.col("n")), F.pmod("_digest", F.ceil(F.col("n") / SHARD))))
    shards = keyed.where("_shard is not null").groupBy("source", "size", "_shard").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("source", "size").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    s = shards.withColumnsRenamed({"source": "_source", "size": "_size", "_shard": "_number"})
    within = Window.partitionBy("source", "size", "_shard").orderBy("_digest", "doc_id", *([] if row is None else ["_row"]))
    open_rows = keyed.where("_shard is not null").join(s, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("_shard") == F.col("_number")))
    picked = open_rows.withColumn("_extra", (F.col("_before") + F.row_number().over(within) <= F.col("more")).cast("int"))
    settled = keyed.where("_shard is null").withColumn("_extra", ((F.col("more") > 0) & (F.col("size") > 0)).cast("int"))
    columns = ["doc_id", "source", "size", "source_size", "target", (F.col("copies") + F.col("_extra")).alias("times")]
    columns += [] if row is None else [F.col("_row").alias(row)]
    out = picked.select(columns).union(settled.select(columns))
    return out.withColumn("taken", F.col("times") * F.col("size"))
