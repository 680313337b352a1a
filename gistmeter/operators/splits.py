"""Seeded splits of exact size, and their shares."""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_DIGITS = 32
_STEP = 4


def split_hash(key: Column | str, seed: int) -> Column:
    """Hex digest that puts the keys in a seeded random order."""
    column = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), column.cast("string")).cast("binary"))


def _prefix_counts(df: DataFrame, key: str, seed: int, prefix: str = "") -> list[tuple[str, int]]:
    """Rows per next four digits of the digest: 65,536 pairs at most, in order."""
    digest = split_hash(key, seed)
    counts = (
        df.select(key)
        .where(F.substring(digest, 1, len(prefix)) == prefix if prefix else F.lit(True))
        .groupBy(F.substring(digest, 1, len(prefix) + _STEP).alias("prefix"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    found = counts.collect()
    if any(row["prefix"] is None for row in found):
        raise ValueError(f"{key} is null in some rows: they have no place in the seeded order")
    return sorted((row["prefix"], row["n"]) for row in found)


def _first_rows(df: DataFrame, key: str, rows: int, seed: int, counts: list[tuple[str, int]]) -> Column:
    """Predicate for the ``rows`` rows that come first in the seeded order.

    Selects by digit: the prefix in which the count is reached is refined by four more digits until
    the cut falls between two prefixes. Nothing is sorted and no row moves; the result is a filter.
    """
    if rows <= 0:
        return F.lit(False)
    while True:
        upto = list(accumulate(n for _, n in counts))
        place = bisect_left(upto, rows)
        if place == len(counts):
            return F.lit(True)
        prefix, n = counts[place]
        if upto[place] == rows or len(prefix) >= _DIGITS:
            return F.substring(split_hash(key, seed), 1, len(prefix)) <= prefix
        rows -= upto[place] - n
        counts = _prefix_counts(df, key, seed, prefix)


def _ceil_share(rows: int, percent: int) -> int:
    return -(-rows * percent // 100)


def split_two(df: DataFrame, key: str, percent: int = 10, seed: int = 42) -> DataFrame:
    """Label rows ``train`` or ``eval``; ``eval`` gets the rounded-up share.

    ``key`` must identify a row: rows that share a key also share their side.
    """
    counts = _prefix_counts(df, key, seed)
    total = sum(n for _, n in counts)
    held_out = _first_rows(df, key, _ceil_share(total, percent), seed, counts)
    return df.withColumn("split", F.when(held_out, "eval").otherwise("train"))


def split_three(df: DataFrame, key: str, percent: int = 20, seed: int = 42) -> DataFrame:
    """Hold out a share, then halve it: the rounded-up half is ``eval``, the rest ``test``."""
    counts = _prefix_counts(df, key, seed)
    held = _ceil_share(sum(n for _, n in counts), percent)
    in_eval = _first_rows(df, key, _ceil_share(held, 50), seed, counts)
    in_held = _first_rows(df, key, held, seed, counts)
    return df.withColumn("split", F.when(in_eval, "eval").when(in_held, "test").otherwise("train"))


def split_shares(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows per split and their percentage of all rows."""
    counts = df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"))
    # The window runs over one row per split.
    everything = Window.partitionBy(F.lit(1))
    return counts.withColumn("percent", F.col("n_rows") * 100.0 / F.sum("n_rows").over(everything))
