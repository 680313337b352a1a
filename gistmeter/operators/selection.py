"""Top rows and filters by a list of ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ids of at most this many rows are broadcast; a longer list is shuffled.
BROADCAST_ROWS = 100_000


def top_rows(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows of an explicit order; fewer when the table is shorter."""
    return df.orderBy(*order).limit(k)


def semi_filter(df: DataFrame, ids: DataFrame, key: str, rows_bound: int | None = None) -> DataFrame:
    """All rows whose id is listed. ``rows_bound`` is a proven bound on the length of the list."""
    wanted = ids.select(key).distinct()
    if rows_bound is not None and rows_bound <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    return df.join(wanted, key, "left_semi")


def top_k_by_score(df: DataFrame, key: str, score: str, k: int) -> DataFrame:
    """All rows of the ids found in the ``k`` best rows; ties go to the smaller id, NaN and null come last."""
    number = F.when(~F.isnan(score), F.col(score))
    best = top_rows(df.select(key, score), k, number.desc_nulls_last(), F.col(key))
    return semi_filter(df, best, key, rows_bound=k)


def top_k_per_split(df: DataFrame, split: str, key: str, score: str, best: dict[str, int]) -> DataFrame:
    """``top_k_by_score`` inside every split named in ``best``, each with its own number; others are left out."""
    chosen = [top_k_by_score(df.where(F.col(split) == name), key, score, k) for name, k in best.items()]
    return reduce(DataFrame.unionByName, chosen)
