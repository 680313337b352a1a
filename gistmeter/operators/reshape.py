"""Wide to long, nested to flat, row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmeter.operators.ranking import global_rank

# Positions of at most this many rows (a count) are broadcast.
BROADCAST_POSITIONS = 2_000_000


def melt(
    df: DataFrame, ids: list[str], variable: str = "model", value: str = "obtained_summary"
) -> DataFrame:
    """One row per id row and remaining column; null values stay."""
    return df.unpivot(ids, [c for c in df.columns if c not in ids], variable, value)


def with_position(df: DataFrame, ids: list[str], order: list[Column | str], name: str) -> DataFrame:
    """``df`` with the 1-based position of each row in ``order``; ``ids`` are unique and present, and hold the order.

    Only ids and order are ranked and sorted. The positions are brought to the rows by a broadcast up to
    ``BROADCAST_POSITIONS`` rows, and by a join beyond.
    """
    slim = df.select(*ids, *[(F.col(o) if isinstance(o, str) else o).alias(f"_gm_o{k}") for k, o in enumerate(order)])
    ranked = global_rank(slim, *[f"_gm_o{k}" for k in range(len(order))], name=name).select(*ids, name)
    small = ranked.limit(BROADCAST_POSITIONS + 1).count() <= BROADCAST_POSITIONS
    return df.join(F.broadcast(ranked) if small else ranked, ids)


def melt_with_index(
    df: DataFrame,
    ids: list[str],
    order: list[Column | str],
    variable: str = "model",
    value: str = "obtained_summary",
) -> DataFrame:
    """``melt`` plus a 0-based ``index``: columns one after the other, rows in ``order``.

    ``ids`` are unique and present. Only they and the order are ranked; the place of a long row follows by arithmetic.
    """
    columns = [c for c in df.columns if c not in ids]
    ranked = with_position(df, ids, order, "_gm_row")
    place = F.coalesce(*[F.when(F.col(variable) == name, F.lit(i)) for i, name in enumerate(columns)])
    long = ranked.unpivot([*ids, "_gm_row"], columns, variable, value)
    total = df.count()
    return long.select(
        (place * F.lit(total) + F.col("_gm_row") - 1).cast("long").alias("index"), *ids, variable, value
    )


def flatten_struct(df: DataFrame, column: str, drop: list[str] | None = None) -> DataFrame:
    """Lift ``column.*`` to columns ``column_*`` and drop bookkeeping columns.

    A column to drop that does not exist is an error.
    """
    absent = sorted(set(drop or []) - set(df.columns))
    if absent:
        raise KeyError(f"columns not in the table: {', '.join(absent)}")
    fields = df.schema[column].dataType.names
    kept = [c for c in df.columns if c != column and c not in (drop or [])]
    return df.select(
        *kept, *[F.col(f"{column}.{field}").alias(f"{column}_{field}") for field in fields]
    )


def metric_history(df: DataFrame, run: str, step: str, metrics: list[str]) -> DataFrame:
    """One row per run, whole-number step and metric."""
    base = df.select(
        run, F.col(step).cast("int").alias("step"), *[F.col(m).cast("double").alias(m) for m in metrics]
    )
    return base.unpivot([run, "step"], metrics, "key", "value")
