"""Exact global positions and lookups that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmeter.session import materialize

_POSITION = "_gm_position"
_PART = "_gm_part"
_BEFORE = "_gm_before"
_TIE = "_gm_tie"


def _width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def global_rank(
    df: DataFrame, *order: Column | str, name: str = "rank", partitions: int | None = None
) -> DataFrame:
    """Add the 1-based position of every row in a total order.

    A window without a partition key would sort the table in one task. Here the rows are range
    partitioned and sorted, each gets its position in its partition, and the sizes of the
    partitions before it are added. A last sort key of our own lets the range partitioner cut
    through rows that tie on ``order``. The sorted rows are written once, so the partition of a row
    cannot change between counting and numbering.
    """
    keys = [F.col(key) if isinstance(key, str) else key for key in order]
    count = partitions or _width(df)
    # Two steps: a generated id must be frozen in a column before it can act as a sort key.
    tied = df.withColumn(_TIE, F.monotonically_increasing_id())
    placed = (
        tied.repartitionByRange(count, *keys, F.col(_TIE))
        .sortWithinPartitions(*keys, F.col(_TIE))
        .drop(_TIE)
        .withColumn(_POSITION, F.monotonically_increasing_id())
    )
    frozen = materialize(placed, "rank")
    split = (
        frozen.withColumn(_PART, F.shiftright(_POSITION, 33))
        .withColumn(_POSITION, F.col(_POSITION).bitwiseAND(F.lit((1 << 33) - 1)))
    )
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition, so the window and the broadcast are bounded by the partition count.
    before = (
        split.groupBy(_PART)
        .agg(F.count(F.lit(1)).alias("_gm_rows"))
        .select(_PART, F.coalesce(F.sum("_gm_rows").over(earlier), F.lit(0)).alias(_BEFORE))
    )
    return split.join(F.broadcast(before), _PART).select(
        *df.columns, (F.col(_BEFORE) + F.col(_POSITION) + 1).alias(name)
    )


def skew_safe_lookup(
    rows: DataFrame, lookup: DataFrame, on: str, occurrences: str, parts: int | None = None
) -> DataFrame:
    """Inner join of ``rows`` with a table that is unique on ``on``.

    ``lookup[occurrences]`` says how many of ``rows`` carry the key. Keys above a share of
    ``1 / parts`` number at most ``parts``, so that piece of the lookup is broadcast and its rows
    stay where they are; no key among the rest can dominate a task of the shuffled join.
    """
    parts = parts or _width(rows)
    total = lookup.agg(F.sum(occurrences)).first()[0] or 0
    frequent = F.col(occurrences) * parts > total
    heavy = F.broadcast(lookup.where(frequent))
    light = lookup.where(~frequent)
    shuffled = rows.join(heavy.select(on), on, "left_anti").join(light, on)
    return rows.join(heavy, on).unionByName(shuffled)


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: str,
    broadcast_rows: int,
    occurrences: str | None = None,
    broadcast_bytes: int = 64 << 20,
    costly: bool = False,
) -> DataFrame:
    """Inner join of ``rows`` with a table that is unique on ``on``.

    The table is counted: up to ``broadcast_rows`` rows, with at most ``broadcast_bytes`` of text in ``on``, it is
    broadcast. For a larger one the frequent keys come from ``rows``, so that a key the table does not have is
    kept off the shuffle too: keys above a share of ``1 / partitions`` are settled by a broadcast of at most
    ``partitions`` rows. ``occurrences`` names a column of the table with the exact uses of its keys, if every
    row has a match; it is dropped.
    """
    size = F.sum(F.octet_length(F.col(on).cast("string")))
    count, held = table.agg(F.count(F.lit(1)), size).first()
    if count <= broadcast_rows and (held or 0) <= broadcast_bytes:
        return rows.join(F.broadcast(table.drop(occurrences) if occurrences else table), on)
    if occurrences:
        return skew_safe_lookup(rows, table, on, occurrences).drop(occurrences)
    present = rows.where(F.col(on).isNotNull())
    present = materialize(present, "rows") if costly else present
    uses = present.groupBy(on).agg(F.count(F.lit(1)).alias("_gm_uses"))
    # Read several times below, so the counting is done once and written.
    counted = materialize(uses.join(table.withColumn("_gm_hit", F.lit(True)), on, "left"), "lookup")
    total = counted.agg(F.sum("_gm_uses")).first()[0] or 0
    frequent = F.col("_gm_uses") * _width(rows) > total
    heavy = F.broadcast(counted.where(frequent).drop("_gm_uses"))
    light = counted.where(~frequent & F.col("_gm_hit")).drop("_gm_uses")
    rest = present.join(heavy.select(on), on, "left_anti").join(light, on)
    return present.join(heavy, on).where("_gm_hit").unionByName(rest).drop("_gm_hit")


def rank_within(df: DataFrame, group: str, *order: Column | str, name: str = "rank") -> DataFrame:
    """``row_number`` per group without gathering a group in one task."""
    ranked = global_rank(df, group, *order, name=_POSITION)
    starts = ranked.groupBy(group).agg(
        F.min(_POSITION).alias(_BEFORE), F.count(F.lit(1)).alias("_gm_rows")
    )
    joined = skew_safe_lookup(ranked, materialize(starts, "starts"), group, "_gm_rows")
    return joined.select(*df.columns, (F.col(_POSITION) - F.col(_BEFORE) + 1).alias(name))
