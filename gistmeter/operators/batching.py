"""Batches of similar length and what their padding costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmeter.operators.ranking import global_rank


def length_batches(df: DataFrame, key: str, length: str, batch_size: int = 4) -> DataFrame:
    """Position by (length, key) and the number of the batch of ``batch_size`` rows it falls in.

    Rank a slim table of keys and lengths and join texts to it afterwards.
    """
    ranked = global_rank(df, length, key, name="rank")
    return ranked.withColumn("batch_id", F.floor((F.col("rank") - 1) / batch_size))


def padding_waste(batches: DataFrame, length: str) -> DataFrame:
    """Rows, padded length and share of padding per batch."""
    return (
        batches.groupBy("batch_id")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.max(length).cast("long").alias("padded_length"),
            F.sum(length).alias("real_length"),
        )
        .withColumn(
            "waste",
            F.when(
                F.col("padded_length") > 0,
                1 - F.col("real_length") / (F.col("padded_length") * F.col("n_rows")),
            ).otherwise(0.0),
        )
    )


def with_padded_length(df: DataFrame, key: str, length: str, batch_size: int = 4) -> DataFrame:
    """Add ``batch_id`` and the longest length of the batch to every row of ``df``.

    ``df`` is read twice, for the ranking and for the join; materialize it when it is costly.
    """
    batches = length_batches(df.select(key, length), key, length, batch_size)
    longest = batches.groupBy("batch_id").agg(F.max(length).alias("padded_length"))
    return df.join(batches.join(longest, "batch_id").select(key, "batch_id", "padded_length"), key)
