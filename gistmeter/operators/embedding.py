"""Vector operators: pooling, paired cosine, greedy token matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmeter.functions.vectors import cosine, greedy_sides

SMALLEST_MASK_SUM = 1e-9


def mean_pool(
    df: DataFrame, by: list[str], vector: str, dim: int, mask: Column | None = None
) -> DataFrame:
    """Masked mean vector per group: Σ(v·m) / max(Σm, 1e-9) for each dimension.

    One sum per dimension, so every task first reduces its rows to one row per group and a group of
    any size costs a shuffle of a few rows. Rows without a vector count as masked out.
    """
    weight = F.when(F.col(vector).isNotNull(), (F.lit(1) if mask is None else mask).cast("double"))
    weight = F.coalesce(weight, F.lit(0.0))
    weighed = df.select(*by, vector, weight.alias("_gm_w"))
    sums = [
        F.sum(F.coalesce(F.get(F.col(vector), F.lit(i)).cast("double"), F.lit(0.0)) * F.col("_gm_w")).alias(
            f"_gm_{i}"
        )
        for i in range(dim)
    ]
    pooled = weighed.groupBy(*by).agg(F.sum("_gm_w").alias("_gm_total"), *sums)
    below = F.greatest(F.col("_gm_total"), F.lit(SMALLEST_MASK_SUM))
    return pooled.select(*by, F.array(*[F.col(f"_gm_{i}") / below for i in range(dim)]).alias(vector))


def paired_cosine(df: DataFrame, left: str, right: str, name: str = "cosine") -> DataFrame:
    """Cosine of the two vectors of each row.

    Equals the diagonal of the full product of all left with all right vectors, at O(N).
    """
    return df.withColumn(name, cosine(F.col(left), F.col(right)))


def gather_vectors(
    tokens: DataFrame, keys: list[str], position: str, vector: str, sides: dict[str, Column]
) -> DataFrame:
    """One row per key with an ordered array of vectors per side.

    ``sides`` maps a column name to the condition that puts a token on that side. A group holds the
    tokens of the texts of one pair, which came from one row.
    """
    item = F.struct(position, vector)
    packed = tokens.groupBy(*keys).agg(
        *[F.sort_array(F.collect_list(F.when(here, item))).alias(name) for name, here in sides.items()]
    )
    return packed.select(*keys, *[F.transform(name, lambda x: x[vector]).alias(name) for name in sides])


def greedy_match(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """Precision, recall and F of greedy matching between two arrays of token vectors.

    Each token takes its most similar token of the other side (Zhang et al., 2020, no idf). The
    product of the two sides is formed block by block inside the row and never stored.
    """
    sided = df.withColumn("_gm_sides", greedy_sides(F.col(predicted), F.col(gold)))
    p, r = F.col("_gm_sides.precision"), F.col("_gm_sides.recall")
    f = F.when(p + r != 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return sided.select(
        *df.columns, p.alias("match_precision"), r.alias("match_recall"), f.alias("match_f1")
    )
