"""Figures for a whole set of scored pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmeter.functions.batches import real_length, unmask_labels
from gistmeter.operators.bias import penalized_score
from gistmeter.operators.overlap import ROUGE_TYPES, rouge_f
from gistmeter.operators.vocabulary import decode

# Cumulative probabilities of a Poisson(1) draw of 0, 1, 2, ...
POISSON_CDF = (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
    0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253,
    0.999998874797402, 0.9999998885745217, 0.9999999899522336,
)
WORDS = 4


def _draw(digest: Column, word: int) -> Column:
    """Poisson(1) count from one 32-bit word of a hex digest."""
    number = F.conv(F.substring(digest, 8 * word + 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    draw = F.lit(0)
    for bound in POISSON_CDF:
        draw = draw + (number >= bound).cast("int")
    return draw


def bootstrap_interval(
    df: DataFrame, key: str, values: list[str], resamples: int = 1000, seed: int = 42
) -> DataFrame:
    """Low, mid and high (2.5, 50 and 97.5 %) of the resampled mean of each value column.

    Every row is drawn a Poisson(1) number of times per resample, taken from a digest of the key,
    so the result does not depend on partitioning. Each task reduces its rows to one sum per
    resample before anything is shuffled; the percentiles run over ``resamples`` numbers.
    """
    if resamples % WORDS:
        raise ValueError(f"resamples must be a multiple of {WORDS}")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_gm_b"), F.col(key)).cast("binary"))
    drawn = (
        df.select(key, *values)
        .withColumn("_gm_b", F.explode(F.sequence(F.lit(0), F.lit(resamples // WORDS - 1))))
        .withColumn("_gm_digest", digest)
        .select("_gm_b", *values, *[_draw(F.col("_gm_digest"), w).alias(f"_gm_w{w}") for w in range(WORDS)])
    )
    sums = []
    for w in range(WORDS):
        weight = F.col(f"_gm_w{w}")
        sums += [F.sum(weight * F.col(v)).alias(f"_gm_{w}_{v}") for v in values]
        sums += [F.sum(F.when(F.col(v).isNotNull(), weight)).alias(f"_gm_n{w}_{v}") for v in values]
    totals = drawn.groupBy("_gm_b").agg(*sums)
    means = totals.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(v).alias("metric"),
                        F.expr(f"try_divide(`_gm_{w}_{v}`, `_gm_n{w}_{v}`)").alias("mean"),
                    )
                    for w in range(WORDS)
                    for v in values
                ]
            )
        ).alias("_gm")
    ).select("_gm.*")
    cuts = means.groupBy("metric").agg(F.percentile("mean", [0.025, 0.5, 0.975]).alias("_gm"))
    return cuts.select(
        "metric",
        F.get("_gm", F.lit(0)).alias("low"),
        F.get("_gm", F.lit(1)).alias("mid"),
        F.get("_gm", F.lit(2)).alias("high"),
    )


def generated_length(df: DataFrame, ids: str) -> DataFrame:
    """Mean number of ids that are not padding."""
    return df.agg(F.avg(real_length(F.col(ids))).alias("gen_len"))


def evaluate(
    df: DataFrame, predicted: str, gold: str, ids: str | None = None, bias: str | None = None
) -> DataFrame:
    """One row: stemmed ROUGE in percent with a sentence a line, and the mean generated length.

    With a ``bias`` column also the mean of the penalised ROUGE-1; rows without a bias have none.
    """
    scored = rouge_f(df, predicted, gold, stem=True, split_sentences=True)
    columns = [(F.avg(t) * 100).alias(t) for t in ROUGE_TYPES]
    if ids is not None:
        columns.append(F.avg(real_length(F.col(ids))).alias("gen_len"))
    if bias is not None:
        columns.append(F.avg(penalized_score(F.col("rouge1"), F.col(bias))).alias("penalized"))
    return scored.agg(*columns)


def evaluate_ids(
    df: DataFrame, key: str, pred_ids: str, label_ids: str, vocabulary: DataFrame, bias: str | None = None
) -> DataFrame:
    """``evaluate`` from the ids that a model made and the labels it was given.

    Ignored labels become padding, both sides are decoded without special ids, and the generated
    length counts the predicted ids that are not padding. ``key`` must be unique.
    """
    made = decode(df, key, pred_ids, vocabulary).withColumnRenamed("text", "_gm_made")
    labels = df.select(key, unmask_labels(F.col(label_ids)).alias(label_ids))
    gold = decode(labels, key, label_ids, vocabulary).withColumnRenamed("text", "_gm_gold")
    kept = df.select(key, pred_ids, *([bias] if bias else []))
    return evaluate(kept.join(made, key).join(gold, key), "_gm_made", "_gm_gold", pred_ids, bias)


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Every double column rounded."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, places).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])
