"""Analysis of tuning logs: one row per trial and iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmeter.operators.ranking import lookup_join, rank_within
from gistmeter.session import materialize

# Counts of at most this many configurations are broadcast.
BROADCAST_CONFIGURATIONS = 100_000


def best_record(df: DataFrame, trial: str, iteration: str, metric: str, keep: list[str]) -> DataFrame:
    """The best row of every trial; the earliest of several. A NaN metric is no result.

    A maximum over structs reduces inside each task first, so a trial of any length is no problem.
    """
    row = F.struct(
        F.col(metric).alias("metric"),
        (-F.col(iteration)).alias("order"),
        F.struct(iteration, *keep).alias("rest"),
    )
    best = df.where(F.col(metric).isNotNull() & ~F.isnan(metric)).groupBy(trial).agg(F.max(row).alias("_gm"))
    return best.select(trial, F.col("_gm.metric").alias(metric), "_gm.rest.*")


def best_trial(best: DataFrame, trial: str, metric: str) -> DataFrame:
    """The trial with the largest metric above zero; the first of several, none when all are lower."""
    return best.where((F.col(metric) > 0) & ~F.isnan(metric)).orderBy(F.col(metric).desc(), F.col(trial)).limit(1)


def first_plateau(
    df: DataFrame,
    trial: str,
    iteration: str,
    metric: str,
    spread: float = 0.01,
    results: int = 4,
    min_results: int | None = None,
    grace_period: int = 1,
) -> DataFrame:
    """First iteration at which the last ``results`` values deviate by less than ``spread``.

    Results are numbered per trial first, so gaps between iterations do not matter. A row belongs to the
    windows that end at its own and the next ``results - 1`` results. It is sent to each of them and the deviation is an ordinary
    aggregate of at most ``results`` rows, which splits a long trial over all tasks.
    """
    least = results if min_results is None else min_results
    numbered = rank_within(df.select(trial, iteration, metric), trial, iteration, name="_gm_number")
    ends = F.sequence(F.col("_gm_number"), F.col("_gm_number") + (results - 1))
    windows = (
        numbered.select(trial, iteration, metric, "_gm_number", F.explode(ends).alias("_gm_end"))
        .groupBy(trial, "_gm_end")
        .agg(
            F.stddev_pop(metric).alias("_gm_spread"),
            F.count(metric).alias("_gm_n"),
            F.max("_gm_number").alias("_gm_last"),
            F.max(iteration).alias("_gm_iteration"),
        )
    )
    flat = windows.where(
        (F.col("_gm_last") == F.col("_gm_end"))
        & (F.col("_gm_spread") < spread)
        & (F.col("_gm_n") >= least)
        & (F.col("_gm_iteration") >= grace_period)
    )
    return flat.groupBy(trial).agg(F.min("_gm_iteration").alias("stop_iteration"))


def latency_summary(df: DataFrame, configuration: str, seconds: str) -> DataFrame:
    """Steps, total and mean time of every configuration."""
    return df.groupBy(configuration).agg(
        F.count(seconds).alias("steps"),
        F.sum(seconds).alias("total_seconds"),
        F.avg(seconds).alias("mean_seconds"),
        F.min(seconds).alias("min_seconds"),
        F.max(seconds).alias("max_seconds"),
    )


def latency_percentiles(
    df: DataFrame, configuration: str, seconds: str, percents: tuple[int, ...] = (50, 90, 99)
) -> DataFrame:
    """The exact ``p<percent>_seconds`` of every configuration: the smallest time that so many steps do not exceed.

    The times are ranked over all tasks, so a configuration of any size is spread; an aggregate that keeps
    a configuration's times together would not be. Null times and null configurations do not count.
    """
    timed = df.select(configuration, seconds).where(F.col(configuration).isNotNull() & F.col(seconds).isNotNull())
    ranked = rank_within(timed, configuration, seconds, name="_gm_rank")
    steps = timed.groupBy(configuration).agg(F.count(F.lit(1)).alias("_gm_steps"))
    counted = materialize(steps.withColumn("_gm_uses", F.col("_gm_steps")), "steps")
    placed = lookup_join(ranked, counted, configuration, BROADCAST_CONFIGURATIONS, "_gm_uses")
    return placed.groupBy(configuration).agg(
        *[
            F.max(F.when(F.col("_gm_rank") == F.ceil(F.col("_gm_steps") * p / 100), F.col(seconds))).alias(f"p{p}_seconds")
            for p in percents
        ]
    )


# Sketches of this size are off by less than half a percent of the ranks, with 99 % confidence.
SKETCH_SIZE, SKETCH_ERROR = 1000, 0.005


def latency_sketches(df: DataFrame, by: list[str], seconds: str, size: int = SKETCH_SIZE) -> DataFrame:
    """(by, sketch): a mergeable quantile sketch of each group's times, of a few KB whatever the group's size.

    Null times do not count; a group without any has an empty sketch, which gives no percentiles. Every task sketches its own rows first.
    """
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(seconds).cast("double"), size).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: list[str], size: int = SKETCH_SIZE) -> DataFrame:
    """Sketches of coarser groups from those of finer ones, without the times."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", size).alias("sketch"))


def sketched_percentiles(sketches: DataFrame, by: list[str], percents: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """(by, steps, percent, seconds): times whose rank is off by less than ``SKETCH_ERROR`` of the steps."""
    values = [F.struct(F.lit(p).alias("percent"), F.kll_sketch_get_quantile_double("sketch", F.lit(p / 100)).alias("seconds")) for p in percents]
    # Asked for a quantile, an empty sketch fails.
    known = sketches.where(F.kll_sketch_get_n_double("sketch") > 0)
    return known.select(*by, F.kll_sketch_get_n_double("sketch").alias("steps"), F.inline(F.array(*values)))
