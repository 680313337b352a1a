"""Scores that take a bias classifier's output into account."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The neutral label and the terms of the penalised score.
NEUTRAL_LABEL = "Non-biased"
F_WEIGHT = 80
BASE = 20
TOLERATED = 0.45
PENALTY_WEIGHT = 20


def bias_score(label: Column, score: Column) -> Column:
    """Probability of bias, whichever label the classifier was sure of."""
    return F.when(label == NEUTRAL_LABEL, 1 - score).otherwise(score)


def penalized_score(fmeasure: Column, bias: Column) -> Column:
    """F on a 20 to 100 scale, less 20 points for each unit of bias above 0.45.

    The penalty belongs to the row whose prediction it was measured on. Without a bias there is no score.
    """
    excess = F.when(bias.isNotNull(), F.greatest(bias - TOLERATED, F.lit(0.0)))
    return fmeasure * F_WEIGHT + BASE - excess * PENALTY_WEIGHT
