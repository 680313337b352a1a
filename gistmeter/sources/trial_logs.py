"""Tuning logs on disk: one folder a trial, JSON lines of results, one JSON object of parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bookkeeping keys of a result line.
BOOKKEEPING = [
    "timesteps_total", "episodes_total", "node_ip", "hostname", "trial_id", "experiment_id", "date",
    "config", "should_checkpoint", "done",
]


def folder_name(path: Column, depth: int = 1) -> Column:
    """Name of the folder ``depth`` levels above a file."""
    return F.element_at(F.split(path, "/"), -1 - depth)


def read_results(
    spark: SparkSession, pattern: str, schema: T.StructType | str, trial: str = "trial"
) -> DataFrame:
    """Every line of every result file that matches ``pattern``, tagged with its folder.

    Folders that start with ``_`` are read when the pattern spells the prefix out.
    """
    lines = spark.read.schema(schema).json(pattern)
    return lines.select(folder_name(F.col("_metadata.file_path")).alias(trial), "*")


def read_params(
    spark: SparkSession, pattern: str, schema: T.StructType | str, trial: str = "trial"
) -> DataFrame:
    """One row per parameter file, tagged with its folder."""
    objects = spark.read.schema(schema).option("multiLine", "true").json(pattern)
    return objects.select(folder_name(F.col("_metadata.file_path")).alias(trial), "*")
