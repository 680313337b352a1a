"""Listings of files and the newest of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modified, size) of the files below ``path``; contents are not read."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
    )
    return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_extract(base_name(path), "^(.+?)(\\.[^.]*)?$", 1)


def visible(files: DataFrame) -> DataFrame:
    """Files whose name does not start with a dot."""
    return files.where(~base_name(F.col("path")).startswith("."))


def newest(files: DataFrame, by: list[str], what: Column | str = "path", modified: str = "modified") -> DataFrame:
    """The last modified entry per group; the larger name of several."""
    entry = F.col(what) if isinstance(what, str) else what
    last = F.max(F.struct(F.col(modified).alias("modified"), entry.alias("entry")))
    return files.groupBy(*by).agg(last.alias("_gm")).select(*by, "_gm.entry", "_gm.modified")
