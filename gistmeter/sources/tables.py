"""Table scans and the choice between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The parquet table ``table`` in ``folder``."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give a scan at least one partition per core.

    For CPU-heavy work on a table stored in fewer row groups than there are cores. Large tables
    have more partitions than cores and pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table_names(spark: SparkSession, database: str | None = None) -> list[str]:
    """Names of the tables and views of a database."""
    return sorted(entry.name for entry in spark.catalog.listTables(database))


def conditional_table(
    spark: SparkSession, marker: str, first_run: str, later_run: str, database: str | None = None
) -> DataFrame:
    """``later_run`` when the ``marker`` table exists, ``first_run`` before that."""
    prefix = "" if database is None else f"{database}."
    chosen = later_run if spark.catalog.tableExists(prefix + marker) else first_run
    return spark.table(prefix + chosen)


def schema_signature(df: DataFrame) -> DataFrame:
    """(column, type, required) of a table; a column without nulls is required.

    Types come from the schema; nulls are counted over the whole table in one pass.
    """
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns], F.count(F.lit(1)).alias("_gm_all"))
    rows = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(kind).alias("type"),
            (F.col(f"`{name}`") == F.col("_gm_all")).alias("required"),
        )
        for name, kind in df.dtypes
    ]
    return counts.select(F.explode(F.array(*rows)).alias("_gm")).select("_gm.*")
