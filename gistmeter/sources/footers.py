"""What the footers of Parquet files say about a table, without decoding a page."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The types whose least and largest values footers keep exactly.
_ORDERED = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def _extremes(table: DataFrame, k: int) -> list[Column]:
    name = f"`{table.schema[k].name}`"
    return [F.min(name).alias(f"low{k}"), F.max(name).alias(f"high{k}")]


def footer_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose plain counts, minima and maxima are answered by file footers.

    It belongs to a session of its own, in which the Parquet reader answers aggregates; every footer is read in a
    task, and its numbers are merged like any aggregate.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path)


def footer_aggregate(table: DataFrame, extremes: bool = True) -> DataFrame:
    """One row with the counts and, if asked for, the extremes of all columns of a ``footer_table``."""
    fields = list(enumerate(table.schema))
    wanted = [F.count(F.lit(1)).alias("all")]
    wanted += [F.count(f"`{f.name}`").alias(f"n{k}") for k, f in fields if not isinstance(f.dataType, _NESTED)]
    if extremes:
        wanted += [x for k, f in fields if isinstance(f.dataType, _ORDERED) for x in _extremes(table, k)]
    return table.agg(*wanted)


def table_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(column, type, n_rows, n_nulls, minimum, maximum) of a Parquet table; extremes of numbers and flags, as double.

    No data is read, except a column whose footers lack extremes somewhere (a file that has only nulls in it): that
    column alone is scanned. A nested column has no null count, and text and times have no extremes, since footers
    cut or drop these. An empty table has zeros and nulls. The driver sees one row, as wide as the table.
    """
    table = footer_table(spark, path)
    schema = table.schema
    try:
        found = footer_aggregate(table).first().asDict()
    except (PySparkException, Py4JJavaError):
        found = footer_aggregate(table, extremes=False).first().asDict()
        for k, field in enumerate(schema):
            if isinstance(field.dataType, _ORDERED):
                try:
                    found |= table.agg(*_extremes(table, k)).first().asDict()
                except (PySparkException, Py4JJavaError):
                    found |= spark.read.parquet(path).agg(*_extremes(table, k)).first().asDict()
    number = lambda value: None if value is None else float(value)
    # Files without rows have no counts either.
    rows, all_rows = [], found["all"] or 0
    for k, field in enumerate(schema):
        nulls = None if isinstance(field.dataType, _NESTED) else all_rows - (found[f"n{k}"] or 0)
        rows.append((field.name, field.dataType.simpleString(), all_rows, nulls, number(found.get(f"low{k}")), number(found.get(f"high{k}"))))
    return spark.createDataFrame(rows, "column string, type string, n_rows long, n_nulls long, minimum double, maximum double")
