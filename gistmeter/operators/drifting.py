"""Nested keys that change from record to record, flattened without a declared schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A log with more distinct keys than this has keys made of data and is better kept long.
MOST_KEYS = 2_000


def keys_of(df: DataFrame, column: str) -> DataFrame:
    """(path, kind, n): every path of keys in a VARIANT column of objects, its common type and how many records have it.

    Objects inside are followed level by level, so a path ends at a value that is no object; an empty object is a
    value of its own. Every task first reduces its records to one row per path.
    """
    level = df.select(F.array().cast("array<string>").alias("path"), F.col(column).alias("value"))
    level = level.where(F.col(column).isNotNull())
    found = None
    while True:
        member = df.sparkSession.tvf.variant_explode(F.col("value").outer())
        inner = level.select("path", "value").lateralJoin(member.toDF("pos", "key", "inside")).where("key is not null")
        inner = inner.select(F.array_append("path", F.col("key")).alias("path"), F.col("inside").alias("value"))
        is_object = F.schema_of_variant("value").startswith("OBJECT<") & (F.schema_of_variant("value") != "OBJECT<>")
        leaves = inner.where(~is_object).groupBy("path").agg(
            F.schema_of_variant_agg("value").alias("kind"), F.count(F.lit(1)).alias("n")
        )
        found = leaves if found is None else found.unionByName(leaves)
        level = inner.where(is_object)
        if level.isEmpty():
            return found


# Types that variants name and columns have under another name; all others are read as text.
_READ_AS = {"BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean", "STRING": "string", "FLOAT": "float", "DATE": "date"}


def column_type(kind: str) -> str:
    """The type a path is read as: decimals as double, arrays, mixed and empty kinds as (JSON) text."""
    return "double" if kind.startswith("DECIMAL") else _READ_AS.get(kind, "string")


def value_at(column: str, path: list[str], kind: str) -> Column:
    """The value at a path of keys, whatever characters they hold; null if it is not there or of another kind."""
    value, steps = F.col(column), "$"
    for key in path:
        if "'" not in key and "\\" not in key:
            steps += f"['{key}']"
        else:
            value, steps = F.try_element_at(F.try_variant_get(value, steps, "map<string,variant>"), F.lit(key)), "$"
    return F.try_variant_get(value, steps, kind)


def flatten_drifting(df: DataFrame, column: str, most_keys: int = MOST_KEYS) -> DataFrame:
    """``df`` with a VARIANT column of objects replaced by a column ``<column>.<key path>`` for every key any record has.

    No key is lost, however late it first appears. A record without a key, with a null, or with no object has null
    there. The driver sees one row per key path; more than ``most_keys`` are an error. Keys that differ only by
    case, or that clash with a column of ``df``, get a number at the end.
    """
    rows = keys_of(df, column).groupBy("path").agg(F.collect_set("kind").alias("kinds")).limit(most_keys + 1).collect()
    if len(rows) > most_keys:
        raise ValueError(f"more than {most_keys} keys in {column}")
    names = {c.lower() for c in df.columns if c != column}
    out = []
    for row in sorted(rows, key=lambda r: r["path"]):
        kind = column_type(row["kinds"][0]) if len(row["kinds"]) == 1 else "string"
        plain = ".".join(row["path"])
        name, number = f"{column}.{plain}", 2
        while name.lower() in names:
            name, number = f"{column}.{plain}_{number}", number + 1
        names.add(name.lower())
        out.append(value_at(column, row["path"], kind).alias(name))
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c != column), *out)
