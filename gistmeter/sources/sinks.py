"""Writing tables: replace, create once with a key, merge by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmeter.session import fresh_path


def overwrite_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Replace the whole table and read it back."""
    writer = df.write.mode("overwrite")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are null or occur more than once, with their row counts."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    return counts.where((F.col("n_rows") > 1) | missing)


def _require_keys(df: DataFrame, keys: list[str]) -> None:
    # Only the keys are read for the check; Catalyst prunes the columns that are costly to compute.
    broken = key_violations(df, keys).limit(1).collect()
    if broken:
        raise ValueError(f"key {keys} is null or repeated: {broken[0].asDict()}")


def create_keyed_table(
    df: DataFrame, name: str, keys: list[str], description: str = "", path: str | None = None
) -> DataFrame:
    """Create a table that must not exist yet; its keys must be present and unique."""
    spark = df.sparkSession
    if spark.catalog.tableExists(name):
        raise ValueError(f"table exists: {name}")
    _require_keys(df, keys)
    writer = df.write.mode("errorifexists")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    comment = (description + f" Primary key: {', '.join(keys)}.").strip().replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"COMMENT ON TABLE {name} IS '{comment}'")
    return spark.table(name)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``changes`` plus the rows of ``current`` whose key they do not carry."""
    kept = current.join(changes.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(changes)


def merge_table(changes: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Merge rows into a stored Parquet table by key; keys of ``changes`` must be present and unique.

    The merged rows are written once, to a folder of their own in the shared folder, and the catalog is then told the
    table's new place in one step: readers see the old table or the new one, and the old files stay for those that
    have begun. ``sources.snapshots`` rewrites touched buckets only and detects a second writer.
    """
    _require_keys(changes, keys)
    spark = changes.sparkSession
    merged = upsert(spark.table(name), changes, keys)
    path = fresh_path(spark, "merged")
    merged.write.parquet(path)
    spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
    spark.catalog.refreshTable(name)
    return spark.table(name)
