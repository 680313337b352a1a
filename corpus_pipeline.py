"""A training corpus from raw documents: quality, exact and near duplicates, source weights, packing.

Each stage gets what the one before kept, as Parquet read again. All but the last return the columns of
``documents``. Decisions are made and carried out row by row: rows are told apart by their place in their files,
not by ``doc_id``, so ids may be null or repeat, with the same text or another. In all stages an empty table gives
an empty result, and columns beyond those named are carried along unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmeter.llm import exact_trie, mixing, ngram_join, packing
from gistmeter.llm.quality import good_documents
from gistmeter.llm.shared import numbered, only, without
from gistmeter.session import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier does not reject, judged by their text alone.

    Null and empty texts get the score of a text without words. Equal texts share one verdict.
    """
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, blanks apart: the longest original, then the smallest id, then the first row.

    Null and empty texts are one group. A null id comes after all others.
    """
    rows, row = numbered(docs)
    dropped = exact_trie.exact_groups(rows, row=row).where("not kept").select(row)
    return without(rows, materialize(dropped, "copies"), row).drop(row)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of links: that of the smallest id (null last), then the first.

    Null texts and texts without words link with nothing, so all of them stay.
    """
    rows, row = numbered(docs)
    groups = ngram_join.jaccard_groups(rows, doc_id=row).select(F.col("doc_id").alias(row), "component_id")
    groups = materialize(groups, "groups")
    others = groups.where(F.col("component_id") != F.col(row))
    # The row a component is named after goes in place of the one with the smallest id.
    named = rows.select(row, F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row).alias("row")).alias("by"))
    least = groups.join(named, row).groupBy("component_id").agg(F.min("by").alias("by"), F.count(F.lit(1)).alias("n"))
    swapped = materialize(least.where("n > 1 and by.row <> component_id").select("component_id", F.col("by.row").alias(row)), "swapped")
    dropped = without(others.select(row), swapped, row).union(swapped.select("component_id"))
    return without(rows, materialize(dropped, "near"), row).drop(row)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: not at all, once or twice.

    Null sources are a source of their own; texts without words are taken as often as all rows of their source.
    """
    rows, row = numbered(docs)
    times = materialize(mixing.mix(rows, row=row).select(row, "times"), "times")
    taken = without(rows, times.where("times = 0"), row)
    return taken.union(only(rows, times.where("times >= 2"), row)).drop(row)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row in a token-budget batch of an optimal length bucket; texts without words have length 0."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("exact dedup", drop_copies),
    ("near duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

#: The classifier and the knapsack cannot be said in SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
