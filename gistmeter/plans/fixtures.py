"""Inputs of the registered queries, derived from the given tables and always from all of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmeter.functions.text import distinct_of, last_of, longest_of, sentences
from gistmeter.operators.ranking import rank_within
from gistmeter.sources.tables import scan, spread

VECTOR_DIM = 64


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(scan(spark, folder, "documents"))


def conversation_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(conv_id, turn, prediction, gold): a user turn and the assistant turn that follows it."""
    turns = scan(spark, folder, "conversations")
    # The partitioning the join needs anyway, asked for by number: scoring is heavy for its bytes, and
    # left alone the adaptive plan would merge small partitions into one task.
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("prediction")
    )
    answered = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold")
    )
    keys = ["conv_id", "turn"]
    return asked.repartition(width, *keys).join(answered.repartition(width, *keys), keys)


def wide_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """(company, gold_summary, deduped, longest, closing): one column per way to shorten a text."""
    parts = F.col("_gm_parts")
    texts = documents(spark, folder).select("doc_id", "text", sentences("text").alias("_gm_parts"))
    return texts.select(
        F.col("doc_id").alias("company"),
        F.col("text").alias("gold_summary"),
        distinct_of(parts).alias("deduped"),
        longest_of(parts).alias("longest"),
        last_of(parts).alias("closing"),
    )


def gold_set(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, score) of the labelled documents: quality first, then length."""
    labels = scan(spark, folder, "labels")
    lengths = scan(spark, folder, "documents").select("doc_id", "n_chars")
    return lengths.join(labels, "doc_id").select(
        "doc_id", (F.col("quality") * 1_000_000 + F.col("n_chars")).cast("double").alias("score")
    )


def bias_labels(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, label, score) in the shape of a bias classifier's output."""
    return scan(spark, folder, "labels").select(
        "doc_id",
        F.when(F.col("toxic") == 0, "Non-biased").otherwise("Biased").alias("label"),
        ((F.col("doc_id") % 100) / 100.0).alias("score"),
    )


def trial_log(spark: SparkSession, folder: str) -> DataFrame:
    """(trial, training_iteration, epoch, eval_rouge1, eval_loss) from the events of each user."""
    events = scan(spark, folder, "events").select(
        F.col("user_id").alias("trial"),
        "ts",
        "event_id",
        F.col("value").alias("eval_rouge1"),
        F.get_json_object("props", "$.k").cast("double").alias("eval_loss"),
    )
    ranked = rank_within(events, "trial", "ts", "event_id", name="training_iteration")
    return ranked.select(
        "trial",
        "training_iteration",
        (F.col("training_iteration") * 0.5).alias("epoch"),
        "eval_rouge1",
        "eval_loss",
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")


def token_vector_id(table: DataFrame) -> Column:
    """Vector of a token: its digest modulo the number of vectors."""
    size = table.agg(F.max("vec_id")).first()[0] + 1
    digest = F.substring(F.md5(F.col("token").cast("binary")), 1, 8)
    return F.conv(digest, 16, 10).cast("long") % F.lit(size)
