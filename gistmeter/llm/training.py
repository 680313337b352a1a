"""Bounded samples of labelled documents for the classifiers, and their scoring over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmeter.llm.shared import crc_part, pieces


def labelled_sample(
    docs: DataFrame, labels: DataFrame, column: str, parts: int, held: int, rows: int, row_bytes: int
) -> tuple[pa.Array, np.ndarray]:
    """Texts and 0/1 labels of at most ``rows`` documents of each class, by a seeded digest of the id.

    Never documents whose ``crc32(doc_id) mod parts`` is ``held``, and none over ``row_bytes`` bytes, so that
    the driver gets at most ``2 * rows * row_bytes`` bytes. A document with several labels has the largest;
    null labels and labels without a document do not count.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (crc_part("doc_id", parts) != held))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64(F.lit(5), "doc_id")
    chosen = [known.where(F.col("label") == k).orderBy(order, "doc_id").limit(rows) for k in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where(F.col("text").isNotNull() & (F.octet_length("text") <= row_bytes))
    # At most 2 * rows ids are broadcast.
    found = texts.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").select("doc_id", "text", "label").toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    text = pa.chunked_array(found.column("text").chunks, pa.string()).combine_chunks()
    return text, found.column("label").to_numpy().astype(np.int64)


def score_documents(docs: DataFrame, score: Callable[[pa.Array], np.ndarray], parts: int, held: int) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; ``score`` sees texts only, about 2 MB at a time."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                values = score(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(values, pa.float64())], names=["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = slim.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        (crc_part("doc_id", parts) == held).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
