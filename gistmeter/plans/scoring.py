"""The scored table: every text and vector metric beside each input row."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmeter.functions.cuts import distinct_tokens, rouge_cut
from gistmeter.functions.places import items_outside
from gistmeter.functions.text import rouge_line
from gistmeter.functions.vectors import text_vector_scores
from gistmeter.operators.overlap import (
    ROUGE_TYPES,
    bleu,
    gold_token_columns,
    rouge_f,
    score_models,
    with_gold_tokens,
)
from gistmeter.operators.ranking import lookup_join
from gistmeter.operators.reshape import melt
from gistmeter.operators.vocabulary import frequent_items, with_packed
from gistmeter.session import materialize

# Every task holds the vectors of frequent tokens, at most so many numbers; a vector table of no more is broadcast.
BROADCAST_VALUES = 4_000_000


def score_overlap(df: DataFrame, predicted: str, gold: str, types: tuple[str, ...] = ROUGE_TYPES) -> DataFrame:
    """Add the F values of ``types`` (rouge1, rouge2, rougel, rougelsum) and the BLEU columns; no shuffle."""
    return bleu(rouge_f(df, predicted, gold, types=types), predicted, gold)


def _with_token_vectors(
    df: DataFrame, keys: list[str], texts: list[str], vectors: DataFrame, token_id: Column, dim: int
) -> tuple[DataFrame, pa.Array, pa.Array]:
    """(``df`` with ``_gm_keys`` and ``_gm_values``, frequent tokens, their vectors).

    The vectors of the corpus's most frequent tokens go to the texts; a row's distinct other tokens, over all its
    texts, look theirs up and come back with them (``_gm_keys``, ``_gm_values``).
    """
    rows = BROADCAST_VALUES // dim
    df = df.select(*keys, *texts)
    # A row asks for a token once, however often it has it.
    items = distinct_tokens(*texts)
    uses = df.select(F.explode(items).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    uses = materialize(uses.withColumn("vec_id", token_id), "tokens")
    held = vectors.select("vec_id", "vector")
    names, ids = frequent_items(uses, "token", "vec_id", "n", rows)
    shared = df.sparkSession.createDataFrame(pa.table({"token": names, "vec_id": ids}), "token string, vec_id long")
    common = held.join(F.broadcast(shared), "vec_id").select("token", "vector").toArrow().combine_chunks()
    shared_names, shared_vectors = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in common.columns)
    # Frequent tokens without a vector have been settled too.
    rare = df.select(*keys, F.explode(F.array_distinct(items_outside(names, T.StringType())(items))).alias("token"))
    found = lookup_join(rare.withColumn("vec_id", token_id), held, "vec_id", rows, costly=True)
    packed = with_packed(df, keys, found, "token", "vector")
    return packed, shared_names, shared_vectors


def _vector_columns(scores: Column) -> list[Column]:
    """cosine, match_precision, match_recall and match_f1 from what ``text_vector_scores`` found for a pair."""
    share = lambda matched, size: F.coalesce(matched / F.nullif(size, F.lit(0)), F.lit(0.0))
    precision, recall = share(scores["matched_p"], scores["size_p"]), share(scores["matched_g"], scores["size_g"])
    total = precision + recall
    f1 = F.when(total != 0, 2 * precision * recall / total).otherwise(0.0)
    return [
        scores["cosine"].alias("cosine"),
        precision.alias("match_precision"),
        recall.alias("match_recall"),
        f1.alias("match_f1"),
    ]


def score_vectors(
    df: DataFrame,
    keys: list[str],
    predicted: str,
    gold: str,
    vectors: DataFrame,
    token_id: Column,
    dim: int,
) -> DataFrame:
    """(keys, cosine, match_precision, match_recall, match_f1) for every pair; ``keys`` are present and unique.

    ``vectors`` is unique on ``vec_id``; ``token_id`` maps the column ``token`` to it. A pair is one row, and both
    sides are compared on one matrix of its distinct tokens. ``cosine`` compares the mean-pooled, normalised vectors.
    A token without a vector counts as unmatched in precision or recall; a pair without vectors on a side scores 0 and
    has no cosine.
    """
    rows, *shared = _with_token_vectors(df, keys, [predicted, gold], vectors, token_id, dim)
    found = text_vector_scores(*shared, rouge_cut)("_gm_keys", "_gm_values", rouge_line(gold), rouge_line(predicted))
    return rows.select(*keys, F.get(found, F.lit(0)).alias("_gm_s")).select(*keys, *_vector_columns(F.col("_gm_s")))


def melt_with_gold(
    df: DataFrame, ids: list[str], gold: str, variable: str = "model", **parts
) -> DataFrame:
    """Melt with the gold text's tokens beside it; ``parts`` as in ``with_gold_tokens``."""
    staged = with_gold_tokens(df, gold, **parts)
    return melt(staged, [*ids, gold, *gold_token_columns(staged)], variable, "obtained_summary")


def score_wide(
    df: DataFrame, ids: list[str], gold: str, variable: str = "model", types: tuple[str, ...] = ROUGE_TYPES
) -> DataFrame:
    """Wide model outputs to one scored row per id row and model.

    Every column outside ``ids`` and ``gold`` is a model. All are scored in their row, before the melt.
    """
    models = [c for c in df.columns if c not in (*ids, gold)]
    return score_models(df, ids, gold, models, variable, "obtained_summary", types)


def score_wide_vectors(
    df: DataFrame, ids: list[str], gold: str, vectors: DataFrame, token_id: Column, dim: int, variable: str = "model"
) -> DataFrame:
    """(ids, variable, cosine, match_precision, match_recall, match_f1) for every id row and model; ``ids`` are unique.

    All models of a row share the matrix of its distinct tokens; the rows become long once they are numbers.
    """
    models = [c for c in df.columns if c not in (*ids, gold)]
    rows, *shared = _with_token_vectors(df, ids, [gold, *models], vectors, token_id, dim)
    found = text_vector_scores(*shared, rouge_cut)("_gm_keys", "_gm_values", *[rouge_line(text) for text in (gold, *models)])
    scored = rows.select(*ids, F.posexplode(found).alias("_gm_k", "_gm_s"))
    name = F.get(F.array(*[F.lit(model) for model in models]), F.col("_gm_k"))
    return scored.select(*ids, name.alias(variable), *_vector_columns(F.col("_gm_s")))
