"""Sentences of a text by centrality: a damped random walk on the graph of their similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmeter.functions.text import rouge_tokens, sentences


def walk(sentence: np.ndarray, term: np.ndarray, weight: np.ndarray, text: np.ndarray, damping: float, rounds: int) -> np.ndarray:
    """Centrality of every sentence of a batch of texts.

    ``sentence, term, weight`` are the entries of unit vectors, terms numbered apart for each text; ``text`` is the
    text of each sentence. The similarity of two sentences is the product of their vectors. The graph is never
    built: a step goes from sentences to the lists of their terms and back, so it costs the entries, not their square.
    """
    count, terms = len(text), int(term.max()) + 1 if len(term) else 0

    def step(x: np.ndarray) -> np.ndarray:
        of_term = np.bincount(term, weight * x[sentence], terms)
        return np.bincount(sentence, weight * of_term[term], count) - x * full

    full = np.bincount(sentence, minlength=count) > 0
    degree = step(np.ones(count))
    # What is left of a sentence that shares no term is rounding.
    degree[degree < 1e-9] = 0
    size = np.bincount(text)[text] if count else np.zeros(0)
    rank = 1.0 / size
    for _ in range(rounds):
        given = np.divide(rank, degree, out=np.zeros(count), where=degree > 0)
        rank = (1 - damping) / size + damping * step(given)
    return rank


def centralities(damping: float = 0.85, rounds: int = 10):
    """A function of a column of sentences, each a list of tokens, to the centrality of each."""

    def run(column: pa.Array) -> pa.Array:
        outer = np.array([len(v.values) if v.is_valid else 0 for v in column], np.int64)
        flat = column.flatten()
        inner = np.array([len(v.values) if v.is_valid else 0 for v in flat], np.int64)
        text = np.repeat(np.arange(len(outer)), outer)
        codes = flat.flatten().dictionary_encode()
        sentence = np.repeat(np.arange(len(inner)), inner)
        token = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        cell, count = np.unique(sentence * max(len(codes.dictionary), 1) + token, return_counts=True)
        sentence, token = np.divmod(cell, max(len(codes.dictionary), 1))
        norm = np.sqrt(np.bincount(sentence, count.astype(float) ** 2, len(text)))
        _, term = np.unique(text[sentence] * max(len(codes.dictionary), 1) + token, return_inverse=True)
        rank = walk(sentence, term, count / norm[sentence], text, damping, rounds)
        bounds = np.concatenate([[0], np.cumsum(outer)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(rank, pa.float64()))

    return F.arrow_udf(run, T.ArrayType(T.DoubleType()))


def with_centrality(df: DataFrame, text: str, cut: Column | None = None, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    """``df`` with ``sentences`` (first-seen distinct ones) and ``centrality``, one number for each.

    ``cut`` is an array of sentences, by default the rule's. The numbers are those of a damped walk after ``rounds``
    steps. A sentence that shares no word with another has the damping's share only; a null or empty text has empty
    lists. Nothing is shuffled, and memory grows with the words of a batch.
    """
    distinct = F.coalesce(F.array_distinct(cut if cut is not None else sentences(text)), F.array().cast("array<string>"))
    listed = df.withColumn("sentences", distinct)
    tokens = F.transform("sentences", lambda s: rouge_tokens(s))
    return listed.withColumn("centrality", centralities(damping, rounds)(tokens))


def central_sentences(df: DataFrame, key: str, text: str, top: int = 1, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    """(key, pos, sentence, centrality): the ``top`` most central sentences of every text, the first of equals."""
    scored = with_centrality(df.select(key, text), text, None, damping, rounds)
    # Equal up to rounding counts as equal.
    items = F.transform(F.arrays_zip("sentences", "centrality"), lambda x, i: F.struct((-F.round(x["centrality"], 9)).alias("by"), i.alias("pos"), x["sentences"].alias("sentence"), x["centrality"].alias("centrality")))
    best = scored.select(key, F.inline(F.slice(F.array_sort(items), 1, top)))
    return best.select(key, F.col("pos").cast("long").alias("pos"), "sentence", "centrality")
