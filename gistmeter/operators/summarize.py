"""Batched prediction over texts, in batches of similar length."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmeter.functions.text import rouge_tokens, sentences
from gistmeter.operators.batching import length_batches

# A model maps the rows of one batch to (prediction, score) pairs.
Model = Callable[[pd.DataFrame], list[tuple[str, float]]]


def central_sentences(count: int = 1) -> Callable[[], Model]:
    """Extractive stand-in for a trained model: the sentences whose words the text uses most.

    A sentence scores the mean frequency, in the whole text, of its words. Ties go to the earlier
    sentence; chosen sentences keep the order of the text.
    """

    def load() -> Model:
        def predict(batch: pd.DataFrame) -> list[tuple[str, float]]:
            return [_pick(s, t, count) for s, t in zip(batch["sentences"], batch["sentence_tokens"])]

        return predict

    return load


def _pick(parts, tokens, count: int) -> tuple[str, float]:
    uses = Counter(token for line in tokens for token in line)
    scores = [sum(uses[t] for t in line) / len(line) if len(line) else 0.0 for line in tokens]
    best = sorted(range(len(parts)), key=lambda i: (-scores[i], i))[:count]
    return " ".join(parts[i] for i in sorted(best)), max((scores[i] for i in best), default=0.0)


def batch_summarize(
    df: DataFrame,
    key: str,
    text: str,
    load_model: Callable[[], Model] | None = None,
    batch_size: int = 4,
    with_sentences: bool = False,
) -> DataFrame:
    """(key, rank, batch_id, prediction, score); the model sees whole batches, shortest texts first.

    Keys and lengths are ranked without the texts. Batches are then spread by their number, so the
    long ones do not meet in one task. The model is loaded once per task. The key travels with each
    prediction, so results can be joined back in any order. A model that asks for it ``with_sentences``
    (the default one does) also gets ``sentences`` and ``sentence_tokens``, made after the texts have moved.
    """
    with_sentences = with_sentences or load_model is None
    load_model = load_model or central_sentences()
    slim = df.select(key, F.length(text).alias("length"))
    batches = length_batches(slim, key, "length", batch_size).drop("length")
    # A number keeps the adaptive plan from merging tasks: a model's time is not in its input's bytes.
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fed = (
        df.select(key, text)
        .join(batches, key)
        .repartition(width, "batch_id")
        .sortWithinPartitions("batch_id", "rank")
    )
    if with_sentences:
        fed = fed.withColumn("sentences", sentences(text))
        fed = fed.withColumn("sentence_tokens", F.transform("sentences", rouge_tokens))
    out = T.StructType(
        [
            df.schema[key],
            T.StructField("rank", T.LongType()),
            T.StructField("batch_id", T.LongType()),
            T.StructField("prediction", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load_model()
        for batches in _whole_batches(frames):
            results = []
            for batch in batches:
                made = batch[[key, "rank", "batch_id"]].copy()
                pairs = predict(batch)
                made["prediction"] = [prediction for prediction, _ in pairs]
                made["score"] = [score for _, score in pairs]
                results.append(made)
            yield pd.concat(results, ignore_index=True)

    return fed.mapInPandas(run, out)


def _whole_batches(frames: Iterator[pd.DataFrame]) -> Iterator[list[pd.DataFrame]]:
    """The batches that each Arrow frame completes; its last one waits for the next frame."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        last = frame["batch_id"].iloc[-1] if len(frame) else None
        whole = [batch for number, batch in frame.groupby("batch_id", sort=True) if number != last]
        if whole:
            yield whole
        rest = frame[frame["batch_id"] == last] if last is not None else rest
    if rest is not None and len(rest):
        yield [rest]
