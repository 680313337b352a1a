"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is its own bucket and those of its 3- to 5-byte grams, word ends marked, so an unseen spelling shares
most vectors with the known one (Joulin et al., 2016; Bojanowski et al., 2017). A passage of ``SPAN`` words is
the mean of its subword vectors and goes through a linear softmax; a document scores as its worst passage, so
that a long text does not thin out one offensive sentence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gistmeter.llm.shared import Words, mixed, odd_numbers, pieces, text_of
from gistmeter.llm.training import labelled_sample, score_documents

SPAN = 8
BITS = 18
GRAMS = (3, 4, 5)
#: Labels are learnt from rows whose crc32(doc_id) mod 4 is not 2.
PARTS, HELD = 4, 2


class Subwords:
    """Buckets of the subwords of some texts, and the passage that each belongs to."""

    def __init__(self, column: pa.Array, span: int = SPAN, bits: int = BITS):
        words = Words(column, lower=True)
        count = words.count
        self.passages = -(-count // span)
        first = np.cumsum(self.passages) - self.passages
        inside = np.arange(len(words.starts)) - np.repeat(words.of_text[:-1], count)
        self.total = int(self.passages.sum())
        of_word = np.repeat(first, count) + inside // span
        shift = np.uint64(64 - bits)
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] = lower[97:123]
        sizes = words.ends - words.starts
        at = np.cumsum(sizes + 2) - (sizes + 2)
        marked = np.full(int((sizes + 2).sum()) + max(GRAMS), 3, np.uint8)
        if len(sizes):
            spot = np.repeat(at + 1 - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
            source = np.repeat(words.starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
            marked[spot] = lower[words.data[source]]
            marked[at] = 2
        end = np.repeat(at + sizes + 2, sizes + 2)
        place = np.arange(len(end))
        passage = np.repeat(of_word, sizes + 2)
        buckets, owners = [mixed(words.fingerprints()) >> shift], [of_word]
        packed = np.zeros(len(end), np.uint64)
        for k in range(max(GRAMS)):
            packed |= marked[k : k + len(end)].astype(np.uint64) << np.uint64(8 * k)
            if k + 1 in GRAMS:
                whole = place + k + 1 <= end
                grams = packed[whole] * odd_numbers(1, 10 + k)[0]
                buckets.append((grams ^ (grams >> np.uint64(29))) * odd_numbers(1, 20 + k)[0] >> shift)
                owners.append(passage[whole])
        self.buckets = [b.astype(np.int64) for b in buckets]
        self.owners = owners
        self.sizes = sum(np.bincount(o, minlength=self.total) for o in owners) if self.total else np.zeros(0)

    def means(self, value: np.ndarray) -> np.ndarray:
        """For every passage the mean of ``value`` over its subwords."""
        if not self.total:
            return np.zeros(0)
        total = sum(np.bincount(o, value[b], self.total) for b, o in zip(self.buckets, self.owners))
        return total / self.sizes


@dataclass
class Toxicity:
    """The learnt part of a score: what each bucket's vector gives to the softmax, and the bias."""

    margin: np.ndarray
    bias: float

    def __call__(self, column: pa.Array) -> np.ndarray:
        subwords = Subwords(column)
        out = np.zeros(len(subwords.passages))
        some = subwords.passages > 0
        if some.any():
            margins = subwords.means(self.margin.astype(np.float64)) + self.bias
            first = (np.cumsum(subwords.passages) - subwords.passages)[some]
            out[some] = 1 / (1 + np.exp(-np.clip(np.maximum.reduceat(margins, first), -60, 60)))
        return out


def fit(texts: pa.Array, labels: np.ndarray, size: int = 16, epochs: int = 30, rate: float = 0.5, seed: int = 3) -> Toxicity:
    """Vectors and softmax weights learnt together by AdaGrad from the worst passages of the texts.

    The offensive texts weigh 0.35 in total and the others 0.65, whatever their numbers. Without both
    classes the model scores everything by the class it saw, or 0.
    """
    n = 1 << BITS
    if len(set(labels.tolist())) < 2:
        return Toxicity(np.zeros(n, np.float32), 60.0 if labels.any() else -60.0)
    random = np.random.default_rng(seed)
    # Piece by piece, since the arrays of bytes are many times the text.
    flat, held, passages = [], [], []
    for piece in pieces(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", 1 << 19):
        part = Subwords(piece.column("text"))
        owners = np.concatenate(part.owners).astype(np.int32)
        flat.append(np.concatenate(part.buckets).astype(np.int32)[np.argsort(owners, kind="stable")])
        held.append(part.sizes)
        passages.append(part.passages)
    piece_at = np.cumsum([0, *(len(f) for f in flat)])
    sizes_of, passages = np.concatenate(held), np.concatenate(passages)
    buckets, starts = np.concatenate(flat), np.concatenate([[0], np.cumsum(sizes_of).astype(np.int64)])
    del flat
    some = np.flatnonzero(passages > 0)
    first = (np.cumsum(passages) - passages)[some]
    length, label = passages[some], labels[some]
    doc_of = text_of(length)
    vectors = random.uniform(-1 / size, 1 / size, (n, size)).astype(np.float32)
    weights = random.normal(0, 0.3, (2, size)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    vector_sum, weight_sum, bias_sum = np.full(n, 1e-6, np.float32), np.full_like(weights, 1e-6), np.full(2, 1e-6, np.float32)
    weight_of = np.where(label == 1, 0.35 / max(label.sum(), 1), 0.65 / max((label == 0).sum(), 1)) * len(label)
    for epoch in range(epochs):
        # The first rounds look at passages at random, later ones at the worst of each text.
        margin = vectors @ (weights[1] - weights[0])
        sums = np.concatenate(
            [
                np.add.reduceat(margin[buckets[a:b]], starts[np.searchsorted(starts, a) : np.searchsorted(starts, b)] - a)
                for a, b in zip(piece_at[:-1], piece_at[1:])
                if b > a
            ]
        ) / sizes_of
        if epoch < 4:
            sums = random.random(len(sums))
        top = np.lexsort((-sums, doc_of))[np.cumsum(length) - length]
        assert (doc_of[top] == np.arange(len(first))).all()
        for batch in np.array_split(random.permutation(len(first)), max(1, len(first) // 128)):
            spans = [buckets[starts[p] : starts[p + 1]] for p in top[batch]]
            sizes = np.array([len(s) for s in spans])
            flat = np.concatenate(spans)
            at = np.cumsum(sizes) - sizes
            mean = np.add.reduceat(vectors[flat], at, axis=0) / sizes[:, None]
            logits = mean @ weights.T + bias
            chance = np.exp(logits - logits.max(1, keepdims=True))
            chance /= chance.sum(1, keepdims=True)
            chance[np.arange(len(batch)), label[batch]] -= 1
            error = (chance * weight_of[batch, None]).astype(np.float32)
            into = error @ weights / sizes[:, None]
            slope = error.T @ mean
            weight_sum += slope**2
            bias_sum += error.sum(0) ** 2
            weights -= 0.1 * slope / np.sqrt(weight_sum)
            bias -= 0.1 * error.sum(0) / np.sqrt(bias_sum)
            # One summed gradient per bucket of the batch.
            rank = np.argsort(flat, kind="stable")
            ids, begin = np.unique(flat[rank], return_index=True)
            grads = np.add.reduceat(np.repeat(into, sizes, axis=0)[rank], begin, axis=0)
            vector_sum[ids] += (grads**2).mean(1)
            vectors[ids] -= rate / size * grads / np.sqrt(vector_sum[ids])[:, None]
    return Toxicity((vectors @ (weights[1] - weights[0])).astype(np.float32), float(bias[1] - bias[0]))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = 2000, row_bytes: int = 40_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``, as ``labels.toxic`` marks it.

    Fitted on the driver from at most ``rows`` labelled documents of each class, none over ``row_bytes`` bytes;
    every whole text is scored. A null text, or one without words, scores 0. Repeated rows score alike. Other
    columns are not read; an empty table gives an empty result; without labels all score 0.
    """
    model = fit(*labelled_sample(docs, labels, "toxic", PARTS, HELD, rows, row_bytes))
    return score_documents(docs, model, PARTS, HELD)
