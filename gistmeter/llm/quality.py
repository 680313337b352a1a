"""Quality: attention-based multiple-instance learning over passages (Ilse et al., 2018).

A document is a bag of passages of ``SPAN`` words. Each passage is encoded from its shape (characters, words,
repetition); gated attention, learnt from the labels of whole documents, weighs the passages, and the weighted
representation is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gistmeter.llm.shared import Words, pieces
from gistmeter.llm.training import labelled_sample, score_documents

SPAN = 64
HIDDEN = 16
#: Labels are learnt from rows whose crc32(doc_id) mod 5 is not 0.
PARTS, HELD = 5, 0


def _classes() -> np.ndarray:
    """Class of each byte: punctuation characters one by one, then digits, small and large letters, blanks, others."""
    out = np.full(256, 36, np.int64)
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    out[marks] = np.arange(len(marks))
    out[48:58], out[97:123], out[65:91] = 32, 33, 34
    out[[32, 9, 10, 11, 12, 13]] = 35
    out[128:] = 37
    return out


CLASSES = 38


def passages(column: pa.Array, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the number of passages of each text."""
    words = Words(column)
    count = words.count
    number = -(-count // span)
    total = int(number.sum())
    if not total:
        return np.zeros((0, CLASSES + 12)), number
    first = np.cumsum(number) - number
    inside = np.arange(len(words.starts)) - np.repeat(words.of_text[:-1], count)
    of_word = np.repeat(first, count) + inside // span
    begins = np.flatnonzero(np.diff(of_word, prepend=-1))
    held = np.diff(np.append(begins, len(of_word))).astype(np.float64)
    # A passage reaches from its first word to the first word of the next, or to the end of its text.
    start = words.starts[begins]
    text_end = np.repeat(words.bounds[1:], number)
    stop = np.minimum(np.append(start[1:], len(words.data)), text_end)
    sizes = (stop - start).astype(np.float64)
    spread = np.repeat(np.arange(total), stop - start)
    covered = np.repeat(start - np.cumsum(stop - start) + (stop - start), stop - start) + np.arange(len(spread))
    kinds = np.bincount(spread * CLASSES + _classes()[words.data[covered]], minlength=total * CLASSES).reshape(total, CLASSES)
    share = kinds / sizes[:, None]
    prints = words.fingerprints()
    lengths = (words.ends - words.starts).astype(np.float64)
    mean = np.add.reduceat(lengths, begins) / held
    square = np.add.reduceat(lengths**2, begins) / held
    same = np.zeros(len(prints))
    same[1:] = prints[1:] == prints[:-1]
    same[begins] = 0
    order = np.lexsort((prints, of_word))
    fresh = np.ones(len(prints))
    fresh[1:] = (prints[order][1:] != prints[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    tail = words.data[words.ends - 1]
    head = words.data[words.starts]
    letter_end = ((tail >= 97) & (tail <= 122)) | ((tail >= 65) & (tail <= 90)) | (tail >= 128)
    stop_end = (tail == 46) | (tail == 33) | (tail == 63)
    capital = (head >= 65) & (head <= 90)
    only_marks = (lengths <= 3) & ~letter_end & ~((tail >= 48) & (tail <= 57)) & ~((head >= 65) & (head <= 122)) & (head < 128)
    rate = lambda v: np.add.reduceat(v.astype(np.float64), begins) / held
    letters = kinds[:, 33] + kinds[:, 34] + 1.0
    more = np.stack(
        [
            mean / 10,
            np.sqrt(np.maximum(square - mean**2, 0)) / 10,
            rate(same),
            np.add.reduceat(fresh, begins) / held,
            rate(letter_end),
            rate(stop_end),
            rate(capital),
            rate(only_marks),
            kinds[:, 34] / letters,
            kinds[:, :32].sum(1) / sizes,
            np.log(held) / 4,
            np.maximum.reduceat(lengths, begins) ** 0.5 / 10,
        ],
        axis=1,
    )
    return np.concatenate([np.sqrt(share), more], axis=1), number


def _bag_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, at, axis=0)


@dataclass
class Quality:
    """Normalisation, encoder, gated attention and scorer."""

    centre: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    flat: float | None = None

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        w, at = self.weights, np.cumsum(sizes) - sizes
        h = np.tanh(x @ w["encode"] + w["encode_bias"])
        t, g = np.tanh(h @ w["tanh"]), 1 / (1 + np.exp(-h @ w["gate"]))
        e = (t * g) @ w["attend"]
        e = e - np.repeat(np.maximum.reduceat(e, at), sizes)
        a = np.exp(e)
        a = a / np.repeat(_bag_sums(a, at), sizes)
        z = _bag_sums(a[:, None] * h, at)
        logit = z @ w["score"] + w["score_bias"][0]
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(logit, -60, 60))), "at": at}

    def __call__(self, column: pa.Array) -> np.ndarray:
        x, number = passages(column)
        out = np.zeros(len(number))
        some = number > 0
        if self.flat is not None:
            out[some] = self.flat
        elif some.any():
            out[some] = self.forward(np.clip((x - self.centre) / self.scale, -8, 8), number[some])["p"]
        return out


def fit(texts: pa.Array, labels: np.ndarray, epochs: int = 40, rate: float = 0.01, seed: int = 7) -> Quality:
    """Adam on the log loss of whole documents; the gradient of the attention is written out.

    Without both classes every text scores as the class that was seen (1 without any label).
    """
    # Piece by piece, since the arrays of bytes are many times the text.
    parts = [passages(p.column("text")) for p in pieces(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", 1 << 20)]
    x, number = (np.concatenate(v) for v in zip(*parts)) if parts else (np.zeros((0, 1)), np.zeros(0, np.int64))
    some = number > 0
    label, sizes = labels[some].astype(np.float64), number[some]
    if len(set(label.tolist())) < 2:
        return Quality(np.zeros(1), np.ones(1), {}, float(label.mean()) if len(label) else 1.0)
    centre, scale = x.mean(0), x.std(0) + 1e-3
    x = np.clip((x - centre) / scale, -8, 8)
    random = np.random.default_rng(seed)
    shape = {"encode": (x.shape[1], HIDDEN), "encode_bias": (HIDDEN,), "tanh": (HIDDEN, HIDDEN), "gate": (HIDDEN, HIDDEN), "attend": (HIDDEN,), "score": (HIDDEN,), "score_bias": (1,)}
    w = {k: random.normal(0, 1 / np.sqrt(s[0]), s) * (not k.endswith("bias")) for k, s in shape.items()}
    model = Quality(centre, scale, w)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in w.items()}
    at_all = np.cumsum(sizes) - sizes
    balance = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean()))
    step = 0
    for epoch in range(epochs):
        pace = rate * (1 - epoch / epochs) + 1e-4
        for batch in np.array_split(random.permutation(len(sizes)), max(1, len(sizes) // 128)):
            size = sizes[batch]
            rows = np.repeat(at_all[batch] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            xb = x[rows]
            f = model.forward(xb, size)
            error = (f["p"] - label[batch]) * balance[batch] / len(batch)
            grad = {"score": f["z"].T @ error, "score_bias": np.array([error.sum()])}
            dz = np.repeat(error[:, None] * w["score"], size, axis=0)
            da = (dz * f["h"]).sum(1)
            de = f["a"] * (da - np.repeat(_bag_sums(f["a"] * da, f["at"]), size))
            gated = de[:, None] * w["attend"]
            grad["attend"] = (f["t"] * f["g"]).T @ de
            dt, dg = gated * f["g"] * (1 - f["t"] ** 2), gated * f["t"] * f["g"] * (1 - f["g"])
            grad["tanh"], grad["gate"] = f["h"].T @ dt, f["h"].T @ dg
            dh = f["a"][:, None] * dz + dt @ w["tanh"].T + dg @ w["gate"].T
            dh *= 1 - f["h"] ** 2
            grad["encode"], grad["encode_bias"] = xb.T @ dh, dh.sum(0)
            step += 1
            for k, g in grad.items():
                g = g + 1e-4 * w[k]
                m = moments[k]
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.999 * m[1] + 0.001 * g**2
                w[k] -= pace * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return model


def quality(docs: DataFrame, labels: DataFrame, rows: int = 2000, row_bytes: int = 40_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``, as ``labels.quality`` marks it.

    Fitted on the driver from at most ``rows`` labelled documents of each class, none over ``row_bytes`` bytes;
    all passages of every whole text are scored. A null text, or one without words, scores 0. Repeated rows
    score alike. Other columns are not read; an empty table gives an empty result; without labels every text
    with words scores 1, so nothing is rejected unlearnt.
    """
    model = fit(*labelled_sample(docs, labels, "quality", PARTS, HELD, rows, row_bytes))
    return score_documents(docs, model, PARTS, HELD)


def good_documents(docs: DataFrame, labels: DataFrame, rows: int = 2000, row_bytes: int = 40_000) -> DataFrame:
    """The rows of ``docs`` that score 0.3 or more, with all their columns, in one pass; see ``quality``."""
    model = fit(*labelled_sample(docs, labels, "quality", PARTS, HELD, rows, row_bytes))

    def run(batches):
        for batch in batches:
            # Whole rows pass by, so half as much text as usual is turned into features at once.
            for piece in pieces(batch, "text", 1 << 20):
                yield piece.filter(pa.array(model(piece.column("text")) >= 0.3))

    return docs.mapInArrow(run, docs.schema)
