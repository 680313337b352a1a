"""Scores of given models, targets of a mix and packed batches against plain loops."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from gistmeter.llm import mixing, packing, quality, toxicity
from gistmeter.llm.queries import QUERIES


def texts(count, seed):
    maker = random.Random(seed)
    words = "the Old house, stands near 42 hills! and é 你好 ... very-long-word-without-end Quiet".split()
    made = [" ".join(maker.choice(words) for _ in range(maker.randrange(1, 300))) for _ in range(count)]
    return [*made, "", None, " \t\n", "one", "x" * 3000]


def test_attention_scores_equal_a_loop():
    column = pa.array(texts(25, 1), pa.string())
    maker = np.random.default_rng(2)
    rows, number = quality.passages(column)
    features, hidden = rows.shape[1], 5
    shape = {"encode": (features, hidden), "encode_bias": (hidden,), "tanh": (hidden, hidden), "gate": (hidden, hidden), "attend": (hidden,), "score": (hidden,), "score_bias": (1,)}
    w = {k: maker.normal(size=s) for k, s in shape.items()}
    model = quality.Quality(rows.mean(0), rows.std(0) + 0.1, w)
    expected, at = [], 0
    for n in number.tolist():
        own, at = rows[at : at + n], at + n
        if not n:
            expected.append(0.0)
            continue
        hs, es = [], []
        for row in own:
            h = [math.tanh(sum(min(max((x - c) / s, -8), 8) * w["encode"][i][k] for i, (x, c, s) in enumerate(zip(row, model.centre, model.scale))) + w["encode_bias"][k]) for k in range(hidden)]
            t = [math.tanh(sum(h[i] * w["tanh"][i][k] for i in range(hidden))) for k in range(hidden)]
            g = [1 / (1 + math.exp(-sum(h[i] * w["gate"][i][k] for i in range(hidden)))) for k in range(hidden)]
            hs.append(h)
            es.append(math.exp(sum(t[k] * g[k] * w["attend"][k] for k in range(hidden))))
        z = [sum(e * h[k] for e, h in zip(es, hs)) / sum(es) for k in range(hidden)]
        expected.append(1 / (1 + math.exp(-sum(z[k] * w["score"][k] for k in range(hidden)) - w["score_bias"][0])))
    assert model(column) == pytest.approx(expected)


def test_attention_learns_one_marked_passage():
    """Documents of many plain passages are told apart by one; both classes are held out."""
    maker = random.Random(4)
    plain = lambda n: " ".join(maker.choice("alpha beta gamma delta epsilon".split()) for _ in range(n))
    bad = lambda: " ".join(maker.choice(["@@##", "%%!!", "^^&&"]) for _ in range(80))
    made = [(plain(maker.randrange(100, 400)) + (" " + bad() if k % 2 else ""), k % 2) for k in range(240)]
    column, label = pa.array([t for t, _ in made]), np.array([v for _, v in made])
    model = quality.fit(column.slice(0, 160), label[:160])
    assert ((model(column.slice(160)) >= 0.5) == label[160:]).mean() > 0.9


def test_worst_passage_scores_equal_a_loop():
    made = texts(25, 3)
    maker = np.random.default_rng(5)
    model = toxicity.Toxicity(maker.normal(size=1 << toxicity.BITS), -0.3)
    got = model(pa.array(made, pa.string()))
    for text, score in zip(made, got):
        words = (text or "").split()
        # A passage alone is its own document, so the worst of them is the whole.
        parts = [" ".join(words[k : k + toxicity.SPAN]) for k in range(0, len(words), toxicity.SPAN)]
        alone = model(pa.array(parts, pa.string())) if parts else [0.0]
        assert score == pytest.approx(max(alone))
    one = toxicity.Subwords(pa.array(["Ab cde"]))
    # "Ab" and "cde" themselves; with their ends marked, 2 + 1 + 0 and 3 + 2 + 1 grams of 3, 4 and 5 bytes.
    assert one.sizes.tolist() == [2 + 3 + 6]
    same, other = (toxicity.Subwords(pa.array([t])).buckets[1] for t in ("AB", "ab"))
    assert same.tolist() == other.tolist()


def plain_targets(sizes, weights, share, most):
    """Excess goes to the others by weight until none is above."""
    target, open_, budget = {}, list(sizes), share * sum(sizes.values())
    while open_:
        whole = sum(weights[s] for s in open_)
        above = [s for s in open_ if budget * weights[s] / whole > most * sizes[s]]
        if not above:
            return target | {s: budget * weights[s] / whole for s in open_}
        for s in above:
            target[s] = most * sizes[s]
            budget -= target[s]
            open_.remove(s)
    return target


def test_mix_comes_near_its_targets(spark, data):
    got = QUERIES["op2_mixing"](spark, data).collect()
    again = QUERIES["op2_mixing"](spark, data).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    source = dict(duckdb.sql(f"SELECT doc_id, source FROM '{data}/documents.parquet'").fetchall())
    sizes, taken, goal = {}, {}, {}
    for r in got:
        s = source[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        goal[s] = r.target
        assert 0 <= r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    expected = plain_targets(sizes, weights, 1.5, 2.0)
    for s in order:
        assert goal[s] == pytest.approx(expected[s])
        # Near: no farther than the shortest text left out could mend; all texts are taken equally often, or once more.
        most = int(expected[s] // max(sizes[s], 1)) + 1
        spare = [r.size for r in got if source[r.doc_id] == s and 0 < r.size and r.taken < most * r.size]
        assert taken[s] <= round(expected[s]) and round(expected[s]) - taken[s] < min(spare, default=1)


def test_batches_equal_a_plain_packer(spark, data):
    got = packing.pack(spark.read.parquet(f"{data}/documents.parquet"), buckets=4, budget=3000).collect()
    batches = {}
    for r in got:
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for bucket in {b for b, _ in batches}:
        rows = [r for r in got if r.bucket == bucket]
        padded = max(max(r.length for r in rows), 1)
        fits = max(3000 // padded, 1)
        assert {r.padded_length for r in rows} == {padded}
        # A plain packer fills one batch after the other.
        sizes = sorted((len(batches[key]) for key in batches if key[0] == bucket), reverse=True)
        whole, rest = divmod(len(rows), fits)
        assert sizes == [fits] * whole + ([rest] if rest else [])
    for (_, _), rows in batches.items():
        assert sorted(r.slot for r in rows) == list(range(len(rows))) and {r.batch_docs for r in rows} == {len(rows)}
        assert rows[0].over_budget == (rows[0].padded_length > 3000)
