"""Unknown tokens, empty sides, NaN scores, gaps and broken keys."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from gistmeter.functions import lcs
from gistmeter.functions.text import rouge_tokens
from gistmeter.functions.vectors import best_matches
from gistmeter.operators import bias, corpus, selection, splits, summarize, trials
from gistmeter.operators.vocabulary import build_vocabulary, decode, encode
from gistmeter.plans.scoring import score_vectors, score_wide_vectors
from gistmeter.sources import sinks

NAN = float("nan")


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_unknown_tokens_keep_their_place(spark, broadcast_rows):
    learnt = spark.createDataFrame([("a b c",)], "text string")
    vocabulary = build_vocabulary(learnt, rouge_tokens("text"))
    texts = spark.createDataFrame([(1, "a zzz b qqq"), (2, ""), (3, None)], "id long, text string")
    encoded = encode(texts, "id", rouge_tokens("text"), vocabulary, broadcast_rows)
    assert {r.id: r.input_ids for r in encoded.collect()} == {1: [0, 4, 3, 5, 3, 2], 2: [0, 2], 3: [0, 2]}
    ids = spark.createDataFrame([(1, [0, 4, 3, 5, 99, 2]), (2, [0, 2])], "id long, ids array<int>")
    assert {r.id: r.text for r in decode(ids, "id", "ids", vocabulary, broadcast_rows).collect()} == {1: "a b <unk>", 2: ""}


def test_every_pair_has_vector_scores(spark):
    pairs = spark.createDataFrame([(1, "a q", "a"), (2, "", "a"), (3, "a", "a")], "id long, p string, g string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, vector array<double>")
    token_id = F.when(F.col("token") == "a", 1).otherwise(2)
    got = {r.id: r for r in score_vectors(pairs, ["id"], "p", "g", vectors, token_id, 2).collect()}
    assert (got[1].match_precision, got[1].match_recall) == (0.5, 1.0) and got[1].match_f1 == pytest.approx(2 / 3)
    assert (got[2].cosine, got[2].match_precision, got[2].match_recall, got[2].match_f1) == (None, 0, 0, 0)
    assert got[3].match_f1 == 1


def test_zero_vector_matches_nothing():
    left, right = best_matches(np.array([[1.0, 0], [0, 0]]), np.array([[-1.0, 0]]))
    assert left.tolist() == [-1, 0] and right.tolist() == [-1]


def test_nan_is_no_result(spark):
    log = spark.createDataFrame([("x", 1, NAN), ("x", 2, 0.5), ("y", 1, NAN)], "trial string, i int, m double")
    best = trials.best_record(log, "trial", "i", "m", [])
    assert [(r.trial, r.m) for r in best.collect()] == [("x", 0.5)]
    named = spark.createDataFrame([("x", 0.5), ("y", NAN)], "trial string, m double")
    assert trials.best_trial(named, "trial", "m").first().trial == "x"
    assert [r.trial for r in selection.top_k_by_score(named, "trial", "m", 1).collect()] == ["x"]


def test_plateau_over_results_with_gaps(spark):
    log = spark.createDataFrame([("x", i, 0.5) for i in (1, 3, 5, 7, 9)], "trial string, i int, m double")
    assert trials.first_plateau(log, "trial", "i", "m").first().stop_iteration == 7


def test_missing_bias_is_no_score(spark):
    row = spark.createDataFrame([(0.5, None), (0.5, 0.2)], "f double, b double")
    assert [r[0] for r in row.select(bias.penalized_score(F.col("f"), F.col("b"))).collect()] == [None, 60.0]


def test_null_keys_have_no_place_in_a_split(spark):
    with pytest.raises(ValueError):
        splits.split_two(spark.createDataFrame([(1,), (None,)], "k long"), "k")


def test_long_lines_stay_in_bounds():
    """One line of many words, all different or few: the walk back must not keep the whole table."""
    maker = random.Random(5)
    for different in (20, 40_000):
        left, right = ([maker.randrange(different) for _ in range(20_000)] for _ in range(2))
        tracemalloc.start()
        hits = lcs.summary_hits([left], [right])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert hits == lcs.lcs_size(left, right) and peak < 20_000_000


def test_lines_that_share_no_word_are_skipped(monkeypatch):
    visited = []
    monkeypatch.setattr(lcs, "lcs_places", lambda line, where, width: visited.append(width) or set())
    assert lcs.summary_hits([["a", "b"]], [["c"] * 3, ["b", "x"], ["d"]]) == 0 and visited == [2]
    assert lcs.summary_hits([["a", "b"]], [["c"], ["a", "b"]]) == 2 and visited == [2]


def test_evaluate_from_ids(spark):
    learnt = spark.createDataFrame([("dogs bark at cats",)], "text string")
    vocabulary = build_vocabulary(learnt, rouge_tokens("text"))
    code = {r.token: r.token_id for r in vocabulary.collect()}
    made = [0, code["dogs"], 3, code["bark"], 2, 1]
    labels = [0, code["dogs"], code["bark"], 2, -100, -100]
    rows = spark.createDataFrame([(1, made, labels, 0.2), (2, [0, 2, 1], labels, None)], "id int, p array<int>, l array<int>, b double")
    got = corpus.evaluate_ids(rows, "id", "p", "l", vocabulary, "b").first()
    assert (got.rouge1, got.rougelsum, got.gen_len, got.penalized) == (50.0, 50.0, 3.5, 100.0)


def test_percentiles_of_a_hot_configuration(spark):
    rows = [("hot", float(i)) for i in range(1, 201)] + [("one", 7.0), ("hot", None), (None, 1.0)]
    timed = spark.createDataFrame(rows, "c string, s double")
    got = {r.c: (r.p50_seconds, r.p90_seconds, r.p99_seconds) for r in trials.latency_percentiles(timed, "c", "s").collect()}
    assert got == {"hot": (100.0, 180.0, 198.0), "one": (7.0, 7.0, 7.0)}


def test_best_of_each_split(spark):
    rows = spark.createDataFrame([(i, float(i), "a" if i % 2 else "b") for i in range(10)], "id int, s double, side string")
    got = selection.top_k_per_split(rows, "side", "id", "s", {"a": 2, "b": 1})
    assert sorted(r.id for r in got.collect()) == [7, 8, 9]


def test_repeated_ids_fan_out_in_a_join(spark):
    texts = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "id int, text string")
    made = spark.createDataFrame([(1, "p"), (1, "q")], "id int, prediction string")
    assert texts.join(made, "id").count() == 4


def test_only_texts_and_keys_move_before_a_prediction(spark):
    texts = spark.createDataFrame([(1, "One. Two."), (2, "Three.")], "id int, text string")
    plan = summarize.batch_summarize(texts, "id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "sentences" in plan.split("RepartitionByExpression")[0]
    assert "sentences" not in plan.split("RepartitionByExpression", 1)[1]


def test_merge_refuses_repeated_keys(spark):
    changes = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    with pytest.raises(ValueError):
        sinks.merge_table(changes, "no_such_table", ["k"])


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_a_hot_token_outside_the_vocabulary(spark, broadcast_rows):
    """Found among the rows' own frequent keys, so it never reaches the shuffled join; nor do repeated tokens."""
    vocabulary = build_vocabulary(spark.createDataFrame([("a b",)], "text string"), rouge_tokens("text"))
    texts = spark.range(300).select("id", F.concat_ws(" ", F.lit("hot hot hot a a"), F.col("id").cast("string")).alias("text"))
    got = encode(texts, "id", rouge_tokens("text"), vocabulary, broadcast_rows)
    assert {tuple(r.input_ids) for r in got.collect()} == {(0, 3, 3, 3, 4, 4, 3, 2)}


def test_only_distinct_tokens_leave_a_text(spark):
    """No exchange has a row per occurrence: what is exploded is distinct, and no vector crosses an exchange on its own."""
    vocabulary = build_vocabulary(spark.createDataFrame([("a b c",)], "text string"), rouge_tokens("text"))
    texts = spark.createDataFrame([(1, "a b a " * 50)], "id long, text string")
    for broadcast_rows in (0, 1000):
        plan = encode(texts, "id", rouge_tokens("text"), vocabulary, broadcast_rows)._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode" not in plan and plan.count("explode(array_distinct(") == plan.count("Generate ")
    pairs = spark.createDataFrame([(1, "a b a", "a")], "id long, p string, g string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, vector array<double>")
    scored = score_vectors(pairs, ["id"], "p", "g", vectors, F.length("token").cast("long"), 2)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(") == 1 and "explode(array_distinct(" in plan
    executed = scored._jdf.queryExecution().executedPlan().toString()
    for line in executed.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "vector" not in line.split("Exchange", 1)[1]


def test_vector_scores_of_several_models(spark):
    """All models of a row against plain matrices: repeats, zero vectors, tokens without one, empty and missing texts."""
    rng = np.random.default_rng(8)
    held = {k: rng.normal(size=3).tolist() if k % 5 else [0.0] * 3 for k in range(1, 9)}
    vectors = spark.createDataFrame([*held.items()], "vec_id long, vector array<double>")
    word = lambda k: "x" * k
    texts = [None, "", word(5), word(11)] + [" ".join(word(int(k)) for k in rng.integers(1, 11, n)) for n in (1, 3, 9, 30, 2500)]
    rows = [(k, texts[k], *[texts[(k * 2 + j) % len(texts)] for j in range(3)]) for k in range(len(texts))]
    wide = spark.createDataFrame(rows, "id int, gold string, m0 string, m1 string, m2 string")
    got = {(r.id, r.model): r for r in score_wide_vectors(wide, ["id"], "gold", vectors, F.length("token").cast("long"), 3).collect()}
    assert len(got) == 3 * len(rows)
    for k, gold, *models in rows:
        for j, text in enumerate(models):
            sides = [(t or "").split() for t in (text, gold)]
            p, g = [np.array([held[len(t)] for t in side if len(t) in held]).reshape(-1, 3) for side in sides]
            best = [a.sum() / len(s) if len(s) and len(p) and len(g) else 0 for a, s in zip(best_matches(p, g) if len(p) and len(g) else [np.zeros(1)] * 2, sides)]
            # A token of both sides matches itself.
            row = got[k, f"m{j}"]
            assert [row.match_precision, row.match_recall] == pytest.approx(best, abs=1e-9)
            size = np.linalg.norm(p.sum(0)) * np.linalg.norm(g.sum(0)) if len(p) and len(g) else 0
            assert (row.cosine is None) == (size == 0)
            assert size == 0 or row.cosine == pytest.approx(p.sum(0) @ g.sum(0) / size)
