import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gistmeter.functions import batches as B
from gistmeter.functions import vectors as V
from gistmeter.functions.text import rouge_tokens
from gistmeter.operators import batching, bias, corpus, embedding, ranking, reshape, selection, splits, summarize, trials
from gistmeter.operators import vocabulary as vocabulary_module
from gistmeter.operators.vocabulary import build_vocabulary, decode, encode


def test_global_rank_splits_a_hot_value(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 50).alias("v"))
    ranked = ranking.global_rank(df.repartition(5), "v", "id").collect()
    expected = sorted((r["v"], r["id"]) for r in ranked)
    assert [(r["v"], r["id"]) for r in sorted(ranked, key=lambda r: r["rank"])] == expected
    assert sorted(r["rank"] for r in ranked) == list(range(1, 3001))


def test_rank_without_a_unique_key_and_of_nothing(spark):
    same = spark.range(500).select(F.lit(1).alias("v"))
    assert sorted(r["rank"] for r in ranking.global_rank(same, "v").collect()) == list(range(1, 501))
    assert ranking.global_rank(same.where("v > 1"), "v").collect() == []


def test_rank_within_a_hot_group(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 20).alias("g"), "id")
    seen = {}
    for r in ranking.rank_within(df, "g", F.col("id").desc()).collect():
        seen.setdefault(r["g"], {})[r["rank"]] = r["id"]
    for rows in seen.values():
        assert [rows[i] for i in range(1, len(rows) + 1)] == sorted(rows.values(), reverse=True)


@pytest.mark.parametrize("limit", [0, 1000])
def test_lookup_join_both_ways(spark, limit):
    rows = spark.range(900).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 40).alias("k"), "id")
    table = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = ranking.lookup_join(rows, table, "k", limit).collect()
    assert len(got) == 900 and all(r["v"] == 2 * r["k"] for r in got)


@pytest.mark.parametrize("rows", [1, 7, 200, 1001])
def test_splits_are_exact_and_stable(spark, rows):
    df = spark.range(rows)
    two = {r["id"]: r["split"] for r in splits.split_two(df, "id").collect()}
    again = {r["id"]: r["split"] for r in splits.split_two(df.repartition(7), "id").collect()}
    assert two == again and len(two) == rows
    assert Counter(two.values())["eval"] == math.ceil(rows / 10)
    three = Counter(r["split"] for r in splits.split_three(df, "id").collect())
    held = math.ceil(rows / 5)
    assert three["eval"] == math.ceil(held / 2) and three["test"] == held - math.ceil(held / 2)


def test_splits_refine_digit_by_digit(spark, monkeypatch):
    df = spark.range(500)
    whole = {r["id"]: r["split"] for r in splits.split_three(df, "id").collect()}
    monkeypatch.setattr(splits, "_STEP", 1)
    assert {r["id"]: r["split"] for r in splits.split_three(df, "id").collect()} == whole


def test_split_with_a_repeated_key_keeps_it_on_one_side(spark):
    df = spark.range(300).select(F.when(F.col("id") < 100, -1).otherwise(F.col("id")).alias("id"))
    sides = splits.split_two(df, "id").where("id = -1").select("split").distinct().collect()
    assert len(sides) == 1


def test_top_k_keeps_all_rows_of_an_id(spark):
    df = spark.createDataFrame([(1, 9.0), (1, 1.0), (2, 8.0), (3, None), (4, 8.0)], "id int, s double")
    got = selection.top_k_by_score(df, "id", "s", 2)
    assert sorted((r["id"], r["s"]) for r in got.collect()) == [(1, 1.0), (1, 9.0), (2, 8.0)]
    assert len(selection.top_rows(df, 50, "id").collect()) == 5


def test_melt_keeps_nulls_and_numbers_rows_model_by_model(spark):
    df = spark.createDataFrame([("b", "x", None), ("a", "y", "z")], "company string, m1 string, m2 string")
    got = {(r["index"], r["company"], r["model"], r["obtained_summary"]) for r in reshape.melt_with_index(df, ["company"], ["company"]).collect()}
    assert got == {(0, "a", "m1", "y"), (1, "b", "m1", "x"), (2, "a", "m2", "z"), (3, "b", "m2", None)}
    with pytest.raises(KeyError):
        reshape.flatten_struct(df.select(F.struct("company").alias("c")), "c", ["absent"])


def test_length_batches(spark):
    df = spark.range(10).select("id", (F.col("id") % 3).alias("n"))
    got = sorted(batching.length_batches(df, "id", "n").collect(), key=lambda r: r["rank"])
    assert [(r["n"], r["id"]) for r in got] == sorted((r["n"], r["id"]) for r in got)
    assert Counter(r["batch_id"] for r in got) == {0: 4, 1: 4, 2: 2}
    waste = {r["batch_id"]: r["waste"] for r in batching.padding_waste(batching.length_batches(df, "id", "n"), "n").collect()}
    assert waste == {0: 0.0, 1: pytest.approx(1 - 5 / 8), 2: 0.0}


def test_padding_and_masks(spark):
    df = spark.createDataFrame([([5, 6],), ([],)], "ids array<int>")
    width = F.lit(4)
    padded = B.pad(F.col("ids"), width)
    row = df.select(
        padded.alias("p"), B.attention_mask(F.col("ids"), width).alias("a"), B.global_attention_mask(padded).alias("g"),
        B.mask_labels(padded).alias("l"), B.unmask_labels(B.mask_labels(padded)).alias("u"), B.truncate(padded, 3).alias("t"),
        B.real_length(padded).alias("n"),
    ).first()
    assert row["p"] == [5, 6, 1, 1] and row["a"] == [1, 1, 0, 0] and row["g"] == [1, 0, 0, 0]
    assert row["l"] == [5, 6, -100, -100] and row["u"] == row["p"] and row["t"] == [5, 6, 1] and row["n"] == 2


@pytest.mark.parametrize("limit", [0, 10_000])
def test_vocabulary_round_trip(spark, limit):
    df = spark.createDataFrame([(1, "b a a c"), (2, ""), (3, "a b")], "id int, text string")
    vocabulary = build_vocabulary(df, rouge_tokens("text"))
    assert {r["token"]: r["token_id"] for r in vocabulary.collect()} == {"a": 4, "b": 5, "c": 6}
    coded = encode(df, "id", rouge_tokens("text"), vocabulary, limit)
    assert {r["id"]: r["input_ids"] for r in coded.collect()} == {1: [0, 5, 4, 4, 6, 2], 2: [0, 2], 3: [0, 4, 5, 2]}
    assert {r["id"]: r["text"] for r in decode(coded, "id", "input_ids", vocabulary, limit).collect()} == {
        1: "b a a c", 2: "", 3: "a b"}


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.coalesce(1).select(V.l2_normalize(F.col("a")).alias("n"), V.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert rows[0]["n"] == pytest.approx([0.6, 0.8]) and rows[0]["c"] == pytest.approx(0.96)
    assert rows[1]["n"] is None and rows[1]["c"] is None


def test_pooling_with_everything_masked(spark):
    df = spark.createDataFrame([("x", [1.0, 3.0], 1), ("x", [3.0, 5.0], 1), ("x", [9.0, 9.0], 0), ("y", [2.0, 2.0], 0)], "g string, v array<float>, m int")
    got = {r["g"]: r["v"] for r in embedding.mean_pool(df, ["g"], "v", 2, F.col("m")).collect()}
    assert got == {"x": [2.0, 4.0], "y": [0.0, 0.0]}
    whole = df.groupBy("g").agg(F.collect_list("v").alias("vs")).select("g", V.pooled(F.col("vs"), 2).alias("v"))
    assert {r["g"]: r["v"] for r in whole.collect()}["y"] == [2.0, 2.0]


def test_greedy_match_against_the_full_product(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=(rng.integers(0, 9), 3)).tolist(), rng.normal(size=(5, 3)).tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, p array<array<float>>, g array<array<float>>")
    for r in embedding.greedy_match(df, "p", "g").collect():
        p, g = np.array(r["p"], dtype=float), np.array(r["g"], dtype=float)
        if not len(p):
            assert r["match_f1"] == 0
            continue
        full = (p / np.linalg.norm(p, axis=1, keepdims=True)) @ (g / np.linalg.norm(g, axis=1, keepdims=True)).T
        a, b = full.max(axis=1).mean(), full.max(axis=0).mean()
        assert (r["match_precision"], r["match_recall"]) == pytest.approx((a, b))
    monkeypatch.setattr(V, "_BLOCK", 2)
    left, right = rng.normal(size=(7, 3)), rng.normal(size=(5, 3))
    a, b = V.best_matches(left, right)
    full = V._unit_rows(left) @ V._unit_rows(right).T
    assert np.allclose(a, full.max(axis=1)) and np.allclose(b, full.max(axis=0))


def test_bootstrap_interval(spark):
    df = spark.range(400).select("id", (F.col("id") % 10).cast("double").alias("x"), F.lit(2.0).alias("c"))
    got = {r["metric"]: r for r in corpus.bootstrap_interval(df, "id", ["x", "c"], 200).collect()}
    assert got["c"]["low"] == got["c"]["high"] == 2.0
    assert got["x"]["low"] < 4.5 < got["x"]["high"] and abs(got["x"]["mid"] - 4.5) < 0.1
    other = corpus.bootstrap_interval(df.repartition(9), "id", ["x"], 200).first()
    assert other["mid"] == pytest.approx(got["x"]["mid"])


def test_bias(spark):
    df = spark.createDataFrame([("Non-biased", 0.9, 0.5), ("Biased", 0.95, 0.5)], "l string, s double, f double")
    score = bias.bias_score(F.col("l"), F.col("s"))
    got = df.coalesce(1).select(score.alias("b"), bias.penalized_score(F.col("f"), score).alias("p")).collect()
    assert [r["b"] for r in got] == pytest.approx([0.1, 0.95]) and [r["p"] for r in got] == pytest.approx([60, 50])


def trial_frame(spark, values):
    rows = [(t, i, float(v)) for t, vs in values.items() for i, v in enumerate(vs, 1)]
    return spark.createDataFrame(rows, "trial string, it int, m double")


def test_trials(spark):
    df = trial_frame(spark, {"a": [1, 3, 3], "b": [3], "c": [-1, -2]})
    best = trials.best_record(df, "trial", "it", "m", [])
    assert {(r["trial"], r["m"], r["it"]) for r in best.collect()} == {("a", 3, 2), ("b", 3, 1), ("c", -1, 1)}
    assert trials.best_trial(best, "trial", "m").first()["trial"] == "a"
    assert trials.best_trial(best.where("trial = 'c'"), "trial", "m").collect() == []


def test_plateau(spark):
    df = trial_frame(spark, {"flat": [1, 5, 5, 5, 5, 5], "rising": [1, 2, 3, 4, 5], "single": [2]})
    stops = {r["trial"]: r["stop_iteration"] for r in trials.first_plateau(df, "trial", "it", "m").collect()}
    assert stops == {"flat": 5}
    early = {r["trial"]: r["stop_iteration"] for r in trials.first_plateau(df, "trial", "it", "m", min_results=1).collect()}
    assert early == {"flat": 1, "rising": 1, "single": 1}


def test_summaries_see_whole_batches(spark):
    rows = [(i, "word " * (i % 7) + ". End here.") for i in range(30)]
    df = spark.createDataFrame(rows, "id int, text string")

    def load():
        return lambda batch: [(str(sorted(batch["id"])), float(len(batch))) for _ in range(len(batch))]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = summarize.batch_summarize(df, "id", "text", load, 4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    order = sorted(range(30), key=lambda i: (len(rows[i][1]), i))
    whole = {i: str(sorted(order[k : k + 4])) for k in range(0, 30, 4) for i in order[k : k + 4]}
    assert {r["id"]: r["prediction"] for r in got} == whole


def test_central_sentence(spark):
    df = spark.createDataFrame([(1, "Dogs bark. Cats and cats. Birds."), (2, "")], "id int, text string")
    got = {r["id"]: (r["prediction"], r["score"]) for r in summarize.batch_summarize(df, "id", "text").collect()}
    assert got == {1: ("Cats and cats.", pytest.approx(5 / 3)), 2: ("", 0.0)}


def test_frequent_tokens_are_looked_up_where_the_text_is(spark):
    """Only what the frequent tokens leave open is joined, and rare, unknown and repeated ones come out in place."""
    rows = [(k, f"the of the {'and ' * (k % 3)}r{k} r{k} the s{k // 2}") for k in range(60)] + [(60, None), (61, "")]
    texts = spark.createDataFrame(rows, "id long, text string")
    made = build_vocabulary(texts.where("id % 7 <> 0"), rouge_tokens("text"))
    ids = {r["token"]: r["token_id"] for r in made.collect()}
    want = {k: [0, *(ids.get(t, 3) for t in (text or "").split()), 2] for k, text in rows}
    names = {i: t for t, i in ids.items()}
    for held in (0, 1, 3, 40, 10_000):
        coded = encode(texts, "id", rouge_tokens("text"), made, held)
        assert {r["id"]: r["input_ids"] for r in coded.collect()} == want
        back = {r["id"]: r["text"] for r in decode(coded, "id", "input_ids", made, held).collect()}
        assert back == {k: " ".join(names[i] for i in v if i > 3) for k, v in want.items()}
    counted = made.withColumn("n", F.col("n").cast("long"))
    for rows_held in (0, 1, 3, 1000):
        some = vocabulary_module.frequent_items(counted, "token", "token_id", "n", rows_held)[0].to_pylist()
        assert len(some) <= rows_held and (rows_held < 1000 or set(some) == set(ids))
        assert rows_held != 1 or some == ["the"]
    plan = encode(texts, "id", rouge_tokens("text"), made, 3)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and "array_remove" not in "".join(moved) and "SortMergeJoin" not in plan
