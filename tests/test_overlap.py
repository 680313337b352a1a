import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gistmeter.functions import lcs, ngrams, overlaps, places
from gistmeter.operators import overlap
from gistmeter.operators.reshape import melt
from gistmeter.plans.scoring import score_wide
from tests import brute

TYPES = overlap.ROUGE_TYPES


def scores(spark, pairs, **options):
    rows = [(i, p, g) for i, (p, g) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "id int, p string, g string")
    out = overlap.rouge(df, "p", "g", **options).orderBy("id").collect()
    return [{t: tuple(r[t]) for t in options.get("types", TYPES)} for r in out]


CASES = [
    ("the cat sat", "the cat sat"),
    ("the cat sat", "the cat ran"),
    ("aa bb", "cc dd"),
    ("", "the cat"),
    ("the cat", ""),
    (None, "the cat"),
    ("the the the the", "the cat the"),
    ("the cat the", "the the the the"),
    ("Été à Noël: l'été!", "ete noel l"),
    ("one two\nthree four\n\nfive", "four three\ntwo one five"),
    ("a\tb a\tb", "a b a"),
]


def test_hand_computed(spark):
    same, near, apart, *_ = scores(spark, CASES)
    assert all(v == (1.0, 1.0, 1.0) for v in same.values())
    assert near["rouge1"][2] == pytest.approx(2 / 3)
    assert near["rouge2"][2] == pytest.approx(1 / 2)
    assert all(v == (0.0, 0.0, 0.0) for v in apart.values())


def random_pairs(count, seed):
    rng = random.Random(seed)
    words = ["a", "bb", "ccc", "dd", "e", "ff"]

    def text():
        return "".join(rng.choice(words) + rng.choice([" ", " ", ". ", "\n", "-"]) for _ in range(rng.randrange(40)))

    return [(text(), text()) for _ in range(count)]


def test_against_definitions(spark):
    pairs = CASES + random_pairs(150, 1)
    plain = {"rouge1": lambda p, g: brute.rouge_n(p, g, 1), "rouge2": lambda p, g: brute.rouge_n(p, g, 2),
             "rougel": brute.rouge_l, "rougelsum": brute.rouge_lsum}
    for got, (p, g) in zip(scores(spark, pairs), pairs):
        for name, value in got.items():
            assert value == pytest.approx(plain[name](p, g)), (name, p, g)
            assert all(0 <= x <= 1 for x in value)
        assert got["rougel"][1] <= got["rouge1"][1] + 1e-12


def test_swapping_sides_swaps_precision_and_recall(spark):
    pairs = random_pairs(40, 2)
    kinds = ("rouge1", "rouge2", "rougel")
    there = scores(spark, pairs, types=kinds)
    back = scores(spark, [(g, p) for p, g in pairs], types=kinds)
    for a, b in zip(there, back):
        assert all(a[k][:2] == b[k][1::-1] for k in kinds)


def test_bit_vectors_match_the_table():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.randrange(4) for _ in range(rng.randrange(25))]
        b = [rng.randrange(4) for _ in range(rng.randrange(25))]
        assert lcs.lcs_size(a, b) == brute.table(a, b)[-1][-1]
        assert lcs.lcs_places(a, lcs._positions(b), len(b)) == brute.walk(a, b)


def test_bleu(spark):
    pairs = CASES + random_pairs(80, 4) + [
        ("Costs 1,000.50 - or -5% (e.g. &quot;x&quot;).", "Costs 1,000.50 - or 5-6% (e.g. \"x\")!"),
        ("the cat sat on the mat today", "the cat sat on the mat"),
    ]
    df = spark.createDataFrame([(i, p, g) for i, (p, g) in enumerate(pairs)], "id int, p string, g string")
    for row in overlap.bleu(df, "p", "g").collect():
        assert row["bleu"] == pytest.approx(brute.bleu([(row["p"], row["g"])]))
        assert row["translation_length"] == len(brute.bleu_tokens(row["p"]))
    whole = overlap.bleu_corpus(df, "p", "g").first()
    assert whole["bleu"] == pytest.approx(brute.bleu(pairs))


def test_sentences_on_lines_for_the_summary_score(spark):
    pair = [("One two. Three four.", "Three four. One two.")]
    assert scores(spark, pair, types=("rougelsum",))[0]["rougelsum"][2] == pytest.approx(0.5)
    split = scores(spark, pair, types=("rougelsum",), split_sentences=True)
    assert split[0]["rougelsum"][2] == 1.0


def test_stemmed_scores_match_inflections(spark):
    pair = [("companies running", "company runs")]
    assert scores(spark, pair, types=("rouge1",))[0]["rouge1"][2] == 0
    assert scores(spark, pair, stem=True)[0]["rouge1"][2] == 1
    assert scores(spark, pair, stem=True)[0]["rougelsum"][2] == 1


def test_repeats_on_both_sides(spark):
    rng = random.Random(6)
    pairs = [(" ".join(rng.choices("abc", k=60)), " ".join(rng.choices("abcd", k=80))) for _ in range(30)]
    for got, (p, g) in zip(scores(spark, pairs, types=("rouge1", "rouge2", "rouge3")), pairs):
        for n in (1, 2, 3):
            assert got[f"rouge{n}"] == pytest.approx(brute.rouge_n(p, g, n))


def test_partition_invariance_and_no_shuffle(spark):
    df = spark.createDataFrame([(p, g) for p, g in random_pairs(60, 5)], "p string, g string")
    one = overlap.bleu(overlap.rouge_f(df.coalesce(1), "p", "g"), "p", "g")
    many = overlap.bleu(overlap.rouge_f(df.repartition(16), "p", "g"), "p", "g")
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    plan = overlap.bleu(overlap.rouge_f(df, "p", "g"), "p", "g")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_wide_table_scores_every_model_and_keeps_nulls(spark):
    wide = spark.createDataFrame(
        [(1, "the cat sat.", "the cat", None), (2, "a dog\nran", "a dog ran", "dog")],
        "company int, gold string, m1 string, m2 string",
    )
    got = {(r["company"], r["model"]): r for r in score_wide(wide, ["company"], "gold").collect()}
    assert set(got) == {(1, "m1"), (1, "m2"), (2, "m1"), (2, "m2")}
    assert got[1, "m2"]["obtained_summary"] is None and got[1, "m2"]["rouge1"] == 0
    for (company, _), row in got.items():
        p, g = row["obtained_summary"], {1: "the cat sat.", 2: "a dog\nran"}[company]
        assert row["rouge2"] == pytest.approx(brute.rouge_n(p, g, 2)[2])
        assert row["rougelsum"] == pytest.approx(brute.rouge_lsum(p, g)[2])
        assert row["bleu"] == pytest.approx(brute.bleu([(p, g)]))
    plain = melt(wide, ["company", "gold"])
    again = overlap.bleu(overlap.rouge_f(plain, "obtained_summary", "gold"), "obtained_summary", "gold")
    assert {(r["company"], r["model"], r["rougel"], r["bleu"]) for r in again.collect()} == {
        (*k, r["rougel"], r["bleu"]) for k, r in got.items()
    }


def test_whole_documents_against_definitions(spark, data):
    """The flagship on whole texts; definitions are applied where their quadratic table stays small."""
    from gistmeter.plans.catalog import QUERIES
    from gistmeter.plans.fixtures import wide_summaries

    texts = {r["company"]: r for r in wide_summaries(spark, data).where(F.length("gold_summary") < 1500).collect()}
    assert len(texts) > 50
    checked = 0
    for row in QUERIES["scored_summaries"](spark, data).collect():
        if row["company"] in texts:
            source = texts[row["company"]]
            p, g = source[row["model"]], source["gold_summary"]
            assert row["rougel"] == pytest.approx(brute.rouge_l(p, g)[2])
            assert row["rougelsum"] == pytest.approx(brute.rouge_lsum(p, g)[2])
            assert row["bleu"] == pytest.approx(brute.bleu([(p, g)]), abs=1e-6)
            checked += 1
    assert checked == 3 * len(texts)


def test_grams_are_numbers_and_match_counting(spark, monkeypatch):
    rng = random.Random(11)
    rows = [[[rng.choice("abc") for _ in range(rng.randrange(n))] for _ in "pg"] for n in (1, 2, 5, 30, 300) for _ in range(6)]
    monkeypatch.setattr(ngrams, "_TOKENS_AT_ONCE", 50)
    left, right = (pa.array([r[k] for r in rows], pa.list_(pa.string())) for k in (0, 1))
    cut = [*places.slices(50, left, right)]
    assert len(cut) > 5 and [n for start, size in cut for n in range(start, start + size)] == [*range(len(rows))]
    got = ngrams._hits(left.slice(3), right.slice(3), 4).tolist()
    assert got == [[sum((brute.grams(p, n) & brute.grams(g, n)).values()) for n in (1, 2, 3, 4)] for p, g in rows[3:]]
    df = spark.createDataFrame(rows, "p array<string>, g array<string>")
    assert len(df.select(ngrams.gram_hits(4)("p", "g")).collect()) == len(rows)


def test_a_text_held_by_the_other_needs_no_table(monkeypatch):
    whole = [*range(50), *range(20), *range(50)]
    part = whole[3:9] + whole[40:70] + whole[90:]
    monkeypatch.delattr(lcs, "_rows")
    assert lcs.lcs_size(part, whole) == lcs.lcs_size(whole, part) == len(part)
    assert lcs.summary_hits([part, whole[60:80]], [whole, [1, 2]]) == len(part) + 20


def test_summary_hits_with_lines_held_whole():
    rng = random.Random(12)
    for _ in range(200):
        lines = [[rng.randrange(6) for _ in range(rng.randrange(8))] for _ in range(rng.randrange(1, 6))]
        other = [[t for t in line if rng.random() < 0.8] for line in lines] + [sum(lines, [])][: rng.randrange(2)]
        text = lambda rows: "\n".join(" ".join(f"w{t}" for t in row) for row in rows)
        hits = lcs.summary_hits([x for x in lines if x], [x for x in other if x])
        want = brute.rouge_lsum(text(other), text(lines))
        assert hits / max(sum(map(len, lines)), 1) == pytest.approx(want[1])


def test_few_rows_become_lists_at_once(monkeypatch):
    seen, codes = [], lcs._codes
    monkeypatch.setattr(lcs, "_codes", lambda *c: seen.append(max(map(len, c))) or codes(*c))
    rows = [("a b c d e".split(), "a x c e b".split())] * 300
    left, right = (pa.array([r[k] for r in rows]) for k in (0, 1))
    monkeypatch.setattr(lcs, "_TOKENS_AT_ONCE", 100)
    assert lcs.lcs_length.func(left, right).to_pylist() == [3] * 300 and max(seen) <= 10
    seen.clear()
    lines = [pa.array([[r[k]] for r in rows]) for k in (0, 1)]
    assert lcs.union_lcs_hits.func(*lines).to_pylist() == [3] * 300 and max(seen) <= lcs._ROWS_AT_ONCE


def test_models_are_scored_in_the_row_of_their_gold_text(spark, monkeypatch):
    """Every type and any number of models, awkward texts and small slices: as the pairs are scored, and no long row has a token."""
    texts = [t for pair in CASES + random_pairs(25, 7) for t in pair]
    rows = [(k, *[texts[(k * 7 + j * 3) % len(texts)] for j in range(4)]) for k in range(len(texts))]
    wide = spark.createDataFrame(rows, "id int, gold string, m1 string, m2 string, m3 string")
    names = ["id", "gold", "model", "obtained_summary"]
    for types in (TYPES, ("rouge2", "rougel"), ("rougelsum",), ()):
        scored = score_wide(wide, ["id"], "gold", types=types)
        pairs = melt(wide, ["id", "gold"])
        want = overlap.bleu(overlap.rouge_f(pairs, "obtained_summary", "gold", types=types), "obtained_summary", "gold")
        assert scored.columns == want.columns and scored.dtypes == want.dtypes and scored.columns[:4] == names
        assert sorted(map(str, scored.collect())) == sorted(map(str, want.collect()))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("ArrowEvalPython")
    monkeypatch.setattr(overlaps, "_TOKENS_AT_ONCE", 10)
    lines = [pa.array([[r.split() for r in (t or "").split("\n")] for t in some], pa.list_(pa.list_(pa.string()))) for some in list(zip(*rows))[1:]]
    found = overlaps.overlap_counts(1, True, True).func(*lines).to_pylist()
    for k, (gold, *others) in enumerate(zip(*[c.to_pylist() for c in lines])):
        flat = [t for line in gold for t in line]
        for got, other in zip(found[k], others):
            made = [t for line in other for t in line]
            assert got == [sum((brute.grams(made, 1) & brute.grams(flat, 1)).values()), brute.table(made, flat)[-1][-1], lcs.summary_hits(gold, other), len(made), len(flat)]


def test_texts_are_sent_uncut_and_equal_ones_are_not_counted(spark, monkeypatch):
    wide = spark.createDataFrame([(1, "a b. c", "a b. c", "c")], "id int, gold string, m1 string, m2 string")
    plan = score_wide(wide, ["id"], "gold")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp_replace" not in plan and "split(" not in plan
    counted = []
    factorize = ngrams.pd.factorize
    monkeypatch.setattr(ngrams.pd, "factorize", lambda values: counted.append(len(values)) or factorize(values))
    token, size = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3, 1, 2, 5, 3, 1, 2]), np.array([4, 2, 0])
    found = ngrams.shared_grams(token, [size, size, np.array([1, 2, 0])], 5)
    assert found.tolist() == [[[4, 3, 2, 1, 0], [1, 0, 0, 0, 0], [0] * 5], [[1, 0, 0, 0, 0], [1, 0, 0, 0, 0], [0] * 5]]
    assert counted[0] == 11


def test_hits_of_one_line_are_those_of_the_tables(monkeypatch):
    rng = random.Random(13)
    for n in range(300):
        lines = [[rng.randrange(4 + n % 9) for _ in range(rng.randrange(7))] for _ in range(rng.randrange(1, 7))]
        kept = [line for line in lines if rng.random() < 0.7]
        other = sum(kept, []) if n % 2 else [t for t in sum(lines, []) if rng.random() < 0.5]
        text = lambda rows: "\n".join(" ".join(f"w{t}" for t in row) for row in rows)
        want = brute.rouge_lsum(text([other]), text(lines))[1] * max(sum(map(len, lines)), 1)
        hits = [lcs.summary_hits([x for x in lines if x], [other])]
        for small in (0, 1 << 20):
            monkeypatch.setattr(lcs, "_SMALL", small)
            hits += [lcs.summary_hits([x for x in lines if x], [other]), lcs.summary_hits([x for x in lines if x], [other, []])]
        assert hits == [pytest.approx(want)] * 5
