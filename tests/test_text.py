import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gistmeter.functions import cuts, stems, text
from tests import brute


def one(spark, value, column):
    df = spark.createDataFrame([(value,)], "text string")
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "value", ["", None, "  Hello, World 42! ", "Ärzte café", "a.b,c 1,5 3-4 &amp; <skipped>x-\ny", "tab\there nbsp"]
)
def test_tokens(spark, value):
    assert one(spark, value, text.rouge_tokens("text")) == brute.rouge_tokens(value)
    assert one(spark, value, text.bleu_tokens("text")) == brute.bleu_tokens(value)


def test_sentences_and_dedup(spark):
    value = "One. Two!  One. Three? Two! end"
    assert one(spark, value, text.sentences("text")) == ["One.", "Two!", "One.", "Three?", "Two!", "end"]
    once = one(spark, value, text.without_repeats("text"))
    assert once == "One. Two! Three? end"
    assert one(spark, once, text.without_repeats("text")) == once
    assert one(spark, value, text.without_repeats("text", max_chars=8)) == "One. Two"
    assert one(spark, " One. Two! ", text.sentence_lines("text")) == "One.\nTwo!"


def test_longest_and_last(spark):
    assert one(spark, "Ab. Cd. Efgh. Ijkl.", text.longest_sentence("text")) == "Efgh."
    assert one(spark, "Ab. Cd.", text.last_sentence("text")) == "Cd."
    assert one(spark, "", text.longest_sentence("text")) is None
    assert one(spark, "", text.last_sentence("text")) is None


@pytest.mark.parametrize(
    "word, expected",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("feed", "feed"),
        ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"),
        ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("tanned", "tan"),
        ("falling", "fall"), ("hissing", "hiss"), ("fizzed", "fizz"), ("failing", "fail"), ("filing", "file"),
        ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"),
        ("rational", "ration"), ("digitizer", "digit"), ("operator", "oper"), ("hopefulness", "hope"),
        ("formality", "formal"), ("triplicate", "triplic"), ("formative", "form"), ("electrical", "electr"),
        ("goodness", "good"), ("revival", "reviv"), ("allowance", "allow"), ("adjustment", "adjust"),
        ("adoption", "adopt"), ("communism", "commun"), ("effective", "effect"), ("probate", "probat"),
        ("rate", "rate"), ("controlling", "control"), ("dying", "die"), ("news", "news"), ("enjoy", "enjoy"),
    ],
)
def test_stems(word, expected):
    assert stems.stem(word) == expected


def test_stems_of_arrays(spark):
    df = spark.createDataFrame([(["companies", "was", "companies"],), ([],), (["running"],)], "t array<string>")
    got = [r["x"] for r in df.coalesce(1).select(stems.stem_tokens("t").alias("x")).collect()]
    assert got == [["compani", "was", "compani"], [], ["run"]]
    nested = df.coalesce(1).select(stems.stem_line_tokens(F.array("t", "t")).alias("x")).collect()
    assert [r["x"] for r in nested] == [[x, x] for x in got]


def test_texts_are_split_into_sentences_once(spark, data):
    from gistmeter.plans.fixtures import wide_summaries

    plan = wide_summaries(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_bytes_are_cut_by_the_rules_of_the_patterns(spark, monkeypatch):
    """Points and commas in runs of any length, dashes, entities, wide spaces, letters whose lower case is ASCII, empty and null texts."""
    maker = random.Random(21)
    signs = [*"aB1 2.,.,--\n\r\t!'$&;<_ ", "\u212a", "\u0130", "\u00e9", "\u20ac", "\U0001f600", "&amp;", "&lt;", "<skipped>", "-\n", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u200b", "\u3000", "\u00c2", "\u2160", "\x1c", "\x00", "\x0b"]
    texts = ["".join(maker.choice(some) for _ in range(maker.randrange(n))) for some in (signs, "1.,", "1a.,", "1-. a", "a\n.") for n in (2, 5, 9, 40) for _ in range(120)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([None, "", *texts, "Ab"])], "id int, t string").coalesce(1)
    lines = F.filter(text.line_tokens("t"), lambda line: F.size(line) > 0)
    rows = df.select(text.rouge_line("t"), text.rouge_tokens("t"), lines, text.bleu_line("t"), text.bleu_tokens("t"), F.array_sort(F.array_distinct(F.concat(text.rouge_tokens("t"), text.rouge_tokens(F.lower("t")))))).collect()
    rouge, tokens, by_line, bleu, marks, distinct = ([*c] for c in zip(*rows))
    for at_once in (1 << 22, 50):
        monkeypatch.setattr(cuts, "_BYTES_AT_ONCE", at_once)
        for skip in (0, 7):
            assert cuts.rouge_cut(pa.array(rouge).slice(skip)).to_pylist() == tokens[skip:]
            assert cuts.rouge_line_cut(pa.array(rouge).slice(skip)).to_pylist() == by_line[skip:]
            assert cuts.bleu_cut(pa.array(bleu).slice(skip)).to_pylist() == marks[skip:]
    found = df.select(F.array_sort(cuts.distinct_tokens("t", F.lower("t")))).collect()
    assert [r[0] for r in found] == distinct
    for cut in (cuts.rouge_cut, cuts.rouge_line_cut, cuts.bleu_cut):
        assert cut(pa.array([], pa.string())).to_pylist() == []
