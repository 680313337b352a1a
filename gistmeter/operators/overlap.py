"""ROUGE and BLEU of (prediction, gold) pairs, one set of columns a row.

ROUGE: tokens are lower-case runs of ``[a-z0-9]``; F is ``2PR / (P + R)`` and 0 when nothing is
shared or a side is empty. ROUGE-L is the longest common subsequence over all tokens; ROUGE-Lsum
takes, for each gold line, the union of its common subsequences with all predicted lines and counts
a token only while both sides have unused occurrences.

BLEU: order 4, no smoothing, 0 when an order has no match; the brevity penalty is 1 for a ratio
above 1 and ``exp(1 - 1/ratio)`` otherwise. An empty side scores 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmeter.functions.cuts import bleu_cut, rouge_cut, rouge_line_cut
from gistmeter.functions.lcs import lcs_length, union_lcs_hits
from gistmeter.functions.ngrams import gram_hits, ngram_count
from gistmeter.functions.overlaps import overlap_counts
from gistmeter.functions.stems import stem_line_tokens, stem_tokens
from gistmeter.functions.text import bleu_line, bleu_tokens, line_tokens, rouge_line, rouge_tokens, sentence_lines

ROUGE_TYPES = ("rouge1", "rouge2", "rougel", "rougelsum")
MAX_ORDER = 4

_PREDICTED, _GOLD = "_gm_p", "_gm_g"
_PREDICTED_BLEU, _GOLD_BLEU = "_gm_bp", "_gm_bg"
_ORDERS = range(1, MAX_ORDER + 1)


def prf(hits: Column, predicted: Column, gold: Column) -> Column:
    """Precision, recall and F from counts."""
    precision = hits / F.greatest(predicted, F.lit(1))
    recall = hits / F.greatest(gold, F.lit(1))
    f = F.when(hits > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return F.struct(precision.alias("precision"), recall.alias("recall"), f.alias("fmeasure"))


def _with_missing(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.withColumns({name: value for name, value in columns.items() if name not in df.columns})


def _with_rouge_tokens(
    df: DataFrame, side: str, text: str, types: tuple[str, ...], stem: bool, split_sentences: bool
) -> DataFrame:
    if any(t != "rougelsum" for t in types):
        tokens = rouge_tokens(text)
        df = _with_missing(df, {side: stem_tokens(tokens) if stem else tokens})
    if "rougelsum" in types:
        tokens = line_tokens(sentence_lines(text) if split_sentences else text)
        df = _with_missing(df, {f"{side}_lines": stem_line_tokens(tokens) if stem else tokens})
    return df


def with_gold_tokens(
    df: DataFrame,
    gold: str,
    types: tuple[str, ...] = ROUGE_TYPES,
    stem: bool = False,
    split_sentences: bool = False,
    with_bleu: bool = True,
) -> DataFrame:
    """Take the gold text apart ahead of scoring.

    Used before a melt, so that this happens once per gold text and not once per model. The scoring
    functions pick the columns up and ``without_gold_tokens`` drops them.
    """
    if types:
        df = _with_rouge_tokens(df, _GOLD, gold, types, stem, split_sentences)
    if with_bleu:
        df = _with_missing(df, {_GOLD_BLEU: bleu_tokens(gold)})
    return df


def gold_token_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith((_GOLD, _GOLD_BLEU))]


def without_gold_tokens(df: DataFrame) -> DataFrame:
    return df.drop(*gold_token_columns(df))


def rouge(
    df: DataFrame,
    predicted: str,
    gold: str,
    types: tuple[str, ...] = ROUGE_TYPES,
    stem: bool = False,
    split_sentences: bool = False,
) -> DataFrame:
    """Add one struct column (precision, recall, fmeasure) per type.

    The texts are tokenised once and every type is a projection of the row. ``split_sentences``
    puts each sentence on a line for ``rougelsum``; otherwise the lines of the text count.
    """
    staged = _with_rouge_tokens(df, _PREDICTED, predicted, types, stem, split_sentences)
    staged = _with_rouge_tokens(staged, _GOLD, gold, types, stem, split_sentences)
    orders = max([_rouge_order(name) or 0 for name in types], default=0)
    if orders:
        staged = staged.withColumn("_gm_hits", gram_hits(orders)(_PREDICTED, _GOLD))
    counted = staged.select("*", *[_rouge_hits(name).alias(f"_gm_hits_{name}") for name in types])
    return counted.select(*df.columns, *[_rouge_score(name).alias(name) for name in types])


def _rouge_order(name: str) -> int | None:
    digits = name.removeprefix("rouge")
    return int(digits) if digits.isdigit() else None


def _rouge_hits(name: str) -> Column:
    order = _rouge_order(name)
    if order is not None:
        return F.get("_gm_hits", F.lit(order - 1))
    if name == "rougel":
        return lcs_length(F.col(_PREDICTED), F.col(_GOLD))
    if name == "rougelsum":
        return union_lcs_hits(F.col(f"{_GOLD}_lines"), F.col(f"{_PREDICTED}_lines"))
    raise ValueError(f"unknown type: {name}")


def _rouge_score(name: str) -> Column:
    hits = F.col(f"_gm_hits_{name}")
    if name == "rougelsum":
        sizes = [
            F.aggregate(F.col(f"{side}_lines"), F.lit(0), lambda n, line: n + F.size(line))
            for side in (_PREDICTED, _GOLD)
        ]
    else:
        sizes = [ngram_count(F.col(side), _rouge_order(name) or 1) for side in (_PREDICTED, _GOLD)]
    return prf(hits, *sizes)


def rouge_f(df: DataFrame, predicted: str, gold: str, **options) -> DataFrame:
    """``rouge`` with the F value alone in each column."""
    types = options.get("types", ROUGE_TYPES)
    scored = rouge(df, predicted, gold, **options)
    return scored.select(*df.columns, *[F.col(f"{t}.fmeasure").alias(t) for t in types])


def bleu_counts(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """Add matches and possible matches per order, and both lengths."""
    staged = _with_missing(df, {_PREDICTED_BLEU: bleu_tokens(predicted), _GOLD_BLEU: bleu_tokens(gold)})
    staged = staged.withColumn("_gm_bleu_hits", gram_hits(MAX_ORDER)(_PREDICTED_BLEU, _GOLD_BLEU))
    return staged.select(
        *df.columns,
        *[F.get("_gm_bleu_hits", F.lit(n - 1)).alias(f"match{n}") for n in _ORDERS],
        *[ngram_count(F.col(_PREDICTED_BLEU), n).alias(f"total{n}") for n in _ORDERS],
        F.size(_PREDICTED_BLEU).alias("translation_length"),
        F.size(_GOLD_BLEU).alias("reference_length"),
    )


def _bleu_columns(counted: DataFrame, keep: list[str]) -> DataFrame:
    shares = [
        F.when(F.col(f"total{n}") > 0, F.col(f"match{n}") / F.col(f"total{n}")).otherwise(F.lit(0.0))
        for n in _ORDERS
    ]
    made, asked = F.col("translation_length"), F.col("reference_length")
    rated = counted.select(
        *keep,
        F.array(*shares).alias("precisions"),
        F.when(asked > 0, made / asked).otherwise(F.lit(0.0)).alias("length_ratio"),
        made,
        asked,
    )
    ratio, precisions = F.col("length_ratio"), F.col("precisions")
    brevity = F.when(ratio > 1, F.lit(1.0)).when(ratio > 0, F.exp(1 - 1 / ratio)).otherwise(F.lit(0.0))
    mean_log = F.aggregate(precisions, F.lit(0.0), lambda total, p: total + F.log(p) / MAX_ORDER)
    geometric = F.when(F.array_min(precisions) > 0, F.exp(mean_log)).otherwise(F.lit(0.0))
    return rated.select(
        *keep,
        (geometric * brevity).alias("bleu"),
        "precisions",
        brevity.alias("brevity_penalty"),
        "length_ratio",
        "translation_length",
        "reference_length",
    )


def bleu(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """Add bleu, precisions, brevity_penalty, length_ratio and both lengths."""
    return _bleu_columns(bleu_counts(df, predicted, gold), df.columns)


def bleu_corpus(df: DataFrame, predicted: str, gold: str, by: list[str] | None = None) -> DataFrame:
    """BLEU of a whole set of pairs: counts are summed before any ratio is taken."""
    by = by or []
    names = [f"{kind}{n}" for kind in ("match", "total") for n in _ORDERS]
    names += ["translation_length", "reference_length"]
    kept = [*dict.fromkeys([*by, predicted, gold, *gold_token_columns(df)])]
    counted = bleu_counts(df.select(*kept), predicted, gold)
    summed = counted.groupBy(*by).agg(*[F.sum(name).alias(name) for name in names])
    return _bleu_columns(summed, by)


def score_models(
    df: DataFrame, ids: list[str], gold: str, models: list[str], variable: str, value: str, types: tuple[str, ...] = ROUGE_TYPES
) -> DataFrame:
    """(ids, gold, variable, value, the F values of ``types``, the columns of ``bleu``): one row per row and model.

    All models' texts meet the gold text in one row, so it is taken apart, sent and numbered once; the rows become
    long once they are numbers.
    """
    by_line, sequence = "rougelsum" in types, "rougel" in types
    orders = max([_rouge_order(name) or 0 for name in types], default=0)
    kinds = [*[f"rouge{n}" for n in range(1, orders + 1)], *["rougel"] * sequence, *["rougelsum"] * by_line]
    unknown = set(types) - set(kinds)
    if unknown:
        raise ValueError(f"unknown type: {min(unknown)}")
    texts = [gold, *models]
    # The tokens of the lines, one after the other, are those of the text.
    cut = rouge_line_cut if by_line else rouge_cut
    rouge_found = overlap_counts(orders, sequence, by_line, cut)(*[rouge_line(t) for t in texts])
    bleu_found = overlap_counts(MAX_ORDER, cut=bleu_cut)(*[bleu_line(t) for t in texts])
    counted = df.select(*ids, *texts, *[rouge_found.alias("_gm_rouge")] * bool(types), bleu_found.alias("_gm_bleu"))
    number = F.col("_gm_number")
    long = counted.select("*", F.explode(F.array(*[F.lit(k) for k in range(len(models))])).alias("_gm_number"))
    at = lambda column, place: F.get(F.get(column, number), F.lit(place))
    grams = lambda size, n: F.greatest(size - (n - 1), F.lit(0))
    made, asked = at("_gm_rouge", len(kinds)), at("_gm_rouge", len(kinds) + 1)
    rated = [
        prf(at("_gm_rouge", kinds.index(t)), *[grams(size, _rouge_order(t) or 1) for size in (made, asked)])["fmeasure"].alias(t)
        for t in types
    ]
    bleu_made, bleu_asked = at("_gm_bleu", MAX_ORDER), at("_gm_bleu", MAX_ORDER + 1)
    scored = long.select(
        *ids,
        gold,
        F.get(F.array(*[F.lit(m) for m in models]), number).alias(variable),
        F.get(F.array(*models), number).alias(value),
        *rated,
        *[at("_gm_bleu", n - 1).alias(f"match{n}") for n in _ORDERS],
        *[grams(bleu_made, n).alias(f"total{n}") for n in _ORDERS],
        bleu_made.alias("translation_length"),
        bleu_asked.alias("reference_length"),
    )
    return _bleu_columns(scored, [*ids, gold, variable, value, *types])
