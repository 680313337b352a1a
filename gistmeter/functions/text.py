"""Tokens and sentences of a text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gistmeter.functions.lets import let

# Token and sentence rules.
ROUGE_BREAK = "[^a-z0-9]+"
SENTENCE_BREAK = "(?<=[.!?])[ \\t\\n\\r\\f]+"
SPACE_RUN = "[\\x{09}-\\x{0d}\\x{1c}-\\x{20}\\x{85}\\p{Z}]+"

# The mteval-v13a rules, in the order they apply. The first class leaves the space out (a
# space between spaces parts the same tokens), and the classes list their characters: Java looks such a
# class up in a table, several times faster than a union of ranges.
BLEU_LITERALS = [("<skipped>", ""), ("-\n", ""), ("\n", " ")]
BLEU_ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
BLEU_PATTERNS = [
    ("([{|}~\\[\\\\\\]^_`!\"#$%&()*+:;<=>?@/])", " $1 "),
    ("([^0123456789])([.,])", "$1 $2 "),
    ("([.,])([^0123456789])", " $1 $2"),
    ("([0123456789])(-)", "$1 $2 "),
]


def _or_empty(text: Column | str) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column, F.lit(""))


def rouge_tokens(text: Column | str) -> Column:
    """Lower-case runs of ``[a-z0-9]``; a null text has no tokens."""
    return F.array_remove(F.split(F.lower(_or_empty(text)), ROUGE_BREAK), "")


def rouge_line(text: Column | str) -> Column:
    """What ``rouge_tokens`` looks for tokens in, closed by a line break."""
    return F.concat(F.lower(_or_empty(text)), F.lit("\n"))


def bleu_line(text: Column | str) -> Column:
    """What the patterns of ``bleu_tokens`` are looked for in, closed by a space."""
    line = _or_empty(text)
    for old, new in BLEU_LITERALS + BLEU_ENTITIES:
        line = F.replace(line, F.lit(old), F.lit(new))
    return F.concat(line, F.lit(" "))


def bleu_tokens(text: Column | str) -> Column:
    """Word and punctuation tokens by the mteval-v13a rules."""
    line = F.concat(F.lit(" "), bleu_line(text))
    for pattern, replacement in BLEU_PATTERNS:
        line = F.regexp_replace(line, pattern, replacement)
    return F.array_remove(F.split(line, SPACE_RUN), "")


def sentences(text: Column | str) -> Column:
    """Pieces that end in ``.``, ``!`` or ``?`` followed by white space."""
    return F.array_remove(F.split(_or_empty(text), SENTENCE_BREAK), "")


def sentence_lines(text: Column | str) -> Column:
    """The trimmed text with one sentence per line."""
    return F.array_join(sentences(F.trim(_or_empty(text))), "\n")


def line_tokens(text: Column | str) -> Column:
    """Tokens of every non-empty line, as ``array<array<string>>``."""
    lines = F.array_remove(F.split(_or_empty(text), "\n"), "")
    return F.transform(lines, rouge_tokens)


def without_repeats(text: Column | str, max_chars: int | None = None) -> Column:
    """The text with every repeated sentence removed; the first one stays.

    ``max_chars`` cuts the text before it is split. It is off unless asked for.
    """
    column = _or_empty(text)
    if max_chars is not None:
        column = F.substring(column, 1, max_chars)
    return distinct_of(sentences(column))


def longest_sentence(text: Column | str) -> Column:
    """The sentence with the most characters; the first of several."""
    return let(sentences(text), longest_of)


def last_sentence(text: Column | str) -> Column:
    """The closing sentence; null when there is none."""
    return let(sentences(text), last_of)


def distinct_of(parts: Column) -> Column:
    return F.array_join(F.array_distinct(parts), " ")


def longest_of(parts: Column) -> Column:
    ranked = F.transform(
        parts, lambda s, i: F.struct(F.length(s).alias("size"), (-i).alias("order"), s.alias("sentence"))
    )
    return F.array_max(ranked)["sentence"]


def last_of(parts: Column) -> Column:
    return F.get(parts, F.size(parts) - 1)
