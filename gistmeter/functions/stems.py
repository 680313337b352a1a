"""English word stems (Porter, 1980, with the common published extensions)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whole words with a stem of their own.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

# Suffix and replacement, first matching suffix decides.
PLURALS = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
DOUBLES = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"),
]
TRIPLES = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
]
ENDINGS = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
    "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]

_VOWEL_THEN_CONSONANT = re.compile("v+c+")


def _shape(word: str) -> str:
    """``c`` or ``v`` per letter; a ``y`` is a vowel after a consonant."""
    kinds = ""
    for letter in word:
        vowel = letter in "aeiou" or (letter == "y" and kinds.endswith("c"))
        kinds += "v" if vowel else "c"
    return kinds


def _measure(word: str) -> int:
    return len(_VOWEL_THEN_CONSONANT.findall(_shape(word)))


def _short_end(word: str) -> bool:
    kinds = _shape(word)
    if len(word) == 2:
        return kinds == "vc"
    return kinds.endswith("cvc") and word[-1] not in "wxy"


def _swap(word: str, rules, needs) -> str:
    for suffix, replacement in rules:
        if word.endswith(suffix):
            root = word[: len(word) - len(suffix)]
            return root + replacement if needs(root) else word
    return word


def _past_or_gerund(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    root = next((word[: -len(end)] for end in ("ed", "ing") if word.endswith(end)), None)
    if root is None or "v" not in _shape(root):
        return word
    if root.endswith(("at", "bl", "iz")):
        return root + "e"
    if len(root) > 1 and root[-1] == root[-2] and _shape(root)[-1] == "c":
        return root if root[-1] in "lsz" else root[:-1]
    return root + "e" if _measure(root) == 1 and _short_end(root) else root


def _derived(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _derived(word[:-2])
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _swap(word, DOUBLES, lambda root: _measure(root) > 0)


def _bare(word: str) -> str:
    for suffix in ENDINGS:
        if word.endswith(suffix):
            root = word[: len(word) - len(suffix)]
            enough = _measure(root) > 1 and (suffix != "ion" or root[-1] in "st")
            return root if enough else word
    return word


def stem(word: str) -> str:
    """The stem of one lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    if word.endswith("ies") and len(word) == 4:
        word = word[:-1]
    else:
        word = _swap(word, PLURALS, lambda root: True)
    word = _past_or_gerund(word)
    if word.endswith("y") and len(word) > 2 and _shape(word)[-2] == "c":
        word = word[:-1] + "i"
    word = _derived(word)
    word = _swap(word, TRIPLES, lambda root: _measure(root) > 0)
    word = _bare(word)
    if word.endswith("e"):
        root = word[:-1]
        if _measure(root) > 1 or (_measure(root) == 1 and not _short_end(root)):
            word = root
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def _stem_values(values: pa.Array) -> pa.Array:
    coded = values.dictionary_encode()
    words = coded.dictionary.to_pylist()
    stems = pa.array([stem(word) if len(word) > 3 else word for word in words], pa.string())
    return stems.take(coded.indices)


def _lists(array: pa.Array, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(
        pa.array([0, *_running(array)], pa.int32()), values
    )


def _running(array: pa.Array):
    total = 0
    for size in array.value_lengths().to_pylist():
        total += size or 0
        yield total


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_tokens(tokens: pa.Array) -> pa.Array:
    """Stems of a token array; tokens of three letters or fewer stay as they are.

    Only the distinct words of a batch are stemmed, and the rows never leave their partition.
    """
    return _lists(tokens, _stem_values(tokens.flatten()))


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def stem_line_tokens(lines: pa.Array) -> pa.Array:
    """``stem_tokens`` for an array of token arrays."""
    inner = lines.flatten()
    return _lists(lines, _lists(inner, _stem_values(inner.flatten())))
