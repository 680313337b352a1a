"""Sentence boundaries learnt from the corpus, without labels (after Kiss and Strunk, 2006).

A word that nearly always stands with a full stop behind it is an abbreviation, and its stop ends no sentence. How
sure that is comes from corpus-wide counts by a log-likelihood ratio, weighted towards short words with stops inside.
Words that follow sentence ends far more often than chance are starters; one of these after an abbreviation does begin
a sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmeter.functions.lets import let
from gistmeter.operators.ranking import lookup_join
from gistmeter.session import materialize

# Fixed values of the method: how often an abbreviation has its stop, and the two thresholds.
STOP_SHARE, ABBREVIATION, STARTER = 0.99, 0.3, 30.0
BROADCAST_TYPES = 500_000

_BLANKS = r"[ \t\n\r\f\x0B]+"
_STOP, _MARK = r"\.[\"')\]]*$", r"[!?][\"')\]]*$"
_TYPE = r"^[^\p{L}]*(.*?)[.!?]*[\"')\]]*$"
# A word that its own lower case leaves a word.
_PLAIN, _MARKED = r"\A[a-zA-Z]+\z", r"\A[a-zA-Z]+[.!?]\z"
_WORD = r"^\p{L}[\p{L}.'-]*$"


def blank_tokens(text: Column | str) -> Column:
    """What blanks separate; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _BLANKS), lambda t: t != "")


def word_type(token: Column) -> Column:
    """The lower-case word of a token without marks around it; null if it is no word."""
    # Most tokens are plain words, or end in a mark: those are told by two short patterns, the others by the whole one.
    word = F.lower(F.regexp_extract(token, _TYPE, 1))
    bare = F.lower(F.substring(token, 1, F.length(token) - 1))
    return F.when(token.rlike(_PLAIN), F.lower(token)).when(token.rlike(_MARKED), bare).when(word.rlike(_WORD), word)


def sentence_model(df: DataFrame, text: str) -> DataFrame:
    """(type, n_period, n_plain, score, abbreviation) of every word that has a full stop behind it somewhere.

    Words are counted inside the tasks first, so neither a frequent word nor a long text matters. Null texts count
    nothing; an empty table gives an empty result.
    """
    tokens = df.select(F.explode(blank_tokens(text)).alias("token"))
    stop = F.col("token").rlike(_STOP).cast("long").alias("stop")
    counts = tokens.select(word_type(F.col("token")).alias("type"), stop).groupBy("type").agg(
        F.sum("stop").alias("n_period"), F.sum(1 - F.col("stop")).alias("n_plain")
    )
    counts = materialize(counts, "types")
    # Stops behind what is no word count too; one row of totals.
    stops, total = counts.agg(F.sum("n_period"), F.sum(F.col("n_period") + F.col("n_plain"))).first()
    both = counts.where("type is not null and n_period > 0")
    share = F.lit((stops or 0) / (total or 1))
    n = F.col("n_period").cast("double")
    plain = F.col("n_plain").cast("double")
    # With a stop behind every token nothing can be told.
    chance = n * F.log(share) + plain * F.log(F.greatest(1 - share, F.lit(1e-12)))
    stopped = n * F.log(F.lit(STOP_SHARE)) + plain * F.log(F.lit(1 - STOP_SHARE))
    size = F.length(F.replace(F.col("type"), F.lit("."), F.lit("")))
    inside = F.length("type") - size
    score = -2 * (chance - stopped) * F.exp(-size.cast("double")) * (inside + 1) * F.pow(size.cast("double"), -plain)
    scored = both.select("type", "n_period", "n_plain", score.alias("score"))
    return scored.withColumn("abbreviation", F.col("score") >= ABBREVIATION)


def _per_text(df: DataFrame, key: str, tokens: str, table: DataFrame, name: str) -> DataFrame:
    """``df`` with those of the distinct word types of each row that ``table`` has, as the list ``name``."""
    types = F.array_distinct(F.filter(F.transform(tokens, word_type), lambda t: t.isNotNull()))
    found = lookup_join(df.select(key, F.explode(types).alias("type")), table.select("type"), "type", BROADCAST_TYPES)
    return df.join(found.groupBy(key).agg(F.collect_list("type").alias(name)), key, "left")


def _ends(tokens: Column, abbreviations: Column, starters: Column | None) -> Column:
    """Whether a sentence ends behind each token; the last one always ends one."""

    def end(token: Column, i: Column) -> Column:
        after = F.get(tokens, i + 1)
        stop = token.rlike(_STOP)
        short = F.coalesce(F.array_contains(abbreviations, word_type(token)), F.lit(False))
        begins = ~after.rlike(r"^[\"'(\[]*\p{Ll}")
        if starters is None:
            again = F.lit(False)
        else:
            again = after.rlike(r"^[\"'(\[]*\p{Lu}") & F.coalesce(F.array_contains(starters, word_type(after)), F.lit(False))
        return after.isNull() | token.rlike(_MARK) | (stop & begins & (~short | again))

    return F.transform(tokens, end)


def sentence_starters(df: DataFrame, key: str, text: str, model: DataFrame) -> DataFrame:
    """(type, n_start, n, ratio) of the words that follow sentence ends far more often than chance.

    ``key`` must be unique and present. Ends are those behind words that are no abbreviation in ``model``.
    """
    cut = df.select(key, blank_tokens(text).alias("_gm_tokens")).repartition(F.col(key))
    known = _per_text(cut, key, "_gm_tokens", model.where("abbreviation"), "_gm_short")
    marked = let(
        F.struct(F.col("_gm_tokens").alias("t"), F.coalesce("_gm_short", F.array().cast("array<string>")).alias("s")),
        lambda x: let(
            _ends(x["t"], x["s"], None),
            lambda ends: F.transform(x["t"], lambda t, i: F.struct(word_type(t).alias("type"), ((i > 0) & F.coalesce(F.get(ends, i - 1), F.lit(False))).cast("long").alias("start"))),
        ),
    )
    words = known.select(F.inline(marked))
    counts = words.groupBy("type").agg(F.sum("start").alias("n_start"), F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "starts")
    breaks, total = counts.agg(F.sum("n_start"), F.sum("n")).first()
    both = counts.where("type is not null and n_start > 0")
    a, whole = F.lit(float(breaks or 1)), F.lit(float(total or 1))
    b, ab = F.col("n").cast("double"), F.col("n_start").cast("double")
    log = lambda x: F.log(F.greatest(x, F.lit(1e-12)))
    part = lambda k, m, p: k * log(p) + (m - k) * log(1 - p)
    rest = F.greatest(whole - a, F.lit(1.0))
    chance = part(ab, a, b / whole) + part(b - ab, whole - a, b / whole)
    bound = F.when(a == ab, 0.0).otherwise(part(ab, a, ab / a)) + F.when(b == ab, 0.0).otherwise(part(b - ab, whole - a, (b - ab) / rest))
    scored = both.select("type", "n_start", "n", (-2 * (chance - bound)).alias("ratio"), (whole / a > b / ab).alias("more"))
    return scored.where((F.col("ratio") >= STARTER) & F.col("more")).drop("more")


def split_learned(df: DataFrame, key: str, text: str, model: DataFrame, starters: DataFrame) -> DataFrame:
    """(key, pos, sentence): the sentences of every text that has any, numbered from 0, blanks made single spaces.

    ``key`` must be unique and present. A text's distinct words are looked up, and it is cut in its row.
    """
    cut = df.select(key, blank_tokens(text).alias("_gm_tokens")).repartition(F.col(key))
    known = _per_text(cut, key, "_gm_tokens", model.where("abbreviation"), "_gm_short")
    known = _per_text(known, key, "_gm_tokens", starters, "_gm_start")
    none = F.array().cast("array<string>")
    parts = F.struct(F.col("_gm_tokens").alias("t"), F.coalesce("_gm_short", none).alias("s"), F.coalesce("_gm_start", none).alias("b"))
    # Tokens have no blanks, so a line break can stand for an end.
    lines = let(
        parts,
        lambda x: let(
            _ends(x["t"], x["s"], x["b"]),
            lambda ends: F.array_join(F.transform(x["t"], lambda t, i: F.concat(t, F.when(F.get(ends, i), F.lit("\n")).otherwise(F.lit(" ")))), ""),
        ),
    )
    sentences = F.filter(F.split(lines, "\n"), lambda s: s != "")
    return known.select(key, F.posexplode(sentences).alias("pos", "sentence"))
