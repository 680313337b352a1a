"""A vocabulary learnt from the corpus; texts to ids and back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmeter.functions.batches import BOS_ID, EOS_ID, SPECIAL_IDS, UNK_ID
from gistmeter.functions.places import items_outside, values_in_place
from gistmeter.operators.ranking import global_rank, lookup_join

# At most this many rows of a vocabulary (a count, not a guess), the most frequent ones, are held by every task,
# and no token of more bytes than the second number.
BROADCAST_TOKENS, LONGEST = 500_000, 64
UNK_TOKEN = "<unk>"


def build_vocabulary(df: DataFrame, tokens: Column) -> DataFrame:
    """(token, n, token_id): ids by falling frequency, after the special ones."""
    counts = (
        df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = global_rank(counts, F.col("n").desc(), F.col("token"), name="_gm_rank")
    return ranked.select(
        "token", "n", (F.col("_gm_rank") - 1 + len(SPECIAL_IDS)).cast("int").alias("token_id")
    )


def frequent_items(table: DataFrame, on: str, value: str, uses: str, rows: int) -> tuple[pa.Array, pa.Array]:
    """The ``on`` and ``value`` columns of at most ``rows`` rows of a table, those with the most uses.

    A bound on the uses decides, so of equally frequent ones all or none are taken. Longer keys than ``LONGEST`` bytes
    stay away, so the bytes that the driver and every task hold are bounded too.
    """
    short = table.where((F.octet_length(F.col(on).cast("string")) <= LONGEST) & (F.col(uses) > 0))
    step = F.floor(F.log2(F.col(uses).cast("double")) * 8)
    counted = short.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect()
    bound, held = None, 0
    for r in sorted(counted, key=lambda r: -r["step"]):
        held += r["rows"]
        if held > rows:
            break
        bound = r["step"]
    chosen = (short.where(F.lit(False)) if bound is None else short.where(step >= bound)).select(on, value).toArrow()
    return tuple(pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in (chosen[on], chosen[value]))


def with_rare_values(
    df: DataFrame, keys: list[str], items: Column, shared: pa.Array, table: DataFrame, on: str, value: str, broadcast_rows: int
) -> DataFrame:
    """``df`` with ``_gm_keys`` and ``_gm_values``: each row's distinct items outside ``shared`` that ``table`` has, and their values.

    Only those items leave their row, each with the row's key, and the rows move once, as they are. Give ``items`` as
    an expression on what ``df`` reads: texts are smaller than their tokens. ``keys`` must be unique and present,
    ``table`` unique on ``on``.
    """
    kind = df.select(items.alias("_gm")).schema["_gm"].dataType.elementType
    rare = df.select(*keys, F.explode(F.array_distinct(items_outside(shared, kind)(items))).alias(on))
    found = lookup_join(rare, table.select(on, value), on, broadcast_rows, costly=True)
    return with_packed(df, keys, found, on, value)


def with_packed(df: DataFrame, keys: list[str], found: DataFrame, on: str, value: str) -> DataFrame:
    """``df`` with the ``on`` and ``value`` columns of the rows found for its keys, as lists ``_gm_keys`` and ``_gm_values``."""
    packed = found.groupBy(*keys).agg(F.collect_list(F.struct(on, value)).alias("_gm"))
    packed = packed.select(*keys, F.col(f"_gm.{on}").alias("_gm_keys"), F.col(f"_gm.{value}").alias("_gm_values"))
    # The lists are hashed, so that no text is sorted.
    return df.join(packed.hint("shuffle_hash"), keys, "left")


def _frequent(vocabulary: DataFrame, on: str, value: str, rows: int) -> tuple[pa.Array, pa.Array]:
    """Smaller ids are more frequent, so the ids alone say which tokens are."""
    ranked = vocabulary.where((F.col("token_id") < len(SPECIAL_IDS) + rows) & (F.octet_length("token") <= LONGEST))
    chosen = ranked.select(on, value).limit(rows).toArrow()
    return tuple(pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in (chosen[on], chosen[value]))


def encode(
    df: DataFrame, key: str, tokens: Column, vocabulary: DataFrame, broadcast_rows: int = BROADCAST_TOKENS
) -> DataFrame:
    """(key, input_ids): the ids of a text's tokens between the start and the end id.

    A token that the vocabulary does not have becomes ``UNK_ID``. ``key`` must be unique. The ``broadcast_rows`` most
    frequent tokens are looked up where the text is; only a text's distinct other ones are joined.
    """
    names, ids = _frequent(vocabulary, "token", "token_id", broadcast_rows)
    known = with_rare_values(df, [key], tokens, names, vocabulary, "token", "token_id", broadcast_rows)
    placed = values_in_place(T.IntegerType(), UNK_ID, names, ids)(tokens, "_gm_keys", "_gm_values")
    return known.select(key, F.concat(F.array(F.lit(BOS_ID)), placed, F.array(F.lit(EOS_ID))).alias("input_ids"))


def decode(
    df: DataFrame, key: str, ids: str, vocabulary: DataFrame, broadcast_rows: int = BROADCAST_TOKENS
) -> DataFrame:
    """(key, text): tokens joined by a space; special ids are skipped, an id without a token is ``<unk>``."""
    words = F.filter(ids, lambda x: x >= len(SPECIAL_IDS)).cast("array<int>")
    slim = vocabulary.select("token", F.col("token_id").cast("int").alias("token_id"))
    numbers, names = _frequent(slim, "token_id", "token", broadcast_rows)
    known = with_rare_values(df.select(key, ids), [key], words, numbers, slim, "token_id", "token", broadcast_rows)
    placed = values_in_place(T.StringType(), UNK_TOKEN, numbers, names)(words, "_gm_keys", "_gm_values")
    return known.select(key, F.array_join(placed, " ").alias("text"))
