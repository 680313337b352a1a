"""Subword ids with the merge ranks of a public vocabulary.

A text is cut into pieces by the vocabulary's pattern; a piece's bytes are merged pair by pair, the pair of the
smallest rank first. Each distinct piece of the corpus is merged once, in the task that holds it, and a text looks up
its distinct pieces, so the cost of merging does not grow with the number of occurrences.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistmeter.functions.places import values_in_place
from gistmeter.operators.vocabulary import BROADCAST_TOKENS, frequent_items, with_rare_values
from gistmeter.session import materialize

# Fixed value: how the byte-level vocabularies cut text before merging (white space as Unicode has it).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A rank file (a token in base64 and its rank on each line) as a dictionary, which ships with the job.

    A vocabulary has some ten thousand tokens; a file of over a million lines is refused.
    """
    rows = spark.read.text(path).limit(1_000_001).collect()
    if len(rows) > 1_000_000:
        raise ValueError(f"{path} is no vocabulary")
    pairs = (row[0].split() for row in rows if row[0].strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: neighbours merge by rising rank, the leftmost of equals first."""
    if word in ranks:
        return [ranks[word]]
    parts: list[bytes | None] = [word[k : k + 1] for k in range(len(word))]
    after, before = [*range(1, len(parts)), -1], list(range(-1, len(parts) - 1))
    waiting: list[tuple[int, int, int]] = []

    def offer(left: int) -> None:
        right = after[left]
        if left >= 0 and right >= 0:
            both = parts[left] + parts[right]
            if both in ranks:
                heapq.heappush(waiting, (ranks[both], left, len(both)))

    for k in range(len(parts) - 1):
        offer(k)
    while waiting:
        _, left, size = heapq.heappop(waiting)
        right = after[left]
        # Stale if either side has been merged since.
        if parts[left] is None or right < 0 or len(parts[left]) + len(parts[right]) != size:
            continue
        parts[left], parts[right] = parts[left] + parts[right], None
        after[left] = after[right]
        if after[left] >= 0:
            before[after[left]] = left
        offer(left)
        if before[left] >= 0:
            offer(before[left])
    return [ranks[part] for part in parts if part is not None]


def text_pieces(text: Column | str) -> Column:
    """What the pattern cuts a text into; nothing is lost, so the pieces joined are the text. None for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U){PATTERN}"), F.lit(0))


def encode_subwords(
    df: DataFrame, key: str, text: str, ranks: dict[bytes, int], broadcast_rows: int = BROADCAST_TOKENS
) -> DataFrame:
    """(key, ids) for every row; null and empty texts have no ids. ``key`` must be unique and present.

    Every byte must be a token of its own (as in byte-level vocabularies), so any text has ids.
    """
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a vocabulary with all bytes")

    def merge(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids = [merged(piece.encode(), ranks) for piece in batch.column("piece").to_pylist()]
            columns = [batch.column("piece"), batch.column("n"), pa.array(ids, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["piece", "n", "ids"])

    pieces = text_pieces(text)
    uses = df.select(F.explode(pieces).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    table = materialize(uses.mapInArrow(merge, "piece string, n long, ids array<int>"), "subwords")
    shared, ids = frequent_items(table, "piece", "ids", "n", broadcast_rows)
    known = with_rare_values(df.select(key, text), [key], pieces, shared, table, "piece", "ids", broadcast_rows)
    placed = values_in_place(T.IntegerType(), -1, shared, ids, nested=True)
    return known.select(key, placed(pieces, "_gm_keys", "_gm_values").alias("ids"))


def decode_subwords(ids: str, ranks: dict[bytes, int]) -> Column:
    """The text of a column of ids, in the row; ids without a token say nothing, broken characters become U+FFFD."""
    tokens = {rank: token for token, rank in ranks.items()}

    def decode(column: pa.Array) -> pa.Array:
        rows = ((tokens.get(i, b"") for i in row or ()) for row in column.to_pylist())
        return pa.array([b"".join(row).decode(errors="replace") for row in rows], pa.string())

    return F.arrow_udf(decode, T.StringType())(ids)
