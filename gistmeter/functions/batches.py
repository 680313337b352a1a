"""Token-id arrays made rectangular: truncation, padding, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ids of the special tokens and the label value that a loss ignores.
BOS_ID, PAD_ID, EOS_ID, UNK_ID = 0, 1, 2, 3
SPECIAL_IDS = (BOS_ID, PAD_ID, EOS_ID, UNK_ID)
IGNORED_LABEL = -100


def truncate(ids: Column, max_length: int) -> Column:
    """At most ``max_length`` leading ids, as a model's input limit asks for."""
    return F.slice(ids, 1, max_length)


def _missing(ids: Column, length: Column) -> Column:
    return F.greatest(length.cast("int") - F.size(ids), F.lit(0))


def pad(ids: Column, length: Column, pad_id: int = PAD_ID) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad_id), _missing(ids, length)))


def attention_mask(ids: Column, length: Column) -> Column:
    """1 for every real id, 0 for padding."""
    return F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), _missing(ids, length)))


def global_attention_mask(padded: Column) -> Column:
    """1 on the first position, 0 elsewhere."""
    return F.transform(padded, lambda _, i: (i == 0).cast("int"))


def mask_labels(ids: Column, pad_id: int = PAD_ID) -> Column:
    return F.transform(ids, lambda x: F.when(x == pad_id, F.lit(IGNORED_LABEL)).otherwise(x))


def unmask_labels(ids: Column, pad_id: int = PAD_ID) -> Column:
    return F.transform(ids, lambda x: F.when(x == IGNORED_LABEL, F.lit(pad_id)).otherwise(x))


def real_length(ids: Column, pad_id: int = PAD_ID) -> Column:
    """Number of ids that are not padding."""
    return F.size(F.filter(ids, lambda x: x != pad_id))
