"""Helpers of this subpackage: words and fingerprints in numpy, connected components, skew-safe lookups.

A word is a run of characters other than ``[\\x20\\x09-\\x0D]``. Text is handled as the UTF-8 bytes of an
Arrow column, many documents at a time, so nothing loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmeter.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes of text that a task turns into fingerprints at once.
PIECE = 2 << 20
#: Bytes of a word that are summed with factors of their own.
BLOCK = 1 << 14
NO_ID = np.iinfo(np.int64).min


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_numbers(count: int, seed: int) -> np.ndarray:
    """Fixed pseudo-random odd 64-bit multipliers."""
    steps = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(steps + np.uint64(seed * 0xD1342543DE82EF95 % 2**64)) | np.uint64(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 bounds of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def id_values(column: pa.Array) -> np.ndarray:
    """Ids as int64, with ``NO_ID`` for null."""
    return pc.fill_null(column.cast(pa.int64()), int(NO_ID)).to_numpy(zero_copy_only=False)


def pieces(batch: pa.RecordBatch, text: str, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each; no text is cut."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths.astype(np.int64)) // size
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for start, end in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(start, end - start)


class Words:
    """Where the words of some texts are, and a fingerprint of each word."""

    _blank = np.zeros(256, bool)
    _blank[list(BLANKS)] = True

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, self.bounds = text_bytes(column)
        solid = ~self._blank[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.bounds] = True
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last[:-1] &= ~solid[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: Number of the first word of every text, and of all words at the end.
        self.of_text = np.searchsorted(self.starts, self.bounds)
        self.count = np.diff(self.of_text)
        self._lower = lower

    def fingerprints(self) -> np.ndarray:
        """A 64-bit number for each word, the same wherever the word stands.

        A word is summed in blocks of ``BLOCK`` bytes. The sums of a long word are mixed and weighted by the
        block's number, so that no factor returns; a block is also the most that is held of a word at once.
        """
        letters = odd_numbers(256, 1)
        if self._lower:
            letters[65:91] = letters[97:123]
        places = odd_numbers(BLOCK, 2)
        lengths = self.ends - self.starts
        blocks = -(-lengths // BLOCK)
        first = np.cumsum(blocks) - blocks
        number = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
        begin = np.repeat(self.starts, blocks) + number * BLOCK
        sizes = np.minimum(np.repeat(self.ends, blocks) - begin, BLOCK)
        sums = np.empty(len(sizes), np.uint64)
        group = np.cumsum(sizes) // PIECE
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)] if len(sizes) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            size = sizes[a:b]
            at = np.cumsum(size) - size
            inside = np.arange(int(size.sum())) - np.repeat(at, size)
            value = letters[self.data[np.repeat(begin[a:b], size) + inside]] * places[inside]
            sums[a:b] = np.add.reduceat(value, at)
        long = np.flatnonzero(number)
        sums[long] = mixed(sums[long]) * (mixed(number[long].astype(np.uint64)) | np.uint64(1))
        out = np.add.reduceat(sums, first) if len(first) else np.zeros(0, np.uint64)
        return mixed(out + lengths.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of every run of ``size`` consecutive words (runs over text ends included)."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(count, size, np.uint64)
    for k, factor in enumerate(odd_numbers(size, 3)):
        total += words[k : k + count] * factor
    return mixed(total)


def text_of(counts: np.ndarray) -> np.ndarray:
    """Number of the text for each of its items."""
    return np.repeat(np.arange(len(counts)), counts)


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """Consecutive runs of a flat array as an Arrow list column."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def flat(column: pa.ListArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The items of a list column in one array, and the length of each list."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False), counts.astype(np.int64)


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def crc_part(column: Column | str, parts: int) -> Column:
    """``crc32(id as text) mod parts``; null ids count as the empty text."""
    value = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")) % parts


#: Ids are scattered before they are dealt by remainder, so that ids with a common step do not meet in one shard.
_PRIME, _FACTOR = 2**31 - 1, 1_181_783_497


def shard_of(ids: np.ndarray, shards: int) -> np.ndarray:
    """A shard for each id, the same as ``shard_column`` gives."""
    return ids % _PRIME * _FACTOR % _PRIME % shards


def shard_column(column: Column | str, shards: int) -> Column:
    """A shard for each id, the same as ``shard_of`` gives."""
    return F.pmod(F.pmod(column, F.lit(_PRIME)) * _FACTOR, F.lit(_PRIME)) % shards


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a long that tells its rows apart, and that column's name.

    The number is a row's place in its file and the file's in the sorted list of files, so it is the same whenever
    and wherever the files are read again, and rows may repeat in all columns. What is not a plain table of files is
    written first. The driver holds one path for each file, as for any scan, and they are broadcast.
    """
    name = "row_number"
    while name in docs.columns:
        name = f"_{name}"
    if not docs._jdf.queryExecution().analyzed().children().isEmpty() or not docs.inputFiles():
        docs = materialize(docs, "rows")
    facts = docs.metadataColumn("_metadata")
    keyed = docs.select("*", facts["file_path"].alias("_path"), facts["row_index"].alias("_at"))
    paths = sorted(r[0] for r in keyed.select("_path").distinct().collect())
    files = docs.sparkSession.createDataFrame([(p, k) for k, p in enumerate(paths)], "_path string, _file long")
    number = F.shiftleft("_file", 40) + F.col("_at")
    return keyed.join(F.broadcast(files), "_path").select(*docs.columns, number.alias(name)), name


def left_lookup(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join with a written table that is unique on ``key``; ``weight`` says how many rows carry the key.

    Keys above a share of ``1 / partitions`` number at most ``partitions``; that piece of the table is
    broadcast. The rows it serves take no part in the second join: they get keys of their own there,
    so that neither a hot key nor the nulls meet in one task.
    """
    parts = partitions_of(rows)
    total = table.agg(F.sum(weight)).first()[0] or 0
    frequent = F.col(weight) * parts > total
    names = [c for c in table.columns if c != key]
    heavy = table.where(frequent).select(key, *(F.col(c).alias(f"_h_{c}") for c in names))
    light = table.where(~frequent).withColumnRenamed(key, "_l_key")
    first = rows.join(F.broadcast(heavy), key, "left")
    served = F.col(f"_h_{weight}").isNotNull() | F.col(key).isNull()
    own = F.when(~served, F.col(key))
    spread = F.when(served, F.monotonically_increasing_id())
    first = first.withColumn("_own", own).withColumn("_spread", spread)
    light = light.withColumn("_spread_l", F.lit(None).cast("long"))
    joined = first.join(
        light, (F.col("_own") == F.col("_l_key")) & F.col("_spread").eqNullSafe(F.col("_spread_l")), "left"
    )
    return joined.select(*rows.columns, *(F.coalesce(F.col(f"_h_{c}"), F.col(c)).alias(c) for c in names))


def without(docs: DataFrame, drop: DataFrame, key: str, most: int = 2_000_000) -> DataFrame:
    """``docs`` without the keys in ``drop``; up to ``most`` keys are counted and broadcast, more are shuffled."""
    drop = drop.select(key).where(F.col(key).isNotNull()).distinct()
    small = drop.limit(most + 1).count() <= most
    return docs.join(F.broadcast(drop) if small else drop, key, "left_anti").select(*docs.columns)


def only(docs: DataFrame, keep: DataFrame, key: str, most: int = 2_000_000) -> DataFrame:
    """``docs`` with a key in ``keep``, joined like ``without``."""
    keep = keep.select(key).where(F.col(key).isNotNull()).distinct()
    small = keep.limit(most + 1).count() <= most
    return docs.join(F.broadcast(keep) if small else keep, key, "left_semi").select(*docs.columns)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of an edge: the smallest node it can reach.

    Large-star and small-star steps (Kiveris et al., 2014): nodes are re-linked to the smallest node near
    them until only stars are left. Each step is a grouped minimum, which is reduced in the map tasks, and
    a join that can be split, and is written to the shared folder.
    """
    pairs = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    while True:
        # Done when every node has one edge and leads to a node that has none.
        ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.union(pairs.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.where("up > 1 or (up = 1 and down = 1)").isEmpty():
            break
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = materialize(small.union(smallest.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "star")
    roots = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


#: Most star rounds, and how many pairs may be left, for each posting there is, for all of them to be looked at.
ROUNDS, PAIRS = 3, 16


def _narrowed(marked: DataFrame, most: int = 2_000_000) -> DataFrame:
    """Postings with a possible partner of another component in their list, and the list's most frequent component.

    Up to ``most`` lists that are open are counted and broadcast; more are joined with the postings by key, where a
    list of very many postings is one that adaptive execution splits.
    """
    per_root = marked.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.max("most").alias("most"), F.min("size").alias("size"))
    main = F.max_by("root", F.struct("n", -F.col("root"))).alias("main")
    per_key = per_root.groupBy("key").agg(main, F.sum("n").alias("in_list"), F.max("n").alias("in_main"), F.max("most").alias("far"), F.min("size").alias("least"))
    lists = materialize(per_key.where("in_list > in_main"), "lists").select(F.col("key").alias("_key"), "main", "far", "least")
    small = lists.limit(most + 1).count() <= most
    fits = (F.col("key") == F.col("_key")) & (F.col("size") <= F.col("far")) & (F.col("least") <= F.col("most"))
    return marked.join(F.broadcast(lists) if small else lists, fits).drop("_key", "far", "least")


def linked_groups(
    postings: DataFrame, verify: Callable[[DataFrame], DataFrame], profiles: DataFrame | None = None, close: Callable[[str, str], Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """``node, root`` over all links among nodes that share a list, and the links that were looked at.

    ``postings`` (written; ``key, node, weight, size, most``) are inverted lists; ``verify`` returns the pairs
    ``a, b`` that are links. Two postings can only link if each one's ``size`` is at most the other's ``most``, and
    every link must meet this in one of the lists that hold both. ``profiles`` (by ``node``) are joined to the
    lists left for a sharper necessary condition ``close``.

    In star rounds every node meets one head of each of its lists, first the node of the largest ``weight``, then
    others: a number of pairs that grows with the postings, not with the square of a list. Between rounds, postings
    leave whose list has no other component, or none of a fitting size. When few pairs are left all of them are
    verified: those of different components, of which one is not the most frequent of its list. A pair of
    one component needs no test, since it can join nothing; so no link between components is lost.
    """
    meets = (F.col("x.key") == F.col("y.key")) & (F.col("x.size") <= F.col("y.most")) & (F.col("y.size") <= F.col("x.most"))
    pair = [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")]
    roots, links, open_lists, count = None, None, postings.withColumn("root", F.col("node")), postings.count()
    for turn in range(ROUNDS):
        by = F.struct("weight", -F.col("node")) if turn == 0 else F.struct(F.xxhash64("node", F.lit(turn)), "node")
        heads = open_lists.groupBy("key").agg(F.max_by(F.struct("node", "root", "size", "most"), by).alias("x"), F.count(F.lit(1)).alias("n"))
        heads = heads.where("n > 1").select("key", "x.*")
        stars = heads.alias("x").join(open_lists.alias("y"), meets & (F.col("x.root") != F.col("y.root"))).select(*pair).distinct()
        found = materialize(verify(stars), "links")
        links = found if links is None else links.union(found)
        roots = components(links)
        marked = postings.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_lists = materialize(_narrowed(materialize(marked, "marked")), "open")
        left = open_lists.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("root") != F.col("main")).cast("long")).alias("other"))
        pairs = left.agg(F.sum(F.col("n") * F.col("other"))).first()[0]
        if not pairs:
            return roots, links
        if pairs <= PAIRS * count:
            break
    if profiles is not None:
        open_lists = open_lists.join(profiles, "node")
    x, y = open_lists.where(F.col("root") != F.col("main")).alias("x"), open_lists.alias("y")
    meets &= (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
    rest = x.join(y, meets & close("x", "y") if close else meets).select(*pair).distinct()
    more = materialize(verify(rest), "links")
    if more.isEmpty():
        return roots, links
    return components(links.union(more)), links.union(more)
