"""Exact duplicates: Patricia tries over partitions by length and content hash.

Texts are equal when identical without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty. Every map
task inserts its texts into a compressed radix trie, so a text leaves the task once however many copies it
has there. The distinct texts are dealt by (length, content hash) and inserted as full byte strings into the
tries of the reducing tasks; a terminal node holds the copy that stays and the number of copies. A trie over
its memory bound spills its largest subtree: later keys below that edge go straight to the subtree's file,
which gets a trie of its own at the end.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmeter.llm.shared import BLANKS, left_lookup, partitions_of
from gistmeter.session import materialize

#: Bytes of edge labels a trie keeps before it spills.
TRIE_BYTES = 96 << 20
NODE_BYTES = 400


class Node:
    """An edge label, children by first byte, and at a terminal the winning copy and the count."""

    __slots__ = ("label", "children", "best", "count")

    def __init__(self, label: bytes):
        self.label, self.children, self.best, self.count = label, None, None, 0


def shared_prefix(a: bytes, b: bytes, at: int) -> int:
    """How many bytes ``a`` shares with ``b[at:]``, by halving."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """Patricia trie with a byte bound; ``best`` is the smallest of the ordered values given for a key."""

    def __init__(self, limit: int = TRIE_BYTES, above: bytes = b""):
        #: ``above`` is what all keys begin with.
        self.root, self.size, self.limit, self.above = Node(b""), 0, limit, above
        #: Files of spilled subtrees by the bytes that lead to them, and the lengths of these.
        self.files: dict[bytes, tempfile.SpooledTemporaryFile] = {}
        self.lengths: set[int] = set()

    def insert(self, key: bytes, value: tuple, count: int = 1) -> None:
        for length in self.lengths:
            if key[:length] in self.files:
                pickle.dump((key, value, count), self.files[key[:length]], protocol=5)
                return
        at, node = len(self.above), self.root
        while at < len(key):
            child = node.children.get(key[at]) if node.children else None
            if child is None:
                child = Node(key[at:])
                node.children = node.children or {}
                node.children[key[at]] = child
                self.size += len(key) - at + NODE_BYTES
                node, at = child, len(key)
                break
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            cut = shared_prefix(child.label, key, at)
            upper = Node(child.label[:cut])
            child.label = child.label[cut:]
            upper.children = {child.label[0]: child}
            node.children[key[at]] = upper
            self.size += NODE_BYTES
            node, at = upper, at + cut
        if node.best is None or value < node.best:
            node.best = value
        node.count += count
        if self.size > self.limit:
            self._spill()

    def _walk(self, node: Node, prefix: bytes) -> Iterator[tuple[bytes, tuple, int]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node.best is not None:
                yield prefix, node.best, node.count
            for child in (node.children or {}).values():
                stack.append((child, prefix + child.label))

    def _weight(self, node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node.label) + NODE_BYTES
            stack.extend((node.children or {}).values())
        return total

    def _spill(self) -> None:
        """Write the heaviest subtree below the first branch to a file of its own and forget it."""
        node, prefix = self.root, self.above
        while node.best is None and node.children and len(node.children) == 1:
            (node,) = node.children.values()
            prefix += node.label
        if not node.children:
            # A single key cannot be divided.
            self.limit = 2 * self.size
            return
        heaviest = max(node.children, key=lambda k: self._weight(node.children[k]))
        child = node.children.pop(heaviest)
        lead = prefix + bytes([heaviest])
        # The file has no name and goes when the task ends, whatever ends it.
        file = self.files[lead] = tempfile.TemporaryFile()  # noqa: SIM115
        self.lengths.add(len(lead))
        for key, best, count in self._walk(child, prefix + child.label):
            pickle.dump((key, best, count), file, protocol=5)
        self.size -= self._weight(child)

    def items(self) -> Iterator[tuple[bytes, tuple, int]]:
        """Every key with its smallest value and its count; a spilled subtree is read at the end."""
        if self.root.children or self.root.best is not None:
            yield from self._walk(self.root, self.above)
        self.root, self.size = Node(b""), 0
        for lead, file in self.files.items():
            file.seek(0)
            below = Trie(self.limit, lead)
            while True:
                try:
                    below.insert(*pickle.load(file))
                except EOFError:
                    break
            file.close()
            yield from below.items()
        self.files, self.lengths = {}, set()


def normalised(text: bytes) -> bytes:
    return text.translate(None, BLANKS)


_DISTINCT = pa.schema(
    [("size", pa.int32()), ("hash", pa.int64()), ("text", pa.binary()), ("points", pa.int64()), ("id", pa.int64()), ("row", pa.int64()), ("n", pa.int64())]
)


def _rows(trie: Trie) -> Iterator[pa.RecordBatch]:
    """A trie's terminals in batches of about 4 MB."""
    rows, size = [], 0
    for key, (points, missing, doc, row), count in trie.items():
        rows.append((len(key), hash_of(key), key, -points, None if missing else doc, row, count))
        size += len(key)
        if size > 4 << 20 or len(rows) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _DISTINCT)], schema=_DISTINCT)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _DISTINCT)], schema=_DISTINCT)


def hash_of(key: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little", signed=True)


def _distinct(limit: int):
    def run(batches):
        trie = Trie(limit)
        for batch in batches:
            points = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
            ids, numbers = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            for doc, row, text, n in zip(ids, numbers, batch.column("text").cast(pa.binary()), points):
                value = (-n, doc is None, 0 if doc is None else doc, row)
                trie.insert(normalised(text.as_py() or b""), value)
            if trie.size > limit // 2:
                yield from _rows(trie)
                trie = Trie(limit)
        yield from _rows(trie)

    return run


_OWNER = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])


def _owner_rows(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], f.type) for k, f in enumerate(_OWNER)], schema=_OWNER)


def _owners(limit: int):
    def run(batches):
        trie = Trie(limit)
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("points", "id", "row", "n"))
            for text, n, doc, row, count in zip(batch.column("text"), *columns):
                trie.insert(text.as_py(), (-n, doc is None, 0 if doc is None else doc, row), count)
        held = []
        for key, (_, missing, doc, row), count in trie.items():
            if count > 1:
                held.append((hashlib.sha256(key).hexdigest(), None if missing else doc, row, count))
            if len(held) == 10_000:
                yield _owner_rows(held)
                held = []
        yield _owner_rows(held)

    return run


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", trie_bytes: int = TRIE_BYTES, row: str | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per row of ``docs``.

    Of equal texts the row with the most code points in the original, then the smallest id, stays. Null and
    empty texts are equal to each other. A null id comes after all others; its row is kept only in a group
    without any id, where ``keep_id`` is null. Rows that repeat an id and a text count one by one in
    ``group_size`` and share one verdict, unless ``row`` names a column of numbers that tell rows apart: then the
    smallest of them settles what ids leave open, exactly one row of a group is ``kept``, and the column is
    returned too. Other columns are not read; an empty table gives an empty result. Groups of copies of any size
    meet as one row per map task.
    """
    own = F.lit(0).cast("long") if row is None else F.col(row).cast("long")
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), own.alias("row"))
    distinct = slim.mapInArrow(_distinct(trie_bytes), "size int, hash long, text binary, points long, id long, row long, n long")
    dealt = distinct.repartition(partitions_of(docs), "size", "hash").drop("size", "hash")
    owners = materialize(dealt.mapInArrow(_owners(trie_bytes), "text_sha256 string, keep_id long, keep_row long, group_size long"), "owners")
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")
    rows = slim.select("doc_id", "row", F.sha2(plain, 256).alias("text_sha256"))
    found = left_lookup(rows, owners, "text_sha256", "group_size")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    kept = F.col("doc_id").eqNullSafe(keep) if row is None else alone | (F.col("row") == F.col("keep_row"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        kept.alias("kept"),
        "text_sha256",
        *([] if row is None else [F.col("row").alias(row)]),
    )
