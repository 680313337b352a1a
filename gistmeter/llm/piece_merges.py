"""SentencePiece encoding and decoding by vectorised merge rounds.

A model's pieces are merged from single characters: the pair of neighbours whose piece has the best score goes
first, the leftmost of equals before the others. Here that runs on flat numpy arrays over many texts at once.

1. Texts become characters (blanks as ``▁``, one before each text). Between two characters that stand side by side
   in no piece no merge can ever happen, so the text is cut there. What is left are short words, most of which
   occur many times; each distinct word is merged once.
2. Rounds: the rank of every pair of neighbours, the smallest rank of each word (a segmented minimum), and all of its
   occurrences merged from the left, side by side ones alternately. The array is compacted and only pairs beside a
   merge are looked up again; words without a pair leave. A merged piece that could take part in a pair of the same
   or a better rank is merged once a round, so the order is that of one merge at a time.
3. Characters that are no piece become their UTF-8 bytes, and the ids of the words are laid out text by text.

A word of more than ``LONG`` characters that cannot be cut (such as a run of blanks) takes its merges from a heap.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmeter.llm.shared import PIECE, flat, lists, mixed, odd_numbers, pieces, text_bytes

#: What a blank is written as.
MARK = "▁"
LONG = 1024
NONE = np.iinfo(np.int32).max


@dataclass
class Pieces:
    """Tables of a model: symbols are its ids, then characters that stand in pieces without being one."""

    surface: list[bytes]  # of ids, as decoded; bytes of byte pieces
    kind: np.ndarray  # of ids: 0 text, 1 byte, 2 control, 3 unknown
    chars: np.ndarray  # sorted code points of the characters in pieces
    char_symbol: np.ndarray  # their symbols
    beside: np.ndarray  # sorted ``left * len(chars) + right`` of characters side by side in a piece
    left_right: np.ndarray  # sorted ``left * symbols + right`` of the pairs that merge
    merged: np.ndarray  # the symbol each becomes
    rank: np.ndarray  # rank of each, smaller first
    alone: np.ndarray  # of symbols: whether it may be merged into only once a round
    symbols: int
    byte_id: np.ndarray  # ids of the 256 byte pieces
    bos: int
    eos: int


def read_pieces(model: bytes) -> Pieces:
    """Tables of a SentencePiece model file, which is read whole (some hundred KB) and shipped with the job.

    The model must be of the pair-merging kind with byte fallback, one blank put before a text, and no other
    normalisation, user-defined or unused pieces; anything else is a ValueError.
    """
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    ids = range(library.get_piece_size())
    if any(library.is_unused(i) for i in ids) or library.normalize(" a  ﬁ \n ") != f"{MARK * 2}a{MARK * 2}ﬁ \n{MARK}":
        raise ValueError("only models that leave the text as it is are read")
    kind = np.array([1 if library.is_byte(i) else 2 if library.is_control(i) else 3 if library.is_unknown(i) else 0 for i in ids], np.int8)
    if (kind == 1).sum() != 256:
        raise ValueError("only models with byte fallback are read")
    names = [library.id_to_piece(i) for i in ids]
    byte_id = np.zeros(256, np.int64)
    surface = []
    for i, name in enumerate(names):
        if kind[i] == 1:
            byte_id[int(name[3:5], 16)] = i
            surface.append(bytes([int(name[3:5], 16)]))
        else:
            surface.append({0: name.replace(MARK, " "), 2: "", 3: " ⁇ "}[int(kind[i])].encode())
    symbol = {name: i for i, name in enumerate(names) if kind[i] == 0}
    order = {score: k for k, score in enumerate(sorted({library.get_score(i) for i in symbol.values()}, reverse=True))}
    rank_of = {i: order[library.get_score(i)] for i in symbol.values()}
    chars = sorted({ord(c) for name in symbol for c in name})
    for c in map(chr, chars):
        symbol.setdefault(c, len(names) + len(symbol))
    symbols = max(symbol.values()) + 1
    number = {chr(c): k for k, c in enumerate(chars)}
    beside = sorted({number[x] * len(chars) + number[y] for name in symbol for x, y in zip(name, name[1:])})
    pairs, alone = {}, np.zeros(symbols, bool)
    for name, i in symbol.items():
        for k in range(1, len(name)):
            x, y = symbol.get(name[:k]), symbol.get(name[k:])
            if x is not None and y is not None:
                pairs[x * symbols + y] = i
                for part in (x, y):
                    alone[part] |= part in rank_of and rank_of[part] >= rank_of[i]
    keys = np.array(sorted(pairs), np.int64)
    merged = np.array([pairs[k] for k in keys.tolist()], np.int32)
    return Pieces(
        surface, kind, np.array(chars, np.int64), np.array([symbol[chr(c)] for c in chars], np.int32), np.array(beside, np.int64),
        keys, merged, np.array([rank_of[i] for i in merged.tolist()], np.int32), alone, symbols, byte_id, library.bos_id(), library.eos_id(),
    )


def _table(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings side by side, and their n + 1 bounds."""
    bounds = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(v) for v in values], out=bounds[1:])
    return np.frombuffer(b"".join(values), np.uint8), bounds


def gathered(data: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``data`` one after the other, and the length of each."""
    sizes = (bounds[1:] - bounds[:-1])[which]
    at = np.cumsum(sizes) - sizes
    return data[np.repeat(bounds[which] - at, sizes) + np.arange(int(sizes.sum()))], sizes


def code_points(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and the n + 1 bounds of the texts among them."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    first = data[at]
    size = 1 + (first >= 0xC0).astype(np.int8) + (first >= 0xE0) + (first >= 0xF0)
    value = np.where(size == 1, first, first & (0x7F >> size)).astype(np.int32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        value[more] = value[more] << 6 | (data[at[more] + k] & 0x3F)
    return value, np.searchsorted(at, bounds)


def utf8(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of code points, and how many each has."""
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    of = np.repeat(points, size)
    back = np.repeat(np.cumsum(size), size) - 1 - np.arange(len(of))  # bytes that follow in the same character
    length = np.repeat(size, size)
    low = (of >> (6 * back)) & 0x3F | 0x80
    head = (0xF0 << (4 - length)) & 0xFF | of >> (6 * back)
    return np.where(back == length - 1, np.where(length == 1, of, head), low).astype(np.uint8), size


class Merger:
    """Merge rounds over the words of a model."""

    def __init__(self, tables: Pieces):
        self.t = tables
        self.number = np.full(0x110000, -1, np.int32)
        self.number[tables.chars] = np.arange(len(tables.chars))
        self.beside = np.zeros(len(tables.chars) ** 2, bool)
        self.beside[tables.beside] = True

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols (``NONE``: no merge) and what it becomes."""
        t = self.t
        key = left.astype(np.int64) * t.symbols + right
        at = np.minimum(np.searchsorted(t.left_right, key), len(t.left_right) - 1)
        hit = t.left_right[at] == key
        return np.where(hit, t.rank[at], NONE), t.merged[at]

    def merge(self, symbol: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of each word when no pair is left to merge, and how many each word has."""
        done_word, done_symbol = [], []
        word = np.repeat(np.arange(len(counts)), counts)
        long = counts > LONG
        if long.any():
            ends = np.cumsum(counts)
            for w in np.flatnonzero(long):
                whole = self._by_heap(symbol[ends[w] - counts[w] : ends[w]].tolist())
                done_word.append(np.full(len(whole), w))
                done_symbol.append(np.array(whole, np.int32))
            symbol, word = symbol[~long[word]], word[~long[word]]
        rank, into = np.full(len(symbol), NONE, np.int32), np.zeros(len(symbol), np.int32)
        look = np.flatnonzero(word[1:] == word[:-1])
        rank[look], into[look] = self._look_up(symbol[look], symbol[look + 1])
        while len(symbol):
            start = np.flatnonzero(np.diff(word, prepend=-1))
            size = np.diff(np.append(start, len(word)))
            least = np.minimum.reduceat(rank, start)
            open_ = np.repeat(least < NONE, size)
            if not open_.all():
                done_word.append(word[~open_])
                done_symbol.append(symbol[~open_])
                symbol, word, rank, into = symbol[open_], word[open_], rank[open_], into[open_]
                least, size = least[least < NONE], size[least < NONE]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            # Side by side ones alternate from the left; a piece that may go on at once is merged once a word.
            run = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0]
            first = np.append(True, word[hit[1:]] != word[hit[:-1]])
            leading = into[hit[first]]
            tied = np.repeat(self.t.alone[leading], np.diff(np.append(np.flatnonzero(first), len(hit))))
            hit = hit[first | ~tied]
            symbol[hit] = into[hit]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            symbol, word, rank, into = symbol[keep], word[keep], rank[keep], into[keep]
            at = place[hit]
            changed = np.zeros(len(symbol), bool)
            changed[at] = changed[np.maximum(at - 1, 0)] = True
            look = np.flatnonzero(changed)
            inside = np.append(word[1:] == word[:-1], False)[look]
            rank[look[~inside]] = NONE
            look = look[inside]
            rank[look], into[look] = self._look_up(symbol[look], symbol[look + 1])
        word, symbol = np.concatenate([*done_word, np.zeros(0, np.int64)]), np.concatenate([*done_symbol, np.zeros(0, np.int32)])
        order = np.argsort(word, kind="stable")
        return symbol[order], np.bincount(word, minlength=len(counts))

    def _by_heap(self, symbol: list[int]) -> list[int]:
        """One word, one merge at a time."""
        n = len(symbol)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank, into = (x.tolist() for x in self._look_up(np.array(symbol[:-1]), np.array(symbol[1:])))
        heap = [(r, k, symbol[k], symbol[k + 1], m) for k, (r, m) in enumerate(zip(rank, into)) if r < NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[int, int]] = {}
        while heap:
            _, k, x, y, m = heapq.heappop(heap)
            j = after[k]
            if symbol[k] != x or j < 0 or symbol[j] != y:
                continue
            symbol[k], symbol[j] = m, -1
            after[k] = after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a < 0 or b < 0:
                    continue
                pair = symbol[a], symbol[b]
                if pair not in known:
                    r, i = self._look_up(np.array([pair[0]]), np.array([pair[1]]))
                    known[pair] = int(r[0]), int(i[0])
                if known[pair][0] < NONE:
                    heapq.heappush(heap, (known[pair][0], a, *pair, known[pair][1]))
        return [s for s in symbol if s >= 0]

    def encode(self, column: pa.Array, bos: bool, eos: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every text, and how many each has."""
        t = self.t
        points, bounds = code_points(*text_bytes(column))
        points[points == 0x20] = ord(MARK)
        full = np.flatnonzero(np.diff(bounds))
        points = np.insert(points, bounds[full], ord(MARK))
        bounds = bounds + np.concatenate([[0], np.cumsum(np.diff(bounds) > 0)])
        number = self.number[points]
        cut = np.ones(len(points) + 1, bool)
        known = (number[1:] >= 0) & (number[:-1] >= 0)
        pair = number[:-1].astype(np.int64) * len(t.chars) + number[1:]
        cut[1:-1] = ~(known & self.beside[np.where(known, pair, 0)])
        cut[bounds] = True
        edges = np.flatnonzero(cut)
        of_word, word_points, sizes = self._distinct(points, edges)
        number = self.number[word_points]
        # An unknown character has a symbol of its own that no pair has.
        symbol = np.where(number >= 0, t.char_symbol[number], -1 - word_points).astype(np.int32)
        symbol, counts = self.merge(symbol, sizes)
        ids, per = self._ids(symbol)
        word_bounds = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(np.add.reduceat(per, np.cumsum(counts) - counts) if len(counts) else counts, out=word_bounds[1:])
        # Begin and end are two words more.
        ids = np.concatenate([ids, [t.bos, t.eos]])
        word_bounds = np.append(word_bounds, word_bounds[-1] + [1, 2])
        text_at = np.searchsorted(edges[:-1], bounds)
        which = of_word
        if eos:
            which = np.insert(which, text_at[1:], len(counts) + 1)
        if bos:
            which = np.insert(which, text_at[:-1] + np.arange(len(text_at) - 1) * int(eos), len(counts))
        text_at = text_at + np.arange(len(text_at)) * (int(eos) + int(bos))
        out, sizes = gathered(ids, word_bounds, which)
        total = np.concatenate([[0], np.cumsum(sizes)])
        return out.astype(np.int32), np.diff(total[text_at])

    def _distinct(self, points: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word the number of its distinct word; the characters of those and how many each has."""
        start, sizes = edges[:-1], np.diff(edges)
        if not len(start):
            return np.zeros(0, np.int64), points, sizes
        inside = np.arange(len(points)) - np.repeat(start, sizes)
        value = mixed(points.astype(np.uint64) + (inside.astype(np.uint64) << np.uint64(24)))
        prints = np.add.reduceat(value, start) + sizes.astype(np.uint64) * odd_numbers(1, 9)[0]
        _, first, of_word = np.unique(prints, return_index=True, return_inverse=True)
        # Words are compared with the one that stands for them; a word that differs stands for itself.
        lead = first[of_word]
        same = sizes == sizes[lead]
        check = np.repeat(same, sizes)
        other = np.zeros(len(points), bool)
        other[check] = points[check] != points[(np.repeat(start[lead], sizes) + inside)[check]]
        same &= ~np.logical_or.reduceat(other, start)
        odd = np.flatnonzero(~same)
        of_word[odd] = len(first) + np.arange(len(odd))
        chosen = np.concatenate([first, odd])
        bounds = np.append(edges[:-1], edges[-1])
        word_points, sizes = gathered(points, bounds, chosen)
        return of_word, word_points, sizes

    def _ids(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols: one of a piece, the bytes of a character that is none."""
        t = self.t
        points = -1 - symbol.astype(np.int64)
        loose = np.flatnonzero((symbol >= len(t.kind)) & (symbol >= 0))
        if len(loose):
            back = np.argsort(t.char_symbol)
            points[loose] = t.chars[back[np.searchsorted(t.char_symbol[back], symbol[loose])]]
        missing = points >= 0
        data, size = utf8(points[missing])
        per = np.ones(len(symbol), np.int64)
        per[missing] = size
        out = np.repeat(symbol.astype(np.int64), per)
        out[np.repeat(missing, per)] = t.byte_id[data]
        return out, per

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The text of every list of ids."""
        t = self.t
        data, bounds = _table(t.surface)
        kind = t.kind[ids]
        out, size = gathered(data, bounds, ids)
        total = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum(counts)
        begin = ends - counts
        keep = np.ones(len(out), bool)
        # The blank put before a text goes, if what is said first starts with one.
        said = np.flatnonzero(kind != 2)
        first = said[np.minimum(np.searchsorted(said, begin), len(said) - 1)] if len(said) else said
        if len(said):
            first = first[(first >= begin) & (first < ends)]
            first = first[(kind[first] == 0) & (size[first] > 0)]
            at = total[first]
            keep[at[out[at] == 0x20]] = False
        text_bounds = np.concatenate([[0], np.cumsum(keep)])[total[np.append(begin, ends[-1:])]] if len(counts) else np.zeros(1, np.int64)
        split = (kind[said[1:]] == 1) & (kind[said[:-1]] == 1) & (np.diff(said) > 1)
        if split.any():
            # Bytes do not join across a control id within a text; encoding never makes such lists.
            return pa.array([self._by_runs(ids[a:b].tolist()) for a, b in zip(begin, ends)], pa.large_string())
        binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(np.ascontiguousarray(text_bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(out[keep]))])
        try:
            text = binary.cast(pa.large_string())
            text.validate(full=True)
            return text
        except pa.ArrowInvalid:
            # Byte pieces that are no UTF-8; encoding never makes them.
            return pa.array([_replaced(v.as_py()) for v in binary], pa.large_string())


    def _by_runs(self, ids: list[int]) -> str:
        """One text, bytes joined between what is no byte."""
        out, run, said = [], b"", False
        for i in [*ids, -1]:
            if i >= 0 and self.t.kind[i] == 1:
                run, said = run + self.t.surface[i], True
                continue
            out.append(_replaced(run))
            run = b""
            if i >= 0 and self.t.kind[i] != 2:
                text = self.t.surface[i].decode()
                out.append(text if said or self.t.kind[i] else text.removeprefix(" "))
                said = True
        return "".join(out)


def _replaced(data: bytes) -> str:
    """Bytes as text, with a replacement character for each byte that belongs to no character."""
    out = []
    while data:
        try:
            return "".join([*out, data.decode()])
        except UnicodeDecodeError as wrong:
            out += [data[: wrong.start].decode(), "�"]
            data = data[wrong.start + 1 :]
    return "".join(out)


_MERGERS: dict[bytes, Merger] = {}


def _merger(tables: Pieces) -> Merger:
    """One merger for each model in a Python worker."""
    key = tables.left_right.tobytes()[:4096] + len(tables.left_right).to_bytes(8, "little")
    if key not in _MERGERS:
        _MERGERS[key] = Merger(tables)
    return _MERGERS[key]


def _with(df: DataFrame, column: str, name: str, kind: str) -> str:
    """The schema of ``df`` with ``column`` replaced by ``name``, as text."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != column]
    return ", ".join([*fields, f"`{name}` {kind}"])


def encode(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids", bos: bool = False, eos: bool = True) -> DataFrame:
    """``docs`` with ``text`` replaced by its piece ids, an array of int, exactly as the model's library has them.

    Nothing is sampled. A null text counts as empty and has only the begin and end asked for. Texts are encoded
    whole, whatever their length (working memory is about 100 bytes for each byte of a text); rows may repeat, other
    columns are kept as they are, and an empty table gives an empty result.
    """
    tables = read_pieces(model)
    other = [c for c in docs.columns if c != text]

    def run(batches):
        merger = _merger(tables)
        for batch in batches:
            for piece in pieces(batch, text, PIECE):
                out, counts = merger.encode(piece.column(text), bos, eos)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in other), lists(out, counts)], names=[*other, ids])

    typed = docs.withColumn(text, docs[text].cast("string"))
    return typed.mapInArrow(run, _with(docs, text, ids, "array<int>"))


def decode(rows: DataFrame, model: bytes, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with the list ``ids`` replaced by its text, exactly as the model's library decodes it.

    Control ids say nothing; bytes that are no UTF-8 become replacement characters; a null list, and a null in a
    list, counts as empty. An id the model does not have is an error. Other columns are kept as they are, and an
    empty table gives an empty result.
    """
    tables = read_pieces(model)
    other = [c for c in rows.columns if c != ids]

    def run(batches):
        merger = _merger(tables)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                values, counts = flat(part.column(ids), np.int64)
                text_of = merger.decode(values, counts).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in other), text_of], names=[*other, text])

    typed = rows.withColumn(ids, F.filter(rows[ids].cast("array<int>"), F.isnotnull))
    return typed.mapInArrow(run, _with(rows, ids, text, "string"))
