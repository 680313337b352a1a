"""Periodic runs, bit-plane clusters and piece merges against plain definitions."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gistmeter.llm import bit_planes, periodic_runs, piece_merges
from gistmeter.llm.queries import ORACLE, QUERIES
from gistmeter.llm.shared import Words

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("public_tokenizers")
MODEL = tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(data):
    return duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall()


def plain_runs(words, exponent, shortest):
    """Every maximal stretch of every period, without those that have a smaller one."""
    n, out = len(words), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(shortest, exponent * q):
                x = words[i : i + size]
                if not any(x[d:] == x[:-d] for d in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {i for start, size, q in runs for i in range(start + q, start + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def awkward_texts():
    maker = random.Random(2)
    texts = ["", None, " \t\n", "a", "a a a a a a", "a " * 300, "你 好 " * 40, "x" * 40_000 + " y", "b\x0bb\x0cb\rb\tb\nb b"]
    for _ in range(600):
        k = maker.choice([1, 2, 2, 3, 5])
        words = [maker.choice("abcdefgh"[:k]) for _ in range(maker.randrange(60))]
        if maker.random() < 0.6:
            part = [maker.choice("abcdefgh"[: k + 1]) for _ in range(maker.randrange(1, 8))]
            at = maker.randrange(len(words) + 1)
            words[at:at] = (part * 12)[: maker.randrange(40)]
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("exponent, shortest", [(4, 6), (2, 1), (3, 8), (2, 6)])
def test_runs_of_all_exponents(exponent, shortest):
    texts = awkward_texts()
    words = Words(pa.array(texts, pa.string()))
    found = periodic_runs.runs_of(words, exponent, shortest)
    got = {}
    for text, *run in zip(*(x.tolist() for x in found)):
        got.setdefault(text, []).append(tuple(run))
    collapsed = periodic_runs.collapsed_words(words, *found).to_pylist()
    for k, text in enumerate(texts):
        plain = (text or "").split()
        expected = plain_runs(plain, exponent, shortest)
        assert got.get(k, []) == expected
        assert collapsed[k] == plain_collapse(plain, expected)


def test_positions_in_blocks():
    maker = random.Random(3)
    numbers = maker.sample(range(100_000), 6000)
    held = periodic_runs.Positions(sorted(numbers[:2]))
    for k, x in enumerate(numbers[2:], 2):
        if k % 500 == 0:
            known = sorted(numbers[:k])
            below, above = [y for y in known if y < x], [y for y in known if y > x]
            assert held.around(x) == (max(below, default=-periodic_runs.FAR), min(above, default=periodic_runs.FAR))
        held.add(x)
    assert list(held) == sorted(numbers) and held.size == 6000 and len(held.blocks) > 4


def test_periodic_runs_frame(spark):
    rows = [(k % 500, t, "x", 1) for k, t in enumerate(awkward_texts())] + [(None, "a b " * 9, None, None)] * 2
    schema = "doc_id long, text string, runs string, start int"
    got = periodic_runs.periodic_runs(spark.createDataFrame(rows, schema).repartition(3))
    assert got.columns == ["doc_id", "start", "n_words", "runs", "collapsed"]
    key = lambda r: (str(r[0]), str(r[1]), r[2])
    seen = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed, r.n_words) for r in got.collect()), key=key)
    expected = []
    for i, text, *_ in rows:
        plain = (text or "").split()
        runs = plain_runs(plain, 4, 6)
        expected.append((i, runs, plain_collapse(plain, runs), len(plain)))
    assert seen == sorted(expected, key=key)
    assert periodic_runs.periodic_runs(spark.createDataFrame([], schema)).collect() == []


def test_op11_on_whole_table(spark, data):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_periodic_runs"](spark, data).collect()}
    looped = 0
    for i, text in documents(data):
        words, h = (text or "").split(), zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
            looped += 1
        if n > 1500:  # the plain definition is quadratic
            assert i in got
            continue
        runs = plain_runs(words, 4, 6)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else None
        facts = (*best, best[1] * 1000 // best[2]) if runs else (None,) * 4
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        assert got[i] == (len(runs), *facts, sha(lines), sha(plain_collapse(words, runs)))
    assert looped > 5


def test_planes_give_exact_products():
    maker = np.random.default_rng(1)
    a, b = maker.integers(0, 1 << 28, (40, 64)), maker.integers(0, 1 << 28, (5, 64))
    x, y = bit_planes.to_planes(a, 28), bit_planes.to_planes(b, 28)
    assert (bit_planes.dots(x, y) == a @ b.T).all()
    far = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    best, distance = bit_planes.nearest(x, y)
    assert (best == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()
    sums = bit_planes.plane_sums(x, best, 5)
    assert (sums == np.stack([a[best == k].sum(axis=0) for k in range(5)])).all()


def plain_clusters(rows, count=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    shift = lambda i: sha(f"3:{'' if i is None else i}")
    centroids = [v for _, v in sorted(kept, key=lambda r: shift(r[0]))[:count]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    place = lambda v: min(range(len(centroids)), key=lambda k: (far(v, centroids[k]), k))
    for _ in range(rounds):
        at = [place(v) for _, v in kept]
        for k in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, at) if c == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, place(v), far(v, centroids[place(v)])) for i, v in kept]
    inertia = [sum(d for _, c, d in out if c == k) for k in range(len(centroids))]
    digest = [sha(",".join(map(str, c))) for c in centroids]
    return [(i, c, d, inertia[c], sum(inertia), digest[c]) for i, c, d in out]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_clusters_of_awkward_vectors(spark):
    maker = random.Random(5)
    vector = lambda: [maker.gauss(0, 1) for _ in range(64)]
    same = vector()
    rows = [(k, vector()) for k in range(60)] + [(100 + k, same) for k in range(30)]
    rows += [(200, None), (201, same[:63]), (202, same + [1.0]), (203, [None, *same[1:]]), (204, [math.nan, *same[1:]]), (205, [math.inf, *same[1:]]), (206, [0.0] * 64), (207, [-100_000.5, *same[1:]]), (208, [])]
    table = [(*r, 1, "x") for r in rows]
    schema = "vec_id long, embedding array<double>, cluster int, planes string"
    got = bit_planes.clusters(spark.createDataFrame(table, schema).repartition(3))
    assert ordered(got.collect()) == ordered(plain_clusters(rows))
    few = rows[:3] + rows[:1]
    assert ordered(bit_planes.clusters(spark.createDataFrame([(*r, 1, "x") for r in few], schema)).collect()) == ordered(plain_clusters(few))
    assert bit_planes.clusters(spark.createDataFrame(table[-9:-6], schema)).collect() == []
    empty = bit_planes.clusters(spark.createDataFrame([], schema))
    assert empty.collect() == [] and empty.columns == got.columns


def test_op12_matches_sql(spark, data):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    got = QUERIES["op12_bit_plane_clusters"](spark, data)
    result = connection.execute(ORACLE["op12_bit_plane_clusters"])
    assert [d[0] for d in result.description] == got.columns
    assert ordered(got.collect()) == ordered(result.fetchall())


@pytest.fixture(scope="module")
def pieces():
    with open(MODEL, "rb") as file:
        raw = file.read()
    return raw, piece_merges.Merger(piece_merges.read_pieces(raw)), sentencepiece.SentencePieceProcessor(model_proto=raw)


def odd_texts():
    maker = random.Random(1)
    texts = ["", None, " ", "  a", "a", " " * 5000, "a" * 3000, "▁▁x ▁", "\x00\n\t", "你好世界 é ß 𝒳 \U0001f600 ", "<s></s><unk><0x41>", "é � é"]
    letters = "abcdefghijklmnopqrstuvwxyz    ABCeeett  .,0123456789\n\t你好éß▁\U0001f600"
    texts += ["".join(maker.choice(letters) for _ in range(maker.randrange(60))) for _ in range(800)]
    texts += ["".join(maker.choice("the ing on") for _ in range(maker.randrange(300))) for _ in range(300)]
    return texts + ["".join(maker.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2500))]


@pytest.mark.parametrize("bos, eos", [(False, True), (True, True), (True, False)])
def test_encoding_equals_the_library(pieces, bos, eos):
    _, merger, library = pieces
    texts = odd_texts()
    ids, counts = merger.encode(pa.array(texts, pa.string()), bos, eos)
    at = np.concatenate([[0], np.cumsum(counts)])
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode(text or "", add_bos=bos, add_eos=eos), text
    assert merger.decode(ids.astype(np.int64), counts).to_pylist() == [(t or "").replace("▁", " ") for t in texts]


def test_rounds_equal_the_heap(pieces, monkeypatch):
    _, merger, _ = pieces
    texts = pa.array(odd_texts(), pa.string())
    by_rounds = merger.encode(texts, False, False)
    monkeypatch.setattr(piece_merges, "LONG", 1)
    by_heap = merger.encode(texts, False, False)
    assert all((a == b).all() for a, b in zip(by_rounds, by_heap))


def test_decoding_of_any_ids(pieces):
    _, merger, library = pieces
    maker = random.Random(6)
    rows = [[maker.randrange(top) for _ in range(maker.randrange(12))] for top in (32_000, 262) for _ in range(1500)]
    for k in range(0, len(rows), 50):
        part = rows[k : k + 50]
        got = merger.decode(np.array(sum(part, []), np.int64), np.array([len(r) for r in part]))
        assert got.to_pylist() == [library.decode(r) for r in part]


def test_encode_frame(spark, pieces):
    raw, _, library = pieces
    rows = [(k % 9, t, "x") for k, t in enumerate(odd_texts()[:40])] + [(None, "a b", None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, counts string").repartition(3)
    got = piece_merges.encode(docs, raw)
    assert got.columns == ["doc_id", "counts", "ids"]
    expected = sorted((str(i), library.encode(t or "", add_eos=True)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.ids) for r in got.collect()) == expected
    back = piece_merges.decode(got, raw)
    assert back.columns == ["doc_id", "counts", "text"]
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(i), (t or "").replace("▁", " ")) for i, t, _ in rows)
    assert piece_merges.encode(docs.limit(0), raw).collect() == []
    lists = spark.createDataFrame([(1, None), (2, []), (3, [None, 2])], "doc_id long, ids array<int>")
    assert [r.text for r in piece_merges.decode(lists, raw).orderBy("doc_id").collect()] == ["", "", ""]


def test_other_models_are_refused():
    with pytest.raises(Exception):
        piece_merges.read_pieces(b"no model")


def test_op13_on_whole_table(spark, data, pieces):
    _, _, library = pieces
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_sentencepiece"](spark, data).collect()}
    for i, text in documents(data):
        ids = library.encode(text or "", add_eos=True)
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_long_words_have_prints_of_their_own():
    base = bytearray(b"a" * 20_000)
    other = bytearray(base)
    base[5], other[5 + (1 << 14) if 5 + (1 << 14) < 20_000 else 0] = ord("b"), ord("b")
    long = bytes(random.Random(7).choices(b"abcdefgh", k=60_000))
    swapped = bytearray(long)
    for k in range(100):
        swapped[k], swapped[k + (1 << 15)] = swapped[k + (1 << 15)], swapped[k]
    moved = long[1 << 14 : 2 << 14] + long[: 1 << 14] + long[2 << 14 :]
    texts = [bytes(x).decode() for x in (base, other, long, swapped, moved, long, long + b"x")]
    prints = [Words(pa.array([f"one {t} two"])).fingerprints()[1] for t in texts]
    assert prints[2] == prints[5]
    assert len(set(prints)) == 6
