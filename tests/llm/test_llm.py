"""The training-data operators against plain definitions, on given tables and on rows made to be awkward."""

import hashlib
import random
import re
import time
import zlib
from itertools import combinations_with_replacement

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gistmeter.llm import exact_trie, mixing, ngram_join, packing, pivot_index, quality, rendering, shared, substrings, toxicity, url_rules
from gistmeter.llm.queries import ORACLE, QUERIES
from gistmeter.llm.shared import shard_column, shard_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, size int, node string, label int"


def documents(spark, rows):
    """Rows of (doc_id, text, source), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, 1, 1, 1, "x", 1) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def awkward():
    maker = random.Random(4)
    base = [maker.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(maker.randrange(40)) for _ in range(400)]
    text = " ".join(base[:120])
    near = base[:118] + ["other", "end"]
    rows = [(1, text, "a"), (2, text.replace(" ", "\n\t"), "b"), (3, " ".join(near), None), (4, None, "a"), (5, "", None), (6, " \t\n", "b")]
    rows += [(7, "short one", "a"), (8, "Short ONE", "a"), (9, " ".join(base * 40), "c"), (10, " ".join(base[50:90] + base[200:300]), "c")]
    rows += [(11, "x" * 50_000, "c"), (12, "éß 你好 " * 30, "b"), (None, text, "a"), (13, text, "a"), (13, text, "a")]
    return rows


def sets_of(rows):
    out = {}
    for i, t, _ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    return out


def components_of(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_exact_groups(spark, awkward):
    got = exact_trie.exact_groups(documents(spark, awkward), trie_bytes=20_000).collect()
    groups = {}
    for i, t, _ in awkward:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    expected = []
    for i, t, _ in awkward:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[key])[2]
        expected.append((i, keep, len(groups[key]), i == keep, hashlib.sha256(key.encode()).hexdigest()))
    order = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert order(got) == order(expected)


def test_trie_spills_by_subtree():
    maker = random.Random(1)
    keys = [bytes(maker.choice(b"abc") for _ in range(maker.randrange(40))) for _ in range(3000)]
    trie = exact_trie.Trie(limit=30_000)
    expected = {}
    for n, key in enumerate(keys):
        trie.insert(key, (n,))
        first, count = expected.get(key, ((n,), 0))
        expected[key] = (first, count + 1)
    assert trie.files
    assert {k: (best, count) for k, best, count in trie.items()} == expected


def test_jaccard_groups(spark, awkward):
    rows = [r for r in awkward if r[0] is not None]
    sets = sets_of(rows)
    roots = components_of(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(documents(spark, awkward)).collect()}
    named = {i: v for i, v in got.items() if i is not None}
    assert named == {i: (len(sets[i]), roots[i]) for i in sets}
    assert got[None] == (len(sets[1]), None)


def test_jaccard_groups_of_a_crowd(spark):
    """Near copies of one text, pairs around the threshold, a passage in most documents."""
    maker = random.Random(9)
    word = lambda: "w" + str(maker.randrange(3000))
    base, passage = [word() for _ in range(60)], [word() for _ in range(30)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(maker.randrange(4)):
            text[maker.randrange(60)] = word()
        rows.append((i, " ".join(text), "a"))
    rows += [(i, " ".join([word() for _ in range(maker.randrange(4, 60))] + passage), "a") for i in range(150, 300)]
    sets = sets_of(rows)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_groups(documents(spark, rows)).collect()}
    assert got == components_of(sets)


def test_strip_repeats(spark, awkward):
    rows = sorted({r for r in awkward if r[0] is not None})
    words = {i: WORD.findall(t or "") for i, t, _ in rows}
    owner = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            owner.setdefault(tuple(words[i][k : k + 13]), i)
    got = {r.doc_id: r for r in substrings.strip_repeats(documents(spark, awkward)).collect()}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 12):
            if owner[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), len(gone), kept)
    assert got[None].n_removed == 0


@pytest.mark.parametrize("seed", range(5))
def test_knapsack_reaches_what_can_be_reached(seed):
    maker = np.random.default_rng(seed)
    lengths, counts = np.unique(maker.integers(1, 60, 8)), None
    counts = maker.integers(1, 4, len(lengths))
    total = int((lengths * counts).sum())
    sums = {0}
    for length, count in zip(lengths.tolist(), counts.tolist()):
        sums = {s + k * length for s in sums for k in range(count + 1)}
    for budget in range(total + 3):
        taken = mixing.fit(lengths, counts, budget)
        assert (taken <= counts).all() and (taken >= 0).all()
        assert int((taken * lengths).sum()) == max(s for s in sums if s <= budget)


def test_knapsack_keeps_to_counts_on_large_budgets():
    maker = np.random.default_rng(2)
    lengths = np.unique(maker.integers(1, 9000, 900))
    counts = maker.integers(1, 300, len(lengths))
    budget = int((lengths * counts).sum() * 0.37)
    taken = mixing.fit(lengths, counts, budget)
    assert (taken <= counts).all() and int((taken * lengths).sum()) == budget


@pytest.mark.parametrize("lengths, counts, budget, want", [
    (range(95_000, 105_000, 1000), [1] * 10, 621_875, 609_000),
    (range(95_000, 105_000, 1000), [1] * 10, 600_000, 600_000),
    ([69_000], [2], 70_000, 69_000),
    ([40_000, 66_000, 90_001], [3, 2, 1], 200_000, 196_001),
])
def test_knapsack_of_a_few_long_texts(lengths, counts, budget, want):
    taken = mixing.fit(np.array(lengths), np.array(counts), budget)
    assert (taken <= np.array(counts)).all() and int((taken * np.array(lengths)).sum()) == want


def test_knapsack_of_many_long_texts():
    maker = np.random.default_rng(6)
    lengths = np.unique(maker.integers(66_000, 2_000_000, 3000))
    counts = maker.integers(1, 4, len(lengths))
    budget = int((lengths * counts).sum() * 0.6)
    taken = mixing.fit(lengths, counts, budget)
    assert (taken <= counts).all() and (taken >= 0).all() and int((taken * lengths).sum()) == budget


def test_mix(spark, awkward):
    got = mixing.mix(documents(spark, awkward)).toPandas()
    assert len(got) == len(awkward) and got["times"].between(0, 2).all()
    assert sorted(got["size"]) == sorted(len(WORD.findall(t or "")) for _, t, _ in awkward)
    by = got.groupby("source", dropna=False).agg(size=("size", "sum"), goal=("target", "first"), taken=("taken", "sum"))
    assert by["goal"].sum() == pytest.approx(min(1.5, 2) * got["size"].sum())
    assert (by["goal"] <= 2 * by["size"] + 1e-6).all() and (by["taken"] <= by["goal"].round()).all()


def test_bounds_are_optimal():
    maker = np.random.default_rng(3)
    for _ in range(20):
        lengths = np.unique(maker.integers(1, 50, 7))
        counts = maker.integers(1, 9, len(lengths))
        pad = lambda bounds: sum(int(c) * (min(b for b in bounds if b >= x) - int(x)) for x, c in zip(lengths, counts))
        best = min(pad({*chosen, int(lengths[-1])}) for chosen in combinations_with_replacement(lengths.tolist(), 2))
        bounds = packing.best_bounds(lengths, counts, 3)
        assert len(bounds) <= 3 and pad(bounds) == best


def test_bounds_of_long_documents_are_lengths(spark):
    lengths = [5, 300, 2049, 20_020, 20_020, 21_840, 21_840, 21_840, 65_500, 65_530, 70_000]
    table = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
    for buckets in (2, 4, 16):
        got = packing.pack(table, buckets=buckets, budget=65_530, length=F.col("length")).toPandas()
        assert set(got["padded_length"]) <= set(lengths) and ((got["length"] > 65_530) == got["over_budget"]).all()
    assert (got["padded_length"] == got["length"]).all() and got[got["length"] == 21_840]["batch_docs"].tolist() == [3] * 3


def test_bounds_of_many_lengths_are_optimal():
    maker = np.random.default_rng(11)
    for apart in (None, 9000):
        lengths = np.unique(maker.integers(1, 30_000, 300))
        counts = maker.integers(1, 50, len(lengths))
        before = np.concatenate([[0], np.cumsum(counts)])
        cost = np.full((6, len(lengths) + 1), np.inf)
        cost[:, 0] = 0
        for k in range(1, 6):
            for j in range(1, len(lengths) + 1):
                start = 0 if apart is None or lengths[j - 1] <= apart else int((lengths <= apart).sum())
                cost[k, j] = (cost[k - 1, start:j] + lengths[j - 1] * (before[j] - before[start:j])).min()
        bounds = packing.best_bounds(lengths, counts, 5, apart)
        assert len(bounds) <= 5 and (np.array(bounds)[np.searchsorted(bounds, lengths)] * counts).sum() == cost[5, -1]


def test_only_the_last_batch_of_a_bucket_is_unfilled(spark):
    table = spark.range(70_000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 + 1).alias("length"))
    got = packing.pack(table, buckets=2, budget=30_000, length=F.col("length")).toPandas()
    sizes = got.groupby(["bucket", "shard", "batch"]).agg(n=("slot", "size"), slots=("slot", "nunique"), says=("batch_docs", "first"), width=("padded_length", "first"))
    assert len(got) == 70_000 and (sizes["n"] == sizes["slots"]).all() and (sizes["n"] == sizes["says"]).all()
    assert not sizes.reset_index().duplicated(["bucket", "batch"]).any()
    assert ((sizes["n"] < 30_000 // sizes["width"]).groupby("bucket").sum() <= 1).all() and (sizes["n"] <= 30_000 // sizes["width"]).all()


def test_pack(spark, awkward):
    got = packing.pack(documents(spark, awkward), buckets=4, budget=1000).toPandas()
    assert len(got) == len(awkward) and (got["length"] <= got["padded_length"]).all()
    batch = got.groupby(["bucket", "shard", "batch"])
    assert (batch["slot"].nunique() == batch.size()).all() and (batch["batch_docs"].first() == batch.size()).all()
    full = batch["padded_length"].sum()
    assert ((full <= 1000) | (batch.size() == 1)).all()


def test_url_rules(spark):
    urls = ["http://WWW.Example.com/en/a", "https://example.com/en/", "http://example.com", "http://a.b.example.com/en/x?y", "ftp://x.net/es/1#z"]
    urls += ["http://net/fr/2", "http://notexample.com/en/", "http://example.com.evil.org/en/", None, "", "no scheme", "http://", "http://com/", "http://example.com/en/" * 3000]
    rows = [(k, u, "<p>", 1) for k, u in enumerate(urls)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key long")
    rules = spark.createDataFrame(url_rules.RULES, "verdict string, host string, path string")
    got = url_rules.judge(pages, rules, target=3).collect()
    assert len(got) == len(rows)
    for r in got:
        url = urls[r.page_id] or ""
        host, _, _ = ("", "", "") if "://" not in url else (re.split(r"[/?#]", url.split("://", 1)[1])[0].translate(LOWER), 0, 0)
        path = re.match(r"[^/?#]*([^?#]*)", url.split("://", 1)[1], re.S)[1] if "://" in url else ""
        fits = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[1], best[2])


@pytest.mark.parametrize("target", [7, 1_000_000])
def test_many_nested_url_rules(spark, target):
    maker = random.Random(17)
    labels, parts = "a b c ab com".split(), ["", "/", "x", "x/", "xy", "é", "-", "/x/y/z", "\U0010ffff"]
    host = lambda: ".".join(maker.choice(labels) for _ in range(maker.randrange(1, 5)))
    path = lambda: "/" + "".join(maker.choice(parts) for _ in range(maker.randrange(4)))
    rules = list({(h, p): (maker.choice(["allow", "block"]), h, p) for h, p in ((host(), maker.choice([path(), path(), ""])) for _ in range(600))}.values())
    urls = [f"http://{host()}{maker.choice([path(), path() + path(), ''])}" for _ in range(700)] + ["http://", None, "http://.a./x", "http://a..b/x"]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, anchor string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = url_rules.judge(pages, table, target=target).collect()
    assert sorted(r.page_id for r in got) == list(range(len(urls)))
    for r in got:
        fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        assert (r.rule, r.verdict) == (best[2], best[3]), urls[r.page_id]
    assert url_rules.judge(pages, table.limit(0)).where("rule is not null").isEmpty()
    assert url_rules.judge(pages.limit(0), table).collect() == []


def test_pages_of_one_template_do_not_meet(spark, monkeypatch):
    """Pages that share most words but too few to link: pairs looked at grow with the pages, not with their square."""
    looked_at = []

    def counting(postings, verify, *rest):
        def counted(pairs):
            looked_at.append(pairs.count())
            return verify(pairs)

        return shared.linked_groups(postings, counted, *rest)

    monkeypatch.setattr(ngram_join, "linked_groups", counting)
    total = {}
    for pages in (200, 800):
        maker = random.Random(5)
        template = [f"t{k}" for k in range(240)]
        rows = [(i, " ".join(template + [f"o{maker.randrange(10**6)}" for _ in range(50 + maker.randrange(8))]), "a") for i in range(pages)]
        # Every tenth page has a near copy.
        rows += [(pages + i, rows[i][1] + " tail", "a") for i in range(0, pages, 10)]
        looked_at.clear()
        got = {r.doc_id: r.component_id for r in ngram_join.jaccard_groups(documents(spark, rows)).collect()}
        assert got == {i: i if i < pages else i - pages for i, *_ in rows}
        total[pages] = sum(looked_at)
    assert total[800] <= 5 * total[200] + 100


@pytest.mark.parametrize("rounds, pairs", [(1, 0), (4, 0), (2, 10**9)])
def test_crowds_in_few_and_many_rounds(spark, monkeypatch, rounds, pairs):
    """Near copies of some centres around the threshold: all components, however many star rounds there are."""
    maker = random.Random(21)
    rows = []
    for crowd in range(4):
        base = [f"c{crowd}w{k}" for k in range(60)]
        for _ in range(30):
            words = list(base)
            for _ in range(maker.randrange(9)):
                words[maker.randrange(60)] = f"x{maker.randrange(400)}"
            rows.append((len(rows), " ".join(words), "a"))
    monkeypatch.setattr(shared, "ROUNDS", rounds)
    monkeypatch.setattr(shared, "PAIRS", pairs)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_groups(documents(spark, rows)).collect()}
    assert got == components_of(sets_of(rows))


def test_near_vectors(spark):
    maker = np.random.default_rng(8)
    centres = maker.normal(size=(40, 16))
    vectors = [c + 0.12 * maker.normal(size=16) for c in centres for _ in range(6)]
    vectors += [3 * vectors[0], vectors[1], vectors[1]]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [float("nan")] + [1.0] * 15), (n + 4, [None] + [1.0] * 15), (n + 5, [1.0, 2.0]), (None, rows[0][1])]
    table = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], "vec_id long, embedding array<double>, label int, node string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivot_index.near_vectors(table).collect()}
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    found = sum(got[i][0] for i in range(n))
    assert found >= 0.97 * (link.sum() - n) and all(got[i][0] <= link[i].sum() - 1 for i in range(n))
    assert all(got[i] == (0, i, True) for i in range(n, n + 6)) and got[None] == (0, None, False)


def planted_pairs(pairs, maker, width=64):
    """Separate pairs of vectors at cosine 0.90 to 0.92, one after the other."""
    x, z = maker.normal(size=(2, pairs, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    cosine = maker.uniform(0.9001, 0.92, (pairs, 1))
    return np.stack([x, cosine * x + np.sqrt(1 - cosine**2) * z], axis=1).reshape(-1, width)


@pytest.mark.parametrize("pivots", [512, 2000, 16_384])
def test_candidates_do_not_thin_out_with_pivots(pivots):
    maker = np.random.default_rng(pivots)
    vectors = planted_pairs(400, maker)
    points = maker.normal(size=(pivots, 64))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    batch = pa.RecordBatch.from_pydict({"node": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors.tolist(), pa.list_(pa.float64()))})
    keys, near = {}, {}
    for rows in pivot_index._index(points)([batch]):
        for node, deep, own, *_ in zip(*(c.to_pylist() for c in rows.columns)):
            keys[node], near[node] = set(own), set(deep)
    found = sum(bool(keys[k] & keys[k + 1]) and len(near[k] & near[k + 1]) >= pivot_index.SHARED for k in range(0, len(vectors), 2))
    assert found >= 0.99 * 400


def test_links_in_crowds_are_counted_by_block(spark, monkeypatch):
    """Tight crowds link as whole blocks, loose ones are compared; shorter vectors and copies stand beside them."""
    monkeypatch.setattr(pivot_index, "BLOCK", 16)
    maker = np.random.default_rng(31)
    centres = maker.normal(size=(3, 16))
    spread = np.repeat([0.02, 0.25, 0.45], 120)[:, None]
    vectors = np.repeat(centres, 120, axis=0) + spread * maker.normal(size=(360, 16))
    vectors[10:40] = vectors[10]
    rows = [(k, v) for k, v in enumerate(vectors.tolist())] + [(1000 + k, v[:9]) for k, v in enumerate(vectors[:150].tolist())]
    got = {r.vec_id: r.n_links for r in pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for part, base in ((vectors, 0), (vectors[:150, :9], 1000)):
        unit = part / np.linalg.norm(part, axis=1, keepdims=True)
        cosine = unit @ unit.T
        sure = np.abs(cosine - 0.9).min() > 1e-12
        assert sure and [got[base + k] for k in range(len(part))] == ((cosine >= 0.9).sum(1) - 1).tolist()


def test_near_vectors_with_far_fewer_pivots(spark):
    vectors = planted_pairs(3000, np.random.default_rng(12))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    table = spark.createDataFrame([(k, v) for k, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in pivot_index.near_vectors(table).collect()}
    links = (unit @ unit.T >= 0.9).sum(1) - 1
    # The queries are the ids divisible by 100, all ids are the wider check.
    for ids in (range(0, len(vectors), 100), range(len(vectors))):
        assert sum(got[k] for k in ids) >= 0.99 * links[list(ids)].sum()


def test_render():
    page = """<title>no</title><ul><li>one<li>two<ol start=3><li>a<li>b<p>para</ol></ul>
    <table><tr><th>Name<th>Qty<tr><td>apple pie<td>3</table><div hidden>no</div><p style="display: none">no<p>yes<br>more
    <pre>  a\n   b</pre>&amp;end<script>no("</p>")</script><b><i>x</b>y<!-- no -->"""
    text = rendering.render(page)
    assert "no" not in re.findall(r"\w+", text)
    assert "- one\n- two\n  3. a\n  4. b\n\n     para" in text
    assert "Name       Qty\napple pie  3" in text
    assert "yes\nmore" in text and "  a\n   b" in text and text.endswith("&endxy")
    assert rendering.render(None) == rendering.render("") == rendering.render("<p></p>") == ""
    assert rendering.render("<div>" * 5000 + "deep").strip() == "deep"
    assert rendering.render("a<![if x]>b").startswith("a")


class Plain:
    """Lines of a block by plain recursion: lists are copied and indented at every level."""

    def __init__(self):
        self.lines, self.run, self.gap = [], [], False

    def flush(self):
        if self.run:
            self.lines += [""] * bool(self.gap and self.lines) + [" ".join(self.run)]
            self.run, self.gap = [], False

    def add(self, lines, spaced):
        self.flush()
        if lines:
            self.lines += [""] * bool(self.lines and (spaced or self.gap)) + lines
            self.gap = spaced


def made_block(maker, depth, item=False):
    """A random piece of a page: its HTML, and its lines laid out plainly."""
    html, out = "", Plain()
    words = lambda: " ".join(maker.choice("alpha beta gamma delta".split()) for _ in range(maker.randrange(1, 5)))
    for _ in range(maker.randrange(1, 4)):
        kind = maker.choice("text div p h2 ul ol blockquote hidden style shut open dialog table comment".split()) if depth else "text"
        inner, below = made_block(maker, depth - 1, kind in ("ul", "ol")) if depth else ("", [])
        if kind == "text":
            out.run.append(words())
            html += maker.choice(["{} ", " <b>{}</b>\n", "<span>{}</span> "]).format(out.run[-1])
        elif kind in ("p", "h2"):
            text = words()
            html += f"<{kind}>{text}</{kind}>"
            out.add([text], True)
        elif kind in ("ul", "ol"):
            items = Plain()
            first, tags = maker.randrange(9), ""
            for k in range(maker.randrange(1, 3)):
                if k:
                    inner, below = made_block(maker, depth - 1, True)
                mark = f"{first + k}. " if kind == "ol" else "- "
                items.add([(" " * len(mark) if n else mark) + x if x else x for n, x in enumerate(below)], False)
                tags += "<li>" + inner + maker.choice(["", "</li>"])
            html += f"<{kind} start={first}>{tags}</{kind}>"
            out.add(items.lines, not item)
        elif kind == "blockquote":
            html += f"<blockquote>{inner}</blockquote>"
            out.add(["  " + x if x else x for x in below], True)
        elif kind == "table":
            rows = [[words() for _ in range(3)] for _ in range(3)]
            wide = [max(len(r[c]) for r in rows) for c in range(3)]
            html += "<table>" + "".join("<tr>" + "".join(f"<th>{c}" for c in r) for r in rows) + "</table>"
            out.add(["  ".join(c.ljust(w) for c, w in zip(r, wide)).rstrip() for r in rows], True)
        elif kind in ("div", "open"):
            html += f"<div>{inner}</div>" if kind == "div" else f"<details open>{inner}</details>"
            out.add(below, False)
        elif kind == "shut":
            title = words()
            html += f"<details>{inner}<summary>{title}</summary>{inner}</details>"
            out.add([title], False)
        else:
            shapes = {"hidden": "<div hidden>{}</div>", "style": "<section style='color:red; display: none'>{}</section>", "dialog": "<dialog>{}</dialog>", "comment": "<!-- {} -->"}
            html += shapes[kind].format(words() if kind == "comment" else inner)
            if kind != "comment":
                out.flush()
    out.flush()
    return html, out.lines


def test_render_equals_plain_layout():
    maker = random.Random(11)
    for _ in range(400):
        html, lines = made_block(maker, maker.randrange(1, 6))
        assert rendering.render(html) == "\n".join(lines).strip("\n"), html


@pytest.mark.parametrize(
    "piece, times, most",
    [("<div>", 10_000, 1), ("<div>x", 10_000, 2), ("<ul><li>x", 4000, 6), ("<ol><li>x", 4000, 6), ("<blockquote>x", 4000, 5)]
    + [("<table><tr><th>a<td>", 2000, 2), ("<a x='", 20_000, 1), ("<a ", 30_000, 1), ("<!--", 20_000, 1), ("<details>x", 10_000, 1)],
)
def test_render_grows_with_the_page(piece, times, most):
    seconds = []
    for n in (times, 2 * times):
        start = time.process_time()
        text = rendering.render(piece * n + "end")
        seconds.append(time.process_time() - start)
        assert len(text) <= most * n * len(piece)
    assert seconds[1] < 3.5 * seconds[0] + 0.2


def test_render_keeps_wide_tables_small():
    wide = "<table><tr><th>" + "w" * 20_000 + "<td>y" + "<tr><td>a<td>b" * 3000 + "</table>"
    text = rendering.render(wide)
    assert len(text) < len(wide) and text.split("\n")[1] == "a  b"
    many = "<table><tr>" + "<td>c" * 5000 + "<tr><td>r" * 5000 + "</table>"
    assert len(rendering.render(many)) < len(many)
    down = "<table>" + "".join(f"<tr><td rowspan={2 + i % 997}>c<td>d" for i in range(3000)) + "</table>"
    assert rendering.render(down).count("d") == 3000


@pytest.mark.parametrize(
    "page, text",
    [
        ("<details><summary>s</summary>body</details>z", "s\nz"),
        ("<details open><summary>s</summary>body</details>z", "s\nbody\nz"),
        ("<details hidden><summary>s</summary>b</details>z", "z"),
        ("<details style='display:none'>x</details>z", "z"),
        ("<details><summary>s</summary><summary>t</summary><p>x</details>z", "s\nz"),
        ("<div hidden><details><summary>s</summary>b</details></div>z", "z"),
        ("<dialog>d</dialog>z", "z"),
        ("<dialog open>d</dialog>z", "d\nz"),
        ("a<!-- b", "a"),
        ("a<b href='x", "a"),
        ("a < b", "a < b"),
    ],
)
def test_render_shows_what_a_browser_shows(page, text):
    assert rendering.render(page) == text


def test_render_tells_data_tables_by_structure():
    table = "<table{}><tr><td>Name<td>Parts<td>Price<tr><td>kit<td>{}<td>30<tr><td>{}<td>nuts<td>4</table>"
    want = "Name  Parts  Price\nkit   {1:5}  30\n      {0}two\n      {0}six\n      {0}ten\n      {0}end\nbox   nuts   4"
    for cell, mark in (("<ul><li>one<li>two<li>six<li>ten<li>end</ul>", "- "), ("one<br>two<br>six<br>ten<br>end", "")):
        assert rendering.render(table.format("", cell, "<p>box</p>")) == want.format(mark, mark + "one")
    by_cell = "Name\nParts\nPrice\nkit\nbolt\n30\nbox\nnuts\n4"
    assert rendering.render(table.format(" role=presentation", "bolt", "box")) == by_cell
    assert rendering.render(table.format("", "bolt", "<table><tr><td>box</table>")).replace("\n\n", "\n") == by_cell
    headed = "<table><tr><th>Name<th>Notes<tr><td>kit<td><h3>Sizes</h3><table><tr><td>a<td>b</table></table>"
    assert "Name  Notes\nkit   Sizes\n" in rendering.render(headed)
    page = "<table><tr><td><h2>News</h2><p>First</p><td><h2>Links</h2><p>Second</p></table>"
    assert rendering.render(page) == "News\n\nFirst\nLinks\n\nSecond"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>T</title><p>Hello", "Hello"),
        ("<head><meta charset=utf-8><title>T</title>\n Hello <b>you</b>", "Hello you"),
        ("<head><noscript><p>no</p></noscript><template><p>no</p></template><style>p{}</style><img src=x>yes", "yes"),
        ("<head><title>T</title><head><link rel=x>yes</head> and more", "yes and more"),
        ("<body><head><title>T</title>yes", "yes"),
        ("<p>area <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>no</annotation></math> here", "area x+1 here"),
        ("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><text>Left</text><text>Right</text></svg>after", "Left\nRight\nafter"),
        ("<svg/>one <svg><defs/><path d=x /></svg>two", "one two"),
        ("<svg><defs><p>yes", "yes"),
        ("<desc>yes</desc>", "yes"),
    ],
)
def test_render_open_heads_and_drawings(page, text):
    assert rendering.render(page) == text


@pytest.mark.parametrize("module, column, parts, held", [(quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)])
def test_classifiers_on_held_out_rows(spark, module, column, parts, held):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = getattr(module, column if column == "quality" else "toxicity")(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % parts == held for i in got["doc_id"]]).all()
    assert ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    known = got[got["held_out"]].merge(labels.toPandas(), on="doc_id")
    assert (known["predicted"] == known[column]).mean() > (0.98 if column == "quality" else 0.94)


@pytest.mark.parametrize("module, column", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_awkward_rows(spark, awkward, module, column):
    name = column if column == "quality" else "toxicity"
    docs = documents(spark, awkward)
    labels = spark.createDataFrame([(1, 1), (3, 0), (9, 1), (None, 1), (5, None), (99, 0)], f"doc_id long, {column} int")
    got = getattr(module, name)(docs, labels).collect()
    assert len(got) == len(awkward) and all(r.score == 0 for r in got if r.doc_id in (4, 5, 6))
    none = getattr(module, name)(docs, labels.where("doc_id = -1")).collect()
    assert {round(r.score, 6) for r in none if r.doc_id == 1} == {1.0 if column == "quality" else 0.0}


def test_empty_tables(spark):
    docs = documents(spark, [])
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    rules = spark.createDataFrame(url_rules.RULES, "verdict string, host string, path string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    results = [packing.pack(docs), mixing.mix(docs), rendering.rendered(pages), ngram_join.jaccard_groups(docs), url_rules.judge(pages, rules)]
    results += [substrings.strip_repeats(docs), toxicity.toxicity(docs, labels), pivot_index.near_vectors(vectors), quality.quality(docs, labels), exact_trie.exact_groups(docs)]
    assert [r.count() for r in results] == [0] * 10


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, data, name):
    connection = duckdb.connect()
    for table in ("documents", "pages"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    want = connection.execute(ORACLE[name]).df()
    got = QUERIES[name](spark, data).toPandas()[list(want)]
    order = lambda df: sorted(map(str, df.astype(object).where(pd.notna(df), None).itertuples(index=False, name=None)))
    assert order(got) == order(want)


def test_pipeline(spark, data):
    """Every stage against what it should keep of its own input."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, data), "test")
        before = {r.doc_id: r.text for r in docs.collect()}
        after = [r.doc_id for r in out.collect()]
        if name == "exact dedup":
            assert len(after) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in before.values()})
        if name == "near duplicates":
            roots = components_of(sets_of([(i, t, None) for i, t in before.items()]))
            assert sorted(after) == sorted({r for r in roots.values()})
        if name == "mixing":
            words = sum(len(WORD.findall(before[i] or "")) for i in after)
            assert words == pytest.approx(1.5 * sum(len(WORD.findall(t or "")) for t in before.values()), rel=0.02)
        if name == "packing":
            assert sorted(after) == sorted(r.doc_id for r in docs.select("doc_id").collect())
        else:
            assert out.columns == columns and set(after) <= set(before)
        docs = out


def stage(spark, name, rows, tmp_path, files=3):
    """A stage of the pipeline on given rows, from files and from a frame that is none."""
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    made = documents(spark, rows).withColumnsRenamed({"n": "row_number", "size": "component_id", "node": "times"})
    path = f"{tmp_path}/docs-{name.replace(' ', '-')}-{len(rows)}"
    made.repartition(files).write.mode("overwrite").parquet(path)
    run = dict(corpus_pipeline.STAGES)[name]
    from_files = run(spark, spark.read.parquet(path), str(tmp_path))
    assert from_files.columns == made.columns
    told = lambda df: sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=str)
    out = told(from_files)
    assert told(run(spark, made, str(tmp_path))) == out
    return out


def test_stages_decide_by_row(spark, tmp_path):
    rows = [(3, "same words here", "a"), (7, "same words here", "a"), (7, "a wholly different second text", "a")]
    rows += [(9, "twice", "a"), (9, "twice", "a"), (None, "twice", "a"), (None, "twice", "a"), (8, "tw ice", "a")]
    rows += [(None, "only without an id", "a")] * 2 + [(1, None, "a"), (1, "", None), (2, " \t", "b")]
    expected = [(3, "same words here", "a"), (7, "a wholly different second text", "a"), (8, "tw ice", "a"), (None, "only without an id", "a"), (2, " \t", "b")]
    assert stage(spark, "exact dedup", rows, tmp_path) == sorted(expected, key=str)
    assert stage(spark, "exact dedup", rows[:0], tmp_path) == []
    words = [f"w{k}" for k in range(40)]
    base, near, far = " ".join(words), " ".join([*words[:39], "x"]), " ".join(words[20:] + words[:10])
    rows = [(5, base, "a"), (4, near, "a"), (4, far, "b"), (None, base, "a"), (None, base, "a"), (6, None, "a"), (6, None, "a"), (5, "", None)]
    expected = [(4, near, "a"), (4, far, "b"), (6, None, "a"), (6, None, "a"), (5, "", None)]
    assert stage(spark, "near duplicates", rows, tmp_path) == sorted(expected, key=str)
    assert stage(spark, "near duplicates", rows[:0], tmp_path) == []


def test_mixing_stage_takes_rows(spark, tmp_path):
    rows = [(1, "a b c", "s")] * 6 + [(None, "d e f", "s")] * 6 + [(2, "x y z", None)] * 12
    got = stage(spark, "mixing", rows, tmp_path)
    taken = {s: sum(3 for r in got if r[2] == s) for s in ("s", None)}
    goal = {r.source: r.target for r in mixing.mix(documents(spark, rows)).collect()}
    assert all(abs(taken[s] - goal[s]) <= 3 for s in taken)
    assert stage(spark, "mixing", rows[:0], tmp_path) == []


def test_text_columns_keep_their_offsets():
    column = pa.array(["zero", None, "one two", ""]).slice(1)
    from gistmeter.llm.shared import Words

    assert Words(column).count.tolist() == [0, 2, 0]


def test_shards_agree_and_spread(spark):
    ids = np.array([0, 1, -1, -(2**63), 2**63 - 1, *(200 * k for k in range(2000))], np.int64)
    told = spark.createDataFrame([(int(i),) for i in ids], "doc_id long").select("doc_id", shard_column("doc_id", 200).alias("shard"))
    assert dict(told.collect()) == dict(zip(ids.tolist(), shard_of(ids, 200).tolist()))
    assert np.bincount(shard_of(ids, 200)).max() < 60
