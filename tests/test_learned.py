"""Subwords, drifting keys, versions, learnt boundaries, centrality, neighbours, footers, sketches, a stream."""

import math
import os
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gistmeter.operators import boundaries, centrality, drifting, neighbours, subwords, trials
from gistmeter.session import fresh_path
from gistmeter.sources import footers, snapshots
from gistmeter.streaming import plateau

BYTES = {bytes([b]): b for b in range(256)}


def plain_merge(word, ranks):
    parts = [word[k : k + 1] for k in range(len(word))]
    while True:
        pairs = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, k = min(pairs)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_merges_go_by_rank():
    maker = random.Random(3)
    tokens = sorted({bytes(maker.choice(b"abc") for _ in range(maker.randrange(2, 5))) for _ in range(60)})
    maker.shuffle(tokens)
    ranks = BYTES | {t: 256 + k for k, t in enumerate(tokens)}
    for _ in range(400):
        word = bytes(maker.choice(b"abcd") for _ in range(maker.randrange(1, 30)))
        if word not in ranks:
            assert subwords.merged(word, ranks) == plain_merge(word, ranks)
    assert len(subwords.merged(b"ab" * 50_000, ranks)) > 0


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_subwords_of_awkward_texts(spark, broadcast_rows):
    ranks = BYTES | {b" the": 256, b"th": 257, b"the": 258, b"\n\n": 259, b"  ": 260}
    texts = ["", None, "the the  the", "a\n\n b \n", "你好 é\U0001f600", "it's " * 20, "x" * 5000, " \t ", "a\x85b"]
    df = spark.createDataFrame([(k, t, "ids") for k, t in enumerate(texts)], "id long, text string, piece string")
    encoded = subwords.encode_subwords(df, "id", "text", ranks, broadcast_rows)
    back = encoded.select("id", "ids", subwords.decode_subwords("ids", ranks).alias("t")).collect()
    assert {r.id: r.t for r in back} == {k: t or "" for k, t in enumerate(texts)}
    assert {r.id: r.ids for r in back}[2] == [257 + 1, 256, 32, 256]
    assert subwords.encode_subwords(df.limit(0), "id", "text", ranks).collect() == []
    with pytest.raises(ValueError):
        subwords.encode_subwords(df, "id", "text", {b"a": 0})


def test_vocabulary_file(spark, tmp_path):
    (tmp_path / "ranks").write_text("YQ== 0\nYmM= 1\n\n")
    assert subwords.read_ranks(spark, str(tmp_path / "ranks")) == {b"a": 0, b"bc": 1}


def test_no_drifting_key_is_lost(spark):
    rows = ['{"k":1,"o":{"x":1.5,"y z":{"q.r":true}},"e":{}}', '{"k":"s","arr":[1,2],"N":null}', None, '{"late":2,"o":{"x":3}}', '{"n":1,"it\'s":3,"K":4}', "7"]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, c string").select("id", F.parse_json("c").alias("c"), F.lit(0).alias("c.late"))
    flat = drifting.flatten_drifting(df, "c")
    got = {r["id"]: r.asDict() for r in flat.collect()}
    assert set(flat.columns) == {"id", "c.late", "c.K", "c.N", "c.arr", "c.e", "c.it's", "c.k_2", "c.late_2", "c.n_2", "c.o.x", "c.o.y z.q.r"}
    assert (got[0]["c.k_2"], got[1]["c.k_2"], got[4]["c.K"]) == ("1", "s", 4)
    assert (got[0]["c.o.x"], got[3]["c.o.x"], got[0]["c.o.y z.q.r"]) == (1.5, 3.0, True)
    assert (got[1]["c.arr"], got[0]["c.e"], got[4]["c.it's"], got[3]["c.late_2"]) == ("[1,2]", "{}", 3, 2)
    assert all(v is None for k, v in got[2].items() if k.startswith("c.") and k != "c.late") and got[5]["c.K"] is None
    assert drifting.flatten_drifting(df.limit(0), "c").columns == ["id", "c.late"]
    with pytest.raises(ValueError):
        drifting.flatten_drifting(df, "c", most_keys=3)


def states(spark, path, version=None):
    return {r.id: r.s for r in snapshots.read(spark, path, version).collect()}


def test_versions_of_a_table(spark):
    path = fresh_path(spark, "table")
    start = spark.range(50).select("id", F.lit("a").alias("s"))
    assert snapshots.create(start, path, ["id"], buckets=8) == 0
    changes = spark.createDataFrame([(3, "b"), (99, None)], "id int, s string")
    assert snapshots.merge(changes, path) == 1
    assert states(spark, path) == {k: "a" for k in range(50)} | {3: "b", 99: None}
    assert states(spark, path, 0) == {k: "a" for k in range(50)}
    # Only touched buckets are new.
    old, new = (snapshots.manifest(spark, path, v)["folders"] for v in (0, 1))
    assert 1 <= sum(old.get(k) != new[k] for k in new) <= 2
    assert snapshots.merge(changes.limit(0), path) == 2 and len(states(spark, path)) == 51
    with pytest.raises(snapshots.Conflict):
        snapshots.create(start, path, ["id"])
    for bad in ([(1, "x"), (1, "y")], [(None, "x")]):
        with pytest.raises(ValueError):
            snapshots.merge(spark.createDataFrame(bad, "id long, s string"), path)
    assert snapshots.versions(spark, path) == [0, 1, 2]
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, path, 7)


def test_a_writer_that_dies_or_loses_changes_nothing(spark, monkeypatch):
    path = fresh_path(spark, "table")
    snapshots.create(spark.range(20).select("id", F.lit("a").alias("s")), path, ["id"], buckets=4)
    one, two = (spark.createDataFrame([(1, s)], "id long, s string") for s in ("one", "two"))

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(snapshots, "_commit", dies)
        with pytest.raises(KeyboardInterrupt):
            snapshots.merge(one, path)
    assert states(spark, path) == {k: "a" for k in range(20)} and snapshots.versions(spark, path) == [0]
    assert snapshots.merge(two, path, base=0) == 1
    with pytest.raises(snapshots.Conflict):
        snapshots.merge(one, path, base=0)
    assert states(spark, path)[1] == "two"
    assert snapshots.merge(one, path) == 2 and states(spark, path)[1] == "one" and states(spark, path, 1)[1] == "two"


def test_boundaries_are_learnt(spark):
    texts = ["We met Dr. Brown there. The talk was long again. The end came at noon (approx. 12 h) today. Was it? The man knew."] * 40
    texts += [f"A word{i} stands in the text. Another{i} stands in a text! The thing{i} goes on" for i in range(80)]
    texts += ["There again it stands today and they knew noon and text and there again we talk today of what they knew"] * 3
    texts += ["", None, "no stop", "Seen by Dr. The others went."]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "id long, t string, type string")
    model = boundaries.sentence_model(df, "t")
    short = {r.type for r in model.where("abbreviation").collect()}
    assert "dr" in short and not short & {"there", "again", "text", "12", "today"}
    starters = boundaries.sentence_starters(df, "id", "t", model)
    assert "the" in {r.type for r in starters.collect()}
    cut = {}
    for r in boundaries.split_learned(df, "id", "t", model, starters).orderBy("id", "pos").collect():
        cut.setdefault(r.id, []).append(r.sentence)
    assert cut[0] == ["We met Dr. Brown there.", "The talk was long again.", "The end came at noon (approx. 12 h) today.", "Was it?", "The man knew."]
    assert cut[len(texts) - 1] == ["Seen by Dr.", "The others went."] and cut[len(texts) - 2] == ["no stop"]
    assert len(texts) - 3 not in cut and len(texts) - 4 not in cut
    for table in (df.limit(0), df.where("t = ''")):
        nothing = boundaries.sentence_model(table, "t")
        assert nothing.collect() == []
        assert boundaries.split_learned(table, "id", "t", nothing, boundaries.sentence_starters(table, "id", "t", nothing)).collect() == []


def plain_walk(token_lists, rounds=10, damping=0.85):
    n = len(token_lists)
    units = []
    for tokens in token_lists:
        size = math.sqrt(sum(tokens.count(t) ** 2 for t in set(tokens)))
        units.append({t: tokens.count(t) / size for t in set(tokens)})
    w = [[0.0 if i == j else sum(x * units[j].get(t, 0) for t, x in units[i].items()) for j in range(n)] for i in range(n)]
    degree = [sum(row) for row in w]
    rank = [1 / n] * n
    for _ in range(rounds):
        rank = [(1 - damping) / n + damping * sum(w[i][j] * rank[j] / degree[j] for j in range(n) if degree[j] > 0) for i in range(n)]
    return rank


def test_centrality_equals_the_dense_walk(spark):
    maker = random.Random(8)
    texts = [". ".join(" ".join(maker.choice("abcdefghij") for _ in range(maker.randrange(1, 6))) for _ in range(maker.randrange(1, 9))) for _ in range(60)]
    texts += ["", None, "... !!! ???", "alone", "x y. z w. x q"]
    df = spark.createDataFrame([(k, t, 0.5) for k, t in enumerate(texts)], "id long, t string, centrality double")
    for r in centrality.with_centrality(df.drop("centrality"), "t").collect():
        parts = [[t for t in s.lower().replace(".", " ").replace("!", " ").replace("?", " ").split()] for s in r.sentences]
        assert len(r.sentences) == len(r.centrality)
        if parts and all(parts):
            assert r.centrality == pytest.approx(plain_walk(parts))
    best = {r.id: r for r in centrality.central_sentences(df, "id", "t", 2).collect()}
    assert len(texts) - 5 not in best and len(texts) - 4 not in best
    assert best[len(texts) - 2].sentence == "alone"


@pytest.mark.parametrize("rows, dim, k, pivots", [(300, 3, 5, None), (300, 8, 1, 40), (4, 3, 5, None), (200, 2, 3, 1)])
def test_nearest_rows_are_exact(spark, rows, dim, k, pivots, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    maker = np.random.default_rng(rows + dim)
    vectors = maker.normal(size=(rows, dim)).round(1)
    if rows > 100:
        vectors[50:120] = vectors[3]
    ids = maker.permutation(10 * rows)[:rows]
    table = [(int(i), v.tolist(), 1.0) for i, v in zip(ids, vectors)]
    odd = [(None, [0.0] * dim, 1.0), (-1, None, 1.0), (-2, [math.nan] * dim, 1.0), (-3, [None] + [0.0] * (dim - 1), 1.0), (-4, [], 1.0)]
    df = spark.createDataFrame(table + odd, "id long, v array<double>, distance double")
    got = {}
    for r in neighbours.nearest_rows(df, "id", "v", k, pivots).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbour, round(r.distance, 9)))
    far = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(axis=2))
    for a in range(rows):
        order = sorted((far[a, b], int(ids[b])) for b in range(rows) if b != a)[:k]
        assert sorted(got.get(int(ids[a]), [])) == [(n + 1, i, round(float(d), 9)) for n, (d, i) in enumerate(order)]
    assert set(got) == {int(i) for i in ids}
    assert neighbours.nearest_rows(df.where("id < 0"), "id", "v").collect() == []


def test_far_cells_are_not_visited():
    maker = np.random.default_rng(4)
    centres = maker.normal(size=(30, 4)) * 50
    rows = (centres[:, None] + maker.normal(size=(30, 40, 4))).reshape(-1, 4)
    far = np.sqrt(((rows[:, None] - centres[None]) ** 2).sum(axis=2))
    cell, own = far.argmin(axis=1), far.min(axis=1)
    near = np.array([np.sort(own[cell == c])[:6] for c in range(30)])
    radius = np.array([own[cell == c].max() for c in range(30)])
    batch = neighbours.pa.RecordBatch.from_arrays([neighbours.pa.array(range(len(rows))), neighbours.pa.array(rows.tolist()), neighbours.pa.array(cell.astype(np.int32))], names=["node", "vector", "cell"])
    visits = sum(b.num_rows for b in neighbours._visits(centres, radius, near, np.ones(30, np.int64), 5)([batch]))
    assert len(rows) <= visits < 0.15 * 30 * len(rows)


@pytest.mark.parametrize("kind, scale, offset", [("float", 1, 0), ("double", 1, 0), ("double", 1, 1e5), ("double", 1e25, 0), ("double", 1e160, 0)])
def test_points_meet_one_slice_after_the_other(spark, monkeypatch, kind, scale, offset):
    """Slices of a few points, without structure, far from zero, and with squares that a float or a double cannot hold."""
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    monkeypatch.setattr(neighbours, "SLICE", 6 * 90)
    monkeypatch.setattr(neighbours, "WIDTH", 30)
    rows = 240
    vectors = (np.random.default_rng(3).normal(size=(rows, 6)) * scale + offset).astype(np.float32 if kind == "float" else np.float64)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], f"id long, v array<{kind}>")
    written, write = [], neighbours.materialize
    monkeypatch.setattr(neighbours, "materialize", lambda df, label: written.append((label, write(df, label))) or written[-1][1])
    got = {}
    for r in neighbours.nearest_rows(df, "id", "v", 4).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbour, r.distance))
    far = neighbours._far(vectors.astype(np.float64), vectors.astype(np.float64))
    far[np.diag_indices(rows)] = np.inf
    for a in range(rows):
        order = np.lexsort((np.arange(rows), far[a]))[:4]
        assert sorted(got.get(a, [])) == [(n + 1, int(b), far[a, b]) for n, b in enumerate(order) if far[a, b] < np.inf]
    # Whatever is visited, what goes from slice to slice is a row for each point, and no copy of it stays.
    states = [df for label, df in written if label == "state"]
    assert len(states) >= 4
    for label, df in written:
        there = df.inputFiles()[0].removeprefix("file://").removeprefix("file:")
        assert os.path.exists(there) == (label not in ("state", "rows", "points", "placed"))


def test_a_task_sends_a_row_for_each_visitor():
    vectors = np.random.default_rng(5).normal(size=(500, 8))
    pivots, table = vectors[:40], neighbours.pa.table({"node": range(500), "vector": vectors.tolist()})
    cell = neighbours._far(vectors, pivots).argmin(axis=1)
    far = np.sort(neighbours._far(vectors, pivots), axis=1)
    table = table.append_column("place", neighbours.pa.array(cell << 32)).append_column("far", neighbours.pa.array(far[:, 0]))
    radius = np.array([far[cell == c, 0].max() for c in range(40)])
    held = neighbours._Held(table, pivots, neighbours._far(pivots, pivots), radius)
    state = neighbours._begun(pivots, np.full((40, 4), np.inf), 3, 3)(table.sort_by("place").to_batches())
    out = neighbours.pa.Table.from_batches(neighbours._compared(SimpleNamespace(value=held), 8, 3)(state))
    assert out.num_rows == 500
    near = np.sort(neighbours._far(vectors, vectors), axis=1)[:, 1:4]
    assert (np.array(out.sort_by("node")["distances"].to_pylist()) == near).all()


def test_slices_hold_whole_places():
    sizes = [(4, 2), (1, 3), (2, 9), (3, 4), (9, 1)]
    assert neighbours._slices(sizes, 7) == [(1, 1), (2, 2), (3, 9)] and neighbours._slices([], 7) == []


def test_statistics_read_no_column(spark):
    path = fresh_path(spark, "footers")
    rows = [(1, None, "a", 2.5, [1], True), (None, 7, None, None, None, False), (3, 4, "c", -1.0, [], None)]
    df = spark.createDataFrame(rows, "a long, `b c` int, s string, d double, l array<int>, f boolean")
    df.coalesce(1).write.parquet(path)
    got = {r.column: (r.type, r.n_rows, r.n_nulls, r.minimum, r.maximum) for r in footers.table_statistics(spark, path).collect()}
    assert got["a"] == ("bigint", 3, 1, 1, 3) and got["b c"] == ("int", 3, 1, 4, 7) and got["s"] == ("string", 3, 1, None, None)
    assert got["d"] == ("double", 3, 1, -1, 2.5) and got["l"] == ("array<int>", 3, None, None, None) and got["f"] == ("boolean", 3, 1, 0, 1)
    plan = footers.footer_aggregate(footers.footer_table(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)" in plan and "ReadSchema: struct<count(*):bigint" in plan
    only_nulls = spark.createDataFrame([(1, None, None, None, None, None)], df.schema)
    df.union(only_nulls).repartitionByRange(2, F.col("d").isNull(), "a").write.parquet(f"{path}-nulls")
    got = {r.column: (r.n_nulls, r.minimum, r.maximum) for r in footers.table_statistics(spark, f"{path}-nulls").collect()}
    assert got["d"] == (2, -1, 2.5) and got["a"] == (1, 1, 3) and got["b c"] == (2, 4, 7)
    df.limit(0).write.parquet(f"{path}-empty")
    assert {(r.n_rows, r.minimum) for r in footers.table_statistics(spark, f"{path}-empty").collect()} == {(0, None)}


def test_sketches_merge_within_their_bound(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("c"), (F.col("id") % 7).alias("day"), F.when(F.col("id") % 5 > 0, F.rand(3)).alias("v"))
    daily = trials.latency_sketches(rows, ["c", "day"], "v", size=200)
    found = trials.sketched_percentiles(trials.merged_sketches(daily, ["c"], size=200), ["c"]).collect()
    assert len(found) == 9 and {r.steps for r in found} == {16_000}
    for r in found:
        assert abs(r.seconds - r.percent / 100) < 0.04
    assert trials.sketched_percentiles(trials.latency_sketches(rows.where("v is null"), ["c"], "v"), ["c"]).collect() == []


def stops(spark, parts, **options):
    """Plateaus of a stream that gets one file after the other, stopped and started again for each."""
    path, found, checkpoint = (fresh_path(spark, label) for label in ("in", "out", "state"))
    schema = "trial string, i long, m double"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", plateau.STATE_STORE)
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        made = plateau.plateaus_of_stream(spark.readStream.schema(schema).parquet(path), "trial", "i", "m", **options)
        writer = made.writeStream.format("parquet").option("path", found).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
    return {r.trial: r.stop_iteration for r in spark.read.schema("trial string, stop_iteration long").parquet(found).collect()}


def test_plateaus_come_back_from_the_checkpoint(spark):
    maker = random.Random(6)
    rows = [(t, i, None if maker.random() < 0.1 else maker.choice([0.1, 0.1, 0.1, 0.5])) for t in "abcdef" for i in range(1, 31)]
    whole = spark.createDataFrame(rows, "trial string, i long, m double")
    parts = [[r for r in rows if low < r[1] <= high] for low, high in ((0, 3), (3, 14), (14, 99))]
    for part in parts:
        maker.shuffle(part)
    for least in (None, 2):
        expected = {r.trial: r.stop_iteration for r in trials.first_plateau(whole, "trial", "i", "m", min_results=least).collect()}
        assert stops(spark, parts, min_results=least) == expected
    # A result that comes late takes part in nothing.
    late = [("x", 1, 0.0), ("x", 2, 0.5), ("x", 3, 0.5)], [("x", 2, 9.0), ("x", 4, 0.5), ("x", 5, 0.5), ("x", 6, 9.0)]
    assert stops(spark, late) == {"x": 5}



def test_word_types_of_plain_tokens_are_those_of_the_whole_pattern(spark):
    tokens = ["Word", "word.", "U.S.", "e.g.", "end!)", '"Quote."', "3rd", "x1", "don't", "co-op.", "Été?", "İstanbul", "a..", "b.!", "...", "-", "", "Kelvin\u212a.", "nel\u0085", "(see", "word.\u2028"]
    df = spark.createDataFrame([(t,) for t in tokens], "token string")
    whole = F.lower(F.regexp_extract("token", boundaries._TYPE, 1))
    got = df.select("token", boundaries.word_type(F.col("token")).alias("got"), F.when(whole.rlike(boundaries._WORD), whole).alias("want")).collect()
    assert [r.got for r in got] == [r.want for r in got] and sum(r.got is not None for r in got) > 10
    plan = df.select(boundaries.word_type(F.col("token")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RLIKE") < plan.index("regexp_extract")


def test_few_pairs_of_a_block_are_measured():
    """All pairs are ruled out by one product but those near the k-th, ties and large numbers included."""
    rng = np.random.default_rng(5)
    for shift, scale in ((0, 1.0), (1e6, 1.0), (0, 1e-9), (0, 1e160)):
        held = (np.round(rng.normal(size=(700, 6)), 1) + shift) * scale
        node = rng.permutation(700)
        some, own = held[:300], node[:300]
        with np.errstate(over="ignore"):
            far = neighbours._far(some, held)
        far[own[:, None] == node[None]] = np.inf
        order = np.lexsort((np.broadcast_to(node, far.shape), far), axis=1)[:, :4]
        found = neighbours._candidates(some, own, held, node, 4)
        assert (found is None) == (scale == 1e160)
        if found is not None:
            assert set(zip(np.repeat(np.arange(300), 4), order.ravel())) <= set(zip(*found))
            assert shift or len(found[0]) < 300 * 40


def test_a_trial_costs_one_read_and_one_write_of_state_a_micro_batch():
    calls, held = [], {}

    class State:
        def get(self):
            calls.append("get")
            return held.get("value")

        def update(self, value):
            calls.append("update")
            held["value"] = value

    class Handle:
        def getValueState(self, name, schema):
            return State()

    processor = plateau._Plateau("trial", "i", "m", 0.01, 3, 2, 1)
    processor.init(Handle())
    go = lambda rows: [tuple(r) for r in processor.handleInputRows(("a",), (Row(trial="a", i=i, m=m) for i, m in rows), None)]
    assert go([(3, None), (1, 0.1), (2, 9.0)]) == [] and held["value"] == (3, 0, 0, [2, 3], [9.0, None])
    assert go([(5, float("nan")), (4, 0.5), (2, 0.5), (None, 0.5), (6, 0.5)]) == [("a", 6)]
    assert held["value"] == (6, 2, 1, [5, 6], [None, 0.5])
    # A trial that has stopped goes on being recorded, and is told once.
    assert go([(7, 0.5), (8, 0.5)]) == [] and held["value"] == (8, 2, 1, [7, 8], [0.5, 0.5])
    assert calls == ["get", "update"] * 3


def test_the_log_that_arrives_is_not_written_by_one_task(spark, data, monkeypatch):
    from gistmeter.plans import learned

    paths, fresh = {}, learned.fresh_path
    monkeypatch.setattr(learned, "fresh_path", lambda spark, label: paths.setdefault(label, fresh(spark, label)))
    learned.trial_plateau_stream(spark, data).collect()
    batches = spark.read.text(paths["progress"] + "/commits/*").select(F.input_file_name()).distinct().count()
    assert len(spark.read.parquet(paths["arriving"]).inputFiles()) > 3 == batches
