import json
import os
import time

import pytest
from pyspark.sql import functions as F

from gistmeter.operators.reshape import flatten_struct
from gistmeter.session import fresh_path, shared_dir
from gistmeter.sources import files, sinks, tables, trial_logs


@pytest.fixture
def table(spark, tmp_path):
    names = []

    def name(label):
        names.append(f"{label}_{time.time_ns()}")
        return names[-1], str(tmp_path / names[-1])

    yield name
    for each in names:
        spark.sql(f"DROP TABLE IF EXISTS {each}")


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_dir(spark) == named
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_create_once_and_key_checks(spark, table):
    name, path = table("keyed")
    good = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    sinks.create_keyed_table(good, name, ["id"], "It's a table.", path)
    assert spark.table(name).count() == 2
    comment = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}["Comment"]
    assert comment == "It's a table. Primary key: id."
    with pytest.raises(ValueError, match="exists"):
        sinks.create_keyed_table(good, name, ["id"])
    for bad in ([(1, "a"), (1, "b")], [(None, "a")]):
        other, where = table("bad")
        with pytest.raises(ValueError, match="null or repeated"):
            sinks.create_keyed_table(spark.createDataFrame(bad, "id int, v string"), other, ["id"], path=where)
        assert not spark.catalog.tableExists(other)


def test_overwrite_and_merge(spark, table):
    name, path = table("merged")
    sinks.overwrite_table(spark.createDataFrame([(9, "x")], "id int, v string"), name, path)
    sinks.overwrite_table(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), name, path)
    sinks.merge_table(spark.createDataFrame([(2, "B"), (3, "c")], "id int, v string"), name, ["id"])
    assert sorted(map(tuple, spark.table(name).collect())) == [(1, "a"), (2, "B"), (3, "c")]


def test_conditional_table(spark):
    spark.range(3).createOrReplaceTempView("full_set")
    spark.range(1).createOrReplaceTempView("temporary_set")
    assert tables.conditional_table(spark, "no_such_marker", "full_set", "temporary_set").count() == 3
    spark.range(1).createOrReplaceTempView("marker")
    assert tables.conditional_table(spark, "marker", "full_set", "temporary_set").count() == 1
    assert {"full_set", "temporary_set"} <= set(tables.table_names(spark))
    spark.catalog.dropTempView("marker")


def test_trial_folders_with_a_leading_underscore(spark, tmp_path):
    for trial in ("a", "b"):
        folder = tmp_path / f"_objective_{trial}"
        folder.mkdir()
        lines = [
            {"epoch": e, "eval_rouge1": 0.1 * e, "node_ip": "x", "done": False, "config": {"learning_rate": 0.5}}
            for e in (1, 2)
        ]
        (folder / "result.json").write_text("\n".join(map(json.dumps, lines)))
        (folder / "params.json").write_text(json.dumps({"learning_rate": 0.5, "num_train_epochs": 2}, indent=1))
    schema = "epoch double, eval_rouge1 double, node_ip string, done boolean, config struct<learning_rate: double>"
    lines = trial_logs.read_results(spark, f"{tmp_path}/_objective*/result.json", schema)
    flat = flatten_struct(lines, "config", ["node_ip", "done"])
    assert flat.columns == ["trial", "epoch", "eval_rouge1", "config_learning_rate"]
    assert sorted((r["trial"], r["epoch"]) for r in flat.collect()) == [
        (f"_objective_{t}", e) for t in "ab" for e in (1.0, 2.0)
    ]
    params = trial_logs.read_params(spark, f"{tmp_path}/_objective*/params.json", "learning_rate double, num_train_epochs int")
    assert {(r["trial"], r["num_train_epochs"]) for r in params.collect()} == {("_objective_a", 2), ("_objective_b", 2)}


def test_newest_visible_file(spark, tmp_path):
    for number, name in enumerate(["one.bin", "two.bin", ".hidden.bin"]):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (1_700_000_000 + number, 1_700_000_000 + number))
    found = files.visible(files.list_files(spark, str(tmp_path))).withColumn("name", files.base_name(F.col("path")))
    assert {r["name"] for r in found.collect()} == {"one.bin", "two.bin"}
    assert files.newest(found, [], "name").first()["entry"] == "two.bin"
    assert {r["s"] for r in found.select(files.stem(F.col("path")).alias("s")).collect()} == {"one", "two"}


def test_signature(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    assert {tuple(r) for r in tables.schema_signature(df).collect()} == {("id", "int", True), ("v", "string", False)}


def test_row_wise_scores_on_a_stream(spark, tmp_path):
    from gistmeter.operators.overlap import rouge_f

    spark.createDataFrame([("the cat", "the cat ran")], "p string, g string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("p string, g string").parquet(str(tmp_path / "in"))
    name = f"scored_{time.time_ns()}"
    query = rouge_f(stream, "p", "g").writeStream.format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table(name).first()["rouge1"] == pytest.approx(0.8)
