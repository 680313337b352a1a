"""Registered queries: one function per operator, (spark, folder) to DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmeter.functions import batches as B
from gistmeter.functions.text import (
    last_sentence,
    rouge_tokens,
    sentence_lines,
    sentences,
    without_repeats,
)
from gistmeter.functions.vectors import l2_normalize
from gistmeter.operators import batching, bias, corpus, embedding, overlap, reshape, selection, splits, trials
from gistmeter.operators.ranking import rank_within
from gistmeter.operators.summarize import batch_summarize as summarize
from gistmeter.operators.vocabulary import build_vocabulary, decode, encode
from gistmeter.plans import fixtures as fx
from gistmeter.plans.scoring import melt_with_gold, score_overlap, score_vectors, score_wide, score_wide_vectors
from gistmeter.session import fresh_path, materialize
from gistmeter.sources import files, sinks, tables, trial_logs
from gistmeter.sources.tables import scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def registered(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


# Scans, projections, selection


@registered
def scan_project(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars").drop("source")


@registered
def conditional_source(spark: SparkSession, folder: str) -> DataFrame:
    """The full set before the marker table exists, the temporary set once it does."""
    tag = uuid.uuid4().hex
    marker, full, temporary = f"marker_{tag}", f"full_{tag}", f"temporary_{tag}"
    texts = scan(spark, folder, "documents").select("doc_id", "n_chars")
    labels = scan(spark, folder, "labels").select("doc_id")
    texts.createOrReplaceTempView(full)
    texts.join(labels, "doc_id", "left_semi").createOrReplaceTempView(temporary)
    first = tables.conditional_table(spark, marker, full, temporary)
    labels.createOrReplaceTempView(marker)
    later = tables.conditional_table(spark, marker, full, temporary)
    both = first.withColumn("run", F.lit("first")).unionByName(later.withColumn("run", F.lit("later")))
    for view in (marker, full, temporary):
        spark.catalog.dropTempView(view)
    return both.groupBy("run").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").alias("n_chars"))


@registered
def text_lengths(spark: SparkSession, folder: str) -> DataFrame:
    texts = fx.documents(spark, folder).select(
        "doc_id",
        F.length("text").cast("long").alias("chars"),
        F.size(rouge_tokens("text")).cast("long").alias("tokens"),
    )
    return texts.orderBy("tokens", "chars", "doc_id")


@registered
def topk_rows(spark: SparkSession, folder: str) -> DataFrame:
    texts = scan(spark, folder, "documents").select("doc_id", "n_chars")
    return selection.top_rows(texts, 50, F.col("n_chars").desc(), F.col("doc_id"))


@registered
def topk_semi_filter(spark: SparkSession, folder: str) -> DataFrame:
    return selection.top_k_by_score(fx.gold_set(spark, folder), "doc_id", "score", 400)


@registered
def select_per_split(spark: SparkSession, folder: str) -> DataFrame:
    """The training job's selection: split, then the best 400 ids of one side and 50 of the other."""
    sides = splits.split_two(fx.gold_set(spark, folder), "doc_id")
    return selection.top_k_per_split(sides, "split", "doc_id", "score", {"train": 400, "eval": 50})


@registered
def schema_signature(spark: SparkSession, folder: str) -> DataFrame:
    return tables.schema_signature(scan(spark, folder, "documents"))


# Text preparation


@registered
def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    pieces = fx.documents(spark, folder).select("doc_id", F.posexplode(sentences("text")).alias("pos", "sentence"))
    return pieces.withColumn("pos", F.col("pos").cast("long"))


@registered
def sentence_per_line(spark: SparkSession, folder: str) -> DataFrame:
    return fx.documents(spark, folder).select("doc_id", sentence_lines("text").alias("lines"))


@registered
def dedup_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return fx.documents(spark, folder).select("doc_id", without_repeats("text").alias("filtered_text"))


@registered
def prepare_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The test set's preparation; its limit of 900,000 characters is the workload's own."""
    prepared = without_repeats("text", max_chars=900_000)
    return fx.documents(spark, folder).select("doc_id", prepared.alias("text"))


# Reshaping


@registered
def melt_models(spark: SparkSession, folder: str) -> DataFrame:
    wide = fx.wide_summaries(spark, folder)
    return reshape.melt(wide, ["company", "gold_summary"]).drop("gold_summary")


@registered
def melt_with_index(spark: SparkSession, folder: str) -> DataFrame:
    wide = fx.wide_summaries(spark, folder).drop("gold_summary")
    long = reshape.melt_with_index(wide, ["company"], [F.col("company")])
    return long.select("index", "company", "model", F.length("obtained_summary").cast("long").alias("chars"))


# Splits


@registered
def split_90_10(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_two(scan(spark, folder, "documents").select("doc_id"), "doc_id")


@registered
def split_80_10_10(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_three(scan(spark, folder, "documents").select("doc_id"), "doc_id")


@registered
def split_shares(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_shares(split_80_10_10(spark, folder))


# Batches, tokens, vocabulary


def _document_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "documents").select("doc_id", F.length("text").cast("long").alias("chars"))


@registered
def length_batches(spark: SparkSession, folder: str) -> DataFrame:
    return batching.length_batches(_document_lengths(spark, folder), "doc_id", "chars")


@registered
def padding_waste(spark: SparkSession, folder: str) -> DataFrame:
    placed = batching.length_batches(_document_lengths(spark, folder), "doc_id", "chars")
    return batching.padding_waste(placed, "chars").withColumn("waste", F.round("waste", 6))


def _encoded_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    texts = fx.documents(spark, folder).select("doc_id", "text")
    vocabulary = build_vocabulary(texts, rouge_tokens("text"))
    return encode(texts, "doc_id", rouge_tokens("text"), vocabulary), vocabulary


@registered
def vocab_build(spark: SparkSession, folder: str) -> DataFrame:
    texts = fx.documents(spark, folder)
    return build_vocabulary(texts, rouge_tokens("text")).withColumn("token_id", F.col("token_id").cast("long"))


@registered
def vocab_encode(spark: SparkSession, folder: str) -> DataFrame:
    encoded, _ = _encoded_documents(spark, folder)
    return encoded.select("doc_id", F.array_join("input_ids", " ").alias("input_ids"))


@registered
def vocab_encode_unseen(spark: SparkSession, folder: str) -> DataFrame:
    """All texts with the vocabulary of the training side: words it lacks become the unknown id."""
    texts = scan(spark, folder, "documents").select("doc_id", "text")
    train = splits.split_two(texts, "doc_id").where("split = 'train'")
    vocabulary = build_vocabulary(train, rouge_tokens("text"))
    encoded = encode(texts, "doc_id", rouge_tokens("text"), vocabulary)
    return encoded.select("doc_id", F.array_join("input_ids", " ").alias("input_ids"))


@registered
def vocab_decode(spark: SparkSession, folder: str) -> DataFrame:
    encoded, vocabulary = _encoded_documents(spark, folder)
    return decode(encoded, "doc_id", "input_ids", vocabulary)


@registered
def token_truncate(spark: SparkSession, folder: str) -> DataFrame:
    """The 4,096-id input limit: how much of each text it keeps, and the last id kept."""
    encoded, _ = _encoded_documents(spark, folder)
    kept = B.truncate(F.col("input_ids"), 4096)
    return encoded.select(
        "doc_id",
        F.size("input_ids").cast("long").alias("n_ids"),
        F.size(kept).cast("long").alias("n_kept"),
        F.element_at(kept, -1).cast("long").alias("last_id"),
    )


def _padded_documents(spark: SparkSession, folder: str) -> DataFrame:
    encoded, _ = _encoded_documents(spark, folder)
    # Read for the ranking and again for the padding; encoding twice would cost more than one write.
    sized = materialize(encoded.withColumn("size", F.size("input_ids")), "encoded")
    placed = batching.with_padded_length(sized, "doc_id", "size")
    return placed.withColumn("padded_ids", B.pad(F.col("input_ids"), F.col("padded_length")))


@registered
def pad_and_mask(spark: SparkSession, folder: str) -> DataFrame:
    padded = _padded_documents(spark, folder)
    return padded.select(
        "doc_id",
        "batch_id",
        F.array_join("padded_ids", " ").alias("input_ids"),
        F.array_join(B.attention_mask(F.col("input_ids"), F.col("padded_length")), "").alias("attention_mask"),
        F.array_join(B.global_attention_mask(F.col("padded_ids")), "").alias("global_attention_mask"),
    )


@registered
def label_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Padding becomes the ignored label, and comes back from it."""
    masked = B.mask_labels(F.col("padded_ids"))
    padded = _padded_documents(spark, folder).withColumn("labels", masked)
    return padded.select(
        "doc_id",
        F.array_join("labels", " ").alias("labels"),
        (B.unmask_labels(F.col("labels")) == F.col("padded_ids")).alias("restored"),
    )


@registered
def gen_len(spark: SparkSession, folder: str) -> DataFrame:
    padded = _padded_documents(spark, folder)
    return corpus.rounded(corpus.generated_length(padded, "padded_ids"))


# Overlap metrics on pairs


def _rouge_query(spark: SparkSession, folder: str, kind: str, **options) -> DataFrame:
    pairs = fx.conversation_pairs(spark, folder)
    return overlap.rouge(pairs, "prediction", "gold", types=(kind,), **options).select(
        "conv_id", "turn", f"{kind}.*"
    )


@registered
def rouge1(spark: SparkSession, folder: str) -> DataFrame:
    return _rouge_query(spark, folder, "rouge1")


@registered
def rouge2(spark: SparkSession, folder: str) -> DataFrame:
    return _rouge_query(spark, folder, "rouge2")


@registered
def rouge_l(spark: SparkSession, folder: str) -> DataFrame:
    return _rouge_query(spark, folder, "rougel")


@registered
def rouge_lsum(spark: SparkSession, folder: str) -> DataFrame:
    return _rouge_query(spark, folder, "rougelsum", split_sentences=True)


@registered
def rouge1_stemmed(spark: SparkSession, folder: str) -> DataFrame:
    return _rouge_query(spark, folder, "rouge1", stem=True)


@registered
def rouge_corpus(spark: SparkSession, folder: str) -> DataFrame:
    pairs = fx.conversation_pairs(spark, folder).withColumn("ids", rouge_tokens("prediction"))
    sized = pairs.withColumn("ids", F.transform("ids", lambda _: F.lit(B.UNK_ID)))
    return corpus.rounded(corpus.evaluate(sized, "prediction", "gold", ids="ids"))


@registered
def evaluate_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted ids and padded labels of all pairs to corpus scores; words no gold text has are unknown."""
    pairs = fx.conversation_pairs(spark, folder)
    pairs = materialize(pairs.select(F.concat_ws("-", "conv_id", "turn").alias("pair"), "prediction", "gold"), "pairs")
    vocabulary = materialize(build_vocabulary(pairs, rouge_tokens("gold")), "vocabulary")
    made = encode(pairs, "pair", rouge_tokens("prediction"), vocabulary).withColumnRenamed("input_ids", "pred_ids")
    labels = encode(pairs, "pair", rouge_tokens("gold"), vocabulary).withColumnRenamed("input_ids", "label_ids")
    padded = B.pad(F.col("label_ids"), F.ceil(F.size("label_ids") / 8) * 8)
    labels = labels.withColumn("label_ids", B.mask_labels(padded))
    coded = materialize(made.join(labels, "pair"), "coded")
    return corpus.rounded(corpus.evaluate_ids(coded, "pair", "pred_ids", "label_ids", vocabulary))


def _bleu_output(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.select(
        *keys,
        F.round("bleu", 6).alias("bleu"),
        *[F.round(F.get("precisions", F.lit(i)), 6).alias(f"precision{i + 1}") for i in range(overlap.MAX_ORDER)],
        F.round("brevity_penalty", 6).alias("brevity_penalty"),
        F.round("length_ratio", 6).alias("length_ratio"),
        F.col("translation_length").cast("long").alias("translation_length"),
        F.col("reference_length").cast("long").alias("reference_length"),
    )


@registered
def bleu_row(spark: SparkSession, folder: str) -> DataFrame:
    scored = overlap.bleu(fx.conversation_pairs(spark, folder), "prediction", "gold")
    return _bleu_output(scored, ["conv_id", "turn"])


@registered
def bleu_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return _bleu_output(overlap.bleu_corpus(fx.conversation_pairs(spark, folder), "prediction", "gold"), [])


@registered
def bleu_by_model(spark: SparkSession, folder: str) -> DataFrame:
    wide = fx.wide_summaries(spark, folder)
    long = melt_with_gold(wide, ["company"], "gold_summary", types=())
    return _bleu_output(overlap.bleu_corpus(long, "obtained_summary", "gold_summary", ["model"]), ["model"])


@registered
def summaries_rouge(spark: SparkSession, folder: str) -> DataFrame:
    """ROUGE-1 and ROUGE-2 of every model's summary of every whole document."""
    kinds = ("rouge1", "rouge2")
    wide = fx.wide_summaries(spark, folder)
    long = melt_with_gold(wide, ["company"], "gold_summary", types=kinds, with_bleu=False)
    scored = overlap.rouge_f(long, "obtained_summary", "gold_summary", types=kinds)
    return scored.select("company", "model", "rouge1", "rouge2")


@registered
def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    pairs = fx.conversation_pairs(spark, folder)
    scored = overlap.rouge_f(pairs, "prediction", "gold", types=("rouge1", "rouge2"))
    keyed = scored.withColumn("pair", F.concat_ws("-", "conv_id", "turn"))
    return corpus.rounded(corpus.bootstrap_interval(keyed, "pair", ["rouge1", "rouge2"]), 6)


@registered
def bias_score(spark: SparkSession, folder: str) -> DataFrame:
    rated = fx.bias_labels(spark, folder)
    return rated.select("doc_id", "label", F.round(bias.bias_score(F.col("label"), F.col("score")), 6).alias("bias"))


@registered
def penalized_score(spark: SparkSession, folder: str) -> DataFrame:
    """Penalised ROUGE-1 of the longest sentence of each labelled document, averaged per label."""
    wide = fx.wide_summaries(spark, folder).select("company", "gold_summary", "longest")
    rated = fx.bias_labels(spark, folder).withColumnRenamed("doc_id", "company")
    scored = overlap.rouge_f(wide.join(rated, "company"), "longest", "gold_summary", types=("rouge1",))
    value = bias.penalized_score(F.col("rouge1"), bias.bias_score(F.col("label"), F.col("score")))
    means = scored.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(value).alias("penalized"))
    return corpus.rounded(means)


# Vectors


@registered
def mean_pool(spark: SparkSession, folder: str) -> DataFrame:
    """Mean vector per label; the mask stands in for padding and is the sign of the first value."""
    rows = fx.vectors(spark, folder)
    mask = (F.get("vector", F.lit(0)) >= 0).cast("int")
    pooled = embedding.mean_pool(rows, ["label"], "vector", fx.VECTOR_DIM, mask)
    return _unpacked(pooled, "label")


def _unpacked(df: DataFrame, key: str) -> DataFrame:
    long = df.select(key, F.posexplode("vector").alias("pos", "value"))
    return long.select(key, F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@registered
def l2_normalized(spark: SparkSession, folder: str) -> DataFrame:
    rows = fx.vectors(spark, folder).withColumn("vector", l2_normalize(F.col("vector")))
    return _unpacked(rows, "vec_id")


@registered
def paired_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of vectors 2k and 2k + 1."""
    rows = fx.vectors(spark, folder).withColumn("pair", F.floor(F.col("vec_id") / 2))
    left = rows.where(F.col("vec_id") == F.col("pair") * 2).select("pair", F.col("vector").alias("left"))
    right = rows.where(F.col("vec_id") != F.col("pair") * 2).select("pair", F.col("vector").alias("right"))
    scored = embedding.paired_cosine(left.join(right, "pair"), "left", "right")
    return scored.select("pair", F.round("cosine", 6).alias("cosine"))


def _vector_scores(spark: SparkSession, folder: str) -> DataFrame:
    vectors = fx.vectors(spark, folder)
    return score_vectors(
        fx.conversation_pairs(spark, folder),
        ["conv_id", "turn"],
        "prediction",
        "gold",
        vectors,
        fx.token_vector_id(vectors),
        fx.VECTOR_DIM,
    )


@registered
def text_cosine(spark: SparkSession, folder: str) -> DataFrame:
    scored = _vector_scores(spark, folder)
    return scored.select("conv_id", "turn", F.round("cosine", 6).alias("cosine"))


@registered
def greedy_match_score(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.rounded(_vector_scores(spark, folder).drop("cosine"), 6)


# Prediction and joins


@registered
def batch_summarize(spark: SparkSession, folder: str) -> DataFrame:
    made = summarize(fx.documents(spark, folder), "doc_id", "text")
    return made.withColumn("score", F.round("score", 6))


@registered
def join_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions come in length order and are put beside their texts by id."""
    made = summarize(fx.documents(spark, folder), "doc_id", "text").select("doc_id", "prediction")
    texts = scan(spark, folder, "documents").select(
        "doc_id", "lang", "source", F.length("text").cast("long").alias("length")
    )
    return texts.join(made, "doc_id")


@registered
def latency_summary(spark: SparkSession, folder: str) -> DataFrame:
    timed = scan(spark, folder, "events").select(F.col("event_type").alias("configuration"), F.col("value").alias("seconds"))
    return corpus.rounded(trials.latency_summary(timed, "configuration", "seconds"))


@registered
def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    timed = scan(spark, folder, "events").select(F.col("event_type").alias("configuration"), F.col("value").alias("seconds"))
    return trials.latency_percentiles(timed, "configuration", "seconds")


# Trial logs


@registered
def rank_in_trial(spark: SparkSession, folder: str) -> DataFrame:
    events = scan(spark, folder, "events").select("user_id", "ts", "event_id")
    return rank_within(events, "user_id", "ts", "event_id").drop("ts")


@registered
def trial_best_epoch(spark: SparkSession, folder: str) -> DataFrame:
    return trials.best_record(
        fx.trial_log(spark, folder), "trial", "training_iteration", "eval_rouge1", ["epoch", "eval_loss"]
    )


@registered
def trial_leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    return trials.best_trial(trial_best_epoch(spark, folder), "trial", "eval_rouge1")


@registered
def trial_plateau(spark: SparkSession, folder: str) -> DataFrame:
    return trials.first_plateau(
        fx.trial_log(spark, folder), "trial", "training_iteration", "eval_rouge1", spread=10.0
    )


@registered
def trial_metric_history(spark: SparkSession, folder: str) -> DataFrame:
    log = fx.trial_log(spark, folder)
    history = reshape.metric_history(log, "trial", "epoch", ["eval_rouge1", "eval_loss"])
    return history.withColumn("step", F.col("step").cast("long"))


RESULT_SCHEMA = (
    "event_id long, eval_rouge1 double, epoch double, training_iteration long, timesteps_total long, "
    "episodes_total long, node_ip string, hostname string, trial_id string, experiment_id string, "
    "date string, should_checkpoint boolean, done boolean, config struct<k: long>"
)


def _write_results(spark: SparkSession, folder: str) -> str:
    """Events as JSON lines of trial results, a folder per event type."""
    path = fresh_path(spark, "results")
    lines = scan(spark, folder, "events").select(
        F.col("event_type").alias("run"),
        "event_id",
        F.col("value").alias("eval_rouge1"),
        (F.col("event_id") * 0.5).alias("epoch"),
        (F.col("event_id") + 1).alias("training_iteration"),
        F.lit(0).alias("timesteps_total"),
        F.lit(0).alias("episodes_total"),
        F.lit("10.0.0.1").alias("node_ip"),
        F.lit("node").alias("hostname"),
        F.col("user_id").cast("string").alias("trial_id"),
        F.lit("x").alias("experiment_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.lit(False).alias("should_checkpoint"),
        F.lit(False).alias("done"),
        F.from_json("props", "k long").alias("config"),
    )
    lines.write.partitionBy("run").json(path)
    return path


def _run_name(df: DataFrame) -> DataFrame:
    return df.withColumn("trial", F.regexp_replace("trial", "^run=", ""))


@registered
def trial_log_flatten(spark: SparkSession, folder: str) -> DataFrame:
    path = _write_results(spark, folder)
    read = _run_name(trial_logs.read_results(spark, f"{path}/run=*/*.json", RESULT_SCHEMA))
    drop = [key for key in trial_logs.BOOKKEEPING if key != "config"]
    return reshape.flatten_struct(read, "config", drop)


@registered
def trial_params_join(spark: SparkSession, folder: str) -> DataFrame:
    """Best result of each run beside the parameters read from its own file."""
    path = fresh_path(spark, "params")
    events = scan(spark, folder, "events")
    params = events.groupBy(F.col("event_type").alias("run")).agg(
        F.min("value").alias("learning_rate"),
        F.max(F.get_json_object("props", "$.k").cast("long")).alias("num_train_epochs"),
    )
    params.write.partitionBy("run").json(path)
    read = trial_logs.read_params(spark, f"{path}/run=*/*.json", "learning_rate double, num_train_epochs long")
    results = trial_logs.read_results(spark, f"{_write_results(spark, folder)}/run=*/*.json", RESULT_SCHEMA)
    totals = results.groupBy("trial").agg(
        F.count(F.lit(1)).alias("n_results"), F.max("eval_rouge1").alias("best")
    )
    return _run_name(totals.join(read, "trial"))


@registered
def latest_per_group(spark: SparkSession, folder: str) -> DataFrame:
    events = scan(spark, folder, "events").select("user_id", "ts", "event_id", "event_type", "value")
    last = events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("last"))
    return last.select("user_id", "last.event_id", "last.event_type", "last.value")


@registered
def latest_file(spark: SparkSession, folder: str) -> DataFrame:
    """Rows in the newest of two checkpoints per run, found by file times."""
    path = fresh_path(spark, "checkpoints")
    events = scan(spark, folder, "events").select("event_type", "event_id", "value")
    for number, rows in enumerate((events, events.where(F.col("value") > 10))):
        rows.withColumnRenamed("event_type", "run").write.partitionBy("run").json(f"{path}/checkpoint_{number}")
    listed = files.visible(files.list_files(spark, path, "*.json")).select(
        trial_logs.folder_name(F.col("path")).alias("trial"),
        trial_logs.folder_name(F.col("path"), 2).alias("checkpoint"),
        "modified",
    )
    newest = files.newest(listed, ["trial"], "checkpoint").withColumnRenamed("entry", "checkpoint")
    # One folder a run is read, and nothing of the older checkpoints.
    chosen = [f"{path}/{r['checkpoint']}/{r['trial']}/*.json" for r in newest.select("trial", "checkpoint").collect()]
    rows = spark.read.schema("event_id long, value double").json(chosen)
    where = rows.select(
        trial_logs.folder_name(F.col("_metadata.file_path")).alias("trial"),
        trial_logs.folder_name(F.col("_metadata.file_path"), 2).alias("checkpoint"),
        "event_id",
    )
    counts = where.groupBy("trial", "checkpoint").agg(F.count(F.lit(1)).alias("n_rows"))
    return _run_name(counts.join(newest.drop("modified"), ["trial", "checkpoint"]))


# Sinks


@registered
def overwrite_readback(spark: SparkSession, folder: str) -> DataFrame:
    texts = fx.documents(spark, folder)
    name, path = f"results_{uuid.uuid4().hex}", fresh_path(spark, "table")
    sinks.overwrite_table(texts.select("doc_id", F.lit(0).cast("long").alias("chars")), name, path)
    final = texts.select("doc_id", F.length(without_repeats("text")).cast("long").alias("chars"))
    sinks.overwrite_table(final, name, path)
    return _dropped(spark.sql(f"SELECT * FROM {name}"), name)


def _dropped(df: DataFrame, name: str) -> DataFrame:
    """The rows of a table whose name leaves the catalog; its files lie in the shared folder."""
    df.sparkSession.sql(f"DROP TABLE {name}")
    return df


@registered
def create_keyed_table(spark: SparkSession, folder: str) -> DataFrame:
    pairs = overlap.rouge_f(fx.conversation_pairs(spark, folder), "prediction", "gold", types=("rouge1",))
    name, path = f"scored_{uuid.uuid4().hex}", fresh_path(spark, "table")
    rows = pairs.select("conv_id", "turn", "rouge1")
    return _dropped(sinks.create_keyed_table(rows, name, ["conv_id", "turn"], "Pairs with their scores.", path), name)


@registered
def key_violations(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.key_violations(scan(spark, folder, "conversations"), ["conv_id"])


@registered
def upsert_by_key(spark: SparkSession, folder: str) -> DataFrame:
    current = scan(spark, folder, "documents").select("doc_id", F.lit("unlabelled").alias("state"))
    changes = scan(spark, folder, "labels").select(
        "doc_id", F.concat_ws("/", F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("state")
    )
    name = f"states_{uuid.uuid4().hex}"
    sinks.overwrite_table(current, name, fresh_path(spark, "table"))
    return _dropped(sinks.merge_table(changes, name, ["doc_id"]), name)


# The scored tables


@registered
def scored_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All metrics beside each pair."""
    pairs = fx.conversation_pairs(spark, folder)
    scored = score_overlap(pairs, "prediction", "gold").drop("prediction", "gold", "precisions")
    return corpus.rounded(scored.join(_vector_scores(spark, folder), ["conv_id", "turn"], "left"), 6).select(
        "conv_id",
        "turn",
        *overlap.ROUGE_TYPES,
        "bleu",
        "brevity_penalty",
        "length_ratio",
        F.col("translation_length").cast("long").alias("translation_length"),
        F.col("reference_length").cast("long").alias("reference_length"),
        "cosine",
        "match_precision",
        "match_recall",
        "match_f1",
    )


@registered
def scored_wide_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship's chain on all conversation pairs: two models' texts wide, melted, every overlap metric."""
    pairs = fx.conversation_pairs(spark, folder)
    wide = pairs.select("conv_id", "turn", "gold", F.col("prediction").alias("whole"), last_sentence("prediction").alias("closing"))
    return _bleu_output(score_wide(wide, ["conv_id", "turn"], "gold"), ["conv_id", "turn", "model", *overlap.ROUGE_TYPES])


@registered
def summaries_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship's n-gram scores, ROUGE-1, ROUGE-2 and BLEU, on whole documents."""
    kinds = ("rouge1", "rouge2")
    long = melt_with_gold(fx.wide_summaries(spark, folder), ["company"], "gold_summary", types=kinds)
    scored = overlap.rouge_f(long, "obtained_summary", "gold_summary", types=kinds)
    return _bleu_output(overlap.bleu(scored, "obtained_summary", "gold_summary"), ["company", "model", *kinds])


def _scored_summaries(spark: SparkSession, folder: str, types: tuple[str, ...]) -> DataFrame:
    wide = fx.wide_summaries(spark, folder)
    vectors = fx.vectors(spark, folder)
    scored = score_wide(wide, ["company"], "gold_summary", types=types)
    vector_scores = score_wide_vectors(wide, ["company"], "gold_summary", vectors, fx.token_vector_id(vectors), fx.VECTOR_DIM)
    index = reshape.melt_with_index(wide.drop("gold_summary"), ["company"], ["company"]).select("index", "company", "model")
    both = _bleu_output(scored, ["company", "model", *types]).join(vector_scores, ["company", "model"])
    return both.join(index, ["company", "model"]).select("index", *both.columns)


@registered
def summaries_scored(spark: SparkSession, folder: str) -> DataFrame:
    """Every column of the flagship that SQL can check on whole documents: all but ROUGE-Lsum."""
    return corpus.rounded(_scored_summaries(spark, folder, ("rouge1", "rouge2", "rougel")), 6)


@registered
def scored_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: wide model outputs to long, with every overlap and vector metric on whole texts and the index."""
    return _scored_summaries(spark, folder, overlap.ROUGE_TYPES)
