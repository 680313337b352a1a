"""Queries for what is learnt from, or looked up in, the whole corpus; each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmeter.operators import boundaries, centrality, corpus, drifting, neighbours, subwords, trials
from gistmeter.plans import fixtures as fx
from gistmeter.plans.catalog import registered
from gistmeter.plans.oracle import ORACLE
from gistmeter.session import fresh_path, materialize
from gistmeter.sources import footers, snapshots
from gistmeter.sources.tables import scan
from gistmeter.streaming import plateau

try:  # the vocabulary files of public tokenizers, where they are installed
    import public_tokenizers
except ModuleNotFoundError:
    public_tokenizers = None

# Subword ids

if public_tokenizers is not None:
    RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

    def _subwords(spark: SparkSession, folder: str, path: str) -> tuple[DataFrame, dict[bytes, int]]:
        ranks = subwords.read_ranks(spark, path)
        return subwords.encode_subwords(fx.documents(spark, folder).select("doc_id", "text"), "doc_id", "text", ranks), ranks

    @registered
    def subword_encode(spark: SparkSession, folder: str, path: str = RANKS) -> DataFrame:
        """Every document as ids of a public byte-level vocabulary."""
        encoded, _ = _subwords(spark, folder, path)
        return encoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.array_join("ids", " ").alias("ids"))

    @registered
    def subword_decode(spark: SparkSession, folder: str, path: str = RANKS) -> DataFrame:
        """The ids of every document as text again."""
        encoded, ranks = _subwords(spark, folder, path)
        return encoded.select("doc_id", subwords.decode_subwords("ids", ranks).alias("text"))

    # The expression engine has no look-ahead: a mark is put before the last blank of a run that a word follows.
    _BLANK = r"[ \t\n\r\f\x0B\x{85}\p{Z}]"
    ORACLE["subword_encode"] = rf"""
    WITH RECURSIVE ranks AS MATERIALIZED (
      SELECT hex(from_base64(a)) AS t, b AS r
      FROM read_csv('{RANKS}', delim=' ', header=false, quote='', escape='', columns={{'a': 'VARCHAR', 'b': 'INTEGER'}})),
    marked AS (
      SELECT doc_id, regexp_replace(coalesce(text, ''), '({_BLANK}+)({_BLANK})([^ \t\n\r\f\x0B\x{{85}}\p{{Z}}])', '\1' || chr(57344) || '\2\3', 'g') AS text
      FROM documents),
    cut AS (
      SELECT doc_id, regexp_extract_all(text, '''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^ \t\n\r\f\x0B\x{{85}}\p{{Z}}\p{{L}}\p{{N}}\x{{E000}}]+|{_BLANK}+') AS p
      FROM marked),
    pieces AS MATERIALIZED (SELECT doc_id, unnest(p) AS w, generate_subscripts(p, 1) AS pos FROM cut),
    distinct_pieces AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM pieces),
    steps AS (
      SELECT w, list_transform(range(0, (length(h) // 2)::BIGINT), lambda i: substr(h, (2 * i + 1)::BIGINT, 2)) AS parts FROM distinct_pieces
      UNION ALL
      SELECT w, list_concat(list_concat(parts[:pos - 1], [parts[pos] || parts[pos + 1]]), parts[pos + 2:]) AS parts
      FROM (
        SELECT s.w, s.parts, s.pos
        FROM (SELECT w, parts, unnest(range(1, len(parts)::BIGINT)) AS pos FROM steps) s
        JOIN ranks ON ranks.t = s.parts[s.pos] || s.parts[s.pos + 1]
        QUALIFY row_number() OVER (PARTITION BY s.w ORDER BY ranks.r, s.pos) = 1)),
    last AS (SELECT w, arg_min(parts, len(parts)) AS parts FROM steps GROUP BY w),
    tokens AS (SELECT w, unnest(parts) AS t, generate_subscripts(parts, 1) AS k FROM last),
    coded AS (SELECT w, list(r ORDER BY k) AS ids FROM tokens JOIN ranks USING (t) GROUP BY w),
    found AS (SELECT doc_id, flatten(list(ids ORDER BY pos)) AS ids FROM pieces JOIN coded USING (w) GROUP BY doc_id)
    SELECT doc_id, coalesce(len(ids), 0)::BIGINT AS n_ids, coalesce(array_to_string(ids, ' '), '') AS ids
    FROM documents LEFT JOIN found USING (doc_id)"""
    ORACLE["subword_decode"] = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


# Logs whose keys drift


@registered
def trial_log_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Trial results whose ``config`` has other keys in every run, read as they are and flattened."""
    path = fresh_path(spark, "drift")
    k = F.get_json_object("props", "$.k").cast("long")
    # Runs of three kinds: one key, a number that is a fraction elsewhere, and keys inside keys.
    config = (
        F.when(F.col("event_type") == "click", F.to_json(F.struct(k.alias("k"))))
        .when(F.col("event_type") == "view", F.to_json(F.struct(k.alias("k"), F.col("value").alias("rate"), F.lit(True).alias("warm up"))))
        .otherwise(F.to_json(F.struct(F.lit(2).alias("rate"), F.struct(F.col("event_type").alias("kind"), F.struct(k.alias("n.steps")).alias("in")).alias("plan"))))
    )
    lines = scan(spark, folder, "events").select("event_id", F.to_json(F.struct("event_id", F.parse_json(config).alias("config"))).alias("value"))
    lines.select("value").write.text(path)
    read = spark.read.text(path).select(F.parse_json("value").alias("line"))
    results = read.select(F.variant_get("line", "$.event_id", "long").alias("event_id"), F.variant_get("line", "$.config", "variant").alias("config"))
    flat = drifting.flatten_drifting(materialize(results, "results"), "config")
    return flat.select(*[F.col(f"`{c}`").alias(c.replace("config.", "").replace(".", "_").replace(" ", "_")) for c in flat.columns])


ORACLE["trial_log_drift"] = """
SELECT event_id,
       CASE WHEN event_type IN ('click', 'view') THEN (props::JSON ->> '$.k')::BIGINT END AS k,
       CASE WHEN event_type = 'view' THEN value WHEN event_type <> 'click' THEN 2.0 END AS rate,
       CASE WHEN event_type = 'view' THEN true END AS warm_up,
       CASE WHEN event_type NOT IN ('click', 'view') THEN event_type END AS plan_kind,
       CASE WHEN event_type NOT IN ('click', 'view') THEN (props::JSON ->> '$.k')::BIGINT END AS plan_in_n_steps
FROM events"""


# A keyed table in versions


@registered
def merge_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """All three versions of a keyed table after two merges: labels over all documents, then toxic ones again."""
    path = fresh_path(spark, "snapshots")
    table = scan(spark, folder, "documents").select("doc_id", F.lit("unlabelled").alias("state"))
    labels = scan(spark, folder, "labels")
    state = F.concat_ws("/", F.col("quality").cast("string"), F.col("toxic").cast("string"))
    snapshots.create(table, path, ["doc_id"], buckets=16)
    snapshots.merge(labels.select("doc_id", state.alias("state")), path)
    snapshots.merge(labels.where("toxic = 1").select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.lit("moved").alias("state")), path)
    read = [snapshots.read(spark, path, v).select(F.lit(v).cast("long").alias("version"), "doc_id", "state") for v in snapshots.versions(spark, path)]
    return read[0].unionByName(read[1]).unionByName(read[2])


ORACLE["merge_snapshot"] = """
WITH first AS (SELECT doc_id, 'unlabelled' AS state FROM documents),
marks AS (SELECT doc_id, quality || '/' || toxic AS state FROM labels),
second AS (SELECT doc_id, coalesce(marks.state, first.state) AS state FROM first FULL JOIN marks USING (doc_id)),
third AS (SELECT * FROM second UNION ALL SELECT doc_id + 1000000, 'moved' FROM labels WHERE toxic = 1)
SELECT 0::BIGINT AS version, * FROM first UNION ALL SELECT 1, * FROM second UNION ALL SELECT 2, * FROM third"""


# Sentence boundaries


def _model(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    texts = fx.documents(spark, folder).select("doc_id", "text")
    return texts, materialize(boundaries.sentence_model(texts, "text"), "model")


@registered
def sentence_model(spark: SparkSession, folder: str) -> DataFrame:
    """Every word that ever has a full stop behind it, and whether it is an abbreviation."""
    _, model = _model(spark, folder)
    # A zero has no sign here.
    return corpus.rounded(model, 6).withColumn("score", F.col("score") + 0.0)


@registered
def sentence_starters(spark: SparkSession, folder: str) -> DataFrame:
    """Words that begin sentences far more often than chance."""
    texts, model = _model(spark, folder)
    return corpus.rounded(boundaries.sentence_starters(texts, "doc_id", "text", model), 6)


@registered
def sentence_split_learned(spark: SparkSession, folder: str) -> DataFrame:
    """All documents cut at the boundaries learnt from them."""
    texts, model = _model(spark, folder)
    starters = materialize(boundaries.sentence_starters(texts, "doc_id", "text", model), "starters")
    cut = boundaries.split_learned(texts, "doc_id", "text", model, starters)
    return cut.withColumn("pos", F.col("pos").cast("long"))


_TYPED = r"""
split AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f\x0B]+'), lambda t: t <> '') AS t FROM documents),
raw AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM split),
worded AS (SELECT *, lower(regexp_extract(token, '(?s)^[^\p{L}]*(.*?)[.!?]*["'')\]]*$', 1)) AS w FROM raw),
typed AS MATERIALIZED (
  SELECT doc_id, pos, token, CASE WHEN regexp_matches(w, '^\p{L}[\p{L}.''-]*$') THEN w END AS type,
         regexp_matches(token, '\.["'')\]]*$') AS stop, regexp_matches(token, '[!?]["'')\]]*$') AS mark FROM worded),
counts AS (SELECT type, count(*) FILTER (stop) AS n_period, count(*) FILTER (NOT stop) AS n_plain FROM typed GROUP BY type),
share AS (SELECT sum(n_period) / sum(n_period + n_plain) AS p FROM counts),
sized AS (
  SELECT *, length(replace(type, '.', '')) AS size, length(type) - length(replace(type, '.', '')) AS inside
  FROM counts, share WHERE type IS NOT NULL AND n_period > 0),
scored AS MATERIALIZED (
  SELECT type, n_period, n_plain,
         -2 * (n_period * ln(p) + n_plain * ln(greatest(1 - p, 1e-12)) - n_period * ln(0.99::DOUBLE) - n_plain * ln((1 - 0.99)::DOUBLE))
         * exp(-size) * (inside + 1) * pow(size::DOUBLE, -n_plain) AS score FROM sized)"""
_ENDS = _TYPED + r""",
ahead AS (SELECT *, lead(token) OVER w AS next, lead(type) OVER w AS next_type FROM typed WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ended AS MATERIALIZED (
  SELECT a.*, next IS NULL OR mark OR (stop AND NOT regexp_matches(next, '^["''(\[]*\p{Ll}') AND coalesce(s.score, 0) < 0.3) AS plain_end
  FROM ahead a LEFT JOIN scored s USING (type)),
begun AS (SELECT type, coalesce(lag(plain_end) OVER (PARTITION BY doc_id ORDER BY pos), false) AS start FROM ended),
starts AS (SELECT type, count(*) FILTER (start) AS n_start, count(*) AS n FROM begun GROUP BY type),
totals AS (SELECT sum(n_start)::DOUBLE AS a, sum(n)::DOUBLE AS whole FROM starts),
both_ AS (SELECT type, n_start, n, n_start::DOUBLE AS ab, n::DOUBLE AS b, a, whole FROM starts, totals WHERE type IS NOT NULL AND n_start > 0),
ratios AS (
  SELECT *, -2 * ((ab * ln(greatest(b / whole, 1e-12)) + (a - ab) * ln(greatest(1 - b / whole, 1e-12)))
                  + ((b - ab) * ln(greatest(b / whole, 1e-12)) + (whole - a - (b - ab)) * ln(greatest(1 - b / whole, 1e-12)))
                  - CASE WHEN a = ab THEN 0 ELSE ab * ln(greatest(ab / a, 1e-12)) + (a - ab) * ln(greatest(1 - ab / a, 1e-12)) END
                  - CASE WHEN b = ab THEN 0 ELSE (b - ab) * ln(greatest((b - ab) / greatest(whole - a, 1.0), 1e-12))
                      + (whole - a - (b - ab)) * ln(greatest(1 - (b - ab) / greatest(whole - a, 1.0), 1e-12)) END) AS ratio FROM both_),
starters AS MATERIALIZED (SELECT type, n_start, n, ratio FROM ratios WHERE ratio >= 30 AND whole / a > b / ab)"""
ORACLE["sentence_model"] = f"WITH {_TYPED} SELECT type, n_period, n_plain, round(score, 6) + 0.0 AS score, score >= 0.3 AS abbreviation FROM scored"
ORACLE["sentence_starters"] = f"WITH {_ENDS} SELECT type, n_start, n, round(ratio, 6) AS ratio FROM starters"
ORACLE["sentence_split_learned"] = rf"""
WITH {_ENDS}, cut AS (
  SELECT e.doc_id, e.pos, e.token,
         e.plain_end OR (e.stop AND regexp_matches(e.next, '^["''(\[]*\p{{Lu}}') AND s.type IS NOT NULL) AS ends
  FROM ended e LEFT JOIN starters s ON s.type = e.next_type),
numbered AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM cut)
SELECT doc_id, n::BIGINT AS pos, string_agg(token, ' ' ORDER BY pos) AS sentence FROM numbered GROUP BY doc_id, n"""


# Centrality


@registered
def central_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The most central sentence of every document."""
    best = centrality.central_sentences(fx.documents(spark, folder), "doc_id", "text")
    return best.withColumn("centrality", F.round("centrality", 6))


def _central_sql(rounds: int = 10) -> str:
    from gistmeter.plans.oracle import DOC_SENTENCES, TOKENS

    steps = "".join(
        f""", r{k + 1} AS MATERIALIZED (
  SELECT s.doc_id, s.pos, s.sentence, s.n, 0.15 / s.n + 0.85 * coalesce(g.x, 0) AS r
  FROM r{k} s LEFT JOIN (
    SELECT e.doc_id, e.i, sum(e.w * r.r / d.d) AS x FROM edges e JOIN r{k} r ON r.doc_id = e.doc_id AND r.pos = e.j
    JOIN degrees d ON d.doc_id = e.doc_id AND d.i = e.j GROUP BY e.doc_id, e.i) g ON g.doc_id = s.doc_id AND g.i = s.pos)"""
        for k in range(rounds)
    )
    return f"""
WITH {DOC_SENTENCES}, listed AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS place FROM ds),
firsts AS (SELECT doc_id, sentence, min(place) AS place FROM listed GROUP BY ALL),
sents AS MATERIALIZED (
  SELECT doc_id, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM firsts),
toks AS (SELECT doc_id, pos, unnest({TOKENS.format("sentence")}) AS t FROM sents),
tf AS (SELECT doc_id, pos, t, count(*)::DOUBLE AS c FROM toks GROUP BY ALL),
unit AS MATERIALIZED (SELECT doc_id, pos, t, c / sqrt(sum(c * c) OVER (PARTITION BY doc_id, pos)) AS w FROM tf),
edges AS MATERIALIZED (
  SELECT a.doc_id, a.pos AS i, b.pos AS j, sum(a.w * b.w) AS w FROM unit a JOIN unit b ON a.doc_id = b.doc_id AND a.t = b.t AND a.pos <> b.pos GROUP BY ALL),
degrees AS MATERIALIZED (SELECT doc_id, i, sum(w) AS d FROM edges GROUP BY ALL),
r0 AS (SELECT *, 1.0::DOUBLE / n AS r FROM sents){steps}
SELECT doc_id, pos, sentence, round(r, 6) AS centrality FROM r{rounds}
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(r, 9) DESC, pos) = 1"""


ORACLE["central_sentences"] = _central_sql()


# Nearest rows


@registered
def nearest_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest others of every vector."""
    near = neighbours.nearest_rows(fx.vectors(spark, folder), "vec_id", "vector")
    return near.withColumn("distance", F.round("distance", 6))


ORACLE["nearest_rows"] = """
WITH far AS (
  SELECT a.vec_id, b.vec_id AS neighbour,
         sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM far)
SELECT vec_id, rank, neighbour, round(distance, 6) AS distance FROM ranked WHERE rank <= 5"""


# Footers


@registered
def table_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Types, nulls and extremes of the document and label tables, from their footers."""
    names = ("documents", "labels")
    found = [footers.table_statistics(spark, f"{folder}/{n}.parquet").select(F.lit(n).alias("name"), "*") for n in names]
    return found[0].unionByName(found[1])


ORACLE["table_statistics"] = " UNION ALL ".join(
    f"""SELECT '{table}' AS name, '{column}' AS "column", '{kind}' AS type, count(*) AS n_rows, count(*) - count({column}) AS n_nulls,
        {f"min({column})::DOUBLE" if kind != "string" else "NULL::DOUBLE"} AS minimum, {f"max({column})::DOUBLE" if kind != "string" else "NULL::DOUBLE"} AS maximum
        FROM {table}"""
    for table, columns in {
        "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
        "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
    }.items()
    for column, kind in columns.items()
)


# Quantiles that merge


@registered
def latency_sketch(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles from daily sketches merged per configuration, and whether their exact rank is within the bound."""
    timed = scan(spark, folder, "events").select(F.col("event_type").alias("configuration"), F.to_date("ts").alias("day"), F.col("value").alias("seconds"))
    daily = materialize(trials.latency_sketches(timed, ["configuration", "day"], "seconds"), "sketches")
    found = trials.sketched_percentiles(trials.merged_sketches(daily, ["configuration"]), ["configuration"])
    # One row for each configuration and percentile meets that configuration's times.
    limits = found.groupBy("configuration").agg(F.first("steps").alias("steps"), F.collect_list(F.struct("percent", "seconds")).alias("limits"))
    times = timed.select("configuration", F.col("seconds").alias("time")).join(F.broadcast(limits), "configuration")
    ranked = times.select("configuration", "steps", "time", F.inline("limits")).groupBy("configuration", "percent", "steps").agg(
        F.sum((F.col("time") < F.col("seconds")).cast("long")).alias("below"), F.sum((F.col("time") <= F.col("seconds")).cast("long")).alias("upto")
    )
    wanted, room = F.col("percent") / 100 * F.col("steps"), F.col("steps") * trials.SKETCH_ERROR + 1
    within = (F.col("below") <= wanted + room) & (F.col("upto") >= wanted - room)
    return ranked.select("configuration", F.col("percent").cast("long").alias("percent"), "steps", within.alias("within"))


ORACLE["latency_sketch"] = """
SELECT event_type AS configuration, p::BIGINT AS percent, count(*) AS steps, true AS within
FROM events, (VALUES (50), (90), (99)) v(p) WHERE value IS NOT NULL GROUP BY ALL"""


# Plateaus of a log that arrives


@registered
def trial_plateau_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The plateaus of all trials, found by a stream that takes three parts of their log as they come, going on from its checkpoint."""
    log = materialize(fx.trial_log(spark, folder).select("trial", "training_iteration", "eval_rouge1"), "log")
    path, found, checkpoint = (fresh_path(spark, label) for label in ("arriving", "plateaus", "progress"))
    bounds = [0, *log.agg(F.percentile_approx("training_iteration", [0.3, 0.6])).first()[0], None]
    setting, width = "spark.sql.streaming.stateStore.providerClass", int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = spark.conf.get(setting)
    spark.conf.set(setting, plateau.STATE_STORE)
    try:
        for low, high in zip(bounds[:-1], bounds[1:]):
            part = log.where((F.col("training_iteration") > low) & (F.lit(True) if high is None else F.col("training_iteration") <= high))
            # Any order inside a part and any number of files: all of them are one micro-batch.
            order = F.xxhash64("trial", "training_iteration")
            part.repartition(width, order).sortWithinPartitions(order).write.mode("append").parquet(path)
            arriving = spark.readStream.schema(log.schema).parquet(path)
            stops = plateau.plateaus_of_stream(arriving, "trial", "training_iteration", "eval_rouge1", spread=10.0)
            sink = stops.writeStream.format("parquet").option("path", found).option("checkpointLocation", checkpoint)
            query = sink.queryName(f"plateaus_{uuid.uuid4().hex}").trigger(availableNow=True).outputMode("append").start()
            query.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(stops.schema).parquet(found)


ORACLE["trial_plateau_stream"] = ORACLE["trial_plateau"]
