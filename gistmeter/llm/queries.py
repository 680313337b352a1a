"""Registered queries of this subpackage and, where SQL can say the same, their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmeter.llm import (
    bit_planes,
    exact_trie,
    mixing,
    ngram_join,
    packing,
    periodic_runs,
    piece_merges,
    pivot_index,
    quality,
    rendering,
    substrings,
    toxicity,
    url_rules,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in token-budget batches of optimal length buckets."""
    return packing.pack(_table(spark, folder, "documents"))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with the words the mix takes of each."""
    return mixing.mix(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "times")


def op3_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as laid-out visible text."""
    return rendering.rendered(_table(spark, folder, "pages"))


def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the component of its links at similarity 0.75 on five words."""
    return ngram_join.jaccard_groups(_table(spark, folder, "documents"))


def op5_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every page judged by the nested host and path rules."""
    values = ", ".join(str(rule) for rule in url_rules.RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(verdict, host, path)")
    return url_rules.judge(_table(spark, folder, "pages"), rules)


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the passages of 13 words or more that an earlier one has."""
    stripped = substrings.strip_repeats(_table(spark, folder, "documents"))
    return stripped.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its toxicity score."""
    return toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op8_pivot_index(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector with its links at cosine 0.9 and their component."""
    return pivot_index.near_vectors(_table(spark, folder, "embeddings"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its quality score."""
    return quality.quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the copy that stays for it."""
    return exact_trie.exact_groups(_table(spark, folder, "documents"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, each tenth with a repeated stretch, with its periodic runs and what is left of it without them."""
    docs = _table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = periodic_runs.periodic_runs(periodic_runs.looped(docs))
    # Runs are in order, so the first of equals stays.
    most = F.reduce(
        "runs",
        F.get("runs", F.lit(0)),
        lambda best, run: F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best),
    )
    lines = F.transform("runs", lambda run: F.concat(F.concat_ws(",", run["start"].cast("string"), run["length"].cast("string"), run["period"].cast("string")), F.lit("\n")))
    found = found.withColumn("most", most)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("most.start").alias("start"),
        F.col("most.length").alias("length"),
        F.col("most.period").alias("period"),
        F.expr("most.length * 1000 div most.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_bit_plane_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Every whole vector with its centroid of 8 after 10 rounds."""
    return bit_planes.clusters(_table(spark, folder, "embeddings"))


def op13_sentencepiece(spark: SparkSession, folder: str, model: str | None = None) -> DataFrame:
    """Every document as piece ids with an end id, and decoded again; ``model`` is the path of a model file."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    with open(model, "rb") as file:
        tables = file.read()
    docs = _table(spark, folder, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    encoded = piece_merges.encode(docs, tables, bos=False, eos=True)
    told = encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        "ids",
    )
    return piece_merges.decode(told, tables).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {
    query.__name__: query
    for query in (
        op1_packing,
        op2_mixing,
        op3_html_extraction,
        op4_ngram_join,
        op5_url_rules,
        op6_substring_dedup,
        op7_toxicity,
        op8_pivot_index,
        op9_quality,
        op10_exact_dedup,
        op11_periodic_runs,
        op12_bit_plane_clusters,
        op13_sentencepiece,
    )
}


def _cluster_sql(rounds: int = 10) -> str:
    """The rounds of ``op12_bit_plane_clusters``, one after the other."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
        far{k} AS MATERIALIZED (
            SELECT v.vec_id, c.cluster, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS distance
            FROM parts v JOIN centroids{k} c USING (dim) GROUP BY v.vec_id, c.cluster),
        near{k} AS MATERIALIZED (
            SELECT vec_id, cluster, distance FROM far{k}
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)""")
        if k < rounds:
            steps.append(f"""
        centroids{k + 1} AS MATERIALIZED (
            SELECT c.cluster, c.dim, coalesce(m.x, c.x) AS x
            FROM centroids{k} c LEFT JOIN (
                SELECT n.cluster, p.dim, ((sum(p.x) - ((sum(p.x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
                FROM near{k} n JOIN parts p USING (vec_id) GROUP BY n.cluster, p.dim) m
              ON m.cluster = c.cluster AND m.dim = c.dim)""")
    return f"""
        WITH kept AS (
            SELECT vec_id, embedding FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        parts AS MATERIALIZED (
            SELECT vec_id, unnest(range(1, 65)) AS dim, floor(1024 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM kept),
        chosen AS (
            SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster
            FROM kept QUALIFY cluster < 8),
        centroids0 AS MATERIALIZED (
            SELECT c.cluster, p.dim, p.x FROM chosen c JOIN parts p USING (vec_id)),{",".join(steps)},
        digests AS (
            SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256
            FROM centroids{rounds} GROUP BY cluster)
        SELECT n.vec_id, n.cluster::INTEGER AS cluster, n.distance,
               (sum(n.distance) OVER (PARTITION BY n.cluster))::BIGINT AS cluster_inertia,
               (sum(n.distance) OVER ())::BIGINT AS inertia, d.centroid_sha256
        FROM near{rounds} n JOIN digests d USING (cluster)"""


ORACLE = {
    "op5_url_rules": r"""
        WITH parts AS (
            SELECT page_id,
                   coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        rules(verdict, rule_host, rule_path) AS (VALUES
            ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
            ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        fitting AS (
            SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.verdict,
                   length(r.rule_host || r.rule_path) AS size, length(r.rule_host) AS host_size
            FROM parts p LEFT JOIN rules r
              ON (p.host = r.rule_host OR suffix(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM fitting
        QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY size DESC NULLS LAST, host_size DESC) = 1""",
    "op10_exact_dedup": r"""
        WITH texts AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents),
        ranked AS (
            SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size
            FROM texts
            WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id))
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM ranked""",
    "op12_bit_plane_clusters": _cluster_sql(),
}
