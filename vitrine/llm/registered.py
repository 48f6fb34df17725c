"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import sizing
from vitrine.llm import (
    blocks,
    bpe,
    decontaminate,
    dialogue,
    exact,
    jaccard,
    language,
    licences,
    negatives,
    quality,
    repeats,
    secrets,
    urls,
    warc,
)

VOCABULARY = "byte_bpe_50k.tiktoken"
ARCHIVED = datetime(2024, 1, 31, tzinfo=timezone.utc)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return blocks.bounded(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


@query(
    r"""
    WITH plain AS (
        SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents
    )
    SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = min(doc_id) OVER same AS kept, sha256(text) AS text_sha256
    FROM plain WINDOW same AS (PARTITION BY text)
    """
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = sizing.small_side(exact.copies(docs).withColumnRenamed("id", "doc_id"))
    hashed = docs.select("doc_id", F.sha2(exact.normalised("text"), 256).alias("text_sha256"))
    keep = F.coalesce("keep_id", "doc_id")
    return hashed.join(found, "doc_id", "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (keep == F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


def token_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document its number of tokens and hashes of its ids and of what they decode to."""
    encoded = bpe.encode(docs, vocabulary or public_tokenizers.path(VOCABULARY), decoded=True)
    return encoded.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def _labels(spans: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")


@query()
def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    phrases = F.filter(spans, lambda s: s["phrase"])
    starts = F.transform(phrases, lambda s: s["start"])
    return licences.scan(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size(phrases).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        _labels(phrases).alias("base_labels"),
        _labels(spans).alias("labels"),
        F.coalesce(F.array_max(F.transform(spans, lambda s: s["covered"])), F.lit(0.0)).alias("score"),
    )


def _span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query()
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    of_kind = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter(spans, lambda s: s["kind"] != "crf")
    return secrets.scan(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        of_kind("assign").alias("n_assign"),
        of_kind("access").alias("n_access"),
        of_kind("hex").alias("n_hex"),
        F.sha2(_span_list(base), 256).alias("base_sha256"),
        _span_list(spans).alias("spans"),
    )


@query()
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.select(
        F.col("id").alias("doc_id"), "text_score", "meta_score", "score", (F.col("score") >= 0.5).alias("kept")
    )


@query()
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(~language.held_out("doc_id")))
    return language.predict(docs, model).select(
        F.col("id").alias("doc_id"), language.held_out("id").alias("held_out"), "lang_pred", "score"
    )


@query()
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(docs, benchmark).select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "start", "end", "edits"
    )


@query(
    r"""
    WITH rules (verdict, host, path) AS (VALUES
        ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
        ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
    named AS (
        SELECT page_id,
               coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
               coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
        FROM pages),
    judged AS (
        SELECT n.host, n.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
               arg_max(r.verdict, length(r.host || r.path)) AS verdict
        FROM (SELECT DISTINCT host, path FROM named) n
        JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)
        GROUP BY ALL)
    SELECT n.page_id, n.host, n.path, j.rule, coalesce(j.verdict, 'allow') AS verdict
    FROM named n LEFT JOIN judged j ON n.host = j.host AND n.path = j.path
    """
)
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.rules(spark)).select(
        F.col("id").alias("page_id"), "host", "path", "rule", "verdict"
    )


@query()
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id")
    )


@query()
def op8_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.transform("removed", lambda s: s["end"] - s["start"])
    return repeats.without_repeats(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query()
def op11_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dialogue.damaged(dialogue.turns(table(spark, sf_dir, "conversations")))
    return dialogue.repair(rows).withColumnRenamed("id", "conv_id")


@query(
    r"""
    WITH hashed AS (
        SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
    ),
    digits AS (
        SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hexes,
               max(page_id) OVER (PARTITION BY payload) AS largest
        FROM hashed)
    SELECT page_id, payload_bytes,
           list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
               ('0x' || substr(hexes, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)
               FOR i IN range(32)], 'string_agg', '') AS payload_digest,
           CASE WHEN page_id IS DISTINCT FROM largest AND largest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to
    FROM digits
    """
)
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"), ARCHIVED).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to"
    )


@query(
    """
    WITH vectors AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
    scored AS (
        SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same,
               list_inner_product(a.vector, c.vector)::BIGINT AS score
        FROM vectors a JOIN vectors c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
    positives AS (
        SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id,
           row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
           id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    QUALIFY rank <= 5
    """
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding")
    return negatives.mine(rows, rows.filter("id % 100 = 0"))
