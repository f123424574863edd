"""Registered queries of the text operators: each runs over its whole table with production settings."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedview.llm.chat import digests, format_conversations
from seedview.llm.centroids import cluster_vectors
from seedview.llm.common import bounded_batches, read_table, remainder, train_labels
from seedview.llm.decontam import find_leaks
from seedview.llm.host_rules import judge_documents
from seedview.llm.manifest import build_manifest, hex_of, leaf_digest, lower_ascii, prove
from seedview.llm.mixing import MixSettings, mix_sources
from seedview.llm.pii import BASE, find_personal_data, listed
from seedview.llm.pieces import encode_documents
from seedview.llm.quality import score_quality
from seedview.llm.simhash import hex_digits, near_duplicate_classes
from seedview.llm.suffix_dedup import remove_repeats
from seedview.llm.toxicity import fit_toxicity, score_toxicity
from seedview.llm.url_filter import Rule, judge_urls

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
]


#: Vocabulary file of the piece codec.
PIECES = "piece_bpe_32k.model"


def quality(spark: SparkSession, root: str) -> DataFrame:
    good = train_labels(read_table(spark, root, "labels"), "quality", 4, 2).where("y = 1")
    return score_quality(read_table(spark, root, "documents"), good).select(
        "doc_id",
        (remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def toxicity(spark: SparkSession, root: str) -> DataFrame:
    docs = read_table(spark, root, "documents")
    model = fit_toxicity(docs, train_labels(read_table(spark, root, "labels"), "toxic", 5, 0))
    return score_toxicity(docs, model).select(
        "doc_id",
        (remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def host_rules(spark: SparkSession, root: str) -> DataFrame:
    judged = judge_documents(read_table(spark, root, "documents"), "source")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def simhash(spark: SparkSession, root: str) -> DataFrame:
    classes = near_duplicate_classes(read_table(spark, root, "documents"))
    return classes.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def personal_data(spark: SparkSession, root: str) -> DataFrame:
    found = find_personal_data(read_table(spark, root, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["kind"].isin(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "row.doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def suffix_dedup(spark: SparkSession, root: str) -> DataFrame:
    return remove_repeats(read_table(spark, root, "documents"), texts=False)


def mixing(spark: SparkSession, root: str) -> DataFrame:
    return mix_sources(read_table(spark, root, "documents"), MixSettings(entropy=0.97))


def chat_format(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return digests(format_conversations(rows.unionByName(extra)))


def url_filter(spark: SparkSession, root: str) -> DataFrame:
    """Labels of a page are the quality labels of the document that its url ends with."""
    pages = read_table(spark, root, "pages").select("page_id", "url")
    number = F.regexp_extract(F.coalesce("url", F.lit("")), r"/([0-9]{1,18})(?:\.html)?/?(?:[?#].*)?$", 1)
    named = pages.select("page_id", F.when(number != "", number.cast("long")).alias("doc_id"))
    labels = read_table(spark, root, "labels").select("doc_id", (1 - F.col("quality")).alias("bad"))
    judged = judge_urls(pages, named.join(labels, "doc_id").select("page_id", "bad"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def piece_codec(spark: SparkSession, root: str) -> DataFrame:
    encoded = encode_documents(read_table(spark, root, "documents").select("doc_id", "text"), public_tokenizers.path(PIECES))
    ids = F.col("__encoded.ids")
    return encoded.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("__encoded.decoded"), 256).alias("decoded_sha256"),
    )


def merkle_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Texts of every fifth id by hash are checked with A-Z lower-cased; rows without id are left alone."""
    docs = read_table(spark, root, "documents")
    kept = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    altered = (remainder(F.col("doc_id"), 5) == 0) & F.col("doc_id").isNotNull()
    checked = F.when(altered, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    digests = docs.select(
        "doc_id",
        F.col("source").alias("group"),
        leaf_digest([*kept, F.col("text")]).alias("digest"),
        leaf_digest([*kept, checked]).alias("checked"),
    )
    manifest = build_manifest(digests)
    tree_root = F.lit(manifest.root).cast("string")
    return prove(manifest).select(
        "doc_id",
        hex_of(F.col("digest")).alias("leaf"),
        hex_of(F.col("subroot")).alias("subroot"),
        tree_root.alias("root"),
        F.sha2(hex_of(F.col("siblings")).cast("binary"), 256).alias("proof_sha256"),
        hex_of(F.col("folded")).alias("folded_root"),
        (hex_of(F.col("folded")) == tree_root).alias("verified"),
    )


def centroids(spark: SparkSession, root: str) -> DataFrame:
    clustered = cluster_vectors(read_table(spark, root, "embeddings"), "vec_id", "embedding")
    return clustered.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def decontamination(spark: SparkSession, root: str) -> DataFrame:
    leaks = find_leaks(read_table(spark, root, "documents"), read_table(spark, root, "benchmark"))
    return leaks.select("doc_id", "item_id", "score", "question_overlap", "answer_overlap")


def _bounded(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, root: str) -> DataFrame:
        bounded_batches(spark)
        return query(spark, root)

    return run


_ALL: dict[str, Query] = {
    "op1_quality": quality,
    "op2_toxicity": toxicity,
    "op3_suffix_dedup": suffix_dedup,
    "op4_host_rules": host_rules,
    "op5_mixing": mixing,
    "op6_simhash": simhash,
    "op7_personal_data": personal_data,
    "op8_chat_format": chat_format,
    "op9_url_filter": url_filter,
    "op10_decontamination": decontamination,
    "op11_piece_codec": piece_codec,
    "op12_merkle_manifest": merkle_manifest,
    "op13_centroids": centroids,
}

QUERIES: dict[str, Query] = {name: _bounded(query) for name, query in _ALL.items()}
