"""One query per corpus operator over the whole given tables, and SQL where it can tell the rows."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import centroid_clusters
from .decontamination import contaminated
from .jaccard_join import jaccard_components
from .lang_id import fit_language_trees, identify_language
from .line_dedup import dedup_lines
from .merkle import folded, merkle_manifest, proof_digest
from .mixing import mix_sources
from .quality_ensemble import fit_quality_ensemble, score_quality
from .quality_rules import apply_quality_rules, fit_quality_rules
from .sharding import balanced_shards
from .simhash import simhash_components
from .sql import SQL
from .storage import table
from .suffix_dedup import remove_repeated_strings
from .text import byte_size, held_out, n_words, whole
from .toxicity import fit_toxicity, score_toxicity

__all__ = ["QUERIES", "SQL"]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_strings(table(spark, sf_dir, "documents"), length=400)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous shards by doc_id under the law ``bytes``; the digest columns stand for the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", byte_size().alias("n"), F.crc32(whole().cast("binary")).alias("text_crc32"))
    out = balanced_shards(docs, shards=16, size=F.col("n") + 1, order=("doc_id", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify_language(docs, fit_language_trees(docs))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit_quality_rules(docs, table(spark, sf_dir, "labels"))
    return apply_quality_rules(docs.select("doc_id", "text"), rules).drop("text")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality_ensemble(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).drop("text")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words().alias("size"), F.xxhash64("text").alias("text_hash"))
    return mix_sources(docs, seed=17).drop("source")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(whole(), 256).alias("kept_sha256"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), words=3, radius=2)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"), clusters=8, rounds=10, dims=64, scale=1024, seed=3)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document, by its id's crc32, is verified with its text's A-Z lowered."""
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    found = F.when(held_out("doc_id", 5, 0), lowered).otherwise(F.col("text"))
    out = merkle_manifest(table(spark, sf_dir, "documents"), found)
    out = out.select("doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), folded(F.coalesce("found_leaf", "leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_sharding,
        op3_language_id,
        op4_toxicity,
        op5_quality_rules,
        op6_quality_classifier,
        op7_mixing,
        op8_decontamination,
        op9_jaccard_join,
        op10_line_dedup,
        op11_simhash,
        op12_centroids,
        op13_merkle,
    )
}
