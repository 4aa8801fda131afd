"""From raw documents to balanced training shards, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before it kept; it
is written as Parquet and reread between stages. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.decontamination import decontaminate
from assay.llm.jaccard_join import one_per_group
from assay.llm.mixing import mix_sources
from assay.llm.quality_ensemble import fit_quality_ensemble, score_quality
from assay.llm.sharding import balanced_shards
from assay.llm.storage import materialize, table
from assay.llm.text import packed, unpacked


_READ = ("doc_id", "text", "source")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects (score below 0.3) go.

    Null text counts as empty. Repeated rows are judged alike, each by itself; without labels of both
    classes all rows stay or go together; an empty table gives no rows.
    """
    model = fit_quality_ensemble(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(packed(docs, _READ), model)
    # counting here also keeps Spark from pushing the filter, and with it a second scoring, below the statistics
    scored = scored.observe("quality", F.count_if(F.col("predicted") == 0).alias("rejected"))
    return scored.where("predicted = 1").select(*unpacked(docs.columns, _READ))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; links are five-word shingles with a similarity of 0.8 or more.

    Of repeated rows one stays; rows with a null id and those without words all stay (see
    ``one_per_group``).
    """
    return one_per_group(docs, words=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go; null and empty texts stay, repeated rows go together."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents repeated or left out so that sources come near their target shares.

    A document is there as often as the words that the mix takes of it fill it, rounded; one
    without words stays once.
    """
    copies = F.expr("CASE WHEN size = 0 THEN 1 ELSE (2 * taken + size) div (2 * size) END")
    mixed = mix_sources(packed(docs, _READ), seed=17).withColumn("__copies", copies).where("__copies > 0")
    return mixed.withColumn("__copy", F.explode(F.expr("sequence(1, int(__copies))"))).select(*unpacked(docs.columns, _READ))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """16 contiguous shards of near-equal bytes; adds size, shard and slot. Null ids come first, null text has one byte."""
    return balanced_shards(docs, shards=16)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", drop_low_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("source_mixing", mix),
    ("sharding", shard),
]

#: A learned classifier decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
