"""Record streams: ingestion with quarantine, keyed upserts and an incremental leaderboard."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.scalars import stability_class
from assay.operators.discovery import classification_rates
from assay.operators.gates import keep_last


def read_records(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """JSON-line records as they arrive; lines that are cut off keep their text in ``_corrupt_record``."""
    lines = spark.readStream.options(**options).text(path)
    parse = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select(parse.alias("r")).select("r.*")


def good_records(records: DataFrame) -> DataFrame:
    return records.where("_corrupt_record IS NULL").drop("_corrupt_record")


def quarantined(records: DataFrame) -> DataFrame:
    return records.where("_corrupt_record IS NOT NULL").select("_corrupt_record")


def distinct_records(records: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """First record of each key within the watermark; state older than it is dropped."""
    return records.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def latest_into(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the last record of each key.

    Each batch writes a new version folder next to the ones before, so a repeated batch rewrites
    its own version only.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = keep_last(batch, keys, order)
        if batch_id:
            old = spark.read.parquet(f"{path}/version={batch_id - 1}")
            last = keep_last(old.unionByName(last), keys, order)
        last.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return write


def running_counts(records: DataFrame, keys: list[str], threshold: float = 0.0) -> DataFrame:
    """Confusion counts and error sums by keys, for a stream in complete or update mode."""
    rows = records.withColumn("outcome", stability_class("each_true", "each_pred", threshold))
    one = lambda k: F.count_if(F.col("outcome") == k).alias(k.lower())
    err = F.col("each_pred") - F.col("each_true")
    return rows.groupBy(*keys).agg(*map(one, ("TP", "FN", "FP", "TN")), F.count(err).alias("n"), F.sum(F.abs(err)).alias("abs_err"), F.sum(err * err).alias("sq_err"))


def leaderboard(counts: DataFrame) -> DataFrame:
    """Rates and errors from ``running_counts``."""
    out = classification_rates(counts)
    return out.withColumns({"mae": F.try_divide("abs_err", "n"), "rmse": F.sqrt(F.try_divide("sq_err", "n"))}).drop("abs_err", "sq_err")


def event_windows(events: DataFrame, length: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts and value sums of a timed stream by tumbling window and type; late rows beyond the watermark are dropped."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", length), "event_type")
    out = out.agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "low", "high")


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process all that is there, write it as Parquet below ``path`` and return the table.

    In complete or update mode the last version of the result is kept.
    """
    writer = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").outputMode(mode).start(f"{path}/rows").awaitTermination()
    else:
        writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/rows")).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
