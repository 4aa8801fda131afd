"""Streams into committed payloads, and a record log that tells what it turned away.

A payload is a base table and a delta for every batch since. A batch writes its own delta only, so its
cost follows its rows and not what was committed before; ``compact`` folds deltas into a new base now and then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.operators.gates import coverage_problems, keep_last
from assay.sources.payloads import BASE
from assay.sources.shared import written


def start_payload(committed: DataFrame, path: str) -> None:
    """The committed payload as base; keys are unique."""
    committed.write.parquet(f"{path}/base/upto=-1")
    committed.limit(0).write.parquet(f"{path}/deltas/batch=-1")  # so that there is a table before the first batch


def _newest_base(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    base = spark.read.parquet(f"{path}/base")
    upto = int(base.select(F.max("upto")).first()[0])  # one number
    return base.where(F.col("upto") == upto).drop("upto"), upto


def splice_into(path: str, key: str = "id", order: str = "order") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that adds the last row of each key in the batch as a delta; a repeated batch replaces its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        keep_last(batch.where(F.col(key) != BASE), [key], order).write.mode("overwrite").parquet(f"{path}/deltas/batch={batch_id}")

    return write


def current_payload(spark: SparkSession, path: str, schema: T.StructType, key: str = "id", order: str = "order", inactive: DataFrame | None = None) -> DataFrame:
    """The payload with all deltas: the newest row of each key, rows of later batches before others.

    Equal to a batch ``upsert`` of all batches: the committed base row stays, keys without news stay, and keys of ``inactive`` go.
    ``schema`` is that of the stream's rows; ``order`` is not a column of the payload.
    """
    base, upto = _newest_base(spark, path)
    fields = [f for f in schema.fields if f.name != "batch"]
    deltas = spark.read.schema(T.StructType([*fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/deltas")
    deltas = deltas.where(F.col("batch") > upto)
    names = base.columns
    rows = base.withColumn("__at", F.lit(-1).cast("long")).unionByName(deltas.select(*names, F.col("batch").alias("__at")))
    out = keep_last(rows, [key], "__at").drop("__at")
    if inactive is not None:
        out = out.join(inactive.where(F.col(key) != BASE).select(key).distinct(), key, "left_anti")
    return out


def compact(spark: SparkSession, path: str, schema: T.StructType, key: str = "id", order: str = "order", inactive: DataFrame | None = None) -> int:
    """Fold all deltas into a new base, and return the last batch in it; readers go on with the old one until it is whole."""
    done = spark.read.parquet(f"{path}/deltas").agg(F.max("batch")).first()[0]
    _, upto = _newest_base(spark, path)
    if done is None or done <= upto:
        return upto
    written(current_payload(spark, path, schema, key, order, inactive), "payload").write.mode("overwrite").parquet(f"{path}/base/upto={done}")
    return int(done)


def mark_duplicates(records: DataFrame, keys: list[str], order: str, accepted: DataFrame | None = None) -> DataFrame:
    """Records of a batch with ``duplicate``: true for all but the first of each key, and for all of keys that ``accepted`` has.

    The least ``order`` is the first. Keys before are looked up by those of the batch, so that only these go through a join.
    """
    place = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last())
    out = records.withColumn("duplicate", F.row_number().over(place) > 1)
    if accepted is None:
        return out
    same = lambda a, b: reduce(and_, (a[k].eqNullSafe(b[k]) for k in keys))
    now, before = records.select(*keys).distinct(), accepted.select(*keys)
    seen = before.join(now, same(before, now), "left_semi").distinct().select(*(F.col(k).alias(f"__{k}") for k in keys), F.lit(True).alias("__seen"))
    out = out.join(seen, reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)), "left")
    return out.withColumn("duplicate", F.col("duplicate") | F.coalesce("__seen", F.lit(False))).drop("__seen", *(f"__{k}" for k in keys))


def log_records(good: DataFrame, path: str, keys: list[str], order: str) -> None:
    """Run a stream of records into ``path``/log, as Parquet by batch: accepted and rejected records.

    The log is the state: a record of a key that an earlier batch accepted is a duplicate whatever its order. A repeated
    batch replaces its own rows and looks at those before it only.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        accepted = None
        if batch_id:
            log = T.StructType([*good.schema.fields, T.StructField("duplicate", T.BooleanType()), T.StructField("batch", T.LongType())])
            accepted = batch.sparkSession.read.schema(log).parquet(f"{path}/log").where((F.col("batch") < batch_id) & ~F.col("duplicate"))
        mark_duplicates(batch, keys, order, accepted).write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}")

    good.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/log-state").trigger(availableNow=True).start().awaitTermination()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The records of a log, with ``duplicate`` as a boolean."""
    return spark.read.parquet(f"{path}/log").drop("batch")


def log_report(log: DataFrame, quarantined: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """What a log holds: (status, n) with accepted, duplicate, truncated and, against the expected keys, missing and unexpected."""
    status = F.when(F.col("duplicate"), "duplicate").otherwise("accepted")
    counts = log.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    cut = quarantined.agg(F.count("*").alias("n")).select(F.lit("truncated").alias("status"), "n")
    gaps = coverage_problems(log.where("NOT duplicate"), expected, keys).groupBy(F.col("problem").alias("status")).agg(F.count("*").alias("n"))
    return counts.unionByName(cut.where("n > 0")).unionByName(gaps)
