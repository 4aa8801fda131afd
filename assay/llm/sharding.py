"""Contiguous shards of equal bytes, from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize
from .text import byte_size


def balanced_shards(docs: DataFrame, shards: int = 16, size: Column | None = None, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Cut rows in the order of ``order`` into ``shards`` contiguous shards of near-equal bytes.

    Rows are range-partitioned once. Each partition's total goes into a prefix sum over
    partitions (a table with a row per partition), which is added to running sums within
    partitions. A row goes to the shard that holds the middle of its bytes in the global sum, so
    a shard is off its share by less than its two outermost rows.

    Adds size (by default UTF-8 bytes of text plus 1; null text has none), shard and slot (place
    in the shard, gapless from 0); columns with these names are replaced. Null keys come first,
    rows with equal keys stand as they are read, and a run of them is split like any other. An
    empty table gives no rows.
    """
    docs = docs.drop("size", "shard", "slot")
    size = byte_size() + 1 if size is None else size
    sized = docs.withColumn("size", size.cast("long")).withColumn("__tie", F.monotonically_increasing_id())
    keys = [*order, "__tie"]
    placed = sized.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id())
    placed = materialize(placed, "shard-ranges")

    parts = placed.groupBy("__part").agg(F.sum("size").alias("__bytes"), F.count("*").alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    parts = parts.select(
        "__part",
        F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__bytes_before"),
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rows_before"),
        F.sum("__bytes").over(every).alias("__total"),
    )
    within = Window.partitionBy("__part").orderBy(*keys)
    rows = placed.withColumn("__end", F.sum("size").over(within)).withColumn("__n", F.row_number().over(within))
    rows = rows.join(F.broadcast(parts), "__part")  # one row per partition
    rows = rows.withColumn("__row", F.col("__rows_before") + F.col("__n") - 1)
    middle = f"{shards} * (2 * (__bytes_before + __end) - size) div (2 * __total)"
    rows = rows.withColumn("shard", F.least(F.lit(shards - 1), F.expr(middle)).cast("int"))
    first = rows.groupBy("shard").agg(F.min("__row").alias("__first"))
    rows = rows.join(F.broadcast(first), "shard")  # one row per shard
    return rows.select(*docs.columns, "size", "shard", (F.col("__row") - F.col("__first")).alias("slot"))
