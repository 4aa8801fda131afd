"""Places of rows in text files, for files of any size.

Spark reads a file in blocks, a task each. Rows are counted per block; sums over the blocks before give
each row its place in the file, or in all files, without any task seeing a whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.sources.shared import written

#: Rows of a small table that may be broadcast; beyond it both sides are shuffled.
MOST_BROADCAST = 1_000_000


def join_small(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a written table of few rows, broadcast up to ``MOST_BROADCAST`` of them (counted)."""
    return rows.join(F.broadcast(small) if small.count() <= MOST_BROADCAST else small, on, how)


def marked(rows: DataFrame) -> DataFrame:
    """A file scan with ``__file``, ``__block`` (where the block of the file starts) and ``__id``, ascending within a block."""
    return rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))


def blocks(scan: DataFrame, by_file: bool, **also: Column) -> DataFrame:
    """One row per block of a marked scan: its first ``__id``, ``__rows``, and ``__before``, the rows of earlier blocks, of
    the same file or, in order of path, of all; ``also`` are aggregates over the block. Written once."""
    per = scan.groupBy("__file", "__block").agg(F.min("__id").alias("__first"), F.count("*").alias("__rows"), *(v.alias(k) for k, v in also.items()))
    order = Window.partitionBy("__file").orderBy("__block") if by_file else Window.orderBy("__file", "__block")  # a row per block of 128 MB
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    return written(per.withColumn("__before", F.coalesce(F.sum("__rows").over(earlier), F.lit(0))), "blocks")


def with_ordinals(rows: DataFrame, name: str = "ordinal") -> DataFrame:
    """Rows of a file scan with their place in reading order: files by path, lines as they stand, from 0 and without gaps."""
    scan = marked(rows)
    out = join_small(scan, blocks(scan, by_file=False), ["__file", "__block"])
    return out.withColumn(name, F.col("__id") - F.col("__first") + F.col("__before")).select(*rows.columns, name)
