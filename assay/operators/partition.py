"""Splitting rows into shards, chunks and training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.operators.prefix import prefix_sums
from assay.sources.places import join_small
from assay.sources.shared import written


def equal_chunks(rows: DataFrame, chunks: int, order: str = "ordinal") -> DataFrame:
    """Contiguous chunks 0 to n - 1 that differ by one row at most, the first ones longer.

    Rows are numbered by way of ranges of the order, so no task sees all of them.
    """
    placed = with_global_row(rows, order)
    n = placed.agg(F.count("*").alias("__n"))
    small, extra = F.expr(f"__n div {chunks}"), F.expr(f"__n % {chunks}")
    i, head = F.col("__row"), F.expr(f"(__n % {chunks}) * (__n div {chunks} + 1)")
    chunk = F.when(i < head, F.expr(f"__row div (__n div {chunks} + 1)")).otherwise(extra + F.try_divide(i - head, small).cast("long"))
    return placed.crossJoin(F.broadcast(n)).withColumn("chunk", chunk.cast("int")).drop("__row", "__n")  # one row


def with_global_row(rows: DataFrame, order: str, name: str = "__row") -> DataFrame:
    """Row numbers from 0 in the order of a number column."""
    out = prefix_sums(rows, order, {"__upto": F.lit(1).cast("long")})
    return out.withColumn(name, F.col("__upto") - 1).drop("__upto")


def balanced_by_sum(rows: DataFrame, shards: int, size: str, order: str) -> DataFrame:
    """Contiguous shards of near-equal total size: floor(sum before * shards / total)."""
    total = rows.agg(F.sum(size).alias("__total"))
    out = prefix_sums(rows, order, {"__upto": F.col(size).cast("long")}).crossJoin(F.broadcast(total))  # one row
    shard = F.least(F.lit(shards - 1), F.expr(f"(__upto - {size}) * {shards} div __total")).cast("int")
    return out.withColumn("shard", shard).drop("__upto", "__total")


def largest_first(sizes: DataFrame, shards: int) -> list[tuple[int, int, int, list[int]]]:
    """Greedy balance on a histogram (size, n): runs (size, first, last, order) of rows of one size.

    Rows go largest first, each to the lightest shard, ties to the lowest number. Rows of one size are alike, so the driver
    handles one line per distinct size. Taken in steps of the size, shards join in as the level reaches them; while none
    joins, rows go round the shards below the level in the order of their loads. That is a run: its rows first to
    last - 1, counted within the size, go to ``order`` in turn, starting with its first.
    """
    loads = [0] * shards
    out: list[tuple[int, int, int, list[int]]] = []
    for r in sizes.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.col("size").desc()).toLocalIterator():
        size, n = r["size"], r["n"]
        if size <= 0:  # the lightest shard stays the lightest
            out.append((size, 0, n, [min(range(shards), key=lambda s: (loads[s], s))]))
            continue
        base = min(loads)
        levels = sorted({(x - base) // size for x in loads})
        done = 0
        for i, level in enumerate(levels):
            ready = sorted((s for s in range(shards) if (loads[s] - base) // size <= level), key=lambda s: ((loads[s] - base) % size, s))
            room = (levels[i + 1] - level) * len(ready) if i + 1 < len(levels) else n
            take = min(room, n - done)
            if take:
                out.append((size, done, done + take, ready))
                done += take
            if done == n:
                break
        for _, first, last, order in (x for x in out if x[0] == size):
            for k, s in enumerate(order):
                loads[s] += size * len(range(first + k, last, len(order)))
    return out


def place_largest_first(rows: DataFrame, shards: int, size: str = "size", order: str = "id") -> DataFrame:
    """Add ``shard``: rows go largest first, those of a size in the order of a column, each to the lightest shard.

    Equal to placing rows one by one. Rows are numbered within their size over ranges, so a size that very many rows have
    is no task of its own; the runs of ``largest_first`` are a line per size. Null sizes count as 0.
    """
    rows = rows.withColumn("__size", F.coalesce(F.col(size), F.lit(0)).cast("long"))
    runs = largest_first(rows.groupBy(F.col("__size").alias("size")).agg(F.count("*").alias("n")), shards)
    spark = rows.sparkSession
    lines = spark.createDataFrame(runs, "__size long, first long, last long, turns array<int>").groupBy("__size").agg(F.collect_list(F.struct("first", "last", "turns")).alias("__runs"))
    placed = prefix_sums(rows, "__size", {"__upto": F.lit(1).cast("long")}, ties=[order], descending=True)
    starts = placed.groupBy("__size").agg(F.min("__upto").alias("__start"))
    lines = written(starts.join(lines, "__size"), "largest-first")
    placed = join_small(placed, lines, ["__size"]).withColumn("__k", F.col("__upto") - F.col("__start"))
    run = "filter(__runs, r -> __k >= r.first AND __k < r.last)[0]"
    placed = placed.withColumn("__run", F.expr(run)).withColumn("shard", F.expr("__run.turns[int((__k - __run.first) % size(__run.turns))]"))
    return placed.drop("__size", "__upto", "__start", "__runs", "__k", "__run")


def train_test(rows: DataFrame, key: str, train_percent: int = 95, seed: int = 0) -> DataFrame:
    """A seeded split by a hash of the key, the same under any partitioning."""
    return rows.withColumn("is_train", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(100)) < train_percent)
