"""Running sums and top-k over groups of any size.

A window over a whole group runs in one task. Here rows are cut into ranges of near-equal numbers of
rows first, by Spark's range partitioning; the ranges' totals are summed by a window over few rows,
and each range by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.sources.shared import written


def prefix_sums(rows: DataFrame, order: str, sums: dict[str, Column], keys: list[str] | None = None, ties: list[str] | None = None, descending: bool = False, ranges: int | None = None, following: dict[str, Column] | None = None) -> DataFrame:
    """Add sums over all rows of the group up to and with the row, in the order of a column.

    Rows with equal order and ties are summed one after the other in an arbitrary order, so give ties
    that tell rows apart; they also let Spark cut a value that very many rows have. Nulls in the order
    column come first. ``ranges`` are the shuffle partitions by default. The ranges are written once
    to the shared folder, because two scans must see the same cuts.

    ``following`` adds columns with values of the row after, also where that is in the next range: each range
    hands its first row to the one before. The last row of a group has null there.
    """
    keys = keys or []
    rows = rows.withColumns({f"__v_{name}": c for name, c in sums.items()})
    first = F.col(order).desc_nulls_first() if descending else F.col(order).asc_nulls_first()
    cut = [*keys, first, *(ties or [])]
    rows = rows.repartitionByRange(ranges, *cut) if ranges else rows.repartitionByRange(*cut)
    rows = written(rows.withColumn("__range", F.spark_partition_id()), "prefix-ranges")
    totals = rows.groupBy(*keys, "__range").agg(*(F.sum(f"__v_{name}").alias(f"__t_{name}") for name in sums))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__range").alias("__r"), *(F.coalesce(F.sum(f"__t_{name}").over(before), F.lit(0)).alias(f"__b_{name}") for name in sums))
    within = Window.partitionBy(*keys, "__range").orderBy(first, *(ties or [])).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"__s_{name}": F.sum(f"__v_{name}").over(within) for name in sums})
    match = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col("__range") == F.col("__r")]
    if following:
        ordered = Window.partitionBy(*keys, "__range").orderBy(first, *(ties or []))
        rows = rows.withColumn("__own", F.struct(*(c.alias(name) for name, c in following.items())))
        rows = rows.withColumns({"__ahead": F.lead("__own").over(ordered), "__place": F.row_number().over(ordered)})
        heads = rows.where("__place = 1").select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__range").alias("__r"), F.col("__own").alias("__head"))
        after = Window.partitionBy(*(f"__k_{k}" for k in keys)).orderBy("__r")
        totals = totals.join(heads.withColumn("__next", F.lead("__head").over(after)).drop("__head").withColumnsRenamed({f"__k_{k}": f"__h_{k}" for k in keys} | {"__r": "__hr"}),
                             [F.col(f"__k_{k}").eqNullSafe(F.col(f"__h_{k}")) for k in keys] + [F.col("__r") == F.col("__hr")]).drop("__hr", *(f"__h_{k}" for k in keys))
    out = rows.join(totals, match)
    if following:
        out = out.withColumn("__ahead", F.coalesce("__ahead", "__next"))
        out = out.withColumns({name: F.col("__ahead")[name] for name in following}).drop("__own", "__ahead", "__place", "__next")
    out = out.withColumns({name: F.col(f"__s_{name}") + F.col(f"__b_{name}") for name in sums})
    return out.drop("__range", "__r", *(f"__k_{k}" for k in keys), *(f"__{p}_{name}" for p in "vsb" for name in sums))


def top_rows(rows: DataFrame, keys: list[str], order: list[Column], k: int, place: str = "place", spread: int = 64) -> DataFrame:
    """The first k rows of each group with their place, by way of the first k of ``spread`` parts of it."""
    if k > spread * 16:  # large reports take more parts, so that none grows beyond some multiples of k
        spread *= 4
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(spread))
    rows = rows.withColumn("__part", part)
    rows = rows.withColumn("__p", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))).where(F.col("__p") <= k)
    rows = rows.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= k)
    return rows.drop("__part", "__p")
