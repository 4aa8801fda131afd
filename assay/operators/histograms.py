"""Equal-width histograms; edges are low + i * width and the last bin is closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.scalars import ratio


def bin_number(x: Column, low: Column | float, high: Column | float, bins: int) -> Column:
    """0 to bins - 1; null outside the range. The quotient is corrected by one where rounding moved it past an edge."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    width = (high - low) / bins
    i = F.least(F.floor((x - low) / width), F.lit(bins - 1))
    i = F.when(x < low + i * width, i - 1).when((x >= low + (i + 1) * width) & (i < bins - 1), i + 1).otherwise(i)
    return F.when((x >= low) & (x <= high), i.cast("int"))


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which null keys meet."""
    right = right.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(right, on, "left").drop(*(f"__{k}" for k in keys))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Counts by ``keys`` and bin, empty bins included: (keys, bin, centre, count).

    Nulls, NaN and values outside the range are dropped. With ``weight`` the count is a sum.
    """
    keys = keys or []
    width = (high - low) / bins
    numbered = rows.where(~F.isnan(value)).withColumn("bin", bin_number(F.col(value), low, high, bins)).where("bin IS NOT NULL")
    counts = numbered.groupBy(*keys, "bin").agg((F.sum(weight) if weight else F.count("*")).alias("count"))
    every = rows.select(*keys).distinct() if keys else rows.sparkSession.range(1).select()
    every = every.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = _beside(every, counts, [*keys, "bin"]).fillna(0, ["count"])
    return out.withColumn("centre", F.lit(low) + (F.col("bin") + 0.5) * width)


def data_range_histogram(rows: DataFrame, value: str, bins: int, keys: list[str], weight: str | None = None) -> DataFrame:
    """As ``histogram`` over each group's own range; a range of one value is widened by 0.5 to both sides."""
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    ends = rows.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    one = F.col("low") == F.col("high")
    ends = ends.select(*keys, F.when(one, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"), F.when(one, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"))
    counts = _beside(rows, ends, keys).withColumn("bin", bin_number(F.col(value), F.col("low"), F.col("high"), bins))
    counts = counts.groupBy(*keys, "bin").agg((F.sum(weight) if weight else F.count("*")).alias("count"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = _beside(every, counts, [*keys, "bin"]).fillna(0, ["count"])
    return out.withColumn("centre", F.col("low") + (F.col("bin") + 0.5) * ((F.col("high") - F.col("low")) / bins)).drop("low", "high")


def deviation_histogram(rows: DataFrame, value: str, bins: int = 150, spread: float = 2.0) -> DataFrame:
    """Bins over mean +- spread * sample deviation, labelled by right edge: (bin, edge, count, stable)."""
    ends = rows.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    rows = rows.crossJoin(F.broadcast(ends))  # one row
    low, high = F.col("mean") - spread * F.col("std"), F.col("mean") + spread * F.col("std")
    rows = rows.withColumns({"bin": bin_number(F.col(value), low, high, bins), "low": low, "high": high}).where("bin IS NOT NULL")
    counts = rows.groupBy("bin", "low", "high").agg(F.count("*").alias("count"))
    edge = F.col("low") + (F.col("bin") + 1) * ((F.col("high") - F.col("low")) / bins)
    return counts.select("bin", edge.alias("edge"), "count", (edge <= 0).alias("stable"))


def cumulative_share(counts: DataFrame, order: str = "bin", keys: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*(keys or [])).orderBy(order)
    return counts.withColumn("cumulative", ratio(F.sum("count").over(w), F.sum("count").over(Window.partitionBy(*(keys or [])))))


def cumulative_cut(counts: DataFrame, share: float = 0.9, order: str = "bin") -> DataFrame:
    """The last bin before ``share`` of all counts is reached."""
    return cumulative_share(counts, order).where(F.col("cumulative") < share).agg(F.max(order).alias("cut"))


def density(counts: DataFrame, width: float, keys: list[str]) -> DataFrame:
    """Counts scaled to unit area by ``keys``."""
    return counts.withColumn("density", ratio(F.col("count"), F.sum("count").over(Window.partitionBy(*keys)) * width))


def nested_histogram(rows: DataFrame, values: str, low: float, high: float, bins: int, depth: int = 2, absolute: bool = True, keys: list[str] | None = None) -> DataFrame:
    """Histogram of all numbers in arrays nested ``depth`` deep, of their sizes by default: (keys, bin, centre, count)."""
    flat = F.col(values)
    for _ in range(depth - 1):
        flat = F.flatten(flat)
    long = rows.select(*(keys or []), F.explode_outer(flat).alias("__value")).withColumn("__value", F.col("__value").cast("double"))
    return histogram(long.withColumn("__value", F.abs("__value")) if absolute else long, "__value", low, high, bins, keys)


def element_histogram(sites: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Histogram by element of the value of each frame's last site of it: (element, bin, centre, count).

    sites: frame, site, element and the value. Counts are aggregated; no list of values is kept.
    """
    last = sites.groupBy("frame", "element").agg(F.max_by(value, "site").alias(value))
    return histogram(last, value, low, high, bins, ["element"])
