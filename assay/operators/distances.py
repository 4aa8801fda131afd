"""Distances between weighted samples and between curves on different grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.scalars import ratio


def wasserstein(u: DataFrame, v: DataFrame, keys: list[str], value: str = "x", weight: str = "w") -> DataFrame:
    """First Wasserstein distance between two weighted samples, by ``keys``: (keys, w1).

    Both sides are laid on one axis; between neighbouring values the cumulative shares differ by a
    constant. Rows with equal values are merged first. A side without weight gives null.
    """
    side = lambda d, a, b: d.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("x"), (F.col(weight) * a).alias("wu"), (F.col(weight) * b).alias("wv"))
    rows = side(u, 1.0, 0.0).unionByName(side(v, 0.0, 1.0)).groupBy(*keys, "x").agg(F.sum("wu").alias("wu"), F.sum("wv").alias("wv"))
    order, every = Window.partitionBy(*keys).orderBy("x"), Window.partitionBy(*keys)
    share = lambda c: ratio(F.sum(c).over(order), F.sum(c).over(every))
    gap = F.coalesce(F.lead("x").over(order) - F.col("x"), F.lit(0.0))
    rows = rows.select(*keys, (F.abs(share("wu") - share("wv")) * gap).alias("part"))
    return rows.groupBy(*keys).agg(F.when(F.count("part") == F.count("*"), F.sum("part")).alias("w1"))


def weighted_quantiles(rows: DataFrame, keys: list[str], levels: list[float], value: str = "x", weight: str = "w") -> DataFrame:
    """Inverse cumulative distribution at each level: (keys, level, quantile).

    The quantile is the least value whose cumulative share reaches the level, else the last one.
    A negative weight or a level outside 0 to 1 raises.
    """
    if any(not 0 <= x <= 1 for x in levels):
        raise ValueError("levels must lie between 0 and 1")
    rows = rows.where(F.col(value).isNotNull())
    w = F.when(F.col(weight) < 0, F.raise_error(F.lit("negative weight")).cast("double")).otherwise(F.col(weight))
    merged = rows.groupBy(*keys, F.col(value).alias("x")).agg(F.sum(w).alias("w"))
    order, every = Window.partitionBy(*keys).orderBy("x"), Window.partitionBy(*keys)
    cdf = merged.withColumn("cdf", ratio(F.sum("w").over(order), F.sum("w").over(every)))
    wanted = cdf.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    return wanted.groupBy(*keys, "level").agg(F.coalesce(F.min(F.when(F.col("cdf") >= F.col("level"), F.col("x"))), F.max("x")).alias("quantile"))


def _next_known(c: str, keys: list[str], *order: str) -> Column:
    """The next value of a column in a group's order that is not null, in one pass over its rows."""
    of = ", ".join(f"`{k}`" for k in keys)
    return F.expr(f"lead(`{c}`) IGNORE NULLS OVER ({f'PARTITION BY {of} ' if of else ''}ORDER BY {', '.join(order)})")


def _between(x: Column, a: str, b: str, y: str = "y") -> Column:
    """The value at x on the line from knot a to the next, b; a knot at x gives its own."""
    t = ratio(x - F.col(f"{a}.x"), F.col(f"{b}.x") - F.col(f"{a}.x"))
    return F.when(F.col(f"{a}.x") == x, F.col(f"{a}.{y}")).when(F.col(f"{b}.x") == x, F.col(f"{b}.{y}")).otherwise(F.col(f"{a}.{y}") + t * (F.col(f"{b}.{y}") - F.col(f"{a}.{y}")))


def interpolate(knots: DataFrame, grid: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Linear interpolation of curves at grid points: (keys, x, y); null outside a curve's range.

    Knots and points are unioned, and the nearest knots on both sides come from windows, so no
    as-of join is needed. ``knots`` and ``grid`` have the keys; grid points may repeat knots.
    """
    point = F.lit(None).cast("double")
    rows = knots.select(*keys, F.col(x).alias("x"), F.col(y).alias("y"), F.lit(False).alias("wanted"))
    rows = rows.unionByName(grid.select(*keys, F.col(x).alias("x"), point.alias("y"), F.lit(True).alias("wanted")))
    rows = rows.withColumn("knot", F.when(~F.col("wanted"), F.struct("x", "y")))
    back = Window.partitionBy(*keys).orderBy("x", "wanted").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"a": F.last("knot", ignorenulls=True).over(back), "b": _next_known("knot", keys, "x", "wanted")}).where("wanted")
    return rows.select(*keys, "x", _between(F.col("x"), "a", "b").alias("y"))


def common_grid(a: DataFrame, b: DataFrame, keys: list[str], points: int, x: str = "x") -> DataFrame:
    """Evenly spaced points over the overlap of two curves: (keys, i, x); no overlap gives no points."""
    ends = lambda d, s: d.groupBy(*keys).agg(F.min(x).alias(f"low_{s}"), F.max(x).alias(f"high_{s}"))
    both = ends(a, "a").join(ends(b, "b"), keys)
    both = both.withColumns({"low": F.greatest("low_a", "low_b"), "high": F.least("high_a", "high_b")}).where("low < high")
    out = both.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.when(F.col("i") == points - 1, F.col("high")).otherwise(F.col("low") + F.col("i") * ((F.col("high") - F.col("low")) / (points - 1)))
    return out.select(*keys, "i", at.alias("x"))


def on_common_grid(a: DataFrame, b: DataFrame, keys: list[str], points: int = 100, values: tuple[str, ...] = ("y",), last: str | None = None) -> DataFrame:
    """Both curves at the points of their common grid: (keys, i, x, ya, yb), and so for other ``values``.

    ``last`` names one of the values; each row then has it at the last point of its curve, too (ya_last, yb_last).

    The knots of both are merged, and each takes the points from itself up to the next by their numbers. So only knots are
    shuffled and sorted; points are made last, and stay with their curve.
    """
    side = lambda d, of_a: d.select(*keys, F.col("x").cast("double").alias("x"), *values, F.lit(of_a).alias("of_a"))
    rows = side(a, True).unionByName(side(b, False)).dropna(subset=[*keys, "x"])
    every, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("x")
    own = {"a": F.when(F.col("of_a"), F.struct("x", *values)), "b": F.when(~F.col("of_a"), F.struct("x", *values))}
    rows = rows.withColumns({f"{s}0": c for s, c in own.items()})
    rows = rows.withColumns({f"{s}1": _next_known(f"{s}0", keys, "x") for s in own} | {f"{end}_{s}": f(f"{s}0.x").over(every) for s in own for end, f in (("low", F.min), ("high", F.max))})
    rows = rows.withColumns({f"{s}0": F.last(f"{s}0", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)) for s in own})
    rows = rows.where("low_a IS NOT NULL AND low_b IS NOT NULL").withColumns({"low": F.greatest("low_a", "low_b"), "high": F.least("high_a", "high_b")}).where("low < high")
    top, step = F.lit(points - 1), (F.col("high") - F.col("low")) / max(points - 1, 1)
    at = lambda i: F.when(i == top, F.col("high")).otherwise(F.col("low") + i * step)
    near = F.greatest(F.lit(0), F.least(F.ceil(ratio(F.col("x") - F.col("low"), step)).cast("int"), top))
    near = near + (at(near) < F.col("x")).cast("int") - ((near > 0) & (at(near - 1) >= F.col("x"))).cast("int")  # division rounds
    rows = rows.withColumn("first", F.when(F.col("x") <= F.col("low"), 0).when(F.col("x") > F.col("high"), points).otherwise(near))
    rows = rows.withColumn("end", F.coalesce(F.lead("first").over(order), F.lit(points))).where("end > first")
    ends = [f"{last}{s}_last" for s in own if last]
    if last:  # the row that takes the last point knows them
        rows = rows.withColumns({f"{last}{s}_last": F.max(F.when(F.col("end") == points, _between(F.col("high"), f"{s}0", f"{s}1", last))).over(every) for s in own})
    rows = rows.withColumn("i", F.explode(F.sequence("first", F.col("end") - 1))).withColumn("x", at(F.col("i")))
    return rows.select(*keys, "i", "x", *ends, *(_between(F.col("x"), f"{s}0", f"{s}1", v).alias(f"{v}{s}") for v in values for s in own))


def merged_grid(a: DataFrame, b: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """All x of both curves up to the lesser of their maxima: (keys, x)."""
    top = a.groupBy(*keys).agg(F.max(x).alias("ta")).join(b.groupBy(*keys).agg(F.max(x).alias("tb")), keys)
    every = a.select(*keys, F.col(x).alias("x")).unionByName(b.select(*keys, F.col(x).alias("x"))).distinct()
    return every.join(top, keys).where(F.col("x") <= F.least("ta", "tb")).select(*keys, "x")


def trapezoid(rows: DataFrame, keys: list[str], y: str, x: str = "x") -> DataFrame:
    """Integral of y over x by ``keys``: (keys, area)."""
    w = Window.partitionBy(*keys).orderBy(x)
    part = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return rows.withColumn("part", part).groupBy(*keys).agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("area"))


def density_of_states(rows: DataFrame, keys: list[str], bins: int = 128, value: str = "freq", weight: str = "w") -> DataFrame:
    """Weighted histogram over each group's range, scaled to a peak of 1; null where nothing has weight."""
    from assay.operators.histograms import data_range_histogram

    out = data_range_histogram(rows, value, bins, keys, weight)
    return out.withColumn("dos", ratio("count", F.max("count").over(Window.partitionBy(*keys)))).drop("count")
