"""Metrics of sampled energy and force curves; tables have the keys of a curve, x and y (or f)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.scalars import ratio, wavenumber
from assay.operators.distances import on_common_grid
from assay.operators.leaderboard import SKIPPED_ELEMENTS
from assay.operators.prefix import prefix_sums
from assay.sources.shared import written

WALLS = (1.0, 5.0, 10.0, 20.0, 50.0, 100.0)


def _w(keys: list[str], x: str = "x"):
    return Window.partitionBy(*keys).orderBy(x)


def valid_curves(rows: DataFrame, keys: list[str], least: int = 2, others: tuple[str, ...] = ()) -> DataFrame:
    """Curves with ``least`` points or more, finite values (of ``others`` too), and no x twice."""
    every = Window.partitionBy(*keys)
    bad = F.col("x").isNull() | F.col("y").isNull() | F.isnan("y") | (F.abs("y") == float("inf"))
    for c in others:
        bad = bad | _unknown(c)
    rows = rows.withColumn("__bad", bad | F.coalesce(F.lag("x").over(_w(keys)) == F.col("x"), F.lit(False)))
    rows = rows.withColumns({"__n": F.count("*").over(every), "__bad": F.max("__bad").over(every)})
    return rows.where((F.col("__n") >= least) & ~F.col("__bad")).drop("__n", "__bad")


def in_window(rows: DataFrame, elements: DataFrame, inner: float = 0.9, outer: float = 3.1, limit: float = float("inf"), slack: float = 1e-12) -> DataFrame:
    """Points within [inner * r_cov, min(outer * r_vdw, limit)] of their element."""
    ends = elements.select("element", (F.col("r_cov") * inner - slack).alias("__lo"), F.least(F.col("r_vdw") * outer, F.lit(limit)).alias("__hi"))
    return rows.join(F.broadcast(ends), "element").where(F.col("x").between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")  # one row per element


def trim_to_finite(rows: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Drop non-finite points outside the scored window; a curve with one inside is dropped whole."""
    bad = F.coalesce(F.isnan("y") | (F.abs("y") == float("inf")), F.lit(True))
    inside = F.col("x").between(F.col(low), F.col(high))
    rows = rows.withColumn("__bad", bad).withColumn("__reject", F.max(bad & inside).over(Window.partitionBy(*keys)))
    return rows.where(~F.col("__bad") & ~F.col("__reject")).drop("__bad", "__reject")


def total_variation(rows: DataFrame, keys: list[str], y: str = "y") -> DataFrame:
    step = F.abs(F.col(y) - F.lag(y).over(_w(keys)))
    return rows.withColumn("step", step).groupBy(*keys).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("total_variation"))


def tortuosity(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Total variation over the height of both sides of the well; null if it is flat."""
    step = F.abs(F.col("y") - F.lag("y").over(_w(keys)))
    out = rows.withColumn("step", step).groupBy(*keys).agg(F.sum("step").alias("tv"), F.min_by("y", "x").alias("y0"), F.max_by("y", "x").alias("y1"), F.min("y").alias("low"))
    direct = F.abs(F.col("y0") - F.col("low")) + F.abs(F.col("y1") - F.col("low"))
    return out.select(*keys, ratio("tv", direct).alias("tortuosity"))


def _turns(rows: DataFrame, keys: list[str], values: dict[str, tuple[Column, float]]) -> DataFrame:
    """Add values by name where they reach their threshold and are not 0, and the last such value before (``name_before``)."""
    rows = rows.withColumns({name: value for name, (value, _) in values.items()})
    rows = rows.withColumns({name: F.when((F.abs(name) >= least) & (F.col(name) != 0), F.col(name)) for name, (_, least) in values.items()})
    back = _w(keys).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({f"{name}_before": F.last(name, ignorenulls=True).over(back) for name in values})


def _flips(name: str) -> Column:
    return F.count_if(F.signum(name) != F.signum(f"{name}_before"))


def _jump(name: str) -> Column:
    return F.sum(F.when(F.signum(name) != F.signum(f"{name}_before"), F.abs(name) + F.abs(f"{name}_before")))


def flips(rows: DataFrame, keys: list[str], threshold: float = 1e-3, y: str = "y") -> DataFrame:
    """Sign changes of successive differences and the jumps at them: (keys, flips, jump).

    Differences below the threshold are removed before neighbours are compared; a jump is the sum
    of both differences' sizes.
    """
    rows = _turns(rows, keys, {"__d": (F.col(y) - F.lag(y).over(_w(keys)), threshold)})
    return rows.groupBy(*keys).agg(_flips("__d").alias("flips"), _jump("__d").alias("jump")).fillna(0, ["flips", "jump"])


def force_flips(rows: DataFrame, keys: list[str], threshold: float = 1e-2, f: str = "y") -> DataFrame:
    """Sign changes of a force along x; values below the threshold are removed first."""
    return _turns(rows, keys, {"__f": (F.col(f), threshold)}).groupBy(*keys).agg(_flips("__f").alias("flips"))


def wall_radii(rows: DataFrame, keys: list[str], walls: tuple[float, ...] = WALLS) -> DataFrame:
    """Where the inner wall reaches given heights above the far end: (keys, wall, r).

    Inwards from the minimum the running maximum is inverted by linear interpolation, with the
    first radius of each level; a wall that is not reached, or a minimum at the first point, gives null.
    """
    every = Window.partitionBy(*keys)
    rows = rows.withColumns({"e": F.col("y") - F.max_by("y", "x").over(every), "xm": F.min(F.struct("y", "x")).over(every)["x"], "x0": F.min("x").over(every)})
    inner = rows.where((F.col("x") <= F.col("xm")) & (F.col("xm") > F.col("x0")))
    inwards = Window.partitionBy(*keys).orderBy(F.col("x").desc())
    inner = inner.withColumn("level", F.max("e").over(inwards)).groupBy(*keys, "level").agg(F.max("x").alias("x"))
    up = Window.partitionBy(*keys).orderBy("level")
    inner = inner.withColumns({"l0": F.lag("level").over(up), "r0": F.lag("x").over(up)})
    wanted = rows.select(*keys).distinct().withColumn("wall", F.explode(F.array(*map(F.lit, walls))))
    hit = inner.join(F.broadcast(rows.sparkSession.createDataFrame([(w,) for w in walls], "wall double")), (F.col("wall") <= F.col("level")) & (F.col("wall") > F.coalesce("l0", F.lit(-1e300))))
    r = F.when(F.col("l0").isNull(), F.when(F.col("wall") == F.col("level"), F.col("x"))).otherwise(F.col("r0") + (F.col("wall") - F.col("l0")) / (F.col("level") - F.col("l0")) * (F.col("x") - F.col("r0")))
    return wanted.join(hit.select(*keys, "wall", r.alias("r")), [*keys, "wall"], "left")


def wall_distance_mae(pred: DataFrame, true: DataFrame, keys: list[str], walls: tuple[float, ...] = WALLS) -> DataFrame:
    """Mean distance of wall radii; a crossing that the prediction lacks costs the whole reference radius."""
    t = wall_radii(true, keys, walls).where("r IS NOT NULL").withColumnRenamed("r", "rt")
    both = t.join(wall_radii(pred, keys, walls), [*keys, "wall"], "left")
    return both.groupBy(*keys).agg(F.avg(F.abs(F.coalesce("r", F.lit(0.0)) - F.col("rt"))).alias("wall_mae"))


def paired_curves(pred: DataFrame, true: DataFrame, keys: list[str], points: int | None, values: tuple[str, ...] = ("y",)) -> DataFrame:
    """Both curves at the same x: (keys, i, x, ya, yb), and so for other ``values``.

    With ``points`` both are interpolated on their common grid of so many; without, curves whose x are exactly the same are
    taken as they are, and others left out.
    """
    if points is not None:
        return on_common_grid(pred, true, keys, points, values)
    a, b = (d.select(*keys, "x", *(F.col(v).alias(f"{v}{s}") for v in values)) for d, s in ((pred, "a"), (true, "b")))
    both = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), [*keys, "x"], "full_outer")
    every = Window.partitionBy(*keys)
    both = both.withColumn("alone", F.count_if(F.col("in_a").isNull() | F.col("in_b").isNull()).over(every)).where("alone = 0")
    return both.select(*keys, (F.row_number().over(every.orderBy("x")) - 1).alias("i"), "x", *(f"{v}{s}" for v in values for s in "ab"))


def curve_maes(pred: DataFrame, true: DataFrame, keys: list[str], points: int | None = 200, energy: str | None = "y", force: str | None = None) -> DataFrame:
    """Both MAEs at the same points: energies after both curves are aligned at their last common point, forces as they are."""
    values = tuple(c for c in (energy, force) if c)
    grid = on_common_grid(pred, true, keys, points, values, energy) if points is not None else paired_curves(pred, true, keys, None, values)
    d = lambda c, at="": F.col(f"{c}a{at}") - F.col(f"{c}b{at}")
    maes = {}
    if energy:
        shift = d(energy, "_last") if points is not None else F.max_by(d(energy), "i").over(Window.partitionBy(*keys))
        grid = grid.withColumn("__e", F.abs(d(energy) - shift))
        maes["energy_mae"] = F.avg("__e")
    if force:
        maes["force_mae"] = F.avg(F.abs(d(force)))
    return grid.groupBy(*keys).agg(*(c.alias(name) for name, c in maes.items()))


def energy_mae(pred: DataFrame, true: DataFrame, keys: list[str], points: int | None = 200) -> DataFrame:
    """MAE after both curves are aligned at their last common point; see ``paired_curves``."""
    return curve_maes(pred, true, keys, points)


def well_fit(rows: DataFrame, keys: list[str], points: int = 5) -> DataFrame:
    """Quadratic through up to five points around the minimum: (keys, r_eq, curvature, depth).

    The window is moved inwards at the ends. Without a convex fit, or with a vertex outside the
    points, r_eq is the minimum on the grid; without a convex fit the curvature is null.
    """
    every = Window.partitionBy(*keys)
    rows = rows.withColumns({"i": F.row_number().over(_w(keys)), "n": F.count("*").over(every)})
    rows = rows.withColumns({"im": F.min(F.struct("y", "i")).over(every)["i"], "xm": F.min(F.struct("y", "x")).over(every)["x"], "far": F.max_by("y", "x").over(every), "low": F.min("y").over(every)})
    first = F.greatest(F.lit(1), F.least(F.col("im") - points // 2, F.col("n") - points + 1))
    near = rows.where(F.col("i").between(first, first + points - 1)).withColumn("t", F.col("x") - F.col("xm"))
    t, y = F.col("t"), F.col("y") - F.col("low")
    sums = {f"s{k}": F.sum(F.pow(t, F.lit(k))) for k in range(5)} | {f"v{k}": F.sum(F.pow(t, F.lit(k)) * y) for k in range(3)}
    near = near.groupBy(*keys).agg(*(v.alias(k) for k, v in sums.items()), F.first("xm").alias("xm"), F.min("x").alias("xa"), F.max("x").alias("xb"), F.first("far").alias("far"), F.first("low").alias("low"))
    s0, s1, s2, s3, s4, v0, v1, v2 = (F.col(c) for c in ("s0", "s1", "s2", "s3", "s4", "v0", "v1", "v2"))
    det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    a = ratio(s0 * (s2 * v2 - s3 * v1) - s1 * (s1 * v2 - s2 * v1) + v0 * (s1 * s3 - s2 * s2), det)
    b = ratio(s0 * (v1 * s4 - v2 * s3) - v0 * (s1 * s4 - s2 * s3) + s2 * (s1 * v2 - s2 * v1), det)
    near = near.withColumns({"a": F.when(s0 >= 3, a), "b": F.when(s0 >= 3, b)})
    vertex = F.col("xm") + ratio(-F.col("b"), 2 * F.col("a"))
    r_eq = F.when((F.col("a") > 0) & vertex.between(F.col("xa"), F.col("xb")), vertex).otherwise(F.col("xm"))
    return near.select(*keys, r_eq.alias("r_eq"), F.when(F.col("a") > 0, 2 * F.col("a")).alias("curvature"), (F.col("far") - F.col("low")).alias("depth"))


def well_errors(pred: DataFrame, true: DataFrame, keys: list[str], masses: DataFrame | None = None, least_depth: float = 0.05) -> DataFrame:
    """Errors of bond length, well depth and harmonic wavenumber; skipped where the reference binds too weakly.

    ``masses`` has the keys' element and its mass; the reduced mass of a pair is half of it.
    """
    p, t = (well_fit(d, keys).select(*keys, *(F.col(c).alias(f"{s}_{c}") for c in ("r_eq", "curvature", "depth"))) for d, s in ((pred, "p"), (true, "t")))
    both = t.where(F.col("t_depth") >= least_depth).join(p, keys)
    out = {"bond_length_error": F.abs(F.col("p_r_eq") - F.col("t_r_eq")), "well_depth_error": F.abs(F.col("p_depth") - F.col("t_depth"))}
    if masses is not None:
        both = both.join(F.broadcast(masses), "element", "left")  # one row per element
        out["vib_freq_error"] = F.abs(wavenumber("p_curvature", F.col("mass") / 2) - wavenumber("t_curvature", F.col("mass") / 2))
    return both.select(*keys, *(v.alias(k) for k, v in out.items()))


def force_mae(pred: DataFrame, true: DataFrame, keys: list[str], points: int | None = 200) -> DataFrame:
    """MAE of force components at the same x (see ``paired_curves``); component columns belong to ``keys`` of the tables."""
    parts = [*keys, "component"]
    return paired_curves(pred, true, parts, points).groupBy(*keys).agg(F.avg(F.abs(F.col("ya") - F.col("yb"))).alias("force_mae"))


def windows(rows: DataFrame, keys: list[str], elements: DataFrame | None, inner: float = 0.9, outer: float = 3.1, wall_inner: float = 0.8) -> DataFrame:
    """The scored range of x of each curve: (keys, lo, wall_lo, hi), one row per curve.

    From ``inner`` (for walls ``wall_inner``) covalent radii of its element to ``outer`` van der Waals
    radii, at most its last x. Without a table of elements, or a radius there, that end is open.
    """
    ends = rows.groupBy(*keys).agg(F.max("x").alias("last"))
    if elements is None:
        return ends.select(*keys, F.lit(0.0).alias("lo"), F.lit(0.0).alias("wall_lo"), F.col("last").alias("hi"))
    ends = ends.join(F.broadcast(elements.select("element", "r_cov", "r_vdw")), "element", "left")  # one row per element
    low = lambda share, slack: F.coalesce(F.col("r_cov") * share - slack, F.lit(0.0))
    hi = F.least(F.col("last"), F.coalesce(F.col("r_vdw") * outer, F.col("last")))
    return ends.select(*keys, low(inner, 0.0).alias("lo"), low(wall_inner, 1e-12).alias("wall_lo"), hi.alias("hi"))


def within(rows: DataFrame, ends: DataFrame, keys: list[str], low: str = "lo") -> DataFrame:
    """Points in the scored range of their curve; a curve without a range has none."""
    ends = ends.select(*keys, F.col(low).alias("__lo"), F.col("hi").alias("__hi"))
    return rows.join(ends, keys).where(F.col("x").between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def _unknown(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def low_quality_references(rows: DataFrame, keys: list[str], jump: float = 1.5, least_flips: int = 3, least: int = 5, elements: DataFrame | None = None) -> DataFrame:
    """Curves that cannot be scored against: a value in the scored range is missing or not finite, or many flips and a large jump.

    Curves with fewer than ``least`` points in their range are not judged.
    """
    rows = _turns(within(rows, windows(rows, keys, elements), keys), keys, {"__d": (F.col("y") - F.lag("y").over(_w(keys)), 1e-3)})
    judged = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max(_unknown("y")).alias("bad"), _flips("__d").alias("flips"), _jump("__d").alias("jump"))
    rough = (F.nanvl(F.coalesce("jump", F.lit(0.0)), F.lit(0.0)) >= jump) & (F.col("flips") >= least_flips)
    return judged.where(f"n >= {least}").where(F.col("bad") | rough).select(*keys)


def own_metrics(rows: DataFrame, keys: list[str], forces: bool) -> DataFrame:
    """Metrics of curves alone, and of their force f, from one pass: (keys, ``OWN_METRICS``, with forces ``FORCE_METRICS``)."""
    order = _w(keys)
    rows = rows.withColumns({"__de": F.col("y") - F.lag("y").over(order)} | ({"__df": F.col("f") - F.lag("f").over(order)} if forces else {}))
    rows = _turns(rows, keys, {"__e": (F.col("__de"), 1e-3)} | ({"__f": (F.col("f"), 1e-2), "__g": (F.col("__df"), 0.0)} if forces else {}))
    variation = lambda c: F.coalesce(F.sum(F.abs(c)), F.lit(0.0))
    out = {"tv": F.sum(F.abs("__de")), "y0": F.min_by("y", "x"), "y1": F.max_by("y", "x"), "low": F.min("y")}
    out |= {"energy_diff_flips": _flips("__e"), "energy_jump": _jump("__e"), "total_variation": variation("__de")}
    if forces:
        out |= {"force_flips": _flips("__f"), "force_total_variation": variation("__df"), "force_jump": _jump("__g")}
    found = rows.groupBy(*keys).agg(*(c.alias(name) for name, c in out.items())).fillna(0, ["energy_jump", *(["force_jump"] if forces else ())])
    direct = F.abs(F.col("y0") - F.col("low")) + F.abs(F.col("y1") - F.col("low"))
    return found.withColumn("tortuosity", ratio("tv", direct)).drop("tv", "y0", "y1", "low")


#: Metrics of a curve alone, of its force f, against a reference, and of its force against the reference's.
OWN_METRICS = ("tortuosity", "energy_diff_flips", "energy_jump", "total_variation")
FORCE_METRICS = ("force_flips", "force_total_variation", "force_jump")
REFERENCE_METRICS = ("energy_mae", "wall_mae", "bond_length_error", "well_depth_error")
CURVE_METRICS = (*OWN_METRICS, *FORCE_METRICS, *REFERENCE_METRICS, "vib_freq_error", "force_mae")


def curve_metrics(pred: DataFrame, true: DataFrame, keys: list[str], names: tuple[str, ...] | None = None, least: int = 5, elements: DataFrame | None = None, masses: DataFrame | None = None, points: int | None = 200, skipped: tuple[str, ...] = SKIPPED_ELEMENTS) -> DataFrame:
    """Metrics of predicted curves, one row per curve scored; an unknown name raises.

    Curves of ``skipped`` elements (where element is one of the keys) are not scored. Energies and forces are compared at
    ``points`` interpolated points, or, without, only where both curves have the same x.

    Curves are cut to their ``windows``; those with fewer than ``least`` points there, with values or
    forces that are not finite, or with an x twice, are left out. References of low quality give no metrics
    against them, and walls are taken over the wider range. Curves to be scored and their references are
    written once to the shared folder, since each metric reads them. By default all metrics that the tables
    allow: those of forces need a column f (force on the first atom along the bond), the vibration
    needs ``masses`` (element, mass).
    """
    forces = "f" in pred.columns
    possible = [*OWN_METRICS, *(FORCE_METRICS if forces else ()), *REFERENCE_METRICS, *(["vib_freq_error"] if masses is not None else ()), *(["force_mae"] if forces and "f" in true.columns else ())]
    names = tuple(possible) if names is None else names
    if unknown := set(names) - set(CURVE_METRICS):
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    if lacking := set(names) - set(possible):
        raise ValueError(f"metrics that need forces or masses: {sorted(lacking)}")
    if "element" in keys:
        pred, true = (d.where(~F.col("element").cast("string").isin(*skipped)) for d in (pred, true))
    ends = windows(pred, keys, elements)
    scored = written(valid_curves(within(pred, ends, keys), keys, least, ("f",) if forces else ()), "curves-scored")
    good = written(true.join(low_quality_references(true, keys, elements=elements), keys, "left_anti"), "curves-references")
    walls = within(good, ends, keys, "wall_lo")
    good = within(good, ends, keys)
    good = good.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where("__n >= 2").drop("__n")
    wells = {"bond_length_error", "well_depth_error", "vib_freq_error"}
    wanted = {*names}
    out = own_metrics(scored, keys, forces)
    if wanted & {"energy_mae", "force_mae"}:
        out = out.join(curve_maes(scored, good, keys, points, "y" if "energy_mae" in wanted else None, "f" if "force_mae" in wanted else None), keys, "left")
    if "wall_mae" in wanted:
        out = out.join(wall_distance_mae(within(pred, ends, keys, "wall_lo"), walls, keys), keys, "left")
    if wanted & wells:
        out = out.join(well_errors(scored, good, keys, masses if "vib_freq_error" in wanted else None), keys, "left")
    return out.select(*keys, *names)


def merge_minimum(rows: DataFrame, keys: list[str], order: str = "spin_ord", digits: int = 4) -> DataFrame:
    """Of the candidates at each x (rounded) the one with least y; the first candidate wins ties."""
    scale = 10.0**digits
    x = F.rint(F.col("x") * scale) / scale
    rest = [c for c in rows.columns if c not in {*keys, "x"}]
    best = rows.where("y IS NOT NULL").groupBy(*keys, x.alias("x")).agg(F.min_by(F.struct(*rest), F.struct("y", order)).alias("b"))
    return best.select(*keys, "x", "b.*")


def drop_collapsed(rows: DataFrame, keys: list[str], drop: float = 20.0) -> DataFrame:
    """Remove points more than ``drop`` below the lower of their neighbours, one by one: (keys, x, y, round).

    The first such point from the left goes, then all are judged again, so points that collapsed
    together peel off; an end has one neighbour, the last point stays. ``round`` is 0 for points that
    stay, else their turn. Curves go through sorted Arrow batches, many at a time; each is worked through in one
    pass, since a removal changes only what its two neighbours are judged by.
    """

    known = ~_unknown("y")
    kept = rows.where(known).select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    kept = kept.repartition(*keys).sortWithinPartitions(*keys, F.col("x").asc_nulls_last(), "y")
    schema = T.StructType([*kept.schema.fields, T.StructField("round", T.IntegerType())])

    def turns(y: list[float]) -> list[int]:
        turn, gone, stays = [0] * len(y), 0, []  # ``stays`` are the points on the left that are not below for now
        for i, at in enumerate(y):
            right = y[i + 1] if i + 1 < len(y) else np.inf
            if gone == len(y) - 1 or not at < min(y[stays[-1]] if stays else np.inf, right) - drop:
                stays.append(i)
                continue
            gone += 1
            turn[i] = gone
            # only the neighbours of a point that went are judged anew, the left one first
            while stays and gone < len(y) - 1 and y[stays[-1]] < min(y[stays[-2]] if len(stays) > 1 else np.inf, right) - drop:
                gone += 1
                turn[stays.pop()] = gone
        return turn

    def starts(table: pa.Table) -> list[int]:
        new = np.zeros(len(table) - 1, bool)
        for k in keys:
            codes = table[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new |= codes[1:] != codes[:-1]
        return [0, *(np.flatnonzero(new) + 1).tolist()]

    def done(table: pa.Table, at: list[int]) -> Iterator[pa.RecordBatch]:
        y = table["y"].to_pylist()
        out = [t for lo, hi in zip(at, [*at[1:], len(y)], strict=True) for t in turns(y[lo:hi])]
        yield from table.append_column("round", pa.array(out, pa.int32())).to_batches()

    def peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last curve, which the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            at = starts(table)
            if len(at) > 1:
                yield from done(table.slice(0, at[-1]), at[:-1])
            held = table.slice(at[-1])
        if held is not None:
            yield from done(held, [0])

    return kept.mapInArrow(peel, schema)


def replace_branch_drops(candidates: DataFrame, keys: list[str], drop: float = 3.0) -> DataFrame:
    """Minimum-energy curve in which isolated drops to another branch are mended: (keys, x, y, branch, edited).

    A point on another branch than both neighbours, lower by ``drop`` than each of them and than the
    line between them, is replaced by the neighbours' branch at that x, the nearer to the line, if
    that is higher by ``drop`` and nearer to the line than the point. The left neighbour is taken as
    already mended, so a curve is worked through in order, one bounded group each.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        best = pdf.sort_values(["x", "y", "branch"]).drop_duplicates("x").reset_index(drop=True)
        at = {(r.x, r.branch): r.y for r in pdf.itertuples()}
        x, y, branch = (best[c].tolist() for c in ("x", "y", "branch"))
        edited = [False] * len(x)
        for i in range(1, len(x) - 1):
            line = y[i - 1] + (y[i + 1] - y[i - 1]) * (x[i] - x[i - 1]) / (x[i + 1] - x[i - 1])
            lowest = min(y[i - 1], y[i + 1], line)
            if branch[i] in (branch[i - 1], branch[i + 1]) or y[i] > lowest - drop:
                continue
            options = [b for b in (branch[i - 1], branch[i + 1]) if (x[i], b) in at]
            if not options:
                continue
            new = min(options, key=lambda b: abs(at[x[i], b] - line))
            value = at[x[i], new]
            if value >= y[i] + drop and abs(value - line) < abs(y[i] - line):
                branch[i], y[i], edited[i] = new, value, True
        return best[keys].assign(x=x, y=y, branch=branch, edited=edited)

    schema = ", ".join(f"{k} {candidates.schema[k].dataType.simpleString()}" for k in keys)
    return candidates.select(*keys, "x", "y", "branch").groupBy(*keys).applyInPandas(one, f"{schema}, x double, y double, branch string, edited boolean")


def drop_bumps(rows: DataFrame, keys: list[str], height: float = 0.1) -> DataFrame:
    """Remove single points higher by ``height`` than both neighbours and than the line between them, on the given curve."""
    w = _w(keys)
    x0, x1, y0, y1 = F.lag("x").over(w), F.lead("x").over(w), F.lag("y").over(w), F.lead("y").over(w)
    line = y0 + (y1 - y0) * ratio(F.col("x") - x0, x1 - x0)
    bump = (F.col("y") >= F.greatest(y0, y1) + height) & (F.col("y") >= line + height) & y0.isNotNull() & y1.isNotNull()
    return rows.withColumn("__bump", F.coalesce(bump, F.lit(False))).where("NOT __bump").drop("__bump")


def tail_jumps(rows: DataFrame, keys: list[str], jump: float = 0.1, points: int = 3) -> DataFrame:
    """Steps of ``jump`` or more among the last points of each curve."""
    back = Window.partitionBy(*keys).orderBy(F.col("x").desc())
    rows = rows.withColumns({"place": F.row_number().over(back), "step": F.abs(F.col("y") - F.lag("y").over(_w(keys)))})
    return rows.groupBy(*keys).agg(F.count_if((F.col("place") < points) & (F.col("step") >= jump)).alias("tail_jumps"))


def moment_jumps(rows: DataFrame, keys: list[str], jump: float = 1.0, moments: str = "magmoms") -> DataFrame:
    """Points where some moment differs by ``jump`` or more from the point before; missing ones, and other numbers of them, are skipped."""
    before = F.lag(moments).over(_w(keys))
    changed = (F.size(moments) == F.size(before)) & F.exists(F.zip_with(moments, before, lambda a, b: F.abs(a - b)), lambda d: F.coalesce(d >= jump, F.lit(False)))
    return rows.withColumn("changed", F.coalesce(changed, F.lit(False))).groupBy(*keys).agg(F.count_if("changed").alias("moment_jumps"))


def downsample(rows: DataFrame, keys: list[str], points: int) -> DataFrame:
    """Largest-triangle sampling of each polyline, in the order of x and y, to ``points`` points.

    The points between the ends fall into ``points`` - 2 buckets of equal width, each moved one bucket
    to the right. Of each bucket the point goes on that spans the largest triangle with the one chosen
    before and the bucket's mean; the first wins ties. The last bucket ends with the last point, so that one point fewer may
    be returned. Choices depend on each other, but a triangle over a given base is largest at a corner of the bucket's convex
    hull. So places are counted over ranges, hulls are taken batch by batch and joined up, and one group chooses among corners.
    """
    rows = rows.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    if points < 3:
        return rows
    rows = written(prefix_sums(rows, "x", {"__i": F.lit(1).cast("long")}, keys, ["y"]).withColumn("__i", F.col("__i") - 1), "polyline-places")
    size = rows.groupBy(*keys).agg(F.count("*").alias("__n")).withColumnsRenamed({k: f"__k_{k}" for k in keys})
    rows = rows.join(F.broadcast(size), [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])  # one row per polyline
    long = rows.where(F.col("__n") > points)
    width = (F.col("__n") - 2).cast("double") / (points - 2)
    start = lambda k: F.floor(k * width) + 1
    k = F.ceil(F.col("__i") / width) - 1
    k = k + (start(k + 1) <= F.col("__i")).cast("int") - (start(k) > F.col("__i")).cast("int")  # division rounds
    at = ["__k", "__i", "x", "y"]
    part = [F.col("x").alias("__sx"), F.col("y").alias("__sy"), F.lit(1).cast("long").alias("__c")]
    inner = long.withColumn("__k", F.least(k, F.lit(points - 2)).cast("int")).where("__k >= 1").select(*keys, *at, *part)
    end = F.when(F.col("__i") == 0, 0).when(F.col("__i") == F.col("__n") - 1, points - 1)
    ends = long.withColumn("__k", end).where("__k IS NOT NULL").select(*keys, *at, *(F.lit(0).cast(t).alias(c) for c, t in (("__sx", "double"), ("__sy", "double"), ("__c", "long"))))

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        """The corners of each bucket's hull; the first has the sums over the bucket."""
        out = []
        for _, g in pdf.groupby([*keys, "__k"], dropna=False, sort=False):
            sums = g[["__sx", "__sy", "__c"]].sum()
            g = g.sort_values(["x", "y", "__i"]).drop_duplicates(["x", "y"])
            x, y, kept = g["x"].tolist(), g["y"].tolist(), set()
            for order in (range(len(g)), range(len(g) - 1, -1, -1)):
                s: list[int] = []
                for j in order:
                    while len(s) > 1 and (x[s[-1]] - x[s[-2]]) * (y[j] - y[s[-2]]) <= (y[s[-1]] - y[s[-2]]) * (x[j] - x[s[-2]]):
                        s.pop()
                    s.append(j)
                kept.update(s)
            g = g.iloc[sorted(kept)].copy()
            for c in sums.index:
                g[c] = [sums[c]] + [0] * (len(g) - 1)
            out.append(g)
        return pd.concat(out).astype({"__c": "int64"})

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from (corners(pdf) for pdf in parts if len(pdf))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__k", "__i"]).reset_index(drop=True)
        chosen = [0]
        for k, g in pdf.groupby("__k"):
            if 0 < k < points - 1:
                px, py, n = pdf["x"][chosen[-1]], pdf["y"][chosen[-1]], g["__c"].sum()
                area = np.abs((px - g["__sx"].sum() / n) * (g["y"] - py) - (px - g["x"]) * (g["__sy"].sum() / n - py))
                chosen.append(g.index[int(area.to_numpy().argmax())])
        return pdf.loc[[*chosen, len(pdf) - 1]].drop_duplicates("__i")[[*keys, "x", "y"]]

    found = inner.sortWithinPartitions(*keys, "__k", "__i").mapInPandas(batches, inner.schema)
    found = found.groupBy(*keys, "__k").applyInPandas(corners, inner.schema)
    picked = found.unionByName(ends).groupBy(*keys).applyInPandas(choose, long.select(*keys, "x", "y").schema)
    return rows.where(F.col("__n") <= points).select(*keys, "x", "y").unionByName(picked)


def build_reference(candidates: DataFrame, keys: list[str], expected: DataFrame, points: int = 2) -> tuple[DataFrame, DataFrame]:
    """Reference curves from branch candidates, and a summary by functional.

    ``candidates``: keys, xc, branch, x and y; ``expected``: the keys and xc that must be there. Collapsed points go from each branch, the branches' minimum is taken (the first branch by name where they tie, x to four decimals), drops to another
    branch are mended and bumps removed. Returns (curves: keys, xc, x, y, branch, edited; summary: xc,
    curves, points, collapsed, mended, bumps, tail_jumps). Raises if an expected curve has fewer than
    ``points`` points.
    """
    every = [*keys, "xc"]
    judged = drop_collapsed(candidates, [*every, "branch"])
    alive = judged.where("round = 0").withColumn("x", F.rint(F.col("x") * 1e4) / 1e4)
    mended = replace_branch_drops(alive, every)
    curves = drop_bumps(mended, every)
    have = curves.groupBy(*every).agg(F.count("*").alias("n"))
    lacking = expected.select(*every).distinct().join(have.where(f"n >= {points}"), every, "left_anti")
    if found := lacking.limit(5).collect():
        raise ValueError(f"incomplete curves: {[tuple(r) for r in found]}")
    count = lambda rows, name: rows.groupBy("xc").agg(F.count("*").alias(name))
    summary = have.groupBy("xc").agg(F.count("*").alias("curves"), F.sum("n").alias("points"))
    for part in (
        count(judged.where("round > 0"), "collapsed"), count(mended.where("edited"), "mended"),
        count(mended, "before").join(count(curves, "after"), "xc").select("xc", (F.col("before") - F.col("after")).alias("bumps")),
        tail_jumps(curves, every).groupBy("xc").agg(F.sum("tail_jumps").alias("tail_jumps")),
    ):
        summary = summary.join(part, "xc", "left")
    return curves, summary.fillna(0)
