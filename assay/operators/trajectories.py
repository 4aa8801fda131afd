"""Structure and dynamics of particle trajectories.

``atoms(system, frame, atom, x, y, z, ...)`` is long, with one row per atom and frame; ``cells``
has the edge lengths (or a 3x3 cell) of each system. Distances use the minimum image.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.scalars import finite, ratio
from assay.operators import lattices
from assay.operators.distances import interpolate, merged_grid, trapezoid, wasserstein
from assay.operators.histograms import bin_number
from assay.operators.neighbours import cubic, neighbour_pairs, with_lattice
from assay.sources.shared import written

KB = 8.617333262e-5  # eV/K
_U_A2_FS2 = 103.642696562  # eV per u * (A/fs)^2
_XYZ = ("x", "y", "z")


def image_radius(cells: DataFrame, key: str = "system") -> DataFrame:
    """Half the shortest lattice vector of each system's cells: (key, radius).

    ``cells`` has a column cell (3x3) and, optionally, pbc (3 flags). Cells are reduced first, so they may be skewed
    to any extent; where no direction is periodic the shortest vector of the cell counts.
    """
    on = [key, "cell", *(["pbc"] if "pbc" in cells.columns else [])]
    return with_lattice(cells.select(*on).distinct()).groupBy(key).agg((F.min(lattices.shortest()) / 2).alias("radius"))


def _image(d: Column, edge: Column | float) -> Column:
    edge = edge if isinstance(edge, Column) else F.lit(float(edge))
    return d - edge * F.rint(d / edge)


def _with_cell(rows: DataFrame, cell: float | DataFrame, keys: tuple[str, ...] | list[str]) -> DataFrame:
    """Rows with their cell: the edge of a cubic one, or 3x3 with its reduced lattice from a table by system or by system and frame."""
    if isinstance(cell, DataFrame):
        on = [k for k in keys if k in cell.columns]
        cell = written(with_lattice(cell).withColumns({"shifts": lattices.image_shifts(), "limits": lattices.image_limits()}), "images")
        return rows.join(cell.select(*on, "cell", "lattice", "inverse", "shifts", "limits"), on)
    return rows.withColumn("cell", F.lit(float(cell)))


def _with_image(rows: DataFrame, vector: tuple[Column, Column, Column], cell: float | DataFrame, name: str) -> DataFrame:
    """Add the shortest image of a vector, as a struct of r2, x, y and z."""
    rows = rows.withColumns({f"__d{c}": v for c, v in zip(_XYZ, vector, strict=True)})
    if isinstance(cell, DataFrame):
        rows = lattices.with_nearest_image(rows, tuple(f"__d{c}" for c in _XYZ), name)
    else:
        x, y, z = (_image(F.col(f"__d{c}"), F.col("cell")) for c in _XYZ)
        rows = rows.withColumn(name, F.struct((x * x + y * y + z * z).alias("r2"), x.alias("x"), y.alias("y"), z.alias("z")))
    return rows.drop(*(f"__d{c}" for c in _XYZ))


def pair_distances(atoms: DataFrame, edge: float | DataFrame, keys: tuple[str, ...] = ("system", "frame"), directed: bool = False, cutoff: float | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """Atom pairs of each frame with their minimum-image vector: (keys, i, j, dx, dy, dz, r).

    ``edge`` is that of a cubic cell, or a table (system, cell) or (system, frame, cell) of 3x3 cells, reduced or not.
    Columns ``also`` come twice, with 1 and 2 after their names. All pairs of a frame are joined; with a ``cutoff`` (at
    most half the shortest lattice vector) only neighbouring grid cells are, see ``neighbour_pairs``.
    """
    if cutoff is not None:
        cells = edge if isinstance(edge, DataFrame) else cubic(atoms, edge, list(keys))
        return neighbour_pairs(atoms, cells, cutoff, list(keys), directed, also).where(F.col("r") < cutoff)
    a = atoms.select(*keys, F.col("atom").alias("i"), *(F.col(c).alias(f"{c}1") for c in (*_XYZ, *also)))
    b = atoms.select(*keys, F.col("atom").alias("j"), *(F.col(c).alias(f"{c}2") for c in (*_XYZ, *also)))
    pairs = _with_cell(a.join(b, list(keys)).where("i <> j" if directed else "i < j"), edge, keys)
    pairs = _with_image(pairs, tuple(F.col(f"{c}2") - F.col(f"{c}1") for c in _XYZ), edge, "d")
    names = [f"{c}{n}" for c in also for n in (1, 2)]
    return pairs.select(*keys, "i", "j", *(F.col(f"d.{c}").alias(f"d{c}") for c in _XYZ), F.sqrt("d.r2").alias("r"), *names)


def _volume(cell: float | DataFrame) -> Column:
    if not isinstance(cell, DataFrame):
        return F.lit(float(cell) ** 3)
    at = lambda i, j: F.get(F.get("cell", F.lit(i)), F.lit(j))
    minor = lambda i, j: at(1, i) * at(2, j) - at(1, j) * at(2, i)
    return F.abs(at(0, 0) * minor(1, 2) - at(0, 1) * minor(0, 2) + at(0, 2) * minor(0, 1))


def _radii(atoms: DataFrame, cell: float | DataFrame) -> DataFrame:
    """Half the shortest lattice vector of each system, the least of its frames: (system, radius)."""
    if not isinstance(cell, DataFrame):
        return atoms.select("system").distinct().withColumn("radius", F.lit(float(cell) / 2))
    return image_radius(cell)


def rdf(atoms: DataFrame, edge: float | DataFrame, bins: int = 500, r_max: float | DataFrame | None = None) -> DataFrame:
    """Radial distribution function: (system, bin, r, g); cells as in ``pair_distances``.

    Counts over the ideal count, the sum of N^2/2 * shell / volume over frames. By default a system's
    bins end at half its shortest lattice vector; ``r_max``, a number or a table (system, radius), beyond that raises.
    """
    limits = _radii(atoms, edge)
    if r_max is not None:
        if not isinstance(r_max, DataFrame) and (not r_max > 0 or not isinstance(edge, DataFrame) and r_max > edge / 2 + 1e-12):
            raise ValueError("r_max must be positive and at most half the cell")
        wanted = r_max.select("system", F.col("radius").alias("__wanted")) if isinstance(r_max, DataFrame) else atoms.select("system").distinct().withColumn("__wanted", F.lit(float(r_max)))
        fits = F.col("radius") >= F.col("__wanted") - 1e-12
        limits = limits.join(wanted, "system").select("system", F.when(fits, F.col("__wanted")).otherwise(F.raise_error(F.lit("r_max is beyond half the cell")).cast("double")).alias("radius"))
    pairs = pair_distances(atoms, edge)
    if r_max is not None and isinstance(edge, DataFrame):  # a short reach leaves most pairs out
        pairs = neighbour_pairs(atoms, edge.join(limits.withColumnRenamed("radius", "__reach"), "system"), "__reach")
    counts = pairs.join(limits, "system").withColumn("bin", bin_number(F.col("r"), 0.0, F.col("radius"), bins)).where("bin IS NOT NULL")
    counts = counts.groupBy("system", "bin").agg(F.count("*").alias("n"))
    size = _with_cell(atoms.groupBy("system", "frame").agg(F.count("*").alias("m")), edge, ("system", "frame"))
    size = size.groupBy("system").agg((F.sum(F.col("m").cast("double") * F.col("m") / _volume(edge)) / 2).alias("pairs")).join(limits, "system").withColumn("width", F.col("radius") / bins)
    every = size.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(counts, ["system", "bin"], "left")
    shell = 4.0 / 3.0 * np.pi * (F.pow((F.col("bin") + 1) * F.col("width"), F.lit(3)) - F.pow(F.col("bin") * F.col("width"), F.lit(3)))
    return every.select("system", "bin", ((F.col("bin") + 0.5) * F.col("width")).alias("r"), (F.coalesce("n", F.lit(0)) / (F.col("pairs") * shell)).alias("g"))


def rdf_error(pred: DataFrame, true: DataFrame) -> DataFrame:
    """100 * min(1, integral |g_t - g_p| / integral |g_t - 1|); no reference structure gives 100."""
    both = true.select("system", "bin", "r", F.col("g").alias("gt")).join(pred.select("system", "bin", F.col("g").alias("gp")), ["system", "bin"])
    up = trapezoid(both.withColumn("d", F.abs(F.col("gt") - F.col("gp"))), ["system"], "d", "r").withColumnRenamed("area", "up")
    down = trapezoid(both.withColumn("d", F.abs(F.col("gt") - 1)), ["system"], "d", "r").withColumnRenamed("area", "down")
    return up.join(down, "system").select("system", (100 * F.coalesce(F.least(F.lit(1.0), ratio("up", "down")), F.lit(1.0))).alias("rdf_error"))


def bonds_within(atoms: DataFrame, edge: float | DataFrame, radii: DataFrame, factor: float = 1.25) -> DataFrame:
    """Directed pairs within ``factor`` times the sum of their species' radii, at most half the shortest lattice vector.

    ``atoms`` has species, ``radii`` (species, radius) one row per species.
    """
    most = radii.agg(F.max("radius").alias("__longest"))
    cells = (edge if isinstance(edge, DataFrame) else cubic(atoms, edge, ["system", "frame"])).join(_radii(atoms, edge), "system")
    cells = cells.crossJoin(F.broadcast(most)).withColumn("__reach", F.least("radius", F.col("__longest") * (2 * factor)))  # one row
    pairs = neighbour_pairs(atoms, cells, "__reach", directed=True, also=("species",)).join(_radii(atoms, edge).withColumnRenamed("radius", "most"), "system")
    for n in (1, 2):
        pairs = pairs.join(F.broadcast(radii.select(F.col("species").alias(f"species{n}"), F.col("radius").alias(f"radius{n}"))), f"species{n}")
    return pairs.where((F.col("r") > 1e-12) & (F.col("r") <= F.least(F.col("most"), (F.col("radius1") + F.col("radius2")) * factor)))


def adf(atoms: DataFrame, edge: float | DataFrame, cutoff: float | DataFrame, bins: int = 180) -> DataFrame:
    """Histogram of angles between bonds, of unit area: (system, bin, angle, density).

    Bonds are pairs within ``cutoff``, or within the sums of species' radii where it is a table; see
    ``bonds_within``.
    """
    bonds = bonds_within(atoms, edge, cutoff) if isinstance(cutoff, DataFrame) else pair_distances(atoms, edge, directed=True, cutoff=cutoff)
    one = bonds.select("system", "frame", "i", *(F.col(c).alias(f"{c}_1") for c in ("j", "dx", "dy", "dz", "r")))
    two = bonds.select("system", "frame", "i", *(F.col(c).alias(f"{c}_2") for c in ("j", "dx", "dy", "dz", "r")))
    pairs = one.join(two, ["system", "frame", "i"]).where("j_1 < j_2")
    cos = F.expr("(dx_1 * dx_2 + dy_1 * dy_2 + dz_1 * dz_2) / (r_1 * r_2)")
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))
    counts = pairs.withColumn("bin", bin_number(angle, 0.0, 180.0, bins)).groupBy("system", "bin").agg(F.count("*").alias("n"))
    every = atoms.select("system").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(counts, ["system", "bin"], "left").fillna(0, ["n"])
    width = 180.0 / bins
    return every.select("system", "bin", ((F.col("bin") + 0.5) * width).alias("angle"), ratio("n", F.sum("n").over(Window.partitionBy("system")) * width).alias("density"))


def adf_error(pred: DataFrame, true: DataFrame) -> DataFrame:
    """100 * min(1, W1(true, pred) / W1(true, sine))."""
    p, t = (d.select("system", F.col("angle").alias("x"), F.col("density").alias("w")) for d in (pred, true))
    sine = t.select("system", "x", F.sin(F.radians("x")).alias("w"))
    both = wasserstein(t, p, ["system"]).withColumnRenamed("w1", "up").join(wasserstein(t, sine, ["system"]).withColumnRenamed("w1", "down"), "system")
    return both.select("system", (100 * F.coalesce(F.least(F.lit(1.0), ratio("up", "down")), F.lit(1.0))).alias("adf_error"))


def _with_dt(rows: DataFrame, dt: float | DataFrame) -> DataFrame:
    """Rows with the time step dt, one for all or from a table (system, dt)."""
    return rows.join(dt.select("system", "dt"), "system") if isinstance(dt, DataFrame) else rows.withColumn("dt", F.lit(float(dt)))


def velocities(atoms: DataFrame, edge: float | DataFrame, dt: float | DataFrame) -> DataFrame:
    """Central differences of unwrapped positions, one-sided at the ends: (system, frame, atom, vx, vy, vz)."""
    w = Window.partitionBy("system", "atom").orderBy("frame")
    rows = _with_cell(_with_dt(atoms, dt), edge, ("system", "frame"))
    rows = _with_image(rows, tuple(F.col(c) - F.lag(c).over(w) for c in _XYZ), edge, "step")
    rows = rows.withColumn("step", F.when(F.lag("frame").over(w).isNotNull(), F.col("step")))
    for c in _XYZ:
        rows = rows.withColumn(f"u{c}", F.sum(F.coalesce(f"step.{c}", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.when(F.lag("frame").over(w).isNull() | F.lead("frame").over(w).isNull(), 1).otherwise(2)
    v = lambda c: (F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))) / (span * F.col("dt"))
    return rows.select("system", "frame", "atom", *(v(f"u{c}").alias(f"v{c}") for c in _XYZ))


def kinetic_temperature(v: DataFrame, masses: DataFrame) -> DataFrame:
    """Mean equipartition temperature of each system; masses (system, atom, mass) in u, velocities in A/fs."""
    e = (F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz")) * F.col("mass") * _U_A2_FS2
    frames = v.join(masses, ["system", "atom"]).groupBy("system", "frame").agg((F.sum(e) / (3 * F.count("*") * KB)).alias("t"))
    return frames.groupBy("system").agg(F.avg("t").alias("temperature"))


def vdos(v: DataFrame, dt: float | DataFrame) -> DataFrame:
    """Vibrational density of states from velocities: (system, freq, power), of unit power.

    Each atom and component is one bounded group: Hann window, real FFT, power scaled to 1; the
    groups' spectra are then summed by Spark.
    """
    long = v.select("system", "atom", "frame", F.expr("stack(3, 0, vx, 1, vy, 2, vz) AS (component, v)"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("frame")["v"].to_numpy()
        power = np.abs(np.fft.rfft((x - x.mean()) * np.hanning(len(x)))) ** 2
        total = power.sum()
        return pd.DataFrame({"system": pdf["system"].iloc[0], "k": np.arange(len(power)), "freq": np.fft.rfftfreq(len(x)), "power": power / total if total > 0 else power})

    kind = v.schema["system"].dataType.simpleString()
    parts = long.groupBy("system", "atom", "component").applyInPandas(one, f"system {kind}, k long, freq double, power double")
    out = _with_dt(parts.groupBy("system", "k", "freq").agg(F.sum("power").alias("power")), dt)
    return out.select("system", (F.col("freq") / F.col("dt")).alias("freq"), ratio("power", F.sum("power").over(Window.partitionBy("system"))).alias("power"))


def vdos_error(pred: DataFrame, true: DataFrame, tail: float = 0.999) -> DataFrame:
    """100 * min(1, W1 / sigma_true) of trapezoid masses on the merged grid.

    Both spectra end where the reference has ``tail`` of its power. No predicted power below gives 100; a reference
    without spread gives 0 if the prediction equals it, else 100. Both are written once to the shared folder, since
    the grid, its interpolation and the cut read them.
    """
    keys = ["system"]
    p, t = (written(d.select("system", F.col("freq").alias("x"), F.col("power").alias("y")), "spectra") for d in (pred, true))
    grid = merged_grid(p, t, keys)
    order, every = Window.partitionBy("system").orderBy("x"), Window.partitionBy("system")
    mass = F.greatest(F.lit(0.0), F.col("y")) * (F.coalesce(F.lead("x").over(order), F.col("x")) - F.coalesce(F.lag("x").over(order), F.col("x"))) / 2
    p, t = (interpolate(d, grid, keys).withColumn("w", mass).select("system", "x", "w") for d in (p, t))
    share = ratio(F.sum("w").over(order), F.sum("w").over(every))
    cut = t.withColumn("before", share - ratio("w", F.sum("w").over(every))).where(F.col("before") < tail) if tail < 1 else t
    cut = cut.groupBy("system").agg(F.max("x").alias("cut"))
    p, t = (d.join(cut, "system").where("x <= cut").drop("cut") for d in (p, t))
    m = t.groupBy("system").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("x")).alias("sx"))
    m = t.join(m, "system").groupBy("system").agg(F.sqrt(ratio(F.sum(F.col("w") * F.pow(F.col("x") - ratio("sx", "sw"), F.lit(2))), F.max("sw"))).alias("sigma"))
    error = F.when(F.col("w1").isNull(), 1.0).when(F.col("sigma") > 0, F.least(F.lit(1.0), F.col("w1") / F.col("sigma"))).otherwise(F.when(F.col("w1") <= 0, 0.0).otherwise(1.0))
    return wasserstein(t, p, keys).join(m, "system").select("system", (100 * error).alias("vdos_error"))


def pressure_metrics(pred: DataFrame, true: DataFrame, bins: int = 80) -> DataFrame:
    """Difference of mean pressures, W1, and the share of histograms that does not overlap: by system.

    Both tables have system and pressure. Bins are shared; constant and equal pressures give 0.
    """
    one = lambda d: d.select("system", F.col("pressure").alias("x"), F.lit(1.0).alias("w"))
    means = pred.groupBy("system").agg(F.avg("pressure").alias("mp")).join(true.groupBy("system").agg(F.avg("pressure").alias("mt")), "system")
    both = pred.select("system", "pressure", F.lit(1).alias("side")).unionByName(true.select("system", "pressure", F.lit(0).alias("side")))
    ends = both.groupBy("system").agg(F.min("pressure").alias("low"), F.max("pressure").alias("high"))
    binned = both.join(ends, "system").withColumn("bin", F.when(F.col("low") == F.col("high"), 0).otherwise(bin_number(F.col("pressure"), F.col("low"), F.col("high"), bins)))
    counts = binned.groupBy("system", "bin").agg(F.count_if(F.col("side") == 1).alias("p"), F.count_if(F.col("side") == 0).alias("t"))
    every = Window.partitionBy("system")
    gap = F.abs(ratio("p", F.sum("p").over(every)) - ratio("t", F.sum("t").over(every)))
    overlap = counts.withColumn("gap", gap).groupBy("system").agg((100 * F.sum("gap") / 2).alias("histogram_error"))
    w1 = wasserstein(one(pred), one(true), ["system"])
    return means.select("system", F.abs(F.col("mp") - F.col("mt")).alias("mean_error")).join(w1, "system").join(overlap, "system")


def energy_force_rmse(pred: DataFrame, true: DataFrame, atoms: str = "n_atoms", forces: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """RMSE of per-atom energy fluctuations (each side's mean taken off) and of force components, by system.

    Tables have system, frame, energy and n_atoms; ``forces`` are two tables of system, frame, atom, fx,
    fy, fz. Without them force_rmse is null.
    """
    mean = pred.select("system", "frame", F.col("energy").alias("p"), F.col(atoms).alias("n")).join(true.select("system", "frame", F.col("energy").alias("t")), ["system", "frame"])
    off = (F.col("p") - F.col("t")) / F.col("n")
    # the deviation of the differences is the RMSE after both means are taken off
    energy = mean.groupBy("system").agg(F.stddev_pop(off).alias("energy_rmse"))
    if forces is None:
        return energy.withColumn("force_rmse", F.lit(None).cast("double"))
    p, t = (d.select("system", "frame", "atom", *(F.col(c).alias(f"{side}_{c}") for c in ("fx", "fy", "fz"))) for d, side in zip(forces, "pt", strict=True))
    square = sum((F.pow(F.col(f"p_{c}") - F.col(f"t_{c}"), F.lit(2)) for c in ("fy", "fz")), F.pow(F.col("p_fx") - F.col("t_fx"), F.lit(2)))
    return energy.join(p.join(t, ["system", "frame", "atom"]).groupBy("system").agg(F.sqrt(F.avg(square) / 3).alias("force_rmse")), "system", "left")


def time_strides(steps: DataFrame, scale: int = 10**9) -> DataFrame:
    """Strides that bring two time steps (decimals dt_a, dt_b) onto their least common grid.

    Steps are scaled to integers, so the result is exact: (system, stride_a, stride_b). Steps that are not positive raise.
    """
    from assay.functions.scalars import _gcd

    positive = lambda c: F.when(F.col(c) > 0, (F.col(c) * scale).cast("long")).otherwise(F.raise_error(F.lit("time steps must be positive")).cast("long"))
    steps = steps.select("system", positive("dt_a").alias("a"), positive("dt_b").alias("b")).withColumn("g", _gcd(F.col("a"), F.col("b")))
    return steps.selectExpr("system", "b div g AS stride_a", "a div g AS stride_b")


def matched_counts(frames: DataFrame) -> DataFrame:
    """Usable frames on both sides for one closed interval: from n_a, n_b and the strides."""
    steps = F.least(F.expr("(n_a - 1) div stride_a"), F.expr("(n_b - 1) div stride_b"))
    return frames.select("*", (steps * F.col("stride_a") + 1).alias("use_a"), (steps * F.col("stride_b") + 1).alias("use_b"))


def rollout_problems(frames: DataFrame, expected: DataFrame, atoms: DataFrame | None = None, species: DataFrame | None = None) -> DataFrame:
    """Systems whose rollout is not whole and sound: (system, problem, frame), the first frame of each kind.

    ``frames`` has system, frame (from 0), md_step, cell and pbc; ``expected`` system, n_frames, interval, cell and pbc. There are
    exactly n_frames frames with md_step = frame * interval and the cell (to 1e-8 + 1e-5 of each number) and pbc of the reference. ``atoms``
    (system, frame, atom, species, x, y, z and, optionally, vx, vy, vz) have the species of ``species`` (system, atom, species)
    in every frame, and finite positions and velocities.
    """
    rows = frames.join(expected.select("system", "n_frames", "interval", F.col("cell").alias("__cell"), F.col("pbc").alias("__pbc")), "system")
    flat = lambda c: F.flatten(F.transform(c, lambda r: F.transform(r, lambda x: x.cast("double"))))
    near = F.forall(F.zip_with(flat(F.col("cell")), flat(F.col("__cell")), lambda a, b: F.coalesce(F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b), F.lit(False))), lambda x: x)
    tests = {
        "steps": ~F.col("md_step").eqNullSafe(F.col("frame") * F.col("interval")),
        "cell or pbc": ~F.coalesce(near & (F.col("pbc") == F.col("__pbc")), F.lit(False)),
    }
    kind = lambda d, problem: d.groupBy("system").agg(F.min("frame").cast("long").alias("frame")).select("system", F.lit(problem).alias("problem"), "frame")
    counts = frames.groupBy("system").agg(F.count("*").alias("n"), F.count_distinct("frame").alias("d"))
    counted = expected.join(counts, "system", "left").where("n IS NULL OR n <> n_frames OR d <> n")
    out = counted.select("system", F.when(F.col("n").isNull(), "missing").otherwise("frame count").alias("problem"), F.lit(None).cast("long").alias("frame"))
    for problem, test in tests.items():
        out = out.unionByName(kind(rows.where(test), problem))
    if atoms is not None:
        numbers = [c for c in ("x", "y", "z", "vx", "vy", "vz") if c in atoms.columns]
        odd = F.lit(False)
        for c in numbers:
            odd = odd | finite(F.col(c)).isNull()
        out = out.unionByName(kind(atoms.where(odd), "not finite"))
    if atoms is not None and species is not None:
        per = frames.select("system", "frame").join(species.select("system", "atom", F.col("species").alias("__species")), "system")
        both = atoms.select("system", "frame", "atom", "species").join(per, ["system", "frame", "atom"], "full_outer")
        out = out.unionByName(kind(both.where("NOT species <=> __species"), "species"))
    return out


def temperature_gate(temperatures: DataFrame, targets: DataFrame, factor: float = 3.0) -> DataFrame:
    """Systems whose temperature is not within ``factor`` of its target."""
    rows = temperatures.join(targets, "system")
    return rows.where(~F.col("temperature").between(F.col("target") / factor, F.col("target") * factor) | F.col("temperature").isNull())


def model_md_metrics(rows: DataFrame) -> DataFrame:
    """Model means over systems, missing values left out; energy and force RMSE in milli-units, only if no system lacks them.

    Hardware is kept if all systems name the same. Run time is summed, memory is the maximum; each is null if a
    system lacks it, and run time and GPU memory also where hardware is mixed or not known.
    """
    given = set(rows.columns)
    mean = lambda c: F.avg(c).alias(c)
    whole = lambda c: F.count(c) == F.count("*")
    full = lambda c: F.when(whole(c), 1000 * F.avg(c)).alias(c)
    uniform = whole("hardware") & (F.min("hardware") == F.max("hardware")) if "hardware" in given else F.lit(True)
    costs = {"run_time_sec": (F.sum, True), "max_rss_gb": (F.max, False), "max_gpu_mem_gb": (F.max, True)}
    return rows.groupBy("model_key").agg(
        *(mean(c) for c in ("rdf_error", "adf_error", "vdos_error", "pressure_mae", "pressure_wasserstein", "pressure_error") if c in given),
        *(full(c) for c in ("energy_rmse", "force_rmse") if c in given),
        *(F.when(whole(c) & (uniform if by_hardware else F.lit(True)), f(c)).alias(c) for c, (f, by_hardware) in costs.items() if c in given),
        *([F.when(uniform, F.max("hardware")).alias("hardware")] if "hardware" in given else []), F.count("*").alias("n_systems"),
    )


def time_matched(pred: DataFrame, true: DataFrame, steps: DataFrame, least: int = 4) -> tuple[DataFrame, DataFrame]:
    """Both sides cut to the same closed interval from their first frames on; steps has system, dt_a (of ``pred``) and dt_b.

    The interval is the longest multiple of the common time grid that both sides cover. Fewer than ``least`` frames
    on either side raise.
    """
    n = systems_of(pred).withColumnRenamed("frames", "n_a").join(systems_of(true).withColumnRenamed("frames", "n_b"), "system")
    steps = steps.select("system", *(F.col(c).cast("decimal(28,9)").alias(c) for c in ("dt_a", "dt_b")))
    used = matched_counts(n.join(time_strides(steps), "system"))
    enough = F.least("use_a", "use_b") >= least
    message = F.concat(F.lit("too few frames after time matching: "), F.col("system").cast("string"))
    used = used.select("system", *(F.when(enough, F.col(c)).otherwise(F.raise_error(message).cast("long")).alias(c) for c in ("use_a", "use_b")))

    def head(side: DataFrame, count: str) -> DataFrame:
        first = side.groupBy("system").agg(F.min("frame").alias("__first")).join(used.select("system", F.col(count).alias("__use")), "system")
        return side.join(first, "system").where(F.col("frame") < F.col("__first") + F.col("__use")).drop("__first", "__use")

    return head(pred, "use_a"), head(true, "use_b")


def system_metrics(pred: DataFrame, true: DataFrame, cells: tuple[float | DataFrame, float | DataFrame], steps: DataFrame, cutoff: float | DataFrame, pressures: tuple[DataFrame, DataFrame] | None = None, bins: int = 500, least: int = 4) -> DataFrame:
    """RDF, ADF and vDOS errors and three pressure metrics of each system, over the same interval of time.

    ``cells`` are those of both sides (see ``pair_distances``), ``steps`` has system, dt_a and dt_b: the time between
    frames of ``pred`` and ``true``. Both are cut by ``time_matched``; the reference's r_max serves both RDFs. ``cutoff``
    is one for all, or radii by species. ``pressures`` have system, frame and pressure and are cut alike; where a side
    lacks them pressure_mae, pressure_wasserstein and pressure_error are null. What is cut, and the distributions, are
    written once to the shared folder, since several metrics read them.
    """
    ends = lambda d: d.select("system", "frame").distinct()
    p, t = (written(side, "matched") for side in time_matched(written(pred, "sides"), written(true, "sides"), steps, least))
    dp, dt = (steps.select("system", F.col(c).cast("double").alias("dt")) for c in ("dt_a", "dt_b"))
    of = lambda cell, side: cell.join(ends(side), ["system", "frame"], "left_semi") if isinstance(cell, DataFrame) and "frame" in cell.columns else cell
    cp, ct = of(cells[0], p), of(cells[1], t)
    once = lambda d: written(d, "distributions")
    out = rdf_error(once(rdf(p, cp, bins, _radii(t, ct))), once(rdf(t, ct, bins))).join(adf_error(once(adf(p, cp, cutoff)), once(adf(t, ct, cutoff))), "system")
    out = out.join(vdos_error(vdos(velocities(p, cp, dp), dp), vdos(velocities(t, ct, dt), dt)), "system")
    names = ("pressure_mae", "pressure_wasserstein", "pressure_error")
    if pressures is None:
        return out.withColumns({c: F.lit(None).cast("double") for c in names})
    cut = (side.join(ends(of_side), ["system", "frame"], "left_semi") for side, of_side in zip(pressures, (p, t), strict=True))
    found = pressure_metrics(*cut).select("system", *(F.col(c).alias(n) for c, n in zip(("mean_error", "w1", "histogram_error"), names, strict=True)))
    return out.join(found, "system", "left")


def strip_labels(rows: DataFrame, labels: tuple[str, ...] = ("energy", "forces", "stress", "fx", "fy", "fz")) -> DataFrame:
    """A reference without its labels, to be given to those who predict them."""
    return rows.drop(*labels)


def systems_of(rows: DataFrame) -> DataFrame:
    """Systems with their numbers of frames: (system, frames)."""
    return rows.groupBy("system").agg(F.count_distinct("frame").alias("frames"))


def head_frames(rows: DataFrame, n: int) -> DataFrame:
    """The first n frames of each system, from its least frame number on."""
    first = rows.groupBy("system").agg(F.min("frame").alias("__first"))
    return rows.join(first, "system").where(F.col("frame") < F.col("__first") + n).drop("__first")


def saved_interval_gate(v: DataFrame, masses: DataFrame, targets: DataFrame, frames: int = 256, factor: float = 3.0) -> DataFrame:
    """Systems whose kinetic temperature over the first ``frames`` frames is not within ``factor`` of the target."""
    return temperature_gate(kinetic_temperature(head_frames(v, frames), masses), targets, factor)


def shape_problems(frames: DataFrame, atoms: DataFrame) -> DataFrame:
    """Systems whose frames differ in atoms, or whose cells are not 3x3: (system, problem)."""
    per = atoms.groupBy("system", "frame").agg(F.count("*").alias("n")).groupBy("system").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    uneven = per.where("lo <> hi").select("system", F.lit("atoms per frame").alias("problem"))
    square = (F.size("cell") == 3) & F.forall("cell", lambda r: F.size(r) == 3)
    return uneven.unionByName(frames.where(~F.coalesce(square, F.lit(False))).select("system", F.lit("cell shape").alias("problem")).distinct())
