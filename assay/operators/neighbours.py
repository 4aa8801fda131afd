"""Neighbours within a cutoff, by cell lists: a join on grid cells instead of one of all pairs.

Each frame's cell is cut into grid cells no thinner than the cutoff. An atom is at home in one grid cell,
and is sent to the cells around it, across periodic faces with the lattice vectors that this takes. The
join is on system, frame and grid cell, so a frame of any size makes as many pairs as its atoms have
neighbours at hand, and no task holds a frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.operators import lattices
from assay.sources.shared import written

_XYZ = ("x", "y", "z")


def with_lattice(cells: DataFrame) -> DataFrame:
    """Cells with the reduced ``lattice`` and its ``inverse``; all vectors are periodic where there is no column pbc.

    Written once: a row per cell, which what follows refers to many times.
    """
    if "pbc" not in cells.columns:
        cells = cells.withColumn("pbc", F.array(*[F.lit(True)] * 3))
    return written(written(cells.withColumn("lattice", lattices.reduced()), "lattices").withColumn("inverse", lattices.reciprocal()), "lattices")


def cubic(atoms: DataFrame, edge: float, keys: list[str]) -> DataFrame:
    """One cubic cell for every system: (system, cell)."""
    cell = F.array(*(F.array(*(F.lit(float(edge) if i == j else 0.0) for j in range(3))) for i in range(3)))
    return atoms.select(keys[0]).distinct().withColumn("cell", cell)


def neighbour_pairs(atoms: DataFrame, cells: DataFrame, cutoff: float | str, keys: list[str] | None = None, directed: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of atoms, and of an atom and another's periodic image, within the cutoff: (keys, i, j, dx, dy, dz, r).

    ``atoms`` has the keys (system and frame by default), atom, x, y and z; ``cells`` the first of the keys or all, cell
    (3x3) and, optionally, pbc. ``cutoff`` is a number, or the name of a column of ``cells``. Cells need not be reduced, nor positions wrapped.
    Up to half the shortest lattice vector each pair comes once, as under the minimum image; beyond it every image counts.
    Unless ``directed``, i < j (or an atom and its own image, one of two). Columns ``also`` come twice, with 1 and 2 after
    their names. Atoms without a cell or a position give no pairs.
    """
    keys = keys or ["system", "frame"]
    on = [k for k in keys if k in cells.columns]
    most = F.lit(float(cutoff)) if not isinstance(cutoff, str) else F.col(cutoff).cast("double")
    cells = with_lattice(cells).select(*on, "lattice", "inverse", most.alias("__most"))
    # distance of the faces along each vector is one over the length of the inverse vector
    height = "transform(inverse, v -> 1 / sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]))"
    cells = cells.withColumn("__n", F.expr(f"transform({height}, h -> greatest(1L, least(1048576L, bigint(floor(h / __most)))))"))
    cells = cells.withColumn("__reach", F.expr(f"zip_with({height}, __n, (h, n) -> bigint(ceil(__most / (h / n))))"))

    at = lambda i: f"(inverse[{i}][0] * x + inverse[{i}][1] * y + inverse[{i}][2] * z)"
    rows = atoms.select(*keys, "atom", *_XYZ, *also).where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").join(cells, on)
    # places that fall on a face by rounding belong to the last grid cell before it
    home = lambda i: f"CASE WHEN lattice.periodic > {i} THEN least(__n[{i}] - 1, bigint(floor(({at(i)} - floor({at(i)})) * __n[{i}]))) ELSE bigint(floor({at(i)} * __n[{i}])) END"
    whole = lambda i: f"CASE WHEN lattice.periodic > {i} THEN floor({at(i)}) ELSE 0 END"
    rows = rows.withColumns({"__g": F.expr(f"array({', '.join(map(home, range(3)))})"), "__w": F.expr(f"array({', '.join(map(whole, range(3)))})")})
    inside = lambda c, i: f"{c} - __w[0] * lattice.vectors[0][{i}] - __w[1] * lattice.vectors[1][{i}] - __w[2] * lattice.vectors[2][{i}]"
    rows = rows.withColumns({c: F.expr(inside(c, i)) for i, c in enumerate(_XYZ)})

    b = rows.select(*keys, F.expr("__g[0]").alias("__c0"), F.expr("__g[1]").alias("__c1"), F.expr("__g[2]").alias("__c2"), F.col("atom").alias("j"), *(F.col(c).alias(f"{c}2") for c in (*_XYZ, *also)))
    step = lambda i: f"transform(sequence(__g[{i}] - __reach[{i}], __g[{i}] + __reach[{i}]), t -> CASE WHEN lattice.periodic > {i} THEN struct(pmod(t, __n[{i}]) AS c, bigint(floor(t / __n[{i}])) AS m) ELSE struct(t AS c, 0L AS m) END)"
    halo = rows
    for i in range(3):
        halo = halo.withColumn(f"__t{i}", F.explode(F.expr(step(i))))
    moved = lambda c, i: f"{c} - __t0.m * lattice.vectors[0][{i}] - __t1.m * lattice.vectors[1][{i}] - __t2.m * lattice.vectors[2][{i}]"
    a = halo.select(
        *keys, *(F.col(f"__t{i}.c").alias(f"__c{i}") for i in range(3)), F.col("atom").alias("i"), F.struct(*(F.col(f"__t{i}.m").alias(f"m{i}") for i in range(3))).alias("__m"), "__most",
        *(F.expr(moved(c, i)).alias(f"{c}1") for i, c in enumerate(_XYZ)), *(F.col(c).alias(f"{c}1") for c in also),
    )
    pairs = a.join(b, [*keys, "__c0", "__c1", "__c2"])
    none = F.struct(*(F.lit(0).cast("long").alias(f"m{i}") for i in range(3)))
    itself = (F.col("__m") != none) if directed else (F.col("__m") > none)
    order = (F.col("i") != F.col("j")) if directed else (F.col("i") < F.col("j"))
    pairs = pairs.where(order | ((F.col("i") == F.col("j")) & itself))
    pairs = pairs.withColumns({f"d{c}": F.col(f"{c}2") - F.col(f"{c}1") for c in _XYZ})
    pairs = pairs.withColumn("r", F.expr("sqrt(dx * dx + dy * dy + dz * dz)")).where("r <= __most")
    return pairs.select(*keys, "i", "j", "dx", "dy", "dz", "r", *(f"{c}{n}" for c in also for n in (1, 2)))


def neighbour_counts(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Number of neighbours and nearest distance of each atom of directed pairs: (keys, i, neighbours, nearest)."""
    return pairs.groupBy(*(keys or ["system", "frame"]), "i").agg(F.count("*").alias("neighbours"), F.min("r").alias("nearest"))
