"""Reduced lattices, nearest images, cell lists and time-matched systems against plain numpy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.operators import trajectories as T
from assay.operators.lattices import reduced
from assay.operators.neighbours import neighbour_counts, neighbour_pairs

REDUCED = np.array([[4.0, 0.0, 0.0], [1.5, 4.0, 0.0], [0.0, 0.5, 5.0]])
SKEWED = np.array([[1, 0, 0], [7, 1, 0], [-11, 4, 1]]) @ REDUCED
THIN = np.array([[2.0, 0.0, 0.0], [0.7, 9.0, 0.0], [0.3, 4.0, 11.0]])
CELLS = {"reduced": REDUCED, "skewed": SKEWED, "thin": THIN, "left": SKEWED[[1, 0, 2]]}
ATOMS = "system string, frame int, atom int, x double, y double, z double, species string"


def frames(spark, n=14, n_frames=2):
    """Positions far outside of their cells, too."""
    rng = np.random.default_rng(1)
    rows = []
    for s, cell in CELLS.items():
        for f in range(n_frames):
            frac = rng.random((n, 3)) * 5 - 2
            frac[1] = frac[0] + [1, 0, -1]  # the same place in another cell
            rows += [(s, f, i, *map(float, x @ cell), "ab"[i % 2]) for i, x in enumerate(frac)]
    cells = spark.createDataFrame([(s, c.tolist()) for s, c in CELLS.items()], "system string, cell array<array<double>>")
    return rows, spark.createDataFrame(rows, ATOMS), cells


def images(cell, reach):
    """Lattice vectors up to a length, from a basis that is known to be short."""
    short = THIN if np.allclose(abs(np.linalg.det(cell)), abs(np.linalg.det(THIN))) else REDUCED
    n = [int(reach / h) + 2 for h in 1 / np.linalg.norm(np.linalg.inv(short), axis=0)]
    return np.array([np.array(m) @ short for m in itertools.product(*(range(-k, k + 1) for k in n))])


def by_frame(rows):
    out = {}
    for s, f, i, *xyz, _ in rows:
        out.setdefault((s, f), {})[i] = np.array(xyz)
    return out


def wrap(d, cell):
    short = THIN if np.allclose(abs(np.linalg.det(cell)), abs(np.linalg.det(THIN))) else REDUCED
    return d - np.rint(d @ np.linalg.inv(short)) @ short


def test_reduction_ends_with_the_shortest_vectors(spark):
    rng = np.random.default_rng(2)
    cells = []
    for k in range(60):
        basis = rng.normal(size=(3, 3)) * rng.uniform(0.5, 8, (3, 1))
        change = np.eye(3, dtype=int)
        for _ in range(12):
            i, j = rng.permutation(3)[:2]
            change[i] += rng.integers(-3, 4) * change[j]
        cells.append((k, (change @ basis).tolist(), [True] * 3))
    df = spark.createDataFrame(cells, "k int, cell array<array<double>>, pbc array<boolean>")
    for r in df.select("k", "cell", reduced().alias("r")).collect():
        v = np.array(r.r.vectors)
        vectors = np.array([np.array(m) @ v for m in itertools.product(range(-4, 5), repeat=3) if any(m)])
        found = []
        for i in np.argsort(np.linalg.norm(vectors, axis=1), kind="stable"):  # successive minima
            if np.linalg.matrix_rank(np.array([*found, vectors[i]]), tol=1e-6) > len(found):
                found.append(vectors[i])
            if len(found) == 3:
                break
        assert np.allclose(np.linalg.norm(v, axis=1), np.linalg.norm(found, axis=1), rtol=1e-9), r.k
        m = v @ np.linalg.inv(np.array(r.cell))
        assert np.allclose(m, np.rint(m), atol=1e-5) and abs(abs(np.linalg.det(m)) - 1) < 1e-4


def test_image_radius_of_partly_periodic_cells(spark):
    flags = [("all", [True] * 3, 4.0), ("two", [True, True, False], 4.0), ("last", [False, False, True], float(np.linalg.norm(SKEWED[2]))), ("none", [False] * 3, 4.0)]
    rows = [(s, SKEWED.tolist(), f) for s, f, _ in flags]
    got = {r.system: r.radius for r in T.image_radius(spark.createDataFrame(rows, "system string, cell array<array<double>>, pbc array<boolean>")).collect()}
    assert got == {s: pytest.approx(w / 2) for s, _, w in flags}


def test_pair_distances_of_unreduced_cells(spark):
    rows, atoms, cells = frames(spark)
    got = {(r.system, r.frame, r.i, r.j): r.r for r in T.pair_distances(atoms, cells).collect()}
    n = 0
    for (s, f), at in by_frame(rows).items():
        shifts = images(CELLS[s], 12)
        for i, j in itertools.combinations(at, 2):
            want = np.linalg.norm(wrap(at[j] - at[i], CELLS[s]) + shifts, axis=1).min()
            assert got[s, f, i, j] == pytest.approx(want, abs=1e-9)
            n += 1
    assert n == len(got)


@pytest.mark.parametrize("cutoff", [0.7, 1.9, 6.5])
def test_cell_lists_find_every_image(spark, cutoff):
    rows, atoms, cells = frames(spark, 9, 1)
    pairs = neighbour_pairs(atoms, cells, cutoff, also=("species",)).collect()
    got = sorted((r.system, r.i, r.j, round(r.r, 7)) for r in pairs)
    want = []
    for (s, _), at in by_frame(rows).items():
        shifts = images(CELLS[s], cutoff + 12)
        for i in at:
            for j in at:
                if i > j:
                    continue
                r = np.linalg.norm(wrap(at[j] - at[i], CELLS[s]) + shifts, axis=1)
                found = sorted(r[(r <= cutoff) & ((r > 1e-9) | (i != j))])
                want += [(s, i, j, round(float(x), 7)) for x in (found if i != j else found[::2])]
    assert got == sorted(want)
    assert all((r.species1, r.species2) == ("ab"[r.i % 2], "ab"[r.j % 2]) and r.r == pytest.approx(math.hypot(r.dx, r.dy, r.dz)) for r in pairs)
    both = neighbour_pairs(atoms, cells, cutoff, directed=True)
    assert both.count() == 2 * len(got)
    counts = neighbour_counts(both).agg(F.sum("neighbours"), F.min("nearest")).first()
    assert counts[0] == 2 * len(got) and counts[1] == pytest.approx(min(r.r for r in pairs))


def test_cell_lists_agree_with_all_pairs_and_do_not_join_them(spark):
    _, atoms, cells = frames(spark)
    cut = lambda d: sorted((r.system, r.frame, r.i, r.j, round(r.r, 9)) for r in d.collect())
    near = T.pair_distances(atoms, cells, cutoff=0.99)
    assert cut(near) == cut(T.pair_distances(atoms, cells).where("r < 0.99"))
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x and "atom" in x]
    assert all("__c0" in x for x in joins if "frame" in x)


def test_cell_lists_of_open_directions_nulls_and_no_rows(spark):
    rows = [("s", 0, 0, 0.0, 0.0, 0.0, "a"), ("s", 0, 1, 9.5, 0.0, 0.0, "a"), ("s", 0, 2, 0.0, 9.5, 0.0, "a"), ("s", 0, 3, None, 0.0, 0.0, "a"), ("t", 0, 0, 0.0, 0.0, 0.0, "a")]
    atoms = spark.createDataFrame(rows, ATOMS)
    cells = spark.createDataFrame([("s", np.diag([10.0, 10.0, 10.0]).tolist(), [True, False, False])], "system string, cell array<array<double>>, pbc array<boolean>")
    got = {(r.i, r.j): (round(r.r, 9), round(r.dx, 9)) for r in neighbour_pairs(atoms, cells, 2.0).collect()}
    assert got == {(0, 1): (0.5, -0.5)}
    assert neighbour_pairs(atoms.limit(0), cells, 2.0).count() == 0


def test_rdf_with_a_short_reach_and_bonds_of_species(spark):
    _, atoms, cells = frames(spark)
    g = T.rdf(atoms, cells, 20, 0.8).orderBy("system", "bin").collect()
    n = T.pair_distances(atoms, cells).where("r <= 0.8").groupBy("system").count().collect()
    volume = {s: abs(np.linalg.det(c)) for s, c in CELLS.items()}
    for r in n:
        total = sum(x.g * 14 * 14 / 2 * 2 / volume[r.system] * 4 / 3 * math.pi * (((x.bin + 1) * 0.04) ** 3 - (x.bin * 0.04) ** 3) for x in g if x.system == r.system)
        assert total == pytest.approx(r["count"])
    with pytest.raises(Exception, match="beyond half"):
        T.rdf(atoms, cells, 20, 1.1).collect()
    radii = spark.createDataFrame([("a", 0.3), ("b", 0.5)], "species string, radius double")
    bonds = T.bonds_within(atoms, cells, radii, 1.25)
    want = T.pair_distances(atoms, cells, directed=True, also=("species",)).where("r > 1e-12 AND r <= 1.25 * (CASE species1 WHEN 'a' THEN 0.3 ELSE 0.5 END + CASE species2 WHEN 'a' THEN 0.3 ELSE 0.5 END)")
    want = want.join(T.image_radius(cells), "system").where("r <= radius")
    key = lambda d: sorted((r.system, r.frame, r.i, r.j, round(r.r, 9)) for r in d.collect())
    assert key(bonds) == key(want) and len(key(bonds)) > 10


def test_systems_are_matched_in_time(spark):
    rng = np.random.default_rng(4)
    def walk(n, dt, cell):
        # the same motion, seen every dt
        t = np.arange(n) * dt
        start = np.random.default_rng(9).random((8, 3)) * 6
        return [("s", f + 3, i, *map(float, (start[i] + 0.4 * np.sin(0.9 * t[f] + i)) % 6.0), "a") for f in range(n) for i in range(8)]
    cell = spark.createDataFrame([("s", np.diag([6.0] * 3).tolist())], "system string, cell array<array<double>>")
    fine, coarse = (spark.createDataFrame(walk(n, dt, 6.0), ATOMS) for n, dt in ((64, 0.5), (40, 0.75)))
    steps = spark.createDataFrame([("s", "0.5", "0.75")], "system string, dt_a string, dt_b string")
    p, t = T.time_matched(fine, coarse, steps)
    # the common grid is 1.5: 21 steps of it fit into 31.5, and 19 into 29.25
    assert (p.select("frame").distinct().count(), t.select("frame").distinct().count()) == (19 * 3 + 1, 19 * 2 + 1)
    assert p.agg(F.min("frame")).first()[0] == 3
    pressure = lambda d, off: d.select("system", "frame").distinct().withColumn("pressure", F.col("frame") % 4 + off)
    got = T.system_metrics(fine, coarse, (cell, cell), steps, 2.0, (pressure(fine, F.lit(0.0)), pressure(coarse, F.lit(1.0))), bins=40).first()
    want_p, want_t = pressure(p, F.lit(0.0)), pressure(t, F.lit(1.0))
    r = T.pressure_metrics(want_p, want_t).first()
    assert (got.pressure_mae, got.pressure_wasserstein, got.pressure_error) == pytest.approx((r.mean_error, r.w1, r.histogram_error))
    assert got.rdf_error == pytest.approx(T.rdf_error(T.rdf(p, 6.0, 40), T.rdf(t, 6.0, 40)).first().rdf_error)
    assert 0 <= got.vdos_error <= 100 and 0 <= got.adf_error <= 100
    same = T.system_metrics(fine, fine, (cell, 6.0), spark.createDataFrame([("s", 0.5, 0.5)], "system string, dt_a double, dt_b double"), 2.0, bins=40).first()
    assert (round(same.rdf_error, 9), round(same.adf_error, 9), round(same.vdos_error, 9), same.pressure_mae) == (0, 0, 0, None)
    with pytest.raises(Exception, match="too few frames"):
        T.system_metrics(fine, coarse, (6.0, 6.0), spark.createDataFrame([("s", "0.5", "13")], "system string, dt_a string, dt_b string"), 2.0).collect()
    # a prediction whose cell is too small for the reference's reach
    small = spark.createDataFrame([("s", np.diag([5.0] * 3).tolist())], "system string, cell array<array<double>>")
    with pytest.raises(Exception, match="beyond half"):
        T.system_metrics(fine, fine, (small, cell), spark.createDataFrame([("s", 0.5, 0.5)], "system string, dt_a double, dt_b double"), 2.0).collect()


def test_model_means_need_whole_costs(spark):
    schema = "model_key string, rdf_error double, energy_rmse double, run_time_sec double, max_rss_gb double, max_gpu_mem_gb double, hardware string"
    rows = [
        ("full", 1.0, 0.001, 10.0, 2.0, 5.0, "h"), ("full", 3.0, 0.003, 20.0, 4.0, 3.0, "h"),
        ("mixed", 1.0, 0.001, 10.0, 2.0, 5.0, "h"), ("mixed", None, None, 20.0, 4.0, 3.0, "g"),
        ("unknown", 1.0, 0.001, 10.0, 2.0, 5.0, "h"), ("unknown", 3.0, 0.003, 20.0, None, 3.0, None),
        ("part", 1.0, 0.001, None, 2.0, 5.0, "h"), ("part", 3.0, 0.003, 20.0, 4.0, None, "h"),
    ]
    got = {r.model_key: (r.rdf_error, r.energy_rmse, r.run_time_sec, r.max_rss_gb, r.max_gpu_mem_gb, r.hardware, r.n_systems) for r in T.model_md_metrics(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        "full": (2.0, 2.0, 30.0, 4.0, 5.0, "h", 2), "mixed": (1.0, None, None, 4.0, None, None, 2),
        "unknown": (2.0, 2.0, None, None, None, None, 2), "part": (2.0, 2.0, None, 4.0, None, "h", 2),
    }
    bare = spark.createDataFrame([("m", 1.0, 5.0), ("m", 2.0, 6.0)], "model_key string, vdos_error double, run_time_sec double")
    assert T.model_md_metrics(bare).first().asDict() == {"model_key": "m", "vdos_error": 1.5, "run_time_sec": 11.0, "n_systems": 2}
