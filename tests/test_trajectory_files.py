"""Extended-XYZ files read in blocks, dense ordinals and the frame store."""

import random

import pytest
from pyspark.sql import functions as F

from assay.sources import extxyz as X
from assay.sources import readers as S

HEAD = 'Lattice="5 0 0 0 6 0 0.5 0 7" Properties={layout} pbc="{pbc}"{extra}'


def text(frames, layout="species:S:1:pos:R:3", pbc="T T F", extra=lambda f: f" energy={-f / 4}", atoms=None, n=3):
    out = []
    for f in range(frames):
        rows = atoms(f) if atoms else [f"{'HOC'[i]} {i + f / 8} {f} -1e-3" for i in range(n)]
        out += [f"{len(rows)}", HEAD.format(layout=layout, pbc=pbc, extra=extra(f)), *rows]
    return "\n".join(out) + "\n"


@pytest.fixture
def small_blocks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0b")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_file_is_read_by_many_tasks(spark, tmp_path, small_blocks):
    layout = "id:I:1:species:S:1:forces:R:3:pos:R:3"
    atoms = lambda f: [f"{i} {'HOC'[i]} {f} 0 {i}   {i + f / 8} {f} -0.001" for i in range(3)]
    extra = lambda f: f' free_energy=99 energy={-f / 4} stress="1 {f} 3 4 5 6 7 8 9" md_step={f * 10}'
    (tmp_path / "a.extxyz").write_text(text(60, layout, extra=extra, atoms=atoms) + "\n  \n\n")
    (tmp_path / "b.xyz").write_text(text(45, extra=lambda f: f" energy={f}" + (f" md_step={f}" if f != 7 else "")))
    lines = X.numbered_lines(spark, f"{tmp_path}/*xyz")
    assert lines.rdd.getNumPartitions() > 8 and lines.where("system = 'a'").select(F.spark_partition_id()).distinct().count() > 5
    want = (tmp_path / "a.extxyz").read_text().rstrip().split("\n")
    assert [r.value for r in lines.where("system = 'a'").orderBy("line").collect()] == want
    frames, sites = X.read_trajectories(spark, f"{tmp_path}/*xyz")
    a = frames.where("system = 'a'").orderBy("frame").collect()
    assert [(r.frame, r.energy, r.md_step) for r in a] == [(f, -f / 4, f * 10) for f in range(60)]
    assert a[5].stress == [1, 5, 9, 8, 7, 4] and a[5].lattice == [5, 0, 0, 0, 6, 0, 0.5, 0, 7] and a[5].pbc == [True, True, False]
    b = frames.where("system = 'b'").orderBy("frame").collect()
    assert [(r.energy, r.md_step, r.stress) for r in b] == [(f, None, None) for f in range(45)]  # one step is missing
    got = sorted((r.system, r.frame, r.atom, r.species, r.x, r.y, r.z, r.fx, r.fz) for r in sites.collect())
    assert got == sorted([("a", f, i, "HOC"[i], i + f / 8, f, -1e-3, f, i) for f in range(60) for i in range(3)] + [("b", f, i, "HOC"[i], i + f / 8, f, -1e-3, None, None) for f in range(45) for i in range(3)], key=lambda r: r[:3])


BROKEN = {
    "frames of unequal length": text(4) + "H 0 0 0\n",
    "atom count changes": text(4).replace("\n3\n", "\n2\n", 1),
    "without species or pos": text(3, "species:S:1:place:R:3"),
    "frame without lattice": text(3).replace("Lattice", "Lattices", 1),
    "stress without nine": text(3, extra=lambda f: ' stress="1 2 3"'),
    "energy in some": text(3, extra=lambda f: " energy=1" if f else ""),
    "stress in some": text(3, extra=lambda f: ' stress="1 2 3 4 5 6 7 8 9"' if f == 1 else ""),
    "energy that is no number": text(3, extra=lambda f: " energy=lots"),
    "Properties differ": text(3) + text(1, "species:S:1:pos:R:3:tag:I:1", atoms=lambda f: [f"{e} 0 0 0 1" for e in "HOC"]),
    "pbc differs": text(3) + text(1, pbc="T T T"),
    "species differ": text(3) + text(1, atoms=lambda f: [f"{e} 0 0 0" for e in "OHC"]),
    "not complete": text(3).replace("-1e-3", "", 1),
    "Properties without": "3\nno fields here\nH 0 0 0\nO 0 0 0\nC 0 0 0\n",
}


@pytest.mark.parametrize("message", BROKEN)
def test_files_that_are_no_trajectories_raise(spark, tmp_path, message):
    (tmp_path / "bad.extxyz").write_text(BROKEN[message])
    with pytest.raises(ValueError, match=message):
        X.read_trajectories(spark, f"{tmp_path}/bad.extxyz")


def test_files_by_name_and_number_and_the_store(spark, tmp_path):
    for name in ("w1", "w2", "x1", "w3"):
        (tmp_path / f"{name}.extxyz").write_text(text(5))
    frames, atoms = S.read_frames(spark, f"{tmp_path}/*.extxyz", r"^w", 2)
    assert {r.system for r in frames.collect()} == {"w1", "w2"}
    X.write_store(atoms, f"{tmp_path}/store")
    got = X.read_store(spark, f"{tmp_path}/store", 1, 2)
    assert got.count() == 2 * 2 * 3 and got.columns[-1] == "system"
    spark.createDataFrame([(0,)], "version int").write.mode("overwrite").parquet(f"{tmp_path}/store/version")
    with pytest.raises(ValueError, match="schema 0"):
        X.read_store(spark, f"{tmp_path}/store")


def test_ordinals_have_no_gaps(spark, tmp_path, small_blocks):
    rng = random.Random(3)
    for f in range(3):
        (tmp_path / f"{f}.csv").write_text("material_id,v\n" + "".join(f"{f}-{i},{'x' * rng.randint(0, 40)}\n" for i in range(150)))
    rows = S.read_summary(spark, f"{tmp_path}/*.csv", "material_id string, v string")
    assert rows.rdd.getNumPartitions() > 6
    assert [r.material_id for r in rows.orderBy("ordinal").collect()] == [f"{f}-{i}" for f in range(3) for i in range(150)]
    assert rows.agg(F.min("ordinal"), F.max("ordinal"), F.count_distinct("ordinal")).first() == (0, 449, 450)
