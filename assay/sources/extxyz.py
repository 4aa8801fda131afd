"""Extended-XYZ trajectories of any size as long tables.

A file is read by as many tasks as it has blocks: line numbers come from counts per block, and frame and
place in it from the number of atoms that the first line gives. Comment lines become frames, the others atoms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.operators.gates import require_empty
from assay.sources.places import blocks, join_small, marked
from assay.sources.shared import written


def matching_files(spark: SparkSession, pattern: str, name_filter: str | None = None, limit: int | None = None) -> list[str]:
    """Paths of a pattern in order, those whose name matches a regular expression, at most ``limit`` of them."""
    import re

    files = sorted(spark.read.text(pattern).inputFiles())
    files = [f for f in files if name_filter is None or re.search(name_filter, f.rsplit("/", 1)[-1])]
    return files[:limit]


def _field(pattern: str, default: str | None = None) -> Column:
    """A capture of the comment line; null (or the default) where there is none."""
    found = F.regexp_extract("value", pattern, 1)
    return F.when(found == "", F.lit(default)).otherwise(found)


def _numbers(text: Column) -> Column:
    return F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.try_cast("double"))


#: Where a named property starts among an atom line's columns; null if it is not there.
_START = """
get(get(transform(array(split(regexp_extract({header}, r'Properties=(\\S+)', 1), ':')), t -> filter(
  transform(sequence(0, greatest(size(t) div 3 - 1, 0)), i -> struct(get(t, 3 * i) AS name,
    aggregate(filter(sequence(0, size(t) div 3), j -> j < i), 0, (s, j) -> s + coalesce(try_cast(get(t, 3 * j + 2) AS int), 0)) AS start)),
  p -> p.name = '{name}')), 0), 0).start"""


#: The name of a file, without its extensions.
NAME = r"([^/]+?)(\.extxyz|\.xyz)?(\.gz|\.bz2)?$"


def numbered_lines(spark: SparkSession, paths: str | list[str], name: str = NAME) -> DataFrame:
    """Lines with their file's system, stride and layout: system, line, value, n, species_at, pos_at, forces_at.

    The system is the first group of the expression ``name`` in the file's path, and has to tell files apart. Trailing blank
    lines of a file are left out.
    """
    scan = marked(spark.read.text(paths))
    filled = F.trim("value") != ""
    per = blocks(
        scan, True, __line=F.min_by("value", "__id"), __header=F.min_by("value", F.when(F.col("value").contains("="), F.col("__id"))), __last=F.max(F.when(filled, F.col("__id")))
    )
    file = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a file's blocks
    per = per.withColumns({
        "n": F.get(F.split(F.trim(F.first("__line").over(file)), r"\s+"), F.lit(0)).try_cast("int"),
        "__header": F.first("__header", ignorenulls=True).over(file),
        "lines": F.max(F.when(F.col("__last").isNotNull(), F.col("__before") + F.col("__last") - F.col("__first") + 1)).over(file),
    })
    per = per.withColumns({f"{name}_at": F.expr(_START.format(header="__header", name=name)) for name in ("species", "pos", "forces")})
    per = written(per.select("__file", "__block", "__first", "__before", "n", "lines", "species_at", "pos_at", "forces_at"), "trajectory-blocks")
    out = join_small(scan, per, ["__file", "__block"]).withColumn("line", F.col("__id") - F.col("__first") + F.col("__before"))
    system = F.regexp_extract("__file", name, 1).alias("system")
    return out.where("line < lines").select(system, "line", "value", "n", "lines", "species_at", "pos_at", "forces_at")


def trajectory_tables(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts (system, frame, count), frames and atoms of numbered lines, by line div (n + 2) and line % (n + 2)."""
    rows = lines.withColumns({"frame": F.expr("int(line div (n + 2))"), "k": F.expr("int(line % (n + 2))")})
    count = F.get(F.split(F.trim("value"), r"\s+"), F.lit(0)).try_cast("int")
    counts = rows.where("k = 0").select("system", "frame", "n", "lines", count.alias("count"), "species_at", "pos_at")
    frames = rows.where("k = 1").select(
        "system", "frame", _numbers(_field(r'Lattice="([^"]*)"')).alias("lattice"), _field(r'pbc="([^"]*)"', "T T T").alias("pbc"),
        _field(r"(?<!\w)energy=(\S+)").alias("energy"), _numbers(_field(r'\bstress="([^"]*)"')).alias("stress"),
        _field(r"\bmd_step=(\S+)").try_cast("double").cast("long").alias("md_step"), _field(r"Properties=(\S+)", "").alias("properties"),
    )
    part = F.split(F.trim("value"), r"\s+")
    number = lambda at, i: F.get(F.col("parts"), F.col(at) + i).try_cast("double")
    atoms = rows.where("k > 1").withColumn("parts", part)
    atoms = atoms.select(
        "system", "frame", (F.col("k") - 2).alias("atom"), F.get("parts", F.col("species_at")).alias("species"), *(number("pos_at", i).alias(c) for i, c in enumerate("xyz")),
        *(number("forces_at", i).alias(f"f{c}") for i, c in enumerate("xyz")), F.col("forces_at").isNotNull().alias("has_forces"),
    )
    return counts, frames, atoms


def trajectory_problems(counts: DataFrame, frames: DataFrame, atoms: DataFrame) -> DataFrame:
    """What keeps files from being trajectories: (system, problem, frame), the first frame of each kind.

    All frames of a file have the atoms, species, columns and pbc of its first; species and pos are given; each has
    a lattice of nine numbers; energy and stress are there for all frames or none; values are numbers.
    """

    def kind(rows: DataFrame, test: str, problem: str) -> DataFrame:
        return rows.where(test).groupBy("system").agg(F.min("frame").alias("frame")).select("system", F.lit(problem).alias("problem"), "frame")

    whole = counts.where("frame = 0")
    found = [
        kind(counts, "count IS NULL OR count <> n", "atom count changes between frames"),
        kind(whole, "n IS NULL OR lines % (n + 2) <> 0", "frames of unequal length"),
        kind(whole, "species_at IS NULL OR pos_at IS NULL", "Properties without species or pos"),
        kind(frames, "lattice IS NULL OR size(lattice) <> 9 OR exists(lattice, x -> x IS NULL)", "frame without lattice"),
        kind(frames, "stress IS NOT NULL AND (size(stress) <> 9 OR exists(stress, x -> x IS NULL))", "stress without nine numbers"),
        kind(frames, "energy IS NOT NULL AND try_cast(energy AS double) IS NULL", "energy that is no number"),
        kind(atoms, "x IS NULL OR y IS NULL OR z IS NULL OR species IS NULL OR (has_forces AND (fx IS NULL OR fy IS NULL OR fz IS NULL))", "atom line that is not complete"),
    ]
    per = frames.groupBy("system").agg(
        F.count("*").alias("n"), F.count("energy").alias("e"), F.count("stress").alias("s"), F.count_distinct("properties").alias("p"), F.count_distinct("pbc").alias("b"),
        F.min(F.when(F.col("energy").isNull(), F.col("frame"))).alias("no_energy"), F.min(F.when(F.col("stress").isNull(), F.col("frame"))).alias("no_stress"),
    )
    for test, problem, frame in (("e NOT IN (0, n)", "energy in some frames only", "no_energy"), ("s NOT IN (0, n)", "stress in some frames only", "no_stress"), ("p > 1", "Properties differ between frames", None), ("b > 1", "pbc differs between frames", None)):
        found.append(per.where(test).select("system", F.lit(problem).alias("problem"), (F.col(frame) if frame else F.lit(None).cast("int")).alias("frame")))
    kinds = atoms.groupBy("system", "atom").agg(F.min("species").alias("a"), F.max("species").alias("b")).where("a <> b")
    found.append(kinds.select("system", F.lit("species differ between frames").alias("problem"), F.lit(None).cast("int").alias("frame")).distinct())
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def read_trajectories(spark: SparkSession, paths: str | list[str], strict: bool = True, name: str = NAME) -> tuple[DataFrame, DataFrame]:
    """Frames and atoms of extended-XYZ files, one file per system, each read by several tasks if it is large.

    Frames: system, frame, lattice (nine numbers), pbc (three flags), energy, stress (xx, yy, zz, yz, xz, xy) and
    md_step, null in all frames of a file where one lacks it. Atoms: system, frame, atom, species, x, y, z, and fx, fy, fz,
    null where the file has no forces. ``strict`` raises on ``trajectory_problems``; without it values that are no numbers are null.
    A file that is compressed as a whole is read by one task.
    """
    counts, frames, atoms = trajectory_tables(numbered_lines(spark, paths, name))
    if strict:
        require_empty(trajectory_problems(counts, frames, atoms), "trajectory files")
    stepped = written(frames.groupBy("system").agg((F.count("md_step") == F.count("*")).alias("stepped")), "trajectory-steps")
    frames = join_small(frames, stepped, ["system"])
    voigt = F.when(F.col("stress").isNotNull(), F.array(*(F.get("stress", F.lit(i)) for i in (0, 4, 8, 7, 6, 3))))
    flags = F.transform(F.split(F.trim("pbc"), r"\s+"), lambda x: F.lower(x).startswith("t"))
    frames = frames.select("system", "frame", "lattice", flags.alias("pbc"), F.col("energy").try_cast("double").alias("energy"), voigt.alias("stress"), F.when(F.col("stepped"), F.col("md_step")).alias("md_step"))
    return frames, atoms.drop("has_forces")


def frame_lines(frames: DataFrame, atoms: DataFrame, part: str = "part") -> DataFrame:
    """Extended-XYZ lines of frames (system, part, frame, lattice, energy) and their atoms: (system, part, frame, k, value).

    Positions and, where there are columns fx, fy and fz, forces are written with all their digits.
    """
    forces = "fx" in atoms.columns
    layout = "species:S:1:pos:R:3" + (":forces:R:3" if forces else "")
    counts = atoms.groupBy("system", part, "frame").agg(F.count("*").cast("string").alias("value")).withColumn("k", F.lit(0).cast("long"))
    lattice = F.array_join(F.transform("lattice", lambda x: x.cast("string")), " ")
    extra = [F.concat(F.lit(f" {c}="), F.col(c).cast("string")) for c in ("energy", "md_step") if c in frames.columns]
    comment = F.concat(F.lit('Lattice="'), lattice, F.lit(f'" Properties={layout} pbc="T T T"'), *extra)
    comments = frames.select("system", part, "frame", comment.alias("value"), F.lit(1).cast("long").alias("k"))
    names = ["x", "y", "z", *(["fx", "fy", "fz"] if forces else [])]
    body = atoms.select("system", part, "frame", F.concat_ws(" ", "species", *(F.col(c).cast("string") for c in names)).alias("value"), (F.col("atom") + 2).cast("long").alias("k"))
    return counts.unionByName(comments).unionByName(body)


def write_trajectories(lines: DataFrame, path: str, part: str = "part") -> None:
    """One text file per system and part; parts bound what a file, and the task that writes it, holds."""
    name = F.concat_ws("-", F.col("system").cast("string"), F.col(part).cast("string"))
    rows = lines.select(name.alias("name"), "frame", "k", "value").repartition("name").sortWithinPartitions("name", "frame", "k")
    rows.select("name", "value").write.partitionBy("name").text(path)


SCHEMA_VERSION = 1


def write_store(rows: DataFrame, path: str) -> None:
    """Frames or atoms as Parquet by system, sorted by frame, with the version of the schema beside them."""
    rows.repartition("system", F.expr("frame div 4096")).sortWithinPartitions("system", "frame").write.partitionBy("system").parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([(SCHEMA_VERSION,)], "version int").write.parquet(f"{path}/version")


def read_store(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Frames first to last of a store (row groups are pruned); another version of the schema raises."""
    version = spark.read.parquet(f"{path}/version").first()[0]  # one row
    if version != SCHEMA_VERSION:
        raise ValueError(f"{path} has schema {version}, expected {SCHEMA_VERSION}")
    rows = spark.read.parquet(f"{path}/rows")
    return rows.where(F.col("frame").between(F.lit(0 if first is None else first), F.lit(2**31 - 1 if last is None else last)))
