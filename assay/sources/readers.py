"""Readers: files to long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.functions.scalars import finite
from assay.sources.extxyz import matching_files, read_trajectories
from assay.sources.places import with_ordinals

_FORMATS = {"csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet"}


def read_glob(spark: SparkSession, pattern: str, schema: str | None = None, **options) -> DataFrame:
    """Union of all files of a pattern, by extension (.gz is seen through); adds the column ``file``.

    An unknown extension raises; a pattern without files raises in Spark.
    """
    name = pattern.removesuffix(".gz")
    kind = _FORMATS.get(name.rsplit(".", 1)[-1])
    if kind is None:
        raise ValueError(f"no reader for {pattern}")
    reader = spark.read.options(**({"header": "true"} if kind == "csv" else {}), **({"multiLine": "true"} if name.endswith(".json") else {}), **options)
    if schema:
        reader = reader.schema(schema)
    return reader.format(kind).load(pattern).withColumn("file", F.input_file_name())


def from_path(pattern: str, group: int = 1, column: str = "file") -> Column:
    """A part of the file's path by a regular expression."""
    return F.regexp_extract(column, pattern, group)


def single_row_files(rows: DataFrame) -> DataFrame:
    """Rows of files that have exactly one row."""
    return rows.withColumn("__n", F.count("*").over(Window.partitionBy("file"))).where("__n = 1").drop("__n")


def numeric(rows: DataFrame, columns: list[str], scale: dict[str, float] | None = None) -> DataFrame:
    """Columns as finite doubles, anything else null, some scaled."""
    return rows.withColumns({c: finite(c) * (scale or {}).get(c, 1.0) for c in columns})


def flatten_metrics(models: DataFrame, sections: list[str], prefix: str = "metrics") -> DataFrame:
    """Metric fields of nested sections as columns; later sections win, missing models give no row."""
    names: dict[str, list[str]] = {}
    for s in sections:
        node = models.select(f"{prefix}.{s}").schema[0].dataType
        for f in node.names:
            names.setdefault(f, []).insert(0, f"{prefix}.{s}.{f}")
    out = models.select("model_key", *(F.coalesce(*map(F.col, paths)).alias(n) for n, paths in names.items()))
    return out.dropna("all", subset=list(names))


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    """Sections of curves from JSON {section: {name: {distances, energies}}}: (section, name, pos, x, y), empty ones skipped."""
    kind = "map<string, map<string, struct<distances: array<double>, energies: array<double>>>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("v"))
    curves = text.select(F.explode("v").alias("section", "c")).select("section", F.explode("c").alias("name", "d"))
    return curves.where("size(d.distances) > 0").select("section", "name", F.posexplode(F.arrays_zip("d.distances", "d.energies"))).select("section", "name", "pos", F.col("col.distances").alias("x"), F.col("col.energies").alias("y"))


def grid_violations(curves: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Curves whose x are not an ordered subset of the grid (pos, x): (keys)."""
    rows = curves.join(F.broadcast(grid.select("x", F.col("pos").alias("g"))), "x", "left")  # one grid
    w = Window.partitionBy(*keys).orderBy("pos")
    bad = F.col("g").isNull() | (F.col("g") <= F.lag("g").over(w))
    return rows.withColumn("bad", bad).groupBy(*keys).agg(F.max("bad").alias("bad")).where("bad").select(*keys)


def homonuclear_name(name: Column | str) -> Column:
    """``X-X`` becomes X; other names stay."""
    n = F.col(name) if isinstance(name, str) else name
    a, b = (F.split_part(n, F.lit("-"), F.lit(k)) for k in (1, 2))
    return F.when(a == b, a).otherwise(n)


def read_frames(spark: SparkSession, pattern: str, name_filter: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Frames and atoms of extended-XYZ files, optionally of the first ``limit`` whose names match; see ``read_trajectories``."""
    return read_trajectories(spark, matching_files(spark, pattern, name_filter, limit) if name_filter or limit else pattern)


def read_records(spark: SparkSession, path: str, schema: str, key: str = "material_id") -> DataFrame:
    """Nested JSON records with a schema; rows without the key raise when they are read."""
    rows = spark.read.schema(schema).option("multiLine", str(path.rstrip("*").removesuffix(".gz").endswith(".json")).lower()).json(path)
    if key not in rows.columns:
        raise ValueError(f"the schema lacks {key}")
    return rows.where(F.when(F.col(key).isNotNull(), True).otherwise(F.raise_error(F.lit(f"record without {key}")).cast("boolean")))


def read_summary(spark: SparkSession, path: str, schema: str, key: str = "material_id") -> DataFrame:
    """A reference table from CSV with a header, with the place of each row in reading order, from 0 and without gaps, as ordinal.

    Rows without the key are left out, but have had a place.
    """
    rows = with_ordinals(spark.read.schema(schema).option("header", "true").csv(path))
    return rows.where(F.col(key).isNotNull())


def per_system_or_combined(files: DataFrame, combined: DataFrame, key: str = "system") -> DataFrame:
    """Rows of files that have exactly one, and for systems without such a file those of the combined file."""
    single = single_row_files(files).drop("file")
    return single.unionByName(combined.join(single, key, "left_anti"), allowMissingColumns=True)


def stress_to_voigt(stress: Column | str) -> Column:
    """Row-major 3x3 stress as xx, yy, zz, yz, xz, xy."""
    s = F.col(stress) if isinstance(stress, str) else stress
    return F.array(*(F.get(s, F.lit(i)) for i in (0, 4, 8, 5, 2, 1)))


def frame_slice(frames: DataFrame, first: int, last: int) -> DataFrame:
    """Frames first to last; on Parquet sorted by frame the bounds prune row groups."""
    return frames.where(F.col("frame").between(first, last))


def candidate_points(points: DataFrame) -> DataFrame:
    """Points with a finite last energy, distance and 2x3 forces; malformed moments are null."""
    energy = F.get("energies", F.size("energies") - 1)
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    forces = (F.size("forces") == 2) & F.forall("forces", lambda r: (F.size(r) == 3) & F.forall(r, good))
    moments = F.when((F.size("magmoms") == 2) & F.forall("magmoms", good), F.col("magmoms"))
    return points.withColumns({"y": energy, "magmoms": moments}).where(good(F.col("y")) & good(F.col("x")) & forces)


def curves_with_moments(points: DataFrame, keys: list[str]) -> DataFrame:
    known = F.exists("magmoms", lambda m: m.isNotNull())
    return points.groupBy(*keys).agg(F.max(F.coalesce(known, F.lit(False))).alias("known")).where("known").select(*keys)
