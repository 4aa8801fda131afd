"""Data-quality gates: each returns the rows that break a rule, so an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_empty(problems: DataFrame, message: str) -> None:
    """Raise with the first problems if there are any."""
    if found := problems.limit(5).collect():
        raise ValueError(f"{message}: {[tuple(r) for r in found]}")


def coverage_problems(rows: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are duplicate, missing or unexpected: (keys, problem, n)."""
    have = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    want = expected.select(*keys).distinct().withColumn("wanted", F.lit(True))
    both = have.join(want, keys, "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("n") > 1, "duplicate")
    return both.select(*keys, problem.alias("problem"), F.coalesce("n", F.lit(0)).alias("n")).where("problem IS NOT NULL")


def shared_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys)


def missing_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``a`` that ``b`` lacks."""
    return a.select(*keys).distinct().join(b, keys, "left_anti")


def shard_problems(headers: DataFrame, records: DataFrame, expected: DataFrame, key: str = "material_id") -> DataFrame:
    """What keeps shards from merging: (problem, detail).

    headers: model_key, shard, shards, settings, data_hash, assigned (array of keys); records:
    model_key, shard, key. Indices must be 0 to n - 1, settings and hashes one, records equal to
    what is assigned, and all of it the expected keys once.
    """
    per = headers.groupBy("model_key").agg(
        F.count("*").alias("n"), F.count_distinct("shard").alias("d"), F.min("shard").alias("lo"), F.max("shard").alias("hi"),
        F.count_distinct("settings").alias("s"), F.count_distinct("data_hash").alias("h"), F.min("shards").alias("a"), F.max("shards").alias("b"),
    )
    tests = {
        "shard indices": "n <> a OR d <> n OR lo <> 0 OR hi <> n - 1 OR a <> b",
        "settings differ": "s <> 1",
        "dataset differs": "h <> 1",
    }
    kind = F.col("model_key").cast("string").alias("detail")
    out = None
    for name, test in tests.items():
        bad = per.where(test).select(F.lit(name).alias("problem"), kind)
        out = bad if out is None else out.unionByName(bad)
    assigned = headers.select("model_key", "shard", F.explode("assigned").alias(key))
    for name, d in (
        ("not recorded", assigned.join(records, ["model_key", "shard", key], "left_anti")),
        ("not assigned", records.join(assigned, ["model_key", "shard", key], "left_anti")),
        ("recorded twice", records.groupBy("model_key", key).agg(F.count("*").alias("n")).where("n > 1")),
        ("not expected", records.join(expected, key, "left_anti")),
        ("missing", expected.join(records, key, "left_anti")),
    ):
        out = out.unionByName(d.select(F.lit(name).alias("problem"), F.col(key).cast("string").alias("detail")))
    return out


def manifest_problems(manifest: DataFrame, expected: DataFrame, key: str = "material_id") -> DataFrame:
    """How a numbered manifest differs from the expected keys in order: (model_key, problem, key, place, expected_place).

    ``manifest`` has model_key, place (from 0) and the key, ``expected`` place and key. A key may be duplicate in either,
    missing, extra, or moved; keys are compared by place, so one key that is left out moves those behind it.
    """
    have = manifest.select("model_key", "place", key)
    models = have.select("model_key").distinct()
    want = expected.select(F.col("place").alias("expected_place"), key)
    twice = have.groupBy("model_key", key).agg(F.count("*").alias("n"), F.min("place").alias("place")).where("n > 1")
    twice_expected = want.groupBy(key).agg(F.count("*").alias("n"), F.min("expected_place").alias("expected_place")).where("n > 1")
    # models are some tens
    both = have.join(want.crossJoin(F.broadcast(models)), ["model_key", key], "full_outer")
    problem = F.when(F.col("place").isNull(), "missing").when(F.col("expected_place").isNull(), "extra").when(F.col("place") != F.col("expected_place"), "moved")
    out = both.select("model_key", problem.alias("problem"), key, "place", "expected_place").where("problem IS NOT NULL")
    out = out.unionByName(twice.select("model_key", F.lit("duplicate").alias("problem"), key, "place", F.lit(None).cast("long").alias("expected_place")))
    return out.unionByName(twice_expected.select(F.lit(None).cast(have.schema["model_key"].dataType).alias("model_key"), F.lit("expected twice").alias("problem"), key, F.lit(None).cast("long").alias("place"), "expected_place"))


def record_problems(manifest: DataFrame, runs: DataFrame, records: DataFrame, fields: list[str], key: str = "material_id", files: DataFrame | None = None) -> DataFrame:
    """What keeps the records of a run from being complete: (model_key, problem, key).

    ``runs`` has model_key, save_forces and the fields that each record repeats; ``records`` model_key, key, error, force_file
    and the fields. Records are exactly those of the manifest, once each, with the run's fields; where forces are saved
    a record without an error names a force file, below ``forces/`` and among ``files`` (path) if they are given. Keys of both
    sides are counted together and each record is judged in one pass.
    """
    on = ["model_key", key]
    # by name and in all shuffle partitions: sorted keys take few compressed bytes, by which Spark would merge them into few tasks
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = lambda d, problem: d.select("model_key", F.lit(problem).alias("problem"), key)
    sides = manifest.select(*on, F.lit(1).alias("__listed"), F.lit(0).alias("__records")).unionByName(records.select(*on, F.lit(0).alias("__listed"), F.lit(1).alias("__records")))
    counts = sides.repartition(n, *on).groupBy(*on).agg(F.max("__listed").alias("__listed"), F.sum("__records").alias("__records"))
    whole = F.col("model_key").isNotNull() & F.col(key).isNotNull()  # null keys match nothing
    problems = F.concat(
        F.when((F.col("__listed") == 1) & ((F.col("__records") == 0) | ~whole), F.array(F.lit("no record"))).otherwise(F.array().cast("array<string>")),
        F.when((F.col("__listed") == 0) | ~whole, F.array_repeat(F.lit("not in the manifest"), F.col("__records").cast("int"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("__records") > 1, F.array(F.lit("recorded twice"))).otherwise(F.array().cast("array<string>")),
    )
    out = counts.select("model_key", F.explode(problems).alias("problem"), key)
    # runs are some tens
    both = records.join(F.broadcast(runs.select("model_key", "save_forces", *(F.col(f).alias(f"__run_{f}") for f in fields))), "model_key")
    saved, named = F.col("save_forces"), F.col("force_file").isNotNull()
    inside = F.col("force_file").startswith("forces/") & ~F.col("force_file").contains("..")
    tests = {f"{f} differs": ~F.col(f).eqNullSafe(F.col(f"__run_{f}")) for f in fields}
    tests |= {"no force file": saved & F.col("error").isNull() & ~named, "invalid force file": saved & named & ~inside}
    found = F.array_compact(F.array(*(F.when(test, F.lit(problem)) for problem, test in tests.items())))
    out = out.unionByName(both.select("model_key", F.explode(found).alias("problem"), key))
    if files is not None:
        # files and the records that name them are laid together by path; a join would be planned anew, with partitions merged
        wanted = both.where(saved & named & inside).select(*on, "force_file", F.lit(0).alias("__there"))
        sides = wanted.unionByName(files.select(F.col("path").alias("force_file"), F.lit(1).alias("__there")), allowMissingColumns=True).repartition(n, "force_file")
        sides = sides.withColumn("__found", F.max("__there").over(Window.partitionBy("force_file")))
        out = out.unionByName(kind(sides.where("__there = 0 AND __found = 0"), "invalid force file"))
    return out


def grid_problems(curves: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Curves whose grid differs from the most common one: (keys, points)."""
    grids = curves.groupBy(*keys).agg(F.sum(F.xxhash64(x).cast("decimal(20,0)")).alias("grid"), F.count("*").alias("points"))
    common = grids.groupBy("grid").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "grid").limit(1).select("grid")
    return grids.join(F.broadcast(common), "grid", "left_anti").select(*keys, "points")  # one row


def _digest(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """SHA-256 of each group's values, one per line; a hash of one text is sequential, so each group
    is one task's, but sorted rows are streamed and no group is ever held in memory or cut."""
    items = rows.select(*keys, *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)), F.col(value).cast("string").alias("__v"))
    items = items.repartition(*keys) if keys else items.repartition(1)
    places = [*keys, *(f"__o{i}" for i in range(len(order))), "__v"]
    items = items.sortWithinPartitions(*places).select(*keys, "__v")
    n = len(keys)
    schema = T.StructType([*items.schema.fields[:n], T.StructField("digest", T.StringType())])

    def digests(batches):
        import hashlib

        import pyarrow as pa

        def out(group, hashed):
            arrays = [b.slice(0, 1) for b in group] + [pa.array([hashed.hexdigest()])]
            return pa.RecordBatch.from_arrays(arrays, names=[*keys, "digest"])

        key = group = hashed = None
        started = False
        for batch in batches:
            columns = [batch.column(i) for i in range(n)]
            for i, (*k, v) in enumerate(zip(*(c.to_pylist() for c in columns), batch.column(n).to_pylist())):
                if group is None or k != key:
                    if group is not None:
                        yield out(group, hashed)
                    key, group, hashed, started = k, [pa.concat_arrays([c.slice(i, 1)]) for c in columns], hashlib.sha256(), False
                if v is not None:
                    hashed.update(b"\n" + v.encode() if started else v.encode())
                    started = True
        if group is not None:
            yield out(group, hashed)

    return items.mapInArrow(digests, schema)


def ordered_digest(rows: DataFrame, keys: list[str], value: str, ordinal: str) -> DataFrame:
    """SHA-256 of the values in order, one per line, for groups of any size; nulls are left out."""
    return _digest(rows, keys, value, [ordinal])


def sorted_digest(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """As ``ordered_digest`` with the values sorted, so order does not matter."""
    return _digest(rows, keys, value, [])


def set_digest(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Order-free digest for groups of any size: xor and count of hashes."""
    return rows.groupBy(*keys).agg(F.bit_xor(F.xxhash64(value)).alias("digest"), F.count("*").alias("n"))


def table_problems(rows: DataFrame, required: list[str], key: str) -> DataFrame:
    """Null and duplicate keys: (problem, key, n); a missing column raises."""
    if lacking := [c for c in required if c not in rows.columns]:
        raise ValueError(f"missing columns: {lacking}")
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    return n.where(F.col(key).isNull() | (F.col("n") > 1)).select(F.when(F.col(key).isNull(), "null key").otherwise("duplicate key").alias("problem"), F.col(key), "n")


def union_steps(parts: dict[int, DataFrame], expected: dict[int, int], removed: DataFrame, key: str = "material_id") -> tuple[DataFrame, DataFrame]:
    """Union of per-step tables less removed keys, and steps with other than the expected row counts."""
    rows = None
    for step, d in parts.items():
        d = d.withColumn("step", F.lit(step))
        rows = d if rows is None else rows.unionByName(d)
    want = rows.sparkSession.createDataFrame(sorted(expected.items()), "step int, expected long")
    have = rows.groupBy("step").agg(F.count("*").alias("n"))
    return rows.join(removed, key, "left_anti"), want.join(have, "step", "left").where("NOT n <=> expected")


def differing_rows(a: DataFrame, b: DataFrame, key: str, value: str, limit: float) -> DataFrame:
    """Keys that one side lacks or whose values differ by more than ``limit``: (key, a, b)."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full_outer")
    return both.where(F.col("a").isNull() | F.col("b").isNull() | (F.abs(F.col("a") - F.col("b")) > limit))


def sample_rows(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n rows by a hash of the key: the same rows on every run."""
    return rows.orderBy(F.xxhash64(key), key).limit(n)


def size_problems(columns: DataFrame, manifest: DataFrame) -> DataFrame:
    """Aligned columns (name, position, value) whose row count is not the manifest's (n_rows)."""
    n = columns.groupBy("name").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(manifest.select("n_rows"))).where("n <> n_rows")  # one row


def provenance_problems(records: DataFrame, manifest: DataFrame, fields: list[str], run: str = "run_id") -> DataFrame:
    """Records whose fields are not their run's: (run, field, record value, run value)."""
    m = manifest.select(run, *(F.col(f).cast("string").alias(f"m_{f}") for f in fields))
    both = records.join(m, run)
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("have"), F.col(f"m_{f}").alias("want")) for f in fields)))
    return both.select(run, each.alias("p")).select(run, "p.*").where("NOT have <=> want")


def order_problems(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Groups whose ordinals are not 0 to n - 1."""
    per = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(ordinal).alias("lo"), F.max(ordinal).alias("hi"), F.count_distinct(ordinal).alias("d"))
    return per.where("lo <> 0 OR hi <> n - 1 OR d <> n")


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def smallest(rows: DataFrame, n: int, size: str, key: str) -> DataFrame:
    """The n smallest rows by size and key; duplicate keys, or fewer than n rows, raise."""
    require_empty(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), "duplicate keys")
    out = rows.orderBy(size, key).limit(n)
    if (have := out.count()) < n:
        raise ValueError(f"only {have} of {n} rows")
    return out
