"""Payload tables: keyed upserts, roster changes, row shards and path updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.scalars import round_even

BASE = "_base"


def upsert(committed: DataFrame | None, fresh: DataFrame, inactive: DataFrame | None = None, full_run: bool = False, key: str = "id") -> DataFrame:
    """New version of a payload: a full run replaces it, a subset run replaces rows by key.

    A subset run keeps the committed base row and unknown keys, and drops inactive keys; without a
    committed payload it raises. Columns color and visible are left out. Rows are sorted by key.
    """
    fresh = fresh.drop("color", "visible")
    if full_run:
        return fresh.orderBy(key)
    if committed is None:
        raise ValueError("a subset run needs a committed payload")
    replaced = fresh.where(F.col(key) != BASE)
    out = committed.join(replaced, key, "left_anti").unionByName(replaced)
    if inactive is not None:
        out = out.join(inactive.where(F.col(key) != BASE), key, "left_anti")
    return out.orderBy(key)


def unchanged(a: DataFrame, b: DataFrame) -> bool:
    """The two versions have the same rows, so nothing has to be written."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def roster_changes(before: DataFrame, after: DataFrame, keys: tuple[str, str] = ("payload", "id"), lists: bool = True) -> DataFrame:
    """Ids added and removed by payload: (payload, added, removed, n_added, n_removed); base rows do not count.

    The lists are for payloads of some tens of models; without ``lists`` only the counts are taken.
    """
    payload, key = keys
    a, b = (d.where(F.col(key) != BASE).select(*keys).distinct().withColumn(c, F.lit(True)) for d, c in ((before, "was"), (after, "now")))
    both = a.join(b, list(keys), "full_outer")
    if not lists:
        return both.groupBy(payload).agg(F.count_if(F.col("was").isNull()).alias("n_added"), F.count_if(F.col("now").isNull()).alias("n_removed"))
    ids = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNull(), F.col(key))))
    out = both.groupBy(payload).agg(ids("was").alias("added"), ids("now").alias("removed"))
    return out.withColumns({"n_added": F.size("added"), "n_removed": F.size("removed")})


def row_shards(rows: DataFrame, ordinal: str = "ordinal", shard_rows: int = 512, bundle: int = 50) -> DataFrame:
    """Shard and bundle of each row by its place."""
    rows = rows.withColumn("shard", F.expr(f"{ordinal} div {shard_rows}").cast("long"))
    return rows.withColumn("bundle", F.expr(f"shard div {bundle}").cast("long"))


def write_aligned(base: DataFrame, values: DataFrame, path: str, key: str = "material_id", ordinal: str = "ordinal", digits: int = 6) -> None:
    """A base table and one column per model, all in the order of the base, for readers that go by place alone.

    ``base`` has the key, the ordinal (0 to n - 1) and any columns; ``values`` (model_key, key, value), one row per
    model and key at most. Each model gets a row per base row, with null where it has none, rounded. Files are by bundle
    (rows div 512 div 50), so none holds more than 25,600 rows, sorted by ordinal; a model's rows carry nothing but
    ordinal and value.
    """
    placed = row_shards(base, ordinal)
    placed.repartition("bundle").sortWithinPartitions("bundle", ordinal).write.partitionBy("bundle").parquet(f"{path}/base")
    keys = placed.select(key, F.col(ordinal).alias("ordinal"), "bundle")
    models = values.select("model_key").distinct()
    # a base row for every model; models are some tens
    every = keys.crossJoin(F.broadcast(models)).join(values.select("model_key", key, "value"), ["model_key", key], "left")
    every = every.select("model_key", "bundle", "ordinal", round_even("value", digits).alias("value"))
    every.repartition("model_key", "bundle").sortWithinPartitions("model_key", "bundle", "ordinal").write.partitionBy("model_key", "bundle").parquet(f"{path}/models")


def aligned_bundles(spark: SparkSession, path: str, key: str = "material_id", ordinal: str = "ordinal") -> DataFrame:
    """Each column of aligned assets by bundle, checked against the base: (model_key, bundle, rows, values, order_sha256, aligned).

    ``order_sha256`` is the SHA-256 of the base's keys in order, a line each; ``aligned`` says that the model has exactly the
    base's places. A bundle is a bounded group.
    """
    base = spark.read.parquet(f"{path}/base")
    order = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(key).cast("string").alias("k"))))
    base = base.groupBy("bundle").agg(order.alias("in_order")).select(
        "bundle", F.sha2(F.array_join(F.transform("in_order", lambda x: x["k"]), "\n"), 256).alias("order_sha256"), F.transform("in_order", lambda x: x["o"]).alias("places"))
    models = spark.read.parquet(f"{path}/models").groupBy("model_key", "bundle").agg(
        F.array_sort(F.collect_list("ordinal")).alias("ordinals"), F.count("value").alias("values"), F.count("*").alias("rows"))
    every = spark.read.parquet(f"{path}/models").select("model_key").distinct().crossJoin(F.broadcast(base))  # a line per bundle, some tens of models
    out = every.join(models, ["model_key", "bundle"], "left")
    return out.select("model_key", "bundle", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("values", F.lit(0)).alias("values"), "order_sha256", F.coalesce(F.col("ordinals") == F.col("places"), F.lit(False)).alias("aligned"))


def update_paths(facts: DataFrame, updates: DataFrame, preserve: bool = False) -> DataFrame:
    """Set values at dotted paths (model_key, path, value); with ``preserve`` values that are there stay."""
    keys = ["model_key", "path"]
    if preserve:
        return facts.unionByName(updates.join(facts, keys, "left_anti"))
    return facts.join(updates, keys, "left_anti").unionByName(updates)


def replace_section(facts: DataFrame, updates: DataFrame, section: str) -> DataFrame:
    """All values below a path replaced for the models in ``updates``."""
    inside = F.col("path").startswith(f"{section}.")
    old = facts.where(inside).join(updates.select("model_key").distinct(), "model_key", "left_semi")
    return facts.join(old.select("model_key", "path"), ["model_key", "path"], "left_anti").unionByName(updates)


def compact_positions(atoms: DataFrame, digits: int = 3) -> DataFrame:
    return atoms.withColumns({c: round_even(c, digits) for c in ("x", "y", "z")})


def grouped_blobs(frames: DataFrame, key: str, text: str, ordinal: str) -> DataFrame:
    """One text per key from its frames in order; a key's frames are bounded."""
    items = F.array_sort(F.collect_list(F.struct(ordinal, text)))
    return frames.groupBy(key).agg(F.array_join(F.transform(items, lambda x: x[text]), "\n").alias("blob"))
