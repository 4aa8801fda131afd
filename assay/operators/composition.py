"""Element statistics over exploded compositions (material_id, element, amount)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.scalars import crystal_system, ratio, round_even
from assay.operators.prefix import prefix_sums


def explode_composition(rows: DataFrame, composition: str = "composition") -> DataFrame:
    return rows.select("material_id", F.explode(composition).alias("element", "amount"))


def referenced_energy(entries: DataFrame, composition: DataFrame, references: DataFrame) -> DataFrame:
    """(E - sum n e) / N of each entry; an element without a reference raises, a missing energy too.

    entries (material_id, energy), references (element, e_ref; one row per element).
    """
    parts = composition.join(F.broadcast(references.select("element", "e_ref")), "element", "left")  # one row per element
    e = F.when(F.col("e_ref").isNull(), F.raise_error(F.concat(F.lit("no reference energy of "), F.col("element"))).cast("double")).otherwise(F.col("e_ref"))
    sums = parts.groupBy("material_id").agg(F.sum(F.col("amount") * e).alias("e0"), F.sum("amount").alias("n"))
    energy = F.when(F.col("energy").isNull(), F.raise_error(F.lit("energy is missing")).cast("double")).otherwise(F.col("energy"))
    return entries.join(sums, "material_id").select("material_id", ((energy - F.col("e0")) / F.col("n")).alias("e_form"))


def elemental_references(entries: DataFrame, composition: DataFrame) -> DataFrame:
    """Lowest energy per atom among entries of one element: (element, material_id, e_ref)."""
    one = composition.withColumn("k", F.count("*").over(Window.partitionBy("material_id"))).where("k = 1").drop("k")
    rows = one.join(entries, "material_id").withColumn("e", ratio("energy", "amount"))
    best = rows.groupBy("element").agg(F.min(F.struct("e", "material_id")).alias("b"))
    return best.select("element", F.col("b.material_id").alias("material_id"), F.col("b.e").alias("e_ref"))


def missing_references(composition: DataFrame, references: DataFrame) -> DataFrame:
    return composition.select("element").distinct().join(references, "element", "left_anti")


def element_counts(composition: DataFrame, materials: DataFrame, by_amount: bool = False) -> DataFrame:
    """Counts of elements over all rows, by step and by arity, in one pass: (slice, value, element, count)."""
    arity = composition.withColumn("arity", F.count("*").over(Window.partitionBy("material_id")))
    rows = arity.join(materials.select("material_id", "step"), "material_id")
    rows = rows.select("element", "amount", F.explode(F.expr("array(struct('all' AS slice, 0L AS value), struct('step' AS slice, bigint(step) AS value), struct('arity' AS slice, bigint(arity) AS value))")).alias("s"))
    total = F.sum("amount") if by_amount else F.count("*")
    return rows.groupBy("s.slice", "s.value", "element").agg(total.alias("count"))


def compare_counts(a: DataFrame, b: DataFrame, size_a: int, size_b: int, least: int = 10) -> DataFrame:
    """Two count tables (element, count) side by side, also per 100 rows; rare elements are dropped."""
    both = a.select("element", F.col("count").alias("a")).join(b.select("element", F.col("count").alias("b")), "element", "full_outer").fillna(0, ["a", "b"])
    both = both.where(F.col("a") + F.col("b") > least)
    return both.withColumns({"a_per_100": F.col("a") * 100.0 / size_a, "b_per_100": F.col("b") * 100.0 / size_b, "ratio": ratio(F.col("a") / size_a, F.col("b") / size_b)})


def arity_shares(composition: DataFrame, keys: list[str] | None = None, most: int = 6) -> DataFrame:
    keys = keys or []
    arity = composition.groupBy(*keys, "material_id").agg(F.count("*").alias("arity")).groupBy(*keys, "arity").agg(F.count("*").alias("count"))
    return arity.withColumn("share", ratio("count", F.sum("count").over(Window.partitionBy(*keys)))).where(F.col("arity") <= most)


def element_errors(rows: DataFrame, composition: DataFrame) -> DataFrame:
    """Per model and element: mean error weighted by amount over rows with an error, and mean over all rows."""
    parts = rows.select("model_key", "material_id", "err").join(composition, "material_id")
    size = F.abs("err")
    return parts.groupBy("model_key", "element").agg(
        F.avg(F.col("amount") * size).alias("weighted_error"), (F.coalesce(F.sum(size), F.lit(0.0)) / F.count("*")).alias("presence_error"), F.count("*").alias("n")
    )


def element_spread(materials: DataFrame, composition: DataFrame, value: str = "each_true") -> DataFrame:
    return composition.join(materials.select("material_id", value), "material_id").groupBy("element").agg(F.stddev_samp(value).alias("spread"))


def normal_errors(errors: DataFrame, spread: DataFrame) -> DataFrame:
    """Errors over the element's spread; null where that is missing or 0."""
    return errors.join(spread, "element", "left").withColumn("normal_error", ratio("presence_error", F.nullif("spread", F.lit(0.0))))


def elements_within(composition: DataFrame, allowed: list[str]) -> DataFrame:
    """Materials all of whose elements are allowed."""
    ok = F.col("element").isin(allowed)
    return composition.groupBy("material_id").agg(F.min(ok).alias("ok")).where("ok").select("material_id")


def space_group_tree(materials: DataFrame) -> DataFrame:
    """Counts by crystal system and space group with totals of both levels: (system, spg_num, count)."""
    rows = materials.select(crystal_system("spg_num").alias("system"), "spg_num")
    return rows.rollup("system", "spg_num").agg(F.count("*").alias("count"))


def flows(rows: DataFrame, a: str, b: str, keys: list[str], top: int = 10) -> DataFrame:
    """Flow counts among the values of the most frequent pairs: (keys, a, b, count, source, target).

    The ``top`` pairs of each group give the values; all rows with both values among them count.
    Nodes are numbered from 0 on each side.
    """
    pairs = rows.groupBy(*keys, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("count"))
    order = Window.partitionBy(*keys).orderBy(F.col("count").desc(), "a", "b")
    best = pairs.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    kept = pairs.join(best.select(*keys, "a").distinct(), [*keys, "a"], "left_semi").join(best.select(*keys, "b").distinct(), [*keys, "b"], "left_semi")
    node = lambda c: (F.dense_rank().over(Window.partitionBy(*keys).orderBy(c)) - 1)
    return kept.select(*keys, "a", "b", "count", node("a").alias("source"), node("b").alias("target"))


def difference_counts(rows: DataFrame, diff: str, key: str = "model_key") -> DataFrame:
    """Value counts of a difference by model, with the model's sample deviation."""
    spread = rows.groupBy(key).agg(F.stddev_samp(diff).alias("spread"))
    return rows.groupBy(key, F.col(diff).alias("diff")).agg(F.count("*").alias("count")).join(spread, key)


def geometry_metrics(rows: DataFrame) -> DataFrame:
    """Mean RMSD (missing as 1), mean change of operation counts, shares of symmetry outcomes by model.

    rows: model_key, rmsd, spg_diff, ops_diff. Rows without spg_diff are not valid.
    """
    valid = F.col("spg_diff").isNotNull()
    share = lambda c: ratio(F.count_if(valid & c), F.count_if(valid))
    return rows.groupBy("model_key").agg(
        F.avg(F.coalesce("rmsd", F.lit(1.0))).alias("rmsd"), F.avg(F.when(valid, F.abs("ops_diff"))).alias("ops_mae"),
        share((F.col("spg_diff") != 0) & (F.col("ops_diff") < 0)).alias("decreased"), share(F.col("spg_diff") == 0).alias("matched"),
        share((F.col("spg_diff") != 0) & (F.col("ops_diff") > 0)).alias("increased"), F.count_if(valid).alias("n"),
    )


def cdf(rows: DataFrame, value: str, key: str = "model_key", samples: int = 200, stop: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Cumulative distribution at evenly spaced ranks, and its normalised area up to ``stop``.

    Returns (key, x, share) and (key, auc); the area is taken on the sampled points.
    """
    ranked = rows.where(F.col(value).isNotNull())
    size = ranked.groupBy(key).agg(F.count("*").alias("n"))
    ranked = prefix_sums(ranked.select(key, value), value, {"i": F.lit(1).cast("long")}, [key]).join(F.broadcast(size), key)  # one row per key
    # row i is sampled if some k gives floor(k (n - 1) / (samples - 1)) = i - 1
    k = F.expr(f"((i - 1) * {samples - 1} + n - 2) div greatest(n - 1, 1)")
    hit = (F.col("n") <= samples) | (F.floor(k * (F.col("n") - 1) / (samples - 1)) == F.col("i") - 1)
    points = ranked.where(hit).select(key, F.col(value).alias("x"), ratio("i", "n").alias("share"))
    w = Window.partitionBy(key).orderBy("x", "share")
    area = (F.col("x") - F.lag("x").over(w)) * (F.col("share") + F.lag("share").over(w)) / 2
    auc = points.where(F.col("x") <= stop).withColumn("area", area).groupBy(key).agg((F.coalesce(F.sum("area"), F.lit(0.0)) / stop).alias("auc"))
    return points, auc


def rounded_references(references: DataFrame, elements: DataFrame) -> DataFrame:
    """Reference energies in order of atomic number, two decimals."""
    return references.join(F.broadcast(elements), "element").select("element", "z", round_even("e_ref", 2).alias("e_ref")).orderBy("z")


def last_value_per_element(sites: DataFrame, value: str) -> DataFrame:
    """The value of the last site of each element in each frame: (frame, element, value)."""
    return sites.groupBy("frame", "element").agg(F.max_by(value, "site").alias(value))


def canonical_wyckoffs(rows: DataFrame, relabelings: DataFrame) -> DataFrame:
    """The least of all relabelled Wyckoff strings, by the sum of letters and then as text: (material_id, wyckoffs).

    rows: material_id, spg_num, wyckoffs ("2a_b3c": letters with counts, elements between
    underscores); relabelings: spg_num, source, target (letters and what they become). A space
    group without relabelings keeps its letters, sorted within elements.
    """
    letters = F.expr("coalesce(translate(wyckoffs, source, target), wyckoffs)")
    names = rows.join(F.broadcast(relabelings), "spg_num", "left").withColumn("w", letters)  # a fixed table of space groups
    parts = F.transform(F.split("w", "_"), lambda p: F.array_join(F.array_sort(F.regexp_extract_all(p, F.lit("([0-9]*[A-Za-z])"), F.lit(1))), ""))
    one = F.regexp_extract_all("w", F.lit("([0-9]*)[A-Za-z]"), F.lit(1))
    letter = F.regexp_extract_all("w", F.lit("[0-9]*([A-Za-z])"), F.lit(1))
    score = F.aggregate(F.zip_with(one, letter, lambda n, x: F.when(n == "", 1).otherwise(n.try_cast("int")) * F.ascii(x)), F.lit(0), lambda a, x: a + x)
    best = F.min(F.struct(score.alias("score"), F.array_join(parts, "_").alias("wyckoffs")))
    return names.groupBy("material_id").agg(best.alias("b")).select("material_id", "b.wyckoffs")


def analysis_differences(pred: DataFrame, true: DataFrame, columns: list[str], keys: tuple[str, ...] = ("model_key",), key: str = "material_id") -> DataFrame:
    """Predictions with the differences of columns to the reference's: (keys, key, <column>_diff), null where either lacks it."""
    t = true.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    return pred.join(t, key, "left").select(*keys, key, *((F.col(c) - F.col(f"__{c}")).alias(f"{c}_diff") for c in columns))


def concat_metrics(tables: dict[str, DataFrame], key: str = "material_id") -> DataFrame:
    """Tables of one model each as one long table: (model_key, key, metric, value) of all their number columns."""
    out = None
    for name, d in tables.items():
        columns = [c for c, kind in d.dtypes if c != key and kind in ("tinyint", "smallint", "int", "bigint", "float", "double")]
        pairs = ", ".join(f"'{c}', double({c})" for c in columns)
        long = d.select(F.lit(name).alias("model_key"), key, F.expr(f"stack({len(columns)}, {pairs}) AS (metric, value)"))
        out = long if out is None else out.unionByName(long)
    return out


def each_setting(models: DataFrame, settings: DataFrame) -> DataFrame:
    """Every model under every setting; both tables are small dimensions."""
    return models.crossJoin(F.broadcast(settings))
