"""Pipelines that build the reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.scalars import alphabetical_formula, close_id_gaps, next_step_id, pressure, round_even, space_group_of_label
from assay.operators.composition import referenced_energy
from assay.operators.discovery import duplicate_prototypes


def summary_table(
    raw: DataFrame, hull: DataFrame, composition: DataFrame, references: DataFrame, training_prototypes: DataFrame, removed: list[int] | None = None, low: float = -5.0, high: float = 5.0
) -> DataFrame:
    """Reference table from raw rows, hull distances and compositions.

    raw: step, number, ordinal, energy, correction, proto_id, material_id. Ids are repaired, raw
    and hull rows are aligned by (step, ordinal), formation energies come from references, rows
    outside (low, high) go, prototypes seen in training or in a more stable row are marked.
    """
    gaps = F.array(*map(F.lit, removed or [])).cast("array<long>")
    rows = raw.withColumn("number", F.when(F.col("step") == 3, close_id_gaps(F.col("number"), gaps)).otherwise(F.col("number")))
    rows = rows.withColumn("wbm_id", F.concat_ws("-", F.lit("wbm"), "step", F.col("number") + 1))
    rows = rows.join(hull.select("step", "ordinal", "each_true"), ["step", "ordinal"])
    rows = rows.join(referenced_energy(rows.select("material_id", "energy"), composition, references), "material_id")
    rows = rows.withColumn("e_form", F.col("e_form") + F.col("correction")).where((F.col("e_form") > low) & (F.col("e_form") < high))
    seen = training_prototypes.select("proto_id").distinct().withColumn("in_training", F.lit(True))
    rows = duplicate_prototypes(rows.join(seen, "proto_id", "left"))
    unique = ~F.coalesce("in_training", F.lit(False)) & ~F.col("is_duplicate")
    return rows.select("wbm_id", "material_id", "step", "ordinal", round_even("e_form", 6).alias("e_form"), round_even("each_true", 6).alias("each_true"), unique.alias("uniq_proto"))


def prediction_table(records: DataFrame, summary: DataFrame, composition: DataFrame, references: DataFrame) -> DataFrame:
    """Formation energies of successful records, four decimals; failed records stay with null.

    records: material_id, energy (null if failed), correction per atom.
    """
    good = records.where("energy IS NOT NULL")
    formed = referenced_energy(good.select("material_id", "energy"), composition, references)
    rows = summary.select("material_id").join(records, "material_id").join(formed, "material_id", "left")
    return rows.select("material_id", round_even(F.col("e_form") + F.col("correction"), 4).alias("e_form_pred"), F.col("energy").isNull().alias("failed"))


def frame_summary(frames: DataFrame, composition: DataFrame, references: DataFrame) -> DataFrame:
    """Formation energy and pressure of trajectory frames: (frame_id, e_form, pressure)."""
    formed = referenced_energy(frames.select(F.col("frame_id").alias("material_id"), "energy"), composition.withColumnRenamed("frame_id", "material_id"), references)
    return frames.select("frame_id", pressure("stress").alias("pressure")).join(formed.withColumnRenamed("material_id", "frame_id"), "frame_id")


def energies_table(docs: DataFrame, prototypes: DataFrame) -> DataFrame:
    """Nested symmetry fields flattened, prototype labels joined; space groups that disagree raise."""
    rows = docs.select("material_id", "formula", "energy", F.col("symmetry.number").alias("spg_num")).join(prototypes, "material_id")
    ok = F.when(space_group_of_label("label") == F.col("spg_num"), True).otherwise(F.raise_error(F.lit("space groups disagree")).cast("boolean"))
    return rows.where(ok)


def lowest_energy(rows: DataFrame) -> DataFrame:
    """The row of least energy for each formula and type."""
    best = rows.groupBy("formula", "thermo_type").agg(F.min(F.struct("energy", "material_id")).alias("b"))
    return best.select("formula", "thermo_type", "b.*")


def settings_of(names: DataFrame, settings: DataFrame) -> DataFrame:
    """The longest settings key that is a prefix of each name: (name, setting)."""
    rows = names.join(F.broadcast(settings), F.col("name").startswith(F.col("setting")), "left")  # a short list of settings
    return rows.groupBy("name").agg(F.max_by("setting", F.length("setting")).alias("setting"))


def named_formulas(compositions: DataFrame) -> DataFrame:
    return compositions.select("material_id", alphabetical_formula("composition").alias("formula"))


def repaired_ids(ids: DataFrame, column: str = "material_id") -> DataFrame:
    return ids.withColumn(column, next_step_id(column))


def export_tables(materials: DataFrame, composition: DataFrame) -> dict[str, DataFrame]:
    """All histograms and counts of a reference table, by name, each to be written as a payload."""
    from assay.operators import composition as C
    from assay.operators import histograms as H

    return {
        "hull_distances": H.deviation_histogram(materials, "each_true"),
        "formation_energies": H.cumulative_share(H.histogram(materials, "e_form_dft", -5.5, 5.5, 300)),
        "element_counts": C.element_counts(composition, materials),
        "element_amounts": C.element_counts(composition, materials, by_amount=True),
        "arity": C.arity_shares(composition),
        "space_groups": C.space_group_tree(materials),
    }
