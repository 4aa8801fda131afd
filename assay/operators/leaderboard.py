"""Scores, filters, ranks and frontiers over one row per model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.scalars import finite, normal_key, ratio, subscore, weighted_score

CPS_WEIGHTS = {"f1": 0.5, "kappa_srme": 0.4, "rmsd": 0.1}


def combined_score(weights: dict[str, float] | None = None, rmsd_baseline: float = 0.15) -> Column:
    """Weighted mean of F1, 1 - RMSD / baseline (clamped) and 1 - SRME / 2; a missing part with weight gives null.

    So does one out of range: F1 lies between 0 and 1, SRME between 0 and 2, RMSD is not negative.
    """
    w = CPS_WEIGHTS | (weights or {})
    value = lambda c, most: F.when((finite(F.col(c)) >= 0) & (F.col(c) <= most), F.col(c))
    f1, srme, rmsd = value("f1", 1.0), value("kappa_srme", 2.0), value("rmsd", float("inf"))
    return weighted_score([(f1, w["f1"]), (1 - srme / 2, w["kappa_srme"]), (subscore(rmsd, rmsd_baseline), w["rmsd"])])


def md_score() -> Column:
    """0.3 vDOS + 0.2 ADF + 0.2 speed + 0.3 pressure, errors in percent, run time in seconds (logarithmic)."""
    return weighted_score([
        (subscore("vdos_error", 100.0), 0.3), (subscore("adf_error", 100.0), 0.2), (subscore("run_time_sec", 3e5, 9e3, log=True), 0.2), (subscore("pressure_error", 100.0), 0.3),
    ])


#: The components of each pillar as (column, weight, baseline, floor, logarithmic).
PILLAR_COMPONENTS = {
    "accuracy": [("pbe_energy_mae", 5 / 9, 4.0, 0.0, False), ("pbe_force_mae", 4 / 9, 5.0, 0.0, False)],
    "geometry": [("pbe_wall_dist_mae", 1 / 2, 0.5, 0.0, False), ("pbe_bond_length_error", 1 / 3, 0.8, 0.0, False), ("pbe_well_depth_error", 1 / 6, 3.5, 0.0, False)],
    "speed": [("run_time_sec", 1.0, 5000.0, 50.0, True)],
    "physicality": [("energy_jump", 2 / 5, 3.0, 0.0, False), ("force_flips", 2 / 5, 3.5, 1.0, False), ("tortuosity", 1 / 5, 2.0, 1.0, False)],
}
PILLAR_WEIGHTS = {"accuracy": 4 / 9, "geometry": 2 / 9, "speed": 1 / 9, "physicality": 2 / 9}


def pillar_score(weights: dict[str, float] | None = None, components: dict[str, list[tuple[str, float, float, float, bool]]] | None = None, excluded: Column | None = None, scored: int = 87) -> Column:
    """Two-level weighted score of one row per model: components within pillars, pillars by weight, times coverage.

    A component of a pillar with weight that is missing or not finite, or not positive where it is logarithmic, gives
    null, and so do weights that are all 0; a pillar without weight is not looked at. Coverage is 1 - excluded / scored, at least 0.
    """
    weights = PILLAR_WEIGHTS if weights is None else weights
    components = PILLAR_COMPONENTS if components is None else components
    parts = []
    for pillar, weight in weights.items():
        if weight:
            inside = [subscore(finite(F.col(c)), baseline, floor, log) * w for c, w, baseline, floor, log in components[pillar]]
            parts.append((sum(inside[1:], inside[0]), weight))
    score = weighted_score(parts)
    return score if excluded is None else score * F.greatest(F.lit(0.0), 1 - excluded / scored)


def ranks(rows: DataFrame, higher_is_better: dict[str, bool]) -> DataFrame:
    """Competition rank of each model for each metric among those with a value: (model_key, metric, value, rank, n)."""
    pairs = ", ".join(f"'{m}', double({m})" for m in higher_is_better)
    long = rows.select("model_key", F.expr(f"stack({len(higher_is_better)}, {pairs}) AS (metric, value)"))
    long = long.where("value IS NOT NULL AND NOT isnan(value)")
    up = F.create_map(*(F.lit(x) for kv in higher_is_better.items() for x in kv))[F.col("metric")]
    signed = F.when(up, -F.col("value")).otherwise(F.col("value"))
    every = Window.partitionBy("metric")
    return long.withColumns({"rank": F.rank().over(every.orderBy(signed)), "n": F.count("*").over(every)})


def running_best(rows: DataFrame, date: str = "date", value: str = "value", keys: list[str] | None = None, higher: bool = True) -> DataFrame:
    """Rows that strictly improve on all before them; of one date only the best can.

    One row per date is left before the window over dates.
    """
    keys = keys or []
    v = F.col(value) if higher else -F.col(value)
    rest = [c for c in rows.columns if c not in {*keys, date}]
    best = rows.where(F.col(value).isNotNull()).groupBy(*keys, date).agg(F.max(F.struct(v.alias("__v"), *rest)).alias("b"))
    before = F.max("b.__v").over(Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, -1))
    best = best.withColumn("__best", before).where(F.col("__best").isNull() | (F.col("b.__v") > F.col("__best")))
    return best.select(*keys, date, *(F.col(f"b.{c}").alias(c) for c in rest)).select(*rows.columns)


def step_line(frontier: DataFrame, end: Column, date: str = "date", value: str = "value") -> DataFrame:
    """Corner points of the frontier's steps, drawn on to ``end``: (date, value, part)."""
    w = Window.partitionBy().orderBy(date)
    corners = frontier.withColumn("before", F.lag(value).over(w)).where("before IS NOT NULL").select(F.col(date).alias("date"), F.col("before").alias("value"), F.lit(0).alias("part"))
    own = frontier.select(F.col(date).alias("date"), F.col(value).alias("value"), F.lit(1).alias("part"))
    last = frontier.agg(F.max_by(value, date).alias("value")).where("value IS NOT NULL").select(end.alias("date"), "value", F.lit(2).alias("part"))
    return corners.unionByName(own).unionByName(last)


def pareto(rows: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Points that no other beats in both axes (lower is better; negate a column for the reverse); exact ties all stay."""
    keys = keys or []
    rows = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    by_x = rows.groupBy(*keys, F.col(x).alias("__x")).agg(F.min(y).alias("__y"))
    left = Window.partitionBy(*keys).orderBy("__x").rowsBetween(Window.unboundedPreceding, -1)
    by_x = by_x.withColumn("__best", F.min("__y").over(left)).where(F.col("__best").isNull() | (F.col("__y") < F.col("__best")))
    cond = (rows[x] == by_x["__x"]) & (rows[y] == by_x["__y"])
    for k in keys:
        cond = cond & rows[k].eqNullSafe(by_x[k])
    return rows.join(by_x, cond, "left_semi")


def training_sizes(models: DataFrame, datasets: DataFrame) -> DataFrame:
    """Structures and materials over each model's training sets; an unknown set raises.

    models (model_key, training_sets array), datasets (dataset, n_structures, n_materials?).
    """
    rows = models.select("model_key", F.explode("training_sets").alias("dataset")).join(F.broadcast(datasets.withColumn("known", F.lit(True))), "dataset", "left")  # a registry of datasets
    known = F.when(F.col("known").isNull(), F.raise_error(F.concat(F.lit("unknown dataset "), F.col("dataset"))).cast("boolean")).otherwise(True)
    return rows.where(known).groupBy("model_key").agg(F.sum("n_structures").alias("n_structures"), F.sum(F.coalesce("n_materials", "n_structures")).alias("n_materials"))


def slowdown(rows: DataFrame, time: str = "run_time_sec", keys: list[str] | None = None) -> DataFrame:
    """Time over that of the fastest row in view; only positive finite times count."""
    t = finite(F.col(time))
    t = F.when(t > 0, t)
    return rows.withColumn("slowdown", ratio(t, F.min(t).over(Window.partitionBy(*(keys or [])))))


#: Metrics by the direction in which they improve; others have none.
HIGHER_IS_BETTER = ("Acc", "Accuracy", "AUC", "DAF", "F1", "Prec", "Precision", "R2", "Recall", "TN", "TNR", "TP", "TPR", "CMDS", "combined_score", "CPS")
LOWER_IS_BETTER = (
    "MAE", "RMSE", "FPR", "FNR", "FP", "FN", "RMSD", "κ_SRME", "κ_SRE", "κ_failure_rate", "imaginary_mode_rate", "spectrum_w1",
    "energy_rmse", "force_rmse", "rdf_error", "adf_error", "vdos_error", "pressure_mae", "pressure_wasserstein", "pressure_error",
)
#: Classes of openness, and outputs that models can be filtered by (energy is universal).
OPENNESS = ("OSOD", "OSCD", "CSOD", "CSCD")
OUTPUTS = {"F": "forces", "S": "stress", "M": "magmoms", "H": "Hessian"}


def metric_direction(metric: Column | str) -> Column:
    """``higher`` or ``lower`` for metrics that have a better direction, else null."""
    m = F.col(metric) if isinstance(metric, str) else metric
    return F.when(m.isin(*HIGHER_IS_BETTER), "higher").when(m.isin(*LOWER_IS_BETTER), "lower")


def known_ranks(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """``ranks`` of the metrics that have a direction; the others are left out."""
    up = {m: m in HIGHER_IS_BETTER for m in metrics if m in (*HIGHER_IS_BETTER, *LOWER_IS_BETTER)}
    return ranks(rows, up)


def parsed_targets(targets: Column | str = "targets") -> Column:
    """Outputs and force mode of a target string such as EFS_GM: struct(outputs array<string>, fs_mode string).

    Letters ahead of the underscore are outputs; an M behind it adds magnetic moments, D means direct and G gradient
    forces (direct if both), neither no mode.
    """
    t = F.col(targets) if isinstance(targets, str) else targets
    head, tail = F.split_part(t, F.lit("_"), F.lit(1)), F.split_part(t, F.lit("_"), F.lit(2))
    letters = F.filter(F.split(head, ""), lambda x: x != "")
    outputs = F.array_distinct(F.when(tail.contains("M"), F.concat(letters, F.array(F.lit("M")))).otherwise(letters))
    return F.struct(outputs.alias("outputs"), F.when(tail.contains("D"), "direct").when(tail.contains("G"), "gradient").alias("fs_mode"))


def filter_models(
    rows: DataFrame, openness: list[str] | None = None, require: list[str] | None = None, exclude: list[str] | None = None, column: str = "training_sets",
    targets: dict[str, bool] | None = None, fs_mode: str | None = None, search: str | None = None,
) -> DataFrame:
    """Models in view: by openness, by training sets that they must all have and must not have, by predicted outputs and force mode.

    ``targets`` says which of OUTPUTS are required (true) or excluded; by default forces are required, wherever the table has
    targets. A force mode leaves models without any out. ``search`` is a part of the key or label, in any case.
    """
    if unknown := (set(openness or ()) - {*OPENNESS, "open", "closed"}) | (set(targets or ()) - set(OUTPUTS)) | ({fs_mode} - {None, "direct", "gradient"}):
        raise ValueError(f"unknown filter values: {sorted(unknown)}")
    if openness is not None:
        rows = rows.where(F.col("openness").isin(openness))
    for x in require or []:
        rows = rows.where(F.array_contains(column, x))
    for x in exclude or []:
        rows = rows.where(~F.array_contains(column, x))
    if "targets" in rows.columns:
        parsed = parsed_targets()
        for key, needed in ({"F": True} if targets is None else targets).items():
            rows = rows.where(F.array_contains(parsed["outputs"], key) == F.lit(needed))
        if fs_mode is not None:
            rows = rows.where(parsed["fs_mode"] == fs_mode)
    if search:
        names = [F.lower(c).contains(search.lower()) for c in ("model_key", "label") if c in rows.columns]
        rows = rows.where(names[0] | names[1] if len(names) > 1 else names[0])
    return rows


def active_models(models: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """Models whose lifecycle is active and, where predictions (model_key) are given, that have any."""
    rows = models.where("lifecycle = 'active'")
    return rows if predictions is None else rows.join(predictions.select("model_key").distinct(), "model_key", "left_semi")


def is_full_run(models: DataFrame, requested: DataFrame) -> bool:
    """All active models are among the requested ones (model_key), so that a payload may be replaced as a whole."""
    return active_models(models).join(requested, "model_key", "left_anti").isEmpty()


def shared_subset(subset: str) -> str:
    """A subset that models can share in one payload; the most stable predictions of each model are its own and raise."""
    if subset == "most_stable_10k":
        raise ValueError("the most stable predictions differ by model, so they cannot be in one payload")
    return subset


#: Elements that no model is scored on.
SKIPPED_ELEMENTS = ("Po", "At", "Rn", "Fr", "Ra")


def excluded_formulas(curated: DataFrame, found: DataFrame, reason: str = "invalid or unsupported curve") -> DataFrame:
    """Formulas that are left out of a model's means: (model_key, formula, reason).

    ``curated`` has model_key, formula and reason, and goes before ``found`` (model_key, formula). Formulas with one of
    SKIPPED_ELEMENTS are left out of all models' metrics and not listed.
    """
    every = curated.select("model_key", "formula", "reason").unionByName(found.select("model_key", "formula").distinct().join(curated, ["model_key", "formula"], "left_anti").withColumn("reason", F.lit(reason)))
    return every.where(~F.arrays_overlap(F.split("formula", "-"), F.array(*map(F.lit, SKIPPED_ELEMENTS))))


def without_excluded(metrics: DataFrame, excluded: DataFrame, element: str = "element") -> DataFrame:
    """Metric rows (model_key, element) less those whose element X is excluded as X or X-X."""
    formulas = F.explode(F.array(F.col(element), F.concat_ws("-", element, element)))
    hit = metrics.select("model_key", element).distinct().withColumn("formula", formulas).join(excluded.select("model_key", "formula"), ["model_key", "formula"], "left_semi")
    return metrics.join(hit.select("model_key", element).distinct(), ["model_key", element], "left_anti")


def resolve_models(references: DataFrame, models: DataFrame) -> DataFrame:
    """Match names in any spelling to models; an unknown or ambiguous one raises: (reference, model_key)."""
    names = models.select("model_key", F.explode(F.array("model_key", "label")).alias("name")).select("model_key", normal_key("name").alias("k")).distinct()
    rows = references.withColumn("k", normal_key("reference")).join(names, "k", "left").groupBy("reference").agg(F.collect_set("model_key").alias("found"))
    one = F.when(F.size("found") == 1, F.get("found", F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("unknown or ambiguous model "), F.col("reference"))).cast("string"))
    return rows.select("reference", one.alias("model_key"))


def sort_models(rows: DataFrame, by: str, descending: bool = True) -> DataFrame:
    """By a metric with missing values last in both directions; a run time of 0 counts as infinite."""
    c = F.when(F.isnan(by), None).otherwise(F.col(by)) if dict(rows.dtypes)[by] in ("double", "float") else F.col(by)
    if by == "run_time_sec":
        c = F.when(c == 0, float("inf")).otherwise(c)
    return rows.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "model_key")


def associations(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson and Spearman correlation of two metrics over models (average ranks for ties)."""
    rows = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    rank = lambda c: F.rank().over(Window.partitionBy().orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2.0
    ranked = rows.select(a, b, rank(a).alias("ra"), rank(b).alias("rb"))
    return ranked.agg(F.corr(a, b).alias("pearson"), F.corr("ra", "rb").alias("spearman"), F.count("*").alias("n"))


def metric_means(rows: DataFrame, metrics: list[str], digits: int = 4) -> DataFrame:
    """Mean of each metric over finite values by model, to significant digits; a metric without values gives no row."""
    from assay.functions.scalars import significant

    pairs = ", ".join(f"'{m}', double({m})" for m in metrics)
    long = rows.select("model_key", F.expr(f"stack({len(metrics)}, {pairs}) AS (metric, value)"))
    return long.withColumn("value", finite(F.col("value"))).where("value IS NOT NULL").groupBy("model_key", "metric").agg(significant(F.avg("value"), digits).alias("value"))


def merge_segments(segments: DataFrame, strict: bool = False) -> DataFrame:
    """Run metadata over segments (run_id, ordinal, hardware, run_time_sec, max_rss_gb, versions map, completed_at, hostname).

    The first hardware, summed seconds and largest memory; a cost stays only if all segments report
    it, versions only if all agree (in strict mode a difference raises), the latest end, sorted hosts.
    """
    full = lambda c, f: F.when(F.count(c) == F.count("*"), f(c)).alias(c)
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("versions"))))
    out = segments.withColumn("v", text).groupBy("run_id").agg(
        F.min_by("hardware", F.when(F.col("hardware").isNotNull(), F.col("ordinal"))).alias("hardware"), full("run_time_sec", F.sum), full("max_rss_gb", F.max),
        F.count_distinct("v").alias("n_versions"), F.max("v").alias("versions"), F.max("completed_at").alias("completed_at"), F.array_sort(F.collect_set("hostname")).alias("hosts"),
    )
    differ = F.raise_error(F.lit("versions differ between segments")).cast("string") if strict else F.lit(None).cast("string")
    return out.withColumn("versions", F.when(F.col("n_versions") > 1, differ).otherwise(F.col("versions"))).drop("n_versions")


def scatter(rows: DataFrame, axes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Models with finite values on all axes, and how many models have each property."""
    clean = rows.withColumns({a: finite(F.col(a)) for a in axes})
    counts = clean.agg(*(F.count(a).alias(a) for a in axes))
    return clean.dropna(subset=axes), counts


def staircase(rows: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Corners of the line through the Pareto points, from left to right: (keys, x, y, part).

    Between two points it goes on at the first one's y and then steps; part is 0 for the corner
    ahead of a point and 1 for the point. Groups with fewer than two points give no rows.
    """
    keys = keys or []
    every = Window.partitionBy(*keys)
    points = pareto(rows, x, y, keys).select(*keys, F.col(x).alias("x"), F.col(y).alias("y")).distinct().withColumn("n", F.count("*").over(every)).where("n > 1")
    points = points.withColumn("before", F.lag("y").over(every.orderBy("x")))
    corners = points.where("before IS NOT NULL").select(*keys, "x", F.col("before").alias("y"), F.lit(0).alias("part"))
    return corners.unionByName(points.select(*keys, "x", "y", F.lit(1).alias("part")))


def rank_shifts(rows: DataFrame, a: str, b: str) -> DataFrame:
    """How far each model moves between the ranks of two metrics, and Spearman's correlation without it.

    rows has one row per model: (model_key, rank_a, rank_b, shift, spearman_without). Leaving a model out
    pairs all models with all, of which there are some tens.
    """
    rows = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select("model_key", F.col(a).alias("a"), F.col(b).alias("b"))
    rest = rows.select(F.col("model_key").alias("out")).crossJoin(rows).where("out <> model_key")
    rank = lambda c, by: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2.0
    without = rest.withColumns({"ra": rank("a", ["out"]), "rb": rank("b", ["out"])}).groupBy("out").agg(F.corr("ra", "rb").alias("spearman_without"))
    own = rows.select("model_key", rank("a", []).alias("rank_a"), rank("b", []).alias("rank_b"))
    return own.withColumn("shift", F.col("rank_b") - F.col("rank_a")).join(without.withColumnRenamed("out", "model_key"), "model_key", "left")
