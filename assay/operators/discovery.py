"""Alignment of many models' predictions with a reference table, and discovery metrics.

Inputs are long: ``materials(material_id, ordinal, e_form_dft, each_true, uniq_proto, ...)`` and
``preds(model_key, material_id, e_form_pred)``. All models are processed in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.scalars import MAX_ERROR, STABLE, ratio, round_even, stability_class, without_outliers
from assay.operators.histograms import data_range_histogram
from assay.operators.prefix import prefix_sums, top_rows
from assay.sources.shared import written

SUBSETS = ("full_test_set", "uniq_protos", "most_stable")


def align(materials: DataFrame, preds: DataFrame, max_error: float | None = MAX_ERROR) -> DataFrame:
    """Every material for every model; absent or outlying predictions are null.

    Adds e_form_pred, err (prediction minus truth) and each_pred (predicted hull distance).
    Predictions for unknown materials are dropped.
    """
    models, on = preds.select("model_key").distinct(), ["model_key", "material_id"]
    # dealt out by name in all shuffle partitions: Spark would merge them by compressed bytes, and a task's rows grow with the input
    n = int(materials.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materials.crossJoin(F.broadcast(models)).repartition(n, *on)  # one row per model
    rows = rows.join(preds.select(*on, "e_form_pred").repartition(n, *on), on, "left")
    pred = without_outliers("e_form_pred", "e_form_dft", max_error) if max_error is not None else F.col("e_form_pred")
    rows = rows.withColumn("e_form_pred", pred).withColumn("err", F.col("e_form_pred") - F.col("e_form_dft"))
    return rows.withColumn("each_pred", F.col("each_true") + F.col("err"))


def align_strict(materials: DataFrame, preds: DataFrame, max_error: float | None = MAX_ERROR) -> DataFrame:
    """As ``align``; a prediction for an unknown material raises when the result is computed."""
    known = materials.select("material_id", F.lit(True).alias("known"))
    unknown = preds.join(known, "material_id", "left").where("known IS NULL").agg(F.count("*").alias("unknown"))
    rows = align(materials, preds, max_error).crossJoin(F.broadcast(unknown))  # one row
    fail = F.raise_error(F.concat(F.col("unknown").cast("string"), F.lit(" predictions for unknown materials")))
    return rows.where(F.when(F.col("unknown") > 0, fail.cast("boolean")).otherwise(True)).drop("unknown")


def with_class(rows: DataFrame, threshold: float = STABLE, fill_missing: bool = True) -> DataFrame:
    return rows.withColumn("outcome", stability_class("each_true", "each_pred", threshold, fill_missing))


def select_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of listed ids (material_id, position), in the list's order."""
    return rows.join(ids, "material_id").orderBy("position")


def _counts() -> list[Column]:
    one = lambda k: F.count_if(F.col("outcome") == k).alias(k.lower())
    return [one(k) for k in ("TP", "FN", "FP", "TN")]


def _error_sums() -> list[Column]:
    p = F.col("each_pred").isNotNull() & F.col("each_true").isNotNull()
    err, true = F.when(p, F.col("each_pred") - F.col("each_true")), F.when(p, F.col("each_true"))
    return [
        F.count(err).alias("n_pairs"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.sum(err * err).alias("ss_res"),
        (F.var_pop(true) * F.count(true)).alias("ss_tot"),
        F.count_if(F.col("each_pred").isNull()).alias("missing_preds"),
    ]


def classification_rates(rows: DataFrame, prevalence: Column | None = None) -> DataFrame:
    """Rates from tp, fn, fp, tn; undefined ones are null. ``prevalence`` replaces that of the rows in daf."""
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    rows = rows.withColumns({
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "fpr": ratio(fp, fp + tn), "tnr": ratio(tn, fp + tn),
        "fnr": ratio(fn, tp + fn), "accuracy": ratio(tp + tn, tp + tn + fp + fn), "prevalence": ratio(tp + fn, tp + tn + fp + fn),
    })
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rows.withColumns({"f1": f1, "daf": ratio("precision", F.col("prevalence") if prevalence is None else prevalence)})


def metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Confusion counts, rates, MAE, RMSE and R2 by ``keys``; rows come from ``with_class``."""
    out = rows.groupBy(*keys).agg(*_counts(), *_error_sums())
    r2 = F.when(F.col("n_pairs") < 2, None).when(F.col("ss_tot") == 0, F.when(F.col("ss_res") == 0, 1.0).otherwise(0.0)).otherwise(1 - ratio("ss_res", "ss_tot"))
    return classification_rates(out.withColumn("r2", r2)).drop("ss_res", "ss_tot")


def most_stable(rows: DataFrame, k: int = 10_000) -> DataFrame:
    """Of each model's unique prototypes the k lowest predicted distances, nulls last, ties by ordinal."""
    return top_rows(rows.where("uniq_proto"), ["model_key"], [F.col("each_pred").asc_nulls_last(), F.col("ordinal")], k).drop("place")


def by_subset(rows: DataFrame, k: int = 10_000) -> DataFrame:
    """Rows of all three subsets, which overlap, with a column ``subset``."""
    top = most_stable(rows, k).select("model_key", "material_id", F.lit(SUBSETS[2]).alias("__top"))
    names = F.array(F.lit(SUBSETS[0]), F.when(F.col("uniq_proto"), SUBSETS[1]), F.col("__top"))
    rows = rows.join(top, ["model_key", "material_id"], "left").withColumn("subset", F.explode(names))
    return rows.where("subset IS NOT NULL").drop("__top")


def unique_prevalence(materials: DataFrame, threshold: float = STABLE) -> DataFrame:
    """Share of stable unique prototypes, one row, from unrounded distances."""
    return materials.where("uniq_proto").agg(F.avg((F.col("each_true") <= threshold).cast("double")).alias("unique_prevalence"))


def subset_metrics(materials: DataFrame, preds: DataFrame, k: int = 10_000, digits: int | None = 3) -> DataFrame:
    """Metrics by model and subset; daf of the two narrower subsets is against all unique prototypes."""
    out = metrics(by_subset(with_class(align(materials, preds)), k), ["model_key", "subset"])
    out = out.crossJoin(F.broadcast(unique_prevalence(materials)))  # one row
    daf = F.when(F.col("subset") == SUBSETS[0], F.col("daf")).otherwise(ratio("precision", "unique_prevalence"))
    out = out.withColumn("daf", daf).drop("unique_prevalence")
    if digits is not None:
        out = out.select(*(round_even(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes))
    return out


def mean_error_of_models(rows: DataFrame) -> DataFrame:
    """Mean absolute error over models for each material; missing predictions are skipped."""
    return rows.groupBy("material_id").agg(F.avg(F.abs("err")).alias("mean_abs_err"), F.count("err").alias("n_models"))


def cumulative_curve(rows: DataFrame, samples: int = 100) -> DataFrame:
    """Cumulative precision and recall down each model's ranking of predicted-stable materials.

    Ties go by material_id. Points are the ``samples`` ranks that are evenly spaced in log2, and
    the last rank. A model with fewer than two predicted-stable materials raises.
    """
    rows = written(rows.select("model_key", "material_id", "each_true", "each_pred"), "aligned")  # sizes, cuts and ranges all read them
    hit, called = (F.col("each_true") <= STABLE).cast("long"), F.col("each_pred") <= STABLE
    size = rows.groupBy("model_key").agg(F.sum(hit).alias("positives"), F.count_if(called).alias("n"))
    rows = prefix_sums(rows.where(called), "each_pred", {"rank": F.lit(1).cast("long"), "hits": hit}, ["model_key"], ["material_id"])
    rows = rows.join(F.broadcast(size), "model_key")  # one row per model
    enough = F.when(F.col("n") < 2, F.raise_error(F.lit("fewer than two predicted stable")).cast("boolean")).otherwise(True)
    step = F.log2(F.col("n").cast("double")) / (samples - 1)
    # a rank is sampled if the integer part of some power hits it
    k = F.ceil(F.log2(F.col("rank").cast("double")) / step - 1e-9)
    sampled = (F.col("rank") == F.col("n")) | (F.floor(F.pow(F.lit(2.0), k * step) + 1e-9) == F.col("rank"))
    return rows.where(enough).where(sampled).select("model_key", "rank", ratio("hits", "rank").alias("precision"), ratio("hits", "positives").alias("recall"))


def _score_counts(rows: DataFrame) -> DataFrame:
    """Positives and negatives at each distinct score: (model_key, score, p, n)."""
    positive = F.coalesce(F.col("each_true") > 0, F.lit(False))
    by = rows.where("each_pred IS NOT NULL").groupBy("model_key", F.col("each_pred").alias("score"))
    return by.agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))


def roc_points(rows: DataFrame) -> DataFrame:
    """Cumulative counts at each distinct score, from the highest: (model_key, score, tpr, fpr).

    Positives are truths above 0; null truth is negative; rows without a score are left out.
    """
    by = _score_counts(rows)
    size = by.groupBy("model_key").agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    by = prefix_sums(by, "score", {"up_p": F.col("p"), "up_n": F.col("n")}, ["model_key"], descending=True)
    by = by.join(F.broadcast(size), "model_key")  # one row per model
    return by.select("model_key", "score", ratio("up_p", "all_p").alias("tpr"), ratio("up_n", "all_n").alias("fpr"))


def roc_curve(rows: DataFrame) -> DataFrame:
    """Corners of the staircase, (0, 0) without a score first: (model_key, score, tpr, fpr).

    The first and last scores stay, and of the others those at which a step differs from the next, in positives or
    negatives. A step's counts are the score's own, so only the following score is looked at, across ranges.
    """
    by = written(_score_counts(rows), "score-counts")  # sizes and sums both read them
    size = by.groupBy("model_key").agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"), F.max("score").alias("top"))
    by = prefix_sums(by, "score", {"up_p": F.col("p"), "up_n": F.col("n")}, ["model_key"], descending=True, following={"next_p": F.col("p"), "next_n": F.col("n")})
    by = by.join(F.broadcast(size), "model_key")  # one row per model
    by = by.where("next_p IS NULL OR score = top OR next_p <> p OR next_n <> n")
    out = by.select("model_key", "score", ratio("up_p", "all_p").alias("tpr"), ratio("up_n", "all_n").alias("fpr"))
    return size.select("model_key", F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr")).unionByName(out)


def roc_auc(rows: DataFrame) -> DataFrame:
    """Area under the full staircase, two decimals.

    The area is a sum over scores of n * (p above + p / 2), so it needs no neighbours.
    """
    by = prefix_sums(_score_counts(rows), "score", {"up": F.col("p")}, ["model_key"], descending=True)
    area = by.groupBy("model_key").agg(F.sum(F.col("n") * (F.col("up") - F.col("p") / 2)).alias("a"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return area.select("model_key", round_even(ratio("a", F.col("p").cast("double") * F.col("n")), 2).alias("auc"))


def rolling_mae(rows: DataFrame, low: float = -0.2, high: float = 0.2, centres: int = 80, width: float = 0.04) -> DataFrame:
    """Mean absolute error in half-open windows (c - w/2, c + w/2] around evenly spaced centres.

    A row goes to its windows by arithmetic on the centres' numbers, at most width/step + 1 of them.
    """
    step = (high - low) / (centres - 1)
    first, last = F.ceil((F.col("each_true") - width / 2 - low) / step - 1), F.floor((F.col("each_true") + width / 2 - low) / step + 1)
    first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(centres - 1))
    near = rows.where("err IS NOT NULL").where(first <= last).withColumn("i", F.explode(F.sequence(first, last)))
    centre = F.lit(low) + F.col("i") * step
    near = near.withColumn("centre", centre).where((F.col("each_true") > F.col("centre") - width / 2) & (F.col("each_true") <= F.col("centre") + width / 2))
    out = near.groupBy("model_key", "i", "centre").agg(F.avg(F.abs("err")).alias("mae"), F.stddev_samp(F.abs("err")).alias("std"), F.count("*").alias("n"))
    return out.withColumn("sem", ratio("std", F.sqrt(F.col("n").cast("double")))).drop("std")


def error_quantiles(rows: DataFrame, levels: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Exact quantiles of each model's error, by linear interpolation: (model_key, quantiles).

    Values are counted and ranked over ranges, and each level reads its two neighbours, so no task
    holds a model's errors.
    """
    by = rows.where("err IS NOT NULL").groupBy("model_key", "err").agg(F.count("*").alias("c"))
    size = by.groupBy("model_key").agg((F.sum("c") - 1).alias("last"))
    by = prefix_sums(by, "err", {"upto": F.col("c")}, ["model_key"]).join(F.broadcast(size), "model_key")  # one row per model
    wanted = F.filter(F.array(*map(F.lit, levels)), lambda q: (F.floor(q * F.col("last")) < F.col("upto")) & (F.ceil(q * F.col("last")) >= F.col("upto") - F.col("c")))
    near = by.withColumn("q", F.explode(wanted)).groupBy("model_key", "q", "last").agg(F.min("err").alias("lo"), F.max("err").alias("hi"))
    place = F.col("q") * F.col("last")
    value = F.col("lo") + (place - F.floor(place)) * (F.col("hi") - F.col("lo"))
    found = near.groupBy("model_key").agg(F.array_sort(F.collect_list(F.struct("q", value.alias("v")))).alias("found"))  # one entry per level
    return found.select("model_key", F.col("found.v").alias("quantiles"))


def extreme_errors(rows: DataFrame, k: int, largest: bool = True) -> DataFrame:
    """Each model's k largest or smallest absolute errors; the first row wins ties."""
    size = F.abs("err")
    return top_rows(rows.where("err IS NOT NULL"), ["model_key"], [size.desc() if largest else size.asc(), F.col("ordinal")], k)


def end_histograms(rows: DataFrame, value: str, k: int = 1000, bins: int = 100) -> DataFrame:
    """Histograms of a column over each model's k smallest (``min``) and largest (``max``) absolute errors, each over its own range.

    Returns (model_key, side, bin, count, centre).
    """
    sides = [extreme_errors(rows, k, largest).withColumn("side", F.lit(name)) for name, largest in (("min", False), ("max", True))]
    return data_range_histogram(sides[0].unionByName(sides[1]), value, bins, ["model_key", "side"])


def worst_mae(rows: DataFrame, k: int = 100) -> DataFrame:
    return extreme_errors(rows, k).groupBy("model_key").agg(F.avg(F.abs("err")).alias("mae"), F.count("*").alias("n"))


def errors_at_top(rows: DataFrame, materials: DataFrame, by: str, k: int = 1000) -> DataFrame:
    """MAE of each model on the k materials with the largest ``by``, ties by ordinal."""
    top = materials.orderBy(F.col(by).desc_nulls_last(), "ordinal").limit(k).select("material_id")
    return rows.join(F.broadcast(top), "material_id").groupBy("model_key").agg(F.avg(F.abs("err")).alias("mae"), F.count("err").alias("n"))  # k rows


def duplicate_prototypes(materials: DataFrame, proto: str = "proto_id", energy: str = "each_true") -> DataFrame:
    """Mark all but the lowest-energy row of each prototype, ties by ordinal; ordinals are unique, null energies come first.

    The lowest row is an aggregate, so a prototype that very many rows have is no single task's.
    """
    first = materials.groupBy(F.col(proto).alias("__proto")).agg(F.min(F.struct(energy, "ordinal"))["ordinal"].alias("__first"))
    rows = materials.join(first, F.col(proto).eqNullSafe(F.col("__proto")))
    return rows.withColumn("is_duplicate", F.col("ordinal") != F.col("__first")).drop("__proto", "__first")


def quality_counts(materials: DataFrame) -> DataFrame:
    """Stable share, the MAE of predicting the mean, and rows further than 0.1 from the decomposition energy above 0, one row.

    The last needs columns e_hull and e_decomp, and is null without them.
    """
    mean = materials.agg(F.avg("each_true").alias("mean"))
    rows = materials.crossJoin(F.broadcast(mean))  # one row
    apart = F.lit(None).cast("long")
    if {"e_hull", "e_decomp"} <= {*materials.columns}:
        apart = F.count_if(F.col("e_hull") - F.greatest(F.col("e_decomp"), F.lit(0.0)) > 0.1)
    return rows.agg(
        apart.alias("n_apart"), F.count("*").alias("n"), F.avg((F.col("each_true") <= STABLE).cast("double")).alias("stable_share"), F.avg(F.abs(F.col("each_true") - F.col("mean"))).alias("dummy_mae")
    )


def parity_statistics(rows: DataFrame, x: str = "e_form_dft", y: str = "e_form_pred") -> DataFrame:
    """MAE and R2 of plotted points by model; points need both values."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = F.col(y) - F.col(x)
    out = both.groupBy("model_key").agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"), F.sum(d * d).alias("res"), (F.var_pop(x) * F.count("*")).alias("tot"))
    return out.select("model_key", "n", "mae", (1 - ratio("res", "tot")).alias("r2"))
