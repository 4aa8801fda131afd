"""Queries by name, with the SQL that gives the same rows.

Each query runs operators over the whole of the given tables, seen through the views in ``views``.
Sums of doubles are rounded, because engines add in different orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions import scalars as S
from assay.operators import composition as C
from assay.operators import curves as K
from assay.operators import datasets as B
from assay.operators import discovery as D
from assay.operators import distances as A
from assay.operators import gates as V
from assay.operators import histograms as H
from assay.operators import kappa as Q
from assay.operators import leaderboard as L
from assay.operators import partition as P
from assay.operators import trajectories as T
from assay.plans.registry import QUERIES, SQL, query, six
from assay.plans.views import sql_with, view
from assay.operators import fitting as M
from assay.sources import payloads as Y
from assay.sources.shared import shared_path
from assay.streaming import events as R

_ALIGNED = """, models AS (SELECT DISTINCT model_key FROM preds), aligned AS (
  SELECT r.*, k.model_key, CASE WHEN abs(p.e_form_pred - r.e_form_dft) > 5e0 THEN NULL ELSE p.e_form_pred END AS e_form_pred
  FROM materials r CROSS JOIN models k LEFT JOIN preds p ON p.model_key = k.model_key AND p.material_id = r.material_id
), rows_ AS (
  SELECT *, e_form_pred - e_form_dft AS err, each_true + (e_form_pred - e_form_dft) AS each_pred FROM aligned
), classed AS (
  SELECT *, CASE WHEN each_true <= 0 AND coalesce(each_pred <= 0, false) THEN 'TP' WHEN each_true <= 0 THEN 'FN'
    WHEN coalesce(each_pred <= 0, false) THEN 'FP' ELSE 'TN' END AS outcome FROM rows_)
"""

_METRICS = """count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FN') AS fn, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'TN') AS tn,
  count(err) AS n_pairs, avg(abs(each_pred - each_true)) AS mae, sqrt(avg((each_pred - each_true) * (each_pred - each_true))) AS rmse, count(*) FILTER (each_pred IS NULL) AS missing_preds,
  1 - sum((each_pred - each_true) * (each_pred - each_true)) / (var_pop(CASE WHEN each_pred IS NOT NULL THEN each_true END) * count(err)) AS r2"""

_RATES = """tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, fp / (fp + tn) AS fpr, tn / (fp + tn) AS tnr, fn / (tp + fn) AS fnr,
  (tp + tn) / (tp + tn + fp + fn) AS accuracy, (tp + fn) / (tp + tn + fp + fn) AS prevalence,
  2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) AS f1"""


@query("materials preds", _ALIGNED + f", m AS (SELECT model_key, {_METRICS} FROM classed GROUP BY model_key), r AS (SELECT *, {_RATES} FROM m) "
       "SELECT model_key, tp, fn, fp, tn, n_pairs, missing_preds, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2, round(precision, 6) AS precision, round(recall, 6) AS recall, "
       "round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(precision / prevalence, 6) AS daf FROM r")  # fmt: skip
def discovery_metrics(materials, preds):
    out = D.metrics(D.with_class(D.align(materials, preds)), ["model_key"])
    return out.select("model_key", "tp", "fn", "fp", "tn", "n_pairs", "missing_preds", *(six(c).alias(c) for c in ("mae", "rmse", "r2", "precision", "recall", "accuracy", "f1", "daf")))


@query("materials preds", _ALIGNED + f""", top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_key ORDER BY each_pred NULLS LAST, ordinal) AS place FROM classed WHERE uniq_proto) WHERE place <= 500
), u AS (SELECT 'full_test_set' AS subset, * FROM classed UNION ALL SELECT 'uniq_protos', * FROM classed WHERE uniq_proto UNION ALL SELECT 'most_stable', * EXCLUDE (place) FROM top),
m AS (SELECT model_key, subset, {_METRICS} FROM u GROUP BY ALL), r AS (SELECT *, {_RATES} FROM m),
p AS (SELECT avg(CAST(each_true <= 0 AS DOUBLE)) AS up FROM materials WHERE uniq_proto)
SELECT model_key, subset, tp, fn, fp, tn, missing_preds, round_even(mae * 1e3, 0) / 1e3 AS mae, round_even(f1 * 1e3, 0) / 1e3 AS f1,
  round_even(precision / CASE WHEN subset = 'full_test_set' THEN prevalence ELSE up END * 1e3, 0) / 1e3 AS daf FROM r, p""")
def subset_metrics(materials, preds):
    return D.subset_metrics(materials, preds, k=500).select("model_key", "subset", "tp", "fn", "fp", "tn", "missing_preds", "mae", "f1", "daf")


@query("materials preds", _ALIGNED + "SELECT material_id, round(avg(abs(err)), 9) AS mean_abs_err, count(err) AS n_models FROM rows_ GROUP BY material_id")
def model_mean_errors(materials, preds):
    return D.mean_error_of_models(D.align(materials, preds)).withColumn("mean_abs_err", F.round("mean_abs_err", 9))


@query("materials preds", _ALIGNED + """SELECT model_key, score, round(sum(p) OVER w / sum(p) OVER (PARTITION BY model_key), 9) AS tpr, round(sum(n) OVER w / sum(n) OVER (PARTITION BY model_key), 9) AS fpr
FROM (SELECT model_key, each_pred AS score, count(*) FILTER (each_true > 0) AS p, count(*) FILTER (NOT each_true > 0) AS n FROM rows_ WHERE each_pred IS NOT NULL GROUP BY ALL)
WINDOW w AS (PARTITION BY model_key ORDER BY score DESC)""")
def roc_points(materials, preds):
    return D.roc_points(D.align(materials, preds)).select("model_key", "score", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


@query("materials preds")
def roc_corners(materials, preds):
    return D.roc_curve(D.align(materials, preds))


@query("materials preds", _ALIGNED + """, g AS (SELECT model_key, each_pred AS score, count(*) FILTER (each_true > 0) AS p, count(*) FILTER (NOT each_true > 0) AS n FROM rows_ WHERE each_pred IS NOT NULL GROUP BY ALL),
c AS (SELECT model_key, score, sum(p) OVER w / sum(p) OVER (PARTITION BY model_key) AS t, sum(n) OVER w / sum(n) OVER (PARTITION BY model_key) AS f FROM g WINDOW w AS (PARTITION BY model_key ORDER BY score DESC))
SELECT model_key, round_even(sum(a) * 1e2, 0) / 1e2 AS auc FROM (
  SELECT model_key, (f - coalesce(lag(f) OVER w, 0)) * (t + coalesce(lag(t) OVER w, 0)) / 2 AS a FROM c WINDOW w AS (PARTITION BY model_key ORDER BY score DESC)) GROUP BY model_key""")
def roc_auc(materials, preds):
    return D.roc_auc(D.align(materials, preds))


@query("materials preds")
def cumulative_precision_recall(materials, preds):
    return D.cumulative_curve(D.align(materials, preds))


@query("materials preds", _ALIGNED + """, c AS (SELECT i, -2e-1 + i * (4e-1 / 79) AS centre FROM range(80) t(i))
SELECT model_key, CAST(i AS BIGINT) AS i, round(centre, 9) AS centre, round(avg(abs(err)), 12) AS mae, count(*) AS n FROM rows_ JOIN c ON each_true > centre - 4e-2 / 2 AND each_true <= centre + 4e-2 / 2
WHERE err IS NOT NULL GROUP BY ALL""")
def rolling_mae(materials, preds):
    return D.rolling_mae(D.align(materials, preds)).select("model_key", F.col("i").cast("long").alias("i"), F.round("centre", 9).alias("centre"), F.round("mae", 12).alias("mae"), "n")


@query("materials preds", _ALIGNED + "SELECT model_key, " + ", ".join(f"round(quantile_cont(err, {x}), 9) AS q{int(float(x) * 100):02d}" for x in ("0.05", "0.25", "0.5", "0.75", "0.95")) + " FROM rows_ GROUP BY model_key")
def error_quantiles(materials, preds):
    names = ("q05", "q25", "q50", "q75", "q95")
    return D.error_quantiles(D.align(materials, preds)).select("model_key", *(F.round(F.get("quantiles", F.lit(i)), 9).alias(n) for i, n in enumerate(names)))


@query("materials preds", _ALIGNED + """SELECT model_key, material_id, round(abs(err), 9) AS abs_err, CAST(place AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY model_key ORDER BY abs(err) DESC, ordinal) AS place FROM rows_ WHERE err IS NOT NULL) WHERE place <= 100""")
def worst_errors(materials, preds):
    return D.extreme_errors(D.align(materials, preds), 100).select("model_key", "material_id", F.round(F.abs("err"), 9).alias("abs_err"), "place")


@query("materials preds", _ALIGNED + """, t AS (SELECT material_id FROM materials ORDER BY e_form_dft DESC, ordinal LIMIT 1000)
SELECT model_key, round(avg(abs(err)), 6) AS mae, count(err) AS n FROM rows_ JOIN t USING (material_id) GROUP BY model_key""")
def errors_at_top(materials, preds):
    return D.errors_at_top(D.align(materials, preds), materials, "e_form_dft").select("model_key", six("mae").alias("mae"), "n")


@query("materials", """SELECT material_id, row_number() OVER (PARTITION BY proto_id ORDER BY each_true, ordinal) > 1 AS is_duplicate FROM materials""")
def duplicate_prototypes(materials):
    return D.duplicate_prototypes(materials).select("material_id", "is_duplicate")


@query("materials", """SELECT count(*) AS n, round(avg(CAST(each_true <= 0 AS DOUBLE)), 6) AS stable_share, round(avg(abs(each_true - (SELECT avg(each_true) FROM materials))), 6) AS dummy_mae FROM materials""")
def quality_counts(materials):
    return D.quality_counts(materials).select("n", six("stable_share").alias("stable_share"), six("dummy_mae").alias("dummy_mae"))


@query("materials preds", _ALIGNED + """, f AS (SELECT model_key, e_form_dft AS x, e_form_pred AS y FROM rows_ WHERE e_form_pred IS NOT NULL)
SELECT model_key, count(*) AS n, round(avg(abs(y - x)), 6) AS mae, round(1 - sum((y - x) * (y - x)) / (var_pop(x) * count(*)), 6) AS r2 FROM f GROUP BY model_key""")
def parity_statistics(materials, preds):
    return D.parity_statistics(D.align(materials, preds)).select("model_key", "n", six("mae").alias("mae"), six("r2").alias("r2"))


_BINS = """CASE WHEN {x} BETWEEN {lo} AND {hi} THEN CAST(least(floor(({x} - {lo}) / {w}), {n} - 1) AS INTEGER)
  - CASE WHEN {x} < {lo} + least(floor(({x} - {lo}) / {w}), {n} - 1) * {w} THEN 1 WHEN {x} >= {lo} + (least(floor(({x} - {lo}) / {w}), {n} - 1) + 1) * {w} AND least(floor(({x} - {lo}) / {w}), {n} - 1) < {n} - 1 THEN -1 ELSE 0 END END"""


@query("materials preds", _ALIGNED + f""", b AS (SELECT model_key, outcome, {_BINS.format(x='each_pred', lo='-45e-2', hi='45e-2', w='(9e-1 / 64)', n=64)} AS bin FROM classed),
e AS (SELECT DISTINCT model_key, outcome, CAST(i AS INTEGER) AS bin FROM classed, range(64) t(i))
SELECT e.model_key, e.outcome, e.bin, count(b.bin) AS count FROM e LEFT JOIN b USING (model_key, outcome, bin) GROUP BY ALL""")
def error_histograms(materials, preds):
    rows = D.with_class(D.align(materials, preds))
    return H.histogram(rows, "each_pred", -0.45, 0.45, 64, ["model_key", "outcome"]).drop("centre")


@query("materials")
def hull_distance_histogram(materials):
    return H.deviation_histogram(materials, "each_true").select("bin", six("edge").alias("edge"), "count", "stable")


@query("materials", f"""SELECT CAST(i AS INTEGER) AS bin, count(bin) AS count, round(sum(count(bin)) OVER (ORDER BY i) / sum(count(bin)) OVER (), 9) AS cumulative FROM range(300) t(i) LEFT JOIN (
  SELECT {_BINS.format(x='e_form_dft', lo='-55e-1', hi='55e-1', w='(11e0 / 300)', n=300)} AS bin FROM materials) b ON b.bin = i GROUP BY i""")
def energy_histogram(materials):
    counts = H.histogram(materials, "e_form_dft", -5.5, 5.5, 300)
    return H.cumulative_share(counts).select("bin", "count", F.round("cumulative", 9).alias("cumulative"))


# compositions


@query("materials preds composition", _ALIGNED + """SELECT model_key, element, round(avg(amount * abs(err)), 6) AS weighted_error, round(coalesce(sum(abs(err)), 0) / count(*), 6) AS presence_error, count(*) AS n
FROM rows_ JOIN composition USING (material_id) GROUP BY model_key, element""")
def element_errors(materials, preds, composition):
    out = C.element_errors(D.align(materials, preds), composition)
    return out.select("model_key", "element", six("weighted_error").alias("weighted_error"), six("presence_error").alias("presence_error"), "n")


@query("materials preds composition", _ALIGNED + """, e AS (SELECT model_key, element, coalesce(sum(abs(err)), 0) / count(*) AS pe FROM rows_ JOIN composition USING (material_id) GROUP BY ALL),
s AS (SELECT element, stddev_samp(each_true) AS sp FROM composition JOIN materials USING (material_id) GROUP BY element)
SELECT model_key, element, round(pe / nullif(sp, 0), 6) AS normal_error FROM e LEFT JOIN s USING (element)""")
def normal_element_errors(materials, preds, composition):
    errors = C.element_errors(D.align(materials, preds), composition)
    return C.normal_errors(errors, C.element_spread(materials, composition)).select("model_key", "element", six("normal_error").alias("normal_error"))


@query("materials composition", """, a AS (SELECT c.*, step, count(*) OVER (PARTITION BY material_id) AS arity FROM composition c JOIN materials USING (material_id))
SELECT 'all' AS slice, 0 AS value, element, count(*) AS count FROM a GROUP BY ALL UNION ALL SELECT 'step', step, element, count(*) FROM a GROUP BY ALL UNION ALL SELECT 'arity', arity, element, count(*) FROM a GROUP BY ALL""")
def element_counts(materials, composition):
    return C.element_counts(composition, materials)


@query("materials composition", """, h AS (SELECT element, count(*) FILTER (step <= 2) AS a, count(*) FILTER (step > 2) AS b FROM composition JOIN materials USING (material_id) GROUP BY element),
n AS (SELECT count(*) FILTER (step <= 2) AS na, count(*) FILTER (step > 2) AS nb FROM materials)
SELECT element, a, b, round(a * 100e0 / na, 9) AS a_per_100, round(b * 100e0 / nb, 9) AS b_per_100, round((a / na) / nullif(b / nb, 0), 9) AS ratio FROM h, n WHERE a + b > 10""")
def element_count_comparison(materials, composition):
    early = materials.where("step <= 2")
    rows = composition.join(materials.select("material_id", "step"), "material_id")
    a, b = (rows.where(x).groupBy("element").agg(F.count("*").alias("count")) for x in ("step <= 2", "step > 2"))
    na, nb = early.count(), materials.where("step > 2").count()
    return C.compare_counts(a, b, na, nb).select("element", "a", "b", *(F.round(c, 9).alias(c) for c in ("a_per_100", "b_per_100", "ratio")))


@query("composition", """SELECT arity, count(*) AS count, round(count(*) / (SELECT count(DISTINCT material_id) FROM composition), 9) AS share
FROM (SELECT material_id, count(*) AS arity FROM composition GROUP BY ALL) GROUP BY arity HAVING arity <= 6""")
def arity_shares(composition):
    return C.arity_shares(composition).withColumn("share", F.round("share", 9))


@query("materials composition", """, one AS (SELECT material_id, min(element) AS element, min(amount) AS amount FROM composition GROUP BY material_id HAVING count(*) = 1),
e AS (SELECT element, material_id, e_form_dft / amount AS e FROM one JOIN materials USING (material_id))
SELECT element, material_id, round(e, 9) AS e_ref FROM (SELECT *, row_number() OVER (PARTITION BY element ORDER BY e, material_id) AS r FROM e) WHERE r = 1""")
def elemental_references(materials, composition):
    entries = materials.select("material_id", F.col("e_form_dft").alias("energy"))
    return C.elemental_references(entries, composition).withColumn("e_ref", F.round("e_ref", 9))


@query("materials composition", """, r AS (SELECT element, min(amount) AS e_ref FROM composition GROUP BY element),
s AS (SELECT material_id, sum(amount * e_ref) AS e0, sum(amount) AS n FROM composition JOIN r USING (element) GROUP BY material_id)
SELECT material_id, (e_form_dft - e0) / n AS e_form FROM materials JOIN s USING (material_id)""")
def referenced_energies(materials, composition):
    refs = composition.groupBy("element").agg(F.min("amount").alias("e_ref"))
    return C.referenced_energy(materials.select("material_id", F.col("e_form_dft").alias("energy")), composition, refs)


@query("composition", """SELECT material_id, array_to_string(list(CASE WHEN amount = 1 THEN element ELSE element || CAST(CAST(amount AS BIGINT) AS VARCHAR) END ORDER BY element), ' ') AS formula
FROM composition GROUP BY material_id""")
def alphabetical_formulas(composition):
    maps = composition.groupBy("material_id").agg(F.map_from_entries(F.collect_list(F.struct("element", "amount"))).alias("composition"))
    return B.named_formulas(maps)


@query("composition", """, g AS (SELECT material_id, list(CAST(amount AS BIGINT) ORDER BY element) AS a FROM composition GROUP BY material_id),
d AS (SELECT *, list_reduce(a, lambda x, y: gcd(x, y)) AS k FROM g)
SELECT material_id, array_to_string(list_transform(a, lambda x, i: chr(CAST(64 + i AS INTEGER)) || CASE WHEN x = k THEN '' ELSE CAST(x // k AS VARCHAR) END), '') AS prototype FROM d""")
def prototype_formulas(composition):
    maps = composition.groupBy("material_id").agg(F.map_from_entries(F.collect_list(F.struct("element", "amount"))).alias("composition"))
    return maps.select("material_id", S.prototype_formula("composition").alias("prototype"))


@query("materials", """, s AS (SELECT *, CASE WHEN spg_num <= 2 THEN 'triclinic' WHEN spg_num <= 15 THEN 'monoclinic' WHEN spg_num <= 74 THEN 'orthorhombic' WHEN spg_num <= 142 THEN 'tetragonal'
  WHEN spg_num <= 167 THEN 'trigonal' WHEN spg_num <= 194 THEN 'hexagonal' ELSE 'cubic' END AS system FROM materials)
SELECT system, spg_num, count(*) AS count FROM s GROUP BY ROLLUP (system, spg_num)""")
def space_group_tree(materials):
    return C.space_group_tree(materials)


_SYMMETRY = """, d AS (SELECT model_key, material_id, (p.spg % 230) + 1 AS pred_spg, m.spg_num, ((p.spg % 230) + 1) - m.spg_num AS spg_diff, p.spg % 7 - 3 AS ops_diff,
  CASE WHEN p.spg % 5 = 0 THEN NULL ELSE (p.spg % 100) * 1e-3 END AS rmsd
  FROM (SELECT model_key, material_id, CAST(CASE WHEN material_id % 4 = 0 THEN (material_id * 7) % 230 ELSE 0 END AS BIGINT) + material_id % 3 AS spg FROM preds) p JOIN materials m USING (material_id))
"""


def _symmetry(preds, materials):
    spg = F.expr("bigint(CASE WHEN material_id % 4 = 0 THEN (material_id * 7) % 230 ELSE 0 END) + material_id % 3")
    rows = preds.select("model_key", "material_id", spg.alias("spg")).join(materials.select("material_id", "spg_num"), "material_id")
    return rows.select(
        "model_key", "material_id", (F.col("spg") % 230 + 1).alias("pred_spg"), "spg_num", (F.col("spg") % 230 + 1 - F.col("spg_num")).alias("spg_diff"),
        (F.col("spg") % 7 - 3).alias("ops_diff"), F.when(F.col("spg") % 5 != 0, F.col("spg") % 100 * F.lit(1e-3)).alias("rmsd"),
    )


@query("preds materials", _SYMMETRY + """SELECT model_key, round(avg(coalesce(rmsd, 1)), 6) AS rmsd, round(avg(abs(ops_diff)), 6) AS ops_mae, round(count(*) FILTER (spg_diff <> 0 AND ops_diff < 0) / count(*), 6) AS decreased,
  round(count(*) FILTER (spg_diff = 0) / count(*), 6) AS matched, round(count(*) FILTER (spg_diff <> 0 AND ops_diff > 0) / count(*), 6) AS increased, count(*) AS n FROM d GROUP BY model_key""")
def geometry_metrics(preds, materials):
    return C.geometry_metrics(_symmetry(preds, materials)).select("model_key", *(six(c).alias(c) for c in ("rmsd", "ops_mae", "decreased", "matched", "increased")), "n")


@query("preds materials", _SYMMETRY + """, p AS (SELECT model_key, spg_num AS a, pred_spg AS b, count(*) AS count FROM d GROUP BY ALL),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_key ORDER BY count DESC, a, b) AS r FROM p) WHERE r <= 10),
k AS (SELECT p.* FROM p WHERE EXISTS (SELECT 1 FROM t WHERE t.model_key = p.model_key AND t.a = p.a) AND EXISTS (SELECT 1 FROM t WHERE t.model_key = p.model_key AND t.b = p.b))
SELECT *, CAST(dense_rank() OVER (PARTITION BY model_key ORDER BY a) - 1 AS INTEGER) AS source, CAST(dense_rank() OVER (PARTITION BY model_key ORDER BY b) - 1 AS INTEGER) AS target FROM k""")
def symmetry_flows(preds, materials):
    return C.flows(_symmetry(preds, materials), "spg_num", "pred_spg", ["model_key"])


@query("preds materials", _SYMMETRY + """, s AS (SELECT model_key, stddev_samp(ops_diff) AS spread FROM d GROUP BY model_key)
SELECT model_key, ops_diff AS diff, count(*) AS count, round(any_value(spread), 6) AS spread FROM d JOIN s USING (model_key) GROUP BY ALL""")
def operation_differences(preds, materials):
    return C.difference_counts(_symmetry(preds, materials), "ops_diff").withColumn("spread", six("spread"))


@query("preds materials")
def rmsd_cdf(preds, materials):
    return C.cdf(_symmetry(preds, materials), "rmsd")[0]


# spectra and curves


@query("spectrum", """, u AS (SELECT label, freq AS x, sum(CASE WHEN vec_id % 2 = 0 THEN w ELSE 0 END) AS wu, sum(CASE WHEN vec_id % 2 = 1 THEN w ELSE 0 END) AS wv FROM spectrum GROUP BY ALL),
c AS (SELECT label, abs(sum(wu) OVER o / sum(wu) OVER e - sum(wv) OVER o / sum(wv) OVER e) * coalesce(lead(x) OVER o - x, 0) AS part FROM u WINDOW o AS (PARTITION BY label ORDER BY x), e AS (PARTITION BY label))
SELECT label, round(sum(part), 9) AS w1 FROM c GROUP BY label""")
def spectrum_distance(spectrum):
    rows = spectrum.select("label", F.col("freq").alias("x"), "w", (F.col("vec_id") % 2).alias("side"))
    return A.wasserstein(rows.where("side = 0"), rows.where("side = 1"), ["label"]).withColumn("w1", F.round("w1", 9))


@query("spectrum", """, m AS (SELECT vec_id, freq AS x, sum(w) AS w FROM spectrum GROUP BY ALL),
c AS (SELECT vec_id, x, sum(w) OVER (PARTITION BY vec_id ORDER BY x) / sum(w) OVER (PARTITION BY vec_id) AS f FROM m), l AS (SELECT unnest([5e-2, 25e-2, 5e-1, 75e-2, 95e-2]) AS level)
SELECT vec_id, level, coalesce(min(CASE WHEN f >= level THEN x END), max(x)) AS quantile FROM c, l GROUP BY vec_id, level""")
def spectrum_quantiles(spectrum):
    return A.weighted_quantiles(spectrum.withColumnRenamed("freq", "x"), ["vec_id"], [0.05, 0.25, 0.5, 0.75, 0.95])


@query("spectrum")
def densities_of_states(spectrum):
    return A.density_of_states(spectrum, ["vec_id"]).select("vec_id", "bin", F.round("centre", 9).alias("centre"), F.round("dos", 9).alias("dos"))


@query("curve", """, d AS (SELECT side, curve_id, y, x, abs(y - lag(y) OVER (PARTITION BY side, curve_id ORDER BY x)) AS s FROM curve)
SELECT side, curve_id, round(sum(s) / nullif(abs(min_by(y, x) - min(y)) + abs(max_by(y, x) - min(y)), 0), 6) AS tortuosity, round(coalesce(sum(s), 0), 6) AS total_variation FROM d GROUP BY side, curve_id""")
def curve_roughness(curve):
    keys = ["side", "curve_id"]
    both = K.tortuosity(curve, keys).join(K.total_variation(curve, keys), keys)
    return both.select(*keys, six("tortuosity").alias("tortuosity"), six("total_variation").alias("total_variation"))


@query("curve", """, d AS (SELECT side, curve_id, x, y - lag(y) OVER (PARTITION BY side, curve_id ORDER BY x) AS d FROM curve),
k AS (SELECT *, lag(d) OVER (PARTITION BY side, curve_id ORDER BY x) AS b FROM d WHERE abs(d) >= 1e0 AND d <> 0),
f AS (SELECT side, curve_id, count(*) FILTER (sign(d) <> sign(b)) AS flips, sum(CASE WHEN sign(d) <> sign(b) THEN abs(d) + abs(b) END) AS jump FROM k GROUP BY ALL)
SELECT side, curve_id, coalesce(flips, 0) AS flips, round(coalesce(jump, 0), 6) AS jump FROM (SELECT DISTINCT side, curve_id FROM curve) LEFT JOIN f USING (side, curve_id)""")
def curve_flips(curve):
    return K.flips(curve, ["side", "curve_id"], threshold=1.0).withColumn("jump", six("jump"))


@query("curve", """, k AS (SELECT *, lag(y - 50) OVER (PARTITION BY side, curve_id ORDER BY x) AS b FROM curve WHERE abs(y - 50) >= 1e0)
SELECT side, curve_id, coalesce(n, 0) AS flips FROM (SELECT DISTINCT side, curve_id FROM curve)
LEFT JOIN (SELECT side, curve_id, count(*) FILTER (sign(y - 50) <> sign(b)) AS n FROM k GROUP BY ALL) USING (side, curve_id)""")
def force_direction_flips(curve):
    return K.force_flips(curve.withColumn("y", F.col("y") - 50), ["side", "curve_id"], threshold=1.0)


def _sides(curve):
    """Each other event type against views."""
    pred = curve.where("side <> 'view'")
    kinds = F.broadcast(pred.select("side").distinct())  # one row per event type
    return pred, curve.where("side = 'view'").drop("side").crossJoin(kinds)


@query("curve")
def curve_interpolation(curve):
    pred, true = _sides(curve)
    return A.on_common_grid(pred, true, ["side", "curve_id"], 20).select("side", "curve_id", "i", six("x").alias("x"), six("ya").alias("ya"), six("yb").alias("yb"))


@query("curve")
def curve_metrics(curve):
    pred, true = _sides(curve)
    keys = ["side", "curve_id"]
    out = K.curve_metrics(*(d.withColumn("f", F.col("y") / 10 - 5) for d in (pred, true)), keys)
    return out.select(*keys, *(six(c).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes if c not in keys))


@query("curve", """, m AS (SELECT side, curve_id, x, y, row_number() OVER (PARTITION BY curve_id, round(x, 0) ORDER BY y, side) AS r FROM curve)
SELECT curve_id, round(x, 0) AS x, y, side FROM m WHERE r = 1""")
def minimum_curves(curve):
    rows = curve.withColumn("x", F.floor(F.col("x") + 0.5).cast("double"))
    return K.merge_minimum(rows, ["curve_id"], order="side", digits=0).select("curve_id", "x", "y", "side")


@query("curve", """, n AS (SELECT *, lag(x) OVER w AS x0, lead(x) OVER w AS x1, lag(y) OVER w AS y0, lead(y) OVER w AS y1 FROM curve WINDOW w AS (PARTITION BY side, curve_id ORDER BY x))
SELECT side, curve_id, x, y FROM n WHERE NOT coalesce(y >= greatest(y0, y1) + 2e1 AND y >= y0 + (y1 - y0) * ((x - x0) / (x1 - x0)) + 2e1 AND y0 IS NOT NULL AND y1 IS NOT NULL, false)""")
def curves_without_bumps(curve):
    return K.drop_bumps(curve, ["side", "curve_id"], height=20.0)


@query("curve")
def collapsed_points(curve):
    return K.drop_collapsed(curve, ["side", "curve_id"], drop=40.0)


@query("curve")
def mended_branches(curve):
    rows = curve.select("curve_id", F.floor(F.col("x") * 4).cast("double").alias("x"), "y", F.col("side").alias("branch"))
    return K.replace_branch_drops(rows, ["curve_id"], drop=10.0)


@query("curve", """, s AS (SELECT *, row_number() OVER (PARTITION BY side, curve_id ORDER BY x DESC) AS r, abs(y - lag(y) OVER (PARTITION BY side, curve_id ORDER BY x)) AS d FROM curve)
SELECT side, curve_id, count(*) FILTER (r < 3 AND d >= 1e1) AS tail_jumps FROM s GROUP BY ALL""")
def curve_tail_jumps(curve):
    return K.tail_jumps(curve, ["side", "curve_id"], jump=10.0)


@query("materials preds")
def downsampled_roc(materials, preds):
    corners = D.roc_curve(D.align(materials, preds)).select("model_key", F.col("fpr").alias("x"), F.col("tpr").alias("y"))
    return K.downsample(corners, ["model_key"], 50)


# trajectories

_PAIRS = """, p AS (SELECT a.system, a.frame, sqrt(pow(least(abs(a.x - b.x), 10 - abs(a.x - b.x)), 2) + pow(least(abs(a.y - b.y), 10 - abs(a.y - b.y)), 2) + pow(least(abs(a.z - b.z), 10 - abs(a.z - b.z)), 2)) AS r
  FROM atoms a JOIN atoms b ON a.system = b.system AND a.frame = b.frame AND a.atom < b.atom)
"""


@query("atoms", _PAIRS + f""", c AS (SELECT system, {_BINS.format(x='r', lo='0e0', hi='5e0', w='(5e0 / 20)', n=20)} AS bin FROM p), n AS (SELECT system, bin, count(*) AS n FROM c WHERE bin IS NOT NULL GROUP BY ALL),
s AS (SELECT system, sum(m * m) / 2 AS pairs FROM (SELECT system, frame, CAST(count(*) AS DOUBLE) AS m FROM atoms GROUP BY ALL) GROUP BY system)
SELECT s.system, CAST(i AS INTEGER) AS bin, round((i + 5e-1) * 25e-2, 6) AS r, round(coalesce(n, 0) / (pairs * (4e0 / 3e0 * pi() * (pow((i + 1) * 25e-2, 3) - pow(i * 25e-2, 3))) / 1e3), 6) AS g
FROM s CROSS JOIN range(20) t(i) LEFT JOIN n ON n.system = s.system AND n.bin = i""")
def radial_distribution(atoms):
    return T.rdf(atoms, 10.0, bins=20).select("system", "bin", six("r").alias("r"), six("g").alias("g"))


def _halves(atoms):
    return atoms.where("frame % 2 = 0"), atoms.where("frame % 2 = 1")


@query("atoms")
def radial_distribution_error(atoms):
    a, b = _halves(atoms)
    return T.rdf_error(T.rdf(a, 10.0, 50), T.rdf(b, 10.0, 50)).withColumn("rdf_error", six("rdf_error"))


@query("atoms")
def angular_distribution(atoms):
    return T.adf(atoms, 10.0, 2.0, 36).select("system", "bin", "angle", six("density").alias("density"))


@query("atoms")
def angular_distribution_error(atoms):
    a, b = _halves(atoms)
    return T.adf_error(T.adf(a, 10.0, 2.0, 36), T.adf(b, 10.0, 2.0, 36)).withColumn("adf_error", six("adf_error"))


@query("atoms")
def atom_velocities(atoms):
    return T.velocities(atoms, 10.0, 1.0).select("system", "frame", "atom", *(six(c).alias(c) for c in ("vx", "vy", "vz")))


@query("atoms")
def kinetic_temperatures(atoms):
    masses = atoms.select("system", "atom").distinct().withColumn("mass", F.col("atom") % 5 + F.lit(1.0))
    return T.kinetic_temperature(T.velocities(atoms, 10.0, 100.0), masses).withColumn("temperature", F.round("temperature", 6))


@query("atoms")
def vibrational_spectra(atoms):
    return T.vdos(T.velocities(atoms, 10.0, 1.0), 1.0).select("system", F.round("freq", 9).alias("freq"), F.round("power", 9).alias("power"))


@query("atoms")
def vibrational_error(atoms):
    v = T.velocities(atoms, 10.0, 1.0)
    a, b = v.where("frame % 2 = 0"), v.where("frame % 2 = 1")
    return T.vdos_error(T.vdos(a, 2.0), T.vdos(b, 2.0)).withColumn("vdos_error", six("vdos_error"))


@query("curve", """, p AS (SELECT curve_id % 10 AS system, side, y FROM curve) SELECT system,
  round(abs(avg(CASE WHEN side <> 'view' THEN y END) - avg(CASE WHEN side = 'view' THEN y END)), 6) AS mean_error FROM p GROUP BY system""")
def pressure_means(curve):
    a, b = (curve.where(c).select((F.col("curve_id") % 10).alias("system"), F.col("y").alias("pressure")) for c in ("side <> 'view'", "side = 'view'"))
    return T.pressure_metrics(a, b).select("system", six("mean_error").alias("mean_error"))


@query("curve")
def pressure_errors(curve):
    a, b = (curve.where(c).select((F.col("curve_id") % 10).alias("system"), F.col("y").alias("pressure")) for c in ("side <> 'view'", "side = 'view'"))
    return T.pressure_metrics(a, b).select("system", *(six(c).alias(c) for c in ("mean_error", "w1", "histogram_error")))


# conductivity


@query("spectrum")
def conductivity_metrics(spectrum):
    rows = spectrum.select((F.col("vec_id") % 2).alias("side"), F.expr("vec_id div 2").alias("material_id"), F.expr("pos div 8").alias("q"), (F.col("pos") % 8).alias("b"), F.abs("freq").alias("k"), "w")
    kappa = rows.groupBy("side", "material_id").agg(F.sum("k").alias("kappa"))
    rows = rows.join(kappa, ["side", "material_id"])
    pred, true = rows.where("side = 0").drop("side"), rows.where("side = 1").drop("side")
    pred = pred.withColumn("w", F.col("q") % 3 + F.lit(1.0))
    return Q.srme(pred, true, ["material_id"]).select("material_id", six("srme").alias("srme"))


@query("spectrum", """, k AS (SELECT vec_id // 2 AS material_id, sum(CASE WHEN vec_id % 2 = 0 THEN abs(freq) END) AS p, sum(CASE WHEN vec_id % 2 = 1 THEN abs(freq) END) AS t FROM spectrum GROUP BY ALL)
SELECT material_id, round(abs(2 * (p - t) / (p + t)), 6) AS sre FROM k WHERE p > 0 AND t > 0""")
def conductivity_parity(spectrum):
    k = spectrum.groupBy(F.expr("vec_id div 2").alias("material_id")).agg(F.sum(F.expr("CASE WHEN vec_id % 2 = 0 THEN abs(freq) END")).alias("kappa_pred"), F.sum(F.expr("CASE WHEN vec_id % 2 = 1 THEN abs(freq) END")).alias("kappa_true"))
    return Q.parity_points(k).select("material_id", six("sre").alias("sre"))


# models as rows: suppliers stand for models with several metrics

_BOARD = """, board AS (SELECT model_key, avg(CASE WHEN err IS NOT NULL THEN abs(err) END) AS mae, count(err) AS n, CAST(min(added_at) AS DATE) AS added FROM rows_ GROUP BY model_key)
"""


@query("materials preds", _ALIGNED + """, c AS (SELECT proto_id AS model_key, round(avg(abs(err)), 6) AS mae, round(avg(each_true), 6) AS mean_true, count(err) AS n FROM rows_ GROUP BY proto_id),
l AS (SELECT model_key, 'mae' AS metric, mae AS value FROM c UNION ALL SELECT model_key, 'n', CAST(n AS DOUBLE) FROM c)
SELECT model_key, metric, value, CAST(rank() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'n' THEN -value ELSE value END) AS INTEGER) AS rank, count(*) OVER (PARTITION BY metric) AS n FROM l WHERE value IS NOT NULL""")
def metric_ranks(materials, preds):
    return L.ranks(_cohort(materials, preds), {"mae": False, "n": True})


def _cohort(materials, preds):
    """Prototypes as competing models: one row each with its errors."""
    rows = D.align(materials, preds)
    return rows.groupBy(F.col("proto_id").alias("model_key")).agg(six(F.avg(F.abs("err"))).alias("mae"), six(F.avg("each_true")).alias("mean_true"), F.count("err").alias("n"))


@query("materials preds", _ALIGNED + """, c AS (SELECT proto_id AS model_key, round(avg(abs(err)), 6) AS mae, round(avg(each_true), 6) AS mean_true FROM rows_ GROUP BY proto_id)
SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE (o.mae < c.mae AND o.mean_true <= c.mean_true) OR (o.mae <= c.mae AND o.mean_true < c.mean_true))""")
def pareto_frontier(materials, preds):
    return L.pareto(_cohort(materials, preds).drop("n"), "mae", "mean_true")


@query("materials", """, b AS (SELECT *, max(e_form_dft) OVER (PARTITION BY step ORDER BY added_at, e_form_dft DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM materials)
SELECT step, added_at, e_form_dft FROM b WHERE best IS NULL OR e_form_dft > best""")
def running_best(materials):
    return L.running_best(materials.select("step", "added_at", "e_form_dft"), "added_at", "e_form_dft", ["step"])


@query("materials preds", _ALIGNED + """, c AS (SELECT proto_id AS model_key, round(avg(abs(err)), 6) AS mae, round(avg(each_true), 6) AS mean_true FROM rows_ GROUP BY proto_id)
SELECT round(corr(mae, mean_true), 6) AS pearson, count(*) AS n FROM c WHERE mae IS NOT NULL""")
def metric_association(materials, preds):
    return L.associations(_cohort(materials, preds), "mae", "mean_true").select(six("pearson").alias("pearson"), "n")


@query("materials preds", _ALIGNED + """, c AS (SELECT proto_id AS model_key, count(err) AS n FROM rows_ GROUP BY proto_id)
SELECT model_key, round(CAST(n AS DOUBLE) / (SELECT min(n) FROM c WHERE n > 0), 9) AS slowdown FROM c""")
def slowdown(materials, preds):
    rows = _cohort(materials, preds).withColumn("run_time_sec", F.col("n").cast("double"))
    return L.slowdown(rows).select("model_key", F.round("slowdown", 9).alias("slowdown"))


@query("materials preds")
def combined_scores(materials, preds):
    m = D.metrics(D.with_class(D.align(materials, preds)), ["model_key"])
    rows = m.select("model_key", "f1", F.col("mae").alias("rmsd"), F.col("rmse").alias("kappa_srme"))
    return rows.select("model_key", six(L.combined_score()).alias("cps"))


# gates, digests, partitions and payloads


@query("materials preds", """, h AS (SELECT material_id, count(*) AS n FROM preds GROUP BY material_id)
SELECT coalesce(h.material_id, m.material_id) AS material_id, CASE WHEN n IS NULL THEN 'missing' ELSE 'duplicate' END AS problem, coalesce(n, 0) AS n FROM h FULL JOIN materials m ON m.material_id = h.material_id
WHERE n IS NULL OR n > 1""")
def coverage_problems(materials, preds):
    return V.coverage_problems(preds, materials, ["material_id"])


@query("materials preds", "SELECT DISTINCT material_id FROM materials WHERE material_id NOT IN (SELECT material_id FROM preds)")
def missing_predictions(materials, preds):
    return V.missing_keys(materials, preds, ["material_id"])


@query("materials", "SELECT step, sha256(array_to_string(list(CAST(material_id AS VARCHAR) ORDER BY ordinal), chr(10))) AS digest FROM materials GROUP BY step")
def ordered_digests(materials):
    return V.ordered_digest(materials, ["step"], "material_id", "ordinal")


@query("materials", "SELECT step, sha256(array_to_string(list(CAST(material_id AS VARCHAR) ORDER BY CAST(material_id AS VARCHAR)), chr(10))) AS digest FROM materials GROUP BY step")
def sorted_digests(materials):
    return V.sorted_digest(materials, ["step"], "material_id")


@query("materials", "SELECT material_id, CAST(ntile(7) OVER (ORDER BY ordinal) - 1 AS INTEGER) AS chunk FROM materials")
def equal_chunks(materials):
    return P.equal_chunks(materials, 7).select("material_id", "chunk")


@query("materials", """, s AS (SELECT material_id, coalesce(sum(spg_num) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(spg_num) OVER () AS t FROM materials)
SELECT material_id, CAST(least(6, b * 7 // t) AS INTEGER) AS shard FROM s""")
def balanced_partitions(materials):
    return P.balanced_by_sum(materials, 7, "spg_num", "ordinal").select("material_id", "shard")


@query("materials")
def train_test_split(materials):
    return P.train_test(materials, "material_id").select("material_id", "is_train")


@query("materials", """, a AS (SELECT material_id AS id, e_form_dft AS v FROM materials WHERE step <= 3), b AS (SELECT material_id AS id, each_true AS v FROM materials WHERE step >= 3)
SELECT id, v FROM b UNION ALL SELECT id, v FROM a WHERE id NOT IN (SELECT id FROM b)""")
def payload_upsert(materials):
    a, b = (materials.where(c).select(F.col("material_id").cast("string").alias("id"), F.col(v).alias("v")) for c, v in (("step <= 3", "e_form_dft"), ("step >= 3", "each_true")))
    return Y.upsert(a, b).select(F.col("id").cast("long").alias("id"), "v")


@query("materials", "SELECT material_id, ordinal // 512 AS shard, ordinal // 512 // 50 AS bundle FROM materials")
def parity_shards(materials):
    return Y.row_shards(materials).select("material_id", "shard", "bundle")


@query("materials", """, o AS (SELECT step, count(*) FILTER (spg_num <= 200) AS was, count(*) FILTER (spg_num >= 30) AS now FROM materials GROUP BY ALL)
SELECT CAST(step AS BIGINT) AS payload, count(*) FILTER (spg_num > 200) AS n_added, count(*) FILTER (spg_num < 30) AS n_removed FROM materials GROUP BY step""")
def roster_changes(materials):
    rows = materials.select(F.col("step").cast("long").alias("payload"), F.col("material_id").cast("string").alias("id"), "spg_num")
    out = Y.roster_changes(rows.where("spg_num <= 200"), rows.where("spg_num >= 30"), lists=False)
    return out.select("payload", F.col("n_added").cast("long").alias("n_added"), F.col("n_removed").cast("long").alias("n_removed"))


@query("materials", """, b AS (SELECT *, row_number() OVER (PARTITION BY spg_num, step ORDER BY e_form_dft, material_id) AS r FROM materials)
SELECT spg_num AS formula, step AS thermo_type, e_form_dft AS energy, material_id FROM b WHERE r = 1""")
def lowest_energies(materials):
    return B.lowest_energy(materials.select(F.col("spg_num").alias("formula"), F.col("step").alias("thermo_type"), F.col("e_form_dft").alias("energy"), "material_id"))


# fitting, builds and streams


@query("materials composition")
def forest_baseline(materials, composition):
    """Held-out MAE and R2 of a random forest on composition features."""
    features = composition.groupBy("material_id").agg(F.sum("amount").alias("atoms"), F.count("*").cast("double").alias("arity"), F.max("amount").alias("most"))
    features = features.join(materials.select("material_id", F.col("spg_num").cast("double").alias("spg")), "material_id")
    rows = P.train_test(M.training_rows(features, materials, "material_id", "e_form_dft"), "material_id", 80)
    names = ["atoms", "arity", "most", "spg"]
    model = M.forest(rows.where("is_train"), names, "e_form_dft", trees=20, depth=5)
    out = M.regression_scores(model.transform(rows.where("NOT is_train")), "e_form_dft")
    return out.select("n", *(F.round(c, 3).alias(c) for c in ("mae", "r2")))


@query("materials composition", """, ref AS (SELECT element, 0e0 AS e_ref FROM (SELECT DISTINCT element FROM composition)),
raw AS (SELECT step, ordinal, material_id, CASE WHEN step = 3 THEN ordinal - (CASE WHEN ordinal > 12 THEN 1 ELSE 0 END) - (CASE WHEN ordinal > 99 THEN 1 ELSE 0 END) ELSE ordinal END AS number, e_form_dft, each_true, proto_id FROM materials),
n AS (SELECT material_id, sum(amount) AS n FROM composition GROUP BY material_id),
f AS (SELECT raw.*, e_form_dft / n + 5e-1 AS e_form FROM raw JOIN n USING (material_id)), k AS (SELECT * FROM f WHERE e_form > -5 AND e_form < 5),
d AS (SELECT *, row_number() OVER (PARTITION BY proto_id ORDER BY each_true, ordinal) > 1 AS dup FROM k)
SELECT 'wbm-' || step || '-' || (number + 1) AS wbm_id, material_id, step, ordinal, round_even(e_form * 1e6, 0) / 1e6 AS e_form, round_even(each_true * 1e6, 0) / 1e6 AS each_true, NOT (proto_id < 20 OR dup) AS uniq_proto FROM d""")
def summary_build(materials, composition):
    """The reference table, built from raw rows, hull distances, compositions and training prototypes."""
    raw = materials.select("step", "ordinal", "material_id", F.col("ordinal").alias("number"), F.col("e_form_dft").alias("energy"), F.lit(0.5).alias("correction"), "proto_id")
    refs = composition.select("element").distinct().withColumn("e_ref", F.lit(0.0))
    return B.summary_table(raw, materials.select("step", "ordinal", "each_true"), composition, refs, materials.where("proto_id < 20"), [12, 99])


@query("preds", """SELECT material_id, e_form_pred FROM (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY model_key DESC) AS r FROM preds) WHERE r = 1""")
def keep_last(preds):
    return V.keep_last(preds, ["material_id"], "model_key").select("material_id", "e_form_pred")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a file stream; the pattern matches a file or a folder of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows of the event stream, all of them at the end of the input."""
    windows = R.event_windows(_stream(spark, sf_dir, "events"))
    return R.run_available(windows, shared_path(spark, "windows"), "complete")


def stream_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts by event type kept up to date over a stream of records."""
    records = _stream(spark, sf_dir, "events").select("event_type", (F.col("value") - 50).alias("each_true"), (F.col("value") - 50 + F.col("user_id") % 7 - 3).alias("each_pred"))
    counts = R.run_available(R.running_counts(records, ["event_type"]), shared_path(spark, "leaderboard"), "complete")
    return R.leaderboard(counts).select("event_type", "tp", "fn", "fp", "tn", *(six(c).alias(c) for c in ("precision", "recall", "f1", "mae", "rmse")))


QUERIES |= {"stream_windows": stream_windows, "stream_leaderboard": stream_leaderboard}
SQL["stream_windows"] = """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY ALL"""
SQL["stream_leaderboard"] = """WITH r AS (SELECT event_type, value - 50 AS t, value - 50 + user_id % 7 - 3 AS p FROM events),
c AS (SELECT event_type, count(*) FILTER (t <= 0 AND p <= 0) AS tp, count(*) FILTER (t <= 0 AND p > 0) AS fn, count(*) FILTER (t > 0 AND p <= 0) AS fp, count(*) FILTER (t > 0 AND p > 0) AS tn,
  round(avg(abs(p - t)), 6) AS mae, round(sqrt(avg((p - t) * (p - t))), 6) AS rmse FROM r GROUP BY event_type)
SELECT event_type, tp, fn, fp, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1, mae, rmse FROM c"""


_PAIR = """, p AS (SELECT vec_id // 2 AS material_id, pos, sum(CASE WHEN vec_id % 2 = 0 THEN abs(freq) END) AS kp, sum(CASE WHEN vec_id % 2 = 1 THEN abs(freq) END) AS kt,
  count(*) AS n FROM spectrum GROUP BY ALL)
"""

_MORE = {
    "combined_scores": ("materials preds", _ALIGNED + f""", m AS (SELECT model_key, {_METRICS} FROM classed GROUP BY model_key), r AS (SELECT *, {_RATES} FROM m)
SELECT model_key, CASE WHEN f1 BETWEEN 0 AND 1 AND rmse BETWEEN 0 AND 2 AND mae >= 0 THEN round(5e-1 * f1 + 4e-1 * (1 - rmse / 2) + 1e-1 * least(1, greatest(0, 1 - mae / 15e-2)), 6) END AS cps FROM r"""),
    "conductivity_metrics": ("spectrum", _PAIR + """SELECT material_id, round(CASE WHEN count(*) FILTER (kp IS NULL OR kt IS NULL) > 0 THEN 2 ELSE least(2, 2 * (sum(abs(kp - kt)) / sum(CASE WHEN pos % 8 = 0 THEN pos // 8 % 3 + 1 END)) / (sum(kp) + sum(kt))) END, 6) AS srme FROM p GROUP BY material_id HAVING count(kt) > 0"""),
    "atom_velocities": ("atoms", """, d AS (SELECT *, coalesce(x - lag(x) OVER w - 10 * round_even((x - lag(x) OVER w) / 10, 0), 0) AS dx, coalesce(y - lag(y) OVER w - 10 * round_even((y - lag(y) OVER w) / 10, 0), 0) AS dy,
  coalesce(z - lag(z) OVER w - 10 * round_even((z - lag(z) OVER w) / 10, 0), 0) AS dz FROM atoms WINDOW w AS (PARTITION BY system, atom ORDER BY frame)),
u AS (SELECT system, frame, atom, sum(dx) OVER w AS ux, sum(dy) OVER w AS uy, sum(dz) OVER w AS uz FROM d WINDOW w AS (PARTITION BY system, atom ORDER BY frame ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CASE WHEN lag(frame) OVER w IS NULL OR lead(frame) OVER w IS NULL THEN 1 ELSE 2 END AS n, coalesce(lead(ux) OVER w, ux) - coalesce(lag(ux) OVER w, ux) AS a,
  coalesce(lead(uy) OVER w, uy) - coalesce(lag(uy) OVER w, uy) AS b, coalesce(lead(uz) OVER w, uz) - coalesce(lag(uz) OVER w, uz) AS c FROM u WINDOW w AS (PARTITION BY system, atom ORDER BY frame))
SELECT system, frame, atom, round(a / n, 6) AS vx, round(b / n, 6) AS vy, round(c / n, 6) AS vz FROM s"""),
    "hull_distance_histogram": ("materials", """, e AS (SELECT avg(each_true) - 2 * stddev_samp(each_true) AS lo, avg(each_true) + 2 * stddev_samp(each_true) AS hi FROM materials),
b AS (SELECT CAST(least(floor((each_true - lo) / ((hi - lo) / 150)), 149) AS INTEGER) AS bin, lo, hi FROM materials, e WHERE each_true BETWEEN lo AND hi)
SELECT bin, round(lo + (bin + 1) * ((hi - lo) / 150), 6) AS edge, count(*) AS count, lo + (bin + 1) * ((hi - lo) / 150) <= 0 AS stable FROM b GROUP BY bin, lo, hi"""),
    "rmsd_cdf": ("preds materials", _SYMMETRY + """, n AS (SELECT model_key, rmsd AS x, row_number() OVER (PARTITION BY model_key ORDER BY rmsd) AS i, count(*) OVER (PARTITION BY model_key) AS n FROM d WHERE rmsd IS NOT NULL),
k AS (SELECT DISTINCT model_key, CAST(floor(k * (n - 1) / 199) AS BIGINT) + 1 AS i FROM n, range(200) t(k))
SELECT model_key, x, i / n AS share FROM n JOIN k USING (model_key, i)"""),
    "pressure_errors": ("curve", """, p AS (SELECT curve_id % 10 AS system, side <> 'view' AS pred, y FROM curve),
m AS (SELECT system, abs(avg(y) FILTER (pred) - avg(y) FILTER (NOT pred)) AS mean_error, min(y) AS lo, max(y) AS hi, count(*) FILTER (pred) AS np, count(*) FILTER (NOT pred) AS nt FROM p GROUP BY system),
x AS (SELECT system, y, count(*) FILTER (pred) AS a, count(*) FILTER (NOT pred) AS b FROM p GROUP BY ALL),
c AS (SELECT system, abs(sum(a) OVER o / np - sum(b) OVER o / nt) * coalesce(lead(y) OVER o - y, 0) AS part FROM x JOIN m USING (system) WINDOW o AS (PARTITION BY system ORDER BY y)),
h AS (SELECT system, least(floor((y - lo) / ((hi - lo) / 80)), 79) AS bin, count(*) FILTER (pred) / any_value(np) AS a, count(*) FILTER (NOT pred) / any_value(nt) AS b FROM p JOIN m USING (system) GROUP BY ALL),
g AS (SELECT system, 100 * sum(abs(a - b)) / 2 AS histogram_error FROM h GROUP BY system), v AS (SELECT system, sum(part) AS w1 FROM c GROUP BY system)
SELECT system, round(mean_error, 6) AS mean_error, round(w1, 6) AS w1, round(histogram_error, 6) AS histogram_error FROM m JOIN v USING (system) JOIN g USING (system)"""),
    "densities_of_states": ("spectrum", """, e AS (SELECT vec_id, min(freq) AS lo, max(freq) AS hi FROM spectrum GROUP BY vec_id),
b AS (SELECT vec_id, least(floor((freq - lo) / ((hi - lo) / 128)), 127) AS i, sum(w) AS w FROM spectrum JOIN e USING (vec_id) GROUP BY ALL)
SELECT vec_id, CAST(i AS INTEGER) AS bin, round(lo + (i + 5e-1) * ((hi - lo) / 128), 9) AS centre, round(coalesce(w, 0) / max(w) OVER (PARTITION BY vec_id), 9) AS dos
FROM (e CROSS JOIN range(128) t(i)) LEFT JOIN b USING (vec_id, i)"""),
}
SQL |= {name: sql_with(views, text) for name, (views, text) in _MORE.items()}
