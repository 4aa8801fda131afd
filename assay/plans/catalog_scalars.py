"""Queries of column functions, gates and tables that ``catalog`` does not reach, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import scalars as S
from assay.operators import composition as C
from assay.operators import curves as K
from assay.operators import datasets as B
from assay.operators import discovery as D
from assay.operators import gates as V
from assay.operators import histograms as H
from assay.operators import kappa as Q
from assay.operators import leaderboard as L
from assay.operators import trajectories as T
from assay.plans.registry import query, six
from assay.sources import readers as I

# ids, formulas and single values


@query("materials", """SELECT material_id AS k, CASE WHEN material_id % 7 <> 0 THEN 'wbm-' || step || '-' || (material_id + 1) ELSE 'odd-' || material_id END AS id,
  CASE WHEN material_id % 7 <> 0 THEN CAST(step AS INTEGER) END AS step, CAST(spg_num AS INTEGER) AS spg_num FROM materials""")
def repaired_ids(materials):
    raw = F.when(F.col("material_id") % 7 != 0, F.concat_ws("_", F.lit("step"), "step", "material_id")).otherwise(F.concat(F.lit("odd-"), "material_id"))
    rows = materials.select(F.col("material_id").alias("k"), S.next_step_id(raw).alias("id"), F.concat(F.lit("AB2_cF12_"), "spg_num", F.lit("_a_c")).alias("label"))
    return rows.select("k", "id", F.when(F.col("id").startswith("wbm"), S.id_step("id")).alias("step"), S.space_group_of_label("label").alias("spg_num"))


@query("parts", """SELECT part_id, 'Fe' AS element, CAST(size % 4 + 2 AS DOUBLE) AS amount FROM parts UNION ALL SELECT part_id, 'O', CAST(size % 3 + 1 AS DOUBLE) FROM parts""")
def parsed_formulas(parts):
    formula = F.concat(F.lit("Fe"), F.col("size") % 4 + 1, F.lit("O"), F.col("size") % 3 + 1, F.lit("Fe"))
    return parts.select("part_id", F.explode(S.parse_formula(formula)).alias("element", "amount"))


@query("vectors", """, e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM vectors)
SELECT vec_id, round(-(e[1] + e[2] + e[3]) / 3 / 0.006241509125883258::DOUBLE, 6) AS pressure, e[6] AS xy, round((e[1] + e[2] + e[3]) / 3, 9) AS trace, round((e[1] + e[2] + e[3]) / 3, 9) AS mean,
  e[7] IS NOT NULL AS longer FROM e""")
def tensor_components(vectors):
    v = F.slice(F.col("embedding").cast("array<double>"), 1, 6)
    rows = vectors.select("vec_id", v.alias("v"), S.voigt_to_tensor(v).alias("t"), S.voigt_to_tensor("embedding").isNull().alias("longer"))
    return rows.select("vec_id", six(S.pressure("v")).alias("pressure"), F.col("t")[0][1].alias("xy"), F.round(S.tensor_average("t"), 9).alias("trace"), F.round(S.directional_average("v"), 9).alias("mean"), "longer")


@query("vectors", """, e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x + 2.5e-1) AS e FROM vectors),
f AS (SELECT vec_id, list_bool_or(list_transform(e[4:8], lambda x: x < 0)) OR list_bool_or(list_transform(e[1:3], lambda x: x < -1e-2)) OR list_bool_or(list_transform(e[9:], lambda x: x < 0)) AS imaginary FROM e)
SELECT vec_id, imaginary, NOT imaginary AND vec_id % 3 = 0 AS allowed, NOT imaginary AS allowed_broken FROM f""")
def mode_flags(vectors):
    shifted = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.25)
    bands = F.transform(F.sequence(F.lit(0), F.ceil(F.size("e") / 8).cast("int") - 1), lambda q: F.slice("e", q * 8 + 1, F.lit(8)))
    rows = vectors.select("vec_id", shifted.alias("e")).select("vec_id", S.imaginary_modes(bands).alias("imaginary"))
    kept = F.col("vec_id") % 3 == 0
    return rows.select("vec_id", "imaginary", S.conductivity_allowed("imaginary", kept).alias("allowed"), S.conductivity_allowed("imaginary", kept, True).alias("allowed_broken"))


@query("items", """SELECT material_id, line, CASE WHEN d * 1e2 - 3 = 0 AND t = 0 THEN 0e0 WHEN d * 1e2 - 3 < 0 THEN -2e0 ELSE round(2 * ((d * 1e2 - 3) - t * 1e2) / nullif((d * 1e2 - 3) + t * 1e2, 0), 6) END AS srd,
  CASE WHEN q > 10 THEN round(521.4708983725064::DOUBLE * sqrt((q - 1e1) / (t + 1e-2)), 4) END AS wavenumber, round(least(1, greatest(0, 1 - (q - 1e1) / (4e1 - 1e1))), 9) AS linear,
  round(least(1, greatest(0, 1 - (log10(q) - log10(2e0)) / (log10(4e1) - log10(2e0)))), 9) AS logarithmic FROM items""")
def relative_scores(items):
    pred, true = F.col("d") * 1e2 - 3, F.col("t") * 1e2
    return items.select("material_id", "line", six(S.relative_difference(pred, true)).alias("srd"), F.round(S.wavenumber(F.col("q") - 10, F.col("t") + 1e-2), 4).alias("wavenumber"),
                        F.round(S.subscore("q", 40.0, 10.0), 9).alias("linear"), F.round(S.subscore("q", 40.0, 2.0, log=True), 9).alias("logarithmic"))


_TEXT = "CASE WHEN event_id % 11 = 0 THEN 'NaN' WHEN event_id % 13 = 0 THEN 'Infinity' WHEN event_id % 17 = 0 THEN 'n/a' ELSE CAST(user_id AS {text}) END"


@query("records", "SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) * 1e3 END AS milli FROM records")
def finite_numbers(records):
    rows = records.select("event_id", F.expr(_TEXT.format(text="STRING")).alias("milli"))
    return I.numeric(rows, ["milli"], {"milli": 1e3})


@query("vectors", """, e AS (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM vectors)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, CASE WHEN x <> 0 AND vec_id % 5 = 0 AND pos = 0 THEN NULL ELSE round_even(x * 1e5, 0) / 1e5 END AS v,
  CASE WHEN vec_id % 5 = 0 THEN (SELECT CAST(embedding AS DOUBLE[])[2] FROM vectors w WHERE w.vec_id = e.vec_id) ELSE (SELECT CAST(embedding AS DOUBLE[])[1] FROM vectors w WHERE w.vec_id = e.vec_id) END AS first FROM e""")
def rounded_lists(vectors):
    e = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: F.when((F.col("vec_id") % 5 == 0) & (i == 0), float("inf")).otherwise(x))
    rows = vectors.select("vec_id", e.alias("e"))
    return rows.select("vec_id", S.first_finite("e").alias("first"), F.posexplode(S.round_list("e")).alias("pos", "v"))


@query("runs", "SELECT run_id, CASE WHEN status = 'P' THEN 'pending_review' WHEN seconds > 2e5 THEN 'complete' WHEN cust % 3 = 0 THEN 'not_available' WHEN cust % 5 = 0 THEN 'not_applicable' ELSE 'pending' END AS state FROM runs")
def task_states(runs):
    state = S.task_coverage(F.when(F.col("status") == "P", "pending_review"), F.col("seconds") > 2e5, F.col("cust") % 3 != 0, F.col("cust") % 5 != 0)
    return runs.select("run_id", state.alias("state"))


# curves


@query("curve elements", "SELECT side, curve_id, x, y FROM curve JOIN elements ON element = curve_id % 25 WHERE x >= r_cov * 9e-1 - 1e-12 AND x <= least(r_vdw * 3.1e0, 2e1)")
def window_points(curve, elements):
    return K.in_window(curve.withColumn("element", (F.col("curve_id") % 25).cast("int")), elements, limit=20.0).select("side", "curve_id", "x", "y")


@query("curve", """, b AS (SELECT *, x = 25e-2 OR (curve_id % 4 = 0 AND x BETWEEN 5e-1 AND 6e-1) AS bad FROM curve), r AS (SELECT *, max(bad AND x BETWEEN 3e-1 AND 4e0) OVER (PARTITION BY side, curve_id) AS reject FROM b)
SELECT side, curve_id, x, y FROM r WHERE NOT bad AND NOT reject""")
def finite_ends(curve):
    bad = (F.col("x") == 0.25) | ((F.col("curve_id") % 4 == 0) & F.col("x").between(0.5, 0.6))
    rows = curve.withColumns({"y": F.when(bad, float("nan")).otherwise(F.col("y")), "lo": F.lit(0.3), "hi": F.lit(4.0)})
    return K.trim_to_finite(rows, ["side", "curve_id"], "lo", "hi").select("side", "curve_id", "x", "y")


@query("curve", """, d AS (SELECT *, y - lag(y) OVER (PARTITION BY side, curve_id ORDER BY x) AS d, count(*) OVER (PARTITION BY side, curve_id) AS n FROM curve),
k AS (SELECT *, lag(d) OVER (PARTITION BY side, curve_id ORDER BY x) AS b FROM d WHERE abs(d) >= 1e-3),
f AS (SELECT side, curve_id, n, count(*) FILTER (sign(d) <> sign(b)) AS flips, sum(CASE WHEN sign(d) <> sign(b) THEN abs(d) + abs(b) END) AS jump FROM k GROUP BY ALL)
SELECT side, curve_id FROM f WHERE n >= 5 AND flips >= 12 AND jump >= 5e2""")
def low_quality_curves(curve):
    return K.low_quality_references(curve, ["side", "curve_id"], jump=500.0, least_flips=12)


@query("curve", """, m AS (SELECT *, abs(y - lag(y) OVER (PARTITION BY side, curve_id ORDER BY x)) >= 5e1 AS jumped FROM curve) SELECT side, curve_id, count(*) FILTER (jumped) AS moment_jumps FROM m GROUP BY ALL""")
def curve_moment_jumps(curve):
    return K.moment_jumps(curve.withColumn("magmoms", F.array(F.col("y"), F.lit(1.0))), ["side", "curve_id"], jump=50.0)


# conductivity

_MODES = """, m AS (SELECT vec_id, pos // 8 AS q, pos % 8 AS b, freq, w FROM spectrum)
"""


@query("spectrum", _MODES + """SELECT vec_id, count(*) AS n, round(sum(CASE WHEN vec_id % 2 = 0 THEN q + 1 ELSE 1 END), 6) AS w, round(sum(freq * CASE WHEN vec_id % 2 = 0 THEN q + 1 ELSE 1 END), 6) AS wx FROM m GROUP BY vec_id""")
def mode_spectra(spectrum):
    rows = spectrum.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "freq"))), lambda x: x["freq"]).alias("f"))  # one vector
    n = F.ceil(F.size("f") / 8).cast("int")
    rows = rows.select("vec_id", F.transform(F.sequence(F.lit(0), n - 1), lambda q: F.slice("f", q * 8 + 1, F.lit(8))).alias("frequencies"),
                       F.when(F.col("vec_id") % 2 == 0, F.transform(F.sequence(F.lit(1), n), lambda q: q.cast("double"))).otherwise(F.array(F.lit(5.0))).alias("weights"))
    return Q.mode_spectrum(rows, ["vec_id"]).groupBy("vec_id").agg(F.count("*").alias("n"), six(F.sum("w")).alias("w"), six(F.sum(F.col("w") * F.col("x"))).alias("wx"))


@query("spectrum", _MODES + """SELECT x.vec_id, x.q, x.b, round(sum(2 * abs(x.freq - y.freq) * (x.w + x.b) / (x.w + x.b + y.w + y.b)), 6) AS k FROM m x JOIN m y ON x.vec_id = y.vec_id AND x.q = y.q GROUP BY ALL""")
def mode_conductivities(spectrum):
    modes = spectrum.select("vec_id", F.expr("pos div 8").alias("q"), (F.col("pos") % 8).alias("b"), "freq", "w")
    other = modes.select("vec_id", "q", F.col("b").alias("b2"), F.col("freq").alias("f2"))
    pairs = modes.join(other, ["vec_id", "q"]).select("vec_id", "q", "b", "b2", F.abs(F.col("freq") - F.col("f2")).alias("k"))
    capacity = modes.select("vec_id", "q", "b", (F.col("w") + F.col("b")).alias("c"))
    return Q.total_mode_conductivity(pairs, capacity, ["vec_id"]).withColumn("k", six("k"))


_KAPPA = """, v AS (SELECT vec_id, label, sum(abs(freq)) AS kt, sum(freq * freq) * 2e1 AS kp, max(freq) AS top FROM spectrum GROUP BY ALL),
r AS (SELECT vec_id, label, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE kp END AS kappa_pred, kt AS kappa_true, least(abs(top), 19e-1) AS srme, vec_id % 5 = 0 AS imaginary, vec_id % 7 AS f, vec_id % 7 + CASE WHEN vec_id % 13 = 0 THEN 1 ELSE 0 END AS i FROM v),
mm AS (SELECT vec_id, label, kappa_pred, imaginary, CASE WHEN kappa_pred IS NULL THEN -2 ELSE 2 * (kappa_pred - kappa_true) / (kappa_pred + kappa_true) END AS srd,
  CASE WHEN imaginary OR (f <> 0 AND f <> i) THEN 2 ELSE srme END AS srme FROM r)
"""


def _kappa(spectrum):
    v = spectrum.groupBy("vec_id", "label").agg(F.sum(F.abs("freq")).alias("kappa_true"), (F.sum(F.col("freq") * F.col("freq")) * 20).alias("kp"), F.max("freq").alias("top"))
    k = F.col("vec_id")
    rows = v.select("vec_id", F.col("label").alias("model_key"), F.when(k % 11 != 0, F.col("kp")).alias("kappa_pred"), "kappa_true", F.least(F.abs("top"), F.lit(1.9)).alias("srme"),
                    (k % 5 == 0).alias("imaginary"), (k % 7).alias("final_spg"), (k % 7 + F.when(k % 13 == 0, 1).otherwise(0)).alias("init_spg"))
    return Q.material_metrics(rows)


@query("spectrum", _KAPPA + "SELECT vec_id, round(srd, 6) AS srd, round(abs(srd), 6) AS sre, round(srme, 6) AS srme, srme = 2 AS censored FROM mm")
def material_conductivity(spectrum):
    return _kappa(spectrum).select("vec_id", *(six(c).alias(c) for c in ("srd", "sre", "srme")), "censored")


@query("spectrum", _KAPPA + """SELECT label AS model_key, round(avg(srme), 6) AS mean_srme, round(avg(abs(srd)), 6) AS mean_sre, round(avg(srd), 6) AS mean_srd, round(avg(CAST(kappa_pred IS NULL AS DOUBLE)), 6) AS failure_rate,
  round(avg(CAST(imaginary AS DOUBLE)), 6) AS imaginary_rate, count(*) AS n, round(avg(round_even(abs(srd) * 1e4, 0) / 1e4), 6) AS mean_w1 FROM mm GROUP BY label""")
def model_conductivity(spectrum):
    out = Q.model_metrics(_kappa(spectrum).withColumn("w1", F.col("sre")))
    return out.select("model_key", *(six(c).alias(c) for c in ("mean_srme", "mean_sre", "mean_srd", "failure_rate", "imaginary_rate", "mean_w1")), "n")


# gates


@query("materials preds", """, a AS (SELECT material_id, e_form_dft AS a FROM materials WHERE step <= 4), b AS (SELECT material_id, e_form_pred AS b FROM preds WHERE model_key = 'A')
SELECT material_id, a, b FROM a FULL JOIN b USING (material_id) WHERE a IS NULL OR b IS NULL OR abs(a - b) > 1e-1""")
def differing_energies(materials, preds):
    a = materials.where("step <= 4").select("material_id", F.col("e_form_dft").alias("v"))
    return V.differing_rows(a, preds.where("model_key = 'A'").select("material_id", F.col("e_form_pred").alias("v")), "material_id", "v", 0.1)


@query("preds", """, t AS (SELECT CASE WHEN material_id % 50 = 0 THEN NULL ELSE material_id END AS k FROM preds) SELECT CASE WHEN k IS NULL THEN 'null key' ELSE 'duplicate key' END AS problem, k, count(*) AS n FROM t GROUP BY k HAVING k IS NULL OR count(*) > 1""")
def key_problems(preds):
    return V.table_problems(preds.select(F.when(F.col("material_id") % 50 != 0, F.col("material_id")).alias("k")), ["k"], "k")


@query("materials preds", """, p AS (SELECT material_id FROM preds WHERE model_key <> 'N' AND material_id % 9 <> 0 UNION ALL SELECT material_id + 100000000 FROM preds WHERE material_id % 101 = 0)
SELECT material_id, 'duplicate' AS problem FROM p GROUP BY material_id HAVING count(*) > 1 UNION ALL SELECT material_id, 'missing' FROM materials WHERE material_id NOT IN (SELECT material_id FROM p)
UNION ALL SELECT DISTINCT material_id, 'unexpected' FROM p WHERE material_id NOT IN (SELECT material_id FROM materials)""")
def id_problems(materials, preds):
    p = preds.where("model_key <> 'N' AND material_id % 9 <> 0").select("material_id")
    p = p.unionByName(preds.where("material_id % 101 = 0").select(F.col("material_id") + 100000000).toDF("material_id"))
    return Q.id_set_problems(p, materials)


@query("materials preds", "SELECT DISTINCT material_id FROM materials JOIN preds USING (material_id) WHERE step = 2 AND model_key = 'R'")
def shared_materials(materials, preds):
    return V.shared_keys(materials.where("step = 2"), preds.where("model_key = 'R'"), ["material_id"])


@query("preds", """, n AS (SELECT model_key AS name, count(*) AS n FROM preds GROUP BY ALL) SELECT name, n, (SELECT max(n) FROM n) AS n_rows FROM n WHERE n <> (SELECT max(n) FROM n)""")
def column_sizes(preds):
    most = preds.groupBy("model_key").agg(F.count("*").alias("n")).agg(F.max("n").alias("n_rows"))
    return V.size_problems(preds.select(F.col("model_key").alias("name")), most)


@query("runs", """SELECT run_id, 'status' AS field, status AS have, CASE WHEN run_id % 40 = 0 THEN 'X' ELSE status END AS want FROM runs WHERE run_id % 40 = 0
UNION ALL SELECT run_id, 'hardware', CASE WHEN run_id % 60 = 0 THEN NULL ELSE hardware END, hardware FROM runs WHERE run_id % 60 = 0""")
def provenance_breaks(runs):
    records = runs.select("run_id", "status", F.when(F.col("run_id") % 60 != 0, F.col("hardware")).alias("hardware"))
    manifest = runs.select("run_id", F.when(F.col("run_id") % 40 == 0, "X").otherwise(F.col("status")).alias("status"), "hardware")
    return V.provenance_problems(records, manifest, ["status", "hardware"])


@query("materials", "SELECT step, n, expected FROM (SELECT CAST(step AS INTEGER) AS step, count(*) AS n, CAST(CASE step WHEN 2 THEN 2500 ELSE 3000 END AS BIGINT) AS expected FROM materials WHERE step <= 3 GROUP BY step) WHERE n <> expected")
def step_sizes(materials):
    parts = {k: materials.where(F.col("step") == k).drop("step") for k in (1, 2, 3)}
    return V.union_steps(parts, {1: 3000, 2: 2500, 3: 3000}, materials.where("material_id % 10 = 0"))[1].select("step", "n", "expected")


# leaderboards


@query("runs", """SELECT cust AS run_id, arg_min(hardware, run_id) AS hardware, round(sum(seconds), 4) AS run_time_sec, CASE WHEN count(*) FILTER (status = 'P') = 0 THEN round(max(seconds), 4) END AS max_rss_gb, CASE WHEN count(DISTINCT status) > 1 THEN NULL ELSE '{"a":"' || any_value(status) || '"}' END AS versions FROM runs GROUP BY cust""")
def merged_runs(runs):
    segments = runs.select(F.col("cust").alias("run_id"), F.col("run_id").alias("ordinal"), "hardware", F.col("seconds").alias("run_time_sec"), F.when(F.col("status") != "P", F.col("seconds")).alias("max_rss_gb"),
                           F.create_map(F.lit("a"), F.col("status")).alias("versions"), F.lit(0).alias("completed_at"), F.lit("h").alias("hostname"))
    return L.merge_segments(segments).select("run_id", "hardware", F.round("run_time_sec", 4).alias("run_time_sec"), F.round("max_rss_gb", 4).alias("max_rss_gb"), "versions")


@query("records", """, m AS (SELECT event_type AS model_key, 'value' AS metric, avg(value) AS v FROM records GROUP BY ALL UNION ALL SELECT event_type, 'user', avg(user_id) FROM records GROUP BY ALL)
SELECT model_key, metric, round(v, CAST(3 - floor(log10(abs(v))) AS INTEGER)) AS value FROM m""")
def significant_means(records):
    return L.metric_means(records.select(F.col("event_type").alias("model_key"), "value", F.col("user_id").alias("user")), ["value", "user"]).withColumn("value", F.round("value", 8))


@query("runs", """, p AS (SELECT cust, seconds AS x, CAST(run_id % 1000 AS DOUBLE) AS y FROM runs), f AS (SELECT DISTINCT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.cust = a.cust AND b.x <= a.x AND b.y <= a.y AND (b.x < a.x OR b.y < a.y))),
n AS (SELECT *, count(*) OVER (PARTITION BY cust) AS n, lag(y) OVER (PARTITION BY cust ORDER BY x) AS before FROM f)
SELECT cust, x, before AS y, 0 AS part FROM n WHERE n > 1 AND before IS NOT NULL UNION ALL SELECT cust, x, y, 1 FROM n WHERE n > 1""")
def run_staircases(runs):
    return L.staircase(runs.select("cust", F.col("seconds").alias("a"), (F.col("run_id") % 1000).cast("double").alias("b")), "a", "b", ["cust"])


@query("records", """SELECT event_type AS model_key, round((3e-1 * least(1, greatest(0, 1 - avg(value) / 1e2)) + 2e-1 * least(1, greatest(0, 1 - min(value) / 1e2)) + 2e-1 * least(1, greatest(0, 1 - (log10(sum(value)) - log10(9e3)) / (log10(3e5) - log10(9e3)))) + 3e-1 * least(1, greatest(0, 1 - max(value) / 2e2))), 6) AS score FROM records GROUP BY event_type""")
def dynamics_scores(records):
    rows = records.groupBy(F.col("event_type").alias("model_key")).agg(F.avg("value").alias("vdos_error"), F.min("value").alias("adf_error"), F.sum("value").alias("run_time_sec"), (F.max("value") / 2).alias("pressure_error"))
    return rows.select("model_key", six(L.md_score()).alias("score"))


# compositions and tables


@query("composition", """SELECT material_id FROM composition GROUP BY material_id HAVING bool_and(element LIKE 'E%' OR element IN ('P1', 'P2', 'P3', 'P4', 'P5', 'P6', 'P7', 'P8', 'P9', 'P10', 'P11', 'P12', 'P13', 'P14', 'P15', 'P16', 'P17', 'P18', 'P19', 'P20'))""")
def within_elements(composition):
    return C.elements_within(composition, [f"P{i}" for i in range(1, 21)] + [f"E{i}" for i in range(25)])


@query("materials", """, t AS (SELECT 'M' || step AS model_key, material_id, spg_num - 7 * step AS a, proto_id + step AS b FROM materials WHERE step <= 3)
SELECT model_key, material_id, t.a - CAST(m.spg_num AS BIGINT) AS spg_num_diff, t.b - m.proto_id AS proto_id_diff FROM t JOIN materials m USING (material_id)""")
def symmetry_differences(materials):
    pred = materials.where("step <= 3").select(F.concat(F.lit("M"), "step").alias("model_key"), "material_id", (F.col("spg_num") - 7 * F.col("step")).alias("spg_num"), (F.col("proto_id") + F.col("step")).alias("proto_id"))
    return C.analysis_differences(pred, materials, ["spg_num", "proto_id"])


@query("materials", """SELECT 'a' AS model_key, material_id, 'each_true' AS metric, each_true AS value FROM materials UNION ALL SELECT 'a', material_id, 'e_form_dft', e_form_dft FROM materials
UNION ALL SELECT 'b', material_id, 'each_true', each_true * 2 FROM materials WHERE step = 1""")
def long_metrics(materials):
    return C.concat_metrics({"a": materials.select("material_id", "each_true", "e_form_dft"), "b": materials.where("step = 1").select("material_id", (F.col("each_true") * 2).alias("each_true"))})


@query("records", """, l AS (SELECT event_type, user_id, arg_max(value, event_id) AS v FROM records GROUP BY ALL), t AS (SELECT DISTINCT event_type FROM records),
c AS (SELECT event_type, CAST(least(floor(v / (1e2 / 10)), 9) AS INTEGER) AS bin, count(*) AS n FROM l WHERE v BETWEEN 0 AND 100 GROUP BY ALL)
SELECT event_type AS element, CAST(i AS INTEGER) AS bin, round((i + 5e-1) * 1e1, 6) AS centre, coalesce(n, 0) AS count FROM (SELECT event_type FROM t) CROSS JOIN range(10) r(i) LEFT JOIN c USING (event_type) WHERE c.bin = i OR NOT EXISTS (SELECT 1 FROM c d WHERE d.event_type = event_type AND d.bin = i)""")
def element_value_histograms(records):
    sites = records.select(F.col("user_id").alias("frame"), F.col("event_id").alias("site"), F.col("event_type").alias("element"), F.col("value").alias("v"))
    return H.element_histogram(sites, "v", 0.0, 100.0, 10).select("element", "bin", six("centre").alias("centre"), "count")


@query("vectors", """, x AS (SELECT abs(unnest(CAST(embedding AS DOUBLE[]))) AS x FROM vectors), c AS (SELECT CAST(least(floor(x / 5e-2), 9) AS INTEGER) AS bin, count(*) AS n FROM x WHERE x <= 5e-1 GROUP BY ALL)
SELECT CAST(i AS INTEGER) AS bin, round((i + 5e-1) * 5e-2, 6) AS centre, coalesce(n, 0) AS count FROM range(10) r(i) LEFT JOIN c ON bin = i""")
def nested_value_histogram(vectors):
    nested = F.array(F.slice("embedding", 1, 3), F.slice("embedding", 4, 1_000_000))
    return H.nested_histogram(vectors.select(nested.alias("v")), "v", 0.0, 0.5, 10).select("bin", six("centre").alias("centre"), "count")


@query("materials", """SELECT count(*) AS n, round(avg(CAST(each_true <= 0 AS DOUBLE)), 9) AS stable_share, count(*) FILTER (each_true - greatest(e_form_dft / 10, 0) > 1e-1) AS n_apart FROM materials""")
def distance_counts(materials):
    rows = materials.withColumns({"e_hull": F.col("each_true"), "e_decomp": F.col("e_form_dft") / 10})
    return D.quality_counts(rows).select("n", F.round("stable_share", 9).alias("stable_share"), "n_apart")


@query("materials composition", """, n AS (SELECT material_id, sum(amount) AS n FROM composition GROUP BY material_id)
SELECT material_id, CASE WHEN material_id % 6 <> 0 THEN round_even((e_form_dft / n + 2.5e-1) * 1e4, 0) / 1e4 END AS e_form_pred, material_id % 6 = 0 AS failed FROM materials JOIN n USING (material_id) WHERE step <= 3""")
def formation_predictions(materials, composition):
    records = materials.select("material_id", F.when(F.col("material_id") % 6 != 0, F.col("e_form_dft")).alias("energy"), F.lit(0.25).alias("correction"))
    refs = composition.select("element").distinct().withColumn("e_ref", F.lit(0.0))
    return B.prediction_table(records, materials.where("step <= 3"), composition, refs)


@query("parts", """SELECT DISTINCT kind AS name, CASE WHEN kind LIKE 'ECONOMY A%' THEN 'ECONOMY A' WHEN kind LIKE 'ECONOMY%' THEN 'ECONOMY' WHEN kind LIKE 'S%' THEN 'S' END AS setting FROM parts""")
def longest_settings(parts):
    settings = parts.sparkSession.createDataFrame([("ECONOMY",), ("ECONOMY A",), ("S",)], "setting string")
    return B.settings_of(parts.select(F.col("kind").alias("name")).distinct(), settings)


# trajectories


@query("items", """, s AS (SELECT material_id * 10 + line AS system, CAST(q AS BIGINT) AS a, CAST(q AS BIGINT) % 7 + 1 AS b FROM items) SELECT system, b // gcd(a, b) AS stride_a, a // gcd(a, b) AS stride_b,
  least(999 // (b // gcd(a, b)), 499 // (a // gcd(a, b))) * (b // gcd(a, b)) + 1 AS use_a, least(999 // (b // gcd(a, b)), 499 // (a // gcd(a, b))) * (a // gcd(a, b)) + 1 AS use_b FROM s""")
def frame_strides(items):
    q = F.col("q").cast("long")
    steps = items.select((F.col("material_id") * 10 + F.col("line")).alias("system"), (q.cast("decimal(18,9)") / 1000).cast("decimal(18,9)").alias("dt_a"), ((q % 7 + 1).cast("decimal(18,9)") / 1000).cast("decimal(18,9)").alias("dt_b"))
    strides = T.time_strides(steps).withColumns({"n_a": F.lit(1000), "n_b": F.lit(500)})
    return T.matched_counts(strides).select("system", "stride_a", "stride_b", "use_a", "use_b")


@query("atoms", """, e AS (SELECT system, frame, sum(x) AS p, sum(y) AS t, count(*) AS n FROM atoms GROUP BY ALL)
SELECT system, round(stddev_pop((p - t) / n), 6) AS energy_rmse, (SELECT round(sqrt(avg((x - y) * (x - y) + (y - z) * (y - z) + (z - x) * (z - x)) / 3), 6) FROM atoms a WHERE a.system = e.system) AS force_rmse FROM e GROUP BY system""")
def energy_force_errors(atoms):
    pred, true = (atoms.groupBy("system", "frame").agg(F.sum(c).alias("energy"), F.count("*").alias("n_atoms")) for c in "xy")
    forces = tuple(atoms.select("system", "frame", "atom", *(F.col(c).alias(f"f{n}") for c, n in zip(order, "xyz", strict=True))) for order in ("xyz", "yzx"))
    return T.energy_force_rmse(pred, true, forces=forces).select("system", six("energy_rmse").alias("energy_rmse"), six("force_rmse").alias("force_rmse"))


@query("atoms", """SELECT a.*, frames FROM (SELECT system, frame, atom FROM atoms WHERE frame < 4) a JOIN (SELECT system, count(DISTINCT frame) AS frames FROM atoms GROUP BY system) USING (system)""")
def first_frames(atoms):
    rows = T.strip_labels(atoms.withColumn("energy", F.lit(1.0)))
    return T.head_frames(rows, 3).join(T.systems_of(rows), "system").select("system", "frame", "atom", "frames")


_CELL = """, k AS (SELECT unnest(range(-1, 2)) AS s), c AS (SELECT DISTINCT system, 12 + system * 2.5e-1 AS e FROM atoms),
sh AS (SELECT system, e, a.s * e + b.s * 1e0 AS sx, b.s * e + c2.s * 5e-1 AS sy, c2.s * e AS sz FROM c, k a, k b, k c2),
pr AS (SELECT a.system, a.frame, a.atom AS i, b.atom AS j, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM atoms a JOIN atoms b ON a.system = b.system AND a.frame = b.frame AND a.atom < b.atom),
im AS (SELECT system, frame, i, j, sqrt(min((dx + sx) * (dx + sx) + (dy + sy) * (dy + sy) + (dz + sz) * (dz + sz))) AS r FROM pr JOIN sh USING (system) GROUP BY ALL)
"""


@query("atoms", _CELL + "SELECT system, frame, count(*) AS pairs, round(avg(r), 6) AS mean_r, round(min(r), 6) AS least_r FROM im GROUP BY ALL")
def skewed_cell_distances(atoms):
    edge = F.lit(12) + F.col("system") * 0.25
    zero = F.lit(0.0)
    cells = atoms.select("system").distinct().withColumn("cell", F.array(F.array(edge, zero, zero), F.array(F.lit(1.0), edge, zero), F.array(zero, F.lit(0.5), edge)))
    pairs = T.pair_distances(atoms, cells)
    return pairs.groupBy("system", "frame").agg(F.count("*").alias("pairs"), six(F.avg("r")).alias("mean_r"), six(F.min("r")).alias("least_r"))
