"""Queries of systems, cells, files, streams and gates beyond the other catalogs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators import curves as K
from assay.operators import discovery as D
from assay.operators import gates as V
from assay.operators import kappa as Q
from assay.operators import leaderboard as L
from assay.operators import neighbours as N
from assay.operators import partition as P
from assay.operators import trajectories as T
from assay.plans.catalog import _ALIGNED
from assay.plans.registry import QUERIES, SQL, query, six
from assay.plans.views import sql_with, view
from assay.sources import extxyz as X
from assay.sources import payloads as Y
from assay.sources.shared import shared_path, written
from assay.streaming import deltas as S
from assay.streaming import events as R

# cells: a reduced one for each system, and the same lattice from vectors that are far from reduced


def _cells(atoms: DataFrame, skewed: bool) -> DataFrame:
    edge, zero, one = F.lit(12) + F.col("system") * 0.25, F.lit(0.0), F.lit(1.0)
    a, b, c = (edge, zero, zero), (one, edge, zero), (zero, F.lit(0.5), edge)
    if skewed:
        b = tuple(y + 5 * x for x, y in zip(a, b, strict=True))
        c = tuple(z - 3 * y + 2 * x for x, y, z in zip(a, b, c, strict=True))
    return atoms.select("system").distinct().withColumn("cell", F.array(*(F.array(*v) for v in (a, b, c))))


_IMAGES = """, s AS (SELECT a.c AS p, b.c AS q, c.c AS t FROM (SELECT unnest([-1, 0, 1]) AS c) a, (SELECT unnest([-1, 0, 1]) AS c) b, (SELECT unnest([-1, 0, 1]) AS c) c),
d AS (SELECT a.system, a.frame, a.atom AS i, b.atom AS j, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, 12 + a.system * 25e-2 AS e FROM atoms a JOIN atoms b ON a.system = b.system AND a.frame = b.frame AND a.atom < b.atom),
p AS (SELECT system, frame, i, j, min(sqrt(pow(dx + p * e + q, 2) + pow(dy + q * e + t * 5e-1, 2) + pow(dz + t * e, 2))) AS r FROM d, s GROUP BY ALL)
"""


@query("atoms", _IMAGES + "SELECT system, frame, i, j, round(r, 6) AS r FROM p WHERE r < 4e0")
def neighbour_list(atoms):
    """Pairs within 4 of each other in skewed cells, by cell lists."""
    return N.neighbour_pairs(atoms, _cells(atoms, True), 4.0).select("system", "frame", "i", "j", six("r").alias("r"))


@query("atoms", _IMAGES + "SELECT system, frame, i, j, round(r, 6) AS r FROM p")
def unreduced_cell_distances(atoms):
    """Distances of all pairs, from cells whose vectors are far from reduced."""
    return T.pair_distances(atoms, _cells(atoms, True)).select("system", "frame", "i", "j", six("r").alias("r"))


@query("atoms", """SELECT DISTINCT system, round((12 + system * 25e-2) / 2, 9) AS radius FROM atoms""")
def image_radii(atoms):
    return T.image_radius(_cells(atoms, True)).select("system", F.round("radius", 9).alias("radius"))


@query("atoms", _IMAGES + """, w AS (SELECT system, (system % 3) * 25e-2 + 3e0 AS top FROM (SELECT DISTINCT system FROM atoms)),
b AS (SELECT p.system, least(CAST(floor(r / (top / 20)) AS INTEGER), 19) AS bin FROM p JOIN w USING (system) WHERE r <= top), n AS (SELECT system, bin, count(*) AS n FROM b GROUP BY ALL),
m AS (SELECT system, sum(m * m) / 2 AS pairs FROM (SELECT system, frame, CAST(count(*) AS DOUBLE) AS m FROM atoms GROUP BY ALL) GROUP BY system)
SELECT w.system, CAST(i AS INTEGER) AS bin, round(coalesce(n, 0) * pow(12 + w.system * 25e-2, 3) / (pairs * (4e0 / 3e0 * pi() * (pow((i + 1) * top / 20, 3) - pow(i * top / 20, 3)))), 6) AS g
FROM w JOIN m USING (system) CROSS JOIN range(20) t(i) LEFT JOIN n ON n.system = w.system AND n.bin = i""")
def short_radial_distribution(atoms):
    """Radial distribution up to a reach of each system's own, by cell lists."""
    reach = atoms.select("system").distinct().withColumn("radius", (F.col("system") % 3) * 0.25 + 3.0)
    return T.rdf(atoms, _cells(atoms, True), 20, reach).select("system", "bin", six("g").alias("g"))


def _side(atoms: DataFrame, odd: bool) -> DataFrame:
    return atoms.where(F.col("system") % 2 == (1 if odd else 0)).withColumn("system", F.expr("system div 2"))


@query("atoms", """, n AS (SELECT system // 2 AS s, system % 2 AS side, count(DISTINCT frame) AS n FROM atoms GROUP BY ALL),
c AS (SELECT s, least((max(n) FILTER (side = 0) - 1) // 3, (max(n) FILTER (side = 1) - 1) // 2) AS c FROM n GROUP BY s),
f AS (SELECT DISTINCT system // 2 AS s, system % 2 AS side, dense_rank() OVER (PARTITION BY system ORDER BY frame) AS r, frame FROM atoms)
SELECT CAST(f.s AS BIGINT) AS system, CASE WHEN side = 0 THEN 'pred' ELSE 'true' END AS side, CAST(frame AS INTEGER) AS frame FROM f JOIN c USING (s) WHERE r <= CASE WHEN side = 0 THEN 3 ELSE 2 END * c + 1""")
def matched_frames(atoms):
    """Frames of two sides with time steps 0.5 and 0.75 over the same interval."""
    pred, true = _side(atoms, False), _side(atoms, True)
    steps = pred.select("system").distinct().select("system", F.lit("0.5").alias("dt_a"), F.lit("0.75").alias("dt_b"))
    p, t = (d.select("system", F.lit(name).alias("side"), "frame").distinct() for d, name in zip(T.time_matched(pred, true, steps), ("pred", "true"), strict=True))
    return p.unionByName(t).select(F.col("system").cast("long").alias("system"), "side", F.col("frame").cast("int").alias("frame"))


@query("atoms")
def system_evaluation(atoms):
    """All errors of a system whose sides have unlike time steps; tests hold its parts against the single operators."""
    atoms = written(atoms, "atoms")
    pred, true = _side(atoms, False), _side(atoms, True)
    steps = pred.select("system").distinct().select("system", F.lit("0.5").alias("dt_a"), F.lit("0.75").alias("dt_b"))
    pressures = tuple(d.groupBy("system", "frame").agg(F.avg("x").alias("pressure")) for d in (pred, true))
    out = T.system_metrics(pred, true, (10.0, 10.0), steps, 2.5, pressures, bins=50)
    return out.select("system", *(six(c).alias(c) for c in out.columns if c != "system"))


SQL["kinetic_temperatures"] = sql_with("atoms", """, d AS (SELECT *, coalesce(x - lag(x) OVER w - 10 * round_even((x - lag(x) OVER w) / 10, 0), 0) AS dx, coalesce(y - lag(y) OVER w - 10 * round_even((y - lag(y) OVER w) / 10, 0), 0) AS dy,
  coalesce(z - lag(z) OVER w - 10 * round_even((z - lag(z) OVER w) / 10, 0), 0) AS dz FROM atoms WINDOW w AS (PARTITION BY system, atom ORDER BY frame)),
s AS (SELECT *, CASE WHEN lag(frame) OVER w IS NULL OR lead(frame) OVER w IS NULL THEN 1 ELSE 2 END AS n,
  coalesce(lead(dx) OVER w, 0) + CASE WHEN lag(frame) OVER w IS NULL THEN 0 ELSE dx END AS a, coalesce(lead(dy) OVER w, 0) + CASE WHEN lag(frame) OVER w IS NULL THEN 0 ELSE dy END AS b,
  coalesce(lead(dz) OVER w, 0) + CASE WHEN lag(frame) OVER w IS NULL THEN 0 ELSE dz END AS e FROM d WINDOW w AS (PARTITION BY system, atom ORDER BY frame)),
k AS (SELECT system, frame, sum((a * a + b * b + e * e) / (n * n * 1e4) * (atom % 5 + 1)) * 103.642696562::DOUBLE / (3 * count(*) * 8.617333262e-5) AS t FROM s GROUP BY ALL)
SELECT system, round(avg(t), 6) AS temperature FROM k GROUP BY system""")

_HALVES = """, p AS (SELECT a.system, a.frame % 2 AS half, sqrt(pow(least(abs(a.x - b.x), 10 - abs(a.x - b.x)), 2) + pow(least(abs(a.y - b.y), 10 - abs(a.y - b.y)), 2) + pow(least(abs(a.z - b.z), 10 - abs(a.z - b.z)), 2)) AS r
  FROM atoms a JOIN atoms b ON a.system = b.system AND a.frame = b.frame AND a.atom < b.atom)
"""
SQL["radial_distribution_error"] = sql_with("atoms", _HALVES + """, c AS (SELECT system, half, least(CAST(floor(r / 1e-1) AS INTEGER), 49) AS bin, count(*) AS n FROM p WHERE r <= 5 GROUP BY ALL),
m AS (SELECT system, frame % 2 AS half, sum(k * k) / 2e3 AS pairs FROM (SELECT system, frame, CAST(count(*) AS DOUBLE) AS k FROM atoms GROUP BY ALL) GROUP BY ALL),
g AS (SELECT m.system, m.half, i, (i + 5e-1) * 1e-1 AS r, coalesce(n, 0) / (pairs * 4e0 / 3e0 * pi() * (pow((i + 1) * 1e-1, 3) - pow(i * 1e-1, 3))) AS g FROM m CROSS JOIN range(50) t(i) LEFT JOIN c ON c.system = m.system AND c.half = m.half AND c.bin = i),
d AS (SELECT t.system, t.i, t.r, abs(t.g - q.g) AS a, abs(t.g - 1) AS b FROM g t JOIN g q ON q.system = t.system AND q.i = t.i AND t.half = 1 AND q.half = 0),
z AS (SELECT system, (r - lag(r) OVER w) * (a + lag(a) OVER w) / 2 AS a, (r - lag(r) OVER w) * (b + lag(b) OVER w) / 2 AS b FROM d WINDOW w AS (PARTITION BY system ORDER BY i))
SELECT system, round(100 * least(1, sum(a) / sum(b)), 6) AS rdf_error FROM z GROUP BY system""")
SQL["angular_distribution"] = sql_with("atoms", """, d AS (SELECT a.system, a.frame, a.atom AS i, b.atom AS j, b.x - a.x - 10 * round_even((b.x - a.x) / 10, 0) AS dx, b.y - a.y - 10 * round_even((b.y - a.y) / 10, 0) AS dy, b.z - a.z - 10 * round_even((b.z - a.z) / 10, 0) AS dz
  FROM atoms a JOIN atoms b ON a.system = b.system AND a.frame = b.frame AND a.atom <> b.atom),
k AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS r FROM d), n AS (SELECT * FROM k WHERE r < 2),
t AS (SELECT a.system, degrees(acos(greatest(-1, least(1, (a.dx * b.dx + a.dy * b.dy + a.dz * b.dz) / (a.r * b.r))))) AS angle FROM n a JOIN n b ON a.system = b.system AND a.frame = b.frame AND a.i = b.i AND a.j < b.j),
c AS (SELECT system, least(CAST(floor(angle / 5) AS INTEGER), 35) AS bin, count(*) AS n FROM t GROUP BY ALL)
SELECT s.system, CAST(i AS INTEGER) AS bin, (i + 5e-1) * 5 AS angle, round(coalesce(n, 0) / (sum(coalesce(n, 0)) OVER (PARTITION BY s.system) * 5e0), 6) AS density
FROM (SELECT DISTINCT system FROM atoms) s CROSS JOIN range(36) t(i) LEFT JOIN c ON c.system = s.system AND c.bin = i""")


@query("spectrum", """, m AS (SELECT label AS system, pos AS x, sum(CASE WHEN vec_id % 2 = 0 THEN abs(freq) ELSE 0 END) AS p, sum(CASE WHEN vec_id % 2 = 1 THEN abs(freq) * CASE WHEN pos > 40 THEN 1e-4 ELSE 1 END ELSE 0 END) AS t FROM spectrum GROUP BY ALL),
w AS (SELECT system, x, p * CASE WHEN x IN (0, 63) THEN 5e-1 ELSE 1 END AS p, t * CASE WHEN x IN (0, 63) THEN 5e-1 ELSE 1 END AS t FROM m),
c AS (SELECT *, sum(t) OVER (PARTITION BY system ORDER BY x) - t AS before, sum(t) OVER (PARTITION BY system) AS whole FROM w),
k AS (SELECT *, sum(p) OVER (PARTITION BY system) AS sp, sum(t) OVER (PARTITION BY system) AS st FROM c WHERE before < 0.999::DOUBLE * whole),
g AS (SELECT *, abs(sum(p) OVER o / sp - sum(t) OVER o / st) * coalesce(lead(x) OVER o - x, 0) AS part, sum(t * x) OVER (PARTITION BY system) / st AS mean FROM k WINDOW o AS (PARTITION BY system ORDER BY x))
SELECT system, round(100 * least(1, sum(part) / sqrt(sum(t * pow(x - mean, 2)) / max(st))), 6) AS vdos_error FROM g GROUP BY system""")
def band_errors(spectrum):
    """Distance of two spectra whose reference has little power beyond a cut."""
    y = lambda odd, tail: F.sum(F.when(F.col("vec_id") % 2 == odd, F.abs("freq")).otherwise(0.0)) * tail
    side = lambda odd, tail: spectrum.groupBy(F.col("label").alias("system"), "pos").agg(y(odd, 1.0).alias("power")).select("system", F.col("pos").cast("double").alias("freq"), (F.col("power") * F.when(F.col("pos") > 40, tail).otherwise(1.0)).alias("power"))
    return T.vdos_error(side(0, 1.0), side(1, 1e-4)).select("system", six("vdos_error").alias("vdos_error"))


# conductivity and scores


@query("spectrum", """, r AS (SELECT vec_id, vec_id // 4 AS m, vec_id // 2 % 2 * 300 + 300 AS t, vec_id % 2 AS side, pos, abs(freq) AS k FROM spectrum),
n AS (SELECT m, t, sum(k) FILTER (side = 0) AS tp, sum(k) FILTER (side = 1) AS tt, count(*) FILTER (side = 0) AS np, count(*) FILTER (side = 1) AS nt FROM r GROUP BY ALL),
d AS (SELECT m, t, pos, abs(sum(k) FILTER (side = 0) - sum(k) FILTER (side = 1)) AS d FROM r GROUP BY ALL),
s AS (SELECT n.m, n.t, least(2, 2 * sum(d) / 36 / (max(tp) + max(tt))) AS s, bool_or(np <> nt) AS bad, any_value(nt) AS nt FROM n JOIN d USING (m, t) GROUP BY ALL)
SELECT m AS material_id, CAST(t AS INTEGER) AS t, round(CASE WHEN bool_or(bad) OVER (PARTITION BY m) THEN 2 ELSE s END, 6) AS srme FROM s WHERE nt > 0""")
def conductivity_by_temperature(spectrum):
    """SRME at two temperatures; weights 1 to 8 of eight q, eight bands each."""
    rows = spectrum.select(F.expr("vec_id div 4").alias("material_id"), F.expr("int(vec_id div 2 % 2 * 300 + 300)").alias("t"), (F.col("vec_id") % 2).alias("side"), F.expr("pos div 8").alias("q"), (F.col("pos") % 8).alias("b"), F.abs("freq").alias("k"), (F.expr("pos div 8") + 1.0).alias("w"))
    rows = rows.join(rows.groupBy("side", "material_id", "t").agg(F.sum("k").alias("kappa")), ["side", "material_id", "t"])
    return Q.srme(rows.where("side = 0"), rows.where("side = 1"), ["material_id"], "t").select("material_id", "t", six("srme").alias("srme"))


@query("spectrum", """, f AS (SELECT vec_id, pos, freq, count(*) FILTER (NOT (vec_id % 3 = 0 AND pos = 5)) OVER (PARTITION BY vec_id) = count(*) OVER (PARTITION BY vec_id) AS whole,
  count(*) FILTER (NOT (vec_id % 6 = 0 AND pos = 9)) OVER (PARTITION BY vec_id) = count(*) OVER (PARTITION BY vec_id) AS whole2 FROM spectrum)
SELECT vec_id, pos, round(CASE WHEN whole THEN freq WHEN whole2 THEN freq * 2 ELSE freq * 3 END, 6) AS k FROM f""")
def best_mode_values(spectrum):
    """Of three representations the first that has no gap in any mode of a record."""
    diagonal = lambda x: F.array(*(F.array(*(x if i == j else F.lit(0.0) for j in range(3))) for i in range(3)))
    rows = spectrum.select(
        "vec_id", "pos", F.when(~((F.col("vec_id") % 3 == 0) & (F.col("pos") == 5)), F.col("freq")).otherwise(F.lit(float("nan"))).alias("average"),
        F.when(~((F.col("vec_id") % 6 == 0) & (F.col("pos") == 9)), diagonal(F.col("freq") * 2)).alias("tensor"), (F.col("freq") * 3).alias("total"),
    )
    return Q.best_mode_conductivity(rows, ["vec_id"]).select("vec_id", "pos", six("k").alias("k"))


_CARDS = """, c AS (SELECT cust AS model_key, CASE WHEN cust % 5 <> 0 THEN avg(seconds) / 1e5 END AS e, min(seconds) / 5e4 AS f, avg(run_id % 100) / 1e2 AS w, max(run_id % 9) / 1e1 AS b, count(*) / 1e1 AS d,
  CASE WHEN cust % 7 = 0 THEN 0 ELSE sum(seconds) / 1e3 END AS t, 1e0 * count(DISTINCT hardware) AS j, 1 + count(*) / 1e1 AS p, 1 + min(run_id % 11) / 1e1 AS o, cust % 95 AS x FROM runs GROUP BY cust)
"""


@query("runs", _CARDS + """, s AS (SELECT model_key, x, CASE WHEN e IS NULL OR t <= 0 THEN NULL ELSE
  4e0 / 9 * (5e0 / 9 * greatest(0, least(1, 1 - e / 4)) + 4e0 / 9 * greatest(0, least(1, 1 - f / 5)))
  + 2e0 / 9 * (5e-1 * greatest(0, least(1, 1 - w / 5e-1)) + 1e0 / 3 * greatest(0, least(1, 1 - b / 8e-1)) + 1e0 / 6 * greatest(0, least(1, 1 - d / 35e-1)))
  + 1e0 / 9 * greatest(0, least(1, 1 - (log10(t) - log10(5e1)) / (log10(5e3) - log10(5e1))))
  + 2e0 / 9 * (4e-1 * greatest(0, least(1, 1 - j / 3)) + 4e-1 * greatest(0, least(1, 1 - (p - 1) / 25e-1)) + 2e-1 * greatest(0, least(1, 1 - (o - 1)))) END AS s FROM c)
SELECT model_key, round(s * greatest(0, 1 - x / 87e0), 6) AS score FROM s""")
def pillar_scores(runs):
    """Customers as models: a component that is missing, or a time that is not positive, leaves no score; coverage ends at 0."""
    c = runs.groupBy(F.col("cust").alias("model_key")).agg(
        F.when(F.col("cust") % 5 != 0, F.avg("seconds") / 1e5).alias("pbe_energy_mae"), (F.min("seconds") / 5e4).alias("pbe_force_mae"), (F.avg(F.col("run_id") % 100) / 1e2).alias("pbe_wall_dist_mae"),
        (F.max(F.col("run_id") % 9) / 10).alias("pbe_bond_length_error"), (F.count("*") / 10).alias("pbe_well_depth_error"), F.when(F.col("cust") % 7 == 0, 0.0).otherwise(F.sum("seconds") / 1e3).alias("run_time_sec"),
        F.count_distinct("hardware").cast("double").alias("energy_jump"), (1 + F.count("*") / 10).alias("force_flips"), (1 + F.min(F.col("run_id") % 11) / 10).alias("tortuosity"), (F.col("cust") % 95).alias("excluded"),
    )
    return c.select("model_key", six(L.pillar_score(excluded=F.col("excluded"))).alias("score"))


@query("runs", """SELECT cust AS model_key, round(avg(seconds / 1e5), 4) AS rdf_error, CASE WHEN count(*) FILTER (run_id % 4 = 0) = 0 THEN round(avg(run_id % 10), 6) END AS energy_rmse,
  CASE WHEN count(DISTINCT h) = 1 AND count(h) = count(*) AND count(*) FILTER (run_id % 8 = 0) = 0 THEN round(sum(seconds), 2) END AS run_time_sec, max(run_id % 64) AS max_rss_gb,
  CASE WHEN count(DISTINCT h) = 1 AND count(h) = count(*) THEN max(run_id % 24) END AS max_gpu_mem_gb, CASE WHEN count(DISTINCT h) = 1 AND count(h) = count(*) THEN min(h) END AS hardware, count(*) AS n_systems
FROM (SELECT *, CASE WHEN hardware <> '5-LOW' THEN CASE WHEN hardware = '1-URGENT' THEN 'fast' ELSE 'plain' END END AS h FROM runs) GROUP BY cust""")
def system_costs(runs):
    """Customers as models: costs only of one kind of hardware, and only if every run has them."""
    h = F.when(F.col("hardware") != "5-LOW", F.when(F.col("hardware") == "1-URGENT", "fast").otherwise("plain"))
    k = F.col("run_id")
    rows = runs.select(F.col("cust").alias("model_key"), (F.col("seconds") / 1e5).alias("rdf_error"), F.when(k % 4 != 0, k % 10 / 1000).alias("energy_rmse"), F.when(k % 8 != 0, F.col("seconds")).alias("run_time_sec"),
                       (k % 64).alias("max_rss_gb"), (k % 24).alias("max_gpu_mem_gb"), h.alias("hardware"))
    return T.model_md_metrics(rows).withColumns({"rdf_error": F.round("rdf_error", 4), "energy_rmse": six("energy_rmse"), "run_time_sec": F.round("run_time_sec", 2)})


# placement, files and assets


@query("parts", """, o AS (SELECT part_id, CAST(size AS BIGINT) AS size, row_number() OVER (ORDER BY size DESC, part_id) AS i FROM parts),
r AS (WITH RECURSIVE g AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS part_id, CAST(NULL AS INTEGER) AS shard, list_transform(range(7), lambda x: CAST(0 AS BIGINT)) AS loads
  UNION ALL
  SELECT o.i, o.part_id, CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER), list_transform(loads, lambda x, k: CASE WHEN k = list_position(loads, list_min(loads)) THEN x + o.size ELSE x END)
  FROM g JOIN o ON o.i = g.i + 1) SELECT part_id, shard FROM g WHERE i > 0)
SELECT part_id, shard FROM r""")
def largest_first_shards(parts):
    """Parts to seven shards, largest first, each to the lightest."""
    return P.place_largest_first(parts.select("part_id", "size"), 7, "size", "part_id").select("part_id", "shard")


@query("materials preds", """, o AS (SELECT material_id, row_number() OVER (ORDER BY material_id) - 1 AS ordinal FROM materials),
b AS (SELECT ordinal // 512 // 50 AS bundle, count(*) AS rows, sha256(array_to_string(list(CAST(material_id AS VARCHAR) ORDER BY ordinal), chr(10))) AS order_sha256 FROM o GROUP BY ALL),
v AS (SELECT model_key, ordinal // 512 // 50 AS bundle, count(e_form_pred) AS values FROM preds JOIN o USING (material_id) GROUP BY ALL)
SELECT model_key, bundle, rows, coalesce(values, 0) AS values, order_sha256, true AS aligned FROM (SELECT DISTINCT model_key FROM preds) CROSS JOIN b LEFT JOIN v USING (model_key, bundle)""")
def parity_assets(materials, preds):
    """Aligned columns of all models, written, read again and checked against the base's order."""
    base = P.with_global_row(materials.select("material_id", "each_true"), "material_id", "ordinal")
    path = shared_path(materials.sparkSession, "parity-assets")
    Y.write_aligned(base, preds.select("model_key", "material_id", F.col("e_form_pred").alias("value")), path)
    return Y.aligned_bundles(materials.sparkSession, path).withColumn("bundle", F.col("bundle").cast("long"))


@query("atoms", """SELECT 'S' || a.system || '-' || a.frame // 64 AS system, frame % 64 - CASE WHEN frame // 64 = 0 THEN 1 ELSE 0 END AS frame, CAST(atom AS INTEGER) AS atom, 'E' || atom % 3 AS species, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(-x, 6) AS fx,
  round(-(frame + a.system) / 8e0, 6) AS energy, 10 * frame AS md_step, 1e1 AS edge FROM atoms a""")
def trajectory_text(atoms):
    """Trajectories written as extended-XYZ text, 64 frames a file, and read again block by block."""
    rows = atoms.select(F.col("system").cast("string").alias("system"), F.expr("frame div 64").alias("part"), "frame", "atom", F.concat(F.lit("E"), F.col("atom") % 3).alias("species"), "x", "y", "z", *((-F.col(c)).alias(f"f{c}") for c in "xyz"))
    frames = rows.select("system", "part", "frame").distinct().withColumn("lattice", F.array(*(F.lit(10.0 if i % 4 == 0 else 0.0) for i in range(9))))
    frames = frames.withColumns({"energy": -(F.col("frame") + F.col("system").cast("double")) / 8, "md_step": F.col("frame") * 10})
    path = shared_path(atoms.sparkSession, "trajectories")
    X.write_trajectories(X.frame_lines(frames, rows), path)
    got, sites = X.read_trajectories(atoms.sparkSession, f"{path}/*/*.txt", name=r"name=([^/]+)/")
    both = sites.join(got, ["system", "frame"])
    return both.select(F.concat(F.lit("S"), "system").alias("system"), F.col("frame").cast("long").alias("frame"), "atom", "species", *(six(c).alias(c) for c in ("x", "y", "z", "fx", "energy")), "md_step", F.get("lattice", F.lit(0)).alias("edge"))


SQL["roc_corners"] = sql_with("materials preds", _ALIGNED + """, g AS (SELECT model_key, each_pred AS score, count(*) FILTER (each_true > 0) AS p, count(*) FILTER (NOT each_true > 0) AS n FROM rows_ WHERE each_pred IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(p) OVER w AS up, sum(n) OVER w AS un, row_number() OVER w AS r, count(*) OVER (PARTITION BY model_key) AS k, lead(p) OVER w AS p1, lead(n) OVER w AS n1, sum(p) OVER (PARTITION BY model_key) AS tp, sum(n) OVER (PARTITION BY model_key) AS tn FROM g WINDOW w AS (PARTITION BY model_key ORDER BY score DESC))
SELECT model_key, score, round(up / tp, 9) AS tpr, round(un / tn, 9) AS fpr FROM c WHERE r IN (1, k) OR p1 <> p OR n1 <> n
UNION ALL SELECT DISTINCT model_key, CAST(NULL AS DOUBLE), 0e0, 0e0 FROM c""")


@query("materials preds")
def roc_corners(materials, preds):
    """Corners of the staircases, by the step after each."""
    return D.roc_curve(D.align(materials, preds)).select("model_key", "score", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


@query("materials preds", _ALIGNED + """, n AS (SELECT model_key, spg_num AS v, row_number() OVER (PARTITION BY model_key ORDER BY abs(err), ordinal) AS lo, row_number() OVER (PARTITION BY model_key ORDER BY abs(err) DESC, ordinal) AS hi FROM rows_ WHERE err IS NOT NULL),
s AS (SELECT model_key, 'min' AS side, v FROM n WHERE lo <= 1000 UNION ALL SELECT model_key, 'max', v FROM n WHERE hi <= 1000),
e AS (SELECT model_key, side, min(v) AS l, max(v) AS h FROM s GROUP BY ALL), b AS (SELECT model_key, side, least(CAST(floor((v - l) / ((h - l) / 100e0)) AS INTEGER), 99) AS bin, count(*) AS count FROM s JOIN e USING (model_key, side) GROUP BY ALL)
SELECT e.model_key, e.side, CAST(i AS INTEGER) AS bin, coalesce(b.count, 0) AS count, round(l + (i + 5e-1) * ((h - l) / 100e0), 6) AS centre FROM e CROSS JOIN range(100) t(i) LEFT JOIN b ON b.model_key = e.model_key AND b.side = e.side AND b.bin = i""")
def end_histograms(materials, preds):
    """Space groups of each model's thousand best and worst predictions."""
    out = D.end_histograms(D.align(materials, preds).withColumn("spg_num", F.col("spg_num").cast("double")), "spg_num")
    return out.select("model_key", "side", "bin", "count", six("centre").alias("centre"))


_VIEW = """, m AS (SELECT part_id AS model_key, ['OSOD', 'OSCD', 'CSOD', 'CSCD'][size % 4 + 1] AS openness, ['E', 'EF_G', 'EFS_GM', 'EFS_D', 'EFSH_GD'][part_id % 5 + 1] AS targets,
  CASE WHEN part_id % 3 = 0 THEN ['A', 'B'] WHEN part_id % 3 = 1 THEN ['B'] ELSE [] END AS sets, kind FROM parts)
"""


@query("parts", _VIEW + """SELECT model_key, targets FROM m WHERE openness IN ('OSOD', 'CSOD') AND list_contains(sets, 'B') AND NOT list_contains(sets, 'A') AND targets LIKE '%F%'
  AND targets NOT LIKE '%M' AND targets LIKE '%D' AND contains(lower(kind), 'd')""")
def model_views(parts):
    """Parts as models, seen through all filters of a leaderboard."""
    k = F.col("part_id")
    rows = parts.select(
        k.alias("model_key"), F.get(F.array(*map(F.lit, L.OPENNESS)), (F.col("size") % 4).cast("int")).alias("openness"), F.get(F.array(*map(F.lit, ("E", "EF_G", "EFS_GM", "EFS_D", "EFSH_GD"))), (k % 5).cast("int")).alias("targets"),
        F.when(k % 3 == 0, F.array(F.lit("A"), F.lit("B"))).when(k % 3 == 1, F.array(F.lit("B"))).otherwise(F.expr("cast(array() AS array<string>)")).alias("training_sets"), F.col("kind").alias("label"),
    )
    return L.filter_models(rows, ["OSOD", "CSOD"], ["B"], ["A"], targets={"F": True, "M": False}, fs_mode="direct", search="D").select("model_key", "targets")


@query("curve", """, c AS (SELECT curve_id, x, y, row_number() OVER (PARTITION BY curve_id ORDER BY x) AS i, count(*) OVER (PARTITION BY curve_id) AS n FROM curve WHERE side = 'view'),
p AS (SELECT curve_id, x, y * 9e-1 + 1e0 AS y FROM c WHERE NOT (curve_id % 4 = 1 AND i = n)),
b AS (SELECT c.curve_id, c.x, p.y AS ya, c.y AS yb FROM c LEFT JOIN p ON p.curve_id = c.curve_id AND p.x = c.x),
g AS (SELECT *, count(*) FILTER (ya IS NULL) OVER (PARTITION BY curve_id) AS alone, arg_max(ya - yb, x) OVER (PARTITION BY curve_id) AS shift FROM b)
SELECT curve_id, round(avg(abs(ya - yb - shift)), 6) AS energy_mae FROM g WHERE alone = 0 GROUP BY curve_id""")
def same_grid_errors(curve):
    """Energy errors without interpolation: only curves with the very grid of their reference."""
    true = curve.where("side = 'view'").select("curve_id", "x", "y")
    last = true.groupBy("curve_id").agg(F.max("x").alias("last"))
    pred = true.join(last, "curve_id").where("NOT (curve_id % 4 = 1 AND x = last)").select("curve_id", "x", (F.col("y") * 0.9 + 1).alias("y"))
    return K.energy_mae(pred, true, ["curve_id"], None).withColumn("energy_mae", six("energy_mae"))


# gates


@query("materials", """, e AS (SELECT material_id, row_number() OVER (ORDER BY material_id) - 1 AS place FROM materials),
n AS (SELECT k AS model_key, CASE WHEN material_id % 100 = 3 THEN -material_id ELSE material_id END AS material_id, CASE WHEN material_id % 64 = 5 THEN place + 1 ELSE place END AS place FROM e, (SELECT unnest(['a', 'b']) AS k) WHERE NOT (k = 'b' AND material_id % 50 = 7)),
f AS (SELECT coalesce(n.model_key, x.k) AS model_key, coalesce(n.material_id, x.material_id) AS material_id, n.place AS place, x.place AS expected_place FROM n FULL JOIN (SELECT * FROM e, (SELECT unnest(['a', 'b']) AS k)) x ON x.k = n.model_key AND x.material_id = n.material_id)
SELECT model_key, CASE WHEN place IS NULL THEN 'missing' WHEN expected_place IS NULL THEN 'extra' ELSE 'moved' END AS problem, material_id, place, expected_place FROM f WHERE place IS DISTINCT FROM expected_place""")
def manifest_gaps(materials):
    """Two manifests held against the expected order: ids renamed, moved by one and left out."""
    expected = P.with_global_row(materials.select("material_id"), "material_id", "place")
    k = F.col("material_id")
    both = expected.withColumn("model_key", F.explode(F.array(F.lit("a"), F.lit("b")))).where(~((F.col("model_key") == "b") & (k % 50 == 7)))
    manifest = both.select("model_key", F.when(k % 100 == 3, -k).otherwise(k).alias("material_id"), F.when(k % 64 == 5, F.col("place") + 1).otherwise(F.col("place")).alias("place"))
    return V.manifest_problems(manifest, expected)


@query("items", """, u AS (SELECT DISTINCT flag AS model_key, material_id FROM items),
r AS (SELECT model_key, material_id, material_id % 9 = 0 AS failed, CASE WHEN material_id % 9 = 0 OR material_id % 31 = 0 THEN NULL WHEN material_id % 37 = 0 THEN 'elsewhere/' || material_id ELSE 'forces/' || material_id END AS f,
  CASE WHEN material_id % 41 = 0 THEN 'w' ELSE 'v' END AS version FROM u WHERE material_id % 29 <> 0)
SELECT model_key, 'no record' AS problem, material_id FROM u WHERE material_id % 29 = 0
UNION ALL SELECT model_key, 'version differs', material_id FROM r WHERE version <> 'v'
UNION ALL SELECT model_key, 'no force file', material_id FROM r WHERE NOT failed AND f IS NULL AND model_key <> 'N'
UNION ALL SELECT model_key, 'invalid force file', material_id FROM r WHERE f LIKE 'elsewhere%' AND model_key <> 'N'
UNION ALL SELECT model_key, 'invalid force file', material_id FROM r WHERE f LIKE 'forces%' AND material_id % 43 = 0 AND model_key <> 'N'""")
def record_gaps(items):
    """Records of three runs against their manifests: gaps, other versions, and force files that are missing or misplaced."""
    # dealt out in all shuffle partitions, as in the view of predictions, and written once, since each rule reads it
    dealt = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = written(items.select(F.col("flag").alias("model_key"), "material_id").repartition(dealt, "model_key", "material_id").distinct(), "listed")
    k = F.col("material_id")
    path = F.when((k % 9 == 0) | (k % 31 == 0), None).when(k % 37 == 0, F.concat(F.lit("elsewhere/"), k)).otherwise(F.concat(F.lit("forces/"), k))
    records = listed.where("material_id % 29 <> 0").select("model_key", "material_id", F.when(k % 9 == 0, "failed").alias("error"), path.alias("force_file"), F.when(k % 41 == 0, "w").otherwise("v").alias("version"))
    runs = listed.select("model_key").distinct().select("model_key", (F.col("model_key") != "N").alias("save_forces"), F.lit("v").alias("version"))
    files = listed.where("material_id % 43 <> 0").select(F.concat(F.lit("forces/"), k).alias("path"))
    return V.record_problems(listed, runs, records, ["version"], files=files)


@query("atoms", """, f AS (SELECT DISTINCT system, frame - 1 AS frame FROM atoms), n AS (SELECT system, count(*) AS n FROM f GROUP BY system)
SELECT system, 'frame count' AS problem, CAST(NULL AS BIGINT) AS frame FROM n WHERE system % 4 = 1
UNION ALL SELECT system, 'steps', min(frame) FROM f WHERE system % 4 = 2 AND frame >= 5 GROUP BY system
UNION ALL SELECT system, 'cell or pbc', min(frame) FROM f WHERE system % 4 = 3 AND frame >= 3 GROUP BY system
UNION ALL SELECT system, 'not finite', min(frame) FROM f WHERE system % 5 = 4 AND frame >= 2 GROUP BY system
UNION ALL SELECT system, 'species', min(frame) FROM f WHERE system % 5 = 3 AND frame >= 1 GROUP BY system""")
def rollout_gaps(atoms):
    """Rollouts with frames too many, steps, cells, numbers and species that are off."""
    s, f = F.col("system"), F.col("frame")
    rows = atoms.withColumn("frame", f - 1).withColumn("species", F.concat(F.lit("E"), F.col("atom") % 3))
    cell = F.array(*(F.array(*(F.lit(10.0 if i == j else 0.0) + (F.when((s % 4 == 3) & (f >= 3), 1.0).otherwise(0.0) if (i, j) == (2, 1) else 0.0) for j in range(3))) for i in range(3)))
    frames = rows.select("system", "frame").distinct().select("system", "frame", F.when((s % 4 == 2) & (f >= 5), 1).otherwise(f * 10).alias("md_step"), cell.alias("cell"), F.array(*[F.lit(True)] * 3).alias("pbc"))
    expected = frames.groupBy("system").agg(F.count("*").alias("n")).select("system", F.when(s % 4 == 1, F.col("n") - 1).otherwise(F.col("n")).alias("n_frames"), F.lit(10).alias("interval"), F.expr("array(array(10D, 0D, 0D), array(0D, 10D, 0D), array(0D, 0D, 10D))").alias("cell"), F.array(*[F.lit(True)] * 3).alias("pbc"))
    species = rows.select("system", "atom", "species").distinct()
    sites = rows.withColumns({"x": F.when((s % 5 == 4) & (f >= 2) & (F.col("atom") == 0), F.lit(float("nan"))).otherwise(F.col("x")), "species": F.when((s % 5 == 3) & (f >= 1) & (F.col("atom") == 1), "Q").otherwise(F.col("species"))})
    return T.rollout_problems(frames, expected, sites, species)


# streams

_EVENT = "event_type string, user_id long, event_id long, value double"


def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with lines that are cut off and records that come again: what is accepted, rejected, truncated and missing."""
    events = view(spark, sf_dir, "records")
    path = shared_path(spark, "event-log")
    line = F.to_json(F.struct("event_type", "user_id", "event_id", "value"))
    events.select(F.when(F.col("event_id") % 97 == 0, F.left(line, F.length(line) - 9)).otherwise(line).alias("value")).write.text(f"{path}/in")
    stream = R.read_records(spark, f"{path}/in", _EVENT)
    S.log_records(R.good_records(stream), path, ["user_id", "event_type"], "event_id")
    cut = R.run_available(R.quarantined(R.read_records(spark, f"{path}/in", _EVENT)), f"{path}/cut")
    return S.log_report(S.read_log(spark, path), cut, events.select("user_id", "event_type").distinct(), ["user_id", "event_type"])


QUERIES["stream_log"] = stream_log
SQL["stream_log"] = sql_with("records", """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM records WHERE event_id % 97 <> 0),
c AS (SELECT CASE WHEN event_id % 97 = 0 THEN 'truncated' END AS status FROM records WHERE event_id % 97 = 0 UNION ALL SELECT CASE WHEN k = 1 THEN 'accepted' ELSE 'duplicate' END FROM r
  UNION ALL SELECT 'missing' FROM (SELECT user_id, event_type FROM records GROUP BY ALL HAVING count(*) FILTER (event_id % 97 <> 0) = 0))
SELECT status, count(*) AS n FROM c GROUP BY status""")


def stream_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News from a stream spliced into a committed payload, compacted, and ids pruned that are no longer active."""
    events = view(spark, sf_dir, "records")
    path = shared_path(spark, "spliced")
    committed = events.groupBy(F.col("user_id").cast("string").alias("id")).agg(F.max("value").alias("value"))
    base = spark.range(1).select(F.lit("_base").alias("id"), F.lit(-1.0).alias("value"))
    S.start_payload(committed.unionByName(base), path)
    stream = _event_stream(spark, sf_dir).where("event_type = 'purchase' AND user_id % 3 <> 0")
    fresh = stream.select(F.when(F.col("user_id") % 10 == 1, F.lit("_base")).otherwise(F.col("user_id").cast("string")).alias("id"), "value", F.col("event_id").alias("order"))
    fresh.writeStream.foreachBatch(S.splice_into(path)).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    S.compact(spark, path, fresh.schema)
    inactive = events.where("user_id % 13 = 0").select(F.col("user_id").cast("string").alias("id")).distinct()
    return S.current_payload(spark, path, fresh.schema, inactive=inactive).select("id", six("value").alias("value"))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assay.plans.catalog import _stream

    return _stream(spark, sf_dir, "events")


QUERIES["stream_splice"] = stream_splice
SQL["stream_splice"] = sql_with("records", """, c AS (SELECT user_id, max(value) AS value FROM records GROUP BY user_id),
n AS (SELECT user_id, arg_max(value, event_id) AS value FROM records WHERE event_type = 'purchase' AND user_id % 3 <> 0 AND user_id % 10 <> 1 GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS id, round(coalesce(n.value, c.value), 6) AS value FROM c LEFT JOIN n USING (user_id) WHERE user_id % 13 <> 0 UNION ALL SELECT '_base', -1e0""")
