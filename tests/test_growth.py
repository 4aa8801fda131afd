"""Steps that grow no faster than their input."""

from pyspark.sql import functions as F

from assay.operators import lattices
from assay.operators.neighbours import with_lattice

SF = "/root/testdata/sf0.001"


def test_frames_are_ranked_before_components(spark):
    from assay.plans.views import view

    plan = view(spark, SF, "atoms")._jdf.queryExecution().optimizedPlan().toString()
    lines = [x.lstrip(" :+-") for x in plan.splitlines()]
    first = next(i for i, x in enumerate(lines) if x.startswith("Window"))
    assert not any(x.startswith("Generate") for x in lines[first:])  # a window over a label holds ids, not components


def test_atoms_equal_their_sql(spark, tmp_path):
    import duckdb

    from assay.plans.views import sql_with, view

    rows = [(1, 7, [1.0] * 7), (2, 7, [2.0, None, 3.0]), (2, 7, [5.0, 4.0]), (2, 8, [6.0] * 6), (3, 8, [1.0, 2.0]), (4, 8, []), (5, 7, None), (9, None, [4.0] * 4)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(sql_with("atoms", "SELECT system, frame, atom, x, y, z FROM atoms")).fetchall()
    got = [tuple(r) for r in view(spark, str(tmp_path), "atoms").select("system", "frame", "atom", "x", "y", "z").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 6


def test_short_vectors_need_no_neighbours(spark):
    cell = F.expr("array(array(12D, 0D, 0D), array(1D, 12D, 0D), array(0D, 0.5D, 12D))")
    cells = with_lattice(spark.range(1).select(cell.alias("cell"))).withColumns({"limits": lattices.image_limits(), "shifts": lattices.image_shifts()})
    rows = cells.withColumn("t", F.explode(F.sequence(F.lit(-60), F.lit(60)))).withColumns({"dx": F.col("t") * 0.37, "dy": F.col("t") * 0.11, "dz": F.lit(0.7) - F.col("t") * 0.2})
    image = lambda d: {r.t: r.d for r in lattices.with_nearest_image(d, ("dx", "dy", "dz"), "d").select("t", "d").collect()}
    got, alone = image(rows), image(rows.withColumn("shifts", F.lit(None).cast("array<array<double>>")))
    assert sum(d is not None for d in alone.values()) > 60 and all(d is None or d == got[t] for t, d in alone.items())
    for t, d in got.items():
        v = (t * 0.37, t * 0.11, 0.7 - t * 0.2)
        around = range(-4, 5)
        least = min((v[0] + 12 * a + b) ** 2 + (v[1] + 12 * b + c / 2) ** 2 + (v[2] + 12 * c) ** 2 for a in around for b in around for c in around)
        assert abs(d.r2 - least) < 1e-9 and abs(d.x**2 + d.y**2 + d.z**2 - d.r2) < 1e-9


def test_spectra_are_made_once(spark):
    from assay.operators import trajectories as T

    v = spark.range(64).select(F.lit("s").alias("system"), F.lit(0).alias("atom"), F.col("id").alias("frame"), *(F.sin(F.col("id") * k).alias(c) for k, c in ((1, "vx"), (2, "vy"), (3, "vz"))))
    out = T.vdos_error(T.vdos(v, 1.0), T.vdos(v, 1.0))
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.first().vdos_error == 0


def test_system_evaluation_reads_its_atoms_once(spark):
    from assay.plans.catalog import QUERIES

    plan = QUERIES["system_evaluation"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "embedding#" not in plan and "FlatMapGroupsInPandas" not in plan and "BatchEvalPython" not in plan


def test_record_problems_match_null_keys_with_nothing_and_fill_partitions(spark):
    from assay.operators import gates as V

    on = "model_key string, material_id string"
    manifest = spark.createDataFrame([("m", "a"), ("m", "a"), ("m", None)], on)
    records = spark.createDataFrame([("m", "a", None), ("m", None, None), ("m", "z", None), ("m", "z", None)], f"{on}, error string").withColumns({"force_file": F.lit("forces/q"), "version": F.lit("1")})
    runs = spark.createDataFrame([("m", True, "1")], "model_key string, save_forces boolean, version string")
    files = spark.createDataFrame([("forces/q",)], "path string")
    out = V.record_problems(manifest, runs, records, ["version"], files=files)
    assert sorted((r.problem, str(r.material_id)) for r in out.collect()) == [("no record", "None"), ("not in the manifest", "None"), ("not in the manifest", "z"), ("not in the manifest", "z"), ("recorded twice", "z")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2 and "SortMergeJoin" not in plan and "LeftAnti" not in plan


def test_a_repeated_batch_of_a_log_judges_by_the_batches_before_it(spark):
    from assay.streaming import deltas as D

    row = "k string, at long"
    accepted = spark.createDataFrame([("a",), (None,)], "k string")
    batch = spark.createDataFrame([("a", 1), ("b", 5), ("b", 4), ("c", None), ("c", 2), (None, 3)], row)
    got = sorted((str(r.k), str(r.at), r.duplicate) for r in D.mark_duplicates(batch, ["k"], "at", accepted).collect())
    assert got == [("None", "3", True), ("a", "1", True), ("b", "4", False), ("b", "5", True), ("c", "2", False), ("c", "None", True)]
    first = sorted((str(r.k), r.duplicate) for r in D.mark_duplicates(batch, ["k"], "at").collect())
    assert first == [("None", False), ("a", False), ("b", False), ("b", True), ("c", False), ("c", True)]


def test_points_of_a_grid_are_made_from_sorted_knots(spark):
    import numpy as np

    from assay.operators import distances as A

    rng = np.random.default_rng(3)
    sides = []
    for _ in range(2):
        curves = {k: sorted((rng.choice(4000, 5 + k, replace=False) / 400).tolist()) for k in range(12)} | {20: [1.0, 2.0, 3.0], 21: [0.0, 1.0] if sides else [1.0, 2.0], 22: [5.0]}
        sides.append({k: (x, rng.normal(size=len(x)).tolist()) for k, x in curves.items()})
    frames = [spark.createDataFrame([(k, x, y) for k, (xs, ys) in s.items() for x, y in zip(xs, ys, strict=True)] + [(None, 0.0, 1.0), (None, 1.0, 1.0), (20, None, 9.0)], "k int, x double, y double") for s in sides]
    out = A.on_common_grid(*frames, ["k"], 5)
    got = {(r.k, r.i): r for r in out.collect()}
    ends = {k: (max(s[k][0][0] for s in sides), min(s[k][0][-1] for s in sides)) for k in sides[0]}
    ends = {k: (lo, hi) for k, (lo, hi) in ends.items() if lo < hi}
    assert len(got) == out.count() == 5 * len(ends) and 20 in ends and not {21, 22} & {*ends}
    for (k, i), r in got.items():
        lo, hi = ends[k]
        assert r.x == (hi if i == 4 else lo + i * ((hi - lo) / 4))
        assert abs(r.ya - np.interp(r.x, *sides[0][k])) < 1e-12 and abs(r.yb - np.interp(r.x, *sides[1][k])) < 1e-12
    plan = out._jdf.queryExecution().executedPlan().toString().rpartition("== Initial Plan ==")[2]
    assert plan.count("Exchange hashpartitioning") == 1  # of knots; points are neither shuffled nor sorted
    assert "Sort" not in plan[: plan.index("Generate")]


def test_missing_values_take_only_their_own_stretches_of_a_grid(spark):
    from assay.operators import distances as A

    a = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, None), (1, 2.0, 2.0), (1, 4.0, 4.0)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 0.0, 1.0), (1, 4.0, 1.0)], "k int, x double, y double")
    assert [r.ya for r in A.on_common_grid(a, b, ["k"], 9).orderBy("i").collect()] == [0.0, None, None, None, 2.0, 2.5, 3.0, 3.5, 4.0]


def test_curve_metrics_take_each_curve_through_few_shuffles(spark):
    from assay.operators import curves as K

    rows = spark.range(400).selectExpr("CAST(id % 8 AS int) k", "CAST(id DIV 8 AS double) x", "sin(id) y", "cos(id) f")
    out = K.curve_metrics(rows, rows, ["k"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 3 and plan.count("Join LeftOuter") <= 5  # one grid, the walls of both; a join for each pass
    assert out.columns == ["k", *K.OWN_METRICS, *K.FORCE_METRICS, *K.REFERENCE_METRICS, "force_mae"] and out.count() == 8
    one = K.curve_metrics(rows, rows, ["k"], names=("force_jump", "energy_mae"))
    assert one.columns == ["k", "force_jump", "energy_mae"]
    want = {r.k: (r.force_jump, r.energy_mae) for r in out.collect()}
    assert {r.k: (r.force_jump, r.energy_mae) for r in one.collect()} == want


def test_down_sampling_takes_corners_of_hulls_and_no_whole_polyline(spark):
    import numpy as np

    from assay.operators import curves as K

    def plain(x, y, points):
        n, chosen = len(x), [0]
        width = (n - 2) / (points - 2)
        for k in range(1, points - 1):
            lo, hi = int(k * width) + 1, min(int((k + 1) * width) + 1, n)
            px, py = x[chosen[-1]], y[chosen[-1]]
            area = np.abs((px - x[lo:hi].mean()) * (y[lo:hi] - py) - (px - x[lo:hi]) * (y[lo:hi].mean() - py))
            chosen.append(lo + int(area.argmax()))
        return sorted({(x[i], y[i]) for i in {*chosen, n - 1}})

    rng = np.random.default_rng(5)
    curves = {k: (np.cumsum(rng.random(n)), rng.normal(size=n).cumsum()) for k, n in ((1, 6), (2, 7), (3, 8), (4, 997), (None, 50))}
    curves[5] = (np.cumsum(rng.integers(0, 2, 400)) / 256.0, np.cumsum(rng.integers(1, 3, 400)) / 256.0)  # steep steps: an x has several points
    rows = spark.createDataFrame([(k, a, b) for k, xy in curves.items() for a, b in zip(*(v.tolist() for v in xy), strict=True)], "k int, x double, y double").repartition(7)
    taken = []
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        out = K.downsample(rows, ["k"], 7)
        taken = out.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for k, (x, y) in curves.items():
        want = plain(x, y, 7) if len(x) > 7 else sorted(zip(x, y, strict=True))
        assert sorted((r.x, r.y) for r in taken if r.k == k) == want, k
    assert "MapInPandas" in out._jdf.queryExecution().optimizedPlan().toString()


def test_aligned_rows_fill_all_shuffle_partitions(spark):
    from assay.operators.discovery import align
    from assay.plans.views import view

    # the join of all models' rows with predictions is not merged by compressed bytes into tasks that grow with the input
    rows = align(view(spark, SF, "materials"), view(spark, SF, "preds"))
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [model_key") == 2


def test_cumulative_curve_reads_aligned_rows_once(spark):
    from assay.operators.discovery import cumulative_curve

    pairs = [("m", i, (i % 3 - 1) / 10.0, (i - 40) / 100.0) for i in range(60)] + [("n", i, -0.1, -1.0) for i in range(3)] + [("n", 3, None, None)]
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame(pairs, "model_key string, material_id long, each_true double, each_pred double")
    got = {(r.model_key, r.rank): (r.precision, r.recall) for r in cumulative_curve(rows.mapInArrow(seen, rows.schema), 5).collect()}
    assert read.value == len(pairs)
    hits = [sum(t <= 0 for _, _, t, _ in pairs[:r]) for r in range(61)]
    assert {k: v for k, v in got.items() if k[0] == "m"} == {("m", r): (hits[r] / r, hits[r] / 40) for r in (1, 2, 6, 16, 41)}
    assert {k for k in got if k[0] == "n"} == {("n", r) for r in (1, 2, 3)} and got["n", 3] == (1, 1)
