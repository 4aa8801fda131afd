"""Record logs, payload deltas, manifests, rollouts and aligned assets."""

import json

import pytest
from pyspark.sql import functions as F

from assay.operators import gates as V
from assay.operators import trajectories as T
from assay.sources import payloads as Y
from assay.streaming import deltas as D
from assay.streaming import events as R

SCHEMA = "model_key string, material_id long, at long, v double"


def line(key, i, at):
    return json.dumps({"model_key": key, "material_id": i, "at": at, "v": float(at)})


def test_log_tells_what_it_turns_away(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path = f"{tmp_path}/out"

    def run():
        D.log_records(R.good_records(R.read_records(spark, f"{tmp_path}/in", SCHEMA)), path, ["model_key", "material_id"], "at")
        return sorted((r.material_id, r.at, r.duplicate) for r in D.read_log(spark, path).collect())

    (tmp_path / "in" / "a.jsonl").write_text("\n".join([line("m", 1, 5), line("m", 1, 3), line("m", 2, 4), line("m", 1, 9), '{"model_key": "m", "mat']))
    first = [(1, 3, False), (1, 5, True), (1, 9, True), (2, 4, False)]
    assert run() == first
    assert run() == first  # nothing new, nothing changes
    (tmp_path / "in" / "b.jsonl").write_text("\n".join([line("m", 1, 1), line("m", 3, 8), line("n", 1, 2)]))  # late, and new
    assert run() == sorted([*first, (1, 1, True), (1, 2, False), (3, 8, False)])
    bad = R.run_available(R.quarantined(R.read_records(spark, f"{tmp_path}/in", SCHEMA)), f"{tmp_path}/bad")
    expected = spark.createDataFrame([("m", i) for i in (1, 2, 3, 4)], "model_key string, material_id long")
    report = {r.status: r.n for r in D.log_report(D.read_log(spark, path), bad, expected, ["model_key", "material_id"]).collect()}
    assert report == {"accepted": 4, "duplicate": 3, "truncated": 1, "missing": 1, "unexpected": 1}


def test_deltas_equal_a_batch_upsert(spark, tmp_path):
    path = f"{tmp_path}/p"
    committed = spark.createDataFrame([("_base", 0.0), ("a", 1.0), ("b", 2.0), ("gone", 3.0)], "id string, value double")
    D.start_payload(committed, path)
    batches = [[("a", 10.0, 1), ("a", 11.0, 2), ("_base", 99.0, 3)], [("c", 5.0, 1), ("a", 12.0, 0)], [("c", 6.0, 2)]]
    frames = [spark.createDataFrame(b, "id string, value double, order long") for b in batches]
    schema, write = frames[0].schema, D.splice_into(path)
    inactive = spark.createDataFrame([("gone",), ("_base",)], "id string")
    now = lambda: sorted(tuple(r) for r in D.current_payload(spark, path, schema, inactive=inactive).collect())
    assert now() == [("_base", 0.0), ("a", 1.0), ("b", 2.0)]
    assert D.compact(spark, path, schema) == -1
    want = committed
    for i, f in enumerate(frames):
        write(f, i)
        before = now()
        write(f, i)  # a repeated batch changes nothing
        assert now() == before
        want = Y.upsert(want, V.keep_last(f, ["id"], "order").drop("order"), inactive)
        assert now() == sorted(tuple(r) for r in want.collect())
        # a batch writes its own rows only
        assert spark.read.parquet(f"{path}/deltas/batch={i}").count() <= len(batches[i])
        if i == 1:
            assert D.compact(spark, path, schema, inactive=inactive) == 1 and now() == before
            assert "gone" not in {r.id for r in spark.read.parquet(f"{path}/base/upto=1").collect()}
    assert now() == [("_base", 0.0), ("a", 12.0), ("b", 2.0), ("c", 6.0)]


def test_manifest_order(spark):
    expected = spark.createDataFrame([(i, k) for i, k in enumerate("abcd")], "place long, material_id string")
    manifest = spark.createDataFrame([("m", 0, "a"), ("m", 1, "c"), ("m", 2, "b"), ("m", 3, "x"), ("n", 0, "a"), ("n", 1, "b"), ("n", 2, "c"), ("n", 3, "d"), ("o", 0, "a"), ("o", 1, "a")], "model_key string, place long, material_id string")
    got = sorted((r.model_key, r.problem, r.material_id, r.place, r.expected_place) for r in V.manifest_problems(manifest, expected).collect() if r.model_key != "o")
    assert got == [("m", "extra", "x", 3, None), ("m", "missing", "d", None, 3), ("m", "moved", "b", 2, 1), ("m", "moved", "c", 1, 2)]
    assert ("duplicate", "a") in {(r.problem, r.material_id) for r in V.manifest_problems(manifest, expected).where("model_key = 'o'").collect()}
    twice = V.manifest_problems(manifest.where("model_key = 'n'"), expected.unionByName(expected.where("place = 0")))
    assert {(r.problem, r.material_id) for r in twice.collect()} == {("expected twice", "a")}


def test_records_of_a_run(spark):
    manifest = spark.createDataFrame([("m", k) for k in "abcde"], "model_key string, material_id string")
    runs = spark.createDataFrame([("m", True, "1", None)], "model_key string, save_forces boolean, version string, note string")
    rows = [("m", "a", None, "forces/a", "1", None), ("m", "b", None, None, "1", None), ("m", "c", "failed", None, "2", None), ("m", "d", None, "forces/../d", "1", "x"), ("m", "d", None, "forces/d", "1", None), ("m", "z", None, "forces/z", "1", None)]
    records = spark.createDataFrame(rows, "model_key string, material_id string, error string, force_file string, version string, note string")
    files = spark.createDataFrame([("forces/a",), ("forces/z",)], "path string")
    got = sorted((r.problem, r.material_id) for r in V.record_problems(manifest, runs, records, ["version", "note"], files=files).collect())
    assert got == sorted([("no record", "e"), ("not in the manifest", "z"), ("recorded twice", "d"), ("version differs", "c"), ("note differs", "d"), ("no force file", "b"), ("invalid force file", "d"), ("invalid force file", "d")])
    assert V.record_problems(manifest, runs.withColumn("save_forces", F.lit(False)), records, [], files=files).where("problem LIKE '%force%'").count() == 0


def test_rollouts(spark):
    cell = [[5.0, 0.0, 0.0], [0.0, 5.0, 0.0], [0.0, 0.0, 5.0]]
    off = [[5.0, 0.0, 0.0], [0.0, 5.0, 0.0], [0.0, 0.01, 5.0]]
    frames, atoms = [], []
    for s in ("good", "steps", "cell", "pbc", "nan", "species", "atoms", "short"):
        for f in range(4 if s != "short" else 3):
            frames.append((s, f, f * 10 + (s == "steps" and f == 2), off if s == "cell" and f == 3 else cell, [True, True, not (s == "pbc" and f == 1)]))
            for i in range(2 if not (s == "atoms" and f == 2) else 3):
                atoms.append((s, f, i, "X" if s == "species" and f == 1 and i == 0 else "HO"[i % 2], float("inf") if s == "nan" and f == 3 else 0.0, 0.0, 0.0))
    f = spark.createDataFrame(frames, "system string, frame int, md_step int, cell array<array<double>>, pbc array<boolean>")
    a = spark.createDataFrame(atoms, "system string, frame int, atom int, species string, x double, y double, z double")
    names = sorted({r[0] for r in frames}) + ["gone"]
    near = [[5.0 + 1e-6, 0.0, 0.0], [0.0, 5.0, 0.0], [0.0, 0.0, 5.0]]
    want = spark.createDataFrame([(s, 4, 10, near, [True] * 3) for s in names], "system string, n_frames int, interval int, cell array<array<double>>, pbc array<boolean>")
    species = spark.createDataFrame([(s, i, "HO"[i]) for s in names for i in range(2)], "system string, atom int, species string")
    got = sorted((r.system, r.problem, r.frame) for r in T.rollout_problems(f, want, a, species).collect())
    assert got == [("atoms", "species", 2), ("cell", "cell or pbc", 3), ("gone", "missing", None), ("nan", "not finite", 3), ("pbc", "cell or pbc", 1), ("short", "frame count", None), ("species", "species", 1), ("steps", "steps", 2)]


def test_aligned_assets_notice_what_is_off(spark, tmp_path):
    base = spark.range(60_000).select((F.col("id") * 7 % 60_013).alias("material_id"), F.col("id").alias("ordinal"), F.lit("f").alias("formula"))
    values = base.where("ordinal % 3 = 0").select(F.lit("a").alias("model_key"), "material_id", (F.col("ordinal") / 7).alias("value")).unionByName(base.where("ordinal < 10").select(F.lit("b").alias("model_key"), "material_id", F.lit(1.0).alias("value")))
    Y.write_aligned(base, values, f"{tmp_path}/assets")
    rows = sorted((r.model_key, r.bundle, r.rows, r["values"], r.aligned) for r in Y.aligned_bundles(spark, f"{tmp_path}/assets").collect())
    assert rows == [("a", 0, 25600, 8534, True), ("a", 1, 25600, 8533, True), ("a", 2, 8800, 2933, True), ("b", 0, 25600, 10, True), ("b", 1, 25600, 0, True), ("b", 2, 8800, 0, True)]
    models = spark.read.parquet(f"{tmp_path}/assets/models")
    in_order = [r.ordinal for r in spark.read.parquet(f"{tmp_path}/assets/models/model_key=a/bundle=1").collect()]
    assert in_order == list(range(25600, 51200))  # a file as it stands
    models.where("NOT (model_key = 'b' AND ordinal = 30000)").write.partitionBy("model_key", "bundle").parquet(f"{tmp_path}/off/models")
    spark.read.parquet(f"{tmp_path}/assets/base").write.partitionBy("bundle").parquet(f"{tmp_path}/off/base")
    off = {(r.model_key, r.bundle): r.aligned for r in Y.aligned_bundles(spark, f"{tmp_path}/off").collect()}
    assert [k for k, v in off.items() if not v] == [("b", 1)]


def test_leaderboard_filters_directions_and_exclusions(spark):
    from assay.operators import leaderboard as L

    rows = [("a", "OSOD", "EFS_GM", ["X"], "active"), ("b", "CSCD", "EF_D", ["X", "Y"], "active"), ("c", "OSOD", "E", [], "superseded"), ("d", "OSCD", "EFSH_GD", ["Y"], "active")]
    models = spark.createDataFrame(rows, "model_key string, openness string, targets string, training_sets array<string>, lifecycle string")
    keys = lambda **f: sorted(r.model_key for r in L.filter_models(models, **f).collect())
    assert keys() == ["a", "b", "d"]  # forces are required by default
    assert keys(targets={}) == ["a", "b", "c", "d"] and keys(targets={"F": False}) == ["c"] and keys(targets={"M": True}) == ["a"] and keys(targets={"H": True, "S": True}) == ["d"]
    assert keys(fs_mode="direct") == ["b", "d"] and keys(targets={}, fs_mode="gradient") == ["a"]
    assert keys(openness=["OSOD", "OSCD"], require=["Y"]) == ["d"] and keys(exclude=["Y"], search="A") == ["a"]
    with pytest.raises(ValueError, match="unknown filter"):
        keys(targets={"Q": True})
    preds = spark.createDataFrame([("a",), ("c",)], "model_key string")
    assert [r.model_key for r in L.active_models(models, preds).collect()] == ["a"]
    assert not L.is_full_run(models, preds) and L.is_full_run(models, models.select("model_key"))
    with pytest.raises(ValueError, match="differ by model"):
        L.shared_subset("most_stable_10k")
    names = spark.createDataFrame([("F1",), ("RMSD",), ("color",)], "metric string")
    assert [r.d for r in names.select(L.metric_direction("metric").alias("d")).collect()] == ["higher", "lower", None]
    got = L.known_ranks(spark.createDataFrame([("a", 0.1, 3.0, 1.0), ("b", 0.5, 1.0, 2.0)], "model_key string, F1 double, MAE double, other double"), ["F1", "MAE", "other"])
    assert {(r.model_key, r.metric): r["rank"] for r in got.collect()} == {("a", "F1"): 2, ("b", "F1"): 1, ("a", "MAE"): 2, ("b", "MAE"): 1}
    curated = spark.createDataFrame([("a", "H-H", "known"), ("a", "Po-Po", "never")], "model_key string, formula string, reason string")
    found = spark.createDataFrame([("a", "H-H"), ("a", "O-O"), ("b", "H"), ("b", "Ra-O")], "model_key string, formula string")
    excluded = L.excluded_formulas(curated, found)
    assert sorted(tuple(r) for r in excluded.collect()) == [("a", "H-H", "known"), ("a", "O-O", "invalid or unsupported curve"), ("b", "H", "invalid or unsupported curve")]
    metrics = spark.createDataFrame([(m, e) for m in "ab" for e in ("H", "O", "N")], "model_key string, element string")
    assert sorted(tuple(r) for r in L.without_excluded(metrics, excluded).collect()) == [("a", "N"), ("b", "N"), ("b", "O")]


def test_curves_on_the_same_grid_and_skipped_elements(spark):
    from assay.operators import curves as K

    x = [1.0 + i / 4 for i in range(12)]
    true = spark.createDataFrame([(e, v, (v - 2) ** 2, v) for e in ("H", "O", "Po") for v in x], "element string, x double, y double, f double")
    pred = true.where("NOT (element = 'O' AND x = 2.5)").withColumn("y", F.col("y") + F.when(F.col("x") < 2, 1.0).otherwise(0.0)).withColumn("f", F.col("f") + 0.5)
    got = {r.element: r for r in K.curve_metrics(pred, true, ["element"], names=("energy_mae", "force_mae"), points=None).collect()}
    assert set(got) == {"H", "O"} and got["O"].energy_mae is None and got["O"].force_mae is None
    assert got["H"].energy_mae == pytest.approx(4 / 12) and got["H"].force_mae == pytest.approx(0.5)
    fine = {r.element: r for r in K.curve_metrics(pred, true, ["element"], names=("force_mae",), points=50, skipped=()).collect()}
    assert set(fine) == {"H", "O", "Po"} and all(r.force_mae == pytest.approx(0.5) for r in fine.values())


def test_duplicates_and_ends(spark):
    from assay.operators import discovery

    rows = [(1, "p", 0.5), (2, "p", 0.1), (3, "p", 0.1), (4, None, 1.0), (5, None, 2.0), (6, "q", None), (7, "q", 0.0)]
    m = spark.createDataFrame(rows, "ordinal long, proto_id string, each_true double")
    assert {r.ordinal for r in discovery.duplicate_prototypes(m).where("is_duplicate").collect()} == {1, 3, 5, 7}
    errors = spark.createDataFrame([("m", i, (i - 50) / 10, float(i)) for i in range(100)], "model_key string, ordinal long, err double, v double")
    out = discovery.end_histograms(errors, "v", 10, 5).collect()
    assert {s: sum(r["count"] for r in out if r.side == s) for s in ("min", "max")} == {"min": 10, "max": 10}
    assert max(r.centre for r in out if r.side == "min") < 56 and min(r.centre for r in out if r.side == "max") < 10
