import json

import pytest
from pyspark.sql import functions as F

from assay.operators.discovery import align, metrics, with_class
from assay.sources import payloads as Y
from assay.sources import readers as S
from assay.streaming import events as R


def test_glob_reader(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"m{i}.csv").write_text(f"material_id,e\na,{i}\n" + ("b,x\n" if i == 2 else ""))
    rows = S.read_glob(spark, f"{tmp_path}/*.csv")
    assert rows.count() == 4
    assert sorted(r.e for r in S.numeric(S.single_row_files(rows), ["e"], {"e": 1000}).collect()) == [0.0, 1000.0]
    assert {r.m for r in rows.select(S.from_path(r"/(m\d)\.csv").alias("m")).collect()} == {"m0", "m1", "m2"}
    with pytest.raises(ValueError, match="no reader"):
        S.read_glob(spark, f"{tmp_path}/*.xyz")


def test_curves_from_json(spark, tmp_path):
    data = {"homo": {"H-H": {"distances": [1.0, 2.0], "energies": [0.5, 0.1]}, "He-He": {"distances": [], "energies": []}, "O-O": {"distances": [2.0, 1.0], "energies": [1.0, 2.0]}}}
    (tmp_path / "c.json").write_text(json.dumps(data))
    curves = S.read_curves(spark, f"{tmp_path}/c.json")
    assert {r.name for r in curves.collect()} == {"H-H", "O-O"}
    grid = spark.createDataFrame([(0, 1.0), (1, 2.0)], "pos int, x double")
    assert [r.name for r in S.grid_violations(curves, grid, ["name"]).collect()] == ["O-O"]
    assert {r.n for r in curves.select(S.homonuclear_name("name").alias("n")).collect()} == {"H", "O"}


FRAME = '2\nLattice="5 0 0 0 5 0 0 0 5" Properties=species:S:1:pos:R:3 energy={e}\nH 0 0 {z}\nO 1 1 1\n'


def test_frames(spark, tmp_path):
    (tmp_path / "water.extxyz").write_text("".join(FRAME.format(e=-i, z=i / 10) for i in range(4)))
    frames, atoms = S.read_frames(spark, f"{tmp_path}/*.extxyz")
    assert [(r.system, r.frame, r.energy, len(r.lattice)) for r in frames.orderBy("frame").collect()] == [("water", i, -float(i), 9) for i in range(4)]
    got = S.frame_slice(atoms, 2, 2).orderBy("atom").collect()
    assert [(r.species, r.z) for r in got] == [("H", 0.2), ("O", 1.0)]
    assert Y.compact_positions(atoms.withColumn("x", F.col("x") + 0.00049)).where("x = 0").count() == 4
    (tmp_path / "bad.extxyz").write_text(FRAME.format(e=1, z=0) + "H 0 0 0\n")
    with pytest.raises(Exception, match="unequal length"):
        S.read_frames(spark, f"{tmp_path}/bad.extxyz")[1].count()


def test_nested_metrics(spark):
    rows = [("m", {"d": {"full": {"f1": 0.1, "mae": 0.2}, "uniq": {"f1": 0.3, "mae": None}}}), ("none", {"d": None})]
    schema = "model_key string, metrics struct<d: struct<full: struct<f1: double, mae: double>, uniq: struct<f1: double, mae: double>>>"
    got = S.flatten_metrics(spark.createDataFrame(rows, schema), ["d.full", "d.uniq"]).collect()
    assert [tuple(r) for r in got] == [("m", 0.3, 0.2)]


def test_payload_upsert(spark):
    old = spark.createDataFrame([("_base", 0), ("a", 1), ("b", 2), ("gone", 3)], "id string, v int")
    new = spark.createDataFrame([("_base", 9), ("b", 20), ("c", 30)], "id string, v int")
    out = Y.upsert(old, new, spark.createDataFrame([("gone",)], "id string"))
    assert [tuple(r) for r in out.collect()] == [("_base", 0), ("a", 1), ("b", 20), ("c", 30)]
    assert Y.upsert(old, new, full_run=True).count() == 3 and Y.unchanged(out, out) and not Y.unchanged(out, old)
    with pytest.raises(ValueError, match="committed"):
        Y.upsert(None, new)
    tag = lambda d: d.withColumn("payload", F.lit("p"))
    r = Y.roster_changes(tag(old), tag(out)).first()
    assert (r.added, r.removed) == (["c"], ["gone"])
    facts = spark.createDataFrame([("m", "a.x", "1"), ("m", "b.y", "2")], "model_key string, path string, value string")
    up = spark.createDataFrame([("m", "a.x", "9"), ("m", "a.z", "3")], "model_key string, path string, value string")
    get = lambda d: {x.path: x.value for x in d.collect()}
    assert get(Y.update_paths(facts, up)) == {"a.x": "9", "b.y": "2", "a.z": "3"}
    assert get(Y.update_paths(facts, up, preserve=True)) == {"a.x": "1", "b.y": "2", "a.z": "3"}
    assert get(Y.replace_section(facts, up.where("path = 'a.z'"), "a")) == {"b.y": "2", "a.z": "3"}


def test_record_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = [json.dumps({"model_key": "m", "material_id": i % 4, "v": i, "at": f"2024-01-01T00:0{i}:00"}) for i in range(6)]
    (tmp_path / "in" / "a.jsonl").write_text("\n".join([*good, '{"model_key": "m", "mat']))
    stream = R.read_records(spark, f"{tmp_path}/in", "model_key string, material_id long, v long, at timestamp")
    once = R.distinct_records(R.good_records(stream), ["model_key", "material_id"], "at")
    assert sorted(r.material_id for r in R.run_available(once, f"{tmp_path}/out").collect()) == [0, 1, 2, 3]
    assert R.run_available(R.quarantined(stream), f"{tmp_path}/bad").count() == 1
    sink = R.latest_into(f"{tmp_path}/latest", ["material_id"], "v")
    R.good_records(stream).writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.material_id, r.v) for r in spark.read.parquet(f"{tmp_path}/latest/version=0").collect()) == [(0, 4), (1, 5), (2, 2), (3, 3)]


def test_running_leaderboard_is_the_batch_one(spark):
    materials = spark.createDataFrame([(i, i, 0.0, (i - 5) / 10, True) for i in range(10)], "material_id long, ordinal long, e_form_dft double, each_true double, uniq_proto boolean")
    preds = spark.createDataFrame([("a", i, (i % 3 - 1) / 5) for i in range(9)], "model_key string, material_id long, e_form_pred double")
    rows = with_class(align(materials, preds))
    batch = metrics(rows, ["model_key"]).first()
    running = R.leaderboard(R.running_counts(rows, ["model_key"])).first()
    assert (batch.tp, batch.fp, batch.fn, batch.tn) == (running.tp, running.fp, running.fn, running.tn)
    assert batch.mae == pytest.approx(running.mae) and batch.rmse == pytest.approx(running.rmse) and batch.f1 == pytest.approx(running.f1)
