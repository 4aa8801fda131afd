"""Operators against values worked out by hand or by NumPy."""

import math

import numpy as np
import pytest
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
from assay.operators.prefix import prefix_sums, top_rows


def value(spark, column, schema=None, row=()):
    df = spark.createDataFrame([row], schema) if schema else spark.range(1)
    return df.select(column.alias("v")).first().v


def test_ids_and_labels(spark):
    df = spark.createDataFrame([("step_2_7",), ("other",), ("step_x_1",)], "id string")
    assert [r.v for r in df.select(S.next_step_id("id").alias("v")).collect()] == ["wbm-2-8", "other", "step_x_1"]
    assert value(spark, S.id_step(F.lit("wbm-3-10"))) == 3
    with pytest.raises(Exception, match="no step"):
        value(spark, S.id_step(F.lit("wbm-9-1")))
    assert value(spark, S.space_group_of_label(F.lit("AB_cP2_221_a_b"))) == 221
    assert value(spark, S.close_id_gaps(F.lit(10), F.array(F.lit(3), F.lit(10), F.lit(4)))) == 8
    assert [value(spark, S.crystal_system(F.lit(n))) for n in (1, 15, 16, 142, 167, 194, 230, 0, 231)] == ["triclinic", "monoclinic", "orthorhombic", "tetragonal", "trigonal", "hexagonal", "cubic", None, None]


def test_formulas(spark):
    assert value(spark, S.parse_formula(F.lit("Ac6 U2Fe0.5O"))) == {"Ac": 6.0, "U": 2.0, "Fe": 0.5, "O": 1.0}
    assert value(spark, S.parse_formula(F.lit("H2OH"))) == {"H": 3.0, "O": 1.0}
    assert value(spark, S.alphabetical_formula(S.parse_formula(F.lit("Fe4O6")))) == "Fe4 O6"
    assert value(spark, S.prototype_formula(S.parse_formula(F.lit("Fe4O6")))) == "A2B3"
    with pytest.raises(Exception, match="flat"):
        value(spark, S.parse_formula(F.lit("Fe(OH)2")))


def test_rounding_and_cleaning(spark):
    xs = [0.0005, 0.0015, 2.5e-3, -0.0025, 1.0045]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r.v for r in df.select(S.round_even("x", 3).alias("v")).collect()] == [float(np.round(x, 3)) for x in xs]
    assert value(spark, S.significant(F.lit(0.012345), 3)) == pytest.approx(0.0123)
    assert [value(spark, S.finite(F.lit(x))) for x in ("1.5", "nan", "inf", "x")] == [1.5, None, None, None]
    assert value(spark, S.round_list(F.array(F.lit(1.234567), F.lit(float("nan"))))) == [1.23457, None]


def test_tensors(spark):
    v = F.array(*(F.lit(float(i)) for i in range(1, 7)))
    assert value(spark, S.voigt_to_tensor(v)) == [[1, 6, 5], [6, 2, 4], [5, 4, 3]]
    assert value(spark, S.directional_average(v)) == 2 and value(spark, S.directional_average(F.array(F.lit(1.0)))) is None
    assert value(spark, S.tensor_average(S.voigt_to_tensor(v))) == 2
    assert value(spark, S.pressure(v)) == pytest.approx(-2 / S.GPA)
    modes = lambda rows: F.array(*(F.array(*map(F.lit, r)) for r in rows))
    assert value(spark, S.imaginary_modes(modes([[-0.005, 0.0, 0.0, 1.0], [0.1, 0.1, 0.1, 1.0]]))) is False
    assert value(spark, S.imaginary_modes(modes([[-0.05, 0.0, 0.0, 1.0]]))) is True
    assert value(spark, S.imaginary_modes(modes([[0.0, 0.0, 0.0, -0.001]]))) is True
    assert value(spark, S.imaginary_modes(modes([[0.0, 0.0, 0.0, 1.0], [-0.001, 1.0, 1.0, 1.0]]))) is True


def test_relative_difference(spark):
    assert value(spark, S.relative_difference(F.lit(3.0), F.lit(1.0))) == 1
    assert value(spark, S.relative_difference(F.lit(0.0), F.lit(0.0))) == 0
    assert value(spark, S.relative_difference(F.lit(None).cast("double"), F.lit(1.0))) == -2
    with pytest.raises(Exception, match="reference"):
        value(spark, S.relative_difference(F.lit(1.0), F.lit(-1.0)))


def test_scores(spark):
    assert [value(spark, S.subscore(F.lit(x), 2.0)) for x in (0.0, 1.0, 3.0)] == [1.0, 0.5, 0.0]
    assert value(spark, S.subscore(F.lit(math.sqrt(9e3 * 3e5)), 3e5, 9e3, log=True)) == pytest.approx(0.5)
    row = spark.createDataFrame([(0.8, 0.5, 0.03), (0.8, None, 0.03)], "f1 double, kappa_srme double, rmsd double")
    got = [r.v for r in row.select(L.combined_score().alias("v")).collect()]
    assert got == [pytest.approx(0.5 * 0.8 + 0.4 * 0.75 + 0.1 * 0.8), None]
    odd = spark.createDataFrame([(1.2, 0.5, 0.03), (0.8, 2.5, 0.03), (0.8, 0.5, -0.1), (0.8, 2.0, 0.3)], "f1 double, kappa_srme double, rmsd double")
    assert [r.v for r in odd.select(L.combined_score().alias("v")).collect()] == [None, None, None, pytest.approx(0.4)]
    parts = {"a": [("x", 0.25, 2.0, 0.0, False), ("y", 0.75, 4.0, 1.0, False)], "b": [("t", 1.0, 100.0, 1.0, True)]}
    rows = [(1.0, 1.0, 10.0, 0), (1.0, None, 10.0, 0), (1.0, 1.0, 0.0, 0), (1.0, float("nan"), 10.0, 0), (1.0, 1.0, 10.0, 100)]
    df = spark.createDataFrame(rows, "x double, y double, t double, excluded int")
    score = lambda w: [r.v for r in df.select(L.pillar_score(w, parts, F.col("excluded")).alias("v")).collect()]
    whole = pytest.approx((0.875 * 2 + 0.5) / 3)
    assert score({"a": 2.0, "b": 1.0}) == [whole, None, None, None, 0.0]
    assert score({"a": 0.0, "b": 1.0}) == [0.5, 0.5, None, 0.5, 0.0]  # a pillar without weight is not looked at
    assert score({"a": 0.0, "b": 0.0}) == [None] * 5


def discovery_case(spark):
    materials = [(i, i, 0.0, t, True) for i, t in enumerate([-0.1, 0.0, 0.2, 0.3, -0.2, 0.5])]
    m = spark.createDataFrame(materials, "material_id long, ordinal long, e_form_dft double, each_true double, uniq_proto boolean")
    preds = [("a", 0, 0.0), ("a", 1, 0.1), ("a", 2, -0.3), ("a", 3, 0.1), ("a", 4, 9.0), ("b", 0, -0.1)]
    return m, spark.createDataFrame(preds, "model_key string, material_id long, e_form_pred double")


def test_discovery_metrics(spark):
    m, p = discovery_case(spark)
    got = {r.model_key: r for r in D.metrics(D.with_class(D.align(m, p)), ["model_key"]).collect()}
    a = got["a"]
    assert (a.tp, a.fn, a.fp, a.tn, a.n_pairs, a.missing_preds) == (1, 2, 1, 2, 4, 2)
    assert a.precision == 0.5 and a.recall == pytest.approx(1 / 3) and a.f1 == pytest.approx(0.4) and a.daf == pytest.approx(1.0)
    assert a.mae == pytest.approx(0.125) and got["b"].r2 is None
    true, pred = np.array([-0.1, 0.0, 0.2, 0.3]), np.array([-0.1, 0.1, -0.1, 0.4])
    assert a.r2 == pytest.approx(1 - ((pred - true) ** 2).sum() / ((true - true.mean()) ** 2).sum())
    with pytest.raises(Exception, match="unknown materials"):
        D.align_strict(m.where("material_id < 4"), p).count()
    assert D.align_strict(m, p).count() == 12


def test_published_counts_give_published_rates(spark):
    df = spark.createDataFrame([(34420, 9672, 24576, 188295)], "tp long, fn long, fp long, tn long")
    r = D.classification_rates(df).first()
    assert [round(x, 3) for x in (r.precision, r.recall, r.accuracy, r.f1)] == [0.583, 0.781, 0.867, 0.668]


def test_rates_without_denominator(spark):
    r = D.classification_rates(spark.createDataFrame([(0, 0, 0, 5)], "tp long, fn long, fp long, tn long")).first()
    assert r.precision is None and r.recall is None and r.f1 is None and r.tnr == 1


def test_most_stable_keeps_order_of_ties(spark):
    m, p = discovery_case(spark)
    rows = D.align(m, p).where("model_key = 'b'")
    assert [r.material_id for r in D.most_stable(rows, 3).orderBy("ordinal").collect()] == [0, 1, 2]


def test_roc(spark):
    rng = np.random.default_rng(0)
    rows = [("m", float(np.round(s, 1)), float(t)) for s, t in zip(rng.normal(size=300), rng.normal(size=300), strict=True)]
    df = spark.createDataFrame(rows, "model_key string, each_pred double, each_true double")
    pos, neg = [s for _, s, t in rows if t > 0], [s for _, s, t in rows if t <= 0]
    area = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert D.roc_auc(df).first().auc == pytest.approx(round(area, 2))
    corners = D.roc_curve(df).orderBy("fpr", "tpr").collect()
    assert (corners[0].tpr, corners[0].fpr) == (0, 0) and (corners[-1].tpr, corners[-1].fpr) == (1, 1)
    scores = sorted({s for _, s, _ in rows}, reverse=True)
    up = np.array([[sum(x >= s for x in side) for side in (pos, neg)] for s in scores])
    inner = (np.diff(up, 2, axis=0) != 0).any(axis=1)
    keep = [True, *inner, True]
    want = [(s, p / len(pos), n / len(neg)) for s, (p, n), k in zip(scores, up, keep, strict=True) if k]
    assert [(r.score, r.tpr, r.fpr) for r in sorted(corners[1:], key=lambda r: -r.score)] == [(s, pytest.approx(t), pytest.approx(f)) for s, t, f in want]


def test_prefix_sums_and_top_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), float(np.round(x, 1)), i) for i, (k, x) in enumerate(zip(rng.integers(0, 3, 500), rng.normal(size=500), strict=True))]
    df = spark.createDataFrame(rows, "k int, x double, i int")
    for down in (False, True):
        got = {r.i: r.s for r in prefix_sums(df, "x", {"s": F.col("i")}, ["k"], ["i"], descending=down, ranges=7).collect()}
        for k in range(3):
            total = 0
            for _, i in sorted((-x if down else x, i) for kk, x, i in rows if kk == k):
                total += i
                assert got[i] == total
    top = {(r.k, r.i): r.place for r in top_rows(df, ["k"], [F.col("x"), F.col("i")], 5).collect()}
    for k in range(3):
        assert [top[k, i] for _, i in sorted((x, i) for kk, x, i in rows if kk == k)[:5]] == [1, 2, 3, 4, 5]
    assert prefix_sums(df.limit(0), "x", {"s": F.col("i")}).count() == 0


@pytest.mark.parametrize(("low", "high", "bins"), [(-1.0, 1.0, 7), (0.0, 0.3, 3), (-0.45, 0.45, 64)])
def test_histogram_is_numpys(spark, low, high, bins):
    rng = np.random.default_rng(2)
    edges = [low + i * ((high - low) / bins) for i in range(bins)] + [high]
    xs = [*rng.normal(0, 0.5, 500), *edges, low - 1e-12, high + 1e-12]
    df = spark.createDataFrame([(float(x),) for x in xs] + [(None,), (float("nan"),)], "x double")
    got = [r["count"] for r in H.histogram(df, "x", low, high, bins).orderBy("bin").collect()]
    assert got == np.histogram(xs, bins=np.array(edges))[0].tolist()


def test_range_histogram_of_one_value(spark):
    df = spark.createDataFrame([("k", 2.0), ("k", 2.0)], "k string, x double")
    got = H.data_range_histogram(df, "x", 4, ["k"]).orderBy("bin").collect()
    assert [r["count"] for r in got] == np.histogram([2.0, 2.0], 4)[0].tolist()


def numpy_w1(x, u, y, v):
    at = np.unique(np.r_[x, y])
    f = np.array([u[x <= t].sum() / u.sum() for t in at])
    g = np.array([v[y <= t].sum() / v.sum() for t in at])
    return float((np.abs(f - g)[:-1] * np.diff(at)).sum())


def test_wasserstein_and_quantiles(spark):
    rng = np.random.default_rng(3)
    x, u, y, v = np.round(rng.normal(size=40), 1), rng.random(40), np.round(rng.normal(1, 2, 30), 1), rng.random(30)
    a = spark.createDataFrame([(1, float(i), float(j)) for i, j in zip(x, u, strict=True)], "k int, x double, w double")
    b = spark.createDataFrame([(1, float(i), float(j)) for i, j in zip(y, v, strict=True)], "k int, x double, w double")
    assert A.wasserstein(a, b, ["k"]).first().w1 == pytest.approx(numpy_w1(x, u, y, v))
    assert A.wasserstein(a, a, ["k"]).first().w1 == 0
    got = {r.level: r.quantile for r in A.weighted_quantiles(a, ["k"], [0.0, 0.3, 1.0]).collect()}
    order = np.argsort(x, kind="stable")
    cdf = np.cumsum(u[order]) / u.sum()
    assert got[0.3] == x[order][np.searchsorted(cdf, 0.3)] and got[0.0] == x.min()


def test_interpolation_is_numpys(spark):
    rng = np.random.default_rng(4)
    x = np.sort(rng.random(12))
    y = rng.random(12)
    grid = np.r_[x[3], x[0], x[-1], rng.uniform(x[0], x[-1], 20)]
    knots = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y, strict=True)], "k int, x double, y double")
    points = spark.createDataFrame([(1, float(g)) for g in [*grid, x[0] - 1]], "k int, x double")
    got = {r.x: r.y for r in A.interpolate(knots, points, ["k"]).collect()}
    assert [got[float(g)] for g in grid] == pytest.approx(np.interp(grid, x, y).tolist()) and got[float(x[0] - 1)] is None


def morse(x, depth=2.0, a=1.5, r=1.4):
    return depth * (1 - np.exp(-a * (x - r))) ** 2 - depth


def curve(spark, x, y):
    return spark.createDataFrame([("H", float(i), float(j)) for i, j in zip(x, y, strict=True)], "element string, x double, y double")


def test_curve_metrics_of_a_smooth_well(spark):
    x = np.linspace(0.5, 6, 60)
    c = curve(spark, x, morse(x))
    got = K.curve_metrics(c, c, ["element"]).first()
    assert got.tortuosity == pytest.approx(1) and got.energy_diff_flips == 1 and got.energy_mae == 0 and got.wall_mae == 0 and got.bond_length_error == 0
    fit = K.well_fit(c, ["element"]).first()
    near = np.argsort(np.abs(x - x[morse(x).argmin()]))[:5]
    p = np.polyfit(x[near], morse(x)[near], 2)
    assert fit.r_eq == pytest.approx(-p[1] / (2 * p[0])) and fit.curvature == pytest.approx(2 * p[0])
    with pytest.raises(ValueError, match="unknown"):
        K.curve_metrics(c, c, ["element"], names=("nonsense",))


def test_wall_radii(spark):
    x = np.array([0.5, 1.0, 1.5, 2.0, 3.0])
    c = curve(spark, x, [30.0, 10.0, 2.0, -1.0, 0.0])
    got = {r.wall: r.r for r in K.wall_radii(c, ["element"]).collect()}
    assert got[5.0] == pytest.approx(np.interp(5, [2, 10], [1.5, 1.0])) and got[20.0] == pytest.approx(0.75) and got[50.0] is None
    rising = curve(spark, x, [0.0, 1.0, 2.0, 3.0, 4.0])
    assert all(r.r is None for r in K.wall_radii(rising, ["element"]).collect())


def test_flips_drop_small_differences(spark):
    c = curve(spark, range(6), [0, 1, 1.0001, 0.5, 2.0, 1.0])
    got = K.flips(c, ["element"], threshold=1e-2).first()
    assert got.flips == 3 and got.jump == pytest.approx(1.5001 + 2.0001 + 2.5)
    assert K.force_flips(curve(spark, range(5), [1, 0.001, -1, 0.0, 2]), ["element"]).first().flips == 2


def test_sequential_edits(spark):
    c = curve(spark, range(7), [5, 4, -40, -70, 2, 1, 0])
    got = {int(r.x): r.round for r in K.drop_collapsed(c, ["element"]).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 1, 4: 0, 5: 0, 6: 0}
    rows = [("H", float(i), y, b) for i, y, b in [(0, 3, "up"), (1, 2, "up"), (2, -5, "odd"), (2, 1.2, "up"), (3, 0, "up"), (4, 0, "up")]]
    df = spark.createDataFrame([(e, x, float(y), b) for e, x, y, b in rows], "element string, x double, y double, branch string")
    got = {r.x: (r.y, r.branch, r.edited) for r in K.replace_branch_drops(df, ["element"]).collect()}
    assert got[2.0] == (1.2, "up", True) and not got[1.0][2]
    assert K.drop_bumps(curve(spark, range(4), [0, 0, 9, 0]), ["element"]).count() == 3
    down = K.downsample(curve(spark, range(1000), np.sin(np.arange(1000) / 50)), ["element"], 20).orderBy("x").collect()
    assert 18 <= len(down) <= 20 and down[0].x == 0 and down[-1].x == 999
    # worked by hand: buckets are points 2-3, 4-5 and 5 of 0 to 5, so 3, 4 and the last point stay
    zigzag = curve(spark, range(6), [0, 0, 1, 9, 0, 0])
    assert [r.x for r in K.downsample(zigzag, ["element"], 5).orderBy("x").collect()] == [0, 2, 3, 5]


def test_collapsed_ends_and_single_points(spark):
    low_end = curve(spark, range(3), [-100, 0, 1])
    assert {r.x: r.round for r in K.drop_collapsed(low_end, ["element"]).collect()} == {0: 1, 1: 0, 2: 0}
    assert [r.round for r in K.drop_collapsed(curve(spark, [1], [-100]), ["element"]).collect()] == [0]
    two = curve(spark, range(5), [0, -50, 0, -60, 0])
    assert {int(r.x): r.round for r in K.drop_collapsed(two, ["element"]).collect()} == {0: 0, 1: 1, 2: 0, 3: 2, 4: 0}


def test_branch_drops_need_every_condition(spark):
    def mended(*points):
        rows = [("H", float(x), float(y), b) for x, y, b in points]
        df = spark.createDataFrame(rows, "element string, x double, y double, branch string")
        return [r.x for r in K.replace_branch_drops(df, ["element"]).where("edited").collect()]

    around = [(0, 0, "a"), (2, 0, "a")]
    assert mended(*around, (1, -5, "b"), (1, 0.1, "a")) == [1.0]
    assert mended(*around, (1, -2, "b"), (1, 0.1, "a")) == []  # too small a drop
    assert mended(*around, (1, -5, "b"), (1, -3, "a")) == []  # the other branch is not high enough
    assert mended(*around, (1, -5, "b"), (1, 6, "a")) == []  # it is further from the line
    assert mended(*around, (1, -5, "b")) == []  # no such point
    assert mended((0, 0, "a"), (2, -9, "a"), (1, -8, "b"), (1, -4, "a")) == []  # not below both neighbours


def test_bumps_are_above_both_neighbours(spark):
    slope = curve(spark, range(4), [0, 1, 1.3, 1.4])  # above the line, but not above its right neighbour
    assert K.drop_bumps(slope, ["element"]).count() == 4
    assert [r.x for r in K.drop_bumps(curve(spark, range(4), [0, 0, 0.15, 0.02]), ["element"]).orderBy("x").collect()] == [0, 1, 3]


def test_reference_gate_and_windows(spark):
    x = np.arange(0.5, 6.5, 0.5)
    good, rough = morse(x), morse(x) + 3 * (np.arange(len(x)) % 2)
    rows = [(e, float(a), float(b), float(-b)) for e, y in (("A", good), ("B", rough), ("C", np.where(x > 5, np.inf, good))) for a, b in zip(x, y, strict=True)]
    true = spark.createDataFrame(rows, "element string, x double, y double, f double")
    elements = spark.createDataFrame([("A", 1.0, 1.5), ("B", 1.0, 1.5), ("C", 1.0, 1.5)], "element string, r_cov double, r_vdw double")
    assert {r.element for r in K.low_quality_references(true, ["element"]).collect()} == {"B", "C"}
    assert {r.element for r in K.low_quality_references(true, ["element"], elements=elements).collect()} == {"B"}  # C is bad beyond its window only
    assert K.low_quality_references(true, ["element"], least=20).count() == 0
    pred = true.where("element <> 'C'")
    masses = spark.createDataFrame([("A", 2.0), ("B", 2.0)], "element string, mass double")
    got = {r.element: r for r in K.curve_metrics(pred, true, ["element"], elements=elements, masses=masses).collect()}
    assert set(got["A"].asDict()) == {"element", *K.CURVE_METRICS}
    assert got["A"].energy_mae == 0 and got["A"].vib_freq_error == 0 and got["A"].force_mae == 0 and got["A"].bond_length_error == 0
    assert got["B"].energy_mae is None and got["B"].wall_mae is None and got["B"].energy_diff_flips > 3
    inside = [b for a, b in zip(x, good, strict=True) if 0.9 <= a <= 4.65]
    assert got["A"].force_total_variation == pytest.approx(np.abs(np.diff(inside)).sum())
    broken = pred.withColumn("f", F.when((F.col("element") == "A") & (F.col("x") == 2.0), float("nan")).otherwise(F.col("f")))
    assert [r.element for r in K.curve_metrics(broken, true, ["element"], elements=elements).select("element").collect()] == ["B"]
    with pytest.raises(ValueError, match="need forces"):
        K.curve_metrics(pred.drop("f"), true, ["element"], names=("force_jump",))


def test_reference_build(spark):
    rows = [("H", "p", b, float(x), float(y)) for b, ys in (("a", [5, 1, 0, 0.1, 0.2]), ("b", [6, 2, -9, 0.3, 0.4]), ("c", [7, 3, 2, 1, -80])) for x, y in enumerate(ys)]
    candidates = spark.createDataFrame(rows, "element string, xc string, branch string, x double, y double")
    expected = spark.createDataFrame([("H", "p")], "element string, xc string")
    curves, summary = K.build_reference(candidates, ["element"], expected)
    assert [r.y for r in curves.orderBy("x").collect()] == [5, 1, 0, 0.1, 0.2]
    assert summary.first().asDict() == {"xc": "p", "curves": 1, "points": 5, "collapsed": 1, "mended": 1, "bumps": 0, "tail_jumps": 2}
    with pytest.raises(ValueError, match="incomplete"):
        K.build_reference(candidates, ["element"], expected.union(spark.createDataFrame([("He", "p")], "element string, xc string")))


def test_skewed_cells(spark):
    rng = np.random.default_rng(4)
    cell = np.array([[4, 0, 0], [1.5, 4, 0], [0, 0.5, 5]])
    points = rng.random((3, 8, 3)) @ cell
    rows = [("s", f, i, *map(float, p), "HO"[i % 2]) for f in range(3) for i, p in enumerate(points[f])]
    atoms = spark.createDataFrame(rows, "system string, frame int, atom int, x double, y double, z double, species string")
    cells = spark.createDataFrame([("s", cell.tolist())], "system string, cell array<array<double>>")
    shifts = np.array([[a, b, c] for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]) @ cell
    image = lambda d: d + shifts[np.linalg.norm(d + shifts, axis=1).argmin()]
    got = {(r.frame, r.i, r.j): (r.dx, r.dy, r.dz, r.r) for r in T.pair_distances(atoms, cells).collect()}
    for (f, i, j), v in got.items():
        d = image(points[f][j] - points[f][i])
        assert v == pytest.approx((*d, np.linalg.norm(d)))
    g = {r.bin: r.g for r in T.rdf(atoms, cells, bins=5).collect()}
    distances = [np.linalg.norm(image(points[f][j] - points[f][i])) for f in range(3) for i in range(8) for j in range(i)]
    counts, edges = np.histogram(distances, 5, (0, 2.0))
    want = counts / (3 * 64 / 2 / abs(np.linalg.det(cell)) * 4 / 3 * np.pi * np.diff(edges**3))
    assert [g[i] for i in range(5)] == pytest.approx(want.tolist())
    v = {(r.frame, r.atom): (r.vx, r.vy, r.vz) for r in T.velocities(atoms, cells, 0.5).collect()}
    assert v[1, 0] == pytest.approx(tuple((image(points[1][0] - points[0][0]) + image(points[2][0] - points[1][0])) / 1.0))
    radii = spark.createDataFrame([("H", 0.6), ("O", 0.9)], "species string, radius double")
    bonds = {(r.frame, r.i, r.j) for r in T.bonds_within(atoms, cells, radii).collect()}
    reach = {"HH": 1.5, "HO": 1.875, "OH": 1.875, "OO": 2.0}
    assert bonds == {(f, i, j) for (f, a, b), w in got.items() for i, j in ((a, b), (b, a)) if w[3] < reach["HO"[i % 2] + "HO"[j % 2]]}
    with pytest.raises(Exception, match="beyond half the cell"):
        T.rdf(atoms, cells, 5, r_max=2.5).collect()


def test_energy_and_force_errors(spark):
    frames = [("s", f, float(e), 2) for f, e in enumerate([1.0, 4.0, 2.0])]
    pred = spark.createDataFrame(frames, "system string, frame int, energy double, n_atoms int")
    true = pred.withColumn("energy", F.col("energy") + F.when(F.col("frame") == 1, 6.0).otherwise(0.0))
    forces = spark.createDataFrame([("s", 0, a, 1.0, 2.0, 3.0) for a in (0, 1)], "system string, frame int, atom int, fx double, fy double, fz double")
    got = T.energy_force_rmse(pred, true, forces=(forces, forces.withColumn("fx", F.col("fx") + F.col("atom") * 3))).first()
    assert got.energy_rmse == pytest.approx(np.std([0, 3, 0])) and got.force_rmse == pytest.approx(np.sqrt(9 / 6))
    assert T.energy_force_rmse(pred, true).first().force_rmse is None


def test_null_keys_stay_in_histograms(spark):
    df = spark.createDataFrame([(None, 0.5), ("a", 0.5), (None, 0.6)], "k string, v double")
    assert {(r.k, r["count"]) for r in H.histogram(df, "v", 0, 1, 1, ["k"]).collect()} == {(None, 2), ("a", 1)}
    assert {(r.k, r["count"]) for r in H.data_range_histogram(df, "v", 1, ["k"]).collect()} == {(None, 2), ("a", 1)}


def test_nested_and_element_histograms(spark):
    df = spark.createDataFrame([([[-1.0, 2.0], [0.5]],), (None,)], "v array<array<double>>")
    assert [r["count"] for r in H.nested_histogram(df, "v", 0, 3, 3).orderBy("bin").collect()] == [1, 1, 1]
    sites = spark.createDataFrame([(1, 0, "H", 0.1), (1, 1, "H", 0.9), (2, 0, "O", 0.1)], "frame int, site int, element string, m double")
    assert {(r.element, r.bin): r["count"] for r in H.element_histogram(sites, "m", 0, 1, 2).collect()} == {("H", 0): 0, ("H", 1): 1, ("O", 0): 1, ("O", 1): 0}


def test_staircase_and_rank_shifts(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 2.0, 3.0), ("c", 3.0, 4.0), ("d", 4.0, 1.0)], "model_key string, x double, y double")
    assert [(r.x, r.y) for r in L.staircase(df, "x", "y").orderBy("x", "part").collect()] == [(1, 5), (2, 5), (2, 3), (4, 3), (4, 1)]
    assert L.staircase(df.limit(1), "x", "y").count() == 0
    got = {r.model_key: (r["shift"], r.spearman_without) for r in L.rank_shifts(df, "x", "y").collect()}
    assert got["a"] == (3.0, pytest.approx(-0.5)) and got["c"] == (0.0, pytest.approx(-1.0))


@pytest.mark.parametrize("shards,sizes", [(4, {7: 23, 5: 1, 3: 40, 0: 4}), (3, {1000: 1, 9: 7, 8: 50, 1: 30}), (5, {12: 2, 11: 3, 5: 1, 2: 90, 1: 3}), (1, {3: 2, 1: 1}), (6, {4: 3})])
def test_largest_first_equals_one_by_one(spark, shards, sizes):
    import heapq
    import random

    ids = list(range(sum(sizes.values())))
    random.Random(1).shuffle(ids)
    rows, at = [], 0
    for size, n in sizes.items():
        rows += [(i, size) for i in ids[at : at + n]]
        at += n
    loads, want = [(0, s) for s in range(shards)], {}
    for i, size in sorted(rows, key=lambda r: (-r[1], r[0])):
        load, s = heapq.heappop(loads)
        want[i] = s
        heapq.heappush(loads, (load + size, s))
    df = spark.createDataFrame(rows, "id long, size long").repartition(3)
    assert {r.id: r.shard for r in P.place_largest_first(df, shards).collect()} == want


def test_following_rows_come_from_the_next_range(spark):
    from assay.operators.prefix import prefix_sums

    rows = [(k, i % 7, i) for k in ("a", "b", None) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, x int, i int").repartition(4)
    for descending in (False, True):
        out = prefix_sums(df, "x", {"upto": F.lit(1).cast("long")}, ["k"], ["i"], descending, ranges=9, following={"next_i": F.col("i")}).collect()
        for k in ("a", "b", None):
            order = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1] if descending else r[1], r[2]))
            got = sorted((r for r in out if r.k == k), key=lambda r: r.upto)
            assert [r.i for r in got] == [r[2] for r in order] and [r.next_i for r in got] == [r[2] for r in order[1:]] + [None]


def test_best_mode_conductivity_and_model_means(spark):
    tensor = [[3.0, 0.0, 0.0], [0.0, 6.0, 0.0], [0.0, 0.0, 9.0]]
    # one value that is not finite rejects the whole array
    modes = [("a", 1.0, tensor, 2.0), ("a", 5.0, None, None), ("b", 1.0, tensor, 2.0), ("b", float("nan"), tensor, 3.0), ("c", None, tensor, 2.0), ("c", 1.0, None, 3.0), ("d", None, None, None)]
    df = spark.createDataFrame(modes, "material_id string, average double, tensor array<array<double>>, total double")
    assert sorted((r.material_id, r.k or 0) for r in Q.best_mode_conductivity(df, ["material_id"]).collect()) == [("a", 1), ("a", 5), ("b", 6), ("b", 6), ("c", 2), ("c", 3), ("d", 0)]
    rows = spark.createDataFrame([("m", 0.5, 0.5, -0.5, 1.0, False, 0.12345), ("m", 2.0, 1.0, 1.0, None, True, 0.2)], "model_key string, srme double, sre double, srd double, kappa_pred double, imaginary boolean, w1 double")
    got = Q.model_metrics(rows).first()
    assert (got.mean_srme, got.failure_rate, got.imaginary_rate, got.mean_w1) == (1.25, 0.5, 0.5, pytest.approx((0.1234 + 0.2) / 2, abs=6e-5))
    with pytest.raises(Exception, match="between 0 and 2"):
        Q.model_metrics(rows.withColumn("sre", F.lit(3.0))).collect()


def test_minimum_image(spark):
    cell = F.array(*(F.array(*map(F.lit, r)) for r in [[4.0, 0.0, 0.0], [1.5, 4.0, 0.0], [0.0, 0.5, 5.0]]))
    d = np.array([3.1, 2.9, 2.2])
    m = np.array([[4, 0, 0], [1.5, 4, 0], [0, 0.5, 5]])
    want = min(np.linalg.norm(d + np.array([a, b, c]) @ m) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1))
    two = spark.createDataFrame([("s", 0, 0, 0.0, 0.0, 0.0), ("s", 0, 1, *d.tolist())], "system string, frame int, atom int, x double, y double, z double")
    assert T.pair_distances(two, two.select("system").distinct().withColumn("cell", cell)).first().r == pytest.approx(want)
    cells = spark.createDataFrame([("s", m.tolist(), [True, True, True])], "system string, cell array<array<double>>, pbc array<boolean>")
    assert T.image_radius(cells).first().radius == pytest.approx(2.0)


def gas(spark, frames=6, atoms=9, edge=6.0):
    rng = np.random.default_rng(5)
    start = rng.random((atoms, 3)) * edge
    v = rng.normal(0, 0.05, (atoms, 3))
    rows = [("s", f, i, *map(float, (start[i] + f * v[i]) % edge)) for f in range(frames) for i in range(atoms)]
    return spark.createDataFrame(rows, "system string, frame int, atom int, x double, y double, z double"), v


def test_velocities_unwrap(spark):
    atoms, v = gas(spark)
    got = T.velocities(atoms, 6.0, 2.0).collect()
    assert all(np.allclose([r.vx, r.vy, r.vz], v[r.atom] / 2) for r in got)
    masses = spark.createDataFrame([("s", i, 2.0) for i in range(9)], "system string, atom int, mass double")
    t = T.kinetic_temperature(T.velocities(atoms, 6.0, 2.0), masses).first().temperature
    assert t == pytest.approx((v**2 / 4).sum() * 2 * T._U_A2_FS2 / (3 * 9 * T.KB))


def test_distributions(spark):
    atoms, _ = gas(spark)
    g = T.rdf(atoms, 6.0, 30)
    assert T.rdf_error(g, g).first().rdf_error == 0
    pairs = T.pair_distances(atoms, 6.0).where("r <= 3").count()
    n = g.withColumn("n", F.col("g") * 6 * 81 / 2 * (4 / 3) * math.pi * (F.pow((F.col("bin") + 1) * 0.1, F.lit(3)) - F.pow(F.col("bin") * 0.1, F.lit(3))) / 216).agg(F.sum("n")).first()[0]
    assert n == pytest.approx(pairs)
    a = T.adf(atoms, 6.0, 2.5, 36)
    assert a.agg(F.sum(F.col("density") * 5.0)).first()[0] == pytest.approx(1) and T.adf_error(a, a).first().adf_error == 0
    with pytest.raises(ValueError):
        T.rdf(atoms, 6.0, 30, 4.0)


def test_vibrations(spark):
    rows = [("s", f, i, math.sin(2 * math.pi * f * 5 / 64), 0.0, 0.0) for f in range(64) for i in range(3)]
    v = spark.createDataFrame(rows, "system string, frame int, atom int, vx double, vy double, vz double")
    d = T.vdos(v, 1.0)
    assert d.orderBy(F.col("power").desc()).first().freq == pytest.approx(5 / 64) and d.agg(F.sum("power")).first()[0] == pytest.approx(1)
    assert T.vdos_error(d, d).first().vdos_error < 1

    def error(true, pred):
        side = lambda y: spark.createDataFrame([("s", float(i), float(v)) for i, v in enumerate(y)], "system string, freq double, power double")
        return T.vdos_error(side(pred), side(true)).first().vdos_error

    assert error([0, 5, 5, 0, 0, 0], [0, 5, 5, 0, 0, 50]) == 0  # power beyond the reference's band is cut on both sides
    assert error([0, 5, 0, 0], [0, 9, 0, 0]) == 0 and error([0, 5, 0, 0], [5, 0, 0, 0]) == 100  # no spread
    assert error([0, 5, 5, 0, 0], [0, 0, 0, 0, 4]) == 100  # nothing left in the band
    assert error([0, 1, 1, 0, 0], [0, 1, 0, 1, 0]) == 100 and error([0, 1, 1, 1, 0], [0, 1, 1, 2, 0]) == pytest.approx(100 * 0.25 / math.sqrt(2 / 3))


def test_time_grids(spark):
    df = spark.createDataFrame([("s", 0.5, 2.0, 101, 26)], "system string, a double, b double, n_a long, n_b long")
    df = df.select("*", F.col("a").cast("decimal(18,9)").alias("dt_a"), F.col("b").cast("decimal(18,9)").alias("dt_b"))
    got = T.matched_counts(df.join(T.time_strides(df), "system")).first()
    assert (got.stride_a, got.stride_b, got.use_a, got.use_b) == (4, 1, 101, 26)


def test_pressure(spark):
    df = spark.createDataFrame([("s", 1.0), ("s", 1.0)], "system string, pressure double")
    r = T.pressure_metrics(df, df).first()
    assert (r.mean_error, r.w1, r.histogram_error) == (0, 0, 0)
    far = spark.createDataFrame([("s", 5.0), ("s", 6.0)], "system string, pressure double")
    r = T.pressure_metrics(far, df).first()
    assert (r.mean_error, r.w1, r.histogram_error) == (4.5, 4.5, 100)


def test_conductivity(spark):
    rows = [("m", q, b, float(1 + q + b), 1.0, 10.0) for q in range(2) for b in range(2)]
    schema = "material_id string, q int, b int, k double, w double, kappa double"
    true = spark.createDataFrame(rows, schema)
    pred = true.withColumn("k", F.col("k") * 2).withColumn("kappa", F.lit(20.0))
    one = lambda p, t=true: Q.srme(p, t, ["material_id"]).first().srme
    assert one(pred) == pytest.approx(2 * (8 / 2) / 30)  # weights count once per q
    assert one(pred.limit(3)) == 2 and one(pred.limit(0)) == 2
    # the prediction's weights, not the reference's
    assert one(pred.withColumn("w", F.col("q") + 1.0), true.withColumn("w", F.lit(None).cast("double"))) == pytest.approx(2 * (8 / 3) / 30)
    for c, bad in (("k", "NaN"), ("kappa", "-1"), ("kappa", None), ("w", "-1"), ("w", "0"), ("w", None)):
        assert one(pred.withColumn(c, F.lit(bad).cast("double"))) == 2
    none = true.withColumn("kappa", F.lit(0.0))
    assert one(none, none) == 0 and one(pred.withColumn("kappa", F.lit(0.0)), none) == 2
    assert one(pred.withColumn("k", F.col("k") * 1000)) == 2
    for c in ("k", "kappa"):
        with pytest.raises(Exception, match="invalid reference"):
            one(pred, true.withColumn(c, F.lit("NaN").cast("double")))
    hot = lambda d, t, f: d.withColumn("t", F.lit(t)).withColumn("kappa", F.col("kappa") * f)
    both = Q.srme(hot(pred, 300, 1.0).unionByName(hot(pred, 600, 2.0)), hot(true, 300, 1.0).unionByName(hot(true, 600, 2.0)), ["material_id"], "t")
    assert sorted((r.t, round(r.srme, 9)) for r in both.collect()) == [(300, round(8 / 30, 9)), (600, round(8 / 60, 9))]
    assert [r.srme for r in Q.srme(hot(pred, 300, 1.0), hot(true, 300, 1.0).unionByName(hot(true, 600, 2.0)), ["material_id"], "t").collect()] == [2, 2]
    flags = [(0.5, None, None, 5, None, 1), (0.5, False, 0, 5, 6, 1), (0.5, False, 7, None, 7, 1), (0.5, False, 7, None, 8, 1), (0.5, False, 7, 8, 7, 1), (0.5, True, 7, 7, 7, 1), (None, False, 7, 7, 7, 1), (0.5, False, 7, 7, 7, 3), (0.5, False, 7, None, None, 1)]
    flags = spark.createDataFrame([(i, 1.0, 1.0, *r) for i, r in enumerate(flags)], "i int, kappa_pred double, kappa_true double, srme double, imaginary boolean, final_spg int, init_spg int, reference_spg int, n_temperatures int")
    assert [r.srme for r in Q.material_metrics(flags).orderBy("i").collect()] == [0.5, 0.5, 0.5, 2, 2, 2, 2, 2, 0.5]
    alias = spark.createDataFrame([(1, None, "x"), (1, 2, "y")], "spg int, spg_num int, id string")
    with pytest.raises(Exception, match="disagree"):
        Q.coalesce_aliases(alias, {"spg_num": ["spg"]}).collect()
    assert [r.spg_num for r in Q.coalesce_aliases(alias, {"spg_num": ["spg"]}, ("spg_num",)).collect()] == [1, 2]
    rec = spark.createDataFrame([("m", [[1.0, 2.0], [3.0, 4.0]], [1.0, 3.0])], "material_id string, frequencies array<array<double>>, weights array<double>")
    assert sorted((r.x, r.w) for r in Q.mode_spectrum(rec, ["material_id"]).collect()) == [(1.0, 1.0), (2.0, 1.0), (3.0, 3.0), (4.0, 3.0)]
    assert {r.problem for r in Q.id_set_problems(spark.createDataFrame([("a",), ("a",), ("c",)], "material_id string"), spark.createDataFrame([("a",), ("b",)], "material_id string")).collect()} == {"duplicate", "missing", "unexpected"}


def test_geometry_counts_changed_rows_without_difference_nowhere(spark):
    df = spark.createDataFrame([("m", None, 0, 0), ("m", 0.5, 1, 0), ("m", 0.5, 2, -3), ("m", 0.0, None, None)], "model_key string, rmsd double, spg_diff int, ops_diff int")
    r = C.geometry_metrics(df).first()
    assert r.rmsd == pytest.approx(0.5) and r.n == 3 and r.ops_mae == 1 and r.matched == r.decreased == pytest.approx(1 / 3) and r.increased == 0


def test_frontiers(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 3.0), (3, 2.0), (4, 5.0)], "date int, value double")
    best = L.running_best(df)
    assert sorted((r.date, r.value) for r in best.collect()) == [(1, 3.0), (4, 5.0)]
    line = L.step_line(best, F.lit(9)).orderBy("date", "part").collect()
    assert [(r.date, r.value) for r in line] == [(1, 3.0), (4, 3.0), (4, 5.0), (9, 5.0)]
    points = spark.createDataFrame([(1.0, 5.0), (1.0, 5.0), (2.0, 5.0), (2.0, 3.0), (3.0, 4.0), (None, 0.0)], "x double, y double")
    assert sorted(tuple(r) for r in L.pareto(points, "x", "y").collect()) == [(1.0, 5.0), (1.0, 5.0), (2.0, 3.0)]


def test_models_table(spark):
    models = spark.createDataFrame([("m1", "Model One", ["A", "B"], "open"), ("m2", "Model-Two", ["A"], "closed")], "model_key string, label string, training_sets array<string>, openness string")
    sets = spark.createDataFrame([("A", 10, None), ("B", 5, 3)], "dataset string, n_structures long, n_materials long")
    assert {r.model_key: (r.n_structures, r.n_materials) for r in L.training_sizes(models, sets).collect()} == {"m1": (15, 13), "m2": (10, 10)}
    with pytest.raises(Exception, match="unknown dataset"):
        L.training_sizes(models, sets.limit(1)).collect()
    assert [r.model_key for r in L.filter_models(models, ["open"], ["B"]).collect()] == ["m1"]
    refs = spark.createDataFrame([("MODEL one",), ("m2",)], "reference string")
    assert sorted(r.model_key for r in L.resolve_models(refs, models).collect()) == ["m1", "m2"]
    runs = spark.createDataFrame([("a", 0.0), ("b", 2.0), ("c", None), ("d", 1.0)], "model_key string, run_time_sec double")
    assert [r.model_key for r in L.sort_models(runs, "run_time_sec", False).collect()] == ["d", "b", "a", "c"]
    assert {r.model_key: r.slowdown for r in L.slowdown(runs).collect()} == {"a": None, "b": 2.0, "c": None, "d": 1.0}


def test_shard_gate(spark):
    heads = [("m", i, 2, "s", "h", ["a", "b"] if i == 0 else ["c"]) for i in range(2)]
    schema = "model_key string, shard int, shards int, settings string, data_hash string, assigned array<string>"
    records = [("m", 0, "a"), ("m", 0, "b"), ("m", 1, "c")]
    r = spark.createDataFrame(records, "model_key string, shard int, material_id string")
    want = spark.createDataFrame([("a",), ("b",), ("c",)], "material_id string")
    good = spark.createDataFrame(heads, schema)
    assert V.shard_problems(good, r, want).count() == 0
    V.require_empty(V.shard_problems(good, r, want), "shards")
    bad = spark.createDataFrame([heads[0]], schema)
    assert {x.problem for x in V.shard_problems(bad, r.where("shard = 0 AND material_id = 'a'"), want).collect()} == {"shard indices", "not recorded", "missing"}
    with pytest.raises(ValueError, match="shards"):
        V.require_empty(V.shard_problems(bad, r, want), "shards")


def test_digests_and_gates(spark):
    df = spark.createDataFrame([(0, "b", 1), (1, "a", 1)], "o int, id string, k int")
    import hashlib

    assert V.ordered_digest(df, ["k"], "id", "o").first().digest == hashlib.sha256(b"b\na").hexdigest()
    assert V.sorted_digest(df, ["k"], "id").first().digest == hashlib.sha256(b"a\nb").hexdigest()
    assert {r.problem for r in V.table_problems(spark.createDataFrame([("a",), ("a",), (None,)], "id string"), ["id"], "id").collect()} == {"null key", "duplicate key"}
    a = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 5.0)], "k int, v double")
    b = spark.createDataFrame([(1, 0.1), (2, 3.0)], "k int, v double")
    assert sorted(r.k for r in V.differing_rows(a, b, "k", "v", 0.15).collect()) == [2, 3]
    run = spark.createDataFrame([(1, "x", None)], "run_id int, f string, g string")
    rec = spark.createDataFrame([(1, "x", None), (1, "y", None)], "run_id int, f string, g string")
    assert [(p.field, p.have) for p in V.provenance_problems(rec, run, ["f", "g"]).collect()] == [("f", "y")]


@pytest.mark.parametrize(("n", "chunks"), [(10, 3), (9, 3), (2, 5), (1, 1)])
def test_chunks_are_numpys(spark, n, chunks):
    df = spark.createDataFrame([(i * 7 + 3,) for i in range(n)], "ordinal long")
    got = [r.chunk for r in P.equal_chunks(df, chunks).orderBy("ordinal").collect()]
    assert got == [i for i, c in enumerate(np.array_split(np.arange(n), chunks)) for _ in c]


def test_balance(spark):
    sizes = spark.createDataFrame([(9, 1), (5, 2), (1, 4)], "size int, n int")
    loads = {}
    for size, first, last, turns in P.largest_first(sizes, 3):
        for k in range(first, last):
            shard = turns[(k - first) % len(turns)]
            loads[shard] = loads.get(shard, 0) + size
    assert sorted(loads.values()) == [7, 7, 9]
    df = spark.range(2000)
    split = P.train_test(df, "id", 95, 3)
    assert 0.92 < split.where("is_train").count() / 2000 < 0.98
    assert split.exceptAll(P.train_test(df.repartition(7), "id", 95, 3)).count() == 0


def test_element_tables(spark):
    comp = spark.createDataFrame([("a", "Fe", 2.0), ("a", "O", 3.0), ("b", "Fe", 1.0), ("c", "O", 1.0)], "material_id string, element string, amount double")
    entries = spark.createDataFrame([("a", -10.0), ("b", -1.0), ("c", -2.0)], "material_id string, energy double")
    refs = C.elemental_references(entries, comp)
    assert {r.element: r.e_ref for r in refs.collect()} == {"Fe": -1.0, "O": -2.0}
    assert {r.material_id: r.e_form for r in C.referenced_energy(entries, comp, refs).collect()} == {"a": pytest.approx(-0.4), "b": 0, "c": 0}
    with pytest.raises(Exception, match="no reference energy"):
        C.referenced_energy(entries, comp, refs.where("element = 'O'")).collect()
    assert [r.element for r in C.missing_references(comp, refs.where("element = 'O'")).collect()] == ["Fe"]
    assert [r.material_id for r in C.elements_within(comp, ["Fe"]).collect()] == ["b"]
    errs = spark.createDataFrame([("m", "a", 1.0), ("m", "b", None)], "model_key string, material_id string, err double")
    got = {r.element: (r.weighted_error, r.presence_error, r.n) for r in C.element_errors(errs, comp).collect()}
    assert got["Fe"] == (2.0, 0.5, 2)


def test_settings_by_longest_prefix(spark):
    names = spark.createDataFrame([("Al2O3_300_x",), ("Al_9",), ("Zn",)], "name string")
    settings = spark.createDataFrame([("Al",), ("Al2O3_300",)], "setting string")
    assert {r.name: r.setting for r in B.settings_of(names, settings).collect()} == {"Al2O3_300_x": "Al2O3_300", "Al_9": "Al", "Zn": None}


def test_wyckoffs(spark):
    rows = spark.createDataFrame([("m", 1, "b2a_c"), ("n", 9, "ba")], "material_id string, spg_num int, wyckoffs string")
    names = spark.createDataFrame([(1, "abc", "abc"), (1, "abc", "cab")], "spg_num int, source string, target string")
    assert {r.material_id: r.wyckoffs for r in C.canonical_wyckoffs(rows, names).collect()} == {"m": "2ab_c", "n": "ab"}


def test_segments_and_means(spark):
    rows = [("r", 0, None, 5.0, 1.0, {"a": "1"}, 1, "h2"), ("r", 1, "gpu", 7.0, None, {"a": "1"}, 3, "h1"), ("q", 0, "cpu", 1.0, 2.0, {"a": "1"}, 1, "h"), ("q", 1, "cpu", 1.0, 4.0, {"a": "2"}, 2, "h")]
    df = spark.createDataFrame(rows, "run_id string, ordinal int, hardware string, run_time_sec double, max_rss_gb double, versions map<string,string>, completed_at int, hostname string")
    got = {r.run_id: r for r in L.merge_segments(df).collect()}
    assert (got["r"].hardware, got["r"].run_time_sec, got["r"].max_rss_gb, got["r"].completed_at, got["r"].hosts) == ("gpu", 12.0, None, 3, ["h1", "h2"])
    assert got["q"].versions is None and got["q"].max_rss_gb == 4 and got["r"].versions == '{"a":"1"}'
    with pytest.raises(Exception, match="versions differ"):
        L.merge_segments(df, strict=True).collect()
    m = spark.createDataFrame([("a", 1.23456, None), ("a", float("nan"), None)], "model_key string, x double, y double")
    assert [tuple(r) for r in L.metric_means(m, ["x", "y"]).collect()] == [("a", "x", 1.235)]
    points, counts = L.scatter(m, ["x"])
    assert points.count() == 1 and counts.first().x == 1


def test_smallest(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 0)], "k string, n int")
    assert [r.k for r in V.smallest(df, 2, "n", "k").collect()] == ["c", "a"]
    with pytest.raises(ValueError, match="only 3"):
        V.smallest(df, 4, "n", "k")


def test_digests_hold_no_group_in_memory(spark):
    import hashlib

    df = spark.range(30_000).select((F.col("id") % 2).alias("k"), (-F.col("id")).alias("o"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("id"))
    df = df.unionByName(spark.createDataFrame([(None, 1, 5), (9, 1, None)], "k long, o long, id long"))
    for made, order in ((V.ordered_digest(df, ["k"], "id", "o"), lambda x: -x), (V.sorted_digest(df, ["k"], "id"), str)):
        assert "collect_list" not in made._jdf.queryExecution().toString()
        want = {k: sorted((i for i in range(30_000) if i % 2 == k and i % 7), key=order) for k in (0, 1)} | {None: [5], 9: []}
        assert {r.k: r.digest for r in made.collect()} == {k: hashlib.sha256("\n".join(map(str, v)).encode()).hexdigest() for k, v in want.items()}


def test_prototype_formula_costs_as_much_as_its_amounts(spark):
    numbers = [[1, 1], [4, 6, 10], [89, 144], [233, 377, 610], [7], [2**40, 3 * 2**38], [1.5, 3.0], [0, 4, 6], [1, 7, 9]]
    rows = spark.createDataFrame([(i, {f"E{k}": float(x) for k, x in enumerate(xs)}) for i, xs in enumerate(numbers)], "i int, c map<string, double>")
    text = lambda x: "" if x == 1 else str(int(x)) if x == int(x) else str(x)
    for row in rows.select("i", S.prototype_formula("c").alias("p")).collect():
        xs = numbers[row.i]
        divisor = math.gcd(*(int(x) for x in xs)) if all(x == int(x) for x in xs) else 1
        assert row.p == "".join(chr(65 + k) + text(x / divisor) for k, x in enumerate(xs))
    plan = rows.select(S.prototype_formula("c").alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_sort") == 1  # each part is computed once, not once per element


def test_collapsed_points_of_many_curves_in_batches(spark):
    def plain(y, drop=20.0):
        left, turn = list(range(len(y))), {}
        while len(left) > 1:
            low = [i for n, i in enumerate(left) if y[i] < min(y[left[n - 1]] if n else math.inf, y[left[n + 1]] if n + 1 < len(left) else math.inf) - drop]
            if not low:
                break
            turn[low[0]] = len(turn) + 1
            left.remove(low[0])
        return [turn.get(i, 0) for i in range(len(y))]

    rng = np.random.default_rng(3)
    curves = {i: [float(v) for v in rng.integers(-60, 60, n)] for i, n in enumerate([*rng.integers(1, 40, 300), 900])}
    rows = spark.createDataFrame([(i if i else None, float(x), y) for i, ys in curves.items() for x, y in enumerate(ys)], "c int, x double, y double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")  # curves go on over batches
    try:
        out = K.drop_collapsed(rows, ["c"])
        got = {(r.c or 0, int(r.x)): r.round for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(i, x): t for i, ys in curves.items() for x, t in enumerate(plain(ys))}
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().analyzed().toString()  # no call of Python for each curve


def test_mode_conductivity_deals_pairs_out_once(spark):
    capacity = spark.createDataFrame([(m, q, b, c) for m in (1, 2) for q in (0, 1) for b, c in ((0, 1.0), (1, 3.0), (2, None), (None, 9.0))], "m int, q int, b int, c double")
    listed = [(m, q, b, b2, float(m + q + b)) for m in (1, 2, 3) for q in (0, 1) for b in (0, 1, 2, 5) for b2 in (0, 1, 2, 7)]
    pairs = spark.createDataFrame([*listed, (1, 0, None, 0, 5.0), (2, 1, 0, None, 5.0), (2, 1, 1, 0, None)], "m int, q int, b int, b2 int, k double")
    out = Q.total_mode_conductivity(pairs, capacity, ["m"])
    value = {0: 1.0, 1: 3.0, 2: None}
    want = {}
    for m, q, b, b2, k in listed:
        if m < 3 and b in value and b2 in value:  # bands without a capacity give nothing
            both = value[b] is not None and value[b2] is not None
            want[m, q, b] = want.get((m, q, b), 0.0) + (2 * k * value[b] / (value[b] + value[b2]) if both else 0.0)
    assert {(r.m, r.q, r.b): r.k for r in out.collect()} == pytest.approx(want)
    # pairs and the map of capacities are dealt out by record and q, and the sums need no shuffle of their own
    assert out._jdf.queryExecution().sparkPlan().toString().count("Join") == 1
