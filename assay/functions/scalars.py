"""Column functions: cleaning, rounding, classification, formulas, tensors and scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STABLE = 0.0
MAX_ERROR = 5.0


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; null where undefined."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def round_even(x: Column | str, digits: int) -> Column:
    """Half-even rounding of the scaled binary value."""
    scale = float(10**digits)
    return F.rint(_c(x) * scale) / scale


def significant(x: Column | str, digits: int) -> Column:
    """Rounded to a number of significant digits; 0 stays 0."""
    x = _c(x)
    scale = F.pow(F.lit(10.0), F.lit(float(digits - 1)) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, x).otherwise(F.rint(x * scale) / scale)


def finite(x: Column | str) -> Column:
    """The number; null where it is NaN or infinite or no number."""
    x = F.expr(f"try_cast({x} AS double)") if isinstance(x, str) else x.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def first_finite(values: Column | str) -> Column:
    """The first finite number of an array."""
    return F.get(F.filter(_c(values), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(0))


def round_list(values: Column | str, digits: int = 5) -> Column:
    return F.transform(_c(values), lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), round_even(x, digits)))


def without_outliers(pred: Column | str, true: Column | str, limit: float = MAX_ERROR) -> Column:
    """The prediction; null where it is off by more than ``limit``."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    return F.when(F.abs(_c(pred) - _c(true)) > limit, None).otherwise(_c(pred))


def stability_class(true: Column | str, pred: Column | str, threshold: float = STABLE, fill_missing: bool = True) -> Column:
    """TP, FN, FP or TN; null truth has no class, a missing prediction is unstable if filled."""
    stable, called = _c(true) <= threshold, _c(pred) <= threshold
    called = F.coalesce(called, F.lit(False)) if fill_missing else called
    return F.when(stable & called, "TP").when(stable & ~called, "FN").when(~stable & called, "FP").when(~stable & ~called, "TN")


def next_step_id(material_id: Column | str) -> Column:
    """``step_i_j`` becomes ``wbm-i-(j+1)``; any other id stays."""
    x = _c(material_id)
    found = x.rlike(r"^step_\d+_\d+$")
    part = lambda k: F.regexp_extract(x, r"^step_(\d+)_(\d+)$", k)
    return F.when(found, F.concat(F.lit("wbm-"), part(1), F.lit("-"), (part(2).try_cast("long") + 1).cast("string"))).otherwise(x)


def close_id_gaps(number: Column, removed: Column) -> Column:
    """A running number less the removed numbers below it; ``removed`` is an array."""
    return number - F.size(F.filter(removed, lambda r: r < number))


def id_step(material_id: Column | str) -> Column:
    """The step of an id: its second part, 1 to 5; anything else raises."""
    step = F.split_part(_c(material_id), F.lit("-"), F.lit(2)).try_cast("int")
    return F.when(step.between(1, 5), step).otherwise(F.raise_error(F.concat(F.lit("no step in id "), _c(material_id))).cast("int"))


def space_group_of_label(label: Column | str) -> Column:
    return F.split_part(_c(label), F.lit("_"), F.lit(3)).try_cast("int")


def crystal_system(number: Column | str) -> Column:
    """By space-group number: fixed ranges of the seven systems."""
    n, out = _c(number), None
    for last, name in ((2, "triclinic"), (15, "monoclinic"), (74, "orthorhombic"), (142, "tetragonal"), (167, "trigonal"), (194, "hexagonal"), (230, "cubic")):
        out = F.when(n <= last, name) if out is None else out.when(n <= last, name)
    return F.when(n >= 1, out)


def parse_formula(formula: Column | str) -> Column:
    """Composition of a flat formula: map of element to amount, repeats summed, elements sorted."""
    f = _c(formula)
    flat = F.when(f.rlike(r"^([A-Z][a-z]?[0-9.]*\s*)+$"), f).otherwise(F.raise_error(F.concat(F.lit("not a flat formula: "), f)).cast("string"))
    pattern = F.lit(r"([A-Z][a-z]?)([0-9.]*)")
    pairs = F.arrays_zip(F.regexp_extract_all(flat, pattern, F.lit(1)).alias("e"), F.regexp_extract_all(flat, pattern, F.lit(2)).alias("n"))
    elements = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["e"])))
    amount = lambda p: F.when(p["n"] == "", 1.0).otherwise(p["n"].try_cast("double"))
    total = lambda e: F.aggregate(F.filter(pairs, lambda p: p["e"] == e), F.lit(0.0), lambda a, p: a + amount(p))
    return F.map_from_arrays(elements, F.transform(elements, total))


def _number(x: Column) -> Column:
    whole = x == F.floor(x)
    return F.when(x == 1, "").when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))


def alphabetical_formula(composition: Column | str) -> Column:
    entries = F.array_sort(F.map_entries(_c(composition)))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], _number(e["value"]))), " ")


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm in as many steps as the smaller number can need: its logarithm to the golden ratio."""
    start = F.struct(F.greatest(a, b).alias("x"), F.least(a, b).alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, s["y"]).otherwise(F.try_mod(s["x"], s["y"])).alias("y"))
    most = F.ceil(F.log2(F.least(F.abs(a), F.abs(b)) + 1.0) * 1.45).cast("int") + 2
    return F.aggregate(F.sequence(F.lit(1), F.coalesce(most, F.lit(1))), start, step)["x"]


def prototype_formula(composition: Column | str) -> Column:
    """Elements in order become A, B, ...; whole amounts are divided by their common divisor."""
    common = lambda a, x: F.when((a == 0) | (a == x), x).when((a == 1) & (x > 0), a).otherwise(_gcd(a, x))
    letter = lambda i: F.char(F.lit(65) + i)

    def formula(amounts: Column) -> Column:
        whole = F.forall(amounts, lambda x: x == F.floor(x))
        divisor = F.when(whole, F.aggregate(amounts, F.lit(0).cast("long"), lambda a, x: common(a, x.cast("long")))).otherwise(1)
        return _once(divisor, lambda d: F.array_join(F.transform(amounts, lambda x, i: F.concat(letter(i), _once(x / d, _number))), ""))

    entries = F.array_sort(F.map_entries(_c(composition)))
    return _once(F.transform(entries, lambda e: e["value"]), formula)


def voigt_to_tensor(v: Column | str) -> Column:
    """Six components to a 3x3 tensor; other sizes give null."""
    v = _c(v)
    rows = [[0, 5, 4], [5, 1, 3], [4, 3, 2]]
    return F.when(F.size(v) == 6, F.array(*(F.array(*(F.get(v, F.lit(j)) for j in r)) for r in rows)))


def directional_average(v: Column | str) -> Column:
    """Mean of the first three of 6 or 3 components; other sizes are missing."""
    v = _c(v)
    return F.when(F.size(v).isin(3, 6), (F.get(v, F.lit(0)) + F.get(v, F.lit(1)) + F.get(v, F.lit(2))) / 3)


def tensor_average(t: Column | str) -> Column:
    """A third of the trace of a 3x3 tensor; other shapes are missing."""
    t = _c(t)
    at = lambda i: F.get(F.get(t, F.lit(i)), F.lit(i))
    return F.when((F.size(t) == 3) & F.forall(t, lambda r: F.size(r) == 3), (at(0) + at(1) + at(2)) / 3)


#: Electronvolt per cubic Angstrom in a gigapascal.
GPA = 0.006241509125883258


def pressure(stress: Column | str) -> Column:
    """Minus a third of the normal stresses of a Voigt tensor, in GPa; null stress raises."""
    s = _c(stress)
    return F.when(s.isNull(), F.raise_error(F.lit("stress is missing")).cast("double")).otherwise(-directional_average(s) / GPA)


def imaginary_modes(frequencies: Column | str, threshold: float = -0.01) -> Column:
    """All missing; or optical below 0 or acoustic below ``threshold`` at the first q; or any below 0 at others."""
    f = _c(frequencies)
    known = lambda x: x.isNotNull() & ~F.isnan(x)
    first = F.get(f, F.lit(0))
    none = ~F.exists(F.flatten(f), known)
    optical = F.exists(F.slice(first, 4, F.greatest(F.size(first), F.lit(1))), lambda x: known(x) & (x < 0))
    acoustic = F.exists(F.slice(first, 1, 3), lambda x: known(x) & (x < threshold))
    others = F.exists(F.flatten(F.slice(f, 2, F.greatest(F.size(f), F.lit(1)))), lambda x: known(x) & (x < 0))
    return F.coalesce(none | optical | acoustic | others, F.lit(True))


def conductivity_allowed(imaginary: Column | str, symmetry_kept: Column | str, allow_broken: bool = False) -> Column:
    return ~_c(imaginary) & (F.lit(allow_broken) | F.coalesce(_c(symmetry_kept), F.lit(False)))


def relative_difference(pred: Column | str, true: Column | str) -> Column:
    """2 (p - t) / (p + t); 0 where both are 0; an invalid prediction counts as -2, an invalid truth raises."""
    p, t = finite(_c(pred)), finite(_c(true))
    value = F.when((p == 0) & (t == 0), 0.0).when(p.isNull() | (p < 0), -2.0).otherwise(2 * F.try_divide(p - t, p + t))
    return F.when(t.isNull() | (t < 0), F.raise_error(F.lit("invalid reference value")).cast("double")).otherwise(value)


#: Wavenumber of sqrt(eV / A^2 / u) in 1/cm.
WAVENUMBER = 521.4708983725064


def wavenumber(curvature: Column | str, reduced_mass: Column | str) -> Column:
    k, m = _c(curvature), _c(reduced_mass)
    return F.when((k > 0) & (m > 0), F.sqrt(k / m) * WAVENUMBER)


def subscore(value: Column | str, baseline: float, floor: float = 0.0, log: bool = False) -> Column:
    """1 at ``floor`` and better, 0 at ``baseline`` and worse, linear or logarithmic between."""
    v, lo, hi = _c(value), F.lit(float(floor)), F.lit(float(baseline))
    if log:
        v, lo, hi = F.when(v > 0, F.log10(v)), F.log10(lo), F.log10(hi)
    return F.when(v.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - (v - lo) / (hi - lo))))


def weighted_score(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean; null if a part with weight is missing or no part has weight."""
    used = [(c, w) for c, w in parts if w]
    if not used:
        return F.lit(None).cast("double")
    total = None
    for c, w in used:
        total = c * w if total is None else total + c * w
    return total / sum(w for _, w in used)


def normal_key(name: Column | str) -> Column:
    """Lower case, runs of anything but letters and digits as one underscore."""
    return F.regexp_replace(F.lower(_c(name)), "[^a-z0-9]+", "_")


def task_coverage(status: Column, complete: Column, available: Column, applicable: Column) -> Column:
    """An explicit status wins; then complete, not_available, not_applicable, pending."""
    return F.coalesce(status, F.when(complete, "complete").when(~available, "not_available").when(~applicable, "not_applicable").otherwise("pending"))


def checked(condition: Column, value: Column, message: str, kind: str = "double") -> Column:
    """The value; rows that break the condition raise."""
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast(kind))

