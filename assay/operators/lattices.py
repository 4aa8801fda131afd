"""Reduction of lattices and nearest periodic images, as Spark columns.

A cell is an array of three vectors (arrays of x, y and z) with three flags for the periodic ones. All
of this is evaluated once per cell, not per pair of atoms.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = 48


def _dot(u: str, v: str) -> str:
    return "(" + " + ".join(f"{u}[{i}] * {v}[{i}]" for i in range(3)) + ")"


def _minus(u: str, *multiples: tuple[str, str]) -> str:
    """u less multiples (factor, vector)."""
    return "array(" + ", ".join(f"{u}[{i}]" + "".join(f" - ({k}) * {v}[{i}]" for k, v in multiples) for i in range(3)) + ")"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` evaluated once under a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


_BY_LENGTH = f"(u, v) -> CASE WHEN {_dot('u', 'u')} < {_dot('v', 'v')} THEN -1 WHEN {_dot('u', 'u')} > {_dot('v', 'v')} THEN 1 ELSE 0 END"


def _nearest_integer(up: str, down: str) -> str:
    return f"coalesce(rint(try_divide({up}, {down})), 0D)"


def _step() -> str:
    """One round for sorted vectors p: the second less its part along the first, the third less the lattice point of
    the first two that lies nearest below it. Rounds end with short vectors, of which none can be made shorter."""
    second = _minus("p[1]", (_nearest_integer(_dot("p[1]", "p[0]"), _dot("p[0]", "p[0]")), "p[0]"))
    det = f"({_dot('a', 'a')} * {_dot('b', 'b')} - {_dot('a', 'b')} * {_dot('a', 'b')})"
    x = _nearest_integer(f"{_dot('c', 'a')} * {_dot('b', 'b')} - {_dot('c', 'b')} * {_dot('a', 'b')}", det)
    y = _nearest_integer(f"{_dot('c', 'b')} * {_dot('a', 'a')} - {_dot('c', 'a')} * {_dot('a', 'b')}", det)
    moved = _minus("c", ("m + i", "a"), ("n + j", "b"))
    near = f"flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> {moved})))"
    least = f"array_min(transform({near}, v -> struct({_dot('v', 'v')} AS r2, v AS v))).v"
    third = _let("m", x, _let("n", y, least))
    three = _let("a", "p[0]", _let("b", second, _let("c", "p[2]", f"array(a, b, {third})")))
    return f"CASE size(p) WHEN 3 THEN {three} WHEN 2 THEN array(p[0], {second}) ELSE p END"


def reduced(cell: str = "cell", pbc: str = "pbc") -> Column:
    """The cell with its periodic vectors Minkowski-reduced and first, shortest first: struct(vectors, periodic).

    ``periodic`` is their number; the others follow as they are. A cell that rounds of reduction do not bring to an
    end raises.
    """
    inside = f"filter({cell}, (v, i) -> {pbc}[i])"
    length = lambda x: f"aggregate({x}, 0D, (s, v) -> s + {_dot('v', 'v')})"
    after = _let("q", f"array_sort({_let('p', 's.p', _step())}, {_BY_LENGTH})", f"struct(q AS p, coalesce({length('q')} >= {length('s.p')} * (1 - 1e-12D), false) AS done)")
    rounds = f"aggregate(sequence(1, {_STEPS}), struct(array_sort({inside}, {_BY_LENGTH}) AS p, false AS done), (s, k) -> CASE WHEN s.done THEN s ELSE {after} END)"
    checked = "CASE WHEN r.done THEN r.p ELSE cast(raise_error('the cell cannot be reduced') AS array<array<double>>) END"
    whole = f"concat(p, filter({cell}, (v, i) -> NOT {pbc}[i]))"
    return F.expr(_let("p", _let("r", rounds, checked), f"struct({whole} AS vectors, size(p) AS periodic)"))


def shortest(lattice: str = "lattice") -> Column:
    """Length of the shortest periodic vector of a reduced lattice, or of any where none is periodic."""
    every = f"array_min(transform({lattice}.vectors, v -> sqrt({_dot('v', 'v')})))"
    return F.expr(f"CASE WHEN {lattice}.periodic > 0 THEN sqrt({_dot(f'{lattice}.vectors[0]', f'{lattice}.vectors[0]')}) ELSE {every} END")


def _cross(u: str, v: str) -> str:
    return "array(" + ", ".join(f"{u}[{(i + 1) % 3}] * {v}[{(i + 2) % 3}] - {u}[{(i + 2) % 3}] * {v}[{(i + 1) % 3}]" for i in range(3)) + ")"


def reciprocal(lattice: str = "lattice") -> Column:
    """Three vectors whose products with a position are its fractional coordinates."""
    v = [f"{lattice}.vectors[{i}]" for i in range(3)]
    rows = [f"transform({_cross(v[(i + 1) % 3], v[(i + 2) % 3])}, x -> x / det)" for i in range(3)]
    return F.expr(_let("det", _dot(v[0], _cross(v[1], v[2])), f"array({', '.join(rows)})"))


def image_shifts(lattice: str = "lattice") -> Column:
    """Combinations of -1 to 1 of the periodic vectors of a reduced lattice, as arrays of x, y and z."""
    v = f"{lattice}.vectors"
    ends = [f"sequence(-(CASE WHEN {lattice}.periodic > {i} THEN 1 ELSE 0 END), CASE WHEN {lattice}.periodic > {i} THEN 1 ELSE 0 END)" for i in range(3)]
    at = ", ".join(f"a * {v}[0][{i}] + b * {v}[1][{i}] + c * {v}[2][{i}]" for i in range(3))
    return F.expr(f"flatten(flatten(transform({ends[0]}, a -> transform({ends[1]}, b -> transform({ends[2]}, c -> array({at}))))))")


#: Of each pair of opposite neighbours in the lattice, one.
_HALF = [k for k in product((-1, 0, 1), repeat=3) if k > (0, 0, 0)]


def image_limits(lattice: str = "lattice") -> Column:
    """Square lengths of half of the neighbours in the lattice, infinite where they take a vector that is not periodic."""
    v = f"{lattice}.vectors"
    at = lambda k: "array(" + ", ".join(" + ".join(f"{n} * {v}[{j}][{i}]" for j, n in enumerate(k)) for i in range(3)) + ")"
    last = lambda k: max(i for i, n in enumerate(k) if n)
    return F.expr("array(" + ", ".join(f"CASE WHEN {lattice}.periodic > {last(k)} THEN {_let('s', at(k), _dot('s', 's'))} ELSE double('Infinity') END" for k in _HALF) + ")")


def with_nearest_image(rows: DataFrame, d: tuple[str, str, str], name: str, lattice: str = "lattice", inverse: str = "inverse", shifts: str = "shifts", limits: str = "limits") -> DataFrame:
    """Add the shortest image of a vector, exactly, whatever cells its ends lie in: struct of r2, x, y and z.

    In a reduced lattice the shortest image of a wrapped vector w is among its 27 neighbours w + s. Mostly it is w itself,
    and certainly where 2 |w s| is less than s s for all s; this is compiled, and only other rows go through the neighbours, in lambdas.
    """
    v = f"{lattice}.vectors"
    whole = {f"__n{i}": F.expr(f"CASE WHEN {lattice}.periodic > {i} THEN rint({' + '.join(f'{inverse}[{i}][{j}] * {c}' for j, c in enumerate(d))}) ELSE 0D END") for i in range(3)}
    wrapped = {f"__w{i}": F.expr(c + "".join(f" - __n{j} * {v}[{j}][{i}]" for j in range(3))) for i, c in enumerate(d)}
    along = {f"__p{j}": F.expr("2 * (" + " + ".join(f"__w{i} * {v}[{j}][{i}]" for i in range(3)) + ")") for j in range(3)}
    rows = rows.withColumns(whole).withColumns(wrapped).withColumns(along)
    short = lambda k: "abs(" + " ".join(f"{'+-'[n < 0]} __p{j}" for j, n in enumerate(k) if n) + ")"
    # least() is compiled in parts; one long condition would make a method that the JVM only interprets
    sure = "least(" + ", ".join(f"{limits}[{m}] * (1 - 1e-9D) - {short(k)}" for m, k in enumerate(_HALF)) + ") > 0"
    itself = "struct(__w0 * __w0 + __w1 * __w1 + __w2 * __w2 AS r2, __w0 AS x, __w1 AS y, __w2 AS z)"
    moved = "array(__w0 + s[0], __w1 + s[1], __w2 + s[2])"
    around = f"array_min(transform({shifts}, s -> {_let('t', moved, 'struct(' + _dot('t', 't') + ' AS r2, t[0] AS x, t[1] AS y, t[2] AS z)')}))"
    return rows.withColumn(name, F.expr(f"CASE WHEN {sure} THEN {itself} ELSE {around} END")).drop(*whole, *wrapped, *along)
