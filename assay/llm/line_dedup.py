"""Removal of repeated runs of lines, by winnowing over line hashes.

A run counts if it has three lines, or fewer with more than 50 words together. Each such run is a
window over the line hashes of its text, and the least hash in it is its fingerprint; neighbouring
windows mostly choose the same line, so about half of the lines become rows. Which line a window
chooses depends on its lines alone, so equal runs choose equal places and none is missed.

Positions of equal fingerprints are joined: those found once leave, nearly all by a filter of fixed
size, the few others when their extensions are. From the others
the match is extended to both sides as far as the windows reach that chose the line, and each
extension goes to its first occurrence. Extensions of neighbouring fingerprints overlap and add
up to the longest repeated run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize, thinned
from .text import n_words, whole

_KEY = ["__row_id", "__row_hash"]


def _at(array: str, k: int) -> str:
    """SQL for the element k places from pos; null beyond the ends."""
    return f"CASE WHEN pos + {k} BETWEEN 0 AND size({array}) - 1 THEN get({array}, pos + {k}) END"


def _chosen(lines: int, before: int, run: int, min_words: int) -> str:
    """Whether the line at pos is the fingerprint of the window of ``lines`` lines with ``before`` of them ahead of it."""
    inside = f"pos - {before} >= 0 AND pos + {lines - 1 - before} < size(h)"
    least = [f"{_at('h', k)} {'>' if k < 0 else '>='} {_at('h', 0)}" for k in range(-before, lines - before) if k]
    words = f"{' + '.join(_at('w', k) for k in range(-before, lines - before))} > {min_words}" if lines < run else "true"
    return " AND ".join([inside, words, *least])


def fingerprints(texts: DataFrame, run: int = 3, min_words: int = 50) -> DataFrame:
    """Winnowed positions of texts: their keys, pos, fingerprint, and ``reach``, the windows that chose it.

    A window of ``reach`` is (before, lines, r1, r2): its lines ahead of the position, its length
    and two hashes of its lines; null stands for a window that did not choose it. Positions that no
    window chooses give no row. All of this is generated code, which keeps a text's array of line
    hashes out of its output rows.
    """
    parts = F.split("text", "\n")
    rows = texts.select(*_KEY, F.transform(parts, lambda x: F.xxhash64(x)).alias("h"), F.transform(parts, n_words).alias("w"))
    rows = rows.select("*", F.posexplode_outer("h").alias("pos", "fingerprint"))
    windows = []
    for lines in range(1, run + 1):
        for before in range(lines):
            hashed = ", ".join(_at("h", k) for k in range(-before, lines - before))
            window = f"named_struct('before', {before}, 'lines', {lines}, 'r1', xxhash64(1, {lines}, {hashed}), 'r2', xxhash64(2, {lines}, {hashed}))"
            windows.append(f"CASE WHEN {_chosen(lines, before, run, min_words)} THEN {window} END")
    rows = rows.select(*_KEY, "pos", "fingerprint", F.expr(f"array({', '.join(windows)})").alias("reach"))
    return rows.where(" OR ".join(f"reach[{i}] IS NOT NULL" for i in range(len(windows))))


def _place(kind: str) -> Column:
    """Order of positions, by doc_id and then place; a number where ids are, so that hash aggregates serve."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(F.col("__row_id").cast("decimal(38,0)"), F.lit(-(2**63)).cast("decimal(38,0)")) * F.lit(2**31).cast("decimal(10,0)") + F.col("pos")
    return F.struct("__row_id", "pos")


def repeated_runs(texts: DataFrame, run: int = 3, min_words: int = 50) -> DataFrame:
    """Runs that occurred earlier: the keys, pos and lines of each. Keys are ``__row_id`` and ``__row_hash``.

    All but the first occurrence of a run, in order of id and then place, are returned. A run at
    one place under one id is one occurrence.
    """
    rows = materialize(fingerprints(texts, run, min_words), "line-fingerprints")
    position = F.xxhash64(*_KEY, "pos")
    many = rows.groupBy("fingerprint").agg(F.min(position).alias("x"), F.max(position).alias("y")).where("x <> y").select("fingerprint")
    rows = thinned(rows, materialize(many, "line-shared"), "fingerprint")
    rows = rows.select(*_KEY, "pos", F.inline("reach")).where("lines IS NOT NULL").select(*_KEY, (F.col("pos") - F.col("before")).alias("pos"), "lines", "r1", "r2")
    rows = materialize(rows.withColumn("place", _place(dict(texts.dtypes)["__row_id"])), "line-extensions")
    first = rows.groupBy("r1", "r2").agg(F.min("place").alias("first"), F.count("*").alias("times")).where("times > 1")
    later = rows.join(materialize(first.drop("times"), "line-first"), ["r1", "r2"])
    return later.where("place > first").select(*_KEY, "pos", "lines")


def dedup_lines(docs: DataFrame, run: int = 3, min_words: int = 50) -> DataFrame:
    """Delete lines of runs that occur earlier in the corpus; all columns stay, text is what is left.

    Lines are the pieces between line feeds, compared byte for byte; a run is ``run`` lines, or fewer
    that have more than ``min_words`` words together. Of equal runs the first in order of doc_id (of
    any type that can be ordered) and place stays. Adds n_lines and n_removed, replacing columns of
    these names; names that begin with two underscores are reserved, other columns are left alone.
    Null text has no lines and stays null; rows that are alike in doc_id and text are treated alike;
    null ids come first. An empty table gives no rows.
    """
    docs = docs.drop("n_lines", "n_removed")
    keyed = docs.withColumns({"__row_id": F.col("doc_id"), "__row_hash": F.xxhash64(whole())})
    later = repeated_runs(keyed.select(*_KEY, "text").where("text IS NOT NULL"), run, min_words)
    gone = later.groupBy(*_KEY).agg(F.collect_set(F.struct("pos", "lines")).alias("runs"))
    gone = gone.select(F.col("__row_id").alias("__id"), F.col("__row_hash").alias("__hash"), F.expr("array_distinct(flatten(transform(runs, x -> sequence(x.pos, x.pos + x.lines - 1))))").alias("__gone"))
    out = keyed.join(gone, keyed["__row_id"].eqNullSafe(gone["__id"]) & (keyed["__row_hash"] == gone["__hash"]), "left").withColumn("__lines", F.split("text", "\n"))
    kept = F.expr("transform(array_except(sequence(0, size(__lines) - 1), __gone), i -> get(__lines, i))")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("__lines")).cast("long")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    removed = F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long")
    return out.select(*(c if c != "text" else text.alias("text") for c in docs.columns), n_lines.alias("n_lines"), removed.alias("n_removed"))
