"""Mixing of sources to target weights, by Sainte-Laguë apportionment of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize
from .text import n_words


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """Target tokens of each source: (source, source_size, target).

    Sources by code point, null last, get the weights in turn and share all tokens. No target is
    above ``repeats`` times the source's size; the excess is reshared by weight until none is.
    In order of size per weight the sources at their limit are a prefix, so one pass over running
    sums finds them. The table has one row per source.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*map(F.lit, weights)), turn % len(weights)).cast("long")
    rows = sizes.select("source", "source_size", turn.alias("turn"), weight.alias("weight"), (F.col("source_size") * repeats).alias("limit"))
    per_weight = Window.orderBy(F.col("limit").cast("double") / F.col("weight"), "turn")
    before, every = per_weight.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.withColumns({
        "tokens": F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0)),
        "weights": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    rows = rows.withColumn("full", F.expr("cast(tokens AS double) / weights * weight > limit"))
    share = F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(every), F.lit(0))
    rows = rows.withColumn("share", share.cast("double") / F.sum(F.when(~F.col("full"), F.col("weight"))).over(every))
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.col("share") * F.col("weight"))
    return rows.select("source", "source_size", "turn", target.alias("target"))


def apportion(rows: DataFrame, weight: str, seats: str, by: list[str], order: str) -> DataFrame:
    """Sainte-Laguë: add ``quota``, the seats of each row of a group ``by``.

    Seats go to the highest quotients weight / (2k + 1). With n rows and s seats the divisor lies
    between W / (s + n/2) and W / (s - n/2), so all but about 2n quotients are settled by rounding;
    only the rest are ranked. ``seats`` is the same in all rows of a group; ties go by ``order``.
    """
    every = Window.partitionBy(*by)
    rows = rows.withColumns({"__w": F.sum(weight).over(every), "__n": F.count("*").over(every)})
    low = f"CASE WHEN {seats} * 2 > __n THEN greatest(0, bigint(floor({weight} / (__w / ({seats} - __n / 2.0)) + 0.5)) - 1) ELSE 0 END"
    high = f"bigint(floor({weight} / (__w / ({seats} + __n / 2.0)) + 0.5)) + 1"
    rows = rows.withColumn("__low", F.expr(f"CASE WHEN {weight} > 0 THEN {low} ELSE 0 END"))
    rows = rows.withColumn("__left", F.col(seats) - F.sum("__low").over(every))
    open_seats = f"CASE WHEN {weight} > 0 AND {seats} > 0 THEN sequence(__low, {high}) ELSE array(-1L) END"
    quotients = rows.withColumn("__k", F.explode(F.expr(open_seats)))
    quotient = F.when(F.col("__k") >= 0, F.col(weight) / (2 * F.col("__k") + 1)).otherwise(-1.0)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(quotient.desc(), order))
    won = (F.col("__k") >= 0) & (rank <= F.col("__left"))
    keep = [c for c in rows.columns if c not in ("__w", "__n", "__left", "__low")]
    counted = quotients.withColumn("__won", won.cast("long")).groupBy(*keep, "__low").agg(F.sum("__won").alias("__won"))
    return counted.select(*keep, (F.col("__low") + F.col("__won")).alias("quota"))


def mix_sources(docs: DataFrame, seed: int = 17, shards: int = 64, shard_rows: int = 1 << 15, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """How many words of each document a mix takes: source_size, target, size and taken are added.

    Size is the number of words, null text has none; a null source is a source of its own. Single
    words are apportioned to sources by target, and each source's to its hash shards by the words it
    has there (``shards`` of them, doubled until the largest source has at most ``shard_rows`` rows a
    shard, so that no task holds more), so a source of any size gets its target to within a word or two in a
    corpus of any size. Within source and shard documents stand in a seeded order; the quota takes
    whole passes over all words and, for the rest, words from a seeded one onwards. ``taken``
    counts words with repeats, at most ``repeats`` times the size. The order is a hash of seed and doc_id, so reruns agree; of rows
    with one doc_id the text's hash decides, and equal rows may swap. Empty tables give no rows.
    Columns that the operator adds replace those of the same names. Rows are written once with all their columns; a caller
    that needs no texts gives ``size`` and ``text_hash`` (for ties) instead of ``text``.
    """
    measured = "text" not in docs.columns
    docs = docs.drop("source_size", "target", "taken") if measured else docs.drop("size", "source_size", "target", "taken")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = docs.withColumn("__key", key)
    if measured:
        rows = rows.withColumn("size", F.coalesce("size", F.lit(0)).cast("long")).withColumnRenamed("text_hash", "__text")
    else:
        rows = rows.withColumn("size", n_words()).withColumn("__text", F.xxhash64("text"))
    rows = materialize(rows, "mix-sizes")
    most = rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    while shards * shard_rows < most:
        shards *= 2
    number = F.conv(F.concat(F.substring("__key", 5, 8), F.substring("__key", 1, 4)), 16, 10).cast("long")
    rows = rows.withColumn("__shard", (number % shards).cast("int"))

    cells = materialize(rows.groupBy("source", "__shard").agg(F.sum("size").alias("__words")), "mix-cells")
    targets = source_targets(cells.groupBy("source").agg(F.sum("__words").alias("source_size")), weights, repeats)
    every = Window.partitionBy()
    targets = targets.withColumn("__seats", F.sum("source_size").over(every))
    targets = apportion(targets.withColumn("__one", F.lit(1)), "target", "__seats", ["__one"], "turn")
    targets = materialize(targets.select("source", "source_size", "target", F.col("quota").alias("__seats")), "mix-targets")
    named = targets.withColumnRenamed("source", "__source")
    cells = cells.join(named, cells.source.eqNullSafe(named.__source)).drop("__source")
    cells = apportion(cells, "__words", "__seats", ["source"], "__shard")
    start = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce("source", F.lit("")), "__shard").cast("binary"))
    cells = cells.select(
        F.col("source").alias("__source"), F.col("__shard").alias("__s"), "source_size", "target", "__words",
        F.expr(f"least(quota, {repeats} * __words)").alias("__quota"),
        (F.conv(F.substring(start, 1, 8), 16, 10).cast("long") % F.greatest(F.lit(1), F.col("__words"))).alias("__from"),
    )
    cells = materialize(cells, "mix-quotas")

    order = Window.partitionBy("source", "__shard").orderBy("__key", "doc_id", "__text")
    rows = rows.withColumn("__at", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.join(cells, rows.source.eqNullSafe(cells.__source) & (rows.__shard == cells.__s))
    rows = rows.withColumn("__rest", F.expr("CASE WHEN __words > 0 THEN __quota % __words ELSE 0 END"))
    inside = "greatest(0, least(__at + size, {0}) - greatest(__at, {1}))"
    ahead, around = inside.format("__from + __rest", "__from"), inside.format("__from + __rest - __words", "0")
    taken = F.expr(f"CASE WHEN size = 0 THEN 0 ELSE size * (__quota div __words) + {ahead} + {around} END")
    kept = [c for c in docs.columns if not (measured and c in ("size", "text_hash"))]
    return rows.select(*kept, "size", "source_size", "target", taken.cast("long").alias("taken"))
