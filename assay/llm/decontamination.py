"""Benchmark leaks in training documents, found by spaced-seed hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .text import row_id, whole

#: Tokens that a seed reads (1) and skips (0).
#: The first two hit every choice of 13 of 16 tokens; all four also 12 of 15 and n - 2 of n = 12, 13, 14.
SEED_MASKS = ("1001001111", "11110001001", "1111101", "1110111")
_LONG_MASKS, _LONG, _WHOLE = 2, 16, 12
_BROADCAST_SEEDS = 2_000_000
_KEY = ["row_id", "row_hash"]


def tokens(text: str | Column = "text") -> Column:
    """Lower-case runs of letters and digits, in any script."""
    return F.regexp_extract_all(F.lower(whole(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _seed(number: int, offsets: list[int], hashes: str, at: str) -> str:
    """SQL for one seed: a hash of the token hashes at these offsets from a place; null where they reach past the end."""
    read = ", ".join(f"get({hashes}, {at} + {j})" for j in offsets)
    return f"CASE WHEN {at} + {max(offsets)} < size({hashes}) THEN xxhash64({number}, {read}) END"


def _seeded(rows: DataFrame, seeds: list[str]) -> DataFrame:
    """One row per place of the array ``h`` and seed there: the rows' columns, pos and seed.

    Places become rows before anything is hashed, so that hashing and the join's lookup run in
    generated code. The outer form keeps Spark from hashing all tokens once more to filter empty
    arrays first; their seeds are null.
    """
    places = rows.select("*", F.posexplode_outer("h").alias("pos", "__h"))
    return places.select("*", F.expr(f"stack({len(seeds)}, {', '.join(seeds)}) AS (seed)")).where("seed IS NOT NULL").drop("h", "__h")


def _offsets(mask: str) -> list[int]:
    return [j for j, x in enumerate(mask) if x == "1"]


def leaks(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = SEED_MASKS, window: int = 16, percent: int = 80, broadcast_seeds: int = _BROADCAST_SEEDS) -> DataFrame:
    """Pairs of documents and benchmark items that overlap: (row_id, row_hash, doc_id, item_id, matched, compared, start).

    Seeds of all documents join seeds of all items; a seed skips the tokens where its mask has 0,
    so a substituted token there does not hide a hit. A hit fixes how the two texts align. It
    counts if ``window`` aligned tokens (the whole item where it is shorter) that hold the seed
    agree in ``percent`` or more of their places. The first two masks serve items of 16 tokens and
    more, all of them shorter ones; with the given masks, window and percent every such place
    holds a seed, so none is missed. Items of fewer than 12 tokens must occur whole.
    matched and compared count over the whole alignment, start is the item's first token in the
    document (negative if it is cut off); of several alignments the best is returned.
    """
    items = benchmark.where("item_id IS NOT NULL").select("item_id", tokens().alias("item"))
    items = materialize(items.withColumn("ih", F.transform("item", lambda x: F.xxhash64(x))), "leak-items")
    sizes = [r.n for r in items.select(F.least(F.size("ih"), F.lit(_LONG)).alias("n")).distinct().collect()]  # at most 17 values
    short = [n for n in sizes if 0 < n < _WHOLE]
    if not any(_WHOLE <= n < _LONG for n in sizes):
        masks = masks[:_LONG_MASKS]
    span = min(map(len, masks))
    seeds = [_seed(k, _offsets(m), "h", "pos") for k, m in enumerate(masks)]
    keyed = items.select("item_id", F.size("ih").alias("len"), F.col("ih").alias("h"))
    of_item = _seeded(keyed.where(f"len >= {_LONG}"), seeds[:_LONG_MASKS]) if any(n >= _LONG for n in sizes) else None
    if any(_WHOLE <= n < _LONG for n in sizes):
        middle = _seeded(keyed.where(f"len >= {_WHOLE} AND len < {_LONG}"), seeds)
        of_item = of_item.unionByName(middle) if of_item else middle
    for n in short:
        seeds.append(_seed(-n, [*range(n)], "h", "pos"))
        whole_item = _seeded(keyed.where(f"len = {n}"), seeds[-1:])
        of_item = of_item.unionByName(whole_item) if of_item else whole_item
    if of_item is None:  # no item with a token
        of_item = _seeded(keyed.where("false"), seeds)
    of_item = of_item.withColumnRenamed("pos", "item_pos").distinct()
    of_item = materialize(of_item, "leak-seeds")
    small = of_item.count() <= broadcast_seeds  # else both sides are shuffled

    texts = docs.select("doc_id", *_KEY, "text")
    of_doc = _seeded(texts.select(*_KEY, F.transform(tokens(), lambda x: F.xxhash64(x)).alias("h")), seeds)
    hits = of_doc.join(F.broadcast(of_item) if small else of_item.hint("shuffle_merge"), "seed")
    hits = hits.select(*_KEY, "item_id", (F.col("pos") - F.col("item_pos")).alias("start"), "item_pos", "len").distinct()
    hits = materialize(hits, "leak-hits")

    # around each hit the texts are compared token by token
    lined = hits.groupBy(*_KEY, "item_id", "start", "len").agg(F.array_sort(F.collect_set("item_pos")).alias("seeds"))
    by_text = lined.groupBy(*_KEY).agg(F.collect_list(F.struct("item_id", "start", "len", "seeds")).alias("hits"))
    found = texts.join(by_text, _KEY).withColumn("tokens", tokens())
    found = found.select("doc_id", *_KEY, F.expr("""inline(transform(hits, x -> struct(x.item_id, x.start, x.len, x.seeds,
        slice(tokens, greatest(x.start, 0) + 1, x.len + least(x.start, 0)) AS part)))"""))
    found = found.join(items.select("item_id", "item"), "item_id")
    found = found.withColumn("from", F.expr("greatest(-start, 0)"))
    same = F.expr("transform(part, (x, i) -> int(x = get(item, i + from)))")
    found = found.withColumn("same", same).withColumn("w", F.expr(f"least({window}, len)"))
    # a window may start from w - span tokens before a seed up to the seed
    near = f"""exists(seeds, p -> exists(sequence(greatest(from, p + least({span}, len) - w), p), s ->
        s - from + w <= size(same) AND 100 * aggregate(slice(same, s - from + 1, w), 0, (a, x) -> a + x) >= {percent} * w))"""
    found = found.where(near)
    matched = F.expr("bigint(aggregate(same, 0, (a, x) -> a + x))")
    best = F.struct(matched.alias("matched"), (-F.abs("start")).alias("o"), F.size("same").cast("long").alias("compared"), F.col("start").cast("long").alias("start"))
    found = found.groupBy("doc_id", *_KEY, "item_id").agg(F.max(best).alias("b"))
    return found.select("doc_id", *_KEY, "item_id", "b.matched", "b.compared", "b.start")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"row_id": row_id(docs), "row_hash": F.xxhash64("text")})


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents with benchmark passages: doc_id, item_id, matched, compared, start; see ``leaks``.

    Tokens are lower-case runs of letters and digits. Empty and null texts and items match
    nothing, items with a null item_id are left out, documents with a null doc_id are reported
    under it. Ids have any type. Repeated rows give one row per item. Other columns are ignored.
    """
    return leaks(_keyed(docs), benchmark, **options).drop(*_KEY)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without those that hold a benchmark passage; columns stay as they are."""
    keyed = docs.withColumns({"__id": row_id(docs), "__hash": F.xxhash64("text")})
    bad = leaks(_keyed(docs.select("doc_id", "text")), benchmark, **options).select(F.col("row_id").alias("__id"), F.col("row_hash").alias("__hash")).distinct()
    return keyed.join(bad, ["__id", "__hash"], "left_anti").select(*docs.columns)
