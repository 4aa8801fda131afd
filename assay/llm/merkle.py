"""Merkle manifest of a dataset, level by level with lag and lead windows.

Nodes are numbered in order, once, by range partitions and carried counts. A run is ``idx div 16``
and a slot ``idx % 16``; windows are over single runs, so a source of any size is as many small
windows. In them the lags and leads of 1 to 15 rows, masked by slot and run length, are a node's
siblings; the first child of a run hashes it and its leads into the parent, which is a row of the
next level. Paths go back down by joins on the parent's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

FANOUT = 16
#: What a leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def leaf_digest(*values: Column) -> Column:
    """sha256 of the values, each as its UTF-8 byte count, a colon and itself, or ``-`` if null."""
    parts = [x.cast("string") for x in values]
    return F.sha2(F.concat(*(F.when(x.isNull(), "-").otherwise(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)) for x in parts)), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``idx``, the place within the group in the given order, from 0; rows alike in it may swap.

    Rows are range-partitioned by group and order, so only the first group of a partition goes on
    from partitions before it: what it carries over is one row per partition.
    """
    keys = [group, *order, "__tie"]
    rows = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys)
    rows = materialize(rows.withColumn("__part", F.spark_partition_id()), "merkle-ranges")
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("__part", group).agg(F.count("*").alias("n")).withColumn("__before", F.sum("n").over(before))
    carried = carried.where("__before > 0").select("__part", group, "__before")
    place = F.row_number().over(Window.partitionBy("__part", group).orderBy(*order, "__tie"))
    rows = rows.withColumn("idx", place.cast("long") - 1)
    rows = rows.join(F.broadcast(carried), ["__part", group], "left")  # at most one row per partition
    return rows.withColumn("idx", F.col("idx") + F.coalesce("__before", F.lit(0))).drop("__part", "__before", "__tie")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Add run, lone, and the digests of the run's other nodes to the left and right, each in one string.

    A lone node is the only one of its group.
    """
    run = "PARTITION BY g, run"
    lags = [f"CASE WHEN slot >= {k} THEN lag(digest, {k}) OVER ({run} ORDER BY slot) END" for k in range(FANOUT - 1, 0, -1)]
    leads = [f"CASE WHEN slot + {k} < length THEN lead(digest, {k}) OVER ({run} ORDER BY slot) END" for k in range(1, FANOUT)]
    nodes = nodes.selectExpr("*", f"idx div {FANOUT} AS run", f"int(idx % {FANOUT}) AS slot").selectExpr("*", f"count(*) OVER ({run}) AS length")
    nodes = nodes.selectExpr("*", "run = 0 AND length = 1 AS lone", f"concat_ws('', {', '.join(lags)}) AS left", f"concat_ws('', {', '.join(leads)}) AS right")
    return nodes.drop("length")


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Levels of nodes (g, idx, digest) from ``nodes`` up, and what remains of each group: (g, level, digest)."""
    levels, tops = [nodes], None
    while True:
        first = with_siblings(levels[-1].select("g", "idx", "digest")).where("slot = 0")
        parent = F.when(F.col("lone"), F.col("digest")).otherwise(F.sha2(F.concat("digest", "right"), 256))
        first = materialize(first.select("g", F.col("run").alias("idx"), "lone", parent.alias("digest")), "merkle-level")
        top = first.where("lone").select("g", F.lit(len(levels) - 1).alias("level"), "digest")
        tops = top if tops is None else tops.unionByName(top)
        above = first.where("NOT lone").drop("lone")
        if above.isEmpty():
            return levels, tops
        levels.append(above)


def _upwards(node: DataFrame) -> Column:
    """A node's own siblings, if its group has more nodes, ahead of its parent's path."""
    return F.when(F.col("lone"), F.col("path")).otherwise(F.concat(F.array(F.struct("left", "right")), F.col("path")))


def _parent_paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(g, run, subroot, path) for the parents of the lowest level; ``tops`` has g, level, subroot and path."""
    above = lambda level: tops.where(F.col("level") == level).select("g", F.lit(0).cast("long").alias("run"), "subroot", "path")
    paths = above(len(levels) - 1)
    for level in range(len(levels) - 1, 0, -1):
        here = with_siblings(levels[level]).join(paths, ["g", "run"])
        here = here.select("g", F.col("idx").alias("run"), "subroot", _upwards(here).alias("path"))
        paths = materialize(here.unionByName(above(level - 1)), "merkle-paths")
    return paths


def merkle_manifest(docs: DataFrame, found: Column | None = None) -> DataFrame:
    """Merkle tree with 16 children a node over each source's rows, and one over the sources' subroots.

    A leaf is the digest of ``FIELDS``; per source leaves ascend by doc_id, null ids first, rows of
    one id by leaf; a null source is a source of its own and comes first. While a source has several nodes,
    runs of 16 (the last one shorter) become the sha256 of their digests as hex text.

    Returns doc_id, source, leaf, subroot (of the source), root, path (the siblings' digests to the
    left and right at each level where there is more than one node, from the leaf up through the
    source's tree to the root) and found_leaf, one row per input row: the leaf if the text were ``found``, null where
    that is the text. Repeated rows are leaves of their own; null texts and other nulls are covered
    as such; other columns are not covered and left out. An empty table gives no rows.
    """
    spark = docs.sparkSession
    fields = [F.col(x) for x in FIELDS]
    # ``-`` sorts before ``=``
    group = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("source")))
    changed = F.lit(None).cast("string")
    if found is not None:
        changed = F.when(~found.eqNullSafe(F.col("text")), leaf_digest(*(found if x == "text" else F.col(x) for x in FIELDS)))
    leaves = docs.select("doc_id", group.alias("g"), leaf_digest(*fields).alias("digest"), changed.alias("found_leaf"))
    # written first, because cutting ranges reads rows twice and texts are to be hashed once
    leaves = materialize(numbered(materialize(leaves, "merkle-digests"), "g", ["doc_id", "digest"]), "merkle-leaves")
    levels, tops = _climb(leaves)
    tops = materialize(tops, "merkle-subroots")

    sources = tops.select(F.lit("all").alias("g"), F.col("g").alias("source_key"), "level", "digest")
    sources = materialize(numbered(sources, "g", ["source_key"]), "merkle-sources")
    top_levels, root = _climb(sources)
    root = root.select("g", "level", F.col("digest").alias("subroot"), F.expr(f"cast(array() AS {_PATH})").alias("path"))
    root_digest = next((r.subroot for r in root.collect()), None)  # one row, or none
    whole = with_siblings(sources).join(_parent_paths(top_levels, root).drop("subroot"), ["g", "run"])
    tops = whole.select(F.col("source_key").alias("g"), "level", F.col("digest").alias("subroot"), _upwards(whole).alias("path"))
    tops = materialize(tops, "merkle-source-paths")

    out = with_siblings(leaves).join(_parent_paths(levels, tops), ["g", "run"])
    source = F.when(F.col("g") != "-", F.expr("substring(g, 2)"))
    return out.select("doc_id", source.alias("source"), F.col("digest").alias("leaf"), "subroot", F.lit(root_digest).alias("root"), _upwards(out).alias("path"), "found_leaf")


def proof_digest() -> Column:
    """sha256 of all siblings of ``path``, from the leaf up."""
    return F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column) -> Column:
    """The root that a leaf and the siblings of ``path`` give."""
    return F.aggregate("path", leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))
