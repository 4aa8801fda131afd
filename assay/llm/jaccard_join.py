"""Jaccard self-join on word n-grams, with candidates filtered under several global token orders.

If two sets have a Jaccard similarity of t or more, each lacks at most m = n - ceil(t n) of its
tokens in the other. So under ANY global order of tokens the first m + s of either set hold the
first s tokens that they share. Each order gives a filter, and a pair has to pass all of them
before its sets are compared:

* Order 1, hash of the token. The first m + s tokens of all sets are counted; tokens of one set
  alone fall out, and so do sets with fewer than s tokens left (s is a fixed share of the set).
  Only a quarter of the tokens is shuffled for this, and most sets leave here.
* Order 2, frequency among the sets that remain, rare tokens first. A set whose tokens are not
  shared to a share of t leaves; of the others the first m + 1 tokens are postings for candidates.
  Rare-first prefixes keep passages that many documents share out of the postings, and a pair
  counts only at tokens early enough in both sets to leave the overlap that it needs.
* Order 3, tokens of one set alone first, then another hash. The prefixes of a candidate pair,
  about a quarter of its tokens, are joined to it and must have s tokens in common.

Only pairs that are left fetch their whole sets, and the exact similarity is taken. Groups of
thousands of near copies must not give all their pairs: in a first pass every posting list links
its sets to the most central one of them only, which joins such a group up in as many pairs as it
has sets. Then only pairs of sets that are still in different components, and share a posting,
are left, and all are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import U64, WordHasher, final, row_blocks, shingles, text_bytes
from .components import connected_components
from .storage import materialize, thinned

_SLACK = 8  # one in so many tokens: the size of s
_SIGNATURE = U64(0xA0761D6478BD642F)


def _sets(column: pa.Array, words: int, hasher: WordHasher) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text."""
    data, offsets = text_bytes(column)
    for lo, hi in row_blocks(offsets):
        hashes, at = hasher.words(data, offsets[lo : hi + 1])
        for i in range(hi - lo):
            yield np.unique(shingles(hashes[at[i] : at[i + 1]], words))


def _least(n: int, percent: int) -> int:
    """ceil(t n) without rounding errors."""
    return -(-percent * n // 100)


def _prefix(tokens: np.ndarray, percent: int) -> np.ndarray:
    """First m + s tokens under the order of their hashes."""
    n = len(tokens)
    size = min(n, n - _least(n, percent) + n // _SLACK + 1)
    return tokens[np.argpartition(tokens, size - 1)[:size]] if size < n else tokens


def _signatures(words: int, percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            sizes, low, high, prefix, ends = [], [], [], [], [0]
            for tokens in _sets(batch.column("text"), words, hasher):
                sizes.append(len(tokens))
                low.append(final(tokens).sum(dtype=U64))
                high.append(final(tokens ^ _SIGNATURE).sum(dtype=U64))
                prefix.append(_prefix(tokens, percent) if len(tokens) else tokens)
                ends.append(ends[-1] + len(prefix[-1]))
            flat = np.concatenate(prefix) if prefix else np.empty(0, U64)
            as_long = lambda x: pa.array(np.array(x, U64).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_hash"), pa.array(np.array(sizes, np.int64)), as_long(low), as_long(high), lists],
                names=["doc_id", "row_hash", "n", "s1", "s2", "prefix"],
            )

    return rows


def _all_tokens(words: int, size: int = 200_000):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()

        def out(ids: pa.Array, at: int, sets: list[np.ndarray]) -> pa.RecordBatch:
            sizes = np.array([len(x) for x in sets])
            of = np.repeat(np.arange(at, at + len(sets)), sizes)
            return pa.RecordBatch.from_arrays(
                [ids.take(pa.array(of)), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets).view(np.int64))], names=["id", "n", "token"]
            )

        for batch in batches:
            at, sets, held = 0, [], 0
            for tokens in _sets(batch.column("text"), words, hasher):
                sets.append(tokens)
                held += len(tokens)
                if held >= size:
                    yield out(batch.column("id"), at, sets)
                    at, sets, held = at + len(sets), [], 0
            if sets:
                yield out(batch.column("id"), at, sets)

    return rows


def _of_pairs(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b) with n and a column of both sets. Sets in no pair stay out of the shuffle; one in very many is split by Spark."""
    a, b = (sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col(column).alias(f"of_{x}")) for x in "ab")
    return pairs.join(thinned(a, pairs, "a"), "a").join(thinned(b, pairs, "b"), "b")


def share_prefixes(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose prefixes under order 3 have s tokens in common, s being that of the smaller set."""
    least = f"(({percent} * least(n_a, n_b) + 99) div 100) div {_SLACK} + 1"
    return _of_pairs(pairs, sets, "prefix_3").where(f"size(array_intersect(of_a, of_b)) >= {least}").select("a", "b")


def similar_sets(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose similarity is high enough, exactly. Tokens that no other set has count in n alone."""
    both = _of_pairs(pairs, sets, "tokens").withColumn("both", F.expr("size(array_intersect(of_a, of_b))"))
    return both.where(f"100 * both >= {percent} * (n_a + n_b - both)").select("a", "b")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    near = materialize(share_prefixes(pairs, sets, percent), "jaccard-near")
    return materialize(similar_sets(near, sets, percent), "jaccard-links")


def similarity_classes(docs: DataFrame, words: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets, and links that connect all classes of a component.

    Returns (members: doc_id, row_hash, n_shingles, id, one row per input row) and (links: a, b
    between ids). An id is the least (doc_id, row_hash) of a class, with the hash of its text. Every
    two sets whose similarity is ``percent`` or more are in one component of the links.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row_hash", F.xxhash64("text"))
    signed = docs.mapInArrow(_signatures(words, percent), f"doc_id {kind}, row_hash long, n long, s1 long, s2 long, prefix array<long>")
    signed = materialize(signed, "jaccard-signatures")
    key, own = ["n", "s1", "s2"], F.struct("doc_id", "row_hash")
    one = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min(own).alias("id"), F.any_value("prefix").alias("prefix"))
    one = materialize(one, "jaccard-classes")
    members = signed.select("doc_id", "row_hash", *key).join(one.select(*key, "id"), key, "left")
    members = members.select("doc_id", "row_hash", F.col("n").alias("n_shingles"), F.coalesce("id", own).alias("id"))

    # order 1
    postings = one.select("id", "n", F.explode("prefix").alias("token"))
    shared = materialize(postings.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1").select("token"), "jaccard-tokens-1")
    left = postings.join(shared, "token", "left_semi").groupBy("id").agg(F.count("*").alias("found"), F.first("n").alias("n"))
    share = f"(({percent} * n + 99) div 100)"
    left = materialize(left.where(f"found >= {share} div {_SLACK} + 1").select("id.*"), "jaccard-left-1")
    row = ["doc_id", "row_hash"]  # the join and the removal of repeated rows take one shuffle
    texts = thinned(docs, left, *row).join(left, row, "left_semi").dropDuplicates(row).select(own.alias("id"), "text")

    # order 2: tokens by frequency, then by value; those of one set alone come first in orders 2 and 3
    tokens = materialize(texts.mapInArrow(_all_tokens(words), f"id struct<doc_id:{kind},row_hash:long>, n long, token long"), "jaccard-tokens")
    shared = materialize(tokens.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1"), "jaccard-tokens-2")
    sets = tokens.join(shared, "token").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("sets", "token"))).alias("found"))
    sets = sets.where(f"size(found) >= {share}").select("id", "n", (F.col("n") - F.size("found")).alias("alone"), F.col("found.token").alias("tokens"))
    ordered = F.array_sort(F.transform("tokens", lambda x: F.xxhash64(x)))
    sets = sets.withColumn("prefix_3", F.slice(ordered, 1, F.expr(f"int(n - {share} + {share} div {_SLACK} + 1 - alone)")))
    sets = materialize(sets, "jaccard-sets")
    prefix = F.slice("tokens", 1, F.expr(f"int(n - {share} + 1 - alone)"))
    postings = sets.select("id", "n", "alone", F.posexplode(prefix).alias("place", "token")).withColumn("place", F.col("alone") + F.col("place"))

    # at the first token that two sets share, what comes before in either is not in the other
    overlap = f"least({{0}}n - {{0}}place, {{1}}n - {{1}}place)"
    fits = f"{100 + percent} * {overlap} >= {percent} * ({{0}}n + {{1}}n)"

    # one central set in each list
    centre = postings.groupBy("token").agg(F.count("*").alias("sets"), F.min(F.struct("alone", "id", "n", "place")).alias("c")).where("sets > 1")
    centre = materialize(centre.select("token", F.col("c.id").alias("b"), F.col("c.n").alias("c_n"), F.col("c.place").alias("c_place")), "jaccard-centres")
    postings = materialize(postings.join(centre.select("token"), "token", "left_semi").drop("alone"), "jaccard-postings")
    pairs = postings.join(centre, "token").where("id <> b").where(fits.format("", "c_")).select(F.col("id").alias("a"), "b").distinct()
    pairs = materialize(pairs, "jaccard-pairs")
    links = _links(pairs, sets, percent)

    # all other pairs between components
    group = connected_components(links)
    group = materialize(postings.join(group.withColumnRenamed("node", "id"), "id", "left").select("token", "id", "n", "place", F.coalesce("component", "id").alias("component")), "jaccard-grouped")
    mixed = group.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token")
    group = materialize(group.join(materialize(mixed, "jaccard-mixed"), "token", "left_semi"), "jaccard-open")
    x, y = (group.select("token", F.col("id").alias(a), *(F.col(c).alias(f"{a}_{c}") for c in ("n", "place", "component"))) for a in "ab")
    near = F.expr(f"a > b AND a_component <> b_component AND {fits.format('a_', 'b_')}")
    rest = x.join(y, "token").where(near).select("a", "b").distinct().join(pairs.union(pairs.select("b", "a")), ["a", "b"], "left_anti")
    rest = materialize(rest, "jaccard-rest")
    return members, links.unionByName(_links(rest, sets, percent))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Connected components of documents whose word n-grams have a Jaccard similarity >= percent/100.

    Words are runs of characters other than space and tabs or line ends, with A-Z lowered; a set
    is the distinct runs of ``words`` words, or all words where there are fewer; empty and null
    texts have an empty set and link with nothing. Returns doc_id, n_shingles and component_id
    (the smallest doc_id reachable, itself included), one row per input row; doc_id has any type
    that can be ordered. Rows with one doc_id count as one node, whatever their texts. A row with a
    null doc_id has a null component and links nothing, unless a document with the same set has an
    id. Other columns are ignored; an empty table gives no rows.
    """
    members, links = similarity_classes(docs, words, percent)
    # rows that repeat a doc_id tie their classes together
    known = members.where("doc_id IS NOT NULL AND n_shingles > 0")
    first = known.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("doc_id", "a")
    twice = known.join(materialize(first, "jaccard-repeated"), "doc_id").select("a", F.col("id").alias("b"))
    found = connected_components(links.unionByName(twice))
    out = members.join(found.withColumnRenamed("node", "id"), "id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id")["doc_id"])
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def one_per_group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without all but the first of each group of near duplicates, in order of doc_id.

    Texts decide: rows with one doc_id and unlike texts all stay; of rows alike in doc_id and text
    one stays; ties of one doc_id within a group go by the text's hash. Rows with a null doc_id
    cannot be told apart and all stay, and so do different ids with empty or null texts. Columns are
    those of ``docs``; an empty table gives no rows.
    """
    members, links = similarity_classes(docs, words, percent)
    found = connected_components(links).withColumnRenamed("node", "id")
    heads = members.where("doc_id IS NOT NULL").join(found, "id", "left").withColumn("head", F.coalesce("component", "id"))
    heads = heads.where("head.doc_id = doc_id AND head.row_hash = row_hash").select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash"))
    rows = docs.withColumn("__text", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = rows.join(heads, (rows.doc_id == heads["__id"]) & (rows["__text"] == heads["__hash"]), "left_semi").dropDuplicates(["doc_id", "__text"])
    return kept.drop("__text").unionByName(docs.where("doc_id IS NULL"))
