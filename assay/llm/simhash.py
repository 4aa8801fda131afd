"""SimHash near duplicates: all pairs within a Hamming radius, by covering locality-sensitive hashing.

Every bit of a fingerprint is given a non-zero vector of radius + 1 bits, in turn. For each non-zero
vector v the mask of table v holds the bits whose vectors have an odd inner product with v. Two
fingerprints that differ in at most ``radius`` bits leave some v orthogonal to all vectors of those
bits, so they agree under that mask: every pair within the radius collides in some of the
2^(radius + 1) - 1 tables.

Buckets are never turned into pairs. A bucket of two is settled by the bits in which the two differ.
In a larger one all fingerprints agree on the mask, so two of them lie within the radius exactly if
some point half-way, reached from either by flipping radius / 2 other bits, is the same: each
fingerprint is dealt to its half-way points, and a point links the few that can reach it. Work is
thus in proportion to the rows of a bucket, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import materialize

_BITS = 64
_PIECE = 1 << 20
_SPACES = b" \t\n\r\x0b\x0c"


def covering_masks(radius: int, bits: int = _BITS) -> list[int]:
    """Masks of the tables; each bit is in about half of them."""
    vectors = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(bits) if (v & (1 + i % vectors)).bit_count() % 2) for v in range(1, vectors + 1)]


def half_way_flips(mask: int, radius: int, bits: int = _BITS) -> list[int]:
    """All ways to flip at most radius / 2 bits outside the mask."""
    free = [1 << i for i in range(bits) if not mask >> i & 1]
    return [sum(x) for n in range(radius // 2 + 1) for x in combinations(free, n)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about ``_PIECE`` bytes that end where a word does."""
    at = 0
    while at < len(text):
        end = at + _PIECE
        while end < len(text) and text[end] not in _SPACES:
            end += 1
        yield text[at:end]
        at = end


def fingerprint(text: bytes, words: int) -> int:
    """SimHash over the shingles of one text, unsigned; a text without words has zero."""
    ones, n, held = np.zeros(_BITS, np.int64), 0, []
    for piece in _pieces(text):
        held += piece.lower().split()
        if len(held) < words:
            continue
        ends = list(accumulate(len(w) + 1 for w in held))
        joined = b" ".join(held)
        hashes = [xxhash.xxh64_intdigest(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[words - 1 :])]
        ones += np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, _BITS).sum(0, dtype=np.int64)
        n += len(hashes)
        held = held[len(held) - words + 1 :]
    if not n and held:
        return xxhash.xxh64_intdigest(b" ".join(held), 42)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x, words) for x in batch.column("text").to_pylist()]
            found = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", "fp"])

    return rows


def near_links(heads: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) that join up all fingerprints within the radius; ``heads`` has the distinct ones as fp."""
    masks = covering_masks(radius)
    flips = F.array(*(F.array(*(F.lit(_signed(x)) for x in half_way_flips(m, radius))) for m in masks))
    tables = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)))
    dealt = heads.select("fp", F.inline(tables))
    buckets = dealt.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    buckets = materialize(buckets.where("n > 1"), "simhash-buckets")
    two = buckets.where(f"n = 2 AND bit_count(a ^ b) <= {radius}").select("a", "b")
    more = dealt.join(buckets.where("n > 2").select("t", "key"), ["t", "key"], "left_semi")
    points = more.select("t", "fp", F.explode(F.get(flips, F.col("t"))).alias("flip"))
    points = points.groupBy("t", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    # a point is reached from no more fingerprints than it has flips
    points = points.agg(F.min("fp").alias("a"), F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    points = points.select("a", F.explode("fps").alias("b")).where("a <> b")
    return two.unionByName(points).distinct()


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """Connected components of documents whose SimHash fingerprints differ in at most ``radius`` bits.

    Words are runs of characters other than space and tabs or line ends, with A-Z lowered; shingles
    of ``words`` words, repeats included, are hashed by XXH64 with seed 42; a shorter text is one
    shingle, and one without words, or null, has fingerprint zero and links like any other. A bit is
    1 if it is set in over half the hashes. ``radius`` is even.

    Returns doc_id, fingerprint (16 lowercase hex digits) and component_id (the smallest doc_id
    reachable, itself included), one row per input row; doc_id has any type that can be ordered.
    Rows with one doc_id count as one node, whatever their texts. A null doc_id has a null component
    and links nothing. Other columns are ignored; an empty table gives no rows.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    members = materialize(texts.mapInArrow(_fingerprints(words), f"doc_id {kind}, fp long"), "simhash-members")
    known = members.where("doc_id IS NOT NULL")
    heads = materialize(known.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-heads")
    # rows that repeat a doc_id tie their fingerprints together
    several = known.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("doc_id", "a")
    tied = known.join(materialize(several, "simhash-repeated"), "doc_id").select("a", F.col("fp").alias("b"))
    found = connected_components(near_links(heads.select("fp"), radius).unionByName(tied))
    heads = heads.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    heads = materialize(heads.select("fp", "least", F.coalesce("component", "fp").alias("component")), "simhash-components")
    least = heads.groupBy("component").agg(F.min("least").alias("component_id"))
    out = members.join(heads.join(least, "component").select("fp", "component_id"), "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))
