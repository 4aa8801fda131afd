"""Removal of byte strings that occur more than once, by bucket-pointer refinement.

Every string of ``length`` bytes is put in a bucket with the strings that share a q-gram in it,
and buckets are split on the bucket identifiers of later offsets until each holds equal strings:

1. Identifiers of q-grams are built recursively: that of 2h bytes at p is a function of those of
   h bytes at p and at p + h, so each round reuses the identifiers of the round before. They are
   functions of the bytes alone, hence equal on all executors with no global numbering.
2. Of the q-grams in a string, the one with the least identifier is its anchor, so strings that
   are equal have equal anchors at equal distances, and only one position in some hundred is an
   anchor. The initial buckets are those of the anchors' q-grams.
3. All strings with one anchor make a row: its starts are ``[x1, x2]``, its core is what they
   share, its extent what they cover. Rows of a bucket are sorted on the identifiers at the later
   offsets of their extents. Equal extents mean that all their strings repeat. A bucket with one
   distinct extent is finished. The others are split into narrower ranges of starts, whose
   buckets are the identifiers of the narrower cores, and so on down to single strings.

Singletons leave at once, and copies are one row per distinct extent after the first round, so
each round handles only the edges of repeats. Hot buckets are counted map-side first; rows meet
them in joins that Spark can split, and no bucket is ever gathered into one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import U64, final, mix, text_bytes
from .storage import materialize
from .text import row_id

_GRAM = 100
_SEGMENT = 1 << 18
_ROW = "row_id long, row_hash long, a int, x1 int, x2 int, open boolean, c1 long, c2 long, e1 long, e2 long"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_KEY = ["row_id", "row_hash"]


def gram_ids(data: np.ndarray) -> np.ndarray:
    """Identifiers of the 100-grams at all offsets, by recursive doubling."""
    n = len(data)
    ids = data.astype(U64)
    for h in (1, 2, 4):  # up to 8 bytes an identifier is the bytes themselves
        ids = ids[: n - 2 * h + 1] | ids[h : n - h + 1] << U64(8 * h)
    for h in (8, 16, 32):
        ids = mix(ids[: n - 2 * h + 1], ids[h : n - h + 1])
    return final(mix(ids[: n - _GRAM + 1], ids[_GRAM - 64 : n - 63]))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width``."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(U64).max, U64)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class _Grams:
    """Identifiers of longer strings at chosen offsets of one text."""

    def __init__(self, ids: np.ndarray, length: int):
        self.ids, self.half = ids, length // 2

    def at(self, x: np.ndarray) -> np.ndarray:
        """Of ``half`` bytes, from 100-grams that cover them."""
        out = self.ids[x]
        for step in range(_GRAM, self.half, _GRAM):
            out = mix(out, self.ids[x + min(step, self.half - _GRAM)])
        return out

    def pair(self, x1: np.ndarray, x2: np.ndarray, length: int, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two identifiers of the bytes from x1 to x2 + length, x2 - x1 <= length."""
        low = mix(self.at(x1), self.at(x1 + length - self.half) + salt)
        high = mix(self.at(x2 + length - self.half) ^ U64(0x5851F42D4C957F2D), self.at(x2) - salt)
        return low.view(np.int64), high.view(np.int64)


def _anchors(data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows (anchor, x1, x2, bucket, extent) of a text, one segment of starts at a time."""
    for lo in range(0, len(data) - length + 1, _SEGMENT):
        part = data[lo : lo + _SEGMENT + length - 1]
        ids = gram_ids(part)
        keys = (ids & U64(0xFFFFFFFF00000000)) | np.arange(len(ids), dtype=U64)
        anchor = (_least(keys, length - _GRAM + 1) & U64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        a, x1, x2 = anchor[first], first, np.r_[first[1:], len(anchor)] - 1
        e1, e2 = _Grams(ids, length).pair(x1, x2, length, (a - x1).astype(U64) << U64(32) | (a - x2).astype(U64))
        bucket = ids[a].view(np.int64)
        yield a + lo, x1 + lo, x2 + lo, bucket, bucket, e1, e2


def _ranges(data: np.ndarray, a: np.ndarray, x1: np.ndarray, x2: np.ndarray, length: int, width: int) -> tuple[np.ndarray, ...]:
    """Rows split into ranges of at most ``width`` starts, on a grid of distances to the anchor."""
    ids = gram_ids(data)
    g1, g2 = (a - x2) // width, (a - x1) // width
    many = g2 - g1 + 1
    of = np.repeat(np.arange(len(a)), many)
    g = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + g1[of]
    a = a[of]
    y1, y2 = np.maximum(a - (g + 1) * width + 1, x1[of]), np.minimum(a - g * width, x2[of])
    grams = _Grams(ids, length)
    # what all strings on this place of the grid share: it starts at the last of them and ends with the first
    start, size = a - g * width, length - width + 1
    core1 = mix(grams.at(start), g.astype(U64))
    core2 = mix(grams.at(start + size - grams.half), g.astype(U64) + U64(1))
    e1, e2 = grams.pair(y1, y2, length, (a - y1).astype(U64) << U64(32) | (a - y2).astype(U64))
    return of, a, y1, y2, core1.view(np.int64), core2.view(np.int64), e1, e2


def _first_rows(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in _KEY]
            found, size = [], 0
            for i in np.flatnonzero(np.diff(offsets) >= length):
                for x in _anchors(data[offsets[i] : offsets[i + 1]], length):
                    found.append((*(np.full(len(x[0]), k[i]) for k in keys), *x))
                    size += len(x[0])
                    if size > 50_000:
                        yield _batch(found)
                        found, size = [], 0
            if found:
                yield _batch(found)

    return rows


def _batch(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    columns = [np.concatenate(x) for x in zip(*found, strict=True)]
    columns[2:5] = [x.astype(np.int32) for x in columns[2:5]]
    if len(columns) < len(_NAMES):
        columns.insert(5, np.ones(len(columns[0]), bool))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=_NAMES)


def _next_rows(length: int, width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in _KEY]
            lists = batch.column("entities")
            at, flat = lists.offsets.to_numpy(), lists.values
            a, x1, x2 = (flat.field(c).to_numpy().astype(np.int64) for c in ("a", "x1", "x2"))
            is_open = flat.field("open").to_numpy(zero_copy_only=False)
            for i in range(len(batch)):
                s, e = at[i], at[i + 1]
                text = data[offsets[i] : offsets[i + 1]]
                order = np.argsort(x1[s:e], kind="stable") + s
                for part in _segments(x1[order]):  # long texts: only the bytes around these rows
                    p = order[part]
                    lo = int(x1[p].min())
                    hi = int(x2[p].max()) + length
                    of, *cols = _ranges(text[lo:hi], a[p] - lo, x1[p] - lo, x2[p] - lo, length, width)
                    cols[:3] = [x + lo for x in cols[:3]]
                    yield _batch([(*(np.full(len(of), k[i]) for k in keys), *cols[:3], is_open[p][of], *cols[3:])])

    return rows


def _segments(starts: np.ndarray) -> Iterator[slice]:
    """Runs of sorted starts no wider than a segment, and of bounded length."""
    lo = 0
    while lo < len(starts):
        hi = min(int(np.searchsorted(starts, starts[lo] + _SEGMENT, "right")), lo + 4096)
        yield slice(lo, hi)
        lo = hi


def _refine(rows: DataFrame, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """One round: rows whose strings all repeat, and rows still to be split."""
    bucket, extent = ["c1", "c2"], ["c1", "c2", "e1", "e2"]
    rows = materialize(rows, "suffix-rows")
    many = rows.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1").select(*bucket)
    rows = materialize(rows.join(materialize(many, "suffix-buckets"), bucket, "left_semi"), "suffix-shared")
    place = F.struct("row_id", "row_hash", "a", "x1", "x2", "open")
    distinct = materialize(rows.groupBy(*extent).agg(F.count("*").alias("copies"), F.min(place).alias("place")), "suffix-extents")
    repeated = rows.where("open").join(distinct.where("copies > 1").select(*extent), extent, "left_semi")
    repeated = materialize(repeated.select(*_KEY, "x1", "x2"), "suffix-repeated")
    if last:
        return repeated, None
    single = F.col("copies") == 1
    buckets = distinct.groupBy(*bucket).agg(F.count("*").alias("n"), F.max(single & F.col("place.open")).alias("unsettled"))
    buckets = materialize(buckets.where("n > 1 AND unsettled").select(*bucket), "suffix-unsettled")
    left = distinct.join(buckets, bucket, "left_semi")
    return repeated, left.select("place.row_id", "place.row_hash", "place.a", "place.x1", "place.x2", (single & F.col("place.open")).alias("open"))


def _strip(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            lists = batch.column("spans")
            at, flat = lists.offsets.to_numpy(), lists.values
            x1, x2 = (flat.field(c).to_numpy() for c in ("x1", "x2"))
            removed, spans, digests = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64), []
            for i in range(len(batch)):
                text = data[offsets[i] : offsets[i + 1]]
                s, e = at[i], at[i + 1]
                if e > s:
                    step = np.zeros(len(text) + 1, np.int32)
                    np.add.at(step, x1[s:e], 1)
                    np.add.at(step, x2[s:e] + length, -1)
                    gone = np.cumsum(step[:-1], dtype=np.int32) > 0
                    removed[i] = gone.sum()
                    spans[i] = gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()
                    text = text[~gone]
                digests.append(hashlib.sha256(text.tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed), pa.array(spans), pa.array(digests)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return rows


def repeated_starts(docs: DataFrame, length: int = 400, widths: tuple[int, ...] = (16, 1)) -> DataFrame:
    """Ranges ``[x1, x2]`` of starts of repeated strings, by (row_id, row_hash).

    ``docs`` has row_id, row_hash and text. ``widths``: starts in a row in the later rounds; the
    last is 1, so the result is exact. ``length`` is at least 200.
    """
    if length < 2 * _GRAM or widths[-1] != 1:
        raise ValueError("length must be 200 or more, and the last width 1")
    found, rows = [], docs.mapInArrow(_first_rows(length), _ROW)
    for width in [*widths, None]:
        repeated, left = _refine(rows, width is None)
        found.append(repeated)
        if left is not None:
            by_row = left.groupBy(*_KEY).agg(F.collect_list(F.struct("a", "x1", "x2", "open")).alias("entities"))
            rows = docs.join(by_row, _KEY).select(*_KEY, "text", "entities").mapInArrow(_next_rows(length, width), _ROW)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def remove_repeated_strings(docs: DataFrame, length: int = 400) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts anywhere else.

    Texts are UTF-8 bytes, null is empty, matches never cross texts, overlaps within a text count,
    and strings are judged on the input. Returns doc_id, n_bytes, n_removed, n_spans and
    kept_sha256 (of the remaining bytes), one row per input row. Texts shorter than ``length``
    stay whole; copies of a text are all removed; repeated rows are copies; rows with a null
    doc_id are handled like others; ids have any type; other columns of ``docs`` are ignored; an empty table gives
    an empty result.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumns({"row_id": row_id(docs), "row_hash": F.xxhash64("text")})
    spans = repeated_starts(docs.select(*_KEY, "text"), length)
    spans = spans.groupBy(*_KEY).agg(F.collect_list(F.struct("x1", "x2")).alias("spans"))
    joined = docs.join(spans, _KEY, "left").select("doc_id", "text", F.coalesce("spans", F.array().cast("array<struct<x1:int,x2:int>>")).alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_strip(length), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
