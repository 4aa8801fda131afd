"""Toxicity by a character n-gram linear classifier on naive Bayes features.

Each n-gram has the log ratio of its smoothed shares of toxic and other training texts. A text's
features are its n-gram frequencies times these ratios; a logistic regression with a ridge penalty
is fitted on them. At prediction weight and ratio are one number for each n-gram, so a text's score
is the mean of table entries over its positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import U64, final, mix
from .statistics import labelled_sample
from .storage import materialize
from .text import held_out, whole

_GRAMS = range(3, 7)
_SCALE = 300.0
_PIECE = 1 << 17


def _pieces(column: pa.Array) -> Iterator[tuple[int, str, int]]:
    """(row, characters, starts) of lower-case texts between spaces; long ones in pieces that overlap by an n-gram.

    N-grams that begin after the first ``starts`` characters are left to the next piece.
    """
    reach = max(_GRAMS) - 1
    for row, text in enumerate(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")).to_pylist()):
        text = f" {text} "
        last = max(0, len(text) - reach - 1) // _PIECE * _PIECE
        for lo in range(0, last, _PIECE):
            yield row, text[lo : lo + _PIECE + reach], _PIECE
        yield row, text[last:], len(text)


def grams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of all n-grams of a column of texts, about ``_PIECE`` characters at a time."""
    held, size = [], 0
    for piece in _pieces(column):
        held.append(piece)
        size += len(piece[1])
        if size >= _PIECE:
            yield from _hashes(held)
            held, size = [], 0
    if held:
        yield from _hashes(held)


def _hashes(pieces: list[tuple[int, str, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    lengths = np.array([len(p[1]) for p in pieces])
    row = np.repeat([p[0] for p in pieces], lengths)
    ends = np.cumsum(lengths)
    place = np.arange(ends[-1])
    left = np.repeat(ends, lengths) - place
    starts = place < np.repeat(ends - lengths + [p[2] for p in pieces], lengths)
    letters = final(np.frombuffer("".join(p[1] for p in pieces).encode("utf-32-le", "surrogatepass"), np.uint32) + U64(0x9E3779B97F4A7C15))
    h = letters
    for n in range(2, max(_GRAMS) + 1):
        if len(letters) < n:
            return
        h = mix(h[: len(letters) - n + 1], letters[n - 1 :])
        if n in _GRAMS:
            inside = np.flatnonzero((left[: len(h)] >= n) & starts[: len(h)])
            yield row[inside], final(h[inside])


class GramTable:
    """A number for each of some hashes, by open addressing; 0 for all others."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(hashes)).bit_length())
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, U64), np.zeros(1 << bits, values.dtype)
        slot, left = (hashes >> self.shift).astype(np.int64), np.arange(len(hashes))
        while len(left):
            free = np.flatnonzero(self.keys[slot[left]] == 0)
            at, which = np.unique(slot[left[free]], return_index=True)
            placed = left[free[which]]
            self.keys[at], self.values[at] = hashes[placed], values[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> self.shift).astype(np.int64)
        found = self.keys[slot]
        hit = found == hashes
        out = np.where(hit, self.values[slot], self.values.dtype.type(0))
        left = np.flatnonzero(~hit & (found != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            found = self.keys[slot[left]]
            hit = found == hashes[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found != 0)]
        return out


@dataclass
class ToxicityModel:
    """Weights of n-gram hashes, and the bias."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self):
        """A function from a column of texts to their scores."""
        table = GramTable(self.hashes, self.weights)

        def score(column: pa.Array) -> np.ndarray:
            total, n = np.zeros(len(column)), np.zeros(len(column))
            for row, h in grams(column):
                total += np.bincount(row, table(h), len(column))
                n += np.bincount(row, minlength=len(column))
            return 1 / (1 + np.exp(-np.clip(self.bias + _SCALE * total / np.maximum(n, 1), -500, 500)))

        return score


def minimise(loss, x: np.ndarray, rounds: int = 100, memory: int = 8, tolerance: float = 1e-7) -> np.ndarray:
    """Limited-memory BFGS with backtracking; ``loss`` gives value and gradient."""
    value, gradient = loss(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        step, alphas = -gradient, []
        for s, y, r in reversed(pairs):
            alphas.append(r * (s @ step))
            step = step - alphas[-1] * y
        if pairs:
            s, y, _r = pairs[-1]
            step = step * ((s @ y) / (y @ y))
        for (s, y, r), a in zip(pairs, reversed(alphas), strict=True):
            step = step + s * (a - r * (y @ step))
        slope, size = gradient @ step, 1.0 if pairs else 1.0 / max(1e-12, np.abs(gradient).sum())
        while True:
            new = x + size * step
            new_value, new_gradient = loss(new)
            if new_value <= value + 1e-4 * size * slope or size < 1e-10:
                break
            size /= 2
        s, y = new - x, new_gradient - gradient
        done = value - new_value <= tolerance * max(abs(value), 1e-12)
        x, value, gradient = new, new_value, new_gradient
        if done:
            break
        if s @ y > 1e-12:
            pairs = [*pairs[-memory + 1 :], (s, y, 1.0 / (s @ y))]
    return x


def train(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, labels: np.ndarray, weights: np.ndarray, n_columns: int, ridge: float = 1e-5, toxic_share: float = 1 / 3) -> tuple[np.ndarray, float]:
    """Ridge logistic weights and bias for sparse features (row, column, value), rows ascending.

    ``weights`` are what each text stands for within its class; together the toxic texts have
    ``toxic_share`` of the loss, so that a rare class still reaches scores of 0.5.
    """
    toxic = labels == 1
    share = np.where(toxic, toxic_share * weights / weights[toxic].sum(), (1 - toxic_share) * weights / weights[~toxic].sum())
    sign = np.where(toxic, 1.0, -1.0)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = x[:-1], x[-1]
        margin = sign * (b + np.bincount(rows, values * w[columns], len(labels)))
        g = -share * sign / (1 + np.exp(np.clip(margin, -500, 500)))
        gradient = np.append(np.bincount(columns, values * g[rows], n_columns) + ridge * w, g.sum())
        return float(share @ np.logaddexp(0, -margin) + ridge / 2 * (w @ w)), gradient

    x = minimise(loss, np.zeros(n_columns + 1))
    return x[:-1], float(x[-1])


def log_ratio(toxic: str = "toxic", other: str = "other", n_toxic: int = 0, n_other: int = 0) -> tuple[str, str]:
    """SQL for the smoothed log-count ratio of an n-gram in so many texts of each class, and for its standard error."""
    ratio = f"ln(({toxic} + 1) / {n_toxic + 2}) - ln(({other} + 1) / {n_other + 2})"
    return ratio, f"sqrt(1 / ({toxic} + 1) + 1 / ({other} + 1))"


def _support(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other texts of a batch each n-gram is, a few texts at a time."""
    for batch in batches:
        for lo in range(0, len(batch), 16):
            part = batch.slice(lo, 16)
            y = part.column("y").to_numpy()
            found = [np.empty((2, 0), np.int64)]
            for row, h in grams(part.column("text")):
                order = np.lexsort((row, h))
                row, h = row[order], h[order].view(np.int64)
                first = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.empty(0, bool)
                found.append(np.stack([h[first], row[first]]))
            h, row = np.unique(np.concatenate(found, axis=1), axis=1) if len(found) > 2 * len(_GRAMS) * 16 else np.concatenate(found, axis=1)
            names, at = np.unique(h, return_inverse=True)
            counts = [np.bincount(at, y[row] == k, len(names)).astype(np.int64) for k in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(names), *map(pa.array, counts)], names=["gram", "toxic", "other"])


def _frequencies(hashes: np.ndarray):
    """(y, order, hash, gram, share) of the known n-grams of each text, as lists."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = GramTable(hashes, np.arange(1, len(hashes) + 1, dtype=np.int32))
        for batch in batches:
            total = np.zeros(len(batch), np.int64)
            seen = []
            for row, h in grams(batch.column("text")):
                total += np.bincount(row, minlength=len(batch))
                at = table(h)
                seen.append(np.unique(row[at > 0].astype(np.int64) << 32 | at[at > 0] - 1, return_counts=True))
            keys = np.concatenate([x[0] for x in seen]) if seen else np.empty(0, np.int64)
            keys, which = np.unique(keys, return_inverse=True)
            n = np.bincount(which, np.concatenate([x[1] for x in seen]), len(keys)) if len(keys) else np.empty(0)
            row = keys >> 32
            ends = pa.array(np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((keys & 0xFFFFFFFF).astype(np.int32), (n / np.maximum(total[row], 1)).astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("order"), batch.column("hash"), *lists], names=["y", "order", "hash", "gram", "share"])

    return rows


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 1500, min_support: int = 3, deviations: float = 2.0) -> ToxicityModel | None:
    """A model from at most ``per_class`` labelled texts of each class.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out; null text counts as empty. N-grams are
    counted on the executors. Features are all n-grams in ``min_support`` texts or more whose log
    ratio is at least so many standard ``deviations`` from 0; the others tell the classes too little
    apart. None if a class has no text.
    """
    sample, weights = labelled_sample(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), "toxic", per_class)
    sample = materialize(sample.select("y", F.col("__order").alias("order"), F.xxhash64("text").alias("hash"), whole().alias("text")), "toxicity-sample")
    size = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}  # two rows
    if len(size) < 2:
        return None
    ratio, error = log_ratio(n_toxic=size[1], n_other=size[0])
    support = sample.select("y", "text").mapInArrow(_support, "gram long, toxic long, other long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    support = support.where(f"toxic + other >= {min_support}").select("gram", F.expr(ratio).alias("ratio"), F.expr(error).alias("error"))
    known = support.where(f"abs(ratio) >= {deviations} * error").select("gram", "ratio").toArrow().to_pandas().sort_values("gram")  # bounded by the sample
    hashes, ratios = known["gram"].to_numpy().view(U64), known["ratio"].to_numpy()
    found = sample.mapInArrow(_frequencies(hashes), "y int, order long, hash long, gram array<int>, share array<float>").toArrow().combine_chunks().to_batches()
    found = pa.Table.from_batches(found).to_pandas().sort_values(["order", "hash"], kind="stable")
    sizes = found["gram"].map(len).to_numpy()
    columns = np.concatenate([*found["gram"], np.empty(0, np.int32)]).astype(np.int32)
    values = np.concatenate([*found["share"], np.empty(0, np.float32)]) * _SCALE * ratios[columns]
    y = found["y"].to_numpy()
    w, b = train(np.repeat(np.arange(len(y), dtype=np.int32), sizes), columns, values.astype(np.float32), y, np.array([weights[int(k)] for k in y]), len(hashes))
    return ToxicityModel(hashes, (w * ratios).astype(np.float32), b)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.5), one row per input row.

    Null text counts as empty and gets the score of the bias alone; without a model all scores are
    0. Nulls in doc_id stay; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), whole().alias("text"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast((model.hashes, model.weights, model.bias))  # bounded by the sample
    kind = docs.schema["doc_id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = ToxicityModel(*shared.value).scorer()
        for batch in batches:
            score = scores(batch.column("text"))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(predict, f"doc_id {kind}, held_out boolean, score double, predicted int")
