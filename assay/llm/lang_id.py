"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to three bytes keeps how often each byte follows.
A byte that a context has seen costs -log2(count / (n + d)) bits, with n observations of d distinct
bytes; any other costs the escape -log2(d / (n + d)) and then what the next shorter context takes,
down to eight bits (method C without exclusion). The statistics are frozen after training, so the
cost of each (context, byte) is worked out once, and a text's exact code length is a sum of table
entries. The language with the shortest code is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import row_blocks, text_bytes
from .statistics import one_per_id
from .text import held_out, whole

_ORDER = 3
_PIECE = 1 << 20


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each byte follows each context in texts: (lang, k, code, n), for each batch.

    A context of k bytes and the byte after it are one number, the byte in the low eight bits. Long
    texts are counted in pieces.
    """
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in np.unique(langs.astype(str)):
            for i in np.flatnonzero(langs == lang):
                for lo in range(int(offsets[i]), int(offsets[i + 1]), _PIECE):
                    hi = min(lo + _PIECE, int(offsets[i + 1]))
                    for k in range(_ORDER + 1):
                        t = data[max(int(offsets[i]), lo - k) : hi].astype(np.int64)
                        if len(t) > k:
                            found, n = np.unique(sum(t[j : len(t) - k + j] << (8 * (k - j)) for j in range(k + 1)), return_counts=True)
                            columns = [pa.array([lang] * len(found)), pa.array(np.full(len(found), k, np.int32)), pa.array(found), pa.array(n)]
                            yield pa.RecordBatch.from_arrays(columns, names=["lang", "k", "code", "n"])


@dataclass
class ContextTrees:
    """Bits for each context, byte and language.

    ``first`` has all pairs of bytes. For longer contexts a level has the place of each context
    that was seen, what escaping from it costs, and the costs of the bytes seen after it; all others
    cost the escape and what the next shorter context takes. ``symbol`` numbers the bytes seen.
    """

    langs: list[str]
    symbol: np.ndarray
    first: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def costs(self, past: list[np.ndarray], s: np.ndarray) -> np.ndarray:
        """Bits of the symbols s; past[j] are the symbols j + 1 places before them."""
        width = len(self.first)
        state = past[0]
        out = self.first[state, s]
        for k, (where, escape, keys, bits) in enumerate(self.levels, 2):
            state = past[k - 1].astype(np.int64) * width ** (k - 1) + state
            context = where[state]
            out = out + escape[context]
            code = context.astype(np.int64) * width + s
            at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == code)
            out[hit] = bits[at[hit]]
        return out

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each row of a block in each language."""
        first = int(offsets[0])
        s = self.symbol[data[first : int(offsets[-1])]].astype(np.int32)
        unknown = len(self.first) - 1
        lengths = np.diff(offsets)
        begins = offsets[:-1] - first
        past = []
        for back in range(1, _ORDER + 1):  # before a text's start nothing is known
            before = np.full(len(s), unknown, np.int32)
            before[back:] = s[:-back] if back < len(s) else before[back:]
            for j in range(back):
                before[begins[lengths > j] + j] = unknown
            past.append(before)
        out = np.zeros((len(lengths), len(self.langs)))
        some = np.flatnonzero(lengths)
        if len(some):
            out[some] = np.add.reduceat(self.costs(past, s), begins[some], axis=0, dtype=np.float64)
        return out


def build_trees(counts: pd.DataFrame) -> ContextTrees:
    """Cost tables from counts of all contexts."""
    langs = sorted(counts["lang"].unique())
    seen = np.sort(counts.loc[counts["k"] == 0, "code"].unique()).astype(np.int64)
    width = len(seen) + 1
    symbol = np.full(256, width - 1, np.int64)
    symbol[seen] = np.arange(len(seen))

    def part(k: int) -> tuple[np.ndarray, ...]:
        rows = counts[counts["k"] == k]
        code = rows["code"].to_numpy().astype(np.int64)
        return code >> 8, symbol[code & 255], np.searchsorted(langs, rows["lang"].to_numpy()), rows["n"].to_numpy().astype(np.float64)

    def totals(row: np.ndarray, size: int, lang: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Observations, distinct bytes and the cost of escaping, for each context and language."""
        total, distinct = np.zeros((size, len(langs))), np.zeros((size, len(langs)))
        np.add.at(total, (row, lang), n)
        np.add.at(distinct, (row, lang), 1)
        return total, distinct, np.where(total > 0, -np.log2(np.maximum(distinct, 1) / np.maximum(total + distinct, 1)), 0.0)

    first = np.full((width, width, len(langs)), 8.0)
    for k in (0, 1):
        context, s, lang, n = part(k)
        row = symbol[context & 255] if k else np.zeros(len(s), np.int64)
        total, distinct, escape = totals(row, width if k else 1, lang, n)
        first = first + escape[:, None, :]
        cost = -np.log2(n / (total + distinct)[row, lang])
        if k:
            first[row, s, lang] = cost
        else:
            first[:, s, lang] = cost
    trees = ContextTrees(langs, symbol, first.astype(np.float32), [])
    for k in range(2, _ORDER + 1):
        context, s, lang, n = part(k)
        if not len(context):
            break
        names, row = np.unique(context, return_inverse=True)
        total, distinct, escape = totals(row, len(names) + 1, lang, n)  # the last one is any unknown context
        past = [symbol[(names >> (8 * j)) & 255] for j in range(k)]
        where = np.full(width**k, len(names), np.int32)
        where[sum(past[j] * width**j for j in range(k))] = np.arange(len(names), dtype=np.int32)
        keys, key = np.unique(row * width + s, return_inverse=True)
        of = keys // width
        bits = trees.costs([p[of] for p in past], keys % width) + escape[of]
        bits[key, lang] = -np.log2(n / (total + distinct)[row, lang])
        trees.levels.append((where, escape.astype(np.float32), keys, bits.astype(np.float32)))
    return trees


def fit_language_trees(docs: DataFrame, per_lang: int = 400, max_bytes: int = 1 << 20) -> ContextTrees | None:
    """Trees from a bounded sample: ``per_lang`` texts of each language, by a hash of doc_id.

    Documents whose crc32(doc_id as text) mod 3 is 1 are held out; null languages, null ids, null and empty
    texts are not learned from, nor texts of more than ``max_bytes`` bytes; of rows that repeat an id and language one is. All contexts
    of the sampled texts are kept. None without a text.
    """
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0) & ~held_out("doc_id", 3, 1))
    # only ids until the sample is settled; a cut on the hash leaves a few times its size to rank
    ids = known.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("place"))
    share = ids.groupBy("lang").agg((F.lit(4.0 * per_lang * (1 << 40)) / F.approx_count_distinct("doc_id")).alias("cut"))
    ids = ids.join(F.broadcast(share), "lang").where(F.col("place") <= F.col("cut")).select("doc_id", "lang", "place").distinct()  # one row per language
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    ids = ids.withColumn("rank", rank).where(F.col("rank") <= per_lang).select("doc_id", "lang")
    sample = one_per_id(known.join(F.broadcast(ids), ["doc_id", "lang"]), ["doc_id", "lang"], max_bytes)  # per_lang ids a language
    counts = sample.select("lang", "text").mapInArrow(_counts, "lang string, k int, code long, n long")
    counts = counts.groupBy("lang", "k", "code").agg(F.sum("n").alias("n")).toArrow().to_pandas()  # bounded by the sample
    return build_trees(counts) if len(counts) else None


def identify_language(docs: DataFrame, trees: ContextTrees | None) -> DataFrame:
    """Add lang_pred, score and bits_per_byte to doc_id, held_out.

    score is the share of the predicted language in 2^-bits over all languages. A null text, one
    without a letter, or any text without a model gives ``und`` with score 0. One row per input row,
    nulls in doc_id stay; other columns are ignored.
    """
    rows = docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), whole().alias("text"), whole().rlike(r"\p{L}").alias("letters"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    if trees is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    shared = docs.sparkSession.sparkContext.broadcast((trees.langs, trees.symbol, trees.first, trees.levels))  # bounded by the sample

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ContextTrees(*shared.value)
        names = np.array([*model.langs, "und"], object)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            bits = np.concatenate([_long_code_lengths(model, data, offsets[lo : hi + 1]) for lo, hi in row_blocks(offsets)]) if len(batch) else np.zeros((0, len(model.langs)))
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            best = bits.argmin(axis=1) if len(batch) else np.zeros(0, int)
            least = bits.min(axis=1, keepdims=True) if len(batch) else bits
            score = 1 / np.exp2(np.maximum(least - bits, -1000)).sum(axis=1)
            size = np.maximum(np.diff(offsets), 1)
            columns = [
                batch.column("doc_id"),
                batch.column("held_out"),
                pa.array(names[np.where(letters, best, len(model.langs))], pa.string()),
                pa.array(np.where(letters, score, 0.0)),
                pa.array(least[:, 0] / size, mask=~letters),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    return rows.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double, bits_per_byte double")


def _long_code_lengths(model: ContextTrees, data: np.ndarray, offsets: np.ndarray, size: int = 1 << 19) -> np.ndarray:
    """Code lengths of a block; a single long text is taken in pieces that overlap by a context."""
    if len(offsets) > 2 or offsets[-1] - offsets[0] <= size:
        return model.code_lengths(data, offsets)
    total = 0.0
    for lo in range(int(offsets[0]), int(offsets[-1]), size):
        hi = min(lo + size, int(offsets[-1]))
        back = max(int(offsets[0]), lo - _ORDER)
        total = total + model.code_lengths(data, np.array([back, hi])) - (model.code_lengths(data, np.array([back, lo])) if back < lo else 0)
    return total
