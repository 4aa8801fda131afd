"""Statistics of texts and labelled samples of them, as Spark columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import WORD, held_out, whole, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_WINDOW = 8


def base_statistics(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long).

    Words are runs of characters other than space and tabs or line ends; word_chars are their
    code points; n_symbols counts characters of SYMBOLS; n_dup_lines counts lines with a word
    that equal an earlier line; n_repeat_words counts words in windows of 8 words that occur
    twice or more in the text. Null text counts as empty: all are 0. The columns ``__words`` and
    ``__lines`` stay for further statistics; see ``without_scratch``.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = docs.drop(*names).withColumn("__words", words()).withColumn("__lines", F.filter(F.split(whole(), "\n"), lambda x: x.rlike(WORD)))
    hashes = F.expr(f"CASE WHEN size(__words) >= {_WINDOW} THEN transform(sequence(1, size(__words) - {_WINDOW - 1}), i -> xxhash64(slice(__words, i, {_WINDOW}))) ELSE array() END")
    rows = rows.withColumn("__h", hashes)
    # most texts repeat no window; only the others are sorted
    by_hash = "array_sort(transform(__h, (x, i) -> struct(x AS h, i AS i)))"
    twice = f"get(transform(array({by_hash}), s -> transform(filter(s, (x, i) -> get(s, i - 1).h <=> x.h OR get(s, i + 1).h <=> x.h), x -> x.i)), 0)"
    covered = f"get(transform(array(array_sort({twice})), p -> aggregate(transform(p, (x, i) -> least({_WINDOW}, coalesce(get(p, i + 1), x + {_WINDOW}) - x)), 0, (a, x) -> a + x)), 0)"
    repeats = F.expr(f"CASE WHEN size(array_distinct(__h)) < size(__h) THEN {covered} ELSE 0 END")
    return rows.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.regexp_count(whole(), F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": repeats.cast("long"),
    }).drop("__h")


def ratios(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Add the statistics that models read (double, never null); returns also their names.

    ``rows`` comes from ``base_statistics``. All are shares, so a text's length does not matter
    by itself; length is its own statistic.
    """
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    text = whole()
    adjacent = F.expr("size(filter(__words, (x, i) -> x <=> get(__words, i - 1)))")
    short = F.expr("size(filter(__words, x -> length(x) <= 3))")
    added = {
        "__s_length": F.log1p(F.col("n_words")),
        "__s_word_chars": F.col("word_chars") / n,
        "__s_symbols": F.col("n_symbols") / chars,
        "__s_upper": F.regexp_count(text, F.lit(r"\p{Lu}")) / chars,
        "__s_marks": F.regexp_count(text, F.lit(r"[!?]")) / chars,
        "__s_digits": F.regexp_count(text, F.lit(r"\p{N}")) / chars,
        "__s_stops": F.regexp_count(text, F.lit(r"[.,;:]")) / chars,
        "__s_adjacent": adjacent / n,
        "__s_distinct": F.size(F.array_distinct("__words")) / n,
        "__s_short": short / n,
        "__s_dup_lines": F.col("n_dup_lines") / F.greatest(F.size("__lines"), F.lit(1)),
        "__s_repeats": F.col("n_repeat_words") / n,
    }
    return rows.withColumns({k: v.cast("double") for k, v in added.items()}), list(added)


def without_scratch(rows: DataFrame) -> DataFrame:
    return rows.drop("__words", "__lines")


def one_per_id(rows: DataFrame, keys: list[str], max_bytes: int) -> DataFrame:
    """One row for each of the keys: of texts with at most ``max_bytes`` bytes the one with the least hash."""
    text = whole()
    rest = [F.col(c) for c in rows.columns if c not in keys]
    rows = rows.where(F.octet_length(text) <= max_bytes).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.xxhash64(text)).alias("__one"))
    return rows.select(*keys, "__one.*")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int = 1 << 20) -> tuple[DataFrame, dict[int, float]]:
    """At most ``per_class`` labelled documents of each class, and what one of them stands for.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out. Which ids are taken depends on a
    hash of doc_id alone; of rows that repeat an id one is taken, and texts of more than ``max_bytes`` bytes are left
    out, so the sample holds no more than per_class * max_bytes bytes a class. Returns (docs with columns y and __order,
    weight by class); a document row is a match on doc_id.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", 5, 0))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).withColumn("__order", F.xxhash64("doc_id"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    parts = [known.where(F.col("y") == y).orderBy("__order", "doc_id").limit(per_class) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    weights = {y: n / min(n, per_class) for y, n in counts.items()}
    # at most 2 * per_class ids
    return one_per_id(docs.join(F.broadcast(chosen), "doc_id"), ["doc_id"], max_bytes), weights
