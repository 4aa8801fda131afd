"""Samples stay bounded when ids repeat; ids of any type; mixing without texts."""

import zlib

import pytest
from pyspark.sql import functions as F

from assay.llm import jaccard_join, line_dedup
from assay.llm.decontamination import contaminated, decontaminate
from assay.llm.jaccard_join import jaccard_components
from assay.llm.lang_id import fit_language_trees
from assay.llm.line_dedup import dedup_lines
from assay.llm.mixing import mix_sources
from assay.llm.statistics import labelled_sample
from assay.llm.storage import thinned
from assay.llm.suffix_dedup import remove_repeated_strings
from assay.llm.text import n_words


def test_a_repeated_id_is_sampled_once(spark):
    often = next(i for i in range(10) if zlib.crc32(str(i).encode()) % 5 and zlib.crc32(str(i).encode()) % 3 != 1)  # held out of neither
    many = spark.range(10_000).select(F.lit(often).cast("long").alias("doc_id"), F.concat(F.lit("words of one id "), F.col("id") % 50).alias("text"), F.lit("en").alias("lang"))
    others = spark.range(10, 60).select(F.col("id").alias("doc_id"), F.concat(F.lit("another text "), "id").alias("text"), F.lit("de").alias("lang"))
    docs = many.unionByName(others)
    labels = spark.createDataFrame([(i, i % 2) for i in [often, *range(10, 60)]], "doc_id long, toxic int")
    sample, weights = labelled_sample(docs.select("doc_id", "text"), labels, "toxic", 20)
    rows = sample.collect()
    assert len(rows) == len({r.doc_id for r in rows}) <= 40 and set(weights) == {0, 1}
    # the same row whatever the order of rows
    again, _ = labelled_sample(docs.repartition(7).select("doc_id", "text"), labels, "toxic", 20)
    assert {(r.doc_id, r.text) for r in again.collect()} == {(r.doc_id, r.text) for r in rows}
    assert labelled_sample(docs.select("doc_id", "text"), labels, "toxic", 20, max_bytes=5)[0].count() == 0
    # the id gives one text and not 10,000; its counts are those of a table with one row
    trees = fit_language_trees(docs, per_lang=400)
    one = many.where(F.col("text") == [r.text for r in labelled_sample(many.select("doc_id", "text"), labels, "toxic", 100)[0].collect()][0]).limit(1)
    alone = fit_language_trees(one.unionByName(others), per_lang=400)
    assert trees.langs == alone.langs and all((a[2] == b[2]).all() and (a[3] == b[3]).all() for a, b in zip(trees.levels, alone.levels, strict=True))


@pytest.fixture
def named(rows, spark):
    by_name = [(f"doc-{i}" if i % 5 else None, i, t) for i, t, *_ in rows]
    return spark.createDataFrame(by_name, "doc_id string, n long, text string")


def test_repeated_strings_with_text_ids(spark, docs, named):
    want = {r.doc_id: (r.n_removed, r.kept_sha256) for r in remove_repeated_strings(docs, 200).collect()}
    got = sorted((r.n_removed, r.kept_sha256) for r in remove_repeated_strings(named, 200).collect())
    assert got == sorted(want.values())


def test_decontamination_with_text_ids(spark, rows, docs, named):
    item = " ".join(rows[4][1].split()[3:30])
    bench = spark.createDataFrame([("q1", item), (None, "x")], "item_id string, text string")
    want = {r.doc_id for r in contaminated(docs, bench).collect()}
    got = {r.doc_id for r in contaminated(named, bench).collect()}
    assert want and got == {f"doc-{i}" if i % 5 else None for i in want}
    kept = {r.n for r in decontaminate(named, bench).collect()}
    assert kept == {i for i, *_ in rows} - want


def test_mixing_by_measured_sizes(spark, docs):
    whole = {r.doc_id: (r.size, r.taken) for r in mix_sources(docs.select("doc_id", "source", "text"), seed=17).collect()}
    sizes = docs.select("doc_id", "source", n_words().alias("size"), F.xxhash64("text").alias("text_hash"))
    out = mix_sources(sizes, seed=17)
    assert out.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    assert {r.doc_id: (r.size, r.taken) for r in out.collect()} == whole


def test_filters_of_fixed_size(spark):
    rows = spark.createDataFrame([(i if i else None, str(i)) for i in range(5000)], "n long, x string")
    keys = rows.where("n IS NULL OR n % 100 = 0")
    got = {r.n for r in thinned(rows, keys, "n").collect()}
    assert got >= {None, *range(100, 5000, 100)} and len(got) < 60 and thinned(rows, keys, "n").columns == rows.columns
    assert thinned(rows, keys.limit(0), "n").count() == 0
    assert thinned(rows, rows, "n", "x", bits=64).count() == 5000  # a full filter lets all pass


def test_joins_without_filters_give_the_same_rows(docs, monkeypatch):
    key = lambda d: sorted(map(str, d.collect()))
    near, lines = key(jaccard_components(docs, 4, 85)), key(dedup_lines(docs.select("doc_id", "text")))
    for module in (jaccard_join, line_dedup):
        monkeypatch.setattr(module, "thinned", lambda rows, *_: rows)
    assert key(jaccard_components(docs, 4, 85)) == near and key(dedup_lines(docs.select("doc_id", "text"))) == lines
