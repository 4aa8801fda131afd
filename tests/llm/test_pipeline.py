import re
from collections import Counter

import duckdb
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from assay.llm.quality_ensemble import fit_quality_ensemble, score_quality
from assay.llm.sql import SQL
from assay.llm.storage import table


def test_stages_keep_the_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        n = docs.count()
        if name not in ("source_mixing", "sharding"):
            assert docs.columns == columns and (before is None or n <= before)
        before = n
    assert {"shard", "slot", "size"} <= set(docs.columns)
    shards = {r.shard: (r.n, r.top) for r in docs.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top")).collect()}
    assert all(n == top + 1 for n, top in shards.values())


def test_stages_on_odd_and_empty_tables(spark, odd, empty):
    sf = "/root/testdata/sf0.001"
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert out.where("size IS NOT NULL AND size <> 1").isEmpty() if "size" in docs.columns else True
            assert out.isEmpty() if docs is empty else True
        assert {"size", "shard", "slot"} <= set(corpus_pipeline.STAGES[-1][1](spark, docs, sf).columns)


def test_first_stage_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, sf).select("doc_id").withColumn("kept", F.lit(True))
    by = {r.quality: r.share for r in labels.join(kept, "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(False)).cast("double")).alias("share")).collect()}
    assert by[1] > 0.97 and by[0] < 0.1


def _words(text):
    out = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(out[i : i + 5]) for i in range(max(1, len(out) - 4))} if out else set()


def test_rows_from_end_to_end(spark):
    """Each stage against a plain version on what the one before kept: scores as they are, sets in Python, the rest by SQL."""
    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf).select("doc_id", "text", "size", "shard", "slot").collect()
    table_docs = table(spark, sf, "documents")
    scored = score_quality(table_docs.select("doc_id", "text"), fit_quality_ensemble(table_docs, table(spark, sf, "labels")))
    docs = {r.doc_id: r for r in table_docs.join(scored.where("score >= 0.3").select("doc_id"), "doc_id").collect()}

    sets = {i: _words(r.text) for i, r in docs.items()}
    group = {i: i for i in docs}

    def head(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((head(a), head(b)))
                group[y] = x
    kept = [i for i in ids if head(i) == i]
    assert len(kept) < len(ids) < table_docs.count()

    con = duckdb.connect()
    frame = pd.DataFrame([docs[i].asDict() for i in kept])
    con.register("documents", frame)
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet'")
    leaks = {r[0] for r in con.sql(f"SELECT doc_id FROM ({SQL['op8_decontamination']})").fetchall()}
    frame = frame[~frame.doc_id.isin(leaks)]
    con.unregister("documents")
    con.register("documents", frame)
    mixed = con.sql(f"SELECT doc_id, size, taken FROM ({SQL['op7_mixing']})").fetchall()
    copies = {i: 1 if size == 0 else (2 * taken + size) // (2 * size) for i, size, taken in mixed}
    assert leaks and Counter(r.doc_id for r in got) == Counter({i: n for i, n in copies.items() if n})

    order = sorted(got, key=lambda r: (r.doc_id, r.shard, r.slot))
    total, upto, slots = sum(r.size for r in got), 0, Counter()
    for r in order:
        assert r.text == docs[r.doc_id].text and r.size == len((r.text or "").encode()) + 1
        upto += r.size
        assert r.shard == min(15, 16 * (2 * upto - r.size) // (2 * total)) and r.slot == slots[r.shard]
        slots[r.shard] += 1
